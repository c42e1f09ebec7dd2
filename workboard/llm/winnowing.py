"""Benchmark decontamination by winnowing.

A text becomes words (A-Z lower-cased, runs outside ASCII punctuation and white
space). Of the ``WINDOW - K + 1`` hashes of K consecutive words inside every
window of ``WINDOW`` words the smallest is the window's fingerprint, so two texts
that share a span of ``WINDOW`` words or more share a fingerprint, always. Adjoining
windows of one fingerprint are one run. Test fingerprints are joined with the runs of
the documents; every window of a run that meets is extended to its words and compared
word by word, and adjoining windows merge into the covered positions. A benchmark item
of fewer words than a window (but not none) is one window of its own length, found by
its first word.

Up to BROADCAST_ROWS test windows are broadcast. Beyond, runs (id, text hash, places,
fingerprint; never words) are shuffled, and the texts of documents with meeting runs
are fetched once.

Defined results: a null text has no words; a very long text is one row's work, linear
in its length; repeated item rows count once per item id; an item with a null id marks
words but its id is not listed; rows of documents that agree in id and text get the
same result, found once; extra columns pass through :func:`contamination` untouched
unless they bear its result names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.llm.common import ascii_lower, let, stored, text_key, whole_text

WINDOW = 13
K = 5
#: Tables of test windows up to this many rows are broadcast; larger ones shuffle.
BROADCAST_ROWS = 500_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(whole_text(text)), NOT_WORD), lambda w: w != "")


def count_words(text: Column) -> Column:
    # The upper-case letters count as word characters here: no lower-casing needed.
    parts = F.split(whole_text(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def _spread(values: Column, width: int, op) -> Column:
    """``op`` over each run of ``width`` consecutive values, by doubling; the last ``width - 1`` places hold no whole run."""
    def shifted(x: Column, by: int) -> Column:
        return F.zip_with(x, F.slice(x, F.lit(by + 1), F.size(x)), op)

    def grow(x: Column, have: int) -> Column:
        if 2 * have <= width:
            return let(shifted(x, have), lambda y: grow(y, 2 * have))
        return shifted(x, width - have) if have < width else x

    return let(values, lambda x: grow(x, 1))


def fingerprints(words: Column) -> Column:
    """For each window, by its first word: the smallest hash of K consecutive words."""
    n = F.size(words)
    grams = F.slice(_spread(F.transform(words, lambda w: F.xxhash64(w)), K, lambda x, y: F.xxhash64(x, y)), F.lit(1), n - (K - 1))
    return F.when(n >= WINDOW, F.slice(_spread(grams, WINDOW - K + 1, lambda x, y: F.least(x, y)), F.lit(1), n - (WINDOW - 1)))


def runs(words: Column) -> Column:
    """``array<struct<first, last, fp>>``: adjoining windows with one fingerprint."""
    def cut(mins: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(mins)), lambda i: (i == 1) | (F.get(mins, i - 1) != F.get(mins, i - 2)))
        return let(starts, lambda at: F.transform(at, lambda s, j: F.struct(
            s.alias("first"), F.coalesce(F.get(at, j + 1) - 1, F.size(mins)).alias("last"), F.get(mins, s - 1).alias("fp"))))

    return F.when(F.size(words) >= WINDOW, let(fingerprints(words), cut))


def _first_word(word: Column) -> Column:
    return F.xxhash64(word, F.lit(WINDOW))


def _gram(words: Column, at: Column, n: Column | int) -> Column:
    # Not nullable: else a null test of it would run before the fingerprint join.
    return F.coalesce(F.array_join(F.slice(words, at, n), " "), F.lit(""))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """Hits: ``id, k`` (a document row), ``at`` (word position from 1), ``n`` (words), ``gram``; each once.

    Also the table of test windows and its number of rows.
    """
    bench = stored(items.select(F.col("item_id"), words_of(F.col("text")).alias("words"))
                   .filter(F.size("words") > 0), "bench-words")
    # Pruning columns keeps the words of long items out of the window table.
    full = (bench.filter(F.size("words") >= WINDOW)
            .select("item_id", "words", F.posexplode(fingerprints(F.col("words"))).alias("at", "fp"))
            .select("item_id", "fp", F.lit(WINDOW).alias("n"), _gram(F.col("words"), F.col("at") + 1, WINDOW).alias("gram")))
    short = (bench.filter(F.size("words") < WINDOW)
             .select("item_id", _first_word(F.element_at("words", 1)).alias("fp"), F.size("words").alias("n"),
                     F.array_join("words", " ").alias("gram")))
    windows = stored(full.unionByName(short).distinct(), "bench-windows")
    n_windows, n_short = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("n") < WINDOW).cast("long")), F.lit(0))).first()
    marks = _small(windows.groupBy("fp").agg(F.collect_set("n").alias("ns")), n_windows)

    words = F.col("words")
    found = runs(words)
    if n_short:
        firsts = F.transform(words, lambda w, i: F.struct((i + 1).alias("first"), (i + 1).alias("last"), _first_word(w).alias("fp")))
        found = let(firsts, lambda one: F.when(F.size(words) >= WINDOW, F.concat(runs(words), one)).otherwise(one))
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_key(whole_text(text)).alias("k"), words_of(text).alias("words"))
    met = rows.select("id", "k", "words", F.explode(found).alias("run")).select("id", "k", "words", "run.*").join(marks, "fp")
    if n_windows > BROADCAST_ROWS:
        spots = stored(met.groupBy("id", "k").agg(F.collect_set(F.struct("first", "last", "ns")).alias("spots")), "bench-spots")
        named = docs.select(F.col(id_col).alias("own_id"), text_key(whole_text(text)).alias("own_k"), text.alias("own_text"))
        met = (named.join(spots, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_k") == F.col("k")))
               .select("id", "k", words_of(F.col("own_text")).alias("words"), F.explode("spots").alias("spot"))
               .select("id", "k", "words", "spot.*"))
    hits = (met.select("id", "k", "words", "ns", F.explode(F.sequence("first", "last")).alias("at"))
            .select("id", "k", "words", "at", F.explode("ns").alias("n"))
            .filter(F.col("at") + F.col("n") <= F.size("words") + 1)
            .select("id", "k", "at", "n", _gram(words, F.col("at"), F.col("n")).alias("gram")))
    real = _small(windows.select("n", "gram").distinct(), n_windows)
    return hits.join(real, ["n", "gram"], "left_semi").distinct(), windows, n_windows


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with the columns :data:`RESULT`."""
    hits, windows, n_windows = find_hits(docs, items, id_col, text_col)
    hits = stored(hits, "bench-hits")
    # Windows in order of place: each adds the words beyond the last one covered.
    end = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        F.array_sort(F.collect_list(F.struct("at", F.col("n").cast("int").alias("n")))), end,
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["at"] + x["n"] - 1 - F.greatest(s["end"], x["at"] - 1))).cast("long").alias("n"),
                              F.greatest(s["end"], x["at"] + x["n"] - 1).cast("int").alias("end")), lambda s: s["n"])
    words = hits.groupBy("id", "k").agg(covered.alias("n_hit"))
    of = _small(windows.filter(F.col("item_id").isNotNull()).select("n", "gram", "item_id").distinct(), n_windows)
    listed = (hits.select("id", "k", "n", "gram").distinct().join(of, ["n", "gram"])
              .select("id", "k", F.col("item_id").cast("string").alias("item")).distinct()
              .groupBy("id", "k").agg(F.array_sort(F.collect_list("item")).alias("items")))
    found = words.join(listed, words["id"].eqNullSafe(listed["id"]) & (words["k"] == listed["k"]), "left").select(
        words["id"].alias("hit_id"), words["k"].alias("hit_k"), "n_hit", "items")

    # The input columns travel by number, whatever they are called.
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in RESULT}
    base = docs.select(*[F.col(c).alias(n) for c, n in own.items()], F.col(id_col).alias("id"), text_key(whole_text(F.col(text_col))).alias("k"), count_words(F.col(text_col)).alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return (base.join(found, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("k") == F.col("hit_k")), "left")
            .select(*[F.col(n).alias(c) for c, n in own.items()], "n_words", n_hit.alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
                    ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")))
