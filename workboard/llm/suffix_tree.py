"""Language-model scoring by a probabilistic suffix tree over words.

Tokens are the words of a text (A-Z lower-cased, split at ASCII white space) and
one end. The root of the tree predicts by the words' counts, with absolute
discounting: what the discounts free belongs to words never seen in training.
Below it stand contexts of one to DEPTH words, each read from the latest word
backwards, over all words. A context is tried if training has it MIN_COUNT times
or more, whatever the size of the corpus, and kept if its next words diverge from
those of its suffix, the context without its oldest word: if ``n * KL`` is above
``d / 2 * ln(n)`` for n occurrences with d different next words. A kept context is
smoothed with its longest kept suffix (Witten-Bell). A token is scored in the
longest kept context that the words before it end with.

A 64-bit hash stands for a word, a context and a (context, next word) pair. Tasks
combine the pairs of some million tokens and send them in rows of arrays to
buckets, dealt by the last two words of a pair (by its next word alone if that is
not among the FREQUENT most frequent ones; such a word has at most tokens /
FREQUENT occurrences). A pair thus meets its suffixes, and the count of its next
word, in its bucket. Buckets hold about BUCKET_TOKENS tokens each, whatever the
size of the corpus. Pairs of held-out documents travel along with a count of zero.
A pair that training has once, and no held-out document has, is not stored: a pair
of a training document that no table has is one of these, and counts one.

Scoring resolves in place what the most frequent words, pairs and kept contexts
(at most FREQUENT, FREQUENT_PAIRS and FREQUENT_CONTEXTS) and a bit map of the stored
pairs settle; all other tokens are sent to their bucket. A bit map never misses
what it holds, and what it lets through wrongly is settled in the bucket.

Defined results: a null text is empty (its only token is the end); a null id is
in training; rows are scored one by one, also when ids or texts repeat. Without
training tokens every probability is one. A very long text is hashed in one piece
by one task. Extra columns are ignored, also when called like columns of the result.
Texts are numbered by partition and place, so ``docs`` must give the same rows in the
same order when a lost task is run again, as a stored table does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.llm import common
from workboard.llm.hashing import U, mix64, word_hashes

MIN_COUNT = 16
DEPTH = 3
FREQUENT = 250_000
FREQUENT_PAIRS = 1_000_000
FREQUENT_CONTEXTS = 500_000
#: A task combines the pairs of this many tokens before it sends them.
HELD_TOKENS = 1_000_000
#: A task that scores sends its open tokens when it holds this many.
HELD_OPEN = 300_000
#: Tokens of the corpus per bucket.
BUCKET_TOKENS = 1_000_000
#: Bits of a map, as a power of two: sixteen per entry between these bounds.
MAP_BITS = (16, 28)
#: Bytes of text that a task hashes at a time (or one text).
PIECE = 4_000_000
END_CODE = mix64(U(0x5DEECE66D) + np.zeros(1, np.uint64))[0]
#: Columns of the rows in a bucket: words or other keys, counts, words before (the latest first); each an array of 64-bit numbers, packed.
NAMES = ["w", "n", *(f"c{k}" for k in range(1, DEPTH + 1))]
ARRAYS = ", ".join(f"{c} binary" for c in NAMES)
RESULT = ["uid", "id", "held_out", "n_tokens", "score", "base", "known"]
#: Kinds of rows in a bucket: counts of words, then stored pairs and contexts per level, then pairs or open tokens.
WORDS, PAIRS, CONTEXTS, SENT, TEXT = 0, 10, 20, 30, 40


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``common.stored``; the shuffle files behind the table go when it is written."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return common.stored(df, tag)
    finally:
        conf.set(name, before)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


# Tokens, contexts and pairs.

def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context and the word after it."""
    return mix64(context * U(0x9E3779B97F4A7C15) + word)


def _pieces(column: pa.Array):
    """(first, number) of runs of texts of at most PIECE bytes, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = int(ends[at - 1]) if at else 0
        to = max(int(np.searchsorted(ends, before + PIECE, "right")), at + 1)
        yield at, to - at
        at = to


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of all texts in a row: hashes, numbers of their texts, places in these."""
    codes, first = word_hashes(column)
    codes = np.insert(codes, first[1:], END_CODE)
    lens = np.diff(first) + 1
    doc = np.repeat(np.arange(len(column)), lens)
    return codes, doc, np.arange(len(codes)) - (np.cumsum(lens) - lens)[doc]


#: Stands for a word before that is not sent.
NONE = U(0xFFFFFFFFFFFFFFFF)


def _before(codes: np.ndarray, depth: int) -> list[np.ndarray]:
    """Per level the word that is ``level`` places before each token (of its text from place ``level`` on)."""
    return [np.concatenate([codes[:k], codes[:-k]])[: len(codes)] for k in range(1, depth + 1)]


def _of_words(before: list[np.ndarray]) -> list[np.ndarray]:
    """Contexts from the words before, the latest first; 0 from the first one that is not sent."""
    out = []
    for k in range(1, len(before) + 1):
        context = before[k - 1]
        for w in reversed(before[: k - 1]):
            context = _joined(context, w)
        out.append(np.where(before[k - 1] == NONE, U(0), context))
    return out


def _contexts(codes: np.ndarray, depth: int) -> list[np.ndarray]:
    """Per level the hash of the ``level`` tokens before each token (of its text from place ``level`` on)."""
    out, gram = [], codes
    for _ in range(depth):
        out.append(np.concatenate([gram[:1], gram[:-1]]))
        gram = _joined(out[-1], codes)
    return out


class Keys:
    """Sorted hashes with an index by their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(len(keys).bit_length(), 1)
        self.shift = U(64 - bits)
        sizes = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)

    def __reduce__(self):  # the index is made again
        return Keys, (self.keys,)

    def __len__(self):
        return len(self.keys)

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``asked`` (0 if missing), and whether they are there."""
        at, there = np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        if not len(self.keys) or not len(asked):
            return at, there
        slot = (asked >> self.shift).astype(np.int64)
        spot, end, open_ = self.starts[slot], self.starts[slot + 1], np.arange(len(asked))
        while len(open_):
            some = spot < end
            open_, spot, end = open_[some], spot[some], end[some]
            hit = self.keys[spot] == asked[open_]
            at[open_[hit]], there[open_[hit]] = spot[hit], True
            open_, spot, end = open_[~hit], spot[~hit] + 1, end[~hit]
        return at, there


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


class Map:
    """A bit map of hashes; its size follows their number up to a bound."""

    def __init__(self, hashes: DataFrame, count: int):
        self.bits = bits = min(max(int(16 * count).bit_length(), MAP_BITS[0]), MAP_BITS[1])
        at = F.shiftrightunsigned("h", 64 - bits)
        rows = (hashes.groupBy(F.shiftright(at, 15).alias("part"))
                .agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).collect()) if count else []
        out = np.zeros((1 << bits - 15, 4096), np.uint8)
        for r in rows:
            out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
        self.map = out.reshape(-1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> U(64 - self.bits)).astype(np.int64)
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _most(table: DataFrame, limit: int) -> Column:
    """True for the rows with the largest ``n``, at most ``limit``, from a histogram by eighths of an octave."""
    step = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, None
    for r in sorted(table.filter("n > 0").groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        if held + r["count"] > limit:
            break
        held, least = held + r["count"], r["s"]
    return (F.col("n") > 0) & (step >= least) if least is not None else F.lit(False)


def _sorted(table: pa.Table, key: str, *others: str) -> tuple[np.ndarray, ...]:
    keys = table[key].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], *(table[c].to_numpy()[order] for c in others)


class Root:
    """Figures of all training words, and the counts of the most frequent ones."""

    #: Contexts that a bucket knows besides its own: (keys, total, d, kept).
    along: tuple = ()

    def __init__(self, words: DataFrame):
        self.n, self.v, once, twice = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1),
                                                F.count_if(F.col("n") == 2)).first()
        self.discount = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)
        self.buckets = max(24, -(-self.n // BUCKET_TOKENS))
        most = words.filter(_most(words, FREQUENT) | (F.col("w") == int(END_CODE.view(np.int64))))
        words, self.counts = _sorted(most.toArrow(), "w", "n")
        self.words = Keys(words)

    def share(self, c: np.ndarray) -> np.ndarray:
        """The root's probability of words that training has ``c`` times (of any unseen word: one class)."""
        if not self.n:
            return np.ones(len(c))
        return np.where(c > 0, c - self.discount, self.discount * self.v) / self.n

    def short(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' places among those sent along, or the words (as hashes, these are larger), and which are places."""
        at, there = self.words.find(words)
        return np.where(there, at.astype(np.uint64), words), there

    def full(self, words: np.ndarray) -> np.ndarray:
        there = words < U(len(self.words))
        return np.where(there, self.words.keys[np.where(there, words, U(0)).astype(np.int64)], words) if len(self.words) else words

    def bucket(self, frequent: np.ndarray, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (np.where(frequent, _joined(before, words), mix64(words)) % U(self.buckets)).astype(np.int32)


def _count_words(batches):
    def send():
        words, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(words)
        first = _runs(words[order])
        return pa.RecordBatch.from_arrays([pa.array(words[order][first].view(np.int64)), pa.array(np.add.reduceat(n[order], first))],
                                          names=["w", "n"])

    held, size = [], 0
    for batch in batches:
        column = batch.column(0)
        for at, m in _pieces(column):
            words, n = np.unique(_tokens(column.slice(at, m))[0], return_counts=True)
            held.append((words, n))
            size += len(words)
            if size > HELD_TOKENS:
                yield send()
                held, size = [], 0
    if held:
        yield send()


def _pack(x: np.ndarray) -> bytes:
    """An array of 64-bit numbers, compressed by byte planes."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(x: bytes) -> np.ndarray:
    size = int.from_bytes(x[:8], "little")
    planes = np.frombuffer(pa.decompress(x[8:], 8 * size, "zstd", asbytes=True), np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.int64)


def _packed(buckets: np.ndarray, arrays: list[np.ndarray]) -> list[pa.Array]:
    """Arrays (w, n, c1, ...; missing ones null) in rows per bucket, as columns of a record batch."""
    order = np.lexsort((arrays[2] if len(arrays) > 2 else arrays[0], buckets))
    first = _runs(buckets[order])
    ends = np.append(first, len(order))
    rows = [pa.array([_pack(y[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()) for x in arrays for y in [x[order]]]
    return [pa.array(buckets[order][first], pa.int32()), *rows, *[pa.nulls(len(first), pa.binary())] * (2 + DEPTH - len(rows))]


def _rare_words(root):
    """Rows per bucket of the words that are not sent along, from ``w, n``."""
    def pack(batches):
        r = root.value
        for batch in batches:
            words, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            none = ~r.words.find(words)[1]
            words, n = words[none], n[none]
            if len(words):
                yield pa.RecordBatch.from_arrays(_packed(r.bucket(np.zeros(len(words), bool), words, words), [words, n]), names=["b", *NAMES])

    return pack


def _count_pairs(level: int, tried, root):
    """Rows per bucket of pairs after tried contexts, from ``held_out, text``; ``n``: twice the count, and one if a held-out text has it."""
    def count(batches):
        r, tries = root.value, tried.value

        def send():
            words, away, *before = (np.concatenate(x) for x in zip(*kept))
            kept.clear()
            gram = _joined(_of_words(before)[-1], words)
            order = np.argsort(gram)
            first = _runs(gram[order])
            away = away[order]
            n = 2 * np.add.reduceat(~away, first, dtype=np.int64) + np.maximum.reduceat(away, first)
            some = order[first]
            words, before = words[some], [c[some] for c in before]
            short, frequent = r.short(words)
            b = r.bucket(frequent, before[0], words)
            return pa.RecordBatch.from_arrays(_packed(b, [short, n, *(r.short(x)[0] for x in before)]), names=["b", *NAMES])

        kept, size = [], 0
        for batch in batches:
            column, out = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for at, m in _pieces(column):
                codes, doc, place = _tokens(column.slice(at, m))
                contexts = _contexts(codes, level)
                hit = np.flatnonzero((place >= level) & tries.has(contexts[-1]))
                kept.append((codes[hit], out[at + doc[hit]], *(c[hit] for c in _before(codes, level))))
                size += len(hit)
                if size > HELD_TOKENS:
                    yield send()
                    size = 0
        if size:
            yield send()

    return count


class Bucket:
    """The words, pairs and contexts that stand in one bucket."""

    def __init__(self, table: pa.Table, root: Root):
        kinds = table["kind"].to_numpy()
        self.root = root

        def of(kind, *names):
            rows = table.filter(pa.array(kinds == kind)).select(list(names))
            return [np.concatenate([np.zeros(0, np.int64), *(_unpack(x.as_py()) for x in c if x.is_valid)]) for c in rows.columns]

        def by_key(kind, *names):
            keys, *others = of(kind, *names)
            order = np.argsort(keys.view(np.uint64))
            return [Keys(keys.view(np.uint64)[order]), *(x[order] for x in others)]

        self.rare = by_key(WORDS, "w", "n")
        self.pairs = [by_key(PAIRS + k, "w", "n") for k in range(1, DEPTH + 1)]
        self.contexts = [by_key(CONTEXTS + k, "w", "n", "c1", "c2") for k in range(1, DEPTH + 1)]
        words, n, *contexts = of(SENT, *NAMES)
        before = [root.full(x.view(np.uint64)) for x in contexts if len(x) == len(words)]
        self.sent = [root.full(words.view(np.uint64)), n, *_of_words(before)]

    def counts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words, and which of them are sent along to all tasks."""
        at, frequent = self.root.words.find(words)
        spot, there = self.rare[0].find(words)
        rare = np.where(there, self.rare[1][spot], 0) if len(self.rare[0]) else np.zeros(len(words), np.int64)
        return np.where(frequent, self.root.counts[at], rare) if len(self.root.words) else rare, frequent

    def predict(self, words: np.ndarray, contexts: list[np.ndarray], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability after the longest kept one of the contexts, and share after the last one given.

        ``least`` is the count of a pair that is not stored.
        """
        p = q = self.root.share(self.counts(words)[0])
        for context, (grams, n), own in zip(contexts, self.pairs, self.contexts):
            tables = [x for x in (own, *self.root.along) if len(x[0])]
            if tables:
                spot, found = grams.find(_joined(context, words))
                count = np.where(found, n[spot], least) if len(grams) else least
            for keys, total, d, kept in tables:  # a context stands in one of them
                at, there = keys.find(context)
                q = np.where(there, count / np.maximum(total[at], 1), q)
                p = np.where(there & (kept[at] > 0), (count + d[at] * p) / (total[at] + d[at]), p)
        return p, q


def _settle(level: int, root):
    """Of a bucket: the pairs to store, and its part of the figures of the contexts of this level."""
    def settle(key, table):
        here = Bucket(table, root.value)
        words, n, *contexts = here.sent[: 2 + level]
        gram = _joined(contexts[-1], words)
        order = np.argsort(gram)
        first = _runs(gram[order])
        some = order[first]
        held = np.maximum.reduceat((n & 1)[order], first) if len(first) else n
        n = np.add.reduceat((n >> 1)[order], first) if len(first) else n
        gram, words, contexts = gram[some], words[some], [c[some] for c in contexts]
        _, q = here.predict(words, contexts[:-1], np.ones(len(n), np.int64))
        x = np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum(q, 1e-300)), 0.0)
        store = (n > 1) | ((n == 1) & (held > 0))
        longer = gram[(n >= MIN_COUNT) & (words != END_CODE)] if level < DEPTH else gram[:0]
        order = np.argsort(contexts[-1])
        first = _runs(contexts[-1][order])
        sums = [np.add.reduceat(y[order], first) if len(first) else y[:0] for y in (n, (n > 0).astype(np.int64), x)]
        lists = [contexts[-1][order][first].view(np.int64), *sums, longer.view(np.int64)]
        by_gram = np.flatnonzero(store)
        pairs = [pa.array([_pack(x[by_gram])], pa.binary()) for x in (gram, n)]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *pairs, *(pa.array([y], pa.list_(pa.from_numpy_dtype(y.dtype))) for y in lists)],
                        names=["b", "w", "n", "ctx", "total", "d", "x", "longer"])

    return settle


def _rows(df: DataFrame, kind: int) -> DataFrame:
    """Rows of arrays of one kind; what they lack is empty."""
    none = F.lit(None).cast("binary")
    return df.select("b", F.lit(kind).alias("kind"), *((F.col(c) if c in df.columns else none).alias(c) for c in NAMES))


def _in_buckets(parts: list[DataFrame], fn, schema: str) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("b").applyInArrow(fn, schema)


class Level:
    """The stored pairs of one level, the figures of its contexts, and both as rows of the buckets.

    Contexts that are not kept stand in the buckets (if ``every``) until the next level is settled.
    """

    def __init__(self, level: int, settled: DataFrame, every: bool):
        parts = settled.select("b", F.inline(F.arrays_zip("ctx", "total", "d", "x")))
        whole = parts.groupBy("ctx").agg(F.sum("total").alias("total"), F.sum("d").alias("d"), F.sum("x").alias("x"))
        gain = F.col("x") - F.col("total") * F.ln("total")  # total * KL
        self.contexts = stored(whole.filter(F.col("total") >= MIN_COUNT).select(
            "ctx", "total", "d", (gain > 0.5 * F.col("d") * F.ln("total")).alias("kept")), "contexts")
        met = self.contexts if every else self.contexts.filter("kept")
        back = parts.select("b", "ctx").join(met, "ctx").select("b", "ctx", "total", "d", F.col("kept").cast("long").alias("kept"))
        self.back = stored(back.groupBy("b").applyInArrow(_pack_contexts(every), "b int, all boolean, w binary, n binary, c1 binary, c2 binary"), "back")
        self.packed = stored(settled.select("b", "w", "n"), "pairs")
        self.pairs = self.packed.select("w", "n").mapInArrow(_pair_rows, "h long, n long")
        self.level, self.every = level, every

    def keep(self) -> None:
        """Let go of the contexts that are not kept."""
        if self.every:
            back, self.every = self.back, False
            self.back = stored(back.filter(~F.col("all")), "back")
            common.drop_stored(back)

    def beyond(self, known) -> None:
        """Let go of the contexts that are sent along to all tasks."""
        back = self.back
        self.back = stored(back.mapInArrow(_not_along(known), back.schema), "back")
        common.drop_stored(back)

    def parts(self) -> list[DataFrame]:
        """Rows of the buckets: the stored pairs and the contexts, all or kept ones."""
        back = self.back.filter(F.col("all") if self.every else ~F.col("all"))
        return [_rows(self.packed, PAIRS + self.level), _rows(back, CONTEXTS + self.level)]


def _pack_contexts(every: bool):
    """Of a bucket a row of the kept contexts and, if ``every``, one of all."""
    def pack(key, table):
        out = []
        for all_ in (True, False) if every else (False,):
            some = table if all_ else table.filter(pc.equal(table["kept"], 1))
            out.append([key[0].as_py(), all_, *(_pack(some[c].to_numpy()) for c in ("ctx", "total", "d", "kept"))])
        kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 4)
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["b", "all", "w", "n", "c1", "c2"])

    return pack


def _not_along(known):
    def rest(batches):
        keys = known.value.along[0][0]
        for batch in batches:
            for row in batch.to_pylist():
                columns = {c: _unpack(row[c]) for c in ("w", "n", "c1", "c2")}
                none = ~keys.find(columns["w"].view(np.uint64))[1]
                if none.any():
                    yield pa.RecordBatch.from_pylist([{**row, **{c: _pack(x[none]) for c, x in columns.items()}}], batch.schema)

    return rest


def _pair_rows(batches):
    for batch in batches:
        for w, n in zip(batch.column(0), batch.column(1)):
            w, n = _unpack(w.as_py()), _unpack(n.as_py())
            for at in range(0, len(w), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(w[at: at + 100_000]), pa.array(n[at: at + 100_000])], names=["h", "n"])


def grow(rows: DataFrame, rare: DataFrame, codes: DataFrame, root: Root, shared) -> list[Level]:
    """The levels of the tree over the rows ``held_out, text``."""
    context = rows.sparkSession.sparkContext
    tried = codes.filter((F.col("n") >= MIN_COUNT) & (F.col("w") != int(END_CODE.view(np.int64)))).select(F.col("w").alias("h"))
    levels: list[Level] = []
    settled = None
    for level in range(1, DEPTH + 1):
        count = tried.count()
        if not count:
            break
        tries = context.broadcast(Map(tried, count))
        if settled is not None:  # the level before has its own tables
            common.drop_stored(settled)
        sent = rows.select("held_out", "text").mapInArrow(_count_pairs(level, tries, shared), f"b int, {ARRAYS}")
        settled = stored(_in_buckets([_rows(sent, SENT), rare, *(p for x in levels for p in x.parts())], _settle(level, shared),
                                     "b int, w binary, n binary, ctx array<long>, total array<long>, d array<long>, "
                                     "x array<double>, longer array<long>"), "settled")
        if levels:
            levels[-1].keep()
        levels.append(Level(level, settled, level < DEPTH))
        tried = settled.select(F.explode("longer").alias("h"))
    if levels:
        common.drop_stored(settled)
        levels[-1].keep()
    return levels


class Settled(Root):
    """What scoring tasks know without asking: frequent words, pairs and kept contexts, and maps of all that exist."""

    def __init__(self, root: Root, levels: list[Level], spark):
        self.__dict__.update(root.__dict__)
        pairs, contexts = spark.createDataFrame([], "h long, n long"), spark.createDataFrame([], "ctx long, n long, d long")
        self.maps = []
        for x in levels:
            kept = x.contexts.filter("kept").select("ctx", F.col("total").alias("n"), "d")
            pairs, contexts = pairs.unionByName(x.pairs), contexts.unionByName(kept)
            self.maps.append(Map(kept.select(F.col("ctx").alias("h")), kept.count()))
        count = pairs.count()
        self.pair_map = Map(pairs.select("h"), count)
        grams, times = _sorted(pairs.filter(_most(pairs, FREQUENT_PAIRS)).toArrow(), "h", "n")
        keys, self.total, self.d = _sorted(contexts.filter(_most(contexts, FREQUENT_CONTEXTS)).toArrow(), "ctx", "n", "d")
        self.grams, self.keys = Keys(grams), Keys(keys)
        self.times = times if times.max(initial=0) >= 1 << 31 else times.astype(np.int32)
        self.all_contexts = len(self.keys) == contexts.count()


class Known(Root):
    """The root, and the kept contexts that are sent along."""

    def __init__(self, settled: Settled):
        self.__dict__.update({k: settled.__dict__[k] for k in ("n", "v", "discount", "buckets", "counts", "words")})
        self.along = ((settled.keys, settled.total, settled.d, np.ones(len(settled.keys), np.int8)),)


def _scorer(model):
    """Per text a row with the sums of its settled tokens, and rows per bucket of the others (``n``: twice the text, and one in training)."""
    def score(batches):
        t = model.value
        uid = TaskContext.get().partitionId() << 40
        names = [*RESULT, "b", "kind", *NAMES]
        left, size = [], 0

        def send(kind):
            words, n, *before = (np.concatenate(x) for x in zip(*left))
            left.clear()
            short, frequent = t.short(words)
            columns = _packed(t.bucket(frequent, before[0], words), [short, n, *(t.short(x)[0] for x in before)])
            m = len(columns[0])
            empty = [pa.nulls(m, x) for x in (pa.int64(), kind, pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*empty, columns[0], pa.array(np.full(m, SENT, np.int32)), *columns[1:]], names=names)

        kind = pa.null()
        for batch in batches:
            kind, column = batch.column(0).type, batch.column(2)
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, m in _pieces(column):
                codes, doc, place = _tokens(column.slice(first, m))
                at, frequent = t.words.find(codes)
                c = np.where(frequent, t.counts[at], 0) if len(t.words) else np.zeros(len(codes), np.int64)
                p, closed = t.share(c), frequent.copy()
                least = np.where(held[first + doc], 0, 1)
                # The words of the longest context that may be kept are sent, the first always: it names the bucket.
                sent, deepest = _before(codes, DEPTH), np.ones(len(codes), np.int8)
                contexts = _contexts(codes, DEPTH)
                for level, (bits, context) in enumerate(zip(t.maps, contexts), 1):
                    hit = np.flatnonzero((place >= level) & bits.has(context))
                    deepest[hit] = level
                    spot, there = t.keys.find(context[hit])
                    if not t.all_contexts:
                        closed[hit[~there]] = False
                    hit, spot = hit[there], spot[there]
                    gram = _joined(context[hit], codes[hit])
                    known = np.flatnonzero(t.pair_map.has(gram))
                    where, found = t.grams.find(gram[known])
                    closed[hit[known[~found]]] = False
                    n = least[hit]
                    n[known[found]] = t.times[where[found]]
                    p[hit] = (n + t.d[spot] * p[hit]) / (t.total[spot] + t.d[spot])
                starts = np.flatnonzero(place == 0)
                sums = [np.add.reduceat(x, starts) for x in (np.where(closed, np.log10(p), 0.0), np.where(frequent, np.log10(c + 1.0), 0.0),
                                                             frequent.astype(np.int64))]
                some = np.flatnonzero(~closed)
                left.append((codes[some], 2 * (uid + doc[some]) + least[some], *(np.where(np.minimum(deepest, place)[some] >= k, x[some], NONE) for k, x in enumerate(sent, 1))))
                size += len(some)
                own = [pa.array(np.arange(uid, uid + m)), batch.column(0).slice(first, m), batch.column(1).slice(first, m),
                       pa.array(np.bincount(doc, minlength=m)), *map(pa.array, sums),
                       pa.array((np.arange(uid, uid + m) % t.buckets).astype(np.int32)), pa.array(np.full(m, TEXT, np.int32))]
                yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(m, pa.binary())] * len(NAMES)], names=names)
                uid += m
                if size > HELD_OPEN:
                    yield send(kind)
                    size = 0
        if size:
            yield send(kind)

    return score


def _answer(root):
    """Of a bucket: its texts, and per text the sums of its open tokens."""
    def answer(key, table):
        here = Bucket(table, root.value)
        words, n, *contexts = here.sent
        p, _ = here.predict(words, contexts, n & 1)
        c, frequent = here.counts(words)
        order = np.argsort(n >> 1)
        uid = (n >> 1)[order]
        first = _runs(uid)
        sums = [np.add.reduceat(x[order], first) if len(first) else x for x in (
            np.log10(p), np.where(frequent, 0.0, np.log10(c + 1.0)), (~frequent & (c > 0)).astype(np.int64))]
        texts = table.filter(pc.equal(table["kind"], TEXT)).select(RESULT)
        columns = {"uid": uid[first], **dict(zip(RESULT[-3:], sums))}
        return pa.concat_tables([texts, pa.table([pa.array(columns[f.name]) if f.name in columns else pa.nulls(len(first), f.type)
                                                  for f in texts.schema], schema=texts.schema)])

    return answer


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counted = rows.filter("not held_out").select("text").mapInArrow(_count_words, "w long, n long")
    codes = stored(counted.groupBy("w").agg(F.sum("n").alias("n")), "words")
    root = Root(codes)
    shared = spark.sparkContext.broadcast(root)
    rare = _rows(stored(codes.mapInArrow(_rare_words(shared), f"b int, {ARRAYS}"), "rare"), WORDS)
    levels = grow(rows, rare, codes, root, shared)
    settled = Settled(root, levels, spark)
    model, known = spark.sparkContext.broadcast(settled), spark.sparkContext.broadcast(Known(settled))
    for x in levels:
        x.beyond(known)
    for table in (codes, *(x.contexts for x in levels)):  # scoring reads the buckets' tables alone
        common.drop_stored(table)
    kind = rows.schema["id"].dataType.simpleString()
    result = f"uid long, id {kind}, held_out boolean, n_tokens long, score double, base double, known long"
    sent = rows.mapInArrow(_scorer(model), f"{result}, b int, kind int, {ARRAYS}")
    parts = [p.select(*(F.lit(None).cast(sent.schema[c].dataType).alias(c) for c in RESULT), "*") for p in (rare, *(p for x in levels for p in x.parts()))]
    return (_in_buckets([sent, *parts], _answer(known), result).groupBy("uid")
            .agg(F.first("id", True).alias("id"), F.bool_or("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
                 *(F.sum(c).alias(c) for c in ("known", "base", "score")))
            .select("id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(root.n).cast("long").alias("train_tokens"),
                    (F.col("base") - F.col("n_tokens") * float(np.log10(root.n + root.v + 1))).alias("base_score"), "score"))
