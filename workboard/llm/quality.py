"""Quality rules by robust multivariate outliers.

Of every text some counts are taken, and from them a vector: the logarithm of the
mean word length and the square roots of the shares of symbols, of repeated lines,
of words in repeated three-word windows and of capitals. Per language and source a
minimum-covariance-determinant estimate (MCD) of its centre and scatter is made from
all documents, and a document is rejected if its squared Mahalanobis distance is
above the quantile of the chi-square distribution that leaves TAIL.

The MCD looks for the half of a group with the smallest scatter determinant. From
two robust starts (medians with fixed scales; medians with the spatial-sign
covariance) concentration steps keep the nearer half and estimate anew, over the
whole group. Halves are counted off in bins of the distance (FINE to an octave), each
with its count and moments; the bin that completes the half counts in part. So a
step is one aggregate combined on the map side, whatever the size of a group. The better result is reweighted once (documents
within the 97.5 % quantile). To each scatter a fixed variance per statistic (FLOOR)
is added, as most documents hold no symbol or repeated line at all.

Groups of fewer than LEAST usable documents are pooled by language, and pools as
small are pooled in turn; the last pool, if small, rejects nothing. Usable are
documents that pass the base rule: 50 words or more, and at most half of them in
repeated windows. All others are rejected.

Defined results: a null text has no words; null languages and sources are values
like others; repeated rows are rows of their own; texts may be of any length. Input
columns that are not named are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workboard.llm.common import drop_stored, stored

MIN_WORDS = 50
LEAST = 50
TAIL = 1e-5
#: Standard deviation that is added per statistic.
FLOOR = np.array([0.05, 0.05, 0.25, 0.2, 0.05])
P = len(FLOOR)
#: Concentration steps at most; they end when no log-determinant falls by more than SETTLED.
STEPS = 10
SETTLED = 1e-2
REWEIGHT = 0.975
#: Bins to an octave of the squared distance, and its least octave.
FINE, LOWEST = 4, -10
#: The rows of a cell meet its estimate in this many parts, where they are shuffled for it.
SALTS = 64
#: Width of a bin when medians are counted off.
WIDTH = 0.005

X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
SUMS = [f"s{i}" for i in range(P)]
PRODUCTS = [f"q{i}{j}" for i, j in PAIRS]
CENTRES = [f"m{i}" for i in range(P)]
WEIGHTS = [f"w{i}{j}" for i, j in PAIRS]
FIT = "cell string, start int, logdet double, " + ", ".join(f"{c} double" for c in CENTRES + WEIGHTS)

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))


def repeated_words(words: list[bytes]) -> int:
    """How many of the words stand in a three-word window that the list holds twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    two = np.unique(codes[:-1] * len(number) + codes[1:], return_inverse=True)[1]
    _, kind, times = np.unique(two[:-1] * len(number) + codes[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[kind] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def _counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_capitals."""
    data = (text or "").encode()

    def of(kind: bytes) -> int:
        return len(data) - len(data.translate(None, kind))

    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(WHITE)]
    return (len(words), len(text or "") - of(WHITE), of(SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), of(CAPITALS))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def _measure(batches):
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        rows: list[tuple[int, ...]] = []
        for at in range(0, len(texts), 200):
            rows.extend(map(_counts, texts.slice(at, 200).to_pylist()))
        counts = np.array(rows, np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(counts[:, k]) for k in range(len(COUNTS)))],
                                         names=[*batch.schema.names[:-1], *COUNTS])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source") -> DataFrame:
    """``id, lang, source``, the counts of each text, ``base_failed`` and the vector ``x0`` to ``x4`` (stored)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(_measure, f"id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))

    def share(a: str, b: str) -> Column:
        return F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))

    vector = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
              share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
              share("n_capitals", "word_chars")]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stored(counted.withColumn("base_failed", failed).withColumns(dict(zip(X, vector))), "measured")


# Chi-square distribution.

def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, h = k / 2, x / 2
    if h <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= h / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi2_quantile(share: float, k: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < share:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < share else (low, mid)
    return high


def consistency(share: float) -> float:
    """By how much the scatter of the nearest ``share`` of normal vectors is too small."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


# Estimates.

def cells(measured: DataFrame) -> DataFrame:
    """``lang, source, cell``: the group or pool of the documents of a language and source (none if all are too small)."""
    own = measured.filter("not base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < LEAST
    pool = Window.partitionBy("lang", small)
    named = own.withColumn("pool", F.sum("n").over(pool)).select(
        "lang", "source", "n", F.when(~small, F.to_json(F.struct("lang", "source")))
        .when(F.col("pool") >= LEAST, F.to_json(F.struct("lang"))).otherwise("").alias("cell"))
    sized = named.join(named.groupBy("cell").agg(F.sum("n").alias("size")), "cell").filter(F.col("size") >= LEAST)
    return stored(sized.select("lang", "source", "cell"), "cells")


def _estimate(n, sums, products, factor: float):
    """Centre, floored scatter's inverse and log-determinant from moments."""
    mean = sums / n
    scatter = np.zeros((P, P))
    for (i, j), q in zip(PAIRS, products):
        scatter[i, j] = scatter[j, i] = q / n - mean[i] * mean[j]
    scatter = scatter * factor + np.diag(FLOOR ** 2)
    return mean, np.linalg.inv(scatter), float(np.linalg.slogdet(scatter)[1])


def _row(cell, start, mean, inverse, logdet):
    # Off the diagonal an entry counts twice in the distance.
    return [cell, start, logdet, *mean, *(inverse[i, j] * (1 if i == j else 2) for i, j in PAIRS)]


def distance() -> Column:
    """Squared Mahalanobis distance of ``x`` by the row's estimate."""
    d = [F.col(x) - F.col(m) for x, m in zip(X, CENTRES)]
    return sum((F.col(w) * d[i] * d[j] for w, (i, j) in zip(WEIGHTS[1:], PAIRS[1:])), F.col(WEIGHTS[0]) * d[0] * d[0])


def _moments() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(s) for x, s in zip(X, SUMS)],
            *[F.sum(F.col(X[i]) * F.col(X[j])).alias(q) for (i, j), q in zip(PAIRS, PRODUCTS)]]


def _estimates(factor: float):
    """From rows of moments to estimates; ``before`` goes along."""
    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                mean, inverse, logdet = _estimate(r.n, np.array([getattr(r, c) for c in SUMS]),
                                                  [getattr(r, c) for c in PRODUCTS], factor)
                rows.append([*_row(r.cell, r.start, mean, inverse, logdet), r.before])
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FIT.split(", ")] + ["before"])

    return run


def _nearer(bins: DataFrame, share: float) -> DataFrame:
    """The moments of the nearest ``share`` of each estimate's rows; the last bin counts in part."""
    part = Window.partitionBy("cell", "start")
    upto = F.sum("n").over(part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    wanted = bins.withColumn("short", share * F.sum("n").over(part) - (upto - F.col("n"))).withColumn(
        "f", F.least(F.lit(1.0), F.col("short") / F.col("n"))).filter("f > 0")
    return wanted.groupBy("cell", "start").agg(F.max("before").alias("before"),
                                               *[F.sum(F.col("f") * F.col(c)).alias(c) for c in ["n", *SUMS, *PRODUCTS]])


def _with(usable: DataFrame, estimates: DataFrame) -> DataFrame:
    """Every row with each estimate of its cell. A cell may hold a third of all rows: it is joined in SALTS parts."""
    parts = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return usable.join(parts, ["cell", "salt"])


def _starts(usable: DataFrame) -> DataFrame:
    """Two estimates per cell: medians with fixed scales, and with the spatial-sign covariance."""
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(x) / WIDTH).alias("bin")) for i, x in enumerate(X)]))
    hist = usable.select("cell", places.alias("v")).groupBy("cell", "v.i", "v.bin").agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy("cell", "i")
    upto = F.sum("n").over(part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    median = (hist.withColumn("upto", upto).withColumn("all", F.sum("n").over(part)).filter(2 * F.col("upto") >= F.col("all"))
              .groupBy("cell", "i").agg(((F.min("bin") + 0.5) * WIDTH).alias("m")))
    medians = stored(median.groupBy("cell").agg(*[F.max(F.when(F.col("i") == i, F.col("m"))).alias(m) for i, m in enumerate(CENTRES)]),
                     "medians")
    scaled = _with(usable, medians).select("cell", *CENTRES, *[((F.col(x) - F.col(m)) / float(f)).alias(x)
                                                                     for x, m, f in zip(X, CENTRES, FLOOR)])
    norm = sum((F.col(x) * F.col(x) for x in X), F.lit(1e-12))
    signs = scaled.groupBy("cell").agg(*[F.first(m).alias(m) for m in CENTRES], F.count(F.lit(1)).alias("n"),
                                       *[F.sum(F.col(X[i]) * F.col(X[j]) / norm).alias(q) for (i, j), q in zip(PAIRS, PRODUCTS)])

    def fit(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                sign = np.zeros((P, P))
                for (i, j), q in zip(PAIRS, PRODUCTS):
                    sign[i, j] = sign[j, i] = getattr(r, q) / r.n * P
                centre = np.array([getattr(r, m) for m in CENTRES])
                for start, scatter in enumerate((np.eye(P), sign + np.eye(P) * 0.05)):
                    scatter = scatter * np.outer(FLOOR, FLOOR)
                    rows.append(_row(r.cell, start, centre, np.linalg.inv(scatter), float("inf")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FIT.split(", ")])

    return stored(signs.mapInPandas(fit, FIT), "starts")


def fit(measured: DataFrame, of: DataFrame) -> DataFrame:
    """One reweighted MCD estimate per cell (stored): ``cell``, centre, weights of the distance, ``logdet``."""
    usable = stored(measured.filter("not base_failed").join(of, [measured["lang"].eqNullSafe(of["lang"]),
                                                                 measured["source"].eqNullSafe(of["source"])])
                    .select("cell", (F.monotonically_increasing_id() % SALTS).cast("int").alias("salt"), *X), "usable")
    estimates = _starts(usable)
    octave = F.log2(F.greatest(distance(), F.lit(2.0 ** LOWEST)))
    for _ in range(STEPS):
        bins = (_with(usable, estimates).groupBy("cell", "start", F.floor(octave * FINE).alias("bin"))
                .agg(F.min("logdet").alias("before"), *_moments()))
        new = stored(_nearer(bins, 0.5).mapInPandas(_estimates(consistency(0.5)), FIT + ", before double"), "estimates")
        drop_stored(estimates)
        estimates = new.drop("before")
        if new.filter(f"before - logdet > {SETTLED}").isEmpty():
            break
    best = estimates.groupBy("cell").agg(F.min_by(F.struct("start", "logdet", *CENTRES, *WEIGHTS), F.struct("logdet", "start")).alias("x")).select("cell", "x.*")
    near = _with(usable, best).filter(distance() <= chi2_quantile(REWEIGHT, P)).groupBy("cell").agg(*_moments())
    whole = near.withColumns({"start": F.lit(0), "before": F.lit(0.0), "n": F.col("n").cast("double")})
    return stored(whole.mapInPandas(_estimates(consistency(REWEIGHT)), FIT + ", before double").drop("before", "start"), "fit")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """One row per document: ``id``, the counts, ``base_failed``, ``kept`` and ``distance`` (null without an estimate)."""
    measured = measure(docs, id_col, text_col, lang_col, source_col)
    of = cells(measured)
    estimates = fit(measured, of)
    by_pair = stored(of.join(estimates, "cell").drop("cell", "logdet").withColumnsRenamed({"lang": "l", "source": "s"}), "by-pair")
    rows = measured.join(by_pair, [measured["lang"].eqNullSafe(by_pair["l"]), measured["source"].eqNullSafe(by_pair["s"])], "left")
    out = rows.withColumn("distance", distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(1 - tail, P), F.lit(True))
    return out.select("id", *COUNTS[:5], "base_failed", kept.alias("kept"), "distance")
