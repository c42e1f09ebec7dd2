"""Toxicity by cumulative-link ordinal regression on sparse text features.

A document's severity y is one of the grades 0..K-1 with
``P(y > k) = sigmoid(w.x - t_k)``: one weight vector shared by ordered
thresholds. The result is the expected severity, ``sum_k P(y > k)``.

Features are words and word beginnings (PREFIXES letters) of the lower-cased
text. What counts as evidence for one is the number of distinct contexts (word
and word before it) that only toxic documents of the labelled sample have,
against all its contexts: words that copies of one document repeat have few.
Features with enough evidence are taken, of several that begin alike the one
with the most. Each gives two values: whether it occurs, and
``log(1 + occurrences)``.

Labels that only say toxic or not are graded first: 0 is clean, 1 to GRADES are
the shares of equal size of the toxic documents by occurrences of the chosen
features. Labels with grades of their own (a ``severity`` column) are used as
they are.

The classifier is fitted on at most SAMPLE labelled documents (those with the
smallest hash of id and label; a documented bound), all documents are scored, whole.
The model's size is bounded too: of the features that toxic contexts hold more than
twice as often as others, the CANDIDATES with the largest ratio are looked at and at
most FEATURES kept; words of more than LONGEST_WORD letters count by their beginnings
alone. These bounds shape the model; scoring leaves nothing out.

Defined results: a null text is empty; rows without a label or text do not train; of
several labels of one id the largest counts, of several texts of one id the one with
the smallest hash trains; repeated texts train once. Without labels, or without
evidence, every severity is 0 and nothing is toxic. Every row gets its score, repeated
rows and null ids too. A very long text is one row's work, linear in its length.
Extra columns pass through; input columns named like results give way to them.
"""

from __future__ import annotations

import functools
import itertools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.llm.common import free_name, hash_sample, stored, whole_text

SAMPLE = 10_000
CANDIDATES = 4_000
FEATURES = 500
PREFIXES = (3, 4, 5, 6)
LONGEST_WORD = 24
GRADES = 3
#: A feature needs this evidence (log-likelihood ratio).
LEAST_EVIDENCE = 35.0


def normal(text: Column) -> Column:
    """Lower case; anything but letters and digits is one space; spaces at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(whole_text(text)), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def _features(word: Column) -> Column:
    """The features that an occurrence of ``word`` has: itself and its beginnings."""
    n = F.length(word)
    whole = F.when(n.between(2, LONGEST_WORD), F.concat(F.lit(" "), word, F.lit(" ")))
    starts = [F.when(n >= k, F.concat(F.lit(" "), F.substring(word, 1, k))) for k in PREFIXES]
    return F.array_compact(F.array(whole, *starts))


@functools.lru_cache(maxsize=4)
def _automaton(features: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, f in enumerate(features):
        found.add_word(f, i)
    found.make_automaton()
    return found


def count_features(text: str, features: tuple[str, ...]) -> dict[int, int]:
    """Occurrences of each feature in a normalised text."""
    out: dict[int, int] = {}
    if features:
        for _, i in _automaton(features).iter(text):
            out[i] = out.get(i, 0) + 1
    return out


def _evidence(toxic: np.ndarray, all_: np.ndarray, n_toxic: float, n_all: float) -> np.ndarray:
    """Log-likelihood ratio of 'documents with the feature are toxic more often'."""
    def part(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    rest, k_rest = n_all - all_, n_toxic - toxic
    p1, p2 = toxic / np.maximum(all_, 1), k_rest / np.maximum(rest, 1)
    g = 2 * (part(toxic, all_, p1) + part(k_rest, rest, p2) - part(toxic, all_, n_toxic / n_all) - part(k_rest, rest, n_toxic / n_all))
    return np.where(p1 > p2, g, 0.0)


def _choose(names: list[str], evidence: np.ndarray) -> list[str]:
    """Names by falling evidence (a longer beginning first), none that begins like a chosen one."""
    order = sorted(range(len(names)), key=lambda f: (-round(float(evidence[f]), 6), names[f].endswith(" "), -len(names[f]), names[f]))
    chosen: list[str] = []
    for f in order:
        if evidence[f] < LEAST_EVIDENCE or len(chosen) == FEATURES:
            break
        if not any(names[f].startswith(c) or c.startswith(names[f]) for c in chosen):
            chosen.append(names[f])
    return chosen


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, steps: int = 600, ridge: float = 5e-5):
    """Weights and increasing thresholds of the cumulative-link model (numpy, Adam).

    The likelihood of grade y is ``P(y > y-1) - P(y > y)``; gaps between
    thresholds are exponentials, so that they stay ordered.
    """
    n, d = x.shape
    cuts = grades - 1
    share = np.clip([(y > k).mean() for k in range(cuts)], 1e-3, 1 - 1e-3)
    t = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(d), t[:1], np.log(np.maximum(np.diff(t), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)

    def thresholds(q):
        return q[d] + np.concatenate([[0.0], np.cumsum(np.exp(q[d + 1:]))])

    edge = np.arange(cuts)
    for step in range(1, steps + 1):
        th = thresholds(p)
        over = 1 / (1 + np.exp(-np.clip((x @ p[:d])[:, None] - th[None, :], -40, 40)))  # P(y > k)
        full = np.hstack([np.ones((n, 1)), over, np.zeros((n, 1))])
        like = np.maximum(full[np.arange(n), y] - full[np.arange(n), y + 1], 1e-12)
        slope = over * (1 - over)
        # d like / d score_k: +slope at k = y - 1, -slope at k = y
        sign = (edge[None, :] == y[:, None] - 1).astype(float) - (edge[None, :] == y[:, None])
        each = -(sign * slope) / like[:, None] / n  # gradient of the loss by score_k
        g_th = -each.sum(axis=0)
        gaps = np.exp(p[d + 1:])
        g = np.concatenate([x.T @ each.sum(axis=1) + ridge * p[:d], [g_th.sum()],
                            gaps * np.array([g_th[k + 1:].sum() for k in range(cuts - 1)])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return p[:d], thresholds(p)


def expected(x_dot_w: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected severity and ``P(y > 0)``."""
    over = 1 / (1 + np.exp(-np.clip(x_dot_w[:, None] - thresholds[None, :], -40, 40)))
    return over.sum(axis=1), over[:, 0]


def _counter(features: tuple[str, ...]):
    def count(batches):
        for batch in batches:
            found = [count_features(t, features) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([list(f) for f in found], pa.list_(pa.int32())),
                 pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], names=["y", "f", "n"])

    return count


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> dict:
    """The model: ``features``, ``weights``, ``thresholds`` (a few hundred numbers)."""
    none = {"features": (), "weights": np.zeros(0), "thresholds": np.zeros(0)}
    graded = "severity" in labels.columns
    some = hash_sample(labels.select(F.col(id_col).alias("i"), F.col("severity" if graded else label_col).cast("int").alias("y"))
                       .filter("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y")), SAMPLE)
    # At most SAMPLE ids are broadcast, and each brings one document.
    text = F.col(text_col).cast("string")
    sample = stored(
        docs.select(F.col(id_col).alias("i"), text.alias("t")).filter("t is not null").join(F.broadcast(some), "i")
        .groupBy("i", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t"))
        .select(normal(F.col("t")).alias("t"), "y")
        .groupBy("t").agg(F.max("y").alias("y")), "toxicity-sample")
    n_all, n_toxic = sample.agg(F.count(F.lit(1)), F.sum((F.col("y") > 0).cast("int"))).first()
    if not n_all or not n_toxic or n_toxic == n_all:
        return none
    words = F.split(F.trim("t"), " ")
    seen = (sample.select("y", words.alias("ws"))
            .select("y", F.explode(F.arrays_zip(F.col("ws").alias("w"), F.concat(F.array(F.lit("")), "ws").alias("p"))).alias("x"))
            .filter("x.w is not null and x.w != ''")
            .groupBy("x.w", "x.p").agg(F.min((F.col("y") > 0).cast("int")).alias("k")))
    n_seen, k_seen = seen.agg(F.count(F.lit(1)), F.sum("k")).first()
    counts = (seen.select("k", F.explode(_features(F.col("w"))).alias("f"))
              .groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
              .filter((F.col("k") > 3) & (F.col("k") * n_seen > 2 * F.col("n") * k_seen)))
    # The leading terms of the ratio give the order; at most CANDIDATES rows come back.
    share = F.col("k") / F.col("n")
    order = F.col("k") * F.log(share * (n_seen / max(k_seen, 1))) + F.when(
        share < 1, (F.col("n") - F.col("k")) * F.log((1 - share) * (n_seen / max(n_seen - k_seen, 1)))).otherwise(0.0)
    best = counts.orderBy(order.desc(), "f").limit(CANDIDATES).collect()
    if not best:
        return none
    evidence = _evidence(np.array([r.k for r in best], float), np.array([r.n for r in best], float), k_seen, n_seen)
    names = _choose([r.f for r in best], evidence)
    if not names:
        return none
    rows = sample.select("t", "y").mapInArrow(_counter(tuple(names)), "y int, f array<int>, n array<int>").collect()
    y = np.array([r.y for r in rows])
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, r.f] = r.n
    if not graded:
        hits = x.sum(axis=1)
        cuts = np.quantile(hits[y > 0], np.arange(1, GRADES) / GRADES)
        y = np.where(y > 0, 1 + (hits[:, None] > cuts[None, :]).sum(axis=1), 0)
    y = np.unique(y, return_inverse=True)[1]  # grades without a document close up
    w, th = fit_ordinal(np.hstack([np.log1p(x), x > 0]), y, int(y.max()) + 1)
    return {"features": tuple(names), "weights": w, "thresholds": th}


def _scorer(model: bytes, at: int):
    def score(batches):
        m = pickle.loads(model)
        features, w, th = m["features"], m["weights"], m["thresholds"]
        for batch in itertools.chain.from_iterable((b.slice(k, 512) for k in range(0, b.num_rows, 512)) for b in batches):
            found = (count_features(t, features) for t in batch.column(at).to_pylist())
            z = np.array([sum(np.log1p(n) * w[i] + w[len(features) + i] for i, n in f.items()) for f in found], float)
            if len(th):
                severity, p = expected(z, th)
            else:
                severity = p = np.zeros(len(z))
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(severity), pa.array(p)], names=[
                *[c for i, c in enumerate(batch.schema.names) if i != at], "severity", "p_toxic"])

    return score


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``severity``, ``p_toxic`` and ``toxic``."""
    extra = free_name(docs, "normal")
    rows = docs.drop("severity", "p_toxic", "toxic").withColumn(extra, normal(F.col(text_col)))
    at = rows.columns.index(extra)
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != extra],
                           T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())])
    return (rows.mapInArrow(_scorer(pickle.dumps(model), at), schema)
            .withColumn("toxic", F.col("p_toxic") >= 0.5))
