"""Near-duplicate documents by circulant MinHash and exact Jaccard verification.

Words are runs between ASCII white space with A-Z lower-cased; a document's set
is its distinct word shingles as 64-bit hashes (a document of fewer words is one
shingle, one without words has none and is linked with nothing). Two fixed
permutations of the 2**32 positions give all signature coordinates: the first
scatters the shingles, the second, shifted circularly by k, orders them for
coordinate k. Bands of ROWS coordinates meet in buckets.

Documents with the same set form one class, which is represented by its smallest
id, so copies cost one row each and are never paired. In every bucket all
classes are compared with its smallest and its largest member; after the
components of these links are known, the pairs of one bucket that still lie in
different components are compared, all of them, in blocks whose tasks return only
links, and each pair in the first band it shares. Every link is confirmed on the
full sets: ``100 * intersection >= percent * union``. At a similarity of 0.8 a
pair misses all 32 bands with probability 5e-8; every pair that shares a band and
still lies in different components is compared exactly.

Defined results: rows that share an id are one document (linked); a row with a
null id is linked with nothing, has a null component and is kept; null and empty
texts have no shingles and are components of their own; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.llm.common import stored
from workboard.llm.components import components
from workboard.llm.hashing import U, mix64, shingle_sets

BANDS, ROWS = 32, 4
#: Members of one pivot that are verified together; a larger star is cut up.
STAR_ROWS = 128
#: Members, and shingles, of one side of a block; a larger bucket is cut into more blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 300, 2_000_000


def _permute32(x: np.ndarray) -> np.ndarray:
    """A bijection of the 32-bit integers (in place)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least of ``p(s(x) - k)`` over the set."""
    scattered = _permute32((shingles >> U(32)).astype(np.uint32) ^ (shingles & U(0xFFFFFFFF)).astype(np.uint32))
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(scattered), 1024):  # stays in the cache
        np.minimum(least, _permute32(scattered[None, at: at + 1024] - shifts).min(axis=1), out=least)
    return least


def _band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * U(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def _signer(words: int):
    def sign(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 256):
                n, a, b, keys = [], [], [], []
                for s in shingle_sets(texts.slice(at, 256), words):
                    n.append(len(s))
                    # Sums of mixed hashes stand for the set, whatever the order.
                    a.append(mix64(s + U(1)).sum(dtype=np.uint64).view(np.int64))
                    b.append(mix64(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))
                    keys.append(_band_keys(signature(s)) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 256), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                     pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "a", "b", "bands"])

    return sign


def similar(s: np.ndarray, c: np.ndarray, percent: int) -> bool:
    """``100 * intersection >= percent * union`` of two sorted sets."""
    small, big = (s, c) if len(s) < len(c) else (c, s)
    if not len(small) or 100 * len(small) < percent * len(big):
        return False
    spot = np.minimum(np.searchsorted(big, small), len(big) - 1)
    both = int((big[spot] == small).sum())
    return 100 * both >= percent * (len(s) + len(c) - both)


def _linker(words: int, percent: int):
    def link(batches):
        """Rows come by star (pivot, part), the pivot's own rows first."""
        star, centre = None, []
        for batch in batches:
            pivots, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own, ids = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            u, v = [], []
            for at in range(0, len(ids), 256):
                for i, s in enumerate(shingle_sets(batch.column(4).slice(at, 256), words), at):
                    if star != (pivots[i], parts[i]):
                        star, centre = (pivots[i], parts[i]), []
                    if own[i]:
                        centre.append(s)
                        continue
                    if any(similar(s, c, percent) for c in centre):
                        u.append(ids[i])
                        v.append(pivots[i])
            yield pa.RecordBatch.from_arrays([pa.array(u, batch.column(3).type), pa.array(v, batch.column(3).type)],
                                             names=["u", "v"])

    return link


def _block_links(ids: list, groups: list, minor: list, band: int, sets: list, percent: int):
    """Links between members of different components (``groups``) in one block."""
    parent: dict = {}

    def root(g):
        while parent.get(g, g) != g:
            parent[g] = g = parent.get(parent[g], parent[g])
        return g

    signs = np.stack([signature(s) for s in sets])
    for i in range(len(ids)):
        if not minor[i]:
            continue
        equal = signs == signs[i]
        same = equal.reshape(len(ids), BANDS, ROWS).all(axis=2)
        near = (same.argmax(axis=1) == band) & same[:, band]
        for j in np.flatnonzero(near):
            if (j > i or not minor[j]) and root(groups[i]) != root(groups[j]) and similar(sets[i], sets[j], percent):
                parent[root(groups[i])] = root(groups[j])
                yield ids[i], ids[j]


def _block_linker(words: int, percent: int):
    def link(batches):
        """Rows come by block (h, x, y): columns h, x, y, band, minor, c, id, text."""
        block, held = None, ([], [], [], [])

        def flush():
            if held[0] and len(set(held[1])) > 1:
                yield from _block_links(*held[:3], block[3], held[3], percent)

        kind = None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            minor, groups, ids = (batch.column(k).to_pylist() for k in (4, 5, 6))
            kind, links = batch.column(6).type, []
            for at in range(0, len(ids), 256):
                for i, s in enumerate(shingle_sets(batch.column(7).slice(at, 256), words), at):
                    if keys[i] != block:
                        links += flush()
                        block, held = keys[i], ([], [], [], [])
                    for column, value in zip(held, (ids[i], groups[i], minor[i], s)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], kind), pa.array([y for _, y in links], kind)],
                                             names=["u", "v"])
        if held[0]:
            links = list(flush())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], kind), pa.array([y for _, y in links], kind)],
                                             names=["u", "v"])

    return link


def _across(filed: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members of one bucket that lie in different components.

    ``filed``: h, band, rep, n, c. In a bucket the members of the component with
    the most members (major) need no comparison among themselves; the others
    (minor) meet each other and the major ones, part by part.
    """
    per = filed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    parts = F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("n") / BLOCK_SHINGLES)).cast("int")
    split = stored(
        per.groupBy("h").agg(F.max(F.struct("m", "n", "c")).alias("major"), F.sum("m").alias("m"), F.sum("n").alias("n"))
        .select("h", F.col("major.c").alias("major"), (F.col("m") - F.col("major.m")).alias("m"),
                (F.col("n") - F.col("major.n")).alias("n"),
                F.ceil(F.greatest(F.col("major.m") / BLOCK_ROWS, F.col("major.n") / BLOCK_SHINGLES)).cast("int").alias("majors"))
        .filter("m > 0").select("h", "major", parts.alias("minors"), "majors"), "split")
    part = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    own = part(F.col("minors"))
    spot = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    count = lambda n: F.sequence(F.lit(0), n - 1)
    rows = filed.join(split, "h").withColumn("minor", F.col("c") != F.col("major"))
    spots = F.when(F.col("minor"), F.concat(
        F.transform(count(F.col("minors")), lambda k: spot(F.least(own, k), F.greatest(own, k))),
        F.transform(count(F.col("majors")), lambda k: spot(own, F.col("minors") + k)),
    )).otherwise(F.transform(count(F.col("minors")), lambda k: spot(k, F.col("minors") + part(F.col("majors")))))
    rows = rows.select("h", "band", "minor", "c", "rep", F.explode(spots).alias("at"))
    kind = docs.schema["id"].dataType
    return (rows.join(docs, rows["rep"] == docs["id"])
            .select("h", F.col("at.x").alias("x"), F.col("at.y").alias("y"), "band", "minor", "c", "rep", "text")
            .repartition("h", "x", "y").sortWithinPartitions("h", "x", "y", "rep")
            .mapInArrow(_block_linker(words, percent), T.StructType([T.StructField("u", kind), T.StructField("v", kind)])))


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The ``pairs`` (pivot, member) whose full sets are similar enough, as ``u, v``."""
    pairs = stored(pairs, "pairs")
    stars = stored(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("parts")), "stars")
    members = (pairs.join(stars, "pivot")
               .select("pivot", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"),
                       F.lit(False).alias("own"), F.col("member").alias("id")))
    pivots = stars.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                          F.lit(True).alias("own"), F.col("pivot").alias("id"))
    rows = (members.unionByName(pivots).join(docs, "id")
            .repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.desc("own"))
            .select("pivot", "part", "own", "id", "text"))
    kind = docs.schema["id"].dataType
    return rows.mapInArrow(_linker(words, percent), T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``id, n_shingles, component_id, kept``."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType
    signed = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("a", T.LongType()),
                           T.StructField("b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    sets = stored(texts.mapInArrow(_signer(words), signed), "sets")
    texts = texts.filter("id is not null")
    real = sets.filter("n > 0 and id is not null")
    classes = stored(real.groupBy("a", "b").agg(F.min("id").alias("rep"), F.first("n").alias("n"),
                                                F.any_value("bands").alias("bands")), "classes")

    entries = classes.select("rep", "n", F.posexplode("bands").alias("band", "h"))
    buckets = stored(entries.groupBy("h").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi"), "buckets")
    filed = stored(entries.join(buckets, "h"), "filed")
    # The texts of all documents that share a bucket, fetched once.
    texts = stored(texts.join(filed.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "texts")
    stars = (filed.select(F.col("rep").alias("member"), F.col("lo").alias("pivot")).filter("member != pivot")
             .unionByName(filed.filter("rep != hi and rep != lo").select(F.col("rep").alias("member"), F.col("hi").alias("pivot")))
             .distinct())
    links = stored(_verified(stars, texts, words, percent), "links")

    # Rows with one id but different sets: their classes belong together.
    twice = stored(real.groupBy("id").agg(F.min("a").alias("x"), F.max("a").alias("y"), F.min("b").alias("p"),
                                          F.max("b").alias("q")).filter("x != y or p != q").select("id"), "repeated-ids")
    same = (real.join(twice, "id").join(classes.select("a", "b", "rep"), ["a", "b"])
            .filter("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    owners = same.select(F.col("u").alias("v"), F.col("v").alias("u"))
    links = links.unionByName(owners)
    groups = components(links)

    filed = stored(filed.select("h", "band", "rep", "n").join(
        groups.select(F.col("u").alias("rep"), F.col("v").alias("c")), "rep", "left")
        .withColumn("c", F.coalesce("c", "rep")), "filed")
    more = stored(_across(filed, texts, words, percent), "more-links")
    if not more.isEmpty():
        groups = components(groups.unionByName(more))

    of_class = stored(classes.select("a", "b", "rep").join(
        groups.select(F.col("u").alias("rep"), F.col("v").alias("c")), "rep", "left")
        .select("a", "b", F.coalesce("c", "rep").alias("c")), "class-components")
    found = sets.select("id", "n", "a", "b").join(of_class, ["a", "b"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("id")))
    return found.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
