"""Conversation prefix trie by the Euler-tour technique.

A node is a distinct sequence of first turns (role and text); a conversation is a
member of the node of each of its prefixes, all are members of the root. The turns
of a conversation are numbered by a skew-safe scan, and a prefix is named by the
XOR of 127-bit hashes of its turns and their places, a running value that needs no
conversation in one task. Nodes, members and children are aggregates over these
names. For the subtrees an enter and an exit arc is built per node, linked in the
order of a depth-first walk (children by name), ranked as a linked list
(:mod:`workboard.llm.euler`), and weights at the enter arcs are summed up to each
place: a subtree's total is the difference between its exit and its enter.

Defined results: null roles and texts are empty; turns of one conversation are
ordered by turn (null first), then role and text; repeated rows are turns of their
own; rows without a conversation id take no part; an empty table has no nodes, not
even a root. Extra columns are ignored. Texts and conversations may be of any
length. Ids are compared as long integers.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workboard.llm.common import stored
from workboard.llm.euler import LAST, list_ranks, running
from workboard.operators.keyed_scan import keyed_row_number, keyed_scan

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def number_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, p, h1, h2, chars``: the turns of each conversation, numbered from 1, as hashes (stored)."""
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("conv is not null")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return stored(keyed_row_number(rows, ["conv"], order, "p").select(
        "conv", "p", F.xxhash64(F.lit(1), F.length("role"), "role", "text").alias("h1"),
        F.xxhash64(F.lit(2), F.length("role"), "role", "text").alias("h2"), F.length("text").cast("long").alias("chars")), "turns")


def share_first_turns(numbered: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share beginnings: turns (as of :func:`number_turns`) and all ids.

    The first ``h = crc32(id) % most`` turns come from the conversation whose id is
    the next multiple of ``block`` below, as far as it has them; then follow the
    conversation's own turns after its first ``h``.
    """
    def base(conv):
        return F.col(conv) - F.col(conv) % block

    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    ids = stored(numbered.groupBy("conv").agg(F.max("p").alias("len")), "conversations")
    heads = ids.filter(F.col("conv") % block == 0).select(F.col("conv").alias("base"), "len")
    first = numbered.filter((F.col("conv") % block == 0) & (F.col("p") < most)).withColumnRenamed("conv", "base")
    shared = (ids.select("conv", base("conv").alias("base"), h.alias("h")).filter("h > 0")
              .join(first, "base").filter("p <= h").select("conv", "p", "h1", "h2", "chars"))
    own = (numbered.withColumns({"base": base("conv"), "h": h}).filter("p > h").join(heads, "base", "left")
           .select("conv", (F.col("p") - F.col("h") + F.least(F.col("h"), F.coalesce("len", F.lit(0)))).alias("p"), "h1", "h2", "chars"))
    return stored(shared.unionByName(own), "rebuilt"), ids.select("conv")


def _digests(batches):
    """SHA-256 of the chunks of each node, one after the other; rows come sorted by node and chunk."""
    def send(done):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in done], pa.int64()), pa.array([k[1] for k, _ in done], pa.int64()),
                                           pa.array([v for _, v in done], pa.string())], names=["a", "b", "sha"])

    key, digest = None, None
    for batch in batches:
        done = []
        a, b, ids = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "ids"))
        for x, y, chunk in zip(a, b, ids):
            if (x, y) == key:
                digest.update(b",")
            else:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = (x, y), hashlib.sha256()
            digest.update(chunk.encode())
        if done:
            yield send(done)
    if key is not None:
        yield send([(key, digest.hexdigest())])


def _ends(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """``a, b, sha``: digest of the ids of the conversations that end at a node."""
    last = prefixes.groupBy("conv").agg(F.max(F.struct("p", "a", "b")).alias("x")).select("conv", "x.a", "x.b")
    zero = F.lit(0).cast("long")
    at = convs.join(last, "conv", "left").select("conv", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))
    # Ids of 1,024 neighbouring numbers make one chunk; a node's chunks are hashed in a stream.
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = at.groupBy("a", "b", F.shiftright("conv", 10).alias("chunk")).agg(ids.alias("ids"))
    return (chunks.repartition("a", "b").sortWithinPartitions("a", "b", "chunk")
            .mapInArrow(_digests, "a long, b long, sha string"))


def _arcs(nodes: DataFrame) -> DataFrame:
    """The tour as a linked list of arcs: enter ``(a, b)`` and exit ``(a, b | 1)`` of each node."""
    key = F.struct("a", "b")
    below = nodes.filter("depth > 0")
    first = below.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.min(key).alias("first"))
    # The next sibling is the one before in falling order; a node may have any number of children.
    falling = keyed_scan(below.select("pa", "pb", "a", "b", key.alias("k")), ["pa", "pb"],
                         [F.col("a").desc(), F.col("b").desc()], carry_before={"next": "k"})
    one = F.lit(1).cast("long")
    exits = falling.select(
        "a", F.col("b").bitwiseOR(one).alias("c"), F.coalesce(F.col("next.a"), F.col("pa")).alias("ta"),
        F.coalesce(F.col("next.b"), F.col("pb").bitwiseOR(one)).alias("tc"))
    enters = nodes.select("a", "b").join(first, ["a", "b"], "left").select(
        "a", F.col("b").alias("c"), F.coalesce(F.col("first.a"), F.col("a")).alias("ta"),
        F.coalesce(F.col("first.b"), F.col("b").bitwiseOR(one)).alias("tc"))
    none = F.lit(None).cast("long")
    end = nodes.filter("depth = 0").select("a", F.col("b").bitwiseOR(one).alias("c"), none.alias("ta"), none.alias("tc"))
    return enters.unionByName(exits).unionByName(end).withColumn("dist", one)


def trie(numbered: DataFrame, convs: DataFrame, last: int = LAST) -> DataFrame:
    """One row per node of numbered turns (``conv, p, h1, h2, chars``) of the conversations ``convs`` (``conv``).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. ``last``: see :func:`euler.list_ranks`.
    """
    rows = numbered.withColumns({"g1": F.xxhash64(F.lit(3), "p", "h1", "h2"),
                                 "g2": F.xxhash64(F.lit(4), "p", "h1", "h2").bitwiseAND(F.lit(-2).cast("long"))})
    named = running(rows, ["conv"], "p", xors=["g1", "g2"]).withColumnsRenamed({"run_g1": "a", "run_g2": "b"})
    prefixes = stored(named.select("conv", "p", "a", "b", F.col("a").bitwiseXOR(F.col("g1")).alias("pa"),
                                   F.col("b").bitwiseXOR(F.col("g2")).alias("pb"), "chars"), "prefixes")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = (convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).filter("n_convs > 0")
            .select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), none.alias("pa"), none.alias("pb"),
                    "n_convs", "conv_id", zero.alias("chars")))
    nodes = stored(prefixes.groupBy("a", "b", F.col("p").alias("depth")).agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.count(F.lit(1)).alias("n_convs"),
        F.min("conv").alias("conv_id"), F.min("chars").alias("chars")).unionByName(root), "nodes")
    if nodes.isEmpty():
        ranks = nodes.select("a", F.col("b").alias("c"), F.lit(0).cast("long").alias("rank"))
    else:
        ranks = list_ranks(stored(_arcs(nodes), "arcs"), last)
    children = stored(nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"))
                      .agg(F.count(F.lit(1)).alias("n_children")), "children")
    # Ranks are distances to the end; places count from 1.
    weights = (nodes.join(children, ["a", "b"], "left").select(
        "a", F.col("b").alias("c"), F.col("n_children").isNull().cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))
    places = stored(ranks.join(weights, ["a", "c"], "left").select(
        "a", "c", (F.lit(2 * nodes.count()) - F.col("rank")).alias("place"),
        F.coalesce("leaf", zero).alias("leaf"), F.coalesce("saved", zero).alias("saved")), "places")
    sums = running(places, [], "place", sums=["leaf", "saved"])
    out = F.col("c").bitwiseAND(F.lit(1).cast("long")) == 1
    # Up to the exit, less what stands before the enter.
    part = {c: F.sum(F.when(out, F.col(f"run_{c}")).otherwise(F.col(c) - F.col(f"run_{c}"))) for c in ("leaf", "saved")}
    subtrees = sums.groupBy("a", F.col("c").bitwiseAND(F.lit(-2).cast("long")).alias("b")).agg(
        part["leaf"].alias("n_leaves"), part["saved"].alias("saved_tokens"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    linked = stored(nodes.join(parents, ["pa", "pb"], "left").select(
        "a", "b", "conv_id", "depth", "parent_conv_id", "n_convs"), "linked")
    return (linked.join(children, ["a", "b"], "left").join(subtrees, ["a", "b"])
            .join(_ends(prefixes, convs), ["a", "b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA256)).alias("ends_sha256")))


def build(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the conversations of ``turns`` as they are."""
    numbered = number_turns(turns, conv_col, turn_col, role_col, text_col)
    return trie(numbered, stored(numbered.select("conv").distinct(), "conversations"))
