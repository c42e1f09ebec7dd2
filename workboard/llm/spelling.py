"""Spelling variants grouped by bidirectional FM-index search schemes.

Two words are near if they differ by one inserted, deleted or replaced code point.
Such words agree in the first or in the last half of the shorter one, so each word
joins the groups of its halves: as a word of its own length, and as one that is a
letter longer than the others. Groups are packed into shards. A task builds the
bidirectional FM-index of its shard's delimited words (:mod:`workboard.llm.fm_index`),
matches one half of every word exactly and extends across the other allowing one
error. An error stands in one place, so a pair is found in one group alone.

A group of more than LIMIT words is split exactly: its free half is halved again,
and a pair must agree in one of the quarters, which become part of the group's
name. This goes on while a group is too large and has two free letters, so no task
holds more than a bounded number of words, whatever beginnings are common.

Defined results: a null text has no words, a null id counts as the empty text;
repeated rows count again; words may be of any length. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.llm.common import ascii_lower, drop_stored, stored, whole_text
from workboard.llm.fm_index import BidirectionalIndex

#: Maximal runs of these are words; A-Z are lower-cased before.
LETTERS = r"[a-zÀ-ÿ]+"
#: Words in a shard, about, and in a group before it is split.
SHARD = 8_000
LIMIT = 8_000


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` (as text), ``run``: every maximal run of letters, A-Z lower-cased."""
    text = ascii_lower(whole_text(F.col(text_col)))
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))


def drop_letters(found: DataFrame, one_in: int) -> DataFrame:
    """Of one run in ``one_in`` (by the CRC-32 of ``id:run``) a letter is deleted."""
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select("id", F.when(h % one_in == 0, cut).otherwise(F.col("run")).alias("run"))


def vocabulary(found: DataFrame, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """``word, n``: the distinct runs with their counts (stored)."""
    return stored(found.filter(F.length("run") >= min_chars).groupBy(F.col("run").alias("word"))
                  .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count), "vocabulary")


def _memberships(words: DataFrame) -> DataFrame:
    """``word, n, ell, p, s``: a group is of length ``ell`` (or one letter more) with ``p`` first and ``s`` last letters."""
    half = F.floor(F.col("ell") / 2).cast("int")
    return (words.withColumn("ell", F.explode(F.array(F.length("word"), F.length("word") - 1)))
            .withColumn("side", F.explode(F.array(F.lit(True), F.lit(False))))
            .select("word", "n", "ell", F.when(F.col("side"), half).otherwise(0).alias("p"),
                    F.when(F.col("side"), 0).otherwise(F.col("ell") - half).alias("s")))


def _named(members: DataFrame) -> DataFrame:
    head, tail = F.substring("word", F.lit(1), F.col("p")), F.right("word", F.col("s"))
    return members.withColumn("key", F.concat_ws(":", "ell", "p", "s", head, tail))


def _split(members: DataFrame) -> DataFrame:
    """The groups of each half of the free letters."""
    middle = F.col("p") + F.floor((F.col("ell") - F.col("s") - F.col("p")) / 2).cast("int")
    return (members.withColumn("side", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("m", middle)
            .select("word", "n", "ell", F.when(F.col("side"), F.col("m")).otherwise(F.col("p")).alias("p"),
                    F.when(F.col("side"), F.col("s")).otherwise(F.col("ell") - F.col("m")).alias("s")))


def groups(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The members of all groups with more than one word, none of more than ``limit`` that can be split (stored)."""
    done, open_ = None, stored(_named(_memberships(words)), "members")
    while True:
        sizes = open_.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("ell") - F.col("p") - F.col("s")).alias("free"))
        kinds = stored(sizes.filter("size > 1").select("key", ((F.col("size") > limit) & (F.col("free") > 1)).alias("large")), "groups")
        part = stored(open_.join(kinds.filter("not large").select("key"), "key"), "members")
        done = part if done is None else done.unionByName(part)
        large = kinds.filter("large").select("key")
        if large.isEmpty():
            return done
        before, open_ = open_, stored(_named(_split(open_.join(large, "key").drop("key"))), "members")
        drop_stored(before)


def _search(batches):
    """Near words of one shard."""
    table = pa.Table.from_batches(batches)
    words, number = np.unique(np.array(table["word"].to_pylist(), object), return_inverse=True)
    n = np.zeros(len(words), np.int64)
    n[number] = table["n"].to_numpy()
    index = BidirectionalIndex(list(words))
    own = np.flatnonzero(index.lens[number] == table["ell"].to_numpy())  # the others are only looked for
    p, s = (table[c].to_numpy()[own].astype(np.int64) for c in ("p", "s"))
    at, found = index.near(number[own], p, s)
    word = number[own][at]
    longer = index.lens[found] > index.lens[word]  # a longer word does not search for this one
    a, b = np.concatenate([word, found[longer]]), np.concatenate([found, word[longer]])
    return pa.table({"word": pa.array(words[a], pa.string()), "near": pa.array(words[b], pa.string()), "near_n": n[b]})


def near_pairs(words: DataFrame, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """``word, near, near_n``: both directions of each pair of near words of ``word, n`` (stored, distinct words)."""
    members = groups(words, limit)
    shards = max(1, -(-members.count() // shard))
    return (members.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard")
            .applyInArrow(lambda t: _search(t.to_batches()), "word string, near string, near_n long"))


def forms(words: DataFrame, pairs: DataFrame, times: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n``.

    The form is the near word of largest count (ties: smallest in code-point order)
    if that is ``times`` the word's own or more; the root ends the chain of forms.
    """
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("x"))
    form: Column = F.when(-F.col("x.n") >= times * F.col("n"), F.col("x.near"))
    table = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"),
        F.when(form.isNotNull(), -F.col("x.n")).alias("form_n")), "forms")
    # Counts at least double along a chain, so doubling its steps ends after a few rounds.
    steps = stored(table.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(steps.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_stored(steps)
        steps = new
        if new.filter("moved").isEmpty():
            break
    return table.join(steps.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(words: DataFrame) -> DataFrame:
    """Spelling variants of a stored vocabulary ``word, n``."""
    return forms(words, near_pairs(words))
