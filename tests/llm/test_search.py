"""MinHash, multi-index, SentencePiece and the pipeline: brute force, parity, edges."""

import collections
import importlib
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from workboard.llm import components, hashing, minhash, multi_index, sentencepiece
from workboard.llm.common import stored

SMALL = "/root/testdata/sf0.01"


# MinHash

def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_groups(rows, n, percent=80):
    """``(id, size, component)`` per row; rows that share an id are one document."""
    sets = []
    for i, t in rows:
        w = words_of(t)
        sets.append((i, {tuple(w[k: k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, s) in enumerate(sets):
        for j, c in sets[:x]:
            if i is not None and j is not None and s and c and 100 * len(s & c) >= percent * len(s | c):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted(((i, len(s), None if i is None else root(i) if s else i, i is None or root(i) == i or not s) for i, s in sets), key=repr)


def grouped(spark, rows, n=4):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, component_id int")
    return sorted([tuple(r) for r in minhash.near_duplicates(df, words=n).collect()], key=repr)


def noisy(g, words, share):
    return " ".join("".join(g.choice(list("abcdefgh"), 6)) if g.random() < share else w for w in words)


def test_word_hashes_follow_the_definition(monkeypatch):
    g = np.random.default_rng(8)
    texts = [None, "", "A b\tC", "É é x", "  ", "word " * 50, "x" * 5000] + [
        " ".join("".join(g.choice(list("aBé\n\t xyz"), int(g.integers(1, 12)))) for _ in range(30)) for _ in range(40)]
    monkeypatch.setattr(hashing, "_PIECE", 64)  # many pieces
    codes, at = hashing.word_hashes(pa.array(texts))
    seen = {}
    for t, a, b in zip(texts, at[:-1], at[1:]):
        w = words_of(t)
        assert b - a == len(w)
        for x, code in zip(w, codes[a:b].tolist()):
            assert seen.setdefault(x, code) == code
    assert len(set(seen.values())) == len(seen)


def test_circulant_signature_estimates_jaccard():
    g = np.random.default_rng(1)
    x = g.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = x[:2000], x[500:2500]
    same = (minhash.signature(a, 1024) == minhash.signature(b, 1024)).mean()
    assert abs(same - 1500 / 2500) < 0.06
    # Coordinate k shifts one and the same permutation.
    s = minhash._permute32((a >> np.uint64(32)).astype(np.uint32) ^ (a & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    assert minhash.signature(a, 8)[5] == minhash._permute32(s - np.uint32(5)).min()


def test_near_duplicates_equal_brute_force(spark):
    g = np.random.default_rng(5)
    base = [["".join(g.choice(list("abcdefgh"), 5)) for _ in range(120)] for _ in range(4)]
    rows = [(100 + i, noisy(g, base[i % 4], share)) for i, share in enumerate(g.choice([0, 0.01, 0.02, 0.03, 0.04, 0.06], 120))]
    rows += [(1, "a b c d e f g h"), (2, "A  b c d\te f g h"), (3, "a b"), (4, "A b"), (5, "b a"), (6, None), (7, ""), (8, " \n"),
             (9, "word"), (10, "word"), (None, "word"), (None, None), (11, "x y z w v"), (11, "x y z w v"), (12, "k l m n o p"), (12, "word"),
             (13, "k l m n o p")]
    assert grouped(spark, rows) == brute_groups(rows, 4)


def test_large_groups_go_through_blocks(spark, monkeypatch):
    """A hub with many copies on the verge: links come from parts and blocks, none is lost."""
    monkeypatch.setattr(minhash, "STAR_ROWS", 8)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    g = np.random.default_rng(6)
    base = ["".join(g.choice(list("abcdefgh"), 5)) for _ in range(150)]
    rows = [(i, noisy(g, base, 0.028)) for i in range(150)]
    assert grouped(spark, rows) == brute_groups(rows, 4)


def test_blocks_find_links_that_stars_miss(spark, monkeypatch):
    """Without the stars' links the blocks alone give the same components."""
    g = np.random.default_rng(9)
    base = ["".join(g.choice(list("abcdefgh"), 5)) for _ in range(150)]
    rows = [(i, noisy(g, base, 0.02)) for i in range(60)]
    want = brute_groups(rows, 4)
    real = minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda *a: real(*a).limit(0))
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    assert grouped(spark, rows) == want


def test_blocks_compare_every_pair_that_shares_a_band():
    """Pairs with few equal coordinates are compared on the full sets too."""
    g = np.random.default_rng(12)
    found = 0
    for _ in range(200):
        words = g.integers(0, 2**63, 160).astype(np.uint64)
        sets = [np.unique(words[:125]), np.unique(words[35:])]  # 90 of 160 in common
        equal = minhash.signature(sets[0]) == minhash.signature(sets[1])
        bands = np.flatnonzero(equal.reshape(minhash.BANDS, minhash.ROWS).all(axis=1))
        if len(bands) and equal.sum() < 80:
            found += 1
            assert list(minhash._block_links([1, 2], [1, 2], [True, True], int(bands[0]), sets, 50)) == [(1, 2)]
    assert found > 20


def test_near_duplicates_empty(spark):
    assert grouped(spark, []) == []
    assert grouped(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_components(spark):
    g = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in g.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == {x: root(x) for x in nodes if root(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


# Multi-index

def brute_nearest(ids, x, own, top):
    s = np.zeros(len(x))
    q = x[list(ids).index(own)]
    for k in range(x.shape[1]):
        s += q[k] * x[:, k]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != own][:top]
    return [(int(ids[i]), float(s[i])) for i in order]


def test_multi_index_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    out = collections.defaultdict(list)
    for r in multi_index.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score, r.rank))
    hit = total = 0
    for own in ids[ids % 20 == 0].tolist():
        want = brute_nearest(ids, x, own, 20)
        got = out[own]
        assert [r for *_, r in got] == list(range(1, 21))
        assert [(-s, v) for v, s, _ in got] == sorted((-s, v) for v, s, _ in got)
        every = dict(brute_nearest(ids, x, own, len(ids)))
        assert all(every[v] == s for v, s, _ in got)
        hit, total = hit + len({v for v, _ in want} & {v for v, *_ in got}), total + 20
    assert hit >= 0.9 * total


def test_multi_index_traversal_is_by_summed_distance():
    g = np.random.default_rng(3)
    a, b, counts = g.normal(0, 1, 7), g.normal(0, 1, 5), g.integers(0, 4, 35)
    got = multi_index.traverse(a, b, counts, 40)
    order = sorted((c for c in range(35) if counts[c]), key=lambda c: a[c // 5] + b[c % 5])
    assert got == order[: len(got)] and counts[got].sum() >= 40 > counts[got[:-1]].sum()


def test_multi_index_edges(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 0.5, -2.0, 0.25]
    rows = [(0, same), (20, None), (40, []), (60, [0.0] * 4), (80, [1.0, None, 0.0, 0.0]), (100, [nan, 1.0, 0.0, 0.0]), (120, [inf, 0.0, 0.0, 0.0]),
            (3, same), (2, same), (1, same), (5, [-1.0, 0.0, 0.0, 0.0]), (140, [1.0, 2.0]), (None, same), (0, same)]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    out = [tuple(r) for r in multi_index.search(df, F.col("vec_id") % 20 == 0).collect()]
    score = sum(x * x for x in same)
    assert sorted(out) == [(0, 1, 1, score), (0, 2, 2, score), (0, 3, 3, score), (0, 4, 5, -1.0)]
    assert multi_index.search(df.limit(0), F.lit(True)).collect() == []
    assert multi_index.search(df.filter("vec_id = 20"), F.lit(True)).collect() == []


# SentencePiece

def test_parity_with_the_reference_library(spark):
    data = sentencepiece._load(sentencepiece.MODEL)
    tok = sentencepiece.tokenizer(data)
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(300).collect()]
    g = np.random.default_rng(1)
    texts += ["".join(g.choice(list(" \n\t▁aé日\U0001F600<0x41>.\u0000"), 40)) for _ in range(200)]
    sentencepiece.check_parity(tok, data, texts)
    import sentencepiece as reference
    other = reference.SentencePieceProcessor(model_proto=data)
    assert sentencepiece.Encoder(data)(texts).to_pylist() == other.encode(texts)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def unigram_model(fallback):
    """A model file written by hand: pieces with scores, unigram, flags."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, s, 1) for p, s in [("▁", -3.0), ("▁th", -4.1), ("e", -2.5), ("▁the", -3.2), ("t", -4.0), ("h", -4.3), ("a", -3.7), ("▁a", -3.1),
                                      ("in", -3.9), ("i", -4.6), ("n", -4.4), ("▁▁", -6.0), ("é", -7.0), ("the", -5.5)]]
    out = b"".join(message(1, message(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for p, s, k in pieces)
    trainer = varint(3 << 3) + varint(1) + varint(4 << 3) + varint(len(pieces)) + varint(35 << 3) + varint(int(fallback))
    normal = message(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1)
    return out + message(2, trainer) + message(3, normal)


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_scores_give_the_reference_ids(fallback):
    import sentencepiece as reference
    data = unigram_model(fallback)
    tok, other = sentencepiece.build(data), reference.SentencePieceProcessor(model_proto=data)
    for text in ["the thin ant", "in  the", "éa the", "", "a", "hat then"] + (["xyz the 日"] if fallback else []):
        assert tok.encode(text, add_special_tokens=False).ids == other.encode(text), text
    assert sentencepiece.read_model(data)["unigram"]


def test_slices_hold_every_row_once():
    import pyarrow as pa
    texts = ["a" * int(n) for n in np.random.default_rng(1).integers(0, 9000, 700)] + [None, "", "b" * 3_000_000, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = [p.column(0).to_pylist() for p in sentencepiece._slices(batch, 0)]
    assert [t for p in parts for t in p] == texts and all(p for p in parts)
    assert all(len(p) <= sentencepiece.SLICE_ROWS and (len(p) == 1 or sum(len(t or "") for t in p) <= sentencepiece.SLICE_BYTES) for p in parts)
    assert list(sentencepiece._slices(batch.slice(0, 0), 0)) == []


def test_a_task_leaves_no_words_in_its_worker():
    data = sentencepiece._load(sentencepiece.MODEL)
    batch = pa.RecordBatch.from_arrays([pa.array([f"word{i} and word{i + 1}" for i in range(600)])], names=["text"])
    assert sum(x.num_rows for x in sentencepiece._encoder(data, 0)(iter([batch]))) == 600
    kept = sentencepiece._kept_encoder(data)
    assert not kept.at and not kept.chars and not len(kept.ids)


def test_encode_edges(spark):
    df = spark.createDataFrame([(1, "Hi there", 5), (2, None, 6), (3, "", 7), (1, "Hi there", 5), (4, "y" * 100_000, 8)],
                               "doc_id long, text string, n_tokens int")
    rows = sorted(sentencepiece.encode(df).collect(), key=lambda r: r.doc_id)
    assert [r.decoded for r in rows[:2]] == ["Hi there"] * 2 and rows[2].input_ids == [] and rows[2].decoded == "" and rows[3].n_tokens == 0
    assert rows[4].decoded == "y" * 100_000 and rows[4].n_tokens == len(rows[4].input_ids)
    assert sentencepiece.encode(df.limit(0)).collect() == []


# Pipeline

def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), "test")
        assert docs.columns == columns and 0.7 * before < docs.count() <= before, name
        before = docs.count()
    out = pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert out.count() == before and out.filter("decoded != text").count() == 0


def test_pipeline_rules(spark):
    """Toxic, copied, near-copied and contaminated documents go; others keep their text; nulls pass."""
    pipeline = importlib.import_module("corpus_pipeline")
    g = np.random.default_rng(4)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    word = lambda: "".join(g.choice(list("abcdefghijklm"), 5))
    clean = [" ".join(word() for _ in range(60)) for _ in range(4)]
    near = clean[1].split()
    near[30] = "changed"
    rows = [(9001, clean[0]), (9002, clean[1]), (9003, " ".join(near)), (9004, item), (9005, clean[2]), (9006, clean[2]), (9007, None), (9008, ""),
            (None, clean[3]), (9010, "you idiot pathetic scum worthless moron loser idiot"), (9002, clean[1])]
    real = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = real.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], real.schema))
    out = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        docs = stored(docs, "test")
        out[name] = [(r.doc_id, r.text) for r in docs.filter("doc_id is null or doc_id > 9000").collect()]
    last = collections.Counter(i for i, _ in out["sentencepiece"])
    assert last == collections.Counter([9001, 9002, 9005, 9007, 9008, None])
    assert (9006, clean[2]) not in out["line dedup"] and 9010 not in dict(out["toxicity"])


def test_near_duplicate_stage_keeps_clean_documents_of_one_id(spark):
    """Different texts under one id all stay; copies go, without an id or repeated too; smallest id first."""
    pipeline = importlib.import_module("corpus_pipeline")
    g = np.random.default_rng(14)
    clean = [" ".join("".join(g.choice(list("abcdefgh"), 6)) for _ in range(80)) for _ in range(60)]
    rows = [(0, t) for t in clean[:40]]
    rows += [(5, clean[50]), (3, clean[50]), (None, clean[50]), (None, clean[51]), (None, clean[51]), (7, clean[52]), (7, clean[52]),
             (None, clean[0]), (9, None), (9, None), (8, ""), (None, None), (2, clean[53] + " tail"), (6, clean[53])]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    want = [(0, t) for t in clean[:40]] + [(3, clean[50]), (None, clean[51]), (7, clean[52]), (9, None), (8, ""), (None, None), (2, clean[53] + " tail")]
    for parts in (2, 9):
        out = pipeline.drop_near_duplicates(spark, df.repartition(parts), SMALL)
        assert out.columns == df.columns
        assert sorted([(r.doc_id, r.text) for r in out.collect()], key=repr) == sorted(want, key=repr)
    assert pipeline.drop_near_duplicates(spark, df.limit(0), SMALL).collect() == []


def test_entry_registers_every_operator():
    import __spark_entry__ as entry
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
