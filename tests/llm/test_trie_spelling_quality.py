"""Prefix trie, spelling variants and quality rules against brute force; edges."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from workboard.llm import euler, prefix_trie, quality, queries, spelling
from workboard.llm.common import stored

SMALL = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth string, conv string"


# Prefix trie

def brute_trie(rows, rebuild):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    said = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        built[c] = said.get(c - c % 100, [])[:h] + own[h:]
    nodes, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += not kids[k]
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)).encode()).hexdigest())
                  for k, m in nodes.items()) if built else []


def trie_of(spark, rows, rebuild=True, last=euler.LAST):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    numbered = prefix_trie.number_turns(df)
    if rebuild:
        return prefix_trie.trie(*prefix_trie.share_first_turns(numbered), last)
    return prefix_trie.trie(numbered, stored(numbered.select("conv").distinct(), "c"), last)


def same(got, want):
    key = lambda r: (r[1], r[0], r[7])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_trie_equals_brute_force_with_distributed_ranks(spark):
    random.seed(3)
    rows = [(c, t, random.choice(["user", "assistant"]), random.choice(["", "a", "bb"]))
            for c in [*range(40), *range(100, 130), 250] for t in range(random.randint(1, 9))]
    rows += [(7, None, None, None), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (None, 0, "user", "lost"), (5, 3, None, "x")]
    want = brute_trie(rows, True)
    same(trie_of(spark, rows, last=20).collect(), want)  # two levels of rulers
    same(trie_of(spark, rows).collect(), want)


def test_trie_hot_and_long_conversations(spark):
    # One conversation of 3,000 turns (three blocks), 300 equal ones, one wide root.
    rows = [(1, t, "user", f"t{t}") for t in range(3000)]
    rows += [(c, t, "user", f"same{t}") for c in range(200, 500) for t in range(2)]
    rows += [(c, 0, "user", f"own{c}") for c in range(1000, 1400)]
    got = trie_of(spark, rows, rebuild=False, last=100).collect()
    root = next(r for r in got if r.depth == 0)
    assert (root.conv_id, root.parent_conv_id, root.n_convs, root.n_children, root.n_leaves) == (1, None, 701, 402, 402)
    assert root.saved_tokens == 2 * 299 * len("same0")
    deep = next(r for r in got if r.depth == 3000)
    assert (deep.conv_id, deep.parent_conv_id, deep.n_children, deep.n_leaves) == (1, 1, 0, 1)
    equal = next(r for r in got if r.depth == 2 and r.conv_id == 200)
    assert equal.ends_sha256 == hashlib.sha256(",".join(map(str, range(200, 500))).encode()).hexdigest()


def test_trie_of_no_conversations(spark):
    assert trie_of(spark, []).collect() == []
    assert trie_of(spark, [(None, 1, "user", "x")]).collect() == []


@pytest.mark.parametrize("last", [5, 1000])
def test_list_ranks(spark, last):
    order = list(range(300))
    random.seed(1)
    random.shuffle(order)
    rows = [(a, 0, b, 0 if b is not None else None, 1) for a, b in zip(order, [*order[1:], None])]
    links = stored(spark.createDataFrame(rows, "a long, c long, ta long, tc long, dist long"), "links")
    got = {r.a: r["rank"] for r in euler.list_ranks(links, last).collect()}
    assert got == {a: 299 - i for i, a in enumerate(order)}


# Spelling variants

def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if x.isascii() else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, out = {}, []
    for w in n:
        close = [v for v in n if v != w and near(v, w)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out.append((w, len(close)))
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n[w], k, n.get(form[w])) for w, k in out)


def spelling_docs():
    random.seed(5)
    words = ["".join(random.choice("abcé") for _ in range(random.randint(4, 7))) for _ in range(120)]
    docs = [(i, " ".join(random.choice(words).title() if i % 3 else random.choice(words) for _ in range(60)) + "—Ünder×score_x1")
            for i in range(150)]
    return docs + [(None, "null null nulls nulls nulls nullx"), (3, None), (4, ""), (9, "z" * 30_000 + " " + "z" * 30_000 + "," + "z" * 30_000)]


@pytest.mark.parametrize("limit,shard", [(spelling.LIMIT, spelling.SHARD), (4, 30)])
def test_spelling_equals_brute_force(spark, limit, shard):
    docs = spelling_docs()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, word string, n string")
    words = spelling.vocabulary(spelling.drop_letters(spelling.runs(df), 97))
    got = spelling.forms(words, spelling.near_pairs(words, limit, shard)).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == brute_spelling(docs)


def test_spelling_splits_large_groups(spark):
    words = stored(spark.createDataFrame([(f"{a}{b}cdefgh", 3) for a in "abcdefghij" for b in "abcdefghij"], "word string, n long"), "w")
    searched = spelling.groups(words, 12).filter("ell = length(word)")  # one free letter is left: at most the alphabet
    assert searched.groupBy("key").count().agg({"count": "max"}).first()[0] <= 12
    assert spelling.near_pairs(words, 12, 50).count() == 100 * 18


def test_spelling_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group(spelling.vocabulary(spelling.runs(df))).collect() == []


# Quality rules

def brute_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i: i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i: i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def brute_fit(x):
    """The estimate of one group by the same steps, row by row."""
    floor, p = quality.FLOOR, quality.P

    def floored(rows, weights, share):
        mean = np.average(rows, axis=0, weights=weights)
        return mean, np.average([np.outer(r, r) for r in rows - mean], axis=0, weights=weights) * quality.consistency(share) + np.diag(floor ** 2)

    def d2(mean, scatter):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)

    centre = np.array([(np.sort(np.floor(c / quality.WIDTH))[(len(c) + 1) // 2 - 1] + 0.5) * quality.WIDTH for c in x.T])
    z = (x - centre) / floor
    sign = sum(np.outer(r, r) / (r @ r + 1e-12) for r in z) / len(z) * p + np.eye(p) * 0.05
    states = [[centre, s * np.outer(floor, floor), np.inf] for s in (np.eye(p), sign)]
    for _ in range(quality.STEPS):
        moved = 0.0
        for s in states:
            d = d2(s[0], s[1])
            b = np.floor(np.log2(np.maximum(d, 2.0 ** quality.LOWEST)) * quality.FINE)
            weight, left = np.zeros(len(x)), len(x) / 2
            for v in np.unique(b):
                k = (b == v).sum()
                weight[b == v] = min(1.0, max(0.0, left / k))
                left -= k
            mean, scatter = floored(x[weight > 0], weight[weight > 0], 0.5)
            logdet = np.linalg.slogdet(scatter)[1]
            moved = max(moved, s[2] - logdet)
            s[:] = [mean, scatter, logdet]
        if moved <= quality.SETTLED:
            break
    mean, scatter, _ = min(states, key=lambda s: s[2])
    inside = d2(mean, scatter) <= quality.chi2_quantile(quality.REWEIGHT, p)
    return d2(*floored(x[inside], np.ones(inside.sum()), quality.REWEIGHT))


def vector(text):
    n, chars, symbols, dup, rep = brute_counts(text)
    lines = [x for x in text.split("\n") if x.strip()]
    caps = len(re.findall("[A-Z]", text))
    return [np.log(chars / n), np.sqrt(symbols / chars), np.sqrt(dup / len(lines)), np.sqrt(rep / n), np.sqrt(caps / chars)]


def quality_docs():
    random.seed(8)
    words = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 9))) for _ in range(400)]
    docs = []
    for i in range(260):
        said = [random.choice(words) for _ in range(random.randint(50, 120))]
        if i % 20 == 7:
            said = [w + "$#*" for w in said]
        if i % 20 == 8:
            said = [w.upper() for w in said]
        docs.append((i, "\n".join(" ".join(said[k: k + 12]).capitalize() if i % 20 != 8 else " ".join(said[k: k + 12])
                                  for k in range(0, len(said), 12)), ["en", "de", None][i % 3], f"s{i % 2}" if i % 5 else "rare"))
    return docs + [(900, None, "en", "s0"), (901, "", None, None), (902, "a b c " * 60, "en", "s0"), (902, "a b c " * 60, "en", "s0")]


def test_quality_equals_brute_force(spark):
    docs = quality_docs()
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, lang string, source string, n_words string, x0 string")
    got = {r.id: r for r in quality.judge(df).collect()}
    assert len(got) == len(docs) - 1
    cell, usable = defaultdict(list), {}
    for i, text, lang, source in docs:
        c = brute_counts(text)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == c
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        assert got[i].base_failed == failed and not (failed and got[i].kept)
        if not failed:
            cell[lang, source].append(i)
            usable[i] = text
    small = {k for k, v in cell.items() if len(v) < quality.LEAST}
    pools = defaultdict(list)
    for k, v in cell.items():
        pools["", k[0]] += v if k in small else []
    merged = [v for k, v in cell.items() if k not in small] + [v for v in pools.values() if len(v) >= quality.LEAST]
    merged.append([i for v in pools.values() if len(v) < quality.LEAST for i in v])
    seen = 0
    for ids in merged:
        if len(ids) < quality.LEAST:
            assert all(got[i].kept and got[i].distance is None for i in ids)
            continue
        want = brute_fit(np.array([vector(usable[i]) for i in ids]))
        assert np.allclose([got[i].distance for i in ids], want, rtol=1e-6)
        seen += len(ids)
    assert seen > 100
    assert not any(got[i].kept for i in usable if i % 20 in (7, 8) and got[i].distance is not None)
    assert all(got[i].kept for i in usable if i % 20 not in (7, 8))


def test_quality_same_under_another_partitioning(spark):
    docs = quality_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    one = sorted((r.id, r.kept) for r in quality.judge(df.coalesce(1)).collect())
    assert one == sorted((r.id, r.kept) for r in quality.judge(df.repartition(13)).collect())


def test_quality_of_nothing_and_long_text(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert quality.judge(spark.createDataFrame([], schema)).collect() == []
    long = " ".join(str(k) for k in range(400_000))
    row = quality.judge(spark.createDataFrame([(1, long, "en", "s")], schema)).first()
    assert (row.n_words, row.n_repeat_words, row.kept) == (400_000, 0, True)


def test_quality_on_labelled_documents(spark):
    """Held to the labels, which the operator never sees."""
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/labels.parquet").collect()}
    got = [(labels[r.id], r.base_failed, r.kept) for r in quality.judge(docs).collect() if r.id in labels]
    assert all(kept for good, failed, kept in got if good and not failed)
    assert not any(kept for good, _, kept in got if not good)


def test_queries_are_registered():
    assert {"op11_prefix_trie", "op12_spelling", "op13_quality"} <= set(queries.QUERIES)
