"""Personal data, page extraction, toxicity, suffix tree: brute force, accuracy, edges."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from workboard.llm import bilstm_crf, html_blocks, html_crf, pii, suffix_tree, toxicity
from workboard.llm.common import hash_sample

SMALL = "/root/testdata/sf0.01"


# Personal data

def brute_base(text):
    out = []
    out += [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        s = sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    g = np.random.default_rng(3)
    pieces = ["a@b.co", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4103973116826153", "4103 9731-1682 6153", "+1 (726) 555-7857", "+1", " ", "x",
              ".", "a.b@c.d.e@f.g", "é", "\U0001F600", "12", "-", "00001.2.3.4", "a@b", "%+@x-.y", "\n"]
    for _ in range(3000):
        text = "".join(g.choice(pieces, int(g.integers(1, 9))))
        assert pii.base_spans(text) == brute_base(text), text


def test_base_spans_are_linear_in_long_runs():
    text = "a" * 300_000 + "1" * 300_000 + "." + "@" * 1000 + "+" * 1000
    assert pii.base_spans(text) == []


def test_bilstm_crf_gradients_and_decoding():
    g = np.random.default_rng(0)
    codes, tags = g.integers(0, 130, (3, 6)), g.integers(0, 5, (3, 6))
    p = bilstm_crf.start(5, emb=3, hid=4)
    for name in p:
        p[name] = p[name] + g.normal(0, 0.1, p[name].shape)
    _, grads = bilstm_crf.loss_and_grads(p, codes, tags)
    for name in p:
        at = tuple(g.integers(0, s) for s in p[name].shape)
        if name == "emb":
            at = (codes[0, 0], at[1])
        old, eps = p[name][at], 1e-5
        losses = []
        for step in (eps, -eps):
            p[name][at] = old + step
            losses.append(bilstm_crf.loss_and_grads(p, codes, tags)[0])
        p[name][at] = old
        assert abs((losses[0] - losses[1]) / (2 * eps) - grads[name][at]) < 1e-6
    # Viterbi against all label sequences.
    e = bilstm_crf.emissions(p, codes[:1, :4])[0]
    import itertools
    value = lambda y: p["first"][y[0]] + sum(e[t, y[t]] for t in range(4)) + sum(p["tr"][a, b] for a, b in zip(y, y[1:]))
    assert tuple(bilstm_crf.decode(p, codes[:1, :4])[0]) == max(itertools.product(range(5), repeat=4), key=value)


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_pii_model_on_held_out_text(spark, model):
    """The network alone finds most spans that the patterns define, and some that they drop."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text rlike '[0-9@]'")
             .orderBy("doc_id").limit(400).collect()]
    found = total = 0
    for t in texts:
        starts = pii.window_starts(t)
        tags = bilstm_crf.decode(model, np.stack([bilstm_crf.char_codes(t[s: s + pii.WIDTH], pii.WIDTH) for s in starts]))
        spans = [(k, a + s, b + s) for s, row in zip(starts, tags) for k, a, b in pii._tagged(row[: len(t) - s])]
        base = set(pii.base_spans(t))
        found, total = found + len(base & set(pii.reconcile(t, spans, []))), total + len(base)
    assert total > 50 and found >= 0.8 * total


def test_pii_query_shape_and_edges(spark, model):
    df = spark.createDataFrame([(1, "mail a.b@x.org now", 1, "q"), (2, None, 2, "q"), (3, "", 3, "q"), (None, "1.2.3.4", 4, "q"), (1, "mail a.b@x.org now", 1, "q"),
                                (5, "z" * 200_000 + " +1 (726) 555-7857", 1, "q")], "doc_id long, text string, n_ip int, searched string")
    rows = pii.find(df, model).collect()
    none = hashlib.sha256(b"").hexdigest()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(rows) == 6 and len(by[1]) == 2 and by[1][0].spans == "email:5:14"
    assert by[2][0].base_sha256 == by[3][0].base_sha256 == none and by[2][0].spans == ""
    assert by[None][0].n_ip == 1 and by[5][0].n_phone == 1 and by[5][0].spans == "phone:200001:200018"
    assert by[1][0].searched == "q" and by[1][0].base_sha256 == hashlib.sha256(b"email:5:14").hexdigest()


def test_pii_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.fit(df) is None and pii.find(df, None).collect() == []


def test_reconcile_keeps_base_and_unites_windows():
    text = "call (736) 555-7857 4103973116826153 ok"
    base = [(2, 20, 36)]
    assert pii.reconcile(text, [(3, 5, 19), (3, 5, 15), (2, 18, 36)], base) == [(3, 5, 19)]


# Pages

def test_blocks():
    read = lambda s: [b.text for b in html_blocks.blocks(s)]
    assert read("") == [] and read("   ") == [] and read("plain") == ["plain"]
    assert read("<div><p>one<p>two <i>th</i>ree<br>four</div>tail") == ["one", "two three four", "tail"]
    assert read("a &amp;&nbsp; b &#233;") == ["a & b é"]
    assert read('<a title="x>y">l</a><!-- <p>no --><script>if(a<b)"</p>"</script>r') == ["lr"]
    assert read("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>") == ["a", "b", "1", "2"]
    assert read("3 < 4 <3 </ >") == ["3 < 4 <3"]
    assert read("<p>" * 20_000 + "x") == ["x"]


def test_crf_on_held_out_layouts(spark):
    pages = [r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").orderBy("page_id").collect()]
    model = html_crf.train_crf(html_crf.training_pages(pages[:120]))
    g, wrong, total = np.random.default_rng(77), 0, 0
    for page in pages[120:]:
        read = html_blocks.blocks(page)
        own = html_crf.own_labels(read)
        assert html_crf.decode(read, model) == own
        main = [b.text for b, y in zip(read, own) if y]
        built, labels = html_crf.layout(g, main, [b.text for b, y in zip(read, own) if not y])
        got = html_crf.decode(html_blocks.blocks(built), model)
        wrong, total = wrong + sum(a != b for a, b in zip(got, labels)), total + len(labels)
    assert wrong <= 0.02 * total


def test_crf_viterbi_is_best():
    import itertools
    g = np.random.default_rng(1)
    page = [html_blocks.Block(t, place, 0) for place in [html_blocks.blocks("<div>x")[0].place]
            for t in ("one.", "two", "three words here", "x")]
    model = {"w": g.normal(0, 1, html_crf.SIZE), "tr": g.normal(0, 1, (2, 2)), "first": g.normal(0, 1, 2)}
    e = [sum(model["w"][s] for s in slots) for slots in html_crf._slots(page)]
    value = lambda y: model["first"][y[0]] + sum(e[i] * y[i] for i in range(4)) + sum(model["tr"][a, b] for a, b in zip(y, y[1:]))
    assert tuple(html_crf.decode(page, model)) == max(itertools.product((0, 1), repeat=4), key=value)


def test_emissions_equal_the_sums_of_features(spark):
    g = np.random.default_rng(4)
    w = g.normal(0, 1, html_crf.SIZE).tolist()
    pages = [r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").orderBy("page_id").limit(20).collect()]
    tags = "div p b a ul li section table td h1 form custom-x".split()
    for _ in range(200):  # broken markup too
        pages.append("".join(g.choice([f"<{t} class='n{int(g.integers(0, 4))}'>", f"</{t}>", " word © ", "tail."])
                             for t in g.choice(tags, 40)))
    for page in pages:
        read = html_blocks.blocks(page)
        wanted = [sum(w[s] for s in slots) for slots in html_crf._slots(read)]
        assert np.allclose(html_crf.emissions(read, w), wanted)


@pytest.mark.parametrize("page", [
    "<article>" + "<div>" * 100_000 + "x", "<b><p>word " * 50_000, "".join(f"<x{i} class=c{i}>t" for i in range(50_000)) + "<p>end",
    "<li><ul>" + "<div>" * 30_000 + "<option>a</option>" * 30_000, "<p>word</p> " * 100_000, "<table>" + "<tr><td>w" * 50_000,
])
def test_pages_of_any_depth_and_length_take_linear_time(page):
    import time
    model = {"w": [0.1] * html_crf.SIZE, "tr": np.zeros((2, 2)), "first": np.zeros(2)}
    start = time.process_time()
    assert html_crf.main_text(page, model) == "\n".join(b.text for b in html_blocks.blocks(page))
    assert time.process_time() - start < 20


def test_deep_and_long_pages_do_not_train(spark):
    rows = [(1, "<article>" + "<i>" * 5_000 + "<p>x"), (2, "<article><p>" + "x" * html_crf.LONGEST)]
    assert html_crf.fit(spark.createDataFrame(rows, "page_id long, html string")) == {}


def test_extract_edges(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a b</p></article>", "k"), (2, None, None, "k"), (3, "u", "", "k"), (1, "u", "<nav>m</nav>", "k")],
                               "page_id long, url string, html string, text string")
    assert [r.text for r in html_crf.extract(df, {}).collect()] == ["", "", "", ""]
    model = html_crf.fit(spark.read.parquet(f"{SMALL}/pages.parquet"))
    rows = html_crf.extract(df, model).collect()
    assert [(r.text, r.n_chars) for r in rows] == [("a b", 3), ("", 0), ("", 0), ("", 0)]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_crf.fit(empty) == {} and html_crf.extract(empty, {}).collect() == []


def test_crf_fit_finds_rare_marked_pages(spark, monkeypatch):
    """The bound is one of marked pages: one such page among many others gives a model."""
    monkeypatch.setattr(html_crf, "SAMPLE", 1)
    rows = [(i, "<div><p>not marked</p></div>") for i in range(50)]
    rows += [(99, "<nav>m</nav><ARTICLE class=x><p>This is the text of the page.</p></ARTICLE>"), (100, None)]
    assert html_crf.fit(spark.createDataFrame(rows, "page_id long, html string"))


# Toxicity

def test_ordinal_regression_recovers_grades():
    g = np.random.default_rng(2)
    x = g.normal(0, 1, (4000, 3))
    score = x @ np.array([2.0, -1.0, 0.0]) + g.logistic(0, 1, 4000)
    y = np.digitize(score, [-1.0, 0.5, 2.0])
    w, t = toxicity.fit_ordinal(x, y, 4)
    assert np.allclose(w, [2, -1, 0], atol=0.25) and np.allclose(t, [-1, 0.5, 2], atol=0.25) and (np.diff(t) > 0).all()
    severity, p = toxicity.expected(x @ w, t)
    assert ((0 < severity) & (severity < 3)).all() and np.corrcoef(severity, y)[0, 1] > 0.7 and (p <= 1).all()


def test_toxicity_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 3 != 0"))
    rows = toxicity.score(docs.join(labels.filter("doc_id % 3 = 0").withColumnRenamed("toxic", "wanted"), "doc_id"), model).collect()
    said = [(r.toxic, bool(r.wanted)) for r in rows]
    assert sum(a == b for a, b in said) >= 0.97 * len(said)
    assert sum(a and b for a, b in said) >= 0.8 * sum(b for _, b in said)
    assert all(0 <= r.severity <= len(model["thresholds"]) for r in rows)


def test_toxicity_features_and_score_equal_brute_force(spark):
    """Evidence counted context by context, features counted word by word, severity from the definition."""
    texts = []
    g = np.random.default_rng(8)
    plain = [f"{a}{b}" for a in "bcdfg" for b in ("alo", "eni", "ort", "usk", "imp")]
    for i in range(400):
        words = list(g.choice(plain, 30))
        if i % 4 == 0:
            words = [x for w in words for x in (w, str(g.choice(["vile", "vilest", "grobian"])))][:50]
        texts.append((i, " ".join(words).title() + "!", int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(None, None), (900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    sample = {re.sub(r"[^a-z0-9]+", " ", t.lower()).strip(): y for _, t, y in texts}
    contexts = collections.defaultdict(lambda: 1)
    for t, y in sample.items():
        ws = t.split()
        for before, w in zip(["", *ws], ws):
            contexts[before, w] = min(contexts[before, w], y)
    n, k = collections.Counter(), collections.Counter()
    for (_, w), toxic in contexts.items():
        for f in [f" {w} ", *(f" {w[:p]}" for p in toxicity.PREFIXES if len(w) >= p)]:
            n[f] += 1
            k[f] += toxic
    N, K = len(contexts), sum(contexts.values())

    def ratio(f):
        def part(a, b, p):
            return (a * math.log(p) if a else 0) + ((b - a) * math.log(1 - p) if b > a else 0)
        p1, p2 = k[f] / n[f], (K - k[f]) / (N - n[f])
        both = part(k[f], n[f], K / N) + part(K - k[f], N - n[f], K / N)
        return 2 * (part(k[f], n[f], p1) + part(K - k[f], N - n[f], p2) - both) if p1 > p2 else 0.0

    strong = [f for f in n if k[f] > 3 and k[f] * N > 2 * n[f] * K and ratio(f) >= toxicity.LEAST_EVIDENCE]
    chosen = []
    for f in sorted(strong, key=lambda f: (-round(ratio(f), 6), f.endswith(" "), -len(f), f)):
        if not any(f.startswith(c) or c.startswith(f) for c in chosen):
            chosen.append(f)
    assert chosen and list(model["features"]) == chosen
    for r in toxicity.score(docs, model).collect():
        text = f" {re.sub(r'[^a-z0-9]+', ' ', (r.text or '').lower()).strip()} ".replace("  ", " ")
        z = 0.0
        for i, f in enumerate(chosen):
            c = sum(text.startswith(f, at) for at in range(len(text)))
            z += math.log1p(c) * model["weights"][i] + (c > 0) * model["weights"][len(chosen) + i]
        over = [1 / (1 + math.exp(-(z - t))) for t in model["thresholds"]]
        assert abs(r.severity - sum(over)) < 1e-9 and abs(r.p_toxic - over[0]) < 1e-9
        assert r.toxic == (r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 0)


def test_toxicity_sample_is_bounded_under_a_hot_id(spark, monkeypatch):
    """One labelled id on most rows brings one document, the same under any partitioning."""
    monkeypatch.setattr(toxicity, "SAMPLE", 10)
    seen = []
    monkeypatch.setattr(toxicity, "stored", lambda df, tag: seen.append(df.cache()) or seen[-1])
    rows = [(0, f"text {i}") for i in range(2900)] + [(i, f"other {i}") for i in range(1, 100)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(0, 1), (None, 1)], "doc_id long, toxic int")
    for parts in (1, 7):
        toxicity.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), labels.repartition(parts))
    assert seen[0].count() <= 10 and sorted(seen[0].collect()) == sorted(seen[1].collect())


def test_toxicity_long_text(spark):
    model = {"features": (" vile",), "weights": np.array([1.0, 1.0]), "thresholds": np.array([2.0])}
    docs = spark.createDataFrame([(1, "vile " * 400_000), (2, "a" * 2_000_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert rows[1].toxic and not rows[2].toxic


def test_hash_sample(spark):
    """The same rows under any partitioning, nulls without advantage, repeated rows once."""
    rows = [(None, f"n{i}") for i in range(1000)] + [(i, f"t{i}") for i in range(2000)] + [(7, "again")] * 1500
    df = spark.createDataFrame(rows, "k long, t string")
    first = hash_sample(df.repartition(3), 200).collect()
    assert first == hash_sample(df.repartition(11, "t"), 200).collect()
    assert 150 <= len(first) == len(set(first)) <= 200
    assert 0.2 * len(first) < sum(r.k is None for r in first) < 0.48 * len(first)
    assert len(hash_sample(df, 10_000).collect()) == 3001 and hash_sample(df.limit(0), 5).collect() == []


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "x", "c"), (None, "y", "d")], "doc_id long, text string, normal string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(rows) == 4 and not any(r.toxic for r in rows) and {r.normal for r in rows} == set("abcd")
    odd = spark.createDataFrame([(1, 1), (2, None), (None, 1), (9, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.train(docs, odd)["features"] == ()
    assert toxicity.score(docs.limit(0), toxicity.train(docs, none)).collect() == []


# Suffix tree

def tokens(text):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w] + [b""]


def test_suffix_tree_base_figures(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(300).collect()]
    rows += [(10_001, None), (10_002, ""), (10_003, " \t\n"), (None, "The null id"), (10_002, ""), (10_004, "ÉÀ x never-seen-word " * 3)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, uid int")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    out = suffix_tree.score(df).collect()
    assert sorted((repr(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in out)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Brute:
    """The suffix tree from its definition, by dictionaries over whole words."""

    def __init__(self, texts, least=suffix_tree.MIN_COUNT):
        docs = [tokens(t) for t in texts]
        self.words = collections.Counter(w for d in docs for w in d)
        self.n, once, twice = sum(self.words.values()), *(sum(c == k for c in self.words.values()) for k in (1, 2))
        self.discount = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)
        self.next = collections.defaultdict(collections.Counter)
        for d in docs:
            for i, w in enumerate(d):
                for k in range(1, min(i, suffix_tree.DEPTH) + 1):
                    self.next[tuple(d[i - k: i])][w] += 1
        self.kept = set()
        for context, after in self.next.items():
            total = sum(after.values())
            if total >= least:
                share = self.words if len(context) == 1 else self.next[context[1:]]
                whole = sum(share.values())
                q = lambda w: (share[w] - self.discount) / self.n if len(context) == 1 else share[w] / whole  # noqa: B023, E731
                if sum(n * math.log(n / total / q(w)) for w, n in after.items()) > 0.5 * len(after) * math.log(total):
                    self.kept.add(context)

    def p(self, context, w):
        while context and context not in self.kept:
            context = context[1:]
        if not context:
            return ((self.words[w] - self.discount if self.words[w] else self.discount * len(self.words)) / self.n) if self.n else 1.0
        after = self.next[context]
        return (after[w] + len(after) * self.p(context[1:], w)) / (sum(after.values()) + len(after))

    def score(self, text):
        d = tokens(text)
        return sum(math.log10(self.p(tuple(d[max(i - suffix_tree.DEPTH, 0): i]), w)) for i, w in enumerate(d))


def phrases():
    g = np.random.default_rng(9)
    rows = [(i, " ".join(f"a{k % 750} b{k % 500} c{k} z{g.integers(0, 3000)}" for k in g.integers(0, 1500, 25))) for i in range(2400)]
    return rows + [(2400, None), (2401, ""), (None, "a1 b1 c1"), (None, "a1 b1 c1"), (5, "b7 " * 5000), (7, rows[7][1]), (2402, "a1 never b1 " * 40)]


def test_suffix_tree_is_a_distribution_and_learns_contexts(spark):
    g = np.random.default_rng(4)
    text = lambda: " ".join("a b c a c b".split() if g.random() < 0.5 else "d e f d".split())
    rows = [(i, " ".join(text() for _ in range(20))) for i in range(200)]
    tree = Brute([t for i, t in rows if not held(i)])
    assert len(tree.kept) > 3
    for context in [(), *tree.kept]:
        seen = sum(tree.p(context, w) for w in tree.words)
        assert abs(seen + tree.p(context, b"never") - 1) < 1e-9
    out = suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (out[out.held_out].score > out[out.held_out].base_score).all()


def test_suffix_tree_rare_words_join(spark, monkeypatch):
    """With hardly any word sent along, the joined counts give the same scores."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet").limit(120).select("doc_id", "text")
    whole = {r.id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in suffix_tree.score(df).collect()}
    monkeypatch.setattr(suffix_tree, "FREQUENT", 200)
    assert {r.id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in suffix_tree.score(df).collect()} == whole


def test_suffix_tree_stores_what_scoring_reads(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(suffix_tree, "MIN_COUNT", 4)
    docs = spark.createDataFrame([(i, " ".join(["a b c d e f", "b c d e g"][i % 2].split()[: 3 + i % 4])) for i in range(200)], "doc_id long, text string")
    monkeypatch.setattr(suffix_tree.common, "shared_dir", lambda _: str(tmp_path))
    scored = suffix_tree.score(docs)
    left = collections.defaultdict(list)
    for path in tmp_path.iterdir():
        left[path.name.split("-")[0]].append(spark.read.parquet(str(path)))
    assert {tag: len(x) for tag, x in left.items()} == {"rare": 1, "pairs": suffix_tree.DEPTH, "back": suffix_tree.DEPTH}
    assert all(x.columns == ["b", "w", "n"] for x in left["pairs"])
    assert all(x.isEmpty() for x in left["back"])  # all kept contexts are sent along
    assert scored.count() == 200


def test_suffix_tree_empty(spark):
    assert suffix_tree.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = suffix_tree.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)


@pytest.mark.parametrize("sent", ["all", "none", "some"])
def test_suffix_tree_equals_its_definition(spark, monkeypatch, sent):
    """Contexts far below a thousandth of the tokens count, also with little or nothing settled in place."""
    rows = phrases()
    tree = Brute([t for i, t in rows if not held(i)])
    assert max(tree.words.values()) < 1e-1 * tree.n
    assert all(sum(len(c) == k for c in tree.kept) > 500 for k in (1, 2))
    if sent != "all":
        for name, some in (("FREQUENT", 500), ("FREQUENT_PAIRS", 1000), ("FREQUENT_CONTEXTS", 800), ("HELD_TOKENS", 20_000), ("HELD_OPEN", 5000),
                           ("BUCKET_TOKENS", 1000), ("PIECE", 30_000), ("MAP_BITS", (16, 16))):
            monkeypatch.setattr(suffix_tree, name, 0 if sent == "none" and name.startswith("FREQ") else some)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, uid int").repartition(5)
    got = sorted((repr(r.id), round(r.score, 5)) for r in suffix_tree.score(df).collect())
    want = sorted((repr(i), round(tree.score(t), 5)) for i, t in rows)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert all(abs(a[1] - b[1]) < 1e-4 for a, b in zip(got, want))
