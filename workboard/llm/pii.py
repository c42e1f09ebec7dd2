"""Personal data in text: patterns plus a character BiLSTM-CRF.

Patterns find the base spans (email, ip, card, phone). A character-level
bidirectional LSTM with CRF transitions (:mod:`bilstm_crf`) is trained on
labelled spans and adds what the patterns do not write down, such as other
separators or a phone number without its plus sign. Base spans always stay; a
model span that overlaps one is dropped.

Labels: base spans of at most SAMPLE documents that hold a digit or an "@" (those with
the smallest hash of id and pieces; a documented bound), in up to PIECES short pieces
each; the first WINDOWS windows around them train (both bounds concern the fit alone).
Part of the training windows hold a variant of the span in another common notation, or
a harmless number (date, version, amount, code) in its place.

The whole text is cut into windows of WIDTH characters that overlap by half.
Every accepted span holds a digit or an "@", so windows with neither are passed
over; that loses nothing. Spans of all windows of a document are reconciled
together: those of one kind that overlap are united, and of overlapping kinds the
one that more windows found stays (then the longer, then the first). A model span
must look like its kind: see :func:`plausible`.

Defined results: a null text is empty; positions are code points, end exclusive;
rows without spans have the digest of the empty string. Without any base span to
learn from, the model adds nothing. Repeated rows stay, each with its result, and train
once; null ids train like others. A very long text is one row's work, linear in its
length. Extra columns pass through; input columns named like results give way to them.
"""

from __future__ import annotations

import hashlib
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.llm import bilstm_crf
from workboard.llm.common import free_name, hash_sample

KINDS = ("email", "ip", "card", "phone")
WIDTH, STEP = 64, 32
SAMPLE = 6_000
PIECES = 4
WINDOWS = 6_000
RESULT = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried once, from its start: a later start fails alike.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_RUN = re.compile(r"[0-9@][0-9 ().+-]*")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in text.split("."))


def base_spans(text: str) -> list[Span]:
    """The contract's patterns, leftmost and non-overlapping per kind; time is linear in the text."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, first, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    out += [(1, *m.span()) for m in _IP.finditer(text) if _octets(m.group())]
    for kind, pattern in ((2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            digits = "".join(_DIGITS.findall(m.group()))
            if (16 <= len(digits) <= 19 and luhn(digits)) if kind == 2 else 8 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out


def plausible(kind: int, text: str) -> bool:
    """What a model span must hold, besides being found."""
    digits = _DIGITS.findall(text)
    if kind == 0:
        left, _, right = text.partition("@")
        return bool(left) and "." in right.strip(".") and not re.search(r"[\s@]", left + right)
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and _octets(".".join(parts)) and not re.search(r"[^0-9.\s\[\]]", text)
    if re.search(r"[^0-9 ().+/_-]", text):
        return False
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn("".join(digits))
    return 8 <= len(digits) <= 15 and bool(re.search(r"[0-9][ ).-]+[0-9]", text))


# Training windows.

def _labels(spans: list[Span], at: int, width: int) -> np.ndarray:
    """Label per character: 0 outside, 1 + 2 * kind at a span's start, 2 + 2 * kind inside."""
    out = np.zeros(width, np.int64)
    for kind, a, b in spans:
        a, b = a - at, b - at
        if a < width and b > 0:
            out[max(a, 0): min(b, width)] = 2 + 2 * kind
            if 0 <= a:
                out[a] = 1 + 2 * kind
    return out


def _digit_run(g, n: int) -> str:
    return "".join(map(str, g.integers(0, 10, n)))


def _card_digits(g) -> str:
    first = "4" + _digit_run(g, 14)
    return next(first + str(d) for d in range(10) if luhn(first + str(d)))


def _variant(g, kind: int) -> str:
    """A value of ``kind`` in some common notation."""
    a, b, c = _digit_run(g, 3), _digit_run(g, 3), _digit_run(g, 4)
    if kind == 3:
        return str(g.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"+1-{a}-{b}-{c}",
                             f"00{a[:2]} {b} {c} {a}", f"+{a[:2]} {b} {c}", f"+1 ({a}) {b}-{c}"]))
    if kind == 2:
        d = _card_digits(g)
        return str(g.choice([d, *(s.join(d[i: i + 4] for i in range(0, 16, 4)) for s in " -._")]))
    if kind == 1:
        return ".".join(str(g.integers(1, 255)) for _ in range(4))
    word = "".join(g.choice(list("abcdefghiklmnoprstu"), int(g.integers(3, 9))))
    return f"{word}{g.choice(['', '.', '_', '+', '-'])}{_digit_run(g, int(g.integers(0, 3)))}@{word[::-1]}.{g.choice(['com', 'org', 'co.uk', 'net'])}"


def _harmless(g) -> str:
    n = int(g.integers(1, 9))
    return str(g.choice([_digit_run(g, n), f"{_digit_run(g, 4)}-0{1 + n}-1{n}", f"1{n % 3}:{_digit_run(g, 2)}", f"{n}.{n + 1}.{n}", f"{n},{_digit_run(g, 3)}.{_digit_run(g, 2)}",
                         f"#{_digit_run(g, 6)}", f"{hashlib.md5(bytes([n])).hexdigest()[:12 + 2 * n]}", f"{_digit_run(g, n)} {_digit_run(g, 3)}"]))


def training_windows(texts: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of windows around digits and "@", a third each as found, varied and made harmless.

    Half of the varied ones are followed by a second value, which patterns that
    take in spaces cannot tell apart.
    """
    g = np.random.default_rng(seed)
    codes, labels = [], []
    for text in texts:
        spans = base_spans(text)
        spots = [m.start() for m in re.finditer(r"[0-9@]+", text)]
        for spot in spots[:PIECES]:
            if len(codes) >= WINDOWS:
                break
            own = next((s for s in spans if s[1] <= spot < s[2]), None)
            if own is None and len(_DIGITS.findall(_RUN.match(text, spot).group())) >= 8:
                continue  # may be data that the patterns dropped: no label is better than a wrong one
            piece, marks = text, spans
            if own is not None and (way := int(g.integers(0, 3))):
                parts = [(None, _harmless(g))] if way == 2 else [(own[0], _variant(g, own[0]))]
                if way == 1 and g.random() < 0.5:  # two values side by side
                    kind = int(g.integers(0, len(KINDS)))
                    parts += [(None, " "), (kind, _variant(g, kind))]
                new = "".join(x for _, x in parts)
                shift = len(new) - (own[2] - own[1])
                piece = text[: own[1]] + new + text[own[2]:]
                marks = [(k, a + shift * (a >= own[2]), b + shift * (a >= own[2])) for k, a, b in spans
                         if not (a < own[2] and b > own[1])]
                spot = own[1]
                for kind, x in parts:
                    marks += [] if kind is None else [(kind, spot, spot + len(x))]
                    spot += len(x)
            at = max(0, (own[1] if own else spot) - int(g.integers(0, WIDTH - 24)))
            codes.append(bilstm_crf.char_codes(piece[at: at + WIDTH], WIDTH))
            labels.append(_labels(marks, at, WIDTH))
    return np.array(codes).reshape(-1, WIDTH), np.array(labels).reshape(-1, WIDTH)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The trained network, from pieces of at most SAMPLE documents."""
    text = F.col(text_col)
    near = F.concat_ws("\n", F.slice(F.regexp_extract_all(text, F.lit(r"[^\n]{0,60}[0-9@][^\n]{0,100}"), F.lit(0)), 1, PIECES))
    rows = hash_sample(docs.filter(text.rlike("[0-9@]")).select(F.col(id_col).alias("i"), near.alias("t")), SAMPLE).collect()
    codes, labels = training_windows([r.t for r in rows])
    if not len(codes) or not labels.any():
        return None
    return bilstm_crf.train(codes, labels, 1 + 2 * len(KINDS))


# Finding.

def _tagged(labels: np.ndarray) -> list[Span]:
    out, kind, first = [], None, 0
    for i, tag in enumerate([*labels.tolist(), 0]):
        own = None if tag == 0 else (tag - 1) // 2
        if kind is not None and (own != kind or tag % 2):
            out.append((kind, first, i))
            kind = None
        if own is not None and kind is None:
            kind, first = own, i
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the windows (multiples of STEP) that hold a digit or an "@"."""
    found: set[int] = set()
    for m in re.finditer(r"[0-9@]+", text):
        found.update(range(max(0, (m.start() - WIDTH) // STEP + 1), (m.end() - 1) // STEP + 1))
    return [k * STEP for k in sorted(found)]


def reconcile(text: str, found: list[Span], base: list[Span]) -> list[Span]:
    """The model spans of a document, out of those of all its windows."""
    united: list[list[int]] = []  # kind, start, end, windows
    for kind, a, b in sorted(found):
        if united and united[-1][0] == kind and a < united[-1][2]:
            united[-1][2] = max(united[-1][2], b)
            united[-1][3] += 1
        else:
            united.append([kind, a, b, 1])
    taken = [(a, b) for _, a, b in base]
    out = []
    for kind, a, b, _ in sorted(united, key=lambda x: (-x[3], x[1] - x[2], x[1], x[0])):
        while a < b and text[a] in " .,;:-\n\t":
            a += 1
        while a < b and text[b - 1] in " .,;:-(\n\t":
            b -= 1
        if a < b and plausible(kind, text[a:b]) and all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b))
    return out


def find_spans(texts: list[str], model: dict | None) -> list[tuple[list[Span], list[Span]]]:
    """Per text its base spans and the spans that the model adds."""
    base = [base_spans(t) for t in texts]
    found: list[list[Span]] = [[] for _ in texts]
    if model is not None:
        todo = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
        for at in range(0, len(todo), 1024):
            part = todo[at: at + 1024]
            codes = np.stack([bilstm_crf.char_codes(texts[i][s: s + WIDTH], WIDTH) for i, s in part])
            tags = bilstm_crf.decode(model, codes)
            for (i, s), row in zip(part, tags):
                if row.any():
                    n = min(WIDTH, len(texts[i]) - s)
                    found[i] += [(k, a + s, b + s) for k, a, b in _tagged(row[:n])]
    return [(b, reconcile(t, f, b) if f else []) for t, f, b in zip(texts, found, base)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _finder(model: bytes, at: int):
    def find(batches):
        network = pickle.loads(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                spans = find_spans([x or "" for x in part.column(at).to_pylist()], network)
                own = [c for i, c in enumerate(part.columns) if i != at]
                counts = [pa.array([sum(s[0] == kind for s in b) for b, _ in spans], pa.int64()) for kind in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [*own, *counts, pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in spans]),
                     pa.array([written(b + m) for b, m in spans]), pa.array([len(m) for _, m in spans], pa.int64())],
                    names=[*[c for i, c in enumerate(batch.schema.names) if i != at], *RESULT])

    return find


def find(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the columns :data:`RESULT`."""
    text = F.col(text_col)
    # Texts that can hold no span do not go to Python.
    extra = free_name(docs, "searched")
    rows = docs.drop(*RESULT).withColumn(extra, F.when(text.rlike("[0-9@]"), text))
    long, string = T.LongType(), T.StringType()
    kinds = [long, long, long, long, string, string, long]
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != extra],
                           *[T.StructField(n, k) for n, k in zip(RESULT, kinds)]])
    return rows.mapInArrow(_finder(pickle.dumps(model), rows.columns.index(extra)), schema)
