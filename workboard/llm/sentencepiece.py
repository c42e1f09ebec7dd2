"""SentencePiece encoding and decoding with the ``tokenizers`` library.

The model file is a protobuf; a small reader takes pieces, scores and flags from
it. From these the tokenizer is rebuilt: the normaliser (a precompiled character
map where the model has one, white-space rules), the metaspace marker, the
unigram scores (or, for a BPE model, the merges in order of score), byte
fallback and the decoder. Batches are encoded by the library's threads. Before
a task encodes anything it checks, on fixed probe texts, that ids and decoded
texts equal those of the reference library.

Where no piece has the marker after another character, no piece crosses into a
new word. Normalised texts are then cut before each run of markers, each distinct
word of a batch is encoded once (a task keeps up to MEMO_CHARS characters of
words, and lets go of them when it ends), and the ids of the texts are put together from those of the words. Other
models (and those with user-defined pieces or without byte fallback) encode whole
texts. Decoding always runs over the whole ids.

Defined results: a null text is empty; an empty text has no ids and decodes to
the empty text; extra columns pass through.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabulary files are; the model is a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Threads of one task's batch encoding.
THREADS = 2
MEMO_CHARS = 2_000_000
#: Rows and bytes of text that are encoded together; a longer text is a part of its own.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20
MARK = "▁"
# Kinds of pieces in the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
PROBES = ("", " ", "a", "Hello world", "  two  spaces ", "line\nbreak\ttab", "Été üßñ",
          "日本語 \U0001F600‍", "▁ marker▁", "<s> </s> <unk> <0x41>", "x" * 300,
          "1234567 ... !!!", "a\u0000b", " nbsp　wide", "é combining")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes):
    """``(number, value)`` of a protobuf message; nested messages stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at: at + size], at + size
        elif kind == 5:
            value, at = struct.unpack("<f", data[at: at + 4])[0], at + 4
        elif kind == 1:
            value, at = struct.unpack("<d", data[at: at + 8])[0], at + 8
        else:
            raise ValueError(f"wire type {kind} in a SentencePiece model")
        yield key >> 3, value


def read_model(data: bytes) -> dict:
    """Pieces ``(text, score, kind)`` and the flags that encoding needs."""
    pieces, trainer, normal = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normal = dict(fields(value))
    return {"pieces": pieces, "unigram": trainer.get(3, 1) == 1, "bpe": trainer.get(3, 1) == 2,
            "byte_fallback": bool(trainer.get(35, 0)), "suffix_marker": bool(trainer.get(24, 0)),
            "charsmap": normal.get(2, b""), "dummy_prefix": bool(normal.get(3, 1)),
            "squeeze": bool(normal.get(4, 1)), "escape": bool(normal.get(5, 1))}


def _no_piece_crosses(pieces) -> bool:
    return not any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind in (NORMAL, USER))


def build(data: bytes):
    """A ``tokenizers.Tokenizer`` that encodes and decodes like the model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = read_model(data)
    if not (m["unigram"] or m["bpe"]) or m["suffix_marker"] or not m["escape"]:
        raise ValueError("only unigram and BPE models with a leading white-space marker")
    pieces = m["pieces"]
    unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    if m["unigram"]:
        # Controls never match a text: no text holds their score's candidates.
        model = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=unk, byte_fallback=m["byte_fallback"])
    else:
        ids = {p: i for i, (p, _, _) in enumerate(pieces)}
        real = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
        merges = sorted(((-real[a + b], ids[a + b], a, b) for p in real for k in range(1, len(p))
                         for a, b in [(p[:k], p[k:])] if a in real and b in real), key=lambda x: x[:2])
        model = models.BPE(ids, [(a, b) for _, _, a, b in merges], unk_token=pieces[unk][0], fuse_unk=True,
                           byte_fallback=m["byte_fallback"])
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
    if m["squeeze"]:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps.append(normalizers.Replace(" ", MARK))
    if m["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    tok.normalizer = normalizers.Sequence(steps)
    if _no_piece_crosses(pieces):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tok.add_tokens([AddedToken(p, normalized=True, special=False) for p, _, kind in pieces if kind == USER])
    out = [decoders.Replace(MARK, " ")]
    if m["byte_fallback"]:
        out.append(decoders.ByteFallback())
    out.append(decoders.Fuse())
    if m["dummy_prefix"]:
        out.append(decoders.Strip(" ", 1, 0))
    tok.decoder = decoders.Sequence(out)
    return tok


def _load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def check_parity(tok, data: bytes, texts) -> None:
    """Raise if ids or decoded texts differ from those of the reference library."""
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in texts:
        ids = tok.encode(text, add_special_tokens=False).ids
        want = other.encode(text)
        if ids != want or tok.decode(ids, skip_special_tokens=False) != other.decode(want):
            raise ValueError(f"the rebuilt tokenizer differs on {text[:80]!r}")


@functools.lru_cache(maxsize=2)
def tokenizer(data: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    tok = build(data)
    check_parity(tok, data, PROBES)
    return tok


class Encoder:
    """Ids of batches of texts."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer, normalizers

        self.tok = tokenizer(data)
        m = read_model(data)
        self.by_word = (m["byte_fallback"] and _no_piece_crosses(m["pieces"])
                        and not any(kind == USER for _, _, kind in m["pieces"]))
        self.plain = m["dummy_prefix"] and not m["charsmap"] and not m["squeeze"]
        self.words = Tokenizer.from_str(self.tok.to_str())
        self.words.normalizer = normalizers.Sequence([])
        self._forget()

    def _forget(self):
        self.at, self.chars = {}, 0
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        # What the library's threads and Arrow have freed goes back to the system.
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    def _normalise(self, text: str) -> str:
        if self.plain:
            return MARK + text.replace(" ", MARK) if text else ""
        return self.tok.normalizer.normalize_str(text) if text else ""

    def _learn(self, words: list[str]):
        found = [e.ids for e in self.words.encode_batch_fast(words, add_special_tokens=False)]
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.chars += sum(map(len, words))
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.int32)])
        ends = self.starts[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        self.starts = np.concatenate([self.starts, ends])

    def __call__(self, texts: list[str]) -> pa.Array:
        """A list array of int32."""
        if not self.by_word:
            return pa.array([e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)],
                            pa.list_(pa.int32()))
        if self.chars > MEMO_CHARS:
            self._forget()
        words = [_WORD.findall(self._normalise(t)) for t in texts]
        every = list(itertools.chain.from_iterable(words))
        if new := list(set(every).difference(self.at)):
            self._learn(new)
        spot = np.fromiter(map(self.at.__getitem__, every), np.int64, len(every))
        first, size = self.starts[spot], self.starts[spot + 1] - self.starts[spot]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])]
        ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), pa.array(ids, pa.int32()))


@functools.lru_cache(maxsize=1)
def _kept_encoder(data: bytes) -> Encoder:
    return Encoder(data)  # a worker's later tasks find the tokenizers, not the words


def _slices(batch: pa.RecordBatch, at: int):
    """Parts of at most SLICE_ROWS rows and about SLICE_BYTES of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    first = held = 0
    for k, size in enumerate(sizes):
        if k > first and (k - first == SLICE_ROWS or held + size > SLICE_BYTES):
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def _encoder(data: bytes, at: int):
    def encode(batches):
        encoder = _kept_encoder(data)
        try:
            for batch in batches:
                for part in _slices(batch, at):
                    ids = encoder([x or "" for x in part.column(at).to_pylist()])
                    flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
                    back = encoder.tok.decode_batch([flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])],
                                                    skip_special_tokens=False)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, ids, pa.array(np.diff(ends).astype(np.int64)),
                         pa.array(back, pa.string())],
                        names=[*batch.schema.names, "input_ids", "n_tokens", "decoded"])
        finally:
            encoder._forget()  # the worker lives on, also through other stages

    return encode


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """All rows and columns of ``docs`` with ``input_ids``, ``n_tokens`` and ``decoded``.

    Input columns of these names are replaced. The model goes to the tasks with
    the code (its size is that of one vocabulary file).
    """
    rows = docs.drop("input_ids", "n_tokens", "decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("input_ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(_encoder(_load(model), rows.columns.index(text_col)), schema)
