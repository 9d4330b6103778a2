"""SentencePiece encoding and decoding with the tokenizers library.

The model file's protobuf is parsed here; the normaliser (its character map,
extra spaces, dummy prefix), the space marker, the scores (Unigram) or the
merges that they imply (BPE), and byte fallback are rebuilt as a ``Tokenizer``,
which encodes batches on several threads. ``parity`` compares its ids with
those of the sentencepiece library.

A word's pieces are found apart from its neighbours' where no piece of the
model reaches over a marker, which leaves the ids as they are and lets the
library remember words.

Defined results: null and empty texts have no ids and decode to the empty
text. Repeated rows and ids are each encoded; a null id returns a row. Extra
columns are ignored; an empty table returns no rows. Texts of any length are
encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, read_table, steps, to_batch

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = buf[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0
    while at < len(buf):
        tag, at = _varint(buf, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(buf, at)
        elif kind == 1:
            value, at = buf[at : at + 8], at + 8
        elif kind == 2:
            n, at = _varint(buf, at)
            value, at = buf[at : at + n], at + n
        elif kind == 5:
            value, at = buf[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    bpe: bool = False
    byte_fallback: bool = False
    suffix: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    m.bpe = v == 2
                elif n == 24:
                    m.suffix = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    m.char_map = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.trim_spaces = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    return m


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All splits of each piece in two pieces, best score first."""
    usable = {p for p, _, kind in pieces if kind in (NORMAL, USER)}
    ranked = sorted((k for k in range(len(pieces)) if pieces[k][2] == NORMAL and len(pieces[k][0]) > 1), key=lambda k: (-pieces[k][1], k))
    return [(p[:i], p[i:]) for p in (pieces[k][0] for k in ranked) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]


def rebuild(m: Model):
    """The model as a ``tokenizers.Tokenizer``."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.suffix or not m.escape:
        raise ValueError("markers behind words, or none, aren't supported")
    unk = next((k for k, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
    if m.bpe:
        vocab = {p: k for k, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab, merges(m.pieces), unk_token=None if unk is None else m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk, m.byte_fallback)
    t = Tokenizer(model)
    chain = [normalizers.Precompiled(m.char_map)] if m.char_map else []
    if m.trim_spaces:
        chain += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    chain += [normalizers.Prepend(MARK)] if m.dummy_prefix else []
    t.normalizer = normalizers.Sequence([*chain, normalizers.Replace(" ", MARK)])
    apart = re.compile(f"{MARK}*[^{MARK}]*")
    if all(apart.fullmatch(p) for p, _, kind in m.pieces if kind in (NORMAL, USER)):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return t


class Codec:
    """Encoder and decoder of a model file.

    Texts without two spaces in a row, a space at the start or a marker of
    their own take the library's built-in marker splitting, which is faster and
    gives the same ids; the others take the rebuilt normaliser.
    """

    def __init__(self, path: str):
        from tokenizers import normalizers, pre_tokenizers

        with open(path, "rb") as f:
            m = parse(f.read())
        self.whole, self.simple = rebuild(m), None
        if self.whole.pre_tokenizer is not None and m.dummy_prefix and not m.char_map:
            self.simple = rebuild(m)
            self.simple.normalizer = normalizers.Sequence([])
            self.simple.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        easy = [self.simple is not None and x[:1] not in ("", " ") and x[-1] != " " and "  " not in x and MARK not in x for x in texts]
        out: list[list[int]] = [[]] * len(texts)
        for tokenizer, kind in ((self.simple, True), (self.whole, False)):
            own = [k for k, e in enumerate(easy) if e == kind]
            if own:
                for k, e in zip(own, tokenizer.encode_batch_fast([texts[k] for k in own], add_special_tokens=False), strict=True):
                    out[k] = e.ids
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


#: Threads of a worker's encoder; more contend for its memory of words.
THREADS = 2
_codecs: dict[str, Codec] = {}


def load(path: str) -> Codec:
    """The codec of a model file, built once in a process."""
    if path not in _codecs:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        _codecs[path] = Codec(path)
    return _codecs[path]


def parity(path: str, texts: list[str]) -> list[int]:
    """Positions of ``texts`` whose ids differ from the sentencepiece library's."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)
    return [k for k, (a, b) in enumerate(zip(load(path).encode(texts), theirs, strict=True)) if a != b]


_OUT = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, ids of each row."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for lo, hi in steps(texts):
                part = texts[lo:hi]
                yield to_batch(_OUT, [b.column(0).slice(lo, hi - lo), list(map(len, part)), t.encode(part)])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, n_chars long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """id, text of rows with id, ids."""
    path = path or default_model()
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for b in batches:
            yield to_batch(schema, [b.column(0), t.decode([x or [] for x in b.column(1).to_pylist()])])

    return map_arrow(ids.select("id", "ids"), run, "id long, text string")


_CHECKED = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])


def op5(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), round_trip (decoding gives the text again)."""
    path = default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for lo, hi in steps(texts):
                part = texts[lo:hi]
                ids = t.encode(part)
                back = t.decode(ids)
                yield to_batch(_CHECKED, [b.column(0).slice(lo, hi - lo), list(map(len, ids)), [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids], [x == y for x, y in zip(part, back, strict=True)]])

    return map_arrow(read_table(spark, sf_dir, "documents").select("doc_id", "text"), run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
