"""Packing documents into sequences, best fit decreasing.

A document's ids (with a closing id) are cut into full windows, which are
sequences of their own, and a rest. Each task packs its rests in blocks of
BLOCK: longest first, each into the open window with the least room that
suffices, found in a segment tree indexed by remaining capacity. The few
windows that stay poorly filled at the end of a block are joined and cut
anew, the last of them into lengths that are powers of two and need no padding.
No shuffle: a task's rests are many, and it holds only one block of them.

Ids are those of the ``tokenizers`` library for the given file. Texts of
common scripts without very long words go through ``tiktoken`` with ranks read
from the same file, which gives the same ids several times faster; all others,
and texts that spell a special token, go through ``tokenizers``.

Defined results: a null or empty text is the closing id alone. Repeated rows
and ids are packed once each; a null id returns pieces too. Extra columns are
ignored. An empty table returns no rows. Very long texts are many windows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, read_table, to_batch

WINDOW = 1024
END = 0
BLOCK = 1 << 15
#: Room from which a window counts as poorly filled at the end of a block.
POOR = 17
_SCHEMA = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """The ids that a byte-level BPE file of the tokenizers library gives."""

    #: Text in which both libraries split words alike: no unusual scripts or spaces.
    plain = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e¡-ɏ‐-―‘-‟…€]")
    #: Words of more characters go to tokenizers.
    longest = 400

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast, self.special = None, []
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        usual = spec["model"].get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not spec["model"].get("dropout")
        if usual:
            self.fast = self._ranks(spec)

    def _ranks(self, spec: dict):
        import public_tokenizers
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        vocab = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][a + b] for a, b in merges]
        if ids != sorted(ids):  # then a merge's rank isn't its id
            return None
        return tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        fast = self.fast is not None and not self.plain.search(text) and not any(t in text for t in self.special) and max(map(len, text.split()), default=0) <= self.longest
        ids = self.fast.encode_ordinary(text) if fast else self.slow.encode(text, add_special_tokens=False).ids
        return np.array([*ids, END], np.dtype("<u4"))


class Room:
    """Open windows by remaining capacity, in a segment tree of counts."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.size
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window with the least room of ``need`` or more, and its room."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        window = self.open[room].pop()
        while i:
            self.tree[i] -= 1
            i >>= 1
        return window, room


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Positions of ``lengths`` by window, best fit decreasing. All are at most ``window``."""
    room, out = Room(window), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        found = room.take(n)
        if found is None:
            out.append([k])
            room.add(window - n, len(out) - 1)
        else:
            out[found[0]].append(k)
            room.add(found[1] - n, found[0])
    return out


def _cuts(total: int, window: int) -> list[int]:
    """Lengths of sequences for ``total`` ids: full windows, then powers of two."""
    out = [window] * (total // window)
    rest = total % window
    return out + [1 << b for b in reversed(range(window.bit_length())) if rest >> b & 1]


def _block(rests: list[tuple], window: int) -> Iterator[list[tuple]]:
    """Sequences, each a list of (id, start, ids, doc_tokens)."""
    bins = best_fit([len(r[2]) for r in rests], window)
    poor = []
    for b in bins:
        n = sum(len(rests[k][2]) for k in b)
        if window - n >= POOR and n & (n - 1):
            poor += b
        else:
            yield [rests[k] for k in b]
    todo = [rests[k] for k in poor]
    at = used = 0
    for size in _cuts(sum(len(r[2]) for r in todo), window):
        sequence = []
        while size:
            doc, start, ids, n = todo[at]
            part = ids[used : used + size]
            sequence.append((doc, start + used, part, n))
            size -= len(part)
            used += len(part)
            if used == len(ids):
                at, used = at + 1, 0
        yield sequence


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, next_id = Ids(path), TaskContext.get().partitionId() << 33
        rests: list[tuple] = []
        rows: list[tuple] = []

        def put(sequence: list[tuple]) -> None:
            nonlocal next_id
            offset = 0
            for doc, start, ids, n in sequence:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, next_id, offset))
                offset += len(ids)
            next_id += 1

        def out() -> pa.RecordBatch:
            batch = to_batch(_SCHEMA, list(zip(*rows, strict=True)))
            rows.clear()
            return batch

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "")
                full = len(ids) // window * window
                for at in range(0, full, window):
                    put([(doc, at, ids[at : at + window], len(ids))])
                if full < len(ids):
                    rests.append((doc, full, ids[full:].copy(), len(ids)))
                if len(rests) >= BLOCK:
                    for sequence in _block(rests, window):
                        put(sequence)
                    rests.clear()
                if len(rows) >= 20_000:
                    yield out()
        for sequence in _block(rests, window):
            put(sequence)
        if rows:
            yield out()

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, _DDL)


def op8(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
