"""Line deduplication by pairwise alignment.

1. Each document becomes the sequence of its lines' hashes (white space at a
   line's end aside), with the words of each line.
2. From each line on, and up to each line, the fewest lines in a row that have
   BLOCK_WORDS are a window: a long line alone, or short lines together. Every
   line of a block that is long enough is in a window within the block. A
   window that several documents hold is a link: each later document is paired
   with the first document that holds it. However frequent a window is, it gives
   one pair for each later holder, so none is dropped for being common and pairs
   stay in proportion to lines. In scripts without spaces two characters
   count as a word.
3. A pair's sequences are aligned with patience diff: lines that are unique in
   both anchor the alignment, gaps are aligned in turn, and matches grow over
   equal neighbours. Blocks of BLOCK_WORDS or more in aligned common lines are
   deleted from the later document; so are moved blocks, windows that both have
   but in another order, which the alignment leaves.

Pairing with first holders loses nothing against pairing all: a block that is
shared with any earlier document consists of windows, and each window is in the
first document that holds it, where alignment or the search for moved blocks
finds it. So the lines deleted are those of all runs of BLOCK_WORDS or more
that any earlier document has.

Documents are ordered by id, then by a hash of the text; a null id comes last.
Rows with the same id and text are one document: they are not compared with
each other and lose the same lines. Lines that repeat only within a document stay.

Defined results: a null text has no lines and stays null. Empty texts stay. An
empty table returns no rows. All columns of the input are kept; the operator's
own columns are joined under names that the input doesn't have.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_arrow, read_table, spread_join, to_batch, written

BLOCK_WORDS = 5
_LAST = (1 << 63) - 1
_SIG = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("lines", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("links", pa.list_(pa.int64()))])
_SIG_DDL = "id long, th long, lines array<long>, words array<int>, links array<long>"
#: Thai to Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def n_words(line: str) -> int:
    """Words of a line; two characters of a script without spaces are one."""
    if line.isascii() or not (n := len(_UNSPACED.findall(line))):
        return len(line.split())
    return len(_UNSPACED.sub(" ", line).split()) + (n + 1) // 2


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Hash and words of each line of ``text``."""
    lines = text.split("\n")
    digest = xxhash.xxh64_intdigest
    return [_signed(digest(x.rstrip().encode("utf-8", "surrogatepass"), 7)) for x in lines], [n_words(x) for x in lines]


def windows(words: list[int], least: int) -> set[tuple[int, int]]:
    """Ranges of lines with ``least`` words: the shortest from each line, and the shortest up to each line."""
    out, hi, held = set(), 0, 0
    for lo in range(len(words)):
        while hi < len(words) and held < least:
            held += words[hi]
            hi += 1
        if held < least:
            break
        out.add((lo, hi))
        held -= words[lo]
    lo = held = 0
    for hi in range(len(words)):
        held += words[hi]
        while held - words[lo] >= least:
            held -= words[lo]
            lo += 1
        if held >= least:
            out.add((lo, hi + 1))
    return out


def _sums(lines: list[int]) -> list[int]:
    """Rolling hash of each beginning."""
    out = [0]
    for x in lines:
        out.append((out[-1] * _BASE + x) % _PRIME)
    return out


def links(lines: list[int], words: list[int], least: int) -> list[int]:
    """Hashes of the windows' lines, in one pass over the lines whatever the windows' length."""
    upto, power = _sums(lines), [1]
    for _ in lines:
        power.append(power[-1] * _BASE % _PRIME)
    return list({(upto[hi] - upto[lo] * power[hi - lo]) % _PRIME for lo, hi in windows(words, least)})


def _signatures(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [line_hashes(t) for t in b.column(2).to_pylist()]
            yield to_batch(_SIG, [b.column(0), b.column(1), [r[0] for r in rows], [r[1] for r in rows], [links(*r, least) for r in rows]])

    return run


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of two sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {x for x, n in ca.items() if n == 1 and cb.get(x) == 1}
        if not once:
            out += _in_order(a, b, a0, a1, b0, b1)
            continue
        place = {b[j]: j for j in range(b0, b1) if b[j] in once}
        chain = _increasing([(i, place[a[i]]) for i in range(a0, a1) if a[i] in once])
        at_a, at_b = a0, b0
        for i, j in chain:
            out.append((i, j))
            todo.append((at_a, i, at_b, j))
            at_a, at_b = i + 1, j + 1
        todo.append((at_a, a1, at_b, b1))
    return sorted(out)


def _in_order(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Without unique lines: each line of ``a`` at its next place in ``b``, runs together; one pass over an index."""
    places: dict[int, list[int]] = defaultdict(list)
    for j in range(b0, b1):
        places[b[j]].append(j)
    out, i, at = [], a0, b0
    while i < a1:
        own = places.get(a[i], ())
        k = bisect_left(own, at)
        if k == len(own):
            i += 1
            continue
        j = own[k]
        while i < a1 and j < b1 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        at = j
    return out


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``pairs``, which increase in the first number, that increases in the second too."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    chain, k = [], ends[-1]
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def moved_blocks(earlier: list[int], later: list[int], left: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the later document's ranges ``left`` whose lines the earlier one has too, anywhere."""
    by_size: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for lo, hi in left:
        by_size[hi - lo].append((lo, hi))
    upto_a, upto_b, power = _sums(earlier), _sums(later), [1]
    for _ in range(max(by_size, default=0)):
        power.append(power[-1] * _BASE % _PRIME)
    out = []
    for n, ranges in by_size.items():
        held = {(upto_a[i + n] - upto_a[i] * power[n]) % _PRIME: i for i in range(len(earlier) - n + 1)}
        for lo, hi in ranges:
            i = held.get((upto_b[hi] - upto_b[lo] * power[n]) % _PRIME)
            if i is not None and earlier[i : i + n] == later[lo:hi]:
                out.append((lo, hi))
    return out


def common_blocks(earlier: list[int], later: list[int], words: list[int], least: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """Ranges of the later document's lines that the earlier one has and that have ``least`` words: aligned, then moved ones."""
    out, run = [], []
    covered = [False] * len(later)
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            lo, hi = run[0][1], run[-1][1] + 1
            if sum(words[lo:hi]) >= least:
                out.append((lo, hi))
                covered[lo:hi] = [True] * (hi - lo)
            run = []
        run.append((i, j))
    gaps = [0]
    for c in covered:
        gaps.append(gaps[-1] + (not c))
    left = [(lo, hi) for lo, hi in windows(words, least) if gaps[hi] > gaps[lo]]
    return sorted(out + moved_blocks(earlier, later, left)) if left else out


_PAIR = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("n", pa.int32())])
_MASK = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("gone", pa.list_(pa.bool_()))])


def _align(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, th, e, lines, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ranges := common_blocks(e, lines, words, least):
                    rows.append((i, th, [x[0] for x in ranges], [x[1] for x in ranges], len(lines)))
            if rows:
                yield to_batch(_PAIR, list(zip(*rows, strict=True)))

    return run


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for n, los, his in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            gone = [False] * n
            for lo, hi in zip(los, his, strict=True):
                gone[lo:hi] = [True] * (hi - lo)
            out.append(gone)
        yield to_batch(_MASK, [b.column(0), b.column(1), out])


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = BLOCK_WORDS, scope: str = "query") -> DataFrame:
    """id, th (hash of the text), gone (for each line, whether it goes) of documents that lose lines."""
    keyed = docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    sigs = written(map_arrow(keyed, _signatures(least), _SIG_DDL), "lines", scope)
    held = sigs.select("id", "th", F.explode("links").alias("h"))
    doc = F.struct("id", "th")
    first = written(held.groupBy("h").agg(F.min(doc).alias("base"), F.max(doc).alias("top"), F.count("*").alias("n")).filter("base <> top").select("h", "base", "n"), "first", scope)
    # a common line's holders are dealt to several tasks, where each meets the line's first holder
    met = spread_join(held, first.select("h", "base"), ["h"], first.select("h", "n")).filter(doc > F.col("base"))
    pairs = written(met.select(F.col("base.id").alias("id"), F.col("base.th").alias("th"), F.col("id").alias("id2"), F.col("th").alias("th2")).distinct(), "pairs", scope)
    one = sigs.dropDuplicates(["id", "th"])
    earlier = one.select("id", "th", F.col("lines").alias("earlier"))
    later = one.select(F.col("id").alias("id2"), F.col("th").alias("th2"), "lines", "words")
    both = spread_join(pairs, earlier, ["id", "th"]).join(later, ["id2", "th2"]).select("id2", "th2", "earlier", "lines", "words")
    ranges = map_arrow(both, _align(least), "id long, th long, lo array<int>, hi array<int>, n int")
    # as many ranges as the document's own links
    merged = ranges.groupBy("id", "th").agg(F.max("n").alias("n"), F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))
    return map_arrow(merged, _masks, "id long, th long, gone array<boolean>")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = BLOCK_WORDS, scope: str = "query", details: bool = False) -> DataFrame:
    """``docs`` with aligned common blocks deleted from later documents.

    details: adds n_lines and n_removed (lines) and removed (array of line numbers).
    """
    i, th, gone = free_name(docs, "_line_id", "_line_th", "_line_gone")
    masks = shared_lines(docs, id_col, text_col, least, scope).toDF(i, th, gone)
    keyed = docs.withColumns({i: F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), th: F.xxhash64(F.col(text_col))})
    joined = keyed.join(masks, [i, th], "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, k: ~F.get(F.col(gone), k)), "\n")
    out = {text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)}
    if details:
        removed = F.filter(F.transform(F.col(gone), lambda g, k: F.when(g, k)), lambda k: k.isNotNull())
        out |= {"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"), "removed": F.coalesce(removed, F.array().cast("array<int>"))}
    joined = joined.withColumns(out)
    if details:
        joined = joined.withColumn("n_removed", F.size("removed").cast("long"))
    return joined.select(*docs.columns, *(["n_lines", "n_removed", "removed"] if details else []))


def op10(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers, comma-joined), text (what is left)."""
    found = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), details=True)
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), "text")
