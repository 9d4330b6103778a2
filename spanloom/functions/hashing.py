"""XXH32 and base64url: ids of blocks and styles."""

from __future__ import annotations

import functools
from binascii import b2a_base64

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .markers import HASH_SEP


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def short_hash(text: str) -> str:
    """base64url of the little-endian XXH32 (seed 0) of the text, without padding."""
    return b2a_base64(xxhash.xxh32_digest(utf8(text), 0)[::-1])[:6].translate(_URL).decode()


_URL = bytes.maketrans(b"+/", b"-_")
_short_hash_seen = functools.lru_cache(8192)(short_hash)


def style_hash(otag: str, ctag: str) -> str:
    """Of the tags of a style. Few styles come often, so those that are short are kept."""
    both = otag + HASH_SEP + ctag
    return (_short_hash_seen if len(both) < 512 else short_hash)(both)


@F.pandas_udf(T.StringType())
def short_hash_col(texts: pd.Series) -> pd.Series:
    """``short_hash`` of a column, by Arrow batch; null stays null."""
    return texts.map(lambda t: None if t is None else short_hash(t)).astype(object)


@F.pandas_udf(T.LongType())
def xxh32(texts: pd.Series) -> pd.Series:
    """XXH32, seed 0, as an unsigned value in a long."""
    return texts.map(lambda t: None if t is None else xxhash.xxh32_intdigest(utf8(t), 0)).astype("Int64")


@F.pandas_udf(T.StringType())
def xxh64(texts: pd.Series) -> pd.Series:
    """XXH64, seed 0, as unsigned decimal digits (Spark's own xxhash64 has another seed)."""
    return texts.map(lambda t: None if t is None else str(xxhash.xxh64_intdigest(utf8(t), 0))).astype(object)


def b64url(value: Column) -> Column:
    """base64url without padding of a string's or binary's bytes."""
    return F.translate(F.base64(value.cast("binary")), "+/=\r\n", "-_")


def short_hash_sql(text: str) -> str:
    """DuckDB SQL for ``short_hash``: lanes are folded with lists."""
    p1, p2, p3, p4, p5, m = 2654435761, 2246822519, 3266489917, 668265263, 374761393, 4294967296
    rot = lambda x, r: f"((({x}) * {1 << r} + ({x}) // {1 << (32 - r)}) % {m})"
    mul = lambda x, p: f"((({x}) * {p}::HUGEINT) % {m})"
    h = f"hex(encode({text}))"
    n = f"(length({h}) // 2)"
    byte = lambda at: f"('0x' || substr({h}, 2 * ({at})::BIGINT + 1, 2))::HUGEINT"
    lane = lambda at: f"({byte(at)} + 256 * {byte(f'{at} + 1')} + 65536 * {byte(f'{at} + 2')} + 16777216 * {byte(f'{at} + 3')})"
    fold = lambda first, items, step: f"list_reduce(list_prepend(({first})::HUGEINT, {items}), lambda acc, w: {step})"
    seeds = ((p1 + p2) % m, p2, 0, (-p1) % m)
    rounds = [fold(s, f"list_transform(range({n} // 16), lambda k: {lane(f'(16 * k + {4 * i})')})", mul(rot(f"(acc + {mul('w', p2)}) % {m}", 13), p1)) for i, s in enumerate(seeds)]
    started = f"CASE WHEN {n} < 16 THEN {p5}::HUGEINT ELSE ({' + '.join(rot(v, r) for v, r in zip(rounds, (1, 7, 12, 18), strict=True))}) % {m} END"
    done = f"({n} // 16 * 16)"
    words = fold(f"({started} + {n}) % {m}", f"list_transform(range(({n} - {done}) // 4), lambda k: {lane(f'({done} + 4 * k)')})", mul(rot(f"(acc + {mul('w', p3)}) % {m}", 17), p4))
    tail = fold(words, f"list_transform(range({n} // 4 * 4, {n}), lambda k: {byte('k')})", mul(rot(f"(acc + {mul('w', p5)}) % {m}", 11), p1))
    mixed = f"(SELECT list_reduce([h0, 15, 13, 16]::HUGEINT[], lambda acc, s: CASE s WHEN 15 THEN {mul('xor(acc, acc // 32768)', p2)} WHEN 13 THEN {mul('xor(acc, acc // 8192)', p3)} ELSE xor(acc, acc // 65536) END) FROM (SELECT {tail} AS h0))"
    little = f"(SELECT unhex(format('{{:02X}}{{:02X}}{{:02X}}{{:02X}}', (v % 256)::BIGINT, (v // 256 % 256)::BIGINT, (v // 65536 % 256)::BIGINT, (v // 16777216)::BIGINT)) FROM (SELECT {mixed} AS v))"
    return f"translate(rtrim(base64({little}), '='), '+/', '-_')"


def xxh64_sql(text: str) -> str:
    """DuckDB SQL for ``xxh64``."""
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    m = 1 << 64
    u = lambda x: f"({x})::UHUGEINT"
    mod = lambda x: f"(({x}) % {m}::UHUGEINT)"
    rot = lambda x, r: mod(f"({mod(x)} * {1 << r}::UHUGEINT) + ({mod(x)} // {1 << (64 - r)}::UHUGEINT)")
    mul = lambda x, p: mod(f"{mod(x)} * {p}::UHUGEINT")
    h = f"hex(encode({text}))"
    n = f"(length({h}) // 2)"
    byte = lambda at: u(f"('0x' || substr({h}, 2 * ({at})::BIGINT + 1, 2))::BIGINT")
    lane = lambda at, size: "(" + " + ".join(f"{byte(f'{at} + {i}')} * {1 << 8 * i}::UHUGEINT" for i in range(size)) + ")"
    fold = lambda first, items, step: f"list_reduce(list_prepend({u(first)}, {items}), lambda acc, w: {step})"
    one = lambda v: mul(rot(mul(v, p2), 31), p1)
    seeds = ((p1 + p2) % m, p2, 0, (-p1) % m)
    lanes = [fold(str(s), f"list_transform(range({n} // 32), lambda j: {lane(f'(32 * j + {8 * i})', 8)})", mul(rot(f"acc + {mul('w', p2)}", 31), p1)) for i, s in enumerate(seeds)]
    joined = " + ".join(rot(f"v[{i + 1}]", r) for i, r in enumerate((1, 7, 12, 18)))
    mixed = fold(mod(joined), "v", mod(f"{mul(f'xor(acc, {one("w")})', p1)} + {p4}::UHUGEINT"))
    started = f"CASE WHEN {n} < 32 THEN {u(str(p5))} ELSE (SELECT {mixed} FROM (SELECT [{', '.join(lanes)}] AS v)) END"
    begun, at8 = f"({n} // 32 * 32)", f"({n} // 8 * 8)"
    eights = fold(mod(f"{started} + {u(n)}"), f"list_transform(range(({n} - {begun}) // 8), lambda j: {lane(f'({begun} + 8 * j)', 8)})", mod(f"{mul(rot(f'xor(acc, {one("w")})', 27), p1)} + {p4}::UHUGEINT"))
    fours = fold(eights, f"list_transform(range(({n} - {at8}) // 4), lambda j: {lane(f'({at8} + 4 * j)', 4)})", mod(f"{mul(rot(f'xor(acc, {mul("w", p1)})', 23), p2)} + {p3}::UHUGEINT"))
    tail = fold(fours, f"list_transform(range({n} // 4 * 4, {n}), lambda j: {byte('j')})", mul(rot(f"xor(acc, {mul('w', p5)})", 11), p1))
    return f"(SELECT xor(c, c // {1 << 32}::UHUGEINT) FROM (SELECT {mul(f'xor(b, b // {1 << 29}::UHUGEINT)', p3)} AS c FROM (SELECT {mul(f'xor(a, a // {1 << 33}::UHUGEINT)', p2)} AS b FROM (SELECT {tail} AS a))))::VARCHAR"
