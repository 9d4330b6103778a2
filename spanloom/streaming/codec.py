"""Block streams: Apertium, VISL and CG, to and from tables of blocks.

Encoders and the VISL and CG decoders are column expressions; the Apertium
decoder reads nested brackets and escapes, in one regular expression for each
frame. All are stateless maps of rows, so the same functions serve batch tables
and Structured Streaming.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markers import CLOSE, HEADER_END, OPEN_B, OPEN_E, PROT_B, PROT_E, SENTINEL, rewrite
from ..functions.text import reduce_space, replaced

STREAMS = ("apertium", "visl", "cg")
#: The word in a stream's header. Set it to what the other tools expect; readers take any.
WORD = "spanloom"
_META = [(r"([\\^$\[\]{}/])", r"\\$1")]
_BODY = [(r"([\\^$\[\]{}/@<>])", r"\\$1")]


def apertium_meta(column: Column) -> Column:
    """Backslashes before what Apertium reads as markup, for names."""
    return rewrite(column, _META)


def apertium_body(column: Column) -> Column:
    """A block's text: escapes, spans as wordblanks, protected regions as blanks."""
    spans = [(f";(?=[^{OPEN_B}{OPEN_E}]*{OPEN_E})", ";t:"), (f"{OPEN_B}([^{OPEN_E}]*){OPEN_E}", "[[t:$1]]"), (CLOSE, "[[/]]"), (f"{PROT_B}([^{PROT_E}]*){PROT_E}", "[tf:$1]")]
    escaped = rewrite(column, _BODY)
    return F.when(escaped.rlike(f"[{OPEN_B}-{CLOSE}{PROT_B}]"), rewrite(escaped, spans)).otherwise(escaped)


def apertium_header(name: Column, word: str = WORD) -> Column:
    return F.concat(F.lit(f"[{word}:"), apertium_meta(name), F.lit("]\n\0"))


def apertium_block(block_id: Column, body: Column, is_header: Column | None = None, without_stop: bool = False) -> Column:
    mark = F.lit("") if is_header is None else F.when(is_header, f"[]{HEADER_END}").otherwise("")
    return F.concat(F.lit("\n[tf-block:"), apertium_meta(block_id), F.lit("]\n\n"), apertium_body(body), mark, F.lit("" if without_stop else ".[]"), F.lit("" if without_stop else "\n"), F.lit("\0"))


def visl_body(column: Column) -> Column:
    return replaced(column, (OPEN_B, "<STYLE:"), (OPEN_E, ">"), (CLOSE, "</STYLE>"))


def visl_header(name: Column, word: str = WORD) -> Column:
    return F.concat(F.lit(f"<STREAMCMD:{word.upper()}:"), name, F.lit(">\n\n"))


def visl_block(block_id: Column, body: Column) -> Column:
    return F.concat(F.lit('\n<s id="'), block_id, F.lit('">\n'), visl_body(body), F.lit("\n</s>\n\n"))


def encode(blocks: DataFrame, stream: str, name: Column, id_col: str = "doc_id", without_stop: bool = False, word: str = WORD) -> DataFrame:
    """id, stream: the text of each document's stream. blocks: block_no, block_id, body, is_header.

    A document's blocks meet in one row, as its stream is one text.
    """
    if stream not in STREAMS:
        raise ValueError(f"no stream format {stream}; there are {', '.join(STREAMS)}")
    chunk = apertium_block(F.col("block_id"), F.col("body"), F.col("is_header"), without_stop) if stream == "apertium" else visl_block(F.col("block_id"), F.col("body"))
    one = blocks.select(F.col(id_col), F.col("block_no"), chunk.alias("chunk"))
    joined = one.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("block_no", "chunk"))).alias("x"))
    header = apertium_header(name, word) if stream == "apertium" else visl_header(name, word)
    return joined.select(id_col, F.concat(header, F.array_join(F.col("x.chunk"), "")).alias("stream"))


def stream_kind(stream: Column) -> Column:
    """The stream's format by its first line that isn't empty, or null."""
    first = F.regexp_extract(stream, r"\A\n*([^\n]*)", 1)
    return F.when(first.rlike(r"\[[a-z]+:"), "apertium").when(first.rlike("<STREAMCMD:[A-Z]+:"), "visl")


def stream_name(stream: Column) -> Column:
    """The name in a stream's header."""
    plain = F.regexp_extract(stream, r"<STREAMCMD:[A-Z]+:([^>\n]*)>", 1)
    escaped = F.regexp_extract(stream, r"\[[a-z]+:((?:\\.|[^\]\\])*)\]", 1)
    return F.when(stream_kind(stream) == "apertium", F.regexp_replace(escaped, r"\\(.)", "$1")).otherwise(plain)


def documents_of(streams: DataFrame, column: str, *keep: str) -> DataFrame:
    """name, stream of each document in texts that hold several streams: a header begins one."""
    at = F.when(stream_kind(F.col(column)) == "apertium", F.split(column, r"(?=\[[a-z]+:(?:\\.|[^\]\\])*\]\n\x00)")).otherwise(F.split(column, "(?=<STREAMCMD:[A-Z]+:)"))
    each = streams.select(*keep, F.explode(at).alias("stream"))
    return each.select(*keep, stream_name(F.col("stream")).alias("name"), "stream").filter("name <> ''")


_UNIT = re.compile(r"\\(.)|\[\[/\]\]|\[\[((?:\\.|[^\]\\])*)\]\]|\.?\[\]|\[((?:\\.|[^\]\\])*)\]", re.S)
_BACK = re.compile(r"\\(.)", re.S)
_ID = re.compile(r"\[tf-block:((?:\\.|[^\]\\])*)\]")


def apertium_text(body: str) -> str:
    """The text of an Apertium body: wordblanks to spans, blanks to their content, escapes undone."""
    opened = 0

    def one(m: re.Match) -> str:
        nonlocal opened
        if m[1] is not None:
            return m[1]
        if m[0] == "[[/]]":
            closes = opened > 0
            opened -= closes
            return CLOSE if closes else ""
        if m[2] is not None:
            items = dict.fromkeys(x.strip("; \t\r\n") for x in _BACK.sub(r"\1", m[2]).split(";"))
            kept = [x[2:] for x in items if x.startswith("t:")]
            if not kept:
                return ""
            opened += 1
            return OPEN_B + ";".join(kept) + OPEN_E
        if m[3] is None:
            return ""
        blank = _BACK.sub(r"\1", m[3])
        if blank.startswith("tf-block:"):
            return ""
        return f"{PROT_B}{blank[3:]}{PROT_E}" if blank.startswith("tf:") else blank

    return _UNIT.sub(one, body)


@F.pandas_udf(T.StructType([T.StructField("block_id", T.StringType()), T.StructField("body", T.StringType())]))
def _apertium_frames(frames: pd.Series) -> pd.DataFrame:
    rows = []
    for f in frames:
        m = _ID.search(f) if f is not None else None
        if not m:
            rows.append((None, None))
            continue
        rows.append((_BACK.sub(r"\1", m[1]), apertium_text(f[m.end() :])))
    return pd.DataFrame(rows, columns=["block_id", "body"])


def decode_apertium(frames: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """block_id, body of each frame that has one: a frame is what stands between NULs. Works on streams too."""
    got = frames.select(*keep, _apertium_frames(column).alias("b")).filter("b.block_id IS NOT NULL")
    return got.select(*keep, "b.block_id", reduce_space(F.col("b.body")).alias("body"))


def frames_of(streams: DataFrame, column: str, *keep: str) -> DataFrame:
    """Whole Apertium streams cut into frames: ``seq``, ``value``."""
    return streams.select(*keep, F.posexplode(F.split(column, "\0", -1)).alias("seq", "value"))


def decode_visl(streams: DataFrame, column: str, *keep: str, cg: bool = False) -> DataFrame:
    """seq, block_id, body of each block of VISL or CG streams.

    VISL lines join without a line feed. CG has a token on each line; its line
    ends stay as a sentinel, and blanks are not reduced.
    """
    whole = F.regexp_extract_all(F.col(column), F.lit(r'(?s)(<s id="[^"]*">.*?\n</s>)'), F.lit(1))
    each = streams.select(*keep, F.posexplode(whole).alias("seq", "x"))
    block_id = F.regexp_extract("x", r'\A<s id="([^"]*)">', 1)
    text = F.regexp_extract("x", r'(?s)\A<s id="[^"]*">\n?(.*?)\n?</s>\z', 1)
    spans = rewrite(text, [("<STYLE:([^>]*)>", f"{OPEN_B}$1{OPEN_E}"), ("</STYLE>", CLOSE)])
    body = F.concat(F.replace(spans, F.lit("\n"), F.lit(SENTINEL)), F.lit(SENTINEL)) if cg else reduce_space(F.replace(spans, F.lit("\n"), F.lit("")))
    return each.select(*keep, "seq", block_id.alias("block_id"), body.alias("body"))


def read_frames(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Frames of Apertium stream files, as a table or as a stream of new files."""
    reader = (spark.readStream if streaming else spark.read).format("text").option("lineSep", "\0")
    return (reader.schema("value string") if streaming else reader).load(path)
