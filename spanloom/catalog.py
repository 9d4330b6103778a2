"""Queries over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.hashing import b64url, short_hash_col, short_hash_sql, xxh64, xxh64_sql
from .functions.markers import BLANK, CHARSET, CLOSE, CONTENT, HASH_SEP, OPEN_B, OPEN_E, PROT_B, PROT_E, SENTINEL, SMALL_GT, SMALL_LT, SOLID, rewrite, rewrite_sql
from .operators import detect, formats, office, spans
from .operators.tree import escape
from .plans import engine
from .plans.engine import Settings
from .sources.tables import dealt, merged_styles, read_files, read_table, scratch, small_batches, upsert, value_of, write_lines
from .streaming import codec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", "html")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "text")


def _dealt_docs(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(_docs(spark, sf), "doc_id", "text")


def _dealt_pages(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(_pages(spark, sf), "page_id", "html")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- detection ------------------------------------------------------------------------------

_DETECT = f"CASE WHEN contains(lower(x), '</html>') THEN 'html' WHEN contains(lower(x), '</tei>') THEN 'tei' WHEN {' OR '.join(f'contains(lower(x), {_q(t)})' for t in detect.FRAGMENT_TAGS)} THEN 'html-fragment' ELSE 'text' END"


@_query(f"SELECT page_id, {_DETECT} AS format FROM (SELECT page_id, html AS x FROM pages)")
def detect_format_pages(spark, sf):
    return _pages(spark, sf).select("page_id", detect.by_text(F.col("html")).alias("format"))


@_query(f"SELECT doc_id, {_DETECT} AS format FROM (SELECT doc_id, text AS x FROM documents)")
def detect_format_documents(spark, sf):
    return _docs(spark, sf).select("doc_id", detect.by_text(F.col("text")).alias("format"))


_ENDINGS = [*detect.EXTENSIONS, "HTML", "unknown"]


@_query(f"""SELECT doc_id, ending, CASE lower(ending) {' '.join(f"WHEN {_q(e)} THEN {_q(f)}" for e, f in detect.EXTENSIONS.items())} END AS format
FROM documents, (SELECT unnest([{', '.join(map(_q, _ENDINGS))}]) AS ending)""")
def detect_format_names(spark, sf):
    each = _docs(spark, sf).select("doc_id", F.explode(F.array(*map(F.lit, _ENDINGS))).alias("ending"))
    return each.select("doc_id", "ending", detect.by_name(F.concat(F.lit("dir.v1/name_"), F.col("doc_id").cast("string"), F.lit("."), F.col("ending"))).alias("format"))


@_query("SELECT doc_id, unnest(['UTF-8-BOM', 'UTF-32BE', 'UTF-16LE', 'UTF-16BE', 'UTF-8']) AS encoding, text FROM documents")
def encoding_detect(spark, sf):
    t = F.col("text")
    mark = lambda hexed, charset: F.concat(F.unhex(F.lit(hexed)), F.encode(t, charset))
    kinds = [mark("EFBBBF", "UTF-8"), F.when(t.isNotNull(), F.encode(F.concat(F.lit("\ufeff"), t), "UTF-32")), mark("FFFE", "UTF-16LE"), mark("FEFF", "UTF-16BE"), F.encode(t, "UTF-8")]
    each = _docs(spark, sf).select("doc_id", F.explode(F.array(*kinds)).alias("content"))
    return each.select("doc_id", detect.encoding(F.col("content")).alias("encoding"), detect.decoded(F.col("content")).alias("text"))


@_query("SELECT doc_id, 'windows-1252' AS encoding, text FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7F¡-ÿ]*') AND regexp_matches(text, '[à-ÿ]')")
def encoding_legacy(spark, sf):
    """Texts in one byte a letter, without a mark: the code page is guessed from the letters."""
    fits = F.col("text").rlike(r"\A[\x00-\x7F\u00A1-\u00FF]*\z") & F.col("text").rlike("[à-ÿ]")
    content = F.encode("text", "ISO-8859-1")
    return _docs(spark, sf).filter(fits).select("doc_id", detect.encoding(content).alias("encoding"), detect.decoded(content).alias("text"))


# ---- rewrites before parsing ----------------------------------------------------------------


@_query("SELECT page_id, NOT contains(lower(html), '</html>') AS fragment FROM pages")
def html_fragment_fallback(spark, sf):
    return _pages(spark, sf).select("page_id", formats.is_fragment(F.col("html")).alias("fragment"))


@_query(f"SELECT page_id, regexp_replace(html, {_q(formats.CHARSET_RULES[0][0])}, '\\1{CHARSET}') AS html FROM pages")
def charset_placeholder(spark, sf):
    return _pages(spark, sf).select("page_id", rewrite(F.col("html"), formats.CHARSET_RULES).alias("html"))


@_query(f"""SELECT page_id, place, body, {short_hash_sql(f"body || '{HASH_SEP}'")} AS hash FROM (
SELECT page_id, unnest(b) AS body, unnest(range(len(b)))::INT AS place FROM (SELECT page_id, regexp_extract_all(html, {_q(formats.RAW_BODIES)}, 1) AS b FROM pages))""")
def protect_script_style(spark, sf):
    each = _pages(spark, sf).select("page_id", F.posexplode(formats.raw_bodies(F.col("html"))).alias("place", "body"))
    return each.withColumn("hash", short_hash_col(F.concat("body", F.lit(HASH_SEP))))


@_query(f"SELECT page_id, {rewrite_sql('html', formats.SOFT_HYPHENS)} AS html FROM pages")
def strip_soft_hyphens(spark, sf):
    return _pages(spark, sf).select("page_id", formats.strip_soft_hyphens(F.col("html")).alias("html"))


_SUBS = [("([a-z])([a-z])([a-z]+)", "$1<sub>$2</sub>$3"), ("<sub>e</sub>", "<sup class=\"x\">e</sup>")]


@_query(f"SELECT doc_id, {rewrite_sql('text', _SUBS + formats.SUBSUP_BEFORE + formats.SUBSUP_AFTER_EACH)} AS text FROM documents")
def subsup_spacing(spark, sf):
    return _docs(spark, sf).select("doc_id", rewrite(F.col("text"), _SUBS + formats.SUBSUP_BEFORE + formats.SUBSUP_AFTER).alias("text"))


@_query(f"SELECT doc_id, {_q(formats._FRAGMENT_HEAD)} || text || {_q(formats._FRAGMENT_TAIL)} AS html FROM documents")
def fragment_wrap(spark, sf):
    return _docs(spark, sf).select("doc_id", formats.wrap_fragment(F.col("text")).alias("html"))


@_query(f"""SELECT page_id, name, class, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9-]*)', 1)) AS name FROM pages)
JOIN (VALUES {', '.join(f"('{c}', '{n}')" for c in ('prot', 'prot_inline', 'inline') for n in sorted(getattr(formats.HTML_TAGS, c)))}) AS k(class, name) USING (name) GROUP BY ALL""")
def tag_class_membership(spark, sf):
    tags = _pages(spark, sf).select("page_id", F.explode(F.regexp_extract_all(tx.lower_ascii(F.col("html")), F.lit("<([a-z][a-z0-9-]*)"), F.lit(1))).alias("name"))
    classes = spark.createDataFrame([(c, n) for c in ("prot", "prot_inline", "inline") for n in sorted(getattr(formats.HTML_TAGS, c))], "class string, name string")
    counted = tags.groupBy("page_id", "name").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(classes), "name").select("page_id", "name", "class", "n")  # a fixed list


# ---- text and lines -------------------------------------------------------------------------

_LINES = "SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS place FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)"
_PARAS = f"SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS place FROM (SELECT doc_id, regexp_split_to_array(text, {_q(formats._PARAGRAPH)}) AS p FROM documents)"


def _numbered(parts: str, has: str) -> str:
    return f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place))::INT AS block_no, body FROM (SELECT doc_id, place, {rewrite_sql('part', formats.SOFT_HYPHENS)} AS body FROM ({parts})) WHERE regexp_matches(body, {_q(has)})"


def _blocks(df: DataFrame, by_line: bool, more: bool = False) -> DataFrame:
    """doc_id, block_no, body: parts with content, numbered; all in the JVM."""
    parts = formats.paragraphs(df, "doc_id", F.col("text"), by_line).select("doc_id", "place", formats.strip_soft_hyphens(F.col("part")).alias("body"))
    return formats.number_blocks(parts.filter(tx.has_content(F.col("body"), more)), "doc_id").select("doc_id", "block_no", "body")


@_query(_numbered(_PARAS, CONTENT))
def text_paragraphs(spark, sf):
    return _blocks(_docs(spark, sf), False)


@_query(_numbered(_LINES, CONTENT))
def text_lines(spark, sf):
    return _blocks(_docs(spark, sf), True)


@_query(_numbered(_LINES, SOLID))
def text_lines_extract_more(spark, sf):
    return _blocks(_docs(spark, sf), True, more=True)


@_query(_numbered(_LINES.replace("documents", "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"), CONTENT))
def conversation_lines(spark, sf):
    turns = read_table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return _blocks(turns, True)


@_query(f"SELECT doc_id, block_no, block_no || '-' || {short_hash_sql('body')} AS block_id FROM ({_numbered(_LINES, CONTENT)})")
def block_ids_lines(spark, sf):
    return _with_ids(_blocks(_docs(spark, sf), True)).select("doc_id", "block_no", "block_id")


def _with_ids(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("block_id", F.concat(F.col("block_no").cast("string"), F.lit("-"), short_hash_col("body")))


# ---- scalar functions -----------------------------------------------------------------------


def _replace_sql(x: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        x = f"replace({x}, {a}, {b})"
    return x


_FIVE = (("'&'", "'&amp;'"), ("'\"'", "'&quot;'"), ("''''", "'&apos;'"), ("'<'", "'&lt;'"), ("'>'", "'&gt;'"))
_LINE_REFS = (("chr(9)", "'&#9;'"), ("chr(10)", "'&#10;'"), ("chr(13)", "'&#13;'"))


def _scalar(name: str, fn: Callable[[Column], Column], sql: str, given: Callable[[Column], Column] = lambda c: c, given_sql: str = "text", heavy: bool = False) -> None:
    def query(spark, sf):
        docs = _dealt_docs if heavy else _docs
        return docs(spark, sf).select("doc_id", fn(given(F.col("text"))).alias("value"))

    query.__name__ = name
    _query(f"SELECT doc_id, {sql} AS value FROM (SELECT doc_id, {given_sql} AS x FROM documents)")(query)


_scalar("xml_escape", tx.xml_escape, _replace_sql("x", *_FIVE))
_scalar("xml_escape_nls", lambda c: tx.xml_escape(c, newlines=True), _replace_sql("x", *_FIVE, *_LINE_REFS))
_scalar("xml_round_trip", lambda c: tx.xml_unescape(tx.xml_escape(c)), "x")
_scalar("mangle_xml", tx.mangle, f"translate(x, '<>', '{SMALL_LT}{SMALL_GT}')", lambda c: F.concat(F.lit("<p>"), c, F.lit("</p>")), "'<p>' || text || '</p>'")
_scalar("lower_ascii", tx.lower_ascii, "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_PAD, _PAD_SQL = lambda c: F.concat(F.lit("; \n\t"), c, F.lit(" \n;")), "'; ' || chr(10) || chr(9) || text || ' ' || chr(10) || ';'"
_scalar("trim_ws", tx.trim_ascii, "trim(x, ' ' || chr(9) || chr(10) || chr(13))", lambda c: F.concat(F.lit(" \n\t"), c, F.lit("\r\n ")), "' ' || chr(10) || chr(9) || text || chr(13) || chr(10) || ' '")
_scalar("trim_wb", tx.trim_wordblank, "trim(x, '; ' || chr(9) || chr(10) || chr(13))", _PAD, _PAD_SQL)
_REDUCE_SQL = "CASE WHEN trim(x, w) = '' THEN CASE WHEN contains(x, ' ') THEN ' ' ELSE '' END ELSE (CASE WHEN contains(regexp_extract(x, '^[ \\t\\r\\n]+'), ' ') THEN ' ' ELSE '' END) || trim(x, w) || (CASE WHEN contains(regexp_extract(x, '[ \\t\\r\\n]+$'), ' ') THEN ' ' ELSE '' END) END".replace("trim(x, w)", "trim(x, ' ' || chr(9) || chr(10) || chr(13))")
_scalar("reduce_ws", tx.reduce_space, _REDUCE_SQL, lambda c: F.concat(F.lit("\n"), c, F.lit(" \n ")), "chr(10) || text || ' ' || chr(10) || ' '")
_scalar("base64url_text", b64url, "translate(rtrim(base64(encode(x)), '='), '+/', '-_')")


@_query(f"SELECT c_custkey, {xxh64_sql('t')} AS hash FROM (SELECT c_custkey, repeat(c_name, (c_custkey % 5)::INT) AS t FROM customer)")
def xxh64_text(spark, sf):
    """XXH64 of texts of none to some 90 bytes."""
    return read_table(spark, sf, "customer").select("c_custkey", xxh64(F.repeat("c_name", (F.col("c_custkey") % 5).cast("int"))).alias("hash"))


# ---- spans ----------------------------------------------------------------------------------

_PAIR = [("([a-z]+) ([a-z]+)", f"{OPEN_B}b:AA{OPEN_E}$1{CLOSE} {OPEN_B}b:AA{OPEN_E}$2{CLOSE}")]
_NEST = [("([a-z]+) ([a-z]+)", f"{OPEN_B}b:AA{OPEN_E}{OPEN_B}i:BB{OPEN_E}$1{CLOSE}{CLOSE} $2")]
_CUT = [("([a-z])([a-z]+)([a-z])", f"$1{OPEN_B}b:AA{OPEN_E}$2{CLOSE}$3")]
_SPACED = [("([a-z]+) ", f"{OPEN_B}b:AA{OPEN_E} $1 {CLOSE}")]
_REGIONS = [("([a-z]+) ([a-z]+)", f"$1{PROT_B}P:AA{PROT_E} {PROT_B}P:BB{PROT_E}$2")]
#: The first rule without a back-reference, and the third without look-ahead, for the lists above.
_MERGE_AA = [(f"{OPEN_B}b:AA{OPEN_E}([^{OPEN_B}-{CLOSE}]+){CLOSE}({BLANK}*){OPEN_B}b:AA{OPEN_E}([^{OPEN_B}-{CLOSE}]+){CLOSE}", f"{OPEN_B}b:AA{OPEN_E}$1$2$3{CLOSE}")]
_PREFIX_EATING = [(f"([\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Sk}}]*[\\p{{L}}\\p{{M}}])({OPEN_B}b:AA{OPEN_E})(\\p{{L}})", "$2$1$3")]
_SUFFIX_EATING = [(f"([\\p{{L}}\\p{{M}}]){CLOSE}(\\p{{L}}[\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Sk}}]*)", f"$1$2{CLOSE}")]
#: What joining makes of the list above, in one step.
_NESTED_ONCE = [("([a-z]+) ([a-z]+)", f"{OPEN_B}b:AA;i:BB{OPEN_E}$1{CLOSE} $2")]
_SPACED_ONCE = [("([a-z]+) ", f" {OPEN_B}b:AA{OPEN_E}$1{CLOSE} ")]
_REGIONS_ONCE = [("([a-z]+) ([a-z]+)", f"$1{PROT_B}P:AA P:BB{PROT_E}$2")]


def _span(name: str, given: list, rules: list, sql_rules: list | None = None) -> None:
    _scalar(name, lambda c: rewrite(c, rules), rewrite_sql("x", sql_rules or rules), lambda c: rewrite(c, given), rewrite_sql("text", given))


_span("span_merge", _PAIR, spans.MERGE, _MERGE_AA)
_scalar("span_nested", lambda c: rewrite(c, spans.NESTED), rewrite_sql("x", _NESTED_ONCE), lambda c: rewrite(c, _NEST))
_span("span_alpha_prefix", _CUT, spans.ALPHA_PREFIX, _PREFIX_EATING)
_span("span_alpha_suffix", _CUT, spans.ALPHA_SUFFIX, _SUFFIX_EATING)
_scalar("span_space_out", lambda c: rewrite(c, spans.SPACE_OUT), rewrite_sql("x", _SPACED_ONCE), lambda c: rewrite(c, _SPACED))
_scalar("protected_merge", lambda c: rewrite(c, spans.PROTECTED_MERGE), rewrite_sql("x", _REGIONS_ONCE), lambda c: rewrite(c, _REGIONS))
_ROUND = [*_MERGE_AA, *spans.NESTED, *_PREFIX_EATING, *_SUFFIX_EATING, *spans.SPACE_OUT, *_MERGE_AA]
_scalar("span_round", spans.one_round, rewrite_sql("x", _ROUND), lambda c: rewrite(c, _CUT), rewrite_sql("text", _CUT), heavy=True)


_DEEP = [("([a-z]+) ([a-z]+) ", f"{OPEN_B}b:AA{OPEN_E}{OPEN_B}i:BB{OPEN_E}{OPEN_B}u:CC{OPEN_E}$1{CLOSE}{CLOSE}{CLOSE} {OPEN_B}b:AA{OPEN_E}{OPEN_B}i:BB;u:CC{OPEN_E}$2 {CLOSE}{CLOSE}")]


@_query(f"SELECT doc_id, {rewrite_sql('x', [('((?:[a-z]+ [a-z]+ )*[a-z]+ [a-z]+) ', f'{OPEN_B}b:AA;i:BB;u:CC{OPEN_E}$1{CLOSE} ')])} AS value FROM (SELECT doc_id, translate(text, 'àâäáéèêëíîïìóôöòúûüùñçßœæÀÂÄÁÉÈÊËÍÎÏÌÓÔÖÒÚÛÜÙÑÇABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?-', repeat('.', 99)) AS x FROM documents)")
def span_fixpoint(spark, sf):
    """Spans three deep, cut by blanks: rounds until nothing changes; what is no small ASCII letter is a point."""
    x = F.translate("text", "àâäáéèêëíîïìóôöòúûüùñçßœæÀÂÄÁÉÈÊËÍÎÏÌÓÔÖÒÚÛÜÙÑÇABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?-", "." * 99)
    small_batches(spark)
    return _dealt_docs(spark, sf).select("doc_id", spans.normalise(rewrite(x, _DEEP)).alias("value"))


@_query(f"""SELECT c_custkey, tag, hash, coalesce(otag, '') AS otag, coalesce(ctag, '') AS ctag, coalesce(flags, '') AS flags, coalesce(otag, '') || (CASE WHEN flags = 'P' THEN '' ELSE c_name END) || coalesce(ctag, '') AS expanded
FROM (SELECT c_custkey, c_name, 'n' AS tag, (c_nationkey + 1)::VARCHAR AS hash FROM customer)
LEFT JOIN (SELECT 'n' AS tag, n_nationkey::VARCHAR AS hash, '<n v="' || n_name || '">' AS otag, '</n>' AS ctag, CASE WHEN n_regionkey = 1 THEN 'P' ELSE '' END AS flags FROM nation) USING (tag, hash)""")
def span_expand_depth1(spark, sf):
    nation = read_table(spark, sf, "nation")
    styles = nation.select(F.lit("n").alias("tag"), F.col("n_nationkey").cast("string").alias("hash"), F.concat(F.lit('<n v="'), "n_name", F.lit('">')).alias("otag"), F.lit("</n>").alias("ctag"), F.when(F.col("n_regionkey") == 1, "P").otherwise("").alias("flags"))
    given = read_table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(f"{OPEN_B}n:"), (F.col("c_nationkey") + 1).cast("string"), F.lit(OPEN_E), F.col("c_name"), F.lit(CLOSE)).alias("body"))
    each = spans.lookup_styles(spans.spans_of(given, "body", "c_custkey", "body"), styles, ("tag", "hash"))
    return each.select("c_custkey", "tag", "hash", "otag", "ctag", "flags", spans.expand_flat(F.col("body"), F.col("otag"), F.col("ctag"), F.col("flags")).alias("expanded"))


# ---- streams --------------------------------------------------------------------------------

_esc_sql = lambda x, chars: f"regexp_replace({x}, '([{chars}])', '\\\\\\1', 'g')"
_BODY_SQL = _esc_sql("body", r"\\^$\[\]{}/@<>")
_IDS_SQL = f"SELECT doc_id, block_no, block_no || '-' || {short_hash_sql('body')} AS block_id, body FROM ({_numbered(_LINES, CONTENT)})"
_APERTIUM_SQL = f"chr(10) || '[tf-block:' || block_id || ']' || chr(10) || chr(10) || {_BODY_SQL} || '.[]' || chr(10)"
_VISL_SQL = "chr(10) || '<s id=\"' || block_id || '\">' || chr(10) || body || chr(10) || '</s>' || chr(10) || chr(10)"


def _line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _with_ids(_blocks(_docs(spark, sf), True)).withColumn("is_header", F.lit(False))


@_query(f"SELECT doc_id, {_esc_sql('text', r'\\^$\[\]{}/@<>')} AS value FROM documents")
def apertium_escape(spark, sf):
    return _docs(spark, sf).select("doc_id", codec.apertium_body(F.col("text")).alias("value"))


@_query(f"SELECT doc_id, block_no, {_APERTIUM_SQL} AS chunk FROM ({_IDS_SQL})")
def apertium_block(spark, sf):
    chunk = codec.apertium_block(F.col("block_id"), F.col("body"))
    return _line_blocks(spark, sf).select("doc_id", "block_no", F.translate(chunk, "\0", "").alias("chunk"))


@_query(f"SELECT doc_id, block_no, {_VISL_SQL} AS chunk FROM ({_IDS_SQL})")
def visl_block(spark, sf):
    return _line_blocks(spark, sf).select("doc_id", "block_no", codec.visl_block(F.col("block_id"), F.col("body")).alias("chunk"))


@_query(f"SELECT doc_id, '[spanloom:job]' || chr(10) || '|' || string_agg({_APERTIUM_SQL} || '|', '' ORDER BY block_no) AS stream FROM ({_IDS_SQL}) GROUP BY doc_id")
def apertium_stream(spark, sf):
    # DuckDB's texts can't hold NUL; a bar stands for it here
    return codec.encode(_line_blocks(spark, sf), "apertium", F.lit("job")).withColumn("stream", F.translate("stream", "\0", "|"))


_VISL_STREAM = f"SELECT doc_id, '<STREAMCMD:SPANLOOM:job>' || chr(10) || chr(10) || string_agg({_VISL_SQL}, '' ORDER BY block_no) AS stream FROM ({_IDS_SQL}) GROUP BY doc_id"


@_query(_VISL_STREAM)
def visl_stream(spark, sf):
    return codec.encode(_line_blocks(spark, sf), "visl", F.lit("job"))


@_query(_VISL_STREAM)
def cg_stream(spark, sf):
    return codec.encode(_line_blocks(spark, sf), "cg", F.lit("job"))


_DECODED = "SELECT doc_id, block_id, {} AS body FROM ({})"


@_query(_DECODED.format(_REDUCE_SQL.replace("(x", "(body"), _IDS_SQL))
def apertium_decode(spark, sf):
    streams = codec.encode(_line_blocks(spark, sf), "apertium", F.lit("job"))
    return codec.decode_apertium(codec.frames_of(streams, "stream", "doc_id"), "value", "doc_id")


@_query(_DECODED.format(_REDUCE_SQL.replace("(x", "(body"), _IDS_SQL))
def visl_decode(spark, sf):
    streams = codec.encode(_line_blocks(spark, sf), "visl", F.lit("job"))
    return codec.decode_visl(streams, "stream", "doc_id").drop("seq")


@_query(_DECODED.format(f"body || '{SENTINEL}'", _IDS_SQL))
def cg_decode(spark, sf):
    streams = codec.encode(_line_blocks(spark, sf), "cg", F.lit("job"))
    return codec.decode_visl(streams, "stream", "doc_id", cg=True).drop("seq")


@_query("SELECT doc_id, unnest(['apertium', 'visl']) AS kind, 'a [b]/' || doc_id AS name FROM documents")
def stream_detect(spark, sf):
    name = F.concat(F.lit("a [b]/"), F.col("doc_id").cast("string"))
    heads = F.array(codec.apertium_header(name), F.concat(F.lit("\n"), codec.visl_header(name)))
    each = _docs(spark, sf).select("doc_id", F.explode(heads).alias("head"))
    return each.select("doc_id", codec.stream_kind(F.col("head")).alias("kind"), codec.stream_name(F.col("head")).alias("name"))


# ---- state ----------------------------------------------------------------------------------


@_query("SELECT conv_id AS doc_id, role AS key, text AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS k FROM conversations) WHERE k = 1")
def info_upsert(spark, sf):
    turns = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("key"), F.col("turn").alias("seq"), F.col("text").alias("value"))
    return upsert(turns.filter("seq = 0"), turns.filter("seq > 0"), ["doc_id", "key"], "seq").drop("seq")


def _html(spark: SparkSession, sf: str, **settings) -> engine.State:
    return engine.extract(_dealt_pages(spark, sf), Settings(format="html", **settings), "page_id", "html")


#: The raw pages' texts stand between a start tag and an end tag of their own, or before an unclosed break.
_TEXT_TAGS = "title|h1|p|a|li|div|footer|td|th|blockquote"
_PAGE_TEXT = f"<(?:{_TEXT_TAGS}|b)(?: [^>]*)?>([^<>]+)(?:</(?:{_TEXT_TAGS})>|<br>)"
_PLAIN_TEXT = _replace_sql("x", ("'&quot;'", "'\"'"), ("'&copy;'", "'©'"), ("'&middot;'", "'·'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'"), ("'&amp;'", "'&'"))
_PAGE_BLOCKS = f"""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n))::INT AS block_no, body FROM (
SELECT page_id, n, {_PLAIN_TEXT} AS body FROM (SELECT page_id, unnest(range(len(b))) AS n, unnest(b) AS x FROM (SELECT page_id, regexp_extract_all(html, {_q(_PAGE_TEXT)}, 1) AS b FROM pages)))
WHERE regexp_matches(body, {_q(CONTENT)})"""
_BLOCK_COLUMNS = ("page_id", "block_no", "block_id", "kind", "attr_name", "is_header", "body")
_PAGE_BLOCK_ROWS = f"SELECT page_id, block_no, block_no || '-' || {short_hash_sql('body')} AS block_id, 'text' AS kind, NULL AS attr_name, false AS is_header, body FROM ({_PAGE_BLOCKS})"


@_query(_PAGE_BLOCK_ROWS)
def html_blocks(spark, sf):
    return _html(spark, sf, stream="visl").blocks.select(*_BLOCK_COLUMNS)


@_query(_PAGE_BLOCK_ROWS)
def html_blocks_apertium(spark, sf):
    return _html(spark, sf).blocks.select(*_BLOCK_COLUMNS)


@_query(f"SELECT page_id, count(*) AS n_blocks, sum(length(body))::BIGINT AS n_chars FROM ({_PAGE_BLOCKS}) GROUP BY page_id")
def html_blocks_per_page(spark, sf):
    return _html(spark, sf, stream="visl").blocks.groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("body")).cast("long").alias("n_chars"))


@_query(f"SELECT page_id, {_replace_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)", *((b, a) for a, b in reversed(_FIVE)))} AS body FROM pages WHERE regexp_matches(html, '<h1>')")
def header_marks(spark, sf):
    return _html(spark, sf, stream="visl", mark_headers=True).blocks.filter("is_header").select("page_id", "body")


@_query(f"""SELECT 'U' AS tag, {short_hash_sql(f"otag || '{HASH_SEP}'")} AS hash, otag, '' AS ctag, '' AS flags, pages FROM (
SELECT otag, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, {_q(formats.RAW_BODIES)}, 1)) AS otag FROM pages) GROUP BY otag)""")
def style_dictionary(spark, sf):
    """Styles of all pages, each with the number of pages that use it."""
    return _html(spark, sf, stream="visl").styles.groupBy("tag", "hash", "otag", "ctag", "flags").agg(F.count("*").alias("pages"))


_closed_sql = lambda x: f"regexp_replace({x}, '<br>(<p>|</article>|</body>|$)', '<br></b></p>\\1', 'g')"
_letters_sql = lambda x: _replace_sql(x, ("'&quot;'", "'\"'"), ("'&copy;'", "'©'"), ("'&middot;'", "'·'"))
_UTF8_SQL = "regexp_replace(html, '(charset=\")utf-8\"', '\\1UTF-8\"')"


@_query(f"""SELECT page_id, CASE WHEN whole THEN 'html' ELSE 'html-fragment' END AS format, CASE WHEN whole
THEN replace({_letters_sql(_closed_sql(_UTF8_SQL))}, '<!DOCTYPE html>', '<!DOCTYPE html>' || chr(10)) || chr(10)
ELSE regexp_replace(regexp_replace({_letters_sql(_closed_sql('html'))}, '<!DOCTYPE html><html[^>]*><head>', ''), '</?(?:html|head|body)(?: [^>]*)?>', '', 'g') END AS text
FROM (SELECT *, contains(lower(html), '</html>') AS whole FROM pages)""")
def html_clean(spark, sf):
    return engine.clean(_dealt_pages(spark, sf), Settings(stream="visl"), "page_id", "html").select("page_id", "format", "text")


@_query(f"SELECT doc_id, {rewrite_sql('text', [('­', '')])} AS text FROM documents")
def line_clean(spark, sf):
    return engine.clean(_docs(spark, sf), Settings(format="line", stream="visl")).select("doc_id", "text")


_TEXT_BREAK = "\n[ \\t]*(?:\n[ \\t]*)+"


@_query(f"SELECT doc_id, regexp_replace({rewrite_sql('text', [('­', '')])}, {_q(_TEXT_BREAK)}, chr(10) || chr(10), 'g') AS text FROM documents")
def text_clean(spark, sf):
    return engine.clean(_docs(spark, sf), Settings(format="text", stream="visl")).select("doc_id", "text")


_SHOUT = "translate({}, 'aeiou', 'AEIOU')"


def _injected_sql(change: str) -> str:
    return f"SELECT doc_id, string_agg(CASE WHEN has THEN {change} ELSE body END, chr(10) ORDER BY place) AS text FROM (SELECT doc_id, place, body, has, count(*) FILTER (WHERE has) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id, has ORDER BY place) AS k FROM (SELECT doc_id, place, {rewrite_sql('part', [('­', '')])} AS body, regexp_matches(body, {_q(CONTENT)}) AS has FROM ({_LINES}))) GROUP BY doc_id"


def _line_state(spark: SparkSession, sf: str) -> engine.State:
    """Saved, so that blocks and documents come of one extraction."""
    return engine.extract(_dealt_docs(spark, sf), Settings(format="line", stream="visl")).save(scratch(spark, "state"))


def _shouted(state: engine.State) -> DataFrame:
    return state.blocks.select("doc_id", "block_id", "block_no", F.translate("body", "aeiou", "AEIOU").alias("body"))


@_query(_injected_sql("body"))
def inject_identity(spark, sf):
    state = _line_state(spark, sf)
    return engine.inject(state, state.blocks.select("doc_id", "block_id", "body")).select("doc_id", "text")


@_query(_injected_sql(_SHOUT.format("body")))
def inject_all(spark, sf):
    state = _line_state(spark, sf)
    return engine.inject(state, _shouted(state)).select("doc_id", "text")


@_query(_injected_sql(f"CASE WHEN contains(body, 'r') THEN {_SHOUT.format('body')} ELSE body END"))
def inject_partial(spark, sf):
    state = _line_state(spark, sf)
    return engine.inject(state, _shouted(state).filter(F.col("body").contains("r"))).select("doc_id", "text")


@_query(_injected_sql(f"CASE WHEN k = n THEN {_SHOUT.format('body')} ELSE body END"))
def inject_out_of_order(spark, sf):
    """Blocks arrive last first: in order, the last block alone is taken."""
    state = _line_state(spark, sf)
    arrivals = _shouted(state).withColumn("seq", -F.col("block_no"))
    return engine.inject(state, arrivals, ordered=True).select("doc_id", "text")


# ---- XML and office formats: documents as such files, one paragraph a line ------------------


def _members(fmt: str, text: str) -> dict[str, str]:
    lines = [escape(x) for x in text.split("\n")]
    if fmt == "docx":
        return {office.DOCX_MAIN: f"<w:document><w:body>{''.join(f'<w:p><w:r><w:t>{x}</w:t></w:r></w:p>' for x in lines)}</w:body></w:document>"}
    if fmt == "pptx":
        return {f"ppt/slides/slide{i + 1}.xml": f"<p:sld><a:p><a:r><a:t>{x}</a:t></a:r></a:p></p:sld>" for i, x in enumerate(lines)}
    return {"content.xml": f"<office:body>{''.join(f'<text:p>{x}</text:p>' for x in lines)}</office:body>"}


def _packed(docs: DataFrame, fmt: str) -> DataFrame:
    """doc_id, content: documents as office files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
                    for name, xml in _members(fmt, text or "").items():
                        z.writestr(name, xml.encode("utf-8", "surrogatepass"))
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return docs.mapInArrow(run, "doc_id long, content binary")


_PLAIN_LINES = _numbered(_LINES, CONTENT).replace(rewrite_sql("part", formats.SOFT_HYPHENS), "part")


def _office(fmt: str) -> None:
    def query(spark, sf):
        return engine.extract(_packed(_dealt_docs(spark, sf), fmt), Settings(stream="visl"), content="content").blocks.select("doc_id", "block_no", "body")

    query.__name__ = f"{fmt}_blocks"
    _query(_PLAIN_LINES)(query)


for _fmt in ("docx", "pptx", "odt"):
    _office(_fmt)


@_query(_PLAIN_LINES)
def tei_blocks(spark, sf):
    body = F.concat(F.lit("<TEI><text><p>"), F.replace(tx.xml_escape(F.col("text")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></text></TEI>"))
    return engine.extract(_dealt_docs(spark, sf).select("doc_id", body.alias("text")), Settings(stream="visl")).blocks.select("doc_id", "block_no", "body")


_ODT_STYLES_SQL = """SELECT doc_id, place::INT AS place, 's' || place AS style, 's' || min(place) OVER (PARTITION BY doc_id, part) AS kept
FROM (SELECT doc_id, unnest(range(len(p))) AS place, unnest(p) AS part FROM (SELECT doc_id, string_split(text, ' ') AS p FROM documents))"""


@_query(_ODT_STYLES_SQL)
def odt_style_dedup(spark, sf):
    """Each word of a document as a style: equal words are one style."""
    words = F.transform(F.split("text", " ", -1), lambda w, k: F.concat(F.lit('<style:style style:name="s'), k.cast("string"), F.lit('" v="'), tx.xml_escape(w), F.lit('"></style:style>')))
    return formats.odt_styles(_dealt_docs(spark, sf).select("doc_id", F.array_join(words, "").alias("xml")), "doc_id", F.col("xml"))


@_query(f"SELECT doc_id, {rewrite_sql('text', [('([a-z]) ', '$1<lb/>')])} AS text FROM documents")
def tei_lb_round_trip(spark, sf):
    padded = rewrite(F.col("text"), [("([a-z]) ", "$1<lb/>"), *formats.LB_RULES])
    return _docs(spark, sf).select("doc_id", rewrite(padded, formats.TEI_UNDO).alias("text"))
