"""Queries over whole documents of each format, built from the lines of ``documents``, and their SQL.

Each line with content becomes an element whose kind follows its number; the
SQL knows from the kind what the engine must find in it or make of it.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import _BODY_SQL, _FIVE, _IDS_SQL, _LINES, _SHOUT, _dealt_docs, _docs, _line_blocks, _q, _query, _replace_sql, _scalar, _with_ids, _blocks
from .functions import text as tx
from .functions.hashing import short_hash_sql
from .functions.markers import BLANK, CLOSE, CONTENT, HASH_SEP, NAME_B, NAME_E, OPEN_B, OPEN_E, PROT_B, PROT_E, rewrite, rewrite_sql
from .operators import detect, formats, office, spans
from .plans import engine
from .plans.engine import Settings
from .sources.tables import INFO_DDL, read_files, read_table, scratch, small_batches, upsert, value_of, write_lines
from .streaming import codec

# ---- lines as elements ----------------------------------------------------------------------

#: doc_id, k (from 0), x: lines with content, trimmed, without soft hyphens.
_X = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS k,
regexp_replace(regexp_replace(replace(part, '­', ''), {_q(f'^{BLANK}+')}, ''), {_q(f'{BLANK}+$')}, '') AS x
FROM ({_LINES}) WHERE regexp_matches(part, {_q(CONTENT)})"""


def _elements(kinds: list, first: int = 0) -> Column:
    """The document's lines as elements, by number; a kind is a function of the escaped line and its number."""
    plain = F.replace("text", F.lit("­"), F.lit(""))
    trimmed = F.transform(F.split(plain, "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, f"^{BLANK}+", ""), f"{BLANK}+\\z", ""))
    lines = F.filter(trimmed, lambda x: x.rlike(CONTENT))

    def one(x: Column, k: Column) -> Column:
        e, out = tx.xml_escape(x), F.lit("")
        chosen = None
        for i, kind in enumerate(kinds):
            value = kind(e, k.cast("string"))
            chosen = F.when(k % len(kinds) == i, value) if chosen is None else chosen.when(k % len(kinds) == i, value)
        return F.coalesce(chosen, out)

    return F.array_join(F.transform(lines, one), "")


def _c(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _hash(otag: str, ctag: str) -> str:
    return short_hash_sql(_q(otag + HASH_SEP + ctag))


def _span_sql(tags: str, body: str) -> str:
    return f"'{OPEN_B}' || {tags} || '{OPEN_E}' || {body} || '{CLOSE}'"


#: Escapes of texts and of attributes in HTML that the engine writes, and of texts in XML.
_TEXT = lambda x: _replace_sql(x, ("'&'", "'&amp;'"), ("'<'", "'&lt;'"), ("'>'", "'&gt;'"))
_ATTR = lambda x: _replace_sql(x, ("'&'", "'&amp;'"), ("'\"'", "'&quot;'"), ("'<'", "'&lt;'"), ("'>'", "'&gt;'"))

# ---- HTML -----------------------------------------------------------------------------------

_BR, _NOTE = '<br tf-space-before=" " tf-space-after=" "/>', "<!-- n -->"
_B, _I, _I_AFTER = '<b tf-space-before=" " tf-space-after=" ">', "<i>", '<i tf-space-after=" ">'
_SCRIPT = "if (a < 1 && b) { x(); }"
_HTML_HEAD = '<!DOCTYPE html>\n<html><head><meta charset="{}"><title>Doc '
_HTML_BODY = f"</title><script>{_SCRIPT}</script></head><body>\n"
_HTML_TAIL = "</body></html>\n"
_KINDS = [
    lambda e, k: _c('<h2 title="Über ', k, '">', e, "</h2>\n"),
    lambda e, k: _c("<p>", e, "</p>\n"),
    lambda e, k: _c("<p>Lead <b>", e, "</b> tail</p>\n"),
    lambda e, k: _c("<pre>", e, "</pre>\n"),
    lambda e, k: _c('<ul><li><a href="#1">', e, "</a></li></ul>\n"),
    lambda e, k: _c("<p>", e, " <br> next</p>\n"),
    lambda e, k: _c('<p><img alt="', e, '"></p>\n'),
    lambda e, k: _c("<p>a <b><i>", e, "</i></b> c</p>\n"),
    lambda e, k: _c("<p>in<i>side</i> ", e, "</p>\n"),
    lambda e, k: _c("<p>One <!-- n -->two <![CDATA[", F.lit("&amp; <x>"), "]]> ", e, "</p>\n"),
]


def _html_docs(spark, sf) -> DataFrame:
    page = _c(_HTML_HEAD.format("latin1"), F.col("doc_id").cast("string"), _HTML_BODY, _elements(_KINDS), _HTML_TAIL)
    return _dealt_docs(spark, sf).select("doc_id", page.alias("text"))


_HASHES = f"SELECT {_hash(_B, '</b>')} AS hb, {_hash(_I, '</i>')} AS hi, {_hash(_I_AFTER, '</i>')} AS ha, {_hash(_BR, '')} AS hbr, {_hash(_NOTE, '')} AS hn, {_hash(_SCRIPT, '')} AS hs"


def _html_blocks_sql(region) -> str:
    body = f"""CASE k % 10 WHEN 2 THEN 'Lead ' || {_span_sql("'b:' || hb", 'x')} || ' tail' WHEN 5 THEN x || ' ' || {region('hbr', 'br')} || ' next'
WHEN 7 THEN 'a ' || {_span_sql("'b:' || hb || ';i:' || hi", 'x')} || ' c' WHEN 8 THEN {_span_sql("'i:' || ha", "'inside'")} || ' ' || x
WHEN 9 THEN 'One ' || {region('hn', 'xml-special')} || 'two &amp; <x> ' || x ELSE x END"""
    return f"""WITH h AS ({_HASHES}), p AS ({_X}), b AS (
SELECT doc_id, -1 AS k, 0 AS s, 'text' AS kind, NULL AS attr_name, false AS is_header, 'Doc ' || doc_id AS body FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, k, 0, 'attribute', CASE k % 10 WHEN 0 THEN 'title' ELSE 'alt' END, k % 10 = 0, CASE k % 10 WHEN 0 THEN 'Über ' || k ELSE x END FROM p WHERE k % 10 IN (0, 6)
UNION ALL SELECT doc_id, k, 1, 'text', NULL, k % 10 = 0, {body} FROM p, h WHERE k % 10 NOT IN (3, 6))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, s))::INT AS block_no, kind, attr_name, is_header, body FROM b"""


_VISL_REGION = lambda h, name: _span_sql(f"'P:' || {h}", f"'{NAME_B}{name}{NAME_E}'")
_APERTIUM_REGION = lambda h, name: f"'{PROT_B}P:' || {h} || '{PROT_E}'"


def _page_blocks(spark, sf, stream: str) -> DataFrame:
    state = engine.extract(_html_docs(spark, sf), Settings(stream=stream, mark_headers=True))
    return state.blocks.select("doc_id", "block_no", "kind", "attr_name", "is_header", "body")


@_query(_html_blocks_sql(_VISL_REGION))
def page_blocks(spark, sf):
    return _page_blocks(spark, sf, "visl")


@_query(_html_blocks_sql(_APERTIUM_REGION))
def page_blocks_apertium(spark, sf):
    return _page_blocks(spark, sf, "apertium")


def _styles_sql(rows: list[tuple[str, str, str, str, str, str]], source: str) -> str:
    """rows: SQL of the hash, tag, otag, ctag, flags, condition on k."""
    each = " UNION ALL ".join(f"SELECT {_q(tag)} AS tag, {h} AS hash, {_q(o)} AS otag, {_q(c)} AS ctag, {_q(f)} AS flags, (SELECT count(DISTINCT doc_id) FROM ({source}) WHERE {cond}) AS docs" for h, tag, o, c, f, cond in rows)
    return f"SELECT * FROM ({each}) WHERE docs > 0"


@_query(
    f"WITH p AS ({_X}) "
    + _styles_sql(
        [(_hash(_B, "</b>"), "b", _B, "</b>", "", "k % 10 IN (2, 7)"), (_hash(_I, "</i>"), "i", _I, "</i>", "", "k % 10 = 7"), (_hash(_I_AFTER, "</i>"), "i", _I_AFTER, "</i>", "", "k % 10 = 8"), (_hash(_BR, ""), "P", _BR, "", "P", "k % 10 = 5"), (_hash(_NOTE, ""), "P", _NOTE, "", "P", "k % 10 = 9")],
        "SELECT * FROM p",
    )
    + f" UNION ALL SELECT 'U', {_hash(_SCRIPT, '')}, {_q(_SCRIPT)}, '', '', count(*) FROM documents WHERE text IS NOT NULL"
)
def page_styles(spark, sf):
    styles = engine.extract(_html_docs(spark, sf), Settings(stream="visl")).styles
    return styles.groupBy("tag", "hash", "otag", "ctag", "flags").agg(F.count_distinct("doc_id").alias("docs"))


def _html_page_sql(change: str = "x", tail: str = "tail") -> str:
    """The page that the engine writes; ``change`` of a text without spans, ``tail`` of the bold one's end."""
    t, plain = _TEXT("x"), _TEXT(change)
    element = f"""CASE k % 10 WHEN 0 THEN '<h2 title="Über ' || k || '">' || {plain} || '</h2>' WHEN 1 THEN '<p>' || {plain} || '</p>' WHEN 2 THEN '<p>Lead <b>' || {t} || '</b> {tail}</p>'
WHEN 3 THEN '<pre>' || {t} || '</pre>' WHEN 4 THEN '<ul><li><a href="#1">' || {plain} || '</a></li></ul>' WHEN 5 THEN '<p>' || {t} || ' <br> next</p>' WHEN 6 THEN '<p><img alt="' || {_ATTR('x')} || '"></p>'
WHEN 7 THEN '<p>a <b><i>' || {t} || '</i></b> c</p>' WHEN 8 THEN '<p><i>inside</i> ' || {t} || '</p>' ELSE '<p>One <!-- n -->two &amp;amp; &lt;x&gt; ' || {t} || '</p>' END || chr(10)"""
    return f"""WITH p AS ({_X}) SELECT d.doc_id, {_q(_HTML_HEAD.format('UTF-8'))} || d.doc_id || {_q(_HTML_BODY)} || coalesce(b, '') || {_q(_HTML_TAIL)} AS text
FROM documents d LEFT JOIN (SELECT doc_id, string_agg({element}, '' ORDER BY k) AS b FROM p GROUP BY doc_id) USING (doc_id) WHERE d.text IS NOT NULL"""


@_query(_html_page_sql())
def page_clean(spark, sf):
    return engine.clean(_html_docs(spark, sf).filter("text IS NOT NULL"), Settings(stream="visl")).select("doc_id", "text")


@_query(_html_page_sql(_SHOUT.format("x"), "fin &amp; &lt;"))
def page_inject(spark, sf):
    """New texts for all texts without spans, with a stray marker that goes, and for the end of each bold one."""
    state = engine.extract(_html_docs(spark, sf).filter("text IS NOT NULL"), Settings(stream="visl")).save(scratch(spark, "state"))
    body = F.col("body")
    plain = (F.col("kind") == "text") & ~body.contains(OPEN_B) & ~body.startswith("Doc ")
    bold = body.startswith("Lead ") & body.endswith(" tail") & body.contains(f"{OPEN_B}b:")
    new = F.when(plain, F.concat(F.translate(body, "aeiou", "AEIOU"), F.lit(CLOSE))).when(bold, F.concat(F.expr("substring(body, 1, length(body) - 4)"), F.lit("fin & <")))
    return engine.inject(state, state.blocks.select("doc_id", "block_id", new.alias("body")).filter("body IS NOT NULL")).select("doc_id", "text")


_FRAGMENT = "WITH p AS ({}) SELECT doc_id, string_agg('<p>' || {} || '</p>', '' ORDER BY k) AS text FROM p GROUP BY doc_id"


@_query(_FRAGMENT.format(_X, _TEXT("x")))
def fragment_clean(spark, sf):
    body = _dealt_docs(spark, sf).select("doc_id", _elements([lambda e, k: _c("<p>", e, "</p>")]).alias("text")).filter("text <> ''")
    return engine.clean(body, Settings(stream="visl")).select("doc_id", "text")


@_query(f"""WITH p AS ({_X}), h AS (SELECT {_hash('<x tf-space-before=" " tf-space-after=" ">', '</x>')} AS hx), b AS (
SELECT doc_id, k, 'a ' || {_span_sql("'x:' || hx", 'x')} || ' b' AS body FROM p, h WHERE k % 2 = 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k))::INT AS block_no, body FROM b""")
def tag_overrides(spark, sf):
    """An own inline tag, and texts of paragraphs alone: what stands right in a div or list is no block."""
    kinds = [lambda e, k: _c("<p>a <x>", e, "</x> b</p>"), lambda e, k: _c("<div>", e, "</div>")]
    body = _dealt_docs(spark, sf).select("doc_id", _elements(kinds).alias("text")).filter("text <> ''")
    settings = Settings(format="html-fragment", stream="visl", tags={"inline": ["+", "x"], "parents_direct": ["p"]})
    return engine.extract(body, settings).blocks.select("doc_id", "block_no", "body")


# ---- TEI ------------------------------------------------------------------------------------

_TEI_KINDS = [
    lambda e, k: _c("<p>", e, "</p>"),
    lambda e, k: _c("<p>a <date>", e, "</date> b</p>"),
    lambda e, k: _c("<ab>one<lb/>two ", e, "</ab>"),
    lambda e, k: _c("<x>", e, "</x>"),
]
_TEI_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<TEI><teiHeader><p>no</p></teiHeader><text>'
_TEI_TAIL = "</text></TEI>\n"
_LB = '<lb tf-added-before="1" tf-added-after="1" tf-space-before=" " tf-space-after=" " tf-unique="'


def _tei_docs(spark, sf) -> DataFrame:
    return _dealt_docs(spark, sf).filter("text IS NOT NULL").select("doc_id", _c(_TEI_HEAD, _elements(_TEI_KINDS), _TEI_TAIL).alias("text"))


_LB_HASH = short_hash_sql(f"{_q(_LB)} || nth || '\"/>{HASH_SEP}'")


@_query(f"""WITH p AS ({_X}), h AS (SELECT {_hash('<date tf-space-before=" " tf-space-after=" ">', '</date>')} AS hd), b AS (
SELECT doc_id, k, CASE k % 4 WHEN 0 THEN x WHEN 1 THEN 'a ' || {_span_sql("'date:' || hd", 'x')} || ' b' ELSE 'one ' || {_VISL_REGION('lbh', 'lb')} || ' two ' || x END AS body
FROM (SELECT *, {_LB_HASH} AS lbh FROM (SELECT *, k // 4 + 1 AS nth FROM p)), h WHERE k % 4 < 3)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k))::INT AS block_no, body FROM b""")
def tei_page_blocks(spark, sf):
    return engine.extract(_tei_docs(spark, sf), Settings(stream="visl")).blocks.select("doc_id", "block_no", "body")


@_query(f"""WITH p AS ({_X}) SELECT d.doc_id, {_q(_TEI_HEAD)} || coalesce(b, '') || {_q(_TEI_TAIL)} AS text FROM documents d LEFT JOIN (
SELECT doc_id, string_agg(CASE k % 4 WHEN 0 THEN '<p>' || {_TEXT('x')} || '</p>' WHEN 1 THEN '<p>a <date>' || {_TEXT('x')} || '</date> b</p>' WHEN 2 THEN '<ab>one<lb/>two ' || {_TEXT('x')} || '</ab>' ELSE '<x>' || {_TEXT('x')} || '</x>' END, '' ORDER BY k) AS b
FROM p GROUP BY doc_id) USING (doc_id) WHERE d.text IS NOT NULL""")
def tei_page_clean(spark, sf):
    return engine.clean(_tei_docs(spark, sf), Settings(stream="visl")).select("doc_id", "text")


# ---- office files with runs -----------------------------------------------------------------

_W_RUN = lambda e, props="": _c(f'<w:r w:rsidR="00A1">{props}<w:t xml:space="preserve">', e, "</w:t></w:r>")
_BOLD = '<w:rPr><w:b/><w:lang w:val="en"/></w:rPr>'
_A_RUN = lambda e, props="": _c(f'<a:r><a:rPr{props} lang="en"/><a:t>', e, "</a:t></a:r>")
_PACKS = {
    "docx": (
        office.DOCX_MAIN,
        "<w:document><w:body>",
        "</w:body></w:document>",
        [
            lambda e, k: _c("<w:p>", _W_RUN(e), "</w:p>"),
            lambda e, k: _c("<w:p>", _W_RUN("One "), _W_RUN(e, _BOLD), "<w:proofErr w:type=\"x\"/></w:p>"),
            lambda e, k: _c("<w:p><w:r><w:t>", e, "</w:t><w:tab/><w:t>end</w:t></w:r></w:p>"),
            lambda e, k: _c("<w:p>", _W_RUN("See "), '<w:hyperlink r:id="7">', _W_RUN(e), "</w:hyperlink></w:p>"),
        ],
    ),
    "pptx": (
        "ppt/slides/slide1.xml",
        "<p:sld>",
        "</p:sld>",
        [
            lambda e, k: _c("<a:p>", _A_RUN(e), "</a:p>"),
            lambda e, k: _c("<a:p>", _A_RUN("An "), _A_RUN(e, ' b="1"'), "</a:p>"),
        ],
    ),
    "odt": (
        "content.xml",
        '<office:body><style:style style:name="S1" v="1"></style:style><style:style style:name="S2" v="1"></style:style>',
        "</office:body>",
        [
            lambda e, k: _c("<text:p>", e, "</text:p>"),
            lambda e, k: _c('<text:h>a <text:span text:style-name="S2" fo:language="en">', e, "</text:span> b</text:h>"),
            lambda e, k: _c("<x>", e, "</x>"),
        ],
    ),
}


def _packed_runs(spark, sf, fmt: str) -> DataFrame:
    """doc_id, content: documents as office files with runs."""
    member, head, tail, kinds = _PACKS[fmt]
    docs = _dealt_docs(spark, sf).filter("text IS NOT NULL").select("doc_id", _c(head, _elements(kinds), tail).alias("xml"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for xml in b.column(1).to_pylist():
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
                    z.writestr(member, xml.encode("utf-8", "surrogatepass"))
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return docs.mapInArrow(run, "doc_id long, content binary")


def _office_sql(hashes: str, rows: str) -> str:
    return f"WITH p AS ({_X}), h AS (SELECT {hashes}), b AS ({rows}) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, s))::INT AS block_no, body FROM b"


_OFFICE_SQL = {
    "docx": _office_sql(
        f"{_hash('<w:r><w:rPr><w:b/></w:rPr><w:t>', '</w:t></w:r>')} AS hb, {_hash('<w:hyperlink r:id=\"7\">', '</w:hyperlink>')} AS ha",
        f"SELECT doc_id, k, 0 AS s, CASE k % 4 WHEN 1 THEN 'One ' || {_span_sql("'b:' || hb", 'x')} WHEN 3 THEN 'See ' || {_span_sql("'a:' || ha", 'x')} ELSE x END AS body FROM p, h UNION ALL SELECT doc_id, k, 1, 'end' FROM p WHERE k % 4 = 2",
    ),
    "pptx": _office_sql(
        f"{_hash('<a:r><a:t>', '</a:t></a:r>')} AS ht, {_hash('<a:r><a:rPr b=\"1\"/><a:t>', '</a:t></a:r>')} AS hb",
        f"SELECT doc_id, k, 0 AS s, CASE k % 2 WHEN 1 THEN {_span_sql("'text:' || ht", "'An'")} || ' ' || {_span_sql("'b:' || hb", 'x')} ELSE x END AS body FROM p, h",
    ),
    "odt": _office_sql(
        f"{_hash('<text:span text:style-name=\"S1\" tf-space-before=\" \" tf-space-after=\" \">', '</text:span>')} AS hs",
        f"SELECT doc_id, k, 0 AS s, CASE k % 3 WHEN 1 THEN 'a ' || {_span_sql("'span:' || hs", 'x')} || ' b' ELSE x END AS body FROM p, h WHERE k % 3 < 2",
    ),
}


def _office_runs(fmt: str) -> None:
    def blocks(spark, sf):
        return engine.extract(_packed_runs(spark, sf, fmt), Settings(stream="visl"), content="content").blocks.select("doc_id", "block_no", "body")

    def again(spark, sf):
        """Blocks of the files that cleaning writes."""
        written = engine.clean(_packed_runs(spark, sf, fmt), Settings(stream="visl"), content="content").select("doc_id", "content")
        return engine.extract(written, Settings(stream="visl"), content="content").blocks.select("doc_id", "block_no", "body")

    def injected(spark, sf):
        """Blocks of the files that injection writes: each block's first letters changed outside its spans."""
        state = engine.extract(_packed_runs(spark, sf, fmt), Settings(stream="visl"), content="content").save(scratch(spark, "state"))
        new = state.blocks.select("doc_id", "block_id", F.concat(F.lit("New "), "body").alias("body"))
        out = engine.inject(state, new).select("doc_id", "content")
        return engine.extract(out, Settings(stream="visl"), content="content").blocks.select("doc_id", "block_no", "body")

    blocks.__name__, again.__name__, injected.__name__ = f"{fmt}_run_blocks", f"{fmt}_run_clean", f"{fmt}_run_inject"
    _query(_OFFICE_SQL[fmt])(blocks)
    _query(_OFFICE_SQL[fmt])(again)
    if fmt != "pptx":  # there a text without a run gets one, and so a span of its own
        _query(_OFFICE_SQL[fmt].replace("body FROM b", "'New ' || body AS body FROM b"))(injected)


for _fmt in _PACKS:
    _office_runs(_fmt)


@_query("SELECT doc_id, format FROM documents, (SELECT unnest(['docx', 'pptx', 'odt']) AS format) WHERE text IS NOT NULL")
def zip_formats(spark, sf):
    """Formats found by the members of archives."""
    found = [engine.found_formats(_packed_runs(spark, sf, fmt), Settings(stream="visl"), content="content") for fmt in _PACKS]
    return found[0].unionByName(found[1]).unionByName(found[2])


# ---- scalars, regions, header marks ---------------------------------------------------------

_scalar("left_trim", tx.left_trim, f"regexp_replace(x, {_q(f'^{BLANK}+')}, '')", lambda c: F.concat(F.lit(" \t \n"), c, F.lit("  ")), "' ' || chr(9) || chr(160) || chr(10) || text || chr(8232) || ' '")
_scalar("right_trim", tx.right_trim, f"regexp_replace(x, {_q(f'{BLANK}+$')}, '')", lambda c: F.concat(F.lit(" \t \n"), c, F.lit("  ")), "' ' || chr(9) || chr(160) || chr(10) || text || chr(8232) || ' '")
_scalar("blank_test", tx.is_blank, "len(x) = 1 AND (contains(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160), x))", lambda c: F.substring(c, 12, 1), "substring(text, 12, 1)")
_EDGE = [("([a-z]+) ([a-z]+)", f"<p>{PROT_B}<!-- a -->{PROT_E}$1 {PROT_B}<i/>{PROT_E}$2{PROT_B}<!-- b -->{PROT_E} </p>")]
_RELEASED = [("([a-z]+) ([a-z]+)", f"<p><!-- a -->$1 {PROT_B}<i/>{PROT_E}$2<!-- b --> </p>")]
_scalar("protected_release", lambda c: rewrite(c, spans.PROTECTED_RELEASE), rewrite_sql("x", _RELEASED), lambda c: rewrite(c, _EDGE))


@_query(f"SELECT doc_id, block_no, chr(10) || '[tf-block:' || block_id || ']' || chr(10) || chr(10) || {_BODY_SQL} || (CASE WHEN block_no % 3 = 1 THEN '[]❡' ELSE '' END) || '.[]' || chr(10) AS chunk FROM ({_IDS_SQL})")
def apertium_header_marks(spark, sf):
    blocks = _line_blocks(spark, sf)
    chunk = codec.apertium_block(F.col("block_id"), F.col("body"), F.col("block_no") % 3 == 1)
    return blocks.select("doc_id", "block_no", F.translate(chunk, "\0", "").alias("chunk"))


@_query(f"SELECT doc_id, block_id, trim(body, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM ({_IDS_SQL})")
def apertium_decode_spans(spark, sf):
    """Streams with spans and protected regions come back as they were."""
    body = F.concat(F.lit(f"{OPEN_B}b:AA;i:BB{OPEN_E}x{CLOSE} {PROT_B}P:CC{PROT_E} "), "body")
    blocks = _line_blocks(spark, sf).withColumn("body", body)
    streams = codec.encode(blocks, "apertium", F.lit("job"))
    got = codec.decode_apertium(codec.frames_of(streams, "stream", "doc_id"), "value", "doc_id")
    lead = f"{OPEN_B}b:AA;i:BB{OPEN_E}x{CLOSE} {PROT_B}P:CC{PROT_E} "
    kept = F.when(F.col("body").startswith(lead), F.expr(f"substring(body, {len(lead) + 1})"))
    return got.select("doc_id", "block_id", tx.trim_ascii(kept).alias("body"))


# ---- state and files ------------------------------------------------------------------------


@_query(f"SELECT doc_id, block_no, block_id, body FROM ({_IDS_SQL})")
def state_reload(spark, sf):
    """An extraction that is kept is used again."""
    settings, path = Settings(format="line", stream="visl"), scratch(spark, "state")
    engine.extract(_dealt_docs(spark, sf), settings).save(path)
    return engine.State.load(spark, path, settings).blocks.select("doc_id", "block_no", "block_id", "body")


@_query(f"SELECT part AS line, count(*) AS n FROM ({_LINES}) GROUP BY part")
def lines_through_files(spark, sf):
    """Lines written as text files, and read back as whole files."""
    small_batches(spark)
    path = scratch(spark, "lines")
    write_lines(_docs(spark, sf).select(F.explode(F.split("text", "\n", -1)).alias("line")), "line", path)
    text = F.expr("substring(text, 1, length(text) - 1)")  # without the last line end
    files = read_files(spark, f"{path}/part-*").select(detect.decoded(F.col("content")).alias("text"), "name").filter("text <> ''")
    return files.select(F.explode(F.split(text, "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


@_query("SELECT max_by(text, turn) AS value FROM conversations WHERE conv_id = 3 AND role = 'user'")
def info_lookup(spark, sf):
    turns = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("key"), F.col("text").alias("value"), F.col("turn").alias("seq"))
    empty = spark.createDataFrame([], INFO_DDL + ", seq " + dict(turns.dtypes)["seq"])
    return value_of(upsert(empty, turns, ["doc_id", "key"], "seq"), 3, "user")
