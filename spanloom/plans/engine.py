"""Extract, inject and clean: whole plans over tables of documents.

A document is one row and makes one trip through Python, as an Arrow batch;
detection and decoding before it, and everything relational after it, stay in
the JVM. ``clean`` needs no shuffle. ``inject`` shuffles on the document's id.

Defined results: a null content has no blocks and renders as null. An unknown
format, or a document that can't be opened, keeps its bytes and has no blocks.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markers import BLOCK_B, BLOCK_E, BLOCK_M, BLOCK_N, rewrite_text, shielded, unshielded
from ..operators import detect, formats, office
from ..operators.spans import expand_text, normalise_text
from ..sources.tables import small_batches
from ..operators.tree import Found, Node, TagClasses, changing, escape, finish, keep_regions, parse, restore_spaces


@dataclass(frozen=True)
class Settings:
    """How to extract and inject. ``tags``: class name to names, with ``+`` to append."""

    format: str = "auto"
    stream: str = "apertium"
    mark_headers: bool = False
    extend: bool = True
    extract_more: bool = False
    mangle_xml: bool = False
    inject_raw: bool = False
    tags: dict[str, list[str]] = field(default_factory=dict)
    #: Edits the rendered markup or text before it is packed.
    hook: Callable[[str], str] | None = None

    def __post_init__(self) -> None:
        if self.format not in ("auto", *detect.FORMATS):
            raise ValueError(f"no format {self.format}; there are auto, {', '.join(detect.FORMATS)}")
        if self.stream not in ("apertium", "visl", "cg"):
            raise ValueError(f"no stream format {self.stream}")

    @functools.cached_property
    def _classes(self) -> dict[str, TagClasses]:
        return {}

    def classes(self, fmt: str) -> TagClasses:
        if fmt not in self._classes:
            self._classes[fmt] = self._made(fmt)
        return self._classes[fmt]

    def _made(self, fmt: str) -> TagClasses:
        base = {"tei": formats.TEI_TAGS, "odt": formats.ODT_TAGS, "odp": formats.ODT_TAGS, "docx": formats.DOCX_TAGS, "pptx": formats.PPTX_TAGS}.get(fmt, formats.HTML_TAGS)
        if self.mark_headers and base is formats.HTML_TAGS:
            base = base.overridden(formats.HTML_HEADERS)
        return base.overridden(self.tags)


_BLOCK = "block_no int, block_id string, kind string, attr_name string, is_header boolean, body string, place int"
_STYLE = "tag string, hash string, otag string, ctag string, flags string"
_EXTRACTED = f"format string, doctype boolean, skeleton string, original binary, blocks array<struct<{_BLOCK.replace(' ', ':').replace(',:', ', ')}>>, styles array<struct<{_STYLE.replace(' ', ':').replace(',:', ', ')}>>"
_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_as_struct = lambda ddl: pa.list_(pa.struct([(n, _KINDS[t]) for n, t in (c.split(" ") for c in ddl.split(", "))]))
_EXTRACTED_ARROW = [("format", pa.string()), ("doctype", pa.bool_()), ("skeleton", pa.string()), ("original", pa.binary()), ("blocks", _as_struct(_BLOCK)), ("styles", _as_struct(_STYLE))]
_RENDERED_ARROW = [("format", pa.string()), ("text", pa.string()), ("content", pa.binary())]
ZIPPED = ("docx", "pptx", "odt", "odp")


def _page_format(fmt: str, text: str) -> str:
    return "html-fragment" if fmt == "html" and formats.is_cut(text) else fmt


def format_one(fmt: str, text: str | None, content: bytes | None) -> str:
    """The format that ``extract_one`` finds, without extraction: an archive's members are read, none is parsed."""
    if fmt == "zip":
        return office.zip_format(office.members(content or b""))
    return fmt if text is None or fmt in ZIPPED else _page_format(fmt, shielded(text))


def extract_one(fmt: str, text: str | None, content: bytes | None, s: Settings, want: str = "all") -> tuple[str, Found]:
    """The format and what is found in one document; ``want``: blocks, or styles, if nothing else is asked for."""
    found = Found()

    def done(styled: str, pairs: bool = False) -> None:
        if want != "styles":
            finish(styled, classes, found, s.extend, s.extract_more, s.mangle_xml, pairs, skeleton=want == "all")

    if fmt in ("zip", *ZIPPED):
        parts = office.members(content or b"")
        fmt = office.zip_format(parts) if fmt == "zip" else fmt
        classes = s.classes(fmt)
        if fmt == "docx" and (main := office.docx_main(parts)):
            done(office.styled_runs(shielded(office.undeclared(parts[main])), "w", found, s.extend))
        elif fmt == "pptx" and (names := office.slides(parts)):
            xml = "<tf-slides>" + "".join(shielded(office.undeclared(parts[n])) for n in names) + "</tf-slides>"
            done(office.styled_runs(xml, "a", found, s.extend))
        elif fmt in ("odt", "odp") and parts.get("content.xml"):
            xml = formats.same_odt_styles(rewrite_text(shielded(office.undeclared(parts["content.xml"])), formats.ODT_CHAFF))
            done(keep_regions(formats.styled_tree(parse(xml), classes, found), s.stream, found))
        return fmt, found
    if text is None:
        return fmt, found
    text = shielded(text)
    fmt = _page_format(fmt, text)
    if fmt == "line" and not s.tags:
        formats.line_blocks(text, found, s.extract_more, s.mangle_xml)
        return fmt, found
    classes = s.classes(fmt)
    if fmt == "tei":
        styled = formats.styled_tree(parse(formats.lb_apart(text)), classes, found, pairs=True)
    else:
        styled = formats.styled_html(formats.text_as_html(text, fmt == "line") if fmt in ("text", "line") else text, s.stream, classes, found)
    done(keep_regions(styled, s.stream, found), pairs=fmt == "tei")
    return fmt, found


_PLACE = re.compile(f"{BLOCK_B}([^{BLOCK_M}]*){BLOCK_M}(.*?){BLOCK_N}\\1{BLOCK_E}", re.S)
#: Block markers that do not pair.
_LEFT = re.compile(f"{BLOCK_B}[^{BLOCK_M}{BLOCK_N}]*{BLOCK_M}|{BLOCK_N}[^{BLOCK_E}]*{BLOCK_E}|[{BLOCK_B}{BLOCK_M}{BLOCK_N}{BLOCK_E}]")


def fill(skeleton: str, new: dict[str, str] | None, s: Settings) -> str:
    """The skeleton with texts in the blocks' places: new ones, or their own."""

    def text(m: re.Match) -> str:
        body = (new or {}).get(m[1])
        return m[2] if body is None else body if s.inject_raw else escape(body, lines=s.stream == "cg")

    return _LEFT.sub("", _PLACE.sub(text, skeleton))


def render_one(fmt: str, doctype: bool, skeleton: str, styles: dict, new: dict[str, str] | None, original: bytes | None, s: Settings) -> tuple[str | None, bytes | None]:
    """The document with new texts for its blocks; blocks without one keep theirs."""
    if skeleton == "":
        return None, original
    edit = s.hook or (lambda x: x)
    hook = lambda x: edit(unshielded(x))
    if fmt == "line" and not s.inject_raw and (lines := formats.lines_out(skeleton, new or {}, s.stream != "apertium")) is not None:
        return hook(lines), None
    root = _rendered(skeleton, styles, new, s, added=fmt != "tei")
    if fmt in ZIPPED:
        back = {"docx": office.docx_out, "pptx": office.pptx_out}.get(fmt, office.odt_out)
        return None, back(root, original, hook)
    if fmt == "tei":
        return hook(formats.tei_out(root)), None
    if fmt in ("text", "line"):
        return hook(formats.text_out(root, fmt == "line")), None
    return _page_out(fmt, root, doctype, styles, s), None


def clean_page(fmt: str, text: str, s: Settings) -> tuple[str, str] | None:
    """The format and the page with normalised spans, by one tree: what ``extract_one`` and ``render_one`` make of it.

    Spans that no rule changes come back as the elements they were, and so do all other elements; only elements with
    other spans go the long way, each by itself, as no rule reaches beyond a tag. None if the page is not of that kind.
    """
    text = shielded(text)
    fmt = _page_format(fmt, text)
    if fmt not in ("html", "html-fragment") or s.stream == "apertium":
        return None
    found, classes = Found(), s.classes(fmt)
    html = formats.page_markup(text, found)
    if "tf-" in html:  # notes of its own, and those of rewrites
        return None
    root = parse(html, html=True)
    units = changing(root, classes)
    if units is None:
        return None
    for n in units:
        own, part = Found(), Node("r")
        part.kids = [n]
        finish(keep_regions(formats.styled_tree(part, classes, own), s.stream, own), classes, own, s.extend, s.extract_more, s.mangle_xml)
        kids = _rendered(own.skeleton, own.styles, None, s).kids
        at = next(i for i, k in enumerate(n.up.kids) if k is n)
        n.up.kids[at : at + 1] = kids
        for k in kids:
            k.up = n.up
    return fmt, _page_out(fmt, root, _doctype(text), found.styles, s)


def _rendered(skeleton: str, styles: dict, new: dict[str, str] | None, s: Settings, added: bool = True) -> Node:
    """The tree of a skeleton with new texts."""
    filled = fill(skeleton, new, s)
    markup = expand_text(normalise_text(filled, s.extend), lambda tag, h: styles.get((tag, h)))
    root = parse(re.sub(r' tf-unique="\d+"', "", markup))
    restore_spaces(root, keep=s.stream != "apertium", added=added)
    return root


def _page_out(fmt: str, root: Node, doctype: bool, styles: dict, s: Settings) -> str:
    look = lambda tag, h: styles.get((tag, h))
    out = unshielded(formats.fragment_out(root, look) if fmt == "html-fragment" else formats.html_out(root, doctype, look))
    return s.hook(out) if s.hook else out


def _prepared(docs: DataFrame, s: Settings, id_col: str, content: str, name: str | None) -> DataFrame:
    """id, format, text, content: formats and encodings are found in the JVM."""
    binary = dict(docs.dtypes)[content] == "binary"
    col = F.col(content)
    zipped = detect.is_zip(col) if binary else F.lit(False)
    named = detect.by_name(F.col(name)) if name else F.lit(None).cast("string")
    if binary:  # Python guesses at all that it is given: no archives. A column of its own, as decoding reads it often
        docs = docs.withColumn("_open", F.when(~zipped, col))
    text = detect.decoded(F.col("_open")) if binary else col
    fmt: Column = F.lit(s.format) if s.format != "auto" else F.coalesce(named, F.when(zipped, "zip"), detect.by_text(text), F.lit("text"))
    return docs.select(F.col(id_col).alias("id"), fmt.alias("format"), text.alias("text"), (F.when(zipped, col) if binary else F.lit(None).cast("binary")).alias("content"))


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """``values`` as an array; lists of records go by column, which is faster than record by record."""
    if not pa.types.is_list(kind):
        return pa.array(values, type=kind)
    columns = _columns(values, kind)
    ends = pa.array([0, *accumulate(map(len, values))], type=pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind)


def _columns(values: list, kind: pa.DataType) -> list[pa.Array]:
    """The records of all lists, one behind the other, by column."""
    each = [x for v in values for x in v]
    return [pa.array([x[f.name] for x in each], type=f.type) for f in kind.value_type]


def _map(df: DataFrame, one: Callable[..., tuple], out: list, ddl: str, id_col: str) -> DataFrame:
    """Rows to rows, one Arrow batch at a time; the first column is the id and stays."""
    small_batches(df.sparkSession)
    id_type = df.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(*values) for values in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in out]
            arrays = [_array(list(c), t) for c, (_, t) in zip(columns, out, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=[id_col, *(n for n, _ in out)])

    return df.mapInArrow(run, f"`{id_col}` {id_type}, {ddl}")


def _map_each(df: DataFrame, records: Callable[..., list], kind: pa.DataType, ddl: str, id_col: str) -> DataFrame:
    """Rows to any number of records each, with the id before them."""
    small_batches(df.sparkSession)
    id_type = df.schema[0].dataType.simpleString()
    names = [f.name for f in kind.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [records(*values) for values in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            of = pa.array([i for i, x in enumerate(found) for _ in x], type=pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), *_columns(found, kind)], names=[id_col, *names])

    return df.mapInArrow(run, f"`{id_col}` {id_type}, {ddl}")


def _doctype(text: str | None) -> bool:
    return "<!doctype" in (text or "").split("\n", 1)[0].lower()


def _styles(found: Found) -> list[dict]:
    return [dict(zip(("tag", "hash", "otag", "ctag", "flags"), (*k, *v), strict=True)) for k, v in found.styles.items()]


@dataclass
class State:
    """What extraction leaves: one row for each document, with its blocks, styles and skeleton.

    ``prepared``: the documents, if the state isn't kept. Then blocks, and styles, are found by a
    pass that does nothing else: no skeleton is written, and what is not asked for does not leave Python.
    """

    extracted: DataFrame
    settings: Settings
    id_col: str = "doc_id"
    prepared: DataFrame | None = None

    @property
    def blocks(self) -> DataFrame:
        """id, block_no, block_id, kind, attr_name, is_header, body, place (in the skeleton)."""
        if self.prepared is None:
            return self.extracted.select(self.id_col, F.inline("blocks"))
        s = self.settings
        return _map_each(self.prepared, lambda *row: extract_one(*row, s, "blocks")[1].blocks, _as_struct(_BLOCK), _BLOCK, self.id_col)

    @property
    def styles(self) -> DataFrame:
        """id, tag, hash, otag, ctag, flags; unique by the first three."""
        if self.prepared is None:
            return self.extracted.select(self.id_col, F.inline("styles"))
        s = self.settings
        return _map_each(self.prepared, lambda *row: _styles(extract_one(*row, s, "styles")[1]), _as_struct(_STYLE), _STYLE, self.id_col)

    @property
    def skeleton(self) -> DataFrame:
        return self.extracted.select(self.id_col, "format", "skeleton")

    def save(self, path: str) -> State:
        """The state as Parquet in a shared folder, and read back: extraction isn't repeated.

        Spark's committer shows the files all at once, with their mark of success.
        """
        self.extracted.write.mode("overwrite").parquet(path)
        return State(self.extracted.sparkSession.read.schema(self.extracted.schema).parquet(path), self.settings, self.id_col)

    @staticmethod
    def load(spark: SparkSession, path: str, settings: Settings, id_col: str = "doc_id") -> State:
        return State(spark.read.parquet(path), settings, id_col)


def extract(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", content: str = "text", name: str | None = None) -> State:
    """Blocks, styles and skeletons of documents; ``docs`` may be a stream. ``content`` is text or bytes."""
    s = settings or Settings()

    def one(fmt: str, text: str | None, data: bytes | None) -> tuple:
        fmt, found = extract_one(fmt, text, data, s)
        return fmt, _doctype(text), found.skeleton, data, found.blocks, _styles(found)

    prepared = _prepared(docs, s, id_col, content, name)
    return State(_map(prepared, one, _EXTRACTED_ARROW, _EXTRACTED, id_col), s, id_col, prepared)


def found_formats(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", content: str = "text", name: str | None = None) -> DataFrame:
    """id, format: what ``extract`` would take each document for."""
    prepared = _prepared(docs, settings or Settings(), id_col, content, name)
    return _map(prepared, lambda *row: (format_one(*row),), [("format", pa.string())], "format string", id_col)


def accepted(state: State, arrivals: DataFrame, seq: str) -> DataFrame:
    """Arrivals that an in-order reader takes: blocks of the document whose place lies beyond all taken before.

    A refused block lies before the largest place so far, so the running
    maximum over all arrivals equals that over those taken.
    """
    known = state.blocks.select(state.id_col, "block_id", "place")
    window = Window.partitionBy(state.id_col).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    placed = arrivals.join(known, [state.id_col, "block_id"]).withColumn("_before", F.max("place").over(window))
    return placed.filter(F.col("_before").isNull() | (F.col("place") > F.col("_before"))).drop("_before", "place")


def unknown_blocks(state: State, arrivals: DataFrame) -> DataFrame:
    """Arrivals that no document has a place for."""
    return arrivals.join(state.blocks.select(state.id_col, "block_id"), [state.id_col, "block_id"], "left_anti")


def _with_new(state: State, blocks: DataFrame, ordered: bool, seq: str) -> DataFrame:
    """Documents, each with its new bodies."""
    key = state.id_col
    got = accepted(state, blocks, seq) if ordered else blocks
    first = F.min_by("body", seq) if seq in got.columns else F.min("body")
    each = got.groupBy(key, "block_id").agg(first.alias("body")).groupBy(key).agg(F.collect_list(F.struct("block_id", "body")).alias("new"))
    return state.extracted.select(key, "format", "doctype", "skeleton", "original", "styles").join(each, key, "left")


def _bodies(new: list | None) -> dict[str, str]:
    return {x["block_id"]: x["body"] for x in new or [] if x["body"] is not None}


def filled(state: State, blocks: DataFrame, ordered: bool = False, seq: str = "seq") -> DataFrame:
    """id, format, markup: what injection parses after it has put the texts in their places, for a look at it."""
    s = state.settings

    def one(fmt: str, doctype: bool, skeleton: str, original: bytes | None, styles: list, new: list | None) -> tuple:
        return fmt, fill(skeleton or "", _bodies(new), s)

    return _map(_with_new(state, blocks, ordered, seq), one, [("format", pa.string()), ("markup", pa.string())], "format string, markup string", state.id_col)


def inject(state: State, blocks: DataFrame, ordered: bool = False, seq: str = "seq") -> DataFrame:
    """id, format, text, content: documents with new bodies for their blocks (id, block_id, body).

    A block without a new body keeps its own; one that comes twice counts where it comes first
    by ``seq``, or with the smallest body where there is no such column. ``ordered``: blocks out of order are refused.
    """
    s = state.settings

    def one(fmt: str, doctype: bool, skeleton: str, original: bytes | None, styles: list, new: list | None) -> tuple:
        known = {(x["tag"], x["hash"]): (x["otag"], x["ctag"], x["flags"]) for x in styles or []}
        return fmt, *render_one(fmt, doctype, skeleton, known, _bodies(new), original, s)

    return _map(_with_new(state, blocks, ordered, seq), one, _RENDERED_ARROW, "format string, text string, content binary", state.id_col)


def _plain(s: Settings) -> bool:
    """Whether a document is plain text that comes back as it was, but for the blanks between paragraphs."""
    return s.format in ("text", "line") and s.stream != "apertium" and s.hook is None and not s.tags


def clean(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", content: str = "text", name: str | None = None) -> DataFrame:
    """id, format, text, content: documents with normalised spans; one pass, no shuffle.

    Plain texts and lines have no spans: what cleaning them means is a projection.
    """
    s = settings or Settings()
    prepared = _prepared(docs, s, id_col, content, name)
    if _plain(s):
        text = F.when(F.col("content").isNull(), formats.clean_text(F.col("text"), s.format == "line"))
        return prepared.select(F.col("id").alias(id_col), "format", text.alias("text"), "content")

    def one(fmt: str, text: str | None, data: bytes | None) -> tuple:
        if text is not None and fmt in ("html", "html-fragment") and (page := clean_page(fmt, text, s)):
            return *page, None
        fmt, found = extract_one(fmt, text, data, s)
        return fmt, *render_one(fmt, _doctype(text), found.skeleton, found.styles, None, data, s)

    return _map(prepared, one, _RENDERED_ARROW, "format string, text string, content binary", id_col)
