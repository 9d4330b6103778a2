"""Front ends and back ends of the text and markup formats: rewrites before parsing, tag classes, serialising."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import style_hash
from ..functions.markers import BLANKS, BLOCK_B, BLOCK_E, BLOCK_M, BLOCK_N, CHARSET, LOOSE, RAW_B, RAW_E, Rules, has_marks, rewrite, rewrite_text
from ..functions.text import lower_ascii
from .spans import OneOf, Styles, restore_raw
from .tree import Found, Node, TagClasses, attribute, escape, has_content, parse, save_spaces, serialise, tag_spans, unescape


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Tag and attribute names of the formats.
HTML_TAGS = TagClasses(
    prot=_names("applet area base cite code frame frameset link meta nowiki object pre ref script style svg syntaxhighlight template"),
    prot_inline=_names("apertium-notrans br ruby"),
    raw=_names("script style svg"),
    inline=_names("a abbr acronym address b bdi bdo big del em font i ins kbd mark meter output q s samp small span strike strong sub sup time tt u var"),
    attrs=_names("alt caption label summary title placeholder"),
)
HTML_HEADERS = {"headers": ["h1", "h2", "h3", "h4", "h5", "h6"], "attrs_headers": ["title"]}
TEI_TAGS = TagClasses(
    parents_allow=_names("ab floatingtext p"),
    prot=_names("binaryobject figdesc teiheader"),
    prot_inline=_names("gap lb space"),
    inline=_names("ref seg"),
    semantic=_names("date persname placename time"),
    unique=_names("gap lb ref seg"),
)
ODT_TAGS = TagClasses(parents_allow=_names("text:h text:p"), prot_inline=_names("text:line-break text:s"), inline=_names("text:a text:span"))
DOCX_TAGS = TagClasses(parents_allow=_names("tf-text w:t"))
PPTX_TAGS = TagClasses(parents_allow=_names("tf-text a:t"))

#: The name of a charset gives way to a placeholder, at its first mention.
CHARSET_RULES: Rules = [(r"(?is)\A(.*?charset\s*=\s*[\"']?)[^\"'\s/>;]+", "$1" + CHARSET)]
#: Soft hyphens and break opportunities vanish.
SOFT_HYPHENS: Rules = [("(?i)<wbr>|­|&shy;|&#173;|&#x0*ad;", "")]
#: A sub- or superscript that touches a word is set apart, and says so.
SUBSUP_BEFORE: Rules = [(r"([^>\s])<(sub|sup)([ >])", '$1 <$2 tf-added-before="1"$3')]
SUBSUP_AFTER: Rules = [(r"<(sub|sup)((?: [^>]*)?)>([^<]*)</\1>(?=[^<\s])", '<$1 tf-added-after="1"$2>$3</$1> ')]
SUBSUP_AFTER_EACH: Rules = [(rf"<({t})((?: [^>]*)?)>([^<]*)</{t}>([^<\s])", '<$1 tf-added-after="1"$2>$3</$1> $4') for t in ("sub", "sup")]
_WORDY = r"[^\s\p{Z}<>;&]"
LB_RULES: Rules = [
    (f"({_WORDY})<lb/>({_WORDY})", '$1 <lb tf-added-before="1" tf-added-after="1"/> $2'),
    (f"({_WORDY})<lb/>", '$1 <lb tf-added-before="1"/>'),
    (f"<lb/>({_WORDY})", '<lb tf-added-after="1"/> $1'),
]
_IS_WORDY = OneOf(_WORDY)


def lb_apart(text: str) -> str:
    """LB_RULES on one text, from each break: rules of one pass share no character."""
    if "<lb/>" not in text:
        return text
    for before, after in ((True, True), (True, False), (False, True)):
        by = f'{" " * before}<lb{' tf-added-before="1"' * before}{' tf-added-after="1"' * after}/>{" " * after}'
        out, last, end = [], 0, len(text)
        i = text.find("<lb/>")
        while i >= 0:
            j = i + 5
            if (not before or i > last and _IS_WORDY[text[i - 1]]) and (not after or j < end and _IS_WORDY[text[j]]):
                out += [text[last:i], by]
                if after:
                    out.append(text[j])
                last = j = j + after
            i = text.find("<lb/>", j)
        text = "".join(out) + text[last:]
    return text


# Language, country and revision marks that split equal text.
ODT_CHAFF: Rules = [(rf' {a}="[^"]+"', "") for a in ("fo:language", "style:language-complex", "style:language-asian", "fo:country", "style:country-complex", "style:country-asian", "officeooo:paragraph-rsid", "officeooo:rsid")] + [("<style:text-properties/>", "")]

_FRAGMENT_HEAD = '<!DOCTYPE html>\n<html><head><meta charset="utf-8"></head><body>'
_FRAGMENT_TAIL = "</body></html>"


def wrap_fragment(fragment: Column) -> Column:
    """A whole page around a fragment."""
    return F.concat(F.lit(_FRAGMENT_HEAD), fragment, F.lit(_FRAGMENT_TAIL))


def is_fragment(html: Column) -> Column:
    """A page without an end of html is a fragment."""
    return ~lower_ascii(html).contains("</html>")


_PARAGRAPH = "\n[\\s\\p{Zs}]*\n[\\s\\p{Zs}]*"


def paragraphs(docs: DataFrame, id_col: str, text: Column, by_line: bool = False) -> DataFrame:
    """doc id, place, part: paragraphs (parted by blank lines) or lines, in order; all in the JVM."""
    parts = F.split(text, "\n" if by_line else _PARAGRAPH, -1)
    return docs.select(id_col, F.posexplode(parts).alias("place", "part"))


def number_blocks(parts: DataFrame, id_col: str, place: str = "place") -> DataFrame:
    """block_no: consecutive within a document."""
    return parts.withColumn("block_no", F.row_number().over(Window.partitionBy(id_col).orderBy(place)))


RAW_BODIES = r"(?is)<(?:script|style)\b[^>]*>(.+?)</(?:script|style)\s*>"


def raw_bodies(html: Column) -> Column:
    """Bodies of scripts and style sheets, in order."""
    return F.regexp_extract_all(html, F.lit(RAW_BODIES), F.lit(1))


#: What each match of SOFT_HYPHENS begins with; the long s is an s where case is ignored.
_SOFT = ("\u00ad", "<w", "<W", "&s", "&S", "&\u017f", "&#")
_RAW_BODY = re.compile(r"(<(script|style)\b[^>]*>)(.+?)(</\2\s*>)", re.I | re.S)
_CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)


def styled_html(html: str, stream: str, classes: TagClasses, found: Found) -> str:
    """A page as styled string: rewrites, tree, spans."""
    return styled_tree(parse(page_markup(html, found), html=True), classes, found)


def is_cut(html: str) -> bool:
    """Whether a page has no end of html."""
    return "</html>" not in html and "</html>" not in html.lower()


def page_markup(html: str, found: Found) -> str:
    """A page after the rewrites that come before its tree."""
    if is_cut(html):
        html = _FRAGMENT_HEAD + html + _FRAGMENT_TAIL
    html = rewrite_text(html, CHARSET_RULES)

    def raw(m: re.Match) -> str:
        h = style_hash(m[3], "")
        found.styles["U", h] = (m[3], "", "")
        return f"{m[1]}{RAW_B}{h}{RAW_E}{m[4]}"

    html = _RAW_BODY.sub(raw, html)
    if any(x in html for x in _SOFT):
        html = rewrite_text(html, SOFT_HYPHENS)
    if "<su" in html:
        html = rewrite_text(html, SUBSUP_BEFORE + SUBSUP_AFTER)
    return _CDATA.sub(lambda m: escape(m[1]), html)


def styled_tree(root: Node, classes: TagClasses, found: Found, pairs: bool = False) -> str:
    save_spaces(root, classes)
    return tag_spans(root, classes, found, pairs)


_BREAKS = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")


def text_as_html(text: str, by_line: bool) -> str:
    """Paragraphs, and breaks within them, of a plain text."""
    text = escape(text)
    if by_line:
        body = "</p>\n<p>".join(text.split("\n"))
    else:
        body = "</p>\n\n<p>".join(p.replace("\n", "<br>\n") for p in _BREAKS.split(text))
    return f"{_FRAGMENT_HEAD}<p>{body}</p>{_FRAGMENT_TAIL}".replace("</body></html>", "</body>\n</html>")


_LINES_HEAD = f'\n<html tf-space-before="&#10;" tf-space-suffix="&#10;"><head><meta charset="{CHARSET}"/></head><body>'
_LINES_TAIL = "</body>\n</html>"
_LINE = re.compile(f'<p((?: tf-space-(?:prefix|suffix|after)="[^"]*")*)(?:/>|>(?:{BLOCK_B}([^{BLOCK_M}]*){BLOCK_M}([^<>{BLOCK_B}-{BLOCK_E}]*){BLOCK_N}\\2{BLOCK_E}|([^<>{BLOCK_B}-{BLOCK_E}]*))</p>)')
_NOTE = re.compile(' tf-space-(prefix|suffix)="([^"]*)"')


def line_blocks(text: str, found: Found, more: bool = False, mangled: bool = False) -> None:
    """What extraction finds in the page that ``text_as_html`` makes of lines; no page is made."""
    lines = text.replace("\u00ad", "").split("\n")
    out: list[str] = []
    last = len(lines) - 1
    for i, x in enumerate(lines):
        notes = ""
        if x and (x[0] in BLANKS or x[-1] in BLANKS):
            solid = x.strip(BLANKS)
            lead, tail = (x[: len(x) - len(x.lstrip(BLANKS))], x[len(x.rstrip(BLANKS)) :]) if solid else (x, "")
            notes = "".join(attribute(f"tf-space-{k}", v) for k, v in (("prefix", lead), ("suffix", tail)) if v)
        if i < last:
            notes += ' tf-space-after="&#10;"'
        if not x:
            out.append(f"<p{notes}/>")
            continue
        safe = escape(x, quotes=False)
        if has_content(x, more):
            begin, end = found.block(x, mangled)
            safe = f"{begin}{safe}{end}"
        out.append(f"<p{notes}>{safe}</p>")
    found.skeleton = f"{_LINES_HEAD}{'\n'.join(out)}{_LINES_TAIL}"


def lines_out(skeleton: str, new: dict[str, str], keep: bool) -> str | None:
    """Lines with new texts for their blocks, of a skeleton by ``line_blocks``; None if it is another, or a text has marks."""
    if not (skeleton.startswith(_LINES_HEAD) and skeleton.endswith(_LINES_TAIL)):
        return None
    out: list[str] = []
    for part in skeleton[len(_LINES_HEAD) : -len(_LINES_TAIL)].split("\n"):
        m = _LINE.fullmatch(part)
        if not m:
            return None
        notes, block_id, own, other = m.groups()
        text = new.get(block_id) if block_id is not None else None
        if text is None:
            text = unescape(own or other or "", False)
        elif has_marks(text):
            return None
        if keep and "fix=" in notes:
            noted = {k: unescape(v, False) for k, v in _NOTE.findall(notes)}
            lead, tail = noted.get("prefix"), noted.get("suffix")
            if text.strip(BLANKS):
                text = text if lead is None else lead + text.lstrip(BLANKS)
                text = text if tail is None else text.rstrip(BLANKS) + tail
            else:
                text = f"{lead or ''}{tail or ''}"
        out.append(text)
    return "\n".join(out)


def clean_text(text: Column, by_line: bool) -> Column:
    """What extraction and injection make of a plain text, as an expression."""
    if not by_line:
        text = F.regexp_replace(text, r"(?U)\n[^\S\n]*(?:\n[^\S\n]*)+", "\n\n")
    return F.translate(text, "\u00ad", "")


_BODY = re.compile(r"<body[^>]*>(.*)</body>", re.S | re.I)


def html_out(root: Node, original_doctype: bool, styles: Styles) -> str:
    out = serialise(root, html=True).replace(CHARSET, "UTF-8").replace(LOOSE, "&")
    return restore_raw(("<!DOCTYPE html>\n" if original_doctype else "") + out.strip() + "\n", styles)


def fragment_out(root: Node, styles: Styles) -> str:
    """What stands within the body."""
    out = serialise(root, html=True).replace(CHARSET, "UTF-8").replace(LOOSE, "&")
    m = _BODY.search(out)
    return restore_raw(m[1] if m else out, styles)


def text_out(root: Node, by_line: bool) -> str:
    """Plain text again: the parts' texts, parted as they were."""
    parts = [n.all_text() for n in root.walk() if n.kind == "e" and n.name == "p"]
    return ("\n" if by_line else "\n\n").join(parts)


TEI_UNDO: Rules = [
    (' <lb tf-added-before="1" tf-added-after="1"/> ', "<lb/>"),
    (' <lb tf-added-before="1"/>', "<lb/>"),
    ('<lb tf-added-after="1"/> ', "<lb/>"),
    (' tf-added-(?:before|after)="1"(?=[^<>]*>)', ""),  # of a tag, not of a text
]


def tei_out(root: Node) -> str:
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + rewrite_text(serialise(root, pairs=True).strip(), TEI_UNDO) + "\n"


def strip_soft_hyphens(column: Column) -> Column:
    return rewrite(column, SOFT_HYPHENS)


_ODT_STYLE = re.compile(r'<style:style style:name="([^"]+)"(.+?</style:style>)', re.S)


def same_odt_styles(xml: str) -> str:
    """Styles that differ in their name alone become the first of them."""
    first: dict[str, str] = {}
    same: dict[str, str] = {}

    def one(m: re.Match) -> str:
        kept = first.setdefault(m[2], m[1])
        if kept == m[1]:
            return m[0]
        same[m[1]] = kept
        return ""

    xml = _ODT_STYLE.sub(one, xml)
    return re.sub(r' text:style-name="([^"]+)"', lambda m: f' text:style-name="{same.get(m[1], m[1])}"', xml) if same else xml


def odt_styles(docs: DataFrame, id_col: str, xml: Column) -> DataFrame:
    """doc id, place, style, kept: each style definition and the first one with the same body."""
    bodies = F.regexp_extract_all(xml, F.lit(r'(?s)<style:style style:name="[^"]+"(.+?</style:style>)'), F.lit(1))
    names = F.regexp_extract_all(xml, F.lit(r'(?s)<style:style style:name="([^"]+)".+?</style:style>'), F.lit(1))
    each = docs.select(id_col, F.posexplode(F.arrays_zip(names.alias("name"), bodies.alias("body"))).alias("place", "x"))
    first = Window.partitionBy(id_col, "x.body").orderBy("place")
    return each.select(id_col, "place", F.col("x.name").alias("style"), F.first("x.name").over(first).alias("kept"))
