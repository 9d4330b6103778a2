"""ZIP-based office documents: members, merging of runs, and putting texts back.

Runs are merged on the tree: each run of a paragraph becomes a span in a helper
element ``tf-text``, and back again after injection, when every text within the
helper that stands outside a text element gets a run of its own.
"""

from __future__ import annotations

import functools
import io
import re
import zipfile
from collections.abc import Callable

from ..functions.markers import CLOSE, OPEN_B, OPEN_E, SENTINEL, Rules, rewrite_text
from .spans import normalise_text
from .tree import Found, Node, escape, open_tag, parse, serialise

DOCX_MAIN = "word/document.xml"

# Elements and attributes of the formats that say nothing about the text, but split it.
DOCX_CHAFF: Rules = (
    [(f' {a}="{v}"', "") for a, v in (("xml:space", "preserve"), ("w:eastAsiaTheme", "minorHAnsi"), ("w:type", "textWrapping"))]
    + [(f' w:{a}="[^"]+"', "") for a in ("rsidP", "rsidRDefault", "rsidR", "rsidRPr", "rsidDel")]
    + [(r"<w:(?:lang|proofErr) [^/>]+/>", "")]
    + [(f"<w:{t}/>", "") for t in ("noProof", "lastRenderedPageBreak")]
    + [('<w:color w:val="auto"/>', ""), (r"<w:rFonts(?:/>|></w:rFonts>)", ""), (r"<w:rPr></w:rPr>", ""), ("<w:softHyphen/>", "")]
    + [(r"<w:(?:br|cr)/>", "<w:t>\n</w:t>"), ("<w:noBreakHyphen/>", "<w:t>-</w:t>")]
    + [(r"</w:t>([^<>]*)<w:t(?: [^>]*)?>", "")]
)
PPTX_CHAFF: Rules = [(' lang="[^"]*"', ""), ("<a:rPr/>", ""), (r"</a:t>([^<>]+)<a:t(?: [^>]*)?>", "")]


def members(data: bytes) -> dict[str, bytes]:
    """Members by name, in order; none if the archive can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return {n: z.read(n) for n in z.namelist()}
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError):
        return {}


def repacked(data: bytes, new: dict[str, bytes]) -> bytes:
    """The archive with some members replaced; the others keep their bytes, order and times."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for info in old.infolist():
            z.writestr(info, new.get(info.filename, old.read(info.filename)), compress_type=info.compress_type)
    return out.getvalue()


def zip_format(names: dict[str, bytes] | list[str]) -> str:
    """The format that an archive's members show; the first that fits."""
    have = set(names)
    for member, fmt in ((DOCX_MAIN, "docx"), ("ppt/slides/slide1.xml", "pptx"), ("[Content_Types].xml", "docx"), ("content.xml", "odt")):
        if member in have:
            return fmt
    return "unknown"


def docx_main(parts: dict[str, bytes]) -> str | None:
    """The name of the main document part."""
    if DOCX_MAIN in parts:
        return DOCX_MAIN
    for override in re.findall(r"<Override [^>]*>", parts.get("[Content_Types].xml", b"").decode("utf-8", "replace")):
        name = re.search(r'PartName="/?([^"]+)"', override)
        if name and "document.main+xml" in override and name[1] in parts:
            return name[1]
    return None


def slides(parts: dict[str, bytes]) -> list[str]:
    """Names of slides from the first to the first gap."""
    out: list[str] = []
    while f"ppt/slides/slide{len(out) + 1}.xml" in parts:
        out.append(f"ppt/slides/slide{len(out) + 1}.xml")
    return out


def undeclared(xml: bytes) -> str:
    return re.sub(r"^\s*<\?xml [^>]*\?>\s*", "", xml.decode("utf-8-sig", "replace"))


def _split_run(run: Node, text_tag: str, props: str) -> list[Node]:
    """A run in which texts and other content alternate, as runs with the same properties."""
    own = [k for k in run.kids if k.name == props]
    groups: list[list[Node]] = []
    for k in run.kids:
        if k.name == props:
            continue
        if groups and (groups[-1][-1].name == text_tag) == (k.name == text_tag):
            groups[-1].append(k)
        else:
            groups.append([k])
    if len(groups) < 2 or not any(g[0].name == text_tag for g in groups):
        return [run]
    out = []
    for g in groups:
        new = Node("e", run.name)
        new.attrs = [list(a) for a in run.attrs]
        for k in [*(x.copy() for x in own), *g]:
            new.add(k)
        new.up = run.up
        out.append(new)
    at = run.up.kids.index(run)
    run.up.kids[at : at + 1] = out
    return [r for r in out if r.kids[-1].name == text_tag]


def _docx_kind(run: str) -> str:
    bold, italic = "<w:b/>" in run, "<w:i/>" in run
    return "b+i" if bold and italic else "b" if bold else "i" if italic else "rpr" if "<w:rPr" in run else "text"


def _pptx_kind(run: str) -> str:
    have = [k for k, sign in (("a", "a:hlinkClick"), ("b", ' b="1"'), ("i", ' i="1"')) if sign in run]
    return "+".join(have) or "text"


def _text_of(node: Node) -> str:
    return node.kids[0].text if len(node.kids) == 1 and node.kids[0].kind == "t" else node.all_text()


def _small(run: Node) -> str:
    """``serialise`` of a run; most hold nothing but empty elements and one text."""
    out = [open_tag(run)]
    for k in run.kids:
        if k.kind != "e" or len(k.kids) > 1 or k.kids and k.kids[0].kind != "t":
            return serialise(run)
        tag = open_tag(k)
        out.append(f"{tag}{escape(k.kids[0].text, quotes=False)}</{k.name}>" if k.kids else f"{tag[:-1]}/>")
    return f"{''.join(out)}</{run.name}>"


def merge_runs(root: Node, prefix: str, found: Found) -> None:
    """Runs of paragraphs with two texts or more become spans; ``prefix``: w or a."""
    text_tag, props, docx = f"{prefix}:t", f"{prefix}:rPr", prefix == "w"
    kind_of = functools.lru_cache(1024)(_docx_kind if docx else _pptx_kind)
    for para in [n for n in root.walk() if n.name == f"{prefix}:p"]:
        inside = list(para.walk())
        found_texts = [n for n in inside if n.name == text_tag]
        if len(found_texts) < 2:
            continue
        runs = list({id(n.up): n.up for n in found_texts}.values())
        for run in [r for x in runs for r in _split_run(x, text_tag, props)]:
            texts = [k for k in run.kids if k.name == text_tag]
            content = "".join([_text_of(t) for t in texts])
            texts[0].kids = []
            texts[0].add_text(SENTINEL)
            if len(texts) > 1:
                run.kids = [k for k in run.kids if k not in texts[1:]]
            markup = _small(run)
            kind = kind_of(markup) if len(markup) < 256 else kind_of.__wrapped__(markup)
            if not (docx and kind == "text"):
                otag, _, ctag = markup.partition(SENTINEL)
                content = f"{OPEN_B}{kind}:{found.style(kind, otag, ctag)}{OPEN_E}{content}{CLOSE}"
            _into_helper(run, content)
        if not any([n.name == "w:hyperlink" for n in inside]):
            continue
        for link in [n for n in para.walk() if n.name == "w:hyperlink"]:
            if len(link.kids) == 1 and link.kids[0].name == "tf-text":
                content = link.kids[0].all_text()
                link.kids = []
                link.add_text(SENTINEL)
                otag, _, ctag = serialise(link).partition(SENTINEL)
                _into_helper(link, f"{OPEN_B}a:{found.style('a', otag, ctag)}{OPEN_E}{content}{CLOSE}")


def _into_helper(node: Node, content: str) -> None:
    """``content`` takes the node's place, in the helper before it or in a new one."""
    kids = node.up.kids
    at = next(i for i, k in enumerate(kids) if k is node)
    if at and kids[at - 1].name == "tf-text":
        kids[at - 1].add_text(content)
        del kids[at]
        return
    helper = Node("e", "tf-text")
    helper.up = node.up
    helper.add_text(content)
    kids[at] = helper


def styled_runs(xml: str, prefix: str, found: Found, extend: bool) -> str:
    root = parse(rewrite_text(xml, DOCX_CHAFF if prefix == "w" else PPTX_CHAFF))
    merge_runs(root, prefix, found)
    return normalise_text(serialise(root), extend).replace("</tf-text><tf-text>", "")


def unmerge_runs(root: Node, prefix: str) -> None:
    """Helpers dissolve; texts that stand outside a text element get a run of their own."""
    text_tag = f"{prefix}:t"

    for helper in [n for n in root.walk() if n.name == "tf-text"]:
        for node in list(helper.walk()):
            for i, k in enumerate(node.kids):
                if k.kind == "t" and node.name != text_tag and k.text:
                    run = Node("e", f"{prefix}:r")
                    run.add(Node("e", text_tag)).add_text(k.text)
                    run.up = node
                    node.kids[i] = run
        # runs without a text say nothing
        kids = [k for k in helper.kids if not (k.name == f"{prefix}:r" and any(t.name == text_tag for t in k.kids) and not k.all_text())]
        at = next(i for i, k in enumerate(helper.up.kids) if k is helper)
        for k in kids:
            k.up = helper.up
        helper.up.kids[at : at + 1] = kids
    if prefix == "w":
        for n in root.walk():
            if n.name in ("w:t", "w:instrText"):
                n.attrs.insert(0, ["xml:space", "preserve"])


DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


Hook = Callable[[str], str]


def _bytes(xml: str) -> bytes:
    return xml.encode("utf-8", "surrogatepass")


def docx_out(root: Node, original: bytes, hook: Hook) -> bytes:
    unmerge_runs(root, "w")
    return repacked(original, {docx_main(members(original)) or DOCX_MAIN: _bytes(hook(DECLARATION + serialise(root)))})


def pptx_out(root: Node, original: bytes, hook: Hook) -> bytes:
    unmerge_runs(root, "a")
    found = [n for top in root.kids if top.name == "tf-slides" for n in top.kids if n.kind == "e"]
    names = slides(members(original))
    return repacked(original, {name: _bytes(hook(DECLARATION + serialise(n))) for name, n in zip(names, found, strict=False)})


def odt_out(root: Node, original: bytes, hook: Hook) -> bytes:
    return repacked(original, {"content.xml": _bytes(hook('<?xml version="1.0" encoding="UTF-8"?>\n' + serialise(root)))})
