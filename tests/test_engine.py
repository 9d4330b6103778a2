import io
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.functions.hashing import short_hash, style_hash
from spanloom.functions.markers import CLOSE, NAME_B, NAME_E, OPEN_B, OPEN_E, PROT_B, PROT_E
from spanloom.operators import office
from spanloom.operators.spans import expand_text, normalise_text
from spanloom.operators.tree import TagClasses, parse, serialise
from spanloom.plans import engine
from spanloom.plans.engine import Settings, extract_one, render_one
from spanloom.sources.tables import merged_styles, read_files, upsert, value_of
from spanloom.streaming import codec


def shown(body):
    for a, b in ((OPEN_B, "<STYLE:"), (OPEN_E, ">"), (CLOSE, "</STYLE>"), (NAME_B, ""), (NAME_E, "")):
        body = body.replace(a, b)
    return body


def blocks(markup, fmt="html-fragment", **kw):
    _, found = extract_one(fmt, markup, None, Settings(stream=kw.pop("stream", "visl"), **kw))
    return [(b["block_id"].split("-", 1)[1], shown(b["body"])) for b in found.blocks]


def round_trip(markup, fmt="html-fragment", new=None, **kw):
    s = Settings(stream=kw.pop("stream", "visl"), **kw)
    fmt, found = extract_one(fmt, markup, None, s)
    return render_one(fmt, "<!doctype" in markup.lower(), found.skeleton, found.styles, new, None, s)[0]


# Hashes that files written by other tools hold.
@pytest.mark.parametrize(
    ("text", "want"),
    [("I am David.", "qICbLQ"), ("Something æ ø å", "vjBYVQ"), (f"legal {OPEN_B}b:QjZnxQ{OPEN_E}persons{CLOSE}", "983gzA")],
)
def test_block_hash(text, want):
    assert short_hash(text) == want


@pytest.mark.parametrize(
    ("otag", "ctag", "want"),
    [
        ('<a href="#1" tf-space-after=" ">', "</a>", "2jDz4g"),
        ('<a href="#1" tf-space-before=" " tf-space-after=" ">', "</a>", "GVbw3w"),
        ('<b tf-space-before=" ">', "</b>", "QjZnxQ"),
        ('<br tf-space-before=" " tf-space-after=" "/>', "", "iqz-BQ"),
        ('<br tf-space-after="&#10;"/>', "", "xXY2iQ"),
        ("<!-- Inline -->", "", "QUhh9g"),
        ('<sub tf-added-after="1" tf-space-before=" " tf-space-after=" ">', "</sub>", "01ZKdA"),
    ],
)
def test_style_hash(otag, ctag, want):
    assert style_hash(otag, ctag) == want


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<p>legal <b>persons</b></p>", [("983gzA", "legal <STYLE:b:QjZnxQ>persons</STYLE>")]),
        ("<p><b>I</b> am <b>David.</b></p>", [("beZIww", "<STYLE:b:aNiiLA>I</STYLE> am <STYLE:b:QjZnxQ>David.</STYLE>")]),
        ('<p>Text with <a href="#1"><b>perfectly nested inline</b></a> tags.</p>', [("j5mf9A", "Text with <STYLE:a:GVbw3w;b:l89z2Q>perfectly nested inline</STYLE> tags.")]),
        ("<p>Bees can<sub>not</sub> swim.</p>", [("dBUylg", "Bees can <STYLE:sub:MhzKiw>not</STYLE> swim.")]),
        ("<p>Bees really<sub>can</sub>not swim.</p>", [(short_hash(f"Bees really {OPEN_B}sub:afjwLw{OPEN_E}can{CLOSE} not swim."), "Bees really <STYLE:sub:afjwLw>can</STYLE> not swim.")]),
        ("<p><!-- a -->My sister lives<!-- Inline --> in Wales.<!-- b --></p>", [(blocks("<p>My sister lives<!-- Inline --> in Wales.</p>")[0][0], "My sister lives<STYLE:P:QUhh9g>xml-special</STYLE> in Wales.")]),
        ('<p><a href="#1">Text entirely inside inline tag.</a></p>', [(short_hash("Text entirely inside inline tag."), "Text entirely inside inline tag.")]),
        ('<img title="T t" alt="A a">', [(short_hash("A a"), "A a"), (short_hash("T t"), "T t")]),
        ("<p>--- ... </p><pre>x</pre><p></p>", []),
    ],
)
def test_html_blocks(markup, want):
    assert blocks(markup) == want


def test_fragment_whole():
    text = '<a href="#1">Conway</a> stated that young children "<i>understand <a href="#2">object permanence</a>. Concealed objects feature in their awareness.</i>" (Nielsen equivalence).'
    assert blocks(text)[0][0] == "ZJ-sTQ"
    assert round_trip(text) == text


def test_plain_text():
    text = "Something\n\nI am David.\nBees cannot swim.\n\nlast & <x>"
    assert blocks(text, "text")[1] == ("wIUM9w", "I am David.<STYLE:P:xXY2iQ>br</STYLE>\nBees cannot swim.")
    assert round_trip(text, "text") == text
    assert [b for _, b in blocks(text, "line")] == ["Something", "I am David.", "Bees cannot swim.", "last & <x>"]


PAGE = """<!DOCTYPE html>
<html>
<head>
\t<meta charset="latin1">
\t<title>T</title>
<script>if (a < b && c) {}</script>
</head>
<body>
<h1 title="Over">Head</h1>
<p>Text with <a href="#1"> inline spaced and</a> <a href="#1">inline spaced </a> tags &amp; more.</p>
<ul><li>one<li><b>two</b> x</ul>
</body>
</html>
"""


def test_page_round_trip():
    out = round_trip(PAGE, "html")
    assert out == PAGE.replace("latin1", "UTF-8").replace("one<li>", "one</li><li>").replace(" x</ul>", " x</li></ul>")
    assert round_trip(out, "html") == out


def test_page_new_texts():
    _, found = extract_one("html", PAGE, None, Settings(stream="visl"))
    ids = {b["body"]: b["block_id"] for b in found.blocks}
    out = round_trip(PAGE, "html", {ids["Head"]: "Kopf & <so>", ids["Over"]: 'Ü"ber', ids["one"]: f"{OPEN_B}x:none{OPEN_E}eins{CLOSE}"})
    assert '<h1 title="Ü&quot;ber">Kopf &amp; &lt;so&gt;</h1>' in out and "<li>eins</li>" in out


def test_headers_and_options():
    _, found = extract_one("html", PAGE, None, Settings(stream="visl", mark_headers=True))
    assert {b["body"] for b in found.blocks if b["is_header"]} == {"Head", "Over"}
    assert blocks("<p>a<x>b</x></p>", mangle_xml=True, tags={"inline": ["+", "x"]})[0][1].startswith("<STYLE:x:")
    assert blocks("<p>...</p>", extract_more=True) == [(short_hash("..."), "...")]
    assert blocks("<p>a &lt; b</p>", mangle_xml=True)[0][1] == "a ﹤ b"
    assert blocks("<p>in<b>side</b></p>")[0][1] == "<STYLE:b:" + style_hash("<b>", "</b>") + ">inside</STYLE>"
    assert blocks("<p>in<b>side</b></p>", extend=False)[0][1].startswith("in<STYLE:b:")
    with pytest.raises(ValueError):
        Settings(format="pdf")
    with pytest.raises(ValueError):
        TagClasses().overridden({"nope": []})


def test_tei():
    text = '<?xml version="1.0" encoding="UTF-8"?>\n<TEI><teiHeader><p>no</p></teiHeader><text><p>one<lb/>two <date>May</date> <ref>a</ref><ref>b</ref></p><x>not here</x></text></TEI>\n'
    got = [b for _, b in blocks(text, "tei")]
    assert len(got) == 1 and got[0].startswith("one <STYLE:P:") and "<STYLE:date:" in got[0] and got[0].count("<STYLE:ref:") == 2
    assert round_trip(text, "tei") == text


def office_file(**parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return data.getvalue()


def office_trip(data, fmt="zip", new=None, **kw):
    s = Settings(stream="visl", **kw)
    fmt, found = extract_one(fmt, None, data, s)
    out = render_one(fmt, False, found.skeleton, found.styles, new, data, s)[1]
    return fmt, [shown(b["body"]) for b in found.blocks], {k: v.decode() for k, v in office.members(out).items()}


def run(text, props=""):
    return f"<w:r w:rsidR=\"1\">{props}<w:t>{text}</w:t></w:r>"


def test_docx():
    bold = "<w:rPr><w:b/></w:rPr>"
    xml = f"<w:document><w:body><w:p>{run('One ')}{run('two', bold)}{run(' three', bold)}{run(' x<w:tab/>').replace('x<w:tab/></w:t>', 'x</w:t><w:tab/><w:t>y </w:t>')}<w:hyperlink r:id=\"7\">{run('link')}</w:hyperlink></w:p><w:p>{run('alone')}</w:p></w:body></w:document>"
    fmt, found, out = office_trip(office_file(**{"word/document.xml": xml, "other.bin": "kept"}))
    assert fmt == "docx" and out["other.bin"] == "kept"
    assert found[0].startswith("One <STYLE:b:") and ">two three</STYLE> x" in found[0] and found[-2].startswith("y <STYLE:a:") and found[-1] == "alone"
    main = out["word/document.xml"]
    assert "tf-text" not in main and "<w:tab/>" in main and "" not in main
    tree = parse(main)
    assert tree.all_text().strip() == "One two three xy linkalone"
    assert all(n.up.name in ("w:t",) for n in tree.walk() if n.kind == "t" and n.text.strip())


def test_pptx_and_odt():
    slide = "<?xml version='1.0'?><p:sld><a:p><a:r><a:t>An</a:t></a:r><a:r><a:rPr b=\"1\" lang=\"en\"/><a:t> example</a:t></a:r></a:p></p:sld>"
    fmt, found, out = office_trip(office_file(**{"ppt/slides/slide1.xml": slide, "ppt/slides/slide2.xml": slide.replace("An", "No"), "ppt/slides/slide4.xml": slide}))
    assert fmt == "pptx" and len(found) == 2 and found[0].startswith("<STYLE:text:") and "<STYLE:b:" in found[0]
    assert parse(out["ppt/slides/slide2.xml"]).all_text().strip() == "No example" and out["ppt/slides/slide4.xml"] == slide
    xml = '<o:c><style:style style:name="P1" a="1"></style:style><style:style style:name="P2" a="1"></style:style><text:p text:style-name="P1">a <text:span text:style-name="P2">b</text:span> <text:span text:style-name="P1">c</text:span></text:p><x>no</x></o:c>'
    fmt, found, out = office_trip(office_file(**{"content.xml": xml}))
    assert fmt == "odt" and len(found) == 1 and found[0].count("<STYLE:span:") == 2
    assert "P2" not in out["content.xml"] and parse(out["content.xml"]).all_text().strip() == "a b cno"
    assert office_trip(office_file(a="b"))[0] == "unknown"
    assert extract_one("zip", None, b"PK\x03\x04broken", Settings())[1].blocks == []


def span(items, body):
    return f"{OPEN_B}{items}{OPEN_E}{body}{CLOSE}"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (span("b:1", "x") + " " + span("b:1", "y") + span("b:1", "z"), span("b:1", "x yz")),
        (span("b:1", span("i:2", "x")), span("b:1;i:2", "x")),
        ("ab" + span("b:1", "cd") + "ef", span("b:1", "abcdef")),
        ("a" + span("b:1", " c ") + "d", "a " + span("b:1", "c") + " d"),
        (span("b:1", ""), span("b:1", "")),
    ],
)
def test_normalise(given, want):
    assert normalise_text(given) == want


def test_expand():
    styles = {("b", "1"): ("<b>", "</b>", ""), ("i", "2"): ("<i>", "</i>", ""), ("P", "3"): ("<br/>", "", "P")}
    look = lambda t, h: styles.get((t, h))
    assert expand_text(span("b:1;i:2", "x" + span("P:3", "br") + span("q:9", "y")), look) == "<b><i>x<br/>y</i></b>"
    assert expand_text(f"a{PROT_B}P:3{PROT_E}{CLOSE}b{OPEN_B}b:1{OPEN_E}c", look) == "a<br/>b<b>c</b>"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ab p\"'=&;!-\n" + "é", max_size=60))
def test_parser_never_fails(text):
    for html in (True, False):
        out = serialise(parse(text, html), html)
        assert serialise(parse(out, html), html) == out or html


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<a href='x'>", "</a>", "<br>", " ", "word", "x", "<div>", "</div>", "&amp;", "\n"]), max_size=25))
def test_clean_is_stable(parts):
    once = round_trip("".join(parts))
    if once is not None:
        twice = round_trip(once)
        assert parse(twice or "", True).all_text().split() == parse("".join(parts), True).all_text().split()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab [](){}^$/\\@<>.;:❡é", max_size=40))
def test_apertium_body_comes_back(text):
    escaped = "".join("\\" + c if c in "^$[]{}/\\@<>" else c for c in text)
    assert codec.apertium_text(escaped) == text


def test_apertium_text():
    assert codec.apertium_text("a [[t:b:1;w:x;t:i:2;t:b:1]]x[[/]] [tf:P:3][blank][[/]] end.[]\n") == f"a {span('b:1;i:2', 'x')} {PROT_B}P:3{PROT_E}blank end\n"


def test_tables(spark):
    info = spark.createDataFrame([(1, "name", "a", 0), (1, "format", "html", 0), (2, "name", None, 0)], "doc_id long, key string, value string, seq long")
    new = spark.createDataFrame([(1, "name", "b", 2), (1, "name", "c", 1)], info.schema)
    got = upsert(info, new, ["doc_id", "key"], "seq")
    assert {tuple(r) for r in got.collect()} == {(1, "name", "b", 2), (1, "format", "html", 0), (2, "name", None, 0)}
    assert value_of(got, 1, "name").first().value == "b"
    styles = spark.createDataFrame([(1, "b", "x", "<b>", "</b>", "")] * 2 + [(1, "b", "x", "<i>", "</i>", "")], "doc_id long, tag string, hash string, otag string, ctag string, flags string")
    assert [(r.otag, r.clashes) for r in merged_styles(styles).collect()] == [("<b>", 2)]


def test_plan_over_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "<p>a <b>b</b></p>", "x"), (2, None, "y"), (3, "", "z"), (3, "plain\n\ntwo", "z")], "doc_id long, text string, format string")
    state = engine.extract(docs, Settings(stream="visl")).save(str(tmp_path / "state"))
    got = state.blocks.collect()
    assert sorted((r.doc_id, r.block_no) for r in got) == [(1, 1), (3, 1), (3, 2)]
    assert {r.format for r in state.skeleton.collect()} == {"html-fragment", "text"}
    new = state.blocks.filter("doc_id = 1").select("doc_id", "block_id", "body").unionByName(spark.createDataFrame([(1, "9-none", "q")], "doc_id long, block_id string, body string"))
    assert engine.unknown_blocks(state, new).count() == 1
    out = {(r.doc_id, r.text) for r in engine.inject(state, new).collect()}
    assert (1, "<p>a <b>b</b></p>") in out and (2, None) in out and (3, "plain\n\ntwo") in out
    assert engine.State.load(spark, str(tmp_path / "state"), state.settings).styles.count() == 1
    assert engine.clean(docs.limit(0), Settings()).count() == 0
    shouted = engine.clean(docs.filter("doc_id = 1"), Settings(stream="visl", hook=str.upper)).first()
    assert shouted.text == "<P>A <B>B</B></P>"


def test_files_and_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Grüße".encode("utf-16"))
    (tmp_path / "b.dat").write_bytes("caf\xe9 \x80".encode("latin-1"))
    (tmp_path / "c.docx").write_bytes(office_file(**{"word/document.xml": "<w:p><w:r><w:t>hi</w:t></w:r></w:p>"}))
    (tmp_path / "d.bin").write_bytes(office_file(**{"content.xml": "<text:p>yo</text:p>"}))
    state = engine.extract(read_files(spark, str(tmp_path)), Settings(stream="visl"), content="content", name="name")
    assert sorted((r.format, r.body) for r in state.extracted.selectExpr("format", "blocks[0].body as body").collect()) == [("docx", "hi"), ("odt", "yo"), ("text", "Grüße"), ("text", "café €")]


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    docs = spark.createDataFrame([(1, "one\ntwo."), (2, "three [x]")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    q = engine.extract(stream, Settings(format="line", stream="apertium")).blocks.writeStream.format("memory").queryName("found_blocks").start()
    q.processAllAvailable()
    q.stop()
    found = spark.table("found_blocks")
    assert sorted(r.body for r in found.collect()) == ["one", "three [x]", "two."]
    text = "".join(r.stream for r in codec.encode(found, "apertium", __import__("pyspark.sql.functions", fromlist=["x"]).lit("a]b")).collect())
    (tmp_path / "in" / "s.txt").write_text(text)
    q = codec.decode_apertium(codec.read_frames(spark, str(tmp_path / "in"), streaming=True)).writeStream.format("memory").queryName("frames").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.body for r in spark.table("frames").collect()) == ["one", "three [x]", "two."]


@pytest.mark.parametrize(
    ("fmt", "markup"),
    [("html", "<div>" * 100_000 + "x y"), ("html", "<p>" + "<b>" * 100_000 + "x"), ("html", "<p>a<div>" * 30_000), ("html", "<div>" * 50_000 + "</b>" * 50_000), ("tei", "<TEI><p>" + "<seg>" * 30_000 + "x" + "</seg>" * 30_000 + "</p></TEI>"), ("html", "<p>y " + "<b>" * 30_000 + "x" + "</b>" * 30_000 + " z</p>")],
)
def test_deep_documents(fmt, markup):
    s = Settings(stream="visl")
    fmt, found = extract_one(fmt, markup, None, s)
    assert render_one(fmt, False, found.skeleton, found.styles, None, None, s)[0]


def test_deep_spans_join_at_once(monkeypatch):
    deep = lambda tags, x: "".join(f"{OPEN_B}{t}:h{OPEN_E}" for t in tags) + x + CLOSE * len(tags)
    for text in ("y " + deep("abc", "x") + " z", deep("ab", "x " + deep("cd", "y")), deep("a", deep("b", "") + "q"), deep("ab", "x") + CLOSE + OPEN_B):
        want = normalise_text(text)
        with monkeypatch.context() as m:
            m.setattr("spanloom.operators.spans.DEEP", 0)
            assert normalise_text(text) == want


def test_marker_characters_in_documents():
    odd = f"a{OPEN_B}b:zz{OPEN_E}x{CLOSE} \ue015\ue016 \ue020P:q\ue021 \ue014 b"
    for fmt in ("text", "line"):
        assert round_trip(odd, fmt) == odd
    assert round_trip(f"<p>{odd} <b>c</b></p>") == f"<p>{odd} <b>c</b></p>"
    text = f"<TEI><text><p>{odd}</p></text></TEI>"
    assert odd in round_trip(text, "tei")


def test_left_over_block_markers():
    skeleton = "<p>\ue0151-x\ue016one\ue0171-x\ue018 \ue0152-y\ue016two \ue0173-z\ue018\ue018three</p>"
    assert engine.fill(skeleton, {"1-x": "new & <b>"}, Settings()) == "<p>new &amp; &lt;b&gt; two three</p>"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b ", " ", "\n", "\n\n", "\t", "\u00ad", "&", "<", "é", "\u2028", "charset=x", "&shy;"]), max_size=10), min_size=8, max_size=8))
def test_plain_cleaning_is_the_same_by_tree(spark, parts):
    docs = spark.createDataFrame([(k, "".join(p)) for k, p in enumerate(parts)], "doc_id long, text string")
    for fmt in ("text", "line"):
        got = {r.doc_id: r.text for r in engine.clean(docs, Settings(format=fmt, stream="visl")).collect()}
        assert got == {k: round_trip("".join(p), fmt) for k, p in enumerate(parts)}


def test_direct_parents():
    assert [b for _, b in blocks("<div>no<p>yes <b>x</b></p>no</div>", tags={"parents_direct": ["p"]})] == ["yes <STYLE:b:" + style_hash('<b tf-space-before=" ">', "</b>") + ">x</STYLE>"]


def test_command_line(spark, tmp_path, capsysbinary):
    from spanloom import cli

    (tmp_path / "in").mkdir()
    for k, x in enumerate(["same", "same\nother"]):
        (tmp_path / "in" / f"{k}.line").write_text(x + f"\nown {k}")
    (tmp_path / "hook").write_text("#!/bin/sh\nsed -i s/OWN/hooked/ \"$1\"\n")
    (tmp_path / "hook").chmod(0o755)
    state, stream, out = (str(tmp_path / x) for x in ("state", "stream", "out"))
    for kind in ("apertium", "visl"):
        assert cli.main(["-m", "extract", "-f", "line", "-s", kind, "-Kd", state, "-i", str(tmp_path / "in"), "-o", stream]) == 0
        text = open(stream).read()
        assert text.count("#") == 2 and text.count("same") == 2
        with open(stream, "w") as f:
            f.write(text.replace("own", "OWN"))
        # format, state and documents are those of the header; equal blocks of two documents don't mix
        assert cli.main(["inject", stream, out, "--debug", "--hook-inject", str(tmp_path / "hook")]) == 0
        assert sorted(open(out).read().replace("hooked 0", "hooked 0\n").replace("hooked 1", "hooked 1\n").split("\n")) == sorted(["", "same", "hooked 0", "same", "other", "hooked 1"])
        assert "OWN 0" in "".join(r.markup for r in spark.read.parquet(f"{state}/debug-inject-filled").collect())
    assert cli.main(["extract", "-f", "line", "-d", state, "-s", "visl", str(tmp_path / "nothing-here"), stream]) == 0  # the extraction is used again
    assert "own 1" in open(stream).read()
    assert cli.main(["inject", "-K", stream, out]) == 0 and not (tmp_path / "state").exists()
    with pytest.raises(SystemExit):
        cli.main(["inject", stream, out])
    assert cli.main(["clean", "-f", "line", "-s", "visl", str(tmp_path / "in" / "0.line"), out]) == 0 and open(out).read() == "same\nown 0"
    capsysbinary.readouterr()
    for args, want in ((["--url64", "a?>"], b"YT8-\n"), (["--hash32", "I am David."], b"qICbLQ\n"), (["--hash64", ""], b"menYUTfbRu8\n")):
        assert cli.main(args) == 0 and capsysbinary.readouterr().out == want
    with pytest.raises(SystemExit):
        cli.main([])


@pytest.mark.parametrize(
    ("charset", "want", "text"),
    [
        ("cp1252", "windows-1252", "Où est l'élève ? À côté, ça va, naïve façade."),
        ("cp1252", "windows-1252", "Größe und Übung, schön süß – „weiß“"),
        ("cp1250", "windows-1250", "Zażółć gęślą jaźń, proszę państwa"),
        ("cp1250", "windows-1250", "Příliš žluťoučký kůň úpěl ďábelské ódy"),
        ("cp1251", "windows-1251", "Съешь ещё этих мягких французских булок"),
        ("koi8-r", "KOI8-R", "Съешь ещё этих мягких французских булок"),
        ("cp1253", "windows-1253", "Η γρήγορη αλεπού πηδάει πάνω από το σκύλο"),
        ("shift_jis", "Shift_JIS", "日本語の文章です。漢字とかなとカタカナ"),
        ("euc_jp", "EUC-JP", "日本語の文章です。漢字とかなとカタカナ"),
        ("euc_kr", "EUC-KR", "한국어 문장입니다. 안녕하세요"),
        ("gb18030", "GB18030", "这是一个简单的中文句子，我们在这里"),
        ("big5", "Big5", "這是一個簡單的中文句子，我們在這裡"),
    ],
)
def test_guessed_encodings(spark, charset, want, text):
    from pyspark.sql import functions as F

    from spanloom.operators import detect

    assert detect.guess(text.encode(charset)) == (want, text)
    row = spark.createDataFrame([(bytearray(text.encode(charset)),)], "c binary").select(detect.encoding(F.col("c")).alias("e"), detect.decoded(F.col("c")).alias("t")).first()
    assert (row.e, row.t) == (want, text)


@pytest.mark.parametrize(
    "text",
    [
        "Étion et en ench èanier, ierque vi èenaioi en èenque oieau éçaux. Ciónasasta ciónuellí íquega de el y. Se osdoado ciónqueue rataes ciieie íll asllue.",
        "the and of English words that run on " * 40 + "Èanier trèai évielle íquega ñezdoñ ciónco ciónes",
    ],
)
def test_guess_of_several_western_languages(text):
    from spanloom.operators import detect

    assert detect.guess(text.encode("latin-1")) == ("windows-1252", text)


def test_hungarian_with_a_loan_word_is_not_western():
    from spanloom.operators import detect

    text = "Őrült hűség, fűtött szőlő: a quiz győztese új könyvet kért, és többször ünnepelt."
    assert detect.guess(text.encode("cp1250"))[0] == "windows-1250"


def test_page_keeps_ampersands_that_begin_no_reference():
    page = "<!DOCTYPE html>\n<html><head><title>a&amp;&am</title></head><body><h1>b &copy; c&amp</h1><p>d & e &nosuch; &#38;</p></body></html>\n"
    assert [b[1] for b in blocks(page, "html")] == ["a&&am", "b © c&amp", "d & e &nosuch; &"]
    assert round_trip(page, "html") == page.replace("&copy;", "©").replace("&#38;", "&amp;")


def test_span_rules_on_texts_agree_with_expressions():
    import random

    from spanloom.functions.markers import rewrite_text
    from spanloom.operators.spans import _round, round_rules

    r = random.Random(1)
    parts = [f"{OPEN_B}b:A{OPEN_E}"] * 3 + [f"{OPEN_B}i:B{OPEN_E}", OPEN_B, OPEN_E] + [CLOSE] * 4 + list("aé1´\u0301  \n\u2028.^")
    for n in range(5000):
        text = "".join(r.choices(parts, k=r.randint(1, 14)))
        assert _round(text, n % 2 == 0) == rewrite_text(text, round_rules(n % 2 == 0))


def test_long_words_cost_no_more_than_their_length():
    import time

    began = time.perf_counter()
    text = "a" * 100_000 + f". {OPEN_B}b:A{OPEN_E}x{CLOSE} " + " " * 100_000 + "."
    assert normalise_text(text) == text
    assert time.perf_counter() - began < 2


def test_archives_are_not_guessed_at(spark):
    """The guess is given a column without archives, not the content itself."""
    docs = spark.createDataFrame([(1, bytearray(b"PK\x03\x04\xff\xfe\xe9"))], "doc_id long, content binary")
    plan = engine._prepared(docs, Settings(), "doc_id", "content", None)._jdf.queryExecution().analyzed().toString()
    calls = [p.split("AS text#")[0] for p in plan.split("_guessed(")[1:]]
    assert calls and all("_open#" in p[:400] for p in calls)


def test_lines_make_files_of_bounded_length(spark, tmp_path):
    from spanloom.sources import tables

    tables.write_lines(spark.range(tables.FILE_LINES * 2 + 1).selectExpr("cast(id AS string) AS line").coalesce(1), "line", f"{tmp_path}/lines")
    assert sorted(len(x.read_text().split()) for x in (tmp_path / "lines").glob("part-*")) == [1, tables.FILE_LINES, tables.FILE_LINES]


def test_blocks_of_markup_are_those_of_the_tree():
    """Tag by tag, without a tree: the same blocks, places and skeleton, or none taken."""
    import random

    from spanloom.operators import formats, tree

    r = random.Random(2)
    classes = [formats.HTML_TAGS, formats.TEI_TAGS, formats.HTML_TAGS.overridden(formats.HTML_HEADERS), formats.HTML_TAGS.overridden({"parents_direct": ["p"]})]
    opens = ["<p>", '<p title="a&quot;b">', '<h1 alt="x" title="&amp; y">', "<pre>", "<q:b>", '<i tf-protect="1">', "<br/>", '<img alt="z"/>', "<br>", "<P  x=1>", '<p x="1" x="2">', '<p x="1>2">', "<!-- c -->", "<?i?>"]
    taken = 0
    for n in range(4000):
        parts, around = [], []
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.4:
                tag = r.choice(opens[:8] if n % 4 else opens)
                parts.append(tag)
                if not tag.endswith(("/>", "->", "?>")):
                    around.append(re.match("<([^ >]+)", tag)[1])
            elif kind < 0.6 and around:
                parts.append(f"</{around.pop()}>")
            else:
                parts.append(r.choice(["a", " ", "é &amp; b", "&lt;x&gt;", "'q'", "-", "&#169;", *(["<", ">", "&", "</p>", "<![CDATA[z]]>"] if n % 4 == 0 else [])]))
        markup = "".join(parts + [f"</{x}>" for x in reversed(around)])
        args = (r.choice(classes), r.random() < 0.5, r.random() < 0.5)
        want, got = tree.Found(), tree.Found()
        tree.take_blocks(tree.parse(markup), args[0], want, *args[1:])
        if tree.blocks_of_markup(markup, args[0], got, *args[1:]):
            assert (got.skeleton, got.blocks) == (want.skeleton, want.blocks), markup
            taken += 1
        else:
            assert (got.skeleton, got.blocks) == ("", [])
    assert taken > 2000


def test_tags_seen_before_read_the_same():
    from spanloom.operators import tree

    for html in (False, True):
        for markup in ('<a X="1" x="2">t</A><a x="1>2" y>u</a><a x="1>', "<p a=b/>x<p a=b/>y<br><BR>z</p >", "<" * 50_000 + ">", "<script>a<b</script><script>c</script>"):
            first = tree.serialise(tree.parse(markup, html), html)
            assert tree.serialise(tree.parse(markup, html), html) == first
            assert all(len(x) <= tree._SHORT for x in tree._SEEN[html])


def test_rules_look_only_at_marks_that_may_apply(monkeypatch):
    """A plain text between many spans costs no look at each of them."""
    from spanloom.operators import spans

    looked = []
    monkeypatch.setattr(spans, "_LETTER_MARK", type("Looks", (dict,), {"__missing__": lambda self, c: looked.append(c) or c.isalpha()})())
    text = f"{OPEN_B}b:A{OPEN_E}x{CLOSE} und " * 1000
    assert spans._suffix_in(spans._prefix_in(text)) == text and not looked


def test_formats_are_found_without_extraction(spark, monkeypatch):
    def packed(*names):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for n in names:
                z.writestr(n, "<x>a</x>")
        return data.getvalue()

    broken = packed("content.xml").replace(b"<x>a</x>", b"<x>b</x>")
    contents = [packed(office.DOCX_MAIN), packed("ppt/slides/slide1.xml"), packed("content.xml"), packed("other"), packed("content.xml")[:-9], broken, b"<p>a</p>", b"<html>a</html>", b"<TEI>a</TEI>", b"a", None]
    docs = spark.createDataFrame([(k, c and bytearray(c)) for k, c in enumerate(contents)], "doc_id long, content binary")
    want = {r.doc_id: r.format for r in engine.extract(docs, content="content").skeleton.collect()}
    assert {r.doc_id: r.format for r in engine.found_formats(docs, content="content").collect()} == want
    monkeypatch.setattr(engine, "finish", None)
    assert [engine.format_one("zip", None, c) for c in contents[:6]] == ["docx", "pptx", "odt", "unknown", "unknown", "unknown"]
    assert engine.format_one("html", "<p>", None) == "html-fragment" and engine.format_one("odp", None, contents[2]) == "odp"


def test_empty_tei_elements_come_back_as_written():
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<TEI><teiHeader><p></p><x/></teiHeader>'
    for text in ("<text></text>", "<text/>", "<text><p>a<pb/> b <seg></seg>c</p><p></p><p/></text>", '<text><p>a tf-added-before="1" b<lb/>c</p></text>'):
        whole = f"{head}{text}</TEI>\n"
        assert round_trip(whole, "tei") == whole


def test_pages_cleaned_by_one_tree_are_those_of_the_long_way():
    import random

    s, r = Settings(stream="visl"), random.Random(5)
    tags = "<p> </p> <b> </b> <i> </i> <a_href=x> </a> <br> <div> </div> <ul><li> </li> <script> a<b </script> <!--_c_--> <?pi_x?> <pre> </pre> <ruby> </ruby> <svg> </svg> <td> </table> <h1_title='q_&amp;_r'> <img_alt='z_'> <b></b> <x> </x> <style> </style> <p_a=1_A=2> <![CDATA[q_<_z]]> </head> <body_c=d> <sub> </sub>".replace("'", '"').split()
    words = ["a", " ", "b c", " d", "e ", "é", "-", ".", "\n", "&amp;", "&lt;x", "&", "&quot;", "'", "\xa0", "x"]
    taken = 0
    for _ in range(4000):
        text = "".join(r.choice(tags).replace("_", " ") if r.random() < 0.45 else r.choice(words) for _ in range(r.randint(1, 22)))
        if r.random() < 0.7:
            text = f"<!DOCTYPE html>\n<html><head><meta charset='x'></head><body>{text}</body></html>"
        got = engine.clean_page("html", text, s)
        if got:
            fmt, found = extract_one("html", text, None, s)
            assert got == (fmt, render_one(fmt, "<!doctype" in text.lower(), found.skeleton, found.styles, None, None, s)[0]), text
            taken += 1
    assert taken > 2000


def test_pages_are_cleaned_by_one_tree(monkeypatch):
    """Only elements with spans that change go the long way."""
    seen = []
    monkeypatch.setattr(engine, "finish", lambda styled, *a, **k: (seen.append(styled), engine_finish(styled, *a, **k))[1])
    page = "<!DOCTYPE html>\n<html><head></head><body>" + "<p>a <b><i>x</i></b> c</p><h1>y</h1>" * 50 + "<p>in<i>side</i></p></body></html>\n"
    assert engine.clean_page("html", page, Settings(stream="visl"))[1] == page.replace("in<i>side", "<i>inside")
    assert len(seen) == 1 and len(seen[0]) < 50


engine_finish = engine.finish


def test_lines_without_a_page_are_those_of_the_page():
    import random

    from spanloom.functions.markers import shielded
    from spanloom.operators import formats, tree

    r = random.Random(1)
    parts = ["a", " ", "\t", "\n", "\n\n", "&", "&amp;", "<b>", '"', "'", "­", "é", "-", "_", "\xa0", "\r", "\x85", OPEN_B, "charset=x", "&shy;", "😀"]
    for _ in range(2000):
        s = Settings(format="line", stream=r.choice(["visl", "cg", "apertium"]), extract_more=r.random() < 0.3, mangle_xml=r.random() < 0.3)
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        want, classes = tree.Found(), s.classes("line")
        styled = formats.styled_html(formats.text_as_html(shielded(text), True), s.stream, classes, want)
        tree.finish(styled, classes, want, s.extend, s.extract_more, s.mangle_xml)
        got = extract_one("line", text, None, s)[1]
        assert got == want, text
        new = {b["block_id"]: r.choice(["", "  ", "n", " n ", "<i>&", "n\tm", b["body"].upper(), f"{OPEN_B}b:x{OPEN_E}y{CLOSE}"]) for b in want.blocks if r.random() < 0.7}
        page = engine.unshielded(formats.text_out(engine._rendered(want.skeleton, {}, new, s), True))
        assert render_one("line", False, got.skeleton, {}, new, None, s)[0] == page, (text, new)


def test_lines_are_not_parsed(monkeypatch):
    monkeypatch.setattr(engine, "parse", None)
    s = Settings(format="line", stream="visl")
    found = extract_one("line", "a b\n--\n c", None, s)[1]
    assert [b["body"] for b in found.blocks] == ["a b", " c"]
    assert render_one("line", False, found.skeleton, {}, {found.blocks[1]["block_id"]: "D"}, None, s)[0] == "a b\n--\n D"


def test_blocks_and_styles_alone_are_those_of_the_whole(spark):
    """A state that isn't kept finds blocks, and styles, without a skeleton; they are those of the extraction."""
    page = '<!DOCTYPE html>\n<html><head><title>t &am</title></head><body><img title="Bild &lt;b&gt;" alt="z"><p title="x">a <b><i>b</i></b> c<br>d &#38;amp; \'e\'</p><pre>no</pre><b><div>in <i> block</i> z</div></b><p> <u><s>all</s> </u></p></body></html>\n'
    docs = spark.createDataFrame([(1, page), (2, None), (3, "<p>eins <i>zwei</i> drei</p>"), (4, "Grüße\n\nan alle")], "doc_id long, text string")
    for stream in ("visl", "apertium"):
        state = engine.extract(docs, Settings(stream=stream, mark_headers=True))
        kept = engine.State(state.extracted, state.settings)
        for part in ("blocks", "styles"):
            got, want = getattr(state, part), getattr(kept, part)
            assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
            assert "skeleton" not in got._jdf.queryExecution().optimizedPlan().toString()
    places = {r.attr_name: (r.block_no, r.place) for r in kept.blocks.filter("doc_id = 1 AND kind = 'attribute' AND block_no < 4").collect()}
    assert places == {"alt": (2, 2), "title": (3, 1)}


def test_start_tags_are_read_once(monkeypatch):
    """A tag that comes again under the same classes is looked up, whatever its texts and attributes."""
    from spanloom.operators import formats, tree

    classes = formats.HTML_TAGS.overridden({"inline": ["+", "zz"]})
    read = []
    monkeypatch.setattr(tree, "_one_tag", lambda part, real=tree._one_tag: (read.append(part), real(part))[1])
    markup = '<p title="b" alt="a">x &amp; y</p><zz>q</zz>' * 500
    alone, whole = tree.Found(), tree.Found()
    assert tree.blocks_of_markup(markup, classes, alone, skeleton=False) and sorted(read) == ['<p title="b" alt="a">', "<zz>"]
    tree.take_blocks(tree.parse(markup), classes, whole)
    assert alone.blocks == whole.blocks and alone.skeleton == ""


def test_inline_elements_are_asked_for_once():
    """Whether inline elements fill their block or hold one, in nests and rows that would take squares of time one by one."""
    import time

    from spanloom.operators import formats, tree

    def spans(markup):
        found = tree.Found()
        return tree.tag_spans(tree.parse(markup, html=True), formats.HTML_TAGS, found).count(OPEN_B)

    assert spans("<p><i><b>a</b></i></p>") == 0 and spans("<p>x <i><b>a</b></i></p>") == 2
    assert spans("<b>x<div>a <i>b</i></div></b>") == 1 and spans("<div>x <b>a<div>b</div></b> <i>c</i></div>") == 1
    began = time.process_time()
    assert spans("<p>x " + "<i>y <b>" * 20_000 + "z" + "</b></i>" * 20_000 + "</p>") == 40_000
    assert spans("<p>" + "<i>y</i> " * 40_000 + "</p>") == 40_000
    assert time.process_time() - began < 20


def test_runs_are_written_as_trees_are():
    from spanloom.operators import tree

    for xml in ('<a:r><a:rPr b="1"/><a:t>x &lt; "y"</a:t></a:r>', "<a:r><a:t/></a:r>", '<w:r><w:rPr><w:b/></w:rPr><w:t>a</w:t></w:r>', "<w:r>loose<w:t>a</w:t></w:r>", "<w:r><w:t>a</w:t><w:t>b</w:t><!-- c --></w:r>"):
        run = tree.parse(xml).kids[0]
        assert office._small(run) == tree.serialise(run)


def test_formats_by_tags_ignore_the_case_of_ascii_letters_alone(spark):
    from pyspark.sql import functions as F

    from spanloom.operators import detect

    texts = ["a</HTML>b", "</Tei>", "</STRONG>", "</ſ>", "x</ſpan>", "</ a>", "no", "", None, "</FONT>", "</q></html>"]
    got = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", detect.by_text(F.col("text")).alias("f"))
    assert [r.f for r in sorted(got.collect())] == ["html", "tei", "html-fragment", "text", "text", "text", "text", "text", "text", "html-fragment", "html"]
