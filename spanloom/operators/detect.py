"""Encoding and format of documents, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lower_ascii

# Endings of names, and tags that show a fragment.
EXTENSIONS = {"docx": "docx", "pptx": "pptx", "odt": "odt", "odp": "odp", "xml": "tei", "html": "html", "htm": "html", "text": "text", "txt": "text"}
FRAGMENT_TAGS = ("</b>", "</a>", "</i>", "</span>", "</p>", "</u>", "</strong>", "</em>", "</s>", "</q>", "</font>")
ZIP_MAGIC = ("504B0304", "504B0506", "504B0708")
FORMATS = ("text", "line", "html", "html-fragment", "tei", "docx", "pptx", "odt", "odp")
#: Legacy code pages: name, Python's codec, and for each language the letters beyond ASCII that its texts are made of
#: (the common ones where the alphabet is another). None: scripts in which letters beyond ASCII stand side by side.
_PAGES: list[tuple[str, str, list[str] | None]] = [
    ("windows-1252", "cp1252", ["éèàùâêîôûçëïœ", "äöüß", "áéíóúñü", "ãõáéíóúâêôçà", "åæøäöé", "àèéìòù"]),
    ("windows-1250", "cp1250", ["ąćęłńóśźż", "áčďéěíňóřšťúůýž", "áéíóöőúüű", "ăâîşţ", "čćđšž"]),
    ("windows-1254", "cp1254", ["çğıöşü"]),
    ("windows-1251", "cp1251", ["оеаинтсрвлкмдпуяыьгзбчй"]),
    ("KOI8-R", "koi8-r", ["оеаинтсрвлкмдпуяыьгзбчй"]),
    ("windows-1253", "cp1253", ["αοιετσνηυρπκλμωςάέήίόύώ"]),
    ("Shift_JIS", "shift_jis", None),
    ("EUC-JP", "euc_jp", None),
    ("EUC-KR", "euc_kr", None),
    ("GB18030", "gb18030", None),
    ("Big5", "big5", None),
]


def _side_by_side(text: str) -> float:
    """Of the letters beyond ASCII, the share that belong together: kana and Hangul count whole, Han less."""
    total = score = 0.0
    for i, c in enumerate(text):
        if ord(c) < 128 or not c.isalpha():
            continue
        total += 1
        near = text[max(0, i - 1) : i] + text[i + 1 : i + 2]
        if any(x.isascii() and x.isalpha() for x in near):
            continue
        name = unicodedata.name(c, "")
        if name.startswith(("HIRAGANA", "KATAKANA", "HANGUL SYLLABLE")):
            score += 1
        elif name.startswith("CJK UNIFIED") and ord(c) <= 0x9FFF:
            # signs of daily use come first in the older sets
            score += 0.9 if c in _DAILY else 0.5
    return score / total if total else 0.0


_DAILY = frozenset("的一是不了在人有我他这個这们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实這個們來為國說時會對過發後裡種經麼學現當沒動還進樣開從實日語文章漢字句簡單")


def guess(data: bytes) -> tuple[str, str]:
    """The likeliest legacy code page of bytes that are no UTF-8, and their text; windows-1252 where nothing speaks for another."""
    best = (-1.0, "", "")
    # a q before an u, or few letters beyond ASCII, speak for western languages
    high = sum(b > 127 for b in data)
    western = data.lower().count(b"qu") * 10 >= high or high * 50 < len(data)
    for name, codec, languages in _PAGES:
        try:
            text = data.decode(codec)
        except UnicodeDecodeError:
            if name != "windows-1252":
                continue
            text = data.decode("latin-1").translate(_C1_TABLE)
        if languages is None:
            score = _side_by_side(text)
        else:
            # capitals speak less for a language than small letters, and not at all behind a small one; nor does a letter
            # of another alphabet beside an ASCII one
            other = languages[0][0] > "\u024f"
            letters = []
            for i, c in enumerate(text):
                if ord(c) > 127 and c.isalpha():
                    mixed = other and any(x.isascii() and x.isalpha() for x in text[max(0, i - 1) : i] + text[i + 1 : i + 2])
                    odd_case = c.isupper() and i and text[i - 1].islower()
                    letters.append((c.lower(), 0.0 if mixed or odd_case else 0.6 if c.isupper() else 1.0))
            odd = sum(ord(c) > 127 and not c.isalpha() and unicodedata.category(c)[0] not in "PZS" for c in text)
            # texts in several western languages fit none of them wholly
            sets = [(own, 1.0) for own in languages] + ([("".join(languages), 0.75)] if name == "windows-1252" else [])
            score = max(part * sum(w for c, w in letters if c in own) / (len(letters) + odd) for own, part in sets) if letters else 0.0
            if western and name in ("windows-1250", "windows-1254"):
                score *= 0.7
        if score > best[0] + 1e-9:
            best = (score, name, text)
    return best[1], best[2]


@F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType())]))
def _guessed(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if c is None else guess(bytes(c)) for c in contents], columns=["encoding", "text"])


# What the bytes 80 to 9F stand for in windows-1252; five of them for nothing.
_CP1252 = "€\u0081‚ƒ„…†‡ˆ‰Š‹Œ\u008dŽ\u008f\u0090‘’“”•–—˜™š›œ\u009džŸ"
_C1_TABLE = {0x80 + i: c for i, c in enumerate(_CP1252)}


def by_name(name: Column) -> Column:
    """The format that a file's ending shows, or null."""
    ending = lower_ascii(F.regexp_extract(name, r"\.([^./\\]+)\z", 1))
    out = F.when(F.lit(False), "")
    for e, fmt in EXTENSIONS.items():
        out = out.when(ending == e, fmt)
    return out


def by_text(text: Column) -> Column:
    """The format that a text's tags show."""
    has = lambda *tags: text.rlike(f"(?i){'|'.join(tags)}")  # noqa: E731 - ASCII letters alone, and no copy of the text
    return F.when(text.contains("</html>") | has("</html>"), "html").when(has("</tei>"), "tei").when(has(*FRAGMENT_TAGS), "html-fragment").otherwise("text")


def is_zip(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)).isin(*ZIP_MAGIC)


def _legacy(content: Column) -> Column:
    """Only bytes without a mark that are no UTF-8 go to Python."""
    head = F.hex(F.substring(content, 1, 4))
    marked = head.startswith("EFBBBF") | head.startswith("FFFE") | head.startswith("FEFF") | (head == "0000FEFF")
    return _guessed(F.when(~marked & ~F.is_valid_utf8(content.cast("string")), content))


def encoding(content: Column) -> Column:
    """By byte order mark, then by validity; what is neither is guessed from its letters, in Python."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(head.startswith("EFBBBF"), "UTF-8-BOM")
        .when(head == "FFFE0000", "UTF-32LE")
        .when(head == "0000FEFF", "UTF-32BE")
        .when(head.startswith("FFFE"), "UTF-16LE")
        .when(head.startswith("FEFF"), "UTF-16BE")
        .when(F.is_valid_utf8(content.cast("string")), "UTF-8")
        .otherwise(_legacy(content)["encoding"])
    )


def decoded(content: Column) -> Column:
    """The text of the bytes, without a byte order mark."""
    kind = encoding(content)
    rest = lambda n: F.substring(content, n + 1, 1 << 30)
    return (
        F.when(kind == "UTF-8-BOM", F.make_valid_utf8(rest(3).cast("string")))
        .when(kind.isin("UTF-32LE", "UTF-32BE"), F.decode(content, "UTF-32"))
        .when(kind == "UTF-16LE", F.decode(rest(2), "UTF-16LE"))
        .when(kind == "UTF-16BE", F.decode(rest(2), "UTF-16BE"))
        .when(kind == "UTF-8", content.cast("string"))
        .otherwise(_legacy(content)["text"])
    )
