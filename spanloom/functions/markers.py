"""Marker characters, character classes and rewrite rules, for Spark and Python alike."""

from __future__ import annotations

import functools
import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Private-use characters that stand for structure inside texts.
HASH_SEP = "\ue010"
OPEN_B, OPEN_E, CLOSE = "\ue011", "\ue012", "\ue013"
CHARSET = "\ue014"
BLOCK_B, BLOCK_M, BLOCK_N, BLOCK_E = "\ue015", "\ue016", "\ue017", "\ue018"
SENTINEL = "\ue019"
PROT_B, PROT_E = "\ue020", "\ue021"
RAW_B, RAW_E = "\ue022", "\ue023"
NAME_B, NAME_E = "\ue02c", "\ue02d"
LOOSE = "\ue02e"  # an ampersand of a page that begins no reference
HEADER_END = "\u2761"
SMALL_LT, SMALL_GT = "\ufe64", "\ufe65"

#: Character classes that Java, RE2 and Python's regex read the same way.
BLANK = r"[\t-\r \x85\p{Z}]"
SOLID = r"[^\t-\r \x85\p{Z}]"
CONTENT = r"[\p{L}\p{N}\p{M}\p{Pc}]"

#: The characters above mean structure only to this engine. In a document's own text each stands, from reading to
#: writing, as a character of another private plane.
_OWN = "".join((HASH_SEP, OPEN_B, OPEN_E, CLOSE, CHARSET, BLOCK_B, BLOCK_M, BLOCK_N, BLOCK_E, SENTINEL, PROT_B, PROT_E, RAW_B, RAW_E, NAME_B, NAME_E, LOOSE))
_AWAY = {ord(c): chr(0xF0000 + ord(c) - 0xE000) for c in _OWN}
_HOME = {ord(v): chr(k) for k, v in _AWAY.items()}
_SHIELDS = tuple(_AWAY.values())


def _any_of(characters: tuple[str, ...] | str, text: str) -> bool:
    """A search for each character: faster than one for a class."""
    return not text.isascii() and any([c in text for c in characters])


def shielded(text: str) -> str:
    """A document's own characters in place of marker characters."""
    return text.translate(_AWAY) if _any_of(_OWN, text) else text


def has_marks(text: str) -> bool:
    """Whether marker characters stand in a text."""
    return _any_of(_OWN, text)


def unshielded(text: str) -> str:
    return text.translate(_HOME) if _any_of(_SHIELDS, text) else text


Rules = list[tuple[str, str]]


def rewrite(column: Column, rules: Rules) -> Column:
    """Regular expression rewrites in order, on a column; ``$1`` names a group."""
    for pattern, by in rules:
        column = F.regexp_replace(column, pattern, by)
    return column


#: What BLANK matches, as characters.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def _compiled(pattern: str, by: str) -> tuple[regex.Pattern | re.Pattern, str, str]:
    """The pattern, by the faster of two engines where both read it alike; the replacement; what each match begins with."""
    literal = "" if "|" in pattern or re.search(r"\)[?*{]", pattern) else re.match(r"\(?([^\\^$.|?*+()\[\]{}]*)", pattern)[1]
    begins = literal[:-1] if pattern.lstrip("(")[len(literal) :][:1] in tuple("?*+{") else literal
    plain = pattern.replace(BLANK, f"[{BLANKS}]")
    engine = regex if re.search(r"\\[pswbdSWBD]|\(\?i|\(\?s", plain) else re
    return engine.compile(plain if engine is re else pattern), re.sub(r"\$(\d)", r"\\g<\1>", by), begins


def rewrite_text(text: str, rules: Rules) -> str:
    """The same rewrites on one text."""
    for pattern, by in rules:
        compiled, by, begins = _compiled(pattern, by)
        if begins in text:
            text = compiled.sub(by, text)
    return text


def rewrite_sql(expression: str, rules: Rules) -> str:
    """The same rewrites as SQL; for patterns without look-around and back-references."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, by in rules:
        expression = f"regexp_replace({expression}, {quoted(pattern)}, {quoted(re.sub(r'[$](\d)', r'\\\1', by))}, 'g')"
    return expression
