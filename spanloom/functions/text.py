"""Scalar text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markers import BLANK, CONTENT, SMALL_GT, SMALL_LT, SOLID

_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def replaced(column: Column, *pairs: tuple[str, str]) -> Column:
    """Plain replacements in order."""
    for a, b in pairs:
        column = F.replace(column, F.lit(a), F.lit(b))
    return column


def xml_escape(column: Column, newlines: bool = False) -> Column:
    """The five entities; ``newlines`` adds references for tab, line feed and carriage return."""
    out = replaced(column, ("&", "&amp;"), ('"', "&quot;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;"))
    return replaced(out, ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")) if newlines else out


def xml_unescape(column: Column) -> Column:
    """The inverse; the ampersand comes last."""
    return replaced(column, ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def mangle(column: Column) -> Column:
    """Angle brackets become small ones that no stream mistakes for markup."""
    return F.translate(column, "<>", SMALL_LT + SMALL_GT)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, _ASCII_UPPER, _ASCII_LOWER)


def trim_ascii(column: Column) -> Column:
    return F.btrim(column, F.lit(" \t\r\n"))


def trim_wordblank(column: Column) -> Column:
    return F.btrim(column, F.lit("; \t\r\n"))


def reduce_space(column: Column) -> Column:
    """Blanks at either end shrink to one space, or to none where there was no space character."""
    lead, tail = F.regexp_extract(column, r"^[ \t\r\n]+", 0), F.regexp_extract(column, r"[ \t\r\n]+\z", 0)
    one = lambda blanks: F.when(blanks.contains(" "), " ").otherwise("")
    core = trim_ascii(column)
    return F.when(core == "", one(lead)).otherwise(F.concat(one(lead), core, one(tail)))


def left_trim(column: Column) -> Column:
    return F.regexp_replace(column, rf"^{BLANK}+", "")


def right_trim(column: Column) -> Column:
    return F.regexp_replace(column, rf"{BLANK}+\z", "")


def is_blank(column: Column) -> Column:
    """Not empty, and blanks alone."""
    return column.rlike(rf"^{BLANK}+\z")


def has_content(column: Column, more: bool = False) -> Column:
    """Whether a text is worth a block: a letter, mark, digit or connector; ``more``: anything that isn't blank."""
    return column.rlike(SOLID if more else CONTENT)
