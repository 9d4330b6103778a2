r"""Quality rules: a table of thresholds compiled into one Spark projection.

Measures are column expressions over the text; ``compile_rules`` turns a table
of (measure, lowest, highest) into one boolean expression. No user functions.

Defined results: a null text has no words and fails, like an empty one. Ratios
with denominator zero are zero. Texts of any length are measured whole; a word
is a run of characters outside ``[\x20\x09-\x0D]``. Repeated rows and ids each
return a row, a null id too. All columns pass through untouched, whatever their
names: the measures are one struct column behind them, under a name of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, read_table

SPACE = r"[\x20\x09-\x0D]+"
ELLIPSIS = r"(…|\.\.\.)[\x20\x09-\x0D]*\z"
BULLET = r"\A[\x20\x09-\x0D]*[-*•‣][\x20\x09-\x0D]"
STOP_WORDS = (
    "the of and to in that is was he for it with as his on be at by i this had not are but from or have an they which one you were her all she there would their we him been has when who will no more if out so "
    "der die und das von zu den mit ist im für auf ein eine nicht dem des sich auch als wie "
    "de la le les et des en un une du que est pour dans qui pas par sur au il ne se ce "
    "el los las y del se una por con para su al lo como más"
).split()
_STOPS = sorted(set(STOP_WORDS))

#: measure, lowest and highest value that pass.
RULES: list[tuple[str, float, float]] = [
    ("n_words", 50, math.inf),
    ("mean_word_length", 2.0, 14.0),
    ("symbol_ratio", 0.0, 0.1),
    ("stop_words", 2, math.inf),
    ("ellipsis_line_ratio", 0.0, 0.3),
    ("bullet_line_ratio", 0.0, 0.9),
    ("dup_line_ratio", 0.0, 0.3),
    ("upper_ratio", 0.0, 0.6),
    ("repeat_word_ratio", 0.0, 0.5),
]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    The windows' hashes are sorted with their positions; equal neighbours mark
    repeated windows, and their positions, in order, cover the words. Texts
    whose windows are all different stop after the distinct count.
    """
    n = F.size(words)
    windows = F.zip_with(F.zip_with(words, F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b)), F.slice(words, 3, n), lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab, c)))
    windows = F.slice(windows, 1, n - 2)

    def covered(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        last = F.size(w) - 1

        def equal(s: Column) -> Column:
            def at(x: Column, i: Column) -> Column:
                left = (i > 0) & (F.get(s, i - 1)["h"] == x["h"])
                right = (i < last) & (F.get(s, i + 1)["h"] == x["h"])
                return left | right

            return F.sort_array(F.transform(F.filter(s, at), lambda x: x["i"]))

        def length(p: Column) -> Column:
            # each window adds three words, less what the window before it covers
            gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.when(b.isNull(), F.lit(3)).otherwise(F.least(F.lit(3), b - a)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return _let(_let(placed, equal), length)

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_let(windows, count))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def measured(df: DataFrame, text_col: str = "text", into: str = "measures") -> DataFrame:
    """``df`` and, as its last column, a struct of all measures.

    The struct is named ``into``, with underscores added while ``df`` has such a column.
    """
    into, t, p, w, base = free_name(df, into, "t", "p", "w", "base")
    out = df.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn(p, F.split(F.col(t), SPACE))
    # only the first and the last part can be empty; a text without words is one empty part
    first = (F.get(F.col(p), F.lit(0)) == "").cast("int")
    last = ((F.element_at(F.col(p), -1) == "") & (F.size(p) > 1)).cast("int")
    out = out.withColumn(w, F.slice(F.col(p), first + 1, F.size(p) - first - last))
    words = F.col(w)
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    upper = F.length(F.regexp_replace(F.col(t), r"\P{Lu}+", ""))
    out = out.withColumn(
        base,
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(F.col(t), SPACE, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(F.col(t), r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.array_intersect(F.transform(words, F.lower), F.lit(_STOPS))).cast("long").alias("stop_words"),
            upper.alias("upper"),
            _let(lines, _line_measures).alias("lines"),
        ),
    )
    b, of_lines = F.col(base), F.col(f"{base}.lines")
    found = {
        **{k: b[k] for k in ("n_words", "word_chars", "n_symbols")},
        "n_dup_lines": of_lines["dup"],
        "n_repeat_words": b["n_repeat_words"],
        "mean_word_length": _ratio(b["word_chars"], b["n_words"]),
        "symbol_ratio": _ratio(b["n_symbols"], b["word_chars"]),
        "stop_words": b["stop_words"],
        "ellipsis_line_ratio": _ratio(of_lines["ellipsis"], of_lines["n"]),
        "bullet_line_ratio": _ratio(of_lines["bullet"], of_lines["n"]),
        "dup_line_ratio": _ratio(of_lines["dup"], of_lines["n"]),
        "upper_ratio": _ratio(b["upper"], b["word_chars"]),
        "repeat_word_ratio": _ratio(b["n_repeat_words"], b["n_words"]),
    }
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.struct(*[v.alias(k) for k, v in found.items()]).alias(into))


def _line_measures(lines: Column) -> Column:
    def share(pattern: str) -> Column:
        return F.size(F.filter(lines, lambda x: x.rlike(pattern)))

    return F.struct(
        F.size(lines).alias("n"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"),
        share(ELLIPSIS).alias("ellipsis"),
        share(BULLET).alias("bullet"),
    )


def compile_rules(rules: list[tuple[str, float, float]] = RULES, at: str = "measures") -> Column:
    """One boolean: all measures, fields of the struct ``at``, within their bounds."""
    out = F.lit(True)
    for name, low, high in rules:
        if low > -math.inf:
            out = out & (F.col(at)[name] >= F.lit(low))
        if high < math.inf:
            out = out & (F.col(at)[name] <= F.lit(high))
    return out


def op9(spark, sf_dir: str) -> DataFrame:
    docs = measured(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = {k: F.col("measures")[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return docs.select("doc_id", *[v.alias(k) for k, v in m.items()], failed.alias("base_failed"), (~failed & compile_rules()).alias("kept"))


SQL9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
win AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM tri),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines, length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS n_upper,
    len(list_intersect(list_distinct(list_transform(w, lambda x: lower(x))), [{stops}])) AS n_stops,
    len(list_filter(ls, lambda x: regexp_matches(x, '(…|\.\.\.)[\x20\x09-\x0D]*\z'))) AS n_dots,
    len(list_filter(ls, lambda x: regexp_matches(x, '\A[\x20\x09-\x0D]*[-*•‣][\x20\x09-\x0D]'))) AS n_bullets
  FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / word_chars <= 0.1 AND n_stops >= 2
  AND n_dots / n_lines <= 0.3 AND n_bullets / n_lines <= 0.9 AND n_dup_lines / n_lines <= 0.3
  AND n_upper / word_chars <= 0.6 AND n_repeat_words / n_words <= 0.5 AS kept
FROM f
""".replace("{stops}", ", ".join(f"'{x}'" for x in _STOPS))
