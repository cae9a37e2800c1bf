"""Quality rules: a threshold table compiled into one projection of built-in functions.

Null text counts as empty. A text without words, or with fewer than ``MIN_WORDS``,
fails the base test. Every row of the input comes back, repeated rows and rows with a
null id included; an empty table gives an empty result. The input row travels in the
struct ``doc``, so its columns may have any names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50

# Function words of the four languages, lower case.
STOP_WORDS = (
    "the of and to in a that is it for as was with be by on at this are or from an they you he she not have has but "
    "la de le les des et en un une que qui du au pour par dans il elle est sur "
    "el los las y del se con su una para es al no lo como más "
    "der die und den dem das ist ein eine zu von mit auf für im nicht auch sich als ich wir sie"
).split()


class Rule(NamedTuple):
    """Keep a text only if ``low <= 1000 * part / whole <= high`` (per mille, null: open)."""

    name: str
    part: str
    whole: str
    low: int | None
    high: int | None


RULES = (
    Rule("word_length", "word_chars", "n_words", 2500, 12000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop", "n_words", 50, None),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("line_words", "n_words", "n_lines", 2000, None),
)


def compile_rules(rules: tuple[Rule, ...]) -> str:
    """The table as one SQL condition; the same text runs in any SQL engine."""
    tests = []
    for r in rules:
        if r.low is not None:
            tests.append(f"1000 * {r.part} >= {r.low} * {r.whole}")
        if r.high is not None:
            tests.append(f"1000 * {r.part} <= {r.high} * {r.whole}")
    return " AND ".join(tests) or "true"


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that stand twice or more in ``words``.

    Windows are sorted by hash and words, so equal ones are neighbours; the hash only
    makes most comparisons short.
    """
    def window(i: Column) -> Column:
        a, b, c = (F.get(words, i + k) for k in range(3))
        return F.struct(F.xxhash64(a, b, c).alias("h"), a.alias("a"), b.alias("b"), c.alias("c"), i.alias("i"))

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def covered(s: Column) -> Column:
        repeated = F.filter(
            s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))
        )
        return F.aggregate(
            F.array_sort(F.transform(repeated, lambda x: x["i"])),
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum")),
            lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(3), i - acc["last"])).alias("sum")),
            lambda acc: acc["sum"],
        )

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))
    # transform over a one-element array evaluates ``windows`` once and names it.
    return F.when(F.size(words) >= 3, F.get(F.transform(F.array(windows), covered), F.lit(0))).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc`` (the input row) and its counts: words, word_chars, symbols, stop words, lines, repeats."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    split = docs.select(
        F.struct("*").alias("doc"),
        F.array_remove(F.split(body, SPACE), "").alias("words"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    return split.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``base_failed`` and ``kept``."""
    base = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words"
    return measured.select("*", F.expr(base).alias("base_failed"), F.expr(f"NOT ({base}) AND {compile_rules(rules)}").alias("kept"))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with their own columns.

    The row number keeps the filter above the projection: pushed below it, the measures
    would be computed again inside the condition.
    """
    judged = judge(measure(docs, text), rules).withColumn("_stay", F.col("kept") & (F.monotonically_increasing_id() >= 0))
    return judged.where("_stay").select("doc.*")


def oracle_sql(rules: tuple[Rule, ...] = RULES, source: str = "documents") -> str:
    """The same result in DuckDB SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    base = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {source}),
s AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
u AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM s),
g AS (SELECT r, i, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z FROM u WINDOW p AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) > 1 AS again FROM g WHERE z IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM f, (VALUES (0), (1), (2)) AS o(k) WHERE again GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop,
        CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM s LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed,
  NOT ({base}) AND {compile_rules(rules)} AS kept
FROM m
"""
