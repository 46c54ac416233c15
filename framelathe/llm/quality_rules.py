"""Line-first quality rules, in Spark's own expressions only.

Every line of a text is judged by punctuation, navigation and boilerplate
rules; failing lines are removed; a document that loses too much of its text,
or fails the base rules on the whole text, is rejected.  All work happens
inside a row, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import balanced, WORD

#: Phrases of boilerplate lines.  Fixed values.
PHRASES = (
    r"licensed under|all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|"
    r"we use cookies|accept (?:all )?cookies|enable javascript|javascript is (?:disabled|required)|"
    r"click here|subscribe to|sign up for|sign in|log in to|share this|powered by|copyright \(c\)"
)
#: What any phrase matches, and phrases as whole words.
ANY_PHRASE = f"(?i)(?:{PHRASES}|©)"
WHOLE_PHRASE = f"(?i)(?:(?:^|[^a-z0-9])(?:{PHRASES})(?:$|[^a-z0-9])|©)"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_percent: int = 20  # words in repeated 5-word windows
    max_symbol_percent: int = 30  # of a line's words that end in two or more of the marks below
    max_bars_percent: int = 25  # of a line's words that are a lone | or the like
    min_bars: int = 2
    words_per_phrase: int = 25  # a line fails if it has a phrase for so many of its words
    max_lost_percent: int = 50  # of a document's words on removed lines


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column, r: QualityRules) -> Column:
    """True where one of the rules fails; a line without a word never does.

    Punctuation: too many words end in runs of marks (``!!``, ``***``, ``%%%``).
    Navigation: too many separators (``|``, ``»``, ``·``, ``>``) stand alone.
    Boilerplate: phrases of licences, cookie notices and calls to act, for a
    short line one of them; a sentence that uses one doesn't fail its paragraph.
    """
    n = count_of(line, WORD)
    marks = count_of(line, r"[!?*#$%&~^=_+]{2,}[.,;:]?(?=[\x20\x09-\x0D]|$)")
    bars = count_of(line, r"(?<![^\x20\x09-\x0D])[|»·>•](?![^\x20\x09-\x0D])")
    return (
        (marks * 100 > n * r.max_symbol_percent)
        | ((bars >= r.min_bars) & (bars * 100 > n * r.max_bars_percent))
        | (line.rlike(ANY_PHRASE) & (count_of(line, WHOLE_PHRASE) * r.words_per_phrase >= n) & line.rlike(WHOLE_PHRASE))
    )


def quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """``docs`` (doc_id, text, anything else) with the rules' columns.

    Adds ``clean_text`` (lines that pass, joined by newline; null for a null
    text), ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_removed_words`` (long), ``base_failed`` and ``kept``.  A null text counts
    as empty: no words, base_failed.  Every row gives one row, repeated or not,
    however long its text is; a column of ``docs`` that bears one of these names
    is replaced.  Empty table: empty.
    """
    r = rules
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("_q", F.struct(text.alias("t")))
    t = F.col("_q.t")
    w = F.col("_w")
    df = df.withColumn("_w", words_of(t))
    df = df.withColumn("_lines", F.split(t, "\n", -1))
    df = df.withColumn("_good", F.filter("_lines", lambda x: ~line_fails(x, r)))
    df = df.withColumn("_worded", F.filter("_lines", lambda x: x.rlike(WORD)))
    # one hash for each word, then one for each window of five
    df = df.withColumn("_h", F.transform(w, lambda x: F.xxhash64(x)))
    h = F.col("_h")
    df = df.withColumn(
        "_win",
        F.when(F.size(h) < 5, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.size(h) - 5),
                lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]),
            )
        ),
    )
    win = F.col("_win")
    df = df.withColumn(
        "_again",
        F.when(
            F.size(F.array_distinct(win)) < F.size(win),
            F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ),
    )
    again = F.col("_again")
    twice = F.filter(
        F.transform(
            again,
            lambda s, k: F.when(
                (s["x"] == F.get(again, k - 1)["x"]) | (s["x"] == F.get(again, k + 1)["x"]), s["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("_at", F.when(again.isNotNull(), F.sort_array(twice)))
    at = F.col("_at")
    covered = F.aggregate(
        F.transform(at, lambda p, k: F.least(F.lit(5), p - F.coalesce(F.get(at, k - 1), F.lit(-5)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    df = df.withColumn("_clean", F.array_join("_good", "\n"))
    n = F.size(w).cast("long")
    out = {
        "clean_text": F.when(F.col("text").isNotNull(), F.col("_clean")),
        "n_words": n,
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_removed_words": n - count_of(F.col("_clean"), WORD),
    }
    scratch = {"_q", "_w", "_lines", "_good", "_worded", "_h", "_win", "_again", "_at", "_clean"}
    added = [*out, "base_failed", "kept"]
    df = df.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in added and c not in scratch],
        *[v.alias(k) for k, v in out.items()],
    )
    df = df.withColumn(
        "base_failed",
        (F.col("n_words") < r.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * r.max_repeat_percent),
    )
    # The row number is always true here; being non-deterministic it keeps a later filter above these
    # projections, where pushing it down would repeat their expressions within each other.
    return df.withColumn(
        "kept",
        ~F.col("base_failed")
        & (F.col("n_removed_words") * 100 <= F.col("n_words") * r.max_lost_percent)
        & (F.monotonically_increasing_id() >= 0),
    )


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = balanced(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept"
    )


_W = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '{_W}') AS w FROM d
), win AS (
  SELECT k, i, list_extract(w, i) || chr(1) || list_extract(w, i+1) || chr(1) || list_extract(w, i+2) || chr(1)
               || list_extract(w, i+3) || chr(1) || list_extract(w, i+4) AS x
  FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
), twice AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT k, sum(least(5, i - coalesce(p, -100))) AS n
  FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS p FROM twice) GROUP BY k
), ln AS (
  SELECT k, unnest(string_split(t, chr(10))) AS l FROM d
), judged AS (
  SELECT k, l, len(regexp_extract_all(l, '{_W}')) AS n,
    len([x FOR x IN regexp_extract_all(l, '{_W}') IF regexp_matches(x, '[!?*#$%&~^=_+]{{2,}}[.,;:]?$')]) AS marks,
    len([x FOR x IN regexp_extract_all(l, '{_W}') IF regexp_matches(x, '^[|»·>•]$')]) AS bars,
    regexp_matches(l, '{WHOLE_PHRASE}') AND len(regexp_extract_all(l, '{WHOLE_PHRASE}')) * 25 >= len(regexp_extract_all(l, '{_W}')) AS boiler
  FROM ln
), lines AS (
  SELECT k, sum(CASE WHEN marks * 100 > n * 30 OR (bars >= 2 AND bars * 100 > n * 25) OR boiler THEN n ELSE 0 END) AS lost,
    count(*) FILTER (WHERE n > 0) - count(DISTINCT l) FILTER (WHERE n > 0) AS dup
  FROM judged GROUP BY k
), f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    dup::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, lost::BIGINT AS n_removed_words
  FROM w JOIN lines USING (k) LEFT JOIN rep USING (k)
)
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_removed_words * 100 <= n_words * 50 AS kept
FROM f
"""
