"""Rule-based quality filter: a table of thresholds compiled into one Spark projection without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = (
    "the be to of and that have with a in is it for on was as are this by an or from at "
    "der die das und in den von zu mit dem des auf für ist ein eine nicht sich im auch als "
    "le la les de et un une du des que qui dans par pour pas sur au est avec il "
    "el los las y en por con una se del su para es lo al"
).split()


class Rule(NamedTuple):
    """low <= measure <= high is asked of documents that have at least min_words words; None leaves a side open."""

    name: str
    measure: str
    low: float | None
    high: float | None
    min_words: int = 0


RULES = (
    Rule("word_count", "n_words", 1, 100_000),
    Rule("word_length", "mean_word_length", 2, 12, 5),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("upper_case", "upper_ratio", None, 0.3, 5),
    Rule("stop_words", "stop_word_ratio", 0.06, 0.6, 50),
    Rule("sentence_lines", "terminal_line_ratio", 0.6, None, 20),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9, 5),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3, 5),
)

MEASURES = ("n_words", "mean_word_length", "symbol_ratio", "upper_ratio", "stop_word_ratio", "terminal_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _passes(rule: Rule) -> Column:
    value, ok = F.col(rule.measure), F.lit(True)
    if rule.low is not None:
        ok = ok & (value >= rule.low)
    if rule.high is not None:
        ok = ok & (value <= rule.high)
    return ok | (F.col("n_words") < rule.min_words) if rule.min_words else ok


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """One row per input row: doc_id, the measures, failed (names of the broken rules, in table order) and keep.

    Words are runs of non-space characters, lines are runs of characters other than line feeds; ratios over nothing are
    0. A null text counts as empty and fails word_count. A null doc_id stays null, repeated rows are judged each for
    itself, other columns of docs are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    n = lambda pattern: F.regexp_count("text", F.lit(pattern))
    # a word list is split off once; only the words that are in the list are kept
    stops = F.size(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w.isin(*sorted(set(stop_words)))))
    counted = base.select(
        "doc_id",
        F.length("text").alias("chars"),
        n(r"\S+").alias("n_words"),
        n(r"\s").alias("spaces"),
        n(r"[#$%&*|!~^<>{}=]").alias("symbols"),
        n(r"[A-Z]").alias("uppers"),
        stops.alias("stops"),
        n(r"[^\n]+").alias("lines"),
        n(r"[.!?:;\"'”»…][ \t\r]*(\n|$)").alias("terminals"),
        n(r"(^|\n)[ \t]*[-*•‣+]").alias("bullets"),
        n(r"(\.\.\.|…)[ \t\r]*(\n|$)").alias("ellipses"),
    )
    measured = counted.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        _ratio(F.col("chars") - F.col("spaces"), F.col("n_words")).alias("mean_word_length"),
        _ratio(F.col("symbols"), F.col("n_words")).alias("symbol_ratio"),
        _ratio(F.col("uppers"), F.col("chars")).alias("upper_ratio"),
        _ratio(F.col("stops"), F.col("n_words")).alias("stop_word_ratio"),
        _ratio(F.col("terminals"), F.col("lines")).alias("terminal_line_ratio"),
        _ratio(F.col("bullets"), F.col("lines")).alias("bullet_line_ratio"),
        _ratio(F.col("ellipses"), F.col("lines")).alias("ellipsis_line_ratio"),
    )
    failed = F.concat_ws(",", *[F.when(~_passes(rule), F.lit(rule.name)) for rule in rules])
    return measured.select("*", failed.alias("failed")).withColumn("keep", F.col("failed") == "")


def quality_rules_sql(rules: tuple[Rule, ...] = RULES, stop_words: list[str] = STOP_WORDS) -> str:
    """The same over the table documents, for DuckDB."""
    listed = ", ".join(f"'{w}'" for w in sorted(set(stop_words)))
    n = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    quoted = "'" + "'"
    failed = ", ".join(
        "CASE WHEN NOT ("
        + " AND ".join(["TRUE"] + [f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None))
        + (f" OR n_words < {r.min_words}" if r.min_words else "")
        + f") THEN '{r.name}' END"
        for r in rules
    )
    return f"""
    WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    counted AS (
      SELECT doc_id, length(t) AS chars, {n(r'[^ \t\n\x0B\f\r]+')} AS n_words, {n(r'[ \t\n\x0B\f\r]')} AS spaces,
             {n(r'[#$%&*|!~^<>{}=]')} AS symbols, {n('[A-Z]')} AS uppers,
             len(list_filter(string_split_regex(lower(t), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w IN ({listed}))) AS stops,
             {n(r'[^\n]+')} AS lines, {n(r'[.!?:;"' + quoted + r'”»…][ \t\r]*(\n|$)')} AS terminals,
             {n(r'(^|\n)[ \t]*[-*•‣+]')} AS bullets, {n(r'(\.\.\.|…)[ \t\r]*(\n|$)')} AS ellipses
      FROM base),
    measured AS (
      SELECT doc_id, CAST(n_words AS BIGINT) AS n_words,
             CASE WHEN n_words > 0 THEN CAST(chars - spaces AS DOUBLE) / n_words ELSE 0.0 END AS mean_word_length,
             CASE WHEN n_words > 0 THEN CAST(symbols AS DOUBLE) / n_words ELSE 0.0 END AS symbol_ratio,
             CASE WHEN chars > 0 THEN CAST(uppers AS DOUBLE) / chars ELSE 0.0 END AS upper_ratio,
             CASE WHEN n_words > 0 THEN CAST(stops AS DOUBLE) / n_words ELSE 0.0 END AS stop_word_ratio,
             CASE WHEN lines > 0 THEN CAST(terminals AS DOUBLE) / lines ELSE 0.0 END AS terminal_line_ratio,
             CASE WHEN lines > 0 THEN CAST(bullets AS DOUBLE) / lines ELSE 0.0 END AS bullet_line_ratio,
             CASE WHEN lines > 0 THEN CAST(ellipses AS DOUBLE) / lines ELSE 0.0 END AS ellipsis_line_ratio
      FROM counted),
    judged AS (SELECT *, concat_ws(',', {failed}) AS failed FROM measured)
    SELECT *, failed = '' AS keep FROM judged
    """
