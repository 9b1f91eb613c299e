"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

`RULES` names a measure and the bounds it must keep. Bounds are in the table, so a caller passes
another table to change the verdict. All measures come from the whole text; a null text has no
words. A text that has no words fails. A document with under 20 words, or with more than 30 % of
its words in repeated 8-word windows, fails before any rule is read. Windows are told apart by
64-bit hashes of their words' hashes.

Every row is judged alone: repeated rows and ties get equal verdicts, null ids stay null, an empty
table gives an empty one, and further columns pass through `kept_documents` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.llm.shared import settled

#: Fixed values of the contract.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW, LEAST_WORDS, REPEATED_PERCENT = 8, 20, 30

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as by was are at this from or an not but his they "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son "
    "el los del las por para con no su al lo como más y o pero sus este ya porque"
)


class Rule(NamedTuple):
    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_count", "n_words", 20, 1_000_000),
    Rule("word_length", "mean_word_length", 2.0, 14.0),
    Rule("symbols", "symbols_per_word", None, 0.35),
    Rule("stop_words", "stop_word_ratio", 0.04, None),
    Rule("duplicate_lines", "duplicate_line_ratio", None, 0.5),
    Rule("capitals", "capital_ratio", None, 0.6),
    Rule("letters", "letter_ratio", 0.5, None),
    Rule("exclamations", "exclamations_per_word", None, 0.35),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measured(rows: DataFrame) -> DataFrame:
    """Add the counts of the contract and the measures to rows of (..., text)."""
    stops = sorted({form for word in STOP_WORDS.split() for form in (word, word.capitalize())})
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = rows.withColumns({"words": settled(words_of(F.col("text"))), "lines": settled(lines)})
    step = step.withColumns(
        {
            "hashes": settled(F.transform("words", lambda w: F.xxhash64(w))),
            "stops": F.size(F.filter("words", lambda w: w.isin(stops))),
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "others": F.regexp_count(text, F.lit(r"[^\p{L}\x20\x09-\x0D]")),
            "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")),
            "exclaimed": F.regexp_count(text, F.lit("!")),
        }
    )
    spans = F.when(
        F.size("hashes") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("spans", settled(spans))
    # Most texts repeat nothing: only the others pay for sorting.
    placed = F.when(
        F.size(F.array_distinct("spans")) < F.size("spans"),
        F.sort_array(F.transform("spans", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    step = step.withColumn("placed", settled(placed))
    repeated = F.filter(
        "placed",
        lambda e, k: ((k > 0) & (F.element_at("placed", F.greatest(k, F.lit(1)))["h"] == e["h"]))
        | ((k < F.size("placed") - 1) & (F.element_at("placed", F.least(k + 2, F.size("placed")))["h"] == e["h"])),
    )
    starts = F.sort_array(F.transform(repeated, lambda e: e["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return step.withColumns(
        {
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "mean_word_length": share(F.col("word_chars"), F.col("n_words")),
            "symbols_per_word": share(F.col("n_symbols"), F.col("n_words")),
            "stop_word_ratio": share(F.col("stops"), F.col("n_words")),
            "duplicate_line_ratio": share(F.col("n_dup_lines"), F.col("n_lines")),
            "capital_ratio": share(F.col("capitals"), F.col("word_chars") - F.col("others")),
            "letter_ratio": share(F.col("word_chars") - F.col("others"), F.col("word_chars")),
            "exclamations_per_word": share(F.col("exclaimed"), F.col("n_words")),
        }
    )


def broken(rules: Sequence[Rule]) -> Column:
    """Names of the rules whose bounds a row leaves."""
    found = []
    for rule in rules:
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (F.col(rule.measure) < rule.low)
        if rule.high is not None:
            bad = bad | (F.col(rule.measure) > rule.high)
        found.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*found))


def judged(rows: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add the verdict to rows of (..., text); names of the measures must be free."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return (
        measured(rows)
        .withColumns({"base_failed": failed, "broken_rules": broken(rules)})
        .withColumn("kept", settled(~F.col("base_failed") & (F.size("broken_rules") == 0)))
    )


REPORT = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    "broken_rules",
)


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts, broken rules and verdict of every document."""
    return judged(docs.select("doc_id", "text"), rules).select(*REPORT)


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Documents that pass, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return judged(rows, rules).filter("kept").select("row.*")
