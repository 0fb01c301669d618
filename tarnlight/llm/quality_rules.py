"""Quality rules: a table of thresholds compiled into one projection, in DataFrame functions only.

A rule is a row of ``RULES``: a measure of the text, the least and the greatest value that a kept text may have. Measures are
lengths and ratios of words, symbols, stop words and lines (after Rae et al. 2021). ``failures`` turns a table into one
column, the names of the rules that a text breaks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.select import unused


class Rule(NamedTuple):
    """Texts whose ``measure`` is under ``least`` or over ``most`` break the rule; None sets no bound."""

    name: str
    measure: str
    least: float | None
    most: float | None


#: The first two are the base: at least 50 words, at most half of them in three-word windows that occur twice or more.
BASE = (Rule("too_short", "n_words", 50, None), Rule("repetitive", "repeat_word_ratio", None, 0.5))
RULES = BASE + (
    Rule("word_length", "mean_word_length", 2.5, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("shouting", "exclamation_ratio", None, 0.1),
    Rule("few_stop_words", "stop_word_ratio", 0.06, None),
    Rule("few_alphabetic", "alphabetic_ratio", 0.8, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.4),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.3),
)

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "with", "be", "as", "by", "this", "at", "are", "from", "or", "have",
    "der", "die", "das", "und", "zu", "den", "von", "mit", "sich", "des", "für", "auf", "ist", "im", "nicht", "dem", "ein", "eine", "als",
    "de", "la", "le", "les", "et", "en", "un", "une", "du", "que", "est", "pour", "dans", "qui", "au", "par", "pas", "sur", "avec",
    "el", "los", "se", "del", "y", "por", "las", "con", "una", "no", "su", "para", "es", "lo", "al",
)

#: As they stand in a text: on their own, or with a mark behind.
_SPELLED = [w + mark for w in STOP_WORDS for mark in ("", ",", ".", ";", ":", "!", "?")]

_SPACE = " \t\n\x0b\x0c\r"
_WORDS, _LINES, _GRAMS = "_words", "_lines", "_grams"


def _share(part: Column | str, whole: Column | str) -> Column:
    """``part`` by ``whole``, as doubles; 0 where there is nothing to divide by."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _n_repeated(grams: Column, words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more; ``grams`` has the windows' hashes in order.

    Windows are put in order by hash, those equal to a neighbour are kept, and their places add up to a union of stretches
    of three. The hash has 64 bits: a text of a million words has a chance of 1 in 37 million that two windows share one.
    """

    def marked(ordered: Column) -> Column:
        again = F.filter(ordered, lambda x, k: F.coalesce((x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]), F.get(ordered, k + 1)["h"] == x["h"], F.get(ordered, k - 1)["h"] == x["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # each of the two arrays is bound to a name by a one-element array, so that it is built once
    places = F.flatten(F.transform(F.array(ordered), marked))
    steps = F.flatten(F.transform(F.array(places), lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))))
    total = F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("bigint")).otherwise(total)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``measures`` (named otherwise if that is taken: see ``select.unused``) of counts and ratios.

    Counts are longs, ratios doubles. Null and empty texts and texts without words have 0 throughout. Rows are neither dropped
    nor joined nor shuffled.
    """
    out = unused(docs, "measures")
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    trimmed = F.btrim("t", F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    rows = rows.select("row", "t", words.alias(_WORDS), lines.alias(_LINES))
    w = F.col(_WORDS)
    three = lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
    grams = F.slice(F.transform(w, three), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    count = lambda array, test: F.size(F.filter(array, test)).cast("bigint")
    rows = rows.select(
        "row", _WORDS, grams.alias(_GRAMS), F.size(_WORDS).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"), (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("bigint").alias("n_exclamations"), F.size(_LINES).cast("bigint").alias("n_lines"),
        (F.size(_LINES) - F.size(F.array_distinct(_LINES))).cast("bigint").alias("n_dup_lines"),
        count(w, lambda x: F.lower(x).isin(*_SPELLED)).alias("n_stop_words"), count(w, lambda x: x.rlike(r"\p{L}")).alias("n_alphabetic"),
        count(F.col(_LINES), lambda x: x.rlike(r"^\s*[-*•‣]\s")).alias("n_bullet_lines"), count(F.col(_LINES), lambda x: x.rlike(r"(\.\.\.|…)\s*$")).alias("n_ellipsis_lines"),
    )
    rows = rows.withColumn("n_repeat_words", _n_repeated(F.col(_GRAMS), F.col(_WORDS)))
    ratios = [
        _share("word_chars", "n_words").alias("mean_word_length"), _share("n_symbols", "n_words").alias("symbol_ratio"), _share("n_exclamations", "n_words").alias("exclamation_ratio"),
        _share("n_stop_words", "n_words").alias("stop_word_ratio"), _share("n_alphabetic", "n_words").alias("alphabetic_ratio"),
        _share("n_repeat_words", "n_words").alias("repeat_word_ratio"), _share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        _share("n_bullet_lines", "n_lines").alias("bullet_line_ratio"), _share("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"),
    ]
    counts = ["n_words", "word_chars", "n_symbols", "n_exclamations", "n_lines", "n_dup_lines", "n_stop_words", "n_alphabetic", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words"]
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.struct(*counts, *ratios).alias(out))


def failures(measures: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a struct of measures breaks, in the table's order; an empty array if it breaks none."""
    broken = []
    for r in rules:
        tests = ([measures[r.measure] < F.lit(r.least)] if r.least is not None else []) + ([measures[r.measure] > F.lit(r.most)] if r.most is not None else [])
        broken += [F.when(t, F.lit(r.name)) for t in tests]
    return F.array_distinct(F.array_compact(F.array(*broken))) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the structs ``measures`` and the array ``failed``: the rules that each text breaks. All rows stay.

    A column of the caller's with one of the two names keeps it; the new one then gets underscores. Null and empty texts break
    ``too_short`` and whatever else 0 breaks.
    """
    measured = measure(docs, text)
    return measured.withColumn(unused(docs, "failed"), failures(F.col(measured.columns[-1]), rules))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text breaks no rule, with their own columns."""
    judged = judge(docs, rules, text)
    return judged.where(F.size(judged.columns[-1]) == 0).select(*[f"`{c}`" for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    m = F.col("measures")
    # the same comparison in whole numbers, which no rounding touches
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return judged.select(
        "doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"), (~base & (F.size("failed") == 0)).alias("kept"), F.array_join("failed", ",").alias("failed"),
    )
