"""Refusal classification: loose, strict and three readings of "says nothing else", and what reclassifying changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import CITATION, count_citations, fold, safe_ratio, strip_citations

#: Reading B is the default: a refusal with any prose beside it is an answer.
READINGS = ("A", "B", "C")
LENGTH_MULTIPLES = (1.0, 1.1, 1.25, 1.5, 2.0, 3.0, 4.0, float("inf"))


def _key(sentence: str) -> str:
    return sentence.rstrip(" .")


def loose(text: Column, sentence: str) -> Column:
    """The sentence occurs, its final period aside."""
    return F.contains(text, F.lit(_key(sentence)))


def strict(text: Column, sentence: str, multiple: float = 1.5) -> Column:
    """Loose, without a citation, and not longer than ``multiple`` sentences."""
    short = F.lit(True) if multiple == float("inf") else F.length(F.trim(text)) <= F.lit(multiple * len(sentence))
    return loose(text, sentence) & (count_citations(text) == 0) & short


def residual(text: Column, sentence: str) -> Column:
    """What a text says beside citations and the sentence; the whole sentence goes before its key."""
    rest = F.replace(strip_citations(text), F.lit(sentence), F.lit(" "))
    return F.replace(rest, F.lit(_key(sentence)), F.lit(" "))


def asserts(text: Column, sentence: str, reading: str = "B") -> Column:
    """Whether the residual asserts: A prose and a citation, B prose, C prose or a citation."""
    prose, cited = F.rlike(residual(text, sentence), F.lit("[A-Za-z]")), F.rlike(text, F.lit(CITATION))
    return {"A": prose & cited, "B": prose, "C": prose | cited}[reading]


def refuses(text: Column, sentence: str, reading: str = "B") -> Column:
    return loose(text, sentence) & ~asserts(text, sentence, reading)


def shows_refusal(text: Column, sentences: list[str]) -> Column:
    """For display, never a metric: any of some sentences, with case, quotes, dashes and spaces folded."""
    folded, found = fold(text), F.lit(False)
    for s in sentences:
        key = s.lower().replace("’", "'").replace("—", "-").replace("–", "-").rstrip(" .")
        found = found | F.contains(folded, F.lit(key))
    return found


def _moved(answers: DataFrame, sentence: str, reading: str) -> DataFrame:
    return answers.withColumn("loose", loose(F.col("text"), sentence)).withColumn("now", refuses(F.col("text"), sentence, reading))


def reclassify(answers: DataFrame, sentence: str, reading: str = "B") -> DataFrame:
    """Both sides of moving from loose to a reading, in one row: over-refusals recovered, correct refusals lost.

    ``answers``: id, text, answerable. Which answers they are is :func:`reclassified`.
    """
    over, ok = F.col("answerable") & F.col("loose"), ~F.col("answerable") & F.col("loose")
    return _moved(answers, sentence, reading).agg(
        F.count_if("answerable").alias("ans_n"),
        F.count_if(~F.col("answerable")).alias("unans_n"),
        F.count_if(over).alias("n_loose_over"),
        F.count_if(over & ~F.col("now")).alias("n_recovered"),
        F.count_if(ok).alias("n_loose_ok"),
        F.count_if(ok & ~F.col("now")).alias("n_lost"),
    )


def reclassified(answers: DataFrame, sentence: str, reading: str = "B") -> DataFrame:
    """``(id, side)`` of answers that the reading no longer counts as refusals: ``recovered`` or ``lost``, a row each."""
    moved = _moved(answers, sentence, reading).where("loose and not now")
    return moved.select("id", F.when(F.col("answerable"), "recovered").otherwise("lost").alias("side"))


def reading_grid(answers: DataFrame, sentence: str) -> DataFrame:
    """Refusal counts by reading, for both kinds of question: one pass over the answers."""
    marks = [F.struct(F.lit(r).alias("reading"), refuses(F.col("text"), sentence, r).alias("refused")) for r in READINGS]
    a = answers.select("answerable", F.explode(F.array(*marks)).alias("m"))
    return a.groupBy(F.col("m.reading").alias("reading")).agg(
        F.count_if(F.col("answerable") & F.col("m.refused")).alias("over_refusals"),
        F.count_if(~F.col("answerable") & F.col("m.refused")).alias("refusals_ok"),
        F.count_if("answerable").alias("ans_n"),
        F.count_if(~F.col("answerable")).alias("unans_n"),
    )


def length_grid(answers: DataFrame, sentence: str) -> DataFrame:
    """Strict refusals by length multiple."""
    marks = [F.struct(F.lit(m).alias("multiple"), strict(F.col("text"), sentence, m).alias("refused")) for m in LENGTH_MULTIPLES]
    a = answers.select("answerable", F.explode(F.array(*marks)).alias("m"))
    return a.groupBy(F.col("m.multiple").alias("multiple")).agg(
        F.count_if(F.col("answerable") & F.col("m.refused")).alias("over_refusals"), F.count_if(~F.col("answerable") & F.col("m.refused")).alias("refusals_ok")
    )


def score_bounds(total: Column, n: Column, unjudged: Column) -> tuple[Column, Column]:
    """Mean with unjudged items as 0 and as 1, to 6 digits."""
    return F.round(safe_ratio(total, n), 6), F.round(safe_ratio(total + unjudged, n), 6)


def gap_bounds(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Difference of two intervals and its sign, ``indeterminate`` where it spans 0."""
    lo, hi = F.round(a_low - b_high, 6), F.round(a_high - b_low, 6)
    sign = F.when(lo > 0, "positive").when(hi < 0, "negative").otherwise("indeterminate")
    return F.struct(lo.alias("lo"), hi.alias("hi"), sign.alias("sign"))
