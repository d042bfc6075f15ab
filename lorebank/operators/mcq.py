"""Question screening: format score, failure codes and verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.wordlists import OPTION_KEYS


def char_diff(a: Column, b: Column) -> Column:
    """Characters of ``a`` that differ from those at the same place in ``b``, the shorter padded with blanks."""
    n = F.greatest(F.length(a), F.length(b))
    pad = lambda x: F.split(F.rpad(x, n, F.lit(" ")), "")
    return F.size(F.filter(F.zip_with(pad(a), pad(b), lambda x, y: x != y), lambda d: d))


def format_score(question: Column, options: Column, correct: Column) -> Column:
    """struct(score, codes) of a question with options (map of key to text) and the key of the right one."""
    keys, values = F.map_keys(options), F.transform(F.map_values(options), lambda v: F.lower(F.trim(v)))
    want = F.array(*[F.lit(k) for k in OPTION_KEYS])
    wrong_keys = (F.size(F.array_except(keys, want)) > 0) | (F.size(F.array_except(want, keys)) > 0)
    right = F.lower(F.trim(F.coalesce(F.try_element_at(options, correct), F.lit(""))))
    others = F.transform(F.map_values(F.map_filter(options, lambda k, _: k != correct)), lambda v: F.lower(F.trim(v)))
    diverse = F.size(F.filter(others, lambda o: char_diff(o, right) > 3))
    tests = (
        (wrong_keys, 0.40, "FORMAT_ERROR"),
        (~F.array_contains(want, correct), 0.30, "FORMAT_ERROR"),
        (~question.rlike("[ঀ-৿]"), 0.20, "FORMAT_ERROR"),
        (F.size(F.array_distinct(values)) < F.size(values), 0.25, "DUPLICATE_OPTIONS"),
        (diverse < 2, 0.20, "WEAK_DISTRACTORS"),
        (F.length(F.trim(question)) < 10, 0.15, "FORMAT_ERROR"),
    )
    score, codes = F.lit(1.0), []
    for fails, cost, code in tests:
        score = score - F.when(fails, cost).otherwise(0.0)
        codes.append(F.when(fails, code))
    return F.struct(T.rnd(F.greatest(F.lit(0.0), score), 3).alias("score"), F.array_sort(F.array_distinct(F.array_compact(F.array(*codes)))).alias("codes"))


def composite(fmt: Column, grounding: Column, clarity: Column, distractor: Column) -> Column:
    return F.lit(0.20) * fmt + F.lit(0.35) * grounding + F.lit(0.25) * clarity + F.lit(0.20) * distractor


def codes(grounding: Column, distractor: Column, rules: Column | None = None) -> Column:
    """The failure codes of a question: those that its ``rules`` (an array) gave, and those of scores below their bounds."""
    found = F.array_compact(F.array(F.when(grounding < 0.80, "WRONG_GROUNDING"), F.when(distractor < 0.55, "WEAK_DISTRACTORS")))
    return found if rules is None else F.array_union(rules, found)


def passed(total: Column, grounding: Column, found: Column) -> Column:
    return (total >= 0.70) & (grounding >= 0.80) & ~F.arrays_overlap(found, F.array(F.lit("FORMAT_ERROR"), F.lit("WRONG_GROUNDING")))
