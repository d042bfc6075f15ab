"""A ledger of quality rules, in DataFrame operations only.

Each document is measured once; every rule is one bit of ``failed``. Policies are versions of a set of rules and decide
by bitwise operations over the ledger alone, so a new version, or the ablation of a rule, never reads a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Bits of the ledger: rule names in their order.
RULES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words", "shouting")
#: Versions: the rules that each asks for. Version 1 is the base.
POLICIES = {1: ("few_words", "repeated_windows"), 2: ("few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words", "shouting")}
CURRENT = 2


def mask(version: int) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[version])


def _without(text: Column, letters: str) -> Column:
    for c in letters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not at each use inside a lambda."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = 5) -> Column:
    """How many words lie in windows of so many words that occur twice or more, the first included."""
    last = F.size(words) - window

    def count(hashes: Column) -> Column:
        def cover(s: Column) -> Column:
            twin = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"]))
            places = F.sort_array(F.transform(twin, lambda x: x["i"]))
            start = F.struct(F.lit(-window).alias("p"), F.lit(0).alias("n"))
            return F.aggregate(
                places, start, lambda acc, p: F.struct(p.alias("p"), (acc["n"] + F.least(F.lit(window), p - acc["p"])).alias("n")), lambda acc: acc["n"]
            )

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, cover))

    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    return F.when(last < 0, F.lit(0)).otherwise(_let(hashes, count)).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed) of each row of ``docs``.

    failed holds bit i if rule i of RULES fails. A null text has no words and no lines. Windows are compared by 64-bit
    hashes of their words. Texts are read whole however long. Rows are kept as they are, repeated or not; an empty table gives
    none; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    blank = "[ \\t-\\r]"
    words = F.split(F.regexp_replace("text", f"^{blank}+|{blank}+\\z", ""), f"{blank}+", -1)
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    upper = F.length(F.regexp_replace("text", "[^\\p{Lu}]+", ""))
    rows = rows.select(
        "doc_id",
        F.length(_without(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        upper.alias("n_upper"),
        F.when(F.col("text").rlike("[^ \\t-\\r]"), _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))).alias("w"),
    )
    rows = rows.withColumns({"n_words": F.coalesce("w.n", F.lit(0)).cast("long"), "n_repeat_words": F.coalesce("w.r", F.lit(0)).cast("long")}).drop("w")
    n = F.col("n_words")
    fails = {
        "few_words": n < 10,
        "repeated_windows": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 100 * F.col("n_symbols") > 50 * n,
        "duplicate_lines": (F.col("n_dup_lines") >= 3) & (100 * F.col("n_repeat_words") > 15 * n),
        "long_words": F.col("word_chars") > 20 * n,
        "shouting": 100 * F.col("n_upper") > 60 * F.col("word_chars"),
    }
    failed = sum((F.when(fails[r], F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)), F.lit(0)).cast("long")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("failed"))


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds base_failed (a rule of version 1) and kept (no rule of version 1 or of ``version``) to a ledger.

    Every row of the ledger is judged by its own bits, repeated or not, whatever its id; an empty ledger stays empty.
    """
    base = F.col("failed").bitwiseAND(F.lit(mask(1))) != 0
    return rows.withColumns({"base_failed": base, "kept": F.col("failed").bitwiseAND(F.lit(mask(1) | mask(version))) == 0})


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without) for each rule of a policy: documents that fail it, that fail nothing else of the policy, and that stay without it.

    Rows of the ledger count one by one, repeated or not, whatever their ids; with an empty ledger all counts are 0.
    """
    active = F.col("failed").bitwiseAND(F.lit(mask(version)))
    patterns = rows.groupBy(active.alias("failed")).agg(F.count("*").alias("n"))  # at most 2 ** len(RULES) rows
    total_of = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    total = [
        F.struct(
            F.lit(r).alias("rule"),
            total_of(F.col("failed").bitwiseAND(F.lit(bit)) != 0).alias("n_failed"),
            total_of(F.col("failed") == bit).alias("n_only"),
            total_of(F.col("failed").bitwiseAND(F.lit(~bit)) == 0).alias("n_kept_without"),
        )
        for r, bit in ((r, 1 << RULES.index(r)) for r in POLICIES[version])
    ]
    return patterns.agg(F.array(*total).alias("x")).select(F.explode("x").alias("x")).select("x.*")
