"""Quality rules as a ledger of bits, with DataFrame expressions only.

``ledger`` evaluates every rule once and stores measurements and ``failure_bits``; ``judge`` applies a policy version to
the bits, and ``ablation`` counts what each rule of a policy changes, from the bits alone.

Nulls: a null text is empty, has no words and fails ``few_words``; other columns are carried through untouched. Ties and
repeated rows: every row is judged alone. Empty tables give empty ledgers and counts of zero. Columns of the input named
like a ledger column are replaced by it. Texts of any length are measured whole; windows of words are compared by 64-bit
hashes (two different windows of a text of 20,000 words agree by chance once in 10^11 texts).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmerge.llm.common import let, text_of, words_of

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules; shares are of words, ``max_upper`` of the characters in words."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbols: float = 0.2
    max_upper: float = 0.5
    max_adjacent: float = 0.3
    max_dup_lines: float = 0.5
    min_word_length: float = 1.5
    max_word_length: float = 30.0


#: Rule names; a rule's place is its bit.
RULES = ("few_words", "repeat_words", "symbols", "upper", "adjacent", "dup_lines", "word_length")
#: Rules of each policy version.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("few_words", "repeat_words"),
    "v1": ("few_words", "repeat_words", "symbols", "upper", "adjacent"),
    "v2": RULES,
}


def mask_of(policy: str) -> int:
    return sum(1 << RULES.index(rule) for rule in POLICIES[policy])


def _equal_neighbours(values: Column) -> Column:
    rest = F.size(values) - 1
    same = F.zip_with(F.slice(values, 1, rest), F.slice(values, 2, rest), lambda a, b: a == b)
    return F.when(rest < 1, 0).otherwise(F.size(F.filter(same, lambda x: x)))


def _windows(words: Column) -> Column:
    """A hash for every window of words."""
    hashed = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(w[i + k] for k in range(WINDOW)))))
    return F.when(F.size(words) >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more."""

    def repeated(pairs: Column) -> Column:
        rest = F.size(pairs) - 1
        met = F.zip_with(
            F.slice(pairs, 1, rest), F.slice(pairs, 2, rest),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>")),
        )
        return F.sort_array(F.array_distinct(F.flatten(met)))

    def spread(starts: Column) -> Column:
        after = F.concat(F.slice(starts, 2, F.size(starts) - 1), F.array(starts[F.size(starts) - 1] + WINDOW))
        return F.aggregate(F.zip_with(starts, after, lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0), lambda n, k: n + k)

    pairs = F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    slow = let(F.sort_array(pairs), lambda sorted_pairs: let(repeated(sorted_pairs), spread))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(slow)


def _occurrences(text: Column, characters: str) -> Column:
    """How often single-byte characters occur."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters), F.lit(0))


def ledger(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``documents`` with a column per measurement and ``failure_bits`` (bit i: rule i of RULES fails)."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    measured = documents.withColumns({"_words": words_of(text), "_lines": lines, "_text": text})
    measured = measured.withColumn("_hashes", _windows(F.col("_words")))
    measured = measured.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": (F.length("_text") - _occurrences(F.col("_text"), " \t\n\v\f\r")).cast("long"),
        "n_symbols": _occurrences(F.col("_text"), SYMBOLS).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _covered(F.col("_hashes")).cast("long"),
        "n_adjacent": _equal_neighbours(F.col("_words")).cast("long"),
        "n_upper": F.length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("long"),
    }).drop("_words", "_lines", "_hashes", "_text")
    n, chars = F.col("n_words"), F.col("word_chars")
    failed = (
        n < limits.min_words,
        F.col("n_repeat_words") * 100 > n * limits.max_repeat_percent,
        F.col("n_symbols") > n * limits.max_symbols,
        F.col("n_upper") > chars * limits.max_upper,
        F.col("n_adjacent") > n * limits.max_adjacent,
        F.col("n_dup_lines") > F.col("n_lines") * limits.max_dup_lines,
        (chars < n * limits.min_word_length) | (chars > n * limits.max_word_length),
    )
    bits = sum((F.when(rule, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, rule in enumerate(failed)), F.lit(0))
    return measured.withColumn("failure_bits", bits.cast("long"))


def judge(ledger: DataFrame, policy: str = "v1", name: str = "kept") -> DataFrame:
    """Add whether no rule of the policy fails."""
    return ledger.withColumn(name, F.col("failure_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0)


def keep(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows that no rule of the policy fails.

    Rows are multiplied by one or none rather than filtered: Spark moves a filter below the measurements that it
    reads, and then computes them twice.
    """
    passed = F.col("failure_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0
    return ledger.select("*", F.explode(F.when(passed, F.array(F.lit(True)))).alias("_kept")).drop("_kept")


def ablation(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, fail it alone (kept if the rule goes), and remain kept.

    One aggregate over bit patterns, of which there are at most 2^rules, whatever the number of documents.
    """
    mask = F.lit(mask_of(policy)).cast("long")
    patterns = ledger.groupBy(F.col("failure_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(1 << RULES.index(rule)).cast("long").alias("bit")) for rule in POLICIES[policy])))
    each = patterns.withColumn("r", rules).select("bits", "n", "r.*")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("bits") == 0).alias("n_kept"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )
