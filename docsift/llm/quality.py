"""Quality rules kept as a ledger of failure bits; DataFrame functions only.

Every rule is evaluated once a document. The ledger holds the measurements and one bigint whose bit ``b`` says that rule
``b`` failed. A policy is a versioned mask over those bits, so a changed policy, or a what-if without one rule, is a bitwise
operation over the ledger and never a second pass over the texts.

Defined results: null text counts as empty (no words); a null id stays null; repeated rows each get their row; an empty table
gives an empty ledger; columns other than the id and the text are not read, so clashing names do no harm. Texts of any length
are measured whole: the windows of a document are sorted in one array, n log n in its length, and no other row is involved. Equal
windows of a document are told by their 64-bit hash, which is not verified: of n windows about n² / 2^65 pairs are taken for equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.shared import no_null_text, table

SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a boolean expression over the measurements, in whole numbers so that no rounding can flip it."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "no_letter", "n_letters = 0"),
    Rule(7, "digits", "2 * n_digits > word_chars"),
)

#: Versions are never changed, only added.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "2025.1": ("too_few_words", "repeated_windows", "symbols", "repeated_lines"),
    "2025.2": ("too_few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "no_letter", "digits"),
}
PRODUCTION = "2025.2"


def mask(policy: str) -> int:
    by_name = {r.name: r.bit for r in RULES}
    return sum(1 << by_name[n] for n in POLICIES[policy])


def _count(text: Column, chars: str) -> Column:
    """Characters of ``text`` among ``chars``."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def _window_ends(words: Column) -> Column:
    """Hash and place of every window of three words, equal windows side by side."""
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.expr("cast(array() as array<int>)"))
    keyed = F.transform(places, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.sort_array(keyed)


def _covered(windows: Column) -> Column:
    """Words inside windows that stand next to an equal one: each window adds what the next repeated one doesn't cover."""
    again = F.filter(windows, lambda x, k: ((k > 0) & (F.get(windows, k - 1)["h"] == x["h"])) | F.coalesce(F.get(windows, k + 1)["h"] == x["h"], F.lit(False)))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    return F.aggregate(F.transform(F.array(starts), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0).cast("long"), lambda a, x: a + x)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with all measurements; steps are projections, so a long expression is computed once."""
    step = docs.select(F.col(id_col).alias("doc_id"), no_null_text(text_col).alias("_text"))
    step = step.select(
        "doc_id",
        F.filter(F.split("_text", SPACES + "+"), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "").alias("_lines"),
        _count(F.col("_text"), SYMBOLS).alias("n_symbols"),
        _count(F.col("_text"), "0123456789").alias("n_digits"),
        (F.char_length("_text") - F.char_length(F.translate("_text", " \t\n\x0b\x0c\r", ""))).cast("long").alias("_spaces"),
        F.char_length("_text").cast("long").alias("_chars"),
        F.when(F.col("_text").rlike(r"\p{L}"), 1).otherwise(0).cast("long").alias("n_letters"),
    )
    step = step.select("doc_id", "n_symbols", "n_digits", "n_letters", F.size("_words").cast("long").alias("n_words"), (F.col("_chars") - F.col("_spaces")).alias("word_chars"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), _window_ends(F.col("_words")).alias("_windows"))
    return step.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_digits", "n_letters", _covered(F.col("_windows")).alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``fail_bits``."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(kept: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Adds ``base_failed`` and ``kept``; a base failure fails under every policy."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(policy) | mask("base")).cast("long")) != 0
    return kept.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask("base")).cast("long")) != 0).withColumn("kept", ~failed)


def ablations(kept: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that would come back without it.

    The ledger is first folded to one row a distinct bit pattern (at most 2^rules), so hot patterns cost nothing.
    """
    m = F.lit(mask(policy)).cast("long")
    patterns = kept.groupBy(F.col("fail_bits").bitwiseAND(m).alias("bits")).agg(F.count("*").alias("n"))
    names = [r for r in RULES if r.name in POLICIES[policy]]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("one")) for r in names])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.one")) != 0
    return patterns.select("bits", "n", each).groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.one"), F.col("n")).otherwise(0)).alias("n_only_this"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
p AS (SELECT k, count(DISTINCT i + d) AS n FROM r, (VALUES (0), (1), (2)) AS o(d) GROUP BY k),
m AS (SELECT doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, regexp_matches(text, '\p{L}') AS letters FROM w LEFT JOIN p USING (k)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) + (CASE WHEN NOT letters THEN 64 ELSE 0 END) + (CASE WHEN 2 * n_digits > word_chars THEN 128 ELSE 0 END) AS bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits FROM b
"""
