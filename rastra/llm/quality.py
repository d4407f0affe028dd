"""Quality rules as a ledger of failure bits.

Every rule is evaluated once on a document; the ledger keeps its measurements and one bit for each rule that
failed. Policies are masks over those bits, kept by version, so that a new policy or an ablation reads the small
ledger and never the texts again. All expressions are Spark's own.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastra.llm.common import SPACE, free_prefix

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A name and the SQL condition over the measurements under which a document fails."""

    name: str
    fails: str


#: A rule's place is its bit. New rules go to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repetition", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > word_chars"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
)
#: The rules that each version of the policy heeds.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("few_words", "repetition"),
    "v1": ("few_words", "repetition", "symbols"),
    "v2": ("few_words", "repetition", "symbols", "repeated_lines", "word_length"),
}


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(1 << i for i, rule in enumerate(RULES) if rule.name in POLICIES[policy])


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of MEASURES, all long; columns of these names are replaced.

    Words are runs of anything but ASCII white space; n_lines counts \\n-split lines with a word, n_dup_lines those equal to
    an earlier one; n_repeat_words counts words in a 3-word window that occurs at least twice in the
    text. Windows are compared by 64-bit hashes. A null text measures like an empty one: 0 each.
    """
    q = free_prefix(docs, "_q")
    text, words, hashes, ordered, places, lines = (q + x for x in ("text", "words", "hashes", "ordered", "places", "lines"))
    df = docs.drop(*MEASURES).withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumns({
        words: F.array_remove(F.split(text, f"[{SPACE}]+"), ""),
        lines: F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
    })
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": sum(((F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit(c), F.lit("")))) for c in SYMBOLS), F.lit(0)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        hashes: F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    }).drop(words, lines, text)
    # Only texts with some repeated window sort them; equal windows then stand side by side.
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    df = df.withColumn(ordered, F.when(repeated, F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.zip_with(F.slice(ordered, 1, F.size(ordered) - 1), F.slice(ordered, 2, F.size(ordered) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.drop(hashes).withColumn(places, F.when(F.col(ordered).isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))))
    steps = F.zip_with(F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places) - 1), lambda a, b: F.least(F.lit(3), b - a))
    covered = F.when(F.col(places).isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda n, step: n + step))
    return df.drop(ordered).withColumn("n_repeat_words", covered.cast("long")).drop(places)


def bits() -> Column:
    """The failure bits from the measurements."""
    failed = F.lit(0)
    for i, rule in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)))
    return failed


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, the measurements, fail_bits), one row for each row of ``docs``; ids may be null or repeated."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return measured(rows, "_text").select(F.col("_id").alias(id_col), *MEASURES, bits().alias("fail_bits"))


def kept(policy: str, fail_bits: str = "fail_bits") -> Column:
    """Whether none of the policy's rules failed."""
    return F.col(fail_bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """(rule, failed, removed_by_it_alone, kept_without_it) for each rule of a policy, from a ledger.

    Rows are first counted by their bits, so the rest works on at most two to the number of rules rows. An empty ledger gives zeros.
    """
    known = mask(policy)
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(known)).alias("failed_bits")).agg(F.count("*").alias("n"))
    n_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    columns = []
    for i, rule in enumerate(RULES):
        if known >> i & 1:
            has = F.col("failed_bits").bitwiseAND(F.lit(1 << i)) != 0
            rest = F.col("failed_bits").bitwiseAND(F.lit(known & ~(1 << i)))
            columns.append(F.struct(F.lit(rule.name).alias("rule"), n_if(has).alias("failed"), n_if(has & (rest == 0)).alias("removed_by_it_alone"), n_if(rest == 0).alias("kept_without_it")))
    return counts.agg(F.array(*columns).alias("rules")).select(F.inline("rules"))
