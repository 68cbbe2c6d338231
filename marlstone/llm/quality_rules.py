"""Quality rules as a ledger of failure bits, with versioned policies and ablations over the bits.

ledger() measures each text and evaluates every rule once; bit k of `failed` is set where rule k fails. The
ledger is stored, as a DataFrame alone would measure all texts again for each use. A policy is a mask of rules, so
that another policy, or the effect of leaving a rule out, reads the stored ledger alone. Windows of words are compared by 64-bit hashes within one text.

Defined results: null and empty texts have no words and fail `few_words`; a null doc_id and repeated rows are
rows as any other; other columns of the input don't reach the ledger; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rules in the order of their bits: name and failing condition over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
]
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """The rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << k for k, (name, _) in enumerate(RULES) if name in self.rules)


POLICIES = {
    "1": Policy("1", BASE),
    "2": Policy("2", tuple(name for name, _ in RULES)),
}


def measured(docs: DataFrame, carried: str = "doc_id") -> DataFrame:
    """The carried column and the measurements, in one pass without exchange. Each step names the one before twice or more, so none is computed anew for each element."""
    df = docs.selectExpr(carried, "coalesce(text, '') AS t")
    carried = df.columns[0]
    df = df.selectExpr(carried, "t", r"filter(split(t, '[ \\t-\\r]+', -1), x -> x != '') AS w", r"filter(split(t, '\n', -1), x -> length(translate(x, ' \t\n\u000b\u000c\r', '')) > 0) AS l")
    df = df.selectExpr(
        carried,
        "cast(size(w) AS bigint) AS n_words",
        r"cast(length(translate(t, ' \t\n\u000b\u000c\r', '')) AS bigint) AS word_chars",
        "cast(length(t) - length(translate(t, '#*$%&|<>', '')) AS bigint) AS n_symbols",
        "cast(size(l) AS bigint) AS n_lines",
        "cast(size(l) - size(array_distinct(l)) AS bigint) AS n_dup_lines",
        "CASE WHEN size(w) < 5 THEN cast(array() AS array<bigint>) ELSE transform(w, x -> xxhash64(x)) END AS h",
    )
    rest = [carried, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    df = df.selectExpr(*rest, "CASE WHEN size(h) < 5 THEN h ELSE transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])) END AS g")
    df = df.selectExpr(*rest, "CASE WHEN size(array_distinct(g)) = size(g) THEN cast(array() AS array<struct<x:bigint,i:int>>) ELSE sort_array(transform(g, (x, i) -> struct(x, i))) END AS s")
    df = df.selectExpr(*rest, "CASE WHEN size(s) = 0 THEN cast(array() AS array<int>) ELSE sort_array(transform(s, (e, k) -> CASE WHEN get(s, k - 1).x = e.x OR get(s, k + 1).x = e.x THEN e.i END)) END AS p")
    repeats = "aggregate(filter(p, i -> i IS NOT NULL), struct(-5 AS at, cast(0 AS bigint) AS n), (a, i) -> struct(i AS at, a.n + least(5, i - a.at) AS n), a -> a.n)"
    # The row number keeps the optimizer from pushing a filter on verdicts down into the steps above, which would compute them anew for each element.
    return df.selectExpr(*rest, f"{repeats} + 0 * monotonically_increasing_id() AS n_repeat_words")


def ledger(docs: DataFrame, carried: str = "doc_id") -> DataFrame:
    """doc_id (or another carried column), measurements and the failure bits of all rules."""
    bits = " | ".join(f"CASE WHEN {rule} THEN {1 << k}L ELSE 0L END" for k, (_, rule) in enumerate(RULES))
    return measured(docs, carried).withColumn("failed", F.expr(bits))


def stored_ledger(docs: DataFrame, carried: str = "doc_id") -> DataFrame:
    """The ledger, written to the shared folder and read again: policies and ablations measure nothing."""
    return stored(ledger(docs, carried), "ledger")[0]


def filtered(docs: DataFrame, policy: Policy) -> DataFrame:
    """The documents that the policy keeps, with their columns. The stored ledger holds the rows too, so that no join is needed, nor an id that tells rows apart."""
    return apply_policy(stored_ledger(docs, "struct(*) AS row"), policy).where("kept").select("row.*")


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with `kept`: no rule of the policy failed."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents it fails, those it alone rejects, and those kept without it."""
    failed = F.col("failed").bitwiseAND(F.lit(policy.mask))
    chosen = [(name, 1 << k) for k, (name, _) in enumerate(RULES) if name in policy.rules]
    sums = [F.count(F.lit(1)).alias("n_documents"), F.count_if(failed == 0).alias("n_kept")]
    for name, bit in chosen:
        sums += [F.sum(F.expr(f"(failed & {bit}L) / {bit}")).cast("long").alias(f"f_{name}"), F.count_if(failed == bit).alias(f"a_{name}")]
    names = ", ".join(f"struct('{name}' AS rule, coalesce(f_{name}, 0) AS n_failed, a_{name} AS n_alone, n_kept + a_{name} AS n_kept_without)" for name, _ in chosen)
    return entries.agg(*sums).selectExpr("n_documents", "n_kept", f"array({names}) AS rules").selectExpr("n_documents", "n_kept", "inline(rules)")
