"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document.  The ledger keeps the measurements and one bit
for each failed rule; a policy is a named, versioned mask over these bits, so that applying
another policy, or asking what a single rule costs, never measures a text again.

Defined results: a null or empty text has no words, measures 0 and fails FEW_WORDS.  Rows with
equal or null ids are judged one by one.  An empty table gives an empty ledger.  Other columns of
the input aren't read by ledger(); keep() returns them as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """bit: its place in the mask; fails: SQL over the measures, true for a document that fails."""

    bit: int
    name: str
    fails: str


#: The bits are stable: a new rule takes a new bit, and ledgers already written stay valid.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbol_heavy", "10 * n_symbols > 3 * word_chars"),
    Rule(3, "long_words", "word_chars > 40 * n_words"),
    Rule(4, "short_words", "2 * word_chars < 3 * n_words"),
    Rule(5, "many_symbols", "10 * n_symbols > word_chars"),
    Rule(6, "mean_word_over_15", "word_chars > 15 * n_words"),
    Rule(7, "any_dup_line", "n_dup_lines > 0"),
)

#: Policies by version: a document is rejected if it fails any rule of the mask.
POLICIES = {
    "base/1": ("few_words", "repeated_windows"),
    "standard/1": ("few_words", "repeated_windows", "symbol_heavy", "long_words", "short_words"),
    "strict/1": tuple(r.name for r in RULES),
}


def mask_of(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _measured(df: DataFrame, text: Column) -> DataFrame:
    """df (of columns that start with an underscore) with a column for each measure.

    The steps are separate projections so that each array is made once and read often.
    """
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(NON_SPACE))
    a = df.withColumn("_t", F.coalesce(text, F.lit(""))).withColumn("_l", lines)
    a = a.withColumn("_w", F.array_remove(F.split("_t", SPACES), ""))
    a = a.select(
        *[c for c in df.columns],
        "_w",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
    )
    # a window is known by a 64-bit hash of its words' hashes; it is compared within its document only
    at = ", ".join(f"_g[i + {k}]" for k in range(WINDOW))
    a = a.withColumn("_g", F.transform("_w", lambda w: F.xxhash64(w))).drop("_w")
    a = a.withColumn(
        "_h",
        F.expr(f"CASE WHEN n_words < {WINDOW} THEN array() ELSE transform(sequence(0, size(_g) - {WINDOW}), i -> xxhash64({at})) END"),
    ).drop("_g")
    # most documents repeat no window; only the others pay for the sort
    a = a.withColumn("_z", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN array_sort(transform(_h, (h, i) -> struct(h, i))) END")).drop("_h")
    a = a.withColumn(
        "_p",
        F.expr("array_sort(transform(filter(_z, (e, k) -> (k > 0 AND _z[greatest(k - 1, 0)].h = e.h) OR (k < size(_z) - 1 AND _z[least(k + 1, size(_z) - 1)].h = e.h)), e -> e.i))"),
    ).drop("_z")
    covered = f"aggregate(_p, struct(0L AS n, -{WINDOW} AS last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) AS n, p AS last), a -> a.n)"
    return a.withColumn("n_repeat_words", F.expr(f"coalesce({covered}, 0L)")).drop("_p")


def _failed() -> Column:
    bits = F.lit(0).cast("bigint")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measures, failed (bigint, a bit for each rule that the document fails)."""
    df = _measured(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), F.col("_text"))
    return df.select(F.col("_id").alias("doc_id"), *MEASURES).withColumn("failed", _failed())


def verdict(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with base_failed and kept under the policy; no text is read."""
    return ledger.withColumns(
        {
            "base_failed": F.col("failed").bitwiseAND(F.lit(mask_of("base/1"))) != 0,
            "kept": F.col("failed").bitwiseAND(F.lit(mask_of(policy) | mask_of("base/1"))) == 0,
        }
    )


def keep(docs: DataFrame, policy: str = "standard/1", text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    row = docs.select(F.struct("*").alias("_row"))
    # never null, and not deterministic: the filter stays above the measures instead of being copied, with all that they
    # are made from, into each step
    measured = _measured(row, F.col(f"_row.`{text}`")).withColumn("_failed", F.when(F.monotonically_increasing_id() >= 0, _failed()))
    kept = measured.where(F.col("_failed").bitwiseAND(F.lit(mask_of(policy) | mask_of("base/1"))) == 0)
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail only it, and that the policy without it would keep.

    A single aggregation over the bits; one row for each rule.
    """
    names = {r.name: 1 << r.bit for r in RULES}
    whole = mask_of(policy)
    bad = F.col("failed").bitwiseAND(F.lit(whole))
    sums = []
    for name in POLICIES[policy]:
        bit = names[name]
        sums += [
            F.count_if(bad.bitwiseAND(F.lit(bit)) != 0).alias(f"{name}_fails"),
            F.count_if(bad == bit).alias(f"{name}_alone"),
            F.count_if(bad.bitwiseAND(F.lit(~bit)) == 0).alias(f"{name}_without"),
        ]
    one = ledger.agg(*sums)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}_fails").alias("n_fails"), F.col(f"{n}_alone").alias("n_alone"), F.col(f"{n}_without").alias("n_kept_without")) for n in POLICIES[policy]])
    return one.select(F.inline(rows))
