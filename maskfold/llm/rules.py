"""Quality rules as a bitmask ledger.

`ledger` measures a text once and stores every rule's failure as one bit beside the measurements.
Policies are masks over these bits, so a new policy version or an ablation is integer arithmetic on
the ledger and never reads a text again.
"""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskfold.plans.ordering import bind

from . import text as T

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """`fails` is a boolean SQL expression over the measurements; the bit never changes its meaning."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Iterable[Rule]) -> int:
        known = {r.name: r.bit for r in rules}
        return sum(1 << known[n] for n in set(self.rules))


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 25 * n_words"),
    Rule(5, "repeated_lines", "n_dup_lines > 3 AND 100 * n_dup_lines > 60 * n_lines"),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
POLICY = Policy("2", tuple(r.name for r in RULES))


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text (all occurrences)."""
    windows = F.transform(
        F.slice(w, F.lit(1), F.size(w) - 2),
        lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i")),
    )
    # equal windows are neighbours after sorting
    twice = bind(
        F.sort_array(windows),
        lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["s"] == x["s"]) | (F.get(s, k + 1)["s"] == x["s"])),
    )
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        at, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
    )["n"]
    return F.when(F.size(w) < 4, 0).otherwise(covered)


def _measure(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(T.BLANKS)) != "")
    of_words = bind(T.words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r")))
    of_lines = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    return F.struct(
        of_words.alias("w"),
        F.length(F.translate(text, T.BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        of_lines.alias("l"),
    )


def ledger(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """One row per row of `docs`: the columns `keep`, the measurements and `fail_bits`.

    Null text counts as empty (all measurements 0). Repeated rows stay repeated; other columns of
    `docs` never clash because only `keep` is carried. An empty table gives an empty ledger.
    """
    m = F.col("__m")
    out = docs.select(*keep, _measure(F.col(text)).alias("__m")).select(
        *keep,
        m["w"]["n"].alias("n_words"),
        m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["l"]["n"].alias("n_lines"),
        m["l"]["d"].alias("n_dup_lines"),
        m["w"]["r"].alias("n_repeat_words"),
    )
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return out.withColumn("fail_bits", total)


def apply_policy(led: DataFrame, policy: Policy, rules: Iterable[Rule] = RULES, out: str = "kept") -> DataFrame:
    """Add `out`: true where no rule of the policy failed."""
    return led.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0)


def ablation(led: DataFrame, policies: Iterable[Policy], rules: Iterable[Rule] = RULES) -> DataFrame:
    """Per policy and rule: rows failed, rows failed by this rule alone, rows kept with and without it.

    The ledger is first counted by its bit pattern, at most 2**len(rules) rows.
    """
    rules = list(rules)
    patterns = led.groupBy("fail_bits").agg(F.count("*").alias("__n"))
    wanted = [
        F.struct(F.lit(p.version).alias("policy"), F.lit(r.name).alias("rule"), F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("bit"))
        for p in policies for r in rules if r.name in p.rules
    ]
    b = F.col("fail_bits")
    failed = b.bitwiseAND(F.col("x.mask"))
    rest = b.bitwiseAND(F.col("x.mask") - F.col("x.bit"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("__n"))), F.lit(0))
    return (
        patterns.select("fail_bits", "__n", F.explode(F.array(*wanted)).alias("x"))
        .groupBy("x.policy", "x.rule")
        .agg(
            count(b.bitwiseAND(F.col("x.bit")) != 0).alias("failed"),
            count(failed == F.col("x.bit")).alias("failed_alone"),
            count(failed == 0).alias("kept"),
            count(rest == 0).alias("kept_without"),
        )
    )
