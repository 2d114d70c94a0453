"""Differences between the benefits a card has and those proposed for it, as set algebra in stages.

Each stage takes the rows no stage before has settled. A stage is windows over a card's rows of one key, so the plan grows
by a few windows a stage and nothing is joined; a card has few benefits, and "more than one" is told by least and
greatest. Rows: side (c current, p proposed), id, card_id, dedupe_key, semantic_key, condition, source, subject, v6.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CONFLICT, MISMATCH, AMBIGUOUS = "conflicting_proposed_terms", "dedupe_key_condition_mismatch", "ambiguous_benefit_match"


def _over(*keys: str):
    return Window.partitionBy("card_id", *keys)


def _several(test: Column, value: str, *keys: str) -> Column:
    """Whether rows of the key that pass test have more than one value."""
    v = F.when(test, F.col(value))
    return F.coalesce(F.min(v).over(_over(*keys)) != F.max(v).over(_over(*keys)), F.lit(False))


def _count(test: Column, *keys: str) -> Column:
    return F.sum(F.when(test, 1).otherwise(0)).over(_over(*keys))


def diff(terms: DataFrame) -> DataFrame:
    """terms with outcome: unchanged, identity_migration, modification, addition, possible_removal or a conflict's code."""
    current, proposed, alive = F.col("side") == "c", F.col("side") == "p", F.col("outcome").isNull()

    def settle(rows: DataFrame, test: Column, outcome) -> DataFrame:
        return rows.withColumn("outcome", F.when(alive & test, outcome if isinstance(outcome, Column) else F.lit(outcome)).otherwise(F.col("outcome")))

    def spread(rows: DataFrame, outcome: str) -> DataFrame:
        """A key that is settled is settled for all its rows of that side."""
        hit = F.max(F.when(F.col("outcome") == outcome, 1)).over(Window.partitionBy("card_id", "side", "dedupe_key")) == 1
        return settle(rows, F.coalesce(hit, F.lit(False)), outcome)

    rows = terms.withColumn("outcome", F.lit(None).cast("string"))
    rows = settle(rows, _several(current, "condition", "dedupe_key") | _several(proposed, "condition", "dedupe_key"), MISMATCH)
    torn = _several(proposed, "condition", "semantic_key") & _several(proposed, "source", "semantic_key")
    rows = spread(settle(rows.withColumn("torn", torn), F.col("torn"), CONFLICT), CONFLICT)
    fit = proposed & F.col("v6") & ~F.col("torn")
    rows = spread(settle(rows, _several(fit, "semantic_key", "subject") & _several(fit, "source", "subject") & (fit | current), CONFLICT), CONFLICT)

    n_c, n_p = _count(alive & current, "dedupe_key"), _count(alive & proposed, "dedupe_key")
    same = ~_several(alive, "condition", "dedupe_key")
    rows = rows.withColumns({"_both": (n_c > 0) & (n_p > 0), "_same": same})
    rows = settle(rows, F.col("_both"), F.when(F.col("_same"), F.lit("unchanged")).otherwise(F.lit(MISMATCH)))

    legacy = alive & current & ~F.col("dedupe_key").startswith("card-benefit-v2:")
    publishable = alive & proposed & F.col("v6")
    rows = rows.withColumn("_one", (_count(legacy, "condition") == 1) & (_count(publishable, "condition") == 1) & (legacy | publishable))
    rows = settle(rows, F.col("_one"), "identity_migration")

    rows = rows.withColumns({"_c": _count(alive & current, "semantic_key"), "_p": _count(alive & proposed, "semantic_key")})
    rows = settle(rows, (F.col("_c") > 0) & (F.col("_p") > 0), F.when((F.col("_c") == 1) & (F.col("_p") == 1), F.lit("modification")).otherwise(F.lit(AMBIGUOUS)))

    rows = rows.withColumns({"_p": _count(alive & proposed, "semantic_key"), "_s": _several(alive & proposed, "source", "semantic_key")})
    rows = settle(rows, proposed & (F.col("_p") > 1) & F.col("_s"), CONFLICT)
    rows = settle(rows, F.lit(True), F.when(proposed, F.lit("addition")).otherwise(F.lit("possible_removal")))
    return rows.select(*terms.columns, "outcome")
