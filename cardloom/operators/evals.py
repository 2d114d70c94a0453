"""Evaluation of outputs: assertions on JSON, verdicts, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardloom.operators.settle import settled

#: Operators whose failure is severe.
SEVERE = ("money", "catalog_id", "benefit", "must_not_exist", "must_not_claim")
TOLERANCE = 0.01


def at_path(variant: Column, path: str) -> tuple[Column, Column]:
    """(found, text) of a $.a.b path; a JSON null is found."""
    value = F.try_variant_get(variant, path, "variant")
    return value.isNotNull(), F.to_json(value)


def holds(operator: str, variant: Column, path: str, wanted: Column | None = None, whole: Column | None = None, claims: tuple[str, ...] = ()) -> Column:
    """Whether an assertion holds of an output: the value at a path equals what is wanted (equals, catalog_id, benefit: JSON in order
    of its keys), is as much money, has it once among its entries, is not there, or the output makes none of the claims."""
    found, actual = at_path(variant, path)
    if operator in ("equals", "catalog_id", "benefit"):
        ok = found & (actual == wanted)
    elif operator == "money":
        ok = found & (F.abs(actual.try_cast("double") - wanted.try_cast("double")) <= TOLERANCE + 1e-12)
    elif operator == "exactly_once":
        entries = F.coalesce(F.try_variant_get(variant, path, "array<variant>"), F.array(F.try_variant_get(variant, path, "variant")))
        ok = found & (F.size(F.filter(entries, lambda e: F.to_json(e) == wanted)) == 1)
    elif operator == "must_not_exist":
        ok = ~found
    elif operator == "must_not_claim":
        ok = F.lit(True)
        for c in claims:
            ok = ok & ~F.contains(F.lower(F.coalesce(actual, whole)), F.lit(c.lower()))
    else:
        raise ValueError(f"no assertion {operator}")
    return F.coalesce(ok, F.lit(False))


def assertions_of(rows: DataFrame, assertions: list[tuple], baseline: str, candidate: str) -> DataFrame:
    """rows with assertions: an array of (op, baseline, candidate, severe), one for each assertion (operator, path, wanted, claims).
    baseline, candidate: columns of JSON texts, each parsed once a row."""
    read = settled(rows.withColumns({"_b": F.try_parse_json(baseline), "_c": F.try_parse_json(candidate)}))
    each = [F.struct(F.lit(o).alias("op"), holds(o, F.col("_b"), p, w, F.col(baseline), c).alias("baseline"), holds(o, F.col("_c"), p, w, F.col(candidate), c).alias("candidate"), F.lit(o in SEVERE).alias("severe")) for o, p, w, c in assertions]
    return read.select(*rows.columns, F.array(*each).alias("assertions"))


def asserted(rows: DataFrame, assertions: list[tuple], baseline: str, candidate: str) -> DataFrame:
    """rows once for each assertion, with op, baseline, candidate and severe."""
    return assertions_of(rows, assertions, baseline, candidate).select(*rows.columns, F.inline("assertions"))


def verdict(assertions: Column) -> dict[str, Column]:
    """What verdicts gives, of a row's own array of assertions: nothing is multiplied, grouped or shuffled."""
    some = F.when(F.size(assertions) > 0, True)
    base, cand = some & F.forall(assertions, lambda a: a["baseline"]), some & F.forall(assertions, lambda a: a["candidate"])
    severe = F.exists(assertions, lambda a: a["severe"] & a["baseline"] & ~a["candidate"])
    return {"baseline_passed": base, "passed": cand, "regression": base & ~cand, "severe_regression": base & ~cand & severe, "requires_review": ~cand}


def verdicts(scored: DataFrame, case: str) -> DataFrame:
    """Per case from its assertions (baseline, candidate, severe): all must hold; a case without assertions is for review."""
    base, cand = F.bool_and("baseline"), F.bool_and("candidate")
    out = scored.groupBy(case).agg(base.alias("baseline_passed"), cand.alias("passed"), F.bool_or(F.col("severe") & F.col("baseline") & ~F.col("candidate")).alias("_s"))
    regression = F.col("baseline_passed") & ~F.col("passed")
    return out.select(case, "baseline_passed", "passed", regression.alias("regression"), (regression & F.col("_s")).alias("severe_regression"), (~F.col("passed")).alias("requires_review"))


def blind_side(seed: Column) -> Column:
    """Which output is shown as A: by the parity of the first byte of a digest."""
    return F.when(F.conv(F.substring(F.sha2(seed, 256), 1, 2), 16, 10).cast("int") % 2 == 0, F.lit("baseline_is_a")).otherwise(F.lit("baseline_is_b"))


def run_summary(results: DataFrame, by: str) -> DataFrame:
    """Counts, rates, cost and nearest-rank 95th percentile of latency of each run, and what blocks it."""
    blockers = F.array_compact(F.array(F.when(F.count_if(F.col("severe") & F.col("baseline_pass") & ~F.col("candidate_pass")) > 0, F.lit("severe_regression")), F.when(F.count_if(F.col("status") == "execution_error") > 0, F.lit("execution_errors")), F.when(F.count_if(F.col("status") == "review") > 0, F.lit("pending_review"))))
    return results.groupBy(by).agg(
        F.count("*").alias("cases"), F.round(F.count_if("baseline_pass") / F.count("*"), 6).alias("baseline_rate"), F.round(F.count_if("candidate_pass") / F.count("*"), 6).alias("candidate_rate"), F.count_if(F.col("status") == "review").alias("reviews"),
        F.sum("cost_usd").cast("double").alias("cost_usd"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_ms"), F.array_join(blockers, ",").alias("blockers"))
