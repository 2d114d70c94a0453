"""Attempts at the sources of crawls: what a crawl keeps of them, whether it is complete, and what it did in numbers.

Attempts: (crawl, place, role, source_key, status, http_status, error_code, identity, attempted_at, history, overflow). place orders
the attempts of a crawl; history holds the attempts that an earlier compaction put together, oldest first, and overflow says
that some are gone from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardloom.operators.crawl import FALLBACK_FAILURES

#: Attempts kept of a crawl, entries kept of a source's history, how far a clock may be ahead.
KEPT, HISTORY, SKEW = 9, 6, "INTERVAL '5' MINUTE"
#: Roles that decide on a crawl, and its other role.
PRIMARY, REQUIRED, SUPPORTING = "primary", "required_supporting", "supporting"
ENTRY = ("status", "http_status", "error_code", "identity", "attempted_at")


def entry(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ENTRY])


def one_a_source(attempts: DataFrame, crawl: str, now: str) -> DataFrame:
    """One attempt for each source of each crawl: its last, with the whole history merged in the order of places.

    A source two of whose attempts share an instant, have none, or lie ahead of the clock has no last one: if it is decisive, the
    attempt fails with invalid_attempt_history; else it goes. A source may have any number of attempts: of their entries only
    the last HISTORY are ever held, which each task picks for itself before the shuffle.
    """
    key = [crawl, "role", "source_key"]
    clock = F.lit(now).cast("timestamp_ntz") + F.expr(SKEW)
    history = F.coalesce("history", F.array().cast(attempts.schema["history"].dataType))
    own = F.array(entry())
    # a history that ends with the attempt itself has it already
    merged = F.when(F.element_at(F.when(F.size(history) > 0, history), -1).eqNullSafe(entry()), history).otherwise(F.concat(history, own))
    rows = attempts.withColumn("_entries", merged).withColumn("source_key", F.coalesce("source_key", F.concat(F.lit("unproven:"), F.col("place").cast("string"))))
    sound = F.col("attempted_at").isNotNull() & (F.col("attempted_at") <= clock)
    last = F.struct(*ENTRY, "place")
    seen = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.count_distinct(F.when(sound, F.col("attempted_at"))).alias("instants"), F.max_by(last, F.struct("attempted_at", "place")).alias("last"), F.min("place").alias("first"),
        F.sum(F.size("_entries")).alias("entries"), F.max(F.coalesce("overflow", F.lit(False))).alias("over"))
    each = rows.select(*key, "place", F.posexplode("_entries").alias("pos", "e"))
    newest = Window.partitionBy(*key).orderBy(F.desc("place"), F.desc("pos"))
    kept = each.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= HISTORY)
    kept = kept.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("k"), "e"))), lambda x: x["e"]).alias("history"))
    clear = F.col("n") == F.col("instants")
    decisive = F.col("role").isin(PRIMARY, REQUIRED)
    none = F.struct(F.lit("failed").alias("status"), F.lit(None).cast(attempts.schema["http_status"].dataType).alias("http_status"), F.lit("invalid_attempt_history").alias("error_code"), F.lit(None).cast(attempts.schema["identity"].dataType).alias("identity"), F.lit(now).cast("timestamp_ntz").alias("attempted_at"), F.col("first").alias("place"))
    out = seen.join(kept, key).where(clear | decisive).withColumn("row", F.when(clear, F.col("last")).otherwise(none))
    return out.select(*key, "row.*", F.when(clear, F.col("history")).alias("history"), (clear & (F.col("over") | (F.col("entries") > HISTORY))).alias("overflow"))


def compacted(attempts: DataFrame, crawl: str, now: str, most: int = KEPT) -> DataFrame:
    """The attempts that each crawl keeps, one a source and at most so many: decisive ones first, then optional ones in their order.

    Decisive sources are never dropped in silence: beyond most of them the crawl keeps most - 1 and a failed attempt,
    decisive_attempt_overflow, which leaves it incomplete.
    """
    rows = one_a_source(attempts, crawl, now)
    decisive = F.col("role").isin(PRIMARY, REQUIRED)
    order = Window.partitionBy(crawl).orderBy(F.when(F.col("role") == PRIMARY, 0).when(decisive, 1).otherwise(2), "place")
    counts = rows.groupBy(crawl).agg(F.count_if(decisive).alias("_decisive"))
    ranked = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).join(counts, crawl)
    crowded = F.col("_decisive") > most
    kept = ranked.where(~crowded | (F.col("_n") < most)).drop("_n", "_decisive")
    by_name = {f.name: f.dataType for f in rows.schema.fields}
    values = {"role": F.lit(REQUIRED), "source_key": F.lit("invalid-source"), "status": F.lit("failed"), "error_code": F.lit("decisive_attempt_overflow"), "attempted_at": F.lit(now).cast("timestamp_ntz"), "overflow": F.lit(False)}
    marks = counts.where(crowded).select(*[(F.col(c) if c == crawl else values.get(c, F.lit(None)).cast(t)).alias(c) for c, t in by_name.items()])
    return kept.unionByName(marks)


def assessed(kept: DataFrame, crawl: str) -> DataFrame:
    """(crawl, complete, reason) from what crawls keep: the first reason that holds."""
    final = F.array_distinct(F.array_compact(F.concat(F.array("identity"), F.transform(F.coalesce("history", F.array().cast(kept.schema["history"].dataType)), lambda h: h["identity"]))))
    ok = F.coalesce((F.col("status") == "fetched") & F.col("http_status").between(200, 299) | (F.col("status") == "not_modified") & (F.col("http_status") == 304), F.lit(False))
    role = lambda r: F.col("role") == r
    open_ = role(SUPPORTING) & (F.col("status") == "failed") & F.col("error_code").isin(*FALLBACK_FAILURES)
    seen = kept.groupBy(crawl).agg(
        F.max(F.col("error_code").eqNullSafe("decisive_attempt_overflow")).alias("crowded"), F.max(F.size(final) > 1).alias("torn"), F.max("overflow").alias("over"), F.count_if(role(PRIMARY)).alias("primaries"), F.count_if(role(PRIMARY) & ok).alias("fetched"),
        F.min_by(F.when(open_, F.col("error_code")), F.when(open_, F.col("place"))).alias("open"), F.count_if(role(REQUIRED) & ~ok).alias("lacking"))
    reason = (
        F.when(F.col("crowded"), F.lit("decisive_attempt_overflow")).when(F.col("torn"), F.lit("final_resource_identity_conflict")).when(F.col("over"), F.lit("attempt_history_overflow")).when(F.col("primaries") == 0, F.lit("missing_primary"))
        .when(F.col("primaries") > 1, F.lit("multiple_primary")).when(F.col("fetched") == 0, F.lit("primary_incomplete")).when(F.col("open").isNotNull(), F.col("open")).when(F.col("lacking") > 0, F.lit("required_supporting_incomplete")).otherwise(F.lit("complete"))
    )
    return seen.select(crawl, (reason == "complete").alias("complete"), reason.alias("reason"))


# ---------------------------------------------------------------- crawls in numbers

#: Failures by what they tell of a source, and those that mean a required source was never asked.
BLOCKED = ("http_401", "http_403", "http_429", "robots_disallowed", "challenge_page", "js_challenge", "empty_shell")
MISSING = ("http_404", "http_410", "soft_404")
OMITTED = ("required_source_overflow", "fetch_budget_exhausted", "deadline_exceeded")
#: The longest time that a crawl may take.
LONGEST = "INTERVAL '10' MINUTE"


def attempt_metrics(attempts: DataFrame, crawl: str) -> DataFrame:
    """Counts of fetches for each crawl. attempts: as above, with reusable: whether an unmodified source's earlier reading may be used.

    An attempt with a history counts by its entries, else by itself; entries are read in the row, so a crawl's attempts meet once.
    """
    fields = lambda x: F.struct(x["status"].alias("s"), F.coalesce(x["error_code"], F.lit("")).alias("e"))
    events = F.when(F.size("history") > 0, F.transform("history", fields)).otherwise(F.array(fields(F.struct("status", "error_code"))))
    failed = lambda test: lambda x: (x["s"] == "failed") & test(x["e"])
    count = lambda test: F.coalesce(F.size(F.filter(events, test)), F.lit(0))
    reusable = F.coalesce("reusable", F.lit(False))
    per = {
        "fetch_attempts": F.size(events), "fetch_success": count(lambda x: x["s"] == "fetched"), "fetch_not_modified": F.when(reusable, count(lambda x: x["s"] == "not_modified")).otherwise(0),
        "fetch_blocked": count(failed(lambda e: e.isin(*BLOCKED))), "fetch_missing": count(failed(lambda e: e.isin(*MISSING))), "fetch_failed": count(failed(lambda e: ~e.isin(*BLOCKED, *MISSING))),
        "fetch_attempt_history_overflow": F.coalesce("overflow", F.lit(False)).cast("int"),
    }
    required = F.col("role") == REQUIRED
    code = F.coalesce("error_code", F.lit(""))
    per |= {
        "_required": required.cast("int"), "required_supporting_omitted": (required & code.isin(*OMITTED)).cast("int"), "required_supporting_succeeded": (required & ((F.col("status") == "fetched") | (F.col("status") == "not_modified") & reusable)).cast("int"),
        "required_supporting_failed": (required & (F.col("status") == "failed") & ~code.isin(*OMITTED)).cast("int"),
    }
    sums = attempts.select(crawl, *[c.alias(n) for n, c in per.items()]).groupBy(crawl).agg(*[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in per])
    rate = lambda n, of, none: F.when(F.col(of) == 0, F.lit(none)).otherwise(n / F.col(of))
    sums = sums.withColumn("fetch_success_rate", rate(F.col("fetch_success") + F.col("fetch_not_modified"), "fetch_attempts", 0.0)).withColumn("required_supporting_success_rate", rate(F.col("required_supporting_succeeded"), "_required", 1.0))
    return sums.withColumn("required_supporting_attempted", F.col("_required") - F.col("required_supporting_omitted")).drop("_required")


#: Counts of proposals by kind, and of decisions by action.
PROPOSED = {"additions": "staged_additions", "modifications": "staged_modifications", "migrations": "identity_migrations", "removals": "staged_removals", "conflicts": "proposal_conflicts", "catalog_conflicts": "catalog_identity_conflicts"}
DECIDED = {"approve": "approvals", "edit": "edits", "retire": "retirements"}


def crawl_metrics(crawls: DataFrame, attempts: DataFrame, proposals: DataFrame, decisions: DataFrame, crawl: str, now: str) -> DataFrame:
    """One row of metrics for each crawl: fetches, required sources, proposals, decisions, proofs and time.

    crawls: (crawl, complete, suppressed, retries, replay_passed, proof_passed, started_at, completed_at); proposals: (crawl, kind), kind
    a key of PROPOSED; decisions: (crawl, action, benefit_id, proposal_index). Each table is grouped before it is joined. valid is
    false, and the duration null, where times are missing, backward, before the year 2000, ahead of the clock or too far apart.
    """
    start, end = F.col("started_at"), F.col("completed_at")
    clock = F.lit(now).cast("timestamp_ntz") + F.expr(SKEW)
    valid = F.coalesce((end >= start) & (start >= F.lit("2000-01-01").cast("timestamp_ntz")) & (end <= clock) & (end - start <= F.expr(LONGEST)), F.lit(False))
    kinds = proposals.groupBy(crawl).agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in PROPOSED.items()])
    reject = F.col("action") == "reject"
    targeted = F.coalesce(F.col("benefit_id") != "", F.lit(False)) | F.coalesce(F.col("proposal_index") >= 0, F.lit(False))
    acts = decisions.groupBy(crawl).agg(
        *[F.count_if(F.col("action") == a).alias(n) for a, n in DECIDED.items()], F.count_if(reject & targeted).alias("targeted_rejects"), F.count_if(reject & ~targeted).alias("global_rejects"), F.count_if(F.col("action") == "retry").alias("_retries"))
    rows = crawls.join(attempt_metrics(attempts, crawl), crawl, "left").join(kinds, crawl, "left").join(acts, crawl, "left")
    complete = F.coalesce("complete", F.lit(False))
    none_of = {"fetch_success_rate": 0.0, "required_supporting_success_rate": 1.0}
    whole = [c for c in rows.columns if c not in (*crawls.columns, "_retries")]
    suppressed = F.coalesce("suppressed", F.lit(0))
    return rows.select(
        crawl, *[F.coalesce(c, F.lit(none_of.get(c, 0))).alias(c) for c in whole], F.when(complete, 0).otherwise(1).alias("fetch_incomplete"), suppressed.alias("suppressed_removals"), F.when((suppressed > 0) & ~complete, F.lit("incomplete_crawl")).otherwise(F.lit("")).alias("suppressed_removal_reason_codes"),
        F.coalesce("retries", "_retries", F.lit(0)).alias("retries"), F.coalesce("replay_passed", F.lit(False)).alias("deterministic_replay_passed"), F.coalesce("proof_passed", F.lit(False)).alias("side_effect_proof_passed"), valid.alias("valid"), start.alias("processing_started_at"), end.alias("processing_completed_at"),
        F.when(valid, F.timestamp_diff("MILLISECOND", start, end)).alias("processing_duration_ms"))
