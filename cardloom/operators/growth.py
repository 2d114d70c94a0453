"""The nine ratios of a waitlist's funnel, each with its counts and what follows from it.

People: a row each (user_id, source, started_at, completed_at, qualified, cohort, invited_at, activated_at, support_minutes, issue, severe_open,
interviewed). A sample is a week of starts, or a cohort of invitations. Each activated person matures on day 14 after an
activation of their own, whatever their cohort does, and retention looks at the person's own days 8 to 14.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: From which ratio a metric goes on, from which it is watched, and what must be bad for a stop: so many samples in a
#: row at the end, or so many people.
BANDS = {
    "application_completion": (0.55, 0.35, 2, 0), "qualified_lead": (0.45, 0.25, 0, 25), "invite_activation": (0.60, 0.40, 2, 0), "week2_retention": (0.40, 0.25, 2, 0), "second_decision": (0.35, 0.20, 2, 0),
}
#: How far a source may be below all, and from how many submissions on; minutes of support; shares of issues; of interviews.
SOURCE_BELOW, SOURCE_LEAST, SUPPORT, ISSUES, INTERVIEWS = 0.15, 20, (30, 60), (0.10, 0.20), (0.10, 0.20, 0.40)
MATURE, ACTIVE = 14, (8, 14)


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' DAY")


def matured(people: DataFrame, sessions: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """Activated people (user_id, cohort, active, decided) who have matured: active in their own days 8 to 14, a second decision within 14 days.

    sessions: (user_id, at, meaningful); decisions: (user_id, at). Both are grouped to a row a person after a join on the person alone.
    """
    clock = F.lit(now).cast("timestamp_ntz")
    own = people.where(F.col("activated_at") + _days(MATURE) <= clock).select("user_id", "cohort", "activated_at")
    day = F.datediff(F.to_date("at"), F.to_date("activated_at"))
    active = sessions.where("meaningful").join(own, "user_id").where(day.between(*ACTIVE)).select("user_id").distinct().withColumn("active", F.lit(True))
    second = decisions.join(own, "user_id").where((F.col("at") >= F.col("activated_at")) & (F.col("at") <= F.col("activated_at") + _days(MATURE))).groupBy("user_id").agg((F.count("*") >= 2).alias("decided"))
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return own.join(active, "user_id", "left").join(second, "user_id", "left").select("user_id", "cohort", yes("active"), yes("decided"))


def _ratio(n: str = "numerator", of: str = "denominator") -> Column:
    return F.when(F.col(of) > 0, F.col(n) / F.col(of))


def banded(samples: DataFrame, metric: str) -> DataFrame:
    """(metric, scope, numerator, denominator, ratio, state) over samples (sample, numerator, denominator).

    Below the lower band a metric stops only if its last samples, as many as it takes, were all below it (a run, cut by the last
    good one), or if enough people stand behind it; else it is watched. Without a denominator the state is no_data.
    """
    go, watch, run, least = BANDS[metric]
    own = F.struct("sample", (F.col("numerator") < watch * F.col("denominator")).alias("bad"))
    whole = samples.agg(F.coalesce(F.sum("numerator"), F.lit(0)).alias("numerator"), F.coalesce(F.sum("denominator"), F.lit(0)).alias("denominator"), F.array_sort(F.collect_list(F.when(F.col("denominator") > 0, own))).alias("_s"))  # a sample is a week or a cohort
    out = whole.withColumn("run", F.aggregate("_s", F.lit(0), lambda n, x: F.when(x["bad"], n + 1).otherwise(0))).withColumn("ratio", _ratio())
    stop = (F.col("run") >= run) if run else (F.col("denominator") >= least)
    state = F.when(F.col("ratio").isNull(), F.lit("no_data")).when(F.col("ratio") >= go, F.lit("continue")).when((F.col("ratio") < watch) & stop, F.lit("stop")).otherwise(F.lit("watch"))
    return out.select(F.lit(metric).alias("metric"), F.lit("all").alias("scope"), F.col("numerator").cast("double").alias("numerator"), "denominator", "ratio", state.alias("state"))


def by_source(people: DataFrame) -> DataFrame:
    """The same row for each source: its share of qualified applications against that of all."""
    done = people.where(F.col("completed_at").isNotNull())
    counts = done.groupBy("source").agg(F.count_if("qualified").cast("double").alias("numerator"), F.count("*").alias("denominator"))
    every = Window.partitionBy(F.lit(1))  # sources are few
    rows = counts.withColumn("overall", F.sum("numerator").over(every) / F.sum("denominator").over(every)).withColumn("ratio", _ratio())
    far = (F.col("overall") - F.col("ratio") >= SOURCE_BELOW) & (F.col("denominator") >= SOURCE_LEAST)
    state = F.when(F.col("ratio") >= F.col("overall"), F.lit("continue")).when(far, F.lit("stop")).otherwise(F.lit("watch"))
    return rows.select(F.lit("source_qualified").alias("metric"), F.coalesce("source", F.lit("unknown")).alias("scope"), "numerator", "denominator", "ratio", state.alias("state"))


def scorecard(people: DataFrame, sessions: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """(metric, scope, numerator, denominator, ratio, state) of all nine metrics; source_qualified has a row a source."""
    week, cohort = F.date_trunc("week", "started_at").cast("string").alias("sample"), F.col("cohort").cast("string").alias("sample")
    done, on = F.col("completed_at").isNotNull(), F.col("activated_at").isNotNull()
    count = lambda rows, by, n, of: rows.groupBy(by).agg(F.count_if(n).alias("numerator"), F.count_if(of).alias("denominator"))
    mature = matured(people, sessions, decisions, now)
    samples = {
        "application_completion": count(people.where("started_at IS NOT NULL"), week, done, F.lit(True)), "qualified_lead": count(people.where("started_at IS NOT NULL"), week, done & F.col("qualified"), done), "invite_activation": count(people.where("invited_at IS NOT NULL"), cohort, on, F.lit(True)),
        "week2_retention": count(mature, cohort, F.col("active"), F.lit(True)), "second_decision": count(mature, cohort, F.col("decided"), F.lit(True)),
    }
    out = by_source(people)
    for metric, own in samples.items():
        out = out.unionByName(banded(own, metric))
    sums = people.where(on).agg(F.count("*").alias("n"), F.coalesce(F.sum("support_minutes"), F.lit(0)).cast("double").alias("minutes"), F.count_if("issue").cast("double").alias("issues"), F.coalesce(F.max("severe_open"), F.lit(False)).alias("severe"), F.count_if("interviewed").cast("double").alias("talks"))
    per = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    load, trust, talk = per("minutes"), per("issues"), per("talks")
    states = {
        "support_load": ("minutes", load, F.when(load <= SUPPORT[0], F.lit("continue")).when(load <= SUPPORT[1], F.lit("watch")).otherwise(F.lit("stop"))),
        "trust_issue": ("issues", trust, F.when(F.col("severe") | (trust > ISSUES[1]), F.lit("stop")).when(trust >= ISSUES[0], F.lit("watch")).otherwise(F.lit("continue"))),
        "interview_coverage": ("talks", talk, F.when(talk < INTERVIEWS[0], F.lit("stop")).when(talk.between(INTERVIEWS[1], INTERVIEWS[2]), F.lit("continue")).otherwise(F.lit("watch"))),
    }
    rows = [F.struct(F.lit(m).alias("metric"), F.lit("all").alias("scope"), F.col(c).alias("numerator"), F.col("n").alias("denominator"), r.alias("ratio"), F.when(r.isNull(), F.lit("no_data")).otherwise(s).alias("state")) for m, (c, r, s) in states.items()]
    return out.unionByName(sums.select(F.inline(F.array(*rows))))
