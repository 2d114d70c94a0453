"""Observations of one offer from several pages, put together where their terms agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TERMS = ("rate", "value", "cap", "threshold", "period")


def clusters(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, url, cluster, strongest) of observations (key, url, strength, the terms).

    In order of strength, then url, an observation joins the first cluster none of whose known terms it contradicts, and
    lends it those that it knows; else it begins one. Observations of equal terms always end in one cluster, so they are put
    together first, and a task sees the distinct terms of a key in the order of their strongest observations: one row for
    each wording of an offer, however many pages repeat it.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    named = rows.withColumn("terms", F.to_json(F.struct(*TERMS)))
    distinct = named.groupBy(*key, "terms").agg(*[F.first(t).alias(t) for t in TERMS], F.min(F.struct((-F.col("strength")).alias("s"), "url")).alias("lead")).select("*", "lead.s", F.col("lead.url").alias("lead_url")).drop("lead")
    schema = ", ".join(f"{k} {fields[k]}" for k in key) + ", terms string, cluster int, lead_url string"

    def one(frame):
        found: list[dict] = []
        place = []
        frame = frame.sort_values(["s", "lead_url"], kind="stable")
        for row in frame[list(TERMS)].itertuples(index=False):
            own = {t: v for t, v in zip(TERMS, row) if v is not None and v == v}
            at = next((i for i, known in enumerate(found) if all(known.get(t, v) == v for t, v in own.items())), len(found))
            if at == len(found):
                found.append({})
            found[at] |= own
            place.append(at)
        out = frame[[*key, "terms", "lead_url"]].copy()
        out["cluster"] = place
        out.loc[out["cluster"].duplicated(), "lead_url"] = None
        return out

    placed = distinct.groupBy(*key).applyInPandas(one, schema)
    strongest = F.coalesce(F.col("url") == F.col("lead_url"), F.lit(False)).alias("strongest")
    return named.join(placed, [*key, "terms"]).select(*key, "url", "cluster", strongest)
