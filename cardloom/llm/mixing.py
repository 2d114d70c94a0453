"""Mixing sources to target weights by Poisson replication.

A group's mean repetition rate is its share of the wanted total over its present size; a document's number of copies is a
Poisson variable of that mean, found by inverting the distribution at a number in [0, 1) that a hash of seed and doc_id
gives. The draw depends on nothing but the document, so partitions, retries and re-runs agree. Copies are exploded and
spread over all partitions by a hash key, in whose order they are returned: a global shuffle.

The rates are one row for each weighted source and one for all others together, however many sources there are, so the
broadcast side has at most len(weights) + 1 rows. A source with a third of all rows is a partial sum like any other.

Defined results: a null source belongs to the others; a null text has size 0 (every document counts one more, for its
end); rows with equal doc_id share their draw and key; a null doc_id draws as the text "null"; sources without documents
leave their weight to the rest; columns of docs named like a result column are replaced; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TWO_52 = 4503599627370496.0


def _uniform(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(TWO_52)


def repetition_rates(sized: DataFrame, weights: dict[str, float], rest_weight: float, ratio: float) -> DataFrame:
    """(grp, rate, cdf) for each group with documents. sized: (grp, size); grp null stands for all sources without a weight."""
    weight = F.lit(float(rest_weight))
    for name, w in weights.items():
        weight = F.when(F.col("grp") == name, F.lit(float(w))).otherwise(weight)
    groups = sized.groupBy("grp").agg(F.sum("size").alias("size")).withColumn("w", weight)
    whole = Window.partitionBy(F.lit(1))  # over the few rows of groups
    groups = groups.withColumn("all_size", F.sum("size").over(whole)).withColumn("all_w", F.sum("w").over(whole))
    rate = F.when(F.col("w") > 0, F.lit(float(ratio)) * F.col("all_size") * F.col("w") / F.col("all_w") / F.col("size")).otherwise(F.lit(0.0))
    groups = groups.select("grp", rate.alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int")
    step = F.struct(F.lit(0.0).alias("ln"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))

    def add(acc, k):
        ln = F.when(k == 0, F.lit(0.0)).otherwise(acc["ln"] + F.log(F.greatest(k, F.lit(1)).cast("double")))
        total = acc["sum"] + F.exp(-F.col("rate") + k * F.log("rate") - ln)
        return F.struct(ln.alias("ln"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(0), last), step, add)["cdf"])
    return groups.select("grp", "rate", cdf.alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float], rest_weight: float, ratio: float = 1.0, seed: int = 1, partitions: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs, each row repeated by its draw, with n_copies, copy (from 1) and mix_key, in mix_key order.
    weights: target share of each named source, in characters; ratio: wanted characters over present ones."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    grp = F.when(F.col(source_col).isin(*weights), F.col(source_col)) if weights else F.lit(None).cast("string")
    size = F.coalesce(F.length(text_col), F.lit(0)).cast("long") + 1
    rates = repetition_rates(docs.select(grp.alias("grp"), size.alias("size")), weights, rest_weight, ratio)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), grp.alias("grp"), ident.alias("ident"))
    rows = rows.join(F.broadcast(rates), rows["grp"].eqNullSafe(rates["grp"])).select("row", "ident", "cdf")
    u = _uniform(F.concat(F.lit(f"{seed}:"), F.col("ident")))
    drawn = rows.withColumn("u", u).withColumn("n", F.size(F.filter("cdf", lambda c: c <= F.col("u")))).where("n > 0")
    copies = drawn.select("row", "ident", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}"), "ident", F.col("copy").cast("string")).cast("binary")))
    # the key is uniform, so its leading digits name the partition without sampling
    part = F.floor(_prefix("mix_key") * n).cast("int")
    spread = keyed.repartitionById(n, part).sortWithinPartitions("mix_key")
    return spread.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_copies", "copy", "mix_key")], F.col("n").alias("n_copies"), "copy", "mix_key")


def _prefix(key: str) -> Column:
    return F.conv(F.substring(key, 1, 7), 16, 10).cast("long") / F.lit(268435456.0)
