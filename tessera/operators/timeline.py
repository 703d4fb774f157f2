"""Events in time: spans and stops of an actor, concurrent events, chains, sides of a battle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.dates import days, pad
from tessera.functions.text import label


def mark_spans(rows: DataFrame, by: str = "actor", may_span: Column | None = None) -> DataFrame:
    """Add span: the row (lo, hi as dates) holds the start of a strictly shorter row of its actor. An actor's
    distinct starting days, each with its least length, are gathered as one array: it grows with the days
    that the data span, not with the rows."""
    start = F.datediff("lo", F.lit("1900-01-01").cast("date"))
    rows = rows.withColumn("_s", start).withColumn("_d", F.datediff("hi", "lo"))
    per = rows.groupBy(by, "_s").agg(F.min("_d").alias("m")).groupBy(by).agg(F.collect_list(F.struct("_s", "m")).alias("_all"))
    inside = F.exists("_all", lambda x: (x["_s"] >= F.col("_s")) & (x["_s"] <= F.col("_s") + F.col("_d")) & (x["m"] < F.col("_d")))
    out = rows.join(per, by).withColumn("span", inside if may_span is None else inside & may_span)
    return out.drop("_s", "_d", "_all")


def stops(rows: DataFrame, by: str = "actor", order: list[str] | None = None) -> DataFrame:
    """Consecutive rows at the same place (place, lo, hi) merge into stops: gaps and islands."""
    w = W.partitionBy(by).orderBy(*(order or ["lo", "hi", "place"]))
    moved = rows.withColumn("_new", F.when(F.col("place").eqNullSafe(F.lag("place").over(w)), 0).otherwise(1))
    numbered = moved.withColumn("seq", F.sum("_new").over(w))
    merged = numbered.groupBy(by, "seq").agg(F.first("place").alias("place"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("rows"))
    return merged.withColumn("label", label(F.col("seq") - 1))


def event_chain(events: DataFrame, parent: str, asked: DataFrame) -> DataFrame:
    """Dated siblings of asked events in order, each before, asked or after. ``asked`` has parent and
    id; ``events`` parent, id, name, start_date."""
    w = W.partitionBy(parent).orderBy(pad(F.col("start_date"), end=False), "name")
    ordered = events.filter("start_date is not null").join(asked.select(parent), parent, "left_semi").withColumn("seq", F.row_number().over(w))
    at = ordered.join(asked.select(parent, "id"), [parent, "id"]).select(parent, F.col("seq").alias("at"))
    position = F.when(F.col("at").isNull(), None).when(F.col("seq") < F.col("at"), "before").when(F.col("seq") > F.col("at"), "after").otherwise("asked")
    return ordered.join(at, parent, "left").withColumn("position", position).drop("at")


def overlapping(asked: DataFrame, events: DataFrame, short: int = 30, max_bucket_days: int = 32) -> DataFrame:
    """Events (id, lo, hi as dates) that overlap asked events, without the asked ones themselves. A
    range join: both sides are dealt out over buckets of days, so rows meet on an equi key, and a
    pair counts in the first bucket that both touch."""
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1900-01-01").cast("date")) / max_bucket_days)
    spread = lambda df: df.withColumn("_first", bucket("lo")).withColumn("_b", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    a = spread(asked.select(F.col("id").alias("asked"), "lo", "hi")).select("asked", F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.col("_first").alias("af"), "_b")
    b = spread(events.select("id", "lo", "hi"))
    met = a.join(b, "_b").filter((F.col("lo") <= F.col("ahi")) & (F.col("hi") >= F.col("alo")) & (F.col("_b") == F.greatest("af", "_first")) & (F.col("id") != F.col("asked")))
    n = days(F.col("lo"), F.col("hi"))
    return met.select("asked", "id", "lo", "hi", n.alias("days"), F.when(n <= short, "concurrent").otherwise("ongoing").alias("state"))


def sides(actors: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """Order of battle from (event, actor, side): a side counts where the actor's assertions agree.
    An actor without one takes the side of its nearest sided ancestor (root, id, level) in the same
    event, if that level is of one side."""
    stated = actors.groupBy("event", "actor").agg(F.when(F.countDistinct("side") == 1, F.min("side")).alias("side"), (F.countDistinct("side") > 1).alias("disagree"))
    if ancestors is None:
        return stated.withColumn("side_via", F.when(F.col("side").isNotNull(), "stated"))
    sided = stated.filter("side is not null").select("event", F.col("actor").alias("id"), F.col("side").alias("above"))
    open_ = stated.filter("side is null").join(ancestors.filter("level > 0"), F.col("actor") == F.col("root")).select("event", "actor", "id", "level")
    hits = open_.join(sided, ["event", "id"]).withColumn("_first", F.min("level").over(W.partitionBy("event", "actor"))).filter("level = _first")
    inferred = hits.groupBy("event", "actor").agg(F.when(F.countDistinct("above") == 1, F.min("above")).alias("above"))
    out = stated.join(inferred, ["event", "actor"], "left")
    via = F.when(F.col("side").isNotNull(), "stated").when(F.col("above").isNotNull(), "part_of")
    return out.select("event", "actor", F.coalesce("side", "above").alias("side"), "disagree", via.alias("side_via"))


def side_names(rows: DataFrame, top: int = 4) -> DataFrame:
    """(event, side, name, weight) -> the heaviest names of each side."""
    total = rows.groupBy("event", "side", "name").agg(F.sum("weight").alias("weight"))
    w = W.partitionBy("event", "side").orderBy(F.desc("weight"), "name")
    return total.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top)


def coverage_probe(stop_rows: DataFrame, by: str = "actor", least: int = 2, options: int = 3) -> DataFrame:
    """Actors with their number of dated stops, whether that is too thin for a path, and whether they
    are among the best ``options``, which are found as a top-k and met again by a join."""
    n = stop_rows.groupBy(by).agg(F.count(F.lit(1)).alias("stops"))
    best = n.orderBy(F.desc("stops"), by).limit(options).select(F.col(by).alias("_best"))
    met = n.join(F.broadcast(best), F.col(by).eqNullSafe(F.col("_best")), "left") if options else n.withColumn("_best", F.lit(None))  # a row for each option
    return met.select(by, "stops", (F.col("stops") < least).alias("thin"), F.col("_best").isNotNull().alias("option"))
