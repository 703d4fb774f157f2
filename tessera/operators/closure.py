"""Transitive closures by cycle-safe iteration over joins, to the fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A frame without its lineage where the session has a checkpoint folder, else kept."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() is not None else df.persist()


def closure(parents: DataFrame, start: DataFrame | None = None, depth: int | None = None, down: bool = True) -> DataFrame:
    """(root, id, level) along (child, parent), from the ids of ``start`` or from every node, to the
    fixpoint or to a given depth. Each round extends only what the last one found; what is known already
    stops a cycle."""
    step = parents.select(F.col("parent" if down else "child").alias("from"), F.col("child" if down else "parent").alias("to")).distinct()
    roots = start.select("id") if start is not None else step.select(F.col("from").alias("id"))
    front = roots.distinct().select(F.col("id").alias("root"), "id", F.lit(0).alias("level"))
    found, level = front, 0
    while depth is None or level < depth:
        level += 1
        next_ = front.join(step, front["id"] == step["from"]).select("root", F.col("to").alias("id"), F.lit(level).alias("level")).distinct()
        next_ = cut(next_.join(found.select("root", "id"), ["root", "id"], "left_anti"))
        if next_.isEmpty():
            break
        found, front = found.unionByName(next_), next_
    return found


def nearest(levels: DataFrame, marked: DataFrame) -> DataFrame:
    """The marked ancestors (id, mark) at each root's nearest marked level; mark is null where they
    disagree."""
    hits = levels.join(marked, "id")
    ranked = hits.withColumn("first", F.min("level").over(W.partitionBy("root"))).filter(F.col("level") == F.col("first"))
    one = F.countDistinct("mark") == 1
    return ranked.groupBy("root").agg(F.min("level").alias("level"), F.when(one, F.min("mark")).alias("mark"), F.when(one, F.min("id")).alias("via"))


def chain(parents: DataFrame, preferred: DataFrame, depth: int = 8) -> DataFrame:
    """Each unit's chain of parents, one at every step: preferred ones first, then by name."""
    ranked = parents.join(preferred.select(F.col("id").alias("parent"), F.lit(1).alias("prefer")), "parent", "left")
    best = ranked.withColumn("rn", F.row_number().over(W.partitionBy("child").orderBy(F.desc(F.coalesce("prefer", F.lit(0))), "parent"))).filter("rn = 1").select("child", "parent")
    rows = best.select(F.col("child").alias("id"), F.col("parent").alias("top"), F.array("parent").alias("chain"))
    for _ in range(depth - 1):
        up = best.select(F.col("child").alias("top"), F.col("parent").alias("next"))
        rows = rows.join(up, "top", "left")
        fresh = F.col("next").isNotNull() & ~F.array_contains("chain", F.col("next"))
        rows = rows.select("id", F.when(fresh, F.col("next")).otherwise(F.lit(None)).alias("top"), F.when(fresh, F.array_append("chain", F.col("next"))).otherwise(F.col("chain")).alias("chain"))
    return rows.select("id", F.array_join("chain", ">").alias("chain"))


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """(title, target): the end of each title's chain of redirects (title, target); a title whose chain
    runs into a cycle keeps its own target."""
    levels = closure(redirects.select(F.col("title").alias("child"), F.col("target").alias("parent")), redirects.select(F.col("title").alias("id")), down=False)
    ends = levels.join(redirects.select(F.col("title").alias("id")), "id", "left_anti").groupBy(F.col("root").alias("title")).agg(F.min("id").alias("end"))
    return redirects.select("title", "target").join(ends, "title", "left").select("title", F.coalesce("end", "target").alias("target"))


def layers(steps: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Discovery in layers along steps (from, to, relation): (found, log). ``found`` (id, layer) holds each
    id in the first layer that meets it; a layer is extended by its ``most`` best met ids (those of most
    steps, then the smaller id), all by default. ``log`` (layer, candidates, kept, left) says what a limit left out."""
    found = seeds.select("id").distinct().withColumn("layer", F.lit(0))
    front, logs = found.select("id"), []
    for layer in range(1, depth + 1):
        met = steps.join(front, steps["from"] == front["id"]).groupBy(F.col("to").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        new = cut(met.join(found.select("id"), "id", "left_anti"))
        kept = new if most is None else cut(new.orderBy(F.desc("n"), "id").limit(most))
        counted = new.agg(F.count(F.lit(1)).alias("candidates")).withColumn("layer", F.lit(layer))
        log = counted.join(kept.agg(F.count(F.lit(1)).alias("kept")).withColumn("layer", F.lit(layer)), "layer")
        logs.append(log.select("layer", "candidates", "kept", (F.col("candidates") - F.col("kept")).alias("left")))
        if kept.isEmpty():
            break
        found, front = found.unionByName(kept.select("id", F.lit(layer).alias("layer"))), kept.select("id")
    whole = logs[0]
    for log in logs[1:]:
        whole = whole.unionByName(log)
    return found, whole
