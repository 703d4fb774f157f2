"""What an answer rests on: nicknames, names without evidence, references, resolutions, result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.geo import haversine
from tessera.operators import search

#: A quoted alias, phrases that introduce a nickname, the length of an evidence sentence,
#: references of an answer.
QUOTED = r'["“”]([^"“”]{2,40})["“”]'
PHRASES = ("nicknamed", "also known as", "known as", "dubbed", "called the", "codenamed", "codename was", "codename")
SENTENCE, REFERENCES = 200, 25


def quoted_aliases(labels: DataFrame) -> DataFrame:
    """(id, label, kind, evidence): the quoted parts of aliases (id, label)."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("label", F.lit(QUOTED), 1)))
    return labels.select("id", found.alias("label"), F.col("label").alias("evidence")).select("id", F.trim("label").alias("label"), F.lit("nickname").alias("kind"), "evidence")


def nicknames(texts: DataFrame) -> DataFrame:
    """(id, label, kind, evidence): what texts (id, name, text) call an entity, in quotes or in up to five
    capitalised words, with the sentence that says so (of a repeated phrase, its first). A label shorter
    than three letters, or equal to the name, is none."""
    opening = r"\b(?:" + "|".join(PHRASES) + r")\s+(?:the\s+)?"
    name = r"(?:[\"“‘'][^\"”’']{2,40}[\"”’']|[A-Z][\w\-.]*(?:\s+[A-Z][\w\-.]*){0,4})"
    phrases = F.array_distinct(F.regexp_extract_all("text", F.lit("(?U)" + opening + name), 0))
    rows = texts.select("id", "name", "text", F.explode(phrases).alias("phrase"))
    said = F.regexp_replace("phrase", "(?U)^" + opening, "")
    rows = rows.withColumn("label", F.regexp_replace(said, "^[ .,;:\"“”‘’']+|[ .,;:\"“”‘’']+$", ""))
    at = F.position(F.col("phrase"), F.col("text"))
    ahead = F.substring_index(F.substring("text", F.lit(1), at - 1), ".", -1)
    after = F.substring("text", at + F.length("phrase"), F.length("text"))
    rest = F.when(F.contains(after, F.lit(".")), F.concat(F.substring_index(after, ".", 1), F.lit("."))).otherwise(after)
    evidence = F.substring(F.trim(F.concat(ahead, "phrase", rest)), 1, SENTENCE)
    rows = rows.select("id", "label", F.lit("nickname").alias("kind"), evidence.alias("evidence"), X.normalize_latin(F.col("label")).alias("_n"), X.normalize_latin(F.col("name")).alias("_name"))
    return rows.filter((F.length("_n") >= 3) & ~F.col("_n").eqNullSafe(F.col("_name"))).drop("_n", "_name")


def ungrounded_names(answers: DataFrame, names: DataFrame, grounded: DataFrame, shown: DataFrame, common: list[str]) -> DataFrame:
    """(run_id, name) of entities that an answer (run_id, answer) names though no id that bears the name
    (name, id) was returned or asked for (grounded: run_id, id) and no tool's text (shown: run_id, text)
    holds it. Names of ``common`` words alone are no entities."""
    texts = answers.select(F.col("run_id").alias("id"), F.col("answer").alias("text"))
    found = search.names_in_text(texts, names).select(F.col("id").alias("run_id"), "name")
    found = found.filter(~F.forall(F.split("name", " "), lambda w: w.isin(*common)))
    backed = found.join(names.select("name", "id"), "name").join(grounded.select("run_id", "id"), ["run_id", "id"], "left_semi").select("run_id", "name")
    printed = search.names_in_text(shown.select(F.col("run_id").alias("id"), "text"), names).select(F.col("id").alias("run_id"), "name")
    return found.join(backed.unionByName(printed).distinct(), ["run_id", "name"], "left_anti").select("run_id", "name")


def source_references(evidence: DataFrame, answer: DataFrame, context: DataFrame, own: DataFrame, most: int = REFERENCES) -> DataFrame:
    """(run_id, rank, provider, record_id, page): references behind an answer, each once. Those of relations
    (evidence: run_id, source, target, ord and the reference) at an answer's id come first, then those at an
    id of the context (both run_id, id), then the answer's own sources (own: id, ord and the reference)."""
    ref = ["provider", "record_id", "page"]
    ends = evidence.select("*", F.explode(F.array_distinct(F.array("source", "target"))).alias("id")).select("run_id", "id", "ord", *ref)
    parts = [
        ends.join(answer.select("run_id", "id").distinct(), ["run_id", "id"], "left_semi").withColumn("part", F.lit(1)),
        ends.join(context.select("run_id", "id").distinct(), ["run_id", "id"], "left_semi").withColumn("part", F.lit(2)),
        answer.select("run_id", "id").distinct().join(own.select("id", "ord", *ref), "id").withColumn("part", F.lit(3)),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    once = rows.groupBy("run_id", *ref).agg(F.min(F.struct("part", "ord")).alias("first"))
    place = F.row_number().over(W.partitionBy("run_id").orderBy("first", *ref))
    return once.withColumn("rank", place).filter(F.col("rank") <= most).select("run_id", "rank", *ref)


def expanded_sets(handles: DataFrame, registry: DataFrame, shown: DataFrame) -> DataFrame:
    """(run_id, handle, reason) of result sets that answers name (run_id, handle), each once. The reason is
    null where the set counts: it is registered (handle) and a tool of the run showed it (run_id, handle)."""
    rows = handles.select("run_id", "handle").distinct()
    known = registry.select("handle").distinct().withColumn("_known", F.lit(True))
    seen = shown.select("run_id", "handle").distinct().withColumn("_seen", F.lit(True))
    rows = rows.join(known, "handle", "left").join(seen, ["run_id", "handle"], "left")
    reason = F.when(F.col("_known").isNull(), "unknown").when(F.col("_seen").isNull(), "not_in_tool_output")
    return rows.select("run_id", "handle", reason.alias("reason"))


def text_battles(items: DataFrame, events: DataFrame) -> DataFrame:
    """(item, id): the one event (id, name, low, high in years) that bears an item's name (item, name, low,
    high) and whose years, where both have some, overlap. An item that two events fit has none."""
    form = lambda df: df.withColumn("_n", X.normalize_latin(F.col("name"))).drop("name")
    e = form(events).select(F.col("id"), F.col("low").alias("_low"), F.col("high").alias("_high"), "_n")
    free = F.col("low").isNull() | F.col("_low").isNull()
    met = form(items).join(e, "_n").filter(free | ((F.col("_high") >= F.col("low")) & (F.col("high") >= F.col("_low"))))
    return met.groupBy("item").agg(F.min("id").alias("id"), F.max("id").alias("_other")).filter("id = _other").drop("_other")


def event_region(places: DataFrame, inside: DataFrame, points: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """(id, how): events in a region: at one of its places (event places: id, place; region: place), else
    with a place or a point of their own (points: id, lat, lon) within a distance."""
    at = places.join(inside.select("place").distinct(), "place", "left_semi").select("id", F.lit(0).alias("_how"))
    close = points.filter(haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= km).select("id")
    through = places.join(close.select(F.col("id").alias("place")), "place", "left_semi").select("id", F.lit(1).alias("_how"))
    own = close.join(places.select("id").distinct(), "id", "left_semi").select("id", F.lit(1).alias("_how"))
    rows = at.unionByName(through).unionByName(own).groupBy("id").agg(F.min("_how").alias("_how"))
    return rows.select("id", F.when(F.col("_how") == 0, "place").otherwise("distance").alias("how"))


def actor_kind(type_: Column, kind: Column) -> Column:
    """person, country, ship or unit."""
    return F.when(type_ == "person", "person").when(kind.isin("country", "ship"), kind).otherwise("unit")


def discovery_recall(sample: DataFrame, found: DataFrame) -> DataFrame:
    """One row (relevant, discovered, included): how much of a relevant sample (item) a run (item, in_scope) found."""
    rows = sample.select("item").join(found.select("item", "in_scope", F.lit(1).alias("_f")), "item", "left")
    some = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    return rows.agg(F.count(F.lit(1)).alias("relevant"), some(F.col("_f"))("discovered"), some(F.col("in_scope"))("included"))
