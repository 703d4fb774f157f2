"""Graph enrichment from statements: dates, classes, new entities, aliases, type repair, probes.

Statements are long: (id, prop, value, rank, snak, precision); times are texts like +1944-01-00T00:00:00Z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Properties of start, end and point dates, of birth and death.
DATES = {"start_date": "P580", "end_date": "P582", "point_date": "P585"}
LIFE = {"birth_date": "P569", "death_date": "P570"}


def usable(statements: DataFrame) -> DataFrame:
    """Statements with a value whose rank is not deprecated."""
    return statements.filter("rank <> 'deprecated' and snak = 'value' and value is not null")


def cut_to_precision(time: Column, precision: Column) -> Column:
    """A time text with month and day zeroed as its precision says; null below a year (9)."""
    year, month, day = (F.regexp_extract(time, r"^([+-]\d+)-(\d{2})-(\d{2})T", i) for i in (1, 2, 3))
    tail = F.lit("T00:00:00Z")
    out = F.when(precision == 9, F.concat(year, F.lit("-00-00"), tail)).when(precision == 10, F.concat(year, F.lit("-"), month, F.lit("-00"), tail)).otherwise(F.concat(year, F.lit("-"), month, F.lit("-"), day, tail))
    return F.when((precision >= 9) & (year != ""), out)


def time_key(time: Column) -> Column:
    part = lambda i: F.regexp_extract(time, r"^([+-]\d+)-(\d{2})-(\d{2})", i).cast("int")
    return F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d"))


def entity_dates(statements: DataFrame) -> DataFrame:
    """(id, start_date, end_date, point_date, several): the earliest start and point, the latest end."""
    rows = usable(statements).filter(F.col("prop").isin(*DATES.values())).withColumn("t", cut_to_precision(F.col("value"), F.col("precision"))).filter("t is not null")
    key = time_key(F.col("t"))
    pick = lambda f, p: f(F.when(F.col("prop") == p, F.col("t")), F.when(F.col("prop") == p, key))
    many = F.array_compact(F.array(*[F.when(F.countDistinct(F.when(F.col("prop") == p, F.col("t"))) > 1, n) for n, p in DATES.items()]))
    return rows.groupBy("id").agg(*[pick(F.max_by if n == "end_date" else F.min_by, p).alias(n) for n, p in DATES.items()], F.array_join(many, ",").alias("several"))


def life_dates(statements: DataFrame) -> DataFrame:
    """(id, birth_date, death_date): a preferred value first, then the earliest."""
    rows = usable(statements).filter(F.col("prop").isin(*LIFE.values())).withColumn("t", cut_to_precision(F.col("value"), F.col("precision"))).filter("t is not null")
    key = F.struct((F.col("rank") != "preferred").alias("later"), time_key(F.col("t")).alias("k"))
    return rows.groupBy("id").agg(*[F.min_by(F.when(F.col("prop") == p, F.col("t")), F.when(F.col("prop") == p, key)).alias(n) for n, p in LIFE.items()])


def classes(instances: DataFrame, ancestors: DataFrame, roots: DataFrame, excluded: DataFrame) -> DataFrame:
    """(id, class): of items (id, value) through their classes' ancestors (root, id, level), the class of
    the nearest root (id, class, rank), ties by rank; items under an excluded root have none."""
    up = instances.join(ancestors.select(F.col("root").alias("value"), F.col("id").alias("up"), "level"), "value").groupBy("id", "up").agg(F.min("level").alias("level"))
    barred = up.join(excluded.select(F.col("id").alias("up")), "up", "left_semi").select("id").distinct()
    hits = up.join(roots.select(F.col("id").alias("up"), "class", "rank"), "up").join(barred, "id", "left_anti")
    return hits.groupBy("id").agg(F.min_by("class", F.struct("level", "rank", "up")).alias("class"))


def repair_types(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """A class that statements give replaces a node's type where they differ; the old one is kept."""
    rows = nodes.join(found.select("id", F.col("class").alias("_class")), "id", "left")
    wrong = F.col("_class").isNotNull() & (F.col("_class") != F.col("type"))
    return rows.withColumn("type_before", F.when(wrong, F.col("type"))).withColumn("type", F.coalesce("_class", "type")).drop("_class")


def new_entities(links: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """(id, pages): link targets (page, id) outside the graph that enough pages name."""
    counted = links.groupBy("id").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= least)
    return counted.join(nodes.select("id"), "id", "left_anti")


def link_aliases(links: DataFrame, names: DataFrame, least: int = 2) -> DataFrame:
    """(id, alias): link texts that name one entity alone, often enough, and no other's name (id, name)."""
    n = links.groupBy(F.lower("text").alias("alias"), "id").agg(F.count(F.lit(1)).alias("n"))
    one = n.groupBy("alias").agg(F.count(F.lit(1)).alias("ids"), F.max_by("id", "n").alias("id"), F.max("n").alias("n")).filter(F.col("ids") == 1).filter(F.col("n") >= least)
    other = names.select(F.lower("name").alias("alias"), F.col("id").alias("owner"))
    return one.join(other, "alias", "left").filter("owner is null").select("id", "alias", "n")


def anchor_histogram(links: DataFrame) -> DataFrame:
    """(id, anchor, n, spelling): link texts by id, case folded, with their first spelling."""
    return links.groupBy("id", F.lower("text").alias("anchor")).agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "ord").alias("spelling"))


def event_sides(mentions: DataFrame) -> DataFrame:
    """Participant edges of infobox mentions (event, side, target, role): once each, with the side only
    where all mentions of the pair agree."""
    agree = F.when(F.countDistinct("side") == 1, F.min("side"))
    return mentions.groupBy("event", "target", "role").agg(agree.alias("side"), F.count(F.lit(1)).alias("mentions"))


def probes(nodes: DataFrame, by: str, n: int, seed: int) -> DataFrame:
    """A fixed draw of n nodes per class, the same in every run."""
    w = W.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    return nodes.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def same_time(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Years of two events overlap, or one of them is unknown."""
    y = lambda c: F.substring(c, 1, 4)
    known = F.coalesce(a_start, a_end).isNotNull() & F.coalesce(b_start, b_end).isNotNull()
    return ~known | ((y(F.coalesce(a_start, a_end)) <= y(F.coalesce(b_end, b_start))) & (y(F.coalesce(a_end, a_start)) >= y(F.coalesce(b_start, b_end))))
