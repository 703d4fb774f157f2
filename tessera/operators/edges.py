"""Property-graph edges: combining assertions, roles, neighbours, relations and their statistics.

An edge frame has source, target, type, family, count, start_date, end_date, point_date, event_start,
event_end (dates of the event that it touches, where there is one), and ord (input order).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.dates import effective, outside_scope, overlaps

KEY = ["source", "target", "type", "start_date", "end_date", "point_date"]


def combine_assertions(edges: DataFrame, order: str = "ord") -> DataFrame:
    """Assertions with equal keys (null counts as a value) are one edge: the first represents it,
    support sums their counts. One shuffle, with partial aggregation before it."""
    return edges.groupBy(*KEY).agg(F.sum("count").alias("support"), F.count(F.lit(1)).alias("assertions"), F.min(order).alias("first_ord"))


def assertions_behind(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """The assertions of given edges: a null-safe join on the key."""
    on = [edges[k].eqNullSafe(rows[k]) for k in KEY]
    return edges.join(rows, on, "left_semi")


def known_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an unknown end, and which one."""
    s, t = nodes.select(F.col("id").alias("source"), F.lit(True).alias("has_source")), nodes.select(F.col("id").alias("target"), F.lit(True).alias("has_target"))
    rows = edges.join(s, "source", "left").join(t, "target", "left")
    return rows.filter("has_source is null or has_target is null").withColumn("missing", F.when(F.col("has_source").isNull(), "source").otherwise("target")).drop("has_source", "has_target")


def redirect(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Ids that were merged into others (old, new), replaced on both ends."""
    out = edges
    for end in ("source", "target"):
        m = merged.select(F.col("old").alias(end), F.col("new").alias("new_id"))
        out = out.join(m, end, "left").withColumn(end, F.coalesce("new_id", end)).drop("new_id")
    return out.select(*edges.columns)


def resolve_endpoint(edges: DataFrame, records: DataFrame, end: str = "source") -> DataFrame:
    """A bare key at one end becomes the typed record (key, id, type) of the type that the edge
    expects (column expected), if there is exactly one; status says resolved, ambiguous or unknown."""
    keyed = edges.withColumn("edge_key", F.monotonically_increasing_id()) if "edge_key" not in edges.columns else edges
    found = keyed.join(records.select(F.col("key").alias(end), F.col("id").alias("record"), F.col("type").alias("record_type")), end, "left")
    fits = (F.col("record_type") == F.col("expected")) | F.col("expected").isNull()
    one = found.groupBy("edge_key").agg(F.count_if(fits).alias("n"), F.max(F.when(fits, F.col("record"))).alias("record"))
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return keyed.join(one, "edge_key").withColumn("status", status).withColumn(end, F.when(F.col("n") == 1, F.col("record")).otherwise(F.col(end))).drop("record", "n")


def fold_views(edges: DataFrame) -> DataFrame:
    """Reverse views (derived, with source_edge_id) go where their base assertion is present."""
    bases = edges.filter(~F.col("derived") & F.col("source_edge_id").isNull()).select(F.col("id").alias("source_edge_id"))
    views = edges.filter("derived and source_edge_id is not null")
    return edges.filter("not derived or source_edge_id is null").unionByName(views.join(bases, "source_edge_id", "left_anti").select(*edges.columns))


def relation_filter(values: Iterable[str] | str | None, type_: str = "type", family: str = "family") -> Column:
    """A value is an exact type, or a family in any case, or, where a type has no family, the type in
    any case. No value: no filter."""
    if values is None:
        return F.lit(True)
    names = [values] if isinstance(values, str) else list(values)
    low = [v.lower() for v in names]
    return F.col(type_).isin(names) | F.coalesce(F.lower(family).isin(low), F.lit(False)) | (F.col(family).isNull() & F.lower(type_).isin(low))


def unknown_relations(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Filter values (value) that name no type and no family."""
    known = edges.select("type", "family").distinct().select(F.explode(F.array("type", F.lower("type"), F.lower("family"))).alias("form")).distinct()
    forms = values.select("value", F.explode(F.array("value", F.lower("value"))).alias("form"))
    return values.join(forms.join(known, "form").select("value").distinct(), "value", "left_anti")


def in_range(low: str | None, high: str | None) -> Column:
    """An edge's own dates if it has any, else those of its event, overlap the range."""
    s, e = effective(F.col("start_date"), F.col("end_date"), F.col("point_date"))
    dated = F.coalesce(s, e).isNotNull()
    return overlaps(F.when(dated, s).otherwise(F.col("event_start")), F.when(dated, e).otherwise(F.col("event_end")), low, high)


def path_edge_ok(low: str | None, high: str | None, timeless: tuple[str, ...]) -> Column:
    """On a path: dated edges must overlap, timeless roles pass, undated ones go by their event."""
    s, e = effective(F.col("start_date"), F.col("end_date"), F.col("point_date"))
    dated = F.coalesce(s, e).isNotNull()
    return F.when(dated, overlaps(s, e, low, high)).when(F.col("type").isin(*timeless), True).otherwise(overlaps(F.col("event_start"), F.col("event_end"), low, high))


def within_scope(edges: DataFrame) -> DataFrame:
    s, e = effective(F.col("start_date"), F.col("end_date"), F.col("point_date"))
    return edges.filter(~outside_scope(s, e))


def find_relations(edges: DataFrame, relations: Iterable[str] | str | None = None, sources: DataFrame | None = None, targets: DataFrame | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """Combined edges by type, ends (frames of id) and dates. Filters reach the scan; the ends are
    semi joins whose strategy is left to the optimiser."""
    rows = edges.filter(relation_filter(relations)).filter(in_range(low, high))
    for end, ids in (("source", sources), ("target", targets)):
        if ids is not None:
            rows = rows.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return combine_assertions(rows)


def neighbours(edges: DataFrame, ids: DataFrame, nodes: DataFrame, direction: str = "both", node_type: str | None = None) -> DataFrame:
    """One hop from given nodes: id, direction, type, neighbour, support."""
    start = ids.select("id")
    # Only edges of the asked nodes are combined.
    near = lambda end: combine_assertions(edges.join(start.withColumnRenamed("id", end), end, "left_semi"))
    out = near("source").select(F.col("source").alias("id"), F.lit("out").alias("direction"), "type", F.col("target").alias("neighbour"), "support")
    into = near("target").select(F.col("target").alias("id"), F.lit("in").alias("direction"), "type", F.col("source").alias("neighbour"), "support")
    rows = {"out": out, "in": into}.get(direction) or out.unionByName(into)
    kinds = nodes.select(F.col("id").alias("neighbour"), F.col("type").alias("neighbour_type"))
    rows = rows.join(kinds, "neighbour")
    return rows.filter(F.col("neighbour_type") == node_type) if node_type else rows


def role_edges(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """Normalise types to roles (type, role, inverse): subject, role, object, support. The role table
    is a constant of a few rows."""
    rows = combine_assertions(edges).join(F.broadcast(roles), "type")
    return rows.select("role", F.when(F.col("inverse"), F.col("target")).otherwise(F.col("source")).alias("subject"), F.when(F.col("inverse"), F.col("source")).otherwise(F.col("target")).alias("object"), "support", "type")


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type", "family").agg(F.count(F.lit(1)).alias("edges"))


def relation_catalog(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogued and observed relations: label, family, number of edges, whether used."""
    seen = edges.groupBy("type").agg(F.count(F.lit(1)).alias("edges"), F.max("family").alias("seen_family"))
    rows = catalog.select(F.col("id").alias("type"), "label", F.col("family").alias("catalog_family")).join(seen, "type", "full_outer")
    return rows.select("type", F.coalesce("label", "type").alias("label"), F.coalesce("catalog_family", "seen_family").alias("family"), F.coalesce("edges", F.lit(0)).alias("edges"), F.col("edges").isNotNull().alias("used"))


def family_summary(catalog_rows: DataFrame, top: int = 3) -> DataFrame:
    """Per family: relations, used ones, edges, and the most frequent relations."""
    ranked = catalog_rows.withColumn("rn", F.row_number().over(W.partitionBy("family").orderBy(F.desc("edges"), "type")))
    best = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= top, F.struct("rn", "type")))), lambda x: x["type"]), ",")
    return ranked.groupBy("family").agg(F.count(F.lit(1)).alias("relations"), F.count_if("used").alias("used"), F.sum("edges").alias("edges"), best.alias("top"))


def graph_schema(nodes: DataFrame) -> DataFrame:
    """Per node type: nodes, placed nodes, dates and bounding box."""
    return nodes.groupBy("type").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count("lat").alias("placed"),
        F.min("start_date").alias("first_date"),
        F.max("end_date").alias("last_date"),
        *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")],
    )


def coverage(edges: DataFrame) -> DataFrame:
    """Data-quality counters in one pass."""
    s, e = effective(F.col("start_date"), F.col("end_date"), F.col("point_date"))
    undated = F.coalesce(s, e).isNull()
    return edges.groupBy("type").agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(undated).alias("undated"),
        F.count_if(undated & F.col("event_start").isNotNull()).alias("dated_by_event"),
        F.count_if(F.col("point_date").isNotNull()).alias("point_dated"),
        F.count_if(F.col("family").isNull()).alias("without_family"),
        F.count_if(F.col("source") == F.col("target")).alias("loops"),
        F.sum("count").alias("support"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Per node: incident combined edges and their support."""
    c = combine_assertions(edges)
    ends = c.select(F.col("source").alias("id"), "support").unionByName(c.select(F.col("target").alias("id"), "support"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("support").alias("support"))


def importance(nodes: DataFrame, edges: DataFrame, pages: DataFrame | None = None, override: str | None = None) -> DataFrame:
    """Support of incident edges plus distinct source pages (id, pages); an attribute may override."""
    rows = nodes.join(degrees(edges).select("id", "support"), "id", "left")
    value = F.coalesce("support", F.lit(0))
    if pages is not None:
        rows = rows.join(pages, "id", "left")
        value = value + F.coalesce("pages", F.lit(0))
    if override:
        value = F.coalesce(F.col(override).cast("long"), value)
    return rows.withColumn("importance", value).drop("support", "pages")


def find_entities(nodes: DataFrame, ranked: DataFrame, type_: str, kind: str | None = None, low: str | None = None, high: str | None = None, name_pattern: str | None = None) -> DataFrame:
    """Entities of a type by kind and dates, most important first. The kind is the attribute where any
    node of the type has one, else the name's pattern decides."""
    own = nodes.filter(F.col("type") == type_)
    if kind is not None:
        has = own.agg(F.max(F.col("kind").isNotNull()).alias("has"))
        by_name = F.col("name").rlike(name_pattern or f"(?i)\\b{kind}\\b")
        own = own.crossJoin(F.broadcast(has)).filter(F.when(F.coalesce("has", F.lit(False)), F.col("kind") == kind).otherwise(by_name)).drop("has")  # one row
    own = own.filter(overlaps(F.col("start_date"), F.col("end_date"), low, high))
    return own.join(ranked.select("id", "importance"), "id")


def merge_entities(records: DataFrame, rank: list[Column]) -> DataFrame:
    """Records with one key merge: the best by rank wins, names unite, types are counted."""
    best = F.max_by(F.struct("id", "name", "type"), F.struct(*rank, F.col("id")))
    return records.groupBy("key").agg(
        best.alias("best"),
        F.array_join(F.array_sort(F.collect_set("name")), "|").alias("aliases"),
        F.count(F.lit(1)).alias("records"),
        F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"),
    ).select("key", F.col("best.id").alias("id"), F.col("best.name").alias("name"), F.col("best.type").alias("type"), "aliases", "records", "types")


def confidence(rows: DataFrame, by: str) -> DataFrame:
    """high: support of 3 and two pages or two providers; medium: support of 2; else low."""
    agg = rows.groupBy(by).agg(F.max("support").alias("support"), F.countDistinct("page").alias("pages"), F.countDistinct("provider").alias("providers"))
    level = F.when((F.col("support") >= 3) & ((F.col("pages") >= 2) | (F.col("providers") >= 2)), "high").when(F.col("support") >= 2, "medium").otherwise("low")
    return agg.withColumn("level", level)


def page(rows: DataFrame, order: list[Column], size: int, number: int = 0) -> DataFrame:
    """One page of an ordered result; a top-k for the first page."""
    return rows.orderBy(*order).offset(size * number).limit(size) if number else rows.orderBy(*order).limit(size)
