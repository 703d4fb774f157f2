"""Queries over the property graph: relations, closures, places, timelines, sides, names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import geo
from tessera.operators import closure, edges, search, spatial, timeline
from tessera.operators import release as R
from tessera.plans.bridge import EDGE, EVENT, PLACE, Star
from tessera.plans.registry import query


def ids(star: Star, *values: str) -> DataFrame:
    return star.spark.createDataFrame([(v,) for v in values], "id string")


def inside(star: Star, region: str) -> DataFrame:
    """The places inside a region, by closure over LOCATED_IN."""
    parents = star.edges("LOCATED_IN").select(F.col("source").alias("child"), F.col("target").alias("parent"))
    return closure.closure(parents, ids(star, region)).select("id").distinct()


SPAN = "lo <= DATE '1995-06-30' AND hi >= DATE '1995-03-01'"


@query(
    "find_relations",
    f"""WITH RECURSIVE {PLACE}, {EVENT}, inside AS (SELECT 'R2' AS id UNION SELECT p.id FROM place p JOIN inside i ON 'R' || p.n_regionkey = i.id)
    SELECT e.parent AS source, e.id AS target, 'PARTICIPATED_IN' AS type, 1::BIGINT AS support, e.start_date AS event_start
    FROM event e JOIN customer c ON e.parent = 'C' || c.c_custkey WHERE ('N' || c.c_nationkey) IN (SELECT id FROM inside) AND {SPAN}""",
)
def find_relations(star: Star) -> DataFrame:
    """Who, living in a region, took part in events of a period?"""
    people = edges.find_relations(star.edges("RESIDES_IN"), "location", targets=inside(star, "R2")).select(F.col("source").alias("id"))
    events = star.events().select(F.col("id").alias("target"), F.col("start_date").alias("event_start"))
    rows = edges.find_relations(star.edges("PARTICIPATED_IN"), "PARTICIPATED_IN", sources=people, low="1995-03", high="1995-06-30")
    return rows.join(events, "target").select("source", "target", "type", "support", "event_start")


@query(
    "neighbors_both",
    f"""WITH {EDGE}, c AS (SELECT source, target, type, point_date, count(*) AS support FROM edge GROUP BY ALL)
    SELECT target AS id, 'in' AS direction, type, source AS neighbour, support FROM c WHERE target IN ('N3','N7') AND source LIKE 'S%'
    UNION ALL SELECT source, 'out', type, target, support FROM c WHERE source IN ('N3','N7') AND target LIKE 'S%'""",
)
def neighbours(star: Star) -> DataFrame:
    return edges.neighbours(star.edges(), ids(star, "N3", "N7"), star.nodes(), node_type="org").select("id", "direction", "type", "neighbour", "support")


@query("combine_assertions", f"WITH {EDGE} SELECT source, target, type, point_date, count(*) AS support, count(*) AS assertions, min(ord) AS first_ord FROM edge WHERE type = 'SUPPLIED' GROUP BY ALL")
def combine(star: Star) -> DataFrame:
    return edges.combine_assertions(star.edges("SUPPLIED")).select("source", "target", "type", "point_date", "support", "assertions", "first_ord")


@query(
    "assertions_behind",
    f"WITH {EDGE}, c AS (SELECT source, target, type, point_date FROM edge WHERE type = 'USED_IN' GROUP BY ALL HAVING count(*) > 1) SELECT e.source, e.target, e.ord FROM edge e JOIN c ON e.source = c.source AND e.target = c.target AND e.type = c.type AND e.point_date IS NOT DISTINCT FROM c.point_date",
)
def behind(star: Star) -> DataFrame:
    rows = star.edges("USED_IN")
    return edges.assertions_behind(rows, edges.combine_assertions(rows).filter("support > 1").select(*edges.KEY)).select("source", "target", "ord")


CATALOG = [("LOCATED_IN", "located in", "GEOGRAPHY"), ("BASED_AT", "based at", "LOCATION"), ("RESIDES_IN", "resides in", "LOCATION"), ("PARTICIPATED_IN", "took part in", "PARTICIPATION"), ("SUPPLIED", "supplied", "PARTICIPATION"), ("COMMANDED", "commanded", "PARTICIPATION")]
CATALOG_SQL = "catalog(type, label, family) AS (VALUES " + ", ".join(map(str, CATALOG)) + ")"
SEEN_SQL = f"{EDGE}, {CATALOG_SQL}, seen AS (SELECT type, count(*) AS edges, max(family) AS family FROM edge GROUP BY type), cat AS (SELECT coalesce(c.type, s.type) AS type, coalesce(c.label, s.type) AS label, coalesce(c.family, s.family) AS family, coalesce(s.edges, 0) AS edges, s.edges IS NOT NULL AS used FROM catalog c FULL JOIN seen s ON c.type = s.type)"


def _catalog(star: Star) -> DataFrame:
    return edges.relation_catalog(star.edges(), star.spark.createDataFrame(CATALOG, "id string, label string, family string"))


@query("relation_catalog", f"WITH {SEEN_SQL} SELECT type, label, family, edges, used FROM cat")
def relation_catalog(star: Star) -> DataFrame:
    return _catalog(star)


@query(
    "family_summary",
    f"""WITH {SEEN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY edges DESC, type) AS rn FROM cat)
    SELECT family, count(*) AS relations, count(*) FILTER (used) AS used, sum(edges)::BIGINT AS edges, string_agg(type, ',' ORDER BY rn) FILTER (rn <= 3) AS top FROM r GROUP BY family""",
)
def family_summary(star: Star) -> DataFrame:
    return edges.family_summary(_catalog(star))


@query("relation_counts", f"WITH {EDGE} SELECT type, family, count(*) AS edges FROM edge GROUP BY ALL")
def relation_counts(star: Star) -> DataFrame:
    return edges.relation_counts(star.edges())


NODE = f"""{PLACE}, {EVENT}, node AS (
    SELECT 'R' || r_regionkey AS id, r_name AS name, 'location' AS type, 'region' AS kind, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, NULL::VARCHAR AS start_date, NULL::VARCHAR AS end_date FROM region
    UNION ALL SELECT id, name, 'location', 'country', lat, lon, NULL, NULL FROM place
    UNION ALL SELECT 'S' || s_suppkey, s_name, 'org', 'company', NULL, NULL, NULL, NULL FROM supplier
    UNION ALL SELECT 'C' || c_custkey, c_name, 'person', c_mktsegment, NULL, NULL, NULL, NULL FROM customer
    UNION ALL SELECT id, name, 'event', kind, NULL, NULL, start_date, end_date FROM event
    UNION ALL SELECT 'P' || p_partkey, p_name, 'other', p_brand, NULL, NULL, NULL, NULL FROM part)"""


@query("graph_schema", f"WITH {NODE} SELECT type, count(*) AS nodes, count(lat) AS placed, min(start_date) AS first_date, max(end_date) AS last_date, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM node GROUP BY type")
def graph_schema(star: Star) -> DataFrame:
    return edges.graph_schema(star.nodes())


@query(
    "coverage",
    f"""WITH {EDGE} SELECT type, count(*) AS edges, count(*) FILTER (point_date IS NULL) AS undated, count(*) FILTER (point_date IS NULL AND event_start IS NOT NULL) AS dated_by_event,
    count(*) FILTER (point_date IS NOT NULL) AS point_dated, 0::BIGINT AS without_family, 0::BIGINT AS loops, count(*) AS support FROM edge GROUP BY type""",
)
def coverage(star: Star) -> DataFrame:
    return edges.coverage(star.edges())


@query(
    "entity_merge",
    """WITH r AS (SELECT c_custkey % 500 AS key, 'C' || c_custkey AS id, c_name AS name, 'person' AS type, c_acctbal AS bal FROM customer
        UNION ALL SELECT s_suppkey % 500, 'S' || s_suppkey, s_name, 'org', s_acctbal FROM supplier),
    w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY bal DESC, id DESC) AS rn FROM r)
    SELECT key, max(id) FILTER (rn = 1) AS id, max(name) FILTER (rn = 1) AS name, max(type) FILTER (rn = 1) AS type, string_agg(DISTINCT name, '|' ORDER BY name) AS aliases, count(*) AS records, string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM w GROUP BY key""",
)
def entity_merge(star: Star) -> DataFrame:
    c = star.table("customer").select((F.col("c_custkey") % 500).alias("key"), F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("person").alias("type"), F.col("c_acctbal").alias("bal"))
    s = star.table("supplier").select((F.col("s_suppkey") % 500).alias("key"), F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("org").alias("type"), F.col("s_acctbal").alias("bal"))
    return edges.merge_entities(c.unionByName(s), [F.col("bal")])


@query(
    "resolve_endpoints",
    """WITH rec AS (SELECT s_suppkey AS k, 'S' || s_suppkey AS id, 'org' AS type FROM supplier UNION ALL SELECT c_custkey, 'C' || c_custkey, 'person' FROM customer),
    e AS (SELECT o_orderkey, o_custkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'person' WHEN o_orderkey % 3 = 1 THEN 'org' END AS expected FROM orders),
    f AS (SELECT o_orderkey, e.k, count(r.id) FILTER (r.type = expected OR expected IS NULL) AS n, max(r.id) FILTER (r.type = expected OR expected IS NULL) AS id FROM e LEFT JOIN rec r ON r.k = e.k GROUP BY o_orderkey, e.k, expected)
    SELECT o_orderkey AS edge_key, CASE WHEN n = 1 THEN id ELSE k::VARCHAR END AS source, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status FROM f""",
)
def resolve_endpoints(star: Star) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    org = star.table("supplier").select(text("s_suppkey").alias("key"), F.concat(F.lit("S"), "s_suppkey").alias("id"), F.lit("org").alias("type"))
    person = star.table("customer").select(text("c_custkey").alias("key"), F.concat(F.lit("C"), "c_custkey").alias("id"), F.lit("person").alias("type"))
    expected = F.when(F.col("o_orderkey") % 3 == 0, "person").when(F.col("o_orderkey") % 3 == 1, "org")
    rows = star.table("orders").select(F.col("o_orderkey").alias("edge_key"), text("o_custkey").alias("source"), expected.alias("expected"))
    return edges.resolve_endpoint(rows, org.unionByName(person)).select("edge_key", "source", "status")


@query("redirect_edges", "SELECT 'P' || (CASE WHEN l_partkey % 5 = 0 AND l_partkey > 5 THEN l_partkey - 1 ELSE l_partkey END) AS source, count(*) AS n FROM lineitem GROUP BY ALL")
def redirect_edges(star: Star) -> DataFrame:
    merged = star.table("part").filter("p_partkey % 5 = 0 and p_partkey > 5").select(F.concat(F.lit("P"), "p_partkey").alias("old"), F.concat(F.lit("P"), F.col("p_partkey") - 1).alias("new"))
    return edges.redirect(star.edges("USED_IN"), merged).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("dangling_edges", "SELECT 'C' || o_custkey AS source, 'O' || o_orderkey AS target, 'target' AS missing FROM orders WHERE o_orderkey % 10 = 0")
def dangling_edges(star: Star) -> DataFrame:
    nodes = star.nodes().filter("type <> 'event' or cast(substring(id, 2, 20) as bigint) % 10 <> 0")
    return edges.dangling(star.edges("PARTICIPATED_IN"), nodes).select("source", "target", "missing")


@query("fold_derived_views", "SELECT 'e' || o_orderkey AS id FROM orders UNION ALL SELECT 'v' || o_orderkey FROM orders WHERE o_orderkey % 4 = 3")
def fold_derived_views(star: Star) -> DataFrame:
    o = star.table("orders").select("o_orderkey", F.concat(F.lit("e"), "o_orderkey").alias("id"), F.lit(False).alias("derived"), F.lit(None).cast("string").alias("source_edge_id"))
    base = F.when(F.col("o_orderkey") % 4 == 3, F.concat(F.lit("gone"), "o_orderkey")).otherwise(F.concat(F.lit("e"), "o_orderkey"))
    v = star.table("orders").filter("o_orderkey % 2 = 1").select("o_orderkey", F.concat(F.lit("v"), "o_orderkey").alias("id"), F.lit(True).alias("derived"), base.alias("source_edge_id"))
    return edges.fold_views(o.unionByName(v)).select("id")


@query("role_edges", f"WITH {EDGE} SELECT CASE type WHEN 'LOCATED_IN' THEN 'located_in' ELSE 'acted_at' END AS role, CASE type WHEN 'LOCATED_IN' THEN source ELSE target END AS subject, CASE type WHEN 'LOCATED_IN' THEN target ELSE source END AS object, 1::BIGINT AS support FROM edge WHERE type IN ('LOCATED_IN', 'BASED_AT')")
def role_edges(star: Star) -> DataFrame:
    roles = star.spark.createDataFrame([("LOCATED_IN", "located_in", False), ("BASED_AT", "acted_at", True)], "type string, role string, inverse boolean")
    return edges.role_edges(star.edges("LOCATED_IN", "BASED_AT"), roles).select("role", "subject", "object", "support")


@query("unknown_relations", "SELECT 'wd:P9' AS value UNION ALL SELECT 'supplied by'")
def unknown_relations(star: Star) -> DataFrame:
    values = star.spark.createDataFrame([("SUPPLIED",), ("location",), ("wd:P9",), ("supplied by",)], "value string")
    return edges.unknown_relations(values, star.edges("SUPPLIED", "BASED_AT"))


PARTIAL = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END"


def _partial(star: Star) -> DataFrame:
    day = F.to_date("o_orderdate").cast("string")
    part = F.when(F.col("o_orderkey") % 4 == 0, F.substring(day, 1, 4)).when(F.col("o_orderkey") % 4 == 1, F.substring(day, 1, 7)).when(F.col("o_orderkey") % 4 == 2, day)
    return star.table("orders").select("o_orderkey", part.alias("d"))


@query("date_bounds", f"SELECT o_orderkey, d, CASE length(d) WHEN 4 THEN d || '-01-01' WHEN 7 THEN d || '-01' ELSE d END AS lo, CASE length(d) WHEN 4 THEN d || '-12-31' WHEN 7 THEN d || '-31' ELSE d END AS hi FROM (SELECT o_orderkey, {PARTIAL} AS d FROM orders)")
def date_bounds(star: Star) -> DataFrame:
    return _partial(star).select("o_orderkey", "d", D.pad(F.col("d"), end=False).alias("lo"), D.pad(F.col("d"), end=True).alias("hi"))


@query("date_overlap", f"SELECT o_orderkey, d FROM (SELECT o_orderkey, {PARTIAL} AS d FROM orders) WHERE CASE length(d) WHEN 4 THEN d || '-01-01' WHEN 7 THEN d || '-01' ELSE d END <= '1995-07-31' AND CASE length(d) WHEN 4 THEN d || '-12-31' WHEN 7 THEN d || '-31' ELSE d END >= '1995-02-01'")
def date_overlap(star: Star) -> DataFrame:
    return _partial(star).filter(D.overlaps(F.col("d"), F.lit(None), "1995-02", "1995-07"))


@query("scope_window", "SELECT o_orderkey FROM orders WHERE NOT (year(o_orderdate) > 1996 OR year(o_orderdate + to_days((o_orderkey % 60)::INT)) < 1994)")
def scope_window(star: Star) -> DataFrame:
    e = star.events()
    return e.filter(~D.outside_scope(F.col("start_date"), F.col("end_date"), ("1994", "1996"))).select(F.substring("id", 2, 20).cast("long").alias("o_orderkey"))


@query(
    "model_date_range",
    """WITH t AS (SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, (8 + o_orderkey % 4)::INT AS p FROM orders)
    SELECT o_orderkey, p FROM t WHERE (CASE p WHEN 8 THEN y // 10 * 10 ELSE y END) * 10000 + (CASE WHEN p >= 10 THEN m ELSE 1 END) * 100 + (CASE WHEN p >= 11 THEN d ELSE 1 END) <= 19950615
        AND (CASE p WHEN 8 THEN y // 10 * 10 + 9 ELSE y END) * 10000 + (CASE WHEN p >= 10 THEN m ELSE 12 END) * 100 + (CASE WHEN p >= 11 THEN d ELSE 31 END) >= 19950310""",
)
def model_date_range(star: Star) -> DataFrame:
    day = F.to_date("o_orderdate")
    rows = star.table("orders").select("o_orderkey", (8 + F.col("o_orderkey") % 4).cast("int").alias("p"), F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d"))
    low, high = D.bounds(F.col("y"), F.col("m"), F.col("d"), F.col("p"))
    point = lambda y, m, d: F.struct(F.lit(y).alias("y"), F.lit(m).alias("m"), F.lit(d).alias("d"))
    return rows.filter((low <= point(1995, 6, 15)) & (high >= point(1995, 3, 10))).select("o_orderkey", "p")


@query("year_span", "SELECT p_partkey, (p_size * 37) // 10 * 10 AS decade, (p_size * 37) // 10 * 10 + 9 AS decade_end, (p_size * 37 - 1) // 100 * 100 + 1 AS century FROM part")
def year_span(star: Star) -> DataFrame:
    y = F.col("p_size") * 37
    decade, end = D.year_span(y, 10)
    return star.table("part").select("p_partkey", decade.alias("decade"), end.alias("decade_end"), D.year_span(y, 100, 1)[0].alias("century"))


@query("iso_dates", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y') END AS iso FROM orders")
def iso_dates(star: Star) -> DataFrame:
    day = F.to_date("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("+"), F.date_format(day, "yyyy-MM"), F.lit("-00T00:00:00Z"))).otherwise(F.date_format(day, "dd/MM/yyyy"))
    precision = F.when(F.col("o_orderkey") % 3 == 2, "year")
    return star.table("orders").select("o_orderkey", D.iso(raw, precision).alias("iso"))


TREE = "parent(child, parent) AS (SELECT s_suppkey, s_suppkey // 2 FROM supplier WHERE s_suppkey // 2 > 0)"


def _units(star: Star) -> DataFrame:
    half = F.floor(F.col("s_suppkey") / 2)
    return star.table("supplier").filter(half > 0).select(F.col("s_suppkey").alias("child"), half.alias("parent"))


@query("closure_located_in", f"WITH RECURSIVE {TREE}, c(root, id, level) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT c.root, p.child, c.level + 1 FROM c JOIN parent p ON p.parent = c.id) SELECT root, id, level FROM c")
def closure_down(star: Star) -> DataFrame:
    return closure.closure(_units(star), star.table("supplier").select(F.col("s_suppkey").alias("id")))


@query("ancestor_levels", f"WITH RECURSIVE {TREE}, c(root, id, level) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT c.root, p.parent, c.level + 1 FROM c JOIN parent p ON p.child = c.id) SELECT root, id, level FROM c WHERE level > 0")
def ancestors(star: Star) -> DataFrame:
    return closure.closure(_units(star), star.table("supplier").select(F.col("s_suppkey").alias("id")), down=False).filter("level > 0")


@query("unit_chain", f"WITH RECURSIVE {TREE}, c(id, top, chain, n) AS (SELECT child, parent, parent::VARCHAR, 1 FROM parent UNION ALL SELECT c.id, p.parent, c.chain || '>' || p.parent, n + 1 FROM c JOIN parent p ON p.child = c.top WHERE n < 8) SELECT id, max_by(chain, n) AS chain FROM c GROUP BY id")
def unit_chain(star: Star) -> DataFrame:
    return closure.chain(_units(star), star.table("supplier").filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("id")))


HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


@query("near_point", f"WITH {PLACE}, q AS (SELECT 5.0 AS lat, 20.0 AS lon) SELECT place.id, round({HAVERSINE.format(a='q.', b='place.')}, 6) AS distance_km FROM place, q WHERE {HAVERSINE.format(a='q.', b='place.')} <= 6000")
def near_point(star: Star) -> DataFrame:
    return spatial.near(star.places(), 5.0, 20.0, 6000.0).select("id", F.round("distance_km", 6).alias("distance_km"))


@query("near_join", f"WITH {PLACE} SELECT a.id, b.id AS other, round({HAVERSINE.format(a='a.', b='b.')}, 6) AS distance_km FROM place a, place b WHERE {HAVERSINE.format(a='a.', b='b.')} <= 3000")
def near_join(star: Star) -> DataFrame:
    p = star.places()
    return spatial.near_join(p, p, 3000.0).select("id", "other", F.round("distance_km", 6).alias("distance_km"))


@query("bbox_antimeridian", f"WITH {PLACE} SELECT id, lat, lon FROM place WHERE lat BETWEEN -50 AND 50 AND (lon >= 120 OR lon <= -100)")
def bbox(star: Star) -> DataFrame:
    return spatial.in_box(star.places(), 120, -50, -100, 50).select("id", "lat", "lon")


@query("area_hits", f"WITH {PLACE}, q AS (SELECT 0.0 AS lat, 0.0 AS lon) SELECT place.id, CASE WHEN (n_regionkey + 1)::BIGINT * 600000000 > 10 * 3.141592653589793::DOUBLE * 8000 * 8000 THEN 'contains' ELSE 'inside' END AS hit FROM place, q WHERE {HAVERSINE.format(a='q.', b='place.')} <= 8000")
def area_hits(star: Star) -> DataFrame:
    size = star.table("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), ((F.col("n_regionkey") + 1).cast("long") * 600_000_000).alias("area_km2"))
    return spatial.area_hits(star.places().join(size, "id"), 0.0, 0.0, 8000.0).select("id", "hit")


@query(
    "what_happened_at",
    f"""WITH {PLACE}, {EVENT} SELECT p.id AS place, count(*) AS events, count(DISTINCT e.parent) AS actors, min(e.start_date) AS first_date, max(e.end_date) AS last_date
    FROM place p JOIN customer c ON p.id = 'N' || c.c_nationkey JOIN event e ON e.parent = 'C' || c.c_custkey, (SELECT 5.0 AS lat, 20.0 AS lon) q
    WHERE {HAVERSINE.format(a='q.', b='p.')} <= 6000 AND {SPAN} GROUP BY p.id""",
)
def what_happened_at(star: Star) -> DataFrame:
    """Places near a point -> people there -> their events in a period."""
    places = spatial.near(star.places(), 5.0, 20.0, 6000.0).select(F.col("id").alias("place"))
    people = star.edges("RESIDES_IN").select(F.col("source").alias("parent"), F.col("target").alias("place")).join(places, "place")
    events = star.events().filter(D.overlaps(F.col("start_date"), F.col("end_date"), "1995-03-01", "1995-06-30"))
    return events.join(people, "parent").groupBy("place").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("parent").alias("actors"), F.min("start_date").alias("first_date"), F.max("end_date").alias("last_date"))


CONNECTED = """hop AS (SELECT l_suppkey AS actor, c_nationkey AS loc, o_orderkey AS via, count(*) AS strength FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


def _connected(star: Star) -> DataFrame:
    """Paths supplier -> order -> customer -> nation: actor, loc, via, strength (the weakest support)."""
    supplied = edges.combine_assertions(star.edges("SUPPLIED").withColumn("point_date", F.lit(None).cast("string"))).select(F.col("source").alias("actor"), F.col("target").alias("via"), "support")
    took = star.edges("PARTICIPATED_IN").select(F.col("source").alias("person"), F.col("target").alias("via"))
    lives = star.edges("RESIDES_IN").select(F.col("source").alias("person"), F.col("target").alias("loc"))
    return supplied.join(took, "via").join(lives, "person").select("actor", "loc", "via", F.col("support").alias("strength"))


@query("connected_locations", f"WITH {CONNECTED}, r AS (SELECT *, row_number() OVER (PARTITION BY actor, loc ORDER BY strength DESC, 'O' || via) AS rn, count(*) OVER (PARTITION BY actor, loc) AS paths FROM hop) SELECT 'S' || actor AS actor, 'N' || loc AS loc, strength, 'O' || via AS via, paths FROM r WHERE rn = 1")
def connected_locations(star: Star) -> DataFrame:
    # The best path by strength; of equal ones the first by name, found without sorting a group.
    rows = _connected(star).groupBy("actor", "loc", "strength").agg(F.min("via").alias("via"), F.count(F.lit(1)).alias("n"))
    return rows.groupBy("actor", "loc").agg(F.max("strength").alias("strength"), F.max_by("via", "strength").alias("via"), F.sum("n").alias("paths"))


@query("shared_connections", f"WITH {CONNECTED}, g AS (SELECT actor % 2 AS side, loc, max(strength) AS strength, count(*) AS paths FROM hop GROUP BY ALL) SELECT 'N' || a.loc AS loc, least(a.strength, b.strength) AS strength, a.paths + b.paths AS paths FROM g a JOIN g b ON a.loc = b.loc AND a.side = 0 AND b.side = 1")
def shared_connections(star: Star) -> DataFrame:
    key = F.substring("actor", 2, 20).cast("long")
    g = _connected(star).groupBy((key % 2).alias("side"), "loc").agg(F.max("strength").alias("strength"), F.count(F.lit(1)).alias("paths"))
    a, b = g.filter("side = 0").select("loc", F.col("strength").alias("x"), F.col("paths").alias("p")), g.filter("side = 1").select("loc", F.col("strength").alias("y"), F.col("paths").alias("q"))
    return a.join(b, "loc").select("loc", F.least("x", "y").alias("strength"), (F.col("p") + F.col("q")).alias("paths"))


@query("shared_events", "SELECT 'O' || l_orderkey AS event FROM lineitem WHERE l_suppkey % 10 = 1 INTERSECT SELECT 'O' || l_orderkey FROM lineitem WHERE l_suppkey % 10 = 2")
def shared_events(star: Star) -> DataFrame:
    of = lambda d: star.table("lineitem").filter(F.col("l_suppkey") % 10 == d).select(F.concat(F.lit("O"), "l_orderkey").alias("event"))
    return of(1).intersect(of(2))


@query("locations_of", f"WITH {PLACE} SELECT 'S' || s_suppkey AS id, p.id AS loc, 'BASED_AT' AS relations, p.lat, p.lon FROM supplier JOIN place p ON p.id = 'N' || s_nationkey UNION ALL SELECT id, id, 'SELF', lat, lon FROM place")
def locations_of(star: Star) -> DataFrame:
    p = star.places()
    linked = star.edges("BASED_AT").select(F.col("source").alias("id"), F.col("target").alias("loc"), "type").union(star.edges("BASED_AT").filter("source like 'N%'").select("target", "source", "type"))
    near = linked.join(p.select(F.col("id").alias("loc"), "lat", "lon"), "loc").groupBy("id", "loc", "lat", "lon").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("relations"))
    own = p.select("id", F.col("id").alias("loc"), F.lit("SELF").alias("relations"), "lat", "lon")
    return near.select("id", "loc", "relations", "lat", "lon").unionByName(own)


IMPORTANCE = f"{NODE}, e AS (SELECT 'S' || s_suppkey AS a, 'N' || s_nationkey AS b FROM supplier UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders UNION ALL SELECT 'S' || l_suppkey, 'O' || l_orderkey FROM lineitem), d AS (SELECT id, count(*) AS importance FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id)"


def _ranked(star: Star) -> DataFrame:
    return edges.importance(star.nodes().select("id"), star.edges("BASED_AT", "RESIDES_IN", "PARTICIPATED_IN", "SUPPLIED"))


@query("importance", f"WITH {IMPORTANCE} SELECT node.id, coalesce(importance, 0) AS importance FROM node LEFT JOIN d USING (id)")
def importance(star: Star) -> DataFrame:
    return _ranked(star)


@query("find_entities", f"WITH {IMPORTANCE} SELECT node.id, name, coalesce(importance, 0) AS importance FROM node LEFT JOIN d USING (id) WHERE type = 'person' AND kind = 'BUILDING'")
def find_entities(star: Star) -> DataFrame:
    return edges.find_entities(star.nodes(), _ranked(star), "person", kind="BUILDING").select("id", "name", "importance")


@query("overview", f"WITH {EVENT}, r AS (SELECT kind, substr(start_date, 1, 4) AS year FROM event) SELECT coalesce(kind, '*') AS kind, coalesce(year, '*') AS year, count(*) AS n FROM r GROUP BY GROUPING SETS ((kind), (year), ())")
def overview(star: Star) -> DataFrame:
    rows = star.events().select("kind", F.substring("start_date", 1, 4).alias("year"))
    return rows.groupingSets([["kind"], ["year"], []], "kind", "year").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("kind", F.lit("*")).alias("kind"), F.coalesce("year", F.lit("*")).alias("year"), "n")


@query("entity_page", f"WITH {IMPORTANCE} SELECT node.id, coalesce(importance, 0) AS importance FROM node LEFT JOIN d USING (id) ORDER BY importance DESC, id LIMIT 50")
def entity_page(star: Star) -> DataFrame:
    """A top-k report: the 50 most important entities."""
    return edges.page(_ranked(star), [F.desc("importance"), F.col("id")], 50)


@query("confidence", "WITH a AS (SELECT l_suppkey AS id, count(*) AS support, count(DISTINCT l_orderkey % 7) AS pages, count(DISTINCT l_returnflag) AS providers FROM lineitem GROUP BY 1) SELECT id, support, pages, providers, CASE WHEN support >= 3 AND (pages >= 2 OR providers >= 2) THEN 'high' WHEN support >= 2 THEN 'medium' ELSE 'low' END AS level FROM a")
def confidence(star: Star) -> DataFrame:
    rows = star.table("lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_orderkey") % 7).alias("page"), F.col("l_returnflag").alias("provider"))
    total = rows.groupBy("id").agg(F.count(F.lit(1)).alias("support"))
    return edges.confidence(rows.join(total, "id"), "id")


@query(
    "events_during",
    f"""WITH {EVENT} SELECT a.id AS asked, b.id, datediff('day', b.lo, b.hi) + 1 AS days, CASE WHEN datediff('day', b.lo, b.hi) + 1 <= 30 THEN 'concurrent' ELSE 'ongoing' END AS state
    FROM event a JOIN event b ON b.lo <= a.hi AND b.hi >= a.lo AND a.id <> b.id WHERE a.o_orderkey = (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)""",
)
def events_during(star: Star) -> DataFrame:
    """Events during one event: the dearest order."""
    e = star.events()
    one = star.table("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select(F.concat(F.lit("O"), "o_orderkey").alias("id"))
    asked = e.join(one, "id", "left_semi")
    return timeline.overlapping(asked, e).select("asked", "id", F.col("days").cast("long").alias("days"), "state")


LINE = "line AS (SELECT 'C' || o_custkey AS actor, o_orderkey, o_orderstatus AS place, o_orderdate::DATE AS lo, o_orderdate::DATE + (o_orderkey % 60)::INT AS hi FROM orders)"


def _line(star: Star) -> DataFrame:
    lo = F.to_date("o_orderdate")
    return star.table("orders").select(F.concat(F.lit("C"), "o_custkey").alias("actor"), "o_orderkey", F.col("o_orderstatus").alias("place"), lo.alias("lo"), F.date_add(lo, (F.col("o_orderkey") % 60).cast("int")).alias("hi"))


@query("timeline_spans", f"WITH {LINE} SELECT actor, o_orderkey, EXISTS (SELECT 1 FROM line b WHERE b.actor = a.actor AND b.lo BETWEEN a.lo AND a.hi AND b.hi - b.lo < a.hi - a.lo) AS span FROM line a")
def timeline_spans(star: Star) -> DataFrame:
    return timeline.mark_spans(_line(star)).select("actor", "o_orderkey", "span")


@query(
    "timeline_stops",
    f"""WITH {LINE}, n AS (SELECT *, CASE WHEN place IS NOT DISTINCT FROM lag(place) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM line WINDOW w AS (PARTITION BY actor ORDER BY lo, hi, o_orderkey)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY lo, hi, o_orderkey)::BIGINT AS seq FROM n)
    SELECT actor, seq, min(place) AS place, min(lo)::VARCHAR AS lo, max(hi)::VARCHAR AS hi, count(*) AS n_rows, CASE WHEN seq <= 26 THEN chr((64 + seq)::INT) ELSE chr((64 + (seq - 1) // 26)::INT) || chr((65 + (seq - 1) % 26)::INT) END AS label FROM s GROUP BY actor, seq""",
)
def timeline_stops(star: Star) -> DataFrame:
    rows = timeline.stops(_line(star), order=["lo", "hi", "o_orderkey"])
    return rows.select("actor", "seq", "place", F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"), F.col("rows").alias("n_rows"), "label")


@query(
    "event_chain",
    f"""WITH {EVENT}, o AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY start_date, name) AS seq FROM event), one AS (SELECT parent, arg_max(seq, (o_totalprice, o_orderkey)) AS pos FROM o JOIN orders USING (o_orderkey) GROUP BY parent)
    SELECT o.parent, o.id, seq, CASE WHEN seq < pos THEN 'before' WHEN seq > pos THEN 'after' ELSE 'asked' END AS position FROM o JOIN one USING (parent)""",
)
def event_chain(star: Star) -> DataFrame:
    """The events around every customer's dearest order."""
    e = star.events()
    dearest = F.max(F.struct("o_totalprice", "o_orderkey"))["o_orderkey"]
    asked = star.table("orders").groupBy("o_custkey").agg(dearest.alias("key")).select(F.concat(F.lit("C"), "o_custkey").alias("parent"), F.concat(F.lit("O"), "key").alias("id"))
    return timeline.event_chain(e, "parent", asked).select("parent", "id", F.col("seq").cast("long").alias("seq"), "position")


SIDED = "a AS (SELECT 'O' || l_orderkey AS event, l_suppkey AS actor, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE (l_suppkey + l_quantity::BIGINT // 10) % 2 + 1 END AS side FROM lineitem), s AS (SELECT event, actor, CASE WHEN count(DISTINCT side) = 1 THEN min(side) END AS side, count(DISTINCT side) > 1 AS disagree FROM a GROUP BY ALL)"


@query(
    "order_of_battle",
    f"""WITH RECURSIVE {TREE}, {SIDED}, c(root, id, level) AS (SELECT s_suppkey, s_suppkey // 2, 1 FROM supplier WHERE s_suppkey // 2 > 0 UNION ALL SELECT c.root, p.parent, c.level + 1 FROM c JOIN parent p ON p.child = c.id),
    h AS (SELECT s.event, s.actor, u.side, c.level, min(c.level) OVER (PARTITION BY s.event, s.actor) AS first FROM s JOIN c ON c.root = s.actor JOIN s u ON u.event = s.event AND u.actor = c.id AND u.side IS NOT NULL WHERE s.side IS NULL),
    i AS (SELECT event, actor, CASE WHEN count(DISTINCT side) = 1 THEN min(side) END AS above FROM h WHERE level = first GROUP BY ALL)
    SELECT s.event, s.actor, coalesce(s.side, i.above) AS side, s.disagree, CASE WHEN s.side IS NOT NULL THEN 'stated' WHEN i.above IS NOT NULL THEN 'part_of' END AS side_via FROM s LEFT JOIN i ON i.event = s.event AND i.actor = s.actor""",
)
def order_of_battle(star: Star) -> DataFrame:
    side = F.when(F.col("l_suppkey") % 3 != 0, (F.col("l_suppkey") + F.floor(F.col("l_quantity").cast("long") / 10)) % 2 + 1)
    actors = star.table("lineitem").select(F.concat(F.lit("O"), "l_orderkey").alias("event"), F.col("l_suppkey").alias("actor"), side.cast("long").alias("side"))
    above = closure.closure(_units(star), star.table("supplier").select(F.col("s_suppkey").alias("id")), down=False)
    return timeline.sides(actors, above)


@query("operational_coverage", f"WITH {LINE}, n AS (SELECT actor, lo, hi, o_orderkey, CASE WHEN place IS NOT DISTINCT FROM lag(place) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM line WINDOW w AS (PARTITION BY actor ORDER BY lo, hi, o_orderkey)), t AS (SELECT actor, sum(new)::BIGINT AS stops FROM n GROUP BY actor) SELECT actor, stops, stops < 2 AS thin, row_number() OVER (ORDER BY stops DESC, actor) <= 3 AS option FROM t")
def operational_coverage(star: Star) -> DataFrame:
    return timeline.coverage_probe(timeline.stops(_line(star), order=["lo", "hi", "o_orderkey"]))


@query("narrowest_bbox", f"WITH {PLACE}, l AS (SELECT DISTINCT n_regionkey, lon FROM place), g AS (SELECT n_regionkey, lon, lead(lon) OVER (PARTITION BY n_regionkey ORDER BY lon) AS nxt, min(lon) OVER (PARTITION BY n_regionkey) AS least FROM l), r AS (SELECT n_regionkey, coalesce(nxt, least) AS west, lon AS east, row_number() OVER (PARTITION BY n_regionkey ORDER BY coalesce(nxt - lon, least + 360 - lon) DESC, lon) AS rn FROM g) SELECT n_regionkey, west, east FROM r WHERE rn = 1")
def narrowest_bbox(star: Star) -> DataFrame:
    rows = star.table("nation").select("n_regionkey", F.expr("n_nationkey * 29 % 360 - 180").cast("double").alias("lon"))
    return spatial.narrowest_box(rows, ["n_regionkey"])


@query("unwrap_path", f"WITH {PLACE}, j AS (SELECT n_regionkey, id, lon, lon - lag(lon) OVER (PARTITION BY n_regionkey ORDER BY id) AS jump FROM place) SELECT n_regionkey, id, lon + sum(CASE WHEN jump > 180 THEN -360 WHEN jump < -180 THEN 360 ELSE 0 END) OVER (PARTITION BY n_regionkey ORDER BY id) AS unwrapped FROM j")
def unwrap_path(star: Star) -> DataFrame:
    rows = star.table("nation").select("n_regionkey", F.concat(F.lit("N"), "n_nationkey").alias("id"), F.expr("n_nationkey * 29 % 360 - 180").cast("double").alias("lon"))
    return spatial.unwrap(rows, ["n_regionkey"], ["id"]).select("n_regionkey", "id", "unwrapped")


@query("grid_cells", "SELECT n_nationkey, (floor(((n_nationkey * 7 % 120 - 60) + 90) / 10) * 36 + floor(((n_nationkey * 29 % 360 - 180) + 180) / 10) % 36)::BIGINT AS cell FROM nation")
def grid_cells(star: Star) -> DataFrame:
    return star.places().select(F.substring("id", 2, 9).cast("int").alias("n_nationkey"), geo.cell(F.col("lat"), F.col("lon"), 10).alias("cell"))


@query("geojson_features", f"""WITH {PLACE} SELECT id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lon::DECIMAL(9,1) || ',' || lat::DECIMAL(9,1) || ']}},"properties":{{"name":"' || name || '"}}}}' AS feature FROM place""")
def geojson_features(star: Star) -> DataFrame:
    from tessera.sources.sinks import features

    return features(star.places(), ["name"])


@query("search_exact", "SELECT 'the part 7' AS query, p_partkey AS id, 100 AS score FROM part WHERE false UNION ALL SELECT q.query, p_partkey, CASE WHEN lower(p_name) = lower(q.query) THEN 100 ELSE 94 END FROM part, (SELECT p_name AS query FROM part UNION SELECT 'The ' || p_name FROM part) q WHERE lower(p_name) = regexp_replace(lower(q.query), '^the ', '')")
def search_exact(star: Star) -> DataFrame:
    labels = star.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit("name").alias("kind"))
    p = star.table("part")
    queries = p.select(F.col("p_name").alias("query")).union(p.select(F.concat(F.lit("The "), "p_name"))).distinct()
    return search.exact(labels, queries).select("query", "id", "score")


@query("search_fuzzy", "SELECT p_partkey AS id, levenshtein(lower(p_name), 'smal widgett')::INT AS distance FROM part WHERE levenshtein(lower(p_name), 'smal widgett') <= 3 AND lower(p_name) LIKE 's%'")
def search_fuzzy(star: Star) -> DataFrame:
    labels = star.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return search.fuzzy(labels, "Smal widgett").select("id", "distance")


@query("search_ranked")
def search_ranked(star: Star) -> DataFrame:
    """Weighted-ratio search, which SQL cannot state."""
    labels = star.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("name").alias("kind"))
    return search.search(labels, "customer#00000123")


@query("impact_nodes", f"WITH {EVENT}, b AS (SELECT id, start_date || kind AS v FROM event WHERE o_orderkey % 7 <> 0), a AS (SELECT id, start_date || CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE kind END AS v FROM event WHERE o_orderkey % 11 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'lost' WHEN b.id IS NULL THEN 'gained' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.id = b.id WHERE a.v IS DISTINCT FROM b.v")
def impact_nodes(star: Star) -> DataFrame:
    k = F.substring("id", 2, 20).cast("long")
    e = star.events()
    after = e.filter(k % 11 != 0).withColumn("kind", F.when(k % 5 == 0, "X").otherwise(F.col("kind")))
    return R.node_changes(e.filter(k % 7 != 0), after, ["start_date", "kind"])


@query("impact_edges", "WITH b AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE year(l_shipdate) <= 1995 GROUP BY ALL), a AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE year(l_shipdate) > 1995 GROUP BY ALL) SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS lost, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS gained FROM b FULL JOIN a ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def impact_edges(star: Star) -> DataFrame:
    l = star.table("lineitem")
    return R.edge_changes(l.filter(F.year("l_shipdate") <= 1995), l.filter(F.year("l_shipdate") > 1995), ["l_suppkey", "l_returnflag"])
