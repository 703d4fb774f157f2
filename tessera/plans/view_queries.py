"""Queries of composed questions: typed paths, what happened somewhere, entities as a whole, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import composed as C
from tessera.operators import spatial
from tessera.plans.bridge import EDGE, EVENT, PLACE, Star
from tessera.plans.graph_queries import HAVERSINE, NODE, SPAN
from tessera.plans.registry import query

ROLES = [
    ("BASED_AT", "acted_at"), ("RESIDES_IN", "person_place"), ("PARTICIPATED_IN", "event_link"), ("SUPPLIED", "event_link"),
    ("LOCATED_IN", "located_in"), ("PART_OF", "part_of"), ("OCCURRED_AT", "occurred_at"), ("STAYED", "acted_at"),
]
#: EDGE without the events, which NODE holds.
EDGE_ONLY = EDGE.removeprefix(EVENT + ", ")
PERIOD = ("1995-03-01", "1995-06-30")


def key() -> Column:
    """The number of an id."""
    return F.substring("id", 2, 20).cast("long")


#: Where events happened: a seventh of them in a region, the others in a nation.
OCCURRED = "occ AS (SELECT id, CASE WHEN o_orderkey % 7 = 0 THEN 'R' || o_orderkey % 5 ELSE 'N' || o_orderkey % 25 END AS place, 1 + o_orderkey % 3 AS support FROM event)"


def edge(star: Star, rows: DataFrame, type_: str, count=None, start=None) -> DataFrame:
    """Edges (source, target) that the star schema does not hold, with the columns of Star.edges."""
    none = F.lit(None).cast("string")
    dates = [none.alias(c) for c in ("end_date", "point_date", "event_start", "event_end")]
    n = F.lit(1) if count is None else count
    return rows.select("source", "target", F.lit(type_).alias("type"), F.lit(None).cast("string").alias("family"), n.cast("long").alias("count"), (none if start is None else start).alias("start_date"), *dates, F.lit(0).cast("long").alias("ord"))


def occurred(star: Star) -> DataFrame:
    place = F.when(key() % 7 == 0, F.concat(F.lit("R"), key() % 5)).otherwise(F.concat(F.lit("N"), key() % 25))
    rows = star.events().select(F.col("id").alias("source"), place.alias("target"), (1 + key() % 3).alias("n"))
    return edge(star, rows, "OCCURRED_AT", F.col("n"))


def part_of(star: Star) -> DataFrame:
    half = F.floor(F.col("s_suppkey") / 2)
    rows = star.table("supplier").filter(half > 0).select(F.concat(F.lit("S"), "s_suppkey").alias("source"), F.concat(F.lit("S"), half).alias("target"))
    return edge(star, rows, "PART_OF")


def links(star: Star, *edges: DataFrame) -> DataFrame:
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return C.role_links(out, star.spark.createDataFrame([(t, r, False) for t, r in ROLES], "type string, role string, inverse boolean"))


def nodes(star: Star) -> DataFrame:
    """The star's nodes; regions are areas, which events may be stated at."""
    return star.nodes().withColumn("kind", F.when(F.col("kind") == "region", "area").otherwise(F.col("kind")))


PATHS = f"""{EVENT}, {OCCURRED}, up(root, id, hops) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT up.root, s.s_suppkey, hops + 1 FROM up JOIN supplier s ON s.s_suppkey // 2 = up.id WHERE s.s_suppkey // 2 > 0),
    sup AS (SELECT l_suppkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_orderkey, l_shipdate::DATE),
    path AS (SELECT up.root, 'N' || s_nationkey AS loc, 1 AS strength, hops + 1 AS hops FROM up JOIN supplier ON s_suppkey = up.id
        UNION ALL SELECT up.root, o.place, least(CASE WHEN hops > 0 THEN 1 ELSE n END, n, o.support), hops + 2 FROM up JOIN sup ON l_suppkey = up.id JOIN occ o ON o.id = 'O' || l_orderkey),
    best AS (SELECT *, max(strength) OVER (PARTITION BY root, loc) AS most FROM path)"""


def _profiles(star: Star) -> DataFrame:
    all_links = links(star, star.edges("BASED_AT", "SUPPLIED"), part_of(star), occurred(star))
    starts = star.table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"))
    return C.profile_locations(starts, all_links, nodes(star))


@query("profile_locations", f"WITH RECURSIVE {PATHS} SELECT 'S' || root AS root, loc, most::BIGINT AS strength, min(hops) FILTER (strength = most)::INT AS hops, count(*) AS paths FROM best GROUP BY root, loc, most")
def profile_locations(star: Star) -> DataFrame:
    """Every supplier's places: where it and its sub-units are based, and where the events they supplied happened."""
    return _profiles(star).select("root", "loc", "strength", "hops", "paths")


@query(
    "shared_profile_locations",
    f"WITH RECURSIVE {PATHS}, g AS (SELECT root, loc, most, count(*) AS paths FROM best GROUP BY ALL), h AS (SELECT root % 2 AS side, loc, max(most) AS strength, sum(paths) AS paths FROM g GROUP BY ALL)"
    " SELECT a.loc, least(a.strength, b.strength)::BIGINT AS strength, (a.paths + b.paths)::BIGINT AS paths FROM h a JOIN h b ON a.loc = b.loc AND a.side = 0 AND b.side = 1",
)
def shared_profile_locations(star: Star) -> DataFrame:
    rows = _profiles(star)
    odd = F.substring("root", 2, 20).cast("long") % 2
    return C.shared_locations(rows.filter(odd == 0), rows.filter(odd == 1))


HIT = f"q AS (SELECT lat, lon, name, 'R' || n_regionkey AS above FROM place WHERE id = 'N3'), hit AS (SELECT p.id FROM place p, q WHERE {HAVERSINE.format(a='q.', b='p.')} <= 6000)"


@query(
    "what_happened_split",
    f"""WITH {PLACE}, {EVENT}, {OCCURRED}, {HIT}, r AS (SELECT e.*, o.place, n.n_name FROM event e JOIN occ o USING (id) JOIN nation n ON n.n_nationkey = e.o_orderkey % 11 WHERE {SPAN})
    SELECT r.id, 'at' AS part, start_date, end_date, NULL::VARCHAR AS region FROM r WHERE place = 'N3'
    UNION ALL SELECT r.id, 'nearby', start_date, end_date, NULL FROM r, q WHERE place IN (SELECT id FROM hit) AND place <> 'N3' AND n_name = q.name
    UNION ALL SELECT r.id, 'region', start_date, end_date, place FROM r, q WHERE place = q.above""",
)
def what_happened_split(star: Star) -> DataFrame:
    """Around one place in a period: events at it, near it and naming it, or at the area above it."""
    places = star.places()
    asked = places.filter("id = 'N3'").select("lat", "lon").first()
    hits = spatial.near(places, asked["lat"], asked["lon"], 6000.0)
    names = star.table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("text"))
    texts = star.events().select("id", (key() % 11).cast("int").alias("k")).join(names, "k").select("id", "text")
    return C.what_happened(hits, nodes(star), links(star, star.edges("LOCATED_IN"), occurred(star)), *PERIOD, place="N3", texts=texts)


AREA = f"{HAVERSINE.format(a='q.', b='p.')} <= 8000 AND (p.n_regionkey + 1)::BIGINT * 600000000 <= 10 * 3.141592653589793::DOUBLE * 8000 * 8000"


@query(
    "what_happened_in_area",
    f"""WITH {PLACE}, {EVENT}, {OCCURRED}, q AS (SELECT 0.0 AS lat, 0.0 AS lon), hit AS (SELECT p.id FROM place p, q WHERE {AREA})
    SELECT e.id, e.start_date, e.end_date FROM event e JOIN occ o USING (id) WHERE o.place IN (SELECT id FROM hit) AND {SPAN}""",
)
def what_happened_in_area(star: Star) -> DataFrame:
    """Events at the places inside a marked circle, without places so large that they only contain it."""
    size = star.table("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), ((F.col("n_regionkey") + 1).cast("long") * 600_000_000).alias("area_km2"))
    hits = spatial.area_hits(star.places().join(size, "id"), 0.0, 0.0, 8000.0).filter("hit = 'inside'")
    return C.what_happened(hits, nodes(star), links(star, occurred(star)), *PERIOD).select("id", "start_date", "end_date")


@query(
    "entity_view",
    f"""WITH {NODE}, {EDGE_ONLY}, t AS (SELECT source AS id, 'out' AS direction, type, target AS other FROM edge UNION ALL SELECT target, 'in', type, source FROM edge),
    k AS (SELECT id, direction, type, count(DISTINCT other) AS others, count(*) AS support FROM t GROUP BY ALL),
    g AS (SELECT id, string_agg(direction || ' ' || type || ' ' || others || ' ' || support, '; ' ORDER BY direction || ' ' || type || ' ' || others || ' ' || support) AS relations, sum(support)::BIGINT AS support FROM k GROUP BY id)
    SELECT node.id, name, CASE WHEN lat IS NULL THEN 'no_text,no_geometry' ELSE 'no_text' END AS limits, coalesce(relations, '') AS relations, coalesce(support, 0) AS support FROM node LEFT JOIN g USING (id) WHERE type = 'location'""",
)
def entity_view(star: Star) -> DataFrame:
    """All locations as a whole: their gaps and their relations."""
    asked = star.nodes().filter("type = 'location'").select("id")
    return C.entity_view(asked, star.nodes(), star.edges()).select("id", "name", "limits", "relations", "support")


@query(
    "set_summary",
    """WITH r AS (SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 4 = 0 THEN 'direct' ELSE 'O' || s_suppkey % 7 END AS via, 'R' || n_regionkey AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    a AS (SELECT 'via' AS facet, via AS value, count(*) AS n, min(ord) AS f FROM r GROUP BY ALL UNION ALL SELECT 'region', region, count(*), min(ord) FROM r GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, f) AS rn FROM a) SELECT facet, value, n FROM k WHERE rn <= 4""",
)
def set_summary(star: Star) -> DataFrame:
    """A report of the four most frequent ways to a set of places, and regions of it."""
    via = F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("O"), F.col("s_suppkey") % 7))
    rows = star.table("supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("loc"), via.alias("via"), F.col("s_suppkey").alias("ord"))
    regions = star.edges("LOCATED_IN").select(F.col("source").alias("loc"), F.col("target").alias("region"))
    return C.set_summary(rows, regions, 4)


@query("unit_links", "SELECT 'S' || s_suppkey AS unit, 'S' || s_suppkey // 2 AS parent FROM supplier WHERE s_suppkey // 2 > 0")
def unit_links(star: Star) -> DataFrame:
    return C.unit_links(links(star, part_of(star)), star.nodes()).select("unit", "parent")


@query("group_members", "SELECT 'S' || s_suppkey AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 3)")
def group_members(star: Star) -> DataFrame:
    """Members of a country: even suppliers by their relation to it, odd ones, which have none, by their names."""
    name = star.table("nation").filter("n_nationkey = 3").first()["n_name"]
    rows = star.table("supplier").join(star.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    even, id_ = F.col("s_suppkey") % 2 == 0, F.concat(F.lit("S"), "s_suppkey").alias("id")
    orgs = rows.select(id_, F.when(even, F.col("s_name")).otherwise(F.concat("n_name", F.lit(" "), F.col("s_name"))).alias("name"), F.lit("org").alias("type"))
    return C.group_members(orgs, f"country:{name}", rows.filter(even).select(id_, F.col("n_name").alias("country")))


@query(
    "without_broad",
    """WITH s AS (SELECT p_size, bool_or(p_partkey % 10 = 0) AS specific FROM part GROUP BY 1)
    SELECT DISTINCT p_size AS map, 'N' || p_partkey % 25 AS id FROM part JOIN s USING (p_size) WHERE NOT specific UNION ALL SELECT p_size, 'P' || p_partkey FROM part""",
)
def without_broad(star: Star) -> DataFrame:
    p = star.table("part")
    named = p.select(F.col("p_size").alias("map"), F.concat(F.lit("N"), F.col("p_partkey") % 25).alias("id")).distinct()
    placed = F.when(F.col("p_partkey") % 10 == 0, 1.0)
    known = star.places().select("id", F.lit("country").alias("kind"), "lat").unionByName(p.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_brand").alias("kind"), placed.alias("lat")))
    return C.without_broad(named.unionByName(p.select(F.col("p_size").alias("map"), F.concat(F.lit("P"), "p_partkey").alias("id"))), known)


TIMED = "t AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'N' || o_orderkey % 25 END AS place, o_orderkey % 5 = 0 AS undated FROM event)"


@query(
    "timeline_rows",
    f"""WITH {EVENT}, {TIMED} SELECT parent AS root, id AS event, place, CASE WHEN NOT undated THEN start_date END AS lo, CASE WHEN NOT undated THEN end_date END AS hi,
        CASE WHEN undated THEN 'undated' WHEN place IS NULL THEN 'unplaced' ELSE 'stop' END AS state FROM t
    UNION ALL SELECT 'C' || c_custkey, NULL, 'N' || c_nationkey, '1995-01-01', '1995-01-01', 'stop' FROM customer WHERE c_custkey % 2 = 0""",
)
def timeline_rows(star: Star) -> DataFrame:
    """Every customer's events and dated stays: stops, events without a place, events without a date."""
    known = star.nodes().withColumns({c: F.when((F.col("type") == "event") & (key() % 5 == 0), None).otherwise(F.col(c)) for c in ("start_date", "end_date")})
    at = star.events().filter(key() % 3 != 0).select(F.col("id").alias("source"), F.concat(F.lit("N"), key() % 25).alias("target"))
    stays = star.table("customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("source"), F.concat(F.lit("N"), "c_nationkey").alias("target"))
    own = links(star, star.edges("PARTICIPATED_IN"), edge(star, at, "OCCURRED_AT"), edge(star, stays, "STAYED", start=F.lit("1995-01-01")))
    id_ = F.concat(F.lit("C"), "c_custkey")
    return C.timeline_rows(star.table("customer").select(id_.alias("root"), id_.alias("id")), own, known)


@query("layered_set", "SELECT 'P' || p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'hand' WHEN p_size > 25 THEN 'in' ELSE 'out' END AS label FROM part WHERE p_partkey % 11 <> 0")
def layered_set(star: Star) -> DataFrame:
    """Labels of past decisions: rules, then decisions by hand, without those that are never to be used."""
    p, id_ = star.table("part"), F.concat(F.lit("P"), "p_partkey").alias("id")
    rules = p.select(id_, F.when(F.col("p_size") > 25, "in").otherwise("out").alias("label"))
    return C.layered_set([rules, p.filter("p_partkey % 7 = 0").select(id_, F.lit("hand").alias("label"))], p.filter("p_partkey % 11 = 0").select(id_))


@query("best_resolution", "WITH r AS (SELECT l_orderkey AS id, 'S' || l_suppkey AS name, l_returnflag = 'A' AS clear, l_quantity AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'A' DESC, l_quantity DESC, 'S' || l_suppkey) AS rn FROM lineitem) SELECT id, name, clear, score FROM r WHERE rn = 1")
def best_resolution(star: Star) -> DataFrame:
    rows = star.table("lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("S"), "l_suppkey").alias("name"), (F.col("l_returnflag") == "A").alias("clear"), F.col("l_quantity").alias("score"))
    return C.best_resolution(rows)


@query("review_order", "SELECT o_orderkey AS id, o_totalprice AS relevance FROM orders ORDER BY (o_orderpriority <> '1-URGENT')::INT, o_totalprice DESC, o_orderkey LIMIT 40")
def review_order(star: Star) -> DataFrame:
    """A top-k report: what a reviewer sees first."""
    rows = star.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("relevance"), F.when(F.col("o_orderpriority") == "1-URGENT", "review").otherwise("rules").alias("decided_by"))
    return C.review_order(rows, 40).select("id", "relevance")


@query("run_steps", "SELECT event_id, row_number() OVER w AS step, (floor(epoch(ts)) - lag(floor(epoch(ts))) OVER w)::BIGINT AS waited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def run_steps(star: Star) -> DataFrame:
    rows = star.table("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    return C.run_steps(rows).select(F.col("seq").alias("event_id"), F.col("step").cast("long").alias("step"), "waited")


@query("titled_pages", "WITH t AS (SELECT s_suppkey % 40 AS page, min(s_name) AS title FROM supplier GROUP BY 1) SELECT o_orderkey AS ord, o_custkey % 50 AS page, title FROM orders LEFT JOIN t ON t.page = o_custkey % 50")
def titled_pages(star: Star) -> DataFrame:
    titles = star.table("supplier").select((F.col("s_suppkey") % 40).alias("page"), F.col("s_name").alias("title"))
    return C.titled(star.table("orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % 50).alias("page")), titles).select("ord", "page", "title")


@query(
    "model_dates",
    f"""WITH {EVENT}, r AS (SELECT id, o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN start_date END AS s, end_date AS e, CASE WHEN o_orderkey % 11 = 0 THEN '1990-01-01' ELSE start_date END AS ms FROM event)
    SELECT id, CASE WHEN k % 2 = 0 AND NOT (k % 11 = 0 AND s IS NOT NULL AND s <> ms) THEN coalesce(s, ms) ELSE s END AS start_date, e AS end_date, k % 2 = 0 AND k % 11 = 0 AND s IS NOT NULL AND s <> ms AS rejected FROM r""",
)
def model_dates(star: Star) -> DataFrame:
    """Dates of a model fill events that have none; a date that differs from an event's own is rejected."""
    e = star.events().select("id", "start_date", "end_date")
    table = e.filter(key() % 2 == 0).select("id", F.when(key() % 11 == 0, "1990-01-01").otherwise(F.col("start_date")).alias("start_date"), "end_date")
    own = e.withColumn("start_date", F.when(key() % 3 != 0, F.col("start_date")))
    return C.model_dates(own, table, ["start_date", "end_date"]).select("id", "start_date", "end_date", "rejected")
