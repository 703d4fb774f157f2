"""Queries of corpus building and graph enrichment, over relations of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import closure, corpus, enrich
from tessera.plans.bridge import Star
from tessera.plans.registry import query

# Orders stand for pages, every third of a person; parts of a first brand for battles, small ones for umbrellas.
# An accepted line is a claim (one of a battle, an unrelated property, a significant event), a returned one a
# category, an open one a link.
TIES = """b AS (SELECT p_partkey, p_size < 10 AS umbrella FROM part WHERE p_brand LIKE '%1'),
t AS (SELECT l_orderkey AS p, p_partkey AS b, bool_or(l_returnflag = 'R' OR (l_returnflag = 'A' AND (l_linenumber % 3 = 0 OR (l_linenumber % 3 = 2 AND l_orderkey % 3 <> 0)))) AS strong, any_value(umbrella) AS umbrella
    FROM lineitem JOIN b ON l_partkey = p_partkey WHERE NOT (l_returnflag = 'A' AND l_linenumber % 3 = 1) GROUP BY ALL),
a AS (SELECT o_orderkey, count(*) FILTER (strong AND NOT umbrella) AS s, count(*) FILTER (b IS NOT NULL AND NOT umbrella) AS specific, count(b) AS n FROM orders LEFT JOIN t ON p = o_orderkey GROUP BY o_orderkey)"""


@query(
    "anchor_ties",
    f"""WITH {TIES}, g AS (SELECT 'O' || o_orderkey AS title, n AS ties, CASE WHEN s > 0 THEN 'strong' WHEN n >= 2 AND specific > 0 THEN 'links' WHEN n = 0 THEN 'none' WHEN specific = 0 THEN 'umbrella only' ELSE 'one battle' END AS grade FROM a)
    SELECT title, CASE WHEN grade IN ('strong', 'links') THEN 'anchored' WHEN grade = 'none' THEN 'none' ELSE 'gray' END AS verdict, grade, ties FROM g""",
)
def anchor_ties(star: Star) -> DataFrame:
    key = lambda prefix, c: F.concat(F.lit(prefix), c)
    lines = star.table("lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", key("B", "l_partkey").alias("battle"))
    of = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("battle")))
    gathered = lines.groupBy("l_orderkey").agg(of("R").alias("categories"), of("N").alias("links"))
    pages = star.table("orders").join(gathered, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        key("O", "o_orderkey").alias("title"), key("Q", "o_orderkey").alias("qid"), F.when(F.col("o_orderkey") % 3 == 0, "Person").alias("tag"),
        F.coalesce("categories", F.array()).alias("categories"), F.coalesce("links", F.array()).alias("links"),
    )
    prop = F.element_at(F.array(F.lit("P607"), F.lit("P31"), F.lit("P793")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    claims = lines.filter("l_returnflag = 'A'").select(key("Q", "l_orderkey").alias("qid"), prop.alias("prop"), F.col("battle").alias("value")).distinct()
    battles = star.table("part").filter("p_brand like '%1'").select(key("B", "p_partkey").alias("battle"), key("B", "p_partkey").alias("qid"), (F.col("p_size") < 10).alias("umbrella"))
    return corpus.anchor_ties(pages, claims, battles, battles.select(F.col("battle").alias("alias"), "battle"))


@query(
    "tag_pages",
    """WITH t AS (SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN 'Ship' END AS box, CASE WHEN p_size < 10 THEN 'Unit' END AS cls, CASE WHEN p_type LIKE '%STEEL%' THEN 'Media' WHEN p_type LIKE '%BRASS%' THEN 'Place' END AS cat FROM part)
    SELECT p_partkey AS title, coalesce(box, cls, cat) AS tag, CASE WHEN box IS NOT NULL THEN 'infobox' WHEN cls IS NOT NULL THEN 'wikidata' ELSE 'category' END AS source FROM t WHERE coalesce(box, cls, cat) IS NOT NULL""",
)
def tag_pages(star: Star) -> DataFrame:
    p = star.table("part")
    pages = p.select(F.col("p_partkey").alias("title"), F.col("p_brand").alias("infobox"), F.array("p_type").alias("categories"))
    rules = star.spark.createDataFrame([("infobox", "1$", "Ship", 0), ("category", "STEEL", "Media", 0), ("category", "BRASS", "Place", 1)], "source string, pattern string, tag string, rank int")
    return corpus.tags(pages, rules, p.filter("p_size < 10").select(F.col("p_partkey").alias("title"), F.lit("Unit").alias("tag"), F.lit(0).alias("rank")))


CLASSIFY = """r AS (SELECT o_orderkey AS id, ['Battle', 'Person', 'Media', NULL][o_orderkey % 4 + 1] AS tag, o_orderkey % 4 = 0 AS is_battle, ['in', 'dated', 'no participants'][o_orderkey % 3 + 1] AS scope, ['in', 'peripheral', 'disagree', 'out'][o_orderkey // 3 % 4 + 1] AS battle_grade,
o_orderkey % 5 = 0 AS participants_known, o_orderkey % 7 = 0 AS broad, ['anchored', 'gray', 'none'][o_orderkey // 2 % 3 + 1] AS anchor, o_orderkey % 11 = 0 AS allied_only FROM orders)"""


@query(
    "classify_pages",
    f"""WITH {CLASSIFY} SELECT id, CASE WHEN tag = 'Media' THEN 'out' WHEN is_battle THEN CASE WHEN scope = 'in' THEN CASE battle_grade WHEN 'disagree' THEN 'gray' WHEN 'out' THEN 'out' ELSE 'in' END WHEN scope = 'dated' OR participants_known THEN 'out' WHEN anchor = 'anchored' THEN 'in' WHEN anchor = 'gray' THEN 'gray' ELSE 'out' END
    WHEN broad OR allied_only OR anchor = 'none' THEN 'out' WHEN anchor = 'gray' OR tag IS NULL THEN 'gray' ELSE 'in' END AS verdict FROM r""",
)
def classify_pages(star: Star) -> DataFrame:
    k = F.col("o_orderkey")
    of = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    rows = star.table("orders").select(
        k.alias("id"), of(["Battle", "Person", "Media", None], k % 4).alias("tag"), (k % 4 == 0).alias("is_battle"), of(["in", "dated", "no participants"], k % 3).alias("scope"), of(["in", "peripheral", "disagree", "out"], F.floor(k / 3) % 4).alias("battle_grade"),
        (k % 5 == 0).alias("participants_known"), (k % 7 == 0).alias("broad"), of(["anchored", "gray", "none"], F.floor(k / 2) % 3).alias("anchor"), (k % 11 == 0).alias("allied_only"),
    )
    return corpus.classify(rows).select("id", "verdict")


@query("article_links", "SELECT doc_id AS id, 'Page 1|' || 'Page ' || (2 + doc_id % 3) AS links FROM documents")
def article_links(star: Star) -> DataFrame:
    text = F.concat(F.lit("[[page_1#top|x]] [[File:a.png]] [[Page "), 2 + F.col("doc_id") % 3, F.lit("]] [[page 1]]"))
    return star.table("documents").select(F.col("doc_id").alias("id"), F.array_join(corpus.article_links(text), "|").alias("links"))


@query("infobox_fields", "SELECT doc_id AS id, '[[A|b]] {{flag|X}}' AS side1, doc_id::VARCHAR AS place FROM documents")
def infobox_fields(star: Star) -> DataFrame:
    text = F.concat(F.lit("intro {{Infobox battle\n| combatant1 = [[A|b]] {{flag|X}}\n| place = "), F.col("doc_id"), F.lit("\n}} text | place = no"))
    fields = corpus.infobox(text)
    return star.table("documents").select(F.col("doc_id").alias("id"), fields["combatant1"].alias("side1"), fields["place"].alias("place"))


STATEMENT = "s AS (SELECT l_orderkey AS id, ['P580', 'P582', 'P585'][l_linenumber % 3 + 1] AS prop, strftime(l_shipdate, '%Y') AS y, strftime(l_shipdate, '%m') AS m, strftime(l_shipdate, '%d') AS d, 9 + l_linenumber % 3 AS p FROM lineitem WHERE l_returnflag <> 'R'), c AS (SELECT id, prop, '+' || y || '-' || CASE WHEN p >= 10 THEN m ELSE '00' END || '-' || CASE WHEN p >= 11 THEN d ELSE '00' END || 'T00:00:00Z' AS t FROM s)"


@query("entity_dates", f"WITH {STATEMENT} SELECT id, min(t) FILTER (prop = 'P580') AS start_date, max(t) FILTER (prop = 'P582') AS end_date, min(t) FILTER (prop = 'P585') AS point_date FROM c GROUP BY id")
def entity_dates(star: Star) -> DataFrame:
    prop = F.element_at(F.array(F.lit("P580"), F.lit("P582"), F.lit("P585")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    time = F.concat(F.lit("+"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    rows = star.table("lineitem").select(F.col("l_orderkey").alias("id"), prop.alias("prop"), time.alias("value"), F.when(F.col("l_returnflag") == "R", "deprecated").otherwise("normal").alias("rank"), F.lit("value").alias("snak"), (9 + F.col("l_linenumber") % 3).alias("precision"))
    return enrich.entity_dates(rows).drop("several")


@query(
    "entity_classes",
    """WITH RECURSIVE up(root, id, level) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT root, id // 2, level + 1 FROM up WHERE id // 2 > 0),
    i AS (SELECT p_partkey AS id, up.id AS up, min(level) AS level FROM part JOIN up ON up.root = p_partkey % 90 + 1 GROUP BY ALL), x AS (SELECT DISTINCT id FROM i WHERE up = 11),
    r(up, class, rank) AS (VALUES (1, 'thing', 3), (2, 'event', 1), (3, 'place', 2), (5, 'person', 0)), h AS (SELECT i.id, class, row_number() OVER (PARTITION BY i.id ORDER BY level, rank, i.up) AS rn FROM i JOIN r ON r.up = i.up WHERE i.id NOT IN (SELECT id FROM x))
    SELECT id, class FROM h WHERE rn = 1""",
)
def entity_classes(star: Star) -> DataFrame:
    half = F.floor(F.col("s_suppkey") / 2)
    parents = star.table("supplier").filter(half > 0).select(F.col("s_suppkey").alias("child"), half.alias("parent"))
    up = closure.closure(parents, star.table("supplier").select(F.col("s_suppkey").alias("id")), down=False)
    roots = star.spark.createDataFrame([(1, "thing", 3), (2, "event", 1), (3, "place", 2), (5, "person", 0)], "id long, class string, rank int")
    return enrich.classes(star.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 90 + 1).alias("value")), up, roots, star.spark.createDataFrame([(11,)], "id long"))


@query("repair_types", "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'ship' ELSE 'unit' END AS type, CASE s_suppkey % 3 WHEN 0 THEN 'unit' END AS type_before FROM supplier")
def repair_types(star: Star) -> DataFrame:
    nodes = star.table("supplier").select(F.col("s_suppkey").alias("id"), F.lit("unit").alias("type"))
    return enrich.repair_types(nodes, nodes.filter("id % 3 <> 2").select("id", F.when(F.col("id") % 3 == 0, "ship").otherwise("unit").alias("class")))


@query("new_entities", "SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS pages FROM lineitem WHERE l_partkey % 4 = 0 GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 30")
def new_entities(star: Star) -> DataFrame:
    links = star.table("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("id"))
    return enrich.new_entities(links, star.table("part").filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id")), 30)


@query("anchor_histogram", "SELECT l_suppkey AS id, lower(l_returnflag || l_linestatus) AS anchor, count(*) AS n FROM lineitem GROUP BY ALL")
def anchor_histogram(star: Star) -> DataFrame:
    links = star.table("lineitem").select(F.col("l_suppkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.col("l_orderkey").alias("ord"))
    return enrich.anchor_histogram(links).select("id", "anchor", "n")


@query("event_sides", "SELECT 'O' || l_orderkey AS event, l_suppkey AS target, l_linestatus AS role, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS side, count(*) AS mentions FROM lineitem GROUP BY ALL")
def event_sides(star: Star) -> DataFrame:
    return enrich.event_sides(star.table("lineitem").select(F.concat(F.lit("O"), "l_orderkey").alias("event"), F.col("l_suppkey").alias("target"), F.col("l_linestatus").alias("role"), F.col("l_returnflag").alias("side")))


@query("crawl_round", "SELECT l_partkey AS title, 2::INT AS depth FROM lineitem WHERE l_linestatus = 'O' AND l_partkey % 3 <> 0 GROUP BY ALL")
def crawl_round(star: Star) -> DataFrame:
    lines = star.table("lineitem")
    frontier = lines.filter("l_linestatus = 'O'").select(F.concat(F.lit("O"), "l_orderkey").alias("title")).distinct().withColumn("depth", F.lit(3))
    edges = lines.filter("l_linestatus = 'O'").select(F.concat(F.lit("O"), "l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    return corpus.crawl_round(frontier, star.table("part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("title"), F.lit(5).alias("depth")), edges)
