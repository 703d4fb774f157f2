"""The property graph that the star schema holds: nodes, role edges and coordinates.

Regions and nations are places, suppliers organisations, customers persons, orders events with a
period, parts other nodes. Coordinates are a fixed expression of the nation's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAT, LON = "n_nationkey * 7 % 120 - 60", "n_nationkey * 29 % 360 - 180"


class Star:
    """Tables and derived frames of one data folder. Frames are lazy: a query reads what it uses."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def places(self) -> DataFrame:
        """id, name, lat, lon of nations."""
        return self.table("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.expr(LAT).cast("double").alias("lat"), F.expr(LON).cast("double").alias("lon"))

    def events(self) -> DataFrame:
        """id, name, start_date, end_date (ISO days), lo, hi (dates), parent (customer), kind."""
        lo = F.to_date("o_orderdate")
        hi = F.date_add(lo, (F.col("o_orderkey") % 60).cast("int"))
        return self.table("orders").select(
            F.concat(F.lit("O"), "o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("name"), lo.cast("string").alias("start_date"), hi.cast("string").alias("end_date"),
            lo.alias("lo"), hi.alias("hi"), F.concat(F.lit("C"), "o_custkey").alias("parent"), F.col("o_orderpriority").alias("kind"),
        )

    def nodes(self) -> DataFrame:
        """id, name, type, kind, lat, lon, start_date, end_date."""
        none = lambda t: F.lit(None).cast(t)
        part = lambda df, type_: df.select("id", "name", F.lit(type_).alias("type"), "kind", *[c if c in df.columns else none(t).alias(c) for c, t in (("lat", "double"), ("lon", "double"), ("start_date", "string"), ("end_date", "string"))])
        key = lambda p, c: F.concat(F.lit(p), c).alias("id")
        frames = [
            part(self.table("region").select(key("R", "r_regionkey"), F.col("r_name").alias("name"), F.lit("region").alias("kind")), "location"),
            part(self.places().withColumn("kind", F.lit("country")), "location"),
            part(self.table("supplier").select(key("S", "s_suppkey"), F.col("s_name").alias("name"), F.lit("company").alias("kind")), "org"),
            part(self.table("customer").select(key("C", "c_custkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind")), "person"),
            part(self.events(), "event"),
            part(self.table("part").select(key("P", "p_partkey"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind")), "other"),
        ]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def edges(self, *types: str) -> DataFrame:
        """Assertions of the given types, all by default; see operators.edges for the columns."""
        days = lambda c: F.to_date(c).cast("string")
        key = lambda p, c: F.concat(F.lit(p), c)
        none = F.lit(None).cast("string")

        def make(df: DataFrame, source, target, type_: str, family: str, ord_, point=none, start=none, end=none) -> DataFrame:
            return df.select(source.alias("source"), target.alias("target"), F.lit(type_).alias("type"), F.lit(family).alias("family"), F.lit(1).cast("long").alias("count"), none.alias("start_date"), none.alias("end_date"), point.alias("point_date"), start.alias("event_start"), end.alias("event_end"), ord_.cast("long").alias("ord"))

        made = {
            "LOCATED_IN": lambda: make(self.table("nation"), key("N", "n_nationkey"), key("R", "n_regionkey"), "LOCATED_IN", "GEOGRAPHY", F.col("n_nationkey")),
            "BASED_AT": lambda: make(self.table("supplier"), key("S", "s_suppkey"), key("N", "s_nationkey"), "BASED_AT", "LOCATION", F.col("s_suppkey")),
            "RESIDES_IN": lambda: make(self.table("customer"), key("C", "c_custkey"), key("N", "c_nationkey"), "RESIDES_IN", "LOCATION", F.col("c_custkey")),
            "PARTICIPATED_IN": lambda: make(self.events(), F.col("parent"), F.col("id"), "PARTICIPATED_IN", "PARTICIPATION", F.substring("id", 2, 20), start=F.col("start_date"), end=F.col("end_date")),
            "SUPPLIED": lambda: make(self.table("lineitem"), key("S", "l_suppkey"), key("O", "l_orderkey"), "SUPPLIED", "PARTICIPATION", F.col("l_orderkey") * 10 + F.col("l_linenumber"), point=days("l_shipdate")),
            "USED_IN": lambda: make(self.table("lineitem"), key("P", "l_partkey"), key("O", "l_orderkey"), "USED_IN", "USAGE", F.col("l_orderkey") * 10 + F.col("l_linenumber")),
        }
        out: DataFrame | None = None
        for t in types or made:
            out = made[t]() if out is None else out.unionByName(made[t]())
        assert out is not None
        return out


#: The same graph for the oracle: common table expressions over the same tables.
PLACE = f"place AS (SELECT 'N' || n_nationkey AS id, n_name AS name, ({LAT})::DOUBLE AS lat, ({LON})::DOUBLE AS lon, n_regionkey FROM nation)"
EVENT = """event AS (SELECT 'O' || o_orderkey AS id, 'Order ' || o_orderkey AS name, o_orderdate::DATE AS lo, o_orderdate::DATE + (o_orderkey % 60)::INT AS hi,
    strftime(o_orderdate, '%Y-%m-%d') AS start_date, strftime(o_orderdate::DATE + (o_orderkey % 60)::INT, '%Y-%m-%d') AS end_date, 'C' || o_custkey AS parent, o_orderpriority AS kind, o_orderkey FROM orders)"""
EDGE = (
    EVENT
    + """, edge AS (
    SELECT 'N' || n_nationkey AS source, 'R' || n_regionkey AS target, 'LOCATED_IN' AS type, 'GEOGRAPHY' AS family, NULL::VARCHAR AS point_date, NULL::VARCHAR AS event_start, NULL::VARCHAR AS event_end, n_nationkey::BIGINT AS ord FROM nation
    UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'BASED_AT', 'LOCATION', NULL, NULL, NULL, s_suppkey FROM supplier
    UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'RESIDES_IN', 'LOCATION', NULL, NULL, NULL, c_custkey FROM customer
    UNION ALL SELECT parent, id, 'PARTICIPATED_IN', 'PARTICIPATION', NULL, start_date, end_date, o_orderkey FROM event
    UNION ALL SELECT 'S' || l_suppkey, 'O' || l_orderkey, 'SUPPLIED', 'PARTICIPATION', strftime(l_shipdate, '%Y-%m-%d'), NULL, NULL, l_orderkey * 10 + l_linenumber FROM lineitem
    UNION ALL SELECT 'P' || l_partkey, 'O' || l_orderkey, 'USED_IN', 'USAGE', NULL, NULL, NULL, l_orderkey * 10 + l_linenumber FROM lineitem
)"""
)
