"""Readers of graphs, tables, logs and quads as DataFrames with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id string, name string, type string, aliases array<string>, geometry string, text string, attributes map<string,string>, sources array<struct<provider:string,record_id:string,url:string,page:string,paragraph:int>>"
EDGE = "id string, source string, target string, type string, relation_family string, count bigint, start_date string, end_date string, point_date string, derived boolean, source_edge_id string, attributes map<string,string>, sources array<struct<provider:string,record_id:string,url:string,page:string,paragraph:int>>"
CATALOG = "id string, label string, family string, direction array<string>, status array<string>, source_predicates array<string>"


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, catalog) of a whole-file graph {metadata, relation_catalog, nodes, edges}. The file
    is exploded once; store the parts as Parquet for later runs. A large-file pointer is refused."""
    head = spark.read.text(path).limit(1).collect()
    if head and head[0][0].startswith("version https://git-lfs"):
        raise ValueError(f"{path} is a pointer to the file, not the file")
    schema = f"relation_catalog array<struct<{_inner(CATALOG)}>>, nodes array<struct<{_inner(NODE)}>>, edges array<struct<{_inner(EDGE)}>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    part = lambda c: whole.select(F.explode(c).alias("r")).select("r.*")
    edges = part("edges").withColumn("count", F.coalesce("count", F.lit(1))).withColumn("derived", F.coalesce("derived", F.lit(False)))
    return part("nodes"), edges, part("relation_catalog")


def _inner(ddl: str) -> str:
    """A DDL list as the fields of a struct type."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString().removeprefix("struct<").removesuffix(">")


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines, plain or gzipped; lines that do not parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def latest_runs(spark: SparkSession, paths: list[str], schema: str, key: str) -> DataFrame:
    """The union of several runs' rows by key; a later path wins."""
    from tessera.operators.release import latest

    parts = [json_lines(spark, p, schema).withColumn("_run", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return latest(out, [key], F.col("_run")).drop("_run")


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def n_quads(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object, graph) of N-Quads lines; comments and broken lines are left out."""
    line = r"^(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\"\S*)\s*(<[^>]*>)?\s*\.\s*$"
    rows = spark.read.text(path).filter(F.col("value").rlike(line))
    strip = lambda c: F.regexp_replace(c, r"^<|>$", "")
    return rows.select(*[strip(F.regexp_extract("value", line, i)).alias(n) for i, n in enumerate(("subject", "predicate", "object", "graph"), 1)])


def same_as(quads: DataFrame) -> DataFrame:
    """(subject, ids): identities stated by owl:sameAs."""
    rows = quads.filter(F.col("predicate") == "http://www.w3.org/2002/07/owl#sameAs")
    return rows.groupBy("subject").agg(F.array_sort(F.collect_set("object")).alias("ids"))


def related(quads: DataFrame, subjects: DataFrame) -> DataFrame:
    """Quads of given subjects: a semi-join instead of a scan by contiguous subject."""
    return quads.join(subjects, "subject", "left_semi")


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """The paragraph table with its schema asserted."""
    df = spark.read.parquet(path)
    need = {"Source": "string", "Index": "bigint", "Text": "string"}
    have = dict(df.dtypes)
    wrong = {k: have.get(k) for k, v in need.items() if have.get(k) != v}
    if wrong:
        raise ValueError(f"columns differ from the schema: {wrong}")
    return df


def trace(spark: SparkSession, path: str) -> DataFrame:
    """A run log; lines that do not parse are left out."""
    return json_lines(spark, path, "run_id string, seq bigint, ts string, event string, name string, args string, status string, outcome string, failure_stage string, latency_ms bigint, result string, warnings array<string>")


def normalise_sources(edges: DataFrame) -> DataFrame:
    """Provenance: a record reference written as a page moves to record_id; entries without page,
    record and address go."""
    moved = F.transform("sources", lambda s: F.struct(s["provider"].alias("provider"), F.coalesce(s["record_id"], F.when(s["page"].rlike("^(Q|P)?[0-9]+$"), s["page"])).alias("record_id"), s["url"].alias("url"), F.when(~s["page"].rlike("^(Q|P)?[0-9]+$"), s["page"]).alias("page"), s["paragraph"].alias("paragraph")))
    return edges.withColumn("sources", F.filter(moved, lambda s: s["page"].isNotNull() | s["record_id"].isNotNull() | s["url"].isNotNull()))


def lift_attributes(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Promote map entries to columns; the map stays."""
    return nodes.select("*", *[F.try_element_at("attributes", F.lit(n)).alias(n) for n in names])


def sections(frames: dict[str, DataFrame]) -> DataFrame:
    """Several frames as one, each row with its section; missing columns are null."""
    out: DataFrame | None = None
    for name, df in frames.items():
        part = df.withColumn("section", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sections")
    return out
