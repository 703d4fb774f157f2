"""Writers: corpus Parquet, CSV, JSON lines, GeoJSON, and a verified round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.release import round_trip_difference


def corpus(df: DataFrame, path: str, order: str = "qid", level: int = 9) -> None:
    """Sorted, zstd-compressed Parquet; Spark's committer publishes it whole or not at all."""
    df.orderBy(order).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)


def csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    """CSV with a header; ``limit`` writes a sample."""
    (df.limit(limit) if limit else df).write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def verified_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write, read back and compare as multisets; what was read is returned."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if not round_trip_difference(df, back).isEmpty():
        raise ValueError(f"{path} does not hold what was written")
    return back


def features(places: DataFrame, properties: list[str]) -> DataFrame:
    """(id, feature): each place as a GeoJSON feature."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return places.filter("lat is not null and lon is not null").select("id", F.to_json(feature).alias("feature"))


def collection(feature_rows: DataFrame, cap: int = 1000) -> DataFrame:
    """One FeatureCollection of at most ``cap`` features, in order of id: what a map can show."""
    top = feature_rows.orderBy("id").limit(cap)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "feature"))), lambda x: x["feature"])
    return top.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(ordered, ","), F.lit("]}")).alias("geojson"))


def content_store(df: DataFrame, column: str) -> DataFrame:
    """Payloads keyed by their content: (sha256, payload), once each."""
    return df.select(F.sha2(column, 256).alias("sha256"), F.col(column).alias("payload")).dropDuplicates(["sha256"])


def unresolved_references(df: DataFrame, store: DataFrame, column: str = "sha256") -> DataFrame:
    return df.join(store.select(column), column, "left_anti")


def ordered_digest(df: DataFrame, order: list[str], column: str, by: list[str]) -> DataFrame:
    """A digest of a column's values in order, per group."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias("_v")))), lambda x: F.coalesce(x["_v"].cast("string"), F.lit("")))
    return df.groupBy(*by).agg(F.sha2(F.array_join(values, "\x1f"), 256).alias("digest"))
