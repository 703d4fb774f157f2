"""Exact top-k inner-product search with a pivot-distance index.

Inner products become distances: with M the largest squared norm, each candidate x gets one more
coordinate, sqrt(M - |x|^2), and each query a zero; then |q - x|^2 = |q|^2 + M - 2 q.x, so the
nearest are the best. Candidates are keyed by their nearest pivot and the distance to it, sorted by
that key and cut into blocks: annuli around a pivot. A query first searches the annuli nearest to
it, which gives the k-th score so far and with it a radius. By the triangle inequality an annulus
[low, high] around p holds nothing better if max(low - d(q, p), d(q, p) - high) exceeds the radius;
all annuli that may hold something are searched next, and there the search stops.

Pivots come from a bounded sample; every vector is indexed. Blocks grow with the table, so that
their directory stays below ``Config.directory`` rows and may be broadcast. Blocks are equal runs of
a range partitioning whose last key numbers the rows, so a vector, or a whole row, that a third of all
rows repeat is split over many of them.

Defined cases: rows with a null id, and vectors that are null or hold null or non-finite components,
take no part. Every other row is a candidate, repeated rows too, each with a rank of its own; rows that
repeat a query are one query. A shorter vector counts as filled up with zeros. Candidates with a query's
own id are left out. Fewer candidates than k: all of them. Components beyond 2**62 count as 2**62, and
scores beyond the range of a long as its bounds, where they tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table


@dataclass(frozen=True)
class Config:
    k: int = 10
    pivots: int = 32
    sample: int = 4096
    block: int = 1024
    directory: int = 50_000
    queries: int = 256
    #: Annuli that a query searches before it has a radius.
    first: int = 2


def quantised(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component, x as double; null for a vector that takes no part."""
    sound = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long")))


LARGEST = 1 << 62
#: Below every score.
NONE = np.iinfo(np.int64).min


def _matrix(column: pa.Array) -> np.ndarray:
    """Integer vectors as one matrix, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = column.value_lengths().to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy()
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = np.clip(flat, -LARGEST, LARGEST)
    return out


def _widen(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows, held within longs; doubles are exact below 2**53."""
    dim = max(a.shape[1], b.shape[1])
    a, b = _widen(a, dim), _widen(b, dim)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dim < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    small = np.abs(x).max(initial=0) < 1 << 31
    return (b"4" if small else b"8") + x.astype("<i4" if small else "<i8").tobytes()


def _unpack(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if data[:1] == b"4" else "<i8", offset=1).astype(np.int64).reshape(rows, -1)


@dataclass
class Pivots:
    vectors: np.ndarray
    extra: np.ndarray
    largest: float

    @staticmethod
    def choose(sample: np.ndarray, largest: float, n: int) -> Pivots:
        """Farthest-first points of the sample."""
        x = np.column_stack([sample, np.sqrt(np.maximum(largest - (sample.astype(float) ** 2).sum(axis=1), 0))])
        picked = [0] if len(x) else []
        far = ((x - x[:1]) ** 2).sum(axis=1)
        while picked and len(picked) < n and far.max() > 0:
            picked.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
        return Pivots(x[picked, :-1], x[picked, -1], largest)

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """To each pivot; queries have a zero as their last coordinate."""
        dim = max(x.shape[1], self.vectors.shape[1])
        x, p = _widen(x.astype(float), dim), _widen(self.vectors, dim)
        own = (x**2).sum(axis=1)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.largest - own, 0))
        d2 = own[:, None] + (p**2).sum(axis=1)[None] - 2 * x @ p.T + (extra[:, None] - self.extra[None]) ** 2
        return np.sqrt(np.maximum(d2, 0))


def build(vectors: DataFrame, config: Config) -> tuple[DataFrame, Pivots, np.ndarray]:
    """The index of (row, vec_id, v): a stored table of blocks, the pivots and the blocks' directory."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).first()
    drawn = vectors.orderBy(F.xxhash64("vec_id", F.lit("pivots")), "vec_id", "row").limit(config.sample).select("v").toArrow()
    pivots = Pivots.choose(_matrix(drawn.column("v")), float(facts["m"] or 0), config.pivots)
    size = max(config.block, -(-2 * facts["n"] // config.directory))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = pivots.distances(_matrix(b.column(1)), query=False)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near]), *b.columns], names=["pivot", "dist", "vec_id", "v", "row"])

    keyed = vectors.select("vec_id", "v", "row").mapInArrow(key, "pivot int, dist double, vec_id long, v array<long>, row long")
    ordered = keyed.repartitionByRange("pivot", "dist", "row").sortWithinPartitions("pivot", "dist", "row")
    names = ["block", "pivot", "low", "high", "n", "ids", "data"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        made = 0

        def flush(rows: pa.Table, last: bool) -> tuple[list[tuple], pa.Table]:
            nonlocal made
            pivot = rows.column("pivot").to_numpy()
            out, at = [], 0
            while at < len(pivot):
                end = min(at + size, int(np.searchsorted(pivot, pivot[at], side="right")))
                if end == len(pivot) and end - at < size and not last:
                    break
                part = rows.slice(at, end - at)
                d = part.column("dist").to_numpy()
                out.append((base + made, int(pivot[at]), float(d[0]), float(d[-1]), end - at, part.column("vec_id").to_numpy().astype("<i8").tobytes(), _pack(_matrix(part.column("v")))))
                made += 1
                at = end
            return out, rows.slice(at)

        schema = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
        to_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 2 * size:
                out, rest = flush(pa.Table.from_batches(held).combine_chunks(), last=False)
                held = rest.to_batches()
                if out:
                    yield to_batch(out)
        if held and sum(x.num_rows for x in held):
            yield to_batch(flush(pa.Table.from_batches(held).combine_chunks(), last=True)[0])

    index = materialize(ordered.mapInArrow(cut, "block long, pivot int, low double, high double, n int, ids binary, data binary"), "pivot-index")
    # At most 2 * directory / 2 + pivots + partitions rows: blocks grow with the table.
    directory = index.select(*names[:4]).toArrow().to_pandas().to_numpy(dtype=float, na_value=0) if facts["n"] else np.zeros((0, 4))
    return index, pivots, directory


def _bounds(pivots: Pivots, directory: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Lower bound of each query's distance to all that a block holds."""
    d = pivots.distances(q, query=True)[:, directory[:, 1].astype(int)]
    return np.maximum(0, np.maximum(directory[:, 2] - d, d - directory[:, 3]))


def _slack(squares: np.ndarray | float) -> np.ndarray | float:
    """What rounding may take from a distance of vectors with such squared norms."""
    return 1e-6 * np.sqrt(squares) + 1e-6


ROUTED = pa.schema([("block", pa.int64()), ("n_queries", pa.int32()), ("query_ids", pa.binary()), ("least", pa.binary()), ("queries", pa.binary())])
def _route(queries: DataFrame, pivots: Pivots, directory: np.ndarray, config: Config, first: bool) -> DataFrame:
    """Rows (block, its queries): the nearest annuli of each query, or all others within its radius."""
    ids = queries.sparkSession.sparkContext.broadcast((pivots, directory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, directory = ids.value
        numbers = index_numbers(directory)
        for whole in batches:
            for at in range(0, whole.num_rows, config.queries):
                b = whole.slice(at, config.queries)
                q, own, least = _matrix(b.column(1)), b.column(0).to_numpy(), b.column(2).to_numpy()
                bound = _bounds(pivots, directory, q)
                near = np.zeros(bound.shape, bool)
                np.put_along_axis(near, np.argsort(bound, axis=1, kind="stable")[:, : config.first], True, axis=1)
                if first:
                    want = near
                else:
                    squares = (q.astype(float) ** 2).sum(axis=1) + pivots.largest
                    bare = (least == NONE) | (np.abs(least.astype(float)) >= 2.0**62)  # no k-th score yet, or one at a bound
                    radius = np.sqrt(np.maximum(squares - 2 * np.where(bare, -np.inf, least.astype(float)), 0))
                    want = ~near & (bound <= (radius * (1 + 1e-9) + _slack(squares))[:, None])
                out = []
                for j in np.flatnonzero(want.any(axis=0)):
                    rows = want[:, j]
                    out.append((int(numbers[j]), int(rows.sum()), own[rows].astype("<i8").tobytes(), least[rows].astype("<i8").tobytes(), _pack(q[rows])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ROUTED, strict=True)], schema=ROUTED)

    return queries.select("vec_id", "v", "least").mapInArrow(run, "block long, n_queries int, query_ids binary, least binary, queries binary")


def index_numbers(directory: np.ndarray) -> np.ndarray:
    """Block numbers; they stay below 2**53."""
    return directory[:, 0].astype(np.int64)


def _search(routed: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Each block's best k for its queries, of those that reach the query's least score."""
    met = routed.join(index.select("block", "n", "ids", "data"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q, x = _unpack(r["queries"], r["n_queries"]), _unpack(r["data"], r["n"])
                own, ids, least = (np.frombuffer(r[c], "<i8") for c in ("query_ids", "ids", "least"))
                s = _dot(q, x)
                ok = (ids[None] != own[:, None]) & (s >= least[:, None])
                # The k-th best of each row bounds what can matter; ties at it all stay.
                masked = np.where(ok, s, NONE)
                if masked.shape[1] > k:
                    ok &= masked >= np.partition(masked, masked.shape[1] - k, axis=1)[:, -k][:, None]
                i, j = np.nonzero(ok)
                order = np.lexsort((ids[j], -s[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[place < k], j[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[j]), pa.array(s[i, j])], names=["query_id", "vec_id", "score"])

    return met.mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, config: Config = Config()) -> DataFrame:
    """query_id, rank, vec_id, score for (vec_id, v) with integer vectors."""
    spark = vectors.sparkSession
    sound = vectors.filter("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    rows = materialize(sound.withColumn("row", F.monotonically_increasing_id()), "vectors")  # stored, so numbers stay
    index, pivots, directory = build(rows, config)
    if not len(directory):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = materialize(rows.filter(is_query).select("vec_id", "v").dropDuplicates(), "queries")
    start = queries.withColumn("least", F.lit(NONE))
    near = materialize(_search(_route(start, pivots, directory, config, first=True), index, config.k), "near")
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= config.k)
    kth = top(near).filter(F.col("rank") == config.k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    bounded = queries.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("kth", F.lit(NONE)).alias("least"))
    rest = _search(_route(bounded, pivots, directory, config, first=False), index, config.k)
    return top(near.unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    return search(rows, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0) AS q JOIN v AS c ON c.vec_id <> q.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 10
"""
