"""Relation alignment and release: mapping, identity, keys, differences, dictionaries, round trips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import choose_one, stable_id


def map_relations(assertions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Predicates become relations of one vocabulary; unseen ones stay themselves, unresolved. A mapping
    of inverse direction swaps the ends. The mapping is the vocabulary: a constant table."""
    m = mapping.select("predicate", F.col("relation").alias("_relation"), F.col("family").alias("_family"), F.col("direction").alias("_direction"))
    rows = assertions.join(F.broadcast(m), "predicate", "left")
    swap = F.coalesce(F.col("_direction") == "inverse", F.lit(False))
    out = rows.withColumn("_s", F.when(swap, F.col("object")).otherwise(F.col("subject"))).withColumn("_o", F.when(swap, F.col("subject")).otherwise(F.col("object")))
    out = out.withColumn("subject", F.col("_s")).withColumn("object", F.col("_o")).withColumn("relation", F.coalesce("_relation", "predicate")).withColumn("family", F.coalesce("_family", F.lit("UNRESOLVED")))
    return out.withColumn("observation_id", stable_id(F.col("subject").cast("string"), F.col("relation"), F.col("object").cast("string"), F.col("record").cast("string"))).drop("_s", "_o", "_relation", "_family", "_direction")


def quality_gate(assertions: DataFrame) -> DataFrame:
    """Counters per relation; a release needs zero of the last three."""
    return assertions.groupBy("relation").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("observation_id").alias("ids"),
        F.count_if(F.col("family") == "UNRESOLVED").alias("unresolved"),
        F.count_if(F.col("subject").isNull() | F.col("object").isNull()).alias("without_end"),
        F.count_if(F.col("subject") == F.col("object")).alias("loops"),
    )


def unique_resolution(candidates: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """(uri, id): addresses with exactly one identity; ambiguous ones are left out."""
    rows = candidates if rejects is None else candidates.join(rejects, ["uri", "id"], "left_anti")
    return rows.groupBy("uri").agg(F.collect_set("id").alias("ids")).filter(F.size("ids") == 1).select("uri", F.col("ids")[0].alias("id"))


def span_dates(subjects: DataFrame, begins: DataFrame, ends: DataFrame) -> DataFrame:
    """(subject, begin, end) through a time span: each end counts if it is the only one."""
    rows = subjects.join(begins, "span", "left").join(ends, "span", "left")
    return rows.groupBy("subject").agg(choose_one(F.collect_set("begin")).alias("begin"), choose_one(F.collect_set("end")).alias("end"))


def orphans(child: DataFrame, parent: DataFrame, key: dict[str, str]) -> DataFrame:
    """Rows whose foreign key is set and names no row; must be empty."""
    p = parent.select(*[F.col(v).alias(f"_{k}") for k, v in key.items()]).distinct()
    set_ = [F.col(k).isNotNull() for k in key]
    rows = child.filter(set_[0] if len(set_) == 1 else set_[0] & set_[1])
    return rows.join(p, [rows[k] == p[f"_{k}"] for k in key], "left_anti")


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def asymmetries(pairs: DataFrame) -> DataFrame:
    """Co-occurrence rows (a, b, n, strength) whose reverse is missing or of another count."""
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("n_back"))
    return pairs.join(back, ["a", "b"], "left").filter(F.col("n_back").isNull() | (F.col("n") != F.col("n_back")))


def cooccurrences(memberships: DataFrame) -> DataFrame:
    """(a, b, n, strength): members that share groups (group, member), both directions; strength is n
    over a's groups."""
    m = memberships.select("group", "member").distinct()
    pairs = m.withColumnRenamed("member", "a").join(m.withColumnRenamed("member", "b"), "group").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    own = m.groupBy(F.col("member").alias("a")).agg(F.count(F.lit(1)).alias("groups"))
    return pairs.join(own, "a").withColumn("strength", F.col("n") / F.col("groups")).drop("groups")


def shared_groups(memberships: DataFrame, least: int, width: int = 4096) -> DataFrame:
    """(a, b, n): members a < b that share at least ``least`` groups (group, member); nulls share nothing.

    Pairs are counted where they meet and never shuffled: members are dealt into blocks of about ``width``
    by hash, and a task counts the pairs of two blocks from the groups that both have members in. So what
    is shuffled grows with the memberships times the blocks, however large a group is."""
    m = memberships.select("group", "member").filter("group is not null and member is not null").distinct()
    blocks = max(1, -(-m.select("member").distinct().count() // width))
    block = F.pmod(F.xxhash64("member"), F.lit(blocks)).cast("int")
    order = W.partitionBy("block").orderBy("member")
    at = m.select("member").distinct().withColumn("block", block).withColumn("at", (F.row_number().over(order) - 1).cast("int"))
    held = m.join(at, "member").groupBy("block", "group").agg(F.collect_list(F.col("at").cast("short")).alias("in"))
    named = at.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "member")))["member"].alias("names"))
    of = lambda df, by, c, x: df.select(*by, F.col("block").alias(x), F.col(c).alias(f"{c}_{x}"))
    met = of(held, ["group"], "in", "i").join(of(held, ["group"], "in", "j"), "group").filter("i <= j").drop("group")
    firsts = of(named, [], "names", "i").withColumn("j", F.explode(F.sequence("i", F.lit(blocks - 1))))
    heads = firsts.join(of(named, [], "names", "j"), "j")  # a row for each two blocks
    rows = met.unionByName(heads, allowMissingColumns=True).select("i", "j", "names_i", "names_j", "in_i", "in_j")
    dealt = rows.repartition("i", "j").sortWithinPartitions("i", "j", F.col("names_i").isNull())  # names come first
    kind = m.schema["member"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: _Tile | None = None
        for b in batches:
            i, j = b.column(0).to_numpy(), b.column(1).to_numpy()
            start = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))) if len(i) else []
            for low, high in zip(start, [*start[1:], len(i)], strict=True):
                part = b.slice(low, high - low)
                if part.column(2)[0].is_valid:
                    if tile is not None:
                        yield from tile.pairs(least)
                    tile = _Tile(part.column(2)[0].values, part.column(3)[0].values, i[low] == j[low])
                    part = part.slice(1)
                assert tile is not None
                tile.add(part.column(4), part.column(5))
        if tile is not None:
            yield from tile.pairs(least)

    found = dealt.mapInArrow(run, f"a {kind}, b {kind}, n long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n")


class _Tile:
    """How many groups each member of one block shares with each of another. Pairs of thin groups are
    listed until they are many; those of thick groups are a product of 0/1 matrices."""

    def __init__(self, x: pa.Array, y: pa.Array, same: bool):
        self.x, self.y, self.same = x, y, same
        self.cells = len(x) * len(y)
        self.count: np.ndarray | None = None
        self.keys: list[np.ndarray] = []
        self.listed = 0

    def _dense(self) -> np.ndarray:
        if self.count is None:
            self.count = np.zeros((len(self.x), len(self.y)), np.int32)
        return self.count

    def _settle(self) -> None:
        """Listed pairs into the counts."""
        if self.keys:
            np.add.at(self._dense().reshape(-1), np.concatenate(self.keys), 1)
            self.keys, self.listed = [], 0

    def add(self, xs: pa.Array, ys: pa.Array) -> None:
        """Groups: their members in both blocks."""
        nx, ny = xs.value_lengths().to_numpy().astype(np.int64), ys.value_lengths().to_numpy().astype(np.int64)
        vx, vy = xs.flatten().to_numpy().astype(np.int64), ys.flatten().to_numpy().astype(np.int64)
        thick = nx * ny * 200 > self.cells
        fx, fy = np.cumsum(nx) - nx, np.cumsum(ny) - ny
        for g in np.flatnonzero(~thick).tolist():
            key = (vx[fx[g] : fx[g] + nx[g], None] * len(self.y) + vy[None, fy[g] : fy[g] + ny[g]]).reshape(-1)
            self.keys.append(key)
            self.listed += len(key)
            if self.listed * 8 > self.cells:
                self._settle()
        rank = np.cumsum(thick) - 1
        n_thick = int(thick.sum())
        of = lambda n, v: (np.repeat(np.where(thick, rank, -1), n), v)
        (gx, vx), (gy, vy) = of(nx, vx), of(ny, vy)
        for low in range(0, n_thick, 512):
            high = min(low + 512, n_thick)
            a, b = np.zeros((high - low, len(self.x)), np.float32), np.zeros((high - low, len(self.y)), np.float32)
            own, other = (gx >= low) & (gx < high), (gy >= low) & (gy < high)
            a[gx[own] - low, vx[own]] = 1
            b[gy[other] - low, vy[other]] = 1
            np.add(self._dense(), a.T @ b, out=self._dense(), casting="unsafe")

    def pairs(self, least: int) -> Iterator[pa.RecordBatch]:
        """The pairs counted at least so often; of one block with itself each pair once."""
        if self.count is None and self.keys:
            key, n = np.unique(np.concatenate(self.keys), return_counts=True)
            yield from self._batch(*np.divmod(key, len(self.y)), n, least)
            return
        self._settle()
        if self.count is not None:
            for low in range(0, len(self.x), 32):
                part = self.count[low : low + 32]
                i, j = np.nonzero(part >= least)
                yield from self._batch(i + low, j, part[i, j], least)

    def _batch(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
        keep = (n >= least) & (i < j) if self.same else n >= least
        if keep.any():
            yield pa.RecordBatch.from_arrays([self.x.take(pa.array(i[keep])), self.y.take(pa.array(j[keep])), pa.array(n[keep].astype(np.int64))], names=["a", "b", "n"])


def dictionary(texts: DataFrame) -> DataFrame:
    """Distinct texts: (text_sha256, text, n, first). The key is hash and text, so a collision of
    hashes stays two rows."""
    return texts.groupBy(F.sha2("text", 256).alias("text_sha256"), "text").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def collisions(dictionary_rows: DataFrame) -> DataFrame:
    return repeated_keys(dictionary_rows, ["text_sha256"])


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(text_sha256, state): unchanged, new or removed, over distinct text hashes."""
    h = lambda df, n: df.select(F.sha2("text", 256).alias("text_sha256")).distinct().withColumn(n, F.lit(True))
    rows = h(old, "_old").join(h(new, "_new"), "text_sha256", "full_outer")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").otherwise("unchanged")
    return rows.select("text_sha256", state.alias("state"))


def node_changes(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(id, change): lost, gained or changed nodes."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    rows = before.select("id", digest.alias("_b")).join(after.select("id", digest.alias("_a")), "id", "full_outer")
    change = F.when(F.col("_a").isNull(), "lost").when(F.col("_b").isNull(), "gained").when(F.col("_a") != F.col("_b"), "changed")
    return rows.select("id", change.alias("change")).filter("change is not null")


def edge_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Multiset difference of edges, as counts by key: lost and gained."""
    count = lambda df, n: df.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    rows = count(before, "b").join(count(after, "a"), key, "full_outer").fillna(0, ["a", "b"])
    return rows.withColumn("lost", F.greatest(F.col("b") - F.col("a"), F.lit(0))).withColumn("gained", F.greatest(F.col("a") - F.col("b"), F.lit(0))).filter("lost + gained > 0").drop("a", "b")


def round_trip_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one frame that the other lacks, as multisets, both ways; empty after a good round trip.
    Maps, which have no set operations, are compared as their sorted entries."""
    plain = lambda df: df.select(*[F.array_sort(F.map_entries(c)).alias(c) if t.startswith("map<") else F.col(c) for c, t in a.dtypes])
    a, b = plain(a), plain(b)
    return a.exceptAll(b).unionByName(b.select(*a.columns).exceptAll(a))


def fill_missing(nodes: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Facts fill only what a node lacks."""
    f = facts.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    rows = nodes.join(f, "id", "left")
    return rows.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in nodes.columns])


def new_edges(edges: DataFrame, proposed: DataFrame, key: list[str]) -> DataFrame:
    """Proposed edges that the graph lacks, once each."""
    return proposed.dropDuplicates(key).join(edges.select(*key), key, "left_anti")


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Last row per key: an upsert."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def secrets_in(files: DataFrame, pattern: str = r"(api[_-]?key|secret|token|password)\s*[=:]\s*\S+") -> DataFrame:
    return files.filter(F.col("text").rlike(f"(?i){pattern}"))
