"""Near-duplicate join on word shingles by chosen paths.

Texts are sets of shingles of ``Config.words`` consecutive words (a shorter text is one shingle).
Run r splits the texts on one sampled shared token, the shingle that is least under hash function r;
texts that share it meet in a bucket. A large bucket is split again on the tokens of later functions
as long as that pulls its members apart. Small buckets are searched by brute force; large ones whose
members stay together are cut into blocks, and every pair of blocks is searched. Blocks grow with their
bucket up to ``Config.block`` members: n texts that are all alike cost n * n comparisons, as their links are
counted exactly, but n * n / block rows. Two texts of similarity s agree on a function with probability s,
so ``Config.recall`` fixes the number of runs, the number of functions from which a path's further tokens
come, and the number of functions on which sketches must agree to be compared.

A pair is judged in one place only: the bucket of its first common tokens, which its sketches tell.
So links are counted without listing pairs, and no group is ever expanded into pairs. Sketches choose
the candidates; the shingle sets of their texts, hashed once for each text, decide exactly.

Texts that are equal are one text with several documents, whose copies are never compared. Result:
one row per document with its class (connected by links or equality; named by its least doc_id), the
number of different texts that its text links to, and the number of documents with its text.

Defined cases: a text without words, null included, is a class of its own with no links, also if
several documents have it. Rows with a null doc_id take no part; they get a null class. Words are
maximal runs of ASCII letters, digits and characters beyond ASCII, in lower case, so that changes of
case or punctuation do not hide a copy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkernel as K
from tessera.llm.common import materialize, parts, sieve, table, trimmed
from tessera.llm.graph import components

U = K.U


@dataclass(frozen=True)
class Config:
    words: int = 5
    similarity: float = 0.8
    recall: float = 0.99999
    functions: int = 32
    #: Members of a bucket that is searched as a whole, and at most of a block of a larger one.
    bucket: int = 256
    block: int = 1024
    depth: int = 3

    def __post_init__(self):
        if self.functions < self.reach(self.depth):
            raise ValueError(f"paths of {self.depth} tokens at similarity {self.similarity} need {self.reach(self.depth)} functions")

    def below(self, n: int, level: int) -> float:
        """The chance that a pair of the similarity sought agrees on fewer than ``level`` of n functions."""
        s = self.similarity
        return sum(math.comb(n, i) * s**i * (1 - s) ** (n - i) for i in range(level))

    @property
    def agree(self) -> int:
        """Sketches that agree on fewer functions are not compared: a tenth of the recall's loss at most."""
        return max(n for n in range(1, self.functions + 1) if n == 1 or self.below(self.functions, n) <= (1 - self.recall) / 10)

    def reach(self, level: int) -> int:
        """How many functions paths of ``level`` tokens draw from: the least number of which a pair of
        the similarity sought has ``level`` in common with the recall sought."""
        n = level
        while self.below(n, level) > 1 - self.recall:
            n += 1
        return n


def shingles(t: K.Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each (lower-case) text of a run, and their texts, in text order."""
    s, e, own = t.spans(K.LETTER[t.data])
    h = K.hashes(t.prefix(), s, e)
    first, gram = K.windows(h, own, words)
    of = own[first]
    count = np.bincount(own, minlength=len(t))
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        begin = np.searchsorted(own, short)
        with np.errstate(over="ignore"):
            whole = np.array([K.mix(np.array([(h[b : b + count[i]] * U(0x9FB21C651E98DF25)).cumsum()[-1] + U(count[i])], U))[0] for i, b in zip(short, begin, strict=True)], U)
        gram, of = np.concatenate([gram, whole]), np.concatenate([of, short])
    order = np.lexsort((gram, of))
    gram, of = gram[order], of[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
    return gram[new], of[new]


def sketches(gram: np.ndarray, of: np.ndarray, n: int, functions: int) -> np.ndarray:
    """The least token of each text under each function, hashed; texts without tokens get zeros."""
    out = np.zeros((n, functions), np.int64)
    if not len(gram):
        return out
    start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    seeds = K.mix(np.arange(1, functions + 1, dtype=U))
    with np.errstate(over="ignore"):
        for r in range(functions):
            x = (gram ^ seeds[r]) * U(0x9FB21C651E98DF25)
            x ^= x >> U(32)
            x *= U(0xD6E8FEB86659FD93)
            least = np.minimum.reduceat(x ^ (x >> U(29)), start)
            out[of[start], r] = K.mix(least + seeds[r]).view(np.int64)
    return out


def sketch(docs: DataFrame, config: Config) -> DataFrame:
    """doc_id, tid (digest of the text), mins (array of long; null without words)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tid"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in K.lowered_runs(b.column(2)):
                gram, of = shingles(t, config.words)
                mins = sketches(gram, of, len(t), config.functions)
                empty = np.bincount(of, minlength=len(t)) == 0
                at = pa.array(np.arange(0, mins.size + 1, config.functions, dtype=np.int32))
                lists = pa.ListArray.from_arrays(at, pa.array(mins.ravel()), mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, len(t)), b.column(1).slice(t.first, len(t)), lists], names=["doc_id", "tid", "mins"])

    return source.mapInArrow(trimmed(run), "doc_id long, tid string, mins array<long>")


def buckets(texts: DataFrame, config: Config, n_parts: int | None = None) -> DataFrame:
    """(place, path, left, right, own, tid): who is searched where. ``path`` lists the functions
    whose tokens the members share; left and right are the blocks that meet (0, 0: a whole bucket),
    own the member's block."""
    runs = F.explode(F.sequence(F.lit(0), F.lit(config.reach(1) - 1))).alias("run")
    rows = texts.select("tid", "mins", runs).select("tid", "mins", F.xxhash64("run", F.col("mins")[F.col("run")]).alias("place"), F.array("run").alias("path"))
    found: list[DataFrame] = []
    for level in range(1, config.depth + 1):
        counts = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rows = materialize(rows.join(counts, "place"), "buckets", n_parts)
        whole = F.col("n") <= config.bucket
        found.append(rows.filter(whole).select("place", "path", F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(0).alias("own"), "tid"))
        large = rows.filter(~whole)
        if large.isEmpty():
            break
        # Splitting helps where the next function's most frequent token has less than half.
        following = F.element_at("path", -1) + 1
        child = large.groupBy("place", F.get("mins", following).alias("token")).agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
        apart = child.groupBy("place").agg((F.max("m") * 2 < F.first("n")).alias("apart"))
        marked = large.join(apart, "place")
        last = level == config.depth
        stay = marked if last else marked.filter("not apart")
        found.append(_blocks(stay, config))
        if last:
            break
        final = min(config.reach(level + 1), config.functions) - 1
        then = F.explode(F.sequence(following, F.lit(final))).alias("run")
        split = marked.filter("apart").filter(following <= final).select("place", "path", "tid", "mins", then)
        rows = split.select("tid", "mins", F.xxhash64("place", "run", F.col("mins")[F.col("run")]).alias("place"), F.concat("path", F.array("run")).alias("path"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _blocks(stay: DataFrame, config: Config) -> DataFrame:
    """Cut large buckets into blocks that meet in pairs. Most members of a bucket of alike texts also
    share the token of an earlier function outside the path: those pairs are judged there. So the
    members with that function's most frequent token are settled, and their blocks meet only the
    blocks of the others."""
    last = F.element_at("path", -1)
    earlier = F.filter(F.sequence(F.lit(0), last), lambda f: ~F.array_contains("path", f))
    stay = stay.withColumn("token", F.get("mins", F.get(earlier, F.lit(0))))
    counts = stay.filter("token is not null").groupBy("place", "token").agg(F.count(F.lit(1)).alias("m"))
    common = counts.groupBy("place").agg(F.max_by("token", F.struct("m", "token")).alias("common"), F.max("m").alias("m"))
    rows = stay.join(common, "place", "left").withColumn("settled", F.coalesce(F.col("token") == F.col("common"), F.lit(False)))
    # Sixteen blocks, until these reach their largest size: pairs enough for many tasks.
    size = F.greatest(F.lit(config.bucket), F.least(F.lit(config.block), F.ceil(F.col("n") / 16)))
    blocks = lambda n: F.ceil(n / size).cast("int")
    m = F.coalesce("m", F.lit(0))
    rows = rows.withColumn("s", blocks(m)).withColumn("u", blocks(F.col("n") - m)).withColumn("h", F.xxhash64("tid", F.lit("block")))
    own = F.when(F.col("settled"), F.pmod("h", F.greatest("s", F.lit(1)))).otherwise(F.col("s") + F.pmod("h", F.greatest("u", F.lit(1)))).cast("int")
    first = F.when(F.col("settled"), F.col("s")).otherwise(0)
    met = rows.filter(~F.col("settled") | (F.col("u") > 0)).select("place", "path", "tid", own.alias("own"), F.explode(F.sequence(first, F.col("s") + F.col("u") - 1)).alias("other"))
    return met.select("place", "path", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "tid")


def _judged_here(mins: np.ndarray, g: pa.RecordBatch, config: Config) -> np.ndarray:
    """Pairs whose first common functions are exactly the path, and that agree on enough functions;
    where two blocks meet, pairs across them. Only these are judged in this bucket."""
    path = g.column(1)[0].as_py()
    n, first = len(mins), path[-1] + 1
    common = np.zeros((n, n), np.int16)
    own = g.column(4).to_numpy()
    ok = own[:, None] != own[None, :] if g.column(2)[0].as_py() != g.column(3)[0].as_py() else np.ones((n, n), bool)
    for r in range(mins.shape[1]):
        same = mins[:, None, r] == mins[None, :, r]
        if r < first:
            ok &= same == (r in path)
        common += same
    return ok & (common >= config.agree)


def _groups(b: pa.RecordBatch, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys."""
    change = np.zeros(b.num_rows, bool)
    for k in keys:
        c = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
        change[1:] |= c[1:] != c[:-1]
    at = [0, *np.flatnonzero(change).tolist(), b.num_rows]
    for i, j in zip(at, at[1:], strict=False):
        yield b.slice(i, j - i)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Groups of sorted rows, whole over batch bounds."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        for g in _groups(b, keys) if b.num_rows else []:
            key = tuple(g.column(g.schema.get_field_index(k))[0].as_py() for k in keys)
            if held and key != at:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(g)
            at = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


PLACE = ["place", "left", "right"]
MEMBER = ["place", "path", "left", "right", "own", "tid"]


def candidates(members: DataFrame, texts: DataFrame, config: Config) -> DataFrame:
    """Members that have a candidate partner in their bucket, by their sketches."""
    rows = members.join(texts.select("tid", "mins"), "tid").repartition(*PLACE).sortWithinPartitions(*PLACE, "tid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _whole_groups(batches, PLACE):
            if g.num_rows < 2:
                continue
            mins = g.column(6).flatten().to_numpy().reshape(g.num_rows, -1)
            pairs = _judged_here(mins, g, config)
            np.fill_diagonal(pairs, False)
            keep = pairs.any(axis=1)
            if keep.any():
                yield pa.RecordBatch.from_arrays([g.column(i) for i in range(6)], names=MEMBER).filter(pa.array(keep))

    return rows.select(*MEMBER, "mins").mapInArrow(trimmed(run), "place long, path array<int>, left int, right int, own int, tid string")


def _shared(gram: np.ndarray, of: np.ndarray, n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i and j."""
    if len(i) <= 4 * n:
        at = np.searchsorted(of, np.arange(n + 1))
        return np.array([len(np.intersect1d(gram[at[a] : at[a + 1]], gram[at[b] : at[b + 1]], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    token, count = np.unique(gram, return_counts=True)
    place = np.searchsorted(token, gram)
    keep = count[place] > 1
    place, of = place[keep], of[keep]
    used, place = np.unique(place, return_inverse=True)
    total = np.zeros((n, n), np.float32)
    for first in range(0, len(used), 4096):
        inside = (place >= first) & (place < first + 4096)
        x = np.zeros((n, min(4096, len(used) - first)), np.float32)
        x[of[inside], place[inside] - first] = 1
        total += x @ x.T
    return total[i, j].astype(np.int64)


def sets(texts: DataFrame, config: Config) -> DataFrame:
    """(tid, grams) of (tid, text): the sorted shingle hashes of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in K.lowered_runs(b.column(1)):
                gram, of = shingles(t, config.words)
                at = np.searchsorted(of, np.arange(len(t) + 1)) * 8
                data = pa.Array.from_buffers(pa.binary(), len(t), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(gram.astype("<u8"))])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, len(t)), data], names=["tid", "grams"])

    return texts.select("tid", "text").mapInArrow(trimmed(run), "tid string, grams binary")


def links(chosen: DataFrame, held: DataFrame, config: Config) -> DataFrame:
    """(tid, root, n): each linked text, a text of its group in this bucket, and the links counted
    here. Exact: by the shingle sets of the texts (``held``)."""
    rows = chosen.join(held, "tid").select(*MEMBER, "grams").repartition(*PLACE).sortWithinPartitions(*PLACE, "tid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _whole_groups(batches, PLACE):
            n = g.num_rows
            if n < 2:
                continue
            own = [np.frombuffer(x.as_buffer(), "<u8") for x in g.column(6)]
            gram, of = np.concatenate(own), np.repeat(np.arange(n), [len(x) for x in own])
            pairs = _judged_here(sketches(gram, of, n, config.functions), g, config)
            i, j = np.nonzero(np.triu(pairs, 1))
            if not len(i):
                continue
            size = np.bincount(of, minlength=n)
            both = _shared(gram, of, n, i, j)
            linked = both >= config.similarity * (size[i] + size[j] - both) - 1e-9
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            count = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            root = np.arange(n)
            while True:
                before = root.copy()
                np.minimum.at(root, i, root[j])
                np.minimum.at(root, j, root[i])
                root = root[root]
                if (root == before).all():
                    break
            keep = np.flatnonzero(count)
            tid = g.column(5)
            yield pa.RecordBatch.from_arrays([tid.take(pa.array(keep)), tid.take(pa.array(root[keep])), pa.array(count[keep])], names=["tid", "root", "n"])

    return rows.mapInArrow(trimmed(run), "tid string, root string, n long")


def near_duplicates(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.filter("doc_id is not null")
    rows = materialize(sketch(known, config), "sketches")
    n_rows = rows.count()
    n_parts = parts(docs.sparkSession, n_rows)
    texts = rows.groupBy("tid").agg(F.first("mins").alias("mins"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_copies"))
    texts = materialize(texts, "texts", n_parts)
    full = texts.filter("mins is not null").select("tid", "mins")
    members = materialize(candidates(buckets(full, config, n_parts), full, config), "candidates", n_parts)
    # The texts of candidates, once each: the row with the least id, or any of its repetitions.
    wanted = members.select("tid").distinct().join(texts.select("tid", F.col("first").alias("doc_id")), "tid")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    near = sieve(known, "doc_id", wanted.select("doc_id"))[0]
    held = near.join(wanted.withColumnRenamed("tid", "want"), "doc_id").filter(digest == F.col("want")).select(F.col("want").alias("tid"), "text").dropDuplicates(["tid"])
    found = materialize(links(members, materialize(sets(held, config), "sets", n_parts), config), "links", n_parts)
    labels = components(found.select(F.col("tid").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("tid").agg(F.sum("n").alias("n_links"))
    named = texts.drop("mins").join(labels.withColumnRenamed("node", "tid"), "tid", "left").join(counted, "tid", "left")
    # Texts without words are never one class: each of their documents names its own.
    keyed = named.select("tid", F.coalesce("label", "tid").alias("label"), "first", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    classes = keyed.groupBy("label").agg(F.min("first").alias("class_id"))
    of_text = keyed.join(classes, "label").select("tid", "class_id", "n_links", "n_copies")
    # Texts that very many documents share, at most 100,000 of them whatever the input, are broadcast, so
    # that no task gathers their documents; the others meet in a join.
    hot = F.col("n_copies") > max(10_000, n_rows // 100_000)
    names = ["class_id", "n_links", "n_copies"]
    met = rows.select("doc_id", "tid", F.col("mins").isNull().alias("empty")).join(F.broadcast(of_text.filter(hot)), "tid", "left")
    rest = met.filter("class_id is null").drop(*names).join(of_text.filter(~hot), "tid")
    out = met.filter("class_id is not null").unionByName(rest)
    out = out.select("doc_id", F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_links", "n_copies")
    nameless = docs.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(nameless)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same rows by brute force over shared shingles, for tables on which that is quick.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM documents WHERE doc_id IS NOT NULL
), texts AS (
    SELECT text, any_value(w) AS w, min(doc_id) AS id, count(*) AS n_copies FROM words GROUP BY text
), shingles AS (
    SELECT id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM texts
), sizes AS (
    SELECT id, count(*) AS n FROM shingles GROUP BY id
), common AS (
    SELECT x.id AS a, y.id AS b, count(*) AS k FROM shingles AS x JOIN shingles AS y ON x.g = y.g AND x.id <> y.id GROUP BY ALL
), link AS (
    SELECT a, b FROM common JOIN sizes AS p ON p.id = a JOIN sizes AS q ON q.id = b WHERE k >= 0.8 * (p.n + q.n - k)
), reach(id, least) AS (
    SELECT id, id FROM texts UNION SELECT b, least FROM reach JOIN link ON a = reach.id
), class AS (
    SELECT id, min(least) AS class_id FROM reach GROUP BY id
), degree AS (
    SELECT a AS id, count(*) AS n_links FROM link GROUP BY a
)
SELECT doc_id, CASE WHEN len(t.w) = 0 THEN doc_id ELSE class_id END AS class_id, coalesce(n_links, 0) AS n_links, n_copies
FROM words JOIN texts AS t USING (text) JOIN class ON class.id = t.id LEFT JOIN degree ON degree.id = t.id
UNION ALL SELECT NULL, NULL, 0, 1 FROM documents WHERE doc_id IS NULL
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class, the document with the least id stays. Rows that repeat that id
    with another text go; rows that repeat it wholly are one document. Rows without an id stay."""
    n_parts = parts(spark, docs.count())
    found = materialize(near_duplicates(docs), "classes", n_parts)
    gone = found.filter("doc_id <> class_id").select("doc_id", F.lit(True).alias("gone")).distinct()
    repeated = found.filter("doc_id = class_id").groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(False).alias("gone"))
    status = materialize(gone.unionByName(repeated).groupBy("doc_id").agg(F.max("gone").alias("gone")).withColumnRenamed("doc_id", "_doc_id"), "gone", n_parts)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("key"))
    # Most documents are surely not concerned, and not shuffled.
    maybe, rest = sieve(rows, "key", status.select("_doc_id"))
    judged = maybe.join(status, F.col("key") == F.col("_doc_id"), "left")
    kept = rest.select("row").unionByName(judged.filter("gone is null").select("row"))
    if not status.filter("not gone").isEmpty():
        kept = kept.unionByName(judged.filter("not gone").dropDuplicates(["key"]).select("row"))
    return kept.select("row.*")
