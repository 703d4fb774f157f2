"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: records of one task fill archives of bounded size. Each archive trains a small dictionary
on a sample of its own records, stores it in a skippable frame and compresses every record as a
frame of its own. Each attempt of a task writes files of its own names; the manifest, a stored table that
holds the files of the attempts that Spark committed, is what makes them part of the result, so a repeated
or failed task leaves nothing that is read. Reading: the dictionary is loaded from the leading frame, frame bounds are
found from the block headers, each frame is decoded by itself, and headers, lengths, digests and
frame checksums are validated; a damaged archive raises ValueError.

Duplicates: of records with equal payloads of at least ``least`` bytes, that with the smallest id is
a response and the others revisit it. Rows that repeat that smallest id are responses too. A null
payload is empty; a null id never counts as the smallest unless all are null, and reads back null;
a null or unsafe target address is written percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, scratch_path, strings, table

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_DICTIONARY = b"\x37\xa4\x30\xec"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Raw bytes of records per archive, records that train a dictionary, dictionary size.
ARCHIVE, SAMPLES, DICTIONARY = 8 << 20, 64, 16 << 10
ROW = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("target", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def record(page_id: int | None, target: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record. A revisit (``refers_to`` set) has the HTTP head alone as its block."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(target or "", safe=":/?#[]@!$&'()*+,;=%~")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT)]
    fields.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    step = max(1, len(records) // SAMPLES)
    samples = [r[: 64 << 10] for r in records[::step][:SAMPLES]]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=128, d=8)
    except zstandard.ZstdError:  # too few records to train on
        return zstandard.ZstdCompressionDict(samples[0][:DICTIONARY].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def build_archive(records: list[bytes], level: int = 3) -> bytes:
    trained = _dictionary(records)
    raw = trained.as_bytes()
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True, write_dict_id=False)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(packer.compress, records)])


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that begins at ``at`` ends, found from its block headers."""
    try:
        flags = data[at + 4]
        at += zstandard.frame_header_size(data[at : at + 18])
        last = 0
        while not last:
            block = int.from_bytes(data[at : at + 3], "little")
            if at + 3 > len(data):
                raise ValueError("archive ends inside a frame")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            at += 3 + (1 if kind == 1 else size)
    except (IndexError, zstandard.ZstdError) as e:
        raise ValueError(f"bad frame header: {e}") from e
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ValueError("archive ends inside a frame")
    return at


def read_records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one per frame."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    at = 8 + struct.unpack_from("<I", data, 4)[0]
    raw = data[8:at]
    if len(raw) != at - 8:
        raise ValueError("archive ends inside its dictionary")
    if raw[:4] == FRAME_MAGIC:  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == ZSTD_DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    while at < len(data):
        end = frame_end(data, at)
        if data[at : at + 4] == FRAME_MAGIC:
            try:
                yield unpacker.decompress(data[at:end])
            except zstandard.ZstdError as e:
                raise ValueError(f"bad frame: {e}") from e
        at = end


REQUIRED = {"WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Length"}
_URN = re.compile(r"<urn:page:(-?\d*)>")


def parse(raw: bytes) -> tuple:
    """A record's fields in the order of ROW, after validation."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0].encode() != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if missing := REQUIRED.difference(fields):
        raise ValueError(f"headers are missing: {sorted(missing)}")
    length = int(fields["Content-Length"])
    block = rest[: max(length, 0)]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != length:
        raise ValueError("the block's length differs from Content-Length")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("the block's digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"\r\nContent-Length: (\d+)", http)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not sep or not size or kind not in ("response", "revisit") or (kind == "revisit") != ("WARC-Refers-To" in fields):
        raise ValueError("a header is missing or unknown")
    if kind == "response" and (len(payload) != int(size[1]) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload's length or digest differs")
    ids = [int(m[1]) if (m := _URN.fullmatch(fields.get(k, ""))) and m[1] else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
    return ids[0], kind, ids[1], fields["WARC-Target-URI"], int(size[1]), digest, payload if kind == "response" else None


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a folder that Spark names."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def mark_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html, digest, size, refers_to: null for responses. Only digests that occur
    more than once meet the pages in a join; hot ones are split by adaptive execution."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes")).filter(F.col("bytes") >= least)
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    repeat = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", F.when(repeat.isNull(), F.col("html")).alias("html"), "digest", "size", repeat.alias("refers_to"))


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write archives into ``folder`` (any address that Spark and pyarrow both open) and store the
    manifest: one row per archive with its file's name, records and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex
        held: list[bytes] = []
        size = made = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, made
            name = f"part-{context.partitionId():06d}-{made:04d}-{attempt}.warc.zst"
            data = build_archive(held)
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            out = pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})
            held, size, made = [], 0, made + 1
            return out

        for b in batches:
            columns = [strings(c).to_pylist() if pa.types.is_string(c.type) else c for c in b.columns]
            for i in range(b.num_rows):
                page_id, refers_to, payload = b.column(0)[i].as_py(), b.column(5)[i].as_py(), b.column(2)[i].as_py()
                held.append(record(page_id, columns[1][i], payload or b"", columns[3][i], b.column(4)[i].as_py(), refers_to))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield flush()
        if held:
            yield flush()

    rows = marked.select("page_id", "url", "html", "digest", "size", "refers_to")
    return materialize(rows.mapInArrow(run, "name string, records long, bytes long"), "warc-manifest")


def _decoded(contents: Iterator[bytes], payloads: bool) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ROW.names if payloads else ROW.names[:-1]
    for content in contents:
        columns = list(zip(*map(parse, read_records(content)), strict=True)) or [()] * len(ROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind, _ in zip(columns, kinds, names, strict=False)], names=names)


def _schema(payloads: bool) -> T.StructType:
    return ROW if payloads else T.StructType(ROW.fields[:-1])


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of all archives in a folder, as ROW. An archive is bounded and read whole by
    one task; ``payloads`` False validates payloads but leaves them out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(lambda batches: _decoded((x.as_py() for b in batches for x in b.column(0)), payloads), _schema(payloads))


def read_manifest(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives that a manifest names; their numbers must agree with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for b in batches:
            for row in b.to_pylist():
                with store.open_input_stream(f"{root}/{row['name']}", compression=None) as f:
                    content = f.read()
                (out,) = _decoded(iter([content]), payloads)
                if (len(content), out.num_rows) != (row["bytes"], row["records"]):
                    raise ValueError(f"{row['name']} differs from its manifest")
                yield out

    return manifest.repartition("name").mapInArrow(run, _schema(payloads))


def archive_pages(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Write all pages as archives into ``folder`` and return their records, read back."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    return read_manifest(write_archives(mark_revisits(pages, least), folder), folder, payloads=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch_path(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH page AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), first AS (
    SELECT payload_digest, min(page_id) AS page_id FROM page WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
    CASE WHEN f.page_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN f.page_id <> p.page_id THEN f.page_id END AS refers_to
FROM page AS p LEFT JOIN first AS f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= 100
"""
