"""Zstandard WARC archives: one frame per record, dictionary up front.

An archive starts with a skippable frame that holds the dictionary; then every
record is a frame of its own, so any record can be reached without the ones
before it. Archives travel as rows of a table (`archive`, `content`), which
every store that Spark writes can hold; files of the same form are read with
`spark.read.format("binaryFile")`.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import cut, table

#: Fixed value: the number that marks the dictionary's skippable frame.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
#: Smallest payload that may be stored as a revisit of an equal one.
REVISIT_BYTES = 1000
#: An archive is closed when it holds so many bytes before compression.
ARCHIVE_BYTES = 8 << 20
#: A dictionary of so many bytes is trained on the first records of its archive.
DICTIONARY_BYTES, TRAINING_RECORDS = 16 << 10, 200
#: Parts over which the copies of one page are dealt.
SALTS = 16
#: Fixed date of all records, so that equal pages give equal archives.
DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_sha1(payload: bytes) -> str:
    """The digest in the form that WARC headers carry."""
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response record, or a revisit record if it refers to another page."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: {payload_sha1(payload)}",
        f"WARC-Block-Digest: {payload_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary for an archive: trained on its first records, or their bytes as they are where those are too few or too alike."""
    first = records[:TRAINING_RECORDS]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, first, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(first)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes]) -> bytes:
    """Records as frames, after their dictionary's skippable frame."""
    shared = dictionary(records)
    packer = zstandard.ZstdCompressor(level=3, dict_data=shared)
    data = shared.as_bytes()
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(data)), data, *map(packer.compress, records)])


def _headers(lines: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = lines.decode("utf-8").split("\r\n")
    pairs = [line.partition(":") for line in rest]
    if any(not colon or not name for name, colon, _ in pairs):
        raise ValueError("a header line has no name")
    return first, {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse_record(raw: bytes) -> dict:
    """The checked content of one record; ValueError if a length or digest is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, named = _headers(head)
    if not gap or not version.startswith("WARC/1."):
        raise ValueError("no WARC header")
    size = int(named["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length isn't the stated one")
    if payload_sha1(block) != named["warc-block-digest"]:
        raise ValueError("the block's digest isn't the stated one")
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, inner = _headers(http)
    if not gap or not status.startswith("HTTP/"):
        raise ValueError("no HTTP header")
    kind = named["warc-type"]
    stated = int(inner["content-length"])
    if kind == "response" and (len(payload) != stated or payload_sha1(payload) != named["warc-payload-digest"]):
        raise ValueError("the payload isn't the stated one")
    if kind == "revisit" and (payload or "warc-refers-to" not in named):
        raise ValueError("a revisit has a payload or refers to nothing")
    return {
        "record_id": named["warc-record-id"],
        "record_type": kind,
        "url": named.get("warc-target-uri"),
        "payload_bytes": stated,
        "payload_digest": base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex(),
        "refers_to": named.get("warc-refers-to"),
        "payload": payload if kind == "response" else None,
    }


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive, a frame at a time.

    The leading frame may hold the dictionary as it is or compressed; archives
    without one, as others write them, are read, too.
    """
    at, shared = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        data, at = content[8 : 8 + size], 8 + size
        if len(data) != size:
            raise ValueError("the dictionary is cut short")
        if data.startswith(ZSTD_FRAME):
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        shared = zstandard.ZstdCompressionDict(data)
    unpacker = zstandard.ZstdDecompressor(dict_data=shared)
    view = memoryview(content)
    while at < len(content):
        if content[at : at + 4] != ZSTD_FRAME:
            raise ValueError(f"no frame at byte {at}")
        # the frame's end isn't stated: give the decoder growing pieces of what is left
        frame, raw, pos = unpacker.decompressobj(), [], at
        while not frame.eof:
            if pos >= len(content):
                raise ValueError("the last frame is cut short")
            raw.append(frame.decompress(view[pos : pos + 4096]))
            pos += 4096
        at = min(pos, len(content)) - len(frame.unused_data)
        yield parse_record(b"".join(raw))


ARCHIVES = "archive string, records long, content binary"


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives (`archive, records, content`) of `page_id, url, html, refers_to`.

    Each task closes an archive every 8 MB, so memory holds one archive at
    most, or one record where a page is longer than that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            content = write_archive(waiting)
            name = hashlib.sha1(content).hexdigest()[:16] + ".warc.zst"
            batch = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(waiting)], pa.int64()), pa.array([content], pa.binary())], ["archive", "records", "content"])
            waiting.clear()
            return batch

        for batch in batches:
            for page, url, html, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(write_record(page, url, (html or "").encode(), to))
                held += len(waiting[-1])
                if held >= ARCHIVE_BYTES:
                    yield close()
                    held = 0
        if waiting:
            yield close()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, ARCHIVES)


RECORDS = (
    "archive string, record_id string, record_type string, url string, payload_bytes long, "
    "payload_digest string, refers_to string, payload binary"
)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in `archive, content`.

    A wrong length, header or digest fails the job; an empty archive has no
    records. For files: `spark.read.format("binaryFile").load(folder)
    .select(col("path").alias("archive"), "content")`.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string() for n in names]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for record in read_archive(content.as_py() or b""):
                    rows.append(record | {"archive": name, "payload": record["payload"] if with_payload else None})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("archive", "content").mapInArrow(run, RECORDS)


def mark_revisits(pages: DataFrame) -> DataFrame:
    """`page_id, url, html, refers_to` for rows of pages.

    Of rows with equal payloads of at least 1000 bytes those with the largest
    page_id have no `refers_to`; the others have that page_id. Nulls: a null
    html is an empty payload; a null page_id is below any other, and a group
    with only such rows refers to nothing. Equal rows are treated alike. Only
    digests are grouped, and only those found twice are joined back; copies of
    one page are dealt over SALTS parts, with a row of the digest in each.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    long_enough = F.octet_length("html") >= REVISIT_BYTES
    # shorter pages meet nothing, so they aren't dealt out
    short = own.filter(~long_enough).withColumn("refers_to", F.lit(None).cast("long"))
    named = own.filter(long_enough).withColumn("digest", F.sha2("html", 256))
    firsts = named.select("page_id", "digest").groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first_id")).filter("n > 1 and first_id is not null")
    salted = firsts.select("digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("salt"))
    joined = named.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(salted, ["digest", "salt"], "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("first_id")).alias("refers_to")).unionByName(short)


def _page(urn: str) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `pages` written to archives and read back."""
    archives = cut(write_archives(mark_revisits(table(spark, sf_dir, "pages"))), "warc")
    return read_archives(archives, with_payload=False).select(
        _page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        _page("refers_to").alias("refers_to"),
    )


OP6_SQL = """
WITH own AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), grouped AS (
    SELECT *, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS first_id FROM own
)
SELECT page_id,
       CAST(strlen(html) AS BIGINT) AS payload_bytes,
       sha1(html) AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM grouped
"""
