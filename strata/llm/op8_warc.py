"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, followed by one Zstandard frame for every record, as the public
"Zstandard compression for WARC" specification lays it out.  Reading decodes
frame by frame and validates headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, mapped, materialize, table

SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
#: Dictionary: at most so many bytes, from payloads of at most so many pages (by hash of page_id), each up to so many bytes.
DICT_BYTES, DICT_PAGES, DICT_PAGE_BYTES = 32 << 10, 400, 16 << 10
LEVEL = 3
#: Bytes of payload that one archive takes before the next is begun.
ARCHIVE_BYTES = 8 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NO_DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record or archive breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, full_digest: str, length: int, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record; a revisit holds the HTTP header alone.  X-Payload-Length is that of the full payload."""
    block = HTTP + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {NO_DATE}", f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha1:{full_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Payload-Length: {length}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, validated."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        raise WarcError("no WARC header")
    lines = raw[:end].decode("utf-8").split("\r\n")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or name.lower() in headers:
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is not a number")
    block = raw[end + 4 : -4]
    if int(headers["content-length"]) != len(block) or raw[-4:] != b"\r\n\r\n" or end + 8 > len(raw):
        raise WarcError("Content-Length differs from the block")
    if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise WarcError("block digest differs")
    return headers, block


def skippable(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


class ArchiveWriter:
    def __init__(self, dictionary: bytes):
        import zstandard

        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True, write_checksum=True)
        self.lead = skippable(dictionary)

    def frame(self, raw: bytes) -> bytes:
        return self._compressor.compress(raw)


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, decoded frame by frame."""
    import zstandard

    at, d = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise WarcError("the dictionary frame is cut short")
        lead = data[8 : 8 + size]
        if lead.startswith(ZSTD_MAGIC):  # the dictionary may itself be compressed
            lead = zstandard.ZstdDecompressor().decompress(lead, max_output_size=64 << 20)
        d = zstandard.ZstdCompressionDict(lead) if lead else None
        at = 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        if at + 8 > len(data):
            raise WarcError(f"{len(data) - at} stray bytes at the end")
        if 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at > len(data):
                raise WarcError("a skippable frame is cut short")
            continue
        one = decoder.decompressobj()
        try:
            raw = one.decompress(view[at:])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at {at}: {e}") from e
        if not one.eof:
            raise WarcError(f"the frame at {at} is cut short")
        at = len(data) - len(one.unused_data)
        yield parse(raw)


def _writer(folder: str, dictionary: bytes):
    """Write each partition's records to archives of bounded size and give their paths.

    An archive gets its final name, which depends on the partition alone, when
    it is whole; a task that runs again writes the same bytes to the same name.
    """

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        where, path = fs.FileSystem.from_uri(folder)
        maker, part, number, done = ArchiveWriter(dictionary), TaskContext.get().partitionId(), 0, []
        out, size, name = None, 0, ""

        def close():
            out.close()
            final = f"{path}/part-{part:06d}-{number:05d}.warc.zst"
            where.move(name, final)
            done.append(final)

        for b in batches:
            for page_id, url, html, sha, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "first")), strict=True):
                payload = html or b""
                if out is None:
                    name = f"{path}/.{uuid.uuid4().hex}"
                    out, size = where.open_output_stream(name, compression=None), 0
                    out.write(maker.lead)
                kind = "response" if first is None else "revisit"
                uri = (url or "urn:unknown").replace("\r", "").replace("\n", "").strip() or "urn:unknown"
                out.write(maker.frame(record(kind, f"urn:page:{'' if page_id is None else page_id}", uri, payload, base64.b32encode(bytes.fromhex(sha)).decode(), len(payload), f"urn:page:{first}")))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    return run


def _reader(folder: str):
    def run(batches):
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                with where.open_input_stream(path, compression=None) as f:
                    data = f.read()
                for h, block in read_archive(data):
                    kind = h["warc-type"]
                    page = h["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                    to = h.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                    sha = h["warc-payload-digest"].removeprefix("sha1:")
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    size = int(h["x-payload-length"])
                    if kind == "response" and (digest(payload) != sha or len(payload) != size):
                        raise WarcError(f"payload of {page} differs from its digest or length")
                    rows.append((int(page) if page else None, h["warc-target-uri"], size, sha, kind, int(to) if kind == "revisit" else None, payload if kind == "response" else None))
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return run


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payloads; empty where they are too few to train one."""
    import zstandard

    fit = pages.filter("page_id is not null and length(html) > 64").select(F.col("page_id").cast("long").alias("page_id"), "html")
    # keys first, so that no more than DICT_PAGES payloads leave the executors; rows that share a page_id give one
    picked = fit.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(DICT_PAGES)
    sample = fit.join(F.broadcast(picked), "page_id", "left_semi").select("page_id", F.substring(F.encode("html", "utf-8"), 1, DICT_PAGE_BYTES).alias("x"))
    rows = sample.groupBy("page_id").agg(F.min("x").alias("x")).orderBy(F.xxhash64("page_id")).collect()
    try:
        return zstandard.train_dictionary(DICT_BYTES, [bytes(r["x"]) for r in rows]).as_bytes() if len(rows) >= 20 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, min_revisit_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as archives under ``folder`` and return their paths.

    Among equal payloads of at least ``min_revisit_bytes`` the row with the
    smallest page_id is a response and the others revisit it; rows that share
    that page_id are all responses, as are payloads below the size.  Null html
    is the empty payload.  Rows with a null page_id refer to the smallest
    page_id, and are responses where there is none.
    """
    from pyarrow import fs

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    # only digests that occur again, with the smallest page_id of each
    digests = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("html")).select("page_id", F.sha1("html").alias("sha"), F.length("html").alias("n"))
    again = digests.filter(F.col("n") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select(F.col("sha").alias("again"), "first")
    linked = rows.join(again, F.col("sha") == F.col("again"), "left").withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    return materialize(mapped(linked.select("page_id", "url", "html", "sha", "first"), _writer(folder, dictionary), "path string"))


def read_archives(paths: DataFrame, folder: str) -> DataFrame:
    """Records of the archives at ``paths``, validated, one row each."""
    tasks = max(1, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return paths.repartition(tasks).mapInArrow(_reader(folder), RECORD)


def archived(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Records of pages after a round trip through archives in the shared folder."""
    folder = f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    paths = write_archives(pages, folder, train_dictionary(pages), min_revisit_bytes)
    return read_archives(paths, folder)


def query(spark, sf_dir):
    return archived(table(spark, sf_dir, "pages")).drop("url", "payload")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT *, unhex(sha)::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + list_sum(list_transform(range(5), lambda j: substr(bits, (i * 5 + j + 1)::INT, 1)::INT * (16 >> j::INT))))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
