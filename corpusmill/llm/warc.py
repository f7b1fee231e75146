"""WARC archives, index first.

Each task writes one archive, a gzip member per record, and an index row per record: archive, offset, length, URL and
digest. Reading starts from the index: the byte ranges of the selected records are sorted, neighbouring ranges are
coalesced into one read, and each record is parsed and its payload's digest verified.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest id is a response; the others
revisit it and carry no payload. Archives lie in the shared folder; a task writes under a name of its own attempt and
renames it when it is whole, and its content depends on its input alone, so a repeated task changes nothing.

Defined results: a null html is an empty payload; a null URL gives a record without a target; rows repeated under the
smallest id are all responses; rows with a null id revisit a known id, and are responses where none is known; an empty
table gives no records. Columns other than id, URL and html are not read.
"""

from __future__ import annotations

import hashlib
import posixpath
import urllib.parse
import uuid
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from math import ceil

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, shared_path, tune, write_cut

MIN_REVISIT = 100
ARCHIVE_BYTES = 1 << 30
#: Ranges with a gap of at most GAP are read together, up to MAX_READ bytes at once.
GAP, MAX_READ = 1 << 16, 8 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as bytes. A revisit names the payload's size and digest but leaves it out."""
    http = b"" if refers_to is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = b"" if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else urllib.parse.quote(url, safe="".join(map(chr, range(33, 127)))),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": len(payload),
        "WARC-Profile": PROFILE if refers_to is not None else None,
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if refers_to is not None else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + block + _END


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload. Raises ValueError on a record that is cut."""
    head, mark, rest = data.partition(_END)
    lines = head.decode().split("\r\n")
    if not mark or lines[0] != "WARC/1.0":
        raise ValueError("no record starts here")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if len(rest) != size + len(_END) or rest[size:] != _END:
        raise ValueError("cut record")
    payload = rest[:size].partition(_END)[2] if size else b""
    return headers, payload


def _id_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


_INDEX = {"archive": pa.string(), "offset": pa.int64(), "length": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "digest": pa.string()}
_INDEX_SQL = "archive string, offset long, length long, page_id long, url string, digest string"


def _first_holders(pages: DataFrame) -> tuple[DataFrame, int]:
    """(page_id, digest, refers_to) of the revisits, and the bytes of all payloads."""
    html = F.coalesce("html", F.lit(""))
    prints = write_cut(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("n")), "payload-digests")
    large = prints.where(F.col("n") >= MIN_REVISIT)
    firsts = write_cut(large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1 AND refers_to IS NOT NULL"), "first-holders")
    revisits = large.join(firsts.select("digest", "refers_to"), "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return revisits.select("page_id", "digest", "refers_to"), prints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives of pages into folder and return their index, itself a written table."""
    spark = pages.sparkSession
    tune(spark)
    revisits, size = _first_holders(pages)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / ARCHIVE_BYTES))
    told = revisits.select("page_id", F.lit(0).alias("kind"), F.col("digest").alias("url"), F.col("refers_to").cast("string").alias("html"))
    rows = told.unionByName(pages.select(F.col("page_id").cast("long"), F.lit(1).alias("kind"), "url", "html"))
    # what a page revisits comes before the page, so the payloads move once and each task knows all it needs; rows go by
    # id and payload, so that those of one id, or of none, do not all meet in one task
    payload = F.when(F.col("kind") == 0, F.col("url")).otherwise(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    dealt = rows.withColumn("to", F.xxhash64("page_id", payload))
    ordered = dealt.repartition(n, "to").drop("to").sortWithinPartitions("page_id", "kind", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft = posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
        offset, current, refers, index = 0, object(), {}, []
        with fs.open_output_stream(draft) as out:
            for b in batches:
                for page_id, kind, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "kind", "url", "html")), strict=True):
                    if page_id != current:
                        current, refers = page_id, {}
                    if kind == 0:
                        refers[url] = int(html)
                        continue
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    digest = hashlib.sha256(payload).hexdigest()
                    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
                    data = squeeze.compress(record(page_id, url, payload, digest, refers.get(digest))) + squeeze.flush()
                    out.write(data)
                    index.append((posixpath.join(folder, name), offset, len(data), page_id, url, digest))
                    offset += len(data)
                    if len(index) >= 4096:
                        yield _index_batch(index)
                        index = []
        _settle(fs, draft, posixpath.join(root, name), offset)
        yield _index_batch(index)

    return write_cut(ordered.mapInArrow(run, _INDEX_SQL), "warc-index")


def _settle(fs: FileSystem, draft: str, final: str, size: int) -> None:
    """Rename a whole archive. Where another attempt of the task has done so already, its equal file stays."""
    try:
        fs.move(draft, final)
    except OSError:
        if fs.get_file_info(final).size != size:
            raise
        fs.delete_file(draft)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_INDEX)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _INDEX.values(), strict=True)], list(_INDEX))


def coalesce_ranges(ranges: Iterable[tuple[str, int, int]], gap: int = GAP, most: int = MAX_READ) -> Iterator[tuple[str, int, int, list[int]]]:
    """(archive, start, end, how-manieth ranges) of each read: ranges (archive, offset, length) that come in order,
    joined over gaps while small enough. Only the ranges of the read under way are held."""
    archive, start, end, own = "", 0, 0, []
    for i, (a, offset, n) in enumerate(ranges):
        if own and a == archive and offset - end <= gap and max(offset + n, end) - start <= most:
            end = max(offset + n, end)
            own.append(i)
            continue
        if own:
            yield archive, start, end, own
        archive, start, end, own = a, offset, offset + n, [i]
    if own:
        yield archive, start, end, own


_RECORD_SQL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_RECORD = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def read_records(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that rows of the index point to, whatever order the rows come in: they are sorted by archive and
    offset, and neighbours are read together. Sizes and digests come from the archives, and are verified where the
    payload is there."""
    tune(selected.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: deque[dict] = deque()  # index rows of the read under way, and the one that ended it

        def ranges() -> Iterator[tuple[str, int, int]]:
            for b in batches:
                for r in b.to_pylist():
                    pending.append(r)
                    yield r["archive"], r["offset"], r["length"]

        opened, f, out, size = None, None, [], 0
        for archive, start, end, own in coalesce_ranges(ranges()):
            if archive != opened:
                if f is not None:
                    f.close()
                fs, path = FileSystem.from_uri(archive)
                opened, f = archive, fs.open_input_file(path)
            f.seek(start)
            data = f.read(end - start)
            for r in (pending.popleft() for _ in own):
                out.append(_read_one(data[r["offset"] - start : r["offset"] - start + r["length"]], r, payloads))
                size += len(out[-1][-1] or b"")
                if size > MAX_READ or len(out) >= 4096:
                    yield _record_batch(out)
                    out, size = [], 0
        if f is not None:
            f.close()
        yield _record_batch(out)

    ordered = selected.select(*_INDEX).repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, _RECORD_SQL)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_RECORD)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RECORD.values(), strict=True)], list(_RECORD))


def _read_one(data: bytes, row: dict, payloads: bool) -> tuple:
    headers, payload = parse_record(zlib.decompress(data, 31))
    kind, digest, size = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["WARC-Payload-Length"])
    if kind == "response":
        size, found = len(payload), hashlib.sha256(payload).hexdigest()
        if found != digest or found != row["digest"]:
            raise ValueError(f"payload of {row['page_id']} differs from its digest")
    refers_to = _id_of(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None
    return _id_of(headers["WARC-Record-ID"]), row["url"], size, digest, kind, refers_to, payload if payloads and kind == "response" else None


def op6_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(read(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op6_warc_index_first": f"""
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""
}
