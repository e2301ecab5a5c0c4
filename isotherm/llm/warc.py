"""WARC archives with a two-level capture index.

Writing: every task writes its rows as gzip members, one per record, into archive files. A page
whose payload equals that of a page with a smaller id becomes a revisit without body.

Index: one line per capture, keyed by the address with its host reversed, sorted by key over all
files (range partitioning), and compressed in blocks of BLOCK_LINES lines. Each index part has a
sparse directory of its own: first key, offset and length of every block. A lookup finds the parts
by binary search over their key ranges, in a part's directory the blocks by binary search, in the
block the lines by binary search, and then reads the records by their byte ranges.

Files go below the session's shared folder through a file system that understands the folder's
address, first under the name of the attempt, then renamed: a task that runs again leaves no
half-written archive in the index.

Defined results: NULL html is an empty payload, a NULL url an empty address. Records with equal
payloads of at least MIN_REVISIT bytes: smallest page_id is the response; rows that share this id
are all responses. Repeated rows each get their record. Rows without page_id never have revisits
refer to them. An empty table gives empty archives and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm.common import table
from isotherm.llm.words import map_rows
from isotherm.session import new_folder

MIN_REVISIT = 0                 # bytes from which equal payloads are revisits
BLOCK_LINES = 256               # captures in one block of the index
ARCHIVE_BYTES = 256 << 20       # a new archive file is begun beyond this size
DATE = "2024-01-01T00:00:00Z"   # the tables carry no capture time


def filesystem(address: str):
    """File system and path of a folder's address."""
    from pyarrow import fs

    if address.startswith("file:/") and not address.startswith("file://"):
        address = address.removeprefix("file:")
    return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)


def reversed_key(url: str | None) -> str:
    """Address with its host reversed: https://www.a.org/x?y -> org,a,www)/x?y."""
    url = url or ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url
    if not host:
        return url
    name = ",".join(reversed(host.lower().split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{name}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record. The address is also kept as JSON, which holds any character."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    shown = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in (url or ""))
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {shown or 'about:blank'}", f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response",
        f"X-Page: {json.dumps([page_id, url, len(payload), refers_to])}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; raises where block and digest disagree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, block


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, first): first is the page a revisit refers to, else NULL.

    Only digests that occur more than once are joined back; equal pages meet in partial aggregates.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    keyed = rows.withColumn("digest", F.sha1(body)).withColumn("n_bytes", F.octet_length(body))
    again = (keyed.where(F.col("n_bytes") >= min_revisit).groupBy("digest", "n_bytes")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "n_bytes", "first"))
    made = keyed.join(again, ["digest", "n_bytes"], "left")
    return made.select("page_id", "url", "html", F.when(
        F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).alias("first"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records; returns the index lines (key, page_id, line)."""
    def run(batches):
        import pyarrow as pa

        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, stream, size = "", None, 0
        lines: list[tuple] = []

        def close():
            nonlocal stream
            if stream is not None:
                stream.close()
                fs.move(f"{base}/_{name}", f"{base}/{name}")
                stream = None

        for batch in batches:
            for page_id, url, html, first in zip(*[c.to_pylist() for c in batch.columns]):
                payload = (html or "").encode("utf-8", "replace")
                d = digest(payload)
                raw = gzip.compress(record(page_id, url, payload, d, first), 6, mtime=0)
                if stream is None or size >= archive_bytes:
                    close()
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    stream = fs.open_output_stream(f"{base}/_{name}", compression=None)
                stream.write(raw)
                lines.append((reversed_key(url), page_id, json.dumps([name, size, len(raw)])))
                size += len(raw)
            # lines name a file that may still be open: they leave when the task ends
        close()
        for i in range(0, len(lines), 10_000):
            part = lines[i:i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.int64()),
                                              pa.array([x[2] for x in part], pa.string())], names=["key", "page_id", "line"])

    return records.select("page_id", "url", "html", "first").mapInArrow(run, "key string, page_id long, line string")


def write_index(lines: DataFrame, folder: str, parts: int, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorted compressed blocks, one file and one directory per part; returns the manifest of the parts."""
    # equal keys may spread over several parts: page_id and line break ties
    ordered = lines.repartitionByRange(parts, "key", "page_id", "line").sortWithinPartitions("key", "page_id", "line")

    def run(batches):
        import pyarrow as pa

        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        out, directory, offset, block, last = None, [], 0, [], None

        def flush():
            nonlocal offset, block
            packed = zlib.compress("\n".join(json.dumps(x) for x in block).encode())
            out.write(packed)
            directory.append((block[0][0], offset, len(packed)))
            offset, block = offset + len(packed), []

        for batch in batches:
            for key, page_id, line in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    out = fs.open_output_stream(f"{base}/_{name}.blocks")
                block.append((key, page_id, *json.loads(line)))
                last = key
                if len(block) >= block_lines:
                    flush()
        if out is None:
            return
        if block:
            flush()
        out.close()
        with fs.open_output_stream(f"{base}/{name}.directory") as d:
            d.write(zlib.compress(json.dumps(directory).encode()))
        fs.move(f"{base}/_{name}.blocks", f"{base}/{name}.blocks")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]]), pa.array([last])],
                                         names=["part", "low", "high"])

    return ordered.mapInArrow(run, "part string, low string, high string")


def _located(pa, rows: list[tuple]):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                      names=["file", "start", "size"])


def lookup(spark: SparkSession, urls: DataFrame, archives: str, index: str, manifest: list[tuple[str, str, str]],
           parts: int) -> DataFrame:
    """All captures of the addresses in urls (column url), read back from the archives.

    manifest: (low key, high key, part) per index part, one short row per file, so it may go to
    every task. The addresses are dealt to the parts that can hold them and sorted there.
    """
    ranges = sorted(manifest)
    lows, highs = [r[0] for r in ranges], [r[1] for r in ranges]

    def route():
        def run(columns):
            for (url,) in zip(*columns):
                key = reversed_key(url)
                for i in range(bisect_left(highs, key), bisect_right(lows, key)):
                    yield key, i
        return run

    asked = map_rows(urls.select("url").distinct(), route, "key string, part int").distinct()
    asked = asked.repartition(parts, "part").sortWithinPartitions("part", "key")

    def blocks(batches):
        """Locations of the captures, from the blocks the directory names."""
        import pyarrow as pa

        fs, base = filesystem(index)
        open_part, held, directory, firsts, file = None, (None, [], []), [], [], None
        for batch in batches:
            out: list[tuple] = []
            for key, part in zip(*[c.to_pylist() for c in batch.columns]):
                if part != open_part:
                    name = ranges[part][2]
                    with fs.open_input_stream(f"{base}/{name}.directory") as d:
                        directory = json.loads(zlib.decompress(d.read()))
                    firsts, open_part, held = [x[0] for x in directory], part, (None, [], [])
                    file = fs.open_input_file(f"{base}/{name}.blocks")
                # the block before the first that begins with the key may end with it
                k = max(0, bisect_left(firsts, key) - 1)
                while k < len(directory) and firsts[k] <= key:
                    if held[0] != k:
                        file.seek(directory[k][1])
                        rows = [json.loads(x) for x in zlib.decompress(file.read(directory[k][2])).decode().split("\n")]
                        held = (k, rows, [x[0] for x in rows])
                    rows, keys = held[1], held[2]
                    for x in rows[bisect_left(keys, key):bisect_right(keys, key)]:
                        out.append((x[2], x[3], x[4]))
                        if len(out) >= 10_000:
                            yield _located(pa, out)
                            out = []
                    k += 1
            yield _located(pa, out)

    located = asked.mapInArrow(blocks, "file string, start long, size long")
    # neighbours in an archive are read together; no archive is read by one task alone
    located = located.repartition(parts, "file", F.floor(F.col("start") / (8 << 20))).sortWithinPartitions("file", "start")

    def read():
        fs, base = filesystem(archives)
        held: list = ["", None]

        def run(columns):
            for name, start, size in zip(*columns):
                if held[0] != name:
                    if held[1] is not None:
                        held[1].close()
                    held[:] = [name, fs.open_input_file(f"{base}/{name}")]
                held[1].seek(start)
                fields, block = parse(gzip.decompress(held[1].read(size)))
                page_id, url, n, first = json.loads(fields["X-Page"])
                d = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response":
                    body = block.partition(b"\r\n\r\n")[2]
                    n, seen = len(body), digest(body)
                    if seen != d:
                        raise ValueError(f"payload and digest of page {page_id} differ")
                yield page_id, url, n, d, fields["WARC-Type"], first
        return run

    return map_rows(located, read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
                                   "record_type string, refers_to bigint")


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) and their index below folder; returns the manifest rows."""
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = write_archives(plan_records(pages), f"{folder}/archives")
    # written once: a range partitioning looks at its input twice, and every look would write archives anew
    lines.write.parquet(f"{folder}/lines")
    return write_index(spark.read.parquet(f"{folder}/lines"), f"{folder}/index", parts)


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), new_folder(spark, "warc")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = [(r.low, r.high, r.part) for r in archive_pages(spark, pages, folder, parts).collect()]
    return lookup(spark, pages.select(F.col("url").cast("string").alias("url")), f"{folder}/archives", f"{folder}/index",
                  manifest, parts)


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""WITH p AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0],
 lambda s: '{_B32}'[((('0x' || h[g * 5 + 1:g * 5 + 5])::INT >> s) & 31) + 1]), 'string_agg', '')), 'string_agg', '') AS payload_digest,
 min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first THEN first END::BIGINT AS refers_to FROM b"""
