"""Web archives with a two-level capture index, written and read by Spark tasks.

Pages are sorted over the cluster by a reversed-host key (``com,example)/path``)
and page id. Each task writes its range as gzipped WARC records, one member per
record, and an index of them: index lines in key order are compressed in blocks,
and a sparse directory keeps the first key and the place of every block. A lookup
searches the list of shards, then the shard's directory, then one block (each
binary), and reads just the record's bytes.

Of records with equal payloads of at least REVISIT_BYTES, the one with the
largest page id is the response and the others are revisits of it.

Files get new names in every attempt, and only those named in the list of shards
that Spark has committed are read: a lost executor leaves at most unread files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm.common import scratch_path, store

REVISIT_BYTES = 1000
BLOCK_LINES = 256            # index lines in a compressed block
FILE_BYTES = 1 << 30         # a task begins another archive file beyond this size
NO_ID = -(1 << 63)           # stands for a null page id in keys
# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Reversed-host sort key: ``com,example,www)/path?query``, host in lower case, no scheme, port or fragment."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    host = F.lower(F.regexp_extract(clean, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?:]*)", 1))
    rest = F.regexp_replace(clean, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


# ---------------------------------------------------------------- records

def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{digest}'.encode()).hexdigest())}>"


def _header_value(value: str) -> str:
    """Control characters would end a header line."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def record(page: dict) -> bytes:
    """One uncompressed WARC record of a page (page_id, url, payload, digest, response_id)."""
    payload, revisit = page["payload"], page["response_id"] is not None and page["response_id"] != page["page_id"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {_record_id(page['page_id'], page['digest'])}", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{page['digest']}", f"X-Payload-Length: {len(payload)}"]
    if page["url"] is not None:
        lines.append(f"WARC-Target-URI: {_header_value(page['url'])}")
    if page["page_id"] is not None:
        lines.append(f"X-Page-ID: {page['page_id']}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {page['response_id']}",
                  f"WARC-Refers-To: {_record_id(page['response_id'], page['digest'])}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a {VERSION} record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# ---------------------------------------------------------------- writing

class _Shard:
    """Archive files and index of one task."""

    def __init__(self, folder: str):
        self.fs, self.folder = filesystems.FileSystem.from_uri(folder)
        self.name, self.files, self.out, self.at = uuid.uuid4().hex, 0, None, 0
        self.lines, self.blocks, self.directory, self.size, self.first, self.last, self.n = [], [], [], 0, None, None, 0

    def _open(self, name: str):
        self.fs.create_dir(self.folder, recursive=True)
        return self.fs.open_output_stream(f"{self.folder}/{name}", compression=None)    # members are packed here

    def add(self, key: str, page: dict) -> None:
        if self.out is None or self.at >= FILE_BYTES:
            if self.out:
                self.out.close()
            self.file, self.at = f"{self.name}-{self.files}.warc.gz", 0
            self.out, self.files = self._open(self.file), self.files + 1
        packed = _gzip(record(page))
        self.out.write(packed)
        place = (key, NO_ID if page["page_id"] is None else page["page_id"])
        self.lines.append([*place, self.file, self.at, len(packed)])
        self.at += len(packed)
        self.first, self.last, self.n = self.first or place, place, self.n + 1
        if len(self.lines) >= BLOCK_LINES:
            self._end_block()

    def _end_block(self) -> None:
        if self.lines:
            packed = zlib.compress("\n".join(map(json.dumps, self.lines)).encode())
            self.directory.append([*self.lines[0][:2], self.size, len(packed)])
            self.blocks.append(packed)
            self.size += len(packed)
            self.lines = []

    def close(self) -> dict:
        self._end_block()
        self.out.close()
        directory = zlib.compress(json.dumps(self.directory).encode())
        with self._open(f"{self.name}.index") as out:
            for block in self.blocks:
                out.write(block)
            out.write(directory)
        return {"index": f"{self.name}.index", "first_key": self.first[0], "first_id": self.first[1],
                "directory_at": self.size, "directory_size": len(directory), "records": self.n}


SHARDS = "index string, first_key string, first_id long, directory_at long, directory_size long, records long"


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; returns the committed list of shards.

    A shard's files are written by one task and named after its attempt.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
                        F.sha1(payload).alias("digest"))
    # which pages revisit which is found on digests alone; few pages do, so Spark can
    # mostly broadcast them and sorts the payloads in one shuffle
    digests = rows.filter(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    heads = (digests.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").drop("n"))
    revisits, _ = store(digests.join(heads, "digest").filter(~F.col("page_id").eqNullSafe(F.col("response_id")))
                        .select(F.col("page_id").alias("of"), F.col("digest").alias("same"), "response_id").distinct(), "warc-revisits")
    keyed = (rows.join(revisits, rows["page_id"].eqNullSafe(revisits["of"]) & (rows["digest"] == revisits["same"]), "left")
             .drop("of", "same").withColumn("key", url_key(F.col("url"))).withColumn("order_id", F.coalesce("page_id", F.lit(NO_ID))))

    def write(batches):
        shard = None
        for batch in batches:
            names = ("page_id", "url", "payload", "digest", "response_id")
            columns = [batch.column(c).to_pylist() for c in names]
            for key, values in zip(batch.column("key").to_pylist(), zip(*columns)):
                shard = shard or _Shard(folder)
                shard.add(key, dict(zip(names, values)))
        if shard:
            yield pa.RecordBatch.from_pylist([shard.close()])

    sorted_pages = keyed.repartitionByRange("key", "order_id").sortWithinPartitions("key", "order_id")
    return store(sorted_pages.drop("order_id").mapInArrow(write, SHARDS), "warc-shards")[0]


# ---------------------------------------------------------------- reading

class Reader:
    """Looks captures up in an archive folder; keeps the directory and block last used."""

    def __init__(self, folder: str, shards: list[tuple]):
        self.fs, self.folder = filesystems.FileSystem.from_uri(folder)
        self.shards = sorted(shards, key=lambda s: (s[1], s[2]))
        self.firsts = [(s[1], s[2]) for s in self.shards]
        self.open, self.directory, self.block = {}, (None, None), (None, None)

    def read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 8:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.folder}/{name}")
        return self.open[name].read_at(size, at)

    def _directory(self, shard: tuple) -> tuple[list, list]:
        if self.directory[0] != shard[0]:
            entries = json.loads(zlib.decompress(self.read(shard[0], shard[3], shard[4])))
            self.directory = (shard[0], ([(e[0], e[1]) for e in entries], entries))
        return self.directory[1]

    def _lines(self, index: str, at: int, size: int) -> tuple[list, list]:
        if self.block[0] != (index, at):
            lines = [json.loads(x) for x in zlib.decompress(self.read(index, at, size)).split(b"\n")]
            self.block = ((index, at), ([(x[0], x[1]) for x in lines], lines))
        return self.block[1]

    def locate(self, key: str, page_id: int | None):
        """(file, offset, size) of every capture of a page under a key."""
        place = (key, NO_ID if page_id is None else page_id)
        s = bisect_right(self.firsts, place) - 1
        while s >= 0:                                  # captures of one place may go on from earlier shards and blocks
            firsts, entries = self._directory(self.shards[s])
            b = bisect_right(firsts, place) - 1
            while b >= 0:
                places, lines = self._lines(self.shards[s][0], entries[b][2], entries[b][3])
                i = bisect_right(places, place) - 1
                while i >= 0 and places[i] == place:
                    yield tuple(lines[i][2:])
                    i -= 1
                if firsts[b] != place:
                    break
                b -= 1
            if self.firsts[s] != place:
                break
            s -= 1

    def capture(self, file: str, at: int, size: int) -> dict:
        """What a record says, its payload checked against its digest."""
        headers, payload = parse(zlib.decompress(self.read(file, at, size), 31))
        digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest
                                   or len(payload) != int(headers["x-payload-length"])):
            raise ValueError(f"payload of {headers['warc-record-id']} doesn't match its digest")
        number = lambda name: int(headers[name]) if name in headers else None
        return {"page_id": number("x-page-id"), "payload_bytes": number("x-payload-length"), "payload_digest": digest,
                "record_type": kind, "refers_to": number("x-refers-to-page")}


def look_up(wanted: DataFrame, folder: str, shards: DataFrame) -> DataFrame:
    """Captures of the pages in ``wanted`` (page_id, url), read from the archive; absent ones give no row.

    Lookups are sorted like the index, so a task goes through its part of it
    once. The list of shards (one row per writing task) goes to every task.
    """
    listed = [tuple(r) for r in shards.collect()]

    def run(batches):
        reader = Reader(folder, listed)
        for batch in batches:
            rows = []
            for key, page_id in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist()):
                rows += [reader.capture(*place) for place in reader.locate(key, page_id)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64())]))

    places = wanted.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id")).distinct()
    # rows are few bytes but each reads a record: a fixed number of tasks, not one by the size of the rows
    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = places.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from its archive.

    Null html is an empty payload; a null url sorts under an empty host; a null
    page id is written and read like any other but is never the response of
    another. Rows that repeat page and payload of a response are responses too.
    An empty table writes nothing and gives no rows; other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    return look_up(pages, folder, write_archive(pages, folder))
