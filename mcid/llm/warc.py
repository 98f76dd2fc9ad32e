"""WARC archives with a two-level capture index.

Method: every page becomes a WARC record, compressed as a gzip member of its own. An archive is a sequence of
members; the store holds one row per member (archive, offset, record), so that the rows of an archive in order of
their offsets are a valid ``.warc.gz``, in any store that Spark can write, and a row is what a range read returns.
The capture index sorts keys with reversed host names over all archives and packs them into compressed blocks; a
sparse directory holds the first key of each block. A look-up searches the directory, then the block, then reads
the named ranges. In bulk each step is one join: keys with blocks, places with members.

The directory has at most ``entries`` rows of at most ``KEY`` characters, whatever the number of captures: blocks
grow instead. It is the only thing that the driver reads and every task holds.

Equal payloads: the smallest page_id writes a response, the others revisits that refer to it. Pages meet by digest
and length; the payloads themselves are shuffled only where a page is a revisit and there are many of these.

Cases: a null html is an empty payload; empty payloads count as equal (``min_bytes`` 0); a null or malformed url gets
a key of its own text (null: empty); a page without an id is a response unless a page with an id has its payload,
and is read back with a null id; repeated rows of the smallest id are all responses; an empty table gives no rows;
other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import bytes_batches, map_arrow, release, texts

#: Characters of a directory key; bytes of an archive, about.
KEY, ARCHIVE = 256, 256 << 20
CRLF = b"\r\n"


def clean(url: str | None) -> str:
    """A url without characters that would break a header or an index line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def surt(url: str | None) -> str:
    """Sort key with the host reversed: ``http://a.example.com:81/x?y#z`` gives ``com,example,a:81)/x?y``."""
    url = clean(url)
    try:
        u = urlsplit(url)
        host, port = u.hostname, u.port
    except ValueError:
        return url
    if not host:
        return url
    tail = f":{port}" if port and (u.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return ",".join(reversed(host.split("."))) + tail + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers: int | None, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, which names the length of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Date: {date}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join([*head, "", ""]).encode() + block + CRLF + CRLF


def parse(data: bytes) -> dict[str, object]:
    """Type, ids, digest and payload of a record; a response's payload is held against its digest."""
    head, _, rest = data.partition(CRLF + CRLF)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != found):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(name: str) -> int | None:
        number = fields.get(name, "<urn:page:>")[len("<urn:page:") : -1]
        return int(number) if number else None

    return {
        "page_id": page("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": found,
        "record_type": kind,
        "refers_to": page("WARC-Refers-To"),
        "payload": payload if kind == "response" else None,
    }


def compress(data: bytes) -> bytes:
    """A gzip member without time stamp, so that a repeated task writes the same bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The store: archive, offset, length, key, record."""
    body = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    slim = pages.select("page_id", F.sha1(body).alias("sha"), F.octet_length(body).alias("size"))
    first = slim.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("refers"), F.count("*").alias("n"))
    again = slim.join(first.where("n > 1 and refers is not null").drop("n"), ["sha", "size"])
    again = cut_lineage(again.where("page_id is null or page_id <> refers").distinct())
    revisit = again.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), F.col("refers"))
    todo = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(body).alias("sha")).join(
        revisit, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, at = TaskContext.get().partitionId() * 1_000_003, 0
        for batch in bytes_batches(batches):
            ids, urls, refers = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "refers"))
            rows: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for page, url, payload, r in zip(ids, urls, texts(batch, "html"), refers):
                member = compress(record(page, url, payload, r, date))
                if at and at + len(member) > ARCHIVE:
                    archive, at = archive + 1, 0
                for column, value in zip(rows, (archive, at, len(member), surt(url), member)):
                    column.append(value)
                at += len(member)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], ["archive", "offset", "length", "key", "record"])

    return cut_lineage(todo.select("page_id", "url", "html", "refers").mapInArrow(run, "archive long, offset long, length long, key string, record binary"))


def capture_index(store: DataFrame, entries: int = 65_536, least: int = 1024) -> DataFrame:
    """Index blocks in order of their keys: block, first, last, data (compressed lines)."""
    size = max(least, -(-store.count() // entries))
    order = ["key", "archive", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        lines: list[str] = []
        for batch in batches:
            for key, *place in zip(*(batch.column(i).to_pylist() for i in range(4))):
                lines.append("\t".join([key, *map(str, place)]))
                if len(lines) == size:
                    yield pack(block, lines)
                    block, lines = block + 1, []
        if lines:
            yield pack(block, lines)

    def pack(block: int, lines: list[str]) -> pa.RecordBatch:
        first, last = (line.partition("\t")[0] for line in (lines[0], lines[-1]))
        return pa.RecordBatch.from_pydict(
            {"block": [block], "first": [first], "last": [last], "data": [zlib.compress("\n".join(lines).encode())]},
            pa.schema([("block", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("data", pa.binary())]),
        )

    ranged = store.select(*order, "length").repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(ranged.mapInArrow(run, "block long, first string, last string, data binary"))


def places_in(data: bytes, key: str) -> list[tuple[int, int, int]]:
    """archive, offset, length of a key's captures in one block."""
    lines = zlib.decompress(data).decode().split("\n")
    return find(lines, [x.partition("\t")[0] for x in lines], key)


def find(lines: list[str], keys: list[str], key: str) -> list[tuple[int, int, int]]:
    return [tuple(map(int, x.split("\t")[1:])) for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]]


class Directory:
    """First and last keys of all blocks, cut to ``KEY`` characters."""

    def __init__(self, blocks: DataFrame):
        rows = blocks.select("block", F.substring("first", 1, KEY).alias("first"), F.substring("last", 1, KEY).alias("last")).orderBy("block").collect()
        self.blocks, self.first, self.last = ([r[i] for r in rows] for i in range(3))

    def search(self, key: str) -> list[int]:
        """Blocks that may hold a key: usually one; several where captures of one key fill blocks."""
        short = key[:KEY]
        return self.blocks[bisect_left(self.last, short) : bisect_right(self.first, short)]


def locate(keys: DataFrame, blocks: DataFrame, directory: Directory) -> DataFrame:
    """archive, offset of all captures of the distinct keys in column ``key``."""

    def assign(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        pairs = [(b, k) for k in batch.column("key").to_pylist() for b in directory.search(k)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string())], ["block", "key"])

    def search(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        found = []
        for data, keys in zip(batch.column("data").to_pylist(), batch.column("keys").to_pylist()):
            lines = zlib.decompress(data).decode().split("\n")
            sorted_keys = [x.partition("\t")[0] for x in lines]
            found += [p for k in keys for p in find(lines, sorted_keys, k)]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["archive", "offset"])

    # a list holds distinct keys between a block's first and last key
    wanted = map_arrow(keys.select("key"), assign, "block long, key string").groupBy("block").agg(F.collect_list("key").alias("keys"))
    return map_arrow(blocks.select("block", "data").join(wanted, "block").select("data", "keys"), search, "archive long, offset long")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(store: DataFrame, places: DataFrame, payload: bool = True) -> DataFrame:
    """Records at the given places, parsed."""
    schema = READ if payload else READ.rpartition(",")[0]

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        rows = [parse(zlib.decompress(x, 31)) for x in batch.column("record").to_pylist()]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        cols = [c.split() for c in schema.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[k]) for c, k in cols], [c for c, _ in cols])

    return map_arrow(store.select("archive", "offset", "record").join(places, ["archive", "offset"]).select("record"), run, schema, 4 << 20)


def lookup(store: DataFrame, blocks: DataFrame, directory: Directory, url: str) -> DataFrame:
    """All captures of one url: directory, then block, then range reads, each a filter that reaches the files."""
    key = surt(url)
    data = blocks.where(F.col("block").isin(directory.search(key))).select("data").collect()
    places = [p for r in data for p in places_in(r["data"], key)]
    at = [(F.col("archive") == a) & (F.col("offset") == o) for a, o, _ in places]
    condition = F.lit(False)
    for x in at:
        condition = condition | x
    spark = store.sparkSession
    members = store.where(condition)
    return read(members, spark.createDataFrame([p[:2] for p in places], "archive long, offset long"))


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, then read every page's captures back through the index by its url."""
    spark = pages.sparkSession
    store = write(pages, min_bytes)
    blocks = capture_index(store)
    directory = Directory(blocks)
    keys = map_arrow(pages.select("url"), keys_of, "key string").distinct()
    places = cut_lineage(locate(keys, blocks, directory))
    release(spark, blocks)
    return read(store, places, payload=False)


def keys_of(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column("url").to_pylist()], pa.string())], ["key"])
