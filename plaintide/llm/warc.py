"""WARC archives of pages, and one ordered capture index over all of them.

Tasks write their pages as WARC records sorted by URL key and time: every archive file is
a sorted run.  Every record is a gzip member of its own, so that it can be read alone from
its position, and has an id that no other record of any run has; a revisit names the
record it refers to.  Reading an archive back gives its index entries in that order.  The
runs are cut by key ranges, and each range is merged by a loser tree into the global order.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaintide.llm.common import written

REVISIT_MIN_BYTES = 100
ARCHIVE_BYTES = 1 << 26  # compressed; a longer record is an archive of its own
BATCH_BYTES, BATCH_RECORDS, FEED = 1 << 24, 1024, 1 << 16
# Record and header lines of the format.
VERSION, PROFILE, SEPARATOR = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "\r\n\r\n"
ENTRY = (
    "archive string, position bigint, record_type string, record_id string, page_id string, refers_to_record string, refers_to string, "
    "url string, captured string, payload_digest string, payload_bytes bigint, payload binary"
)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the last to the first, then path and query, in lower case."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    bare = F.regexp_replace(bare, r"^[^/?]*@|^www\d*\.", "")
    host = F.regexp_extract(bare, r"^([^/?:]*)", 1)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.concat(labels, F.lit(")"), F.regexp_replace(F.regexp_replace(bare, r"^[^/?]*", ""), r"^$", "/"))


def with_revisits(pages: DataFrame, id_col: str, url: str, html: str, captured: str | None) -> DataFrame:
    """Pages with payload size and digest, and the page and row that a revisit refers to.

    Equal payloads are those of equal length and SHA-256.  Copies are counted before the
    shuffle; only payloads that occur twice take part in the join.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    when = F.col(captured).cast("timestamp") if captured else F.timestamp_seconds(F.coalesce(F.col(id_col), F.lit(0)).cast("bigint"))
    rows = pages.select(
        F.col(id_col).cast("string").alias("page_id"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.col(url).cast("string").alias("url"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("captured"),
        payload.alias("html"), F.octet_length(payload).cast("bigint").alias("n"), F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    order = F.struct(F.col("id").isNull().alias("z"), "id", "row")
    first = (
        rows.filter(F.col("n") >= REVISIT_MIN_BYTES)
        .groupBy("digest", "n")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
        .drop("copies")
    )
    again = F.col("row") != F.col("first.row")
    return rows.join(first, ["digest", "n"], "left").select(
        "page_id", "row", "url", "captured", "html", "n", "digest",
        F.when(again, F.col("first.row")).alias("first_row"), F.when(again, F.col("first.id").cast("string")).alias("refers_to"),
    )


def _urn(run: str, row: Column) -> Column:
    """Id of the record of a row: the same whenever its task runs, another one in every run."""
    return F.concat(
        F.lit("<urn:uuid:"),
        F.regexp_replace(F.md5(F.concat(F.lit(f"{run}:"), row.cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        F.lit(">"),
    )


def _escaped(c: Column) -> Column:
    for char, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def records(resolved: DataFrame, run: str) -> DataFrame:
    """(key, captured, row, record): the text of each WARC record without the blank lines that end it.

    The page numbers travel in two lines of our own, which other readers skip.
    """
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    known = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    revisit = F.col("first_row").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(SEPARATOR)
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(run, F.col("row"))),
        line("WARC-Date", F.col("captured")),
        known("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        known("WARC-Refers-To", _urn(run, F.col("first_row"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(F.lit("")),
        known("Page-ID", _escaped(F.col("page_id"))),
        known("Refers-To-Page-ID", _escaped(F.col("refers_to"))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(SEPARATOR),
    )
    return resolved.select(url_key(F.col("url")).alias("key"), "captured", "row", F.concat(head, block).alias("record"))


def _closed(members: list[bytes]) -> bytes:
    """An archive without the zero byte that ends it: the text writer ends each row with that byte.

    The last byte of a member is the high byte of its record's length.  It isn't zero for a
    record of 16 MiB and more, and then an empty member ends the archive.
    """
    if members[-1][-1]:
        members = [*members, gzip.compress(b"", mtime=0)]
    return b"".join(members)[:-1]


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html",
    captured: str | None = None, records_per_file: int = 2000, archive_bytes: int = ARCHIVE_BYTES,
) -> str:
    """Write a record per page, in archives that are each sorted by URL key and time.

    An archive ends at ``records_per_file`` records or ``archive_bytes`` compressed bytes, and
    a task holds one at a time.  Null html is an empty payload, a null url has no target
    line, a null id no page line.  Of records with equal payloads of at least 100 bytes, the
    one with the smallest id (then the first row, null ids last) is the response and the
    others revisit it.  Without a ``captured`` column the id stands in for the time, in
    seconds.  Repeated rows are records of their own.
    """
    run = uuid.uuid4().hex
    runs = records(with_revisits(pages, id_col, url, html, captured), run).sortWithinPartitions("key", "captured", "row")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                member = gzip.compress(record.as_py().encode() + SEPARATOR.encode(), 6, mtime=0)
                if held and (len(held) == records_per_file or size + len(member) > archive_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([_closed(held)], pa.binary())], names=["content"])
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_closed(held)], pa.binary())], names=["content"])

    archives = runs.select("record").mapInArrow(pack, "content binary").select(F.col("content").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(position, content) of the gzip members of an archive, one at a time."""
    at = 0
    while at < len(data):
        inflate, parts, end = zlib.decompressobj(wbits=31), [], at
        while not inflate.eof:
            if end >= len(data):
                raise ValueError(f"member at {at} is cut off")
            parts.append(inflate.decompress(data[end : end + FEED]))
            end = min(end + FEED, len(data))
        yield at, b"".join(parts)
        at = end - len(inflate.unused_data)


def parse(data: bytes) -> Iterator[dict]:
    """The records of plain bytes, framed by their Content-Length."""
    at = 0
    while at < len(data):
        blank = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:blank].decode().split("\r\n")
        if version != VERSION:
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines)
        end = blank + 4 + int(head["Content-Length"])
        block = data[blank + 4 : end]
        if len(block) < int(head["Content-Length"]) or data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut off")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload of the record at {at} is damaged")
        page, first = (head[x] if x in head else None for x in ("Page-ID", "Refers-To-Page-ID"))
        yield {
            "position": at, "record_type": head["WARC-Type"], "record_id": head["WARC-Record-ID"], "page_id": None if page is None else unquote(page),
            "refers_to_record": head["WARC-Refers-To"] if revisit else None, "refers_to": None if first is None else unquote(first),
            "url": head.get("WARC-Target-URI"),
            "captured": head["WARC-Date"], "payload_digest": digest, "payload_bytes": size, "payload": None if revisit else payload,
        }
        at = end + 4


def archive_records(data: bytes) -> Iterator[dict]:
    """The records of an archive; ``position`` is where the gzip member, or the plain record, begins."""
    if data[:2] != b"\x1f\x8b":
        yield from parse(data)
        return
    for at, content in members(data):
        for record in parse(content):
            yield {**record, "position": at}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives, in file order, payloads checked against size and digest.

    One task holds one archive as it is stored, one decompressed member of it and a batch
    of entries; ``write_archives`` bounds the bytes of an archive.  Damage raises an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    fields = [f.split(" ") for f in ENTRY.split(", ")]
    types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[t]) for n, t in fields], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for record in archive_records(content.as_py()):
                    if not payloads:
                        record["payload"] = None
                    rows.append({**record, "archive": archive.as_py()})
                    size += len(record["payload"] or b"")
                    if size >= BATCH_BYTES or len(rows) == BATCH_RECORDS:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    return files.mapInArrow(run, ENTRY)


class LoserTree:
    """Merge k sorted lists: each step replays one path of losers from a leaf to the root."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.losers = [-1] * max(len(runs), 1)
        self.winner = -1
        for leaf in range(len(runs)):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether run ``a`` has the smaller head; an exhausted run comes last."""
        x, y = self.runs[a], self.runs[b]
        if self.at[b] >= len(y):
            return self.at[a] < len(x) or a < b
        return self.at[a] < len(x) and (x[self.at[a]], a) < (y[self.at[b]], b)

    def _replay(self, leaf: int) -> None:
        node = (leaf + len(self.runs)) // 2
        while node > 0:
            if self.losers[node] == -1:  # while the tree is built, the first to come waits
                self.losers[node] = leaf
                return
            if self._before(self.losers[node], leaf):
                leaf, self.losers[node] = self.losers[node], leaf
            node //= 2
        self.winner = leaf

    def __iter__(self) -> Iterator:
        while self.runs and self.at[self.winner] < len(self.runs[self.winner]):
            yield self.runs[self.winner][self.at[self.winner]]
            self.at[self.winner] += 1
            self._replay(self.winner)


def merge_index(entries: DataFrame) -> DataFrame:
    """Index entries of sorted runs in global order, numbered by ``place``.

    Entries are dealt by ranges of (key, captured, page, archive, position), so a key or time
    that holds a third of all captures is spread.  A task holds one range of index entries,
    without payloads.
    """
    keyed = entries.drop("payload").withColumns({"key": url_key(F.col("url")), "captured": F.coalesce("captured", F.lit("")), "page": F.coalesce(F.col("page_id").try_cast("bigint"), F.lit(-1))})
    order = ["key", "captured", "page", "archive", "position"]
    at = [keyed.columns.index(c) for c in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[list]] = {}
        held, base = [], 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in at]
            for i, entry in enumerate(zip(*columns)):
                parts = runs.setdefault(entry[3], [[]])
                if parts[-1] and parts[-1][-1] > (entry, -1):  # what arrives in pieces is more runs
                    parts.append([])
                parts[-1].append((entry, base + i))
            held.append(batch)
            base += batch.num_rows
        if held:
            merged = LoserTree([r for parts in runs.values() for r in parts])
            yield from pa.Table.from_batches(held).take(pa.array([i for _, i in merged], pa.int64())).to_batches()

    return keyed.repartitionByRange(*order).mapInArrow(run, keyed.schema).withColumn("place", F.monotonically_increasing_id())


def capture_history(pages: DataFrame, path: str, **columns) -> DataFrame:
    """Write the archives under ``path``, read them back, and return their merged index.

    An empty table writes no record and gives an empty index.  Other columns are ignored.
    """
    write_archives(pages, path, **columns)
    return merge_index(written(read_archives(pages.sparkSession, path, payloads=False)))
