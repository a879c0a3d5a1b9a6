"""WARC archives: writing with revisit records, reading back, and one globally ordered capture index.

The index comes from an external merge. Every archive file yields a run, sorted where the file is read and written to the
shared folder. Ranges of (url key, time, page) are then dealt out; in each range a loser tree merges the slices of all
runs. Ranges split even a single url's captures, so neither a hot url nor a hot host stays in one task.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldstate.llm import common as C

#: Smallest payload that a revisit may stand for, records of a file at most, what ends a record.
SMALLEST, PER_FILE, END = 100, 2000, "\r\n\r\n"


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def with_originals(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """(page_id, url, html, digest, size, original): ``original`` is the smallest page id with the same payload, null for
    small payloads. Small ones take no part in the join: a million empty pages are no group."""
    data = F.encode(payload(F.col("html")), "UTF-8")
    rows = pages.select("page_id", "url", payload(F.col("html")).alias("html"), F.sha2(data, 256).alias("digest"), F.octet_length(data).cast("long").alias("size"))
    large = rows.filter(F.col("size") >= smallest)
    least = large.groupBy("digest").agg(F.min("page_id").alias("original"))
    small = rows.filter(F.col("size") < smallest).withColumn("original", F.lit(None).cast("long"))
    return large.join(least, "digest").unionByName(small)


def record() -> Column:
    """One WARC record without its end, from the columns of ``with_originals``. Page and time are in the record's headers."""
    again = F.col("page_id") != F.col("original")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    safe = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    when = F.date_format(F.timestamp_seconds(F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", safe),
        line("WARC-Date", when),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.when(again, F.concat(F.lit("<urn:page:"), F.col("original").cast("string"), F.lit(">")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_warc(pages: DataFrame, path: str, smallest: int = SMALLEST) -> None:
    """Archive files, compressed as a whole, of all rows of (page_id, url, html) under ``path``, which must not exist."""
    records = with_originals(pages, smallest).select(record().alias("value"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", PER_FILE).option("compression", "gzip").text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(headers, offset, length, block) of the records of an archive file, by their lengths."""
    at = 0
    while at < len(data):
        top = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:top].decode("utf-8").split("\r\n")[1:])
        begin = top + 4
        end = begin + int(headers["Content-Length"])
        yield headers, at, end + 4 - at, data[begin:end]
        at = end + 4


def page_of(name: str | None) -> int | None:
    return int(name[len("<urn:page:") : -1]) if name and len(name) > len("<urn:page:>") else None


def url_key(url: str | None) -> str:
    """Sort key of a url: host reversed, then the rest."""
    rest = (url or "").partition("://")[2]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


INDEX = (
    "url_key string, captured long, page_id long, run string, file string, offset long, length long, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long"
)
NAMES = [x.split()[0] for x in INDEX.split(", ")]
TYPES = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in INDEX.split(", ")]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """A sorted run for each archive file under ``path``; offsets and lengths are those before compression. Digests and sizes of responses come from the payload read."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                run = uuid.uuid5(uuid.NAMESPACE_URL, name).hex
                for headers, offset, length, block in parsed(gzip.decompress(content.as_py())):
                    top = block.index(b"\r\n\r\n") + 4
                    kind, body = headers["WARC-Type"], block[top:]
                    size, digest = len(body), sha256(body).hexdigest() if kind == "response" else ""
                    if kind == "revisit":
                        size = int(block[:top].split(b"Content-Length: ")[1].split(b"\r\n")[0])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    when = datetime.strptime(headers["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
                    rows.append((url_key(headers.get("WARC-Target-URI")), int(when.timestamp()), page_of(headers["WARC-Record-ID"]), run,
                                 name, offset, length, size, digest, kind, page_of(headers.get("WARC-Refers-To"))))
                rows.sort(key=lambda r: (r[0], r[1], r[2] if r[2] is not None else C.NO_ID))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(TYPES), TYPES)], NAMES)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return C.written(files.mapInArrow(emit, INDEX), "runs")


class LoserTree:
    """k-way merge of sorted lists: each inner node holds the loser of its match, so a step costs one path to the root."""

    def __init__(self, lists: list[list]) -> None:
        self.lists, self.k = lists, len(lists)
        self.at = [0] * self.k
        self.losers = [-1] * self.k  # at 0: the winner
        for i in range(self.k):
            self._play(i)

    def _head(self, i: int):
        return self.lists[i][self.at[i]] if self.at[i] < len(self.lists[i]) else None

    def _beats(self, i: int, j: int) -> bool:
        a, b = self._head(i), self._head(j)
        return b is None or (a is not None and (a, i) <= (b, j))

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:  # while the tree is built: wait for the opponent
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.k and (item := self._head(i := self.losers[0])) is not None:
            yield item
            self.at[i] += 1
            self._play(i)


def merged(index: DataFrame) -> DataFrame:
    """``index`` in global order with its ``position`` (from 0) by url key, time and page."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches if len(b)]
        if not tables:
            return
        table = pa.concat_tables(tables).combine_chunks()
        keys = list(zip(table["url_key"].to_pylist(), table["captured"].to_pylist(), [C.NO_ID if x is None else x for x in table["page_id"].to_pylist()]))
        slices: dict[str, list] = {}
        for i, run in enumerate(table["run"].to_pylist()):  # rows of a run come in its order
            slices.setdefault(run, []).append((keys[i], i))
        order = [i for _, i in LoserTree(list(slices.values()))]
        own = TaskContext.get().partitionId()
        out = table.take(pa.array(order)).append_column("range", pa.array([own] * len(order), pa.int32()))
        yield from out.append_column("inner", pa.array(range(len(order)), pa.int64())).to_batches(max_chunksize=10_000)

    keys = ("url_key", "captured", F.coalesce("page_id", F.lit(C.NO_ID)))
    dealt = index.repartitionByRange(*keys).sortWithinPartitions("run", *keys)
    done = C.written(dealt.mapInArrow(emit, INDEX + ", range int, inner long"), "captures")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range, not for each capture
    bases = done.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return done.join(bases, "range").withColumn("position", F.col("base") + F.col("inner")).drop("range", "inner", "base", "run")


def archived(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """Write all rows of (page_id, url, html) to archives in the shared folder, read them back and return the capture index.

    Payload is the html in UTF-8, null counts as empty. Of records with equal payloads of at least ``smallest`` bytes the
    one with the smallest page id is the response and holds the payload; the others are revisits of it. Rows that repeat a
    page id are records of their own, and with equal payloads all of them are responses. A null page id is kept as null and
    revisits nothing. A null url has no target header and the key ")". Captures are timed by their page id in seconds, as
    the table has no time. An empty table gives an empty index. Other columns are left out.
    """
    spark = pages.sparkSession
    path = f"{C.folder(spark)}/archive-{uuid.uuid4().hex}"
    write_warc(pages, path, smallest)
    return merged(runs(spark, path))


def digest(pages: DataFrame) -> DataFrame:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")
    return archived(pages).select(*names)
