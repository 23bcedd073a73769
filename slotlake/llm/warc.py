"""WARC archives with deduplicated payloads, and an external merge of their indexes."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha1
from base64 import b32encode

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotlake.llm.common import arrow_schema, extended
from slotlake.session import materialize, scratch_path

CRLF = "\r\n"
# The alphabet of base 32 in order, and that of Spark's conv().
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """min_bytes: smaller payloads are never revisits. records_per_file bounds a file
    and so a capture run. Capture dates are `epoch` plus page_id seconds. The merge
    has one range for about `range_rows` captures, `most_ranges` at most; their
    borders come from a sample of `sample` keys a range and have no bearing on
    the result."""

    min_bytes: int = 0
    records_per_file: int = 4000
    epoch: str = "2024-01-01 00:00:00"
    range_rows: int = 2000
    most_ranges: int = 8192
    sample: int = 8


# --- writing ---------------------------------------------------------------------


def base32_sha1(payload: Column) -> Column:
    """Bare base 32 of the SHA-1 of a binary column; five hexadecimal digits are four
    of base 32."""
    digest = F.sha1(payload)
    groups = [
        F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)
    ]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def with_types(pages: DataFrame, archive: Archive) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    The first page of each payload is the smallest page_id of its digest, so the
    payloads' groups are never gathered; the join back leaves a large group's rows
    to be split."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(F.encode(payload, "UTF-8")).alias("payload_digest"),
    )
    first = rows.groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    revisit = (
        (F.col("payload_bytes") >= archive.min_bytes)
        & F.col("first").isNotNull()
        & ~F.col("page_id").eqNullSafe(F.col("first"))
    )
    return (
        rows.join(first, "payload_digest")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("first")))
        .drop("first")
    )


def _record(archive: Archive) -> Column:
    """A WARC record without its closing two line breaks."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    seconds = F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(10 * 365 * 86400))
    date = F.date_format(
        F.lit(archive.epoch).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )
    http = text(
        "HTTP/1.1 200 OK", CRLF, "Content-Type: text/html; charset=utf-8", CRLF,
        "Content-Length: ", F.col("payload_bytes").cast("string"), CRLF, CRLF,
    )
    is_revisit = F.col("record_type") == "revisit"
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    extra = F.when(
        is_revisit,
        text("WARC-Profile: ", PROFILE, CRLF, "WARC-Refers-To: <urn:page:", name("refers_to"), ">", CRLF),
    ).otherwise(F.lit(""))
    return text(
        "WARC/1.1", CRLF,
        "WARC-Type: ", F.col("record_type"), CRLF,
        "WARC-Record-ID: <urn:page:", name("page_id"), ">", CRLF,
        "WARC-Date: ", date, CRLF,
        "WARC-Target-URI: ", uri, CRLF,
        "WARC-Payload-Digest: sha1:", F.col("payload_digest"), CRLF,
        extra,
        "Content-Type: application/http; msgtype=response", CRLF,
        "Content-Length: ", F.octet_length(block).cast("string"), CRLF, CRLF,
        block,
    )


def write_archives(pages: DataFrame, path: str, archive: Archive = Archive()) -> None:
    """One record a page in gzipped WARC files under `path`.

    A revisit record names the record that holds its payload, and keeps the HTTP
    head only. A null html is an empty payload; blanks and control characters of a
    url are written as %20. Rows with the smallest page_id of a payload are its
    responses (all of them, if rows repeat); a null page_id refers to that one, or
    is a response where no other page has the payload.
    """
    (
        with_types(pages, archive)
        .select(_record(archive).alias("value"))
        .write.option("lineSep", CRLF * 2)  # the end of a record
        .option("compression", "gzip")
        .option("maxRecordsPerFile", archive.records_per_file)
        .text(path)
    )


# --- reading ---------------------------------------------------------------------

INDEX = "run string, number long, urlkey string, date string, page_id {id}, payload_bytes long, payload_digest string, record_type string, refers_to {id}, intact boolean"
HEAD_END = b"\r\n\r\n"
PAGE = re.compile(r"<urn:page:(.*)>")


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped archive, by content length alone."""
    unpack = zlib.decompressobj(wbits=47)
    view, step = memoryview(content), 1 << 20
    data = bytearray()
    for start in range(0, len(view), step):
        piece = view[start : start + step]
        while len(piece):
            data += unpack.decompress(piece)
            piece = unpack.unused_data
            if unpack.eof:  # another member may follow
                unpack = zlib.decompressobj(wbits=47)
        at = 0
        while (end := data.find(HEAD_END, at)) >= 0:
            lines = bytes(data[at:end]).decode("utf-8").split("\r\n")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            stop = end + 4 + int(headers["Content-Length"])
            if len(data) < stop + 4:
                break
            yield headers, bytes(data[end + 4 : stop])
            at = stop + 4
        del data[:at]
    if data:
        raise ValueError("an archive ends within a record")


def url_key(url: str) -> str:
    """Sort-friendly form of a url: the host's labels turned round, then the rest."""
    rest = url.split("://", 1)[-1]
    cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def _index_entry(headers: dict[str, str], block: bytes) -> tuple:
    name = lambda h: None if (v := PAGE.match(h)[1]) == "null" else int(v)
    head, payload = block.split(HEAD_END, 1)
    size = int(head.rsplit(b": ", 1)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    full = headers["WARC-Type"] == "response"
    intact = not full or (len(payload) == size and b32encode(sha1(payload).digest()).decode() == digest)
    refers = name(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None
    return (
        url_key(headers.get("WARC-Target-URI", "")), headers["WARC-Date"],
        name(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], refers, intact,
    )


def read_index(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The capture index of all archives under `path`. A file is a capture run: its
    entries are numbered in the order of (urlkey, date, page_id)."""
    ddl = INDEX.format(id=id_type)
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows = [_index_entry(h, b) for h, b in records(content.as_py())]
                rows.sort(key=_order)
                rows = [(file.as_py(), k, *r) for k, r in enumerate(rows)]
                for start in range(0, len(rows), 10_000):
                    part = rows[start : start + 10_000]
                    columns = zip(*part, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)],
                        schema=schema,
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, ddl)


def _order(entry: tuple) -> tuple:
    """(urlkey, date, page_id), a null page_id first."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0


# --- the merge -------------------------------------------------------------------


class LoserTree:
    """k-way merge of sorted runs: each inner node holds the loser of its match, so
    the next entry costs one match on each level."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        k = len(runs)
        self.losers = [0] * max(k, 1)
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.wins(a, b) else (b, a)
        self.losers[0] = winners[1] if k > 1 else 0

    def wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and (head := self.heads[winner := self.losers[0]]) is not None:
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            node = (winner + k) // 2
            while node:
                if self.wins(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


def merge_runs(index: DataFrame, archive: Archive = Archive()) -> DataFrame:
    """The captures of all runs in one order: adds `position`, which counts from 0 by
    urlkey, date and page_id (null first).

    Keys are cut into ranges. A range's segments of the sorted runs are merged by a
    loser tree in one task; the ranges' sizes give the offsets of their positions.
    A url with any number of captures spreads over ranges, as the borders are full
    keys.
    """
    n = index.count()
    ranges = max(1, min(archive.most_ranges, -(-n // archive.range_rows)))
    key = ("urlkey", "date", "page_id", "run", "number")
    share = min(1.0, ranges * archive.sample / max(n, 1))
    drawn = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < int(share * (1 << 30))
    picked = [(r.urlkey, r.date, r.page_id is not None, r.page_id or 0, r.run, r.number) for r in index.filter(drawn).select(*key).collect()]
    picked.sort()
    borders = [picked[k * len(picked) // ranges] for k in range(1, ranges)] if picked else []
    columns = [c for c in index.columns]
    ddl = extended(index.schema, "range int")
    schema = arrow_schema(ddl)
    out_ddl = extended(ddl, "rank long")
    out_schema = arrow_schema(out_ddl)
    at = [columns.index(c) for c in key]

    def sort_key(row: tuple) -> tuple:
        url, date, page, run, number = (row[k] for k in at)
        return url, date, page is not None, page or 0, run, number

    def ranged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            of = [bisect_right(borders, sort_key(r)) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32())], schema=schema)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), ("number", "ascending")])
        names = [table["run"][k].as_py() for k in range(table.num_rows)]
        rows = list(zip(*[table[c].to_pylist() for c in columns], strict=True))
        starts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
        runs = [
            iter([(sort_key(rows[k]), k) for k in range(a, b)])
            for a, b in zip(starts, [*starts[1:], len(rows)], strict=True)
        ]
        order = [k for _, k in LoserTree(runs)]
        merged = table.take(pa.array(order, pa.int64()))
        return merged.append_column("rank", pa.array(range(len(order)), pa.int64())).cast(out_schema)

    cut = index.mapInArrow(ranged, ddl)
    merged = materialize(cut.groupBy("range").applyInArrow(merge, out_ddl), "warc-merged")
    sizes = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return merged.join(F.broadcast(offsets), "range").select(  # one row a range: at most most_ranges
        *columns, (F.col("base") + F.col("rank")).alias("position")
    )


def archive_round_trip(pages: DataFrame, archive: Archive = Archive(), path: str | None = None) -> DataFrame:
    """Writes the archives, reads them back and merges their indexes.

    page_id, payload_bytes, payload_digest, record_type, refers_to, intact, urlkey,
    date, position of every page, all as read from the archives; `intact` says that
    a response's payload has the digest its record names. An empty table gives no
    rows; repeated rows have records of their own; other columns are not looked at.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, archive)
    id_type = pages.schema["page_id"].dataType.simpleString()
    index = materialize(read_index(spark, path, id_type), "warc-index")
    return merge_runs(index, archive).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "urlkey",
        "date", "position",
    )
