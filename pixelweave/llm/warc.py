"""WARC archives with revisit records, and an external merge of capture indexes.

Writing: payload digests are grouped (small rows only), each payload's largest
page id becomes its response, and the records are text lines with the record
terminator CRLF CRLF as line separator, so Spark's own writer commits them.

Reading: each archive is parsed record by record in one task, into a locally
sorted run of captures. Runs are dealt out by ranges of (URL key, timestamp,
page id), and in every range a loser tree merges its slices of the runs: ranges
in order give the captures of the whole archive set in global order. A URL with
very many captures spans several ranges, since the timestamp and the id are in
the key. The merge is external: slices lie in a temporary file of the task, a
block of each run is in memory, and more than ``FAN_IN`` runs are merged in
several passes.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import itertools
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import blank, fresh_path, local_name, small_batches

CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "url_key string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
FIELDS = [c.split()[0] for c in CAPTURE.split(", ")]
#: Bytes of records in an archive, in the mean and before compression; records in an archive at most.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 32 << 20, 20_000
#: Runs that are merged at a time, and captures of each that are in memory.
FAN_IN, BLOCK_ROWS = 128, 500
#: Captures have no time of their own; theirs begins here, a second a page id (ids modulo 10^9).
EPOCH = datetime.datetime(2024, 1, 1)


def base32_sha1(text) -> F.Column:
    """Upper-case base32 SHA-1 of a text's UTF-8 bytes: 160 bits are 32 letters, no padding."""
    digest = F.sha1(text.cast("binary"))
    letters = F.array(*map(F.lit, ALPHABET))
    five = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substring(digest, k * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    return F.array_join(F.flatten(F.transform(five, lambda v: F.array(*[F.get(letters, F.shiftright(v, s).bitwiseAND(F.lit(31))) for s in (15, 10, 5, 0)]))), "")


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(page_id, record)``: the text of one WARC record per row of ``pages(page_id, url, html)``.

    Of records with equal payloads of ``least_bytes`` or more, the one with the
    largest page id is the response and the others revisit it; smaller ones
    are all responses. A null html is an empty payload and a null url an empty
    one. Rows that share the largest id are all responses. A null page id can
    be named by no revisit: such rows revisit another page with their payload
    if there is one, and are responses if not.
    """
    own = pages.select("page_id", F.regexp_replace(blank(F.col("url")), r"[\x00-\x20\x7F]", "%20").alias("url"), blank(F.col("html")).alias("html"))
    small = own.select("page_id", F.octet_length("html").alias("n_bytes"), base32_sha1(F.col("html")).alias("digest"))
    owners = small.filter(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("owner"))
    kinds = small.join(owners, "digest", "left").select("page_id", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")).alias("refers_to")).distinct()
    by_page = kinds.withColumnRenamed("page_id", "of").withColumnRenamed("digest", "payload_digest")
    both = own.withColumn("digest", base32_sha1(F.col("html"))).join(by_page, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("payload_digest")))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    when = F.date_format(F.lit(EPOCH.isoformat(" ")).cast("timestamp_ntz") + F.make_dt_interval(secs=F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    n_bytes = F.octet_length("html")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n_bytes.cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = [
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), name(F.col("page_id")), F.lit(f"{CRLF}WARC-Target-URI: "), F.col("url"), F.lit(f"{CRLF}WARC-Date: "), when,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(f"{CRLF}Content-Type: application/http; msgtype=response"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {REVISIT}{CRLF}WARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block,
    ]
    return both.select("page_id", F.concat(*head).alias("record"))


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> str:
    """Write gzip-compressed archives below ``path`` and return it; a record is never split."""
    path = path or fresh_path(pages.sparkSession, "warc")
    mean = pages.agg(F.avg(F.octet_length(blank(F.col("html"))))).first()[0] or 0
    per_file = int(min(ARCHIVE_RECORDS, max(1, ARCHIVE_BYTES // (mean + 500))))
    records(pages, least_bytes).select("record").write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: reversed host labels, then path and sorted query, without scheme, ``www`` and fragment."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path.lower() or '/'}{'?' + query.lower() if query else ''}"


def parse(data: bytes, archive: str) -> Iterator[tuple]:
    """The captures of one archive, in file order; a payload that does not match its digest is an error."""
    number = lambda name: None if name.endswith(":null>") else int(name[12:-1])
    at = 0
    with gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data) as source:
        while version := source.readline():
            head = [version]
            while head[-1] not in (b"\r\n", b""):
                head.append(source.readline())
            fields = dict(line.decode("utf-8", "replace").rstrip(CRLF).split(": ", 1) for line in head[1:-1])
            size = int(fields["Content-Length"])
            block = source.read(size)
            http, _, payload = block.partition(b"\r\n\r\n")
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
            n_bytes = int(http.rpartition(b"Content-Length: ")[2])
            if not version.startswith(b"WARC/") or len(block) != size or source.read(4) != b"\r\n\r\n" or (kind == "response" and (len(payload) != n_bytes or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest)):
                raise ValueError(f"damaged record at {at} of {archive}")
            stamp = "".join(c for c in fields["WARC-Date"] if c.isdigit())
            yield url_key(fields.get("WARC-Target-URI", "")), stamp, number(fields["WARC-Record-ID"]), n_bytes, digest, kind, number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, archive, at
            at += sum(map(len, head)) + size + 4


def order_of(row: tuple) -> tuple:
    """Global order of captures: URL key, timestamp, page id (null first), place."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def batch_of(rows: list[tuple], **more) -> pa.RecordBatch:
    """Captures as an Arrow batch, with further columns behind them."""
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()])]
    return pa.record_batch([*columns, *more.values()], [*FIELDS, *more])


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of every archive below ``path`` with their ``place`` in the archive's sorted run."""
    small_batches(spark)

    def rows(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                run = sorted(parse(data, local_name(name)), key=order_of)
                for k in range(0, len(run), 10_000):
                    part = run[k : k + 10_000]
                    yield batch_of(part, place=pa.array(range(k, k + len(part)), pa.int64()))

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(rows, f"{CAPTURE}, place long")


class LoserTree:
    """k-way merge of sorted runs: one comparison per level for each row taken out."""

    def __init__(self, runs: list[Iterable[tuple]]) -> None:
        self.runs, self.k = [iter(r) for r in runs], max(1, len(runs))
        self.heads = [self.draw(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self.play(i)

    def draw(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (order_of(row), i, row)

    def beats(self, a: int, b: int) -> bool:
        """Whether run ``a`` goes before run ``b``; an exhausted run goes last."""
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def play(self, i: int) -> None:
        at = (i + self.k) // 2
        while at > 0:
            if self.losers[at] == -1:
                self.losers[at] = i
                return
            if self.beats(self.losers[at], i):
                i, self.losers[at] = self.losers[at], i
            at //= 2
        self.losers[0] = i

    def __iter__(self):
        while (best := self.heads[self.losers[0]]) is not None:
            yield best[2]
            i = best[1]
            self.heads[i] = self.draw(i)
            self.play(i)


class RunFile:
    """Sorted runs of captures as blocks in a temporary file, which goes with the task."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()

    def write(self, rows: Iterable[tuple]) -> list[int]:
        """Write a run behind the others; where its blocks begin."""
        rows, begins = iter(rows), []
        while block := list(itertools.islice(rows, BLOCK_ROWS)):
            begins.append(self.file.seek(0, io.SEEK_END))
            pickle.dump(block, self.file, pickle.HIGHEST_PROTOCOL)
        return begins

    def read(self, begins: list[int]) -> Iterator[tuple]:
        for at in begins:
            self.file.seek(at)
            yield from pickle.load(self.file)

    def merged(self, runs: list[list[int]]) -> Iterator[tuple]:
        """The rows of all runs in order, with at most ``FAN_IN`` runs open at a time."""
        while len(runs) > FAN_IN:
            runs = [self.write(LoserTree([self.read(r) for r in runs[k : k + FAN_IN]])) for k in range(0, len(runs), FAN_IN)]
        return iter(LoserTree([self.read(r) for r in runs]))


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """All captures below ``path`` in global order of URL key, timestamp and page id.

    ``range_no`` and ``position`` give the order: ranges follow each other.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sorted_runs(spark, path).repartitionByRange(n, "url_key", "timestamp", F.col("page_id").asc_nulls_first(), "archive", "offset")
    slices = dealt.sortWithinPartitions("archive", "place").withColumn("range_no", F.spark_partition_id())  # each run's slice as it was

    def merged(batches):
        at, store = 0, RunFile()

        def captures():
            nonlocal at
            for batch in batches:
                if batch.num_rows:
                    at = batch.column("range_no")[0].as_py()
                yield from zip(*(batch.column(c).to_pylist() for c in FIELDS))

        runs = [store.write(slice_) for _, slice_ in itertools.groupby(captures(), key=lambda row: row[7])]
        rows, position = store.merged(runs), 0
        while block := list(itertools.islice(rows, 10_000)):
            yield batch_of(block, range_no=pa.array([at] * len(block), pa.int32()), position=pa.array(range(position, position + len(block)), pa.int64()))
            position += len(block)

    return slices.mapInArrow(merged, f"{CAPTURE}, range_no int, position long")


def archive_and_index(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write archives of ``pages`` and return their merged capture index, read back from them.

    Page ids are integers. An empty table gives no archive record and an empty
    index. A very long page is one record, read into memory by itself. Of equal
    keys the archive and the place in it decide. Columns other than
    ``page_id``, ``url`` and ``html`` are not read.
    """
    return capture_index(pages.sparkSession, write_archives(pages, path, least_bytes))
