"""Operator 8: WARC archives and an externally merged capture index.

Every page becomes a WARC 1.1 record in one gzip member.  The page with the
smallest id among those with equal payloads is a ``response``; the others are
``revisit`` records that refer to it and hold the HTTP header alone.  Payloads
below ``min_revisit`` bytes are always responses.

Plan: payloads are compared by SHA-1 and length in a map-side combined
aggregate; a payload of very many pages is sent to its pages instead of gathering
them.  Each task then writes one archive and, beside it, runs: at most ``RUN_ROWS``
captures each, sorted by URL key, timestamp and page.  Runs are merged by k-way
loser trees, ``FAN_IN`` at a time, in rounds; the last round is split into ranges of
(URL key, timestamp, page), as many as there are captures for, so that it runs in
parallel and a URL with a large share of all captures is split too.  The bounds of
the ranges come from at most FAN_IN * ``SAMPLES`` captures read at even distances;
a task finds its range in each run by bisecting the file, so no index of the runs is
ever collected.  The parts in order are the global capture history; a capture's number in
its URL's history is counted by the merge, and carried over from part to part by one
row a part.  Tasks write under attempt names; only files that a finished task reported
are read, so lost executors leave no trace in the result.  Archives are read back
record by record, and payloads checked against their digests.

The pages have no capture time unless a timestamp column is named (``captured``), so
dates are invented: as many seconds after the start of 2024 as the page's id says,
before it for negative ids, held within the years 1000 to 9999; 0 for a null id.

Defined cases: a null html is an empty payload; a null url has the empty key;
rows equal in page_id and payload are written each, and all of them are
responses if the id is the smallest; a null page_id is written as id ``-``, comes
back as null and is never referred to unless no other page has the payload;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, meet, open_shared, small_batches

FAN_IN = 64
#: Captures of a sorted run, and of a part of the history; parts at most; captures sampled of a run for the bounds of the parts.
RUN_ROWS, PART_ROWS, MAX_PARTS, SAMPLES = 200_000, 4096, 1024, 256
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
FIRST, LAST = datetime(1000, 1, 1, tzinfo=timezone.utc), datetime(9999, 12, 31, 23, 59, 59, tzinfo=timezone.utc)
_URN = "urn:page:"
_TAB = str.maketrans("\t\n\r", "   ")


# -- records -------------------------------------------------------------------------------


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query, in lower case; no scheme, fragment or default port."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().translate(_TAB))
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().translate(_TAB).lower()
    labels = ",".join(reversed(host.split(".")))
    at = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{labels}{at}){parts.path or '/'}{query}".lower()


def invented_date(page: int | None) -> datetime:
    """So many seconds after EPOCH."""
    low, high = (round((end - EPOCH).total_seconds()) for end in (FIRST, LAST))
    return EPOCH + timedelta(seconds=min(max(page or 0, low), high))


def _urn(page: int | None) -> str:
    return f"<{_URN}{'-' if page is None else page}>"


def record(page: int | None, url: str | None, moment: datetime, payload: bytes, digest: str, refers: int | None, is_revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {moment:%Y-%m-%dT%H:%M:%SZ}",  # FIRST keeps years at four digits
        f"WARC-Target-URI: {(url or '').translate(_TAB)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream: io.RawIOBase, size: int = 1 << 20) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, one after another."""
    inflate, parts, rest = zlib.decompressobj(31), [], b""
    while data := rest or stream.read(size):
        parts.append(inflate.decompress(data))
        rest = inflate.unused_data
        if inflate.eof:
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, body = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = body[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is cut short")
    return fields, block


# -- loser tree ----------------------------------------------------------------------------


class LoserTree:
    """Merges sorted iterators with one comparison a level for each row taken."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] + [None] * (self.k - len(self.runs))
        self.losers = [-1] * self.k
        winners = [0] * (2 * self.k)
        winners[self.k :] = range(self.k)
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.heads[self.winner]) is not None:
            yield row
            w = self.winner
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _key(line: str) -> tuple:
    key, moment, page, *_ = line.split("\t")
    return key, moment, (page == "-", 0 if page == "-" else int(page))


def _run_rows(uri: str, lo: tuple | None = None, hi: tuple | None = None) -> Iterator[tuple]:
    """Rows of a run from the first one of at least ``lo`` to the last one below ``hi``."""
    with open_shared(uri, "rb") as f:
        f.seek(0 if lo is None else _place(f, lo))
        while raw := f.readline():
            line = raw.decode()
            key = _key(line)
            if lo is not None and key < lo:
                continue
            if hi is not None and key >= hi:
                return
            yield key, line


def _line_after(f, at: int) -> str:
    """The first line that begins at ``at`` or later; empty at the end."""
    f.seek(max(at - 1, 0))
    if at:
        f.readline()
    return f.readline().decode()


def _place(f, key: tuple) -> int:
    """A place in a sorted file from which the first row of at least ``key`` is at most a few lines away."""
    low, high = 0, f.seek(0, 2)
    while high - low > 4096:
        middle = (low + high) // 2
        line = _line_after(f, middle)
        if line and _key(line) < key:
            low = middle
        else:
            high = middle
    if low:
        f.seek(low - 1)
        f.readline()
        return f.tell()
    return 0


def _write_run(uri: str, rows: Iterator[tuple]) -> int:
    """Writes sorted rows; tells their number."""
    n = 0
    with open_shared(uri, "wb") as f:
        for _, line in rows:
            f.write(line.encode())
            n += 1
    return n


# -- Spark ---------------------------------------------------------------------------------

_FILES = "task int, seq int, warc string, run string, n long"


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["task", "seq", "warc", "run", "n"])


def _writer(folder: str, run_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        name, at, captures, runs, out = f"{folder}/part-{task:06d}-{attempt}", 0, [], [], None

        def end_run() -> None:
            captures.sort()
            seq = len(runs)
            uri = f"{name}-{seq:04d}.cdx"
            runs.append((task, seq, None if seq else f"{name}.warc.gz", uri, _write_run(uri, captures)))
            captures.clear()

        for batch in batches:
            for page, url, html, moment, refers in zip(*(c.to_pylist() for c in batch.columns[:5])):
                out = out or open_shared(f"{name}.warc.gz", "wb")
                payload = (html or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                moment = invented_date(page) if moment is None else EPOCH + timedelta(microseconds=moment)
                press = zlib.compressobj(1, zlib.DEFLATED, 31)
                revisit = refers is not None
                raw = press.compress(record(page, url, moment, payload, digest, refers, revisit)) + press.flush()
                out.write(raw)
                line = "\t".join([url_key(url), f"{moment:%Y%m%d%H%M%S}", "-" if page is None else str(page), "revisit" if revisit else "response", digest, str(task), str(at), str(len(raw))]) + "\n"
                captures.append((_key(line), line))
                at += len(raw)
                if len(captures) >= run_rows:
                    end_run()
        if out:
            out.close()
            if captures or not runs:
                end_run()
            yield _manifest(runs)

    return run


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0, captured: str | None = None) -> DataFrame:
    """Writes archives and sorted runs into ``folder``; a row for each run, the first of a task names its archive: task, seq, warc, run, n.

    captured: the timestamp column that holds the time of capture, if there is one.
    """
    spark = pages.sparkSession
    small_batches(spark, rows=500)
    html = F.coalesce(F.col("html"), F.lit(""))
    moment = F.greatest(F.unix_micros(F.col(captured).cast("timestamp")), F.lit(round((FIRST - EPOCH).total_seconds() + EPOCH.timestamp()) * 10**6)) - int(EPOCH.timestamp()) * 10**6 if captured else F.lit(None).cast("long")
    src = pages.select(F.col("page_id").cast("long").alias("page"), "url", "html", moment.alias("moment"), F.concat(F.sha1(html.cast("binary")), F.lit(":"), F.octet_length(html)).alias("payload"), F.octet_length(html).alias("size"))
    ids = src.where(F.col("size") >= min_revisit).select("page", "payload")
    first = cut(ids.groupBy("payload").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1 and first is not null"))
    later = meet(ids, first, "payload").where(~F.col("page").eqNullSafe(F.col("first"))).select(F.col("page").alias("p"), F.col("payload").alias("s"), "first").distinct()
    joined = src.join(later, F.col("page").eqNullSafe(F.col("p")) & (F.col("payload") == F.col("s")), "left")
    return cut(joined.select("page", "url", "html", "moment", "first").mapInArrow(_writer(folder, RUN_ROWS), _FILES))


def _merge_some(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = f"{folder}/merge-{level}-{group:06d}-{TaskContext.get().taskAttemptId()}.cdx"
                yield _manifest([(group, 0, None, name, _write_run(name, iter(LoserTree([_run_rows(r) for r in runs]))))])

    return run


def _sample(samples: int):
    """Captures at even distances of a run: URL key, timestamp, page and the rows that each stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_shared(uri, "rb") as f:
                    size = f.seek(0, 2)
                    found = [_key(line) for i in range(samples) if (line := _line_after(f, size * i // samples))]
                rows += [(key, moment, page[1], page[0], n / len(found)) for key, moment, page in found]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["url_key", "timestamp", "page", "no_page", "rows"])

    return run


def _bounds(files: DataFrame, parts: int) -> list[tuple]:
    """Captures that cut all of them into about equal ranges: at most ``parts`` - 1 of at most FAN_IN * SAMPLES sampled ones."""
    kinds = "url_key string, timestamp string, page long, no_page boolean, rows double"
    rows = sorted(((r[0], r[1], (r[3], r[2])), r[4]) for r in files.select("run", "n").mapInArrow(_sample(SAMPLES), kinds).collect())
    total, seen, cuts = sum(n for _, n in rows), 0.0, []
    for key, n in rows:
        if seen >= total * (len(cuts) + 1) / parts and (not cuts or key > cuts[-1]):
            cuts.append(key)
        seen += n
    return cuts


def _merge_range(runs: list[str]):
    """Merges the captures of a range out of all runs, and counts those of each URL key within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lo, hi in zip(*(c.to_pylist() for c in batch.columns[:3])):
                lo, hi = (None if x is None else (x["key"], x["moment"], (x["no_page"], x["page"])) for x in (lo, hi))
                rows: list[list] = []
                place, number, last = 0, 0, None

                def out():
                    cols = list(zip(*rows))
                    ints = [pa.array([None if v == "-" else int(v) for v in cols[i]], pa.int64()) for i in (2, 5, 6, 7)]
                    return pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(rows), pa.int32()), pa.array(range(place - len(rows), place), pa.int64()), pa.array(cols[8], pa.int64()), pa.array(cols[0]), pa.array(cols[1]), ints[0], pa.array(cols[3]), pa.array(cols[4]), ints[1], ints[2], ints[3]],
                        names=["part", "place", "number", "url_key", "timestamp", "page_id", "record_type", "digest", "task", "at", "length"],
                    )

                for key, line in LoserTree([_run_rows(u, lo, hi) for u in runs]):
                    number = number + 1 if key[0] == last else 1
                    last = key[0]
                    rows.append([*line.rstrip("\n").split("\t"), number])
                    place += 1
                    if len(rows) == 5000:
                        yield out()
                        rows.clear()
                if rows:
                    yield out()

    return run


_HISTORY = "part int, place long, number long, url_key string, timestamp string, page_id long, record_type string, digest string, task long, at long, length long"
_BOUND = "struct<key:string,moment:string,no_page:boolean,page:long>"


def merge_index(files: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """The capture histories in global order of (part, place): number, url_key, timestamp, page_id, record_type, digest, task, at, length.

    number: the capture's place, from 1, among all of its URL key.
    """
    spark = files.sparkSession
    level = 0
    while True:
        count, captures, seqs = files.agg(F.count(F.lit(1)), F.sum("n"), F.max("seq")).first()
        if count <= FAN_IN:
            break
        group = F.floor((F.col("task").cast("long") * (seqs + 1) + F.col("seq")) / FAN_IN).cast("int")
        grouped = files.groupBy(group.alias("g")).agg(F.sort_array(F.collect_list("run")).alias("runs"))
        files = cut(grouped.mapInArrow(_merge_some(folder, level), _FILES))
        level += 1
    runs = [r["run"] for r in files.select("run").collect()]  # at most FAN_IN names
    parts = parts or min(MAX_PARTS, -(-(captures or 0) // PART_ROWS) or 1)
    cuts = [(key, moment, *page) for key, moment, page in _bounds(files, parts)] if parts > 1 else []
    ranges = list(zip(range(len(cuts) + 1), [None, *cuts], [*cuts, None]))
    table = spark.createDataFrame(ranges, f"part int, lo {_BOUND}, hi {_BOUND}").repartition(len(ranges), "part")
    merged = cut(table.mapInArrow(_merge_range(runs), _HISTORY))
    ends = merged.groupBy("part").agg(F.min("url_key").alias("first"), F.max(F.struct("place", "url_key", "number")).alias("end")).orderBy("part").collect()  # at most MAX_PARTS
    carried, before, number = [], None, 0
    for r in ends:
        same = r["first"] == before
        carried.append((r["part"], r["first"], number if same else 0))
        before, number = r["end"]["url_key"], r["end"]["number"] + (number if same and r["end"]["url_key"] == r["first"] else 0)
    over = F.broadcast(spark.createDataFrame(carried, "of int, key string, over long"))
    joined = merged.join(over, (F.col("part") == F.col("of")) & (F.col("url_key") == F.col("key")), "left")
    return joined.withColumn("number", F.col("number") + F.coalesce("over", F.lit(0))).drop("of", "key", "over")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for task, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows: list[tuple] = []

            def out():
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "task"])

            with open_shared(uri, "rb") as f:
                for raw in members(f):
                    fields, block = parse(raw)
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{uri}: payload of {fields['WARC-Record-ID']} differs from its digest")
                    ids = [None if (v := fields.get(k, f"<{_URN}->")[len(_URN) + 1 : -1]) == "-" else int(v) for k in ("WARC-Record-ID", "WARC-Refers-To")]
                    rows.append((ids[0], int(http["Content-Length"]), digest, kind, ids[1], task))
                    if len(rows) == 5000:
                        yield out()
                        rows.clear()
            if rows:
                yield out()


def read_archives(files: DataFrame) -> DataFrame:
    """Every record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, task."""
    files = files.where("warc is not null")
    n = max(1, files.count())
    return files.select("task", "warc").repartition(n, "task").mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, task long")
