"""WARC archives with revisit records, and their capture index by external merge.

Tasks write gzip-compressed archives to the shared folder. Reading an archive back
gives its records as a run sorted by URL key and timestamp. Runs are cut at common
range bounds, and each range merges its pieces of all runs with a loser tree: range
after range, the index is in global order, so the captures of a URL stand together
in time order, also where one URL's history spans several ranges.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import new_table_path, open_store, query, small_batches, table, written

EPOCH = dt.datetime(2024, 1, 1)
# Columns of a capture, as read from the archives.
CAPTURE = (
    "url_key string, captured string, page_id long, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, file string, offset long"
)
ORDER = ["url_key", "captured", "page_id"]


def url_key(url: str | None) -> str:
    """Sortable key: host labels reversed and comma-joined, then path and query."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host = parts.hostname or ""
    except ValueError:
        return (url or "").strip().lower()
    host = host.removeprefix("www.")
    path = parts.path.rstrip("/") or "/"
    return ",".join(reversed(host.split("."))) + ")" + path + (f"?{parts.query}" if parts.query else "")


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def _record(page_id, url, payload: bytes, digest: str, response_id, is_response: bool) -> bytes:
    name = "null" if page_id is None else str(page_id)
    try:
        captured = EPOCH + dt.timedelta(seconds=page_id or 0)
    except OverflowError:
        captured = EPOCH
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if is_response else http
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'response' if is_response else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {captured.isoformat(timespec='seconds')}Z",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if not is_response:
        headers += [
            f"WARC-Refers-To: <urn:page:{response_id}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    headers += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write one record per page; returns (file, records) of the archives in a shared folder.

    Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the
    largest page_id is a response and the others are revisits of it; rows that repeat
    that page_id are responses too. A NULL html is an empty payload. A NULL page_id is
    smaller than all others; where a group has no other, its rows are all responses.
    Rows of one payload are joined to their one response by digest; adaptive execution
    splits the join where one payload holds much of the table.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = new_table_path(spark, "warc")
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
    )
    firsts = rows.groupBy("digest").agg(F.max("page_id").alias("response_id"))
    rows = rows.join(firsts, "digest")

    def write(batches):
        part = TaskContext.get()
        name = f"part-{part.partitionId():06d}.warc.gz"
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        draft, count = f"{path}/_{name}.{part.taskAttemptId()}", 0
        with store.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for row in batch.itertuples():
                    page_id = None if pd.isna(row.page_id) else int(row.page_id)
                    response_id = None if pd.isna(row.response_id) else int(row.response_id)
                    payload = row.html.encode()
                    digest = base64.b32encode(bytes.fromhex(row.digest)).decode()
                    is_response = len(payload) < min_bytes or page_id == response_id
                    record = _record(page_id, row.url, payload, digest, response_id, is_response)
                    out.write(gzip.compress(record, 4, mtime=0))
                    count += 1
        store.move(draft, f"{path}/{name}")  # a task that runs again puts the same records there
        yield pd.DataFrame({"file": [f"{folder}/{name}"], "records": [count]})

    return written(rows.mapInPandas(write, "file string, records long"), "archives")


def read_archive(uri: str) -> Iterator[tuple]:
    """Captures of one archive in file order, payload digests recomputed from responses."""
    store, path = open_store(uri)
    with store.open_input_stream(path, compression=None) as raw:
        data, offset, base = b"", 0, 0
        while True:
            if not data:
                data = raw.read(1 << 20)
                if not data:
                    return
            member, parts = zlib.decompressobj(31), []
            while not member.eof:
                parts.append(member.decompress(data))
                base += len(data) - len(member.unused_data)
                data = member.unused_data
                if not member.eof:
                    data = raw.read(1 << 20)
                    if not data:
                        raise OSError(f"{uri} ends inside a record")
            yield _capture(b"".join(parts), uri, offset)
            offset = base


def _capture(record: bytes, uri: str, offset: int) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    number = lambda name: None if (n := name.removeprefix("<urn:page:").rstrip(">")) == "null" else int(n)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    length = int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        seen = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if seen != digest or len(payload) != length:
            raise OSError(f"{uri} at {offset}: payload does not match its digest")
    refers = fields.get("WARC-Refers-To")
    return (
        url_key(fields.get("WARC-Target-URI")), fields["WARC-Date"], number(fields["WARC-Record-ID"]),
        fields["WARC-Type"], number(refers) if refers else None, length, digest, uri, offset,
    )


class LoserTree:
    """Merge of sequences of (key, value) sorted by key: nodes hold losers, the winner comes out."""

    def __init__(self, runs: Sequence[Sequence[tuple]]):
        self.values = [None] * len(runs)
        self.iterators = [iter(run) for run in runs]
        self.heads = [self._next(i) for i in range(len(runs))]
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        for i in range(len(runs)):
            self._play(i)

    def _next(self, i: int):
        # An exhausted run loses against all others; the run number breaks ties.
        item = next(self.iterators[i], None)
        if item is None:
            return (1,)
        self.values[i] = item[1]
        return (0, item[0], i)

    def _play(self, i: int) -> None:
        node = (i + self.size) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self.heads[other] < self.heads[i]:
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.heads and self.heads[self.losers[0]][0] == 0:
            i = self.losers[0]
            yield self.values[i]
            self.heads[i] = self._next(i)
            self._play(i)


def capture_index(archives: DataFrame) -> DataFrame:
    """All captures of the archives in global order of URL key, timestamp and page.

    Each archive is read by one task, which sorts its captures into a run; a range task
    merges its pieces of the runs. Ranges are bounded by key, timestamp and page, so a
    URL with a third of all captures is spread over ranges.
    """
    fields = [f.split(" ")[0] for f in CAPTURE.split(", ")]

    def runs(batches):
        for batch in batches:
            for uri in batch["file"]:
                run = sorted(read_archive(uri), key=_key)
                frame = pd.DataFrame(run, columns=fields)
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    def merge(batches):
        # Rows come sorted by run and then in run order.
        pieces: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                pieces.setdefault(row[7], []).append((_key(row), row))
        merged = list(LoserTree(list(pieces.values())))
        frame = pd.DataFrame(merged, columns=fields)
        yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    # The number is given, as otherwise so short a list would go to one task.
    files = archives.select("file").repartition(max(1, archives.count()), "file")
    sorted_runs = written(files.mapInPandas(runs, CAPTURE), "runs")
    ranges = sorted_runs.repartitionByRange(*ORDER).sortWithinPartitions("file", *ORDER, "offset")
    return ranges.mapInPandas(merge, CAPTURE)


def _key(row: tuple):
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[8])


@query("op8_warc")
def op8_warc(spark, folder):
    """Captures of all pages, read back from the archives in index order."""
    archives = write_archives(table(spark, folder, "pages").select("page_id", "url", "html"))
    return capture_index(archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured"
    )
