"""WARC archives with a globally ordered capture index.

Writing.  Payloads are digested in the JVM; of equal payloads of at least
``revisit_bytes`` the capture with the largest id is the response and the others
revisit it.  The digests that occur twice are broadcast up to 2**18 of them, so
that payloads stay where they are, and joined by a shuffle beyond.  Each task writes its rows as one archive, a gzip member a record,
and returns a run of index rows sorted by (URL key, timestamp, id).

Index merge.  The runs are dealt out by range, and each range is produced by an
external k-way merge: rows that arrive are cut into sorted runs, runs beyond
``RUN_ROWS`` rows in memory go to a local temporary file that is deleted on
the way out, and a loser tree merges them.  A range's rows leave in order, and
the ranges follow each other, so the whole is the ordered capture history.  The
ranges are cut on the full key, so one URL with a third of all captures still
spreads over many ranges.

Reading follows the index: a block of index rows is read from the archives in
file order and returned in index order, each payload checked against its digest.

Archives go to the shared folder by a name that no other attempt uses, and the
index is settled at once, so a lost executor leaves orphans but no wrong rows.

Defined cases: a null payload is empty, a null URL is the empty URL, a null id
is written as ``null`` and read back as null; captures that share the largest
id of their group are all responses; without any id in a group all are
responses; an empty table gives no archive and no rows; a payload of any size
is held by one task at a time; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import fresh_folder, sent, settle

#: Captures carry no time of their own; they are dated one second apart from here, by id.
FIRST_DATE = datetime(2024, 1, 1, tzinfo=UTC)
RUN_ROWS = 100_000
READ_ROWS = 256
INDEX = "url_key string, stamp string, page_id bigint, url string, archive string, offset bigint, length bigint, run string"
RECORD = "url_key string, stamp string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def url_key(url: str | None) -> str:
    """The URL with its host reversed, lower-cased and without ``www.``, default ports, user or fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return (url or "").strip().lower()
    host = host.removeprefix("www.")
    reverse = ",".join(reversed(host.split("."))) if host else ""
    shown = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{reverse}{shown}){(parts.path or '/').lower()}{query.lower()}"


def stamp_of(page_id: int | None) -> str:
    """The 14-digit capture time of an id."""
    try:
        return (FIRST_DATE + timedelta(seconds=page_id or 0)).strftime("%Y%m%d%H%M%S")
    except OverflowError:
        return "99991231235959"


def _date(stamp: str) -> str:
    return f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:]}Z"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with its HTTP head only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {quote(url or '', safe=SAFE)}",
        f"WARC-Date: {_date(stamp_of(page_id))}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head[-2:-2] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_name(refers_to)}",
            f"WARC-Refers-To-Date: {_date(stamp_of(refers_to))}",
        ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


#: Left as they are in a target URI, all that is printable in ASCII.
SAFE = "".join(map(chr, range(33, 127)))


def parse(raw: bytes) -> dict:
    """A record's fields; payload is None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: None if x is None or x == "<urn:page:null>" else int(x.removeprefix("<urn:page:").removesuffix(">"))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


class LoserTree:
    """k-way merge of sorted iterators with one comparison a level for each row taken."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            loser = self.losers[node]
            if loser < 0:  # the tree is being filled: the first to come waits here
                self.losers[node] = winner
                return
            if self._before(loser, winner):
                self.losers[node], winner = winner, loser
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.losers[0]]) is not None:
            yield head
            winner = self.losers[0]
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


def _sort_key(row: dict) -> tuple:
    return row["url_key"], row["stamp"], row["page_id"] is None, row["page_id"] or 0, row["archive"], row["offset"]


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder; ``captures`` names it with its scheme."""
    return pafs.FileSystem.from_uri(f"file://{folder.removeprefix('file:')}" if "://" not in folder else folder)


def _write_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _place(folder)
        name, out, at, rows = f"{uuid.uuid4().hex}.warc.gz", None, 0, []
        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(b.column(k) for k in range(5)), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                page_id, url, payload = page_id.as_py(), url.as_py(), payload.as_py() or b""
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                raw = packer.compress(record(page_id, url, payload, digest.as_py(), refers_to.as_py())) + packer.flush()
                out.write(raw)
                rows.append({"url_key": url_key(url), "stamp": stamp_of(page_id), "page_id": page_id, "url": url, "archive": name, "offset": at, "length": len(raw), "run": name})
                at += len(raw)
        if out is not None:
            out.close()
            rows.sort(key=_sort_key)
            yield from pa.Table.from_pylist(rows, schema=_SCHEMA).to_batches(max_chunksize=10_000)

    return run


_SCHEMA = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in (x.split() for x in INDEX.split(", "))])


def _keyed(rows: list[dict]) -> list[tuple]:
    return [(*_sort_key(r), r["page_id"] is None, tuple(r.values())) for r in rows]


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with tempfile.TemporaryDirectory() as folder:
        runs: list[Iterator[tuple]] = []
        held: dict[str, list[tuple]] = {}
        count = 0

        def spilled(path: str) -> Iterator[tuple]:
            with open(path, "rb") as f:
                while True:
                    try:
                        yield from pickle.load(f)
                    except EOFError:
                        return

        def spill() -> None:
            nonlocal count
            merged = list(LoserTree([iter(sorted(r)) for r in held.values()]))
            path = os.path.join(folder, str(len(runs)))
            with open(path, "wb") as f:
                for k in range(0, len(merged), 1000):
                    pickle.dump(merged[k : k + 1000], f)
            runs.append(spilled(path))
            held.clear()
            count = 0

        for b in batches:
            for row in _keyed(b.to_pylist()):
                held.setdefault(row[-1][-1], []).append(row)
            count += b.num_rows
            if count >= RUN_ROWS:
                spill()
        runs += [iter(sorted(r)) for r in held.values()]
        out: list[dict] = []
        for row in LoserTree(runs):
            out.append(dict(zip(_SCHEMA.names, row[-1], strict=True)))
            if len(out) == 5000:
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` as WARC archives below ``folder``; their index rows, a sorted run for each archive."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    marks = rows.select("page_id", "digest").where(F.octet_length("payload") >= revisit_bytes)
    repeated = marks.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    repeated = settle(repeated.select(F.col("digest").alias("of"), "first"))
    typed = rows.join(sent(repeated, 1 << 18), F.col("digest") == F.col("of"), "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("first").eqNullSafe(F.col("page_id")), None).otherwise(F.col("first")).alias("refers_to")
    )
    return settle(typed.mapInArrow(_write_batches(folder), INDEX))


def merge_index(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The index rows in global order: sorted inside each partition, and the partitions follow each other."""
    key = ["url_key", "stamp", "page_id", "archive", "offset"]
    dealt = runs.repartitionByRange(ranges, *key) if ranges else runs.repartitionByRange(*key)
    return dealt.mapInArrow(_merge_batches, INDEX)


def _read_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _place(folder)
        for b in batches:
            for at in range(0, b.num_rows, READ_ROWS):
                rows = b.slice(at, READ_ROWS).to_pylist()
                found: list[dict | None] = [None] * len(rows)
                name, f = None, None
                for k in sorted(range(len(rows)), key=lambda k: (rows[k]["archive"], rows[k]["offset"])):
                    r = rows[k]
                    if r["archive"] != name:
                        if f:
                            f.close()
                        name, f = r["archive"], fs.open_input_file(f"{base}/{r['archive']}")
                    got = parse(zlib.decompress(f.read_at(r["length"], r["offset"]), 31))
                    if got["page_id"] != r["page_id"]:
                        raise ValueError(f"the index names {r['page_id']}, the archive holds {got['page_id']}")
                    found[k] = {"url_key": r["url_key"], "stamp": r["stamp"], "url": r["url"]} | got
                if f:
                    f.close()
                yield pa.RecordBatch.from_pylist(found, schema=_READ)

    return run


_READ = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in RECORD.split(", "))])


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names, in its order, with payloads (null for revisits)."""
    return index.mapInArrow(_read_batches(folder), RECORD)


def remove_archives(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def captures(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Write ``pages``, merge the index and read back: (records, index, folder)."""
    folder = folder or fresh_folder(pages.sparkSession, "warc")
    index = settle(merge_index(write_archives(pages, folder)))
    return read_archives(index, folder), index, folder
