"""Operator 12: WARC archives with revisit records, and their index by external merge.

Every page becomes a record of its own gzip member. Of records with equal payloads the one with the
largest key is a ``response`` that holds the payload; the others are ``revisit`` records that hold the
HTTP header and refer to it. Records are packed into archives of bounded size, a file each.

The archives are then read back, member by member, and every payload is checked against its digest.
A capture history lists captures by URL key and time. It is built like an external merge sort:
the entries of one archive, sorted where they are read, are a run; runs are stored; ranges
of (URL key, time, record id), chosen so that a range has a bounded number of entries even if one URL holds most
of them, each take their stretch of every run, and a tree of losers merges the stretches, one
comparison a level for each entry. Ranges in order give the whole index in order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.llm.common import materialize, ship

#: Ends an archive file: a gzip member without content, as the text writer ends every line with it.
END_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
ARCHIVE_BYTES = 4_000_000
#: Entries of one range of the index, about.
RANGE_ENTRIES = 100_000
FIRST_DATE = datetime(2024, 1, 1, tzinfo=timezone.utc)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DEFAULT_PORTS = {"http": 80, "https": 443}


def url_key(url: str | None) -> str:
    """The URL as captures are sorted: host labels from the last to the first, then path and sorted query, in lower case.

    Scheme, a leading ``www``, the usual port, user and fragment do not count. What is no URL is its own key.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    labels = re.sub(r"^www\d*\.", "", host).split(".")[::-1]
    at = "" if port in (None, DEFAULT_PORTS.get(parts.scheme.lower())) else f":{port}"
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return (",".join(labels) + at + ")" + (parts.path or "/") + ("?" + query if query else "")).lower()


def _field(value: str) -> str:
    """A header value on one line: per cent signs, spaces and control characters written as %HH."""
    return re.sub(r"[\x00-\x20\x7f-\x9f%]", lambda m: quote(m.group(), safe=""), value)


def _address(url: str) -> str:
    """A URL on one line; what is written as %HH already stays."""
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: quote(m.group(), safe=""), url)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(fields: dict[str, str | None], block: bytes) -> bytes:
    head = ["WARC/1.1", *(f"{name}: {value}" for name, value in fields.items() if value is not None), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _response(record: str, key: str | None, url: str | None, at: str, digest: str, payload: bytes) -> bytes:
    return _member(
        {
            "WARC-Type": "response",
            "WARC-Record-ID": f"<{record}>",
            "WARC-Date": at,
            "WARC-Target-URI": None if url is None else _address(url),
            "WARC-Payload-Digest": f"sha1:{digest}",
            "X-Record-Key": None if key is None else _field(key),
            "Content-Type": "application/http;msgtype=response",
        },
        _http(len(payload)) + payload,
    )


def _revisit(row: dict) -> bytes:
    of = row["leader"]
    return _member(
        {
            "WARC-Type": "revisit",
            "WARC-Profile": REVISIT_PROFILE,
            "WARC-Record-ID": f"<{row['record']}>",
            "WARC-Date": row["at"],
            "WARC-Target-URI": None if row["url"] is None else _address(row["url"]),
            "WARC-Payload-Digest": f"sha1:{row['digest']}",
            "WARC-Refers-To": f"<{of['record']}>",
            "WARC-Refers-To-Target-URI": None if of["url"] is None else _address(of["url"]),
            "WARC-Refers-To-Date": of["at"],
            "X-Record-Key": None if row["key"] is None else _field(row["key"]),
            "X-Refers-To-Key": None if of["key"] is None else _field(of["key"]),
            "Content-Type": "application/http;msgtype=response",
        },
        _http(row["n_bytes"]),
    )


def _responses(pages: DataFrame) -> DataFrame:
    """Every page as a response record, with its digest, length, time and a record id."""
    schema = T.StructType([
        T.StructField("record", T.StringType()), T.StructField("key", T.StringType()), T.StructField("rank", pages.schema["rank"].dataType), T.StructField("url", T.StringType()),
        T.StructField("at", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("member", T.BinaryType()),
    ])

    def made(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            rank, held, size, first = batch.column(0), [], 0, 0
            for i in range(batch.num_rows):
                key, url, at, payload = (batch.column(c)[i].as_py() for c in range(1, 5))
                payload = payload or b""
                digest = payload_digest(payload)
                record = uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([part, number, key, url, digest])).urn
                number += 1
                held.append((record, key, url, at, digest, len(payload), _response(record, key, url, at, digest, payload)))
                size += len(held[-1][-1])
                if size >= ARCHIVE_BYTES or i + 1 == batch.num_rows:
                    columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.string(),) * 5 + (pa.int64(), pa.binary()), strict=True)]
                    columns.insert(2, rank.slice(first, len(held)))
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                    held, size, first = [], 0, i + 1

    return pages.select("rank", "key", "url", "at", "payload").mapInArrow(made, schema)


def write_archives(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", payload: str = "html", captured: str | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages`` into the archives under ``out``.

    ``captured`` names a timestamp column; without it the whole-number key gives seconds after a fixed first date.
    Records with equal payloads of at least ``least_bytes`` bytes refer to the one with the largest key; no
    payload is an empty one. Rows with equal or without keys are records of their own.
    """
    spark = pages.sparkSession
    ship(spark)
    date = F.date_format(F.to_utc_timestamp(F.col(captured).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if captured else None
    if date is None:
        seconds = F.coalesce(F.expr(f"try_cast(`{key}` AS BIGINT)"), F.lit(0)) + int(FIRST_DATE.timestamp())
        date = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    first = FIRST_DATE.strftime("%Y-%m-%dT%H:%M:%SZ")
    plain = pages.select(F.col(key).alias("rank"), F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(date, F.lit(first)).alias("at"), F.col(payload).cast("binary").alias("payload"))
    records = materialize(_responses(plain), "records")
    # groups of equal payloads: only their small columns are grouped, and a large group is one row a task
    small = records.drop("member").where(F.col("n_bytes") >= least_bytes)
    leaders = small.groupBy("digest", "n_bytes").agg(F.max(F.struct("rank", "record", "key", "url", "at")).alias("leader"), F.count("*").alias("n")).where(F.col("n") > 1)
    revisits = small.select("record", "digest", "n_bytes").join(leaders, ["digest", "n_bytes"]).where(F.col("record") != F.col("leader.record"))
    # written first, so that its size is known: the members are shuffled only where there are many revisits
    chosen = materialize(revisits.select("record", F.struct("leader.record", "leader.key", "leader.url", "leader.at").alias("leader")), "revisits")
    dealt = records.select("record", "key", "url", "at", "digest", "n_bytes", "member").join(chosen, "record", "left")
    # a revisit carries no payload on
    dealt = dealt.withColumn("member", F.when(F.col("leader").isNull(), F.col("member")))

    def packed(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):  # one row at a time: a batch may be large
                leader = batch.column("leader")[i].as_py()
                row = batch.slice(i, 1).to_pylist()[0] if leader else {}
                held.append(_revisit(row) if leader else batch.column("member")[i].as_py())
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    archives = dealt.mapInArrow(packed, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("lineSep", END_MEMBER).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(out)


def _members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member."""
    view, at = memoryview(content), 0
    while at < len(view):
        stream, fed, out = zlib.decompressobj(wbits=31), at, []
        while not stream.eof and fed < len(view):
            piece = view[fed : fed + 65_536]
            out.append(stream.decompress(piece))
            fed += len(piece)
        if not stream.eof:
            raise ValueError("an archive ends within a record")
        end = fed - len(stream.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is not as long as it says")
    return fields, rest[:size]


ENTRY = "url_key string, at string, record string, type string, key string, refers_to string, payload_digest string, payload_bytes long, url string, archive string, offset long, length long"


def _entry(fields: dict[str, str], block: bytes, archive: str, offset: int, length: int) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    http = {n.lower(): v.strip() for n, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    size = int(http["content-length"])
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"{archive}: the payload at {offset} is not the one that was written")
    key, of = fields.get("x-record-key"), fields.get("x-refers-to-key")
    url = fields.get("warc-target-uri")
    return (
        url_key(url), fields["warc-date"], fields["warc-record-id"].strip("<>"), kind, None if key is None else unquote(key), None if of is None else unquote(of), digest, size, url, archive, offset, length,
    )


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all archives under ``path``: one run an archive, sorted by URL key, time and record id."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                archive = batch.column(0)[i].as_py().rsplit("/", 1)[-1]
                entries = [_entry(*parse_record(raw), archive, at, length) for at, length, raw in _members(batch.column(1)[i].as_py()) if raw]
                entries.sort(key=lambda e: e[:3])
                columns = list(zip(*entries, strict=True)) if entries else [()] * 12
                kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(range(len(entries)), pa.int64())], names=[*(x.split()[0] for x in ENTRY.split(", ")), "seq"])

    return files.mapInArrow(read, ENTRY + ", seq long")


def merged(runs: list[list]) -> Iterator[tuple[int, int]]:
    """(run, place) of all keys of sorted ``runs`` in order, by a tree of losers; equal keys by run.

    An inner node keeps the loser of the match below it, so that after the winner has moved on, only
    the matches on its own way to the root are played again.
    """
    k = len(runs)
    place = [0] * k
    head = [run[0] if run else None for run in runs]

    def before(x: int, y: int) -> bool:
        if head[x] is None or head[y] is None:
            return head[y] is None and (head[x] is not None or x < y)
        return (head[x], x) < (head[y], y)

    loser, up = [0] * k, [0] * k + list(range(k))  # ``up``: winners while the tree is built; leaves are k to 2k - 1
    for node in range(k - 1, 0, -1):
        x, y = up[2 * node], up[2 * node + 1]
        up[node], loser[node] = (x, y) if before(x, y) else (y, x)
    winner = up[1] if k else 0
    while k and head[winner] is not None:
        yield winner, place[winner]
        place[winner] += 1
        head[winner] = runs[winner][place[winner]] if place[winner] < len(runs[winner]) else None
        node = (winner + k) // 2
        while node:
            if before(loser[node], winner):
                winner, loser[node] = loser[node], winner
            node //= 2


def merge_runs(runs: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """All entries in the order of URL key, time and record id: ``part`` numbers the ranges, ``place`` the entries of one.

    ``runs`` should be a stored table. Ranges follow the whole sort key, so one URL with most of the captures is many ranges.
    """
    entries = runs.count()
    ranges = max(1, -(-entries // range_entries))
    schema = T.StructType([*(f for f in runs.schema.fields if f.name != "seq"), T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])

    def merge(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        stretches: dict[str, list] = {}
        columns = [table.column(c).to_pylist() for c in ("archive", "seq", "url_key", "at", "record")]
        for row, (archive, seq, *key) in enumerate(zip(*columns, strict=True)):
            stretches.setdefault(archive, []).append((tuple(key), seq, row))
        # rows of a run come in its order; a shuffle does not promise it, so it is looked at
        lists = [s if all(x[1] < y[1] for x, y in zip(s, s[1:])) else sorted(s, key=lambda x: x[1]) for _, s in sorted(stretches.items())]
        order = [lists[run][place][2] for run, place in merged([[x[0] for x in s] for s in lists])]
        part = TaskContext.get().partitionId()
        out = table.drop_columns(["seq"]).take(order)
        out = out.append_column("part", pa.array([part] * len(order), pa.int32())).append_column("place", pa.array(range(len(order)), pa.int64()))
        yield from out.to_batches(max_chunksize=10_000)

    return runs.repartitionByRange(ranges, "url_key", "at", "record").mapInArrow(merge, schema)


def capture_history(pages: DataFrame, out: str, key: str = "page_id", **writing) -> DataFrame:
    """Archives of ``pages`` under ``out``/archives, and the index read back from them, ``out``/index, in order.

    Columns: ``key`` (of the type of the key column), ``record_type``, ``refers_to`` (the response's key for revisits),
    ``payload_digest`` and ``payload_bytes`` of the full payload, ``url_key``, ``at``, ``url``, ``archive``, ``offset``,
    ``length`` (of the record's gzip member), and ``part``, ``place``: the order of the index.

    No payload is an empty one; no URL has the key ``""`` and comes first; no key stays none and is smaller than any.
    Equal rows are records of their own, of which one is the response. Other columns are not read. An
    empty table gives no archive and no rows.
    """
    spark = pages.sparkSession
    kind = pages.schema[key].dataType
    write_archives(pages, f"{out}/archives", key, **writing)
    runs = materialize(capture_runs(spark, f"{out}/archives"), "capture_runs")
    index = merge_runs(runs).select(
        F.col("key").cast(kind).alias("key"), F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"), "payload_digest", "payload_bytes",
        "url_key", "at", "url", "record", "archive", "offset", "length", "part", "place",
    )
    index.write.parquet(f"{out}/index")
    return spark.read.schema(index.schema).parquet(f"{out}/index")


def captures_of(index: DataFrame, url: str) -> DataFrame:
    """The history of one URL; files of the index whose range of keys does not reach it are not read."""
    return index.where(F.col("url_key") == url_key(url)).orderBy("part", "place")

