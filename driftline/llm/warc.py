"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by their key, so each task holds one stretch of keys. A task rolls to a new file when the
compressed bytes reach a limit, and writes under a temporary name that carries a fresh id; a table of what each
finished task wrote is stored in the shared folder, and only files named there are renamed and listed in the
manifest. A task that runs twice, or dies half-way, thus leaves nothing but a temporary file, which the commit
removes. Headers and digests are made anew from the payload. File systems are reached through their URI (pyarrow),
so executors need no common local disk.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import shared_dir

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

MANIFEST_SCHEMA = "temp string, name string, records long, bytes long, sha256 string"
READ_SCHEMA = "key long, url string, date string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, block_ok boolean"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def _one_line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: response with the payload, or revisit of another key with the HTTP head alone."""
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = uuid.uuid5(NAMESPACE, f"{key}\0{url}\0{digest}")
    head = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_one_line(url)}"] if url is not None else []
    head += [f"X-Record-Key: {key}"] if key is not None else []
    head += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Key: {refers_to}"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    """A gzip member without time or name, so equal records give equal bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _writer(base: str, date: str, roll_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        store, root = _uri_fs(base)
        part, run = TaskContext.get().partitionId(), uuid.uuid4().hex
        done: list[tuple[str, str, int, int, str]] = []
        out = sha = None
        size = count = 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((temp, name, count, size, sha.hexdigest()))
                out = None

        known: tuple[int | None, bytes] | None = None
        refers: int | None = None
        for b in batches:
            for raw_key, url, html, to, sha1, kind in zip(b["_key"], b["_url"], b["_body"], b["_refers"], b["_sha"], b["_kind"], strict=True):
                key = None if raw_key is None else int(raw_key)
                if kind == 0:
                    known, refers = (key, bytes(sha1)), int(to)
                    continue
                if out is None:
                    name = f"part-{part:05d}-{len(done):05d}.warc.gz"
                    temp = f"_temporary/{run}-{name}"
                    out, sha, size, count = store.open_output_stream(f"{root}/{temp}", compression=None), hashlib.sha256(), 0, 0
                data = _gzip(record(key, url, bytes(html), refers if known == (key, bytes(sha1)) else None, date))
                out.write(data)
                sha.update(data)
                size, count = size + len(data), count + 1
                if size >= roll_bytes:
                    close()
        close()
        yield pd.DataFrame(done, columns=["temp", "name", "records", "bytes", "sha256"])

    return write


def write_warc(
    pages: DataFrame,
    base: str | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "2000-01-01T00:00:00Z",
    min_payload: int = 0,
    roll_bytes: int = 16 << 20,
) -> tuple[str, DataFrame]:
    """Write every row as a record; returns the archive folder's URI and its manifest (``name, records, bytes, sha256``).

    Of records with equal payloads of at least ``min_payload`` bytes that with the smallest key is a response and
    others are revisits of it; rows that repeat that smallest key are all responses. Null html is the empty payload,
    a null url writes no target, a null key writes no key and never serves as the response if another key exists;
    payloads that only null keys have are all responses. An empty table gives an archive without files.
    Other columns are not archived.
    """
    spark = pages.sparkSession
    base = base or f"{shared_dir(spark)}/warc"
    body = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("_key"), F.col(url).cast("string").alias("_url"), body.alias("_body")).withColumn("_sha", F.unhex(F.sha1("_body")))
    first = rows.filter(F.length("_body") >= min_payload).groupBy("_sha").agg(F.min("_key").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 and _first is not null").select("_sha", "_first")
    # the digest columns alone meet the first keys; payloads move once, by the range sort, and meet what they refer to in the writer
    refers = rows.select("_key", "_sha").join(first, "_sha").filter("_key is null or _key != _first").select("_key", "_sha", F.col("_first").alias("_refers")).distinct()
    records = rows.withColumns({"_kind": F.lit(1), "_refers": F.lit(None).cast("long")})
    merged = records.unionByName(refers.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    store, root = _uri_fs(base)
    store.create_dir(f"{root}/_temporary", recursive=True)
    ordered = merged.repartitionByRange(n, "_key", "_sha").sortWithinPartitions("_key", "_sha", "_kind", "_url")
    # pandas reads integers with nulls among them as floats: keys travel as text
    rows = ordered.select(F.col("_key").cast("string").alias("_key"), "_url", "_body", F.col("_refers").cast("string").alias("_refers"), "_sha", "_kind")
    parts = rows.mapInPandas(_writer(base, date, roll_bytes), MANIFEST_SCHEMA)
    parts.write.parquet(f"{base}/_manifest.parquet")
    return base, commit_warc(spark, base)


def commit_warc(spark: SparkSession, base: str) -> DataFrame:
    """Give the files of the stored task table their names; may be repeated after a failure at any point."""
    table = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{base}/_manifest.parquet")
    store, root = _uri_fs(base)
    names = []
    # one row for each file of at least roll_bytes, not for each record
    for row in table.orderBy("name").toLocalIterator():
        if store.get_file_info(f"{root}/{row.temp}").type == fs.FileType.File:
            store.move(f"{root}/{row.temp}", f"{root}/{row.name}")
        if store.get_file_info(f"{root}/{row.name}").size != row.bytes:
            raise RuntimeError(f"archive file {row.name} is missing or incomplete")
        names.append({"name": row.name, "records": row.records, "bytes": row.bytes, "sha256": row.sha256})
    with store.open_output_stream(f"{root}/_temporary/MANIFEST.json") as out:
        out.write(json.dumps(names).encode())
    store.move(f"{root}/_temporary/MANIFEST.json", f"{root}/MANIFEST.json")
    store.delete_dir(f"{root}/_temporary")
    return table.select("name", "records", "bytes", "sha256")


def parse_warc(stream, chunk: int = 1 << 20) -> Iterator[tuple]:
    """Rows of ``READ_SCHEMA`` from a stream of gzip members, one member in memory at a time."""
    held, data, member = b"", b"", zlib.decompressobj(31)
    while True:
        got = held or stream.read(chunk)
        held = b""
        if not got:
            if data:
                raise ValueError("the archive ends inside a record")
            return
        data += member.decompress(got)
        if not member.eof:
            continue
        held, member = member.unused_data, zlib.decompressobj(31)
        head, _, rest = data.partition(b"\r\n\r\n")
        data = b""
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        full = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        revisit = fields["WARC-Type"] == "revisit"
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        ok = fields["WARC-Block-Digest"] == "sha1:" + sha1_base32(block) and (revisit or (sha1_base32(payload) == digest and len(payload) == full))
        number = lambda name: int(fields[name]) if name in fields else None  # noqa: B023, E731
        target = _unline(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
        yield (number("X-Record-Key"), target, fields["WARC-Date"], fields["WARC-Type"], number("X-Refers-To-Key"), full, digest, None if revisit else payload, ok)


def read_warc(spark: SparkSession, base: str, manifest: DataFrame, rows: int = 256) -> DataFrame:
    """All records of the files in the manifest, as ``READ_SCHEMA``; ``block_ok`` tells whether the digests hold."""
    names = READ_SCHEMA.replace(",", "").split()[::2]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _uri_fs(base)
        for b in batches:
            for name in b["name"]:
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    held: list[tuple] = []
                    for r in parse_warc(stream):
                        held.append(r)
                        if len(held) >= rows:
                            yield _frame(held, names)
                            held = []
                    yield _frame(held, names)

    files = manifest.select("name").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "name")
    return files.mapInPandas(load, READ_SCHEMA)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=names, dtype=object)
    df = df.assign(**{name: pd.array([r[names.index(name)] for r in rows], "Int64") for name in ("key", "refers_to")})
    return df.astype({"payload_bytes": "int64", "block_ok": "bool"})
