"""WARC archives on shared storage: a writer with revisit records, and a sequential reader.

Each record is a gzip member of its own. The reader decompresses a file in small steps, takes a record by
its Content-Length, checks block and payload digest (SHA-1, base32) and holds one record at a time, so a file
of any size needs the memory of its largest record. One task writes or reads one file.

Files go through ``pyarrow.fs`` and so to any storage it knows (local and mounted folders, HDFS, object
stores). A task writes beside the final name and renames: a repeated task replaces its own file.

Of records with equal payloads the one with the smallest key is the response, the others revisit it.
Defined results: a null payload is empty; a null key is never referred to and is a response unless an equal
payload has a key; rows that repeat the smallest key are all responses; a null url has no target header;
an empty table gives no records. A digest that does not fit gives ``valid`` = false; broken framing raises.
"""
from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import staged

STEP = 256 << 10
URN = "urn:page:"
# The profile of the standard for revisits by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("path string, record_no bigint, record_type string, record_id string, refers_to string, target_uri string, "
          "payload_bytes bigint, payload_digest string, valid boolean, payload binary")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def record_bytes(key, url: str | None, payload: bytes, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record, not yet compressed; a revisit keeps the HTTP head and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<{URN}{'' if key is None else key}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", PROFILE), ("WARC-Truncated", "length")]
    fields += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
               ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
               ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def find_revisits(df: DataFrame, key: str, payload: str, at_least: int = 0, salts: int = 16) -> DataFrame:
    """``_key, _sha, _first`` of each row that repeats the payload of a smaller key. A payload that fills a third
    of the table is dealt over ``salts`` tasks; only digests travel."""
    body = F.coalesce(F.col(payload), F.lit(""))
    light = df.where(F.octet_length(body) >= at_least).select(F.col(key).alias("_key"), F.sha1(body).alias("_sha"))
    firsts = light.groupBy("_sha").agg(F.min("_key").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    firsts = firsts.select("_sha", "_first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    light = light.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int"))
    return (light.join(firsts, ["_sha", "_salt"]).where("_first is not null and not (_key <=> _first)")
            .select("_key", "_sha", "_first").distinct())


def write_archives(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   at_least: int = 0) -> DataFrame:
    """Write every row as a record; returns the manifest ``file, records, bytes`` (also stored beside them)."""
    revisits = staged(find_revisits(df, key, payload, at_least), "warc-revisits")
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"))
    rows = (rows.join(revisits, rows["key"].eqNullSafe(revisits["_key"]) & (F.sha1("payload") == revisits["_sha"]), "left")
            .select("key", "url", F.col("payload").cast("binary").alias("payload"), F.col("_first").alias("refers_to")))

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = _open_fs(path)
        name = f"part-{context.partitionId():05d}.warc.gz"
        store.create_dir(root, recursive=True)
        trial = f"{root}/_attempt-{context.taskAttemptId()}-{name}"
        records = size = 0
        with store.open_output_stream(trial, compression=None) as out:
            for batch in it:
                for row in zip(*(batch.column(i) for i in range(4))):
                    k, u, p, r = (v.as_py() for v in row)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(record_bytes(k, u, p, r)) + packer.flush()
                    out.write(data)
                    records, size = records + 1, size + len(data)
        if records:
            store.move(trial, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "records": [records], "bytes": [size]})
        else:
            store.delete_file(trial)

    manifest = rows.mapInArrow(write, "file string, records bigint, bytes bigint")
    return staged(manifest, "warc-manifest")


class Records:
    """The records of one archive, one after the other."""

    def __init__(self, stream):
        self.stream, self.raw = stream, b""

    def _members(self) -> Iterator[Iterator[bytes]]:
        """For each gzip member its data in steps."""
        while self.raw or (data := self.stream.read(STEP)):
            if not self.raw:
                self.raw = data
            yield self._steps()

    def _steps(self) -> Iterator[bytes]:
        unpack = zlib.decompressobj(31)
        while True:
            data, self.raw = self.raw or self.stream.read(STEP), b""
            if not data:
                raise ValueError("archive ends within a record")
            while data:
                yield unpack.decompress(data, STEP)
                data = unpack.unconsumed_tail
                if unpack.eof:
                    self.raw = unpack.unused_data
                    return
            if unpack.eof:
                return

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for steps in self._members():
            got = bytearray()
            for data in steps:
                got += data
                if (end := got.find(b"\r\n\r\n")) >= 0:
                    break
            else:
                raise ValueError("record without an end of its head")
            lines = bytes(got[:end]).decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(head["content-length"])
            del got[:end + 4]
            for data in steps:
                got += data
                if len(got) > size + 4:
                    break
            if len(got) != size + 4 or got[size:] != b"\r\n\r\n":
                raise ValueError(f"record {head.get('warc-record-id')}: Content-Length {size} does not frame it")
            del got[size:]
            yield head, bytes(got)


def _urn(value: str | None) -> str | None:
    return value.strip("<>").removeprefix(URN) or None if value else None


def _digest(head: dict[str, str], name: str) -> str | None:
    return head[name].removeprefix("sha1:") if name in head else None


def _parse(path: str, no: int, head: dict[str, str], block: bytes, keep: bool) -> tuple:
    kind = head.get("warc-type", "")
    http, _, payload = block.partition(b"\r\n\r\n") if kind in ("response", "revisit") else (b"", b"", block)
    stated, valid = _digest(head, "warc-payload-digest"), _digest(head, "warc-block-digest") in (None, base32_sha1(block))
    if kind == "revisit":  # the payload is elsewhere; its size and digest stand in the heads
        sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, digest = (sizes[0] if sizes else None), stated
    else:
        size, digest = len(payload), base32_sha1(payload)
        valid = valid and stated in (None, digest)
    return (path, no, kind, _urn(head.get("warc-record-id")), _urn(head.get("warc-refers-to")),
            head.get("warc-target-uri"), size, digest, valid, payload if keep else None)


def read_archives(spark: SparkSession, files: DataFrame, file: str = "file", payloads: bool = True) -> DataFrame:
    """A row for each record of the archives that ``files`` lists, one task a file."""
    names = [f.name for f in spark.createDataFrame([], RECORD).schema]
    schema = pa.schema([(n, t) for n, t in zip(names, [
        pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(),
        pa.binary()])])

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path in batch.column(0).to_pylist():
                store, name = _open_fs(path)
                rows, held = [], 0
                with store.open_input_stream(name, compression=None, buffer_size=STEP) as stream:
                    for no, (head, block) in enumerate(Records(stream)):
                        rows.append(_parse(path, no, head, block, payloads))
                        held += len(block) if payloads else 64
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    paths = files.select(F.col(file).alias("path"))
    return paths.repartition(max(1, paths.count())).mapInArrow(read, RECORD)
