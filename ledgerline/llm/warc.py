"""WARC archives as a Python data source, and web pages written to and read from them.

Writing: every task rolls gzip files with one member a record; each member's extra field holds its lengths (the subfield
``sl``), so a reader can pass over a record without inflating it. A commit lists the files and their split points in a
manifest; files of lost attempts aren't listed and so never read.

Reading: partitions are file splits. Predicates on the record type and header columns are pushed into the reader, which
inflates a record's head first and its payload only if the predicates hold and the schema asks for the payload. Archives of
other writers (no ``sl``, no manifest, plain text) are read too, a file a partition, and so are those in subfolders. Paths are
local or URIs of stores that Arrow opens (file, hdfs, s3, gs, abfs); Hadoop's names s3a, s3n and gcs are taken for them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import materialize, scratch_path, short_batches
from .membership import perhaps

SCHEMA = (
    "record_type string, record_id string, target_uri string, refers_to string, date string, payload_digest string,"
    " content_length long, payload_length long, payload binary"
)
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest"}
FILE_BYTES, SPLIT_BYTES, HEAD_BYTES, BATCH_BYTES = 1 << 28, 1 << 25, 1 << 12, 1 << 23
PART = re.compile(r"part-[0-9a-f]{32}\.warc\.gz")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str):
    """The Arrow file system of a path, which may be a URI of any store that Arrow knows."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    scheme, mark, rest = path.partition("://")
    path = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}.get(scheme, scheme) + mark + rest
    return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """A gzip member whose extra field tells the member's own length and the record's."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(r: dict) -> bytes:
    """A record in WARC 1.1 form; responses and revisits carry an HTTP head that tells the payload's length."""
    payload = r.get("payload") or b""
    length = r["payload_length"] if r.get("payload_length") is not None else len(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + payload
    lines = [f"{name}: {str(r[c]).replace(chr(13), ' ').replace(chr(10), ' ')}" for c, name in HEADERS.items() if r.get(c) is not None and c != "payload_digest"]
    if r.get("payload_digest"):
        lines.append(f"WARC-Payload-Digest: sha1:{r['payload_digest']}")
    if r["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Files(WriterCommitMessage):
    files: list  # (name, [split offsets], bytes)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        done, out, name, splits, at = [], None, "", [], 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is not None and at >= FILE_BYTES:
                    out.close()
                    done.append((name, splits, at))
                    out = None
                if out is None:
                    name, splits, at = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                if at - splits[-1] >= SPLIT_BYTES:
                    splits.append(at)
                data = member(record_bytes(r))
                out.write(data)
                at += len(data)
        if out is not None:
            out.close()
            done.append((name, splits, at))
        return Files(done)

    def commit(self, messages: list) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list) -> None:
        store, root = filesystem(self.path)
        for m in messages:
            for name, _, _ in m.files if m else ():
                store.delete_file(f"{root}/{name}")


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int  # -1: to the end of the file


class _Stream:
    """Forward reads over a file with a look-ahead buffer."""

    def __init__(self, file, start: int):
        self.file, self.at, self.buffer = file, start, b""
        file.seek(start)

    def peek(self, n: int) -> bytes:
        while len(self.buffer) < n:
            more = self.file.read(max(1 << 16, n - len(self.buffer)))
            if not more:
                break
            self.buffer += more
        return self.buffer[:n]

    def skip(self, n: int) -> None:
        self.at += n
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.buffer = b""
            self.file.seek(self.at)


def _head(data: bytes) -> tuple[dict, int] | None:
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/"):
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.wanted = path, columns, {}

    def pushFilters(self, filters):
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column in HEADERS and column != "payload_digest" and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.wanted.setdefault(column + "?", {True})
            else:
                yield f

    def partitions(self) -> list[Split]:
        from pyarrow import fs

        store, root = filesystem(self.path)
        folder = store.get_file_info(root).type == fs.FileType.Directory
        found = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File] if folder else store.get_file_info([root])
        manifests = [f.path for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json")]
        own = {m.rpartition("/")[0] for m in manifests}  # folders that this writer has committed to
        out = []
        for m in manifests:
            for name, splits, size in json.loads(store.open_input_stream(m).read()):
                out += [Split(f"{m.rpartition('/')[0]}/{name}", a, b) for a, b in zip(splits, [*splits[1:], size], strict=True)]
        for f in found:
            ours = PART.fullmatch(f.base_name) and f.path.rpartition("/")[0] in own  # listed above, or of a lost attempt
            if f.base_name.endswith((".warc", ".warc.gz")) and not ours:
                out.append(Split(f.path, 0, -1))
        return out or [Split("", 0, 0)]

    def passes(self, head: dict) -> bool:
        for column, values in self.wanted.items():
            found = head.get(HEADERS[column.removesuffix("?")].lower())
            if found is None or not column.endswith("?") and found not in values:
                return False
        return True

    @staticmethod
    def of_http(head: dict) -> bool:
        return head.get("content-type", "").startswith("application/http") and head.get("warc-type") in ("response", "revisit", "request")

    def row(self, head: dict, block: bytes) -> dict:
        kind, http, _ = head.get("warc-type"), *block.partition(b"\r\n\r\n")[::2]
        of_http = self.of_http(head)
        payload = block[len(http) + 4 :] if of_http else block
        digest = (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        rest = int(head.get("content-length", 0)) - (len(http) + 4 if of_http else 0)  # the block may be its first bytes only
        length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), max(rest, 0)) if of_http else rest
        whole = "payload" in self.columns and kind != "revisit"
        if whole and digest and base32_sha1(payload) != digest:
            raise ValueError(f"payload of {head.get('warc-record-id')} does not match its digest")
        values = {c: head.get(h.lower()) for c, h in HEADERS.items()} | {"payload_digest": digest, "content_length": int(head.get("content-length", 0)), "payload_length": length, "payload": payload if whole else None}
        return {c: values[c] for c in self.columns}

    def records(self, stream: _Stream, end: int) -> Iterator[dict]:
        whole = "payload" in self.columns
        sized = "payload_length" in self.columns  # needs the whole HTTP head
        while end < 0 or stream.at < end:
            first = stream.peek(24)
            if not first:
                return
            if first[:2] == b"\x1f\x8b":
                known = struct.unpack("<I", first[16:20])[0] if first[3] & 4 and first[12:14] == b"sl" else 0
                inflate, data, used = zlib.decompressobj(31), b"", 0
                chunk = stream.peek(min(known, HEAD_BYTES) if known else HEAD_BYTES)
                data = inflate.decompress(chunk)
                used = len(chunk)

                def more(data=data) -> bytes:
                    nonlocal used
                    parts = [data]
                    while not inflate.eof:
                        part = stream.peek(used + (known - used if known else 1 << 16))[used:]
                        if not part:
                            break
                        used += len(part)
                        parts.append(inflate.decompress(part))
                    return b"".join(parts)

                found = _head(data)
                if found is None:
                    data = more()
                    found = _head(data)
                keep = found is not None and self.passes(found[0])
                need = found[1] + int(found[0].get("content-length", 0)) if keep else 0
                cut = keep and sized and self.of_http(found[0]) and b"\r\n\r\n" not in data[found[1] : need]
                if keep and len(data) < need and (whole or cut or found[0].get("warc-type") == "revisit"):
                    data = more()
                if keep:
                    yield self.row(found[0], data[found[1] : need])
                if not known and not inflate.eof:
                    more()
                stream.skip(known or used - len(inflate.unused_data))
            else:
                n = HEAD_BYTES
                while (found := _head(stream.peek(n).lstrip(b"\r\n"))) is None and len(stream.peek(n)) == n:
                    n *= 2
                if found is None:
                    return
                blank = len(stream.peek(n)) - len(stream.peek(n).lstrip(b"\r\n"))
                size = int(found[0].get("content-length", 0))
                if self.passes(found[0]):
                    start, n = blank + found[1], size if whole else min(size, HEAD_BYTES)
                    while n < size and sized and self.of_http(found[0]) and b"\r\n\r\n" not in stream.peek(start + n)[start : start + n]:
                        n = min(size, n * 2)
                    yield self.row(found[0], stream.peek(start + n)[start : start + n])
                stream.skip(blank + found[1] + size)
                while (rest := stream.peek(4)) and rest[:1] in b"\r\n":
                    stream.skip(len(rest) - len(rest.lstrip(b"\r\n")))

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        types = {"content_length": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, types.get(c, pa.string())) for c in self.columns])
        if not partition.file:
            return
        store, _ = filesystem(self.path)
        rows, size = [], 0
        with store.open_input_file(partition.file) as file:
            for r in self.records(_Stream(file, partition.start), partition.end):
                rows.append(r)
                size += 500 + len(r.get("payload") or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Warc(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; columns as in ``SCHEMA``, or fewer."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Records to write: of equal payloads of ``min_bytes`` or more, the smallest id is the response and the others revisit it.

    Payloads are compared by SHA-1 and length. Rows that repeat the smallest id are responses too. Null html is an empty payload.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    keyed = given.withColumn("sha1", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    first = keyed.filter(F.col("payload_length") >= min_bytes).groupBy("sha1", "payload_length").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    several = materialize(first.filter("n > 1"), "copies")
    clear, unsure = perhaps(keyed, F.col("sha1"), several.select(F.col("sha1").alias("key")))  # only payloads that may have copies are shuffled
    alone = clear.withColumn("first", F.lit(None).cast(several.schema["first"].dataType)).withColumn("n", F.lit(None).cast("long"))
    joined = unsure.join(several, ["sha1", "payload_length"], "left").unionByName(alone)
    response = F.coalesce(F.col("id").eqNullSafe(F.col("first")) | F.col("n").isNull(), F.lit(True))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return joined.select(
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.coalesce(urn("id"), F.lit("<urn:page:>")).alias("record_id"),
        "target_uri",
        F.when(~response, urn("first")).alias("refers_to"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.col("sha1").alias("payload_digest"),
        "payload_length",
        F.when(response, F.col("payload")).alias("payload"),
    )


def _base32(batches):
    for b in batches:
        digest = pa.array([None if x is None else base64.b32encode(bytes.fromhex(x)).decode() for x in b.column("payload_digest").to_pylist()], pa.string())
        yield b.set_column(b.schema.get_field_index("payload_digest"), "payload_digest", digest)


def write_pages(pages: DataFrame, path: str, **columns) -> None:
    """Writes a record per row of ``pages`` to archives below ``path``, beside what is there.

    Null html is an empty payload, a null url leaves its header out, and a null id gives a record id without number. Repeated
    rows give a record each. Other columns are ignored, whatever their names. Empty input: no records.
    """
    register(pages.sparkSession)
    short_batches(pages.sparkSession)
    records = page_records(pages, **columns)
    records.mapInArrow(_base32, records.schema).write.format("warc").mode("append").save(path)


def archive_round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", **columns) -> DataFrame:
    """Writes ``pages`` to archives and returns what they hold: ``id_col, payload_bytes, payload_digest, record_type, refers_to``.

    One row per input row; a null id comes back null. Lengths of responses are those of the payloads read, whose digests are
    verified; a revisit's come from its headers. Empty input: no rows.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    write_pages(pages, path, id_col=id_col, **columns)
    read = spark.read.format("warc").schema("record_type string, record_id string, refers_to string, payload_digest string, payload_length long, payload binary").load(path)
    number = lambda c: F.expr(f"nullif(regexp_extract({c}, '<urn:page:(.*)>', 1), '')").cast(kind)
    return read.filter(F.col("record_type").isin("response", "revisit")).select(
        number("record_id").alias(id_col),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )
