"""WARC 1.1 as a PySpark data source, and deduplicating archives of pages.

Writing: each task writes gzip-member-per-record files that roll over at ``ROLL_BYTES``; they are
staged under ``_staged`` and moved when the job commits, so a retried task leaves nothing behind.
Each member carries its compressed and its plain length (the format's skip-length extra field).

Reading: the driver plans one partition a file. Predicates on the record type and on the other
header columns are pushed down (``spark.sql.python.filterPushdown.enabled``). A record's header
is inflated first; when the predicates reject it, or the ``payload`` option is false, the reader
goes on to the next member without inflating the rest. Files of others, without the extra field
or not compressed, are read too. A file that ends inside a record, or goes on with bytes that are no
record, raises ``Broken`` with its name and the byte; with the option ``corrupt`` set to ``skip`` its
whole records before that are the result.

Defined results for ``archive_pages``: a null html is an empty payload; of equal payloads of at
least ``LEAST_REVISIT`` bytes the rows with the largest page_id are responses and the others
revisit them (rows that repeat the largest id are all responses; a null id revisits any other);
an empty table gives no rows. Other input columns are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from photonspark.llm.workspace import Workspace

ROLL_BYTES = 256 << 20
HEAD_BYTES = 2048
LEAST_REVISIT = 1000
SMALL_GROUPS = 500_000

#: Column -> WARC header field (fixed values of the format).
FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
}
SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes string, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Control characters would end a header line; they are percent-encoded.
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def record_bytes(row: dict) -> bytes:
    """One record, not compressed."""
    payload = row["payload"] or b""
    response = row["record_type"] == "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) if response else b""
    block = http + payload
    head = ["WARC/1.1", *(f"{field}: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', str(row[name]))}" for name, field in FIELDS.items() if row.get(name) is not None)]
    head += ["Content-Type: application/http; msgtype=response"] if response else [f"WARC-Profile: {REVISIT_PROFILE}"] if row["record_type"] == "revisit" else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(plain: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own and the plain length."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(plain) + squeeze.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(plain)) if max(size, len(plain)) < 1 << 32 else b""
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{root}/_staged", recursive=True)
        files: list[str] = []
        out = None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out = system.open_output_stream(f"{root}/_staged/{files[-1]}", compression=None)
                out.write(member(record_bytes(row)))
                if out.tell() >= ROLL_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        for message in messages:
            for name in message.files if message else []:
                system.move(f"{root}/_staged/{name}", f"{root}/{name}")
        self._clean(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*fs.FileSystem.from_uri(self.path))

    @staticmethod
    def _clean(system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_staged").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_staged")


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


@dataclass
class File(InputPartition):
    name: str


class Broken(OSError):
    """An archive has no whole record where one should be."""


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, corrupt: str = "fail"):
        if corrupt not in ("fail", "skip"):
            raise ValueError(f"corrupt is fail or skip, not {corrupt}")
        self.path, self.payload, self.corrupt = path, payload, corrupt
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            kind = {EqualTo: "eq", In: "in", StringStartsWith: "starts"}.get(type(f))
            if kind and name in FIELDS:
                self.tests.append((FIELDS[name].lower(), kind, f.value))
            else:
                yield f

    def partitions(self) -> list[File]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [File(x.path) for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")) and "/_staged/" not in x.path] or [File("")]

    def wanted(self, head: dict[str, str]) -> bool:
        for field, kind, value in self.tests:
            has = head.get(field)
            if has is None or (kind == "eq" and has != value) or (kind == "in" and has not in value) or (kind == "starts" and not has.startswith(value)):
                return False
        return True

    def records(self, source, name: str) -> Iterator[tuple[dict[str, str], bytes | None]]:
        try:
            yield from (gzip_records if name.endswith(".gz") else plain_records)(source, self.wanted, self.payload)
        except Broken as broken:
            if self.corrupt == "fail":
                raise Broken(f"{name}: {broken}") from broken

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        held: list[dict] = []
        size = 0
        with system.open_input_file(partition.name) as source:
            for head, block in self.records(source, partition.name):
                row = {name: head.get(field.lower()) for name, field in FIELDS.items()}
                if block is not None and head.get("content-type", "").startswith("application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                row["payload"] = block
                held.append(row)
                size += len(block or b"")
                if len(held) >= 2000 or size > 8 << 20:
                    yield to_batch(held)
                    held, size = [], 0
        if held:
            yield to_batch(held)


def to_batch(rows: list[dict]) -> pa.RecordBatch:
    names = [*FIELDS, "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.binary() if n == "payload" else pa.string()) for n in names], names=names)


def skip_length(source, at: int, end: int) -> int | None:
    """The length of the member at a byte, if its extra field has it."""
    source.seek(at)
    first = source.read(12)
    if len(first) < 12 or first[:3] != b"\x1f\x8b\x08":
        raise Broken(f"no gzip member at byte {at}")
    if not first[3] & 4:
        return None
    extra = source.read(struct.unpack("<H", first[10:12])[0])
    length = struct.unpack("<I", extra[4:8])[0] if extra[:2] == b"sl" and len(extra) >= 12 else None
    if length is not None and not 0 < length <= end - at:
        raise Broken(f"the member at byte {at} is cut off")
    return length


def gzip_records(source, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and blocks of the members; a block that is not needed is neither inflated nor, with a skip length, read."""
    at, end = 0, source.size()
    while at < end:
        length = skip_length(source, at, end)
        source.seek(at)
        inflate, plain, used = zlib.decompressobj(31), b"", 0

        def more(limit: int) -> bytes | None:
            """Some more of the member's plain bytes, perhaps none; None at its end."""
            nonlocal used
            if inflate.eof:
                return None
            fresh = inflate.unconsumed_tail
            if not fresh:
                fresh = source.read(min(HEAD_BYTES if not used else 1 << 20, length - used if length is not None else 1 << 20))
                used += len(fresh)
                if not fresh:
                    raise Broken(f"the member at byte {at} is cut off")
            try:
                return inflate.decompress(fresh, limit)
            except zlib.error as error:
                raise Broken(f"the member at byte {at}: {error}") from error

        while b"\r\n\r\n" not in plain and (part := more(HEAD_BYTES)) is not None:
            plain += part
        raw, found, rest = plain.partition(b"\r\n\r\n")
        if not found:
            raise Broken(f"the member at byte {at} has no whole header")
        head = parse_head(raw)
        take = wanted(head)
        if take and payload or length is None:
            pieces = [rest]
            while (part := more(1 << 20)) is not None:
                pieces.append(part)
            rest = b"".join(pieces)
        if take:
            yield head, rest[: block_length(head, at)] if payload else None
        at = at + length if length is not None else at + used - len(inflate.unused_data)


def block_length(head: dict[str, str], at: int) -> int:
    text = head.get("content-length", "0")
    if not text.isdecimal():
        raise Broken(f"the record at byte {at} has no length")
    return int(text)


def plain_records(source, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    at, end = 0, source.size()
    while at < end:
        source.seek(at)
        raw = b""
        while b"\r\n\r\n" not in raw and (part := source.read(HEAD_BYTES)):
            raw += part
        if b"\r\n\r\n" not in raw or not raw.startswith(b"WARC/"):
            raise Broken(f"no whole header at byte {at}")
        head_bytes = raw.index(b"\r\n\r\n")
        head = parse_head(raw[:head_bytes])
        start, length = at + head_bytes + 4, block_length(head, at)
        if start + length > end:
            raise Broken(f"the record at byte {at} is cut off")
        if wanted(head):
            block = None
            if payload:
                source.seek(start)
                block = source.read(length)
            yield head, block
        at = start + length + 4


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false", self.options.get("corrupt", "fail"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame, work: Workspace) -> DataFrame:
    """A record for each page. Groups of equal payloads are counted on digests; html is never shuffled for it
    unless there are more than ``SMALL_GROUPS`` groups of two pages or more."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 AND kept IS NOT NULL")
    groups = work.table(groups.select("digest", "size", "kept"), "groups")
    if groups.count() <= SMALL_GROUPS:
        groups = F.broadcast(groups)
    joined = rows.join(groups, ["digest", "size"], "left")
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    return joined.select(
        urn("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        now.alias("date"),
        F.when(revisit, urn("kept")).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.col("size").cast("string").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages(page_id, url, html)`` and read them back."""
    spark = pages.sparkSession
    register(spark)
    work = Workspace(spark, "warc")
    kind = dict(pages.dtypes)["page_id"]
    records(pages, work).write.format("warc").mode("append").option("path", work.path("archive")).save()
    # payloads are inflated for responses only; of revisits the headers say it all
    read = lambda payload, kind: spark.read.format("warc").option("path", work.path("archive")).option("payload", payload).load().where(F.col("record_type") == kind)
    back = read("true", "response").unionByName(read("false", "revisit"))
    response = F.col("record_type") == "response"
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast(kind)
    return back.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes").cast("long")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
