"""WARC archives as a PySpark Python data source (format name ``warc``).

Writing: every task writes one gzip WARC, a member per record, and reports it with its commit message; the
driver then writes ``_manifest.json``. Files of failed or repeated attempts are not in the manifest and so are never
read. Members carry the ``sl`` (skip lengths) extra field of the WARC standard's gzip annex.

Reading: partitions are planned from the manifest (files cut at record starts about every ``split_bytes``) or,
without one, a partition for each ``*.warc`` or ``*.warc.gz`` file. Filters on record_type and other header columns are pushed down:
a record's headers are inflated and parsed first, and a record that is not wanted is skipped by its length without
inflating its payload. A payload is inflated only if the schema asks for ``payload`` or ``verify`` is set.

Spark 4.1 keeps the predicates that one plan has pushed into a loaded frame and applies them to every later plan of that frame: load the
archives again for each set of predicates.

Options: ``split_bytes`` (64 MB), ``verify`` (recompute payload digests, fail on a mismatch), ``date`` (WARC-Date of written records).

Without skip lengths a gzip member may hold several records. A record that doesn't begin as one, whose headers don't end or whose payload is
cut off fails the read: nothing is left out silently.

Defined cases: a null payload of a response is the empty payload; a revisit has HTTP headers but no payload, its
payload_bytes is the full payload's from those headers; a null target_uri or refers_to is left out; ids may be null or
repeat (rows that share payload and smallest id are all responses); control characters in a URI are percent-encoded, all other
URIs read back as they were; other columns are left out; an empty table writes no record and reads back as an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import shared_path, text_batches

SCHEMA = "record_type string, record_id string, target_uri string, date string, content_type string, content_length long, refers_to string, payload_digest string, payload_bytes long, payload binary"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"
HEAD = 8192  #: bytes read first; enough for most headers


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def header_text(value: str) -> str:
    """A value as it stands in a header: control characters, and spaces at its ends, are percent-encoded; all else is kept."""
    inner = value.strip(" ")
    at = value.find(inner) if inner else 0
    inner = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in inner)
    return "%20" * at + inner + "%20" * (len(value) - at - len(value.strip(" ")))


def encode_record(kind: str, record_id: str, uri: str | None, date: str, refers_to: str | None, digest: str, size: int, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if uri is not None:
        head.append(("WARC-Target-URI", header_text(uri)))
    if refers_to is not None:
        head.append(("WARC-Refers-To", f"<{refers_to}>"))
    if kind == "revisit":
        head.append(("WARC-Profile", REVISIT))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + http + payload + b"\r\n\r\n"


def member(record: bytes, level: int = 5) -> bytes:
    """A gzip member with the record's compressed and plain length in the ``sl`` extra field (zero where 32 bits don't do)."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    whole = 24 + len(body) + 8
    lengths = (whole, len(record)) if max(whole, len(record)) < 1 << 32 else (0, 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *lengths) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    splits: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "1970-01-01T00:00:00Z")
        self.split, self.overwrite = int(options.get("split_bytes", 64 << 20)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = open_fs(self.path)
        fs.create_dir(at, recursive=True)
        name, size, splits = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
            for batch in iterator:
                for r in batch.to_pylist():
                    payload = r.get("payload") or b""
                    payload = payload.encode("utf-8", "surrogatepass") if isinstance(payload, str) else payload
                    revisit = r["record_type"] == "revisit"
                    digest, length = (base64.b32encode(bytes.fromhex(r["payload_digest"])).decode(), r["payload_bytes"]) if revisit else (base32_sha1(payload), len(payload))
                    if size - splits[-1] >= self.split:
                        splits.append(size)
                    data = member(encode_record(r["record_type"], r["record_id"], r.get("target_uri"), self.date, r.get("refers_to"), digest, length, b"" if revisit else payload))
                    out.write(data)
                    size += len(data)
        return Written(name, size, splits)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = open_fs(self.path)
        fs.create_dir(at, recursive=True)
        before = _manifest(fs, at) or []
        listed = [{"name": m.name, "size": m.size, "splits": m.splits} for m in messages if m is not None]
        # The manifest decides what is read: an overwrite replaces it first and deletes the old files then.
        with fs.open_output_stream(f"{at}/{MANIFEST}.new", compression=None) as out:
            out.write(json.dumps(listed if self.overwrite else before + listed).encode())
        fs.move(f"{at}/{MANIFEST}.new", f"{at}/{MANIFEST}")
        for old in before if self.overwrite else ():
            fs.delete_file(f"{at}/{old['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = open_fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{at}/{m.name}")


def _manifest(fs: pafs.FileSystem, at: str) -> list[dict] | None:
    if fs.get_file_info(f"{at}/{MANIFEST}").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Stretch(InputPartition):
    name: str
    start: int
    end: int


_COMPARE = {
    EqualTo: lambda a, b: a is not None and a == b,
    EqualNullSafe: lambda a, b: a == b,
    In: lambda a, b: a is not None and a in b,
    GreaterThan: lambda a, b: a is not None and a > b,
    GreaterThanOrEqual: lambda a, b: a is not None and a >= b,
    LessThan: lambda a, b: a is not None and a < b,
    LessThanOrEqual: lambda a, b: a is not None and a <= b,
    StringStartsWith: lambda a, b: a is not None and a.startswith(b),
    StringEndsWith: lambda a, b: a is not None and a.endswith(b),
    StringContains: lambda a, b: a is not None and b in a,
    IsNull: lambda a, b: a is None,
    IsNotNull: lambda a, b: a is not None,
}
#: Columns known from the WARC headers alone.
HEADER_COLUMNS = {"record_type", "record_id", "target_uri", "date", "content_type", "content_length", "refers_to", "payload_digest"}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"].rstrip("/"), schema
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            column = ".".join(inner.attribute) if hasattr(inner, "attribute") else None
            if type(f) in _COMPARE and column in HEADER_COLUMNS:
                self.tests.append((type(f), column, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        fs, at = open_fs(self.path)
        listed = _manifest(fs, at)
        if listed is None:
            infos = fs.get_file_info(pafs.FileSelector(at, recursive=True))
            return [Stretch(i.path, 0, i.size) for i in infos if i.path.endswith((".warc", ".warc.gz")) and i.size] or [Stretch("", 0, 0)]
        cuts = [(f"{at}/{f['name']}", [*f["splits"], f["size"]]) for f in listed if f["size"]]
        return [Stretch(name, a, b) for name, c in cuts for a, b in zip(c, c[1:], strict=False)] or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        names = self.schema.names
        wants_http = self.verify or "payload_bytes" in names
        arrow = pa.schema([(f.name, {"long": pa.int64(), "binary": pa.binary()}.get(f.dataType.typeName(), pa.string())) for f in self.schema])
        rows, size = [], 0
        for row in self._records(partition, wants_http, self.verify or "payload" in names) if partition.end else ():
            rows.append({n: row.get(n) for n in names})
            size += 256 + len(rows[-1].get("payload") or b"")
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def _records(self, part: Stretch, wants_http: bool, wants_payload: bool) -> Iterator[dict]:
        fs, _ = open_fs(self.path)
        with fs.open_input_file(part.name) as f:
            at = part.start
            while at < part.end:
                record, row = Record(f, at), None
                while record.begins():
                    row = record.headers()
                    if all(_COMPARE[kind](row[column], value) for kind, column, value in self.tests):
                        if wants_http:
                            row["payload_bytes"] = record.payload_bytes(row)
                        if wants_payload and row["record_type"] == "response":
                            row["payload"] = record.payload(row)
                            if self.verify and (len(row["payload"]) != row["payload_bytes"] or row["payload_digest"] not in (None, base32_sha1(row["payload"]))):
                                raise ValueError(f"{part.name}: {row['record_id']} does not match its digest or length")
                        yield row
                    if not record.gz or record.length:
                        break
                    record.skip(row)  # a member of foreign archives may hold more records
                if row is None:  # nothing but blank lines to the end
                    break
                at = record.end(row)


class Record:
    """One record of an open file, decoded only as far as asked for."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at
        file.seek(at)
        self.raw = file.read(HEAD)
        self.gz = self.raw[:2] == b"\x1f\x8b"
        self.length = 0
        if self.gz:
            self.z, skip = zlib.decompressobj(31), b""
            if self.raw[3] & 4:
                (n,) = struct.unpack_from("<H", self.raw, 10)
                extra = self.raw[12 : 12 + n]
                while len(extra) >= 4:
                    tag, (m,) = extra[:2], struct.unpack_from("<H", extra, 2)
                    if tag == b"sl" and m >= 8:
                        skip = extra[4:12]
                    extra = extra[4 + m :]
            self.length = struct.unpack("<II", skip)[0] if skip else 0
            self.plain = self.z.decompress(self.raw, 4096)
        else:
            self.plain = self.raw

    def _more(self) -> bool:
        """Decode a little more; False at the end of the record's data."""
        if self.gz:
            data = self.z.unconsumed_tail or (b"" if self.z.eof else self.file.read(1 << 18))
            if self.z.eof or not data:
                return False
            self.plain += self.z.decompress(data, 1 << 20)
            return True
        data = self.file.read(1 << 20)
        self.plain += data
        return bool(data)

    def _until_blank(self, start: int) -> int:
        while (end := self.plain.find(b"\r\n\r\n", start)) < 0:
            if not self._more():
                return -1
        return end

    def begins(self) -> bool:
        """Whether a record begins here, behind blank lines; anything else is damage."""
        while not (rest := self.plain.lstrip(b"\r\n")) and self._more():
            pass
        rest = self.plain.lstrip(b"\r\n")
        if not self.gz:
            self.at += len(self.plain) - len(rest)
        self.plain = rest
        while 0 < len(self.plain) < 5 and self._more():
            pass
        if self.plain and not self.plain.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {self.at}")
        return bool(self.plain)

    def skip(self, row: dict) -> None:
        """Forgets a record that was read, as far as its member goes on."""
        end, have = self.block + row["content_length"], len(self.plain)
        while have < end:
            self.plain = b""
            if not self._more():
                raise ValueError(f"the record at {self.at} is cut off")
            have += len(self.plain)
        self.plain = self.plain[len(self.plain) - (have - end) :] if have > end else b""
        if hasattr(self, "body"):
            del self.body

    def headers(self) -> dict:
        self.block = self._until_blank(0) + 4
        if self.block < 4:
            raise ValueError(f"the headers at {self.at} have no end")
        found = {}
        for line in self.plain[: self.block].decode("utf-8", "replace").strip().split("\r\n")[1:]:
            k, _, v = line.partition(":")
            found[k.strip().lower()] = v.strip(" \t")
        digest = found.get("warc-payload-digest")
        bare = lambda k: found[k].strip("<>") if k in found else None
        return {
            "record_type": found.get("warc-type"), "record_id": bare("warc-record-id"), "target_uri": found.get("warc-target-uri"), "date": found.get("warc-date"), "content_type": found.get("content-type"),
            "content_length": int(found.get("content-length", 0)), "refers_to": bare("warc-refers-to"), "payload_digest": digest.partition(":")[2] if digest else None,
        }

    def payload_bytes(self, row: dict) -> int | None:
        if not (row["content_type"] or "").startswith("application/http"):
            self.body = self.block
            return row["content_length"]
        self.body = self._until_blank(self.block) + 4
        if self.body < 4:
            self.body = self.block + row["content_length"]
        if row["record_type"] != "revisit":
            return self.block + row["content_length"] - self.body
        for line in self.plain[self.block : self.body].split(b"\r\n"):
            k, _, v = line.partition(b":")
            if k.strip().lower() == b"content-length":
                return int(v)
        return None

    def payload(self, row: dict) -> bytes:
        end = self.block + row["content_length"]
        if not hasattr(self, "body"):
            self.payload_bytes(row)
        pieces, have = [self.plain], len(self.plain)
        while have < end:
            self.plain = b""
            if not self._more():
                raise ValueError(f"the record at {self.at} is cut off")
            pieces.append(self.plain)
            have += len(self.plain)
        self.plain = b"".join(pieces)
        return self.plain[self.body : end]

    def end(self, row: dict) -> int:
        if not self.gz:
            return self.at + self.block + row["content_length"] + 4
        if self.length:
            return self.at + self.length
        while not self.z.eof:  # no skip length: the member's end has to be found
            self.plain = b""
            if not self._more():
                break
        return self.file.tell() - len(self.z.unused_data)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format ``warc`` known and lets Spark push filters into Python data sources."""
    text_batches(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, id_col: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """The WARC records to write for ``pages`` (payload_digest: hexadecimal SHA-1; base32 in the archive): of equal payloads of at least ``least`` bytes that with the smallest id is the response.

    The smallest id of each payload is found with map-side combine; the join back to the pages splits large groups (AQE).
    """
    html = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri).alias("uri"), F.col(payload).alias("html"), F.sha2(html, 256).alias("same"))
    first = pages.select(F.col(id_col).alias("i"), html.alias("h")).filter(F.octet_length("h") >= least).groupBy(F.sha2("h", 256).alias("s")).agg(F.min("i").alias("first"))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    urn = lambda c: F.when(c.isNotNull(), F.concat(F.lit("urn:page:"), c.cast("string")))
    text = F.coalesce("html", F.lit(""))
    return rows.join(first, rows.same == first.s, "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(urn(F.col("id")), F.lit("urn:page:")).alias("record_id"),
        F.col("uri").alias("target_uri"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.sha1(text).alias("payload_digest"),
        F.octet_length(text).cast("long").alias("payload_bytes"),
        F.when(~again, text).cast("binary").alias("payload"),
    )


def op6_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads and verified; revisits by their headers alone (the predicate is pushed down, payloads are skipped)."""
    register(spark)
    path = shared_path(spark, "warc")
    records(spark.read.parquet(f"{sf_dir}/pages.parquet")).write.format("warc").mode("append").save(path)
    columns = "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long"
    responses = spark.read.format("warc").option("verify", "true").schema(columns).load(path).filter("record_type = 'response'")
    revisits = spark.read.format("warc").schema(columns).load(path).filter("record_type = 'revisit'")
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)")
    return responses.unionByName(revisits).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
