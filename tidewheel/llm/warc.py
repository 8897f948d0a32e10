"""WARC archives as a PySpark Python data source, and their writer.

Reading: files are the partitions' units (large ones first, spread by size);
equality and IN filters on the record type and on header columns are pushed
down; a record's header is parsed first, and the payload of a record that no
filter wants, or of any record when the payload isn't asked for, is skipped by
its stored length without being inflated.

Records are gzip members, one each, whose extra field ``sl`` holds the
compressed and the raw length (the skip-length convention); files from
elsewhere without it, or not compressed, are read too.

Paths are URIs that pyarrow's file systems can open (local, HDFS, S3), seen by
driver and executors alike.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ._util import shared_dir

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, content_length long, headers map<string,string>, payload binary"
_COLUMNS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}


def open_fs(uri: str):
    """File system and path of a URI or local path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file:///") else "file://" + uri[5:])


#: A record's header has at most so many bytes.
MOST_HEAD = 1 << 20


def pack_record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """One record as a gzip member with its skip lengths.  Line breaks in header values become spaces."""
    head = "".join(f"{k}: {' '.join(v.splitlines()) if v else ''}\r\n" for k, v in [*headers, ("Content-Length", str(len(payload)))])
    raw = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + payload + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H2sHII", 12, b"sl", 8, 24 + len(body) + 8, len(raw)) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _parse_head(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        if k:
            out[k.strip()] = v.strip()
    return out


def read_records(f, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of an open binary file that ``wanted(headers)`` accepts; payloads only where asked for."""
    step, size = 1 << 16, f.size()
    while f.tell() < size:
        start = f.tell()
        first = f.read(2)
        if first == b"\x1f\x8b":
            f.seek(start)
            yield from _gzip_member(f, start, step, wanted, with_payload)
        elif first.strip() == b"":
            f.seek(start + 1)  # blank lines between plain records
        else:
            f.seek(start)
            yield from _plain_record(f, start, step, wanted, with_payload)


def _plain_record(f, start, step, wanted, with_payload):
    buf = b""
    while (end := buf.find(b"\r\n\r\n")) < 0:
        more = f.read(step)
        if not more or len(buf) > MOST_HEAD:
            raise ValueError(f"a record header at byte {start} has no end")
        buf += more
    head = _parse_head(buf[:end])
    n = int(head.get("Content-Length") or 0)
    if start + end + 4 + n > f.size():
        raise ValueError(f"the record at byte {start} is cut short")
    f.seek(start + end + 4)
    if wanted(head):
        yield head, f.read(n) if with_payload else None
    f.seek(start + end + 4 + n + 4)


def _gzip_member(f, start, step, wanted, with_payload):
    prefix, skip = f.read(12), 0
    if prefix[3] & 4:
        extra = f.read(struct.unpack("<H", prefix[10:12])[0])
        at = 0
        while at + 4 <= len(extra):
            (n,) = struct.unpack("<H", extra[at + 2 : at + 4])
            if extra[at : at + 2] == b"sl" and n == 8:
                skip = struct.unpack("<I", extra[at + 4 : at + 8])[0]
            at += 4 + n
    f.seek(start)
    z = zlib.decompressobj(31)
    buf = b""
    while (end := buf.find(b"\r\n\r\n")) < 0 and not z.eof:
        data = z.unconsumed_tail or f.read(4096)
        if not data or len(buf) > MOST_HEAD:
            raise ValueError(f"a gzip member at byte {start} has no end")
        buf += z.decompress(data, 4096)
    head = _parse_head(buf[:end] if end >= 0 else buf)
    n, got = int(head.get("Content-Length") or 0), wanted(head)
    if got and with_payload or not skip:
        parts = [buf[end + 4 :]]
        while not z.eof:
            data = z.unconsumed_tail or f.read(step)
            if not data:
                raise ValueError(f"a gzip member at byte {start} has no end")
            x = z.decompress(data)
            if got and with_payload:
                parts.append(x)
        f.seek(f.tell() - len(z.unused_data))
        if got:
            yield head, b"".join(parts)[:n] if with_payload else None
    else:
        if got:
            yield head, None
    if skip:
        f.seek(start + skip)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.tasks = int(options.get("tasks", "0"))
        self.filters: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]):
        """Take equality and IN on header columns; Spark keeps the rest."""
        for x in filters:
            name = x.attribute[0] if isinstance(x, EqualTo | In) and len(x.attribute) == 1 else None
            if name in _COLUMNS:
                values = x.value if isinstance(x, In) else [x.value]
                self.filters.append((_COLUMNS[name], frozenset(map(str, values))))
            elif isinstance(x, EqualTo | In) and len(x.attribute) == 2 and x.attribute[0] == "headers":
                values = x.value if isinstance(x, In) else [x.value]
                self.filters.append((x.attribute[1], frozenset(map(str, values))))
            else:
                yield x

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, path = open_fs(self.path)
        found = [x for x in where.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and "/_temporary/" not in x.path]
        n = min(len(found), self.tasks or len(found)) or 1
        bins, sizes = [[] for _ in range(n)], [0] * n
        for x in sorted(found, key=lambda x: (-x.size, x.path)):
            i = sizes.index(min(sizes))
            bins[i].append(x.path)
            sizes[i] += x.size
        return [Files(b) for b in bins]

    def read(self, partition: Files):
        import pyarrow as pa

        where, _ = open_fs(self.path)
        filters = self.filters
        wanted = lambda h: all(h.get(k) in v for k, v in filters)
        types = [pa.field(n, pa.int64() if n == "content_length" else pa.binary() if n == "payload" else pa.map_(pa.string(), pa.string()) if n == "headers" else pa.string()) for n in (c.split()[0] for c in SCHEMA.split(", "))]
        rows, held = [], 0
        for path in partition.paths if partition else ():
            with where.open_input_file(path) as f:
                for head, payload in read_records(f, wanted, self.payload):
                    rows.append((*[head.get(k) for k in _COLUMNS.values()], int(head.get("Content-Length") or 0), list(head.items()), payload))
                    held += len(payload or b"") + 512
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=pa.schema(types))
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=pa.schema(types))


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class WarcWriter(DataSourceWriter):
    """Rows (headers map, payload) become records; a file a task, moved into place on commit."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        where, path = open_fs(self.path)
        f, at = None, f"{path}/_temporary/{self.job}/{uuid.uuid4().hex}.warc.gz"
        for row in rows:
            if f is None:
                where.create_dir(f"{path}/_temporary/{self.job}")
                f = where.open_output_stream(at, compression=None)
            f.write(pack_record(list(row.headers.items()), bytes(row.payload or b"")))
        if f is None:
            return Written(None)
        f.close()
        return Written(at)

    def commit(self, messages: list) -> None:
        """Only files of tasks that count are moved; those of lost or repeated attempts go."""
        where, path = open_fs(self.path)
        where.create_dir(path)
        for m in messages:
            if m is not None and m.path:
                where.move(m.path, f"{path}/{m.path.rsplit('/', 1)[1]}")
        self._clear(where, path)

    def abort(self, messages: list) -> None:
        self._clear(*open_fs(self.path))

    def _clear(self, where, path: str) -> None:
        from pyarrow import fs

        if where.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            where.delete_dir(f"{path}/_temporary")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: 40 bits at a time in radix 32, digits renamed."""
    four = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*four)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_pages(pages: DataFrame, path: str) -> None:
    """Archive ``pages`` (page_id, url, html) under ``path``, repeated payloads as revisit records.

    The payload is the html in UTF-8 (null: empty).  Of equal payloads (by SHA-1)
    the row with the smallest page_id is a response, the others revisit it;
    repeated rows with that page_id are responses too.  A null page_id sorts
    last and is written as an empty header; urls may be null.

    Digests are pre-aggregated before the shuffle, so a payload that holds a
    third of all rows is one row a map task; the join back can split its
    partition.
    """
    spark = pages.sparkSession
    register(spark)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload"))
    firsts = p.groupBy("sha").agg(F.min("page_id").alias("first")).withColumnRenamed("sha", "f_sha")
    p = p.join(firsts, F.col("sha") == F.col("f_sha")).withColumn("revisit", F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    pairs = [
        ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        ("WARC-Record-ID", urn(F.col("page_id"))),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        ("WARC-Refers-To", F.when(F.col("revisit"), urn(F.col("first")))),
        ("X-Payload-Length", F.octet_length("payload").cast("string")),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
    ]
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs]), lambda x: x["v"].isNotNull())
    rows = p.select(F.map_from_entries(entries).alias("headers"), F.when(~F.col("revisit"), F.col("payload")).alias("payload"))
    rows.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records back as pages: page_id, payload_bytes, payload_digest, record_type, refers_to, from headers.

    One scan: a response's length and digest are taken from its bytes, a
    revisit's, which has none, from its header.
    """
    register(spark)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).cast("long")
    r = spark.read.format("warc").load(path).where("record_type in ('response', 'revisit')")
    again = F.col("record_type") == "revisit"
    size = F.when(again, F.col("headers")["X-Payload-Length"].cast("long")).otherwise(F.length("payload").cast("long"))
    digest = F.when(again, F.substring_index("payload_digest", ":", -1)).otherwise(base32(F.sha1("payload")))
    return r.select(number(F.col("record_id")).alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to"))


def archive_dir(spark: SparkSession) -> str:
    """A new folder for archives beside the checkpoints."""
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def remove(uri: str) -> None:
    where, path = open_fs(uri)
    where.delete_dir(path)
