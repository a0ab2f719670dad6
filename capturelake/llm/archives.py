"""Web archives: legacy ARC files, their conversion to WARC, and reading both back.

Files are written and read by Spark itself (text writer, binary reader), so
any file system that Spark knows will do; each file is one gzip stream and is
parsed as a stream. An archive's folders part the records by size, so that no
file holds over ``RECORDS`` records or ``FILE_BYTES`` of payload, but for single
payloads that are longer (a payload must fit in one column value, 2 GB). Null payloads are empty; a
null or empty URL is "-" in an ARC header line and comes back as null; a null key gives
no key field. Repeated rows are separate records. An empty table gives files
without records, which read back as an empty table.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import HOT_ROWS, attach
from ..session import durable

#: Records of a file, its describing record included, and bytes of its payloads.
RECORDS, FILE_BYTES = 5_000, 64_000_000
#: Payloads under so many bytes are always kept in full.
LEAST_REVISIT = 100
#: Distinct repeated payloads (32-byte digest, key, place) that may be broadcast; more are joined by shuffle, without payloads.
BROADCAST_ROWS = 100_000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

# The fields of a header line by ARC version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
        "Archive-length"),
}


class ArcRecord(NamedTuple):
    offset: int
    url: str | None
    ip: str
    date: str
    mime: str
    block: bytes


class WarcRecord(NamedTuple):
    fields: dict[str, str]
    block: bytes


# -- ARC -------------------------------------------------------------------------

def _arc_line(version: int, url: str | None, date: str, mime: str, length: int, offset: int, name: str) -> bytes:
    # White space would part the fields of the line.
    place = "".join(f"%{b:02X}" if b in b" \t\r\n\x0b\x0c" else chr(b) for b in (url or "-").encode())
    values = {"URL": place, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime, "Result-code": "200",
              "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(length)}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode("latin-1") + b"\n"


def _arc_start(version: int, date: str, name: str) -> bytes:
    body = f"{version} 0 capturelake\n{' '.join(ARC_FIELDS[version])}\n".encode()
    if version == 1:
        return _arc_line(1, f"filedesc://{name}", date, "text/plain", len(body), 0, name) + body
    return f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n".encode() + body


def http_block(key: int | None, payload: bytes) -> bytes:
    """An HTTP response: headers that carry the key and the payload's length, then the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
    return head.encode() + (b"" if key is None else b"X-Page-Id: %d\r\n" % key) + b"\r\n" + payload


def parse_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """Records of one ARC file, without the one that describes it.

    The version block names the fields of the header lines; without one, a
    line's field count tells the version. A URL with blanks is read from
    the left of the known fields. Lines that are no header are passed over; a
    block shorter than declared ends the file and is not given out.
    """
    fields, at = None, 0
    while line := stream.readline():
        begin, at = at, at + len(line)
        parts = line.decode("latin-1").rstrip("\r\n").split(" ")
        names = fields or (ARC_FIELDS[2] if len(parts) >= 10 and parts[-8][:14].isdigit() else ARC_FIELDS[1])
        if len(parts) < len(names) or not parts[-1].isdigit():
            continue
        values = dict(zip(names[1:], parts[1 - len(names):], strict=True))
        if not (values["Archive-date"].isdigit() and len(values["Archive-date"]) == 14):
            continue
        url = " ".join(parts[:1 - len(names)])
        size = int(values["Archive-length"])
        block = stream.read(size)
        at += len(block)
        if len(block) < size:
            return
        if url.startswith("filedesc:"):
            version = block.split(b" ", 1)[0]
            fields = ARC_FIELDS[2 if version == b"2" else 1]
            continue
        yield ArcRecord(begin, None if url == "-" else url.encode("latin-1").decode("utf-8", "replace"),
                        values["IP-address"], values["Archive-date"], values["Content-type"], block)


# -- WARC ------------------------------------------------------------------------

def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """Header part and payload of an HTTP response, or None where it is none."""
    if not block.startswith(b"HTTP/"):
        return None
    head, gap, payload = block.partition(b"\r\n\r\n")
    return head + gap, payload


def http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode("latin-1")
    return None


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def record_id(source: str, offset: int) -> str:
    """An identifier that stays the same when the same place of the same file is converted again."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{source}#{offset}").urn


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"{k}: {' '.join(v.split())}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def parse_warc(stream: BinaryIO) -> Iterator[WarcRecord]:
    """Records of one WARC file; a block shorter than declared ends the file and is not given out."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields.get("content-length", "0"))
        block = stream.read(size)
        if len(block) < size:
            return
        yield WarcRecord(fields, block)


# -- files -----------------------------------------------------------------------

def _opened(content: bytes) -> BinaryIO:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def _contents(spark: SparkSession, path: str) -> DataFrame:
    # The text writer's success mark and checksum files are hidden from readers.
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _limits() -> list[tuple[int, int]]:
    """Size classes: records of a file, and the longest payload that lets so many keep to ``FILE_BYTES``."""
    out, records = [], RECORDS
    while records > 2:
        out.append((records, FILE_BYTES // records))
        records = max(2, records // 10)
    return [*out, (2, 1 << 62)]  # one payload, beside the record that describes the file


def _class(size: Column) -> Column:
    """Number of the size class of a payload."""
    limits = _limits()
    out = F.lit(len(limits) - 1)
    for n in reversed(range(len(limits) - 1)):
        out = F.when(size <= limits[n][1], n).otherwise(out)
    return out


def _write(records: DataFrame, path: str, between: str, most: int) -> None:
    """Raw records, one after the other; bytes pass through the text writer unchanged."""
    (records.select(F.col("value").cast("string")).write.option("lineSep", between).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most).text(path))


def write_arc(df: DataFrame, path: str, key: str, url: str, payload: str, date: str = "20200101000000", version: int = 1) -> None:
    """An ARC folder with one HTTP response for every row."""
    source = df.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{url}`").cast("string").alias("u"),
                       F.col(f"`{payload}`").cast("binary").alias("p"))
    size = _class(F.coalesce(F.octet_length("p"), F.lit(0)))
    # The class of short payloads is written in any case, so that an empty table gives an archive.
    for n in sorted({0, *(r[0] for r in source.select(size.alias("n")).distinct().collect())}):  # a handful of classes
        most = _limits()[n][0]
        _write(source.filter(size == n).mapInArrow(_arc_writer(date, version, most), "value binary"), f"{path}/size={n}", "\n", most)


def _arc_writer(date: str, version: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records of the rows (key, url, payload) of a task, each file of ``most`` records begun by the one that describes it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, offset = 0, 0
        for batch in batches:
            out: list[bytes] = []
            for k, u, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place % most == 0:
                    name = f"{place // most}.arc"
                    out.append(_arc_start(version, date, name))
                    place, offset = place + 1, len(out[-1])
                block = http_block(k, p or b"")
                out.append(_arc_line(version, u, date, "text/html", len(block), offset, name) + block)
                place, offset = place + 1, offset + len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


_CONVERTED = ("source string, offset bigint, key bigint, url string, date string, mime string, bytes bigint, digest binary, "
              "head binary, payload binary")
_CONVERTED_NAMES = [x.split()[0] for x in _CONVERTED.split(", ")]


_AGAIN = "f_key bigint, f_source string, f_offset bigint"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _converted(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Rows of the records of files (path, content), and where the files come with lists of revisits, what each refers to."""
    lists = "again" in files.columns
    names = [*_CONVERTED_NAMES, *(x.split()[0] for x in _AGAIN.split(", "))] if lists else _CONVERTED_NAMES
    kinds = [*_KINDS, pa.int64(), pa.string(), pa.int64()] if lists else _KINDS

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                source = batch.column(0)[n].as_py().rpartition("/")[2]
                again = {x["offset"]: (x["f_key"], x["f_source"], x["f_offset"]) for x in batch.column(2)[n].as_py() or ()} if lists else {}
                rows, size = [], 0
                for r in parse_arc(_opened(batch.column(1)[n].as_py())):
                    head, payload = split_http(r.block) or (b"", r.block)
                    key = http_field(head, b"x-page-id")
                    row = (source, r.offset, int(key) if key else None, r.url, r.date, r.mime, len(payload),
                           hashlib.sha256(payload).digest(), head, payload if with_payload else None)
                    rows.append(row + again.get(r.offset, (None, None, None)) if lists else row)
                    size += len(r.block) if with_payload else 100
                    if size > 8_000_000:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    return files.mapInArrow(run, f"{_CONVERTED}, {_AGAIN}" if lists else _CONVERTED)


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per ARC record: place, key and header values, and digest of the payload, with the payload where asked."""
    return _converted(_contents(spark, path), with_payload)


def arc_to_warc(spark: SparkSession, arc: str, warc: str, least: int = LEAST_REVISIT, broadcast_rows: int = BROADCAST_ROWS,
                hot_rows: int = HOT_ROWS) -> None:
    """Convert an ARC folder: HTTP responses become response or revisit records, other blocks resource records.

    Of responses with equal payloads of at least ``least`` bytes the first by
    (key, date, URL, place) is kept in full. Identifiers come from a record's
    place, dates from the 14 digits, digests from the payload.
    """
    order = F.struct(F.col("key").isNull(), "key", "date", "url", "source", "offset")
    known = read_arc(spark, arc, with_payload=False).filter((F.col("bytes") >= least) & (F.length("head") > 0))
    repeated = durable(
        known.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("f")).filter("n > 1")
        .select("digest", "n", F.col("f.key").alias("f_key"), F.col("f.source").alias("f_source"), F.col("f.offset").alias("f_offset")))
    few = repeated.count() <= broadcast_rows
    if not few:
        # Places of the revisits, joined without payloads and gathered by file: at most RECORDS of each.
        again = attach(known.select("digest", "source", "offset"), repeated, ["digest"], F.col("n"), hot_rows).filter(
            F.col("f_source").isNotNull() & ~((F.col("source") == F.col("f_source")) & (F.col("offset") == F.col("f_offset"))))
        by_file = durable(again.groupBy("source").agg(F.collect_list(F.struct("offset", "f_key", "f_source", "f_offset")).alias("again")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                place = (r["source"], r["offset"])
                again = r["f_source"] is not None and place != (r["f_source"], r["f_offset"])
                http = bool(r["head"])
                out.append(warc_record({
                    "WARC-Type": "revisit" if again else "response" if http else "resource",
                    "WARC-Record-ID": f"<{record_id(*place)}>",
                    "WARC-Date": warc_date(r["date"]),
                    "WARC-Target-URI": r["url"],
                    "WARC-Payload-Digest": f"sha256:{r['digest'].hex()}",
                    "WARC-Profile": PROFILE if again else None,
                    "WARC-Refers-To": f"<{record_id(r['f_source'], r['f_offset'])}>" if again else None,
                    "X-Refers-To-Page": str(r["f_key"]) if again and r["f_key"] is not None else None,
                    "Content-Type": "application/http; msgtype=response" if http else r["mime"],
                }, r["head"] + (b"" if again else r["payload"])))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    for folder, most in _folders(spark, arc):
        place = f"{arc}/{folder}" if folder else arc
        if few:
            rows = read_arc(spark, place)
            joined = rows.join(F.broadcast(repeated), (rows["digest"] == repeated["digest"]) & (rows["bytes"] >= least) & (F.length("head") > 0), "left")
            chosen = joined.select("source", "offset", "url", "date", "mime", rows["digest"], "head", "payload", "f_key", "f_source", "f_offset")
        else:
            # What travels are whole files as they are, compressed, each once to its list of revisits.
            files = _contents(spark, place).withColumn("source", F.substring_index("path", "/", -1)).join(by_file, "source", "left")
            chosen = _converted(files.select("path", "content", "again"))
        _write(chosen.mapInArrow(run, "value binary"), f"{warc}/{folder}" if folder else warc, "\r\n\r\n", most)


def _folders(spark: SparkSession, arc: str) -> list[tuple[str, int]]:
    """Folders by size of an archive written here, with their records of a file; the archive itself where it is another's."""
    root = spark._jvm.org.apache.hadoop.fs.Path(arc)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = [(f"size={n}", most) for n, (most, _) in enumerate(_limits())
           if files.exists(spark._jvm.org.apache.hadoop.fs.Path(root, f"size={n}"))]
    return out or [("", RECORDS)]


_WARC = ("record_id string, record_type string, date string, url string, page_id bigint, payload_bytes bigint, "
         "payload_digest string, refers_to_record string, refers_to bigint, intact boolean, payload binary")
_WARC_NAMES = [x.split()[0] for x in _WARC.split(", ")]


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per WARC record; length and digest are of the full payload, for revisits as their headers state it.

    ``intact`` tells whether the payload that was read has the stated digest (null for revisits).
    """
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
             pa.bool_(), pa.binary()]

    def row(r: WarcRecord) -> tuple:
        get, kind = r.fields.get, r.fields.get("warc-type")
        head, payload = split_http(r.block) or (b"", r.block)
        key, again = http_field(head, b"x-page-id"), kind == "revisit"
        stated = (get("warc-payload-digest") or "").rpartition(":")[2]
        size = int(http_field(head, b"content-length") or 0) if again else len(payload)
        digest = stated if again else hashlib.sha256(payload).hexdigest()
        refers = get("x-refers-to-page")
        return ((get("warc-record-id") or "").strip("<>"), kind, get("warc-date"), get("warc-target-uri"),
                int(key) if key else None, size, digest, (get("warc-refers-to") or "").strip("<>") or None,
                int(refers) if refers else None, None if again else digest == stated, payload if with_payload and not again else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                rows, size = [], 0
                for r in parse_warc(_opened(batch.column(1)[n].as_py())):
                    rows.append(row(r))
                    size += len(r.block) if with_payload else 300
                    if size > 8_000_000:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_WARC_NAMES)

    return _contents(spark, path).mapInArrow(run, _WARC)
