"""WARC archives: writing, normalising, reading back by index.

``write_archives`` writes a record a page with Spark's text writer, its record
separator being the two line ends that close a WARC record. Compressed, such a
file is one gzip stream from end to end, as careless crawlers make them: no
record can be read without inflating all before it.

``normalise`` mends that. Each file is inflated once, as a stream, by one task;
a parser cuts the stream into records by their Content-Length, and each record
is deflated as a gzip member of its own. The same task counts the bytes, so one
pass writes the new archive and, beside it, a sidecar index: a line of JSON a
record with the offset and length of its member, a gzip member each as well.
The text writer puts a separator behind every row: here that is an empty gzip
member, so both are valid gzip files.

``read_archives`` reads records by the index: it goes to each offset, inflates
that member alone and checks it against what the index says.

All files are written by Spark's writers below a folder of any file system
Spark knows. A task holds a record, a batch of members, or (in reading) an
archive, whose size ``records_per_file`` bounds.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import col, lit

from flowsieve.llm.arrow_text import small_batches
from flowsieve.llm.hot_keys import look_up
from flowsieve.session import work_dir, written as stored

EOL = "\r\n"
END = EOL + EOL
# a gzip member that inflates to nothing
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcConfig:
    """``least_bytes``: shorter payloads are never revisits. ``records_per_file``
    bounds an archive. ``date``: WARC-Date of the records, as the pages carry
    none. ``batch_bytes``: deflated records that a task hands on at a time."""

    least_bytes: int = 100
    records_per_file: int = 2_000
    date: str = "2024-01-01T00:00:00Z"
    level: int = 6
    batch_bytes: int = 4 << 20


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(lit("urn:uuid:"), F.concat_ws("-", *cut))


def _header(name: str, value: Column) -> Column:
    """The header line, or nothing for a null value. Line ends are escaped."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(lit(f"{name}: "), safe, lit(EOL)), lit(""))


def page_records(pages: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """(record string) of each page, without the line ends that close it.

    Of equal payloads (by SHA-256) of at least ``least_bytes`` bytes, the rows
    with the smallest page_id are responses, the others revisits that refer to
    them and hold no payload. Null html is an empty payload, a null url has no
    WARC-Target-URI, a null page_id no X-Page-Id and is never the smallest one
    unless the payload has no other (then all its rows are responses).
    """
    html = F.coalesce(col("html").cast("string"), lit(""))
    # the digests first, without the payloads
    facts = stored(pages.select(col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"),
                                F.octet_length(html).cast("long").alias("bytes")), "warc-digests")
    shared = stored(facts.where(col("bytes") >= cfg.least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
        .select("digest", "first_id"), "warc-shared")
    rows = pages.select(col("page_id").cast("long").alias("page_id"), col("url").cast("string").alias("url"),
                        html.alias("html"), F.sha2(html, 256).alias("digest"))
    if shared.head(1):
        rows = look_up(rows, shared, "digest", counted=facts.where(col("bytes") >= cfg.least_bytes))
    else:
        rows = rows.withColumn("first_id", lit(None).cast("long"))

    digest = F.concat(lit("sha256:"), col("digest"))
    page = F.coalesce(col("page_id").cast("string"), lit("-"))
    revisit = col("first_id").isNotNull() & ~col("page_id").eqNullSafe(col("first_id"))
    http = F.concat(lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
                    F.octet_length("html").cast("string"), lit(END))
    block = F.concat(http, F.when(revisit, lit("")).otherwise(col("html")))
    head = F.concat(
        lit("WARC/1.1" + EOL),
        _header("WARC-Type", F.when(revisit, lit("revisit")).otherwise(lit("response"))),
        _header("WARC-Record-ID", F.concat(lit("<"), _uuid(page, "digest"), lit(">"))),
        _header("WARC-Date", lit(cfg.date)), _header("WARC-Target-URI", col("url")),
        _header("X-Page-Id", col("page_id").cast("string")),
        _header("WARC-Payload-Digest", digest),
        _header("WARC-Refers-To", F.when(revisit, F.concat(lit("<"), _uuid(col("first_id").cast("string"), "digest"), lit(">")))),
        _header("WARC-Profile", F.when(revisit, lit(REVISIT_PROFILE))),
        _header("Content-Type", lit("application/http;msgtype=response")),
        lit("Content-Length: "), F.octet_length(block).cast("string"), lit(END))
    return rows.select(F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, path: str, cfg: WarcConfig = WarcConfig()) -> None:
    """Write ``page_records`` as WARC files that are one gzip stream each."""
    (page_records(pages, cfg).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", cfg.records_per_file).text(path))


class RecordParser:
    """Cuts a stream of bytes, given in pieces, into WARC records."""

    def __init__(self):
        self.pieces: list[bytes] = []
        self.size = 0
        self.need = 0  # bytes to have before the next attempt
        self.head: tuple[dict, int] | None = None

    def feed(self, piece: bytes):
        """(headers, record bytes with its closing line ends) of each record
        that the piece completes."""
        self.pieces.append(piece)
        self.size += len(piece)
        if self.size < self.need:
            return
        data = self.pieces[0] if len(self.pieces) == 1 else b"".join(self.pieces)
        at = 0
        while True:
            if self.head is None:
                while data.startswith(b"\r\n", at):  # line ends beyond those that close a record
                    at += 2
                cut = data.find(b"\r\n\r\n", at)
                if cut < 0:
                    self.need = 0
                    break
                self.head = self._headers(data[at:cut]), cut + 4 - at
            headers, skip = self.head
            end = at + skip + int(headers["content-length"])
            if len(data) < end + 4:
                self.need = end + 4 - at
                break
            if data[end:end + 4] != b"\r\n\r\n":
                raise ValueError(f"a WARC record does not end where its Content-Length says: {headers}")
            yield headers, data[at:end + 4]
            at, self.head = end + 4, None
        self.pieces = [data[at:]]
        self.size = len(data) - at

    @staticmethod
    def _headers(text: bytes) -> dict:
        lines = text.decode("utf-8", "replace").split(EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not the start of a WARC record: {lines[0][:80]!r}")
        found = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        if not found.get("content-length", "").isdigit():
            raise ValueError(f"a WARC record without a Content-Length: {found}")
        return found

    def close(self) -> None:
        if b"".join(self.pieces).strip(b"\r\n"):
            raise ValueError("the stream ends inside a WARC record")


def member(record: bytes, level: int = 6) -> bytes:
    """The record as a gzip member; the same bytes for the same record."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


INDEX = ["position", "length", "record_length", "record_type", "record_id", "refers_to_id", "page_id", "target_uri",
         "payload_digest"]


def _angled(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _members(cfg: WarcConfig):
    fields = pa.schema([("kind", pa.string()), ("archive", pa.string()), ("seq", pa.int64()), ("value", pa.binary())])

    def run(batches):
        at, seq, position, parser, rows, held = None, 0, 0, None, [], 0

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
        for batch in batches:
            for path, chunk in zip(batch.column("path"), batch.column("chunk")):
                path = path.as_py()
                if path != at:
                    if parser:
                        parser.close()
                    at, seq, position, parser = path, 0, 0, RecordParser()
                    name = at.rsplit("/", 1)[-1].split(".")[0]
                for h, record in parser.feed(chunk.as_py() + b"\r\n\r\n"):
                    packed = member(record, cfg.level)
                    page = h.get("x-page-id")
                    entry = dict(zip(INDEX, (
                        position, len(packed), len(record), h.get("warc-type"), _angled(h.get("warc-record-id")),
                        _angled(h.get("warc-refers-to")), int(page) if page else None, h.get("warc-target-uri"),
                        (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None)))
                    line = member(json.dumps(entry).encode() + b"\n", cfg.level)
                    rows += [("archives", name, seq, packed), ("index", name, seq, line)]
                    seq, position, held = seq + 1, position + len(packed) + len(EMPTY_MEMBER), held + len(packed) + len(line)
                    if held >= cfg.batch_bytes:
                        yield emit()
                        rows, held = [], 0
        if parser:
            parser.close()
        if rows:
            yield emit()
    return run


def normalise(spark: SparkSession, source: str, target: str, cfg: WarcConfig = WarcConfig()) -> None:
    """Rewrite the gzip WARC files in folder ``source`` with a member a record.

    Writes ``target/kind=archives/archive=<name>`` and
    ``target/kind=index/archive=<name>``, a file each for every file of the
    source. A gzip file cannot be split, so a task reads a file from its start
    to its end; one that ends inside a record, or whose records do not end where
    they say, fails the job with the record's headers.
    """
    small_batches(spark)
    chunks = (spark.read.option("lineSep", END).text(source)
              .select(col("_metadata.file_path").alias("path"), col("value").cast("binary").alias("chunk")))
    rows = chunks.mapInArrow(_members(cfg), "kind string, archive string, seq long, value binary")
    # a task has all rows of its files; the sort keeps their order in the writer
    (rows.sortWithinPartitions("kind", "archive", "seq").select("kind", "archive", col("value").cast("string").alias("value"))
     .write.partitionBy("kind", "archive").option("encoding", "ISO-8859-1")
     .option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(target))


def inflate_member(archive: bytes, position: int, length: int) -> bytes:
    """The record whose member starts at ``position``; that member alone is read."""
    inflate = zlib.decompressobj(31)
    out = inflate.decompress(archive[position:position + length])
    if not inflate.eof or inflate.unused_data:
        raise ValueError(f"no gzip member of {length} bytes at {position}")
    return out


def index_entries(sidecar: bytes) -> list[dict]:
    """The index's entries, in the order of the archive."""
    return [json.loads(line) for line in gzip.decompress(sidecar).splitlines()]


_READ = ("page_id long, record_type string, record_id string, refers_to_id string, target_uri string, "
         "payload_bytes long, payload_digest string, payload binary")


def _read(keep_payload: bool, batch_bytes: int):
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _READ.split(", ")])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    def run(batches):
        for batch in batches:
            for content, sidecar in zip(batch.column("content"), batch.column("sidecar")):
                content, rows, held = memoryview(content.as_buffer()), [], 0
                for e in index_entries(sidecar.as_py()):
                    record = inflate_member(content, e["position"], e["length"])
                    headers, whole = next(RecordParser().feed(record))
                    if len(whole) != e["record_length"] or _angled(headers.get("warc-record-id")) != e["record_id"]:
                        raise ValueError(f"the index does not fit the archive: {e}")
                    block = record[record.index(b"\r\n\r\n") + 4:-4]
                    payload = block[block.index(b"\r\n\r\n") + 4:] if b"\r\n\r\n" in block else block
                    full = headers.get("warc-type") != "revisit"
                    rows.append((e["page_id"], headers.get("warc-type"), e["record_id"], _angled(headers.get("warc-refers-to")),
                                 headers.get("warc-target-uri"), len(payload) if full else None,
                                 hashlib.sha256(payload).hexdigest() if full else e["payload_digest"],
                                 payload if full and keep_payload else None))
                    held += len(payload) if keep_payload else 0
                    if held >= batch_bytes or len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)
    return run


def read_archives(spark: SparkSession, target: str, payloads: bool = True, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Records of normalised archives, each inflated from its own member at the
    offset that the index gives: page_id, record_type, record_id, refers_to_id,
    target_uri, payload_bytes, payload_digest (SHA-256 of the payload as read;
    of a revisit, which has none, as its header says), payload. The payload is
    the record's block behind the first empty line (of an HTTP message, its body)."""
    files = spark.read.format("binaryFile").load(target)
    if "kind" not in files.columns:  # no record was written
        return spark.createDataFrame([], _READ)
    name = F.regexp_extract("path", "archive=([^/]*)/", 1).alias("archive")
    archives = files.where("kind = 'archives'").select(name, "content")
    sidecars = files.where("kind = 'index'").select(name, col("content").alias("sidecar"))
    return archives.join(sidecars, "archive").select("content", "sidecar").mapInArrow(_read(payloads, cfg.batch_bytes), _READ)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def archive_report(pages: DataFrame, cfg: WarcConfig = WarcConfig(), folder: str | None = None,
                   keep_raw: bool = False) -> DataFrame:
    """Write the pages as WARC, normalise the archives, read them back: page_id,
    payload_bytes, payload_digest, record_type, refers_to (the response's
    page_id) of each record.

    Needs page_id, url and html; other columns are not read. What nulls, short
    payloads and equal rows do is said at ``page_records``; rows that repeat
    page_id and html are records of their own. The normalised files stay below
    ``folder`` (of the session's checkpoint folder unless given), the gzip
    streams they replace only if ``keep_raw``. An empty table writes no record
    and gives an empty table.
    """
    spark = pages.sparkSession
    folder = folder or work_dir(spark, "warc")
    write_archives(pages, f"{folder}/raw", cfg)
    normalise(spark, f"{folder}/raw", f"{folder}/normalised", cfg)
    if not keep_raw:
        _delete(spark, f"{folder}/raw")
    read = stored(read_archives(spark, f"{folder}/normalised", payloads=False).drop("payload"), "warc-read")
    responses = (read.where("record_type = 'response'").groupBy(col("record_id").alias("refers_to_id"))
                 .agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("full_bytes"),
                      F.min("payload_digest").alias("full_digest")))
    found = look_up(read, responses, "refers_to_id")
    return found.select("page_id", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"),
                        F.coalesce("full_digest", "payload_digest").alias("payload_digest"), "record_type", "refers_to")
