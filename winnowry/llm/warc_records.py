"""WARC archives through a chunked record table.

A payload is a run of rows (record, chunk number, bytes) of at most ``CHUNK`` bytes each. The rows of a record
follow each other, and each carries the digests of all bytes up to its end, so no step holds a whole payload and the
last row of a record has the payload's digests. Records of equal payloads (equal SHA-1, second digest and size) are
grouped: the one with the largest key is the response, the others are revisits that name it. A payload of more than
one chunk is written in WARC segments, a ``response`` and its ``continuation`` records, which may lie in several
files; reading brings the segments of a record together in order and digests them one after the other.

Archives are gzip files of about FILE_CHUNKS * CHUNK bytes before compression, written by Spark, so they can
lie wherever Spark writes, and a task that runs again leaves one copy. Reading unpacks them piece by piece and checks
every payload digest; a broken archive is an error.

A null payload is empty. A null key comes before all others; among records of equal key and payload one is the
response. Repeated rows are records of their own. Control characters, blanks and characters beyond ASCII in a url are
written percent-encoded, a null url is left out. An empty table gives an archive without records and no rows. Other
columns are not stored.
"""

import base64
import hashlib
import re
import uuid
import zlib
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import materialize, scratch_path

CHUNK = 1 << 18
BUNDLE_CHUNKS, FILE_CHUNKS = 16, 128
LEAST_BYTES = 0
_PRINTABLE = "".join(chr(c) for c in range(0x21, 0x7F))
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digests():
    return hashlib.sha1(), hashlib.blake2b(digest_size=16)


def chunk_table(pages: DataFrame, key: str, url: str, payload: str, chunk: int = CHUNK) -> DataFrame:
    """(r, key, url, chunk, last, data, upto, sha1, second): the record table, stored.

    ``upto``, ``sha1`` and ``second`` stand for all bytes of the record up to the end of the chunk.
    """
    data = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("r"), F.col(key).alias("key"), F.col(url).alias("url"), data.alias("data"))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("data") / chunk).cast("int") - 1)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("r", "key", "url", "chunk", (F.col("chunk") == last).alias("last"), F.substr("data", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("data"))
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("upto", T.LongType()), T.StructField("sha1", T.BinaryType()), T.StructField("second", T.BinaryType())]
    )

    def digest(batches):
        held, upto = None, 0
        for batch in batches:
            sizes, firsts, seconds = [], [], []
            for number, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                if number == 0:
                    held, upto = _digests(), 0
                part = data.as_buffer()
                for h in held:
                    h.update(part)
                upto += part.size
                sizes.append(upto)
                firsts.append(held[0].digest())
                seconds.append(held[1].digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(firsts, pa.binary()), pa.array(seconds, pa.binary())], names=schema.names)

    path = scratch_path(pages.sparkSession, "warc-chunks")
    rows.mapInArrow(digest, schema).write.option("compression", "zstd").parquet(path)
    return pages.sparkSession.read.schema(schema).parquet(path)


def record_types(chunks: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(r, size, digest, refers): each record's payload, and the record that it revisits (null: it is a response)."""
    ends = chunks.filter("last").select("r", "key", F.col("upto").alias("size"), F.col("sha1").alias("digest"), "second")
    same = ["size", "digest", "second"]
    leads = ends.groupBy(*same).agg(F.max(F.struct("key", "r")).alias("lead"))
    refers = F.when((F.col("lead.r") != F.col("r")) & (F.col("size") >= least_bytes), F.col("lead.r"))
    return ends.join(leads, same).select("r", "size", "digest", refers.alias("refers"))


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(fields: list[tuple[str, str]], block: bytes = b"") -> bytes:
    block_digest = _base32(hashlib.sha1(block).digest())
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"WARC-Block-Digest: sha1:{block_digest}", f"Content-Length: {len(block)}", "", ""]
    return b"".join(("\r\n".join(lines).encode(), block, b"\r\n\r\n"))


def write_archives(pages: DataFrame, path: str, key: str, url: str, payload: str, chunk: int = CHUNK, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record for each row."""
    chunks = chunk_table(pages, key, url, payload, chunk)
    types = record_types(chunks, least_bytes)
    rows = chunks.select("r", "key", "url", "chunk", "last", "data").join(types, "r").filter("refers is null or chunk = 0")
    rows = rows.withColumn("data", F.when(F.col("refers").isNull(), F.col("data"))).sortWithinPartitions("r", "chunk")
    archive = uuid.uuid4()
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def name(r, part=0) -> str:
        return f"<urn:uuid:{uuid.uuid5(archive, f'{r}/{part}')}>"

    def segment(r, key, url, number, last, data, size, digest, refers) -> bytes:
        if number:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", name(r, number)), ("WARC-Segment-Origin-ID", name(r))]
        else:
            fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", name(r))]
        fields.append(("WARC-Date", date))
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        if not number:
            if url is not None:
                fields.append(("WARC-Target-URI", quote(url, safe=_PRINTABLE)))
            if key is not None:
                fields.append(("Source-Key", quote(str(key))))
            fields += [("WARC-Payload-Digest", f"sha1:{_base32(digest)}"), ("Content-Type", "application/http; msgtype=response")]
        if refers is not None:
            return _record([*fields, ("WARC-Profile", _IDENTICAL), ("WARC-Refers-To", name(refers))], head)
        if number or not last:
            fields.append(("WARC-Segment-Number", str(number + 1)))
        if number and last:
            fields.append(("WARC-Segment-Total-Length", str(len(head) + size)))
        return _record(fields, data if number else head + data)

    def bundles(batches):
        held, size, made = [], 0, 0
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if not held and made % (FILE_CHUNKS // BUNDLE_CHUNKS) == 0:
                    held.append(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]))
                held.append(segment(*(row[c] for c in ("r", "key", "url", "chunk", "last", "data", "size", "digest", "refers"))))
                size += len(held[-1])
                if size >= BUNDLE_CHUNKS * chunk:
                    yield close(held)
                    held, size, made = [], 0, made + 1
        if held:
            yield close(held)

    def close(held):
        # Spark's writer ends each row with the final line end.
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-2]], pa.binary())], ["bundle"])

    files = rows.mapInArrow(bundles, "bundle binary").select(F.col("bundle").cast("string"))
    files.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_CHUNKS // BUNDLE_CHUNKS).text(path)


class _Unpacked:
    """The bytes of a file, unpacked piece by piece; at most a piece and what was asked for is held."""

    def __init__(self, content: bytes, piece: int):
        self.rest, self.piece = memoryview(content), piece
        self.packed = content[:2] == b"\x1f\x8b"
        self.unpack = zlib.decompressobj(31) if self.packed else None
        self.held = bytearray()

    def more(self) -> bool:
        if not self.packed:
            self.held += self.rest[: self.piece]
            self.rest = self.rest[self.piece :]
            return len(self.held) > 0
        before = len(self.held)
        while len(self.rest) and len(self.held) == before:
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            self.held += self.unpack.decompress(self.rest, self.piece)
            left = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            self.rest = self.rest[len(self.rest) - len(left) :]
        return len(self.held) > before

    def line(self, end: bytes) -> bytes | None:
        """Up to the end mark; None where the file ends."""
        at = 0
        while (i := self.held.find(end, at)) < 0:
            at = max(0, len(self.held) - len(end))
            if not self.more():
                return None
        out = bytes(self.held[:i])
        del self.held[: i + len(end)]
        return out

    def parts(self, n: int):
        """The next n bytes in pieces."""
        while n:
            if not self.held and not self.more():
                raise ValueError("an archive ends inside a record")
            part = bytes(self.held[: min(n, self.piece)])
            del self.held[: len(part)]
            n -= len(part)
            yield part


def _records(content: bytes, piece: int):
    """(fields, pieces of the block) of each record of a file; the pieces must be read before the next record."""
    file = _Unpacked(content, piece)
    while (head := file.line(b"\r\n\r\n")) is not None:
        lines = head.decode().lstrip("\r\n").split("\r\n")
        if not re.fullmatch(r"WARC/1\.\d", lines[0]):
            raise ValueError("no WARC record where one should begin")
        fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        yield fields, file.parts(int(fields["content-length"]))
        if b"".join(file.parts(4)) != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")


def _payload(pieces, of_http: bool):
    """The pieces without the head of the HTTP message."""
    head = b"" if of_http else None
    for part in pieces:
        if head is None:
            yield part
            continue
        head += part
        if (i := head.find(b"\r\n\r\n")) >= 0:
            yield head[i + 4 :]
            head = None


def read_chunks(spark: SparkSession, path: str, piece: int = CHUNK) -> DataFrame:
    """(record, kind, key, refers, segment, piece, data, size, sha1, said): rows of all records in the files.

    A record in one segment is one row with size and digest; the pieces of a segmented one are rows with their bytes.
    """
    names = ["record", "kind", "key", "refers", "segment", "piece", "data", "size", "sha1", "said"]
    kinds = [pa.string()] * 4 + [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.string()]

    def rows_of(content):
        for fields, pieces in _records(content, piece):
            kind = fields["warc-type"]
            if kind not in ("response", "revisit", "continuation"):
                for _ in pieces:
                    pass
                continue
            key = fields.get("source-key")
            said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            record = fields.get("warc-segment-origin-id", fields["warc-record-id"])
            own = [record, kind, None if key is None else unquote(key), fields.get("warc-refers-to")]
            segment = int(fields.get("warc-segment-number", 0))
            block, first, size = hashlib.sha1(), hashlib.sha1(), 0

            def watched(pieces=pieces, block=block):
                for part in pieces:
                    block.update(part)
                    yield part

            for i, part in enumerate(_payload(watched(), kind != "continuation")):
                if segment:
                    yield [*own, segment, i, part, None, None, said]
                else:
                    first.update(part)
                    size += len(part)
            if fields.get("warc-block-digest", f"sha1:{_base32(block.digest())}") != f"sha1:{_base32(block.digest())}":
                raise ValueError(f"the block of record {fields['warc-record-id']} does not have its digest")
            if not segment:
                yield [*own, 0, 0, None, size, first.digest(), said]

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for row in rows_of(content.as_py()):
                    held.append(row)
                    size += 256 + len(row[6] or b"")
                    if size >= BUNDLE_CHUNKS * piece:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds, strict=True)], names)

    schema = "record string, kind string, key string, refers string, segment int, piece int, data binary, size bigint, sha1 binary, said string"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, kind, key, refers, size, digest) of all records in the files, stored; digests are checked."""
    names = ["record", "kind", "key", "refers", "size", "digest"]

    def fold(batches):
        now, first, size = None, None, 0

        def done():
            if now[5] is not None and now[5] != _base32(first.digest()):
                raise ValueError(f"the payload of record {now[0]} does not have its digest")
            return [now[0], now[1], now[2], now[3], size, _base32(first.digest())]

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("record", "kind", "key", "refers", "segment", "said", "size", "sha1")]
            for record, kind, key, refers, segment, said, whole, sha1, data in zip(*columns, batch.column("data"), strict=True):
                if now is not None and record != now[0]:
                    out.append(done())
                    now = None
                if not segment:
                    if kind == "response" and said is not None and said != _base32(sha1):
                        raise ValueError(f"the payload of record {record} does not have its digest")
                    out.append([record, kind, key, refers, whole, _base32(sha1)])
                    continue
                if now is None:
                    now, first, size = (record, kind, key, refers, segment, said), hashlib.sha1(), 0
                part = data.as_buffer()
                first.update(part)
                size += part.size
            yield made(out)
        if now is not None:
            yield made([done()])

    def made(rows):
        columns = list(zip(*rows)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 4 + [pa.int64(), pa.string()], strict=True)], names)

    rows = read_chunks(spark, path).repartition("record").sortWithinPartitions("record", "segment", "piece")
    return materialize(rows.mapInArrow(fold, "record string, kind string, key string, refers string, size bigint, digest string"), "warc-records")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(key, size, digest, kind, refers_to) of every record; a revisit has the payload of the response it names."""
    rows = read_records(spark, path)
    own = rows.filter("kind = 'response'")
    whole = own.select(F.col("record").alias("refers"), F.col("key").alias("refers_to"), "size", "digest")
    again = rows.filter("kind = 'revisit'").select("key", "kind", "refers").join(whole, "refers")
    return own.select("key", "size", "digest", "kind", F.lit(None).cast("string").alias("refers_to")).unionByName(again.select("key", "size", "digest", "kind", "refers_to"))


def op13_warc_records(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, "page_id", "url", "html")
    return summary(spark, path).select(
        F.col("key").cast("bigint").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("refers_to").cast("bigint").alias("refers_to"),
    )


# Base 32 of a hex digest: ten hex digits are eight characters of five bits.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substr(digest, 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1)), '')"""
SQL = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS lead FROM pages)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> lead THEN lead END AS refers_to FROM p"""
