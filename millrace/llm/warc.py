"""WARC archives, dictionary-compressed.

Each archive starts with a skippable Zstandard frame (magic 0x184D2A5D) that holds a
dictionary built from records of that archive; every record after it is a frame of its own,
compressed with that dictionary. Equal payloads of at least `least_revisit` bytes are
stored once: the largest page_id is a response, the others are revisit records that name it.
Archives go to the shared folder under names no other attempt uses; only the archives of
attempts that Spark committed are read back, so a lost executor costs a retry and no more.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, stash

DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        *([("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url else []),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; plain content of the first records where they are too few to train on."""
    if len(samples) >= 8:
        try:
            return zstandard.train_dictionary(size, samples, k=256, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[: size // 4] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writer of one archive: records are held until there are enough for the dictionary."""

    def __init__(self, out, dictionary_bytes: int, sample_bytes: int, level: int):
        self.out, self.held, self.held_bytes, self.options = out, [], 0, (dictionary_bytes, sample_bytes, level)
        self.compressor, self.raw, self.records = None, 0, 0

    def add(self, rec: bytes) -> None:
        self.raw, self.records = self.raw + len(rec), self.records + 1
        if self.compressor is not None:
            self.out.write(self.compressor.compress(rec))
            return
        self.held.append(rec)
        self.held_bytes += len(rec)
        if self.held_bytes >= self.options[1]:
            self.begin()

    def begin(self) -> None:
        size, _, level = self.options
        d = build_dictionary([r[:16384] for r in self.held], size)
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(d.as_bytes())) + d.as_bytes())
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=d)
        for r in self.held:
            self.out.write(self.compressor.compress(r))
        self.held = []

    def close(self) -> None:
        if self.compressor is None:
            self.begin()
        self.out.close()


def read_records(data: bytes):
    """(header dict, block) of every record of an archive."""
    magic, n = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    d = zstandard.ZstdCompressionDict(data[8 : 8 + n])
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=d).stream_reader(io.BytesIO(memoryview(data)[8 + n :]), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            k, _, v = line[:-2].partition(b": ")
            fields[k.decode()] = v.decode("utf-8", "surrogatepass")
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("record end missing")
        yield fields, block


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _qualified(spark, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri


def write_archives(pages: DataFrame, folder: str | None = None, least_revisit: int = 1000, archive_bytes: int = 64 << 20, dictionary_bytes: int = 64 << 10, sample_bytes: int = 6 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of pages(page_id, url, html) and return (archive, records, raw_bytes).

    A null html is an empty payload; a null url is left out. Rows that repeat a response's
    page_id and payload are responses too. An empty table writes no archive.
    """
    spark = pages.sparkSession
    folder = _qualified(spark, folder or new_path(spark, "warc"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    first = rows.where(F.octet_length("html") >= least_revisit).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.concat("sha1", F.lit("")).alias("k"), "first")
    # the join exchanges both sides, so one hot payload's rows can be split over tasks
    marked = rows.withColumn("k", F.concat("sha1", F.lit(""))).join(first, "k", "left").select("page_id", "url", "html", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches):
        disk, root = _filesystem(folder)
        disk.create_dir(root, recursive=True)
        archive, name, done = None, None, []

        def finish():
            archive.close()
            done.append((name, archive.records, archive.raw))

        for b in batches:
            for page_id, url, html, sha1, refers in zip(*(b.column(i).to_pylist() for i in range(2)), b.column(2).cast(pa.binary()), *(b.column(i).to_pylist() for i in range(3, 5))):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    archive = Archive(disk.open_output_stream(f"{root}/{name}", compression=None), dictionary_bytes, sample_bytes, level)
                archive.add(record(page_id, url, html.as_py(), sha1, refers, date))
                if archive.raw >= archive_bytes:
                    finish()
                    archive = None
        if archive is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["archive", "records", "raw_bytes"])

    listed = stash(marked.mapInArrow(run, "archive string, records long, raw_bytes long"), "archives")
    return listed.withColumn("folder", F.lit(folder))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of the listed archives, from the bytes of the files.

    page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to, html (null for
    revisits). A response's digest and size are taken from its payload and must agree with
    its header; a revisit's are those its header and HTTP head state.
    """
    spark = archives.sparkSession
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html binary"

    def number(urn: str | None) -> int | None:
        tail = urn.rpartition(":")[2].rstrip(">") if urn else "none"
        return None if tail == "none" else int(tail)

    def run(batches):
        for b in batches:
            for data in b.column(0):
                got = []
                for fields, block in read_records(data.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    response = fields["WARC-Type"] == "response"
                    if response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    got.append((number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, sha1, fields["WARC-Type"], number(fields.get("WARC-Refers-To")), payload if response else None))
                    if len(got) == 256:
                        yield _rows(got)
                        got = []
                if got:
                    yield _rows(got)

    def _rows(got):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])

    if archives.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(folder).select("content", F.regexp_extract("path", "([^/]+)$", 1).alias("archive"))
    return files.join(archives.select("archive"), "archive", "left_semi").select("content").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    folder = new_path(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
