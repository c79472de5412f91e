"""Media columns: payloads as 8-bit sound in ZIP archives, read back by a data source of our own.

A text's UTF-8 bytes, padded with spaces to a multiple of FRAME, become the samples of a mono 8-bit WAV file, one
deflated member of an archive for each row. The tasks that scan the documents write archives under names of their own;
the manifest lists those of tasks that ended well.

The data source "media_archive" plans byte ranges over the archives without opening them. A task takes the members whose
headers begin in its range from the archive's directory, fetches neighbours together, and streams the media out in
Arrow batches of bounded size. A member that fails its checksum or can't be read is fetched again by itself, from a newly
opened file at the member's offset, before the task gives up.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioscope.llm.shared import body, python_fs, scratch, table

#: Pad byte, multiple of the payload's length, bytes of a WAV header, samples a second.
PAD, FRAME, HEADER_BYTES, RATE = b" ", 192, 44, 8000
#: Bytes of an archive, of a planned range, of an Arrow batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 256 << 20, 16 << 20, 4 << 20
LEVEL = 1
ATTEMPTS = 3


def payload_of(text: str) -> bytes:
    """UTF-8 with spaces up to a positive multiple of FRAME."""
    data = text.encode("utf-8", "surrogatepass")
    return data + PAD * ((-len(data)) % FRAME or (0 if data else FRAME))


def wav(samples: bytes) -> bytes:
    """A mono 8-bit PCM WAV file."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    kind, _, form, fmt, size, pcm, channels, _, _, _, bits, mark, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER_BYTES])
    if (kind, form, fmt, size, pcm, channels, bits, mark) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 8, b"data"):
        raise ValueError("not a mono 8-bit PCM WAV file")
    return media[HEADER_BYTES : HEADER_BYTES + n]


def write_archives(docs: DataFrame, folder: str) -> list[dict]:
    """Writes every whole text of docs (doc_id, text) to archives and _manifest.json in folder; returns the manifest.

    A null text is empty: FRAME spaces. Members are named by doc_id (null if there is none), length of the text in bytes
    and place in the archive, so repeated rows are members of their own. An empty table gives an empty manifest. Only
    doc_id and text are read.
    """

    def run(batches):
        fs, path = python_fs(folder)
        stream = archive = name = None
        members = 0

        def close():
            archive.close()
            size = stream.tell()
            stream.close()
            return pa.RecordBatch.from_pylist([{"file": name, "bytes": size, "members": members}], pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if archive is None:
                    name, members = f"{uuid.uuid4().hex}.zip", 0
                    stream = fs.open_output_stream(f"{path}/{name}", compression=None)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=LEVEL)
                text = text.as_py()
                n, samples = len(text.encode("utf-8", "surrogatepass")), payload_of(text)
                archive.writestr(zipfile.ZipInfo(f"{'null' if doc_id is None else doc_id}/{n}/{members}.wav"), wav(samples), zipfile.ZIP_DEFLATED, LEVEL)
                members += 1
                if stream.tell() >= ARCHIVE_BYTES:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    written = rows.mapInArrow(run, "file string, bytes long, members long").collect()
    manifest = sorted(({"file": r.file, "bytes": r.bytes, "members": r.members} for r in written), key=lambda e: e["file"])
    fs, path = python_fs(folder)
    with fs.open_output_stream(f"{path}/_manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


class ByteRange(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class MediaArchiveSource(DataSource):
    """Rows of the archives under option path: doc_id, n_bytes, archive, offset, media. Option rangeBytes sets the planned ranges."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("media", T.BinaryType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MediaArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


class MediaArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[ByteRange]:
        fs, path = python_fs(self.folder)
        with fs.open_input_stream(f"{path}/_manifest.json") as f:
            manifest = json.loads(f.read())
        return [ByteRange(e["file"], a, a + self.range_bytes) for e in manifest for a in range(0, e["bytes"], self.range_bytes)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, path = python_fs(self.folder)
        where = f"{path}/{partition.file}"
        fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary())])
        rows, held = [], 0
        for info, media in members_between(fs, where, partition.start, partition.end):
            doc_id, n, _ = info.filename.split("/")
            rows.append({"doc_id": None if doc_id == "null" else int(doc_id), "n_bytes": int(n), "archive": partition.file, "offset": info.header_offset, "media": media})
            held += len(media)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, fields)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, fields)


def members_between(fs, where: str, start: int, end: int) -> Iterator[tuple[zipfile.ZipInfo, bytes]]:
    """Directory entries whose headers begin in [start, end), with their plain bytes; neighbours are fetched together."""
    with fs.open_input_file(where) as source:
        with zipfile.ZipFile(source) as archive:
            entries, directory = sorted(archive.infolist(), key=lambda i: i.header_offset), archive.start_dir
        ends = [i.header_offset for i in entries[1:]] + [directory]
        mine = [(i, e) for i, e in zip(entries, ends) if start <= i.header_offset < end]
        at = 0
        while at < len(mine):
            first, to = mine[at][0].header_offset, at + 1
            while to < len(mine) and mine[to][1] - first <= BATCH_BYTES:
                to += 1
            try:
                source.seek(first)
                block = source.read(mine[to - 1][1] - first)
            except OSError:
                block = b""
            for info, stop in mine[at:to]:
                try:
                    yield info, plain_bytes(info, block[info.header_offset - first : stop - first])
                except (ValueError, struct.error, zlib.error):
                    yield info, fetched_again(fs, where, info, stop)
            at = to


def fetched_again(fs, where: str, info: zipfile.ZipInfo, stop: int) -> bytes:
    """One member by its offset, from a newly opened file, up to ATTEMPTS times."""
    for left in range(ATTEMPTS - 1, -1, -1):
        try:
            with fs.open_input_file(where) as source:
                source.seek(info.header_offset)
                return plain_bytes(info, source.read(stop - info.header_offset))
        except (OSError, ValueError, struct.error, zlib.error) as error:
            if not left:
                raise OSError(f"member {info.filename} at {info.header_offset} of {where}: {error}") from error
    raise AssertionError


def plain_bytes(info: zipfile.ZipInfo, raw: bytes) -> bytes:
    """A member's bytes from its local header on, checked against the directory's length and CRC-32."""
    name, extra = struct.unpack("<HH", raw[26:30])
    if raw[:4] != b"PK\x03\x04":
        raise ValueError("no member begins here")
    data = raw[30 + name + extra : 30 + name + extra + info.compress_size]
    plain = zlib.decompressobj(-15).decompress(data) if info.compress_type == zipfile.ZIP_DEFLATED else data
    if len(plain) != info.file_size or zlib.crc32(plain) != info.CRC:
        raise ValueError("length or checksum differs")
    return plain


def feature_of(samples: bytes) -> str:
    """Mean, root mean square about silence (128), share of crossings of silence, and the entropy of the sample values in bits."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    n = len(x)
    if not n:
        return "mean=0.0000;rms=0.0000;crossings=0.0000;entropy=0.0000"
    share = np.bincount(x + 128, minlength=256) / n
    share = share[share > 0]
    crossings = np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)) / max(1, n - 1)
    return f"mean={x.sum() / n:.4f};rms={np.sqrt((x * x).sum() / n):.4f};crossings={crossings:.4f};entropy={max(0.0, -(share * np.log2(share)).sum()):.4f}"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").option("path", folder).load()


def with_features(media: DataFrame) -> DataFrame:
    """media (of read_archives) with payload (binary) and feature; what is stored is checked to be such a WAV file."""

    @F.arrow_udf("string")
    def feature(stored: pa.Array) -> pa.Array:
        return pa.array([feature_of(samples_of(m)) for m in stored.to_pylist()], pa.string())

    return media.withColumns({"payload": F.substring("media", HEADER_BYTES + 1, 2**31 - 1), "feature": feature("media")})


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "media")
    write_archives(table(spark, sf_dir, "documents"), folder)
    rows = with_features(read_archives(spark, folder))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
