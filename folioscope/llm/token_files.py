"""Token ids of documents in seekable zstandard files.

A file holds one independent zstandard frame for each document, in ascending order of doc_id, then a skippable frame
with the documents' ids and token counts, then the public format's seek table: for each frame its compressed and its plain
size and the low 32 bits of the XXH64 of its plain bytes. A reader takes the tables from the end of a file and fetches
and decompresses only the frames it wants. A frame's plain bytes are the ids as little-endian unsigned 32-bit integers.

Documents are range-partitioned by doc_id, encoded and written by the task that holds the range, under a name of its own;
the manifest lists the files of the tasks that ended well, so a task that is run again leaves no trace in it.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import body, kept, python_fs, scratch, table
from folioscope.llm.words import Words

#: Fixed values of the public seekable format and of skippable frames.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: The id appended to each document.
END_ID = 2
LEVEL = 1
#: Words, and runs of words, whose ids are kept; bytes of texts whose words are looked up together.
WORDS, RUNS_KEPT, TOGETHER = 300_000, 700_000, 4_000_000
#: Longer words and runs aren't kept, so that what is kept is bounded in bytes.
KEPT_BYTES = 64
#: What the tokenizer splits a word into, once normalised.
ASCII_RUNS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Bytes that a reader fetches at once.
FETCH = 4 << 20


def byte_characters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level model: printable Latin-1 for itself, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    return dict(zip(sorted(set(range(256)).difference(plain)), range(256, 512)))


BYTE_CHARACTERS = byte_characters()


class Known(dict):
    """Values by key, found when they are first asked for."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, key):
        value = self.find(key)
        if len(key) <= KEPT_BYTES:
            self[key] = value
        return value


class WordEncoder:
    """The tokenizers library's ids of a text, word by word.

    The tokenizer normalises (NFC, lower case), splits at white space, then into contractions, runs of letters, single
    digits and runs of other signs, and never merges across these. So a text's ids are those of its words one after the
    other, and a word's ids those of its runs. Words are found and told apart in numpy, and each distinct one is looked up once for many
    texts; runs are asked of the library's model once while they are in the cache. Words that normalisation could change beyond plain lower case, and texts that hold an added token of the tokenizer such as
    <|endoftext|>, go through the whole library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes] = {}
        self.runs = Known(self.run)
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in kept("token_files"):
            kept("token_files")[path] = cls(path)
        return kept("token_files")[path]

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def run(self, run: bytes) -> bytes:
        # ASCII letters stand for themselves
        text = run.decode("ascii") if run.isalpha() else run.decode("latin-1").translate(BYTE_CHARACTERS)
        of = self.bytes_of
        return b"".join([of[t.id] for t in self.model.tokenize(text)])

    def word(self, word: bytes) -> bytes:
        if word.isalpha():
            return self.runs[word.lower()]
        if word.isascii():
            parts = ASCII_RUNS.findall(word.lower())
        else:
            text = word.decode("utf-8", "surrogatepass")
            if not unicodedata.is_normalized("NFC", text) or "\u03a3" in text or "\u0130" in text:  # lower case depends on the place, or is longer
                return self.library(text)
            low = text.lower()
            if low.isalpha():
                return self.runs[low.encode("utf-8", "surrogatepass")]
            parts = [p.encode("utf-8", "surrogatepass") for p in RUNS.findall(low)]
        return b"".join(map(self.runs.__getitem__, parts))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids with END_ID of each UTF-8 text, as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= TOGETHER):
                size += len(texts[to])
                to += 1
            yield from self._together(texts[at:to])
            at = to

    def _together(self, texts: list[bytes]) -> Iterator[bytes]:
        """Each distinct word of the texts is looked up once; their ids are then gathered."""
        end = END_ID.to_bytes(4, "little")
        whole = {i: self.library(t.decode("utf-8", "surrogatepass")) for i, t in enumerate(texts) if any(a in t for a in self.added)}
        words = Words([b"" if i in whole else t for i, t in enumerate(texts)])  # parted at ASCII white space alone
        if len(self.words) > WORDS:
            self.words.clear()
        if len(self.runs) > RUNS_KEPT:
            self.runs.clear()
        first, inverse = words.distinct()
        found, known, data = [], self.words, words.bytes.tobytes()
        for start, size in zip(words.first[first].tolist(), words.sizes[first].tolist()):
            word = data[start : start + size]
            ids = known.get(word)
            if ids is None:
                ids = self.word(word)
                if size <= KEPT_BYTES:
                    known[word] = ids
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        counts = sizes[inverse]
        ends = np.cumsum(counts)
        tokens = flat[np.arange(int(counts.sum())) + np.repeat(starts[inverse] - (ends - counts), counts)]
        cuts = np.append(0, ends)[np.cumsum(words.lengths)].tolist()
        for i, (a, b) in enumerate(zip([0, *cuts[:-1]], cuts)):
            yield whole.get(i, tokens[a:b].tobytes()) + end


class FrameWriter:
    """Writes frames, the index and the seek table to an open stream."""

    def __init__(self, stream):
        import xxhash
        import zstandard

        self.stream, self.compress, self.digest = stream, zstandard.ZstdCompressor(level=LEVEL).compress, xxhash.xxh64_intdigest
        self.seek, self.doc_ids, self.counts = bytearray(), [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compress(ids)
        self.stream.write(frame)
        self.seek += struct.pack("<III", len(frame), len(ids), self.digest(ids) & 0xFFFFFFFF)
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)

    def finish(self) -> None:
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        index = np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + known.tobytes() + np.array(self.counts, "<u4").tobytes()
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.seek += struct.pack("<III", len(index) + 8, 0, self.digest(b"") & 0xFFFFFFFF)
        footer = struct.pack("<IBI", len(self.seek) // 12, CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(self.seek) + len(footer)) + self.seek + footer)


class FrameReader:
    """Reads the tables at the end of an open random-access file, then the frames asked for."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * frames)
        table = np.frombuffer(source.read(12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.sizes, self.checksums = table[:-1, 1], table[:-1, 2]
        source.seek(int(self.at[frames - 1]) + 8)
        index, n = source.read(int(table[-1, 0]) - 8), frames - 1
        ids, known = np.frombuffer(index[: 8 * n], "<i8"), np.frombuffer(index[8 * n : 9 * n], np.uint8)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.counts = np.frombuffer(index[9 * n :], "<u4").astype(np.int64)

    def frames(self, wanted: range | list[int]) -> Iterator[tuple[int, bytes]]:
        """(position, plain bytes) of the frames at ascending positions; neighbours are fetched together, about FETCH bytes at once."""
        import xxhash
        import zstandard

        plain, wanted, i = zstandard.ZstdDecompressor(), list(wanted), 0
        while i < len(wanted):
            j = i + 1
            while j < len(wanted) and wanted[j] == wanted[j - 1] + 1 and self.at[wanted[j] + 1] - self.at[wanted[i]] <= FETCH:
                j += 1
            start = int(self.at[wanted[i]])
            self.source.seek(start)
            held = memoryview(self.source.read(int(self.at[wanted[j - 1] + 1]) - start))
            for k in wanted[i:j]:
                ids = plain.decompress(held[int(self.at[k]) - start : int(self.at[k + 1]) - start], max_output_size=int(self.sizes[k]))
                if len(ids) != self.sizes[k] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.checksums[k]:
                    raise ValueError(f"frame {k} does not match its checksum")
                yield k, ids
            i = j

    def of(self, doc_ids: set[int | None]) -> Iterator[tuple[int | None, bytes]]:
        for k, ids in self.frames([k for k, d in enumerate(self.doc_ids) if d in doc_ids]):
            yield self.doc_ids[k], ids


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str) -> list[dict]:
    """Encodes every whole text and writes the files and _manifest.json to folder; returns the manifest.

    An entry has file, documents, tokens and start, the ids in all files before it. A null text is empty and has END_ID
    alone; a null doc_id comes first. Rows of equal doc_id go by a hash of their text, so reruns agree. An empty table
    gives an empty manifest. Only doc_id and text are read.
    """

    def run(batches):
        encoder, files, writer, stream = WordEncoder.of(tokenizer_path), python_fs(folder), None, None
        name = f"{uuid.uuid4().hex}.tokens.zst"
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if writer is None and doc_ids:
                stream = files[0].open_output_stream(f"{files[1]}/{name}", compression=None)
                writer = FrameWriter(stream)
            for doc_id, ids in zip(doc_ids, encoder.encode(texts)):
                writer.add(doc_id, ids)
        if writer is not None:
            writer.finish()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "file": name, "documents": len(writer.counts), "tokens": sum(writer.counts)}], pa.schema([("part", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().cast("binary").alias("text"), F.xxhash64(body()).alias("mark"))
    ranged = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark")
    written = ranged.select("doc_id", "text").mapInArrow(run, "part long, file string, documents long, tokens long").collect()
    manifest, start = [], 0
    for r in sorted(written, key=lambda r: r.part):  # ranges are numbered in order
        manifest.append({"file": r.file, "documents": r.documents, "tokens": r.tokens, "start": start})
        start += r.tokens
    fs, path = python_fs(folder)
    with fs.open_output_stream(f"{path}/_manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> list[dict]:
    fs, path = python_fs(folder)
    with fs.open_input_stream(f"{path}/_manifest.json") as f:
        return json.loads(f.read())


def _over_files(spark: SparkSession, folder: str, run, schema: str) -> DataFrame:
    """run over the manifest's entries, one task a file."""
    entries = read_manifest(folder)
    rows = spark.createDataFrame([(e["file"], e["start"]) for e in entries], "file string, start long")
    return rows.repartition(max(1, len(entries))).mapInArrow(run, schema)


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id and ids (array of long) from the files; with doc_ids only those documents' frames are fetched."""
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches):
        fs, path = python_fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{path}/{name}") as source:
                    reader = FrameReader(source)
                    found = reader.of(wanted) if wanted is not None else ((reader.doc_ids[k], ids) for k, ids in reader.frames(range(len(reader.doc_ids))))
                    for doc_id, ids in found:
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([np.frombuffer(ids, "<u4").astype(np.int64)], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _over_files(spark, folder, run, "doc_id long, ids array<long>")


def digest_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the frames of the files."""

    def run(batches):
        fs, path = python_fs(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{path}/{name}") as source:
                    reader = FrameReader(source)
                    crcs, counts = [], []
                    for _, ids in reader.frames(range(len(reader.doc_ids))):
                        crcs.append(zlib.crc32(ids))
                        counts.append(len(ids) // 4)
                    starts = start + np.cumsum([0, *counts[:-1]], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _over_files(spark, folder, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), default_path(), folder)
    return digest_token_files(spark, folder)
