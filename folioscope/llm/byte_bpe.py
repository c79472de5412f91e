"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pieces are the matches of the public pattern of the rank files ('s|'t|'re|'ve|'m|'ll|'d, a run of letters, digits or
other signs with at most one space before it, white space). They are found without a regular expression: a table turns
code points into classes, neighbours refine a class where the pattern looks ahead, and each class stands for a function
on the eight states of a small automaton. Functions compose associatively, so the states of all positions follow from a
scan: blocks of columns are composed side by side in numpy, the blocks' functions by doubling, and the states inside the
blocks once more side by side. A text starts with a class whose function forgets the state, so a batch is one scan.

Pieces are merged by rank and cached; a piece's ids do not depend on its place. Token offsets follow from the lengths of
the tokens; decoding looks ids up and joins their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import body, kept, table

#: Code points of the White_Space property: fixed values.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006,
    0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SIGN, LETTER, NUMBER, SPACE, WHITE = range(5)
#: Classes after a look at the neighbours: white space followed by white space or the end, a last space, other last
#: white space, and an apostrophe that could begin a contraction of one or of two letters.
MID_WHITE, LAST_SPACE, LAST_WHITE, SHORT, LONG = range(3, 8)
CLASSES = 8
#: States: nothing open; letters, numbers, signs; a space that what follows joins; white space; one or two letters of a
#: contraction to come.
NONE, IN_LETTERS, IN_NUMBERS, IN_SIGNS, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
STATES = 8
BLOCK = 128
#: Code points scanned at once, unless one text is longer.
CHUNK = 1_000_000
#: Pieces whose ids are kept; pieces of a text that are looked up at once.
CACHE, TOGETHER = 300_000, 100_000
#: Pieces of more bytes are merged with a heap, and not kept.
LONG_PIECE = 64


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and piece start, for [class (+ CLASSES at the start of a text), state]."""
    after = np.zeros((2 * CLASSES, STATES), np.uint8)
    start = np.ones((2 * CLASSES, STATES), bool)
    for kind, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (SIGN, IN_SIGNS)):
        after[kind] = inside
        start[kind, [inside, AFTER_SPACE]] = False
    for state, then in ((ONE_MORE, NONE), (TWO_MORE, ONE_MORE)):
        after[LETTER, state], start[LETTER, state] = then, False
    after[MID_WHITE], start[MID_WHITE, IN_WHITE] = IN_WHITE, False
    after[LAST_SPACE], after[LAST_WHITE] = AFTER_SPACE, NONE
    for kind, then in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
        after[kind] = then
        after[kind, [IN_SIGNS, AFTER_SPACE]], start[kind, [IN_SIGNS, AFTER_SPACE]] = IN_SIGNS, False
    after[CLASSES:] = after[:CLASSES, NONE, None]
    return after, start


AFTER, START = _automaton()


def class_table() -> np.ndarray:
    """Class of each code point."""
    if "classes" not in kept("byte_bpe"):
        by_first = {"L": LETTER, "N": NUMBER}
        kinds = np.fromiter((by_first.get(unicodedata.category(chr(c))[0], SIGN) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        kinds[list(WHITE_SPACE)] = WHITE
        kinds[0x20] = SPACE
        kept("byte_bpe")["classes"] = kinds
    return kept("byte_bpe")["classes"]


def refined_classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes with look-ahead; first marks where a text begins."""
    plain = class_table()[points]
    ends = np.append(first[1:], True)
    white = (plain == SPACE) | (plain == WHITE)
    last = white & ~np.append(white[1:], True) & ~ends
    kinds = np.where(white, np.where(last, np.where(plain == SPACE, LAST_SPACE, LAST_WHITE), MID_WHITE), plain).astype(np.uint8)
    for at in np.flatnonzero((points == 0x27) & ~ends):
        one = points[at + 1]
        if one in (0x73, 0x74, 0x6D, 0x64):  # s t m d
            kinds[at] = SHORT
        elif at + 2 < len(points) and not first[at + 2] and (int(one), int(points[at + 2])) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):  # re ve ll
            kinds[at] = LONG
    kinds[first] += CLASSES
    return kinds


def scan_states(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state before each position: an exclusive scan of composed transition functions."""
    n = len(kinds)
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.intp)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T) * STATES
    flat = AFTER.reshape(-1)
    whole = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES))
    for column in columns:  # function of each block
        whole = flat[column[:, None] + whole]
    step = 1
    while step < rows:  # functions of all blocks up to each
        whole = np.concatenate([whole[:step], np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), 1)])
        step *= 2
    state = np.concatenate([[NONE], whole[:-1, NONE]]).astype(np.uint8)
    before = np.empty((BLOCK, rows), np.uint8)
    for at, column in enumerate(columns):
        before[at] = state
        state = flat[column + state]
    return before.T.reshape(-1)[:n]


def piece_starts(texts: list[str]) -> list[np.ndarray]:
    """Where the pieces of each text begin, in code points."""
    lengths = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return [np.empty(0, np.intp) for _ in texts]
    begins = np.cumsum(lengths) - lengths
    first = np.zeros(len(points), bool)
    first[begins[lengths > 0]] = True
    kinds = refined_classes(points, first)
    found = np.flatnonzero(START[kinds, scan_states(kinds)])
    cuts = np.searchsorted(found, np.append(begins, len(points)))
    return [found[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], begins)]


class ByteBpe:
    """Ranks of a vocabulary, with a cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.cache: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> ByteBpe:
        if path not in kept("byte_bpe"):
            kept("byte_bpe")[path] = cls(path)
        return kept("byte_bpe")[path]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the pair of lowest rank is merged, the first of equals, until no pair has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > LONG_PIECE:
            return self.merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        never = 1 << 60
        pairs = [ranks.get(a + b, never) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < never:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], never)
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], never)
        return [ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(piece)
        ends = list(range(1, n + 1))  # of the part that begins here; 0: merged into an earlier one
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            middle = ends[at]
            if middle < n and (rank := ranks.get(piece[at : ends[middle]])) is not None:
                heapq.heappush(heap, (rank, at, ends[middle]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, at, end = heapq.heappop(heap)
            middle = ends[at]
            if not middle or middle >= n or ends[middle] != end or ranks.get(piece[at:end]) != rank:
                continue
            ends[at], ends[middle] = end, 0
            if end < n:
                before[end] = at
                offer(at)
            if before[at] >= 0:
                offer(before[at])
        found, at = [], 0
        while at < n:
            found.append(ranks[piece[at : ends[at]]])
            at = ends[at]
        return found

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        for text, starts in zip(texts, piece_starts(texts)):
            cuts = starts.tolist()
            pieces = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]
            try:
                joined = b"".join(map(self.cache.__getitem__, pieces))
            except KeyError:
                joined = b"".join(self._joined(pieces[at : at + TOGETHER]) for at in range(0, len(pieces), TOGETHER))
            yield np.frombuffer(joined, "<u4")

    def _joined(self, pieces: list[str]) -> bytes:
        """Ids of some pieces. Long ones aren't kept, and few enough come at once that what is kept is bounded in bytes."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        own = {}
        for piece in set(pieces).difference(self.cache):
            (self.cache if len(piece) <= LONG_PIECE else own)[piece] = np.array(self.merge(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        return b"".join([own[p] if p in own else self.cache[p] for p in pieces] if own else map(self.cache.__getitem__, pieces))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token begins in the text's UTF-8 bytes."""
        ends = np.cumsum(self.lengths[ids])
        return ends - self.lengths[ids]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def batches_of(texts: list[str], chunk: int = CHUNK) -> Iterator[slice]:
    """Slices of texts that hold about chunk code points, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chunk:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """doc_id, ids (array of int), offsets (array of int: where each token begins in the UTF-8 bytes) of each row.

    A null text is empty and has no ids. Whole texts are encoded, in the task that scans them, a chunk at a time; rows
    may repeat or lack an id. Only the id and text columns are read.
    """

    def run(batches):
        bpe = ByteBpe.of(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in batches_of(texts):
                ids = [x.astype(np.int32) for x in bpe.encode(texts[part])]
                starts = [bpe.offsets(x).astype(np.int32) for x in ids]
                own = batch.column(0)[part.start : part.stop]
                yield pa.RecordBatch.from_arrays([own, pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32()))], ["doc_id", "ids", "offsets"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), body().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded (binary) from doc_id and ids; null ids decode to no bytes."""

    def run(batches):
        bpe = ByteBpe.of(path)
        for batch in batches:
            decoded = [bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: the round trip inside the task that scans it, so ids are not sent on."""

    def run(batches):
        bpe = ByteBpe.of(path)
        for batch in batches:
            texts, counts, of_ids, of_bytes = batch.column(1).to_pylist(), [], [], []
            for part in batches_of(texts):
                for ids in bpe.encode(texts[part]):
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(ids).hexdigest())
                    of_bytes.append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded_sha256 of each row, encoded and decoded in the task that scans it."""

    def run(batches):
        bpe = ByteBpe.of(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in batches_of(texts):
                ids = list(bpe.encode(texts[part]))
                decoded = [hashlib.sha256(bpe.decode(x.tolist())).hexdigest() for x in ids]
                columns = [batch.column(0)[part.start : part.stop], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), default_path())
