"""Masked pseudo-likelihood by a bidirectional window network with a memory of the corpus.

Each word of a text is predicted from the WINDOW words on both sides of it, and the log-probabilities are summed.

The network's inputs are embeddings of the neighbours, weighted by their place, and a hidden layer; its output is the word itself, by a
softmax in two steps: the class of the word, then the word among those of its class, both from the hidden layer. Classes are cut so that a word takes
the fewest outputs, which changes no word's being predicted among all. It knows the commonest words of the
corpus, more of them the larger the vocabulary is. Any other word is predicted as a rare word by the network, then spelled by
a model of byte pairs of the corpus's rare words, so every word has a probability. Each task trains a copy in numpy on its documents
(Adam, cross entropy): one word in MASKED is masked and predicted, from a place that changes from chunk to chunk, the others are what it is
predicted from. The copies are averaged, weighted by their words. Vocabulary, byte pairs, memory and scores are of all words.

The memory holds how often each window, with and without the word in it, occurs in the corpus. A masked word does not count
itself: with n other occurrences of its window, k of them around the same word, its probability is (k + PRIOR p) / (n + PRIOR),
p being the network's, which is p where the window occurs nowhere else. So what is gathered grows with the corpus, word by word.

Windows meet by their hashes. A task sends, for each of its chunks of documents and each range of hashes, one compressed blob of the sorted hashes
with the network's log-probabilities, and gets back corrections for the documents in which other chunks know a
window. Equal windows of a chunk are one entry, so a passage that every document has is as many entries as there are chunks.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import body, materialize, table
from folioscope.llm.words import ODD, Words, mixed

#: Neighbours on either side.
WINDOW = 2
#: Words that the network knows in a corpus of HEAD_FROM types, and the power by which they grow with the types.
HEAD, HEAD_FROM, HEAD_POWER = 8_192, 400_000, 0.2
#: Size of embeddings and hidden layer; masked words in a step, one of how many words is masked, rate, seed.
SIZE, STEP, MASKED, RATE, SEED = 24, 8_192, 1, 0.01, 9
#: Occurrences that the network's probability counts as beside those in the memory.
PRIOR = 2.0
#: Bytes and documents of a chunk; words that one copy is trained on and that one range of hashes holds, about.
TOGETHER, DOCS_TOGETHER, TRAINER_WORDS, RANGE_WORDS = 3_000_000, 50_000, 10_000_000, 2_000_000
#: Numbers in a block of parameters that is averaged; copies of a block that meet in one task.
BLOCK, FAN = 65_536, 32
#: Bits of an entry's hash that stand for the word, and bits by which those of its window exceed the logarithm of the corpus's words.
WORD_BITS, SPARE_BITS = 12, 20
#: The network's log-probabilities are rounded to this part of one, so that they pack; the sum of n words is off by some sqrt(n) / 55.
ROUNDED = 16
#: Outputs within this bound have exponentials whose sums fit, so that a softmax needs no maximum.
LARGEST = 60.0
#: Parameters that a step of training changes at once.
PIECE = 16_384
#: Rows that are multiplied at once by what is the same for each; a word that occurs more often in a step is summed up by itself.
WIDE, FEW = 64, 16


def chunks(batches, text: int) -> Iterator[tuple[list[pa.RecordBatch], Words]]:
    """(rows, their words) of chunks of whole documents. Column number text holds UTF-8 bytes."""
    rows, texts, size = [], [], 0
    for batch in batches:
        at = 0
        for i, t in enumerate(batch.column(text).to_pylist()):
            texts.append(t)
            size += len(t)
            if size >= TOGETHER or len(texts) >= DOCS_TOGETHER:
                yield [*rows, batch.slice(at, i + 1 - at)], Words(texts)
                rows, texts, size, at = [], [], 0, i + 1
        if at < batch.num_rows:
            rows.append(batch.slice(at))
    if rows:
        yield rows, Words(texts)


def word_counts(docs: DataFrame) -> DataFrame:
    """h, n: each type of the corpus and how often it occurs."""

    def run(batches):
        for _, words in chunks(batches, 0):
            h, n = np.unique(words.types, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    return docs.select(body().cast("binary").alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def head_for(vocabulary: int) -> int:
    """Number of words that the network knows, for a corpus with so many types."""
    return round(HEAD * max(1.0, vocabulary / HEAD_FROM) ** HEAD_POWER)


def commonest(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Types and counts of the commonest words, most at most and as many as are above a count, in descending order."""
    by_count = sorted(((r["n"], r["words"]) for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow().to_pylist()), reverse=True)
    least, size = 1 << 62, 0
    for n, of_n in by_count:
        size += of_n
        if size > most:
            break
        least = n
    found = words.where(F.col("n") >= least).toArrow()
    h, n = found.column("h").to_numpy(), found.column("n").to_numpy()
    order = np.lexsort((h, -n))
    return h[order], n[order]


def sides(x: np.ndarray, lengths: np.ndarray, edge, of: np.ndarray | None = None) -> np.ndarray:
    """[2 * WINDOW, words]: the neighbours of each word (or of the words at places of) in its document, those before it first; edge beyond the ends."""
    padded = np.full(len(x) + WINDOW * (len(lengths) + 1), edge, x.dtype)
    at = np.arange(WINDOW, WINDOW + len(x)) + np.repeat(np.arange(len(lengths)) * WINDOW, lengths)
    padded[at] = x
    if of is not None:
        at = at[of]
    return np.stack([padded[at + by] for by in [*range(-WINDOW, 0), *range(1, WINDOW + 1)]])


class Network:
    """Codes: the places of the head words, then one for all rare words; as an input also the edge of a document."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, rare: int):
        self.rare, self.edge = len(head), len(head) + 1
        # head words by the first bits of their types; those that share them are looked up by the rest
        self.bits = max(1, (4 * len(head)).bit_length())
        slot = (head.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(head.view(np.uint64))
        self.order, self.types = np.append(order, self.rare).astype(np.int32), np.append(head[order], 0)
        self.slots = np.searchsorted(slot[order], np.arange(2**self.bits))
        self.sizes = np.bincount(slot, minlength=2**self.bits).astype(np.uint16)
        self.deepest = int(self.sizes.max())
        n = np.append(counts, rare) + 1.0
        # a class begins where the roots of the words' shares, summed up, pass a whole number: that makes classes and words of the own class, which are
        # all the outputs that a word takes, fewest on average; the rare word is a class
        roots = np.sqrt(n[:-1] / n.sum())
        step = np.floor(np.cumsum(roots) - roots)
        first = np.flatnonzero(np.append(True, step[1:] != step[:-1])) if len(head) else np.empty(0, np.int64)
        self.starts = np.append(first, [self.rare, self.rare + 1]).astype(np.int64)
        sizes = np.diff(self.starts)
        self.of = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint16)
        of_class = np.add.reduceat(n, self.starts[:-1])
        random = np.random.default_rng(SEED)
        drawn = lambda scale, *shape: random.normal(0, scale, shape)
        self.p = {
            "in": drawn(0.3, self.rare + 2, SIZE), "place": np.full((2 * WINDOW, SIZE), (2 * WINDOW) ** -0.5),
            "hidden": drawn(SIZE**-0.5, SIZE, SIZE), "bias": np.zeros(SIZE),
            "class": drawn(0.1, SIZE, len(sizes)), "class_bias": np.log(of_class / of_class.sum()),
            "word": drawn(0.1, self.rare + 1, SIZE), "word_bias": np.log(n / of_class[self.of]),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.spelling, self.rooms = np.zeros(257 * 257, np.float32), {}

    def codes(self, types: np.ndarray) -> np.ndarray:
        """int32 codes of types."""
        slot = (types.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)
        to = self.slots[slot]
        codes = np.where(self.types[to] == types, self.order[to], np.int32(self.rare))
        left = np.flatnonzero((codes == self.rare) & (self.sizes[slot] > 1))
        for by in range(1, self.deepest):
            to = self.slots[slot[left]] + by
            found = self.types[to] == types[left]
            codes[left[found]] = self.order[to[found]]
            left = left[~found]
            left = left[self.sizes[slot[left]] > by + 1]
        return codes

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array to write to. Its memory is kept and used again under this name: asking the system for fresh pages at each step takes longer than many sums."""
        size, kind = math.prod(shape), self.p["in"].dtype
        kept = self.rooms.get(name)
        if kept is None or kept.size < size or kept.dtype != kind:
            kept = self.rooms[name] = np.empty(size, kind)
        return kept[:size].reshape(shape)

    def inputs(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours' embeddings, and their sum by place."""
        n = windows.shape[1]
        of = np.take(self.p["in"], windows, axis=0, out=self.room("of", len(windows), n, SIZE), mode="clip")
        x, more = _times(of[0], self.p["place"][0], self.room("x", n, SIZE)), self.room("more", n, SIZE)
        for e, place in zip(of[1:], self.p["place"][1:]):
            x += _times(e, place, more)
        return of, x

    def hidden(self, x: np.ndarray, out: np.ndarray) -> None:
        """The hidden layer to out, a column each; its last row is 1: what stands for the bias of the outputs."""
        h = np.matmul(self.p["hidden"].T, x.T, out=out[:SIZE])
        h += self.p["bias"][:, None]
        np.tanh(h, out=h)
        out[SIZE] = 1

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and, a row each, of the words, with their biases."""
        p = self.p
        classes, words = self.room("classes", SIZE + 1, p["class"].shape[1]), self.room("weights", len(p["word"]), SIZE + 1)
        classes[:SIZE], classes[SIZE] = p["class"], p["class_bias"]
        words[:, :SIZE], words[:, SIZE] = p["word"], p["word_bias"]
        return classes, words

    def outputs(self, hidden: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.matmul(hidden.T, weights, out=self.room("z", hidden.shape[1], weights.shape[1]))

    def groups(self, classes: np.ndarray) -> Iterator[tuple[slice, int, int]]:
        """(rows, first, end) for each class of several words that sorted classes have: their places and the class's words."""
        at = np.flatnonzero(np.append(True, classes[1:] != classes[:-1])) if len(classes) else []
        for k, a, b in zip(classes[at].tolist(), at, [*at[1:], len(classes)]):
            if self.starts[k + 1] - self.starts[k] > 1:
                yield slice(int(a), int(b)), int(self.starts[k]), int(self.starts[k + 1])

    def small(self) -> bool:
        """Whether no output can be beyond LARGEST: the hidden layer is within -1 and 1."""
        p = self.p
        words = _sums(np.abs(p["word"], out=self.room("words", *p["word"].shape))) + np.abs(p["word_bias"])
        return max((np.abs(p["class"]).sum(0) + np.abs(p["class_bias"])).max(), words.max()) < LARGEST

    def log_p(self, windows: np.ndarray, codes: np.ndarray, block: int = 1024) -> np.ndarray:
        """log P(word | its neighbours) of words by their codes."""
        p, small = self.p, self.small()
        order = np.argsort(self.of[codes], kind="stable")
        windows, codes = windows[:, order], codes[order]
        classes, sums, hidden = self.of[codes], np.empty(len(codes)), np.empty((len(codes), SIZE + 1), p["in"].dtype)
        of_classes, of_words = self.weights()
        # what each word at each place adds to the hidden layer, once for all that have it
        added = [(p["in"] * place) @ p["hidden"] for place in p["place"]]
        added[0] += p["bias"]
        for at in range(0, len(codes), block):
            own = windows[:, at : at + block]
            h, more = self.room("x", own.shape[1], SIZE), self.room("more", own.shape[1], SIZE)
            np.take(added[0], own[0], axis=0, out=h, mode="clip")
            for by_word, w in zip(added[1:], own[1:]):
                h += np.take(by_word, w, axis=0, out=more, mode="clip")
            hidden[at : at + block, :SIZE] = np.tanh(h, out=h)
            hidden[at : at + block, SIZE] = 1
            sums[at : at + block] = _log_softmax_at(self.outputs(hidden[at : at + block].T, of_classes), classes[at : at + block], small)
        for rows, first, end in self.groups(classes):
            for at in range(rows.start, rows.stop, block):
                part = slice(at, min(at + block, rows.stop))
                sums[part] += _log_softmax_at(self.outputs(hidden[part].T, of_words[first:end].T), codes[part] - first, small)
        out = np.empty(len(codes))
        out[order] = sums
        return out

    def slopes(self, windows: np.ndarray, codes: np.ndarray, block: int = 1024) -> dict[str, np.ndarray]:
        """Slopes of the mean cross entropy by each parameter, which hold until the next call. Words are taken class by class, so those of a class are next to each other."""
        p, n, small = self.p, len(codes), self.small()
        order = np.argsort(self.of[codes], kind="stable")
        windows, codes = windows[:, order], codes[order]
        classes = self.of[codes]
        of, x = self.inputs(windows)
        own, dh, more, by = self.room("own", SIZE + 1, n), self.room("dh", SIZE, n), self.room("scaled", SIZE, n), self.room("by", n)
        self.hidden(x, own)
        h, (of_classes, of_words) = own[:SIZE], self.weights()
        slope = {k: self.room("slope " + k, *p[k].shape) for k in ("class", "class_bias", "word", "word_bias", "in")}
        for empty in slope.values():
            empty.fill(0)
        for at in range(0, n, block):
            rows = slice(at, min(at + block, n))
            d = _slope_at(self.outputs(own[:, rows], of_classes), classes[rows], n, small, by[rows])
            slope["class"] += np.multiply(h[:, rows], by[rows], out=more[:, rows]) @ d
            slope["class_bias"] += by[rows] @ d
            np.matmul(p["class"], d.T, out=dh[:, rows])
        dh *= by
        by.fill(0)
        by_words = self.room("by words", SIZE, n)
        by_words.fill(0)
        for rows, first, end in self.groups(classes):
            d = _slope_at(self.outputs(own[:, rows], of_words[first:end].T), codes[rows] - first, n, small, by[rows])
            np.matmul(d.T, np.multiply(h[:, rows], by[rows], out=more[:, rows]).T, out=slope["word"][first:end])
            np.matmul(by[rows], d, out=slope["word_bias"][first:end])
            np.matmul(p["word"][first:end].T, d.T, out=by_words[:, rows])
        by_words *= by
        dh += by_words
        dh *= np.subtract(1, np.multiply(h, h, out=more), out=more)
        slope["hidden"], slope["bias"] = x.T @ dh.T, dh.sum(1)
        dx = np.matmul(dh.T, p["hidden"].T, out=x)
        ones, more = np.ones(n, dx.dtype), self.room("more", n, SIZE)
        slope["place"] = np.stack([ones @ np.multiply(e, dx, out=more) for e in of])
        flat = windows.reshape(-1)
        order = np.argsort(flat.astype(np.uint16) if self.edge < 65_536 else flat, kind="stable")
        # rare words and edges come last and are a good part of all: two sums instead of sorted rows
        order = order[: len(flat) - np.count_nonzero(flat >= self.rare)]
        for code in (self.rare, self.edge):
            slope["in"][code] = np.einsum("ij,ij->j", (windows == code).astype(dx.dtype) @ dx, p["place"])
        if len(order):
            found = flat[order]
            at = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            for e, place in zip(of, p["place"]):
                _times(dx, place, e)
            self.sum_runs(of.reshape(-1, SIZE), order, at, found[at], slope["in"])
        return slope

    def sum_runs(self, x: np.ndarray, order: np.ndarray, first: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """Sums rows of x, taken in this order, from each first one to the next, to the rows of out at places to. Short runs, which are most, are summed side by side."""
        sizes = np.diff(np.append(first, len(order)))
        by_size = np.argsort(np.maximum(FEW + 1 - sizes, 0).astype(np.uint16), kind="stable")
        many = int(np.count_nonzero(sizes > FEW))
        long, short = np.sort(by_size[:many]), by_size[many:]
        total, more = self.room("summed", len(short), SIZE), self.room("summand", len(short), SIZE)
        at, n = first[short], len(short)
        np.take(x, order[at], axis=0, out=total, mode="clip")
        longer = np.bincount(sizes[short], minlength=FEW + 1)
        for by in range(1, FEW):
            n -= int(longer[by])
            total[:n] += np.take(x, order[at[:n] + by], axis=0, out=more[:n], mode="clip")
        out[to[short]] = total
        if many:
            of_long = order[np.repeat(sizes > FEW, sizes)]
            rows = np.take(x, of_long, axis=0, out=self.room("by word", len(of_long), SIZE), mode="clip")
            out[to[long]] = np.add.reduceat(rows, np.cumsum(sizes[long]) - sizes[long], axis=0)

    def spell(self, words: Words) -> np.ndarray:
        """log P(spelling) of all words, were they rare."""
        inside, last = words.pairs()
        return np.add.reduceat(self.spelling[inside], words.first, dtype=np.float64) + self.spelling[last] if len(last) else np.empty(0)

    def finish(self, vector: np.ndarray, pairs: np.ndarray) -> None:
        """Takes averaged parameters and the corpus's counts of byte pairs."""
        at = 0
        for k, v in self.p.items():
            self.p[k] = vector[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        pairs = pairs.reshape(257, 257) + 1.0
        self.spelling = (np.log(pairs) - np.log(pairs.sum(1, keepdims=True))).reshape(-1).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()])


def _log_softmax_at(z: np.ndarray, at: np.ndarray, small: bool) -> np.ndarray:
    """The log-softmax of each row of z at one place; z is overwritten."""
    if not small:
        z -= z.max(1, keepdims=True)
    found = z[np.arange(len(z)), at]
    return found - np.log(_sums(np.exp(z, out=z)))


def _slope_at(z: np.ndarray, at: np.ndarray, n: int, small: bool, by: np.ndarray) -> np.ndarray:
    """d, which overwrites z, and by: the slope by z of -1 / n of the sum of the log-softmax of each row at one place is by times d, row by row.

    Rows are left unscaled, as what they are multiplied with is narrower than they are."""
    if not small:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    sums = _sums(z)
    flat = z.reshape(-1)
    flat[at + np.arange(0, z.size, z.shape[1])] -= sums
    sums *= n
    np.divide(1, sums, out=by)
    return z


def _times(x: np.ndarray, by: np.ndarray, out: np.ndarray) -> np.ndarray:
    """x * by, written to out: WIDE rows at once, as rows are short."""
    n = len(x) // WIDE * WIDE
    np.multiply(x[:n].reshape(-1, WIDE * len(by)), np.tile(by, WIDE), out=out[:n].reshape(-1, WIDE * len(by)))
    np.multiply(x[n:], by, out=out[n:])
    return out


def _sums(z: np.ndarray) -> np.ndarray:
    """The sum of each row."""
    return z @ np.ones(z.shape[1], z.dtype)


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.n = p, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, slopes: dict[str, np.ndarray]) -> None:
        self.n += 1
        rate = np.float32(RATE * (1 - 0.999**self.n) ** 0.5 / (1 - 0.9**self.n))
        for k, slope in slopes.items():
            # by pieces, which stay in the processor's cache from sum to sum
            whole = [x.reshape(-1) for x in (slope, self.m[k], self.v[k], self.p[k])]
            for at in range(0, slope.size, PIECE):
                g, m, v, p = (x[at : at + PIECE] for x in whole)
                a = np.subtract(g, m)
                a *= np.float32(0.1)
                m += a
                np.multiply(g, g, out=a)
                a -= v
                a *= np.float32(0.001)
                v += a
                np.sqrt(v, out=a)
                a += np.float32(1e-8)
                np.divide(m, a, out=a)
                a *= rate
                p -= a


COPIES = "trainer long, block long, words long, part binary"


def averages(copies: DataFrame, trainers: int) -> dict[int, np.ndarray]:
    """Each block's mean over the copies (COPIES), weighted by their words; block -1 is summed. At most FAN blocks meet in one task, in as many rounds as that takes."""

    def summed(t: pa.Table) -> pa.Table:
        t = t.sort_by("trainer")
        block, words, parts = t.column("block")[0].as_py(), t.column("words").to_numpy(), t.column("part").to_pylist()
        kind = np.int64 if block < 0 else np.float64
        total = sum(np.frombuffer(x, kind) for x in parts)
        return pa.table({"trainer": pa.array([t.column("trainer")[0].as_py() // FAN]), "block": pa.array([block]), "words": pa.array([int(words.sum())]), "part": pa.array([total.tobytes()], pa.binary())})

    while True:
        copies = copies.groupBy(F.expr(f"trainer div {FAN}"), "block").applyInArrow(summed, COPIES)
        trainers = -(-trainers // FAN)
        if trainers == 1:
            break
    rows = copies.toArrow().to_pylist()
    return {r["block"]: np.frombuffer(r["part"], np.int64).astype(np.float64) if r["block"] < 0 else np.frombuffer(r["part"], np.float64) / r["words"] for r in rows}


def trained(docs: DataFrame) -> tuple[Network, int]:
    """The network of the corpus, and the number of its words."""
    types = materialize(word_counts(docs), "lm-words")
    total = types.agg(F.count(F.lit(1)).alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    head, counts = commonest(types, head_for(total.types))
    network = Network(head, counts, total.words - int(counts.sum()))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        own: Network = shared.value
        own.p, pairs, seen = {k: v.copy() for k, v in own.p.items()}, np.zeros(257 * 257, np.int64), 0
        adam, random = Adam(own.p), np.random.default_rng(SEED)
        for number, (_, words) in enumerate(chunks(batches, 0)):
            codes = own.codes(words.types)
            inside, last = words.pairs()
            rare = codes == own.rare
            pairs += np.bincount(inside[np.repeat(rare, words.sizes)], minlength=257 * 257) + np.bincount(last[rare], minlength=257 * 257)
            masked = random.permutation(np.arange(number % MASKED, len(codes), MASKED))
            windows, codes = sides(codes, words.lengths, own.edge, masked), codes[masked]
            for at in range(0, len(masked), STEP):
                adam.step(own.slopes(windows[:, at : at + STEP], codes[at : at + STEP]))
            seen += len(words.types)
        if seen:
            trainer, vector = TaskContext.get().partitionId(), own.flat()
            parts = [(vector[at : at + BLOCK].astype(np.float64) * seen).tobytes() for at in range(0, len(vector), BLOCK)]
            parts.append(pairs.tobytes())
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([trainer] * n), pa.array([*range(n - 1), -1]), pa.array([seen] * n), pa.array(parts, pa.binary())], ["trainer", "block", "words", "part"])

    trainers = max(1, -(-total.words // TRAINER_WORDS))
    texts = docs.select(body().cast("binary").alias("text")).coalesce(trainers)
    found = averages(texts.mapInArrow(run, COPIES), trainers)
    if found:
        pairs = found.pop(-1)
        network.finish(np.concatenate([found[k] for k in sorted(found)]), pairs)
    return network, total.words


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones, ...: sorted or small numbers compress well that way."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(data: bytes, at: int, n: int, kind) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(-1), at + n * size


def packed(keys: np.ndarray, logs: np.ndarray, times: np.ndarray, docs: np.ndarray) -> bytes:
    """A blob of entries: sorted keys, log-probabilities, how often each occurs, and the documents of all occurrences."""
    import zstandard

    data = np.array([len(keys), len(docs)], "<u4").tobytes() + _planes(keys) + _planes(logs.astype("<f2")) + _planes(times.astype("<u4")) + _planes(docs.astype("<u2"))
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    (n, m), at = np.frombuffer(data, "<u4", 2), 8
    keys, at = _numbers(data, at, n, "<u8")
    logs, at = _numbers(data, at, n, "<f2")
    times, at = _numbers(data, at, n, "<u4")
    return keys, logs.astype(np.float64), times.astype(np.int64), _numbers(data, at, m, "<u2")[0].astype(np.int64)


def window_bits(words: int) -> int:
    """Bits of a window's hash in a corpus of so many words: one in a million windows has another one's."""
    return min(64 - WORD_BITS, max(1, words).bit_length() + SPARE_BITS)


def window_keys(types: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """uint64 for each word: bits of its window's hash, then WORD_BITS of its own, then zeros."""
    t = types.view(np.uint64)
    window = mixed(sum(s * odd for s, odd in zip(sides(t, lengths, np.uint64(1)), ODD)))
    below = np.uint64(64 - bits)
    return window >> below << below | mixed(t * ODD[4]) >> np.uint64(64 - WORD_BITS) << np.uint64(64 - bits - WORD_BITS)


def corrections(keys: np.ndarray, logs: np.ndarray, times: np.ndarray, bits: int) -> np.ndarray:
    """What the memory adds to each entry's log-probability, from all entries of a range of hashes."""
    if not len(keys):
        return np.zeros(0)
    order = np.argsort(keys, kind="stable")
    k, n = keys[order], times[order]

    def summed(same: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
        return np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(same))))

    of_word, of_window = np.empty(len(k)), np.empty(len(k))
    of_word[order], of_window[order] = summed(k), summed(k >> np.uint64(64 - bits))
    found = np.zeros(len(k))
    known = of_window > 1
    p = np.exp(logs[known])
    found[known] = np.log((of_word[known] - 1 + PRIOR * p) / (of_window[known] - 1 + PRIOR)) - logs[known]
    return found


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over words), mean_log_likelihood (a word) of each row of docs.

    The model is trained on docs themselves, all words of all texts. Null and empty texts, and texts without words, have
    0 words, sum 0 and a null mean. Repeated rows get equal scores and count as often as they occur. Rows without a
    doc_id are scored like others. Only doc_id and text are read; an empty table gives an empty result.
    """
    network, total = trained(docs)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges, bits = max(least, -(-total // RANGE_WORDS)), window_bits(total)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def scored(batches):
        own = shared.value
        bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
        for rows, words in chunks(batches, 2):
            chunk, lengths = rows[0].column(0)[0].as_py(), words.lengths
            keys = window_keys(words.types, lengths, bits)
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
            times, keys, at = np.diff(np.append(first, len(keys))), keys[first], order[first]
            codes = own.codes(words.types)
            logs = own.log_p(sides(codes, lengths, own.edge, at), codes[at])
            logs += np.where(codes[at] == own.rare, own.spell(words)[at], 0.0)
            logs = (np.round(logs * ROUNDED) / ROUNDED).astype(np.float16).astype(np.float64)
            doc = np.repeat(np.arange(len(lengths)), lengths)[order]
            sums = np.bincount(doc, np.repeat(logs, times), len(lengths)) if len(doc) else np.zeros(len(lengths))
            sink = io.BytesIO()
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([r.column(1) for r in rows]), pa.array(lengths), pa.array(sums)], ["doc_id", "n", "sum"])
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            cuts, ends = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]), np.append(0, np.cumsum(times))
            filled = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if a < b]
            blobs = [sink.getvalue(), *(packed(keys[a:b], logs[a:b], times[a:b], doc[ends[a] : ends[b]]) for _, a, b in filled)]
            to = [-1, *(i for i, _, _ in filled)]
            yield pa.RecordBatch.from_arrays([pa.array([to_ if to_ >= 0 else hash(chunk) % ranges for to_ in to], pa.int32()), pa.array(to, pa.int32()), pa.array([chunk] * len(to), pa.int64()), pa.array(blobs, pa.binary())], ["part", "range", "chunk", "blob"])

    def corrected(batches):
        """The blobs of each range to the corrections of each chunk's documents; the chunks' own sums pass through."""
        held, of = [], None
        for batch in batches:
            for i, chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if i < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([None], pa.binary()), pa.array([blob.as_py()], pa.binary())], ["chunk", "docs", "sums"])
                    continue
                if i != of and held:
                    yield of_range(held)
                    held = []
                held.append((chunk, unpacked(blob.as_py())))
                of = i
        if held:
            yield of_range(held)

    def of_range(held) -> pa.RecordBatch:
        parts = [p for _, p in held]
        ends = np.cumsum([len(p[0]) for p in parts])
        added = np.split(corrections(*(np.concatenate([p[i] for p in parts]) for i in range(3)), bits), ends[:-1])
        at, sums = [], []
        for (_, _, times, doc), by in zip(parts, added):
            total = np.bincount(doc, np.repeat(by, times))
            found = np.flatnonzero(total)
            at.append(found.astype("<u2").tobytes())
            sums.append(total[found].astype("<f4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int64()), pa.array(at, pa.binary()), pa.array(sums, pa.binary())], ["chunk", "docs", "sums"])

    def assembled(t: pa.Table) -> pa.Table:
        own, added = None, []
        for at, sums in zip(t.column("docs").to_pylist(), t.column("sums").to_pylist()):
            if at is None:
                own = pa.ipc.open_stream(sums).read_all()
            else:
                added.append((np.frombuffer(at, "<u2"), np.frombuffer(sums, "<f4")))
        n, total = own.column("n").to_numpy(), own.column("sum").to_numpy().copy()
        for at, sums in sorted(added, key=lambda x: (x[0].tobytes(), x[1].tobytes())):
            total[at] += sums
        mean = [t / k if k else None for t, k in zip(total, n)]
        return pa.table({"doc_id": own.column("doc_id"), "n_words": pa.array(n), "log_likelihood": pa.array(total), "mean_log_likelihood": pa.array(mean, pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", body().cast("binary").alias("text"))
    blobs = rows.mapInArrow(scored, "part int, range int, chunk long, blob binary")
    met = blobs.repartitionById(ranges, F.col("part")).sortWithinPartitions("range").select("range", "chunk", "blob")
    parts = met.mapInArrow(corrected, "chunk long, docs binary, sums binary")
    return parts.groupBy("chunk").applyInArrow(assembled, f"doc_id {kind}, n_words long, log_likelihood double, mean_log_likelihood double")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
