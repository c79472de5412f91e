"""Toxicity by a weighted finite-state grammar of clauses.

Words become symbols of a small alphabet: insult, threat, modal, target, negation, report, other. Five transducers read the
symbols of a clause and mark what they recognise: an insult; a threat (a modal, then a threatening verb); a target near the
trigger, before or after; a negation shortly before it; speech reported by somebody else. Their composition, built
once as a product automaton, marks each trigger with its kind: what it is, and whether it is targeted, negated and
reported. A clause that holds no trigger can't be accepted, so only clauses with one are run.

The insult lexicon has two parts. Seeds are common words of four languages. Others are learned from labelled documents: words and word
beginnings that occur in toxic documents far more often than chance allows, counted once for each group of like
documents. A document's strongest clause of each kind feeds a logistic score, whose weights start from the grammar's
own and are fitted to the same labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import body, is_held_out, materialize, table

OTHER, INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT = range(7)
#: Seed words of the grammar, in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons loser losers scum pathetic worthless disgusting stupid trash clown imbecile dumbass bastard bastards scumbag dipshit asshole arschloch wichser dummkopf vollidiot abschaum drecksau connard connards connasse salope abruti abrutis enculé crétin gilipollas imbécil cabrón pendejo estúpido estúpida".split()
THREATS = "kill murder strangle stab destroy hurt beat slaughter umbringen töten erstechen vernichten tuer égorger massacrer matar matarte destruir apuñalar".split()
MODALS = "will gonna going ll shall werde werden vais allons voy vamos".split()
TARGETS = "you your youre u he she they them him her ya du dich dir dein ihr euch sie tu toi vous ton ta tú usted ustedes te".split()
NEGATIONS = "not no never isnt arent wasnt aint nicht kein keine nie pas jamais nunca ningún".split()
REPORTS = "said says told called calls quoted wrote claimed sagte sagten nannte zitierte schrieb dit disait appelé écrit dijo dijeron llamó escribió".split()
TOKEN = re.compile(r"[^\W\d_]+")
#: Words of a clause with the apostrophes inside them.
APOSTROPHED = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;\n]+")
#: Tokens within which a target or a negation counts.
TARGET_REACH, NEGATION_REACH = 4, 2
#: Strength of a seed word; learned ones have up to 1.
SEED = 0.85
#: Labelled rows that a fit uses, about; shortest and longest word beginnings.
LABELLED_ROWS = 24_000
BEGINNINGS = range(3, 9)
#: Hashes whose minima labelled rows must share to count once.
SKETCH = 8
#: A feature is learned if its toxic documents would be chance with less than this probability in all features together.
CHANCE = 0.05
#: Least log-odds of a learned feature, and those of full strength.
LOG_ODDS, FULL = 1.5, 6.0
#: Log-odds without a match, and of a clause of full strength: plain, and what each mark adds.
BASE, PLAIN, THREAT_ADDS, TARGET_ADDS, NEGATED_ADDS, REPORTED_ADDS = -3.0, 5.0, 1.0, 1.5, -4.0, -3.0
#: Log-odds of a document in which the strengths of the plain and targeted matches add up to one in DENSE words.
DENSITY_ADDS, DENSE = 1.5, 50
#: Pull of the fitted weights towards these, in rows.
PULL = 4.0
THRESHOLD = 0.7
MEMO = 100_000


class Transducer:
    """States are any values; step(state, symbol) gives the next state and a mark or None."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def recently(symbol: int, reach: int, mark: str) -> Transducer:
    """Marks a trigger that follows the symbol within reach tokens."""

    def step(left, s):
        if s == symbol:
            return reach, None
        return max(0, left - 1), mark if left and s in (INSULT, THREAT) else None

    return Transducer(0, step)


def ever(symbol: int, mark: str) -> Transducer:
    return Transducer(False, lambda seen, s: (seen or s == symbol, mark if seen and s in (INSULT, THREAT) else None))


def transducers() -> list[Transducer]:
    insult = Transducer(None, lambda _, s: (None, "insult" if s == INSULT else None))
    modal = recently(MODAL, TARGET_REACH, "meant")
    threat = Transducer(modal.start, lambda state, s: (modal.step(state, s)[0], "threat" if s == THREAT and modal.step(state, s)[1] else None))
    return [insult, threat, recently(TARGET, TARGET_REACH, "target"), recently(NEGATION, NEGATION_REACH, "negated"), ever(REPORT, "reported")]


def compose(parts: list[Transducer]) -> list[list[tuple[int, frozenset]]]:
    """The product automaton: for each state and symbol the next state and all marks."""
    numbers, todo, rows = {tuple(p.start for p in parts): 0}, [tuple(p.start for p in parts)], []
    for states in todo:
        row = []
        for symbol in range(7):
            made = [p.step(s, symbol) for p, s in zip(parts, states)]
            after = tuple(m[0] for m in made)
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row.append((numbers[after], frozenset(m[1] for m in made if m[1])))
        rows.append(row)
    return rows


GRAMMAR = compose(transducers())
#: Kinds of a match: threat, targeted, negated, reported.
KINDS = [(t, a, n, r) for t in (0, 1) for a in (0, 1) for n in (0, 1) for r in (0, 1)]
KIND = {k: i for i, k in enumerate(KINDS)}


def first_weights() -> np.ndarray:
    """BASE, DENSITY_ADDS, then the log-odds of each kind."""
    return np.array([BASE, DENSITY_ADDS] + [PLAIN + t * THREAT_ADDS + a * TARGET_ADDS + n * NEGATED_ADDS + r * REPORTED_ADDS for t, a, n, r in KINDS])


class Grammar:
    """Lexicon of words and beginnings (with a last *), each with a strength up to 1, and the weights of kinds."""

    def __init__(self, learned: dict[str, float], weights: np.ndarray | None = None):
        self.symbols = {w: s for ws, s in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (MODALS, MODAL), (THREATS, THREAT), (INSULTS, INSULT)) for w in ws}
        self.strength = {w: SEED for w in INSULTS} | {w: 1.0 for w in THREATS}
        for word, strength in learned.items():
            # a word of the grammar keeps its part: one learned as an insult must still be a target or a negation
            if not word.endswith("*") and self.symbols.get(word, INSULT) in (INSULT, THREAT):
                self.symbols[word], self.strength[word] = self.symbols.get(word, INSULT), max(strength, self.strength.get(word, 0))
        self.beginnings = {w[:-1]: s for w, s in learned.items() if w.endswith("*")}
        self.lengths = sorted({len(b) for b in self.beginnings})
        self.weights = first_weights() if weights is None else weights
        self.known: dict[str, tuple[int, float]] = {}

    def read(self, word: str) -> tuple[int, float]:
        """Symbol and strength of a word."""
        found = self.known.get(word)
        if found is None:
            symbol = self.symbols.get(word, OTHER)
            found = symbol, self.strength.get(word, 0.0)
            if symbol in (OTHER, INSULT):
                best = max([self.beginnings.get(word[:n], 0.0) for n in self.lengths if n <= len(word)], default=0.0)
                if best > found[1]:
                    found = INSULT, best
            if len(self.known) > MEMO:
                self.known.clear()
            self.known[word] = found
        return found

    def split(self, clause: str) -> Iterable[str]:
        """Words of a clause, parted at apostrophes (I'll, l'enculé) except in negations (isn't)."""
        for word in APOSTROPHED.findall(clause):
            joined = word.replace("'", "").replace("’", "")
            if self.symbols.get(joined) == NEGATION:
                yield joined
            else:
                yield from TOKEN.findall(word)

    def features(self, text: str) -> np.ndarray:
        """Of the whole text: how dense its matches are, then the strength of the strongest matched clause of each kind."""
        found = np.zeros(1 + len(KINDS))
        low = text.lower()
        read = self.read
        tokens = TOKEN.findall(low)
        if not any(read(w)[0] in (INSULT, THREAT) for w in set(tokens)):
            return found
        total = 0.0
        for clause in CLAUSE.split(low):
            words = [read(w) for w in self.split(clause)]
            if any(s in (INSULT, THREAT) for s, _ in words):
                for kind, strength in self.matches(words):
                    found[1 + kind] = max(found[1 + kind], strength)
                    if not any(KINDS[kind][2:]):
                        total += strength
        found[0] = min(2.0, DENSE * total / (len(tokens) + 10))
        return found

    def matches(self, words: list[tuple[int, float]]) -> Iterable[tuple[int, float]]:
        """Kind and strength of each trigger in a clause; the second reading, from the right, finds targets and reports that follow."""
        state, marked = 0, []
        for at, (symbol, strength) in enumerate(words):
            state, marks = GRAMMAR[state][symbol]
            if marks & {"insult", "threat"}:
                marked.append([at, marks, strength])
        state, after = 0, {}
        for at in range(len(words) - 1, -1, -1):
            state, after[at] = GRAMMAR[state][words[at][0]]
        for at, marks, strength in marked:
            both = marks | after[at]
            yield KIND["threat" in marks, "target" in both, "negated" in marks, "reported" in both], strength

    def score(self, features: np.ndarray) -> float:
        """Probability from the kind that speaks most for toxicity, and the density; weaker readings of the same document don't lower it."""
        log_odds = self.weights[0] + self.weights[1] * features[0] + max(0.0, float((self.weights[2:] * features[1:]).max()))
        return 1 / (1 + math.exp(-log_odds))


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str, rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, label, text of about so many labelled rows that are not held out, chosen by a hash of doc_id.

    A doc_id with several labels has the largest. The ids are broadcast: rows bounds them.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(column)), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    return docs.select("doc_id", body().alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")


def one_of_like(rows: DataFrame) -> DataFrame:
    """One row of those that share their label and the least of each of SKETCH hashes of three words in a row: copies count once, so do closest copies.

    Texts that share a passage differ in some minimum, unless the passage is most of them.
    """
    words = rows.withColumn("w", F.split(F.lower("text"), r"\s+"))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 2))

    def sign(n: int) -> F.Column:
        return F.array_min(F.transform(at, lambda i: F.xxhash64(F.slice("w", i, F.lit(3)), F.lit(n)))).alias(f"sign{n}")

    signs = [sign(n) for n in range(SKETCH)]
    return words.groupBy("label", *signs).agg(F.min(F.struct("doc_id", "text")).alias("r")).select("label", "r.text")


def features_of(text: str) -> set[str]:
    words = set(TOKEN.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if n <= len(w)}


def counted(rows: DataFrame, wanted: frozenset | None = None) -> DataFrame:
    """feature, n: documents that have it, summed by task first."""

    def run(batches):
        n = Counter()
        for batch in batches:
            for text in batch.column(0):
                found = features_of(text.as_py())
                n.update(found if wanted is None else found & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])

    return rows.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def chance_of(n: int, total: int, rate: float) -> float:
    """Probability of n or more of total at the rate, bounded above."""
    if total == 0 or n / total <= rate:
        return 1.0
    p = n / total
    kl = p * math.log(p / rate) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0.0)
    return math.exp(-total * kl)


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and beginnings with strengths from (label, text).

    A feature is collected if it is in so many toxic rows that a feature of toxic rows alone could pass the test; their number, like that of the
    entries, is bounded by the labelled rows.
    """
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), sum(n for y, n in totals.items() if y != 1)
    if not toxic or not clean:
        return {}
    rate = toxic / (toxic + clean)
    by_toxic = materialize(counted(rows.where("label = 1")), "toxic-features")
    features = by_toxic.count()
    least = max(3, math.ceil(math.log(max(1, features) / CHANCE) / -math.log(rate)))
    often = by_toxic.where(F.col("n") >= least).collect()
    in_toxic = {r.feature: r.n for r in often}
    in_clean = {r.feature: r.n for r in counted(rows.where("label <> 1"), frozenset(in_toxic)).collect()}
    good = {}
    for feature, n in in_toxic.items():
        m = in_clean.get(feature, 0)
        odds = math.log((n + 0.5) / (toxic + 1)) - math.log((m + 0.5) / (clean + 1))
        if odds >= LOG_ODDS and chance_of(n, n + m, rate) * features < CHANCE:
            good[feature] = (n, min(1.0, odds / FULL))
    most = Counter()  # documents of the commonest word under a beginning
    for word, n in in_toxic.items():
        if not word.endswith("*"):
            for k in BEGINNINGS:
                most[word[:k] + "*"] = max(most[word[:k] + "*"], n)
    chosen: dict[str, float] = {}
    for feature in sorted(good, key=lambda f: (not f.endswith("*"), len(f), f)):
        under = max([chosen.get(feature[:k] + "*", 0.0) for k in BEGINNINGS if k <= len(feature)], default=0.0)
        if under >= 0.9 * good[feature][1] or feature.endswith("*") and good[feature][0] < 1.5 * most[feature]:
            continue  # a beginning that stands for one word only is no more than that word
        chosen[feature] = good[feature][1]
    return chosen


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, pulled towards the grammar's own; a mark never turns into the opposite."""
    first = first_weights()
    w, a = first.copy(), np.hstack([np.ones((len(x), 1)), x])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) + PULL * (w - first)
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + PULL * np.eye(len(w)), slope)
    w[0], w[1] = min(w[0], BASE), max(w[1], 0.0)
    return w


def train(docs: DataFrame, labels: DataFrame) -> Grammar:
    """A grammar from docs (doc_id, text) and labels (doc_id, toxic); without labels of both kinds the seeds alone."""
    rows = materialize(one_of_like(labelled_rows(docs, labels, "toxic")), "toxic-rows")
    learned = learn_lexicon(rows)
    grammar = Grammar(learned)

    def run(batches):
        own = Grammar(learned)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["label", "features"])

    found = rows.select("label", "text").mapInArrow(run, "label int, features array<double>").collect()
    if found:
        y = np.array([r.label == 1 for r in found], float)
        if 0 < y.sum() < len(y):
            grammar.weights = fit_weights(np.array([r.features for r in found]), y)
    return grammar


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs.

    Whole texts are read. Null and empty texts, and texts without a trigger, get the score of no match. Rows without a
    doc_id are not held out and never learned from. Repeated rows get equal scores. Only doc_id and text of docs and
    doc_id and toxic of labels are read; empty tables give empty results.
    """
    grammar = train(docs, labels)
    learned = {**{b + "*": s for b, s in grammar.beginnings.items()}, **{w: s for w, s in grammar.strength.items() if grammar.symbols[w] == INSULT}}
    weights = grammar.weights

    def run(batches):
        own = Grammar(learned, weights)
        for batch in batches:
            scores = [own.score(own.features(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", is_held_out().alias("held_out"), body().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the grammar does not reject."""
    grammar = train(docs, labels)
    learned = {**{b + "*": s for b, s in grammar.beginnings.items()}, **{w: s for w, s in grammar.strength.items() if grammar.symbols[w] == INSULT}}
    weights, at = grammar.weights, docs.columns.index("text")

    def run(batches):
        own = Grammar(learned, weights)
        for batch in batches:
            yield batch.filter(pa.array([own.score(own.features(t.as_py() or "")) < THRESHOLD for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
