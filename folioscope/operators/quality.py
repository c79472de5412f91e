"""Judgements on extracted text: generic answers, acceptable text, runaway repetition, suspicion, what may be reused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.geometry import max_reasonable_chars
from folioscope.functions.text import GENERIC_FRAGMENTS, WORD_SET, count_alnum, count_lines, display_text, let, one_line, score_of, scoring_text, strip, text_counts

#: Fixed values of the judgements.
LEAST_ALNUM, LEAST_SCORE, LONGEST_RUN, MANY_TOKENS, LEAST_DISTINCT = 25, 90, 6, 600, 0.22
#: Fragments of fatal engine errors depend on the engine; codes after which a request is tried again.
RETRYABLE = (408, 409, 429, 500, 502, 503, 504)
#: Fixed values of repeated phrases: words of a phrase at most, the copies in a row that count.
PHRASE_WORDS, PHRASE_COPIES = 4, 4
_LETTER, _LONG = rf"[{WORD_SET}]", rf"\A[{WORD_SET}-]{{3,}}\z"


def generic_of(counts: Column) -> Column:
    """Of text_counts: empty, or an answer about the image instead of its text, or one line with hardly a letter."""
    about = let(one_line(F.lower(counts["text"])), lambda norm: reduce(lambda a, b: a | b, [F.contains(norm, F.lit(f)) for f in GENERIC_FRAGMENTS]))
    return (counts["text"] == "") | ((counts["alnum"] < LEAST_ALNUM) & (counts["lines"] <= 1)) | about


def judgement(c: Column) -> Column:
    """struct(generic, acceptable, score) of a text, its counts taken once."""

    def judged(counts: Column) -> Column:
        generic = F.struct(generic_of(counts).alias("generic"), score_of(counts).alias("score"), (counts["text"] != "").alias("filled"))
        return let(generic, lambda j: F.struct(j["generic"].alias("generic"), (j["filled"] & ~j["generic"] & (j["score"] >= LEAST_SCORE)).alias("acceptable"), j["score"].alias("score")))

    return let(text_counts(c), judged)


def is_generic_response(c: Column) -> Column:
    """generic_of a text."""
    counts = lambda t: F.struct(t.alias("text"), count_alnum(t).alias("alnum"), count_lines(t).alias("lines"))
    return let(let(F.coalesce(c, F.lit("")), counts), generic_of)


def is_acceptable_text(c: Column) -> Column:
    return judgement(c)["acceptable"]


def longest_run(tokens: Column) -> Column:
    """Length of the longest run of equal neighbours."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, t: Column) -> Column:
        run = F.when(t.eqNullSafe(acc["last"]), acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(tokens, start, step, lambda acc: acc["best"])


def equal_run(tokens: Column, apart: int, n: int) -> Column:
    """Whether n tokens in a row equal the tokens so many places behind them."""
    flags = F.zip_with(tokens, F.slice(tokens, F.lit(apart + 1), F.greatest(F.size(tokens) - apart, F.lit(0))), lambda a, b: F.when(a == b, "1").otherwise("0"))
    return F.contains(F.array_join(flags, ""), F.lit("1" * n))


def _may_repeat(w: Column) -> Column:
    """Necessary for a repeated phrase: of four equal phrases of k words, the inner two and the inner ends of the outer two are whole words."""
    return reduce(lambda a, b: a | b, [equal_run(w, k, (PHRASE_COPIES - 1) * k - 2) for k in range(1, PHRASE_WORDS + 1)])


def _shift(w: Column, by: int) -> Column:
    """w without its first members; zip_with fills up with nulls."""
    return F.slice(w, F.lit(by + 1), F.greatest(F.size(w) - by, F.lit(0)))


def _opens(word: Column, copy: Column) -> Column:
    """Whether the phrase's first word, a whole word in its copies, ends this word and begins at an edge of letters and others."""
    letter = lambda c: c.rlike(_LETTER)
    before = F.length(word) - F.length(copy)
    inner = letter(F.substring(word, before, F.lit(1))) != letter(F.left(copy, F.lit(1)))
    return F.endswith(word, copy) & copy.rlike(_LONG) & F.when(before > 0, inner).otherwise(letter(F.left(copy, F.lit(1))))


def _phrase_of(w: Column, k: int) -> Column:
    """Whether a phrase of k words stands four times in a row in words parted by single spaces.

    Its first copy may begin inside a word and its last one end inside a word; all words between equal the words k places on. So
    each place has a digit that says what it may be: one at which a phrase opens (1), one of an equal word (2) that may also be a later word of the
    first copy (4), one whose copy begins the word k places on (8). What is looked for is then a run of fixed length over these digits.
    """

    def place(word: Column, on: Column) -> Column:
        # a place without a word that far on has nothing
        here = F.when(on.isNull(), F.lit(0)).when(word == on, F.when(word.rlike(_LONG), F.when(F.left(word, F.lit(1)).rlike(_LETTER), F.lit(6)).otherwise(F.lit(2))).otherwise(F.lit(0))).otherwise(F.lit(0))
        opens = F.when(on.isNotNull() & _opens(word, on), F.lit(1)).otherwise(F.lit(0))
        ends = F.when(on.isNotNull() & F.startswith(on, word) & word.rlike(_LONG), F.lit(8)).otherwise(F.lit(0))
        return F.substring(F.lit("ABCDEFGHIJKLMNOP"), here + opens + ends + 1, F.lit(1))

    def having(bits: int) -> str:
        return "[" + "".join("ABCDEFGHIJKLMNOP"[i] for i in range(16) if i & bits == bits) + "]"

    later = f"{having(6)}{{{k - 1}}}{having(2)}{{{2 * k - 1}}}"
    return F.array_join(F.zip_with(w, _shift(w, k), place), "").rlike(f"{having(1)}{later}{having(8)}")


def has_repeated_phrase(w: Column) -> Column:
    """Whether one to four words of three or more letters, digits, _ or - stand four times in a row; linear in the words."""
    return reduce(lambda a, b: a | b, [_phrase_of(w, k) for k in range(1, PHRASE_WORDS + 1)])


def _runaway(norm: Column) -> Column:
    """Of a lower-case text on one line."""
    tokens = F.regexp_extract_all(norm, F.lit("[a-zà-öø-ÿ0-9]+"), F.lit(0))
    few = lambda t: (F.size(t) > MANY_TOKENS) & (F.size(F.array_distinct(t)) / F.size(t) < LEAST_DISTINCT)
    phrases = let(F.split(norm, " "), lambda w: F.when(_may_repeat(w), has_repeated_phrase(w)).otherwise(F.lit(False)))
    return let(tokens, lambda t: few(t) | equal_run(t, 1, LONGEST_RUN - 1)) | phrases


def runaway_repetition(c: Column) -> Column:
    """A phrase four times in a row, a token six times, or very few distinct tokens among many.

    Where phrases begin and end is looked at only where words repeat at a phrase's distance.
    """
    return let(F.lower(scoring_text(display_text(c), c)), _runaway)


def with_runaway_repetition(df: DataFrame, text: str, to: str = "runaway") -> DataFrame:
    """df with to: runaway_repetition of the text."""
    return df.withColumn(to, runaway_repetition(F.col(text)))


def with_suspicion(df: DataFrame, text: str, width: str, height: str, to: str = "suspicious") -> DataFrame:
    """df with to: a text too long for its page, or with runaway repetition."""
    long = lambda t: F.length(t) > max_reasonable_chars(F.col(width), F.col(height))
    judged = lambda t: (t != "") & (long(t) | let(F.lower(t), _runaway))
    return df.withColumn(to, let(scoring_text(display_text(F.col(text)), F.col(text)), judged))


def reusable_pages(cached: DataFrame, page_count: Column | None = None) -> DataFrame:
    """Cached pages that need no new extraction: no error, a text that says something, a page number in range."""
    good = (strip(F.coalesce("error", F.lit(""))) == "") & (strip(F.coalesce("text", F.lit(""))) != "") & ~is_generic_response(F.col("text"))
    number = F.col("page").try_cast("int")
    return cached.where(good & (number >= 1) & (number <= page_count if page_count is not None else F.lit(True)))


def confident(text: Column, confidence: Column, least: float, unknown: float) -> Column:
    """False for a short text (two characters at most) below the least confidence; unparseable confidence counts as unknown."""
    return ~((F.coalesce(confidence.try_cast("double"), F.lit(unknown)) < least) & (F.length(text) <= 2))


def is_retryable(status: Column, attempts_left: Column) -> Column:
    return status.isin(*RETRYABLE) & (attempts_left > 0)


def is_fatal_error(message: Column, fragments) -> Column:
    """True if the message holds one of the engine's fatal fragments."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(f)) for f in fragments], F.lit(False))
