"""Text normalisation and text statistics as column expressions, in the JVM but for the rare texts that are not in normal form C.

White space means what Python's str.isspace means; Java's own classes differ, so every pattern spells its characters out.
A column expression that is named twice is computed twice, so functions here name their input once, or bind it with let.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space, and its complement, as the members of a character class.
WS_SET = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS, NOT_WS = f"[{WS_SET}]", f"[^{WS_SET}]"
WS_CHARACTERS = "".join(chr(i) for i in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: White space other than the space and LF.
_BLANKS = "".join(c for c in WS_CHARACTERS if c not in " \n")
#: Where str.splitlines breaks, LF and CR LF aside.
_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
WORD_SET = r"\p{L}\p{N}_"
#: Letters and digits that the scores count; fragments of answers that hold no page text.
ALNUM_CHARACTERS = "".join(chr(i) for a, b in ("09", "AZ", "az", "ÀÖ", "Øö", "øÿ") for i in range(ord(a), ord(b) + 1))
GENERIC_FRAGMENTS = (
    "transforme uma imagem",
    "no texto extração",
    "the text in the image",
    "the text content",
    "cannot be extracted",
    "not visible in the image",
    "texto não está visível",
    "não é possível extrair",
)


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once, however often use names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


#: Characters that normal form C may change or join to the one before: marks, Korean letters, and those that stand for others.
_NOT_COMPOSED = (
    # one range is asked first, which hardly a character is in
    r"[\x{300}-\x{10FFFF}&&[\p{M}\x{374}\x{37E}\x{387}\x{958}-\x{95F}\x{9DC}-\x{9DF}\x{A33}-\x{A5E}\x{B5C}\x{B5D}\x{F43}-\x{F69}\x{1100}-\x{11FF}\x{1F71}-\x{1FFD}"
    r"\x{2000}\x{2001}\x{2126}-\x{212B}\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]]"
)


@F.pandas_udf(T.StringType())
def _composed(c: pd.Series) -> pd.Series:
    return c.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: Characters below U+0100 that a line is not recognised by.
_NOT_KEPT = "".join(c for c in map(chr, range(1, 0x100)) if not (c in " \n" or "0" <= c <= "9" or "a" <= c <= "z" or "à" <= c <= "ö" or "ø" <= c <= "ÿ"))


def nfc(c: Column, of: Column | None = None) -> Column:
    """Unicode normal form C, null as empty. Only texts with a character that it may change go through Python; of, if c takes
    long to compute, is a plain column that holds all of c's characters. Deterministic, so filters on other columns pass below it.
    """
    seen = c if of is None else of
    may = (F.octet_length(seen) != F.length(seen)) & seen.rlike(_NOT_COMPOSED)
    return F.coalesce(_composed(F.when(may, c)), c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARACTERS))


def display_text(c: Column, of: Column | None = None) -> Column:
    """NFC; line ends as LF; NBSP as space; no U+200B; one space for a run of blanks; single blank lines inside only. of as for nfc."""
    text = F.replace(F.replace(nfc(c, of), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    text = F.regexp_replace(text, r"[ \t\f\x0B]{2,}|[\t\f\x0B]", " ")
    text = F.array_join(F.transform(F.split(text, "\n", -1), strip), "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def one_line(display: Column) -> Column:
    """A normalised text on one line, single spaces between words."""
    return F.trim(F.regexp_replace(F.translate(display, _BLANKS + "\n", " " * len(_BLANKS + "\n")), " {2,}", " "))


def scoring_text(display: Column, raw: Column) -> Column:
    """The text that rates compare: a raw text's display_text, normalised once more, then on one line. Only NFC can change it again, where a U+200B was removed."""
    joined = _composed(F.when(F.contains(raw, F.lit("\u200b")), display))
    return one_line(F.coalesce(joined, display))


def count_words(c: Column) -> Column:
    return let(one_line(F.coalesce(c, F.lit(""))), count_spaced_words)


def count_spaced_words(c: Column) -> Column:
    """count_words of a scoring text, of a page or of a document: its words are parted by one space or line end each, so these are counted."""
    return F.when(c != "", F.length(c) - F.length(F.translate(c, " \n", "")) + 1).otherwise(F.lit(0))


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{WS}+", -1), lambda w: w != "")


def _with_lf(c: Column) -> Column:
    """A text whose lines end with LF, wherever str.splitlines breaks."""
    return F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), _BREAKS, "\n" * len(_BREAKS))


def lines(c: Column) -> Column:
    return F.split(_with_lf(c), "\n", -1)


def count_lines(c: Column) -> Column:
    """Lines that are not blank."""
    return F.size(F.filter(lines(c), lambda line: strip(line) != ""))


def count_alnum(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, ALNUM_CHARACTERS, ""))


def text_counts(c: Column) -> Column:
    """struct(text, alnum, words, lines, distinct) of a text, null counting as empty: what scores and judgements are made of."""
    return let(
        F.coalesce(c, F.lit("")),
        lambda t: F.struct(
            t.alias("text"),
            count_alnum(t).alias("alnum"),
            F.regexp_count(t, F.lit(f"[{WORD_SET}]+")).alias("words"),
            count_lines(t).alias("lines"),
            F.size(F.array_distinct(F.split(t, ""))).alias("distinct"),
        ),
    )


def score_of(counts: Column) -> Column:
    """Letters and digits, 0.7 a word, 0.3 a line, 8 times distinct characters / length; 0 for an empty text."""
    diversity = counts["distinct"] / F.length(counts["text"])
    found = counts["alnum"] + counts["words"] * F.lit(0.7) + counts["lines"] * F.lit(0.3) + diversity * F.lit(8.0)
    return F.when(counts["text"] == "", F.lit(0.0)).otherwise(found)


def score_text(c: Column) -> Column:
    """score_of a text."""
    return let(text_counts(c), score_of)


def normal_line(c: Column) -> Column:
    """A line as repeats are recognised: lower case, single spaces, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), f"{WS}+", " "), r"[^a-zà-öø-ÿ0-9 ]+", "")


def _before(rows: Column) -> Column:
    """rows moved up by one: each row's predecessor, null for the first."""
    return F.concat(F.array(F.lit(None)), F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0))))


def dedupe_lines(c: Column) -> Column:
    """Drops lines without letters and lines like the last kept one (blank lines between don't count); at most one blank line in a row.

    A line is like the last kept one exactly if it is like its predecessor among the lines that are not blank and have letters,
    since a dropped line is like the one it was dropped for. So no line waits for another, and the cost is in proportion to the text.
    """
    text = _with_lf(F.coalesce(c, F.lit("")))

    def split_both(t: Column) -> Column:
        raw = F.transform(F.split(t, "\n", -1), lambda line: F.rtrim(line, F.lit(WS_CHARACTERS)))
        norm = F.regexp_replace(F.translate(F.lower(t), _BLANKS, " " * len(_BLANKS)), " {2,}", " ")
        norm = F.translate(F.trim(F.regexp_replace(norm, r" \n ?|\n ", "\n")), _NOT_KEPT, "")
        norm = F.regexp_replace(norm, r"[^\x01-\x{FF}]+", "")
        return F.arrays_zip(raw.alias("raw"), F.split(norm, "\n", -1).alias("norm"))

    numbered = F.transform(let(text, split_both), lambda x, i: F.struct(x["raw"].alias("raw"), x["norm"].alias("norm"), i.alias("i")))
    filled = F.filter(numbered, lambda x: x["raw"] != "")
    # blanks: blank lines before a line
    filled = F.transform(filled, lambda x, k: F.struct(x["raw"].alias("raw"), x["norm"].alias("norm"), (x["i"] - k).alias("blanks")))
    filled = F.filter(filled, lambda x: x["norm"] != "")
    kept = let(filled, lambda rows: F.zip_with(rows, _before(rows), lambda x, last: F.when(last.isNull() | (last["norm"] != x["norm"]), x)))
    kept = F.filter(kept, lambda x: x.isNotNull())
    joined = let(kept, lambda rows: F.zip_with(rows, _before(rows), lambda x, last: F.when(last["blanks"] < x["blanks"], F.concat(F.lit("\n"), x["raw"])).otherwise(x["raw"])))
    return display_text(F.array_join(joined, "\n"), c)


#: Fixed values in the two functions below: the markup that is recognised.
def _rewritten(line: Column) -> Column:
    """Inline markup of one stripped line."""
    for pattern, to in (
        (rf"\A#{{1,6}}{WS}+", ""),
        (rf"\A[-*+]{WS}+", ""),
        (r"</?(?:p|br|div|tr|td|th|table|thead|tbody|ul|ol|li|h[1-6])[^>]*>", " "),
        (r"<[^>]+>", ""),
        (r"!\[[^\]]*\]\([^)]+\)", ""),
        (rf"(?i)!{NOT_WS}+\.(?:png|jpe?g|gif|webp)(?![{WORD_SET}])", ""),
        (r"(?d)\[(.*?)\]\((.*?)\)", "$1"),
        (r"`([^`]*)`", "$1"),
    ):
        line = F.regexp_replace(line, pattern, to)
    return line


def _cells_joined(line: Column) -> Column:
    """The cells of a table row, joined by spaces; null for a row of rules."""
    cells = F.transform(F.split(F.regexp_replace(line, r"\A\|+|\|+\z", ""), r"\|", -1), lambda c: F.regexp_replace(strip(c), f"{WS}+", " "))
    joined = F.array_join(F.filter(cells, lambda c: (c != "") & ~c.rlike(rf"\A[{WS_SET}:\-]+\z")), " ")
    rule = line.rlike(rf"\A\|?[{WS_SET}:\-]+\|[{WS_SET}|:\-]*\z")
    return F.when(~F.contains(line, F.lit("|")), line).when(rule, F.lit(None)).when(joined == "", line).otherwise(joined)


def cleanup_markup(c: Column) -> Column:
    """Removes the markup that language models add: fences, headings, bullets, tags, images, links, code, table rules, emphasis, bare references.

    Lines that were blank stay; lines that become empty go.
    """
    text = strip(F.coalesce(c, F.lit("")))
    unfenced = F.regexp_replace(F.regexp_replace(text, r"\A```[a-zA-Z0-9_-]*\n?", ""), r"\n?```\z", "")
    text = F.regexp_replace(F.when(text.startswith("```"), unfenced).otherwise(text), r"\r\n?", "\n")
    rows = F.transform(F.split(text, "\n", -1), strip)
    rows = F.transform(rows, lambda line: F.struct((line == "").alias("blank"), _rewritten(line).alias("s")))
    rows = F.transform(rows, lambda r: F.struct(r["blank"].alias("blank"), _cells_joined(r["s"]).alias("s")))
    rows = F.transform(rows, lambda r: F.struct(r["blank"].alias("blank"), strip(F.replace(F.replace(r["s"], F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))).alias("s")))
    bare = r"\A\[\p{Nd}+\]\z|(?i)\A\[(?:handwritten|illustration|image|photo|figure)[^\]]*\]\z"
    kept = F.filter(rows, lambda r: r["blank"] | (r["s"].isNotNull() & (r["s"] != "") & ~r["s"].rlike(bare)))
    return F.array_join(F.transform(kept, lambda r: F.when(r["blank"], F.lit("")).otherwise(r["s"])), "\n")


def engine_text(c: Column, markup: bool) -> Column:
    """An engine's raw text: normalised, after markup clean-up for engines that answer in Markdown."""
    return display_text(cleanup_markup(c), c) if markup else display_text(c)
