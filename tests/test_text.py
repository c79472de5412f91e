"""Text functions against plain statements of the same rules in Python, over random strings with every odd character."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from folioscope.functions import text

ODD = list("ab Z1é") + ["́", "\r", "\n", "\r\n", " ", "​", " ", "\x0b", "\x0c", "\x1c", "\x85", " ", "　", ".", "|", "#", "*", "_", "[", "]", "`", "<p>", "-", ":", "1", "(", ")", "!"]


def strings(n, seed, longest=25):
    r = random.Random(seed)
    return ["".join(r.choices(ODD, k=r.randint(0, longest))) for _ in range(n)] + ["", " ", "\n\n a \n\n\n b\n"]


def display(s):
    s = unicodedata.normalize("NFC", s or "")
    s = re.sub("\r\n?", "\n", s).translate({0xA0: " ", 0x200B: None})
    kept = []
    for line in (re.sub("[ \t\f\v]+", " ", x).strip() for x in s.split("\n")):
        if line or kept and kept[-1]:
            kept.append(line)
    return "\n".join(kept).rstrip("\n") if kept and not kept[-1] else "\n".join(kept)


def scoring(s):
    return " ".join(display(s).split())


def deduped(s):
    kept, last = [], None
    for line in s.splitlines():
        norm = re.sub("[^a-zà-öø-ÿ0-9 ]", "", " ".join(line.lower().split()))
        if not line.strip():
            kept += [""] if kept and kept[-1] else []
        elif norm and norm != last:
            kept.append(line.rstrip())
            last = norm
    return display("\n".join(kept))


def on(spark, values, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [[r[f"c{k}"] for r in rows] for k in range(len(columns))]


def test_normal_forms(spark):
    values = strings(3000, 1)
    shown, scored, words, lines = on(spark, values, text.display_text(F.col("s")), text.scoring_text(text.display_text(F.col("s")), F.col("s")), text.count_words(F.col("s")), text.count_lines(F.col("s")))
    assert shown == [display(v) for v in values]
    assert scored == [scoring(display(v)) for v in values]
    assert words == [len(v.split()) for v in values]
    assert lines == [sum(bool(x.strip()) for x in v.splitlines()) for v in values]


def test_normal_form_c_of_every_character(spark):
    """Each character alone, after a letter that marks join, after Korean letters, and with a mark behind it."""
    chars = [chr(i) for i in range(0x20, 0x30000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    values = [f"{before}{c}{after}" for c in chars for before, after in (("x", "y"), ("a", ""), ("\u1100", "\u11a8"), ("", "\u0301"))]
    (got,) = on(spark, values, text.nfc(F.col("s")))
    wrong = [(v, g) for v, g in zip(values, got) if g != unicodedata.normalize("NFC", v)]
    assert not wrong, (len(wrong), wrong[:20])


def test_zero_width_space_between_letter_and_mark(spark):
    value = "e\u200b\u0301 te\u0301"
    (shown, scored) = on(spark, [value], text.display_text(F.col("s")), text.scoring_text(text.display_text(F.col("s")), F.col("s")))
    assert shown == ["e\u0301 t\u00e9"] and scored == ["\u00e9 t\u00e9"]


def test_dedupe_lines(spark):
    values = strings(1500, 2, 40)
    (got,) = on(spark, values, text.dedupe_lines(F.col("s")))
    assert got == [deduped(v) for v in values]


def test_null_is_empty(spark):
    got = on(spark, [None], text.display_text(F.col("s")), text.count_words(F.col("s")), text.score_text(F.col("s")), text.cleanup_markup(F.col("s")), text.dedupe_lines(F.col("s")))
    assert [g[0] for g in got] == ["", 0, 0.0, "", ""]


def test_markup(spark):
    cases = {
        "```python\nx = 1\n```": "x = 1",
        "# Title\n\n- item **bold**": "Title\n\nitem bold",
        "a<br/>b <i>c</i>": "a b c",
        "see [here](http://x) and ![](p.png)": "see here and",
        "| a | b |\n|---|:-:|\n| 1 |  |": "a b\n1",
        "[12]\n[Image of a cat]\n[13a]": "[13a]",
        "`code` __u__": "code u",
        "keep\n\n<b></b>\nlast": "keep\n\nlast",
        "||": "||",
    }
    (got,) = on(spark, list(cases), text.cleanup_markup(F.col("s")))
    assert got == list(cases.values())


def test_score(spark):
    def score(s):
        if not s:
            return 0.0
        lines = sum(bool(x.strip()) for x in s.splitlines())
        return len(re.findall("[A-Za-zÀ-ÖØ-öø-ÿ0-9]", s)) + len(re.findall(r"\b\w+\b", s)) * 0.7 + lines * 0.3 + len(set(s)) / len(s) * 8.0

    values = ["", "one two", "é½ x_1\n\nb", "🙂 ok"]
    (got,) = on(spark, values, text.score_text(F.col("s")))
    assert [round(g, 9) for g in got] == [round(score(v), 9) for v in values]


def test_long_texts_in_proportion(spark):
    """A text of 100,000 lines: no array grows in a fold."""
    lines = [f"line {i // 2}" if i % 7 else "" for i in range(100_000)]
    (got,) = on(spark, ["\n".join(lines)], text.dedupe_lines(F.col("s")))
    assert got[0] == deduped("\n".join(lines))


#: Fixed value: what counts as a phrase that repeats.
PHRASE = re.compile(r"(\b[\w-]{3,}(?:\s+\b[\w-]{3,}){0,3})(?:\s+\1){3,}")


def test_repeated_phrases_as_the_pattern_finds_them(spark):
    from folioscope.operators import quality

    r = random.Random(7)
    words = ["abc", "abcd", "xabc", "ab", "a-bc", "-abc", "abc-", "é__", "...", "def", "abc.", "_-a", "--abc", "x--abc"]
    values = [" ".join(r.choices(words[: r.randint(1, 14)], k=r.randint(0, 40))) for _ in range(4000)]
    values += [("x-" if i % 2 else "") + " ".join(["one two three four"[: 3 + 4 * (i % 4)].strip()] * (3 + i % 3)) + ("more" if i % 3 else "") for i in range(60)]
    # nearly repeated phrases: a word of a few repeats is changed, cut or lengthened
    for _ in range(4000):
        phrase = r.choices(words, k=r.randint(1, 5))
        w = phrase * r.randint(3, 5)
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(w))
            w[i] = r.choice([w[i] + "x", w[i][1:], "y" + w[i], "y-" + w[i], w[i][:-1], w[i]])
        values.append(" ".join([r.choice(words), *w, r.choice(words)]))
    df = spark.createDataFrame([(v,) for v in values], "s string")
    norm = F.lower(text.scoring_text(text.display_text(F.col("s")), F.col("s")))
    split = F.split(norm, " ")
    tokens = F.regexp_extract_all(norm, F.lit("[a-zà-öø-ÿ0-9]+"), F.lit(0))
    rows = df.select(norm.alias("norm"), quality._may_repeat(split).alias("may"), quality.has_repeated_phrase(split).alias("phrase"), quality.runaway_repetition(F.col("s")).alias("got"), quality.longest_run(tokens).alias("run")).collect()
    plain = [PHRASE.search(x.norm) is not None for x in rows]
    assert 500 < sum(plain) < len(rows) - 500
    assert [x.phrase for x in rows] == plain
    assert all(x.may for x, p in zip(rows, plain) if p)
    assert all(x.got == (p or x.run >= quality.LONGEST_RUN) for x, p in zip(rows, plain))


def test_repeated_phrases_in_long_texts(spark):
    """100,000 words of which many repeat at a phrase's distance but no phrase stands four times; then one at the end."""
    from folioscope.operators import quality

    words = [f"word{i // 9}" if i % 9 < 3 else f"w{i}x" for i in range(100_000)]
    (got,) = on(spark, [" ".join(words), " ".join(words + ["far away"] * 4)], quality.has_repeated_phrase(F.split(F.col("s"), " ")))
    assert got == [False, True]


def test_normalisation_looks_for_no_class_of_white_space(spark):
    """Patterns that begin with a large class cost most of the time; characters are translated instead, and few patterns are left."""
    plan = lambda c: spark.range(1).select(F.col("id").cast("string").alias("t")).select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    for made, patterns in ((text.display_text(F.col("t")), 2), (text.one_line(F.col("t")), 1), (text.dedupe_lines(F.col("t")), 8)):
        assert plan(made).count("regexp_replace(") <= patterns and "\\x{2028}" not in plan(made)
