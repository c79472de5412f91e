"""URL filter by rules, and by a character language-model ratio where no rule fits, in DataFrame operations only.

Two variable-order Markov models, one of accepted and one of rejected URLs, give each character of a URL a probability
after its context. Characters fall into a fixed alphabet, so a context of up to ORDER characters is a number below a
proven bound and a whole model is a table of at most SYMBOLS ** (ORDER + 1) entries. An order's estimate is its counts
plus DISCOUNT times the next shorter order's estimate; a context that was never seen hands all of its weight down, so
the order in effect varies from place to place. The log ratio of the two models is rounded to 1/1000 and travels to the
scan as one binary literal; scoring is an indexed lookup inside the projection, without a join or a shuffle.

A URL's score is its mean log ratio a character. The threshold is calibrated on labelled URLs kept out of the counts:
the one, among all bins of their scores, with the least mean error of the two classes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import table

#: Fixed values of the query: rule and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Characters that the models tell apart; digits count as 0, upper case as lower case, others as ~.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0:/.?#=&_-%+~^"
SYMBOLS, ORDER = len(ALPHABET), 2
#: Weight of the shorter context's estimate, in counts.
DISCOUNT = 4.0
#: Scores are held in steps of 1/SCALE.
SCALE = 1000


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host in lower case (A-Z only), and path, of a URL; both empty without ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        of, slash, start = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def symbols(url: F.Column) -> F.Column:
    """The URL in the models' alphabet, with start marks before it and an end mark behind."""
    plain = F.translate(F.lower(F.coalesce(url, F.lit(""))), "123456789", "000000000")
    plain = F.regexp_replace(plain, r"(?s)[^a-z0:/.?#=&_\-%+]", "~")
    return F.concat(F.lit("^" * ORDER), plain, F.lit("^"))


def grams(column: str) -> F.Column:
    """An array of the numbers of all runs of ORDER + 1 symbols."""
    symbol = lambda at: F.position(F.substring(F.col(column), at, F.lit(1)), F.lit(ALPHABET)) - 1
    number = lambda at: sum((symbol(at + k) * SYMBOLS ** (ORDER - k) for k in range(1, ORDER + 1)), symbol(at) * SYMBOLS**ORDER)
    return F.transform(F.sequence(F.lit(1), F.length(column) - ORDER), number)


def gram_counts(urls: DataFrame) -> np.ndarray:
    """Of (url, accepted) the counts [2, SYMBOLS ** (ORDER + 1)], rejected first. The bound of the collected rows is proven."""
    runs = urls.select("accepted", symbols(F.col("url")).alias("s")).select("accepted", F.explode(grams("s")).alias("g"))
    found = runs.groupBy("accepted", "g").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros((2, SYMBOLS ** (ORDER + 1)))
    for row in found.collect():
        counts[int(row.accepted), row.g] = row.n
    return counts


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | context) of the accepted less that of the rejected, in steps, int16 for each gram."""
    logs = []
    for c in counts:
        p = np.full(SYMBOLS, 1.0 / SYMBOLS)
        for k in range(ORDER + 1):
            n = c.reshape(-1, SYMBOLS ** (k + 1)).sum(axis=0).reshape(-1, SYMBOLS)
            shorter = np.tile(p.reshape(-1, SYMBOLS), (len(n) // max(1, p.size // SYMBOLS), 1))
            p = (n + DISCOUNT * shorter) / (n.sum(axis=1, keepdims=True) + DISCOUNT)
        logs.append(np.log(p.reshape(-1)))
    return np.clip(np.rint((logs[1] - logs[0]) * SCALE), -32000, 32000).astype(">i2")


def score(url: F.Column, ratio: np.ndarray) -> F.Column:
    """Mean log ratio a symbol, in steps, as an integer number rounded down; 0 for an untrained pair of models."""
    held = F.lit(bytearray((ratio.astype(np.int32) + 32768).astype(">u2").tobytes()))
    value = lambda g: F.conv(F.hex(F.substring(held, (g * 2 + 1).cast("int"), F.lit(2))), 16, 10).cast("long") - 32768
    return F.aggregate(grams("s"), F.lit(0).cast("long"), lambda acc, g: acc + value(g)), F.length("s") - ORDER


def with_scores(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """rows with url_score: floor of the mean log ratio of url's symbols, in steps of 1/SCALE."""
    total, n = score(F.col("url"), ratio)
    return rows.withColumn("s", symbols(F.col("url"))).withColumn("url_score", F.floor(total / n)).drop("s")


def calibrate(scored: DataFrame) -> int:
    """From (url_score, accepted) the score from which on a URL is accepted. Scores are integers in a fixed range, so the table of bins is bounded."""
    bins = sorted((r.url_score, r.yes, r.no) for r in scored.groupBy("url_score").agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no")).collect())
    yes, no = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not yes or not no:
        return 0
    best, where, lost, kept_out = math.inf, 0, 0, 0
    for at, (value, y, n) in enumerate(bins):
        error = lost / yes + (no - kept_out) / no
        if error < best:
            best, where = error, (value + bins[at - 1][0] + 1) // 2 if at else value
        lost, kept_out = lost + y, kept_out + n
    return where


def train(labelled: DataFrame) -> tuple[np.ndarray, int]:
    """Log ratio table and threshold from (url, accepted); URLs with an odd MD5 are kept for the threshold."""
    odd = F.substring(F.md5(F.col("url").cast("binary")), 32, 1).isin(*"13579bdf")
    labelled = labelled.where("url IS NOT NULL AND accepted IS NOT NULL").withColumn("odd", odd)
    ratio = log_ratio(gram_counts(labelled.where("NOT odd")))
    return ratio, calibrate(with_scores(labelled.where("odd"), ratio))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, url_score of each row of pages (page_id, url).

    Without labelled URLs (url, accepted) the models learn from those that a rule allows or blocks. Where only one kind is
    there the ratio is 0 or one-sided and the threshold 0, so all else is allowed. A null URL has empty host and path, no
    rule, and the score of an empty URL. Repeated rows get equal results. Only page_id and url are read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        labelled = rows.where("ruled IS NOT NULL").select("url", (F.col("ruled") == "allow").alias("accepted"))
    ratio, threshold = train(labelled)
    told = F.when(F.col("url_score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return with_scores(rows, ratio).select("page_id", "url", "host", "path", "rule", F.coalesce("ruled", told).alias("verdict"), "url_score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "url_score")




def _fits(of: str, start: str) -> str:
    return f"(host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '/{start}')"


def _chosen(rules, pick: int) -> str:
    longest = sorted(rules, key=lambda r: -len(r[0]))
    return "CASE " + " ".join(f"WHEN {_fits(r[0].partition('/')[0], r[0].partition('/')[2])} THEN '{r[pick]}'" for r in longest) + " END"


OP3_SQL = f"""
WITH r AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
                  '{"^" * ORDER}' || regexp_replace(translate(lower(coalesce(url, '')), '123456789', '000000000'), '[^a-z0:/.?#=&_\\-%+]', '~', 'g') || '^' AS s FROM pages),
h AS (SELECT page_id, url, s, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
p AS (SELECT *, {_chosen(RULES, 0)} AS rule, {_chosen(RULES, 1)} AS ruled, contains('13579bdf', substr(md5(url), 32, 1)) AS odd FROM h),
i AS (SELECT page_id, ruled, odd, url, s, unnest(range(1, length(s) - 1)) AS i FROM p),
g AS (SELECT page_id, substr(s, i, 1) AS a, substr(s, i + 1, 1) AS b, substr(s, i + 2, 1) AS c, CASE WHEN url IS NOT NULL AND NOT odd THEN ruled END AS k FROM i),
u AS (SELECT DISTINCT a, b, c FROM g), k AS (SELECT unnest(['allow', 'block']) AS k),
n3 AS (SELECT k, a, b, c, count(*)::DOUBLE AS n FROM g WHERE k IS NOT NULL GROUP BY ALL), n3s AS (SELECT k, a, b, sum(n) AS n FROM n3 GROUP BY ALL),
n2 AS (SELECT k, b, c, sum(n) AS n FROM n3 GROUP BY ALL), n2s AS (SELECT k, b, sum(n) AS n FROM n2 GROUP BY ALL),
n1 AS (SELECT k, c, sum(n) AS n FROM n3 GROUP BY ALL), n1s AS (SELECT k, sum(n) AS n FROM n1 GROUP BY ALL),
q0 AS (SELECT u.*, k.k, (coalesce(n1.n, 0) + {DISCOUNT}::DOUBLE * (1.0::DOUBLE / {SYMBOLS})) / (coalesce(n1s.n, 0) + {DISCOUNT}::DOUBLE) AS p
       FROM u CROSS JOIN k LEFT JOIN n1 ON n1.k = k.k AND n1.c = u.c LEFT JOIN n1s ON n1s.k = k.k),
q1 AS (SELECT q0.* EXCLUDE (p), (coalesce(n2.n, 0) + {DISCOUNT}::DOUBLE * p) / (coalesce(n2s.n, 0) + {DISCOUNT}::DOUBLE) AS p
       FROM q0 LEFT JOIN n2 ON n2.k = q0.k AND n2.b = q0.b AND n2.c = q0.c LEFT JOIN n2s ON n2s.k = q0.k AND n2s.b = q0.b),
q2 AS (SELECT q1.* EXCLUDE (p), (coalesce(n3.n, 0) + {DISCOUNT}::DOUBLE * p) / (coalesce(n3s.n, 0) + {DISCOUNT}::DOUBLE) AS p
       FROM q1 LEFT JOIN n3 ON n3.k = q1.k AND n3.a = q1.a AND n3.b = q1.b AND n3.c = q1.c LEFT JOIN n3s ON n3s.k = q1.k AND n3s.a = q1.a AND n3s.b = q1.b),
w AS (SELECT x.a, x.b, x.c, greatest(-32000, least(32000, round((ln(x.p) - ln(y.p)) * {SCALE}))) AS w FROM q2 x JOIN q2 y ON x.a = y.a AND x.b = y.b AND x.c = y.c WHERE x.k = 'allow' AND y.k = 'block'),
v AS (SELECT page_id, floor(sum(w) / count(*))::BIGINT AS url_score FROM g JOIN w ON g.a = w.a AND g.b = w.b AND g.c = w.c GROUP BY page_id),
f AS (SELECT p.*, v.url_score FROM p JOIN v ON p.page_id = v.page_id),
b AS (SELECT url_score, count_if(ruled = 'allow') AS yes, count_if(ruled = 'block') AS no FROM f WHERE url IS NOT NULL AND odd AND ruled IS NOT NULL GROUP BY url_score),
t AS (SELECT url_score, lag(url_score) OVER (ORDER BY url_score) AS before, (sum(yes) OVER ())::DOUBLE AS y, (sum(no) OVER ())::DOUBLE AS n,
             (sum(yes) OVER (ORDER BY url_score) - yes)::DOUBLE AS lost, (sum(no) OVER (ORDER BY url_score) - no)::DOUBLE AS kept_out FROM b),
z AS (SELECT CASE WHEN before IS NULL THEN url_score ELSE floor((url_score + before + 1) / 2.0)::BIGINT END AS threshold FROM t WHERE y > 0 AND n > 0
      ORDER BY lost / y + (n - kept_out) / n, url_score LIMIT 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN url_score >= coalesce((SELECT threshold FROM z), 0) THEN 'allow' ELSE 'block' END) AS verdict, url_score FROM f
"""
