"""The registered queries and the SQL that states their results.

The tables hold no extraction results, so candidate engines are made from their texts by fixed rules: one that copies,
one that confuses letters, one that lacks every third page, one that drops every fourth word, one that fails on some
pages, one with a page too many. A benchmark item or a conversation is a document, a sentence or a turn a page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import distance, geometry, names, text
from folioscope.operators import evaluate, layout, quality, select, standardize
from folioscope.plans import charts
from folioscope.sources import documents, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt by key to all cores if it is read in fewer splits than there are cores; larger tables are taken as they come, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


#: Rows that one task groups and sorts, about.
TASK_ROWS = 1_000_000


def tasks_for(df: DataFrame) -> int | None:
    """Tasks of TASK_ROWS for a table's rows, which its files' footers tell; none if the session's own number of tasks is enough."""
    n = -(-df.count() // TASK_ROWS)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, key: str, tasks: int | None) -> DataFrame:
    """df dealt by key once for all that is grouped by it and more; into so many tasks, so that what one holds doesn't grow with the table."""
    return df.repartition(tasks, key) if tasks else df.repartition(key)


# ---- documents of pages, and what engines make of them

SQL_BENCHMARK_PAGES = """
p AS (SELECT doc, i AS page, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS t
      FROM (SELECT item_id AS doc, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS i FROM benchmark)
      WHERE trim(regexp_replace(s, '\\s+', ' ', 'g')) <> '')"""
SQL_CONVERSATION_PAGES = "p AS (SELECT conv_id AS doc, turn + 1 AS page, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)"
SQL_CANDIDATES = """
c AS (SELECT doc, page, 'copy' AS model, t, false AS failed FROM p
      UNION ALL SELECT doc, page, 'confuse', translate(t, 'elo', 'c10'), false FROM p
      UNION ALL SELECT doc, page, 'drop_pages', t, false FROM p WHERE page % 3 <> 0
      UNION ALL SELECT doc, page, 'drop_words', array_to_string(list_filter(string_split(t, ' '), lambda w, i: (i - 1) % 4 <> 3), ' '), false FROM p
      UNION ALL SELECT doc, page, 'failing', CASE WHEN page % 5 = 2 THEN '' ELSE t END, page % 5 = 2 FROM p
      UNION ALL SELECT doc, page, 'extra_page', t, false FROM p
      UNION ALL SELECT doc, 1000, 'extra_page', 'one page too many', false FROM (SELECT DISTINCT doc FROM p))"""


def benchmark_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "benchmark"), "item_id").select(F.col("item_id").alias("doc"), F.posexplode(F.split("text", r"\.", -1)).alias("ord", "text"))
    return rows.where(text.one_line(F.col("text")) != "").withColumn("page", F.col("ord") + 1)


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations"), "conv_id").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).cast("int").alias("page"), F.col("turn").alias("ord"), "text")


def candidates(pages: DataFrame) -> DataFrame:
    """Raw pages of six engines, made in one pass over the pages."""
    t, page = F.col("text"), F.col("page")
    line = text.one_line(t)

    def made(model: str, of: Column, keep: Column, error: Column | None = None, number: Column = page) -> Column:
        error = F.lit(None).cast("string") if error is None else error
        return F.when(keep, F.struct(F.lit(model).alias("model"), number.cast("string").alias("page"), of.alias("text"), error.alias("error")))

    always, broken = F.lit(True), page % 5 == 2
    rows = F.array(
        made("copy", t, always),
        made("confuse", F.translate(t, "elo", "c10"), always),
        made("drop_pages", t, page % 3 != 0),
        made("drop_words", F.array_join(F.filter(F.split(line, " "), lambda _, i: i % 4 != 3), " "), always),
        made("failing", F.when(broken, F.lit("")).otherwise(t), always, F.when(broken, F.lit("engine failed"))),
        made("extra_page", t, always),
    )
    raw = pages.select("doc", "ord", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("doc", "ord", "r.*")
    extra = pages.select("doc").distinct().select("doc", F.lit(1000).alias("ord"), F.lit("extra_page").alias("model"), F.lit("1000").alias("page"), F.lit("one page too many").alias("text"), F.lit(None).cast("string").alias("error"))
    seconds = (F.length("text") * 7 % 1000 / 1000.0).cast("string")
    return raw.unionByName(extra).withColumn("processing_seconds", seconds)


def reference_and_candidates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    reference = standardize.standardize_pages(pages.withColumn("page", F.col("page").cast("string")))
    return reference, standardize.standardize_pages(candidates(pages))


def _encoded(a: str, b: str, split: str, v: str) -> str:
    """DuckDB's levenshtein counts bytes: both sides are written in the pair's own alphabet v of at most 127 symbols."""
    code = lambda x: f"array_to_string(list_transform({split.format(x)}, lambda w: chr(list_position({v}, w)::INT)), '')"
    return f"levenshtein({code(a)}, {code(b)})"


def _alphabets(source: str) -> str:
    """CTE y: source with the alphabets vc of characters and vw of words of its columns a and b."""
    both = lambda split: f"list_distinct(list_concat({split.format('a')}, {split.format('b')}))"
    return f"y AS MATERIALIZED (SELECT *, {both(CHARS)} AS vc, {both(WORDS)} AS vw FROM {source})"


CHARS, WORDS = "list_filter(string_split({0}, ''), lambda x: x <> '')", "list_filter(string_split(replace({0}, chr(10), ' '), ' '), lambda x: x <> '')"
SQL_RATE = "CASE WHEN {1} > 0 THEN {0}::DOUBLE / {1} WHEN {0} = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END"


def n_words(c: str) -> str:
    return f"len({WORDS.format(c)})"


@query(f"""
WITH {SQL_BENCHMARK_PAGES}, {SQL_CANDIDATES},
r AS (SELECT doc, string_agg(t, chr(10) ORDER BY page) AS a FROM p GROUP BY doc),
h AS (SELECT doc, model, coalesce(string_agg(t, chr(10) ORDER BY page) FILTER (t <> ''), '') AS b, count_if(failed)::BIGINT AS failed_pages_count FROM c GROUP BY doc, model),
q AS (SELECT r.doc, model, a, b, failed_pages_count FROM r JOIN h ON r.doc = h.doc), {_alphabets("q")},
m AS (SELECT *, {_encoded("a", "b", CHARS, "vc")} AS char_distance, {_encoded("a", "b", WORDS, "vw")} AS word_distance FROM y),
x AS (SELECT c.doc, c.model, count_if(p.page IS NULL)::BIGINT AS extra_pages_count, count_if(p.page IS NOT NULL)::BIGINT AS common FROM c LEFT JOIN p ON c.doc = p.doc AND c.page = p.page GROUP BY ALL),
n AS (SELECT doc, count(*) AS pages FROM p GROUP BY doc),
k AS (SELECT m.doc, m.model, {SQL_RATE.format("char_distance", "length(a)")} AS cer, {SQL_RATE.format("word_distance", n_words("a"))} AS wer,
             char_distance, word_distance, failed_pages_count, pages - common AS missing_pages_count, extra_pages_count
      FROM m JOIN x ON m.doc = x.doc AND m.model = x.model JOIN n ON m.doc = n.doc)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY cer, wer, model) AS rank, model, cer, wer, char_distance, word_distance,
       failed_pages_count, missing_pages_count, extra_pages_count FROM k
""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.leaderboard(*reference_and_candidates(benchmark_pages(spark, sf_dir))).drop("total_processing_seconds", "average_page_processing_seconds")


@query()
def leaderboard_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.leaderboard(*reference_and_candidates(conversation_pages(spark, sf_dir)))


@query(f"""
WITH {SQL_CONVERSATION_PAGES}, {SQL_CANDIDATES},
w AS (SELECT p.doc, m.model, p.page, p.t AS a FROM p JOIN (SELECT DISTINCT doc, model FROM c) m ON p.doc = m.doc),
j AS (SELECT w.*, coalesce(c.t, '') AS b, c.page IS NULL AS missing_page,
             CASE WHEN c.page IS NULL THEN 'missing' WHEN failed THEN 'error' WHEN c.t = '' THEN 'empty' ELSE 'ok' END AS status
      FROM w LEFT JOIN c ON w.doc = c.doc AND w.model = c.model AND w.page = c.page),
{_alphabets("j")}, d AS (SELECT *, {_encoded("a", "b", CHARS, "vc")} AS char_distance FROM y)
SELECT doc, model, page, status, missing_page, length(a) AS reference_char_count, length(b) AS hypothesis_char_count,
       {n_words("a")} AS reference_word_count, {n_words("b")} AS hypothesis_word_count, char_distance,
       {SQL_RATE.format("char_distance", "length(a)")} AS cer FROM d
""")
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.page_metrics(*reference_and_candidates(conversation_pages(spark, sf_dir)))
    return rows.select("doc", "model", "page", "status", "missing_page", "reference_char_count", "hypothesis_char_count", "reference_word_count", "hypothesis_word_count", "char_distance", "cer")


@query(f"""
WITH {SQL_CONVERSATION_PAGES}, {SQL_CANDIDATES},
r AS (SELECT doc, list(page) AS r FROM p GROUP BY doc), h AS (SELECT doc, model, list(page) AS h FROM c GROUP BY doc, model)
SELECT h.doc, model, array_to_string(list_sort(list_filter(r, lambda x: NOT list_contains(h, x))), ',') AS missing_pages,
       array_to_string(list_sort(list_filter(h, lambda x: NOT list_contains(r, x))), ',') AS extra_pages FROM h JOIN r ON h.doc = r.doc
""")
def missing_extra_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.page_sets(*reference_and_candidates(conversation_pages(spark, sf_dir)))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select("doc", "model", joined("missing_pages"), joined("extra_pages"))


@query(f"""
WITH x AS (SELECT a.item_id, a.text AS a, b.text AS b FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1), {_alphabets("x")}
SELECT item_id, {_encoded("a", "b", WORDS, "vw")} AS word_distance, {n_words("a")} AS words FROM y
""")
def word_distance_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select("item_id", distance.word_distance("text", "other").alias("word_distance"), text.count_words(F.col("text")).alias("words"))


# ---- text

SQL_LINES = "list_transform(string_split(nfc_normalize(coalesce(text, '')), chr(10)), lambda l: trim(regexp_replace(l, '[ \\t\\f\\v]+', ' ', 'g')))"
SQL_DISPLAY = f"trim(regexp_replace(array_to_string({SQL_LINES}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"
SQL_SCORING = "trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\\s+', ' ', 'g'))"
SQL_ALNUM = "len(regexp_extract_all({0}, '[A-Za-zÀ-ÖØ-öø-ÿ0-9]'))"
SQL_FULL_LINES = "len(list_filter(string_split({0}, chr(10)), lambda l: regexp_matches(l, '\\S')))"
SQL_SCORE = (
    f"CASE WHEN t = '' THEN 0.0::DOUBLE ELSE {SQL_ALNUM.format('t')} + len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) * 0.7::DOUBLE + {SQL_FULL_LINES.format('t')} * 0.3::DOUBLE"
    " + len(list_distinct(string_split(t, '')))::DOUBLE / length(t) * 8.0::DOUBLE END"
)
SQL_GENERIC = (
    "(t = '' OR " + " OR ".join(f"contains(regexp_replace(lower(t), '\\s+', ' ', 'g'), '{f}')" for f in text.GENERIC_FRAGMENTS) + f" OR ({SQL_ALNUM.format('t')} < 25 AND {SQL_FULL_LINES.format('t')} <= 1))"
)
SQL_TEXTS = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))


@query(f"SELECT doc_id, {SQL_DISPLAY} AS text FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", text.display_text(F.col("t")).alias("text"))


@query(f"SELECT doc_id, {SQL_SCORING} AS text FROM documents")
def normalize_scoring_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).withColumn("display", text.display_text(F.col("t")))
    return rows.select("doc_id", text.scoring_text(F.col("display"), F.col("t")).alias("text"))


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS words FROM documents")
def count_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", text.count_words(F.col("t")).cast("long").alias("words"))


SQL_REWRITES = "l"
for _pattern, _to in (
    ("^#{1,6}\\s+", ""), ("^[-*+]\\s+", ""), ("</?(?:p|br|div|tr|td|th|table|thead|tbody|ul|ol|li|h[1-6])[^>]*>", " "), ("<[^>]+>", ""),
    ("!\\[[^\\]]*\\]\\([^)]+\\)", ""), ("(?i)!\\S+\\.(?:png|jpe?g|gif|webp)\\b", ""), ("\\[(.*?)\\]\\((.*?)\\)", "\\1"), ("`([^`]*)`", "\\1"),
):
    SQL_REWRITES = f"regexp_replace({SQL_REWRITES}, '{_pattern}', '{_to}', 'g')"


@query(f"""
WITH l AS (SELECT page_id, unnest(string_split(trim(html, ' ' || chr(10) || chr(9)), chr(10))) AS raw, generate_subscripts(string_split(trim(html, ' ' || chr(10) || chr(9)), chr(10)), 1) AS i FROM pages),
s AS (SELECT page_id, i, trim(raw, ' ' || chr(9)) AS l FROM l),
w AS (SELECT page_id, i, l = '' AS blank, {SQL_REWRITES} AS r FROM s),
c AS (SELECT *, array_to_string(list_filter(list_transform(string_split(trim(r, '|'), '|'), lambda x: regexp_replace(trim(x), '\\s+', ' ', 'g')), lambda x: x <> '' AND NOT regexp_full_match(x, '[\\s:\\-]+')), ' ') AS cells FROM w),
t AS (SELECT page_id, i, blank, CASE WHEN NOT contains(r, '|') THEN r WHEN regexp_full_match(r, '\\|?[\\s:\\-]+\\|[\\s|:\\-]*') THEN NULL WHEN cells = '' THEN r ELSE cells END AS r FROM c),
f AS (SELECT page_id, i, blank, trim(replace(replace(r, '**', ''), '__', '')) AS r FROM t),
g AS (SELECT page_id, string_agg(CASE WHEN blank THEN '' ELSE r END, chr(10) ORDER BY i) AS text FROM f
      WHERE blank OR (r IS NOT NULL AND r <> '' AND NOT regexp_full_match(r, '\\[\\d+\\]') AND NOT regexp_full_match(r, '(?i)\\[(?:handwritten|illustration|image|photo|figure)[^\\]]*\\]')) GROUP BY page_id)
SELECT p.page_id, coalesce(g.text, '') AS text FROM pages p LEFT JOIN g ON p.page_id = g.page_id
""")
def cleanup_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id").select("page_id", text.cleanup_markup(F.col("html")).alias("text"))


@query(f"{SQL_TEXTS} SELECT doc_id, {SQL_SCORE} AS score FROM d")
def score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", text.score_text(F.col("t")).alias("score"))


@query(f"{SQL_TEXTS} SELECT doc_id, {SQL_GENERIC} AS generic, t <> '' AND NOT {SQL_GENERIC} AND {SQL_SCORE} >= 90 AS acceptable FROM d")
def generic_and_acceptable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", quality.judgement(F.col("t")).alias("j")).select("doc_id", "j.generic", "j.acceptable")


SQL_DEDUPED = """
l AS (SELECT {key}, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM {source}),
n AS (SELECT {key}, i, rtrim(raw) AS raw, regexp_replace(regexp_replace(lower(trim(raw)), '\\s+', ' ', 'g'), '[^a-zà-öø-ÿ0-9 ]+', '', 'g') AS norm FROM l),
k AS (SELECT {key}, i, raw, norm, lag(norm) OVER (PARTITION BY {key} ORDER BY i) AS before FROM n WHERE raw <> '' AND norm <> ''),
o AS (SELECT {key}, i, raw FROM k WHERE before IS NULL OR before <> norm UNION ALL SELECT {key}, i, '' FROM n WHERE raw = ''),
a AS (SELECT {key}, string_agg(raw, chr(10) ORDER BY i) AS text FROM o GROUP BY {key})"""


@query(f"""
WITH s AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {SQL_DEDUPED.format(key="doc_id", source="s")}
SELECT s.doc_id, coalesce({SQL_DISPLAY.replace("coalesce(text, '')", "coalesce(a.text, '')")}, '') AS text FROM s LEFT JOIN a ON s.doc_id = a.doc_id
""")
def dedupe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", text.dedupe_lines(F.col("t")).alias("text"))


def _sql_phrase(k: int) -> str:
    """Whether a phrase of k words stands four times in a row from word i on, in windows over the words of a text in order."""
    next_w, shape = f"lead(w, {k}) OVER o", "'[\\p{L}\\p{N}_-]{3,}'"
    edge = f"""regexp_full_match({next_w}, {shape}) AND suffix(w, {next_w})
      AND regexp_matches(left({next_w}, 1), '[\\p{{L}}\\p{{N}}_]') <> (length(w) > length({next_w}) AND regexp_matches(w[length(w) - length({next_w}):length(w) - length({next_w})], '[\\p{{L}}\\p{{N}}_]'))"""
    same = f"CASE WHEN w = {next_w} AND regexp_full_match(w, {shape}) THEN 1 ELSE 0 END"
    return f"""f{k} AS (SELECT doc_id, i, {edge} AS opens, {same} AS same, prefix({next_w}, w) AND regexp_full_match(w, {shape}) AS ends,
      regexp_matches(left(w, 1), '[\\p{{L}}\\p{{N}}_]')::INT AS letter FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    p{k} AS (SELECT doc_id, opens AND sum(same) OVER (o ROWS BETWEEN 1 FOLLOWING AND {3 * k - 2} FOLLOWING) = {3 * k - 2}
      AND {f"sum(letter) OVER (o ROWS BETWEEN 1 FOLLOWING AND {k - 1} FOLLOWING) = {k - 1}" if k > 1 else "true"} AND lead(ends, {3 * k - 1}) OVER o AS found
      FROM f{k} WINDOW o AS (PARTITION BY doc_id ORDER BY i))"""


def sql_runaway(source: str) -> str:
    """CTEs up to runaway (doc_id, runaway) of source (doc_id, norm): phrases four times in a row, tokens six times, few distinct among many."""
    return f"""
    t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(norm, ' ') AS w FROM {source})),
    {", ".join(_sql_phrase(k) for k in range(1, 5))},
    found AS (SELECT doc_id, bool_or(found) AS found FROM ({" UNION ALL ".join(f"SELECT doc_id, found FROM p{k}" for k in range(1, 5))}) GROUP BY doc_id),
    e AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(norm, '[a-zà-öø-ÿ0-9]+') AS w FROM {source})),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS run FROM e),
    r AS (SELECT doc_id, w, run, count(*) AS n FROM g GROUP BY ALL),
    m AS (SELECT doc_id, max(n) AS longest, sum(n) AS tokens, count(DISTINCT w) AS kinds FROM r GROUP BY doc_id),
    runaway AS (SELECT s.doc_id, coalesce(found, false) OR coalesce(longest >= 6 OR (tokens > 600 AND kinds::DOUBLE / tokens < 0.22), false) AS runaway
      FROM {source} s LEFT JOIN found ON s.doc_id = found.doc_id LEFT JOIN m ON s.doc_id = m.doc_id)"""


@query(f"WITH x AS (SELECT doc_id, lower({SQL_SCORING}) AS norm FROM documents), {sql_runaway('x')} SELECT doc_id, runaway FROM runaway")
def runaway_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_runaway_repetition(texts(spark, sf_dir), "t").select("doc_id", "runaway")


@query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower({SQL_SCORING}), '[a-zà-öø-ÿ0-9]+') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS run FROM e),
r AS (SELECT doc_id, t, run, count(*) AS n FROM g GROUP BY ALL), m AS (SELECT doc_id, max(n) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(m.n, 0) AS longest_run, len(w) AS tokens, len(list_distinct(w)) AS distinct_tokens FROM d LEFT JOIN m ON d.doc_id = m.doc_id
""")
def token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).withColumn("s", text.scoring_text(text.display_text(F.col("t")), F.col("t")))
    rows = rows.withColumn("w", F.regexp_extract_all(F.lower("s"), F.lit("[a-zà-öø-ÿ0-9]+"), F.lit(0)))
    return rows.select("doc_id", quality.longest_run(F.col("w")).cast("long").alias("longest_run"), F.size("w").alias("tokens"), F.size(F.array_distinct("w")).alias("distinct_tokens"))


# ---- documents and timing

@query(f"""
WITH {SQL_CONVERSATION_PAGES}
SELECT doc, count(*) AS timed_pages_count, count_if(t <> '')::BIGINT AS successful_pages_count, max(page) AS page_count,
       length(string_agg(t, chr(10) ORDER BY page)) AS scored_char_count, sum({n_words("t")})::BIGINT AS total_word_count, string_agg(t, chr(10) ORDER BY page) AS text_for_cer_wer
FROM p GROUP BY doc
""")
def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = standardize.standardize_pages(conversation_pages(spark, sf_dir).withColumn("page", F.col("page").cast("string")))
    rows = standardize.build_documents(pages, ("doc",))
    return rows.select("doc", "timed_pages_count", "successful_pages_count", "page_count", F.length("text_for_cer_wer").alias("scored_char_count"), F.col("total_word_count").cast("long").alias("total_word_count"), "text_for_cer_wer")


@query("SELECT event_type AS model, count(*) AS pages, sum(value::DECIMAL(18, 3))::DOUBLE AS total_seconds, sum(value::DECIMAL(18, 3))::DOUBLE / count(*) AS average_seconds FROM events GROUP BY event_type")
def latency_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.col("value").cast("decimal(18,3)")).cast("double")
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("pages"), total.alias("total_seconds"))
    return rows.withColumn("average_seconds", F.col("total_seconds") / F.col("pages"))


# ---- attempts at whole texts: letters confused, every fourth word lost, the text itself; some fail, by the text's length

#: Size of the page that a text is taken to fill, in pixels; lines of a band, which begins with the last line of the one before.
PAGE_WIDTH, PAGE_HEIGHT = 1654, 2339
BAND_LINES = 8

SQL_FEWER_WORDS = "array_to_string(list_filter(string_split(s, ' '), lambda w, i: (i - 1) % 4 <> 3), ' ')"
SQL_ATTEMPTS = f"""
d AS (SELECT doc_id, coalesce(text, '') AS s, length(coalesce(text, '')) AS n FROM documents),
u AS (SELECT doc_id, 0 AS idx, 'pagina_inteira' AS mode, CASE WHEN n % 3 = 0 THEN '' ELSE translate(s, 'elo', 'c10') END AS t, n % 11 = 1 AS suspicious, n % 3 = 0 AS fails FROM d
      UNION ALL SELECT doc_id, 1, 'pagina_inteira_pre', CASE WHEN n % 7 = 0 THEN '' ELSE {SQL_FEWER_WORDS} END, n % 5 = 2, n % 7 = 0 FROM d
      UNION ALL SELECT doc_id, 2, 'faixas', CASE WHEN n % 7 < 2 THEN '' ELSE s END, n % 13 = 4, n % 7 < 2 FROM d),
a AS (SELECT *, {SQL_SCORE} AS score FROM u),
w AS (SELECT doc_id, string_agg(mode, ',' ORDER BY idx) AS warnings, coalesce(string_agg(mode || ': engine failed', ' | ' ORDER BY idx) FILTER (fails), '') AS errors FROM u GROUP BY doc_id)"""


def fewer_words(s: Column) -> Column:
    return F.array_join(F.filter(F.split(s, " ", -1), lambda _, i: i % 4 != 3), " ")


def row_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, attempts: a text's attempts in order, in one row."""
    n, s = F.length("t"), F.col("t")
    one = lambda idx, mode, t, fails, suspicious: F.struct(F.lit(idx).alias("idx"), F.lit(mode).alias("mode"), F.when(fails, "").otherwise(t).alias("text"), suspicious.alias("suspicious"), F.array(F.lit(mode)).alias("warnings"), F.when(fails, F.lit("engine failed")).alias("error"))
    rows = F.array(
        one(0, "pagina_inteira", F.translate(s, "elo", "c10"), n % 3 == 0, n % 11 == 1),
        one(1, "pagina_inteira_pre", fewer_words(s), n % 7 == 0, n % 5 == 2),
        one(2, "faixas", s, n % 7 < 2, n % 13 == 4),
    )
    return texts(spark, sf_dir).select("doc_id", rows.alias("attempts"))


def raw_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = row_attempts(spark, sf_dir).select("doc_id", F.explode("attempts").alias("a")).select("doc_id", "a.*")
    return made.withColumns({"width": F.lit(PAGE_WIDTH), "height": F.lit(PAGE_HEIGHT)})


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_attempts(spark, sf_dir).withColumn("score", text.score_text(F.col("text")))


SQL_BEST = """
SELECT b.doc_id, mode, t AS text, score, warnings, CASE WHEN t = '' THEN errors END AS error
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {0}) AS n FROM a) b JOIN w ON b.doc_id = w.doc_id WHERE n = 1"""


def _best(attempts: DataFrame, tiered: bool) -> DataFrame:
    return select.best_attempt(attempts, ("doc_id",), tiered=tiered).select("doc_id", "mode", "text", "score", F.array_join("warnings", ",").alias("warnings"), "error")


@query(f"WITH {SQL_ATTEMPTS} " + SQL_BEST.format("t <> '' DESC, CASE WHEN t <> '' THEN score END DESC, CASE WHEN t <> '' THEN idx ELSE -idx END"))
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(attempts(spark, sf_dir), False)


@query(f"WITH {SQL_ATTEMPTS} " + SQL_BEST.format("t <> '' AND NOT suspicious DESC, t <> '' DESC, CASE WHEN t <> '' THEN score END DESC, CASE WHEN t <> '' THEN idx ELSE -idx END"))
def best_attempt_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen inside the row that holds a text's attempts."""
    scored = F.transform("attempts", lambda a: a.withField("score", text.score_text(a["text"])))
    best = row_attempts(spark, sf_dir).withColumn("attempts", scored).select("doc_id", select.best_of(F.col("attempts"), tiered=True).alias("best")).select("doc_id", "best.*")
    return best.select("doc_id", "mode", "text", "score", F.array_join("warnings", ",").alias("warnings"), "error")


@query(f"""
WITH {SQL_ATTEMPTS.replace("a AS (", "scored AS (")}, x AS (SELECT doc_id * 3 + idx AS doc_id, s, lower(s) AS norm FROM (SELECT doc_id, idx, {SQL_SCORING.replace("coalesce(text, '')", "t")} AS s FROM u)),
{sql_runaway("x")},
j AS (SELECT x.doc_id AS id, s <> '' AND (length(s) > greatest(2500, least(14000, floor({PAGE_WIDTH} * {PAGE_HEIGHT} / 420)::INT)) OR runaway) AS suspected FROM x JOIN runaway ON x.doc_id = runaway.doc_id),
a AS (SELECT scored.* REPLACE (suspected AS suspicious, CASE WHEN suspected THEN 0.0::DOUBLE ELSE score END AS score) FROM scored JOIN j ON doc_id * 3 + idx = id)
""" + SQL_BEST.format("t <> '' AND NOT suspicious DESC, t <> '' DESC, CASE WHEN t <> '' THEN score END DESC, CASE WHEN t <> '' THEN idx ELSE -idx END"))
def best_attempt_suspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with suspicion from the texts themselves."""
    return _best(select.judged(raw_attempts(spark, sf_dir), suspicion=True), True)


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS s, length(coalesce(text, '')) AS n FROM documents),
u AS (SELECT doc_id, 0 AS idx, CASE WHEN n % 2 = 0 THEN '' ELSE translate(s, 'elo', 'c10') END AS t FROM d UNION ALL SELECT doc_id, 1, CASE WHEN n % 3 = 0 THEN '' ELSE {SQL_FEWER_WORDS} END FROM d
      UNION ALL SELECT doc_id, 2, CASE WHEN n % 5 = 0 THEN '' ELSE translate(s, 'aiu', '4 v') END FROM d UNION ALL SELECT doc_id, 3, CASE WHEN n % 7 = 0 THEN '' ELSE s END FROM d),
a AS (SELECT *, {SQL_SCORE} AS score, t <> '' AND NOT {SQL_GENERIC} AND {SQL_SCORE} >= 90 AS good FROM u),
b AS (SELECT doc_id, min(idx) FILTER (good) AS stop FROM a GROUP BY doc_id),
k AS (SELECT a.* FROM a JOIN b ON a.doc_id = b.doc_id WHERE stop IS NULL OR idx <= stop)
SELECT doc_id, idx, t AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t <> '' DESC, CASE WHEN t <> '' THEN score END DESC, CASE WHEN t <> '' THEN idx ELSE -idx END) AS n FROM k) WHERE n = 1
""")
def cascade_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.length("t"), F.col("t")

    def stage(out: int, said: Column):
        fails = n % out == 0
        return lambda df: df.withColumns({"text": F.when(fails, "").otherwise(said), "error": F.when(fails, F.lit("engine failed")), "warnings": F.array().cast("array<string>")})

    stages = list(zip(standardize.PIPELINE, (stage(2, F.translate(s, "elo", "c10")), stage(3, fewer_words(s)), stage(5, F.translate(s, "aiu", "4 v")), stage(7, s))))
    return select.cascade(texts(spark, sf_dir), stages, sinks.written, ("doc_id",)).select("doc_id", "idx", "text")


def whole_bands(s: Column) -> Column:
    """band, text of overlapping bands that cover the lines of a text to its end."""

    def cut(rows: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(rows) - 2), F.lit(BAND_LINES - 1))
        return F.transform(starts, lambda at: F.struct(at.alias("band"), F.array_join(F.slice(rows, at + 1, F.lit(BAND_LINES)), "\n").alias("text")))

    return text.let(text.lines(s), cut)


@query(f"""
WITH s AS (SELECT doc_id, text AS t FROM documents WHERE text <> ''), {SQL_DEDUPED.format(key="doc_id", source="s")}
SELECT s.doc_id, coalesce({SQL_DISPLAY.replace("coalesce(text, '')", "coalesce(a.text, '')")}, '') AS text FROM s LEFT JOIN a ON s.doc_id = a.doc_id
""")
def merge_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping bands of each text to its end, joined and without repeated lines: what dedupe_lines makes of the text."""
    bands = texts(spark, sf_dir).select("doc_id", F.explode(whole_bands(F.col("t"))).alias("b")).select("doc_id", "b.*")
    return select.merge_bands(bands, ("doc_id",))


@query(f"""
WITH t AS (SELECT conv_id AS doc, turn + 1 AS page, coalesce(text, '') AS t, role FROM conversations),
g AS (SELECT doc, page, t FROM t WHERE role <> 'assistant' AND trim(t) <> '' AND NOT {SQL_GENERIC})
SELECT t.doc, t.page, g.t IS NOT NULL AS reused, g.t AS text FROM t LEFT JOIN g ON t.doc = g.doc AND t.page = g.page
""")
def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir)
    cached = pages.join(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), "role"), ["doc", "ord"])
    cached = cached.withColumn("error", F.when(F.col("role") == "assistant", F.lit("engine failed"))).withColumn("page", F.col("page").cast("string"))
    return documents.resume_plan(pages.select("doc", "page"), cached)


# ---- layout and geometry

SQL_PAGE_TEXT = SQL_DEDUPED.format(key="page", source="s") + f"""
SELECT s.page, coalesce({SQL_DISPLAY.replace("coalesce(text, '')", "coalesce(a.text, '')")}, '') AS text FROM s LEFT JOIN a ON s.page = a.page"""
SQL_PARAGRAPHS = """
b AS (SELECT *, lag({section}) OVER o AS section_before, lag(bottom) OVER o AS bottom_before, lag(height) OVER o AS height_before FROM rows_ WINDOW o AS (PARTITION BY page ORDER BY line)),
s AS (SELECT page, string_agg(CASE WHEN section_before <> {section} OR top - bottom_before > greatest(18.0, height_before * 1.4, height * 1.2) THEN chr(10) ELSE '' END || t, chr(10) ORDER BY line) AS t FROM b GROUP BY page)"""


@query(f"""
WITH RECURSIVE x AS (SELECT l_orderkey AS page, l_linenumber AS idx, 'w' || l_partkey AS text, l_suppkey * 3.0::DOUBLE AS left_, l_partkey % 40 * 9.0::DOUBLE AS top, l_partkey % 40 * 9.0::DOUBLE + 10 + l_quantity::DOUBLE % 8 AS bottom FROM lineitem),
i AS MATERIALIZED (SELECT *, (top + bottom) / 2 AS middle, greatest(1.0::DOUBLE, bottom - top) AS height, row_number() OVER (PARTITION BY page ORDER BY top, left_, idx, text, bottom) AS n FROM x),
w AS (SELECT page, n, 1 AS line, middle AS middles, height AS heights, 1 AS boxes FROM i WHERE n = 1
      UNION ALL SELECT page, n, CASE WHEN near THEN line ELSE line + 1 END, CASE WHEN near THEN middles + middle ELSE middle END, CASE WHEN near THEN heights + height ELSE height END, CASE WHEN near THEN boxes + 1 ELSE 1 END
      FROM (SELECT i.page, i.n, line, middles, heights, boxes, middle, height, abs(middle - middles / boxes) <= greatest(12.0, least(heights / boxes, height) * 0.65) AS near FROM w JOIN i ON i.page = w.page AND i.n = w.n + 1)),
rows_ AS (SELECT w.page, line, string_agg(text, ' ' ORDER BY left_, top, idx) AS t, min(top) AS top, max(bottom) AS bottom, avg(height) AS height, 0 AS section FROM w JOIN i ON i.page = w.page AND i.n = w.n GROUP BY w.page, line),
{SQL_PARAGRAPHS.format(section="section")}, {SQL_PAGE_TEXT}
""")
def reading_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page are the lines of an order, laid out by their numbers."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    top = F.pmod(F.col("l_partkey"), F.lit(40)) * 9.0
    boxes = l.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_suppkey") * 3.0).alias("left"), top.alias("top"), (top + 10.0 + F.pmod(F.col("l_quantity"), F.lit(8))).alias("bottom"))
    return layout.boxes_to_text(boxes, tasks=tasks_for(l))


@query("""
WITH w AS (SELECT l_orderkey AS page, l_linenumber AS idx, 'w' || l_partkey AS text, l_partkey % 3 AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'w' || l_partkey) AS n FROM lineitem),
b AS (SELECT *, CASE WHEN lag(block) OVER (PARTITION BY page ORDER BY n) = block THEN 0 ELSE 1 END AS starts FROM w),
k AS (SELECT *, sum(starts) OVER (PARTITION BY page ORDER BY n) AS line FROM b),
l AS (SELECT page, line, string_agg(text, ' ' ORDER BY n) AS t FROM k GROUP BY page, line),
d AS (SELECT *, lag(t) OVER (PARTITION BY page ORDER BY line) AS before FROM l)
SELECT page, string_agg(t, chr(10) || chr(10) ORDER BY line) AS text FROM d WHERE before IS NULL OR before <> t GROUP BY page
""")
def keyed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page are the lines of an order; a new part class begins a new block."""
    block = F.col("l_partkey") % 3
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    words = dealt(l, "l_orderkey", tasks_for(l)).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), F.lit(0).alias("top"), F.lit(10).alias("height"), block.alias("block_num"), F.lit(1).alias("par_num"), F.lit(1).alias("line_num"))
    return layout.keyed_words_to_text(words)


@query(f"""
WITH w AS (SELECT l_orderkey AS page, 'w' || l_partkey AS text, l_suppkey * 3.0::DOUBLE AS top, greatest(1, l_quantity::INT - 4)::DOUBLE AS height, l_partkey % 3 AS block, l_suppkey % 2 AS par,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'w' || l_partkey, l_suppkey, greatest(1, l_quantity::INT - 4)) AS n FROM lineitem),
c AS (SELECT *, CASE WHEN lag(block) OVER o = block AND lag(par) OVER o = par THEN 0 ELSE 1 END AS starts FROM w WINDOW o AS (PARTITION BY page ORDER BY n)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY page ORDER BY n) AS line FROM c),
rows_ AS (SELECT page, line, string_agg(text, ' ' ORDER BY n) AS t, min(top) AS top, max(top + height) AS bottom, list_reduce(list(height ORDER BY n), lambda m, h: (m + h) / 2.0::DOUBLE) AS height, any_value(block * 2 + par) AS section FROM g GROUP BY page, line),
{SQL_PARAGRAPHS.format(section="section")}, {SQL_PAGE_TEXT}
""")
def keyed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page are the lines of an order, of different heights: blocks and paragraphs change, and gaps are wide or not."""
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    words = dealt(l, "l_orderkey", tasks_for(l)).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), F.concat(F.lit("w"), part.cast("string")).alias("text"), (supplier * 3).alias("top"), (F.col("l_quantity").cast("int") - 4).alias("height"), (part % 3).alias("block_num"), (supplier % 2).alias("par_num"), F.lit(1).alias("line_num"))
    return layout.keyed_words_to_text(words)


SQL_SIZES = "p AS (SELECT p_partkey AS id, (p_size * 53 + 200)::INT AS w, ((p_partkey % 50) * 71 + 150)::INT AS h FROM part)"


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("p_size") * 53 + 200).cast("int"), (F.col("p_partkey") % 50 * 71 + 150).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), w.alias("w"), h.alias("h"))


@query(f"""
WITH {SQL_SIZES},
m AS (SELECT id, h, unnest([1200, 900]) AS cap FROM p),
n AS (SELECT *, greatest(2, ceil(h::DOUBLE / cap)::INT) AS n FROM m), s AS (SELECT *, ceil(h::DOUBLE / n)::INT AS step FROM n),
o AS (SELECT *, least(96, greatest(24, step // 12)) AS overlap FROM s),
b AS (SELECT id, h, cap, n, step, overlap, unnest(range(0, n)) AS i FROM o WHERE h > cap)
SELECT id, cap, i, CASE WHEN i = 0 THEN 0 ELSE greatest(0, i * step - overlap) END AS top, CASE WHEN i = n - 1 THEN h ELSE least(h, (i + 1) * step + overlap) END AS bottom FROM b
UNION ALL SELECT id, cap, 0, 0, h FROM m WHERE h <= cap
""")
def band_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = image_sizes(spark, sf_dir).withColumn("cap", F.explode(F.array(*[F.lit(x) for x in geometry.BAND_HEIGHTS])))
    rows = rows.select("id", "cap", F.posexplode(geometry.bands(F.col("h"), F.col("cap"))).alias("i", "b"))
    return rows.select("id", "cap", F.col("i").cast("long").alias("i"), F.col("b.top").cast("long").alias("top"), F.col("b.bottom").cast("long").alias("bottom"))


@query(f"""
WITH {SQL_SIZES}, x AS (SELECT *, greatest(w, h) AS longest FROM p),
d AS (SELECT id, w, h, longest, CASE WHEN longest <= 1600 THEN [longest, 1600, 1200] ELSE [1600, 1200] END AS dims FROM x),
e AS (SELECT id, w, h, longest, unnest(dims) AS dim, generate_subscripts(dims, 1) AS i FROM d),
s AS (SELECT id, i, CASE WHEN longest <= dim THEN w ELSE greatest(1, floor(w * (dim::DOUBLE / longest))::INT) END AS width, CASE WHEN longest <= dim THEN h ELSE greatest(1, floor(h * (dim::DOUBLE / longest))::INT) END AS height FROM e),
u AS (SELECT id, width, height, min(i) AS i FROM s GROUP BY ALL)
SELECT p.id, (SELECT string_agg(u.width || 'x' || u.height, ' ' ORDER BY u.i) FROM u WHERE u.id = p.id) AS sizes,
       greatest(2500, least(14000, floor(p.w * p.h / 420)::INT)) AS max_chars,
       CASE WHEN p.h >= 1800 THEN array_to_string(list_filter([ceil(p.h / 2.0)::INT, 1200, 900], lambda x, i: i = 1 OR x <> ceil(p.h / 2.0)::INT), ' ') ELSE '1200 900' END AS heights
FROM p
""")
def candidate_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform(geometry.candidate_sizes(F.col("w"), F.col("h")), lambda s: F.concat_ws("x", s["width"].cast("string"), s["height"].cast("string")))
    heights = F.transform(geometry.band_heights(F.col("h")), lambda h: h.cast("string"))
    return image_sizes(spark, sf_dir).select("id", F.array_join(sizes, " ").alias("sizes"), geometry.max_reasonable_chars(F.col("w"), F.col("h")).alias("max_chars"), F.array_join(heights, " ").alias("heights"))


@query("""
WITH s AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, (p_partkey % 90)::DOUBLE AS b FROM part)
SELECT id, CASE WHEN (b > a * 1.2::DOUBLE AND b - a > 25) OR (a < 15 AND b > 45) THEN 180 ELSE 0 END AS rotation FROM s
""")
def rotation_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, inverted = F.col("p_size").cast("double"), (F.col("p_partkey") % 90).cast("double")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), geometry.rotation(normal, inverted).alias("rotation"))


# ---- names, metadata, charts, report

SQL_SAFE = "CASE WHEN {0} = '' THEN 'arquivo' ELSE {0} END"


def _sql_safe(c: str) -> str:
    return SQL_SAFE.format(f"regexp_replace(regexp_replace(trim({c}), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')")


@query(f"SELECT c_custkey AS id, 'out/data/extracted/' || {_sql_safe('c_mktsegment')} || '_output_' || {_sql_safe('c_name')} || '.json' AS path FROM customer")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), names.output_path("out", F.col("c_mktsegment"), F.concat("c_name", F.lit(".pdf"))).alias("path"))


@query("""
WITH m AS (SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'first:v1' WHEN 1 THEN 'second-' || n_nationkey WHEN 2 THEN 'third:fast' ELSE n_name END AS model FROM nation)
SELECT id, model, CASE WHEN model = 'first:v1' THEN 'First (v1)' WHEN model = 'third:fast' THEN 'Third, fast' WHEN model LIKE 'second-%' THEN 'Second' ELSE model END AS label FROM m
""")
def label_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    model = F.when(n % 4 == 0, "first:v1").when(n % 4 == 1, F.concat(F.lit("second-"), n.cast("string"))).when(n % 4 == 2, "third:fast").otherwise(F.col("n_name"))
    rows = table(spark, sf_dir, "nation").select(n.alias("id"), model.alias("model"))
    return rows.withColumn("label", names.label(F.col("model"), {"first:v1": "First (v1)", "third:fast": "Third, fast"}, {"second-": "Second"}))


@query("SELECT event_id, event_type || '/' || CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE json_extract_string(props, '$.k') END AS merged FROM events")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's own keys win over its meta, which wins over its metadata."""
    base = F.from_json("props", "map<string,string>")
    extra = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.col("user_id").cast("string")))
    folded = standardize.later_wins(base, F.create_map(F.lit("type"), F.col("event_type")), extra)
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", folded["type"], folded["k"]).alias("merged"))


@query(f"""
WITH {SQL_BENCHMARK_PAGES}, {SQL_CANDIDATES},
w AS (SELECT p.doc, m.model, p.page, p.t AS a FROM p JOIN (SELECT DISTINCT doc, model FROM c) m ON p.doc = m.doc),
j AS (SELECT w.*, coalesce(c.t, '') AS b FROM w LEFT JOIN c ON w.doc = c.doc AND w.model = c.model AND w.page = c.page),
{_alphabets("j")}, d AS (SELECT *, {_encoded("a", "b", CHARS, "vc")} AS dist FROM y), r AS (SELECT *, {SQL_RATE.format("dist", "length(a)")} AS cer FROM d)
SELECT doc, model, row_number() OVER (PARTITION BY doc, model ORDER BY page) AS position, least(cer, 1.0::DOUBLE) AS cell FROM r
""")
def cer_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, made = reference_and_candidates(benchmark_pages(spark, sf_dir))
    cells = charts.heat_cells(evaluate.leaderboard(reference, made), evaluate.page_metrics(reference, made))
    return cells.select("doc", "model", F.col("position").cast("long").alias("position"), "cell")


@query()
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report(*reference_and_candidates(benchmark_pages(spark, sf_dir))).select("doc", F.to_json(F.struct("reference", "ranking", "models")).alias("report"))


@query()
def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.console_lines(evaluate.leaderboard(*reference_and_candidates(benchmark_pages(spark, sf_dir))))
