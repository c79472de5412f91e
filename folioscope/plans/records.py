"""Registered queries of scans, coercion, settings, geometry and roll-ups, with the SQL that states their results.

The tables hold no extraction results, so answers and raw records are made from their rows by rules that give every kind of
odd value: numbers that are none, blank and missing fields, repeated pages, both JSON shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import geometry, names, text
from folioscope.operators import evaluate, layout, quality, select, standardize
from folioscope.plans import charts
from folioscope.plans.queries import SQL, SQL_BENCHMARK_PAGES, SQL_CANDIDATES, SQL_DISPLAY, SQL_RATE, SQL_SCORE, SQL_SCORING, _alphabets, _encoded, benchmark_pages, conversation_pages, dealt, n_words, query, reference_and_candidates, sql_runaway, table, tasks_for
from folioscope.plans.queries import CHARS as SQL_CHARS
from folioscope.plans.queries import WORDS as SQL_WORDS
from folioscope.sources import boundary, documents, engines, sinks

# ---- raw records


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE (event_id % 900)::INT END AS page,
       CASE event_id % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 WHEN 3 THEN 'Infinity'::DOUBLE ELSE value END AS processing_seconds,
       CASE WHEN event_id % 3 = 0 THEN 180 ELSE 0 END AS rotation_applied_degrees,
       CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN 'full' ELSE NULL END AS extraction_mode,
       CASE WHEN event_id % 6 = 0 THEN event_type END AS error,
       CASE WHEN event_id % 6 = 0 THEN 'error' WHEN event_id % 4 = 3 THEN 'empty' ELSE 'ok' END AS status,
       CASE WHEN event_id % 2 = 0 THEN event_type || ',None' ELSE '' END AS warnings
FROM events
""")
def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd values of every raw field to the defaults of a standard page."""
    n, kind = F.col("event_id"), F.col("event_type")
    blank = F.lit(None).cast("string")
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(n % 5 == 0, "x").when(n % 5 == 1, blank).when(n % 5 == 2, "3.7").otherwise((n % 900).cast("string")).alias("page"),
        F.when(n % 7 == 0, "abc").when(n % 7 == 1, "-4").when(n % 7 == 2, "NaN").when(n % 7 == 3, "Infinity").otherwise(F.col("value").cast("string")).alias("processing_seconds"),
        F.when(n % 3 == 0, "180").when(n % 3 == 1, "side").alias("rotation_applied_degrees"),
        F.when(n % 4 == 0, kind).when(n % 4 == 2, " ").otherwise("").alias("extraction_mode"),
        F.when(n % 4 == 1, " full ").otherwise("").alias("ocr_method"),
        F.when(n % 6 == 0, F.concat(F.lit("\t"), kind, F.lit(" "))).when(n % 6 == 1, "  ").alias("error"),
        F.when(n % 4 == 3, " ​\n").otherwise(kind).alias("text"),
        F.when(n % 2 == 0, F.array(F.concat(F.lit(" "), kind), F.lit(" "), F.lit(""), blank)).alias("warnings"),
    )
    rows = standardize.standardize_pages(raw)
    return rows.select("event_id", "page", "processing_seconds", "rotation_applied_degrees", "extraction_mode", "error", "status", F.array_join("warnings", ",").alias("warnings"))


@query("""
SELECT event_id, event_type AS kept, user_id::VARCHAR AS shared, CASE WHEN event_id % 2 = 0 THEN event_type ELSE NULL END AS own, event_id::VARCHAR AS added FROM events
""")
def nested_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner maps of both sides are merged, later values win."""
    one = lambda key, value: F.create_map(F.lit(key), value.cast("string"))
    base = F.create_map(F.lit("a"), F.map_concat(one("kept", F.col("event_type")), one("shared", F.lit("old"))))
    base = F.when(F.col("event_id") % 2 == 0, F.map_concat(base, F.create_map(F.lit("b"), one("own", F.col("event_type"))))).otherwise(base)
    extra = F.create_map(F.lit("a"), one("shared", F.col("user_id")), F.lit("c"), one("added", F.col("event_id")))
    m = standardize.merge_nested(base, extra)
    get = lambda outer, inner: F.try_element_at(F.try_element_at(m, F.lit(outer)), F.lit(inner)).alias(inner)
    return table(spark, sf_dir, "events").select("event_id", get("a", "kept"), get("a", "shared"), get("b", "own"), get("c", "added"))


SQL_TURNS = "t AS (SELECT conv_id AS doc, turn + 1 AS page, turn, text, length(text) * 7 % 25 AS k FROM conversations)"


def timed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard pages of conversations, with seconds of 0.04 each step."""
    raw = conversation_pages(spark, sf_dir).withColumn("processing_seconds", (F.length("text") * 7 % 25 * 4 / 100.0).cast("string"))
    return standardize.standardize_pages(raw.withColumn("page", F.col("page").cast("string")))


@query(f"""
WITH {SQL_TURNS}, p AS (SELECT doc, page, k, {SQL_DISPLAY} AS s FROM t),
d AS (SELECT doc, string_agg(s, chr(10) || chr(10) ORDER BY page) FILTER (s <> '') AS text, sum(k)::BIGINT AS k, count(*) AS n FROM p GROUP BY doc)
SELECT doc, coalesce(text, '') AS text, length(coalesce(text, '')) AS total_char_count, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::BIGINT AS total_word_count,
       (k * 40)::DOUBLE / 1000.0::DOUBLE AS total_processing_seconds, round((k * 40)::DOUBLE / n) / 1000.0::DOUBLE AS average_page_processing_seconds, n AS timed_pages_count FROM d
""")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts joined by blank lines, totals and means of time, counts of a document."""
    rows = standardize.build_documents(timed_pages(spark, sf_dir), ("doc",))
    return rows.select("doc", "text", "total_char_count", F.col("total_word_count").cast("long").alias("total_word_count"), "total_processing_seconds", "average_page_processing_seconds", "timed_pages_count")


@query(f"WITH {SQL_TURNS} SELECT doc, page, length(left({SQL_DISPLAY}, 120)) AS shown, left({SQL_DISPLAY}, 120) AS reference_excerpt, length(regexp_replace({SQL_DISPLAY}, '\\s+', ' ', 'g')) AS reference_char_count, 0.0::DOUBLE AS cer, 0.0::DOUBLE AS wer FROM t")
def last_duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate that gives each page twice, first wrong: the last one is rated."""
    pages = conversation_pages(spark, sf_dir).withColumn("page", F.col("page").cast("string"))
    wrong = pages.withColumns({"text": F.upper("text"), "model": F.lit("m")})
    right = pages.withColumns({"ord": F.col("ord") + 1000, "model": F.lit("m")})
    rows = evaluate.page_metrics(standardize.standardize_pages(pages), standardize.standardize_pages(wrong.unionByName(right)))
    return rows.select("doc", "page", F.length("hypothesis_excerpt").alias("shown"), "reference_excerpt", "reference_char_count", "cer", "wer")


@query(f"""
WITH {SQL_BENCHMARK_PAGES}, {SQL_CANDIDATES},
w AS (SELECT p.doc, m.model, p.page, p.t AS a FROM p JOIN (SELECT DISTINCT doc, model FROM c) m ON p.doc = m.doc),
j AS (SELECT w.*, coalesce(c.t, '') AS b, coalesce(failed, false) AS failed FROM w LEFT JOIN c ON w.doc = c.doc AND w.model = c.model AND w.page = c.page),
{_alphabets("j")}, d AS (SELECT *, {_encoded("a", "b", SQL_WORDS, "vw")} AS word_distance, {_encoded("a", "b", SQL_CHARS, "vc")} AS char_distance FROM y)
SELECT doc, model, page, char_distance, word_distance, {SQL_RATE.format("char_distance", "length(a)")} AS cer, {SQL_RATE.format("word_distance", n_words("a"))} AS wer,
       CASE WHEN failed THEN 'engine failed' END AS error, left(a, 120) AS reference_excerpt, left(b, 120) AS hypothesis_excerpt FROM d
""")
def sentence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of characters and words, excerpts and errors of each page."""
    rows = evaluate.page_metrics(*reference_and_candidates(benchmark_pages(spark, sf_dir)))
    return rows.select("doc", "model", "page", "char_distance", "word_distance", "cer", "wer", "error", "reference_excerpt", "hypothesis_excerpt")


# ---- scans


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, json of conversations as result files: objects, or bare lists for every third; members that are no objects; declared counts."""
    rows = table(spark, sf_dir, "conversations")
    page = F.struct((F.col("turn") + 1).cast("int").alias("page"), "text", F.col("role").alias("speaker"))
    docs = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))), lambda x: F.to_json(x["p"])).alias("pages"))
    listed = F.concat(F.lit('["skipped",'), F.array_join("pages", ","), F.lit("]"))
    n = F.col("conv_id")
    declared = F.when(n % 3 == 1, F.lit('"page_count":99,')).otherwise("")
    whole = F.concat(F.lit('{"model":"m'), (n % 2).cast("string"), F.lit('","source_pdf":"'), n.cast("string"), F.lit('.pdf",'), declared, F.lit('"run_elapsed_seconds":1.5,"pages":'), listed, F.lit("}"))
    return docs.select(F.concat(F.lit("/r/folder/"), n.cast("string"), F.lit(".json")).alias("path"), F.when(n % 3 == 0, listed).otherwise(whole).alias("json"))


@query("""
SELECT '/r/folder/' || conv_id || '.json' AS path, CASE WHEN conv_id % 3 = 0 THEN 'folder' ELSE 'm' || conv_id % 2 END AS model,
       CASE WHEN conv_id % 3 <> 0 THEN conv_id || '.pdf' END AS source_pdf, CASE WHEN conv_id % 3 = 1 THEN 99 ELSE max(turn) + 1 END AS page_count,
       CASE WHEN conv_id % 3 = 0 THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END AS run_elapsed_seconds
FROM conversations GROUP BY conv_id
""")
def loaded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.load_documents(result_files(spark, sf_dir))[0]


@query("SELECT '/r/folder/' || conv_id || '.json' AS path, turn + 1 AS ord, (turn + 1)::VARCHAR AS page, text, role AS speaker FROM conversations")
def loaded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages of both JSON shapes, in order; what is no object is left out but keeps its place."""
    raw = documents.load_documents(result_files(spark, sf_dir))[1]
    return raw.select("path", (F.col("ord") + 1).alias("ord"), "page", "text", F.try_element_at("extra", F.lit("speaker")).alias("speaker"))


@query(f"""
WITH {SQL_TURNS}, p AS (SELECT doc, page, {SQL_DISPLAY} AS s FROM t)
SELECT doc, 'engine 1' AS model, max(page) AS page_count, count(*) AS pages, sum(length(s))::BIGINT AS chars FROM p GROUP BY doc
""")
def written_and_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files of their own, discovered by their names, loaded and standardised again."""
    docs = standardize.build_documents(timed_pages(spark, sf_dir).withColumn("model", F.lit("engine 1")))
    docs = docs.withColumns({"source_pdf": F.concat("doc", F.lit(".pdf")), "file_name": F.concat("doc", F.lit(".pdf"))})
    root = sinks.scratch_folder(spark, "written")
    sinks.write_document_files(docs, root).count()
    found, raw = documents.load_documents(documents.discover(spark, root))
    pages = standardize.standardize_pages(raw).groupBy("path").agg(F.count(F.lit(1)).alias("pages"), F.sum("char_count").alias("chars"))
    doc = F.regexp_extract("source_pdf", r"\A(.*)\.pdf\z", 1)
    return found.join(pages, "path").select(doc.cast("long").alias("doc"), "model", "page_count", "pages", "chars")


@query("""
WITH p AS (SELECT c_custkey AS id, c_mktsegment AS model, CASE WHEN c_custkey % 3 = 0 THEN 'a.pdf' ELSE 'b.pdf' END AS file_name, CASE WHEN c_custkey % 4 <> 0 THEN '/in/' || c_nationkey END AS source_pdf FROM customer)
SELECT id FROM p WHERE file_name = 'a.pdf' AND (source_pdf IS NULL OR source_pdf = '/in/7') AND model = 'BUILDING' AND id % 5 <> 0
""")
def accepted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier results that belong to a run: same file, and same source and model where they say so."""
    n = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        n.alias("id"), F.col("c_mktsegment").alias("model"), F.when(n % 3 == 0, "a.pdf").otherwise("b.pdf").alias("file_name"),
        F.when(n % 4 != 0, F.concat(F.lit("/in/"), F.col("c_nationkey").cast("string"))).alias("source_pdf"), F.when(n % 5 != 0, F.array(n)).alias("pages"),
    )
    return documents.accepted_cache(rows, F.lit("a.pdf"), F.lit("/in/7"), F.lit("BUILDING")).select("id")


@query("""
WITH r AS (SELECT n_regionkey AS id, n_name AS model, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rank, n_nationkey AS k FROM nation)
SELECT id, rank, model, k / 100.0::DOUBLE AS doc_cer, i AS page, k / 10.0::DOUBLE + i AS cer FROM r, (VALUES (1), (2), (3)) AS x(i)
""")
def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as JSON, each model listed twice: its last pages count."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    pages = lambda add: F.array(*[F.struct(F.lit(i).alias("page"), (k / 10.0 + i + add).alias("cer"), F.lit(0.0).alias("wer")) for i in (1, 2, 3)])
    of = n.groupBy("n_regionkey").agg(
        F.array_sort(F.collect_list(F.struct("n_name", (k / 100.0).alias("cer")))).alias("ranked"),
        F.collect_list(F.struct(F.col("n_name").alias("model"), pages(5.0).alias("pages"))).alias("first"),
        F.collect_list(F.struct(F.col("n_name").alias("model"), pages(0.0).alias("pages"))).alias("last"),
    )
    ranking = F.transform("ranked", lambda x, i: F.struct((i + 1).alias("rank"), x["n_name"].alias("model"), x["cer"].alias("cer"), F.lit(0.0).alias("wer")))
    files = of.select(F.col("n_regionkey").cast("string").alias("path"), F.to_json(F.struct(ranking.alias("ranking"), F.concat("first", "last").alias("models"))).alias("json"))
    rows = documents.load_report(files)
    return rows.select(F.col("path").cast("int").alias("id"), "rank", "model", "doc_cer", "page", "cer")


# ---- answers of engines


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN trim(url) WHEN 1 THEN 'other' ELSE '' END AS chat,
       CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'inner' WHEN 2 THEN 'bare' WHEN 3 THEN 'no JSON' ELSE 'Erro desconhecido.' END AS message FROM pages
""")
def chat_and_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, url = F.col("page_id"), F.col("url")
    chat = F.when(n % 4 == 0, F.to_json(F.struct(F.struct(F.concat(F.lit(" "), url, F.lit("\n")).alias("content")).alias("message"))))
    chat = chat.when(n % 4 == 1, '{"message":"text","response":" other "}').when(n % 4 == 2, '{"message":{},"response":"ignored"}').otherwise("not JSON")
    error = F.when(n % 5 == 0, F.to_json(F.struct(F.lit(" ").alias("message"), url.alias("detail"))))
    error = error.when(n % 5 == 1, '{"error":{"message":" inner "}}').when(n % 5 == 2, '"bare"').when(n % 5 == 3, " no JSON ").otherwise("[]")
    return table(spark, sf_dir, "pages").select("page_id", engines.chat_response_to_text(chat).alias("chat"), engines.error_message(error).alias("message"))


@query("""
SELECT page_id, url || chr(10) || chr(10) || 'body' || chr(10) || chr(10) || 'end' AS text, 4 AS response_pages_count, page_id || ',7' AS indices, 2 AS tables_count, 1 AS images_count, 0 AS hyperlinks_count, '{"pages":' || page_id || '}' AS usage_info FROM pages
""")
def cloud_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a cloud engine: header, body and footer, pages that say nothing or are no objects, counts, usage."""
    n = F.col("page_id").cast("string")
    pages = [
        F.concat(F.lit('{"index":'), n, F.lit(',"header":'), F.to_json(F.array("url")), F.lit(',"markdown":" # **body** ","tables":[1,2]}')),
        F.lit('"no object"'), F.lit('{"index":7,"markdown":" ","images":["i"],"tables":"none"}'), F.lit('{"footer":"end","hyperlinks":[]}'),
    ]
    header = F.regexp_replace(F.concat_ws(",", *pages), r'"header":\["(.*?)"\]', r'"header":"$1"')
    payload = F.concat(F.lit('{"pages":['), header, F.lit('],"usage_info":{"pages":'), n, F.lit("}}"))
    said = table(spark, sf_dir, "pages").select("page_id", engines.cloud_response_to_text(payload).alias("r"))
    joined = F.array_join(F.transform("r.summary.response_page_indices", lambda i: i.cast("string")), ",").alias("indices")
    return said.select("page_id", "r.text", "r.summary.response_pages_count", joined, "r.summary.tables_count", "r.summary.images_count", "r.summary.hyperlinks_count", "r.summary.usage_info")


SQL_LINE_BOXES = "l AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, 'w' || l_partkey AS t, l_discount AS c, l_suppkey::DOUBLE AS x, l_quantity::DOUBLE AS y FROM lineitem)"


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page and items, in order: text, confidence, x, y."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("t"), F.col("l_discount").alias("c"), F.col("l_suppkey").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    return dealt(l, "l_orderkey", tasks_for(l)).groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("items"))


@query(f"""
WITH {SQL_LINE_BOXES}
SELECT page, i AS idx, t AS text, CASE WHEN page % 3 = 2 THEN 0.0 ELSE c END AS confidence, CASE WHEN page % 3 < 2 THEN x ELSE 0.0 END AS "left", CASE WHEN page % 3 < 2 THEN y ELSE 20.0 * CASE WHEN page % 3 = 2 THEN 0 ELSE i END END AS top,
       CASE WHEN page % 3 < 2 THEN x + 9 ELSE 8.0 * length(t) END AS "right", CASE WHEN page % 3 < 2 THEN y + 5 ELSE 10.0 + 20.0 * CASE WHEN page % 3 = 2 THEN 0 ELSE i END END AS bottom
FROM l WHERE page % 3 < 2 UNION ALL SELECT page, 0, t, 0.0, 0.0, 0.0, 8.0 * length(t), 10.0 FROM l WHERE page % 3 = 2
""")
def any_answer_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every shape (parallel lists under res, boxes with their texts a level deeper, bare texts) to boxes."""
    items, n = F.col("items"), F.col("page")
    polygon = lambda b: F.array(F.array(b["x"], b["y"] + 5), F.array(b["x"] + 9, b["y"]))
    parallel = F.to_json(F.struct(F.struct(F.transform(items, lambda b: b["t"]).alias("rec_texts"), F.transform(items, lambda b: b["c"]).alias("rec_scores"), F.transform(items, lambda b: F.array(b["x"], b["y"], b["x"] + 9, b["y"] + 5)).alias("rec_boxes")).alias("res")))
    legacy = lambda b: F.concat(F.lit("["), F.to_json(polygon(b)), F.lit(',["'), b["t"], F.lit('",'), b["c"].cast("string"), F.lit("]]"))
    nested = F.concat(F.lit("[["), F.array_join(F.transform(items, legacy), ","), F.lit("]]"))
    bare = F.to_json(F.transform(items, lambda b: b["t"]))
    answer = F.when(n % 3 == 0, parallel).when(n % 3 == 1, nested).otherwise(bare)
    rows = line_boxes(spark, sf_dir).select("page", F.inline(boundary.boxes_of_answer(answer)))
    return rows.withColumn("idx", F.col("idx").cast("long"))


@query(f"""
WITH {SQL_LINE_BOXES}, n AS (SELECT page, count(*) AS n FROM l GROUP BY page)
SELECT l.page, i AS idx, t AS text, CASE WHEN page_n > i + 1 THEN c ELSE -1.0 END AS conf, x::INT AS "left", y::INT AS top, 0 AS block_num, i::INT AS word_num,
       NOT (CASE WHEN page_n > i + 1 THEN c ELSE -1.0 END < 0.05 AND length(t) <= 2) AS kept
FROM (SELECT l.*, n.n AS page_n FROM l JOIN n ON l.page = n.page) l
""")
def parallel_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays to words, short arrays giving defaults, and the low-confidence rule."""
    items = F.col("items")
    of = lambda f: F.transform(items, f)
    none = F.array().cast("array<string>")
    data = line_boxes(spark, sf_dir).select(
        "page", of(lambda b: b["t"]).alias("text"), F.slice(of(lambda b: b["c"].cast("string")), F.lit(1), F.size("items") - 1).alias("conf"),
        of(lambda b: b["x"].cast("string")).alias("left"), of(lambda b: b["y"].cast("string")).alias("top"), none.alias("width"), none.alias("height"),
        none.alias("block_num"), none.alias("par_num"), none.alias("line_num"), none.alias("word_num"),
    )
    rows = engines.words_of_parallel_arrays(data)
    kept = quality.confident(F.col("text"), F.col("conf").cast("string"), 0.05, -1.0).alias("kept")
    return rows.select("page", F.col("idx").cast("long").alias("idx"), "text", "conf", "left", "top", "block_num", "word_num", kept)


@query("""
WITH b AS (SELECT l_orderkey AS page, l_linenumber AS line, l_partkey AS part, l_suppkey::DOUBLE AS x, l_quantity::DOUBLE AS y FROM lineitem)
SELECT page, line, part, least(x, y) AS poly_left, least(x, y) AS poly_top, greatest(x, y) AS poly_right, greatest(x, y) AS poly_bottom,
       least(x, 30.0::DOUBLE) AS flat_left, greatest(y, 40.0::DOUBLE) AS flat_bottom, line * 20.0::DOUBLE AS made_top, greatest(1.0::DOUBLE, length(part::VARCHAR) * 8.0::DOUBLE) AS made_right FROM b
""")
def boxes_of_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_suppkey").cast("double"), F.col("l_quantity").cast("double")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        layout.box_of_polygon(F.array(F.array(x, y), F.array(y, x))).alias("p"), layout.box_of_scalars(F.array(x, y, F.lit(30.0), F.lit(40.0))).alias("s"),
        layout.synthetic_box(F.col("l_linenumber"), F.col("l_partkey").cast("string")).alias("m"),
    )
    return rows.select("page", "line", "part", *[F.col(f"p.{c}").alias(f"poly_{c}") for c in ("left", "top", "right", "bottom")], F.col("s.left").alias("flat_left"), F.col("s.bottom").alias("flat_bottom"), F.col("m.top").alias("made_top"), F.col("m.right").alias("made_right"))


# ---- judgements and settings


@query("""
SELECT event_id, (400 + event_id % 110) IN (408, 409, 429, 500, 502, 503, 504) AND event_id % 4 > 0 AS retryable,
       contains(lower(event_type), 'err') OR contains(lower(event_type), 'sign') AS fatal, event_id % 20 BETWEEN 1 AND 12 AS in_range
FROM events
""")
def engine_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that may pass, messages that end a run, cached pages within the document."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (n % 20).cast("string").alias("page"), F.lit("a cached text that is long enough to count").alias("text"), F.lit(None).cast("string").alias("error"))
    fits = quality.reusable_pages(rows, F.lit(12)).select("event_id", F.lit(True).alias("fits"))
    rows = rows.join(fits, "event_id", "left")
    return rows.select("event_id", quality.is_retryable(400 + n % 110, n % 4).alias("retryable"), quality.is_fatal_error(F.upper("event_type"), ("err", "sign")).alias("fatal"), F.coalesce("fits", F.lit(False)).alias("in_range"))


@query(f"""
WITH x AS (SELECT doc_id, s, lower(s) AS norm, 300 + doc_id % 9 * 200 AS w FROM (SELECT doc_id, {SQL_SCORING} AS s FROM documents)), {sql_runaway("x")}
SELECT x.doc_id, s <> '' AND (length(s) > greatest(2500, least(14000, floor(x.w * 1000 / 420)::INT)) OR runaway) AS suspicious FROM x JOIN runaway ON x.doc_id = runaway.doc_id
""")
def suspicious_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts too long for their pages, whose widths go by their ids, or with runaway repetition."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), (300 + F.col("doc_id") % 9 * 200).cast("int").alias("w"), F.lit(1000).alias("h"))
    return quality.with_suspicion(rows, "t", "w", "h").select("doc_id", "suspicious")


@query("""
WITH s AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'off' WHEN 2 THEN '' ELSE 'SIM' END AS f, c_nationkey AS k FROM customer)
SELECT id, f IN (' Yes ', 'SIM') AS flag, CASE WHEN f <> '' THEN f IN (' Yes ', 'SIM') END AS optional, CASE WHEN k > 0 THEN k || ' 7' ELSE '7' END AS dims,
       'keyed:por+eng:oem' || id % 3 AS model, '--oem 3 --psm ' || k || ' -c preserve_interword_spaces=1 --tessdata-dir "/d"' AS config,
       CASE WHEN id % 2 = 0 THEN 'png PNG' ELSE 'jpg JPEG' END AS format, ['#1f77b4', '#ff7f0e', '#2ca02c', '#d62728', '#9467bd', '#8c564b', '#e377c2', '#7f7f7f', '#bcbd22', '#17becf'][id % 10 + 1] AS color,
       CASE WHEN k = 0 THEN '0%' WHEN k > 20 THEN '>100%' ELSE (k * 5) || '%' END AS percent FROM s
""")
def setting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("c_custkey"), F.col("c_nationkey")
    f = F.when(n % 4 == 0, " Yes ").when(n % 4 == 1, "off").when(n % 4 == 2, "").otherwise("SIM")
    dims = names.positive_ints(F.concat(k.cast("string"), F.lit(", x,-3, 7")))
    form = names.image_format(F.when(n % 2 == 0, " PNG ").when(n % 4 == 1, "").otherwise("jpeg"))
    return table(spark, sf_dir, "customer").select(
        n.alias("id"), names.flag(f).alias("flag"), names.optional_flag(f).alias("optional"), F.array_join(F.transform(dims, lambda d: d.cast("string")), " ").alias("dims"),
        names.model_id("keyed", names.languages(F.lit(" por+,eng ")), F.concat(F.lit("oem"), (n % 3).cast("string")), "+").alias("model"),
        names.keyed_engine_config(3, k, data_dir="/d").alias("config"), F.concat_ws(" ", form["extension"], form["encoder"]).alias("format"), names.color(n).alias("color"),
        charts.percent_label(k * 5 / 100.0).alias("percent"),
    )


@query("""
WITH p AS (SELECT p_partkey AS id, (p_size * 53 + 200)::INT AS w, ((p_partkey % 50) * 71 + 150)::INT AS h FROM part),
d AS (SELECT *, greatest(w, h) AS longest FROM p),
x AS (SELECT id, w, h, longest, unnest(list_distinct(CASE WHEN longest <= 1600 THEN [longest, 1600, 1200] ELSE [1600, 1200] END)) AS dim FROM d),
s AS (SELECT id, dim, CASE WHEN longest <= dim THEN w ELSE greatest(1, floor(w * (dim::DOUBLE / longest))::INT) END AS width, CASE WHEN longest <= dim THEN h ELSE greatest(1, floor(h * (dim::DOUBLE / longest))::INT) END AS height FROM x),
u AS (SELECT id, width, height, min(dim) AS dim FROM s GROUP BY ALL)
SELECT id, string_agg(width || 'x' || height, ' ' ORDER BY dim) AS sizes FROM u GROUP BY id
""")
def ascending_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("p_size") * 53 + 200).cast("int"), (F.col("p_partkey") % 50 * 71 + 150).cast("int")
    sizes = F.transform(geometry.candidate_sizes(w, h, ascending=True), lambda s: F.concat_ws("x", s["width"].cast("string"), s["height"].cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(sizes, " ").alias("sizes"))


# ---- roll-ups and charts


SQL_HEIGHTS = f"""
d AS (SELECT doc_id, coalesce(text, '') AS s, length(coalesce(text, '')) AS n FROM documents),
u AS (SELECT doc_id, 0 AS height_idx, CASE WHEN n % 3 = 0 THEN 'the text in the image ' || s ELSE translate(s, 'aiu', '4 v') END AS t, n % 5 = 1 AS suspicious FROM d
      UNION ALL SELECT doc_id, 1, CASE WHEN n % 2 = 0 THEN 'not visible in the image ' || s ELSE s END, n % 7 = 2 FROM d UNION ALL SELECT doc_id, 2, s || ' and more words at the end of it', false FROM d),
g AS (SELECT *, {SQL_SCORE} AS raw_score, contains(t, 'the text in the image') OR contains(t, 'not visible in the image') OR t = '' OR (len(regexp_extract_all(t, '[A-Za-zÀ-ÖØ-öø-ÿ0-9]')) < 25 AND len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '\\S'))) <= 1) AS generic FROM u),
a AS (SELECT *, CASE WHEN suspicious THEN 0.0::DOUBLE ELSE raw_score END AS score, NOT generic AND NOT suspicious AS ends FROM g),
k AS (SELECT a.* FROM a JOIN (SELECT doc_id, min(height_idx) FILTER (ends) AS stop FROM a GROUP BY doc_id) b ON a.doc_id = b.doc_id WHERE (stop IS NULL OR height_idx <= stop) AND score > 0)"""


@query(f"WITH {SQL_HEIGHTS} SELECT doc_id, height_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, height_idx) AS n FROM k) WHERE n = 1")
def best_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged texts of three band heights: the best score up to the first that is neither generic nor suspicious."""
    n, s = F.length("t"), F.col("t")
    made = lambda idx, t, suspicious: F.struct(F.lit(idx).alias("height_idx"), t.alias("text"), suspicious.alias("suspicious"))
    rows = F.array(
        made(0, F.when(n % 3 == 0, F.concat(F.lit("the text in the image "), s)).otherwise(F.translate(s, "aiu", "4 v")), n % 5 == 1),
        made(1, F.when(n % 2 == 0, F.concat(F.lit("not visible in the image "), s)).otherwise(s), n % 7 == 2),
        made(2, F.concat(s, F.lit(" and more words at the end of it")), F.lit(False)),
    )
    merged = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", F.explode(rows).alias("m")).select("doc_id", "m.*")
    return select.best_height(merged, ("doc_id",), tiered=True).select("doc_id", "height_idx", "score")


def line_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(board, pages): orders as documents, line numbers as ranked models, each with two pages."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    l = dealt(l.select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", tasks_for(l)).groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("rank")).agg(F.max("l_quantity").alias("q"))  # noqa: E741
    board = l.select("doc", F.concat(F.lit("m"), F.col("rank").cast("string")).alias("model"), "rank", F.col("q").alias("total_processing_seconds"), (F.col("q") / 40).alias("cer"), (F.col("q") / 20).alias("wer"))
    pages = board.select("doc", "model", F.explode(F.array(F.lit(5), F.lit(9))).alias("page"), ((F.col("cer") * F.col("page")) / 5).alias("cer"))
    return board, pages


SQL_LINES_RANKED = "b AS (SELECT l_orderkey AS doc, l_linenumber AS rank, max(l_quantity) AS q FROM lineitem GROUP BY ALL)"


@query(f"WITH {SQL_LINES_RANKED} SELECT doc, max(q) * 1.18::DOUBLE AS time_axis, max(q / 40) * 1.2::DOUBLE AS cer_axis, max(q / 20) * 1.2::DOUBLE AS wer_axis FROM b GROUP BY doc")
def axis_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.axis_limits(line_cells(spark, sf_dir)[0])


@query(f"WITH {SQL_LINES_RANKED} SELECT doc, rank, CASE WHEN rank <= 2 THEN 'M' ELSE 'm' END || rank AS label, least(1.0::DOUBLE, q / 40 * 5 / 5) AS p1, least(1.0::DOUBLE, q / 40 * 9 / 5) AS p2 FROM b WHERE doc IN (SELECT doc FROM b WHERE rank = 1)")
def heat_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heat map's rows by rank; documents without a first-ranked model have no columns."""
    cells = charts.heat_cells(*line_cells(spark, sf_dir), labels={"m1": "M1", "m2": "M2"})
    return charts.heat_matrix(cells, 2)


@query(f"""
WITH {SQL_BENCHMARK_PAGES}, {SQL_CANDIDATES},
r AS (SELECT doc, string_agg(t, chr(10) ORDER BY page) AS a FROM p GROUP BY doc),
h AS (SELECT doc, model, coalesce(string_agg(t, chr(10) ORDER BY page) FILTER (t <> ''), '') AS b FROM c GROUP BY doc, model),
q AS (SELECT r.doc, model, a, b FROM r JOIN h ON r.doc = h.doc), {_alphabets("q")},
m AS (SELECT *, {_encoded("a", "b", SQL_CHARS, "vc")} AS char_distance, {_encoded("a", "b", SQL_WORDS, "vw")} AS word_distance FROM y),
k AS (SELECT doc, model, char_distance, word_distance, {SQL_RATE.format("char_distance", "length(a)")} AS cer, {SQL_RATE.format("word_distance", n_words("a"))} AS wer FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY cer, wer, model) AS rank FROM k),
z AS (SELECT doc, count(*) AS pages FROM p GROUP BY doc)
SELECT g.doc, rank, model, char_distance, word_distance, round(cer, 9) AS cer, round(wer, 9) AS wer, z.pages AS listed_pages FROM g JOIN z ON g.doc = z.doc
""")
def report_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report, as JSON and read back: its ranking, and how many pages each model lists."""
    nested = evaluate.report(*reference_and_candidates(benchmark_pages(spark, sf_dir))).select("doc", F.to_json(F.struct("ranking", "models")).alias("json"))
    rank = "array<struct<rank:int,model:string,cer:double,wer:double,char_distance:int,word_distance:int>>"
    r = nested.select("doc", F.from_json("json", f"struct<ranking:{rank},models:array<struct<model:string,pages:array<struct<page:int>>>>>").alias("r"))
    ranking = r.select("doc", F.inline("r.ranking"))
    pages = r.select("doc", F.explode("r.models").alias("m")).select("doc", "m.model", F.size("m.pages").alias("listed_pages"))
    rows = ranking.join(pages, ["doc", "model"])
    return rows.select("doc", "rank", "model", "char_distance", "word_distance", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"), F.col("listed_pages").cast("long").alias("listed_pages"))


# ---- odd characters, whole reports, sums over bands

SQL_ODD = "replace(replace(replace(replace(replace(coalesce(text, ''), '. ', '.' || chr(13) || chr(10)), 'er ', 'er' || chr(160)), 'th', 't' || chr(8203) || 'h'), ', ', ',' || chr(13)), 'é', 'e' || chr(769))"
SQL_CLEAN = f"replace(replace(replace(replace(nfc_normalize({SQL_ODD}), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(8203), '')"
SQL_CLEAN_LINES = f"array_to_string(list_transform(string_split({SQL_CLEAN}, chr(10)), lambda l: trim(regexp_replace(l, '[ \\t\\f\\v]+', ' ', 'g'))), chr(10))"


@query(f"""
SELECT doc_id, trim(regexp_replace({SQL_CLEAN_LINES}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text,
       trim(regexp_replace(nfc_normalize({SQL_CLEAN}), '\\s+', ' ', 'g')) AS scored FROM documents
""")
def odd_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with CR, CR LF, no-break spaces, zero-width spaces and letters whose accents stand apart, as standard texts and as scoring texts."""
    odd = F.coalesce("text", F.lit(""))
    for plain, put in ((". ", ".\r\n"), ("er ", "er\u00a0"), ("th", "t\u200bh"), (", ", ",\r"), ("é", "e\u0301")):
        odd = F.replace(odd, F.lit(plain), F.lit(put))
    rows = table(spark, sf_dir, "documents").select("doc_id", odd.alias("odd")).withColumn("text", text.display_text(F.col("odd")))
    return rows.select("doc_id", "text", text.scoring_text(F.col("text"), F.col("odd")).alias("scored"))


@query("""
WITH b AS (SELECT conv_id, turn, trim(text) AS t, turn % 3 AS tables_count, CASE WHEN turn % 4 = 1 THEN 0 ELSE length(text) END AS images_count FROM conversations WHERE turn % 5 <> 4 AND coalesce(text, '') <> '')
SELECT conv_id, count(*)::BIGINT AS bands_count, sum(tables_count)::BIGINT AS tables_count, sum(images_count)::BIGINT AS images_count FROM b GROUP BY conv_id
""")
def band_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as bands of a page; every fifth has no text, and some counts are no numbers."""
    turn = F.col("turn")
    bands = table(spark, sf_dir, "conversations").select(
        "conv_id", turn.alias("band"), F.when(turn % 5 != 4, F.col("text")).alias("text"), (turn % 3).alias("tables_count"),
        F.when(turn % 4 == 1, "none").otherwise(F.length("text").cast("string")).alias("images_count"),
    )
    made = select.merge_bands(bands, ("conv_id",), ("tables_count", "images_count"))
    return made.select("conv_id", F.col("bands_count").cast("long").alias("bands_count"), "tables_count", "images_count")


SQL_BOARD = SQL["leaderboard"].strip()


@query(f"""
WITH RECURSIVE board AS ({SQL_BOARD}),
d AS (SELECT item_id AS doc, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS page FROM benchmark),
f AS (SELECT doc, max(page) AS pages, string_agg(trim(regexp_replace(s, '\\s+', ' ', 'g')), chr(10) ORDER BY page) AS t FROM d WHERE trim(regexp_replace(s, '\\s+', ' ', 'g')) <> '' GROUP BY doc),
x AS (SELECT doc, 0 AS part, unnest([printf('Referencia: %s | paginas=%d | chars=%d | words=%d', doc || '.pdf', pages, length(t), {n_words("t")}), '',
        'Modelo                    CER      WER    DistC    DistW   Tempo(s)   Falhas  Faltantes   Extras', repeat('-', 97)]) AS line, generate_subscripts([1, 2, 3, 4], 1) AS place FROM f
      UNION ALL SELECT doc, 1, printf('%-20s %8.4f %8.4f %8d %8d %10.3f %8d %10d %8d', model, cer, wer, char_distance, word_distance, 0.0::DOUBLE, failed_pages_count, missing_pages_count, extra_pages_count), rank FROM board)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY part, place) AS n, line FROM x
""")
def console_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The console report of every benchmark item, of engines that don't tell their times."""
    pages = benchmark_pages(spark, sf_dir)
    reference, made = reference_and_candidates(pages)
    board = evaluate.leaderboard(reference, made.withColumn("processing_seconds", F.lit(0.0)))
    about = standardize.build_documents(reference, ("doc",)).select("doc", F.concat(F.col("doc").cast("string"), F.lit(".pdf")).alias("file_name"), "page_count", F.length("text_for_cer_wer").alias("total_char_count"), "total_word_count")
    return evaluate.console_report(about, board)


# ---- engines, renderers and copies of what they make


class RuleEngine:
    """Stands for an engine: answers by a rule on the page's text, and fails on every page that divides by five with two left."""

    def open(self) -> None:
        pass

    def recognise(self, page: dict) -> str:
        if page["page"] % 5 == 2:
            raise RuntimeError(f"no answer for page {page['page']}")
        return page["truth"].replace("e", "c")


@query("SELECT conv_id AS doc, turn + 1 AS page, CASE WHEN (turn + 1) % 5 = 2 THEN '' ELSE replace(coalesce(text, ''), 'e', 'c') END AS text, CASE WHEN (turn + 1) % 5 = 2 THEN 'no answer for page ' || (turn + 1) END AS error FROM conversations")
def engine_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn through an engine, four calls in flight a task."""
    pages = conversation_pages(spark, sf_dir).select("doc", "page", F.coalesce("text", F.lit("")).alias("truth"))
    return engines.run_engine(pages, RuleEngine(), in_flight=4).select("doc", "page", "text", "error")


@query("""
WITH a AS (SELECT l_orderkey AS page, list('attempt ' || l_linenumber || ': part ' || l_partkey ORDER BY l_linenumber, l_partkey) AS said FROM lineitem GROUP BY l_orderkey)
SELECT page, array_to_string(said[greatest(1, len(said) - 2):len(said)], ' | ') AS last FROM a
""")
def last_attempt_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three entries of each order's list of attempts."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    said = F.transform("lines", lambda x: F.concat(F.lit("attempt "), x["l_linenumber"].cast("string"), F.lit(": part "), x["l_partkey"].cast("string")))
    return rows.withColumn("said", said).select("page", F.array_join(engines.last_attempts(F.col("said"), 3), " | ").alias("last"))


PAGE_BYTES = 700


def _cut(content: bytes, dpi: int) -> list[tuple[int, int, bytes]]:
    """A renderer of pages of PAGE_BYTES; it can't open what has a length that divides by three."""
    if len(content) % 3 == 0:
        raise ValueError("can't open")
    return [(dpi, 10, content[i : i + PAGE_BYTES]) for i in range(0, len(content), PAGE_BYTES)]


def _whole(content: bytes, dpi: int) -> list[tuple[int, int, bytes]]:
    return [(dpi, 20, content)]


@query(f"""
WITH d AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents WHERE text <> ''),
r AS (SELECT doc_id, n, unnest(CASE WHEN doc_id % 4 = 0 THEN [0, 1] WHEN n % 3 = 0 THEN [0] ELSE range(0, ceil(n / {PAGE_BYTES}.0)::BIGINT) END) AS i FROM d)
SELECT doc_id, i + 1 AS page, doc_id % 4 = 0 AS reused, CASE WHEN doc_id % 4 = 0 THEN 'scan' || (i + 1) || '.png' ELSE printf('page_%04d.jpg', i + 1) END AS image_file,
       CASE WHEN doc_id % 4 = 0 THEN 0 WHEN n % 3 = 0 THEN 20 ELSE 10 END AS height, CASE WHEN doc_id % 4 = 0 THEN 5 + i WHEN n % 3 = 0 THEN n ELSE least({PAGE_BYTES}, n - i * {PAGE_BYTES}) END::BIGINT AS bytes FROM r
""")
def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rendered by the first renderer that can open them; every fourth has its pages already, beside a file that is none."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))
    old = docs.where(F.col("path").cast("long") % 4 == 0).select("path", F.explode(F.array(*[F.struct(F.lit(n).alias("image_file"), F.lit(b).alias("image")) for n, b in (("scan2.png", bytearray(6)), ("scan1.png", bytearray(5)), ("notes.txt", bytearray(1)))])).alias("f")).select("path", "f.*")
    made = boundary.rendered_or_reused(docs, old, 220, {"cut": _cut, "whole": _whole})
    return made.select(F.col("path").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), "reused", "image_file", F.coalesce("height", F.lit(0)).alias("height"), F.length("image").cast("long").alias("bytes"))


@query("SELECT conv_id AS doc, unnest(['main', 'copy']) AS root, max(turn) + 1 AS pages FROM conversations GROUP BY conv_id")
def written_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written under two roots in one run, found again under each."""
    docs = standardize.build_documents(timed_pages(spark, sf_dir).withColumn("model", F.lit("engine 1"))).withColumn("source_pdf", F.concat("doc", F.lit(".pdf")))
    folder = sinks.scratch_folder(spark, "copies")
    sinks.write_document_files(docs, f"{folder}/main", f"{folder}/copy")
    found = [documents.load_documents(documents.discover(spark, f"{folder}/{root}"))[0].select(F.regexp_extract("source_pdf", r"\A(.*)\.pdf\z", 1).cast("long").alias("doc"), F.lit(root).alias("root"), F.col("page_count").alias("pages")) for root in ("main", "copy")]
    return found[0].unionByName(found[1])
