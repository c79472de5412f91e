import hashlib
import json
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioscope.functions import geometry, names
from folioscope.operators import evaluate, layout, quality, select, standardize
from folioscope.plans import charts, runs
from folioscope.sources import boundary, documents, engines, sinks
from folioscope.streaming.pages import append_stream, resume_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import this file

RAW = "doc string, model string, ord int, page string, text string, processing_seconds string, error string, warnings array<string>, meta map<string,string>, metadata map<string,string>, ocr_method string"


def raw(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (11 - len(r))) for r in rows], RAW)


def test_standardize_coerces(spark):
    rows = standardize.standardize_pages(
        raw(
            spark,
            ("d", "m", 0, "3", "  a\r\nb ", "1.0005", None, [" w ", ""], {"k": "2"}, {"k": "1", "j": "0"}, " full "),
            ("d", "m", 1, "x", None, "abc", " boom "),
            ("d", "m", 2, None, "t", "-4", " "),
        )
    ).orderBy("ord").collect()
    a, b, c = rows
    assert (a.page, a.text, a.text_for_cer_wer, a.status, a.char_count, a.word_count, a.processing_seconds) == (3, "a\nb", "a b", "ok", 3, 2, 1.0)
    assert (a.warnings, a.metadata, a.extraction_mode) == (["w"], {"k": "2", "j": "0"}, "full")
    assert (b.page, b.status, b.error, b.processing_seconds, b.warnings) == (0, "error", "boom", 0.0, [])
    assert (c.page, c.status, c.error, c.processing_seconds) == (0, "ok", None, 0.0)


def test_odd_seconds(spark):
    rows = standardize.standardize_pages(raw(spark, ("d", "m", 0, "1", "t", "NaN"), ("d", "m", 1, "2", "t", "Infinity"), ("d", "m", 2, "3", "t", "-Infinity"), ("d", "m", 3, "4", "t", "2.0005"))).orderBy("ord").collect()
    assert [r.processing_seconds for r in rows] == [0.0, float("inf"), 0.0, round(2.0005, 3)]


def test_documents(spark):
    pages = standardize.standardize_pages(raw(spark, ("d", "m", 0, "2", "two", "24.115"), ("d", "m", 1, "1", "one", "24.115"), ("d", "m", 2, "0", "zero", "0"), ("d", "m", 3, "3", "", "0", "e")))
    (d,) = standardize.build_documents(pages).collect()
    assert (d.text, d.text_for_cer_wer) == ("zero\n\none\n\ntwo", "zero\none\ntwo")
    assert (d.page_count, d.timed_pages_count, d.successful_pages_count, d.failed_pages_count) == (3, 4, 3, 1)
    assert (d.total_processing_seconds, d.average_page_processing_seconds) == (48.23, round(48.23 / 4, 3))
    assert [p.page for p in d.pages] == [0, 1, 2, 3] and d.pages[0].metadata == {}


def evaluation(spark):
    ref = standardize.standardize_pages(raw(spark, ("d", "r", 0, "1", "alpha beta"), ("d", "r", 1, "2", ""), ("d", "r", 2, "3", "gamma")))
    cand = standardize.standardize_pages(
        raw(spark, ("d", "a", 0, "1", "wrong"), ("d", "a", 1, "1", "alpha beta"), ("d", "a", 2, "9", "more"), ("d", "b", 0, "1", "alpha beta"), ("d", "b", 1, "2", "x"), ("d", "b", 2, "3", "gamma"))
    )
    return ref, cand


def test_page_metrics_and_sets(spark):
    ref, cand = evaluation(spark)
    got = {(r.model, r.page): r for r in evaluate.page_metrics(ref, cand).collect()}
    assert got["a", 1].cer == 0 and not got["a", 1].missing_page  # the last duplicate counts
    assert (got["a", 2].cer, got["a", 2].status) == (0.0, "missing")
    assert (got["a", 3].cer, got["a", 3].status) == (1.0, "missing")
    assert got["b", 2].cer == 1.0
    sets = {r.model: (r.missing_pages, r.extra_pages) for r in evaluate.page_sets(ref, cand).collect()}
    assert sets == {"a": ([2, 3], [9]), "b": ([], [])}


def test_leaderboard_scores_joined_texts(spark):
    ref, cand = evaluation(spark)
    b, a = evaluate.leaderboard(ref, cand).orderBy("rank").collect()
    assert (b.model, b.rank, b.char_distance) == ("b", 1, 2)  # "x" and its separator
    assert (a.model, a.rank, a.missing_pages_count, a.extra_pages_count) == ("a", 2, 2, 1)
    lines = evaluate.console_lines(evaluate.leaderboard(ref, cand)).orderBy("rank").collect()
    assert lines[0].line.startswith("b                    ")
    report = json.loads(evaluate.report(ref, cand).select(F.to_json(F.struct("ranking", "models"))).first()[0])
    assert [m["model"] for m in report["models"]] == ["b", "a"] and len(report["models"][0]["pages"]) == 3


def test_charts(spark):
    ref, cand = evaluation(spark)
    board, pages = evaluate.leaderboard(ref, cand), evaluate.page_metrics(ref, cand)
    cells = charts.heat_cells(board, pages)
    assert cells.count() == 6 and charts.heat_matrix(cells, 3).columns[-1] == "p3"
    assert charts.axis_limits(board).count() == 1
    assert spark.range(1).select(charts.percent_label(F.lit(1.5)).alias("a"), charts.percent_label(F.lit(0.25)).alias("b")).first() == (">100%", "25%")


def test_quality(spark):
    long = "word " * 7
    cases = {"": (True, False), "The text content is": (True, False), "short": (True, False), "a line of text that is long enough to count\nsecond line here with even more text in it, so that it scores over the limit": (False, True), long: (False, False)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: (r.g, r.a) for r in df.select("t", quality.is_generic_response(F.col("t")).alias("g"), quality.is_acceptable_text(F.col("t")).alias("a")).collect()}
    assert got == cases
    run = {r.t: r.runaway for r in quality.with_runaway_repetition(spark.createDataFrame([(long,), ("go to it go to it go to it go to it",), ("see the end see the end see the end see the end",), ("a b c",), ("a a a a a a",)], "t string"), "t").collect()}
    assert list(run.values()) == [True, False, True, False, True]
    sus = quality.with_suspicion(spark.createDataFrame([("ab " * 2000 + "x", 10, 10), ("", 10, 10)], "t string, w int, h int"), "t", "w", "h").collect()
    assert [s.suspicious for s in sus] == [True, False]


ATTEMPTS = "doc int, page int, idx int, mode string, text string, score double, suspicious boolean, warnings array<string>, error string"


def test_best_attempt(spark):
    df = spark.createDataFrame(
        [
            (1, 1, 0, "a", "x", 5.0, False, ["w0"], None), (1, 1, 1, "b", "y", 5.0, False, ["w1"], None),
            (2, 1, 0, "a", "", 0.0, False, [], "e0"), (2, 1, 1, "b", "", 0.0, False, [], "e1"),
            (3, 1, 0, "a", "x", 9.0, True, [], None), (3, 1, 1, "b", "y", 1.0, False, [], None),
        ], ATTEMPTS)
    got = {r.doc: r for r in select.best_attempt(df).collect()}
    assert (got[1].mode, got[1].warnings, got[2].mode, got[2].error, got[3].mode) == ("a", ["w0", "w1"], "b", "a: e0 | b: e1", "a")
    assert {r.doc: r.mode for r in select.best_attempt(df, tiered=True).collect()}[3] == "b"


def test_heights_and_bands(spark):
    bands = spark.createDataFrame([(1, 1, 0, 1, "same line here"), (1, 1, 0, 0, "first line here"), (1, 1, 0, 2, "same line here"), (1, 2, 0, 0, "")], "doc int, page int, height_idx int, band int, text string")
    assert [(r.page, r.text) for r in select.merge_bands(bands).collect()] == [(1, "first line here\nsame line here")]
    good = "a line of text that is long enough to count\nand one more"
    merged = spark.createDataFrame([(1, 1, 0, "the text content " * 9, False), (1, 1, 1, good, False), (1, 1, 2, good * 3, False)], "doc int, page int, height_idx int, text string, suspicious boolean")
    assert select.best_height(merged).first().height_idx == 0  # an earlier generic text may score higher


class FakeEngine:
    """Answers from the page's own truth column, with deterministic mistakes: a page fails or is empty by a hash of its keys and mode."""

    def __init__(self, mode, fails=0, empties=0):
        self.mode, self.fails, self.empties = mode, fails, empties

    def open(self):
        pass

    def recognise(self, page):
        h = hashlib.md5(f"{page['doc']}/{page['page']}/{self.mode}".encode()).digest()[0] % 10
        if h < self.fails:
            raise RuntimeError("engine failed")
        return "" if h < self.fails + self.empties else page["truth"]


class SlowEngine:
    """Takes 50 ms a page; pages that divide by 7 fail on their first call, those by 11 on every call, number 5 hangs."""

    def __init__(self, hangs=False):
        self.hangs, self.seen = hangs, set()

    def open(self):
        pass

    def recognise(self, page):
        n = page["page"]
        time.sleep(3.0 if self.hangs and n == 5 else 0.05)
        if n % 11 == 0 or n % 7 == 0 and n not in self.seen:
            self.seen.add(n)
            raise RuntimeError(f"failed {n}")
        return f"text {n}"


def test_engine_calls_in_flight(spark):
    pages = spark.createDataFrame([("d", n) for n in range(1, 65)], "doc string, page int").coalesce(1)

    def timed(**how):
        began = time.perf_counter()
        rows = engines.run_engine(pages, SlowEngine(how.pop("hangs", False)), **how).collect()
        return rows, time.perf_counter() - began

    timed(in_flight=64)
    plain, alone = timed()
    rows, together = timed(in_flight=16)
    assert alone > 3.2 and together < alone / 4
    assert [r.page for r in rows] == [r.page for r in plain] == list(range(1, 65))
    fails = lambda n: n % 11 == 0 or n % 7 == 0
    for got in (plain, rows):
        assert {r.page: r.error for r in got} == {n: f"failed {n}" if fails(n) else None for n in range(1, 65)}
        assert all(r.text == ("" if fails(r.page) else f"text {r.page}") and 0.04 < r.processing_seconds < 1 for r in got)
    # the budget of repeats is shared: enough of it leaves the pages that always fail
    repeated, _ = timed(in_flight=16, repeats=100)
    assert {r.page for r in repeated if not r.error} >= {n for n in range(1, 65) if n % 7 == 0 and n % 11}
    few, _ = timed(in_flight=16, repeats=1)
    assert sum(r.error is not None for r in few) in (13, 14)
    hung, took = timed(in_flight=16, deadline=0.5, hangs=True)
    assert took < 3 and {r.page: r.error for r in hung}[5] == "no answer within 0.5 s" and {r.page: r.text for r in hung}[6] == "text 6"


def test_cascade_runs_open_pages_only(spark):
    truth = "a line of text that is long enough to count\nsecond line here with even more text in it, so that it scores over the limit"
    pages = spark.createDataFrame([("d", n, truth) for n in range(1, 21)], "doc string, page int, truth string")
    seen = {}

    def write(df, name):
        seen[name] = df.count()
        return df

    stages = [(mode, lambda df, mode=mode: engines.run_engine(df, FakeEngine(mode, 3, 3))) for mode in standardize.PIPELINE]
    got = select.cascade(pages, stages, write).collect()
    assert len(got) == 20 and seen["attempt-0"] == 20 > seen["attempt-1"] > seen["attempt-2"]


def test_boxes(spark):
    box = lambda i, t, left, top, bottom: (1, i, t, float(left), float(top), float(bottom))
    df = spark.createDataFrame([box(0, "right", 50, 2, 12), box(1, "left", 0, 0, 10), box(2, "next", 0, 20, 30), box(3, "far", 0, 80, 90), box(4, "far!", 0, 100, 110)], "page int, idx int, text string, left double, top double, bottom double")
    assert layout.boxes_to_text(df).first().text == "left right\nnext\n\nfar"
    poly = spark.createDataFrame([([[1.0, 5.0], [4.0, 2.0]], [1.0, 2.0, 3.0, 4.0])], "p array<array<double>>, v array<double>").select(layout.box_of_polygon(F.col("p")), layout.box_of_scalars(F.col("v")), layout.synthetic_box(F.lit(2), F.lit("abc"))).first()
    assert [tuple(x) for x in poly] == [(1.0, 2.0, 4.0, 5.0), (1.0, 2.0, 3.0, 4.0), (0.0, 40.0, 24.0, 50.0)]


def test_keyed_words(spark):
    df = spark.createDataFrame([(1, ["Hi", "there", "", "new", "x"], ["0", "5", "0", "0", "1"], ["0", "0", "0", "12", "bad"], ["10"] * 5, ["1", "1", "1", "2", "2"], ["90"] * 5)], "page int, text array<string>, left array<string>, top array<string>, height array<string>, block_num array<string>, conf array<string>")
    df = df.withColumns({c: F.array().cast("array<string>") for c in ("width", "par_num", "line_num", "word_num")})
    words = engines.words_of_parallel_arrays(df)
    assert layout.keyed_words_to_text(words).first().text == "Hi there\n\nnew"
    keep = words.select(quality.confident(F.col("text"), F.lit("3"), 30.0, -1.0).alias("k")).collect()
    assert [k.k for k in keep] == [False, True, True]


def test_geometry(spark):
    one = spark.range(1).select(geometry.bands(F.lit(2500), F.lit(1200)).alias("b"), geometry.bands(F.lit(900), F.lit(1200)).alias("w"), geometry.band_heights(F.lit(2500)).alias("h"), geometry.candidate_sizes(F.lit(3000), F.lit(1000)).alias("c"), geometry.max_reasonable_chars(F.lit(10), F.lit(10)).alias("m"), geometry.rotation(F.lit(10.0), F.lit(50.0)).alias("r")).first()
    assert [(b.top, b.bottom) for b in one.b] == [(0, 903), (765, 1737), (1599, 2500)]
    assert [(b.top, b.bottom) for b in one.w] == [(0, 900)] and one.h == [1250, 1200, 900]
    assert [(c.width, c.height) for c in one.c] == [(1600, 533), (1200, 400)] and (one.m, one.r) == (2500, 180)


def test_names(spark):
    one = spark.range(1).select(
        names.safe_name(F.lit(" a/b ç.. ")), names.safe_name(F.lit("..")), names.output_path("/r", F.lit("m:1"), F.lit("x/My File.v2.pdf")), names.label(F.lit("family-9"), {"one": "One"}, {"family-": "Family"}), names.label(F.lit("own")),
        names.color(F.lit(12)), names.flag(F.lit(" Sim ")), names.positive_ints(F.lit("3, x,-1,4")), names.model_id("keyed", names.languages(F.lit("por+eng")), F.lit("oem3"), "+"), names.keyed_engine_config(3, F.lit(6)), names.image_format(F.lit("JPEG")),
    ).first()
    assert list(one)[:10] == ["a_b", "arquivo", "/r/data/extracted/m_1_output_My_File.v2.json", "Family", "own", "#2ca02c", True, [3, 4], "keyed:por+eng:oem3", "--oem 3 --psm 6 -c preserve_interword_spaces=1"]
    assert tuple(one[10]) == ("jpg", "JPEG")


def test_sources(spark, tmp_path):
    (tmp_path / "data/extracted").mkdir(parents=True)
    doc = {"model": "m", "page_count": 7, "pages": [{"page": 1, "text": "a", "dpi": 3, "meta": {"k": "v"}}, "skipped", {"page": "2", "text": "b", "processing_seconds": "1.5"}]}
    (tmp_path / "data/extracted/m_output_x.json").write_text(json.dumps(doc))
    (tmp_path / "data/extracted/z_output_y.json").write_text(json.dumps([{"page": 4, "text": "c"}, {"page": 3.7}]))
    docs, pages = documents.load_documents(documents.discover(spark, str(tmp_path)))
    assert sorted((d.model, d.page_count) for d in docs.collect()) == [("extracted", 4), ("m", 7)]
    std = {(r.model, r.page): r for r in standardize.standardize_pages(pages.withColumn("doc", F.lit("d"))).collect()}
    assert std["m", 1].metadata == {"k": "v", "dpi": "3"} and std["m", 2].processing_seconds == 1.5 and ("extracted", 3) in std
    assert documents.read_files(spark, [f"{tmp_path}/data/extracted/m_output_x.json"] * 2).count() == 1
    assert documents.Settings().fallbacks == (1600, 1200) and documents.Settings.of_conf(spark).render_dpi == 220
    bad = spark.createDataFrame([("p", "3")], "path string, json string")
    try:
        documents.load_documents(bad)[0].collect()
        raise AssertionError("a number is no document")
    except Exception as e:  # noqa: BLE001
        assert "unsupported JSON shape" in str(e)


def test_resume(spark):
    images = spark.createDataFrame([("d", n) for n in (1, 2, 3)], "doc string, page int")
    good = "a line of text that is long enough to count"
    cached = spark.createDataFrame([("d", "1", 0, good, None), ("d", "2", 0, good, "e"), ("d", "x", 1, good, None), ("d", "1", 2, good + "!", None)], "doc string, page string, ord int, text string, error string")
    got = {r.page: (r.reused, r.text) for r in documents.resume_plan(images, cached).collect()}
    assert got == {1: (True, good + "!"), 2: (False, None), 3: (False, None)}


def test_engine_answers(spark):
    cloud = json.dumps({"pages": [{"index": 0, "markdown": "# T", "header": "H", "tables": ["t"]}, "no object", {"index": 1, "markdown": ""}], "usage_info": {"pages": 2}})
    for none in ('{"pages":[]}', '{"text":"x"}', '{"pages":"x"}'):
        with pytest.raises(Exception, match="no pages"):
            spark.range(1).select(engines.cloud_response_to_text(F.lit(none))).collect()
    one = spark.range(1).select(
        engines.cloud_response_to_text(F.lit(cloud)).alias("c"), engines.chat_response_to_text(F.lit('{"message":{"content":"hi"}}')).alias("m"),
        engines.error_message(F.lit('{"message":" ","error":{"type":"bad"}}')).alias("e"), engines.error_message(F.lit("plain")).alias("p"), engines.error_message(F.lit("[]")).alias("d"),
        engines.boxes_of_parallel_arrays(F.lit('{"res":{"rec_texts":["a","b"],"rec_scores":[0.5]}}')).alias("b"),
    ).first()
    assert (one.c.text, one.c.summary.response_pages_count, one.c.summary.tables_count, one.m, one.e, one.p, one.d) == ("H\n\nT", 3, 1, "hi", "bad", "plain", "Erro desconhecido.")
    assert (one.c.summary.response_page_indices, one.c.summary.usage_info) == ([0, 1], '{"pages":2}')
    assert [(b.text, b.confidence, b.box) for b in one.b] == [("a", 0.5, None), ("b", 0.0, None)]
    legacy = '[[[[0,1],[4,1]],["a",0.9]],[[[0,5],[4,5]],["b",0.8]]]'
    both = spark.range(1).select(engines.boxes_of_legacy_lists(F.lit(legacy)).alias("x"), engines.boxes_of_legacy_lists(F.lit(f"[{legacy}]")).alias("y"), engines.last_attempts(F.array(*[F.lit(str(i)) for i in range(8)])).alias("l"), engines.last_attempts(F.array(F.lit("1"))).alias("k"), names.optional_flag(F.lit(" ")).alias("f")).first()
    assert [(b.text, b.confidence, b.box) for b in both.x] == [("a", 0.9, [[0.0, 1.0], [4.0, 1.0]]), ("b", 0.8, [[0.0, 5.0], [4.0, 5.0]])] == [(b.text, b.confidence, b.box) for b in both.y]
    assert (both.l, both.k, both.f) == (list("234567"), ["1"], None)
    assert engines.first_working([lambda x: x.missing, lambda x: x + 1], 1) == 2
    waits = []
    answers = iter([(503, ""), (429, ""), (200, "ok")])
    assert engines.with_retries(lambda: next(answers), 3, 0.5, waits.append) == "ok" and waits == [0.5, 1.0]
    fallible = iter([ConnectionError("reset"), TimeoutError("slow"), (200, "ok")])

    def request():
        found = next(fallible)
        if isinstance(found, Exception):
            raise found
        return found

    assert engines.with_retries(request, 3, 0.0, waits.append) == "ok"
    with pytest.raises(RuntimeError, match="no answer: down"):
        engines.with_retries(lambda: (_ for _ in ()).throw(OSError("down")), 2, 0.0, waits.append)
    with pytest.raises(RuntimeError, match="HTTP 400"):
        engines.with_retries(lambda: (400, "bad"), 3, 0.0, waits.append)
    assert engines.first_answer(lambda c: c, ["", "generic", "text"], lambda t: t == "generic") == "text"


def stream_of(spark, tmp_path, batches):
    """Raw pages as files that a stream reads one by one."""
    schema = "doc string, model string, ord int, page string, text string, processing_seconds string, warnings array<string>, metadata map<string,string>, arrived timestamp"
    for i, rows in enumerate(batches):
        made = [(d, "m", ord_, str(p), text, "0.5", ["w"], {"k": text}, None) for d, p, ord_, text in rows]
        spark.createDataFrame(made, schema).withColumn("arrived", F.lit("2024-01-01 00:00:00.123456").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/n={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_stream_equals_batch(spark, tmp_path):
    """Pages that come again within and across batches, in any order: the stream's pages are those of the batch operators, and its state says what is there."""
    import random

    r = random.Random(14)
    batches = [[(r.choice("ab"), r.randrange(6), ord_, r.choice(["", f"text  {ord_}"])) for ord_ in r.sample(range(100 * n, 100 * n + 60), 12)] for n in (2, 0, 1)]
    batches.append(batches[0])  # rows that come again
    stream = stream_of(spark, tmp_path, batches)
    append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    raw = spark.read.schema(stream.schema).parquet(f"{tmp_path}/in/*").dropDuplicates(["doc", "model", "page", "ord"])
    wanted = standardize.last_of_page(standardize.standardize_pages(raw)).orderBy("doc", "page")
    shown = lambda df: [(x.doc, x.page, x.ord, x.text, x.status, x.warnings, x.metadata, x.arrived) for x in df.where("page > 0").orderBy("doc", "page").collect()]
    assert shown(sinks.read_pages(spark, f"{tmp_path}/out")) == shown(wanted)
    state = {(s.doc, s.page): (s.ord, s.filled) for s in resume_state(spark, f"{tmp_path}/cp").collect()}
    last = {}
    for d, p, ord_, text in sum(batches, []):
        last[d, str(p)] = max(last.get((d, str(p)), (-1, False)), (ord_, bool(text)))
    assert state == last
    # nothing new: the query goes on from its checkpoint and adds nothing
    before = sinks.read_pages(spark, f"{tmp_path}/out").count()
    append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sinks.read_pages(spark, f"{tmp_path}/out").count() == before


def test_documents_as_json_lines(spark, tmp_path):
    pages = standardize.standardize_pages(spark.createDataFrame([("d", "m", n, str(n), "text") for n in range(3)], "doc string, model string, ord int, page string, text string"))
    sinks.write_documents(standardize.build_documents(pages), f"{tmp_path}/docs", f"{tmp_path}/copy")
    assert spark.read.json(f"{tmp_path}/docs").first().page_count == 2 == spark.read.json(f"{tmp_path}/copy").first().page_count


def test_results_of_any_shape():
    class Array:
        def tolist(self):
            return [[1, 2, 5, 9]]

    class Answer:
        res = {"rec_texts": ["a"], "rec_scores": ["0.5"], "rec_boxes": Array()}

    line = lambda t, c: [[[0, 1], [4, 1], [4, 3], [0, 3]], [t, c]]
    assert boundary.boxed(Answer()) == [(0, "a", 0.5, 1.0, 2.0, 5.0, 9.0)]
    assert boundary.boxed([[line("a", 0.9), line(" b ", "x")]]) == [(0, "a", 0.9, 0.0, 1.0, 4.0, 3.0), (1, "b", 0.0, 0.0, 1.0, 4.0, 3.0)]
    assert boundary.boxed(line("a", 0.9)) == [(0, "a", 0.9, 0.0, 1.0, 4.0, 3.0)]
    assert boundary.boxed({"texts": ["a", "", "c"], "scores": [1]}) == [(0, "a", 1.0, 0.0, 0.0, 8.0, 10.0), (2, "c", 0.0, 0.0, 40.0, 8.0, 50.0)]
    assert boundary.boxed([[["x"], {"text": "yy", "confidence": 0.25, "bbox": [3, 4, 1, 2]}], None, 7, []]) == [(0, "x", 0.0, 0.0, 0.0, 8.0, 10.0), (0, "yy", 0.25, 1.0, 2.0, 3.0, 4.0)]
    assert boundary.boxed({"res": {"texts": []}, "text": "t"})[0][1] == "t" and boundary.boxed(None) == []


def test_what_results_offer():
    """Each way to hand a result over, the order of two ways, and objects in objects."""
    import types

    of = types.SimpleNamespace
    assert boundary.plain(of(tolist=lambda: [1, 2])) == [1, 2] and boundary.plain(of(item=lambda: 2.5)) == 2.5
    assert boundary.plain(of(res=[3])) == [3] and boundary.plain(of(data=of(res="x"))) == "x"
    assert boundary.plain(of(to_dict=lambda: {"a": 1})) == {"a": 1} == boundary.plain(of(asdict=lambda: {"a": 1}))
    assert boundary.plain(of(json='{"a": [1]}')) == {"a": [1]} == boundary.plain(of(json=lambda: {"a": [1]}))
    assert boundary.plain(of(res=[1], tolist=lambda: [2])) == [2] and boundary.plain(of(json="[1]", data=[3])) == [3]
    assert boundary.plain(of(text="t", _hidden=1)) == {"text": "t"}
    assert [boundary.number(v) for v in ("1.5", None, "x", of(item=lambda: 3))] == [1.5, 0.0, 0.0, 3.0]


def test_corners_of_boxes():
    assert boundary.corners([1, 2, 3, 4]) == [(1.0, 2.0), (3.0, 4.0)] and boundary.corners((5, 6.5)) == [(5.0, 6.5)]
    assert boundary.corners([[1, 2], [3, 4], [5, 6]]) == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]
    assert boundary.corners([[[1, 2]], [[3, 4, 5, 6]]]) == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]
    assert boundary.corners(None) == boundary.corners(7) == boundary.corners([1, 2, 3]) == boundary.corners("ab") == boundary.corners([]) == []
    assert boundary.is_box([[0, 0], [1, 1]]) and not boundary.is_box([[0, 0], "text"]) and not boundary.is_box([])


def test_renderers(spark, tmp_path):
    one = lambda content, dpi: [(dpi, 1, content), (dpi, 2, content)]

    def broken(content, dpi):
        raise OSError("no library")

    assert boundary.render_with_fallback(b"x", 72, {"a": broken, "b": one})[1] == (72, 2, b"x")
    with pytest.raises(RuntimeError, match="a: no library . c: no pages"):
        boundary.render_with_fallback(b"x", 72, {"a": broken, "c": lambda content, dpi: []})
    with pytest.raises(RuntimeError, match="a: no library$"):
        boundary.render_with_fallback(b"x", 72, {"a": broken, "b": one}, " A ")
    with pytest.raises(ValueError, match="unknown page renderer"):
        boundary.render_with_fallback(b"x", 72, {"a": broken}, "z")
    files = spark.createDataFrame([("p", bytearray(b"1")), ("q", bytearray(b"2"))], "path string, content binary")
    images = spark.createDataFrame([("p", "page_0002.jpg", bytearray(b"j2")), ("p", "page_0001.jpg", bytearray(b"j1")), ("p", "page_0001.png", bytearray(b"n"))], "path string, image_file string, image binary")
    got = boundary.rendered_or_reused(files, images, 100, {"b": one}).orderBy("path", "page").collect()
    assert [(r.path, r.page, r.image_file, bytes(r.image), r.reused) for r in got] == [("p", 1, "page_0001.jpg", b"j1", True), ("p", 2, "page_0002.jpg", b"j2", True), ("q", 1, "page_0001.jpg", b"2", False), ("q", 2, "page_0002.jpg", b"2", False)]
    assert boundary.rendered_or_reused(files, None, 100, {"b": one}).count() == 4
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/tool").write_text("")
    assert boundary.tool_folder("tool", ["", f"{tmp_path}/bin/tool"], []) == f"{tmp_path}/bin" == boundary.tool_folder("tool", [], ["/none", f"{tmp_path}/bin"], lambda t: None)
    assert boundary.tool_folder("tool", [], [f"{tmp_path}/bin"], lambda t: "/usr/bin/tool") is None


def test_checks_before_a_run():
    boundary.check_model("m:v2", ["m:v1", ""])
    with pytest.raises(RuntimeError, match="is not available: a"):
        boundary.check_model("m", ["a:1"])
    boundary.check_languages(["por"], ["por", "eng"])
    with pytest.raises(RuntimeError, match="languages x are not available: eng, por"):
        boundary.check_languages(["por", "x"], ["por", "eng"])
    assert [boundary.device(w, a)[0] for w in (None, True, False) for a in (True, False)] == [True, False, True, False, False, False]
    assert boundary.device(True, False)[1]
    assert boundary.tool_command(" x ", "/none", "t") == "x" and boundary.tool_command("", "/none", "t", lambda t: "/b/t") == "/b/t" and boundary.tool_command(None, "/none", "t", lambda t: None) == "t"
    assert boundary.first_constructor(lambda **k: k["b"], [{"a": 1}, {"b": 2}]) == 2
    with pytest.raises(RuntimeError, match="no variant"):
        boundary.first_constructor(lambda **k: k["c"], [{"a": 1}] * 9)


def test_files_to_ranking_and_chart(spark, tmp_path):
    """Documents written as files, found again, rated against a reference file; the report is read back for the chart."""
    pages = standardize.standardize_pages(raw(spark, ("x.pdf", "good", 0, "1", "alpha beta"), ("x.pdf", "good", 1, "2", "gamma"), ("x.pdf", "poor", 0, "1", "alpha"), ("x.pdf", "poor", 1, "2", "delta")))
    docs = standardize.build_documents(pages).withColumns({"source_pdf": F.col("doc"), "file_name": F.col("doc")})
    assert sinks.write_document_files(docs, str(tmp_path / "out"), str(tmp_path / "copy")).count() == 4
    written = json.loads((tmp_path / "out/data/extracted/good_output_x.json").read_text())
    assert written["pages"][0]["text"] == "alpha beta" and written["pages"][0]["error"] is None
    assert (tmp_path / "out/data/extracted/good_output_x.json").read_text().startswith('{\n  "')
    assert (tmp_path / "copy/data/extracted/poor_output_x.json").exists()
    (tmp_path / "ref.json").write_text(json.dumps([{"page": 1, "text": "alpha beta"}, {"page": 2, "text": "gamma"}]))
    board = runs.evaluate_files(spark, str(tmp_path / "ref.json"), root=str(tmp_path / "out"), report_path=str(tmp_path / "report")).orderBy("rank").collect()
    assert [(r.rank, r.model, r.cer) for r in board] == [(1, "good", 0.0), (2, "poor", board[1].cer)] and board[1].cer > 0
    part = next(p for p in (tmp_path / "report").iterdir() if p.name.startswith("part"))
    cells = runs.chart_frames(spark, [str(part)], {"good": "Good"}).collect()
    assert {(c.label, c.position) for c in cells} == {("Good", 1), ("Good", 2), ("poor", 1), ("poor", 2)}
    rows = evaluate.console_page_lines(evaluate.page_metrics(*evaluation(spark))).where("model = 'b'").orderBy("page").collect()
    assert rows[0].line == "   1   0.0000   0.0000        0        0         ok"
    checked = sinks.written(spark.range(3), "test-written")
    assert checked.count() == 3


def test_best_of_a_row_is_best_of_rows(spark):
    """Attempts in one row and in rows of their own give the same, ties and empty texts included."""
    import random

    r = random.Random(9)
    rows = []
    for d in range(300):
        for i in range(r.randint(1, 5)):
            text = r.choice(["", "", "abc", "some more text", None])
            rows.append((d, 0, i, f"m{i}", text, r.choice([0.0, 5.0, 5.0, None]), r.choice([True, False, None]), r.choice([["w"], None, []]), r.choice(["failed", "", None])))
    df = spark.createDataFrame(rows, "doc int, page int, idx int, mode string, text string, score double, suspicious boolean, warnings array<string>, error string")
    arrays = df.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in select.ATTEMPT if c != "idx"]))).alias("a"))
    for tiered in (False, True):
        grouped = {(x.doc): x for x in select.best_attempt(df.withColumn("text", F.coalesce("text", F.lit(""))), tiered=tiered).collect()}
        row = {x.doc: x for x in arrays.withColumn("a", F.transform("a", lambda a: a.withField("text", F.coalesce(a["text"], F.lit(""))))).select("doc", "page", select.best_of(F.col("a"), tiered).alias("b")).select("doc", "page", "b.*").collect()}
        assert {d: tuple(x[c] for c in ("idx", "mode", "text", "score", "suspicious", "warnings", "error")) for d, x in grouped.items()} == {d: tuple(x[c] for c in ("idx", "mode", "text", "score", "suspicious", "warnings", "error")) for d, x in row.items()}


@pytest.mark.parametrize("suspicion", [False, True])
def test_cascade_against_plain_loops(spark, tmp_path, suspicion):
    """Each page goes through the stages until its best attempt so far is acceptable; no text is shuffled between stages."""
    import random

    r = random.Random(10)
    good = "a line of text that is long enough to count\nsecond line here with even more text in it, so that it scores over the limit number "
    said = ["", "short", "the text content " * 9, good + "one", good + "two and longer", "again and again " * 60]
    pages = [(d, 1, [r.randrange(len(said)) for _ in range(4)]) for d in range(200)]
    df = spark.createDataFrame(pages, "doc int, page int, turns array<int>").withColumns({"width": F.lit(1000), "height": F.lit(1000)}).repartition(4)
    texts = F.array(*[F.lit(t) for t in said])

    def stage(i):
        text = texts[F.col("turns")[i]]
        return lambda rows: rows.withColumns({"text": text, "error": F.when(text == "", F.lit(f"e{i}")), "warnings": F.array(F.lit(f"w{i}"))})

    written = []

    def write(rows, name):
        written.append(rows._jdf.queryExecution().executedPlan().toString())
        rows.write.parquet(f"{tmp_path}/{suspicion}-{name}")
        return spark.read.parquet(f"{tmp_path}/{suspicion}-{name}")

    got = {x.doc: x for x in select.cascade(df, [(m, stage(i)) for i, m in enumerate(standardize.PIPELINE)], write, suspicion=suspicion).collect()}
    judged = {x.t: x for x in select.judged(spark.createDataFrame([(t, 1000, 1000) for t in said], "t string, width int, height int").withColumn("text", F.col("t")), suspicion).withColumn("ok", quality.is_acceptable_text(F.col("text"))).collect()}
    for d, _, turns in pages:
        best, warnings, errors = None, [], []
        for i, k in enumerate(turns):
            j = judged[said[k]]
            warnings.append(f"w{i}")
            if not said[k]:
                errors.append(f"{standardize.PIPELINE[i]}: e{i}")
            rank = (bool(said[k]) and not (suspicion and j.suspicious), bool(said[k]), j.score if said[k] else 0.0)
            if best is None or rank > best[0] or not rank[1] and not best[0][1]:
                best = rank, i, said[k], j
            if best[1] == i and j.ok and not j.suspicious:
                break
        x = got[d]
        assert (x.idx, x.mode, x.text, x.score, x.suspicious, x.warnings) == (best[1], standardize.PIPELINE[best[1]], best[2], best[3].score, best[3].suspicious, warnings)
        assert x.error == (" | ".join(errors) if not best[2] else None)
    assert all("Exchange" not in plan for plan in written[1:])


def test_printed_decimals_start_from_the_binary_value(spark):
    board = spark.createDataFrame([("d", 1, "m", 0.03125, 0.20625, 1, 2, 0.0005, 0, 0, 0)], "doc string, rank int, model string, cer double, wer double, char_distance int, word_distance int, total_processing_seconds double, failed_pages_count int, missing_pages_count int, extra_pages_count int")
    values = (0.03125, 0.20625, 1, 2, 0.0005)
    assert evaluate.console_lines(board).first().line.startswith("%-20s %8.4f %8.4f %8d %8d %10.3f" % ("m", *values))
    assert board.select(charts.percent_label(F.col("cer") * 4)).first()[0] == "%.0f%%" % 12.5


def test_heights_are_judged_once(spark):
    rows = [(1, 0, "a long enough text of many words and more of them", False), (1, 1, "x" * 60, False), (2, 0, "", False), (3, 1, "some words that are long enough to count here", True)]
    best = select.best_height(spark.createDataFrame(rows, "doc int, height_idx int, text string, suspicious boolean"), ("doc",), tiered=True)
    assert "Join" not in best._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.doc, r.height_idx) for r in best.collect()] == [(1, 0)]


def test_heat_cells_join_by_document_alone(spark):
    board = spark.createDataFrame([("d", "m", 1), ("d", "n", 2)], "doc string, model string, rank int")
    pages = spark.createDataFrame([("d", "m", 1, 0.5), ("d", "n", 4, 0.1), ("d", "n", 2, 2.0), ("d", "other", 1, 0.0)], "doc string, model string, page int, cer double")
    cells = charts.heat_cells(board, pages)
    assert sorted((r.model, r.position, r.cell) for r in cells.collect()) == [("m", 1, 0.5), ("n", 1, 1.0)]
    assert "Join Inner, (doc" in cells._jdf.queryExecution().optimizedPlan().toString()


def test_equal_texts_stay_out_of_python(spark):
    from folioscope.functions.distance import with_metrics

    rows = with_metrics(spark.createDataFrame([("a b", "a b"), ("a b", "a c"), (None, "x")], "r string, h string"), "r", "h")
    assert "CASE WHEN" in rows._jdf.queryExecution().optimizedPlan().toString().split("char_distance(")[1][:60]
    assert [(r.char_distance, r.word_distance) for r in rows.collect()] == [(0, 0), (1, 1), (1, 1)]


def test_partitions_grow_with_the_rows(spark, tmp_path, monkeypatch):
    from folioscope.plans import queries, records

    rows = spark.range(4000).selectExpr("id div 4 AS l_orderkey", "cast(id % 4 + 1 AS int) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "cast(5 AS double) AS l_quantity", "0.1d AS l_discount")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(queries, "TASK_ROWS", 100)
    for of in (queries.keyed_lines, queries.reading_order_lines, records.heat_matrix, records.any_answer_boxes):
        df = of(spark, str(tmp_path))
        assert df._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1].split("\n")[0].endswith(", 40")


def test_answers_of_a_batch_keep_their_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, '["a", "b"]'), (3, "[]"), (4, '"c"')], "n int, answer string").coalesce(1)
    found = {r.n: r.b for r in rows.select("n", boundary.boxes_of_answer("answer").alias("b")).collect()}
    assert found[1] is None and [b.text for b in found[2]] == ["a", "b"] and found[3] == [] and [b.text for b in found[4]] == ["c"]
