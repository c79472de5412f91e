"""Result files: which are opened, how they are written, and what a failed or repeated run leaves."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folioscope.operators import standardize
from folioscope.sources import documents, sinks


def files_opened(df):
    """How many files the scan of a collected plan read."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(int(leaves.apply(i).metrics().apply("numFiles").value()) for i in range(leaves.size()))


@pytest.fixture
def results(tmp_path):
    folder = tmp_path / "data" / "extracted"
    folder.mkdir(parents=True)
    for m in range(4):
        for d in range(5):
            (folder / f"m{m}_output_doc{d}.json").write_text(json.dumps({"model": f"m{m}", "pages": [{"page": 1, "text": f"{m} {d}"}]}))
    return str(tmp_path)


def test_a_filter_opens_only_its_files(spark, results):
    found = documents.discover(spark, results)
    assert found.columns == ["path", "engine", "document", "bytes", "json"] and found.count() == 20
    one = found.where("engine = 'm2'").select("json")
    one.collect()
    assert one.count() == 5 and files_opened(one) == 5
    single = found.where("engine = 'm2' AND document = 'doc3'").select("path", "json")
    assert [os.path.basename(r.path) for r in single.collect()] == ["m2_output_doc3.json"] and files_opened(single) == 1
    small = found.where(F.col("bytes") < 1).select("json")
    assert small.collect() == [] and files_opened(small) == 0
    _, raw = documents.load_documents(found.where("engine = 'm1'"))
    assert {r.model for r in raw.collect()} == {"m1"}


def test_paths_count_once_before_they_are_read(spark, results):
    path = f"{results}/data/extracted/m0_output_doc0.json"
    files = documents.read_files(spark, [path, f"file:{path}", f"file://{path}", path.replace("/data/", "/data/./")])
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert files.count() == 1 and "Exchange" not in plan and "Aggregate" not in plan
    with pytest.raises(Exception, match="m0_output_gone"):
        documents.read_files(spark, [path, f"{results}/data/extracted/m0_output_gone.json"])


def test_names_without_a_document(spark, tmp_path):
    folder = tmp_path / "ocr_models" / "x"
    folder.mkdir(parents=True)
    (folder / "eng_output.json").write_text("[]")
    found = documents.discover(spark, str(tmp_path)).first()
    assert (found.engine, found.document, found.json) == ("eng", "", "[]")


def test_the_driver_holds_no_list_of_many_files(spark, tmp_path):
    folder = tmp_path / "data" / "extracted"
    folder.mkdir(parents=True)
    for i in range(1_100):
        (folder / f"m{i % 100}_output_{i}.json").write_text('{"pages": []}')
    found = documents.discover(spark, str(tmp_path))
    assert len(found.inputFiles()) < 10 and found.agg(F.count_distinct("path"), F.sum("bytes")).first() == (1_100, 14_300)
    one = found.where("engine = 'm7'")
    (folder / "m8_output_8.json").unlink()  # another engine's
    assert one.where("json = '{\"pages\": []}'").count() == 11
    with pytest.raises(Exception, match="m8_output_8.json"):
        found.where("engine = 'm8'").select("json").collect()


def test_files_of_any_name_are_the_same_however_they_are_listed(spark, tmp_path, monkeypatch):
    folder = tmp_path / "ro ot%41ü" / "data" / "extracted"
    (folder / "d_output_x.json").mkdir(parents=True)
    for name in ("m_output_a", "m x_output_b c", "é_output_ü", "p%20_output_q%", "a+b_output_c#d", "_h_output_a", ".h_output_b", "_k=1_output_b", "nb\u00a0x_output_z", "\U0001d54f_output_;@,$", "d_output_x.json/part", "none"):
        (folder / f"{name}.json").write_text(f'["{name}"]\r\n')
    (folder / "empty_output_1.json").touch()
    (folder / "bad_output_1.json").write_bytes(b'\xef\xbb\xbf["\xff"]')
    by_driver = documents.discover(spark, str(tmp_path / "ro ot%41ü"))
    monkeypatch.setattr(documents, "DRIVER_FILES", 2)
    by_task = documents.discover(spark, str(tmp_path / "ro ot%41ü"))
    assert by_task.schema.simpleString() == by_driver.schema.simpleString()
    assert sorted(by_task.collect()) == sorted(by_driver.collect()) and by_task.count() == 10
    assert "BatchEvalPython" in by_task._jdf.queryExecution().toString() and "BatchEvalPython" not in by_driver._jdf.queryExecution().toString()


def made(spark, n, text="tëxt"):
    rows = [(d, "m", p, f"{text} {d} {p}") for d in range(n) for p in (1, 2)]
    pages = standardize.standardize_pages(spark.createDataFrame(rows, "doc int, model string, ord int, text string").withColumn("page", F.col("ord").cast("string")))
    return standardize.build_documents(pages).withColumn("source_pdf", F.concat(F.lit("d"), F.col("doc").cast("string"), F.lit(".pdf")))


def everything(root):
    return sorted(os.path.relpath(os.path.join(at, f), root) for at, _, files in os.walk(root) for f in files if not f.startswith((".", "_")) and ".runs" not in at)


def test_files_appear_when_all_are_written(spark, tmp_path):
    root, extra = f"{tmp_path}/a", f"{tmp_path}/b"
    out = sinks.write_document_files(made(spark, 30).repartition(4), root, extra, run="one").collect()
    names = [f"data/extracted/m_output_d{d}.json" for d in range(30)]
    assert everything(root) == everything(extra) == sorted(names)
    assert sorted(r.path for r in out) == sorted(f"{r}/{n}" for r in (root, extra) for n in names)
    text = open(f"{root}/data/extracted/m_output_d7.json").read()
    assert "tëxt 7 1" in text and text.startswith('{\n  "') and {r.bytes for r in out if r.path.endswith("d7.json")} == {len(text.encode())}
    # a run that was completed is not written again, another one replaces the files
    again = sinks.write_document_files(made(spark, 30, "changed"), root, extra, run="one")
    assert sorted(again.collect()) == sorted(out) and "tëxt 7 1" in open(f"{root}/data/extracted/m_output_d7.json").read()
    sinks.write_document_files(made(spark, 8, "changed"), root, run="two")
    assert "changed 7 1" in open(f"{root}/data/extracted/m_output_d7.json").read() and len(everything(root)) == 30


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    sinks.write_document_files(made(spark, 3), root)
    before = {n: open(f"{root}/{n}").read() for n in everything(root)}
    broken = made(spark, 40, "changed").repartition(4).withColumn("doc", F.when(F.col("doc") == 33, F.raise_error(F.lit("task killed"))).otherwise(F.col("doc")))
    with pytest.raises(Exception, match="task killed"):
        sinks.write_document_files(broken, root, run="r")
    assert {n: open(f"{root}/{n}").read() for n in everything(root)} == before
    assert not [d for d in os.listdir(f"{root}/data") if d.startswith(".staging")]
    sinks.write_document_files(made(spark, 40, "changed"), root, run="r")
    assert len(everything(root)) == 40


def test_moving_can_be_repeated(spark, tmp_path, monkeypatch):
    """Half of the files are moved, then the job stops; the same run goes on from there without writing again."""
    root = str(tmp_path)
    move, calls = sinks._moved, []

    def stops(batches):
        for batch in batches:
            yield from move(iter([batch.slice(0, batch.num_rows // 2)]))
            raise RuntimeError("executor lost")

    monkeypatch.setattr(sinks, "_moved", stops)
    with pytest.raises(Exception, match="executor lost"):
        sinks.write_document_files(made(spark, 20).repartition(2), root, run="r")
    monkeypatch.setattr(sinks, "_moved", move)
    assert 0 < len(everything(root)) != 20 or calls == []
    out = sinks.write_document_files(made(spark, 20, "never written"), root, run="r")
    found = [n for n in everything(root) if n.startswith("data/extracted")]
    assert len(found) == 20 == out.count() and all("tëxt" in open(f"{root}/{n}").read() for n in found)


def test_pages_of_a_batch_replace_themselves(spark, tmp_path):
    pages = spark.createDataFrame([("d", "m", n, n, f"text {n}") for n in range(6)], "doc string, model string, page int, ord int, text string")
    path = str(tmp_path / "pages")
    sinks.append_pages(pages.where("page < 4"), path, "r1", 0)
    sinks.append_pages(pages.where("page >= 4"), path, "r1", 1)
    for _ in range(2):
        sinks.append_pages(pages.where("page >= 4"), path, "r1", 1)
    assert sorted(r.text for r in sinks.read_pages(spark, path).collect()) == [f"text {n}" for n in range(6)]
    sinks.append_pages(pages.where("page = 2").withColumns({"ord": F.lit(9), "text": F.lit("later")}), path, "r2", 0)
    got = {r.page: r.text for r in sinks.read_pages(spark, path).collect()}
    assert len(got) == 6 and got[2] == "later"
