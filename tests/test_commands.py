"""The commands on result files, and the whole console report."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope import __main__ as commands
from folioscope.operators import select


@pytest.fixture
def files(tmp_path):
    pages = ["The first page of the text.", "And the second one, which is longer."]
    whole = lambda texts: [{"page": n, "text": t} for n, t in enumerate(texts, 1)]
    (tmp_path / "truth.json").write_text(json.dumps(whole(pages)))
    folder = tmp_path / "data" / "extracted"
    folder.mkdir(parents=True)
    (folder / "good_output_truth.json").write_text(json.dumps({"model": "good", "pages": whole(pages)}))
    (folder / "weak_output_truth.json").write_text(json.dumps({"model": "weak", "pages": [{"page": 1, "text": "The frst page of text.", "processing_seconds": 1.25}, {"page": 7, "text": "", "error": "down"}]}))
    return tmp_path


def test_evaluate_prints_the_whole_report(spark, files, capsys, monkeypatch):
    monkeypatch.setattr("sys.argv", ["folioscope", "evaluate", str(files / "truth.json"), "--root", str(files), "-o", str(files / "report"), "--show-pages"])
    commands.main()
    lines = capsys.readouterr().out.split("\n")
    assert lines[0] == "Referencia: truth.json | paginas=2 | chars=64 | words=13"
    assert lines[1] == "" and lines[2] == f"{'Modelo':<20} {'CER':>8} {'WER':>8} {'DistC':>8} {'DistW':>8} {'Tempo(s)':>10} {'Falhas':>8} {'Faltantes':>10} {'Extras':>8}" and lines[3] == "-" * 97
    assert lines[4] == f"{'good':<20} {'0.0000':>8} {'0.0000':>8} {0:>8} {0:>8} {'0.000':>10} {0:>8} {0:>10} {0:>8}"
    assert lines[5].startswith("weak ") and lines[5].endswith(f"{'1.250':>10} {1:>8} {1:>10} {1:>8}")
    assert lines[6:9] == ["", "[good]", f"{'Pag':>4} {'CER':>8} {'WER':>8} {'DistC':>8} {'DistW':>8} {'Status':>10}"] and lines[9] == "-" * 56
    assert lines[10] == f"{1:>4} {'0.0000':>8} {'0.0000':>8} {0:>8} {0:>8} {'ok':>10}" and lines[13] == "[weak]"
    assert lines[16].endswith("        ok") and lines[17] == f"{2:>4} {'1.0000':>8} {'1.0000':>8} {36:>8} {7:>8} {'missing':>10}" and lines[18:] == [""]
    report = spark.read.json(str(files / "report")).first()
    assert [r.model for r in report.ranking] == ["good", "weak"]
    cells = commands.run(spark, ["chart", str(files / "report"), "-o", str(files / "cells")])
    assert {(r.model, r.position, r.percent) for r in cells.collect()} >= {("good", 1, "0%"), ("weak", 2, "100%")}


def test_evaluate_files_that_are_named(spark, files):
    lines = commands.run(spark, ["evaluate", str(files / "truth.json"), str(files / "data/extracted/good_output_truth.json")]).orderBy("n").collect()
    assert [r.n for r in lines] == [1, 2, 3, 4, 5] and lines[4].line.startswith("good")
    with pytest.raises(Exception, match="gone.json"):
        commands.run(spark, ["evaluate", str(files / "gone.json")])
    with pytest.raises(SystemExit):
        commands.run(spark, ["rate"])


def test_sums_over_bands(spark):
    rows = [(1, 0, "a", "2", 1), (1, 1, "", "9", 9), (1, 2, "b", "x", None), (1, 3, None, "9", 9), (2, 0, "", "1", 1)]
    got = select.merge_bands(spark.createDataFrame(rows, "page int, band int, text string, tables_count string, images_count int"), ("page",), ("tables_count", "images_count")).collect()
    assert [tuple(g) for g in got] == [(1, "a\nb", 2, 2, 1)]
    plain = select.merge_bands(spark.createDataFrame(rows, "page int, band int, text string, tables_count string, images_count int").withColumn("n", F.lit(1)), ("page",))
    assert plain.columns == ["page", "text"]
