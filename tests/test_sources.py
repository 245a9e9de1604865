"""Places of lines in files that are read in many splits, last lines, stores and tables by campaign."""

import json

import pytest

from tidewheel.sources import sinks, text


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "16", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lines_are_numbered_across_splits(spark, tmp_path, small_splits):
    lines = {f"{name}.txt": [f"{name} {'x' * (7 * i % 90)} {i}" for i in range(n)] for name, n in (("one", 60), ("two", 3), ("three", 25))}
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    found = text.text_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = {(r["path"].rsplit("/", 1)[1], r["line_no"]): r["line"] for r in found.collect()}
    assert got == {(name, i): line for name, rows in lines.items() for i, line in enumerate(rows)}


def test_regions_of_a_file_in_many_splits(spark, tmp_path, small_splits):
    body = []
    for k in range(12):
        body += [f"20240101 & outside {k} \\\\", "\\begin{longtable}", f"20240102 & inside {k} \\\\", "\\end{longtable}"]
    (tmp_path / "t.tex").write_text("\n".join(body))
    cells = text.table_cells(text.text_lines(spark, str(tmp_path / "t.tex")), "path", "line_no", r"\\begin\{longtable\}", r"\\end\{longtable\}", r"^\s*\d{8}\s*&").collect()
    assert sorted(r["cells"][1] for r in cells) == sorted(f"inside {k}" for k in range(12))


def test_the_last_line_of_the_last_file_wins(spark, tmp_path, small_splits):
    first = [{"family": "M0", "sim": i % 5, "lam": float(100 - i)} for i in range(60)]
    (tmp_path / "summaries_a.jsonl").write_text("\n".join(map(json.dumps, first)))
    (tmp_path / "summaries_b.jsonl").write_text("\n".join(json.dumps(x) for x in ({"family": "M0", "sim": 3, "lam": 9.0}, {"family": "M0", "sim": 3, "lam": 1.0})))
    rows = sinks.read_summaries(spark, str(tmp_path / "summaries_*.jsonl"), "family string, sim bigint, lam double", ["family", "sim"]).collect()
    assert {r["sim"]: r["lam"] for r in rows} == {0: 45.0, 1: 44.0, 2: 43.0, 4: 41.0, 3: 1.0}


def test_one_of_two_batches_written_at_once_wins_whole(spark, tmp_path, monkeypatch):
    store = sinks.UnitStore(spark, str(tmp_path / "units"), "k int, v int", ["k"])
    monkeypatch.setattr(sinks.UnitStore, "_next", lambda self: 7)
    for v in (1, 2):
        store.append(spark.createDataFrame([(k, v * (-1) ** k) for k in range(20)], "k int, v int"))
    done = {r["k"]: r["v"] for r in store.done().collect()}
    assert len(done) == 20 and {v * (-1) ** k for k, v in done.items()} in ({1}, {2})


def test_results_of_one_campaign_are_replaced(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "campaign string, lam double")
    sinks.replace_campaigns(make([("a", 1.0), ("a", 2.0), ("b", 3.0)]), str(tmp_path / "r"))
    got = sinks.replace_campaigns(make([("a", 5.0)]), str(tmp_path / "r"))
    assert {(r["campaign"], r["lam"]) for r in got.collect()} == {("a", 5.0), ("b", 3.0)}
