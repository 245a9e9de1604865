"""The jobs: two runs over growing input, a failed batch, reruns, the command lines; and the tables that they find in texts."""

import json
import os
import re
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from jobs import published_tables, queries, session_inputs
from tidewheel.operators.regions import Rule, numbered_lines, region_rows

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


def in_sql(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in want.fetchall()), key=repr)


def in_spark(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


@needs_data
def test_session_inputs_take_only_what_is_new(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    source, out, checkpoint = str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    late = F.coalesce((F.col("event_id") % 3 == 0) & (F.col("event_type") == "click"), F.lit(False))
    again = events.filter(~late & (F.col("event_type") == "click")).withColumn("value", F.col("value") + 1000).orderBy("event_id").limit(20)
    events.filter(~late).coalesce(2).write.parquet(source)
    first = session_inputs.run(spark, source, out, checkpoint)
    assert first["read"] == events.filter(~late).count() and 0 < first["rebuilt"] <= first["read"]
    before = files_of(f"{out}/inputs")
    events.filter(late).unionByName(again).coalesce(1).write.mode("append").parquet(source)
    second = session_inputs.run(spark, source, out, checkpoint)
    assert second["read"] == events.filter(late).count() + 20
    after = files_of(f"{out}/inputs")
    kept = {f for f in before if "campaign=click" not in f}
    assert kept and all(after.get(f) == before[f] for f in kept) and before.keys() - kept - after.keys()
    whole = events.join(again.select("event_id", F.col("value").alias("v")), "event_id", "left").withColumn("value", F.coalesce("v", "value")).drop("v")
    whole.coalesce(1).write.parquet(str(tmp_path / "whole"))
    want = in_sql(queries.ORACLE_SQL["job1_session_inputs"], events=f"{tmp_path}/whole/*.parquet")
    assert in_spark(session_inputs.read_inputs(spark, out)) == want
    assert session_inputs.run(spark, source, out, checkpoint) == {"read": 0, "rebuilt": 0}
    assert files_of(f"{out}/inputs") == after


@needs_data
def test_session_inputs_mend_a_failed_batch(spark, tmp_path, monkeypatch):
    source, out, checkpoint = f"{DATA}/events.parquet", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    whole, written = session_inputs._overwrite, []

    def fails_once(rows, path, by):
        if path.endswith("inputs") and not written:
            written.append(path)
            raise OSError("the disk is full")
        return whole(rows, path, by)

    monkeypatch.setattr(session_inputs, "_overwrite", fails_once)
    with pytest.raises(PySparkException):
        session_inputs.run(spark, source, out, checkpoint)
    session_inputs.run(spark, source, out, checkpoint)
    assert in_spark(session_inputs.read_inputs(spark, out)) == in_sql(queries.ORACLE_SQL["job1_session_inputs"], events=source)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_jobs_equal_sql(spark, name):
    want = in_sql(queries.ORACLE_SQL[name], events=f"{DATA}/events.parquet", documents=f"{DATA}/documents.parquet")
    settings = {c: spark.conf.get(c, None) for c in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    assert want and in_spark(queries.QUERIES[name](spark, DATA)) == want
    assert settings == {c: spark.conf.get(c, None) for c in settings}


@needs_data
def test_command_lines(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    env = os.environ | {"PYTHONPATH": root}
    config = tmp_path / "tables.json"
    config.write_text(json.dumps({"rules": [{"name": "piped", "row": r" \| ", "cells": r" \| "}]}))
    for args in (["jobs.session_inputs", f"{DATA}/events.parquet", f"{tmp_path}/a", f"{tmp_path}/c"], ["jobs.published_tables", f"{DATA}/documents.parquet", f"{tmp_path}/b", "--config", str(config)]):
        done = subprocess.run([sys.executable, "-m", *args], cwd=root, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert re.search(r"read \d+ (new events|texts)", done.stderr)
    assert list(Path(tmp_path, "a", "inputs").glob("campaign=*/session=*/*.parquet"))
    assert [p.name for p in Path(tmp_path, "b", "rows").glob("rule=*")] == ["rule=piped"]


RULES = [
    Rule("bars", r"\|", cells=r" *\| *"),
    Rule("table", r"^\d+ (\w+)", begin=r"^BEGIN", end=r"^END", rows=2),
    Rule("whole", r"^=.*"),
]
TEXTS = [
    "a | b\nc|d\n\ne | f | g\nh",
    "BEGIN\n1 one\nnoise\n2 two\nEND\n3 three\nBEGIN\n4 four\nBEGIN\n5 five\n6 six\n7 seven",
    "",
    "END\n1 | x\nBEGIN x | y\n8 eight | z",
    "=\n==\n\n=",
    "1 one\n" * 50 + "é | 𝒳",
]


def plain_regions(keys, text):
    """The same by walking the lines."""
    out = []
    for rule in RULES:
        region, last, found = None, None, defaultdict(list)
        for n, line in enumerate(text.split("\n")):
            if rule.begin and re.search(rule.begin, line):
                region = n
            elif rule.begin and re.search(rule.end, line):
                region = None
            elif m := re.search(rule.row, line):
                if not rule.begin:
                    region, last = (region if last == n - 1 else n), n
                if region is not None:
                    found[region].append((n, tuple(re.split(rule.cells, line)) if rule.cells else m.groups() or (line,)))
        for start, rows in found.items():
            conforms = len({len(c) for _, c in rows}) == 1 and rule.rows in (None, len(rows))
            out += [(*keys, rule.name, start, n, cells, len(rows), conforms) for n, cells in rows]
    return out


def test_regions_equal_a_walk_over_the_lines(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[1], "x"), (None, TEXTS[0], "x"), (9, None, "x")]
    texts = spark.createDataFrame(rows, "id int, text string, region string").withColumn("h", F.hash("text"))
    hashes = {r["text"]: r["h"] for r in texts.collect()}
    found = region_rows(numbered_lines(texts, ["id", "h"]), RULES, ["id", "h"])
    got = sorted(((r["id"], r["h"], r["rule"], r["region"], r["line_no"], tuple(r["cells"]), r["n_rows"], r["conforms"]) for r in found.collect()), key=repr)
    assert got == sorted((x for i, t, _ in rows if t is not None for x in plain_regions((i, hashes[t]), t)), key=repr)
    assert region_rows(numbered_lines(texts.limit(0), ["id"]), RULES, ["id"]).collect() == []
    with pytest.raises(PySparkException, match="region of rule table at line 6 does not conform"):
        region_rows(numbered_lines(texts.filter("id = 1"), ["id"]), RULES, ["id"], strict=True).collect()


def test_tables_of_repeated_and_null_rows(spark, tmp_path):
    rows = [(1, "a | b", "s"), (1, "a | b", "s"), (None, "c | d\nLicensed under the X.\nfoo bar baz", None), (2, None, "s"), (3, "", "")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("rule", F.lit("clash")).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        done = published_tables.run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
        assert done == {"texts": 5, "rows": 5, "tallies": 4}
    got = {(r["doc_id"], r["rule"], r["n_rows"], tuple(r["cells"])) for r in published_tables.read_rows(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, "piped", 2, ("a", "b")), (None, "piped", 1, ("c", "d")), (None, "licence", 1, ("X",)), (None, "below_licence", 1, ("foo", "baz"))}


@needs_data
def test_jobs_on_tables_without_rows_or_matches(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.limit(0).write.parquet(str(tmp_path / "none"))
    events.withColumn("ts", F.expr("ts + interval 90 days")).write.parquet(str(tmp_path / "outside"))
    for name, n in (("none", 0), ("outside", events.count())):
        out = str(tmp_path / f"{name}-out")
        assert session_inputs.run(spark, str(tmp_path / name), out, f"{out}/checkpoint") == {"read": n, "rebuilt": 0}
        assert session_inputs.read_inputs(spark, out).count() == 0
    docs = spark.createDataFrame([(1, "s", "no table")], "doc_id bigint, source string, text string")
    docs.write.parquet(str(tmp_path / "plain"))
    docs.limit(0).write.parquet(str(tmp_path / "empty"))
    for name, n in (("plain", 1), ("empty", 0)):
        assert published_tables.run(spark, str(tmp_path / name), str(tmp_path / f"{name}-out")) == {"texts": n, "rows": 0, "tallies": 0}
        assert published_tables.read_rows(spark, str(tmp_path / f"{name}-out")).collect() == []
