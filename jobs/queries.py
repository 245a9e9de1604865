"""The jobs as registered queries: each runs twice into one new shared folder and returns what is there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import published_tables, session_inputs
from tidewheel.plans.frames import OBSERVED_SQL
from tidewheel.sources.shared import new_folder


def job1_session_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "session-inputs")
    for _ in range(2):
        session_inputs.run(spark, f"{sf_dir}/events.parquet", out, f"{out}/checkpoint")
    return session_inputs.read_inputs(spark, out)


def job2_published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "published-tables")
    for _ in range(2):
        published_tables.run(spark, f"{sf_dir}/documents.parquet", out)
    return published_tables.read_rows(spark, out).withColumn("cells", F.to_json("cells"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_session_inputs": job1_session_inputs, "job2_published_tables": job2_published_tables}

ORACLE_SQL: dict[str, str] = {
    "job1_session_inputs": f"""
WITH {OBSERVED_SQL},
f AS (SELECT *, CASE WHEN t - lag(t) OVER s < 600000000 THEN 0 ELSE 1 END AS opens FROM ob WINDOW s AS (PARTITION BY campaign, session ORDER BY t, event_id)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY campaign, session ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY campaign, session, grp ORDER BY w DESC, t, event_id) AS rn, count(*) OVER (PARTITION BY campaign, session, grp) AS n_merged FROM g)
SELECT CAST(grp AS BIGINT) AS grp, event_id, t, w, n_merged, campaign, session FROM r WHERE rn = 1
""",
    "job2_published_tables": r"""
WITH d AS (SELECT doc_id, source, sha256(text) AS sha256, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, source, sha256, unnest(lines) AS line, unnest(range(0, len(lines))) AS line_no FROM d),
h AS (SELECT *, 'piped' AS rule, 'r' AS kind, string_split(line, ' | ') AS cells FROM l WHERE contains(line, ' | ')
    UNION ALL SELECT *, 'licence', 'r', [regexp_extract(line, '^Licensed under (?:the )?(.+)\.$', 1)] FROM l WHERE regexp_matches(line, '^Licensed under (?:the )?(.+)\.$')
    UNION ALL SELECT *, 'below_licence', CASE WHEN starts_with(line, 'Licensed under ') THEN 'b' WHEN NOT contains(line, ' ') THEN 'e' ELSE 'r' END, [regexp_extract(line, '^([^ ]+) .* ([^ ]+)$', 1), regexp_extract(line, '^([^ ]+) .* ([^ ]+)$', 2)] FROM l
        WHERE starts_with(line, 'Licensed under ') OR NOT contains(line, ' ') OR regexp_matches(line, '^([^ ]+) .* ([^ ]+)$')),
o AS (SELECT *, CASE WHEN rule = 'below_licence' THEN CASE kind WHEN 'b' THEN line_no WHEN 'e' THEN -1 END WHEN coalesce(line_no - lag(line_no) OVER w > 1, true) THEN line_no END AS opens FROM h WINDOW w AS (PARTITION BY doc_id, source, sha256, rule ORDER BY line_no)),
r AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id, source, sha256, rule ORDER BY line_no RANGE UNBOUNDED PRECEDING) AS region FROM o)
SELECT doc_id, source, sha256, region, line_no, count(*) OVER w AS n_rows, min(len(cells)) OVER w = max(len(cells)) OVER w AS conforms, to_json(cells)::VARCHAR AS cells, rule FROM r WHERE kind = 'r' AND region > -1 WINDOW w AS (PARTITION BY doc_id, source, sha256, rule, region)
""",
}
