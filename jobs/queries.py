"""The jobs as queries over the given tables, each run twice into one new folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import quality_report, token_archive
from sigtok.plans.catalog import LENGTHS, MEAN_ERRORS, SIGNALS, means_sql
from sigtok.session import work_path


def job1_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds nothing new and adds nothing."""
    target, checkpoint = work_path(spark, "token-archive"), work_path(spark, "token-archive-mark")
    for _ in range(2):
        token_archive.run(spark, f"{sf_dir}/documents.parquet", target, checkpoint)
    return token_archive.read_back(spark, target)


def job2_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run replaces what the first wrote."""
    target = work_path(spark, "quality-report")
    for _ in range(2):
        quality_report.run(spark, f"{sf_dir}/documents.parquet", target)
    return quality_report.read_back(spark, target)


JOB1_SQL = f"""WITH {SIGNALS}, {means_sql(8192, 8048, 16)}, packed AS (
SELECT read_pos, seq, string_agg(printf('%04x', code), '' ORDER BY token) AS codes FROM codes GROUP BY ALL), archived AS (
SELECT s.read_pos, s.n AS num_samples, s.seq::INT AS seq, s.start::BIGINT AS start, s.valid::INT AS valid, s.center, s.half AS scale, p.codes
FROM stats s JOIN packed p ON s.read_pos = p.read_pos AND s.seq = p.seq
UNION ALL SELECT doc_id, 0, NULL, NULL, 0, NULL, NULL, '' FROM documents WHERE coalesce(length(text), 0) = 0)
SELECT a.read_pos, a.num_samples::BIGINT AS num_samples, a.seq, a.start, a.valid, a.center, a.scale, a.codes, 0::BIGINT AS batch, d.source
FROM archived a JOIN documents d ON d.doc_id = a.read_pos"""


def _listed(source: str, section: str, name: str, n: str, figures: dict[str, str], group: str) -> str:
    each = ", ".join(f"{{'figure': '{k}', 'value': round(({v})::DOUBLE, 5)}}" for k, v in figures.items())
    return f"SELECT source, '{section}' AS section, {name} AS name, ({n})::BIGINT AS n, unnest([{each}]) AS f FROM {source} GROUP BY {group}"


def _marks(column: str) -> dict[str, str]:
    return {name: f"quantile_cont({column}, {q})" for name, q in quality_report.MARKS.items()}


_BIN = "CASE WHEN n < 8192 THEN '0-8192' WHEN n < 50000 THEN '8192-50000' WHEN n < 200000 THEN '50000-200000' ELSE '200000-inf' END"
_SECTIONS = [
    _listed("sizes", "input", "'all'", "count(*)", {"reads": "count(*)", "samples": "sum(n)", "windows": "sum(k_chunks)", "short_read_share": "avg((n < 8192)::INT)"}, "source"),
    _listed("sizes", "read_length", "'all'", "count(*)", _marks("n"), "source"),
    _listed("errs", "region", "region", "count(*)", {"mae_pa": "avg(abs(err))", "rmse_pa": "sqrt(avg(err * err))"}, "source, region"),
    _listed("byread", "length_bin", _BIN, "count(*)", {"mean_read_mae": "avg(mae)"}, f"source, {_BIN}"),
    _listed("byread", "read_mae", "'all'", "count(*)", _marks("mae"), "source"),
    _listed("byread", "overall", "'all'", "count(*)", {"mae_pa": "sum(mae * n) / sum(n)", "mae_over_std": "avg(mae / greatest(std, 1e-9::DOUBLE))"}, "source"),
]
JOB2_SQL = f"""WITH {SIGNALS}, {MEAN_ERRORS}, {LENGTHS}, sized AS (SELECT l.*, d.source FROM lens l JOIN documents d ON d.doc_id = l.read_pos),
sizes AS (SELECT read_pos, n, source, CASE WHEN n = 0 THEN 0 WHEN n <= 8192 THEN 1 ELSE 1 + (n - 8192 + 8048 - 1) // 8048 END AS k_chunks FROM sized),
errs AS (SELECT r.*, d.source FROM region r JOIN documents d ON d.doc_id = r.read_pos),
byread AS (SELECT source, read_pos, n, avg(abs(err)) AS mae, stddev_pop(pa) AS std FROM errs GROUP BY ALL),
listed AS ({" UNION ALL ".join(_SECTIONS)})
SELECT section, name, f.figure AS figure, f.value AS value, n, source FROM listed"""

QUERIES = {"job1_token_archive": job1_token_archive, "job2_quality_report": job2_quality_report}
SQL = {"job1_token_archive": JOB1_SQL, "job2_quality_report": JOB2_SQL}
