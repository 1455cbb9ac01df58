"""Queries of the general data operators (history, incremental processing) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioforge.operators.history import bitemporal_ledger, current_versions, last_snapshot, metadata_updates
from folioforge.operators.incremental import plan_work_items
from folioforge.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every source path with the period for which it was valid, from the bitemporal ledger."""
    snapshots = table(spark, sf_dir, "metadata_snapshots")
    ledger = bitemporal_ledger(metadata_updates(snapshots, digest=True), last_day=last_snapshot(snapshots))
    return current_versions(ledger).select(
        F.col("entity").alias("source_path"),
        F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
        F.coalesce(F.date_format("valid_to", "yyyy-MM-dd"), F.lit("open")).alias("valid_to"),
    )


def p1_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ledger, superseded beliefs included, with the states themselves."""
    snapshots = table(spark, sf_dir, "metadata_snapshots")
    ledger = bitemporal_ledger(metadata_updates(snapshots), last_day=last_snapshot(snapshots))
    return ledger.withColumnRenamed("entity", "source_path")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that each successful run must process, from the ledger of work items."""
    items = plan_work_items(table(spark, sf_dir, "manifest_entries"), table(spark, sf_dir, "sync_runs"))
    return items.filter("status = 'done' and needs_work").select(F.col("done_run").alias("run_no"), "source_path")


def p5_work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger: what became pending when, how many leases it took and which token committed it."""
    items = plan_work_items(table(spark, sf_dir, "manifest_entries"), table(spark, sf_dir, "sync_runs"))
    return items.select("source_path", "enqueued_run", "attempts", "token", "status", "needs_work")


QUERIES = {"p1_found": p1_found, "p1_history": p1_history, "p5_found": p5_found, "p5_work_items": p5_work_items}

SQL = {
    "p1_found": r"""
WITH days AS (SELECT d, row_number() OVER (ORDER BY d) AS n, lead(d) OVER (ORDER BY d) AS nx
              FROM (SELECT DISTINCT snapshot_date AS d FROM metadata_snapshots WHERE snapshot_date IS NOT NULL)),
caps AS (SELECT source_path, snapshot_date AS d, captured_at,
   coalesce(nullif(trim(document_id, E' \t\n\r'), ''), '~') || chr(1) || coalesce(nullif(trim(version, E' \t\n\r'), ''), '~') || chr(1) ||
   array_to_string(list_sort(list_filter(list_transform(map_entries(metadata), lambda e: CASE WHEN e.value IS NULL OR trim(e.value, E' \t\n\r') = '' THEN NULL
      ELSE e.key || chr(2) || trim(e.value, E' \t\n\r') END), lambda x: x IS NOT NULL)), chr(3)) AS st
   FROM metadata_snapshots WHERE source_path IS NOT NULL AND snapshot_date IS NOT NULL),
one AS (SELECT source_path, d, arg_max(st, captured_at) AS st FROM caps GROUP BY 1, 2),
o AS (SELECT source_path, one.d, n, nx, st, lag(n) OVER w AS pn, lag(st) OVER w AS ps FROM one JOIN days ON one.d = days.d
      WINDOW w AS (PARTITION BY source_path ORDER BY one.d)),
g AS (SELECT *, sum(CASE WHEN pn = n - 1 AND ps IS NOT DISTINCT FROM st THEN 0 ELSE 1 END) OVER (PARTITION BY source_path ORDER BY d) AS v FROM o)
SELECT source_path, strftime(min(d), '%Y-%m-%d') AS valid_from, replace(strftime(arg_max(nx, d), '%Y-%m-%d'), '9999-12-31', 'open') AS valid_to
FROM (SELECT source_path, v, d, coalesce(nx, DATE '9999-12-31') AS nx FROM g) GROUP BY source_path, v""",
    "p5_found": r"""
WITH runs AS (SELECT run_no, last_delivery, lag(last_delivery) OVER (ORDER BY run_no) AS prev
              FROM sync_runs WHERE lower(trim(status)) = 'succeeded'),
rows_ AS (SELECT source_path, delivery, entry_id, CAST(trim(indexed_at) AS TIMESTAMPTZ) AS ts,
          coalesce(lower(trim(content_sha256)), '~') || '/' || coalesce(lower(trim(metadata_sha256)), '~') AS st FROM manifest_entries WHERE source_path IS NOT NULL),
st AS (SELECT run_no, source_path, arg_max(st, (ts, delivery, entry_id)) AS now FROM rows_ JOIN runs ON delivery <= last_delivery GROUP BY 1, 2),
pv AS (SELECT run_no, source_path, arg_max(st, (ts, delivery, entry_id)) AS before FROM rows_ JOIN runs ON delivery <= prev GROUP BY 1, 2)
SELECT CAST(st.run_no AS BIGINT) AS run_no, st.source_path FROM st LEFT JOIN pv ON st.run_no = pv.run_no AND st.source_path = pv.source_path
WHERE before IS NULL OR before <> now""",
    "p5_work_items": r"""
WITH r AS (SELECT run_no, row_number() OVER (ORDER BY run_no) AS pos, coalesce(lower(trim(status)) = 'succeeded', false) AS ok, max(last_delivery) OVER (ORDER BY run_no) AS upto
           FROM sync_runs WHERE run_no IS NOT NULL AND last_delivery IS NOT NULL),
r2 AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY run_no), -2147483648) AS seen, max(pos) OVER () AS last_pos,
       min(CASE WHEN ok THEN run_no END) OVER w AS nok, min(CASE WHEN ok THEN pos END) OVER w AS npos FROM r WINDOW w AS (ORDER BY run_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
e AS (SELECT source_path, (CAST(trim(indexed_at) AS TIMESTAMPTZ), delivery, entry_id) AS k, run_no, pos, nok, npos, last_pos,
      coalesce(lower(trim(content_sha256)), '~') || '/' || coalesce(lower(trim(metadata_sha256)), '~') AS st FROM manifest_entries JOIN r2 ON delivery > seen AND delivery <= upto WHERE source_path IS NOT NULL),
i AS (SELECT source_path, nok, min(run_no) AS enqueued_run, coalesce(max(npos), max(last_pos)) - min(pos) + 1 AS attempts, arg_max(st, k) AS st, max(k) AS k FROM e GROUP BY 1, 2),
w AS (SELECT *, arg_max(st, k) OVER (PARTITION BY source_path ORDER BY coalesce(nok, 2147483647) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now,
      arg_max(st, k) OVER (PARTITION BY source_path ORDER BY coalesce(nok, 2147483647) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)
SELECT source_path, CAST(enqueued_run AS BIGINT) AS enqueued_run, CAST(attempts AS BIGINT) AS attempts, CAST(nok AS BIGINT) AS token, CASE WHEN nok IS NULL THEN 'pending' ELSE 'done' END AS status,
  before IS NULL OR before <> now AS needs_work FROM w""",
}
