"""Record maintenance and rule overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.operators import maintenance as M
from statloom.plans.oracle import text as lit, with_views
from statloom.plans.q_numbers import _CURRENT, _TOTAL
from statloom.plans.registry import query
from statloom.session import small_table

_TASKS = with_views("tasks")
_PROGRESS = "CASE row_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'null' WHEN 2 THEN '{}' ELSE concat('{\"current\": ', CAST(n_urls AS VARCHAR), '}') END"


@query("M01_default_progress", "row_id:L progress:S", f"""
{_TASKS}, p AS (SELECT row_id, {_PROGRESS} AS x FROM tasks) SELECT row_id, CASE WHEN x IS NULL OR x IN ('null', '{{}}') THEN {lit(M.DEFAULT_PROGRESS)} ELSE x END AS progress FROM p""")
def _(t):
    return M.default_progress(t.view("tasks").withColumn("progress", F.expr(_PROGRESS.replace("VARCHAR", "STRING"))))


@query("M02_backfill_urls", "row_id:L n:I first_url:S", f"""
{_TASKS} SELECT row_id, CASE row_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n, CASE row_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN url END AS first_url FROM tasks""")
def _(t):
    k = F.col("row_id") % 3
    given = t.view("tasks").withColumns({"urls": F.when(k == 0, F.array(F.lit("a"), F.lit("b"))), "url": F.when(k < 2, F.col("url"))})
    return M.backfill_urls(given).select("row_id", F.size("urls").alias("n"), F.get("urls", F.lit(0)).alias("first_url"))


@query("M03_default_metrics", "row_id:L metrics:S", f"{_TASKS} SELECT row_id, coalesce(metrics, '{{}}') AS metrics FROM tasks")
def _(t):
    return M.default_metrics(t.view("tasks"))


@query("M04_progress_struct", "row_id:L current:L total:L percentage:D display:S", f"""
{_TASKS}, p AS (SELECT row_id, {_CURRENT} AS c, {_TOTAL} AS t, progress_current IS NOT NULL OR progress_total IS NOT NULL AS given FROM tasks)
SELECT row_id, CASE WHEN given THEN c END AS current, CASE WHEN given THEN t END AS total, CASE WHEN given THEN round(c / t * 100, 2) END AS percentage, CASE WHEN given THEN c || '/' || t END AS display FROM p""")
def _(t):
    return M.to_progress_struct(t.view("tasks")).select("row_id", "progress.*")


@query("M04_progress_struct_plain", "row_id:L current:L total:L", f"""
{_TASKS} SELECT row_id, CASE WHEN progress_current IS NOT NULL OR progress_total IS NOT NULL THEN CASE WHEN regexp_matches(progress_current, '^-?[0-9]+$') THEN CAST(progress_current AS BIGINT) ELSE 0 END END AS current,
  CASE WHEN progress_current IS NOT NULL OR progress_total IS NOT NULL THEN coalesce(CAST(progress_total AS BIGINT), 0) END AS total FROM tasks""")
def _(t):
    # The plain form reads integers only; other spellings count as missing.
    whole = F.when(F.col("progress_current").rlike("^-?[0-9]+$"), F.col("progress_current")).when(F.col("progress_current").isNotNull(), "0")
    return M.to_progress_struct(t.view("tasks").withColumn("progress_current", whole), clamp=False).select("row_id", "progress.*")


def _issue(name: str) -> str:
    return f"CASE WHEN NOT coalesce(regexp_matches({name}, '^\\s*[+-]?[0-9]+\\s*$'), false) THEN '{name} non convertible en int : ''' || coalesce({name}, 'None') || '''' END"


_ISSUES = f"""d AS (SELECT *, list_filter([CASE WHEN contains(progress_current, '/') THEN 'progress_current contient ''/'' : ''' || progress_current || '''' END,
  CASE WHEN contains(progress_total, '/') THEN 'progress_total contient ''/'' : ''' || progress_total || '''' END, {_issue('progress_current')}, {_issue('progress_total')}], lambda x: x IS NOT NULL) AS issues,
  {_CURRENT} AS c, {_TOTAL} AS t FROM tasks)"""


@query("M05_detect_progress", "row_id:L is_problematic:B issues:S fix_current:S fix_total:S", f"""
{_TASKS}, {_ISSUES} SELECT row_id, len(issues) > 0 AS is_problematic, array_to_string(issues, '; ') AS issues, CASE WHEN len(issues) > 0 THEN c::VARCHAR END AS fix_current, CASE WHEN len(issues) > 0 THEN t::VARCHAR END AS fix_total FROM d""")
def _(t):
    return M.detect_progress_issues(t.view("tasks")).withColumn("issues", F.array_join("issues", "; "))


@query("M06_apply_fixes", "origin:S row_id:L old_current:S old_total:S new_current:S new_total:S", f"""
{_TASKS}, {_ISSUES} SELECT 'log' AS origin, row_id, progress_current AS old_current, progress_total AS old_total, c::VARCHAR AS new_current, t::VARCHAR AS new_total FROM d WHERE len(issues) > 0
UNION ALL SELECT 'task', row_id, NULL, NULL, CASE WHEN len(issues) > 0 THEN c::VARCHAR ELSE progress_current END, CASE WHEN len(issues) > 0 THEN t::VARCHAR ELSE progress_total END FROM d""")
def _(t):
    tasks = t.view("tasks")
    fixes = M.detect_progress_issues(tasks).filter("is_problematic")
    repaired, log = M.apply_fixes(tasks, fixes)
    rows = repaired.select(F.lit("task").alias("origin"), "row_id", F.col("progress_current").alias("new_current"), F.col("progress_total").alias("new_total"))
    return log.withColumn("origin", F.lit("log")).unionByName(rows, allowMissingColumns=True)


@query("M07_missing_columns", "row_id:L status:S priority:I analysis_type:S results:S max_retries:I callback_url:S", f"""
{_TASKS} SELECT row_id, status, priority, 'standard' AS analysis_type, '[]' AS results, 3 AS max_retries, NULL AS callback_url FROM tasks""")
def _(t):
    return M.add_missing_columns(t.view("tasks"))


@query("M08_fill_ids", "row_id:L task_id:S", f"{_TASKS} SELECT row_id, CASE WHEN trim(task_id) = '' THEN sha256(row_id::VARCHAR) ELSE task_id END AS task_id FROM tasks")
def _(t):
    return M.fill_task_ids(t.view("tasks"))


@query("M09_cancel", "row_id:L status:S error:S completed_at:S", f"""
{_TASKS} SELECT row_id, CASE WHEN task_id = 't11' THEN 'cancelled' ELSE status END AS status, CASE WHEN task_id = 't11' THEN {lit(M.CANCEL_MESSAGE)} END AS error,
  strftime(CASE WHEN task_id = 't11' THEN TIMESTAMP '2024-05-01 10:00:00' ELSE completed_at END, '%Y-%m-%d %H:%M:%S') AS completed_at FROM tasks""")
def _(t):
    done = M.cancel_task(t.view("tasks"), "t11", "2024-05-01 10:00:00")
    return done.withColumn("completed_at", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss"))


@query("M10_retention", "event_type:S records:L size_freed:L", """
SELECT event_type, count(*) AS records, sum(length(props)) AS size_freed FROM events WHERE ts < TIMESTAMP '2024-02-01' - INTERVAL 20 DAY GROUP BY event_type""")
def _(t):
    old = M.expired(t.events, "ts", "2024-02-01 00:00:00", 20)
    return old.groupBy("event_type").agg(F.count("*").alias("records"), F.sum(F.length("props")).alias("size_freed"))


@query("M10_file_retention", "files_removed:L size_freed:L")
def _(t):
    return M.expired_files(t.spark, t.folder, "*.parquet", "2100-01-01 00:00:00", 30)


_RULES = {"priority_patterns": R.LINK_PRIORITY, "excluded_patterns": R.LINK_EXCLUDED, "data_indicators": R.RICHNESS_TERMS}
_RULE_ROWS = [(k, i, x) for k, xs in _RULES.items() for i, x in enumerate(xs)]


@query("E01_rule_override", "origin:S rule_key:S ordinal:L item:S", f"""
WITH rules(rule_key, ordinal, item) AS (VALUES {', '.join(f"({lit(k)}, {i}, {lit(x)})" for k, i, x in _RULE_ROWS)}),
up AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'priority_patterns' WHEN 1 THEN 'unknown_key' ELSE 'data_indicators' END AS rule_key, p_partkey AS ordinal, p_name AS item FROM part),
kn AS (SELECT * FROM up WHERE rule_key IN (SELECT rule_key FROM rules))
SELECT 'rules' AS origin, rule_key, ordinal, item FROM rules WHERE rule_key NOT IN (SELECT rule_key FROM kn) UNION ALL SELECT 'rules', rule_key, ordinal, item FROM kn
UNION ALL SELECT 'changed', rule_key, count(*), NULL FROM kn GROUP BY rule_key""")
def _(t):
    rules = small_table(t.spark, ["rule_key", "ordinal", "item"], _RULE_ROWS)
    key = F.when(F.col("p_partkey") % 3 == 0, "priority_patterns").when(F.col("p_partkey") % 3 == 1, "unknown_key").otherwise("data_indicators")
    updates = t.part.select(key.alias("rule_key"), F.col("p_partkey").cast("int").alias("ordinal"), F.col("p_name").alias("item"))
    new, changed = M.override_rules(rules, updates)
    counts = changed.select(F.lit("changed").alias("origin"), "rule_key", F.col("n_items").alias("ordinal"))
    return new.withColumn("origin", F.lit("rules")).unionByName(counts, allowMissingColumns=True)
