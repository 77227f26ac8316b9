"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import advice, labels
from statloom.functions import rules as R
from statloom.functions.common import join_null_safe
from statloom.functions.numbers import size_class
from statloom.operators import aggregates as A
from statloom.operators import coverage as V
from statloom.operators import filtering, maintenance, texts
from statloom.operators import merging as M
from statloom.operators.windows import first_k
from statloom.plans.oracle import has, labels as case_labels, rx, text as lit, with_views
from statloom.plans.q_filters import PERIOD_OUTCOME, VALIDATED_SQL
from statloom.plans.q_joins import CATALOGUE
from statloom.plans.q_scores import ANALYSED_SQL, SCORED_SITES_SQL, analysed, scored_sites
from statloom.plans.q_labels import page_class_sql
from statloom.plans.registry import query
from statloom.functions import urls

_OBS = with_views("obs")
_RESULTS = with_views("results")
_TASKS = with_views("tasks")
_CATEGORY = case_labels("lower(indicator_name)", R.CATEGORY_GROUPS, "OTHER")


def _categorised(t):
    return M.with_category(t.view("obs")).withColumn("is_target_indicator", labels.is_target("indicator_name"))


@query("A01_page_summary", "page_id:L total_values:L categories_found:L target_indicators:L high_quality:L average_confidence:D", f"""
{_OBS} SELECT page_id, count(*) AS total_values, count(DISTINCT {_CATEGORY}) AS categories_found, count(*) FILTER ({has('lower(indicator_name)', R.TARGET_TERMS)}) AS target_indicators,
  count(*) FILTER (confidence_score > 0.8) AS high_quality, avg(confidence_score) AS average_confidence FROM obs GROUP BY page_id""")
def _(t):
    return A.page_summary(_categorised(t))


_REJECTS = """count(*) AS total_input, count(*) FILTER (reject_reason IS NULL) AS valid_output, count(*) FILTER (reject_reason = 'rejected_outside_period') AS outside_period,
  count(*) FILTER (reject_reason = 'rejected_no_year') AS no_year, count(*) FILTER (reject_reason = 'rejected_patterns') AS patterns, count(*) FILTER (reject_reason = 'rejected_validation_error') AS validation_errors"""


@query("A02_reject_summary", "page_id:L total_input:L valid_output:L outside_period:L no_year:L patterns:L validation_errors:L success_rate:D high_rejection:B", f"""
{VALIDATED_SQL}, g AS (SELECT page_id, {_REJECTS} FROM checked GROUP BY page_id UNION ALL SELECT -1, {_REJECTS} FROM checked)
SELECT *, valid_output / total_input * 100 AS success_rate, 100 - valid_output / total_input * 100 > 80 AS high_rejection FROM g""")
def _(t):
    checked = filtering.strict_validation(t.view("obs"))
    whole = A.reject_summary(checked).withColumn("page_id", F.lit(-1))
    return A.reject_summary(checked, ["page_id"]).unionByName(whole)


@query("A02_outcome_counts", "source_domain:S outcome:S n:L", f"""
{_OBS} SELECT source_domain, outcome, count(*) AS n FROM (SELECT source_domain, {PERIOD_OUTCOME} AS outcome FROM obs) GROUP BY ALL""")
def _(t):
    tagged = filtering.period_filter(t.view("obs"), urls.is_gov_site("source_domain"))
    return tagged.groupBy("source_domain", "outcome").agg(F.count("*").alias("n"))


def _line(count: str, reason: str) -> str:
    return f"CASE WHEN {count} > 0 THEN {count} || ' éléments rejetés ({reason})' END"


@query("Q16_validation_warnings", "page_id:L warnings:S", f"""
{VALIDATED_SQL}, g AS (SELECT page_id, {_REJECTS} FROM checked GROUP BY page_id), r AS (SELECT *, (total_input - valid_output) / total_input * 100 AS rate FROM g)
SELECT page_id, array_to_string(list_filter([{_line('outside_period', 'hors période 2018-2025')}, {_line('no_year', 'année non trouvée')}, {_line('patterns', 'patterns non-économiques')},
  CASE WHEN rate > 80 THEN 'Taux de rejet élevé (' || printf('%.1f', rate) || '%) - vérifier la qualité des données source' END], lambda x: x IS NOT NULL), ' | ') AS warnings FROM r""")
def _(t):
    g = A.reject_summary(filtering.strict_validation(t.view("obs")), ["page_id"])
    lines = advice.validation_warnings("outside_period", "no_year", "patterns", "validation_errors", "total_input")
    return g.select("page_id", F.array_join(lines, " | ").alias("warnings"))


@query("A03_confidence_histogram", "page_id:L high:L medium:L low:L categories_found:S samples:S", f"""
{_OBS}, c AS (SELECT *, {_CATEGORY} AS category, row_number() OVER (PARTITION BY page_id ORDER BY o1) AS rn FROM obs)
SELECT page_id, count(*) FILTER (confidence_score > 0.7) AS high, count(*) FILTER (confidence_score > 0.4 AND confidence_score <= 0.7) AS medium, count(*) FILTER (confidence_score <= 0.4) AS low,
  array_to_string(list_sort(list(DISTINCT category)), ',') AS categories_found, string_agg(indicator_name, '|' ORDER BY rn) FILTER (rn <= 3) AS samples FROM c GROUP BY page_id""")
def _(t):
    obs = _categorised(t)
    histogram = A.confidence_histogram(obs).withColumn("categories_found", F.array_join("categories_found", ","))
    listed = F.array_sort(F.collect_list(F.struct("rank", "indicator_name")))
    samples = first_k(obs, ["page_id"], ["o1"], 3).groupBy("page_id").agg(
        F.array_join(F.transform(listed, lambda x: x["indicator_name"]), "|").alias("samples"))
    return join_null_safe(histogram, samples, ["page_id"])


def _joined_map(name):
    return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


_METRICS = """g AS (SELECT task_id, count(*) AS processed_urls, count(*) FILTER (success) AS successful_urls, count(*) FILTER (NOT success) AS failed_urls,
  round(coalesce(avg(confidence_score) FILTER (success), 0), 3) AS average_quality_score, round(sum(processing_time), 2) AS execution_time FROM results GROUP BY task_id),
d AS (SELECT task_id, string_agg(strategy_used || '=' || n, ',' ORDER BY strategy_used) AS strategy_distribution FROM (SELECT task_id, strategy_used, count(*) AS n FROM results GROUP BY ALL) GROUP BY task_id)"""


@query("A04_task_summary", "task_id:S status:S successful_urls:L failed_urls:L average_quality_score:D strategy_distribution:S", f"""
{with_views('results', 'tasks')}, {_METRICS} SELECT g.task_id, status, successful_urls, failed_urls, average_quality_score, strategy_distribution FROM g JOIN d USING (task_id) JOIN tasks ON tasks.task_id = g.task_id""")
def _(t):
    metrics = A.task_metrics(t.view("results")).withColumn("strategy_distribution", _joined_map("strategy_distribution"))
    return metrics.join(t.view("tasks").select("task_id", "status"), "task_id")


@query("A05_task_metrics", "task_id:S processed_urls:L successful_urls:L success_rate:D execution_time:D strategy_distribution:S", f"""
{_RESULTS}, {_METRICS} SELECT task_id, processed_urls, successful_urls, round(successful_urls / processed_urls * 100, 2) AS success_rate, execution_time, strategy_distribution FROM g JOIN d USING (task_id)""")
def _(t):
    return A.task_metrics(t.view("results")).withColumn("strategy_distribution", _joined_map("strategy_distribution"))


@query("A06_combined_analyses", "source:S sources_analyzed:L average_confidence:D average_quality:D dominant_topic:S top_advice:S distribution:S", f"""
{ANALYSED_SQL}, k AS (SELECT * FROM analysed WHERE confidence > 0.3), tc AS (SELECT source, topic, count(*) AS n FROM k GROUP BY ALL),
ac AS (SELECT source, x, count(*) AS n FROM (SELECT source, unnest(advice) AS x FROM k) GROUP BY ALL), ar AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, x) AS rn FROM ac)
SELECT source, count(*) AS sources_analyzed, avg(confidence) AS average_confidence, avg(quality) AS average_quality,
  (SELECT topic FROM tc WHERE tc.source = k.source ORDER BY n DESC, topic LIMIT 1) AS dominant_topic, (SELECT string_agg(x, ' | ' ORDER BY rn) FROM ar WHERE ar.source = k.source AND rn <= 3) AS top_advice,
  (SELECT string_agg(topic || '=' || n, ',' ORDER BY topic) FROM tc WHERE tc.source = k.source) AS distribution FROM k GROUP BY source""")
def _(t):
    a = analysed(t.view("notes")).select("source", "topic", "confidence", "quality", "advice")
    combined = A.combine_analyses(a, ["source"])
    return combined.withColumns({"top_advice": F.array_join("top_advice", " | "), "distribution": _joined_map("distribution")})


_SYNTHESIS = f"""{ANALYSED_SQL.replace('WITH ', 'WITH ' + with_views('results')[5:] + ', ', 1)}, s AS (SELECT (SELECT count(*) FROM results) AS n_results, (SELECT count(*) FROM results WHERE success) AS n_ok,
  count(*) AS n_analyses, avg(quality) AS analysis_quality FROM analysed), o AS (SELECT *, n_ok / n_results AS success_rate, (n_ok / n_results + analysis_quality) / 2 AS overall_score FROM s)"""


@query("A07_synthesis", "n_results:L n_ok:L n_analyses:L success_rate:D analysis_quality:D overall_score:D quality_level:S", f"""
{_SYNTHESIS} SELECT *, CASE WHEN overall_score > 0.8 THEN 'excellent' WHEN overall_score > 0.6 THEN 'good' WHEN overall_score > 0.4 THEN 'acceptable' ELSE 'poor' END AS quality_level FROM o""")
def _(t):
    return A.synthesis(t.view("results"), analysed(t.view("notes")))


@query("A08_crawl_statistics", "page_class:S pages_analyzed:L data_pages:L avg_score:D", f"""
{SCORED_SITES_SQL}, c AS (SELECT score, {page_class_sql('b', 'url')} AS page_class FROM scored)
SELECT page_class, count(*) AS pages_analyzed, count(*) FILTER (score > 0.6) AS data_pages, avg(score) AS avg_score FROM c GROUP BY page_class""")
def _(t):
    pages = scored_sites(t).withColumn("page_class", labels.page_class("body", "url"))
    return pages.groupBy("page_class").agg(
        F.count("*").alias("pages_analyzed"), F.count_if(F.col("score") > 0.6).alias("data_pages"), F.avg("score").alias("avg_score"))


# Rendered dumps, read off the base columns: names that can match and the years in the text.
_YEARS_IN_DUMP = " + ".join(f"CAST(contains(content, '{y}') AS INT)" for y in R.TARGET_YEARS)
_DUMPED = f"""{with_views('dumps')}, {CATALOGUE},
entries AS (SELECT p_partkey AS dump_id, unnest(['inflation ' || lower(p_brand), 'pib par habitant', 'balance commerciale', '', '', 'pib par habitant', 'balance commerciale', 'epargne nationale']) AS n FROM part),
hits AS (SELECT dump_id, category, count(*) AS n_found FROM (SELECT DISTINCT dump_id, n, category, i FROM (SELECT dump_id, n, row_number() OVER () AS i FROM entries) JOIN cat ON contains(n, lower(target_name))) GROUP BY ALL),
cov AS (SELECT d.dump_id, 8 AS total_values, 3 AS recognised_values, CASE WHEN d.dump_id % 2 = 0 THEN 1 ELSE 0 END AS priority_found, {_YEARS_IN_DUMP} AS years_covered,
  (SELECT count(DISTINCT category) FROM hits h WHERE h.dump_id = d.dump_id) AS categories_covered FROM dumps d)"""


@query("A09_target_coverage", "dump_id:L total_values:L recognised_values:L priority_found:L categories_covered:I years_covered:I overall_coverage_percentage:D", f"""
{_DUMPED} SELECT *, categories_covered / 6 * 100 AS overall_coverage_percentage FROM cov""")
def _(t):
    return V.target_coverage(t.view("dumps"))


@query("A09_category_coverage", "dump_id:L category:S n_found:L coverage_percentage:D", f"""
{_DUMPED}, sizes AS (SELECT category, count(*) AS k FROM cat GROUP BY category) SELECT dump_id, category, n_found, n_found / k * 100 AS coverage_percentage FROM hits JOIN sizes USING (category)""")
def _(t):
    return V.category_coverage(t.view("dumps"))


@query("A10_data_quality", "dump_id:L target_score:D unit_score:D temporal_score:D overall_score:D quality_level:S", f"""
{_DUMPED}, s AS (SELECT dump_id, categories_covered / 6 AS target_score, 3 / 8 AS unit_score, years_covered / 8 AS temporal_score FROM cov),
o AS (SELECT *, target_score * 0.5 + unit_score * 0.3 + temporal_score * 0.2 AS overall_score FROM s)
SELECT *, CASE WHEN overall_score > 0.7 THEN 'excellent' WHEN overall_score > 0.5 THEN 'good' WHEN overall_score > 0.3 THEN 'fair' ELSE 'poor' END AS quality_level FROM o""")
def _(t):
    return V.data_quality(V.target_coverage(t.view("dumps")))


@query("A11_target_validation", "dump_id:L targets_found:L categories_with_findings:L invalid_units:S coverage_score:D validation_status:S", """
WITH c AS (SELECT p_partkey AS dump_id, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS k FROM part)
SELECT dump_id, 2 AS targets_found, k AS categories_with_findings, 'md tnd' AS invalid_units, (2 / 27 + k / 6) / 2 AS coverage_score, 'needs_improvement' AS validation_status FROM c""")
def _(t):
    return V.target_validation(t.view("dumps")).withColumn("invalid_units", F.array_join("invalid_units", ","))


@query("Q16_target_advice", "dump_id:L advice:S", f"""
{_DUMPED}, s AS (SELECT *, categories_covered / 6 * 100 AS pct, 3 / 8 AS u, years_covered / 8 AS t FROM cov), o AS (SELECT *, pct / 100 * 0.5 + u * 0.3 + t * 0.2 AS q FROM s),
m AS (SELECT *, (SELECT list(c ORDER BY c) FROM (SELECT DISTINCT category AS c FROM cat WHERE category NOT IN (SELECT category FROM hits h WHERE h.dump_id = o.dump_id))) AS gone FROM o)
SELECT dump_id, array_to_string(list_filter(list_concat(list_concat(CASE WHEN pct < 30 THEN ['⚠️ Couverture TARGET faible (' || printf('%.1f', pct) || '%) - Optimiser l''extraction', '🎯 Créer des extracteurs spécialisés par catégorie TARGET'] ELSE ['✅ Couverture TARGET acceptable (' || printf('%.1f', pct) || '%)'] END,
  list_concat(['📋 Catégories TARGET manquantes: ' || array_to_string(gone, ', ')], list_transform(gone, lambda g: '🔍 Développer patterns pour ' || g))),
  ['📏 Améliorer la détection des RECOGNIZED_UNITS', '🔧 Implémenter la normalisation des unités selon settings',
   CASE WHEN t < 0.3 THEN '📅 Couverture temporelle faible (' || years_covered || '/8 années)' END, CASE WHEN t < 0.3 THEN '🕐 Développer l''extraction de données historiques TARGET_YEARS' END,
   CASE WHEN priority_found = 0 THEN '🤖 Activer le mode ''intelligent'' pour extraction TARGET avancée' END, CASE WHEN priority_found = 0 THEN '🚀 Tester l''analyse LLM pour identifier les TARGET_INDICATORS' END,
   CASE WHEN q <= 0.5 THEN '📈 Qualité globale ' || CASE WHEN q > 0.3 THEN 'fair' ELSE 'poor' END || ' - Optimisations nécessaires' END, CASE WHEN q <= 0.5 THEN '🔄 Réviser les patterns d''extraction pour TARGET_INDICATORS' END,
   '💾 Sauvegarder les TARGET_INDICATORS extraits pour analyse historique', '📊 Créer un dashboard de suivi des TARGET_INDICATORS', '🔄 Programmer extractions régulières selon TARGET_YEARS']), lambda x: x IS NOT NULL), ' | ') AS advice FROM m""")
def _(t):
    q = V.data_quality(V.target_coverage(t.view("dumps")))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in R.TARGETS]), "covered"))
    lines = advice.for_targets("overall_coverage_percentage", missing, "unit_score", "temporal_score", "years_covered", "priority_found", "quality_level")
    return q.select("dump_id", F.array_join(lines, " | ").alias("advice"))


@query("A12_value_counts", "kind:S item:S n:L", f"""
{_OBS} SELECT 'source' AS kind, method AS item, count(*) AS n FROM obs GROUP BY method UNION ALL SELECT 'category', {_CATEGORY}, count(*) FROM obs GROUP BY 2
UNION ALL SELECT 'size', CASE WHEN value > 1000 THEN 'large_number' WHEN value < 1 THEN 'decimal' ELSE 'standard' END, count(*) FROM obs GROUP BY 2""")
def _(t):
    obs = M.with_category(t.view("obs"))
    kinds = {"source": F.col("method"), "category": F.col("category"), "size": size_class("value")}
    return M.union_all([obs.groupBy(c.alias("item")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, c in kinds.items()])


@query("A13_run_quality", "task_id:S quality_score:D", f"""
{_RESULTS}, r AS (SELECT task_id, strategy_used, bool_or(success) AS ok, sum(extraction_count) AS n, sum(processing_time) AS s FROM results GROUP BY ALL)
SELECT task_id, round(sum(CASE WHEN ok THEN 1.0 ELSE 0.0 END + least(n / 15, 1) * 1.5 + CASE WHEN s < 10 THEN 0.5 ELSE 0.0 END), 1) AS quality_score FROM r GROUP BY task_id""")
def _(t):
    return A.run_quality(t.view("results"))


@query("A14_task_counts", "total_tasks:L active_tasks:L recent_tasks:L pending:L running:L completed:L failed:L cancelled:L", f"""
{_TASKS} SELECT count(*) AS total_tasks, count(*) FILTER (status IN ('pending', 'running')) AS active_tasks, count(*) FILTER (created_at >= TIMESTAMP '1999-06-01') AS recent_tasks,
  {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ('pending', 'running', 'completed', 'failed', 'cancelled'))} FROM tasks""")
def _(t):
    return A.task_counts(t.view("tasks"), "1999-06-01 00:00:00")


@query("A15_store_statistics", "files_count:L total_size:L total_tasks:L completed_tasks:L")
def _(t):
    return A.store_statistics(t.spark, t.folder, "*.parquet", t.view("tasks"))


_HOST = "split_part(url, '/', 3)"


@query("A16_endpoint_statistics", "host:S total_requests:L success_rate:D timeout_failure_rate:D fallback_success_rate:D", f"""
{_RESULTS} SELECT {_HOST} AS host, count(*) AS total_requests, count(*) FILTER (success) / count(*) AS success_rate, count(*) FILTER (NOT success AND processing_time > 5) / count(*) AS timeout_failure_rate,
  count(*) FILTER (success AND strategy_used = 'intelligent') / count(*) AS fallback_success_rate FROM results GROUP BY 1""")
def _(t):
    hosted = t.view("results").withColumn("host", urls.authority("url"))
    return A.endpoint_statistics(hosted, ["host"], 5)


@query("A17_performance_report", "host:S total_runs:L success_rate:D average_time:D average_quality:D performance_level:S", f"""
{_RESULTS}, g AS (SELECT {_HOST} AS host, count(*) AS total_runs, avg(success::INT) AS success_rate, avg(processing_time) AS average_time, coalesce(avg(confidence_score) FILTER (success), 0) AS average_quality FROM results GROUP BY 1)
SELECT *, CASE WHEN success_rate > 0.9 AND average_quality > 0.8 THEN 'excellent' WHEN success_rate > 0.7 AND average_quality > 0.6 THEN 'good' ELSE 'needs_improvement' END AS performance_level FROM g""")
def _(t):
    return A.performance_report(t.view("results").withColumn("host", urls.authority("url")), ["host"])


@query("A18_source_survey", "sources:L successful:L total_values:L success_rate:D", f"""
{_RESULTS} SELECT count(*) AS sources, count(*) FILTER (success) AS successful, sum(CASE WHEN success THEN extraction_count ELSE 0 END) AS total_values, count(*) FILTER (success) / count(*) * 100 AS success_rate FROM results""")
def _(t):
    summary = A.outcome_summary(t.view("results"), F.col("success"), F.when(F.col("success"), F.col("extraction_count")).otherwise(0))
    return summary.select(F.col("total").alias("sources"), F.col("passed").alias("successful"), F.col("total_duration").alias("total_values"), "success_rate")


@query("A19_check_summary", "total:L passed:L failed:L success_rate:D total_duration:D", """
SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') / count(*) * 100 AS success_rate, sum(value) AS total_duration FROM events""")
def _(t):
    return A.outcome_summary(t.events, F.col("event_type") != "error", "value")


@query("A20_progress_audit", "total_tasks:L problematic_tasks:L", f"""
{_TASKS} SELECT count(*) AS total_tasks, count(*) FILTER (NOT coalesce(regexp_matches(progress_current, '^\\s*[+-]?[0-9]+\\s*$'), false) OR NOT coalesce(regexp_matches(progress_total, '^\\s*[+-]?[0-9]+\\s*$'), false)) AS problematic_tasks FROM tasks""")
def _(t):
    return A.progress_audit(maintenance.detect_progress_issues(t.view("tasks")))


@query("A21_temporal_coverage", "doc_id:L year:I n_values:L found:S", f"""
{with_views('notes')}, y AS ({' UNION ALL '.join(f"SELECT doc_id, {y} AS year, regexp_extract_all(text, {rx(f'{y}.*?([0-9]+[,.]?[0-9]*)' + chr(92) + 's*(?:%|MD|TND|millions?)')}, 1) AS f FROM notes WHERE contains(text, '{y}')" for y in R.TARGET_YEARS)})
SELECT doc_id, year, len(f) AS n_values, array_to_string(f, '|') AS found FROM y""")
def _(t):
    return texts.years_with_values(t.view("notes")).withColumn("found", F.array_join("found", "|"))


@query("A22_majority_year", "doc_id:L year:I n:L", f"""
{with_views('notes')}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(20(?:1[8-9]|2[0-5]))\\b', 1)) AS y, unnest(range(len(regexp_extract_all(text, '\\b(20(?:1[8-9]|2[0-5]))\\b')))) AS i FROM notes),
c AS (SELECT doc_id, y, count(*) AS n, min(i) AS i FROM m GROUP BY doc_id, y) SELECT doc_id, CAST(y AS INTEGER) AS year, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1""")
def _(t):
    return texts.majority_year(t.view("notes"))


@query("A23_page_reports", "page_id:L domain:S selected_route:S time_limit:I content_length:L extraction_count:L has_valid_content:B", f"""
{_OBS}, n AS (SELECT page_id, count(*) AS k FROM obs GROUP BY page_id), p AS (SELECT *, lower(regexp_extract(trim(url), '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?//([^/?#]*)', 1)) AS host FROM pages)
SELECT page_id, host AS domain, CASE WHEN {has('lower(url)', R.ROUTE_COORD_API)} THEN 'traditional' WHEN {has('host', R.DOMAIN_GOV)} OR {has('lower(url)', R.ROUTE_COORD_DYNAMIC)} THEN 'intelligent' ELSE 'traditional' END AS selected_route,
  CASE {' '.join(f"WHEN contains(host, {lit(p)}) THEN {v}" for p, v in R.DOMAIN_POLICY)} ELSE {R.DOMAIN_POLICY_DEFAULT} END AS time_limit, length(html) AS content_length, coalesce(k, 0) AS extraction_count,
  length(trim(html)) > 50 OR k > 0 AS has_valid_content FROM p LEFT JOIN n USING (page_id)""")
def _(t):
    return A.page_reports(t.pages, t.view("obs"))
