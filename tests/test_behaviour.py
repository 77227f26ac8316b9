"""Invariants, brute-force comparisons on small fixtures, and streams against batches."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from statloom.functions import urls
from statloom.operators import crawl, extraction, filtering, maintenance, merging, pipeline, records, windows
from statloom.plans import load_all
from statloom.plans.registry import QUERIES
from statloom.session import fresh_dir
from statloom.sources import pages as P
from statloom.sources import payloads
from statloom.streaming import incremental
from tests.conftest import FOLDER

load_all()


def test_filters_partition_their_input(tables):
    obs = tables.view("obs")
    checked = filtering.strict_validation(obs)
    n = obs.count()
    assert checked.filter("reject_reason IS NULL").count() + checked.filter("reject_reason IS NOT NULL").count() == n
    tagged = filtering.period_filter(obs, urls.is_gov_site("source_domain"))
    assert tagged.filter("kept").count() + tagged.filter("NOT kept").count() == n


def test_single_pass_equals_the_separate_methods(tables):
    pages = tables.view("field_pages")
    X = extraction
    base = [X.adjacent_pairs, X.data_blocks, X.bank_patterns, X.piped_lines, X.finance_patterns, X.generic_patterns]
    clean = [X.header_tables, X.list_items, X.text_patterns, X.government_patterns]
    keys = ["page_id", "obs_key", "method", "indicator_name", "value", "unit", "year"]
    apart = merging.union_all(
        [f(pages).select(keys) for f in base]
        + [f(pages).withColumn("obs_key", F.concat(F.lit("clean_"), "obs_key")).select(keys) for f in clean]
    )
    # the separate clean methods trim nothing, the single pass neither
    together = extraction.all_methods(pages).withColumns({"unit": F.trim("unit"), "indicator_name": F.trim("indicator_name")})
    a, b = sorted(map(repr, apart.withColumns({"unit": F.trim("unit")}).collect())), sorted(map(repr, together.select(keys).collect()))
    assert a == b and len(a) > 500
    assert together.groupBy("page_id", "obs_key").count().filter("count > 1").count() == 0


def test_category_report_counts_match_the_validated_rows(tables):
    pages = tables.view("field_pages")
    valid = pipeline.validated(pages).filter("reject_reason IS NULL").groupBy("category", "final_year").count().collect()
    report = {(r["category"], r["year"]): r["n_values"] for r in pipeline.category_report(pages).collect()}
    assert report == {(r["category"], r["final_year"]): r["count"] for r in valid}
    summary = pipeline.page_report(pages).agg(F.sum("valid_output")).first()[0]
    assert summary == sum(report.values())


def test_running_means_by_brute_force(spark):
    rows = [(k, i, f"2024-01-{1 + i % 9:02d} 00:00:{i % 60:02d}", float(i * 7 % 13), i % 3 != 0) for k in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, id int, t string, v double, ok boolean").withColumn("ts", F.col("t").cast("timestamp"))
    got = {(r["k"], r["id"]): r for r in windows.running_means(df, ["k"], "ts", "id", "v", F.col("ok")).collect()}
    rec = {(r["k"], r["id"]): r["recurrent_mean"] for r in windows.recurrent_mean(df, ["k"], "ts", "id", "v", F.col("ok")).collect()}
    for k in (1, 2):
        ordered = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        total, good, n_good, m = 0.0, 0.0, 0, 0.0
        for n, (_, i, _, v, ok) in enumerate(ordered, 1):
            total += v
            if ok:
                good, n_good, m = good + v, n_good + 1, (m * (n - 1) + v) / n
            assert math.isclose(got[(k, i)]["running_mean"], total / n)
            assert math.isclose(got[(k, i)]["running_ok_mean"], good / n_good if n_good else 0.0)
            assert math.isclose(rec[(k, i)], m, abs_tol=1e-9)


def test_overwrite_and_merge_keep_keys_unique(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], "page_id int, obs_key string, value double")
    b = spark.createDataFrame([(1, "x", 9.0), (2, "x", 3.0)], "page_id int, obs_key string, value double")
    assert sorted(map(tuple, merging.overwrite([a, b], ["page_id", "obs_key"]).collect())) == [(1, "x", 9.0), (1, "y", 2.0), (2, "x", 3.0)]
    merged = merging.merge_methods(a, b)
    assert sorted(r["obs_key"] for r in merged.collect()) == ["clean_x", "clean_x", "x", "y"]


def test_recovery_keeps_whole_groups(spark):
    rows = [(1, True), (1, False), (2, False), (2, False)]
    df = spark.createDataFrame(rows, "page_id int, keep boolean")
    kept = sorted(map(tuple, filtering.keep_or_recover(df, ["page_id"], "keep").select("page_id", "recovered").collect()))
    assert kept == [(1, False), (2, True), (2, True)]


def test_crawl_by_brute_force(spark):
    edges = [(f"u{i}", f"u{(i * j) % 30}") for i in range(30) for j in range(2, 9)]
    links = spark.createDataFrame(edges, "src_url string, dst_url string").distinct()
    starts = spark.createDataFrame([("s", "u1")], "site string, url string")
    got = {(r["url"], r["depth"]) for r in crawl.crawl(links, starts, max_depth=4, max_pages=12, per_page=3).collect()}
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    seen, frontier = {"u1": 0}, ["u1"]
    for depth in range(1, 4):
        reached = sorted({d for u in frontier for d in sorted(out[u])[:3]} - set(seen))
        frontier = reached[: max(0, 12 - len(seen))]
        seen.update({u: depth for u in frontier})
    assert got == set(seen.items())


def test_nested_json_walk(spark):
    doc = '{"a": 1, "code": 2, "b": {"c": true, "d": [3, {"e": 4.5, "f": "6"}]}, "empty": {}, "none": null}'
    df = spark.createDataFrame([(1, doc)], "dump_id int, content string")
    got = {r["obs_key"]: r["value"] for r in payloads.nested_numbers(df).collect()}
    assert got == {"a": 1.0, "b_c": 1.0, "b_d_1_e": 4.5}


def test_deep_documents_among_shallow_ones_give_all_leaves(spark, monkeypatch):
    """The depth comes from the data: 40 and 70 levels beside one, brackets inside texts don't count."""
    monkeypatch.setattr(payloads, "CHAIN", 10)

    def deep(n):
        return '{"v":%d,"x":[' % n * n + "1" + "]}" * n

    rows = [(1, '{"a": 1, "t": "[[[{{{ \\" ["}'), (2, deep(20)), (3, deep(35)), (4, None), (5, ""), (6, "[1, 2"), (7, '{"a": {"b": {}}}'), (8, "7")]
    df = spark.createDataFrame(rows, "dump_id int, content string")
    assert [r.n for r in df.select(payloads.nesting("content").alias("n")).collect()] == [1, 40, 70, 0, 0, 1, 3, 0]
    got = {}
    for r in payloads.nested_numbers(df).collect():
        got.setdefault(r.dump_id, []).append((r.obs_key, r.value))
    assert got[1] == [("a", 1.0)] and set(got) == {1, 2, 3}
    for i, n in ((2, 20), (3, 35)):
        assert sorted(got[i]) == sorted(("x_0_" * k + "v", float(n)) for k in range(n))


def test_second_route_reads_escalated_pages_only(spark, tables, monkeypatch):
    seen = []
    second = extraction.second_methods
    monkeypatch.setattr(extraction, "second_methods", lambda pages: seen.append(pages) or second(pages))
    pages = tables.view("mixed_pages")
    pipeline.escalated(pages)
    few = seen[0]
    assert few.count() == 400 < pages.count()
    assert "FileScan" not in few._jdf.queryExecution().executedPlan().toString()


def test_mixed_tables_are_one_narrow_stage(tables):
    plan = extraction.all_methods(tables.view("mixed_pages"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_flat_numbers_reject_years(spark):
    df = spark.createDataFrame([(1, '{"a": 2020, "b": true, "c": "5", "d": -3}')], "dump_id int, content string")
    assert {r["obs_key"]: r["value"] for r in payloads.flat_numbers(df).collect()} == {"json_b": 1.0, "json_d": -3.0}


def test_dump_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(
        '{"task_id":"t1","results":[{"url":"u","content":{"structured_data":{"extracted_values":{"gov_2_7":{"value":3.5,"indicator_name":"x"}}}}}]}'
    )
    row = payloads.read_dumps(spark, str(tmp_path)).first()
    assert (row["dump_id"], row["method"], row["o1"], row["o2"], row["value"]) == ("one.json", "gov", 2, 7, 3.5)


def test_values_are_read_from_a_page(spark):
    body = (
        "<table><tr><td>Taux de change</td><td>3,1</td></tr></table>"
        "<ul><li>Budget: 1.234,5 MD</li></ul><p>Inflation: 6,3 %</p>"
    )
    pages = spark.createDataFrame([(1, "https://x.org/2021", body)], "page_id int, url string, html string")
    rows = {r["obs_key"]: (r["indicator_name"], r["value"], r["unit"], r["year"]) for r in extraction.all_methods(pages).collect()}
    assert rows["table_0_0_0"][:2] == ("Taux de change", 3.1)
    assert rows["clean_list_0_0"] == ("Budget", 1234.5, "MD", 2021)
    assert rows["clean_text_2_0"] == ("Inflation", 6.3, "%", 2021)


def test_validated_records(spark):
    df = spark.createDataFrame([("Inflation", 5.0, "%", 2022)], "indicator_name string, value double, unit string, year int")
    row = records.from_validated(df).first()
    assert (row["category"], row["temporal_context"], row["semantic_quality"]) == ("MONETARY", "2022-validated", 0.8)


def test_dry_run_changes_nothing(tables):
    tasks = tables.view("tasks")
    fixes = maintenance.detect_progress_issues(tasks).filter("is_problematic")
    same, log = maintenance.apply_fixes(tasks, fixes, dry_run=True)
    assert same.exceptAll(tasks).isEmpty()
    assert log.count() == fixes.count()


def test_page_gate_drops_and_keeps_whole_pages(spark):
    df = spark.createDataFrame([(1, "x" * 600000), (2, "  short  "), (3, "y" * 20)], "page_id int, html string")
    got = {r["page_id"]: len(r["html"]) for r in P.gate_pages(df).collect()}
    assert got == {1: 600000, 3: 20}


def test_store_statistics_count_every_file(spark):
    row = QUERIES["A15_store_statistics"].frame(spark, FOLDER).first()
    assert row["files_count"] == 14 and row["total_size"] > 0


def test_stream_restart_adds_only_new_files(spark, tables):
    landing, out, check = (fresh_dir(spark, x) for x in ("landing", "out", "check"))
    pages = tables.pages
    pages.filter("page_id < 25").coalesce(1).write.parquet(landing)

    def run():
        stream = incremental.landed(spark, landing, pages.schema)
        return incremental.extract_incrementally(stream, lambda p: extraction.page_links(p), out, check)

    first = run().count()
    assert run().count() == first
    pages.filter("page_id >= 25").coalesce(1).write.mode("append").parquet(landing)
    both = run()
    assert both.count() == extraction.page_links(pages).count() > first
    assert both.exceptAll(extraction.page_links(pages)).isEmpty()


def test_progress_stream_over_two_batches(spark, tables):
    landing, out, check = (fresh_dir(spark, x) for x in ("landing", "out", "check"))
    events = tables.events
    ok = F.col("event_type") != "error"

    def run():
        return incremental.maintain_progress(incremental.landed(spark, landing, events.schema), "user_id", ok, out, check)

    for part in range(4):
        events.filter(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(landing)
        got = {r["user_id"]: (r["processed"], r["succeeded"]) for r in run().collect()}
    assert len(incremental.snapshots(spark, out)) == 2
    want = events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("s")).collect()
    assert got == {r["user_id"]: (r["n"], r["s"]) for r in want}


@pytest.mark.parametrize("name", ["W01_cap_per_group", "W05_samples", "J09_crawl"])
def test_caps_prune_before_the_shuffle(name, spark):
    if name == "J09_crawl":
        links = spark.createDataFrame([("a", "b")], "src_url string, dst_url string")
        df = crawl.ranked_links(links)
    else:
        df = QUERIES[name].frame(spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double, ok boolean")


def test_running_values_keep_null_keys_and_times(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from statloom.operators import windows

    day = dt.datetime(2024, 1, 1)
    rows = [(1, None, day, 1.0, True), (2, None, None, 3.0, True), (3, 7, None, 5.0, False), (4, 7, day, 7.0, True)]
    frame = _events(spark, rows)
    means = {r.event_id: r.running_mean for r in windows.running_means(frame, ["user_id"], "ts", "event_id", "value", F.col("ok")).collect()}
    assert means == {2: 3.0, 1: 2.0, 3: 5.0, 4: 6.0}
    assert windows.recurrent_mean(frame, ["user_id"], "ts", "event_id", "value", F.col("ok")).count() == 4
    assert windows.progress_tracking(frame, ["user_id"], "ts", "event_id", 5).count() == 4
    assert windows.latest_success(frame, ["user_id"], "ts", "event_id", "user_id", F.col("ok")).count() == 4


def test_one_key_and_day_spreads_over_tasks(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from statloom.operators import windows

    day = dt.datetime(2024, 1, 1)
    frame = _events(spark, [(i, 1, day + dt.timedelta(seconds=i), float(i), True) for i in range(4000)])
    bucketed = windows.bucketed(frame, ["user_id"], "ts", "event_id")
    sizes = [r["count"] for r in bucketed.groupBy("_bucket").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 4000 * 0.6
    out = windows.running_means(frame, ["user_id"], "ts", "event_id", "value", F.col("ok")).filter("event_id = 3999").first()
    assert out.running_mean == sum(range(4000)) / 4000


def test_null_groups_keep_their_rows(spark):
    from statloom.operators import aggregates, filtering, merging

    flagged = spark.createDataFrame([(None, True), (None, False), (1, False), (2, True)], "page_id long, good boolean")
    kept = sorted(map(str, filtering.keep_or_recover(flagged, ["page_id"], "good").collect()))
    assert len(kept) == 3 and any("page_id=None, good=True" in k for k in kept)
    assert filtering.group_flag(flagged, ["page_id"], "good").count() == 4
    results = spark.createDataFrame([(None, "a", True, 0.5, 1.0), ("t", None, False, 0.1, 2.0)], "task_id string, strategy_used string, success boolean, confidence_score double, processing_time double")
    assert sorted((str(r.task_id), r.processed_urls) for r in aggregates.task_metrics(results).collect()) == [("None", 1), ("t", 1)]
    one = spark.createDataFrame([(None, 1)], "k long, v int")
    two = spark.createDataFrame([(None, 2), (3, 4)], "k long, v int")
    got = {(r.k, r.v, r.provenance) for r in merging.first_available(one, two, two.limit(0), "k", ["v"]).collect()}
    assert got == {(None, 1, "primary"), (3, 4, "alternative")}


def test_observation_stream_continues_after_a_restart(spark, tables):
    from statloom.sources.tables import Tables

    landing, out, check = (fresh_dir(spark, x) for x in ("landing", "out", "check"))
    part = tables.part

    def run():
        live = Tables(spark, FOLDER)
        live.set("part", incremental.landed(spark, landing, part.schema))
        return incremental.extract_incrementally(live.view("html"), extraction.list_items, out, check)

    part.filter("p_partkey % 2 = 0").coalesce(1).write.parquet(landing)
    first = run().count()
    part.filter("p_partkey % 2 = 1").coalesce(1).write.mode("append").parquet(landing)
    got = sorted(map(repr, run().select("page_id", "obs_key", "value").collect()))
    assert 0 < first < len(got)
    assert got == sorted(map(repr, extraction.list_items(tables.view("html")).select("page_id", "obs_key", "value").collect()))


def test_all_results_of_a_dump_count(spark):
    one = '{"content":{"structured_data":{"target_indicators":{"a":{"value":1}},"key_figures":{"k":{"value":2}},"tables_data":[{"rows":[{"x":"{\\"value\\":3}"}]}]}}}'
    two = '{"content":{"structured_data":{"target_indicators":{"b":{"value":4},"c":{"value":5}},"tables_data":[{},{"rows":[{"y":"{\\"value\\":6}"}]}]}}}'
    dumps = spark.createDataFrame([(1, f'{{"results":[{one},{{"url":"u"}},{two}]}}'), (2, '{"results":[]}'), (3, "{}")], "dump_id long, content string")
    assert sorted(r.value for r in payloads.all_values(dumps).collect()) == [1, 2, 3, 4, 5, 6]
    counts = {r.dump_id: tuple(r)[1:] for r in payloads.collection_counts(dumps).collect()}
    assert counts == {1: (3, 1, 2, 0), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0)}


def test_crawl_has_no_page_limit_by_default(spark):
    pages = [f"https://s.org/{a}" for a in range(5)]
    links = [("https://s.org", p) for p in pages] + [(p, f"{p}/{b}") for p in pages for b in range(5)]
    links += [(f"{p}/{b}", f"{p}/{b}/{c}") for p in pages for b in range(5) for c in range(5)]
    starts = spark.createDataFrame([("s", "https://s.org")], "site string, url string")
    assert crawl.crawl(spark.createDataFrame(links, "src_url string, dst_url string"), starts, max_depth=4).count() == 1 + 5 + 25 + 125
