"""Queries on texts use all cores, and shortcuts keep their results."""

import pytest
from pyspark.sql import functions as F

from statloom.functions import html, labels, markup, scores
from statloom.functions import rules as R
from statloom.operators import crawl, extraction, filtering
from statloom.plans import load_all
from statloom.plans.registry import QUERIES
from statloom.session import cut_lineage
from statloom.sources import tables
from statloom.sources.tables import Tables


@pytest.mark.parametrize("view, base", [("html", "part"), ("dumps", "part"), ("api_json", "orders")])
def test_rows_of_one_row_group_are_dealt_over_all_cores(spark, tmp_path, view, base):
    """A file of one row group is one task of the scan; the pages made of it must not be."""
    rows = {
        "part": "CAST(id AS BIGINT) p_partkey, 'Brand#1' p_brand, 'n' p_name, CAST(id % 50 AS INT) p_size, 901.5 p_retailprice",
        "orders": "CAST(id AS BIGINT) o_orderkey, CAST(id AS BIGINT) o_custkey, 1000.5 o_totalprice",
    }[base]
    spark.range(0, 2000, 1, 1).selectExpr(*rows.split(", ")).write.parquet(str(tmp_path / f"{base}.parquet"))
    made = Tables(spark, str(tmp_path), spread=True).view(view)
    sizes = [r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 2000
    assert len(sizes) >= 3 * spark.sparkContext.defaultParallelism and max(sizes) < 200


def test_tasks_grow_with_the_table(spark, tmp_path, monkeypatch):
    """So that the longest of them does not."""
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    rows = "CAST(id AS BIGINT) p_partkey, 'Brand#1' p_brand, 'n' p_name, CAST(id % 50 AS INT) p_size, 901.5 p_retailprice"
    spark.range(0, 2000, 1, 1).selectExpr(*rows.split(", ")).write.parquet(str(tmp_path / "part.parquet"))
    made = Tables(spark, str(tmp_path), spread=True).view("html")
    assert made.rdd.getNumPartitions() == 200 and made.count() == 2000


CLASSED = [
    ('<p class="x valeur y">12 dinars</p>', True), ("<p CLASS='valeur'>12 dinars</p>", True), ("<p class = valeur>12 dinars</p>", True),
    ('<p title="a>b" class="VALEUR">12 dinars</p>', True), ('<p class="valeurs">12 dinars</p>', False), ("<p>valeur class 12</p>", False),
    ('<p data-class="valeur">12 dinars</p>', False), ('<!-- <p class="valeur">12 dinars</p> -->', False),
]


def test_pages_without_the_class_are_skipped_and_others_are_not(spark):
    rows = [(i, "https://www.bct.gov.tn/a", page) for i, (page, _) in enumerate(CLASSED)]
    found = extraction.class_values(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"] for r in found.collect()} == {i for i, (_, wanted) in enumerate(CLASSED) if wanted}


def test_attribute_forms(spark):
    tags = ['<a id="x y">', "<a id='x\"y'>", "<a id=x>", "<a id = x/y b=2>", '<a id="">', "<a data-id=1>", '<a id="x', "<a>", '<a id="x>']
    read = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, t string").select("i", markup.attribute("t", "id").alias("v"))
    assert [r["v"] for r in read.orderBy("i").collect()] == ["x y", 'x"y', "x", "x/y", "", None, None, None, None]


def test_rows_of_a_stream_are_dealt_over_all_cores(spark, tmp_path):
    part = "CAST(id AS BIGINT) p_partkey, 'Brand#1' p_brand, 'n' p_name, CAST(id % 50 AS INT) p_size, 901.5 p_retailprice"
    spark.range(0, 2000, 1, 1).selectExpr(*part.split(", ")).write.parquet(str(tmp_path / "part.parquet"))
    load_all()
    found = QUERIES["T01_observations"].frame(spark, str(tmp_path))
    once = QUERIES["X04_list_items"].frame(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, once.select(*found.columns).collect()), key=repr)
    written = [r["n"] for r in found.groupBy(F.input_file_name()).agg(F.countDistinct("page_id").alias("n")).collect()]
    assert sum(written) == 2000 and max(written) < 200


def test_scores_lower_case_a_text_once(spark):
    """Not once for every term: on long texts that was most of the work of the analyses."""
    made = [
        labels.topic("text", "source"), labels.page_class("text", "url"), scores.context_density("text")["overall_score"],
        scores.data_density("text"), scores.credibility("text"), scores.topic_terms_found("text", "topic"), scores.topic_hits("text", "topic"),
        scores.page_richness("text", "html", "url"),
    ]
    assert [str(c).count("lower(text)") for c in made] == [1] * len(made)
    rows = spark.createDataFrame([("PIB et INFLATION: BCT, BANQUE CENTRALE", "www.INS.tn"), (None, "x"), ("", None)], "text string, source string")
    found = rows.select(labels.topic("text", "source").alias("topic"), scores.context_density("text")["overall_score"].alias("d"), scores.credibility("text").alias("c")).collect()
    assert [(r.topic, r.d is None, r.c) for r in found] == [("monetary_financial", False, "medium"), ("empty_content", True, "low"), ("empty_content", False, "low")]


def test_crawl_ranks_links_in_tasks_that_grow_with_them(spark, monkeypatch):
    """A shuffle of few bytes is put into few tasks, however many links it holds."""
    pairs = [(f"s{k % 20}", f"s{(k * 7 + k // 20) % 20}") for k in range(200)] + [(None, "s1"), ("s2", None), ("s3", "s4"), ("s3", "s4")]
    links = spark.createDataFrame(pairs, "src_url string, dst_url string")
    starts = spark.createDataFrame([("x", "s0"), ("y", "s1")], "site string, url string")
    few = sorted(tuple(r) for r in crawl.crawl(links, starts).collect())
    monkeypatch.setattr(crawl, "TASK_LINKS", 10)
    assert crawl.ranked_links(crawl.dealt_links(links)).rdd.getNumPartitions() == 21
    assert sorted(tuple(r) for r in crawl.crawl(links, starts).collect()) == few and len(few) > 10


def test_crawl_does_not_broadcast_links(spark, monkeypatch):
    """Nor the visited pages: their estimated size is no bound."""
    plans = []
    monkeypatch.setattr(crawl, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut_lineage(df))
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src_url string, dst_url string")
    found = crawl.crawl(links, spark.createDataFrame([("x", "a")], "site string, url string"))
    assert sorted(tuple(r) for r in found.collect()) == [("x", "a", 0), ("x", "b", 1), ("x", "c", 2)]
    joined = [p for p in plans if "Join" in p]
    assert len(joined) == 2 and not any("Broadcast" in p for p in joined)


def test_hidden_parts_are_dropped_once_a_page(spark):
    """Once from the page and once from what remains without noise."""
    pages = spark.createDataFrame([(1, "http://a.org", "<p>x</p>")], "page_id long, url string, html string")
    plan = extraction.all_methods(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</script") == 2 * markup.HIDDEN.count("</script")


def test_validated_confidence_is_not_copied_into_the_filter(spark):
    obs = spark.createDataFrame([("PIB", 1.0, "md", 2020, "PIB: 1")], "indicator_name string, value double, unit string, year int, raw_text string")
    valid = filtering.strict_validation(obs, raw_text="raw_text").filter("reject_reason IS NULL").select("strict_confidence")
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert all(len(line) < 1500 for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter"))


def test_texts_without_a_sign_are_left_as_they_are(spark):
    texts = ["", "a &amp; b", "a > b", "<b>a</b> &lt;i&gt;", "x < y", "<!-- gone -->z", "<script>no", "&amp;lt;", "plain", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", html.page_text("t").alias("a"), html.page_text(F.concat("t", F.lit(""))).alias("b"), html.without_noise("t").alias("c"))
    assert [r.a for r in found.orderBy("i").collect()] == ["", "a & b", "a > b", "a <i>", "x < y", "z", "", "&lt;", "plain", None]
    assert all(r.a == r.b for r in found.collect())
    assert [r.c for r in found.orderBy("i").collect()] == ["", *texts[1:5], "z", "", *texts[7:]]


def test_words_of_patterns_leave_no_match_out(spark, monkeypatch):
    """Random texts made of the words, numbers and signs of the patterns, with letters that only ignoring case makes equal."""
    import random

    r = random.Random(11)
    words = sorted({w for listed in extraction._WORDS.values() for w in listed if w})
    pieces = words + [w.upper() for w in words] + ["ınflation", "İnflatİon", "claſſ", "popUlation", "Réserves", "Taux de Chômage", "md", "MDT", " millions", " habitants", "%", "usd", ": ", " = ", "-", '"', ">", "<", "12,5", "3.4", "1 200", "2021", "e5", " ", "name", "<td>taux x</td><td>12</td>", '"date": "2021", "value": 3.5']
    texts = spark.createDataFrame([(i, "".join(r.choice(pieces) for _ in range(r.randint(1, 14)))) for i in range(3000)], "i int, t string").cache()
    sets = {
        "text": (extraction._numbered(R.TEXT_PATTERNS), True), "bank": (extraction._numbered(R.BANK_PATTERNS), True),
        "finance": (extraction._numbered(R.FINANCE_PATTERNS), True), "generic": ([(i, (p, g)) for i, (p, g) in enumerate(R.GENERIC_PATTERNS)], True),
        "gov": ([(i, (p.lower(), 1)) for i, p in enumerate(R.GOV_PATTERNS)], False),
    }

    def found():
        cols = [extraction._matches("t" if fold else F.lower("t"), p, lambda v: v, ignore_case=fold).alias(name) for name, (p, fold) in sets.items()]
        return texts.select("i", *cols).orderBy("i").collect()

    guarded = found()
    monkeypatch.setattr(extraction, "_WORDS", {})
    assert guarded == found()
    assert all(any(row[name] for row in guarded) for name in sets)
