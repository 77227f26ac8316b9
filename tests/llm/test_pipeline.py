import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from statloom.llm import packing
from tests.conftest import FOLDER
from tests.llm.helpers import clashing, documents, empty, rows
from tests.llm.test_jaccard import brute as near_groups
from tests.llm.test_secrets import brute as secret_digest
from tests.llm.test_substrings import brute as repeats


def test_stages_match_brute_force_one_after_another(spark):
    docs = documents(spark, [(800, "token = abcdefghijklmnop1234 and more words than that")])
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, FOLDER)
    assert clean.columns == docs.columns and 0 < clean.count() <= len(rows()) + 1  # labels of the given tables meet these ids
    single = stages["near duplicates"](spark, clean, FOLDER)
    table = [tuple(r) for r in clean.collect()]
    least = {i: c for i, _, c in near_groups(table, 5, 80) if i is not None}
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == sorted({i for i, c in least.items() if i == c})
    cut = stages["repeated substrings"](spark, single, FOLDER)
    want = {r[0]: r[4] for r in repeats([tuple(r) for r in single.collect()]) if r[0] is not None}
    got = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in cut.collect() if r.doc_id is not None}
    assert got == want
    masked = stages["secrets"](spark, cut, FOLDER)
    assert masked.columns == docs.columns and masked.count() == cut.count()
    assert [r for r in secret_digest([tuple(r) for r in masked.collect()]) if r[1] or r[2]] == []
    packed = stages["packing"](spark, masked, FOLDER)
    encode = packing.encoder(packing.vocabulary_path(), packing.vocabulary_path(packing.RANKS)).encode
    assert packed.agg({"length": "sum"}).first()[0] == sum(len(np.frombuffer(encode(r.text or ""), dtype="<u4")) + 1 for r in masked.collect())


def test_run_on_given_tables(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")] and out.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "repeated substrings", "secrets", "packing"]


def test_stages_keep_columns_named_like_their_own(spark):
    odd = ["__doc", "__key", "__chunk", "__blob", "__found", "__id", "__content", "__mark"]
    docs = clashing(documents(spark, [(801, "password = abcdefghijklmnop1234 and so on")]))
    docs = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(odd)])
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "near duplicates", "repeated substrings", "secrets"):
        out = stages[name](spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert [tuple(r) for r in out.select(*odd).distinct().collect()] == [tuple(range(len(odd)))], name
        if name != "toxicity":  # there the text decides, whatever the id
            assert out.filter("doc_id IS NULL").count() == 2, name
    assert "[secret]" in out.filter("doc_id = 801").first().text


def test_stages_take_an_empty_table(spark):
    stages = dict(corpus_pipeline.STAGES)
    for name in ("near duplicates", "repeated substrings", "secrets", "packing"):
        assert stages[name](spark, empty(spark), FOLDER).count() == 0, name


def test_stages_make_workers_give_freed_memory_back(spark):
    """A stage can be called alone, so each prepares the workers."""
    wanted = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}

    def seen(frames):
        import os

        import pyarrow as pa

        for frame in frames:
            yield frame.assign(pool=pa.default_memory_pool().backend_name, **{n: os.environ.get(n, "") for n in wanted})

    environment = spark.sparkContext.environment
    for name in ("near duplicates", "repeated substrings", "packing"):
        for key in wanted:
            environment.pop(key, None)
        dict(corpus_pipeline.STAGES)[name](spark, empty(spark), FOLDER)
        found = spark.range(1).mapInPandas(seen, "id long, pool string, " + ", ".join(f"{n} string" for n in wanted)).first().asDict()
        assert found["pool"] == "system" and {n: found[n] for n in wanted} == wanted, name
