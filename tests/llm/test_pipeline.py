"""The pipeline against its stages' rules, and the registration of its queries."""

import re

import __spark_entry__
import corpus_pipeline
import pytest
from cadence.llm import queries, simhash, toxicity
from tests.conftest import SMOKE_DIR
from tests.llm.test_brute_force import components, passes, plain_pii


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.common.materialise(stage(spark, docs, SMOKE_DIR), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_stages_return_the_columns_of_documents(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.dtypes == before.dtypes, name


def test_toxic_documents_go_and_others_stay(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SMOKE_DIR}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    want = {r.doc_id for r in before.collect() if model.probability(scorer.worst([r.text])[0]) < 0.5}
    assert {r.doc_id for r in after.collect()} == want and 0 < len(want) < before.count()


def test_one_of_each_group_of_copies_stays(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in before.collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (0, 1 << 62)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for _, i in best.values())


def test_one_of_each_component_stays(stages):
    before, after = stages["simhash"]
    want = components({r.doc_id: simhash.fingerprint(r.text) for r in before.collect()})
    assert {r.doc_id for r in after.collect()} == set(want.values())


def test_personal_data_is_gone(stages):
    before, after = stages["pii"]
    old, new = ({r.doc_id: r for r in df.collect()} for df in (before, after))
    assert old.keys() == new.keys()
    for i, r in new.items():
        spans = plain_pii(old[i].text)
        if not spans:
            assert r == old[i]
        assert all(old[i].text[a:b] not in r.text for _, a, b in spans) and r.n_chars == len(r.text)
    assert passes("email", "a@b.c")


def test_packing_holds_every_document(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}


def test_run_applies_the_stages(spark, stages):
    columns = ["doc_id", "start", "length", "ids", "doc_tokens"]
    whole = lambda df: df.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert sorted(map(tuple, whole(corpus_pipeline.run(spark, SMOKE_DIR)))) == sorted(map(tuple, whole(stages["packing"][1].select(*columns))))


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert set(queries.queries()) | {"pipeline"} <= set(names)
    assert [n for n in sorted(int(k[2:].split("_")[0]) for k in queries.queries())] == list(range(1, 14))
