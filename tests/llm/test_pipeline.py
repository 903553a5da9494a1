import pytest

import corpus_pipeline as C
from kairograph.llm import language, pii

from .test_decontaminate import slow
from .test_near_copies import slow_kept
from .test_pii import slow as spans


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs.toPandas())]
    for name, f in C.STAGES:
        docs = f(spark, docs, sf)
        out.append((name, docs.toPandas()))
    return out


def test_columns(stages):
    first = list(stages[0][1].columns)
    assert all(list(t.columns) == first for _, t in stages[:-1]) and len(C.STAGES) == 5


def test_clean_documents_stay_and_others_go(spark, stages):
    tables = dict(stages)
    model = language.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    letters = language._Letters()
    kept = {i for i, t in zip(tables["documents"]["doc_id"], tables["documents"]["text"]) if model.predict(t.encode(), letters)[2] >= language.LEAST_COVERAGE}
    assert set(tables["language"]["doc_id"]) == kept and len(kept) >= 0.98 * len(tables["documents"])
    rows = list(zip(tables["language"]["doc_id"], tables["language"]["text"]))
    assert sorted(tables["near_duplicates"]["doc_id"], key=str) == slow_kept(rows)
    bench = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    clean = {i for i, t in zip(tables["near_duplicates"]["doc_id"], tables["near_duplicates"]["text"]) if not slow(t, bench)[-1]}
    assert set(tables["decontamination"]["doc_id"]) == clean


def test_texts_are_redacted_and_encoded(stages):
    tables = dict(stages)
    assert set(tables["personal_data"]["doc_id"]) == set(tables["decontamination"]["doc_id"]) == set(tables["sentencepiece"]["doc_id"])
    before = dict(zip(tables["decontamination"]["doc_id"], tables["decontamination"]["text"]))
    for i, t, n in zip(tables["personal_data"]["doc_id"], tables["personal_data"]["text"], tables["personal_data"]["n_chars"]):
        assert not spans(t) and n == len(t) and (bool(spans(before[i])) or t == before[i])
    assert tables["sentencepiece"]["round_trip"].all() and (tables["sentencepiece"]["n_pieces"] > 0).all()


def test_run_gives_the_last_stage(spark, stages):
    out = C.run(spark, "/root/testdata/sf0.001").toPandas()
    last = stages[-1][1]
    assert sorted(out["doc_id"]) == sorted(last["doc_id"])
    assert {i: list(x) for i, x in zip(out["doc_id"], out["ids"])} == {i: list(x) for i, x in zip(last["doc_id"], last["ids"])}


def test_stages_take_any_documents(spark, docs, none):
    for _, f in C.STAGES:
        assert f(spark, none, "/root/testdata/sf0.001").count() == 0
        assert f(spark, docs, "/root/testdata/sf0.001").count() <= docs.count()


def test_kinds_are_listed():
    assert pii.BASE == ("email", "ip", "card", "phone")
