import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.llm import language as L
from kairograph.llm import toxicity as X

from .conftest import texts


@pytest.fixture(scope="module")
def real(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    return read("documents"), read("labels")


def test_bloom_filter_returns_all_languages():
    grams = {x: np.arange(i * 500, i * 500 + 1000, dtype=np.uint64) * np.uint64(2654435761) for i, x in enumerate("abc")}
    f = L.Filter(list("abc"), grams)
    masks = f.masks(grams["b"])
    assert all(int(m) & 2 for m in masks[:, 0]) and all(int(m) & 1 for m in masks[:500, 0]) and all(int(m) & 4 for m in masks[500:, 0])
    fresh = (np.arange(20_000, dtype=np.uint64) + np.uint64(10**9)) * np.uint64(40503)
    assert abs(f.counts(fresh)).max() < 0.02 * len(fresh)
    many = L.Filter([str(i) for i in range(130)], {str(i): np.arange(i, i + 1, dtype=np.uint64) for i in range(130)})
    assert int(np.argmax(many.counts(np.full(10, 129, np.uint64)))) == 129


def test_held_out_accuracy(spark, real):
    docs, _ = real
    rows = L.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows) and len(rows) > 250
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_the_fold_are_not_learned(real):
    docs, _ = real
    held = L.fold(F.col("doc_id"), 3) == 1
    a = L.fit(docs)
    b = L.fit(docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))))
    assert a.languages == b.languages and (a.slots == b.slots).all()


def test_language_cases(docs, none, clashing, real):
    model = L.fit(real[0])
    got = {(r["doc_id"], r["text"]): r for r in L.identify(docs.withColumn("t", F.col("text")), model, "t").collect()}
    assert len(got) == len({(r[0], r[1]) for r in texts()})
    for (_, t), r in got.items():
        assert (r["lang_pred"] == "und") == (not any(ch.isalpha() for ch in t or "")), t
    assert L.identify(none, model).count() == 0 and L.identify(clashing, model).count() == len(texts())
    assert L.fit(none).languages == [] and {r["lang_pred"] for r in L.identify(docs, L.fit(none)).collect()} == {"und"}


def test_toxic_documents_are_found(spark, real):
    docs, labels = real
    rows = X.query(spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = [a["score"] > b["score"] for a in held if a["toxic"] for b in held if not b["toxic"]]
    assert np.mean(right) > 0.95
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9


def test_toxicity_cases(docs, none, clashing, real):
    model = X.fit(*real)
    rows = X.score(docs, model).collect()
    assert len(rows) == len(texts()) and len({r["score"] for r in rows if not r["text"]}) == 1
    assert X.score(none, model).count() == 0 and X.score(clashing, model).count() == len(texts())
    empty = X.fit(none, real[1].limit(0))
    assert {r["score"] for r in X.score(docs, empty).collect()} == {0.5}
    one = X.fit(docs, real[1].limit(0).union(real[1].where("toxic = 0").limit(3)))
    assert X.score(docs, one).count() == len(texts())


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    f = X.boost(x, y, trees=30)
    assert ((f.margin(x) > 0) == y).mean() > 0.98
    knots, rates = X.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert rates.tolist() == [0.0, 0.5, 1.0] and (np.diff(knots) > 0).all()


def test_features_of_obfuscated_words():
    lexicon = {b"idiot": 5.0}
    at = {n: i for i, n in enumerate(X.FEATURES)}
    for text in (b"you id1ot", b"an i.d.i.o.t here", b"i d i o t"):
        assert X.features(text, lexicon, 1.0)[at["hidden_hits"]] >= 1, text
    row = X.features(b"you IDIOT!!", lexicon, 1.0)
    assert row[at["near_second_person"]] == 1 and row[at["capital_words"]] > 0 and row[at["exclamations"]] > 0
    assert X.features(b"", lexicon, 1.0) == X.features(None, lexicon, 1.0)
