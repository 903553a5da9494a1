import hashlib
import random
import re

import pytest

from kairograph.llm import decontaminate as D

from .conftest import prose, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCH = [
    (1, prose(120, 3)[40:200]),
    (2, "One"),
    (3, "quiet sky and NO one"),
    (4, None),
    (5, "..."),
    (6, prose(30, 77)),
    (7, prose(120, 3)[40:200]),
    (7, prose(120, 5)[:120]),
    (8, "日本語 text"),
]


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s or "")


def slow(text, bench):
    words, hit, items = WORD.findall(lower(text)), set(), set()
    for item, t in bench:
        w = WORD.findall(lower(t))
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                items.add(item)
    digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
    return len(words), len(hit), len(items), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("plan", ["broadcast", "join", "auto"])
def test_matches_brute_force(spark, docs, plan):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = sorted((tuple(r) for r in D.decontaminate(docs, bench, keep=["doc_id"], plan=plan).collect()), key=str)
    assert got == sorted(((r[0], *slow(r[1], BENCH)) for r in texts()), key=str)


@pytest.mark.parametrize("plan", ["broadcast", "join"])
def test_empty_tables_and_clashing_names(spark, docs, none, clashing, plan):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert D.decontaminate(none, bench, plan=plan).count() == 0
    clean = D.decontaminate(docs, bench.limit(0), keep=["doc_id"], plan=plan)
    assert clean.count() == docs.count() and clean.where("n_hit > 0 or contaminated").count() == 0
    out = D.decontaminate(clashing, bench, plan=plan)
    assert len(out.columns) == len(set(out.columns)) and out.count() == docs.count()


def test_every_shared_window_is_found():
    import random

    rng = random.Random(1)
    vocabulary = [f"w{i}".encode() for i in range(6)]  # many ties between hashes
    for _ in range(50):
        item = [rng.choice(vocabulary) for _ in range(20)]
        doc = [rng.choice(vocabulary) for _ in range(60)]
        doc[30:43] = item[4:17]
        n, hit, found = D.Index([("i", b" ".join(item))]).hits([b" ".join(doc)])[0]
        assert n == 60 and set(range(30, 43)) <= set(hit) and found == {"i"}


def test_a_large_benchmark_by_both_plans(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    bench = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 200, 400])))) for i in range(400)]
    rows = [(i, " ".join([*rng.choices(vocabulary, k=30), *bench[i][1].split()[:40], *rng.choices(vocabulary, k=10)])) for i in range(60)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    a, b = (sorted(tuple(r) for r in D.decontaminate(docs, items, keep=["doc_id"], plan=p).collect()) for p in ("broadcast", "join"))
    assert a == b and any(r[-1] for r in a)


def test_broken_text_by_both_plans(spark):
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62206364' AS string) AS text")
    items = spark.sql("SELECT 1L AS item_id, cast(X'61FF62206364' AS string) AS text")
    for plan in ("broadcast", "join"):
        assert [tuple(r)[1:4] for r in D.decontaminate(broken, items, keep=["doc_id"], plan=plan).collect()] == [(2, 2, 1)]


def test_the_index_is_small():
    import tracemalloc

    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(50_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=300)).encode()) for i in range(1900)]  # 4 MB
    tracemalloc.start()
    D.Index(items)
    assert tracemalloc.get_traced_memory()[0] < 80e6
    tracemalloc.stop()
