import corpus_pipeline as C
from kairograph.llm import near_copies as N

from .conftest import prose, texts

SF = "/root/testdata/sf0.001"


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_groups(rows):
    """The group of each row, by all pairs."""
    sets, group = [sets_of(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = group[j], group[i]
                group = [a if g == b else g for g in group]
    return group


def slow_kept(rows):
    group = slow_groups(rows)
    return sorted((min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in set(group)), key=str)


def kept(df):
    return sorted((r[0] for r in N.one_of_each(df).select("doc_id").collect()), key=str)


def test_matches_brute_force(docs, clashing, none):
    expected = slow_kept([(r[0], r[1]) for r in texts()])
    assert kept(docs) == expected and kept(clashing) == expected
    assert N.one_of_each(docs).columns == docs.columns
    assert kept(none) == []


def test_the_stage_finds_near_copies(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sorted((r[0] for r in C.near_duplicates(spark, df, SF).select("doc_id").collect()), key=str) == slow_kept(rows)


def test_a_large_group_and_sets_on_the_threshold(spark):
    base = prose(400, 3).split()
    rows = [(i, " ".join([*base[: 5 * i], f"x{i}", *base[5 * i + 1 :]])) for i in range(70)]
    # 8 of 10 and 7 of 9 shingles in common.
    w = [f"w{i}" for i in range(14)]
    rows += [(100, " ".join(w)), (101, " ".join(w[:12])), (200, " ".join(f"v{i}" for i in range(13))), (201, " ".join(f"v{i}" for i in range(11)))]
    assert kept(spark.createDataFrame(rows, "doc_id long, text string")) == slow_kept(rows) == [0, 100, 200, 201]


def test_a_shard_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 4)
    base = prose(300, 3).split()
    rows = [(i, " ".join([*base[: 4 * i], f"x{i}", *base[4 * i + 1 :]])) for i in range(60)]
    # Of one template, but too far from the others and from one another.
    rows += [(100 + i, " ".join(w if k % 12 else f"y{i}" for k, w in enumerate(base))) for i in range(9)]
    assert kept(spark.createDataFrame(rows, "doc_id long, text string")) == slow_kept(rows)


def test_a_long_list_is_joined_by_a_shuffle(spark, monkeypatch):
    from kairograph.llm import simhash

    df = spark.createDataFrame(texts(), "doc_id long, text string, lang string, source string, n_chars long")
    expected = kept(df)
    for module in (N, simhash):
        monkeypatch.setattr(module, "broadcast_if_small", lambda x: x)
    assert kept(df) == expected


def test_no_text_is_shuffled_by_the_choice(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    plan = N.one_of_each(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
