import xxhash
from pyspark.sql import functions as F

from kairograph.llm import simhash as S

from .conftest import texts


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    return sorted(((r[0], format(p, "016x"), least[g]) for r, p, g in zip(rows, prints, group)), key=str)


def found(df):
    out = S.near_duplicates(df)
    return sorted(((r["doc_id"], r["f"], r["component_id"]) for r in out.withColumn("f", S.hex16(F.col("simhash"))).collect()), key=str)


def test_matches_brute_force(docs, clashing):
    expected = slow_components([(r[0], r[1]) for r in texts()])
    assert found(docs) == expected
    assert found(clashing) == expected


def test_empty_table(none):
    assert found(none) == []
    assert S.one_of_each(none).count() == 0


def test_one_of_each(docs, clashing):
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r[0] for r in kept.collect()), key=str)
    expected = slow_components([(r[0], r[1]) for r in texts()])
    assert ids == sorted({c for _, _, c in expected}, key=str)
    assert len(S.one_of_each(clashing).columns) == len(clashing.columns)


def test_null_ids_only(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "x y z")], "doc_id long, text string")
    assert S.one_of_each(df).count() == 2


def test_links_against_all_pairs_with_split_shards(spark):
    import random

    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:20]:
        for _ in range(20):
            q = p
            for _ in range(rng.randint(1, 3)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "simhash long")
    from kairograph.llm.components import connected_components

    def parts(shard):
        roots = {r["node"]: r["root"] for r in connected_components(S.fingerprint_links(df, shard=shard)).collect()}
        return {p: roots.get(p, p) for p in signed}

    group = {p: p for p in signed}
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 and group[a] != group[b]:
                x, y = max(group[a], group[b]), min(group[a], group[b])
                group = {k: y if v == x else v for k, v in group.items()}
    assert parts(2048) == group
    assert parts(4) == group


def test_bk_tree():
    tree = S.BKTree()
    values = [0, 1, 3, 7, 255, 256, 1 << 63]
    for v in values + values:
        tree.add(v)
    assert len(tree.values) == len(values)
    assert sorted(tree.within(1, 1)) == [0, 1, 3]
    assert list(S.BKTree().within(1, 2)) == []


def test_components_of_a_chain(spark):
    from kairograph.llm.components import connected_components

    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
