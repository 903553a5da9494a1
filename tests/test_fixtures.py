"""Small literal cases, each with its expected rows."""

import math

import pytest
from pyspark.sql import functions as F

from kairograph.operators import graph as G
from kairograph.operators import metrics as M
from kairograph.operators import neighbors as N
from kairograph.operators import partition as P
from kairograph.operators import state as S
from kairograph.operators import targets as T
from kairograph.operators import temporal as W
from kairograph.sources import edges as E
from kairograph.sources import tables


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


@pytest.fixture(scope="module")
def make(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


def test_csv_edges_are_sorted_in_time(spark, tmp_path):
    (tmp_path / "edges.csv").write_text(",src,dst,time,ext_roll\n0,1,2,20,1\n1,0,1,10,0\n")
    out = E.read_dataset(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["src"], r["dst"], r["ts"], r["split"], r["pos"]) for r in out] == [(0, 1, 10, 0, 0), (1, 2, 20, 1, 1)]
    with pytest.raises(FileNotFoundError):
        E.read_dataset(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        E.canonical(spark.createDataFrame([(1, 2)], "src long, x long"))


def test_labels_and_numeric_rows(spark, make, tmp_path):
    out = E.label_rows(make([(0, 9, 2, 0), (2, 19, 1, 7)], "nid long, time long, y int, ext_roll int"))
    assert rows(out) == [(0, 9, 0, 2), (2, 19, 2, 1)]
    (tmp_path / "a.edges").write_text("% comment\nsrc dst w\n1 2 3\n4,5 6\n\n")
    got = E.read_numeric_rows(spark, str(tmp_path / "a.edges"))
    assert sorted(r["cols"] for r in got.collect()) == [[1, 2, 3], [4, 5, 6]]
    assert rows(E.web_edges(got)) == [(1, 2, 1.0, 3), (4, 5, 1.0, 6)]
    nested = make([({9: {0: 1.0}, 29: {2: 0.5}},)], "labels map<long, map<long, double>>")
    assert sorted(rows(E.flatten_labels(nested))) == [(9, 0, 1.0), (29, 2, 0.5)]


def test_edges_without_times_and_with_aliases(make):
    out = E.canonical(make([(5, 6, 2), (7, 8, 1)], "src long, dst long, edge_ids long"))
    assert rows(out, "src", "ts", "pos") == [(5, 1, 1), (7, 0, 0)]


def test_remap_and_both_directions(make):
    e = make([(10, 30, 0, 1), (30, 20, 1, 2)], "src long, dst long, pos long, ts long")
    assert rows(E.remapped(e)) == [(10, 0), (20, 1), (30, 2)]
    assert rows(E.bidirectional(e), "node", "other", "dir", "pos") == [(10, 30, 0, 0), (20, 30, 1, 1), (30, 10, 1, 0), (30, 20, 0, 1)]


def test_positions_match_a_plain_sort(spark):
    df = spark.range(5000).select(F.pmod(F.col("id") * 7919, F.lit(97)).alias("a"), F.col("id").alias("b"))
    got = [(r["a"], r["b"]) for r in tables.with_position(df.repartition(5), ["a", "b"]).orderBy("pos").collect()]
    assert got == sorted(((i * 7919) % 97, i) for i in range(5000))
    assert tables.with_position(df.limit(0), ["a"]).count() == 0


def test_shards_and_fingerprints(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") % 3).cast("int").alias("part"))
    tables.write_shards(df, str(tmp_path / "s"))
    assert tables.read_shard(spark, str(tmp_path / "s"), 1).count() == 7 and tables.read_shard(spark, str(tmp_path / "s")).count() == 20
    a, b = tables.fingerprint(df).first(), tables.fingerprint(df.orderBy(F.desc("id")).repartition(3)).first()
    assert a == b and tables.fingerprint(df.limit(19)).first() != a and tables.fingerprint(df.limit(0)).first()["n_rows"] == 0


def test_split_by_ratio_and_ties(make):
    e = make([(i, t) for i, t in enumerate([1, 1, 1, 2, 2, 3, 3, 3, 3, 3])], "pos long, ts long")
    assert rows(W.split_ranges(e, (0.5, 0.2, 0.3))) == [(0, 0, 5), (1, 5, 7), (2, 7, 10)]
    assert rows(W.split_ranges(e, (0.4, 0.2, 0.4), tie_safe=True)) == [(0, 0, 3), (1, 3, 5), (2, 5, 10)]
    assert W.cut_points(5, (0.5, 0.5)) == [0, 2, 5] and W.cut_points(3, (0.5, 0.5)) == [0, 2, 3]


def test_adaptive_batches_match_a_walk(make):
    import random

    rng = random.Random(3)
    for _ in range(6):
        ts, batch = sorted(rng.choices(range(12), k=60)), rng.randint(2, 9)
        got = rows(W.adaptive_batches(make(list(enumerate(ts)), "pos long, ts long"), batch))
        expected, begin = [], 0
        while begin < 60:
            cut = begin + batch
            if cut < 60 and ts[cut - 1] == ts[cut]:
                first = ts.index(ts[cut])
                after = 60 - ts[::-1].index(ts[cut])
                cut = after if first <= begin or after - cut <= cut - first else first
            expected.append((len(expected), begin, min(cut, 60)))
            begin = min(cut, 60)
        assert got == sorted(expected, key=str)


def test_labels_to_windows(make):
    windows = make([(0, 0, 2.0), (0, 1, 4.0), (0, 2, 6.0), (0, 3, None)], "split int, window long, end_ts double")
    labels = make([(0, 0.5, 0), (1, 3.0, 0), (2, 3.0, 0), (3, 9.0, 0)], "node long, ts double, split int")
    assert rows(W.label_windows(labels, windows), "node", "window") == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_next_targets_stay_inside_the_split(make):
    windows = make([(0, 0, 0, 1), (0, 1, 1, 2), (1, 2, 2, 3)], "split int, window long, begin long, end long")
    e = make([(0, 10), (1, 11), (2, 12)], "pos long, eid long")
    assert rows(W.edge_targets(e, windows), "window", "eid") == [(0, 11)]
    assert rows(W.with_horizon(windows, 1), "window", "labelled") == [(0, True), (1, False), (2, False)]


def test_coverage(make):
    e = make([(i,) for i in range(5)], "pos long")
    assert W.covered(e, make([(0, 2), (1, 4)], "begin long, end long")).first().asDict() == {"n_rows": 5, "in_none": 1, "in_many": 1}


def test_weighted_norm(make):
    e = make([(0, 1, 2.0), (2, 1, 1.0)], "src long, dst long, w double")
    got = {(r["src"], r["dst"]): r["norm"] for r in G.gcn_norm(e).collect()}
    assert got[(0, 1)] == pytest.approx(2 / math.sqrt(12)) and got[(2, 1)] == pytest.approx(1 / math.sqrt(8))
    assert got[(0, 0)] == pytest.approx(1 / math.sqrt(3)) and len(got) == 5


def test_last_match(make):
    source = make([(1, 0), (1, 1), (2, 2)], "k long, pos long")
    query = make([(1,), (2,), (3,), (-1,)], "k long")
    assert rows(G.lookup_last(source, query, ["k"], "pos", "pos")) == [(-1, -1), (1, 1), (2, 2), (3, -1)]
    with pytest.raises(ValueError):
        G.fetch(query, source, "k")


def test_recent_neighbours_are_causal(make):
    adj = make([(1, 5, 0, 10, 0, 1.0), (1, 6, 1, 20, 0, 1.0), (1, 7, 2, 20, 0, 1.0), (1, 8, 3, 30, 0, 1.0)], "node long, other long, pos long, ts long, dir int, w double")
    got = rows(N.recent(adj, None, 2), "cutoff", "other", "back", "delta")
    assert got == sorted([(20, 5, 1, 10), (30, 7, 1, 10), (30, 6, 2, 10)], key=str)
    asked = make([(1, 25), (1, 31), (2, 99), (1, 10)], "node long, cutoff long")
    for safe in (False, True):
        assert rows(N.recent(adj, asked, 2, hub_safe=safe), "cutoff", "other") == sorted([(25, 6), (25, 7), (31, 7), (31, 8)], key=str)
    stats = rows(N.recent_stats(adj, 2))
    assert stats == [(1, 20, 1, 10, 10, 0), (1, 30, 2, 10, 10, 3)]
    assert rows(N.instances(N.expand(adj, asked, [1])), "node", "ts") == rows(make([(1, 25), (1, 31), (6, 20), (7, 20), (8, 30)], "a long, b long").where("a != 6"))


def test_sampling_takes_all_of_few(make):
    adj = make([(1, 5, 0, 10, 0, 1.0), (1, 6, 1, 20, 0, 0.0), (1, 7, 2, 30, 0, 3.0)], "node long, other long, pos long, ts long, dir int, w double")
    root = make([(1, 40)], "node long, cutoff long")
    assert rows(N.uniform(adj, root, 3), "other") == [(5,), (6,), (7,)]
    drawn = [r["other"] for r in N.uniform(adj, root, 2).collect()]
    assert len(drawn) == 2 and set(drawn) <= {5, 6, 7}
    picks = [r["other"] for r in N.weighted(adj, root, 400).collect()]
    assert len(picks) == 400 and 6 not in picks and 0.65 < picks.count(7) / 400 < 0.85
    snap = adj.withColumn("snapshot", (F.col("ts") / 20).cast("long"))
    assert rows(N.snapshot_uniform(snap, 4), "snapshot", "other") == [(0, 5), (1, 6), (1, 7)]
    assert rows(N.snapshot_history(snap, 4, 1), "at", "other") == [(0, 5), (1, 5), (1, 6), (1, 7)]


def test_owners_pools_and_addresses(make):
    e = make([(0, 1, 0), (1, 2, 1), (2, 3, 2), (3, 0, 3)], "src long, dst long, pos long")
    nodes = make([(i,) for i in range(4)], "node long")
    own = P.round_robin(nodes, 2)
    assert rows(P.edge_owner(e, own), "pos", "part") == [(0, 1), (1, 0), (2, 1), (3, 0)]
    halves = make([(0, 0), (1, 0), (2, 1), (3, 1)], "node long, part int")
    loops = P.edge_owner(make([(i, i, i) for i in range(4)], "src long, dst long, pos long"), halves)
    hot = make([(3, 9, 1)], "node long, degree long, place int")
    assert rows(T.local_pool(loops, 0, hot)) == [(0,), (1,), (3,)] and rows(T.local_pool(loops, 1, hot)) == [(2,), (3,)]
    assert rows(T.remote_pool(loops, 0)) == [(2,), (3,)]
    placed = P.local_rows(halves, hot)
    assert rows(placed, "node", "part", "loc") == [(0, 0, 1), (1, 0, 2), (2, 1, 1), (3, 1, 0)]
    assert rows(P.unpacked(P.packed(placed).drop("part", "loc")), "node", "part", "loc") == rows(placed, "node", "part", "loc")


def test_pool_weights():
    assert T.pool_weights({"a": 2.0, "b": 1.0}) == {"a": 2 / 3, "b": 1 / 3}
    with pytest.raises(ValueError):
        T.pool_weights({"a": 0.0})
    assert T.NegativePolicy.of("train").global_share == 0.1 and T.NegativePolicy.of("test").global_share == 1.0


def test_history(make):
    h = make([(0, 1, 4.0), (2, 1, 2.0), (0, 2, 12.0), (2, 2, 6.0), (0, 4, 20.0), (2, 4, 10.0)], "node long, version long, value double")
    inc = {(r["node"], r["version"]): (r["n"], r["mean_inc"]) for r in S.increments(h).collect()}
    assert inc[(2, 2)] == (2, 3.0) and inc[(0, 2)] == (2, 6.0) and inc[(2, 4)] == (3, pytest.approx(8 / 3)) and inc[(0, 4)] == (3, pytest.approx(16 / 3))
    asked = make([(2, 3), (0, 3), (9, 3), (2, 0)], "node long, version long")
    assert rows(S.history_asof(h, asked), "node", "found", "value") == sorted([(2, 2, 6.0), (0, 2, 12.0), (9, None, None), (2, None, None)], key=str)
    assert rows(S.history_asof(h, make([(2, 2)], "node long, version long"), strict=True), "found") == [(1,)]
    p = make([(2, 1, 2.0), (2, 2, 4.0), (0, 1, 3.0), (0, 2, 6.0)], "node long, version long, value double")
    assert rows(S.predict(p, make([(2, 4), (0, 4), (7, 4)], "node long, version long"))) == [(0, 4, 12.0), (2, 4, 8.0), (7, 4, 0.0)]


def test_ranking_metrics_with_ties(make):
    s, y = [0.2, 0.7, 0.5, 0.6, 0.1, 0.4, 0.4, 0.6], [1, 1, 1, 0, 0, 0, 1, 0]
    df = make(list(zip(s, y)), "score double, label int")
    pairs = [(a > b) + (a == b) / 2 for a, p in zip(s, y) if p for b, q in zip(s, y) if not q]
    assert M.roc_auc(df).first()["auc"] == pytest.approx(sum(pairs) / 16)
    ap, seen = 0.0, 0
    for t in sorted(set(s), reverse=True):
        hits = sum(p for a, p in zip(s, y) if a >= t)
        ap += (hits - seen) / 4 * hits / sum(a >= t for a in s)
        seen = hits
    assert M.average_precision(df).first()["ap"] == pytest.approx(ap)
    assert M.roc_auc(df.where("label = 1")).first()["auc"] is None and M.average_precision(df.limit(0)).first()["ap"] is None


def test_classification_and_losses(make):
    df = make([(0, 0), (0, 0), (1, 0), (1, 1)], "truth int, pred int")
    out = M.f1_scores(M.confusion(df)).first()
    assert out["accuracy"] == 0.75 and out["macro_f1"] == pytest.approx(11 / 15) and out["micro_f1"] == 0.75
    big = make([(800.0, 1.0), (-800.0, 0.0), (0.0, 1.0)], "x double, y double")
    assert M.mean_bce(big, "x", "y").first()["bce"] == pytest.approx(math.log(2) / 3)


def test_mailboxes(make):
    m = make([(0, 1, 5, 0, [2.0, 2.5]), (0, 3, 5, 1, [4.0, 4.5])], "batch long, node long, ts long, pos long, value array<double>")
    assert rows(S.mailbox(m, 1, "batch")) == [(1, 0, 5, [2.0, 2.5]), (3, 0, 5, [4.0, 4.5])]
    late = make([(b, 1, t, b, float(b)) for b, t in enumerate([10, 30, 20, 5, 40])], "batch long, node long, ts long, pos long, value double")
    kept: list = []
    for b, t in enumerate([10, 30, 20, 5, 40]):
        if len(kept) < 2:
            kept.append((t, float(b)))
        else:
            kept[min((0, 1), key=lambda i: kept[i][0])] = (t, float(b))
    assert rows(S.mailbox(late, 2, "batch"), "slot", "ts", "value") == [(i, *k) for i, k in enumerate(kept)]


def test_write_mask_and_delivery(make):
    e = make([(0, 1, 0, 0), (1, 2, 1, 0)], "src long, dst long, pos long, window long")
    assert rows(G.write_mask(e), "pos", "mask") == [(0, 1), (1, 3)]
    mails = make([(0, 0, 0, [1.0, 0.0, 0.0, 1.0]), (1, 1, 1, [0.0, 1.0, 2.0, 2.0]), (2, 1, 2, [2.0, 2.0, 0.0, 1.0])], "node long, ts long, pos long, value array<double>")
    graph = make([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    assert rows(S.deliver(graph, mails), "node", "ts", "value") == [(0, 1, [2.0, 2, 0, 1]), (1, 1, [0.0, 1, 2, 2]), (2, 1, [0.0, 1, 2, 2])]


def test_commit_rejects_late_updates(make):
    old = make([(1, 10, 1.0), (2, 10, 2.0)], "node long, ts long, value double")
    new = make([(1, 9, 0, 5.0), (2, 10, 1, 6.0), (2, 10, 2, 7.0), (3, 1, 3, 8.0)], "node long, ts long, pos long, value double")
    assert rows(S.commit(old, new)) == [(1, 10, 1.0), (2, 10, 7.0), (3, 1, 8.0)]


def test_messages_and_changes(make):
    mem = make([(1, [1.0, 2.0])], "node long, value array<double>")
    e = make([(1, 2, 0, 5, [9.0])], "src long, dst long, pos long, ts long, feat array<double>")
    assert rows(S.messages(e, mem), "node", "value") == [(1, [1.0, 2.0, 0.0, 0.0, 9.0]), (2, [0.0, 0.0, 1.0, 2.0, 9.0])]
    new = make([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "node long, value array<double>")
    assert rows(S.changed(mem, new, 0.5, 0.1), "node") == [(2,)]
    assert rows(S.changed(mem, make([(1, [1.0, 4.0])], "node long, value array<double>"), 0.5, 0.9), "node") == [(1,)]


def test_refresh_after_skips(make):
    c = make([(1, v, x) for v, x in enumerate([0, 0, 5, 0, 0, 0, 0])], "node long, version long, change int")
    skips, expected = 0, []
    for v, x in enumerate([0, 0, 5, 0, 0, 0, 0]):
        publish = x >= 3 or skips >= 2
        skips = 0 if publish else skips + 1
        expected.append((v, publish))
    assert [(r["version"], r["published"]) for r in S.refresh_decisions(c, 3, 2).orderBy("version").collect()] == expected


def test_asof(make):
    left = make([(1, 5, "a"), (1, 10, "b"), (2, 1, "c")], "k long, t long, x string")
    right = make([(1, 5, 50), (1, 7, 70)], "k long, t long, v int")
    assert rows(W.asof(left, right, "k", "t", ["v"]), "x", "v") == [("a", 50), ("b", 70), ("c", None)]
    assert rows(W.asof(left, right, "k", "t", ["v"], allow_equal=False), "x", "v") == [("a", None), ("b", 70), ("c", None)]


def test_chunk_filters_differ(make):
    e = make([(0, 1, 0), (2, 1, 1), (1, 2, 2)], "src long, dst long, pos long")
    chunks = make([(0, 0), (1, 0), (2, 1)], "node long, chunk int")
    assert rows(P.chunk_filter_dst(e, chunks, 1), "pos") == [(0,), (1,)]
    assert rows(P.chunk_induced(e, chunks, 1), "pos") == [(0,)]


def test_decay_parser():
    assert W.parse_decay("half", 3, 16) == [8, 4, 2] and W.parse_decay("auto:0.25", 2, 16) == [4, 1] and W.parse_decay("5,5,1", 3, 9) == [5, 5, 1]
    for bad in ("1,2", "auto:0", "3"):
        with pytest.raises(ValueError):
            W.parse_decay(bad, 2, 4)


def test_streamed_edges_are_balanced(make):
    e = make([(i % 7, 100 + i % 11, i, i) for i in range(400)], "src long, dst long, pos long, ts long")
    hot = P.hot_nodes(e, count=3)
    got = rows(P.streaming_edge_parts(e, hot, 4))
    assert len(got) == 400 and {p for _, p in got} <= {0, 1, 2, 3}
    assert rows(P.streaming_edge_parts(e.repartition(3), hot, 4)) == got
    assert P.streaming_edge_parts(e, hot, 4, lanes=3).count() == 400


def test_chunk_assignment_is_even(make):
    loads = make([(s, c, 10 if (c + s) % 3 else 40) for s in range(4) for c in range(12)], "snapshot long, chunk int, n long")
    at = P.assign_chunks(loads, 3)
    sums = [[sum(10 if (c + s) % 3 else 40 for c in range(12) if at[c] == p) for p in range(3)] for s in range(4)]
    assert all(max(x) - min(x) <= 30 for x in sums)


def test_empty_edges(make):
    e = make([], "src long, dst long, pos long, ts long, w double, eid long")
    adj = E.bidirectional(e)
    assert N.recent(adj, None, 3).count() == N.recent_stats(adj, 3).count() == N.uniform(adj, None, 3).count() == 0
    assert G.gcn_norm(e).count() == G.csr(e).count() == E.remapped(e).count() == 0
    assert W.adaptive_batches(e, 5).count() == 0 and rows(W.split_ranges(e)) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]
