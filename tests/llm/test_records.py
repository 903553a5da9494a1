import base64
import hashlib
import math
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kairograph.llm import sharding as H
from kairograph.llm import warc as W

from .conftest import texts


def rows_of(df, **options):
    return [r.asDict() for r in H.assign(df, **options).collect()]


def test_sizes_slots_and_checksums(docs, none, clashing):
    for df in (docs, clashing):
        rows = rows_of(df)
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == sorted(((t[0], len((t[1] or "").encode()) + 8, zlib.crc32((t[1] or "").encode())) for t in texts()), key=str)
        by = defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert H.assign(none).count() == 0


@pytest.mark.parametrize("n", [1, 4, 11, 12, 23, 24])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    for more in (0, 1):
        grown = {r["doc_id"]: r for r in rows_of(df, n=n + more, planned=n)}
        after = {r["doc_id"]: r["shard"] for r in rows_of(df, n=n + more + 1, planned=n)}
        assert all(r["grown_shard"] == after[i] and after[i] in (r["shard"], n + more) for i, r in grown.items())
        moved = sum(after[i] != r["shard"] for i, r in grown.items())
        assert abs(moved - 4000 / (n + more + 1)) < 5 * (4000 / (n + more + 1)) ** 0.5 + 5


def test_the_shard_count_alone_decides_beyond_the_plan(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    grown = {r["doc_id"]: r["grown_shard"] for r in rows_of(df)}
    assert grown == {r["doc_id"]: r["shard"] for r in rows_of(df, n=H.SHARDS + 1, planned=H.SHARDS)}


def slow_shard(key, shards):
    """Descent by draws at each level."""

    def least(children):
        u = lambda name: (int(hashlib.md5(f"{key}:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return min((-math.log(u(name)) / w, name) for name, w in children.items())[1]

    def weights(of, name):
        out = defaultdict(float)
        for s in of:
            out[name(s)] += s.weight
        return out

    region = least(weights(shards, lambda s: f"region{s.region}"))
    shards = [s for s in shards if f"region{s.region}" == region]
    rack = least(weights(shards, lambda s: f"rack{s.rack}"))
    return int(least(weights([s for s in shards if f"rack{s.rack}" == rack], lambda s: str(s.number))))


def test_draws_at_each_level(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    weights = [1.0 + i % 5 for i in range(24)]
    assert all(r["shard"] == slow_shard(r["doc_id"], H.tree(24, weights)) for r in rows_of(df, weights=weights))


def test_weights_and_movement(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    weights = [1.0] * 24
    a = {r["doc_id"]: r["shard"] for r in rows_of(df, weights=weights)}
    weights[5] = 3.0
    b = {r["doc_id"]: r["shard"] for r in rows_of(df, weights=weights)}
    # Only into subtrees whose weights grow: region 0, in it rack 1, in it shard 5.
    place = {s.number: (s.region, s.rack, s.number) for s in H.tree(24)}
    for i, s in a.items():
        level = next((k for k in range(3) if place[s][k] != place[b[i]][k]), None)
        assert level is None or place[b[i]][level] == place[5][level]
    assert abs(sum(v == 5 for v in b.values()) - 6000 * 3 / 26) < 150
    with pytest.raises(ValueError):
        H.tree(3, [1.0, 0.0, 1.0])


def test_rows_that_repeat_often(spark, monkeypatch):
    monkeypatch.setattr(H, "PART_ROWS", 10)
    df = spark.range(300).select(F.when(F.col("id") < 100, F.lit(7)).when(F.col("id") < 150, F.lit(None)).otherwise(F.col("id")).cast("long").alias("doc_id"), (F.col("id") % 3).cast("string").alias("text"))
    rows, by = rows_of(df), defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == 300 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sum(r["doc_id"] == 7 for r in rows) == 100


PAGES = [
    (1, "http://a/x", '<html lang="EN-us"><head><title>A &amp;  B</title><style>p{}</style></head><body><p>One <b>two</b></p><script>if (a<b) x()</script><a href="/y?a=1&amp;b=2">three</a><!-- no --></body></html>'),
    (2, None, None),
    (3, "http://a/z", ""),
    (3, "http://a/z", ""),
    (4, "u", "plain < text & more"),
    (None, "u", "<p>x" + "<p>é😀 " * 20000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_derivatives(pages):
    source = {(r["target_uri"], r["record_id"]): r for r in W.responses(pages).collect()}
    made = W.derive(W.responses(pages)).collect()
    assert len(made) == 2 * len(PAGES)
    for r in made:
        s = source[(r["target_uri"], r["refers_to"])]
        assert r["payload_digest"] == s["payload_digest"] and r["warc_date"] == s["warc_date"] and r["record_id"] != s["record_id"]
        assert r["content_length"] == len(r["block"])
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r["block"]).digest()).decode()
        assert [h["name"] for h in r["source_headers"]] == ["Content-Type", "Content-Length"]
        html = s["block"].split(b"\r\n\r\n", 1)[1]
        assert s["payload_digest"] == W.digest(bytes(html))
    kinds = {(r["warc_type"], r["target_uri"]): bytes(r["block"]).decode() for r in made}
    assert kinds[("conversion", "http://a/x")] == "A & B\nOne two\nthree"
    assert kinds[("conversion", None)] == "" and kinds[("conversion", "http://a/z")] == ""
    meta = kinds[("metadata", "http://a/x")].split("\r\n")
    assert "title: A & B" in meta and "language: en-us" in meta and "outlink: /y?a=1&b=2" in meta


def test_other_records_and_blocks(spark, pages):
    r = W.responses(pages)
    assert W.derive(r.withColumn("warc_type", F.lit("request"))).count() == 0
    assert W.derive(r.limit(0)).count() == 0
    bare = W.derive(r.limit(1).withColumn("block", F.lit(b"no header <p>x")).withColumn("payload_digest", F.lit(None).cast("string")).withColumn("extra", F.lit(1)))
    text = bare.where("warc_type = 'conversion'").first()
    assert bytes(text["block"]) == b"no header\nx" and text["payload_digest"] == W.digest(b"no header <p>x") and not text["source_headers"]


def test_file_bytes(pages):
    row = W.responses(pages).withColumn("raw", W.file_bytes()).where("target_uri = 'http://a/x'").first()
    raw = bytes(row["raw"])
    head, _, rest = raw.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and f"Content-Length: {row['content_length']}".encode() in head
    assert rest == bytes(row["block"]) + b"\r\n\r\n"


@pytest.mark.parametrize("bad", ["<svg>", "<a ", "<title>", "<!--", "<script", "<", "<a href='", "</", "<p", "<style>x"])
def test_malformed_pages_take_linear_time(bad):
    import time

    began = time.time()
    W.derivatives({"block": (bad * (1_000_000 // len(bad))).encode(), "payload_digest": None, "record_id": "r", "target_uri": "u", "warc_date": W.EPOCH})
    assert time.time() - began < 10


def test_headers_and_marks():
    block = W.http_block([("Date", "x"), ("Link", "<a>"), ("Server", "s")], b"<title>T&amp;</title>a<!-- <b>x --><i>b</i><svg/>c<svg><p>no</svg>d <3 <a href=u>e")
    meta, text = W.derivatives({"block": block, "payload_digest": None, "record_id": "r", "target_uri": "u", "warc_date": W.EPOCH})
    assert [h["name"] for h in meta["source_headers"]] == ["Date", "Link", "Server"] and b"http-server: s" in meta["block"]
    assert text["block"] == b"T&\na bc d <3 e" and b"outlink: u\r\n" in meta["block"] and b"title: T&\r\n" in meta["block"]


def test_pages_of_other_columns_and_ids(spark, pages):
    odd = pages.withColumn("block", F.lit("x")).withColumn("p", F.lit(1)).withColumn("record_id", F.lit(2))
    assert sorted(r["record_id"] for r in W.responses(odd).collect()) == sorted(r["record_id"] for r in W.responses(pages).collect())
    two = spark.createDataFrame([(1, "u", "a"), (1, "u", "b")], "page_id long, url string, html string")
    assert len({r["record_id"] for r in W.responses(two).collect()}) == 2
