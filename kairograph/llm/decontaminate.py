"""Benchmark decontamination by winnowing: which words of a document repeat a benchmark window.

A window is ``WINDOW`` consecutive words of an item.  Both sides hash their
k-grams and keep the smallest hash in each run of ``WINDOW - K + 1`` k-grams, so
equal windows always keep the same fingerprint: every shared span of a window's
length is found.  Fingerprints that training and test texts share are extended
to whole windows, which are compared word by word.  Items of fewer words are
one window; each such length has its own scan, as winnowing promises nothing
below a full window.

Two plans give the same rows.  ``broadcast``: a benchmark of at most
``BROADCAST_BYTES`` of text (checked) goes to all tasks, whose index is made once
in each worker, and the documents are read once, without a shuffle.  ``join``: a larger benchmark is joined to the
documents' fingerprints by hash.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import append_from_text, c, written

WINDOW, K = 13, 7
#: Share of a document's words that makes it contaminated: 1 in 20.
SHARE = 20
#: Largest benchmark, in bytes of text, that is sent to every task.
BROADCAST_BYTES = 4_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters a-z after lower-casing, and non-ASCII characters."""
    return text.translate(_LOWER).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * _MIX


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of the runs of ``n`` word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * np.uint64(0x100000001B3) + h[i : len(h) - n + 1 + i]
    return out ^ (out >> np.uint64(29))


def winnow(h: np.ndarray, window: int = WINDOW, k: int = K) -> np.ndarray:
    """For each window of words, the smallest hash of its k-grams."""
    low = grams(h, k)
    if len(h) < window:
        return np.empty(0, np.uint64)
    out = low[: len(h) - window + 1].copy()
    for i in range(1, window - k + 1):
        np.minimum(out, low[i : len(out) + i], out=out)
    return out


class Index:
    """Windows of items by length: fingerprints to look for, and where windows with a hash stand in the items' words.

    Words are kept once, in one list; a window is a hash and a place, in arrays
    sorted by hash, so the index takes a few dozen bytes a word.
    """

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW, k: int = K) -> None:
        self.window, self.k = window, k
        self.items = [item for item, _ in items]
        self.words: list[bytes] = []
        self.begins = np.zeros(len(items) + 1, np.int64)
        shared: dict[bytes, bytes] = {}
        found: dict[int, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))
        for i, (_, text) in enumerate(items):
            words = [shared.setdefault(w, w) for w in words_of(text)]
            if n := min(len(words), window):
                h = word_hashes(words)
                for into, x in zip(found[n], (self.fingerprints(h, n), grams(h, n), np.arange(len(words) - n + 1) + len(self.words)), strict=True):
                    into.append(x)
            self.words += words
            self.begins[i + 1] = len(self.words)
        self.prints: dict[int, np.ndarray] = {}
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, (prints, hashes, places) in found.items():
            h, at = np.concatenate(hashes), np.concatenate(places)
            order = np.argsort(h, kind="stable")
            self.prints[n], self.whole[n] = np.unique(np.concatenate(prints)), (h[order], at[order])

    def fingerprints(self, h: np.ndarray, n: int) -> np.ndarray:
        return winnow(h, self.window, self.k) if n == self.window else grams(h, n)

    def found(self, words: list[bytes], n: int, whole: np.uint64) -> set:
        """Items that have this very window; ``whole`` is its hash."""
        h, places = self.whole[n]
        at = places[np.searchsorted(h, whole) : np.searchsorted(h, whole, side="right")]
        same = [p for p in at.tolist() if self.words[p : p + n] == words]
        return {self.items[i] for i in (np.searchsorted(self.begins, same, side="right") - 1).tolist()} if same else set()

    def hits(self, texts: list[bytes | None]) -> list[tuple[int, list[int], set]]:
        """For each text: words, positions of the words hit, items found."""
        split = [words_of(t) for t in texts]
        counts = [len(w) for w in split]
        words = [w for x in split for w in x]
        ends = np.cumsum(np.array(counts, np.int64))
        of = np.repeat(np.arange(len(texts)), counts)
        h, hit, items = word_hashes(words), [set() for _ in texts], [set() for _ in texts]
        for n, prints in self.prints.items():
            own = self.fingerprints(h, n)
            at = np.searchsorted(prints, own)
            at[at == len(prints)] = 0
            likely = np.flatnonzero(prints[at] == own) if len(own) else np.empty(0, np.int64)
            whole = grams(h, n) if len(likely) else own
            for i in likely.tolist():
                d = int(of[i])
                if i + n <= ends[d] and (those := self.found(words[i : i + n], n, whole[i])):
                    begin = i - int(ends[d]) + counts[d]
                    hit[d].update(range(begin, begin + n))
                    items[d] |= those
        return [(counts[d], sorted(hit[d]), items[d]) for d in range(len(texts))]


def items_digest(items) -> str:
    """SHA-256 of the ids as strings, sorted, comma-joined."""
    return hashlib.sha256(",".join(sorted("" if x is None else str(x) for x in items)).encode()).hexdigest()


_WINDOW_TYPE = StructType([StructField("print", LongType()), StructField("n", IntegerType()), StructField("at", LongType()), StructField("words", BinaryType())])
_FIELDS = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()), StructField("items_sha256", StringType()), StructField("contaminated", BooleanType())]


def _row(n: int, hits: int, items) -> tuple:
    return n, hits, len(items), items_digest(items), hits > 0 and SHARE * hits >= n


#: The last index made in this worker, by the plan that it belongs to.
_made: dict[str, Index] = {}


def _index_of(key: str, shared) -> Index:
    if key not in _made:
        _made.clear()
        _made[key] = Index(shared.value)
    return _made[key]


def _broadcast_plan(docs: DataFrame, items: list, text: str, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    key = uuid.uuid4().hex

    def kernel():
        index = _index_of(key, shared)
        return lambda texts: list(map(list, zip(*(_row(n, len(hit), found) for n, hit, found in index.hits(texts)), strict=True)))

    return append_from_text(docs, text, keep, _FIELDS, kernel)


def _windows(lengths: list[int], kind: str):
    """Kernel: windows with their fingerprint; runs of equal fingerprints in documents are one row."""

    def kernel():
        index = Index([])

        def apply(texts):
            n_words, rows = [], []
            for t in texts:
                words, found = words_of(t), []
                h = word_hashes(words)
                for n in lengths if kind == "document" else [min(len(words), WINDOW)]:
                    own = index.fingerprints(h, n) if 0 < n <= len(words) else np.empty(0, np.uint64)
                    runs = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
                    if kind == "item":
                        runs = np.arange(len(own))
                    for i, j in zip(runs.tolist(), [*runs[1:].tolist(), len(own)], strict=True) if len(runs) else ():
                        found.append({"print": int(own[i].view(np.int64)), "n": n, "at": i, "words": b" ".join(words[i : j - 1 + n])})
                n_words.append(len(words))
                rows.append(found)
            return [n_words, rows]

        return apply

    return kernel


def _join_plan(docs: DataFrame, benchmark: DataFrame, text: str, keep: list[str], item_id: str, item_text: str) -> DataFrame:
    kind = ArrayType(_WINDOW_TYPE)
    items = append_from_text(benchmark.select(c(item_id).alias("item"), c(item_text).alias("__t")), "__t", ["item"], [StructField("n_words", LongType()), StructField("w", kind)], _windows([], "item"))
    items, _ = written(items.select("item", F.explode("w").alias("w")).select("item", "w.print", "w.n", "w.words").groupBy("print", "n", "words").agg(F.sort_array(F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit("")))).alias("items")), "windows")
    lengths = [r[0] for r in items.select("n").distinct().collect()]  # 13 values at most
    rows, _ = written(docs.select(F.expr("uuid()").alias("__row"), *[c(k) for k in keep], c(text).cast("binary").alias("__t")), "documents")
    own = append_from_text(rows, "__t", ["__row"], [StructField("n_words", LongType()), StructField("w", kind)], _windows(lengths, "document"))
    pairs = own.select("__row", F.explode("w").alias("w")).select("__row", "w.print", "w.n", "w.at", F.col("w.words").alias("span")).join(items, ["print", "n"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for x in batch.to_pylist():
                span, window = x["span"].split(b" "), x["words"].split(b" ")
                for i in range(len(span) - len(window) + 1):
                    if span[i : i + len(window)] == window:
                        for k, v in enumerate((x["__row"], list(range(x["at"] + i, x["at"] + i + len(window))), x["items"])):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())), strict=True)], names=["__row", "at", "items"])

    found, _ = written(pairs.mapInArrow(extend, "__row string, at array<long>, items array<string>"), "hits")
    hit = found.select("__row", F.explode("at").alias("at")).groupBy("__row").agg(F.count_distinct("at").alias("n_hit"))
    those = found.select("__row", F.explode("items").alias("item")).groupBy("__row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    counted = append_from_text(rows, "__t", ["__row", *keep], [StructField("n_words", LongType())], lambda: lambda texts: [[len(words_of(t)) for t in texts]])
    out = counted.join(hit, "__row", "left").join(those, "__row", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    ids = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    contaminated = (F.col("n_hit") > 0) & (F.lit(SHARE) * F.col("n_hit") >= F.col("n_words"))
    return out.select(*[c(k) for k in keep], "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), contaminated.alias("contaminated"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    item_id: str = "item_id",
    item_text: str = "text",
    plan: str = "auto",
) -> DataFrame:
    """``keep`` columns of every document, ``n_words, n_hit, n_items, items_sha256, contaminated``.

    ``n_hit`` counts the document's words inside any occurrence of a window;
    contaminated: some are hit, and at least one in ``SHARE``.  Defined cases:
    null and empty texts have no words and no windows; repeated rows each keep a
    row; items with the same window are all found; items with the same id count
    once, and a null id is the empty string in the digest; an empty benchmark
    leaves all clean.  Kept columns named like a result are left out.
    """
    keep = [k for k in (docs.columns if keep is None else keep) if k.lower() not in {f.name for f in _FIELDS}]
    if plan == "auto":
        size = benchmark.agg(F.sum(F.octet_length(c(item_text)) + F.lit(32))).first()[0] or 0
        plan = "broadcast" if size <= BROADCAST_BYTES else "join"
    # Under names of our own inside, as a table's may be anything.
    names, own = [*keep, *(f.name for f in _FIELDS)], [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[c(k).alias(o) for k, o in zip(keep, own, strict=True)], c(text).alias("t"))
    if plan == "join":
        return _join_plan(rows, benchmark, "t", own, item_id, item_text).toDF(*names)
    items = [(r[0], bytes(r[1]) if r[1] is not None else None) for r in benchmark.select(c(item_id), c(item_text).cast("binary")).collect()]
    return _broadcast_plan(rows, items, "t", own).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    """``op2_decontamination``: words of every document inside benchmark windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])


def oracle_sql() -> str:
    """DuckDB SQL for the rows of ``query``."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), i AS (SELECT item_id, {words} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s FROM i WHERE len(w) > 0)),
    dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
    h AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
    k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND {SHARE} * n_hit >= len(w), false) AS contaminated
    FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""
