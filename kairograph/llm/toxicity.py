"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features: densities of a lexicon learned from the labels, second-person words
near lexicon words, capitals, punctuation, and signs of obfuscation (digits or
symbols inside words, spaced letters, repeated letters, and lexicon words that
appear once such signs are undone).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField

from .common import append_from_text, c, least_hashes, remove, written
from .language import fold

FOLDS = 5
#: The fit reads this many labelled rows at most, those with the smallest hashes of their ids.
ROWS = 16_000
#: Lexicon: words with log odds of this value and so many standard errors.
LOG_ODDS, ERRORS = 2.5, 3.0
#: Trees, depth, learning rate, bins of a feature, L2 of leaf values.
TREES, DEPTH, RATE, BINS, L2 = 60, 3, 0.2, 32, 1.0
#: Words before and after a lexicon word in which a second-person word counts.
NEAR = 4

#: Second-person words of the common languages.
SECOND_PERSON = frozenset(w.encode() for w in "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine sie ihr euch usted ustedes tú ti tus vosotros você".split())
#: Symbols that stand for letters.
_LEET = bytes.maketrans(b"0134578@$!|+", b"oieastbasiit")

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or b == 39 else 32 for b in range(256))
_INNER = re.compile(rb"[A-Za-z][0-9@$!|+*#_.-]{1,3}[A-Za-z]")
_SPACED = re.compile(rb"\b[A-Za-z](?:[ .*_-][A-Za-z]\b){3,}")
_REPEATED = re.compile(rb"([A-Za-z])\1{2,}")
#: A letter beside a symbol, or a dot between two letters.
_WHITE = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")
_ODD = re.compile(rb"[A-Za-z][0-9@$!|+*#_-]|[0-9@$!|+*#_-][A-Za-z]|[A-Za-z]\.[A-Za-z]")

FEATURES = ("lexicon_hits", "lexicon_density", "strong_hits", "strong_density", "hidden_hits", "near_second_person", "second_person_density", "capitals", "capital_words", "exclamations", "questions", "punctuation", "obfuscated", "spaced", "repeated", "length")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def _odd_tokens(text: bytes) -> Iterator[bytes]:
    """Runs without white space that have a letter beside a symbol."""
    plain, end = text.translate(_WHITE), 0
    for m in _ODD.finditer(plain):
        if m.start() >= end:
            begin = plain.rfind(b" ", 0, m.start()) + 1
            end = plain.find(b" ", m.end())
            end = len(plain) if end < 0 else end
            yield plain[begin:end].lower()


def features(text: bytes | None, lexicon: dict[bytes, float], strong: float) -> list[float]:
    """Dense features of a whole text; all 0 if it is empty."""
    return features_by(text, [(lexicon, strong)])[0]


def features_by(text: bytes | None, lexicons: list[tuple[dict[bytes, float], float]]) -> list[list[float]]:
    """``features`` for each lexicon; what doesn't depend on one is worked out once."""
    if not text:
        return [[0.0] * len(FEATURES) for _ in lexicons]
    words = words_of(text)
    n, size = max(1, len(words)), len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    # What a token may hide: its words with symbols read as letters, or left out.
    disguised = [(words_of(x), [w for y in (x.translate(_LEET), re.sub(rb"[^a-z\x80-\xff]", b"", x)) for w in words_of(y)]) for x in _odd_tokens(text)]
    spaced = [re.sub(rb"[^a-z]", b"", m.group().lower()) for m in _SPACED.finditer(text)]
    shared = [
        sum(w in SECOND_PERSON for w in words) / n,
        upper / max(1, upper + lower),
        len(re.findall(rb"\b[A-Z]{3,}\b", text)) / n,
        int(hist[33]) / n,
        int(hist[63]) / n,
        (int(hist[33:48].sum()) + int(hist[58:65].sum())) / size,
        len(_INNER.findall(text)) / n,
        len(spaced) / n,
        sum(1 for _ in _REPEATED.finditer(text)) / n,
        float(np.log1p(n)),
    ]
    out = []
    for lexicon, strong in lexicons:
        hits = [i for i, w in enumerate(words) if w in lexicon]
        top = sum(lexicon[words[i]] >= strong for i in hits)
        near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
        hidden = sum(any(w in lexicon for w in meant) and not any(w in lexicon for w in plain) for plain, meant in disguised) + sum(w in lexicon for w in spaced)
        out.append([float(np.log1p(len(hits))), len(hits) / n, float(np.log1p(top)), top / n, float(hidden), near / max(1, len(hits)), *shared])
    return out


@dataclass
class Forest:
    """Complete trees of one depth; a node without a split sends all to the left."""

    bias: float
    split: np.ndarray  # (trees, nodes) feature
    above: np.ndarray  # (trees, nodes) threshold
    leaf: np.ndarray  # (trees, leaves)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for split, above, leaf in zip(self.split, self.above, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, split[at]] > above[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Logistic gradient boosting on binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(rate / (1 - rate)))
    margin, inner = np.full(len(y), bias), 2**depth - 1
    splits, aboves, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at, split, above = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best = 1e-6
            cut = len(edges[0]) + BINS
            if len(own) > 1:
                total_g, total_h = g[own].sum(), h[own].sum()
                for j, e in enumerate(edges):
                    left_g = np.cumsum(np.bincount(binned[own, j], g[own], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[own, j], h[own], len(e) + 1))[:-1]
                    gain = left_g**2 / (left_h + L2) + (total_g - left_g) ** 2 / (total_h - left_h + L2) - total_g**2 / (total_h + L2)
                    if len(gain) and gain.max() > best:
                        best, cut = gain.max(), int(gain.argmax())
                        split[node], above[node] = j, e[cut]
            right = binned[own, split[node]] > cut if np.isfinite(above[node]) else np.zeros(len(own), bool)
            at[own] = 2 * node + 1 + right
        at -= inner
        sums_g, sums_h = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf = RATE * sums_g / (sums_h + L2)
        margin += leaf[at]
        splits.append(split)
        aboves.append(above)
        leaves.append(leaf)
    return Forest(bias, np.array(splits), np.array(aboves), np.array(leaves))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margins) and their non-decreasing rates."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of margins, sum of labels, rows
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([m, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Model:
    lexicon: dict[bytes, float]
    strong: float
    forest: Forest
    knots: np.ndarray
    rates: np.ndarray

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Calibrated probabilities; one part in a hundred is the uncalibrated one, which orders ties."""
        margin = self.forest.margin(np.array([features(t, self.lexicon, self.strong) for t in texts]).reshape(len(texts), -1))
        calibrated = np.interp(margin, self.knots, self.rates) if len(self.knots) else 1 / (1 + np.exp(-margin))
        return np.clip(0.99 * calibrated + 0.01 / (1 + np.exp(-margin)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of labelled documents whose fold (modulo 5) is not 0.

    The ``ROWS`` labelled rows with the smallest hashes of id and text are read,
    whole, and written once.  Lexicon and trees are learned of all of them; what
    calibrates are the margins that each fifth gets from a lexicon and trees
    learned of the other four.  Word counts are summed on the cluster, and the
    driver gets the words whose odds stand out, which the bounded rows bound,
    and a feature row for each labelled row.  Rows that repeat in id and text
    count once; an id with several texts or labels counts with each text, under
    the largest label.  Without labelled rows every score is that of an even
    chance.
    """
    known = labels.where(c(doc_id).isNotNull() & c(label).isin(0, 1) & (fold(c(doc_id), FOLDS) != 0)).select(c(doc_id).alias("id"), c(label).cast("int").alias("y"))
    chosen = least_hashes(known, F.col("id"), ROWS).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(c(doc_id).alias("id"), c(text).cast("binary").alias("t")).withColumn("k", F.xxhash64("id", "t"))
    narrow = texts.select("id", "k").join(F.broadcast(chosen), "id").distinct()
    narrow = least_hashes(narrow, F.col("k"), ROWS)
    rows = texts.join(F.broadcast(narrow), ["id", "k"]).dropDuplicates(["id", "k"]).select("h", "y", "t")
    rows, path = written(rows, "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for h, y, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found.update((w, h % FOLDS, y) for w in {b"", *words_of(t)})
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w, _, _ in keys]), pa.array([f for _, f, _ in keys], pa.int64()), pa.array([y for _, _, y in keys], pa.int64()), pa.array(found.values(), pa.int64())], names=["word", "fold", "y", "n"])

    # A word's documents by fold and label: clean ones, then toxic ones.
    sums = rows.mapInArrow(count, "word string, fold long, y long, n long").groupBy("word").agg(*[F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{y}{f}") for y in (0, 1) for f in range(FOLDS)])
    sums, counted = written(sums, "words")
    first = sums.where("word = ''").first()
    totals = np.array(first[1:], float).reshape(2, FOLDS) if first else np.zeros((2, FOLDS))
    without = [None, *range(FOLDS)]  # of all rows, and of all but a fold

    def odds(n, fold, log):
        """Log odds of a word, and their standard error squared, of counts by label and fold."""
        clean, toxic = (sum(n[y][f] for f in range(FOLDS) if f != fold) for y in (0, 1))
        all_clean, all_toxic = (sum(totals[y][f] for f in range(FOLDS) if f != fold) for y in (0, 1))
        return log((toxic + 0.5) / (all_toxic + 1.0)) - log((clean + 0.5) / (all_clean + 1.0)), 1 / (toxic + 0.5) + 1 / (clean + 0.5)

    stands = F.lit(False)
    for fold_ in without:
        o, e = odds([[F.col(f"n{y}{f}") for f in range(FOLDS)] for y in (0, 1)], fold_, lambda x: F.log(F.lit(x) if isinstance(x, float) else x))
        stands = stands | ((o >= LOG_ODDS) & (o * o >= ERRORS**2 * e))
    top = [(r["word"].encode(), np.array(r[1:], float).reshape(2, FOLDS)) for r in sums.where((F.col("word") != "") & stands).orderBy("word").collect()]
    lexicons = []
    for fold_ in without:
        found = {w: odds(n, fold_, np.log) for w, n in top}
        lexicons.append({w: float(o) for w, (o, e) in found.items() if o >= LOG_ODDS and o * o >= ERRORS**2 * e})
    strong = [float(np.quantile(list(x.values()), 0.7)) if x else 0.0 for x in lexicons]

    def kernel():
        pairs = list(zip(lexicons, strong, strict=True))
        return lambda texts: [[[v for x in features_by(t, pairs) for v in x] for t in texts]]

    table = append_from_text(rows, "t", ["h", "y"], [StructField("x", ArrayType(DoubleType()))], kernel).toPandas().sort_values(["h", "y"], kind="stable")
    for done in (path, counted):
        remove(docs.sparkSession, done)
    y, fold_of = table["y"].to_numpy(float), table["h"].to_numpy() % FOLDS
    x = np.array(table["x"].tolist(), float).reshape(len(y), len(without), len(FEATURES))
    if not len(y) or any(len(np.unique(y[fold_of != f])) < 2 for f in range(FOLDS)):
        return Model(lexicons[0], strong[0], Forest(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2))), np.empty(0), np.empty(0))
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        held = fold_of == k
        margin[held] = boost(x[~held, k + 1], y[~held]).margin(x[held, k + 1])
    return Model(lexicons[0], strong[0], boost(x[:, 0], y), *isotonic(margin, y))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` of every text.

    Defined cases: null and empty texts get the score of all-zero features;
    repeated rows each keep a row.  Kept columns named like a result are left
    out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel():
        held = shared.value

        def apply(texts):
            s = held.scores(texts)
            return [s.tolist(), (s >= 0.5).astype(int).tolist()]

        return apply

    return append_from_text(docs, text, docs.columns if keep is None else keep, [StructField("score", DoubleType()), StructField("predicted", IntegerType())], kernel)


def query(spark, sf_dir: str) -> DataFrame:
    """``op8_toxicity``: toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, model, keep=["doc_id"]).select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted")
