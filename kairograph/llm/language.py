"""Language identification with one bit-sliced Bloom filter for all languages.

Each slot of the filter holds a bit per language.  A query ands the slots of an
n-gram and so gets all languages that contain it at once.  A text's n-grams are
counted per language by the bits of those masks, the counts are corrected for
the filter's false positives, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .common import append_from_text, c, least_hashes

#: The fit reads this many labelled documents of each language at most, chosen by hash of the id.
DOCS_PER_LANGUAGE = 1500
#: Most bytes of the filter, which every worker holds.
MOST_BYTES = 1 << 28
#: An n-gram belongs to a language if its rate there is this share of its highest rate.
RATE_SHARE = 0.35
#: Hash functions, and slots for each n-gram in the filter.
HASHES, SLOTS_EACH = 3, 12
#: The pipeline keeps a document if this share of its n-grams belongs to the predicted language.
LEAST_COVERAGE = 0.15
UNKNOWN = "und"

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class _Letters:
    """Which code points are letters, worked out page by page as texts need them."""

    def __init__(self) -> None:
        self.table = np.zeros(0x110000, bool)
        self.known = np.zeros(0x110000 >> 8, bool)

    def of(self, codes: np.ndarray) -> np.ndarray:
        seen = codes >> 8
        for page in np.flatnonzero(np.bincount(seen, minlength=1).astype(bool) & ~self.known[: int(seen.max(initial=0)) + 1]).tolist():
            self.table[page << 8 : (page + 1) << 8] = [chr(i).isalpha() for i in range(page << 8, (page + 1) << 8)]
            self.known[page] = True
        return self.table[codes]


def trigrams(text: bytes | None, letters: _Letters) -> np.ndarray:
    """Packed letter trigrams of the lower-cased text, word edges as spaces; empty if it has no letter."""
    codes = np.frombuffer(f" {(text or b'').decode('utf-8', 'replace').lower()} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    inside = letters.of(codes)
    codes = np.where(inside, codes, 32)
    full = inside[1:-1] & (inside[:-2] | inside[2:])  # the middle is a letter, and one neighbour too
    return ((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[full].astype(np.uint64)


def has_letter(text: bytes | None) -> bool:
    return any(x.isalpha() for x in (text or b"").decode("utf-8", "replace"))


class Filter:
    """Bit-sliced Bloom filter: slots of language bits, as many words as the languages need."""

    def __init__(self, languages: list[str], members: dict[str, np.ndarray]) -> None:
        self.languages = languages
        total = sum(map(len, members.values()))
        self.bits = max(10, int(np.ceil(np.log2(max(1, total) * SLOTS_EACH))))
        size = (len(languages) + 63) // 64 * 8 << self.bits
        if size > MOST_BYTES:
            raise ValueError(f"the filter of {total} n-grams of {len(languages)} languages takes {size} bytes; lower DOCS_PER_LANGUAGE")
        self.slots = np.zeros((1 << self.bits, (len(languages) + 63) // 64), np.uint64)
        for i, name in enumerate(languages):
            for at in self._places(members.get(name, np.empty(0, np.uint64))):
                self.slots[at, i // 64] |= np.uint64(1 << (i % 64))
        self.false_rate = np.array([float(self._bit(self.slots, i).mean()) ** HASHES for i in range(len(languages))])

    def _places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        for mix in _MIX[:HASHES]:
            h = grams * np.uint64(mix)
            yield ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)

    @staticmethod
    def _bit(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Languages that contain each n-gram, as bits."""
        out = np.full((len(grams), self.slots.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in self._places(grams):
            out &= self.slots[at]
        return out

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """N-grams of each language, corrected for false positives."""
        masks, n = self.masks(grams), len(grams)
        raw = np.array([self._bit(masks, i).sum() for i in range(len(self.languages))], float)
        return np.clip((raw - n * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate), 0, n)

    def predict(self, text: bytes | None, letters: _Letters) -> tuple[str, float, float]:
        """Language, its share of all languages' counts, and of the text's n-grams."""
        grams = trigrams(text, letters)
        if not self.languages or (not len(grams) and not has_letter(text)):
            return UNKNOWN, 0.0, 0.0
        counts = self.counts(grams)
        best = int(np.argmax(counts))
        total = float(counts.sum())
        return self.languages[best], float(counts[best]) / total if total else 0.0, float(counts[best]) / max(1, len(grams))


def fold(doc_id: Column, n: int) -> Column:
    """CRC-32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Filter:
    """The filter of the documents whose fold (modulo 3) is not 1 and whose ``lang`` is not null.

    Of each language the ``DOCS_PER_LANGUAGE`` documents with the smallest
    hashes of their ids are read, whole.  A language's n-grams and their counts
    are summed on the cluster; the driver gets all of them, which the bounded
    documents bound.  A filter over ``MOST_BYTES`` is refused.  Without labelled
    rows the filter is empty and all is ``und``.
    """
    rows = docs.where((fold(c(doc_id), 3) != 1) & c(lang).isNotNull() & c(text).isNotNull())
    chosen = least_hashes(rows.select(c(lang).alias("lang"), c(doc_id).alias("id")), F.col("id"), DOCS_PER_LANGUAGE, "lang")
    texts = rows.select(c(doc_id).alias("id"), c(lang).alias("lang"), c(text).cast("binary").alias("t")).join(F.broadcast(chosen.select("id", "lang").distinct()), ["id", "lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _Letters()
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(trigrams(t, letters))
            for name, parts in by.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    table = texts.select("lang", "t").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, grams, n = np.array(table["lang"].to_pylist(), object), table["gram"].to_numpy(), table["n"].to_numpy().astype(float)
    languages = sorted(set(names.tolist()))
    distinct, at = np.unique(grams, return_inverse=True)
    rate = np.array([n[i] for i in range(len(n))])
    for name in languages:
        rate[names == name] /= n[names == name].sum()
    highest = np.zeros(len(distinct))
    np.maximum.at(highest, at, rate)
    own = rate >= RATE_SHARE * highest[at] if len(at) else np.empty(0, bool)
    return Filter(languages, {name: grams[own & (names == name)].astype(np.int64).view(np.uint64) for name in languages})


def identify(docs: DataFrame, model: Filter, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` and ``coverage`` of every text.

    ``score`` is the language's share of all languages' corrected counts,
    ``coverage`` its share of the text's n-grams.  Defined cases: null texts and
    texts without a letter are ``und`` with 0; single letters only go to the
    first language with 0; ties go to the first language by name; repeated rows
    each keep a row.  Kept columns named like a result are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("coverage", DoubleType())]

    def kernel():
        filter_, letters = shared.value, _Letters()
        return lambda texts: list(map(list, zip(*(filter_.predict(t, letters) for t in texts), strict=True)))

    return append_from_text(docs, text, docs.columns if keep is None else keep, fields, kernel)


def query(spark, sf_dir: str) -> DataFrame:
    """``op10_language``: the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, fit(docs), keep=["doc_id"]).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
