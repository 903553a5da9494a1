"""Token counts by a byte-level BPE tokenizer file, exact for documents of any length.

Ordinary texts: a space between two characters that are not white space always
begins a pre-token of this kind of tokenizer, whatever stands around it, so the
text's words are counted by the library one by one and counts are kept.  Texts
with other white space runs or special strings go to the library whole.

Huge documents are encoded in overlapping chunks with offsets.  A boundary in an
overlap is stable if both chunks begin a pre-token there and it is far enough
from the first chunk's cut: pre-tokens are matched from left to right, so both
go on alike behind it, and what the first chunk has before it is right by
induction.  Chunks are spliced there.  Without such a boundary the overlap is
widened, at last to the end of the text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField

from .common import append_from_text

LIMIT = 1024
#: Characters from which a text is huge, of a chunk, and of the first overlap.
HUGE, CHUNK, OVERLAP = 65_536, 32_768, 256
#: Most words whose counts a task keeps, and words that one text joins to learn their counts.
WORDS, JOINED = 400_000, 256

_RUNS = re.compile(r"\s\s|^\s|\s$")


class Counter:
    """The library's counts for texts, without begin, end or added special tokens."""

    def __init__(self, tokenizer: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.library.no_padding()
        self.library.no_truncation()
        parsed = json.loads(tokenizer)
        self.special = [x["content"] for x in parsed.get("added_tokens") or []]
        kind = parsed.get("pre_tokenizer") or {}
        self.by_word = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and not parsed.get("normalizer")
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.margin = 2 + max(map(len, self.special), default=0)
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        words: list[tuple[int, list[str]]] = []
        rest: list[int] = []
        for i, t in enumerate(texts):
            if len(t) > self.huge:
                out[i] = self.spliced(t)
            elif self.by_word and t and not _RUNS.search(t) and not any(s in t for s in self.special):
                words.append((i, t.split(" ")))
            else:
                rest.append(i)
        for i, n in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = n
        self._learn(self.first, {x[0] for _, x in words}, self.whole)
        self._learn(self.later, {w for _, x in words for w in x[1:]}, self.after_space)
        later = self.later.__getitem__
        for i, x in words:
            out[i] = self.first[x[0]] + sum(map(later, x[1:]))
        return out

    def _learn(self, known: dict[str, int], needed: set[str], count) -> None:
        if len(known) > WORDS:
            known.clear()
        fresh = list(needed - known.keys())
        known.update(zip(fresh, count(fresh), strict=True))

    def after_space(self, words: list[str]) -> list[int]:
        """Counts of words that follow a space, from texts that join many of them."""
        blocks = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out: list[int] = []
        for block, e in zip(blocks, self.library.encode_batch([" " + " ".join(x) for x in blocks], add_special_tokens=False), strict=True):
            begins = np.cumsum([0, *(len(w) + 1 for w in block[:-1])])
            at = np.searchsorted(begins, np.array([x[0] for x in e.offsets], np.int64), side="right") - 1
            out += np.bincount(at, minlength=len(block)).tolist()
        return out

    def _encoded(self, text: str, begin: int, end: int) -> tuple[list[int], list[int], int]:
        """Starts of pre-tokens, tokens before each, and all tokens of a chunk."""
        e = self.library.encode(text[begin:end], add_special_tokens=False)
        starts, before, last = [], [], object()
        for i, (word, (at, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if (word is None or word != last) and not text[begin + at : begin + at + 1].isspace():
                starts.append(begin + at)
                before.append(i)
            last = word
        return starts, before, len(e.ids)

    def spliced(self, text: str) -> int:
        """Count of a huge text from overlapping chunks."""
        total, begin, skip = 0, 0, 0
        while True:
            cut, overlap = begin + self.chunk, self.overlap
            while True:
                end = min(len(text), cut + overlap)
                starts, before, n = self._encoded(text, begin, end)
                if end == len(text):
                    return total + n - skip
                mine = {s: b for s, b in zip(starts, before, strict=True) if cut <= s <= end - self.margin}
                other_starts, other_before, _ = self._encoded(text, cut, min(len(text), cut + 2 * overlap + self.margin))
                shared = [(s, b) for s, b in zip(other_starts, other_before, strict=True) if s > cut and s in mine]
                if shared:
                    break
                overlap *= 4
            at, ahead = shared[0]
            total += mine[at] - skip
            begin, skip = cut, ahead


def tokenizer_text(path: str | None = None) -> str:
    """A tokenizer file on the driver; by default the public 50k byte-level BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``keep`` columns, ``n_bytes, n_tokens, over_limit`` of every text.

    Defined cases: null counts as the empty text, with no bytes and no tokens;
    repeated rows each keep a row.  Kept columns named like a result are left
    out.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_text(path))
    fields = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]

    def kernel():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(shared.value)

        def apply(texts):
            n = counter.counts([(t or b"").decode("utf-8", "replace") for t in texts])
            return [[len(t or b"") for t in texts], n, [x > limit for x in n]]

        return apply

    return append_from_text(df, text, df.columns if keep is None else keep, fields, kernel)


def query(spark, sf_dir: str) -> DataFrame:
    """``op4_token_counts``: tokens of every document."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
