"""SentencePiece encoding and decoding, exact for documents of any length.

Texts up to ``GIANT`` characters go to the library whole.  Longer ones are
split into chunks of ``CHUNK`` characters, each a row of its own.  The state at
a boundary is the piece that crosses or ends at it, with its overhang.  Each
chunk yields a max-plus transfer matrix from the states at its left boundary to
those at its right one.  Matrices combine associatively, ``FAN`` neighbours at a
time, up to one for the document; the way back down picks the state at every
boundary, and each chunk is then traced back on its own.  All three passes run
over the chunks in parallel, and no task holds more than ``FAN`` matrices.

For a unigram model the entries are path scores.  For a BPE model they are 0 or
minus infinity: a sequence of pieces is the BPE encoding exactly when every two
neighbours are compatible, that is, when merging the two pieces' characters
gives those two pieces again.  So the encoding is the only path without an
incompatible pair, and the same scan finds it.

Only models with identity normalisation are taken; others raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField

from .common import append_from_text, c, written

#: Characters from which a text is split, and of a chunk.
GIANT, CHUNK = 65_536, 16_384
#: Neighbouring matrices that a task combines, and words whose encodings a task keeps.
FAN, WORDS = 64, 300_000
#: Chunks of a task, while there are no more than so many tasks for each core.
EACH, WAVES = 8, 16
SPACE = "▁"
_NO = float("-inf")


class Model:
    """Pieces and scores of a model file, and the library's processor for ordinary texts."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        parsed = sentencepiece_model_pb2.ModelProto()
        parsed.ParseFromString(proto)
        if parsed.normalizer_spec.precompiled_charsmap or parsed.normalizer_spec.remove_extra_whitespaces or parsed.trainer_spec.treat_whitespace_as_suffix or not parsed.normalizer_spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.prefix = SPACE if parsed.normalizer_spec.add_dummy_prefix else ""
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in parsed.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        self.ids = {p.piece: i for i, p in enumerate(parsed.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in parsed.pieces if p.type == kinds.NORMAL}
        self.bpe = parsed.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(parsed.pieces) if p.type == kinds.BYTE}
        self.unknown = self.library.unk_id()
        self.unknown_score = min(self.scores.values(), default=0.0) - 10.0
        self.longest = max(map(len, self.ids), default=1)
        self.starts = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        # Without a piece that goes on behind a word's end, words are encoded on their own and kept.
        self.by_word = self.bpe and bool(self.prefix) and not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: Ids of words, as 32-bit numbers.
        self._words: dict[str, bytes] = {}
        self._fits: dict[tuple[str, str], bool] = {}

    # Lattice

    def pieces_at(self, text: str, at: int) -> list[str]:
        """Pieces that start here; a character that none covers stands alone."""
        out, n = [], 1
        while at + n <= len(text) and text[at : at + n] in self.starts:
            if text[at : at + n] in self.ids:
                out.append(text[at : at + n])
            n += 1
        if not out or len(out[0]) > 1:
            out.insert(0, text[at])
        return out

    def weight(self, piece: str) -> float:
        return 0.0 if self.bpe else self.scores.get(piece, self.unknown_score)

    def fits(self, left: str, right: str) -> bool:
        """Whether two neighbours may stand together."""
        if not self.bpe:
            return True
        key = (left, right)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self.merged(left + right) == [left, right]
        return known

    def merged(self, text: str) -> list[str]:
        """BPE of a short string: merge the best-scored neighbours, leftmost first."""
        parts = list(text)
        while True:
            best, at = _NO, -1
            for i in range(len(parts) - 1):
                if (s := self.scores.get(parts[i] + parts[i + 1], _NO)) > best:
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    # Scan

    def encode(self, text: str, giant: int = GIANT, chunk: int = CHUNK) -> list[int]:
        if len(text) <= giant:
            return self.library.encode(text)
        whole, cuts = self.cut(text, chunk)
        states = [[("", 0)], *(self.states(whole, at) for at in cuts[1:-1])]
        parts = [Chunk(self, whole, cuts[i], cuts[i + 1], states[i]) for i in range(len(cuts) - 1)]
        chosen = scan([p.matrix for p in parts])
        pieces: list[str] = []
        for part, (left, right) in zip(parts, zip(chosen, chosen[1:], strict=False), strict=True):
            pieces += part.trace(left, right)
        return self.to_ids(pieces)

    def cut(self, text: str, chunk: int) -> tuple[str, list[int]]:
        """The text as the lattice has it, and the boundaries of its chunks."""
        whole = self.prefix + text.replace(" ", SPACE)
        return whole, [*range(0, len(whole), chunk), len(whole)]

    def states(self, text: str, at: int) -> list[tuple[str, int]]:
        """Pieces that end at or cross a boundary, with their overhang."""
        return [(p, begin + len(p) - at) for begin in range(max(0, at - self.longest), at) for p in self.pieces_at(text, begin) if begin + len(p) >= at]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """``encode`` of each text; ordinary texts share the encodings of their words."""
        # A space symbol of the text's own may join a word to the space before it.
        plain = [self.by_word and len(t) <= GIANT and SPACE not in t and "  " not in t and t[:1] != " " and t[-1:] not in ("", " ") for t in texts]
        split = [t.split(" ") if p else None for t, p in zip(texts, plain, strict=True)]
        if len(self._words) > WORDS:
            self._words.clear()
        if fresh := [w for w in {w for x in split if x for w in x} if w not in self._words]:
            self._words.update((w, array("i", x).tobytes()) for w, x in zip(fresh, self.library.encode(fresh, num_threads=1), strict=True))
        word = self._words.__getitem__
        return [self.encode(t) if x is None else np.frombuffer(b"".join(map(word, x)), np.int32).tolist() for t, x in zip(texts, split, strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


State = tuple[str, int]


class Chunk:
    """Forward pass from every left state at once; ``matrix`` maps left to right states and scores."""

    def __init__(self, model: Model, text: str, begin: int, end: int, left: list[State]) -> None:
        self.model, self.text, self.begin, self.end = model, text, begin, end
        # Only left states that some path reaches matter to a position, so scores are kept by left state.
        self.cells: list[dict[str, dict[State, float]]] = [{} for _ in range(end - begin + model.longest + 1)]
        self.matrix: dict[State, dict[State, float]] = {s: {} for s in left}
        for s in left:
            if s[1] >= end - begin and begin + s[1] > end:
                self.matrix[s][(s[0], begin + s[1] - end)] = 0.0  # the piece spans the whole chunk
            else:
                self.cells[s[1]].setdefault(s[0], {})[s] = 0.0
        for at in range(end - begin):
            before = self.cells[at]
            if not before:
                continue
            for piece in model.pieces_at(text, begin + at):
                w, into = model.weight(piece), self.cells[at + len(piece)]
                for last, scores in before.items():
                    if last == "" or model.fits(last, piece):
                        here = into.setdefault(piece, {})
                        for s, v in scores.items():
                            if v + w > here.get(s, _NO):
                                here[s] = v + w
        for over in range(model.longest + 1):
            for last, scores in self.cells[end - begin + over].items():
                for s, v in scores.items():
                    if v > self.matrix[s].get((last, over), _NO):
                        self.matrix[s][(last, over)] = v

    def trace(self, left: State, right: State) -> list[str]:
        """Pieces that start inside the chunk on the best path between two states."""
        out: list[str] = []
        at, piece = self.end - self.begin + right[1], right[0]
        while piece and at >= len(piece):  # a left state's piece starts before the chunk
            out.append(piece)
            at -= len(piece)
            before = {last: v[left] for last, v in self.cells[at].items() if left in v and (last == "" or self.model.fits(last, piece))}
            piece = max(before, key=before.get)
        return out[::-1]


def combine(a: dict, b: dict) -> dict:
    """Max-plus product of two transfer matrices."""
    out: dict = {}
    for i, row in a.items():
        into = out[i] = {}
        for j, v in row.items():
            for k, w in b.get(j, {}).items():
                if v + w > into.get(k, _NO):
                    into[k] = v + w
    return out


def scan(matrices: list[dict], ends: tuple[State, State] | None = None) -> list[State]:
    """The best state at every boundary, by an associative up-sweep and a down-sweep over the tree.

    Without ``ends`` the matrices are a whole document's.
    """

    def build(lo: int, hi: int):
        if hi - lo == 1:
            return matrices[lo], lo, None, None
        mid = (lo + hi) // 2
        a, b = build(lo, mid), build(mid, hi)
        return combine(a[0], b[0]), mid, a, b

    chosen: list = [None] * (len(matrices) + 1)

    def descend(node, lo: int, hi: int) -> None:
        _, mid, a, b = node
        if a is None:
            return
        first = a[0][chosen[lo]]
        chosen[mid] = max((j for j in first if chosen[hi] in b[0].get(j, {})), key=lambda j: first[j] + b[0][j][chosen[hi]])
        descend(a, lo, mid)
        descend(b, mid, hi)

    root = build(0, len(matrices))
    chosen[0], chosen[-1] = ends or best_ends(root[0])
    descend(root, 0, len(matrices))
    return chosen


def best_ends(matrix: dict) -> tuple[State, State]:
    """First and last state of a document's matrix: its only first one, and the best that ends with the text."""
    first = next(iter(matrix))
    ends = {s: v for s, v in matrix[first].items() if s[1] == 0}
    return first, max(ends, key=ends.get)


def combined(matrices: list[dict]) -> dict:
    """The product of neighbouring matrices, as a tree."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def _packed(matrix: dict) -> str:
    return json.dumps([[*i, *j, v] for i, row in matrix.items() for j, v in row.items()])


def _unpacked(packed: str) -> dict:
    out: dict = {}
    for a, b, x, y, v in json.loads(packed):
        out.setdefault((a, b), {})[(x, y)] = v
    return out


def _each_row(df: DataFrame, schema: str, start: Callable[[], Callable[[tuple], Iterator[tuple]]]) -> DataFrame:
    """Rows made of each row, one at a time; ``start()`` is called once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = start()
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(made(tuple(x[k].as_py() for x in batch.columns)))
                yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds)

    kinds = _arrow_schema(schema)
    return df.mapInArrow(run, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _each_group(df: DataFrame, by: list[str], schema: str, made: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """Rows made of the rows of each group, in the order of ``k``."""
    kinds = _arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        rows = made(table.sort_by("k").to_pylist())
        return pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds)

    return df.groupBy(*by).applyInArrow(run, schema)


def _chunk_of(model: Model, k: int, begin: int, length: int, seg: str, left: list[State] | None = None) -> Chunk:
    """The chunk at ``begin`` of a segment that has the text around it."""
    left = left or ([("", 0)] if k == 0 else model.states(seg, begin))
    return Chunk(model, seg, begin, begin + length, left)


def encode_giants(rows: DataFrame, shared, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``rid, ids`` of the texts ``t`` of ``rid, t``; ids of rows are distinct, and ``rows`` gives the same on each read."""

    def split():
        model = Model(shared.value)

        def made(row):
            whole, cuts = model.cut(row[1], chunk)
            for k in range(len(cuts) - 1):
                before = max(0, cuts[k] - model.longest)
                yield row[0], k, cuts[k] - before, cuts[k + 1] - cuts[k], whole[before : cuts[k + 1] + model.longest]

        return made

    def matrix():
        model = Model(shared.value)
        return lambda row: iter([(row[0], row[1], _packed(_chunk_of(model, *row[1:]).matrix))])

    def up(group):
        return [(group[0]["rid"], group[0]["g"], _packed(combined([_unpacked(x["m"]) for x in group])))]

    def down(group):
        states = scan([_unpacked(x["m"]) for x in group], tuple(tuple(json.loads(group[0][x])) for x in ("l", "r")))
        return [(x["rid"], x["k"], json.dumps(states[i]), json.dumps(states[i + 1])) for i, x in enumerate(group)]

    def top(row):
        return iter([(row[0], row[1], *(json.dumps(x) for x in best_ends(_unpacked(row[2]))))])

    def trace():
        model = Model(shared.value)

        def made(row):
            left, right = (tuple(json.loads(x)) for x in row[5:7])
            yield row[0], row[1], model.to_ids(_chunk_of(model, *row[1:5], left=[left]).trace(left, right))

        return made

    chunks, _ = written(_each_row(rows.select("rid", "t"), "rid string, k long, begin long, length long, seg string", split).repartition("rid", "k"), "chunks")
    tasks = max(1, min(-(-chunks.count() // EACH), WAVES * rows.sparkSession.sparkContext.defaultParallelism))
    chunks = chunks.repartition(tasks, "rid", "k")
    levels = [written(_each_row(chunks, "rid string, k long, m string", matrix), "matrices")[0]]
    g = F.floor(F.col("k") / fan).cast("long")
    while (levels[-1].agg(F.max("k")).first()[0] or 0) > 0:
        levels.append(written(_each_group(levels[-1].withColumn("g", g), ["rid", "g"], "rid string, k long, m string", up), "matrices")[0])
    chosen = _each_row(levels[-1], "rid string, k long, l string, r string", lambda: top)
    for level in levels[-2::-1]:
        both = level.withColumn("g", g).join(chosen.select("rid", F.col("k").alias("g"), "l", "r"), ["rid", "g"])
        chosen, _ = written(_each_group(both, ["rid", "g"], "rid string, k long, l string, r string", down), "states")
    traced = _each_row(chunks.join(chosen.repartition(tasks, "rid", "k"), ["rid", "k"]).select("rid", "k", "begin", "length", "seg", "l", "r"), "rid string, k long, ids array<int>", trace)
    return traced.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x")).select("rid", F.col("x.ids").alias("parts"))


def join_parts(parts: list[list[int]], unknown: int) -> list[int]:
    """Ids of neighbouring chunks; an unknown piece that goes on over a boundary is one."""
    out: list[int] = []
    for x in parts:
        out += x[1:] if out and x and out[-1] == x[0] == unknown else x
    return out


def model_proto(path: str | None = None) -> bytes:
    """Bytes of a model file on the driver; by default the public 32k BPE model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


_FIELDS = [StructField("n_pieces", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType()), StructField("round_trip", BooleanType())]


def _giant(text: Column, giant: int) -> Column:
    return F.coalesce(F.length(text) > giant, F.lit(False))


def encode_decode(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, digest: bool = False, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``keep`` columns, ``n_pieces, ids, decoded, round_trip`` of every text.

    With ``digest`` the ids and the decoded text are replaced by ``ids_sha256``
    (of the comma-joined ids) and ``decoded_sha256``.  Texts over ``giant``
    characters are written to the shared folder, narrowed to themselves and
    ``keep``, and scanned there.  Defined cases: null is encoded as the empty
    text, which has no pieces and decodes to itself; the library's space symbol
    inside a text decodes to a space, so only there ``round_trip`` is false;
    repeated rows each keep a row.  Kept columns named like a result are left
    out, and any other name may clash with ours inside.
    """
    shared = df.sparkSession.sparkContext.broadcast(model_proto(path))
    fields = [_FIELDS[0], StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), _FIELDS[3]] if digest else _FIELDS
    names = {f.name for f in fields}
    keep = [k for k in (df.columns if keep is None else keep) if k.lower() not in names]
    own = [f"k{i}" for i in range(len(keep))]
    rows = df.select(*[c(k).alias(o) for k, o in zip(keep, own, strict=True)], c(text).cast("string").alias("t"))

    def sha(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    def results(model: Model, plain: list[str], ids: list[list[int]]) -> list[list]:
        back = model.library.decode(ids)
        trips = [a == b for a, b in zip(plain, back, strict=True)]
        if digest:
            return [[len(x) for x in ids], [sha(",".join(map(str, x))) for x in ids], [sha(x) for x in back], trips]
        return [[len(x) for x in ids], ids, back, trips]

    def ordinary():
        model = Model(shared.value)

        def apply(texts):
            plain = [(t or b"").decode("utf-8", "replace") for t in texts]
            return results(model, plain, model.encode_all(plain))

        return apply

    def scanned():
        model = Model(shared.value)

        def apply(packed):
            found = [json.loads(x) for x in packed]
            return results(model, [x["t"] for x in found], [join_parts(x["parts"], model.unknown) for x in found])

        return apply

    out = append_from_text(rows.where(~_giant(F.col("t"), giant)), "t", own, fields, ordinary)
    giants, _ = written(rows.where(_giant(F.col("t"), giant)).withColumn("rid", F.expr("uuid()")), "giants")
    if not giants.isEmpty():
        found = giants.join(encode_giants(giants, shared, chunk), "rid").withColumn("packed", F.to_json(F.struct("t", "parts")))
        out = out.union(append_from_text(found, "packed", own, fields, scanned))
    return out.toDF(*keep, *[f.name for f in fields])


def query(spark, sf_dir: str) -> DataFrame:
    """``op3_sentencepiece``: pieces of every document and whether they decode to it."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"], digest=True)
