import random

import pytest
import public_tokenizers
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from kairograph.llm import sentencepiece_scan as P
from kairograph.llm import token_counts as T

from .conftest import prose, texts

ODD = ["", " ", "  two  spaces ", "tabs\tand\n\nlines \n x", "<|endoftext|> in text<|endoftext|>", "☃ snow ☃☃", "a" * 300, "don't we're I'll", " nbsp　x", "▁ low", "x ▁y", "12 345,678.90", "aaaa    " * 30, "\r\n \r\n"]


def counts(library, xs):
    return [len(e.ids) for e in library.encode_batch(xs, add_special_tokens=False)]


def test_counts_match_the_library(docs, clashing):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sorted(((r[0], len((r[1] or "").encode()), n, n > 1024) for r, n in zip(texts(), counts(library, [r[1] or "" for r in texts()]))), key=str)
    assert sorted((tuple(r) for r in T.count_tokens(docs, keep=["doc_id"]).collect()), key=str) == expected
    assert T.count_tokens(clashing).count() == len(expected)


def test_no_rows(none):
    assert T.count_tokens(none).count() == 0
    assert P.encode_decode(none).count() == 0


def test_resynchronised_chunks():
    rng = random.Random(3)
    c = T.Counter(T.tokenizer_text(), huge=0)
    pieces = [*ODD, prose(40, 7), prose(80, 2).replace(" ", "  "), "x" * 700 + " y", " \n" * 60]
    for _ in range(120):
        c.chunk, c.overlap = rng.choice([5, 23, 70, 200]), rng.choice([1, 4, 16, 64])
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
        assert c.spliced(text) == counts(c.library, [text])[0]


def test_ordinary_texts_by_word():
    c = T.Counter(T.tokenizer_text())
    assert c.counts(ODD + [prose(50, 3)]) == counts(c.library, ODD + [prose(50, 3)])


@pytest.fixture(scope="module")
def model():
    return P.Model(P.model_proto())


def test_pieces_match_the_library(model, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {(r["doc_id"], r["decoded"]): r for r in P.encode_decode(docs, keep=["doc_id"]).collect()}
    for r in texts():
        row = got[(r[0], r[1] or "")]
        assert row["ids"] == library.encode(r[1] or "") and row["round_trip"]
    assert model.encode_all(ODD) == [library.encode(x) for x in ODD]


def test_chunks_give_the_librarys_bpe(model):
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice([*ODD, prose(30, 5), "ththth" * 9]) for _ in range(rng.randint(1, 4)))
        assert model.encode(text, giant=0, chunk=rng.choice([1, 2, 3, 7, 20, 64])) == model.library.encode(text)


def test_chunks_give_the_best_unigram_score():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(P.model_proto())
    proto.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    for i, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = -3.0 - (i * 7919 % 10007) / 1009
    model, rng = P.Model(proto.SerializeToString()), random.Random(8)
    total = lambda ids: sum(proto.pieces[i].score for i in ids)
    for _ in range(40):
        text = prose(rng.randint(1, 60), rng.randint(1, 9))
        mine, other = model.encode(text, giant=0, chunk=rng.choice([1, 5, 33, 128])), model.library.encode(text)
        assert total(mine) == pytest.approx(total(other), abs=1e-3) and model.decode(mine) == text


def test_matrices_combine_in_any_order(model):
    text = model.prefix + prose(40, 3).replace(" ", P.SPACE)
    cuts = [0, 11, 40, 77, len(text)]
    states = [[("", 0)], *(model.states(text, at) for at in cuts[1:-1])]
    a, b, c, d = (P.Chunk(model, text, cuts[i], cuts[i + 1], states[i]).matrix for i in range(4))
    assert P.combine(P.combine(P.combine(a, b), c), d) == P.combine(a, P.combine(b, P.combine(c, d))) == P.combine(P.combine(a, b), P.combine(c, d))


def test_words_are_cached_only_where_no_merge_crosses_them(model):
    rng = random.Random(11)
    assert model.encode_all(["a▁ ▁b"]) == [model.library.encode("a▁ ▁b")]
    xs = ["".join(rng.choice(["a", "b", "the", " ", " ", "▁", "▁▁", "é", "\n"]) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    assert model.encode_all(xs) == [model.library.encode(x) for x in xs]


def test_giant_texts_are_scanned_as_rows(spark, model):
    rng = random.Random(5)
    xs = ["".join(rng.choice([*ODD, prose(60, 5), "▁▁ ▁", "ththth" * 9]) for _ in range(rng.randint(1, 12))) for _ in range(30)]
    rows = [(i, x, "x") for i, x in enumerate([*xs, xs[0], prose(3000, 2), None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string").withColumnsRenamed({"rid": "parts"}).selectExpr("*", "'y' AS rid", "'z' AS k", "'z' AS t")
    found = P.encode_decode(df, giant=100, chunk=37)
    assert found.columns == ["doc_id", "text", "parts", "rid", "k", "t", "n_pieces", "ids", "decoded", "round_trip"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(rows)
    for i, x, _ in rows:
        assert got[i]["ids"] == model.library.encode(x or "") and got[i]["decoded"] == model.library.decode(got[i]["ids"])
        assert got[i]["round_trip"] == ("▁" not in (x or "")) and got[i]["text"] == x


def test_many_chunks_combine_level_by_level(spark, model):
    text = prose(900, 4)
    df = spark.createDataFrame([("a", text), ("b", "x" * 50)], "rid string, t string")
    shared = spark.sparkContext.broadcast(P.model_proto())
    got = {r["rid"]: P.join_parts([list(x) for x in r["parts"]], model.unknown) for r in P.encode_giants(df, shared, chunk=29, fan=4).collect()}
    assert got == {"a": model.library.encode(text), "b": model.library.encode("x" * 50)}
