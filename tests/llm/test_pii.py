import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kairograph.llm import pii

from .conftest import texts

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
CASES = [
    "mail a@b.co or a@b.com_x@y.zz and @no.pe or x@y or a.b+c%d@e-f.gh.ij.",
    "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255 1.2.3.256 10.0.0.1x",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111  1111 1 1 23-4 5500005555555559",
    "call +1 (988) 555-2485, +12, +44 20 7946 0958 +1234567890123456 +1((((((",
    "IBAN DE89370400440532013000 and GB82 WEST 1234 5698 7654 32 and DE89370400440532013001",
    "ssn 123-45-6789 and 123-45-6789 too far from it; " + "x" * 60 + " 123-45-6789 social 000-12-1234",
    "9" * 5000 + " " + "a" * 20000 + "@" + "b." * 3000 + "c",
    "+1 555 555 5555@example.com 4111111111111111@1.2.3.4",
    "é" * 10 + " 😀 x@y.zz 😀 1.2.3.4",
]


def luhn(d):
    return sum((v * 2 - 9 if v > 4 else v * 2) if i % 2 else v for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def slow(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            g, d = m.group(), re.sub(r"[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in g.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    return {r["doc_id"]: r["s"] for r in df.select("doc_id", pii.joined(pii.spans(F.col("text"))).alias("s")).collect()}


def test_base_spans(found):
    for i, t in enumerate(CASES):
        base = [x for x in found[i].split(",") if x.split(":")[0] in BASE]
        assert base == slow(t), t[:80]


def test_added_spans(found):
    assert [x for x in found[4].split(",") if x.startswith("iban")] == ["iban:5:27", "iban:32:59"]
    assert [x for x in found[5].split(",") if x.startswith("ssn")] == ["ssn:4:15"]


def test_query_columns(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = pii.query(spark, str(tmp_path)).collect()
    expected = {(r[0], hashlib.sha256(",".join(slow(r[1])).encode()).hexdigest()) for r in texts()}
    assert {(r["doc_id"], r["base_sha256"]) for r in rows} == expected and len(rows) == len(texts())


def test_redaction(spark, docs, none, clashing):
    df = spark.createDataFrame([(1, CASES[0]), (2, CASES[8]), (3, None), (4, "no data"), (5, CASES[7])], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got[1] == "mail <EMAIL> or <EMAIL><EMAIL> and @no.pe or x@y or <EMAIL>."
    assert got[2] == "é" * 10 + " 😀 <EMAIL> 😀 <IP>" and got[3] is None and got[4] == "no data"
    assert "@" not in got[5] and "4111" not in got[5]
    assert pii.redact(none).count() == 0 and pii.redact(clashing).columns == clashing.columns
    assert pii.redact(docs).count() == docs.count()


def test_no_python_in_the_plan(docs, capsys):
    docs.select(pii.spans(F.col("text"))).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_checksums(spark):
    row = spark.range(1).select(*[pii.luhn(F.lit(x)).alias(f"l{x}") for x in ("4111111111111111", "4111111111111112", "0")], *[pii.mod97(F.lit(x)).alias(x) for x in ("DE89370400440532013000", "DE89370400440532013001")]).first()
    assert tuple(row) == (True, False, True, True, False)


def test_card_of_single_separated_digits(spark):
    """No two digits side by side anywhere in the text."""
    rows = [(f"card {sep.join('4' + '1' * 15)} end",) for sep in " -"]
    out = pii.redact(pii.find(spark.createDataFrame(rows, "text string"))).collect()
    assert [[(s["kind"], s["start"], s["end"]) for s in r["pii_spans"]] for r in out] == [[("card", 5, 36)]] * 2
    assert [r["text"] for r in out] == ["card <CARD> end"] * 2


def test_account_numbers_end_with_their_countrys_length(spark):
    cases = ["pay DE89 3704 0044 0532 0130 00 BIC COBADEFF", "GB82WEST12345698765432THEN", "NO9386011117947 AND MORE", "XX89370400440532013000"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    found = {r[0]: [x for x in r[1].split(",") if x.startswith("iban")] for r in df.select("doc_id", pii.joined(pii.spans(F.col("text")))).collect()}
    assert found == {0: ["iban:4:31"], 1: [], 2: ["iban:0:15"], 3: []}


def test_context_decides_on_secrets(spark):
    cases = ['api token = "7f5790b897549d620aedfc0705a565f96e3741e8"', 'commit 7f5790b897549d620aedfc0705a565f96e3741e8', "password aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    assert [r[0] for r in df.orderBy("doc_id").select(F.size(F.filter(pii.spans(F.col("text")), lambda s: s["kind"] == "secret"))).collect()] == [1, 0, 0]


def slow_redacted(text, found):
    out, at, spans = "", 0, sorted(found, key=lambda s: (s[1], -s[2], s[0]))
    for kind, start, end in spans:
        if start >= at:
            out += text[at:start] + f"<{kind.upper()}>"
        at = max(at, end)
    return out + text[at:]


def test_redaction_matches_a_walk_and_takes_ten_thousand_spans(spark):
    import time

    many = " ".join(f"é{i} u{i}@x.yy 10.0.{i % 300}.1 +1 555 {i:07d}@b.cc" for i in range(3500))
    cases = [*CASES, many, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.redact(pii.find(df).withColumn("old", F.col("text"))).collect()}
    assert len(got[len(CASES)]["pii_spans"]) >= 10_000 and time.time() - began < 60
    for i, t in enumerate(cases):
        assert got[i]["text"] == (None if t is None else slow_redacted(t, [(s["kind"], s["start"], s["end"]) for s in got[i]["pii_spans"]]))
