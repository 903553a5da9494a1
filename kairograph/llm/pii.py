"""Personal data in texts, with Spark SQL functions only.

Regular expressions propose spans, checksum validators (Luhn, mod-97) confirm
them, and context words before a span adjust its score.  Positions come from
the pieces between matches: ``split`` and ``regexp_extract_all`` walk the same
matches, so lengths of pieces and matches add up to code point offsets.

The patterns are possessive and anchored at run starts, so that each is linear
in the text and needs no recursion, however long a run of digits or letters is.
Running sums over matches are made in blocks of the root of their number, so
that a text of very many spans costs no square.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import c

#: Characters before a span, back to the kind's last match, in which context words count, and what one adds.
CONTEXT, BOOST = 40, 0.35
#: A proposed span of an added kind is reported from this score on.
LEAST_SCORE = 0.5

DIGITS = "[^0-9]"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, DIGITS, "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).when(d.try_cast("int") > 4, d.try_cast("int") * 2 - 9).otherwise(d.try_cast("int") * 2),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces, in capitals, leaves 1 modulo 97."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def step(a, ch):
        v = F.ascii(ch)
        return F.when(v >= 65, (a * 100 + v - 55) % 97).otherwise((a * 10 + v - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), step) == 1


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, "[.]"), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))


def _digit_count(low: int, high: int):
    return lambda m: F.length(_digits(m)).between(low, high)


def _iban(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    return F.length(plain).between(15, 34) & mod97(plain)


def _mixed(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[A-Za-z]")


#: Lengths of account numbers (IBAN) and the countries that have them.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
#: A number ends with its country's length, whatever word follows.
_IBAN = r"\b(?:" + "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?:[\\x20]?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items()) + r")\b"


@dataclass(frozen=True)
class Kind:
    """``hint``: a cheap condition without which a text has no match."""

    name: str
    pattern: str
    hint: str
    valid: object
    score: float
    words: str
    base: bool = True


#: Kinds in the order of the results; fixed values of the contract and of public formats.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9, "mail|contact|write"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:[.][0-9]++){3}", "[0-9][.][0-9]", _octets, 0.6, "ip|address|host|server"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+", r"[0-9][\x20-]?[0-9]", lambda m: _digit_count(16, 19)(m) & luhn(_digits(m)), 0.8, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "[+][0-9]", _digit_count(8, 15), 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", _IBAN, "[A-Z]{2}[0-9]{2}", _iban, 0.8, "iban|account|bank", False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), 0.3, "ssn|social|security", False),
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+", "(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24}", _mixed, 0.2, "token|secret|password|passwd|credential|bearer|api.?key", False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, step) -> Column:
    """Each value joined by ``step`` to all before it (sums, maxima), in blocks; an empty array stays so."""
    none = F.expr("cast(array() as array<bigint>)")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    each = lambda block: F.aggregate(block, none, lambda acc, v: F.array_append(acc, F.when(F.size(acc) == 0, v).otherwise(step(last(acc), v))))

    def blocks(xs):
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(xs)), size), lambda b: each(F.slice(xs, b, size)))

    def joined_blocks(inner):
        # What the blocks before each one come to.
        carried = each(F.filter(F.transform(inner, last), lambda x: x.isNotNull()))
        return _bound(carried, lambda before: F.flatten(F.transform(inner, lambda block, i: _bound(F.get(before, i - 1), lambda b: F.transform(block, lambda v: F.when(b.isNull(), v).otherwise(step(b, v)))))))

    return _bound(_bound(values, blocks), joined_blocks)


def _spans_of(text: Column, kind: Kind) -> Column:
    """Array of (kind, start, end, score) of one kind, by start."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)
    empty = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,score:double>>)")

    def proposed(p, m):
        near = F.lower(F.right(p, F.lit(CONTEXT))).rlike(kind.words)
        score = F.lit(kind.score) + F.when(near, BOOST).otherwise(0.0)
        ok = F.coalesce(kind.valid(m), F.lit(False)) & (F.lit(kind.base) | (score >= LEAST_SCORE))
        return F.struct((F.length(p) + F.length(m)).cast("long").alias("both"), F.length(m).cast("long").alias("own"), F.least(score, F.lit(1.0)).alias("score"), ok.alias("ok"))

    def span(x, end):
        placed = F.struct(F.lit(kind.name).alias("kind"), (end - x["own"]).alias("start"), end.alias("end"), x["score"].alias("score"))
        return F.struct(x["ok"].alias("ok"), placed.alias("span"))

    pairs = F.zip_with(F.slice(between, 1, F.size(matches)), matches, proposed)
    placed = _bound(pairs, lambda xs: F.zip_with(xs, _running(F.transform(xs, lambda x: x["both"]), lambda a, b: a + b), span))
    found = F.transform(F.filter(placed, lambda x: x["ok"]), lambda x: x["span"])
    hinted = F.contains(text, F.lit("@")) if kind.hint == "@" else F.rlike(text, F.lit(kind.hint))
    return F.when(hinted, found).otherwise(empty)


def spans(text: Column) -> Column:
    """All spans of a text, by kind as listed, then by start; null: none."""
    whole = F.coalesce(text, F.lit(""))
    return F.flatten(F.array(*[_spans_of(whole, k) for k in KINDS]))


def joined(found: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def find(df: DataFrame, text: str = "text", to: str = "pii_spans") -> DataFrame:
    """``df`` with an array column of spans (kind, start, end in code points, score).

    Defined cases: null and empty texts have no spans; spans of different kinds
    may overlap; repeated rows each keep theirs; a column named ``to`` is
    replaced.
    """
    return df.withColumn(to, spans(c(text)))


def redacted(text: Column, found: Column) -> Column:
    """The text with each span as ``<KIND>``; overlapping spans go together, under the kind of the earliest, then longest."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def done(xs):
        reached = _running(F.transform(xs, lambda x: -x["back"]), lambda a, b: F.greatest(a, b))
        return F.when(F.size(xs) == 0, text).otherwise(_bound(F.concat(F.array(F.lit(0).cast("long")), reached), lambda before: written(xs, before)))

    def written(xs, before):
        """``before``: where the spans before each one, and before the text's end, reach."""
        first = F.filter(F.zip_with(xs, F.slice(before, 1, F.size(xs)), lambda x, at: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), at.alias("at"))), lambda x: x["start"] >= x["at"])
        pieces = F.transform(first, lambda x: F.concat(F.substr(text, (x["at"] + 1).cast("int"), (x["start"] - x["at"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.concat(F.array_join(pieces, ""), F.substr(text, (F.element_at(before, -1) + 1).cast("int")))

    return _bound(order, done)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the personal data of its texts replaced; null stays null."""
    return df.withColumn(text, F.when(c(text).isNotNull(), redacted(c(text), spans(c(text)))))


def query(spark, sf_dir: str) -> DataFrame:
    """``op7_pii``: personal data of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", spans(F.col("text")).alias("s"))
    # One use of the column below, so that the optimizer doesn't repeat the search in each result.
    row = F.inline(F.transform(F.array(F.col("s")), lambda s: F.struct(*[_count(s, n).alias(f"n_{n}") for n in BASE], joined(F.filter(s, lambda x: x["kind"].isin(*BASE))).alias("b"), joined(s).alias("spans"))))
    return docs.select("doc_id", row).select("doc_id", *[f"n_{n}" for n in BASE], F.sha2("b", 256).alias("base_sha256"), "spans")


def _sql_kind(kind: Kind, order: int, pattern: str, valid: str) -> str:
    return f"""SELECT doc_id, {order} AS ord, '{kind.name}' AS kind, m[i] AS v, p[i] AS before, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(x, '{pattern}') AS m, string_split_regex(x, '{pattern}') AS p FROM t)) WHERE {valid}"""


_D = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_D}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN {_D}[-j]::INT WHEN {_D}[-j]::INT > 4 THEN {_D}[-j]::INT * 2 - 9 ELSE {_D}[-j]::INT * 2 END)) % 10 = 0"
_PLAIN = "replace(v, ' ', '')"
_MOD97 = f"list_reduce(list_transform(string_split(array_to_string(list_transform(string_split({_PLAIN}[5:] || {_PLAIN}[1:4], ''), lambda x: CASE WHEN x >= 'A' THEN (ascii(x) - 55)::VARCHAR ELSE x END), ''), ''), lambda x: x::INT), lambda a, b: (a * 10 + b) % 97) = 1"
_SQL_KINDS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(v, '.'), lambda o: length(ltrim(o, '0')) <= 3 AND coalesce(try_cast(ltrim(o, '0') AS INT), 0) <= 255))"),
    (r"[0-9](?:[\x20-]?[0-9])+", f"length({_D}) BETWEEN 16 AND 19 AND {_LUHN}"),
    (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_D}) BETWEEN 8 AND 15"),
    (_IBAN, f"length({_PLAIN}) BETWEEN 15 AND 34 AND {_MOD97}"),
    (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$') AND regexp_matches(lower(right(before, 40)), 'ssn|social|security')"),
    (r"[A-Za-z0-9_-]{24,}", f"regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(lower(right(before, 40)), '{KINDS[-1].words}')"),
)


def oracle_sql() -> str:
    """DuckDB SQL for the rows of ``query``."""
    # The condition of a kind reads the row that the inner select makes.
    parts = [f"SELECT * FROM ({_sql_kind(k, i, p, 'true')}) WHERE {v}" for i, (k, (p, v)) in enumerate(zip(KINDS, _SQL_KINDS, strict=True))]
    counts = ", ".join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n in BASE)
    text = "kind || ':' || s::BIGINT || ':' || (s + length(v))::BIGINT"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), found AS ({" UNION ALL ".join(parts)})
    SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({text}, ',' ORDER BY ord, s) FILTER (ord < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg({text}, ',' ORDER BY ord, s), '') AS spans
    FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""
