"""WARC derivatives: metadata and plain-text conversion records of response records.

A derived record names its response in ``WARC-Refers-To`` and keeps the
response's target, date and all HTTP headers; digests are SHA-1 in
base 32, as is usual in WARC files.  ``responses`` makes response records of a
table of pages, ``derive`` turns any responses into their derivatives, and
``record_bytes`` writes a record as it stands in a file.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import c, pieces, small_batches

#: Namespace of derived record ids: the same response always gives the same ids.
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Date of records made of pages, which have none.
EPOCH = "1970-01-01T00:00:00Z"
#: Elements whose content is no text, those that drop the rest of a page if they are not closed, and those that break lines.
HIDDEN = frozenset(b"script style noscript template svg".split())
TO_THE_END = frozenset(b"script style".split())
BREAKS = frozenset(b"p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav aside main blockquote pre hr title body head td th form".split())
_TAG = re.compile(rb"<(/?)([a-z][a-z0-9]*)|<[!?]")
_HREF = re.compile(rb"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_LANG = re.compile(rb"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{kind} {source}')}>"


def _plain(raw: bytes) -> str:
    """Text between tags, with entities read and white space folded."""
    return " ".join(html_entities.unescape(raw.decode("utf-8", "replace")).split())


class Page:
    """Visible text, title, language and links of a page, by one pass over its tags.

    The place of each closing mark is looked up once and kept until it is
    passed, so that the pass is linear in the page, however malformed it is.
    A mark that never comes leaves a tag as text, drops the rest of the page
    after a comment, script or style, and ends no other element.
    """

    def __init__(self, page: bytes) -> None:
        self.page, self.low = page, page.lower()
        self.upcoming: dict[bytes, int] = {}
        self.title: str | None = None
        self.language: str | None = None
        self.links: list[str] = []
        self.text = self._lines(b"".join(self._visible()))

    def _lines(self, raw: bytes) -> str:
        lines = html_entities.unescape(raw.decode("utf-8", "replace")).split("\n")
        return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)

    def _next(self, mark: bytes, at: int) -> int:
        """Where ``mark`` comes next, or -1; ``at`` never goes back."""
        found = self.upcoming.get(mark, -2)
        if found != -1 and found < at:
            found = self.upcoming[mark] = self.low.find(mark, at)
        return found

    def _visible(self) -> Iterator[bytes]:
        page, low, at = self.page, self.low, 0
        while (tag := low.find(b"<", at)) >= 0:
            yield page[at:tag]
            if low.startswith(b"<!--", tag):
                at = self._next(b"-->", tag + 4) + 3
                if at < 3:
                    return
                yield b" "
                continue
            found, end = _TAG.match(low, tag), self._next(b">", tag)
            name = found[2] if found else None
            opens = bool(found) and not found[1] and name is not None
            if not found or end < 0:
                if opens and name in TO_THE_END:
                    return
                yield b"<"
                at = tag + 1
                continue
            at = end + 1
            if opens and name in HIDDEN and page[end - 1 : end] != b"/":
                close = self._next(b"</" + name, at)
                if close >= 0 or name in TO_THE_END:
                    at = self._next(b">", close) + 1 if close >= 0 else 0
                    if not at:
                        return
                    yield b" "
                    continue
            if name in BREAKS:
                yield b"\n"
            if opens:
                self._opened(name, page[tag + 1 + len(name) : end], at)
        yield page[at:]

    def _opened(self, name: bytes, inside: bytes, at: int) -> None:
        if name == b"a" and (m := _HREF.search(inside)):
            self.links.append(_plain(next(x for x in m.groups() if x is not None)))
        elif name == b"html" and self.language is None and (m := _LANG.search(inside)):
            self.language = m[1].decode().lower()
        elif name == b"title" and self.title is None and (close := self._next(b"</title", at)) >= 0:
            self.title = _plain(self.page[at:close])


def plain_text(html: str) -> str:
    """Visible text of a page: one line for each block, white space folded."""
    return Page(html.encode()).text


def http_block(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n" + payload


def split_http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and payload of an HTTP response; without a header end all is payload."""
    if not block.startswith(b"HTTP/"):
        return [], block
    head, end, payload = block.partition(b"\r\n\r\n")
    if not end:
        return [], block
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return [(k.strip(), v.strip()) for k, _, v in pairs], payload


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record of a WARC 1.1 file."""
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n" + block + b"\r\n\r\n"


_HEADER = StructType([StructField("name", StringType()), StructField("value", StringType())])
RECORD = StructType(
    [
        StructField("warc_type", StringType()),
        StructField("record_id", StringType()),
        StructField("refers_to", StringType()),
        StructField("target_uri", StringType()),
        StructField("warc_date", StringType()),
        StructField("content_type", StringType()),
        StructField("block_digest", StringType()),
        StructField("payload_digest", StringType()),
        StructField("content_length", LongType()),
        StructField("source_headers", ArrayType(_HEADER)),
        StructField("block", BinaryType()),
    ]
)


def _response(page: object, url: str | None, html: bytes | None) -> dict:
    payload = html or b""
    block = http_block([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], payload)
    return {
        "warc_type": "response",
        "record_id": record_id("response", f"{page} {url} {digest(payload)}"),
        "target_uri": url,
        "warc_date": EPOCH,
        "content_type": "application/http; msgtype=response",
        "block_digest": digest(block),
        "payload_digest": digest(payload),
        "content_length": len(block),
        "source_headers": [],
        "block": block,
    }


def _derived(kind: str, source: dict, content_type: str, block: bytes, headers: list[dict]) -> dict:
    return {
        "warc_type": kind,
        "record_id": record_id(kind, source["record_id"] or ""),
        "refers_to": source["record_id"],
        "target_uri": source["target_uri"],
        "warc_date": source["warc_date"],
        "content_type": content_type,
        "block_digest": digest(block),
        "payload_digest": source["payload_digest"],
        "content_length": len(block),
        "source_headers": headers,
        "block": block,
    }


def derivatives(source: dict) -> list[dict]:
    """The metadata and the conversion record of a response."""
    found, payload = split_http(source["block"] or b"")
    headers = [{"name": k, "value": v} for k, v in found]
    if not source["payload_digest"]:
        source = source | {"payload_digest": digest(payload)}
    page = Page(payload)
    fields = [("source-digest", source["payload_digest"]), ("source-length", str(len(payload)))]
    fields += [(f"http-{h['name'].lower()}", h["value"]) for h in headers]
    fields += [("title", page.title)] if page.title is not None else []
    fields += [("language", page.language)] if page.language else []
    fields += [("outlink", x) for x in page.links]
    metadata = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return [
        _derived("metadata", source, "application/warc-fields", metadata, headers),
        _derived("conversion", source, "text/plain; charset=utf-8", page.text.encode(), headers),
    ]


def _map(df: DataFrame, size: int, made, schema: StructType) -> DataFrame:
    """Rows made of each row, a few MB at a time; ``size``: the column that is large."""
    small_batches(df.sparkSession)
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in pieces(batch.column(size)):
                rows = [x for r in batch.slice(begin, end - begin).to_pylist() for x in made(r)]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return df.mapInArrow(run, schema)


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response records of a table of pages; null pages have an empty payload, null urls no target."""
    rows = pages.select(c(page_id).cast("string").alias("p"), c(url).alias("u"), c(html).cast("binary").alias("h"))
    return _map(rows, 2, lambda r: [_response(r["p"], r["u"], r["h"])], RECORD)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all response records; others are left out.

    Defined cases: a null or empty block gives records with an empty payload;
    one that isn't HTTP is all payload, without source headers; a missing
    payload digest is computed; responses that repeat in all columns give the same
    records again, under the same ids; other columns of the input play no part.
    """
    rows = records.where(F.col("warc_type") == "response").select(*[c(f.name) for f in RECORD])
    return _map(rows, len(RECORD) - 1, derivatives, RECORD)


def file_bytes() -> Column:
    """The record as bytes of a WARC file, from the columns of ``RECORD``."""
    header = lambda name, column: F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit("\r\n"))).otherwise("")
    names = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    return F.concat(F.concat(F.lit("WARC/1.1\r\n"), *[header(*x) for x in names], F.lit("\r\n")).cast("binary"), F.coalesce(F.col("block"), F.lit(b"")), F.lit(b"\r\n\r\n"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op5_warc``: the derived records of all pages, blocks as digests."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    made = derive(responses(pages))
    headers = F.array_join(F.transform("source_headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")
    return made.select(*[x for x in RECORD.names if x not in ("source_headers", "block")], headers.alias("source_headers"), F.sha2("block", 256).alias("block_sha256"))
