"""WARC derivatives: metadata and plain-text conversion records for response records.

Each response gives two records that refer to it: ``metadata`` (title, language, charset, outlinks, and the id of the conversion) and
``conversion`` (the page's text). Both keep the response's target URI, date, payload digest and HTTP headers, carry digests of
their own blocks, and have ids that are hashes of the response's id and the kind, so that a rerun gives the same records.

Everything about a record is in its own row: one pass, no shuffle, a lost task is simply run again.

Defined results: a null payload counts as empty and gives an empty text; a null URI or date leaves its header out; responses without an id get one from their
key, URI and payload digest. Headers keep their order, and repeated names all their values; a null value is empty, a header without a name is left
out. Bytes that aren't UTF-8 are replaced. Unclosed comments, scripts and tags end with the page, as in browsers. Repeated rows give repeated
records with equal ids. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text, and elements that begin a new line.
_SILENT = frozenset("script style template noscript head iframe object svg math select textarea".split())
_BLOCK = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p "
    "pre section table tbody td tfoot th thead tr ul body html title".split()
)
_RAW = frozenset(("script", "style", "textarea", "title"))
_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def _tag_end(page: str, start: int) -> int:
    """Place of the > that ends the tag at ``start``, not within quotes; -1 if there is none."""
    end = page.find(">", start)
    while end >= 0:
        inside = page[start:end]
        quote = None
        if '"' in inside or "'" in inside:
            for sign in inside:
                if sign == quote:
                    quote = None
                elif quote is None and sign in "\"'":
                    quote = sign
        if quote is None:
            return end
        closing = page.find(quote, end)
        if closing < 0:
            return end
        end = page.find(">", closing)
    return -1


def read_page(page: str) -> dict:
    """title, lang, charset, links (href values in order) and text of a page."""
    found = {"title": "", "lang": None, "charset": None, "links": [], "base": None}
    parts, silent, at = [], None, 0
    while at < len(page):
        open_ = page.find("<", at)
        if open_ < 0:
            open_ = len(page)
        if open_ > at and silent is None:
            parts.append(html.unescape(page[at:open_]))  # by itself: tags end a reference
        if open_ == len(page):
            break
        if page.startswith("<!--", open_):
            end = page.find("-->", open_ + 4)
            at = len(page) if end < 0 else end + 3
            continue
        name = _NAME.match(page, open_ + 1)
        if not name:
            if page.startswith(("!", "?"), open_ + 1):
                end = page.find(">", open_)
                at = len(page) if end < 0 else end + 1
            else:
                if silent is None:
                    parts.append("<")
                at = open_ + 1
            continue
        end = _tag_end(page, open_)
        if end < 0:
            break
        tag = name[0].lower()
        closes, tag = tag.startswith("/"), tag.lstrip("/")
        at = end + 1
        if silent is not None:
            if closes and tag == silent:
                silent = None
            elif silent != "head" or tag not in ("meta", "title", "base", "script", "style", "body"):
                continue
        if tag == "body" and silent == "head":
            silent = None
        if not closes and tag in ("html", "a", "meta", "base", "link"):
            attributes = {key.lower(): html.unescape(value.strip("\"'")) for key, value in _ATTRIBUTE.findall(page, name.end(), end)}
            if tag == "a" and attributes.get("href"):
                found["links"].append(attributes["href"])
            elif tag == "html":
                found["lang"] = attributes.get("lang") or found["lang"]
            elif tag == "base":
                found["base"] = found["base"] or attributes.get("href")
            elif tag == "meta" and attributes.get("charset"):
                found["charset"] = attributes["charset"]
        if not closes and tag in _RAW:
            closing = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            if tag == "title" and not found["title"]:
                found["title"] = " ".join(html.unescape(page[at : closing.start() if closing else len(page)]).split())
            at = closing.end() if closing else len(page)
        elif not closes and tag in _SILENT and silent is None and page[end - 1] != "/":
            silent = tag
        elif tag in _BLOCK:
            parts.append("\n")
    text = _BLANKS.sub(" ", "".join(parts))
    found["text"] = _LINES.sub("\n", text).strip()
    return found


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers, block) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = [tuple(line.split(": ", 1)) for line in head.decode().split("\r\n")[1:]]
    return headers, rest[: int(dict(headers)["Content-Length"])]


def _one_line(value: str) -> str:
    return " ".join(value.split())


def _named(headers: list[tuple[str, str]]) -> list[dict]:
    return [{"name": name, "value": value} for name, value in headers]


def derive_one(source: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    payload = source["payload"] or b""
    uri = _one_line(source["target_uri"]) if source["target_uri"] else None
    payload_digest = digest(payload)
    response = source["record_id"] or record_id("response", str(source["key"]), uri or "", payload_digest)
    page = read_page(payload.decode("utf-8", "replace"))
    sent = [(header["name"], header["value"] or "") for header in source["http_headers"] or [] if header and header["name"]]
    conversion = record_id("conversion", response, payload_digest)
    fields = [("title", page["title"]), ("languages-html", page["lang"]), ("charset", page["charset"]), ("conversion", conversion)]
    base = urljoin(uri or "", page["base"]) if page["base"] else uri or ""
    outlinks = []
    for link in page["links"]:
        try:
            outlinks.append(_one_line(urljoin(base, link)))
        except ValueError:  # not a URI
            outlinks.append(_one_line(link))
    fields += [("outlink", link) for link in outlinks] + [(f"http-{name.lower()}", value) for name, value in sent]
    written = "".join(f"{name}: {_one_line(value)}\r\n" for name, value in fields if value)
    records = []
    for kind, type_, id_, text in (
        ("metadata", "application/warc-fields", record_id("metadata", response, payload_digest), written),
        ("conversion", "text/plain; charset=utf-8", conversion, page["text"]),
    ):
        block = text.encode("utf-8", "replace")
        headers = [("WARC-Type", kind), ("WARC-Record-ID", id_), ("WARC-Refers-To", response)]
        headers += [("WARC-Target-URI", uri)] * bool(uri) + [("WARC-Date", source["date"] or "")] * bool(source["date"])
        headers += [("WARC-Block-Digest", digest(block)), ("X-Source-Payload-Digest", payload_digest)]
        headers += [("Content-Type", type_), ("Content-Length", str(len(block)))]
        records.append({
            "kind": kind, "record_id": id_, "refers_to": response, "target_uri": uri, "block": text, "block_digest": digest(block),
            "source_digest": payload_digest, "source_headers": _named(sent), "warc_headers": _named(headers), "outlinks": outlinks if kind == "metadata" else None,
            "title": page["title"],
        })
    return records


#: Headers in the order they were sent, names repeated as they come.
_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
HEADERS = "array<struct<name:string,value:string>>"
_ARROW = pa.schema([
    ("key", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("title", pa.string()),
    ("outlinks", pa.list_(pa.string())), ("source_headers", _PAIRS), ("source_digest", pa.string()), ("block_digest", pa.string()),
    ("warc_headers", _PAIRS), ("block", pa.string()),
])
RECORDS = (
    "key bigint, kind string, record_id string, refers_to string, target_uri string, title string, outlinks array<string>, "
    f"source_headers {HEADERS}, source_digest string, block_digest string, warc_headers {HEADERS}, block string"
)


def derive(responses: DataFrame) -> DataFrame:
    """Two records for every row of (key, record_id, target_uri, date, http_headers: `HEADERS`, payload: binary)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                source = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                rows += [{"key": source["key"], **record} for record in derive_one(source)]
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return responses.select("key", "record_id", "target_uri", "date", "http_headers", "payload").mapInArrow(of, RECORDS)


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Response records of stored pages, as `derive` takes them."""
    payload = F.coalesce(F.col(page).cast("string"), F.lit("")).cast("binary")
    sent = {"Content-Type": F.lit("text/html; charset=utf-8"), "Content-Length": F.octet_length(payload).cast("string")}
    headers = F.array(*[F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in sent.items()])
    none = F.lit(None).cast("string")
    return pages.select(
        F.col(page_id).cast("bigint").alias("key"), none.alias("record_id"), F.col(url).cast("string").alias("target_uri"), none.alias("date"),
        headers.alias("http_headers"), payload.alias("payload"),
    )


def to_warc(records: DataFrame) -> DataFrame:
    """key, kind and record (bytes of a WARC record) for every derived record."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, blocks = batch.column("warc_headers").to_pylist(), batch.column("block").to_pylist()
            pairs = [[(header["name"], header["value"]) for header in headers] for headers in named]
            made = [serialise(headers, block.encode("utf-8", "replace")) for headers, block in zip(pairs, blocks, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("kind"), pa.array(made, pa.binary())], ["key", "kind", "record"])

    return records.mapInArrow(of, "key bigint, kind string, record binary")
