"""WARC derivative builder (operator 1).

A ``response`` record (WARC headers and a block of HTTP head and payload)
gives two derived records that refer to it by ``WARC-Refers-To``: a
``metadata`` record (application/warc-fields: source status and headers,
title, language, out-links, digests, the id of the conversion) and a
``conversion`` record (the visible plain text).  Source headers and digests
are carried over as they were.  Record ids are derived from the response id,
the kind and the payload digest, so a retried task writes the same ids.

Each record is worked on by itself: one pass, no shuffle.

Chunked and compressed bodies are put together and inflated for the text;
digests are those of the payload as it was sent.

Cases: a null block is an empty one; a block without an HTTP head is all
payload; an empty payload gives empty text; unknown or wrong charsets are
read as UTF-8 with replacement; broken codings give what can be read of them;
very long and broken pages take work in proportion to their length; a null
target is left out of the headers; repeated rows give repeated records; an
empty table gives none; clashing extra columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "WARC/1.1"

# Elements whose content is not text; an svg without an end tag is a tag like others.
_HIDDEN = ("script", "style", "template", "noscript", "svg")
_LINES_OF = set("p div section article header footer nav aside main ul ol li dl dt dd table tr h1 h2 h3 h4 h5 h6 pre blockquote form title body head".split())
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*_HIDDEN, "title")}
_MARK = re.compile(r"<!--|<!\[CDATA\[|\]\]>|<(?=/?[a-zA-Z!?])")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)?")
_CLOSED_AT_ONCE = re.compile(r"<svg(?=[\s/])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>", re.I)
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[\s]*")
_LANG = re.compile(r"[^>]*?\slang\s*+=\s*+[\"']?([A-Za-z0-9-]+)", re.I)
_LINK = re.compile(r"[^>]*?[\s\"']href\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_META = re.compile(rb"<meta[^>]*?charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
META_BYTES = 1024  # a page names its charset within so many bytes
_CHUNK = re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r?\n")

RECORDS = T.StructType([T.StructField(n, t) for n, t in (
    ("key", T.StringType()), ("record_type", T.StringType()), ("record_id", T.StringType()), ("refers_to", T.StringType()),
    ("target_uri", T.StringType()), ("date", T.StringType()), ("content_type", T.StringType()), ("content_length", T.LongType()),
    ("block_digest", T.StringType()), ("source_block_digest", T.StringType()), ("source_payload_digest", T.StringType()),
    ("source_headers", T.StringType()), ("block", T.StringType()))])


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP response; its head ends at
    the first empty line, whatever line ends the server wrote."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    at, size = min(ends, default=(len(block), 0))
    lines = re.split("\r?\n", block[:at].decode("latin-1"))
    headers = [(n.strip(), v.strip()) for n, colon, v in (line.partition(":") for line in lines[1:]) if colon]
    return lines[0], headers, block[at + size:]


def _header(headers: list[tuple[str, str]], name: str) -> str:
    return next((v for n, v in headers if n.lower() == name), "")


def unchunked(payload: bytes) -> bytes:
    """A chunked body put together; from where it is no chunk on, it is taken
    as it stands."""
    out, at = [], 0
    while m := _CHUNK.match(payload, at):
        size = int(m.group(1)[:16], 16)
        if size == 0:
            return b"".join(out)
        out.append(payload[m.end(): m.end() + size])
        at = m.end() + size
        at += 2 if payload[at: at + 2] == b"\r\n" else int(payload[at: at + 1] == b"\n")
    return b"".join([*out, payload[at:]])


def inflated(payload: bytes) -> bytes:
    """A gzip, zlib or raw deflate body; of a broken one what can be read, and
    one that is none of them as it stands."""
    for bits in (47, -15):
        engine = zlib.decompressobj(bits)
        parts, at = [], 0
        try:
            while at < len(payload) and not engine.eof:
                parts.append(engine.decompress(payload[at: at + 65536]))
                at += 65536
            return b"".join([*parts, engine.flush()])
        except zlib.error:
            if any(parts):
                return b"".join(parts)
    return payload


def body_of(payload: bytes, headers: list[tuple[str, str]]) -> bytes:
    """The payload without its transfer and content codings."""
    if "chunked" in _header(headers, "transfer-encoding").lower():
        payload = unchunked(payload)
    for coding in reversed(_header(headers, "content-encoding").lower().split(",")):
        if coding.strip() in ("gzip", "x-gzip", "deflate"):
            payload = inflated(payload)
    return payload


def decoded(body: bytes, headers: list[tuple[str, str]]) -> str:
    """The text of a body: its charset is told by a byte order mark, the
    header or the page itself; else, or if there is no such charset, UTF-8."""
    if body.startswith(b"\xef\xbb\xbf"):
        return body[3:].decode("utf-8", "replace")
    told = _CHARSET.search(_header(headers, "content-type"))
    meta = _META.search(body[:META_BYTES])
    name = told.group(1) if told else meta.group(1).decode("ascii") if meta else "utf-8"
    try:
        # surrogates that some charsets let through are no text
        return body.decode(name, "replace").encode("utf-8", "replace").decode("utf-8")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def scanned(page: str) -> tuple[list[str], list[tuple[str, str]]]:
    """(pieces of visible text, facts) in one pass from mark to mark.  Each
    mark is left behind whatever follows it, and what was once looked for in
    vain is not looked for again, so the work is in proportion to the page."""
    out: list[str] = []
    facts: dict[str, str] = {}
    links: list[tuple[str, str]] = []
    missing: set[str] = set()
    at, title = 0, None
    while mark := _MARK.search(page, at):
        out.append(page[at: mark.start()])
        begin, at = mark.start(), mark.end()
        if mark.group() == "<!--":
            if page.startswith((">", "->"), at):
                at = page.index(">", at) + 1
            else:
                end = page.find("-->", at)
                at = len(page) if end < 0 else end + 3
            out.append(" ")
            continue
        if mark.group() != "<":
            out.append(" ")
            continue
        end = page.find(">", begin)
        closing, name = _NAME.match(page, begin, len(page) if end < 0 else end).groups()
        name = (name or "").lower()
        if end < 0 and (closing or name not in _HIDDEN):
            at = begin
            break  # no tag ends any more: the rest is text
        at = len(page) if end < 0 else end + 1
        if name in _HIDDEN and not closing:
            out.append(" ")
            whole = _CLOSED_AT_ONCE.match(page, begin) if name == "svg" else None
            if whole:
                at = whole.end()
            elif (found := None if name in missing else _END[name].search(page, at)) is not None:
                at = found.end()
            else:
                missing.add(name)
                if name != "svg":
                    at = len(page)
            continue
        out.append("\n" if name in _LINES_OF or (name in ("br", "hr") and not closing) else " " if name in ("td", "th") else "")
        if name == "title" and "title" not in facts:
            if not closing and title is None:
                title = len(out)
            elif closing and title is not None:
                facts["title"] = "".join(x for x in out[title:-1])
        if closing:
            continue
        if name == "html" and "lang" not in facts and (m := _LANG.match(page, begin)):
            facts["lang"] = m.group(1)
        elif name == "a" and (m := _LINK.match(page, begin)):
            links.append(("outlink", next(g for g in m.groups() if g is not None)))
    out.append(page[at:])
    one_line = lambda s: " ".join(html.unescape(s).split())
    found = [("title", one_line(facts["title"]))] if "title" in facts else []
    found += [("languages-html", facts["lang"])] if "lang" in facts else []
    return out, found + [(n, one_line(v)) for n, v in links]


def _joined(pieces: list[str]) -> str:
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape("".join(pieces)))).strip()


def plain_text(page: str) -> str:
    """The visible text: blocks on lines of their own, blanks collapsed."""
    return _joined(scanned(page)[0])


def page_facts(page: str) -> list[tuple[str, str]]:
    """Title, language and out-links."""
    return scanned(page)[1]


def derived(key, rid, target, date, block: bytes, block_digest, payload_digest) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    status, headers, payload = split_http(block)
    block_digest = block_digest or digest(block)
    payload_digest = payload_digest or digest(payload)
    pieces, facts = scanned(decoded(body_of(payload, headers), headers))
    text = _joined(pieces)
    ids = {kind: record_id(rid or "", kind, payload_digest) for kind in ("metadata", "conversion")}
    fields = [("source-status", status)] + [(f"source-header-{n.lower()}", v) for n, v in headers]
    fields += [("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("conversion-id", ids["conversion"])]
    fields += facts
    blocks = {"metadata": "".join(f"{n}: {v}\r\n" for n, v in fields), "conversion": text}
    types = {"metadata": "application/warc-fields", "conversion": "text/plain; charset=utf-8"}
    raw_headers = "\r\n".join([status, *(f"{n}: {v}" for n, v in headers)]) if status else ""
    out = []
    for kind, body in blocks.items():
        raw = body.encode("utf-8", "replace")
        out.append((key, kind, ids[kind], rid, target, date, types[kind], len(raw), digest(raw), block_digest, payload_digest,
                    raw_headers, raw.decode("utf-8")))
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """``responses`` (key, record_id, target_uri, date, block binary,
    block_digest, payload_digest) to metadata and conversion records."""
    arrow = [(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in RECORDS]

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                rows = []
                for r in batch.slice(first, 200).to_pylist():
                    rows += derived(r["key"], r["record_id"], r["target_uri"], r["date"], bytes(r["block"] or b""),
                                    r["block_digest"], r["payload_digest"])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), arrow)], [n for n, _ in arrow])

    return responses.select(F.col("key").cast("string").alias("key"), "record_id", "target_uri", "date", "block", "block_digest", "payload_digest") \
        .mapInArrow(run, RECORDS)


def responses_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", key_col: str = "page_id", url_col: str = "url",
                       html_col: str = "html") -> DataFrame:
    """Landed pages as response records (status 200, UTF-8); ``date`` stands
    for the unknown time of the fetch."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    rows = pages.select(F.col(key_col).alias("key"), F.col(url_col).alias("target_uri"), F.concat(F.encode(head, "UTF-8"), payload).alias("block"),
                        F.concat(F.lit("sha256:"), F.sha2(payload, 256)).alias("payload_digest"))
    name = F.sha2(F.concat_ws("\u0000", F.lit("response"), F.col("key").cast("string"), F.coalesce("target_uri", F.lit("")), "payload_digest"), 256)
    uid = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))
    return rows.select("key", uid.alias("record_id"), "target_uri", F.lit(date).alias("date"), "block",
                       F.concat(F.lit("sha256:"), F.sha2("block", 256)).alias("block_digest"), "payload_digest")


# --- record files -------------------------------------------------------------


def record_bytes(row: dict) -> bytes:
    """One record as it stands in a WARC file."""
    block = row["block"].encode("utf-8")
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]),
               ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["date"]), ("WARC-Block-Digest", row["block_digest"]),
               ("WARC-Payload-Digest", row["source_payload_digest"] if row["record_type"] == "response" else None),
               ("Content-Type", row["content_type"]), ("Content-Length", str(len(block)))]
    head = "".join(f"{n}: {v}\r\n" for n, v in headers if v)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def read_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not at a record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin = end + 4
        size = int(headers["Content-Length"])
        out.append((headers, data[begin: begin + size]))
        at = begin + size + 4
    return out


def warc_blocks(records: DataFrame) -> DataFrame:
    """(key, record_type, record): records serialised, each gzipped as a
    member of its own, as WARC files hold them: members concatenate."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("record", T.BinaryType())])

    def run(batches):
        import gzip

        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in rows], pa.string()), pa.array([r["record_type"] for r in rows], pa.string()),
                                              pa.array([gzip.compress(record_bytes(r), mtime=0) for r in rows], pa.binary())], schema.fieldNames())

    return records.mapInArrow(run, schema)
