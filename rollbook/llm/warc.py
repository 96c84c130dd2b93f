"""Derived WARC records: metadata and plain-text conversions of responses.

:func:`read` takes the records out of WARC files, plain or of gzip members, by Spark's text
source, which splits plain files and streams compressed ones; :func:`derive` gives for
each response a ``metadata`` record (its headers and what was found out about it) and a
``conversion`` record (its text), both of which name it in WARC-Refers-To with its target
and date, and keep its digests. Record ids are name-based UUIDs over the response's id and
the record's type, so a rerun gives the same records. Blocks are written as WARC 1.1 by
Spark's text sink, whose line separator is the two line breaks that end a record.

Pages are scanned once from left to right, so a page with tags that never end takes as long
as another one of its size.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, small_batches

#: The name space of the records' UUIDs: that of URLs.
SPACE = uuid.NAMESPACE_URL
#: What a record of version 1.0 or 1.1 begins with, before the last digit; files are split there.
VERSION = b"WARC/1."
#: Elements that hold no text, and elements that begin a new line.
SILENT = {"script", "style", "noscript", "template"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "footer", "nav", "main", "aside", "title", "head", "body", "blockquote", "pre", "hr", "dl", "dt", "dd", "form"}
NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9-]*)")
HREF = re.compile(r"[\s\"'/]href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
LANG = re.compile(r"[\s\"'/]lang\s*=\s*[\"']?([\w-]+)", re.I)
CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)
SPACES = re.compile(r"[^\S\n]+")
LINES = re.compile(r"\s*\n\s*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join(names))}>"


def scanned(page: str) -> tuple[str, list[tuple[str, str]]]:
    """What a reader sees (no scripts, styles or comments, a line for each block, entities decoded), and title, language and links.

    A comment or a silent element that doesn't end reaches to the end of the page; a "<" after which no tag follows is text.
    """
    low = page.lower()
    low = low if len(low) == len(page) else page  # a few letters change their length in lower case
    parts: list[str] = []
    found: list[tuple[str, str]] = []
    title: list[str] | None = None
    at, end, last_close = 0, len(page), low.rfind(">")
    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            begin = end
        if begin > at:
            parts.append(page[at:begin])
            if title is not None:
                title.append(page[at:begin])
        if begin == end:
            break
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if begin > last_close:
            parts.append(page[begin:])
            break
        name = NAME.match(low, begin + 1)
        stop = page.find(">", begin)
        at = stop + 1
        if not name:
            continue
        kind, closes = name[1].lower(), page[begin + 1] == "/"
        if kind in SILENT and not closes:
            stop = low.find(f"</{kind}", at)
            at = low.find(">", stop) + 1 if 0 <= stop <= last_close else end
            continue
        if kind in BREAKS:
            parts.append("\n")
        if kind == "title":
            if closes and title is not None and not any(k == "title" for k, _ in found):
                found.insert(0, ("title", SPACES.sub(" ", html.unescape("".join(title))).strip()))
            title = None if closes else []
        elif not closes and kind in ("a", "html"):
            tag = page[begin:stop]
            if kind == "a" and (m := HREF.search(tag)):
                found.append(("outlink", html.unescape(m[1] or m[2] or m[3] or "")))
            elif kind == "html" and (m := LANG.search(tag)):
                found.append(("languages-html", m[1].lower()))
    return LINES.sub("\n", SPACES.sub(" ", html.unescape("".join(parts)))).strip(), found


def plain_text(page: str) -> str:
    return scanned(page)[0]


def _clean(value: str) -> str:
    """A header value without line breaks."""
    return re.sub(r"[\r\n]+", " ", value).strip()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_clean(v)}" for k, v in headers if v), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace") + block


def _fields(lines: str) -> list[tuple[str, str]]:
    """Header lines; one that begins with white space goes on with the line before."""
    out: list[tuple[str, str]] = []
    for x in lines.splitlines():
        if x[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {x.strip()}")
        elif ":" in x:
            k, _, v = x.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def _decoded(http: list[tuple[str, str]], payload: bytes) -> str:
    """The payload as text: content codings undone where they can be, in the character set that the header names."""
    named = {k.lower(): v for k, v in http}
    if named.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            payload = zlib.decompressobj(47).decompress(payload)
        except zlib.error:
            pass
    m = CHARSET.search(named.get("content-type", ""))
    try:
        return payload.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derived(headers: str, block: bytes) -> list[tuple[str, str, str, str, bytes]]:
    """(type, record id, block digest, the response's payload digest, record) of the two records of a response: its WARC header lines and its block."""
    own = _fields(headers)
    named = {k.lower(): v for k, v in reversed(own)}
    http, gap, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    status, _, lines = http.decode("iso-8859-1").partition("\r\n")
    sent = _fields(lines)
    text, found = scanned(_decoded(sent, payload))
    text = text.encode("utf-8", "replace")
    source_id, url, date = named.get("warc-record-id", ""), named.get("warc-target-uri", ""), named.get("warc-date", "")
    # digests that the source states are kept as they stand, others are made
    whole, part = named.get("warc-block-digest") or digest(block), named.get("warc-payload-digest") or digest(payload)
    conversion, metadata = record_id(source_id, "conversion"), record_id(source_id, "metadata")
    fields = [("source-block-digest", whole), ("source-payload-digest", part), ("source-length", str(len(payload))), ("text-length", str(len(text)))]
    fields += [(f"source-{k.lower()}", v) for k, v in own] + [("http-status", status)] * bool(status) + [(f"http-{k.lower()}", v) for k, v in sent]
    fields += [*found, ("conversion-record", conversion)]
    about = "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields).encode("utf-8", "replace")
    out = []
    for kind, name, media, made in (("metadata", metadata, "application/warc-fields", about), ("conversion", conversion, "text/plain; charset=utf-8", text)):
        lines = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", source_id), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Block-Digest", digest(made)), ("WARC-Payload-Digest", digest(made)), ("Content-Type", media)]
        out.append((kind, name, digest(made), part, record(lines, made)))
    return out


def responses(pages: DataFrame, *, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(record): response records of bare pages, for tables of pages that came without any.

    The id is named by page id and URL, and the page id goes along as the header Page-ID. What such a table doesn't
    know is given here: ``date``, and an HTTP header of status 200 and UTF-8. A null page is an empty payload.
    Repeated rows give repeated records; pages of any length are one record; an empty table stays empty; other columns, whatever their names, are left out.
    """
    names = F.concat_ws("|", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")))
    h = F.sha1(F.concat(F.lit("rollbook:"), names))
    # a name-based UUID (version 5 layout) from the hash
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    uid = F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))
    body = F.coalesce(F.col(page), F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    line = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n"))).otherwise("")
    lines = [line("WARC-Record-ID", uid), line("WARC-Target-URI", F.col(url)), line("WARC-Date", F.lit(date)), line("Page-ID", F.col(id_col).cast("string"))]
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\n"), *lines, F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.concat(head, block).cast("binary").alias("record"))


RECORD = pa.schema([("file", pa.string()), ("open", pa.bool_()), ("headers", pa.string()), ("block", pa.binary())])


def _parsed(piece: bytes) -> tuple[bytes, bytes, int] | None:
    """(header lines, block, bytes that are missing) of a piece that begins a record, else none."""
    first = re.match(rb"\d+[ \t]*\r\n", piece)
    head, gap, body = piece[first.end() :].partition(b"\r\n\r\n") if first else (b"", b"", b"")
    m = re.search(rb"(?im)^content-length[ \t]*:[ \t]*(\d+)", head)
    return (head, body[: int(m[1])], max(int(m[1]) - len(body), 0)) if gap and m else None


def _cut(batches, strict: bool = True):
    """Records of pieces (file, split, piece) that come in order; ``open`` if a file's or split's last one has bytes missing.

    Bytes outside records are an error, unless a split may begin within one (not ``strict``).
    """
    place, held = None, []

    def row(made, unfinished):
        return place[0], unfinished, made[0].decode("utf-8", "replace"), made[1]

    for batch in batches:
        out = []
        for file, split, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (file, split) != place:
                if held:
                    out.append(row(_parsed(VERSION.join(held)), True))
                place, held = (file, split), []
            if held:
                held.append(piece)
                missing -= len(VERSION) + len(piece)
            elif made := _parsed(piece):
                held, missing = [piece], made[2]
            elif strict and piece.strip():
                raise ValueError(f"{file}: no WARC 1.0 or 1.1 record begins at {piece[:40]!r}")
            if held and missing <= 0:
                out.append(row(_parsed(VERSION.join(held)), False))
                held = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(RECORD)], schema=RECORD)
    if held:
        made = row(_parsed(VERSION.join(held)), True)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(made, RECORD, strict=True)], schema=RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, headers, block): the records of WARC 1.0 and 1.1 files, whatever their type, plain or compressed by record.

    Files are cut at the records' first line; a file that holds anything but such records is an error, an empty one has none. Where a block holds that line itself, the pieces are put together again by
    the block's length. Spark splits plain files, so a first pass looks for splits that end within such a record; the files
    that have any (hardly ever one) are put in order by a sort and read as a whole, the others split by split. A file's
    last record that ends early has what there is.
    """
    small_batches(spark)
    rows = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))
    kind = "file string, open boolean, headers string, block binary"
    torn = [r.file for r in rows.mapInArrow(lambda b: _cut(b, False), kind).where("open").select("file").distinct().collect()]
    if not torn:
        return rows.mapInArrow(_cut, kind).select("file", "headers", "block")
    of = F.broadcast(spark.createDataFrame([(f,) for f in torn], "file string"))
    # a partition's rows come split by split and in order, so their number tells the order within a split
    order = rows.withColumn("nth", F.monotonically_increasing_id()).join(of, "file").repartition(partitions(spark), "file").sortWithinPartitions("file", "split", "nth")
    whole = order.select("file", F.lit(0).cast("long").alias("split"), "piece").mapInArrow(_cut, kind)
    return rows.join(of, "file", "left_anti").mapInArrow(_cut, kind).union(whole).select("file", "headers", "block")


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response among ``records`` (headers, block).

    (page_id, refers_to, type, record_id, target_uri, block_digest, payload_digest, record); ``page_id`` is the header
    Page-ID, null where there is none. Null headers or blocks count as empty, and an empty header isn't written; repeated
    responses give repeated records with the same ids; records of other types give none. Blocks of any length are scanned whole; an
    empty table stays empty; other columns are left out.
    """
    small_batches(records.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for headers, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                named = {k.lower(): v for k, v in reversed(_fields(headers or ""))}
                if named.get("warc-type", "").lower() != "response":
                    continue
                for made in derived(headers or "", block or b""):
                    out.append((named.get("page-id"), named.get("warc-record-id"), *made[:2], named.get("warc-target-uri"), *made[2:]))
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            types = [*[pa.string()] * 7, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "refers_to", "type", "record_id", "target_uri", "block_digest", "payload_digest", "record"])

    return records.select("headers", "block").mapInArrow(run, "page_id string, refers_to string, type string, record_id string, target_uri string, block_digest string, payload_digest string, record binary")


def write(records: DataFrame, path: str, compression: str | None = None) -> None:
    """WARC files of ``record``, one a task. With ``compression="gzip"`` a file is one gzip stream."""
    out = records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n")
    (out.option("compression", compression) if compression else out).text(path)
