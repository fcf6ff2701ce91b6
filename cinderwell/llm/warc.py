"""WARC derivatives: metadata and conversion records from responses.

Records are rows: ``record_id``, ``type``, ``headers`` (the WARC named fields as
they stand in a file, a line each) and ``block`` (bytes). For each response ``derive``
adds a ``metadata`` record (JSON: the response's WARC fields, its HTTP status
and headers, and the page's title, meta tags and links) and a ``conversion``
record (plain text of the page). Both name the response in
``WARC-Refers-To`` and each other in ``WARC-Concurrent-To``, keep its target,
date and payload digest, and have digests of their own; their ids are made from
the response's, so a rerun gives the same records.

``write`` packs records into files of one gzip member a record, a new file
after ``ROLL`` bytes; a file is renamed when it is whole, until then a leading
``_`` hides it from ``read``, also what a failed attempt leaves. ``read`` streams
``*.warc`` and ``*.warc.gz`` files, a task holding a batch of records, or one. A file
that is cut off, or a block that does not fit its SHA-1 digest, is an error.

A response whose block is no HTTP message is taken as a bare payload. A null
block counts as empty: the text is empty, the metadata has no title. Rows of
other types are passed over. Repeated rows give repeated records. Texts of any
length are converted whole. An empty table gives no records and no files.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderwell.llm.arrowfiles import _filesystem
from cinderwell.llm.common import or_empty, shared_folder, small_batches, table

RECORD = "record_id string, type string, headers string, block binary"
_RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("headers", pa.string()), ("block", pa.binary())])
ROLL = 16_000_000
LEVEL = 1
PIECE = 8192
BATCH = 256

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
#: fixed values: elements that end a line of text
_LINES = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr li main nav ol p pre section table td th tr ul".split())
_LINE_TAG = re.compile(rf"</?(?:{'|'.join(sorted(_LINES))})\b[^>]*>", re.I)
_TITLE, _TITLE_END = re.compile(r"<title", re.I), re.compile(r"</title\s*>", re.I)
_META = re.compile(r"<meta\b", re.I)
_LINK, _LINK_END = re.compile(r"<a\b", re.I), re.compile(r"</a\s*>|<a\b|\Z", re.I)
_ATTRIBUTE = re.compile(r"""(?<![-\w:])([a-zA-Z][-\w:]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


#: two base-32 digits for each ten bits
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PAIRS = [a + b for a in _DIGITS for b in _DIGITS]


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as WARC files have it."""
    n = int.from_bytes(hashlib.sha1(data).digest(), "big")
    return "sha1:" + "".join([_PAIRS[n >> shift & 1023] for shift in range(150, -1, -10)])


def derived_id(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#{kind}')}>"


def _attributes(tag: str) -> dict[str, str]:
    return {n.lower(): html.unescape(a or b or c) for n, a, b, c in _ATTRIBUTE.findall(tag)}


def _without(tag: re.Pattern, by: str, page: str) -> str:
    """Tags replaced. What is left of the last ``>`` is not looked at: no tag
    ends there, and each opening would be followed to the end of the page."""
    end = page.rfind(">") + 1
    return tag.sub(by, page[:end]) + page[end:]


def _tags(opening: re.Pattern, page: str, at: int = 0):
    """(what stands in the tag, where it ends) of each tag, in one scan."""
    while found := opening.search(page, at):
        end = page.find(">", found.end())
        if end < 0:
            return
        at = end + 1
        yield page[found.end():end], at


def _title(page: str) -> str | None:
    for _, at in _tags(_TITLE, page):
        end = _TITLE_END.search(page, at)
        return page[at:end.start()] if end else None


def _links(page: str):
    """(tag, text) of each anchor; the text ends at the next anchor at latest."""
    for tag, at in _tags(_LINK, page):
        yield tag, page[at:_LINK_END.search(page, at).start()]


def _line(text: str) -> str:
    return " ".join(html.unescape(_without(_TAG, " ", text)).split())


def plain_text(page: str) -> str:
    """The text a reader sees: without scripts, styles, comments and the head,
    a line for each block element."""
    page = _HIDDEN.sub(" ", page.replace("\n", " "))
    page = _without(_TAG, "", _without(_LINE_TAG, "\n", page))
    lines = (" ".join(x.split()) for x in html.unescape(page).split("\n"))
    return "\n".join(x for x in lines if x)


def http_message(block: bytes) -> tuple[str, list[list[str]], bytes]:
    """Status line, headers and payload; chunks joined and gzip undone."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers = [[n.strip(), v.strip()] for n, _, v in (x.partition(":") for x in lines if ":" in x)]
    by = {n.lower(): v.lower() for n, v in headers}
    if "chunked" in by.get("transfer-encoding", ""):
        whole, rest = [], payload
        while rest:
            size, _, rest = rest.partition(b"\r\n")
            try:
                n = int(size.split(b";")[0], 16)
            except ValueError:
                break
            if not n:
                break
            whole.append(rest[:n])
            rest = rest[n + 2:]
        payload = b"".join(whole)
    if "gzip" in by.get("content-encoding", ""):
        try:
            payload = zlib.decompressobj(31).decompress(payload)
        except zlib.error:
            pass
    return status, headers, payload


def _decoded(payload: bytes, headers: list[list[str]]) -> str:
    kind = next((v for n, v in headers if n.lower() == "content-type"), "")
    named = re.search(r"charset=[\"']?([-\w]+)", kind, re.I)
    named = named[1] if named else (m[1].decode() if (m := re.search(rb"<meta[^>]+charset=[\"']?([-\w]+)", payload[:4096], re.I)) else "utf-8")
    try:
        return payload.decode(named, "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derivatives(record_id: str, headers: list[tuple[str, str]], block: bytes) -> list[tuple]:
    """The metadata and the conversion record of a response."""
    by = {n.lower(): v for n, v in headers}
    status, http, payload = http_message(block)
    page = _decoded(payload, http)
    entity = digest(payload)
    title = _title(page)
    metas = [a for a in (_attributes(tag) for tag, _ in _tags(_META, page)) if a]
    links = [{"url": a["href"], "text": _line(t)} for a, t in ((_attributes(tag), t) for tag, t in _links(page)) if "href" in a]
    meta_id, text_id = derived_id(record_id, "metadata"), derived_id(record_id, "conversion")
    envelope = {"WARC-Header-Metadata": [list(x) for x in headers], "Block-Digest": by.get("warc-block-digest") or digest(block),
                "HTTP-Response-Metadata": {"Response-Message": status, "Headers": http, "Entity-Length": len(payload), "Entity-Digest": entity},
                "HTML-Metadata": {"Title": None if title is None else _line(title), "Metas": metas, "Links": links}}
    kept = [(n, by[n.lower()]) for n in ("WARC-Target-URI", "WARC-Date") if n.lower() in by]
    # other named fields of the source, such as a crawler's own, go along
    kept += [(n, v) for n, v in headers if n.lower().startswith("x-")]
    source = by.get("warc-payload-digest") or entity

    def record(own: str, other: str, kind: str, content: str, body: bytes) -> tuple:
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), *kept, ("WARC-Refers-To", record_id), ("WARC-Concurrent-To", other),
                  ("X-Source-Payload-Digest", source), ("WARC-Block-Digest", digest(body)), ("Content-Type", content), ("Content-Length", str(len(body)))]
        return own, kind, fields, body

    return [record(meta_id, text_id, "metadata", "application/json", json.dumps(envelope, ensure_ascii=False).encode("utf-8", "replace")),
            record(text_id, meta_id, "conversion", "text/plain; charset=utf-8", plain_text(page).encode("utf-8", "replace"))]


def _batches(rows):
    """Rows (record_id, type, headers, block) as record batches."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3])
        if len(held) >= BATCH or size >= ROLL:
            yield _batch(held)
            held, size = [], 0
    yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RECORD)], schema=_RECORD)


def lines_of(fields: list[tuple[str, str]]) -> str:
    return "".join([f"{n}: {' '.join(v.splitlines())}\r\n" for n, v in fields])


def fields_of(lines: str) -> list[tuple[str, str]]:
    return [(n.strip(), v.strip()) for n, found, v in (x.partition(":") for x in lines.split("\r\n")) if found]


def _rows(batch: pa.RecordBatch):
    for a in range(0, batch.num_rows, BATCH):
        part = batch.slice(a, BATCH)
        for i, kind, lines, block in zip(*(part.column(n).to_pylist() for n in ("record_id", "type", "headers", "block"))):
            yield i, kind, lines or "", block or b""


def derive(records: DataFrame) -> DataFrame:
    """Response records -> their metadata and conversion records."""
    def each(batches):
        yield from _batches((own, made, lines_of(fields), body) for b in batches for i, kind, lines, block in _rows(b) if kind == "response"
                            for own, made, fields, body in derivatives(i, fields_of(lines), block))

    return small_batches(records).select("record_id", "type", "headers", "block").mapInArrow(each, RECORD)


def responses(pages: DataFrame, date: str, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Response records of fetched pages, the record id made from page_id and
    URL; the page's number goes along as a field of its own."""
    rows = pages.select(pages[f"`{page_id}`"].cast("string").alias("id"), or_empty(pages[f"`{url}`"]).alias("url"), or_empty(pages[f"`{page}`"]).alias("page"))

    def each(batches):
        def records():
            for b in batches:
                for a in range(0, b.num_rows, BATCH):
                    part = b.slice(a, BATCH)
                    for i, target, text in zip(*(part.column(n).to_pylist() for n in ("id", "url", "page"))):
                        payload = text.encode()
                        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                        own = derived_id(f"{i}|{target}", "response")
                        fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Target-URI", target), ("WARC-Date", date),
                                  ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)),
                                  ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
                        yield own, "response", lines_of(fields + ([("X-Page-ID", i)] if i is not None else [])), block

        yield from _batches(records())

    return small_batches(rows).mapInArrow(each, RECORD)


def _member(lines: str, block: bytes) -> bytes:
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def write(records: DataFrame, folder: str) -> int:
    """Write records to ``folder``/*.warc.gz, shared by all executors; the
    number of files."""
    def each(batches):
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        part, names, sink, size = TaskContext.get().partitionId(), [], None, 0
        tag = uuid.uuid4().hex

        def close():
            sink.close()
            fs.move(attempt(names[-1]), names[-1])

        def attempt(name):
            return f"{base}/_{name.rpartition('/')[2]}.{tag}"

        for b in batches:
            for _, _, lines, block in _rows(b):
                if sink is None:
                    names.append(f"{base}/part-{part:06d}-{len(names):04d}.warc.gz")
                    sink, size = fs.open_output_stream(attempt(names[-1]), compression=None), 0
                data = _member(lines, block)
                sink.write(data)
                size += len(data)
                if size >= ROLL:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["n"])

    return records.select("record_id", "type", "headers", "block").mapInArrow(each, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _plain(source):
    """Contents of a file in pieces, its gzip members undone."""
    member, data = None, source.read(PIECE)
    while data:
        if member is None:
            if len(data) == 1:
                data += source.read(PIECE)
            if data[:2] != b"\x1f\x8b":
                yield data
                while data := source.read(PIECE):
                    yield data
                return
            member = zlib.decompressobj(31)
        yield member.decompress(data)
        data = b""
        if member.eof:
            data, member = member.unused_data, None
        data = data or source.read(PIECE)
    if member is not None:
        raise ValueError("a gzip member is cut off")


def parsed(source):
    """Records of a WARC file (bytes or an open file), gzipped by member or plain."""
    pieces, held = _plain(io.BytesIO(source) if isinstance(source, bytes) else source), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while True:  # line ends after a record
            lead = next((i for i, c in enumerate(held) if c not in b"\r\n"), len(held))
            del held[:lead]
            if held or not more():
                break
        if not held:
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                raise ValueError("the header of a record is cut off")
        lines = held[:end].decode("utf-8", "replace").partition("\r\n")[2] + "\r\n"
        by = {n.lower(): v for n, v in fields_of(lines)}
        own, end = by.get("warc-record-id"), end + 4
        whole = end + int(by.get("content-length") or 0)
        while len(held) < whole:
            if not more():
                raise ValueError(f"record {own} is cut off")
        block = bytes(held[end:whole])
        del held[:whole]
        stated = by.get("warc-block-digest", "")
        if stated.startswith("sha1:") and len(stated) == 37 and stated != digest(block):
            raise ValueError(f"the block of record {own} does not fit its digest")
        yield own, by.get("warc-type"), lines, block


def read(spark: SparkSession, path: str) -> DataFrame:
    def each(batches):
        def records():
            for b in batches:
                for name in b.column("path").to_pylist():
                    fs, base = _filesystem(quote(name, safe="/:@%"))
                    with fs.open_input_stream(base, compression=None, buffer_size=1 << 20) as source:
                        yield from parsed(source)

        yield from _batches(records())

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path).select("path").mapInArrow(each, RECORD)


def field(name: str):
    """The value of a named field, null if there is none."""
    return F.nullif(F.regexp_extract("headers", rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = shared_folder(spark, "warc")
    if not write(derive(responses(pages, date="2024-01-01T00:00:00Z")), folder):
        records = spark.createDataFrame([], RECORD)
    else:
        records = read(spark, folder)
    return records.select(
        field("X-Page-ID").cast("long").alias("page_id"), F.col("type").alias("warc_type"), "record_id", field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Concurrent-To").alias("concurrent_to"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("date"),
        field("X-Source-Payload-Digest").alias("source_digest"), field("WARC-Block-Digest").alias("block_digest"), field("Content-Type").alias("content_type"),
        F.col("block").cast("string").alias("content"))
