"""Derivatives of web archive responses: metadata and plain-text records.

A response record becomes two records that name it in ``WARC-Refers-To``:

* ``metadata`` with a JSON block: the source record's headers, its HTTP status
  line and headers, its digests, the page's title and its links;
* ``conversion`` with the page's text in plain form.

Both carry the target address and date of the source, the digest of the source
payload and a digest of their own block.  Records are built where the response
is read; nothing is shuffled.

Defined cases: a null body counts as empty; a null address gives a record
without ``WARC-Target-URI``; repeated responses give repeated derivatives;
other columns are ignored; an empty input gives no record; a head ends at its
end tag or at the first thing that cannot stand in a head; of a hidden element
without an end tag only the tag is left out, but script and style hide the rest
of the page, as in a browser.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_arrow, slices

RECORD = ("record_id string, warc_type string, refers_to string, target_uri string, warc_date string, "
          "content_type string, content_length long, block_digest string, payload_digest string, block binary")
ARROW = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("refers_to", pa.string()),
                   ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()),
                   ("content_length", pa.int64()), ("block_digest", pa.string()), ("payload_digest", pa.string()),
                   ("block", pa.binary())])
#: Names that the record format uses.
VERSION = "WARC/1.1"
FIELDS = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "refers_to": "WARC-Refers-To",
          "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "content_type": "Content-Type",
          "content_length": "Content-Length", "block_digest": "WARC-Block-Digest",
          "payload_digest": "WARC-Payload-Digest"}
HTTP_TYPE = "application/http; msgtype=response"
#: Elements whose ends break a line of plain text.
BREAKS = ("address article aside blockquote body br dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 head header hr "
          "html li main nav ol option p pre section select table tbody td tfoot th thead title tr ul").split()
HIDDEN = "script style noscript template head iframe object".split()
TO_THE_END = {"script", "style"}  # without an end tag

_GONE = re.compile(r"<!--.*?(?:-->|$)|<(%s)\b[^>]*>|<[!?][^>]*(?:>|$)" % "|".join(HIDDEN), re.I | re.S)
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}
_IN_HEAD = re.compile(r"""\s+|<!--.*?-->|<(title|style|script|noscript|template|noframes)\b[^>]*>.*?</\1\s*>|<(?:base|basefont|bgsound|head|link|meta)\b[^>]*>
                          |</(?!(?:head|body|html|br)\b)[a-z][^>]*>|<[!?](?!--)[^>]*>""", re.I | re.S | re.X)
_BREAK = re.compile(r"</?(?:%s)\b[^>]*(?:>|$)" % "|".join(BREAKS), re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*(?:>|$)")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|$)", re.I | re.S)
_LINK = re.compile(r"""<a\s[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def derived_id(source: str, kind: str) -> str:
    """Record id that depends on the source id and the kind alone, so that a
    task that runs again gives the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{source}')}>"


def without_hidden(page: str) -> str:
    """The page with a space for each comment, declaration and hidden element."""
    out, at, endless = [], 0, set()
    while found := _GONE.search(page, at):
        out += page[at:found.start()], " "
        at, name = found.end(), (found[1] or "").lower()
        if name == "head":
            while part := _IN_HEAD.match(page, at):
                at = part.end()
            if end := _END[name].match(page, at):
                at = end.end()
        elif name and name not in endless:
            if end := _END[name].search(page, at):
                at = end.end()
            elif name in TO_THE_END:
                at = len(page)
            else:
                endless.add(name)
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """Visible text, one line per block, white space inside a line collapsed."""
    page = _TAG.sub("", _BREAK.sub("\x00", without_hidden(page.replace("\x00", " "))))
    lines = (" ".join(html.unescape(line).split()) for line in page.split("\x00"))
    return "\n".join(line for line in lines if line)


def split_http(block: bytes) -> tuple[str, list[list[str]], bytes]:
    """Status line, headers and body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], [[k, v.strip()] for k, _, v in (x.partition(":") for x in lines[1:])], body


def derive(response: dict) -> list[dict]:
    """The two records for one response record."""
    block = response["block"] or b""
    status, headers, body = split_http(block)
    page = body.decode("utf-8", "replace")
    title = _TITLE.search(page)
    source = {FIELDS[k]: response[k] for k in FIELDS if response.get(k) is not None}
    payload = response.get("payload_digest") or digest(body)
    text = plain_text(page).encode()
    envelope = {
        "source": source, "status": status, "headers": headers, "block_digest": digest(block), "payload_digest": payload,
        "payload_length": len(body), "title": " ".join(html.unescape(title[1]).split()) if title else None,
        "links": [html.unescape(a or b or c) for a, b, c in _LINK.findall(page)], "text_digest": digest(text)}
    out = []
    for kind, mime, data in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False).encode()),
                             ("conversion", "text/plain", text)):
        out.append({
            "record_id": derived_id(response["record_id"], kind), "warc_type": kind, "refers_to": response["record_id"],
            "target_uri": response["target_uri"], "warc_date": response["warc_date"], "content_type": mime,
            "content_length": len(data), "block_digest": digest(data), "payload_digest": payload, "block": data})
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """Metadata and conversion records for a table of response records."""
    need = [c.split()[0] for c in RECORD.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "block"):
            yield pa.RecordBatch.from_pylist([x for r in piece.to_pylist() for x in derive(r)], schema=ARROW)

    return map_arrow(responses.filter(F.col("warc_type") == "response").select(*need), build, RECORD)


def responses_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records that hold the given pages, as a crawler writes them."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    hexed = F.md5(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("url")))
    dashed = F.regexp_replace(hexed, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    block = F.concat(F.encode(head, "utf-8"), body)
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"), F.lit("response").alias("warc_type"),
        F.lit(None).cast("string").alias("refers_to"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"),
        F.lit(HTTP_TYPE).alias("content_type"), F.octet_length(block).cast("long").alias("content_length"),
        F.concat(F.lit("sha256:"), F.sha2(block, 256)).alias("block_digest"),
        F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("payload_digest"), block.alias("block"))


def record_bytes(record: dict) -> bytes:
    lines = [VERSION] + [f"{name}: {record[k]}" for k, name in FIELDS.items() if record.get(k) is not None]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + (record["block"] or b"") + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write each partition as a gzipped archive, one member per record, and
    return the files written: ``path``, ``records``.  A file's name is new in
    each attempt, so files of lost attempts are never in the list."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                for record in batch.to_pylist():
                    out.write(gzip.compress(record_bytes(record), mtime=0))
                    n += 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "records": [n]})

    return map_arrow(records.select(*[c.split()[0] for c in RECORD.split(", ")]), write, "path string, records long")


def parse_warc(stream) -> Iterator[dict]:
    """Records of an uncompressed archive stream."""
    kinds = {v.lower(): k for k, v in FIELDS.items()}
    while line := stream.readline():
        if not line.strip():
            continue
        record: dict = dict.fromkeys(FIELDS)
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            if name.lower() in kinds:
                record[kinds[name.lower()]] = value.strip()
        record["content_length"] = int(record["content_length"] or 0)
        record["block"] = stream.read(record["content_length"])
        yield record


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of gzipped archives, one task per file, read as a stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(name, compression=None) as raw, gzip.open(raw) as stream:
                    for record in parse_warc(stream):
                        yield pa.RecordBatch.from_pylist([record], schema=ARROW)

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return map_arrow(listed, read, RECORD)
