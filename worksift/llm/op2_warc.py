"""WARC derivatives: linked metadata and plain-text conversion records for response records.

Each response gives two records that refer to it by its own id: a ``metadata`` record with what the page says about itself, and
a ``conversion`` record with its text. Both keep the response's target, date, HTTP headers and digests. Digests that the
response's record states are preserved as they stand; only missing ones are computed. Ids of new records follow from their
content, so a rerun or a lost task makes the same ones. Everything is a projection: no shuffle, whatever a host's share of the rows.

``responses`` takes such records from WARC files, ``responses_of_pages`` makes them for tables of pages, which state
only an address and a payload: there id, headers and date are ours. ``write_warc`` writes one gzip member a record, ``read_warc``
reads members by their ``Content-Length``, so blocks come back byte by byte whatever they hold.

Defined results: a null address or payload is empty and still gives both records; repeated rows give equal records; a null
page_id is carried along; extra columns are ignored; an empty table gives no rows. Malformed HTML is read leniently: an
unclosed script or style hides the rest, unknown entities stay as they are. Payloads that aren't UTF-8 are read by the
charset of their content type, and bytes that it doesn't have become replacement characters.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Elements whose text isn't shown, and elements that start a new line.
HIDDEN = {"script", "style", "noscript", "template", "title"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
#: Schemes of stores that a reading task opens itself, and bytes of records that it hands on at once, about.
STREAMED, BATCH_BYTES = ("", "file", "s3", "s3a", "gs"), 8 << 20


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.shown: list[str] = []
        self.title: list[str] = []
        self.links: list[str] = []
        self.lang, self.hidden = "", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if tag == "a" and named.get("href"):
            self.links.append(named["href"])
        if tag == "html":
            self.lang = named.get("lang") or ""
        if tag in HIDDEN:
            self.hidden.append(tag)
        if tag in BLOCKS:
            self.shown.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        if tag in BLOCKS:
            self.shown.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.shown.append(data)
        elif self.hidden[-1] == "title":
            self.title.append(data)


def read_page(html: str | None) -> tuple[str, str, str, list[str]]:
    """(text, title, language, links): lines of the text are stripped, inner white space is one space, empty lines go."""
    page = _Page()
    page.feed(html or "")
    page.close()
    lines = (" ".join(x.split()) for x in "".join(page.shown).split("\n"))
    return "\n".join(x for x in lines if x), " ".join("".join(page.title).split()), page.lang, page.links


def decoded(payload: bytes, http: str) -> str:
    """A payload as text, by the charset that its HTTP headers name, else UTF-8."""
    named = re.search(r"(?im)^content-type:[^\r\n]*charset=[\"']?([\w.:-]+)", http)
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _read(rows: DataFrame) -> DataFrame:
    """Add text, title, lang and links of each payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read_page(decoded(bytes(x), h)) for x, h in zip(batch["payload"], batch["http"], strict=True)]
            read = pd.DataFrame(found, columns=["text", "title", "lang", "links"], index=batch.index)
            yield pd.concat([batch.drop(columns="payload"), read], axis=1)

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "payload")
    return rows.mapInPandas(run, f"{schema}text string, title string, lang string, links array<string>")


def _digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data.cast("binary"), 256))


def _record_id(*parts: Column) -> Column:
    name = F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def _header(*pairs: tuple[str, Column]) -> Column:
    """Named fields, one a line; line breaks in a value become spaces."""
    return F.concat(*(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit(CRLF)) for name, value in pairs))


def responses_of_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Responses (page_id, record_id, target_uri, date, http, payload, block_digest, payload_digest) for (page_id, url, html)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), _header(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.octet_length(html))))
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("target_uri"), F.lit(date).alias("date"), http.alias("http"), html.alias("payload"))
    rows = rows.withColumns({"block_digest": _digest(F.concat("http", F.lit(CRLF), "payload")), "payload_digest": _digest(F.col("payload"))})
    return rows.select("page_id", _record_id(F.lit("response"), F.col("page_id"), F.col("target_uri"), F.col("block_digest")).alias("record_id"), "target_uri", "date", "http", F.col("payload").cast("binary").alias("payload"), "block_digest", "payload_digest")


def responses(records: DataFrame) -> DataFrame:
    """The responses among records that ``read_warc`` read, with their own ids, dates, headers and digests; page_id is null."""
    rows = records.where("record_type = 'response'")
    # Bytes are cut as Latin-1 text, in which every byte is one character.
    at = F.locate(CRLF * 2, F.decode("block", "ISO-8859-1"))
    http = F.decode(F.expr("substring(block, 1, _at + 1)"), "UTF-8")
    rows = rows.withColumn("_at", F.when(at > 0, at).otherwise(F.octet_length("block") - 1))
    rows = rows.withColumns({"http": http, "payload": F.expr("substring(block, _at + 4)")})
    stated = {n: F.try_element_at("headers", F.lit(f"warc-{n}-digest")) for n in ("block", "payload")}
    return rows.select(
        F.lit(None).cast("long").alias("page_id"), "record_id", F.coalesce("target_uri", F.lit("")).alias("target_uri"), F.coalesce("date", F.lit(DATE)).alias("date"), "http", "payload",
        F.coalesce(stated["block"], _digest(F.col("block"))).alias("block_digest"), F.coalesce(stated["payload"], _digest(F.col("payload"))).alias("payload_digest"),
    )


def derivatives(found: DataFrame) -> DataFrame:
    """Two records for each response: ``metadata`` and ``conversion``."""
    columns = ["page_id", "record_id", "target_uri", "date", "http", "block_digest", "payload_digest"]
    rows = _read(found.select(*columns, F.coalesce("payload", F.lit(b"")).alias("payload"))).withColumnsRenamed({"record_id": "response_id", "block_digest": "response_digest"})
    links = F.concat_ws("", F.transform("links", lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, r"[\r\n]+", " "), F.lit(CRLF))))
    about = F.concat(_header(("title", F.col("title")), ("languages-declared", F.col("lang")), ("text-characters", F.length("text")), ("source-payload-digest", F.col("payload_digest"))), links)
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), about.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    out = rows.withColumn("x", F.explode(made)).select("page_id", "target_uri", "date", "http", "response_id", "response_digest", "payload_digest", "x.*")
    out = out.withColumns({"block_digest": _digest(F.col("block")), "content_length": F.octet_length("block").cast("long")})
    out = out.withColumn("record_id", _record_id(F.col("record_type"), F.col("response_id"), F.col("block_digest")))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header(
            ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))), ("WARC-Date", F.col("date")),
            ("WARC-Target-URI", F.col("target_uri")), ("WARC-Refers-To", F.concat(F.lit("<"), "response_id", F.lit(">"))), ("WARC-Refers-To-Date", F.col("date")),
            ("WARC-Block-Digest", F.col("block_digest")), ("X-Source-Block-Digest", F.col("response_digest")), ("X-Source-Payload-Digest", F.col("payload_digest")),
            ("X-Source-HTTP", F.rtrim(F.regexp_replace("http", "(\r\n)+", " | "))), ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length")),
        ),
    )
    return out.select("page_id", "record_type", "record_id", F.col("response_id").alias("refers_to"), "target_uri", "content_type", "content_length", "block_digest", F.col("payload_digest").alias("source_payload_digest"), F.col("response_digest").alias("source_block_digest"), F.col("http").alias("source_headers"), header.alias("header"), "block")


def response_records(found: DataFrame) -> DataFrame:
    """(header, block): the responses themselves as records."""
    block = F.concat(F.col("http").cast("binary"), F.lit(CRLF).cast("binary"), "payload")
    fields = _header(
        ("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Block-Digest", F.col("block_digest")), ("WARC-Payload-Digest", F.col("payload_digest")), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block)),
    )
    return found.select(F.concat(F.lit(f"WARC/1.1{CRLF}"), fields).alias("header"), block.alias("block"))


def write_warc(records: DataFrame, folder: str) -> int:
    """Write (header, block) records below ``folder``, a path or URI that executors reach: one gzip member each, one file for
    each partition. Returns their count. A file appears under its name when it is whole, so a task that is lost or runs twice does no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        name, n = f"{base}/part-{TaskContext.get().partitionId():05d}.warc.gz", 0
        part = f"{base}/_{uuid.uuid4().hex}"
        with system.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for header, block in zip(batch["header"], batch["block"], strict=True):
                    out.write(gzip.compress(header.encode() + CRLF.encode() + bytes(block) + CRLF.encode() * 2, mtime=0))
                n += len(batch)
        system.move(part, name)
        yield pd.DataFrame({"n": [n]})

    return records.select("header", F.col("block").cast("binary").alias("block")).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def inflated(stream, size: int = 1 << 14) -> Iterator[bytes]:
    """The plain bytes of a file, in pieces: a chain of gzip members, perhaps with zeros between them, or what isn't compressed at all."""
    member, plain = None, None
    while data := stream.read(size):
        if plain is None:
            plain = data[:2] != b"\x1f\x8b"
        if plain:
            yield data
            continue
        while data:
            if member is None:
                if not (data := data.lstrip(b"\0")):
                    break
                member = zlib.decompressobj(31)
            if piece := member.decompress(data, 1 << 20):
                yield piece
            data = member.unconsumed_tail
            if member.eof:
                data, member = member.unused_data, None
    if member is not None:
        raise ValueError("the last gzip member ends early")


def records_of(pieces: Iterable[bytes]) -> Iterator[tuple[str, bytes]]:
    """(header, block) of the records in a stream of plain bytes, by their Content-Length. Holds one record at a time."""
    buffer, pieces, ends = bytearray(), iter(pieces), re.compile(rb"[\r\n]*")

    def more() -> bool:
        piece = next(pieces, None)
        if piece:
            buffer.extend(piece)
        return piece is not None

    while True:
        while True:
            del buffer[: ends.match(buffer).end()]
            if buffer:
                break
            if not more():
                return
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(buffer) - 3)
            if not more():
                raise ValueError(f"not a WARC record: {bytes(buffer[:80])!r}")
        head = bytes(buffer[:end])
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        if not head.startswith(b"WARC/") or not length:
            raise ValueError(f"not a WARC record: {head[:80]!r}")
        stop = end + 4 + int(length[1])
        while len(buffer) < stop:
            if not more():
                raise ValueError(f"a block of {len(buffer) - end - 4} of {int(length[1])} bytes")
        yield head.decode("utf-8", "replace") + CRLF, bytes(buffer[end + 4 : stop])
        del buffer[:stop]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, headers, record_type, record_id, refers_to, target_uri, date, block, digest_ok) of records.

    Names of ``headers`` are lower-cased. ``digest_ok`` tells whether the block has its stated SHA-256 or SHA-1 digest, null if none is
    stated. A file is read by one task, as its members have no index, in one pass that holds one record and a batch of ``BATCH_BYTES``,
    however large the file is. Stores of other schemes than ``STREAMED``, which only Spark reaches, give it as one value of 2 GB at most.
    """
    streamed = (path.partition("://")[0] if "://" in path else path.partition(":")[0] if path.startswith("file:") else "") in STREAMED

    def opened(file: str, content) -> io.BufferedIOBase:
        if content is not None:
            return io.BytesIO(content)
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(file.replace("s3a://", "s3://", 1))
        return system.open_input_stream(name, compression=None, buffer_size=1 << 20)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "header", "headers", "block", "digest_ok"]
        for batch in batches:
            for file, content in zip(batch["path"], [None] * len(batch) if streamed else batch["content"], strict=True):
                rows, size = [], 0
                with opened(file, content) as stream:
                    for header, block in records_of(inflated(stream)):
                        names = named(header)
                        rows.append((file, header, names, block, checked(names, block)))
                        size += len(header) + len(block)
                        if size >= BATCH_BYTES or len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=columns)

    def named(header: str) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in header.split(CRLF)[1:]) if sep}

    def checked(headers: dict[str, str], block: bytes) -> bool | None:
        kind, _, value = headers.get("warc-block-digest", "").partition(":")
        if kind.lower() not in ("sha1", "sha256"):
            return None
        found = hashlib.new(kind.lower(), block)
        return value.lower() == found.hexdigest() or value.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("=")

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", True).load(path).select("path", *([] if streamed else ["content"]))
    rows = rows.mapInPandas(run, "file string, header string, headers map<string,string>, block binary, digest_ok boolean")
    field = lambda name: F.try_element_at("headers", F.lit(name))
    bare = lambda name: F.regexp_extract(field(name), "^<?(.*?)>?$", 1)
    return rows.select("file", "header", "headers", field("warc-type").alias("record_type"), bare("warc-record-id").alias("record_id"), bare("warc-refers-to").alias("refers_to"), field("warc-target-uri").alias("target_uri"), field("warc-date").alias("date"), "block", "digest_ok")


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all ``pages``."""
    return derivatives(responses_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
