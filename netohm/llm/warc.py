"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

responses() frames raw pages as response records; derivatives() makes of each response one metadata record (title, language,
counts of links and of characters) and one conversion record (plain text). Both carry WARC-Refers-To with the response's
record id, its target URI and date, the response's own headers in the metadata block, and SHA-1 digests of blocks and
payloads. write_records() and read_records() keep records as WARC 1.1 text files, one gzip stream for each part file.

Defined cases: null html is an empty page; null url becomes an empty target URI; a page without title has an empty one; repeated
rows give repeated records with one id; extra columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netohm.llm.work import ship

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
RECORD = ("record_id", "warc_type", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "payload_digest", "content_length", "block")


def record_id(kind: str, *parts: Column) -> Column:
    """A stable urn:uuid from a digest of the parts."""
    d = F.md5(F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts]))
    cut = [F.substring(d, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(F.encode(x, "UTF-8")))


def plain_text(html: Column) -> Column:
    """Visible text: without scripts, styles and comments; block ends become line ends, tags spaces, entities characters."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<title[^>]*>.*?</title>", " ")
    t = F.regexp_replace(t, r"[ \t\r\n]{2,}|[\t\r\n]", " ")  # a single space may stay as it is
    t = F.regexp_replace(t, r"(?i)<(?:/(?:p|div|li|h[1-6]|tr|ul|ol|article|nav)|br ?/?)>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]{2,}|\t", " ")
    t = F.regexp_replace(t, r" \n[ \n]*|\n[ \n]+", "\n")
    return F.trim(t, F.lit(" \n"))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of pages (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF))
    block = F.concat(head, F.lit(CRLF), html)
    return pages.select(
        "page_id",
        record_id("response", F.col("page_id"), F.coalesce("url", F.lit(""))).alias("record_id"),
        F.lit("response").alias("warc_type"),
        F.lit(None).cast("string").alias("refers_to"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit(DATE).alias("warc_date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        digest(block).alias("block_digest"),
        digest(html).alias("payload_digest"),
        F.octet_length(block).cast("long").alias("content_length"),
        block.alias("block"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records; other columns but those of RECORD pass through."""
    rest = [c for c in records.columns if c not in RECORD]
    blank = CRLF + CRLF
    source = records.where(F.col("warc_type") == "response")
    body = F.substring(F.col("block"), F.locate(blank, F.col("block")) + 4, F.length("block"))
    split = source.select("*", F.substring_index("block", blank, 1).alias("__head"), F.when(F.locate(blank, F.col("block")) > 0, body).otherwise(F.col("block")).alias("__html"))
    title = F.regexp_extract("__html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    lang = F.regexp_extract("__html", r"(?i)<html[^>]* lang=.([A-Za-z-]+)", 1)
    links = F.regexp_count("__html", F.lit(r"(?i)<a [^>]*href="))
    text = plain_text(F.col("__html"))
    split = split.select("*", text.alias("__text"))
    fields = F.concat(
        F.lit("title: "), F.regexp_replace(title, r"[\r\n]+", " "), F.lit(CRLF + "language: "), lang, F.lit(CRLF + "links: "), links.cast("string"), F.lit(CRLF + "text-chars: "),
        F.length("__text").cast("string"), F.lit(CRLF + "source-payload-digest: "), F.col("payload_digest"), F.lit(CRLF + "source-headers: "),
        F.regexp_replace("__head", r"\r\n", "; "), F.lit(CRLF),
    )

    def record(kind: str, content_type: str, block: Column) -> Column:
        return F.struct(
            record_id(kind, F.col("record_id")).alias("record_id"), F.lit(kind).alias("warc_type"), F.lit(content_type).alias("content_type"), digest(block).alias("block_digest"),
            F.octet_length(block).cast("long").alias("content_length"), block.alias("block"),
        )

    split = split.select("*", fields.alias("__fields"))
    both = F.array(record("metadata", "application/warc-fields", F.col("__fields")), record("conversion", "text/plain; charset=utf-8", F.col("__text")))
    out = split.select(*rest, F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "payload_digest", F.inline(both))
    return out.select(*rest, *RECORD)


def write_records(records: DataFrame, target: str) -> None:
    """WARC/1.1 text, gzipped by part file; Content-Length is that of the block as written."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(CRLF))).otherwise(F.lit(""))
    c = F.col
    block = F.coalesce("block", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", c("warc_type")), line("WARC-Record-ID", c("record_id")), line("WARC-Refers-To", c("refers_to")), line("WARC-Target-URI", c("target_uri")),
        line("WARC-Date", c("warc_date")), line("WARC-Block-Digest", c("block_digest")), line("WARC-Payload-Digest", c("payload_digest")), line("Content-Type", c("content_type")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    records.select(F.concat(head, F.lit(CRLF), block).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(target)


MARK = b"\r\n\r\nWARC/1."
FIELDS = {"record_id": b"warc-record-id", "warc_type": b"warc-type", "refers_to": b"warc-refers-to", "target_uri": b"warc-target-uri", "warc_date": b"warc-date", "content_type": b"content-type", "block_digest": b"warc-block-digest", "payload_digest": b"warc-payload-digest"}


def _head(part: bytes) -> dict[bytes, bytes] | None:
    """Header fields by name in small letters; None if this is no head of a record."""
    end = part.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = part[:end].split(b"\r\n")[1:]
    fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(b":") for x in lines)}
    return fields if b"warc-type" in fields and fields.get(b"content-length", b"").isdigit() else None


def _joined(batches):
    """Records of parts in file order: a record starts where the one before it has ended, and takes parts until Content-Length is reached, whatever they hold."""
    file, open_, held, need = None, None, [], 0

    def record():
        whole = MARK.join(held)
        at = whole.find(b"\r\n\r\n") + 4
        n = int(open_[b"content-length"])
        text = lambda b: b.decode("utf-8", "replace")
        row = {k: text(open_[f]) if f in open_ else None for k, f in FIELDS.items()}
        return row | {"target_uri": row["target_uri"] or "", "content_length": n, "block": text(whole[at : at + n])}

    for b in batches:
        out = []
        for name, part in zip(b.column("file").to_pylist(), b.column("value")):
            part = part.as_py()
            if name != file:
                file, open_ = name, None
            if open_ is None:
                open_ = _head(part)
                if open_ is None:  # between records, or text that is no WARC
                    continue
                held, need = [part], part.find(b"\r\n\r\n") + 4 + int(open_[b"content-length"]) - len(part)
            else:
                held.append(part)
                need -= len(MARK) + len(part)
            if need <= 0:
                out.append(record())
                open_ = None
        yield pa.RecordBatch.from_pylist(out, schema=READ)


READ = pa.schema([(c, pa.int64() if c == "content_length" else pa.string()) for c in RECORD])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC text files, plain or gzipped, cut by Content-Length: text that looks like a record's head stays in its block.

    One task takes a file's parts between marks in their order, as only the lengths from its start on tell where records begin. A gzipped
    file is read by one task; the parts of plain ones, which Spark reads in splits, are dealt by file first. A record that the file cuts short is left out.
    """
    ship(spark)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row")
    raw = spark.read.option("lineSep", MARK.decode()).text(path)
    packed = F.col("_metadata.file_name").endswith(".gz")
    file, value = F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")
    schema = ", ".join(f"{c} {'long' if c == 'content_length' else 'string'}" for c in RECORD)
    whole = raw.where(packed).select(file, value)
    cut = raw.where(~packed).select(file, F.col("_metadata.file_block_start").alias("start"), row, value)
    ordered = cut.repartition("file").sortWithinPartitions("file", "start", "row").select("file", "value")
    return whole.mapInArrow(_joined, schema).unionByName(ordered.mapInArrow(_joined, schema))
