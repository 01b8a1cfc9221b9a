"""WARC derivatives: response records become linked metadata and plain-text conversion records."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame, functions as F

from .common import gapless_rank, materialize

STATUS = "HTTP/1.1 200 OK\r\n"
#: Record types that are built here, in the order of their rows.
KINDS = ("response", "metadata", "conversion")
#: The WARC-Date of responses whose time of capture nobody knows.
DATE = "1970-01-01T00:00:00Z"


def _uuid(*parts: Column) -> Column:
    """A stable record identifier from a digest of ``parts``."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    at = lambda i, n: F.substring(h, i, n)
    return F.concat(F.lit("<urn:uuid:"), at(1, 8), F.lit("-"), at(9, 4), F.lit("-"), at(13, 4), F.lit("-"), at(17, 4), F.lit("-"), at(21, 12), F.lit(">"))


def _sha(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def _digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), _sha(data))


def entities() -> dict[str, str]:
    """Texts of the named character references of HTML that end in ";"; a no-break space is a blank."""
    return {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")} | {"nbsp": " "}


def read_references(text: Column) -> Column:
    """Named and numeric character references as what they stand for; what is none stays."""
    names = F.from_json(F.lit(json.dumps(entities())), "map<string, string>")
    found = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"

    def read(x: Column) -> Column:
        name = F.regexp_extract(x, found, 1)
        hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
        code = F.when(hexadecimal, F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("int")
        char = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        told = F.when(name == "", None).when(name.startswith("#"), char).otherwise(F.try_element_at(names, name))
        return F.coalesce(F.concat(told, F.substring(x, F.length(name) + 2, F.length(x))), F.concat(F.lit("&"), x))

    parts = F.transform(F.split(text, "&"), lambda x, i: F.when(i == 0, x).otherwise(read(x)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def plain_text(page: Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags; block ends are line ends; character references are read."""
    t = F.regexp_replace(page, r"(?is)<(?:!--.*?-->|script\b[^>]*>.*?</script\s*>|style\b[^>]*>.*?</style\s*>|head\b[^>]*>.*?</head\s*>)", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br\s*/?|/(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title)\s*)>", "\n")
    t = read_references(F.regexp_replace(t, r"(?s)<[a-zA-Z/!][^>]*>", ""))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of pages (page_id, url, html), with the headers a server would have sent.

    A null url or html is empty. Pages have no time of capture: ``date`` stands for it. Record ids come from the row, so
    reruns agree; repeated rows are numbered, and a number is part of the id, which stays unique. Other columns are
    ignored. Returns page_id, record_id, target_uri, warc_date, http_header, payload.
    """
    url, page = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "html"))
    header = F.concat(F.lit(STATUS + "Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\n\r\n"))
    ident = _uuid(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, _sha(page))
    out = pages.select("page_id", ident.alias("record_id"), url.alias("target_uri"), F.lit(date).alias("warc_date"), header.alias("http_header"), page.alias("payload"))
    repeated = materialize(out.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("record_id"))
    if not repeated.limit(1).count():
        return out
    some = materialize(out.join(repeated, "record_id", "left_semi").withColumn("_at", F.monotonically_increasing_id()))
    some = gapless_rank(some, ["record_id"], ["_at"], "_k")
    some = some.withColumn("record_id", F.when(F.col("_k") == 0, F.col("record_id")).otherwise(_uuid(F.col("record_id"), F.col("_k").cast("string"))))
    return out.join(repeated, "record_id", "left_anti").select(*out.columns).unionByName(some.select(*out.columns))


def header_fields(header: Column) -> Column:
    """The lines of an HTTP header as ``source-<name>`` fields, folded lines as one and lines without a name as ``source-header``."""
    lines = F.split(F.regexp_replace(header, r"\r\n[ \t]+", " "), "\r\n")
    lines = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x != "")

    def field(x: Column) -> Column:
        named = F.instr(x, ":") > 1
        name = F.when(named, F.lower(F.trim(F.substring_index(x, ":", 1)))).otherwise("header")
        return F.concat(F.lit("source-"), name, F.lit(": "), F.when(named, F.trim(F.regexp_replace(x, r"^[^:]*:", ""))).otherwise(F.trim(x)), F.lit("\r\n"))

    return F.array_join(F.transform(lines, field), "")


def derivatives(resp: DataFrame) -> DataFrame:
    """The response, a metadata and a conversion record for each row of ``resp`` (see ``responses``).

    Metadata and conversion refer to the response's record id and keep its target URI and date (``DATE`` where it has
    none). The metadata block holds the response's status, the digests of its payload and of the conversion, and all its
    header lines; the conversion block is the page's plain text. Record ids come from the response's id, so reruns agree.
    Empty pages get empty conversions. A null payload or header is empty, a null record id is made from page_id, URI, header
    and payload, a null URI has no line in its records. One pass, no shuffle. Other columns are ignored.
    Returns page_id, warc_type, record_id, refers_to, target_uri, warc_date, content_type, block, block_digest,
    payload_digest, content_length long (bytes), record (the record as it stands in a file).
    """
    date = F.coalesce(F.col("warc_date"), F.lit(DATE)) if "warc_date" in resp.columns else F.lit(DATE)
    header, payload, uri = (F.coalesce(F.col(c), F.lit("")) for c in ("http_header", "payload", "target_uri"))
    ident = F.coalesce("record_id", _uuid(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri, _sha(F.concat(header, payload))))
    r = resp.select("page_id", ident.alias("record_id"), "target_uri", date.alias("warc_date"), header.alias("http_header"), payload.alias("payload")).withColumn("text", plain_text(F.col("payload")))
    r = r.withColumns({"payload_digest": _digest(F.col("payload")), "text_digest": _digest(F.col("text")), "conversion_id": _uuid(F.lit("conversion"), F.col("record_id"))})
    status = F.regexp_extract("http_header", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    fields = F.concat(
        F.lit("source-status: "), status, F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"), F.lit("\r\nconversion-record-id: "), F.col("conversion_id"),
        F.lit("\r\nconversion-block-digest: "), F.col("text_digest"), F.lit("\r\n"), header_fields(F.col("http_header")),
    )
    r = r.withColumns({"fields": fields, "answer": F.concat("http_header", "payload")})
    none = F.lit(None).cast("string")

    def record(kind: str, ident: Column, refers: Column, content: str, block: Column, digest: Column, payload: Column) -> Column:
        return F.struct(F.lit(kind).alias("warc_type"), ident.alias("record_id"), refers.alias("refers_to"), F.lit(content).alias("content_type"), block.alias("block"), digest.alias("block_digest"), payload.alias("payload_digest"))

    own = F.col("record_id")
    kinds = F.array(
        record("response", own, none, "application/http; msgtype=response", F.col("answer"), _digest(F.col("answer")), F.col("payload_digest")),
        record("metadata", _uuid(F.lit("metadata"), own), own, "application/warc-fields", F.col("fields"), _digest(F.col("fields")), none),
        record("conversion", F.col("conversion_id"), own, "text/plain", F.col("text"), F.col("text_digest"), none),
    )
    out = r.select("page_id", "target_uri", "warc_date", F.explode(kinds).alias("r")).select("page_id", "target_uri", "warc_date", "r.*")
    out = out.withColumn("content_length", F.octet_length("block").cast("long"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("warc_date")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Payload-Digest", F.col("payload_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
    )
    columns = ("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block", "block_digest", "payload_digest", "content_length")
    return out.select(*columns, F.concat(head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).alias("record"))
