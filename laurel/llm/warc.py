"""WARC derivatives: metadata and plain-text conversion records of responses.

Only DataFrame functions are used. Every response gives one metadata and one conversion
record. Both name the response in WARC-Refers-To and keep its target URI, date, content type and
payload digest in their headers; the metadata record also lists the source's length, the
title, the language and the links. Tags may hold `>` in quoted attributes. Character references
are decoded once, by number or by the names of HTML 4; unknown ones stay as they are. Record ids and digests depend on the response alone, so
a rebuilt file is the same.

Defined results: null HTML is empty; a null URI gives records without WARC-Target-URI; line
breaks and other control characters in a URI are dropped, so it cannot add headers;
repeated responses give repeated records.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
NEWLINE = "\r\n"
BLOCK_TAGS = "p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|th|table|article|section|header|footer|nav|title"
NAMED = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'", "nbsp": " "}
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# What follows a tag's name: quoted values, which may hold `>`, and anything else.
REST = r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>"""
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def clean_uri(uri: Column) -> Column:
    return F.regexp_replace(uri, r"[\x00-\x1F\x7F]", "")


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A URN with the shape of a UUID, made from a digest of the parts."""
    code = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    groups = [F.substring(code, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *groups))


def decode_entities(text: Column) -> Column:
    """Character references replaced by their characters; a no-break space counts as a blank."""
    known = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def decoded(piece: Column, place: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        digits = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(
            F.substring(name, 2, 7))
        code = F.when(F.substring(name, 1, 1) == "#", digits.cast("int"))
        usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        numbered = F.when(code == 0xA0, " ").when(
            usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        character = F.coalesce(numbered, F.try_element_at(known, name))
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        return F.when(place == 0, piece).otherwise(F.coalesce(
            F.concat(character, rest), F.concat(F.lit("&"), piece)))

    return F.array_join(F.transform(F.split(text, "&"), decoded), "")


def plain_text(html: Column) -> Column:
    """Text of a page: no comments, scripts, styles or tags; block tags break lines."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCK_TAGS})(?:>|[\s/]{REST})", "\n")
    text = decode_entities(F.regexp_replace(text, rf"<[/!?A-Za-z]{REST}", ""))
    text = F.regexp_replace(text, r"[ \t\r\x0B\f]+", " ")
    return F.trim(F.regexp_replace(text, r" ?\n[\n ]*", "\n"), F.lit(" \n"))


def title(html: Column) -> Column:
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title\b[^>]*>([^<]*)</title", 1)
    return F.trim(F.regexp_replace(decode_entities(found), r"\s+", " "))


def language(html: Column) -> Column:
    return F.regexp_extract(F.coalesce(html, F.lit("")), r'(?i)<html\b[^>]*\blang="([A-Za-z-]*)"', 1)


def links(html: Column) -> Column:
    """Values of href attributes in order, repeats included."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)
    return F.transform(found, lambda x: clean_uri(decode_entities(x)))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id",
              url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response rows (id, record_id, target_uri, date, content_type, payload_digest, payload)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(
        F.col(id_col).alias("id"), record_id(F.col(id_col), F.col(url_col), html).alias("record_id"),
        clean_uri(F.col(url_col)).alias("target_uri"), F.lit(date).alias("date"),
        F.lit("text/html").alias("content_type"), digest(html).alias("payload_digest"), html.alias("payload"),
    )


def _line(name: str, value: Column) -> Column:
    """`name: value` with the line's end; nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(NEWLINE)), F.lit(""))


def derivatives(found: DataFrame) -> DataFrame:
    """Two records per response: (id, record_type, record_id, refers_to, target_uri, date,
    source_digest, block_digest, content_length, headers, content).
    """
    payload = F.col("payload")
    outlinks = F.array_join(F.transform(links(payload), lambda x: F.concat(F.lit("outlink: "), x, F.lit(NEWLINE))), "")
    fields = F.concat(
        _line("source-content-type", F.col("content_type")), _line("source-payload-digest", F.col("payload_digest")),
        _line("source-length", F.octet_length(payload).cast("string")),
        _line("title", title(payload)), _line("language", language(payload)), outlinks,
    )
    kinds = F.explode(F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("media"),
                 fields.alias("content")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("media"),
                 plain_text(payload).alias("content")),
    ))
    rows = found.select(
        "id", F.col("record_id").alias("refers_to"), "target_uri", "date",
        F.col("payload_digest").alias("source_digest"), "content_type", kinds.alias("made"),
    ).select(
        "id", "refers_to", "target_uri", "date", "source_digest", "content_type", "made.*",
    ).withColumns({
        "record_id": record_id(F.col("refers_to"), F.col("record_type")),
        "block_digest": digest(F.col("content")),
        "content_length": F.octet_length("content").cast("long"),
    })
    angled = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    headers = F.concat(
        F.lit(VERSION + NEWLINE), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", angled("record_id")),
        _line("WARC-Refers-To", angled("refers_to")), _line("WARC-Target-URI", F.col("target_uri")),
        _line("WARC-Date", F.col("date")), _line("Source-Content-Type", F.col("content_type")),
        _line("Source-Payload-Digest", F.col("source_digest")), _line("WARC-Block-Digest", F.col("block_digest")),
        _line("Content-Type", F.col("media")), _line("Content-Length", F.col("content_length").cast("string")),
    )
    return rows.select(
        "id", "record_type", "record_id", "refers_to", "target_uri", "date", "source_digest", "block_digest",
        "content_length", headers.alias("headers"), "content",
    )


def write_warc(records: DataFrame, folder: str) -> None:
    """Write records as gzip-compressed WARC files, one per partition."""
    whole = F.concat("headers", F.lit(NEWLINE), "content")
    (records.select(whole.alias("value")).write.option("lineSep", NEWLINE * 2)
     .option("compression", "gzip").text(folder))


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(headers, content) of files made by `write_warc`.

    Files are cut before version lines; derived contents hold no such line, as text has no
    carriage returns and fields start with their names.
    """
    rows = spark.read.option("lineSep", VERSION + NEWLINE).text(folder).where("value <> ''")
    end = F.instr("value", F.lit(NEWLINE * 2))
    length = F.regexp_extract("value", r"\r\nContent-Length: ([0-9]+)\r\n", 1)
    body = F.expr("substring(value, instr(value, '\\r\\n\\r\\n') + 4)").cast("binary")
    return rows.select(
        F.concat(F.lit(VERSION + NEWLINE), F.expr("left(value, instr(value, '\\r\\n\\r\\n') + 1)")).alias("headers"),
        F.substring(body, F.lit(1), length.cast("int")).cast("string").alias("content"),
    ).where(end > 0)
