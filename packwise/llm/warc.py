"""WARC derivatives: metadata and plain-text conversion records made from responses, with DataFrame functions only.

Each page is a response record. Its id is a urn:uuid from the sha-256 of url, page id and content, so a second run makes
the same records. Where the input has a column with the HTTP head of the response, it is part of the block, and its status,
content type, date and last-modified are read from it; a column may give the date of the capture. From a response two
derivatives follow, each with its own id, a WARC-Refers-To naming the response, the source's target URI and date, block
digest and the length in bytes: a `metadata` record (application/warc-fields with title, language, charset, links, the
digests of the source and those headers it has) and a `conversion` record (text/plain). `serialized` gives the text of any
record as it stands in a WARC file.

Text of a page: comments, scripts, styles and templates go; block tags end lines; other tags go; character references,
named and numeric, are resolved once; blanks are joined and empty lines dropped.

Defined cases: a null page is an empty block; a null url leaves the target URI empty; a null or missing head or date leaves
out its fields (the date is then DATE: a record must have one); a numeric reference that is no character (zero, a surrogate,
beyond U+10FFFF) becomes U+FFFD; repeated rows give repeated records (with equal ids); an empty table gives no records; a page
without title or links has empty fields; very long pages are taken whole; further columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the text conversion, in their order, and named character references.
DROPPED = [r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<head\b.*?</head\s*>", r"(?is)<template\b.*?</template\s*>"]
LINE_TAGS = r"(?i)</?(p|div|br|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|section|article|nav|header|footer|main|blockquote|pre|td|th)\b[^>]*>"
OTHER_TAGS = r"<[/!?a-zA-Z][^>]*>"
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7")]
NUMERIC = "&#([0-9]+|[xX][0-9a-fA-F]+);"
CHARSET = r"(?i)<meta\b[^>]*\bcharset=[\"']?([^\s\"'/>;]+)"
HEADERS = [("source-content-type", "content-type"), ("source-last-modified", "last-modified"), ("source-http-date", "date")]
DATE = "2026-01-01T00:00:00Z"


def _character(number: Column) -> Column:
    """The character of a numeric reference; an ampersand stays a named reference, which is resolved last."""
    digits = F.regexp_replace(number, "^[xX]?0*", "")
    base = F.when(number.rlike("^[xX]"), F.lit(16)).otherwise(F.lit(10))
    code = F.when(F.length(digits) <= 7, F.when(base == 16, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int"))
    sound = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    made = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code == 38, F.lit("&amp;")).when(sound, made).otherwise(F.lit("\ufffd"))


def named(text: Column) -> Column:
    """Named character references resolved, but for the ampersand."""
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def numbered(text: Column) -> Column:
    """Numeric references and then the ampersand resolved; after `named`, each is resolved once: what a resolved one forms with its
    neighbours is no reference. The text is used several times: a column that is there already, no long expression."""
    between = F.split(text, NUMERIC, -1)
    chars = F.concat(F.transform(F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(1)), _character), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(between, chars, lambda part, char: F.concat(part, char)), "")
    return F.replace(F.when(F.contains(text, F.lit("&#")), joined).otherwise(text), F.lit("&amp;"), F.lit("&"))


def without_tags(html: Column) -> Column:
    text = F.coalesce(html, F.lit(""))
    for pattern in DROPPED:
        text = F.regexp_replace(text, pattern, " ")
    return F.regexp_replace(F.regexp_replace(text, LINE_TAGS, "\n"), OTHER_TAGS, "")


def tidy(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r" ?\n ?", "\n"), r"\n+", "\n"), r"^[ \n]+|[ \n]+$", "")


def _uuid(hexes: Column) -> Column:
    parts = [F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", head: str | None = None, date: str | None = None
) -> DataFrame:
    """(page_id, type, record_id, uri, date, content_type, head, payload, block, block_digest, payload_digest) of the source records.

    head: column with status line and header lines of the response; date: column with the time of the capture, as text.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    above = F.col(head) if head else F.lit(None).cast("string")
    block = F.concat(F.coalesce(F.concat(above, F.lit("\r\n\r\n")), F.lit("")), payload)
    uri = F.coalesce(F.col(url), F.lit(""))
    key = F.sha2(F.concat_ws("\n", F.lit("response"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), uri, block).cast("binary"), 256)
    when = F.coalesce(F.col(date), F.lit(DATE)) if date else F.lit(DATE)
    kind = F.when(above.isNotNull(), F.lit("application/http; msgtype=response")).otherwise(F.lit("text/html"))
    return pages.select(
        F.col(page_id).alias("page_id"), F.lit("response").alias("type"), _uuid(key).alias("record_id"), uri.alias("uri"), when.alias("date"),
        kind.alias("content_type"), above.alias("head"), payload.alias("payload"), block.alias("block"), _digest(block).alias("block_digest"),
        _digest(payload).alias("payload_digest"),
    )


def derivatives(sources: DataFrame) -> DataFrame:
    """Two records for each response: metadata and conversion, linked to it, with the digests of its block and payload."""
    title = F.regexp_extract("payload", r"(?is)<title\b[^>]*>(.*?)</title", 1)
    language = F.regexp_extract("payload", r"(?i)<html\b[^>]*\blang=\"([^\"]*)\"", 1)
    charset = F.lower(F.regexp_extract("payload", CHARSET, 1))
    links = F.size(F.regexp_extract_all("payload", F.lit(r"(?i)<a\b[^>]*\bhref=\"([^\"]*)\""), 1))
    found = sources.select("*", named(without_tags(F.col("payload"))).alias("plain"), named(title).alias("title"), language.alias("language"), charset.alias("charset"), links.alias("links"))
    made = found.withColumns({"plain": tidy(numbered(F.col("plain"))), "title": F.trim(F.regexp_replace(numbered(F.col("title")), r"\s+", " "))})

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def header(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("head", pattern, 1), F.lit(""))

    own = [line("source-status", header(r"^HTTP/\S+[ \t]+([0-9]{3})"))]
    own += [line(name, header(rf"(?im)^{of}:[ \t]*([^\r\n]*)")) for name, of in HEADERS]
    fields = F.concat(
        line("title", F.col("title")), line("language", F.col("language")), line("charset", F.col("charset")), line("outlinks", F.col("links").cast("string")),
        line("source-digest", F.col("block_digest")), line("source-payload-digest", F.col("payload_digest")), *[F.coalesce(h, F.lit("")) for h in own],
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("plain").alias("block")),
    )
    each = made.select("page_id", "record_id", "uri", "date", "block_digest", "payload_digest", F.explode(kinds).alias("new"))
    key = F.sha2(F.concat_ws("\n", "new.type", "record_id").cast("binary"), 256)
    return each.select(
        "page_id", "new.type", _uuid(key).alias("record_id"), F.col("record_id").alias("refers_to"), "uri", "date", "new.content_type", "new.block",
        _digest(F.col("new.block")).alias("block_digest"), F.col("block_digest").alias("source_digest"), F.col("payload_digest").alias("source_payload_digest"),
        F.octet_length("new.block").cast("long").alias("content_length"),
    )


def serialized(records: DataFrame) -> DataFrame:
    """(page_id, type, record): the text of each record as it stands in a WARC/1.1 file."""
    refers = F.when(F.lit("refers_to" in records.columns), F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to") if "refers_to" in records.columns else F.lit(""), F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("type"), F.lit("\r\nWARC-Record-ID: "), F.col("record_id"), F.lit("\r\nWARC-Date: "), F.col("date"), F.lit("\r\n"), refers,
        F.lit("WARC-Target-URI: "), F.col("uri"), F.lit("\r\nWARC-Block-Digest: "), F.col("block_digest"), F.lit("\r\nContent-Type: "), F.col("content_type"),
        F.lit("\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"),
    )
    return records.select("page_id", "type", F.concat(head, F.col("block"), F.lit("\r\n\r\n")).alias("record"))
