"""Visible text of an HTML document, as Column expressions."""

from __future__ import annotations

from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktext.functions.text import _col, let

# All named references that end with a semicolon, as the language's standard table has them.
NAMED = {f"&{name}": value for name, value in html5.items() if name.endswith(";")}
# The most common of them besides &amp;.
ENTITIES = (
    ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&cent;", "¢"), ("&pound;", "£"), ("&yen;", "¥"), ("&euro;", "€"), ("&copy;", "©"),
    ("&reg;", "®"), ("&sect;", "§"), ("&deg;", "°"), ("&para;", "¶"), ("&middot;", "·"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"),
    ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&hellip;", "…"), ("&bull;", "•"),
    ("&agrave;", "à"), ("&aacute;", "á"), ("&acirc;", "â"), ("&auml;", "ä"), ("&ccedil;", "ç"),
    ("&egrave;", "è"), ("&eacute;", "é"), ("&ecirc;", "ê"), ("&euml;", "ë"), ("&iacute;", "í"),
    ("&ntilde;", "ñ"), ("&oacute;", "ó"), ("&ouml;", "ö"), ("&uacute;", "ú"), ("&uuml;", "ü"),
    ("&szlig;", "ß"),
)
COMMENT = r"(?s)<!--.*?-->"
HIDDEN = r"(?is)<(script|style)\b.*?</(script|style)\s*>"
ANY_TAG = r"(?s)</?[a-zA-Z!][^>]*>"
REFERENCE = r"(&[a-zA-Z][a-zA-Z0-9]{1,31};|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};)"
MARK = "\u0000"
BUCKETS = 64


def _numeric(part: Column) -> Column:
    """One numeric reference -> its character; surrogates and values out of range stay as written."""
    body = F.regexp_extract(part, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
    code = F.when(part.rlike("^&#[xX]"), F.conv(body, 16, 10)).otherwise(body).cast("int")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(part)


def decode_entities(c: Column | str) -> Column:
    """Decode named and numeric references in one pass; unknown ones stay as written."""
    # A map is searched from its start: the common names have a short one of their own, the others
    # are dealt to BUCKETS short maps by a checksum.
    common = F.create_map(*[F.lit(x) for pair in (*ENTITIES, ("&amp;", "&")) for x in pair])
    dealt = [[("", "")] for _ in range(BUCKETS)]
    for pair in NAMED.items():
        dealt[crc32(pair[0].encode()) % BUCKETS].append(pair)
    names = F.array(*[F.create_map(*[F.lit(x) for pair in own for x in pair]) for own in dealt])

    def rare(part: Column) -> Column:
        return F.try_element_at(F.get(names, F.pmod(F.crc32(part), F.lit(BUCKETS)).cast("int")), part)

    def decoded(part: Column) -> Column:
        return F.when(part.startswith("&#"), _numeric(part)).otherwise(F.coalesce(F.try_element_at(common, part), rare(part), part))

    def split(value: Column) -> Column:
        parts = F.split(F.regexp_replace(value, REFERENCE, f"{MARK}$1{MARK}"), MARK)
        whole = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("&"), decoded(p)).otherwise(p)), "")
        return F.when(value.contains("&"), whole).otherwise(value)

    return let(_col(c), split)


def visible_text(c: Column | str) -> Column:
    """Drop comments, scripts, styles and tags, then decode character references."""
    bare = F.regexp_replace(_col(c), COMMENT, "")
    bare = F.regexp_replace(bare, HIDDEN, "")
    bare = F.regexp_replace(bare, ANY_TAG, "")
    return decode_entities(bare)


def element_text(c: Column | str, tag: str) -> Column:
    """Visible text of the first element of the given name."""
    inner = F.regexp_extract(_col(c), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return visible_text(inner)
