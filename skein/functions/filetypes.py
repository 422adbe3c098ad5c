"""File names, types and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File type by extension; other extensions are ``unknown``.
EXTENSIONS = {
    "pdf": "pdf", "doc": "doc", "docx": "doc", "hwp": "hwp", "rtf": "rtf", "txt": "txt", "md": "txt", "csv": "txt", "log": "txt", "conf": "txt", "ini": "txt", "cfg": "txt",
    "xls": "excel", "xlsx": "excel", "xlsm": "excel", "xlsb": "excel", "ppt": "pptx", "pptx": "pptx", "pps": "pptx", "ppsx": "pptx", "msg": "msg", "eml": "msg",
    "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image", "tiff": "image", "tif": "image", "webp": "image", "svg": "image", "ico": "image",
}
#: File type by a part of the content type, first match first.
CONTENT_TYPES = [
    ("pdf", "pdf"), ("image", "image"), ("text/plain", "txt"), ("rtf", "rtf"), ("msword", "doc"), ("officedocument.wordprocessingml", "doc"), ("hwp", "hwp"), ("hancom", "hwp"),
    ("msg", "msg"), ("application/vnd.ms-outlook", "msg"), ("excel", "excel"), ("spreadsheetml", "excel"), ("powerpoint", "pptx"), ("presentationml", "pptx"),
]
#: First bytes of a file, in hexadecimal.
MAGIC = [("7B5C727466", "rtf"), ("25504446", "pdf"), ("504B0304", "zip"), ("D0CF11E0A1B11AE1", "ole"), ("89504E47", "image"), ("FFD8FF", "image"), ("47494638", "image")]


def base_name(name: Column) -> Column:
    """The last part of a path or link, without its query."""
    return F.substring_index(F.substring_index(name, "?", 1), "/", -1)


def extension(name: Column) -> Column:
    """The extension in lower case, without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(name), r"[^.]\.([^.]+)$", 1))


def type_by_extension(name: Column) -> Column:
    """File type by extension; ``unknown`` without one, for ``.null``, long and unlisted ones, and for null."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit("unknown"))


def type_by_content(content_type: Column) -> Column:
    low = F.lower(content_type)
    out = F.lit("unknown")
    for part, kind in reversed(CONTENT_TYPES):
        out = F.when(F.contains(low, F.lit(part)), F.lit(kind)).otherwise(out)
    return out


def type_by_magic(content: Column) -> Column:
    """File type by the first bytes; ``unknown`` otherwise."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit("unknown")
    for start, kind in reversed(MAGIC):
        out = F.when(head.startswith(start), F.lit(kind)).otherwise(out)
    return out


def valid_name(name: Column) -> Column:
    """Whether a name is that of a file: an extension that is not ``.null``, three characters and a letter or digit."""
    t = F.trim(name)
    return F.coalesce((F.length(t) >= 3) & F.contains(t, F.lit(".")) & ~F.lower(t).endswith(".null") & t.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def sanitized_name(name: Column) -> Column:
    """Ten digits of the name's md5, and its extension."""
    ext = extension(name)
    return F.concat(F.substring(F.md5(name), 1, 10), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit("")))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(name, "?", 1), "[^A-Za-z0-9._-]", "_")


def name_of_link(url: Column) -> Column:
    """The file a link names, without a leading UUID."""
    return F.regexp_replace(base_name(url), r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}[_-]?", "")


def link_expired(url: Column, now: Column) -> Column:
    """Whether a signed link (``X-Amz-Date`` and ``X-Amz-Expires``) is over at ``now``; false without these."""
    part = lambda key: F.regexp_extract(url, rf"[?&]{key}=([^&]*)", 1)
    begin = F.try_to_timestamp(part("X-Amz-Date"), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    seconds = part("X-Amz-Expires").try_cast("bigint")
    return F.coalesce(F.unix_seconds(begin) + seconds < F.unix_seconds(now), F.lit(False))


def image_links(html: Column) -> Column:
    """Sources of the images of an HTML text."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<img[^>]+src=["'](.*?)["']"""), F.lit(1))


def html_lines(html: Column) -> Column:
    """The text of an HTML fragment, a line for each block element; scripts, styles and tags go."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?i)</?(p|h[1-6]|li|ul|ol|div|tr|table|br|section|article|blockquote|pre)\b[^>]*>", "\n")
    body = F.regexp_replace(F.regexp_replace(body, "<[^>]*>", ""), "&nbsp;", " ")
    for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(mark), F.lit(sign))
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def data_uri_bytes(src: Column) -> Column:
    """The bytes of a base64 data URI; null for other links."""
    return F.when(src.rlike(r"(?i)^data:[^,]*;base64,"), F.try_to_binary(F.substring_index(src, ",", -1), F.lit("base64")))
