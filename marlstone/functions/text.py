"""Scalar functions as Spark columns. All of them run on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and media types by which a format is known.
MARKDOWN_EXTENSIONS = ("md", "markdown", "mdown", "mkd")
HTML_EXTENSIONS = ("html", "htm", "xhtml")
MARKDOWN_TYPES = ("text/markdown", "text/x-markdown")
HTML_TYPES = ("text/html", "application/xhtml+xml")

UNTITLED = "untitled"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def looks_like_html(body: Column) -> Column:
    """Whether the first 64 characters after white space begin a page."""
    head = F.lower(F.substring(F.regexp_replace(body, r"^\s+", ""), 1, 64))
    return head.startswith("<!doctype") | head.startswith("<html") | head.startswith("<?xml")


def looks_like_markdown(body: Column) -> Column:
    """One strong sign (heading, fence) or two weak ones within 200 lines. Weak signs count once a line."""
    lines = F.slice(F.split(body, "\n"), 1, 200)
    strong = F.exists(lines, lambda x: x.rlike(r"^\s*(?:#{1,6} |```|~~~)"))
    front = F.when(F.trim(F.get(lines, F.lit(0))) == "---", 1).otherwise(0)
    ruled = F.size(F.filter(lines, lambda x: x.contains("|") & x.contains("-") & x.rlike(r"^[\s|:-]+$")))
    linked = F.size(F.filter(lines, lambda x: x.contains("](") & x.contains("[")))
    listed = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(?:[-*+] |\d+\. )")))
    return strong | ((front + ruled + linked + F.when(listed >= 2, 1).otherwise(0)) >= 2)


def detect_format(content_type: Column, extension: Column, body: Column) -> Column:
    """struct(kind, basis): media type, then extension, then the body; pages if nothing tells."""
    media = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    ext = F.lower(F.coalesce(extension, F.lit("")))
    made = F.when(media.isin(*MARKDOWN_TYPES), F.struct(F.lit("Markdown").alias("kind"), F.lit("MediaType").alias("basis")))
    for test, kind, basis in (
        (media.isin(*HTML_TYPES), "Html", "MediaType"),
        (ext.isin(*MARKDOWN_EXTENSIONS), "Markdown", "Extension"),
        (ext.isin(*HTML_EXTENSIONS), "Html", "Extension"),
        (looks_like_html(body), "Html", "BodySignal"),
        (looks_like_markdown(body), "Markdown", "BodySignal"),
    ):
        made = made.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(basis).alias("basis")))
    return made.otherwise(F.struct(F.lit("Html").alias("kind"), F.lit("Fallback").alias("basis")))


def url_extension(url: Column) -> Column:
    """The extension of the last part of the path, null without one."""
    ext = F.regexp_extract(url, r"^[a-z]+://[^/?#]+/(?:[^?#]*/)?[^/?#]*\.([A-Za-z0-9]+)(?:[?#].*)?$", 1)
    return F.when(ext != "", F.lower(ext))


def truncated(body: Column, limit: int = 512) -> Column:
    return F.when(F.char_length(body) > limit, F.concat(F.left(body, F.lit(limit)), F.lit("… (truncated)"))).otherwise(body)


def processing_fingerprint(format_: Column, embedder: str, dimension: int, chunker: str, budget: int = 512, callouts: bool = False) -> Column:
    """The hash of everything that shapes a document's chunks and vectors besides its content."""
    policy = F.when(format_ == "Markdown", "md1").when(format_ == "Html", "html1").otherwise("pdf0-unimplemented")
    parts = [
        F.lit("fp2"),
        F.concat(F.lit("format="), format_),
        F.concat(F.lit("parser_policy="), policy),
        F.lit(f"normalize_bare_callouts={str(callouts).lower()}"),
        F.lit(f"chunker={chunker}"),
        F.lit(f"token_budget={budget}"),
        F.lit(f"embedder={embedder}"),
        F.lit(f"embed_dimension={dimension}"),
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)


def looks_like_math(text: Column) -> Column:
    return text.rlike(r"[\\=^{}]")


def snippet(content: Column, limit: int = 160) -> Column:
    flat = F.regexp_replace(F.regexp_replace(content, r"\s+", " "), "^ | $", "")
    return F.when(F.char_length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(flat)


def shown_title(title: Column) -> Column:
    return F.when(title.isNull() | (F.regexp_replace(title, r"\s+", "") == ""), F.lit(UNTITLED)).otherwise(title)


def source_header(title: Column, path: Column) -> Column:
    """`[Source: title > path]`; a path that begins with the title doesn't repeat it."""
    path = F.coalesce(path, F.array().cast("array<string>"))
    rest = F.when(F.get(path, F.lit(0)) == title, F.slice(path, F.lit(2), F.size(path))).otherwise(path)
    return F.concat(F.lit("[Source: "), F.array_join(F.concat(F.array(title), rest), " > "), F.lit("]"))


def is_url(text: Column) -> Column:
    return text.startswith("http://") | text.startswith("https://")


def file_kind(path: Column) -> Column:
    """struct(kind, error) by extension; .pdf and unknown extensions have the error a reader would raise."""
    from marlstone import errors

    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    kind = F.when(ext == "md", "Markdown").when(ext.isin("html", "htm"), "Html")
    unknown = F.concat(F.lit("invalid input: unsupported file extension '"), ext, F.lit(f"'. supported: {errors.SUPPORTED_EXTENSIONS}"))
    error = F.when(ext == "pdf", f"not implemented: {errors.PDF_NOT_IMPLEMENTED}").when(kind.isNull(), unknown)
    return F.struct(kind.alias("kind"), error.alias("error"))
