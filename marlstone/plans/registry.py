"""All queries of the core, each beside the SQL it is checked against. Where SQL can't express one, tests do."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.emitters import html as html_emitter
from marlstone.emitters import markdown as markdown_emitter
from marlstone.functions import text as fn
from marlstone.functions.tokens import PATTERN, count_tokens, token_count
from marlstone.errors import PDF_NOT_IMPLEMENTED, SUPPORTED_EXTENSIONS, EmbeddingSpaceMismatch, MarlstoneError
from marlstone.ir import check, tree
from marlstone.library import Library
from marlstone.operators import chunking, documents, retrieval
from marlstone.operators.embedding import EmbeddingSpace, HashEmbedder, embed_table
from marlstone.parsers import dom, html, markdown, repairs
from marlstone.parsers.offsets import decode_newlines
from marlstone.sources import files, net
from marlstone.storage.store import Store, projection_faults
from marlstone.tables import shared_folder, table

QUERIES: dict = {}
ORACLE: dict = {}
SPACE = "hash-space-v1|dimension=256"
SPLIT = 512
QUESTION = "how does the cache keep the index when a document is parsed again"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def through(kind: str, make: Callable[[str], object]) -> Callable[[Column], Column]:
    """A function of this package on texts, as a column; null stays null."""

    def column(texts: Column) -> Column:
        @F.pandas_udf(kind)
        def run(batch: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else make(t) for t in batch], dtype=object)

        return run(texts)

    return column


# White space of Python, for SQL.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


# Functions of a text


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", fn.content_hash(F.col("text")).alias("content_hash"))


@query(
    f"""SELECT doc_id, sha256('fp2|format=' || source_format || '|parser_policy=' || CASE source_format WHEN 'Markdown' THEN 'md1' ELSE 'html1' END
    || '|normalize_bare_callouts=false|chunker={chunking.VERSION}|token_budget=512|embedder={SPACE}|embed_dimension=256') AS fingerprint FROM documents"""
)
def processing_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    made = fn.processing_fingerprint(F.col("source_format"), SPACE, 256, chunking.VERSION)
    return table(spark, folder, "documents").select("doc_id", made.alias("fingerprint"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{PATTERN}')) AS tokens FROM documents")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))


_SENTENCES = rf"""SELECT doc_id, regexp_replace(s, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS sentence FROM
    (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.?!]){_SPACE}', '\1' || chr(1), 'g'), '\n', chr(1), 'g'), chr(1))) AS s FROM documents)
    WHERE regexp_replace(s, '^{_SPACE}+|{_SPACE}+$', '', 'g') <> ''"""


@query(_SENTENCES)
def sentences(spark: SparkSession, folder: str) -> DataFrame:
    made = table(spark, folder, "documents").select("doc_id", F.explode(through("array<string>", chunking.split_sentences)(F.col("text"))).alias("sentence"))
    return made.where("sentence <> ''")  # a blank text is one sentence of nothing to the chunker


@query(f"SELECT doc_id, count(*) AS sentences FROM ({_SENTENCES}) GROUP BY doc_id")
def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    count = through("bigint", lambda t: sum(map(bool, chunking.split_sentences(t))))
    return table(spark, folder, "documents").select("doc_id", count(F.col("text")).alias("sentences")).where("sentences > 0")


@query(
    r"""SELECT chunk_id, CASE WHEN length(f) > 160 THEN left(f, 160) || '…' ELSE f END AS snippet FROM
    (SELECT chunk_id, regexp_replace(regexp_replace(content, '\s+', ' ', 'g'), '^ | $', '', 'g') AS f FROM chunks)"""
)
def snippets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("chunk_id", fn.snippet(F.col("content")).alias("snippet"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def html_escape(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", through("string", html_emitter.escape)(F.col("text")).alias("escaped"))


@query(rf"SELECT doc_id, strlen(regexp_replace(text, '{_SPACE}+', '', 'g')) AS bytes FROM documents")
def text_density(spark: SparkSession, folder: str) -> DataFrame:
    """Content length of texts as pages: escaped, parsed, and with chrome around that doesn't count."""

    def length(text: str) -> int:
        page = f"<nav>not counted</nav><div>{html_emitter.escape(text)}</div><footer>nor this</footer>"
        return html.content_length(dom.parse(page).kids[1])

    return table(spark, folder, "documents").select("doc_id", through("bigint", length)(F.col("text")).alias("bytes"))


@query(rf"SELECT chunk_id, CASE WHEN regexp_replace(content, '{_SPACE}+', '', 'g') = '' THEN '' ELSE regexp_replace(content, '{_SPACE}+', ' ', 'g') END AS content FROM chunks")
def collapsed_whitespace(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("chunk_id", through("string", html.collapse)(F.col("content")).alias("content"))


@query(r"SELECT chunk_id, regexp_matches(content, '[\\=^{}]') AS maths FROM chunks")
def math_signs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("chunk_id", fn.looks_like_math(F.col("content")).alias("maths"))


@query("SELECT fetch_id, CASE WHEN length(body) > 512 THEN left(body, 512) || '… (truncated)' ELSE body END AS quoted FROM fetched")
def truncated_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetched").select("fetch_id", fn.truncated(F.col("body")).alias("quoted"))


@query(
    r"""SELECT doc_id, CASE WHEN NOT contains(rtrim(text, chr(10) || chr(13)), chr(10)) AND contains(rtrim(text, chr(10) || chr(13)), '\n')
    THEN regexp_replace(text, '(?:\\r)?\\n', chr(10), 'g') ELSE text END AS decoded FROM documents"""
)
def escaped_newlines(spark: SparkSession, folder: str) -> DataFrame:
    decode = through("string", lambda t: decode_newlines(t)[0] if repairs.is_escaped_stream(t) else t)
    return table(spark, folder, "documents").select("doc_id", decode(F.col("text")).alias("decoded"))


@query(
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?ms)\A---\r*\n.*?^---\r*(?:\n|\z)')
    THEN replace(regexp_extract(text, '(?ms)\A---\r*\n(.*?)^---\r*(?:\n|\z)', 1), chr(13) || chr(10), chr(10)) END AS frontmatter FROM documents"""
)
def frontmatter_split(spark: SparkSession, folder: str) -> DataFrame:
    def fenced(text: str) -> str | None:
        header, _, inferred = repairs.frontmatter(text)
        return None if inferred else header

    return table(spark, folder, "documents").select("doc_id", through("string", fenced)(F.col("text")).alias("frontmatter"))


_PAIRS = r"regexp_extract(replace(text, chr(13), ''), '\A((?:[ \t]*[A-Za-z0-9_-]+:[^\n]*(?:\n|\z)){2,})', 1)"


@query(f"SELECT doc_id, CASE WHEN starts_with(text, '---') OR {_PAIRS} = '' THEN NULL ELSE {_PAIRS} END AS header FROM documents")
def inferred_frontmatter(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of two or more leading `key: value` lines without a fence."""

    def unfenced(text: str) -> str | None:
        header, _, inferred = repairs.frontmatter(text.replace("\r", ""))
        return header if inferred else None

    return table(spark, folder, "documents").select("doc_id", through("string", unfenced)(F.col("text")).alias("header"))


@query(
    rf"""SELECT doc_id, CASE WHEN w IS NULL OR len(w) < 2 OR len(list_filter(w, lambda v: v > 1)) < 2 THEN NULL WHEN list_min(w) = list_max(w) THEN 'table' ELSE 'generic' END AS made FROM
    (SELECT doc_id, list_transform(string_split(replace(replace(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
    lambda x: len(string_split(x, chr(9)))) AS w FROM (SELECT doc_id, replace(text, ' ', chr(9)) AS text FROM documents))"""
)
def tab_promotion(spark: SparkSession, folder: str) -> DataFrame:
    """What a paragraph of lines with tabs becomes, over texts whose blanks are made tabs."""
    made = through("string", lambda t: (repairs.tabbed(t.replace(" ", "\t")) or (None,))[0])
    return table(spark, folder, "documents").select("doc_id", made(F.col("text")).alias("made"))


# Sources

_STRONG = r"len(list_filter(l, lambda x: regexp_matches(x, '^\s*(?:#{1,6} |```|~~~)'))) > 0"
_WEAK = r"""(CASE WHEN trim(l[1]) = '---' THEN 1 ELSE 0 END
    + len(list_filter(l, lambda x: contains(x, '|') AND contains(x, '-') AND regexp_matches(x, '^[\s|:-]+$')))
    + len(list_filter(l, lambda x: contains(x, '](') AND contains(x, '[')))
    + CASE WHEN len(list_filter(l, lambda x: regexp_matches(x, '^\s*(?:[-*+] |\d+\. )'))) >= 2 THEN 1 ELSE 0 END) >= 2"""


@query(
    rf"""SELECT fetch_id, split_part(k, '/', 1) AS kind, split_part(k, '/', 2) AS basis FROM (SELECT fetch_id, CASE
    WHEN m IN ('text/markdown', 'text/x-markdown') THEN 'Markdown/MediaType' WHEN m IN ('text/html', 'application/xhtml+xml') THEN 'Html/MediaType'
    WHEN e IN ('md', 'markdown', 'mdown', 'mkd') THEN 'Markdown/Extension' WHEN e IN ('html', 'htm', 'xhtml') THEN 'Html/Extension'
    WHEN starts_with(h, '<!doctype') OR starts_with(h, '<html') OR starts_with(h, '<?xml') THEN 'Html/BodySignal'
    WHEN {_STRONG} OR {_WEAK} THEN 'Markdown/BodySignal' ELSE 'Html/Fallback' END AS k FROM (SELECT fetch_id,
    lower(trim(split_part(coalesce(content_type, ''), ';', 1))) AS m,
    lower(regexp_extract(final_url, '^[a-z]+://[^/?#]+/(?:[^?#]*/)?[^/?#]*\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS e,
    lower(substr(regexp_replace(body, '^\s+', ''), 1, 64)) AS h, string_split(body, chr(10))[1:200] AS l FROM fetched))"""
)
def detect_format(spark: SparkSession, folder: str) -> DataFrame:
    made = fn.detect_format(F.col("content_type"), fn.url_extension(F.col("final_url")), F.col("body"))
    return table(spark, folder, "fetched").select("fetch_id", made.alias("f")).select("fetch_id", "f.kind", "f.basis")


@query(
    f"""SELECT final_url AS raw_source, CASE WHEN status NOT BETWEEN 200 AND 299 THEN 'network error: fetching ' || chr(39) || final_url || chr(39) || ' returned HTTP ' || status
    WHEN strlen(body) > {net.MAX_BODY} THEN 'network error: response from ' || chr(39) || final_url || chr(39) || ' exceeded the {net.MAX_BODY}-byte limit' END AS error,
    CASE WHEN status BETWEEN 200 AND 299 AND strlen(body) <= {net.MAX_BODY} THEN body END AS content FROM fetched"""
)
def fetch_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    made = files.fetched(table(spark, folder, "fetched"), "final_url", "content_type", "body", "status", net.MAX_BODY)
    return made.select("raw_source", "error", "content")


_EXT = r"lower(regexp_extract(raw_source, '\.([^./\\]*)$', 1))"


@query(
    rf"""SELECT doc_id, starts_with(raw_source, 'http://') OR starts_with(raw_source, 'https://') AS is_url,
    CASE WHEN {_EXT} = 'md' THEN 'Markdown' WHEN {_EXT} IN ('html', 'htm') THEN 'Html' END AS kind,
    CASE WHEN {_EXT} = 'pdf' THEN 'not implemented: {PDF_NOT_IMPLEMENTED}' WHEN {_EXT} NOT IN ('md', 'html', 'htm')
    THEN 'invalid input: unsupported file extension ' || chr(39) || {_EXT} || chr(39) || '. supported: {SUPPORTED_EXTENSIONS}' END AS error FROM
    (SELECT doc_id, raw_source FROM documents UNION ALL SELECT -doc_id, replace(raw_source, '.md', '.pdf') FROM documents)"""
)
def source_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    """Every source, and again under a negative id as if its Markdown files were PDF."""
    rows = table(spark, folder, "documents").select("doc_id", "raw_source")
    rows = rows.unionByName(rows.select((-F.col("doc_id")).alias("doc_id"), F.replace("raw_source", F.lit(".md"), F.lit(".pdf")).alias("raw_source")))
    kind = fn.file_kind(F.col("raw_source"))
    return rows.select("doc_id", fn.is_url(F.col("raw_source")).alias("is_url"), kind["kind"].alias("kind"), kind["error"].alias("error"))


# Deduplication


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY text")
def dedupe_exact(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", fn.content_hash(F.col("text")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    """WITH s AS (SELECT text, raw_source, source_format, doc_id FROM documents WHERE text IS NOT NULL),
    k AS (SELECT text, max_by(source_format, -doc_id) AS stored_format FROM s WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY text),
    l AS (SELECT text, max(struct_pack(raw_source := raw_source, source_format := source_format)) AS l FROM s GROUP BY text)
    SELECT l.l.raw_source AS raw_source, sha256(l.text) AS content_hash, CASE WHEN k.text IS NULL THEN 'insert' WHEN k.stored_format = l.l.source_format THEN 'skip' ELSE 'reprocess' END AS decision
    FROM l LEFT JOIN k USING (text) UNION ALL SELECT raw_source, NULL, 'error' FROM documents WHERE text IS NULL"""
)
def dedupe_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The library's decision on every document, where the English ones are stored already."""
    library = Library(spark, Store(spark, shared_folder(spark, f"store-{uuid.uuid4().hex}")), HashEmbedder(16))
    rows = table(spark, folder, "documents")
    known = rows.where("lang = 'en' AND text IS NOT NULL").groupBy(fn.content_hash(F.col("text")).alias("content_hash")).agg(F.min(F.struct("doc_id", "document_id", "source_format")).alias("d"))
    empty = {n: library.store.table(n) for n in ("documents", "chunks", "chunk_embeddings")}
    stored = known.select("content_hash", "d.document_id", "d.source_format").withColumn("processing_fingerprint", library.fingerprint(F.col("source_format")))
    library.store.replace(empty["documents"].unionByName(stored, allowMissingColumns=True), empty["chunks"], empty["chunk_embeddings"], library.space)
    sources = rows.select("raw_source", "source_format", F.col("text").alias("content"), F.lit(None).cast("string").alias("error"))
    return library.decide(sources).select("raw_source", "content_hash", "decision")


# Stored trees

_BODY = "SELECT doc_id, unnest(json_extract(doc_json, '$.body[*]')) AS b FROM documents WHERE json_valid(doc_json)"


@query(
    f"""SELECT doc_id, kind, count(*) AS blocks FROM (SELECT doc_id, CASE WHEN json_type(b, '$.block') = 'VARCHAR' THEN b->>'$.block'
    ELSE json_keys(b, '$.block')[1] END AS kind FROM ({_BODY})) GROUP BY ALL"""
)
def blocks_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Only the names of the kinds leave the parser."""

    def kinds(source: str) -> list[str]:
        try:
            return [tree.BLOCK_NAMES[b["kind"]] for b in tree.loads(source)["body"]]
        except MarlstoneError:
            return []

    rows = table(spark, folder, "documents").select("doc_id", F.explode(through("array<string>", kinds)(F.col("doc_json"))).alias("kind"))
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"))


@query(
    """SELECT doc_id, CAST(i AS INTEGER) AS ord, array_to_string(CAST(json_extract_string(b, '$.prov.section_path[*]') AS VARCHAR[]), ' > ') AS path FROM
    (SELECT doc_id, unnest(l) AS b, unnest(range(len(l))) AS i FROM (SELECT doc_id, json_extract(doc_json, '$.body[*]') AS l FROM documents WHERE json_valid(doc_json)))"""
)
def section_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of stored blocks, made again from the headings by the tracker."""

    def paths(source: str) -> list[str]:
        try:
            body = tree.loads(source)["body"]
        except MarlstoneError:
            return []
        tracker, out = tree.SectionPath(), []
        for b in body:
            path = tracker.enter(b["level"], tree.plain(b["content"])) if b["kind"] == "heading" else tracker.current()
            out.append(" > ".join(path))
        return out

    made = table(spark, folder, "documents").select("doc_id", F.posexplode(through("array<string>", paths)(F.col("doc_json"))).alias("ord", "path"))
    return made


@query()
def emit_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", documents.rendered(F.col("doc_json"), "text").alias("text"))


@query("SELECT doc_id, text FROM documents WHERE source_format = 'Html' AND json_valid(doc_json) AND text IS NOT NULL")
def emit_text_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The text of a page is its stored tree rendered."""
    rows = table(spark, folder, "documents").where("source_format = 'Html' AND text IS NOT NULL")
    return rows.select("doc_id", documents.rendered(F.col("doc_json"), "text").alias("text")).where("text IS NOT NULL")


@query()
def emit_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", documents.rendered(F.col("doc_json"), "markdown").alias("markdown"))


@query()
def emit_html(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", documents.rendered(F.col("doc_json"), "html").alias("html"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(doc_json, '"Heading":[{]"level":1,') THEN 'heading level 9 out of range' END AS fault, CAST(NULL AS VARCHAR) AS before, json_valid(doc_json) AS stored
    FROM documents WHERE doc_json IS NOT NULL AND json_valid(doc_json)
    UNION ALL SELECT doc_id, NULL, NULL, false FROM documents WHERE doc_json IS NOT NULL AND NOT json_valid(doc_json)"""
)
def validate_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of stored trees, and of the same trees whose first headings got a level there isn't."""
    rows = table(spark, folder, "documents").where("doc_json IS NOT NULL")
    bad = F.regexp_replace("doc_json", r'"Heading":\{"level":1,', '"Heading":{"level":9,')
    parses = through("boolean", _parses)
    return rows.select("doc_id", documents.faults(bad).alias("fault"), documents.faults(F.col("doc_json")).alias("before"), parses(F.col("doc_json")).alias("stored"))


def _parses(source: str) -> bool:
    try:
        tree.loads(source)
        return True
    except MarlstoneError:
        return False


# Parsers


def _of_markdown(make):
    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd

        return pd.Series([None if t is None else make(markdown.parse(t)) for t in texts], dtype=object)

    return run


@query("SELECT doc_id, CAST(NULL AS VARCHAR) AS difference FROM documents WHERE source_format = 'Markdown'")
def markdown_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed, written and parsed again: where the trees differ."""

    def differs(d: dict) -> str | None:
        again = markdown.parse(markdown_emitter.emit(d))
        return check.document_difference(d | {"body": check.normalized(d["body"])}, again | {"body": check.normalized(again["body"])})

    return table(spark, folder, "documents").where("source_format = 'Markdown'").select("doc_id", _of_markdown(differs)("text").alias("difference"))


@query()
def cross_format(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown written as HTML and parsed again: where the bodies differ."""

    def differs(d: dict) -> str | None:
        again = html.parse(f"<body>{html_emitter.emit(d)}</body>", False)
        return check.difference(check.normalized(d["body"]), check.normalized(again["body"]))

    return table(spark, folder, "documents").where("source_format = 'Markdown'").select("doc_id", _of_markdown(differs)("text").alias("difference"))


def _parsed_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetched").select("fetch_id", documents.parsed(F.col("body"), F.col("kind")).alias("document"))


@query()
def parse_fetched(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed_pages(spark, folder).select("fetch_id", "document.title", "document.error", F.size("document.nodes").alias("nodes"), F.size("document.inlines").alias("inlines"))


@query()
def parse_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("source_format = 'Markdown'")
    made = rows.select("doc_id", documents.parsed(F.col("text"), F.col("source_format")).alias("document"))
    return made.select("doc_id", "document.title", "document.frontmatter", "document.error", F.size("document.nodes").alias("nodes"))


def _inner(pattern: str) -> str:
    """The text of the first element that a pattern finds, without tags and with its references decoded."""
    text = f"trim(regexp_replace(regexp_replace(regexp_extract(body, '{pattern}', 1), '<[^>]*>', '', 'g'), '{_SPACE}+', ' ', 'g'))"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{a}', '{b}')"
    return text


@query(f"""SELECT fetch_id, coalesce(nullif({_inner("(?is)<title>(.*?)</title>")}, ''), CASE WHEN NOT regexp_matches(body, '(?i)<td[^>]*>\\s*<h1') THEN nullif({_inner("(?is)<h1[^>]*>(.*?)(?:</h1>|<h|<p)")}, '') END) AS title FROM fetched WHERE kind = 'Html'""")
def html_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of pages, from the title or else the first heading. One in the cell of a table is none."""
    return table(spark, folder, "fetched").where("kind = 'Html'").select("fetch_id", documents.parsed(F.col("body"), F.col("kind"))["title"].alias("title"))


@query(
    r"""SELECT doc_id, coalesce(title, nullif(array_to_string(CAST(json_extract_string(list_filter(json_extract(CASE WHEN json_valid(doc_json) THEN doc_json END, '$.body[*]'),
    lambda b: json_extract_string(b, '$.block.Heading.level') = '1')[1], '$.block.Heading.content[*].Text') AS VARCHAR[]), ''), ''), nullif(regexp_extract(text, '(?m)^# +([^\n]*?)\s*$', 1), '')) AS title
    FROM documents WHERE source_format = 'Markdown' AND text IS NOT NULL"""
)
def markdown_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of parsed sources, as the stored documents have them; where a title is lost, as their trees."""
    rows = table(spark, folder, "documents").where("source_format = 'Markdown' AND text IS NOT NULL")
    return rows.select("doc_id", documents.parsed(F.col("text"), F.col("source_format"))["title"].alias("title"))


@query()
def diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed_pages(spark, folder).select("fetch_id", F.inline("document.diagnostics"))


@query()
def structural_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Where the tree of a Markdown source differs from the stored one."""

    @F.pandas_udf("string")
    def compare(texts, trees):
        import pandas as pd

        from marlstone.errors import MarlstoneError
        from marlstone.ir import tree

        out = []
        for t, j in zip(texts, trees):
            try:
                a, b = (None, None) if t is None or j is None else (markdown.parse(t), tree.loads(j))
                out.append(None if a is None else check.difference(check.normalized(a["body"]), check.normalized(b["body"])))
            except MarlstoneError as e:
                out.append(str(e))
        return pd.Series(out, dtype=object)

    return table(spark, folder, "documents").where("source_format = 'Markdown'").select("doc_id", compare("text", "doc_json").alias("difference"))


# Chunks


@query()
def chunk_trees(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.inline(documents.chunks_of(F.col("doc_json"))))


@query()
def chunk_sources(spark: SparkSession, folder: str) -> DataFrame:
    return documents.chunk_sources(table(spark, folder, "documents").where("source_format = 'Markdown'"), "doc_id", "text", F.col("source_format"))


@query(
    f"""SELECT chunk_id, CAST(w AS INTEGER) AS window_index, least({SPLIT}, n - w * {SPLIT}) AS tokens FROM (SELECT chunk_id, n, unnest(range(0, greatest(1, (n + {SPLIT - 1}) // {SPLIT}))) AS w
    FROM (SELECT DISTINCT chunk_id, len(regexp_extract_all(content, '{PATTERN}')) AS n FROM chunks WHERE content IS NOT NULL))"""
)
def token_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The chunker's windows of 512 tokens of every chunk, counted again."""
    counts = through("array<int>", lambda t: [count_tokens(w) for w in chunking.windows(t, SPLIT)])
    rows = table(spark, folder, "chunks").where("content IS NOT NULL").select("chunk_id", counts(F.col("content")).alias("n")).distinct()
    return rows.select("chunk_id", F.posexplode("n").alias("window_index", "tokens")).withColumn("tokens", F.col("tokens").cast("bigint"))


@query(
    f"""SELECT chunk_id, token_count AS recorded, len(regexp_extract_all(content, '{PATTERN}')) AS counted FROM chunks
    WHERE token_count IS DISTINCT FROM len(regexp_extract_all(content, '{PATTERN}'))"""
)
def wrong_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").select("chunk_id", F.col("token_count").alias("recorded"), token_count(F.col("content")).alias("counted"))
    return rows.where(~F.col("recorded").eqNullSafe(F.col("counted")))


_COUNTED = """SELECT document_id, count(*) AS n, count(DISTINCT sequence_index) AS places, min(sequence_index) AS first, max(sequence_index) AS last
    FROM (SELECT DISTINCT chunk_id, document_id, sequence_index FROM chunks) GROUP BY document_id"""
_WHOLE = f"SELECT document_id FROM ({_COUNTED}) WHERE document_id IN (SELECT document_id FROM documents) AND places = n AND first = 0 AND last = n - 1"


@query(
    f"""SELECT document_id, CASE WHEN document_id NOT IN (SELECT document_id FROM documents) THEN 'chunk of another document' WHEN coalesce(n, 0) <> coalesce(v, 0) THEN 'chunks and vectors differ in number'
    WHEN places <> n THEN 'sequence index twice' WHEN first <> 0 OR last <> n - 1 THEN 'sequence is not contiguous from 0' END AS fault FROM ({_COUNTED}) FULL JOIN
    (SELECT document_id, count(*) AS v FROM (SELECT DISTINCT c.document_id, e.chunk_id FROM chunk_embeddings e JOIN chunks c USING (chunk_id)) GROUP BY document_id) USING (document_id)
    WHERE fault IS NOT NULL"""
)
def validate_projection(spark: SparkSession, folder: str) -> DataFrame:
    """The store's check of documents, chunks and vectors against each other; of the vectors only whose they are."""
    chunks = table(spark, folder, "chunks").select("chunk_id", "document_id", "sequence_index").distinct()
    vectors = table(spark, folder, "chunk_embeddings").select("chunk_id").distinct().join(chunks, "chunk_id").select("chunk_id", "document_id", F.array(F.lit(1.0)).alias("vector"))
    return projection_faults(table(spark, folder, "documents").select("document_id").distinct(), chunks, vectors, 1)


# Store

_STORES: dict[tuple[str, str], Store] = {}


def _store(spark: SparkSession, folder: str) -> Store:
    """A store with the documents of the tables and, of those whose chunks are whole, the chunks and a hashed vector of each. It is bound to
    the recorded space, and made once a session for each folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORES:
        bound = table(spark, folder, "library_metadata").first()
        space = EmbeddingSpace(bound["embedding_space_fingerprint"], bound["embedding_dimension"])
        made = Store(spark, shared_folder(spark, f"store-{uuid.uuid4().hex}"))
        docs = table(spark, folder, "documents").select(
            "document_id", "source", "source_format", "title", F.lit(None).cast("string").alias("frontmatter"), F.col("ingested_at").cast("timestamp").alias("ingested_at"), "content_hash",
            "processing_fingerprint", F.octet_length("text").cast("bigint").alias("source_len"), "doc_json",
        )
        chunks = table(spark, folder, "chunks").select("chunk_id", "document_id", "section_path", "content", "block_type", "sequence_index", "token_count").distinct()
        every = chunks.select("chunk_id", "document_id", F.array(F.lit(1.0)).alias("vector"))
        faults = projection_faults(docs.select("document_id"), chunks, every, 1).select("document_id")
        chunks = chunks.join(faults, "document_id", "left_anti")
        texts = chunks.select("chunk_id", "document_id", F.coalesce("content", F.lit("")).alias("content"))
        vectors = embed_table(texts, "content", HashEmbedder(space.dimension)).select("chunk_id", "document_id", F.lit(space.dimension).alias("dimension"), "vector")
        made.replace(docs, chunks, vectors, space)
        _STORES[key] = made
    return _STORES[key]


def _copy(spark: SparkSession, folder: str) -> Store:
    """Another store with the same rows, to change."""
    store = _store(spark, folder)
    made = Store(spark, shared_folder(spark, f"store-{uuid.uuid4().hex}"))
    made.replace(*(store.table(n) for n in ("documents", "chunks", "chunk_embeddings")), store.space())
    return made


@query(f"SELECT DISTINCT document_id, sequence_index, chunk_id, block_type FROM chunks WHERE document_id IN ({_WHOLE})")
def chunks_by_document(spark: SparkSession, folder: str) -> DataFrame:
    return _store(spark, folder).chunks().select("document_id", "sequence_index", "chunk_id", "block_type")


@query("SELECT document_id, source, source_format, title, content_hash FROM documents")
def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _store(spark, folder).documents().select("document_id", "source", "source_format", "title", "content_hash")


@query(
    f"""SELECT d.document_id, d.title, count(DISTINCT c.chunk_id) AS chunk_count FROM documents d LEFT JOIN (SELECT * FROM chunks WHERE document_id IN ({_WHOLE})) c USING (document_id) GROUP BY ALL"""
)
def info_chunk_count(spark: SparkSession, folder: str) -> DataFrame:
    return _store(spark, folder).infos().select("document_id", "title", "chunk_count")


_ERRORS = "SELECT DISTINCT document_id FROM fetched WHERE status NOT BETWEEN 200 AND 299 AND document_id IS NOT NULL"


@query(f"SELECT DISTINCT chunk_id, document_id, sequence_index FROM chunks WHERE document_id IN ({_WHOLE}) AND document_id NOT IN ({_ERRORS})")
def remove_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks left in the store when the documents of error pages are removed from it."""
    gone = table(spark, folder, "fetched").where("status NOT BETWEEN 200 AND 299 AND document_id IS NOT NULL").select("document_id").distinct()
    store = _copy(spark, folder)
    store.remove_all(gone)
    return store.table("chunks").select("chunk_id", "document_id", "sequence_index")


@query(
    f"""SELECT DISTINCT chunk_id, document_id, sequence_index FROM chunks WHERE document_id IN ({_WHOLE}) AND document_id NOT IN ({_ERRORS})
    UNION ALL SELECT 'new-' || document_id, document_id, 0 FROM ({_ERRORS})"""
)
def replace_projection(spark: SparkSession, folder: str) -> DataFrame:
    """The same documents replaced in the store by one new chunk each."""
    gone = table(spark, folder, "fetched").where("status NOT BETWEEN 200 AND 299 AND document_id IS NOT NULL").select("document_id").distinct()
    store = _copy(spark, folder)
    space = store.space()
    empty = {n: store.table(n).limit(0) for n in ("documents", "chunks", "chunk_embeddings")}
    new = gone.select(F.concat(F.lit("new-"), "document_id").alias("chunk_id"), "document_id", F.lit(0).cast("bigint").alias("sequence_index"))
    vectors = new.select("chunk_id", "document_id", F.lit(space.dimension).alias("dimension"), F.array_repeat(F.lit(0.5).cast("float"), space.dimension).alias("vector"))
    store.replace(empty["documents"].unionByName(gone, allowMissingColumns=True), empty["chunks"].unionByName(new, allowMissingColumns=True), empty["chunk_embeddings"].unionByName(vectors), space)
    return store.table("chunks").select("chunk_id", "document_id", "sequence_index")


@query(
    f"""SELECT count(DISTINCT chunk_id) AS vectors, (SELECT embedding_dimension FROM library_metadata) AS dimension, true AS whole
    FROM chunks WHERE document_id IN ({_WHOLE})"""
)
def index_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """The checks of the index over the whole store."""
    store = _store(spark, folder)
    store.check_index()
    m = store.manifest()
    return spark.createDataFrame([(m.entry_count, m.embedding_dimension, store.open_index())], "vectors bigint, dimension int, whole boolean")


@query(
    """SELECT dimension, count(*) AS vectors, dimension = (SELECT embedding_dimension FROM library_metadata) AS bound FROM chunk_embeddings GROUP BY dimension"""
)
def space_binding(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the store takes vectors of each dimension there is."""
    store, rows = _store(spark, folder), []
    for r in table(spark, folder, "chunk_embeddings").groupBy("dimension").agg(F.count("*").alias("vectors")).collect():  # one row a dimension
        try:
            store.check_space(EmbeddingSpace(store.space().fingerprint, r["dimension"]))
            rows.append((r["dimension"], r["vectors"], True))
        except EmbeddingSpaceMismatch:
            rows.append((r["dimension"], r["vectors"], False))
    return spark.createDataFrame(rows, "dimension int, vectors bigint, bound boolean")


@query("SELECT e.chunk_id FROM (SELECT DISTINCT chunk_id FROM chunk_embeddings) e WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = e.chunk_id)")
def orphan_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunk_embeddings").select("chunk_id").distinct().join(table(spark, folder, "chunks"), "chunk_id", "left_anti")


# Vectors and answers


_WORDS = r"SELECT doc_id, unnest(regexp_split_to_array(replace(lower(text), 'ς', 'σ'), '[ \t\n\x0B\f\r]+')) AS w FROM documents"
_BUCKETS = f"SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 15))::UBIGINT % 256 AS INTEGER) AS bucket, count(*) AS n FROM ({_WORDS}) WHERE w <> '' GROUP BY ALL"


@query(
    f"""SELECT c.doc_id, c.bucket, round(c.n / sqrt(t.s), 6) AS weight FROM ({_BUCKETS}) c
    JOIN (SELECT doc_id, sum(n * n) AS s FROM ({_BUCKETS}) GROUP BY doc_id) t USING (doc_id)"""
)
def hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    made = retrieval.sparse_embedding(table(spark, folder, "documents"), "doc_id", "text")
    return made.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS valid FROM embeddings")
def validate_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", retrieval.valid_vector(F.col("embedding"), 64).alias("valid"))


def _distance(a: str, b: str) -> str:
    x, y = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return f"1 - list_dot_product({x}, {y}) / sqrt(list_dot_product({x}, {x}) * list_dot_product({y}, {y}))"


_FIRST = "SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1"


@query(f"SELECT vec_id, round({_distance('embedding', 'q')}, 6) AS distance FROM embeddings, ({_FIRST}) ORDER BY {_distance('embedding', 'q')}, vec_id LIMIT 10")
def knn_top10(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    asked = vectors.orderBy("vec_id").first()["embedding"]
    return retrieval.search(vectors, "vec_id", "embedding", asked, 10).select("vec_id", F.round("distance", 6).alias("distance"))


_BATCH = f"""SELECT q.vec_id AS query_id, e.vec_id, e.label, {_distance('e.embedding', 'q.embedding')} AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_distance('e.embedding', 'q.embedding')}, e.vec_id) AS r
    FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 QUALIFY r <= 10"""


def _batch(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    return retrieval.search_many(vectors, "vec_id", "embedding", queries, "query_id", "asked", 10, 64)


@query(f"SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(r AS INTEGER) AS rank FROM ({_BATCH})")
def knn_batch(spark: SparkSession, folder: str) -> DataFrame:
    return _batch(spark, folder).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"SELECT query_id, label, count(*) AS votes FROM ({_BATCH}) GROUP BY ALL")
def knn_label_vote(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    return _batch(spark, folder).join(labels, "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))


@query("SELECT p.position, e.vec_id, e.label FROM (SELECT unnest([7, 3, 7, 100000000, 0]) AS vec_id, unnest([0, 1, 2, 3, 4]) AS position) p JOIN embeddings e USING (vec_id)")
def ordered_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.ordered_lookup(table(spark, folder, "embeddings"), "vec_id", [7, 3, 7, 100_000_000, 0]).select("position", "vec_id", "label")


@query(
    r"""SELECT chunk_id, '[Source: ' || array_to_string(list_concat([t], CASE WHEN p[1] = t THEN p[2:] ELSE p END), ' > ') || ']' AS header FROM
    (SELECT DISTINCT c.chunk_id, coalesce(c.section_path, []) AS p, CASE WHEN regexp_replace(coalesce(d.title, ''), '\s+', '', 'g') = '' THEN 'untitled' ELSE d.title END AS t
    FROM chunks c JOIN documents d USING (document_id))"""
)
def source_headers(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "documents").select("document_id", fn.shown_title(F.col("title")).alias("t"))
    rows = table(spark, folder, "chunks").select("chunk_id", "document_id", "section_path").dropDuplicates(["chunk_id"])
    return rows.join(titles, "document_id").select("chunk_id", fn.source_header(F.col("t"), F.col("section_path")).alias("header"))


def _hits(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """The chunks nearest to the fixed question, by hashed words. Texts are fetched for the hits only."""
    chunks = table(spark, folder, "chunks").where("content IS NOT NULL")
    embedder = HashEmbedder()
    vectors = embed_table(chunks.select("chunk_id", "content"), "content", embedder)
    hits = retrieval.search(vectors.drop("content"), "chunk_id", "vector", embedder.embed([QUESTION])[0], limit, unique=False)
    return chunks.join(F.broadcast(hits), "chunk_id").dropDuplicates(["chunk_id"])  # limit rows


@query()
def nearest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return flagship(spark, folder)


@query()
def context_window(spark: SparkSession, folder: str) -> DataFrame:
    """The context for the fixed question within the context budget."""
    budget = table(spark, folder, "chunk_budgets").where("profile = 'context'").first()["token_budget"]
    parts = retrieval.context_parts(_hits(spark, folder, retrieval.CANDIDATES), table(spark, folder, "documents"))
    text = retrieval.fold_context([(r["rank"], r["chunk_id"], r["part"]) for r in parts.collect()], budget)
    return spark.createDataFrame([(text,)], "context string")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 chunks nearest to a fixed question, with where they come from."""
    titles = table(spark, folder, "documents").select("document_id", fn.shown_title(F.col("title")).alias("title"))
    joined = _hits(spark, folder, 10).join(titles, "document_id", "left")
    header = fn.source_header(fn.shown_title(F.col("title")), F.col("section_path"))
    return joined.select("rank", "chunk_id", header.alias("header"), F.round("distance", 6).alias("distance"), fn.snippet(F.col("content")).alias("snippet")).orderBy("rank")
