"""Parsing, checking, rendering and chunking whole tables of documents.

Each is one narrow Arrow transform: a document's tree stays in its row, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.errors import MarlstoneError
from marlstone.ir import arena, check, tree
from marlstone.operators import chunking
from marlstone.parsers import html, markdown

CHUNK = T.ArrayType(
    T.StructType(
        [
            T.StructField("section_path", T.ArrayType(T.StringType())),
            T.StructField("content", T.StringType()),
            T.StructField("block_type", T.StringType()),
            T.StructField("sequence_index", T.LongType()),
            T.StructField("token_count", T.LongType()),
        ]
    )
)
PARSED = T.StructType([*arena.DOCUMENT.fields, T.StructField("error", T.StringType())])


def read(content: str, format_: str, extract: bool = True, callouts: bool = False, repeats: bool = False) -> dict:
    """The checked and normalized tree of a source."""
    if format_ == "Markdown":
        document = markdown.parse(content, repeats, callouts)
    else:
        document = html.parse(content, extract)
    document["error"] = check.fault(document["body"], len(content.encode()))
    document["body"] = check.normalized(document["body"])
    return document


def parsed(content: Column, format_: Column, extract: bool = True, callouts: bool = False, repeats: bool = False) -> Column:
    """struct(title, format, frontmatter, nodes, inlines, diagnostics, error). Null content gives null."""

    @F.pandas_udf(PARSED)
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, formats in batches:
            rows = []
            for t, f in zip(texts, formats):
                document = None if t is None else read(t, f, extract, callouts, repeats)
                rows.append(dict.fromkeys(PARSED.names) if document is None else arena.flatten(document) | {"error": document["error"]})
            yield pd.DataFrame(rows, columns=PARSED.names)

    return parse(content, format_)


def stored(trees: Column) -> Column:
    """The same of stored JSON trees. What doesn't parse has an error and nothing else; null gives null."""

    @F.pandas_udf(PARSED)
    def load(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                try:
                    rows.append(dict.fromkeys(PARSED.names) if t is None else arena.flatten(tree.loads(t)) | {"error": None})
                except MarlstoneError as e:
                    rows.append(dict.fromkeys(PARSED.names) | {"error": str(e)})
            yield pd.DataFrame(rows, columns=PARSED.names)

    return load(trees)


def _over_trees(kind: T.DataType | str, make: Callable[[dict], object]) -> Callable[[Column], Column]:
    """A column function of stored JSON trees; null, and trees that don't parse, give null."""

    def column(trees: Column) -> Column:
        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            def one(t):
                try:
                    return None if t is None else make(tree.loads(t))
                except MarlstoneError:
                    return None

            for texts in batches:
                yield pd.Series([one(t) for t in texts], dtype=object)

        return run(trees)

    return column


def rendered(trees: Column, format_: str) -> Column:
    """A stored tree as markdown, html or text."""
    from marlstone.library import emitter

    return _over_trees("string", emitter(format_))(trees)


def chunks_of(trees: Column, budget: int = chunking.DEFAULT_BUDGET) -> Column:
    return _over_trees(CHUNK, lambda d: chunking.chunk(d, budget))(trees)


def faults(trees: Column) -> Column:
    """The first violation in a stored tree, null if there is none."""
    return _over_trees("string", lambda d: check.fault(d["body"]))(trees)


def chunk_sources(frame: DataFrame, key: str, content: str, format_: Column, budget: int = chunking.DEFAULT_BUDGET) -> DataFrame:
    """(key, section_path, content, block_type, sequence_index, token_count) of sources, parsed and chunked in one pass.

    Sources with a violation, null ones and those without content give no rows.
    """

    @F.pandas_udf(CHUNK)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, formats in batches:
            out = []
            for t, f in zip(texts, formats):
                document = None if t is None else read(t, f)
                out.append([] if document is None or document["error"] else chunking.chunk(document, budget))
            yield pd.Series(out, dtype=object)

    return frame.select(F.col(key), F.inline(run(F.col(content), format_)))


def blocks(frame: DataFrame, key: str, document: str = "document") -> DataFrame:
    """One row a node."""
    return frame.select(key, F.inline(f"{document}.nodes"))
