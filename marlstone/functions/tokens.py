"""The deterministic token counter, on the JVM and in Python.

A token is a run of letters, up to three digits, or a run of other visible characters. White space is the ASCII set, so
that Java, RE2 and Python agree.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZER = "pretoken3"
PATTERN = r"\p{L}+|\p{N}{1,3}|[^ \t\n\x0B\f\r\p{L}\p{N}]+"
_compiled = regex.compile(PATTERN)


def token_count(text: Column) -> Column:
    """BIGINT, null for null."""
    return F.regexp_count(text, F.lit(PATTERN)).cast("bigint")


def count_tokens(text: str) -> int:
    return sum(1 for _ in _compiled.finditer(text))


def token_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _compiled.finditer(text)]
