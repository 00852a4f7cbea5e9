"""Cutting oversized texts: balanced targets, snapped to the strongest boundary near each.

The smallest number of pieces is computed from the budget and the overlap. Their ends are placed at equal distances and
each is moved to the strongest boundary near its target; where a limit then fails, one more piece is tried. The last
resort is a fixed window, which always holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.tokens import token_count, token_spans

#: Strengths of boundaries; 0 is a cut inside running text.
PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE = 5, 4, 3, 2, 1
_sentence_end = re.compile(r"[.!?…。！？]['\"”’)\]]*$")
_clause_end = re.compile(r"[,;:、，；：—–)\]}]$")

PIECE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("start", "stop", "tokens")] + [T.StructField("strength", T.IntegerType())]
)


def strengths(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Of each cut before token i: how natural it is. The cut before the first token is never used."""
    out = [PARAGRAPH]
    for (a, b), (c, _) in zip(spans, spans[1:]):
        gap = text[b:c]
        if "\n" in gap:
            out.append(PARAGRAPH if gap.count("\n") > 1 else LINE)
        elif _sentence_end.search(text, max(a, b - 8), b) and (gap or ord(text[b - 1]) > 0x2000):
            out.append(SENTENCE)
        elif _clause_end.search(text, max(a, b - 1), b) and (gap or ord(text[b - 1]) > 0x2000):
            out.append(CLAUSE)
        else:
            out.append(SPACE if gap else 0)
    return out


def ends(total: int, strength: list[int], budget: int, overlap: int, slack: float = 0.2) -> list[int]:
    """Token positions at which the pieces end. Piece i + 1 begins `overlap` tokens before the end of piece i."""
    if total <= budget:
        return [total]
    overlap = max(0, min(overlap, budget - 1))
    step = budget - overlap
    least = -(-(total - overlap) // step)
    for count in range(least, least + 3 + least // 4):
        size = (total - overlap) / count
        reach = max(1, int(size * slack))
        cuts, begin = [], 0
        for i in range(1, count):
            target = round(overlap + size * i)
            low = max(begin + overlap + 1, target - reach, total - (count - i) * step)
            high = min(begin + budget, target + reach, total - 1)
            if low > high:
                break
            cut = max(range(low, high + 1), key=lambda e: (strength[e], -abs(e - target), -e))
            cuts.append(cut)
            begin = cut - overlap
        else:
            if total - begin <= budget:
                return cuts + [total]
    return [*range(budget, total, step), total]


def pieces(text: str, budget: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, stop, tokens, strength of the boundary at stop) in characters; the pieces cover the whole text.

    A text within the budget, an empty one included, is one piece.
    """
    spans = token_spans(text)
    if len(spans) <= budget:
        return [(0, len(text), len(spans), PARAGRAPH)]
    strength = strengths(text, spans)
    cuts = ends(len(spans), strength, budget, overlap)
    overlap = max(0, min(overlap, budget - 1))
    out, begin = [], 0
    for i, cut in enumerate(cuts):
        last = i == len(cuts) - 1
        stop = len(text) if last else spans[cut][0]
        out.append((spans[begin][0] if i else 0, stop, cut - begin, PARAGRAPH if last else strength[cut]))
        begin = cut - overlap
    return out


def _piece_udf(budget: int, overlap: int):
    @F.pandas_udf(T.ArrayType(PIECE))
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: None if t is None else [dict(zip(PIECE.names, p)) for p in pieces(t, budget, overlap)])

    return cut


def piece_column(text: Column, tokens: Column, budget: int, overlap: int) -> Column:
    """ARRAY of pieces. Only texts above the budget reach Python; the rest are one piece each."""
    whole = F.array(
        F.struct(
            F.lit(0).cast("bigint").alias("start"),
            F.char_length(text).cast("bigint").alias("stop"),
            tokens.alias("tokens"),
            F.lit(PARAGRAPH).alias("strength"),
        )
    )
    return F.when(tokens > budget, _piece_udf(budget, overlap)(F.when(tokens > budget, text))).otherwise(whole)


def split_oversized(frame: DataFrame, key: str, text: str, budget: int, overlap: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: key, piece_index, pieces, start_char, end_char, tokens, the columns of `keep`, content.

    Rows with the same key are taken as one row, the same one in every attempt. A null text gives no piece, an empty text one empty piece. Other
    columns than those named are dropped, whatever they are called. The key is not null; rows without one are dropped.
    """
    sized = frame.select(F.col(key).alias("key"), F.col(text).alias("text"), F.struct(F.lit(0), *keep).alias("kept")).where(
        F.col("key").isNotNull() & F.col("text").isNotNull()
    )
    # Texts are cut where they are read, in one pass. Of rows with the same key one is taken by hash; a column that the caller
    # doesn't ask for, such as the text, is then in no shuffle.
    measured = sized.withColumn("n", token_count(F.col("text"))).withColumn("pieces", piece_column(F.col("text"), F.col("n"), budget, overlap))
    hashed = measured.withColumn("h", F.xxhash64("text", "kept"))
    cut = hashed.groupBy("key").agg(*[F.min_by(c, F.col("h")).alias(c) for c in ("text", "kept", "pieces")])
    return cut.select("key", "text", "kept", F.size("pieces").alias("count"), F.posexplode("pieces")).select(
        F.col("key").alias(key),
        F.col("pos").alias("piece_index"),
        F.col("count").alias("pieces"),
        F.col("col.start").alias("start_char"),
        F.col("col.stop").alias("end_char"),
        F.col("col.tokens").alias("tokens"),
        F.col("col.strength").alias("boundary"),
        *[F.col(f"kept.{c}").alias(c) for c in keep],
        F.expr("substring(text, cast(col.start + 1 as int), cast(col.stop - col.start as int))").alias("content"),
    )
