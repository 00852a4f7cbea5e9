"""Filling containers of fixed capacity: best-two-fit.

Each container is filled greedily with the largest item that still fits. Then its smallest item is replaced by the two
unpacked items that together fill the room it leaves more tightly. Items are never split unless one exceeds the capacity.

At scale, items are spread over groups by a hash of their id, and each group is packed on its own: only ids and sizes
move, and no group depends on another. A group leaves at most one container badly filled, so the room lost to the
grouping is below one container in `CONTAINERS_A_GROUP`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.tokens import token_count
from marlstone.llm.boundaries import piece_column
from marlstone.tables import cut

#: Containers that one group fills, about. Groups follow the total size, so that no group grows with the data.
CONTAINERS_A_GROUP = 500


def best_two_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item, numbered from 0. Items of size 0 go where they are put first; larger ones than the
    capacity are an error."""
    if not sizes:
        return []
    if max(sizes) > capacity or min(sizes) < 0:
        raise ValueError("an item is larger than the container, or negative")
    waiting: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        waiting.setdefault(sizes[i], []).append(i)
    zeros = waiting.pop(0, [])
    #: largest[x] is the largest waiting size up to x.
    count = np.zeros(capacity + 1, dtype=np.int64)
    for s, items in waiting.items():
        count[s] = len(items)
    largest = np.maximum.accumulate(np.where(count > 0, np.arange(capacity + 1), 0))
    where = [0] * len(sizes)

    def take(size: int) -> int:
        count[size] -= 1
        if not count[size]:
            stop = size + 1
            while stop <= capacity and largest[stop] == size:
                stop += 1
            largest[size:stop] = largest[size - 1]
        return waiting[size].pop()

    def give(size: int, item: int) -> None:
        waiting[size].append(item)
        count[size] += 1
        if count[size] == 1:
            part = largest[size:]
            part[part < size] = size

    left, container = len(sizes) - len(zeros), 0
    while left:
        room, packed = capacity, []
        while room and (size := int(largest[room])):
            packed.append((size, take(size)))
            room -= size
            left -= 1
        if room and left and len(packed) > 1:
            small, item = packed[-1]
            wide = room + small
            #: For each first size a, the largest second size b with a + b <= wide.
            first = np.flatnonzero(count[1:wide] > 0) + 1
            if len(first):
                second = largest[wide - first]
                same = (second == first) & (count[first] < 2)
                second = np.where(same, largest[np.maximum(first - 1, 0)], second)
                total = np.where(second > 0, first + second, 0)
                best = int(total.argmax())
                if total[best] > small:
                    packed.pop()
                    a, b = int(first[best]), int(second[best])
                    packed += [(a, take(a)), (b, take(b))]
                    give(small, item)
                    left -= 1
        for _, item in packed:
            where[item] = container
        container += 1
    for item in zeros:
        where[item] = 0
    return where


def pack(frame: DataFrame, key: str, text: str, capacity: int, per_group: int = CONTAINERS_A_GROUP) -> DataFrame:
    """(key, piece_index, pieces, start_char, end_char, tokens, container).

    Rows with the same key are one item, of differing texts one by hash; a row without key or text is none. An empty text has size 0 and still gets a
    container. A text above the capacity is cut at natural boundaries, without overlap, and its pieces are packed. Other
    columns play no part. An empty table gives no rows.
    """
    sized = frame.select(F.col(key).alias("key"), F.col(text).alias("text"), token_count(F.col(text)).alias("n")).where(
        F.col("key").isNotNull() & F.col("text").isNotNull()
    )
    # Only positions and sizes are kept of the texts, before anything is shuffled.
    measured = sized.select("key", piece_column(F.col("text"), F.col("n"), capacity, 0).alias("pieces"), F.xxhash64("text").alias("h"))
    measured = measured.groupBy("key").agg(F.min_by("pieces", "h").alias("pieces"))
    items = measured.select("key", F.size("pieces").alias("pieces"), F.posexplode("pieces").alias("pos", "piece")).select(
        "key", "pos", "pieces", "piece.start", "piece.stop", "piece.tokens"
    )
    items = cut(items)  # used for their total, then packed: texts are read and cut once
    total = items.agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, round(total / (capacity * per_group)))
    schema = "key string, piece_index int, pieces int, start_char bigint, end_char bigint, tokens bigint, container string"

    def packed(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "key", "pos"], ascending=[False, True, True], kind="stable")
        where = best_two_fit(rows["tokens"].tolist(), capacity)
        return pd.DataFrame(
            {
                "key": rows["key"].astype(str),
                "piece_index": rows["pos"],
                "pieces": rows["pieces"],
                "start_char": rows["start"],
                "end_char": rows["stop"],
                "tokens": rows["tokens"],
                "container": [f"{group[0]}-{w}" for w in where],
            }
        )

    grouped = items.withColumn("group", F.pmod(F.xxhash64("key", "pos"), F.lit(groups)))
    return grouped.groupBy("group").applyInPandas(packed, schema).withColumnRenamed("key", key)
