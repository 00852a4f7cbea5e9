"""The k most similar vectors of every vector, by cosine: cells, additive codes, exact reranking.

Vectors are spread over cells, which grow in number with the data. Every vector is a query in its own cell and in those
nearly as near; how near is read off a bounded sample, so that a stated share of true neighbours lies in the cells probed.
In a cell, tables of codeword products score all codes, and exact cosines decide about the shortlist. Where only
neighbours above a cosine are wanted, the stored angle between a vector and its code bounds the score that such a
neighbour can have: what is below can be passed over without loss, cells can be small and few of them are probed. Equal
vectors are one row until the end. A cell with more rows than its share is split, base and queries apart, so that no task
grows with the data.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.additive import F32, Cells, Codebooks, found_among, one_thread
from marlstone.tables import cut

#: Rows read to place cells and to train codebooks, of each dimension. All rows are indexed and searched.
TRAINING_ROWS = 20_000
#: Vectors of a cell: where neighbours above a cosine are wanted, and where the nearest are, however far.
NEAR_CELL, CELL = 1_000, 8_000
#: From this cosine on the first plan is taken. Below, the bound lets too much through.
NEAR = 0.8
#: Of the true neighbours, so many lie in the cells that are probed. Near ones are found from either side.
NEAR_RECALL, CELL_RECALL = 0.98, 0.97
#: Cells probed at most are the nearest so many.
NEAR_BEAM, BEAM = 32, 64
SHORTLIST = 480
#: Rows of a task, as multiples of the size of a cell.
BASE_A_TASK, QUERIES_A_TASK = 4, 8
#: Bytes of a task's input, about.
TASK_BYTES = 16 << 20


def packed(values: np.ndarray) -> list[bytes | None]:
    """Vectors, one a row, as bytes; None for one that isn't finite or is all 0.

    Vectors of numbers of four decimals, the usual spelling, are kept exactly as 16-bit multiples of 0.0001; others as
    doubles, divided by the largest. Equal numbers give equal bytes however they are spelled.
    """
    with np.errstate(all="ignore"):
        top = np.abs(values).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        steps = np.rint(values * 10_000)
        exact = good & (top < 3.2) & (np.abs(values * 10_000 - steps).max(axis=1) < 1e-6)
        scaled = values / np.where(good, top, 1)[:, None]
        ints = np.where(exact[:, None], steps, 0).astype(np.int16)
    return [ints[i].tobytes() if exact[i] else scaled[i].tobytes() if good[i] else None for i in range(len(values))]


class Vectors:
    """Packed vectors of one dimension."""

    def __init__(self, column: pa.Array | list[bytes], dimension: int):
        column = column if isinstance(column, pa.Array) else pa.array(column, pa.binary())
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] else np.empty(0, np.uint8)
        short = np.diff(ends) == 2 * dimension
        self.short = np.where(short, np.cumsum(short) - 1, -1)
        self.ints = self._rows(data, ends, short, 2 * dimension).view(np.int16)
        self.doubles = self._rows(data, ends, ~short, 8 * dimension).view(np.float64)
        self.place = np.cumsum(~short) - 1
        self.over = np.empty(len(column))
        for at, part in ((short, self.ints), (~short, self.doubles)):
            wide = part.astype(np.float64)
            self.over[at] = 1 / np.sqrt(np.einsum("ij,ij->i", wide, wide))

    @staticmethod
    def _rows(data: np.ndarray, ends: np.ndarray, which: np.ndarray, width: int) -> np.ndarray:
        at = ends[:-1][which]
        if len(at) and at[-1] - at[0] == width * (len(at) - 1):  # one after another
            return data[at[0] : at[0] + width * len(at)].reshape(-1, width).copy()
        return data[at[:, None] + np.arange(width)] if len(at) else np.empty((0, width), np.uint8)

    def wide(self, rows: np.ndarray) -> np.ndarray:
        """Rows in doubles, as they were given but for a factor."""
        short = self.short[rows]
        if not len(self.doubles):
            return self.ints[short].astype(np.float64)
        out = np.empty((len(rows), self.doubles.shape[1]))
        out[short >= 0] = self.ints[short[short >= 0]]
        out[short < 0] = self.doubles[self.place[rows[short < 0]]]
        return out

    def units(self) -> np.ndarray:
        every = np.arange(len(self.over))
        return (self.wide(every) * self.over[:, None]).astype(F32)

    def cosines(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of rows, in doubles. The same for (a, b) and (b, a)."""
        out = np.empty(len(a))
        for i in range(0, len(a), 1 << 15):
            x, y = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
            out[i : i + (1 << 15)] = np.einsum("ij,ij->i", self.wide(x), self.wide(y)) * (self.over[x] * self.over[y])
        return out


def unpack(column: list[bytes], dimension: int) -> np.ndarray:
    """Unit vectors, one a row."""
    return Vectors(column, dimension).units()


class Model:
    """Cells and codebooks of one dimension; number counts the cells of the dimensions before."""

    def __init__(self, sample: np.ndarray, total: int, at_least: float = -2.0, cell: int = CELL, number: int = 0, seed: int = 1):
        self.number, self.at_least = number, at_least
        self.near = at_least >= NEAR
        self.beam = NEAR_BEAM if self.near else BEAM
        self.cells = Cells(sample, total / cell, seed)
        self.books = Codebooks(sample, seed=seed)
        self.reach = self._reach(sample)

    def _reach(self, sample: np.ndarray, k: int = 10, queries: int = 400) -> float:
        """By how much a cell may be farther than the nearest one and still be probed."""
        if len(self.cells) == 1:
            return 0.0
        rng = np.random.default_rng(7)
        if self.near:
            # A neighbour as far as allowed, in any direction.
            asked = sample[np.linspace(0, len(sample) - 1, min(10 * queries, len(sample))).astype(int)]
            aside = rng.normal(size=asked.shape)
            aside -= (aside * asked).sum(1, keepdims=True) * asked
            aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-30)
            other = (self.at_least * asked + math.sqrt(max(0.0, 1 - self.at_least**2)) * aside).astype(F32)
            true, share = self.cells.near(other, self.beam)[0][:, :1], NEAR_RECALL
        else:
            at = np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)
            asked = sample[at]
            score = asked @ sample.T
            score[np.arange(len(at)), at] = -2
            k = min(k, len(sample) - 1)
            own = self.cells.near(sample, self.beam)[0][:, 0]
            true, share = own[np.argpartition(-score, k - 1, axis=1)[:, :k]], CELL_RECALL
        cells, cost = self.cells.near(asked, self.beam)
        same = cells[:, :, None] == true[:, None, :]
        gap = np.where(same, (cost - cost[:, :1])[:, :, None], np.inf).min(1)
        return float(np.quantile(gap.ravel(), share, method="higher"))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cells, how many, codes with norm and floor as bytes): the cells to probe of all vectors one after another, own first."""
        cells, cost = self.cells.near(x, self.beam)
        probed = cost <= cost[:, :1] + self.reach
        probed[:, 0] = True
        codes, norms = self.books.encode(x)
        floors = np.full(len(x), -np.inf, F32)
        if self.near:
            close = np.clip((self.books.decode(codes) * x).sum(1) / norms, -1, 1)
            # The angle of a neighbour to the code is at most its angle to the vector and that of the vector to its code.
            wide = np.minimum(math.acos(min(1.0, self.at_least)) + np.arccos(close.astype(np.float64)), math.pi)
            floors = ((np.cos(wide) - 1e-5) * norms).astype(F32)
        blob = np.concatenate([codes, norms.astype(F32)[:, None].view(np.uint8), floors[:, None].view(np.uint8)], axis=1)
        return cells[probed] + self.number, probed.sum(1), blob


_numbers = re.compile(r"\s*\[[\s0-9eE+.,-]*\]\s*")


def parsed(texts: list[str], dimension: int) -> np.ndarray:
    """Vectors, one a row, of JSON arrays of numbers; rows of 0 for all other texts."""
    fine = [bool(_numbers.fullmatch(t)) for t in texts]
    try:
        rows = json.loads("[" + ",".join([t if f else "[]" for t, f in zip(texts, fine)]) + "]")
    except ValueError:
        rows = []
        for t, f in zip(texts, fine):
            try:
                rows.append(json.loads(t) if f else [])
            except ValueError:
                rows.append([])
    blank = [0.0] * dimension
    rows = [r if len(r) == dimension else blank for r in rows]
    try:
        return np.array(rows, np.float64).reshape(len(rows), dimension)
    except OverflowError:  # an integer beyond all doubles
        return np.array([blank if any(abs(v) > 1e308 for v in r) else r for r in rows], np.float64)


def read_vectors(frame: DataFrame, key: str, dimension: str, vector: str) -> DataFrame:
    """(key, class, dim, vec): all valid rows, parsed a batch at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dims = batch.column("text").to_pylist(), batch.column("dim").to_numpy()
            vecs: list = [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                # A text of so many numbers has as many commas at least: others need no room.
                at = [i for i in at.tolist() if texts[i].count(",") == dim - 1]
                for i, v in zip(at, packed(parsed([texts[i] for i in at], int(dim)))) if at else ():
                    vecs[i] = v
            kept = [i for i, v in enumerate(vecs) if v is not None]
            classes = [xxhash.xxh3_128_digest(vecs[i] + int(dims[i]).to_bytes(4, "little")) for i in kept]
            some = batch.select(["key", "dim"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(classes, pa.binary()), some.column("dim"), pa.array([vecs[i] for i in kept], pa.binary())], names=["key", "class", "dim", "vec"])

    rows = frame.select(F.col(key).cast("string").alias("key"), F.col(dimension).cast("int").alias("dim"), F.col(vector).alias("text"))
    return rows.where("key IS NOT NULL AND dim > 0 AND text IS NOT NULL").mapInArrow(pack, "key string, class binary, dim int, vec binary")


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(n, class, dim, vec, ids, many): one row for equal vectors, numbered, with the k + 1 least keys, and whether it has more.

    Of equal vectors each batch sends one row, so that a vector that a third of all rows have stays small.
    """
    few = k + 2

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[bytes, int] = {}
            keys: list[list[str]] = []
            at: list[int] = []
            for i, (c, key) in enumerate(zip(batch.column("class").to_pylist(), batch.column("key").to_pylist())):
                if c in first:
                    keys[first[c]].append(key)
                else:
                    first[c] = len(keys)
                    keys.append([key])
                    at.append(i)
            lists = pa.array([k if len(k) == 1 else sorted(set(k))[:few] for k in keys], pa.list_(pa.string()))
            some = batch.select(["class", "dim", "vec"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, lists], names=["class", "dim", "vec", "ids"])

    parts = rows.mapInArrow(combine, "class binary, dim int, vec binary, ids array<string>")
    merged = parts.groupBy("class").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    ids = F.when(F.size("ids") > 1, F.slice(F.array_sort("ids"), 1, few)).otherwise(F.col("ids"))
    made = merged.select("class", "dim", "vec", ids.alias("ids"))
    return made.select(F.monotonically_increasing_id().alias("n"), "class", "dim", "vec", F.slice("ids", 1, k + 1).alias("ids"), (F.size("ids") > k + 1).alias("many"))


def answers(models: dict[int, Model], part: pa.Table, at_least: float, k: int) -> pa.Table:
    """(n, m, c): the k best bases of every query of a task."""
    one_thread()
    part = part.combine_chunks()
    column = {c: part.column(c).chunk(0) for c in part.column_names}
    dim = column["dim"][0].as_py()
    model = models[dim]
    role, n = column["role"].to_numpy(), column["n"].to_numpy()
    base, query = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    out: list[list] = [[], [], []]
    if len(base) and len(query):
        held = Vectors(column["vec"], dim)
        blob = np.frombuffer(b"".join(column["codes"].take(pa.array(base)).to_pylist()), np.uint8).reshape(len(base), -1)
        norms, floors = np.ascontiguousarray(blob[:, -8:]).view(F32).T
        for a, b, c in found_among(model.books, held.units(), held.cosines, query, base, blob[:, :-8], norms, floors if model.near else None, at_least, SHORTLIST, k):
            out[0].append(n[a])
            out[1].append(n[b])
            out[2].append(c)
    arrays = [pa.array(np.concatenate(o) if o else [], t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))]
    return pa.Table.from_arrays(arrays, names=["n", "m", "c"])


def neighbours(frame: DataFrame, key: str, dimension: str, vector: str, k: int = 10, at_least: float = -2.0, cell: int | None = None) -> DataFrame:
    """(key, neighbour, rank from 1, cosine): the k most similar valid vectors of equal dimension, ties by key.

    Of these only those with a cosine of `at_least` are reported; they rank as among all. Invalid vectors neither ask nor
    answer. A dimension of k vectors or fewer gives shorter lists, one of a single vector none. Rows with the same key are
    one vector, of differing ones one is taken by hash; other columns play no part. An empty table gives no rows.
    """
    spark = frame.sparkSession
    near = at_least >= NEAR
    cell = cell or (NEAR_CELL if near else CELL)
    rows = read_vectors(frame, key, dimension, vector)

    # Cells and codebooks, on samples drawn from the texts by a hash of the key: nothing is sorted, only their rows are parsed.
    kinds = frame.where(F.col(key).isNotNull()).groupBy(F.col(dimension).cast("int").alias("dim")).agg(F.approx_count_distinct(key).alias("count"))
    counts = {r["dim"]: r["count"] for r in kinds.where("dim > 0").collect()}  # one row a dimension
    drawn, samples = F.lit(False), {d: set() for d in counts}
    for d, count in counts.items():
        part = math.ceil(1_000_000 * min(1.0, TRAINING_ROWS / max(1, count)))
        drawn = drawn | ((F.col(dimension) == d) & (F.pmod(F.xxhash64(key), F.lit(1_000_000)) < part))
    if counts:
        some = read_vectors(frame.where(drawn), key, dimension, vector).select("class", "dim", "vec").limit(2 * TRAINING_ROWS * len(counts))
        for r in some.collect():
            samples[r["dim"]].add((bytes(r["class"]), bytes(r["vec"])))
    models: dict[int, Model] = {}
    number = 0
    for d in sorted(counts):
        known = [v for _, v in sorted(samples[d])]
        models[d] = Model(unpack(known, d) if known else np.eye(1, d, dtype=F32), counts[d], at_least, cell, number)
        number += len(models[d].cells)
    shared = spark.sparkContext.broadcast(models)  # codebooks of 256 words a level, whatever the number of cells

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells: list = [None] * len(dims)
            codes: list = [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                flat, count, blob = shared.value[int(dim)].place(Vectors(batch.column("vec").take(pa.array(at)), int(dim)).units())
                for i, c, b in zip(at.tolist(), np.split(flat, np.cumsum(count)[:-1]), blob):
                    cells[i], codes[i] = c, b.tobytes()
            made = [pa.array(cells, pa.list_(pa.int64())), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "cells", "codes"])

    def placed_of(these: DataFrame) -> DataFrame:
        return cut(distinct_vectors(these, k).mapInArrow(place, "n bigint, class binary, dim int, vec binary, ids array<string>, many boolean, cells array<bigint>, codes binary"))

    def all_members(placed: DataFrame, these: DataFrame) -> DataFrame:
        """(n, key) of every key. Only if some vector has more keys than were kept are the rows read again."""
        members = placed.where("NOT many").select("n", F.explode("ids").alias("key"))
        if placed.where("many").isEmpty():
            return members
        return members.unionByName(these.join(placed.where("many").select("n", "class"), "class").select("n", "key").distinct())

    placed = placed_of(rows)
    members = all_members(placed, rows)
    marks = members.groupBy(F.xxhash64("key").alias("h")).agg(F.min("n").alias("a"), F.max("n").alias("b")).where("a <> b")
    if not marks.isEmpty():
        # Keys with different vectors: one is taken by hash, and the rest is made again without the others.
        one = rows.groupBy("key").agg(F.min("class").alias("class"))
        rows = cut(rows.join(one, ["key", "class"], "left_semi").select("key", "class", "dim", "vec"))
        placed = placed_of(rows)
        members = all_members(placed, rows)

    # Cells above the bounds, one by one, and all others together.
    bases, queries = BASE_A_TASK * cell, QUERIES_A_TASK * cell
    sizes = placed.select(F.posexplode("cells").alias("pos", "cell")).groupBy("cell").agg(F.count("*").alias("asked"), F.count_if(F.col("pos") == 0).alias("own"))
    hot = (F.col("asked") > queries) | (F.col("own") > bases)
    listed = sizes.groupBy(F.when(hot, F.col("cell")).alias("cell")).agg(F.sum("asked").alias("asked"), F.sum("own").alias("own")).collect()
    splits = {r["cell"]: (min(60_000, -(-r["own"] // bases)), min(60_000, -(-r["asked"] // queries))) for r in listed if r["cell"] is not None}
    wide = max([2 * d + 90 for d in models], default=1)
    parts = max(1, -(-sum(r["asked"] for r in listed) * wide // TASK_BYTES))
    shared_splits = spark.sparkContext.broadcast(splits)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each task that needs the vector, as base (1), query (2) or both (3)."""
        for batch in batches:
            lists = batch.column("cells")
            flat, count = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            at = np.repeat(np.arange(len(count)), count)
            own = np.zeros(len(flat), bool)
            own[np.cumsum(count) - count] = True
            task, role = flat << 32, np.where(own, 3, 2)
            if shared_splits.value:
                mixed = pc.cast(batch.column("n"), pa.int64()).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                made = [(at, task, role)]
                for c in np.intersect1d(flat, np.fromiter(shared_splits.value, np.int64)):
                    here = np.flatnonzero(flat == c)
                    role[here] = 0
                    b, q = shared_splits.value[int(c)]
                    mine, ask = (mixed[at[here]] >> np.uint64(20)) % np.uint64(b), (mixed[at[here]] >> np.uint64(42)) % np.uint64(q)
                    for i in range(b):
                        for j in range(q):
                            made.append((at[here], np.full(len(here), int(c) << 32 | i << 16 | j), own[here] & (mine == i) | ((ask == j) * 2)))
                at, task, role = (np.concatenate([m[i] for m in made]) for i in range(3))
                at, task, role = at[role > 0], task[role > 0], role[role > 0]
            some = batch.take(pa.array(at))
            codes = pc.if_else(pa.array(role & 1 == 1), some.column("codes"), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), pa.array(role, pa.int8()), some.column("n"), some.column("dim"), some.column("vec"), codes], names=["task", "role", "n", "dim", "vec", "codes"])

    def ask(part: pa.Table) -> pa.Table:
        return answers(shared.value, part, at_least, k + 1)

    tasks = placed.select("n", "dim", "vec", "cells", "codes").mapInArrow(route, "task bigint, role tinyint, n bigint, dim int, vec binary, codes binary")
    found = tasks.repartition(int(parts), "task").groupBy("task").applyInArrow(ask, "n bigint, m bigint, c double")
    if near:  # seen from either side
        found = found.unionByName(found.select(F.col("m").alias("n"), F.col("n").alias("m"), "c")).distinct()
    # Of a vector each task has k + 1 at most; each partition keeps its best before anything moves.
    first = Window.partitionBy("n").orderBy(F.desc("c"), "m")
    merged = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("n", "m", "c")
    named = merged.join(placed.select(F.col("n").alias("m"), "ids"), "m").select("n", "c", F.explode("ids").alias("id"))
    best = named.groupBy("n").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "id"))), 1, k + 1).alias("best"))
    others = members.join(best, "n").select("key", F.slice(F.expr("filter(best, b -> b.id <> key)"), 1, k).alias("best"))
    return others.select("key", F.posexplode("best").alias("pos", "b")).select(
        F.col("key").alias(key), F.col("b.id").alias("neighbour"), (F.col("pos") + 1).alias("rank"), (-F.col("b.c")).alias("cosine")
    )
