"""Near-duplicates by b-bit MinHash.

Texts of the same words are one class. Of each class the minima of many hash functions over its word shingles are taken;
bands of them give the candidates. The low bits of the minima are packed, and of each candidate pair the similarity is
estimated from the count of equal lanes, corrected for lanes that agree by chance. What passes is checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.tables import cut

#: Bits kept of each minimum; lanes of four in a word of 64.
BITS = 4
LANES = 64 // BITS
#: Classes of a band that are joined directly, at most. Bands of more are compared by signatures, in blocks of as many.
HOT = 4_000
_words = regex.compile(r"[\p{L}\p{N}]+")


class Sketch:
    """Hash functions and bands. 64 bands of 3 miss a pair of similarity 0.5 once in 5,000, one of 0.6 once in 6 million."""

    def __init__(self, shingle: int = 5, bands: int = 64, rows: int = 3, seed: int = 1):
        self.shingle, self.bands, self.rows = shingle, bands, rows
        self.size = bands * rows
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(1, 1 << 63, self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, self.size, dtype=np.uint64)
        self.mix = rng.integers(1, 1 << 63, max(shingle, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def shingles(self, words: list[str], known: dict[str, int]) -> np.ndarray:
        """Sorted distinct hashes of the runs of consecutive words. Fewer words than a run has give none."""
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
        n = len(h) - self.shingle + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for i in range(self.shingle):
            total = (total ^ (total >> np.uint64(29))) * self.mix[i] + h[i : i + n]
        total ^= total >> np.uint64(32)
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
        return np.unique(total)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.size, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 512):
            np.minimum(least, (shingles[i : i + 512, None] * self.mul + self.add).min(axis=0), out=least)
        return least

    def pack(self, minima: np.ndarray) -> np.ndarray:
        """The top bits of each minimum are spread by its hash function; the low ones of multiplicative hashes are not."""
        low = (minima * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
        low = np.concatenate([low, np.zeros(-len(low) % LANES, np.uint64)]).reshape(-1, LANES)
        return (low << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        total = np.arange(self.bands, dtype=np.uint64)
        for i in range(self.rows):
            total = (total ^ (total >> np.uint64(31))) * self.mix[i] + minima.reshape(self.bands, self.rows)[:, i]
        return total ^ (total >> np.uint64(32))


def shingle_rows(frame: DataFrame, key: str, text: str, sketch: Sketch, least_words: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept, class BINARY, shingles ARRAY<BIGINT>) of texts of at least so many words, one row per key."""

    @F.pandas_udf("class binary, shingles array<bigint>")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in texts:
            if len(known) > 500_000:
                known.clear()
            classes, sets = [], []
            for t in batch:
                words = _words.findall(t.lower()) if t else []
                enough = len(words) >= max(least_words, sketch.shingle)
                classes.append(xxhash.xxh3_128_digest(" ".join(words)) if enough else None)
                sets.append(sketch.shingles(words, known).view(np.int64) if enough else None)
            yield pd.DataFrame({"class": classes, "shingles": sets})

    source = frame.select(F.col(key).alias("key"), F.struct(F.lit(0), *keep).alias("kept"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    made = source.withColumn("read", read("text")).select("key", "kept", F.col("read.class").alias("class"), F.col("read.shingles").alias("shingles"))
    return made.where(F.col("class").isNotNull()).dropDuplicates(["key"])


def agreeing(a: Column, b: Column, lanes: int) -> Column:
    """How many lanes of two packed signatures are equal."""

    def unlike(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(lanes) - F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda t, x: t + x)


def estimate(equal: Column, lanes: int) -> Column:
    """Similarity from equal lanes, less those that agree by chance."""
    chance = 2.0**-BITS
    return (equal / F.lit(float(lanes)) - chance) / (1 - chance)


def likely_within(part: pa.Table, lanes: int, similarity: float, least: float) -> pa.Table:
    """(a, b): pairs of ids of one block, or across the two of a part, whose estimate reaches `least`, by bit counts of packed lanes."""
    part = part.combine_chunks()
    ids, sizes, side = (part.column(c).to_numpy() for c in ("id", "n", "side"))
    words = np.stack([np.asarray(p, np.int64) for p in part.column("packed").to_pylist()]).view(np.uint64)
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    enough = int(np.ceil(lanes * (least * (1 - 2.0**-BITS) + 2.0**-BITS) - 1e-9))
    ones, out = np.uint64(0x1111111111111111), []
    for i in range(0, len(left), 16):
        x = left[i : i + 16]
        unlike = np.zeros((len(x), len(right)), np.int64)
        for w in range(words.shape[1]):
            d = words[x, w][:, None] ^ words[right, w][None, :]
            d |= d >> np.uint64(1)
            d |= d >> np.uint64(2)
            unlike += np.bitwise_count(d & ones)
        near = np.minimum(sizes[x][:, None], sizes[right][None, :]) >= similarity * np.maximum(sizes[x][:, None], sizes[right][None, :])
        a, b = np.nonzero((lanes - unlike >= enough) & near)
        out.append(np.stack([ids[x[a]], ids[right[b]]]))
    pairs = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
    pairs = pairs[:, pairs[0] != pairs[1]]
    return pa.table({"a": np.minimum(*pairs), "b": np.maximum(*pairs)})


def hot_candidates(hot: DataFrame, packed: DataFrame, sketch: Sketch, similarity: float, least: float, block: int) -> DataFrame:
    """(a, b) of bands of many classes: each pair of blocks of a band is a task, and only likely pairs leave it."""
    blocks = F.ceil(F.col("m") / block).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    placed = hot.join(packed, "id").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # 0 within a block, -1 and 1 in a pair of blocks.
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), -1).otherwise(1).cast("int")
    tasks = placed.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "id", "n", "packed", side.alias("side"))
    return tasks.groupBy("band", "i", "j").applyInArrow(lambda part: likely_within(part, sketch.size, similarity, least), "a bigint, b bigint")


def class_pairs(classes: DataFrame, sketch: Sketch, similarity: float, hot: int = HOT) -> DataFrame:
    """(a, b, jaccard): pairs of classes, a < b, of at least the similarity. classes has class and shingles, once each.

    Classes are numbered, so that bands and candidates are numbers. Bands of one class are dropped before the join; those of
    more than `hot` are compared in blocks, whole.
    """

    @F.pandas_udf("packed array<bigint>, keys array<bigint>")
    def signatures(sets: pd.Series) -> pd.DataFrame:
        rows = [sketch.minima(np.asarray(s, dtype=np.int64).view(np.uint64)) for s in sets]
        return pd.DataFrame({"packed": [sketch.pack(m).view(np.int64) for m in rows], "keys": [sketch.keys(m).view(np.int64) for m in rows]})

    made = classes.select("class", "shingles", F.size("shingles").alias("n"), signatures("shingles").alias("s"))
    signed = cut(made.select(F.monotonically_increasing_id().alias("id"), "class", "shingles", "n", "s.packed", "s.keys"))
    bands = signed.select("id", "n", F.explode("keys").alias("band"))
    shared = cut(bands.withColumn("m", F.count("*").over(Window.partitionBy("band"))).where("m > 1"))
    few = shared.where(F.col("m") <= hot)
    left, right = few.select("band", F.col("id").alias("a"), F.col("n").alias("na")), few.select("band", F.col("id").alias("b"), F.col("n").alias("nb"))
    near = (F.col("na") >= F.col("nb") * similarity) & (F.col("nb") >= F.col("na") * similarity)
    # Estimates stray by 1 / (2 sqrt(lanes)) at most; four times that is left as slack, for the exact check to decide.
    slack = 4 * 0.5 / sketch.size**0.5 / (1 - 2.0**-BITS)
    candidates = left.join(right, "band").where((F.col("a") < F.col("b")) & near).select("a", "b")
    packed = signed.select("id", "packed")
    many = shared.where(F.col("m") > hot)
    if not many.isEmpty():
        candidates = candidates.unionByName(hot_candidates(many, packed, sketch, similarity, similarity - slack, hot))
    candidates = candidates.distinct()
    judged = candidates.join(packed.toDF("a", "pa"), "a").join(packed.toDF("b", "pb"), "b")
    likely = judged.where(estimate(agreeing(F.col("pa"), F.col("pb"), sketch.size), sketch.size) >= similarity - slack).select("a", "b")
    sets = signed.select("id", "class", "shingles")
    both = likely.join(sets.toDF("a", "ca", "sa"), "a").join(sets.toDF("b", "cb", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    found = both.select("ca", "cb", (common / (F.size("sa") + F.size("sb") - common)).alias("jaccard")).where(F.col("jaccard") >= similarity)
    return found.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component, by large and small stars.

    Each round is written to the checkpoint folder. A node of many edges costs a partial minimum, never a list.
    """
    stars = cut(edges.toDF("u", "v").where("u <> v").distinct())
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.toDF("u", "v"))
        stars = cut(small.where("u <> v").distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return stars.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


class Groups:
    """Near-duplicate classes of a table, their members and the links between them."""

    def __init__(self, frame: DataFrame, key: str, text: str, sketch: Sketch, similarity: float, least_words: int = 0, keep: tuple[str, ...] = ()):
        self.rows = cut(shingle_rows(frame, key, text, sketch, least_words, keep))
        self.members = self.rows.select("key", "class", *[F.col(f"kept.{c}").alias(c) for c in keep])
        classes = self.rows.groupBy("class").agg(F.first("shingles").alias("shingles"))
        self.pairs = cut(class_pairs(classes, sketch, similarity))

    def groups(self) -> DataFrame:
        """(key, class_id, group_id, links): class_id is the least key of the texts of the same words, group_id the least
        class_id of the classes that chains of links join, links the number of classes linked to this one."""
        names = self.members.groupBy("class").agg(F.min("key").alias("class_id"))
        named = self.pairs.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select("x", "y")
        joined = components(named).toDF("class_id", "group_id")
        links = named.select("x").unionByName(named.select(F.col("y").alias("x"))).groupBy("x").agg(F.count("*").alias("links")).withColumnRenamed("x", "class_id")
        known = names.join(joined, "class_id", "left").join(links, "class_id", "left")
        known = known.select("class", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
        return self.members.join(known, "class").select("key", "class_id", "group_id", "links")
