"""Embedding by hashed words, exact cosine search, ordered lookup, budgeted context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as fn
from marlstone.functions.tokens import count_tokens

DIMENSION = 256
CANDIDATES = 50
#: A vector of searches is broadcast if it has at most so many numbers; more searches are joined in blocks.
BROADCAST_NUMBERS = 4_000_000


def bucket(word: Column, dimension: int = DIMENSION) -> Column:
    """The place of a word, by its MD5, so that other engines agree."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("bigint"), F.lit(dimension)).cast("int")


def sparse_embedding(frame: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """(key, bucket, weight): the vectors of `HashEmbedder`, one row for each place that isn't 0."""
    # The two small sigmas are one, as engines disagree on which to write.
    words = frame.select(key, F.explode(F.split(F.translate(F.lower(text), "ς", "σ"), r"\s+")).alias("word")).where("word <> ''")
    counts = words.groupBy(key, bucket(F.col("word"), dimension).alias("bucket")).agg(F.count("*").alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def cosine_distance(a: Column, b: Column) -> Column:
    """In doubles; 1 where a vector is all 0."""

    def sum_of(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda t, v: t + v)

    wide = [F.transform(v, lambda x: x.cast("double")) for v in (a, b)]
    dot = sum_of(F.zip_with(*wide, lambda x, y: x * y))
    norms = F.sqrt(sum_of(F.transform(wide[0], lambda x: x * x)) * sum_of(F.transform(wide[1], lambda x: x * x)))
    return F.when(norms > 0, 1.0 - dot / norms).otherwise(1.0)


def valid_vector(vector: Column, dimension: int) -> Column:
    return (F.size(vector) == dimension) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def search(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int, unique: bool = True) -> DataFrame:
    """(key, distance, rank from 1): exact, ties by key. The plan keeps the best of each partition, then of all.

    Keys that may stand on several rows (not `unique`) count once, at their least distance; only keys and distances are shuffled.
    """
    target = F.lit([float(x) for x in query])
    found = vectors.select(F.col(key), cosine_distance(F.col(vector), target).alias("distance"))
    if not unique:
        found = found.groupBy(key).agg(F.min("distance").alias("distance"))
    found = found.orderBy("distance", key).limit(limit)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))


def search_many(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, limit: int, dimension: int) -> DataFrame:
    """(query_key, key, distance, rank) for every query, exact.

    Queries go to every partition of the vectors in blocks of at most BROADCAST_NUMBERS numbers; each partition gives its
    own best, so that only `limit` rows a query and partition are shuffled. A query is not compared with its own key.
    """
    block = max(1, BROADCAST_NUMBERS // max(1, dimension))
    count = queries.count()
    made = None
    for at in range(max(1, -(-count // block))):
        part = queries.where(F.pmod(F.xxhash64(query_key), F.lit(max(1, -(-count // block)))) == at) if count > block else queries
        asked = F.broadcast(part.select(F.col(query_key).alias("q"), F.col(query_vector).alias("qv")))  # at most a block
        pairs = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).join(asked, F.col("q") != F.col("k"))
        scored = pairs.select("q", "k", cosine_distance(F.col("v"), F.col("qv")).alias("distance"))
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "k"))).where(F.col("rank") <= limit)
        made = ranked if made is None else made.unionByName(ranked)
    return made.select(F.col("q").alias(query_key), F.col("k").alias(key), "distance", "rank")


def ordered_lookup(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of the wanted keys in the order asked for; keys asked twice come twice, unknown ones not at all."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(wanted)], f"position int, `{key}` {kind}")
    return rows.join(F.broadcast(asked), key).orderBy("position")  # as many rows as the caller listed


def context_parts(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """hits (rank, chunk_id, document_id, section_path, content) with the header of each: (rank, part)."""
    titles = documents.select("document_id", fn.shown_title(F.col("title")).alias("title"))
    joined = hits.join(titles, "document_id")
    header = fn.source_header(F.col("title"), F.col("section_path"))
    return joined.select("rank", "chunk_id", F.concat(header, F.lit("\n"), F.col("content"), F.lit("\n")).alias("part"))


def fold_context(parts: list[tuple[int, str, str]], budget: int) -> str:
    """Parts in rank order that fit the budget, one after another. A part that doesn't fit is passed over, not the end."""
    out, used, seen = [], 0, set()
    for _, key, part in sorted(parts, key=lambda p: p[0]):
        if used >= budget:
            break
        if key in seen:
            continue
        seen.add(key)
        cost = count_tokens(part)
        if used + cost <= budget:
            out.append(part)
            used += cost
    return "\n".join(out)


class NoopIndex:
    """An index that stores nothing and finds nothing, for embedders without vectors of use."""

    def __init__(self, spark):
        self.spark = spark

    def add(self, *_) -> None:
        pass

    remove = clear = save = load = add

    def search(self, *_) -> DataFrame:
        return self.spark.createDataFrame([], "chunk_id string, distance double, rank int")
