"""The pN_ queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.tokens import PATTERN
from marlstone.llm import boundaries, bpe, furniture, markup, mixing, mojibake, neardup, packing, vectors
from marlstone.tables import cut, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def budget(spark: SparkSession, folder: str, profile: str) -> tuple[int, int]:
    """(token budget, overlap) of a profile; the table has a row for each profile."""
    row = table(spark, folder, "chunk_budgets").where(F.col("profile") == profile).first()
    return row["token_budget"], row["overlap_tokens"]


# 1: containers


@query
def p1_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk, in whole or in pieces, with its container of the context budget."""
    return packing.pack(table(spark, folder, "chunks"), "chunk_id", "content", budget(spark, folder, "context")[0])


@query
def p1_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are: their number, all tokens, and the share of room used."""
    capacity = budget(spark, folder, "context")[0]
    bins = p1_containers(spark, folder).groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return bins.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.max("tokens").alias("fullest"),
        (F.sum("tokens") / (F.count("*") * F.lit(capacity))).alias("used"),
    )


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that packing had to cut."""
    return p1_containers(spark, folder).where("pieces > 1").select("chunk_id").distinct()


# 3: pieces


@query
def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk as ordered pieces within the split budget."""
    tokens, overlap = budget(spark, folder, "split")
    return boundaries.split_oversized(table(spark, folder, "chunks"), "chunk_id", "content", tokens, overlap, ("section_path",))


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of more than one piece."""
    return p3_pieces(spark, folder).where("pieces > 1").select("chunk_id").distinct()


def _over(tokens: int) -> str:
    return f"SELECT DISTINCT chunk_id FROM chunks WHERE len(regexp_extract_all(content, '{PATTERN}')) > {tokens}"


ORACLE["p1_found"] = _over(2048)
ORACLE["p3_found"] = _over(512)


# 7: token ids


@query
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encode(table(spark, folder, "documents"), ("doc_id",), "text")


# 2: markup


@query
def p2_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk as clean text, with the kinds of markup found. Code chunks pass as they are."""
    prose = F.col("block_type").isin("Prose", "Table")
    return markup.clean_texts(table(spark, folder, "chunks"), ("chunk_id", "block_type", "sequence_index"), "content", prose)


@query
def p2_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every fetched body as the text a browser would show."""
    return markup.clean_pages(table(spark, folder, "fetched"), ("fetch_id", "kind"), "body", "kind")


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks in which rendering met markup."""
    return p2_chunks(spark, folder).where(F.size("markup") > 0).select("chunk_id").distinct()


# 5: page furniture


def site(url) -> Column:
    """The host of an address, or the collection in a path such as /srv/<collection>/page.md."""
    host = F.regexp_extract(url, r"^[a-z]+://([^/]+)", 1)
    return F.when(host != "", host).otherwise(F.regexp_extract(url, r"^/[^/]+/([^/]+)/", 1))


@query
def p5_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The top-level blocks of stored trees that are furniture, why, on how many articles of the site they recur, and the odds."""
    host = site(F.col("raw_source"))
    # Raw sources have no address; they belong to their collection.
    host = F.when(host != "", host).otherwise(F.lower(F.trim("source")))
    rendered = ~F.col("source_format").eqNullSafe("Markdown")
    return furniture.tree_furniture(table(spark, folder, "documents"), "doc_id", "doc_json", host, F.lower("content_hash"), rendered)


@query
def p5_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every fetched HTML page."""
    pages = table(spark, folder, "fetched").where("kind = 'Html'")
    url = F.coalesce("final_url", "url")
    return furniture.main_bodies(pages, "fetch_id", "body", site(url), url)


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_blocks(spark, folder).select("doc_id", "block_index").distinct()


# 4: near-duplicates


def _alike(spark: SparkSession, folder: str) -> neardup.Groups:
    """Prose chunks of 60 words or more, by runs of three words, half of them common. A chunk without a document stands for
    a document of its own."""
    documents = table(spark, folder, "documents").select("document_id", F.lower("content_hash").alias("hash"))
    documents = documents.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.min("hash").alias("hash"))
    chunks = table(spark, folder, "chunks").where("block_type = 'Prose'").select("chunk_id", "document_id", "content")
    found = neardup.Groups(chunks, "chunk_id", "content", neardup.Sketch(shingle=3), 0.5, 60, ("document_id",))
    found.members = (
        found.members.join(documents, "document_id", "left")
        .withColumn("document_id", F.coalesce("document_id", "key"))
        .withColumn("hash", F.coalesce("hash", "document_id"))
    )
    return found


@query
def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every Prose chunk of 60 words or more with its class of equal words, its group and its number of links."""
    return _alike(spark, folder).groups().withColumnRenamed("key", "chunk_id")


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of different documents that are alike."""
    alike = _alike(spark, folder)
    members = cut(alike.members.select("class", "key", "document_id", "hash"))
    x = members.select(F.col("class").alias("a"), *[F.col(c).alias(f"{c}_x") for c in ("key", "document_id", "hash")])
    y = members.select(F.col("class").alias("b"), *[F.col(c).alias(f"{c}_y") for c in ("key", "document_id", "hash")])
    apart = "document_id_x <> document_id_y AND hash_x <> hash_y"
    between = alike.pairs.select("a", "b").join(x, "a").join(y, "b").where(apart)
    within = x.join(y.withColumnRenamed("b", "a"), "a").where(f"key_x < key_y AND {apart}")
    pairs = between.select("key_x", "key_y").unionByName(within.select("key_x", "key_y"))
    return pairs.select(F.least("key_x", "key_y").alias("chunk_id_a"), F.greatest("key_x", "key_y").alias("chunk_id_b")).distinct()


ORACLE["p4_found"] = r"""WITH c AS (SELECT DISTINCT chunk_id, document_id, content FROM chunks WHERE block_type = 'Prose' AND content IS NOT NULL AND chunk_id IS NOT NULL),
    w AS (SELECT chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS l FROM c),
    s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) AS g FROM w WHERE len(l) >= 60),
    n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id),
    p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.chunk_id < b.chunk_id GROUP BY ALL),
    h AS (SELECT document_id, min(lower(content_hash)) AS h FROM documents WHERE document_id IS NOT NULL GROUP BY document_id),
    d AS (SELECT DISTINCT chunk_id, coalesce(c.document_id, chunk_id) AS d, coalesce(h, c.document_id, chunk_id) AS h FROM c LEFT JOIN h USING (document_id))
    SELECT DISTINCT a AS chunk_id_a, b AS chunk_id_b FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b JOIN d u ON u.chunk_id = a JOIN d v ON v.chunk_id = b
    WHERE k >= 0.5 * (x.n + y.n - k) AND u.d <> v.d AND u.h <> v.h"""


# 6: similar vectors


@query
def p6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 most similar vectors of every valid vector."""
    return vectors.neighbours(table(spark, folder, "chunk_embeddings"), "chunk_id", "dimension", "vector_json", 10)


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that have each other among their 10 most similar, with cosine of 0.95 or more."""
    near = vectors.neighbours(table(spark, folder, "chunk_embeddings"), "chunk_id", "dimension", "vector_json", 10, 0.95 - 1e-9)
    pair = near.select(F.least("chunk_id", "neighbour").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b"))
    return pair.groupBy("chunk_id_a", "chunk_id_b").agg(F.count("*").alias("n")).where("n = 2").drop("n")


ORACLE["p6_found"] = r"""WITH t AS (SELECT chunk_id, dimension, TRY_CAST(vector_json AS DOUBLE[]) AS v FROM chunk_embeddings
    WHERE regexp_full_match(vector_json, '\s*\[[\s0-9eE+.,-]*\]\s*') AND json_valid(vector_json)),
    u AS (SELECT chunk_id, dimension, any_value(v) AS v FROM t WHERE len(v) = dimension AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY chunk_id, dimension),
    e AS (SELECT chunk_id, dimension, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u),
    p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_dot_product(a.v, b.v) AS c FROM e a JOIN e b ON a.dimension = b.dimension AND a.chunk_id <> b.chunk_id),
    r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS r FROM p WHERE c >= 0.95 - 1e-9)
    SELECT x.a AS chunk_id_a, x.b AS chunk_id_b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.r <= 10 AND y.r <= 10"""


# 8: mixture


@query
def p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


@query
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all tokens that each source has in the mixture, beside its target."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


# 9: garbled text


@query
def p9_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document: whether its text is garbled, the codes found, the restored text. Code spans of pages, which their
    text no longer marks, are read from the stored tree."""
    documents = table(spark, folder, "documents")
    # Escaped quotes and backslashes stand aside, so that the pattern is one class of characters, whatever the length.
    hidden = F.replace(F.replace("doc_json", F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    code = F.transform(
        F.regexp_extract_all(hidden, F.lit(r'"Code":"([^"]+)"'), F.lit(1)),
        lambda c: F.replace(F.replace(c, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\")),
    )
    return mojibake.restore(documents, "doc_id", "text", F.when(F.col("source_format") == "Html", code))


@query
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_texts(spark, folder).where("garbled").select("doc_id").distinct()
