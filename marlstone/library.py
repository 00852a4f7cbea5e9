"""The library: ingest sources, ask, build contexts, render, remove, rebuild."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone import errors
from marlstone.emitters import html as html_emitter
from marlstone.emitters import markdown as markdown_emitter
from marlstone.emitters import text as text_emitter
from marlstone.functions import text as fn
from marlstone.ir import tree
from marlstone.operators import chunking, documents, retrieval
from marlstone.operators.embedding import Embedder, check_batch, embed_table, space_of
from marlstone.sources import files, net
from marlstone.storage.store import Store
from marlstone.tables import cut


def emitter(format_: str) -> Callable[[dict], str]:
    made = {"markdown": markdown_emitter.emit, "html": html_emitter.emit, "text": text_emitter.emit}.get(format_)
    if made is None:
        raise errors.InvalidInput(errors.unsupported_format(format_))
    return made


def hash_id(*parts) -> Column:
    """An id in the form of a UUID that depends on nothing but its parts, so that repeated tasks agree."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


DERIVED = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "frontmatter", "fault", "doc_json")] + [T.StructField("chunks", documents.CHUNK)])


class Library:
    def __init__(self, spark: SparkSession, store: Store, embedder: Embedder, budget: int = chunking.DEFAULT_BUDGET, callouts: bool = False):
        self.spark, self.store, self.embedder, self.budget, self.callouts = spark, store, embedder, budget, callouts
        self.space = space_of(embedder)
        store.check_space(self.space)

    # Ingest

    def fingerprint(self, format_: Column) -> Column:
        return fn.processing_fingerprint(format_, self.space.fingerprint, self.space.dimension, chunking.VERSION, self.budget, self.callouts)

    def decide(self, sources: DataFrame) -> DataFrame:
        """sources with content_hash, processing_fingerprint, document_id and decision: skip, reprocess, insert or error.

        Known before anything is parsed. Of sources of equal content in one table the last by raw_source is taken; which one
        that is, hashes and names alone decide.
        """
        rows = sources.withColumn("content_hash", fn.content_hash(F.col("content"))).withColumn("processing_fingerprint", self.fingerprint(F.col("source_format")))
        fine = F.col("error").isNull() & F.col("content").isNotNull()
        last = rows.where(fine).groupBy("content_hash").agg(F.max(F.struct("raw_source", "source_format")).alias("last"))
        chosen = rows.where(fine).join(last, "content_hash").where(F.struct("raw_source", "source_format").eqNullSafe(F.col("last"))).drop("last")
        chosen = chosen.dropDuplicates(["content_hash"])  # rows alike in every column
        rows = chosen.unionByName(rows.where(~fine).select(*chosen.columns))
        known = self.store.table("documents").select("content_hash", F.col("document_id").alias("known_id"), F.col("processing_fingerprint").alias("known_fp"))
        joined = rows.join(known, "content_hash", "left")
        decision = (
            F.when(F.col("error").isNotNull() | F.col("content").isNull(), "error")
            .when(F.col("known_id").isNull(), "insert")
            .when(F.col("known_fp") == F.col("processing_fingerprint"), "skip")
            .otherwise("reprocess")
        )
        return joined.select("*", decision.alias("decision"), F.coalesce("known_id", hash_id(F.col("content_hash"))).alias("document_id")).drop("known_id", "known_fp")

    def ingest_table(self, sources: DataFrame, ingested_at: datetime | None = None) -> DataFrame:
        """Ingests (raw_source, source_format, content, error) and gives (raw_source, document_id, decision, error).

        All is derived before anything is written, in one parse. Bad documents are rows with an error and don't stop the
        others. The result stays on the executors, a row for each source.
        """
        at = F.lit(ingested_at or datetime.now(timezone.utc).replace(tzinfo=None))
        budget, callouts = self.budget, self.callouts

        @F.pandas_udf(DERIVED)
        def derive(contents: pd.Series, formats: pd.Series, ids: pd.Series) -> pd.DataFrame:
            rows = []
            for c, f, i in zip(contents, formats, ids):
                if c is None:
                    rows.append((None, None, None, None, None))
                    continue
                d = documents.read(c, f, callouts=callouts)
                made = None, []
                if d["error"] is None:
                    meta = {"id": i, "title": d["title"], "format": f, "frontmatter": d["frontmatter"] and {"yaml": d["frontmatter"]}}
                    made = tree.dumps(d, meta), chunking.chunk(d, budget)
                rows.append((d["title"], d["frontmatter"], d["error"], *made))
            return pd.DataFrame(rows, columns=["title", "frontmatter", "fault", "doc_json", "chunks"])

        decided = self.decide(sources)
        work = F.col("decision").isin("insert", "reprocess")
        columns = ["raw_source", "source_format", "content_hash", "processing_fingerprint", "document_id", "decision", "error"]
        read = derive(F.when(work, F.col("content")), "source_format", "document_id")
        # Written once to the shared folder: the tables, the result and a repeated task all read the same rows. Contents end here.
        derived = cut(decided.select(*columns, F.octet_length("content").cast("bigint").alias("source_len"), read.alias("d")))
        good = derived.where(work & F.col("d.fault").isNull())
        docs = good.select(
            "document_id", F.col("raw_source").alias("source"), "source_format", "d.title", "d.frontmatter", at.alias("ingested_at"), "content_hash", "processing_fingerprint", "source_len", "d.doc_json"
        )
        chunks = good.select("document_id", "processing_fingerprint", F.inline("d.chunks"))
        chunks = chunks.withColumn("chunk_id", hash_id(F.col("document_id"), F.col("processing_fingerprint"), F.col("sequence_index"))).drop("processing_fingerprint")
        vectors = embed_table(chunks, "content", self.embedder).select("chunk_id", "document_id", F.lit(self.space.dimension).alias("dimension"), "vector")
        if not good.isEmpty():
            self.store.replace(docs, chunks, vectors, self.space)
        fault = F.when(F.col("d.fault").isNotNull(), F.concat(F.lit("invalid input: "), F.col("d.fault"))).when(
            F.col("decision") == "error", F.coalesce("error", F.lit("invalid input: source has no content"))
        )
        decision = F.when(F.col("d.fault").isNotNull(), "error").otherwise(F.col("decision"))
        return derived.select("raw_source", "document_id", decision.alias("decision"), fault.alias("error"))

    def _one(self, raw_source: str, format_: str, content: str) -> str:
        rows = self.spark.createDataFrame([(raw_source, format_, content, None)], "raw_source string, source_format string, content string, error string")
        row = self.ingest_table(rows).first()
        if row["error"]:
            raise errors.InvalidInput(row["error"].removeprefix("invalid input: "))
        return row["document_id"]

    def ingest_file(self, path: str) -> str:
        content, format_ = files.read_one(path)
        return self._one(path, format_, content)

    def ingest_markdown(self, content: str) -> str:
        return self._one(files.RAW_MARKDOWN, "Markdown", content)

    def ingest_html(self, content: str) -> str:
        return self._one(files.RAW_HTML, "Html", content)

    def ingest_url(self, url: str, allow_private: bool = False) -> str:
        found = net.fetch(url, allow_private)
        row = self.spark.createDataFrame([(found.content_type, found.final_url, found.body)], "t string, u string, b string")
        kind = row.select(fn.detect_format(F.col("t"), fn.url_extension(F.col("u")), F.col("b"))["kind"]).first()[0]
        return self._one(found.final_url, kind, found.body)

    def ingest(self, source: str) -> str:
        return self.ingest_url(source) if source.startswith(("http://", "https://")) else self.ingest_file(source)

    # Questions

    def query(self, text: str, limit: int = 10) -> DataFrame:
        """Chunks by rising distance, with it. Limit 0 and an empty or cleared index give none and ask no embedder."""
        chunks = self.store.table("chunks")
        if limit <= 0 or not self.store.open_index(self.space):
            return chunks.withColumn("distance", F.lit(0.0)).withColumn("rank", F.lit(0)).limit(0)
        vectors = self.embedder.embed([text])
        check_batch(vectors, 1, self.space.dimension)
        hits = retrieval.search(self.store.embeddings(), "chunk_id", "vector", vectors[0], limit)
        return chunks.join(F.broadcast(hits), "chunk_id").orderBy("rank")  # limit rows

    def context_window(self, text: str, budget: int = 2048) -> str:
        parts = retrieval.context_parts(self.query(text, retrieval.CANDIDATES), self.store.table("documents"))
        return retrieval.fold_context([(r["rank"], r["chunk_id"], r["part"]) for r in parts.collect()], budget)  # CANDIDATES rows

    def emit(self, document_id: str, format_: str) -> str:
        return emitter(format_)(tree.loads(self.store.document(document_id)["doc_json"]))

    def list(self) -> DataFrame:
        return self.store.documents()

    def info(self, document_id: str) -> dict:
        row = self.store.document(document_id)
        row.pop("doc_json")
        return row | {"chunk_count": self.store.chunks_of(document_id).count()}

    def remove(self, document_id: str) -> None:
        self.store.remove(document_id)

    def clear_index(self) -> None:
        self.store.clear_index()

    def rebuild_index(self) -> int:
        self.store.check_space(self.space)
        return self.store.rebuild()


def document_id(content: str) -> str:
    """The id that new content gets, for a driver without Spark."""
    digest = hashlib.sha256(hashlib.sha256(content.encode()).hexdigest().encode()).hexdigest()
    return "-".join((digest[:8], digest[8:12], digest[12:16], digest[16:20], digest[20:32]))
