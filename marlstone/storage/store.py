"""A store of Parquet generations behind one manifest.

A write adds a generation of the rows that are new and the ids of the documents they replace or remove, then replaces the
manifest, so readers see all of a change or none. A row counts if no later generation removed its document. Generations of
like size are merged, so that their number stays small and a row is written again only a few times. Vectors are in the
generation of their chunks. The index is a small record of its own that says for which state of the vectors it was made; it
can be lost, damaged or cleared, and made again from the store.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.errors import ConsistencyError, EmbeddingSpaceMismatch, StorageError, VectorIndexError
from marlstone.operators.embedding import EmbeddingSpace
from marlstone.operators.retrieval import valid_vector
from marlstone.storage.shared import Folder

VERSION = 4
INDEX_VERSION = 2
MANIFEST, INDEX = "manifest.json", "index.json"
#: So many generations are never merged.
FEW = 4
SCHEMAS = {
    "documents": "document_id string, source string, source_format string, title string, frontmatter string, ingested_at timestamp,"
    " content_hash string, processing_fingerprint string, source_len bigint, doc_json string",
    "chunks": "chunk_id string, document_id string, section_path array<string>, content string, block_type string, sequence_index bigint, token_count bigint",
    "chunk_embeddings": "chunk_id string, document_id string, dimension int, vector array<float>",
}
REMOVED = "removed"
REPAIR = "; rebuild the index from the store (rebuild-index)"


@dataclass
class Manifest:
    version: int
    generation: str
    embedding_space_fingerprint: str | None = None
    embedding_dimension: int | None = None
    documents: int = 0
    chunks: int = 0
    entry_count: int = 0
    #: Number of the last write, [number, rows] of the generations there are, and numbers of writes that removed something.
    seq: int = 0
    generations: list[list[int]] = field(default_factory=list)
    removals: list[int] = field(default_factory=list)
    #: Generations that are merged, kept for those who still read them.
    retired: list[int] = field(default_factory=list)

    def space(self) -> EmbeddingSpace | None:
        """None if unbound. A half-bound store is damaged."""
        if (self.embedding_space_fingerprint is None) != (self.embedding_dimension is None):
            raise ConsistencyError("embedding space is only partly recorded")
        return None if self.embedding_dimension is None else EmbeddingSpace(self.embedding_space_fingerprint, self.embedding_dimension)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        if not self.folder.exists(MANIFEST):
            self._commit(Manifest(VERSION, uuid.uuid4().hex))

    # Manifest

    def manifest(self) -> Manifest:
        try:
            return Manifest(**self._migrated(json.loads(self.folder.read(MANIFEST))))
        except (ValueError, TypeError, AttributeError, Py4JJavaError) as e:
            raise StorageError(f"manifest of {self.folder.root}: {e}") from None

    @staticmethod
    def _migrated(data: dict) -> dict:
        """Older manifests gain what they lack; newer ones are refused."""
        version = data.get("version", 0)
        if version > VERSION:
            raise ValueError(f"version {version} is newer than {VERSION}")
        return data | {"version": VERSION}

    def _commit(self, made: Manifest, before: Manifest | None = None) -> None:
        """The index follows every change of the vectors, unless it is lost, damaged or cleared: that only a rebuild ends."""
        index = self._index_or_none() or {}
        whole = before is None or not index.get("cleared") and index.get("generation") == before.generation and index.get("entry_count") == before.entry_count
        self.folder.write(MANIFEST, json.dumps(asdict(made)))
        if whole:
            self._write_index(made)

    def _write_index(self, m: Manifest, cleared: bool = False) -> None:
        record = {"version": INDEX_VERSION, "generation": m.generation, "embedding_space_fingerprint": m.embedding_space_fingerprint, "embedding_dimension": m.embedding_dimension}
        self.folder.write(INDEX, json.dumps(record | {"entry_count": 0 if cleared else m.entry_count, "cleared": cleared}))

    def _index_or_none(self) -> dict | None:
        try:
            found = json.loads(self.folder.read(INDEX))
            return found if isinstance(found, dict) else None
        except (ValueError, Py4JJavaError):
            return None

    def space(self) -> EmbeddingSpace | None:
        return self.manifest().space()

    # Reads

    def _rows(self, name: str, m: Manifest, numbers: list[int], after: int = 0) -> DataFrame:
        """Rows of these generations that no later one removed, with the number of theirs."""
        schema = f"{SCHEMAS[name]}, seq int"
        if not numbers:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.folder.name(name)).parquet(*[self.folder.name(f"{name}/seq={n}") for n in numbers])
        later = [n for n in m.removals if n > min(numbers)]
        if not later:
            return rows
        removed = self.spark.read.schema("document_id string, seq int").option("basePath", self.folder.name(REMOVED)).parquet(*[self.folder.name(f"{REMOVED}/seq={n}") for n in later])
        gone = removed.groupBy("document_id").agg(F.max("seq").alias("gone"))
        return rows.join(gone, "document_id", "left").where("gone IS NULL OR gone <= seq").select(*rows.columns)

    def table(self, name: str) -> DataFrame:
        m = self.manifest()
        return self._rows(name, m, [n for n, _ in m.generations]).drop("seq")

    def documents(self) -> DataFrame:
        return self.table("documents").drop("doc_json").orderBy("ingested_at", "document_id")

    def document(self, document_id: str) -> dict:
        row = self.table("documents").where(F.col("document_id") == document_id).first()
        if row is None:
            raise StorageError(f"document not found: {document_id}")
        return row.asDict()

    def chunks(self) -> DataFrame:
        return self.table("chunks")

    def infos(self) -> DataFrame:
        """documents() with chunk_count. Chunks are counted before the join, so that a document of many chunks is one row in it."""
        counts = self.chunks().groupBy("document_id").agg(F.count("*").alias("chunk_count"))
        rows = self.table("documents").drop("doc_json").join(counts, "document_id", "left")
        return rows.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))

    def chunks_of(self, document_id: str) -> DataFrame:
        return self.chunks().where(F.col("document_id") == document_id).orderBy("sequence_index")

    def embeddings(self) -> DataFrame:
        return self.table("chunk_embeddings").select("chunk_id", "vector")

    def has_embeddings(self) -> bool:
        return not self.table("chunk_embeddings").isEmpty()

    def find_by_content_hash(self, content_hash: str) -> str | None:
        row = self.table("documents").where(F.col("content_hash") == content_hash).first()
        return row and row["document_id"]

    # Writes

    def check_space(self, space: EmbeddingSpace) -> None:
        """The first write binds; later ones must match. Vectors of an unknown space can't be added to."""
        bound = self.space()
        if bound is None:
            if self.has_embeddings():
                raise EmbeddingSpaceMismatch("store holds embeddings of an unidentified space")
        elif bound != space:
            raise EmbeddingSpaceMismatch(f"store is bound to {bound.fingerprint} ({bound.dimension}), got {space.fingerprint} ({space.dimension})")

    def _write(self, tables: dict[str, DataFrame], number: int) -> dict[str, DataFrame]:
        for name, frame in tables.items():
            columns = ["document_id"] if name == REMOVED else [f.split()[0] for f in SCHEMAS[name].split(", ")]
            frame.select(*columns).write.mode("overwrite").parquet(self.folder.name(f"{name}/seq={number}"))
        return {n: self.spark.read.schema("document_id string" if n == REMOVED else SCHEMAS[n]).parquet(self.folder.name(f"{n}/seq={number}")) for n in tables}

    def _drop(self, number: int) -> None:
        for name in (*SCHEMAS, REMOVED):
            self.folder.delete(f"{name}/seq={number}")

    def replace(self, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, space: EmbeddingSpace) -> None:
        """Replaces whole documents with their chunks and vectors; others stay and are not written again."""
        self.check_space(space)
        m = self.manifest()
        number = m.seq + 1
        made = self._write({"documents": documents, "chunks": chunks, "chunk_embeddings": embeddings}, number)
        fault = projection_faults(made["documents"], made["chunks"], made["chunk_embeddings"], space.dimension).first()
        if fault is not None:
            self._drop(number)
            raise ConsistencyError(f"document {fault['document_id']}: {fault['fault']}")
        counts = {n: made[n].count() for n in SCHEMAS}
        self._append(m, number, made["documents"].select("document_id").distinct(), counts, space)

    def remove(self, document_id: str) -> None:
        """With its chunks and vectors; an unknown id changes nothing."""
        found = self.table("documents").where(F.col("document_id") == document_id).select("document_id").distinct()
        if not found.isEmpty():
            self.remove_all(found)

    def remove_all(self, ids: DataFrame) -> None:
        """Documents of a table of document_id, each once, with their chunks and vectors. Unknown ids change nothing."""
        m = self.manifest()
        self._append(m, m.seq + 1, ids, dict.fromkeys(SCHEMAS, 0), m.space())

    def _append(self, m: Manifest, number: int, ids: DataFrame, counts: dict[str, int], space: EmbeddingSpace | None) -> None:
        held = [n for n, _ in m.generations]
        lost = {n: self._rows(n, m, held).join(ids, "document_id", "left_semi").count() if held else 0 for n in SCHEMAS}
        if any(lost.values()):
            self._write({REMOVED: ids}, number)
        made = Manifest(
            VERSION, uuid.uuid4().hex, space and space.fingerprint, space and space.dimension,
            m.documents + counts["documents"] - lost["documents"], m.chunks + counts["chunks"] - lost["chunks"], m.entry_count + counts["chunk_embeddings"] - lost["chunk_embeddings"],
            number, m.generations + ([[number, sum(counts.values())]] if any(counts.values()) else []), m.removals + ([number] if any(lost.values()) else []), m.retired,
        )
        if self.manifest().seq != m.seq:
            self._drop(number)
            raise ConsistencyError("another writer changed the store; nothing was written")
        self._commit(made, m)
        self._merge(made)

    def _merge(self, m: Manifest) -> None:
        """Joins the last generations while each is at least half as large as the one before it."""
        last = len(m.generations)
        if last <= FEW:
            return
        first, rows = last - 1, m.generations[-1][1]
        while first > 0 and rows * 2 >= m.generations[first - 1][1]:
            first -= 1
            rows += m.generations[first][1]
        if first < last - 1:
            self._join(m, first)

    def compact(self) -> None:
        """All generations become one, and what was removed is gone."""
        m = self.manifest()
        if len(m.generations) > 1 or m.removals:
            self._join(m, 0)

    def _join(self, m: Manifest, first: int) -> None:
        old, number = [n for n, _ in m.generations[first:]], m.seq + 1
        made = self._write({n: self._rows(n, m, old) for n in SCHEMAS}, number)
        rows = sum(made[n].count() for n in SCHEMAS)
        self.folder.write(MANIFEST, json.dumps(asdict(m) | {"seq": number, "generations": m.generations[:first] + [[number, rows]], "removals": m.removals if first else [], "retired": old + ([] if first else m.removals)}))
        for n in m.retired:
            self._drop(n)

    # Index

    def open_index(self, space: EmbeddingSpace | None = None) -> bool:
        """Whether there is anything to search. VectorIndexError if the record is lost, damaged or of another state."""
        m = self.manifest()
        if not self.folder.exists(INDEX):
            raise VectorIndexError(f"index of {self.folder.root} is missing{REPAIR}")
        index = self._index_or_none()
        if index is None:
            raise VectorIndexError(f"index of {self.folder.root} is not readable{REPAIR}")
        if index.get("version") != INDEX_VERSION:
            raise VectorIndexError(f"index version {index.get('version')} is not supported (expected {INDEX_VERSION}){REPAIR}")
        held = EmbeddingSpace(index.get("embedding_space_fingerprint"), index.get("embedding_dimension"))
        expected = space or m.space()
        if index.get("embedding_dimension") is not None and expected is not None and held != expected:
            raise EmbeddingSpaceMismatch(f"index holds vectors of {held.fingerprint} ({held.dimension}), not of {expected.fingerprint} ({expected.dimension}); a rebuild can't convert them")
        if index.get("cleared"):
            return False
        if index.get("generation") != m.generation:
            raise VectorIndexError(f"index was made for generation {index.get('generation')}, the store has {m.generation}{REPAIR}")
        if index.get("entry_count") != m.entry_count:
            raise VectorIndexError(f"index holds {index.get('entry_count')} vectors, manifest says {m.entry_count}{REPAIR}")
        return m.entry_count > 0

    def clear_index(self) -> None:
        """Nothing is found any more until the index is rebuilt; the stored vectors stay."""
        self._write_index(self.manifest(), True)

    def rebuild(self) -> int:
        """Makes the index again from the stored vectors, whatever is left of it, and gives their number."""
        m = self.manifest()
        m.entry_count = self.table("chunk_embeddings").count()
        m.generation = uuid.uuid4().hex
        self.folder.write(MANIFEST, json.dumps(asdict(m)))
        self._write_index(m)
        self.check_index()
        return m.entry_count

    def check_index(self) -> None:
        """VectorIndexError unless record and vectors are whole: count, unique ids, dimension, chunks that exist."""
        m, vectors = self.manifest(), self.table("chunk_embeddings")
        dimension = m.embedding_dimension or 0
        found = vectors.agg(
            F.count("*").alias("n"),
            F.count_distinct("chunk_id").alias("ids"),
            F.coalesce(F.sum((~valid_vector(F.col("vector"), dimension)).cast("int")), F.lit(0)).alias("bad"),
        ).first()
        orphans = vectors.join(self.table("chunks"), "chunk_id", "left_anti").count()
        for wrong, what in (
            (found["n"] != m.entry_count, f"holds {found['n']} vectors, manifest says {m.entry_count}"),
            (found["ids"] != found["n"], "has a chunk twice"),
            (found["bad"], f"has {found['bad']} vectors that are not {dimension} finite numbers"),
            (orphans, f"has {orphans} vectors without chunks"),
        ):
            if wrong:
                raise VectorIndexError(f"index {what}")
        self.open_index()


def projection_faults(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, dimension: int) -> DataFrame:
    """(document_id, fault) of documents whose chunks and vectors don't belong together."""
    order = chunks.groupBy("document_id").agg(
        F.count("*").alias("n"), F.count_distinct("sequence_index").alias("places"), F.min("sequence_index").alias("first"), F.max("sequence_index").alias("last")
    )
    valid = valid_vector(F.col("vector"), dimension)
    held = embeddings.groupBy("document_id").agg(F.count("*").alias("vectors"), F.sum((~F.coalesce(valid, F.lit(False))).cast("int")).alias("bad"))
    known = documents.select("document_id", F.lit(True).alias("known"))
    both = order.join(held, "document_id", "full").join(known, "document_id", "left")
    fault = (
        F.when(F.col("known").isNull(), "chunk of another document")
        .when(F.coalesce("n", F.lit(0)) != F.coalesce("vectors", F.lit(0)), "chunks and vectors differ in number")
        .when(F.col("places") != F.col("n"), "sequence index twice")
        .when((F.col("first") != 0) | (F.col("last") != F.col("n") - 1), "sequence is not contiguous from 0")
        .when(F.col("bad") > 0, "vector of wrong dimension or not finite")
    )
    return both.select("document_id", fault.alias("fault")).where("fault IS NOT NULL")
