import json

import pytest
from pyspark.sql import functions as F

from marlstone import errors
from marlstone.library import Library, document_id
from marlstone.operators import retrieval
from marlstone.operators.embedding import EmbeddingSpace, HashEmbedder, NoopEmbedder, check_batch, in_order, space_of
from marlstone.storage import store as store_module
from marlstone.storage.store import Store

NOTE = "# Garden\n\n## Apples\n\nprune the apple trees in winter\n\n## Bees\n\nkeep the bees near clover\n\n## Wells\n\nthe well water is cold"


@pytest.fixture
def library(spark, tmp_path):
    return Library(spark, Store(spark, str(tmp_path / "s")), HashEmbedder(64))


def test_end_to_end(library):
    first = library.ingest_markdown(NOTE)
    assert first == document_id(NOTE) == library.ingest_markdown(NOTE)
    top = library.query("where are the bees and the clover", 1).collect()
    assert top[0]["section_path"] == ["Garden", "Bees"] and top[0]["rank"] == 1
    assert library.query("x", 0).count() == 0
    window = library.context_window("bees clover", 60)
    assert window.startswith("[Source: Garden > Bees]\nkeep the bees")
    assert library.context_window("bees", 1) == ""
    assert library.info(first)["chunk_count"] == 3 and library.list().count() == 1
    assert library.emit(first, "markdown") == NOTE
    assert library.emit(first, "text").startswith("GARDEN\n\nAPPLES") and library.emit(first, "html").startswith("<h1>")
    with pytest.raises(errors.InvalidInput, match="unsupported format 'pdf'"):
        library.emit(first, "pdf")
    assert library.rebuild_index() == 3 == library.rebuild_index()
    # The same bytes in another format: the same document, ingested again.
    assert library.ingest_html(NOTE) == first and library.info(first)["source_format"] == "Html"
    library.remove(first)
    library.remove(first)
    assert library.list().count() == 0 and library.query("bees").count() == 0
    with pytest.raises(errors.StorageError, match="not found"):
        library.emit(first, "text")


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_only_new_rows_are_written(library, spark, tmp_path):
    path = tmp_path / "s"
    ids = [library.ingest_markdown(f"# T{i}\n\ntext {i}") for i in range(3)]
    before = files_of(path)
    ids.append(library.ingest_markdown("# New\n\nwords"))
    after = files_of(path)
    assert before.items() <= after.items()
    added = [n for n in after.keys() - before.keys() if n.startswith("documents")]
    assert sum(spark.read.parquet(str(path / n)).count() for n in added) == 1
    assert library.ingest_markdown("# New\n\nwords") == ids[3] and files_of(path) == after
    # A document that is replaced or removed leaves the others' files as they are, too.
    library.remove(ids[0])
    assert library.ingest_html("# T1\n\ntext 1") == ids[1]
    assert after.items() <= files_of(path).items()
    assert {r["document_id"] for r in library.list().collect()} == set(ids[1:])
    m = library.store.manifest()
    assert (m.documents, m.chunks, m.entry_count) == (3, library.store.table("chunks").count(), library.store.table("chunk_embeddings").count())
    library.store.check_index()
    # Many writes leave few generations.
    for i in range(6):
        library.ingest_markdown(f"more {i}")
    m = library.store.manifest()
    assert len(m.generations) <= 7 and m.documents == 9 == library.list().count()
    library.store.compact()
    m = library.store.manifest()
    assert len(m.generations) == 1 and not m.removals and library.list().count() == 9 and library.query("more", 3).count() == 3
    library.store.check_index()


def test_index_is_made_again(library, tmp_path):
    """Whatever is left of it."""
    index = tmp_path / "s" / "index.json"
    library.ingest_markdown(NOTE)
    whole = index.read_text()
    for damaged in (b"\x00corrupted\xff", b"[]", None):
        if damaged is None:
            index.unlink()
        else:
            index.write_bytes(damaged)
        with pytest.raises(errors.VectorIndexError, match="rebuild-index"):
            library.query("bees")
        library.ingest_markdown(f"a note {damaged}")  # the store still takes documents
        with pytest.raises(errors.VectorIndexError, match="rebuild-index"):
            library.query("bees")
        assert library.rebuild_index() == library.store.manifest().entry_count
        assert library.query("clover bees", 1).first()["section_path"] == ["Garden", "Bees"]
    good = json.loads(index.read_text())
    for change, kind in (
        ({"version": 1}, errors.VectorIndexError),
        ({"generation": "other"}, errors.VectorIndexError),
        ({"entry_count": 1}, errors.VectorIndexError),
        ({"embedding_space_fingerprint": "other"}, errors.EmbeddingSpaceMismatch),
        ({"embedding_dimension": 3}, errors.EmbeddingSpaceMismatch),
    ):
        index.write_text(json.dumps(good | change))
        with pytest.raises(kind):
            library.query("bees")
    assert json.loads(whole)["version"] == good["version"]
    library.clear_index()
    assert library.query("bees").count() == 0 and library.list().count() > 0
    assert library.rebuild_index() > 0 and library.query("bees", 1).count() == 1
    assert retrieval.NoopIndex(library.spark).search([1.0], 3).count() == 0


def test_callouts_are_stored(spark, tmp_path):
    source = "[!tip] Heads up\nsecond line"
    plain = Library(spark, Store(spark, str(tmp_path / "a")), HashEmbedder(16))
    made = Library(spark, Store(spark, str(tmp_path / "b")), HashEmbedder(16), callouts=True)
    assert not plain.emit(plain.ingest_markdown(source), "markdown").startswith(">")
    assert made.emit(made.ingest_markdown(source), "markdown") == "> [!tip] Heads up\n> second line"


def test_bad_documents_do_not_stop_others(library, spark):
    rows = [("a", "Markdown", "fine", None), ("b", "Markdown", "[x]()", None), ("c", None, None, "not implemented: x"), ("d", "Markdown", "fine", None), ("e", "Markdown", None, None)]
    made = {r["raw_source"]: r for r in library.ingest_table(spark.createDataFrame(rows, "raw_source string, source_format string, content string, error string")).collect()}
    assert made["d"]["decision"] == "insert" and "a" not in made
    assert "empty url" in made["b"]["error"] and made["c"]["error"] == "not implemented: x" and made["e"]["error"]
    assert library.list().count() == 1
    with pytest.raises(errors.InvalidInput):
        library.ingest_markdown("[x]()")


def test_space_binding(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    Library(spark, store, HashEmbedder(64)).ingest_markdown("x")
    with pytest.raises(errors.EmbeddingSpaceMismatch):
        Library(spark, store, NoopEmbedder())
    path = tmp_path / "s" / "manifest.json"
    data = json.loads(path.read_text())
    path.write_text(json.dumps(data | {"embedding_dimension": None}))
    with pytest.raises(errors.ConsistencyError):
        store.space()
    path.write_text(json.dumps(data | {"embedding_dimension": None, "embedding_space_fingerprint": None}))
    with pytest.raises(errors.EmbeddingSpaceMismatch, match="unidentified"):
        Library(spark, store, HashEmbedder(64))
    path.write_text(json.dumps(data | {"entry_count": 9}))
    with pytest.raises(errors.VectorIndexError, match="manifest says 9"):
        store.check_index()
    path.write_text(json.dumps(data | {"version": 99}))
    with pytest.raises(errors.StorageError, match="newer"):
        store.manifest()
    path.write_text(json.dumps({"generation": data["generation"], "version": 1}))
    assert store.manifest().version == store_module.VERSION


@pytest.mark.parametrize(
    "chunks, vectors, word",
    [
        ([(0, "d"), (1, "x")], [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0]], "another document"),
        ([(0, "d"), (0, "d")], [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0]], "twice"),
        ([(0, "d"), (2, "d")], [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0]], "contiguous"),
        ([(0, "d"), (1, "d")], [[1.0, 0.0, 0.0]], "differ in number"),
        ([(0, "d")], [[float("nan"), 0.0, 0.0]], "not finite"),
        ([(0, "d")], [[1.0, 0.0]], "not finite"),
    ],
)
def test_projections_are_checked(spark, tmp_path, chunks, vectors, word):
    store = Store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([("d",)], "document_id string")
    for c in ("source string", "source_format string", "title string", "frontmatter string", "ingested_at timestamp", "content_hash string", "processing_fingerprint string", "source_len bigint", "doc_json string"):
        docs = docs.withColumn(c.split()[0], F.lit(None).cast(c.split()[1]))
    rows = [(f"c{i}", d, ["A"], "t", "Prose", s, 1) for i, (s, d) in enumerate(chunks)]
    made = spark.createDataFrame(rows, "chunk_id string, document_id string, section_path array<string>, content string, block_type string, sequence_index bigint, token_count bigint")
    embedded = spark.createDataFrame([(f"c{i}", chunks[i][1], 3, v) for i, v in enumerate(vectors)], "chunk_id string, document_id string, dimension int, vector array<float>")
    with pytest.raises(errors.ConsistencyError, match=word):
        store.replace(docs, made, embedded, EmbeddingSpace("s", 3))
    assert store.manifest().documents == 0


def test_embedders():
    assert in_order([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], 2, 1) == [[1.0], [2.0]]
    for data in ([{"index": 0, "embedding": [1.0]}] * 2, [{"index": 5, "embedding": [1.0]}] * 2, [{"index": 0, "embedding": [1.0]}]):
        with pytest.raises(errors.EmbeddingError):
            in_order(data, 2, 1)
    for bad in ([[1.0]], [[1.0, 2.0], [float("inf"), 1.0]], [[1.0], [1.0]]):
        with pytest.raises(errors.EmbeddingError):
            check_batch(bad, 2, 2)
    assert HashEmbedder(8).embed([" "])[0][0] == 1.0
    assert space_of(NoopEmbedder()) == EmbeddingSpace("noop-space-v1", 8)


def test_search_and_lookup(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [2.0, 0.0]), ("z", [0.0, 0.0])], "k string, v array<float>")
    found = retrieval.search(rows, "k", "v", [1.0, 0.0], 4).collect()
    assert [(r["k"], round(r["distance"], 6)) for r in found] == [("a", 0.0), ("c", 0.0), ("b", 1.0), ("z", 1.0)]
    many = retrieval.search_many(rows, "k", "v", rows.select(F.col("k").alias("q"), F.col("v").alias("qv")), "q", "qv", 1, 2).collect()
    assert {(r["q"], r["k"]) for r in many} == {("a", "c"), ("c", "a"), ("b", "a"), ("z", "a")}
    assert [r["k"] for r in retrieval.ordered_lookup(rows, "k", ["c", "a", "c", "nope"]).collect()] == ["c", "a", "c"]
    parts = [(1, "a", "one two"), (2, "a", "one two"), (3, "b", "x " * 50), (4, "c", "three")]
    assert retrieval.fold_context(parts, 4) == "one two\nthree"
