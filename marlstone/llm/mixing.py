"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The token mass of the cells is raked in turn to the marginals of
the three: the target shares of the sources, and for languages and topics the shares of the whole corpus. No weight may
exceed the number of times its source may be used. Documents are then sampled by the weights of their cells, evenly over
their sizes, and a last step adds or takes single copies until each source is within half of its smallest document of its share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import bpe
from marlstone.llm.additive import one_thread, unit
from marlstone.llm.sums import in_few, numbers, summed
from marlstone.tables import cut

TOPICS = 8
#: Rounds in which the centres of the topics move, each over all documents.
TOPIC_ROUNDS = 10
FEATURES = 64
#: Steps of a single document each that bring a source to its share.
CORRECTIONS = 12
#: Documents of a source that are sampled in one task.
DOCS_A_BUCKET = 50_000


def sized(documents: DataFrame, folder: str = bpe.FOLDER) -> DataFrame:
    """(doc_id, source, lang, tokens, profile): source trimmed in lower case, lang its two letters or `und`, profile the
    frequencies of hashed token ids, as bytes of FEATURES floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, offsets in bpe.Encoder(f"{folder}/{bpe.NAME}.json").batches(batches):
            ids, at = np.array(flat, np.int64), np.array(offsets)
            rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
            hashed = (ids * 0x9E3779B1 >> 7) % FEATURES
            profile = np.bincount(rows * FEATURES + hashed, minlength=(len(at) - 1) * FEATURES).reshape(-1, FEATURES)
            profile = np.sqrt(profile / np.maximum(profile.sum(1, keepdims=True), 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.diff(at), pa.int64()), pa.array([p.tobytes() for p in profile], pa.binary())],
                names=["doc_id", "source", "lang", "tokens", "profile"],
            )

    lang = F.lower(F.regexp_extract("lang", r"^\s*([A-Za-z]{2})(?:[-_].*)?\s*$", 1))
    source = documents.select("doc_id", F.lower(F.trim("source")).alias("source"), F.when(lang != "", lang).otherwise("und").alias("lang"), F.col("text").alias("t"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, source string, lang string, tokens bigint, profile binary")


def profiles_of(column: pa.Array) -> np.ndarray:
    return numbers(column, np.float32).reshape(-1, FEATURES)


def firsts(documents: DataFrame) -> np.ndarray:
    """The TOPICS different profiles with the smallest hashes, or all if there are fewer, as rows of length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, bytes] = {}
        for batch in batches:
            h = batch.column("h").to_numpy()
            for n in np.unique(h, return_index=True)[1][:TOPICS]:
                best[int(h[n])] = batch.column("profile")[int(n)].as_py()
            best = dict(sorted(best.items())[:TOPICS])
        yield pa.RecordBatch.from_arrays([pa.array(best.keys(), pa.int64()), pa.array(best.values(), pa.binary())], names=["h", "profile"])

    rows = in_few(documents.select(F.xxhash64("profile").alias("h"), "profile")).mapInArrow(run, "h bigint, profile binary").collect()  # TOPICS a task
    best = dict(sorted((r["h"], bytes(r["profile"])) for r in rows))
    return unit(np.array([np.frombuffer(p, np.float32) for p in list(best.values())[:TOPICS]], np.float32).reshape(-1, FEATURES))


def centres_of(documents: DataFrame) -> np.ndarray:
    """TOPICS centres of the profiles of all documents, as rows of length 1; of fewer different profiles these themselves. A
    centre that is nearest to none stays where it is."""
    centres = firsts(documents)
    profiles = in_few(documents.select("profile"))
    for _ in range(TOPIC_ROUNDS if len(centres) == TOPICS else 0):

        def part(batch: pa.RecordBatch, centres=centres) -> np.ndarray:
            one_thread()
            rows = unit(profiles_of(batch.column("profile")))
            near = (rows @ centres.T).argmax(1)
            return np.eye(TOPICS)[near].T @ rows

        sums = summed(profiles, part, TOPICS * FEATURES).reshape(TOPICS, FEATURES)
        centres = np.where(sums.any(1, keepdims=True), unit(sums), centres)
    return centres


def with_topics(documents: DataFrame) -> DataFrame:
    """Adds topic INT: the nearest of TOPICS centres of profiles."""
    centres = centres_of(documents.where("tokens > 0"))
    if not len(centres):
        return documents.withColumn("topic", F.lit(0))

    @F.pandas_udf("int")
    def nearest(profiles: pd.Series) -> pd.Series:
        rows = np.frombuffer(b"".join(profiles), np.float32).reshape(-1, FEATURES)
        return pd.Series((rows @ centres.T).argmax(1), dtype="int32")

    return documents.withColumn("topic", nearest("profile"))


def fill(mass: np.ndarray, weight: np.ndarray, cap: float, wanted: float) -> np.ndarray:
    """Scales weights so that the mass they give is as wanted, none above the cap; what the cap takes the others get."""
    weight = np.maximum(weight, 1e-9)
    if (mass * cap).sum() <= wanted:
        return np.full_like(weight, cap)
    free = np.ones(len(weight), bool)
    while True:
        scaled = np.where(free, weight * (wanted - (mass * cap)[~free].sum()) / max((mass * weight)[free].sum(), 1e-30), cap)
        over = free & (scaled > cap)
        if not over.any():
            return scaled
        free &= ~over


def rake(cells: pd.DataFrame, targets: pd.DataFrame, lang_share: dict[str, float], topic_share: dict[int, float], rounds: int = 50) -> tuple[np.ndarray, float]:
    """(weight of each cell, total tokens). cells: source, lang, topic, tokens; targets: source, target_share, max_repeats.

    The total is the largest at which every source with documents can have its share. Shares of sources without tokens go
    to the others in proportion. The last step of each round is the sources', so theirs hold exactly.
    """
    mass = cells["tokens"].to_numpy(float)
    weight = np.ones(len(cells))
    if not len(cells) or mass.sum() == 0:
        return weight, 0.0
    cap = dict(zip(targets["source"], targets["max_repeats"].astype(float)))
    share = dict(zip(targets["source"], targets["target_share"].astype(float)))
    held = cells.groupby("source")["tokens"].sum()
    held = held[(held > 0) & (held.index.map(lambda s: share.get(s, 0) > 0 and cap.get(s, 0) > 0))]
    if held.empty:
        return np.zeros(len(cells)), 0.0
    whole = sum(share[s] for s in held.index)
    total = min(held[s] * cap[s] * whole / share[s] for s in held.index)
    source, lang, topic = (cells[c].to_numpy() for c in ("source", "lang", "topic"))
    for _ in range(rounds):
        before = weight.copy()
        for names, shares in ((lang, lang_share), (topic, topic_share)):
            part = sum(shares.get(k, 0.0) for k in set(names)) or 1.0
            for k in set(names):
                at = names == k
                have = (mass * weight)[at].sum()
                if have > 0:
                    weight[at] *= shares.get(k, 0.0) / part * total / have
        for s in set(source):
            at = source == s
            weight[at] = fill(mass[at], weight[at], cap[s], share[s] / whole * total) if s in held.index else 0.0
        if np.abs(weight - before).max() < 1e-9:
            break
    return weight, total


def corrections(sampled: DataFrame, goals: dict[str, float], caps) -> dict[tuple[str, int, int], int]:
    """{(source, tokens, h): copies to add}: single copies that bring the tokens of each source to its goal.

    In each step every source that is off by more than half of its smallest document gives the document nearest in size to
    what is missing or too much, found by a partial minimum. At most CORRECTIONS rows a source reach the driver. Documents
    that agree in source, size and hash, such as one written twice, change together.
    """
    changes: dict[tuple[str, int, int], int] = {}
    rows = sampled.groupBy("source", "tokens", "h").agg(F.count("*").alias("rows"), F.min("copies").alias("copies"))
    have = {r["source"]: r for r in sampled.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.min("tokens").alias("least")).collect()}
    off = {s: goals.get(s, 0.0) - r["used"] for s, r in have.items()}
    rows = cut(rows) if any(abs(d) > have[s]["least"] / 2 for s, d in off.items()) else rows
    for _ in range(CORRECTIONS):
        open_ = {s: d for s, d in off.items() if abs(d) > have[s]["least"] / 2}
        if not open_:
            break
        missing = F.create_map([F.lit(x) for pair in open_.items() for x in pair])[F.col("source")]
        left = F.col("copies")
        for (source, tokens, h), by in changes.items():
            left = left + F.when((F.col("source") == source) & (F.col("tokens") == tokens) & (F.col("h") == h), by).otherwise(0)
        fits = F.when(missing > 0, left < caps[F.col("source")]).otherwise(left > 0)
        size = F.col("tokens") * F.col("rows")
        # Only what brings the source nearer.
        able = rows.where(F.col("source").isin(list(open_)) & fits & (F.abs(F.abs(missing) - size) < F.abs(missing)))
        best = able.groupBy("source").agg(F.min(F.struct(F.abs(F.abs(missing) - size).alias("d"), "tokens", "h", size.alias("size"))).alias("b")).collect()  # one row a source
        if not best:
            break
        for r in best:
            sign = 1 if open_[r["source"]] > 0 else -1
            mark = (r["source"], r["b"]["tokens"], r["b"]["h"])
            changes[mark] = changes.get(mark, 0) + sign
            off[r["source"]] -= sign * r["b"]["size"]
        for s in open_.keys() - {r["source"] for r in best}:
            have[s] = have[s].asDict() | {"least": math.inf}
    return {m: c for m, c in changes.items() if c}


def mix(documents: DataFrame, targets: DataFrame, folder: str = bpe.FOLDER) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    selection: doc_id, source, tokens, copies of the documents used at least once. shares: a row for each target with
    target_share, max_repeats, documents and tokens there are, tokens used, actual_share and the largest number of copies.
    Documents of other sources, or without one, are in no row but count for the marginals. Texts without tokens are never
    used. Documents with the same id are different rows. Empty tables give no selection and actual shares of 0.
    """
    spark = documents.sparkSession
    wanted = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").toPandas()  # one row a source
    pool = cut(with_topics(cut(sized(documents, folder))).drop("profile"))
    # One row for each source, language and topic; sources are those of the targets, the others count as one.
    listed = F.when(F.col("source").isin(wanted["source"].tolist()), F.col("source"))
    cells = pool.groupBy(listed.alias("source"), "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).toPandas()
    whole = max(1, cells["tokens"].sum())
    lang_share = (cells.groupby("lang")["tokens"].sum() / whole).to_dict()
    topic_share = (cells.groupby("topic")["tokens"].sum() / whole).to_dict()
    mine = cells[cells["source"].notna() & (cells["tokens"] > 0)].reset_index(drop=True)
    weight, _ = rake(mine, wanted, lang_share, topic_share)
    mine["weight"] = weight
    mine["buckets"] = np.ceil(mine.groupby("source")["docs"].transform("sum") / DOCS_A_BUCKET).astype(int)
    mine["number"] = mine.groupby("source").ngroup()
    plan = spark.createDataFrame(
        mine[["source", "lang", "topic", "weight", "buckets", "number"]].to_records(index=False).tolist(), "source string, lang string, topic int, weight double, buckets int, number int"
    )
    chosen = pool.where("tokens > 0").join(plan, ["source", "lang", "topic"]).where("weight > 0")
    chosen = chosen.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")))
    # Evenly over cells and sizes: in each bucket of a source the sums of the fractions, from a start of its own, are counted in whole steps.
    run = Window.partitionBy("number", "bucket").orderBy("topic", "lang", "tokens", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fraction = F.col("weight") - F.floor("weight")
    start = F.pmod((F.col("number") + F.col("bucket") * 7) * F.lit(0.6180339887498949), F.lit(1.0))
    chosen = chosen.withColumn("through", F.sum(fraction).over(run) + start).withColumn(
        "copies", (F.floor("weight") + F.floor(F.col("through") + 1e-9) - F.floor(F.col("through") - fraction + 1e-9)).cast("int")
    )
    wanted_tokens = mine.assign(goal=mine["tokens"] * mine["weight"]).groupby("source")["goal"].sum().to_dict()
    caps = F.create_map([F.lit(x) for pair in zip(wanted["source"], wanted["max_repeats"].astype(int)) for x in pair]) if len(wanted) else F.create_map()
    sampled = cut(chosen.select("doc_id", "source", "tokens", F.xxhash64("doc_id", "tokens", "lang", "topic").alias("h"), "copies"))
    changes = corrections(sampled, wanted_tokens, caps)
    copies = F.col("copies")
    for (source, tokens, h), by in changes.items():
        copies = copies + F.when((F.col("source") == source) & (F.col("tokens") == tokens) & (F.col("h") == h), by).otherwise(0)
    selection = cut(sampled.withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "copies"))
    used = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    there = pool.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    total = used.agg(F.sum("tokens_used").alias("total"))
    goal = spark.createDataFrame(wanted.to_records(index=False).tolist(), "source string, target_share double, max_repeats int")
    shares = goal.join(there, "source", "left").join(used, "source", "left").join(F.broadcast(total)).select(  # one row
        "source",
        "target_share",
        "max_repeats",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "tokens_used", "most_copies")],
        F.coalesce(F.col("tokens_used") / F.col("total"), F.lit(0.0)).alias("actual_share"),
    )
    return selection, shares
