"""Byte-level BPE by replaying the merges over the distinct words of the corpus.

The distinct words of all texts are counted in Spark. The most frequent ones, a bounded number, are spread over partitions;
each keeps an inverted index from a pair of neighbouring tokens to the positions at which it stands in its words. Merges are
applied in the order of their rank; each touches only the positions that the index names and the neighbours of these. What
comes out is the dictionary of the corpus. Words beyond its bound, each in few texts, are replayed in the same way where
they stand, all words of a segment of texts together. Texts are not shuffled, and the bound changes no result.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.tables import cut

#: The published pattern that splits text into words before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Words of the corpus dictionary, at most; about 3 MB to every executor.
DICTIONARY = 50_000
#: Words kept by a task. Beyond it the store is emptied; that costs time and changes no result.
WORDS_KEPT = 1_000_000
#: Characters of the texts whose words are replayed together.
SEGMENT = 16_000_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    kept, out, extra = set(plain), [], 0
    for b in range(256):
        out.append(chr(b if b in kept else 0x100 + extra))
        extra += b not in kept
    return out


class Replay:
    """Encodes words by the merge list of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        self.single = [vocab[c] for c in byte_alphabet()]
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault(vocab[a] << 20 | vocab[b], len(self.result))
            self.result.append(vocab[a + b])
        self.pairs = {r: k for k, r in self.rank.items()}

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        single, rank = self.single, self.rank
        token: list[int] = []
        spans = []
        for word in words:
            begin = len(token)
            token.extend([single[b] for b in word.encode("utf-8", "surrogatepass")])
            spans.append((begin, len(token)))
            token.append(-1)
        after = list(range(1, len(token) + 1))
        before = list(range(-1, len(token) - 1))
        index: dict[int, list[int]] = {}
        for i in range(len(token) - 1):
            a, b = token[i], token[i + 1]
            if a >= 0 and b >= 0 and (r := rank.get(a << 20 | b)) is not None:
                index.setdefault(r, []).append(i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r)
            places.sort()
            pair, merged = self.pairs[r], self.result[r]
            a, b = pair >> 20, pair & 0xFFFFF
            for i in places:
                j = after[i]
                if token[i] != a or j >= len(token) or token[j] != b:
                    continue
                token[i], token[j] = merged, -2
                k = after[j]
                after[i] = k
                before[k] = i
                right = token[k]
                if right >= 0 and (q := rank.get(merged << 20 | right)) is not None:
                    if q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        heapq.heappush(heap, q)
                h = before[i]
                if h >= 0 and token[h] >= 0 and (q := rank.get(token[h] << 20 | merged)) is not None:
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        heapq.heappush(heap, q)
        return [[t for t in token[x:y] if t >= 0] for x, y in spans]


class Encoder:
    """Encodes texts of a task. shared is the dictionary of the corpus; words not in it are replayed a segment at a time."""

    def __init__(self, path: str, shared: dict[str, list[int]] | None = None):
        self.replay, self.split = Replay(path), regex.compile(PATTERN).findall
        self.shared, self.known = shared or {}, {}

    def learn(self, texts: list[list[str]]) -> None:
        """Replays the words of these texts that are new, all together."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        known, shared = self.known, self.shared
        fresh = {w for words in texts for w in words if w not in known}
        mine = sorted(w for w in fresh if w not in shared)
        self.known.update((w, shared[w]) for w in fresh if w in shared)
        self.known.update(zip(mine, self.replay.encode(mine)))

    def encode(self, texts: list[list[str]]) -> tuple[list[int], list[int]]:
        """(ids of all texts one after another, the offset at which each text begins), of texts as words that were learned."""
        flat: list[int] = []
        offsets, known = [0], self.known
        for words in texts:
            for w in words:
                flat += known[w]
            offsets.append(len(flat))
        return flat, offsets

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[int]]]:
        """Each batch with the ids of its last column."""
        held: list[tuple[pa.RecordBatch, list[list[str]]]] = []
        size = 0
        for batch in batches:
            texts = batch.columns[-1].to_pylist()
            held.append((batch, [self.split(t) if t else [] for t in texts]))
            size += sum(len(t) for t in texts if t)
            if size >= SEGMENT:
                yield from self._segment(held)
                held, size = [], 0
        yield from self._segment(held)

    def _segment(self, held: list[tuple[pa.RecordBatch, list[list[str]]]]) -> Iterator[tuple[pa.RecordBatch, list[int], list[int]]]:
        self.learn([words for _, texts in held for words in texts])
        for batch, texts in held:
            yield batch, *self.encode(texts)


def word_counts(frame: DataFrame, text: str) -> DataFrame:
    """(word, n) of all texts. Each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, total = regex.compile(PATTERN).findall, Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.columns[0].to_pylist():
                if t:
                    total.update(split(t))
            if len(total) > WORDS_KEPT:
                yield made()
                total.clear()
        yield made()

    return frame.select(F.col(text).alias("text")).where("text <> ''").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(frame: DataFrame, text: str, path: str, most: int = DICTIONARY) -> dict[str, list[int]]:
    """The ids of the most frequent words of all texts, at most so many, replayed by partitions."""
    counts = cut(word_counts(frame, text))
    level = F.floor(4 * F.log2("n"))
    levels = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)  # 4 rows for each doubling
    least, held = None, 0
    for at, words in levels:
        held += words
        if held > most:
            break
        least = at
    if least is None:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for batch in batches for w in batch.columns[0].to_pylist()]
        ids = Replay(path).encode(words) if words else []
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    frequent = counts.where(level >= least).select("word").repartition(max(1, -(-most // 10_000)), "word")
    return {r["word"]: list(r["ids"]) for r in frequent.mapInArrow(run, "word string, ids array<int>").collect()}  # `most` rows


def encode(frame: DataFrame, keep: tuple[str, ...], text: str, name: str = NAME, folder: str = FOLDER, counts_only: bool = False, most: int = DICTIONARY) -> DataFrame:
    """The columns of `keep`, and ids ARRAY<INT> (or only n_ids BIGINT) of the text. No special tokens.

    A null text and an empty one both give an empty array (0). Rows are neither dropped nor merged; other columns than
    those of `keep` are dropped. The file must be readable at the same path on every executor. `most` bounds the dictionary
    of the corpus; with 0 every task replays all its words.
    """
    path = f"{folder}/{name}.json"
    shared = frame.sparkSession.sparkContext.broadcast(dictionary(frame, text, path, most) if most else {})  # at most `most` words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, offsets in Encoder(path, shared.value).batches(batches):
            if counts_only:
                made = pa.array([b - a for a, b in zip(offsets, offsets[1:])], pa.int64())
            else:
                made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], "n_ids" if counts_only else "ids"])

    source = frame.select(*keep, F.col(text).alias("text to encode"))
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{kinds}, {'n_ids bigint' if counts_only else 'ids array<int>'}")
