"""Site template removal: page furniture is what recurs on the pages of a site, and stands where no article would.

Every block of a page is hashed in several ways: the whole subtree with its structure, each of its entries, its first and
last words, and its skeleton without words; numbers and invented names are masked. Spark counts, for each hash and host and
for each hash over all hosts, on how many different articles it stands, and where: above the first heading, last, next to
last or within, and whether on a page that a site rendered or in a source that an author wrote. Short sentences recur in
articles as well, but within them and in sources too. How often a subtree of an article and one of a template is found at
each place is learned from the counts of all hashes by a mixture; the evidence of all places together decides on a hash.

What does not recur itself, such as a list of related pages, is told by a linear model of words, links and place, which is
trained on all blocks that recurrence found against all that authors wrote. No list of words is used.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import markup
from marlstone.llm.sums import in_few, numbers, summed
from marlstone.parsers import dom
from marlstone.tables import cut

#: A subtree is looked at from so many different articles on, however large the host is.
MIN_PAGES = 3
#: A form (first words, last words, skeleton) says less: it is looked at from so many on.
MIN_FORMS = 5
#: Log odds from which a whole subtree or entry is a template: counted over all hosts, and on one host. And a form.
ODDS, HOST_ODDS, FORM_ODDS = 2.0, 4.0, 5.0
#: A block is furniture if so many of its entries are.
ENTRIES = 0.6
#: On how many articles a subtree stands from which the rates are learned.
RATE_PAGES = 5
#: Log odds of the linear model from which a block is furniture.
ALIKE = 3.0
#: Hashed features of the linear model; two bytes hold one.
FEATURES = 1 << 16
#: Pages that a task turns into rows at a time; bounds its memory.
PAGES_AT_ONCE = 500
#: Copies of the few templates in the join with the many blocks, so that one on a third of all pages is spread over tasks.
SALTS = 16

#: Places: above the first heading, last, next to last, within; then the same in sources that no site rendered.
PLACES = 8
#: Rates that a corpus too small to learn from falls back on, each worth so many subtrees: articles, tops, bottoms.
PRIOR_ROWS = 10
PRIOR = np.array(
    [
        [0.01, 0.06, 0.04, 0.36, 0.01, 0.08, 0.04, 0.40],
        [0.70, 0.10, 0.06, 0.05, 0.05, 0.02, 0.01, 0.01],
        [0.02, 0.50, 0.25, 0.14, 0.01, 0.04, 0.02, 0.02],
    ]
)
SHARES = np.array([0.92, 0.03, 0.03, 0.02])

BLOCK, ENTRY, FORM = 1, 2, 3  # what a hash is of; its two lowest bits
HEADING_KINDS = frozenset(["Heading", *dom.HEADINGS])
FIXED_KINDS = HEADING_KINDS | {"CodeBlock", "pre", "ThematicBreak", "hr"}

_name = regex.compile(r"\b\p{Lu}\p{Ll}{3,}(?:\p{Lu}\p{Ll}+)?\b")
_token = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|\p{L}[\p{L}\p{M}'’]*|\p{N}+(?:[.,]\p{N}+)*|[^\s\p{L}\p{N}]")
_entry_end = regex.compile(r"\s+[|·•/]\s+|\s{2,}|\n|(?<=[.!?。！？])\s+|(?<=[。！？])")
_lower = regex.compile(r"\p{Ll}")
_letter = regex.compile(r"[\p{L}\p{N}]")

Leaf = tuple[str, str, list[str]]  # text, text outside links, addresses

# The blocks of a stored tree


def inline_text(inlines: list) -> Leaf:
    """(text, text outside links, urls) of inline content. Anything malformed counts as no text."""
    text, outside, urls = [], [], []
    todo = [(x, False) for x in reversed(inlines if isinstance(inlines, list) else [])]
    while todo:
        node, linked = todo.pop()
        if not isinstance(node, dict):
            text.append(" " if node == "LineBreak" else "")
            continue
        for kind, value in node.items():
            if kind in ("Text", "Code"):
                text.append(str(value))
                if not linked:
                    outside.append(str(value))
            elif kind == "Image" and isinstance(value, dict):
                text.append(str(value.get("alt") or ""))
            elif isinstance(value, dict):
                if kind == "Link":
                    urls.append(str(value.get("url") or ""))
                todo += [(x, linked or kind == "Link") for x in reversed(value.get("children") or [])]
    return "".join(text), "".join(outside), urls


def leaves(node: dict) -> list[Leaf]:
    """Inline contents below a block, in order: one for each paragraph, item or cell."""
    out, todo = [], [node]
    while todo:
        at = todo.pop()
        if not isinstance(at, dict):
            continue
        for kind, value in at.items():
            if not isinstance(value, dict):
                continue
            if kind == "Table":
                for row in [value.get("headers") or [], *(value.get("rows") or [])]:
                    out += [inline_text(c) for c in row if c]
            elif kind == "List":
                todo += [{"block": x.get("block")} for item in reversed(value.get("items") or []) for x in reversed(item.get("content") or []) if isinstance(x, dict)]
            elif kind == "block":
                todo.append(value)
            elif kind == "BlockQuote":
                todo += [{"block": x.get("block")} for x in reversed(value.get("children") or []) if isinstance(x, dict)]
            elif isinstance(value.get("content"), list):
                out.append(inline_text(value["content"]))
    return out


def tree_blocks(source: str | None) -> list[tuple[int, str, list[Leaf]]]:
    """(index, kind, leaves) of the top-level blocks of a stored tree; none for null or text that doesn't parse."""
    try:
        out = []
        for i, node in enumerate(json.loads(source)["body"] if source else []):
            block = node.get("block") if isinstance(node, dict) else None
            kind = block if isinstance(block, str) else next(iter(block), "") if isinstance(block, dict) else ""
            out.append((i, kind, leaves({"block": block}) if isinstance(block, dict) else []))
        return out
    except (ValueError, TypeError, KeyError, AttributeError):
        return []


# What is counted of a block


class Words:
    """Reads texts into tokens, each as (in lower case, with names alike, whether it is an ordinary word, two hashes). A number
    is 0; a name begins with a capital and has four letters or more. What was seen is remembered."""

    ZERO = ("0", "0", False, 1, 1)

    def __init__(self):
        self.known: dict[str, tuple[str, str, bool, int, int]] = {}

    def of(self, text: str) -> list[tuple[str, str, bool, int, int]]:
        known = self.known
        return [known.get(t) or self._learn(t) for t in _token.findall(text)]

    def _learn(self, token: str) -> tuple[str, str, bool, int, int]:
        if token[0].isdigit():
            return self.ZERO
        name = len(token) > 3 and token[0].isupper() and bool(_name.fullmatch(token))
        low = token.lower()
        fold = "n" if name else low
        made = low, fold, not name and bool(_lower.search(token)), *(xxhash.xxh32_intdigest(t) for t in (low, fold))
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[token] = made
        return made


def spelled(tokens: list[tuple[str, str, bool, int, int]]) -> str:
    """Tokens as one text, with names masked where an ordinary word is left then."""
    return " ".join([t[1] for t in tokens] if any(t[2] for t in tokens) else [t[0] for t in tokens])


def mark(text: str, what: int) -> int:
    return (xxhash.xxh3_64_intdigest(text) >> 1 & ~3 | what) - (1 << 62)


def skeleton(kind: str, contents: list[Leaf]) -> str:
    """The kind of a block, which of its leaves are links, text or both, with runs shortened, and whether it has many links."""
    run: list[str] = []
    for text, outside, urls in contents:
        if text.strip():
            leaf = "text" if not urls else "both" if _letter.search(outside) else "link"
            if run[-2:] != [leaf, leaf]:
                run.append(leaf)
    return f"{kind} {' '.join(run)} {min(3, sum(len(u) for _, _, u in contents))}"


def marks(kind: str, entries: list[list[list[tuple]]], skeleton_: str) -> tuple[int, list[int], list[int]]:
    """(hash of the whole subtree, hashes of its entries, of its forms), of the tokens of the entries of each leaf."""
    texts = [[spelled(e) for e in leaf] for leaf in entries]
    whole = mark(kind + "\0" + "\0".join(map(" ".join, texts)), BLOCK)
    forms = [f"skeleton {skeleton_}"]
    first, last, size = [], [], sum(len(e) for leaf in entries for e in leaf)
    for e in (e for leaf in entries for e in leaf):
        first += e[: 3 - len(first)]
        if len(first) == 3:
            break
    for e in (e for leaf in reversed(entries) for e in reversed(leaf)):
        last = e[-(3 - len(last)) :] + last
        if len(last) == 3:
            break
    for n in (2, 3):
        if size > n:
            forms.append(f"first {' '.join(t[0] for t in first[:n])}")
            for side, some in (("First", first[:n]), ("Last", last))[: n - 1]:
                if sum(t[1] not in ("n", "0") for t in some) >= 2:  # names and numbers alone are no form
                    forms.append(f"{side} {' '.join(t[1] for t in some)}")
    return whole, [mark(t, ENTRY) for leaf in texts for t in leaf if t], sorted({mark(f, FORM) for f in forms})


def _size(n: float) -> int:
    return min(6, int(n).bit_length())


class Features:
    """Hashed features of a block for the linear model: words, pairs of words, shape and place."""

    BEGIN, END = 0x9E37, 0x79B9

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, kind: str, contents: list[Leaf], entries: list[list[list[tuple]]], place: int, before: int, after: int) -> np.ndarray:
        words = [t for leaf in entries for e in leaf for t in e]
        ids = [i for leaf in entries for i in (self.BEGIN, *[t[4] for e in leaf for t in e], self.END)]
        pairs = np.array(ids, np.int64)
        pairs = (pairs[:-1] * 0x01000193 ^ pairs[1:]) * 0x9E3779B1 >> 15
        inside = length = links = 0
        for text, outside, urls in contents:
            size = len(text.strip())
            length += size
            inside += size - min(size, len(outside.strip()))
            links += len(urls)
        density, n = inside / max(1, length), len(words)
        shape = (
            f"kind {kind}", f"place {place}", f"before {min(3, before)}", f"after {min(3, after)}", f"leaves {_size(len(contents))}", f"words a leaf {_size(n / max(1, len(contents)))}",
            f"words {_size(n)}", f"density {0 if not inside else 1 + int(density * 2.1)}", f"links {_size(links)} {density >= 0.95}",
        )
        for f in shape:
            if f not in self.known:
                self.known[f] = xxhash.xxh32_intdigest(f)
        own = np.array([t[3] for t in words] + [self.known[f] for f in shape], np.int64)
        return np.unique(np.concatenate([own, pairs]) & (FEATURES - 1)).astype(np.uint16)


def article_of(blocks: list[tuple[int, str, list[Leaf]]], same: str | None) -> int:
    """Tells articles apart, edited copies not: by the headings; else by what rows have in common, or the longest text."""
    texts = [(k, "".join(t for t, _, _ in c)) for _, k, c in blocks]
    heads = "\0".join(t for k, t in texts if k in HEADING_KINDS)
    return mark(heads or same or max((t for _, t in texts), key=len, default=""), BLOCK)


def counted(blocks: list[tuple[int, str, list[Leaf]]], same: str | None, words: Words, features: Features) -> tuple[int, list[tuple]]:
    """A page as it is counted: its article, and each block that may be furniture as (index, place, hash of the whole, hashes of
    entries, hashes of forms, features). Breaks, headings and code may not."""
    real = [b for b in blocks if b[1] not in ("ThematicBreak", "hr")]
    first = next((n for n, (_, k, _) in enumerate(real) if k in HEADING_KINDS), -1)
    out = []
    for n, (index, kind, contents) in enumerate(real):
        if kind in FIXED_KINDS or not any(t.strip() for t, _, _ in contents):
            continue
        after = len(real) - 1 - n
        place = 3 if len(real) < 3 else 0 if n < first else 1 if after == 0 else 2 if after == 1 else 3
        entries = [[e for part in _entry_end.split(text) if (e := words.of(part))] for text, _, _ in contents]
        whole, parts, forms = marks(kind, entries, skeleton(kind, contents))
        found = features.of(kind, contents, entries, place, n, after)
        out.append((index, place, whole, parts, forms, found))
    return article_of(real, same), out


BLOCKS = "array<struct<block_index: bigint, place: int, whole: bigint, entries: array<bigint>, forms: array<bigint>>>"


def _lists(values: list, kind: pa.DataType) -> pa.ListArray:
    """One list for each of the values, of numbers."""
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([np.asarray(v, kind.to_pandas_dtype()) for v in values]) if values else np.empty(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def blocks_array(pages: list[list[tuple]]) -> pa.ListArray:
    every = [b for blocks in pages for b in blocks]
    columns = list(zip(*every)) if every else [()] * 6
    arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), _lists(columns[3], pa.int64()), _lists(columns[4], pa.int64())]
    structs = pa.StructArray.from_arrays(arrays, ["block_index", "place", "whole", "entries", "forms"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(b) for b in pages])]).astype(np.int32)), structs)


def features_arrays(pages: list[list[tuple]]) -> list[pa.Array]:
    """(features of all blocks of a page, two bytes each; how many each block has, four bytes each)."""
    flat = [np.concatenate([b[5] for b in blocks]).tobytes() for blocks in pages]
    return [pa.array(flat, pa.binary()), pa.array([np.array([len(b[5]) for b in blocks], np.int32).tobytes() for blocks in pages], pa.binary())]


# Rates and odds


class Rates:
    """A mixture of what stands in articles, at the top, at the bottom and within articles of rendered pages only."""

    def __init__(self, single: np.ndarray):
        """single: the places of subtrees that stand once."""
        # What stands once is nearly always an article's.
        self.usual = PRIOR[0] * PRIOR_ROWS + single + 1e-3
        article = self.usual / self.usual.sum()
        # Its shape follows from the articles': as they stand, but not in sources.
        within = np.concatenate([article[:4] / article[:4].sum() * 0.98, article[4:] / max(1e-9, article[4:].sum()) * 0.02])
        self.rates, self.shares = np.stack([article, PRIOR[1], PRIOR[2], within]), SHARES.copy()

    def sums(self, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each part of the mixture how many of the subtrees are of it, and where these stand. counts: a row for each kind
        of subtree, a column for each place; rows: how many subtrees there are of each kind."""
        where = counts / np.maximum(1, counts.sum(1, keepdims=True))
        odds = counts @ np.log(self.rates).T + np.log(self.shares)
        odds = np.exp(odds - odds.max(1, keepdims=True))
        odds *= (rows / odds.sum(1))[:, None]
        return np.concatenate([odds.sum(0)[:, None], odds.T @ where], axis=1)

    def learn(self, sums: np.ndarray) -> None:
        """sums: those of all subtrees."""
        self.shares = (sums[:, 0] + PRIOR_ROWS * SHARES) / (sums[:, 0].sum() + PRIOR_ROWS)
        for j, base in enumerate((self.usual, PRIOR[1] * PRIOR_ROWS, PRIOR[2] * PRIOR_ROWS)):
            rate = sums[j, 1:] + base + 1e-3
            self.rates[j] = rate / rate.sum()

    def odds(self, count, local: bool = False) -> Column:
        """Log odds that what stands at these places is a template. count(i) is the column of place i. Local ones are those of
        one host: as its pages are all rendered or none, that says nothing there, only where on a page something stands."""
        rates, bases = self.rates, np.log(self.shares)
        if local:
            rates = np.concatenate([half / half.sum(1, keepdims=True) for half in np.split(rates, 2, axis=1)], axis=1)
        logs = np.log(rates)

        def of(j: int) -> Column:
            total = F.lit(float(bases[j] - bases[0]))
            for i in range(PLACES):
                total = total + count(i) * float(logs[j, i] - logs[0, i])
            return F.exp(F.least(total, F.lit(60.0)))

        return F.log(of(1) + of(2) if local else of(1) + of(2) + of(3))


def rates_of(over: DataFrame, rounds: int = 20) -> Rates:
    """Rates of all subtrees. over: mark, p0 to p7, n. Those that stand alike are one row with their number."""
    places = [f"p{i}" for i in range(PLACES)]
    what = F.col("mark").bitwiseAND(3)
    used = over.where((what == BLOCK) & (F.col("n") == 1) | (what != FORM) & (F.col("n") >= RATE_PAGES))
    alike = cut(used.groupBy("n", *places).agg(F.count("*").alias("rows")))
    single = np.zeros(PLACES)
    for r in alike.where("n = 1").collect():  # a row for each place
        single += np.array([r[p] for p in places], float) * r["rows"]
    rates, many = Rates(single), in_few(alike.where("n > 1").select(*places, "rows"))
    for _ in range(rounds if not many.isEmpty() else 0):
        now = rates.sums

        def part(batch: pa.RecordBatch) -> np.ndarray:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            return now(np.stack(columns[:-1], axis=1), columns[-1])

        rates.learn(summed(many, part, 4 * (PLACES + 1)).reshape(4, PLACES + 1))
    return rates


def scores(features: np.ndarray, sizes: np.ndarray, weight: np.ndarray, base: float) -> np.ndarray:
    """Log odds of the linear model for blocks, each with so many of the features; every block has some."""
    if not len(sizes):
        return np.empty(0)
    return np.add.reduceat(weight[features], np.cumsum(sizes, dtype=np.int64) - sizes) / np.sqrt(sizes) + base


def train(blocks: DataFrame, rounds: int = 60) -> tuple[np.ndarray, float] | None:
    """(weights, base) of a linear model of hashed features, by gradient steps over all blocks that adapt to each feature; both
    labels weigh the same. blocks: features, sizes, labels (a byte a block) of some blocks a row. None if a label is absent."""
    blocks = in_few(blocks)

    def sides(batch: pa.RecordBatch) -> np.ndarray:
        label = numbers(batch.column("labels"), np.uint8)
        return np.array([len(label), label.sum()], float)

    count, true = summed(blocks.select("labels"), sides, 2)
    if not 0 < true < count:
        return None
    weight, base, seen = np.zeros(FEATURES), 0.0, np.full(FEATURES, 1e-6)
    cost = np.array([count / 2 / (count - true), count / 2 / true])
    for _ in range(rounds):

        def part(batch: pa.RecordBatch, weight=weight, base=base) -> np.ndarray:
            flat, sizes, label = (numbers(batch.column(c), k) for c, k in (("features", np.uint16), ("sizes", np.int32), ("labels", np.uint8)))
            slope = (1 / (1 + np.exp(-scores(flat, sizes, weight, base))) - label) * cost[label]
            return np.append(np.bincount(flat, np.repeat(slope / np.sqrt(sizes), sizes), FEATURES), slope.sum())

        made = summed(blocks, part, FEATURES + 1)
        step = made[:-1] + 1e-6 * count * weight
        seen = seen + step * step
        weight = weight - 2.0 * step / np.sqrt(seen)
        base -= 0.5 * float(made[-1]) / count
    return weight, base


def _sum_places(name) -> list[Column]:
    return [name(i).alias(f"p{i}") for i in range(PLACES)]


def furniture_of(pages: DataFrame) -> DataFrame:
    """(key, block_index, reason, pages, score) of the blocks that are furniture. pages: key, host, rendered, article, blocks,
    features, sizes.

    reason: recurs (the whole block), entries (most of its entries), form (its first or last words or its skeleton), alike
    (the linear model). pages: on how many articles of the host the block stands; score: the log odds.
    """
    spark = pages.sparkSession
    pages = cut(pages)
    blocks = pages.select("key", "host", "rendered", "article", F.inline("blocks"))
    place = F.col("place") + F.when(F.col("rendered"), 0).otherwise(PLACES // 2)
    each = blocks.select("host", "article", place.alias("place"), F.explode(F.array_distinct(F.concat(F.array("whole"), "entries", "forms"))).alias("mark"))
    # An article counts once for a hash, however often it or its copies have it: at the place most like an article's. Partial
    # counts leave little of a hot hash.
    once = each.groupBy("host", "mark", "article").agg(F.max("place").alias("place"))
    here = cut(once.groupBy("host", "mark").agg(*_sum_places(lambda i: F.count_if(F.col("place") == i))).withColumn("n", F.expr("+".join(f"p{i}" for i in range(PLACES)))))
    over = here.groupBy("mark").agg(*_sum_places(lambda i: F.sum(f"p{i}")), F.sum("n").alias("n"))
    what = F.col("mark").bitwiseAND(3)

    rates = rates_of(over)

    # Templates: hashes with good odds over all hosts, or on one.
    odds = rates.odds(lambda i: F.col(f"p{i}"))
    least, good = F.when(what == FORM, MIN_FORMS).otherwise(MIN_PAGES), F.when(what == FORM, FORM_ODDS)
    overall = over.where((F.col("n") >= least)).withColumn("odds", odds).where(F.col("odds") >= good.otherwise(ODDS)).select("mark", F.col("odds").alias("overall"))
    local = here.withColumn("odds", rates.odds(lambda i: F.col(f"p{i}"), True))
    known = local.join(overall, "mark", "left")
    fine = F.col("overall").isNotNull() | (F.col("n") >= least) & (F.col("odds") >= good.otherwise(HOST_ODDS))
    templates = known.where(fine).select("host", "mark", F.col("n").alias("pages"), F.greatest("overall", F.when(F.col("n") >= least, F.col("odds"))).alias("odds"))
    # There are few templates and many blocks: copies of the few spread a template that stands on very many pages.
    spread = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = blocks.select(
        "key", "host", "block_index", F.size(F.array_distinct("entries")).alias("entries"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"),
        F.explode(F.array_distinct(F.concat(F.array("whole"), "entries", "forms"))).alias("mark"),
    )
    met = asked.join(spread, ["host", "mark", "salt"]).groupBy("key", "block_index").agg(
        F.max(F.when(what == BLOCK, F.col("pages"))).alias("pages"),
        F.max(F.when(what == BLOCK, F.col("odds"))).alias("whole"),
        F.max(F.when(what == FORM, F.col("odds"))).alias("form"),
        F.max(F.when(what == ENTRY, F.col("odds"))).alias("entry"),
        (F.count_if(what == ENTRY) / F.greatest(F.lit(1), F.max("entries"))).alias("share"),
        F.max("entries").alias("entries"),
    )
    listed = (F.col("share") >= ENTRIES) & (F.col("entries") >= 2)
    reason = F.when(F.col("whole").isNotNull(), "recurs").when(listed, "entries").when(F.col("form").isNotNull(), "form")
    score = F.coalesce("whole", F.when(listed, F.col("entry")), F.col("form"))
    found = cut(met.select("key", "block_index", reason.alias("reason"), "pages", score.alias("score")).where("reason IS NOT NULL"))

    # The linear model. Where no author's source is there, what stands within articles takes its part. Each page's features
    # meet the blocks found on it.
    authors = not pages.where("NOT rendered").isEmpty()
    hits = found.groupBy(F.col("key").alias("at")).agg(F.collect_list("block_index").alias("hits"))  # of a page at most its own blocks
    index, place_of = F.col("blocks.block_index").alias("index"), F.col("blocks.place").alias("place")
    told = pages.select("key", (~F.col("rendered")).alias("written"), index, place_of, "features", "sizes").join(hits, F.col("key").eqNullSafe(F.col("at")), "left")
    told = told.where(F.col("hits").isNotNull() | F.col("written") | F.lit(not authors)).select("written", "index", "place", "features", "sizes", "hits")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each page the blocks found and those that count as written."""
        for batch in batches:
            made = []
            for written, index, place, flat, sizes, hits in zip(*(c.to_pylist() for c in batch.columns)):
                sizes = np.frombuffer(sizes, np.int32)
                hit = np.isin(index, hits or [])
                kept = hit | (written if authors else np.array(place) == 3)
                if kept.any():
                    some = np.frombuffer(flat, np.uint16)[np.repeat(kept, sizes)]
                    made.append((some.tobytes(), sizes[kept].tobytes(), hit[kept].astype(np.uint8).tobytes()))
            columns = list(zip(*made)) if made else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["features", "sizes", "labels"])

    model = train(cut(told.mapInArrow(label, "features binary, sizes binary, labels binary")))
    columns = ["key", "block_index", "reason", "pages", "score"]
    if model is None:
        return found.select(*columns)
    shared = spark.sparkContext.broadcast(model)  # FEATURES weights

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = numbers(batch.column("sizes"), np.int32)
            score = scores(numbers(batch.column("features"), np.uint16), sizes, *shared.value)
            index = batch.column("index")
            good = np.flatnonzero(score >= ALIKE)
            row = pa.array(np.repeat(np.arange(batch.num_rows), index.value_lengths().to_numpy(zero_copy_only=False))[good])
            yield pa.RecordBatch.from_arrays([batch.column("key").take(row), index.flatten().take(pa.array(good)), pa.array(score[good])], names=["key", "block_index", "score"])

    kind = pages.schema["key"].dataType.simpleString()
    likely = pages.select("key", index, "features", "sizes").mapInArrow(alike, f"key {kind}, block_index bigint, score double")
    likely = likely.select("key", "block_index", F.lit("alike").alias("reason"), F.lit(None).cast("bigint").alias("pages"), "score")
    first = F.when(F.col("reason") == "alike", 1).otherwise(0)
    both = found.select(*columns).unionByName(likely)
    return both.groupBy("key", "block_index").agg(F.min_by(F.struct("reason", "pages", "score"), F.struct(first, F.col("score"))).alias("b")).select("key", "block_index", "b.*")


def _pages(frame: DataFrame, key: str, content: str, host, same, rendered, read) -> DataFrame:
    """One row a page of the frame, counted."""
    names = ["key", "host", "rendered", "article", "blocks", "features", "sizes"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, features = Words(), Features()
        for batch in batches:
            for i in range(0, batch.num_rows, PAGES_AT_ONCE):
                some = batch.slice(i, PAGES_AT_ONCE)
                made = [counted(read(t), s, words, features) for t, s in zip(some.column("content").to_pylist(), some.column("same").to_pylist())]
                kept = [n for n, (_, blocks) in enumerate(made) if blocks]
                columns = some.select(["key", "host", "rendered"]).take(pa.array(kept, pa.int64())).columns
                articles = pa.array([made[n][0] for n in kept], pa.int64())
                blocks = [made[n][1] for n in kept]
                yield pa.RecordBatch.from_arrays([*columns, articles, blocks_array(blocks), *features_arrays(blocks)], names=names)

    same = F.lit(None).cast("string") if same is None else same.cast("string")
    rendered = F.lit(True) if rendered is None else F.coalesce(rendered, F.lit(True))
    rows = frame.select(F.col(key).alias("key"), F.coalesce(host, F.lit("")).alias("host"), rendered.alias("rendered"), F.col(content).alias("content"), same.alias("same"))
    return rows.mapInArrow(count, f"key {rows.schema['key'].dataType.simpleString()}, host string, rendered boolean, article bigint, blocks {BLOCKS}, features binary, sizes binary")


def tree_furniture(frame: DataFrame, key: str, tree: str, host, same=None, rendered=None) -> DataFrame:
    """(key, block_index BIGINT, reason, pages, score): the top-level blocks of stored trees that are page furniture.

    `host` is a column; rows with null host are one site of their own. `same` is a column in which copies of a page agree,
    such as a hash of the content; it tells articles without headings apart. `rendered` is false for sources that an author
    wrote; null and no column are true. Null, cut or malformed trees have no blocks. Rows with the same key give the blocks
    of all of them. An empty table gives none. Headings, code and breaks are never furniture.
    """
    found = furniture_of(_pages(frame, key, tree, host, same, rendered, tree_blocks))
    return found.withColumnRenamed("key", key)


# Fetched pages

#: Elements that hold blocks, or are blocks where they hold none.
ELEMENTS = frozenset("header footer nav aside div section ul ol dl table p form main article h1 h2 h3 h4 h5 h6 blockquote pre figure address".split())
#: Elements that are a block whatever they hold.
WHOLE = frozenset("ul ol dl table p pre blockquote h1 h2 h3 h4 h5 h6".split())
NEVER_CONTENT = frozenset("header footer nav aside script style noscript template iframe form".split())


def element_contents(node: dom.Node) -> list[Leaf]:
    """As `leaves`, of an element."""
    items = [n for n in node.walk() if n.tag in ("li", "td", "th", "p", "dt", "dd") and not any(k.tag in ("li", "td", "th", "p", "ul", "ol", "table") for k in n.kids if isinstance(k, dom.Node))]
    out = []
    for n in items or [node]:
        text = n.text()
        urls = [a.attrs.get("href", "") for a in n.walk() if a.tag == "a"]
        linked = sum(len(a.text()) for a in n.walk() if a.tag == "a")
        out.append((text, "" if urls and linked >= len(text.strip()) else text, urls))
    return out


def page_root(page: dom.Node) -> dom.Node:
    best, length = None, 0
    for n in page.walk():
        if (n.tag in ("main", "article") or n.attrs.get("role") == "main") and (size := len(n.text().strip())) >= max(1, length):
            best, length = n, size
    return best or next((n for n in page.walk() if n.tag == "body"), page)


def page_elements(root: dom.Node) -> list[dom.Node]:
    """The blocks of a page in document order, without those that are never content; innermost ones, but lists, tables and the like whole."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node is not root and node.tag in NEVER_CONTENT:
            continue
        inner = [] if node.tag in WHOLE else [k for k in node.kids if isinstance(k, dom.Node)]
        if node.tag in WHOLE or node.tag in ELEMENTS and node is not root and not any(x.tag in ELEMENTS for k in inner for x in k.walk()):
            out.append(node)
        else:
            todo.extend(reversed(inner))
    return out


_tree_kinds = {"ul": "List", "ol": "List", "dl": "List", "table": "Table", "p": "Paragraph"}


def page_blocks(body: str | None) -> list[tuple[int, str, list[Leaf]]]:
    if not body:
        return []
    return [(i, _tree_kinds.get(n.tag, n.tag), element_contents(n)) for i, n in enumerate(page_elements(page_root(dom.parse(body))))]


def main_text(body: str | None, gone) -> str | None:
    """The page without the blocks of these indices and without what is never content, rendered by layout."""
    if body is None:
        return None
    root = page_root(dom.parse(body))
    drop = set() if gone is None else set(gone)
    away = {id(n) for i, n in enumerate(page_elements(root)) if i in drop}
    todo = [root]
    while todo:
        node = todo.pop()
        node.kids = [k for k in node.kids if not isinstance(k, dom.Node) or id(k) not in away and k.tag not in NEVER_CONTENT]
        todo.extend(k for k in node.kids if isinstance(k, dom.Node))
    writer = markup.Writer(kept=False)
    writer.node(root)
    return writer.text()


def main_bodies(frame: DataFrame, key: str, body: str, host, address=None) -> DataFrame:
    """(key, main STRING): the main text of every HTML page. Null bodies give null, empty ones an empty text.

    Rows with the same key are one page; of differing bodies one is taken by hash. Copies, and all bodies of one value of
    the column `address`, count as one page. Pages are parsed twice: for the hashes to count, and to delete what recurs.
    Only keys and hashes are shuffled to find rows written twice, and what is deleted goes to the bodies once.
    """

    @F.pandas_udf("string")
    def rest(bodies: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([main_text(b, g) for b, g in zip(bodies, gone)], dtype=object)

    address = F.lit(None).cast("string") if address is None else address
    rows = frame.select(F.col(key).alias("key"), F.coalesce(host, F.lit("")).alias("host"), address.alias("address"), F.col(body).alias("body"), F.xxhash64(body).alias("h"))
    single = rows.groupBy("key").agg(*[F.min_by(c, F.col("h")).alias(c) for c in ("host", "address", "body")])
    found = furniture_of(_pages(single, "key", "body", F.col("host"), F.col("address"), None, page_blocks))
    # Of a page at most its own blocks are collected.
    gone = found.groupBy("key").agg(F.collect_list("block_index").alias("gone"))
    return single.join(gone, "key", "left").select(F.col("key").alias(key), rest("body", "gone").alias("main"))
