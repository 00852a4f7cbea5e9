"""Text that went through a wrong character decoding: found and, where possible, restored.

Adjacent character pairs of the whole corpus are counted once, over an alphabet of fixed size, and scored by their mutual
information, damped so that rare pairs count as improbable. Words that are themselves valid UTF-8 in a wrong code, or hold
replacement or control characters, are left out of the counts, so that a large garbled source doesn't make its own pairs
common. In each text the maximum-scoring segments of improbable pairs are isolated; nothing outside of them is looked at. Only the words they touch are tested: written back in the wrong code, read in the right one. A reading as
UTF-8 or Shift-JIS proves itself by its validity; one in another single-byte code must be far likelier by the pair counts.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Single-byte codes in which text is read by mistake, and in which it may have been written.
SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "cp1254", "iso8859_2", "iso8859_5", "mac_cyrillic")
#: Pairs of (read as, written in) of codes with several bytes a character.
MULTI = [(w, "utf-8") for w in (*SINGLE, "cp932")] + [(w, r) for r in ("cp932", "euc_jp") for w in ("cp1252", "latin-1", "mac_roman")]
MULTIBYTE = ("utf-8", "cp932", "euc_jp")
#: A pair seen less often than this among all pairs is improbable.
RARE = 2e-5
#: Codes with few letters from 0x80 to 0xBF.
PLAIN = frozenset(("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "iso8859_2"))
#: So many characters of several bytes in a word prove a reading as UTF-8, whatever the corpus holds.
PROOF = 3
#: Bits by which another single-byte reading must be likelier.
GAIN = 8.0
#: Of a restored word every pair with a non-ASCII character must be this frequent.
KNOWN = 4e-7
#: And of the word as it stands some such pair must be this rare.
UNKNOWN = 4e-6
#: Bits that all words of a text must gain together by another single-byte reading.
TEXT_GAIN = 12.0


@lru_cache(None)
def table(code: str) -> tuple[dict[str, int], list[str]]:
    """(character to byte, byte to character); bytes without a character stand for themselves, as decoders leave them."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(code))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {c: b for b, c in enumerate(chars)} | ({chr(b): b for b in range(128, 160)} if code in ("cp1252", "cp1254") else {}), chars


def to_bytes(text: str, code: str) -> bytes | None:
    if code in ("cp932", "euc_jp"):
        try:
            return text.encode(code)
        except UnicodeEncodeError:
            return None
    of = table(code)[0]
    try:
        return bytes([of[c] for c in text])
    except KeyError:
        return None


@lru_cache(None)
def folding() -> tuple[np.ndarray, int]:
    """(class of each code point, number of classes): characters of the single-byte codes, kana and general punctuation for
    themselves, digits as one, blanks as one, all others by blocks of 256. The number does not depend on the corpus."""
    own = {ord(c) for code in SINGLE for c in table(code)[1]} | set(range(0x100, 0x180)) | set(range(0x2010, 0x2030))
    own |= set(range(0x3000, 0x3100)) | set(range(0xFF61, 0xFFA0)) | {0xFFFD}
    own -= set(range(0x30, 0x3A))
    out = np.zeros(0x110000, np.uint16)
    blocks = np.minimum(np.arange(0x110000) >> 8, 0x1FF)
    out[:] = blocks
    classes = 0x200
    for c in sorted(own):
        out[c] = classes
        classes += 1
    out[0x30:0x3A] = classes
    out[[0x09, 0x0A, 0x0D]] = out[0x20]  # words begin and end alike at all blanks
    return out, classes + 1


def classes_of(text: str) -> np.ndarray:
    return folding()[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)


def misread(word: str) -> int:
    """How many characters of several bytes the word has as UTF-8 read in a single-byte code; 0 where it isn't valid, or gives
    other scripts than Latin, Greek, Cyrillic and East Asian ones. In codes whose letters lie among the second bytes whole
    words are valid by chance (чем in cp866), so there PROOF such characters are needed."""
    if not _neighbours.search(word):
        return 0
    for wrong in SINGLE:
        raw = to_bytes(word, wrong)
        if raw is None:
            continue
        try:
            read = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        foreign = _foreign.findall(read)
        if len(foreign) >= (1 if wrong in PLAIN else PROOF) and len(read) < len(word) and not _unlikely.search(read):
            return len(foreign)
    return 0


def word_cell(word: str) -> int:
    return xxhash.xxh64_intdigest(_trim.sub("", word)) % WORDS


def count_pairs(frame: DataFrame, text: str) -> DataFrame:
    """(cell BIGINT, n BIGINT) over all texts: cells below the alphabet squared are pairs, the rest hashes of words with
    non-ASCII characters. Pairs of words that look misread are not counted. Each task adds up its own first; the number of cells is fixed."""
    pairs = folding()[1] ** 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = folding()[1]
        total = np.zeros(pairs, np.int64)
        words = np.zeros(WORDS, np.int64)
        cells: dict[str, int] = {}
        odd: dict[str, bool] = {}
        for batch in batches:
            texts = [t for t in batch["text"] if t]
            for i in range(0, len(texts), 500):
                joined = "\n".join(["", *texts[i : i + 500], ""])
                if len(odd) > 500_000:
                    odd.clear()
                for w in {w for w in _token.findall(joined) if not w.isascii()} - odd.keys():
                    odd[w] = bool(_odd.search(w)) or misread(w) > 0
                c = classes_of(_foreign_token.sub(lambda m: "" if odd[m[0]] else m[0], joined))
                total += np.bincount(c[:-1] * size + c[1:], minlength=pairs)
                seen = [w for w in joined.split() if not w.isascii()]
                if len(cells) > 500_000:
                    cells.clear()
                for w in seen:
                    if w not in cells:
                        cells[w] = word_cell(w)
                words += np.bincount([cells[w] for w in seen], minlength=WORDS) if seen else 0
        both = np.concatenate([total, words])
        at = np.flatnonzero(both)
        yield pd.DataFrame({"cell": at, "n": both[at]}).astype("int64")

    return frame.select(F.col(text).alias("text")).where("text <> ''").mapInPandas(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


class Pairs:
    """Counts of all pairs, and of words in a sketch; both sizes are fixed by the alphabet."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        self.size = folding()[1]
        both = np.zeros(self.size * self.size + WORDS, np.float32)
        both[cells] = counts
        self.n, self.words = both[: self.size * self.size], both[self.size * self.size :]
        self.total = float(max(1.0, self.n.sum(dtype=np.float64)))
        grid = self.n.reshape(self.size, self.size)
        self.first, self.second = grid.sum(1), grid.sum(0)

    def commoner(self, word: str, other: str) -> bool:
        """Whether the corpus has the first word more often."""
        return bool(self.words[word_cell(word)] > self.words[word_cell(other)])

    def improbability(self, c: np.ndarray) -> np.ndarray:
        """Of each adjacent pair: damped mutual information, negated, in bits; above 0 is improbable."""
        a, b = c[:-1], c[1:]
        expected = self.first[a] * self.second[b] / self.total
        return np.log2((expected + max(4.0, RARE * self.total)) / (self.n[a * self.size + b] + 0.5))

    def counts(self, text: str) -> np.ndarray:
        c = classes_of(text)
        return self.n[c[:-1] * self.size + c[1:]]

    def rates(self, text: str) -> np.ndarray:
        return (self.counts(text) + 0.05) / self.total


def segments(score: np.ndarray) -> list[tuple[int, int]]:
    """All maximum-scoring segments, as half-open ranges: the disjoint ones that no longer or shorter one beats."""
    found: list[list[float]] = []  # [start, stop, sum before, sum through]
    total = 0.0
    for i, s in enumerate(score.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(a), int(b)) for a, b, _, _ in found]


_token = re.compile(r"[^ \t\n\r]+")
_foreign = re.compile(r"[^\x00-\x7f]")
_foreign_token = re.compile(r"[^ \t\n\r\x80-\U0010ffff]*[\x80-\U0010ffff][^ \t\n\r]*")
_neighbours = re.compile(r"[^\x00-\x7f]{2}")
#: Characters that a misread word of the languages of such texts doesn't stand for.
_rare_mark = re.compile("[\u0329-\u036f]")
_unlikely = re.compile("[\x80-\x9f\ufffd\u0250-\u036f\u0530-\u1dff]")
_odd = re.compile("[\x80-\x9f\ufffd]")
#: The first byte of a character of four bytes that stands outside of words, without the rest.
_alone = re.compile(r"(?<![^\W\d_])\u00f0(?![^\W\d_])")
#: A character of three bytes of which one is missing.
_short = re.compile(rb"[\xe0-\xef][\x80-\xbf](?![\x80-\xbf])")
#: Codes whose control characters are dropped on the way.
DROPPING = ("latin-1", "cp1252", "iso8859_2")
#: What may stand for a letter in another code, letters apart.
_marks = frozenset("\u201c\u201d\u2018\u2019\u201e\u201a\u2026\u2013\u2014\u00ab\u00bb\u00b0\u00b5\u20ac\u00a3\u00a7\u00b6")
#: Code between runs of as many backticks.
_code_span = re.compile(r"(?<!`)(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")
_trim = re.compile(r"^[!-@\[-`{-~]+|[!-@\[-`{-~]+$")
#: Cells of the sketch that counts words.
WORDS = 1 << 20


class Restorer:
    """Tests words; remembers what it found out about each."""

    def __init__(self, pairs: Pairs):
        self.pairs = pairs
        self.known: dict[str, list[tuple[float, str, str]]] = {}

    def reading(self, word: str, depth: int = 0) -> list[tuple[float, str, str]]:
        """Readings as (gain in bits, restored word, codes). One of several bytes is the only one; a word garbled twice is read twice."""
        if depth == 0 and word in self.known:
            return self.known[word]
        several = self._several_bytes(word, depth)
        found = [several] if several else self._one_byte(word)
        if depth == 0 and not found and (less := self._dropped(word)):
            found = [less]
        if depth == 0:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def _several_bytes(self, word: str, depth: int) -> tuple[float, str, str] | None:
        best = None
        for wrong, right in MULTI:
            if wrong == "cp932" and len(word) < 2:
                continue
            raw = to_bytes(word, wrong)
            if raw is None:
                continue
            try:
                read = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if read == word or len(read) >= len(word) and right == "utf-8" and wrong != "cp932" or _odd.search(read) and not _odd.search(word):
                continue
            if _rare_mark.search(read) and not _rare_mark.search(word):
                continue
            name = f"{right} read as {wrong}"
            gain = self._gain(word, read)
            if right != "utf-8":
                if not any("ぁ" <= c <= "ん" for c in read) or any("｡" <= c <= "ﾟ" for c in read) or gain < GAIN:
                    continue
            elif depth < 2 and _foreign.search(read) and (again := self._several_bytes(read, depth + 1)):
                gain, read, name = gain + again[0], again[1], f"{name}, {again[2]}"
            elif not _odd.search(word) and misread(word) < PROOF and self._mean(read) <= self._mean(word):
                continue
            if best is None or gain > best[0]:
                best = (gain, read, name)
        return best

    def _dropped(self, word: str) -> tuple[float, str, str] | None:
        """The likeliest reading as UTF-8 of which one control character was dropped."""
        best = None
        for wrong in DROPPING:
            raw = to_bytes(word, wrong)
            for m in _short.finditer(raw or b""):
                for at in (m.start() + 1, m.end()):
                    for b in range(0x80, 0xA0):
                        try:
                            read = (raw[:at] + bytes([b]) + raw[at:]).decode("utf-8")
                        except UnicodeDecodeError:
                            continue
                        gain = self._gain(word, read)
                        if gain >= GAIN and not _unlikely.search(read) and (best is None or gain > best[0]):
                            best = (gain, read, f"utf-8 read as {wrong}, a control dropped")
        return best

    def _mean(self, word: str) -> float:
        return float(np.log2(self.pairs.rates(f" {word} ")).mean())

    def _gain(self, word: str, read: str) -> float:
        return float(np.log2(self.pairs.rates(f" {read} ")).sum() - np.log2(self.pairs.rates(f" {word} ")).sum())

    def _one_byte(self, word: str) -> list[tuple[float, str, str]]:
        if len(word) < 2 or not re.search(r"[^\W\d_]", word):
            return []
        before = self.pairs.counts(f" {word} ")
        base = float(np.log2(before + 0.05).sum())
        known, unknown = max(1.0, KNOWN * self.pairs.total), max(2.0, UNKNOWN * self.pairs.total)
        found = []
        for wrong in SINGLE:
            raw = to_bytes(word, wrong)
            if raw is None:
                continue
            for right in SINGLE:
                read = "".join([table(right)[1][b] for b in raw])
                if right == wrong or read == word or _odd.search(read):
                    continue
                after = self.pairs.counts(f" {read} ")
                gain = float(np.log2(after + 0.05).sum()) - base
                if any(x != y and x.isalpha() and not y.isalpha() and y not in _marks for x, y in zip(word, read)):
                    continue
                changed = [i for i, (x, y) in enumerate(zip(f" {word} ", f" {read} ")) if x != y]
                # Pairs within the word: what stands before and after it may be anything.
                touched = sorted({j for i in changed for j in (i - 1, i)} & set(range(1, len(word))))
                if gain >= GAIN and gain >= 2.5 * len(changed) and after[touched].min() >= known and before[touched].min() <= unknown:
                    found.append((gain, read, f"{right} read as {wrong}"))
        return found


def unescaped(text: str) -> str:
    """The string that the inside of a JSON string means."""
    try:
        return json.loads(f'"{text}"') if "\\" in text else text
    except ValueError:
        return text


def quoted_ranges(text: str, quoted: list[str] | None) -> list[tuple[int, int]]:
    """Code spans between backticks, and of each quoted string as many places, in order, as it is quoted."""
    out = [m.span() for m in _code_span.finditer(text)]
    for q, n in Counter(map(unescaped, quoted or ())).items():
        if _foreign.search(q):
            out += [m.span() for m in islice(re.finditer(re.escape(q), text), n)]
    return out


def examine(text: str, restorer: Restorer, quoted: list[str] | None = None) -> tuple[bool, str | None, list[str]]:
    """(whether garbled, the restored text or None where nothing could be, the codes found)."""
    if not text or not _foreign.search(text):
        return False, None, []
    spans = quoted_ranges(text, quoted)
    score = restorer.pairs.improbability(classes_of(f" {text} "))
    # Pairs of ASCII alone can't be garbled; they end segments.
    foreign = np.array([ord(c) > 127 for c in f" {text} "])
    score = np.where(foreign[:-1] | foreign[1:], score, -50.0)
    runs = []  # characters of the text touched, the last one included
    if (score > 0).any():
        near = np.flatnonzero(score > -50.0)
        for part in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1):
            if (score[part] > 0).any():
                runs += [(a - 1 + int(part[0]), b + int(part[0])) for a, b in segments(score[part])]
    if not runs:
        return False, None, []

    def quoted_at(a: int, b: int) -> bool:
        return any(x <= a and b <= y for x, y in spans)

    marks = sorted({p for a, b in runs for p in range(max(0, a), min(b + 1, len(text))) if ord(text[p]) > 127})
    garbled, kinds, edits, options = False, [], [], []
    done = 0
    for at in marks:
        if at < done:
            continue
        a, b = at, at + 1
        while a > 0 and text[a - 1] not in " \t\n\r":
            a -= 1
        while b < len(text) and text[b] not in " \t\n\r":
            b += 1
        done = b
        inside = [i for i in range(a, b) if ord(text[i]) > 127]
        if all(quoted_at(i, i + 1) for i in inside):
            continue
        if any(_odd.match(text, i) or _alone.match(text, i) for i in inside if not quoted_at(i, i + 1)):
            garbled = True
        options += [(x, y, found) for x, y in pieces(text, a, b, spans) if (found := restorer.reading(text[x:y]))]
    # The text as a whole decides among single-byte readings.
    total: dict[str, float] = {}
    for x, y, found in options:
        for gain, read, name in found:
            sure = len(found) == 1 and name.startswith(MULTIBYTE) or restorer.pairs.commoner(read, text[x:y])
            total[name] = total.get(name, 0.0) + gain * sure
    for x, y, found in options:
        gain, read, name = max(found, key=lambda f: (total[f[2]], f[0]))
        if total[name] >= TEXT_GAIN or len(found) == 1 and name.startswith(MULTIBYTE):
            edits.append((x, y, read))
            kinds.append(name)
    if not edits:
        return garbled, None, kinds
    out, at = [], 0
    for x, y, new in edits:
        out += [text[at:x], new]
        at = y
    return True, "".join(out) + text[at:], kinds


def pieces(text: str, a: int, b: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a word to test: all of it outside quotes, or the words in it if the whole doesn't read."""
    cuts = [a]
    for x, y in sorted(spans):
        if a <= x < b or a < y <= b:
            cuts += [max(a, x), min(b, y)]
    cuts.append(b)
    whole = [(x, y) for x, y in zip(cuts[::2], cuts[1::2]) if y > x and _foreign.search(text, x, y)]
    return whole


def restore(frame: DataFrame, key: str, text: str, quoted: Column | None = None) -> DataFrame:
    """(key, garbled BOOLEAN, restored STRING, codes ARRAY<STRING>): one row for each row.

    restored is null where the text isn't garbled or nothing could be restored. `quoted` is an ARRAY<STRING> column of
    strings, as they stand in JSON, that are only quoted in the text as examples; code spans between backticks are found without it. Null and empty
    texts are not garbled. All rows are counted and tested.
    """
    pairs = count_pairs(frame, text).toArrow()  # as many rows as the alphabet and the sketch have cells
    shared = frame.sparkSession.sparkContext.broadcast(Pairs(pairs["cell"].to_numpy(), pairs["n"].to_numpy()))

    @F.pandas_udf("garbled boolean, restored string, codes array<string>")
    def test(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(shared.value)
        for batch, quotes in texts:
            made = [(False, None, []) if t is None else examine(t, restorer, None if q is None else list(q)) for t, q in zip(batch, quotes)]
            yield pd.DataFrame({"garbled": [m[0] for m in made], "restored": [m[1] for m in made], "codes": [sorted(set(m[2])) for m in made]})

    held = F.when(F.col(text).rlike(r"[^\x00-\x7F]"), F.col(text))
    quotes = F.when(held.isNotNull(), quoted) if quoted is not None else F.lit(None).cast("array<string>")
    return frame.select(F.col(key), test(held, quotes).alias("t")).select(key, "t.garbled", "t.restored", "t.codes")
