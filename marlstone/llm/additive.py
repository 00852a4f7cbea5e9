"""Additive quantisation for cosine search, in numpy: training, beam-search encoding, lookup-table scoring.

A vector is approximated by a sum of full-dimensional codewords, one of each codebook. Codebooks are trained one after
another on the residuals of the ones before. Encoding keeps a beam of the best partial sums. The norm of each sum is
stored, so that a score is the sum of table entries, one for each codebook, over that norm.
"""

from __future__ import annotations

import ctypes
from functools import cached_property, lru_cache

import numpy as np

F32 = np.float32
#: Vectors encoded at once, so that what they need stays in the cache.
BLOCK = 256


@lru_cache(None)
def one_thread() -> None:
    """A task has a core; matrix products on more threads than that only wait for each other."""
    try:
        with open("/proc/self/maps", encoding="utf-8") as file:
            paths = {line.split()[-1] for line in file if "openblas" in line}
        for path in paths:
            library = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)
                    break
    except OSError:
        pass


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).astype(F32)


def spread(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool) -> np.ndarray:
    """k centres of x; empty ones are put on random rows. Fewer rows than centres give the rows."""
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return x.astype(F32).copy()
    centres = x[rng.choice(len(x), k, replace=False)].astype(F32).copy()
    for _ in range(rounds):
        score = x @ centres.T
        if not spherical:
            score -= 0.5 * (centres * centres).sum(1)
        near = score.argmax(1)
        order = np.argsort(near, kind="stable")
        counts = np.bincount(near, minlength=k)
        sums = np.add.reduceat(x[order], np.minimum(np.concatenate([[0], counts.cumsum()[:-1]]), len(x) - 1), axis=0)
        empty = counts == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centres = unit(sums) if spherical else (sums / np.maximum(counts, 1)[:, None]).astype(F32)
    return centres


class Codebooks:
    def __init__(self, sample: np.ndarray, books: int = 8, words: int = 256, rounds: int = 8, beam: int = 3, seed: int = 1):
        self.beam = beam
        rest, made = sample.astype(F32), []
        for m in range(books):
            book = spread(rest, words, rounds, seed + m, False)
            if len(book) < words:
                book = np.concatenate([book, np.zeros((words - len(book), sample.shape[1]), F32)])
            near = (rest @ book.T - 0.5 * (book * book).sum(1)).argmax(1)
            rest = rest - book[near]
            made.append(book)
        self.books = np.stack(made)

    @cached_property
    def gram(self) -> np.ndarray:
        """[i, j, word of i, word of j]: products of codewords, made where they are used rather than sent."""
        books, words, dimension = self.books.shape
        flat = self.books.reshape(-1, dimension)
        return (flat @ flat.T).reshape(books, words, books, words).transpose(0, 2, 1, 3).copy()

    def __getstate__(self) -> dict:
        return {"beam": self.beam, "books": self.books}

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes uint8, norm of each approximation). Of equal codewords the first wins."""
        parts = [self._encode(x[i : i + BLOCK]) for i in range(0, max(1, len(x)), BLOCK)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, (books, words, _) = len(x), self.books.shape
        codes = np.zeros((n, 1, books), np.uint8)
        cost = np.zeros((n, 1), F32)  # squared error less the squared norm of x
        for m in range(books):
            # |x - s - c|^2 = |x - s|^2 - 2 x.c + 2 s.c + |c|^2
            step = (self.gram[m, m].diagonal() - 2 * (x @ self.books[m].T))[:, None, :] + cost[:, :, None]
            for j in range(m):
                step += 2 * self.gram[j, m][codes[:, :, j]]
            flat = step.reshape(n, -1)
            keep = min(self.beam, flat.shape[1]) if m < books - 1 else 1
            every, best, cost = np.arange(n), np.empty((n, keep), np.int64), np.empty((n, keep), F32)
            for k in range(keep):
                best[:, k] = flat.argmin(1)
                cost[:, k] = flat[every, best[:, k]]
                flat[every, best[:, k]] = np.inf
            codes = np.take_along_axis(codes, (best // words)[:, :, None], 1)
            codes[:, :, m] = best % words
        codes = codes[:, 0]
        return codes, np.maximum(np.linalg.norm(self.decode(codes), axis=1), 1e-6).astype(F32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.books.shape[2]), F32)
        for m in range(len(self.books)):
            out += self.books[m][codes[:, m]]
        return out

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """[code row, query]: approximate cosines, by one table of all codewords for each query."""
        tables = self.books @ queries.T  # [book, word, query]
        out = tables[0][codes[:, 0]]
        for m in range(1, len(self.books)):
            out += tables[m][codes[:, m]]
        out /= norms[:, None]
        return out


def shortlist(scores: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of at least the `wanted` best rows of each query, and not many more.

    A threshold is read off a part of the rows; where it lets too few through, the query's rows are ranked in full.
    """
    rows, queries = scores.shape
    if rows <= 2 * wanted:
        return tuple(np.indices(scores.shape).reshape(2, -1))
    step = max(1, rows // 800)
    part = np.ascontiguousarray(scores[::step].T)
    size = part.shape[1]
    rank = min(size - 1, int(1.2 * wanted * size / rows) + 1)
    limit = np.partition(part, size - 1 - rank, axis=1)[:, size - 1 - rank]
    found = np.flatnonzero(scores >= limit)
    at, cols = found // queries, found % queries
    few = np.flatnonzero(np.bincount(cols, minlength=queries) < wanted)
    if len(few):
        low = np.partition(np.ascontiguousarray(scores[:, few].T), rows - wanted, axis=1)[:, rows - wanted]
        limit[few] = np.minimum(limit[few], low)
        found = np.flatnonzero(scores >= limit)
        at, cols = found // queries, found % queries
    return at, cols


class Cells:
    """Cells named by the words of residual codebooks: the first level has the centres of the vectors, the next those of
    what is left, and so on. There are as many levels as the number of cells needs, so that cells grow in number with the
    data while the codebooks stay small and a bounded sample places them all."""

    #: Words of one level at most.
    WORDS = 256

    def __init__(self, sample: np.ndarray, wanted: float, seed: int = 1):
        self.books: list[np.ndarray] = []
        rest = sample
        while wanted >= 1.5:
            book = spread(rest, min(self.WORDS, round(wanted)), 10, seed + len(self.books), not self.books)
            rest = rest - book[(rest @ book.T - 0.5 * (book * book).sum(1)).argmax(1)]
            self.books.append(book)
            if len(book) == 1:
                break
            wanted /= len(book)

    def __len__(self) -> int:
        return int(np.prod([len(b) for b in self.books], dtype=np.int64)) if self.books else 1

    def near(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells, squared distances less |x|^2) of the nearest cells of each vector, at most `beam`, nearest first."""
        if not self.books:
            return np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), F32)
        parts = [self._near(x[i : i + 1024], beam) for i in range(0, max(1, len(x)), 1024)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _near(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        cells, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), F32)
        sums = np.zeros((len(x), 1, x.shape[1]), F32)
        for level, book in enumerate(self.books):
            step = ((book * book).sum(1) - 2 * (x @ book.T))[:, None, :] + cost[:, :, None]
            if level:
                step += 2 * (sums @ book.T)
            flat = step.reshape(len(x), -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.broadcast_to(np.arange(keep), flat.shape)
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
            cost = np.take_along_axis(flat, best, 1)
            of, word = best // len(book), best % len(book)
            cells = np.take_along_axis(cells, of, 1) * len(book) + word
            if level + 1 < len(self.books):
                sums = np.take_along_axis(sums, of[:, :, None], 1) + book[word]
        return cells, cost


def found_among(books: Codebooks, x: np.ndarray, exact, query: np.ndarray, base: np.ndarray, codes: np.ndarray, norms: np.ndarray, floors: np.ndarray | None, at_least: float, wanted: int, k: int, block: int = 64):
    """Yields (rows of queries, rows of bases, exact cosines): of each query the k best bases with a cosine of at_least.

    x are all vectors at length 1, in 32 bits; query and base are rows of it. Table scores of all codes make the
    shortlist: those above their floor, if there are floors, else the `wanted` best. exact(a, b) gives cosines in doubles.
    """
    codes = codes.astype(np.intp)
    for at in range(0, len(query), block):
        q = query[at : at + block]
        tables = books.books @ x[q].T  # [book, word, query]
        scores = tables[0][codes[:, 0]]
        for m in range(1, codes.shape[1]):
            scores += tables[m][codes[:, m]]
        if floors is None:
            scores /= norms[:, None]
            rows, cols = shortlist(scores, wanted)
        else:
            rows, cols = np.nonzero(scores >= floors[:, None])
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
        near = np.empty(len(rows), F32)
        for i in range(0, len(rows), 1 << 16):
            near[i : i + (1 << 16)] = np.einsum("ij,ij->i", x[base[rows[i : i + (1 << 16)]]], x[q[cols[i : i + (1 << 16)]]])
        # 32 bits decide what is compared in doubles, with room for their error.
        over = near >= at_least - 1e-5
        rows, cols, near = rows[over], cols[over], near[over]
        order = np.lexsort((rows, -near, cols))
        rows, cols = rows[order], cols[order]
        keep = np.arange(len(cols)) - np.searchsorted(cols, np.arange(len(q)))[cols] < 2 * k
        rows, cols = rows[keep], cols[keep]
        cosines = exact(q[cols], base[rows])
        over = cosines >= at_least
        rows, cols, cosines = rows[over], cols[over], cosines[over]
        order = np.lexsort((rows, -cosines, cols))
        rows, cols, cosines = rows[order], cols[order], cosines[order]
        keep = np.arange(len(cols)) - np.searchsorted(cols, np.arange(len(q)))[cols] < k
        yield q[cols[keep]], base[rows[keep]], cosines[keep]
