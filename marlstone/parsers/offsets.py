"""Where bytes of a transformed text stood in the text it was made of."""

from __future__ import annotations

from bisect import bisect_right


class OffsetMap:
    """Edits in rising order: so many bytes at a place of the new text stand for so many of the old one."""

    def __init__(self):
        self.at: list[int] = []
        self.edits: list[tuple[int, int, int]] = []  # new start, new length, old start, in bytes
        self.olds: list[int] = []
        self.shift = 0

    def edit(self, at: int, new: int, old: int) -> None:
        self.at.append(at)
        self.edits.append((at, new, at + self.shift))
        self.olds.append(old)
        self.shift += old - new

    def _old(self, place: int, end: bool) -> int:
        i = bisect_right(self.at, place) - 1
        if i < 0:
            return place
        start, new, old = self.edits[i]
        if place >= start + new:
            return old + self.olds[i] + place - start - new
        return old + (self.olds[i] if end and place > start else 0)

    def range(self, span: tuple[int, int]) -> tuple[int, int]:
        """A range that begins or ends inside an edit covers all of it."""
        return self._old(span[0], False), self._old(span[1], True)


def decode_newlines(text: str) -> tuple[str, OffsetMap]:
    """Escaped line ends as line ends."""
    out, edits, at = [], OffsetMap(), 0
    size = 0
    while True:
        nxt = text.find("\\n", at)
        cr = text.find("\\r\\n", at)
        if cr >= 0 and (nxt < 0 or cr < nxt):
            nxt, old = cr, 4
        else:
            old = 2
        if nxt < 0:
            out.append(text[at:])
            return "".join(out), edits
        out += [text[at:nxt], "\n"]
        size += len(text[at:nxt].encode())
        edits.edit(size, 1, old)
        size += 1
        at = nxt + old
