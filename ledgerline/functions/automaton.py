"""Many fixed strings found in many texts by one pass: an Aho-Corasick automaton over array tables.

Texts are one stream of bytes with a reset between rows. The stream is cut into
chunks of equal length that overlap by the longest string, all chunks take a step at
once, and a step is two array look-ups; so a pass costs the bytes of the texts,
whatever the number of strings, and a single very long text is as fast as many
short ones.

Strings are written with a space between words. In the texts any run of white
space and hyphens between words counts as one separator: a space if it is only
white space, a hyphen if it holds one. Positions are those of the text itself.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts of a pass, and of a chunk's own part.
SLICE_BYTES, CHUNK_BYTES = 1 << 20, 1 << 10
#: Between rows; no byte of UTF-8.
RESET = 0xFF

_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
_BREAK = _BLANK.copy()
_BREAK[ord("-")] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True


class Automaton:
    """All occurrences of `strings` (lower case, ASCII) in lower-case texts."""

    def __init__(self, strings: Sequence[str]):
        self.strings = list(strings)
        coded = [s.encode("ascii") for s in self.strings]
        if not all(coded):
            raise ValueError("a string is empty")
        self.longest = max(map(len, coded), default=1)
        letters = sorted(set(b"".join(coded)))
        self.classes = np.zeros(256, np.int64)
        self.classes[letters] = np.arange(1, len(letters) + 1)
        width = len(letters) + 1
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for number, string in enumerate(coded):
            at = 0
            for c in string:
                c = int(self.classes[c])
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append([])
                at = children[at][c]
            ends[at].append(number)
        # A missing step goes where the longest proper suffix goes, so states are filled by depth.
        go = np.zeros((len(children), width), np.int64)
        suffix = [0] * len(children)
        queue = deque()
        for c, to in children[0].items():
            go[0, c] = to
            queue.append(to)
        while queue:
            at = queue.popleft()
            ends[at] += ends[suffix[at]]
            go[at] = go[suffix[at]]
            for c, to in children[at].items():
                suffix[to] = int(go[suffix[at], c])
                go[at, c] = to
                queue.append(to)
        self.go, self.width = (go * width).ravel(), width
        self.counts = np.array([len(e) for e in ends], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.ends = np.array([n for e in ends for n in e], np.int64)
        self.sizes = np.array([len(s) for s in coded], np.int64)

    def _states(self, stream: np.ndarray) -> np.ndarray:
        """The state after each byte of a stream."""
        over = self.longest - 1
        chunks = -(-len(stream) // CHUNK_BYTES)
        padded = np.zeros(over + chunks * CHUNK_BYTES, np.int64)
        padded[over : over + len(stream)] = self.classes[stream]
        # Row k holds chunk k with what stands before it; columns are steps.
        steps = np.lib.stride_tricks.sliding_window_view(padded, over + CHUNK_BYTES)[::CHUNK_BYTES].T.copy()
        state = np.zeros(chunks, np.int64)
        out = np.empty((CHUNK_BYTES, chunks), np.int32)
        for j, classes in enumerate(steps):
            state = self.go[state + classes]
            if j >= over:
                out[j - over] = state
        return (out.T.ravel()[: len(stream)]) // self.width

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, string, start, end): all occurrences in the rows of `data`, byte positions of `data`, sorted by end."""
        none = np.zeros(0, np.int64)
        if not len(data) or not self.strings:
            return none, none, none, none
        # Runs of separators become one byte, a hyphen if they hold one; a reset follows each row.
        broken = _BREAK[data]
        begins = np.ones(len(data), bool)
        begins[1:] = ~(broken[1:] & broken[:-1])
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(begins)
        stream = np.where(broken[at], ord(" "), data[at])
        hyphens = np.searchsorted(at, np.flatnonzero(data == ord("-")), "right") - 1
        stream[hyphens] = ord("-")
        row_ends = np.searchsorted(at, offsets[1:])
        stream = np.insert(stream, row_ends, RESET)
        at = np.insert(at, row_ends, -1)
        states = self._states(stream.astype(np.uint8))
        hit = np.flatnonzero(self.counts[states])
        if not len(hit):
            return none, none, none, none
        n = self.counts[states[hit]]
        end = np.repeat(hit, n)
        string = self.ends[np.repeat(self.first[states[hit]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        start, stop = at[end - self.sizes[string] + 1], at[end] + 1
        return np.searchsorted(offsets, start, "right") - 1, string, start, stop


def stands_alone(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether no letter, digit or underscore (ASCII) precedes and follows each span within its row."""
    left, right = start == offsets[row], end == offsets[row + 1]
    if len(start):
        left |= ~_WORD[data[start - 1]]
        right |= ~_WORD[data[np.minimum(end, len(data) - 1)]]
    return left, right


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, end row, bytes, offsets from 0) of a string column, null as empty, in slices of bounded size; a longer row stands alone."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
