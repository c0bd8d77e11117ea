"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

The pre-tokeniser never runs a regular expression. Code points map to classes
through one array; a class with its look-ahead is a symbol; a symbol is a
function on the states of a small automaton. Functions compose associatively,
so the state before every character comes from a prefix scan of function ids
(blocks scanned in parallel lanes, then the block totals scanned the same way).
The slices between boundaries are grouped by hash and each distinct slice is
merged once. Byte offsets of the slices are kept, and decoding joins the bytes
of the ids, which must give the text back exactly; a text for which they do not
(a hash collision) is encoded slice by slice instead.

Null and empty texts have no tokens. Rows are independent, so repeated rows and
ids give repeated results; an empty table gives no rows. Extra columns are ignored by
`digests` and pass through `encode` and `decode`, but for one of the new column's name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Code point classes.
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
# Symbols: a class, or a class with what its look-ahead says.
S_LETTER, S_NUMBER, S_OTHER, S_APOS1, S_APOS2, S_WHITE, S_WHITE_LAST, S_SPACE_LAST, S_RESET, S_SAME = range(10)
# States: what the current token is made of. FRESH: the next character starts one.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, OPEN_SPACE, ONE_MORE, TWO_MORE = range(8)

BLOCK = 64


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether the symbol starts a token."""
    if symbol == S_SAME:
        return state, False
    if symbol == S_RESET:
        return FRESH, False
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FRESH, False
    if symbol in (S_LETTER, S_NUMBER, S_OTHER):
        own = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHER}[symbol]
        return own, state not in (own, OPEN_SPACE)
    if symbol in (S_APOS1, S_APOS2):
        if state in (IN_OTHER, OPEN_SPACE):
            return IN_OTHER, False
        return (ONE_MORE if symbol == S_APOS1 else TWO_MORE), True
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    return (FRESH if symbol == S_WHITE_LAST else OPEN_SPACE), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """All compositions of the symbols' functions: values, products, symbols' ids, starts of tokens."""
    functions = [tuple(_step(q, s)[0] for q in range(8)) for s in range(10)]
    found = {f: i for i, f in enumerate(dict.fromkeys(functions))}
    todo = list(found)
    for f in todo:
        for g in functions:
            h = tuple(g[q] for q in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    k = len(found)
    product = np.zeros((k, k), np.uint16)
    for f, i in found.items():
        for g, j in found.items():
            product[i, j] = found[tuple(g[q] for q in f)]
    values = np.array(list(found), np.uint8)
    ids = np.array([found[f] for f in functions], np.uint16)
    begins = np.array([[_step(q, s)[1] for s in range(10)] for q in range(8)], bool)
    return values, product, ids, begins, k


VALUES, PRODUCT, SYMBOL_IDS, BEGINS, MONOID = _monoid()
_FLAT = PRODUCT.ravel()
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, as the tokenizer library's own Unicode tables have it.

    The library is asked once per worker, for one code point at a time and for
    classes only, so that both always go by the same version of Unicode.
    """
    if not _CLASSES:
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        single = {bytes([i]): i for i in range(256)}
        out = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
            found = bytes(tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
            out[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
        out[0x20] = SPACE
        _CLASSES.append(out)
    return _CLASSES[0]


def scan(ids: np.ndarray) -> np.ndarray:
    """For each position the id of the composition of all functions up to it."""
    n = len(ids)
    if n <= BLOCK:
        out = ids.copy()
        for i in range(1, n):
            out[i] = PRODUCT[out[i - 1], ids[i]]
        return out
    lanes = -(-n // BLOCK)
    same = SYMBOL_IDS[S_SAME]
    padded = np.full(lanes * BLOCK, same, np.uint16)
    padded[:n] = ids
    steps = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)
    for j in range(1, BLOCK):
        np.take(_FLAT, steps[j - 1].astype(np.intp) * MONOID + steps[j], out=steps[j])
    totals = scan(steps[-1].copy())
    carry = np.empty(lanes, np.intp)
    carry[0] = same
    carry[1:] = totals[:-1]
    out = _FLAT[carry[None, :] * MONOID + steps]
    return np.ascontiguousarray(out.T).ravel()[:n]


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens start, over rows that lie one after another."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    rows = len(offsets) - 1
    begins = np.searchsorted(lead, offsets[:-1])
    seats = np.ones(len(points) + rows + 3, bool)  # a reset stands before each row, three after all
    seats[begins + np.arange(rows)] = False
    seats[-3:] = False
    n = len(points) + rows
    point = np.zeros(n + 3, np.uint32)
    point[seats] = points
    kind = np.full(n + 3, 255, np.uint8)
    kind[seats] = classes()[points]
    symbol = np.full(n, S_RESET, np.uint8)
    now, then = kind[:n], kind[1 : n + 1]
    symbol[now == LETTER] = S_LETTER
    symbol[now == NUMBER] = S_NUMBER
    symbol[now == OTHER] = S_OTHER
    white = (now == WHITE) | (now == SPACE)
    symbol[white] = S_WHITE
    last = white & (then < SPACE)
    symbol[last] = S_WHITE_LAST
    symbol[last & (now == SPACE)] = S_SPACE_LAST
    at = np.flatnonzero(point[:n] == 0x27)
    if len(at):
        one, two = point[at + 1], point[at + 2]
        symbol[at[np.isin(one, [ord(c) for c in "stmd"])]] = S_APOS1
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[at[pair]] = S_APOS2
    after = VALUES[scan(SYMBOL_IDS[symbol]), FRESH]
    before = np.empty(n, np.uint8)
    before[0] = FRESH
    before[1:] = after[:-1]
    starts = BEGINS[before, symbol][seats[:n]]
    return lead[starts]


class Merger:
    """Pair merging by rank for many pieces at once, with a bounded cache of finished pieces.

    A pair merges when its bytes together are in the vocabulary; the lowest rank
    goes first, the leftmost among equals. All pieces' symbols lie in one array
    and each piece makes one merge a round; pieces over LONG bytes go through a
    heap instead, which costs n log n. Finished pieces are found again by hash in
    sorted arrays, which start with the vocabulary itself.
    """

    CACHE, RECENT, LONG = 600_000, 50_000, 64
    NONE = np.iinfo(np.int32).max

    def __init__(self, ranks: dict[bytes, int], pairs: dict[int, int] | None = None):
        """`pairs`: the id that left << 32 | right merges to, ids being in the order of merging; else all pairs whose bytes together are in `ranks`."""
        self.ranks = ranks
        self.pairs = pairs = pairs if pairs is not None else {(left << 32) | right: rank for piece, rank in ranks.items() for i in range(1, len(piece)) if (left := ranks.get(piece[:i])) is not None and (right := ranks.get(piece[i:])) is not None}
        self.slots = 1 << max(10, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(self.slots, -1, np.int64), np.full(self.slots, self.NONE, np.int32)
        for at, (key, rank) in zip(self._slot(np.fromiter(pairs, np.int64, len(pairs))).tolist(), pairs.items(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) % self.slots
            self.keys[at], self.values[at] = key, rank
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        order = sorted(ranks, key=ranks.get)
        self.flat = np.frombuffer(b"".join(order), np.uint8)
        sizes = np.array([len(x) for x in order], np.int64)
        top = ranks[order[-1]] + 1
        ids = np.array([ranks[x] for x in order])
        self.begin, self.size = np.zeros(top, np.int64), np.zeros(top, np.int64)
        self.begin[ids], self.size[ids] = np.cumsum(sizes) - sizes, sizes
        begins = self.begin[ids]
        self.vocabulary = self._sorted(common.span_hashes(self.flat, begins, begins + sizes), np.ones(len(ids), np.int64), ids.astype(np.int32))
        self.main, self.recent = self.vocabulary, self._sorted(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    @staticmethod
    def _sorted(hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple:
        """(hashes, starts, counts, ids) with the hashes in order."""
        order = np.argsort(hashes, kind="stable")
        return hashes[order], (np.cumsum(counts) - counts)[order], counts[order], ids

    def _joined(self, a: tuple, b: tuple) -> tuple:
        hashes = np.concatenate([a[0], b[0]])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], np.concatenate([a[1], b[1] + len(a[3])])[order], np.concatenate([a[2], b[2]])[order], np.concatenate([a[3], b[3]])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (common.mix(keys.view(np.uint64)) & np.uint64(self.slots - 1)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], self.NONE)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) % self.slots
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (there >= 0)
            todo, at = todo[more], at[more]
        return out

    def distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces with different hashes: starts and counts among ids, and the ids."""
        begin, count, ids = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), []
        todo, base = np.arange(len(hashes)), 0
        for known, where, sizes, flat in (self.main, self.recent):
            if len(known) and len(todo):
                at = np.minimum(np.searchsorted(known, hashes[todo]), len(known) - 1)
                hit = known[at] == hashes[todo]
                begin[todo[hit]], count[todo[hit]] = where[at[hit]] + base, sizes[at[hit]]
                todo = todo[~hit]
            ids.append(flat)
            base += len(flat)
        if len(todo):
            counts, new = self.merged(data, starts[todo], ends[todo])
            begin[todo], count[todo] = np.cumsum(counts) - counts + base, counts
            ids.append(new)
            short = ends[todo] - starts[todo] <= self.LONG
            self.recent = self._joined(self.recent, self._sorted(hashes[todo[short]], counts[short], new[np.repeat(short, counts)]))
            if len(self.recent[0]) > self.RECENT:
                full = len(self.main[0]) + len(self.recent[0]) > self.CACHE
                self.main = self._joined(self.vocabulary if full else self.main, self.recent)
                self.recent = self._sorted(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        return begin, count, np.concatenate(ids)

    def merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of each piece's ids, and the ids one after another."""
        sizes = ends - starts
        short = np.flatnonzero(sizes <= self.LONG)
        owner = np.repeat(short, sizes[short])
        symbols = self.bytes[data[common.ranges(starts[short], sizes[short])]]
        done = [(np.full(len(x), k), np.array(x, np.int32)) for k in np.flatnonzero(sizes > self.LONG).tolist() for x in [self.merge(data[starts[k] : ends[k]].tobytes())]]
        pair = self._ranked(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            firsts = np.flatnonzero(np.diff(owner, prepend=-1))
            lengths = np.diff(firsts, append=len(owner))
            least = np.minimum.reduceat(pair, firsts)
            over = np.repeat(least == self.NONE, lengths)
            if over.any():
                done.append((owner[over], symbols[over]))
                keep = ~over
                symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
                lengths, least = lengths[least != self.NONE], least[least != self.NONE]
            hits = np.flatnonzero(pair == np.repeat(least, lengths))
            hits = hits[np.diff(owner[hits], prepend=-1) != 0]
            symbols[hits] = pair[hits]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            at = hits - np.arange(len(hits))
            symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
            pair[at] = self._ranked(symbols, owner, at)
            before = at[at > 0] - 1
            before = before[owner[before] == owner[before + 1]]
            pair[before] = self._ranked(symbols, owner, before)
        if not done:
            return np.zeros(len(starts), np.int64), np.zeros(0, np.int32)
        owners = np.concatenate([o for o, _ in done])
        order = np.argsort(owners, kind="stable")
        return np.bincount(owners, minlength=len(starts)), np.concatenate([x for _, x in done])[order]

    def _ranked(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that start at these places; NONE at the ends of pieces."""
        out = np.full(len(at), self.NONE, np.int32)
        inner = np.flatnonzero(at + 1 < len(symbols))
        inner = inner[owner[at[inner]] == owner[at[inner] + 1]]
        out[inner] = self.pair_ranks(symbols[at[inner]], symbols[at[inner] + 1])
        return out

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """One long piece: pairs wait in a heap by rank, then place."""
        n, pairs = len(piece), self.pairs
        symbol = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := pairs.get(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            if symbol[i] != left or (j := nxt[i]) >= n or symbol[j] != right:
                continue  # one of the two has merged since
            symbol[i], symbol[j], nxt[i] = rank, -1, nxt[j]
            if (k := nxt[i]) < n:
                prev[k] = i
                if (r := pairs.get(rank << 32 | symbol[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, symbol[k]))
            if (k := prev[i]) >= 0 and (r := pairs.get(symbol[k] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, k, symbol[k], rank))
        return tuple(x for x in symbol if x >= 0)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        return self.flat[common.ranges(self.begin[ids], self.size[ids])]


_MERGERS: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """The merger of a rank file, loaded once in each worker."""
    if path not in _MERGERS:
        with open(path, "rb") as lines:
            _MERGERS[path] = Merger({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
    return _MERGERS[path]


def encode_rows(data: np.ndarray, offsets: np.ndarray, merge: Merger) -> tuple[np.ndarray, np.ndarray]:
    """All rows' ids one after another, and the rows' bounds among them."""
    starts = token_starts(data, offsets)
    ends = np.append(starts[1:], len(data))
    rows = np.searchsorted(starts, offsets)
    hashes, first, inverse = np.unique(common.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    begin, counts, flat = merge.distinct(data, starts[first], ends[first], hashes)
    counts = counts[inverse]
    ids = flat[common.ranges(begin[inverse], counts)]
    bounds = np.concatenate([[0], np.cumsum(counts)])[rows]
    decoded = merge.decode(ids)
    if len(decoded) != len(data) or not np.array_equal(decoded, data):
        each = [encode_plainly(data[offsets[k] : offsets[k + 1]], merge) for k in range(len(offsets) - 1)]
        ids = np.concatenate([*each, np.zeros(0, np.int32)])
        bounds = np.cumsum([0, *map(len, each)])
    return ids, bounds


def encode_plainly(data: np.ndarray, merge: Merger) -> np.ndarray:
    """One text's ids slice by slice, without the hashes."""
    starts = token_starts(data, np.array([0, len(data)]))
    whole, ends = data.tobytes(), np.append(starts[1:], len(data))
    pieces = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    ids = [(rank,) if (rank := merge.ranks.get(x)) is not None else merge.merge(x) for x in pieces]
    return np.array([i for x in ids for i in x], np.int32)


def encode_slices(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, rows' bounds among the ids) of bounded slices, in order."""
    merge = merger(path)
    for a, b, data, offsets in common.text_slices(column):
        yield a, b, *encode_rows(data, offsets, merge)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with a column of token ids, last; a column that has its name already is replaced."""
    schema = docs.drop(ids).schema
    names = schema.names

    def run(batches):
        for batch in batches:
            flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for _, _, own, bounds in encode_slices(batch.column(names.index(text)), path):
                flat.append(own)
                sizes.append(np.diff(bounds))
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(flat), pa.int32()))], names=[*names, ids])

    from pyspark.sql import types as T

    return common.map_batches(docs.drop(ids), run, T.StructType([*schema, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """`encoded` with a column of the texts its ids stand for, last; null ids give an empty text, and a column that has its name already is replaced."""
    from pyspark.sql import types as T

    rest = encoded.drop(text)
    names = rest.schema.names

    def run(batches):
        merge = merger(path)
        for batch in batches:
            out = [merge.decode(np.array(x or (), np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, text])

    return common.map_batches(rest, run, T.StructType([*rest.schema, T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        merge = merger(path)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for _, _, ids, bounds in encode_slices(batch.column(1), path):
                sizes = np.concatenate([[0], np.cumsum(merge.size[ids])])[bounds].tolist()
                decoded, packed = memoryview(merge.decode(ids)), memoryview(ids.astype("<u4"))
                at = bounds.tolist()
                counts += np.diff(bounds).tolist()
                of_ids += [hashlib.sha256(packed[x:y]).hexdigest() for x, y in zip(at, at[1:], strict=False)]
                of_bytes += [hashlib.sha256(decoded[x:y]).hexdigest() for x, y in zip(sizes, sizes[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
