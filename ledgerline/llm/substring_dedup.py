"""Substring deduplication with a compressed FM-index per shard.

A window is `length` consecutive words of one document. A window whose words also
start earlier (smaller id, or the same document further left) loses the words it
covers; windows are judged on the input.

Documents are cut into runs of consecutive windows with the same minimiser (the
least hash of eight-word grams inside a window). Equal windows have equal
minimisers, so only runs whose minimiser occurs more than once can hold repeats,
and all occurrences of a window meet in the shard of its minimiser. Each shard
indexes its distinct run texts: a suffix array over word numbers, sorted as deep
as a window needs, the Burrows-Wheeler transform in a wavelet matrix of packed
bits, and boundaries of equal (length - 1)-word prefixes. The runs of the
documents are then streamed through backward search: `length` steps to the left
give the interval of the last window, and every further step drops the word at
the right, widens the interval to its (length - 1)-word prefix and takes the next
word at the left. Windows whose match is `length` words in more than one place
are reported; all but the first lose their words.

A minimiser with more than HOT runs is salted over several shards by document and
place. Each of them settles its own windows and passes on one row for every distinct
window, and these rows are settled by an aggregate. Shards are as many as the words
of all repeated runs ask for, at SHARD_WORDS each.

Null and empty texts have no words. Null ids count as the greatest id. A document is
an id and a text: rows that repeat both are one document, so equal places in them are
not earlier than each other, and each row loses the same words; rows of one id with
different texts are documents in the order of their texts' hashes. Extra columns
pass through `dedup`; `digests` returns its own four columns.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 20, 8
#: Runs of one minimiser in one shard, and words a shard aims at.
HOT, SHARD_WORDS = 8_000, 400_000
#: Windows of a run; longer ones (of texts that repeat themselves) are cut.
RUN_WINDOWS = 64
#: Hot minimisers up to this many (24 bytes each) are broadcast; beyond it they are joined like the others.
BROADCAST_HOT = 200_000
#: Per-document marks up to this size are broadcast to the texts; beyond it both sides are shuffled.
BROADCAST_BYTES = 48 << 20
_LAST = np.iinfo(np.int64).max


class Runs:
    """The runs of all rows of one slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.starts, self.ends, self.bounds = common.scan_words(data, offsets)
        words = common.span_hashes(data, self.starts, self.ends)
        none = np.zeros(0, np.int64)
        self.row = self.first = self.count = none
        self.value, self.several = np.zeros(0, np.uint64), np.zeros(0, bool)
        if len(words) < length:
            return
        grams = common.window_hashes(words, GRAM)
        width = length - GRAM + 1
        least, have = grams, 1
        while have * 2 <= width:
            least, have = np.minimum(least[:-have], least[have:]), have * 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        at = np.flatnonzero(owner[: len(least)] == owner[length - 1 :])
        if not len(at):
            return
        value = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (value[1:] != value[:-1])
        begin = np.flatnonzero(new)
        new |= (np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))) % RUN_WINDOWS == 0
        begin = np.flatnonzero(new)
        self.count = np.diff(begin, append=len(at))
        at, self.value = at[begin], value[begin]
        self.row = owner[at]
        self.first = at - self.bounds[self.row]
        spans = self.count + width - 1
        same = grams[common.ranges(at, spans)] == np.repeat(self.value, spans)
        self.several = np.add.reduceat(same, np.cumsum(spans) - spans, dtype=np.int64) > 1  # a run may repeat itself
        self.rows = np.searchsorted(self.row, np.arange(len(offsets)))


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence; bits are packed, with a count every 64."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        depth = max(1, int(symbols - 1).bit_length())
        n = len(sequence)
        for level in range(depth - 1, -1, -1):
            bits = ((sequence >> level) & 1).astype(bool)
            packed = np.packbits(np.append(bits, np.zeros(-n % 64 + 64, bool)), bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32)
            self.levels.append((level, packed, counts, n - int(bits.sum())))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])
        self.starts = np.zeros(symbols, np.int64)
        self.starts = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        for level, packed, counts, zeros in self.levels:
            word = at >> 6
            below = (one << (at & 63).astype(np.uint64)) - one
            ones = counts[word] + np.bitwise_count(packed[word] & below)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbols, at) - self.starts[symbols]


class FMIndex:
    """An index of word sequences, exact for patterns of up to `depth` words."""

    def __init__(self, symbols: np.ndarray, size: int, depth: int):
        """`symbols`: numbers from 1 with a 0 after every sequence; `size`: one more than the largest."""
        n = len(symbols)
        bits = max(1, int(size - 1).bit_length())
        pack = max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        for j in range(pack):
            key <<= bits
            key[: n - j] |= symbols[j:]
        rank, have = np.unique(key, return_inverse=True)[1].astype(np.int32), pack
        while have < depth:
            key[:] = rank
            key *= n + 1
            key[: max(0, n - have)] += rank[have:] + 1
            rank, have = np.unique(key, return_inverse=True)[1].astype(np.int32), have * 2
        del key
        suffixes = np.argsort(rank, kind="stable").astype(np.int32)
        del rank
        self.size = size
        self.bwt = WaveletMatrix(symbols[suffixes - 1], size)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        # Where the prefixes of depth - 1 words change: lengths of common prefixes are compared word by word.
        last = np.append(symbols, np.zeros(depth, symbols.dtype))
        same = np.ones(n - 1, bool)
        for j in range(depth - 1):
            here = last[suffixes + j]
            same &= here[1:] == here[:-1]
        begins = np.concatenate([[0], np.flatnonzero(~same) + 1])
        group = np.cumsum(np.concatenate([[0], ~same]))
        self.left = begins.astype(np.int32)[group]
        self.right = np.append(begins[1:], n).astype(np.int32)[group]

    def step(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after taking one more word at the left."""
        base = self.before[symbols]
        return base + self.bwt.rank(symbols, lo), base + self.bwt.rank(symbols, hi)

    def widen(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after dropping the last of `depth` words."""
        return self.left[lo], self.right[hi - 1]


def window_classes(symbols: np.ndarray, begins: np.ndarray, counts: np.ndarray, size: int, length: int) -> np.ndarray:
    """For the windows of sequences (at `begins`, `counts` windows each), one after another, the lower ends of their intervals.

    Equal windows have equal ends. Windows that match nowhere else have intervals of one.
    """
    index = FMIndex(symbols, size, length)
    out = np.zeros(int(counts.sum()), np.int64)
    slot = np.cumsum(counts) - counts
    lo, hi = np.zeros(len(begins), np.int64), np.full(len(begins), len(symbols), np.int64)
    last = begins + counts - 1 + length - 1
    for j in range(length):
        lo, hi = index.step(symbols[last - j], lo, hi)
    out[slot + counts - 1] = lo
    left = np.flatnonzero(counts > 1)
    at = counts[left] - 2
    lo, hi = lo[left], hi[left]
    while len(left):
        lo, hi = index.widen(lo, hi)
        lo, hi = index.step(symbols[begins[left] + at], lo, hi)
        out[slot[left] + at] = lo
        more = at > 0
        left, at, lo, hi = left[more], at[more] - 1, lo[more], hi[more]
    return out


def _intervals(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]


_MARKS = pa.schema([("doc", pa.int64()), ("text", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("value", pa.int64()), ("check", pa.int64())])
_MARK_TYPES = "doc long, text long, first int, last int, value long, check long"


def settle_shard(table: pa.Table, length: int) -> pa.Table:
    """Marks of repeated windows (check null), and for salted minimisers one row for each distinct window."""
    doc, text = (table.column(c).to_numpy() for c in ("doc", "text"))
    first, count = table.column("first").to_numpy().astype(np.int64), table.column("count").to_numpy().astype(np.int64)
    value, salted = table.column("value").to_numpy(), table.column("salted").to_numpy(zero_copy_only=False)
    parts, spans = [], []
    for _, _, data, offsets in common.text_slices(table.column("words")):
        starts, ends, bounds = common.scan_words(data, offsets)
        parts.append(common.span_hashes(data, starts, ends))
        spans.append(np.diff(bounds))
    hashes, sizes = np.concatenate(parts), np.concatenate(spans)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    del parts, spans
    # Runs with the same words are indexed and searched for once.
    steps = np.arange(len(hashes)) - np.repeat(bounds[:-1], sizes)
    whole = np.add.reduceat(common.mix(hashes + steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), bounds[:-1])
    _, one, which = np.unique(whole, return_index=True, return_inverse=True)
    del steps, whole
    spans = sizes[one] + 1
    begins = np.cumsum(spans) - spans
    distinct, numbers = np.unique(hashes[common.ranges(bounds[:-1][one], spans - 1)], return_inverse=True)
    symbols = np.zeros(int(spans.sum()), np.int32)
    symbols[common.ranges(begins, spans - 1)] = numbers + 1
    del numbers
    found = window_classes(symbols, begins, count[one], len(distinct) + 1, length)
    del symbols, distinct
    slot = np.cumsum(count[one]) - count[one]
    cls = found[common.ranges(slot[which], count)]
    run = np.repeat(np.arange(len(doc)), count)
    at = common.ranges(first, count)
    order = np.lexsort((at, text[run], doc[run], cls))
    new = np.ones(len(order), bool)
    new[1:] = cls[order][1:] != cls[order][:-1]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    late = np.zeros(len(order), bool)
    mine, its = run[order], run[lead]
    late[order] = (doc[mine] != doc[its]) | (text[mine] != text[its]) | (at[order] != at[lead])
    marks = [np.zeros(0, np.int64)] * 4
    gone = np.flatnonzero(late)
    if len(gone):
        cut = np.concatenate([[0], np.flatnonzero((np.diff(gone) != 1) | (run[gone][1:] != run[gone][:-1])) + 1])
        stop = np.append(cut[1:], len(gone)) - 1
        marks = [doc[run[gone[cut]]], text[run[gone[cut]]], at[gone[cut]], at[gone[stop]]]
    firsts = order[new]
    firsts = firsts[salted[run[firsts]]]
    n, m = len(marks[0]), len(firsts)
    windows = common.window_hashes(hashes, length)[bounds[:-1][run[firsts]] + at[firsts] - first[run[firsts]]] if m else np.zeros(0, np.uint64)
    nulls = np.concatenate([np.ones(n, bool), np.zeros(m, bool)])
    return pa.Table.from_arrays(
        [
            pa.array(np.concatenate([marks[0], doc[run[firsts]]])),
            pa.array(np.concatenate([marks[1], text[run[firsts]]])),
            pa.array(np.concatenate([marks[2], at[firsts]]).astype(np.int32)),
            pa.array(np.concatenate([marks[3], at[firsts]]).astype(np.int32)),
            pa.array(np.concatenate([np.zeros(n, np.int64), value[run[firsts]]])),
            pa.array(np.concatenate([np.zeros(n, np.int64), windows.view(np.int64)]), mask=nulls),
        ],
        schema=_MARKS,
    )


def _beside(docs: DataFrame, rows: DataFrame, size, doc: str, text: str) -> DataFrame:
    """`docs` left-joined by its columns `doc` and `text` with `rows` (doc, text, ...), which are broadcast only if they are small."""
    total = rows.select(F.sum(size + F.lit(64))).first()[0] or 0
    rows = rows.withColumnsRenamed({"doc": doc, "text": text})
    return docs.join(F.broadcast(rows) if total <= BROADCAST_BYTES else rows, [doc, text], "left")


def _key(doc: str = "__doc", text: str = "__hash") -> list[Column]:
    """The columns that tell documents apart: the id (nulls last) and the text's hash."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias(doc), F.xxhash64("text").alias(text)]


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, text, spans): first and last start of each stretch of windows that start earlier elsewhere, for each document (id and text hash) that has any."""
    own = docs.select(*_key(), "text")

    def minimisers(batches):
        for batch in batches:
            for a, b, data, offsets in common.text_slices(batch.column(2)):
                runs = Runs(data, offsets, length)
                rows = runs.rows if len(runs.row) else np.zeros(b - a + 1, np.int64)
                values = [np.concatenate([runs.value[x:y], runs.value[x:y][runs.several[x:y]]]) for x, y in zip(rows[:-1], rows[1:], strict=True)]
                bounds = np.cumsum([0, *map(len, values)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), common.int64(np.concatenate([*values, np.zeros(0, np.uint64)])))
                windows = np.concatenate([[0], np.cumsum(runs.count)])
                sizes = [pa.array(x.astype(np.int32)) for x in (np.diff(rows), np.diff(windows[rows]))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(2)), lists, *sizes], names=["doc", "text", "values", "n", "windows"])

    cut = common.checkpointed(own.mapInArrow(minimisers, "doc long, text long, values array<long>, n int, windows int").filter("n > 0"))
    shared = common.checkpointed(cut.select(F.explode("values").alias("value")).groupBy("value").agg(F.count("*").alias("runs")).filter("runs > 1"))
    hot = common.checkpointed(shared.filter(F.col("runs") > HOT).select("value", F.ceil(F.col("runs") / HOT).cast("int").alias("salts")))
    n_hot = hot.count()
    few = n_hot <= BROADCAST_HOT
    # A document's repeated minimisers are all it takes to find its runs again.
    places = cut.select("doc", "text", F.explode(F.slice("values", F.lit(1), F.col("n"))).alias("value"))
    if n_hot and few:
        often = places.join(F.broadcast(hot), "value", "left_semi")
        found = places.join(F.broadcast(hot), "value", "left_anti").join(shared, "value", "left_semi").unionByName(often)
    else:
        found = places.join(shared, "value", "left_semi")
    flagged = common.checkpointed(found.groupBy("doc", "text").agg(F.collect_set("value").alias("values")))
    marked = _beside(own, flagged, F.size("values") * 8, "__doc", "__hash").filter(F.col("values").isNotNull()).select("__doc", "__hash", "text", "values")

    def regions(batches):
        for batch in batches:
            lists = batch.column(3)
            for a, b, data, offsets in common.text_slices(batch.column(2)):
                runs = Runs(data, offsets, length)
                if not len(runs.row):
                    continue
                keep = np.zeros(len(runs.row), bool)
                for k in range(b - a):
                    x, y = runs.rows[k], runs.rows[k + 1]
                    keep[x:y] = np.isin(runs.value[x:y].view(np.int64), lists[a + k].values.to_numpy())
                at = np.flatnonzero(keep)
                if not len(at):
                    continue
                begin = runs.bounds[runs.row[at]] + runs.first[at]
                lo, hi = runs.starts[begin], runs.ends[begin + runs.count[at] + length - 2]
                sizes = hi - lo
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(data[common.ranges(lo, sizes)])])
                mine = pa.array(a + runs.row[at])
                out = [common.int64(runs.value[at]), batch.column(0).take(mine), batch.column(1).take(mine), pa.array(runs.first[at].astype(np.int32)), pa.array(runs.count[at].astype(np.int32)), words.cast(pa.large_string()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["value", "doc", "text", "first", "count", "words"])

    found = marked.mapInArrow(regions, "value long, doc long, text long, first int, count int, words string")
    found = found.join(F.broadcast(hot) if few else hot, "value", "left")
    sums = cut.agg(F.sum("n"), F.sum("windows")).first()
    runs = shared.agg(F.sum("runs")).first()[0] or 0
    words = runs * (length - 1 + (sums[1] or 0) / max(1, sums[0] or 0))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(words / SHARD_WORDS))
    shard = F.pmod(F.xxhash64("value", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc", "text", "first"), "salts"))), F.lit(shards)).cast("int")
    found = found.select(shard.alias("shard"), "value", "doc", "text", "first", "count", "words", F.col("salts").isNotNull().alias("salted"))
    marks = common.checkpointed(found.groupBy("shard").applyInArrow(lambda t: settle_shard(t, length), _MARK_TYPES))
    firsts = marks.filter(F.col("check").isNotNull())
    place = F.struct("doc", "text", "first")
    lead = firsts.groupBy("value", "check").agg(F.min(place).alias("lead"))
    late = firsts.join(lead, ["value", "check"]).filter(place != F.col("lead")).select("doc", "text", "first", "last")
    spans = marks.filter(F.col("check").isNull()).select("doc", "text", "first", "last").unionByName(late)

    def united(batches):
        for batch in batches:
            out = []
            for spans in batch.column(2):
                spans = spans.values
                first, last = spans.field(0).to_numpy(), spans.field(1).to_numpy()
                a, b = _intervals(np.unique(common.ranges(first.astype(np.int64), (last - first + 1).astype(np.int64))))
                out.append(np.stack([a, b], axis=1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc", "text", "spans"])

    return spans.groupBy("doc", "text").agg(F.collect_list(F.struct("first", "last")).alias("spans")).mapInArrow(united, "doc long, text long, spans binary")


def removed(n_words: int, spans: bytes | None, length: int = LENGTH) -> np.ndarray:
    """Which words are covered."""
    edges = np.zeros(n_words + 1, np.int64)
    if spans:
        at = np.frombuffer(spans, "<i4").reshape(-1, 2)
        np.add.at(edges, at[:, 0], 1)
        np.add.at(edges, at[:, 1] + length, -1)
    return np.cumsum(edges[:-1]) > 0


def kept_words(text: str | None, spans: bytes | None, length: int = LENGTH) -> tuple[int, list[bytes]]:
    """Number of words before, and the words that stay."""
    words = (text or "").encode().split()
    lost = removed(len(words), spans, length)
    return len(words), [words[i] for i in np.flatnonzero(~lost).tolist()] if lost.any() else words


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    spans = common.checkpointed(repeated(docs, length))
    own = docs.select("doc_id", *_key(), "text")

    def run(batches):
        for batch in batches:
            n, gone, digest = [], [], []
            for text, marks in zip(batch.column(1), batch.column(2), strict=True):
                words, kept = kept_words(text.as_py(), marks.as_py(), length)
                n.append(words)
                gone.append(words - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _beside(own, spans, F.length("spans"), "__doc", "__hash").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with repeated windows' words gone from `text`; texts that lose words are their kept words, joined by one space."""
    spans = common.checkpointed(repeated(docs, length))
    columns = docs.columns
    doc, text, marks = common.fresh(docs, "doc", "hash", "spans")
    own = docs.select(*map(common.column, columns), *_key(doc, text))
    at = columns.index("text")

    def run(batches):
        for batch in batches:
            out = [t if m is None else b" ".join(kept_words(t, m, length)[1]).decode() for t, m in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.column(at).type) if i == at else batch.column(i) for i in range(len(columns))], names=columns)

    found = _beside(own, spans.withColumnRenamed("spans", marks), F.length(marks), doc, text)
    return common.map_batches(found.select(*map(common.column, columns), marks), run, docs.schema)


SQL = r"""
WITH w AS (
  SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)
), windows AS (
  SELECT *, string_agg(word, ' ') OVER span AS words, count(*) OVER span AS n
  FROM w WINDOW span AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), late AS (
  SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY n = 20, words ORDER BY doc_id, i) > 1 AS late FROM windows
), covered AS (
  SELECT *, bool_or(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM late
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM covered GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""
