"""Token counts by the whole-token shortcut.

Offline, once per worker, every vocabulary string is put through the tokenizer's
own pre-tokenisation and merges. Those that come out as one piece and one token
are proven whole: a pre-token equal to one of them counts one, without merging.
Only the other distinct pre-tokens are merged. Strings of special tokens inside
a text are single tokens that also cut the text, as the library has it by default.

The tokens found must give the bytes back; a slice of texts for which they do not (a
collision of hashes) is merged pre-token by pre-token instead.

Null and empty texts count 0 tokens and 0 bytes. Rows are counted one by one, so
repeated rows and ids repeat; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts of tokens for one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_of()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = [x.encode() for x in special]
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {bytes(of[c] for c in t): i for t, i in vocabulary.items()}
        pairs, last = {}, -1
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            to = vocabulary[left + right]
            if to <= last:
                raise ValueError("ids must follow the order of merges")
            last = to
            pairs[vocabulary[left] << 32 | vocabulary[right]] = to
        self.merge = bpe.Merger(ranks, pairs)
        self.whole = self._proven(self.merge)
        data, offsets = self._rows(self.whole)
        hashes = common.span_hashes(data, offsets[:-1], offsets[1:])
        self.merge.vocabulary = self.merge.main = self.merge._sorted(hashes, np.ones(len(hashes), np.int64), np.array([ranks[x] for x in self.whole], np.int32))

    @staticmethod
    def _rows(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in pieces], dtype=np.int64)])

    @classmethod
    def _proven(cls, merge: bpe.Merger) -> list[bytes]:
        """Vocabulary strings that encode alone as exactly one token."""
        pieces = []
        for x in merge.ranks:
            try:
                x.decode()
                pieces.append(x)
            except UnicodeDecodeError:
                pass  # never a pre-token: those end between characters
        data, offsets = cls._rows(pieces)
        cuts = np.searchsorted(bpe.token_starts(data, offsets), offsets)
        counts, _ = merge.merged(data, offsets[:-1], offsets[1:])
        return [x for x, one, n in zip(pieces, (np.diff(cuts) == 1).tolist(), counts.tolist(), strict=True) if one and n == 1]

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        if self.special:
            raw = data.tobytes()
            if any(x in raw for x in self.special):
                return self._with_special(raw, offsets)
        return self._plain(data, offsets)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts = bpe.token_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes, first, inverse = np.unique(common.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        begin, counts, flat = self.merge.distinct(data, starts[first], ends[first], hashes)
        counts = counts[inverse]
        decoded = self.merge.decode(flat[common.ranges(begin[inverse], counts)])
        if len(decoded) != len(data) or not np.array_equal(decoded, data):
            whole = data.tobytes()
            counts = np.array([len(self.merge.merge(whole[a:b])) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        sums = np.concatenate([[0], np.cumsum(counts)])
        return np.diff(sums[np.searchsorted(starts, offsets)])

    def _with_special(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Each stretch between special strings is a row of its own; the strings count one each."""
        parts, owner, extra = [], [], np.zeros(len(offsets) - 1, np.int64)
        for k in range(len(offsets) - 1):
            own = [raw[offsets[k] : offsets[k + 1]]]
            for mark in self.special:
                cut = [x.split(mark) for x in own]
                extra[k] += sum(len(x) - 1 for x in cut)
                own = [y for x in cut for y in x]
            parts += own
            owner += [k] * len(own)
        return extra + np.bincount(owner, self._plain(*self._rows(parts)), len(extra)).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def counts(docs: DataFrame, limit: int = 1024, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        of = counter(path)
        for batch in batches:
            sizes, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in common.text_slices(batch.column(1)):
                sizes.append(np.diff(offsets))
                tokens.append(of.rows(data, offsets))
            n = np.concatenate(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
