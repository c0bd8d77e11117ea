"""Line deduplication by range-partitioned hashes and per-document keep bitmaps.

A line's key is the line without ASCII white space at both ends, A-Z in lower
case. Keys found in at least `min_docs` documents lose all their lines. Hashes
of the keys are range-partitioned and sorted by hash, document and position, so
even one very frequent key is spread over many partitions. Each partition is
streamed once: a run of equal keys is held only until it has `min_docs`
documents, then its rows pass straight through. Runs cut by a partition's ends
leave at most min_docs - 1 documents each and are settled together afterwards.
What comes back is a compressed bitmap of kept lines for each document that
loses any; texts are never shuffled with their lines.

Null and empty texts are one empty line, which has no key and stays. A document
is a doc_id; null ids count as one document. Rows that repeat an id each keep
their own bitmap (found by the id and the text's hash). An empty table gives no rows. Extra
columns pass through `dedup`, whatever their names; `digests` ignores them.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bitmaps up to this size in all are broadcast; beyond it both sides are shuffled by document.
BROADCAST_BYTES = 32 << 20

_LINES = "__hi long, __lo long, __doc long, __text long, __pos int, __n int"
_FOUND = _LINES + ", __state int"
DROP, OPEN, MARK = range(3)


def split_lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def key_of(line: bytes) -> bytes:
    return line.strip(common.WHITE).lower()


def _line_rows(batches):
    for batch in batches:
        ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b, data, offsets in common.text_slices(batch.column(2)):
            raw = data.tobytes()
            digests, doc, text, pos, size = [], [], [], [], []
            for k in range(b - a):
                lines = raw[offsets[k] : offsets[k + 1]].split(b"\n")
                n = len(lines)
                for i, line in enumerate(lines):
                    key = line.strip(common.WHITE).lower()
                    if key:
                        digests.append(xxhash.xxh3_128_digest(key))
                        doc.append(ids[a + k])
                        text.append(hashes[a + k])
                        pos.append(i)
                        size.append(n)
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(doc, pa.int64()), pa.array(text, pa.int64()), pa.array(pos, pa.int32()), pa.array(size, pa.int32())],
                names=["__hi", "__lo", "__doc", "__text", "__pos", "__n"],
            )


def _stream(min_docs: int):
    """Rows of a sorted partition with what becomes of them; rows of rare keys inside it go."""

    def emit(table: pa.Table, rows: np.ndarray, state: int):
        out = table.take(pa.array(rows)).append_column("__state", pa.array(np.full(len(rows), state, np.int32)))
        return out.combine_chunks().to_batches()

    def settle(table: pa.Table, starts: np.ndarray, first: bool, cut: np.ndarray, last: int):
        """Of whole runs: frequent ones are dropped; rare ones only matter at the partition's ends."""
        n = table.num_rows
        sizes = np.diff(starts, append=n)
        docs = table.column("__doc")
        known = docs.combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        null = docs.is_null().to_numpy()
        new = np.ones(n, bool)
        new[1:] = (known[1:] != known[:-1]) | (null[1:] != null[:-1])
        new[starts] = True
        counts = np.add.reduceat(new.astype(np.int64), starts)
        often = counts >= min_docs
        edge = np.zeros(len(starts), bool)
        if first:
            edge[0] = True
        if last >= 0:
            edge[last] = True
        for rows, state in ((np.repeat(often, sizes), DROP), (np.repeat(~often & edge, sizes), OPEN)):
            if rows.any():
                yield from emit(table, np.flatnonzero(rows), state)
        if (often & edge).any():
            yield from emit(table, starts[often & edge], MARK)

    def run(batches):
        held: pa.Table | None = None  # rows of the last run, not yet min_docs documents
        passing: tuple[int, int] | None = None  # the key whose rows pass straight through
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if passing is not None:
                hi, lo = table.column("__hi").to_numpy(), table.column("__lo").to_numpy()
                other = np.flatnonzero((hi != passing[0]) | (lo != passing[1]))
                n = int(other[0]) if len(other) else len(hi)
                if n:
                    yield from emit(table, np.arange(n), DROP)
                if n == len(hi):
                    continue
                passing, table = None, table.slice(n)
            if held is not None:
                table = pa.concat_tables([held, table])
                held = None
            hi, lo = table.column("__hi").to_numpy(), table.column("__lo").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1])
            tail = table.slice(int(starts[-1]))
            docs = len(set(tail.column("__doc").to_pylist()))
            if len(starts) > 1:
                yield from settle(table.slice(0, int(starts[-1])), starts[:-1], first, starts, -1)
                first = False
            if docs >= min_docs:
                yield from emit(tail, np.arange(tail.num_rows), DROP)
                yield from emit(tail, np.zeros(1, np.int64), MARK)
                passing, first = (int(hi[-1]), int(lo[-1])), False
            else:
                held = tail.combine_chunks()
        if held is not None:
            yield from settle(held, np.zeros(1, np.int64), first, None, 0)

    return run


def _bitmaps(batches):
    for batch in batches:
        sizes, maps = [], []
        for n, positions in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[positions] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            sizes.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], names=["__doc", "__text", "__dropped", "__keep"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(__doc, __text hash, __dropped, __keep): a zlib-compressed bitmap of the kept lines of each row that loses any."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").mapInArrow(_line_rows, _LINES)
    order = ["__hi", "__lo", "__doc", "__text", "__pos"]
    found = common.checkpointed(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), _FOUND))
    cut = found.filter(F.col("__state") != DROP)
    often = cut.groupBy("__hi", "__lo").agg(F.max("__state").alias("__mark"), F.size(F.collect_set(F.coalesce(F.col("__doc").cast("string"), F.lit("")))).alias("__docs")).filter((F.col("__mark") == MARK) | (F.col("__docs") >= min_docs))
    late = found.filter(F.col("__state") == OPEN).join(often.select("__hi", "__lo"), ["__hi", "__lo"], "left_semi")
    lost = found.filter(F.col("__state") == DROP).unionByName(late)
    return lost.groupBy("__doc", "__text").agg(F.max("__n").alias("__n"), F.collect_set("__pos").alias("__at")).mapInArrow(_bitmaps, "__doc long, __text long, __dropped long, __keep binary")


def with_bitmaps(docs: DataFrame, min_docs: int = 10) -> tuple[DataFrame, str, str]:
    """`docs` with columns of dropped lines and bitmaps, null where no line goes, and the names of these two."""
    doc, text, dropped, keep, own = common.fresh(docs, "doc", "text", "dropped", "keep", "hash")
    maps = common.checkpointed(keep_bitmaps(docs, min_docs)).toDF(doc, text, dropped, keep)
    size = maps.select(F.sum(F.length(keep) + F.lit(48))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        maps = F.broadcast(maps)
    hashed = docs.withColumn(own, F.xxhash64("text"))
    return hashed.join(maps, hashed["doc_id"].eqNullSafe(maps[doc]) & (hashed[own] == maps[text]), "left").drop(doc, text, own), dropped, keep


def kept_text(text: str | None, keep: bytes | None) -> tuple[int, bytes]:
    """Number of lines before, and the kept lines' bytes."""
    lines = split_lines(text)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
        return len(lines), b"\n".join([x for x, k in zip(lines, bits.tolist(), strict=True) if k])
    return len(lines), b"\n".join(lines)


def digests(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped and the SHA-256 of the kept lines."""

    def run(batches):
        for batch in batches:
            out = [kept_text(t, k) for t, k in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in out], pa.int64()), batch.column(2).fill_null(0), pa.array([hashlib.sha256(x).hexdigest() for _, x in out], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    own, dropped, keep = with_bitmaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_docs)
    return own.select("doc_id", "text", dropped, keep).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """`docs` with frequent lines gone from `text`; n_chars, where there is one, follows."""
    columns = docs.columns
    marked, _, keep = with_bitmaps(docs, min_docs)
    at = columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            out = [t if k is None else kept_text(t, k)[1].decode() for t, k in zip(texts.to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(columns))], names=columns)

    out = common.map_batches(marked.select(*map(common.column, columns), keep), run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line,
         translate(regexp_replace(regexp_replace(parts[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), frequent AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f ON lines.k = f.k GROUP BY doc_id
"""
