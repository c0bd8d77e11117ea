"""Spelling variant grouping: words one edit apart, without comparing words by pairs.

Words are counted in SQL expressions. Every word then gives the hash of each
string that is left when one of its letters is deleted, and of itself: prefix
and suffix polynomial hashes give all of a batch's keys by a few NumPy
operations, in time proportional to its letters. Keys are dealt out and sorted
as integers; keys that stand alone go. The words of the others are fetched by
their numbers, dealt out by key again, and told apart by the remaining strings
themselves, so a collision of hashes joins nothing.

Words that share a remaining string are one edit apart if one is that string
itself (an insertion), or if they can have lost their letters at the same place
(a replacement). Deleting any letter of a run of equal letters leaves the same
string, so a word gives one key a run, with the run's first and last place.
Within such a group words are counted at every place and each word meets the
best two words of the place, so a group costs its size and no pairs are made.
Two words one edit apart meet at exactly one string and place.

A word's form is its most frequent near word (ties: smallest in code-point
order), if that is at least `ratio` times as frequent as the word. Forms grow in
frequency, so chains end after a few steps; roots are found by pointer doubling.

Odd rows: null and empty texts have no words; a null id stands as '' in what is
hashed. Rows that repeat an id are all counted. Words of any length are whole;
long ones meet like others, by numbers, and their letters travel only with keys
that other words share. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_LETTERS = 7
MIN_COUNT = 2
RATIO = 10
#: One in so many runs of a document is misspelt on purpose, by its hash.
ODDS = 31

#: Letters after A-Z have become a-z: all are below U+0100, a byte each in Latin-1.
LETTERS = r"[a-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_KEYS = "key long, id long, lo int, hi int"
_NEAR = "id long, near long, n long, word string"


def planted_words(docs: DataFrame, odds: int = ODDS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """One row for each run of at least `min_letters` letters that are left, with one letter gone where its hash says so."""
    runs = F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), F.lit(f"{LETTERS}{{{min_letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8"))).withColumn("at", F.expr("cast(h % length(run) as int)"))
    word = F.when(F.col("h") % odds == 0, F.expr("concat(substring(run, 1, at), substring(run, at + 2))")).otherwise(F.col("run"))
    return rows.select(word.alias("word")).filter(F.length("word") >= min_letters)


def counted(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def deletion_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, lo, hi, key): a row for each run of equal letters of each word, and one for the word itself (lo = hi = -1)."""
    n = len(data)
    sizes = np.diff(offsets)
    values = common._TABLE[data] * common._powers(common._BASE, n + 1)[:n]
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=prefix[1:])
    back = common._powers(common._BASE_INV, n + 2)
    first = np.ones(n, bool)
    first[1:] = data[1:] != data[:-1]
    first[offsets[:-1][sizes > 0]] = True
    lo = np.flatnonzero(first)
    word = np.searchsorted(offsets, lo, "right") - 1
    hi = np.append(lo[1:], n) - 1
    begin, end = offsets[word], offsets[word + 1]
    # What stands before the gap keeps its powers; what stands behind it moves up by one letter.
    left = (prefix[lo] - prefix[begin]) * back[begin]
    right = (prefix[end] - prefix[lo + 1]) * back[begin + 1]
    step = np.uint64(0x9E3779B97F4A7C15)
    gone = common.mix(left + right + (sizes[word] - 1).astype(np.uint64) * step)
    whole = common.mix((prefix[offsets[1:]] - prefix[offsets[:-1]]) * back[offsets[:-1]] + sizes.astype(np.uint64) * step)
    none = np.full(len(sizes), -1, np.int64)
    return np.concatenate([word, np.arange(len(sizes))]), np.concatenate([lo - begin, none]), np.concatenate([hi - begin, none]), np.concatenate([gone, whole])


def _keys(bits: int):
    """Keys of batches of words, of so many bits."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            letters = [w.encode("latin-1") for w in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, letters)])
            data = np.frombuffer(b"".join(letters), np.uint8)
            for a, b in common.row_slices(offsets):
                word, lo, hi, key = deletion_keys(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([common.int64(key >> np.uint64(64 - bits)), pa.array(ids[a:b][word]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["key", "id", "lo", "hi"])

    return run


def _shared(batches):
    """Rows of sorted keys that have a neighbour with the same key."""
    held: pa.Table | None = None
    last: int | None = None  # key of the row held back, whose next row is not known yet
    alone = True
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = table.column("key").to_numpy()
        same = keys[1:] == keys[:-1]
        keep = np.zeros(len(keys), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if held is not None and not alone:
            keep[0] = True
        alone, last = not keep[-1], len(keys) - 1
        keep[-1] = False  # handed on with the next batch
        held = table.slice(last)
        if keep.any():
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()
    if held is not None and not alone:
        yield from held.to_batches()


def _best(rows: list[tuple]) -> list[tuple]:
    """The two most frequent, ties by the smaller word."""
    one = two = None
    for row in rows:
        if one is None or (-row[1], row[2]) < (-one[1], one[2]):
            one, two = row, one
        elif two is None or (-row[1], row[2]) < (-two[1], two[2]):
            two = row
    return [one, two]


def near_of(members: list[tuple[int, int, str, int, int]]) -> list[tuple[int, int, int, str]]:
    """(id, near words, n and word of the best) within the words of one remaining string; members are (id, n, word, lo, hi)."""
    out = []
    itself = [m for m in members if m[3] < 0]
    rest = [m for m in members if m[3] >= 0]
    if itself and rest:
        best = _best(rest)[0]
        out.append((itself[0][0], len(rest), best[1], best[2]))
        out += [(m[0], 1, itself[0][1], itself[0][2]) for m in rest]
    if len(rest) > 1:
        places: dict[int, list[tuple]] = {}
        for m in rest:
            for at in range(m[3], m[4] + 1):
                places.setdefault(at, []).append(m)
        for there in places.values():
            if len(there) > 1:
                one, two = _best(there)
                for m in there:
                    best = two if m is one else one
                    out.append((m[0], len(there) - 1, best[1], best[2]))
    return out


def _verified(batches):
    """Near words within runs of a key, split by the remaining strings."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)

    out: list[tuple] = []
    for _, run in itertools.groupby(rows(), key=lambda r: r[0]):
        by: dict[str, list[tuple]] = {}
        for _, i, lo, hi, n, word in run:
            by.setdefault(word if lo < 0 else word[:lo] + word[lo + 1 :], []).append((i, n, word, lo, hi))
        for members in by.values():
            if len(members) > 1:
                out += near_of(members)
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "near", "n", "word"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "near", "n", "word"])


def near_words(words: DataFrame, bits: int = 64) -> DataFrame:
    """(id, n_near, best_n, best): words (id, word, n) that have any word one edit away, with how many and the most frequent. Fewer bits of a key only make more collisions."""
    keys = words.select("id", "word").mapInArrow(_keys(bits), _KEYS)
    shared = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, _KEYS)
    met = shared.join(words.select("id", "n", "word"), "id").select("key", "id", "lo", "hi", "n", "word")
    found = met.repartition("key").sortWithinPartitions("key").mapInArrow(_verified, _NEAR)
    best = found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct(F.negative("n").alias("less"), "word")).alias("b"))
    return best.select("id", "n_near", F.negative("b.less").alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where each word's forms, (word, form), end. Forms are more frequent than their words, so there are no cycles."""
    links = common.checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        step = links.select(F.col("word").alias("w"), F.col("root").alias("next"))
        links = common.checkpointed(links.join(step, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if links.filter("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, bits: int = 64) -> DataFrame:
    """word, form, root, n, n_near, form_n of counted words (word, n)."""
    numbered = common.checkpointed(words.withColumn("id", F.monotonically_increasing_id()))
    far = F.col("best_n") >= ratio * F.col("n")
    judged = common.checkpointed(numbered.join(near_words(numbered, bits), "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best")).alias("form"), F.when(far, F.col("best_n")).alias("form_n")))
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def groups(docs: DataFrame) -> DataFrame:
    """Spelling variants among all words of `docs`."""
    return variants(counted(planted_words(docs)))


#: crc32 is not among the functions of the SQL engine, so it is computed from its 256 remainders.
SQL = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), runs AS (
  SELECT doc, run, count(*) AS times FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents)
  GROUP BY ALL
), bytes AS (SELECT *, hex(encode(doc || ':' || run)) AS x FROM runs
), crc AS (
  SELECT doc, run, times, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, p, 2))::BIGINT)), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8))) AS h FROM bytes, crc_table
), words AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM (SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM crc)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), gone AS MATERIALIZED (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gone g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gone g JOIN words w ON g.rest = w.word
), judged AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(c.n_near, 0) AS n_near, CASE WHEN c.best_n >= 10 * w.n THEN c.best END AS form, CASE WHEN c.best_n >= 10 * w.n THEN c.best_n END AS form_n
  FROM words w LEFT JOIN (SELECT word, count(*) AS n_near, max(other_n) AS best_n, first(other ORDER BY other_n DESC, other) AS best FROM near GROUP BY word) c USING (word)
), chains AS (
  SELECT word, word AS last, 0 AS steps FROM judged
  UNION ALL SELECT c.word, j.form, c.steps + 1 FROM chains c JOIN judged j ON c.last = j.word WHERE j.form IS NOT NULL
), ends AS (SELECT word, max_by(last, steps) AS root FROM chains GROUP BY word)
SELECT j.word, j.form, e.root, j.n, j.n_near::BIGINT AS n_near, j.form_n FROM judged j JOIN ends e USING (word)
"""
