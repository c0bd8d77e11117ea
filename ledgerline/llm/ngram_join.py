"""N-gram Jaccard self join by filtering under several global token orders.

A document's set is its distinct k-word shingles, as 64-bit hashes. Two sets
link when their Jaccard similarity is at least num/den. Such sets share many
tokens among the first of any global order, which gives filters that lose
nothing; a pair has to pass all of them before its sets are compared.

1. By hash order. A prefix is long enough for two linked sets to share at least
   `depth` of its tokens. Only prefixes are shuffled; documents that share fewer
   than that with all others together drop out here.
2. By rarity (number of sets, then hash) among the shared prefix tokens of the
   rest: linked sets also share one of the first of these. Each such token gives
   a star to its smallest document, so the number of candidate links is the
   number of rows, however many documents share the token.
3. Candidate components are joined locally. There both orders, recounted on the
   whole sets, must share a prefix token, then the sets are compared. Documents
   that verified links already connect are not compared again. A component with
   more tokens than a block holds is dealt to one task for each pair of blocks.

Equal sets are one vertex from the start: of exact copies one prefix a partition is
shuffled, and one text in all is compared.
Texts without words have an empty set and no link; texts with fewer than k words
have their whole word sequence as one shingle. Rows that repeat an id
count as linked only through their sets; a null id takes the component of an equal set,
if there is one, and else null. An empty table gives no rows. Extra columns are ignored by
`join` and pass through `one_of_each`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

K, NUM, DEN, DEPTH_SHARE = 5, 80, 100, 10
#: Tokens of a block in the local join (8 bytes each).
BLOCK_TOKENS = 1 << 20
#: Hashes of sets that a partition remembers, to leave out repeated prefixes.
REMEMBERED = 200_000
#: Up to this many candidate documents are broadcast to find their texts; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000


def least_overlap(n, num: int = NUM, den: int = DEN):
    """The tokens that a set of n shares with any linked set, at least."""
    return -(-n * num // den)


def depth(n):
    """How many prefix tokens two linked sets must share; n is the smaller size.

    A tenth of the tokens: lines that many documents share are then not enough
    to make candidates of documents that differ elsewhere.
    """
    return 1 + n // DEPTH_SHARE


def prefix_size(n, num: int = NUM, den: int = DEN):
    return np.minimum(n, n - least_overlap(n, num, den) + depth(n))


def shingle_sets(column: pa.Array, k: int = K):
    """For each row its sorted distinct shingle hashes."""
    for _, _, data, offsets in common.text_slices(column):
        starts, ends, bounds = common.scan_words(data, offsets)
        words = common.span_hashes(data, starts, ends, lower=True)
        windows = common.window_hashes(words, k)
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            if b - a >= k:
                own = np.sort(windows[a : b - k + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                yield common.mix(common.window_hashes(words[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _long_lists(parts: list[np.ndarray]) -> pa.ListArray:
    bounds = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(bounds), common.int64(flat))


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, fp, n, prefix): hash and size of each set, and its prefix in hash order; empty where the partition had it before."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            fp, n, prefix = [], [], []
            for own in shingle_sets(batch.column(1), k):
                n.append(len(own))
                fp.append(int(common.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(own) else 0)
                key = (fp[-1], n[-1])
                prefix.append(own[: 0 if key in seen else int(prefix_size(len(own), num, den))])
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), common.int64(np.array(fp, np.uint64)), pa.array(n, pa.int64()), _long_lists(prefix)], names=["doc_id", "fp", "n", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, n long, prefix array<long>")


def candidate_stars(signed: DataFrame, num: int, den: int) -> DataFrame:
    """(fp, n, lead): each candidate set with the smallest one for each token it is filed under."""
    tokens = signed.select(F.explode("prefix").alias("h"), "fp", "n")
    shared = tokens.groupBy("h").agg(F.count("*").alias("df"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("h", "df")
    need = 1 + F.floor(F.ceil(F.col("n") * num / den) / DEPTH_SHARE)
    own = tokens.join(shared, "h").groupBy("fp", "n").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("s")).filter(F.size("s") >= need)
    filed = common.checkpointed(own.select("fp", "n", F.explode(F.slice("s", F.lit(1), (F.size("s") - need + 1).cast("int"))["h"]).alias("h")))
    lead = filed.groupBy("h").agg(F.min("fp").alias("lead"), F.max("fp").alias("last")).filter("lead <> last").select("h", "lead")
    return filed.join(lead, "h").select("fp", "n", "lead").distinct()


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def linked(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) * den < len(b) * num:
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both * den >= num * (len(a) + len(b) - both)


def spanning_links(sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Verified links that connect exactly what all links among the sets connect.

    Sets come in by size. A postings entry lists a token's sets by the component
    they are in, so that one link settles a whole component.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    _, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
    parts = np.split(ids, np.cumsum([len(s) for s in sets])[:-1])
    forest, out = Forest(len(sets)), []
    by_hash: dict[int, dict[int, list[int]]] = {}
    by_rarity: dict[int, dict[int, list[int]]] = {}

    def gather(postings, tokens):
        """component -> lists of its members under these tokens."""
        found: dict[int, list[list[int]]] = {}
        for t in tokens:
            entry = postings.get(t)
            if entry is None:
                continue
            for r in [r for r in entry if forest.up[r] != r]:
                entry.setdefault(forest.find(r), []).extend(entry.pop(r))
            for r, members in entry.items():
                found.setdefault(r, []).append(members)
        return found

    for i in order:
        own, ranked = sets[i], parts[i]
        if not len(own):
            continue
        p = len(own) - least_overlap(len(own), num, den) + 1
        often = counts[ranked]
        rare = ranked[np.lexsort((ranked, often))]
        shared = lambda x: x[counts[x] > 1].tolist()
        first, second = shared(ranked[:p]), shared(rare[:p])
        one, two = gather(by_hash, first), gather(by_rarity, second)
        for r in sorted(one.keys() & two.keys()):
            if forest.find(r) == forest.find(i):
                continue
            hit = next((m for m in dict.fromkeys(x[-1] for x in two[r][:3]) if linked(own, sets[m], num, den)), None)
            if hit is None:
                both = set().union(*one[r]) & set().union(*two[r])
                hit = next((m for m in sorted(both, reverse=True) if linked(own, sets[m], num, den)), None)
            if hit is not None:
                out.append((i, hit))
                forest.up[forest.find(i)] = forest.find(hit)
        root = forest.find(i)
        for t in first:
            by_hash.setdefault(t, {}).setdefault(root, []).append(i)
        for t in second:
            by_rarity.setdefault(t, {}).setdefault(root, []).append(i)
    return out


def verified_links(docs: DataFrame, picked: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links among the documents of `picked` (doc_id, component, n), enough to connect what is linked."""
    sizes = picked.groupBy("component").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).filter("docs > 1")
    dealt = picked.join(sizes, "component").select("doc_id", "component", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int").alias("blocks"))
    dealt = common.checkpointed(dealt.select(F.col("doc_id").alias("__id"), "component", "blocks", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block")))
    if dealt.count() <= BROADCAST_ROWS:
        dealt = F.broadcast(dealt)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(dealt, F.col("doc_id") == F.col("__id")).select("doc_id", "component", "blocks", "block", "text")

    def packed(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(4), k)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(sets, pa.binary())], names=["doc_id", "component", "blocks", "block", "tokens"])

    rows = texts.mapInArrow(packed, "doc_id long, component long, blocks int, block int, tokens binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def join(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_pylist()
        links = spanning_links([np.frombuffer(x.as_py(), np.uint64) for x in table.column("tokens")], num, den)
        return pa.table({"a": pa.array([ids[x] for x, _ in links], pa.int64()), "b": pa.array([ids[y] for _, y in links], pa.int64())})

    return rows.groupBy("component", "i", "j").applyInArrow(join, "a long, b long")


def join(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id linked with it, over any number of links)."""
    signed = common.checkpointed(signatures(docs, k, num, den))
    classes = signed.filter("n > 0").groupBy("fp", "n").agg(F.min("doc_id").alias("rep"))
    stars = common.checkpointed(candidate_stars(signed.filter("n > 0"), num, den))
    groups = components(stars, "fp", "lead").withColumnRenamed("id", "fp")
    picked = stars.select("fp", "n").distinct().join(groups, "fp").join(classes, ["fp", "n"]).filter(F.col("rep").isNotNull()).select(F.col("rep").alias("doc_id"), "component", "n")
    links = components(verified_links(docs, picked, k, num, den)).withColumnRenamed("id", "rep")
    named = classes.join(links, "rep", "left").select("fp", "n", F.coalesce("component", "rep").alias("__group"))
    out = signed.select("doc_id", "fp", "n").join(named, ["fp", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("__group")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """`docs` without the documents that are linked to one with a smaller id. Rows with a null id stay."""
    (gone,) = common.fresh(docs, "gone")
    groups = common.checkpointed(join(docs, k, num, den).filter(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias(gone)).distinct())
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    return docs.join(groups, docs["doc_id"] == groups[gone], "left_anti")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), one AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w WHERE len(ws) >= 5), five AS (
  SELECT doc_id, string_agg(word, ' ') OVER span AS words, count(*) OVER span AS n FROM one WINDOW span AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, words FROM five WHERE n = 5 UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), sized AS MATERIALIZED (SELECT s.doc_id, words, n FROM s JOIN sizes USING (doc_id)), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b ON a.words = b.words AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT id, b FROM reach JOIN ways ON a = r
)
SELECT id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN sizes ON sizes.doc_id = id GROUP BY id
"""
