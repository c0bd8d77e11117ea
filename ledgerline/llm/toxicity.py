"""Toxicity: noisy-channel deobfuscation before scoring.

A character trigram model is counted over all texts. A token that looks
disguised (digits or signs among its letters, letters repeated three times or
more, or single letters set apart) becomes a lattice: every character may stand
for itself or for letters it resembles, repeated letters may be dropped, and
separators vanish. A Viterbi pass finds the cheapest reading
under the channel and the character model; if a word that the classifier knows can be
read for at most MARGIN more, the cheapest such word is taken: a second pass follows
the beginnings of known words only, and so misses none. In a run of single letters
set apart, every separator may also end a word: the words of the cheapest reading
count, and every known word of a reading that is nearly as cheap. The restored
words are then scored by log-odds.

The classifier is naive Bayes over distinct restored words. It is fitted on at
most SAMPLE labelled rows (those with the smallest hashes of their ids, fold 0 of
five left out), without near copies among them, keeps words whose G2 statistic is at least MIN_G2. Only the text enters a score. An empty or null text scores
the prior. Null labels and labels without a document are ignored; of repeated
labels for an id the largest counts. Rows are scored one by one, so repeated rows
repeat, and rows that repeat an id each enter the fit with their label. An empty
table gives no rows; without labels of both kinds all texts score the same, below
a half. Extra columns are ignored by `score` and pass through `clean`.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, MIN_G2, MIN_DOCS = 20_000, 30.0, 5
FOLDS = 5
#: How much costlier than the cheapest reading a known word may be, in nats.
MARGIN = 8.0
#: Characters of a run that are decoded at once, at least; longer runs are decoded in overlapping pieces.
PIECE = 512

# Letters that a character may stand for (fixed values), and what that costs in nats.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
SUBSTITUTE, KEEP_ODD, DROP_REPEAT, KEEP_REPEAT, SKIP, BOUNDARY = 1.0, 6.0, 0.5, 1.5, 0.1, 1.5

SEPARATORS = ".-_* "
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
EDGE, OUTSIDE = len(ALPHABET), len(ALPHABET) + 1
SIZE = 64
_CODE = np.full(0x110000, OUTSIDE, np.uint8)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i
    if len(_c.upper()) == 1:
        _CODE[ord(_c.upper())] = _i
for _c in " \t\n\x0b\x0c\r":
    _CODE[ord(_c)] = EDGE

STRIP = re.compile(r"^[^\w@$!|+(€£#*]+|[^\w]+$")
DISGUISED = re.compile(r"(?=.*[^\W\d_])(?:.*[\d@$!|+(€£#*].*|.*([^\W\d_])\1\1.*|[^\W\d_](?:[._\-*][^\W\d_]){2,})$")
_UNIT = r"(?:[^\W_]|[@$!|])(?![^\s.\-_*])"
APART = re.compile(rf"(?<!\S){_UNIT}(?:[ .\-_*]++{_UNIT}){{2,}}(?!\S)")


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts: character trigrams, added up in each partition before the shuffle."""

    def run(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for _, _, data, offsets in common.text_slices(batch.column(0)):
                points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
                c = np.concatenate([[EDGE], _CODE[points], [EDGE]]).astype(np.int32)
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Negative log probabilities of a character after two, smoothed by shorter contexts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        tri = np.zeros(SIZE**3)
        tri[grams] = counts
        tri = tri.reshape(SIZE, SIZE, SIZE)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        one = (uni + 1) / (uni.sum() + SIZE)
        two = (bi + 20 * one) / (bi.sum(axis=1, keepdims=True) + 20)
        three = (tri + 20 * two[None]) / (tri.sum(axis=2, keepdims=True) + 20)
        self.cost = -np.log(three).astype(np.float32)


def choices(token: str, i: int) -> list[tuple[str, float]]:
    """What the token's character may be read as, and its cost."""
    c = token[i]
    out = [(x, SUBSTITUTE) for x in LOOKS_LIKE.get(c, "")]
    if c.isalpha():
        out.append((c, KEEP_REPEAT if i > 1 and c == token[i - 1] == token[i - 2] else 0.0))
    elif c not in SEPARATORS:
        out.append((c, KEEP_ODD))
    return out


def repeats(c: str, before: str, code: int, read: list[tuple[str, float]]) -> bool:
    """Whether a character only prolongs the letter (`code`) that the one before it was read as: it is the same, or may be read so."""
    return c == before or any(int(_CODE[ord(x)]) == code for x, _ in read)


def cheapest(token: str, model: CharModel) -> tuple[float, str] | None:
    """Cost and text of the cheapest reading; of equal ones the first in the alphabet.

    Viterbi over states (last two letters read, last character that was read as
    one), each with its cheapest way there as linked letters.
    """
    states: dict[tuple[int, int, str], tuple] = {(EDGE, EDGE, ""): (0.0, None)}
    for i, c in enumerate(token):
        separator, before = c in SEPARATORS, token[i - 1] if i else None
        read = choices(token, i)
        nxt: dict[tuple[int, int, str], tuple] = {}
        for (a, b, last), (cost, node) in states.items():
            ways = [((b, code, c), cost + w + float(model.cost[a, b, code]), (node, x)) for x, w in read for code in (int(_CODE[ord(x)]),)]
            if separator:
                ways.append(((a, b, last), cost + SKIP, node))
            elif last == before and repeats(c, before, b, read):
                ways.append(((a, b, c), cost + DROP_REPEAT, node))
            for to, total, way in ways:
                if to not in nxt or total < nxt[to][0]:
                    nxt[to] = (total, way)
        states = nxt
    return min(((cost + float(model.cost[a, b, EDGE]), spelled(node)) for (a, b, _), (cost, node) in states.items()), default=None)


def spelled(node) -> str:
    out = []
    while node is not None:
        node, x = node
        out.append(x)
    return "".join(reversed(out))


def known_word(token: str, model: CharModel, known: frozenset[str], starts: frozenset[str], limit: float) -> str | None:
    """The known word that the token can be read as at the least cost, if that is at most `limit`.

    States are (beginning of known words, last character read as a letter); all others are left at once.
    """
    edge = lambda word, k: int(_CODE[ord(word[-k])]) if len(word) >= k else EDGE
    states = {("", ""): 0.0} if starts else {}
    for i, c in enumerate(token):
        separator, before = c in SEPARATORS, token[i - 1] if i else None
        read = choices(token, i)
        nxt: dict[tuple[str, str], float] = {}
        for (word, last), cost in states.items():
            if separator or last == before and repeats(c, before, edge(word, 1), read):
                total, to = cost + (SKIP if separator else DROP_REPEAT), (word, last if separator else c)
                if total <= limit and total < nxt.get(to, math.inf):
                    nxt[to] = total
            for x, w in read:
                if word + x in starts:
                    total = cost + w + float(model.cost[edge(word, 2), edge(word, 1), int(_CODE[ord(x)])])
                    if total <= limit and total < nxt.get((word + x, c), math.inf):
                        nxt[word + x, c] = total
        states = nxt
    ends = ((cost + float(model.cost[edge(word, 2), edge(word, 1), EDGE]), word) for (word, _), cost in states.items() if word in known)
    found = min(ends, default=(math.inf, ""))
    return found[1] if found[0] <= limit else None


def run_words(run: str, model: CharModel, known: frozenset[str], starts: frozenset[str], first: bool = True, last: bool = True) -> set[str]:
    """Words of the cheapest reading of letters set apart, and known words of readings that cost at most MARGIN more.

    `starts` are all beginnings of known words. Words at an end of `run` that is no end of the whole run (`first`, `last`) don't count.
    """
    fresh = (EDGE, EDGE, "")
    ahead = [{fresh: 0.0}]  # costs to each state
    came: list[dict] = []  # the cheapest arc into it
    arcs: list[dict] = []  # state: (letter, state after it, cost)
    for i, c in enumerate(run):
        separator, before = c in SEPARATORS, run[i - 1] if i else None
        read = choices(run, i)
        here, nxt, back = {}, {}, {}
        for state, cost in ahead[-1].items():
            a, b, letter = state
            out = [(x, (b, code, c), w + float(model.cost[a, b, code])) for x, w in read for code in (int(_CODE[ord(x)]),)]
            if separator:
                out.append(("", state, SKIP))
            elif letter == before and repeats(c, before, b, read):
                out.append(("", (a, b, c), DROP_REPEAT))
            if separator and state != fresh:
                out.append((" ", fresh, BOUNDARY + float(model.cost[a, b, EDGE])))
            here[state] = out
            for x, to, step in out:
                if cost + step < nxt.get(to, math.inf):
                    nxt[to], back[to] = cost + step, (state, x)
        ahead.append(nxt)
        came.append(back)
        arcs.append(here)
    n = len(run)
    if not ahead[-1]:
        return set()
    behind = [{s: 0.0 if s == fresh else float(model.cost[s[0], s[1], EDGE]) for s in ahead[-1]}]  # costs from each state to the end
    for here in reversed(arcs):
        behind.append({state: min((step + behind[-1][to] for _, to, step in out), default=math.inf) for state, out in here.items()})
    behind.reverse()
    limit = behind[0][fresh] + MARGIN
    state = min(ahead[-1], key=lambda s: ahead[-1][s] + behind[-1][s])
    text = []
    for back in reversed(came):
        state, x = back[state]
        text.append(x)
    words = "".join(reversed(text)).split(" ")
    found = set(words[0 if first else 1 : len(words) if last else -1])
    for i in range(n if starts else 0):
        if fresh not in ahead[i] or not (i or first):
            continue
        at = {(fresh, ""): ahead[i][fresh]}
        for j in range(i, n):
            nxt = {}
            for (state, word), cost in at.items():
                for x, to, step in arcs[j][state]:
                    total = cost + step
                    if total + behind[j + 1][to] > limit:
                        continue
                    if x == " ":
                        if word in known:
                            found.add(word)
                    elif word + x in starts:
                        nxt[to, word + x] = min(total, nxt.get((to, word + x), math.inf))
            at = nxt
            if not at:
                break
        else:
            if last:
                found |= {word for (_, word), _ in at.items() if word in known}
    return found - {""}


class Restorer:
    """Restored words of texts, with a bounded cache of finished tokens."""

    CACHE = 60_000

    def __init__(self, model: CharModel, known=frozenset()):
        self.model, self.known, self.cache = model, known, {}
        self.starts = frozenset(w[:i] for w in known for i in range(len(w) + 1))
        self.overlap = max(PIECE // 2, 8 * max(map(len, known), default=0))

    def word(self, token: str) -> str:
        found = self.cache.get(token)
        if found is None:
            plain = STRIP.sub("", token) if not token.isalpha() else token
            found = self.restored(plain) if DISGUISED.match(plain) else plain
            if len(self.cache) >= self.CACHE:
                self.cache.clear()
            self.cache[token] = found
        return found

    def restored(self, token: str) -> str:
        if token in self.known:
            return token
        best = cheapest(token, self.model)
        if best is None:
            return token
        return known_word(token, self.model, self.known, self.starts, best[0] + MARGIN) or best[1]

    def run(self, run: str) -> set[str]:
        """Words of single letters set apart, in pieces of which each begins `overlap` before the last one's end."""
        out, a = set(), 0
        while True:
            b = a + 2 * self.overlap
            out |= run_words(run[a:b], self.model, self.known, self.starts, a == 0, b >= len(run))
            if b >= len(run):
                return out
            a = b - self.overlap

    def words(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        out = set(map(self.word, set(low.split())))
        for m in APART.finditer(low):
            out |= self.run(m.group())
        out.discard("")
        return out


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def char_model(docs: DataFrame) -> CharModel:
    """Counts of at most SIZE^3 grams reach the driver, whatever the corpus."""
    table = common.checkpointed(trigram_counts(docs)).toPandas()
    return CharModel(table["gram"].to_numpy(), table["n"].to_numpy())


def one_of_each_family(rows: DataFrame, hashes: int = 4) -> DataFrame:
    """`rows` (doc_id, text, toxic) without copies and near copies, whose words would count many times over.

    A row goes if one with a smaller id has one of its `hashes` minimum hashes of three-word shingles.
    """

    def signed(batches):
        salts = common.mix(np.arange(1, hashes + 1, dtype=np.uint64))
        for batch in batches:
            ids, keys = [], []
            for a, _, data, offsets in common.text_slices(batch.column(1)):
                starts, ends, bounds = common.scan_words(data, offsets)
                words = common.span_hashes(data, starts, ends, lower=True)
                for k in range(len(offsets) - 1):
                    own = words[bounds[k] : bounds[k + 1]]
                    grams = common.window_hashes(own, min(3, max(1, len(own))))
                    if len(grams):
                        ids += [batch.column(0)[a + k].as_py()] * hashes
                        keys += [int(common.mix(grams ^ x).min()) for x in salts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), common.int64(np.array(keys, np.uint64)), pa.array(np.arange(len(ids), dtype=np.int32) % hashes)], names=["doc_id", "key", "i"])

    rows = common.checkpointed(rows)
    keys = rows.select("doc_id", "text").mapInArrow(signed, "doc_id long, key long, i int")
    # A group's ids are no more than the sample's, and are put together before the shuffle.
    groups = keys.groupBy("i", "key").agg(F.collect_set("doc_id").alias("ids")).filter(F.size("ids") > 1)
    later = groups.select(F.explode(F.filter("ids", lambda x: x > F.array_min("ids"))).alias("doc_id")).distinct()
    return rows.join(later, "doc_id", "left_anti").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, model: CharModel, sample: int = SAMPLE) -> tuple[float, dict[str, float]]:
    """The prior's log-odds and the words' weights. The sample bounds how many words there are."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    picked = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # bounded by `sample`
    rows = one_of_each_family(docs.select("doc_id", "text").join(picked, "doc_id"))

    def run(batches):
        restorer = Restorer(model)
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in restorer.words(text) | {""}:  # the empty word counts the rows
                    counts.setdefault(word, [0, 0])[toxic > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x[0] for x in counts.values()], pa.int64()), pa.array([x[1] for x in counts.values()], pa.int64())], names=["word", "clean", "toxic"])

    table = rows.mapInArrow(run, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = common.checkpointed(table.filter((F.col("clean") + F.col("toxic") >= MIN_DOCS) | (F.col("word") == "")))
    total = table.filter(F.col("word") == "").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return -4.0, {}
    n0, n1 = total["clean"], total["toxic"]
    both = n0 + n1

    def part(seen, rows_of):
        expected = rows_of * (F.col("clean") + F.col("toxic")) / both
        rest = rows_of * (both - F.col("clean") - F.col("toxic")) / both
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0) + F.when(rows_of - seen > 0, (rows_of - seen) * F.log((rows_of - seen) / rest)).otherwise(0.0)

    g2 = 2 * (part(F.col("clean"), F.lit(float(n0))) + part(F.col("toxic"), F.lit(float(n1))))
    best = table.filter(F.col("word") != "").withColumn("g2", g2).filter(F.col("g2") >= MIN_G2).collect()
    weight = lambda r: math.log((r["toxic"] + 0.5) / (n1 + 1)) - math.log((r["clean"] + 0.5) / (n0 + 1))
    return math.log(n1 / n0), {r["word"]: max(-6.0, min(6.0, weight(r))) for r in best}


def score_batches(prior: float, weights: dict[str, float], model: CharModel):
    """A function from texts to scores."""
    restorer = Restorer(model, frozenset(w for w, x in weights.items() if x > 0))

    def score(text: str | None) -> float:
        z = prior + sum(weights[w] for w in restorer.words(text) & weights.keys())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = char_model(docs)
    prior, weights = fit(docs, labels, model)

    def run(batches):
        of = score_batches(prior, weights, model)
        for batch in batches:
            s = np.array([of(x.as_py()) for x in batch.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows whose score is `threshold` or more."""
    model = char_model(docs)
    prior, weights = fit(docs, labels, model)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        of = score_batches(prior, weights, model)
        for batch in batches:
            yield batch.filter(pa.array([of(x.as_py()) < threshold for x in batch.column(at)], pa.bool_())).rename_columns(names)

    return common.map_batches(docs, run, docs.schema)
