"""Source divergence audit: how far the word use of each source of a language lies from that of the others.

Terms are counted once for each (lang, source, term), within each task first (a
translation of bytes and a split find them; counters of bounded size), and pivoted
into one row for each (lang, term) with an array of (source's place, count);
sources in which a term never occurs have no entry. Higher-order functions turn
each entry and those behind it into contributions of pairs of sources, and
partial aggregates sum them before anything is shuffled.

A term that does not occur in a source has the source's least share there, a
constant b of the source, so the absent entries are never spelled out. For
sources g and h, with shares p and f(p, q) the divergence of one term,

    sum f(p_g, p_h) over all V kept terms = V f(b_g, b_h)
      + sum over terms in g of f(p_g, b_h) - f(b_g, b_h)
      + sum over terms in h of f(b_g, p_h) - f(b_g, b_h)
      + sum over terms in both of f(p_g, p_h) - f(p_g, b_h) - f(b_g, p_h) + f(b_g, b_h)

in whole numbers, so exactly. The second and third sums depend on a term's
count alone and come from a histogram of counts; the last one is what the arrays
emit. The work grows with the entries, not with terms times sources squared.

Odd rows: a null text, lang or source is ''. Every row is a document of its own,
repeated ids too. A language without kept terms has pairs of value 0 and no
terms. A group without terms takes part with its least share. An empty table
gives no rows. Extra columns are ignored. doc_id is never used.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_DOCS = 3
TOP_TERMS = 200
#: Shares are whole numbers of this part.
SCALE = 1_000_000_000
#: (lang, source) groups up to this number are broadcast. The result has a row for each pair of sources of a language, so they are few by its size.
BROADCAST_GROUPS = 500_000

#: Counters of a task are handed on and begun anew once they hold so many (group, term) entries. What they hand on is summed up again in the task, so few are enough.
HELD_TERMS = 100_000

#: Terms are of ASCII letters, made lower case, and of everything beyond ASCII: all other bytes become spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _share(count: str, total: str) -> str:
    """1 + floor(SCALE (count + 1) / total); the product may be wider than a long."""
    return f"(1 + (cast({count} + 1 as decimal(20, 0)) * {SCALE}BD) div cast({total} as decimal(20, 0)))"


def _groups(rows: DataFrame) -> DataFrame:
    """(lang, source, at): the sources of each language, numbered from 1."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    return common.checkpointed(rows.select("lang", "source").distinct().withColumn("at", place))


def _counts(most: int):
    """Occurrences and documents of each (lang, place, term) of some documents, counters being handed on once they hold `most` entries."""

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def flush():
            for (lang, at), (n, d) in held.items():
                columns = [pa.repeat(lang, len(n)), pa.repeat(pa.scalar(at, pa.int32()), len(n)), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array(list(map(d.__getitem__, n)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "at", "term", "n", "d"])
            held.clear()

        for batch in batches:
            langs, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, data, offsets in common.text_slices(batch.column(2)):
                raw = data.tobytes().translate(_TERMS)
                for k in range(b - a):
                    terms = raw[offsets[k] : offsets[k + 1]].split()
                    if terms:
                        n, d = held.setdefault((langs[a + k], places[a + k]), (Counter(), Counter()))
                        n.update(terms)
                        d.update(set(terms))
                if sum(len(n) for n, _ in held.values()) >= most:
                    yield from flush()
        yield from flush()

    return run


def term_vectors(rows: DataFrame, groups: DataFrame, few: bool, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, vec): kept terms, vec an array of (at, n) by place, only of sources that have the term."""
    placed = rows.join(F.broadcast(groups) if few else groups, ["lang", "source"])
    counted = placed.select("lang", "at", "text").mapInArrow(_counts(HELD_TERMS), "lang string, at int, term string, n long, d long")
    counted = counted.groupBy("lang", "at", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    wide = counted.groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("at", "n")).alias("vec"))
    return wide.filter(F.col("docs") >= min_docs).select("lang", "term", "total", F.sort_array("vec").alias("vec"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources with their divergence, and the terms that most set a source apart."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = _groups(rows)
    few = groups.count() <= BROADCAST_GROUPS
    hint = F.broadcast if few else (lambda df: df)
    wide = common.checkpointed(term_vectors(rows, groups, few, min_docs))
    entries = wide.select("lang", "term", "total", F.explode("vec").alias("e")).select("lang", "term", "total", "e.at", "e.n")
    sums = entries.groupBy("lang", "at").agg(F.sum("n").alias("n"))
    size = wide.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    per_group = groups.join(size, "lang", "left").join(sums, ["lang", "at"], "left").select("lang", "source", "at", F.coalesce("v", F.lit(0)).cast("long").alias("v"), F.coalesce("n_lang", F.lit(0)).cast("long").alias("n_lang"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    # room: what a share's denominator is; base: the share of a term that the source does not have.
    per_group = per_group.select("lang", "source", "at", "v", "n_lang", F.expr("greatest(n + v, 1)").alias("room")).withColumn("base", F.expr(_share("0", "room")))
    per_group = common.checkpointed(per_group)
    langs = per_group.groupBy("lang").agg(F.max("v").alias("v"), F.max("n_lang").alias("n_lang"), F.sort_array(F.collect_list(F.struct("at", "room", "base"))).alias("g"))
    langs = langs.select("lang", "v", "n_lang", F.col("g.room").alias("rooms"), F.col("g.base").alias("bases"))

    shares = wide.join(hint(langs), "lang").select(
        "lang", "term", F.expr(_share("total", "(n_lang + v)")).alias("q"), F.expr(f"transform(vec, x -> struct(x.at as at, {_share('x.n', 'rooms[x.at - 1]')} as p, bases[x.at - 1] as b))").alias("vec")
    )
    both = f"{_f('x.p', 'y.p')} - {_f('x.p', 'y.b')} - {_f('x.b', 'y.p')} + {_f('x.b', 'y.b')}"
    back = f"{_f('y.p', 'x.p')} - {_f('y.p', 'x.b')} - {_f('y.b', 'x.p')} + {_f('y.b', 'x.b')}"
    # An entry meets those behind it, so a row holds one entry's pairs, not all of a term's.
    heads = shares.filter(F.size("vec") > 1).select("lang", "vec", F.posexplode("vec").alias("k", "x")).filter(F.col("k") + 1 < F.size("vec"))
    emitted = heads.select("lang", F.explode(F.expr("transform(slice(vec, k + 2, size(vec)), y -> struct(x as x, y as y))")).alias("c")).select("lang", "c.x", "c.y")
    met = emitted.select("lang", F.col("x.at").alias("i"), F.col("y.at").alias("j"), F.expr(both).alias("there"), F.expr(back).alias("back")).groupBy("lang", "i", "j").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    met = met.select("lang", F.explode(F.array(F.struct("i", "j", F.col("there").alias("s")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("back").alias("s")))).alias("c")).select("lang", "c.i", "c.j", "c.s")

    histogram = entries.groupBy("lang", "at", "n").agg(F.count("*").alias("m")).join(hint(langs), "lang")
    histogram = histogram.withColumn("p", F.expr(_share("n", "rooms[at - 1]"))).withColumn("b", F.expr("bases[at - 1]"))
    alone = f"flatten(transform(bases, (c, k) -> if(k + 1 = at, array(), array(struct(at as i, k + 1 as j, m * ({_f('p', 'c')} - {_f('b', 'c')}) as s), struct(k + 1 as i, at as j, m * ({_f('c', 'p')} - {_f('c', 'b')}) as s)))))"
    single = histogram.select("lang", F.explode(F.expr(alone)).alias("c")).select("lang", "c.i", "c.j", "c.s")

    all_absent = f"flatten(transform(bases, (b, x) -> transform(bases, (c, y) -> struct(x + 1 as i, y + 1 as j, v * ({_f('b', 'c')}) as s))))"
    absent = langs.select("lang", F.explode(F.expr(all_absent)).alias("c")).select("lang", "c.i", "c.j", "c.s").filter("i <> j")

    pairs = absent.unionByName(single.groupBy("lang", "i", "j").agg(F.sum("s").alias("s"))).unionByName(met).groupBy("lang", "i", "j").agg(F.sum("s").alias("value"))
    names = per_group.select("lang", "at", "source")
    pairs = pairs.join(hint(names.withColumnRenamed("at", "i")), ["lang", "i"]).join(hint(names.select("lang", F.col("at").alias("j"), F.col("source").alias("item"))), ["lang", "j"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    apart = shares.select("lang", "term", "q", F.explode("vec").alias("e")).filter("e.p > q").select("lang", F.col("e.at").alias("at"), F.col("term").alias("item"), F.expr(_f("e.p", "q")).alias("value"))
    apart = apart.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "at").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)
    apart = apart.join(hint(names), ["lang", "at"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(apart)


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), terms AS (
  SELECT row_no, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT row_no) >= 3
), vocab AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM docs
), counts AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM terms JOIN kept USING (lang, term) GROUP BY ALL
), sums AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM counts GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(s.n, 0) + v.v) AS p,
         1 + (1000000000::HUGEINT * (k.total + 1)) // (v.n + v.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN vocab v ON g.lang = v.lang
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
             FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
    ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
), apart AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE c > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM apart) WHERE rank <= 200
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
"""
