"""Import or export: phrase scores and who, in which column of the page, is in the home country.

All phrases are found by one automaton pass over a batch of texts. The structural
signals come from marks: rows of labels, route labels and countries with their
places, lines and columns. A label's reach ends at the next mark that stops it,
which one window over labels and stops tells; what it reaches is an interval join
of reaches and mentions in pieces of the longest reach, so a long document is many
pieces and no two marks further apart meet.

Documents are told apart by doc_id. Null and empty texts have no mark. White space
is ASCII white space, as everywhere in Spark's patterns, and words are of ASCII letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import automaton
from ..functions import tables as t
from ..functions import values as v
from ..sources.folders import checkpointed

EXPORT, IMPORT = (*t.EXPORT_STRONG, *t.EXPORT_WEAK), (*t.IMPORT_STRONG, *t.IMPORT_WEAK)
PHRASES = (*EXPORT, *IMPORT)


class Phrases:
    """Finds phrases: words apart by any white space; a phrase of one word stands alone."""

    def __init__(self, phrases):
        self.automaton = automaton.Automaton([" ".join(p.lower().split()) for p in phrases])
        self.single = np.array([len(p.split()) == 1 for p in phrases], bool)

    def find(self, data: np.ndarray, offsets: np.ndarray):
        row, phrase, start, end = self.automaton.find(data, offsets)
        left, right = automaton.stands_alone(data, offsets, row, start, end)
        keep = (left & right) | ~self.single[phrase]
        return row[keep], phrase[keep], start[keep], end[keep]


def _lists(values: pa.Array, row: np.ndarray, rows: int) -> pa.Array:
    """A list for each of `rows` rows, of the values whose sorted rows are `row`."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def _letters(data: np.ndarray) -> np.ndarray:
    """Code points before each byte of UTF-8, and before the end."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def found(text, phrases) -> Column:
    """The numbers of the phrases that occur in a text, each once."""
    phrases = tuple(phrases)

    @F.arrow_udf("array<int>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Phrases(phrases)
        for batch in texts:
            parts = []
            for a, b, data, offsets in automaton.text_slices(batch):
                row, phrase, _, _ = finder.find(data, offsets)
                both = np.unique(row * len(phrases) + phrase)
                parts.append(_lists(pa.array((both % len(phrases)).astype(np.int32)), both // len(phrases), b - a))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return of(F.lower(F.coalesce(v.col(text), F.lit(""))))


def occurrences(docs: DataFrame, phrases, text: str = "text") -> DataFrame:
    """(doc_id, phrase, from, to): every place of every phrase, in code points."""
    phrases = tuple(phrases)
    kind = pa.struct([("phrase", pa.string()), ("from", pa.int32()), ("to", pa.int32())])

    @F.arrow_udf("array<struct<phrase:string,from:int,to:int>>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder, names = Phrases(phrases), pa.array(phrases, pa.string())
        for batch in texts:
            parts = []
            for a, b, data, offsets in automaton.text_slices(batch):
                row, phrase, start, end = finder.find(data, offsets)
                letters = _letters(data)
                base = letters[offsets[row]]
                columns = [names.take(pa.array(phrase)), pa.array((letters[start] - base).astype(np.int32)), pa.array((letters[end] - base).astype(np.int32))]
                parts.append(_lists(pa.StructArray.from_arrays(columns, fields=list(kind)), row, b - a))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))

    return docs.select("doc_id", F.explode(of(F.lower(F.coalesce(v.col(text), F.lit(""))))).alias("m")).select("doc_id", "m.phrase", F.col("m.from").alias("from"), F.col("m.to").alias("to"))


def _points(numbers: Column, strong, weak) -> Column:
    """Points of the phrases that occur, each once."""
    of = lambda group, points: F.size(F.array_intersect(numbers, F.array(*(F.lit(PHRASES.index(p)) for p in group)))) * points
    return of(strong, t.STRONG_POINTS) + of(weak, t.WEAK_POINTS)


def _scored(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("__found", found(text, PHRASES)).select("*", _points(F.col("__found"), t.EXPORT_STRONG, t.EXPORT_WEAK).alias("export_score"), _points(F.col("__found"), t.IMPORT_STRONG, t.IMPORT_WEAK).alias("import_score"))


def keyword_scores(docs: DataFrame, text: str = "text") -> DataFrame:
    return _scored(docs, text).drop("__found")


# --- marks ----------------------------------------------------------------------------

BUYER, SUPPLIER, ORIGIN, TARGET, COUNTRY = "buyer", "supplier", "origin", "target", "country"
#: What route labels begin with; their patterns tell where they end.
ROUTE = {
    ORIGIN: ("country of origin", "exporter country", "country of loading", "country of export", "port of loading", "port of export"),
    TARGET: ("country of dest", "country of final dest", "port of discharge", "final destination", "port of import"),
}
_MARK = pa.struct([
    ("kind", pa.string()), ("name", pa.string()), ("from", pa.int32()), ("to", pa.int32()), ("line", pa.int32()), ("cell", pa.int32()), ("bar", pa.int32()),
    ("left", pa.bool_()), ("right", pa.bool_()), ("heading_for", pa.int32()), ("next_name", pa.string()), ("next_adjoins", pa.bool_()),
])
_MARKS = "array<struct<kind:string,name:string,from:int,to:int,line:int,cell:int,bar:int,left:boolean,right:boolean,heading_for:int,next_name:string,next_adjoins:boolean>>"


class Marker:
    """Labels that name a party, route labels and countries of lower-case texts, each with where it stands."""

    BAR = t.COLUMN_MARK.encode()
    REFERENCE, FORMAL, ROUTES = re.compile(t.REFERENCE_FIELD), re.compile(t.FORMAL_PREFIX), {ORIGIN: re.compile(t.ORIGIN_LABEL), TARGET: re.compile(t.DESTINATION_LABEL)}
    HEADING = re.compile(r"\bto\s*$")

    def __init__(self):
        self.entries = [(kind, label, with_hyphens) for kind, labels in ((BUYER, t.BUYER_LABELS), (SUPPLIER, t.SUPPLIER_LABELS)) for label in labels for with_hyphens in self._spellings(label)]
        self.entries += [(kind, s, s) for kind, starts in ROUTE.items() for s in starts]
        self.entries += [(COUNTRY, name, name) for name in t.COUNTRIES]
        self.automaton = automaton.Automaton([e[2] for e in self.entries])
        self.kinds = np.array([e[0] for e in self.entries])

    @staticmethod
    def _spellings(label: str) -> list[str]:
        """A label's words are apart by white space or hyphens."""
        out = [""]
        for i, word in enumerate(label.split()):
            out = [f"{o}{gap}{word}" for o in out for gap in ((" ", "-") if i else ("",))]
        return out

    def marks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[dict]]:
        """Rows and marks, sorted by row and place."""
        row, entry, start, end = self.automaton.find(data, offsets)
        order = np.lexsort((end, start, row))
        row, entry, start, end = row[order], entry[order], start[order], end[order]
        left, right = automaton.stands_alone(data, offsets, row, start, end)
        letters = _letters(data)
        newlines = np.union1d(np.flatnonzero(data == 10), offsets[1:] - 1)  # the last byte of a row ends its line
        bars = self._bars(data)
        is_letter = (data >= 97) & (data <= 122)
        pairs = np.zeros(len(data) + 1, np.int64)  # pairs of letters that begin before a byte
        pairs[1:-1] = np.cumsum(is_letter[1:] & is_letter[:-1])
        pairs[-1:] = pairs[-2:-1]
        rows: list[int] = []
        out: list[dict] = []
        text, of = "", -1
        for r, k, a, b, free_left, free_right in zip(row.tolist(), entry.tolist(), start.tolist(), end.tolist(), left.tolist(), right.tolist(), strict=True):
            if r != of:
                text, of, last = data[offsets[r] : offsets[r + 1]].tobytes().decode(), r, None
                base = int(letters[offsets[r]])
            kind, name, string = self.entries[k]
            # Where a label ends is where its reach begins, so its line and cell are those of its last letter.
            line = int(np.searchsorted(newlines, b - 1 if kind in (BUYER, SUPPLIER) else a))
            line_from = max(int(newlines[line - 1]) + 1 if line else 0, int(offsets[r]))
            before, at = int(np.searchsorted(bars, line_from)), int(np.searchsorted(bars, a))
            bar = int(bars[before]) if before < len(bars) and bars[before] < newlines[line] else None
            mark = {"kind": kind, "name": name, "from": int(letters[a]) - base, "to": int(letters[b]) - base, "line": line, "cell": int(np.searchsorted(bars, b)) - before, "bar": None if bar is None else int(letters[bar]) - base, "left": free_left, "right": free_right}
            if kind in (BUYER, SUPPLIER):
                own_line = max(int(newlines[np.searchsorted(newlines, a) - 1]) + 1 if np.searchsorted(newlines, a) else 0, int(offsets[r]))
                cell_from = max(own_line, int(bars[at - 1]) + len(self.BAR) if at else 0)
                named_before = a - cell_from > 1 and pairs[a - 1] > pairs[cell_from]
                if named_before or self.REFERENCE.match(text[mark["to"] : mark["to"] + t.REFERENCE_CHARS]):
                    continue
            elif kind in ROUTE:
                whole = self.ROUTES[kind].match(text, mark["from"])
                if whole is None:
                    continue
                mark["to"] = whole.end()
            else:
                if text[mark["from"] : mark["to"]] != string:  # countries are written with one space
                    continue
                lead_from = max(mark["from"] - 6, 0)
                heading = self.HEADING.search(text[lead_from : mark["from"]])
                mark["heading_for"] = None if heading is None else lead_from + heading.start()
                if free_left and free_right:
                    if last is not None:  # each country learns the next one, and whether nothing but layout is between them
                        gap = text[last["to"] : mark["from"]].replace(t.COLUMN_MARK, "").strip()
                        last["next_name"], last["next_adjoins"] = name, not self.FORMAL.sub("", gap).strip()
                    last = mark
            rows.append(r)
            out.append(mark)
        return np.array(rows, np.int64), out

    def _bars(self, data: np.ndarray) -> np.ndarray:
        """Byte places of the column mark."""
        hit = np.ones(max(len(data) - len(self.BAR) + 1, 0), bool)
        for i, byte in enumerate(self.BAR):
            hit &= data[i : len(data) - len(self.BAR) + 1 + i] == byte
        return np.flatnonzero(hit)


def marks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, kind, name, from, to, line, cell, bar, ...): party labels, route labels and countries of all texts."""

    @F.arrow_udf(_MARKS)
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marker = Marker()
        for batch in texts:
            parts = []
            for a, b, data, offsets in automaton.text_slices(batch):
                row, out = marker.marks(data, offsets)
                parts.append(_lists(pa.array(out, _MARK), row, b - a))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_MARK))

    return docs.select("doc_id", F.explode(of(F.lower(F.coalesce(v.col(text), F.lit(""))))).alias("m")).select("doc_id", "m.*")


def _reaches(rows: DataFrame) -> DataFrame:
    """Party labels with where their reach ends: at the next label of the other side, the next route label, or after NEAR_CHARS."""
    label, route = F.col("kind").isin(BUYER, SUPPLIER), F.col("kind").isin(ORIGIN, TARGET)
    # A label stands at its end for what it reaches, and at its start for whom it stops: before a label that ends there, as routes do after it.
    events = rows.filter(label | route).withColumn("e", F.explode(F.array_compact(F.array(
        F.struct(F.col("from").alias("at"), F.when(label, 0).otherwise(2).alias("turn")),
        F.when(label, F.struct(F.col("to").alias("at"), F.lit(1).alias("turn"))),
    ))))
    later = Window.partitionBy("doc_id").orderBy(F.desc("e.at"), F.desc("e.turn")).rowsBetween(Window.unboundedPreceding, -1)
    stop = lambda kind: F.min(F.when((F.col("e.turn") != 1) & kind, F.col("e.at"))).over(later)
    named = events.select("*", stop(F.col("kind") == BUYER).alias("b"), stop(F.col("kind") == SUPPLIER).alias("s"), stop(route).alias("r"))
    other = F.when(F.col("kind") == BUYER, F.col("s")).otherwise(F.col("b"))
    return named.filter("e.turn = 1").select("doc_id", "kind", "name", F.col("to").alias("begin"), F.least(F.col("to") + t.NEAR_CHARS, other, "r").alias("stop"), "line", "cell")


def party_homes(rows: DataFrame) -> DataFrame:
    """(doc_id, buyer_home, supplier_home): how many labels of either side reach the home country, in their own column after their own line."""
    pieces = F.sequence(F.floor(F.col("begin") / t.NEAR_CHARS), F.floor(F.col("stop") / t.NEAR_CHARS))
    reach = _reaches(rows).withColumn("piece", F.explode(pieces))
    home = rows.filter((F.col("kind") == COUNTRY) & (F.col("name") == t.HOME)).select(
        F.col("doc_id").alias("d"), F.col("from").alias("h_from"), F.col("to").alias("h_to"), F.col("line").alias("h_line"), F.col("cell").alias("h_cell"), "bar", "left", "right", "heading_for", F.floor(F.col("from") / t.NEAR_CHARS).alias("p")
    )
    within = (F.col("h_from") >= F.col("begin")) & (F.col("h_to") <= F.col("stop")) & (F.col("left") | (F.col("h_from") == F.col("begin"))) & (F.col("right") | (F.col("h_to") == F.col("stop")))
    own_column = (F.col("h_line") == F.col("line")) | F.col("bar").isNull() | (F.col("bar") >= F.col("stop")) | (F.col("h_cell") == F.col("cell"))
    own = F.col("heading_for").isNull() | (F.col("heading_for") < F.col("begin"))
    met = reach.join(home, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("piece") == F.col("p")) & within & own_column & own).select("doc_id", "kind", "name").distinct()
    count = lambda kind: F.count(F.when(F.col("kind") == kind, True)).cast("int")
    return met.groupBy("doc_id").agg(count(BUYER).alias("buyer_home"), count(SUPPLIER).alias("supplier_home"))


def routes(rows: DataFrame) -> DataFrame:
    """(doc_id, origin_home, destination_home): whether the countries of the first origin and destination label are the home country.

    Each label takes the first country behind it and before the other label. If one has none, both take
    the next two countries in the order of the labels, where only layout stands between these.
    """
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("from", "to")))
    labels = rows.filter(F.col("kind").isin(ORIGIN, TARGET)).groupBy(F.col("doc_id").alias("d")).agg(first(ORIGIN).alias("o"), first(TARGET).alias("t"))
    alone = lambda a, b: F.when(F.col(b).isNull(), F.col(f"{a}.to") + t.SINGLE_LABEL_CHARS).otherwise(F.when(F.col(f"{b}.from") > F.col(f"{a}.to"), F.col(f"{b}.from")))
    labels = labels.withColumn("o_stop", alone("o", "t")).withColumn("t_stop", alone("t", "o")).withColumn("begin", F.when(F.col("o").isNotNull() & F.col("t").isNotNull(), F.least("o.from", "t.from")))
    country = rows.filter(F.col("kind") == COUNTRY).join(labels, F.col("doc_id").eqNullSafe(F.col("d")))
    nearest = lambda side: F.min(F.when(
        F.col("left") & (F.col("from") >= F.col(f"{side}.to")) & (F.col(f"{side}_stop").isNull() | (F.col("to") <= F.col(f"{side}_stop"))) & (F.col("right") | F.coalesce(F.col("to") == F.col(f"{side}_stop"), F.lit(False))),
        F.struct("from", "name"),
    ))["name"]
    read = F.min(F.when(F.col("left") & F.col("right") & (F.col("from") >= F.col("begin")), F.struct("from", "name", "next_name", "next_adjoins")))
    per = country.groupBy("doc_id").agg(nearest("o").alias("a"), nearest("t").alias("b"), read.alias("x"), F.first(F.col("o.from") <= F.col("t.from")).alias("in_order"))
    paired = (F.col("a").isNull() | F.col("b").isNull()) & F.coalesce("x.next_adjoins", F.lit(False))
    one, two = F.col("x.name"), F.col("x.next_name")
    a, b = F.when(paired, F.when(F.col("in_order"), one).otherwise(two)).otherwise(F.col("a")), F.when(paired, F.when(F.col("in_order"), two).otherwise(one)).otherwise(F.col("b"))
    return per.select("doc_id", F.coalesce(a == t.HOME, F.lit(False)).alias("origin_home"), F.coalesce(b == t.HOME, F.lit(False)).alias("destination_home"))


def party_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, origin_home, destination_home, buyer_home, supplier_home) of the documents that name the home country near a label."""
    # Structure tells a side only by the home country, so only texts that name it are marked.
    rows = checkpointed(marks(docs.filter(F.lower(F.col(text)).contains(t.HOME)), text))
    met = party_homes(rows).join(routes(rows).withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")), "full")
    none = F.lit(False)
    return met.select(F.coalesce("doc_id", "d").alias("doc_id"), F.coalesce("origin_home", none).alias("origin_home"), F.coalesce("destination_home", none).alias("destination_home"), F.coalesce("buyer_home", F.lit(0)).alias("buyer_home"), F.coalesce("supplier_home", F.lit(0)).alias("supplier_home"))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, shipment_type, export_score, import_score, signal, matched)."""
    names = [f"{'export' if p in EXPORT else 'import'}:{p}" for p in PHRASES]
    d = _scored(docs, text).select("doc_id", "export_score", "import_score", "__found")
    signals = party_signals(docs, text)
    d = d.join(signals.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    origin, target = F.coalesce("origin_home", F.lit(False)), F.coalesce("destination_home", F.lit(False))
    buyer, supplier = F.coalesce(F.col("buyer_home") > 0, F.lit(False)), F.coalesce(F.col("supplier_home") > 0, F.lit(False))
    notes = [(origin & ~target, "export", "structural:origin=IN,destination=foreign"), (target & ~origin, "import", "structural:destination=IN,origin=foreign"), (buyer & ~supplier, "import", "structural:buyer/consignee address is in India"), (supplier & ~buyer, "export", "structural:supplier/exporter address is in India")]
    points = lambda side: sum((F.when(c, t.STRONG_POINTS).otherwise(0) for c, s, _ in notes if s == side), F.lit(0))
    keyword = (F.col("export_score") > 0) | (F.col("import_score") > 0)
    structural = (origin != target) | (buyer != supplier)
    phrases = F.transform(F.array_sort("__found"), lambda i: F.element_at(F.array(*map(F.lit, names)), i + 1))
    d = d.select(
        "doc_id", (F.col("export_score") + points("export")).alias("export_score"), (F.col("import_score") + points("import")).alias("import_score"), F.when(keyword & structural, "both").when(keyword, "keyword").when(structural, "structural").otherwise("none").alias("signal"),
        F.concat(phrases, F.array_compact(F.array(*(F.when(c, note) for c, _, note in notes)))).alias("matched"),
    )
    gap = F.col("export_score") - F.col("import_score")
    return d.select("doc_id", F.when(gap >= t.MARGIN, "export").when(-gap >= t.MARGIN, "import").otherwise("unknown").alias("shipment_type"), "export_score", "import_score", "signal", "matched")
