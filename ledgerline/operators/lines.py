"""Ruled lines of page images: a Hough transform by votes, windows and islands.

Ink pixels (doc_id, page_no, x, y) vote for every line near an axis that may run
through them: an axis, a tilt and a level, where the line crosses the page's edge.
Votes are counted where their page lies, so pixels are shuffled, and votes are not. At the tilt that has the best
line of its page and axis, the levels with most votes of their neighbourhood are lines;
their pixels are taken out and the others vote again, until no line has enough. A line's
pixels in order are islands between gaps, and long islands are segments.

Pages of any number are worked on together, and a page's votes are as many as its levels
and tilts, however much ink it has. Repeated pixels count once. Null places are no pixels.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.folders import checkpointed
from .layout import whole_pages

#: Tilts to either side of the axes are whole multiples of a quarter degree.
TILT_STEP, TILTS = 0.25, range(-80, 81)
#: Votes a line needs; levels to either side that the best of them speaks for, and that its pixels come from.
INK, APART, WIDE = 120, 2, 1
#: Gaps that a segment runs over, and its least length as a share of the page's smaller side.
SKIP, LENGTH_SHARE = 15, 0.25

PAGE = ["doc_id", "page_no"]


def slopes(tilts=TILTS) -> dict[int, float]:
    return {k: math.tan(math.radians(k * TILT_STEP)) for k in tilts}


def _turned(pixels: DataFrame) -> DataFrame:
    """Each pixel once for each axis, by its place along and across it. Pixels are dealt by page, where their votes are counted."""
    both = F.explode(F.array(F.struct(F.lit("flat").alias("axis"), F.col("x").alias("along"), F.col("y").alias("across")), F.struct(F.lit("up").alias("axis"), F.col("y").alias("along"), F.col("x").alias("across"))))
    own = pixels.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*PAGE, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).repartition(*PAGE).distinct()
    return own.select(*PAGE, both.alias("p")).select(*PAGE, "p.axis", "p.along", "p.across")


def _votes(turned: DataFrame, tilts, least: int = 1) -> DataFrame:
    """Votes of pages, each whole in one worker: all pixels of a batch of pages for one tilt after the other, so that no vote is kept or shuffled by itself."""
    slope_of = slopes(tilts)

    def count(table: pa.Table, starts: np.ndarray) -> pa.Table:
        page = np.repeat(np.arange(len(starts)), np.diff(starts, append=table.num_rows))
        flat = table.column("axis").to_numpy() == "flat"
        along, across = (table.column(c).to_numpy().astype(np.int64) for c in ("along", "across"))
        found = []
        for tilt, slope in slope_of.items():
            level = across - np.floor(slope * along + 0.5).astype(np.int64)
            low = level.min()
            span = int(level.max() - low) + 1
            keys, n = np.unique((page * 2 + ~flat) * span + (level - low), return_counts=True)
            keys, n = keys[n >= least], n[n >= least]
            found.append((keys // span, np.full(len(keys), tilt), keys % span + low, n))
        at, tilt, level, n = (np.concatenate(c) for c in zip(*found, strict=True))
        of = pa.array(starts[at // 2])
        out = {c: table.column(c).take(of) for c in PAGE} | {"axis": pa.array(np.where(at % 2 == 0, "flat", "up")), "tilt": pa.array(tilt, pa.int32()), "level": pa.array(level, pa.int32()), "votes": pa.array(n, pa.int64())}
        return pa.table(out)

    schema = T.StructType([*(turned.schema[c] for c in PAGE), T.StructField("axis", T.StringType()), T.StructField("tilt", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("votes", T.LongType())])
    return whole_pages(turned, ["axis", "along", "across"], count, schema)


def votes(pixels: DataFrame, tilts=TILTS, least: int = 1) -> DataFrame:
    """(doc_id, page_no, axis, tilt, level, votes): how many pixels each line would have, the axis being flat or up; lines of fewer than `least` are left out."""
    return _votes(_turned(pixels), tilts, least)


def peaks(counted: DataFrame, ink: int = INK) -> DataFrame:
    """The lines of each page and axis at the tilt of its best one: the most votes within APART levels, ties to the lower level (of tilts, to the smaller)."""
    enough = counted.filter((F.col("votes") >= ink) & F.col("doc_id").isNotNull() & F.col("page_no").isNotNull())
    best = F.max(F.struct("votes", (-F.col("tilt")).alias("low"))).over(Window.partitionBy(*PAGE, "axis"))
    own = enough.withColumn("best", best).filter(F.col("best.low") == -F.col("tilt")).drop("best")
    near = Window.partitionBy(*PAGE, "axis", "tilt").orderBy("level").rangeBetween(-APART, APART)
    top = F.max(F.struct("votes", (-F.col("level")).alias("low"))).over(near)
    return own.withColumn("top", top).filter((F.col("top.votes") == F.col("votes")) & (F.col("top.low") == -F.col("level"))).drop("top")


def marked(pixels: DataFrame, tilts=TILTS, ink: int = INK) -> DataFrame:
    """(doc_id, page_no, axis, tilt, level, along): pixels of lines, each line's in the round that found it."""
    left, found = checkpointed(_turned(pixels)), None
    shift = F.element_at(F.create_map(*(x for k, s in slopes(tilts).items() for x in (F.lit(k), F.lit(s)))), F.col("tilt"))
    while True:
        lines = checkpointed(peaks(_votes(left, tilts, ink), ink))
        if lines.isEmpty():
            break
        # A line's band is three levels wide, and its neighbours are further off than two bands reach.
        bands = lines.select(*PAGE, "axis", "tilt", F.col("level").alias("line"), F.explode(F.sequence(F.col("level") - WIDE, F.col("level") + WIDE)).alias("level"))
        at = lines.select(*PAGE, "axis", "tilt").distinct()
        placed = left.join(at, [*PAGE, "axis"]).withColumn("level", (F.col("across") - F.floor(shift * F.col("along") + 0.5)).cast("int"))
        judged = checkpointed(placed.join(bands, [*PAGE, "axis", "tilt", "level"], "left").select(*PAGE, "axis", "along", "across", "tilt", "line"))
        on = judged.filter("line is not null").select(*PAGE, "axis", "tilt", F.col("line").alias("level"), "along")
        found = on if found is None else found.unionByName(on)
        # Pages and axes without a line this time have none ever.
        left = judged.filter("line is null").select(*PAGE, "axis", "along", "across")
    return found if found is not None else left.select(*PAGE, "axis", F.lit(0).alias("tilt"), F.lit(0).alias("level"), "along").limit(0)


def segments(pixels: DataFrame, sizes: DataFrame, tilts=TILTS, ink: int = INK, share: float = LENGTH_SHARE) -> DataFrame:
    """(doc_id, page_no, x1, y1, x2, y2, width, height) of the ruled lines of pages; `sizes` has width and height of each."""
    on = marked(pixels, tilts, ink).distinct()
    line = Window.partitionBy(*PAGE, "axis", "tilt", "level").orderBy("along")
    gap = F.col("along") - F.lag("along").over(line) > SKIP + 1
    island = on.withColumn("i", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(line))
    ends = island.groupBy(*PAGE, "axis", "tilt", "level", "i").agg(F.min("along").alias("a"), F.max("along").alias("b")).join(sizes.select(*PAGE, "width", "height"), PAGE)
    long = ends.filter(F.col("b") - F.col("a") >= F.floor(F.least("width", "height") * share))
    slope = F.element_at(F.create_map(*(x for k, s in slopes(tilts).items() for x in (F.lit(k), F.lit(s)))), F.col("tilt"))
    across = lambda c: (F.col("level") + F.floor(slope * F.col(c) + 0.5)).cast("int")
    flat = F.col("axis") == "flat"
    place = lambda c, name: (F.when(flat, F.col(c)).otherwise(across(c)).alias(f"x{name}"), F.when(flat, across(c)).otherwise(F.col(c)).alias(f"y{name}"))
    return long.select(*PAGE, *place("a", 1), *place("b", 2), "width", "height")
