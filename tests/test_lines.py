"""Ruled lines found by votes, windows and islands, against lines that were drawn and against a plain count."""

import random
from collections import Counter

from ledgerline.operators import lines


def drawn(r, slope, level, first, last, turned, skip=()):
    out = [(a, level + int(slope * a + 0.5 // 1)) for a in range(first, last + 1) if a not in skip and r.random() < 0.97]
    return [(y, x) for x, y in out] if turned else out


def test_votes_are_plain_counts(spark):
    r = random.Random(1)
    pixels = [(d, 1, r.randint(0, 40), r.randint(0, 40)) for d in ("a", "b", None) for _ in range(150)]
    d = spark.createDataFrame([*pixels, *pixels[:5], ("a", 1, None, 3)], "doc_id string, page_no int, x int, y int")
    tilts = range(-8, 9)
    want = Counter()
    for doc, page, x, y in set(pixels):
        for axis, a, c in (("flat", x, y), ("up", y, x)):
            for k, s in lines.slopes(tilts).items():
                want[doc, page, axis, k, c - int((s * a + 0.5) // 1)] += 1
    assert {tuple(x)[:5]: x["votes"] for x in lines.votes(d, tilts).collect()} == dict(want)


def test_segments_of_drawn_pages(spark):
    r = random.Random(2)
    pixels, want = [], {}
    for page in range(1, 4):
        tilt = r.choice([-6, 0, 5])
        slope = lines.slopes([tilt])[tilt]
        for i in range(4):
            level = 60 + 90 * i
            pixels += [("d", page, x, y) for x, y in drawn(r, slope, level, 10, 390, False)]
            want.setdefault(page, []).append((level, tilt))
        pixels += [("d", page, x, y) for x, y in drawn(r, slope, 200, 20, 380, True, range(150, 190))]
        pixels += [("d", page, r.randint(0, 399), r.randint(0, 399)) for _ in range(200)]
    sizes = spark.createDataFrame([("d", p, 400, 400) for p in (1, 2, 3, 4)], "doc_id string, page_no int, width int, height int")
    d = spark.createDataFrame(pixels, "doc_id string, page_no int, x int, y int").repartition(3)
    got = {}
    for x in lines.segments(d, sizes, range(-20, 21)).collect():
        got.setdefault(x["page_no"], []).append(x)
    assert set(got) == {1, 2, 3}
    for page, drawn_lines in want.items():
        flat = [x for x in got[page] if x["x2"] - x["x1"] > abs(x["y2"] - x["y1"])]
        up = [x for x in got[page] if x not in flat]
        for level, tilt in drawn_lines:
            slope = lines.slopes([tilt])[tilt]
            assert any(abs(x["y1"] - level - slope * x["x1"]) <= 2 and abs(x["y2"] - level - slope * x["x2"]) <= 2 and x["x1"] <= 15 and x["x2"] >= 385 for x in flat)
        # The gap of 40 pixels cuts the upright line in two.
        assert len(up) == 2 and {x["y1"] < 100 for x in up} == {True, False}


def test_no_ink_no_lines(spark):
    none = spark.createDataFrame([], "doc_id string, page_no int, x int, y int")
    sizes = spark.createDataFrame([("d", 1, 10, 10)], "doc_id string, page_no int, width int, height int")
    assert lines.segments(none, sizes).count() == 0 and lines.votes(none).count() == 0


def test_votes_are_not_shuffled(spark):
    r = random.Random(3)
    d = spark.createDataFrame([("a", p, r.randint(0, 20), r.randint(0, 20)) for p in (1, 2) for _ in range(300)], "doc_id string, page_no int, x int, y int")
    plan = lines.votes(d, range(-8, 9))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    key = lambda x: tuple(x)
    every = lines.votes(d, range(-8, 9))
    assert sorted(map(key, lines.votes(d, range(-8, 9), 8).collect())) == sorted(map(key, every.filter("votes >= 8").collect()))
    assert sorted(map(key, lines.peaks(every, 8).collect())) == sorted(map(key, lines.peaks(lines.votes(d, range(-8, 9), 8), 8).collect()))
    # Votes are counted once: Python sees each pixel once.
    assert lines.peaks(every, 8)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
