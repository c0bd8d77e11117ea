"""Formats found by the strings they need, against trying every pattern on every name; glyphs on one spot."""

import random
import re

import numpy as np

from ledgerline.operators import layout, repair


def test_needed_strings():
    assert repair.literals(r"(?i)\bHETER[O0]\b") == ["heter"]
    assert repair.literals(r"^Acme( Ltd)?\.? (GmbH|AG) & Sons$") == ["acme", " & sons"]
    assert repair.literals(r"(abc)+x?yz1") == ["abc", "yz1"] and repair.literals(r"a.b|xyz") == [] and repair.literals("(") == [] and repair.literals(r"(?!never)ever") == ["ever"]


def test_formats_are_those_that_every_pattern_tried_on_every_name_gives(spark):
    r = random.Random(1)
    words = ["Acme", "ACME", "Steel", "Stee1", "Works", "GmbH", "Ltd.", "Pune", "a", "07", "Ö-AG"]
    names = [" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(120)] + ["", "ab"]
    patterns = [r"(?i)\bacme\b", "Steel", "Stee[l1]", r"(?i)works gmbh", r"^a$", r"\d\d$", "Ltd\\.", "(?i)pune|acme", "nowhere", "(Works )+GmbH", "Ö-AG", "(?i)STEEL (?:works )?gmbh", "", "[A-Z]{4}"]
    rules = spark.createDataFrame([(p, i) for i, p in enumerate(patterns)], "p string, number int")
    d = spark.createDataFrame([(n,) for n in set(names)], "name string")
    got = {(x["name"], x["number"]) for x in repair.fitting_formats(d, rules, "name", "p").collect()}
    assert got == {(n, i) for n in set(names) for i, p in enumerate(patterns) if re.search(p, n)}


def test_patterns_wait_for_strings_long_enough_to_tell_names_apart(spark):
    names = spark.createDataFrame([(f"Supplier#{i:09d}",) for i in range(0, 40_000, 100)], "name string")
    rules = spark.createDataFrame([(f"(?i)^SUPPLIER#{i:09d}$",) for i in range(0, 40_000, 50)], "p string")
    assert repair.tried_formats(names, rules, "name", "p").count() == 400  # every three letters of a number are in many names
    assert repair.fitting_formats(names, rules, "name", "p").count() == 400


def test_glyphs_on_one_spot_and_crowds():
    n = 30_000
    same = np.zeros(n)
    gone = layout._doubled(np.zeros(n, np.int64), np.zeros(n, bool), same, same + 8, same)
    assert gone.sum() == n - 1 and not gone[0]
    r = np.random.default_rng(2)
    for _ in range(40):
        n = int(r.integers(1, 120))
        page = np.sort(r.integers(0, 3, n))
        blank, top, x0, height = r.random(n) < 0.2, r.choice([0.0, 0.5, 2.0, 9.0], n), r.choice(np.arange(12) * 0.6, n), r.choice([0.0, 0.4, 8.0, 30.0], n)
        order = np.lexsort((x0, top, page))
        page, blank, top, x0, height = (c[order] for c in (page, blank, top, x0, height))
        want = np.zeros(n, bool)
        for p in set(page.tolist()):
            stay = []
            for i in np.flatnonzero(page == p).tolist():
                near = [k for k in stay[-12:] if blank[k] == blank[i] and abs(x0[k] - x0[i]) <= 1 and abs(top[k] - top[i]) <= max(1, 0.35 * (min(height[k], height[i]) or 1))]
                want[i] = bool(near)
                stay += [] if near else [i]
        assert (layout._doubled(page, blank, top, top + height, x0) == want).all()


def test_pages_of_glyphs_are_worked_on_where_they_lie(spark):
    r = random.Random(5)
    rows = []
    for doc in range(12):
        for seq in range(r.choice((1, 40, 150))):
            text, top = r.choice(("a", "b", " ", "\t", None, "")), r.choice((0.0, 0.4, 1.2, 9.0, None))
            x0 = r.choice((None, *(0.7 * i for i in range(60))))
            rows.append((doc, 1, seq, text, top, None if top is None else top + 8, x0, None if x0 is None else x0 + r.choice((0.0, 0.6, 1.4))))
    d = spark.createDataFrame(rows, "doc_id int, page_no int, seq int, text string, top double, bottom double, x0 double, x1 double")
    least = lambda *v: min(x for x in v if x is not None)
    most = lambda *v: max(x for x in v if x is not None)
    want = []
    for g in rows:
        inner = g[3] in (" ", "\t") and None not in g[4:8] and g[7] > g[6] and any(
            k[0] == g[0] and abs(k[2] - g[2]) <= 12 and k[3] in ("a", "b", "") and k[4] is not None and abs(k[4] - g[4]) <= most(1.0, 0.35 * (k[5] - k[4])) and least(g[7], k[7]) - most(g[6], k[6]) >= 0.5 * (g[7] - g[6]) for k in rows
        )
        want += [] if inner else [g[:3]]
    assert sorted(tuple(x)[:3] for x in layout.without_inner_spaces(d).collect()) == sorted(want)
    # By document, the pages lie together already: no glyph is shuffled again, and Python sees each once.
    plan = layout.without_overlaid_glyphs(d.repartition("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1 and plan.count("Sort ") == 1


def test_words_of_pages_are_those_of_glyphs_read_plainly(spark):
    r = random.Random(6)
    rows = [(doc, page, seq, r.choice(("a", "b", "cd", " ", None)), r.choice((0.0, 1.0, 2.0, 9.0)), 20.0, x0, x0 + r.choice((0.5, 3.0)))
            for doc in "xy" for page in (1, 2) for seq in range(r.choice((1, 60))) for x0 in (r.choice([2.5 * i for i in range(40)]),)]
    d = spark.createDataFrame(rows, "doc_id string, page_no int, seq int, text string, top double, bottom double, x0 double, x1 double")
    want = []
    for at in sorted({g[:2] for g in rows}):
        lines, last = [], None
        for g in sorted((g for g in rows if g[:2] == at), key=lambda g: (g[4], g[6], g[2])):
            if last is None or g[4] - last > 1.5:
                lines.append([])
            lines[-1].append(g)
            last = g[4]
        for line in lines:
            before = None
            for g in sorted(line, key=lambda g: (g[6], g[2])):
                fresh = before is None or g[6] > before[7] + 1.5 or before[3] in (" ", None)
                if g[3] not in (" ", None):
                    want = [*want, [g]] if fresh else [*want[:-1], [*want[-1], g]]
                before = g
    want = [(w[0][0], w[0][1], "".join(g[3] for g in w), min(g[6] for g in w), max(g[7] for g in w), min(g[4] for g in w), 20.0) for w in want]
    assert sorted(tuple(x) for x in layout.glyph_words(d).collect()) == sorted(want)
    widths = {tuple(x)[:2]: x["char_width"] for x in layout.char_widths(d).collect()}
    assert {(x["doc_id"], x["page_no"]): x["char_width"] for x in layout.page_words(d).collect()}.items() <= widths.items()
