"""The phrase automaton against patterns, and party and route signals against a plain reading of the rules."""

import random
import re

import numpy as np
import pyarrow as pa

from ledgerline.functions import automaton
from ledgerline.functions import tables as t
from ledgerline.operators import classify


def test_automaton_finds_all_overlapping_strings_in_any_slices():
    r = random.Random(1)
    strings = ["ab", "abc", "b c", "bc", "c-b", "a", "cab", "b"]
    found = automaton.Automaton(strings)
    for turn in range(60):
        rows = ["".join(r.choice("abc -\nxé") for _ in range(r.choice([0, 1, 5, 30, 3000 if turn % 20 == 0 else 20]))) for _ in range(r.randint(1, 6))]
        for limit in (7, 1 << 20):
            got = []
            for at, _, data, offsets in automaton.text_slices(pa.array(rows), limit):
                got += [(at + i, s, rows[at + i].encode()[: a - offsets[i]].decode(), rows[at + i].encode()[: b - offsets[i]].decode()) for i, s, a, b in zip(*map(np.ndarray.tolist, found.find(data, offsets)), strict=True)]
            want = set()
            for i, text in enumerate(rows):
                for s, string in enumerate(strings):
                    pattern = re.escape(string).replace(r"\ ", r"[ \n]+").replace(r"\-", r"[ \n]*-[- \n]*")
                    want |= {(i, s, text[: m.start(1)], text[: m.end(1)]) for m in re.finditer(f"(?=({pattern}))", text)}
            assert sorted(got) == sorted(want)
    assert not len(automaton.Automaton([]).find(np.zeros(3, np.uint8), np.array([0, 3]))[0])


def phrase_patterns(phrase):
    return r"[ \t\n\x0b\f\r]+".join(map(re.escape, phrase.split())) if " " in phrase else rf"(?a:\b{re.escape(phrase)}\b)"


def test_phrases_as_patterns_find_them(spark):
    r = random.Random(2)
    words = [w for p in classify.PHRASES for w in p.split()] + ["x", "egms", "bill of", "BCD", "é"]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", "  ", "\n", "-", ", ", "\t"]) for _ in range(r.randint(0, 40)))) for i in range(300)] + [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: {k for k, p in enumerate(classify.PHRASES) if re.search(phrase_patterns(p), (x or "").lower())} for i, x in rows}
    assert {x["doc_id"]: set(x["f"]) for x in d.select("doc_id", classify.found("text", classify.PHRASES).alias("f")).collect()} == want
    spots = {(i, p, m.start(), m.end()) for i, x in rows for p in classify.PHRASES for m in re.finditer(phrase_patterns(p), (x or "").lower())}
    assert {tuple(x) for x in classify.occurrences(d, classify.PHRASES).collect()} == spots


PIECES = [
    "Buyer: ", "Seller ", "ship-to\n", "Sold  By: ", "Buyer's Order No ", "Consignee │ ", "Country of origin ", "Country of origin of goods: ", "Final destination: ", "port of import ", "India", " india ", "to India", "indiana ", "Germany", "Republic of Korea", "united  states", "United States ", "│", " │ ", "\n",
    "\n\n", "FCA ", "Pune, ", "x" * 300 + " ", "7 ", "é ", ": ", "Exporter Country ", "to\n", "invoice  to ",
]
COUNTRY = re.compile(r"(?a:\b(" + "|".join(t.COUNTRIES) + r")\b)")


def plain_parties(low):
    """Windows as texts: the rest of the label's line, then of every later line the cell under it."""

    def labels(names):
        for name in names:
            for m in re.finditer(r"[\s\-]+".join(name.split()), low):
                cell = re.split("[\n│]", low[: m.start()])[-1]
                if not re.search("[a-z]{2}", cell) and not re.match(t.REFERENCE_FIELD, low[m.end() : m.end() + 20]):
                    yield name, m.start(), m.end()

    sides = {"buyer": list(labels(t.BUYER_LABELS)), "supplier": list(labels(t.SUPPLIER_LABELS))}
    routes = [m.start() for p in (t.ORIGIN_LABEL, t.DESTINATION_LABEL) for m in re.finditer(f"(?=(?:{p}))", low)]
    out = []
    for side, other in (("buyer", "supplier"), ("supplier", "buyer")):
        near = set()
        for name, _, end in sides[side]:
            stop = min([end + 900] + [a for _, a, _ in sides[other] if a > end] + [a for a in routes if a >= end])
            first, *later = low[end:stop].split("\n")
            column = low[:end].split("\n")[-1].count("│")
            cells = [x.split("│") for x in later]
            window = "\n".join([first] + [c[0] if len(c) == 1 else (c[column : column + 1] or [""])[0] for c in cells])
            if any(not re.search(r"\bto\s*$", window[max(0, m.start() - 6) : m.start()]) for m in re.finditer(r"(?a:\bindia\b)", window)):
                near.add(name)
        out.append(len(near))
    return tuple(out)


def plain_route(low):
    o, d = re.search(t.ORIGIN_LABEL, low), re.search(t.DESTINATION_LABEL, low)

    def after(label, other):
        stop = label.end() + 150 if other is None else other.start() if other.start() > label.end() else len(low)
        m = COUNTRY.search(low, label.end(), stop)
        return m and m[1]

    a, b = o and after(o, d), d and after(d, o)
    if o and d and not (a and b):
        first = min(o.start(), d.start())
        two = list(COUNTRY.finditer(low, first))[:2]
        if len(two) == 2 and not re.sub(t.FORMAL_PREFIX, "", low[two[0].end() : two[1].start()].replace("│", "").strip()).strip():
            a, b = (two[0][1], two[1][1]) if o.start() <= d.start() else (two[1][1], two[0][1])
    return a == "india", b == "india"


def test_signals_as_a_plain_reading_finds_them(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(PIECES) for _ in range(r.randint(0, 25)))) for i in range(1500)] + [(9000, None), (9001, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: tuple(x)[1:] for x in classify.party_signals(d).collect()}
    hits = 0
    for i, text in rows:
        low = (text or "").lower()
        want = (*plain_route(low), *plain_parties(low)) if "india" in low else (False, False, 0, 0)
        hits += want != (False, False, 0, 0)
        # A "to" in the cell above, and words cut by a window's end, are read by places and not by texts.
        assert got.get(i, (False, False, 0, 0)) == want or re.search(r"to\s*\n[^\n]*│|to\s*│", low), (i, text, got.get(i), want)
    assert hits > 300
