"""Deduplication, joins, search, decontamination and url filters against brute force on small fixtures."""

import hashlib
import random

import numpy as np

from ledgerline.llm import components, decontamination, line_dedup, neighbours, ngram_join, substring_dedup, url_filter


def words(r, n, size=5000):
    return [f"w{r.randrange(size)}" for _ in range(n)]


def corpus(seed=1):
    """Copies, near copies, shared passages and lines, a hot line, and edge cases."""
    r = random.Random(seed)
    base = [words(r, r.randint(5, 150)) for _ in range(60)]
    passage, shared = words(r, 60), words(r, 30)
    rows = [" ".join(b) for b in base]
    for k in range(40):
        own = list(base[k % 8])
        for _ in range(k % 4):
            own[r.randrange(len(own))] = f"x{r.randrange(9999)}"
        rows.append(" ".join(own))
    rows += [" ".join(words(r, 20) + passage + words(r, 20)) for _ in range(5)]
    rows += [" ".join(words(r, 10)) + "\nHot  LINE\n" + " ".join(shared) for _ in range(14)]
    rows += [None, "", " \n\t", "one", "one two three four", "One two THREE four", "a " * 60, ("a b c " * 40).strip(), "hot  line", rows[0], rows[0]]
    return list(enumerate(rows, 100))


def docs_of(spark, rows, parts=6):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def brute_components(rows, num=80, den=100):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs_of(spark, rows)).collect()}
    want = brute_components(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 20
    kept = {r["doc_id"] for r in ngram_join.one_of_each(docs_of(spark, rows)).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def test_ngram_join_in_blocks(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 150)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs_of(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}


def test_joins_of_nothing(spark):
    none = docs_of(spark, [], 1)
    assert ngram_join.join(none).count() == 0
    assert substring_dedup.digests(none).count() == 0
    assert line_dedup.digests(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert ngram_join.join(odd).count() == 3


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 51), (51, 52), (52, 50), (70, 70)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 51: 50, 52: 50}


def brute_substrings(rows, n=20):
    first, out = {}, {}
    for i, text in sorted(rows):
        w = (text or "").encode().split()
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - n + 1):
            key = tuple(w[j : j + n])
            if first.setdefault(key, (i, j)) != (i, j):
                gone[j : j + n] = True
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_substring_dedup(spark, monkeypatch):
    rows = corpus(3)
    want = brute_substrings(rows)
    assert sum(x[1] > 0 for x in want.values()) > 30
    for hot in (20_000, 3):  # with and without salted minimisers
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digests(docs_of(spark, rows)).collect()}
        assert got == want


def test_wavelet_matrix_ranks():
    r = np.random.default_rng(2)
    sequence = r.integers(0, 37, 500)
    matrix = substring_dedup.WaveletMatrix(sequence, 37)
    symbols, at = r.integers(0, 37, 200), r.integers(0, 501, 200)
    assert matrix.rank(symbols, at).tolist() == [int((sequence[:k] == c).sum()) for c, k in zip(symbols, at, strict=True)]


def test_fm_index_counts_patterns():
    r = np.random.default_rng(3)
    symbols = np.append(r.integers(1, 4, 300), 0)
    index = substring_dedup.FMIndex(symbols, 4, 8)
    for k in range(40):
        pattern = symbols[k : k + 6]
        lo, hi = np.array([0]), np.array([len(symbols)])
        for c in pattern[::-1]:
            lo, hi = index.step(np.array([c]), lo, hi)
        assert hi[0] - lo[0] == sum(np.array_equal(symbols[j : j + 6], pattern) for j in range(295))


def brute_lines(rows, least=10):
    strip = lambda x: x.strip(b" \t\n\x0b\x0c\r").lower()
    split = {i: (t or "").encode().split(b"\n") for i, t in rows}
    seen = {}
    for i, lines in split.items():
        for x in lines:
            seen.setdefault(strip(x), set()).add(i)
    out = {}
    for i, lines in split.items():
        kept = [x for x in lines if not strip(x) or len(seen[strip(x)]) < least]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest())
    return out


def test_line_dedup(spark):
    rows = corpus(4)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.digests(docs_of(spark, rows)).collect()}
    want = brute_lines(rows)
    assert got == want and sum(x[1] for x in want.values()) >= 28
    d = docs_of(spark, rows).selectExpr("doc_id", "text", "length(text) AS n_chars", "1 AS __extra")
    kept = {r["doc_id"]: r for r in line_dedup.dedup(d).collect()}
    assert all(hashlib.sha256((kept[i]["text"] or "").encode()).hexdigest() == want[i][2] for i in want)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept.values())


def test_neighbours(spark):
    r = np.random.default_rng(4)
    v = r.standard_normal((300, 16)).astype(np.float32)
    v[40:60] = v[20]
    rows = [(i, [float(x) for x in row], 0) for i, row in enumerate(v)]
    rows += [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [1.0, None] * 8, 0), (1080, [1.0], 0), (None, [1.0] * 16, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {}
    for row in neighbours.search(d, d.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    scores = v.astype(np.float64) @ v.astype(np.float64).T
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        want = sorted((c for c in range(300) if c != q), key=lambda c: (-round(scores[q, c], 9), c))[:20]
        assert [c for _, c, _ in sorted(found)] == want
        assert all(abs(s - scores[q, c]) < 1e-12 for _, c, s in found)
    assert neighbours.search(d.limit(0), d.limit(0)).count() == 0


def test_tiles_lose_no_neighbour_of_wide_vectors():
    r = np.random.default_rng(9)
    for d in (64, 1536, 4096):
        v = (100 + r.integers(-3, 4, (200, d))).astype(np.float64)
        ids, scores = np.arange(200), v @ v.T
        found = {int(q): (c.tolist(), s.tolist()) for q, c, s in neighbours.tile(ids[:40], v[:40], ids, v, 20)}
        for q in range(40):
            want = sorted((c for c in range(200) if c != q), key=lambda c: (-scores[q, c], c))[:20]
            assert found[q] == (want, [scores[q, c] for c in want])


def test_tiles_of_extreme_values():
    v = np.array([[1e200, 1.0], [1e-320, 0.0], [-1e200, 2.0], [3.0, 4.0], [1e160, 1e160]])
    found = {int(q): c.tolist() for q, c, _ in neighbours.tile(np.arange(5), v, np.arange(5), v, 2)}
    assert found[3] == [0, 4] and found[1] == [0, 4]


def test_neighbours_over_many_tiles(spark, monkeypatch):
    for name, rows in (("QUERY_ROWS", 7), ("CANDIDATE_ROWS", 11), ("ROWS", 3), ("TASKS", 5)):
        monkeypatch.setattr(neighbours, name, rows)
    v = np.random.default_rng(10).integers(-2, 3, (120, 6)).astype(np.float64)  # many ties
    v[:, 0] = 1
    d = spark.createDataFrame([(i, x.tolist(), "t") for i, x in enumerate(v)], "vec_id long, embedding array<double>, rank string")
    got = {}
    for row in neighbours.search(d, d.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = (row["vec_id"], row["score"])
    scores = v @ v.T
    for q in range(0, 120, 20):
        want = sorted((c for c in range(120) if c != q), key=lambda c: (-scores[q, c], c))[:20]
        assert [got[q][k + 1] for k in range(20)] == [(c, scores[q, c]) for c in want]


def test_decontamination(spark):
    r = random.Random(6)
    common_words = [f"c{k}" for k in range(30)]
    mixed = lambda n: [r.choice(common_words) if r.random() < 0.5 else f"q{r.randrange(20000)}" for _ in range(n)]
    items = [(k, " ".join(mixed(r.randint(14, 60))) + ".") for k in range(25)]
    rows = [(i, " ".join(mixed(r.randint(20, 400)))) for i in range(300)]
    held = {}
    for i in range(0, 300, 6):
        k = r.randrange(25)
        own = rows[i][1].split()
        at = r.randrange(len(own))
        rows[i] = (i, " ".join(own[:at] + items[k][1].upper().split() + own[at:]))
        held[i] = k
    own = items[3][1].split()
    for j in range(0, len(own), 6):
        own[j] = f"z{j}"
    rows += [(900, " ".join(mixed(50) + own + mixed(50))), (901, None), (902, ""), (903, " ".join(items[4][1].split()[:5] + mixed(60)))]
    d, b = docs_of(spark, rows), spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(d, b).collect()}
    assert got == {*held.items(), (900, 3)}
    kept = {x["doc_id"] for x in decontamination.clean(d, b).collect()}
    assert kept == {i for i, _ in rows} - set(held) - {900}
    assert decontamination.clean(d, b.limit(0)).count() == len(rows)


def test_decontamination_of_long_items(spark):
    r = random.Random(8)
    common_words = [f"c{k}" for k in range(30)]
    mixed = lambda n: [r.choice(common_words) if r.random() < 0.5 else f"q{r.randrange(20000)}" for _ in range(n)]
    items = [(k, " ".join(mixed(n)) + ".") for k, n in enumerate((30, 800, 1100, 1500, 2500))]
    rows = [(i, " ".join(mixed(r.randint(20, 400)))) for i in range(100)]
    for k in range(1, 5):
        whole, changed = items[k][1].split(), items[k][1].split()
        for j in r.sample(range(len(changed)), len(changed) * 3 // 10):
            changed[j] = f"z{r.randrange(20000)}"
        rows += [(900 + k, " ".join(mixed(75) + whole + mixed(50))), (910 + k, " ".join(mixed(75) + changed + mixed(50))), (920 + k, " ".join(mixed(50) + whole[: len(whole) // 3] + mixed(50)))]
    d, b = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["lcs"] for x in decontamination.contaminated(d, b).collect()}
    assert set(got) == {(at + k, k) for at in (900, 910) for k in range(1, 5)}
    assert all(got[900 + k, k] > 0.999 for k in range(1, 5))


def variants(r, item, mixed):
    """Exact, word-swapped and sentence-shuffled copies of an item, with other words around."""
    own = item.split()
    swapped = [f"z{r.randrange(9999)}" if r.random() < 0.25 else x for x in own]
    cut = len(own) // 3
    turned = own[cut:] + own[:cut]
    dropped = [x for x in own if r.random() > 0.2]
    return [" ".join(mixed(40) + x + mixed(40)) for x in (own, swapped, turned, dropped)]


def test_retrieval_finds_what_an_exhaustive_search_finds(spark, monkeypatch):
    r = random.Random(14)
    common_words = [f"c{k}" for k in range(40)]
    mixed = lambda n: [r.choice(common_words) if r.random() < 0.5 else f"q{r.randrange(3000)}" for _ in range(n)]
    items = [(k, " ".join(mixed(r.choice((8, 20, 45, 90, 200)))) + ".") for k in range(40)]
    rows = [" ".join(mixed(r.randint(20, 300))) for _ in range(150)] + [x for _, item in items for x in variants(r, item, mixed)]
    d, b = docs_of(spark, list(enumerate(rows))), spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(d, b).collect()}
    monkeypatch.setattr(decontamination, "ITEMS", 25)  # four parts or so, in one pass and in several
    in_parts = {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(d, b).collect()}
    monkeypatch.setattr(decontamination, "PARTS", 2)
    assert {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(d, b).collect()} == in_parts
    monkeypatch.undo()
    monkeypatch.setattr(decontamination, "MIN_COSINE", -2.0)  # every passage is compared with every item
    every = {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(d, b).collect()}
    assert len(every) > 80 and found <= every and len(found) >= 0.95 * len(every)
    assert in_parts <= every and len(in_parts) >= 0.95 * len(every)
    assert all((150 + 4 * k, k) in found for k in range(40))


def test_items_of_a_few_words_are_found_in_a_row(spark):
    items = [(1, "Who wrote it?"), (2, "Who wrote it yesterday evening?"), (3, "x y z")]
    rows = [(1, "someone asked: who wrote it yesterday evening? nobody knew " * 2), (2, "who wrote it"), (3, "who then wrote it"), (4, "x y\nz"), (5, "x y"), (6, "z x y")]
    d, b = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(d, b).collect()} == {(1, 1), (1, 2), (2, 1), (4, 3)}


def test_decontamination_of_short_items_and_odd_tables(spark):
    items = [(1, "What is it?"), (2, "yes"), (3, "  "), (4, "what IS it"), (5, None), (None, "so long and thanks for fish")]
    rows = [(1, "a\n what is it \nb"), (2, "what is it now"), (3, "Yes."), (4, "yes it is"), (5, ""), (6, None), (None, "x y\nYES"), (1, "other"), (3, "Yes."), (7, "and so long and thanks for fish he said " * 3)]
    d = spark.createDataFrame([(*x, i, i, i) for i, x in enumerate(rows)], "doc_id long, text string, __doc int, __gone int, item_id int").repartition(3)
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    got = sorted((str(x["doc_id"]), str(x["item_id"])) for x in decontamination.contaminated(d, b).collect())
    assert got == [("1", "1"), ("1", "4"), ("2", "1"), ("2", "4"), ("3", "2"), ("3", "2"), ("4", "2"), ("7", "None"), ("None", "2")]
    kept = decontamination.clean(d, b)
    assert kept.columns == d.columns and sorted(x["__doc"] for x in kept.collect()) == [4, 5, 7]
    assert decontamination.clean(d.limit(0), b).count() == 0 and decontamination.contaminated(d.limit(0), b).count() == 0


def test_weighted_lcs_in_blocks(monkeypatch):
    r = np.random.default_rng(5)
    for n, m in ((1, 1), (7, 0), (50, 80), (37, 200)):
        item, region, weights = r.integers(0, 9, n), r.integers(0, 9, m), r.random(n)
        monkeypatch.setattr(decontamination, "CELLS", 1 << 20)
        want = decontamination.weighted_lcs(item, weights, region)
        monkeypatch.setattr(decontamination, "CELLS", 1)
        assert decontamination.weighted_lcs(item, weights, region).tolist() == want.tolist()


def test_weighted_lcs():
    a = np.array([1, 2, 3, 4], np.uint64)
    assert decontamination.weighted_lcs(a, np.ones(4), np.array([9, 1, 3, 9, 4, 2], np.uint64)).tolist() == [True, False, True, True]


def test_url_rules(spark):
    urls = ["http://A.Example.net/en/1?x#y", "http://x.net/a", "https://example.com/de/", "https://blog.example.com/fr/", "http://w.example.org/fr/9", "no host", None, "http://", "http://netx/en", "ftp://q.net", "http://example.net/en"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("x.net", "/a", "net/", "block")
    assert got[2][2:] == ("example.com/de/", "block") and got[3][2] is None
    assert got[4][2:] == ("org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][:2] == ("", "")
    assert got[8][2] is None and got[9] == ("q.net", "", None, got[9][3]) and got[10][2:] == ("net/", "block")


def test_distrust_runs_against_links(spark):
    link = lambda *to: "".join(f'<a href="http://{h}/x">t</a>' for h in to)
    rows = [(1, "http://bad.net/", ""), (2, "http://fan.test/", link("bad.net")), (3, "http://good.org/", link("liked.test")), (4, "http://liked.test/", ""), (5, "http://alone.test/", link("alone.test"))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["host"]: r["verdict"] for r in url_filter.judge(d).collect()}
    assert got == {"bad.net": "block", "fan.test": "block", "good.org": "allow", "liked.test": "allow", "alone.test": "allow"}
    assert url_filter.judge(d.limit(0)).count() == 0


def test_pagerank_by_hand(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 0.5), ("b", "c", 0.5)], "src string, dst string, w double")
    seeds = spark.createDataFrame([("a", 1.0)], "host string, seed double")
    got = {r["host"]: r["score"] for r in url_filter.propagate(edges, seeds, 2, 0.5).collect()}
    one = {"a": 0.5, "b": 0.5}
    two = {"a": 0.5 + 0.5 * 0.5 * one["b"], "b": 0.5 * one["a"], "c": 0.5 * 0.5 * one["b"]}
    assert got == two


def test_scores_go_on_until_they_settle(spark):
    link = lambda *to: "".join(f'<a href="http://{h}/x">t</a>' for h in to)
    rows = [(0, "http://bad.net/", "")] + [(k, f"http://fan{k}.test/", link(f"fan{k - 1}.test" if k > 1 else "bad.net")) for k in range(1, 13)]
    rows += [(100, "http://good.org/", link("ring0.test"))] + [(101 + k, f"http://ring{k}.test/", link(f"ring{(k + 1) % 7}.test")) for k in range(7)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["host"]: r for r in url_filter.judge(d).collect()}
    assert all(got[f"fan{k}.test"]["verdict"] == "block" for k in range(1, 13))
    for k in range(13):
        score = 0.15 * 0.85**k
        assert abs(got[f"fan{k}.test" if k else "bad.net"]["distrust"] - score) < 1e-6 * score
    for k in range(7):
        score = 0.15 * 0.85 ** (k + 1) / (1 - 0.85**7)
        assert got[f"ring{k}.test"]["verdict"] == "allow" and abs(got[f"ring{k}.test"]["trust"] - score) < 1e-5 * score


def test_the_basis_holds_items_whole_whatever_documents_there_are():
    import pyarrow as pa

    from ledgerline.llm import common
    from ledgerline.llm import decontamination as m

    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 400)) for _ in range(90)) for _ in range(30)]
    words, bounds = m.scan(*common.buffers(pa.array(texts)))
    vocabulary = m.Vocabulary(words)
    _, _, index, number, weight = m.passages(words, bounds, vocabulary, np.ones(len(vocabulary)))
    basis = m.latent_basis((index, number, weight), vocabulary)
    whole = np.zeros((index.max() + 1, len(vocabulary)))
    whole[index, number] = weight
    assert np.allclose(whole @ basis @ basis.T, whole)
