"""Chat formatting, source divergence and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from ledgerline.llm import chat_format, common, divergence, queries, spelling

HARD = ["", "\\", "#", "##", "###", "####", "</turn>", "</", "<", "<\\/", "#\\#", " </turn>\n", "### assistant: x </turn>\n", "\\### Assistant: </turn> ok", "a\nb", "é", "😀", ": ", "\\\\", "plain words"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escapes_are_reversible_and_hide_control_strings():
    r = random.Random(1)
    for _ in range(3000):
        said = [("".join(r.choice(HARD) for _ in range(r.randint(0, 3))), "".join(r.choice(HARD) for _ in range(r.randint(0, 5)))) for _ in range(r.randint(0, 4))]
        text = "".join(f"### {chat_format.escape_role(a)}: {chat_format.escape(b)} </turn>\n" for a, b in said)
        back = chat_format.read_turns(text)
        assert [x[:2] for x in back] == said
        assert all("##" not in text[a:b] and "</" not in text[a:b] and chat_format.unescape(text[a:b]) == said[i][1] for i, (_, _, a, b) in enumerate(back))


def conversation_digests(rows):
    """conv -> (turns, digest, loss characters, loss digest), read from the rows."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        learned = "".join(t for _, _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{role}\n{t}\n" for _, _, role, t in turns)), len(learned), sha(learned))
    return out


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_conversations(spark, monkeypatch, part):
    monkeypatch.setattr(chat_format, "PART_CHARS", part)
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "a: b", "Assistant"]), r.choice([*HARD, None, "x" * 300])) for c in (*range(40), None, -7) for t in (*range(r.randint(1, 9)), None)]
    rows += rows[:20] + [(99, 0, "assistant", "y" * 200_000), (98, 5, None, None)] + [(97, t, "assistant", f"t{t}") for t in range(700)]
    clash = "tree long, leaf int, jump int, text string, role string, turn long, conv_id long, pos int, `a.b` int"
    d = spark.createDataFrame([(1, 2, 3, x, o, t, c, 4, 5) for c, t, o, x in rows], clash).repartition(4)
    texts, links = chat_format.chain(d)
    out = chat_format.formatted(texts, links, once=False)
    got = {x["conv_id"]: x for x in chat_format.digests(out).collect()}
    assert {c: (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) for c, x in got.items()} == conversation_digests(rows)
    sizes, parts = Counter(), 0
    for x in out.collect():
        parts = max(parts, x["part"])
        sizes[x["tree"]] += len(x["text"])
        assert all(x["text"][s["to"] :].startswith(" </turn>\n") for s in x["loss"])
    assert {c: x["formatted_chars"] for c, x in got.items()} == sizes and (parts > 100) == (part == 40)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.formatted(*chat_format.chain(empty), once=False)).count() == 0


def brute_paths(rows, keep):
    """tree -> paths as lists of ids, best first: mean score, then length, then leaf."""
    trees = {}
    for tree, i, parent, role, text, score in rows:
        trees.setdefault(tree, {}).setdefault(i, []).append((-(score or 0.0), parent is not None, parent or 0, role or "", text or ""))
    out = {}
    for tree, nodes in trees.items():
        own = {i: min(x) for i, x in nodes.items()}
        parent = {i: x[2] if x[1] and x[2] in own else None for i, x in own.items()}
        found = []
        for leaf in own:
            if leaf in {x[2] for x in own.values() if x[1]}:
                continue
            path, at = [], leaf
            while at is not None and at not in path:
                path.append(at)
                at = parent[at]
            if at is None:
                found.append((-sum(-own[i][0] for i in path) / len(path), -len(path), leaf, path[::-1]))
        out[tree] = [(x[3], own) for x in sorted(found)[:keep]]
    return out


@pytest.mark.parametrize("keep", [None, 1, 3])
def test_reply_trees(spark, keep):
    r = random.Random(3)
    rows = []
    for tree in range(12):
        n = r.randint(1, 25)
        rows += [(tree, i, r.choice([None, r.randrange(i), i - 1]) if i else None, r.choice(["user", "assistant"]), r.choice(HARD), r.choice([None, 0.0, 0.25, 0.5, 1.0])) for i in range(n)]
    rows += [(50, i, i - 1 if i else None, "assistant", f"t{i}", 0.5) for i in range(70)] + [(50, 100 + i, 3, "assistant", f"b{i}", 0.25) for i in range(30)]
    rows += [(60, 1, 2, "user", "on a cycle", 1.0), (60, 2, 1, "user", "on a cycle", 1.0), (60, 3, 2, "user", "below it", 1.0), (60, 9, 77, "user", "answers nobody", 1.0)]
    rows += [(70, 1, None, "user", "low", 0.0), (70, 1, None, "user", "high", 1.0), (70, 1, None, "user", "high", 1.0)]
    d = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double").repartition(3)
    texts, links = chat_format.messages(d)
    got = {}
    for x in chat_format.formatted(texts, links, keep).collect():
        got.setdefault(x["tree"], []).append(x)
    want = brute_paths(rows, keep)
    assert {t: sorted(x["leaf"] for x in v) for t, v in got.items()} == {t: sorted(p[-1] for p, _ in v) for t, v in want.items() if v}
    for tree, paths in want.items():
        by_leaf = {x["leaf"]: x for x in got.get(tree, [])}
        learned = Counter()
        for rank, (path, own) in enumerate(paths):
            x = by_leaf[path[-1]]
            turns = chat_format.read_turns(x["text"])
            assert [t[:2] for t in turns] == [(own[i][3], own[i][4]) for i in path] and x["rank"] == (None if keep is None else rank + 1)
            spans = {(s["from"], s["to"]) for s in x["loss"]}
            for i, (role, _, a, b) in zip(path, turns, strict=True):
                assert (a, b) not in spans or role == "assistant"
                learned[i] += (a, b) in spans
        shown = {i for path, _ in paths for i in path}
        assert all(learned[i] == (own[i][3] == "assistant") for i in shown)


def brute_divergence(rows, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in term.findall(text or "")]) for lang, source, text in rows]
    out = set()
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        df = Counter(t for x in own for t in set(x[2]))
        kept = sorted(t for t, n in df.items() if n >= 3)
        counts = {s: Counter(t for x in own if x[1] == s for t in x[2] if df[t] >= 3) for s in {x[1] for x in own}}

        def share(c, kept=kept):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // total for t in kept}

        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            apart = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(apart)[:top])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("held", [600_000, 5])
def test_divergence(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    r = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abcdé" for b in ("x", "Y", "zß", "qÉ", "日本")] + ["the", "The", "don't", "x1y", "_", "😀"]
    rows = []
    for _ in range(300):
        lang, source = r.choice(["de", "en", "", None]), r.choice(["s1", "s2", "s1", "S3", "é", "", None])
        rows.append((lang, source, r.choice([None, ""]) if r.random() < 0.1 else " ".join(r.choice(vocabulary[: 10 if source == "s2" else 40]) for _ in range(r.randint(0, 30)))))
    rows += [("one", "a", "rare words"), ("one", "b", None), ("one", "c", "12 34"), ("solo", "a", "w w w"), ("solo", "a", "w"), ("solo", "a", "W v"), ("en", "silent", "?")] + rows[:30]
    d = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], "lang string, source string, text string, at int, n long, vec int, `a.b` int").repartition(5)
    got = {tuple(x) for x in divergence.audit(d, top=7).collect()}
    assert got == brute_divergence(rows, 7)
    assert divergence.audit(d.limit(0)).count() == 0
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    assert {tuple(x) for x in divergence.audit(d, top=7).collect()} == got


def brute_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, ratio=10):
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    best = {w: min(x, key=lambda o: (-words[o], o)) for w, x in near.items() if x}
    form = {w: best[w] if w in best and words[best[w]] >= ratio * words[w] else None for w in words}
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def counted(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)


@pytest.mark.parametrize("bits", [64, 4])
def test_variants_of_dense_words(spark, bits):
    """With keys of four bits most words that meet have nothing in common."""
    r = random.Random(5)
    words = {}
    while len(words) < 500:
        base = r.choice(["aaaaaaa", "abababab", "qwertyu", "éclairée", "ÿÿÿÿÿÿÿ", "aabbccdd"])
        out = list(base)
        for _ in range(r.randint(0, 3)):
            at, letter = r.randrange(len(out)), r.choice("abqéÿ")
            out[at : at + r.randint(0, 1)] = r.choice([[letter], [letter] * 2, []])
        words.setdefault("".join(out), r.choice([2, 3, 20, 25, 250, 3000]))
    assert {tuple(x) for x in spelling.variants(counted(spark, words), bits=bits).collect()} == brute_variants(words)


def test_long_chains_long_words_and_batches(spark):
    chain = {"abcdefg" + "h" * k: 10**k for k in range(1, 12)}
    long = "".join(random.Random(6).choice("abcdefgh") for _ in range(20_000))
    words = chain | {long: 100, long[:700] + long[701:]: 2, long[:9000] + "z" + long[9001:]: 3, "x" * 5000: 2, "x" * 5001: 20, "x" * 4000 + "y" + "x" * 1000: 200}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {tuple(x) for x in spelling.variants(counted(spark, words)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute_variants(words)
    assert {x[2] for x in got if x[0] in chain} == {"abcdefg" + "h" * 11}


def test_words_of_documents(spark):
    r = random.Random(7)
    vocabulary = ["Spelling", "spelling", "VARIANT", "variants", "straße", "garçon", "naïvement", "ÉCLAIRÉE", "abc", "multiplied×words", "letters123letters", "Ωletters", "correct", "corect", "corrects"]
    rows = [(i % 90 if i % 7 else None, r.choice([None, ""]) if r.random() < 0.05 else " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(200)]
    d = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, word int, n int, `a.b` int").repartition(4)
    words = brute_words(rows)
    assert {(x["word"], x["n"]) for x in spelling.counted(spelling.planted_words(d)).collect()} == set(words.items())
    assert {tuple(x) for x in spelling.groups(d).collect()} == brute_variants(words)
    assert spelling.groups(d.limit(0)).count() == 0


def test_new_queries_are_registered():
    for name in ("op11_chat_format", "op12_source_divergence", "op13_spelling_variants"):
        assert name in queries.QUERIES and name in queries.ORACLE_SQL
    assert common.BATCH_ROWS == 1000
