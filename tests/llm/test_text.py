"""Tokenizers, toxicity and secrets against their libraries and brute force."""

import base64
import functools
import hashlib
import math
import random
import string
import re
import struct

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from ledgerline.llm import bpe, common, secrets, token_counts, toxicity

ALPHABET = "abstrvemld'' ''  \n\t\r 0123!?.,éßñ漢字　\xa0 €😀𝟘½_"
EDGE = [None, "", " ", "a" * 3000, " " * 500, "x'll's'tve're", "a\n\n b", "it's 'sand", "end  "]


def texts(n=1500, seed=3):
    r = random.Random(seed)
    return EDGE + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoding():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_librarys(encoding):
    rows = texts()
    got = [ids[x:y].tolist() for _, _, ids, b in bpe.encode_slices(pa.array(rows, pa.string()), P.path("byte_bpe_50k.tiktoken")) for x, y in zip(b, b[1:], strict=False)]
    assert got == [encoding.encode_ordinary(x or "") for x in rows]


def test_plain_path_and_long_pieces_agree(encoding):
    merge = bpe.merger(P.path("byte_bpe_50k.tiktoken"))
    for x in ("hello worldly " * 20, "z" * 700, "ab" * 400):
        assert bpe.encode_plainly(np.frombuffer(x.encode(), np.uint8), merge).tolist() == encoding.encode_ordinary(x)


def test_scan_is_sequential_composition():
    ids = np.random.default_rng(1).choice(bpe.SYMBOL_IDS, 1000)
    want = [int(ids[0])]
    for x in ids[1:]:
        want.append(int(bpe.PRODUCT[want[-1], x]))
    assert bpe.scan(ids).tolist() == want


def test_digests_and_round_trip(spark, encoding):
    rows = texts(200)
    d = spark.createDataFrame([(i, x, 7) for i, x in enumerate(rows)], "doc_id long, text string, ids int")
    for r in bpe.digests(d).collect():
        ids = encoding.encode_ordinary(rows[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((rows[r["doc_id"]] or "").encode()).hexdigest()
    path = P.path("byte_bpe_50k.tiktoken")
    back = bpe.decode(bpe.encode(d, path), path)
    assert all(r["text"] == (rows[r["doc_id"]] or "") for r in back.collect())


def test_counts_are_the_librarys(spark):
    rows = [*texts(800), "hi <|endoftext|>there<|endoftext|>", "<|endoftext|> a"]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [len(e.ids) for e in library.encode_batch([x or "" for x in rows], add_special_tokens=False)]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_counts.counts(d, limit=50).collect()}
    assert [got[i]["n_tokens"] for i in range(len(rows))] == want
    assert all(got[i]["n_bytes"] == len((x or "").encode()) and got[i]["over_limit"] == (want[i] > 50) for i, x in enumerate(rows))
    assert token_counts.counts(d.limit(0)).count() == 0


def test_whole_tokens_are_proven():
    of = token_counts.counter(P.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    some = random.Random(1).sample(of.whole, 300)
    assert all(len(e.ids) == 1 for e in library.encode_batch([x.decode() for x in some], add_special_tokens=False))


def toxic_tables(spark, n=600):
    r = random.Random(5)
    words = ["".join(r.choice("aeioumnrst") for _ in range(r.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        own = [r.choice(words) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            own[3], own[9] = r.choice(["vurgo", "zellick"]), r.choice(["vurgo", "brankle"])
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    rows += [(9001, "so V U R G O and nothing"), (9002, "a z3ll1ck here"), (9003, "some vurrrgo then"), (9004, None), (9005, ""), (9006, "plain mate")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None), (None, 1), (77777, 1)], "doc_id long, toxic int")


def test_toxicity_restores_disguised_words(spark):
    docs, labels = toxic_tables(spark)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == 606
    held = [i for i in range(600) if got[i]["held_out"]]
    assert 60 < len(held) < 180
    assert all(got[i]["predicted"] == int(i % 5 == 0) for i in held)
    assert [got[9000 + k]["predicted"] for k in range(1, 7)] == [1, 1, 1, 0, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in toxicity.clean(docs.withColumn("extra", docs.doc_id), labels).collect()}
    assert {9004, 9005, 9006} <= kept and not {9001, 9002, 9003} & kept


def test_toxicity_restores_spaced_runs_and_long_tokens(spark):
    docs, labels = toxic_tables(spark)
    rows = ["a v u r g o here", "so v u r g o z e l l i c k then", "m i r a n t o s e v u r g o m i n t a r e s o n i t u r a", "a plain v" + "u" * 70 + "rgo mate", "plain " + "m i r a t e n o " * 200 + "z e l l i c k" + " r a n o s e" * 200, "a m i r a t e n o here", "m i r a n o t e " * 300, "a" + "_" * 60 + "%", "x1" * 5000, None]
    more = spark.createDataFrame([(9100 + i, x) for i, x in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs.unionByName(more), labels).collect()}
    assert [got[9100 + i] for i in range(len(rows))] == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0]


def test_toxicity_without_labels_or_documents(spark):
    docs, labels = toxic_tables(spark, 20)
    assert toxicity.score(docs, labels.limit(0)).count() == 26
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_secrets(spark):
    rows = {
        1: 'x password = "abc123" y', 2: "TOKEN:short", 3: "api_key='Zx9/+kLm28Qw' AKIA" + "A" * 16, 4: "AKIAshort", 5: "f" * 24 + " " + "0" * 23, 6: None, 7: "", 8: "db://user:tR7$kq92!xWm@host", 9: "é😀 secret=zz9911aa", 10: "pwd: qwerty123456", 11: "Authorization: Bearer 8fK2mQ9xLw7ZpT4v", 12: "ſecret=abcdef1",
    }
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.scan(d).collect()}
    assert [(got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) for i in range(1, 13)] == [(1, 0, 0), (0, 0, 0), (1, 1, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert got[6]["base_sha256"] == got[7]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[9]["spans"].startswith("assign:3:18")
    assert got[1]["base_sha256"] == hashlib.sha256(b"assign:2:20").hexdigest()
    assert "guess" in got[3]["spans"] and "guess" in got[8]["spans"] and "guess" in got[11]["spans"]
    assert "guess" not in got[10]["spans"] and "guess" not in got[1]["spans"]


def test_secrets_of_letters_only_and_any_user_in_urls():
    found = lambda text: [text[a:b] for a, _, b in secrets.guessed_spans(text, text.lower())]
    assert found("pwd=QwXzPlKmNbVt x") == ["QwXzPlKmNbVt"]
    assert found("Authorization: Bearer AbCdXqWzKjVp") == ["AbCdXqWzKjVp"]
    assert found("redis://:tR7$kq92!xWm@host") == ["tR7$kq92!xWm"]
    assert found(f"db://{'u' * 80}:QwXzPlKmNbVt@host") == ["QwXzPlKmNbVt"]
    for text in ("pwd=international", "the secret agreement, the token password", "db://user:password@host", "db://@host:123456", "passphrase: development"):
        assert found(text) == []


def test_guess_costs():
    g = secrets.guess_log10
    assert g("password1") < 4 < g("xK9#mQ2$vL") and g("qwertyuiop") < 8 and g("aaaaaaaaaa") < 8 and g("2024-01-31") < 8
    assert g("x7" * 100) < 40


def test_guess_costs_of_ordinary_words():
    g = secrets.guess_log10
    for value in ("international_2024", "Development_1", "administrator1", "gouvernement2"):
        assert g(value) < secrets.GUESS_LOG10, value
    for value in ("QwXzPlKmNbVt", "xvqzkwjpgtrb", "tR7$kq92!xWm", "k9Zx_2024_vLq"):
        assert g(value) >= secrets.GUESS_LOG10, value
    assert not secrets.guessed_spans("api_key: international_2024", "api_key: international_2024")


def test_guess_costs_are_the_least_of_all_segmentations():
    r = random.Random(11)
    pieces = ["password", "Admin", "2024-01-31", "qwerty", "aaaa", "abc", "zx", "9!", "ababab", "P@ss", "K", "54321", "é"]
    for _ in range(120):
        value = "".join(r.choice(pieces) for _ in range(r.randint(1, 4)))[:18]
        segments, brute = list(secrets._segments(value)), math.log10(secrets._alphabet(value))

        def least(i, value=value, segments=segments, brute=brute):
            if i == len(value):
                return 0.0
            return min([brute + least(i + 1), *(cost + math.log10(secrets.SEGMENT) + least(j) for j, cost in segments[i])])

        want = functools.cache(least)(0)
        assert abs(secrets.guess_log10(value) - want) < 1e-9
        assert (secrets.guess_log10(value, 8.0) >= 8.0) == (want >= 8.0 - 1e-12)


def test_guess_costs_of_long_values():
    assert secrets.guess_log10("a" * 200_000) < 8 and not secrets.hard("ab" * 50_000)
    assert abs(secrets.guess_log10("a" * 64) - secrets.guess_log10("a" * 65)) < 0.1
    long = "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=300_000))
    assert secrets.hard(long)
    text = f"x token={long} y"
    assert secrets.guessed_spans(text, text.lower()) == [(8, 3, 8 + len(long))]


PLACEHOLDERS = """your_api_key_here not_a_real_secret process.env.API_TOKEN my_database_connection meinGeheimesPasswort mot_de_passe_exemple changeme123 Password1234 example-token-value insert_your_token_here REPLACE_WITH_YOUR_KEY
placeholder_secret test_password_2024 passwordpassword1 qwertyuiop123 aaaaaaaaaaaa 1234567890 contrasena_de_ejemplo dummy-api-key summer2023! secret_token_value os.environ.get your-secret-here my_secret_password config.api_key
settings.SECRET_KEY ein_neues_passwort abcabcabcabc localhost:8080 votre_cle_api 01/02/2023 example.com/token hunter2hunter2 default_admin_password user_access_token getSecretValue hunter2_hunter2_hunter2""".split()


def test_placeholders_are_told_from_random_values():
    r = random.Random(11)
    assert sum(not secrets.hard(x) for x in PLACEHOLDERS) >= 0.9 * len(PLACEHOLDERS)
    for letters, n in ((string.ascii_letters + string.digits, 9), (string.ascii_lowercase + string.digits, 10), ("0123456789abcdef", 12), (string.ascii_letters + string.digits + "+/_-", 20)):
        values = ["".join(r.choice(letters) for _ in range(n)) for _ in range(300)]
        assert sum(map(secrets.hard, values)) >= 0.95 * len(values), (letters, n)


def brute_base_spans(text):
    """The contract's expressions one by one; failing matches are dropped after matching."""
    out = []
    for kind, (pattern, flags, fits) in enumerate((
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m.group(2)) >= 6),
        (r"AKIA[A-Z0-9]+", 0, lambda m: len(m.group()) >= 20),
        (r"[0-9a-f]+", 0, lambda m: len(m.group()) >= 24),
    )):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if fits(m)]
    return sorted(out)


def test_base_spans_against_the_plain_expressions(spark):
    r = random.Random(12)
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ff", "x", "é", "😀", "\n", "abc/+_.=-9", "kelvin \u212a", "ſ", "tokentoken"]
    rows = [None, "", *("".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(400)), "z" * 200_000 + " secret: abcdef9 "]
    rows += rows[5:8]
    d = spark.createDataFrame([(i, x, "n") for i, x in enumerate(rows)], "doc_id long, text string, spans string")
    got = {x["doc_id"]: x for x in secrets.scan(d).collect()}
    assert len(got) == len(rows)
    hits = 0
    for i, text in enumerate(rows):
        want = brute_base_spans(text or "")
        hits += len(want)
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == [sum(x[1] == k for x in want) for k in range(3)]
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        spans = [x for x in got[i]["spans"].split(",") if x]
        assert [x for x in spans if not x.startswith("guess")] == [x for x in told.split(",") if x]
    assert hits > 60
    assert secrets.scan(d.limit(0)).count() == 0


def small_model(seed=2):
    r = random.Random(seed)
    text = " ".join("".join(r.choice("aeioumnrst") for _ in range(r.randint(2, 7))) for _ in range(500))
    c = toxicity._CODE[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
    grams, counts = np.unique((c[:-2] * toxicity.SIZE + c[1:-1]) * toxicity.SIZE + c[2:], return_counts=True)
    return toxicity.CharModel(grams, counts)


def brute_readings(token, model):
    """Every reading of a token with its cost, one path after another."""
    out = []

    def follow(i, a, b, last, cost, text):
        if i == len(token):
            out.append((cost + float(model.cost[a, b, toxicity.EDGE]), text))
            return
        c = token[i]
        for x, w in toxicity.choices(token, i):
            code = int(toxicity._CODE[ord(x)])
            follow(i + 1, b, code, c, cost + w + float(model.cost[a, b, code]), text + x)
        if c in toxicity.SEPARATORS:
            follow(i + 1, a, b, last, cost + toxicity.SKIP, text)
        elif i and last == token[i - 1] and (c == last or any(int(toxicity._CODE[ord(x)]) == b for x, _ in toxicity.choices(token, i))):
            follow(i + 1, a, b, c, cost + toxicity.DROP_REPEAT, text)

    follow(0, toxicity.EDGE, toxicity.EDGE, "", 0.0, "")
    return out


def test_viterbi_against_all_readings():
    model, r = small_model(), random.Random(13)
    for _ in range(80):
        token = "".join(r.choice("aeimnrstt1035@$!.-*") for _ in range(r.randint(2, 8)))
        every = brute_readings(token, model)
        cost, text = toxicity.cheapest(token, model)
        assert abs(cost - min(x for x, _ in every)) < 1e-6 and any(t == text and abs(x - cost) < 1e-6 for x, t in every)
        known = frozenset(t for _, t in r.sample(every, min(4, len(every)))) - {""}
        starts = frozenset(w[:i] for w in known for i in range(len(w) + 1))
        limit = cost + toxicity.MARGIN
        want = min((x, t) for x, t in every if t in known) if known else (math.inf, None)
        assert toxicity.known_word(token, model, known, starts, limit) == (want[1] if want[0] <= limit else None)


def test_toxicity_of_wide_gaps_repeats_and_ties(spark):
    docs, labels = toxic_tables(spark)
    rows = ["so v     u     r     g     o then", "vurg0" + "o" * 40 + " and", "plain ties mate", "plain ties mate"]
    more = spark.createDataFrame([(9200 + min(i, 2), x) for i, x in enumerate(rows)], "doc_id long, text string")
    out = toxicity.score(docs.unionByName(more).withColumn("score", docs.doc_id), labels.withColumn("quality", labels.toxic)).filter("doc_id >= 9200").collect()
    assert sorted((r["doc_id"], r["predicted"]) for r in out) == [(9200, 1), (9201, 1), (9202, 0), (9202, 0)]
    assert len({r["score"] for r in out if r["doc_id"] == 9202}) == 1


def test_words_and_hashes():
    data, offsets = common.buffers(pa.array(["a b", None, "", " a\tb ", "ab"], pa.string()))
    starts, ends, bounds = common.scan_words(data, offsets)
    h = common.span_hashes(data, starts, ends)
    assert bounds.tolist() == [0, 2, 2, 2, 4, 5]
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
