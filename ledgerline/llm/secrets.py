"""Secret scan: fixed patterns, and guess costs of values in credential contexts.

Three fixed kinds are found in every text: assignments, access keys and long hex
runs. The method adds spans of kind `guess`: a value in a credential context (an
assignment, a longer list of credential words, or user:value@ in a URL, with any user or none) is cut
into words, dates, sequences, repeats, keyboard walks and brute-force characters
so that the product of the segments' guesses is least; words are those that guessers try
first and then those of the public tokenizers' vocabularies, which are ranked by frequency, and
the pieces of longer words; a separator between segments is one of a few, a repeated block costs what
its own cheapest segmentation costs. Values that still need 10^GUESS_LOG10 guesses or more are reported:
eight random letters and digits do, phrases such as your_api_key_here do not. Values of any length are segmented
whole, from left to right, and no further than until every segmentation is known
to cost the limit. Offsets are in code points, ends exclusive.

Null and empty texts have no spans; an empty table gives no rows. Rows are scanned
one by one, so repeated rows repeat; extra columns are ignored. Spans that start
together go by kind, then by end.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "guess")
#: Values that take at least 10 to this power of guesses are reported.
GUESS_LOG10 = 11.0
MIN_VALUE, MIN_HEX, MIN_ACCESS = 6, 24, 20
#: Longest block that counts as repeated.
BLOCK = 16
#: Signs that separate words of a phrase, and the guesses one of them takes.
SEPARATORS, SEPARATOR_GUESSES = frozenset("_-./:+ "), 2
#: Longest keyboard walk that is one segment; longer ones are several.
WALK = 32

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as runs of which short ones are dropped
CONTEXT = re.compile(r"""(?:pwd|pass(?:word|wd|phrase|code)?|secret|token|api[_-]?key|credentials?|private[_-]?key|access[_-]?key|client[_-]?secret|bearer|authorization)["']?\x20*(?:[:=]\x20*|\x20)["']?(?:bearer\x20+)?([^\s"'<>,;]{6,})""", re.IGNORECASE | re.ASCII)
IN_URL = re.compile(r"://[^\s/:@]*+:([^\s/@]{6,})@")
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
CONTEXT_HINTS = (*ASSIGN_HINTS, "pwd", "pass", "credential", "private", "access", "bearer", "authorization", "api-key")

# Words that guessers try first, most frequent first (fixed values).
COMMON_WORDS = (
    "password", "admin", "welcome", "login", "letmein", "master", "monkey", "dragon", "secret", "token", "test", "guest", "root", "user", "hello", "love", "sunshine", "princess", "football", "baseball", "shadow", "superman", "batman", "trustno", "iloveyou", "access", "default", "changeme", "example", "placeholder", "dummy", "sample", "temp", "qwerty", "summer", "winter", "spring", "autumn", "demo", "server", "database", "system", "private", "public", "api", "key", "pass", "word", "null", "none", "true", "false", "your", "here", "insert", "replace", "todo", "abc", "foo", "bar", "the", "and", "for",
    "passwort", "kennwort", "geheim", "geheimes", "mein", "neues", "beispiel", "mot", "passe", "exemple", "secrete", "votre", "contrasena", "clave", "ejemplo", "nueva", "senha",
)
#: Vocabularies whose pieces follow by rank: those that begin a word, and those within words, which come after one another.
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: What a segment costs besides its guesses: the choice to cut there.
SEGMENT = 1.5
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@301$57!", "aaeoissti")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")


def _neighbours() -> frozenset[tuple[str, str]]:
    out = set()
    for r, row in enumerate(ROWS):
        for i, a in enumerate(row):
            near = [row[j] for j in (i - 1, i + 1) if 0 <= j < len(row)]
            if r + 1 < len(ROWS):
                near += [ROWS[r + 1][j] for j in (i - 1, i) if 0 <= j < len(ROWS[r + 1])]
            out |= {(a, b) for b in near} | {(b, a) for b in near}
    return frozenset(out)


NEIGHBOURS = _neighbours()


@functools.cache
def word_ranks() -> tuple[dict[str, int], int]:
    """Ranks of all words of three letters or more, the least of any list, and the longest word's length."""
    out = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
    for name in VOCABULARIES:
        rank, seen = len(COMMON_WORDS), set()
        with open(public_tokenizers.path(name), "rb") as lines:
            for line in lines:
                word = base64.b64decode(line.split()[0]).decode(errors="replace")
                low = (word[1:] if word[0] == " " else word).lower()
                if len(low) >= 3 and low.isalpha() and low not in seen:
                    seen.add(low)
                    rank += 1
                    out[low] = min(rank, out.get(low, rank))
    return out, max(map(len, out))


def _alphabet(value: str) -> int:
    kinds = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))
    size = sum(n for has, n in kinds if any(map(has, value)))
    return size + (33 if any(not c.isalnum() for c in value) else 0) or 10


def _reaches(n: int, joined) -> list[int]:
    """For each place the end of the longest stretch from it whose neighbours are `joined` (i with i + 1)."""
    out = [n] * n
    for i in range(n - 2, -1, -1):
        out[i] = out[i + 1] if joined(i) else i + 1
    return out


def _segments(value: str) -> Iterator[list[tuple[int, float]]]:
    """For each place, the (end, log10 guesses) of the segments from it that may be cheaper than brute force."""
    low = value.lower()
    if len(low) != len(value):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    n = len(value)
    ranks, longest = word_ranks()
    alike = _reaches(n, lambda i: low[i] == low[i + 1])
    walks = _reaches(n, lambda i: (low[i], low[i + 1]) in NEIGHBOURS)
    rows = [_reaches(n, lambda i, step=step: ord(low[i + 1]) - ord(low[i]) == step and low[i + 1].isalnum()) for step in (1, -1)]
    for i in range(n):
        out = []
        if value[i] in SEPARATORS:  # its segment has no price of its own
            out.append((i + 1, math.log10(SEPARATOR_GUESSES / SEGMENT)))
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
            if rank:
                case = 0 if value[i:j] == low[i:j] else math.log10(2) if value[i:j] in (low[i:j].upper(), low[i:j].capitalize()) else (j - i) * math.log10(2)
                out.append((j, math.log10(rank + 1) + case + (0 if low[i:j] in ranks else math.log10(4))))
        m = DATE.match(low, i)
        if m:
            out.append((m.end(), math.log10(366 * 119) if m.end() - i > 4 else math.log10(119)))
        if alike[i] - i >= 3:
            out.append((alike[i], math.log10(26 * (alike[i] - i))))
        for size in range(2, min(BLOCK, (n - i) // 2) + 1):
            if low[i : i + size] == low[i + size : i + 2 * size] and (i < size or low[i - size : i] != low[i : i + size]):
                block, j = low[i : i + size], i + 2 * size
                while low.startswith(block, j):
                    j += size
                out.append((j, guess_log10(value[i : i + size]) + math.log10((j - i) // size)))
        for k in range(i + 4, min(walks[i], i + WALK) + 1):
            out.append((k, math.log10(47) + (k - i) * math.log10(1.6)))
        for reach in rows:
            if reach[i] - i >= 3:
                out.append((reach[i], math.log10(26 * 2 * (reach[i] - i))))
        yield out


def guess_log10(value: str, enough: float = math.inf) -> float:
    """log10 of the guesses of the cheapest segmentation; if that is `enough` or more, any number from `enough` on.

    Every segmentation has an end at a place or a segment over it, so once all
    of these cost `enough`, so does the whole.
    """
    brute, n = math.log10(_alphabet(value)), len(value)
    best = [0.0] + [math.inf] * n
    over: dict[int, float] = {}  # ends of segments over this place, and the costs up to them
    for i, segments in enumerate(_segments(value)):
        best[i] = min(best[i], over.pop(i, math.inf))
        least = min([best[i], *over.values()])
        if least >= enough:
            return least
        best[i + 1] = min(best[i + 1], best[i] + brute)
        for j, cost in segments:
            over[j] = min(over.get(j, math.inf), best[i] + cost + math.log10(SEGMENT))
    return min(best[n], over.get(n, math.inf))


def hard(value: str) -> bool:
    """Whether the value takes 10^GUESS_LOG10 guesses or more."""
    return _hard(value) if len(value) <= 128 else guess_log10(value, GUESS_LOG10) >= GUESS_LOG10


@functools.lru_cache(1 << 14)
def _hard(value: str) -> bool:
    return guess_log10(value, GUESS_LOG10) >= GUESS_LOG10


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), by start and then kind."""
    out = []
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guessed_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """Values in credential contexts that are hard to guess."""
    found = set()
    if any(h in low for h in ASSIGN_HINTS):
        found |= {m.span(2) for m in ASSIGN.finditer(text)}
    if any(h in low for h in CONTEXT_HINTS):
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            found.add((a, a + len(text[a:b].rstrip(".,:!?)"))))
    if "://" in text:
        found |= {m.span(1) for m in IN_URL.finditer(text)}
    return sorted((a, 3, b) for a, b in found if b - a >= MIN_VALUE and hard(text[a:b]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the fixed kinds, SHA-256 of their spans, and all spans."""

    def run(batches):
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                low = text.lower()
                base = base_spans(text, low)
                for k, of in enumerate(counts):
                    of.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + guessed_spans(text, low))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
