"""What gives raw headers and items: a table of recorded answers, rules, or a service.

An answer is JSON text. `parsed` mends what can be mended with SQL functions, and
only the rest goes through Python.
"""

from __future__ import annotations

import ast
import base64
import functools
import json
import re
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions import values as v
from ..operators import text as tx

_EMPTY = r":\s*(?:N/A|n/a|NA|na|None|undefined|NaN|-|\?)(?=\s*[,}\]])"


def tidied(answer) -> Column:
    """The outermost object or array of an answer, without fences, empty words, trailing commas and Python's booleans."""
    c = F.regexp_replace(F.regexp_replace(F.trim(v.col(answer)), r"^```[a-zA-Z]*\n?", ""), r"```\s*$", "")
    c = F.coalesce(v.filled(F.regexp_extract(c, r"(?s)([\{\[].*[\}\]])", 1)), c)
    for pattern, to in ((_EMPTY, ": null"), (r":\s*,\s*", ": null, "), (r",\s*([}\]])", "$1"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false")):
        c = F.regexp_replace(c, pattern, to)
    return c


def mended(text: str | None) -> str | None:
    """JSON from what only Python reads: literals with single quotes, or an object cut off at its end."""
    begin = re.search(r"[{\[]", text or "")
    if begin is None:
        return None
    text = text[begin.start() :]
    try:
        return json.dumps(ast.literal_eval(re.sub(r"\bnull\b", "None", re.sub(r"\btrue\b", "True", re.sub(r"\bfalse\b", "False", text)))))
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        pass
    closers = []
    quoted = escaped = False
    for c in text:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            closers.append("}" if c == "{" else "]")
        elif not quoted and c in "}]" and closers:
            closers.pop()
    try:
        return json.dumps(json.loads((text + '"' * quoted).rstrip().rstrip(",:") + "".join(reversed(closers))))
    except ValueError:
        return None


def parsed(answers: DataFrame, answer: str = "answer", to: str = "json") -> DataFrame:
    """`answers` with valid JSON text, or null where nothing helps."""

    @F.pandas_udf("string")
    def residue(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(mended)

    whole, tidy = F.col(answer), tidied(answer)
    valid = lambda c: F.try_parse_json(c).isNotNull()
    direct = F.when(valid(whole), whole).when(valid(tidy), tidy)
    good = answers.withColumn(to, direct)
    return good.withColumn(to, F.when(F.col(to).isNotNull(), F.col(to)).otherwise(residue(F.when(F.col(to).isNull(), tidy))))


def items_of(answers: DataFrame, column: str = "json") -> DataFrame:
    """(doc_id, pos, fields): the list itself, or the one under line_items, items, ITEM or items_list."""
    c = F.col(column)
    found = F.coalesce(*[F.get_json_object(c, f"$.{k}") for k in ("line_items", "items", "ITEM", "items_list")], F.when(F.ltrim(c).startswith("["), c))
    rows = answers.select("doc_id", F.posexplode(F.from_json(found, "array<map<string,string>>")).alias("p", "fields"))
    return rows.select("doc_id", (F.col("p") + 1).alias("pos"), "fields")


def header_of(answers: DataFrame, fields, column: str = "json") -> DataFrame:
    """doc_id and the named fields as texts, from the answer or from its invoice_header."""
    c = F.col(column)
    inner = F.coalesce(F.get_json_object(c, "$.invoice_header"), F.get_json_object(c, "$.header"), c)
    return answers.select("doc_id", *[F.get_json_object(inner, f"$.{f}").alias(f) for f in fields])


class Replay:
    """Recorded answers: (doc_id, pass, attempt, payload). A pending document without one is an error, so that calls stay counted."""

    def __init__(self, answers: DataFrame, fields):
        self.answers, self.fields = answers, fields

    def __call__(self, kind: str, attempt: int, pending: DataFrame) -> DataFrame:
        own = self.answers.filter((F.col("pass") == kind) & (F.col("attempt") == attempt)).select("doc_id", "payload")
        met = pending.select("doc_id").join(own, "doc_id", "left")
        sure = met.withColumn("answer", F.coalesce("payload", F.raise_error(F.concat(F.lit(f"no recorded {kind} answer {attempt} for "), F.col("doc_id").cast("string")))))
        answers = parsed(sure)
        return header_of(answers, self.fields) if kind == "header" else items_of(answers)


# --- requests to a model --------------------------------------------------------

#: What the two passes ask for, apart from the names of the fields.
_ASKS = {
    "header": "You read trade invoices. Answer with one JSON object that has exactly these keys; copy what the document prints, and give null for what it does not print:",
    "items": "You read trade invoices. Answer with {\"line_items\": [...]}: one object for each row of the item table that has its own quantity and amount, on every page, with these keys; copy figures digit by digit, compute nothing, and give null for what is not printed. Rows of packing lists, charges and totals are no items:",
}
#: Pages up to which a document's items are asked for at once, pages of a request beyond that, and the effort of a model's second look.
WHOLE_PAGES, CHUNK_PAGES, EFFORT, FINE_EFFORT = 3, 2, "minimal", "medium"


def system_prompt(kind: str) -> str:
    return f"{_ASKS[kind]} {', '.join(t.HEADER_FIELDS if kind == 'header' else t.ITEM_FIELDS)}"


def user_prompt(pending: DataFrame, kind: str, text: str = "text") -> Column:
    """The document (after its tables, where there are any) and, on a retry, the last answer and what was found wrong with it."""
    have = set(pending.columns)
    of = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    told, last = ("header_feedback", "previous_header") if kind == "header" else ("items_feedback", "previous_items")
    part = lambda title, c: F.when(v.filled(c).isNotNull(), F.concat(F.lit(title + "\n"), c))
    retry = F.when(of(told).isNotNull(), F.concat_ws("\n\n", part("LAST ANSWER", F.coalesce(of(last), F.lit("{}"))), part("FINDINGS", of(told))))
    return F.concat_ws("\n\n", part("TABLES", of("tables")), part("DOCUMENT", F.col(text)), retry)


def requests(pending: DataFrame, kind: str, model: str, text: str = "text") -> Column:
    """The body of a chat request as JSON. Models that reason are given an effort instead of a response format."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    turns = F.array(turn("system", F.lit(system_prompt(kind))), turn("user", user_prompt(pending, kind, text))).alias("messages")
    named = F.lit(model).alias("model")
    plain = F.to_json(F.struct(named, turns, F.struct(F.lit("json_object").alias("type")).alias("response_format")))
    fine = F.coalesce(F.col("fine"), F.lit(False)) if "fine" in pending.columns else F.lit(False)
    reasoning = F.to_json(F.struct(named, turns, *([] if kind == "header" else [F.when(fine, FINE_EFFORT).otherwise(EFFORT).alias("reasoning_effort"), F.lit("low").alias("verbosity")])))
    return F.when(v.is_reasoning_model(F.lit(model)), reasoning).otherwise(plain)


def usage(response) -> Column:
    """struct<input_tokens, cached_tokens, output_tokens> of a response's JSON; what it does not say is 0."""
    of = lambda path: F.coalesce(F.get_json_object(v.col(response), f"$.usage.{path}").try_cast("long"), F.lit(0))
    return F.struct(of("prompt_tokens").alias("input_tokens"), of("prompt_tokens_details.cached_tokens").alias("cached_tokens"), of("completion_tokens").alias("output_tokens"))


def item_chunks(pending: DataFrame) -> DataFrame:
    """`pending` with chunk_no and `text` cut for the item pass, without transport pages.

    Up to WHOLE_PAGES pages go as one; longer documents in chunks of CHUNK_PAGES. Where `fine` is
    set, every page of a document with several goes alone, later ones after the table's
    heading on the first page, and without findings, which no single page can answer.
    """
    have = set(pending.columns)
    fine = F.coalesce(F.col("fine"), F.lit(False)) if "fine" in have else F.lit(False)
    paged = pending.withColumn("__pages", tx.page_array(tx.without_transport_pages("text")))
    alone = fine & (F.size("__pages") > 1)
    heading = tx.table_heading(F.get("__pages", F.lit(0)))
    led = F.transform("__pages", lambda p, i: F.when((i > 0) & (heading != ""), F.concat(F.lit("HEADING OF THE ITEM TABLE ON PAGE 1 (no row itself; the page below may have no rows, then the list is empty)\n"), heading, F.lit("\n\n"), p)).otherwise(p))
    starts = F.sequence(F.lit(0), F.size("__pages") - 1, F.lit(CHUNK_PAGES))
    grouped = F.transform(starts, lambda i: F.array_join(F.slice("__pages", i + 1, F.lit(CHUNK_PAGES)), "\n\n"))
    chunks = F.when(alone, led).when(F.size("__pages") <= WHOLE_PAGES, F.array(F.array_join("__pages", ""))).otherwise(grouped)
    cut = paged.withColumn("__alone", alone).select("*", F.posexplode(chunks).alias("chunk_no", "__chunk"))
    several = F.size("__pages") > F.when(F.col("__alone"), 1).otherwise(WHOLE_PAGES)
    out = cut.withColumn("text", F.col("__chunk"))
    if "items_feedback" in have:
        out = out.withColumn("items_feedback", F.when(~F.col("__alone"), F.col("items_feedback")))
    if "previous_items" in have:
        out = out.withColumn("previous_items", F.when(~several, F.col("previous_items")))
    return out.drop("__pages", "__alone", "__chunk")


def in_order(chunked: DataFrame) -> DataFrame:
    """(doc_id, pos, fields) from items with chunk_no: pos counts through a document's chunks in their order."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no", "pos"))
    return chunked.select("doc_id", n.cast("int").alias("pos"), "fields")


def with_backoff(call: Callable[[str], str], tries: int = 4, first: float = 2.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """`call`, asked again up to `tries` times in all when it fails, after waits that double from `first` to `most` seconds."""

    def patient(body: str) -> str:
        for i in range(tries - 1):
            try:
                return call(body)
            except Exception:
                sleep(min(most, first * 2**i))
        return call(body)

    return patient


#: Letters of a request that count as one token where a service has not said yet how many there were.
LETTERS_A_TOKEN = 4


class Pace:
    """Spaces requests so that no more than `per_minute` tokens, and one request, begin in any minute.

    A request of n tokens keeps the next one waiting for n shares of a minute. What a response says it
    took replaces the estimate: the wait is longer or shorter by the difference.
    """

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if per_minute <= 0:
            raise ValueError("a pace is over 0 tokens a minute")
        self.seconds, self.clock, self.sleep = 60.0 / per_minute, clock, sleep
        self.free = clock()

    def call(self, call: Callable[[str], str], body: str) -> str:
        estimate = len(body) / LETTERS_A_TOKEN
        if (wait := self.free - self.clock()) > 0:
            self.sleep(wait)
        self.free = max(self.free, self.clock()) + estimate * self.seconds
        response = call(body)
        try:
            told = json.loads(response).get("usage") or {}
            took = float(told.get("prompt_tokens") or 0) + float(told.get("completion_tokens") or 0)
        except (ValueError, AttributeError, TypeError):
            took = 0.0
        if took:
            self.free += (took - estimate) * self.seconds
        return response


def http_call(url: str, key: str | None = None, seconds: float = 300.0) -> Callable[[str], str]:
    """Posts a request's body to a chat service and gives the response's text."""

    def call(body: str) -> str:
        from urllib.request import Request, urlopen

        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with urlopen(Request(url, body.encode(), headers), timeout=seconds) as answer:
            return answer.read().decode()

    return call


class Service:
    """Answers of a model: `call` takes a request's body and gives the response's JSON. At most `tasks` requests run at a time. Off unless given.

    With `tokens_per_minute` each task has its share of them, and so has every try of a request. Requests are
    dealt to tasks by chance and worked off from the largest, so that shares end together. A request that fails for good is an answer without a value and counts no tokens. What every
    document spent is in `spent()`.
    """

    def __init__(self, call: Callable[[str], str], fields=t.HEADER_FIELDS, model: str = t.PRICES[-1][0], tasks: int = 4, tries: int = 4, first: float = 2.0, tokens_per_minute: float | None = None):
        self.plain, self.tries, self.first, self.fields, self.model, self.tasks = call, tries, first, fields, model, tasks
        self.share = None if tokens_per_minute is None else tokens_per_minute / tasks
        self.usages: list[DataFrame] = []

    def __call__(self, kind: str, attempt: int, pending: DataFrame) -> DataFrame:
        from .folders import checkpointed

        plain, tries, first, share, key = self.plain, self.tries, self.first, self.share, pending.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = with_backoff(plain if share is None else functools.partial(Pace(share).call, plain), tries, first)
            for batch in batches:
                responses, errors = [], []
                for body in batch["body"]:
                    try:
                        responses.append(call(body))
                        errors.append(None)
                    except Exception as e:  # one document's failure is not the others'
                        responses.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pd.DataFrame({"doc_id": batch["doc_id"], "chunk_no": batch["chunk_no"], "response": responses, "error": errors}).astype({"chunk_no": "int32"})

        asked = pending.withColumn("chunk_no", F.lit(0)) if kind == "header" else item_chunks(pending)
        bodies = asked.select("doc_id", "chunk_no", requests(asked, kind, self.model).alias("body"))
        dealt = bodies.repartition(self.tasks, F.xxhash64("doc_id", "chunk_no")).sortWithinPartitions(F.desc(F.length("body")), "doc_id", "chunk_no")
        got = checkpointed(dealt.mapInPandas(run, f"doc_id {key}, chunk_no int, response string, error string"))
        self.usages.append(got.select("doc_id", F.lit(kind).alias("kind"), F.lit(attempt).alias("attempt"), "error", usage("response").alias("u")).select("doc_id", "kind", "attempt", "error", "u.*"))
        answers = parsed(got.select("doc_id", "chunk_no", F.get_json_object("response", "$.choices[0].message.content").alias("answer")))
        if kind == "header":
            return header_of(answers, self.fields)
        rows = items_of(answers.select(F.struct("doc_id", "chunk_no").alias("doc_id"), "json")).select("doc_id.doc_id", "doc_id.chunk_no", "pos", "fields")
        return in_order(rows)

    def spent(self) -> DataFrame | None:
        """(doc_id, calls, errors, and token_cost's counts and costs) over all requests so far."""
        if not self.usages:
            return None
        every = reduce(lambda a, b: a.unionByName(b), self.usages)
        sums = every.groupBy("doc_id").agg(F.count("*").alias("calls"), F.array_compact(F.collect_set("error")).alias("errors"), *[F.sum(c).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")])
        cost = v.token_cost(F.lit(self.model), "input_tokens", "cached_tokens", "output_tokens")
        return sums.select("doc_id", "calls", "errors", cost.alias("x")).select("doc_id", "calls", "errors", "x.*")


# --- images instead of texts -------------------------------------------------------


def data_url(image: bytes, kind: str = "png") -> str:
    return f"data:image/{kind};base64,{base64.b64encode(image).decode()}"


def image_request(kind: str, images: list[bytes], model: str, note: str = "") -> str:
    """The body of a chat request that shows a document's pages instead of its text."""
    blocks = [{"type": "text", "text": f"The pages of the document follow as images.{' ' + note if note else ''}"}]
    blocks += [{"type": "image_url", "image_url": {"url": data_url(x)}} for x in images]
    turns = [{"role": "system", "content": system_prompt(kind)}, {"role": "user", "content": blocks}]
    body = {"model": model, "messages": turns}
    return json.dumps(body if re.match(t.REASONING_MODELS, model) else body | {"response_format": {"type": "json_object"}})


def compared(left: DataFrame, right: DataFrame, fields) -> DataFrame:
    """(doc_id, field, left, right, same): two readings of the same headers field by field; documents of one side only are kept."""
    pairs = left.select("doc_id", *[F.col(c).alias(f"l_{c}") for c in fields]).join(right.select("doc_id", *[F.col(c).alias(f"r_{c}") for c in fields]), "doc_id", "full")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"l_{c}").cast("string").alias("left"), F.col(f"r_{c}").cast("string").alias("right"), F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")).alias("same")) for c in fields])
    return pairs.select("doc_id", F.explode(cells).alias("x")).select("doc_id", "x.*")
