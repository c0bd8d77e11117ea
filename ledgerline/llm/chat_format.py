"""Chat formatting: reply trees become one training text a chosen root-to-leaf path.

Messages are rows (tree, id, parent, role, text, score). Paths are found by
iterative self-joins with pointer doubling: after round k every message knows
its ancestor 2^k steps up, with the number and the summed score of the messages
it has passed, so a reply chain of a thousand messages takes ten joins of ids
and no text moves. Leaves then know the length and the mean score of their
paths; the best of each tree are chosen (`keep`), and only their ancestors are
enumerated, each once, by going down through the powers of two. Texts join the
chosen paths, are sorted by path and position, and are streamed into formatted
conversations: memory is bounded by `PART_CHARS` and the longest single text,
never by the length of a conversation, which continues in further parts.

The template: `### role: text </turn>` and a newline for each turn. Inside roles
and texts a backslash is doubled and one is put into every `##` and `</`, so
neither the header nor the end mark can occur in a text, even as plain
substrings; dropping the backslashes gives the text back exactly. A colon in a
role is escaped as well.

Odd rows: a null role or text is empty; a null tree is a tree of its own, a null
id is a message that none can answer. A message whose parent is null or absent
is a root. Of rows that repeat an id of a tree the one with the largest score
stays (then smallest parent, role, text). Messages on a cycle, and those below
one, have no root and are in no path. Null scores count as 0. Of paths with
equal scores the longer goes first, then the one with the smaller leaf.
Conversations without a tree are chains: rows by turn (null first), ties by role
and text, repeated rows repeat their turns. An empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A formatted conversation continues in a further part once a part has so many characters.
PART_CHARS = 1 << 20
#: Characters of text in an Arrow batch that is handed on.
BATCH_CHARS = 1 << 22
#: Role whose texts are under the loss mask.
LEARNED = "assistant"

HEAD, COLON, END = "### ", ": ", " </turn>\n"
_HEADER = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)

_FORMATTED = "tree long, leaf long, rank int, score double, part int, text string, loss array<struct<from:int,to:int>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("##", "#\\#").replace("</", "<\\/")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def read_turns(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of every turn of a formatted part."""
    out, at = [], 0
    while at < len(text):
        head = _HEADER.match(text, at)
        if head is None:
            raise ValueError(f"no turn begins at character {at}")
        to = text.index(END, head.end())
        out.append((unescape(head[1]), unescape(text[head.end() : to]), head.end(), to))
        at = to + len(END)
    return out


def chain(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and their links, of conversations given as rows by turn: each turn answers the one before."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    # A chain's links are the same whatever order ties have, so they are numbered without the texts.
    number = F.row_number().over(Window.partitionBy("tree").orderBy("turn")).cast("long")
    links = rows.select("tree", number.alias("id"))
    links = links.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"))
    return rows.select("tree", place.alias("id"), "role", "text"), links


def messages(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and their links, of a table with columns tree, id, parent, role, text and score; one row for each id."""
    rows = table.select(
        F.col("tree").cast("long").alias("tree"),
        F.col("id").cast("long").alias("id"),
        F.col("parent").cast("long").alias("parent"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    first = F.row_number().over(Window.partitionBy("tree", "id").orderBy(F.desc("score"), "parent", "role", "text"))
    rows = rows.withColumn("first", first).filter("first = 1")
    return rows.select("tree", "id", "role", "text"), rows.select("tree", "id", "parent", "score")


def _jumps(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """For each k the messages with their ancestors 2^k up, and all rooted messages with the length and mean score of their path."""
    known = links.select(F.col("tree").alias("t"), F.col("id").alias("up"))
    start = links.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("up")), "left")
    state = common.checkpointed(start.select("tree", "id", F.col("up").alias("jump"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")))
    rows, rounds = state.count(), []
    while not state.filter("jump is not null").isEmpty():
        rounds.append(state.filter("jump is not null").select(F.col("tree").alias("t"), F.col("id").alias("at"), "jump"))
        if 1 << len(rounds) > 2 * rows:  # a path holds each message once: what still has an ancestor is on or below a cycle
            break
        above = state.select(F.col("tree").alias("t"), F.col("id").alias("at"), F.col("jump").alias("next"), F.col("steps").alias("more"), F.col("total").alias("sum"))
        met = state.filter("jump is not null").join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("jump") == F.col("at")))
        moved = met.select("tree", "id", F.col("next").alias("jump"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("sum")).alias("total"))
        state = common.checkpointed(moved.unionByName(state.filter("jump is null")))
    return rounds, state.filter("jump is null").select("tree", "id", "steps", (F.col("total") / F.col("steps")).alias("score"))


def paths(links: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, node, pos): the messages of the `keep` best root-to-leaf paths of each tree, of all paths if None (rank is null then)."""
    rounds, rooted = _jumps(links)
    answered = links.filter("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p"))
    leaves = rooted.join(answered, F.col("tree").eqNullSafe(F.col("t")) & F.col("id").eqNullSafe(F.col("p")), "left_anti")
    if keep is None:
        leaves = leaves.withColumn("rank", F.lit(None).cast("int"))
    else:
        best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("steps"), "id")
        leaves = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
    out = leaves.select("tree", F.col("id").alias("leaf"), "rank", "score", F.col("id").alias("node"), F.col("steps").alias("pos"))
    for k in reversed(range(len(rounds))):
        met = out.join(rounds[k], F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("at")), "left")
        both = F.array(F.struct("node", "pos"), F.when(F.col("jump").isNotNull(), F.struct(F.col("jump").alias("node"), (F.col("pos") - (1 << k)).alias("pos"))))
        out = met.select("tree", "leaf", "rank", "score", F.explode(F.array_compact(both)).alias("x")).select("tree", "leaf", "rank", "score", "x.node", "x.pos")
    return out


def _writer(part_chars: int):
    """Sorted turns as parts of formatted conversations, parts of at least so many characters but the last."""

    def run(batches):
        names = [x.split()[0] for x in _FORMATTED.split(", ")[:6]] + ["loss"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.string(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))]
        rows: list[tuple] = []
        held = 0
        now: tuple | None = None
        part = length = 0
        pieces: list[str] = []
        loss: list[dict] = []

        def close():
            nonlocal held, part, length, pieces, loss
            rows.append((*now, part, "".join(pieces), loss))
            held += length
            part, length, pieces, loss = part + 1, 0, [], []

        def flush():
            nonlocal rows, held
            columns = list(zip(*rows, strict=True))
            rows, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for *key, role, text, learned in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6, 7)), strict=True):
                if now is None or key[:2] != list(now[:2]):
                    if now is not None and pieces:
                        close()
                    now, part = tuple(key), 0
                head, body = f"{HEAD}{escape_role(role)}{COLON}", escape(text)
                if learned and role == LEARNED:
                    loss.append({"from": length + len(head), "to": length + len(head) + len(body)})
                pieces += (head, body, END)
                length += len(head) + len(body) + len(END)
                if length >= part_chars:
                    close()
                if held >= BATCH_CHARS:
                    yield flush()
        if now is not None and pieces:
            close()
        if rows:
            yield flush()

    return run


def formatted(texts: DataFrame, links: DataFrame, keep: int | None = None, once: bool = True) -> DataFrame:
    """Conversations as texts with loss spans: (tree, leaf, rank, score, part, text, loss).

    Spans are code points of `text`, from and to. With `once` a text that several chosen paths
    share is under the loss of the best of them only. Rows of a conversation are in one partition, in order.
    """
    chosen = paths(links, keep)
    if once:
        chosen = common.checkpointed(chosen)
        owners = chosen.groupBy(F.col("tree").alias("t"), F.col("node").alias("n")).agg(F.min(F.struct("rank", F.negative("score"), "leaf"))["leaf"].alias("owner"))
        chosen = chosen.join(owners, F.col("tree").eqNullSafe(F.col("t")) & F.col("node").eqNullSafe(F.col("n"))).withColumn("learned", F.col("leaf").eqNullSafe(F.col("owner"))).drop("t", "n", "owner")
    else:
        chosen = chosen.withColumn("learned", F.lit(True))
    said = texts.select(F.col("tree").alias("t"), F.col("id").alias("i"), "role", "text")
    turns = chosen.join(said, F.col("tree").eqNullSafe(F.col("t")) & F.col("node").eqNullSafe(F.col("i"))).select("tree", "leaf", "rank", "score", "pos", "role", "text", "learned")
    return turns.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "pos").mapInArrow(_writer(PART_CHARS), _FORMATTED)


def _reader(batches):
    """Digests of what formatted parts say; parts of a conversation follow each other."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, state, rows = None, None, []

    def close():
        turns, said, chars, learned, total = state
        rows.append((now[0], turns, said.hexdigest(), chars, learned.hexdigest(), total))

    for batch in batches:
        for tree, leaf, text, loss in zip(*(batch.column(i).to_pylist() for i in (0, 1, 5, 6)), strict=True):
            if now != (tree, leaf):
                if now is not None:
                    close()
                now, state = (tree, leaf), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said, _, _ in read_turns(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for span in loss:
                learned = unescape(text[span["from"] : span["to"]])
                state[2] += len(learned)
                state[3].update(learned.encode())
            state[4] += len(text)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    if now is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def digests(out: DataFrame) -> DataFrame:
    """Per conversation what is read back from the output of `formatted`: turns, loss and length."""
    return out.mapInArrow(_reader, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation of the query that holds the template's own control strings.
PLANTED = r"\### Assistant: </turn> ok"


def with_planted(conversations: DataFrame) -> DataFrame:
    own = conversations.select("conv_id", "turn", "role", "text")
    rows = own.sparkSession.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return own.unionByName(rows)


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(text) + (length(text) - length(replace(text, chr(92), '')))
         + (length(text) - length(replace(text, '#', ''))) - (length(regexp_replace(text, '#+', '#', 'g')) - length(replace(text, '#', '')))
         + (length(text) - length(replace(text, '</', ''))) // 2
         + length(role) + (length(role) - length(replace(role, chr(92), ''))) + (length(role) - length(replace(role, ':', '')))
         + (length(role) - length(replace(role, '#', ''))) - (length(regexp_replace(role, '#+', '#', 'g')) - length(replace(role, '#', '')))
         + (length(role) - length(replace(role, '</', ''))) // 2 + 15 AS chars
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
