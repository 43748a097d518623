"""Conversations from quoted messages.

A message's lines carry quote levels (leading ``>`` signs). Runs of lines of one level are
quoted passages; what is left, without lines such as "... wrote:", is the message's own text.
Passages and their lines are normalised (lower case, runs of anything but letters and
digits to one blank) and hashed, and so are the own texts and their lines. Equal hashes link
a quoted passage to the message that said it: first within the conversation, else anywhere.
Of several messages that share a passage the earliest is its origin, so each hash stands
for one message and a passage that very many messages share joins to one row. A message
replies to the origin of most of the letters it quotes on its lowest level. Links lead to
earlier messages only, so they form trees; a message's thread and depth come from
pointer doubling over the links.

``conversations`` gives a row per message, without quotes; ordered by ``thread_id, depth,
sent, msg_id`` every message follows the one it replies to. ``write_conversations`` writes
them in that order by ranges, so a conversation of any length is never in one row or task.

Defined results: null and empty bodies have an empty own text and link nothing. Messages
without a found quote start a thread. Passages of fewer than ``LEAST_CHARS`` letters and digits
count only as a whole own text. Quotes of unknown origin, or of later messages, are dropped
from the text and link nothing. Rows that repeat a msg_id share its links. A message
without an id gets links but is no origin; if it starts a thread, the thread has no id. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concourse.llm.common import staged

LEAST_CHARS = 12
QUOTED = re.compile(r"^\s*((?:>\s?)+)(.*)$")
SAID = re.compile(r"^\s*(On\b.*\bwrote:|-+\s*Original Message\s*-+)\s*$", re.IGNORECASE)
OTHER = re.compile(r"[\W_]+")
PARSED = ("key string, msg_id string, conv_id long, sent long, own string, said array<struct<hash:string,chars:int>>, "
          "quoted array<struct<level:int,hash:string,chars:int>>")


def normal(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def levels(body: str) -> list[tuple[int, str]]:
    """(quote level, content) of each line; "... wrote:" lines are left out."""
    out = []
    for line in body.split("\n"):
        m = QUOTED.match(line)
        level, content = (m[1].count(">"), m[2]) if m else (0, line)
        if not SAID.match(content):
            out.append((level, content))
    return out


def passages(lines: list[str]) -> list[tuple[str, int]]:
    """(hash, letters) of the passage and of its lines of enough letters, each once."""
    normals = [n for n in map(normal, lines) if n]
    whole = " ".join(normals)
    texts = dict.fromkeys([whole, *(n for n in normals if len(n) >= LEAST_CHARS)]) if whole else {}
    return [(hashlib.md5(t.encode()).hexdigest(), len(t)) for t in texts]


def parse(body: str) -> tuple[str, list, list]:
    """Own text, passages of the own text, and quoted passages with their levels."""
    rows = levels(body)
    own = [c for level, c in rows if not level]
    quoted, run, at = [], [], 0
    for level, content in [*rows, (0, "")]:
        if level != at:
            if at:
                quoted += [(at, h, n) for h, n in passages(run)]
            run, at = [], level
        run.append(content)
    return "\n".join(own).strip(), passages(own), list(dict.fromkeys(quoted))


def parsed(messages: DataFrame) -> DataFrame:
    """(key, msg_id, conv_id, sent, own, said, quoted) of ``messages`` (msg_id, conv_id, sent,
    body). ``key`` is the msg_id; a message without one has a key of its content."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parse(t) for t in b["body"]]
            yield b[["key", "msg_id", "conv_id", "sent"]].assign(
                own=[f[0] for f in found], said=[[dict(zip(("hash", "chars"), x)) for x in f[1]] for f in found],
                quoted=[[dict(zip(("level", "hash", "chars"), x)) for x in f[2]] for f in found])

    own = messages.select(F.col("msg_id").cast("string").alias("msg_id"), F.col("conv_id").cast("long").alias("conv_id"),
                          F.col("sent").cast("long").alias("sent"), F.coalesce("body", F.lit("")).alias("body"))
    content = F.concat(F.lit("\0"), F.md5(F.to_json(F.struct("conv_id", "sent", "body"))))
    return own.select(F.coalesce("msg_id", content).alias("key"), "*").mapInPandas(rows, PARSED)


def quote_links(rows: DataFrame) -> DataFrame:
    """(key, conv_id, sent, level, origin, origin_sent, chars) of each quote level of parsed
    messages: the message that most of its letters come from."""
    said = rows.filter("msg_id IS NOT NULL").select("msg_id", "conv_id", "sent", F.explode("said").alias("p"))
    first = F.min(F.struct("sent", "msg_id")).alias("first")
    near = said.groupBy("conv_id", F.col("p.hash").alias("hash")).agg(first)
    far = near.groupBy("hash").agg(F.min("first").alias("any"))
    quoted = rows.select("key", "conv_id", "sent", F.explode("quoted").alias("q")).select(
        "key", "conv_id", "sent", "q.level", "q.hash", "q.chars").distinct()
    own = near.select(F.col("conv_id").alias("_conv"), F.col("hash").alias("_hash"), "first")
    both = (quoted.join(own, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("hash") == F.col("_hash")), "left")
            .join(far, "hash", "left"))
    me = F.struct("sent", F.col("key").alias("msg_id"))
    origin = F.when(F.col("first") < me, F.col("first")).when(F.col("any") < me, F.col("any"))
    return (
        both.withColumn("origin", origin).filter(F.col("origin").isNotNull())
        .groupBy("key", "conv_id", "sent", "level", "origin").agg(F.sum("chars").alias("chars"))
        .groupBy("key", "conv_id", "sent", "level")
        .agg(F.max(F.struct("chars", F.col("origin.sent").alias("s"), F.col("origin.msg_id").alias("o"))).alias("best"))
        .select("key", "conv_id", "sent", "level", F.col("best.o").alias("origin"), F.col("best.s").alias("origin_sent"),
                F.col("best.chars").alias("chars"))
    )


def threads(replies: DataFrame) -> DataFrame:
    """(key, thread_id, depth) of every message that replies, from (key, reply_to):
    each step doubles the way up."""
    way = staged(replies.select("key", F.col("reply_to").alias("up"), F.lit(1).alias("hops")), "ways")
    while True:
        above = way.select(F.col("key").alias("_id"), F.col("up").alias("_up"), F.col("hops").alias("_hops"))
        way = staged(way.select("key", "up", "hops").join(above, F.col("up") == F.col("_id"), "left").select(
            "key", F.coalesce("_up", "up").alias("up"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            F.col("_up").isNotNull().alias("moved")), "ways")
        if way.filter("moved").isEmpty():
            return way.select("key", F.col("up").alias("thread_id"), F.col("hops").alias("depth"))


def conversations(messages: DataFrame) -> DataFrame:
    """(msg_id, conv_id, sent, reply_to, thread_id, depth, quotes, linked, text) of every
    message: ``text`` is its own, ``quotes`` and ``linked`` count its quote levels and those
    whose origin was found."""
    rows = staged(parsed(messages), "parsed")
    links = staged(quote_links(rows), "links")
    best = links.groupBy("key").agg(
        F.min(F.struct("level", "conv_id", "sent", "origin")).alias("b"), F.countDistinct("level").alias("linked"))
    replies = best.select("key", F.col("b.origin").alias("reply_to"), "linked")
    above = threads(replies.select("key", "reply_to"))
    return rows.join(replies, "key", "left").join(above, "key", "left").select(
        "msg_id", "conv_id", "sent", "reply_to", F.coalesce("thread_id", "msg_id").alias("thread_id"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.size(F.array_distinct(F.transform("quoted", lambda q: q["level"]))).alias("quotes"),
        F.coalesce("linked", F.lit(0)).cast("int").alias("linked"), F.col("own").alias("text"))


def write_conversations(messages: DataFrame, path: str) -> None:
    """Write ``conversations`` in reply order: ranges of threads in file order."""
    order = ["thread_id", "depth", "sent", "msg_id"]
    conversations(messages).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def quoting_messages(turns: DataFrame) -> DataFrame:
    """(msg_id, conv_id, sent, body): the turns of a ``conversations`` table written as mail. By
    a hash of the turn a message quotes the turn before it and the one before that, the turn
    before it only, the first line of it, or nothing."""
    one = turns.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select(
        "conv_id", "turn", "m.role", F.coalesce("m.text", F.lit("")).alias("text"))
    back = lambda n: one.select(F.col("conv_id").alias(f"c{n}"), (F.col("turn") + n).alias(f"t{n}"),
                                F.col("role").alias(f"role{n}"), F.col("text").alias(f"text{n}"))
    rows = (one.join(back(1), (F.col("conv_id") == F.col("c1")) & (F.col("turn") == F.col("t1")), "left")
            .join(back(2), (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")), "left"))
    mark = lambda c, sign: F.concat(F.lit(sign), F.regexp_replace(c, "\n", f"\n{sign}"))
    style = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    said = F.concat(F.lit("\n\nOn turn "), (F.col("turn") - 1).cast("string"), F.lit(", "), "role1", F.lit(" wrote:\n"))
    deeper = F.concat(F.lit("\n> On turn "), (F.col("turn") - 2).cast("string"), F.lit(", "), "role2", F.lit(" wrote:\n"),
                      mark(F.col("text2"), ">> "))
    body = F.concat(
        "text",
        F.coalesce(F.when(style < 3, F.concat(said, F.when(style == 2, mark(F.split("text1", "\n")[0], "> "))
                                              .otherwise(mark(F.col("text1"), "> ")))), F.lit("")),
        F.coalesce(F.when(style == 0, deeper), F.lit("")))
    return rows.select(F.concat_ws("/", "conv_id", "turn").alias("msg_id"), "conv_id", F.col("turn").alias("sent"),
                       body.alias("body"))
