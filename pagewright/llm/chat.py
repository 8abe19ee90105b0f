"""Chat formatting of reply trees, in DataFrame operations only.

A conversation is a tree of messages, each with the id of the message that it replies to. Self-joins that double their
reach list the ancestors of every leaf; the paths that reach a root are ranked within their tree by score, and each chosen
one is formatted as one conversation, with the spans on which a model is to be trained.

A turn is `<|im_start|>` role newline text `<|im_end|>` newline. Control strings inside texts and roles get a guard mark
after their first character (one more if they have some), so no text can end or start a turn, and taking one mark off
each gives the text back. In roles, backslashes and newlines are written with a backslash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import stored

START = "<|im_start|>"
END = "<|im_end|>\n"
GUARD = "~"
#: What follows the first character of a control string.
CONTROL = r"\|im_start\|>|\|im_end\|>|/?s>|/?INST\]"
TRAINED = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])({GUARD}*(?:{CONTROL}))", rf"$1{GUARD}$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]){GUARD}({GUARD}*(?:{CONTROL}))", "$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), F.lit(r"\\\\"), F.lit(-1))  # at doubled backslashes, so that a newline's backslash is its own
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, message_id, depth) of each message on each path from a root to a leaf; depth counts up from the leaf.

    messages: (conv_id, message_id, parent_id), with message_id unique in its tree. A message whose parent is null or isn't there is a
    root. Messages of a cycle, or that lead into one, are on no path from a root and give none.
    """
    nodes = messages.select("conv_id", F.col("message_id").alias("node"), F.col("parent_id").alias("up"))
    known = nodes.select("conv_id", F.col("node").alias("up"))
    jump = stored(nodes.join(known, ["conv_id", "up"]).select("conv_id", "node", "up"))
    found = nodes.join(jump.select("conv_id", F.col("up").alias("node")).distinct(), ["conv_id", "node"], "left_anti")
    found = stored(found.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth")))
    largest = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < 2 * largest:
        step = jump.select("conv_id", "node", "up")
        more = found.join(step, ["conv_id", "node"]).select("conv_id", "leaf", F.col("up").alias("node"), (F.col("depth") + reach).alias("depth"))
        more = stored(more)
        if more.isEmpty():
            break
        found = stored(found.unionByName(more))
        far = jump.select("conv_id", F.col("node").alias("up"), F.col("up").alias("far"))
        jump = stored(jump.join(far, ["conv_id", "up"]).select("conv_id", "node", F.col("far").alias("up")))
        reach *= 2
    linked = nodes.join(known, ["conv_id", "up"]).select("conv_id", "node")
    ended = found.join(linked, ["conv_id", "node"], "left_anti").select("conv_id", "leaf").distinct()
    return found.join(ended, ["conv_id", "leaf"]).select("conv_id", "leaf", F.col("node").alias("message_id"), "depth")


def best_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """paths() of the `branches` best leaves of each tree (None: all), with `rank` from 1.

    A path's score is the mean of its messages' score (null: 0), ties go to the smaller leaf.
    """
    every = paths(messages).join(messages.select("conv_id", "message_id", F.coalesce(F.col("score"), F.lit(0.0)).alias("score")), ["conv_id", "message_id"])
    leaves = every.groupBy("conv_id", "leaf").agg(F.avg("score").alias("path_score"))
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("path_score"), "leaf")))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    return every.drop("score").join(ranked, ["conv_id", "leaf"])


def formatted(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, formatted, spans) of each chosen path; spans: (start, length) of trained texts in formatted, code points from 0."""
    turns = chosen.select("conv_id", "leaf", "message_id", "depth").join(messages.select("conv_id", "message_id", "role", "text"), ["conv_id", "message_id"])
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    body = escape(text)
    turn = F.struct((-F.col("depth")).alias("at"), head.alias("head"), body.alias("body"), role.isin(*TRAINED).alias("trained"))
    found = turns.groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    state = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(s: Column, t: Column) -> Column:
        start, length = s["at"] + F.char_length(t["head"]), F.char_length(t["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct((start + length + len(END)).alias("at"), F.when(t["trained"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return found.select("conv_id", "leaf", whole.alias("formatted"), F.aggregate("turns", state, step, lambda s: s["spans"]).alias("spans"))


def parsed(formatted_text: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    parts = F.filter(F.split(formatted_text, F.lit(r"(?<=<\|im_end\|>\n)(?=<\|im_start\|>|$)")), lambda p: p != "")

    def turn(p: Column) -> Column:
        own = F.substring(p, F.lit(1 + len(START)), F.char_length(p) - len(START) - len(END))
        at = F.locate("\n", own)
        return F.struct(unescape_role(F.substring(own, F.lit(1), at - 1)).alias("role"), unescape(F.substring(own, at + 1, F.char_length(own))).alias("text"))

    return F.transform(parts, turn)


def trained_text(formatted_text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted_text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Messages of conversations (conv_id, turn, role, text): each row replies to the one before it by turn (null first, ties by role, text)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("message_id", F.row_number().over(order))
    return rows.select("conv_id", "message_id", F.nullif(F.col("message_id") - 1, F.lit(0)).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, read back from its formatted text.

    Null texts and roles count as empty. Rows that repeat are turns of their own. Rows whose conv_id is null form no
    conversation and give none; an empty table gives no rows.
    """
    messages = stored(linear_messages(conversations.where("conv_id IS NOT NULL")))
    found = formatted(best_paths(messages), messages)
    turns = parsed(F.col("formatted"))
    found = found.withColumn("turns", turns).withColumn("loss", trained_text(F.col("formatted"), F.col("spans")))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def with_example(conversations: DataFrame) -> DataFrame:
    """conversations plus conversation -7, whose texts hold the control strings of a common template."""
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    more = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)


ORACLE = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
    regexp_replace(text, '([<\[])({GUARD}*(?:{CONTROL}))', '\1{GUARD}\2', 'g') AS body,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])({GUARD}*(?:{CONTROL}))', '\1{GUARD}\2', 'g') AS head
  FROM rows
), found AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth) AS turns,
    coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(head) + length(body) + {len(START) + 1 + len(END)}) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM found
"""
