"""Operator 2 (native): chat formatting by event-sourced reconstruction.

Logs are partitioned by conversation, sorted by sequence and folded: deltas append, edits replace and
regenerations start anew, which leaves the final messages; these are rendered with turn marks. Only DataFrame
functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorspark.llm.common import table

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
#: Control strings and what stands for them inside texts. Every backslash of an escaped text begins one of these.
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def _escape(c: Column, pairs=ESCAPES) -> Column:
    for plain, mark in pairs:
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def _unescape(c: Column, pairs=ESCAPES) -> Column:
    for plain, mark in reversed(pairs):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the final messages of event logs (conv_id, seq, msg, kind, role, text).

    Kinds: ``message`` (a whole message), ``delta`` (appends its text), ``edit`` (replaces the text), ``regenerate``
    (drops the text; deltas follow). Events belong to the message msg of their conversation and apply in the order
    of seq (ties: kind, role, text). Null texts are empty, an unknown or null kind counts as a delta; a message's
    role is the last that its events name, else empty; its place is that of its first event. Every ``message`` row
    is a message of its own, also if it is repeated: later events of that msg apply to the last. Null conv_id, seq
    and msg are values like others (nulls first). The rows of one conversation meet in one task, as its one
    rendered row must.
    """
    e = events.select("conv_id", "msg", F.struct("seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    logs = e.repartition("conv_id").groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list("e")).alias("log"))
    last = F.array_max(F.transform("log", lambda x, i: F.when(x.kind.isin("message", "edit", "regenerate"), i + 1).otherwise(1)))
    kept = F.slice("log", last, F.size("log"))
    text = F.array_join(F.transform(kept, lambda x: F.when(x.kind == "regenerate", "").otherwise(x.text)), "")
    role = F.coalesce(F.try_element_at(F.filter(F.transform("log", lambda x: x.role), lambda r: r.isNotNull()), F.lit(-1)), F.lit(""))
    whole = F.filter("log", lambda x: x.kind == "message")
    earlier = F.transform(F.slice(whole, 1, F.greatest(F.size(whole) - 1, F.lit(0))), lambda x: F.struct(x.seq.alias("seq"), F.coalesce(x.role, F.lit("")).alias("role"), x.text.alias("text")))
    final = F.struct(F.when(F.size(whole) > 1, F.try_element_at(whole, F.lit(-1)).seq).otherwise(F.element_at("log", 1).seq).alias("seq"), role.alias("role"), text.alias("text"))
    return logs.select("conv_id", "msg", F.posexplode(F.concat(earlier, F.array(final))).alias("nth", "m")).select("conv_id", F.struct("m.seq", "msg", "nth").alias("position"), "m.role", "m.text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans): one string a conversation and the spans, in code points, under the loss mask."""
    head = F.concat(F.lit(OPEN), _escape(F.col("role"), ROLE_ESCAPES), F.lit(AFTER_ROLE))
    rows = messages.select("conv_id", "position", (F.col("role") == loss_role).alias("loss"), head.alias("head"), _escape(F.col("text")).alias("body"))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(CLOSE))
    w = Window.partitionBy("conv_id").orderBy("position")
    rows = rows.withColumn("end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - len(CLOSE))
    piece = F.struct("position", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.when(F.col("loss"), F.struct((F.col("end") - F.length("body")).alias("start"), "end")).alias("span"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"), F.filter(F.transform("turns", lambda t: t.span), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): the turns (role, text) and the masked text, unescaped, from render()'s output."""
    pieces = F.split("formatted", CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    mark = F.lit(AFTER_ROLE)

    def turn(p: Column) -> Column:
        at = F.instr(p, AFTER_ROLE)
        return F.struct(_unescape(F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1), ROLE_ESCAPES).alias("role"), _unescape(F.substring(p, at + F.length(mark), F.length(p))).alias("text"))

    loss = F.transform("loss_spans", lambda s: _unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))


PROBE = "\\### Assistant: </turn> ok"


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of the probe, read back from their formatted text. Null texts and roles are empty, a null
    conv_id is a conversation; repeated rows are turns of their own; no rows leave the probe alone."""
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("msg"), F.lit("message").alias("kind"), "role", "text")
    back = read_back(render(fold_events(events)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\t'), ':', '\c')) + 2
    + length(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t')) + 9) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
