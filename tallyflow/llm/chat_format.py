"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log of events (conv_id, seq, turn, kind, role, text) is folded into final messages and rendered.

* ``message`` opens a message at its turn with its text;
* ``delta`` appends its text to the turn's newest message (and opens one where there is none);
* ``edit`` replaces what that message has said so far;
* ``regenerate`` does the same and discards what later turns had said before it; deltas then refill the message.

Each turn is rendered as ``<|turn|>role\\n text <|end|>\\n``. In texts and roles ``&``, ``<`` and ``[`` are written
as character references, and in roles line ends too, so no control string of this or of another common template can occur inside a text, and
undoing the references gives the exact text back. ``loss`` lists the spans of assistant texts in the rendered string.

Defined cases: a null text is empty and a null role is the empty role; events of one turn that tie in seq are ordered
by kind, role and text; repeated ``message`` events are messages of their own; a null turn sorts first; a null conv_id
is a conversation of its own; an empty log gives an empty result; further columns are ignored, whatever their names;
texts are whole, however long, but for Spark's bound of 2 GB on a conversation's rendered string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import table

TURN, END = "<|turn|>", "<|end|>"
#: Replaced in this order, and undone in the reverse order.
REFERENCES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
#: A role ends at the first line end.
ROLE_REFERENCES = (*REFERENCES, ("\n", "&#10;"))


def escape(c: Column, references: tuple = REFERENCES) -> Column:
    for raw, ref in references:
        c = F.replace(c, F.lit(raw), F.lit(ref))
    return c


def unescape(c: Column, references: tuple = REFERENCES) -> Column:
    for raw, ref in reversed(references):
        c = F.replace(c, F.lit(ref), F.lit(raw))
    return c


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, nth, role, text): what each turn finally says."""
    kind = F.coalesce("kind", F.lit("message"))
    e = events.select("conv_id", "turn", "seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("_t", F.coalesce(F.col("turn").cast("bigint"), F.lit(-(2**62))))
    earlier = Window.partitionBy("conv_id").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    again = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier)
    e = e.withColumn("_again", again).where("_again IS NULL OR seq > _again")
    rank = F.expr("array_position(array('message', 'regenerate', 'edit', 'delta'), kind)")
    order = [F.col("seq"), rank, F.col("role"), F.col("text")]
    so_far = Window.partitionBy("conv_id", "turn").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.greatest(F.sum((F.col("kind") == "message").cast("int")).over(so_far), F.lit(1))
    e = e.withColumn("nth", opened).withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(*order)))
    # What was said before the message's last edit or regeneration doesn't count.
    said = F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("at"))
    last = F.max(said).over(Window.partitionBy("conv_id", "turn", "nth"))
    e = e.withColumn("last", last).where("last IS NULL OR at >= last")
    parts = F.sort_array(F.collect_list(F.struct("at", "text", "role")))
    folded = e.groupBy("conv_id", "turn", "nth").agg(parts.alias("parts"))
    return folded.select("conv_id", "turn", "nth", F.col("parts")[0]["role"].alias("role"), F.array_join(F.col("parts.text"), "").alias("text"))


def render(said: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): loss is an array of (start, length) in code points, from 0."""
    head = F.concat(F.lit(TURN), escape(F.col("role"), ROLE_REFERENCES), F.lit("\n"))
    turns = said.select("conv_id", "turn", "nth", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("mine"))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + len(END) + 1)
    before = Window.partitionBy("conv_id").orderBy("turn", "nth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("mine"), F.struct(F.col("start").alias("start"), F.length("body").alias("length")))
    text = F.concat("head", "body", F.lit(END + "\n"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", text.alias("text")))).alias("rows"), F.sort_array(F.collect_list(span)).alias("loss"))
    return rows.select("conv_id", F.array_join(F.col("rows.text"), "").alias("formatted"), "loss")


def format_log(events: DataFrame) -> DataFrame:
    return render(messages(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): turns is an array of (role, text), both read from the rendered string alone."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda b: b != "")
    body = lambda b: F.substr(b, F.lit(len(TURN) + 1))
    role = lambda b: F.substring_index(body(b), "\n", 1)
    turns = F.transform(blocks, lambda b: F.struct(unescape(role(b), ROLE_REFERENCES).alias("role"), unescape(F.substr(body(b), F.length(role(b)) + 2)).alias("text")))
    masked = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"].cast("int") + 1, s["length"])))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), F.length("formatted").alias("formatted_chars"))


def events_of(conversations: DataFrame) -> DataFrame:
    """Conversation rows as a log: each row is a complete message."""
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("turn").cast("bigint").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def op5_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_log(events_of(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS et,
             replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS er FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(er) + length(et) + 17)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
