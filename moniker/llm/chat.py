"""Chat formatting by event-sourced reconstruction.

An event log has a conversation, a sequence number, the message (its turn) an event is about, a role, a kind and a text:

* "message" or "delta": the text is appended to the message; the first event of a message makes it;
* "edit": the text replaces all that the message had; later deltas are appended to it;
* "regenerate": the message begins again with this text, and all messages of later turns that were made before are gone.

The log is partitioned by conversation and sorted by sequence number; the fold is made of windows: a message has the
deltas from its last edit or regeneration on, unless an earlier turn was regenerated after them. A conversation of any
length is folded without holding it in one row before its messages are complete. The role is that of the message's last
event that names one. Messages are rendered in order of turns.

Defined results: events without conversation or turn are dropped (nothing says where they belong); a null sequence number
counts as the earliest; events with equal numbers are ordered by kind, role and text; a fully repeated event counts once;
null kinds are "message", null texts empty, null roles `unknown`. A message whose content is empty or white space is not
rendered; a conversation in which no message is left has no row. An empty log gives an empty result. Other columns of the
input don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BEGIN, END = "<|im_start|>", "<|im_end|>"


def log_of_turns(conversations: DataFrame) -> DataFrame:
    """A log of how the turns of a table conv_id, turn, role, text may have come about.

    Each line of a turn is a delta, the first one after an edit that begins the message anew. By hash of conversation and turn a third of the messages begin with
    a draft that this edit replaces, and a third are regenerated after a wrong next turn had been made, which goes by that. Sequence
    numbers are (turn, role, hash of the text, number in the turn): of several rows of one turn the last in this order stays. The turns are partitioned by
    conversation before events are made of them, which is less to move, so the log is partitioned already.
    """
    c = C.pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id is not null and turn is not null").repartition("conv_id")
    c = c.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    event = lambda turn, kind, text: F.struct(turn.alias("turn"), F.lit(kind).alias("kind"), text.alias("text"))
    lines, turn, way = F.split("text", "\n", -1), F.col("turn"), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    begin = F.when(way == 0, F.array(event(turn, "message", F.lit("draft of ")), event(turn, "delta", F.col("role")), event(turn, "edit", F.lit(""))))
    begin = begin.when(way == 1, F.array(event(turn, "edit", F.lit(""))))
    begin = begin.otherwise(F.array(event(turn, "delta", F.lit("wrong")), event(turn + 1, "message", F.lit("wrong, too")), event(turn, "regenerate", F.lit(""))))
    deltas = F.transform(lines, lambda x, i: event(turn, "delta", F.when(i > 0, F.concat(F.lit("\n"), x)).otherwise(x)))
    e = c.select("conv_id", turn.alias("made"), "role", F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("of"), F.posexplode(F.concat(begin, deltas)).alias("i", "e"))
    return e.select("conv_id", F.struct("made", "role", "of", "i").alias("seq"), "e.turn", "role", "e.kind", "e.text")


def messages(events: DataFrame, *, partitioned: bool = False) -> DataFrame:
    """conv_id, turn, role, content of the final messages of a log conv_id, seq, turn, role, kind, text. seq may be of any type that can be ordered."""
    e = C.pick(events, conv_id="conv_id", seq="seq", turn="turn", role="role", kind="kind", text="text").where("conv_id is not null and turn is not null")
    # one shuffle serves all that follows: the distinct rows, both windows and the messages; a log that is partitioned by conversation needs none
    e = (e if partitioned else e.repartition("conv_id")).distinct()
    e = e.select("conv_id", "seq", "turn", "role", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    # equal sequence numbers: rank decides, within a conversation
    order = F.struct("seq", "kind", F.coalesce("role", F.lit("")), "text")
    e = e.withColumn("at", order)
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "turn")
    e = e.withColumn("gone", F.max(F.when(F.col("kind") == "regenerate", F.col("at"))).over(earlier))
    e = e.where("gone is null or at > gone")
    e = e.withColumn("reset", F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("at"))).over(own))
    e = e.where("reset is null or at >= reset")
    m = e.groupBy("conv_id", "turn").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["text"]), "").alias("content")
    )
    return m.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), "content").where(F.regexp_replace("content", r"[ \t\r\n]+", "") != "")


def render(events: DataFrame, *, partitioned: bool = False) -> DataFrame:
    """conv_id, n_messages and the rendered text of each conversation."""
    C.ready(events.sparkSession)
    m = messages(events, partitioned=partitioned).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    one = lambda x: F.concat(F.lit(BEGIN), x["role"], F.lit("\n"), x["content"], F.lit(END + "\n"))
    return m.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", one), "").alias("rendered"))


SQL = f"""
with e as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null
  qualify row_number() over (partition by conv_id, turn order by coalesce(role, 'unknown') desc, substr(md5(coalesce(text, '')), 1, 15) desc) = 1)
select conv_id, count(*) as n_messages,
       string_agg('{BEGIN}' || role || chr(10) || text || '{END}' || chr(10), '' order by turn) as rendered
from e where regexp_replace(text, '[ \\t\\r\\n]+', '', 'g') <> '' group by conv_id
"""
