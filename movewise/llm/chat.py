"""Chat formatting (operator 8, native): multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and all others as named users; the mask spans mark the characters to be learned (what the
assistant says, with its end mark). Speakers of `system_roles` are context: rendered as system,
never as the assistant. A conversation is rendered whole, one row for each of its speakers.

A mark (``<|im_start|>`` or ``<|im_end|>``) inside a text or a role is data, not structure: its ``|``
is doubled (``<||im_start||>``), so that no turn can open another. Line breaks in a role become blanks
(roles that agree after that are one participant).

DataFrame operations only. Turns are dealt to tasks by ranges of (conversation, turn, role, text), so
that a conversation with a third of all rows is spread over many tasks: each range numbers its own
turns and adds up their lengths, and what the ranges before it hold (a few numbers for each range) is
added afterwards. Turns are rendered in parts of `part_turns`, each with its place in the whole, and
parts of a longer conversation are joined at the end. A cell holds a whole dialogue, so that last step
needs an executor that can hold it, and one beyond 2 GB (the limit of a cell) fails rather than being
cut; ``rotate_parts`` gives the parts themselves, which have no such limit.

Cases: null turn sorts first, null text is empty, a null role is the participant "unknown". Turns
that tie are ordered by role, then text; repeated rows are rendered each time. A null conv_id is a
conversation like any other. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts as partitions
from .common import staged

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
UNKNOWN = "unknown"


def escaped(text: Column) -> Column:
    """Text without a mark of the format."""
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("|", "||")))
    return text


def _placed(conversations: DataFrame, system_roles: tuple[str, ...], part_turns: int) -> DataFrame:
    """Every turn with its conversation, the number of that one's parts, its part and place (at), and where its text ends if nobody is the assistant."""
    said = F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN))
    role = F.regexp_replace(escaped(said), r"[\r\n]", " ")
    system = said.isin(*system_roles)
    head = F.concat(F.lit(OPEN), F.when(system, F.lit("system")).otherwise(F.concat(F.lit("user name="), role)), F.lit("\n"))
    text = escaped(F.coalesce(F.col("text").cast("string"), F.lit("")))
    turns = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), system.alias("system"), head.alias("head"), text.alias("text"))
    keyed = turns.withColumn("tie", F.monotonically_increasing_id())  # turns that agree in all else are alike: any order of them gives the same result
    dealt = keyed.repartitionByRange(partitions(conversations.sparkSession), "conv", "turn", "role", "text", "tie").withColumn("range", F.spark_partition_id())
    dealt = staged(dealt.drop("tie"), "turns")
    size = (F.length("head") + F.length("text") + len(CLOSE) + 1).cast("long")
    own = Window.partitionBy("conv", "range").orderBy("turn", "role", "text")
    numbered = dealt.withColumn("size", size).withColumns({"at": F.row_number().over(own).cast("long"), "end": F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    held = dealt.groupBy("conv", "range").agg(F.count("*").alias("n"), F.sum(size).alias("chars"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = held.select(F.col("conv").alias("r_conv"), F.col("range").alias("r_range"), F.sum("n").over(Window.partitionBy("conv")).alias("all"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars0"))
    out = numbered.join(ranges, F.col("conv").eqNullSafe(F.col("r_conv")) & (F.col("range") == F.col("r_range")))
    at, end = F.col("at") + F.col("n0") - 1, F.col("end") + F.col("chars0") - 1
    return out.select("conv", F.ceil(F.col("all") / part_turns).alias("parts"), F.floor(at / part_turns).alias("part"), at.alias("at"), end.alias("end"), "role", "system", "head", "text")


def _blocks(turns: DataFrame) -> DataFrame:
    speakers = F.array_sort(F.collect_set(F.when(~F.col("system"), F.col("role")))).alias("speakers")
    return turns.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("at", "end", "role", "system", "head", "text"))).alias("turns"), speakers)


def _rendered(shown: DataFrame) -> DataFrame:
    """shown: conv, part, turns, a perspective, and how many turns it has in earlier parts."""
    mine = lambda t: ~t["system"] & (t["role"] == F.col("perspective"))
    own = shown.withColumn("own", F.filter("turns", mine))
    less = F.length("perspective") + len("user name=") - len("assistant")  # an assistant's head is shorter than its user's

    def span(t: Column, i: Column) -> Column:
        end = t["end"] - (F.col("earlier") + i + 1) * less
        return F.concat_ws("-", (end - F.length(t["text"]) - len(CLOSE)).cast("string"), end.cast("string"))

    learned = F.lit(f"{OPEN}assistant\n")
    dialogue = F.array_join(F.transform("turns", lambda t: F.concat(F.when(mine(t), learned).otherwise(t["head"]), t["text"], F.lit(f"{CLOSE}\n"))), "")
    return own.select(
        F.col("conv").alias("conv_id"), "perspective", "part", F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("own", F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"]) + len(CLOSE)).alias("n_learned"),
        dialogue.alias("text"), F.array_join(F.transform("own", span), ",").alias("mask"),
    )


def _short(turns: DataFrame) -> DataFrame:
    """Conversations of one part, which need no join."""
    return _rendered(_blocks(turns.where("parts = 1")).select("conv", "part", "turns", F.explode("speakers").alias("perspective"), F.lit(0).cast("long").alias("earlier")))


def _long(turns: DataFrame) -> DataFrame:
    """Conversations of several parts, each part with all participants of its conversation."""
    turns = turns.where("parts > 1")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    told = turns.where(~F.col("system")).groupBy(F.col("conv").alias("t_conv"), F.col("part").alias("t_part"), F.col("role").alias("t_role")).agg(F.count("*").alias("n"))
    people = told.select(F.col("t_conv").alias("p_conv"), F.col("t_role").alias("perspective")).distinct()
    every = turns.select("conv", "part").distinct().join(people, same("conv", "p_conv")).select("conv", "part", "perspective")
    counted = every.join(told, same("conv", "t_conv") & (F.col("part") == F.col("t_part")) & (F.col("perspective") == F.col("t_role")), "left")
    before = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counted.select(F.col("conv").alias("s_conv"), F.col("part").alias("s_part"), "perspective", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return _rendered(_blocks(turns).join(earlier, same("conv", "s_conv") & (F.col("part") == F.col("s_part"))))


def rotate_parts(conversations: DataFrame, system_roles: tuple[str, ...] = ("system",), part_turns: int = 2048) -> DataFrame:
    """conv_id, perspective, part, n_turns, n_learned, text, mask: dialogues in parts that join to the whole; masks count from its first character."""
    turns = staged(_placed(conversations, system_roles, part_turns), "placed")
    return _short(turns).unionByName(_long(turns))


def rotate(conversations: DataFrame, system_roles: tuple[str, ...] = ("system",), part_turns: int = 2048) -> DataFrame:
    """conv_id, perspective, n_turns, n_learned, text, mask ("first-end,..." in characters of text, end exclusive): one row per conversation and participant."""
    turns = staged(_placed(conversations, system_roles, part_turns), "placed")
    rows = _long(turns).groupBy("conv_id", "perspective").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_learned").alias("n_learned"), F.array_sort(F.collect_list(F.struct("part", "text", "mask"))).alias("parts"))
    masks = F.filter(F.col("parts.mask"), lambda m: m != "")
    joined = rows.select("conv_id", "perspective", "n_turns", "n_learned", F.array_join("parts.text", "").alias("text"), F.array_join(masks, ",").alias("mask"))
    return _short(turns).drop("part").unionByName(joined)
