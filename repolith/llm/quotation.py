"""Chat formatting: quoted passages are linked to the messages they come from and left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm.common import cut

#: Quote marks at the start of a line; each > is one level.
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
# Lines that introduce a quotation, as mail programs write them.
ATTRIBUTION = r"(?i)^\s*(?:(?:on|am|le|el)\b.{0,200}(?:wrote|schrieb|a écrit|escribió)\s?:|-{2,}\s*original message\s*-{2,})\s*$"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def sentences(text: Column) -> Column:
    """Normalised sentences: lower case, white space collapsed, quotation marks and edge punctuation dropped."""
    flat = F.regexp_replace(F.lower(text), r"[\s\"'“”«»]+", " ")
    parts = F.transform(F.split(flat, r"(?<=[.!?])\s"), lambda s: F.regexp_replace(s, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(parts, lambda s: s != "")


def units(parts: Column, wholes: Column) -> Column:
    """What is hashed of a text: its sentences, and passages as a whole, as arrays of sentences."""
    joined = F.transform(F.filter(wholes, lambda w: F.size(w) > 1), lambda w: F.struct(F.array_join(w, " ").alias("s"), F.size(F.array_distinct(w)).alias("n")))
    single = F.transform(parts, lambda s: F.struct(s.alias("s"), F.lit(0).alias("n")))
    both = F.transform(F.concat(single, joined), lambda u: F.struct(F.xxhash64(u["s"]).alias("h1"), F.xxhash64(F.lit(1), u["s"]).alias("h2"), (u["n"] + 1).alias("weight")))
    return F.explode(F.array_distinct(both))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, proof, role, lines, plain): plain is the text without quotes and what introduces them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, r"\r?\n")
    rows = messages.select("conv_id", "turn", "role", F.hash(text, "role").alias("proof"), lines.alias("lines"))
    following = F.slice(F.concat("lines", F.array(F.lit(""))), 2, F.size("lines"))
    pairs = F.arrays_zip(F.col("lines").alias("line"), following.alias("next"))
    own = F.filter(pairs, lambda p: (level(p["line"]) == 0) & ~(p["line"].rlike(ATTRIBUTION) & (level(p["next"]) > 0)))
    plain = F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda p: p["line"]), "\n"), r"\n{3,}", "\n\n"))
    return rows.withColumn("plain", F.regexp_replace(plain, r"^\n+|\n+$", ""))


def passages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, proof, passage, level, quoted): maximal runs of lines of one quote level, joined."""
    quoted = rows.where(F.exists("lines", lambda x: level(x) > 0))
    quoted = quoted.select("conv_id", "turn", "proof", F.posexplode("lines").alias("pos", "line")).withColumn("level", level(F.col("line"))).where("level > 0")
    quoted = quoted.distinct()  # rows that repeat a message
    message = ["conv_id", "turn", "proof"]
    in_level = Window.partitionBy(*message, "level").orderBy("pos")
    quoted = quoted.withColumn("run", F.col("pos") - F.row_number().over(in_level))
    quoted = quoted.groupBy(*message, "level", "run").agg(F.min("pos").alias("passage"), F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace("line", MARKS, "").alias("s")))).alias("s"))
    return quoted.select(*message, "passage", "level", F.array_join("s.s", " ").alias("quoted"))


def latest_before(held: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, h1, h2, turn, from_turn): the latest turn before each asked one of its conversation that holds the hash.

    Turns are range-partitioned by conversation, hash and turn; each range takes over what the ranges before it
    found. So neither a long conversation nor a sentence that it repeats all the time is in one task.
    """
    keys = ["conv_id", "h1", "h2"]
    turns = held.select(*keys, F.col("from_turn").alias("turn"), F.lit(1).alias("holds"))
    turns = turns.union(asked.select(*keys, "turn", F.lit(0).alias("holds")).distinct())
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = cut(turns.repartitionByRange(parts, *keys, "turn", "holds").withColumn("part", F.spark_partition_id()))
    holder = F.when(F.col("holds") == 1, F.col("turn"))
    ends = turns.groupBy(*keys, "part").agg(F.max(holder).alias("last"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.max("last").over(before)).drop("last")
    inside = Window.partitionBy(*keys, "part").orderBy("turn", "holds").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("inside", F.max(holder).over(inside)).where("holds = 0").join(ends, [*keys, "part"])
    return turns.select(*keys, "turn", F.coalesce("inside", "before").alias("from_turn")).where("from_turn is not null")


def first_holders(held: DataFrame) -> DataFrame:
    """(h1, h2, first, other): the first message of all that holds a hash, and the first of another conversation."""
    keys = ["h1", "h2"]
    each = held.groupBy(*keys, "conv_id").agg(F.min("from_turn").alias("from_turn")).select(*keys, F.struct("conv_id", "from_turn").alias("at"))
    first = each.groupBy(*keys).agg(F.min("at").alias("first"))
    other = each.join(first, keys).where("at.conv_id <> first.conv_id").groupBy(*keys).agg(F.min("at").alias("other"))
    return first.join(other, keys, "left")


def links(rows: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, turn, proof, passage, level, from_conv, from_turn, matched, n_sentences) of each quoted passage.

    The hashes of a passage's sentences and, with more weight than all of these, that of the passage as a whole each
    vote for the latest message before in the conversation that holds them; the message with most votes (the latest
    of equals) is where the passage comes from. If there is none, the first messages of other conversations get the
    votes. matched is the number of sentences that the winner's votes stand for. Originals are reduced to one row a
    hash before the joins, so no join is many to many.
    """
    key = ["conv_id", "turn", "proof", "passage", "level"]
    parts = sentences(F.col("quoted"))
    known = quoted.where("conv_id is not null and turn is not null")
    asked = known.select(*key, F.explode(F.array(parts)).alias("parts"))
    asked = cut(asked.select(*key, units(F.array_distinct("parts"), F.array("parts")).alias("h")).select(*key, "h.*").distinct())
    wholes = F.concat(F.array(sentences(F.col("plain"))), F.transform(F.split("plain", "\n"), sentences))
    held = rows.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").alias("from_turn"), units(sentences(F.col("plain")), wholes).alias("h"))
    held = held.select("conv_id", "from_turn", "h.h1", "h.h2").join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").distinct()
    held = cut(held)
    near = asked.join(latest_before(held, asked), ["conv_id", "h1", "h2", "turn"])
    near = near.groupBy(*key, "from_turn").agg(F.sum("weight").alias("votes"))
    near = near.groupBy(*key).agg(F.max(F.struct("votes", "from_turn")).alias("best"))
    near = near.select(*key, F.col("conv_id").alias("from_conv"), "best.from_turn", "best.votes")
    far = asked.join(first_holders(held), ["h1", "h2"])
    far = far.withColumn("at", F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("other"))).where("at is not null")
    far = far.groupBy(*key, "at").agg(F.sum("weight").alias("votes"))
    most = F.max_by("at", F.struct("votes", -F.col("at.conv_id"), -F.col("at.from_turn"))).alias("at")
    far = far.groupBy(*key).agg(most, F.max("votes").alias("far_votes")).select(*key, F.col("at.conv_id").alias("far_conv"), F.col("at.from_turn").alias("far_turn"), "far_votes")
    n = F.size(F.array_distinct(parts)).alias("n_sentences")
    out = quoted.select(*key, n).join(near, key, "left").join(far, key, "left")
    return out.select(
        *key,
        F.coalesce("from_conv", "far_conv").alias("from_conv"),
        F.when(F.col("from_conv").isNotNull(), F.col("from_turn")).otherwise(F.col("far_turn")).alias("from_turn"),
        F.least(F.coalesce("votes", "far_votes", F.lit(0)), F.col("n_sentences")).cast("int").alias("matched"),
        "n_sentences",
    )


def previous_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, previous, place): the turn before each in its conversation, and how many there are before it.

    Turns are range-partitioned, so a conversation of any length is spread over tasks; the first of each range
    takes the last turn of the ranges before it.
    """
    turns = rows.select("conv_id", "turn").where("conv_id is not null and turn is not null").distinct()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = cut(turns.repartitionByRange(parts, "conv_id", "turn").withColumn("part", F.spark_partition_id()))
    ends = turns.groupBy("conv_id", "part").agg(F.max("turn").alias("last"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("conv_id", "part", F.max("last").over(before).alias("before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn")
    turns = turns.withColumns({"inside": F.lag("turn").over(inside), "row": F.row_number().over(inside) - 1}).join(ends, ["conv_id", "part"])
    return turns.select("conv_id", "turn", F.coalesce("inside", "before").alias("previous"), (F.col("n") + F.col("row")).alias("place"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, place, reply_to, n_passages, max_level, n_linked, links, plain.

    reply_to is the turn that the message's first passage of level 1 comes from, if that is in the conversation,
    else the turn before (null for the first). Replies come after what they answer, so (conv_id, turn) is reply
    order, and place the message's place in it. links has a passage, level, from_conv, from_turn and matched for each
    linked passage, in order. Null text has no quotes and an empty plain text; a message with a null conv_id or turn replies to none
    and its passages are counted but not linked.
    Repeated rows each get a row. An empty table gives an empty result; other columns are ignored.
    """
    rows = parsed(messages)
    message = ["conv_id", "turn", "proof"]
    found = cut(links(rows, passages(rows)))
    answered = F.when((F.col("level") == 1) & (F.col("from_conv") == F.col("conv_id")), F.struct("passage", "from_turn"))
    found = found.groupBy(*message).agg(F.count("*").alias("n_passages"), F.max("level").alias("max_level"), F.count("from_turn").alias("n_linked"), F.min(answered)["from_turn"].alias("answered"), F.array_sort(F.collect_list(F.when(F.col("from_turn").isNotNull(), F.struct("passage", "level", "from_conv", "from_turn", "matched")))).alias("links"))
    out = rows.drop("lines").join(previous_turns(rows), ["conv_id", "turn"], "left").alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in message]
    out = out.join(found.alias("f"), same[0] & same[1] & same[2], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.array().cast("array<struct<passage:int,level:int,from_conv:bigint,from_turn:bigint,matched:int>>")
    return out.select(
        "r.conv_id", "r.turn", "role", "place", F.coalesce("answered", "previous").alias("reply_to"), zero("n_passages"), zero("max_level"), zero("n_linked"),
        F.coalesce("links", none).alias("links"), "plain",
    )


def conversations(linked: DataFrame) -> DataFrame:
    """The messages in order of conversation and reply, for export: range-partitioned, so long ones are spread."""
    return linked.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
