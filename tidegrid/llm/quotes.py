"""Quotation linking of message threads, by DataFrame functions only.

A line's quote level is its number of leading '>' (blanks between them allowed).
Lines are normalised (markers off, blanks collapsed, lower case) and hashed. A
passage is a run of lines of one level without a blank one; its key is the hash of
its lines' hashes. Quoted passages are joined to the latest earlier message of
their conversation that says the same passage, and so are single lines, for
quotes that are cut: both sides are ordered by turn within (conversation, key) and
the last sayer is carried forward, so no pairs are built. A message replies to the
message that, at the lowest level that has an original, most of its lines in whole
passages come from, then most of its single lines, then the later one; deeper
levels decide only where all that is quoted less deep was said by nobody. Threads'
roots and depths follow by pointer doubling, and a reply's position is the rank of
its turn in its thread.

Edge cases: rows with a null conversation or turn are returned with no parent,
as their own root, at position 0; null texts are empty; rows that repeat (conv_id,
turn) share parent, root, depth and position; blank quoted lines link nothing; "... wrote:" lines right
before a quote go with it; texts and marks of any length are handled whole, as no
pattern repeats a group without a bound; columns named root, parent, depth, position or
said are not read; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm._store import discard, settle

_MARK = r"^([ \t>]*>)"  # classes only: a repeated group would recurse once a marker
_ATTRIBUTION = r"^[ \t]*(?:on|am|le|el) .{1,200}(?:wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*$"


def level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, _MARK, 1), " \t", ""))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARK, "")), r"[ \t]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, said (text without quotes), and structs of level, key and n (lines): lines that are not blank, and passages."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.split(text, "\r?\n").alias("raw"))

    def parsed(line: Column, i: Column) -> Column:
        ahead = F.coalesce(F.get("raw", i + 1), F.lit(""))
        attribution = F.lower(line).rlike(_ATTRIBUTION) & (level(ahead) > 0)
        key = F.when(normalised(line) != "", F.xxhash64(normalised(line)))
        return F.struct(level(line).alias("level"), F.when(~attribution, key).alias("key"), attribution.alias("attribution"), line.alias("line"))

    rows = rows.withColumn("all", F.transform("raw", parsed))
    own = F.filter("all", lambda x: (x["level"] == 0) & ~x["attribution"])
    said = F.array_join(F.transform(own, lambda x: x["line"]), "\n")
    kept = F.transform(F.filter("all", lambda x: x["key"].isNotNull()), lambda x: F.struct(x["level"].alias("level"), x["key"].alias("key"), F.lit(1).alias("n")))
    # Of each line the level that a passage goes on with, -1 for lines in none.
    kinds = F.transform("all", lambda x: F.when(x["key"].isNull(), -1).otherwise(x["level"]))
    keys = F.transform("all", lambda x: x["key"])
    rows = rows.select("conv_id", "turn", "role", said.alias("said"), kept.alias("lines"), keys.alias("keys"), kinds.alias("kinds"))
    kind, n = lambda i: F.coalesce(F.get("kinds", i), F.lit(-1)), F.size("kinds")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (kind(i) >= 0) & ((i == 0) | (kind(F.greatest(i - 1, F.lit(0))) != kind(i))))
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (kind(i - 1) >= 0) & (kind(i) != kind(i - 1)))
    passages = F.zip_with(starts, ends, lambda b, e: F.struct(F.get("kinds", b).alias("level"), F.xxhash64(F.slice("keys", b + 1, e - b)).alias("key"), (e - b).alias("n")))
    return rows.select("conv_id", "turn", "role", "said", "lines", passages.alias("passages"))


def parents(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent (turn), for the messages that quote an earlier one."""
    named = lambda array, whole: F.transform(array, lambda x: F.struct(F.lit(whole).alias("whole"), x["level"].alias("level"), x["key"].alias("key"), x["n"].alias("n")))
    units = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(F.concat(named("lines", False), named("passages", True))).alias("x"))
    units, what = units.select("conv_id", "turn", "x.*"), ["conv_id", "whole", "key"]
    quoted = units.where("level > 0").groupBy(*what, "turn", "level").agg(F.sum("n").alias("n"))
    said = units.where("level = 0").join(quoted.select(*what).distinct(), what, "left_semi").select(*what, "turn").distinct()
    both = quoted.withColumn("sayer", F.lit(None).cast("long")).unionByName(said.withColumns({"n": F.lit(0).cast("long"), "level": F.lit(0), "sayer": F.col("turn")}))
    earlier = Window.partitionBy(*what).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    votes = both.withColumn("parent", F.max("sayer").over(earlier)).where("n > 0 and parent is not null")
    of = lambda whole: F.sum(F.when(F.col("whole") == whole, F.col("n")).otherwise(0))
    votes = votes.groupBy("conv_id", "turn", "level", "parent").agg(of(True).alias("passages"), of(False).alias("lines"))
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "passages", "lines", "parent")).alias("best")).select("conv_id", "turn", F.col("best.parent").alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """links of parents(); adds root (turn) and depth, doubling the distance climbed each round."""
    state = settle(links.select("*", F.col("parent").alias("top"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = state.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("higher"), F.col("depth").alias("more"))
        new = state.join(up, ["conv_id", "top"], "left")
        new = new.select("conv_id", "turn", "parent", F.coalesce("higher", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved"))
        new = settle(new, "threads")
        discard(state)
        state = new
        if new.where("moved").isEmpty():
            return state.drop("moved").withColumnRenamed("top", "root")


def link(messages: DataFrame) -> DataFrame:
    """conv_id, root, turn, role, parent, depth, position, said: sorted by (conv_id, root, position) each thread is together and replies follow what they quote."""
    parsed = parse(messages)
    found = threads(parents(parsed))
    out = parsed.drop("lines", "passages").join(found, ["conv_id", "turn"], "left").withColumn("root", F.coalesce("root", "turn"))
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()  # dealt by text, so that they are no hot group
    thread = Window.partitionBy("conv_id", "root", F.when(alone, F.xxhash64("said"))).orderBy("turn")
    position = F.when(alone, 0).otherwise(F.dense_rank().over(thread) - 1).cast("long")
    return out.select("conv_id", "root", "turn", "role", "parent", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), position.alias("position"), "said")
