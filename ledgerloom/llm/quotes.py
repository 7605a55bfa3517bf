"""Chat formatting: quotation linking. SQL functions only.

Lines are split into quote levels by their ``>`` marks. Neighbouring lines of one
level up to a blank line are a passage, line breaks being blanks, so a quotation may
be wrapped anew. Passages are normalised and cut into sentences, whose hashes are
joined to the latest earlier message of the conversation that wrote the sentence
itself. The message that most sentences of the shallowest linked level come from is
what a message replies to, else the turn before it. What is left is each message's
own text, with a key that sorts a conversation so that every reply stands behind
what it replies to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import lower_ascii, neighbour, staged, text_or_empty

#: Repeated groups never give back what they took: the engine would recurse into them, once for each mark or line.
MARKS = r"^(?:[ \t]{0,3}+>)++"
BLANK_HEAD = r"^(?:[ \t\r]*+\n)++"
#: The line that introduces a quotation, in four languages.
ATTRIBUTION = r"(?i)^[ \t]*(?:on .{1,200} wrote|am .{1,200} schrieb .{0,100}|le .{1,200} a écrit|el .{1,200} escribió)[ \t]?:[ \t\r]*$"
STRETCH = 1024
BREAK, LEVEL, END = "\u0001", "\u0002", "\u0003"  # between passages, behind a passage's level, between sentences


def level_of(line: Column) -> Column:
    """The number of ``>`` a line begins with; up to three blanks may stand before each."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normalised(line: Column) -> Column:
    """A line without its marks, A-Z lower-cased, runs of blanks as one."""
    return F.trim(F.regexp_replace(lower_ascii(F.regexp_replace(line, MARKS, "")), f"[ \\t\\r{BREAK}{LEVEL}{END}]+", " "))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once although ``use`` may read it inside another function's steps."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _levelled(lines: Column) -> Column:
    """Lines with their levels; attributions of a message that quotes get level -1."""
    quotes = F.exists(lines, lambda x: (x["level"] > 0) & (x["norm"] != ""))

    def level(x: Column, quoting: Column) -> Column:
        return F.when((x["level"] == 0) & quoting & x["line"].rlike(ATTRIBUTION), -1).otherwise(x["level"])

    return _let(quotes, lambda q: F.transform(lines, lambda x: F.struct(level(x, q).alias("level"), x["norm"].alias("norm"), x["line"].alias("line"))))


def _passages(lines: Column) -> Column:
    """The runs of lines of one level, each as its level, a mark and its text."""

    def written(x: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        starts = (i == 0) | (before["level"] != x["level"]) | (before["norm"] == "")
        return F.when(x["norm"] != "", F.concat(F.when(starts, F.concat(F.lit(BREAK), x["level"].cast("string"), F.lit(LEVEL))).otherwise(" "), x["norm"])).otherwise("")

    return F.array_remove(F.split(F.array_join(F.transform(lines, written), ""), BREAK), "")


def _sentences(passage: Column) -> Column:
    """(level, hash) of the sentences of a passage."""
    parts = F.split(F.regexp_replace(passage, "([.!?]) ", f"$1{END}"), f"[{LEVEL}{END}]")
    one = lambda p, s: F.struct(F.get(p, F.lit(0)).cast("int").alias("level"), F.unhex(F.md5(s.cast("binary"))).alias("hash"))
    return _let(parts, lambda p: F.transform(F.slice(p, 2, F.size(p)), lambda s: one(p, s)))


def parsed(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """``messages`` with ``own`` (text without quotes and attributions), ``own_hashes`` and ``quoted`` (level, hash), one of each sentence."""
    lines = F.transform(F.split(text_or_empty(text_col), "\n"), lambda s: F.struct(level_of(s).alias("level"), normalised(s).alias("norm"), s.alias("line")))
    df = messages.withColumn("lines", _let(lines, _levelled))
    df = df.withColumn("sentences", F.flatten(F.transform(_let(F.col("lines"), _passages), _sentences)))
    text = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    own = F.rtrim(F.regexp_replace(text, BLANK_HEAD, ""), F.lit(" \t\n\u000b\f\r"))
    hashes = F.array_distinct(F.transform(F.filter("sentences", lambda x: x["level"] == 0), lambda x: x["hash"]))
    return df.withColumn("own", own).withColumn("own_hashes", hashes).withColumn("quoted", F.filter("sentences", lambda x: x["level"] > 0)).drop("lines", "sentences")


def origins(asked: DataFrame, written: DataFrame) -> DataFrame:
    """(conv_id, turn, hash, origin): the latest turn before ``turn`` that wrote the sentence. Both sides: conv_id, turn, hash, distinct.

    A sentence of a conversation is cut into stretches of turns, so that no task sorts more than one.
    """
    both = written.select("conv_id", "hash", "turn", F.col("turn").alias("wrote"), F.lit(False).alias("asks"))
    both = both.unionByName(asked.select("conv_id", "hash", "turn", F.lit(None).cast("long").alias("wrote"), F.lit(True).alias("asks")))
    both = both.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    key = ["conv_id", "hash"]
    near = F.max("wrote").over(Window.partitionBy(*key, "stretch").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    ends = both.groupBy(*key, "stretch").agg(F.max("wrote").alias("end"))
    far = F.max("end").over(Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("near", near).where("asks").join(ends.withColumn("far", far).drop("end"), [*key, "stretch"])
    return found.select(*key, "turn", F.coalesce("near", "far").alias("origin")).where("origin is not null")


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, reply_to, reply_order, n_quoted, max_level, n_linked, own) for every message.

    ``reply_to`` is the turn a message answers. Every quoted sentence comes from the
    latest earlier message that wrote it itself; of the shallowest level with such
    sentences the message with most of them counts (ties: the latest), else the turn
    before, null for the first. ``n_quoted`` and ``n_linked`` count sentences. Sorting
    a conversation by ``reply_order`` puts every message behind the one it replies to,
    and answers to one message side by side. Null text is empty; texts of any length
    are read whole; an empty table gives an empty result. Messages with a null
    conversation or turn reply to nothing and link nothing. Rows that repeat a turn
    stay, with one answer for the turn. Extra columns are not read.
    """
    df = parsed(messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))).drop("text")
    levels = F.coalesce(F.array_max(F.transform("quoted", lambda q: q["level"])), F.lit(0))
    df = staged(df.withColumns({"n_quoted": F.size("quoted").cast("long"), "max_level": levels.cast("long")}), "quotes-parsed")  # every text is parsed once
    key = ["conv_id", "turn"]
    placed = df.where("conv_id is not null and turn is not null")
    asked = placed.where(F.size("quoted") > 0).select(*key, F.explode("quoted").alias("q")).select(*key, "q.level", "q.hash")
    asking = asked.select(*key, "hash").distinct()
    written = placed.select(*key, F.explode("own_hashes").alias("hash")).distinct().join(asking.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    linked = asked.join(origins(asking, written), [*key, "hash"])
    votes = linked.groupBy(*key, "level", "origin").agg(F.count("*").alias("n"))
    answers = votes.groupBy(*key).agg(F.max_by("origin", F.struct(-F.col("level"), "n", "origin")).alias("answered"), F.sum("n").alias("n_linked"))
    before = neighbour(placed.select(*key).distinct(), ["conv_id"], "turn", False, STRETCH, "previous")
    turns = before.join(answers, key, "left").select(*key, F.coalesce("answered", "previous").alias("reply_to"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
    out = df.drop("quoted", "own_hashes").join(turns, key, "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0).cast("long")))
    digits = lambda c: F.lpad((c + 10**18).cast("string"), 19, "0")  # noqa: E731  turns may be negative
    order = F.concat(F.coalesce(digits(F.col("reply_to")), F.lit("0" * 19)), F.lit("."), digits(F.col("turn")))
    return out.select("conv_id", "turn", "role", "reply_to", order.alias("reply_order"), "n_quoted", "max_level", "n_linked", "own")
