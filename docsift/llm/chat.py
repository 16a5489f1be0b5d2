"""Quotation linking for conversations; DataFrame functions only.

Lines that begin with ``>``, blanks aside, are quoted, once for each ``>``. Runs of lines of one level are passages. A line of any
length that announces a quote ("On Monday A wrote:"), or two lines that do so together, goes with the quote that follows it. A passage, each
paragraph and each sentence of it (over line breaks, and line by line) is normalised (lower case, letters and digits only) and
hashed; the hash is looked up among the hashes of what
earlier messages of the conversation say in their own words. The latest earlier message that holds it is the origin. A message
replies to the origin of most of its hashes at the outermost level that has one, the latest on a tie. Messages of one reply
tree form a thread.

Only messages that hold a line with ``>`` are taken apart line by line.

Lookups never pair rows: originals and quotes of one hash are put in order of turns and the last original is carried along,
within slices of SLICE turns, with one carried row from slice to slice; so no conversation or common phrase lands in one task
as a whole. Trees are resolved by pointer doubling over linked messages alone.

Result, in reply order (conversation, thread, turn; a message always stands after the one it replies to): the columns of the
input but the text, ``text`` without quotes and the lines that announce them, ``n_quotes`` (passages), ``n_linked`` (hashes
with an origin), ``reply_to`` (turn), ``thread`` (turn of the tree's first message), ``depth``.

Defined results: null text is empty; messages with a null conversation or turn are unlinked threads of their own (thread is
their turn); rows with one conversation and turn are one message for links, and each keeps its row; a quote without origin is
removed and stays unlinked; texts and lines of any length are read whole; an empty table gives no rows; input columns named like those of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.llm.shared import discard, save, table

SLICE = 4096
#: Columns of the result and of the steps; input columns of these names are replaced.
OWN = ("text", "n_quotes", "n_linked", "reply_to", "thread", "depth", "_lines", "_starts", "_own", "_passages", "_c", "_t")
_MARK = r"^[ \t]*((?:>[ \t]?)+)"
_WROTE = r"^[ \t]*(On .+ wrote|Am .+ schrieb.*|Le .+ a écrit ?|El .+ escribió):[ \t]*$"
_QUOTES = r"(?m)^[ \t]*>"


def _level(line: Column) -> Column:
    return F.char_length(F.regexp_replace(F.regexp_extract(line, _MARK, 1), "[^>]", ""))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _units(passage: Column) -> Column:
    """Distinct hashes of a passage, its paragraphs, its sentences over soft line breaks, and the parts of those on a line."""
    paragraphs = F.split(passage, r"\n\s*\n")
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"[.!?…]+(?:\s+|$)")))
    parts = F.split(passage, r"[.!?…]+(?:\s+|$)|\n")
    units = F.transform(F.concat(F.array(passage), paragraphs, sentences, parts), _plain)
    return F.transform(F.filter(F.array_distinct(units), lambda x: x != ""), lambda x: F.md5(x))


def parse(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_own`` (text without quotes) and ``_passages`` (array of level and text)."""
    text = F.coalesce(text_col, F.lit(""))
    quotes, none = text.rlike(_QUOTES), F.expr("cast(array() as array<struct<level:int,said:string,line:string>>)")
    split = F.transform(F.split(text, "\r?\n"), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, _MARK, "").alias("said"), x.alias("line")))
    lines = messages.withColumn("_lines", F.when(quotes, split).otherwise(none))
    level = lambda k: F.coalesce(F.get(F.col("_lines"), k)["level"], F.lit(0))
    line = lambda k: F.coalesce(F.get(F.col("_lines"), k)["line"], F.lit(""))
    both = lambda k: (level(k) == 0) & (level(k + 1) == 0) & (level(k + 2) > 0) & F.concat_ws(" ", line(k), line(k + 1)).rlike(_WROTE)
    announces = lambda k: ((level(k + 1) > 0) & line(k).rlike(_WROTE)) | both(k) | ((k > 0) & both(k - 1))
    own = F.filter("_lines", lambda x, k: (x["level"] == 0) & ~announces(k))
    starts = F.filter(F.transform("_lines", lambda x, k: F.struct(k.alias("k"), x["level"].alias("level"))), lambda x: (F.when(x["k"] == 0, F.lit(-1)).otherwise(level(x["k"] - 1)) != x["level"]))
    plain = F.regexp_replace(text, "\r\n", "\n")
    cut = lines.withColumn("_starts", starts).withColumn("_own", F.when(F.size("_lines") == 0, plain).otherwise(F.array_join(F.transform(own, lambda x: x["line"]), "\n")))
    ends = lambda k: F.coalesce(F.get(F.col("_starts"), k + 1)["k"], F.size("_lines"))
    passages = F.transform("_starts", lambda s, k: F.struct(s["level"].alias("level"), F.array_join(F.transform(F.slice("_lines", s["k"] + 1, ends(k) - s["k"]), lambda x: x["said"]), "\n").alias("said")))
    return cut.withColumn("_passages", F.filter(passages, lambda p: (p["level"] > 0) & (_plain(p["said"]) != ""))).drop("_lines", "_starts")


def _origins(originals: DataFrame, quotes: DataFrame) -> DataFrame:
    """For each quote ``conv, unit, turn, level`` the latest earlier turn with that unit."""
    both = originals.select("conv", "unit", "turn", F.lit(None).cast("int").alias("level")).distinct().unionByName(quotes.select("conv", "unit", "turn", "level").distinct())
    both = both.withColumn("slice", F.floor(F.col("turn") / SLICE))
    said = F.when(F.col("level").isNull(), F.col("turn"))
    inside = Window.partitionBy("conv", "unit", "slice").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(said).over(inside)).where("level is not null")
    by_slice = both.groupBy("conv", "unit", "slice").agg(F.max(said).alias("last"))
    before = Window.partitionBy("conv", "unit").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_slice.withColumn("carried", F.max("last").over(before)).drop("last")
    return near.join(carried, ["conv", "unit", "slice"]).select("conv", "turn", "level", "unit", F.coalesce("near", "carried").alias("origin")).where("origin is not null")


def _trees(replies: DataFrame) -> DataFrame:
    """``conv, turn, reply_to`` to ``conv, turn, reply_to, thread, depth`` by pointer doubling."""
    now = save(replies.select("conv", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        up = now.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"))
        after = save(now.join(up, ["conv", "thread"], "left").select("conv", "turn", "reply_to", F.coalesce("further", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")), "replies")
        moved = not after.where("moved").isEmpty()
        discard(now.sparkSession, now)
        now = after.drop("moved")
        now._saved_at = after._saved_at
        if not moved:
            return now


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    messages = messages.select(*[c for c in messages.columns if c in (conv_col, turn_col, text_col) or c not in OWN])
    parsed = parse(messages, text_col)
    keyed = parsed.where(F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull()).select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), "_own", "_passages")
    quotes = save(keyed.where(F.size("_passages") > 0).select("conv", "turn", F.explode("_passages").alias("p")).select("conv", "turn", F.col("p.level").alias("level"), F.explode(_units(F.col("p.said"))).alias("unit")), "quotes")
    own = [F.col(c) for c in messages.columns if c != text_col]
    told = parsed.select(*own, F.col("_own").alias("text"), F.size("_passages").cast("long").alias("n_quotes"))
    if quotes.isEmpty():
        discard(messages.sparkSession, quotes)
        linked = told.select("*", F.lit(0).cast("long").alias("n_linked"), F.lit(None).cast("long").alias("reply_to"), F.col(turn_col).cast("long").alias("thread"), F.lit(0).cast("long").alias("depth"))
    else:
        quoting = quotes.select("conv").distinct()
        originals = keyed.join(quoting, "conv", "left_semi").select("conv", "turn", F.explode(_units(F.col("_own"))).alias("unit"))
        found = save(_origins(originals, quotes), "origins")
        votes = found.groupBy("conv", "turn", "level", "origin").agg(F.count("*").alias("n"))
        replies = votes.groupBy("conv", "turn").agg(F.min_by("origin", F.struct("level", -F.col("n"), -F.col("origin"))).alias("reply_to"), F.sum("n").alias("n_linked"))
        counted = save(replies, "reply-counts")
        discard(messages.sparkSession, found)
        discard(messages.sparkSession, quotes)
        trees = _trees(counted).join(counted.select("conv", "turn", "n_linked"), ["conv", "turn"])
        trees = trees.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), "n_linked", "reply_to", "thread", "depth")
        joined = told.join(trees, (F.col(conv_col) == F.col("_c")) & (F.col(turn_col).cast("long") == F.col("_t")), "left")
        linked = joined.select(*own, "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to", F.coalesce("thread", F.col(turn_col).cast("long")).alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))
    return linked.orderBy(conv_col, "thread", turn_col)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))
