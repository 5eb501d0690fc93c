"""Chat formatting in budgeted windows, DataFrame functions only.

A conversation's turns, in order, are cut into turn-aligned windows of at
most ``budget`` tokens.  Prefix sums of the turns' tokens decide the spans: a
window takes turns while the prefix at a turn's end minus the prefix at the
window's start stays within the room that is left after the repeated parts.
Every window after the first repeats the conversation's first system turn
and up to ``history_turns`` preceding turns (``history_tokens`` at most);
repeated turns come before the window's own and are outside the loss mask,
which covers exactly the texts of the window's own assistant turns.  A turn
longer than the room makes a window by itself.  No window exceeds the budget
but one of a single turn that alone is longer, which repeats nothing: a system
turn of more than half the budget is never repeated, any other not beside a
turn that leaves no room for it.

Template: ``<<SYS>>text<</SYS>>``, ``[INST]text[/INST]``, ``<s>text</s>`` for
system, user, assistant, ``[TURN role]text[/TURN]`` for any other role.  Inside
texts and roles ``\\ < [ ]`` become ``\\e \\l \\b \\c``, so a control string
never occurs in one and the text can be had back.

Scale: turns are taken in blocks of ``BLOCK`` turn numbers, so a conversation
of any length is spread over tasks; a block's turns are gathered in one row
(the only shuffle of texts) and its windows are made from that row with
array functions.  Only blocks of conversations that have several (found from
ids and turn numbers alone) meet earlier blocks, which hand on their last turns
and first system turn in one narrow row each.  A window never spans two blocks.

Rows: turns are ordered by (turn, role, text), nulls first; null role and text
are empty; null conv_ids form one conversation; repeated rows are repeated
turns; empty turns cost ``OVERHEAD`` tokens like any other, so windows stay
bounded; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspark.llm.common import table
from clickspark.staging import stage_table

#: Tokens of a window, repeated turns, their tokens; turn numbers of a block.
BUDGET, HISTORY_TURNS, HISTORY_TOKENS, BLOCK = 512, 2, 128, 512
#: A token is a word or a mark; each turn costs this many more.
TOKEN, OVERHEAD = r"\w+|[^\w\s]", 4

#: Fixed values of the template: role -> control strings; escapes.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\c"))
#: Ids of conversations with several blocks that may be broadcast.
SEVERAL = 500_000
_TURN = r"(<<SYS>>|\[INST\]|<s>|\[TURN [^\]]*\])([^<\[]*)"


def escape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c)


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), ESCAPES[::-1], c)


def _by_role(role: Column, side: int, other: Column) -> Column:
    c = F
    for name, marks in MARKS.items():
        c = c.when(role == name, F.lit(marks[side]))
    return c.otherwise(other)


def opening(role: Column) -> Column:
    return _by_role(role, 0, F.concat(F.lit("[TURN "), escape(role), F.lit("]")))


def closing(role: Column) -> Column:
    return _by_role(role, 1, F.lit("[/TURN]"))


def role_of(mark: Column) -> Column:
    """The role that an opening control string stands for."""
    c = F
    for name, (start, _) in MARKS.items():
        c = c.when(mark == start, F.lit(name))
    return c.otherwise(unescape(F.substring(mark, F.lit(7), F.length(mark) - 7)))


def _block_of(block: int) -> Column:
    return F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long")


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block: ``p``, its turns in order as
    (i from 1, token prefix in the block, tok, role, text)."""
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("b", _block_of(block))
    t = t.withColumn("tok", F.regexp_count("text", F.lit(TOKEN)).cast("long") + OVERHEAD)
    order = Window.partitionBy("conv_id", "b").orderBy("turn", "role", "text")
    so_far = F.sum("tok").over(order.rowsBetween(Window.unboundedPreceding, 0))
    x = F.struct(F.row_number().over(order).alias("i"), (so_far - F.col("tok")).alias("pre"), "tok", "role", "text")
    return t.select("conv_id", "b", x.alias("x")).groupBy("conv_id", "b").agg(
        F.array_sort(F.collect_list("x")).alias("p"))


def _first_system(p: Column) -> Column:
    return F.get(F.filter(p, lambda x: x["role"] == "system"), F.lit(0))


def _earlier(blocks: DataFrame, history_turns: int) -> DataFrame:
    """For blocks of conversations with several: what the earlier blocks leave,
    ``prev`` (their last turns) and ``old`` (their first system turn).  One
    narrow row per block."""
    mine = blocks.select(
        "conv_id", "b", F.slice("p", -F.least(F.lit(max(1, history_turns)), F.size("p")), max(1, history_turns)).alias("tail"),
        _first_system(F.col("p")).alias("system"))
    w = Window.partitionBy("conv_id").orderBy("b")
    return mine.select(
        F.col("conv_id").alias("ec"), F.col("b").alias("eb"),
        F.flatten(F.collect_list("tail").over(w.rowsBetween(-max(1, history_turns), -1))).alias("prev"),
        F.first("system", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("old"))


def chat_windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS,
                 history_tokens: int = HISTORY_TOKENS, block: int = BLOCK) -> DataFrame:
    """One row per window: conv_id, block, window, n_tokens, formatted,
    repeated (number of leading turns that are repeats), n_turns, and
    loss_spans, array of (start, end) code points of ``formatted``."""
    blocks = stage_table(_blocks(turns, block))  # texts are shuffled once; the rest is per row
    here = _first_system(F.col("p"))
    alone = lambda x: x.select("conv_id", "b", "p", F.get(F.slice("p", 1, 0), F.lit(0)).alias("old"),
                               F.slice("p", 1, 0).alias("prev"), here.alias("here"))
    several = stage_table(turns.select("conv_id", _block_of(block).alias("b")).groupBy("conv_id").agg(
        F.min("b").alias("x"), F.max("b").alias("y")).where("x < y").select(F.col("conv_id").alias("mc")))
    n = several.count()
    if n == 0:
        d = alone(blocks)
    else:
        several = F.broadcast(several) if n <= SEVERAL else several
        known = F.col("conv_id").eqNullSafe(F.col("mc"))
        many = blocks.join(several, known, "left_semi")
        met = many.join(_earlier(many, history_turns), F.col("conv_id").eqNullSafe(F.col("ec")) & (F.col("b") == F.col("eb")))
        d = alone(blocks.join(several, known, "left_anti")).unionByName(
            met.select("conv_id", "b", "p", "old", F.coalesce("prev", F.slice("p", 1, 0)).alias("prev"), here.alias("here")))
    system_tokens = F.coalesce(F.col("old.tok"), F.col("here.tok"), F.lit(0))
    d = d.withColumn("room", F.lit(budget - history_tokens)
                     - F.when(system_tokens <= budget // 2, system_tokens).otherwise(0))

    def take(s: Column, x: Column) -> Column:
        first = F.element_at(s, -1)
        # nothing is repeated in a conversation's first window
        free = F.when((first["i"] == 1) & (F.size("prev") == 0), F.lit(budget)).otherwise(F.col("room"))
        full = (x["pre"] + x["tok"] - first["pre"] > free) & (x["pre"] > first["pre"])
        return F.when(full, F.concat(s, F.array(F.struct(x["i"].alias("i"), x["pre"].alias("pre"))))).otherwise(s)

    one = F.get(F.col("p"), F.lit(0))
    tail = F.element_at("p", -1)
    d = d.withColumn("starts", F.aggregate("p", F.array(F.struct(one["i"].alias("i"), one["pre"].alias("pre"))), take))
    stop = F.array(F.struct((tail["i"] + 1).alias("i"), (tail["pre"] + tail["tok"]).alias("pre")))
    d = d.withColumn("stops", F.concat(F.slice("starts", 2, F.size("starts")), stop))
    d = d.select("*", F.posexplode(F.arrays_zip("starts", "stops")).alias("w", "span"))
    start, end = F.col("span.starts"), F.col("span.stops")
    d = d.withColumn("own", F.slice("p", start["i"], end["i"] - start["i"]))
    d = d.withColumn("system", F.when(F.col("old").isNotNull(), F.col("old"))
                     .when(F.col("here.i") < start["i"], F.col("here")))
    fits = F.col("system.tok") <= F.least(F.lit(budget // 2), F.lit(budget) - (end["pre"] - start["pre"]))
    d = d.withColumn("system", F.when(fits, F.col("system")))

    # repeated turns, nearest first, while they fit; a window that one long turn fills has none
    limit = F.least(F.lit(history_tokens), F.lit(budget) - F.coalesce(F.col("system.tok"), F.lit(0))
                    - (end["pre"] - start["pre"]))
    before = F.concat("prev", F.slice("p", F.lit(1), start["i"] - 1))
    keep = F.least(F.lit(history_turns), F.size(before))
    near = F.when(keep > 0, F.slice(before, -F.greatest(keep, F.lit(1)), F.greatest(keep, F.lit(1)))).otherwise(
        F.slice("p", 1, 0))
    near = F.filter(near, lambda x: ~F.coalesce(x.eqNullSafe(F.col("system")), F.lit(False)))
    d = d.withColumn("near", near).withColumn("limit", limit)
    none = F.struct(F.lit(0).cast("long").alias("sum"), F.slice("p", 1, 0).alias("kept"))
    d = d.withColumn("history", F.aggregate(
        F.reverse("near"), none,
        lambda s, x: F.struct((s["sum"] + x["tok"]).alias("sum"),
                              F.when(s["sum"] + x["tok"] <= F.col("limit"), F.concat(F.array(x), s["kept"]))
                              .otherwise(s["kept"]).alias("kept")))["kept"])

    def piece(own: bool):
        return lambda x: F.struct(
            F.lit(own).alias("own"), (F.lit(own) & (x["role"] == "assistant")).alias("loss"), x["tok"].alias("tok"),
            opening(x["role"]).alias("open"), escape(x["text"]).alias("body"), closing(x["role"]).alias("close"))

    repeated = F.concat(F.when(F.col("system").isNull(), F.slice("p", 1, 0)).otherwise(F.array("system")), F.col("history"))
    wins = d.select("conv_id", "b", "w", F.concat(F.transform(repeated, piece(False)),
                                                  F.transform("own", piece(True))).alias("turns"))

    def span(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["open"])
        end = start + F.length(x["body"])
        return F.struct((end + F.length(x["close"])).alias("at"),
                        F.when(x["loss"], F.concat(s["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))))
                        .otherwise(s["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))
    return wins.select(
        "conv_id", F.col("b").alias("block"), F.col("w").alias("window"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, x: s + x["tok"]).alias("n_tokens"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["open"], x["body"], x["close"])), "").alias("formatted"),
        F.size(F.filter("turns", lambda x: ~x["own"])).alias("repeated"), F.size("turns").alias("n_turns"),
        F.aggregate("turns", none, span)["spans"].alias("loss_spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """Windows -> conv_id, block, window, turns (array of (role, text) of the
    window's own turns) and loss (the texts under the mask), both unescaped."""
    parsed = windows.withColumn("marks", F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(1))).withColumn(
        "bodies", F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(2)))
    turns = F.zip_with("marks", "bodies", lambda m, b: F.struct(role_of(m).alias("role"), unescape(b).alias("text")))
    return parsed.select(
        "conv_id", "block", "window", F.length("formatted").alias("chars"),
        F.slice(turns, F.col("repeated") + 1, F.greatest(F.size("marks") - F.col("repeated"), F.lit(0))).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(
            F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))).alias("loss"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every conversation and conversation -7, formatted and read back."""
    said = r"'</s>[INST] ok [/INST]'"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) "
                      "AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    back = read_back(chat_windows(turns))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = back.select("conv_id", F.struct("block", "window", line.alias("line"), F.array_join("loss", "").alias("loss"))
                      .alias("x"), F.size("turns").alias("n"), "chars")
    g = per.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list("x")).alias("x"))

    def joined(name: str) -> Column:
        return F.array_join(F.transform("x", lambda x: x[name]), "")

    return g.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"),
                    F.sha2(joined("line"), 256).alias("turns_sha256"),
                    F.length(joined("loss")).cast("long").alias("loss_chars"),
                    F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars")
