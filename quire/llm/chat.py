"""Chat formatting in budgeted windows, in DataFrame functions alone.

A window has a budget of tokens, which its own turns, the repeated system turn and the repeated history share: history
may take `history` of it, the system turn what it needs, and the rest is the room for the window's own turns. Prefix
sums of the turns' tokens choose the spans: a turn belongs to the block of `room` tokens in which it starts, and the
one turn that runs over the block's end has a window to itself. Windows are cut between turns, so only a turn that is
too long alone makes a window that exceeds the budget, and that window has no history unless there is room for it.
An assistant turn is a target in one window, its own; repeats are masked.

The template is <|turn|>role\\ntext<|end|>\\n. Control strings inside a text or role get an escape sign behind their
first character, and the sign itself is escaped, so every text can be read back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's marks, and the strings of usual templates that a text must not hold as they are.
TURN, END = "<|turn|>", "<|end|>"
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|<?/?SYS>)"
SIGN = "␛"
#: Turns that are summed together before the sums of a conversation are.
SEGMENT = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(SIGN), F.lit(SIGN + "0")), CONTROL, "$1" + SIGN + "1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(SIGN + "1"), F.lit("")), F.lit(SIGN + "0"), F.lit(SIGN))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(SIGN + "2"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(SIGN + "2"), F.lit("\n")))


def tokens(text: Column) -> Column:
    """A tokenizer-free count: words, digits, runs of other signs and newlines; the template adds 4."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"\p{L}{1,6}|\p{N}{1,3}|[^\p{L}\p{N}\s]{1,3}|\n")), F.lit(0)) + 4).cast("long")


def windows(turns: DataFrame, budget: int = 480, history: int = 96, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, window, text, loss, n_turns, n_repeats, n_tokens): the formatted windows of every conversation.

    loss: (start, length) of each target in the window's text, in code points. n_repeats: how many turns at its begin
    are repeats (the system turn and history). A null text or role counts as empty; a null turn comes first; rows
    with the same turn are ordered by role and text and are turns each; rows with a null conv_id form one conversation;
    a conversation's system turn is its first row of that role, if it has one. A system turn of more than half of the
    budget is not repeated: it stands in its own window alone, whole. history must be under half of the budget. An
    empty table gives no windows; other columns are dropped.
    """
    if not 0 <= history < budget / 2:
        raise ValueError("history must be under half of the budget")
    t = turns.select(turns[conv_id].alias("conv_id"), turns[turn].cast("long").alias("turn"), F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"), F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("size", tokens(F.col("text"))).withColumn("segment", F.floor(F.coalesce("turn", F.lit(-(2**62))) / SEGMENT))
    # prefix sums in two steps: a long conversation is summed by segments first
    sums = t.groupBy("conv_id", "segment").agg(F.sum("size").alias("sum"), F.count("*").alias("rows"), F.min(F.when(F.col("role") == "system", F.struct("turn", "text", "size"))).alias("system"))
    by = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("conv_id")
    base = sums.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), F.coalesce(F.sum("sum").over(by), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(by), F.lit(0)).alias("base_rows"), F.min("system").over(all_).alias("system"))
    # a system turn that would leave less than half of the budget stays where it is
    base = base.withColumn("system", F.when(F.col("system.size") <= budget / 2, F.col("system")))
    base = base.withColumn("room", F.lit(budget - history) - F.coalesce("system.size", F.lit(0)))
    t = t.join(base, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))).drop("c", "s")
    inside = Window.partitionBy("conv_id", "segment").orderBy("turn", "role", "text")
    t = t.withColumn("end", F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.col("base_rows") + F.row_number().over(inside))
    t = t.withColumn("start", F.col("end") - F.col("size")).withColumn("block", F.floor(F.col("start") / F.col("room")).cast("long"))
    t = t.withColumn("over", ((F.col("end") > (F.col("block") + 1) * F.col("room")) & (F.col("start") > F.col("block") * F.col("room"))).cast("int")).withColumn("key", F.col("block") * 2 + F.col("over"))
    own = t.select("conv_id", "key", "at", "turn", "role", "text", "size", "start", F.lit(False).alias("repeat"), "system")
    heads = t.groupBy("conv_id", "key").agg(F.min("start").alias("first"), F.sum("size").alias("own"), F.first("room").alias("room"))
    # history: at most `history` tokens, and what the room leaves if one turn fills it, start in the block before or the window's own
    back = F.least(F.lit(history), F.greatest(F.lit(0), F.col("room") + history - F.col("own")))
    block = F.floor(F.col("first") / F.col("room"))
    later = heads.select(F.col("conv_id").alias("c"), "key", "first", back.alias("back"), F.explode(F.array(block, block - 1)).alias("b"))
    past = t.join(later.withColumnRenamed("key", "k2"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).filter((F.col("end") <= F.col("first")) & (F.col("start") >= F.col("first") - F.col("back")))
    past = past.filter(F.col("role") != "system").select("conv_id", F.col("k2").alias("key"), "at", "turn", "role", "text", "size", "start", F.lit(True).alias("repeat"), "system")
    rows = own.union(past).withColumn("line", F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n")))
    loss = F.when((F.col("role") == "assistant") & ~F.col("repeat"), F.length(escape(F.col("text"))))
    rows = rows.withColumn("skip", F.lit(len(TURN) + 1) + F.length(escape_role(F.col("role"))))
    each = rows.groupBy("conv_id", "key").agg(F.array_sort(F.collect_list(F.struct("at", "line", loss.alias("loss"), "skip", "repeat", "size"))).alias("rows"), F.first("system").alias("system"), F.min(F.when((F.col("role") == "system") & ~F.col("repeat"), F.struct("turn", "text"))).alias("own_system"))
    lead = F.col("system").isNotNull() & ~F.coalesce(F.col("own_system").eqNullSafe(F.struct("system.turn", "system.text")), F.lit(False)) & (F.col("key") > 0)
    front = F.when(lead, F.concat(F.lit(TURN + "system\n"), escape(F.col("system.text")), F.lit(END + "\n"))).otherwise("")
    kind = "struct<pos:long,spans:array<struct<start:long,length:long>>>"
    begin = F.struct(F.length(front).cast("long").alias("pos"), F.expr("cast(array() as array<struct<start:long,length:long>>)").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        span = F.struct((s["pos"] + x["skip"]).cast("long").alias("start"), x["loss"].cast("long").alias("length"))
        return F.struct((s["pos"] + F.length(x["line"])).cast("long").alias("pos"), F.when(x["loss"].isNotNull(), F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans")).cast(kind)

    spans = F.aggregate("rows", begin.cast(kind), step)["spans"]
    whole = F.concat(front, F.array_join(F.transform("rows", lambda x: x["line"]), ""))
    repeats = F.size(F.filter("rows", lambda x: x["repeat"])) + lead.cast("int")
    n_tokens = F.aggregate(F.transform("rows", lambda x: x["size"]), F.lit(0).cast("long"), lambda s, x: s + x) + F.when(lead, F.col("system.size")).otherwise(0)
    return each.select("conv_id", F.col("key").alias("window"), whole.alias("text"), spans.alias("loss"), (F.size("rows") + lead.cast("int")).alias("n_turns"), repeats.alias("n_repeats"), n_tokens.alias("n_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from windows() alone."""
    parts = F.split(F.col("text"), "<\\|turn\\|>")
    fresh = F.slice(parts, F.col("n_repeats") + 2, F.greatest(F.lit(0), F.size(parts) - F.col("n_repeats") - 1))
    role = lambda x: F.substring_index(x, "\n", 1)
    body = lambda x: F.substr(x, F.length(role(x)) + 2, F.length(x) - F.length(role(x)) - 1 - len(END) - 1)
    turns = F.transform(fresh, lambda x: F.concat(unescape_role(role(x)), F.lit("\n"), unescape(body(x)), F.lit("\n")))
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    each = formatted.select("conv_id", "window", F.size(fresh).alias("n"), F.array_join(turns, "").alias("turns"), F.array_join(learned, "").alias("learned"), F.length("text").alias("chars"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "learned"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    turns = F.array_join(F.transform("w", lambda x: x["turns"]), "")
    learned = F.array_join(F.transform("w", lambda x: x["learned"]), "")
    return whole.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
