"""Chat formatting by quotation linking (DataFrame functions only).

Quote levels are the number of ``>`` marks that begin a line, at any nesting. Consecutive
lines of one level are a passage; its text, with marks gone, white space collapsed and case
folded, is hashed whole and sentence by sentence (a sentence ends with its line, or where
``.``, ``!`` or ``?`` stands before white space). Every message of a conversation with
quotations is indexed by the hashes of its own lines, of its paragraphs, of its whole text
without quotes, and of its sentences with their positions. Of each distinct passage the sentence
that is rarest in the conversation is looked up first; where it stands, the others must follow
and precede it at the same distances. The original of a quotation is the earliest message of the
conversation that has the passage. So any run of whole lines or sentences is found, at a cost
that follows the length of messages and of passages, not their product, and a paragraph or
message also where its lines are broken anew; less than a sentence is not looked for. A message
replies to the original of its outermost linked quotation (of the first of several).

Threads and depths come from pointer doubling along replies. The place of a message in its
thread is its place in reply order: a message, then its replies by turn, each followed by what
replies to it in turn. It comes from ranking the list of steps down and up the thread, again
by doubling, so no thread, however long, is ever gathered; messages by (conv_id, thread,
position) are the conversation in reply order, without quotes.

Defined results: null text counts as empty; a message that quotes nothing, or only what is
in no earlier message, begins a thread of its own; a quotation that stands in several
earlier messages links to the earliest; rows that repeat (conv_id, turn) share one reply
link, the smallest, and one position; rows with a null conv_id or turn link to nothing;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: The marks at the beginning of a quoted line.
MARKS = r"^[ \t]*+(?:>[ \t]*+)++"


def folded(text: Column) -> Column:
    """White space collapsed, ends stripped, case folded."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s++", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lines: array of (level, text without marks)."""
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = lambda x: F.regexp_extract(x, MARKS, 0)
    lines = F.transform(F.split("text", "\r?\n", -1), lambda x: F.struct((F.char_length(marks(x)) - F.char_length(F.replace(marks(x), F.lit(">"), F.lit("")))).alias("level"), F.regexp_replace(x, MARKS, "").alias("text")))
    return base.withColumn("lines", lines)


def own_text(lines: Column) -> Column:
    """The message without quotes: lines of level 0, ends stripped."""
    return F.trim(F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["text"]), "\n"))


def passages(lines: Column) -> Column:
    """Runs of quoted lines of one level: array of (level, text), in order."""
    level = lambda i: F.get(lines, i)["level"]
    begins = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))

    def runs(at: Column) -> Column:  # at: where runs begin, computed once
        upto = lambda j: F.coalesce(F.get(at, j + 1), F.size(lines))
        run = lambda i, j: F.array_join(F.transform(F.slice(lines, i + 1, upto(j) - i), lambda x: x["text"]), "\n")
        return F.transform(at, lambda i, j: F.struct(level(i).alias("level"), F.when(level(i) > 0, run(i, j)).otherwise("").alias("text")))

    every = F.get(F.transform(F.array(begins), runs), 0)
    return F.filter(every, lambda p: (p["level"] > 0) & (F.char_length(folded(p["text"])) > 0))


def _hash(text: Column) -> Column:
    return F.unhex(F.md5(folded(text)))


def sentences(text: Column) -> Column:
    """The sentences in order, folded, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\r?\n|(?<=[.!?])[ \t]+|(?<=[。！？])"), folded), lambda x: F.char_length(x) > 0)


def _marks(run: Column) -> Column:
    """The hash of every sentence."""
    return F.transform(run, lambda x: F.unhex(F.md5(x)))


def runs_found(runs: DataFrame, index: DataFrame) -> DataFrame:
    """conv_id, run_hash, by_run: the earliest message that holds the run of sentences.

    runs: conv_id, run_hash (distinct), marks; index: conv_id, turn, row (rows that share a turn are told apart), i, mark.
    """
    counts = materialise(index.groupBy("conv_id", "mark").agg(F.count(F.lit(1)).alias("times")), "sentence-counts")
    steps = materialise(runs.select("conv_id", "run_hash", F.size("marks").alias("k"), F.posexplode("marks").alias("j", "mark")), "run-sentences")
    rarest = steps.join(counts, ["conv_id", "mark"]).groupBy("conv_id", "run_hash", "k").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("times", "j", "mark")).alias("rarest"))
    anchors = materialise(rarest.filter("known = k").select("conv_id", "run_hash", "k", "rarest.j", "rarest.mark"), "anchors")
    near = materialise(anchors.join(index, ["conv_id", "mark"]).select("conv_id", "run_hash", "k", "turn", "row", (F.col("i") - F.col("j")).alias("start")).filter("start >= 0"), "run-starts")
    place = near.filter("k > 1").join(steps.drop("k"), ["conv_id", "run_hash"]).withColumn("i", F.col("start") + F.col("j"))
    met = place.join(index, ["conv_id", "turn", "row", "i", "mark"]).groupBy("conv_id", "run_hash", "k", "turn", "row", "start").agg(F.count_distinct("j").alias("met")).filter("met = k")
    whole = near.filter("k = 1").select("conv_id", "run_hash", "turn").unionByName(met.select("conv_id", "run_hash", "turn"))
    return whole.groupBy("conv_id", "run_hash").agg(F.min("turn").alias("by_run"))


def quotations(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, pos, original: every passage, with the earliest earlier message that has it (null: none)."""
    own = own_text(F.col("lines"))
    units = F.array_distinct(F.concat(F.array(own), F.split(own, r"\n\s*\n"), F.split(own, "\n")))
    quoted = rows.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode(passages(F.col("lines"))).alias("pos", "p"))
    quoted = quoted.select("conv_id", "turn", "pos", F.col("p.level").alias("level"), _hash(F.col("p.text")).alias("hash"), _marks(sentences(F.col("p.text"))).alias("marks"))
    quoted = materialise(quoted.withColumn("run_hash", F.unhex(F.md5(F.array_join(F.transform("marks", F.hex), "")))), "passages")
    quoting = materialise(quoted.select(F.col("conv_id").alias("q_conv")).distinct(), "quoting")
    asked = rows.filter("turn is not null").join(quoting, rows.conv_id == quoting.q_conv, "left_semi")  # only conversations with quotations
    whole = asked.select("conv_id", "turn", F.explode(units).alias("unit")).filter(F.char_length(folded(F.col("unit"))) > 0).groupBy("conv_id", _hash(F.col("unit")).alias("hash")).agg(F.min("turn").alias("by_whole"))
    index = materialise(asked.select("conv_id", "turn", F.xxhash64("text").alias("row"), F.posexplode(_marks(sentences(own))).alias("i", "mark")), "sentences")
    in_runs = runs_found(quoted.groupBy("conv_id", "run_hash").agg(F.any_value("marks").alias("marks")).filter("size(marks) > 0"), index)
    original = F.least("by_whole", "by_run")
    # The indices are written first, so that the join can split passages that many messages quote.
    found = quoted.join(materialise(whole, "whole-units"), ["conv_id", "hash"], "left").join(materialise(in_runs, "sentence-runs"), ["conv_id", "run_hash"], "left")
    return found.select("conv_id", "turn", "level", "pos", F.when(original < F.col("turn"), original).alias("original"))


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content (no quotes), reply_to, thread, depth, position, n_quotes, n_linked; one row per message."""
    rows = materialise(parsed(messages), "messages")
    links = materialise(quotations(rows), "quotations")
    replies = (
        links.groupBy("conv_id", "turn")
        .agg(F.min(F.when(F.col("original").isNotNull(), F.struct("level", "pos", "original"))).alias("first"), F.count(F.lit(1)).alias("n_quotes"), F.count("original").alias("n_linked"))
        .select("conv_id", "turn", F.col("first.original").alias("reply_to"), "n_quotes", "n_linked")
    )
    replies = materialise(replies, "replies")
    placed = placed_in_threads(replies.select("conv_id", "turn", "reply_to").filter("reply_to is not null"))
    by_turn = lambda df, of: (rows.conv_id == df[f"{of}_conv"]) & (rows.turn == df[f"{of}_turn"])
    named = replies.select(F.col("conv_id").alias("r_conv"), F.col("turn").alias("r_turn"), "reply_to", "n_quotes", "n_linked")
    out = rows.join(named, by_turn(named, "r"), "left").join(placed, by_turn(placed, "p"), "left")
    none = F.lit(0).cast("long")
    return out.select("conv_id", "turn", "role", own_text(F.col("lines")).alias("content"), "reply_to", F.coalesce("thread", "turn").alias("thread"), *(F.coalesce(c, none).alias(c) for c in ("depth", "position", "n_quotes", "n_linked")))


def placed_in_threads(replies: DataFrame) -> DataFrame:
    """p_conv, p_turn, thread, depth, position of every message that replies or is replied to; replies: conv_id, turn, reply_to (no nulls)."""
    if replies.isEmpty():
        return replies.select(F.col("conv_id").alias("p_conv"), F.col("turn").alias("p_turn"), F.col("turn").alias("thread"), *(F.lit(0).cast("long").alias(c) for c in ("depth", "position")))
    at = replies.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("steps"))
    moving = True
    while moving:  # as many rounds as the logarithm of the depth
        over = at.select(F.col("conv_id").alias("o_conv"), F.col("turn").alias("o_turn"), F.col("up").alias("o_up"), F.col("steps").alias("o_steps"))
        up = at.join(over, (at.conv_id == over.o_conv) & (at.up == over.o_turn), "left")
        further = materialise(up.select("conv_id", "turn", F.coalesce("o_up", "up").alias("up"), (F.col("steps") + F.coalesce("o_steps", F.lit(0))).alias("steps"), F.col("o_up").isNotNull().alias("moved")), "threads")
        at, moving = further.drop("moved"), not further.filter("moved").isEmpty()
    roots = at.select("conv_id", F.col("up").alias("turn")).distinct().select("conv_id", "turn", F.col("turn").alias("up"), F.lit(0).cast("long").alias("steps"))
    members = materialise(at.unionByName(roots), "thread-members")
    rank = ranks(replies)
    named = lambda of: rank.select(F.col("conv_id").alias(f"{of}_conv"), F.col("turn").alias(f"{of}_turn"), F.col("rank").alias(f"{of}_rank"))
    own, top = named("own"), named("top")
    out = members.join(own, (members.conv_id == own.own_conv) & (members.turn == own.own_turn)).join(top, (members.conv_id == top.top_conv) & (members.up == top.top_turn))
    return out.select(F.col("conv_id").alias("p_conv"), F.col("turn").alias("p_turn"), F.col("up").alias("thread"), F.col("steps").alias("depth"), (F.col("top_rank") - F.col("own_rank")).alias("position"))


def ranks(replies: DataFrame) -> DataFrame:
    """conv_id, turn, rank: how many messages of its thread come from a message on, in reply order.

    Every message has two steps, down to it and back up from it, each followed by one other. The rank of a step is the
    number of steps down from it to the end of its thread; doubling adds them up along the list.
    """
    step = lambda turn, up: F.struct(turn.alias("turn"), F.lit(up).alias("up"))
    turn, parent, none = F.col("turn"), F.col("reply_to"), F.lit(None).cast("struct<turn:bigint,up:int>")
    weight = lambda n: F.lit(n).cast("long").alias("rank")
    first = materialise(replies.groupBy("conv_id", parent.alias("turn")).agg(F.min("turn").alias("child")), "first-replies")
    nodes = replies.select("conv_id", "turn").union(first.select("conv_id", "turn")).distinct()
    down = nodes.join(first, ["conv_id", "turn"], "left").select("conv_id", step(turn, 0).alias("step"), F.when(F.col("child").isNotNull(), step(F.col("child"), 0)).otherwise(step(turn, 1)).alias("next"), weight(1))
    up = next_sibling(replies).select("conv_id", step(turn, 1).alias("step"), F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), 0)).otherwise(step(parent, 1)).alias("next"), weight(0))
    ends = first.join(replies.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").select("conv_id", step(turn, 1).alias("step"), none.alias("next"), weight(0))
    at = materialise(down.unionByName(up).unionByName(ends), "steps")
    while not at.filter("next is not null").isEmpty():
        over = at.select(F.col("conv_id").alias("o_conv"), F.col("step").alias("o_step"), F.col("next").alias("o_next"), F.col("rank").alias("o_rank"))
        further = at.join(over, (at.conv_id == over.o_conv) & (at.next == over.o_step), "left")
        at = materialise(further.select("conv_id", "step", F.col("o_next").alias("next"), (F.col("rank") + F.coalesce("o_rank", F.lit(0))).alias("rank")), "steps")
    return at.filter("step.up = 0").select("conv_id", F.col("step.turn").alias("turn"), "rank")


def next_sibling(replies: DataFrame) -> DataFrame:
    """replies with sibling: the next reply, by turn, to the same message.

    Replies are dealt out by range, so that those to one message may lie in many partitions; what follows the last of
    a partition is the first of the next that holds a reply to the same message.
    """
    n = int(replies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(replies.select("conv_id", "turn", "reply_to").repartitionByRange(n, "conv_id", "reply_to", "turn").withColumn("part", F.spark_partition_id()), "ranged-replies")
    of_message = Window.partitionBy("conv_id", "reply_to").orderBy("part")
    firsts = ranged.groupBy("conv_id", "reply_to", "part").agg(F.min("turn").alias("first")).withColumn("later", F.lead("first").over(of_message)).drop("first")  # a row for each partition at most
    within = ranged.withColumn("sibling", F.lead("turn").over(Window.partitionBy("conv_id", "reply_to", "part").orderBy("turn")))
    return within.join(firsts, ["conv_id", "reply_to", "part"]).select("conv_id", "turn", "reply_to", F.coalesce("sibling", "later").alias("sibling"))


def chat_rows(messages: DataFrame, id_open: str = "<|", id_close: str = "|>") -> DataFrame:
    """``linked`` plus formatted: the message as one turn of a chat template."""
    role = F.coalesce("role", F.lit("user"))
    return linked(messages).withColumn("formatted", F.concat(F.lit(id_open), role, F.lit(id_close), F.lit("\n"), "content"))
