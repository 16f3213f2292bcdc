"""Quotation linking (operator 9, DataFrame functions only).

A message is read line by line: leading ``>`` marks (blanks between them allowed)
give a line's quote level. A run of lines of one level is a passage; its text is
lower-cased, white space runs become one blank, and the result is hashed. A quoted
passage is joined, inside its conversation, to the earlier messages whose own words
(level 0) contain it as their whole text, as a run or as a line; the single lines of
a quoted passage are joined likewise. The reply's original is the latest earlier
message matched at the lowest quote level, by a whole passage before a single line.
Threads then are the trees of these links: ``root`` and ``depth`` come from pointer
doubling, and (root, depth, turn) puts every reply behind its original.

``own_text`` is the message without its linked quotes: a linked passage goes whole, and
of other passages the linked lines go, with the empty marked lines behind them. A marked
line that no earlier message holds was typed by the writer and stays as it is.

A message is a (conv_id, turn); rows that repeat it are versions of one message
and share its links. Nulls and odd input: a null text is empty; rows with a null
conversation or turn keep their row and whole text, link to nothing and have depth 0;
empty passages are not linked; an empty table gives an empty result. Columns other
than those named are ignored.

Scale: lines are parsed inside the row and only their hashes are exploded, once. The
hashes are keyed by (conversation, hash, block of turns), the latest mark of earlier
blocks is carried in by a row per block, so neither a conversation with a third of all
rows nor a line repeated through it is one task. Positions are numbered over ranges of
narrow rows; texts are shuffled once, by a unique row number. Nothing is collected but
a row count per doubling round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalframe.functions.bind import bind
from vocalframe.llm.store import keep

MARKS = r"^((?:[ \t]*>)*)"

#: Turns of one conversation in a block; blocks of one (conversation, hash) are separate keys.
TURNS = 4096


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def hashed(c: Column) -> Column:
    """128 bits of the normalised passage; null when nothing is left."""
    n = normalised(c)
    return F.when(n != "", F.unhex(F.md5(n)))


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``lines`` (level, line without its marks, the line as typed), ``runs`` (start, n, level: the
    passages) and ``parts`` (the same for each line with words and the empty lines behind it)."""
    def line(x: Column) -> Column:
        marks = F.regexp_replace(F.regexp_extract(x, MARKS, 1), r"[ \t]", "")
        return F.struct(F.length(marks).alias("level"), F.regexp_replace(x, MARKS + r"(?<=>) ?", "").alias("line"), x.alias("raw"))

    def changes(i: Column) -> Column:
        return (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"])

    def spans(starts: str) -> Column:
        end = lambda k: F.coalesce(F.get(starts, k + 1), F.size("lines"))
        return F.transform(starts, lambda i, k: F.struct(i.alias("start"), (end(k) - i).alias("n"), F.get("lines", i)["level"].alias("level")))

    got = bind(messages, {"lines": F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n"), line)})
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    got = bind(got, {"_runs": F.filter(every, changes),
                     "_parts": F.filter(every, lambda i: changes(i) | F.get("lines", i)["line"].rlike(r"\S"))})
    return bind(got, {"runs": spans("_runs"), "parts": spans("_parts")}, drop=("_runs", "_parts"))


def passage_hashes(m: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, h, level, part, start, n): a row per hash of a message. A null ``level``
    marks the message's own words; ``part`` is 0 for whole quoted passages and 1 for their lines."""
    p = parsed(m.select("conv_id", "turn", "tie", "text"))
    body = lambda r: F.array_join(F.slice("lines", r["start"] + 1, r["n"])["line"], "\n")
    none = F.lit(None).cast("int")

    def mark(h: Column) -> Column:
        return F.struct(h.alias("h"), none.alias("level"), none.alias("part"), none.alias("start"), none.alias("n"))

    def ask(h: Column, part: int, r: Column) -> Column:
        return F.struct(h.alias("h"), r["level"].alias("level"), F.lit(part).alias("part"), r["start"].alias("start"), r["n"].alias("n"))

    own = F.filter("lines", lambda x: x["level"] == 0)
    first = lambda r: F.get("lines", r["start"])["line"]
    entries = F.concat(
        F.array(mark(hashed(F.array_join(own["line"], "\n")))),
        F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: mark(hashed(body(r)))),
        F.transform(own, lambda x: mark(hashed(x["line"]))),
        F.transform(F.filter("runs", lambda r: r["level"] > 0), lambda r: ask(hashed(body(r)), 0, r)),
        F.transform(F.filter("parts", lambda r: r["level"] > 0), lambda r: ask(hashed(first(r)), 1, r)))
    return p.select("conv_id", "turn", "tie", F.inline(F.array_distinct(entries))).where("h is not null").distinct()


def originals(hashes: DataFrame) -> DataFrame:
    """The quoted rows of ``hashes`` with ``found``, the latest earlier turn that holds the hash."""
    rows = keep(hashes.withColumn("block", F.floor(F.col("turn") / TURNS))
                .withColumn("at", F.when(F.col("level").isNull(), F.col("turn"))))
    near = Window.partitionBy("conv_id", "h", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    # a row per (conversation, hash, block); only hashes in several blocks have anything to carry
    blocks = rows.groupBy("conv_id", "h", "block").agg(F.max("at").alias("at"))
    earlier = Window.partitionBy("conv_id", "h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("carried", F.max("at").over(earlier)).where("carried is not null").drop("at")
    return (rows.withColumn("near", F.max("at").over(near)).where("level is not null")
            .join(carried, ["conv_id", "h", "block"], "left")
            .withColumn("found", F.coalesce("near", "carried")).where("found is not null")
            .select("conv_id", "turn", "tie", "level", "part", "start", "n", "found"))


def link_quotes(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """(conv_id, turn, role, own_text, quote_levels, n_quotes, reply_to, root, depth, position)."""
    m = keep(messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                             F.col(text).alias("text"), F.xxhash64(role, text).alias("tie"))
             .withColumn("row", F.monotonically_increasing_id()))
    keyed = m.where("conv_id is not null and turn is not null")
    # per version of a message: its best link and the lines that go, no more than the version has
    links = keep(originals(passage_hashes(keyed)).groupBy("conv_id", "turn", "tie").agg(
        F.min(F.struct("level", "part", (-F.col("found")).alias("neg"))).alias("b"),
        F.collect_list(F.struct("start", "n")).alias("linked")))
    best = links.groupBy("conv_id", "turn").agg(F.min("b").alias("b")).select("conv_id", "turn", (-F.col("b.neg")).alias("reply_to"))
    nodes = threads(keyed.select("conv_id", "turn").distinct(), best)
    facts = (m.select("conv_id", "turn", "tie", "row").join(nodes, ["conv_id", "turn"], "left")
             .withColumn("root", F.coalesce("root", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)).cast("int")))
    placed = numbered(facts).join(links.select("conv_id", "turn", "tie", "linked"), ["conv_id", "turn", "tie"], "left")
    out = parsed(m.select("row", "role", "text").join(placed, "row"))
    gone = F.flatten(F.transform(F.coalesce("linked", F.array()), lambda p: F.sequence(p["start"], p["start"] + p["n"] - 1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    own = F.array_join(F.transform(stay, lambda i: F.get("lines", i)["raw"]), "\n")
    return out.select(
        "conv_id", "turn", "role", F.trim(own).alias("own_text"), F.array_max(F.col("runs")["level"]).cast("int").alias("quote_levels"),
        F.size(F.filter("runs", lambda r: r["level"] > 0)).alias("n_quotes"), "reply_to", "root", "depth", "position")


def threads(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, root, depth). After k rounds an active node's ``up`` is ``2^k``
    links up; a node whose ``up`` knows its root is done and leaves the rounds."""
    start = keep(nodes.join(links.select("conv_id", "turn", "reply_to"), ["conv_id", "turn"], "left"))
    cols = ["conv_id", "turn", "reply_to", "up", "depth"]
    done = start.where("reply_to is null").select("conv_id", "turn", "reply_to", F.col("turn").alias("up"), F.lit(0).alias("depth"))
    active = start.where("reply_to is not null").select("conv_id", "turn", "reply_to", F.col("reply_to").alias("up"), F.lit(1).alias("depth"))
    while active.limit(1).count():
        over = (done.withColumn("rooted", F.lit(True)).unionByName(active.withColumn("rooted", F.lit(False)))
                .select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("depth").alias("d2"), "rooted"))
        step = keep(active.join(over, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t"))).select(
            "conv_id", "turn", "reply_to", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), "rooted"))
        done, active = done.unionByName(step.where("rooted").select(*cols)), step.where("not rooted").select(*cols)
    return done.select("conv_id", "turn", "reply_to", F.col("up").alias("root"), "depth")


def numbered(rows: DataFrame) -> DataFrame:
    """``position`` of each row in its conversation in (root, depth, turn) order, numbered over
    ranges, so a long conversation is cut like any other part of the table."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "root", "depth", "turn", "tie", "row"]
    kept = keep(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part", "conv_id").orderBy("root", "depth", "turn", "tie", "row")
    local = kept.withColumn("_k", F.row_number().over(w) - 1)
    # one row per range and conversation; a conversation has at most as many as there are ranges
    counts = kept.groupBy("part", "conv_id").count()
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("part").alias("_p"), F.col("conv_id").alias("_c"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    out = local.join(starts, (F.col("part") == F.col("_p")) & F.col("conv_id").eqNullSafe(F.col("_c")))
    return out.withColumn("position", (F.col("_k") + F.col("_off")).cast("bigint")).drop("part", "_k", "_p", "_c", "_off")


def quoting_thread(messages: DataFrame) -> DataFrame:
    """The conversation table as a mail thread: each message quotes the one before it
    (``> ``) and the one before that (``>> ``), as clients do. Where rows repeat a
    (conv_id, turn), the least text stands for it."""
    one = messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(
        F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def back(k: int, mark: str, name: str) -> DataFrame:
        body = F.regexp_replace(F.col("text"), r"(?m)^", mark)
        return one.select(F.col("conv_id").alias(f"c{k}"), (F.col("turn") + k).alias(f"t{k}"), body.alias(name))
    a, b = back(1, "> ", "q1"), back(2, ">> ", "q2")
    j = (messages.join(a, (F.col("conv_id") == F.col("c1")) & (F.col("turn") == F.col("t1")), "left")
         .join(b, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")), "left"))
    return j.select("conv_id", "turn", "role", F.concat_ws("\n", "q2", "q1", F.coalesce("text", F.lit(""))).alias("text"))
