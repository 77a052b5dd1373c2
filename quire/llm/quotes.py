"""Quotation linking: conversations in reply order, without quotes.

Lines that begin with quote marks (">") have the number of marks as level; runs
of lines of one level above 0 are quoted passages. Passages, their lines and their
sentences (over line breaks) are normalised and looked up among what other messages
say themselves: a message says its text, lines and sentences, and of RUN words or more
also any run of its words, wherever lines break. Of those that say it, it is
first the latest earlier message of the same conversation, else the first of all
messages that said it. A passage belongs to the message that most of its
characters point to; the first passage of level 1 that was found makes the reply.
Messages get their own text without quotes, the message they reply to, and their
place: thread (the conversation of the message the chain of replies starts with),
depth in that chain and number in the thread.

Defined results: a null text has an empty text of its own; quotes that nobody
said link to nothing; of fewer than RUN words a quote must be a whole text, line or sentence; a message never replies to itself or to a later one, so
there are no cycles; of rows that repeat conv_id and turn each is placed, and a
reply goes to the pair; null conv_ids or turns sort first and are never replied
to; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .staging import Stage

#: Turns in one part of a thread, for numbering without gathering a thread.
SPAN = 256
MAX_ROUNDS = 64
#: Words of a quote that are looked for anywhere in a message.
RUN = 5

_MARKS = r"^(?:[ \t]*>)+[ \t]?"
#: Lines that introduce a quote.
ATTRIBUTION = r"(?i)^(on|am|le|el)\b.{0,200}(wrote|schrieb|a écrit|escribió)\s?.{0,80}:\s*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (text without quotes), passages: array of (level, text), in order."""
    line = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")

    def leveled(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 0)
        return F.struct((F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"), F.substr(x, F.length(marks) + 1).alias("body"))

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.transform(line, leveled).alias("l"))
    level = lambda i: F.get("l", i).getField("level")
    # Where runs of one level begin, and the runs.
    starts = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: (i == 0) | (level(i) != F.coalesce(level(i - 1), F.lit(-1))))
    rows = rows.withColumn("starts", starts)
    runs = F.transform(
        "starts",
        lambda i, k: F.struct(
            level(i).alias("level"),
            F.array_join(F.transform(F.slice("l", i + 1, F.coalesce(F.get("starts", k + 1), F.size("l")) - i), lambda x: x["body"]), "\n").alias("text"),
        ),
    )
    rows = rows.withColumn("runs", runs)
    followed = lambda i: F.coalesce(level(i + 1), F.lit(0)) > 0
    own = F.filter("l", lambda x, i: (x["level"] == 0) & ~(F.rlike(x["body"], F.lit(ATTRIBUTION)) & followed(i)))
    own = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")
    return rows.select("conv_id", "turn", "role", own.alias("own"), F.filter("runs", lambda r: r["level"] > 0).alias("passages"))


def _units(text: Column) -> Column:
    """The whole normalised text, each of its lines and each of its sentences."""
    sentences = F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?…])[\"'”’»)]* |(?<=[。！？])")
    pieces = F.transform(F.concat(F.array(text), F.split(text, "\n"), sentences), _normal)
    return F.array_distinct(F.filter(pieces, lambda x: x != ""))


def _run(words: Column, i: Column | int) -> Column:
    return F.xxhash64(*(F.get(words, F.lit(i) + k if isinstance(i, int) else i + k) for k in range(RUN)))


def _containing(parsed: DataFrame, quoted: DataFrame) -> DataFrame:
    """conv_id, turn, h: messages that say a quoted unit (columns h, unit) of RUN words or more as a run of their words."""
    units = quoted.select("h", "unit").distinct().select("h", "unit", F.split("unit", " ").alias("w")).filter(F.size("w") >= RUN)
    units = units.select("h", "unit", _run(F.col("w"), 0).alias("run"))
    own = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", _normal(F.col("own")).alias("norm"))
    words = own.select("conv_id", "turn", F.split("norm", " ").alias("w")).filter(F.size("w") >= RUN)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - RUN), lambda i: _run(F.col("w"), i)))
    runs = words.select("conv_id", "turn", F.explode(runs).alias("run")).join(units.select("run").distinct(), "run", "left_semi")
    # Runs travel without texts; those come to the few that meet.
    met = runs.join(units, "run").join(own, ["conv_id", "turn"])
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return met.filter(F.contains(spaced("norm"), spaced("unit"))).select("conv_id", "turn", "h")


def link_passages(parsed: DataFrame, stage: Stage) -> DataFrame:
    """Per passage that was found: conv_id, turn, passage (its number), level, from_conv, from_turn."""
    said = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(_units(F.col("own"))).alias("unit")).select("conv_id", "turn", F.xxhash64("unit").alias("h"))
    quoted = parsed.select("conv_id", "turn", F.posexplode("passages").alias("passage", "p"))
    quoted = quoted.select("conv_id", "turn", "passage", F.col("p.level").alias("level"), F.explode(_units(F.col("p.text"))).alias("unit"))
    quoted = quoted.withColumns({"h": F.xxhash64("unit"), "n": F.length("unit")})
    hashes = quoted.select("h").distinct()
    said = stage.write(said.join(hashes, "h", "left_semi").select("conv_id", "turn", "h").unionByName(_containing(parsed, quoted)).distinct(), "said")
    # The latest earlier message of the conversation that said it: one pass over both, by turn.
    both = said.select("conv_id", "h", "turn", F.lit(None).cast("int").alias("passage"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("n")).unionByName(
        quoted.select("conv_id", "h", "turn", "passage", "level", "n")
    )
    earlier = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    local = both.withColumn("near", F.max(F.when(F.col("passage").isNull(), F.col("turn"))).over(earlier)).filter("passage is not null")
    first = said.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    found = local.join(first, "h", "left")
    before = F.col("first") < F.struct("conv_id", "turn")
    target = F.when(F.col("near").isNotNull(), F.struct(F.col("conv_id"), F.col("near").alias("turn"))).when(before, F.col("first"))
    votes = found.withColumn("target", target).filter("target is not null").groupBy("conv_id", "turn", "passage", "level", "target").agg(F.sum("n").alias("n"))
    best = votes.groupBy("conv_id", "turn", "passage", "level").agg(F.max(F.struct("n", "target")).alias("best"))
    return best.select("conv_id", "turn", "passage", "level", F.col("best.target.conv_id").alias("from_conv"), F.col("best.target.turn").alias("from_turn"))


def _roots(replies: DataFrame, stage: Stage) -> DataFrame:
    """(conv_id, turn, root_conv, depth) of messages that reply, by doubling the reply pointers."""
    now = stage.write(replies.select("conv_id", "turn", "to_conv", "to_turn", F.lit(1).alias("depth")), "pointers")
    for _ in range(MAX_ROUNDS):
        far = now.select(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"), F.col("to_conv").alias("c2"), F.col("to_turn").alias("t2"), F.col("depth").alias("d2"))
        nxt = now.join(far, ["to_conv", "to_turn"], "left")
        nxt = stage.write(
            nxt.select("conv_id", "turn", F.coalesce("c2", "to_conv").alias("to_conv"), F.coalesce("t2", "to_turn").alias("to_turn"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("c2").isNotNull().alias("moved")),
            "pointers",
        )
        stage.drop(now)
        now = nxt
        if not now.filter("moved").limit(1).count():
            break
        now = now.drop("moved")
        now._quire_path = nxt._quire_path
    return now.select("conv_id", "turn", F.col("to_conv").alias("root_conv"), "depth")


def conversations(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """Per message: thread, number (from 0, in the thread), conv_id, turn, role, text, n_quotes, reply_to_conv, reply_to_turn, depth."""
    stage = Stage(spark, "quotes")
    parsed = stage.write(parse(messages), "parsed")
    links = link_passages(parsed, stage).filter("level = 1")
    replies = links.groupBy("conv_id", "turn").agg(F.min_by(F.struct(F.col("from_conv").alias("c"), F.col("from_turn").alias("t")), "passage").alias("to"))
    replies = stage.write(replies.select("conv_id", "turn", F.col("to.c").alias("to_conv"), F.col("to.t").alias("to_turn")), "replies")
    roots = _roots(replies, stage)
    rows = parsed.join(replies, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    rows = rows.select(
        F.coalesce("root_conv", "conv_id").alias("thread"), "conv_id", "turn", "role", F.col("own").alias("text"), F.size("passages").alias("n_quotes"),
        F.col("to_conv").alias("reply_to_conv"), F.col("to_turn").alias("reply_to_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )
    # A reply comes after what it replies to in the order of (conv_id, turn). Numbers: those of the parts before, and within a part.
    rows = stage.write(rows.withColumn("part", F.floor(F.col("turn") / SPAN)), "rows")
    counts = rows.groupBy("thread", "conv_id", "part").count()
    before = Window.partitionBy("thread").orderBy("conv_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.xxhash64("thread", "conv_id", "part").alias("k"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("thread", "conv_id", "part").orderBy("turn", "role", "text")
    numbered = rows.withColumn("k", F.xxhash64("thread", "conv_id", "part")).withColumn("r", F.row_number().over(inside) - 1).join(offsets, "k")
    return numbered.select("thread", (F.col("r") + F.col("offset")).alias("number"), *(c for c in rows.columns if c not in ("thread", "part")))


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
