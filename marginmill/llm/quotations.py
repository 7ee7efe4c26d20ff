"""Quotation linking: what messages quote of each other becomes replies, and goes from their texts.

A line is quoted as deep as it has `>` signs in front. Lines of one depth that follow each other are a passage. Passages,
their lines, their paragraphs (up to a blank line, however wrapped) and sentences are normalised (letters and digits, one space
between words, small letters) and hashed. A quoted passage is joined to its original: the first message of the conversation that
has it as its own text; where none has the passage or a line of it, one that has a paragraph, then one that has a sentence of
it (the latest, if parts of a passage come from several). A message replies to the
original of its least deep linked quote, the latest one if there are several; without a linked quote to the message before it.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered, stored

#: Between sentences.
_SENTENCE = r"(?<=[.!?])\s+|(?<=[。！？])"
_MARKS = r"^((?:[ \t]*>)*)[ \t]*(.*)$"


def _normal_hash(text):
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")))


def passages(messages: DataFrame, keys=()) -> DataFrame:
    """row, passage (its number in the message), level (0: own text), lines (in order) of all messages (row, text, and
    the columns `keys`, which their passages keep)."""
    lines = messages.select("row", *keys, F.posexplode(F.split("text", "\r?\n")).alias("place", "line"))
    marks = F.regexp_extract("line", _MARKS, 1)
    lines = lines.select(
        "row",
        *keys,
        "place",
        (F.length(marks) - F.length(F.replace(marks, F.lit(">")))).alias("level"),
        F.when(F.contains(marks, F.lit(">")), F.regexp_extract("line", _MARKS, 2)).otherwise(F.col("line")).alias("line"),
    )
    # One message is one row of the input, so its lines are no more than a row holds.
    order = Window.partitionBy("row").orderBy("place")
    new = F.coalesce(F.lag("level").over(order) != F.col("level"), F.lit(True)).cast("int")
    lines = lines.withColumn("new", new).withColumn("passage", F.sum("new").over(order))
    return lines.groupBy("row", *keys, "passage").agg(
        F.first("level").alias("level"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("lines"),
    )


def link_quotations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to (turn), depth (deepest quote), n_quoted (quoted passages), n_linked (those with an
    original), text (own text, without quotes) for every message.

    Sorted by conversation, the message replied to, and turn, each message stands after the one it replies to. The first
    message of a conversation replies to none. Null text stays null; an empty quote is no passage; messages without
    conv_id are linked with nothing, and those without a turn come first and are no originals. Of rows with the same conv_id
    and turn each gets its own reply; they are in the order of their texts. Other columns are not read.
    """
    columns = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows, _ = numbered(columns, [F.asc_nulls_first(c) for c in ("conv_id", "turn")] + [F.xxhash64("text").asc()], "messages")
    keys = rows.select("row", "conv_id", "turn")
    # Passages keep the conversation and the turn, so that what they are taken apart into meets no message again.
    found = stored(passages(rows.drop("role").filter("text IS NOT NULL"), ["conv_id", "turn"]), "passages")

    # A passage as a whole, its lines, paragraphs and sentences can be quoted; larger ones tell more than smaller ones.
    whole = F.array_union(F.col("lines"), F.array(F.array_join("lines", " ")))
    paragraphs = F.split(F.array_join("lines", "\n"), r"\n(?:\s*\n)+")
    steps = found.withColumn("whole", whole).withColumn("paragraphs", F.array_except(paragraphs, F.col("whole")))
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, _SENTENCE)))
    steps = steps.withColumn("sentences", F.array_except(sentences, F.array_union("whole", "paragraphs")))
    kinds = [F.transform(name, lambda u, rank=rank: F.struct(F.lit(rank).alias("rank"), u.alias("unit"))) for rank, name in enumerate(("whole", "paragraphs", "sentences"))]
    linkable = steps.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    units = linkable.select("row", "conv_id", "turn", "passage", "level", F.inline(F.concat(*kinds)))
    placed = units.withColumn("hash", _normal_hash(F.col("unit"))).filter(F.col("hash") != F.md5(F.lit(""))).drop("unit")
    originals = placed.filter("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    quotes = placed.filter("level > 0").join(originals, ["conv_id", "hash"], "left").filter("original < turn")
    of_passage = quotes.groupBy("row", "passage", "level").agg(F.min(F.struct("rank", (-F.col("original")).alias("less"))).alias("top"))
    linked = of_passage.groupBy("row").agg(
        F.min(F.struct("level", F.col("top.less").alias("less"))).alias("best"), F.count(F.lit(1)).alias("n_linked")
    )
    real = F.exists("lines", lambda x: F.trim(x) != "")
    own = F.filter(F.array_sort(F.collect_list(F.struct("passage", "level", "lines"))), lambda x: x["level"] == 0)
    texts = found.groupBy("row").agg(
        F.max("level").alias("depth"),
        F.count(F.when((F.col("level") > 0) & real, 1)).alias("n_quoted"),
        F.array_join(F.flatten(F.transform(own, lambda x: x["lines"])), "\n").alias("own"),
    )
    before = _turn_before(keys)
    joined = rows.drop("text").join(texts, "row", "left").join(linked, "row", "left").join(before, "row", "left")
    return joined.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce(-F.col("best.less"), "before").alias("reply_to"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.col("own").alias("text"),
    )


def _turn_before(keys: DataFrame) -> DataFrame:
    """row, before: the turn of the message before it in its conversation. Tasks hold rows in order; only the first row of
    a task looks at another task's last one, and there is one such row for each task."""
    task = F.shiftright("row", 33)
    inside = keys.select((F.col("row") + 1).alias("row"), F.col("conv_id").alias("c"), F.col("turn").alias("before"))
    ends = keys.groupBy(task.alias("task")).agg(F.min("row").alias("row"), F.max_by(F.struct("conv_id", "turn"), "row").alias("end"))
    last = F.lag("end").over(Window.orderBy("task"))
    across = ends.select("row", last["conv_id"].alias("c"), last["turn"].alias("before")).filter("c IS NOT NULL")
    return keys.select("row", "conv_id").join(inside.union(across), "row").filter("c = conv_id").select("row", "before")
