"""Document fingerprints as homomorphic multiset hashes.

A text is a multiset of paragraphs: runs that end in a line break or the end of a sentence, so that together they are
the whole text. Each paragraph is hashed to a wide vector of LANES numbers that are +1 or -1, one for each bit used of
its md5. The fingerprint is the sum of these vectors modulo 2**16, with the number of paragraphs. The sum does not depend
on their order; a paragraph is inserted or deleted by adding or subtracting its vector, and fingerprints of parts add up to
that of the whole. Equal texts have equal fingerprints. The distance of two sums also estimates how many paragraphs two
texts have apart, which gives a likeness.

While they are summed, bits are counted rather than signs, three counters of 20 bits to a long: one pass of plain sums. No
counter sees more than PART paragraphs, so none runs into the next; counts of several parts are added one by one.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered, stored

#: A paragraph ends in line breaks or sentence marks.
PARAGRAPH = r"[^\n.!?]*[\n.!?]+|[^\n.!?]+"
HASHES, SPREAD, COUNTERS = 2, 20, 3
LANES = HASHES * SPREAD * COUNTERS
MODULUS = 1 << 16
#: Paragraphs that are summed in packed counters.
PART = 1 << (SPREAD - 1)
_ONES = sum(1 << SPREAD * i for i in range(COUNTERS))
_COUNTER = (1 << SPREAD) - 1


def _hashes(paragraph):
    """Two numbers of 60 bits."""
    digest = F.md5(paragraph)
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(HASHES)]


def _counts(texts: DataFrame, keys: list[str], text_column: str) -> DataFrame:
    """keys, part (0 for a text that is one part), paragraphs and counters (their bits, packed) of each part of each text; a
    text is a row with keys of its own."""
    paragraphs = F.regexp_extract_all(F.coalesce(text_column, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    pieces = texts.select(*keys, paragraphs.alias("_all"))
    pieces = pieces.select(*keys, (F.size("_all") > PART).alias("_long"), F.posexplode_outer("_all").alias("_at", "_p"))
    part = F.when(F.col("_long"), 1 + F.floor(F.col("_at") / PART)).otherwise(0).cast("int")
    pieces = pieces.select(*keys, part.alias("part"), "_p", *[h.alias(f"_h{i}") for i, h in enumerate(_hashes(F.col("_p")))])
    packed = [(i, s) for i in range(HASHES) for s in range(SPREAD)]
    sums = [F.sum(F.shiftright(f"_h{i}", s).bitwiseAND(F.lit(_ONES))).alias(f"_s{i}_{s}") for i, s in packed]
    summed = pieces.groupBy(*keys, "part").agg(F.count("_p").alias("paragraphs"), *sums)
    counters = F.array(*[F.coalesce(f"_s{i}_{s}", F.lit(0)) for i, s in packed])
    return summed.select(*keys, "part", "paragraphs", counters.alias("counters"))


def _unpacked(counters):
    """The counts of bits."""

    def of(c):
        return F.array(*[F.shiftright(c, SPREAD * k).bitwiseAND(F.lit(_COUNTER)) for k in range(COUNTERS)])

    return F.flatten(F.transform(counters, of))


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, paragraphs, counters (counts modulo 2**16, packed again) of parts, each count summed by itself."""
    counts = parts.select(*keys, "paragraphs", F.posexplode(_unpacked("counters")).alias("_at", "_n"))
    summed = counts.groupBy(*keys, "_at").agg(F.sum("paragraphs").alias("paragraphs"), F.sum("_n").alias("_n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_n"))), lambda x: F.pmod(x["_n"], F.lit(MODULUS)))
    whole = summed.groupBy(*keys).agg(F.first("paragraphs").alias("paragraphs"), ordered.alias("_counts"))
    packed = [
        sum((F.shiftleft(F.col("_counts")[i * COUNTERS + k], SPREAD * k) for k in range(1, COUNTERS)), F.col("_counts")[i * COUNTERS])
        for i in range(HASHES * SPREAD)
    ]
    return whole.select(*keys, "paragraphs", F.array(*packed).alias("counters"))


def lanes(paragraphs, counters):
    """The sums of signs, modulo 2**16, from counts of bits."""
    return F.transform(_unpacked(counters), lambda b: F.pmod(b * 2 - paragraphs, F.lit(MODULUS)))


def lanes_of(texts: DataFrame, keys: list[str], text_column: str = "text") -> DataFrame:
    """keys, paragraphs (their number) and lanes (their sum, LANES numbers modulo 2**16) of each group of rows with the
    same keys. A text may be given in parts, whole paragraphs each, in any order, and a group may have any number of rows.
    Null and empty texts have none."""
    rows = texts.withColumn("_row", F.monotonically_increasing_id())
    found = _added(_counts(rows, [*keys, "_row"], text_column), keys)
    return found.select(*keys, "paragraphs", lanes(F.col("paragraphs"), F.col("counters")).alias("lanes"))


def inserted(lanes, others):
    """Lanes of a text with the paragraphs of another one added."""
    return F.zip_with(lanes, others, lambda a, b: F.pmod(a + b, F.lit(MODULUS)))


def deleted(lanes, others):
    """Lanes of a text with paragraphs taken away."""
    return F.zip_with(lanes, others, lambda a, b: F.pmod(a - b, F.lit(MODULUS)))


def fingerprint(paragraphs, lanes):
    """Number of paragraphs (8 hexadecimal digits) and lanes (4 each)."""
    digits = F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 4, "0")), "")
    return F.concat(F.lpad(F.hex(paragraphs), 8, "0"), digits)


def _squares(lanes):
    """Sum of squares of lanes, read as signed numbers."""
    half = MODULUS // 2
    signed = F.transform(lanes, lambda x: F.pmod(x + half, F.lit(MODULUS)) - half)
    return F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x * x)


def likeness(lanes, others):
    """0 to 1: 1 for equal fingerprints; else about the share of paragraphs that two texts have in common (twice the
    common ones over all), with a standard error of about 1 / sqrt(LANES); 0 where they seem to have none."""
    apart, whole = _squares(deleted(lanes, others)), _squares(lanes) + _squares(others)
    near = 1.0 - F.try_divide(apart.cast("double"), whole.cast("double"))
    return F.coalesce(F.greatest(F.lit(0.0), near), F.lit(1.0))


_KEY = ["none", "id", "hash"]


def in_descending_order(texts: DataFrame) -> DataFrame:
    """Each distinct row (none, id, hash) of the texts once: none, id, hash, n, copies, row (its number by descending id;
    rows with one id by hash, rows without one last) and next (the number of the row after it; after the last comes the first).

    Only keys are ordered, not texts. They are range-partitioned and sorted there, and only the first and last number of
    each task are needed to link the tasks: no window sees more than one row for each."""
    distinct = texts.groupBy(*_KEY, F.length("text").alias("n")).agg(F.count("*").alias("copies"))
    ordered, ends = numbered(distinct, [F.col("none").asc(), F.col("id").desc(), F.col("hash").asc()], "ordered")
    all_tasks = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("first").over(Window.orderBy("task")), F.min("first").over(all_tasks))
    ends = ends.select("task", "last", following.alias("following"))
    placed = ordered.withColumn("task", F.shiftright("row", 33)).join(ends, "task")
    after = F.when(F.col("row") == F.col("last"), F.col("following")).otherwise(F.col("row") + 1)
    return placed.select(*_KEY, "n", "copies", "row", after.alias("next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text of a row has its last floor(n_chars / 3) code points replaced by as many first ones, or all, of the
    next row's text. Null text is empty; a single row follows itself; repeated rows stand one after the other, so all but the
    last of them are followed by themselves; other columns are not read; an empty table gives an empty result.

    Texts are shuffled once, by key; each then sends the piece that the row before it asked for to that row's key.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"), "text"
    )
    ordered = in_descending_order(rows)
    texts = rows.dropDuplicates(_KEY)
    # Who follows whom, and how often: the last copy has another row after it, the others have themselves.
    followers = F.array(
        F.struct(F.col("next").alias("giver"), F.lit(1).cast("long").alias("times")),
        F.struct(F.col("row").alias("giver"), (F.col("copies") - 1).alias("times")),
    )
    asker = [F.col(c).alias(f"asker_{c}") for c in _KEY]
    asked = ordered.select(*asker, F.col("row").alias("asker"), "n", F.inline(followers)).filter("times > 0")
    asked = asked.join(ordered.select(*_KEY, F.col("row").alias("giver")), "giver")
    given = texts.join(asked, _KEY).select(
        *[F.col(f"asker_{c}").alias(c) for c in _KEY],
        F.col("asker").alias("row"),
        "giver",
        "times",
        F.expr("substring(text, 1, cast(n / 3 as int))").alias("given"),
    )
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.col("given"))
    both = texts.join(given, _KEY).select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        "row",
        "giver",
        "times",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"),
        F.inline(
            F.array(*[F.struct(F.lit(i).alias("version"), t.alias("own")) for i, t in enumerate((F.col("text"), edited))])
        ),
    )
    keys = ["doc_id", "row", "giver", "times", "n_chars", "edited_sha256", "version"]
    parts = stored(_counts(both, keys, "own"), "lanes")
    summed = parts.filter("part = 0").drop("part").unionByName(_added(parts.filter("part > 0"), keys))
    # Counters are an eighth of what lanes and fingerprints take: these are made after the last shuffle.
    new = summed.filter("version = 1").drop("version")
    own = summed.filter("version = 0").select("row", F.col("paragraphs").alias("own_n"), F.col("counters").alias("own"))
    own = own.dropDuplicates(["row"])
    after = own.select(F.col("row").alias("giver"), F.col("own_n").alias("after_n"), F.col("own").alias("after"))
    joined = new.join(own, "row").join(after, "giver")
    joined = joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "times",
        "paragraphs",
        "own_n",
        lanes(F.col("paragraphs"), F.col("counters")).alias("new"),
        lanes(F.col("own_n"), F.col("own")).alias("own"),
        lanes(F.col("after_n"), F.col("after")).alias("after"),
    )
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own_n"), F.col("own")).alias("fingerprint"),
        fingerprint(F.col("paragraphs"), F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"),
    ).drop("copy")
