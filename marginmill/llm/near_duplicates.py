"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has 16 bits of each of VALUES minima. The join finds all pairs whose signatures differ in at most 31 of 64
values, by the pigeonhole principle: of the 16 chunks of four values, one differs in at most one value, as 31 < 16 * 2.
Chunks that may have one error are matched by enumerating the place of the error: four keys for each chunk, each without one
of its values. A pair of similarity 0.75 differs in 16 values on average; 31 is 4.3 standard deviations more, and more
distant pairs that share a key by chance are not turned away. Links are confirmed on the full shingle sets. Before that, a
parity bitmap of each set (PARITY bits, each flipped by the shingles that fall on it) rules out most pairs without
loss: two bitmaps differ in at most as many bits as the sets have shingles apart.

Work stays linear in large groups. Documents with equal shingle sets are one from the start. Then every document of a
bucket (of a key) is compared with the first one of it only; confirmed links give components. Then, among the buckets that
still hold several components, pairs from different components are confirmed as well, so
that no link between components is lost; links inside of a component would not change it. A hot bucket is a hot key of
plain joins, which adaptive execution splits. Links, components and signatures stay in tables.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import components
from .shared import stored

SHINGLE_WORDS = 5
VALUES = 64
CHUNK = 4
CHUNKS = VALUES // CHUNK
PARITY = 1024
#: Similarity of at least PART / WHOLE links two documents.
PART, WHOLE = 75, 100

_CHUNKS = [f"c{i}" for i in range(CHUNKS)]
_BITS = [f"b{i}" for i in range(PARITY // 64)]
_COLUMNS = _CHUNKS + _BITS


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _sketches(texts: pa.Array, size: int) -> pa.Array:
    """n (distinct shingles), a and b (together 128 bits that identify the set), the signature and the parity bitmap."""
    seeds = words.mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64), 0x2545F4914F6CDD1D)
    n = np.zeros(len(texts), np.int64)
    identity = np.zeros((2, len(texts)), np.uint64)
    values = np.zeros((len(texts), VALUES), np.uint64)
    parity = np.zeros((len(texts), PARITY), np.uint8)
    # Small blocks: the hashes are gone through once for each minimum.
    for block in words.word_blocks(texts, words.byte_table(words.SPACES), 1 << 17):
        hashes, bounds = words.shingle_hashes(block, size)
        rows = np.flatnonzero(np.diff(bounds))
        if not len(rows):
            continue
        at, to = bounds[rows], block.first_row + rows
        turned = np.empty_like(hashes)
        for k in range(VALUES):
            np.multiply(hashes, seeds[2 * k] | np.uint64(1), out=turned)
            turned += seeds[2 * k + 1]
            values[to, k] = words.mix(np.minimum.reduceat(turned, at)) & np.uint64(0xFFFF)
        for row in rows:
            own = np.unique(hashes[bounds[row] : bounds[row + 1]])
            place = block.first_row + row
            n[place] = len(own)
            identity[0, place] = words.mix(own, 17).sum()
            identity[1, place] = words.mix(own, 71).sum()
            parity[place] = np.bincount((own & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    shifts = np.arange(CHUNK, dtype=np.uint64) * np.uint64(16)
    chunks = (values.reshape(-1, CHUNKS, CHUNK) << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)
    packed = np.packbits(parity, axis=1).view(np.int64).reshape(-1, PARITY // 64)
    columns = [n, *identity.view(np.int64), *chunks.T, *packed.T]
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], ["n", "a", "b", *_COLUMNS])


def _sets(texts: pa.Array, size: int) -> pa.Array:
    """The distinct shingles of each text, as hashes."""
    found, lengths = [], []
    for block in words.word_blocks(texts, words.byte_table(words.SPACES)):
        hashes, bounds = words.shingle_hashes(block, size)
        for low, high in zip(bounds, bounds[1:]):
            found.append(np.unique(hashes[low:high]).view(np.int64))
            lengths.append(len(found[-1]))
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))


def _sketch_udf(size: int):
    kind = ", ".join(f"{c} long" for c in ["n", "a", "b", *_COLUMNS])

    @F.arrow_udf(kind)
    def sketch(texts: pa.Array) -> pa.Array:
        return words.in_slices(lambda t: _sketches(t, size), texts)

    return sketch


def _set_udf(size: int):
    @F.arrow_udf("array<long>")
    def shingles(texts: pa.Array) -> pa.Array:
        return words.in_slices(lambda t: _sets(t, size), texts)

    return shingles


def _keys():
    """The 64 keys of a signature: a chunk without one of its values, and which chunk and value that is."""
    keys = []
    for i, c in enumerate(_CHUNKS):
        for lane in range(CHUNK):
            upper = F.col(c).bitwiseAND(F.lit(_signed(~((1 << 16 * (lane + 1)) - 1) & (1 << 64) - 1)))
            rest = F.shiftrightunsigned(upper, 16)
            if lane:
                rest = rest.bitwiseOR(F.col(c).bitwiseAND(F.lit((1 << 16 * lane) - 1)))
            keys.append(F.shiftleft(rest, 6).bitwiseOR(F.lit(i * CHUNK + lane).cast("long")))
    return F.explode(F.array(*keys))


def _may_be_similar(x: str, y: str):
    """Whether sizes and parity bitmaps leave two documents a chance: sets as similar as that differ in at most
    (WHOLE - PART) / (WHOLE + PART) of the sum of their sizes."""
    apart = F.lit(0)
    for c in _BITS:
        apart = apart + F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (F.least(n, m) * WHOLE >= F.greatest(n, m) * PART) & (apart * (WHOLE + PART) <= (n + m) * (WHOLE - PART))


def _similar(x, y):
    """Whether two full shingle sets are similar enough."""
    common = F.size(F.array_intersect(x, y)).cast("long")
    return common * WHOLE >= (F.size(x) + F.size(y) - common) * PART


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("id").alias("u"), F.col("s").alias("x"))
    right = sets.select(F.col("id").alias("v"), F.col("s").alias("y"))
    return pairs.join(left, "u").join(right, "v").filter(_similar(F.col("x"), F.col("y"))).select("u", "v")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE_WORDS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the near-duplicate group of every row.

    Null and wordless texts have no shingles and are linked with nothing; a text of fewer than `size` words has one,
    the whole of it. Rows that share an id are one document for links, each with its own n_shingles. A row without
    an id has no component and stays. Ties do not arise: a component is named by its smallest id. Other columns are
    not read, an empty table gives an empty result.
    """
    documents = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    sketched = documents.select("id", _sketch_udf(size)("text").alias("s")).select("id", "s.*")
    sketched = stored(sketched, "signatures")
    known = sketched.filter("n > 0 AND id IS NOT NULL")
    # Equal sets have equal signatures: any of them will do.
    classes = stored(
        known.groupBy("a", "b", "n").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in _COLUMNS]), "classes"
    )
    signed = classes.select("id", "n", *_COLUMNS)

    rows = signed.select("id", _keys().alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    shared = stored(rows.join(buckets.select("key", "first"), "key"), "buckets")

    first_pairs = shared.filter("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")).distinct()
    near = (
        first_pairs.join(signed.alias("x"), F.col("u") == F.col("x.id"))
        .join(signed.alias("y"), F.col("v") == F.col("y.id"))
        .filter(_may_be_similar("x", "y"))
        .select("u", "v")
    )
    texts = documents.join(shared.select("id").distinct(), "id", "left_semi")
    sets = stored(texts.select("id", _set_udf(size)("text").alias("s")), "sets")
    links = stored(_confirmed(near, sets), "links")
    grouped = stored(components(links), "components")

    # What is left: pairs from different components, in the buckets that hold more than one.
    placed = shared.join(grouped, shared["id"] == grouped["node"], "left").select(
        "key", "id", "first", F.coalesce("component", "id").alias("component")
    )
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_rows = placed.filter("id <> first").join(mixed.filter("low <> high").select("key"), "key")
    open_rows = stored(open_rows.join(signed, "id").select("key", "component", *signed.columns), "open")
    x, y = open_rows.alias("x"), open_rows.alias("y")
    between = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.col("x.id") > F.col("y.id"))
        & _may_be_similar("x", "y"),
    ).select(F.col("x.id").alias("u"), F.col("y.id").alias("v"))
    more = stored(_confirmed(stored(between.distinct(), "pairs"), sets), "links")
    grouped = components(links.union(more))

    # A class belongs to the component of its smallest document; ids that stand for several texts join their classes.
    class_component = classes.join(grouped, classes["id"] == grouped["node"], "left").select(
        "a", "b", "n", F.coalesce("component", "id").alias("component")
    )
    result = sketched.join(class_component, ["a", "b", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return result.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of the documents that stand for their near-duplicate group, one of each; all columns stay. Of rows
    with the same id one stays; rows without an id stay."""
    kept = near_duplicates(docs, id_column, text_column).filter("kept AND doc_id IS NOT NULL")
    kept = kept.select(F.col("doc_id").alias(id_column)).distinct()
    with_id = docs.join(kept, id_column, "left_semi").dropDuplicates([id_column]).select(*docs.columns)
    return with_id.union(docs.filter(F.col(id_column).isNull()))
