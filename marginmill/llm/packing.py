"""Packing documents into fixed-length training sequences as a cutting-stock problem.

A document's ids are cut at multiples of the sequence length; what is left over is one piece. Pieces are counted by
length class (of UNIT tokens), which gives a histogram of at most capacity / UNIT numbers. A linear program over
patterns (how many pieces of each class share a sequence) covers the histogram with the fewest sequences: columns are
generated by pricing with a knapsack dynamic program until none improves it, it is within TOLERANCE of its lower bound, or many columns gain less
than that. Patterns are rounded down, the few pieces this leaves are packed greedily, and the pieces of each class, ranked, are dealt to the
places of their patterns. Only the histogram and the patterns pass through the driver.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .shared import stored
from .tokens import word_encoder

CAPACITY = 4096
UNIT = 8
END = 2
TOLERANCE = 1e-3
#: Columns that are generated at most, as a multiple of the number of classes.
MOST_ROUNDS = 50


def _best_pattern(values: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack: the pattern of the largest total value; class c takes c units."""
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    gain = np.maximum(values, 0.0)
    turned = gain[:0:-1].copy()
    for room in range(1, capacity + 1):
        options = best[:room] + turned[capacity - room : capacity]
        k = int(options.argmax())
        best[room], choice[room] = options[k], room - k
    pattern = np.zeros(capacity + 1, np.int64)
    room = capacity
    while room > 0:
        if gain[choice[room]] > 0:
            pattern[choice[room]] += 1
        room -= choice[room]
    return pattern


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """matrix @ vector without the threads of a linear algebra library, which can lock up beside a JVM's."""
    return (matrix * vector).sum(axis=1)


def _inverse(basis: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row exchanges."""
    m = len(basis)
    both = np.hstack([basis, np.eye(m)])
    for k in range(m):
        top = k + int(np.abs(both[k:, k]).argmax())
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0.0
        rows = np.flatnonzero(factors)
        both[rows] -= factors[rows, None] * both[k]
    return both[:, m:]


def fractional_patterns(demand: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows, over classes 0 to capacity) and how often each is used in the linear program's solution.
    demand[c] pieces take c units; demand[0] is 0. Column generation by the revised simplex method: every basis is a solution,
    so the loop may end at any turn; it does so after MOST_ROUNDS columns a class at the latest."""
    capacity = len(demand) - 1
    classes = np.flatnonzero(demand)
    m = len(classes)
    if not m:
        return np.zeros((0, capacity + 1), np.int64), np.zeros(0)
    patterns = np.zeros((m, capacity + 1), np.int64)
    patterns[np.arange(m), classes] = capacity // classes
    inverse = np.diag(1.0 / (capacity // classes))
    need = demand[classes].astype(float)
    level = _times(inverse, need)
    full = float((classes * need).sum()) / capacity
    best = np.inf
    for turn in range(MOST_ROUNDS * m):
        if turn % m == 0:
            # A round of as many columns as classes that gains too little is the last one.
            if not level.sum() <= (1 - tolerance) * best:
                break
            best = level.sum()
        prices = np.zeros(capacity + 1)
        prices[classes] = inverse.sum(axis=0)
        column = _best_pattern(prices, capacity)
        worth = float((prices * column).sum())
        # The prices over `worth` are a feasible dual: a lower bound of the program, as are sequences without padding.
        bound = max(full, float((prices[classes] * need).sum()) / worth)
        if worth <= 1 + 1e-9 or level.sum() <= (1 + tolerance) * bound:
            break
        direction = _times(inverse, column[classes])
        rising = direction > 1e-9
        steps = np.where(rising, level / np.where(rising, direction, 1), np.inf)
        out = int(steps.argmin())
        patterns[out] = column
        inverse[out] /= direction[out]
        direction[out] = 0.0
        rows = np.flatnonzero(direction)
        inverse[rows] -= direction[rows, None] * inverse[out]
        if turn % 100 == 99:
            inverse = _inverse(patterns[:, classes].T.astype(float))
        level = np.maximum(_times(inverse, need), 0.0)
    return patterns, level


def whole_patterns(demand: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and whole counts that place every piece exactly once."""
    fractional, level = fractional_patterns(demand, tolerance)
    patterns, counts, left = [], [], demand.astype(np.int64).copy()
    for pattern, times in zip(fractional, np.floor(level + 1e-6).astype(np.int64)):
        used = pattern > 0
        times = min(int(times), int((left[used] // pattern[used]).min()))
        if times > 0:
            patterns.append(pattern)
            counts.append(times)
            left -= times * pattern
    while left.any():
        # Largest first, then whatever still fits.
        pattern, room = np.zeros_like(left), len(demand) - 1
        for c in np.flatnonzero(left)[::-1]:
            pattern[c] = min(int(left[c]), room // c)
            room -= pattern[c] * c
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        patterns.append(pattern)
        counts.append(times)
        left -= times * pattern
    return np.array(patterns).reshape(-1, len(demand)), np.array(counts, np.int64)


def _pieces(texts: pa.Array, path: str, capacity: int, end: int | None, with_ids: bool) -> pa.Array:
    start, length, crc, total, ids, bounds = [], [], [], [], [], [0]
    for own in word_encoder(path).rows(texts, end):
        for at in range(0, len(own), capacity):
            piece = own[at : at + capacity].astype("<u4")
            start.append(at)
            length.append(len(piece))
            crc.append(zlib.crc32(piece.tobytes()))
            total.append(len(own))
            if with_ids:
                ids.append(piece.astype(np.int32))
        bounds.append(len(start))
    columns = {"start": start, "length": length, "ids_crc32": crc, "doc_tokens": total}
    if with_ids:
        columns["ids"] = ids
    arrays = [pa.array(v, pa.list_(pa.int32()) if k == "ids" else pa.int64()) for k, v in columns.items()]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(arrays, list(columns)))


def _sequence_udf(patterns: np.ndarray, counts: np.ndarray):
    """(class, rank in the class) to the sequence: a class fills the places of one pattern after the other."""
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    begins, sequences, per = {}, {}, {}
    for c in np.flatnonzero(patterns.any(axis=0)).tolist():
        of = np.flatnonzero(patterns[:, c])
        per[c] = patterns[of, c]
        sequences[c] = first[of]
        begins[c] = np.concatenate(([0], np.cumsum(per[c] * counts[of])))

    @F.arrow_udf("long")
    def sequence(classes: pa.Array, ranks: pa.Array) -> pa.Array:
        classes, ranks = classes.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        out = np.zeros(len(classes), np.int64)
        for c in np.unique(classes).tolist():
            own = np.flatnonzero(classes == c)
            at = np.searchsorted(begins[c], ranks[own], "right") - 1
            out[own] = sequences[c][at] + (ranks[own] - begins[c][at]) // per[c][at]
        return pa.array(out)

    return sequence


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, unit: int = UNIT, end: int | None = END, with_ids: bool = False
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) for every piece.

    Null and empty texts have the end id alone. Repeated rows are packed as often as they occur, also under the same
    id. Other columns are not read; an empty table gives an empty result. Pieces of a sequence lie one after the other
    in the order in which they were written; a sequence is padded from its last piece to the capacity. `capacity`
    must be a multiple of `unit`. The tokenizer must not join text across ASCII white space.
    """

    fields = "start: long, length: long, ids_crc32: long, doc_tokens: long" + (", ids: array<int>" if with_ids else "")

    @F.arrow_udf(f"array<struct<{fields}>>")
    def pieces_of(texts: pa.Array) -> pa.Array:
        words.keep("packing", word_encoder.cache_clear)
        return words.in_slices(lambda t: _pieces(t, tokenizer_path, capacity, end, with_ids), texts, name="packing")

    pieces = docs.select("doc_id", F.inline(pieces_of("text")))
    pieces = pieces.withColumn("piece", F.monotonically_increasing_id())
    pieces = stored(pieces.withColumn("class", F.ceil(F.col("length") / unit).cast("int")), "pieces")

    histogram = np.zeros(capacity // unit + 1, np.int64)
    for row in pieces.groupBy("class").count().collect():
        histogram[row["class"]] = row["count"]
    patterns, counts = whole_patterns(histogram)

    # Ranks: within what one task wrote, after all that earlier tasks wrote; no class meets in one task.
    pieces = pieces.withColumn("task", F.shiftright("piece", 33).cast("int"))
    totals = pieces.groupBy("class", "task").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    inside = Window.partitionBy("class", "task").orderBy("piece")
    ranked = pieces.withColumn("place", F.row_number().over(inside) - 1).join(totals, ["class", "task"])
    dealt = ranked.withColumn("sequence_id", _sequence_udf(patterns, counts)("class", F.col("before") + F.col("place")))
    # A sequence has at most `capacity` pieces.
    earlier = Window.partitionBy("sequence_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")
    wanted = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    return dealt.select(*wanted, offset.alias("offset"), *(["ids"] if with_ids else []))
