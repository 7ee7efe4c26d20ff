"""Hard negatives: for each anchor and positive the highest-scoring rows of other labels within a window of scores.

Scores are inner products of whole-number vectors, by Strassen's recursive multiplication of int64 tiles (anchors by candidates),
padded with zeros to halves that fit; additions modulo 2**64 are exact, so scores are, as long as they fit 64 bits. Rows are
range-partitioned by label and id and cut into tiles of at most TILE rows; a hot label is many tiles. Anchors pass as blocks of
bounded size: a block is broadcast, each task multiplies its tiles with it and keeps a heap for each anchor, and heaps of
tasks are merged by one aggregation. Positives come first, from tiles that share a label with the block; then windows are
known, and heaps of negatives are filled from the others.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Rows of a tile of candidates; anchors that are broadcast at once, and multiplied at once.
TILE, BLOCK, STRIP = 2048, 8192, 512
#: Strassen's recursion ends where a side is this short.
LEAF = 32
POSITIVES, NEGATIVES = 5, 3
#: A negative scores at least LOW and at most HIGH hundredths of the positive.
LOW, HIGH = 50, 95
ANCHOR_EVERY, RELABEL_EVERY, LABELS, SCALE = 50, 7, 10, 256.0
_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b.T for int64 matrices of any shape with equal numbers of columns."""
    m, k, n = len(a), a.shape[1], len(b)
    if min(m, k, n) <= leaf:
        return np.einsum("ik,jk->ij", a, b)
    # Halves of even sides; a padded row or column of zeros adds nothing.
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, n % 2), (0, k % 2)))
    r, s, t = len(a) // 2, a.shape[1] // 2, len(b) // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    # b stands transposed: its rows are the columns of the right factor.
    b11, b21, b12, b22 = b[:t, :s], b[:t, s:], b[t:, :s], b[t:, s:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * r, 2 * t), np.int64)
    out[:r, :t] = p1 + p4 - p5 + p7
    out[:r, t:] = p3 + p5
    out[r:, :t] = p2 + p4
    out[r:, t:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, units (floor of SCALE times each component) of the rows that take part."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(finite)
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    units = F.transform("vector", lambda x: F.floor(x * SCALE).cast("long"))
    return rows.select("vec_id", moved.alias("label"), units.alias("units"))


def _tiles(rows: DataFrame, most: int) -> DataFrame:
    """rows in tiles: low, high (labels), rows (their number), width, ids, labels, matrix (int64 values as bytes); sorted by label
    and id within a task. Shorter vectors are padded with zeros."""

    def cut(batches):
        for batch in batches:
            units = batch.column("units")
            counts = units.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            width = int(counts.max(initial=0))
            matrix = np.zeros((len(counts), width), np.int64)
            matrix[np.arange(width) < counts[:, None]] = units.flatten().to_numpy(zero_copy_only=False)
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            for at in range(0, len(ids), most):
                own = slice(at, at + most)
                values = [int(labels[own][0]), int(labels[own][-1]), len(ids[own]), width]
                blobs = [ids[own].tobytes(), labels[own].tobytes(), matrix[own].tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([v], pa.int64()) for v in values), *(pa.array([b], pa.binary()) for b in blobs)],
                    ["low", "high", "rows", "width", "ids", "labels", "matrix"],
                )

    kind = "low long, high long, rows long, width long, ids binary, labels binary, matrix binary"
    ordered = rows.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id")
    return ordered.mapInArrow(cut, kind)


def _opened(ids, labels, matrix, width):
    return np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(matrix, np.int64).reshape(-1, width)


def _padded(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] == width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


class Heaps:
    """The best `size` (score, id) of each of n places: highest scores first, ties by smaller id."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.scores = np.full((n, size), _NONE, np.int64)
        self.ids = np.full((n, size), np.iinfo(np.int64).max, np.int64)
        self.filled = np.zeros((n, size), bool)

    def offer(self, places: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores (a row for each place, a column for each id, ascending) where allowed."""
        if scores.shape[1] > self.size:
            # What a row's own best and the heap's last rule out needs no sorting.
            full = self.filled[places, -1]
            last = np.where(full, self.scores[places, -1], _NONE)[:, None]
            smaller = ids < np.where(full, self.ids[places, -1], np.iinfo(np.int64).max)[:, None]
            allowed = allowed & ((scores > last) | ((scores == last) & smaller))
            busy = np.flatnonzero(allowed.sum(axis=1) > 4 * self.size)
            if len(busy):
                own = np.where(allowed[busy], scores[busy], _NONE)
                least = np.partition(own, scores.shape[1] - self.size, axis=1)[:, scores.shape[1] - self.size]
                allowed[busy] &= scores[busy] >= least[:, None]
        row, column = np.nonzero(allowed)
        if not len(row):
            return
        rows = np.unique(row)
        held = self.filled[places[rows]]
        old_row = np.repeat(rows, held.sum(axis=1))
        where = np.concatenate((old_row, row))
        value = np.concatenate((self.scores[places[rows]][held], scores[row, column]))
        name = np.concatenate((self.ids[places[rows]][held], ids[column]))
        order = np.lexsort((name, ~value, where))
        where, value, name = where[order], value[order], name[order]
        first = np.searchsorted(where, rows)
        rank = np.arange(len(where)) - np.repeat(first, np.diff(np.append(first, len(where))))
        kept = rank < self.size
        place, rank = places[where[kept]], rank[kept]
        self.filled[places[rows]] = False
        self.scores[place, rank], self.ids[place, rank], self.filled[place, rank] = value[kept], name[kept], True

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, score and id of all that is held."""
        place, rank = np.nonzero(self.filled)
        return place, self.scores[place, rank], self.ids[place, rank]


def _strips(anchors, tile):
    """Strips of anchors with their scores against a tile."""
    ids, labels, matrix = anchors
    own_ids, own_labels, own = tile
    width = max(matrix.shape[1], own.shape[1])
    own = _padded(own, width)
    for at in range(0, len(ids), STRIP):
        part = np.arange(at, min(at + STRIP, len(ids)))
        yield part, _padded(matrix[part], width), own


def _positive_heaps(block, size):
    """A function of batches of tiles: place (of the anchor in the block), score, id of each task's best rows of the same label."""

    def best(batches):
        anchors = _opened(*block.value)
        heaps = Heaps(len(anchors[0]), size)
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, matrix = _opened(row["ids"], row["labels"], row["matrix"], row["width"])
                # Both are sorted by label: only anchors of the tile's labels meet it.
                low, high = np.searchsorted(anchors[1], row["low"]), np.searchsorted(anchors[1], row["high"], "right")
                if low == high:
                    continue
                some = tuple(x[low:high] for x in anchors)
                for part, left, right in _strips(some, (ids, labels, matrix)):
                    mine = np.isin(labels, some[1][part])
                    allowed = (some[1][part][:, None] == labels[mine]) & (some[0][part][:, None] != ids[mine])
                    order = np.argsort(ids[mine], kind="stable")
                    heaps.offer(low + part, strassen(left, right[mine])[:, order], ids[mine][order], allowed[:, order])
        place, score, name = heaps.rows()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(score), pa.array(name)], ["place", "score", "id"])

    return best


def _negative_heaps(block, windows, size):
    """The same for rows of other labels: place is that of a pair (anchor, positive). windows: for each pair the anchor's place,
    least and largest score; pairs of an anchor stand together."""

    def best(batches):
        anchors = _opened(*block.value)
        owner, least, most = windows.value
        heaps = Heaps(len(owner), size)
        bounds = np.searchsorted(owner, np.arange(len(anchors[0]) + 1))
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, matrix = _opened(row["ids"], row["labels"], row["matrix"], row["width"])
                # A tile of one label holds no negative for the anchors of that label.
                needed = np.flatnonzero((np.diff(bounds) > 0) & ((anchors[1] != row["low"]) | (row["low"] != row["high"])))
                some = tuple(x[needed] for x in anchors)
                order = np.argsort(ids, kind="stable")
                for part, left, right in _strips(some, (ids[order], labels[order], matrix[order])):
                    scores = strassen(left, right)
                    other = some[1][part][:, None] != labels[order]
                    pairs = np.diff(bounds)[needed[part]]
                    for j in range(int(pairs.max(initial=0))):
                        has = np.flatnonzero(pairs > j)
                        place = bounds[needed[part[has]]] + j
                        inside = (scores[has] >= least[place][:, None]) & (scores[has] <= most[place][:, None])
                        heaps.offer(place, scores[has], ids[order], inside & other[has])
        place, score, name = heaps.rows()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(score), pa.array(name)], ["place", "score", "id"])

    return best


def _merged(heaps: DataFrame, size: int) -> DataFrame:
    """place, rank, score, id of the heaps of all tasks."""
    order = Window.partitionBy("place").orderBy(F.desc("score"), "id")
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def _blocks(anchors: DataFrame, most: int):
    """Anchors by label and id, a block of tiles at a time."""
    sizes = anchors.select("low", "high", "tile", "rows").orderBy("low", "high", "tile").collect()
    own, held = [], 0
    for row in [*sizes, None]:
        if own and (row is None or held + row["rows"] > most):
            tiles = [_opened(t.ids, t.labels, t.matrix, t.width) for t in anchors.filter(F.col("tile").isin(own)).collect()]
            width = max(t[2].shape[1] for t in tiles)
            ids, labels, matrix = (np.concatenate(x) for x in zip(*[(i, k, _padded(m, width)) for i, k, m in tiles]))
            order = np.lexsort((ids, labels))
            yield ids[order], labels[order], np.ascontiguousarray(matrix[order])
            own, held = [], 0
        if row is not None:
            own.append(row["tile"])
            held += row["rows"]


_HEAP = "place long, score long, id long"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without a vec_id, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths are
    padded with zeros. Rows that repeat count as often as they occur, anchors too; an anchor is no positive of its own
    vec_id. Ties go to the smaller vec_id. An anchor without a positive, or a positive without a row in its window, gives
    no row; an empty table an empty result. Scores must fit 64 bits. Other columns are not read."""
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings)
    tiles = stored(_tiles(rows, TILE), "tiles")
    anchors = _tiles(rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0), TILE)
    anchors = stored(anchors.withColumn("tile", F.monotonically_increasing_id()), "anchors")
    parts = []
    for ids, labels, matrix in _blocks(anchors, block):
        shared = spark.sparkContext.broadcast((ids.tobytes(), labels.tobytes(), matrix.tobytes(), matrix.shape[1]))
        near = tiles.filter((F.col("low") <= int(labels[-1])) & (F.col("high") >= int(labels[0])))
        found = _merged(near.mapInArrow(_positive_heaps(shared, positives), _HEAP), positives)
        # At most `positives` rows for each anchor of the block.
        best = np.array(sorted((r.place, r.rank, r.score, r.id) for r in found.collect()), np.int64).reshape(-1, 4)
        # low * p <= 100 * n <= high * p, in whole numbers.
        windows = (best[:, 0], -((-low * best[:, 2]) // 100), (high * best[:, 2]) // 100)
        heaps = tiles.mapInArrow(_negative_heaps(shared, spark.sparkContext.broadcast(windows), negatives), _HEAP)
        pairs = pa.table({"place": np.arange(len(best)), "anchor_id": ids[best[:, 0]], "positive_id": best[:, 3], "positive_score": best[:, 2]})
        named = _merged(heaps, negatives).join(F.broadcast(spark.createDataFrame(pairs)), "place")
        named = named.select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
        parts.append(named)
    out = spark.createDataFrame([], _RESULT)
    if len(parts) == 1:
        return parts[0]
    for part in parts:
        out = out.union(stored(part, "negatives"))
    return out
