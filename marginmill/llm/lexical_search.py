"""Ranked lexical search by MaxScore with pair bounds: the best documents for each item of a query set, in whole-number scores.

A first pass counts documents, terms and the documents of each query term. In the second pass each task indexes segments of
its documents: postings of the query terms with their impacts, and for pairs of an item's terms that are neighbours in
weight the intersection list with joint impacts and its maximum. Two terms together add at most the larger of the joint
maximum and their own ones, which is less than both maxima wherever they peak in different documents. Units (pairs, or a
last single term) stand by this bound; those that together can't reach the tenth score so far only score documents that others
brought up, and a document leaves as soon as what it has and the bounds of what is left fall short. Lists of the best of
each task are merged.

Items are the query set. Their terms are broadcast in blocks of bounded size, each with its own passes over the documents.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words

BEST = 10
#: Items to a block.
BLOCK_ITEMS = 2_000
#: A segment ends with this many postings of query terms, or documents.
SEGMENT_POSTINGS, SEGMENT_DOCS = 2_000_000, 50_000
_TERMS = words.byte_table(words.PUNCTUATION)
_LAST = np.iinfo(np.int64).max


@dataclass
class Queries:
    """Items by number; vocabulary: hashes of all their terms, sorted; terms: those of each item, as places in it."""

    ids: list[int | None]
    vocabulary: np.ndarray
    terms: list[np.ndarray]


@dataclass
class Statistics:
    """documents with a term, terms of all documents, and the weight of each term of the vocabulary."""

    documents: int
    terms: int
    weights: np.ndarray


def _queries(ids: list, texts: pa.Array) -> Queries:
    own = []
    for block in words.word_blocks(texts, _TERMS):
        own += [np.unique(block.hashes[low:high]) for low, high in zip(block.bounds, block.bounds[1:])]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
    return Queries(ids, vocabulary, [np.searchsorted(vocabulary, x) for x in own])


def _blocks(items: DataFrame, most: int):
    ids, texts = [], []
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for item, text in rows.filter("text IS NOT NULL").toLocalIterator():
        ids.append(item)
        texts.append(text)
        if len(ids) == most:
            yield _queries(ids, pa.array(texts, pa.string()))
            ids, texts = [], []
    if ids:
        yield _queries(ids, pa.array(texts, pa.string()))


def _term_counts(texts: pa.Array, vocabulary: np.ndarray):
    """Terms of each text, and row, term (its place in the vocabulary), tf of the query terms among them, by row."""
    short = np.zeros(1 << 16, bool)  # most other terms end here, before the search
    short[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    lengths, keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = len(vocabulary)
    for block in words.word_blocks(texts, _TERMS):
        n = np.diff(block.bounds)
        lengths.append(n)
        maybe = np.flatnonzero(short[(block.hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(vocabulary, block.hashes[maybe])
        hit = vocabulary[np.minimum(at, size - 1)] == block.hashes[maybe] if size else at < 0
        row = np.searchsorted(block.bounds, maybe[hit], "right") - 1 + block.first_row
        key, tf = np.unique(row * size + at[hit], return_counts=True)
        keys.append(key)
        times.append(tf)
    key = np.concatenate(keys)
    return np.concatenate(lengths), key // max(size, 1), key % max(size, 1), np.concatenate(times)


def _counted(vocabulary):
    """term, n: documents of each term in a task; at -1 the documents with a term, at -2 all their terms."""

    def count(batches):
        known = vocabulary.value
        found, documents, terms = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            lengths, _, term, _ = _term_counts(batch.column(0), known)
            documents += int((lengths > 0).sum())
            terms += int(lengths.sum())
            found += np.bincount(term, minlength=len(known))
        have = np.flatnonzero(found)
        keys, n = [*have.tolist(), -1, -2], [*found[have].tolist(), documents, terms]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["term", "n"])

    return count


def statistics(docs: DataFrame, vocabulary: np.ndarray) -> Statistics:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_counted(shared), "term long, n long")
    # One row for each term of the block.
    total = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, terms = total.get(-1, 0), total.get(-2, 0)
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * total.get(t, 0) + 1))) for t in range(len(vocabulary))]
    return Statistics(documents, terms, np.array(weights, np.int64))


def paired(terms: np.ndarray, weights: np.ndarray) -> list[tuple[int, ...]]:
    """The terms of an item by weight, two by two; an odd one stands alone."""
    order = terms[np.argsort(weights[terms], kind="stable")].tolist()
    return [tuple(order[i : i + 2]) for i in range(0, len(order), 2)]


class Segment:
    """Postings of some documents, by term, and the intersection lists of term pairs."""

    def __init__(self, lengths, row, term, tf, statistics_: Statistics, pairs):
        self.size = len(lengths)
        norm = 10 + (90 * lengths * statistics_.documents) // max(statistics_.terms, 1)
        impact = statistics_.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[row]))
        order = np.lexsort((row, term))
        self.rows, self.impacts = row[order], impact[order]
        self.bounds = np.searchsorted(term[order], np.arange(len(statistics_.weights) + 1))
        self.most = np.zeros(len(statistics_.weights), np.int64)
        have = np.flatnonzero(np.diff(self.bounds))
        if len(have):
            self.most[have] = np.maximum.reduceat(self.impacts, self.bounds[have])
        self.joint = {pair: self._intersection(*pair) for pair in pairs if len(pair) == 2}

    def postings(self, t):
        own = slice(self.bounds[t], self.bounds[t + 1])
        return self.rows[own], self.impacts[own]

    def _intersection(self, a, b):
        """Documents with both terms, their joint impacts, and the most that a document gets from the two."""
        (rows_a, impacts_a), (rows_b, impacts_b) = self.postings(a), self.postings(b)
        if not len(rows_a) or not len(rows_b):
            return rows_a[:0], impacts_a[:0], max(self.most[a], self.most[b])
        at = np.minimum(np.searchsorted(rows_b, rows_a), len(rows_b) - 1)
        both = rows_b[at] == rows_a
        joint = impacts_a[both] + impacts_b[at[both]]
        return rows_a[both], joint, max(self.most[a], self.most[b], joint.max(initial=0))

    def bound(self, unit):
        return self.joint[unit][2] if len(unit) == 2 else self.most[unit[0]]

    def search(self, units, threshold: int, best: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of all documents that can be among the `best` and reach the threshold."""
        units = sorted(units, key=self.bound)
        upto = np.cumsum([0] + [self.bound(u) for u in units])  # upto[i]: the most that the first i units add
        essential = int(np.searchsorted(upto, threshold, "left")) - 1
        score = np.zeros(self.size, np.int64)
        for unit in units[max(essential, 0) :]:
            for t in unit:
                rows, impacts = self.postings(t)
                score[rows] += impacts
        found = np.flatnonzero(score)
        score = score[found]
        for i in range(essential - 1, -1, -1):
            if len(score) >= best:
                threshold = max(threshold, int(np.partition(score, len(score) - best)[len(score) - best]))
            kept = score + upto[i + 1] >= threshold
            found, score = found[kept], score[kept]
            if not len(found):
                break
            unit = units[i]
            if len(unit) == 1:
                score = score + _values(*self.postings(unit[0]), found)
                continue
            rows, joint, _ = self.joint[unit]
            both = _values(rows, joint, found)
            # A document that is not in the intersection gets one of the two at most.
            alone = max(self.most[t] for t in unit)
            kept = (both > 0) | (score + alone + upto[i] >= threshold)
            found, score, both = found[kept], score[kept], both[kept]
            single = np.flatnonzero(both == 0)
            for t in unit:
                both[single] += _values(*self.postings(t), found[single])
            score = score + both
        kept = score >= threshold
        return found[kept], score[kept]


def _values(rows, impacts, wanted):
    """The impact of each wanted row, 0 where it has none."""
    if not len(rows):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(rows, wanted), len(rows) - 1)
    return np.where(rows[at] == wanted, impacts[at], 0)


def _searched(queries, best):
    """item (its number), score, missing (whether the document has no id), doc_id: the best of a task for each item."""

    def search(batches):
        own, statistics_ = queries.value
        units = [paired(t, statistics_.weights) for t in own.terms]
        pairs = {u for some in units for u in some}
        held = [(np.zeros(0, np.int64),) * 2] * len(units)  # key of a document (its id), score
        parts, postings, documents = [], 0, 0

        def flush():
            at = np.cumsum([0] + [len(p[0]) for p in parts])
            row = np.concatenate([p[1] + k for p, k in zip(parts, at)])
            lengths, term, tf, ids = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4))
            segment = Segment(lengths, row, term, tf, statistics_, pairs)
            for i, some in enumerate(units):
                keys, scores = held[i]
                threshold = max(1, int(scores[-1])) if len(scores) == best else 1
                rows, new = segment.search(some, threshold, best)
                if len(rows):
                    keys, scores = np.concatenate((keys, ids[rows])), np.concatenate((scores, new))
                    order = np.lexsort((keys, -scores))[:best]
                    held[i] = keys[order], scores[order]

        for batch in batches:
            lengths, row, term, tf = _term_counts(batch.column(1), own.vocabulary)
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            parts.append((lengths, row, term, tf, ids))
            postings, documents = postings + len(row), documents + len(ids)
            if postings >= SEGMENT_POSTINGS or documents >= SEGMENT_DOCS:
                flush()
                parts, postings, documents = [], 0, 0
        if parts:
            flush()
        item = np.repeat(np.arange(len(held)), [len(k) for k, _ in held])
        keys, scores = (np.concatenate([np.zeros(0, np.int64), *(h[i] for h in held)]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(scores), pa.array(keys, mask=keys == _LAST)], ["item", "score", "doc_id"]
        )

    return search


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the `best` documents of each item, highest scores first, ties by smaller doc_id.

    Null texts have no terms. Every row of items is an item of its own, also where ids repeat or are null; items without a
    term, or whose terms no document has, give no row. Every row of docs is a document of its own; one without an id comes last
    among equal scores. Other columns are not read; an empty table gives an empty result."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for queries in _blocks(items, block_items):
        found = statistics(docs, queries.vocabulary)
        shared = spark.sparkContext.broadcast((queries, found))
        lists = texts.mapInArrow(_searched(shared, best), "item long, score long, doc_id long")
        # Tasks by the hundred first, so that no item's lists of all tasks meet at once.
        for keys in (["item", F.pmod(F.spark_partition_id(), F.lit(100))], ["item"]):
            order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
        names = pa.table({"item": pa.array(range(len(queries.ids)), pa.int64()), "item_id": pa.array(queries.ids, pa.int64())})
        # One row for each item of the block.
        named = lists.join(F.broadcast(spark.createDataFrame(names)), "item")
        named = named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = named if out is None else out.union(named)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
