"""Benchmark decontamination: an FM-index over each shard of the training texts, searched for all test phrases.

A shard is some MB of documents of one task. Its sequence holds the runs of words that the test items know, apart from each
other by a break; a word that no item has, and a run shorter than every phrase, cannot be part of an occurrence and is
left out of the index. Phrases (windows of WINDOW words of an item, or a shorter item whole) are searched backwards
through the ranks of a wavelet matrix, all at once, and their occurrences located by sampled suffix positions; overlapping
ones merge to removal spans. Documents are read once and not shuffled.

The phrases are the query set. They reach the tasks as broadcast blocks of bounded size, each searched in turn in the
same index; the driver holds one block of items at a time, and for all of them the hashes of distinct words.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .fm_index import FMIndex

WINDOW = 10
#: Items to a block of phrases.
BLOCK_ITEMS = 20_000


@dataclass
class Phrases:
    """Distinct phrases as rows of word hashes, and the items that have them: those of phrase p are
    items[bounds[p]:bounds[p + 1]], numbers into names."""

    hashes: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    names: list[str]


def _phrases(names: list[str], texts: pa.Array, window: int) -> Phrases:
    rows, owners, lengths = [], [], []
    for block in words.word_blocks(texts, words.byte_table(words.PUNCTUATION)):
        for r in range(len(block.bounds) - 1):
            own = block.hashes[block.bounds[r] : block.bounds[r + 1]]
            if not len(own):
                continue
            size = min(window, len(own))
            found = np.lib.stride_tricks.sliding_window_view(own, size)
            rows.append(np.pad(found, ((0, 0), (0, window - size))))
            owners.append(np.full(len(found), block.first_row + r))
            lengths.append(np.full(len(found), size))
    if not rows:
        return Phrases(np.zeros((0, window), np.uint64), *(np.zeros(k, np.int64) for k in (0, 1, 0)), names)
    keys = np.column_stack((np.concatenate(rows), np.concatenate(lengths).astype(np.uint64)))
    distinct, which = np.unique(keys, axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack((which.ravel(), np.concatenate(owners))), axis=0)
    bounds = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    return Phrases(distinct[:, :window], distinct[:, window].astype(np.int64), bounds, pairs[:, 1], names)


def _blocks(benchmark: DataFrame, window: int, block_items: int):
    """Phrases of all items, a block of items at a time."""
    names, texts = [], []
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for name, text in rows.filter("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        names.append(name)
        texts.append(text)
        if len(names) == block_items:
            yield _phrases(names, pa.array(texts, pa.string()), window)
            names, texts = [], []
    if names:
        yield _phrases(names, pa.array(texts, pa.string()), window)


class _Shard:
    """Words of a batch of texts, and the index of those that phrases know."""

    def __init__(self, texts: pa.Array, vocabulary: np.ndarray, shortest: int):
        blocks = list(words.word_blocks(texts, words.byte_table(words.PUNCTUATION)))
        self.n_words = np.concatenate([np.zeros(0, np.int64), *(np.diff(b.bounds) for b in blocks)])
        self.bounds = np.concatenate(([0], np.cumsum(self.n_words)))
        base = np.cumsum([0] + [len(b.data) for b in blocks])
        self.starts = np.concatenate([np.zeros(0, np.int64), *(b.starts + k for b, k in zip(blocks, base))])
        self.ends = np.concatenate([np.zeros(0, np.int64), *(b.ends + k for b, k in zip(blocks, base))])
        known = [np.zeros(0, np.int64)]
        short = np.zeros(1 << 16, bool)  # most unknown words end here, before the search
        short[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        for b in blocks:
            symbol = np.zeros(len(b.hashes), np.int64)
            maybe = np.flatnonzero(short[(b.hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.searchsorted(vocabulary, b.hashes[maybe])
            hit = vocabulary[np.minimum(at, len(vocabulary) - 1)] == b.hashes[maybe] if len(vocabulary) else at < 0
            symbol[maybe[hit]] = at[hit] + 2
            known.append(symbol)
        symbols = np.concatenate(known)
        # Runs of known words; a row's first word begins one.
        inside = symbols > 0
        first_of_row = np.zeros(len(symbols) + 1, bool)
        first_of_row[self.bounds] = True
        begins = inside & (first_of_row[:-1] | ~np.concatenate(([False], inside[:-1])))
        ends = inside & (first_of_row[1:] | ~np.concatenate((inside[1:], [False])))
        low, high = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        enough = high - low >= shortest
        low, lengths = low[enough], (high - low)[enough]
        # Each run is followed by a break, symbol 1.
        place = np.concatenate(([0], np.cumsum(lengths + 1)))
        sequence = np.ones(place[-1], np.int64)
        self.word = np.full(place[-1], -1, np.int64)
        inner = np.repeat(place[:-1], lengths) + words.count_up(lengths)
        self.word[inner] = np.repeat(low, lengths) + words.count_up(lengths)
        sequence[inner] = symbols[self.word[inner]]
        self.index = FMIndex(sequence, len(vocabulary) + 2) if len(sequence) else None

    def occurrences(self, phrases: Phrases, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and first word of each occurrence."""
        if self.index is None or not len(phrases.lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Padding gets any symbol; lengths keep it out of the search.
        symbols = np.minimum(np.searchsorted(vocabulary, phrases.hashes) + 2, len(vocabulary) + 1)
        low, high = self.index.search(symbols, phrases.lengths)
        times = np.maximum(high - low, 0)
        rows = np.repeat(low, times) + words.count_up(times)
        return np.repeat(np.arange(len(times)), times), self.word[self.index.locate(rows)]


def _search(texts: pa.Array, blocks, vocabulary: np.ndarray, shortest: int) -> pa.Array:
    shard = _Shard(texts, vocabulary, shortest)
    n = len(texts)
    edge = np.zeros(len(shard.starts) + 1, np.int64)
    items: list[list[str]] = [[] for _ in range(n)]
    for shared in blocks:
        phrases = shared.value
        which, first = shard.occurrences(phrases, vocabulary)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + phrases.lengths[which], -1)
        row = np.searchsorted(shard.bounds, first, "right") - 1
        pairs = np.unique(row * len(phrases.lengths) + which) if len(row) else row
        for pair in pairs.tolist():
            r, p = divmod(pair, len(phrases.lengths))
            items[r].extend(phrases.names[i] for i in phrases.items[phrases.bounds[p] : phrases.bounds[p + 1]])
    hit = np.cumsum(edge)[:-1] > 0
    n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[shard.bounds])
    names = [sorted(set(x)) for x in items]
    # Spans: runs of hit words within a row, as bytes of the row's text.
    data, offsets = words.text_bytes(texts)
    first_of_row = np.zeros(len(hit) + 1, bool)
    first_of_row[shard.bounds] = True
    begins = np.flatnonzero(hit & (first_of_row[:-1] | ~np.concatenate(([False], hit[:-1]))))
    ends = np.flatnonzero(hit & (first_of_row[1:] | ~np.concatenate((hit[1:], [False]))))
    row = np.searchsorted(shard.bounds, begins, "right") - 1
    low, high = shard.starts[begins], shard.ends[ends]
    # Only changed texts are copied; null elsewhere.
    cleaned: list[str | None] = [None] * n
    for r in np.unique(row).tolist():
        parts, at = [], offsets[r]
        for i in np.flatnonzero(row == r):
            parts.append(data[at : low[i]].tobytes())
            at = high[i]
        cleaned[r] = b"".join([*parts, data[at : offsets[r + 1]].tobytes()]).decode()
    spans = pa.StructArray.from_arrays([pa.array(low - offsets[row]), pa.array(high - offsets[row])], ["start", "end"])
    span_bounds = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    columns = {
        "n_words": pa.array(shard.n_words),
        "n_hit": pa.array(n_hit),
        "n_items": pa.array([len(x) for x in names], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
        "items": pa.array(names, pa.list_(pa.string())),
        "spans": pa.ListArray.from_arrays(span_bounds, spans),
        "cleaned": pa.array(cleaned, pa.string()),
    }
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def contamination_of(benchmark: DataFrame, window: int = WINDOW, block_items: int = BLOCK_ITEMS):
    """A column function of a text column that finds the phrases of the benchmark's items in it: struct of n_words,
    n_hit (words in occurrences), n_items, items_sha256, items (ids as strings, sorted), spans (first byte and end of
    each merged run of hit words, in UTF-8) and cleaned (the text without the spans; a text without any as it is).

    Null has no words; items without an id, a text or a word are not searched; items may repeat.
    """
    search = _search_of(benchmark, window, block_items)

    def found_in(text):
        found, text = search(text), F.col(text) if isinstance(text, str) else text
        return found.withField("cleaned", F.coalesce(found["cleaned"], text))

    return found_in


def _search_of(benchmark: DataFrame, window: int = WINDOW, block_items: int = BLOCK_ITEMS):
    """contamination_of, but `cleaned` is null where a text has no spans: tasks copy only the texts they change."""
    context = benchmark.sparkSession.sparkContext
    blocks, vocabulary, shortest = [], np.zeros(0, np.uint64), window
    for phrases in _blocks(benchmark, window, block_items):
        if not len(phrases.lengths):
            continue
        real = np.arange(window) < phrases.lengths[:, None]
        vocabulary = np.union1d(vocabulary, phrases.hashes[real])
        shortest = min(shortest, int(phrases.lengths.min()))
        blocks.append(context.broadcast(phrases))
    known = context.broadcast(vocabulary)
    kind = (
        "n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, "
        "spans array<struct<start: long, end: long>>, cleaned string"
    )

    @F.arrow_udf(kind)
    def search(texts: pa.Array) -> pa.Array:
        return words.in_slices(lambda t: _search(t, blocks, known.value, shortest), texts)

    return search


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row, repeated ids included."""
    found = docs.select("doc_id", _search_of(benchmark)("text").alias("found"))
    wanted = [F.col(f"found.{c}") for c in ("n_words", "n_hit", "n_items", "items_sha256")]
    return found.select("doc_id", *wanted, (F.col("found.n_hit") > 0).alias("contaminated"))


def without_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows, with occurrences of test phrases cut from their texts and n_chars, if it is there, counted anew. A row
    whose words were all hit goes; clean rows stay as they are."""
    name = "_contamination"
    while name in docs.columns:
        name += "_"
    # Not deterministic to the planner, or the filter would search each text anew, in a second worker beside the first.
    found = docs.withColumn(name, _search_of(benchmark).asNondeterministic()("text"))
    found = found.filter((F.col(f"{name}.n_hit") == 0) | (F.col(f"{name}.n_hit") < F.col(f"{name}.n_words")))
    hit = F.col(f"{name}.n_hit") > 0
    changed = {"text": F.when(hit, F.col(f"{name}.cleaned")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(hit, F.length(F.col(f"{name}.cleaned")).cast(kind)).otherwise(F.col("n_chars"))
    return found.withColumns(changed).drop(name)
