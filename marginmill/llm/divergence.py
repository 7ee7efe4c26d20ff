"""Quality rules by distribution divergence: how far a text's characters and common words are from those of known languages.

A language's reference is two histograms, counted over all labelled documents: one over classes of characters, one over
the language's COMMON most frequent words and the rest. A text is compared with every reference by the Jensen-Shannon
distance (the root of the divergence to base 2, 0 to 1). It passes if, for one language, both distances are within their limits.
A histogram of few draws lies away from its source by chance, about as the root of the number of bins over the number of draws:
limits are wider by that much, and below a minimum length a histogram is no ground to reject.

Plain counts come with it: symbols, repeated lines and repeated windows of words.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .shared import stored

#: Most frequent words of a language that have a bin of their own.
COMMON = 64
#: Languages that get a reference at most (those with the most words), and the words one needs to be trusted.
MOST_LANGUAGES, LEAST_REFERENCE = 256, 2_000
#: Lengths from which a histogram counts.
LEAST_CHARS, LEAST_WORDS = 100, 20
#: Largest distances of a kept text, besides what its length explains. References that junk has a part in are farther from
#: good texts: while they are counted, characters have a wider limit.
CHAR_LIMIT, WORD_LIMIT, FIRST_CHAR_LIMIT = 0.14, 0.45, 0.2
FEWEST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

SYMBOLS = b"#*$%&|<>"
#: Classes of characters by their first byte in UTF-8.
CLASSES = [
    bytes(range(ord("a"), ord("z") + 1)),
    bytes(range(ord("A"), ord("Z") + 1)),
    b"0123456789",
    b" ",
    b"\n\t\x0b\x0c\r",
    b".,;:",
    b"!?",
    b"'\"-()",
    SYMBOLS,
    b"/\\@=+_~^`[]{}",
    bytes(range(0xC2, 0xCA)),  # accented Latin
    bytes(range(0xCA, 0xE0)),  # other alphabets
    bytes(range(0xE0, 0xE3)),  # scripts of South Asia, marks
    bytes(range(0xE3, 0xF0)),  # East Asia
    bytes(range(0xF0, 0xF8)),
]
OTHER = len(CLASSES)  # control characters
_CLASS = np.full(256, OTHER, np.int64)
for _number, _bytes in enumerate(CLASSES):
    _CLASS[list(_bytes)] = _number
_CLASS[0x80:0xC0] = -1  # inside a character
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_EXACT = words.byte_table(words.SPACES, fold_case=False)
_LINES = words.byte_table(b"\n", fold_case=False)
_TERMS = words.byte_table(words.PUNCTUATION)
#: The key of a language's words in all, beside its classes.
ALL_WORDS = -1
#: Distinct words that a task counts before it sends what it has.
MOST_COUNTED = 500_000


@dataclass
class References:
    """One row for each language: shares of character classes, and of its own common words (hashes, sorted) and the rest."""

    names: list[str]
    classes: np.ndarray
    common: list[np.ndarray]
    shares: list[np.ndarray]


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each class in each row."""
    n = len(offsets) - 1
    kind = _CLASS[data]
    row = np.repeat(np.arange(n), np.diff(offsets))
    first = kind >= 0
    return np.bincount(row[first] * (OTHER + 1) + kind[first], minlength=n * (OTHER + 1)).reshape(n, OTHER + 1)


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[bounds])


def _later_equal(keys: np.ndarray) -> np.ndarray:
    """Which keys stand earlier in the array too."""
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return later


def _keyed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return words.mix(hashes ^ words.mix(rows.astype(np.uint64), 0x632BE59BD9B4E019))


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    parts = []
    lines = words.word_blocks(texts, _LINES)
    for block, own in zip(words.word_blocks(texts, _EXACT), lines):
        n = len(block.bounds) - 1
        n_words = np.diff(block.bounds)
        # Code points of words: bytes that begin a character and are no white space.
        character = (_EXACT[block.data] != 0) & ((block.data & 0xC0) != 0x80)
        # Lines with a word that an earlier line equals.
        worded = np.concatenate(([0], np.cumsum(_EXACT[block.data] != 0)))
        full = worded[own.ends] > worded[own.starts]
        row = np.repeat(np.arange(n), np.diff(own.bounds))
        again = np.zeros(len(full), bool)
        again[full] = _later_equal(_keyed(own.hashes[full], row[full]))
        # Words in windows that occur twice or more.
        repeated = np.zeros(len(block.hashes), bool)
        if len(block.hashes) >= WINDOW:
            row_of = np.repeat(np.arange(n), n_words)
            starts = np.flatnonzero(row_of[: len(row_of) - WINDOW + 1] == row_of[WINDOW - 1 :])
            factors = words.mix(np.arange(WINDOW, dtype=np.uint64), 0xD1342543DE82EF95) | np.uint64(1)
            window = np.zeros(len(starts), np.uint64)
            for j in range(WINDOW):
                window += block.hashes[starts + j] * factors[j]
            _, which, times = np.unique(_keyed(words.mix(window), row_of[starts]), return_inverse=True, return_counts=True)
            twice = starts[times[which.ravel()] > 1]
            edge = np.zeros(len(block.hashes) + 1, np.int64)
            edge[twice] += 1
            np.add.at(edge, twice + WINDOW, -1)
            repeated = np.cumsum(edge)[:-1] > 0
        parts.append(
            {
                "n_words": n_words,
                "word_chars": _per_row(character, block.offsets),
                "n_symbols": _per_row(_IS_SYMBOL[block.data], block.offsets),
                "n_dup_lines": _per_row(again, own.bounds),
                "n_repeat_words": _per_row(repeated, block.bounds),
            }
        )
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return {c: np.concatenate([np.zeros(0, np.int64), *(p[c] for p in parts)]) for c in names}


def _entropy(shares: np.ndarray) -> np.ndarray:
    return -(shares * np.log2(np.where(shares > 0, shares, 1.0))).sum(axis=-1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of two histograms of shares, along the last axis."""
    found = _entropy((p + q) / 2) - (_entropy(p) + _entropy(q)) / 2
    return np.sqrt(np.clip(found, 0.0, 1.0))


def _shares(counts_: np.ndarray) -> np.ndarray:
    return counts_ / np.maximum(counts_.sum(axis=1, keepdims=True), 1)


def _judge(texts: pa.Array, references: References, limits: tuple[float, float]) -> pa.Array:
    found = counts(texts)
    n, languages = len(texts), len(references.names)
    data, offsets = words.text_bytes(texts)
    classes, chars = [], []
    ranks = [np.zeros((n, len(common) + 1), np.int64) for common in references.common]
    terms = np.zeros(n, np.int64)
    for block in words.word_blocks(texts, _TERMS):
        rows = slice(block.first_row, block.first_row + len(block.bounds) - 1)
        classes.append(_class_counts(block.data, block.offsets))
        terms[rows] = np.diff(block.bounds)
        row_of = np.repeat(np.arange(len(block.bounds) - 1), terms[rows])
        for common, into in zip(references.common, ranks):
            at = np.minimum(np.searchsorted(common, block.hashes), max(len(common) - 1, 0))
            place = np.where(common[at] == block.hashes, at, len(common)) if len(common) else np.zeros(len(block.hashes), np.int64)
            bins = len(common) + 1
            into[rows] = np.bincount(row_of * bins + place, minlength=into[rows].size).reshape(-1, bins)
    classes = np.concatenate([np.zeros((0, OTHER + 1), np.int64), *classes])
    chars = classes.sum(axis=1)
    # Distances to all languages, and their limits.
    char_distance = distance(_shares(classes)[:, None, :], references.classes[None, :, :])
    word_distance = np.column_stack([distance(_shares(r), s) for r, s in zip(ranks, references.shares)] or [np.zeros((n, 0))])
    char_noise = np.sqrt((OTHER + 1) / (8 * np.log(2) * np.maximum(chars, 1)))
    word_noise = np.sqrt((COMMON + 1) / (8 * np.log(2) * np.maximum(terms, 1)))
    char_over = np.where(chars[:, None] >= LEAST_CHARS, char_distance - limits[0] - char_noise[:, None], 0.0)
    word_over = np.where(terms[:, None] >= LEAST_WORDS, word_distance - limits[1] - word_noise[:, None], 0.0)
    over = np.maximum(char_over, word_over)
    nearest = over.argmin(axis=1) if languages else np.zeros(n, np.int64)
    pick = (np.arange(n), nearest)
    base_failed = (found["n_words"] < FEWEST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])
    near = over[pick] <= 0 if languages else np.ones(n, bool)
    columns = {c: pa.array(v) for c, v in found.items()}
    columns["base_failed"] = pa.array(base_failed)
    columns["kept"] = pa.array(~base_failed & near)
    none = pa.nulls(n, pa.string()), pa.nulls(n, pa.float64())
    columns["nearest"] = pa.array(np.array(references.names, object)[nearest], pa.string()) if languages else none[0]
    columns["char_distance"] = pa.array(char_distance[pick]) if languages else none[1]
    columns["word_distance"] = pa.array(word_distance[pick]) if languages else none[1]
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def _count_batches(batches):
    """lang, kind (0: class, or all words, 1: word), key, n: what a task's texts hold, summed before it is sent."""
    languages: dict[str, int] = {}
    held, totals = [np.zeros((0, 3), np.int64)], {}

    def summed(parts):
        every = np.concatenate(parts)
        order = np.lexsort((every[:, 1], every[:, 0]))
        every = every[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
        n = np.add.reduceat(every[:, 2], np.flatnonzero(new)) if len(every) else every[:, 2]
        return np.column_stack((every[new][:, :2], n))

    def sent(rows):
        names = np.array(list(languages), object)
        keys = [(i, k, c) for (i, k), c in totals.items()]
        extra = np.array(keys, np.int64).reshape(-1, 3)
        every = np.concatenate((rows, extra))
        kind = np.concatenate((np.ones(len(rows), np.int32), np.zeros(len(extra), np.int32)))
        return pa.RecordBatch.from_arrays(
            [pa.array(names[every[:, 0]] if len(every) else [], pa.string()), pa.array(kind), pa.array(every[:, 1]), pa.array(every[:, 2])],
            ["lang", "kind", "key", "n"],
        )

    for batch in batches:
        lang, text = batch.column(0), batch.column(1)
        codes = np.array([languages.setdefault(x, len(languages)) for x in lang.to_pylist()], np.int64)
        for block in words.word_blocks(text, _TERMS):
            rows = codes[block.first_row : block.first_row + len(block.bounds) - 1]
            classes = _class_counts(block.data, block.offsets)
            for i in np.unique(rows).tolist():
                for k, c in enumerate(classes[rows == i].sum(axis=0).tolist()):
                    if c:
                        totals[i, k] = totals.get((i, k), 0) + c
            of = np.repeat(rows, np.diff(block.bounds))
            for i, c in enumerate(np.bincount(of).tolist()):
                if c:
                    totals[i, ALL_WORDS] = totals.get((i, ALL_WORDS), 0) + c
            held.append(np.column_stack((of, block.hashes.view(np.int64), np.ones(len(of), np.int64))))
            if sum(map(len, held[1:])) > MOST_COUNTED:
                held = [summed(held)]
                if len(held[0]) > MOST_COUNTED:
                    yield sent(held[0])
                    held, totals = [np.zeros((0, 3), np.int64)], {}
    yield sent(summed(held))


def language_references(docs: DataFrame, common: int = COMMON, rounds: int = 2) -> References:
    """References from all rows with lang and text; each further round counts anew, without the texts that the references
    before it reject, so that junk of one kind leaves no mark in them. The driver gets at most MOST_LANGUAGES * (common + classes)
    rows."""
    labelled = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    references = _references(labelled, common)
    for _ in range(rounds - 1):
        kept = divergence_of(references, FIRST_CHAR_LIMIT)("text")
        references = _references(labelled.filter(kept["kept"]), common)
    return references


def _references(labelled: DataFrame, common: int) -> References:
    counted = labelled.mapInArrow(_count_batches, "lang string, kind int, key long, n long")
    summed = counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    most = F.when(F.col("kind") == 1, common).otherwise(OTHER + 2)
    placed = summed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.greatest(F.lit(common), F.lit(OTHER + 2)))
    # Written, as it is read twice: some rows for each language.
    placed = stored(placed.filter(F.col("place") <= most), "references")
    sizes = placed.filter((F.col("kind") == 0) & (F.col("key") == ALL_WORDS)).select("lang", F.col("n").alias("words"))
    sizes = sizes.filter(F.col("words") >= LEAST_REFERENCE).orderBy(F.desc("words"), "lang").limit(MOST_LANGUAGES)
    rows = placed.join(F.broadcast(sizes), "lang").collect()
    names = sorted({r.lang for r in rows})
    classes = np.zeros((len(names), OTHER + 1))
    hashes, shares = [], []
    for i, name in enumerate(names):
        own = [r for r in rows if r.lang == name]
        for r in own:
            if r.kind == 0 and r.key != ALL_WORDS:
                classes[i, r.key] = r.n
        best = sorted((np.int64(r.key).view(np.uint64), r.n) for r in own if r.kind == 1)
        total = own[0].words
        hashes.append(np.array([h for h, _ in best], np.uint64))
        shares.append(np.array([n for _, n in best] + [total - sum(n for _, n in best)]) / total)
    return References(names, _shares(classes), hashes, shares)


_KIND = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "nearest string, char_distance double, word_distance double"
)


def divergence_of(references: References, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT):
    """A column function of a text column: the struct of counts, verdict, nearest language and distances to it."""

    @F.arrow_udf(f"struct<{_KIND.replace(' long', ': long').replace(' double', ': double').replace(' boolean', ': boolean').replace(' string', ': string')}>")
    def judged(texts: pa.Array) -> pa.Array:
        return words.in_slices(lambda t: _judge(t, references, (char_limit, word_limit)), texts)

    return judged


def rate_divergence(docs: DataFrame, references: References | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, nearest, char_distance and
    word_distance for every row.

    kept: enough words, few repeated ones, and near to some language. Null text has no words: all counts are 0 and
    it is not kept. Texts shorter than a guard are judged without that histogram; without references (no labelled text) by the
    counts alone: nearest and distances are null then. Repeated rows, ids and null ids are rows of their own; other
    columns are not read; an empty table gives an empty result."""
    found = language_references(docs) if references is None else references
    judged = docs.select("doc_id", divergence_of(found)(F.col("text").cast("string")).alias("found"))
    return judged.select("doc_id", "found.*")
