"""Language identification of whole, possibly mixed-language texts.

A word is a run of letters of one script, so the script of its characters, told by ranges of code points, narrows the candidate
languages; each candidate scores it by the log probabilities of its byte trigrams; a Viterbi pass over the words of a text, with a penalty for each switch,
labels every word, and so the spans of each language. The language of most letters is that of the text.

The model is counts of hashed trigrams for each language: `languages` x 32,768 numbers, whatever the size of the
corpus, and counted over all labelled rows. It is the one thing that reaches the driver.
"""

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import give_back, in_slices, keep, row_blocks, text_bytes

BUCKETS = 1 << 15
#: Bytes whose trigrams are worked out at once: many numbers for each byte, while several workers share an executor's memory.
SCORED_BYTES = 1 << 18
SWITCH_PENALTY = 10.0
#: A language is a candidate for a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"
#: The score of a trigram where all are equally likely. Texts that fit their labels no better fit no learned language.
LEAST_FIT = -math.log(BUCKETS)

#: Ranges of code points (first, last) of the scripts. Fixed values of Unicode. What is no letter in a range is in no script.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0x2AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F), (0xFB13, 0xFB17)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)],
    "Syriac": [(0x700, 0x74F), (0x860, 0x86F)],
    "Thaana": [(0x780, 0x7BF)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Oriya": [(0xB00, 0xB7F)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xFFA0, 0xFFDC)],
    "Ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Mongolian": [(0x1800, 0x18AF)],
    "Kana": [(0x3031, 0x3035), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "Bopomofo": [(0x3100, 0x312F), (0x31A0, 0x31BF)],
    "Han": [(0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
#: No script, the scripts in order, letters of any other script.
N_SCRIPTS = len(SCRIPTS) + 2
#: Marks have the script of the character before.
MARK = 255
#: No letter has a code point of this or above.
END_OF_LETTERS = 0x32400


@lru_cache
def script_table() -> np.ndarray:
    """The script of every code point below END_OF_LETTERS, 0 for what is no letter and MARK for marks."""
    kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(END_OF_LETTERS)], np.uint8)
    scripts = np.full(END_OF_LETTERS, N_SCRIPTS - 1, np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            scripts[first : last + 1] = number
    scripts[kinds != ord("L")] = 0
    scripts[kinds == ord("M")] = MARK
    return scripts


def scripts_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The script of each character of some texts in UTF-8, and its number of bytes."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    sizes = np.diff(np.append(lead, len(data)))
    code = data[lead].astype(np.int32)
    for size, bits in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        at = np.flatnonzero(sizes == size)
        value = code[at] & bits
        for step in range(1, size):
            value = value << 6 | data[lead[at] + step] & 0x3F
        code[at] = value
    scripts = np.where(code < END_OF_LETTERS, script_table()[np.minimum(code, END_OF_LETTERS - 1)], 0)
    first = np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])
    scripts[first[scripts[first] == MARK]] = 0
    marks = np.flatnonzero(scripts == MARK)
    if len(marks):
        base = np.arange(len(scripts))
        base[marks] = 0
        scripts = scripts[np.maximum.accumulate(base)]
    return scripts, sizes


class _Words:
    """Words of some rows: trigram buckets of their bytes, and the script of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        by_character, sizes = scripts_of(data, offsets)
        script = np.repeat(by_character, sizes)
        inside = script > 0
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        joined = np.zeros(n, bool)  # a byte that goes on with the word of the byte before
        joined[1:] = inside[1:] & (script[1:] == script[:-1]) & ~edge[1:n]
        goes_on = np.zeros(n, bool)
        goes_on[:-1] = joined[1:]
        at = np.flatnonzero(inside)
        own = data[at].astype(np.uint32)
        before = np.where(joined[at], data[np.maximum(at - 1, 0)], 0).astype(np.uint32)
        after = np.where(goes_on[at], data[np.minimum(at + 1, max(n - 1, 0))], 0).astype(np.uint32)
        self.buckets = ((before << 16 | own << 8 | after) * np.uint32(2654435761)) >> np.uint32(17)
        first = np.flatnonzero(~joined[at])
        self.first = first
        self.scripts = script[at[first]]
        #: Words of row r: bounds[r] to bounds[r + 1].
        self.bounds = np.searchsorted(at[first], offsets)
        self.letter_rows = np.searchsorted(offsets, at, "right") - 1
        #: Letters of each word: bytes that begin a character.
        begins = (own & 0xC0) != 0x80
        self.letters = np.add.reduceat(begins, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)


def _lowered(texts: pa.Array):
    return text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, place, amount: trigram buckets, and after them scripts."""
    totals: dict[str, np.ndarray] = {}
    keep("", lambda: None)
    for batch in batches:
        langs = np.asarray(batch.column(0).to_pylist(), object)
        data, offsets = _lowered(batch.column(1))
        for low, high in row_blocks(offsets, SCORED_BYTES):
            found = _Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            own = langs[low:high]
            for lang in set(own):
                of_lang = own == lang
                mine = of_lang[found.letter_rows]
                words = np.repeat(of_lang, np.diff(found.bounds))
                total = totals.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                total[:BUCKETS] += np.bincount(found.buckets[mine], minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(found.scripts[words], found.letters[words], N_SCRIPTS).astype(np.int64)
        give_back()
    for lang, total in totals.items():
        places = np.flatnonzero(total)
        columns = [pa.array([lang] * len(places), pa.string()), pa.array(places.astype(np.int32)), pa.array(total[places])]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "amount"])


class LanguageModel:
    """languages, and for each of them log probabilities of trigram buckets and whether a script is its own."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        trigrams, scripts = counts[:, :BUCKETS].astype(float), counts[:, BUCKETS:].astype(float)
        smooth = trigrams + 0.5
        self.scores = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32))
        shares = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.of_script = (shares >= SCRIPT_SHARE).T
        #: A script that no language has leaves all of them.
        self.of_script[~self.of_script.any(axis=1)] = True


def learn_languages(docs: DataFrame, lang_column: str = "lang", text_column: str = "text") -> LanguageModel:
    """Count the trigrams of all rows with a language. Rows without one, or without text, teach nothing."""
    rows = docs.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_counts, "lang string, place int, amount long")
    table = counts.groupBy("lang", "place").agg(F.sum("amount").alias("amount")).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    totals = np.zeros((len(languages), BUCKETS + N_SCRIPTS), np.int64)
    if languages:
        row = pc.index_in(table.column("lang"), pa.array(languages)).to_numpy()
        totals[row, table.column("place").to_numpy()] = table.column("amount").to_numpy()
    return LanguageModel(languages, totals)


def _best_path(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """The label of every word: for each row the labels of the largest sum of scores less penalties. All rows advance
    together, the longest first, so that the ones still running stand in front."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = bounds[:-1][order], lengths[order]
    running = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    stays = np.zeros(scores.shape, bool)
    jump = np.zeros(len(scores), np.int32)
    state = np.zeros((len(lengths), scores.shape[1]), np.float64)
    for step, n in enumerate(running):
        at = begin[:n] + step
        now = state[:n]
        if step:
            best = now.max(axis=1, keepdims=True) - penalty
            stays[at] = now >= best
            jump[at] = now.argmax(axis=1)
            now = np.maximum(now, best)
        state[:n] = now + scores[at]
    labels = np.zeros(len(scores), np.int32)
    label = state.argmax(axis=1)
    for step in range(len(running) - 1, -1, -1):
        n = running[step]
        at = begin[:n] + step
        labels[at] = label[:n]
        if step:
            label[:n] = np.where(stays[at, label[:n]], label[:n], jump[at])
    return labels


def _scored(data: np.ndarray, offsets: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, ...]:
    """For the words of some rows: their score in each language and their letters; for the rows: the bounds of their words and
    their number of trigrams."""
    scores, letters, counts, trigrams = [], [], [], []
    for low, high in row_blocks(offsets, SCORED_BYTES):
        found = _Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        counts.append(np.diff(found.bounds))
        trigrams.append(np.bincount(found.letter_rows, minlength=high - low))
        if len(found.first):
            own = np.add.reduceat(model.scores[found.buckets], found.first, axis=0)
            own[~model.of_script[found.scripts]] -= np.float32(1e3)
            scores.append(own)
            letters.append(found.letters)
    scores = np.concatenate([np.zeros((0, len(model.languages)), np.float32), *scores])
    letters = np.concatenate([np.zeros(0, np.int64), *letters])
    bounds = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int64)
    return scores, letters, bounds, np.concatenate(trigrams)


def _predict(texts: pa.Array, model: LanguageModel, penalty: float) -> pa.Array:
    data, offsets = _lowered(texts)
    n, wide = len(texts), len(model.languages)
    letters = np.zeros((n, max(wide, 1)), np.int64)
    fit, trigrams = np.zeros(n), np.zeros(n, np.int64)
    span_row, span_label, span_first, span_words = [], [], [], []
    for low, high in row_blocks(offsets, max(1 << 16, (1 << 23) // max(wide, 1))):
        if not wide:
            continue
        scores, lengths, word_bounds, trigrams[low:high] = _scored(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], model)
        if not len(scores):
            continue
        labels = _best_path(scores, word_bounds, penalty)
        rows = np.repeat(np.arange(high - low), np.diff(word_bounds))
        np.add.at(letters, (low + rows, labels), lengths)
        np.add.at(fit, low + rows, scores[np.arange(len(labels)), labels])
        begins = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (rows[1:] != rows[:-1]))))
        span_row.append(low + rows[begins])
        span_label.append(labels[begins])
        span_first.append(begins - word_bounds[rows[begins]])
        span_words.append(np.diff(np.concatenate((begins, [len(labels)]))))
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    score = np.where(total > 0, letters[np.arange(n), best] / np.maximum(total, 1), 0.0)
    names = np.array([*model.languages, UNDETERMINED], object)
    predicted = names[np.where(total > 0, best, wide)]
    rows, label, first, count = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (span_row, span_label, span_first, span_words))
    real = total[rows] > 0
    rows, label, first, count = rows[real], label[real], first[real], count[real]
    spans = pa.StructArray.from_arrays([pa.array(names[label], pa.string()), pa.array(first), pa.array(count)], ["lang", "first_word", "n_words"])
    bounds = pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))
    fit = pa.array(fit / np.maximum(trigrams, 1), mask=total == 0)
    columns = [pa.array(predicted, pa.string()), pa.array(score), fit, pa.ListArray.from_arrays(bounds, spans)]
    return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "fit", "spans"])


def language_of(model: LanguageModel, penalty: float = SWITCH_PENALTY):
    """A column function of a text column: struct of lang_pred, score (share of the letters that lie in spans of that
    language, 0 to 1), fit (mean log probability of all trigrams, each in the language of its word) and spans (language,
    first word counted from 0, number of words).

    Null, empty and letterless texts are `und` with score 0, null fit and no spans, and so is every text where nothing was
    learned. Of languages with as many letters the first by name is taken. Texts are read whole.
    """

    @F.arrow_udf("lang_pred string, score double, fit double, spans array<struct<lang: string, first_word: long, n_words: long>>")
    def predict(texts: pa.Array) -> pa.Array:
        return in_slices(lambda t: _predict(t, model, penalty), texts)

    return predict


def held_out(column):
    """Rows that take no part in learning."""
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row: learned from the rows that are not held out. A row without
    doc_id is not held out. Columns besides doc_id, text and lang are not read; an empty table gives an empty result."""
    rows = docs.select("doc_id", "text", "lang")
    model = learn_languages(rows.filter(~held_out(F.col("doc_id"))))
    found = rows.select("doc_id", language_of(model)("text").alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")


def with_language(docs: DataFrame, least_fit: float = LEAST_FIT) -> DataFrame:
    """The rows whose languages could be told: `und` goes, and so do texts whose words, each in the language of its span,
    have a mean trigram score of least_fit or less. Texts in several languages stay, however these share the letters. All
    columns stay as they are."""
    model = learn_languages(docs.filter(~held_out(F.col("doc_id"))))
    name = "_language"
    while name in docs.columns:
        name += "_"
    found = docs.withColumn(name, language_of(model)("text"))
    good = (F.col(f"{name}.lang_pred") != UNDETERMINED) & (F.col(f"{name}.fit") > least_fit)
    return found.filter(good).drop(name)
