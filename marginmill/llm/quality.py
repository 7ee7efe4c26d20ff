"""Quality classifier as a sparse ensemble of rules.

Statistics of whole texts (shares of kinds of characters, lengths, repetition) feed a forest of small trees. Each path
from a root is a rule: a conjunction of thresholds. A logistic regression with a lasso penalty weighs the rules and leaves most
out; what is left compiles to one Spark column expression over the statistics.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .languages import held_out
from .shared import stored

TREES, DEPTH, PENALTY = 20, 3, 0.001
#: The trees and the weights are fitted on about so many labelled rows, chosen by a hash of their ids.
MOST_ROWS = 30_000

_KINDS = ["upper", "lower", "digit", "space", "newline", "stop", "mark", "pipe", "lead", "tail"]
_KIND = np.zeros(256, np.int64)
for _i, _members in enumerate(
    [range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b" \t", b"\r\n", b".,;:'-", b"!?&%$#*@^~+=<>_\\/", b"|", range(0xC0, 0x100), range(0x80, 0xC0)]
):
    _KIND[list(_members)] = _i + 1
STATISTICS = [
    "log_chars", *(f"{k}_share" for k in _KINDS[:8]), "wide_share", "word_length", "long_words", "distinct_words", "distinct_lines", "words_in_line",
]
_LINES = words.byte_table(b"\r\n", fold_case=False)
_WORDS = words.byte_table(words.SPACES)


def _distinct_share(block: words.Block) -> np.ndarray:
    pairs = zip(block.bounds.tolist(), block.bounds[1:].tolist())
    return np.array([len(np.unique(block.hashes[a:b])) / (b - a) if b > a else 1.0 for a, b in pairs])


def _statistics(texts: pa.Array) -> pa.Array:
    n = len(texts)
    data, offsets = words.text_bytes(texts)
    counts = np.zeros((n, len(_KINDS) + 1))
    for low, high in words.row_blocks(offsets):
        rows = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
        kinds = _KIND[data[offsets[low] : offsets[high]]]
        counts[low:high] = np.bincount(rows * (len(_KINDS) + 1) + kinds, minlength=(high - low) * (len(_KINDS) + 1)).reshape(high - low, -1)
    chars = counts.sum(axis=1) - counts[:, 10]
    shares = counts[:, 1:] / np.maximum(chars, 1)[:, None]
    word_count, word_bytes, long_words, distinct, lines, distinct_lines = (np.zeros(n) for _ in range(6))
    for block in words.word_blocks(texts, _WORDS):
        own = slice(block.first_row, block.first_row + len(block.bounds) - 1)
        lengths = np.concatenate(([0], np.cumsum(block.ends - block.starts)))[block.bounds]
        longs = np.concatenate(([0], np.cumsum(block.ends - block.starts > 15)))[block.bounds]
        word_count[own], word_bytes[own], long_words[own] = np.diff(block.bounds), np.diff(lengths), np.diff(longs)
        distinct[own] = _distinct_share(block)
    for block in words.word_blocks(texts, _LINES):
        own = slice(block.first_row, block.first_row + len(block.bounds) - 1)
        lines[own], distinct_lines[own] = np.diff(block.bounds), _distinct_share(block)
    some = np.maximum(word_count, 1)
    columns = [np.log1p(chars), *shares[:, :8].T, shares[:, 8], word_bytes / some, long_words / some, distinct, distinct_lines, word_count / np.maximum(lines, 1)]
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c, np.float64)) for c in columns], STATISTICS)


def statistics(column):
    """The statistics of whole texts, a struct; null is empty, and all of an empty text are 0, but its distinct shares 1."""

    @F.arrow_udf(", ".join(f"{s} double" for s in STATISTICS))
    def of(texts: pa.Array) -> pa.Array:
        return words.in_slices(_statistics, texts)

    return of(column)


def tree_rules(description: str) -> list[tuple]:
    """The rules of a tree in Spark's description of it: conjunctions ((feature, above, threshold), ...) of all paths."""
    rules, path = [], []
    for line in description.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if found:
            depth = len(found[1])
            path = [x for x in path if x[0] < depth] + [(depth, (int(found[2]), found[3] == ">", float(found[4])))]
            rules.append(tuple(sorted(c for _, c in path)))
    return rules


def _column(rule, names):
    found = F.lit(True)
    for feature, above, threshold in rule:
        c = F.col(names[feature])
        found = found & ((c > threshold) if above else (c <= threshold))
    return found


class RuleModel:
    """Weighted rules over named statistics; `score()` is the column of the probability of label 1."""

    def __init__(self, intercept: float, weights: list[tuple[tuple, float]], names: list[str] = STATISTICS):
        self.intercept, self.weights, self.names = intercept, weights, names

    def score(self):
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(_column(rule, self.names), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit_rules(
    rows: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, most_rows: int = MOST_ROWS, seed: int = 7
) -> RuleModel:
    """Fit on rows of the statistics, `doc_id` and a `label` of 0 or 1. Where all labels are the same, or there are none, the
    model has no rules and scores that label (at its smoothed share), or 0.5."""
    n, ones = rows.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = (ones + 0.5) / (n + 1)
    if ones in (0, n):
        return RuleModel(float(np.log(share / (1 - share))), [])
    if n > most_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    rows = stored(rows.select(array_to_vector(F.array(*STATISTICS)).alias("features"), F.col("label").cast("double"), *STATISTICS), "training")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7).fit(rows)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in tree_rules(tree.toDebugString)))
    held = F.array(*[F.when(_column(r, STATISTICS), F.lit(1.0)).otherwise(F.lit(0.0)) for r in rules]) if rules else F.array(F.lit(0.0))
    inputs = rows.select(array_to_vector(held).alias("features"), "label")
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=100).fit(inputs)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    return RuleModel(float(lasso.intercept), weights)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row: learned from labelled rows that are not held out.

    Null and empty texts are scored by their statistics like any other. Labels without a document, and null labels, teach nothing; a
    label that occurs several times counts as often. Rows without an id get a score and teach nothing. Other columns are not read; an empty table
    gives an empty result.
    """
    rows = docs.select("doc_id", statistics("text").alias("s")).select("doc_id", "s.*")
    rows = stored(rows, "statistics")
    known = labels.select("doc_id", F.col("quality").alias("label")).filter("label IN (0, 1)")
    model = fit_rules(rows.join(known.filter(~held_out(F.col("doc_id"))), "doc_id"))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
