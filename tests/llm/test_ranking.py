"""Divergence rules, hard negatives and lexical search on small fixtures, against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest

from marginmill.llm import divergence, hard_negatives, lexical_search, queries

from .test_operators import DOCS, EDGE, docs, prose  # noqa: F401  (docs is a fixture)


def plain_counts(text):
    text = text or ""
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    places = collections.defaultdict(list)
    for i in range(len(own) - 7):
        places[tuple(own[i : i + 8])].append(i)
    hit = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit)


def plain_distance(p, q):
    middle = [(a + b) / 2 for a, b in zip(p, q)]
    entropy = lambda x: -sum(v * math.log2(v) for v in x if v)
    return math.sqrt(max(0.0, entropy(middle) - (entropy(p) + entropy(q)) / 2))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    english = ["the", "of", "and", "to", "in"] * 6 + [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "nrst"]
    french = ["le", "la", "de", "et", "à"] * 6 + [f"{a}é{b}" for a in "bcdfgmnp" for b in "aeiou"]
    rows = []
    for i in range(300):
        language, own = [("en", english), ("fr", french)][i % 2]
        lines = [" ".join(rng.choice(own) for _ in range(rng.randint(4, 12))) + "." for _ in range(rng.randint(2, 40))]
        rows.append((2000 + i, "\n".join(lines), language if i % 5 else None))
    repeated = " ".join(f"{w}" for w in "some words that come again and again here".split())
    rows += [(1000 + i, "|".join(rng.choice(english) + " $$" for _ in range(200)), "en") for i in range(20)]
    rows += [(1100, " ".join([repeated] * 9), "en"), (1101, "same line\nsame line\n \n\nsame line\r\n" * 4, "fr")]
    return rows + EDGE


def test_divergence(spark, docs, corpus):  # noqa: F811
    frame = docs(corpus)
    references = divergence.language_references(frame)
    found = divergence.rate_divergence(frame, references).collect()
    assert references.names == ["en", "fr"] and all(abs(s.sum() - 1) < 1e-9 for s in references.shares)
    assert len(found) == len(corpus)
    by_id = {r.doc_id: r for r in found}
    for i, text, _ in corpus:
        r, expected = by_id[i], plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, i
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r.kept and r.base_failed)
    whole = [by_id[2000 + i] for i in range(300)]
    assert all(r.kept for r in whole if not r.base_failed) and sum(r.base_failed for r in whole) < 60
    assert {r.nearest for r in whole if r.doc_id % 2 and not r.base_failed} == {"fr"}
    assert not any(by_id[1000 + i].kept for i in range(20))
    # Distances by plain Python.
    for i in (2000, 2001, 1003):
        text, r = dict((a, b) for a, b, _ in corpus)[i], by_id[i]
        at = references.names.index(r.nearest)
        kinds = collections.Counter(int(divergence._CLASS[c.encode()[0]]) for c in text)
        shares = [kinds[k] / len(text) for k in range(divergence.OTHER + 1)]
        assert abs(plain_distance(shares, references.classes[at].tolist()) - r.char_distance) < 1e-9


def test_divergence_references(spark, docs, corpus):  # noqa: F811
    """Counts over all labelled rows, whatever the partitions; junk leaves no mark after the second round."""
    frame = docs(corpus)
    one = divergence._references(frame.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL"), 5)
    many = divergence._references(frame.repartition(7).select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL"), 5)
    assert np.array_equal(one.classes, many.classes) and all(np.array_equal(a, b) for a, b in zip(one.shares, many.shares))
    counted = collections.Counter()
    for _, text, language in corpus:
        if language == "en" and text:
            counted.update(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()))
    best = sorted(counted.values(), reverse=True)[:5]
    assert sorted(one.shares[0][:5], reverse=True) == pytest.approx([n / sum(counted.values()) for n in best])
    symbols = divergence.CLASSES.index(divergence.SYMBOLS)
    assert one.classes[0][symbols] > 0.05 > divergence.language_references(frame).classes[0][symbols]


def test_divergence_without_references(spark, docs):  # noqa: F811
    text = prose(random.Random(1), 50)
    found = divergence.rate_divergence(docs([(1, text, None), (2, None, None)])).collect()
    assert [(r.kept, r.nearest, r.char_distance) for r in sorted(found)] == [(True, None, None), (False, None, None)]
    assert divergence.rate_divergence(docs([]).limit(0)).count() == 0


def test_strassen():
    rng = np.random.default_rng(1)
    for m, k, n in [(1, 1, 1), (0, 4, 7), (5, 3, 2), (33, 64, 47), (130, 65, 77), (64, 0, 9)]:
        a, b = (rng.integers(-(2**40), 2**40, (x, k)) for x in (m, n))
        for leaf in (1, 4, 32) if m < 40 else (16, 32):
            assert np.array_equal(hard_negatives.strassen(a, b, leaf), a @ b.T)


def plain_negatives(rows):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * np.float64(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1]))
    for a in kept:
        if a[0] % 50:
            continue
        near = sorted((-score(a, c), c[0]) for c in kept if c[2] == a[2] and c[0] != a[0])[:5]
        for p, i in near:
            p = -p
            window = sorted((-score(a, c), c[0]) for c in kept if c[2] != a[2] and 50 * p <= 100 * score(a, c) <= 95 * p)
            out += [(a[0], i, k + 1, j, p, -s) for k, (s, j) in enumerate(window[:3])]
    return sorted(out)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, score long, place long, rank string"


@pytest.mark.parametrize("case", ["spread", "hot label", "ties", "one label"])
def test_hard_negatives(spark, case):
    rng = np.random.default_rng(7)
    labels = {"spread": 6, "hot label": 3, "ties": 3, "one label": 1}[case]
    rows = []
    for i in range(400):
        label = 1 if case == "hot label" and i % 3 else int(rng.integers(0, labels))
        v = rng.normal(label * 0.3, 0.4, 12) if case != "ties" else np.full(12, 0.5 if i % 4 else 0.4)
        rows.append((i, [float(x) for x in v], label))
    rows += [(None, [1.0] * 12, 1), (450, None, 1), (451, [1.0, None], 1), (452, [float("nan")], 2), (500, [float("inf")] * 12, 2), (453, [], 0), (454, [0.5] * 12, None)]
    frame = spark.createDataFrame([(i, v, k, 1, 2, "x") for i, v, k in rows], EMBEDDINGS).repartition(5)
    expected = plain_negatives(rows)
    for block in (hard_negatives.BLOCK, 3):
        if block == 3 and case != "spread":
            continue
        assert sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, block=block).collect()) == expected
    assert expected or case == "one label"


def test_hard_negatives_repeated_and_empty(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.8, 0.1], 2), (2, [0.8, 0.1], 2), (3, [0.9, 0.0], 3)]
    frame = spark.createDataFrame([(i, v, k, 1, 2, "x") for i, v, k in rows], EMBEDDINGS)
    found = sorted(tuple(r) for r in hard_negatives.hard_negatives(frame).collect())
    each = [(50, 1, 1, 3, 65536, 58880), (50, 1, 2, 2, 65536, 52224), (50, 1, 3, 2, 65536, 52224)]
    assert found == sorted(each * 2)
    assert hard_negatives.hard_negatives(frame.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(frame.filter("vec_id <> 50")).count() == 0


def plain_ranking(rows, items):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, collections.Counter(terms(t))) for i, t in rows]
    n_docs = sum(bool(c) for _, c in counted)
    total = sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:10])]
    return sorted(out, key=str)


ITEMS = "item_id long, text string, item long, doc_id string, score long, rank long"


def test_lexical_search(spark, docs):  # noqa: F811
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([1, 3, 30, 200]), 80), "en") for i in range(200)]
    rows += [(300 + i, rows[3][1], "en") for i in range(15)] + [(400, "W1 w1, W2!" * 3000, None)] + EDGE
    items = [(i, prose(rng, rng.randint(1, 30), 100)) for i in range(30)] + [(3, "w5"), (None, "w7 w8 é"), (90, ""), (91, None), (92, "unknown"), (93, "word WORD"), (94, rows[3][1])]
    frame = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in items], ITEMS)
    expected = plain_ranking([(i, t) for i, t, _ in rows], items)
    for block in (lexical_search.BLOCK_ITEMS, 10):
        found = lexical_search.search(docs(rows).repartition(3), frame, block_items=block)
        assert sorted((tuple(r) for r in found.collect()), key=str) == expected
    assert lexical_search.search(docs(rows), frame.limit(0)).count() == 0
    assert lexical_search.search(docs([]).limit(0), frame).count() == 0


def test_segments_skip_nothing_that_counts():
    """Every threshold gives the exact scores of all documents that reach it and the best ten."""
    rng = np.random.default_rng(2)
    documents, vocabulary = 300, 40
    tf = rng.poisson(0.4, (documents, vocabulary)) * rng.integers(1, 4, (documents, vocabulary))
    row, term = np.nonzero(tf)
    lengths = tf.sum(axis=1) + 1
    weights = rng.integers(100, 6000, vocabulary)
    statistics = lexical_search.Statistics(documents, int(lengths.sum()), weights)
    norm = 10 + (90 * lengths * documents) // int(lengths.sum())
    impacts = np.where(tf > 0, weights * ((10**9 * tf) // np.maximum(1000 * tf + 8 * norm[:, None], 1)), 0)
    skipped = 0
    for _ in range(30):
        terms = np.sort(rng.choice(vocabulary, int(rng.integers(1, 12)), replace=False))
        units = lexical_search.paired(terms, weights)
        segment = lexical_search.Segment(lengths, row, term, tf[row, term], statistics, set(units))
        exact = impacts[:, terms].sum(axis=1)
        for unit in units:
            assert segment.bound(unit) >= impacts[:, list(unit)].sum(axis=1).max()
        tenth = int(np.sort(exact)[-10])
        for threshold in (1, max(1, tenth // 2), max(1, tenth), tenth + 1):
            found, score = segment.search(units, threshold, 10)
            assert np.array_equal(score, exact[found])
            wanted = np.flatnonzero(exact >= max(threshold, tenth, 1))
            assert np.isin(wanted, found).all()
            skipped += (exact > 0).sum() - len(found)
    assert skipped > 0


def test_registered(spark):
    assert {"op11_divergence", "op12_hard_negatives", "op13_lexical_search"} <= queries.registered().keys()
    found = queries.registered()["op11_divergence"](spark, "/root/testdata/sf0.001").collect()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(texts)
    for r in texts:
        own = by_id[r.doc_id]
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == plain_counts(r.text)
