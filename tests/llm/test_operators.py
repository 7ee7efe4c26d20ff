"""The operators on small fixtures, against brute force, exact round trips and the cases their docstrings define."""

import collections
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginmill.llm import archives, decontamination, fingerprints, languages, licences, near_duplicates, packing
from marginmill.llm import pseudonyms, quality, quotations, tokens, words
from marginmill.llm.components import components
from marginmill.llm.fm_index import FMIndex

DOCS = "doc_id long, text string, lang string, n_chars long, word string, key long, n long, id long, s string, row long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, lang), with columns whose names the operators use inside."""
    return lambda rows: spark.createDataFrame(
        [(i, t, lang, None if t is None else len(t), "x", 1, 2, 3, "y", 4) for i, t, lang in rows], DOCS
    )


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGE = [(1, None, None), (2, "", "en"), (3, " \n\t", "en"), (4, "word", "en"), (5, "word", "en"), (5, "word", "en"), (None, "word word", None), (6, "é " * 30_000, "fr")]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if w]
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else ({tuple(own)} if own else set())


def grouped(rows):
    """Smallest reachable id of each document, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_all_pairs(docs):
    rng = random.Random(3)
    rows, base = [], prose(rng, 150).split()
    for i in range(120):  # one large group of edited copies, from nearly equal to beyond the threshold
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(len(copy))] = rng.choice(["the", "of", f"own{i}"])
        rows.append((i, " ".join(copy)))
    passage = prose(rng, 40)
    rows += [(200 + i, f"{prose(rng, 10)} {passage} {prose(rng, 10)}") for i in range(30)]
    rows += [(300 + i, prose(rng, rng.randrange(1, 60))) for i in range(30)]
    rows += [(400 + i, rows[i][1].upper()) for i in range(0, 30, 3)]
    out = near_duplicates.near_duplicates(docs([(i, t, None) for i, t in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == grouped(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_edges(docs):
    out = near_duplicates.near_duplicates(docs(EDGE)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in out) == [
        (0, 1, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (6, 1, 6, True),
    ]
    kept = near_duplicates.without_near_duplicates(docs([*EDGE, (7, "a b", None), (7, "a b", None)]))
    assert kept.columns == docs(EDGE).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert near_duplicates.near_duplicates(docs([]).limit(0)).count() == 0


def test_parity_bitmaps_bound_the_difference():
    rng = random.Random(5)
    for _ in range(30):
        a = prose(rng, 200).split()
        b = [w if rng.random() > 0.1 else "new" for w in a]
        pair = [" ".join(a), " ".join(b)]
        row = near_duplicates._sketches(pa.array(pair), 5).to_pylist()
        apart = sum(bin((row[0][c] ^ row[1][c]) & (1 << 64) - 1).count("1") for c in near_duplicates._BITS)
        assert apart <= len(shingles(pair[0]) ^ shingles(pair[1]))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 99) for i in range(50)]
    random.Random(1).shuffle(edges)
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{99 + i: 99 for i in range(51)}}


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(2)
    for n in (1, 7, 300):
        sequence = rng.integers(1, 5, n)
        index = FMIndex(sequence, 6)
        patterns = rng.integers(1, 6, (40, 4))
        lengths = rng.integers(1, 5, 40)
        low, high = index.search(patterns, lengths)
        for p, k, a, b in zip(patterns, lengths, low, high):
            wanted = [i for i in range(n - k + 1) if (sequence[i : i + k] == p[:k]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b)))) == wanted


def contamination(docs_rows, items, window=10):
    of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    phrases = collections.defaultdict(set)
    for name, text in items:
        own = of(text)
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            phrases[tuple(own[i : i + k])].add(str(name))
    out = []
    for i, text in docs_rows:
        own, hit, names = of(text), set(), set()
        for k in {len(p) for p in phrases}:
            for at in range(len(own) - k + 1):
                if found := phrases.get(tuple(own[at : at + k])):
                    names |= found
                    hit |= set(range(at, at + k))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(own), len(hit), len(names), digest, bool(hit)))
    return out


@pytest.mark.parametrize("block_items", [2, 1000])
def test_decontamination_equals_brute_force(spark, docs, block_items):
    rng = random.Random(8)
    items = [(i, prose(rng, n, 40)) for i, n in enumerate([12, 30, 9, 1, 2, 10, 15, 0])] + [(77, None), (1, "zzz yyy"), (None, "w1 w2")]
    rows = [(i, prose(rng, 80, 60)) for i in range(20)]
    rows += [(50 + i, f"{prose(rng, 9, 60)} {t.upper()}, {t}! {prose(rng, 5, 60)}") for i, (_, t) in enumerate(items[:7])]
    rows += [(i, t) for i, t, _ in EDGE]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    search = decontamination.contamination_of(benchmark, block_items=block_items)
    found = docs([(i, t, None) for i, t in rows]).select("doc_id", "text", search("text").alias("f")).collect()
    got = [(r.doc_id, r.f.n_words, r.f.n_hit, r.f.n_items, r.f.items_sha256, r.f.n_hit > 0) for r in found]
    assert sorted(got, key=str) == sorted(contamination(rows, [x for x in items if x[0] is not None]), key=str)
    for r in found:
        raw = (r.text or "").encode()
        cut = b"".join(raw[a:b] for a, b in zip([0, *(s.end for s in r.f.spans)], [*(s.start for s in r.f.spans), len(raw)]))
        assert (r.f.cleaned or "").encode() == cut


def test_decontamination_stage(spark, docs):
    item = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"before {item} after", None), (2, item, None), (3, "clean text", None), (4, None, None), (5, "", None)]
    out = {r.doc_id: (r.text, r.n_chars) for r in decontamination.without_contamination(docs(rows), benchmark).collect()}
    assert out == {1: ("before  after", 13), 3: ("clean text", 10), 4: (None, None), 5: ("", 0)}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(docs(rows), empty).filter("contaminated").count() == 0


def test_decontamination_stage_searches_once(spark, docs):
    """A second search would hold a second worker for each task."""
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    out = decontamination.without_contamination(docs(EDGE), benchmark)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_a_worker_holds_little_besides_its_texts():
    model = languages.LanguageModel(["xx", "yy"], np.ones((2, languages.BUCKETS + languages.N_SCRIPTS), np.int64))
    texts = pa.array([prose(random.Random(i), 600) for i in range(1700)])
    tracemalloc.start()
    try:
        languages._predict(texts.slice(0, 10), model, languages.SWITCH_PENALTY)
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        out = words.in_slices(lambda t: languages._predict(t, model, languages.SWITCH_PENALTY), texts)
        peak = tracemalloc.get_traced_memory()[1] - held
    finally:
        tracemalloc.stop()
    assert len(out) == len(texts) and texts.nbytes > 3_000_000
    assert peak < 80e6, peak


def test_languages(docs):
    rng = random.Random(4)
    syllables = {"xx": ["ka", "to", "mi"], "yy": ["bre", "sul", "wen"], "zz": ["жо", "ки", "ме"]}
    make = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(i, make(lang, 40), lang) for i in range(150) for lang in [rng.choice("xyz") * 2]]
    mixed = make("xx", 20) + ". " + make("yy", 12)
    rows += [(1000, mixed, None), (1001, "123 -- 45", "xx"), (1002, "— …", "xx"), (1003, None, "xx"), (1004, "", None), (None, make("zz", 3), None)]
    out = {r.doc_id: r for r in languages.identify_languages(docs(rows)).collect()}
    wrong = [i for i, _, lang in rows[:150] if out[i].lang_pred != lang]
    assert not wrong and all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows[:150])
    assert out[1000].lang_pred == "xx" and 0.4 < out[1000].score < 0.8 and out[None].lang_pred == "zz"
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (1001, 1002, 1003, 1004))
    model = languages.learn_languages(docs(rows[:150]))
    spans = docs([(1, mixed, None)]).select(languages.language_of(model)("text").alias("f")).first().f.spans
    assert [(s.lang, s.first_word, s.n_words) for s in spans] == [("xx", 0, 20), ("yy", 20, 12)]
    kept = languages.with_language(docs(rows))
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {1001, 1002, 1003, 1004}
    assert {r.lang_pred for r in languages.identify_languages(docs([(1, "some text", None)])).collect()} == {"und"}


def _words(texts):
    data, offsets = languages._lowered(pa.array(texts))
    found = languages._Words(data, offsets)
    return found, ["none", *languages.SCRIPTS, "other"]


def test_scripts_are_those_of_code_points():
    text = "«Übung» déjà“ слово我们。かな漢 कहाँ १२ e\u0301x \u0301y ไทย한국 ⲁⲃ 😀x×÷2ª"
    found, names = _words([text, "", "\u0301 —…。", "ab", "我"])
    # A word is a run of letters of one script; a mark goes with the letter before it, and digits, marks and symbols cut.
    scripts = [names[s] for s in found.scripts]
    assert scripts == ["Latin", "Latin", "Cyrillic", "Han", "Kana", "Han", "Devanagari", "Latin", "Latin", "Thai", "Hangul", "other", "Latin", "Latin", "Latin", "Han"]
    assert list(found.letters) == [5, 4, 5, 2, 2, 1, 4, 3, 1, 3, 2, 2, 1, 1, 2, 1]
    assert list(found.bounds) == [0, 14, 14, 14, 15, 16]
    # The rule in plain Python.
    rng = random.Random(8)
    alphabet = "aé ж我か、。“ก\u0301ा1-\n😀ª𠀀"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(300)]
    table = languages.script_table()
    want = []
    for t in texts:
        before = 0
        for c in t:
            script = table[ord(c)] if ord(c) < languages.END_OF_LETTERS else 0
            script = before if script == languages.MARK else script
            if script and script != before:
                want.append([script, 0])
            if script:
                want[-1][1] += 1
            before = script
    found, _ = _words(texts)
    assert [list(x) for x in zip(found.scripts, found.letters)] == want


def test_scripts_narrow_the_languages(docs):
    """Letters of another script are no evidence for a language that does not use it, whatever stands around them."""
    rows = [(i, t, lang) for i in range(30) for lang, t in [("de", "über das schöne Haus “gehen” wir"), ("ru", "мы идём домой — вот"), ("zh", "我们回家。今天很好")]]
    rows = [(n, t, lang) for n, (_, t, lang) in enumerate(rows)]
    model = languages.learn_languages(docs(rows))
    own = lambda script: {l for l, x in zip(model.languages, model.of_script[1 + list(languages.SCRIPTS).index(script)]) if x}  # noqa: E731, E741
    assert (own("Latin"), own("Cyrillic"), own("Han")) == ({"de"}, {"ru"}, {"zh"}) and own("Thai") == {"de", "ru", "zh"}
    mixed = "wir gehen. мы идём домой 我们回家。今天 das Haus"
    spans = docs([(1, mixed, None)]).select(languages.language_of(model, 0.0)("text").alias("f")).first().f.spans
    assert [(s.lang, s.n_words) for s in spans] == [("de", 2), ("ru", 3), ("zh", 2), ("de", 2)]
    # Letters of a script that no learned language has still get a learned one.
    assert docs([(1, "ไทย", None)]).select(languages.language_of(model)("text").alias("f")).first().f.lang_pred in model.languages


def _plain_languages(rows):
    """The method word by word: doc_id to language and score."""
    table, size, n_scripts = languages.script_table(), languages.BUCKETS, languages.N_SCRIPTS

    def words_of(text):
        found, before = [], 0
        for c in text.lower():
            script = table[ord(c)]
            script = before if script == languages.MARK else script
            if script and script != before:
                found.append(["", script])
            if script:
                found[-1][0] += c
            before = script
        return found

    def buckets_of(word):
        b = [0, *word.encode(), 0]
        return [((b[i - 1] << 16 | b[i] << 8 | b[i + 1]) * 2654435761 % 2**32) >> 17 for i in range(1, len(b) - 1)]

    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    learned = [(t, lang) for i, t, lang in rows if t is not None and lang is not None and not held(i)]
    known = sorted({lang for _, lang in learned})
    trigrams = {lang: collections.Counter() for lang in known}
    scripts = {lang: collections.Counter() for lang in known}
    for text, lang in learned:
        for word, script in words_of(text):
            trigrams[lang].update(buckets_of(word))
            scripts[lang][script] += len(word)
    weight = {lang: sum(trigrams[lang].values()) + 0.5 * size for lang in known}
    candidates = {x: [lang for lang in known if scripts[lang][x] >= 0.01 * sum(scripts[lang].values())] or known for x in range(n_scripts)}
    out = {}
    for i, text, _ in rows:
        paths = {lang: (0.0, []) for lang in known}
        words = words_of(text or "")
        for n, (word, script) in enumerate(words):
            best = max(known, key=lambda k: paths[k][0])
            after = {}
            for lang in known:
                worth, path = paths[lang]
                if n and paths[best][0] - languages.SWITCH_PENALTY > worth:
                    worth, path = paths[best][0] - languages.SWITCH_PENALTY, paths[best][1]
                own = sum(math.log((trigrams[lang][b] + 0.5) / weight[lang]) for b in buckets_of(word))
                after[lang] = (worth + own - (0 if lang in candidates[script] else 1e3), [*path, lang])
            paths = after
        path = max(paths.values(), key=lambda x: x[0])[1] if words else []
        letters = collections.Counter()
        for lang, (word, _) in zip(path, words):
            letters[lang] += len(word)
        label = min(letters, key=lambda k: (-letters[k], k)) if words else "und"
        out[i] = (held(i), label, letters[label] / max(sum(letters.values()), 1))
    return out


def test_languages_equal_the_plain_method(docs):
    rng = random.Random(12)
    syllables = {"aa": ["ka", "to", "mi", "é"], "bb": ["bre", "sul", "wen", "to"], "cc": ["жо", "ки", "ме"], "dd": ["ме", "го", "ка"], "ee": ["我", "们", "今"]}

    def make(lang, n):
        return "".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) + rng.choice([" ", ", ", "。", "\n", "7"]) for _ in range(n))

    rows = [(i, make(lang, rng.randrange(1, 40)), lang if rng.random() < 0.9 else None) for i in range(120) for lang in [rng.choice(list(syllables))]]
    rows += [(200 + i, "".join(make(rng.choice(list(syllables)), rng.randrange(1, 15)) for _ in range(4)), rng.choice([None, "aa", "dd"])) for i in range(60)]
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "12 — 34", "cc"), (303, "ไทย", None), (304, "e\u0301", None)]
    want = _plain_languages(rows)
    for r in languages.identify_languages(docs(rows)).collect():
        held, label, score = want[r.doc_id]
        assert (r.held_out, r.lang_pred) == (held, label) and r.score == pytest.approx(score), (r, label, score)


def test_best_path_is_viterbi():
    rng = np.random.default_rng(3)
    lengths = [3, 0, 5, 1]
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    scores = rng.normal(size=(bounds[-1], 2))
    labels = languages._best_path(scores, bounds, 0.7)
    for low, high in zip(bounds, bounds[1:]):
        n = high - low
        paths = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        worth = lambda p: sum(scores[low + i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        assert worth(list(labels[low:high])) == pytest.approx(max(map(worth, paths)))


PERSONAL = [
    "card 4316522678525456 end", "4316 5226 7852 5456", "mail ab.Cd9@mail2.example.com.", "call +1 (743) 555-3824 now",
    "ip 233.233.171.252!!", 'token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e"', "password=65f08e5e2ed6b028bd", "born 1984-02-29,",
    "on 31/12/1999", "on 12/31/1999", "ssn 123-45-6789", "GB82WEST12345698765432",
]
KEPT = ["4316522678525457", "999.1.1.1", "1984-02-30", "000-45-6789", "GB83WEST12345698765432", "version 1.2.3", "page 12"]


def test_pseudonyms_round_trip():
    key = b"k"
    for text in PERSONAL:
        new, found = pseudonyms.pseudonymised(text, key)
        assert len(found) == 1 and new != text, text
        assert pseudonyms.pseudonymised(new, key, reverse=True)[0] == text
        assert pseudonyms.pseudonymised(text, b"other")[0] != new
    for text in KEPT:
        assert pseudonyms.pseudonymised(text, key) == (text, [])


def test_pseudonyms_link_and_keep_formats(docs):
    a, b = "4316522678525456", "4316 5226 7852 5456"
    rows = [(11, f"x {a} y", None), (12, f"{a}, again {b}", None), *EDGE]
    out = {r.doc_id: r for r in pseudonyms.pseudonym_report(docs(rows)).collect()}
    one = out[11].text.split()[1]
    assert one != a and out[12].text.startswith(one) and out[12].text.split("again ")[1].replace(" ", "") == one
    assert int(one[-1]) == pseudonyms.luhn_digit(one[:-1]) and out[12].kinds == "card" and out[12].n_found == 2
    assert out[11].n_found == 1 and out[4].text == "word"
    staged = pseudonyms.pseudonymise(docs(rows))
    assert staged.columns == docs(rows).columns and staged.count() == len(rows)


def test_permutation_is_one():
    network = pseudonyms.Permutation(b"key")
    for size in (1, 2, 10, 100, 365):
        moved = [network.move("t", size, v) for v in range(size)]
        assert sorted(moved) == list(range(size))
        assert [network.move("t", size, v, reverse=True) for v in moved] == list(range(size))


PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_token_ids_equal_the_tokenizer():
    encoder = tokens.WordEncoder(PATH)
    texts = ["It's  A test, isn't it? don’t—stop", "é,ü! 12a3 $$$x%%%\n\nEND.", "", "a<|endoftext|>b", "ÅÅ x y", "x" * 300, "日本語 テスト。 ok"]
    texts += [prose(random.Random(1), 500)]
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for chosen in (texts, [t for t in texts if "<|" not in t]):
        got = list(encoder.rows(pa.array(chosen), 2))
        assert [x.tolist() for x in got] == [w.ids + [2] for t, w in zip(texts, want) if t in chosen]


def test_token_ids_of_stretches_encoded_together():
    """Few texts for many new words of letters, and the tokenizer's own ids for whatever else stands among them."""
    encoder, given = tokens.WordEncoder(PATH), []

    class Counted:
        def __getattr__(self, name):
            def call(texts, **options):
                given.extend(texts)
                return getattr(tokenizer, name)(texts, **options)

            return call

    tokenizer, encoder.tokenizer = encoder.tokenizer, Counted()
    rng = random.Random(4)
    new = ["".join(rng.choices("abcdeéßñŁж", k=rng.randint(4, 12))) + rng.choice(["", "", ".", "!?", "'s", ","]) for _ in range(20_000)]
    odd = "İstanbul. İ, ΣΑΣ ǅ e\u0301. \u0301a a\u0338= é\u0308! ×. ÷, x÷. ŉ's é's é'll 가각 \u1100\u1161\u11a8 ª. Ⅷ ２ don'tx ﬁ. ſ's Å. \U0001f600 ZÉ<|".split()
    texts = [" ".join(new[i : i + 50]) for i in range(0, len(new), 50)]
    texts += [" ".join(rng.choices(odd[:-1] + new[:40], k=30)) for _ in range(40)] + ["".join(rng.choices(odd[:-1], k=5)) for _ in range(200)]
    for chosen in (texts, [*texts[-100:], *odd, None, ""]):
        want = tokenizer.encode_batch([t or "" for t in chosen], add_special_tokens=False)
        assert [x.tolist() for x in encoder.rows(pa.array(chosen), None)] == [w.ids for w in want]
    assert len(set(new)) > 15_000 and len(given) < 2_000


def test_packing(spark, docs):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.choice([1, 5, 30, 200, 900])), None) for i in range(60)] + EDGE
    out = packing.pack(docs(rows), PATH, capacity=256, unit=8, with_ids=True).collect()
    assert sum(r.length for r in out) == sum({(r.doc_id, r.start, r.doc_tokens): 1 for r in out} and [len(x) for x in tokens.WordEncoder(PATH).rows(pa.array([t for _, t, _ in rows]), 2)])
    sequences = collections.defaultdict(list)
    for r in out:
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == list(np.cumsum([0] + [p[1] for p in parts])[:-1]) and sum(p[1] for p in parts) <= 256
    assert len(sequences) <= 1.15 * sum(r.length for r in out) / 256 + 2
    assert packing.pack(docs([]).limit(0), PATH).count() == 0


def test_patterns_beside_a_session(spark):
    """The linear program needs no threads of its own, which once locked up beside a JVM's."""
    rng = np.random.default_rng(5)
    demand = np.zeros(513, np.int64)
    demand[rng.choice(np.arange(1, 513), 114, replace=False)] = rng.integers(1, 4, 114)
    began = time.monotonic()
    patterns, level = packing.fractional_patterns(demand)
    assert time.monotonic() - began < 10
    assert ((patterns * level[:, None]).sum(axis=0) >= demand - 1e-6).all()
    assert np.allclose(packing._inverse(np.array([[0.0, 2.0], [4.0, 1.0]])), [[-0.125, 0.25], [0.5, 0.0]])


def test_patterns_cover_the_demand():
    rng = np.random.default_rng(1)
    demand = np.concatenate(([0], rng.integers(0, 50, 64)))
    patterns, counts = packing.whole_patterns(demand)
    assert ((patterns * counts[:, None]).sum(axis=0) == demand).all()
    units = patterns @ np.arange(65)
    # Rounding costs a few sequences over the linear program, which covers the demand itself.
    fractional, level = packing.fractional_patterns(demand)
    assert units.max() <= 64 and counts.sum() <= level.sum() + 10
    assert np.allclose((fractional * level[:, None]).sum(axis=0), demand)


def test_licences(spark, docs):
    rows = [
        (1, "Some prose here.\nReleased under the MIT license!\nmore", None),
        (2, "licensed under the apache license version 2.0", None),
        (3, "Released under", None),
        (4, "prose\n" + "This work is licensed under the GNU General Public License, version 2.\nLicensed under CC BY-NC 4.0.", None),
        *[(i + 10 if i else None, t, None) for i, t, _ in EDGE],
    ]
    out = {r.doc_id: (r.n_matches, r.licences) for r in licences.scan_licences(docs(rows)).collect()}
    assert out[1] == (1, "MIT") and out[2] == (1, "Apache-2.0") and out[3] == (0, "") and out[4] == (2, "CC-BY-NC-4.0,GPL-2.0")
    assert all(out[i] == (0, "") for i in (11, 12, 13, 14, 15, None))
    none = spark.createDataFrame([(None, None), ("X", "one")], "licence string, text string")
    assert licences.scan_licences(docs(rows), none).filter("n_matches > 0").count() == 0


def test_archives_round_trip(spark):
    rows = [(1, "http://a b/ü", "<p>é\r\n\r\nx</p>"), (2, "u", "<p>é\r\n\r\nx</p>"), (2, "u", "<p>é\r\n\r\nx</p>"), (3, None, None), (4, "u", ""), (5, "v", "y\nWARC/1.0\r\n"), (None, "w", "z" * 100_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_id int")
    for version in (1, 2):
        out = archives.page_records(pages, version).collect()
        got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str)
        d = lambda t: archives.digest((t or "").encode())
        want = [(i or 0, len((t or "").encode()), d(t), "response", None) for i, _, t in rows]
        for at, to in ((0, 2), (1, 2), (3, 4)):
            want[at] = (*want[at][:3], "revisit", to)
        assert got == sorted(want, key=str)
    records = archives.page_records(pages, least_bytes=1).filter("page_id IN (3, 4)")
    assert {r.record_type for r in records.collect()} == {"response"}
    assert archives.page_records(pages.limit(0)).count() == 0


def test_archives_are_compressed_at_the_level_named(spark):
    """Their sizes lie between those of the quickest level and of gzip's own, which takes three times as long."""
    rng = random.Random(8)
    rows = [(i, f"u{i}", prose(rng, 400, 3000)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    arc = archives.write_arc(pages)
    for folder in (arc, archives.write_warc(archives.converted(spark, arc).coalesce(1))):
        files = [f.read_bytes() for f in Path(folder.removeprefix("file:")).glob("part-*.gz")]
        [content] = [f for f in files if len(f) > 10_000]
        plain = zlib.decompress(content, 31)
        assert len(zlib.compress(plain, 6)) * 1.005 < len(content) < len(zlib.compress(plain, 1))


def test_payloads_that_are_no_text(spark):
    record = {"original": None, "uri": "u", "date": "d", "record_id": "1", "ip": "-", "payload": b"\xff\x00", "payload_digest": archives.digest(b"\xff\x00"), "http": "HTTP/1.1 200 OK\r\nX-Page-Id: 3"}
    [(headers, block)] = archives.read_warc(archives.warc_record(record).encode())
    assert headers["x-payload-coding"] == "base64" and block.endswith(b"/wA=")


def test_short_arc_records_are_errors():
    text = archives.arc_version_block(1, "2026") + "\n" + archives.arc_record("u", 1, "abc", 1, "-", "2026")
    assert len(list(archives.read_arc(text.encode()))) == 1
    with pytest.raises(ValueError):
        list(archives.read_arc(text.encode()[:-1]))


def test_quotations(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nWith keys."),
        (1, 1, "assistant", "> how do I  sort\nUse sorted().\nIt is stable."),
        (1, 2, "user", "Another topic"),
        (1, 3, "assistant", ">> How do I sort?\n> Use sorted().\nyes"),
        (1, 4, "user", "> not from here\nok"),
        (2, 0, "user", "> Another topic"),
        (2, 1, None, None),
        (None, 0, "user", "> Another topic"),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string")
    out = {(r.conv_id, r.turn): r for r in quotations.link_quotations(table).collect()}
    replies = {k: r.reply_to for k, r in out.items()}
    assert replies == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 3, (2, 0): None, (2, 1): 0, (None, 0): None}
    assert out[1, 3].depth == 2 and (out[1, 3].n_quoted, out[1, 3].n_linked) == (2, 2) and out[1, 3].text == "yes"
    assert (out[1, 4].n_quoted, out[1, 4].n_linked, out[1, 4].text) == (1, 0, "ok") and out[2, 1].text is None
    assert quotations.link_quotations(table.limit(0)).count() == 0


def test_quality_rules(spark, docs):
    rng = random.Random(9)
    rows = [(i, prose(rng, 60) if i % 2 else prose(rng, 60).upper() + "!!", None) for i in range(200)] + EDGE
    labels = spark.createDataFrame([(i, i % 2, 0, 1) for i in range(200)] + [(None, 1, 0, 1), (9999, None, 0, 1)], "doc_id long, quality int, toxic int, score int")
    out = quality.score_quality(docs(rows), labels).collect()
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 200 and r.doc_id > 6]
    assert held and all(r.predicted == r.doc_id % 2 for r in held) and all(0 <= r.score <= 1 for r in out) and len(out) == len(rows)
    none = quality.score_quality(docs(rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_tree_rules_hold_for_the_leaves():
    text = "Tree\n  If (feature 1 <= 0.5)\n   Predict: 0.0\n  Else (feature 1 > 0.5)\n   If (feature 0 <= 2.0)\n    Predict: 1.0\n   Else (feature 0 > 2.0)\n    Predict: 0.0\n"
    assert quality.tree_rules(text) == [((1, False, 0.5),), ((1, True, 0.5),), ((0, False, 2.0), (1, True, 0.5)), ((0, True, 2.0), (1, True, 0.5))]


def test_fingerprints(spark, docs):
    a, b = "One. Two here! Three\n", "Three\nOne. Two here!"
    rows = [(3, a, None), (2, a, None), (1, b, None), (0, "entirely other text. and more of it. " * 20, None)]
    lanes = {r.doc_id: r for r in fingerprints.lanes_of(docs(rows), ["doc_id"]).collect()}
    assert lanes[3].lanes == lanes[2].lanes and lanes[0].lanes != lanes[3].lanes
    parts = docs([(1, "One. Two", None), (1, " here!", None), (2, " here!", None), (3, "One. Two", None)])
    sums = {r.doc_id: r.lanes for r in fingerprints.lanes_of(parts, ["doc_id"]).collect()}
    both = spark.createDataFrame([(sums[1], sums[2], sums[3])], "w array<long>, a array<long>, b array<long>")
    moved = both.select(fingerprints.inserted("a", "b"), fingerprints.deleted("w", "a")).first()
    assert moved[0] == sums[1] and moved[1] == sums[3]


def test_edited_fingerprints(docs):
    rows = [(i, t, lang) for i, t, lang in EDGE]
    out = fingerprints.edited_fingerprints(docs(rows)).collect()
    assert len(out) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    ordered = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -1))
    by = collections.defaultdict(list)
    for at, (i, text, _) in enumerate(ordered):
        text, after = text or "", ordered[(at + 1) % len(ordered)][1] or ""
        k = len(text) // 3
        by[i].append((len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()))
    got = collections.defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.n_chars, r.edited_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by.items()}
    single = fingerprints.edited_fingerprints(docs([(1, "abc. def. ghi", None)])).first()
    assert single.near_next == 1.0
    assert fingerprints.edited_fingerprints(docs([]).limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_blocks():
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(40)) for _ in range(50)] + [None, "", "É é  x"]
    one = [b.hashes for b in words.word_blocks(pa.array(texts), words.byte_table(words.SPACES))]
    many = [b.hashes for b in words.word_blocks(pa.array(texts), words.byte_table(words.SPACES), 100)]
    assert (np.concatenate(one) == np.concatenate(many)).all()
    sliced = pa.array(["zero", *texts]).slice(1)
    assert (np.concatenate([b.hashes for b in words.word_blocks(sliced, words.byte_table(words.SPACES))]) == np.concatenate(one)).all()


MIT_FILE = """MIT License

Copyright (c) 2020 Some Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def test_neighbour_licences(docs):
    """Every notice gets its own name, alone and wrapped into prose; another version gets none."""
    before, after = prose(random.Random(8), 60), prose(random.Random(9), 60)
    rows = [(i, text, None) for i, (_, text) in enumerate(licences.TEMPLATES)]
    rows += [(100 + i, f"{before} {text.replace(', ', ',' + chr(10))} {after}", None) for i, (_, text) in enumerate(licences.TEMPLATES)]
    rows += [(200, "This work is licensed under the GNU General Public License, version 4.", None), (201, licences.TEMPLATES[0][1].replace("2.0", "1.1"), None)]
    out = {r.doc_id: (r.n_matches, r.best) for r in licences.scan_licences(docs(rows)).collect()}
    for i, (name, _) in enumerate(licences.TEMPLATES):
        assert out[i] == (1, name) and out[100 + i][1] == name, i
    assert out[200] == out[201] == (0, None)


def test_wrapped_licences(docs, monkeypatch):
    header = "import x\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\nx = 1"
    rows = [(1, MIT_FILE, None), (2, header, None), (3, f"{prose(random.Random(1), 90)} released\nunder the MIT license, {prose(random.Random(2), 90)}", None), (4, MIT_FILE.replace("\n", "\n * ") + f"\n\n{prose(random.Random(4), 200)}\n\n" + MIT_FILE, None), (5, prose(random.Random(3), 200), None)]
    want = {1: (1, "MIT"), 2: (1, "GPL-3.0"), 3: (1, "MIT"), 4: (2, "MIT"), 5: (0, "")}
    for most in (licences.MOST_CONSTANT, 0):
        monkeypatch.setattr(licences, "MOST_CONSTANT", most)
        assert {r.doc_id: (r.n_matches, r.licences) for r in licences.scan_licences(docs(rows)).collect()} == want


@pytest.mark.parametrize("kind, value, hidden", [
    ("account", "DE89 3704 0044 0532 0130 00", "3704"), ("account", "BE68-5390-0754-7034", "5390"), ("phone", "+33 1 23 45 67 89", "23 45 67"),
    ("phone", "+91 98765 43210", "98765"), ("phone", "555.123.4567", "123.4567"), ("phone", "1-800-555-1234", "555-1234"),
    ("phone", "(020) 7946 0958", "7946 0958"), ("date", "3/7/1990", "3/7/1990"), ("date", "1990-03-07T10:15:00", "1990-03-07"),
    ("date", "9.11.1989", "9.11.1989"), ("secret", "password=p@ssw0rd!", "p@ssw0rd"), ("secret", 'token: "two words; #1"', "two words"),
])
def test_pseudonyms_of_other_spellings(kind, value, hidden):
    for text in (value, f"see {value} AND 12 more", f"({value})", f"{value}."):
        new, found = pseudonyms.pseudonymised(text, b"k")
        assert [k for k, *_ in found] == [kind] and hidden not in new, (text, new)
        assert pseudonyms.pseudonymised(new, b"k", reverse=True)[0] == text
    if kind == "account":
        plain = lambda t: re.sub("[ -]", "", t)
        new = pseudonyms.pseudonymised(value, b"k")[0]
        assert plain(new) == pseudonyms.pseudonymised(plain(value), b"k")[0] and [c in " -" for c in new] == [c in " -" for c in value]


def test_quotations_wrapped_anew_and_of_one_sentence(spark):
    rows = [
        (1, 0, "user", "A first part that is\nlong enough.\n\nAnother part follows here. It ends. Thanks."),
        (1, 1, "user", "Thanks."),
        (1, 2, "user", "Nothing of it."),
        (1, 3, "assistant", "> A first part\n> that is long enough.\nyes"),
        (1, 4, "assistant", "> Another part follows\n> here.\nwhere"),
        (1, 5, "assistant", "> A first part that\n> is long enough.\n>\n> Another part follows here. It\n> ends. Thanks.\nboth"),
        (1, 6, "assistant", "> A first\n> part that is long enough.\n>\n> Thanks. What else?\nno"),
    ]
    out = {r.turn: r for r in quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(out[t].reply_to, out[t].n_quoted, out[t].n_linked) for t in (3, 4, 5, 6)] == [(0, 1, 1)] * 4
    assert [out[t].text for t in (3, 4, 5, 6)] == ["yes", "where", "both", "no"]


def test_mixed_languages_stay(docs):
    rng = random.Random(5)
    syllables = {"xx": ["ka", "to", "mi"], "yy": ["bre", "sul", "wen"], "zz": ["жо", "ки", "ме"]}
    make = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(i, make(lang, 40), lang) for i in range(150) for lang in [rng.choice("xyz") * 2]]
    mixed = ". ".join([make("xx", 45), make("yy", 26), make("zz", 20)])
    strange = " ".join("".join(rng.choices("qjvxhfpg", k=7)) for _ in range(60))
    found = docs([(1, mixed, None)]).select(languages.language_of(languages.learn_languages(docs(rows)))("text").alias("f")).first().f
    assert found.score < 0.5 and [s.lang for s in found.spans] == ["xx", "yy", "zz"]
    kept = {r.doc_id for r in languages.with_language(docs([*rows, (1000, mixed, None), (1001, strange, None)])).collect()}
    assert kept == {i for i, *_ in rows} | {1000}


def plain_links(messages):
    """n_linked and reply_to of each (conv_id, turn, text), straight from the definition."""

    def normal(text):
        return " ".join(re.findall(r"[^\W_]+", text.lower()))

    def passages(text):
        out = []
        for line in re.split(r"\r?\n", text):
            marks = re.match(r"((?:[ \t]*>)*)[ \t]*(.*)$", line)
            level = marks[1].count(">")
            if not out or out[-1][0] != level:
                out.append((level, []))
            out[-1][1].append(marks[2] if level else line)
        return out

    def units(lines):
        paragraphs = re.split(r"\n(?:\s*\n)+", "\n".join(lines))
        ranks = {}
        for rank, some in enumerate(([*lines, " ".join(lines)], paragraphs, [s for p in paragraphs for s in re.split(r"(?<=[.!?])\s+", p)])):
            for unit in map(normal, some):
                ranks.setdefault(unit, rank) if unit else None
        return ranks

    own = {}
    for conv, turn, text in messages:
        for level, lines in passages(text):
            for unit in units(lines) if level == 0 else ():
                own[conv, unit] = min(turn, own.get((conv, unit), turn))
    out = {}
    for conv, turn, text in messages:
        best, linked = None, 0
        for level, lines in passages(text):
            if not level:
                continue
            hits = [(rank, -own[conv, u]) for u, rank in units(lines).items() if own.get((conv, u), turn) < turn]
            if hits:
                linked += 1
                best = min(x for x in (best, (level, min(hits)[1])) if x is not None)
        before = [t for c, t, _ in messages if c == conv and t < turn]
        out[conv, turn] = (linked, -best[1] if best else max(before, default=None))
    return out


def test_quotations_of_random_threads(spark):
    rng = random.Random(11)
    words_ = [f"word{i}" for i in range(400)]
    messages = []
    for conv in range(12):
        thread = []
        for turn in range(rng.randint(1, 9)):
            sentence = lambda: " ".join(rng.choice(words_) for _ in range(rng.randint(3, 7))).capitalize() + rng.choice(".!?")
            text = "\n\n".join(" ".join(sentence() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
            for _ in range(rng.randint(0, 2) if thread else 0):
                source = rng.choice(thread)
                part = rng.choice([source, rng.choice(source.split("\n")), rng.choice(re.split(r"(?<=[.!?])\s+", source))])
                if rng.random() < 0.3:
                    part = part.upper().replace(" ", rng.choice([" ", "  ", "\n"]), 2)
                quoted = "\n".join("> " + line for line in part.split("\n"))
                text = f"{quoted}\n{text}" if rng.random() < 0.5 else f"{text}\n{quoted}"
            thread.append(text)
            messages.append((conv, turn, text))
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in messages], "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): (r.n_linked, r.reply_to) for r in quotations.link_quotations(frame).collect()}
    assert found == plain_links(messages)
    assert sum(n for n, _ in found.values()) > 20


def test_fingerprints_of_many_paragraphs(spark, docs, monkeypatch):
    """Counters never run into each other: four times the paragraphs have four times the lanes."""
    many = spark.range(2).select(F.col("id").alias("doc_id"), F.repeat(F.lit("A line.\n"), F.when(F.col("id") == 0, 550_000).otherwise(2_200_000)).alias("text"))
    few, all_ = (r.lanes for r in fingerprints.lanes_of(many, ["doc_id"]).orderBy("doc_id").collect())
    assert [4 * x % fingerprints.MODULUS for x in few] == all_
    rows = [(i, " ".join(prose(random.Random(i), 5) + "." for _ in range(i)), None) for i in range(1, 40)] + EDGE[:6]
    whole = fingerprints.edited_fingerprints(docs(rows)).collect()
    monkeypatch.setattr(fingerprints, "PART", 3)
    assert sorted(map(str, fingerprints.edited_fingerprints(docs(rows)).collect())) == sorted(map(str, whole))
