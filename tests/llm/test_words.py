"""Operators on words - periodic runs, spelling variants, license scans - against brute force, and on odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from sievegrid.llm import licenses, periodic, spelling
from sievegrid.llm.queries import QUERIES
from sievegrid.session import stage, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_SCHEMA = "doc_id long, text string, run string, word string, row string, id string, n string, lang string"
ODD = [
    (1, None, "x", None, "x", "x", "x", "x"),
    (2, "", "x", "x", "x", None, "x", "x"),
    (None, "na na na na na na MIT License na", "x", "x", "x", "x", "x", None),
    (3, "solo", "x", "x", "x", "x", "x", "x"),
    (4, "lorem ipsum dolor " * 150_000 + "released under the MIT license", "x", "x", "x", "x", "x", "x"),
    (5, "letters letters letters lettres lettres é🎉", "x", "x", "x", "x", "x", "x"),
    (5, "letters letters letters lettres lettres é🎉", "x", "x", "x", "x", "x", "x"),
    (6, "x\x0by\x1cz", "x", "x", "x", "x", "x", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11


def brute_runs(words, least=6, times=4):
    """Every period at every place."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts(seed, texts=60):
    rnd = random.Random(seed)
    out = []
    for _ in range(texts):
        k, words = rnd.choice([1, 2, 3, 9]), []
        while len(words) < rnd.choice([1, 5, 6, 40, 150]):
            block = [f"w{rnd.randrange(k)}" for _ in range(rnd.randrange(1, 26))]
            words += (block * rnd.randrange(1, 8))[: rnd.randrange(1, 120)]
        out.append(rnd.choice([" ", "\n", " \t"]).join(words))
    return out


@pytest.mark.parametrize("least,times", [(6, 4), (9, 5)])
def test_runs_are_those_of_brute_force(spark, least, times):
    texts = periodic_texts(least)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = 0
    for r in periodic.periodic_runs(docs, least=least, times=times).collect():
        words = WORD.findall(texts[r.doc_id])
        want = brute_runs(words, least, times)
        assert [tuple(x) for x in r.runs] == want
        assert r.n_words == len(words) and r.collapsed == collapsed(words, want)
        found += len(want)
    assert found > 30


def test_long_periodic_texts_are_linear_enough(spark):
    block = " ".join(f"w{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, " ".join([block] * 5)), (2, "a " * 300_000), (3, ("a " * 999 + "b ") * 300)], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(docs).collect()}
    assert got[1] == [(0, 100_000, 20_000)]
    assert got[2] == [(0, 300_000, 1)]
    assert (0, 300_000, 1000) in got[3] and len(got[3]) == 301


def test_times_below_four_is_refused(spark, empty):
    with pytest.raises(ValueError):
        periodic.periodic_runs(empty, times=3)


def test_runs_of_odd_tables(spark, odd, empty):
    assert periodic.periodic_runs(empty).count() == 0
    got = periodic.periodic_runs(odd).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_words == by_id[2].n_words == 0 and by_id[1].collapsed == by_id[2].collapsed == ""
    assert [tuple(x) for x in by_id[None].runs] == [(0, 6, 1)] and by_id[None].collapsed == "na MIT License na"
    assert [tuple(x) for x in by_id[4].runs] == [(0, 450_000, 3)]
    assert by_id[6].n_words == 2
    assert sum(r.doc_id == 5 for r in got) == 2
    named = spark.createDataFrame([("a", "x x x x x x")], "key string, body string")
    assert [tuple(x) for x in periodic.periodic_runs(named, "key", "body").first().runs] == [(0, 6, 1)]


def test_query_of_runs_is_that_of_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    planted = 0
    for doc, text in texts.items():
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = brute_runs(words)
        first = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[doc]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *first)
        assert r.exponent_milli == (first[1] * 1000 // first[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 5 and sum(r.n_runs for r in got.values()) > 5


# 12


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    near = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts.get(form[w]), root)
    return out


def told(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(words).collect()}


def test_variants_are_those_of_brute_force(spark):
    rnd = random.Random(4)
    counts = Counter()
    for _ in range(400):
        word = "".join(rnd.choice("abÀé÷") for _ in range(rnd.randrange(1, 8)))
        counts[word] += rnd.choice([1, 3, 20, 400])
    want = brute_variants(counts)
    assert told(spark, counts) == want
    assert sum(v[2] is not None for v in want.values()) > 50 and max(v[1] for v in want.values()) >= 20


def test_chains_of_forms_lead_to_their_end(spark):
    words = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg", "akjihg", "lkjihg", "lkjihgm"]
    counts = {w: 5**i for i, w in enumerate(words)}
    got = told(spark, counts)
    assert got == brute_variants(counts)
    assert {v[4] for v in got.values()} == {"lkjihgm"}


def test_joins_of_words_send_nothing_to_the_driver(spark):
    words = stage(spark.createDataFrame([("forever", 50), ("forevr", 5)], "word string, n long"), "words")
    for table_ in (spelling.near_words(words), spelling.variants(words)):
        assert "Broadcast" not in table_._jdf.queryExecution().executedPlan().toString()


def test_words_of_equal_letters_are_not_near(spark):
    """720 orders of the same six letters, a sixth letter exchanged in some."""
    counts = {"".join(p): i + 1 for i, p in enumerate(itertools.permutations("abcdef"))}
    counts |= {w[:-1] + "g": 7 * n for w, n in list(counts.items())[:60]}
    assert told(spark, counts) == brute_variants(counts)


def test_letters_are_compared_as_code_points(spark):
    values = spark.createDataFrame([("é",), ("aé",), ("éa",)], "word string").select("word", spelling.anagram_value(spelling.F.col("word")).alias("v")).collect()
    got = {r.word: r.v for r in values}
    assert got["é"] == 0xE9**5 and got["aé"] == got["éa"] == 0xE9**5 + 97**5


def test_words_of_odd_tables(spark, odd, empty):
    counted = lambda docs, **o: {r.word: r.n for r in spelling.word_counts(spelling.letter_runs(docs, **o).select(spelling.F.col("run").alias("word")), least_count=4).collect()}
    assert counted(empty) == {} and told(spark, {}) == {}
    assert counted(odd) == {"letters": 6, "lettres": 4}
    assert counted(odd, id_col="id") == {"letters": 6, "lettres": 4}


def test_query_of_variants_is_that_of_brute_force(spark, sf):
    counts = Counter()
    edited = 0
    for r in table(spark, sf, "documents").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = lower(run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 199 == 0:
                run, edited = run[: h % len(run)] + run[h % len(run) + 1 :], edited + 1
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in QUERIES["op12_spelling_variants"](spark, sf).collect()}
    assert got == brute_variants(counts)
    assert edited and sum(v[2] is not None for v in got.values()) > 5


# 13


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_licenses(text, least=0.8):
    words = license_words(text)
    places = [(i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    matches = set()
    for label, t in licenses.TEMPLATES:
        s, t = licenses.block_size(t), set(t.split())
        for i in range(0, len(words), s):
            share = len(t & set(words[i : i + 2 * s])) / len(t)
            if share >= least:
                matches.add((i, 2 * s, label, share))
    return len(words), sorted(places), sorted(matches)


def noisy(text, rnd, drop, add):
    out = []
    for w in text.split():
        if rnd.random() >= drop:
            out.append(rnd.choice([w, w.upper(), w + ","]))
        if rnd.random() < add:
            out.append(f"own{rnd.randrange(99)}")
    return out


def test_licenses_are_those_of_brute_force(spark):
    rnd = random.Random(2)
    prose = " ".join(t for _, t in licenses.TEMPLATES).split()
    texts = []
    for i in range(150):
        _, template = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        around = [rnd.choice(prose) for _ in range(rnd.randrange(0, 300))]
        at = rnd.randrange(len(around) + 1)
        texts.append(" ".join(around[:at] + noisy(template, rnd, rnd.choice([0, 0.1, 0.2, 0.3]), rnd.choice([0, 0.1, 0.5])) + around[at:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = none = 0
    for r in licenses.license_scan(docs).collect():
        n, places, matches = brute_licenses(texts[r.doc_id])
        assert r.n_words == n and [(x.start, x.label) for x in r.places] == places
        assert [tuple(x) for x in r.matches] == matches
        labels = sorted({x[1] for x in places} | {x[2] for x in matches})
        assert r.labels == labels and r.base_labels == sorted({x[1] for x in places})
        assert r.score == (1.0 if places else max((x[3] for x in matches), default=0.0))
        some, none = some + bool(matches), none + (not matches)
    assert some > 50 and none > 10


def test_whole_notices_are_found_and_prose_is_not(spark):
    rows = [(i, f"intro words here {t} more words") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    rows.append((99, "the license of the work is by the author and the copyright notice of this software is in all copies " * 40))
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i].labels and got[i].score == 1.0
    assert got[99].labels == [] and got[99].score == 0.0


def test_own_phrases_and_templates(spark):
    docs = spark.createDataFrame([("a", "do what you want with this one two three"), ("b", "nothing")], "key string, body string")
    got = {r.key: r for r in licenses.license_scan(docs, [("one two", "own")], [("free", "do what you want with this")], 1.0, "key", "body").collect()}
    assert got["a"].labels == ["free", "own"] and got["a"].base_labels == ["own"] and got["b"].labels == []
    bare = {r.key: r for r in licenses.license_scan(docs, [("one two", "own")], [], id_col="key", text_col="body").collect()}
    assert bare["a"].labels == ["own"] and bare["a"].matches == []
    assert {tuple(r.labels) for r in licenses.license_scan(docs, [], [("free", "do what you want with this")], 1.0, "key", "body").collect()} == {("free",), ()}


def test_licenses_of_odd_tables(spark, odd, empty):
    assert licenses.license_scan(empty).count() == 0
    got = licenses.license_scan(odd).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_words == by_id[2].n_words == 0 and by_id[1].labels == [] and by_id[1].score == 0.0
    assert by_id[None].labels == ["mit"] and [x.start for x in by_id[None].places] == [6]
    assert by_id[4].n_words == 450_005 and [x.start for x in by_id[4].places] == [450_003]
    assert by_id[6].n_words == 3
    assert licenses.license_scan(odd, id_col="id").where("id is null").count() == 1
