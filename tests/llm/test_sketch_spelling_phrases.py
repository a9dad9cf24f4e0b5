"""Operators 11 to 13 against plain versions."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import phrases, queries, set_sketch, spelling

from . import helpers

SF = "/root/testdata/sf0.001"
MORE = ["word", "n", "bucket", "registers", "leads", "doc", "phrase", "hot", "w1", "f", "mask", "a", "b"]


def frame(spark, data):
    return helpers.frame(spark, data).withColumns({c: F.lit("x") for c in MORE})


def doc(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", 1, "h", True, 3)


# --- 11 ----------------------------------------------------------------------------------------


def shingles(text, k=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(helpers.LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(data, percent=80):
    """doc_id -> (shingles, smallest doc_id reachable, kept), by comparing all pairs."""
    sets = {r[0]: shingles(r[1]) for r in data}
    parent = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = helpers.find(parent, a), helpers.find(parent, b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), helpers.find(parent, i), helpers.find(parent, i) == i) for i in sets}


def found(spark, data):
    return {r["doc_id"]: tuple(r)[1:] for r in set_sketch.near_duplicates(frame(spark, data)).collect()}


def test_near_duplicates_by_registers(spark):
    data = helpers.rows(7)
    assert found(spark, data) == near(data)


def test_large_groups_whose_copies_differ(spark):
    """Copies of one text that are linked by chains only, two groups that one document joins, and pairs at the threshold."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    data = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(1, 16)):
            words[rng.randrange(200)] = f"u{rng.randrange(9999)}"
        data.append(doc(1000 - i, " ".join(words)))
    data += [doc(2000 + i, " ".join(base[i : i + 120])) for i in range(0, 80, 2)]
    exact = [f"x{i}" for i in range(46)]  # 45 shingles
    data += [doc(3000, " ".join(exact)), doc(3001, " ".join(exact[:37])), doc(3002, " ".join(exact[:36]))]  # 36 and 35 of them
    want = near(data)
    assert want[3001][1] == 3000 and want[3002][1] == 3000 and want[1000 - 149][0] > 0
    assert found(spark, data) == want


def test_copies_too_far_for_a_link_make_next_to_no_pairs(spark, monkeypatch):
    """150 copies of one text, each word at 40 places being one of two: most pairs are as alike as 0.66, few as 0.8."""
    rng = random.Random(5)
    places = rng.sample(range(200), 40)
    data = []
    for i in range(150):
        words = [f"w{j}" for j in range(200)]
        for j in places:
            words[j] = f"{'uv'[rng.randrange(2)]}{j}"
        data.append(doc(i, " ".join(words)))
    asked, likely = [], set_sketch.likely
    monkeypatch.setattr(set_sketch, "likely", lambda pairs, reps, percent: (asked.append(pairs.count()), likely(pairs, reps, percent))[1])
    want = near(data)
    assert len({w[1] for w in want.values()}) > 50
    assert found(spark, data) == want
    assert len(asked) == 2 and asked[1] < 300


def test_odd_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(2)
    every = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    sets = [np.sort(every[:n]) for n in (0, 1, 100, 130, 3000)]
    bits = np.unpackbits(set_sketch.odd_sketches(sets).view(np.uint8), axis=1)
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        apart, found = len(np.setxor1d(a, b)), int((bits[i] != bits[j]).sum())
        assert found <= apart and (found - apart) % 2 == 0
    assert (bits[2] != bits[3]).sum() >= 26  # of 30
    assert set_sketch.odd_sketches([]).shape == (0, set_sketch.ODD_BITS // 64)


def test_near_duplicates_of_odd_rows(spark):
    data = [doc(None, "a b c"), doc(9, "A b\tc"), doc(9, "a b c"), doc(4, "a b c"), doc(5, None), doc(6, " \n"), doc(7, ""), doc(8, "one"), doc(3, "ONE")]
    got = sorted((tuple(r) for r in set_sketch.near_duplicates(frame(spark, data)).collect()), key=repr)
    assert got == sorted([(None, 2, None, None), (9, 2, 4, False), (9, 2, 4, False), (4, 2, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 3, False), (3, 1, 3, True)], key=repr)
    assert set_sketch.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("similarity", [0.3, 0.6, 0.8, 0.95])
def test_registers_agree_as_their_likelihood_says(similarity):
    rng = np.random.default_rng(int(similarity * 100))
    n = 800
    both = round(2 * n * similarity / (1 + similarity))
    rows = []
    for _ in range(20):
        every = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
        rows.append(set_sketch.registers([np.sort(every[:n]), np.sort(every[n - both :])]))
    one, two = (np.stack([r[i] for r in rows]) for i in (0, 1))
    share = 1 - 2 * set_sketch.larger_share(np.array((1 - similarity) / 2))
    assert abs((one == two).mean() - share) < 0.02
    guess, _ = set_sketch.estimate(one, two, np.full(20, n), np.full(20, n), 0.8)
    assert abs(guess.mean() - similarity) < 0.02
    if similarity == 0.8:
        assert (((one ^ two) & 1).sum(1) < set_sketch.coarse_bits(0.8)).all()


def test_registers_of_a_union_are_the_maxima():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (50, 300))
    one, two, both = set_sketch.registers([np.sort(a), np.sort(b), np.unique(np.concatenate([a, b]))])
    assert (np.maximum(one, two) == both).all()


# --- 12 ----------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(counts, factor=10):
    words = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    close = defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            close[a].append(b)
            close[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in close[w]), default=None)
        form[w] = best[1] if best and -best[0] >= factor * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(close[w]), words[form[w]] if form[w] else None)
    return out


def plain_counts(data):
    counts = Counter()
    for doc_id, text, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(helpers.LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def spelled(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_against_all_pairs(spark):
    """Every kind of edit at every place, letters past ASCII, letters that share a bit, ties and chains of forms."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzßéèüÿ÷×"
    counts = {}
    for _ in range(60):
        base = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 14)))
        counts[base] = rng.choice([2, 30, 400, 5000])
        for _ in range(12):
            at = rng.randrange(len(base) + 1)
            word = rng.choice([base[:at] + base[at + 1 :], base[:at] + rng.choice(letters) + base[at + 1 :], base[:at] + rng.choice(letters) + base[at:]])
            counts.setdefault(word, rng.choice([1, 2, 3, 39, 40, 41, 500]))
    counts |= {"mississippi": 3, "misissippi": 40, "missisippi": 40, "mississipi": 500, "mississip": 9999, "abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "short": 50, "shor": 7}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelled(spelling.variants(words))
    assert got == plain_variants(counts)
    assert got["abcdefg"][1] == "abcdefghij" and got["mississippi"][0] == "mississipi"
    assert spelling.variants(words.limit(0)).count() == 0


def test_word_counts_and_variants_of_documents(spark):
    data = [doc(i, "Colour colours, kaleidoscopes kaleidoscope KALEIDOSCOPE xKaleidoscope naïveté Naïvetés straße×straßen İstanbullular short " * 2) for i in range(60)]
    data += [doc(70, None), doc(71, ""), doc(None, "kaleidoscope kaleidoscopf"), *data[:9], *helpers.rows(9, 40)]
    assert {r["word"]: r["n"] for r in spelling.word_counts(frame(spark, data), plant=True).collect()} == {w: n for w, n in plain_counts(data).items() if len(w) >= 7}
    plain = Counter(run.translate(helpers.LOWER) for r in data for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""))
    assert {r["word"]: r["n"] for r in spelling.word_counts(frame(spark, data)).collect()} == {w: n for w, n in plain.items() if len(w) >= 7}
    assert spelled(spelling.variants(spelling.word_counts(frame(spark, data), plant=True))) == plain_variants(plain_counts(data))
    assert spelling.variants(spelling.word_counts(frame(spark, []), plant=True)).count() == 0


def test_spelling_query_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = spelled(queries.QUERIES["op12_spelling_variants"](spark, SF))
    assert got == plain_variants(plain_counts([tuple(r) for r in rows]))


# --- 13 ----------------------------------------------------------------------------------------


def plain_phrases(data, max_n=3, min_count=10, inside=50, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(helpers.LOWER)):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for n in range(1, max_n + 1):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        longer = Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longer[p[i : i + n]] = max(longer[p[i : i + n]], a)
        rows = []
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= inside * a:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("max_n", "top"), [(2, 2000), (3, 5), (4, 2000)])
def test_phrases_against_counting(spark, monkeypatch, max_n, top):
    """Also with flushes within a text, and with many words that are spread over partitions."""
    rng = random.Random(4)
    words = ["the", "Of", "été", "a", "b", "\x01odd", "a\x01", "new", "york", "city", "№5", "日本", "x y"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " new york city "]) for _ in range(rng.randrange(1, 60)))
    data = [doc(i, text(), rng.choice(["en", "en", "fr", None])) for i in range(200)] + [doc(500, None, "de"), doc(501, "", None), doc(None, "new york " * 2000)]
    data += data[:20] + [doc(502, " ".join(f"rare{i}" for i in range(3000)))]
    want = plain_phrases(data, max_n, top=top)
    assert len(want) > 10
    monkeypatch.setattr(phrases, "FLUSH", 50)
    monkeypatch.setattr(phrases, "PAIRS_FLUSH", 200)
    monkeypatch.setattr(phrases, "SPREAD", 3)
    assert sorted(map(tuple, phrases.collocations(frame(spark, data).repartition(5), max_n, top=top).collect())) == want


def test_phrases_of_nothing(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [doc(1, None), doc(2, "one two")])).count() == 0


# --- queries -----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op11_minhash_near_dedup", "op13_phrase_collocations"])
def test_query_gives_what_sql_gives(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want)
