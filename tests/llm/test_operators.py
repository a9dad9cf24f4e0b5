"""The numbered operators against plain versions, on documents with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat_quotes, components, decontaminate, encode, exact_dedup, line_dedup, ngram_join, packing, pii, quality, token_counts, token_files

from . import helpers

SHORT = dict(zip(helpers.SCHEMA.split(", "), range(8), strict=True))


def test_near_duplicates(spark, monkeypatch):
    data = helpers.rows()
    want = helpers.near_components(data)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(helpers.frame(spark, data)).collect()}
    assert got == want


def test_near_duplicates_frequent_shingles(spark, monkeypatch):
    """Groups of near copies larger than RARE, which only share frequent shingles."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    other = base[:60] + [f"v{i}" for i in range(60)]
    data = []
    for i in range(60):
        words = list(base if i < 40 else other)
        for _ in range(2):
            words[rng.randrange(120)] = f"u{rng.randrange(9999)}"
        data.append((i, " ".join(words), "en", "s", 1, "h", True, 3))
    data += [(100 + i, " ".join(base[i : i + 50]), "en", "s", 1, "h", True, 3) for i in range(0, 70, 3)]
    want = helpers.near_components(data)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(helpers.frame(spark, data)).collect()}
    assert got == want


def test_near_duplicates_null_id_and_empty(spark):
    data = [(None, "a b c d e f", "en", "s", 1, "h", True, 3), (4, "a b c d e f", "en", "s", 1, "h", True, 3), (4, "a b c d e f", "en", "s", 1, "h", True, 3)]
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.near_duplicates(helpers.frame(spark, data)).collect())
    assert got == [(-1, None), (4, 4), (4, 4)]
    assert ngram_join.near_duplicates(helpers.frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (200, 200), (60, 50), (60, 55)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 103: 100, 50: 50, 55: 50, 60: 50}


def test_contamination(spark):
    data = helpers.rows(2)
    texts = [r[1] for r in data if r[1] and len(r[1].split()) > 14]
    items = [(i, " ".join(texts[i * 5].split()[2:16])) for i in range(8)] + [(50, "nowhere to be found, this"), (51, "42"), (52, ""), (53, None), (54, " ".join(texts[0].split()[2:16])), (55, texts[3]), (56, " ".join(texts[-1].split()[500:540]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = helpers.contamination(data, items)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.contamination(helpers.frame(spark, data), bench).collect()}
    assert got == want
    none = decontaminate.contamination(helpers.frame(spark, data), bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0
    assert decontaminate.contamination(helpers.frame(spark, []), bench).count() == 0


def test_contamination_names_items_of_any_type(spark):
    bench = spark.createDataFrame([("q-10", "one two three"), ("q-9", "two three four"), ("q-9", "five six"), (None, "one two")], "item_id string, text string")
    got = decontaminate.contamination(spark.createDataFrame([(1, "zero ONE two. three four"), (2, "five, six")], "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["n_hit"], r["items"]) for r in got) == [(1, 4, ["q-10", "q-9"]), (2, 2, ["q-9"])]


def exact(data):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups: dict = {}
    for r in data:
        groups.setdefault(key(r[1]), []).append((-len(r[1] or ""), r[0]))
    return {r[0]: (min(groups[key(r[1])])[1], len(groups[key(r[1])]), min(groups[key(r[1])])[1] == r[0], hashlib.sha256(key(r[1]).encode()).hexdigest()) for r in data}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, tmp_path, weak):
    """Also with a digest of one hex digit, so that different texts meet in one state row."""
    data = helpers.rows(3)
    helpers.frame(spark, data).repartition(5).write.parquet(f"file://{tmp_path}/docs.parquet")
    digest = (lambda norm: F.unhex(F.concat(F.lit("0"), F.left(F.sha2(norm, 256), F.lit(1))))) if weak else exact_dedup.sha256
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.deduplicated(spark, f"file://{tmp_path}/docs.parquet", digest=digest).collect()}
    assert got == exact(data)


def test_exact_dedup_empty(spark, tmp_path):
    helpers.frame(spark, []).write.parquet(f"file://{tmp_path}/docs.parquet")
    assert exact_dedup.deduplicated(spark, f"file://{tmp_path}/docs.parquet").count() == 0
    assert exact_dedup.deduplicated(spark, f"file://{tmp_path}/docs.parquet", state=f"file://{tmp_path}/state").count() == 0


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    """Several batches, a call with nothing new, and one on grown input, in a folder whose name is a glob."""
    data = helpers.rows(3)
    where, state = f"file://{tmp_path}/a[b]{{c}}*/docs.parquet", f"file://{tmp_path}/state"
    run = lambda: {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.deduplicated(spark, where, state=state, max_bytes_per_batch=1).collect()}
    helpers.frame(spark, data[:70]).repartition(3).write.parquet(where)
    assert run() == exact(data[:70])
    batches = len(list((tmp_path / "state" / "commits").glob("[0-9]*")))
    assert batches >= 3
    assert run() == exact(data[:70])
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) == batches
    helpers.frame(spark, data[70:]).repartition(2).write.mode("append").parquet(where)
    assert run() == exact(data)
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) == batches + 2


def test_line_dedup(spark):
    data = helpers.rows(4) + [(5000, None, "en", "s", 0, "h", True, 3)]
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(helpers.LOWER)
    holders: dict = {}
    for doc_id, text, *_ in data:
        for line in (text or "").split("\n"):
            holders.setdefault(strip(line), set()).add(doc_id)
    want = {}
    for doc_id, text, *_ in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(strip(x)) < 40 or len(holders[strip(x)]) < 5 or max(holders[strip(x)]) == doc_id]
        want[doc_id] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.deduplicated_lines(helpers.frame(spark, data)).collect()}
    assert got == want
    assert sum(w[2] for w in want.values()) > 5
    assert line_dedup.deduplicated_lines(helpers.frame(spark, [])).count() == 0


def lines_kept(data):
    """(doc_id, kept text, lines, dropped lines) of every row; rows without an id are one document, below all others."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(helpers.LOWER)
    holders: dict = {}
    for doc_id, text, *_ in data:
        for line in (text or "").split("\n"):
            holders.setdefault(strip(line), set()).add(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text, *_ in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(strip(x)) < 40 or len(holders[strip(x)]) < 5 or max(holders[strip(x)]) == (-1 if doc_id is None else doc_id)]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_counts_documents(spark):
    """One document in three rows and two others are three documents."""
    line = "this line is of forty characters or more, surely"
    data = [(1, line, "en", "s", 1, "h", True, 3)] * 3 + [(i, line + "\nx", "en", "s", 1, "h", True, 3) for i in (2, 3)]
    assert all(r["n_dropped"] == 0 for r in line_dedup.deduplicated_lines(helpers.frame(spark, data)).collect())
    data += [(i, line, "en", "s", 1, "h", True, 3) for i in (4, None)]
    got = line_dedup.deduplicated_lines(helpers.frame(spark, data)).collect()
    assert sorted((repr(r["doc_id"]), r["kept"]) for r in got) == sorted((repr(a), b) for a, b, *_ in lines_kept(data))
    assert sum(r["n_dropped"] for r in got) == 6


def same(got, want) -> None:
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_repeated_rows_and_rows_without_id(spark, tmp_path):
    """Every operator over rows that repeat, some of them without an id."""
    data = helpers.repeated(31)
    docs = helpers.frame(spark, data)
    named = {r[0]: r for r in data if r[0] is not None}
    near = helpers.near_components(list(named.values()))
    got = ngram_join.near_duplicates(docs).collect()
    same([(r["doc_id"], r["component_id"]) for r in got], [(r[0], None if r[0] is None else near[r[0]][1]) for r in data])

    items = [(i, " ".join((data[12 + i][1] or "x").split()[:12])) for i in range(5)]
    plain = lambda r: helpers.contamination([r], items)[r[0]]
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    same([(r["doc_id"], (r["n_words"], r["n_hit"], r["items"])) for r in got], [(r[0], plain(r)) for r in data])

    docs.write.parquet(f"file://{tmp_path}/docs.parquet")
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups: dict = {}
    for r in data:
        groups.setdefault(key(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0]))
    got = exact_dedup.deduplicated(spark, f"file://{tmp_path}/docs.parquet").collect()
    first = lambda r: min(groups[key(r[1])], key=lambda g: (g[0], g[1], g[2] or 0))[2]
    same([(r["doc_id"], r["keep_id"], r["group_size"]) for r in got], [(r[0], first(r), len(groups[key(r[1])])) for r in data])
    assert sum(r["kept"] for r in got) == len(groups)

    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.packed(docs, path, 1, 256).collect()
    ids = {r[1]: ids_of("word_bpe_49k.json", 1, r[1]) for r in data}
    same([(r["doc_id"], r["start"], r["length"]) for r in got], [(r[0], i, len(ids[r[1]][i : i + 256])) for r in data for i in range(0, len(ids[r[1]]), 256)])
    room: dict = {}
    for r in got:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in room.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]

    got = token_files.token_files(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), 2).collect()
    ids = {r[1]: ids_of("byte_bpe_50k.json", 2, r[1]) for r in data}
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], [(r[0], len(ids[r[1]]), crc(ids[r[1]])) for r in data])
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    in_order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert in_order == sorted(in_order, key=lambda i: -1 if i is None else i)

    path = public_tokenizers.path("piece_bpe_32k.model")
    count = token_counts.UnigramCounter(*token_counts.unigram_vocabulary(path))
    same([(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(docs, path).collect()], [(r[0], count.text(r[1] or "")) for r in data])
    assert token_counts.token_counts(helpers.frame(spark, []), path).count() == 0

    got = pii.personal_data(docs).collect()
    same([(r["doc_id"], [tuple(s) for s in r["base"]]) for r in got], [(r[0], helpers.base_spans(r[1])) for r in data])

    labels = spark.createDataFrame([(i, 1, 0) for i in list(named)[::3]] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classified(docs, labels).collect()
    same([r["doc_id"] for r in got], [r[0] for r in data])
    for i in set(named):
        assert len({(r["log_weight"], r["key"], r["kept"]) for r in got if r["doc_id"] == i}) == 1

    got = line_dedup.deduplicated_lines(docs).collect()
    same([tuple(r) for r in got], [(a, b, c, d) for a, b, c, d in lines_kept(data)])


TOKENIZERS = [("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 1)]


@pytest.mark.parametrize(("name", "end"), TOKENIZERS)
def test_encoding_by_pieces_is_encoding_of_texts(name, end):
    import pyarrow as pa

    path = public_tokenizers.path(name)
    rng = random.Random(3)
    texts = [r[1] or "" for r in helpers.rows(6)]
    alphabet = list("aB 's\n\t.,'é×́  1²☃ßΣ") + [" don't", "  ", ".\n", "\r\n", "<|endoftext|>", "é ", " 　x"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    whole = encode.encoder(path).tokenizer
    for row, ids in encode.encoded(pa.array(texts), path, end):
        assert ids.tolist() == [*whole.encode(texts[row], add_special_tokens=False).ids, end], texts[row]


def ids_of(name: str, end: int, text: str | None) -> list[int]:
    return [*encode.encoder(public_tokenizers.path(name)).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


@pytest.mark.parametrize("id_bytes", [2, 4])
def test_token_files(spark, id_bytes):
    data = helpers.rows(7)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.token_files(spark, helpers.frame(spark, data), public_tokenizers.path("byte_bpe_50k.json"), 2, id_bytes).collect()}
    start, want = 0, {}
    for r in sorted(data, key=lambda r: r[0]):
        ids = ids_of("byte_bpe_50k.json", 2, r[1])
        want[r[0]] = (start, len(ids), crc(ids))
        start += len(ids)
    assert got == want
    assert token_files.token_files(spark, helpers.frame(spark, []), public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 0


def test_packing(spark):
    data = helpers.rows(8)
    capacity = 256
    got = packing.packed(helpers.frame(spark, data), public_tokenizers.path("word_bpe_49k.json"), 1, capacity).collect()
    want = set()
    for r in data:
        ids = ids_of("word_bpe_49k.json", 1, r[1])
        want |= {(r[0], i // capacity, i, len(ids[i : i + capacity]), crc(ids[i : i + capacity])) for i in range(0, len(ids), capacity)}
    assert {tuple(r)[:5] for r in got} == want
    assert len(got) == len(want)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= -(-sum(w[3] for w in want) // capacity) + 2
    assert packing.packed(helpers.frame(spark, []), public_tokenizers.path("word_bpe_49k.json"), 1).count() == 0


def test_packing_plan_is_exact_and_tight():
    import numpy as np

    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 513, 900), np.full(300, 171), np.full(301, 257), rng.integers(200, 300, 500), np.array([512] * 5), np.array([], int)):
        counts = np.bincount(lengths, minlength=513)
        plan = packing.solve(counts, 512)
        held = np.zeros(513, int)
        for parts, copies in plan:
            assert sum(parts) <= 512
            assert copies > 0
            for n in parts:
                held[n] += copies
        assert (held == counts).all()
        used = sum(copies for _, copies in plan)
        by_size = -(-int(lengths.sum()) // 512)
        by_half = int((lengths > 256).sum())
        plain = sum(c for _, c in packing.best_fit(counts.copy(), [], 512))
        assert max(by_size, by_half) <= used <= plain + 1


def test_token_counts_match_the_unigram_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary, unknown = token_counts.unigram_vocabulary(path)
    whole = Tokenizer(models.Unigram(vocabulary, unknown, byte_fallback=True))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(2)
    data = helpers.rows(9) + [(9000 + i, "".join(rng.choice(["a", "b", " ", "☃", "▁", "\n", "日", "x", "<unk>", " e", "\n\n\n", "\U0001f600", "<0x0A>"]) for _ in range(rng.randrange(40))), "en", "s", 0, "h", True, 3) for i in range(300)]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(helpers.frame(spark, data), path).collect()}
    assert got == {r[0]: len(whole.encode(r[1] or "", add_special_tokens=False).ids) for r in data}


def test_unigram_ties():
    """Equal scores: the longest last piece that came first stays."""
    from tokenizers import Tokenizer, models

    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("c", -1.5)]
    count, whole = token_counts.UnigramCounter(vocabulary, 0), Tokenizer(models.Unigram(vocabulary, 0))
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))
        assert count.word(text) == len(whole.encode(text).ids), text


def test_personal_data(spark):
    rng = random.Random(6)
    parts = ["a.b@c.de", "x_y@z.co.uk._q@r.st", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1234", "é", " ", "@", "+", "12", ".", "-", "4380591392785139", "0000000000000000000000", "+44.20.7946.0958-1", "日", "\n"]
    data = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25))), "en", "s", 0, "h", True, 3) for i in range(400)] + helpers.rows(10)[:40]
    data = [(i, *r[1:]) for i, r in enumerate(data)]
    data += [(5000, "7" * 60_000, "en", "s", 0, "h", True, 3), (5001, "a." * 30_000, "en", "s", 0, "h", True, 3), (5002, "1 " * 20_000, "en", "s", 0, "h", True, 3)]
    got = {r["doc_id"]: r for r in pii.personal_data(helpers.frame(spark, data)).collect()}
    assert len(got) == len(data)
    for r in data:
        if r[0] < 5000:
            assert [tuple(s) for s in got[r[0]]["base"]] == helpers.base_spans(r[1]), r[1]
    assert all(not got[i]["base"] for i in (5000, 5001, 5002))
    assert pii.personal_data(helpers.frame(spark, [])).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    texts = [f"please callme +1 555 010 {1000 + i} today" for i in range(12)] + ["please callme 555-0199-77 today", "order 12345-678 shipped", "just callme"]
    texts += [f"order 1.2.3.{i} went" for i in range(4)] + ["order now", "order then", "order it"] * 8
    data = [(i, t, "en", "s", 0, "h", True, 3) for i, t in enumerate(texts)]
    got = {r["doc_id"]: [(s["start"], pii.KINDS[s["kind"]], s["end"]) for s in r["added"]] for r in pii.personal_data(helpers.frame(spark, data)).collect()}
    assert got[12] == [(14, "phone", 25)]
    assert not any(v for k, v in got.items() if k != 12)


def added(spark, texts):
    data = [(i, t, "en", "s", 0, "h", True, 3) for i, t in enumerate(texts)]
    return {texts[r["doc_id"]]: [(pii.KINDS[s["kind"]], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["added"]] for r in pii.personal_data(helpers.frame(spark, data)).collect() if r["added"]}


def test_found_instances_induce_further_patterns(spark):
    """Numbers in groups that "callme" leads to make sure of "ring", which leads to no base span, and that to one more."""
    texts = [f"callme +1 555 010 {1000 + i} today" for i in range(24)]
    texts += [f"{word} {number} x" for word in ("callme", "ring") for number in ("555 010 1234", "(555) 010-9999", "078 05 1120")] + ["ring 0171 555 0199 x", "room 12 x", "room 13 x", "room 14 x"]
    got = added(spark, texts)
    assert got == {t: [("phone", t.split(" ", 1)[1].removesuffix(" x"))] for t in texts if t.startswith("ring") or (t.startswith("callme") and "+" not in t)}


def test_patterns_of_any_length_and_distance(spark):
    """A long word before a seed, many blanks between; something@somewhere without a dot."""
    long = "x" * 70
    texts = [f"{word}{gap}user{i}@host.example z" for i in range(12) for word, gap in ((long, " "), ("mail", " " * 60))] + [f"{long} jane@intranet z", "mail joe@intranet z"]
    assert added(spark, texts) == {texts[-2]: [("email", "jane@intranet")], texts[-1]: [("email", "joe@intranet")]}


def test_positions_of_many_matches(spark):
    """More matches than are added up in one go."""
    text = "é " + " ".join(f"u{i}@ex.org 10.0.{i % 250}.{i // 250}" for i in range(1000))
    got = pii.personal_data(helpers.frame(spark, [(1, text, "en", "s", 0, "h", True, 3)])).first()
    assert [tuple(s) for s in got["base"]] == helpers.base_spans(text)
    assert len(got["base"]) == 2000


def test_quality_catches_what_the_target_lacks(spark):
    rng = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]
    bad = ["idiot", "moron", "clown", "scum"]
    data, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for b in bad:
                text.insert(rng.randrange(len(text)), b)
        data.append((i, " ".join(text), "en", "s", 0, "h", True, 3))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    toxic = {r[0] for r in data if set(r[1].split()) & set(bad)}
    data += [(9001, None, "en", "s", 0, "h", True, 3), (9002, "", "en", "s", 0, "h", True, 3)]
    got = {r["doc_id"]: r["kept"] for r in quality.classified(helpers.frame(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held_out = [i for i in got if i % 2 == 0 and i < 9000]
    assert sum(got[i] for i in held_out if i in toxic) == 0
    clean = [got[i] for i in held_out if i not in toxic]
    assert sum(clean) >= 0.98 * len(clean)
    assert got[9001]
    assert got[9002]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in quality.classified(helpers.frame(spark, data[:50]), none).collect())
    assert quality.classified(helpers.frame(spark, []), none).count() == 0


def test_quality_sees_word_order_and_repetition(spark):
    """Rows that hold the words of all others, in another order, or one pair of them over and over."""
    rng = random.Random(9)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(60)]
    data, labels, bad = [], [], {}
    for i in range(1200):
        pairs = [rng.choice(words) + " " + rng.choice(words) for _ in range(40)]
        bad[i] = (None, "order", "often")[0 if rng.random() < 0.7 else rng.choice((1, 2))]
        pairs += ["beta alpha" if bad[i] == "order" else "alpha beta"] * 6 + ["gamma delta"] * (60 if bad[i] == "often" else 2)
        rng.shuffle(pairs)
        data.append((i, " ".join(pairs), "en", "s", 0, "h", True, 3))
        if i % 2:
            labels.append((i, int(bad[i] is None), 0))
    got = {r["doc_id"]: r["log_weight"] for r in quality.weights(helpers.frame(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), margin=-100.0).collect()}
    mean = {kind: sum(got[i] for i in got if i % 2 == 0 and bad[i] == kind) / sum(i % 2 == 0 and bad[i] == kind for i in got) for kind in (None, "order", "often")}
    assert mean["order"] < mean[None] - 2
    assert mean["often"] < mean[None] - 2


def plain_quality(data, labels, prior=2.0, doubt=9.0, cluster=0.015, span=1000.0, margin=1.5, length=150.0, neutral=100.0, sharpness=8.0, seed=17):
    """doc_id -> (log weight, key), and the doc_ids that stay, without hashing of n-grams."""
    import math
    import struct
    from collections import Counter

    import xxhash

    def grams(text):
        raw = (text or "").encode()
        words = re.findall(rb"[0-9a-z\x80-\xff]+", raw.lower())
        out = Counter(("end", t[-3:]) for t in re.findall(rb"[^ \t\n\x0b\x0c\r]+", raw)) + Counter(("word", w) for w in words) + Counter(zip(words, words[1:], strict=False))
        for n in (4, 5):
            out += Counter((n, w[:n]) for w in words if len(w) > n)
        return out

    good = {i for i, quality, toxic in labels if quality == 1 and toxic == 0}
    chars: dict = {}
    for doc_id, text, lang, *_ in data:
        each = chars.setdefault(lang, [0, 0])
        each[0] += min(len(text or ""), span * 1.2) * (doc_id in good)
        each[1] += min(len(text or ""), span * 1.2)
    share = {lang: t / n if n else 0.0 for lang, (t, n) in chars.items()}
    held = []
    for r in data:
        g = grams(r[1])
        held.append((r[0], r[2], {x: n * min(1.0, span / sum(g.values())) for x, n in g.items()}, g))
    target, expected = Counter(), Counter()
    for doc_id, lang, counted, _ in held:
        for x, n in counted.items():
            target[x] += n * (doc_id in good)
            expected[x] += n * share[lang]
    scale = sum(target.values()) / max(sum(expected.values()), 1e-9)
    out = {}
    for doc_id, lang, counted, g in held:
        total = 0.0
        for x, n in g.items():
            seen, due = max(0.0, target[x] - counted[x] * (doc_id in good)), max(0.0, expected[x] - counted[x] * share[lang]) * scale
            total += n * math.log((seen + prior) / (due + prior)) / (1 + (doubt * (due + prior + cluster * due**2) / max((seen - due) ** 2, 1e-9)) ** 2)
        weight = min(0.0, length * total / (sum(g.values()) + neutral) + margin)
        hashed = xxhash.xxh64(struct.pack("<i", seed), seed=xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()).intdigest()
        noise = -math.log(-math.log(((hashed & ((1 << 52) - 1)) + 0.5) / (1 << 52)))
        out[doc_id] = (weight, sharpness * weight + noise)
    k = round(sum(math.exp(w) for w, _ in out.values()))
    return out, set(sorted(out, key=lambda i: -out[i][1])[:k])


def test_quality_against_a_plain_version(spark):
    """Weights, keys and the rows chosen, in two languages; a long text, nulls, and rows that are rejected."""
    rng = random.Random(12)
    words, bad = ["Alpha", "beta,", "gammas", "delta's", "été", "zeta42", "eta"], ["rotten", "filthy", "vile"]
    data, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        text = " ".join(rng.choice(bad if toxic and rng.random() < 0.3 else words) for _ in range(rng.randrange(5, 60)))
        data.append((i, text, "en" if i % 3 else "fr", "s", 0, "h", True, 3))
        if i % 2:
            labels.append((i, int(not toxic), 0))
    data += [(900, None, "en", "s", 0, "h", True, 3), (901, "", None, "s", 0, "h", True, 3), (902, " ".join(rng.choice(words) for _ in range(60_000)), "en", "s", 0, "h", True, 3)]
    want, stay = plain_quality(data, labels)
    got = quality.classified(helpers.frame(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for r in got:
        assert r["log_weight"] == pytest.approx(want[r["doc_id"]][0], abs=1e-3)
        assert r["key"] / quality.KEY_STEPS == pytest.approx(want[r["doc_id"]][1], abs=1e-2)
    assert {r["doc_id"] for r in got if r["kept"]} == stay
    assert 20 < len(data) - len(stay) < 200


def test_quality_leaves_copies_alone(spark):
    """Groups of copies of which none, or fewer than others, happen to be labelled stay; so do rows rejected words are not in."""
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(300)]
    data = [(i, texts[i if i < 300 else i % 7 if i < 320 else rng.choice((8, 8, 9, 10, 11))], "en", "s", 0, "h", True, 3) for i in range(700)]
    labels = [(i, 1, 0) for i in range(700) if rng.random() < 0.4 and i % 7 > 1]
    got = quality.classified(helpers.frame(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sum(not r["kept"] for r in got) <= 7


def test_quality_recall_on_held_out_labels(spark):
    """Labels of odd doc_id are learned from; of the others a weight under a half counts as rejected."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.weights(docs, labels.filter("doc_id % 2 = 1")).join(labels.filter("doc_id % 2 = 0"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good")
    share = {(r["lang"], r["kind"]): r["share"] for r in scored.groupBy("lang", kind.alias("kind")).agg(F.avg((F.exp("log_weight") < 0.5).cast("double")).alias("share")).collect()}
    for lang, toxic in (("en", 0.97), ("de", 0.65), ("es", 0.4), ("fr", 0.25)):
        assert share[lang, "toxic"] >= toxic
        assert share[lang, "low"] >= 0.92
        assert share[lang, "good"] <= 0.01


def test_kth_largest(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-(10**9), 10**9) for _ in range(500)] + [7] * 20
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key long")
    for k in (1, 2, 250, 519, 520):
        assert quality.kth_largest(df, k, bins=16) == sorted(keys, reverse=True)[k - 1]


def test_chat_quotes(spark):
    data = [
        (1, 0, "user", "Hello there.\nHow do I sort?\n\nThanks a lot", 1),
        (1, 1, "assistant", "> How do I SORT?\nUse sort().", 1),
        (1, 2, "user", ">> How do I sort?\n> Use  sort().\nIt works!", 1),
        (1, 3, "user", "> > Use sort().\n> It works!\nMe too", 1),
        (1, 4, "user", "> never said\nhm", 1),
        (2, 0, "user", "Use sort().", 1),
        (2, 1, None, None, 1),
        (2, 1, None, None, 1),
        (None, 3, "user", "> Use sort().", 1),
        (2, None, "user", "> Use sort().\nx", 1),
    ]
    got = chat_quotes.chat_rows(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, depth int")).collect()
    assert len(got) == len(data)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert [(by[1, t]["reply_to"], by[1, t]["thread"], by[1, t]["depth"]) for t in range(5)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (2, 0, 3), (None, 4, 0)]
    assert by[1, 1]["content"] == "Use sort()."
    assert by[1, 2]["formatted"] == "<|user|>\nIt works!"
    assert (by[1, 2]["n_quotes"], by[1, 2]["n_linked"], by[1, 4]["n_linked"]) == (2, 2, 0)
    assert by[2, 1]["reply_to"] is None
    assert chat_quotes.chat_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_quotes_of_parts(spark):
    """Some lines of a paragraph, two of three paragraphs, a sentence of a line; lines that are not together link to nothing."""
    data = [
        (1, 0, "user", "Hello all.\nA one\nB two\nC three", 1),
        (1, 1, "assistant", "First here. Second there! Third?\n\nMiddle part\n\nLast part", 1),
        (1, 2, "user", "> A one\n> B TWO\nyes", 1),
        (1, 3, "user", "> First here. Second there! Third?\n>\n> Middle  part\nno", 1),
        (1, 4, "user", "> Second there!\nwhere", 1),
        (1, 5, "user", "> A one\n> C three\nso", 1),
        (1, 6, "user", "> Third?\n>\n> Middle part\n>\n> Last part\n\nwell", 1),
        (1, 7, "user", ">> B two\n>> C three\n> yes\nfine", 1),
        (2, 0, "user", "> A one\n> B two\nelsewhere", 1),
    ]
    got = chat_quotes.linked(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, depth int")).collect()
    by = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"], r["depth"]) for r in got}
    assert by[1, 2] == (0, 0, 1)
    assert by[1, 3] == by[1, 4] == by[1, 6] == (1, 1, 1)
    assert by[1, 5] == (None, 5, 0)
    assert by[1, 7] == (2, 0, 2)
    assert by[2, 0] == (None, 0, 0)
    assert {(r["n_quotes"], r["n_linked"]) for r in got if r["turn"] == 7} == {(2, 2)}


def plain_chat(data):
    """(conv_id, turn) -> (reply_to, thread, depth, position, quotations, linked), message by message."""
    import functools

    fold = lambda t: re.sub(r"\s+", " ", t).strip(" ").lower()
    cut = lambda t: [x for x in map(fold, re.split(r"\r?\n|(?<=[.!?])[ \t]+", t)) if x]
    convs: dict = {}
    for conv, turn, _, text, *_ in data:
        convs.setdefault(conv, {})[turn] = text or ""
    out = {}
    for conv, turns in convs.items():
        lines = {t: [((m := re.match(r"[ \t]*(?:>[ \t]*)+", x)) and m[0].count(">") or 0, x[len(m[0]) if m else 0 :]) for x in text.split("\n")] for t, text in turns.items()}
        own = {t: "\n".join(x for n, x in ls if not n).strip(" ") for t, ls in lines.items()}
        units = {t: {fold(x) for x in [o, *re.split(r"\n\s*\n", o), *o.split("\n")]} - {""} for t, o in own.items()}
        parts = {t: cut(o) for t, o in own.items()}
        reply = {}
        for t, ls in lines.items():
            passages = []
            for i, (n, x) in enumerate(ls):
                if i and ls[i - 1][0] == n:
                    passages[-1][1].append(x)
                else:
                    passages.append((n, [x]))
            passages = [(n, "\n".join(xs)) for n, xs in passages if n and fold("\n".join(xs))]
            links = []
            for pos, (n, p) in enumerate(passages):
                run = cut(p)
                earlier = [u for u in turns if u < t and (fold(p) in units[u] or any(parts[u][i : i + len(run)] == run for i in range(len(parts[u]))))]
                links.append((n, pos, min(earlier)) if earlier else None)
            found = [x for x in links if x]
            reply[t] = (min(found)[2] if found else None, len(passages), len(found))
        children: dict = {}
        for t in sorted(turns):
            children.setdefault(reply[t][0], []).append(t)
        for root in children.get(None, []):
            order, stack = [], [(root, 0)]
            while stack:
                t, depth = stack.pop()
                out[conv, t] = (reply[t][0], root, depth, len(order), *reply[t][1:])
                order.append(t)
                stack += [(c, depth + 1) for c in reversed(children.get(t, []))]
    return out


def test_chat_quotes_against_a_plain_version(spark):
    """Quotations of runs of lines, of paragraphs and of sentences, nested, of earlier and of later messages; a long thread,
    a message that very many reply to, and long messages."""
    rng = random.Random(15)
    word = lambda: rng.choice(["sort", "list", "use", "this", "that", "why", "Fine", "map", "code", "and"])
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(2, 6))) + rng.choice([".", "?", "!", ""])
    data = []
    for conv in range(40):
        bodies: list[list[str]] = []
        for turn in range(rng.randrange(1, 14)):
            text: list[str] = []
            for _ in range(rng.choice([0, 1, 1, 2])):
                if bodies:
                    source = rng.choice(bodies[-4:])
                    i = rng.randrange(len(source))
                    part = source[i : i + rng.randrange(1, 4)]
                    if rng.random() < 0.3:
                        part = [rng.choice(re.split(r"(?<=[.!?]) ", part[0]))]
                    mark = rng.choice(["> ", ">", ">> ", "> > "])
                    text += [mark + x for x in part]
                if rng.random() < 0.2:
                    text.append("> " + sentence())
            body = [" ".join(sentence() for _ in range(rng.randrange(1, 3))) if rng.random() < 0.85 else "" for _ in range(rng.randrange(1, 6))]
            bodies.append(body)
            data.append((conv, turn, "user", "\n".join([*text, *body]), 1))
    data += [(100, t, "user", (f"> step {t - 1}\n" if t else "") + f"step {t}", 1) for t in range(60)]
    data += [(101, t, "user", f"> first one\nreply {t}" if t else "first one", 1) for t in range(200)]
    data += [(102, 0, "user", "\n".join(f"line {i}" for i in range(3000)), 1), (102, 1, "user", "\n".join(f"> line {i}" for i in range(1000, 2500)) + "\nyes", 1), (102, 2, "user", "\n".join(("> " if i % 2 else ">> ") + f"line {i}" for i in range(900)), 1)]
    many = [f"This is sentence {i % 1700} of it." for i in range(4000)]
    cuts = [(rng.randrange(3800), n) for n in range(1, 61)]
    data += [(103, 0, "user", " ".join(many), 1), (103, 1, "user", "\nno\n".join("> " + " ".join(many[i : i + n]) for i, n in cuts), 1), (103, 2, "user", "> " + " ".join([*many[:30], *many[31:50]]), 1)]
    data += [(104, 0, "user", "ok. ok. ok. ok. well. ok. ok.", 1), (104, 1, "user", "> ok. ok. well. ok.", 1), (104, 2, "user", "> ok. ok. ok. ok. ok.", 1), (104, 3, "user", "> ok. ok.\n> ok. ok.", 1)]
    want = plain_chat(data)
    assert want[103, 1][5] == 60 and want[103, 2][5] == 0 and [want[104, t][0] for t in (1, 2, 3)] == [0, None, 0]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, depth int").repartition(5)
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"], r["depth"], r["position"], r["n_quotes"], r["n_linked"]) for r in chat_quotes.linked(frame).collect()}
    assert got == want
    assert sum(w[0] is not None for w in want.values()) > 300
    assert max(w[2] for w in want.values()) == 59
