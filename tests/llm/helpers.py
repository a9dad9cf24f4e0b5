"""Documents that hold every awkward case, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, kept boolean, base int"


def rows(seed: int = 1, n: int = 120) -> list[tuple]:
    """Random prose of few words, with copies, near copies, shared lines, null, empty and one long text; the last
    columns clash with names that operators use."""
    rng = random.Random(seed)
    words = ["the", "Of", "été", "naïve", "x1", "long-word", "it's", "end.", "a", "日本語", "don't", "B", "42", "data", "Spark", "weiß", "№5", "cóop"]
    shared = "  This very line stands in MANY of the documents here, and is long "
    out: list[tuple] = []
    texts: list[str | None] = [None, "", " ", "\n\n", "one", "one two three four", "ONE  two\tthree four", "\x00odd\x00", " lead and trail \n"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and len(texts) > 10:
            texts.append(rng.choice(texts))
        elif kind < 0.35 and len(texts) > 12:
            base = (rng.choice(texts[9:]) or "x").split(" ")
            for _ in range(max(1, len(base) // 60)):
                base[rng.randrange(len(base))] = rng.choice(words) + str(rng.randrange(99))
            texts.append(" ".join(base))
        else:
            body = [" ".join(rng.choice(words) + (str(rng.randrange(300)) if rng.random() < 0.5 else "") for _ in range(rng.randrange(1, 90))) for _ in range(rng.randrange(1, 4))]
            if rng.random() < 0.3:
                body.insert(rng.randrange(len(body) + 1), shared)
            texts.append("\n".join(body))
    texts.append(" ".join(rng.choice(words) + str(rng.randrange(5000)) for _ in range(30_000)))
    for i, t in enumerate(texts):
        out.append((i * 7 % 1009, t, "en", f"s{i % 3}", len(t or ""), "h", True, 3))
    return out


#: Names that operators use for columns of their own.
CLASHES = ["slot", "rep", "node", "row_hash", "norm", "digest", "shingle", "pattern", "value", "gone", "lines", "row", "at", "_lang", "l_id", "part", "component", "item", "words", "total", "rank", "task", "piece"]


def frame(spark, data: list[tuple] | None = None):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows() if data is None else data, SCHEMA).withColumns({c: F.lit("x") for c in CLASHES})


def repeated(seed: int) -> list[tuple]:
    """``rows`` with the first of them once or twice more, and rows without an id, two of them alike."""
    data = rows(seed, 60)
    nameless = [(None, *r[1:]) for r in (data[12], data[12], data[0], data[20])]
    return data + data[:30] + data[:15] + nameless


def find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def near_components(data: list[tuple]) -> dict[int, tuple[int, int]]:
    """doc_id -> (shingles, smallest doc_id reachable), by comparing all pairs."""
    sets = {}
    for doc_id, text, *_ in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(parent, a), find(parent, b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(parent, i)) for i in ids}


def contamination(data: list[tuple], items: list[tuple[int, str]], window: int = 10) -> dict[int, tuple[int, int, list[str]]]:
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = {}
    for doc_id, text, *_ in data:
        w = split(text)
        hit, found = set(), set()
        for item_id, item in items:
            v = split(item)
            for i in range(max(1, len(v) - window + 1) if v else 0):
                part = v[i : i + window]
                for j in range(len(w) - len(part) + 1):
                    if w[j : j + len(part)] == part:
                        hit.update(range(j, j + len(part)))
                        found.add(str(item_id))
        out[doc_id] = (len(w), len(hit), sorted(found))
    return out


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)
