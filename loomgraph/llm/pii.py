"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base spans come from fixed patterns (email, ip, card, phone). They are the seeds: the visible
word before a seed, however long and however far back, is a lexical pattern. Candidates are
other identifier-like stretches (tokens with an @, groups of digits joined by blanks, dots,
slashes, hyphens or brackets, and tokens of letters with some digits) and the word before
them. Patterns and instances (values) form a bipartite graph whose edges are counted
occurrences, and scores go round in it: a pattern's confidence for a kind is the share of all
occurrences of its word, anywhere in the corpus, that lead to an instance of that kind; an
unseen instance's score is the noisy-or of the patterns that lead to it. In each round a
pattern takes part if it leads to enough distinct sure instances of the kind: base seeds, and
those that an earlier round has made sure of, so that found instances induce further patterns.
Patterns of high confidence at the end add the candidates they lead to as spans of their
kind. Base spans always stay.

The fixed patterns are written so that no text makes them slow: a run of characters is
entered only at its beginning, and never given back.

Defined results: null text counts as empty; repeated rows are answered each for itself; n_*
count base spans; spans that are added never overlap base spans; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise, two_columns

#: Kinds in the order of output, each with a pattern that finds what its plain form finds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: What may be an instance: something@somewhere; groups of digits; letters and at least three digits.
CANDIDATE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9._-]++"
    r"|(?<![0-9A-Za-z@._+/()-])[+(]?[0-9]++(?:(?:\) ?|[ ./-]\(?)[0-9]++)*+(?![0-9A-Za-z@])"
    r"|(?<![0-9A-Za-z@._+/-])(?=(?:[A-Za-z@._+/-]*+[0-9]){3})[0-9A-Za-z+][0-9A-Za-z@._+/-]*+"
)
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
#: Matches whose positions are added up in one go.
MATCHES = 256
#: Patterns are broadcast up to so many bytes; beyond, words are counted first and joined then.
BROADCAST_BYTES = 8 << 20

SPANS = "array<struct<start:int,kind:int,end:int,value:string,before:string>>"


def _luhn(digits: Column) -> Column:
    value = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda s, i: s + F.when((F.char_length(digits) - i) % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return F.when(F.char_length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    return F.lit(True)


def _checked(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _located(text: Column, pattern: str, kind: int) -> Column:
    """Every match in order: start, kind, end (code points, end exclusive), value, and the word before it.

    A split by the same pattern gives the stretches between the matches; lengths add up to positions, within blocks
    of matches first, so that the work does not grow with the square of their number.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(found.alias("value"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"))
    nothing = F.array().cast(SPANS)
    start = F.struct(F.lit(0).alias("at"), nothing.alias("spans"))

    def one(state: Column, p: Column) -> Column:
        begin = state["at"] + F.char_length(p["gap"])
        end = begin + F.char_length(p["value"])
        gap = F.translate(F.rtrim(p["gap"], F.lit(SPACES)), SPACES, " " * len(SPACES))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["value"].alias("value"), F.lower(F.substring_index(gap, " ", -1)).alias("before"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def joined(state: Column, block: Column) -> Column:
        moved = F.transform(block["spans"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + state["at"]).alias("end"), s["value"].alias("value"), s["before"].alias("before")))
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["spans"], moved).alias("spans"))

    def whole(m: Column) -> Column:  # m: the pairs, computed once
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / MATCHES).cast("int")), lambda b: F.aggregate(F.slice(m, b * MATCHES + 1, F.lit(MATCHES)), start, one))
        return F.when(F.size(m) > 0, F.aggregate(blocks, start, joined, lambda s: s["spans"])).otherwise(nothing)

    return F.get(F.transform(F.array(pairs), whole), 0)


def extracted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_hash, base (spans by start, then kind), candidates (identifier-like tokens outside base spans)."""
    text = F.col("text")
    has_digit = text.rlike("[0-9]")
    likely = {"email": text.contains("@"), "ip": has_digit, "card": has_digit, "phone": text.contains("+")}
    nothing = F.array().cast(SPANS)
    rows = two_columns(docs, id_col, text_col).withColumn("row_hash", F.xxhash64("text"))
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        rows = rows.withColumn(kind, F.when(likely[kind], _checked(_located(text, pattern, i), kind)).otherwise(nothing))
    rows = rows.withColumn("base", F.array_sort(F.concat(*KINDS))).withColumn("tokens", F.when(has_digit | likely["email"], _located(text, CANDIDATE, len(KINDS))).otherwise(nothing))
    trimmed = F.transform(
        "tokens",
        lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.char_length(F.rtrim(t["value"], F.lit("@._+/-")))).alias("end"), F.rtrim(t["value"], F.lit("@._+/-")).alias("value"), t["before"].alias("before")),
    )
    outside = F.filter(trimmed, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return rows.select("doc_id", "row_hash", "base", outside.alias("candidates"))


def occurrences(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """pattern, total: how often each pattern's word stands anywhere in the corpus."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "[ \t-\r]+")).alias("pattern")).filter("pattern <> ''")
    size = patterns.agg(F.sum(F.octet_length("pattern") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # few patterns: other words never leave the scan
        return words.join(F.broadcast(patterns), "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    return words.groupBy("pattern").agg(F.count(F.lit(1)).alias("total")).join(patterns, "pattern", "left_semi")


def pattern_scores(spans: DataFrame, docs: DataFrame, rounds: int = 3, min_seeds: int = 3, text_col: str = "text", min_confidence: float = 0.8) -> DataFrame:
    """pattern, kind, confidence, seeds: scores after ``rounds`` rounds over the pattern-instance graph."""
    seeds = spans.select(F.explode("base").alias("s")).select(F.col("s.before").alias("pattern"), F.lower("s.value").alias("value"), F.col("s.kind").alias("kind"))
    others = spans.select(F.explode("candidates").alias("s")).select(F.col("s.before").alias("pattern"), F.lower("s.value").alias("value"), F.lit(None).cast("int").alias("kind"))
    edges = materialise(seeds.unionByName(others).filter("pattern <> ''").groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("n")), "pattern-edges")
    fixed = materialise(edges.filter("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0)), "seeds")
    # Only a pattern that leads to enough distinct values can ever take part.
    enough = materialise(edges.groupBy("pattern").agg(F.count_distinct("value").alias("values")).filter(F.col("values") >= min_seeds).select("pattern"), "promising-patterns")
    totals = materialise(occurrences(docs, enough, text_col), "pattern-totals")
    graph = materialise(edges.join(enough, "pattern", "left_semi").groupBy("pattern", "value").agg(F.sum("n").alias("n")), "pattern-graph")
    unseen = graph.join(fixed.select("value"), "value", "left_anti")
    scores, patterns = fixed, None
    for i in range(rounds):
        led = graph.join(scores, "value").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("led"), F.count_if(F.col("score") >= min_confidence).alias("seeds"))
        patterns = materialise(led.filter(F.col("seeds") >= min_seeds).join(totals, "pattern").select("pattern", "kind", (F.col("led") / F.greatest("total", "led")).alias("confidence"), "seeds"), f"patterns-{i}")
        if i + 1 < rounds:
            risen = unseen.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
            scores = materialise(fixed.unionByName(risen), f"scores-{i}")
    return patterns


def personal_data(docs: DataFrame, min_confidence: float = 0.8, min_seeds: int = 3, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added (arrays of start, kind, end), one row per row of ``docs``."""
    spans = materialise(extracted(docs, id_col, text_col), "spans")
    sure = pattern_scores(spans, docs, rounds, min_seeds, text_col, min_confidence).filter(F.col("confidence") >= min_confidence)
    best = sure.groupBy("pattern").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "kind")).alias("b")).select("pattern", F.col("b.kind").alias("kind"))
    led = spans.select("doc_id", "row_hash", F.explode("candidates").alias("c")).select("doc_id", "row_hash", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.before").alias("pattern")).join(best, "pattern")
    added = led.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added")).withColumnsRenamed({"doc_id": "a_id", "row_hash": "a_hash"})
    joined = spans.join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("row_hash") == F.col("a_hash")), "left")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return joined.select("doc_id", plain.alias("base"), F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("added"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def span_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
