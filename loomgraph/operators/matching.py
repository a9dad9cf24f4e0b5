"""Candidates for a merge: nodes whose names are similar, found without comparing all pairs.

Names are compared as keys (letters and digits, lowered, other runs one space) within a bounded
number of edits. A key of the main side is cut into ``edits + 1`` parts of nearly equal length.
Fewer edits than parts leave one part as it is, so a similar key of the other side holds it, not
further from its place than the edits before and after it can move it. Parts are joined by
length of the key, number and text with what the other keys hold at those places. Keys too short
to be cut meet in what is left of them once up to ``edits`` letters are deleted. Edit distance
then decides, before pairs are made distinct. Every pair within the bound is found.

Equal keys are one key, whoever bears them. Blocks are written before they are joined, so that
adaptive execution splits frequent ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise


def name_key(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def keyed(names: DataFrame) -> DataFrame:
    """identifier, key of names (identifier, name); what has no letter or digit has no key and goes."""
    return names.select("identifier", name_key(F.col("name")).alias("key")).filter("key <> ''").distinct()


def names_of(nodes: DataFrame) -> DataFrame:
    """identifier, name: the identifier itself and each synonym."""
    more = F.coalesce(F.col("synonyms"), F.array().cast("array<string>")) if "synonyms" in nodes.columns else F.array().cast("array<string>")
    return nodes.select("identifier", F.explode(F.array_distinct(F.concat(F.array("identifier"), more))).alias("name")).filter("name is not null")


def _cuts(n: Column, edits: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of each of the ``edits + 1`` parts of a key of ``n`` letters; the last ones are longer by one."""
    base, more = F.floor(n / (edits + 1)).cast("int"), F.pmod(n, F.lit(edits + 1)).cast("int")
    late = lambda i: F.greatest(F.lit(i) - (F.lit(edits + 1) - more), F.lit(0))  # noqa: E731  how many of the first i are longer
    return [(F.lit(1) + base * i + late(i), base + late(i + 1) - late(i)) for i in range(edits + 1)]


def _block(n: Column, part: int, text: Column) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.lit(f"p{part}"), text)


def _parts(key: Column, edits: int) -> Column:
    """The parts of a key, with its length and their numbers."""
    n = F.char_length(key)
    return F.array(*(_block(n, i, F.substring(key, start, size)) for i, (start, size) in enumerate(_cuts(n, edits))))


def _held(key: Column, edits: int) -> Column:
    """What a key holds where it would hold a part of a similar one: for each length that such a key can have, each part
    and each number of letters that the edits before it can have moved it."""
    n, out = F.char_length(key), []
    for more in range(-edits, edits + 1):
        other = n + more
        for i, (start, size) in enumerate(_cuts(other, edits)):
            for moved in range(-edits, edits + 1):
                if abs(moved) + abs(-more - moved) <= edits:
                    at = start + moved
                    fits = (other > edits) & (at >= 1) & (at + size - 1 <= n)
                    out.append(F.when(fits, _block(other, i, F.substring(key, at, size))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def _less(text: Column, letters: int) -> Column:
    """The text, and what is left of it without any one to ``letters`` of its letters."""
    out = F.array(text)
    for _ in range(letters):
        drop = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.expr("''"), F.substring(t, i + 1, F.char_length(t))))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, drop))))
    return out


def similar_keys(keys: DataFrame, edits: int = 2, q: int = 2) -> DataFrame:
    """main_key, other_key, distance (1 to ``edits``) of keys (key, in_main, in_other; distinct): a key of one side with one
    of the other. Keys of up to ``edits + q - 1`` letters count as too short to be cut."""
    if edits < 1 or q < 1:
        raise ValueError("names are compared within one edit or more, and cut from one letter or more")
    n = F.char_length("key")
    short = edits + q - 1
    base = materialise(keys.select("key", "in_main", "in_other"), "name-keys")
    left = F.transform(_less(F.col("key"), edits), lambda x: F.concat(F.lit("d"), x))

    def side(name: str, blocks: Column) -> DataFrame:
        mine = base.filter(f"in_{name}").select(F.col("key").alias(f"{name}_key"), F.explode(F.concat(blocks, F.when(n <= short + edits, left).otherwise(F.array().cast("array<string>")))).alias("block"))
        return materialise(mine, "name-blocks")

    met = side("main", _parts(F.col("key"), edits)).join(side("other", _held(F.col("key"), edits)), "block")
    near = F.abs(F.char_length("main_key") - F.char_length("other_key")) <= edits
    distance = F.levenshtein(F.col("main_key"), F.col("other_key"), edits)
    return met.filter((F.col("main_key") != F.col("other_key")) & near).withColumn("distance", distance).filter(F.col("distance") >= 1).select("main_key", "other_key", "distance").distinct()


def similar_names(main: DataFrame, other: DataFrame, edits: int = 2, q: int = 2) -> DataFrame:
    """main_key, other_key, distance, n_main, n_other (how many identifiers bear the key) of names (identifier, name)."""
    named = lambda df, name: keyed(df).groupBy("key").agg(F.count_distinct("identifier").alias(f"n_{name}"))
    both = materialise(named(main, "main").join(named(other, "other"), "key", "full"), "names")
    keys = both.select("key", F.col("n_main").isNotNull().alias("in_main"), F.col("n_other").isNotNull().alias("in_other"))
    found = similar_keys(keys, edits, q)
    number = lambda name: both.filter(f"n_{name} is not null").select(F.col("key").alias(f"{name}_key"), f"n_{name}")
    return found.join(number("main"), "main_key").join(number("other"), "other_key").select("main_key", "other_key", "distance", "n_main", "n_other")


def similar_candidates(main: DataFrame, other: DataFrame, edits: int = 2, q: int = 2) -> DataFrame:
    """main_id, other_id, distance: nodes of two bases with similar, but not equal, names or synonyms; the least distance of
    any two of them. Candidates are for judging: nothing is merged by them alone."""
    a, b = (materialise(keyed(names_of(df)), "keyed") for df in (main, other))
    keys = a.select("key", F.lit(True).alias("in_main"), F.lit(False).alias("in_other")).unionByName(b.select("key", F.lit(False).alias("in_main"), F.lit(True).alias("in_other")))
    found = similar_keys(keys.groupBy("key").agg(F.bool_or("in_main").alias("in_main"), F.bool_or("in_other").alias("in_other")), edits, q)
    pairs = found.join(a.select(F.col("identifier").alias("main_id"), F.col("key").alias("main_key")), "main_key").join(b.select(F.col("identifier").alias("other_id"), F.col("key").alias("other_key")), "other_key")
    return pairs.groupBy("main_id", "other_id").agg(F.min("distance").alias("distance"))
