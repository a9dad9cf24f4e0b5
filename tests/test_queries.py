"""Every registered query against its SQL in DuckDB, on tables large enough to hold every case."""

from __future__ import annotations

import decimal
from pathlib import Path

import pytest

from loomgraph.plans import catalog

DATA = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    return list(map(plain, value)) if isinstance(value, (list, tuple)) else value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(map(repr, r)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    at = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in at] == columns
    assert got == ordered([tuple(plain(r[i]) for i in at) for r in found.fetchall()])


def test_whole_texts(spark, tmp_path):
    """Other languages, short texts, and what stands after the first 120 or 400 characters."""
    late = "é" * 500 + " Title here " + " ".join("abcde" + "fghij"[i % 5] + "klmno"[i // 5 % 5] + "pq"[i // 25] for i in range(50))
    spark.createDataFrame([(1, late, "fr"), (2, "short", "en"), (3, late + " <b> notag </b", "de")], "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = lambda name: {r[0]: r[1] for r in catalog.QUERIES[name](spark, f"file://{tmp_path}").collect()}
    assert rows("coverage_whole") == {1: 1.0, 2: None, 3: 51 / 51}
    assert rows("slug_whole")[1].startswith("title-here-abcde")
    assert rows("sha_id_whole")[1].startswith("title-here-abcde")


def test_coverage_makes_the_other_text_once(spark):
    """30,000 different words of a text of markup: what is made of the text for every word anew takes hours."""
    import time

    from pyspark.sql import functions as F

    from loomgraph.functions import text as T

    word = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:06d}")
    long = " ".join(f"<b>{word(i)}</b>" for i in range(30_000))
    inside = " ".join(f"{word(i)}xx" for i in range(60)) + " <i>" + " ".join(word(i) for i in range(100, 140))
    rows = [(1, long, long), (2, " ".join(word(i) for i in range(60)), inside), (3, " ".join(word(i) for i in range(60)), None), (4, " ".join(word(i).upper() for i in range(50, 110)), inside), (5, "a b", "c"), (6, None, "c")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    began = time.perf_counter()
    got = dict(df.select("id", T.coverage(F.col("a"), T.strip_markup(F.col("b")))).collect())
    assert time.perf_counter() - began < 60
    assert got == {1: 1.0, 2: 1.0, 3: 0.0, 4: 20 / 60, 5: None, 6: None}


def test_merge_raw_finds_free_suffixes(spark):
    """More than 64 suffixes taken, a gap, and a suffix that a moved source takes."""
    from loomgraph.operators import merge

    main = ["a", *(f"a-{i}" for i in range(2, 90)), "b", "b-2", "b-4", "c", "d", "d-02"]
    other = ["a", "b", "c", "c-2", "d"]
    frame = lambda ids, side: spark.createDataFrame([(i, side + i) for i in ids], "id string, sha256 string")
    got = {r["id"]: r["final_id"] for r in merge.merge_raw(frame(main, "m"), frame(other, "o")).collect()}
    assert got == {"a": "a-90", "b": "b-3", "c": "c-3", "c-2": "c-2", "d": "d-2"}


def test_index_cuts_up_only_what_a_line_may_hold(spark, monkeypatch):
    """Identifiers that begin as no line does are not cut up, and the rarest run of one is found without a sort."""
    from loomgraph.operators import stats

    ids = [*(f"Order {i}" for i in range(500)), *(f"Part {i}" for i in range(60)), "", None, "|", "P", "zz", "t 7 |", "Part 33 | nàme", "nàme 9", "ame 10 |", "Part 3 | name"]
    lines = [*(f"| {'Part ' if i % 3 == 0 else 'P-'}{i} | nàme {i % 12} |" for i in range(90)), None, "", "| Part 3 |"]
    made, plans, write = {}, [], stats.materialise

    def kept(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString())
        out = write(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(stats, "materialise", kept)
    frame = lambda rows, name: spark.createDataFrame([(r,) for r in rows for _ in range(2)], f"{name} string")
    got = sorted(r[0] for r in stats.index_missing(frame(ids, "identifier"), frame(lines, "line")).collect())
    assert got == sorted(i for i in ids if i and not any(i in x for x in lines if x))
    assert made["identifier-runs"] < 300
    assert not any("SortAggregate" in p for p in plans)
    assert [r[0] for r in stats.index_missing(frame(["a"], "identifier"), frame([], "line")).collect()] == ["a"]
    assert stats.index_missing(frame([], "identifier"), frame(["a"], "line")).count() == 0


def test_contract():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
