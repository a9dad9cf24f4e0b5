"""Folders, archives and files to raw/<id>/ and back."""

from __future__ import annotations

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import ingest, ingest_run
from loomgraph.sources import raw, raw_store

PNG = b"\x89PNG-not-really"


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def files_of(spark, rows):
    return spark.createDataFrame(rows, "path string, content binary, batch string")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bundle")
    page = b'<h1>Inside</h1><p>x <img src="data:image/png;base64,aGVsbG8="></p>'
    rows = [
        ("/in/study/long.md", b"# The study\n\nA long text about it, see figures/fig-001.png for more.", "study"),
        ("/in/study/short.txt", b"short", "study"),
        ("/in/study/b.PNG", PNG + b"b", "study"),
        ("/in/study/a.jpg", PNG + b"a", "study"),
        ("/in/study/.hidden", b"no", "study"),
        ("/in/page/page.html", page, "page"),
        ("/in/page/c.gif", PNG + b"c", "page"),
        ("/in/images/one.png", PNG + b"1", "images"),
        ("/in/images/two.png", PNG + b"2", "images"),
        ("/in/again.md", b"short", None),
        ("/in/some.zip", archive(**{"d/notes.csv": "a,b\n1,2\n", "d/pic.svg": "<svg/>", "__MACOSX/x": "junk", "d/same.txt": "short"}), None),
        ("/in/blob.xyz", b"\x00\x01", None),
        ("/in/empty.md", b"", None),
    ]
    record = ingest_run.ingest_files(files_of(spark, rows), f"file://{root}").collect()
    return root, rows, record


def test_actions_and_records(stored):
    root, rows, record = stored
    by = {(r["batch"], r["name"]): r for r in record}
    assert sorted(by) == sorted([("study", "long.md"), ("study", "short.txt"), ("page", "page.html"), ("images", "one.png"), ("images", "two.png"), ("/in/again.md", "again.md"), ("/in/some.zip", "notes.csv"), ("/in/some.zip", "same.txt"), ("/in/blob.xyz", "blob.xyz"), ("/in/empty.md", "empty.md")])
    shorts = [by["study", "short.txt"], by["/in/again.md", "again.md"], by["/in/some.zip", "same.txt"]]
    assert sorted(r["action"] for r in shorts) == ["repeated", "repeated", "stored"] and len({r["id"] for r in shorts}) == 1
    assert all(r["action"] == "stored" for r in record if r not in shorts)
    sha = hashlib.sha256(rows[0][1]).hexdigest()
    assert by["study", "long.md"]["id"] == f"the-study-{sha[:6]}"
    assert by["study", "long.md"]["needs_llm"] and not by["/in/some.zip", "same.txt"]["needs_llm"] and by["/in/blob.xyz", "blob.xyz"]["needs_llm"]


def test_files_of_a_source(stored):
    root, rows, record = stored
    by = {(r["batch"], r["name"]): root / "raw" / r["id"] for r in record}
    study = by["study", "long.md"]
    assert sorted(str(p.relative_to(study)) for p in study.rglob("*.*") if not p.name.startswith(".")) == ["figures/fig-001.jpg", "figures/fig-002.png", "meta.yaml", "original.md", "source.md"]
    assert (study / "original.md").read_bytes() == rows[0][1] and (study / "figures/fig-001.jpg").read_bytes() == PNG + b"a" and (study / "figures/fig-002.png").read_bytes() == PNG + b"b"
    text = (study / "source.md").read_text()
    assert text.startswith(ingest.MARKER) and "![fig-001.jpg](figures/fig-001.jpg)" in text and "![fig-002.png](figures/fig-002.png)" in text
    page = by["page", "page.html"]
    assert (page / "figures/fig-001.png").read_bytes() == b"hello" and (page / "figures/fig-002.gif").read_bytes() == PNG + b"c"
    assert (by["/in/some.zip", "notes.csv"] / "figures/fig-001.svg").read_bytes() == b"<svg/>"
    assert (by["images", "one.png"] / "original.png").read_bytes() == PNG + b"1" and (by["/in/empty.md", "empty.md"] / "source.md").read_bytes() == b""
    assert sorted(p.name for p in (root / "raw").iterdir()) == sorted({r["id"] for r in record})  # no staging left


def test_the_bundle_reader_takes_them(spark, stored):
    root, rows, record = stored
    read = {r["id"]: r for r in raw.sources(spark, f"file://{root}").collect()}
    assert sorted(read) == sorted({r["id"] for r in record})
    study = next(read[r["id"]] for r in record if r["name"] == "long.md")
    assert (study["sha256"], study["format"], study["original_filename"], study["needs_llm_fallback"]) == (hashlib.sha256(rows[0][1]).hexdigest(), "text", "long.md", True)
    assert [(f["file"], f["provisional"], f["described"], f["origin"]) for f in study["figures"]] == [("figures/fig-001.jpg", True, False, "folder:a.jpg"), ("figures/fig-002.png", True, False, "folder:b.PNG")]
    page = next(read[r["id"]] for r in record if r["name"] == "page.html")
    assert [f["origin"] for f in page["figures"]] == ["data-uri", "folder:c.gif"]


def test_a_replay_adds_nothing(spark, stored):
    root, rows, record = stored
    before = sorted(p.name for p in (root / "raw").iterdir())
    again = ingest_run.ingest_files(files_of(spark, [*rows, ("/in/new.md", b"# New", None)]), f"file://{root}").collect()
    ids = {(r["batch"], r["name"]): r["id"] for r in record}
    assert {r["action"] for r in again if r["name"] != "new.md"} == {"reused"} and all(ids[r["batch"], r["name"]] == r["id"] for r in again if r["name"] != "new.md")
    assert sorted(p.name for p in (root / "raw").iterdir()) == sorted([*before, next(r["id"] for r in again if r["name"] == "new.md")])


def test_members_combined(spark, tmp_path):
    rows = [("/in/a.md", b"one\n", "x"), ("/in/b.csv", b"h\n1\n", "x"), ("/in/c.md", b"alone", "y")]
    record = {r["name"]: r for r in ingest_run.ingest_files(files_of(spark, rows), f"file://{tmp_path}", combine=True).collect()}
    assert sorted(record) == ["c.md", "combined.md"]
    assert (tmp_path / "raw" / record["combined.md"]["id"] / "original.md").read_text() == "# a.md\n\none\n\n# b.csv\n\n| h |\n| --- |\n| 1 |\n\n"


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    files = spark.createDataFrame([("s1", "source.md", b"x"), ("s2", "source.md", b"y")], raw_store.FILES)
    bad = files.unionByName(spark.createDataFrame([("s3", "../out", b"z")], raw_store.FILES)).repartition(3)
    with pytest.raises(Exception, match="not the name of a file"):
        raw_store.publish(bad, f"file://{tmp_path}")
    assert not list(tmp_path.rglob("*.md")) and not list((tmp_path / "raw").iterdir())
    raw_store.publish(files, f"file://{tmp_path}")
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == ["s1", "s2"]
    with pytest.raises(Exception, match="already"):
        raw_store.publish(files.withColumn("bytes", F.lit(b"other")), f"file://{tmp_path}")
    assert (tmp_path / "raw" / "s1" / "source.md").read_bytes() == b"x" and sorted(p.name for p in (tmp_path / "raw").iterdir()) == ["s1", "s2"]
    raw_store.publish(files.limit(0), f"file://{tmp_path}")
