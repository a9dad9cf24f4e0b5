"""Bundles, raw sources, decoders, exports and history on small fixtures made by hand."""

from __future__ import annotations

import base64
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import credibility, export, graph, history, ingest, lint, merge, normalise, office, search, stats
from loomgraph.sources import archives, bundle, raw
from loomgraph.streaming import ingest as streaming

MARK = "<!-- kept for later -->"


def node(front: str, body: str = "") -> str:
    return f"---\n{front}---\n{body}"


FILES = {
    "knowledge/gene/braf.md": node(
        "type: Gene\nidentifier: BRAF\nsubtype: protein-coding\nsynonyms: [B-Raf]\nedges:\n- predicate: causes\n  object: Melanoma\n  knowledge_level: observation\n  agent_type: manual_agent\n  primary_source: Paper A\n  subtype: direct\n  p_value: 2\n"
        "- predicate: encodes\n  object: Melanoma\n  knowledge_level: guess\n  agent_type: manual_agent\n  primary_source: Web page\n- predicate: treats\n",
        "\n# BRAF\n\nA kinase: see [[causes:: Naevus | k=v; j=w]]\n",
    ),
    "knowledge/gene/braf2.md": node("type: Gene\nidentifier: BRAF\nsubtype: protein_coding\n"),
    "knowledge/disease/melanoma.md": node("type: Disease\ntitle: Melanoma\nid: MONDO:1\nnote: a note: with a colon\nprovided_by: [Paper A]\n"),
    "knowledge/disease/odd.md": node("type: Gene\nidentifier: HGNC:6018(x)\nfoo: 1\n"),
    "knowledge/paper/a.md": node("type: Publication\nidentifier: Paper A\nraw_source: [raw/none/source.md, raw/src-a/source.md, raw/src-b]\n"),
    "knowledge/paper/web.md": node("type: Publication\nidentifier: Web page\nraw_source: raw/src-b\nxref: https://x.example\n"),
    "knowledge/bad.md": "no frontmatter",
    "knowledge/open.md": "---\ntype: Gene\n",
    "knowledge/index.md": "# not a concept",
    "knowledge/.hidden/x.md": node("type: Gene\nidentifier: Hidden\n"),
    "raw/src-a/source.md": f"{MARK}\n\n![](figures/fig-001.png) and [ok](figures/two.png)",
    "raw/src-a/meta.yaml": "id: src-a\ntitle: A\nsha256: aa\nformat: pdf\ningested_at: 2024-01-01\nneeds_llm_fallback: true\nfigures:\n- file: figures/fig-001.png\n  provisional: true\n  described: false\n  origin: data-uri\n- file: figures/two.png\n  provisional: false\n  described: true\n  origin: x\n"
    "credibility:\n  tier: web\n  confidence: 0.6\n  retracted: true\n  reasoning: r\n  classifier_version: 1\nids:\n  doi: 10.1/x\n",
    "raw/src-b/meta.yaml": "id: src-b\ntitle: B\nsha256: bb\nformat: html\ningested_at: 2024-01-02\nneeds_llm_fallback: false\n",
    "raw/src-c/meta.yaml": "title: no id\n",
    "log.md": "# Change log\n\n## 2024-02-02\n\nx\n\n## 2024-01-01\n",
}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bundle")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    where = f"file://{root}"
    rows = bundle.parsed(bundle.files(spark, where)).cache()
    nodes = normalise.normalise_nodes(bundle.nodes(rows)).cache()
    return where, rows, nodes, normalise.normalise_edges(bundle.edges(rows)).cache()


def column(df, *names):
    return sorted(tuple(r) if len(names) > 1 else r[0] for r in df.select(*names).collect())


def test_bundle(spark, base):
    where, rows, nodes, edges = base
    assert column(nodes, "identifier") == ["BRAF", "BRAF", "HGNC:6018(x)", "Melanoma", "Paper A", "Web page"]
    assert column(bundle.parse_errors(rows), "path", "error") == [("knowledge/bad.md", "no frontmatter"), ("knowledge/open.md", "unterminated frontmatter")]
    melanoma = nodes.filter("identifier = 'Melanoma'").first()
    assert (melanoma["xref"], melanoma["note"], melanoma["node_type"]) == ("MONDO:1", "a note: with a colon", "Disease")
    assert column(edges, "subject", "predicate", "object") == [("BRAF", "causes", "Melanoma"), ("BRAF", "encodes", "Melanoma"), ("Melanoma", "reported_in", "Paper A")]
    assert [r["raw_predicate"] for r in bundle.inline_edges(nodes).collect()] == ["causes"]
    assert bundle.inline_edges(nodes).first()["stats"] == {"k": "v", "j": "w"}
    assert column(bundle.pages(spark, where), "path")[:2] == ["knowledge/.hidden/x.md", "knowledge/bad.md"] or column(bundle.pages(spark, where), "path")[0] == "knowledge/bad.md"
    assert bundle.count_documents(spark, where) == 8
    assert bundle.read_page(spark, where, "log.md").first()["text"] == FILES["log.md"]
    with pytest.raises(ValueError, match="inside"):
        bundle.read_page(spark, where, "../x")
    assert column(stats.edge_subtypes(edges), "subtype") == ["direct"]
    assert normalise.first_wins(nodes).filter("identifier = 'BRAF'").first()["path"] == "knowledge/gene/braf.md"


def test_raw_sources(spark, base):
    where, *_ = base
    assert column(raw.source_ids(spark, where), "id") == ["src-a", "src-b", "src-c"]
    got = {r["id"]: r for r in raw.sources(spark, where).collect()}
    assert sorted(got) == ["src-a", "src-b"]
    a, b = got["src-a"], got["src-b"]
    assert (a["tier"], a["retracted"], a["classified"], a["ids"]["doi"], len(a["figures"])) == ("web", True, True, "10.1/x", 2)
    assert (b["tier"], b["confidence"], b["classified"], b["body"], b["figures"]) == ("unknown", 0.3, False, None, [])
    assert column(raw.metadata(spark, where).filter("error is not null"), "id", "error") == [("src-c", "missing id")]


def test_every_rule_on_a_bundle(spark, base):
    where, rows, nodes, edges = base
    sources = raw.sources(spark, where).withColumn("text_layer", F.when(F.col("id") == "src-b", " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)))).withColumn("body", F.coalesce("body", F.lit("nothing")))
    index = spark.createDataFrame([("| BRAF | Gene |",), ("| Melanoma metastasis |",)], "line string")
    found = lint.lint(nodes, edges, sources, raw.listing(spark, where), bundle.parse_errors(rows), index, MARK)
    got = {(r["rule"], r["subject"]) for r in found.collect()}
    assert {r for r, _ in got} == {
        "parse", "identifier.duplicate", "subtype.missing", "type.path_mismatch", "source.raw_missing_file", "node.no_reported_in", "node.orphan", "subtype.similar", "source.needs_conversion",
        "source.figure_unnamed", "source.figure_undescribed", "source.not_scholarly", "source.retracted", "source.low_coverage", "index.stale", "edge.invalid_knowledge_level", "edge.range", "edge.stat_pvalue",
    }
    # A retracted web source is both; "Web page" has no verdict; the missing path of Paper A is skipped for its next one.
    assert {s for r, s in got if r in ("source.not_scholarly", "source.retracted")} == {"Paper A"}
    assert {s for r, s in got if r == "source.raw_missing_file"} == {"Paper A"}
    assert {s for r, s in got if r == "index.stale"} == {"HGNC:6018(x)", "Paper A", "Web page"}
    assert {s for r, s in got if r == "node.orphan"} == {"BRAF", "HGNC:6018(x)"} or {s for r, s in got if r == "node.orphan"} == {"HGNC:6018(x)"}
    assert not lint.verify(found).first()["ok"]
    single = {name: column(lint.rule(name, nodes, edges), "subject") for name in lint.RULES}
    together = {}
    for r in lint.lint(nodes, edges).collect():
        together.setdefault(r["rule"], []).append(r["subject"])
    assert {k: sorted(v) for k, v in together.items()} == {k: v for k, v in single.items() if v}
    judged = {r["path"]: (r["hard"], r["soft"], r["valid"]) for r in lint.validate(nodes, edges, bundle.parse_errors(rows)).collect()}
    assert judged["knowledge/bad.md"] == (1, 0, False)
    assert judged["knowledge/gene/braf.md"] == (1, 0, False)
    assert judged["knowledge/disease/odd.md"] == (0, 2, True)


def test_search_and_exports(spark, base, tmp_path):
    _, _, nodes, edges = base
    hits = search.search_nodes(nodes, "kinase braf", 5).collect()
    assert hits[0]["identifier"] == "BRAF"
    assert any("A kinase" in h["snippet"] for h in hits)
    docs = search.search_text(nodes).select("key", "text")
    search.write_index(docs.filter("key <> 'BRAF'"), f"file://{tmp_path}/index", 4)
    same = lambda df: column(df, "key", "score")
    assert same(search.search_index(spark, f"file://{tmp_path}/index", "paper a a", None)) == same(search.bm25(docs.filter("key <> 'BRAF'"), "paper a a", None))
    assert search.bm25(docs, "", None).count() == 0
    text = export.index_text(export.index_rows(nodes, edges)).first()["text"]
    assert "| BRAF | Gene | protein-coding | A kinase: see [[causes:: Naevus   k=v; j=w]] |" in text
    assert "- **Gene** (3): BRAF, BRAF, HGNC:6018(x)\n" in text
    assert text.endswith("- **edges**: direct\n")
    pages = spark.createDataFrame([("",), ("# Mine\n\nintro\n",), ("head\n<s>\nold\n<e>\ntail",)], "page string")
    got = [r[0] for r in pages.select(export.upserted(F.col("page"), F.lit("new\n"), "<s>", "<e>", "kb")).collect()]
    assert got == ["# kb\n\n<s>\nnew\n<e>\n", "# Mine\n\nintro\n\n<s>\nnew\n<e>\n", "head\n<s>\nnew\n<e>\n\ntail"]
    kinds = [r["kind"] for r in export.bundle_json(nodes, edges, "kb", log=FILES["log.md"]).select(F.get_json_object("json", "$.kind").alias("kind")).collect()]
    assert (kinds.count("bundle"), kinds.count("page"), kinds.count("edge")) == (1, 6, 5)
    head = export.bundle_json(nodes, edges, "kb", log=FILES["log.md"], pages=False).filter("json like '%\"bundle\"%'").select(F.get_json_object("json", "$.updated"), F.get_json_object("json", "$.pages_deferred")).first()
    assert tuple(head) == ("2024-02-02", "true")
    export.write_text(export.graph_json(nodes, edges), f"file://{tmp_path}/graph")
    assert spark.read.text(f"file://{tmp_path}/graph").count() == graph.graph_nodes(nodes, edges).count() + graph.graph_edges(edges).count()


def test_log_and_history(spark):
    change = spark.createDataFrame([("kb", "c1", "2024-03-03 10:00:00", "add", "one node", None), ("new", "c2", "2024-03-03 11:00:00", "fix", "two", "+1 -1")], "bundle string, commit string, at string, kind string, summary string, delta string").withColumn("at", F.col("at").cast("timestamp"))
    logs = spark.createDataFrame([("kb", "# Change log\n\n## 2024-01-01\n\nold\n")], "bundle string, text string")
    rows, new = export.log_sync(change, logs, change)
    got = dict(column(new, "bundle", "text"))
    assert got["kb"] == "# Change log\n\n## 2024-03-03\n\nadd | one node\n\n## 2024-01-01\n\nold\n"
    assert got["new"] == "# Change log\n\n## 2024-03-03\n\nfix | two\n\n+1 -1\n"
    assert rows.count() == 2
    h = spark.createDataFrame([("c1", "a", "2024-01-01", "x", 1), ("c2", "a", "2024-01-05", "y", 1), ("c3", "b", "2024-01-05", "z", 2), ("c4", "c", "2024-01-01", "w", 3)], "commit string, kind string, at string, value string, key int").withColumn("at", F.col("at").cast("timestamp"))
    back = history.restore(h, "key", "2024-01-02", "r1", "2024-02-01")
    assert back.columns == h.columns
    assert column(back, "key", "kind", "value", "commit") == [(1, "restore", "x", "r1"), (2, "remove", None, "r1")] or {tuple(r) for r in back.select("key", "kind", "value", "commit").collect()} == {(1, "restore", "x", "r1"), (2, "remove", None, "r1")}
    whole = h.unionByName(back)
    assert column(history.living(whole, "key", "2024-12-31"), "key", "value") == [(1, "x"), (3, "w")]
    assert history.restore(whole, "key", "2024-01-02", "r2", "2024-03-01").filter("kind = 'remove'").count() == 0
    assert {r["change"] for r in history.commit(h, h.filter("key < 3")).collect()} == {"removed"}
    assert history.last_heading(logs).first()["heading"] == "2024-01-01"
    per = history.per_user_gap(h.select(F.col("key").alias("user_id"), "at", "commit"))
    assert column(per.filter("gap is not null"), "gap") == [4 * 86400]


def archive(members: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2"><v>1.5</v></c></row><row r="3"><c r="C3" t="inlineStr"><is><t>p|q</t></is></c></row></sheetData></worksheet>'
XLSX = archive(
    {
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Empty" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>na</t><t>me</t></si></sst>",
        "xl/worksheets/s1.xml": SHEET,
        "xl/worksheets/s2.xml": "<worksheet><sheetData/></worksheet>",
        "xl/media/b.png": b"2",
        "xl/media/a.jpg": b"1",
    }
)


def test_office_files(spark):
    docx = archive({"word/document.xml": "<w:p>One &amp; two</w:p><w:p><b>three</b></w:p>", "word/media/x.png": b"9"})
    pptx = archive({"ppt/slides/slide10.xml": "<a:p>ten</a:p>", "ppt/slides/slide2.xml": "<a:p>two</a:p>", "ppt/slides/slide3.xml": "<x/>"})
    page = b"<html><head><title>no</title></head><body><h2>Head</h2><p>A <b>b</b> <a href='u'>link</a></p><ul><li>x</li><li>y</li></ul><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><script>bad()</script></body></html>"
    rows = [("a", "docx", docx), ("b", "pptx", pptx), ("c", "xlsx", XLSX), ("d", "DOCX", b"broken"), ("e", "html", page), ("f", "txt", "naïve".encode("latin-1")), ("g", "bin", bytes(range(256))), ("h", "csv", b'a,"b ""x"", c"\n\n1,2'), ("i", "png", b"x"), ("j", "xls", b"old")]
    files = spark.createDataFrame([(p, e, f"{p}.{e}", c) for p, e, c in rows], "path string, ext string, filename string, content binary")
    got = {r["path"]: r for r in office.convert(files, MARK).collect()}
    assert got["a"]["markdown"] == "One & two\n\nthree"
    assert got["b"]["markdown"] == "## Slide 1\n\ntwo\n\n## Slide 3\n\nten\n\n"
    assert got["c"]["markdown"] == "## One\n\n| name | 1.5 |\n| --- | --- |\n|  | p\\|q |\n\n"
    assert got["d"]["needs_llm"] and got["d"]["markdown"].startswith(MARK + "\n\n> docx conversion failed")
    assert got["e"]["markdown"] == "## Head\n\nA **b** [link](u)\n\n- x\n- y\n\n| k | v |\n| --- | --- |\n| 1 | 2 |"
    assert got["f"]["markdown"] == "na�ve"
    assert "Unknown format `.bin`" in got["g"]["markdown"]
    assert got["h"]["markdown"] == '| a | b "x", c |\n| --- | --- |\n| 1 | 2 |\n'
    assert got["i"]["format"] == "image"
    assert got["j"]["needs_llm"]
    assert not any(got[k]["needs_llm"] for k in "abcefh")
    media = {(r["path"], r["n"], r["ext"], r["origin"]) for r in office.media(files).collect()}
    assert media == {("a", 1, "png", "word/media/x.png"), ("c", 1, "jpg", "xl/media/a.jpg"), ("c", 2, "png", "xl/media/b.png")}


def test_zip_members(spark):
    data = archive({"d/": b"", "d/a.txt": b"1", "__MACOSX/d/._a.txt": b"x", "b/.DS_Store": b"x", "c.md": b"2"})
    files = spark.createDataFrame([("z", data), ("bad", b"nope"), ("none", None)], "path string, content binary")
    assert column(archives.expanded(files), "path", "name", "content") == [("z", "c.md", bytearray(b"2")), ("z", "d/a.txt", bytearray(b"1"))]
    assert archives.expanded(files, limit=2).count() == 1
    assert column(archives.members(files).filter("member is null"), "path") == ["bad", "none"]
    assert archives.members(files, max_bytes=0).filter("bytes is null and error is not null").count() == 6


def test_cells_of_any_length(spark):
    big = "x" * (1 << 20)
    lines = [f'a,"{big}",c', '"never, closed', ",b,", '"",""""', 'a"b,c"d,e', " \t ,　x　", f'"{"ab" * 5000}""{big}"']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(T.split_delimited(F.col("x"))).collect()]
    assert got == [["a", big, "c"], ["never, closed"], ["", "b", ""], ["", '"'], ["ab,cd", "e"], ["", "x"], ["ab" * 5000 + '"' + big]]
    table = spark.createDataFrame([("h\n" + "\n".join(map(str, range(600))),)], "x string")
    assert table.select(ingest.table_markdown(F.col("x"))).first()[0].endswith("| 499 |\n\n_(truncated at 500 rows)_\n")
    assert table.select(ingest.table_markdown(F.col("x"), row_cap=None)).first()[0].endswith("| 599 |\n")


def test_figures(spark):
    png = base64.b64encode(b"pic").decode()
    body = f"a ![x](data:image/jpeg;base64,{png}) b data:image/png;base64,A c data:image/svg+xml;base64,{png}"
    apart = ingest.figures_apart(spark.createDataFrame([("s", body)], "id string, body string"))
    row = apart.first()
    assert row["body"] == "a ![x](figures/fig-001.jpg) b data:image/png;base64,A c figures/fig-002.svg"
    assert [(f["ext"], bytes(f["bytes"])) for f in row["found"]] == [("jpg", b"pic"), ("svg", b"pic")]
    loose = spark.createDataFrame([("s", "text", [("PNG", b"1", "folder:a.PNG")])], "id string, body string, found array<struct<ext:string,bytes:binary,origin:string>>")
    row = ingest.figures_written(loose, 2).first()
    assert row["body"] == "text\n\n![fig-003.png](figures/fig-003.png)\n"
    assert [tuple(f) for f in row["figures"]] == [("figures/fig-003.png", True, False, "folder:a.PNG")]
    banner = ingest.with_banner(ingest.figures_written(apart).withColumn("markdown", F.col("body")).withColumn("needs_llm", F.lit(False)), MARK).first()
    assert banner["needs_llm"]
    assert banner["markdown"].startswith(MARK)
    named = ingest.name_figure(spark.createDataFrame([("s", "see figures/a.png", [("a.png", True)]), ("t", "figures/a.png", [("a.png", True)])], "id string, body string, figures array<struct<file:string,provisional:boolean>>"), "s", "a.png", "b.png")
    assert {r["id"]: (r["body"], r["figures"][0]["provisional"]) for r in named.collect()} == {"s": ("see figures/b.png", False), "t": ("figures/a.png", True)}
    assert [(r["n"], r["ext"]) for r in ingest.data_uri_figures(spark.createDataFrame([("s", body)], "id string, body string")).collect()] == [(1, "jpg"), (2, "svg")]


def test_grouping_merging_and_ids(spark):
    members = spark.createDataFrame([("f", 1, "a.md", 5), ("f", 2, "b.txt", 5), ("f", 3, "p.PNG", 9), ("g", 1, "q.jpg", 1)], "folder string, ord int, name string, length int")
    assert column(ingest.grouped(members), "folder", "ord", "role") == [("f", 1, "document"), ("f", 2, "primary"), ("f", 3, "figure"), ("g", 1, "image")]
    many = spark.createDataFrame([("b", i * 3, f"n{i}", "x", i == 204) for i in range(205)], "batch string, ord int, name string, markdown string, needs_llm boolean")
    assert ingest.combined(many).first()["markdown"].count("# n") == 200
    assert ingest.combined(many, None).first()["markdown"].count("# n") == 205
    texts = ingest.inline_sources(spark.createDataFrame([("My Title!", "body"), ("!", "x")], "title string, text string"))
    assert column(texts, "filename") == ["my-title.md", "source.md"]
    main = spark.createDataFrame([("A", ["raw/1"], ["x:1"], ["alpha"], "x:1")], "identifier string, raw_sources array<string>, xrefs array<string>, synonyms array<string>, xref string")
    other = spark.createDataFrame([("B", ["raw/2", "raw/1"], ["x:2"], ["ALPHA"], "x:9"), ("C", [], [], [], "x:1"), ("A", [], [], [], None)], main.schema)
    assert column(merge.candidates(main, other), "main_id", "other_id") == [("A", "A"), ("A", "B"), ("A", "C")]
    matches = spark.createDataFrame([("B", "A")], "old string, new string")
    united = merge.unite_sources(main, other, matches).first()
    assert (sorted(united["raw_sources"]), sorted(united["xrefs"])) == (["raw/1", "raw/2"], ["x:1", "x:2"])
    assert column(merge.renamed(main, other, matches), "old", "new") == [("A", "A (2)")]
    moved = merge.rewrite_raw_source(spark.createDataFrame([("raw/a/source.md",), ("raw/b/x",), (None,)], "raw_source string"), spark.createDataFrame([("a", "a-2")], "id string, final_id string"))
    assert {r[0] for r in moved.select("raw_source").collect()} == {"raw/a-2/source.md", "raw/b/x", None}
    one = spark.createDataFrame([("Grüße & Co.", "10.1101/2020", "a/__MACOSX/b")], "a string, b string, c string")
    assert tuple(one.select(T.kb_id(F.col("a")), T.preprint_doi(F.col("b")), T.junk(F.col("c")), T.commit_slug(F.col("a"))).first()) == ("gr-e-co", True, True, "gr-e-co")
    assert len(one.select(T.today()).first()[0]) == 10


def test_registry(spark):
    records = spark.createDataFrame([("10.1/A", '{"type":"journal-article","publisher":"PLOS","update-to":[{"type":"retraction"}],"container-title":["J"]}'), ("10.1/b", '{"type":"preprint","host_venue":{"publisher":"x","display_name":"V"}}'), ("10.1/c", '{"type":"unheard"}')], "doi string, record string")
    verdicts = credibility.registry_verdicts(records)
    assert column(verdicts, "doi", "tier", "confidence", "retracted", "venue") == [("10.1/a", "peer_reviewed", 0.95, True, "J"), ("10.1/b", "preprint", 0.85, False, "V")]
    docs = spark.createDataFrame([("https://x.example/1", None, "doi 10.1000/xyz")], "url string, filename string, body string")
    assert credibility.classify(docs, verdicts).first()["tier"] == "web"
    reg = verdicts.withColumn("doi", F.lit("10.1000/xyz")).limit(1)
    assert credibility.classify(docs, reg).first()["tier"] in ("peer_reviewed", "preprint")
    assert column(docs.select(credibility.tier_rank(F.lit("web")).alias("r")), "r") == [5]


def test_stream_stores_each_content_once(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub" / ".git").mkdir(parents=True)
    for name, data in {"a.md": b"# One\ntext", "b.md": b"# One\ntext", "sub/c.txt": b"caf\xe9 au lait", ".DS_Store": b"x", "sub/.git/d.md": b"hidden"}.items():
        (folder / name).write_bytes(data)
    (folder / "g.xlsx").write_bytes(XLSX)
    (folder / "h.md").write_bytes(b"# Pictured\n![x](data:image/png;base64," + base64.b64encode(b"pic") + b")")
    run = lambda: streaming.ingest_stream(spark, f"file://{folder}", f"file://{tmp_path}/store", f"file://{tmp_path}/ck").awaitTermination()
    run()
    (folder / "e.md").write_bytes(b"# Two\nmore")
    (folder / "f.md").write_bytes(b"# One\ntext")
    run()
    got = spark.read.parquet(f"file://{tmp_path}/store")
    assert column(got, "title") == ["One", "One", "Pictured", "Two", "caf� au lait"]
    rows = {r["filename"]: r for r in got.collect()}
    assert [f["origin"] for f in rows["g.xlsx"]["figures"]] == ["xl/media/a.jpg", "xl/media/b.png"]
    assert rows["g.xlsx"]["markdown"].endswith("![fig-001.jpg](figures/fig-001.jpg)\n\n![fig-002.png](figures/fig-002.png)\n")
    assert rows["h.md"]["markdown"] == ingest.MARKER + "\n\n# Pictured\n![x](figures/fig-001.png)"
    assert (rows["h.md"]["needs_llm"], rows["e.md"]["needs_llm"], rows["e.md"]["figures"]) == (True, False, [])
    assert bytes(rows["h.md"]["found"][0]["bytes"]) == b"pic"


def test_stream_by_url_then_content(spark, tmp_path):
    """A known URL goes whatever it holds, a known content goes whatever its URL; a batch that is run again adds nothing."""
    rows = lambda *r: spark.createDataFrame(list(r), "path string, content binary, url string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    run = lambda: streaming.stored_once(spark.readStream.schema("path string, content binary, url string").parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/store", f"file://{tmp_path}/ck").awaitTermination()
    rows(("a.md", b"# A", "http://x/a"), ("b.md", b"# B", None))
    run()
    rows(("a2.md", b"# changed", "http://x/a"), ("c.md", b"# B", "http://x/c"), ("d.md", b"# D", "http://x/d"), ("e.md", b"# D", "http://x/e"), ("f.md", b"# B", None))
    run()
    stored = lambda: column(spark.read.parquet(f"file://{tmp_path}/store"), "title")
    assert stored() == ["A", "B", "D"]
    assert streaming.seen(spark, f"file://{tmp_path}/ck").count() == 3
    last = max(int(p.name) for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit())
    (tmp_path / "ck" / "commits" / str(last)).unlink()  # as if the batch had failed after it wrote
    for p in (tmp_path / "ck" / "commits").glob(f".{last}.crc"):
        p.unlink()
    run()
    assert stored() == ["A", "B", "D"]


def test_vocabulary_tables(spark):
    from loomgraph import vocab

    types, predicates = vocab.dim_node_type(spark), vocab.dim_predicate(spark)
    assert (types.count(), types.filter("is_provenance").count(), predicates.count()) == (28, 4, 35)
    assert column(predicates.filter("symmetric"), "name") == ["associated_with", "interacts_with", "not_associated_with", "not_interacts_with"]


def test_best_level_by_rank(spark):
    edges = spark.createDataFrame([("a", "p", "m", "prediction"), ("a", "p", "m", "statistical_association"), ("a", "p", "m", None), ("m", "q", "z", None), ("b", "p", "m", "unheard")], "subject string, predicate string, object string, knowledge_level string")
    assert {tuple(r) for r in graph.two_hop(edges, "p", "q").select("start", "n_paths", "level").collect()} == {("a", 3, "statistical_association"), ("b", 1, "unheard")}


def test_snapshot_takes_the_last_in_file_order(spark, tmp_path):
    nodes = spark.createDataFrame([("A", "z.md", "1"), ("A", "a.md", "2")], "identifier string, path string, file_ord string")
    merge.write_snapshot(nodes, f"file://{tmp_path}/snap")
    assert spark.read.parquet(f"file://{tmp_path}/snap").first()["path"] == "a.md"
    assert merge.verify_snapshot(merge.snapshot(nodes), nodes.filter("path = 'z.md'")).first()["issue"] == "moved"
