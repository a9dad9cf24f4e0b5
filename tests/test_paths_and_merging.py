"""Paths without a bound, patterns, components, similar names and semantic merging, against plain versions."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import components, graph, history, matching, merge, normalise, office, paths, semantic, trees, versions

EDGE = "subject string, raw_predicate string, object string, knowledge_level string, agent_type string, primary_source string, negated_flag boolean, direction string, ci_lower double, ci_upper double, p_value double"


def edges_of(spark, rows):
    """(subject, predicate, object, level) rows as normalised edges."""
    return normalise.normalise_edges(spark.createDataFrame([(s, p, o, k, "manual_agent", "src" if k else None, False, None, None, None, None) for s, p, o, k in rows], EDGE))


def named(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "identifier string")


def breadth_first(links, starts):
    ahead = defaultdict(set)
    for a, b in links:
        ahead[a].add(b)
    hops, queue = dict.fromkeys(starts, 0), deque(starts)
    while queue:
        for b in ahead[a := queue.popleft()]:
            if b not in hops:
                hops[b] = hops[a] + 1
                queue.append(b)
    return hops


def test_distances_along_a_chain_of_a_thousand_hops(spark):
    """With a side way, a shorter way back into the chain, a ring at its end and one that nothing reaches."""
    links = [(f"n{i}", f"n{i + 1}") for i in range(1000)] + [("n0", "side"), ("side", "n400"), ("n1000", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("q1", "q2"), ("q2", "q1"), ("n5", "n5"), ("n7", None)]
    found = {r["identifier"]: r["hops"] for r in paths.distances(spark.createDataFrame(links, "source string, target string"), named(spark, "n0")).collect()}
    assert found == breadth_first([x for x in links if x[1]], ["n0"])
    assert found["n399"] == 399 and found["n1000"] == 602 and "q1" not in found


@pytest.mark.parametrize("seed", range(4))
def test_distances_of_random_graphs(spark, seed):
    """Few links, so that chains, rings and several starts occur in every way."""
    rng = random.Random(seed)
    links = [(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range([50, 65, 80, 150][seed])]
    starts = [f"v{rng.randrange(60)}" for _ in range(1 + seed % 3)] + ["nowhere"]
    frame = spark.createDataFrame(links, "source string, target string")
    got = {r["identifier"]: r["hops"] for r in paths.distances(frame, named(spark, *starts, *starts)).collect()}
    want = breadth_first(links, starts)
    assert got == want
    assert {r["identifier"]: r["hops"] for r in paths.distances(frame, named(spark, *starts), 2).collect()} == {k: v for k, v in want.items() if v <= 2}


def test_shortest_paths(spark):
    rng = random.Random(8)
    rows = [(f"v{rng.randrange(30)}", rng.choice(["causes", "caused_by", "treats"]), f"v{rng.randrange(30)}", "observation") for _ in range(60)]
    steps = [(o, s, "causes") if p == "caused_by" else (s, o, p) for s, p, o, _ in rows]
    hops = breadth_first([(a, b) for a, b, _ in steps], ["v0", "v1"])
    best = {v: min((a, p) for a, b, p in steps if b == v and hops.get(a) == hops[v] - 1) for v in hops if hops[v]}

    def path(v):
        if not hops[v]:
            return v, [], [v]
        start, predicates, nodes = path(best[v][0])
        return start, [*predicates, best[v][1]], [*nodes, v]

    want = {v: (hops[v], *path(v)) for v in hops}
    rowed = lambda df: {r["identifier"]: (r["hops"], r["start"], r["predicates"], r["nodes"]) for r in df.collect()}
    edges = edges_of(spark, rows)
    assert rowed(paths.shortest_paths(edges, named(spark, "v0", "v1"))) == want
    some = sorted(want, key=lambda v: -want[v][0])[:3] + ["v0", "elsewhere"]
    assert rowed(paths.shortest_paths(edges, named(spark, "v0", "v1"), named(spark, *some))) == {v: want[v] for v in some if v in want}
    assert {r["identifier"]: r["hops"] for r in paths.reachable(edges, "v0").collect()} == breadth_first([(a, b) for a, b, _ in steps], ["v0"])


def test_patterns_of_any_number_of_hops(spark):
    rng = random.Random(9)
    levels = ["knowledge_assertion", "prediction", "observation", None, "odd"]
    rows = [(f"{rng.choice('abc')}{rng.randrange(6)}", rng.choice(["treats", "treated_by", "causes", "associated_with"]), f"{rng.choice('abc')}{rng.randrange(6)}", rng.choice(levels)) for _ in range(250)]
    nodes = spark.createDataFrame([(f"{x}{i}", {"a": "Gene", "b": "Disease", "c": "Study"}[x], f"{x}{i}") for x in "abc" for i in range(6)] + [("a0", "Disease", "z")], "identifier string, node_type string, file_ord string")
    hops = [paths.Hop(("treats",), types=("Disease",), levels=("knowledge_assertion", "prediction", "observation")), paths.Hop(("associated_with",), either=True, sourced=True), paths.Hop(("causes", "treats"), backward=True), paths.Hop(("causes",))]
    steps = [(o, s, "treats", k) if p == "treated_by" else (s, o, p, k) for s, p, o, k in rows]
    rank = lambda k: ["knowledge_assertion", "statistical_association", "prediction", "observation", "not_provided"].index(k) if k not in (None, "odd") else 5
    one = [(a, b, k) for a, b, p, k in steps if p == "treats" and b[0] == "b" and k in ("knowledge_assertion", "prediction", "observation") and a[0] == "a"]
    two = [x for a, b, p, k in steps if p == "associated_with" and k for x in ((a, b, k), (b, a, k))]
    three = [(b, a, k) for a, b, p, k in steps if p in ("causes", "treats")]
    four = [(a, b, k) for a, b, p, k in steps if p == "causes"]
    want: dict = defaultdict(list)
    for w, x, y, z in itertools.product(one, two, three, four):
        if w[1] == x[0] and x[1] == y[0] and y[1] == z[0]:
            want[w[0], z[1]].append(max(rank(t[2]) for t in (w, x, y, z)))
    named_level = lambda r: ["knowledge_assertion", "statistical_association", "prediction", "observation", "not_provided", None][r]
    got = paths.pattern(edges_of(spark, rows), hops, nodes, ("Gene",))
    assert {(r["start"], r["finish"]): (r["n_paths"], r["level"]) for r in got.collect()} == {k: (len(v), named_level(min(v))) for k, v in want.items()}
    assert paths.pattern(edges_of(spark, rows), [paths.Hop(("binds",))]).count() == 0


def test_ordinals_of_a_hub(spark):
    """One subject in every part of the range, with rows that are equal throughout."""
    rows = [("hub", "causes", f"o{i % 700}", "observation") for i in range(900)] + [("b", "treats", "x", None), ("a", "treats", "x", None)]
    got = graph.edge_ordinals(edges_of(spark, rows).repartition(7)).collect()
    assert sorted(r["edge_ord"] for r in got if r["subject"] == "hub") == list(range(1, 901))
    assert [r["object"] for r in sorted((r for r in got if r["subject"] == "hub"), key=lambda r: r["edge_ord"])] == sorted(o for _, _, o, _ in rows[:900])
    assert {r["subject"]: r["edge_ord"] for r in got if r["subject"] != "hub"} == {"a": 1, "b": 1}


def test_components_of_names(spark):
    rng = random.Random(4)
    links = [(f"v{rng.randrange(200)}", f"v{rng.randrange(200)}") for _ in range(110)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)] + [("hub", f"leaf{i}") for i in range(40)] + [("alone", "alone"), (None, "x"), ("c000", "c000")]
    parent: dict = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {v: find(v) for v in parent}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("edits", "q"), [(1, 2), (2, 2), (2, 3), (3, 1)])
def test_similar_keys_are_all_found(spark, edits, q):
    """Keys of every length, few letters, many repeated grams, letters past ASCII."""
    rng = random.Random(edits * 10 + q)
    keys = {"".join(rng.choice("aabé") for _ in range(rng.randrange(1, 14))) for _ in range(150)} | {"aaaaaaaaaaaa", "aaaaaaaaaa", "baaaaaaaaaaa", "abababababab", "babababababa"}
    rows = [(k, rng.random() < 0.6, rng.random() < 0.6) for k in sorted(keys)]
    got = {(r["main_key"], r["other_key"]): r["distance"] for r in matching.similar_keys(spark.createDataFrame(rows, "key string, in_main boolean, in_other boolean"), edits, q).collect()}
    assert got == {(a, b): n for a, m, _ in rows for b, _, o in rows if m and o and 1 <= (n := edit_distance(a, b)) <= edits}


def test_similar_candidates(spark):
    main = spark.createDataFrame([("Aspirin", ["acetylsalicylic acid"]), ("Kinase", None), ("!!", [])], "identifier string, synonyms array<string>")
    other = spark.createDataFrame([("ASA", ["Acetyl-salicylic  acids", "aspirine"]), ("kinase", ["x"]), ("Aspirin", [])], "identifier string, synonyms array<string>")
    got = {tuple(r) for r in matching.similar_candidates(main, other).collect()}
    assert got == {("Aspirin", "ASA", 1)}
    equal = matching.similar_names(spark.createDataFrame([("1", "abc d"), ("2", "ABC-d"), ("3", "abc e")], "identifier string, name string"), spark.createDataFrame([("7", "abc  e"), ("8", None)], "identifier string, name string"))
    assert [tuple(r) for r in equal.collect()] == [("abc d", "abc e", 1, 2, 1)]


NODE = "identifier string, node_type string, subtype string, note string, raw_sources array<string>, path string, file_ord string"


def bases(spark):
    node = lambda name, kind, subtype=None, note=None, raw=(): (name, kind, subtype, note, list(raw), f"{name}.md", name)
    main = [node("a", "Gene", "Protein-coding", "of main", ["r1"]), node("x", "Gene", "Protein-coding"), node("d", "Disease"), node("taken", "Gene"), node("taken (2)", "Gene"), node("p", "Publication", raw=["r2"])]
    other = [node("b", "Gene", "protein coding", "of other", ["r1", "r3"]), node("c", "Gene", "pseudo"), node("x", "Gene", "pseudo"), node("facet", "Phenotype"), node("taken", "Disease"), node("taken (3)", "Gene"), node("new", "Gene", "proteincoding"), node("q", "Publication", raw=["r9"])]
    matches = [("b", "a"), ("b", "x"), ("c", "x"), ("facet", "d"), ("q", "p"), ("gone", "a"), ("c", "gone"), ("b", "a")]
    return spark.createDataFrame(main, NODE), spark.createDataFrame(other, NODE), spark.createDataFrame(matches, "old string, new string")


def test_merge_map_follows_chains_and_finds_free_names(spark):
    main, other, matches = bases(spark)
    got = {(r["origin"], r["identifier"]): (r["final"], r["action"]) for r in semantic.merge_map(main, other, matches).collect()}
    assert got == {
        ("main", "a"): ("a", "kept"), ("main", "x"): ("a", "collapsed"), ("main", "d"): ("d", "kept"), ("main", "taken"): ("taken", "kept"), ("main", "taken (2)"): ("taken (2)", "kept"), ("main", "p"): ("p", "kept"),
        ("other", "b"): ("a", "collapsed"), ("other", "c"): ("a", "collapsed"), ("other", "x"): ("x (2)", "renamed"), ("other", "facet"): ("facet", "carried"), ("other", "taken"): ("taken (4)", "renamed"),
        ("other", "taken (3)"): ("taken (3)", "carried"), ("other", "new"): ("new", "carried"), ("other", "q"): ("p", "collapsed"),
    }


def test_merged_nodes_lose_nothing(spark):
    main, other, matches = bases(spark)
    final = semantic.merge_map(main, other, matches)
    got = {r["identifier"]: r for r in semantic.merged_nodes(main, other, final, ["node_type", "subtype", "note"], ["raw_sources"]).collect()}
    assert sorted(got) == ["a", "d", "facet", "new", "p", "taken", "taken (2)", "taken (3)", "taken (4)", "x (2)"]
    assert (got["a"]["subtype"], got["a"]["note"], sorted(got["a"]["raw_sources"]), got["a"]["also_known"], got["a"]["path"]) == ("Protein-coding", "of main", ["r1", "r3"], ["b", "c", "x"], "a.md")
    assert got["p"]["raw_sources"] == ["r2", "r9"] and got["x (2)"]["also_known"] == ["x"] and got["taken (4)"]["node_type"] == "Disease"
    clash = {(r["identifier"], r["field"], r["value"], r["origin"], r["source"]) for r in semantic.scalar_conflicts(main, other, final, ["subtype", "note"]).collect()}
    assert clash == {("a", "note", "of main", "main", "a"), ("a", "note", "of other", "other", "b"), ("a", "subtype", "Protein-coding", "main", "a"), ("a", "subtype", "Protein-coding", "main", "x"), ("a", "subtype", "protein coding", "other", "b"), ("a", "subtype", "pseudo", "other", "c")}
    both = semantic._of_both(main, other)
    assert Counter(r["subtype"] for r in semantic.harmonised(both).collect() if r["node_type"] == "Gene" and r["subtype"]) == {"Protein-coding": 4, "pseudo": 2}


def test_merged_edges_follow_and_contradictions_stay(spark):
    main, other, matches = bases(spark)
    final = semantic.merge_map(main, other, matches)
    ours = edges_of(spark, [("a", "causes", "d", "observation"), ("x", "causes", "d", "observation"), ("taken", "treats", "elsewhere", None)])
    theirs = edges_of(spark, [("b", "not_causes", "d", "observation"), ("facet", "treats", "taken", "observation"), ("x", "reported_in", "q", "observation"), ("x", "causes", "x", "observation")]).withColumn("primary_source", F.lit("q"))
    merged = semantic.merged_edges(ours, theirs, final)
    assert Counter((r["origin"], r["subject"], r["predicate"], r["object"], r["primary_source"]) for r in merged.collect()) == {
        ("main", "a", "causes", "d", "src"): 2, ("main", "taken", "treats", "elsewhere", None): 1, ("other", "a", "not_causes", "d", "p"): 1, ("other", "facet", "treats", "taken (4)", "p"): 1,
        ("other", "x (2)", "reported_in", "p", "p"): 1, ("other", "x (2)", "causes", "x (2)", "p"): 1,
    }
    assert [tuple(r) for r in semantic.contradictions(merged).collect()] == [("a", "causes", "d", ["main"], ["other"])]


def test_renamed_takes_no_taken_name(spark):
    frame = lambda *names: named(spark, *names)
    got = merge.renamed(frame("X", "X (2)", "Y", "Z", "Z (3)"), frame("X", "Y", "Z", "X (3)", "N"), spark.createDataFrame([("Y", "Y")], "old string, new string"))
    assert {(r["old"], r["new"]) for r in got.collect()} == {("X", "X (4)"), ("Z", "Z (2)")}


def test_snapshot_follows_moved_paths(spark):
    """Of two rows that share an identifier the last path counts, also where the first row has moved behind it."""
    rows = [("A", "k/gene/a.md", "1"), ("A", "k/part/a.md", "2"), ("B", "k/x/b.md", "3")]
    frame = lambda rows: spark.createDataFrame(rows, "identifier string, path string, file_ord string")
    before = merge.snapshot(frame(rows))
    assert {tuple(r) for r in before.collect()} == {("A", "k/part/a.md"), ("B", "k/x/b.md")}
    moved = [("A", "moved/k/gene/a.md", "1"), *rows[1:]]
    assert [tuple(r) for r in merge.verify_snapshot(before, frame(moved)).collect()] == [("A", "moved")]
    assert [tuple(r) for r in merge.verify_snapshot(before, frame(rows[:2])).collect()] == [("B", "removed")]


def test_restore_leaves_removed_keys_removed(spark):
    rows = [(1, "c1", "a", "add", "1"), (1, "c2", "b", "remove", None), (1, "c3", "d", "add", "9"), (2, "c4", "b", "remove", "left"), (3, "c5", "d", "add", "3"), (4, "c6", "a", "add", "4"), (4, "c7", "d", "remove", None), (5, "c8", "b", "remove", None), (5, "c9", "d", "remove", None)]
    days = {"a": "2024-01-01", "b": "2024-01-02", "d": "2024-02-01"}
    log = spark.createDataFrame([(k, c, days[d], kind, v) for k, c, d, kind, v in rows], "k long, commit string, at string, kind string, value string").withColumn("at", F.col("at").cast("timestamp"))
    added = history.restore(log, "k", "2024-01-15", "back", "2024-03-01")
    assert sorted((r["k"], r["kind"], r["value"]) for r in added.collect()) == [(1, "remove", None), (3, "remove", None), (4, "restore", "4")]
    alive = lambda df, at: sorted((r["k"], r["value"]) for r in history.living(df, "k", at).collect())
    assert alive(log.unionByName(added), "2024-12-31") == alive(log, "2024-01-15") == [(4, "4")]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<head><title>t</title><body><p>all of the text", "all of the text"),
        ("<html><head><title>t</title><meta charset=x><style>p{}</style><p>one<p>two", "one\n\ntwo"),
        ("<head><title>t</title></head><body>a <script>no</script>b", "a b"),
        ("<p>a<template><p>hid</template><p>b", "a\n\nb"),
        ("<p>a<template><style>s{}</style><p>kept<p>too", "a\n\nkept\n\ntoo"),
        ("<p>a<style>never ended", "anever ended"),
    ],
)
def test_pages_keep_their_text(page, want):
    assert office._page(page) == want


# --- versions ----------------------------------------------------------------------------------


def test_versions_of_two_writers(spark, tmp_path):
    """One commits, one is told of the conflict, one aborts; restoring copies a manifest, and old versions stay as they were."""
    table = versions.VersionedTable(spark, f"file://{tmp_path}/table")
    rows = lambda df: sorted(map(tuple, df.collect()))
    frame = lambda *pairs: spark.createDataFrame(pairs, "k long, v string")
    assert table.latest() == 0 and table.log().count() == 0
    assert table.commit(frame((1, "a"), (2, "b"), (2, "b")), "ingest", "first") == 1
    assert table.commit(frame((2, "b"), (2, "b"), (1, "a")), "ingest", "the same") == 1
    one, two, three = table.begin(), table.begin(), table.begin()
    one.append(frame((3, "c")))
    one.append(frame((4, "d")).select("v", "k"))
    two.replace(frame((9, "z")))
    three.append(frame((5, "e")))
    assert rows(table.read()) == [(1, "a"), (2, "b"), (2, "b")]  # nothing staged shows
    three.abort()
    with pytest.raises(ValueError, match="aborted"):
        three.commit("edit", "too late")
    assert one.commit("edit", "two writes") == 2
    with pytest.raises(versions.Conflict):
        two.commit("edit", "lost")
    again = table.begin()
    again.replace(frame((9, "z"), (2, "b")))
    assert rows(again.read()) == [(2, "b"), (9, "z")]
    assert again.commit("edit", "after all") == 3
    before = sorted(p.name for p in (tmp_path / "table" / "data").iterdir())
    assert table.restore(1) == 4
    assert sorted(p.name for p in (tmp_path / "table" / "data").iterdir()) == before
    assert rows(table.read()) == rows(table.read(1)) == [(1, "a"), (2, "b"), (2, "b")]
    assert rows(table.read(2)) == [(1, "a"), (2, "b"), (2, "b"), (3, "c"), (4, "d")] and rows(table.read(3)) == [(2, "b"), (9, "z")]
    log = [(r["version"], r["parent"], r["kind"], r["summary"], r["added"], r["removed"]) for r in table.log().orderBy("version").collect()]
    assert log == [(1, 0, "ingest", "first", 3, 0), (2, 1, "edit", "two writes", 2, 0), (3, 2, "edit", "after all", 1, 4), (4, 3, "restore", "version 1", None, None)]
    assert table.begin().commit("edit", "nothing") == 4
    with pytest.raises(ValueError, match="no version"):
        table.read(7)


# --- trees -------------------------------------------------------------------------------------


def plain_diff(before, after):
    old, new = {p: (i, h) for p, i, h in before}, {p: (i, h) for p, i, h in after}
    gone, came = {p: v for p, v in old.items() if p not in new}, {p: v for p, v in new.items() if p not in old}
    out = {}
    for p, (name, sha) in gone.items():
        moved, renamed = [q for q, v in came.items() if v[0] == name], [q for q, v in came.items() if v[1] == sha]
        out[p] = ("moved", min(moved)) if moved else ("renamed", min(renamed)) if renamed else ("removed", None)
    for p, (name, sha) in came.items():
        if not any(v[0] == name or v[1] == sha for v in gone.values()):
            out[p] = ("added", None)
    return out | {p: ("changed", None) for p in old.keys() & new.keys() if old[p] != new[p]}


@pytest.mark.parametrize("seed", range(2))
def test_tree_diff(spark, tmp_path, seed):
    rng = random.Random(seed)
    folder = lambda: "/".join(rng.choice(["a", "b", "long name", "12", "1e5"]) for _ in range(rng.randrange(4)))
    files = {f"{folder()}/f{i}.md".lstrip("/"): (f"n{i % 30}", f"h{rng.randrange(25)}") for i in range(40)}
    after = dict(files)
    for p in rng.sample(sorted(files), 12):
        what, (name, sha) = rng.randrange(4), after.pop(p)
        if what:
            after[p if what == 1 else f"{folder()}/new{len(after)}.md".lstrip("/")] = (name if what == 2 else f"other{len(after)}", sha if what != 1 else "h99")
    after["added/x.md"] = ("fresh", "fresh")
    rows = [[(p, *v) for p, v in f.items()] for f in (files, after)]
    roots = [f"file://{tmp_path}/{name}" for name in ("before", "after")]
    for r, root in zip(rows, roots, strict=True):
        trees.write_tree(spark.createDataFrame(r, "path string, identifier string, sha256 string").repartition(3), root)
    assert {r["path"]: (r["issue"], r["new_path"]) for r in trees.tree_diff(spark, *roots).collect()} == plain_diff(*rows)
    assert trees.tree_diff(spark, roots[0], roots[0]).count() == 0
    touched = {p.rpartition("/")[0] for p in files.keys() | after.keys() if files.get(p) != after.get(p)}
    assert {r["folder"] for r in trees.changed_folders(spark, *roots).collect()} == touched


def test_folders_that_are_alike_are_not_read(spark, tmp_path):
    """Their files are gone from storage, and the comparison does not miss them."""
    rows = [(f"k/{x}/{i}.md", f"{x}{i}", "h") for x in ("same", "other") for i in range(3)]
    roots = [f"file://{tmp_path}/{name}" for name in ("before", "after")]
    for root, more in zip(roots, ([], [("k/other/9.md", "x", "y")]), strict=True):
        trees.write_tree(spark.createDataFrame(rows + more, "path string, identifier string, sha256 string").coalesce(1), root)
    for root in ("before", "after"):
        for p in (tmp_path / root / "files").rglob("*.parquet"):
            if "k/same/0.md" in str(p) or any("k/same" in r["path"] for r in spark.read.parquet(f"file://{p}").collect()):
                p.write_bytes(b"no longer readable")
                for c in p.parent.glob(f".{p.name}.crc"):
                    c.unlink()
    assert [tuple(r) for r in trees.tree_diff(spark, *roots).collect()] == [("k/other/9.md", "added", None)]
