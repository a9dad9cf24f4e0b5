"""A bundle of Markdown documents with YAML frontmatter, read into nodes, edges and parse errors.

Spark lists and reads the files and normalises what they hold; Python only turns one file's frontmatter into JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

RESERVED = ["index.md", "log.md", "SCHEMA.md", "README.md"]
NODE_KEYS = ["type", "identifier", "title", "id", "subtype", "class_basis", "method", "synonyms", "xref", "tags", "raw_source", "in_taxon", "note", "description", "timestamp", "edges", "provided_by", "kind"]
EDGE_SCHEMA = "array<struct<predicate:string,object:string,knowledge_level:string,agent_type:string,primary_source:string,direction:string,note:string,negated:boolean,publications:array<string>,qualifiers:map<string,string>,stats:map<string,string>>>"
PARSED = f"path string, error string, meta map<string,string>, lists map<string,array<string>>, edges {EDGE_SCHEMA}, extra map<string,string>, body string"


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to the root) and text of every concept document."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    base = root.removeprefix("file://").rstrip("/")
    rel = F.expr("substring_index(file, {}, -1)".format(json.dumps(base + "/")))
    return raw.select(rel.alias("path"), "text").filter(_concept(F.col("path")))


def pages(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to the bundle) of every Markdown page under ``knowledge``, from file names alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(f"{root.rstrip('/')}/knowledge")
    return found.select(F.substring_index("path", root.removeprefix("file://").rstrip("/") + "/", -1).alias("path"))


def read_page(spark: SparkSession, root: str, page: str) -> DataFrame:
    """path, text of one page; the page must lie inside the bundle."""
    if page.startswith("/") or ".." in page.split("/"):
        raise ValueError(f"not a path inside the bundle: {page}")
    return spark.read.text(f"{root.rstrip('/')}/{page}", wholetext=True).select(F.lit(page).alias("path"), F.col("value").alias("text"))


def count_documents(spark: SparkSession, root: str) -> int:
    """How many concept documents there are; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    return found.select(F.substring_index("path", root.removeprefix("file://").rstrip("/") + "/", -1).alias("path")).filter(_concept(F.col("path"))).count()


def _concept(path: Column) -> Column:
    folders = F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/")
    return ~F.exists(folders, lambda d: d.isin("raw", "citations") | d.startswith(".")) & ~F.regexp_extract(path, "([^/]*)$", 1).isin(RESERVED)


def _loader():  # noqa: ANN202
    """YAML with core-schema scalars only: true/false, null, integers and floats; words such as yes, and dates, stay text."""
    import yaml

    class Core(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

        def construct_mapping(self, node, deep=False):  # noqa: ANN001, ANN202
            keys = [self.construct_object(k, deep=True) for k, _ in node.value]
            if len({str(k) for k in keys}) < len(keys):
                raise yaml.YAMLError("duplicate key")
            return super().construct_mapping(node, deep)

    for tag, pattern, first in (("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"), ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]), ("int", r"^[-+]?[0-9]+$", "-+0123456789"), ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", "-+.0123456789")):
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))
    Core.add_constructor("tag:yaml.org,2002:float", lambda loader, node: float(node.value))
    Core.add_constructor("tag:yaml.org,2002:int", lambda loader, node: int(node.value))
    return lambda text: yaml.load(text, Core)  # noqa: S506


def _quoted(text: str) -> str:
    """Second try for frontmatter that is no YAML: plain values that hold ": " are put in quotes."""
    fixed = []
    for line in text.split("\n"):
        m = re.match(r"^(\s*(?:- )?[A-Za-z0-9_]+: )(.*)$", line)
        value = m[2] if m else ""
        if m and ": " in value and value[:1] not in tuple("[{\"'>|&*#"):
            line = m[1] + json.dumps(value, ensure_ascii=False)
        fixed.append(line)
    return "\n".join(fixed)


def _scalar(x) -> str | None:  # noqa: ANN001
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(x) if isinstance(x, (str, int, float)) else None


def _strings(x) -> list[str]:  # noqa: ANN001
    return [s for s in map(_scalar, x if isinstance(x, list) else [x]) if s is not None]


def _json_map(d: dict) -> dict[str, str]:
    return {str(k): json.dumps(v, ensure_ascii=False, default=str) for k, v in d.items()}


def parse_document(text: str, load) -> dict:  # noqa: ANN001
    """One file -> the columns of PARSED but for path; raises ValueError where it cannot be read."""
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    lines = text.split("\n")
    if lines[0] != "---":
        raise ValueError("no frontmatter")
    end = next((i for i, x in enumerate(lines) if i and x in ("---", "...")), None)
    if end is None:
        raise ValueError("unterminated frontmatter")
    front, body = "\n".join(lines[1:end]), "\n".join(lines[end + 1 :]).lstrip("\n")
    try:
        meta = load(front)
    except Exception:
        meta = load(_quoted(front))
    if not isinstance(meta, dict):
        raise ValueError("frontmatter is no mapping")
    kinds = [k for k in meta if str(k).endswith("_kind")]
    known = {k: _scalar(meta.get(k)) for k in NODE_KEYS}
    known["kind"] = next((s for s in (_scalar(meta[k]) for k in kinds) if s is not None), None)
    if known["type"] is None:
        raise ValueError("missing type")
    if known["identifier"] is None and known["title"] is None and known["id"] is None:
        raise ValueError("missing identifier")
    lists = {k: _strings(meta.get(k)) for k in ("synonyms", "xref", "tags", "raw_source", "provided_by")}
    named = ("predicate", "object", "knowledge_level", "agent_type", "primary_source", "direction", "note")
    edges = []
    for e in meta.get("edges") if isinstance(meta.get("edges"), list) else []:
        if isinstance(e, dict) and _scalar(e.get("predicate")) is not None and _scalar(e.get("object")) is not None:
            row = {k: _scalar(e.get(k)) for k in named}
            row |= {"negated": e.get("negated") is True, "publications": _strings(e.get("publications")), "qualifiers": _json_map(e["qualifiers"]) if isinstance(e.get("qualifiers"), dict) else {}}
            edges.append(row | {"stats": _json_map({k: v for k, v in e.items() if k not in (*named, "negated", "publications", "qualifiers")})})
    extra = {k: v for k, v in meta.items() if k not in NODE_KEYS and k not in kinds}
    return {"error": None, "meta": {k: v for k, v in known.items() if v is not None}, "lists": lists, "edges": edges, "extra": _json_map(extra), "body": body}


def parsed(documents: DataFrame) -> DataFrame:
    """path, text -> PARSED; a file that cannot be read keeps its path and the error."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = _loader()
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    rows.append({"path": path} | parse_document(text or "", load))
                except Exception as e:
                    rows.append({"path": path, "error": str(e).split("\n")[0][:200], "meta": None, "lists": None, "edges": None, "extra": None, "body": None})
            yield pd.DataFrame(rows, columns=["path", "error", "meta", "lists", "edges", "extra", "body"])

    return documents.select("path", "text").mapInPandas(work, PARSED)


def parse_errors(rows: DataFrame) -> DataFrame:
    return rows.filter("error is not null").select("path", "error")


def nodes(rows: DataFrame) -> DataFrame:
    """Raw nodes: identifier, raw_type, subtype, lists, note, description, body, extra, path, file_ord."""
    m = lambda k: F.try_element_at("meta", F.lit(k))
    ls = lambda k: F.coalesce(F.try_element_at("lists", F.lit(k)), F.array().cast("array<string>"))
    title = m("identifier").isNull() & m("title").isNotNull() & m("id").isNotNull()
    xref = F.when(title, F.array_union(ls("xref"), F.array(m("id")))).otherwise(ls("xref"))
    return rows.filter("error is null").select(
        F.coalesce(m("identifier"), m("title"), m("id")).alias("identifier"),
        m("type").alias("raw_type"),
        F.coalesce(m("subtype"), m("class_basis"), m("method"), m("kind")).alias("subtype"),
        ls("synonyms").alias("synonyms"),
        F.when(F.size(xref) > 0, F.array_join(xref, ", ")).alias("xref"),
        F.get(ls("raw_source"), 0).alias("raw_source"),
        ls("raw_source").alias("raw_sources"),
        m("note").alias("note"),
        m("description").alias("description"),
        m("in_taxon").alias("in_taxon"),
        ls("tags").alias("tags"),
        "extra",
        "body",
        "path",
        T.file_order(F.col("path")).alias("file_ord"),
    )


def edges(rows: DataFrame) -> DataFrame:
    """Raw edges in document order, with the synthetic ones for provided_by after them."""
    subject = F.coalesce(*(F.try_element_at("meta", F.lit(k)) for k in ("identifier", "title", "id")))
    good = rows.filter("error is null").withColumn("subject", subject)
    number = lambda k: F.try_variant_get(F.try_parse_json(F.try_element_at("e.stats", F.lit(k))), "$", "double")
    is_number = lambda k: F.try_element_at("e.stats", F.lit(k)).rlike(r"^[-+0-9.eE]+$")
    stat = lambda k: F.when(is_number(k), number(k))
    authored = good.select("subject", "path", F.posexplode("edges").alias("edge_ord", "e")).select(
        "subject", F.col("e.predicate").alias("raw_predicate"), F.col("e.negated").alias("negated_flag"), "e.object", "e.knowledge_level", "e.agent_type", "e.primary_source", "e.direction",
        stat("ci_lower").alias("ci_lower"), stat("ci_upper").alias("ci_upper"), stat("p_value").alias("p_value"), "edge_ord", "e.stats", "e.qualifiers", "e.note", "path",
    )
    null = lambda t: F.lit(None).cast(t)
    given = good.select("subject", "path", F.size("edges").alias("n"), F.posexplode(F.try_element_at("lists", F.lit("provided_by"))).alias("i", "source")).select(
        "subject", F.lit("reported_in").alias("raw_predicate"), F.lit(False).alias("negated_flag"), F.col("source").alias("object"), F.lit("knowledge_assertion").alias("knowledge_level"), F.lit("manual_agent").alias("agent_type"),
        F.col("source").alias("primary_source"), null("string").alias("direction"), null("double").alias("ci_lower"), null("double").alias("ci_upper"), null("double").alias("p_value"), (F.col("n") + F.col("i")).alias("edge_ord"),
        null("map<string,string>").alias("stats"), null("map<string,string>").alias("qualifiers"), F.lit("from provided_by").alias("note"), "path",
    )
    return authored.unionByName(given)


def inline_edges(nodes_df: DataFrame) -> DataFrame:
    """Edges written in the body as ``[[pred:: object | k=v; k=v]]``: subject, raw_predicate, object, stats (an extension)."""
    pattern = r"\[\[\s*([A-Za-z_]+)::\s*([^\]|]+?)\s*(?:\|\s*([^\]]*))?\]\]"
    part = lambda g: F.regexp_extract_all("body", F.lit(pattern), F.lit(g))
    rows = nodes_df.select("identifier", F.explode(F.arrays_zip(part(1).alias("p"), part(2).alias("o"), part(3).alias("kv"))).alias("e"))
    return rows.select(F.col("identifier").alias("subject"), F.col("e.p").alias("raw_predicate"), F.trim("e.o").alias("object"), F.when(F.col("e.kv") != "", F.str_to_map(F.regexp_replace("e.kv", r"\s*;\s*", ";"), F.lit(";"), F.lit("="))).alias("stats"))
