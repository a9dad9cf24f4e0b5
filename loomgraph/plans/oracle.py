"""The queries of ``catalog`` in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from .. import vocab
from ..functions import text as T
from ..operators.lint import SEVERITY

Q = lambda values: ", ".join(f"'{v}'" for v in values)


def _case(column: str, table: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


_FAMILY = {t: f for f, types in vocab.FAMILIES.items() for t in types}
_NEGATIVE = [f"not_{p}" for p in vocab.NEGATABLE]
_PAD = "lpad(CAST({} AS VARCHAR), 9, '0') || '.md'"

NODES = f"""
raw_nodes AS (
  SELECT 'Region ' || r_regionkey AS identifier, 'GeographicLocation' AS raw_type, lower(r_name) AS subtype, CAST(NULL AS VARCHAR) AS note, r_name AS description, CAST(NULL AS VARCHAR) AS xref, CAST(NULL AS VARCHAR) AS raw_source, 'knowledge/geographiclocation/' || {_PAD.format("r_regionkey")} AS path FROM region
  UNION ALL SELECT 'Nation ' || n_nationkey, 'GeographicLocation', 'Nation', NULL, n_name, NULL, NULL, 'knowledge/geographiclocation/nation/' || {_PAD.format("n_nationkey")} FROM nation
  UNION ALL SELECT 'Customer ' || c_custkey, 'Population', CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END, NULL, c_name, NULL, NULL, 'knowledge/population/' || {_PAD.format("c_custkey")} FROM customer
  UNION ALL SELECT 'Supplier ' || s_suppkey, 'Agent', NULL, s_name, NULL, CASE WHEN s_suppkey % 3 <> 0 THEN 'infores: ' || s_suppkey END, CASE WHEN s_suppkey % 2 = 0 THEN 'raw/doc-' || s_suppkey || '/source.md' END, 'knowledge/agent/' || {_PAD.format("s_suppkey")} FROM supplier
  UNION ALL SELECT 'Order ' || o_orderkey, ' Study', CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE lower(o_orderpriority) END, NULL, NULL, 'order: ' || o_orderkey, NULL, 'knowledge/study/' || {_PAD.format("o_orderkey")} FROM orders
  UNION ALL SELECT CASE WHEN p_partkey % 101 = 0 THEN 'PT:' || p_partkey WHEN p_partkey % 103 = 0 THEN p_partkey || ' mg' WHEN p_partkey % 97 = 0 THEN 'Part ' || (p_partkey - 1) ELSE 'Part ' || p_partkey END,
    CASE WHEN p_partkey % 61 = 0 THEN 'Other' ELSE CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'Molecule' WHEN 'SMALL' THEN 'Disease' WHEN 'LARGE' THEN 'Phenotype' WHEN 'MEDIUM' THEN 'Gene' WHEN 'STANDARD' THEN 'Procedure' ELSE 'Promotion' END END,
    p_brand, CASE WHEN p_partkey % 122 = 0 THEN p_name END, p_name, NULL, NULL, CASE WHEN p_partkey % 13 = 0 THEN 'knowledge/disease/' ELSE 'knowledge/part/' END || {_PAD.format("p_partkey")} FROM part),
n0 AS (SELECT *, replace(path, '/', chr(1)) || chr(9) || identifier AS file_ord, {_case("trim(raw_type)", vocab.TYPE_ALIASES, "trim(raw_type)")} AS node_type FROM raw_nodes),
n AS (SELECT *, node_type IN ({Q(vocab.NODE_TYPES)}) AS type_valid, node_type IN ({Q(vocab.PROVENANCE_TYPES)}) AS is_provenance, {_case("node_type", _FAMILY, "'unknown'")} AS family FROM n0)"""

_Q = "(CAST(l_quantity AS BIGINT) % {})"
_NOTHING = "NULL, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
EDGES = f"""
raw_edges AS (
  SELECT CASE WHEN l_linenumber <= 3 THEN 'Order ' || l_orderkey ELSE 'Supplier ' || l_suppkey END AS subject,
    CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber = 2 THEN 'treated_by' ELSE 'treats' END WHEN l_returnflag = 'R' THEN 'not_treats' WHEN {_Q.format(5)} = 0 THEN 'regulates' WHEN {_Q.format(5)} = 1 THEN ' caused_by'
      WHEN {_Q.format(5)} = 2 THEN 'has_phenotype' WHEN {_Q.format(5)} = 3 THEN 'linked_to' ELSE 'associated_with' END AS raw_predicate,
    l_tax = CAST(0.02 AS DOUBLE) AS negated_flag, CASE WHEN l_partkey % 89 = 0 THEN 'HGNC:' || l_partkey ELSE 'Part ' || l_partkey END AS object,
    CASE WHEN {_Q.format(13)} = 0 THEN NULL WHEN {_Q.format(17)} = 0 THEN 'guess' WHEN l_linestatus = 'O' THEN 'knowledge_assertion' ELSE 'statistical_association' END AS knowledge_level,
    CASE WHEN {_Q.format(19)} = 0 THEN NULL WHEN {_Q.format(23)} = 0 THEN 'robot' ELSE 'manual_agent' END AS agent_type,
    CASE WHEN l_linenumber = 7 THEN NULL WHEN l_tax = CAST(0.08 AS DOUBLE) THEN 'not_provided' WHEN l_partkey % 50 = 0 THEN 'Part ' || l_partkey WHEN l_partkey % 51 = 0 THEN 'Missing ' || l_suppkey ELSE 'Supplier ' || l_suppkey END AS primary_source,
    CASE WHEN l_discount >= CAST(0.05 AS DOUBLE) THEN 'increased' END AS direction, l_extendedprice * (1 - l_discount) AS ci_lower, l_extendedprice * (1 - l_tax) AS ci_upper, l_discount * 12 AS p_value FROM lineitem
  UNION ALL SELECT 'Part ' || l_partkey, 'reported_in', false, 'Supplier ' || l_suppkey, 'knowledge_assertion', 'manual_agent', 'Supplier 1', {_NOTHING} FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT 'Customer ' || c_custkey, 'located_in', false, 'Nation ' || c_nationkey, 'knowledge_assertion', 'manual_agent', 'Supplier 1', {_NOTHING} FROM customer
  UNION ALL SELECT 'Supplier ' || s_suppkey, 'located_in', false, 'Nation ' || s_nationkey, 'knowledge_assertion', 'manual_agent', 'Supplier 1', {_NOTHING} FROM supplier
  UNION ALL SELECT 'Nation ' || n_nationkey, 'part_of', false, 'Region ' || n_regionkey, 'knowledge_assertion', 'manual_agent', 'Supplier 1', {_NOTHING} FROM nation),
e0 AS (SELECT *, trim(raw_predicate) IN ({Q(vocab.INVERSES)}) AS reversed, {_case("trim(raw_predicate)", vocab.INVERSES, "trim(raw_predicate)")} AS plain FROM raw_edges),
e1 AS (SELECT *, CASE WHEN negated_flag AND plain IN ({Q(vocab.NEGATABLE)}) THEN 'not_' || plain ELSE plain END AS predicate FROM e0),
e AS (SELECT *, predicate IN ({Q(vocab.ALL_PREDICATES)}) AS pred_valid, predicate IN ({Q(_NEGATIVE)}) AS negative, CASE WHEN predicate IN ({Q(_NEGATIVE)}) THEN substr(predicate, 5) ELSE predicate END AS base, predicate IN ({Q(_NEGATIVE)}) OR negated_flag AS negated FROM e1)"""

GRAPH = """
wanted AS (SELECT DISTINCT subject AS source, primary_source AS target FROM e WHERE primary_source IS NOT NULL AND primary_source <> 'not_provided' AND primary_source <> subject),
made AS (SELECT source, target, 'reported_in' AS predicate, true AS synthesized FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.predicate = 'reported_in' AND e.subject = w.source AND e.object = w.target)),
oriented AS (SELECT CASE WHEN reversed THEN object ELSE subject END AS source, CASE WHEN reversed THEN subject ELSE object END AS target, predicate, false AS synthesized FROM e),
g AS (SELECT * FROM oriented UNION ALL SELECT * FROM made),
deg AS (SELECT identifier, count(*) AS degree FROM (SELECT source AS identifier FROM g UNION ALL SELECT target FROM g) GROUP BY identifier),
stubs AS (SELECT DISTINCT identifier FROM (SELECT object AS identifier FROM e UNION ALL SELECT target FROM made) x WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.identifier = x.identifier)),
last_row AS (SELECT identifier, max(file_ord) AS last FROM n GROUP BY identifier),
gn AS (SELECT n.identifier, n.node_type, n.family, false AS external, CAST(CASE WHEN n.file_ord = l.last THEN coalesce(d.degree, 0) ELSE 0 END AS BIGINT) AS degree FROM n JOIN last_row l USING (identifier) LEFT JOIN deg d USING (identifier)
  UNION ALL SELECT s.identifier, 'External', 'external', true, CAST(d.degree AS BIGINT) FROM stubs s JOIN deg d USING (identifier))"""

TYPES = "types AS (SELECT identifier, arg_min(node_type, file_ord) AS node_type, arg_min(is_provenance, file_ord) AS is_provenance FROM n GROUP BY identifier)"


def nodes_sql(select: str) -> str:
    return f"WITH {NODES} {select}"


def edges_sql(select: str) -> str:
    return f"WITH {EDGES} {select}"


def both_sql(select: str, *more: str) -> str:
    return f"WITH {', '.join((NODES, EDGES, *more))} {select}"


_SUB = "subject, {} AS detail FROM e WHERE {}"
_named = "primary_source IS NOT NULL AND primary_source <> 'not_provided'"
_range_ok = " OR ".join(f"(base = '{p}' AND t.node_type IN ({Q(types)}))" for p, types in vocab.RANGES.items())
_folders = {t.lower(): t for t in vocab.NODE_TYPES}

LINT: dict[str, str] = {
    "identifier.duplicate": nodes_sql("SELECT identifier AS subject, path AS detail FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY file_ord) AS nth FROM n) WHERE nth > 1"),
    "type.invalid": nodes_sql("SELECT identifier AS subject, node_type AS detail FROM n WHERE NOT type_valid"),
    "identifier.opaque": nodes_sql("SELECT identifier AS subject, path AS detail FROM n WHERE contains(identifier, ':') AND NOT contains(identifier, ' ') AND NOT contains(identifier, '(')"),
    "subtype.missing": nodes_sql("SELECT identifier AS subject, node_type AS detail FROM n WHERE subtype IS NULL"),
    "source.unanchored": nodes_sql("SELECT identifier AS subject, node_type AS detail FROM n WHERE is_provenance AND xref IS NULL AND raw_source IS NULL"),
    "type.path_mismatch": nodes_sql(f"SELECT identifier AS subject, f AS detail FROM (SELECT *, {_case("lower(split_part(path, '/', -2))", _folders, 'NULL')} AS f FROM n) WHERE type_valid AND f IS NOT NULL AND f <> node_type"),
    "edge.duplicate": edges_sql("SELECT subject, predicate || ' ' || object || ' ' || coalesce(primary_source, '') AS detail FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object, coalesce(primary_source, '') ORDER BY 1) AS nth FROM e) WHERE nth > 1"),
    "value.as_identifier": nodes_sql("SELECT identifier AS subject, path AS detail FROM n WHERE regexp_full_match(trim(identifier), '[0-9]+\\.?[0-9]*\\s*(?:%|[A-Za-z]{1,3})?')"),
    "other.missing_note": nodes_sql("SELECT identifier AS subject, path AS detail FROM n WHERE node_type = 'Other' AND note IS NULL"),
    "node.no_reported_in": both_sql("SELECT identifier AS subject, node_type AS detail FROM n WHERE NOT is_provenance AND identifier NOT IN (SELECT subject FROM e WHERE base = 'reported_in')"),
    "node.orphan": both_sql("SELECT identifier AS subject, node_type AS detail FROM gn WHERE NOT external AND degree = 0", GRAPH),
    "edge.contradiction": edges_sql("SELECT subject, base || ' ' || object AS detail FROM e GROUP BY subject, base, object HAVING bool_or(negative) AND bool_or(NOT negative)"),
    "subtype.similar": nodes_sql("SELECT node_type AS subject, string_agg(subtype, ', ' ORDER BY subtype) AS detail FROM (SELECT DISTINCT node_type, subtype FROM n WHERE subtype IS NOT NULL) GROUP BY node_type, lower(regexp_replace(subtype, '[^A-Za-z0-9]', '', 'g')) HAVING count(*) > 1"),
    "predicate.invalid": edges_sql("SELECT " + _SUB.format("predicate", "NOT pred_valid")),
    "edge.not_negatable": edges_sql("SELECT " + _SUB.format("predicate", "negated_flag AND pred_valid AND NOT negative")),
    "predicate.inverse": edges_sql("SELECT " + _SUB.format("predicate", "reversed")),
    "edge.missing_knowledge_level": edges_sql("SELECT " + _SUB.format("object", "knowledge_level IS NULL")),
    "edge.invalid_knowledge_level": edges_sql("SELECT " + _SUB.format("knowledge_level", f"knowledge_level NOT IN ({Q(vocab.KNOWLEDGE_LEVELS)})")),
    "edge.missing_agent_type": edges_sql("SELECT " + _SUB.format("object", "agent_type IS NULL")),
    "edge.invalid_agent_type": edges_sql("SELECT " + _SUB.format("agent_type", f"agent_type NOT IN ({Q(vocab.AGENT_TYPES)})")),
    "edge.missing_primary_source": edges_sql("SELECT " + _SUB.format("object", "primary_source IS NULL")),
    "edge.primary_source_not_provided": edges_sql("SELECT " + _SUB.format("object", "primary_source = 'not_provided'")),
    "edge.primary_source_unresolved": both_sql("SELECT " + _SUB.format("primary_source", f"{_named} AND primary_source NOT IN (SELECT identifier FROM n)")),
    "edge.primary_source_not_source": both_sql(f"SELECT subject, primary_source AS detail FROM e JOIN types t ON e.primary_source = t.identifier WHERE {_named} AND NOT t.is_provenance", TYPES),
    "edge.object_unresolved": both_sql("SELECT " + _SUB.format("object", "object NOT IN (SELECT identifier FROM n)")),
    "edge.range": both_sql(f"SELECT subject, predicate || ' ' || object || ' ' || t.node_type AS detail FROM e JOIN types t ON e.object = t.identifier WHERE base IN ({Q(vocab.RANGES)}) AND NOT ({_range_ok})", TYPES),
    "edge.missing_direction": edges_sql("SELECT " + _SUB.format("predicate", "predicate IN ('regulates', 'expressed_in') AND direction IS NULL")),
    "edge.stat_ci": edges_sql("SELECT " + _SUB.format("object", "ci_lower > ci_upper")),
    "edge.stat_pvalue": edges_sql("SELECT " + _SUB.format("object", "p_value < 0 OR p_value > 1")),
}

SOURCES = """src AS (SELECT 'doc-' || d.doc_id AS id, d.doc_id, sha256(d.text) AS sha256, d.text AS body, CASE quality WHEN 1 THEN 'peer_reviewed' WHEN 0 THEN 'web' END AS tier, coalesce(toxic, 0) = 1 AS retracted, quality IS NOT NULL AS classified
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
#: Raw paths of nodes in turn, and the folder of each.
PATHS = """raws AS (SELECT identifier, file_ord, CASE WHEN raw_source IS NULL THEN CAST([] AS VARCHAR[]) WHEN ends_with(raw_source, '0/source.md') THEN ['raw/gone/source.md', regexp_replace(raw_source, '/source[.]md$', '')] ELSE [raw_source] END AS raws FROM n),
paths AS (SELECT identifier, file_ord, unnest(raws) AS path, generate_subscripts(raws, 1) AS ord FROM raws)"""
#: The first node of a cited identifier, its paths in turn, the first with metadata; classified ones only.
CITED = f"""cited AS (SELECT primary_source, tier, retracted FROM (SELECT p.identifier AS primary_source, s.tier, s.retracted, s.classified, row_number() OVER (PARTITION BY p.identifier ORDER BY p.ord) AS nth FROM paths p
  JOIN (SELECT identifier, min(file_ord) AS file_ord FROM n GROUP BY identifier) f ON f.identifier = p.identifier AND f.file_ord = p.file_ord
  JOIN src s ON 'raw/' || s.id = CASE WHEN regexp_matches(p.path, '(^|/)[^/]+[.][^/.]*$') THEN regexp_replace(p.path, '/[^/]*$', '') ELSE p.path END
  WHERE p.identifier IN (SELECT primary_source FROM e WHERE {_named})) WHERE nth = 1 AND classified)"""
RAW_FILES = "SELECT unnest(['raw/' || id, 'raw/' || id || '/source.md', 'raw/' || id || '/meta.yaml']) FROM src"
INDEX = "(SELECT string_agg('| ' || CASE WHEN p_partkey % 3 = 0 THEN 'Part ' ELSE 'P-' END || p_partkey || ' | ' || p_name || ' |', chr(10)) AS text FROM part)"
SOURCE_LINT: dict[str, str] = {
    "source.not_scholarly": both_sql("SELECT primary_source AS subject, tier AS detail FROM cited WHERE tier IN ('web', 'unknown')", SOURCES, PATHS, CITED),
    "source.retracted": both_sql("SELECT primary_source AS subject, tier AS detail FROM cited WHERE retracted", SOURCES, PATHS, CITED),
    "source.raw_missing_file": f"WITH {NODES}, {SOURCES}, {PATHS} SELECT identifier AS subject, path AS detail FROM paths WHERE path NOT IN ({RAW_FILES})",
    "index.stale": nodes_sql(f"SELECT DISTINCT identifier AS subject, CAST(NULL AS VARCHAR) AS detail FROM n, {INDEX} i WHERE NOT contains(text, identifier)"),
}

_tokens = "list_filter(regexp_split_to_array(lower({}), '[^\\pL\\pN]+'), lambda x: x <> '')"


def bm25_sql(query: list[str], limit: int | None = 10) -> str:
    terms = list(dict.fromkeys(query))
    tf = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"{query.count(t)} * ln((n - df{i} + 0.5e0) / (df{i} + 0.5e0) + 1) * (tf{i} * 2.5e0 / (tf{i} + 1.5e0 * (0.25e0 + 0.75e0 * len / avgdl)))" for i, t in enumerate(terms))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    top = f"ORDER BY raw DESC, key LIMIT {limit}" if limit is not None else ""
    return f"""WITH d AS (SELECT doc_id AS key, {_tokens.format("text")} AS toks FROM documents), c AS (SELECT key, len(toks) AS len, {tf} FROM d),
      t AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS avgdl, {df} FROM c), s AS (SELECT key, {score} AS raw FROM c, t WHERE {hit} {top}) SELECT key, round(raw, 3) AS score FROM s"""


_slug0 = "ltrim(lower(regexp_replace({}, '[^A-Za-z0-9]+', '-', 'g')), '-')"


def slug_sql(column: str) -> str:
    s = _slug0.format(column)
    return f"rtrim(CASE WHEN substr({s}, 40, 1) = '-' THEN substr({s}, 1, 41) ELSE substr({s}, 1, 40) END, '-')"


PAGES = """pg AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://arxiv.org/abs/2401.01234' WHEN 1 THEN 'https://www.cdc.gov/x' WHEN 2 THEN 'https://lab.stanford.edu/p.pdf' WHEN 3 THEN 'http://www.bioRxiv.org/content' WHEN 4 THEN 'file:///local/x' ELSE url END AS url,
  html || CASE WHEN page_id % 3 = 0 THEN ' doi: 10.1234/ABC.' || page_id || '. ' ELSE '' END || CASE WHEN page_id % 4 = 0 THEN ' PMID: 1234567 and PMC7654321 ' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN ' Abstract. Received: May, Smith et al. ' ELSE '' END
  || CASE WHEN page_id % 11 = 0 THEN ' medRxiv ISBN 978-3-16-148410-0 arXiv:2101.00001 ' ELSE '' END AS body FROM pages),
ids AS (SELECT *, url || '  ' || body AS probe, CASE WHEN regexp_matches(url, '^https?://') THEN lower(regexp_extract(url, '^https?://([^/]*)', 1)) END AS host FROM pg),
found AS (SELECT *, regexp_replace(nullif(lower(regexp_extract(probe, '(?i)\\b(10\\.[0-9]{4,9}/[-._;()/:a-z0-9]+)\\b', 1)), ''), '\\.$', '') AS doi,
  coalesce(nullif(regexp_extract(probe, '(?i)arxiv:([0-9]{4}\\.[0-9]{4,5})|arxiv\\.org/(?:abs|pdf)/([0-9]{4}\\.[0-9]{4,5})', 1), ''), nullif(regexp_extract(probe, '(?i)arxiv:([0-9]{4}\\.[0-9]{4,5})|arxiv\\.org/(?:abs|pdf)/([0-9]{4}\\.[0-9]{4,5})', 2), '')) AS arxiv,
  nullif(regexp_extract(probe, '(?i)\\bpmid[:\\s]\\s*([0-9]{6,9})\\b', 1), '') AS pmid, 'PMC' || nullif(regexp_extract(probe, '(?i)\\bPMC([0-9]{5,9})\\b', 1), '') AS pmcid,
  nullif(regexp_extract(probe, '(?i)\\bISBN(?:-1[03])?:?\\s*(97[89][- ]?(?:[0-9][- ]?){9}[0-9]|(?:[0-9][- ]?){9}[0-9X])\\b', 1), '') AS isbn FROM ids)"""


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _hosts(hosts: list[str]) -> str:
    return "(" + " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in hosts) + ")"


_markers = " + ".join(f"CAST(contains(lower(body), '{w}') AS INT)" for w in T.JOURNAL_WORDS)
CLASSIFY = f"""WITH {PAGES}, m AS (SELECT *, {_markers} AS markers, {_any("lower(body)", T.PREPRINT_WORDS)} AS pre FROM found),
v AS (SELECT *, CASE WHEN pre AND (doi IS NOT NULL OR markers >= 1) THEN 'preprint' WHEN doi IS NOT NULL AND markers >= 2 THEN 'journal_article' END AS text_type,
  CASE WHEN {_hosts(T.PREPRINT_HOSTS)} THEN 'preprint' WHEN ends_with(host, '.gov') OR ends_with(host, '.edu') OR {_hosts(T.GRAY_HOSTS)} THEN 'gov_report' WHEN host IS NOT NULL THEN 'web_page' END AS host_type FROM m),
w AS (SELECT *, CASE WHEN host_type IN ('preprint', 'gov_report') THEN host_type WHEN text_type IS NOT NULL THEN text_type ELSE 'web_page' END AS source_type FROM v)
SELECT page_id, source_type, CASE source_type WHEN 'preprint' THEN 'preprint' WHEN 'gov_report' THEN 'gray_lit' WHEN 'journal_article' THEN 'peer_reviewed' ELSE 'web' END AS tier,
  CASE WHEN source_type = 'preprint' AND host_type = 'preprint' THEN 0.9e0 WHEN source_type = 'gov_report' THEN 0.8e0 WHEN source_type = 'preprint' THEN 0.7e0 WHEN source_type = 'journal_article' THEN 0.72e0 WHEN host_type = 'web_page' THEN 0.6e0 ELSE 0.5e0 END AS confidence FROM w"""

HISTORY = "h AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS commit, event_type AS kind, ts AS moment, 'user ' || user_id AS summary, props AS delta, user_id, value FROM events)"
#: White space, as an expression.
_WHITE = " || ".join(f"chr({ord(c)})" for c in T.WHITE)
_strip = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*(?:>|\\z)', '', 'g'), '>', ''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '\n{{3,}}', '\n\n', 'g'), " + _WHITE + ")"

_RANK = "CASE a.knowledge_level " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(vocab.KNOWLEDGE_LEVELS)) + f" ELSE {len(vocab.KNOWLEDGE_LEVELS) + 1} END"
_HARD = f"CAST(NOT pred_valid AS INT) + CAST(knowledge_level IS NULL AS INT) + CAST(coalesce(knowledge_level NOT IN ({Q(vocab.KNOWLEDGE_LEVELS)}), false) AS INT) + CAST(agent_type IS NULL AS INT) + CAST(coalesce(agent_type NOT IN ({Q(vocab.AGENT_TYPES)}), false) AS INT) + CAST(primary_source IS NULL AS INT)"
_SNIPPET = """CASE WHEN start > 1 THEN '…' ELSE '' END || regexp_replace(trim(substr(text, start, 160)), '\\s+', ' ', 'g') || CASE WHEN start + 159 < length(text) THEN '…' ELSE '' END"""


def search_nodes_sql(terms: list[str], limit: int) -> str:
    found = ", ".join(f"nullif(instr(lower(text), '{t}'), 0)" for t in terms)
    tf = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln((n - df{i} + 0.5e0) / (df{i} + 0.5e0) + 1) * (tf{i} * 2.5e0 / (tf{i} + 1.5e0 * (0.25e0 + 0.75e0 * len / avgdl)))" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return nodes_sql(f""", d AS (SELECT identifier, node_type, file_ord, concat_ws(' ', identifier, subtype, description) AS text FROM n), k AS (SELECT *, {_tokens.format("text")} AS toks FROM d), c AS (SELECT *, len(toks) AS len, {tf} FROM k),
      t AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS avgdl, {df} FROM c), s AS (SELECT identifier, node_type, text, {score} AS raw FROM c, t WHERE {hit} ORDER BY raw DESC, file_ord LIMIT {limit}),
      p AS (SELECT *, greatest(coalesce(least({found}), 1) - 40, 1) AS start FROM s) SELECT identifier, node_type, round(raw, 3) AS score, {_SNIPPET} AS snippet FROM p""")


_cells = """list_transform(regexp_extract_all(',' || {}, ',((?:[^,"]|"(?:[^"]|"")*(?:"|$))*)', 1), lambda c: replace(trim(replace(regexp_replace(c, '"((?:[^"]|"")*)(?:"|$)', '\\1', 'g'), '""', '"'), {white}), '|', '\\|'))"""
_row = "'| ' || array_to_string(" + _cells + ", ' | ') || ' |' || chr(10)"
_generated = "regexp_full_match(replace(trim({0}), '-', ''), '[0-9a-fA-F]{{12,}}')"

SQL: dict[str, str] = {
    "type_alias": nodes_sql("SELECT DISTINCT raw_type, node_type, type_valid, is_provenance, family FROM n"),
    "scan_first_wins": nodes_sql("SELECT identifier, min(file_ord) AS file_ord FROM n GROUP BY identifier"),
    "predicate_alias": edges_sql("SELECT raw_predicate, predicate, base, reversed, negative, negated, pred_valid, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL"),
    "get_node": nodes_sql("SELECT identifier, node_type, subtype, path FROM n WHERE identifier = 'Part 96' ORDER BY file_ord LIMIT 1"),
    "subtype_coalesce": nodes_sql("SELECT identifier, coalesce(subtype, note, 'none') AS subtype FROM n"),
    "kb_id_rule": "SELECT s_suppkey, regexp_full_match(k, '[a-z0-9]+(-[a-z0-9]+)*') AND length(k) <= 64 AS ok FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE lower(replace(s_name, '#', '-')) END AS k FROM supplier)",
    "resolve_objects": both_sql("SELECT predicate, coalesce(t.node_type, 'External') AS object_type, CAST(count(*) AS BIGINT) AS n FROM e LEFT JOIN types t ON e.object = t.identifier GROUP BY ALL", TYPES),
    "source_resolution": both_sql(f"SELECT CASE WHEN t.identifier IS NULL THEN 'unresolved' WHEN t.is_provenance THEN 'ok' ELSE 'not_source' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM e LEFT JOIN types t ON e.primary_source = t.identifier WHERE {_named} GROUP BY ALL", TYPES),
    "cited_source_chain": both_sql("SELECT * FROM cited", SOURCES, PATHS, CITED),
    "lint_source_not_scholarly": SOURCE_LINT["source.not_scholarly"],
    "lint_source_retracted": SOURCE_LINT["source.retracted"],
    "lint_source_raw_missing_file": SOURCE_LINT["source.raw_missing_file"],
    "index_substring_anti": nodes_sql(f"SELECT DISTINCT identifier FROM n, {INDEX} i WHERE NOT contains(text, identifier)"),
    "stats_by_type": nodes_sql("SELECT node_type, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY node_type"),
    "stats_by_predicate": edges_sql("SELECT predicate, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY predicate"),
    "stats_totals": both_sql("SELECT 'nodes' AS what, CAST(count(*) AS BIGINT) AS n FROM n UNION ALL SELECT 'edges', CAST(count(*) AS BIGINT) FROM e"),
    "catalog_by_type": nodes_sql("SELECT node_type, CAST(count(*) AS BIGINT) AS n, min(identifier) AS first_id, max(identifier) AS last_id FROM n GROUP BY node_type"),
    "members_by_type": nodes_sql("SELECT node_type, identifier, trim(substr(translate(coalesce(description, note, ''), chr(10) || '|', '  '), 1, 80)) AS shown FROM n"),
    "subtypes_in_use": nodes_sql("SELECT DISTINCT node_type, subtype FROM n WHERE subtype IS NOT NULL"),
    "graph_edges": both_sql("SELECT source, target, predicate, synthesized, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY ALL", GRAPH),
    "graph_nodes": both_sql("SELECT * FROM gn", GRAPH),
    "degree": both_sql("SELECT identifier, CAST(degree AS BIGINT) AS degree FROM deg", GRAPH),
    "orphans": both_sql("SELECT identifier, node_type FROM gn WHERE NOT external AND degree = 0", GRAPH),
    "adjacency": edges_sql("SELECT identifier, neighbor, predicate, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN reversed THEN object ELSE subject END AS identifier, CASE WHEN reversed THEN subject ELSE object END AS neighbor, predicate FROM e UNION ALL SELECT CASE WHEN reversed THEN subject ELSE object END, CASE WHEN reversed THEN object ELSE subject END, predicate FROM e) GROUP BY ALL"),
    "neighbors": edges_sql("SELECT CASE WHEN subject = 'Part 7' THEN object ELSE subject END AS neighbor, CAST(count(*) AS BIGINT) AS n FROM e WHERE subject = 'Part 7' OR object = 'Part 7' GROUP BY 1"),
    "node_panel": both_sql("SELECT direction, predicate, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'out' AS direction, predicate FROM g WHERE source = 'Supplier 3' UNION ALL SELECT 'in', predicate FROM g WHERE target = 'Supplier 3') GROUP BY ALL", GRAPH),
    "two_hop_pattern": edges_sql("SELECT a.subject AS start, b.object AS finish, CAST(count(*) AS BIGINT) AS n_paths, arg_min(a.knowledge_level, " + _RANK + ") AS level FROM e a JOIN e b ON a.object = b.subject AND a.predicate = 'located_in' AND b.predicate = 'part_of' GROUP BY ALL"),
    "reachability": edges_sql(", RECURSIVE_DUMMY AS (SELECT 1) SELECT 1"),
    "edge_ordinals": edges_sql("SELECT subject, CAST(count(*) AS BIGINT) AS n, CAST(max(edge_ord) AS BIGINT) AS last_ord FROM (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY raw_predicate, object) AS edge_ord FROM e) GROUP BY subject"),
    "tokenize": f"SELECT doc_id, CAST(len({_tokens.format('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_tokens.format('text')})) AS BIGINT) AS n_terms FROM documents",
    "slug": f"SELECT doc_id, {slug_sql('text')} AS slug FROM documents",
    "commit_slug": f"SELECT doc_id, {slug_sql('substr(text, 1, 40)')} AS slug FROM documents",
    "kb_id": "SELECT s_suppkey, coalesce(nullif(trim(lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '-', 'g')), '-'), ''), 'base') AS kb_id FROM supplier",
    "sha_id": f"SELECT doc_id, CASE WHEN {slug_sql('text')} = '' THEN 'source' ELSE {slug_sql('text')} END || '-' || substr(sha256(text), 1, 6) AS source_id FROM documents",
    "slug_whole": f"SELECT doc_id, {slug_sql('text')} AS slug FROM documents",
    "sha_id_whole": f"SELECT doc_id, CASE WHEN {slug_sql('text')} = '' THEN 'source' ELSE {slug_sql('text')} END || '-' || substr(sha256(text), 1, 6) AS source_id FROM documents",
    "bm25_stats": f"WITH p AS (SELECT doc_id, unnest({_tokens.format('text')}) AS term FROM documents) SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf FROM p GROUP BY term",
    "bm25_topk": bm25_sql(["the", "license", "of", "the"], 10),
    "bm25_scores": bm25_sql(["the", "license", "apache"], None),
    "url_host": f"WITH {PAGES} SELECT page_id, host FROM ids",
    "bib_ids": f"WITH {PAGES} SELECT page_id, doi, arxiv, pmid, pmcid, isbn FROM found",
    "classify_source": CLASSIFY,
    "allowlist": f"SELECT c_custkey, {_any('lower(p)', T.PUBLISHERS)} AS ok FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Springer ' || c_name WHEN 1 THEN 'PLOS' ELSE c_mktsegment END AS p FROM customer)",
    "strip_markup": f"SELECT page_id, {_strip.format('html')} AS text FROM pages",
    "url_ext": "SELECT page_id, CASE WHEN length(x) BETWEEN 1 AND 5 THEN x WHEN page_id % 3 = 0 THEN 'json' WHEN page_id % 3 = 1 THEN 'txt' ELSE 'html' END AS ext FROM (SELECT page_id, regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '[^/.][^/]*\\.([^./]*)$', 1) AS x FROM pages)",
    "ingest_dedup": f"WITH {SOURCES}, f AS (SELECT sha256, min(doc_id) AS first_ord FROM src WHERE doc_id % 2 = 1 GROUP BY sha256), o AS (SELECT sha256, min(id) AS existing_id FROM src WHERE doc_id % 2 = 0 GROUP BY sha256) SELECT s.doc_id, o.existing_id, CASE WHEN o.existing_id IS NOT NULL THEN 'reused' WHEN s.doc_id > f.first_ord THEN 'repeated' ELSE 'stored' END AS action FROM src s JOIN f USING (sha256) LEFT JOIN o USING (sha256) WHERE doc_id % 2 = 1",
    "url_then_sha_dedup": f"WITH {PAGES}, p AS (SELECT page_id, url, sha256(body) AS sha FROM pg), x AS (SELECT * FROM p WHERE page_id % 2 = 0), u AS (SELECT url, min(page_id) AS by_url FROM x GROUP BY url), s AS (SELECT sha, min(page_id) AS by_sha FROM x GROUP BY sha) SELECT p.page_id, coalesce(u.by_url, s.by_sha) AS reused_id FROM p LEFT JOIN u USING (url) LEFT JOIN s USING (sha) WHERE p.page_id % 2 = 1",
    "primary_doc": "SELECT source AS folder, doc_id AS ord, n_chars AS length FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents) WHERE r = 1",
    "combined_concat": "SELECT conv_id AS batch, string_agg('# ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS markdown, bool_or(role = 'system') AS needs_llm FROM conversations GROUP BY conv_id",
    "merge_raw": f"""WITH {SOURCES}, main AS (SELECT DISTINCT id, sha256 FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'doc-' || (doc_id + 1) || '-2' ELSE 'doc-' || (doc_id + 1) END AS id, sha256 FROM src WHERE doc_id % 2 = 0)), other AS (SELECT id, sha256 FROM src WHERE doc_id % 2 = 1),
      b AS (SELECT sha256, max(id) AS same_id FROM main GROUP BY sha256),
      p AS (SELECT o.id, same_id, CASE WHEN same_id IS NOT NULL THEN 'dropped' WHEN o.id IN (SELECT id FROM main) THEN 'renamed' ELSE 'moved' END AS action FROM other o LEFT JOIN b USING (sha256)),
      taken AS (SELECT regexp_extract(id, '^(.*)-[0-9]+$', 1) AS id, CAST(regexp_extract(id, '-([0-9]+)$', 1) AS BIGINT) AS n FROM (SELECT id FROM main UNION SELECT id FROM p WHERE action = 'moved') WHERE regexp_full_match(id, '.*-[0-9]+')),
      tried AS (SELECT id, 2 AS n FROM p WHERE action = 'renamed' UNION SELECT id, n + 1 FROM taken WHERE n >= 2),
      free AS (SELECT id, min(n) AS n FROM tried t WHERE NOT EXISTS (SELECT 1 FROM taken x WHERE x.id = t.id AND x.n = t.n) GROUP BY id)
      SELECT p.id, CASE action WHEN 'dropped' THEN same_id WHEN 'renamed' THEN p.id || '-' || free.n ELSE p.id END AS final_id, action FROM p LEFT JOIN free ON free.id = p.id""",
    "snapshot_diff": nodes_sql("""SELECT identifier, CASE WHEN p2 IS NULL THEN 'removed' ELSE 'moved' END AS issue FROM (SELECT identifier, max(path) AS path FROM n GROUP BY identifier) a LEFT JOIN
      (SELECT identifier, max(CASE WHEN node_type = 'Gene' THEN 'moved/' || path ELSE path END) AS p2 FROM n WHERE node_type <> 'Disease' GROUP BY identifier) b USING (identifier) WHERE p2 IS NULL OR p2 <> path"""),
    "carry_over": nodes_sql("SELECT identifier, 'main' AS base FROM n WHERE family = 'clinical' UNION ALL SELECT identifier, 'other' FROM n WHERE node_type <> 'Study' AND identifier NOT IN (SELECT identifier FROM n WHERE family = 'clinical')"),
    "collapse_references": edges_sql("SELECT CASE WHEN object IN ('Part 1', 'Part 2') THEN 'Part 3' ELSE object END AS object, CASE WHEN primary_source IN ('Part 1', 'Part 2') THEN 'Part 3' ELSE primary_source END AS primary_source, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL"),
    "log_newest": f"WITH {HISTORY} SELECT commit, kind, summary FROM h ORDER BY moment DESC, commit LIMIT 20",
    "restore_asof": f"WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment DESC, commit DESC) AS k FROM h WHERE moment <= TIMESTAMP '2024-01-15 00:00:00') SELECT user_id, commit, kind, value FROM r WHERE k = 1",
    "change_log_by_day": f"WITH {HISTORY} SELECT strftime(moment, '%Y-%m-%d') AS day, kind, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY ALL",
    "squash": f"WITH {HISTORY} SELECT kind, CAST(count(*) AS BIGINT) AS n, min(moment) AS first_at, max(moment) AS last_at FROM h GROUP BY kind",
    "knowledge_rank": edges_sql("SELECT knowledge_level, CAST(count(*) AS BIGINT) AS n, CAST(CASE knowledge_level " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(vocab.KNOWLEDGE_LEVELS)) + " ELSE 0 END AS BIGINT) AS rank FROM e GROUP BY ALL"),
    "coverage": "SELECT doc_id, CASE WHEN len(w) >= 50 THEN CAST(len(list_filter(w, lambda x: contains(md, x))) AS DOUBLE) / len(w) END AS share FROM (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: lower(x)), lambda x: length(x) >= 5)) AS w, lower(html) AS md FROM documents LEFT JOIN pages ON page_id = doc_id)",
    "coverage_whole": f"SELECT doc_id, CASE WHEN len(w) >= 50 THEN CAST(len(list_filter(w, lambda x: contains(md, x))) AS DOUBLE) / len(w) END AS share FROM (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: lower(x)), lambda x: length(x) >= 5)) AS w, lower({_strip.format('text')}) AS md FROM documents)",
    "title_from": f"""WITH m AS (SELECT doc_id, list_transform(regexp_split_to_array(CASE WHEN doc_id % 3 = 0 THEN '## Heading ' || doc_id || chr(10) ELSE '' END || text, '\\r?\\n'), lambda x: trim(x)) AS lines FROM documents)
      SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN 'given title' END, list_filter(list_transform(list_filter(lines, lambda x: starts_with(x, '#')), lambda x: trim(ltrim(x, '#'))), lambda h: h <> '' AND NOT {_generated.format("h")})[1],
        substr(list_filter(lines, lambda x: strlen(x) >= 8 AND NOT {_generated.format("x")})[1], 1, 80), 'some file name') AS title FROM m""",
    "csv_table": f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array('name,"a ""quoted"" | cell", x' || chr(10) || replace(text, ' ', ','), '\\r?\\n'), lambda x: trim(x, {_WHITE}) <> '') AS lines FROM documents)
      SELECT doc_id, {_row.format("lines[1]", white=_WHITE)} || '|' || repeat(' --- |', len({_cells.format("lines[1]", white=_WHITE)})) || chr(10) || array_to_string(list_transform(lines[2:501], lambda x: {_row.format("x", white=_WHITE)}), '')
        || CASE WHEN len(lines) > 501 THEN chr(10) || '_(truncated at 500 rows)_' || chr(10) ELSE '' END AS markdown FROM t""",
    "graph_json": both_sql("SELECT CAST(to_json({'kind': 'node', 'identifier': identifier, 'node_type': node_type, 'family': family, 'external': external, 'degree': degree}) AS VARCHAR) AS json FROM gn UNION ALL SELECT CAST(to_json({'kind': 'edge', 'source': source, 'target': target, 'predicate': predicate, 'synthesized': synthesized}) AS VARCHAR) FROM g", GRAPH),
    "bm25_index": bm25_sql(["the", "license", "apache"], None),
    "search_nodes": search_nodes_sql(["building", "steel", "7", "brand"], 50),
    "folder_groups": """WITH m AS (SELECT doc_id AS ord, CASE WHEN doc_id % 2 = 0 THEN source ELSE CAST(doc_id AS VARCHAR) END AS folder, doc_id % 7 = 0 AS image, n_chars FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY folder, image ORDER BY n_chars DESC, ord DESC) AS nth, bool_or(NOT image) OVER (PARTITION BY folder) AS has_doc FROM m)
      SELECT ord, CASE WHEN image AND has_doc THEN 'figure' WHEN image THEN 'image' WHEN nth = 1 THEN 'primary' ELSE 'document' END AS role FROM r""",
    "restore_forward": f"""WITH {HISTORY}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment DESC, commit DESC) AS k FROM h WHERE moment <= TIMESTAMP '2024-01-15 00:00:00'), w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment DESC, commit DESC) AS k FROM h)
      SELECT w.user_id, 'back' AS commit, CASE WHEN o.commit IS NULL THEN 'remove' ELSE 'restore' END AS kind, o.value, o.summary FROM w LEFT JOIN o ON o.user_id = w.user_id AND o.k = 1 WHERE w.k = 1 AND w.commit IS DISTINCT FROM o.commit""",
    "restore_removed": f"""WITH {HISTORY}, v AS (SELECT * REPLACE (CASE kind WHEN 'error' THEN 'remove' ELSE kind END AS kind) FROM h), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment DESC, commit DESC) AS k FROM v WHERE moment <= TIMESTAMP '2024-01-15 00:00:00'), w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment DESC, commit DESC) AS k FROM v),
      b AS (SELECT w.user_id, w.kind AS now, o.commit IS NULL OR o.kind = 'remove' AS absent, o.value, o.summary FROM w LEFT JOIN o ON o.user_id = w.user_id AND o.k = 1 WHERE w.k = 1 AND w.commit IS DISTINCT FROM o.commit)
      SELECT user_id, 'back' AS commit, CASE WHEN absent THEN 'remove' ELSE 'restore' END AS kind, CASE WHEN NOT absent THEN value END AS value, CASE WHEN NOT absent THEN summary END AS summary FROM b WHERE NOT (absent AND now = 'remove')""",
    "harmonised_subtypes": nodes_sql("""SELECT node_type, CASE WHEN subtype IS NOT NULL THEN best END AS subtype, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, first_value(subtype) OVER (PARTITION BY node_type, lower(regexp_replace(subtype, '[^A-Za-z0-9]', '', 'g')) ORDER BY many DESC, subtype) AS best FROM (SELECT *, count(*) OVER (PARTITION BY node_type, subtype) AS many FROM n)) GROUP BY ALL"""),
    "index_rows": nodes_sql("""SELECT 1 AS section, identifier || chr(9) || file_ord AS ord, '| ' || replace(identifier, '|', '\\|') || ' | ' || node_type || ' | ' || replace(coalesce(subtype, ''), '|', '\\|') || ' | ' || trim(substr(translate(coalesce(description, note, ''), chr(10) || '|', '  '), 1, 80)) || ' |' AS line FROM n
      UNION ALL SELECT 2, node_type, '- **' || node_type || '** (' || count(*) || '): ' || string_agg(identifier, ', ' ORDER BY identifier) FROM n GROUP BY node_type
      UNION ALL SELECT 3, node_type, '- **' || node_type || '**: ' || string_agg(subtype, ', ' ORDER BY subtype) FROM (SELECT DISTINCT node_type, subtype FROM n WHERE subtype IS NOT NULL) GROUP BY node_type"""),
    "validate": both_sql(f"""SELECT path, identifier, coalesce(ec, 0) AS edge_count, CAST(coalesce(eh, 0) + CAST(NOT type_valid AS INT) AS BIGINT) AS hard, CAST(coalesce(es, 0) + CAST(contains(identifier, ':') AND NOT contains(identifier, ' ') AS INT) + CAST(subtype IS NULL AS INT) + CAST(is_provenance AND xref IS NULL AND raw_source IS NULL AS INT) AS BIGINT) AS soft,
      coalesce(eh, 0) + CAST(NOT type_valid AS INT) = 0 AS valid FROM n LEFT JOIN (SELECT subject, CAST(count(*) AS BIGINT) AS ec, sum({_HARD}) AS eh, sum(CAST(predicate IN ('regulates', 'expressed_in') AND direction IS NULL AS INT)) AS es FROM e GROUP BY subject) p ON p.subject = n.identifier"""),
}
SQL["reachability"] = f"""WITH RECURSIVE {EDGES}, o AS (SELECT DISTINCT CASE WHEN reversed THEN object ELSE subject END AS s, CASE WHEN reversed THEN subject ELSE object END AS t FROM e),
  r AS (SELECT 'Customer 5' AS identifier, 0 AS hops UNION SELECT o.t, r.hops + 1 FROM r JOIN o ON o.s = r.identifier WHERE r.hops < 4) SELECT identifier, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY identifier"""

#: Distances from a node over links o (s, t), without a bound.
_DISTANCES = """o AS (SELECT DISTINCT CASE WHEN reversed THEN object ELSE subject END AS s, CASE WHEN reversed THEN subject ELSE object END AS t, predicate FROM e),
  r(identifier, hops) USING KEY (identifier) AS (SELECT '{start}', 0 UNION SELECT o.t, min(r.hops + 1) FROM r JOIN o ON o.s = r.identifier LEFT JOIN recurring.r q ON q.identifier = o.t WHERE q.identifier IS NULL GROUP BY o.t)"""
SQL["reachability_unbounded"] = f"WITH RECURSIVE {EDGES}, {_DISTANCES.format(start='Customer 5')} SELECT identifier, CAST(hops AS INTEGER) AS hops FROM r"
SQL["shortest_paths"] = f"""WITH RECURSIVE {EDGES}, {_DISTANCES.format(start="Order 7")},
  p AS (SELECT b.identifier, b.hops, a.identifier AS parent, o.predicate, row_number() OVER (PARTITION BY b.identifier ORDER BY a.identifier, o.predicate) AS nth FROM o JOIN r a ON a.identifier = o.s JOIN r b ON b.identifier = o.t AND b.hops = a.hops + 1),
  w AS (SELECT 'Order 7' AS identifier, 0 AS hops, '' AS predicates, 'Order 7' AS nodes UNION ALL SELECT p.identifier, p.hops, w.predicates || CASE WHEN p.hops > 1 THEN ' > ' ELSE '' END || p.predicate, w.nodes || ' > ' || p.identifier FROM w JOIN p ON p.parent = w.identifier AND p.nth = 1)
  SELECT identifier, CAST(hops AS BIGINT) AS hops, predicates, nodes FROM w"""
_rank_of = "CASE {} " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(vocab.KNOWLEDGE_LEVELS)) + f" ELSE {len(vocab.KNOWLEDGE_LEVELS) + 1} END"
SQL["pattern_three_hops"] = both_sql(
    f"""SELECT start, finish, CAST(count(*) AS BIGINT) AS n_paths, [{Q(vocab.KNOWLEDGE_LEVELS)}][min(rank)] AS level FROM (
  SELECT a.s AS start, c.t AS finish, greatest({", ".join(_rank_of.format(f"{x}.knowledge_level") for x in "abc")}) AS rank
  FROM d a JOIN d b ON b.s = a.t JOIN d c ON c.s = b.t JOIN types ta ON ta.identifier = a.s JOIN types tb ON tb.identifier = a.t JOIN types tc ON tc.identifier = b.t
  WHERE a.predicate IN ('treats', 'not_treats') AND a.knowledge_level = 'knowledge_assertion' AND a.{_named} AND ta.node_type = 'Study' AND tb.node_type IN ('Disease', 'Phenotype', 'MethodOrProcedure')
    AND b.predicate = 'reported_in' AND tc.node_type = 'Agent' AND c.predicate = 'located_in') GROUP BY start, finish""".replace("a.primary_source IS NOT NULL AND primary_source", "a.primary_source IS NOT NULL AND a.primary_source"),
    TYPES,
    "d AS (SELECT CASE WHEN reversed THEN object ELSE subject END AS s, CASE WHEN reversed THEN subject ELSE object END AS t, predicate, knowledge_level, primary_source FROM e)",
)
#: Letters past ASCII as capitals, which keys lack: the engine counts edits in bytes.
_single = "translate({}, 'àâäçéèêëîïôöùûüñßáíóúœæ', 'ABCDEFGHIJKLMNOPQRSTUVW')"
SQL["similar_names"] = """WITH k AS (SELECT doc_id, array_to_string(string_split(trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')), ' ')[1:2], ' ') AS key FROM documents WHERE text IS NOT NULL),
  a AS (SELECT key, CAST(count(*) AS BIGINT) AS n FROM k WHERE doc_id % 2 = 0 AND key <> '' GROUP BY key), b AS (SELECT key, CAST(count(*) AS BIGINT) AS n FROM k WHERE doc_id % 2 = 1 AND key <> '' GROUP BY key),
  c AS (SELECT a.key AS main_key, b.key AS other_key, a.n AS n_main, b.n AS n_other, {distance} AS distance FROM a JOIN b ON a.key <> b.key AND abs(length(a.key) - length(b.key)) <= 2)
  SELECT main_key, other_key, CAST(distance AS INTEGER) AS distance, n_main, n_other FROM c WHERE distance <= 2""".replace("{distance}", f"levenshtein({_single.format('a.key')}, {_single.format('b.key')})")

MERGE = f"""{NODES},
mn AS (SELECT * FROM n WHERE node_type <> 'Study'), ot0 AS (SELECT * FROM n WHERE family = 'clinical' OR node_type = 'Study'),
mt AS (SELECT identifier, arg_min(node_type, file_ord) AS t FROM mn GROUP BY identifier), ot AS (SELECT identifier, arg_min(node_type, file_ord) AS t FROM ot0 GROUP BY identifier),
k AS (SELECT identifier, CAST(regexp_extract(identifier, '^Part ([0-9]+)$', 1) AS BIGINT) AS k FROM ot WHERE regexp_full_match(identifier, 'Part [0-9]+')),
matched AS (SELECT identifier AS old, 'Part ' || (k + d) AS new FROM k, (VALUES (0), (3)) v(d) WHERE k % 3 = 0 AND (d = 0 OR k % 30 <= 21)),
typed AS (SELECT DISTINCT 'a' || new AS a, 'b' || old AS b FROM matched JOIN mt ON mt.identifier = new JOIN ot ON ot.identifier = old WHERE mt.t = ot.t),
ways AS (SELECT a, b FROM typed UNION ALL SELECT b, a FROM typed),
reach AS (SELECT a AS node, a AS seen FROM ways UNION SELECT r.node, w.b FROM reach r JOIN ways w ON w.a = r.seen),
comp AS (SELECT node, substr(min(seen), 2) AS final FROM reach GROUP BY node),
mm AS (SELECT 'main' AS origin, identifier, coalesce(final, identifier) AS final, CASE WHEN final <> identifier THEN 'collapsed' ELSE 'kept' END AS action FROM mt LEFT JOIN comp ON node = 'a' || identifier
  UNION ALL SELECT 'other', identifier, coalesce(final, CASE WHEN identifier IN (SELECT identifier FROM mt) THEN identifier || ' (2)' ELSE identifier END), CASE WHEN final IS NOT NULL THEN 'collapsed' WHEN identifier IN (SELECT identifier FROM mt) THEN 'renamed' ELSE 'carried' END
  FROM ot LEFT JOIN comp ON node = 'b' || identifier),
mboth AS (SELECT u.*, mm.final FROM (SELECT 'main' AS origin, * FROM mn UNION ALL SELECT 'other', * FROM ot0) u JOIN mm ON mm.origin = u.origin AND mm.identifier = u.identifier)"""
_order = "(identifier <> final, origin, file_ord)"
_first = lambda c: f"arg_min({c}, {_order}) FILTER (WHERE {c} IS NOT NULL) AS {c}"
SQL["merge_map"] = f"WITH RECURSIVE {MERGE} SELECT * FROM mm"
SQL["merge_nodes"] = f"""WITH RECURSIVE {MERGE} SELECT final AS identifier, {", ".join(map(_first, ["node_type", "subtype", "note", "description"]))}, coalesce(string_agg(DISTINCT identifier, ',' ORDER BY identifier) FILTER (WHERE identifier <> final), '') AS also_known,
  string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, arg_min(path, {_order}) AS path FROM mboth GROUP BY final"""
SQL["merge_conflicts"] = f"""WITH RECURSIVE {MERGE}, v AS (SELECT DISTINCT final, origin, identifier, 'subtype' AS field, subtype AS value FROM mboth WHERE subtype IS NOT NULL UNION SELECT DISTINCT final, origin, identifier, 'description', description FROM mboth WHERE description IS NOT NULL)
  SELECT final AS identifier, field, value, origin, identifier AS source FROM v WHERE (final, field) IN (SELECT (final, field) FROM v GROUP BY final, field HAVING count(DISTINCT value) > 1)"""
_MERGED = f"""{MERGE}, {EDGES}, me AS (SELECT x.origin, coalesce(s.final, x.subject) AS subject, x.predicate, x.base, x.negative, coalesce(o.final, x.object) AS object FROM (SELECT CASE WHEN starts_with(subject, 'Order ') THEN 'other' ELSE 'main' END AS origin, * FROM e) x
  LEFT JOIN mm s ON s.origin = x.origin AND s.identifier = x.subject LEFT JOIN mm o ON o.origin = x.origin AND o.identifier = x.object)"""
SQL["merge_edges"] = f"WITH RECURSIVE {_MERGED} SELECT origin, predicate, object, CAST(count(*) AS BIGINT) AS n FROM me GROUP BY ALL"
_said = lambda negative, name: f"string_agg(DISTINCT origin, ',' ORDER BY origin) FILTER (WHERE {negative}) AS {name}"
SQL["merge_contradictions"] = f"WITH RECURSIVE {_MERGED} SELECT substr(subject, 1, 1) AS subject, base AS predicate, object, {_said('NOT negative', 'positive')}, {_said('negative', 'negative')} FROM me GROUP BY substr(subject, 1, 1), base, object HAVING bool_or(negative) AND bool_or(NOT negative)"
_early = "moment <= TIMESTAMP '2024-01-15 00:00:00'"
SQL["version_log"] = f"""WITH {HISTORY} SELECT CAST(version AS BIGINT) AS version, CAST(version - 1 AS BIGINT) AS parent, kind, summary, CAST(added AS BIGINT) AS added, CAST(removed AS BIGINT) AS removed FROM (
  SELECT 1 AS version, 'ingest' AS kind, 'first half' AS summary, count(*) AS added, 0 AS removed FROM h WHERE {_early} UNION ALL SELECT 2, 'edit', 'second half', count(*), 0 FROM h WHERE NOT {_early}
  UNION ALL SELECT 3, 'edit', 'no errors', 0, count(*) FROM h WHERE kind = 'error' UNION ALL SELECT 4, 'restore', 'version 2', NULL, NULL)"""
SQL["version_restored"] = f"WITH {HISTORY} SELECT kind, CAST(count(*) AS BIGINT) AS n, max(value) AS largest FROM h GROUP BY kind"


def _after_edits(sql: str) -> str:
    """A rule's SQL over the base without every fifth study, and what it says."""
    gone = "regexp_full_match({}, 'Order [0-9]*[05]')"
    kept = sql.replace("FROM raw_nodes)", f"FROM raw_nodes WHERE NOT {gone.format('identifier')})").replace("FROM raw_edges)", f"FROM raw_edges WHERE NOT {gone.format('subject')})")
    assert kept != sql
    return kept


SQL["lint_incremental"] = "SELECT severity, rule, CAST(count(*) AS BIGINT) AS n, min(subject) AS first_subject, max(concat_ws(' ', subject, detail)) AS last_finding FROM (" + " UNION ALL ".join(
    f"SELECT '{SEVERITY[name]}' AS severity, '{name}' AS rule, subject, CAST(detail AS VARCHAR) AS detail FROM ({_after_edits(sql)})" for name, sql in LINT.items()
) + ") GROUP BY severity, rule"
SQL["tree_diff"] = nodes_sql(""", b AS (SELECT path, identifier, sha256(concat_ws('|', node_type, coalesce(subtype, ''), coalesce(description, ''), CASE WHEN subtype IS NULL THEN path ELSE '' END)) AS sha, node_type FROM n),
  a AS (SELECT CASE node_type WHEN 'Gene' THEN 'moved/' WHEN 'Phenotype' THEN 'renamed/' ELSE '' END || path AS path, CASE node_type WHEN 'Phenotype' THEN 'New ' ELSE '' END || identifier AS identifier, CASE node_type WHEN 'MethodOrProcedure' THEN 'other ' ELSE '' END || sha AS sha FROM b WHERE node_type <> 'Disease'),
  gone AS (SELECT * FROM b WHERE path NOT IN (SELECT path FROM a)), came AS (SELECT * FROM a WHERE path NOT IN (SELECT path FROM b)),
  i AS (SELECT identifier, min(path) AS moved FROM came GROUP BY identifier), c AS (SELECT sha, min(path) AS renamed FROM came GROUP BY sha)
  SELECT path, CASE WHEN moved IS NOT NULL THEN 'moved' WHEN renamed IS NOT NULL THEN 'renamed' ELSE 'removed' END AS issue, coalesce(moved, renamed) AS new_path FROM gone LEFT JOIN i USING (identifier) LEFT JOIN c USING (sha)
  UNION ALL SELECT path, 'added', NULL FROM came WHERE identifier NOT IN (SELECT identifier FROM gone) AND sha NOT IN (SELECT sha FROM gone)
  UNION ALL SELECT a.path, 'changed', NULL FROM a JOIN b USING (path) WHERE a.sha <> b.sha OR a.identifier IS DISTINCT FROM b.identifier""")
