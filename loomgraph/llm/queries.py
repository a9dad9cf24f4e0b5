"""Queries over the operators of this subpackage, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_quotes, decontaminate, exact_dedup, line_dedup, ngram_join, packing, phrases, pii, quality, set_sketch, spelling, token_counts, token_files
from .common import documents


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(spark, f"{sf_dir}/documents.parquet")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.chat_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(documents(spark, sf_dir))
    counts = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_sketch.near_duplicates(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir), plant=True)).select("word", "form", "root", "n", "n_near", "form_n")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_files": op6_token_files,
    "op7_token_counts": op7_token_counts,
    "op8_personal_data": op8_personal_data,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
    "op11_minhash_near_dedup": op11_minhash_near_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_phrase_collocations": op13_phrase_collocations,
}

#: Characters that count as white space, and the alphabet, as SQL expressions.
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _components(k: int, percent: int, more: str = "") -> str:
    """Documents linked by the Jaccard similarity of their k-word shingles, and the smallest doc_id that each reaches."""
    words = _LOWER.format("coalesce(text, '')")
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({words}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
                                  ELSE list_distinct(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i : i + {k - 1}], ' '))) END AS grams FROM w),
        e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        u AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
        r AS (SELECT doc_id, doc_id AS seen FROM s UNION SELECT r.doc_id, u.y FROM r JOIN u ON r.seen = u.x),
        c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, component_id{more} FROM s JOIN c USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": _components(5, 75),
    "op11_minhash_near_dedup": _components(2, 80, ", doc_id = component_id AS kept"),
    "op13_phrase_collocations": f"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM d),
        w AS (SELECT lang, id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS pos FROM p),
        v AS (SELECT lang, w1, lead(w1) OVER (PARTITION BY id ORDER BY pos) AS w2, lead(w1, 2) OVER (PARTITION BY id ORDER BY pos) AS w3 FROM w),
        g AS (SELECT lang, 1 AS size, w1 AS phrase FROM v UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM v WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM v WHERE w3 IS NOT NULL),
        f AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM g GROUP BY lang, phrase),
        t AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
        o AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
        k AS (SELECT o.lang, o.phrase, o.f AS a, i.k, l.f AS l, r.f AS r, CAST(o.f AS HUGEINT) * o.f * 1000000 // (CAST(l.f AS HUGEINT) * r.f) AS score
              FROM o JOIN range(1, 3) AS i(k) ON i.k < o.size JOIN f l ON l.lang = o.lang AND l.phrase = array_to_string(o.ws[1 : i.k], ' ')
                     JOIN f r ON r.lang = o.lang AND r.phrase = array_to_string(o.ws[i.k + 1 :], ' ')),
        b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        x AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, f FROM o WHERE size = 3),
        m AS (SELECT lang, phrase, max(f) AS longer FROM x GROUP BY lang, phrase),
        q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase
              WHERE longer IS NULL OR 100 * longer < 50 * a)
        SELECT q.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM q JOIN t ON t.lang = q.lang WHERE rank <= 2000""",
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), {_SPACES}, '') AS norm FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS n FROM t)
        SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op10_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM l),
        d AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.*, d.key IS NOT NULL AND k.doc_id <> d.last_id AS gone FROM k LEFT JOIN d ON k.key = d.key)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}
