"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import byte_cnn, decontam, gru_lm, line_crf, line_dedup, ngram_join, packing, secret_scan, token_store, warc
from palimpsest.llm.shared import read_table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.assess(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read_table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op5_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(read_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_ids(read_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_gru_lm": op5_gru_lm,
    "op6_line_dedup": op6_line_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontamination": op8_decontamination,
    "op9_token_ids": op9_token_ids,
    "op10_ngram_join": op10_ngram_join,
}

_SHINGLES = """SELECT {id}, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
 FROM (SELECT {id}, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {table})"""

_LINE_DEDUP = r"""WITH line AS (SELECT doc_id, unnest(range(len(l))) AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
 word AS (SELECT * FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
 first AS (SELECT line, arg_min(doc_id, (doc_id, no)) AS d, arg_min(no, (doc_id, no)) AS no, length(line) AS n FROM word GROUP BY line),
 long AS (SELECT *, least(2, n // 10) AS edits, n // 3 AS third FROM first WHERE n >= 10),
 -- Two edits leave one of three parts of the shorter line whole, so lines that share none need no comparison.
 near AS (SELECT DISTINCT CASE WHEN (a.d, a.no) < (b.d, b.no) THEN b.line ELSE a.line END AS line FROM long a JOIN long b
   ON b.n IN (a.n, a.n + 1, a.n + 2) AND a.line != b.line
   AND (starts_with(b.line, left(a.line, a.third)) OR ends_with(b.line, right(a.line, a.third)) OR contains(b.line, substr(a.line, a.third + 1, a.n - 2 * a.third)))
   AND levenshtein(a.line, b.line) <= a.edits),
 mark AS (SELECT word.*, (word.doc_id, word.no) > (first.d, first.no) AS again, near.line IS NOT NULL AS close FROM word JOIN first USING (line) LEFT JOIN near USING (line)),
 gone AS (SELECT * FROM mark WHERE again OR close)
 SELECT d.doc_id, len(string_split(d.text, chr(10))) AS n_lines, coalesce(g.n_exact, 0) AS n_exact, coalesce(g.n_near, 0) AS n_near, coalesce(k.text, '') AS text
 FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (again) AS n_exact, count(*) FILTER (NOT again) AS n_near FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
 LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text FROM line ANTI JOIN gone USING (doc_id, no) GROUP BY doc_id) k ON k.doc_id = d.doc_id"""

_DECONTAMINATION = f"""WITH i AS ({_SHINGLES.format(id="item_id", table="benchmark")}), d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
 x AS (SELECT item_id, unnest(s) AS g, len(s) AS n_item FROM i), y AS (SELECT doc_id, unnest(s) AS g FROM d)
 SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item)::BIGINT AS n_item, count(*) / any_value(n_item)::DOUBLE AS containment
 FROM x JOIN y USING (g) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)"""

_NGRAM_JOIN = f"""WITH RECURSIVE d AS ({_SHINGLES.format(id="doc_id", table="documents")}), y AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM d),
 pair AS (SELECT a.doc_id AS a, b.doc_id AS b FROM y a JOIN y b USING (g) WHERE a.doc_id != b.doc_id
   GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a)
 SELECT doc_id, min(b) AS class_id, (SELECT count(*) FROM pair WHERE pair.a = doc_id) AS n_links FROM documents JOIN reach ON reach.a = doc_id GROUP BY doc_id"""

#: The other operators' results (model scores, archives, tokenizer ids, spans) have no SQL form; tests/llm has brute force for them.
ORACLES: dict[str, str] = {
    "op6_line_dedup": _LINE_DEDUP,
    "op8_decontamination": _DECONTAMINATION,
    "op10_ngram_join": _NGRAM_JOIN,
}
