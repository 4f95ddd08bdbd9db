"""Registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kpiscope.llm.ann import nearest
from kpiscope.llm.common import table
from kpiscope.llm.decontam import decontamination
from kpiscope.llm.html_extract import extract
from kpiscope.llm.license_scan import license_scan
from kpiscope.llm.packing import pack
from kpiscope.llm.pii import find_pii
from kpiscope.llm.quality import quality
from kpiscope.llm.reversed_search import search
from kpiscope.llm.simhash import near_duplicates
from kpiscope.llm.spelling import variants
from kpiscope.llm.toxicity import toxicity
from kpiscope.llm.url_filter import judge_urls
from kpiscope.llm.window_packing import pack_windows

URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SHINGLE_WORDS, MAX_BITS = 3, 3     # contract of the SimHash operator and of its pipeline stage


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), SHINGLE_WORDS, MAX_BITS)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op12_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def byte_tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_windows(table(spark, sf_dir, "documents"), byte_tokenizer_file())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_quality, op3_html_extraction, op4_packing,
                            op5_decontamination, op6_simhash, op7_toxicity, op8_pii, op9_license_scan,
                            op10_nearest_neighbours, op11_spelling_variants, op12_reversed_search,
                            op13_window_packing)}
_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

# the operators not listed hold models, hashes or tokenisers that SQL has not
ORACLE: dict[str, str] = {"op5_decontamination": f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT p.doc_id, p.i, p.size, v.item_id FROM places p JOIN windows v ON p.phrase = v.phrase AND p.size = v.size),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit
         FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM found) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(k.n_items, 0) AS n_items,
       sha256(coalesce(k.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN held k ON d.doc_id = k.doc_id""",
    "op12_reversed_search": f"""
WITH items AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
wanted AS (SELECT DISTINCT item_id, term FROM items),
docs AS (SELECT row_number() OVER () AS row_no, doc_id, {_TERMS} AS w FROM documents),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs WHERE len(w) > 0),
counts AS (
  SELECT row_no, doc_id, n, term, count(*) AS tf FROM (SELECT row_no, doc_id, len(w) AS n, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
           FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
impact AS (SELECT row_no, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS part
           FROM counts JOIN weight USING (term), totals),
scored AS (SELECT item_id, row_no, doc_id, CAST(sum(part) AS BIGINT) AS score
           FROM impact JOIN wanted USING (term) GROUP BY item_id, row_no, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10""",
    # crc32 as a sum (xor) over bytes: step is one byte's table, far[k] a byte followed by k others, start the initial value
    "op11_spelling_variants": r"""
WITH RECURSIVE bits AS (
  SELECT b, 0 AS k, b AS v FROM range(256) AS t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END FROM bits WHERE k < 8),
step AS (SELECT b, v FROM bits WHERE k = 8),
runs AS (
  SELECT key, run, octet_length(encode(key)) AS size, hex(encode(key)) AS hexed, count(*) AS n
  FROM (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key
        FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')),
                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents))
  WHERE length(run) >= 7 GROUP BY key, run),
longest AS (SELECT coalesce(max(size), 0) AS size FROM runs),
far AS (
  SELECT 0 AS k, b, v FROM step
  UNION ALL SELECT far.k + 1, far.b, xor(far.v >> 8, step.v) FROM far JOIN step ON step.b = far.v & 255, longest WHERE far.k < longest.size),
start AS (
  SELECT 0 AS k, CAST(4294967295 AS BIGINT) AS v
  UNION ALL SELECT start.k + 1, xor(start.v >> 8, step.v) FROM start JOIN step ON step.b = start.v & 255, longest WHERE start.k < longest.size),
bytes AS (
  SELECT key, size, size - 1 - i AS k, 16 * (instr('0123456789ABCDEF', substr(hexed, 2 * i + 1, 1)) - 1)
                                       + instr('0123456789ABCDEF', substr(hexed, 2 * i + 2, 1)) - 1 AS b
  FROM (SELECT key, size, hexed, CAST(unnest(range(size)) AS INTEGER) AS i FROM runs)),
summed AS (SELECT key, size, bit_xor(far.v) AS v FROM bytes JOIN far USING (k, b) GROUP BY key, size),
hashed AS (SELECT key, xor(xor(summed.v, start.v), CAST(4294967295 AS BIGINT)) AS h FROM summed JOIN start ON start.k = summed.size),
damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
              ELSE run END AS word, n
  FROM runs JOIN hashed USING (key)),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
          FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INTEGER) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
                row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
formed AS (
  SELECT w.word, CASE WHEN near_n >= 10 * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND place = 1),
climb AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM climb c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN climb c ON c.word = f.word JOIN formed r ON r.word = c.root AND r.form IS NULL"""}
