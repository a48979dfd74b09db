"""The registered queries: each applies an operator to its whole table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.bpe import encode_documents
from lakeloom.llm.common import table
from lakeloom.llm.decontamination import find_passages
from lakeloom.llm.near_dups import near_duplicates
from lakeloom.llm.packing import pack
from lakeloom.llm.periodic_runs import find_runs
from lakeloom.llm.pii import find_personal_data, fit
from lakeloom.llm.quality_ranking import fit_ranking, score_documents
from lakeloom.llm.quality_rules import apply_rules, fit_forest
from lakeloom.llm.sharding import assign_shards
from lakeloom.llm.spelling_variants import spelling_variants, word_counts
from lakeloom.llm.token_counts import token_counts
from lakeloom.llm.url_rules import judge_urls, place_rule
from lakeloom.llm.vector_graph import linked_vectors


def tokenizer_file(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


#: The rules of the URL query.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def held_out(id_col: str = "id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every section (line) of every document, boundary tokens by the majority rule.  Null and empty texts have one empty section; repeated rows repeat; an empty table gives none."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by the multilingual ranks, as digests, and of the bytes that they decode to.  Null and empty texts have no ids; repeated rows repeat; an empty table gives none."""
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op3_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more among all vectors and their components.  Null, zero and non-finite vectors link with nothing; equal vectors are linked; an empty table gives none."""
    return linked_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens.  A null or empty text is the end id alone; repeated rows are packed as often as they come; an empty table gives none."""
    files = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")
    return pack(table(spark, sf_dir, "documents"), *files, public_tokenizers.PATTERN, capacity=1024, end_id=2)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text by the patterns and the field, which is fitted on the documents' own matches.  Null and empty texts have none; repeated rows repeat; an empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, fit(docs))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and the verdict of rules and forest, which is fitted on all labels.  A null or empty text fails; repeated rows repeat; an empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_forest(docs, table(spark, sf_dir, "labels")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rule that fits each url, and its verdict; allow where none fits.  A null url has empty host and path; repeated rows repeat; an empty table gives none."""
    return judge_urls(table(spark, sf_dir, "pages"), [place_rule(v, p) for v, p in URL_RULES])


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a ranking fitted on the labels that are not held out.  Null and empty texts are scored as empty; repeated rows repeat; a null id is not held out; an empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    ranking = fit_ranking(docs, table(spark, sf_dir, "labels"), where=~held_out())
    return score_documents(docs, ranking).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents under five-word similarity of 0.85 or more.  Texts without words link with nothing; equal texts are linked; an empty table gives none."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, equal texts together.  Null texts are in the group of the empty ones; an empty table gives none."""
    return assign_shards(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text that lie in a ten-word window of a benchmark item, and these items.  Null and empty texts have none; repeated rows repeat; an empty table gives none."""
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of all rows; where ten divides crc32 of the id, the words from a place on that the crc gives repeat those of a period that it gives."""
    crc = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    chosen = docs.select("doc_id", "text", (F.floor(crc / 10)).alias("g"), F.when(crc % 10 == 0, words).alias("words"))
    at = chosen.withColumn("a", F.expr("g % nullif(size(words), 0)")).withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    repeated = F.expr("transform(words, (w, i) -> if(i < a, w, element_at(words, int(a + (i - a) % p + 1))))")
    return at.select("doc_id", F.when(F.size("words") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods or more of every whole text, after ``with_repeats``, and the text without what they repeat, as digests.  Null and empty texts have none; a null id changes nothing; repeated rows repeat; an empty table gives none."""
    found = find_runs(with_repeats(table(spark, sf_dir, "documents")), min_length=6, exponent=4)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def misspelt(doc_id, word: str) -> str:
    """The word without one code point, if 199 divides the crc32 of id and word; the crc says which."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    return word if h % 199 or doc_id is None else word[: h % len(word)] + word[h % len(word) + 1 :]


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of six code points and five occurrences, after ``misspelt``.  Null and empty texts have none; repeated rows count again; a null id changes nothing; an empty table gives none."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), min_chars=6, min_count=5, rewrite=misspelt), ratio=5)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_token_counts, op2_bpe, op3_vector_graph, op4_packing, op5_personal_data, op6_quality_rules, op7_url_filters, op8_quality_ranking, op9_near_dups, op10_sharding,
        op11_decontamination, op12_periodic_runs, op13_spelling_variants,
    )}


#: Word runs and url parts as DuckDB writes them.
_URL_SQL = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rule, rhost, rpath, rverdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block'))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM (SELECT p.*, r.rule, r.rverdict, row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule) DESC NULLS LAST) AS k
      FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
WHERE k = 1
"""


#: Windows are compared as their words with blanks between them; items of fewer than ten words are windows of their own width.
_PASSAGES_SQL = r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
known AS (
  SELECT DISTINCT item, least(10, len(words)) AS w, array_to_string(words[k : k + least(10, len(words)) - 1], ' ') AS win
  FROM (SELECT item, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS k FROM items WHERE len(words) > 0)),
widths AS (SELECT DISTINCT w FROM known),
found AS (
  SELECT t.r, t.k, t.w, known.item
  FROM (SELECT r, w, k, array_to_string(words[k : k + w - 1], ' ') AS win
        FROM (SELECT r, words, w, unnest(range(1, len(words) - w + 2)) AS k FROM lowered, widths WHERE len(words) >= w)) t
  JOIN known ON known.w = t.w AND known.win = t.win),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + w)) AS p FROM (SELECT DISTINCT r, k, w FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filters": _URL_SQL, "op11_decontamination": _PASSAGES_SQL}
