"""One query per operator, over its whole table and whole texts, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import ballkmeans, fingerprints, langid, lines, neardup, packing, pieces, private, quality, ranked, repeats, tokens, topk
from spoor.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401
from spoor.session import scratch_path


@query("op9_line_dedup", r"""WITH lined AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
  keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lined),
  common AS (SELECT k, max(doc_id) AS newest FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
  marked AS (SELECT doc_id, line, pos, newest IS NOT NULL AND newest <> doc_id AS gone FROM keyed LEFT JOIN common USING (k))
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id""")
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_digests(table(spark, sf, "documents"))


@query("op4_near_dedup")
def op4_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"))


@query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, sf, "documents"))


@query("op2_quality")
def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.predictions(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, measured in words and an end mark, in sequences of 512 to 4096."""
    return packing.pack(packing.word_lengths(table(spark, sf, "documents")))


@query("op1_topk_search", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op1_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    return topk.embedding_search(table(spark, sf, "embeddings"))


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprint_digests(table(spark, sf, "documents"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.languages_of(table(spark, sf, "documents"))


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    tokens.write_tokens(table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokens.read_tokens(spark, path)


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    rows = pieces.encoded(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
    return rows.select("doc_id", F.col("sizes")[0].alias("n_pieces"), "ids_crc32", "best_score", "scores", "sizes", "decodes",
                       "ways_crc32", "ways_decode")


@query("op13_ranked_search", r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
  t AS (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
  c AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY doc_id, term),
  s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
  w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY term, docs),
  q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * c.n * docs) // total))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN c USING (term), s GROUP BY item_id, doc_id),
  o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
  SELECT * FROM o WHERE rank <= 10""")
def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def _ball_oracle(rounds: int = 6) -> str:
    """The plain method, a step for every round."""
    steps = ["""WITH b AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  k AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label, p, e[p * (len(e) // 8) + 1:(p + 1) * (len(e) // 8)] AS v
    FROM b, range(8) t(p)),
  c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, v AS c FROM k
    WHERE vec_id IN (SELECT vec_id FROM b ORDER BY vec_id LIMIT 16))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT id, any_value(vec_id) AS vec_id, any_value(label) AS label, p, any_value(v) AS v,
    min((list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c))::BIGINT * 16 + j) AS best
    FROM k JOIN c{r} USING (p) GROUP BY id, p)""")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (SELECT p, best % 16 AS j, i, sum(v[i])::BIGINT AS s, count(*) AS n
    FROM (SELECT p, best, v, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY ALL),
  m{r} AS MATERIALIZED (SELECT p, j, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM s{r} GROUP BY p, j),
  c{r + 1} AS MATERIALIZED (SELECT p, j, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (p, j))""")
    return ",\n  ".join(steps) + f""",
  h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, j)) AS sha FROM c{rounds}),
  z AS (SELECT vec_id, any_value(label) AS label, string_agg('0' || substr('0123456789abcdef', (best % 16 + 1)::INT, 1), '' ORDER BY p) AS code,
    sum(best // 16)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
  SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256 FROM z, h"""


@query("op11_vector_codes", _ball_oracle())
def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return ballkmeans.compressed(table(spark, sf, "embeddings"))


@query("op12_pii")
def op12_pii(spark: SparkSession, sf: str) -> DataFrame:
    return private.private_digests(table(spark, sf, "documents"))
