"""The queries of the ten operators, with production parameters over whole tables, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import ann, bpe, langid, linededup, media, neardup, packing, tokenfiles, toxicity, warc

VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), vocabulary())


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train_language_model(docs))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade_toxicity(docs, toxicity.train_toxicity_model(docs, table(spark, sf_dir, "labels")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.archive_histories(table(spark, sf_dir, "pages")).select(*kept)


def op6_block_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    deleted = F.aggregate("_runs_deleted", F.lit(0), lambda n, r: n + r["length"])
    runs = F.array_join(F.transform("_runs_deleted", lambda r: F.concat_ws("+", r["start"].cast("string"), r["length"].cast("string"))), " ")
    return out.select("doc_id", F.col("_lines").alias("n_lines"), deleted.alias("n_deleted"), runs.alias("deleted_runs"), "text")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read_token_files(tokenfiles.write_token_files(table(spark, sf_dir, "documents"), vocabulary())).drop("shard", "index")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.write_media(table(spark, sf_dir, "documents"))).drop("tensor_file")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_language_id, op3_packing, op4_toxicity, op5_warc, op6_block_ann, op7_line_dedup, op8_token_files, op9_near_duplicates, op10_media)}
ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
             d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
             f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM f""",
    "op6_block_ann": """
        WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, len(embedding) AS dim FROM embeddings WHERE embedding IS NOT NULL),
             g AS (SELECT vec_id FROM c GROUP BY vec_id, dim HAVING count(x) = dim AND bool_and(isfinite(x)) AND max(abs(x)) > 0),
             e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings JOIN g USING (vec_id)),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))) AS score
                   FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
             r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    # Equal lines in pairs; pairs at one distance of two documents that follow on each other are their maximal common runs.
    "op7_line_dedup": f"""
        WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE text IS NOT NULL AND text <> ''),
             l AS (SELECT doc_id, place, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS body FROM raw),
             n AS (SELECT *, CASE WHEN body <> '' THEN row_number() OVER (PARTITION BY doc_id, body <> '' ORDER BY place) - 1 END AS ln,
                          list_sum(list_transform(string_split_regex(body, '\\s+'), lambda w: 1 + strlen(w) // 12)) AS words FROM l),
             pairs AS (SELECT a.doc_id, a.ln, a.words, b.doc_id AS other, a.ln - b.ln AS apart FROM n a JOIN n b ON a.body = b.body AND (b.doc_id, b.ln) < (a.doc_id, a.ln) WHERE a.ln IS NOT NULL AND b.ln IS NOT NULL),
             islands AS (SELECT *, ln - row_number() OVER (PARTITION BY doc_id, other, apart ORDER BY ln) AS island FROM pairs),
             common AS (SELECT doc_id, min(ln) AS a, max(ln) AS b FROM islands GROUP BY doc_id, other, apart, island HAVING sum(words) >= {linededup.LEAST_WORDS}),
             copies AS (SELECT doc_id, ln, count(*) OVER (PARTITION BY body) AS n, row_number() OVER (PARTITION BY body ORDER BY doc_id, ln) AS copy FROM n WHERE ln IS NOT NULL),
             gone AS (SELECT doc_id, unnest(range(a, b + 1)) AS ln FROM common UNION SELECT doc_id, ln FROM copies WHERE n >= {linededup.OFTEN} AND copy > 1),
             runs AS (SELECT doc_id, min(ln) AS start, count(*) AS length FROM (SELECT doc_id, ln, ln - row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS g FROM gone) GROUP BY doc_id, g),
             said AS (SELECT doc_id, CAST(sum(length) AS INTEGER) AS n_deleted, string_agg(start || '+' || length, ' ' ORDER BY start) AS deleted_runs FROM runs GROUP BY doc_id),
             body AS (SELECT n.doc_id, CAST(count(n.ln) AS INTEGER) AS n_lines, coalesce(string_agg(n.line, chr(10) ORDER BY n.place) FILTER (gone.ln IS NULL), '') AS text
                      FROM n LEFT JOIN gone ON n.doc_id = gone.doc_id AND n.ln = gone.ln GROUP BY n.doc_id)
        SELECT d.doc_id, coalesce(body.n_lines, 0) AS n_lines, coalesce(said.n_deleted, 0) AS n_deleted, coalesce(said.deleted_runs, '') AS deleted_runs, coalesce(body.text, d.text) AS text
        FROM documents d LEFT JOIN body USING (doc_id) LEFT JOIN said USING (doc_id)""",
}
