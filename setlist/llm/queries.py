"""Registered queries of the package, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlist.llm import decontaminate, embedding_dedup, exact_dedup, language_id, license_scan, secret_scan, simhash, sp_sampling, token_alignment, token_counts, toxicity, url_filter, vector_codes
from setlist.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the sampled segmentations, of which the operator returns the ids themselves, and of what these decode to."""
    path = tokenizer_path("piece_bpe_32k.model")
    found = sp_sampling.decode(sp_sampling.encode(table(spark, sf_dir, "documents"), path), path)
    return found.select("doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_probability", "log_inclusion", F.sha2("text", 256).alias("decoded_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(secret_scan.span_names(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_names(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.languages_of(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-level vocabulary is read from its file of ranks, which gives the tokens of byte_bpe_50k.json."""
    import public_tokenizers

    return token_alignment.alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokenizer_path("piece_bpe_32k.model"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_sentencepiece, op4_url_filter, op5_secret_scan, op6_token_counts, op7_license_scan, op8_language_id, op9_decontaminate, op10_simhash, op11_vector_codes, op12_token_alignment, op13_embedding_dedup)}

_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER},'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The others learn, sample or hash in ways that SQL can't express; tests hold them against brute force.
ORACLE_SQL = {
    "op2_exact_dedup": f"""SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "op9_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
 bw AS (SELECT item_id, least(13,len(w)) AS n, array_to_string(list_slice(w,i,i+least(13,len(w))-1),' ') AS win FROM (SELECT item_id, w, unnest(range(1,greatest(len(w)-13,0)+2)) AS i FROM b WHERE len(w)>0)),
 dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w,i,i+n-1),' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1,len(w)-n+2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w)>=n)),
 h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, win)),
 p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i,i+n)) AS q FROM h) GROUP BY 1),
 m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id,',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0)>0 AND 20*coalesce(n_hit,0)>=len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)""",
}

_NUMBERS = "embedding IS NOT NULL AND len(embedding)>0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0"
_NEAREST = "(SELECT vec_id, part, min(d*64+e)%64 AS e, min(d*64+e)//64 AS d FROM (SELECT p.vec_id, p.part, c.e, sum((p.x-c.x)*(p.x-c.x))::BIGINT AS d FROM p JOIN {0} c USING (part,pos) GROUP BY 1,2,3) GROUP BY 1,2)"
_MOVED = "SELECT c.part, c.e, c.pos, CASE WHEN n IS NULL THEN c.x ELSE (s-((s%n)+n)%n)//n END AS x FROM {0} c LEFT JOIN (SELECT part, e, pos, sum(x)::BIGINT AS s, count(*) AS n FROM p JOIN {1} USING (vec_id,part) GROUP BY 1,2,3) USING (part,e,pos)"

ORACLE_SQL["op11_vector_codes"] = f"""WITH k AS (SELECT vec_id, label, embedding FROM embeddings WHERE {_NUMBERS} AND len(embedding)%16=0),
 p AS (SELECT vec_id, (i-1)//(n//16) AS part, (i-1)%(n//16) AS pos, floor(256*x::DOUBLE)::BIGINT AS x FROM (SELECT vec_id, len(embedding) AS n, unnest(embedding) AS x, unnest(range(1,len(embedding)+1)) AS i FROM k)),
 f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id)-1 AS e FROM k),
 c0 AS (SELECT part, e, pos, x FROM p JOIN f USING (vec_id) WHERE e<64),
 a0 AS MATERIALIZED {_NEAREST.format("c0")},
 c1 AS MATERIALIZED ({_MOVED.format("c0", "a0")}),
 a1 AS MATERIALIZED {_NEAREST.format("c1")},
 c2 AS MATERIALIZED ({_MOVED.format("c1", "a1")}),
 a2 AS MATERIALIZED {_NEAREST.format("c2")},
 r AS (SELECT vec_id, string_agg(printf('%02x',e),'' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR,',' ORDER BY part,e,pos)) FROM c2) AS codebooks_sha256 FROM r JOIN k USING (vec_id)"""

ORACLE_SQL["op13_embedding_dedup"] = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS u FROM embeddings WHERE {_NUMBERS}),
 k AS (SELECT vec_id, u FROM v WHERE list_dot_product(u,u)>0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM k a, k b WHERE a.vec_id<>b.vec_id AND len(a.u)=len(b.u) AND list_dot_product(a.u,b.u)/sqrt(list_dot_product(a.u,a.u)*list_dot_product(b.u,b.u))>=0.95),
 r AS (SELECT vec_id AS a, vec_id AS b FROM k UNION SELECT r.a, l.b FROM r JOIN l ON l.a=r.b),
 c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT vec_id, coalesce(n,0)::BIGINT AS n_links, coalesce(component_id,vec_id) AS component_id, coalesce(component_id,vec_id)=vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a=vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) x ON x.a=vec_id"""
