"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.llm import align, bpe, collocations, embed_dedup, line_dedup, media, packing, pii, quality, secrets, simhash, token_store, toxicity
from siftspan.llm.common import modest_batches


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.9)


def held_out() -> Column:
    """Rows that labels are not learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, lexicon).select("doc_id", held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    crf = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, crf).select("doc_id", held_out(), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(spark, documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(spark, documents(spark, sf_dir).select("doc_id", "text"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write(spark, documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2)
    return token_store.scan(spark, folder)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, documents(spark, sf_dir), radius=4, words=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), size=1024, end_id=0).drop("doc_row")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(documents(spark, sf_dir))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir), pii.train(pii.labelled(spark)))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, documents(spark, sf_dir), max_n=3, least=10, top=2000)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = align.align(spark, documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return rows


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": op1_embedding_near_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_bpe": op3_bpe,
        "op4_quality": op4_quality,
        "op5_secrets": op5_secrets,
        "op6_token_store": op6_token_store,
        "op7_line_dedup": op7_line_dedup,
        "op8_simhash": op8_simhash,
        "op9_packing": op9_packing,
        "op10_media": op10_media,
        "op11_pii": op11_pii,
        "op12_collocations": op12_collocations,
        "op13_token_alignment": op13_token_alignment,
        "pipeline": pipeline,
    }


def op5_sql() -> str:
    """Spans of every rule from the pieces between matches, as the operator has them, without an index."""
    parts = []
    for rank, rule in enumerate(secrets.BASE + secrets.ADDED):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(f"""
            SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, k,
                   coalesce(list_sum(list_transform(gaps[1:k], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:k-1], lambda g: length(g))), 0) AS s,
                   length(hits[k]) AS n, length(sized[k]) AS z, {rule.least} AS least
            FROM (SELECT doc_id, hits, sized, gaps, unnest(range(1, len(hits) + 1)) AS k
                  FROM (SELECT doc_id, regexp_extract_all(x, {pattern}, 0) AS hits, regexp_extract_all(x, {pattern}, {rule.group}) AS sized, string_split_regex(x, {pattern}) AS gaps FROM t WHERE regexp_matches(x, {pattern})))""")
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    counts = ", ".join(f"CAST(coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS BIGINT) AS n_{r.kind}" for r in secrets.BASE)
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
        found AS ({" UNION ALL ".join(parts)}),
        kept AS (SELECT doc_id, kind, rank, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS one FROM found WHERE z >= least),
        sums AS (SELECT doc_id, {counts}, string_agg(one, ',' ORDER BY s, rank) FILTER (kind IN ({base})) AS b, string_agg(one, ',' ORDER BY s, rank) AS a FROM kept GROUP BY doc_id)
        SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
        FROM t LEFT JOIN sums USING (doc_id)"""


#: Links by all pairs of usable vectors, and what each vector reaches by them.
OP1_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    r AS (SELECT vec_id, vec_id AS o FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.o),
    n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1), c AS (SELECT vec_id, min(o) AS component_id FROM r GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


#: Every phrase occurrence from the lists of words of the pieces, all cuts and all longer candidates by joins.
OP12_SQL = """
    WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
    p AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM t),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]'), lambda z: z <> '') AS ws FROM p),
    g AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
          UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
          UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
    n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1),
    cuts AS (SELECT lang, phrase, a, 1 AS c, ws[1] AS lp, array_to_string(ws[2:], ' ') AS rp FROM c UNION ALL SELECT lang, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE k = 3),
    s AS (SELECT cuts.*, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
          FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lp JOIN f r ON r.lang = cuts.lang AND r.phrase = rp),
    best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
    longer AS (SELECT lang, sub, max(a) AS above FROM (SELECT lang, a, ws[1] || ' ' || ws[2] AS sub FROM c WHERE k = 3 UNION ALL SELECT lang, a, ws[2] || ' ' || ws[3] FROM c WHERE k = 3) GROUP BY ALL),
    kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.sub = best.phrase WHERE above IS NULL OR above * 100 < a * 50)
    SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1_SQL, "op5_secrets": op5_sql(), "op12_collocations": OP12_SQL}
