"""Registered queries of chunkers, metrics, comparisons, Pareto analysis and synthesis, with DuckDB SQL where it fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspan.operators import abtest, chunkers, metrics, pareto, synthesis
from siftspan.plans.retrieval_queries import docs_of
from siftspan.sources.tables import table

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def chunk_fixed(spark, d):
    return chunkers.fixed_chars(docs_of(spark, d), 512, 64)


def chunk_fixed_tokens(spark, d):
    return chunkers.fixed_tokens(docs_of(spark, d), 128, 16)


def chunk_recursive(spark, d):
    return chunkers.recursive(docs_of(spark, d), 512, 64)


def sentence_groups(spark, d):
    return chunkers.sentence_groups(docs_of(spark, d), 1).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence", "grouped")


def chunk_semantic(spark, d):
    return chunkers.semantic(docs_of(spark, d))


def chunk_doc_aware(spark, d):
    """Over pages, as Markdown: headings, list items and paragraphs from their tags."""
    t = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<h1[^>]*>", "\n# "), r"(?is)<h2[^>]*>", "\n## ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)<li[^>]*>", "\n- "), r"(?is)</?(p|h1|h2|ul|div|li)[^>]*>", "\n\n")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace(t, r"(?s)<[^>]*>", "").alias("text"))
    return chunkers.structured(pages, 512)


def samples(spark, d) -> DataFrame:
    """A sample for each user turn and the assistant turn after it; contexts: all assistant turns of the conversation."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    ctx = c.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("contexts"), F.max_by("text", "turn").alias("ground_truth"))
    nxt = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    q = c.where(F.col("role") == "user").join(nxt, ["conv_id", "turn"]).join(ctx, "conv_id")
    return q.select(F.concat_ws("-", "conv_id", "turn").alias("sample_id"), F.col("text").alias("query"), "answer", "contexts", "ground_truth", F.col("turn").cast("double").alias("latency_seconds"))


def metric_tokens(spark, d):
    a, c, t = F.col("answer"), F.col("contexts"), F.col("ground_truth")
    from siftspan.functions.text import token_f1

    return samples(spark, d).select("sample_id", F.round(metrics.faithfulness(a, c), 6).alias("faithfulness"), F.round(metrics.context_recall(c, t), 6).alias("context_recall"), F.round(token_f1(a, t), 6).alias("token_f1"), F.round(metrics.latency_score(F.col("latency_seconds")), 6).alias("latency_score"))


def metrics_all(spark, d):
    return metrics.evaluate(samples(spark, d))


def ragas_overall(spark, d):
    four = ("faithfulness", "answer_relevance", "context_precision", "context_recall")
    return metrics.harmonic(metrics.evaluate(samples(spark, d), four)).select(F.round("overall", 6).alias("overall"))


def arms(spark, d) -> DataFrame:
    """Order prices by priority: finished orders (A) against open ones (B)."""
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return o.select(F.col("o_orderpriority").alias("metric"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("B").alias("arm"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").cast("double").alias("score"))


def _rounded(df: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def ab_welch(spark, d):
    return _rounded(abtest.welch_statistic(arms(spark, d)).drop("se"), ["mean_a", "mean_b", "std_a", "std_b", "effect_size", "statistic", "df"])


def _tested(df: DataFrame) -> DataFrame:
    """Rounded as far as the SQL's integrals and expansions go."""
    out = df
    for names, digits in ((("mean_a", "mean_b", "std_a", "std_b", "effect_size", "statistic", "mean_diff", "std_diff"), 4), (("p_value", "alpha"), 6), (("ci_lo", "ci_hi"), 3)):
        out = _rounded(out, [n for n in names if n in out.columns], digits)
    return out


def ab_welch_full(spark, d):
    return _tested(abtest.welch(arms(spark, d)))


def ab_mann_whitney(spark, d):
    return abtest.rank_sums(arms(spark, d)).select("metric", "n_a", "n_b", F.round("u", 1).alias("u"), F.col("ties").cast("bigint").alias("ties"))


def ab_mann_whitney_full(spark, d):
    return _tested(abtest.mann_whitney(arms(spark, d)))


def ab_permutation(spark, d):
    """Supplier balances: even nations against odd ones."""
    s = table(spark, d, "supplier").select(F.lit("balance").alias("metric"), F.when(F.col("s_nationkey") % 2 == 0, "A").otherwise("B").alias("arm"), F.col("s_suppkey").alias("pos"), F.col("s_acctbal").cast("double").alias("score"))
    return _rounded(abtest.permutation(spark, s), ["ci_lo", "ci_hi"])


def ab_permutation_selected(spark, d):
    """The same by the way for many scores: the n_a-th key of every round is selected where the scores lie."""
    s = table(spark, d, "supplier").select(F.lit("balance").alias("metric"), F.when(F.col("s_nationkey") % 2 == 0, "A").otherwise("B").alias("arm"), F.col("s_suppkey").alias("pos"), F.col("s_acctbal").cast("double").alias("score"))
    return _rounded(abtest.permutation(spark, s, send_rows=0), ["ci_lo", "ci_hi"])


def pareto_orders(spark, d):
    """Dominance counts of three objectives over all orders, grouped by customer and priority."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("double"))).alias("spent"), F.max(F.datediff("o_orderdate", F.lit("1992-01-01"))).cast("double").alias("latest"))
    return pareto.frontier(o.withColumnRenamed("o_custkey", "point_id"), ["orders", "spent", "latest"], ("orders",))


def pairs(spark, d) -> DataFrame:
    """Mean finished and mean open order prices of a customer, where they have both."""
    return arms_by_customer(spark, d).groupBy("metric", "arm", "pos").agg(F.avg("score").alias("score"))


def arms_by_customer(spark, d) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return o.select(F.lit("price").alias("metric"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("B").alias("arm"), F.col("o_custkey").alias("pos"), F.col("o_totalprice").cast("double").alias("score"))


def ab_paired(spark, d):
    return _rounded(abtest.paired_statistic(pairs(spark, d)), ["mean_diff", "std_diff", "statistic"])


def ab_paired_full(spark, d):
    return _tested(abtest.paired(pairs(spark, d)))


def points(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), F.col("s_acctbal").cast("double").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))


def pareto_frontier(spark, d):
    return pareto.frontier(points(spark, d), ["balance", "nation"], ("nation",))


def pareto_optimal(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"))
    return pareto.optimal(p, ["size", "price"], ("price",))


def pareto_crowding(spark, d):
    return pareto.crowding(points(spark, d), ["balance", "nation"])


def pareto_suggest(spark, d):
    return pareto.suggest(points(spark, d), {"balance": 0.7, "nation": 0.3})


def pareto_analyse(spark, d):
    return pareto.analyse(points(spark, d), ["balance", "nation"], ("nation",))


def synthetic_qa(spark, d):
    asked = synthesis.requests(spark, docs_of(spark, d), 2)
    return asked.select("doc_id", F.col("n").cast("bigint").alias("n"), "question_type", "difficulty", F.sha2("prompt", 256).alias("prompt_key"))


def latency_percentiles(spark, d):
    e = table(spark, d, "events")
    p = lambda x: F.round(F.expr(f"percentile(value, {x})"), 6)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def said(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def answer_checks(spark, d):
    """What strategies look for in answers."""
    from siftspan.functions import text as T

    t = F.concat("text", F.when(F.col("turn") % 3 == 0, " [Done]").when(F.col("turn") % 3 == 1, ' so {"a": {"b": 1}} yes').otherwise(""))
    return said(spark, d).select("conv_id", "turn", T.contains_yes(t).alias("yes"), T.says_done(t).alias("done"), T.json_part(t).alias("json"), F.size(T.dot_sentences(t)).cast("bigint").alias("sentences"), T.cache_key(t).alias("key"))


def thoughts(spark, d):
    from siftspan.functions import text as T

    t = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\n query: what of "), "role", F.lit("\nand more"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("QUERY:"), "role")).otherwise(F.col("text"))
    return said(spark, d).select("conv_id", "turn", T.thought_query(t, F.lit("as before")).alias("p")).select("conv_id", "turn", "p.thought", "p.query")


def reading_notes(spark, d):
    """Three blocks a nation, of which the kinds depend on its number."""
    from siftspan.functions import text as T

    k = F.col("n_nationkey")
    pick = lambda m, *xs: F.get(F.array(*map(F.lit, xs)), k % m)
    t = F.concat(F.lit("RELEVANCE: "), pick(4, "Relevant", "irrelevant", "none", "partially_relevant"), F.lit("\nKEY_INFO: "), "n_name", F.lit("\nTYPE: "), pick(3, "conflicting", "Complementary", "odd"), F.lit("\n\nCONNECTION: of "), "n_name", F.lit("\nTYPE: standard\nRELEVANCE: relevant\n\nno note of "), "n_name")
    notes = table(spark, d, "nation").select("n_nationkey", F.posexplode(T.note_blocks(t)).alias("pos", "n"))
    return notes.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.col("pos").cast("bigint").alias("pos"), "n.*")


def parsed_triples(spark, d):
    from siftspan.functions import text as T

    n, r = table(spark, d, "nation"), table(spark, d, "region")
    t = F.concat(F.lit(" "), "n_name", F.lit(" | in |"), "r_name", F.lit(" | sure\n\n"), "r_name", F.lit("|holds\n| is | nothing\n"), "r_name", F.lit("|holds|"), "n_name")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.posexplode(T.triples(t)).alias("pos", "t"))
    return rows.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.col("pos").cast("bigint").alias("pos"), "t.*")


def listed_lines(spark, d):
    """Entities and claims of lists."""
    from siftspan.functions import text as T

    t = F.concat(F.lit("- "), "n_name", F.lit("\n\n12. "), F.lower("n_name"), F.lit(" is one.\n -- end -"))
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.array_join(T.entity_lines(t), "#").alias("entities"), F.array_join(T.claim_lines(t), "#").alias("claims"))


def pipeline_hits(spark, d):
    """A whole pipeline: chunks, an index of them, and the best five of each benchmark item."""
    from siftspan.plans.pipeline import Config, Pipeline
    from siftspan.plans.retrieval_queries import items_of

    p = Pipeline(spark, Config(chunker="fixed", chunk_size=1024, chunk_overlap=128))
    p.ingest(docs_of(spark, d))
    return p.query(items_of(spark, d), 5)


def pipeline_scores(spark, d):
    """Its evaluation by the metrics that count words, against the items themselves."""
    from siftspan.plans.pipeline import Config, Pipeline
    from siftspan.plans.retrieval_queries import items_of

    p = Pipeline(spark, Config(chunker="fixed", chunk_size=1024, chunk_overlap=128, top_k=4))
    p.ingest(docs_of(spark, d))
    return p.evaluate(items_of(spark, d).withColumn("ground_truth", F.col("query")), ("faithfulness", "context_recall"))


def ab_compare(spark, d):
    """Samples of one half of the conversations against those of the other, scored and compared."""
    rows = samples(spark, d)
    low = F.substring(F.md5(F.substring_index("sample_id", "-", 1)), 1, 1) < "8"
    out = abtest.compare(spark, rows.where(low), rows.where(~low), "welch_t", ("answer_relevance", "coherence", "latency_score"), name_a="low", name_b="high")
    return _tested(out.drop("test", "num_samples"))


QUERIES = {
    "answer_checks": answer_checks, "thoughts": thoughts, "reading_notes": reading_notes, "parsed_triples": parsed_triples, "listed_lines": listed_lines, "pipeline_hits": pipeline_hits, "pipeline_scores": pipeline_scores, "ab_compare": ab_compare,
    "chunk_fixed": chunk_fixed, "chunk_fixed_tokens": chunk_fixed_tokens, "chunk_recursive": chunk_recursive, "sentence_groups": sentence_groups, "chunk_semantic": chunk_semantic, "chunk_doc_aware": chunk_doc_aware,
    "metric_tokens": metric_tokens, "metrics_all": metrics_all, "ragas_overall": ragas_overall, "ab_welch": ab_welch, "ab_welch_full": ab_welch_full, "ab_mann_whitney": ab_mann_whitney, "ab_mann_whitney_full": ab_mann_whitney_full,
    "ab_permutation": ab_permutation, "ab_permutation_selected": ab_permutation_selected, "pareto_orders": pareto_orders, "ab_paired": ab_paired, "ab_paired_full": ab_paired_full, "pareto_frontier": pareto_frontier, "pareto_optimal": pareto_optimal, "pareto_crowding": pareto_crowding, "pareto_suggest": pareto_suggest, "pareto_analyse": pareto_analyse,
    "synthetic_qa": synthetic_qa, "latency_percentiles": latency_percentiles,
}

#: Separators in order, as SQL literals.
CUTS = ("chr(10) || chr(10)", "chr(10)", "'. '", "'! '", "'? '", "'; '", "', '", "' '")


def recursive_sql(size: int = 512, overlap: int = 64) -> str:
    """Pieces by list functions, one step a separator; chunks by a fold, with chr(1) between them."""
    steps, stride = "s0 AS (SELECT doc_id, [text] AS p FROM documents WHERE text IS NOT NULL)", max(1, size - overlap)
    for k, sep in enumerate(CUTS, 1):
        steps += f""", s{k} AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= {size} OR NOT contains(x, {sep}) THEN [x]
            ELSE list_filter(list_transform(string_split(x, {sep}), lambda y, i: CASE WHEN i < len(string_split(x, {sep})) THEN y || {sep} ELSE y END), lambda y: trim(y, {BLANKS}) <> '') END)) AS p FROM s{k - 1})"""
    return f"""WITH {steps},
        h AS (SELECT doc_id, list_filter(flatten(list_transform(p, lambda x: CASE WHEN length(x) <= {size} THEN [x] ELSE list_transform(list_filter(range(0, length(x), {stride}), lambda s: s = 0 OR s - {stride} + {size} < length(x)), lambda s: substr(x, s + 1, {size})) END)), lambda x: trim(x, {BLANKS}) <> '') AS p FROM s{len(CUTS)}),
        m AS (SELECT doc_id, string_split(list_reduce(p, lambda a, x: CASE WHEN length(split_part(a, chr(1), -1)) + length(x) <= {size} THEN a || x ELSE a || chr(1) || right(split_part(a, chr(1), -1), {overlap}) || x END), chr(1)) AS c FROM h WHERE len(p) > 0),
        u AS (SELECT doc_id, c, unnest(range(len(c))) AS i FROM m)
        SELECT doc_id || '_recchunk_' || i AS chunk_id, doc_id, CAST(i AS INTEGER) AS chunk_index, trim(c[i + 1], {BLANKS}) AS content, 'recursive' AS chunking_strategy FROM u WHERE trim(c[i + 1], {BLANKS}) <> ''"""


def semantic_sql(percentile: float = 0.9, least: int = 50, most: int = 2000) -> str:
    """Sentences in groups, distances of neighbouring groups, segments, and a fold over those: chunks are put end to end as
    start, end and content with chr(2) between, chr(1) before each; a segment is short or not, its text and its chunks, with chr(3) between."""
    from siftspan.plans.retrieval_queries import hashed_sql

    return f"""WITH t AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS s FROM documents),
        u AS (SELECT doc_id, s, unnest(range(len(s))) AS pos FROM t WHERE len(s) > 1),
        g AS (SELECT doc_id, pos, s[pos + 1] AS sentence, array_to_string(s[greatest(pos, 1) : pos + 2], ' ') AS grouped FROM u), {hashed_sql('h', 'g', 'doc_id, pos', 'grouped')},
        c AS (SELECT x.doc_id, x.pos, sum(x.w * y.w) AS c FROM h x JOIN h y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 AND x.bucket = y.bucket GROUP BY 1, 2),
        d AS (SELECT g.doc_id, g.pos, sentence, CASE WHEN lead(g.pos) OVER (PARTITION BY g.doc_id ORDER BY g.pos) IS NOT NULL THEN round(1.0::DOUBLE - coalesce(c, 0.0::DOUBLE), 6) END AS distance FROM g LEFT JOIN c ON c.doc_id = g.doc_id AND c.pos = g.pos),
        e AS (SELECT *, quantile_cont(distance, {percentile}) OVER (PARTITION BY doc_id) AS threshold FROM d),
        f AS (SELECT *, coalesce(sum(CASE WHEN distance >= threshold THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM e),
        k AS (SELECT doc_id, segment, string_agg(sentence, ' ' ORDER BY pos) AS content, min(pos) AS a, max(pos) + 1 AS b FROM f GROUP BY 1, 2),
        l AS (SELECT doc_id, list_prepend('', list(CASE WHEN length(content) < {least} THEN '1' ELSE '0' END || chr(3) || content || chr(3) || array_to_string(list_transform(range(0, length(content), {most}), lambda i: a || chr(2) || b || chr(2) || substr(content, i + 1, {most})), chr(1)) ORDER BY segment)) AS p FROM k GROUP BY 1),
        m AS (SELECT doc_id, list_filter(string_split(list_reduce(p, lambda x, y: CASE WHEN x <> '' AND split_part(y, chr(3), 1) = '1' THEN x || ' ' || split_part(y, chr(3), 2) ELSE x || chr(1) || split_part(y, chr(3), 3) END), chr(1)), lambda x: x <> '') AS c FROM l),
        n AS (SELECT doc_id, c, unnest(range(len(c))) AS i FROM m)
        SELECT doc_id || '_semchunk_' || i AS chunk_id, doc_id, CAST(i AS INTEGER) AS chunk_index, split_part(c[i + 1], chr(2), 3) AS content, CAST(split_part(c[i + 1], chr(2), 1) AS INTEGER) AS sentence_start, CAST(split_part(c[i + 1], chr(2), 2) AS INTEGER) AS sentence_end, 'semantic' AS chunking_strategy FROM n
        UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id, NULL, text, NULL, NULL, NULL FROM t WHERE len(s) <= 1"""


def metrics_sql() -> str:
    """A CTE m (sample_id, metric, score) of all metrics, by hashed vectors of all texts of a sample."""
    from siftspan.plans.retrieval_queries import hashed_sql

    def near(name: str, left: str, right: str, on: str = "true", cols: str = "x.sample_id") -> str:
        return f"{name} AS (SELECT {cols}, sum(x.w * y.w) AS d FROM h x JOIN h y ON x.sample_id = y.sample_id AND x.bucket = y.bucket AND x.kind = '{left}' AND y.kind = '{right}' AND {on} GROUP BY ALL)"

    def share(name: str) -> str:
        return f"(SELECT sample_id, count(*) FILTER (round(d, 9) >= 0.5) AS n FROM {name} GROUP BY 1)"

    def per(x: str) -> str:
        return f"CASE WHEN nc = 0 THEN 0.0::DOUBLE ELSE coalesce({x}, 0)::DOUBLE / nc END"

    return f"""WITH {SAMPLES}, z AS (SELECT *, list_filter(list_transform(string_split(answer, '.'), lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS sent, len(contexts) AS nc, coalesce(g, '') AS truth FROM s),
        tx AS (SELECT sample_id, 'q' AS kind, 0 AS pos, query AS text FROM z UNION ALL SELECT sample_id, 'a', 0, answer FROM z UNION ALL SELECT sample_id, 't', 0, truth FROM z UNION ALL SELECT sample_id, 'c', unnest(range(nc)), unnest(contexts) FROM z UNION ALL SELECT sample_id, 's', unnest(range(len(sent))), unnest(sent) FROM z),
        {hashed_sql('h', 'tx', 'sample_id, kind, pos', 'text')},
        {near('qa', 'q', 'a')}, {near('ta', 't', 'a')}, {near('qc', 'q', 'c', cols='x.sample_id, y.pos')}, {near('tc', 't', 'c', cols='x.sample_id, y.pos')}, {near('ss', 's', 's', 'y.pos = x.pos + 1', 'x.sample_id, x.pos')},
        f AS (SELECT *, {WL.format('answer')} AS aw, list_distinct({WL.format("array_to_string(contexts, ' ')")}) AS kw, list_distinct({WL.format('truth')}) AS tw FROM z),
        wide AS (SELECT f.sample_id,
            CASE WHEN len(aw) = 0 OR len(kw) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(aw, lambda y: list_contains(kw, y)))::DOUBLE / len(aw) END AS faithfulness,
            CASE WHEN query = '' OR answer = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, coalesce(qa.d, 0)) END AS answer_relevance,
            CASE WHEN query = '' THEN 0.0::DOUBLE ELSE {per('nq.n')} END AS context_relevance,
            CASE WHEN answer = '' THEN 0.0::DOUBLE WHEN len(sent) <= 1 THEN 1.0::DOUBLE ELSE coalesce(co.d, 0) / (len(sent) - 1) END AS coherence,
            CASE WHEN len(tw) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(tw, kw))::DOUBLE / len(tw) END AS context_recall,
            CASE WHEN truth <> '' THEN {per('nt.n')} WHEN query = '' THEN 0.0::DOUBLE ELSE {per('nq.n')} END AS context_precision,
            CASE WHEN truth = '' OR answer = '' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE * (CASE WHEN len(aw) = 0 OR len(tw) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(list_distinct(aw), tw)) / (len(list_distinct(aw)) + len(tw)) END) + 0.5::DOUBLE * greatest(0.0::DOUBLE, coalesce(ta.d, 0)) END AS answer_correctness,
            CASE WHEN l <= 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - least(l / 10.0::DOUBLE, 1.0::DOUBLE) END AS latency_score
            FROM f LEFT JOIN qa USING (sample_id) LEFT JOIN ta USING (sample_id) LEFT JOIN {share('qc')} nq USING (sample_id) LEFT JOIN {share('tc')} nt USING (sample_id) LEFT JOIN (SELECT sample_id, sum(greatest(0.0::DOUBLE, d)) AS d FROM ss GROUP BY 1) co USING (sample_id)),
        m AS (SELECT sample_id, metric, round(score, 6) AS score FROM wide UNPIVOT (score FOR metric IN (faithfulness, answer_relevance, context_relevance, coherence, context_recall, context_precision, answer_correctness, latency_score)))"""


def two_sided(name: str, src: str, t: str, v: str | None) -> str:
    """A CTE: `src` with p, twice the upper tail at |t| of Student's distribution with v degrees (None: normal), by Simpson's rule."""
    x = f"(abs({t}) * i / 4000.0::DOUBLE)"
    if v:
        f = f"exp(lgamma(({v} + 1) / 2.0::DOUBLE) - lgamma({v} / 2.0::DOUBLE)) / sqrt(pi() * {v}) * pow(1 + {x} * {x} / {v}, -({v} + 1) / 2.0::DOUBLE)"
    else:
        f = f"exp(-{x} * {x} / 2) / sqrt(2 * pi())"
    return f"{name} AS (SELECT {src}.*, p FROM {src} JOIN (SELECT metric, greatest(0, 1 - 2 * sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {f}) * any_value(abs({t})) / 4000 / 3) AS p FROM {src}, range(4001) r(i) GROUP BY metric) USING (metric))"


def t_975(v: str) -> str:
    """The 97.5 % point of Student's distribution by its expansion at the normal one's, for many degrees."""
    z = 1.959963984540054
    terms = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return "(" + " + ".join(f"{c!r}::DOUBLE / pow({v}, {k})" for k, c in enumerate(terms)) + ")"


WL = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda t: t <> '')"
SAMPLES = """c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
x AS (SELECT conv_id, list(text ORDER BY turn) AS contexts, arg_max(text, turn) AS g FROM c WHERE role = 'assistant' GROUP BY 1),
s AS (SELECT c.conv_id || '-' || c.turn AS sample_id, c.text AS query, n.text AS answer, contexts, g, CAST(c.turn AS DOUBLE) AS l FROM c JOIN c n ON n.conv_id = c.conv_id AND n.turn - 1 = c.turn AND n.role = 'assistant' JOIN x ON x.conv_id = c.conv_id WHERE c.role = 'user')"""
ARMS = "arms AS (SELECT o_orderpriority AS metric, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'B' END AS arm, o_orderkey AS pos, CAST(o_totalprice AS DOUBLE) AS score FROM orders WHERE o_orderstatus IN ('F', 'O'))"
MOMENTS = "mo AS (SELECT metric, count(*) FILTER (arm = 'A') AS n_a, count(*) FILTER (arm = 'B') AS n_b, avg(score) FILTER (arm = 'A') AS mean_a, avg(score) FILTER (arm = 'B') AS mean_b, coalesce(stddev_samp(score) FILTER (arm = 'A'), 0) AS std_a, coalesce(stddev_samp(score) FILTER (arm = 'B'), 0) AS std_b FROM arms GROUP BY 1)"
SPREAD = "v0 AS (SELECT *, std_a * std_a / n_a AS va, std_b * std_b / n_b AS vb FROM mo), v AS (SELECT *, sqrt(va + vb) AS se, n_a + n_b - 2 AS d2, (mean_a - mean_b) / sqrt(((n_a - 1) * std_a * std_a + (n_b - 1) * std_b * std_b) / (n_a + n_b - 2)) AS effect, (mean_a - mean_b) / sqrt(va + vb) AS t, (va + vb) * (va + vb) / (va * va / (n_a - 1) + vb * vb / (n_b - 1)) AS df FROM v0)"
RANKS = """r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY score) + (count(*) OVER (PARTITION BY metric, score) - 1) / 2.0::DOUBLE AS r FROM arms),
        t AS (SELECT metric, CAST(sum(n * n * n - n) AS BIGINT) AS ties FROM (SELECT metric, score, count(*) AS n FROM arms GROUP BY 1, 2) GROUP BY 1),
        u AS (SELECT metric, count(*) FILTER (arm = 'A') AS n_a, count(*) FILTER (arm = 'B') AS n_b, sum(r) FILTER (arm = 'A') AS s FROM r GROUP BY 1)"""
PAIRED = """c AS (SELECT o_custkey AS pos, avg(CAST(o_totalprice AS DOUBLE)) FILTER (o_orderstatus = 'F') AS a, avg(CAST(o_totalprice AS DOUBLE)) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1),
        m0 AS (SELECT 'price' AS metric, count(*) AS n, avg(a - b) AS m, coalesce(stddev_samp(a - b), 0) AS s FROM c WHERE a IS NOT NULL AND b IS NOT NULL), m AS (SELECT *, m / (s / sqrt(n)) AS t, n - 1 AS df FROM m0)"""
#: What a test says of each metric, with the level divided by their number; w has the moments, p and what is above.
TESTED = f"""SELECT metric, n_a, n_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(std_a, 4) AS std_a, round(std_b, 4) AS std_b, round(effect, 4) AS effect_size, {{statistic}} AS statistic, round(p, 6) AS p_value,
        round(mean_a - mean_b - {t_975('d2')} * se, 3) AS ci_lo, round(mean_a - mean_b + {t_975('d2')} * se, 3) AS ci_hi, round(0.05::DOUBLE / count(*) OVER (), 6) AS alpha, p < 0.05::DOUBLE / count(*) OVER () AS significant,
        CASE WHEN p < 0.05::DOUBLE / count(*) OVER () THEN CASE WHEN mean_a > mean_b THEN 'A' ELSE 'B' END END AS winner, '{{test}}' AS test FROM w"""
PTS = "p AS (SELECT s_suppkey AS point_id, CAST(s_acctbal AS DOUBLE) AS balance, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier)"
SAID = "c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"


def chunks_sql(size: int, overlap: int) -> str:
    """A CTE ch (doc_id, text) of the chunks of fixed windows, under their ids."""
    step = size - overlap
    return f"""ct AS (SELECT doc_id, trim(text, {BLANKS}) AS t FROM documents), cw AS (SELECT doc_id, t, unnest(list_filter(range(0, length(t), {step}), lambda s: s = 0 OR s - {step} + {size} < length(t))) AS s FROM ct WHERE length(t) > 0),
        ck AS (SELECT doc_id, s, trim(substr(t, s + 1, {size}), {BLANKS}) AS text FROM cw),
        ch AS (SELECT doc_id || '_chunk_' || (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1) AS doc_id, text FROM ck WHERE text <> '')"""


def hits_sql(k: int, size: int = 1024, overlap: int = 128) -> str:
    """CTEs up to hits0: the best chunks of each benchmark item."""
    from siftspan.plans import retrieval_queries as R

    return f"WITH {R.Q}, {chunks_sql(size, overlap)}, {R.TF.replace('FROM documents', 'FROM ch')}, {R.asked_sql(0, 'q', k)}"


def scored_sql(k: int) -> str:
    """Samples (sample_id, query, answer, contexts, g, l) of those hits."""
    return f"""{hits_sql(k)}, hl AS (SELECT query_id, list(text ORDER BY rank) AS contexts FROM hits0 JOIN ch USING (doc_id) GROUP BY 1),
        s AS (SELECT query_id AS sample_id, query, array_to_string(list_transform(coalesce(contexts, [])[1:3], lambda x: substr(x, 1, 200)), ' ') AS answer, coalesce(contexts, []) AS contexts, query AS g, 0.0::DOUBLE AS l FROM q LEFT JOIN hl USING (query_id))"""


WORDS = f"""f AS (SELECT sample_id, l, {WL.format('answer')} AS a, list_distinct({WL.format("array_to_string(contexts, ' ')")}) AS k, list_distinct({WL.format('coalesce(g, chr(32))')}) AS t FROM s),
        wm AS (SELECT sample_id, round(CASE WHEN len(a) = 0 OR len(k) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(a, lambda x: list_contains(k, x)))::DOUBLE / len(a) END, 6) AS faithfulness,
        round(CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(t, k))::DOUBLE / len(t) END, 6) AS context_recall FROM f),
        wl AS (SELECT sample_id, metric, score FROM wm UNPIVOT (score FOR metric IN (faithfulness, context_recall)))"""
LAST = "coalesce(list_filter(list_transform(regexp_extract_all(b, '(?im)^\\s*{0}:[ \\t]*(.*)$', 1), lambda x: lower(trim(x))), lambda x: list_contains({1}, x))[-1], '{2}')"
FIELD = "coalesce(trim(regexp_extract_all(b, '(?im)^\\s*{0}:[ \\t]*(.*)$', 1)[-1]), '')"
#: Both ways of the permutation test.
PERMUTED = """WITH s AS (SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS arm, s_suppkey AS pos, CAST(s_acctbal AS DOUBLE) AS score FROM supplier),
        g AS (SELECT *, CAST('0x' || substr(md5('42-' || arm || '-' || pos), 1, 7) AS BIGINT) AS x FROM s),
        r AS (SELECT rep, CAST('0x' || substr(md5('42-' || rep), 1, 7) AS BIGINT) + 1 AS a, CAST('0x' || substr(md5('42-' || rep), 9, 7) AS BIGINT) AS b FROM range(10000) r(rep)),
        k AS (SELECT count(*) FILTER (arm = 'A') AS n_a, count(*) AS n, sum(score) AS total, avg(score) FILTER (arm = 'A') - avg(score) FILTER (arm = 'B') AS obs FROM s),
        o AS (SELECT rep, score, row_number() OVER (PARTITION BY rep ORDER BY (a * x + b) % 2147483647, arm, pos) AS i FROM g, r),
        y AS (SELECT rep, sum(CASE WHEN i <= n_a THEN score ELSE 0 END) AS a, any_value(n_a) AS n_a, any_value(n) AS n, any_value(total) AS total, any_value(obs) AS obs FROM o, k GROUP BY rep),
        d AS (SELECT obs, round(a / n_a - (total - a) / (n - n_a), 9) AS d FROM y)
        SELECT 'balance' AS metric, round(any_value(obs), 6) AS observed, avg(CASE WHEN abs(d) >= round(abs(obs), 9) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p_value, round(quantile_cont(d, 0.025), 4) AS ci_lo, round(quantile_cont(d, 0.975), 4) AS ci_hi FROM d"""

ORACLE = {
    "answer_checks": f"""WITH {SAID}, t AS (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' [Done]' WHEN 1 THEN ' so {{"a": {{"b": 1}}}} yes' ELSE '' END AS x FROM c)
        SELECT conv_id, turn, contains(lower(x), 'yes') AS yes, contains(lower(x), '[done]') OR contains(lower(x), '[complete]') AS done, regexp_extract(x, '(?s)\\{{.*\\}}') AS json, len(list_filter(string_split(x, '.'), lambda y: trim(y, {BLANKS}) <> '')) AS sentences, sha256(x) AS key FROM t""",
    "thoughts": f"""WITH {SAID}, t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || chr(10) || ' query: what of ' || role || chr(10) || 'and more' WHEN 1 THEN 'QUERY:' || role ELSE text END AS x FROM c),
        p AS (SELECT *, regexp_matches(x, '(?im)^\\s*QUERY:') AS has, trim(regexp_extract(x, '(?is)^(.*?)(?:^|\\n)\\s*QUERY:', 1), {BLANKS}) AS before FROM t)
        SELECT conv_id, turn, CASE WHEN has AND before <> '' THEN before ELSE trim(x, {BLANKS}) END AS thought, CASE WHEN has THEN trim(regexp_extract(x, '(?im)^\\s*QUERY:(.*)$', 1), {BLANKS}) ELSE 'as before' END AS query FROM p""",
    "reading_notes": f"""WITH t AS (SELECT n_nationkey, 'RELEVANCE: ' || (['Relevant', 'irrelevant', 'none', 'partially_relevant'])[n_nationkey % 4 + 1] || chr(10) || 'KEY_INFO: ' || n_name || chr(10) || 'TYPE: ' || (['conflicting', 'Complementary', 'odd'])[n_nationkey % 3 + 1] || chr(10) || chr(10) || 'CONNECTION: of ' || n_name || chr(10) || 'TYPE: standard' || chr(10) || 'RELEVANCE: relevant' || chr(10) || chr(10) || 'no note of ' || n_name AS x FROM nation),
        l AS (SELECT n_nationkey, string_split(x, chr(10) || chr(10)) AS l FROM t), u AS (SELECT n_nationkey, unnest(range(len(l))) AS pos, unnest(l) AS b FROM l)
        SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, pos, {LAST.format('RELEVANCE', "['relevant', 'partially_relevant', 'irrelevant']", 'partially_relevant')} AS relevance, {FIELD.format('KEY_INFO')} AS key_info, {FIELD.format('CONNECTION')} AS connection, {LAST.format('TYPE', "['standard', 'conflicting', 'complementary']", 'standard')} AS note_type FROM u""",
    "parsed_triples": f"""WITH t AS (SELECT n_nationkey, ' ' || n_name || ' | in |' || r_name || ' | sure' || chr(10) || chr(10) || r_name || '|holds' || chr(10) || '| is | nothing' || chr(10) || r_name || '|holds|' || n_name AS x FROM nation JOIN region ON n_regionkey = r_regionkey),
        l AS (SELECT n_nationkey, list_filter(list_transform(string_split(x, chr(10)), lambda y: list_transform(string_split(y, '|'), lambda z: trim(z, {BLANKS}))), lambda p: len(p) >= 3 AND p[1] <> '' AND p[3] <> '') AS l FROM t),
        u AS (SELECT n_nationkey, unnest(range(len(l))) AS pos, unnest(l) AS p FROM l) SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, pos, p[1] AS subject, p[2] AS predicate, p[3] AS object FROM u""",
    "listed_lines": f"""WITH t AS (SELECT n_nationkey, string_split('- ' || n_name || chr(10) || chr(10) || '12. ' || lower(n_name) || ' is one.' || chr(10) || ' -- end -', chr(10)) AS l FROM nation)
        SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, array_to_string(list_filter(list_transform(l, lambda x: trim(trim(trim(x, {BLANKS}), '-'), {BLANKS})), lambda x: x <> ''), '#') AS entities,
        array_to_string(list_filter(list_transform(l, lambda x: trim(ltrim(ltrim(trim(x, {BLANKS}), '- '), '0123456789.)'), {BLANKS})), lambda x: x <> ''), '#') AS claims FROM t""",
    "pipeline_hits": f"{hits_sql(5)} SELECT * FROM hits0",
    "pipeline_scores": f"{scored_sql(4)}, {WORDS} SELECT * FROM wl",
    "ab_compare": f"""{metrics_sql()}, arms AS (SELECT metric, CASE WHEN substr(md5(split_part(sample_id, '-', 1)), 1, 1) < '8' THEN 'A' ELSE 'B' END AS arm, score FROM m WHERE metric IN ('answer_relevance', 'coherence', 'latency_score')), {MOMENTS}, {SPREAD}, {two_sided('w', 'v', 't', 'df')}
        SELECT * EXCLUDE (test, winner), CASE winner WHEN 'A' THEN 'low' WHEN 'B' THEN 'high' END AS winner FROM ({TESTED.format(statistic='round(t, 4)', test='')})""",
    "chunk_fixed": f"""WITH t AS (SELECT doc_id, trim(text, {BLANKS}) AS t FROM documents), w AS (SELECT doc_id, t, unnest(list_filter(range(0, length(t), 448), lambda s: s = 0 OR s - 448 + 512 < length(t))) AS s FROM t WHERE length(t) > 0),
        k AS (SELECT doc_id, s, least(s + 512, length(t)) AS e, trim(substr(t, s + 1, 512), {BLANKS}) AS content FROM w),
        n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i FROM k WHERE content <> '')
        SELECT doc_id || '_chunk_' || i AS chunk_id, doc_id, CAST(i AS INTEGER) AS chunk_index, content, CAST(s AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end, 'fixed' AS chunking_strategy FROM n""",
    "chunk_recursive": recursive_sql(),
    "chunk_semantic": semantic_sql(),
    "metrics_all": f"{metrics_sql()} SELECT * FROM m",
    "ragas_overall": f"""{metrics_sql()}, y AS (SELECT metric, avg(score) AS a FROM m WHERE metric IN ('faithfulness', 'answer_relevance', 'context_precision', 'context_recall') GROUP BY 1)
        SELECT round(coalesce(count(*) FILTER (a > 0) / sum(1.0::DOUBLE / a) FILTER (a > 0), 0.0::DOUBLE), 6) AS overall FROM y""",
    "chunk_fixed_tokens": r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents), w AS (SELECT doc_id, t, unnest(list_filter(range(0, len(t), 112), lambda s: s = 0 OR s - 112 + 128 < len(t))) AS s FROM t),
        n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i FROM w)
        SELECT doc_id || '_chunk_' || i AS chunk_id, doc_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(t[s + 1 : s + 128], ' ') AS content, CAST(s AS INTEGER) AS token_start, CAST(least(s + 128, len(t)) AS INTEGER) AS token_end, 'fixed' AS chunking_strategy FROM n""",
    "sentence_groups": rf"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS s FROM documents),
        u AS (SELECT doc_id, s, unnest(range(len(s))) AS pos FROM t)
        SELECT doc_id, pos, s[pos + 1] AS sentence, array_to_string(s[greatest(pos, 1) : pos + 2], ' ') AS grouped FROM u""",
    "metric_tokens": f"""WITH {SAMPLES}, f AS (SELECT sample_id, l, {WL.format('answer')} AS a, list_distinct({WL.format("array_to_string(contexts, ' ')")}) AS k, list_distinct({WL.format('coalesce(g, chr(32))')}) AS t FROM s), h AS (SELECT *, list_distinct(a) AS b FROM f)
        SELECT sample_id, round(CASE WHEN len(a) = 0 OR len(k) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(a, lambda x: list_contains(k, x)))::DOUBLE / len(a) END, 6) AS faithfulness,
        round(CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(t, k))::DOUBLE / len(t) END, 6) AS context_recall,
        round(CASE WHEN len(b) = 0 OR len(t) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(b, t)) / (len(b) + len(t)) END, 6) AS token_f1,
        round(CASE WHEN l <= 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - least(l / 10.0::DOUBLE, 1.0::DOUBLE) END, 6) AS latency_score FROM h""",
    "ab_welch": f"""WITH {ARMS}, {MOMENTS}, {SPREAD}
        SELECT metric, n_a, n_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(std_a, 4) AS std_a, round(std_b, 4) AS std_b, round(effect, 4) AS effect_size, round(t, 4) AS statistic, round(df, 4) AS df FROM v""",
    "ab_welch_full": f"""WITH {ARMS}, {MOMENTS}, {SPREAD}, {two_sided('w', 'v', 't', 'df')} {TESTED.format(statistic='round(t, 4)', test='welch_t')}""",
    "ab_mann_whitney_full": f"""WITH {ARMS}, {MOMENTS}, {SPREAD}, {RANKS},
        z AS (SELECT v.*, s - v.n_a * (v.n_a + 1) / 2.0::DOUBLE AS us, greatest(0, abs(s - v.n_a * (v.n_a + 1) / 2.0::DOUBLE - v.n_a * v.n_b / 2.0::DOUBLE) - 0.5::DOUBLE) / sqrt(v.n_a * v.n_b / 12.0::DOUBLE * (v.n_a + v.n_b + 1 - ties / ((v.n_a + v.n_b) * (v.n_a + v.n_b - 1.0::DOUBLE)))) AS x FROM v JOIN u USING (metric) JOIN t USING (metric)),
        {two_sided('w', 'z', 'x', None)} {TESTED.format(statistic='round(us, 4)', test='mann_whitney')}""",
    "ab_mann_whitney": f"""WITH {ARMS}, {RANKS}
        SELECT metric, n_a, n_b, round(s - n_a * (n_a + 1) / 2.0::DOUBLE, 1) AS u, ties FROM u JOIN t USING (metric)""",
    "ab_permutation": PERMUTED,
    "ab_paired": f"""WITH {PAIRED} SELECT metric, n, round(m, 4) AS mean_diff, round(s, 4) AS std_diff, round(t, 4) AS statistic FROM m""",
    "ab_paired_full": f"""WITH {PAIRED}, {two_sided('w', 'm', 't', 'df')}
        SELECT metric, n, round(m, 4) AS mean_diff, round(s, 4) AS std_diff, round(t, 4) AS statistic, round(p, 6) AS p_value, round(m - {t_975('df')} * s / sqrt(n), 3) AS ci_lo, round(m + {t_975('df')} * s / sqrt(n), 3) AS ci_hi FROM w""",
    "ab_permutation_selected": PERMUTED,
    "pareto_orders": """WITH p AS (SELECT o_custkey AS point_id, CAST(count(*) AS DOUBLE) AS orders, round(sum(CAST(o_totalprice AS DOUBLE))) AS spent, CAST(max(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) AS DOUBLE) AS latest FROM orders GROUP BY 1),
        n AS (SELECT a.point_id, count(b.point_id) AS n FROM p a LEFT JOIN p b ON b.orders <= a.orders AND b.spent >= a.spent AND b.latest >= a.latest AND (b.orders < a.orders OR b.spent > a.spent OR b.latest > a.latest) GROUP BY 1)
        SELECT point_id, n AS n_dominating, n = 0 AS is_optimal FROM n""",
    "pareto_frontier": f"WITH {PTS}, n AS (SELECT a.point_id, count(b.point_id) AS n FROM p a LEFT JOIN p b ON b.balance >= a.balance AND b.nation <= a.nation AND (b.balance > a.balance OR b.nation < a.nation) GROUP BY 1) SELECT point_id, n AS n_dominating, n = 0 AS is_optimal FROM n",
    "pareto_optimal": "WITH p AS (SELECT p_partkey AS point_id, CAST(p_size AS DOUBLE) AS size, CAST(p_retailprice AS DOUBLE) AS price FROM part) SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.size >= a.size AND b.price <= a.price AND (b.size > a.size OR b.price < a.price))",
    "pareto_crowding": f"""WITH {PTS}, l AS (SELECT point_id, 'balance' AS o, balance AS v FROM p UNION ALL SELECT point_id, 'nation', nation FROM p),
        w AS (SELECT *, lag(v) OVER z AS a, lead(v) OVER z AS b, max(v) OVER (PARTITION BY o) - min(v) OVER (PARTITION BY o) AS span FROM l WINDOW z AS (PARTITION BY o ORDER BY v, point_id)),
        e AS (SELECT point_id, bool_or(a IS NULL OR b IS NULL) AS is_boundary, sum(CASE WHEN span > 1e-10 THEN (b - a) / span ELSE 0 END) AS d FROM w GROUP BY 1)
        SELECT point_id, CASE WHEN NOT is_boundary THEN round(d, 6) END AS crowding_distance, is_boundary FROM e""",
    "pareto_suggest": f"WITH {PTS}, f AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.balance >= a.balance AND b.nation >= a.nation AND (b.balance > a.balance OR b.nation > a.nation))) SELECT *, round(balance * 0.7::DOUBLE + nation * 0.3::DOUBLE, 6) AS utility FROM f ORDER BY utility DESC, point_id LIMIT 1",
    "pareto_analyse": f"""WITH {PTS}, n AS (SELECT a.point_id, a.balance, a.nation, count(b.point_id) AS n FROM p a LEFT JOIN p b ON b.balance >= a.balance AND b.nation <= a.nation AND (b.balance > a.balance OR b.nation < a.nation) GROUP BY ALL),
        f AS (SELECT point_id, balance, -nation AS nation FROM n WHERE n = 0), l AS (SELECT point_id, 'balance' AS o, balance AS v FROM f UNION ALL SELECT point_id, 'nation', nation FROM f),
        w AS (SELECT *, lag(v) OVER z AS a, lead(v) OVER z AS b, max(v) OVER (PARTITION BY o) - min(v) OVER (PARTITION BY o) AS span FROM l WINDOW z AS (PARTITION BY o ORDER BY v, point_id)),
        e AS (SELECT point_id, bool_or(a IS NULL OR b IS NULL) AS is_boundary, sum(CASE WHEN span > 1e-10 THEN (b - a) / span ELSE 0 END) AS d FROM w GROUP BY 1),
        c AS (SELECT point_id, is_boundary, CASE WHEN NOT is_boundary THEN round(d, 6) END AS crowd FROM e),
        k AS (SELECT *, CAST(row_number() OVER (ORDER BY is_boundary DESC, crowd DESC NULLS LAST, point_id) AS INTEGER) AS frontier_rank FROM c)
        SELECT point_id, balance, nation, n AS n_dominating, n = 0 AS is_optimal, CASE WHEN n = 0 THEN crowd ELSE 0.0::DOUBLE END AS crowding_distance, is_boundary, frontier_rank FROM n LEFT JOIN k USING (point_id)""",
    "synthetic_qa": f"""WITH r AS (SELECT doc_id, substr(text, 1, 2000) AS context, unnest(range(2)) AS n FROM documents), k AS (SELECT *, '42-' || doc_id || '-' || n AS key FROM r),
        y AS (SELECT *, ([{', '.join(repr(x) for x in synthesis.TYPES)}])[CAST(('0x' || substr(md5(key || '-t'), 1, 8)) AS BIGINT) % 4 + 1] AS question_type, ([{', '.join(repr(x) for x in synthesis.LEVELS)}])[CAST(('0x' || substr(md5(key || '-d'), 1, 8)) AS BIGINT) % 3 + 1] AS difficulty FROM k)
        SELECT doc_id, n, question_type, difficulty, sha256('Write one ' || difficulty || ' ' || question_type || ' question that this passage answers, as JSON with question and answer.' || chr(10) || chr(10) || context) AS prompt_key FROM y""",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
}
