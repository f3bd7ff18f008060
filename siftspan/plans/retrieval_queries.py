"""Registered retrieval queries over the driver's tables, and DuckDB SQL for the same results.

Searches over vectors take every row whose id is divisible by 100 as a query, against all rows; searches over texts
take all benchmark items.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.functions.text import let
from siftspan.functions.vector import hashed_vectors
from siftspan.operators import bm25, dense, fusion, graph, iterative
from siftspan.operators.postings import Postings
from siftspan.operators.topk import topk
from siftspan.sources.providers import Completer
from siftspan.sources.tables import cut, shared_dir, table
from siftspan.sources.vector_table import VectorTable, delete, probe, upsert


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def items_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def vector_queries(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))


def tokenize_tf(spark, d):
    return bm25.term_frequencies(docs_of(spark, d)).select("doc_id", F.col("dl").cast("bigint").alias("dl"), "term", "tf")


def doc_freq(spark, d):
    return bm25.term_frequencies(docs_of(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


def doc_len_stats(spark, d):
    return bm25.corpus_stats(docs_of(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(spark, d):
    return bm25.retrieve(docs_of(spark, d), items_of(spark, d), 10)


def bm25_postings(spark, d):
    """Through an inverted index: a query reads the buckets of its terms."""
    made = Postings(spark, f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}")
    made.add(docs_of(spark, d))
    return made.retrieve(items_of(spark, d), 10)


def bm25_growing(spark, d):
    """An index that three parts of the documents are added to, one of them twice under its name."""
    made = Postings(spark, f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}")
    for k in (0, 1, 2, 1):
        made.add(docs_of(spark, d).where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == k), f"part-{k}")
    return made.retrieve(items_of(spark, d), 10)


def bm25_threshold(spark, d):
    return bm25.retrieve(docs_of(spark, d), items_of(spark, d), 10, threshold=0.5)


def bm25_custom_params(spark, d):
    return bm25.retrieve(docs_of(spark, d), items_of(spark, d), 2, k1=2.0, b=0.5)


def _search(metric: str, k: int = 10, threshold: float = 0.0, kind: str = "raw"):
    def run(spark, d):
        v = vectors_of(spark, d)
        return dense.search(v.select("doc_id", "v"), vector_queries(v), k, metric, threshold, kind)

    return run


def vector_prefilter(spark, d):
    v = vectors_of(spark, d)
    return dense.search(v.where(F.col("label") == 3).select("doc_id", "v"), vector_queries(v), 10)


def vector_postfilter(spark, d):
    v = vectors_of(spark, d)
    return dense.search(v.select("doc_id", "v"), vector_queries(v), 10).join(v.where(F.col("label") == 3).select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "score", "rank")


def vector_delete_count(spark, d):
    v = vectors_of(spark, d)
    left = delete(v, v.where(F.col("label") == 3), "doc_id")
    return left.groupBy("label").agg(F.count("*").alias("n"))


def vector_upsert(spark, d):
    """New rows for every label 3 vector (its label becomes 103), and as many unknown ids."""
    v = vectors_of(spark, d).select("doc_id", "label")
    new = v.where(F.col("label") == 3).select("doc_id", F.lit(103).alias("label")).unionByName(v.where(F.col("label") == 3).select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.lit(203).alias("label")))
    return upsert(v, new, "doc_id")


def ivf_topk(spark, d):
    """Labels are the cells, their mean vectors the centroids; two cells are probed."""
    v = vectors_of(spark, d)
    centers = fusion.mean_vector(v, "label", "v").select(F.col("label").alias("cell"), F.col("v").alias("c"))
    return probe(v.select("doc_id", "v", F.col("label").alias("cell")), vector_queries(v), centers, 10, 2)


def text_embed(spark, d, k):
    q = hashed_vectors(items_of(spark, d), ["query_id"], "query").withColumnRenamed("v", "q")
    return dense.search(hashed_vectors(docs_of(spark, d), ["doc_id"], "text"), q, k)


def text_embed_topk(spark, d):
    return text_embed(spark, d, 10)


def hybrid_rrf(spark, d):
    lists = [(text_embed(spark, d, 30), "dense", 0.5), (bm25.retrieve(docs_of(spark, d), items_of(spark, d), 30), "bm25", 0.5)]
    return fusion.rrf(lists, 10).select("query_id", "doc_id", "score", F.round("raw_score", 6).alias("raw_score"), "original_strategy", F.round("original_score", 6).alias("original_score"), "rank")


def splade_topk(spark, d):
    return fusion.log_tf_search(docs_of(spark, d), items_of(spark, d), 10)


def window_vectors(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, i, v): hashed vectors of half-overlapping word windows; a text without words is its first 200 characters."""
    from siftspan.functions.text import word_windows

    w = word_windows(F.col(text), size)
    parts = rows.select(key, F.posexplode(F.when(F.trim(text) == "", F.array(F.lit("empty"))).otherwise(w)).alias("i", "window"))
    return hashed_vectors(parts, [key, "i"], "window")


def colbert_maxsim(spark, d):
    dv = window_vectors(docs_of(spark, d), "doc_id", "text", 180)
    qv = window_vectors(items_of(spark, d), "query_id", "query", 32).select("query_id", F.col("i").alias("qi"), F.col("v").alias("q"))
    return fusion.max_sim(dv, cut(spark, qv, "query-tokens"), 10)


def triples_of(spark, d):
    """Nations in regions, suppliers and customers in nations; the document is that of the subject."""
    n, r, s, c = (table(spark, d, t) for t in ("nation", "region", "supplier", "customer"))
    a = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("subject"), F.lit("in").alias("predicate"), F.col("r_name").alias("object"), (F.col("n_nationkey") + 2_000_000_000).cast("bigint").alias("doc_id"))
    b = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("subject"), F.lit("in").alias("predicate"), F.col("n_name").alias("object"), F.col("s_suppkey").cast("bigint").alias("doc_id"))
    e = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("subject"), F.lit("in").alias("predicate"), F.col("n_name").alias("object"), (F.col("c_custkey") + 1_000_000_000).cast("bigint").alias("doc_id"))
    return a.unionByName(b).unionByName(e)


def graph_bfs_docs(spark, d):
    t = triples_of(spark, d)
    seeds = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("query_id"), F.lower("r_name").alias("entity"))
    found = graph.bfs(spark, seeds, graph.edges(t), 1)
    return graph.scored_docs(found, graph.entity_docs(t), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", "depth")


def graph_from_text(spark, d):
    """A graph that a provider reads out of the documents, here a rule that links their first words; two hops from the
    first words of the items."""
    words = lambda c: F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda x: (x != "") & ~F.contains(x, F.lit("|")))
    line = lambda w, i: F.concat(F.get(w, F.lit(i)), F.lit(" | before | "), F.get(w, F.lit(i + 1)))
    # The words of a passage are cut once, not once for each place where a line uses them.
    rule = lambda p: let(F.slice(words(F.regexp_extract(p, r"(?s)<passage>(.*)</passage>", 1)), 1, 4), lambda w: F.array_join(F.array_compact(F.array(*[line(w, i) for i in range(3)])), "\n"))
    t = cut(spark, graph.extracted(docs_of(spark, d), Completer(rule=rule)), "triples")
    seeds = items_of(spark, d).select("query_id", F.lower(F.get(words(F.col("query")), F.lit(0))).alias("entity"))
    found = graph.bfs(spark, seeds, graph.edges(t), 2)
    return graph.scored_docs(found, graph.entity_docs(t), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", "depth")


def graph_entity_link_names(spark, d):
    """Misspelt names of all customers against all their names."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("query_id"), F.concat("c_name", F.lit("#")).alias("mention"), F.lower("c_name").alias("entity"))
    return graph.link(c.select("query_id", "mention"), c.select("entity"), 0.8).select("query_id", "mention", "entity", F.round("similarity", 6).alias("similarity"))


def ivf_trained(spark, d):
    """A vector table with 16 trained cells of which 8 are probed: how many of the exact ten nearest it finds."""
    v = vectors_of(spark, d)
    made = VectorTable(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", nlist=16, nprobe=8)
    made.add(v.select(F.col("doc_id").cast("string").alias("id"), F.col("v").alias("vector"), F.create_map().cast("map<string,string>").alias("metadata")))
    made.compact()
    q = vector_queries(v)
    exact = dense.search(v.select("doc_id", "v"), q, 10).select("query_id", F.col("doc_id").cast("string").alias("doc_id"))
    found = made.search(q, 10).select("query_id", "doc_id", F.lit(1).alias("hit"))
    rows = exact.join(found, ["query_id", "doc_id"], "left").agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_pairs"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return rows.select("n_queries", "n_pairs", (F.col("recall") >= 0.7).alias("recall_reached"))


def graph_entity_link(spark, d):
    m = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.concat("n_name", F.lit("land")).alias("mention"))
    e = table(spark, d, "nation").select(F.lower("n_name").alias("entity"))
    return graph.link(m, e, 0.3).select("query_id", "mention", "entity", F.round("similarity", 6).alias("similarity"))


def graph_fallback(spark, d):
    return graph.overlap(items_of(spark, d), docs_of(spark, d), 10)


def hyde(spark, d):
    """Two drafts an item (the item, and the item after its first 100 characters), averaged, against the documents."""
    q = items_of(spark, d)
    drafts = q.select("query_id", F.lit(0).alias("n"), "query").unionByName(q.select("query_id", F.lit(1).alias("n"), F.concat(F.substring("query", 101, 1_000_000), F.lit(" "), F.substring("query", 1, 100)).alias("query")))
    v = fusion.mean_vector(hashed_vectors(drafts, ["query_id", "n"], "query"), "query_id", "v").withColumnRenamed("v", "q")
    return dense.search(hashed_vectors(docs_of(spark, d), ["doc_id"], "text"), v, 10)


def _overlap_share():
    from siftspan.functions.text import ws_tokens

    q, t = F.array_distinct(ws_tokens(F.col("query"))), F.array_distinct(ws_tokens(F.col("text")))
    return F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))


def rerank(spark, d):
    q, docs = items_of(spark, d), docs_of(spark, d)
    hits = cut(spark, bm25.retrieve(docs, q, 30), "hits")
    return fusion.rerank(hits, q, docs, 4.0 * _overlap_share() - 2.0, 10).select("query_id", "doc_id", "score", "rank", F.round("first_score", 6).alias("first_score"))


def chain_of_note(spark, d):
    q, docs = items_of(spark, d), docs_of(spark, d)
    share = _overlap_share()
    note = F.struct(F.when(share >= 0.5, "relevant").when(share >= 0.3, "partially_relevant").otherwise("irrelevant").alias("relevance"), F.when(share >= 0.7, "complementary").when(share < 0.1, "conflicting").otherwise("standard").alias("note_type"))
    return iterative.noted(cut(spark, bm25.retrieve(docs, q, 10), "hits"), q, docs, note, 5)


def chain_of_note_batches(spark, d):
    """Two rounds of requests, answered by a rule: a note a document, by whether its first characters say item."""
    q, docs = items_of(spark, d), docs_of(spark, d)
    rule = lambda p: F.array_join(F.transform(F.split(F.element_at(F.split(p, "Texts:\n"), -1), "\n\n(?=<text no=)"), lambda x: F.concat(F.lit("RELEVANCE: "), F.when(F.length(x) >= 400, "relevant").otherwise("irrelevant"), F.lit("\nKEY_INFO: "), F.length(x).cast("string"), F.lit("\nTYPE: complementary"))), "\n\n")
    rows = iterative.chain_of_notes(spark, cut(spark, bm25.retrieve(docs, q, 8), "hits"), q, docs, Completer(rule=rule), 8, 5)
    return rows.select("query_id", "doc_id", "score", "rank", "relevance", "key_info", "note_type", "original_score")


def _rounds_search(spark, d):
    """The documents, and a search over terms that are cut once for all rounds."""
    docs = docs_of(spark, d)
    known = bm25.index(spark, docs)
    return docs, lambda q, k: bm25.retrieve(known, q, k)


def _refined():
    last = F.coalesce(F.try_element_at("evidence", F.lit(-1)), F.lit(""))
    return F.concat_ws(" ", F.col("query"), F.substring(last, 1, 200))


def multi_hop(spark, d):
    docs, search = _rounds_search(spark, d)
    return iterative.multi_hop(spark, items_of(spark, d), docs, search, _refined(), F.col("found") >= 6, 10)


def ircot(spark, d):
    docs, search = _rounds_search(spark, d)
    return iterative.interleaved(spark, items_of(spark, d), docs, search, _refined(), F.col("found") >= 6, 10, max_steps=3)


def self_rag(spark, d):
    docs, search = _rounds_search(spark, d)
    share = _overlap_share()
    judge = F.struct((share > 0.1).alias("is_relevant"), (share > 0.2).alias("is_supported"), F.lit(True).alias("is_useful"), share.alias("confidence"))
    return iterative.self_reflective(spark, items_of(spark, d), docs, search, judge, _refined(), F.col("found") < 5, 5, 2)


def optimizer_trials(spark, d):
    from siftspan.operators.tuning import bm25_grid

    hits = bm25_grid(spark, docs_of(spark, d), items_of(spark, d), [(k, k1, b) for k, (k1, b) in enumerate([(0.9, 0.4), (1.2, 0.75), (1.5, 0.75), (2.0, 0.5)])], 3)
    return hits.groupBy("trial").agg(F.round(F.avg("score"), 4).alias("value"), F.count("*").alias("hits"))


def optimizer_best(spark, d):
    from siftspan.operators.tuning import best

    return best(optimizer_trials(spark, d).select(F.col("trial").alias("number"), "value"))


# ---- SQL

TOK = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '')"
Q = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
TF = f"""tk AS (SELECT doc_id, {TOK.format('text')} AS t FROM documents),
ex AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tk), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM ex GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk)"""
QT = f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOK.format('query')}) AS term FROM q) GROUP BY 1, 2)"


def _raw(k1: str, b: str, extra: str = "") -> str:
    return f"""SELECT {extra} query_id, doc_id, sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * ({k1} + 1.0::DOUBLE) / (tf + {k1} * (1.0::DOUBLE - {b} + {b} * dl / avgdl))) AS s
FROM qt JOIN tf USING (term) JOIN df USING (term), st"""


def _ranked(src: str, k: int, value: str = "round(s / max(s) OVER (PARTITION BY query_id), 6)", order: str = "DESC", cols: str = "") -> str:
    return f"SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank{cols} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, doc_id) AS rank FROM (SELECT *, {value} AS score FROM {src})) WHERE rank <= {k}"


def bm25_sql(k: int = 10, k1: float = 1.5, b: float = 0.75, where: str = "") -> str:
    return f"WITH {Q}, {TF}, {QT}, raw AS ({_raw(f'{k1}::DOUBLE', f'{b}::DOUBLE')} GROUP BY 1, 2), r AS ({_ranked('raw', k)}) SELECT * FROM r {where}"


VQ = "v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), vq AS (SELECT doc_id AS query_id, v AS q FROM v WHERE doc_id % 100 = 0)"
COS = "list_dot_product(v, q) / (greatest(sqrt(list_dot_product(v, v)), 1e-10) * greatest(sqrt(list_dot_product(q, q)), 1e-10))"
L2 = "sqrt(list_sum(list_transform(list_zip(v, q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"


def vector_sql(score: str, k: int = 10, where: str = "true", order: str = "DESC", after: str = "") -> str:
    return f"WITH {VQ}, p AS (SELECT query_id, doc_id, label, {score} AS s FROM v, vq WHERE {where}), r AS ({_ranked('p', k, 'round(s, 6)', order, ', label')}) SELECT query_id, doc_id, score, rank FROM r {after}"


def hashed_sql(name: str, src: str, key: str, text: str) -> str:
    """CTEs {name}: (key, bucket, w) of the hashed embedder."""
    return f"""{name}c AS (SELECT {key}, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64 AS bucket, sum(CASE WHEN CAST(('0x' || substr(md5(t), 9, 1)) AS INTEGER) < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS c
FROM (SELECT {key}, unnest({TOK.format(text)}) AS t FROM {src}) GROUP BY {key}, bucket HAVING c <> 0),
{name} AS (SELECT {key}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS w FROM {name}c)"""


def embed_sql(k: int) -> str:
    return f"""{hashed_sql('hd', 'documents', 'doc_id', 'text')}, {hashed_sql('hq', 'q', 'query_id', 'query')},
dk AS (SELECT DISTINCT doc_id FROM hd), qk AS (SELECT DISTINCT query_id FROM hq),
hs AS (SELECT query_id, doc_id, sum(hd.w * hq.w) AS s FROM hd JOIN hq USING (bucket) GROUP BY 1, 2),
es AS (SELECT query_id, doc_id, coalesce(s, 0.0::DOUBLE) AS s FROM dk CROSS JOIN qk LEFT JOIN hs USING (query_id, doc_id)),
er AS ({_ranked('es', k, 'round(s, 6) + 0.0::DOUBLE')})"""


WS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda t: t <> ''))"
SHARE = f"(len(list_intersect({WS.format('query')}, {WS.format('text')}))::DOUBLE / greatest(len({WS.format('query')}), 1))"
NOTED = "least(greatest(b * CASE relevance WHEN 'relevant' THEN 1.2::DOUBLE WHEN 'irrelevant' THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END + CASE note_type WHEN 'complementary' THEN 0.1::DOUBLE WHEN 'conflicting' THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 1.0::DOUBLE)"
TRIPLES = """t AS (SELECT lower(n_name) AS s, lower(r_name) AS o, CAST(n_nationkey + 2000000000 AS BIGINT) AS doc_id FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT lower(s_name), lower(n_name), CAST(s_suppkey AS BIGINT) FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT lower(c_name), lower(n_name), CAST(c_custkey + 1000000000 AS BIGINT) FROM customer JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT s AS entity, o AS neighbour, doc_id FROM t UNION ALL SELECT o, s, doc_id FROM t), ed AS (SELECT DISTINCT entity, doc_id FROM e)"""
GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"


def windows_sql(text: str, size: int) -> str:
    w = rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda t: t <> '')"
    stride = max(1, size // 2)
    return f"list_transform(list_filter(range(0, greatest(len({w}), 1), {stride}), lambda s: s = 0 OR s - {stride} + {size} < len({w})), lambda s: array_to_string(({w})[s + 1 : s + {size}], ' '))"


def asked_sql(n: int, src: str, k: int) -> str:
    """CTEs qt{n}, raw{n} and hits{n} (query_id, doc_id, score, rank): the k best by BM25 of src(query_id, query)."""
    return f"""qt{n} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOK.format('query')}) AS term FROM {src}) GROUP BY 1, 2),
        raw{n} AS (SELECT query_id, doc_id, sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s FROM qt{n} JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
        hits{n} AS MATERIALIZED ({_ranked(f'raw{n}', k)})"""


def evidence_sql(n: int, found: str) -> str:
    """CTE ev{n} (query_id, found, last): how many documents a query has found, and the text of the last one."""
    return f"ev{n} AS (SELECT query_id, count(*) AS found, arg_max(text, {{'a': step, 'b': -score, 'c': doc_id}}) AS last FROM {found} JOIN documents USING (doc_id) GROUP BY 1)"


def rounds_sql(rounds: int, per: int, k: int, decay: float, ask_first: bool) -> str:
    """Rounds of searches with refined queries: `ask_first` refines before each search and stops after it."""
    out, found = [f"WITH {Q}, {TF}"], None
    state = "q"
    for n in range(rounds):
        if ask_first:
            if found:
                out.append(evidence_sql(n, found))
                out.append(f"a{n} AS (SELECT query_id, q.query || ' ' || coalesce(substr(last, 1, 200), '') AS query, coalesce(found, 0) >= 6 AS final FROM (SELECT query_id FROM {state}) JOIN q USING (query_id) LEFT JOIN ev{n} USING (query_id))")
            else:
                out.append(f"a{n} AS (SELECT query_id, query || ' ' AS query, false AS final FROM q)")
            state = f"a{n}"
        out.append(asked_sql(n, state, per))
        seen = f" AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM {found})" if found else ""
        out.append(f"r{n} AS (SELECT query_id, doc_id, score * (1.0::DOUBLE - {decay}::DOUBLE * {n}) AS score, {n} AS step FROM hits{n} WHERE true{seen})")
        out.append(f"f{n} AS MATERIALIZED (SELECT * FROM r{n}{f' UNION ALL SELECT * FROM {found}' if found else ''})")
        found = f"f{n}"
        if ask_first:
            out.append(f"b{n} AS (SELECT query_id FROM a{n} WHERE NOT final)")
            state = f"b{n}"
        else:
            out.append(evidence_sql(n, found))
            out.append(f"a{n} AS (SELECT query_id, q.query || ' ' || coalesce(substr(last, 1, 200), '') AS query FROM (SELECT query_id FROM {state}) JOIN q USING (query_id) LEFT JOIN ev{n} USING (query_id) WHERE coalesce(found, 0) < 6)")
            state = f"a{n}"
    # Products of rounded scores have halves in the seventh digit: they are rounded as the decimals that they are written as.
    ranked = _ranked(found, k, "CAST(round(CAST(CAST(score0 AS VARCHAR) AS DECIMAL(38, 20)), 6) AS DOUBLE)", cols=", step").replace(f"FROM {found}", f"FROM (SELECT query_id, doc_id, score AS score0, step FROM {found})")
    return ", ".join(out) + f" {ranked}"


QUERIES = {
    "tokenize_tf": tokenize_tf, "doc_freq": doc_freq, "doc_len_stats": doc_len_stats, "bm25_topk": bm25_topk, "bm25_postings": bm25_postings, "bm25_growing": bm25_growing, "bm25_threshold": bm25_threshold, "bm25_custom_params": bm25_custom_params,
    "dense_topk": _search("cosine"), "dense_threshold": _search("cosine", threshold=0.2), "vector_l2_topk": _search("l2"), "vector_l2_similarity": _search("l2", kind="similarity"), "vector_dot_topk": _search("dot"),
    "vector_prefilter": vector_prefilter, "vector_postfilter": vector_postfilter, "vector_delete_count": vector_delete_count, "vector_upsert": vector_upsert, "ivf_topk": ivf_topk,
    "text_embed_topk": text_embed_topk, "hybrid_rrf": hybrid_rrf, "splade_topk": splade_topk, "colbert_maxsim": colbert_maxsim, "graph_bfs_docs": graph_bfs_docs, "graph_entity_link": graph_entity_link, "graph_entity_link_names": graph_entity_link_names, "graph_from_text": graph_from_text, "ivf_trained": ivf_trained, "graph_fallback": graph_fallback,
    "hyde": hyde, "rerank": rerank, "chain_of_note": chain_of_note, "chain_of_note_batches": chain_of_note_batches, "multi_hop": multi_hop, "ircot": ircot, "self_rag": self_rag, "optimizer_trials": optimizer_trials, "optimizer_best": optimizer_best,
}

TRIALS = f"WITH {Q}, {TF}, {QT}, g AS (SELECT * FROM (VALUES (0, 0.9::DOUBLE, 0.4::DOUBLE), (1, 1.2::DOUBLE, 0.75::DOUBLE), (2, 1.5::DOUBLE, 0.75::DOUBLE), (3, 2.0::DOUBLE, 0.5::DOUBLE)) x(trial, k1, b)), raw AS ({_raw('k1', 'b', 'trial, ')}, g GROUP BY 1, 2, 3), r AS (SELECT trial, score, row_number() OVER (PARTITION BY trial, query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT *, round(s, 6) AS score FROM raw)), tr AS (SELECT trial, round(avg(score), 4) AS value, count(*) AS hits FROM r WHERE rank <= 3 GROUP BY 1)"
ORACLE = {
    "tokenize_tf": f"WITH {TF} SELECT * FROM tf",
    "doc_freq": f"WITH {TF} SELECT * FROM df",
    "doc_len_stats": f"WITH {TF} SELECT n, round(avgdl, 6) AS avgdl FROM st",
    "bm25_topk": bm25_sql(), "bm25_postings": bm25_sql(), "bm25_growing": bm25_sql(),
    "bm25_threshold": bm25_sql(where="WHERE score >= 0.5"),
    "bm25_custom_params": bm25_sql(2, 2.0, 0.5),
    "dense_topk": vector_sql(COS),
    "dense_threshold": vector_sql(COS, after="WHERE score >= 0.2"),
    "vector_l2_topk": vector_sql(L2, order="ASC"),
    "vector_l2_similarity": vector_sql(f"1.0::DOUBLE / (1.0::DOUBLE + {L2})"),
    "vector_dot_topk": vector_sql("list_dot_product(v, q)"),
    "vector_prefilter": vector_sql(COS, where="label = 3"),
    "vector_postfilter": vector_sql(COS, after="WHERE label = 3"),
    "vector_delete_count": "SELECT label, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY 1",
    "vector_upsert": "SELECT vec_id AS doc_id, CASE WHEN label = 3 THEN 103 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000000, 203 FROM embeddings WHERE label = 3",
    "ivf_topk": f"""WITH {VQ}, m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS x FROM v, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
        n AS (SELECT query_id, label FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(c, q) / (sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(q, q))), 6) DESC, label) AS k FROM m, vq) WHERE k <= 2),
        p AS (SELECT query_id, doc_id, {COS} AS s FROM v JOIN n USING (label) JOIN vq USING (query_id)) {_ranked('p', 10, 'round(s, 6)')}""",
    "text_embed_topk": f"WITH {Q}, {embed_sql(10)} SELECT * FROM er",
    "hybrid_rrf": f"""WITH {Q}, {embed_sql(30)}, {TF}, {QT}, raw AS ({_raw('1.5::DOUBLE', '0.75::DOUBLE')} GROUP BY 1, 2), br AS ({_ranked('raw', 30)}),
        u AS (SELECT query_id, doc_id, score, 0.5::DOUBLE / (60 + rank) AS part, 'dense' AS st, 0 AS o FROM er UNION ALL SELECT query_id, doc_id, score, 0.5::DOUBLE / (60 + rank), 'bm25', 1 FROM br),
        f AS (SELECT query_id, doc_id, sum(part) AS s, arg_max(st, {{'a': score, 'b': -o}}) AS original_strategy, round(max(score), 6) AS original_score FROM u GROUP BY 1, 2),
        z AS ({_ranked('f', 10, cols=', round(s, 6) AS raw_score, original_strategy, original_score')}) SELECT * FROM z""",
    "splade_topk": f"""WITH {Q}, {TF}, {QT}, raw AS (SELECT query_id, doc_id, sum(ln(1.0::DOUBLE + tf) * ln(1.0::DOUBLE + qtf)) AS s FROM qt JOIN tf USING (term) GROUP BY 1, 2) {_ranked('raw', 10)}""",
    "colbert_maxsim": f"""WITH {Q}, dw AS (SELECT doc_id, unnest(w) AS text, unnest(range(len(w))) AS i FROM (SELECT doc_id, {windows_sql('text', 180)} AS w FROM documents)),
        qw AS (SELECT query_id, unnest(w) AS text, unnest(range(len(w))) AS qi FROM (SELECT query_id, {windows_sql('query', 32)} AS w FROM q)),
        {hashed_sql('hd', 'dw', 'doc_id, i', 'text')}, {hashed_sql('hq', 'qw', 'query_id, qi', 'text')},
        ds AS (SELECT DISTINCT doc_id, i FROM hd), qs AS (SELECT DISTINCT query_id, qi FROM hq),
        sm AS (SELECT query_id, qi, doc_id, i, sum(hd.w * hq.w) AS s FROM hd JOIN hq USING (bucket) GROUP BY ALL),
        mx AS (SELECT query_id, qi, doc_id, max(coalesce(s, 0.0::DOUBLE)) AS m FROM ds CROSS JOIN qs LEFT JOIN sm USING (query_id, qi, doc_id, i) GROUP BY ALL),
        f AS (SELECT query_id, doc_id, sum(m) AS s FROM mx GROUP BY 1, 2) {_ranked('f', 10)}""",
    "graph_bfs_docs": f"""WITH {TRIPLES}, s0 AS (SELECT CAST(r_regionkey AS BIGINT) AS query_id, lower(r_name) AS entity, 0 AS depth FROM region),
        s1 AS (SELECT query_id, entity, min(depth) AS depth FROM (SELECT * FROM s0 UNION ALL SELECT query_id, neighbour, 1 FROM s0 JOIN e USING (entity)) GROUP BY 1, 2),
        dd AS (SELECT query_id, doc_id, min(depth) AS depth FROM s1 JOIN ed USING (entity) GROUP BY 1, 2), f AS (SELECT *, 1.0::DOUBLE / (1 + depth) AS s FROM dd),
        z AS ({_ranked('f', 10, cols=', depth')}) SELECT * FROM z""",
    "graph_entity_link": f"""WITH m AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, lower(n_name) || 'land' AS mention FROM nation), e AS (SELECT DISTINCT lower(n_name) AS entity FROM nation),
        p AS (SELECT *, len(list_intersect({GRAMS.format('mention')}, {GRAMS.format('entity')}))::DOUBLE / len(list_distinct(list_concat({GRAMS.format('mention')}, {GRAMS.format('entity')}))) AS j FROM m, e)
        SELECT query_id, mention, entity, round(j, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(j, 6) DESC, entity) AS k FROM p WHERE j >= 0.3) WHERE k = 1""",
    "graph_from_text": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '' AND NOT contains(x, '|')) AS w FROM documents),
        t AS (SELECT DISTINCT doc_id, lower(w[i]) AS s, lower(w[i + 1]) AS o FROM w, range(1, 4) r(i) WHERE len(w) > i),
        e AS (SELECT s AS entity, o AS neighbour, doc_id FROM t UNION ALL SELECT o, s, doc_id FROM t), ed AS (SELECT DISTINCT entity, doc_id FROM e), n AS (SELECT DISTINCT entity, neighbour FROM e),
        s0 AS (SELECT item_id AS query_id, lower(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '' AND NOT contains(x, '|'))[1]) AS entity, 0 AS depth FROM benchmark),
        b AS (SELECT * FROM s0 UNION SELECT query_id, neighbour, depth + 1 FROM b JOIN n USING (entity) WHERE depth < 2),
        r AS (SELECT query_id, entity, min(depth) AS depth FROM b GROUP BY 1, 2),
        dd AS (SELECT query_id, doc_id, min(depth) AS depth FROM r JOIN ed USING (entity) GROUP BY 1, 2), f AS (SELECT *, 1.0::DOUBLE / (1 + depth) AS s FROM dd),
        m AS (SELECT *, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM f)
        SELECT query_id, doc_id, score, rank, depth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m) WHERE rank <= 10""",
    "graph_entity_link_names": f"""WITH m AS (SELECT CAST(c_custkey AS BIGINT) AS query_id, lower(c_name) || '#' AS mention FROM customer), e AS (SELECT DISTINCT lower(c_name) AS entity FROM customer),
        mg AS (SELECT query_id, mention, {GRAMS.format('mention')} AS g FROM m), eg AS (SELECT entity, {GRAMS.format('entity')} AS g FROM e),
        c AS (SELECT query_id, mention, entity, any_value(x.n) + any_value(y.n) AS n, count(*) AS shared FROM (SELECT query_id, mention, len(g) AS n, unnest(g) AS t FROM mg) x JOIN (SELECT entity, len(g) AS n, unnest(g) AS t FROM eg) y USING (t) GROUP BY 1, 2, 3),
        p AS (SELECT *, shared::DOUBLE / (n - shared) AS j FROM c)
        SELECT query_id, mention, entity, round(j, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(j, 6) DESC, entity) AS k FROM p WHERE j >= 0.8) WHERE k = 1""",
    "ivf_trained": f"WITH {VQ} SELECT count(*) AS n_queries, count(*) * 10 AS n_pairs, true AS recall_reached FROM vq",
    "graph_fallback": f"""WITH {Q}, qw AS (SELECT query_id, len(w) AS n, unnest(w) AS word FROM (SELECT query_id, {WS.format('query')} AS w FROM q)), dw AS (SELECT doc_id, unnest({WS.format('text')}) AS word FROM documents),
        h AS (SELECT query_id, doc_id, count(*)::DOUBLE / n AS s FROM qw JOIN dw USING (word) GROUP BY query_id, doc_id, n) {_ranked('h', 10, 'round(s, 6)')}""",
    "hyde": f"""WITH {Q}, dr AS (SELECT query_id, 0 AS n, query FROM q UNION ALL SELECT query_id, 1, substr(query, 101) || ' ' || substr(query, 1, 100) FROM q),
        {hashed_sql('hd', 'documents', 'doc_id', 'text')}, {hashed_sql('hr', 'dr', 'query_id, n', 'query')},
        hn AS (SELECT query_id, count(DISTINCT n) AS m FROM hr GROUP BY 1), hq AS (SELECT query_id, bucket, sum(w) / any_value(m) AS w FROM hr JOIN hn USING (query_id) GROUP BY 1, 2),
        nq AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM hq GROUP BY 1), dk AS (SELECT DISTINCT doc_id FROM hd),
        hs AS (SELECT query_id, doc_id, sum(hd.w * hq.w) AS s FROM hd JOIN hq USING (bucket) GROUP BY 1, 2),
        es AS (SELECT query_id, doc_id, coalesce(s, 0.0::DOUBLE) / n AS s FROM dk CROSS JOIN nq LEFT JOIN hs USING (query_id, doc_id)) {_ranked('es', 10, 'round(s, 6) + 0.0::DOUBLE')}""",
    "rerank": f"""WITH {Q}, {TF}, {QT}, raw AS ({_raw('1.5::DOUBLE', '0.75::DOUBLE')} GROUP BY 1, 2), br AS ({_ranked('raw', 30)}),
        f AS (SELECT query_id, doc_id, br.score AS first_score, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(4.0::DOUBLE * {SHARE} - 2.0::DOUBLE))) AS s FROM br JOIN q USING (query_id) JOIN documents USING (doc_id)),
        z AS ({_ranked('f', 10, 'round(s, 6)', cols=', round(first_score, 6) AS first_score')}) SELECT * FROM z""",
    "chain_of_note": f"""WITH {Q}, {TF}, {QT}, raw AS ({_raw('1.5::DOUBLE', '0.75::DOUBLE')} GROUP BY 1, 2), br AS ({_ranked('raw', 10)}),
        n AS (SELECT query_id, doc_id, br.score AS b, {SHARE} AS sh FROM br JOIN q USING (query_id) JOIN documents USING (doc_id)),
        m AS (SELECT *, CASE WHEN sh >= 0.5 THEN 'relevant' WHEN sh >= 0.3 THEN 'partially_relevant' ELSE 'irrelevant' END AS relevance, CASE WHEN sh >= 0.7 THEN 'complementary' WHEN sh < 0.1 THEN 'conflicting' ELSE 'standard' END AS note_type FROM n),
        f AS (SELECT *, {NOTED} AS s FROM m), z AS ({_ranked('f', 5, 'round(s, 6)', cols=', relevance, note_type')}) SELECT * FROM z""",
    "chain_of_note_batches": f"""WITH {Q}, {TF}, {QT}, raw AS ({_raw('1.5::DOUBLE', '0.75::DOUBLE')} GROUP BY 1, 2), br AS ({_ranked('raw', 8)}),
        n AS (SELECT query_id, doc_id, br.score AS b, length('<text no=' || ((rank - 1) % 5 + 1) || ' key=' || doc_id || '>' || substr(text, 1, 500)) AS l FROM br JOIN documents USING (doc_id)),
        m AS (SELECT *, CASE WHEN l >= 400 THEN 'relevant' ELSE 'irrelevant' END AS relevance, 'complementary' AS note_type, CAST(l AS VARCHAR) AS key_info FROM n),
        f AS (SELECT *, {NOTED} AS s, b AS original_score FROM m), z AS ({_ranked('f', 8, 'round(s, 6)', cols=', relevance, key_info, note_type, original_score')}) SELECT * FROM z""",
    "multi_hop": rounds_sql(3, 3, 10, 0.1, False),
    "ircot": rounds_sql(3, 3, 10, 0.05, True),
    "self_rag": f"""WITH {Q}, {TF}, {asked_sql(0, 'q', 10)},
        j0 AS MATERIALIZED (SELECT query_id, doc_id, score * sh AS score, sh > 0.2::DOUBLE AS good, 0 AS step FROM (SELECT query_id, doc_id, score, {SHARE} AS sh FROM hits0 JOIN q USING (query_id) JOIN documents USING (doc_id))),
        k0 AS (SELECT query_id, doc_id, score, step FROM j0 WHERE good), {evidence_sql(0, 'k0')},
        a0 AS (SELECT q.query_id, q.query || ' ' || coalesce(substr(last, 1, 200), '') AS query FROM q LEFT JOIN ev0 USING (query_id) WHERE coalesce(found, 0) < 5), {asked_sql(1, 'a0', 10)},
        j1 AS (SELECT query_id, doc_id, score * sh AS score, sh > 0.2::DOUBLE AS good, 1 AS step FROM (SELECT query_id, doc_id, score, {SHARE} AS sh FROM hits1 JOIN q USING (query_id) JOIN documents USING (doc_id)) WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM j0)),
        k AS (SELECT query_id, doc_id, score AS score0, step FROM k0 UNION ALL SELECT query_id, doc_id, score, step FROM j1 WHERE good) {_ranked('k', 5, 'round(score0, 6)', cols=', step')}""",
    "optimizer_trials": f"{TRIALS} SELECT * FROM tr",
    "optimizer_best": f"{TRIALS} SELECT trial AS number, value FROM tr ORDER BY value DESC, trial LIMIT 1",
}
