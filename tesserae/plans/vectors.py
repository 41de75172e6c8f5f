"""Queries over vectors: normal forms, search, fusion of stages, filters, structure, evaluation of rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Retrieval, Settings, Stage
from ..engine import Engine
from ..functions import structure as sx
from ..functions import vectors as vx
from ..operators import embedding, evaluation, filters, fusion, index, structural
from ..sources import ingest, store
from . import base

#: Every so many-th vector asks, against all.
EVERY = 50
K = 10
STAGES = Retrieval(stages=(Stage("d16", 16, 20, 0.2), Stage("d32", 32, 20, 0.3), Stage("d64", 64, 20, 0.5)))
WEIGHTS = Retrieval(
    stages=STAGES.stages,
    lambda_similarity=0.6,
    alpha_reliability=0.2,
    beta_temporal=0.1,
    gamma_domain=0.05,
    zeta_structural_similarity=0.05,
    epsilon_bm25=0.1,
)


def _each(df, name="vec_id"):
    return df.select(name, F.posexplode("v").alias("pos", "x")).select(
        name,
        F.col("pos").cast("long").alias("pos"),
        F.round("x", 6).alias("x"),
    )


def vector_l2_normalize(spark, sf_dir):
    return _each(
        base.unit_vectors(spark, sf_dir).select("vec_id", vx.l2_normalized(F.transform("embedding", lambda x: x * 3.0)).alias("v"))
    )


def vector_slice_renorm(spark, sf_dir):
    rows = embedding.multi_resolution(base.unit_vectors(spark, sf_dir), [16, 32], id_col="vec_id", vector_col="embedding")
    return rows.select(
        "vec_id",
        F.col("dimension").cast("long").alias("dimension"),
        F.posexplode("vector").alias("pos", "x"),
    ).select("vec_id", "dimension", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def vector_pad_truncate(spark, sf_dir):
    return _each(base.unit_vectors(spark, sf_dir).select("vec_id", vx.fitted(F.col("embedding"), 80).alias("v")))


def hash_embedding(spark, sf_dir):
    rows = base.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"), vx.hash_vector(F.col("text"), 48).alias("v"))
    return _each(rows)


def _vectors(spark, sf_dir):
    rows = base.unit_vectors(spark, sf_dir)
    items = rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    asked = rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return items, asked


def _top(spark, sf_dir, metric):
    items, asked = _vectors(spark, sf_dir)
    rows = index.top_k(asked, items, K, metric=metric, precision=9)
    return rows.select("query_id", "item_id", F.col("stage_rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def vector_topk_dot(spark, sf_dir):
    return _top(spark, sf_dir, "dot")


def vector_topk_inverse_l2(spark, sf_dir):
    return _top(spark, sf_dir, "inverse_l2")


def vector_topk_blocks(spark, sf_dir):
    """The same ids as the dot product in expressions, from matrices in Arrow batches."""
    items, asked = _vectors(spark, sf_dir)
    rows = index.top_k_blocks(asked, items, K)
    return rows.select("query_id", "item_id", F.col("stage_rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _hits(spark, sf_dir):
    rows = base.unit_vectors(spark, sf_dir)
    parts = F.array(
        *[F.struct(F.lit(s.name).alias("stage"), vx.resolution(F.col("embedding"), s.dimension).alias("vector")) for s in STAGES.stages]
    )
    # Each stage searches these vectors and asks some of them: they are made once.
    staged = store.kept(rows.select("vec_id", F.explode(parts).alias("s")).select("vec_id", "s.*"))
    asked = staged.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id")
    return index.search(asked, staged.withColumnRenamed("vec_id", "chunk_id"), STAGES)


_DOT = "list_dot_product(q.{0}, c.{0})"
STAGED_SQL = f"""base AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings),
res AS (SELECT vec_id, label, {", ".join(f"list_transform(list_slice(e, 1, {s.dimension}), lambda x: x / sqrt(list_dot_product(list_slice(e, 1, {s.dimension}), list_slice(e, 1, {s.dimension})))) AS {s.name}" for s in STAGES.stages)} FROM base),
hits AS ({" UNION ALL ".join(f"SELECT query_id, '{s.name}' AS stage, chunk_id, score, rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {_DOT.format(s.name)} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT.format(s.name)} DESC, c.vec_id) AS rank FROM res q, res c WHERE q.vec_id % {EVERY} = 0) WHERE rank <= {s.top_k}" for s in STAGES.stages)}),
summed AS (SELECT query_id, chunk_id, sum(score * CASE stage {" ".join(f"WHEN '{s.name}' THEN {s.weight}::double" for s in STAGES.stages)} END) AS similarity FROM hits GROUP BY query_id, chunk_id)"""


def stage_fusion(spark, sf_dir):
    rows = fusion.stage_sums(_hits(spark, sf_dir), STAGES)
    return rows.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


def metadata_priors(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents").join(base.table(spark, sf_dir, "labels"), "doc_id", "left")
    meta = F.create_map(
        F.lit("reliability"),
        F.col("quality").cast("string"),
        F.lit("recency_score"),
        F.when(F.col("lang") == "en", F.concat(F.lit("0."), F.col("doc_id").cast("string"))).otherwise(F.col("lang")),
        F.lit("domain_score"),
        (F.col("n_chars") / 1000.0).cast("string"),
    )
    return docs.select("doc_id", *[c.alias(k) for k, c in fusion.priors(meta).items()]).select(
        "doc_id",
        "reliability",
        "recency_score",
        F.round("domain_score", 6).alias("domain_score"),
    )


def _chunks(spark, sf_dir):
    """Vectors as chunks: label gives lang-like metadata and priors."""
    rows = base.unit_vectors(spark, sf_dir)
    meta = F.create_map(
        F.lit("group"),
        F.concat(F.lit("G"), F.col("label").cast("string")),
        F.lit("reliability"),
        (F.col("label") / 10.0).cast("string"),
        F.lit("recency_score"),
        F.lit("0.5"),
        F.lit("domain_score"),
        F.lit("none"),
    )
    return rows.select(F.col("vec_id").alias("chunk_id"), F.lit("").alias("text"), meta.alias("metadata"))


def _queries(spark, sf_dir, filtered):
    rows = base.unit_vectors(spark, sf_dir).where(F.col("vec_id") % EVERY == 0)
    wanted = F.create_map(
        F.lit("filter__group"),
        F.format_string('["g%d", "G9"]', F.col("label")),
    ) if filtered else F.create_map().cast("map<string,string>")
    return rows.select(F.col("vec_id").alias("query_id"), wanted.alias("metadata"))


def weighted_fusion(spark, sf_dir):
    rows = fusion.fuse(_hits(spark, sf_dir), _chunks(spark, sf_dir), _queries(spark, sf_dir, False), WEIGHTS)
    return rows.select(
        "query_id",
        "chunk_id",
        F.round("combined", 6).alias("combined"),
        F.round("weighted", 6).alias("weighted"),
        F.col("rank").cast("long").alias("rank"),
    )


def metadata_filter_soft(spark, sf_dir):
    rows = fusion.fuse(_hits(spark, sf_dir), _chunks(spark, sf_dir), _queries(spark, sf_dir, True), WEIGHTS)
    return rows.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


FUSED_SQL = f"""{STAGED_SQL}, fused AS (
  SELECT s.query_id, s.chunk_id, s.similarity, label, (0.6::double * similarity + 0.2::double * (label / 10.0::double) + 0.1::double * 0.5::double + 0.1::double * 0.5::double) / 1.1::double AS weighted
  FROM summed s JOIN res ON res.vec_id = s.chunk_id
), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weighted DESC, chunk_id) AS rank FROM fused)"""


def structure_text(spark, sf_dir):
    return _structures(spark, sf_dir).select(
        "table_id",
        sx.structure_text(F.col("structure")).alias("text"),
        sx.normalized_structure(F.col("structure")).alias("normal"),
    )


def _structures(spark, sf_dir):
    """A structure record for each part brand: its types and sizes as columns."""
    parts = base.table(spark, sf_dir, "part")
    rows = parts.groupBy("p_brand").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.slice(F.array_sort(F.collect_set("p_type")), 1, 3).alias("types"),
        F.slice(F.array_sort(F.collect_set(F.col("p_size").cast("string"))), 1, 3).alias("sizes"),
    )
    column = lambda name, kind, c: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.col(c).alias("samples"))
    s = F.struct(
        F.concat(F.lit("Parts of "), F.col("p_brand")).alias("table_description"),
        F.array(column("type", "categorical", "types"), column("size", "numeric", "sizes")).alias("columns"),
        F.col("n").alias("rows"),
        F.array(F.lit("keyed")).alias("patterns"),
    )
    return rows.select(F.col("p_brand").alias("table_id"), s.cast(sx.STRUCTURE).alias("structure"))


STRUCTURE_SQL = """brands AS (SELECT p_brand, count(*) AS n, list_slice(list_sort(list_distinct(list(p_type))), 1, 3) AS types,
  list_slice(list_sort(list_distinct(list(cast(p_size AS varchar)))), 1, 3) AS sizes FROM part GROUP BY p_brand),
said AS (SELECT p_brand AS table_id, n, 'Table: Parts of ' || p_brand || ' Columns: type (categorical): ' || array_to_string(types, ', ') || ' | size (numeric): ' || array_to_string(sizes, ', ') || ' Patterns: keyed Rows: ' || n AS text,
  'Description: Parts of ' || p_brand || ' | Columns: type (categorical): ' || array_to_string(types, ', ') || ' | size (numeric): ' || array_to_string(sizes, ', ') || ' | Patterns: ' ||
  array_to_string(list_sort(list_filter(['keyed', CASE WHEN n > 100 THEN 'large' WHEN n < 5 THEN 'small' END, 'narrow'], lambda x: x IS NOT NULL)), ', ') || ' | Rows: ' || n AS normal FROM brands)"""


def structural_similarity(spark, sf_dir):
    vectors = structural.structure_vectors(_structures(spark, sf_dir), 32)
    asked = base.questions(spark, sf_dir)
    chunks = _structures(spark, sf_dir).select(
        F.concat("table_id", F.lit("_full_table")).alias("chunk_id"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    pairs = asked.select("query_id").crossJoin(F.broadcast(chunks.select("chunk_id")))  # 25 brands
    rows = structural.scores(pairs, asked, chunks, vectors, 32)
    return rows.select("query_id", "chunk_id", F.round("value", 6).alias("value"))


def _hash_sql(text: str) -> str:
    return f"list_transform(generate_series(0, 31), lambda i: cast('0x' || substr(sha256({text}), 2 * i + 1, 2) AS int) / 255.0::double)"


def _judged(spark, sf_dir):
    rows = base.unit_vectors(spark, sf_dir)
    asked = rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("l"))
    qrels = rows.join(F.broadcast(asked), (F.col("label") == F.col("l")) & (F.col("vec_id") != F.col("query_id")))
    return qrels.select("query_id", F.col("vec_id").alias("doc_id"), F.lit(1.0).alias("relevance"))


def _run(spark, sf_dir):
    hits = _hits(spark, sf_dir).where("chunk_id != query_id")
    return evaluation.unique_documents(
        hits.select("stage", "query_id", F.col("chunk_id").alias("doc_id"), F.col("stage_rank").alias("rank")),
        ["stage", "query_id"],
    )


def unique_docs(spark, sf_dir):
    """Vectors as chunks of documents of seven: the first chunk places the document."""
    hits = _hits(spark, sf_dir).where("stage = 'd64'").select(
        "query_id",
        F.floor(F.col("chunk_id") / 7).alias("doc_id"),
        F.col("stage_rank").alias("rank"),
    )
    return evaluation.unique_documents(hits, ["query_id"]).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


def _metrics(spark, sf_dir):
    return evaluation.metrics(_run(spark, sf_dir), _judged(spark, sf_dir), [1, 3, 5, 10], ("stage",))


def eval_precision_recall(spark, sf_dir):
    return _metrics(spark, sf_dir).select(
        "stage",
        "query_id",
        F.col("k").cast("long").alias("k"),
        F.round("precision", 6).alias("precision"),
        F.round("recall", 6).alias("recall"),
    )


def eval_mrr(spark, sf_dir):
    return _metrics(spark, sf_dir).where("k = 1").select("stage", "query_id", F.round("mrr", 6).alias("mrr"))


def eval_ndcg(spark, sf_dir):
    return _metrics(spark, sf_dir).select(
        "stage",
        "query_id",
        F.col("k").cast("long").alias("k"),
        F.round("ndcg", 6).alias("ndcg"),
        F.round("ndcg_full", 6).alias("ndcg_full"),
    )


def eval_by_stage(spark, sf_dir):
    rows = evaluation.averages(_metrics(spark, sf_dir), ("stage",))
    return rows.select(
        "stage",
        F.col("k").cast("long").alias("k"),
        F.col("queries").cast("long").alias("queries"),
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "ndcg_full", "mrr")]
    )


EVAL_SQL = f"""{STAGED_SQL}, run AS (
  SELECT stage, query_id, chunk_id AS doc_id, row_number() OVER (PARTITION BY stage, query_id ORDER BY rank) AS rank FROM hits WHERE chunk_id <> query_id
), rel AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id FROM res q JOIN res c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
wanted AS (SELECT query_id, count(*) AS wanted FROM rel GROUP BY query_id),
marked AS (SELECT run.*, (rel.doc_id IS NOT NULL)::int::double AS gain FROM run LEFT JOIN rel USING (query_id, doc_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY stage, query_id ORDER BY gain DESC, rank) AS ideal FROM marked),
ks AS (SELECT unnest([1, 3, 5, 10])::bigint AS k),
sums AS (SELECT stage, query_id, k, count(*) FILTER (rank <= k AND gain > 0) AS hits, min(rank) FILTER (gain > 0) AS first,
  coalesce(sum(gain / log2(rank + 1)) FILTER (rank <= k), 0) AS dcg, coalesce(sum(gain / log2(ideal + 1)) FILTER (ideal <= k), 0) AS idcg FROM best, ks GROUP BY stage, query_id, k),
per AS (SELECT stage, query_id, k, hits::double / k AS precision, hits::double / wanted AS recall, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0::double END AS ndcg,
  dcg / list_sum(list_transform(generate_series(1, least(k, wanted)), lambda i: 1.0::double / log2(i + 1))) AS ndcg_full, coalesce(1.0::double / first, 0.0::double) AS mrr FROM sums JOIN wanted USING (query_id))"""


def filter_terms(spark, sf_dir):
    """Terms of filter values in both notations, as one text each."""
    rows = base.table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("u"))
    separated = F.concat(F.col("event_type"), F.lit("; "), F.col("u"), F.lit(" ,, X"))
    listed = F.concat(F.lit('["'), F.upper("event_type"), F.lit('", " ", "'), F.col("u"), F.lit(', y"]'))
    each = rows.select("event_id", F.explode(F.create_map(F.lit("separated"), separated, F.lit("listed"), listed)).alias("notation", "raw"))
    return each.select("event_id", "notation", F.array_join(filters.filter_terms(F.col("raw")), "|").alias("terms"))


def embed_stages(spark, sf_dir):
    """Stage vectors of passages, as documents and as queries are normalised."""
    texts = base.questions(spark, sf_dir)
    stages = Retrieval(stages=(Stage("d16", 16, 5, 0.5), Stage("d48", 48, 5, 0.5)))
    parts = [embedding.by_stage(texts, stages, id_col="query_id", query=q).withColumn("asked", F.lit(q)) for q in (False, True)]
    rows = parts[0].unionByName(parts[1]).select("query_id", "stage", "asked", F.posexplode("vector").alias("pos", "x"))
    return rows.select("query_id", "stage", "asked", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def engine_retrieve(spark, sf_dir):
    """The public API from documents to ranked chunks: ingestion, windows, vectors, search, fusion."""
    engine = Engine(
        spark,
        Settings(retrieval=Retrieval(stages=(Stage("coarse", 32, 20, 1.0),), lambda_similarity=1.0, zeta_structural_similarity=0.0)),
    )
    engine.add_documents(ingest.normalized(base.texts(spark, sf_dir)))
    rows = engine.retrieve(base.questions(spark, sf_dir))
    return rows.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


QUERIES = {
    f.__name__: f for f in (
        vector_l2_normalize,
        vector_slice_renorm,
        vector_pad_truncate,
        hash_embedding,
        vector_topk_dot,
        vector_topk_inverse_l2,
        vector_topk_blocks,
        stage_fusion,
        metadata_priors,
        weighted_fusion,
        metadata_filter_soft,
        filter_terms,
        structure_text,
        structural_similarity,
        unique_docs,
        eval_precision_recall,
        eval_mrr,
        eval_ndcg,
        eval_by_stage,
        embed_stages,
        engine_retrieve,
    )
}

_POS = "SELECT vec_id, i AS pos, round(v[i + 1], 6)::double AS x FROM (SELECT *, unnest(generate_series(0, len(v) - 1)) AS i FROM ({0}))"
_TOP = f"SELECT query_id, item_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS item_id, round({{0}}, 9) AS score FROM (SELECT vec_id, embedding::double[] AS e FROM embeddings) q, (SELECT vec_id, embedding::double[] AS e FROM embeddings) c WHERE q.vec_id % {EVERY} = 0)) WHERE rank <= {K}"
SQL = {
    "vector_l2_normalize": _POS.format(
        "SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM (SELECT vec_id, list_transform(embedding::double[], lambda x: x * 3) AS e FROM embeddings)"
    ),
    "vector_slice_renorm": "WITH s AS (SELECT vec_id, d AS dimension, list_slice(embedding::double[], 1, d) AS e FROM embeddings, (SELECT unnest([16, 32])::bigint AS d)), n AS (SELECT vec_id, dimension, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM s) SELECT vec_id, dimension, i AS pos, round(v[i + 1], 6) AS x FROM (SELECT *, unnest(generate_series(0, len(v) - 1)) AS i FROM n)",
    "vector_pad_truncate": _POS.format(
        "SELECT vec_id, list_transform(generate_series(1, 80), lambda i: coalesce(embedding[i]::double, 0.0)) AS v FROM embeddings"
    ),
    "hash_embedding": _POS.format(
        "SELECT item_id AS vec_id, list_transform(generate_series(0, 47), lambda i: cast('0x' || substr(sha256(text), 2 * (i % 32) + 1, 2) AS int) / 255.0::double) AS v FROM benchmark"
    ),
    "vector_topk_dot": _TOP.format("list_dot_product(q.e, c.e)"),
    "vector_topk_inverse_l2": _TOP.format(
        "1.0::double / (1.0::double + list_sum(list_transform(generate_series(1, len(q.e)), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i]))))"
    ),
    "vector_topk_blocks": _TOP.format("list_dot_product(q.e, c.e)"),
    "stage_fusion": f"WITH {STAGED_SQL} SELECT query_id, chunk_id, round(similarity, 6) AS similarity FROM summed",
    "metadata_priors": "SELECT d.doc_id, coalesce(try_cast(quality AS double), 0.0::double) AS reliability, coalesce(try_cast(CASE WHEN lang = 'en' THEN '0.' || d.doc_id ELSE lang END AS double), 0.0::double) AS recency_score, round(n_chars / 1000.0::double, 6) AS domain_score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "weighted_fusion": f"WITH {FUSED_SQL} SELECT query_id, chunk_id, round(similarity, 6) AS combined, round(weighted, 6) AS weighted, rank FROM placed WHERE rank <= {STAGES.stages[-1].top_k}",
    "metadata_filter_soft": f"WITH {FUSED_SQL}, m AS (SELECT p.*, (p.label = q.label OR p.label = 9) AS ok FROM placed p JOIN res q ON q.vec_id = p.query_id), kept AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS anyone FROM m) SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM kept WHERE ok OR NOT anyone) WHERE place <= {STAGES.stages[-1].top_k}",
    "filter_terms": "SELECT event_id, 'separated' AS notation, lower(event_type) || '|' || user_id || '|x' AS terms FROM events UNION ALL SELECT event_id, 'listed', lower(event_type) || '|' || user_id || ', y' FROM events",
    "embed_stages": f"""WITH v AS (SELECT cast(item_id AS varchar) AS query_id, d, list_transform(generate_series(0, d - 1), lambda i: cast('0x' || substr(sha256(text), 2 * (i % 32) + 1, 2) AS int) / 255.0::double) AS v FROM benchmark, (SELECT unnest([16, 48])::bigint AS d)),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS l FROM v)
SELECT query_id, 'd' || d AS stage, asked, i AS pos, round(v[i + 1] / (l + CASE WHEN asked THEN 1e-8::double ELSE 0 END), 6) AS x FROM (SELECT *, unnest(generate_series(0, d - 1)) AS i FROM n), (SELECT unnest([true, false]) AS asked)""",
    "engine_retrieve": f"""WITH {{chunks}}, c AS (SELECT chunk_id, {_hash_sql("array_to_string(t, ' ')")} AS v FROM chunks), q AS (SELECT cast(item_id AS varchar) AS query_id, {_hash_sql("text")} AS v FROM benchmark),
s AS (SELECT query_id, chunk_id, round(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(c.v, c.v)) * (sqrt(list_dot_product(q.v, q.v)) + 1e-8::double)), 12) AS s FROM q, c)
SELECT query_id, chunk_id, rank, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM s) WHERE rank <= 20""",
    "structure_text": f"WITH {STRUCTURE_SQL} SELECT table_id, text, normal FROM said",
    "structural_similarity": f"WITH {STRUCTURE_SQL}, q AS (SELECT cast(item_id AS varchar) AS query_id, {{hint}} AS h FROM benchmark), qv AS (SELECT query_id, {_hash_sql('h')} AS v FROM q), cv AS (SELECT table_id || '_full_table' AS chunk_id, {_hash_sql('text')} AS v FROM said) SELECT query_id, chunk_id, round(least(1.0::double, greatest(0.0::double, (list_dot_product(qv.v, cv.v) / sqrt(list_dot_product(qv.v, qv.v) * list_dot_product(cv.v, cv.v)) + 1) / 2)), 6) AS value FROM qv, cv",
    "unique_docs": f"WITH {STAGED_SQL}, f AS (SELECT query_id, chunk_id // 7 AS doc_id, min(rank) AS first FROM hits WHERE stage = 'd64' GROUP BY ALL) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY first, doc_id) AS rank FROM f",
    "eval_precision_recall": f"WITH {EVAL_SQL} SELECT stage, query_id, k, round(precision, 6) AS precision, round(recall, 6) AS recall FROM per",
    "eval_mrr": f"WITH {EVAL_SQL} SELECT stage, query_id, round(mrr, 6) AS mrr FROM per WHERE k = 1",
    "eval_ndcg": f"WITH {EVAL_SQL} SELECT stage, query_id, k, round(ndcg, 6) AS ndcg, round(ndcg_full, 6) AS ndcg_full FROM per",
    "eval_by_stage": f"WITH {EVAL_SQL} SELECT stage, k, count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(ndcg_full), 6) AS ndcg_full, round(avg(mrr), 6) AS mrr FROM per GROUP BY stage, k",
}


def _with_hint() -> None:
    from .text import CHUNKS_SQL, _hints_sql

    SQL["engine_retrieve"] = SQL["engine_retrieve"].replace("{chunks}", CHUNKS_SQL)

    SQL["structural_similarity"] = SQL["structural_similarity"].replace(
        "{hint}",
        _hints_sql(sx.HINTS, "Expected structure: ", "General table structure query"),
    )


_with_hint()
