"""Queries over texts: ingestion, chunks, tokens, words of answers, prompts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import structure as sx
from ..functions import text as tx
from ..operators import bm25, chunking, generation, prompt_search, rerank
from ..sources import ingest, store
from . import base

K = 10


def ingest_normalize(spark, sf_dir):
    rows = ingest.normalized(base.texts(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.col("metadata")["lang"].alias("lang"),
        F.col("metadata")["source"].alias("source"),
    )


def chunk_token_windows(spark, sf_dir):
    rows = chunking.token_chunks(base.texts(spark, sf_dir))
    return rows.select(
        "chunk_id",
        "doc_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("token_count").cast("long").alias("token_count"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


CHUNKS_SQL = f"""w AS (SELECT cast(doc_id AS varchar) AS doc_id, lang, {base.words_sql("text")} AS t FROM documents),
starts AS (SELECT *, unnest(generate_series(0, len(t) - 1, 480)) AS s FROM w WHERE len(t) > 0),
chunks AS (SELECT doc_id || '__' || printf('%05d', s // 480) AS chunk_id, doc_id, lang, s // 480 AS chunk_index, list_slice(t, s + 1, s + 512) AS t FROM starts)"""


def chunk_stats(spark, sf_dir):
    rows = chunking.token_chunks(base.texts(spark, sf_dir)).select(F.col("metadata")["lang"].alias("lang"), F.col("text").alias("content"))
    out = chunking.chunk_lengths(rows, "lang")
    counts = [c for c in out.columns if c not in ("lang", "avg_length")]
    return out.select(
        F.coalesce("lang", F.lit("all")).alias("lang"),
        *[F.col(c).cast("long").alias(c) for c in counts],
        F.round("avg_length", 6).alias("avg_length")
    )


STATS = "count(*) AS chunks, cast(sum(length(c)) AS bigint) AS total_length, min(length(c)) AS min_length, max(length(c)) AS max_length, count(*) FILTER (length(c) < 200) AS short, count(*) FILTER (length(c) >= 200 AND length(c) < 800) AS medium, count(*) FILTER (length(c) >= 800 AND length(c) < 1500) AS long, count(*) FILTER (length(c) >= 1500) AS very_long, round(avg(length(c)), 6) AS avg_length"


def sentence_split(spark, sf_dir):
    rows = base.table(spark, sf_dir, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return rows.select(
        "doc_id",
        F.size("s").cast("long").alias("n_sentences"),
        F.md5(F.array_join("s", "\n").cast("binary")).alias("sentences_md5"),
    )


def bm25_tokens(spark, sf_dir):
    rows = base.table(spark, sf_dir, "documents").select("doc_id", tx.rank_tokens(F.col("text")).alias("t"))
    return rows.select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"),
    )


def bm25_doc_freq(spark, sf_dir):
    return bm25.document_frequencies(base.table(spark, sf_dir, "documents"), "doc_id").select("term", F.col("df").cast("long").alias("df"))


def bm25_idf(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents")
    return bm25.document_frequencies(docs, "doc_id").select("term", F.round(bm25.idf(bm25.documents(docs)), 6).alias("idf"))


def _top(spark, sf_dir):
    asked = base.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    known = bm25.fit(base.table(spark, sf_dir, "documents"), "doc_id", terms=bm25.tokens(asked, "query_id"))
    return known, bm25.top_k(asked, known, K)


def bm25_topk(spark, sf_dir):
    """The flagship: the ten best documents for each benchmark passage."""
    _, top = _top(spark, sf_dir)
    return top.select(
        F.col("query_id").alias("item_id"),
        F.col("item_id").alias("doc_id"),
        F.col("stage_rank").cast("long").alias("rank"),
        F.round("score", 6).alias("score"),
    )


def bm25_normalized(spark, sf_dir):
    known, top = _top(spark, sf_dir)
    return top.select(
        F.col("query_id").alias("item_id"),
        F.col("item_id").alias("doc_id"),
        F.round(bm25.normalized(F.col("score"), known.mean_length), 6).alias("score"),
    )


BM25_SQL = f"""toks AS (SELECT doc_id, {base.tokens_sql("text")} AS t FROM documents WHERE regexp_matches(text, '\\S')),
stats AS (SELECT count(*)::double AS n, avg(len(t)) AS mean FROM toks),
post AS (SELECT doc_id, len, term, count(*)::double AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM toks) GROUP BY ALL),
freq AS (SELECT term, count(*)::double AS df FROM post GROUP BY term),
ask AS (SELECT item_id, term, count(*)::double AS qtf FROM (SELECT item_id, unnest({base.tokens_sql("text")}) AS term FROM benchmark) GROUP BY ALL),
gain AS (SELECT item_id, doc_id, CASE WHEN df IS NULL THEN 0.25::double * ln(n + 1) * qtf ELSE
  greatest(0.1::double, ln(greatest(1.1::double, (n - df + 0.5::double) / (df + 0.5::double)))) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / mean)) * qtf * 2.2::double / (qtf + 1.2::double) END AS g
  FROM post JOIN ask USING (term) LEFT JOIN freq USING (term), stats),
summed AS (SELECT item_id, doc_id, round(sum(g), 9) AS score FROM gain GROUP BY item_id, doc_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM summed) WHERE rank <= {K})"""


def answer_exact_match(spark, sf_dir):
    rows = base.answer_pairs(spark, sf_dir)
    return rows.select("conv_id", "turn", tx.exact_match(F.col("question"), F.col("answer")).alias("exact"))


def answer_f1(spark, sf_dir):
    rows = base.answer_pairs(spark, sf_dir)
    return rows.select("conv_id", "turn", F.round(tx.answer_f1(F.col("question"), F.col("answer")), 6).alias("f1"))


def prompt_f1(spark, sf_dir):
    rows = base.answer_pairs(spark, sf_dir)
    return rows.select("conv_id", "turn", F.round(tx.prompt_f1(F.col("answer"), F.col("question")), 6).alias("f1"))


def _f1_sql(part: str, empty: str) -> str:
    return f"""WITH {base.ANSWERS_SQL}, parts AS (SELECT conv_id, turn, {part.format("question")} AS a, {part.format("answer")} AS b FROM pairs),
shared AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0)::double AS s FROM parts)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN {empty} WHEN s = 0 THEN 0.0 ELSE 2 * (s / len(a)) * (s / len(b)) / (s / len(a) + s / len(b)) END, 6)::double AS f1 FROM shared"""


_NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


def nq_table_like(spark, sf_dir):
    pages = base.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
        F.col("html").alias("t"),
    )
    docs = base.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.col("text").alias("t"),
    )
    return pages.union(docs).select("id", tx.table_like(F.col("t")).alias("table_like"))


_MARKS = " OR ".join(f"contains(lower(t), '{m}')" for m in tx.TABLE_MARKS)
TABLE_LIKE_SQL = rf"""WITH src AS (SELECT 'p' || page_id AS id, html AS t FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents),
cut AS (SELECT *, string_split(regexp_replace(t, '^\s+|\s+$', '', 'g'), chr(10)) AS lines FROM src),
sized AS (SELECT *, list_filter(list_transform(list_slice(lines, 1, 10), lambda l: len({base.words_sql("l")})), lambda n: n >= 3) AS c FROM cut),
mean AS (SELECT *, list_sum(c)::double / len(c) AS m FROM sized)
SELECT id, coalesce(({_MARKS}) OR (length(lower(t)) - length(replace(lower(t), '<li>', ''))) // 4 >= 3
  OR (len(lines) >= 3 AND (contains(t, chr(9)) OR length(t) - length(replace(t, '|', '')) >= 4))
  OR (len(lines) >= 4 AND len(c) >= 3 AND len(list_filter(c, lambda n: abs(n - m) <= m * 0.5)) >= 3), false) AS table_like FROM mean"""


def html_text(spark, sf_dir):
    rows = base.table(spark, sf_dir, "pages").select("page_id", tx.html_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


def structure_hints(spark, sf_dir):
    rows = base.table(spark, sf_dir, "conversations")
    return rows.select(
        "conv_id",
        "turn",
        sx.query_structure(F.col("text")).alias("hints"),
        sx.rich_query_structure(F.col("text")).alias("rich_hints"),
    )


def _hints_sql(groups, prefix, nothing):
    cases = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN '{name}' END" for name, words in groups)
    found = f"list_filter([{cases}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN '{prefix}' || array_to_string({found}, ', ') ELSE '{nothing}' END"


def pair_rerank_topn(spark, sf_dir):
    _, top = _top(spark, sf_dir)
    docs = base.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    asked = base.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = _with_texts(top, docs).join(asked, "query_id").select(
        "query_id",
        "question",
        F.col("item_id").alias("chunk_id"),
        "text",
        F.col("stage_rank").alias("rank"),
        F.col("score").alias("similarity"),
    )
    out = rerank.pairs(rows, 5)
    return out.select(
        F.col("query_id").alias("item_id"),
        F.col("chunk_id").alias("doc_id"),
        F.col("rank").cast("long").alias("rank"),
        F.round("similarity", 6).alias("score"),
    )


PAIR_SQL = f"""WITH {BM25_SQL}, held AS (
  SELECT top.item_id, top.doc_id, top.rank AS before, list_distinct({base.tokens_sql("b.text")}) AS q, list_distinct({base.tokens_sql("d.text")}) AS t
  FROM top JOIN documents d ON d.doc_id = top.doc_id JOIN benchmark b ON b.item_id = top.item_id
), scored AS (SELECT item_id, doc_id, before, CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda x: list_contains(t, x)))::double / len(q) ELSE 0 END AS s FROM held),
again AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, before, doc_id) AS rank FROM scored)
SELECT item_id, doc_id, rank, round(s, 6)::double AS score FROM again WHERE rank <= 5"""


def graph_rerank(spark, sf_dir):
    _, top = _top(spark, sf_dir)
    docs = base.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    rows = _with_texts(top, docs).select(
        "query_id",
        F.col("item_id").alias("chunk_id"),
        "text",
        F.col("stage_rank").alias("rank"),
        F.col("score").alias("similarity"),
    )
    out = rerank.graph(rows)
    return out.select(
        F.col("query_id").alias("item_id"),
        F.col("chunk_id").alias("doc_id"),
        F.col("rank").cast("long").alias("rank"),
        F.col("degree").cast("long").alias("degree"),
        F.round("similarity", 6).alias("score"),
    )


GRAPH_SQL = f"""WITH {BM25_SQL}, held AS (
  SELECT top.*, list_distinct({base.words_sql("lower(d.text)")}) AS w FROM top JOIN documents d ON d.doc_id = top.doc_id
), met AS (
  SELECT a.item_id, a.doc_id, count(*) FILTER (b.doc_id IS NOT NULL AND len(list_intersect(a.w, b.w))::double / greatest(1, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.1::double) AS degree
  FROM held a LEFT JOIN held b ON a.item_id = b.item_id AND a.rank <> b.rank GROUP BY a.item_id, a.doc_id
), again AS (SELECT item_id, doc_id, degree, score + 0.05::double * degree AS s, rank AS before FROM top JOIN met USING (item_id, doc_id))
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, before, doc_id) AS rank, degree, round(s, 6) AS score FROM again"""


def _with_texts(top, docs):
    """top with its texts: what was found is kept, and few rows, as counted, are sent to the documents."""
    top = store.kept(top)
    few = top.limit(bm25.BROADCAST_ROWS + 1).count() <= bm25.BROADCAST_ROWS
    return docs.join(F.broadcast(top) if few else top, "item_id")


def _contexts(spark, sf_dir):
    _, top = _top(spark, sf_dir)
    docs = base.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    rows = _with_texts(top, docs).select(
        "query_id",
        F.col("item_id").cast("string").alias("chunk_id"),
        "text",
        F.col("stage_rank").alias("rank"),
    )
    asked = base.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return generation.contexts(asked, rows)


def prompt_build(spark, sf_dir):
    rows = _contexts(spark, sf_dir).select("query_id", generation.prompt("Use the context.").alias("p"))
    return rows.select(
        F.col("query_id").alias("item_id"),
        F.length("p").cast("long").alias("n_chars"),
        F.md5(F.col("p").cast("binary")).alias("prompt_md5"),
    )


def fallback_answer(spark, sf_dir):
    rows = generation.answers(_contexts(spark, sf_dir), "Use the context.")
    return rows.select(F.col("query_id").alias("item_id"), "answer", F.array_join("references", ",").alias("refs"))


def _echo(prompt):
    """A stand-in for a model whose answer depends on all of its prompt: the end of it, by its length."""
    return F.right(prompt, F.lit(30) + F.length(prompt) % 200)


def _prompt_search(spark, sf_dir):
    examples = base.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("reference_answer"))
    # Each step of the search reads the contexts, which are few texts of many.
    return store.kept(_contexts(spark, sf_dir)), examples


def prompt_search_step(spark, sf_dir):
    """Mean F1 of answers, against each passage itself, for the base prompt and its first candidates."""
    held, examples = _prompt_search(spark, sf_dir)
    prompts = ["Use the context.", *prompt_search.candidates("Use the context.", prompt_search.Search())]
    found = prompt_search.scored(prompts, held, examples, _echo)
    return spark.createDataFrame([(p, round(found[p], 6)) for p in prompts], "prompt string, score double")


def prompt_search_best(spark, sf_dir):
    """Where one step of the search ends."""
    held, examples = _prompt_search(spark, sf_dir)
    prompt, steps = prompt_search.optimize("Use the context.", held, examples, prompt_search.Search(max_steps=1, min_gain=0.001), _echo)
    return spark.createDataFrame([(prompt, len(steps) - 1, round(steps[-1]["score"], 6))], "prompt string, steps long, score double")


def jsonl_documents(spark, sf_dir):
    """documents written as JSON lines and read back as a source."""
    path = f"{store.shared_folder(spark)}/documents-{uuid.uuid4().hex}.jsonl"
    base.table(spark, sf_dir, "documents").select(F.format_string("d%d", "doc_id").alias("id"), "text", "lang", "source").write.json(path)
    rows = ingest.normalized(ingest.documents(spark, path))
    return rows.select(
        "doc_id",
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.col("metadata")["lang"].alias("lang"),
        F.col("metadata")["source"].alias("source"),
    )


_JOINED = "top JOIN documents d ON d.doc_id = top.doc_id"
_FALLBACK = f"'{generation.NO_MODEL}' || coalesce(chr(10) || x, '')"
_ITEMS = f"b.item_id, b.text AS q, string_agg('[' || top.doc_id || '] ' || regexp_replace(d.text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY rank) AS c, string_agg('- [' || top.doc_id || '] ' || substr(d.text, 1, 150) || '...', chr(10) ORDER BY rank) AS x, string_agg(cast(top.doc_id AS varchar), ',' ORDER BY rank) AS refs FROM benchmark b LEFT JOIN ({_JOINED}) ON top.item_id = b.item_id GROUP BY b.item_id, b.text"
_HELD_SQL = f"WITH {BM25_SQL}, held AS (SELECT {_ITEMS})"
_PROMPTS = ["Use the context.", *prompt_search.candidates("Use the context.", prompt_search.Search())]
_FIRST_STEP = ["Use the context.", *prompt_search.candidates("Use the context.", prompt_search.Search(), 1)]
_PROMPT_ROWS, _FIRST_STEP_ROWS = (
    ", ".join(f"({i}::bigint, '" + p.replace("'", "''") + "')" for i, p in enumerate(x)) for x in (_PROMPTS, _FIRST_STEP)
)
_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"

_SEARCH_SQL = f"""{BM25_SQL}, held AS (SELECT {_ITEMS}), prompts AS (
  SELECT place, prompt, q, prompt || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(nullif(c, ''), '{generation.NO_CONTEXT}') || chr(10) || chr(10) || 'Question: ' || q || chr(10) || 'Answer:' AS p
  FROM held, (VALUES {{rows}}) v(place, prompt)
), parts AS (SELECT place, prompt, {_WORDS.format("right(p, 30 + length(p) % 200)")} AS a, {_WORDS.format("q")} AS b FROM prompts),
shared AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0)::double AS s FROM parts),
means AS (SELECT place, prompt, avg(CASE WHEN s = 0 THEN 0.0::double ELSE 2 * (s / len(a)) * (s / len(b)) / (s / len(a) + s / len(b)) END) AS f FROM shared GROUP BY place, prompt)"""

QUERIES = {
    f.__name__: f for f in (
        ingest_normalize,
        chunk_token_windows,
        chunk_stats,
        sentence_split,
        bm25_tokens,
        bm25_doc_freq,
        bm25_idf,
        bm25_topk,
        bm25_normalized,
        answer_exact_match,
        answer_f1,
        prompt_f1,
        nq_table_like,
        html_text,
        structure_hints,
        pair_rerank_topn,
        graph_rerank,
        prompt_build,
        fallback_answer,
        prompt_search_step,
        prompt_search_best,
        jsonl_documents,
    )
}
SQL = {
    "ingest_normalize": "SELECT cast(doc_id AS varchar) AS doc_id, md5(text) AS text_md5, lang, source FROM documents",
    "chunk_token_windows": f"WITH {CHUNKS_SQL} SELECT chunk_id, doc_id, chunk_index, len(t) AS token_count, md5(array_to_string(t, ' ')) AS text_md5 FROM chunks",
    "chunk_stats": f"WITH {CHUNKS_SQL}, c AS (SELECT lang, array_to_string(t, ' ') AS c FROM chunks) SELECT lang, {STATS} FROM c GROUP BY lang UNION ALL SELECT 'all', {STATS} FROM c",
    "sentence_split": r"WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, chr(10))) AS sentences_md5 FROM s",
    "bm25_tokens": f"WITH t AS (SELECT doc_id, {base.tokens_sql('text')} AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t",
    "bm25_doc_freq": f"WITH {BM25_SQL} SELECT term, cast(df AS bigint) AS df FROM freq",
    "bm25_idf": f"WITH {BM25_SQL} SELECT term, round(greatest(0.1::double, ln(greatest(1.1::double, (n - df + 0.5::double) / (df + 0.5::double)))), 6) AS idf FROM freq, stats",
    "bm25_topk": f"WITH {BM25_SQL} SELECT item_id, doc_id, rank, round(score, 6) AS score FROM top",
    "bm25_normalized": f"WITH {BM25_SQL} SELECT item_id, doc_id, round(1.0::double / (1.0::double + exp(-score / (5.0::double + ln(mean + 1)))), 6) AS score FROM top, stats",
    "answer_exact_match": f"WITH {base.ANSWERS_SQL} SELECT conv_id, turn, cast({_NORMAL.format('question')} = {_NORMAL.format('answer')} AS double) AS exact FROM pairs",
    "answer_f1": _f1_sql(
        f"list_filter(string_split({_NORMAL}, ' '), lambda x: x <> '')",
        "CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE 0.0 END",
    ),
    "prompt_f1": _f1_sql(_WORDS, "0.0"),
    "nq_table_like": TABLE_LIKE_SQL,
    "html_text": r"WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages) SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM t",
    "structure_hints": f"SELECT conv_id, turn, {_hints_sql(sx.HINTS, 'Expected structure: ', 'General table structure query')} AS hints, {_hints_sql(sx.RICH_HINTS, 'Query structure: ', 'General table query')} AS rich_hints FROM conversations",
    "pair_rerank_topn": PAIR_SQL,
    "graph_rerank": GRAPH_SQL,
    "prompt_build": f"{_HELD_SQL}, p AS (SELECT item_id, 'Use the context.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(nullif(c, ''), '{generation.NO_CONTEXT}') || chr(10) || chr(10) || 'Question: ' || q || chr(10) || 'Answer:' AS p FROM held) SELECT item_id, length(p) AS n_chars, md5(p) AS prompt_md5 FROM p",
    "fallback_answer": f"{_HELD_SQL} SELECT item_id, {_FALLBACK} AS answer, coalesce(refs, '') AS refs FROM held",
    "prompt_search_step": f"WITH {_SEARCH_SQL.replace("{rows}", _PROMPT_ROWS)} SELECT prompt, round(f, 6) AS score FROM means",
    "prompt_search_best": f"""WITH RECURSIVE {_SEARCH_SQL.replace("{rows}", _FIRST_STEP_ROWS)},
walk AS (SELECT 0::bigint AS n, prompt, f FROM means WHERE place = 0 UNION ALL
  SELECT m.place, CASE WHEN m.f > w.f + 0.001 THEN m.prompt ELSE w.prompt END, CASE WHEN m.f > w.f + 0.001 THEN m.f ELSE w.f END FROM walk w JOIN means m ON m.place = w.n + 1)
SELECT prompt, cast(prompt <> 'Use the context.' AS bigint) AS steps, round(f, 6) AS score FROM walk WHERE n = {len(_FIRST_STEP) - 1}""",
    "jsonl_documents": "SELECT 'd' || doc_id AS doc_id, md5(text) AS text_md5, lang, source FROM documents",
}
