"""The public API: ingest, index, retrieve and answer, for batches of documents and questions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CrossEncoder, Embedding, Generation, Settings
from .functions import text as tx
from .operators import bm25, chunking, embedding, fusion, generation, index, rerank, structural, table_chunks
from .sources import ingest, store


@dataclass
class Plugins:
    """Models that aren't part of the library; what is absent has a deterministic stand-in or is left out."""

    encoders: dict[str, embedding.Encoder] = field(default_factory=dict)
    scorer: Callable[[Column, Column], Column] | None = rerank.overlap_score
    generator: Callable[[Column], Column] | None = None
    #: Makers of models that each worker calls once; they take the settings of their kind. They stand before the above.
    make_encoder: Callable[[Embedding, str], embedding.ModelMaker] | None = None
    make_scorer: Callable[[CrossEncoder], rerank.ScorerMaker] | None = None
    make_generator: Callable[[Generation], generation.GeneratorMaker] | None = None

    def encoders_of(self, settings: Settings) -> dict[str, embedding.Encoder]:
        if self.make_encoder is None:
            return self.encoders
        named = {s.name: s.model_name or settings.embedding.model_name for s in settings.retrieval.stages}
        return {
            stage: embedding.model_encoder(self.make_encoder(settings.embedding, model), settings.embedding.batch_size) for stage,
            model in named.items()
        }

    def scorer_of(self, settings: CrossEncoder) -> Callable[[Column, Column], Column] | None:
        return rerank.pair_scorer(self.make_scorer(settings), settings.batch_size) if self.make_scorer else self.scorer

    def generator_of(self, settings: Generation) -> Callable[[Column], Column] | None:
        return generation.generator(self.make_generator(settings)) if self.make_generator else self.generator


@dataclass
class Engine:
    """Chunks and their vectors as files; each call extends or reads them, nothing is held on the driver."""

    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    plugins: Plugins = field(default_factory=Plugins)
    #: (table_id, structure) records; needed if structural similarity has weight.
    structures: DataFrame | None = None
    #: A folder whose vectors of structures are used again; without one they live as long as the session.
    structure_cache: str | None = None
    chunks: DataFrame | None = None
    vectors: DataFrame | None = None
    _words: bm25.Statistics | None = None
    _structure_vectors: DataFrame | None = None

    def ingest_path(self, source: str, **options) -> DataFrame:
        return ingest.normalized(ingest.documents(self.spark, source, **options))

    def add_documents(self, docs: DataFrame) -> DataFrame:
        """Chunks the documents and adds chunks and vectors to the index; returns the chunks."""
        new = chunking.token_chunks(docs, self.settings.chunking).drop("chunk_index")
        return self.add_chunks(new)

    def add_batches(self, batches: Iterable[DataFrame]) -> list[tuple[int, str]]:
        """Adds batches of documents one by one; a batch that fails is left out, and named with what went wrong."""
        failed = []
        for place, docs in enumerate(batches):
            try:
                self.add_documents(docs)
            except (PySparkException, ValueError) as e:
                failed.append((place, str(e)))
        return failed

    def add_tables(self, tables: DataFrame) -> DataFrame:
        """Chunks of processed tables, in the grains that the settings enable."""
        rows = table_chunks.general_chunks(store.kept(tables), self.settings.chunking.enabled_chunk_types)
        meta = F.create_map(F.lit("chunk_type"), F.col("chunk_type"), F.lit("table_id"), F.col("table_id"))
        return self.add_chunks(
            rows.select(
                F.col("id").alias("chunk_id"),
                F.col("table_id").alias("doc_id"),
                F.col("content").alias("text"),
                F.lit(0).alias("start_char"),
                F.lit(0).alias("end_char"),
                F.size(tx.words(F.col("content"))).alias("token_count"),
                meta.alias("metadata"),
            )
        )

    def add_chunks(self, new: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """Ready-made chunks, with vectors (chunk_id, stage, vector) or without; both are made once and kept."""
        new = store.kept(new)
        if vectors is None:
            vectors = embedding.by_stage(
                new,
                self.settings.retrieval,
                id_col="chunk_id",
                settings=self.settings.embedding,
                encoders=self.plugins.encoders_of(self.settings),
            )
        else:
            index.checked_stages(new, vectors, self.settings.retrieval)
        vectors = store.kept(vectors)
        self.chunks = new if self.chunks is None else self.chunks.unionByName(new)
        self.vectors = vectors if self.vectors is None else self.vectors.unionByName(vectors)
        self._words = None
        return new

    def save(self, root: str | None = None) -> str:
        """Writes chunks and vectors under their content key, and reads the index from there from now on. Without a folder
        they go to that of the settings and the run."""
        self._indexed()
        root = root or f"{self.settings.storage_dir}/{self.settings.run_name}"
        key = store.content_key({"chunks": self.chunks}, self.settings)
        store.save({"chunks": self.chunks, "vectors": self.vectors}, root, key)
        self.load(root, key)
        return key

    def load(self, root: str, key: str) -> bool:
        found = store.load(self.spark, root, key, ["chunks", "vectors"])
        if found:
            self.chunks, self.vectors, self._words = found["chunks"], found["vectors"], None
        return found is not None

    def _indexed(self) -> None:
        if self.chunks is None:
            raise RuntimeError("the index is empty: add documents first")

    def search(self, queries: DataFrame) -> DataFrame:
        """Candidates of every stage for (query_id, text)."""
        self._indexed()
        asked = embedding.by_stage(
            queries,
            self.settings.retrieval,
            id_col="query_id",
            settings=self.settings.embedding,
            encoders=self.plugins.encoders_of(self.settings),
            query=True,
        )
        return index.search(asked, self.vectors, self.settings.retrieval)

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """Ranked chunks with all scores for (query_id, text, metadata), reranked as the settings say."""
        return self.retrieve_with_details(queries)[0]

    def retrieve_with_details(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Ranked chunks, and the candidates of each stage."""
        retrieval = self.settings.retrieval
        if "metadata" not in queries.columns:
            queries = queries.withColumn("metadata", F.create_map().cast("map<string,string>"))
        hits = self.search(queries)
        pairs = hits.select("query_id", "chunk_id").distinct()
        words = similar = None
        if retrieval.epsilon_bm25:
            self._words = self._words or bm25.fit(self.chunks, "chunk_id")
            raw = bm25.scores(queries, self._words, candidates=pairs.withColumnRenamed("chunk_id", "item_id"))
            words = raw.select(
                "query_id",
                F.col("item_id").alias("chunk_id"),
                bm25.normalized(F.col("score"), self._words.mean_length).alias("value"),
            )
        if retrieval.enable_structural_similarity and retrieval.zeta_structural_similarity and self.structures is not None:
            stage = retrieval.stages[0]
            encode = self.plugins.encoders_of(self.settings).get(stage.name, embedding.hash_encoder)
            if self._structure_vectors is None:
                self._structure_vectors = structural.cached_vectors(
                    self.structures,
                    self.structure_cache or store.new_folder(self.spark),
                    stage.dimension,
                    encode,
                )
            similar = structural.scores(pairs, queries, self.chunks, self._structure_vectors, stage.dimension, encode)
        rows = fusion.fuse(hits, self.chunks, queries, retrieval, bm25=words, structural=similar)
        asked = queries.select("query_id", F.col("text").alias("question"))
        if self.settings.cross_encoder is not None:
            rows = rerank.pairs(
                rows.join(asked, "query_id"),
                self.settings.cross_encoder.top_n,
                self.plugins.scorer_of(self.settings.cross_encoder),
            ).drop("question")
        if self.settings.use_graph_rerank:
            rows = rerank.graph(rows)
        return rows.withColumn("scores", fusion.score_map()), hits

    def answer(self, queries: DataFrame, system_prompt: str | None = None) -> DataFrame:
        """(query_id, question, prompt, answer, references, metadata) for all queries."""
        ranked = self.retrieve(queries)
        held = generation.contexts(queries, ranked)
        return generation.answers(
            held,
            system_prompt or self.settings.generation.system_prompt,
            self.plugins.generator_of(self.settings.generation),
        )

    def structure_of(self, chunks: DataFrame) -> DataFrame:
        """Structure records from table structure chunks, kept for structural similarity."""
        from .sources.tables import structures

        self.structures, self._structure_vectors = structures(chunks), None
        return self.structures
