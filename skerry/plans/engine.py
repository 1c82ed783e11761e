"""The engine: scrape, ingest, ask, evaluate and describe, for many questions at once."""

from __future__ import annotations

import time
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.config import Settings
from skerry.functions.text import is_abstention, page_doc_id
from skerry.operators import chunk, context, evaluate, fallback, providers, scrape
from skerry.session import cut
from skerry.sources import corpus, wiki
from skerry.sources.index import with_ordinals
from skerry.sources.store import store_of


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, provider: providers.Provider | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.provider = provider or providers.create(self.settings)
        self.index = store_of(spark, self.settings)

    def check_ready(self, judge: bool = False) -> list[str]:
        """Models that the server lacks; see ``providers.check_ready``."""
        s = self.settings
        return providers.check_ready(self.provider, [s.embed_model, s.chat_model, *([s.effective_judge] if judge else [])])

    # ------------------------------------------------------------ taking documents in

    def chunks_of(self, docs: DataFrame) -> DataFrame:
        """doc_id, title, body, meta to embedded chunks."""
        meta = F.struct(F.col("title"), *[F.coalesce(F.col("meta")[x], F.lit("")).alias(x) for x in ("universe", "source")])
        rows = chunk.chunk_documents(docs.withColumn("__m", meta), self.settings.chunk_chars, self.settings.chunk_overlap, text="body", metadata=F.col("__m"))
        return providers.with_embedding(rows, self.provider)

    def ingest(self, docs: DataFrame | None = None) -> dict[str, object]:
        docs = corpus.load_corpus(self.spark, self.settings.corpus_dir) if docs is None else docs
        if docs.isEmpty():
            raise FileNotFoundError(f"no documents in {self.settings.corpus_dir}")
        chunks = cut(self.chunks_of(docs))
        self.index.create(with_ordinals(chunks))
        n = chunks.agg(F.countDistinct("doc_id"), F.count("*")).first()
        return {"documents": n[0], "chunks": n[1], "location": self.settings.index_dir if self.settings.store == "local" else self.settings.server_url}

    def scrape(self, only_wiki: str | None = None, title: str | None = None) -> DataFrame:
        """Fetch the default pages, those of one wiki, or one named page of it; write corpus and manifest; a result row per page."""
        s = self.settings
        if only_wiki and only_wiki not in s.wiki_urls:
            raise ValueError(f"no wiki is called {only_wiki!r}; there are {', '.join(s.wiki_urls)}")
        if title and not only_wiki:
            raise ValueError("a title needs a wiki")
        pages = wiki.page_list(self.spark, s.pages_file)
        extra = self.spark.createDataFrame([(only_wiki, title)], "wiki string, title string") if title else None
        jobs = scrape.page_jobs(pages.limit(0) if title else pages, only_wiki, extra)
        fetched = cut(wiki.fetch_pages(jobs, s.wiki_urls, s.delay_s, s.retries))
        documents, results = self.store_pages(fetched)
        return results

    def store_pages(self, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Fetched pages to the corpus and the manifest; (documents, results) as ``scrape.documents_of`` gives them."""
        s = self.settings
        made = scrape.documents_of(fetched, time.strftime("%Y-%m-%d"), s.page_chars, s.least_page_chars)
        documents, results = (cut(x) for x in made)
        if not documents.isEmpty():
            corpus.write_corpus(corpus.corpus_page(documents), s.corpus_dir)
        corpus.update_manifest(self.spark, s.corpus_dir, results)
        return documents, results

    # ------------------------------------------------------------ questions

    def retrieve(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """Hits of questions (query_id, question) with their chunks' title, section, text and url."""
        s = self.settings
        queries = providers.with_query_vectors(questions.select("query_id", F.col("question").alias("text")), self.provider)
        return self.index.search(queries, k or s.top_k, s.alpha, s.per_doc, s.hybrid)

    def found(self, questions: DataFrame, k: int | None = None, pages: DataFrame | None = None, live: bool | None = None) -> tuple[DataFrame, DataFrame, float]:
        """(hits, fallback, seconds): hits after the fallback, and query_id, fallback_used, fallback_doc of every question."""
        began = time.perf_counter()
        hits = cut(self.retrieve(questions, k))
        used = questions.select("query_id").withColumns({"fallback_used": F.lit(False), "fallback_doc": F.lit("")})
        live = self.settings.fallback if live is None else live
        if live or pages is not None:
            low = fallback.needs_fallback(questions, hits, self.settings.fallback_score).filter("needs_fallback").select("query_id")
            asked = cut(questions.join(low, "query_id"))
            if not asked.isEmpty():
                got = self.fetch(asked, pages).filter("ok").select("query_id", F.col("doc_id").alias("__doc"))
                again = questions.join(got.select("query_id"), "query_id", "left_semi")
                if not again.isEmpty():
                    hits = cut(hits.join(got.select("query_id"), "query_id", "left_anti").unionByName(self.retrieve(again, k).select(*hits.columns)))
                used = questions.select("query_id").join(got, "query_id", "left")
                used = used.select("query_id", F.col("__doc").isNotNull().alias("fallback_used"), F.coalesce("__doc", F.lit("")).alias("fallback_doc"))
        return hits, used, time.perf_counter() - began

    def ask(self, questions: DataFrame, k: int | None = None, pages: DataFrame | None = None, live: bool | None = None) -> DataFrame:
        """query_id, question, answer, context, sources, fallback_used, fallback_doc, retrieval_seconds, total_seconds.

        What the index answers too badly is looked for in ``pages`` (wiki, title, url, html), or, unless the settings or ``live``
        say no, on the wikis. ``retrieval_seconds`` is the question's share of the batch's
        retrieval, ``total_seconds`` that and the time of its own answer.
        """
        hits, used, seconds = self.found(questions, k, pages, bool(pages is None and self.settings.fallback) if live is None else live)
        return self.answered(questions, hits, used, seconds)

    def answered(self, questions: DataFrame, hits: DataFrame, used: DataFrame, seconds: float) -> DataFrame:
        share = seconds / max(1, questions.count())
        prompts = context.prompts(hits, questions, self.settings.context_chars)
        answers = providers.with_answer(prompts, self.provider, system=context.SYSTEM, seconds="__s").select("query_id", "answer", "context", "__s")
        listed = context.sources(hits).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc", "title", "section", "score", "url"))).alias("sources"))
        rows = questions.join(answers, "query_id", "left").join(listed, "query_id", "left").join(used, "query_id")
        return rows.withColumn("retrieval_seconds", F.lit(share)).withColumn("total_seconds", F.lit(share) + F.coalesce("__s", F.lit(0.0))).drop("__s")

    def fetch(self, questions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
        """Take the best page for each question into the index: query_id, doc_id, ok, chunks_added, skipped_existing, error.

        Pages come from ``pages``, or by search from the wikis. One that the index has already is skipped, one that the
        corpus has is indexed from there, any other is fetched, written to corpus and manifest, and indexed. ``ok`` says that
        the page was added; a page that is too short or can't be had is refused with its error, never raised.
        """
        s = self.settings
        asked = questions.select("query_id", F.col("question").alias("query"))
        if pages is not None:
            keyed = pages.select(F.xxhash64("wiki", "title").alias("__page"), "wiki", "title").distinct()
            met = fallback.title_candidates(asked, keyed, "__page", s.fallback_results)
        else:
            results = wiki.search_wikis(asked, s.wiki_urls, s.fallback_results, s.delay_s, s.retries)
            met = fallback.search_scores(results, s.fallback_results).join(asked, "query_id")
        best = cut(fallback.best_candidates(cut(met)).withColumn("asked_id", page_doc_id(F.col("wiki"), F.col("title"))))
        wanted = best.select("wiki", "title", F.col("asked_id").alias("doc_id")).dropDuplicates(["doc_id"])
        known = cut(self.index.contains(wanted).select("doc_id"))
        missing = wanted.join(known, "doc_id", "left_anti")
        docs = None
        if corpus.exists(self.spark, s.corpus_dir):
            docs = corpus.load_corpus(self.spark, s.corpus_dir)
            docs = cut(docs.join(missing.select("doc_id"), "doc_id", "left_semi"))
            missing = missing.join(docs.select("doc_id"), "doc_id", "left_anti")
        if pages is not None:
            fetched = pages.join(missing.select("wiki", "title"), ["wiki", "title"]).dropDuplicates(["wiki", "title"])
            fetched = fetched.select(F.col("title").alias("asked"), "wiki", "title", "html", "url", F.lit(True).alias("ok"), F.lit("").alias("error"))
        else:
            fetched = wiki.fetch_pages(missing, s.wiki_urls, s.delay_s, s.retries)
        fetched = cut(fetched)
        got = cut(fetched.select(page_doc_id(F.col("wiki"), F.col("asked")).alias("asked_id"), page_doc_id(F.col("wiki"), F.col("title")).alias("doc_id")))
        made, results = self.store_pages(fetched) if not fetched.isEmpty() else (None, None)
        named = F.create_map(F.lit("universe"), F.col("universe"), F.lit("source"), F.col("source"))
        parts = [docs.select("doc_id", "title", "body", "meta")] if docs is not None else []
        parts += [made.select("doc_id", "title", "body", named.alias("meta"))] if made is not None else []
        added = self.spark.createDataFrame([], "doc_id string, n bigint")
        if parts:
            new = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            chunks = cut(self.chunks_of(new).withColumn("chunk_ord", F.lit(None).cast("bigint")))
            fresh = chunks.select("doc_id").distinct()
            old = cut(self.index.contains(fresh))
            added = cut(chunks.join(old, "doc_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n")))
            self.index.append(chunks)
        rows = best.select("query_id", "wiki", "asked_id").join(got, "asked_id", "left").withColumn("doc_id", F.coalesce("doc_id", "asked_id"))
        rows = rows.join(added, "doc_id", "left")
        if results is not None:
            failed = results.filter("not ok").select(page_doc_id(F.col("wiki"), F.col("title")).alias("doc_id"), F.col("error").alias("__e"))
            rows = rows.join(failed.dropDuplicates(["doc_id"]), "doc_id", "left")
        else:
            rows = rows.withColumn("__e", F.lit(None).cast("string"))
        ok = F.col("n").isNotNull()
        skipped = ~ok & F.col("__e").isNull()
        return cut(rows.select("query_id", "doc_id", ok.alias("ok"), F.coalesce("n", F.lit(0)).alias("chunks_added"), skipped.alias("skipped_existing"), F.when(ok, "").otherwise(F.coalesce("__e", F.concat(F.lit("index already has "), "doc_id"))).alias("error")))

    def evaluate(self, questions: DataFrame, retrieval_only: bool = False) -> tuple[DataFrame, DataFrame]:
        """(report, results by question) of an evaluation set; see ``sources.corpus.load_eval_set``.

        Without answers there is no fallback either. Judges read the texts of all hits, not the prompt's shortened ones.
        """
        asked = cut(questions.withColumnRenamed("id", "query_id"))
        hits, used, seconds = self.found(asked, live=False if retrieval_only else None)
        measures = evaluate.retrieval_measures(hits, evaluate.relevance_pairs(questions))
        listed = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("retrieved_docs"))
        results = asked.join(measures, "query_id", "left").join(listed, "query_id", "left")
        if retrieval_only:
            share = F.lit(seconds / max(1, asked.count()))
            results = results.withColumn("retrieval_seconds", share).withColumn("total_seconds", share)
        else:
            answers = cut(self.answered(asked.select("query_id", "question"), hits, used, seconds))
            rows = results.join(answers.select("query_id", "answer", "fallback_used", "retrieval_seconds", "total_seconds"), "query_id", "left")
            rows = rows.join(context.whole_context(hits), "query_id", "left")
            rows = rows.join(evaluate.token_f1(rows, "query_id", "answer", "reference_answer").withColumnRenamed("token_f1", "__f1"), "query_id")
            graded = providers.with_judgements(rows, providers.judge_of(self.provider, self.settings))
            for name in ("faithfulness", "relevance", "correctness"):
                graded = graded.withColumn(name, F.when(F.col("answerable"), F.col(name)))
            abstained = is_abstention(F.col("answer"))
            results = graded.withColumn("token_f1", F.when(F.col("answerable"), F.col("__f1"))).drop("__f1").withColumn("abstention_correct", F.when(~F.col("answerable"), abstained.cast("double")))
        results = cut(results)
        return evaluate.report(results), results

    def write_report(self, report: DataFrame, results: DataFrame, path: str, retrieval_only: bool = False) -> None:
        s = self.settings
        names = ("chat_model", "embed_model", "top_k", "chunk_chars", "hybrid", "alpha", "per_doc")
        config = {n: getattr(s, n) for n in names} | {"judge_model": s.effective_judge, "retrieval_only": retrieval_only, "fallback": s.fallback and not retrieval_only}
        corpus.write_report(report, results, config, path)

    def describe(self) -> dict[str, object]:
        return {**{k: v for k, v in asdict(replace(self.settings, judge_model=self.settings.effective_judge)).items() if k != "api_key"}, "model_server": self.provider.describe(), "chunks": self.index.count()}
