"""Queries of the engine's operators over the project's tables, and SQL that gives the same rows.

The questions of the evaluation set are the queries; a question's vector is that of the
first chunk of its first relevant document, so that no model is needed to compare results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import text as X
from skerry.functions.vectors import norm, unit
from skerry.operators import chunk, context, evaluate, fallback, html, lexical, manifest, pairs, providers, scrape, search
from skerry.session import checkpoint_folder, cut, table
from skerry.sources import corpus
from skerry.sources.index import ChunkIndex, kept_index, with_ordinals
from skerry.streaming.append import follow_latencies


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, text, vector of each question."""
    asked = table(spark, folder, "eval_questions").select(F.col("id").alias("query_id"), F.col("question").alias("text"), F.get("relevant_docs", F.lit(0)).alias("doc_id"))
    known = table(spark, folder, "chunks").select("doc_id", "chunk_ord", "embedding").filter("embedding is not null")
    first = known.join(asked.select("doc_id").distinct(), "doc_id").groupBy("doc_id").agg(F.min_by("embedding", "chunk_ord").alias("vector"))
    return asked.join(first, "doc_id", "left").select("query_id", "text", "vector")


def _index(spark: SparkSession, folder: str) -> search.SearchIndex:
    """The search index of the chunks, made at the first query over these files and kept in the shared folder."""
    return kept_index(table(spark, folder, "chunks"), table(spark, folder, "chunks", wide=True))


def _hits(spark: SparkSession, folder: str, **options) -> DataFrame:
    return search.search(_queries(spark, folder), _index(spark, folder), **options)


def _hits_with_chunks(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select("chunk_ord", "text", "section", F.col("metadata.title").alias("title"), F.col("metadata.source").alias("url"))
    return cut(_hits(spark, folder)).join(chunks, "chunk_ord")


def tokenize_counts(spark, folder):
    return lexical.lengths(table(spark, folder, "chunks"))


def term_df(spark, folder):
    return lexical.build(table(spark, folder, "chunks", wide=True)).terms


def bm25_stats(spark, folder):
    return lexical.build(table(spark, folder, "chunks", wide=True)).stats.select("n_chunks", F.round("avgdl", 6).alias("avgdl"))


def bm25_scores(spark, folder):
    asked = table(spark, folder, "eval_questions")
    scores = pairs.bm25_pairs(table(spark, folder, "chunks", wide=True), asked, query_key="id")
    return scores.select("query_id", F.col("chunk").alias("chunk_ord"), "score")


def bm25_topk(spark, folder):
    asked = table(spark, folder, "eval_questions").select(F.col("id").alias("query_id"), F.col("question").alias("text"), F.lit(None).cast("array<float>").alias("vector"))
    hits = search.search(asked, _index(spark, folder), per_doc=0, lexical_only=True)
    return hits.select("query_id", "rank", "chunk_ord", "score")


def l2_normalise(spark, folder):
    rows = table(spark, folder, "chunks").select("chunk_ord", F.round(norm(F.col("embedding")), 5).alias("norm"), unit(F.col("embedding")).alias("u"))
    return rows.select("chunk_ord", "norm", F.transform("u", lambda x: F.round(x, 6)).alias("unit"))


def _vector_queries(spark, folder):
    rows = table(spark, folder, "embeddings").filter("vec_id % 50 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), F.lit(None).cast("string").alias("text"), F.col("embedding").alias("vector"))


def _vectors(spark, folder):
    return search.build_index(table(spark, folder, "embeddings"), "vec_id", "label", None)


def dense_topk(spark, folder):
    return search.search(_vector_queries(spark, folder), _vectors(spark, folder), per_doc=0, hybrid=False)


def dense_topk_diverse(spark, folder):
    return search.search(_vector_queries(spark, folder), _vectors(spark, folder), per_doc=2, hybrid=False)


def minmax_scores(spark, folder):
    rows = table(spark, folder, "search_hits").filter("score is not null and not isnan(score)").select("query_id", "chunk_id", "scorer", "score").distinct()
    return search.minmax(rows, ["query_id", "scorer"], "score").select("query_id", "chunk_id", "scorer", F.round("scaled", 6).alias("scaled"))


def hybrid_topk(spark, folder):
    return _hits(spark, folder, per_doc=0)


def hybrid_topk_diverse(spark, folder):
    return _hits(spark, folder)


def candidate_rerank(spark, folder):
    return search.rerank_candidates(_queries(spark, folder), _index(spark, folder), table(spark, folder, "chunks"))


def split_sections(spark, folder):
    rows = table(spark, folder, "chunks", wide=True).select("chunk_ord", F.posexplode(chunk.sections(F.concat(F.lit("# "), F.col("text")))).alias("pos", "s"))
    return rows.select("chunk_ord", F.col("pos").cast("bigint").alias("pos"), F.col("s.section").alias("section"), F.length("s.body").cast("bigint").alias("n_chars"), F.md5("s.body").alias("body_md5"))


def split_paragraphs(spark, folder):
    rows = table(spark, folder, "chunks").select("chunk_ord", chunk.paragraphs(X.strip(X.unix_lines(F.col("text")))).alias("p")).filter("p is not null")
    return rows.select("chunk_ord", F.size("p").cast("bigint").alias("n_paragraphs"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).cast("bigint").alias("longest"))


def _chunked(spark, folder, most, overlap):
    rows = chunk.chunk_documents(table(spark, folder, "documents", wide=True), most, overlap)
    return rows.select("doc_id", "chunk_id", "section", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def chunk_documents(spark, folder):
    return _chunked(spark, folder, 1800, 250)


def chunk_documents_small(spark, folder):
    return _chunked(spark, folder, 300, 50)


def chunk_counts(spark, folder):
    return chunk.chunk_documents(table(spark, folder, "documents", wide=True)).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


def front_matter_parse(spark, folder):
    blank = F.lit("")
    page = F.concat(F.lit("---\ntitle: old\ntitle: "), F.coalesce("title", blank), F.lit("\nsource: https://"), F.coalesce("source", blank), F.lit("\nno field\n---\n\n"), F.coalesce("text", blank))
    meta, body = X.front_matter(page)
    rows = table(spark, folder, "documents").select("doc_id", meta.alias("meta"), body.alias("body"))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md"))
    return rows.select("doc_id", F.size("meta").cast("bigint").alias("n_fields"), F.col("meta")["source"].alias("source"), X.resolved_title(F.col("meta"), F.col("body"), name).alias("title"), F.md5("body").alias("body_md5"))


def slugify(spark, folder):
    return table(spark, folder, "part").select("p_partkey", X.slugify(F.col("p_name")).alias("slug"))


def doc_ids(spark, folder):
    pages = table(spark, folder, "manifest_pages").select("wiki", "title").distinct()
    rows = pages.join(F.broadcast(table(spark, folder, "wikis")), "wiki")  # wikis is a fixed table of 12 rows
    return rows.select("wiki", "title", X.page_doc_id(F.col("wiki"), F.col("title")).alias("doc_id"), X.page_url(F.col("base_url"), F.col("title")).alias("url"))


def query_normalise(spark, folder):
    return table(spark, folder, "eval_questions").select("id", X.normal_query(F.col("question")).alias("query"))


def _pages(spark, folder):
    """A page for each document: its title, an infobox and a paragraph per line."""

    def escaped(column):
        return F.replace(F.replace(F.replace(F.coalesce(column, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.concat(F.lit("<p>"), escaped(line), F.lit("</p>")))
    box = F.concat(F.lit('<table class="infobox"><tr><th>Real  Name:</th><td>'), escaped(F.col("source")), F.lit("<br/>"), escaped(F.col("lang")), F.lit("<sup>[1]</sup></td></tr><tr><th>Colour</th><td>red</td></tr></table>"))
    page = F.concat(F.lit("<div class='toc'><p>skip</p></div><script>x()</script>"), box, F.lit("<h5>Title [1]</h5>"), F.array_join(lines, "\n"), F.lit("<h2>References</h2><p>gone</p>"))
    return table(spark, folder, "documents", wide=True).select("doc_id", page.alias("html"))


def html_markdown(spark, folder):
    return html.html_to_markdown(_pages(spark, folder), "doc_id").select("doc_id", F.length("markdown").cast("bigint").alias("n_chars"), F.md5("markdown").alias("markdown_md5"))


def infobox_facts(spark, folder):
    rows = html.html_to_markdown(_pages(spark, folder), "doc_id").select("doc_id", F.explode("facts").alias("f"))
    return rows.select("doc_id", "f.key", "f.value")


def min_length_filter(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars"))
    return rows.select("doc_id", "chars", (F.col("chars") >= 500).alias("ok"))


def manifest_latest(spark, folder):
    return manifest.latest(table(spark, folder, "manifest_pages"))


def manifest_upsert(spark, folder):
    pages = table(spark, folder, "manifest_pages")
    return manifest.upsert(pages.filter("ok"), pages.filter("not ok"))


def manifest_summary(spark, folder):
    return manifest.summary(manifest.latest(table(spark, folder, "manifest_pages")))


def contains_semi(spark, folder):
    wanted = table(spark, folder, "eval_questions").select(F.explode("relevant_docs").alias("doc_id")).distinct()
    return wanted.join(table(spark, folder, "chunks").select("doc_id").distinct(), "doc_id", "left_semi")


def new_docs_anti(spark, folder):
    pages = table(spark, folder, "manifest_pages").select(F.concat("wiki", F.lit("__"), "slug", F.lit(".md")).alias("doc_id")).distinct()
    asked = table(spark, folder, "eval_questions").select(F.explode("relevant_docs").alias("doc_id")).distinct()
    more = table(spark, folder, "documents").select(F.concat(F.lit("documents__"), F.col("doc_id").cast("string"), F.lit(".md")).alias("doc_id"))
    return fallback.not_indexed(pages.union(asked).union(more).distinct(), table(spark, folder, "chunks"))


def qrels(spark, folder):
    return evaluate.relevance_pairs(table(spark, folder, "eval_questions"))


def _measures(spark, folder):
    return evaluate.retrieval_measures(_hits(spark, folder), qrels(spark, folder))


def retrieval_metrics(spark, folder):
    return _measures(spark, folder).select("query_id", *[F.round(m, 6).alias(m) for m in evaluate.MEASURES[:5]])


def metrics_by_category(spark, folder):
    asked = table(spark, folder, "eval_questions").select(F.col("id").alias("query_id"), "category")
    return evaluate.report(asked.join(_measures(spark, folder), "query_id", "left"))


def token_f1(spark, folder):
    rows = evaluate.token_f1(table(spark, folder, "eval_questions"), "id", "question", "reference_answer")
    return rows.select("id", F.round("token_f1", 6).alias("token_f1"))


def abstention(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.is_abstention(F.col("text")).alias("abstained"))


def judge_parse(spark, folder):
    return table(spark, folder, "events").select("event_id", X.judged(F.col("props")).alias("grade"))


def latency_report(spark, folder):
    rows = evaluate.latency_report(table(spark, folder, "events"), "event_type", "value")
    return rows.select("category", "overall", "n", F.round("mean", 4).alias("mean"), F.round("p95", 6).alias("p95"))


def build_context(spark, folder):
    asked = table(spark, folder, "eval_questions").withColumnRenamed("id", "query_id")
    rows = context.prompts(_hits_with_chunks(spark, folder), asked, 3000)
    return rows.select("query_id", "n_passages", F.length("context").cast("bigint").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def hit_sources(spark, folder):
    return context.sources(_hits_with_chunks(spark, folder))


def needs_fallback(spark, folder):
    asked = table(spark, folder, "eval_questions").select(F.col("id").alias("query_id"), F.col("question").alias("text"), F.lit(None).cast("array<float>").alias("vector"))
    best = search.search(asked, _index(spark, folder), 1, per_doc=0, lexical_only=True)
    return fallback.needs_fallback(asked, best, 12.0)


def pick_best_hit(spark, folder):
    asked = table(spark, folder, "eval_questions").select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    wiki = F.split("doc_id", "__", 2)[0].alias("wiki")
    pages = table(spark, folder, "chunks").select("chunk_ord", wiki, F.col("metadata.title").alias("title")).filter("title is not null")
    pages = cut(pages.groupBy("wiki", "title").agg(F.min("chunk_ord").alias("chunk_ord")))
    met = fallback.title_candidates(asked, pages, "chunk_ord")
    return fallback.best_candidates(met).select("query_id", "wiki", "title", "score", F.round("match", 6).alias("match"))


def embed_hash(spark, folder):
    return providers.with_embedding(table(spark, folder, "chunks").select("chunk_ord", "text"), providers.HashProvider(16)).select("chunk_ord", "embedding")


def stream_latency(spark, folder):
    """Events as a stream, taken to its end: closed windows of five minutes by type."""
    source = table(spark, folder, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*")
    out = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    follow_latencies(stream.withColumn("ts", F.col("ts").cast("timestamp")), f"{out}/windows", f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/windows").select("event_type", F.unix_timestamp("window_start").alias("window_start"), "n", F.round("total", 4).alias("total"))


def corpus_round_trip(spark, folder):
    """Documents as corpus pages, written and loaded again."""
    blank = F.lit("")
    docs = table(spark, folder, "documents").select(
        F.lit("w").alias("wiki"), F.concat(F.coalesce("title", blank), F.lit(" "), F.col("doc_id").cast("string")).alias("title"), F.lit("U").alias("universe"),
        F.coalesce("source", blank).alias("source"), F.lit("2025-01-01").alias("scraped"), F.coalesce("text", blank).alias("body"),
    )
    where = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    corpus.write_corpus(corpus.corpus_page(docs), where)
    rows = corpus.load_corpus(spark, where)
    return rows.select("doc_id", "title", F.size("meta").cast("bigint").alias("n_fields"), F.md5("body").alias("body_md5"))


def resolve_title(spark, folder):
    """The title of a page: its field, else its first heading, else its name."""
    blank = F.lit("")
    field = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\ntitle: "), F.coalesce("title", blank), F.lit("\n---\n"))).otherwise(blank)
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), F.coalesce("source", blank), F.lit("\n"))).otherwise(blank)
    meta, body = X.front_matter(F.concat(field, head, F.lit("x")))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, folder, "documents").select("doc_id", X.resolved_title(meta, body, name).alias("title"))


def _nth(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int") + 1)


def drop_sections(spark, folder):
    """Pages with one section that no one reads, of each kind, between two that stay."""
    name = F.initcap(_nth(html.DROPPED_SECTIONS, F.col("doc_id")))
    page = F.concat(F.lit("<h2>One</h2><p>a</p><h3>"), name, F.lit("[edit]</h3><p>gone</p><li>gone</li><h2>Not "), name, F.lit("</h2><p>b</p>"))
    rows = html.html_to_markdown(table(spark, folder, "documents", wide=True).select("doc_id", page.alias("html")), "doc_id")
    return rows.select("doc_id", "markdown")


_OTHER_KEYS = ("Colour", "Nick Name", "Old Aliases", "Team", "Known Affiliations", "Weapon")


def infobox_keys(spark, folder):
    """Facts of every kind that is kept, and of some that aren't, twice each."""
    key = F.upper(_nth((*html.FACT_KEYS, *_OTHER_KEYS), F.col("doc_id")))
    row = F.concat(F.lit("<tr><th>"), key, F.lit(":</th><td>v"), F.col("doc_id").cast("string"), F.lit("</td></tr>"))
    page = F.concat(F.lit("<table class='infobox'>"), row, row, F.lit("<tr><th>Empty</th><td> , </td></tr></table>"))
    rows = html.html_to_markdown(table(spark, folder, "documents", wide=True).select("doc_id", page.alias("html")), "doc_id")
    return rows.select("doc_id", F.explode("facts").alias("f")).select("doc_id", "f.key", "f.value")


def pages_to_documents(spark, folder):
    """Manifest rows of fetched pages, some of them failed or too short."""
    asked = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("title"))
    pages = _pages(spark, folder).join(asked, "doc_id").select(F.lit("w").alias("wiki"), "title", F.lit("u").alias("url"), "html", (F.col("doc_id") % 5 != 0).alias("ok"), F.lit("gone").alias("error"))
    return scrape.documents_of(pages, "2025-01-01")[1].select("slug", "ok", "chars", "error")


def page_jobs(spark, folder):
    """The pages of one wiki, and some more, each once."""
    pages = table(spark, folder, "manifest_pages")
    return scrape.page_jobs(pages, "marvel", table(spark, folder, "documents").select(F.col("source").alias("wiki"), "title"))


def chosen_questions(spark, folder):
    """The first seven questions of a category, in order."""
    asked = table(spark, folder, "eval_questions").withColumn("pos", F.col("id"))
    return corpus.chosen_questions(asked, "factual", 7).select("id", "question")


def hybrid_alpha_0(spark, folder):
    return _hits(spark, folder, alpha=0.0)


def hybrid_alpha_1(spark, folder):
    return _hits(spark, folder, alpha=1.0)


def judge_context(spark, folder):
    """What judges read: the whole texts of a question's hits."""
    rows = context.whole_context(_hits_with_chunks(spark, folder))
    return rows.select("query_id", F.length("context").cast("bigint").alias("n_chars"), F.md5("context").alias("context_md5"))


def append_equals_rebuild(spark, folder):
    """An index of half of the documents to which all are appended, twice: each document's chunks and the range of ordinals."""
    chunks = table(spark, folder, "chunks")
    index = ChunkIndex(spark, f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}")
    index.create(with_ordinals(chunks.filter(F.xxhash64("doc_id") % 2 == 0).drop("chunk_ord")))
    index.append(chunks)
    index.append(chunks)
    rows = index.open().select("doc_id", "chunk_id", "text", "chunk_ord")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("chunk_ord").alias("n_ordinals"), F.min(F.md5(F.coalesce("text", F.lit("")))).alias("least_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize_counts, term_df, bm25_stats, bm25_scores, bm25_topk, l2_normalise, dense_topk, dense_topk_diverse, minmax_scores,
        hybrid_topk, hybrid_topk_diverse, candidate_rerank, split_sections, split_paragraphs, chunk_documents, chunk_documents_small,
        chunk_counts, front_matter_parse, slugify, doc_ids, query_normalise, html_markdown, infobox_facts, min_length_filter,
        manifest_latest, manifest_upsert, manifest_summary, contains_semi, new_docs_anti, qrels, retrieval_metrics, metrics_by_category,
        token_f1, abstention, judge_parse, latency_report, build_context, hit_sources, needs_fallback, pick_best_hit, embed_hash, stream_latency,
        corpus_round_trip, resolve_title, drop_sections, infobox_keys, pages_to_documents, page_jobs, chosen_questions, hybrid_alpha_0, hybrid_alpha_1,
        judge_context, append_equals_rebuild,
    )
}

# ---------------------------------------------------------------- the same in SQL

_S, _I = X.SPACE, X.INLINE_SPACE
_OPEN, _CLOSE = "chr(64976)", "chr(64977)"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{_S}+|{_S}+\z', '', 'g')"


def _unix(x: str) -> str:
    return rf"regexp_replace({x}, '{X.LINE_END}', chr(10), 'g')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+(?:''[a-z0-9]+)?')"


_QUERIES = """
q as (
  select e.id as query_id, e.question as text, arg_min(c.embedding, c.chunk_ord) as vector
  from eval_questions e left join (select doc_id, chunk_ord, embedding from chunks where embedding is not null) c on c.doc_id = e.relevant_docs[1]
  group by e.id, e.question)"""

_LEXICAL = f"""
ct as (select chunk_ord, {_tokens("text")} as toks from chunks),
stats as (select count(*) as n, avg(len(toks)) as avgdl from ct),
post as (select chunk_ord, dl, term, count(*) as tf from (select chunk_ord, len(toks) as dl, unnest(toks) as term from ct) group by 1, 2, 3),
df as (select term, count(*) as df from post group by 1),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({_tokens("text")}) as term from q) group by 1, 2),
lex as (
  select qt.query_id, post.chunk_ord,
         sum(qtf * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * 2.5e0 * tf / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) as s
  from qt join df on df.term = qt.term join post on post.term = qt.term cross join stats group by 1, 2)"""

_ONLY_TEXT = "q as (select id as query_id, question as text from eval_questions)"


def _unit(x: str) -> str:
    v = f"list_transform({x}, lambda x: cast(x as double))"
    return f"case when sqrt(list_dot_product({v}, {v})) = 0 then {v} else list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v}))) end"


_DENSE = f"""
cu as (select chunk_ord, doc_id, {_unit("embedding")} as u from chunks),
qu as (select query_id, {_unit("vector")} as u from q),
dense as (select qu.query_id, cu.chunk_ord, cu.doc_id, case when cu.u is null or qu.u is null or len(cu.u) <> len(qu.u) then 0 else list_dot_product(cu.u, qu.u) end as d from qu cross join cu)"""


def _scaled(x: str, low: str, high: str) -> str:
    return f"case when {high} - {low} < 1e-12 then 0e0 else ({x} - {low}) / ({high} - {low}) end"


def _final(pool: int, cap: int, k: int = 5) -> str:
    own = f"own as (select *, row_number() over (partition by query_id, doc_id order by rn) as o from pool qualify o <= {cap})" if cap else "own as (select * from pool)"
    return f"""
pool as (select *, row_number() over (partition by query_id order by score desc, chunk_ord) as rn from fused qualify rn <= {pool}),
{own},
hits as (select query_id, row_number() over (partition by query_id order by rn) as rank, chunk_ord, doc_id, score from own qualify rank <= {k})"""


def _hybrid(pool: int, cap: int) -> str:
    return f"""with {_QUERIES}, {_LEXICAL}, {_DENSE},
both_ as (select dense.*, coalesce(lex.s, 0) as s from dense left join lex on lex.query_id = dense.query_id and lex.chunk_ord = dense.chunk_ord),
mm as (select query_id, min(d) as d0, max(d) as d1, min(s) as s0, max(s) as s1 from both_ group by 1),
fused as (
  select b.query_id, chunk_ord, doc_id, round(0.7e0 * {_scaled("d", "d0", "d1")} + 0.3e0 * {_scaled("s", "s0", "s1")}, 6) as score
  from both_ b join mm on mm.query_id = b.query_id), {_final(pool, cap)}"""


_DENSE_ONLY = f"""with {_QUERIES}, {_DENSE}, fused as (select query_id, chunk_ord, doc_id, round(d, 6) as score from dense), {_final(20, 2)}"""

_EMBEDDED = f"""with cu as (select vec_id as chunk_ord, label as doc_id, {_unit("embedding")} as u from embeddings),
fused as (
  select a.chunk_ord as query_id, b.chunk_ord, b.doc_id, round(list_dot_product(a.u, b.u), 6) as score
  from cu a cross join cu b where a.chunk_ord % 50 = 0), """

_RERANK = f"""with {_QUERIES}, {_DENSE},
cand as (select query_id, chunk_ord, doc_id, round(d, 6) as d, row_number() over (partition by query_id order by round(d, 6) desc, chunk_ord) as r from dense qualify r <= 20),
tok as (select cand.*, {_tokens("c.text")} as toks from cand join chunks c on c.chunk_ord = cand.chunk_ord),
st as (select query_id, count(*) as n, avg(len(toks)) as avgdl from tok group by 1),
tf as (select query_id, chunk_ord, dl, term, count(*) as tf from (select query_id, chunk_ord, len(toks) as dl, unnest(toks) as term from tok) group by 1, 2, 3, 4),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({_tokens("text")}) as term from q) group by 1, 2),
df as (select tf.query_id, tf.term, count(*) as df from tf join qt on qt.query_id = tf.query_id and qt.term = tf.term group by 1, 2),
lex as (
  select tf.query_id, tf.chunk_ord, sum(qtf * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / case when avgdl > 0 then avgdl else 1 end))) as s
  from tf join qt on qt.query_id = tf.query_id and qt.term = tf.term join df on df.query_id = tf.query_id and df.term = tf.term join st on st.query_id = tf.query_id group by 1, 2),
both_ as (select cand.query_id, cand.chunk_ord, doc_id, d, coalesce(s, 0) as s from cand left join lex on lex.query_id = cand.query_id and lex.chunk_ord = cand.chunk_ord),
mm as (select query_id, min(d) as d0, max(d) as d1, min(s) as s0, max(s) as s1 from both_ group by 1),
fused as (
  select b.query_id, chunk_ord, doc_id, round(0.7e0 * {_scaled("d", "d0", "d1")} + 0.3e0 * {_scaled("s", "s0", "s1")}, 6) as score
  from both_ b join mm on mm.query_id = b.query_id), {_final(20, 2)}"""


def _sections(source: str, key: str, text: str) -> str:
    marked = rf"regexp_replace({_unix(text)}, '(?m)^#{{1,6}}{_I}+(.*)$', {_OPEN} || '\1' || {_CLOSE}, 'g')"
    return f"""
parts as (select {key}, unnest(string_split({marked}, {_OPEN})) as part, unnest(range(0, len(string_split({marked}, {_OPEN})))) as i from {source} where text is not null),
sections_all as (
  select {key}, i, case when i = 0 then '' else {_strip(f"split_part(part, {_CLOSE}, 1)")} end as section,
         {_strip(f"case when i = 0 then part else split_part(part, {_CLOSE}, 2) end")} as body from parts),
sections as (select {key}, row_number() over (partition by {key} order by i) - 1 as pos, section, body from sections_all where body <> '')"""


def _paragraphs(body: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({body}, '\n{_S}*\n'), lambda x: {_strip('x')}), lambda x: x <> '')"


def _chunk_sql(most: int, overlap: int) -> str:
    half = most // 2
    back = f"instr(reverse(left(a.rest, {most})), ' .')"
    cutting = f"case when {back} > 0 and {most} - 1 - {back} > {half} then {most} - {back} else {most} end"
    tail = "a.cur"
    return f"""with {_sections("documents", "doc_id", "text")},
paras as (select doc_id, pos, section, unnest({_paragraphs("body")}) as p, unnest(range(0, len({_paragraphs("body")}))) as pno from sections),
hard as (
  select doc_id, pos, section, pno, list_reduce(
    list_transform(range(0, cast(ceil(length(p) / {half}.0) as bigint) + 2), lambda i: {{'rest': p, 'out': cast([] as varchar[])}}),
    lambda a, x: case when length(a.rest) > {most}
      then {{'rest': {_strip(f"substr(a.rest, ({cutting}) + 1)")}, 'out': list_append(a.out, {_strip(f"left(a.rest, {cutting})")})}} else a end) as h
  from paras),
atoms as (
  select doc_id, pos, section, flatten(list(list_concat(
    list_transform(h.out, lambda t: {{'cur': '', 'out': cast([] as varchar[]), 't': t, 'f': true}}),
    [{{'cur': '', 'out': cast([] as varchar[]), 't': h.rest, 'f': false}}]) order by pno)) as items
  from hard group by 1, 2, 3),
packed as (
  select doc_id, pos, section, list_reduce(list_concat([{{'cur': '', 'out': cast([] as varchar[]), 't': '', 'f': false}}], items),
    lambda a, x: case
      when x.f then {{'cur': '', 'out': list_append(case when a.cur = '' then a.out else list_append(a.out, a.cur) end, x.t), 't': '', 'f': false}}
      when x.t = '' then a
      when a.cur = '' then {{'cur': x.t, 'out': a.out, 't': '', 'f': false}}
      when length(a.cur) + 2 + length(x.t) <= {most} then {{'cur': a.cur || chr(10) || chr(10) || x.t, 'out': a.out, 't': '', 'f': false}}
      else {{'cur': '...' || right({tail}, {overlap}) || chr(10) || chr(10) || x.t, 'out': list_append(a.out, a.cur), 't': '', 'f': false}} end) as r
  from atoms),
pieces as (select doc_id, pos, section, unnest(case when r.cur = '' then r.out else list_append(r.out, r.cur) end) as piece,
  unnest(range(0, len(case when r.cur = '' then r.out else list_append(r.out, r.cur) end))) as k from packed),
final as (
  select p.doc_id, p.doc_id || '#' || (row_number() over (partition by p.doc_id order by pos, k) - 1) as chunk_id, section,
    '[' || coalesce(d.title, '') || ']' || case when section <> '' then ' — ' || section else '' end || chr(10) || piece as text
  from pieces p join documents d on d.doc_id = p.doc_id)"""


_FINAL_CHUNKS = " select doc_id, chunk_id, section, length(text) as n_chars, md5(text) as text_md5 from final"

_LATEST = """select wiki, slug, title, ok, path, url, chars, error, scraped_at, arrived_at from {source}
where wiki is not null and slug is not null
qualify row_number() over (partition by wiki, slug order by {first} scraped_at desc nulls last, arrived_at desc nulls last, ok desc nulls last,
  title desc nulls last, path desc nulls last, url desc nulls last, chars desc nulls last, error desc nulls last) = 1"""

_QRELS = """select distinct query_id, doc_id from (
  select id as query_id, unnest(relevant_docs) as doc_id from eval_questions where answerable) where doc_id is not null"""

_MEASURED = f"""{_hybrid(20, 2)},
rels as ({_QRELS}),
wanted as (select query_id, count(*) as n from rels group by 1),
marked as (select h.query_id, h.rank, h.doc_id, (r.doc_id is not null)::int as rel from hits h left join rels r on r.query_id = h.query_id and r.doc_id = h.doc_id),
got as (
  select query_id, max(rel) as hit, avg(rel) as p, count(distinct doc_id) filter (where rel = 1) as found, min(rank) filter (where rel = 1) as first,
         sum(rel / log2(rank + 1)) as dcg, count(*) as k from marked group by 1),
measured as (
  select w.query_id, coalesce(hit, 0)::double as hit_rate, coalesce(p, 0) as precision, coalesce(found / n, 0)::double as recall, coalesce(1.0e0 / first, 0) as mrr,
         coalesce(dcg / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1 / log2(i + 1))), 0) as ndcg
  from wanted w left join got g on g.query_id = w.query_id)"""

_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_ANSWER = "list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: not list_contains([" + _STOP + "], w))"

_P95 = "list_sort(list({x}))[greatest(1, cast(floor(count({x}) * 0.95e0) as bigint))]"

ORACLES: dict[str, str] = {
    "tokenize_counts": f"select chunk_ord, len({_tokens('text')}) as dl from chunks",
    "term_df": f"select term, count(*) as df from (select distinct chunk_ord, unnest({_tokens('text')}) as term from chunks) group by 1",
    "bm25_stats": f"select count(*) as n_chunks, round(avg(len({_tokens('text')})), 6) as avgdl from chunks",
    "bm25_scores": f"with {_ONLY_TEXT}, {_LEXICAL} select query_id, chunk_ord, round(s, 6) as score from lex",
    "bm25_topk": f"""with {_ONLY_TEXT}, {_LEXICAL}
select query_id, row_number() over (partition by query_id order by round(s, 6) desc, chunk_ord) as rank, chunk_ord, round(s, 6) as score from lex qualify rank <= 5""",
    "l2_normalise": f"""with v as (select chunk_ord, list_transform(embedding, lambda x: cast(x as double)) as v, {_unit("embedding")} as u from chunks)
select chunk_ord, round(sqrt(list_dot_product(v, v)), 5) as norm, list_transform(u, lambda x: round(x, 6)) as unit from v""",
    "dense_topk": f"{_EMBEDDED} {_final(5, 0)} select * from hits",
    "dense_topk_diverse": f"{_EMBEDDED} {_final(20, 2)} select * from hits",
    "minmax_scores": f"""with s as (select distinct query_id, chunk_id, scorer, score from search_hits where score is not null and not isnan(score)),
m as (select query_id, scorer, min(score) as low, max(score) as high from s group by 1, 2)
select s.query_id, s.chunk_id, s.scorer, round({_scaled("score", "low", "high")}, 6) as scaled from s join m on m.query_id = s.query_id and m.scorer = s.scorer""",
    "hybrid_topk": f"{_hybrid(5, 0)} select * from hits",
    "hybrid_topk_diverse": f"{_hybrid(20, 2)} select * from hits",
    "candidate_rerank": f"{_RERANK} select * from hits",
    "split_sections": f"""with src as (select chunk_ord, '# ' || text as text from chunks), {_sections("src", "chunk_ord", "text")}
select chunk_ord, pos, section, length(body) as n_chars, md5(body) as body_md5 from sections""",
    "split_paragraphs": f"""with p as (select chunk_ord, {_paragraphs(_strip(_unix("text")))} as p from chunks where text is not null)
select chunk_ord, len(p) as n_paragraphs, coalesce(list_max(list_transform(p, lambda x: length(x))), 0) as longest from p""",
    "chunk_documents": _chunk_sql(1800, 250) + _FINAL_CHUNKS,
    "chunk_documents_small": _chunk_sql(300, 50) + _FINAL_CHUNKS,
    "chunk_counts": _chunk_sql(1800, 250) + " select doc_id, count(*) as n_chunks from final group by 1",
    "front_matter_parse": rf"""with b as (select doc_id, {_strip("coalesce(title, '')")} as title, 'https://' || {_strip("coalesce(source, '')")} as source,
  regexp_replace({_unix("coalesce(text, '')")}, '\A{_S}+', '') as body from documents)
select doc_id, cast(2 as bigint) as n_fields, source, coalesce(nullif(title, ''), nullif({_strip(f"regexp_extract(body, '\\A#{_I}+([^\\n]+)', 1)")}, ''), 'd' || doc_id) as title, md5(body) as body_md5 from b""",
    "slugify": "select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') as slug from part",
    "doc_ids": """select distinct m.wiki, title, m.wiki || '__' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') || '.md' as doc_id,
  base_url || '/wiki/' || replace(title, ' ', '_') as url from manifest_pages m join wikis w on w.wiki = m.wiki""",
    "query_normalise": f"select id, lower({_strip('question')}) as query from eval_questions",
    "html_markdown": rf"""with l as (
  select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
    lambda x: {_strip(r"regexp_replace(regexp_replace(" + _strip("x") + r", '\[\d+\]', '', 'g'), '[ \t]+', ' ', 'g')")}), lambda x: x <> '') as lines,
    trim(regexp_replace({_strip(f"regexp_replace(coalesce(source, '') || ', ' || coalesce(lang, ''), '{_S}+', ' ', 'g')")}, '\s*,\s*,+', ',', 'g'), ' ,') as v
  from documents),
m as (select doc_id, {_strip("case when v <> '' then '## Quick Facts' || chr(10) || chr(10) || '- **Real Name**: ' || v || chr(10) || chr(10) else '' end || '#### Title' || case when len(lines) > 0 then chr(10) || chr(10) || array_to_string(lines, chr(10) || chr(10)) else '' end")} as markdown from l)
select doc_id, length(markdown) as n_chars, md5(markdown) as markdown_md5 from m""",
    "infobox_facts": rf"""with l as (select doc_id,
    trim(regexp_replace({_strip(f"regexp_replace(coalesce(source, '') || ', ' || coalesce(lang, ''), '{_S}+', ' ', 'g')")}, '\s*,\s*,+', ',', 'g'), ' ,') as v from documents)
select doc_id, 'Real Name' as key, v as value from l where v <> ''""",
    "min_length_filter": "select doc_id, length(coalesce(text, '')) as chars, length(coalesce(text, '')) >= 500 as ok from documents",
    "manifest_latest": _LATEST.format(source="manifest_pages", first=""),
    "manifest_upsert": _LATEST.format(source="(select *, not ok as newer from manifest_pages where ok is not null)", first="newer desc,"),
    "manifest_summary": f"""select wiki, count(*) filter (where ok) as n_ok, count(*) filter (where not coalesce(ok, false)) as n_failed,
  cast(coalesce(sum(chars), 0) as bigint) as n_chars from ({_LATEST.format(source="manifest_pages", first="")}) group by 1""",
    "contains_semi": "select distinct doc_id from (select unnest(relevant_docs) as doc_id from eval_questions) where doc_id in (select doc_id from chunks)",
    "new_docs_anti": """select doc_id from (
  select wiki || '__' || slug || '.md' as doc_id from manifest_pages union select unnest(relevant_docs) from eval_questions union select 'documents__' || doc_id || '.md' from documents)
where doc_id is null or doc_id not in (select doc_id from chunks where doc_id is not null)""",
    "qrels": _QRELS,
    "retrieval_metrics": f"{_MEASURED} select query_id, round(hit_rate, 6) as hit_rate, round(precision, 6) as precision, round(recall, 6) as recall, round(mrr, 6) as mrr, round(ndcg, 6) as ndcg from measured",
    "metrics_by_category": f"""{_MEASURED}
select category, grouping(category) = 1 as overall, round(avg(hit_rate), 4) as hit_rate, round(avg(precision), 4) as precision, round(avg(recall), 4) as recall,
  round(avg(mrr), 4) as mrr, round(avg(ndcg), 4) as ndcg, count(*) as n
from eval_questions e left join measured m on m.query_id = e.id group by rollup (category)""",
    "token_f1": f"""with t as (select id, {_ANSWER.format(x="question")} as a, {_ANSWER.format(x="reference_answer")} as r from eval_questions),
o as (select id, len(a) as na, len(r) as nr, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(r, lambda x: x = w))))) as o from t)
select id, case when coalesce(o, 0) > 0 then round(2.0e0 * o / (na + nr), 6) else 0 end as token_f1 from o""",
    "abstention": "select doc_id, regexp_matches(coalesce(text, ''), '" + X.ABSTENTION.replace("'", "''") + "', 'i') as abstained from documents",
    "judge_parse": "select event_id, cast(nullif(regexp_extract(props, '[1-5]'), '') as double) as grade from events",
    "latency_report": f"""select event_type as category, grouping(event_type) = 1 as overall, count(value) as n, round(avg(value), 4) as mean,
  round({_P95.format(x="value")}, 6) as p95 from events where value is not null group by rollup (event_type)""",
    "build_context": f"""{_hybrid(20, 2)},
t as (select h.query_id, h.rank, coalesce(c.text, '') as text, coalesce(c.metadata.title, c.doc_id) as title,
  coalesce(sum(length(coalesce(c.text, ''))) over (partition by h.query_id order by h.rank rows between unbounded preceding and 1 preceding), 0) as used
  from hits h join chunks c on c.chunk_ord = h.chunk_ord),
ctx as (select query_id, count(*) as n, string_agg('[' || rank || '] (from: ' || title || ')' || chr(10) || left(text, cast(3000 - used as bigint)), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context
  from t where used < 3000 or rank = 1 group by 1)
select e.id as query_id, coalesce(n, 0) as n_passages, length(coalesce(context, '')) as n_chars,
  md5('Context passages:' || chr(10) || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || coalesce(e.question, '')) as prompt_md5
from eval_questions e left join ctx on ctx.query_id = e.id""",
    "hit_sources": f"""{_hybrid(20, 2)} select h.query_id, h.rank, h.doc_id as doc, coalesce(c.metadata.title, '') as title, coalesce(c.section, '') as section,
  round(score, 4) as score, coalesce(c.metadata.source, '') as url from hits h join chunks c on c.chunk_ord = h.chunk_ord""",
    "needs_fallback": f"""with {_ONLY_TEXT}, {_LEXICAL}, b as (select query_id, max(round(s, 6)) as best from lex group by 1)
select q.query_id, coalesce(best, 0) as best, best is null or best < 12 as needs_fallback from q left join b on b.query_id = q.query_id""",
    "pick_best_hit": f"""with {_ONLY_TEXT},
pages as (select min(chunk_ord) as chunk_ord, split_part(doc_id, '__', 1) as wiki, metadata.title as title, metadata.title as text from chunks where metadata.title is not null group by 2, 3),
{_LEXICAL.replace("from chunks", "from pages")},
top as (select query_id, chunk_ord, row_number() over (partition by query_id order by round(s, 6) desc, chunk_ord) as r from lex qualify r <= 20),
met as (select top.query_id, q.text as query, wiki, title, 21 - row_number() over (partition by top.query_id, wiki order by r) as score
  from top join pages on pages.chunk_ord = top.chunk_ord join q on q.query_id = top.query_id),
words as (select *, list_filter(list_distinct(regexp_split_to_array(lower(query), '[ \\t\\n\\f\\r]+')), lambda w: length(w) > 1) as a, regexp_split_to_array(translate(lower(title), '()', '  '), '[ \\t\\n\\f\\r]+') as t from met),
scored as (select query_id, wiki, title, score, case when len(a) > 0 then len(list_intersect(a, t)) / cast(len(a) as double) else 0 end as match from words)
select query_id, wiki, title, score, round(match, 6) as match from scored
qualify row_number() over (partition by query_id order by score desc, match desc, wiki, title) = 1""",
    "stream_latency": """select event_type, cast(floor(epoch(ts) / 300) * 300 as bigint) as window_start, count(*) as n, round(sum(value), 4) as total from events
group by 1, 2 having floor(epoch(any_value(ts)) / 300) * 300 + 300 <= (select max(epoch(ts)) - 600 from events)""",
    "corpus_round_trip": rf"""with t as (select *, coalesce(title, '') || ' ' || doc_id as t from documents)
select 'w__' || trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_') || '.md' as doc_id, {_strip("t")} as title, 4 as n_fields,
  md5('# ' || t || chr(10) || chr(10) || {_unix("coalesce(text, '')")} || chr(10)) as body_md5 from t""",
    "resolve_title": rf"""select doc_id, coalesce(case when doc_id % 3 = 0 then nullif({_strip("coalesce(title, '')")}, '') end,
  case when doc_id % 2 = 0 then nullif({_strip("coalesce(source, '')")}, '') end, 'd' || doc_id) as title from documents""",
    "drop_sections": """select doc_id, '## One' || chr(10) || chr(10) || 'a' || chr(10) || chr(10) || '## Not ' ||
  array_to_string(list_transform(string_split(([{names}])[doc_id % {n} + 1], ' '), lambda w: upper(w[1]) || w[2:]), ' ') || chr(10) || chr(10) || 'b' as markdown from documents""".format(
        names=", ".join(f"'{x}'" for x in html.DROPPED_SECTIONS), n=len(html.DROPPED_SECTIONS)
    ),
    "infobox_keys": """with k as (select doc_id, ([{keys}])[doc_id % {n} + 1] as key from documents)
select doc_id, upper(key) as key, 'v' || doc_id as value from k where lower(key) in ({known}) or regexp_matches(lower(key), 'alias|name|affiliation')""".format(
        keys=", ".join(f"'{x}'" for x in (*html.FACT_KEYS, *_OTHER_KEYS)), n=len(html.FACT_KEYS) + len(_OTHER_KEYS), known=", ".join(f"'{x}'" for x in html.FACT_KEYS)
    ),
    "page_jobs": r"""select distinct wiki, title, trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') as slug from (
  select wiki, title from manifest_pages where wiki = 'marvel' union all select source, title from documents) where wiki is not null and trim(title) <> ''""",
    "chosen_questions": "select id, question from eval_questions where category = 'factual' order by id limit 7",
    "hybrid_alpha_0": f"{_DENSE_ONLY} select * from hits",
    "hybrid_alpha_1": f"{_DENSE_ONLY} select * from hits",
    "judge_context": f"""{_hybrid(20, 2)}, t as (
  select h.query_id, string_agg(coalesce(c.text, ''), chr(10) || chr(10) order by h.rank) as context from hits h join chunks c on c.chunk_ord = h.chunk_ord group by 1)
select query_id, length(context) as n_chars, md5(context) as context_md5 from t""",
    "append_equals_rebuild": "select doc_id, count(*) as n, count(*) as n_ordinals, min(md5(coalesce(text, ''))) as least_md5 from chunks group by 1",
    "embed_hash": r"""with w as (select chunk_ord, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from chunks),
h as (select chunk_ord, cast('0x' || left(md5(word), 7) as bigint) as h from w),
d as (select chunk_ord, h % 16 as i, sum(case when h >= 134217728 then 1 else -1 end) as v from h group by 1, 2),
m as (select chunk_ord, map_from_entries(list({'k': i, 'v': v})) as m from d group by 1)
select c.chunk_ord, case when c.text is not null then list_transform(range(0, 16), lambda i: cast(coalesce(m.m[i], 0) as float)) end as embedding
from chunks c left join m on m.chunk_ord = c.chunk_ord""",
}

_MARKDOWN = ORACLES["html_markdown"].rpartition("select doc_id, length")[0]
ORACLES["pages_to_documents"] = f"""{_MARKDOWN}
select 'page_' || doc_id as slug, doc_id % 5 <> 0 and length(markdown) >= 500 as ok, case when doc_id % 5 <> 0 and length(markdown) >= 500 then length(markdown) else 0 end as chars,
  case when doc_id % 5 = 0 then 'gone' when length(markdown) >= 500 then '' else 'page too short (' || length(markdown) || ' characters)' end as error from m"""
