import json

import pytest

from skerry.config import Settings
from skerry.operators import providers
from skerry.plans.engine import Engine
from skerry.sources import wiki
from skerry.sources.corpus import chosen_questions, corpus_page, load_corpus, load_eval_set, load_manifest
from skerry.sources.index import ChunkIndex, IndexError_
from skerry.streaming.append import append_documents


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    (folder / "a__red_king.md").write_text("---\ntitle: Red King\nuniverse: X\nsource: http://a\n---\n\n# Red King\n\nThe red king rules the tower.\n\n## Powers\nHe can fly over the sea.")
    (folder / "b.txt").write_text("# Blue Queen\r\nThe blue queen sails a ship at night.")
    (folder / "skip.json").write_text("{}")
    return str(folder)


@pytest.fixture
def engine(spark, tmp_path, corpus):
    made = Engine(spark, Settings(corpus_dir=corpus, index_dir=str(tmp_path / "index"), embed_model="hash-32", fallback_score=0.0))
    made.ingest()
    return made


def test_corpus(spark, corpus):
    rows = {r["doc_id"]: r for r in load_corpus(spark, corpus).collect()}
    assert rows["a__red_king.md"]["title"] == "Red King" and rows["a__red_king.md"]["meta"]["source"] == "http://a"
    assert rows["b.txt"]["title"] == "Blue Queen" and rows["b.txt"]["body"].startswith("# Blue Queen\nThe") and len(rows) == 2
    page = corpus_page(spark.createDataFrame([("w", "A B", "X", "u", "2025-01-01", "text")], "wiki string, title string, universe string, source string, scraped string, body string")).first()
    assert page["doc_id"] == "w__a_b.md" and page["content"].startswith("---\ntitle: A B\n") and page["content"].endswith("# A B\n\ntext\n")


def test_ask(spark, engine):
    asked = spark.createDataFrame([("1", "Who sails a ship?"), ("2", "Who rules the tower?")], "query_id string, question string")
    got = {r["query_id"]: r for r in engine.ask(asked).collect()}
    assert "blue queen" in got["1"]["answer"] and got["2"]["sources"][0]["doc"] == "a__red_king.md"
    assert got["1"]["sources"][0]["rank"] == 1 and not got["1"]["fallback_used"]


def test_index_append_is_idempotent_and_like_a_rebuild(spark, engine, tmp_path):
    chunks = engine.index.open()
    n = engine.index.count()
    assert engine.index.append(chunks) == 0 and engine.index.count() == n
    half = ChunkIndex(spark, str(tmp_path / "half")).create(chunks.filter("doc_id = 'b.txt'"))
    half.append(chunks)
    view = lambda df: sorted((r["chunk_id"], r["text"]) for r in df.collect())
    assert view(half.open()) == view(chunks)
    assert half.open().select("chunk_ord").distinct().count() == n
    with pytest.raises(IndexError_):
        ChunkIndex(spark, str(tmp_path / "none")).open()
    with pytest.raises(IndexError_):
        ChunkIndex(spark, str(tmp_path / "none")).create(chunks.limit(0))


def test_fallback_takes_a_page_in(spark, engine):
    engine.settings = Settings(**{**engine.settings.__dict__, "fallback_score": 2.0})
    pages = spark.createDataFrame([("w", "Green Knight", "http://g", "<p>" + "The green knight guards the bridge. " * 20 + "</p>"), ("w", "Short Knight", "http://s", "<p>x</p>")], "wiki string, title string, url string, html string")
    asked = spark.createDataFrame([("1", "Where is the green knight?")], "query_id string, question string")
    row = engine.ask(asked, pages=pages).first()
    assert row["fallback_used"] and row["sources"][0]["doc"] == "w__green_knight.md"
    assert row["fallback_doc"] == "w__green_knight.md"
    again = engine.fetch(asked, pages).first()
    assert not again["ok"] and again["skipped_existing"] and again["chunks_added"] == 0
    short = engine.fetch(spark.createDataFrame([("2", "short knight short")], "query_id string, question string"), pages.filter("title = 'Short Knight'")).first()
    assert not short["ok"] and "too short" in short["error"]


def test_only_questions_whose_page_was_added_used_the_fallback(spark, engine):
    engine.settings = Settings(**{**engine.settings.__dict__, "fallback_score": 2.0})
    page = lambda x: "<p>" + f"The {x} guards the bridge. " * 30 + "</p>"
    pages = spark.createDataFrame([("w", "Green Knight", "http://g", page("green knight")), ("w", "Short Squire", "http://s", "<p>x</p>")], "wiki string, title string, url string, html string")
    asked = spark.createDataFrame([("1", "Where is the green knight?"), ("2", "Where is the short squire?"), ("3", "zzz")], "query_id string, question string")
    got = {r["query_id"]: (r["fallback_used"], r["fallback_doc"]) for r in engine.ask(asked, pages=pages).collect()}
    assert got == {"1": (True, "w__green_knight.md"), "2": (False, ""), "3": (False, "")}
    docs = {r["doc_id"]: r for r in load_corpus(spark, engine.settings.corpus_dir).collect()}
    assert docs["w__green_knight.md"]["meta"]["source"] == "http://g" and len(docs) == 3
    assert {r["slug"]: r["ok"] for r in spark.read.parquet(engine.settings.corpus_dir + "/manifest").collect()} == {"green_knight": True, "short_squire": False}


def test_evaluation(spark, engine, tmp_path):
    path = tmp_path / "eval.json"
    path.write_text(json.dumps({"questions": [{"question": "Who sails a ship?", "relevant_docs": ["b.txt"], "reference_answer": "the blue queen", "category": "f"}, {"question": "zzz", "answerable": False}]}))
    questions = load_eval_set(spark, str(path))
    assert [r["id"] for r in questions.orderBy("pos").collect()] == ["q1", "q2"]
    assert chosen_questions(questions, "f", 0).count() == 1
    with pytest.raises(ValueError):
        chosen_questions(questions, "other")
    report, results = engine.evaluate(questions)
    overall = report.filter("overall").first()
    assert overall["hit_rate"] == 1.0 and overall["n"] == 2 and overall["faithfulness"] == 3.0
    assert {r["query_id"]: r["token_f1"] is None for r in results.collect()} == {"q1": False, "q2": True}
    assert "token_f1" not in engine.evaluate(questions, retrieval_only=True)[0].columns
    rows = {r["query_id"]: r for r in results.collect()}
    assert rows["q1"]["retrieved_docs"][0] == "b.txt" and rows["q1"]["total_seconds"] > rows["q1"]["retrieval_seconds"] > 0
    assert "(from:" not in rows["q1"]["context"]  # judges read the plain texts
    engine.write_report(report, results, str(tmp_path / "report"))
    summary = json.loads(next((tmp_path / "report" / "summary").glob("part-*.json")).read_text())
    assert summary["overall"]["hit_rate"] == 1.0 and summary["by_category"]["f"]["n"] == 1 and summary["config"]["top_k"] == 5 and summary["run_at"]
    told = [json.loads(line) for x in (tmp_path / "report" / "questions").glob("part-*.json") for line in x.read_text().splitlines()]
    assert {q["id"]: q["scores"]["hit_rate"] for q in told} == {"q1": 1.0, "q2": None}


def test_manifest_files(spark, tmp_path):
    good, bad = tmp_path / "m.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"pages": [{"wiki": "w", "title": "T", "slug": "t", "ok": True, "chars": 3}]}))
    bad.write_text("{nonsense")
    assert load_manifest(spark, str(good)).first()["slug"] == "t"
    assert load_manifest(spark, str(bad)).count() == 0


def test_providers():
    hash_ = providers.HashProvider(8)
    assert hash_.embed(["a b", "a b"])[0] == hash_.embed(["a b"])[0] and hash_.generate("nothing") == "I don't know."
    assert providers.missing_models(hash_, ["hash-8", "other"]) == ["other"]
    with pytest.raises(providers.ProviderError):
        providers.HttpProvider("https://far.example", "e", "c")
    with pytest.raises(providers.ProviderError):
        providers.create(Settings(provider="unknown"))
    assert providers.HttpProvider("http://localhost:1", "e", "c", attempts=1).describe().startswith("v1")


def test_models_and_judge():
    one = providers.HttpProvider("http://localhost:1", "e", "c", attempts=1)
    assert providers.judge_of(one, Settings(chat_model="c", judge_model="j")).chat_model == "j"
    assert providers.judge_of(one, Settings(chat_model="c")).chat_model == "c"
    with pytest.raises(providers.ProviderError):
        providers.check_ready(providers.HashProvider(8), ["other"])
    assert providers.check_ready(providers.HashProvider(8), ["hash-8"]) == []
    kept = providers._Remembered(providers.HashProvider(8), 2)
    assert kept.embed(["a", "b", "a", "c"]) == providers.HashProvider(8).embed(["a", "b", "a", "c"])
    assert list(providers._vectors[repr(providers.HashProvider(8))]) == ["b", "c"]


def test_stores(spark):
    with pytest.raises(IndexError_):
        Engine(spark, Settings(store="other"))


def test_settings():
    got = Settings.from_env({"SKERRY_TOP_K": "7", "SKERRY_ALPHA": "", "SKERRY_HYBRID": "no", "SKERRY_CHAT_MODEL": "m"})
    assert (got.top_k, got.alpha, got.hybrid, got.effective_judge) == (7, 0.7, False, "m")


def test_wiki_source(spark):
    wiki.register(spark)
    rows = spark.read.format("wiki_pages").options(base_url="http://127.0.0.1:9", titles="A\nB", delay_s="0", retries="1").load().collect()
    assert [(r["title"], r["ok"]) for r in sorted(rows)] == [("A", False), ("B", False)] and all(r["error"] for r in rows)
    assert wiki.parsed_page({"parse": {"title": "T", "text": "h"}}) == ("T", "h")
    with pytest.raises(ValueError):
        wiki.parsed_page({"error": {"info": "gone"}})
    assert wiki.found_titles({"query": {"search": [{"title": "x"}, {}]}}) == ["x", ""]


def test_stream_appends_once(spark, engine, tmp_path):
    arriving = str(tmp_path / "arriving")
    docs = spark.createDataFrame([("n1", "New", "Fresh text of a new page."), ("b.txt", "Old", "ignored")], "doc_id string, title string, text string")
    docs.write.parquet(arriving)
    before = engine.index.count()
    for checkpoint in ("c1", "c1", "c2"):
        append_documents(spark, arriving, docs.schema.simpleString()[7:-1].replace(":", " "), engine.index, engine.provider, str(tmp_path / checkpoint)).awaitTermination()
    assert engine.index.count() == before + 1
