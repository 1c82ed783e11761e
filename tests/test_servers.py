"""Model, wiki and vector servers, played by a local one."""

import json
import math
import threading
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from skerry.config import Settings
from skerry.operators import context, providers
from skerry.plans.engine import Engine
from skerry.sources.corpus import load_corpus
from skerry.sources.index import IndexError_
from skerry.operators.scrape import documents_of, page_jobs
from skerry.sources import wiki
from skerry.sources.remote import VectorServer


class Server(BaseHTTPRequestHandler):
    points: dict = {}
    fails = 0
    asked: list = []
    models: list = []

    def log_message(self, *args):
        pass

    def reply(self, body, status=200):
        data = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def handle_any(self):
        n = int(self.headers.get("Content-Length") or 0)
        body, path = json.loads(self.rfile.read(n) or b"{}"), self.path
        if Server.fails:
            Server.fails -= 1
            return self.reply({}, 500)
        if "api.php" in path:
            Server.asked.append(path)
            if "list=search" in path:
                if "/dc/" in path:
                    return self.reply({}, 500)
                return self.reply({"query": {"search": [{"title": " "}, {"title": "Green Knight"}, {"title": "Other"}]}})
            if "Gone" in path:
                return self.reply({"error": {"info": "no such page"}})
            return self.reply({"parse": {"title": "Resolved", "text": "<p>" + "words " * 200 + "</p>"}})
        if path == "/v1/embeddings":
            return self.reply({"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]})
        if path == "/v1/chat/completions":
            Server.models.append((body["model"], body["messages"]))
            return self.reply({"choices": [{"message": {"content": " 4 of 5 "}}]})
        if path == "/api/embed":
            return self.reply({"embeddings": [[1.0]]})
        if path == "/api/tags":
            return self.reply({"models": [{"name": "m:latest"}]})
        if path == "/api/chat":
            return self.reply({"message": {}})
        if path.startswith("/collections/"):
            if self.command == "DELETE":
                there = bool(Server.points)
                Server.points.clear()
                return self.reply({}, 200 if there else 404)
            if "/points?wait" in path:
                Server.points.update({p["id"]: p for p in body["points"]})
            elif path.endswith("/count"):
                return self.reply({"result": {"count": len(Server.points)}})
            elif path.endswith("/scroll") and "filter" not in body:
                ids = sorted(Server.points)
                begin = body.get("offset", 0)
                page = [Server.points[i] for i in ids[begin : begin + body["limit"]]]
                return self.reply({"result": {"points": page, "next_page_offset": begin + len(page) if begin + len(page) < len(ids) else None}})
            elif path.endswith("/scroll"):
                want = body["filter"]["must"][0]["match"]["value"]
                return self.reply({"result": {"points": [p for p in Server.points.values() if p["payload"]["doc_id"] == want][:1]}})
            elif path.endswith("/search"):
                cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
                best = sorted(Server.points.values(), key=lambda p: -cos(p["vector"], body["vector"]))[: body["limit"]]
                return self.reply({"result": [{"id": p["id"], "score": cos(p["vector"], body["vector"]), "payload": p["payload"]} for p in best]})
            elif self.command == "GET":
                return self.reply({"result": {}}, 200 if Server.points else 404)
            return self.reply({})
        return self.reply({}, 404)

    do_GET = do_POST = do_PUT = do_DELETE = handle_any


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_model_server(spark, url):
    v1 = providers.HttpProvider(url, "e", "c", batch=2)
    assert v1.embed(["a", "bbb", "cc"]) == [[1.0, 1.0], [3.0, 1.0], [2.0, 1.0]] and v1.embed([]) == []
    Server.fails = 1
    assert v1.generate("x", "s") == "4 of 5"
    local = providers.HttpProvider(url, "e", "c", style="local", attempts=1)
    assert providers.missing_models(local, ["m", "n"]) == ["n"]
    with pytest.raises(providers.ProviderError):
        local.embed(["a", "b"])
    with pytest.raises(providers.ProviderError):
        local.generate("x")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, text string")
    assert {r["k"]: r["embedding"] for r in providers.with_embedding(rows, v1).collect()} == {1: [1.0, 1.0], 2: None}
    asked = spark.createDataFrame([("q", "c", "a", "r"), ("q2", None, None, None)], "question string, context string, answer string, reference_answer string")
    assert {r["faithfulness"] for r in providers.with_judgements(asked, v1).collect()} == {4.0}
    assert providers.with_answer(rows.withColumnRenamed("text", "prompt"), local).filter("answer is not null").count() == 0
    same = spark.createDataFrame([("1", " A b"), ("2", "a B "), ("3", None)], "query_id string, text string")
    got = {r["query_id"]: r["vector"] for r in providers.with_query_vectors(same, v1).collect()}
    assert got["1"] == got["2"] == [3.0, 1.0] and got["3"] is None


def test_wiki_to_documents_and_manifest(spark, url):
    wiki.register(spark)
    fetched = spark.read.format("wiki_pages").options(base_url=url, titles="Here\nGone", delay_s="0", retries="1").load()
    pages = fetched.selectExpr("'marvel' as wiki", "title", "'u' as url", "html", "ok", "error")
    pages = pages.union(spark.createDataFrame([("dc", "Short", "u", "<p>x</p>", True, "")], pages.schema))
    documents, results = documents_of(pages, "2025-01-01")
    assert [(r["doc_id"], r["universe"]) for r in documents.collect()] == [("marvel__resolved.md", "Marvel")]
    assert {r["slug"]: (r["ok"], r["error"]) for r in results.collect()} == {"resolved": (True, ""), "gone": (False, "no such page"), "short": (False, "page too short (1 characters)")}
    jobs = page_jobs(pages, "dc", spark.createDataFrame([("x", "New Page"), ("x", " ")], "wiki string, title string"))
    assert sorted(r["slug"] for r in jobs.collect()) == ["new_page", "short"]
    assert "srsearch=a+b" in wiki.search_url(url, "a b", 3)


def test_vector_server(spark, url):
    server = VectorServer(url, batch=3)
    server.create(2)
    chunks = spark.createDataFrame([(i, f"d{i}", f"d{i}#0", "t", "", [float(i), 1.0]) for i in range(10)] + [(99, "n", "n#0", "t", "", None)], "chunk_ord bigint, doc_id string, chunk_id string, text string, section string, embedding array<float>")
    server.upsert(chunks)
    server.upsert(chunks)
    assert server.count() == 10 and server.contains("d3") and not server.contains("zz")
    queries = spark.createDataFrame([("q", [0.0, 1.0]), ("n", None)], "query_id string, vector array<double>")
    got = server.candidates(spark, queries, 2).orderBy("chunk_ord").collect()
    assert [(r["query_id"], r["chunk_ord"], r["title"]) for r in got] == [("q", 0, ""), ("q", 1, "")]
    assert sorted(server.documents(3)) == [f"d{i}" for i in range(10)] and server.exists()
    assert not VectorServer("http://127.0.0.1:9", timeout_s=1).contains("d")


def test_engine_on_a_vector_server(spark, url, tmp_path):
    engine = Engine(spark, Settings(store="server", server_url=url, corpus_dir=str(tmp_path), embed_model="hash-32", fallback=False))
    assert engine.provider.dim == 32
    (tmp_path / "a.md").write_text("---\ntitle: Red King\nsource: http://a\n---\n\nThe red king rules the tower.")
    (tmp_path / "b.md").write_text("# Blue Queen\nThe blue queen sails a ship.")
    assert engine.ingest()["documents"] == 2 and engine.index.count() == 2
    asked = spark.createDataFrame([("1", "who rules the tower"), ("2", "who sails a ship")], "query_id string, question string")
    for hybrid in (True, False):
        engine.settings = replace(engine.settings, hybrid=hybrid)
        rows = {r["query_id"]: r for r in engine.ask(asked).collect()}
        assert rows["1"]["sources"][0]["url"] == "http://a" and rows["1"]["sources"][0]["title"] == "Red King" and rows["2"]["sources"][0]["doc"] == "b.md"
    chunks = engine.chunks_of(load_corpus(spark, str(tmp_path)))
    assert engine.index.append(chunks) == 0
    (tmp_path / "c.md").write_text("# Green\nA new page.")
    assert engine.index.append(engine.chunks_of(load_corpus(spark, str(tmp_path)))) == 1 and engine.index.count() == 3
    Server.points.clear()
    with pytest.raises(IndexError_):
        engine.index.count()


def test_live_fallback_and_scrape(spark, url, tmp_path):
    settings = Settings(wikis=f"marvel={url}/m,dc={url}/dc/", corpus_dir=str(tmp_path), index_dir=str(tmp_path / "index"), embed_model="hash-32", delay_s=0, retries=1, fallback_score=2.0, provider="hash")
    engine = Engine(spark, settings)
    (tmp_path / "b.md").write_text("# Blue Queen\nThe blue queen sails a ship.")
    engine.ingest()
    asked = spark.createDataFrame([("1", "where is the green knight")], "query_id string, question string")
    Server.asked.clear()
    row = engine.ask(asked).first()
    assert row["fallback_used"] and row["fallback_doc"] == "marvel__resolved.md"  # the title after redirects
    assert any("page=Green+Knight" in x for x in Server.asked)
    assert not engine.ask(asked).first()["fallback_used"]
    assert spark.read.parquet(str(tmp_path / "manifest")).first()["slug"] == "resolved"
    got = {r["slug"]: (r["ok"], r["error"]) for r in engine.scrape("marvel", "Gone").collect()}
    assert got == {"gone": (False, "no such page")}
    assert {r["wiki"] for r in engine.scrape("dc").collect()} == {"dc"}
    for wrong in (("other", None), (None, "Title")):
        with pytest.raises(ValueError):
            engine.scrape(*wrong)


def test_judges_use_their_model_and_answers_the_system_prompt(spark, url, tmp_path):
    engine = Engine(spark, Settings(provider="v1", base_url=url, embed_model="e", chat_model="c", judge_model="j", corpus_dir=str(tmp_path), index_dir=str(tmp_path / "index"), fallback=False))
    (tmp_path / "b.md").write_text("# Blue Queen\nThe blue queen sails a ship.")
    engine.ingest()
    questions = spark.createDataFrame([("1", "c", "who", ["b.md"], "r", True)], "id string, category string, question string, relevant_docs array<string>, reference_answer string, answerable boolean")
    Server.models.clear()
    report, results = engine.evaluate(questions)
    assert results.first()["faithfulness"] == 4.0 and report.filter("overall").first()["latency_p95_s"] is not None
    roles = {(m, said[0]["content"][:12]) for m, said in Server.models}
    assert roles == {("c", context.SYSTEM[:12]), ("j", providers.JUDGE_SYSTEM[:12])}
