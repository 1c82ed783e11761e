import json

import pytest

from skerry.cli import main


@pytest.fixture
def home(tmp_path, monkeypatch):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "b.md").write_text("# Blue Queen\nThe blue queen sails a ship at night.")
    for name, value in {"CORPUS_DIR": corpus, "INDEX_DIR": tmp_path / "index", "EMBED_MODEL": "hash-32", "FALLBACK": "no", "DELAY_S": "0", "RETRIES": "1"}.items():
        monkeypatch.setenv(f"SKERRY_{name}", str(value))
    monkeypatch.setenv("SKERRY_WIKIS", "marvel=http://127.0.0.1:9/m,dc=http://127.0.0.1:9/d")
    return tmp_path


def test_commands(spark, home, capsys, monkeypatch):
    assert main(["ask", "who?"]) == 1  # there is no index yet
    assert main(["ingest"]) == 0 and main(["ask", "who sails a ship", "--k", "1"]) == 0
    said = capsys.readouterr().out
    assert "'documents': 1" in said and "blue queen sails" in said and "[1] Blue Queen" in said
    assert main(["info"]) == 0 and "chunks: 1" in capsys.readouterr().out
    lines = iter(["who sails", ""])
    monkeypatch.setattr("builtins.input", lambda *_: next(lines))
    assert main(["chat"]) == 0 and "blue queen" in capsys.readouterr().out


def test_eval_and_scrape(spark, home, capsys):
    assert main(["ingest"]) == 0
    path = home / "eval.json"
    path.write_text(json.dumps({"questions": [{"question": "Who sails a ship?", "relevant_docs": ["b.md"]}]}))
    assert main(["eval", str(path), "--out", str(home / "out"), "--retrieval-only"]) == 0
    summary = json.loads(next((home / "out" / "summary").glob("part-*.json")).read_text())
    assert summary["overall"]["hit_rate"] == 1.0 and summary["config"]["retrieval_only"]
    assert main(["eval", str(path), "--category", "none"]) == 1
    assert main(["scrape", "--wiki", "other"]) == 1 and main(["scrape", "--character", "X"]) == 1
    capsys.readouterr()
    assert main(["scrape", "--wiki", "dc", "--character", "Some One"]) == 0  # no server answers: a failed page is a row
    said = capsys.readouterr().out
    assert "FAIL  dc Some One" in said and "0 scraped, 1 failed" in said
    assert main(["ask", "x"]) == 0
