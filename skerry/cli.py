"""Command line: ``python -m skerry.cli scrape | ingest | ask | chat | eval | info``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skerry.config import Settings
from skerry.plans.engine import Engine
from skerry.sources.corpus import chosen_questions, load_eval_set

log = logging.getLogger("skerry")


def configure_logging(level: str = "INFO", file: str = "", force: bool = False) -> None:
    """Log to stderr and to ``file``; done once unless forced. An unknown level is INFO."""
    if log.handlers and not force:
        return
    log.handlers[:] = [logging.StreamHandler(sys.stderr), *([logging.FileHandler(file)] if file else [])]
    log.setLevel(getattr(logging, level.upper(), logging.INFO))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skerry")
    parser.add_argument("--log-level")
    parser.add_argument("--log-file")
    commands = parser.add_subparsers(dest="command", required=True)
    scrape = commands.add_parser("scrape")
    scrape.add_argument("--wiki")
    scrape.add_argument("--character")
    commands.add_parser("ingest")
    ask = commands.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--k", type=int, default=0)
    ask.add_argument("--sources", action=argparse.BooleanOptionalAction, default=True)
    commands.add_parser("chat")
    evaluation = commands.add_parser("eval")
    evaluation.add_argument("path")
    evaluation.add_argument("--limit", type=int, default=0)
    evaluation.add_argument("--category")
    evaluation.add_argument("--retrieval-only", action="store_true")
    evaluation.add_argument("--out")
    commands.add_parser("info")
    given = parser.parse_args(args)
    settings = Settings.from_env()
    configure_logging(given.log_level or settings.log_level, given.log_file or settings.log_file)
    spark = SparkSession.builder.appName("skerry").getOrCreate()

    def answer(question: str, k: int = 0, with_sources: bool = True) -> None:
        rows = spark.createDataFrame([("q", question)], "query_id string, question string")
        row = engine.ask(rows, k or None).first()
        print(row["answer"])
        for s in (row["sources"] or []) if with_sources else []:
            print(f"  [{s['rank']}] {s['title']} — {s['section']} ({s['score']}) {s['url']}")

    try:
        engine = Engine(spark, settings)
        if given.command in ("ingest", "ask", "chat", "eval"):
            for model in engine.check_ready(given.command == "eval"):
                log.warning("the model server doesn't list %s", model)
        if given.command == "scrape":
            rows = engine.scrape(given.wiki, given.character)
            for r in rows.orderBy("wiki", "slug").toLocalIterator():
                print(f"  {'ok' if r['ok'] else 'FAIL'}  {r['wiki']} {r['title']}" + (f" ({r['chars']} characters)" if r["ok"] else f": {r['error']}"))
            n = rows.agg(F.count_if("ok"), F.count("*")).first()
            print(f"{n[0]} scraped, {n[1] - n[0]} failed")
        elif given.command == "ingest":
            print(engine.ingest())
        elif given.command == "ask":
            answer(given.question, given.k, given.sources)
        elif given.command == "chat":
            for line in iter(lambda: input("> ").strip(), ""):
                answer(line)
        elif given.command == "eval":
            report, results = engine.evaluate(chosen_questions(load_eval_set(spark, given.path), given.category, given.limit), given.retrieval_only)
            report.show(truncate=False)
            if given.out:
                engine.write_report(report, results, given.out, given.retrieval_only)
        else:
            for name, value in engine.describe().items():
                print(f"{name}: {value}")
    except (FileNotFoundError, RuntimeError, ValueError) as e:
        log.error("%s", e)
        return 1
    except EOFError:
        return 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
