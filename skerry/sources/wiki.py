"""Pages of a MediaWiki server as a Python data source: ``spark.read.format("wiki_pages")``.

Options: ``base_url``, ``titles`` (one per line), ``delay_s`` (0.5) and ``retries`` (3). Rows are
title, html, ok and error: a page that can't be had is a row, not a failed job. A partition
asks for at most 50 titles, one after the other. Without a network every row has an error.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "title string, html string, ok boolean, error string"


def _get(url: str, timeout_s: int = 30) -> dict:
    with urllib.request.urlopen(url, timeout=timeout_s) as reply:
        return json.load(reply)


def with_retries(call, retries: int = 3, pause_s: float = 1.0):
    """``call()``, tried again after pauses that double; the last failure is raised."""
    for i in range(retries):
        try:
            return call()
        except Exception:
            if i + 1 == retries:
                raise
            time.sleep(pause_s * 2**i)


def parse_url(base_url: str, title: str) -> str:
    ask = {"action": "parse", "page": title, "prop": "text", "redirects": 1, "format": "json", "formatversion": 2}
    return f"{base_url.rstrip('/')}/api.php?{urllib.parse.urlencode(ask)}"


def search_url(base_url: str, query: str, limit: int) -> str:
    ask = {"action": "query", "list": "search", "srsearch": query, "srlimit": limit, "format": "json", "formatversion": 2}
    return f"{base_url.rstrip('/')}/api.php?{urllib.parse.urlencode(ask)}"


def parsed_page(reply: dict) -> tuple[str, str]:
    """(title after redirects, html) of a parse reply."""
    if "error" in reply:
        raise ValueError(reply["error"].get("info", "unknown error"))
    return reply["parse"]["title"], reply["parse"]["text"]


def found_titles(reply: dict) -> list[str]:
    return [x.get("title", "") for x in reply.get("query", {}).get("search", [])]


class WikiPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wiki_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.base, self.delay, self.retries = options["base_url"], float(options.get("delay_s", 0.5)), int(options.get("retries", 3))
        self.titles = [t for t in options.get("titles", "").split("\n") if t.strip()]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.titles[i : i + 50]) for i in range(0, len(self.titles), 50)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, title in enumerate(partition.value):
            if i:
                time.sleep(self.delay)
            try:
                yield (*parsed_page(with_retries(lambda t=title: _get(parse_url(self.base, t)), self.retries)), True, "")
            except Exception as e:
                yield title, None, False, str(e)[:500]


def search_wikis(questions: DataFrame, wikis: dict[str, str], limit: int, delay_s: float = 0.5, retries: int = 3) -> DataFrame:
    """query_id, query, wiki, titles: what each wiki's search gives for each question (query_id, query), asked for where the
    questions lie. A wiki that doesn't answer gives no row."""
    kind = questions.schema["query_id"].dataType.simpleString()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for q, text in zip(frame["query_id"], frame["query"], strict=True):
                for wiki, base in wikis.items():
                    try:
                        out.append((q, text, wiki, found_titles(with_retries(lambda b=base, t=text: _get(search_url(b, t, limit)), retries))))
                    except Exception:  # noqa: BLE001, S112
                        continue
                    time.sleep(delay_s)
            yield pd.DataFrame(out, columns=["query_id", "query", "wiki", "titles"])

    rows = questions.select("query_id", "query").filter("query is not null")
    return rows.mapInPandas(ask, f"query_id {kind}, query string, wiki string, titles array<string>")


def fetch_pages(wanted: DataFrame, wikis: dict[str, str], delay_s: float = 0.5, retries: int = 3) -> DataFrame:
    """asked, wiki, title (after redirects), url, html, ok, error of each page (wiki, title); a page that can't be had is a row."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for wiki, title in zip(frame["wiki"], frame["title"], strict=True):
                base = wikis.get(wiki, "").rstrip("/")
                url = f"{base}/wiki/{title.replace(' ', '_')}"
                try:
                    if not base:
                        raise ValueError(f"no wiki is called {wiki}")
                    out.append((title, wiki, *parsed_page(with_retries(lambda b=base, t=title: _get(parse_url(b, t)), retries)), url, True, ""))
                except Exception as e:  # noqa: BLE001
                    out.append((title, wiki, title, None, url, False, str(e)[:500]))
                time.sleep(delay_s)
            yield pd.DataFrame(out, columns=["asked", "wiki", "title", "html", "url", "ok", "error"])

    return wanted.select("wiki", "title").mapInPandas(ask, "asked string, wiki string, title string, html string, url string, ok boolean, error string")


def page_list(spark: SparkSession, file: str = "") -> DataFrame:
    """wiki, title of the pages to take by default: of a CSV file with these columns, else a few well-known ones."""
    if file:
        return spark.read.csv(file, header=True, schema="wiki string, title string").filter(F.col("title").isNotNull())
    return spark.createDataFrame([(wiki, title) for wiki, titles in PAGES.items() for title in titles], "wiki string, title string")


#: Pages that are taken when none are named.
PAGES = {
    "marvel": ("Peter Parker (Earth-616)", "Anthony Stark (Earth-616)", "Steven Rogers (Earth-616)", "Thor Odinson (Earth-616)", "Ororo Munroe (Earth-616)"),
    "dc": ("Superman (Clark Kent)", "Batman (Bruce Wayne)", "Diana of Themyscira (New Earth)", "Barry Allen (New Earth)", "Arthur Curry (New Earth)"),
}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WikiPages)
