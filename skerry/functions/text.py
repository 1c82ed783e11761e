"""Text expressions: built-in Spark functions only, so all of them stay in the JVM.

Character classes are written out, for the classes of Java, RE2 and Python differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.strip`` knows it, and the same without the newline.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INLINE_SPACE = SPACE.replace(r"\t-\r", r"\t\x{0b}-\r")
LINE_END = r"\r\n|[\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

#: The words that answers are compared without, and the phrases of an abstention.
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "of", "in", "on", "and", "or", "to", "his", "her", "their", "its", "he", "she",
    "they", "it", "as", "by", "with", "for", "that", "this", "at", "from", "be", "been", "has", "have", "had",
)
ABSTENTION = (
    r"don'?t know|do not know|not in my knowledge|no information|not mentioned|"
    r"not (?:contained|available|found|present) in|cannot (?:find|answer)|unable to (?:find|answer)"
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+", "")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, LINE_END, "\n")


def search_tokens(text: Column) -> Column:
    """Terms of the lexical index: ASCII letters and digits, with one inner apostrophe group."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))


def answer_tokens(text: Column) -> Column:
    """Terms that answers are compared by, repeated ones kept, stop words left out."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def slugify(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def page_doc_id(wiki: Column, title: Column) -> Column:
    return F.concat(wiki, F.lit("__"), slugify(title), F.lit(".md"))


def page_url(base: Column, title: Column) -> Column:
    return F.concat(base, F.lit("/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))


def normal_query(text: Column) -> Column:
    return F.lower(strip(text))


def is_abstention(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(f"(?i){ABSTENTION}")


def judged(raw: Column) -> Column:
    """The first digit from 1 to 5 of a judge's reply; null if there is none."""
    return F.nullif(F.regexp_extract(raw, "[1-5]", 0), F.lit("")).cast("double")


def front_matter(text: Column) -> tuple[Column, Column]:
    """(meta map, body): a head between ``---`` lines, of which later keys win; the body is stripped on its left."""
    lines = unix_lines(text)
    close = F.locate("\n---\n", lines, 5)
    has = lines.startswith("---\n") & (close > 0)
    head = F.substring(lines, F.lit(5), F.greatest(close - 5, F.lit(0)))
    pairs = F.transform(
        F.filter(F.split(head, "\n"), lambda line: line.contains(":")),
        lambda line: F.struct(
            strip(F.substring_index(line, ":", 1)).alias("key"),
            strip(F.substring(line, F.locate(":", line) + 1, F.length(line))).alias("value"),
        ),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    none = F.expr("cast(map() as map<string,string>)")
    body = F.when(has, F.substring(lines, close + 5, F.length(lines))).otherwise(lines)
    return F.when(has, F.map_from_entries(last)).otherwise(none), lstrip(body)


def resolved_title(meta: Column, body: Column, name: Column) -> Column:
    """The front matter's title, else a heading of the first level at the body's start, else the file's stem."""
    heading = F.regexp_extract(body, rf"\A#{INLINE_SPACE}+([^\n]+)", 1)
    stem = F.regexp_replace(name, r"\.[^.]*\z", "")
    return F.coalesce(F.nullif(meta["title"], F.lit("")), F.nullif(strip(heading), F.lit("")), stem)
