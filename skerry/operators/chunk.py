"""Documents to chunks: sections by headings, paragraphs packed to a size, with overlap.

All of it is one projection per document: headings are found by one regular expression,
and the sequential part, packing, is a fold over the section's paragraphs. No shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import INLINE_SPACE, SPACE, strip, unix_lines

#: Noncharacters of Unicode, which no text holds, mark where a heading starts and ends.
_OPEN, _CLOSE = "﷐", "﷑"


def sections(text: Column) -> Column:
    """array<struct<section, body>>: text by its nearest heading; blank sections vanish."""
    marked = F.regexp_replace(unix_lines(text), rf"(?md)^#{{1,6}}{INLINE_SPACE}+(.*)$", f"{_OPEN}$1{_CLOSE}")
    parts = F.transform(
        F.split(marked, _OPEN),
        lambda part, i: F.struct(
            F.when(i == 0, F.lit("")).otherwise(strip(F.substring_index(part, _CLOSE, 1))).alias("section"),
            strip(F.when(i == 0, part).otherwise(F.substring_index(part, _CLOSE, -1))).alias("body"),
        ),
    )
    return F.filter(parts, lambda part: part["body"] != "")


def paragraphs(body: Column) -> Column:
    parts = F.transform(F.split(body, rf"\n{SPACE}*\n"), strip)
    return F.filter(parts, lambda part: part != "")


def hard_split(paragraph: Column, most: int) -> Column:
    """array<struct<text, forced>>: a paragraph longer than ``most`` is cut after the last sentence end in its upper half, else at ``most``."""
    half = most // 2
    turns = F.ceil(F.length(paragraph) / half).cast("int") + 1
    empty = F.expr("cast(array() as array<struct<text:string,forced:boolean>>)")
    start = F.struct(paragraph.alias("rest"), empty.alias("out"))

    def turn(state: Column, _: Column) -> Column:
        rest = state["rest"]
        window = F.substring(rest, 1, most)
        back = F.locate(" .", F.reverse(window))
        # the sentence end's full stop is at most - back, counted from 1
        cut = F.when((back > 0) & (F.length(window) - 1 - back > half), F.length(window) - back).otherwise(F.lit(most))
        head = F.struct(strip(F.left(rest, cut)).alias("text"), F.lit(True).alias("forced"))
        more = F.struct(strip(F.substring(rest, cut + 1, F.length(rest))).alias("rest"), F.concat(state["out"], F.array(head)).alias("out"))
        return F.when(F.length(rest) > most, more).otherwise(state)

    whole = F.array(F.struct(paragraph.alias("text"), F.lit(False).alias("forced")))
    cut = F.aggregate(
        F.sequence(F.lit(1), turns), start, turn,
        lambda s: F.concat(s["out"], F.array(F.struct(s["rest"].alias("text"), F.lit(False).alias("forced")))),
    )
    return F.when(F.length(paragraph) > most, cut).otherwise(whole)


def pack(body: Column, most: int, overlap: int) -> Column:
    """array<string>: paragraphs joined up to ``most`` characters; a piece begins with the tail of the one before."""
    atoms = F.flatten(F.transform(paragraphs(body), lambda p: hard_split(p, most)))
    start = F.struct(F.lit("").alias("current"), F.expr("cast(array() as array<string>)").alias("out"))

    def closed(state: Column) -> Column:
        return F.when(state["current"] == "", state["out"]).otherwise(F.concat(state["out"], F.array(state["current"])))

    def add(state: Column, atom: Column) -> Column:
        current, text = state["current"], atom["text"]
        joined = F.when(current == "", text).otherwise(F.concat(current, F.lit("\n\n"), text))
        tail = F.concat(F.lit("..."), F.right(current, F.lit(overlap)), F.lit("\n\n"), text) if overlap else text
        forced = F.struct(F.lit("").alias("current"), F.concat(closed(state), F.array(text)).alias("out"))
        kept = F.struct(joined.alias("current"), state["out"].alias("out"))
        turned = F.struct(tail.alias("current"), closed(state).alias("out"))
        return F.when(atom["forced"], forced).when(text == "", state).when(F.length(joined) <= most, kept).otherwise(turned)

    return F.aggregate(atoms, start, add, closed)


def chunk_documents(docs: DataFrame, most: int = 1800, overlap: int = 250, doc: str = "doc_id", title: str = "title", text: str = "text", metadata: Column | None = None) -> DataFrame:
    """doc_id, chunk_id, section, text (and metadata) of every chunk; ordinals count from 0 over a document's sections.

    A document without text has no chunk; a null title is written as an empty one.
    """
    found = F.transform(
        sections(F.col(text)),
        lambda s: F.transform(pack(s["body"], most, overlap), lambda piece: F.struct(s["section"].alias("section"), piece.alias("piece"))),
    )
    extra = [] if metadata is None else [metadata.alias("metadata")]
    rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(title), F.lit("")).alias("__title"), *extra, F.posexplode(F.flatten(found)).alias("__no", "__c"))
    header = F.concat(F.lit("["), F.col("__title"), F.lit("]"), F.when(F.col("__c.section") != "", F.concat(F.lit(" — "), F.col("__c.section"))).otherwise(""))
    return rows.select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("__no").cast("string")).alias("chunk_id"),
        F.col("__c.section").alias("section"), F.concat(header, F.lit("\n"), F.col("__c.piece")).alias("text"), *(["metadata"] if extra else []),
    )
