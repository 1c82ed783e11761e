"""Lines repeated across the documents of one wiki (problem 5).

Each line's documents are held as compressed bitmaps: documents are numbered within their
wiki, a bitmap is cut into containers of 32,768 numbers and only the containers that hold
a document exist. A container is the sorted array of its numbers (two bytes each) or, where
that would be longer, 4,096 bytes of bits. Bitmaps are built per written variant of a line,
the variants' bitmaps are united per normalised line, and the cardinality of the union is the
exact number of documents, however many rows a document has.

Plan. The first reading of the texts counts rows per hash of a normalised line. Lines on too
few rows to reach the threshold in any case go no further: their row count, summed on the
map side first, bounds their documents from above, so this drops nothing; nor does a hash
that two lines share, for it only raises the count. The second reading keeps what is left,
with the normalised line itself, by which everything from there on is grouped. That is per wiki at
most ten times the average number of lines of a document. Every side that is broadcast was counted before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.session import cut

BROADCAST_ROWS = 100_000
CONTAINER, FEW = 1 << 15, 2048


def source_of(doc_id: Column) -> Column:
    """The part of a document's id before the first ``__``."""
    return F.split(doc_id, "__", 2)[0]


def normalised(text: Column) -> Column:
    """The lines of a text: lower case, digit runs as ``0``, runs of other signs as one space, trimmed."""
    digits = F.regexp_replace(F.lower(text), r"\p{Nd}+", "0")
    return F.transform(F.split(F.regexp_replace(digits, r"[^\p{L}\p{N}\n]+", " "), "\n"), lambda line: F.btrim(line))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _numbered(chunks: DataFrame, salts: int = 64) -> DataFrame:
    """__wiki, __doc, __no: documents numbered from 0 within their wiki, without one task per wiki."""
    docs = chunks.groupBy("__wiki", "__doc").agg(F.count("*").alias("__rows"))
    docs = docs.withColumn("__salt", F.pmod(F.xxhash64("__doc"), F.lit(salts)))
    sizes = docs.groupBy("__wiki", "__salt").agg(F.count("*").alias("__size"))
    before = F.expr(
        "coalesce(sum(__size) over (partition by __wiki order by __salt rows between unbounded preceding and 1 preceding), 0)"
    )
    offsets = sizes.select("__wiki", "__salt", before.alias("__before"))
    place = F.expr("row_number() over (partition by __wiki, __salt order by __doc)")
    return (
        docs.select("__wiki", "__doc", "__salt", place.alias("__place"))
        .join(offsets, ["__wiki", "__salt"])
        .select("__wiki", "__doc", (F.col("__before") + F.col("__place") - 1).alias("__no"))
    )


def candidate_lines(df: DataFrame, docs: DataFrame, doc: str, text: str, key: str, least_docs: int, least_share: tuple[int, int]) -> DataFrame:
    """__key, __wiki, __line_no (from 1), __norm, __variant, __no (of the document), __few of lines on enough rows.

    ``__few`` says that the line has at most as many rows as an array container may hold.
    """
    up, down = least_share
    rows = df.select(F.col(key).alias("__key"), F.col(doc).alias("__doc"), source_of(F.col(doc)).alias("__wiki"), F.col(text).alias("__text"))
    rows = rows.filter("__wiki is not null and __text is not null")
    totals = docs.groupBy("__wiki").agg(F.count("*").alias("__total"))
    counts = rows.select("__wiki", F.explode(normalised(F.col("__text"))).alias("__norm")).filter("__norm <> ''")
    counts = counts.groupBy("__wiki", F.xxhash64("__norm").alias("__hash")).agg(F.count("*").alias("__rows")).filter(F.col("__rows") >= least_docs)
    wanted = cut(counts.join(totals, "__wiki").filter(F.col("__rows") * down >= F.col("__total") * up).select("__wiki", "__hash", (F.col("__rows") <= FEW).alias("__few")))
    lines = rows.select("__key", "__doc", "__wiki", F.posexplode(F.arrays_zip(normalised(F.col("__text")).alias("norm"), F.split("__text", "\n").alias("line"))).alias("__pos", "__l"))
    lines = lines.filter("__l.norm <> ''").select("__key", "__doc", "__wiki", (F.col("__pos") + 1).cast("bigint").alias("__line_no"), F.col("__l.norm").alias("__norm"), F.xxhash64("__l.line").alias("__variant"), F.xxhash64("__l.norm").alias("__hash"))
    lines = lines.join(_small(wanted, wanted.count()), ["__wiki", "__hash"]).drop("__hash")
    return lines.join(docs, ["__wiki", "__doc"]).drop("__doc")


def bitmaps_of(lines: DataFrame) -> DataFrame:
    """__wiki, __norm, __bucket, __numbers or __bits, and __size of each container of each line."""
    numbers = lines.select("__wiki", "__norm", "__few", "__variant", F.expr(f"cast(__no div {CONTAINER} as int)").alias("__bucket"), F.expr(f"cast(__no % {CONTAINER} as smallint)").alias("__at"))
    variants = numbers.groupBy("__wiki", "__norm", "__few", "__variant", "__bucket").agg(F.sort_array(F.collect_set("__at")).alias("__numbers"))
    members = variants.select("__wiki", "__norm", "__few", "__bucket", F.explode("__numbers").alias("__at"))
    group = ["__wiki", "__norm", "__bucket"]
    short = members.filter("__few").groupBy(*group).agg(F.sort_array(F.collect_set("__at")).alias("__numbers"))
    long = members.filter("not __few").groupBy(*group).agg(F.expr("bitmap_construct_agg(cast(__at as bigint))").alias("__bits"))
    return short.select(*group, "__numbers", F.lit(None).cast("binary").alias("__bits"), F.size("__numbers").cast("bigint").alias("__size")).unionByName(
        long.select(*group, F.lit(None).cast("array<smallint>").alias("__numbers"), "__bits", F.expr("bitmap_count(__bits)").alias("__size"))
    )


def repeated_lines(
    df: DataFrame, doc: str = "doc_id", text: str = "text", key: str = "chunk_ord",
    least_docs: int = 5, least_share: tuple[int, int] = (1, 10),
) -> tuple[DataFrame, DataFrame]:
    """(lines, bitmaps): ``bitmaps`` has the containers and n_docs of each line in at least ``least_docs``
    documents and that share of its wiki's; ``lines`` has all lines that were looked at with the number of their document.
    """
    up, down = least_share
    docs = cut(_numbered(df.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("__doc"), source_of(F.col(doc)).alias("__wiki"))))
    lines = cut(candidate_lines(df, docs, doc, text, key, least_docs, least_share))
    bitmaps = cut(bitmaps_of(lines))
    totals = docs.groupBy("__wiki").agg(F.count("*").alias("__total"))
    counts = bitmaps.groupBy("__wiki", "__norm").agg(F.sum("__size").alias("n_docs")).join(totals, "__wiki")
    kept = counts.filter((F.col("n_docs") >= least_docs) & (F.col("n_docs") * down >= F.col("__total") * up)).select("__wiki", "__norm", "n_docs")
    return lines, bitmaps.join(kept, ["__wiki", "__norm"])


HELD = """case when __bits is null then array_contains(__numbers, __at)
     else shiftright(cast(conv(hex(substring(__bits, cast(__at div 8 as int) + 1, 1)), 16, 10) as int), cast(__at % 8 as int)) & 1 = 1 end"""


def found_lines(df: DataFrame, doc: str = "doc_id", text: str = "text", key: str = "chunk_ord", **limits) -> DataFrame:
    """``key`` and line_no (from 1) of each repeated line of each row, looked up in the bitmaps.

    Null, empty and blank texts have no lines that count; a row with a null ``doc`` belongs
    to no wiki and is never a case. Repeated rows of a document add nothing to a line's
    documents but are cases themselves. An empty table gives no rows.
    """
    lines, bitmaps = repeated_lines(df, doc, text, key, **limits)
    bitmaps = cut(bitmaps)
    lines = lines.withColumn("__bucket", F.expr(f"cast(__no div {CONTAINER} as int)")).withColumn("__at", F.expr(f"cast(__no % {CONTAINER} as smallint)"))
    return (
        lines.join(_small(bitmaps, bitmaps.count() * 16), ["__wiki", "__norm", "__bucket"])
        .filter(HELD)
        .select(F.col("__key").alias(key), F.col("__line_no").alias("line_no"))
    )


def without_repeated_lines(df: DataFrame, doc: str = "doc_id", text: str = "text", key: str = "chunk_ord", **limits) -> DataFrame:
    """``key``, clean_text and n_removed of every row of ``df``, null texts as null. ``key`` is unique."""
    gone = found_lines(df, doc, text, key, **limits).groupBy(key).agg(F.collect_set("line_no").alias("__gone"))
    rows = df.select(key, F.col(text).alias("__text")).join(gone, key, "left")
    kept = F.filter(F.split("__text", "\n"), lambda line, i: ~F.array_contains(F.col("__gone"), (i + 1).cast("bigint")))
    return rows.select(
        key,
        F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("bigint").alias("n_removed"),
    )
