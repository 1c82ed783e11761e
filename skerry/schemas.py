"""Schemas of the tables that the engine reads and writes."""

from pyspark.sql import types as T

METADATA = T.StructType([T.StructField(x, T.StringType()) for x in ("title", "universe", "source")])
CHUNK = T.StructType(
    [
        T.StructField("chunk_ord", T.LongType()),
        *(T.StructField(x, T.StringType()) for x in ("doc_id", "chunk_id", "text", "section")),
        T.StructField("metadata", METADATA),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
PAGE = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("wiki", "title", "slug")]
    + [T.StructField("ok", T.BooleanType()), T.StructField("path", T.StringType()), T.StructField("url", T.StringType())]
    + [T.StructField("chars", T.LongType()), T.StructField("error", T.StringType())]
)
EVAL_ITEM = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("id", "category", "question")]
    + [T.StructField("relevant_docs", T.ArrayType(T.StringType())), T.StructField("reference_answer", T.StringType())]
    + [T.StructField("answerable", T.BooleanType())]
)
