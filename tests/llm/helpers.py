"""Small inputs that every operator must bear."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     # names that operators might use inside
                     T.StructField("size", T.StringType()), T.StructField("copies", T.StringType()), T.StructField("score", T.StringType()), T.StructField("label", T.StringType())])


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]])"""
    full = [(*r, *(None,) * (4 - len(r)), "x", None, "y", "z") for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n "), (None, "a word or two here"), (4, "word " * 30_000), (5, "same text twice"), (5, "same text twice"), (6, "ÀÉ ñ\u3000ß 文字 \x1c end"), (7, "same text twice")]
