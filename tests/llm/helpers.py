from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents from (doc_id, text[, source[, lang]])."""
    full = [
        (r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""))
        for r in rows
    ]
    return spark.createDataFrame(full, DOCS)


def clash(df, *names):
    """Input columns that carry the names of results."""
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df
