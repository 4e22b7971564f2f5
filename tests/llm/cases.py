"""Documents that every operator must take: nulls, empty, very long, repeated and clashing."""

from pyspark.sql import functions as F

TEXTS = [
    None,
    "",
    " \t\n",
    "one two three",
    "The quick brown fox jumps over the lazy dog near the river bank at dawn.",
    "The quick brown fox jumps over the lazy dog near the river bank at dawn.",
    "mail a.b@x.example.org or +1 (555) 123-4567, host 10.0.0.255, card 4111 1111 1111 1111.",
    "x" * 30_000,
    "la " * 20_000,
    "line of words here\n" * 40 + "end",
    "naïve café — 東京  \x00 ﬁ ½ 🙂 <s> <|endoftext|>",
]


def documents(spark, texts=TEXTS):
    """`documents` with extra columns named like the operators' own."""
    rows = [(None if i == 3 else i, t, "en" if i % 2 else None, None if i % 5 == 4 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += rows[-3:-1]  # repeated rows
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumn("id", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("kept", F.lit("?")).withColumn("size", F.lit(2.5)).withColumn("term", F.lit("t"))


def nothing(spark):
    """An empty table of the same form."""
    return documents(spark).limit(0)
