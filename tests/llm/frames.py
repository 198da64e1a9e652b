"""Small frames for the operators' edge cases."""

from pyspark.sql import types as T

WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "tu") for b in ("lo", "me", "sa") for c in ("n", "s", "t", "")]

#: Extra columns clash with names that the operators use.
EXTRA = {"kept": True, "spans": "x", "fp": 1, "row": 2, "grp": 3, "score": 0.5, "rank": 4}

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.BooleanType()),
        T.StructField("spans", T.StringType()), T.StructField("fp", T.LongType()), T.StructField("row", T.LongType()),
        T.StructField("grp", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType()),
    ]
)


def prose(n: int, seed: int) -> str:
    return " ".join(WORDS[(i * i * 7 + i * seed + seed) % len(WORDS)] for i in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows, marks beyond ASCII."""
    return [
        (1, prose(60, 1)),
        (2, prose(60, 1)),
        (3, " " + prose(60, 1)),
        (4, None),
        (5, ""),
        (6, " \t\n\x0b\x0c\r "),
        (7, prose(40_000, 3)),
        (8, "x" * 70_000),
        (9, "Éa ΣΑΣ 日本語 \U0001f600 don't a@b.co, +1 (234) 555-0199 4539 1488 0343 6467 1.2.3.4"),
        (10, prose(30, 5)),
        (10, prose(30, 5)),
        (None, prose(30, 6)),
        (None, prose(30, 7)),
        (None, None),
        (-5, prose(61, 1)),
        (2**62, "token = 'abcdef123' key Zx81kQp0vTt2mNb7Lw9R deadbeefdeadbeefdeadbeef"),
    ]


def frame(spark, rows=None, parts: int = 3):
    rows = edge_rows() if rows is None else rows
    made = [(i, t, None, None, None if t is None else len(t), *EXTRA.values()) for i, t in rows]
    return spark.createDataFrame(made, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)
