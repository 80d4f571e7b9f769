"""Small tables for the tests: real rows of the smallest size, and odd ones."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None)[:5] for r in rows], SCHEMA)


def documents(spark, data, n=120):
    return spark.read.parquet(f"{data}/documents.parquet").where(F.col("doc_id") < n)


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, a shared id."""
    long = " ".join(f"w{k % 7919}x{k}" for k in range(40_000))
    return frame(spark, [(9001, None), (9002, ""), (9003, " \n\t "), (9004, long), (9005, "same row"), (9005, "same row"), (9006, "one"), (9006, "another text of the same id"), (None, "no id at all"), (None, None)])


def clashing(docs):
    """With extra columns whose names the operators might use themselves."""
    return docs.withColumns({c: F.lit("x") for c in ("bucket", "payload", "added", "row_key", "score", "fp", "rep", "ids", "component", "count", "__group", "__GROUP_", "__score", "__key", "__added", "__near_id", "__near_text", "__near_gone", "node", "key", "label", "n", "q", "r")})


def mirror_words(n=1024):
    """Two words that hashes made of sums of powers, modulo a power of two, cannot tell apart."""
    first = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return first, first.translate(str.maketrans("ab", "ba"))
