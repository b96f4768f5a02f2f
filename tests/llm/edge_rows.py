"""Small document tables with the awkward cases, and brute-force helpers."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
# Names that operators use inside; as extra columns they must pass through or be ignored.
CLASHING = ("node", "ids", "row_key", "features", "score", "copies", "rate", "kept_id", "bucket", "words")

_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    return " ".join(w + ("\n" if i % 17 == 16 else "") for i, w in enumerate(out))


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(w + "x" if rng.random() < share else w for w in text.split(" "))


def rows() -> list[tuple]:
    """Copies, near copies, ties, NULLs, empties, a very long text, repeated rows, odd characters."""
    base, other = prose(1, 120), prose(2, 90)
    texts = [(i, prose(10 + i, 5 + 7 * i)) for i in range(12)]
    texts += [(20, base), (21, base), (22, edited(base, 3, 0.01)), (23, edited(base, 4, 0.03)), (24, edited(base, 5, 0.4))]
    texts += [(30, other), (31, other + "\nAll rights reserved."), (32, "Header line one.\n" + other)]
    texts += [(40, ""), (41, None), (42, " \n\t "), (43, "one two"), (44, "one two"), (45, "a b c d e")]
    texts += [(50, prose(50, 6000)), (51, "z" * 5000), (52, "aa " * 400), (53, "Ünïcödé ß 漢字 🙂 " * 6), (54, "İK MIT License")]
    texts += [(60, base.upper()), (60, base.upper()), (61, prose(61, 30)), (None, prose(62, 30)), (None, None)]
    out = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in texts]
    return [*out, (70, prose(70, 40), None, None, 0), (71, prose(70, 40), "en", None, 0)]


def table(spark, data=None, extra: bool = False):
    data = rows() if data is None else data
    df = spark.createDataFrame(data, SCHEMA)
    if extra:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit("x").alias(n) for n in CLASHING])
    return df


def empty(spark):
    return table(spark, [])


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def ascii_lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
