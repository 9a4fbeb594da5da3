"""Small tables with the awkward rows that every operator must take."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Names that operators use inside; as extra columns they must not clash.
CLASHING = ("row", "digest", "fp", "seat", "size", "rank", "target", "bucket", "score", "chunk", "data", "copies", "key", "place")
SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType())]
    + [StructField(c, StringType()) for c in CLASHING]
)
WORDS = "alpha beta gamma delta the of and to in été größe niño 日本 x1 you idiot".split()


def texts(seed: int = 3, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    prose = [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(n)]
    passage = " ".join(rng.choices(WORDS, k=40))
    out: list[str | None] = [None, "", " ", "\n\t \x0b", "a", "the the the", "same text", "same text", "same text"]
    out += prose + [prose[0], prose[1], prose[1] + " more", passage + " " + prose[2], prose[3] + " " + passage]
    out += [passage * 3, "word " * 30_000, "ab" * 20_000, prose[4].upper(), "\x00\x01\x7f" * 40, "🎉" * 300]
    return out


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i, t in enumerate(texts(seed, n)):
        out.append((i * 7 % 101, t, rng.choice(["en", None]), rng.choice(["s1", "s2", "s10", "é", "", None])) + ("extra",) * len(CLASHING))
    out.append(out[12])  # a whole row twice
    out.append((None, "no id here " * 20, None, None) + (None,) * len(CLASHING))
    out.append((None, "same text", None, "s1") + (None,) * len(CLASHING))
    return out


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
