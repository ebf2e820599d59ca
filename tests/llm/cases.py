"""Documents with nulls, blanks, ties, repeated rows, clashing names and a very long text."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def rows(n=60, seed=1):
    rng, out = random.Random(seed), []
    base = words(rng, 80)
    for i in range(n):
        if i % 3 == 0:
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
        else:
            w = words(rng, rng.randint(1, 120))
        out.append((i, " ".join(w), "en", f"s{i % 4}" if i % 7 else None, None))
    out += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (1002, " \n\t ", "en", "s1", 0), (1003, "one two", "en", "s2", 0)]
    out += [(1004, "ONE\u000btwo", "en", "s2", 0), (1005, " ".join(words(rng, 30_000)), "en", "s0", 0)]
    out += [out[0], out[0], (None, out[3][1], "en", "s0", 1), (1006, "Éa été \u00a0 naïve <|endoftext|> it's x's. $$#", "fr", "s3", 1)]
    return out


def docs(spark, extra=False, data=None):
    df = spark.createDataFrame(rows() if data is None else data, DOCS).repartition(5)
    if extra:
        for name in ("_key", "_size", "_id", "_n", "key", "cls", "score"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df
