import os

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho "
         "sigma tau upsilon phi chi psi omega river stone cloud forest meadow harbour lantern").split()


def prose(rng, words):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(words))


@pytest.fixture(scope="session")
def documents(spark):
    """A function from (doc_id, text) or (doc_id, text, lang) rows to a documents table."""
    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if extra:  # names the operators use inside
            for name in ("row", "doc", "key", "h1", "node", "bucket", "lines", "root", "code", "rules"):
                df = df.withColumn(name, df["source"])
        return df
    return make


@pytest.fixture(scope="session")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    if not os.path.exists(path):
        pytest.skip("no vocabulary files")
    return path
