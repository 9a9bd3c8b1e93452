import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns with names that the operators use themselves.
CLASH = ["kept", "size", "key", "hash", "label", "n_words", "score", "held", "runs", "component", "id", "n_tokens", "_hash", "band", "ids"]


@pytest.fixture(scope="session")
def spark(spark):
    from jobweave.session import use_local_folder
    return use_local_folder(spark)


def sentence(rng, n):
    words = ["alpha", "beta", "Gamma", "delta", "eps", "zeta's", "été", "straße", "theta", "1024", "x#y", "omega", "kappa,", "漢字", "mu.", "nu"]
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and long texts, copies, near copies, ties, repeated rows, odd white space."""
    rng = random.Random(3)
    base, passage = sentence(rng, 130), sentence(rng, 70)
    near = base.split(" ")
    near[60] = "changed"
    far = base.split(" ")[:70] + sentence(rng, 60).split(" ")
    texts = [base, base, " ".join(near), " ".join(far), "", None, " \n\t ", "one", "two words", "a b c d", "A B C D", "  x\x1cy",
             sentence(rng, 40) + "\n" + passage + "\n" + sentence(rng, 30), sentence(rng, 25) + " " + passage, "z" * 3000, "ab" * 900,
             "word " * 400, "line of words\n" * 30, sentence(rng, 6000), "🙂 " * 120, "<|endoftext|> a<|endoftext|>", sentence(rng, 200).upper(),
             "mail a.b+c@x-y.example.org, 1.2.3.4 and 999.1.1.1 or 10.20.30.40.50; 4111 1111 1111 1111 +1 (555) 123-4567 +12",
             "x@y.z_w@q.r @a.b 5.5.5.5.5.5.5.5 4111-1111-1111-1112 +49 30 1234567890123456 00255.1.1.1 255.255.255.256",
             "Released under the MIT License\n\nmit license mit license", "Licensed under the apache\nlicense, version 2.0", "general PUBLIC license license"]
    langs, sources = ["en", "de", None], ["s1", "s0", None, "é"]
    rows = [(i * 3, t, langs[i % 3], sources[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[12], rows[12]]                 # repeated rows
    rows += [(None, base, "en", "s1", 1), (None, None, None, None, None), (-5, sentence(rng, 80), "en", "s1", None)]
    rows += [(9, sentence(rng, 77), "de", "s0", 5)]       # an id with two texts
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i * 3, i % 2, 0) for i in range(20)] + [(None, 1, 0), (6, None, 1), (0, 0, 0)], "doc_id long, quality long, toxic long")
