"""Small tables with everything that operators have to take."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward_texts(seed=1):
    """Nulls, empties, blanks, short and long texts, exact and near copies, shared passages, repeated words."""
    rng = random.Random(seed)
    base, shared = words(rng, 120), words(rng, 70)
    texts = [None, "", " \n\t", "one", "Two words", "a b c d", "A b\tC D e", "a b c d e", " ".join(base)]
    for k in (1, 2, 3, 12):  # near copies of the base, less and less alike
        near = list(base)
        for i in rng.sample(range(len(near)), k):
            near[i] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(base), " ".join(base).upper(), "same " * 300, " ".join(words(rng, 20_000))]
    for _ in range(6):
        texts.append(" ".join(words(rng, rng.randrange(60)) + shared + words(rng, rng.randrange(60))))
    texts += [" ".join(words(rng, rng.randrange(1, 200))) for _ in range(20)]
    texts += ["né à <|endoftext|> 漢字   emoji 😀 " * 3, "x" * 5000]
    return texts


def documents(spark, texts=None, extra=True, repeated=True):
    """Rows with a null id, repeated rows, an id with two texts, and columns that other code might use."""
    texts = awkward_texts() if texts is None else texts
    rows = [(i * 3, t, None if i % 4 == 0 else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    if repeated and rows:
        rows += [rows[8], rows[8], (3 * 20, texts[8], "en", "s", 1), (None, texts[8], "en", None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        for name in ("score", "kept", "spans", "block", "shard", "sequence_id", "component_id", "toxic_score", "text_key"):
            df = df.withColumn(name, F.lit("own"))
    return df


def empty(spark):
    return documents(spark, [], repeated=False)


def saved(df, folder, name="documents"):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
