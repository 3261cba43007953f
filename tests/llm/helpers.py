"""Small tables with the odd cases that every operator must take."""
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h string, n_tokens string, shard string"


def rows_of(texts):
    """(doc_id, text) pairs as whole rows, with columns whose names clash with
    those that the operators make, some of them null."""
    return [(i, t, "en" if i and i % 2 else None, None, len(t) if t else None, "k", "h", "n", "s") for i, t in texts]


def table(spark, texts, parts=3):
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    return df.repartition(parts) if texts else df


def prose(rng, n, vocab=300):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def odd_texts(seed=1):
    rng = random.Random(seed)
    same = prose(rng, 80)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, same), (6, same), (6, same), (None, same), (7, "x" * 30_000),
        (8, prose(rng, 4000)), (9, "Is " * 500), (10, "ÀÉ îô 日本語 \U0001f600 é " * 20), (11, "\x00\x01 \x1c"), (12, same.upper()),
        (13, "line one two\n" * 40), (14, " 　"), (15, "<|endoftext|>a<|startoftext|>"),
    ]
