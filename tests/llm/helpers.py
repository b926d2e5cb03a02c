"""Small tables with every awkward case, and plain-Python counterparts."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that operators use themselves
          "n long, r long, fp long, key string, shard int, word string, bucket string, runs string, tokens string, "
          "label int, score double, kept string, topic2 string")
EXTRA = (1, 2, 3, "k", 4, "w", "b", "runs", "t", 0, 0.5, "kept", "x")


def prose(rng: random.Random, words: int, vocabulary: int = 300) -> str:
    out = []
    for n in range(words):
        out.append(f"w{min(int(rng.paretovariate(0.8)), vocabulary)}{'é' if rng.random() < 0.05 else ''}")
        if n % 12 == 11:
            out.append("\n")
    return " ".join(out).replace(" \n ", "\n").replace(" \n", "\n")


def awkward_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    shared = prose(rng, 70)
    long_line = " ".join(f"p{k}" for k in range(60))
    texts: list[str | None] = [None, "", " \n ", "one", "one two", "One TWO", "é", None, ""]
    texts += [prose(rng, rng.randint(3, 150)) for _ in range(60)]
    texts += [shared] * 7
    texts += [shared.replace("w1", "w2", 1), shared + " tail", "head\n" + shared]
    texts += [f"{prose(rng, 20)}\n{long_line}\n{prose(rng, 20)}" for _ in range(5)]
    texts += [f"{long_line}\n{long_line}\n{long_line}"]
    texts += [prose(rng, 9000)]
    rows = [(k * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), None if t is None else len(t), *EXTRA)
            for k, t in enumerate(texts)]
    return rows


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    rows = awkward_rows() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd_documents(spark: SparkSession) -> DataFrame:
    """The awkward rows, with repeated rows and null ids."""
    rows = awkward_rows()
    return documents(spark, rows + rows[:3] + rows[20:22] + [(None, *rows[30][1:]), (None, None, *rows[30][2:])])


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
