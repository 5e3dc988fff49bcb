"""What the classifiers share: words as numbers, and the bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class WordTable(dict):
    """word -> row of a table of small numbers, made on first sight; emptied when it gets large."""

    def __init__(self, make: Callable[[str], tuple[int, ...]], most: int = 400_000):
        super().__init__()
        self.make, self.most, self.new, self.table = make, most, [], None

    def __missing__(self, word):
        n = self[word] = len(self)
        self.new.append(self.make(word))
        return n

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self.table = None
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:  # only the rows of words not seen before are turned into numbers
            new = np.array(self.new, np.int64)
            self.table = new if self.table is None else np.concatenate((self.table, new))
            self.new = []
        return self.table[at] if self.table is not None else np.zeros((0, 1), np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learns, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows for which ``learns(doc_id)`` holds, the first by a hash of doc_id.

    Rows with a null id or a null label are left out; of several labels of one id the largest counts, of
    several texts of one id the least (a null text counts as empty), so the sample has ``most`` rows however often an id is repeated.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learns(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # ``most`` ids at most
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
