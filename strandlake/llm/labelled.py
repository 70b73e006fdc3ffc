"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def training_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int, most_chars: int, text: str = "text", doc_id: str = "doc_id") -> list[tuple[str, int]]:
    """Texts and labels of at most ``most`` labelled documents for which ``keep`` holds.

    The sample is the first ``most`` in order of a hash of the identifier; texts beyond
    ``most_chars`` are left out of it, so the driver's memory is bounded. Labels other
    than 0 and 1 and null identifiers are left out too; of a repeated identifier the largest label
    and the first text in text order count.
    """
    id_ = F.col(f"`{doc_id}`").cast("long")
    rows = labels.where(keep & F.col(label).isin(0, 1)).select(id_.alias("id"), F.col(label).cast("int").alias("label")).where("id is not null")
    chosen = rows.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    small = docs.where(F.length(f"`{text}`") <= most_chars).select(id_.alias("id"), F.col(f"`{text}`").alias("text"))
    # `most` rows bound the broadcast; one text an identifier, so that bounds the rows collected as well.
    found = small.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return [(r["text"], r["label"]) for r in sorted(found.collect(), key=lambda r: r["id"])]
