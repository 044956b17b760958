"""Embeddings of many texts by a model in each worker, with a stored cache by text hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.sources.store import Store

CACHE = "text_hash string, embedding array<float>"


def text_hash(column: str = "text"):
    return F.sha2(F.col(column), 256)


def embed_distinct(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], dimension: int, batch: int = 32) -> DataFrame:
    """text_hash, embedding of the distinct texts (a column text). ``load`` gives the model, once a task; it takes ``batch`` texts at a time.

    ValueError in the task where the model gives other than ``dimension`` finite numbers a text.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for part in parts:
            for at in range(0, len(part), batch):
                rows = part.iloc[at : at + batch]
                model = load() if model is None else model
                vectors = np.asarray(model(rows["text"].tolist()), np.float32)
                if vectors.shape != (len(rows), dimension) or not np.isfinite(vectors).all():
                    raise ValueError(f"the model must give {dimension} finite numbers a text")
                yield pd.DataFrame({"text_hash": rows["text_hash"].to_numpy(), "embedding": list(vectors)})

    once = texts.select(text_hash().alias("text_hash"), "text").where(F.col("text").isNotNull()).dropDuplicates(["text_hash"])
    return once.mapInPandas(run, CACHE)


def embed(rows: DataFrame, load: Callable, dimension: int, store: Store, name: str = "embedding_cache", column: str = "text", into: str = "embedding", batch: int = 32) -> DataFrame:
    """``rows`` with a vector for each text; null for a null text.

    Texts that the store's cache knows are not embedded again; each new distinct text is embedded once and appended, so a run that
    fails leaves the cache as it was, and the next one starts from what earlier ones finished.
    """
    texts = rows.select(F.col(column).alias("text"))
    known = store.read(name) if store.current(name) else rows.sparkSession.createDataFrame([], CACHE)
    missing = texts.join(known.select("text_hash"), text_hash("text") == F.col("text_hash"), "left_anti")
    store.append(name, embed_distinct(missing, load, dimension, batch))
    cache = store.read(name).select(F.col("text_hash").alias("_hash"), F.col("embedding").alias("_vector"))
    kept = [c for c in rows.columns if c != into]
    return rows.join(cache, text_hash(column) == F.col("_hash"), "left").select(*kept, F.col("_vector").alias(into))
