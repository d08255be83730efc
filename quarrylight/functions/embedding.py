"""Embedding models: what a client is, batches of texts through it, and a check of what comes back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encode = Callable[[list[str]], "np.ndarray | list[list[float]]"]


@dataclass(frozen=True)
class Metadata:
    """What makes vectors comparable."""

    provider: str
    model: str
    version: str
    dimension: int
    metric: str = "cosine"

    def index(self, corpus_version: str) -> dict[str, object]:
        """The key fields of this model's rows in a vector store."""
        return {"corpus_version": corpus_version, **asdict(self)}


def sentence_model(name: str) -> Callable[[], Encode]:
    """A loader of a sentence-transformers model; loaded once in each worker. Needs that library."""

    def load() -> Encode:
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(name).encode

    return load


def embed(rows: DataFrame, text: str, load: Callable[[], Encode], about: Metadata, batch: int = 64) -> DataFrame:
    """rows with embedding: texts in batches of `batch` through a model that each worker loads once; a vector that has another size
    than the model states, or a value that is no number, fails."""
    kept = [f for f in rows.schema.fields if f.name != "embedding"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for frame in frames:
            texts, found = frame[text].fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                for vector in encode(texts[at : at + batch]):
                    v = np.asarray(vector, np.float64)
                    if v.shape != (about.dimension,) or not np.isfinite(v).all():
                        raise ValueError(f"embedding_dimension_mismatch:expected_{about.dimension}:actual_{v.size}")
                    found.append(v.tolist())
            yield frame[[f.name for f in kept]].assign(embedding=found)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*[F.col(f"`{f.name}`") for f in kept]).mapInPandas(run, f"{kinds}, embedding array<double>")
