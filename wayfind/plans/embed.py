"""Texts to vectors: an encoder plug-in, in batches, made once for each task."""

import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from wayfind.operators.ingest import harvest, update_embeddings

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 400  # fixed value: texts that an encoder gets at once


@dataclass
class Hashed:
    """Offline default: words counted in ``size`` cells by their checksum, with a sign, and scaled to length one."""

    size: int = 384

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.size] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12).astype(np.float32)


@dataclass
class SentenceEncoder:
    """A model of the sentence-transformers library, where that is installed on executors."""

    model: str

    def __post_init__(self):
        from sentence_transformers import SentenceTransformer

        self.encoder = SentenceTransformer(self.model)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.encoder.encode(texts), np.float32)


def encoded(rows: DataFrame, make: Callable = Hashed, batch: int = BATCH) -> DataFrame:
    """rows with a column text, and embedding array<float> instead of any they have; of a null text null."""
    from pyspark.sql import types as T

    rows = rows.drop("embedding")
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for part in parts:
            for at in range(0, len(part), batch):
                p = part.iloc[at : at + batch]
                known = p["text"].notna()
                vectors = iter(encode(p["text"][known].tolist())) if known.any() else iter(())
                yield p.assign(embedding=[next(vectors) if k else None for k in known])

    return rows.mapInPandas(run, schema)


def embed_nodes(nodes: DataFrame, make: Callable = Hashed) -> DataFrame:
    """Nodes (node_id, original_id, text, embedding, ...) with the vectors of their texts: what has a text is encoded, and set
    on every node with its original_id, in the order of node_id."""
    new = encoded(harvest(nodes).filter("original_id is not null"), make)
    return update_embeddings(nodes, new.selectExpr("node_id as row_no", "original_id", "embedding"))
