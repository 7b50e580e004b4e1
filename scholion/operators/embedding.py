"""Embeddings: a provider hook over Arrow batches, and a JVM-side default."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.functions.vectors import fit_dimensions, normalise

# Default batch size and stored vector width.
BATCH_SIZE, WIDTH = 32, 1536


class Provider(Protocol):
    """What an embedding model has to offer. load() runs once per task."""

    model_id: str
    dimensions: int

    def load(self) -> Callable[[list[str]], list[list[float]]]: ...


def cut(text: Column, max_chars: int | None = None) -> Column:
    """The text as a model takes it: whole, unless the model has a limit."""
    return text if max_chars is None else F.substring(text, 1, max_chars)


def embed(
    df: DataFrame,
    text_col: str,
    provider: Provider,
    batch_size: int = BATCH_SIZE,
    max_chars: int | None = None,
) -> DataFrame:
    """Add embedding and embedding_error; rows and their order are kept.

    A text the model fails on gets NULL and the error, the others of its batch are retried one
    by one and keep their vectors. Columns pass through as Arrow data; only the texts of one batch and
    what the model gives for them are Python objects.
    """
    whole = max_chars is None and text_col in df.columns
    cut_col = text_col if whole else "_embed_text"
    source = df if whole else df.withColumn(cut_col, cut(F.col(text_col), max_chars))
    schema = T.StructType(
        [f for f in df.schema.fields if f.name not in ("embedding", "embedding_error")]
        + [
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("embedding_error", T.StringType()),
        ]
    )
    names = schema.fieldNames()
    kind = pa.list_(pa.float32())

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = provider.load()

        def alone(text):
            try:
                return model([text])[0], None
            except Exception as error:  # noqa: BLE001 - the failure belongs to this text
                return None, str(error)

        def batch(texts):
            try:
                return [(v, None) for v in model(texts)]
            except Exception:  # noqa: BLE001 - find out which text it was
                return [alone(t) for t in texts]

        for frame in frames:
            texts = frame.column(cut_col)
            present = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            vectors, errors = [pa.array([], kind)], ["no text"] * len(texts)
            for start in range(0, len(present), batch_size):
                part = present[start : start + batch_size]
                out = batch([texts[int(i)].as_py() for i in part])
                vectors.append(pa.array([None if v is None else [float(x) for x in v] for v, _ in out], kind))
                for i, (_, error) in zip(part, out, strict=True):
                    errors[i] = error
            at = np.full(len(texts), -1)
            at[present] = np.arange(len(present))
            made = {
                "embedding": pa.concat_arrays(vectors).take(pa.array(at, mask=at < 0)),
                "embedding_error": pa.array(errors, pa.string()),
            }
            yield pa.RecordBatch.from_arrays([made[c] if c in made else frame.column(c) for c in names], names)

    return source.mapInArrow(run, schema)


def stamp(df: DataFrame, model_id: str, version: int = 1) -> DataFrame:
    """Record model, version and time on the rows that have a vector."""
    there = F.col("embedding").isNotNull()
    return df.withColumns(
        {
            "embedding_model_id": F.when(there, F.lit(model_id)),
            "embedding_version": F.when(there, F.lit(version)),
            "embedding_created_at": F.when(there, F.current_timestamp()),
        }
    )


def hashing_embed(
    df: DataFrame, text_col: str, dimensions: int = 256, width: int | None = None
) -> DataFrame:
    """Deterministic offline default: hashed word counts of unit length, all in the JVM.

    A text without words gets NULL, so no search can return it.
    """
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    from scholion.functions.text import lexemes

    words = df.withColumn("_w", lexemes(F.coalesce(F.col(text_col), F.lit("")), "simple"))
    counted = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dimensions).transform(words)
    vector = normalise(vector_to_array("_tf"))
    if width is not None:
        vector = F.when(vector.isNotNull(), fit_dimensions(vector, width))
    return counted.withColumn("embedding", vector.cast("array<float>")).drop("_w", "_tf")


HASHING_MODEL_ID = "hashed-words"


def stale_embeddings(chunks: DataFrame, model_id: str, version: int = 1) -> DataFrame:
    """Chunks without a vector or with one of another model or an older version."""
    return chunks.where(
        F.col("embedding").isNull()
        | ~F.col("embedding_model_id").eqNullSafe(F.lit(model_id))
        | (F.coalesce("embedding_version", F.lit(0)) < version)
    )
