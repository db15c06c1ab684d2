"""The store of embeddings: models, vectors with the hash of what they were made of, and runs that make what is missing or stale."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators.quality import count_if, unpivot
from tessera.sources.files import lockfile, upsert

TYPES = ("clause", "annex", "table")


@dataclass(frozen=True)
class Model:
    """What a vector was made with."""

    model_id: str
    model_name: str
    embedding_dim: int = R.DIMENSIONS
    normalization: str = "l2"
    runtime_backend: str = "hashing"


#: The model that is used where none is named.
DEFAULT_MODEL = "hashing-384"


def model_of(model_id: str = DEFAULT_MODEL) -> Model:
    """The model of an id; an unknown id is a model of the same size and backend under its own name."""
    bare = model_id.strip()
    if not bare:
        raise ValueError("a model needs an id")
    return Model(bare, "hashing of words and word pairs" if bare == DEFAULT_MODEL else bare)


def register(spark: SparkSession, models: DataFrame | None, model: Model) -> DataFrame:
    """The models with this one in place of any of the same id."""
    row = spark.createDataFrame([tuple(asdict(model).values())], "model_id string, model_name string, embedding_dim int, normalization string, runtime_backend string")
    return row if models is None else upsert(models, row, ["model_id"])


def config_lock(model: Model, path: str) -> str:
    """Write the model's settings with a checksum over id, name, size, normalization and backend; gives the checksum."""
    values = [model.model_id, model.model_name, str(model.embedding_dim), model.normalization, model.runtime_backend]
    checksum = hashlib.sha256("|".join(values).encode()).hexdigest()
    lockfile(path, asdict(model) | {"config_checksum": checksum})
    return checksum


def chunk_types(named: Iterable[str] = ()) -> tuple[str, ...]:
    """The chunk types to embed: the named ones in lower case, or all; others than the three known are refused."""
    wanted = sorted({t.strip().lower() for t in named if t.strip()})
    unknown = set(wanted) - set(TYPES)
    if unknown:
        raise ValueError(f"no such chunk type: {sorted(unknown)}")
    return tuple(wanted) or TYPES


def payloads(chunks: DataFrame, types: Iterable[str] = TYPES) -> DataFrame:
    """(chunk_id, type, payload, payload_hash) of the chunks of the types; the last two are null where there is nothing to embed."""
    payload = R.payload(F.col("type"), F.col("ref"), F.col("heading"), F.col("text"), F.col("table_md"))
    return chunks.where(F.col("type").isin(*types)).select("chunk_id", "type", payload.alias("payload")).withColumn("payload_hash", F.sha2("payload", 256))


def vectors(rows: DataFrame) -> DataFrame:
    """(chunk_id, payload_hash, embedding) from (chunk_id, payload, payload_hash)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "payload_hash": b["payload_hash"], "embedding": list(R.embed_all(list(b["payload"])))})

    return rows.select("chunk_id", "payload", "payload_hash").mapInPandas(run, "chunk_id string, payload_hash string, embedding array<double>")


STORE = "chunk_id string, model_id string, embedding array<double>, embedding_dim int, payload_hash string"


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STORE)


def _joined(rows: DataFrame, store: DataFrame, model: Model) -> DataFrame:
    """The payloads with ``reason``: missing, changed (made of another text), resized, or null where the stored vector holds."""
    s = store.where(F.col("model_id") == model.model_id).select(F.col("chunk_id").alias("s_id"), F.col("payload_hash").alias("s_hash"), "embedding_dim")
    reason = F.when(F.col("s_id").isNull(), "missing").when(~F.col("payload_hash").eqNullSafe(F.col("s_hash")), "changed").when(F.col("embedding_dim") != model.embedding_dim, "resized")
    return rows.where("payload is not null").join(s, F.col("chunk_id") == F.col("s_id"), "left").select("chunk_id", "payload", "payload_hash", reason.alias("reason"))


def embed_run(chunks: DataFrame, store: DataFrame, model: Model, mode: str = "missing-or-stale", types: Iterable[str] = TYPES) -> DataFrame:
    """The store after a run: vectors that are missing or stale, or in mode ``full`` all, are made and take the place of those there were.
    Only their chunks are embedded; other vectors, those of other models and of chunks that are gone included, stay as they are."""
    if mode not in ("full", "missing-or-stale"):
        raise ValueError(f"no such mode: {mode}")
    rows = _joined(payloads(chunks, types), store, model)
    made = vectors(rows if mode == "full" else rows.where("reason is not null"))
    new = made.select("chunk_id", F.lit(model.model_id).alias("model_id"), "embedding", F.lit(model.embedding_dim).alias("embedding_dim"), "payload_hash")
    return upsert(store, new, ["chunk_id", "model_id"])


def stated(chunks: DataFrame, model: Model, types: Iterable[str] = TYPES) -> DataFrame:
    """What a run over the chunks leaves in an empty store, without the vectors: a row per chunk with something to embed."""
    rows = payloads(chunks, types).where("payload is not null")
    return rows.select("chunk_id", F.lit(model.model_id).alias("model_id"), F.lit(model.embedding_dim).alias("embedding_dim"), "payload_hash")


def run_report(chunks: DataFrame, before: DataFrame, after: DataFrame, model: Model, types: Iterable[str] = TYPES) -> DataFrame:
    """(measure, value) of a run: chunks, those with something to embed, those skipped as empty, stale vectors before and after, and how
    many were embedded."""
    rows = payloads(chunks, types)
    sizes = rows.agg(F.count("*").alias("chunks"), count_if(F.col("payload").isNotNull()).alias("eligible"), count_if(F.col("payload").isNull()).alias("skipped_empty"))
    stale = _joined(rows, before, model).agg(count_if(F.col("reason").isNotNull()).alias("stale_before"))
    left = _joined(rows, after, model).agg(count_if(F.col("reason").isNotNull()).alias("stale_after"))
    fresh = _joined(rows, after, model).agg((F.count("*") - count_if(F.col("reason").isNotNull())).alias("embedded"))
    return unpivot(sizes).unionByName(unpivot(stale)).unionByName(unpivot(left)).unionByName(unpivot(fresh))


def coverage(chunks: DataFrame, store: DataFrame, model: Model) -> DataFrame:
    """(measure, value): eligible chunks, those with a vector of the model, those whose vector is of another text, and both as shares."""
    rows = _joined(payloads(chunks), store, model)
    n = rows.agg(F.count("*").alias("eligible"), count_if(~F.coalesce(F.col("reason") == "missing", F.lit(False))).alias("embedded"), count_if(F.col("reason").isin("changed", "resized")).alias("stale"))
    return unpivot(n.withColumns({"coverage": F.when(F.col("eligible") > 0, F.col("embedded") / F.col("eligible")), "stale_ratio": F.when(F.col("embedded") > 0, F.col("stale") / F.col("embedded"))}))


def status(store: DataFrame | None, models: DataFrame | None, model: Model) -> tuple[bool, str]:
    """Whether semantic search can use a store, and why not: no store, a model that isn't registered or is of another size, or no vectors."""
    if store is None:
        return False, "no_store"
    if models is not None:
        known = models.where(F.col("model_id") == model.model_id).select("embedding_dim").first()
        if known is None:
            return False, "model_not_registered"
        if known["embedding_dim"] != model.embedding_dim:
            return False, "dimension_mismatch"
    if store.where(F.col("model_id") == model.model_id).isEmpty():
        return False, "no_embeddings"
    return True, "available"


def encode(vector: Iterable[float]) -> bytes:
    """A vector as little-endian 32-bit floats."""
    return np.asarray(list(vector), dtype="<f4").tobytes()


def decode(blob: bytes, dimensions: int) -> list[float] | None:
    """The vector of a blob; None if it isn't of that many numbers."""
    return None if len(blob) != 4 * dimensions else np.frombuffer(blob, dtype="<f4").astype(float).tolist()
