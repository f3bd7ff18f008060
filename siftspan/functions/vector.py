"""Vector arithmetic as column expressions, in double precision, and the hashed embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from siftspan.functions.text import tokens

DIM = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is under 1e-10."""
    n, m = norm(a), norm(b)
    return F.when((n < 1e-10) | (m < 1e-10), 0.0).otherwise(dot(a, b) / (n * m))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def normalise(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-10))
    return F.transform(a, lambda x: x.cast("double") / n)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def similarity(metric: str, distance: Column) -> Column:
    """A score that grows with nearness from a distance: cosine 1 - d, dot -d, l2 1 / (1 + d)."""
    return {"cosine": 1.0 - distance, "dot": -distance, "l2": 1.0 / (1.0 + distance)}[metric]


def bucket(token: Column, dim: int = DIM) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dim


def sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(token), 9, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)


def hashed_weights(rows: DataFrame, key: list[str], text: str, dim: int = DIM) -> DataFrame:
    """(key..., bucket, w): signed counts of hashed tokens, scaled to unit length; all-zero vectors have no rows."""
    parts = rows.select(*key, F.explode(tokens(F.col(text))).alias("t"))
    counts = parts.groupBy(*key, bucket(F.col("t"), dim).alias("bucket")).agg(F.sum(sign(F.col("t"))).alias("c")).where(F.col("c") != 0)
    sums = counts.groupBy(*key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("_norm"))
    return counts.join(sums, key).select(*key, "bucket", (F.col("c") / F.col("_norm")).alias("w"))


def _hash_texts(texts, dim: int) -> np.ndarray:
    """The hashed vectors of texts, one a row, each distinct token digested once."""
    places: dict[str, tuple[int, float]] = {}
    out = np.zeros((len(texts), dim))
    for v, text in zip(out, texts, strict=True):
        for t in _TOKEN((text.as_py() or "").lower()):
            if t not in places:
                h = hashlib.md5(t.encode("utf-8")).hexdigest()
                places[t] = int(h[:8], 16) % dim, 1.0 if int(h[8], 16) < 8 else -1.0
            at, sign_ = places[t]
            v[at] += sign_
        v /= max(float(np.sqrt(v @ v)), 1e-10)
        if len(places) > 1 << 18:
            places.clear()
    return out


_TOKEN = regex.compile(r"[\p{L}\p{N}_]+").findall


def embed_all(texts: Column, dim: int = DIM) -> Column:
    """The hashed vectors of an array of texts, as array<array<double>>, in Arrow batches.

    This is the stand-in for an embedding model: lexical, not semantic. A model's own UDF takes its place.
    """

    @F.arrow_udf(ArrayType(ArrayType(DoubleType())))
    def run(batch: pa.Array) -> pa.Array:
        made = _hash_texts(batch.flatten(), dim)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, dim, dtype=np.int32)), pa.array(made.ravel()))
        ends = np.append(0, np.cumsum(np.asarray(batch.value_lengths().fill_null(0)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), vectors, mask=batch.is_null())

    return run(texts)


def embed(c: Column, dim: int = DIM) -> Column:
    """The hashed vector of one text."""
    return F.element_at(embed_all(F.array(c), dim), 1)


def hashed_vectors(rows: DataFrame, key: list[str], text: str, dim: int = DIM) -> DataFrame:
    """(key..., v array<double>): `hashed_weights` as dense vectors, made where the texts are read, without a shuffle."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)

    def run(batches):
        places: dict[str, tuple[int, float]] = {}
        for batch in batches:
            lists = batch.column(len(key))
            lengths = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            flat = lists.flatten().dictionary_encode()
            words = flat.dictionary.to_pylist()
            for t in words:
                if t not in places:
                    h = hashlib.md5(t.encode("utf-8")).hexdigest()
                    places[t] = int(h[:8], 16) % dim, 1.0 if int(h[8], 16) < 8 else -1.0
            at = np.array([places[t] for t in words]).reshape(-1, 2)
            of = np.asarray(flat.indices, np.int64)
            cell = np.repeat(np.arange(len(lengths)), lengths) * dim + at[of, 0].astype(np.int64)
            v = np.bincount(cell, at[of, 1], minlength=len(lengths) * dim).reshape(-1, dim)
            if len(places) > 1 << 18:
                places.clear()
            size = np.sqrt((v * v).sum(axis=1))
            some = np.flatnonzero(size > 0)
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(some) + 1) * dim, dim, dtype=np.int32)), pa.array((v[some] / size[some, None]).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(some)) for k in range(len(key))] + [made], names=[*key, "v"])

    return rows.select(*key, tokens(F.col(text)).alias("t")).mapInArrow(run, f"{kinds}, v array<double>")
