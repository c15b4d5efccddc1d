"""Text -> dense vector encoders.

No language model ships with the build, so two deterministic encoders stand
in for one; both keep the output shape (``array<float>``), and any model can
take their place through ``model_encoder``.

* ``hashing_encoder``: character 3-grams -> MLlib ``HashingTF`` ->
  ``Normalizer`` (JVM-side, no Python worker).
* ``table_encoder``: picks the vector ``vec_id = length(text) mod n`` from
  a vector table, so SQL engines can reproduce it exactly.
* ``model_encoder``: an iterator ``pandas_udf`` that loads a model once per
  Python worker and encodes Arrow batches.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embedding_text(name: Column, description: Column) -> Column:
    """Text embedded per product: name + ':' + description (or empty)."""
    return F.concat(name, F.lit(":"), F.coalesce(description, F.lit("")))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Overlapping character n-grams of the lowercased text (whole text, no cap)."""
    t = F.lower(text)
    count = F.greatest(F.length(t) - n + 1, F.lit(0))
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(t, i, n))) \
            .otherwise(F.array().cast("array<string>"))


def hashing_encoder(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 256,
                    n: int = 3) -> DataFrame:
    """Hashed, L2-normalised character n-gram counts; empty text -> empty array."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    grams = df.withColumn("_grams", char_ngrams(F.col(text_col), n))
    tf = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=dim).transform(grams)
    normed = Normalizer(inputCol="_tf", outputCol="_vec", p=2.0).transform(tf)
    vec = vector_to_array("_vec", dtype="float32")
    empty = F.coalesce(F.length(F.col(text_col)), F.lit(0)) == 0
    return (normed.withColumn(out_col, F.when(empty, F.array().cast("array<float>")).otherwise(vec))
                  .drop("_grams", "_tf", "_vec"))


def table_encoder(df: DataFrame, text_col: str, vectors: DataFrame, n_vectors: Column,
                  out_col: str = "embedding") -> DataFrame:
    """Vector ``vec_id = length(text) mod n_vectors`` from ``vectors`` (vec_id, embedding).

    Empty text gets an empty vector. ``n_vectors`` is a scalar column (for
    example a row-count subquery).
    """
    vec = vectors.select(F.col("vec_id").alias("_vid"), F.col("embedding").alias("_vec"))
    keyed = df.withColumn("_vkey", F.length(F.col(text_col)) % n_vectors)
    out = keyed.join(vec, keyed["_vkey"] == vec["_vid"], "left")
    empty = F.coalesce(F.length(F.col(text_col)), F.lit(0)) == 0
    return (out.withColumn(out_col, F.when(empty, F.array().cast("array<float>")).otherwise(F.col("_vec")))
               .drop("_vkey", "_vid", "_vec"))


def model_encoder(load_model: Callable[[], Callable], dim_type: str = "array<float>"):
    """Wrap a model as an iterator pandas_udf: ``load_model()`` runs once per worker
    and returns ``encode(list[str]) -> list[list[float]]``."""
    import pandas as pd

    @F.pandas_udf(dim_type)
    def encode(batches):
        model = load_model()
        for texts in batches:
            vals = texts.fillna("").tolist()
            out = model([t for t in vals if t])
            it = iter(out)
            yield pd.Series([list(next(it)) if t else [] for t in vals])
    return encode
