"""Vector search by cosine similarity, and text to hashed vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tablelens.functions.semantics import col
from tablelens.operators.textsearch import words

EMBEDDING_SIZE = 384


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    size = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(size > 0, _dot(a, b) / size).otherwise(F.lit(0.0))


def vector_topk(
    df: DataFrame, vector: str, target: list[float], k: int = 5, tie_break: str | None = None, equal: dict | None = None
) -> DataFrame:
    """The k rows most similar to one vector, after equality filters.

    The order and limit become one top-k per task: no shuffle of the vectors.
    """
    for name, value in (equal or {}).items():
        df = df.filter(col(name) == F.lit(value))
    asked = F.array(*[F.lit(float(x)) for x in target])
    length = sum(x * x for x in target) ** 0.5
    own = F.sqrt(_dot(col(vector), col(vector)))
    score = F.when((own > 0) & F.lit(length > 0), _dot(col(vector), asked) / (own * F.lit(length))).otherwise(F.lit(0.0))
    order = [F.col("score").desc()] + ([col(tie_break)] if tie_break else [])
    return df.withColumn("score", score).orderBy(*order).limit(k)


def vector_topk_batch(
    df: DataFrame, vector: str, key: str, queries: DataFrame, query_vector: str, query_key: str, k: int = 5, block: int = 512
) -> DataFrame:
    """(query, key, score, rank): the k rows most similar to every query vector.

    The queries are a stated set, taken in blocks of about ``block`` vectors; a block is one scan, in
    which every Arrow batch keeps its own k best per query before anything is shuffled.  Scores are
    rounded to 12 digits, ties go to the smaller key.  Null vectors and vectors of another length
    than a query's are skipped; vectors without length score 0.
    """
    asked = queries.select(col(query_key).alias("query"), col(query_vector).alias("target")).filter("query IS NOT NULL AND target IS NOT NULL")
    blocks = max(1, -(-asked.count() // block))
    rows = df.select(col(key).alias("key"), col(vector).cast("array<double>").alias("vector")).filter("key IS NOT NULL AND vector IS NOT NULL")
    query_type, key_type = asked.schema["query"].dataType, rows.schema["key"].dataType
    schema = f"query {query_type.simpleString()}, key {key_type.simpleString()}, score double"

    def unit(x: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, length, out=np.zeros_like(x), where=length > 0)

    def search(number: int) -> DataFrame:
        mine = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number).collect()  # about `block` vectors
        by_length: dict[int, tuple[list, np.ndarray]] = {}
        for n in {len(r["target"]) for r in mine}:
            same = [r for r in mine if len(r["target"]) == n]
            by_length[n] = [r["query"] for r in same], unit(np.array([r["target"] for r in same], float).reshape(len(same), n))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = batch.column(1).to_pylist()
                out: tuple[list, list, list] = ([], [], [])
                for n, (names, targets) in by_length.items():
                    at = np.flatnonzero([len(v) == n for v in vectors])
                    if not len(at):
                        continue
                    keys = np.array(batch.column(0).take(pa.array(at)).to_pylist(), dtype=object)
                    by_key = np.argsort(keys, kind="stable")
                    scores = np.round(unit(np.array([vectors[i] for i in at[by_key]], float).reshape(len(at), n)) @ targets.T, 12)
                    top = np.argsort(-scores, axis=0, kind="stable")[:k]
                    for j, name in enumerate(names):
                        out[0].extend([name] * len(top))
                        out[1].extend(keys[by_key][top[:, j]])
                        out[2].extend(scores[top[:, j], j])
                types = (to_arrow_type(query_type), to_arrow_type(key_type), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["query", "key", "score"])

        return rows.mapInArrow(best, schema)

    found = reduce(DataFrame.unionByName, [search(n) for n in range(blocks)])
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def text_embed(df: DataFrame, text: str, name: str = "embedding", size: int = EMBEDDING_SIZE) -> DataFrame:
    """Hashed word counts scaled to unit length, as an array<float> of fixed size."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    tokens = df.withColumn("__words", words(col(text)))
    counted = HashingTF(numFeatures=size, inputCol="__words", outputCol="__tf").transform(tokens)
    unit = Normalizer(p=2.0, inputCol="__tf", outputCol="__unit").transform(counted)
    return unit.withColumn(name, vector_to_array("__unit", "float32")).drop("__words", "__tf", "__unit")


def nearest_per_label(df: DataFrame, vector: str, label: str, target: list[float], k: int, tie_break: str) -> DataFrame:
    """The k most similar rows of every label; the rank limit is applied before the shuffle."""
    asked = F.array(*[F.lit(float(x)) for x in target])
    order = Window.partitionBy(label).orderBy(F.col("score").desc(), col(tie_break))
    scored = df.withColumn("score", cosine(col(vector), asked))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
