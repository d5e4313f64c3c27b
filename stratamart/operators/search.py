"""Similarity search over stored vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamart.session import stable


def similarity(corpus: DataFrame, query: Sequence[float], id_col: str, vector: str) -> DataFrame:
    """``(id, similarity_score)``: cosine of every vector with the query; rows without a direction are left out.

    Vectors cross to numpy as Arrow buffers and are scored a batch at a time.
    """
    wanted = np.asarray(query, dtype=np.float64)
    length = np.linalg.norm(wanted)
    if not length:
        raise ValueError("the query vector is zero")
    unit = wanted / length

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(matrix) != len(vectors) * len(unit):
                raise ValueError(f"every vector needs {len(unit)} values")
            matrix = matrix.reshape(len(vectors), len(unit))
            norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
            known = norms > 0
            scores = matrix[known] @ unit / norms[known]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(known)), pa.array(scores)], [id_col, "similarity_score"])

    rows = corpus.select(id_col, vector).where(F.col(vector).isNotNull())
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(score, f"{id_col} {kind}, similarity_score double")


def semantic_topk(corpus: DataFrame, query: Sequence[float], id_col: str, vector: str, top_k: int = 5,
                  min_score: float = 0.25) -> DataFrame:
    """The ``top_k`` rows most similar to the ``query`` vector, at least ``min_score``.

    The corpus is scanned once without a join or shuffle; each task keeps only its best rows.
    Equal scores go by id.
    """
    scored = similarity(corpus, query, id_col, vector)
    return (
        scored.where(F.col("similarity_score") >= min_score)
        .orderBy(F.desc("similarity_score"), id_col).limit(top_k)
    )


def _units(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``(n, id, unit)``: a row number and the bytes of the vector scaled to length one; rows without a
    direction are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            lengths = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(lengths)
            squares = np.append(0.0, np.cumsum(values * values))
            if len(lengths) and (lengths == lengths[0]).all() and lengths[0]:
                matrix = values.reshape(len(lengths), -1)
                norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
            else:  # lengths differ; that is reported when all are known
                norms = np.sqrt(squares[ends] - squares[ends - lengths])
            able = norms > 0
            unit = values / np.repeat(np.where(able, norms, 1.0), lengths)
            out = pa.array([unit[e - n:e].tobytes() for e, n, ok in zip(ends.tolist(), lengths.tolist(), able.tolist(), strict=True) if ok], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(able)), out], ["id", "unit"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"id {kind}, unit binary")
    return rows.withColumn("n", F.monotonically_increasing_id())


def _best(top_k: int, min_score: float, chunk: int = 128):
    """The ``top_k`` rows of one block for every query of another, equal scores by id."""
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        empty = pd.DataFrame({"n": queries["n"][:0], "query_id": queries["id"][:0], "id": rows["id"][:0], "similarity_score": np.zeros(0)})
        if rows.empty or queries.empty:
            return empty
        rows = rows.sort_values("id", kind="stable", ignore_index=True)
        have, ask = (np.frombuffer(b"".join(x["unit"])).reshape(len(x), -1) for x in (rows, queries))
        keep = min(top_k, len(rows))
        for k in range(0, len(ask), chunk):
            # rounded, so that equal vectors score equally wherever they stand in a product
            scores = np.round(ask[k:k + chunk] @ have.T, 12)
            least = np.maximum(np.partition(scores, len(rows) - keep, axis=1)[:, len(rows) - keep], min_score)
            query, row = np.nonzero(scores >= least[:, None])
            score = scores[query, row]
            order = np.lexsort((row, -score, query))
            query, row, score = query[order], row[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            query, row, score = (x[place < keep] for x in (query, row, score))
            found.append(pd.DataFrame({"n": queries["n"].to_numpy()[k + query], "query_id": queries["id"].to_numpy()[k + query],
                                       "id": rows["id"].to_numpy()[row], "similarity_score": score}))
        return pd.concat(found, ignore_index=True)

    return run


def semantic_topk_batch(corpus: DataFrame, queries: DataFrame, id_col: str, vector: str, top_k: int = 5,
                        min_score: float = 0.25, query_block: int = 8192, corpus_block: int = 32768) -> DataFrame:
    """``(query_id, id, similarity_score)``: the ``top_k`` nearest rows of every query row.

    Both sides are read once, scaled and stored, and dealt to blocks of bounded size by a hash of
    their row number, whatever ids repeat. Each pair of blocks is joined in a task, as a product of
    two matrices, and gives ``top_k`` rows per query; the best of those are taken per query. No
    vector reaches the driver. Equal scores (to 12 digits) go by id; rows without a direction are
    left out. All vectors need the same length.
    """
    rows, wanted = stable(_units(corpus, id_col, vector)), stable(_units(queries, id_col, vector))
    sizes = [df.agg(F.count("*"), F.min(F.octet_length("unit")), F.max(F.octet_length("unit"))).first() for df in (rows, wanted)]
    if len({x for s in sizes for x in s[1:] if x is not None}) > 1:
        raise ValueError("all vectors need the same number of values")
    blocks, query_blocks = (max(1, -(-s[0] // size)) for s, size in zip(sizes, (corpus_block, query_block), strict=True))

    def dealt(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("n", F.lit(seed)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    have = rows.select("id", "unit", every(query_blocks).alias("q"), dealt(blocks, 1).alias("c"))
    ask = wanted.select("n", "id", "unit", dealt(query_blocks, 2).alias("q"), every(blocks).alias("c"))
    kinds = [df.schema[id_col].dataType.simpleString() for df in (queries, corpus)]
    found = have.groupBy("q", "c").cogroup(ask.groupBy("q", "c")).applyInPandas(
        _best(top_k, min_score), f"n bigint, query_id {kinds[0]}, id {kinds[1]}, similarity_score double")
    order = Window.partitionBy("n").orderBy(F.desc("similarity_score"), "id")
    return found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top_k).select(
        "query_id", F.col("id").alias(id_col), "similarity_score")
