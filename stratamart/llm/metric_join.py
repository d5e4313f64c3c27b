"""Near-duplicate embeddings: an exact range join in cells around pivots.

Vectors are scaled to length one; a cosine of ``least`` or more is a distance of at most
``r = sqrt(2 - 2 least)``. Pivots part the vectors of a label into cells, each vector at home in
the cell of its nearest pivot. By the triangle inequality a vector within ``r`` of one at home in
cell ``i`` is at most ``2 r`` farther from pivot ``i`` than from its own; in unit vectors the
stronger bound on the distance to the border of both cells holds too. Vectors within the bound are
copied to cell ``i``, and every cell is joined on its own, in blocks of bounded size: its home
vectors against all that are in it, so each ordered pair is met exactly once.

Equal vectors of a label are joined as one with a count. Cells return a number of links and one
local component per vector, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.llm.components import components
from stratamart.session import stable

LEAST = 0.93
BLOCK = 2048
PIVOTS_PER_LABEL, PIVOTED_LABELS = 64, 1024
_SLACK = 1e-9


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(vec_id, label, unit)``: unit is the bytes of the scaled vector, null if it cannot link."""
    for batch in batches:
        ids, vectors, labels = batch.columns
        out = []
        for vector in vectors:
            values = vector.values
            if values is None or not len(values) or values.null_count:
                out.append(None)
                continue
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(x).max()
            if not np.isfinite(top) or top == 0:
                out.append(None)
                continue
            x = x / top  # keeps the squares finite and above zero
            out.append((x / np.sqrt((x * x).sum()) + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(out, pa.binary())], ["vec_id", "label", "unit"])


def _cells(pivots: dict[tuple[int, int], np.ndarray], radius: float):
    """A function that deals vectors to cells: ``home`` rows once, the others as visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, units = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows, cells, homes = [], [], []
            groups: dict[tuple[int, int], list[int]] = {}
            for k, key in enumerate(zip(labels, map(len, units), strict=True)):
                groups.setdefault(key, []).append(k)
            for key, members in groups.items():
                own = pivots.get(key)
                at = np.array(members)
                if own is None:
                    home, row, cell = np.zeros(len(at), int), np.arange(len(at)), np.zeros(len(at), int)
                else:
                    x = np.frombuffer(b"".join(units[k] for k in members)).reshape(len(at), -1)
                    cosine = x @ own.T
                    home = cosine.argmax(1)
                    best = cosine[np.arange(len(at)), home]
                    apart = np.sqrt(np.maximum(((own[:, None] - own[None]) ** 2).sum(2), 0))[home]
                    far = np.sqrt(np.maximum(2 - 2 * cosine, 0))
                    near = (best[:, None] - cosine <= radius * apart + _SLACK) & (far <= far[np.arange(len(at)), home][:, None] + 2 * radius + _SLACK)
                    near[np.arange(len(at)), home] = True
                    row, cell = np.nonzero(near)
                rows.append(at[row])
                cells.append(cell)
                homes.append(home[row] == cell)
            take = pa.array(np.concatenate(rows) if rows else np.zeros(0, int))
            yield pa.RecordBatch.from_arrays(
                [*(c.take(take) for c in batch.columns), pa.array(np.concatenate(cells) if rows else [], pa.int32()), pa.array(np.concatenate(homes) if rows else [], pa.bool_())],
                [*batch.schema.names, "cell", "home"])

    return run


def _join_block(least: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        ask, all_ = group[group["asks"]], group[~group["asks"]]
        a, b = (np.frombuffer(b"".join(x["unit"])).reshape(len(x), -1) if len(x) else np.zeros((0, 1)) for x in (ask, all_))
        ids = [x["id"].to_numpy() for x in (ask, all_)]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        linked = a @ b.T >= least
        linked &= ids[0][:, None] != ids[1][None]
        links = linked @ all_["copies"].to_numpy(np.float64)
        # smallest id that each row and column reaches within the block
        left, right = ids[0].copy(), ids[1].copy()
        top = np.iinfo(np.int64).max
        rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        small = linked[np.ix_(rows, columns)]
        x, y = left[rows], right[columns]
        while len(rows):
            nx = np.minimum(x, np.where(small, y[None], top).min(1))
            ny = np.minimum(y, np.where(small, nx[:, None], top).min(0))
            if (nx == x).all() and (ny == y).all():
                break
            x, y = nx, ny
        out = pd.DataFrame({"id": ids[0][rows], "links": links[rows].astype(np.int64), "root": x})
        other = pd.DataFrame({"id": ids[1][columns], "links": np.zeros(len(columns), np.int64), "root": y})
        return pd.concat([out, other[other["id"] != other["root"]]], ignore_index=True)

    return run


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``.

    Only vectors of one label and one length are compared. Null, zero and empty vectors, those with
    a null or non-finite component, a null label or a null ``vec_id`` link with nothing. Rows that
    repeat a ``vec_id`` are vectors of their own that share it. Other columns are not read.
    """
    radius = float(np.sqrt(2 - 2 * least))
    rows = stable(vectors.select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))
                  .mapInArrow(_unit, "vec_id bigint, label bigint, unit binary"))
    usable = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND unit IS NOT NULL")
    classes = stable(usable.groupBy("label", "unit").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    sizes = classes.groupBy("label", F.octet_length("unit").alias("bytes")).agg(F.count("*").alias("n")).where(f"n > {BLOCK}")
    large = [(r["label"], r["bytes"], r["n"]) for r in sizes.orderBy(F.desc("n"), "label", "bytes").limit(PIVOTED_LABELS).collect()]
    pivots: dict[tuple[int, int], np.ndarray] = {}
    if large:
        wanted = classes.sparkSession.createDataFrame([(label, size, min(PIVOTS_PER_LABEL, -(-n // BLOCK))) for label, size, n in large], "label bigint, bytes int, pivots int")
        share = classes.withColumn("bytes", F.octet_length("unit")).join(wanted, ["label", "bytes"])
        # the vectors of the smallest hashes: at most PIVOTED_LABELS * PIVOTS_PER_LABEL of them
        order = F.struct(F.xxhash64("id").alias("h"), "id", "unit")
        best = share.groupBy("label", "bytes", "pivots", F.pmod(F.xxhash64("id", F.lit(3)), F.col("pivots")).alias("k")).agg(F.min(order).alias("p"))
        for r in best.orderBy("label", "bytes", "k").collect():
            pivots.setdefault((r["label"], r["bytes"]), []).append(np.frombuffer(r["p"]["unit"]))
        pivots = {k: np.stack(v) for k, v in pivots.items()}
    dealt = stable(classes.select("id", "label", "unit", "copies").mapInArrow(
        _cells(pivots, radius), "id bigint, label bigint, unit binary, copies bigint, cell int, home boolean"))
    cell = ["label", "bytes", "cell"]
    dealt = dealt.withColumn("bytes", F.octet_length("unit"))
    counts = dealt.groupBy(*cell).agg(F.expr(f"int(ceil(count(*) / {BLOCK}))").alias("blocks"),
                                      F.expr(f"int(ceil(count_if(home) / {BLOCK}))").alias("asking")).where("asking > 0")
    placed = dealt.join(counts, cell)
    asks = placed.where("home").select("id", "unit", "copies", *cell, F.lit(True).alias("asks"),
                                       F.expr("int(pmod(xxhash64(id, 5), asking))").alias("q"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("b"))
    others = placed.select("id", "unit", "copies", *cell, F.lit(False).alias("asks"),
                           F.explode(F.expr("sequence(0, asking - 1)")).alias("q"), F.expr("int(pmod(xxhash64(id, 6), blocks))").alias("b"))
    found = stable(asks.union(others).groupBy(*cell, "q", "b").applyInPandas(_join_block(least), "id bigint, links bigint, root bigint"))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = classes.join(counted, "id", "left").join(comps, "id", "left").select(
        "label", "unit", F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.coalesce("component", "id")).toDF("label", "unit", "links", "component")
    able = F.col("r.vec_id").isNotNull() & F.col("c.links").isNotNull()
    return rows.alias("r").join(of_class.alias("c"), ["label", "unit"], "left").select(
        "r.vec_id", F.when(able, F.col("c.links")).otherwise(F.lit(0)).alias("n_links"),
        F.when(able, F.col("c.component")).otherwise(F.col("r.vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
