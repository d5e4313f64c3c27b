"""Sorted arrays in the shared folder, written by tasks and mapped into memory by others."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.llm import text as T
from stratamart.session import scratch_path


def local_path(folder: str) -> str:
    """The mounted path of the shared folder; arrays in another kind of store can't be mapped."""
    if folder.startswith("file:"):
        return "/" + folder[len("file:"):].lstrip("/")
    if "://" in folder:
        raise ValueError(f"arrays are memory-mapped: spark.checkpoint.dir has to be a mounted folder, not {folder}")
    return folder


def runs(ranked: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    if not len(ranked):
        return []
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])).tolist()
    return list(zip(starts, [*starts[1:], len(ranked)], strict=True))


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return (T.mix(words.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(shards)).astype(np.int64)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, where each first is, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    start = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, int)
    return ranked[start], order[start], [np.add.reduceat(v[order].astype(np.int64), start) if len(keys) else v.astype(np.int64) for v in values]


def packed(shards: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """The bytes of the columns' items of each shard."""
    order = np.argsort(shards, kind="stable")
    ranked = shards[order]
    for s, e in runs(ranked):
        yield int(ranked[s]), [c[order[s:e]].tobytes() for c in columns]


def store(folder: str, name: str, array: np.ndarray) -> None:
    """Written aside and renamed, so a task that runs again leaves the same whole file."""
    os.makedirs(folder, exist_ok=True)
    aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(aside, "wb") as out:
        np.save(out, array)
    os.replace(aside, f"{folder}/{name}.npy")


class Arrays:
    """The stored arrays of a folder, mapped when first needed; a missing one is empty."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.maps: dict[str, np.ndarray | None] = {}

    def array(self, name: str) -> np.ndarray | None:
        if name not in self.maps:
            path = f"{self.folder}/{name}.npy"
            self.maps[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.maps[name]

    def places(self, name: str, shard: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(shard, wanted items, their place in its array)`` for the items that the arrays have."""
        order = np.lexsort((wanted, shard))
        ranked = shard[order]
        for s, e in runs(ranked):
            have = self.array(f"{name}-{ranked[s]}")
            if have is not None and len(have):
                at = order[s:e]
                place = np.minimum(np.searchsorted(have, wanted[at]), len(have) - 1)
                hit = have[place] == wanted[at]
                yield int(ranked[s]), at[hit], place[hit]


class StoredIds:
    """A set of ids (``id bigint``), stored in shards of about ``per_shard``."""

    def __init__(self, ids: DataFrame, per_shard: int = 1_000_000) -> None:
        self.folder = local_path(scratch_path(ids.sparkSession, "ids"))
        self.shards = shards = max(1, -(-ids.count() // per_shard))
        folder = self.folder

        def keep(group: pd.DataFrame) -> pd.DataFrame:
            own = np.unique(group["id"].to_numpy(np.int64))
            store(folder, f"ids-{int(group['shard'].iloc[0])}", own)
            return pd.DataFrame({"n": [len(own)]})

        ids.select("id", F.expr(f"pmod(id, {shards})").alias("shard")).groupBy("shard").applyInPandas(keep, "n bigint").agg(F.sum("n")).collect()

    def has(self, arrays: Arrays, wanted: np.ndarray) -> np.ndarray:
        out = np.zeros(len(wanted), bool)
        for _, at, _ in arrays.places("ids", np.mod(wanted, self.shards), wanted):
            out[at] = True
        return out
