"""Centroid clustering (operator 13): Lloyd's rounds in whole numbers, with bounds that rest on the centroids' history (ns-bounds).

For every vector and centroid the table keeps the round in which their distance was last computed and that distance. Later on the
centroid may have moved, so the bound is loosened by the norm of its *total* displacement since that round, which the history of
centroids gives, and not by the sum of its moves. A vector whose own upper bound stays below all lower bounds keeps its centroid
without one distance; for the others only those distances are computed whose bounds fail.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.llm.shared import dropped, stored

#: Components are whole numbers of this unit, at most ``MOST`` from zero: squared distances of 64 of them stay below 2**63.
UNIT, MOST = 1024, 1 << 27
#: Bounds are floating-point roots of whole numbers; so much of them is given away on the safe side.
SLACK = 1e-9


def whole_vectors(vectors: DataFrame, dimension: int = 64, unit: int = UNIT, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the vectors with ``dimension`` components, none null, NaN or infinite; a component is floor(unit * component).

    A component beyond ``MOST`` stops the job with a message, since its squared distances would not fit 64 bits."""
    x = F.col(embedding)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), x.cast("array<double>").alias("v")).where((F.size(x) == dimension) & F.coalesce(whole, F.lit(False)))
    far = F.raise_error(F.concat(F.lit(f"component beyond {MOST} in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))).cast("long")
    return rows.select("vec_id", F.transform("v", lambda v: F.when(F.abs(v * unit) > MOST, far).otherwise(F.floor(v * unit))).alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes; ties by the vector, null ids last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select("x", name.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in found], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid, in whole numbers."""
    away = x - c
    return np.einsum("ij,ij->i", away, away)


def assigned(x: np.ndarray, own: np.ndarray, known: np.ndarray, at: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round for a block of vectors: the nearest of the newest centroids (ties: the smaller number).

    ``own`` is the centroid so far, ``known`` the squared distances last computed (n x k), ``at`` the rounds they were computed in;
    ``history`` has the centroids of all rounds (rounds x k x dimension). Returns all three brought up to date."""
    now = len(history) - 1
    moved = np.sqrt(((history[now][None] - history).astype(float) ** 2).sum(axis=2))  # norm of the displacement since each round
    n, k = known.shape
    rows, each = np.arange(n), np.arange(k)
    root, drift = np.sqrt(known.astype(float)), moved[at, each[None]]
    low = (root - drift) * (1 - SLACK) - SLACK * drift - SLACK
    high = (root[rows, own] + drift[rows, own]) * (1 + SLACK) + SLACK
    low[rows, own] = np.inf
    own, known, at = own.copy(), known.copy(), at.copy()
    unsure = np.flatnonzero(low.min(axis=1) <= high) if k > 1 else np.zeros(0, np.int64)

    def compute(which: np.ndarray, j: int) -> None:
        if len(which):
            known[which, j] = squared(x[which], history[now, j])
            at[which, j] = now

    for j in range(k):  # the bound of the own centroid is made exact first
        compute(unsure[(own[unsure] == j) & (at[unsure, j] != now)], j)
    best, nearest = known[unsure, own[unsure]], own[unsure]
    for j in range(k):  # then each other one whose bound does not rule it out
        near = (own[unsure] != j) & (low[unsure, j] <= np.sqrt(best.astype(float)) * (1 + SLACK) + SLACK)
        compute(unsure[near & (at[unsure, j] != now)], j)
        better = near & ((known[unsure, j] < best) | ((known[unsure, j] == best) & (j < nearest)))
        best, nearest = np.where(better, known[unsure, j], best), np.where(better, j, nearest)
    own[unsure] = nearest
    return own, known, at


def assignment(state: DataFrame, history: np.ndarray, last: bool) -> DataFrame:
    """``state`` (``vec_id, x, own, known, at``) after the round of the newest centroids. In the ``last`` one the distance to the own
    centroid is computed where it is not known, and stands as ``distance`` in place of the bounds."""
    dimension, k = history.shape[2], history.shape[1]
    centroids = state.sparkSession.sparkContext.broadcast(history)  # rounds x k x dimension numbers
    kind = state.schema["vec_id"].dataType.simpleString()
    tail = "distance long" if last else "known array<long>, at array<int>"

    def numbers(column: pa.Array, width: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)

    def lists(values: np.ndarray, t: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel(), t))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = centroids.value
        for batch in batches:
            x = numbers(batch.column(1), dimension)
            if "own" in batch.schema.names:
                own, known, at = batch.column(2).to_numpy().astype(np.int64), numbers(batch.column(3), k), numbers(batch.column(4), k)
            else:  # the first round computes every distance
                known = np.stack([squared(x, c) for c in past[0]], axis=1)
                own, at = known.argmin(axis=1), np.zeros((len(x), k), np.int64)
            own, known, at = assigned(x, own, known, at, past)
            columns = [batch.column(0), batch.column(1), pa.array(own, pa.int32())]
            if last:
                exact = known[np.arange(len(x)), own]
                for j in range(k):
                    old = np.flatnonzero((own == j) & (at[:, j] != len(past) - 1))
                    exact[old] = squared(x[old], past[-1, j])
                columns.append(pa.array(exact, pa.int64()))
            else:
                columns += [lists(known, pa.int64()), lists(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "own", *(["distance"] if last else ["known", "at"])])

    return state.mapInArrow(step, f"vec_id {kind}, x array<long>, own int, {tail}")


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dimension: int = 64, unit: int = UNIT, vec_id: str = "vec_id",
             embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, x, own, distance`` of every kept vector, stored, and the final centroids (k x dimension whole numbers).

    A round is one pass over the stored vectors and their bounds, and one aggregation to k rows of sums; a centroid's new place is the
    exact floor of the mean. The driver holds the centroids of all rounds and nothing else. A round's table goes once the next
    one is written, so two lie on disk at a time.

    Vectors with another number of components, or with a null, NaN or infinite one, are left out. A null id stays null and is a seed only
    when fewer than ``k`` rows have ids; repeated rows count each; an empty table gives no rows and no centroids; with fewer than
    ``k`` vectors there are as many centroids; further columns are left out whatever their names."""
    state = stored(whole_vectors(vectors, dimension, unit, vec_id, embedding), "vectors")
    start = first_centroids(state, k, seed)
    if not len(start):
        return state.select("vec_id", "x", F.lit(0).alias("own"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dimension), np.int64)
    history = start[None]
    for _ in range(rounds):
        following = stored(assignment(state, history, last=False), "centroid-round")
        dropped(state)
        state, centroids = following, history[-1].copy()
        sums = state.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(dimension)]).alias("s"))
        for r in sums.collect():  # one row per centroid
            centroids[r["own"]] = [s // r["n"] for s in r["s"]]
        history = np.concatenate([history, centroids[None]])
    found = stored(assignment(state, history, last=True), "clusters")
    dropped(state)
    return found, history[-1]


def cluster_report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of the rows and centroids that ``clusters`` gives."""
    spark = found.sparkSession
    sums = {r["own"]: r["s"] for r in found.groupBy("own").agg(F.sum("distance").alias("s")).collect()}  # one row per centroid
    names = [(j, sums.get(j, 0), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    about = spark.createDataFrame(names, "own int, cluster_inertia long, centroid_sha256 string")
    return (found.join(F.broadcast(about), "own")  # k rows
            .select("vec_id", F.col("own").alias("cluster"), "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256"))
