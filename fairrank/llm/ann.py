"""Approximate nearest neighbours by collision counting with virtual rehashing.

Every unit vector is projected on ``PROJECTIONS`` lines (random orthogonal bases).  Per block of
vectors each line's projections are one sorted array.  Around a query's own projection each array
opens a window that widens in steps of ``WIDEN`` (the same arrays serve every radius: virtual
rehashing).  A vector that lies in at least ``COLLISIONS`` of the windows is verified: its cosine is
computed from the original vectors in double precision.  A query stops widening in a block once
``CANDIDATES`` times the root of the block's size can be verified.  As windows hold more than half
of an array, what lies outside of them is counted (misses = lines - collisions).

Vectors are dealt by hash to blocks of about ``BLOCK_ROWS``, in which the index is one task's
memory.  Queries are a table too: one copy goes to every block in the same shuffle and meets the
index as a stream, so that neither the driver nor a task holds all of them.  Of a query k rows
leave a block.  All vectors are indexed; there is no sample, and small tables are searched the
same way as large ones.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, neither as query nor as candidate; vectors of another length than the query's are no
candidates; rows equal in id and vector count once, and a query never finds rows of its own id;
ties go to the smaller id; equal vectors are always verified together; an empty table gives an
empty table.
"""

from __future__ import annotations

from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairrank.llm.common import pick, staged

PROJECTIONS = 128
COLLISIONS = 102
#: Half width of the first windows, as a multiple of a projection's standard deviation, and the
#: factor from one to the next.
FIRST_WINDOW, WIDEN = 1.4, 1.03
#: Vectors of a block to verify before a query may stop, as a multiple of the root of its size.
CANDIDATES = 2.0
BLOCK_ROWS = 8_192
SEED = 5


def lines(dim: int) -> np.ndarray:
    """Random orthogonal bases side by side, as columns."""
    r = np.random.default_rng(SEED + dim)
    bases = [np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    return np.hstack(bases)[:, :PROJECTIONS]


class Block:
    """The sorted projection arrays of one block of vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        dim = vectors.shape[1]
        # scaled so that a random unit vector's projection has a standard deviation of 1
        self.scaled = lines(dim) * np.sqrt(dim)
        self.widest = 2.0 * np.sqrt(dim)
        p = (self.vectors / self.norms[:, None]) @ self.scaled
        rows = np.argsort(p, axis=0, kind="stable").T
        # one long sorted array: line j is shifted by j * gap, beyond any window of the line before
        self.gap = 4.0 * self.widest
        self.shift = self.gap * np.arange(PROJECTIONS)
        self.flat = (np.take_along_axis(p.T, rows, axis=1) + self.shift[:, None]).ravel()
        self.rows = np.ascontiguousarray(rows).ravel()
        self.first = len(ids) * np.arange(PROJECTIONS)
        self.need = min(len(ids), int(np.ceil(CANDIDATES * np.sqrt(len(ids)))))

    def _counts(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each vector stands in these pieces of the arrays."""
        found = np.concatenate([self.rows[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        return np.bincount(found, minlength=len(self.ids))

    def search(self, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, cosines) of the k best of the verified vectors for one query, and how many were verified."""
        norm = np.sqrt(q @ q)
        at = (q / norm) @ self.scaled + self.shift
        radius = FIRST_WINDOW
        low, high = np.searchsorted(self.flat, at - radius), np.searchsorted(self.flat, at + radius, side="right")
        misses = self._counts(self.first, low) + self._counts(high, self.first + len(self.ids))
        while True:
            cand = np.flatnonzero(misses <= PROJECTIONS - COLLISIONS)
            if len(cand) >= self.need or radius > self.widest:
                break
            radius *= WIDEN
            wide_low, wide_high = np.searchsorted(self.flat, at - radius), np.searchsorted(self.flat, at + radius, side="right")
            misses -= self._counts(np.concatenate((wide_low, high)), np.concatenate((low, wide_high)))
            low, high = wide_low, wide_high
        cand = cand[self.ids[cand] != qid]
        score = (self.vectors[cand] @ q) / (self.norms[cand] * norm)
        best = np.lexsort((self.ids[cand], -score))[:k]
        return self.ids[cand][best], score[best], len(cand)


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = pick(vectors, [id_col, vec_col]).toDF("vec_id", "v").withColumn("vec_id", F.col("vec_id").cast("bigint"))
    ok = ("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) "
          "and exists(v, x -> x != 0)")
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(ok).distinct()


def _unpack(batch: pa.RecordBatch):
    """(block, is query, id, vector) of every row."""
    vectors = batch.column(3)
    flat = vectors.flatten().to_numpy().astype(float)
    ends = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    for i, key in enumerate(zip(*[batch.column(j).to_pylist() for j in range(3)])):
        yield (*key, flat[ends[i]:ends[i + 1]])


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding",
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): the k nearest found of every vector whose id is
    divisible by ``every``, by cosine, among all others, and how many the query verified."""
    rows = staged(_usable(vectors, id_col, vec_col), "vectors")
    blocks = max(1, -(-rows.count() // block_rows))
    here = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("q"), "vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("q"), "vec_id", "v")
    # a block's vectors come before the queries that visit it
    stream = here.union(queries).repartition("block").sortWithinPartitions("block", "q", "vec_id")

    def search(batches):
        def found(block):
            index = {}
            for is_query, rows in groupby(block, key=lambda r: r[1]):
                if not is_query:
                    by = {}
                    for _, _, i, v in rows:
                        by.setdefault(len(v), []).append((i, v))
                    index = {d: Block(np.array([i for i, _ in m]), np.array([v for _, v in m])) for d, m in by.items()}
                else:
                    for _, _, i, v in rows:
                        if len(v) in index:
                            yield (i, *index[len(v)].search(i, v, k))

        for _, block in groupby(chain.from_iterable(map(_unpack, batches)), key=lambda r: r[0]):
            out = list(found(block))
            if out:
                yield pa.RecordBatch.from_arrays([
                    pa.array([o[0] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))],
                    ["query_id", "verified", "ids", "scores"])

    best = stream.mapInArrow(search, "query_id bigint, verified bigint, ids array<bigint>, scores array<double>")
    # k rows of each block at most
    pairs = F.flatten(F.collect_list(F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct(
        (-x["scores"]).alias("far"), x["ids"].alias("vec_id")))))
    out = best.groupBy("query_id").agg(F.sum("verified").alias("verified"), F.slice(F.array_sort(F.array_distinct(pairs)), 1, k).alias("best"))
    return out.select("query_id", "verified", F.posexplode("best").alias("p", "b")).select(
        "query_id", (F.col("p") + 1).alias("rank"), "b.vec_id", (-F.col("b.far")).alias("score"), "verified")
