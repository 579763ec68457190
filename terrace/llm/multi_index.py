"""Approximate nearest neighbours by an inverted multi-index.

Nearness is the inner product, which is made a distance first: each half x of a vector gets
the component sqrt(M^2 - |x|^2), M the largest norm of that half over all vectors, and each half
of a query gets 0, so that the nearer of two vectors, by summed squared distance, is the one with
the larger inner product, whatever the norms. Queries are brought to the length of the vectors,
which changes no order of theirs.

The lifted halves are quantised separately by ``CENTROIDS`` centroids each, fitted on
a bounded sample; a pair of centroids is a cell, and every vector lies in one. A query
traverses the pairs in the order of summed distance with a heap until the cells hold
``VISITED`` of all vectors, and their entries are ranked by the exact inner product in double
precision.

Entries of one first centroid are cut into blocks of about ``BLOCK`` rows by a hash, so that
a cell with a third of all vectors is spread; queries come in blocks, too, and go to the
blocks that hold cells they visit. Only the counts of cells (``CENTROIDS`` squared) and the
sample reach the driver. The data here have no clusters, and so half of the entries have to be
visited for a recall above 0.9; clustered data need fewer.

Vectors that are NULL, zero, of another length than most, or have components that are NULL or
not finite take no part. Rows with the query's id are not its candidates. Ties go to the
smaller id. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import Batches, batch, put

CENTROIDS = 32
SAMPLE_ROWS = 20_000
ROUNDS = 12
VISITED = 0.6
BLOCK = 4096
QUERY_BLOCK = 8192
QUERIES_AT_ONCE = 256
NEAR_TIE = 1e-9


class Codebook(NamedTuple):
    """Centroids of both lifted halves, and the largest squared norm of each half."""

    first: np.ndarray
    second: np.ndarray
    largest: tuple[float, float]

    def halves(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of vectors, lifted so that all have the length of the longest."""
        return lifted(m, self.largest)

    def query_halves(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of queries, scaled to the length of the vectors and not lifted."""
        norms = np.sqrt((m**2).sum(1))[:, None]
        m = m * (np.sqrt(sum(self.largest)) / np.where(norms > 0, norms, 1.0))
        half, flat = m.shape[1] // 2, np.zeros((len(m), 1))
        return np.hstack([m[:, :half], flat]), np.hstack([m[:, half:], flat])


def lifted(m: np.ndarray, largest: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    half = m.shape[1] // 2
    rest = [
        np.sqrt(np.maximum(most - (x**2).sum(1), 0.0))[:, None]
        for x, most in zip((m[:, :half], m[:, half:]), largest)
    ]
    return np.hstack([m[:, :half], rest[0]]), np.hstack([m[:, half:], rest[1]])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = rows.filter(
        F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & finite
        & F.exists("vector", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vector").alias("n")).count()
    width = sizes.orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("vector") == (width[0]["n"] if width else 0))


def _kmeans(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds from k distinct points that are far apart."""
    points = np.unique(points, axis=0)
    chosen = [0]
    far = np.full(len(points), np.inf)
    while len(chosen) < min(k, len(points)):
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(far.argmax()))
    centres = points[chosen].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = points[own == c].mean(0)
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :]


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(points, centres).argmin(1)


def fit(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Codebook:
    """Centroids of both halves from about ``sample_rows`` rows, chosen by a hash of the id.

    The largest norms are those of all vectors.
    """
    half = F.floor(F.size("vector") / 2).cast("int")
    squares = lambda x: F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c)
    sizes = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(squares(F.slice("vector", F.lit(1), half))).alias("first"),
        F.max(squares(F.slice("vector", half + 1, F.size("vector") - half))).alias("second"),
    ).collect()[0]
    share = min(1.0, sample_rows / max(1, sizes["n"]))
    wanted = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < round(share * (1 << 20))
    sample = np.array([r["vector"] for r in vectors.filter(wanted).select("vector").collect()])
    if not len(sample):  # so few rows that the hash chose none
        sample = np.array([r["vector"] for r in vectors.limit(CENTROIDS).collect()])
    if not len(sample):
        return Codebook(np.zeros((1, 0)), np.zeros((1, 0)), (0.0, 0.0))
    largest = (float(sizes["first"]), float(sizes["second"]))
    first, second = (_kmeans(x, CENTROIDS, ROUNDS) for x in lifted(sample, largest))
    return Codebook(first, second, largest)


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(rows, -1)


def index(vectors: DataFrame, centres: Codebook) -> DataFrame:
    """Every vector with its number and cell: vec_id, row, a, b, vector. Written once."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Batches) -> Batches:
        book = held.value
        for b in batches:
            if b.num_rows:
                first, second = book.halves(matrix(b["vector"], b.num_rows))
                own = (nearest(first, book.first), nearest(second, book.second))
                a, c = (pa.array(x.astype(np.int32)) for x in own)
                yield batch(vec_id=b["vec_id"], row=b["row"], a=a, b=c, vector=b["vector"])

    numbered = vectors.select("vec_id", "vector", F.monotonically_increasing_id().alias("row"))
    schema = "vec_id bigint, row bigint, a int, b int, vector array<double>"
    return put(numbered.mapInArrow(run, schema))


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: float) -> np.ndarray:
    """The cells to visit, as a table of booleans: pairs by summed distance, nearest first.

    The multi-sequence walk: with both lists in order, the pair after (i, j) is (i + 1, j) or
    (i, j + 1); each enters the heap once its other neighbour has been visited.
    """
    order_a, order_b = first.argsort(kind="stable"), second.argsort(kind="stable")
    near, far = first[order_a], second[order_b]
    visited = np.zeros(sizes.shape, bool)
    done = np.zeros(sizes.shape, bool)  # by place in the two orders
    heap, held = [(near[0] + far[0], 0, 0)], 0
    while heap and held < wanted:
        _, i, j = heappop(heap)
        done[i, j] = visited[order_a[i], order_b[j]] = True
        held += sizes[order_a[i], order_b[j]]
        if i + 1 < len(near) and (j == 0 or done[i + 1, j - 1]):
            heappush(heap, (near[i + 1] + far[j], i + 1, j))
        if j + 1 < len(far) and (i == 0 or done[i - 1, j + 1]):
            heappush(heap, (near[i] + far[j + 1], i, j + 1))
    return visited


def search(
    indexed: DataFrame,
    queries: DataFrame,
    centres: Codebook,
    k: int = 20,
    visited: float = VISITED,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, row, vector).

    Each row of the queries is a query of its own, to which all rows but itself are candidates,
    also those that repeat its vec_id.
    """
    spark = indexed.sparkSession
    shape = (len(centres.first), len(centres.second))
    sizes = np.zeros(shape, np.int64)
    for r in indexed.groupBy("a", "b").count().collect():
        sizes[r["a"], r["b"]] = r["count"]
    blocks = np.maximum(1, -(-sizes.sum(1) // BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    held = spark.sparkContext.broadcast((centres, sizes, blocks))
    # Enough cells for k others besides the query itself.
    wanted = max(visited * float(sizes.sum()), min(k + 1, int(sizes.sum())))

    def send(batches: Batches) -> Batches:
        book, sizes, blocks = held.value
        for b in batches:
            if not b.num_rows:
                continue
            m = matrix(b["vector"], b.num_rows)
            first, second = book.query_halves(m)
            to_first, to_second = distances(first, book.first), distances(second, book.second)
            names = list(zip(b["row"].to_pylist(), b["vec_id"].to_pylist()))
            columns = ("asked", "query_id", "a", "block", "cells", "query")
            rows: dict[str, list] = {n: [] for n in columns}
            for i, name in enumerate(names):
                cells = traverse(to_first[i], to_second[i], sizes, wanted)
                for a in np.flatnonzero((cells & (sizes > 0)).any(1)).tolist():
                    for block in range(blocks[a]):
                        for key, x in zip(rows, (*name, a, block, cells[a].tobytes(), m[i].tobytes())):
                            rows[key].append(x)
                if len(rows["a"]) > 4096:
                    yield _sent(rows)
                    rows = {n: [] for n in rows}
            yield _sent(rows)

    def _sent(rows: dict[str, list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return batch(**{n: pa.array(rows[n], t) for n, t in zip(rows, kinds)})

    sent = queries.mapInArrow(
        send, "asked bigint, query_id bigint, a int, block int, cells binary, query binary"
    ).withColumn("part", F.pmod(F.xxhash64("asked"), F.lit(query_blocks)).cast("int"))
    counts = F.array(*[F.lit(int(n)) for n in blocks])
    own_block = F.pmod(F.xxhash64("row"), F.get(counts, F.col("a"))).cast("int")
    entries = indexed.withColumns(
        {
            "block": own_block,
            "part": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))),
        }
    )

    def rank(key, entries: pa.Table, sent: pa.Table) -> pa.Table:
        out = [*[np.zeros(0, np.int64)] * 3, np.zeros(0)]
        if entries.num_rows and sent.num_rows:
            m = matrix(entries["vector"], entries.num_rows)
            ids, cell, rows = (entries[c].to_numpy() for c in ("vec_id", "b", "row"))
            asked, names = sent["asked"].to_numpy(), sent["query_id"].to_numpy()
            cells = [np.frombuffer(x, bool) for x in sent["cells"].to_pylist()]
            query = [np.frombuffer(x) for x in sent["query"].to_pylist()]
            found = []
            for at in range(0, len(names), QUERIES_AT_ONCE):
                upto = slice(at, at + QUERIES_AT_ONCE)
                q = np.array(query[upto])
                scores = q @ m.T
                hidden = ~np.array(cells[upto])[:, cell] | (rows[None, :] == asked[upto, None])
                scores[hidden] = -np.inf
                for i, own in enumerate(scores):
                    least = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -np.inf
                    near = np.flatnonzero((own >= least - NEAR_TIE) & (own > -np.inf))
                    exact = (m[near] * q[i]).sum(1)  # the same sum for equal vectors
                    best = near[np.lexsort((ids[near], -exact))[:k]]
                    exact = (m[best] * q[i]).sum(1)
                    own = [np.full(len(best), x[at + i]) for x in (asked, names)]
                    found.append((*own, ids[best], exact))
            out = [np.concatenate(x) for x in zip(*found)]
        return pa.table(dict(zip(("asked", "query_id", "vec_id", "score"), out)))

    key = ["a", "block", "part"]
    near = (
        entries.groupBy(*key)
        .cogroup(sent.groupBy(*key))
        .applyInArrow(rank, "asked bigint, query_id bigint, vec_id bigint, score double")
    )
    place = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
