"""Nearest neighbours by score-aware (anisotropic) quantisation with 4-bit table scans and exact reranking.

Smallest Euclidean distance is largest inner product once each vector carries its
squared norm: |q - x|^2 = |q|^2 - 2 (<q, x> - |x|^2 / 2).  Vectors are coded by a
product quantiser of 16 centroids a subspace, trained to weigh the residual that is
parallel to the vector more than the orthogonal one, since the parallel part moves
the largest products most.  A query's products with all centroids are a small
table; a scan adds table entries by code, and the best of each block are measured
exactly on the original vectors.  The k-th of these distances and the stored length
of each residual then tell which rows of the block can still be among the nearest;
all of them are measured too, so that the answer is exact within a block, and copies
or near copies that share a code are told apart.

Tables of over `LIST_ROWS` rows are dealt to lists by their nearest coarse centroid,
and a query visits the lists nearest to it: as many as hold `COVERED` of the true
neighbours of sampled vectors among the sample, the lists in order of distance.  The
whole set is denser than the sample, its neighbours nearer, so more of them are met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.session import cut

TRAIN_ROWS = 8_192  # the codebooks are fitted on at most about so many vectors, chosen by a hash; every vector is coded
CENTROIDS = 16
SUBSPACE = 2
PARALLEL = 4.0  # how much more a parallel residual costs
QUERIES_A_PASS = 8_192
BLOCK = 4_096
RERANK = 12  # first measurements for each neighbour wanted, in each block
PAIRS = 1 << 17  # measured at once
LIST_ROWS, MOST_LISTS = 16_384, 1_024
COVERED = 0.98  # share of sampled neighbours in the lists that a query visits
PASSES_A_TABLE = 16
STRANDS = 64  # a query's finds are merged in so many parts first


@dataclass(frozen=True)
class Lists:
    """Coarse centroids, and how many of them a query visits."""

    centroids: np.ndarray
    visits: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, but for each row's own square."""
        return (self.centroids**2).sum(axis=1) - 2 * (x @ self.centroids.T)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self.order(x).argmin(axis=1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        if self.visits >= len(self.centroids):
            return np.repeat(np.arange(len(self.centroids))[None], len(x), axis=0)
        return np.argpartition(self.order(x), self.visits - 1, axis=1)[:, : self.visits]


def coarse(sample: np.ndarray, rows: int, k: int, rounds: int = 10) -> Lists:
    """Lists for a table of `rows` rows, by k-means on the sample; the visits are measured on the sample."""
    n = int(np.clip(rows // LIST_ROWS, 1, min(MOST_LISTS, max(1, len(sample) // 8))))
    rng = np.random.default_rng(23)
    lists = Lists(sample[rng.permutation(len(sample))[:n]].copy(), n)
    if n == 1:
        return lists
    for _ in range(rounds):
        own = lists.nearest(sample)
        for c in np.unique(own):
            lists.centroids[c] = sample[own == c].mean(axis=0)
    own = lists.nearest(sample)
    asked = rng.permutation(len(sample))[:512]
    apart = (sample**2).sum(axis=1) - 2 * (sample[asked] @ sample.T)
    apart[np.arange(len(asked)), asked] = np.inf
    near = np.argpartition(apart, min(k, len(sample) - 1) - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(lists.order(sample[asked]), axis=1), axis=1)
    places = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return Lists(lists.centroids, int(places[int(np.ceil(COVERED * len(places))) - 1]) + 1)


@dataclass(frozen=True)
class Codebooks:
    centroids: np.ndarray  # subspace, centroid, dimension within the subspace
    dims: int

    def split(self, x: np.ndarray) -> np.ndarray:
        m, _, d = self.centroids.shape
        padded = np.zeros((len(x), m * d))
        padded[:, : self.dims] = x
        return padded.reshape(len(x), m, d)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.centroids[j][codes[:, j]] for j in range(len(self.centroids))], axis=1)[:, : self.dims]

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """A centroid for each vector and subspace, by coordinate descent on the score-aware loss."""
        parts = self.split(x)
        codes = np.stack([((parts[:, j, None] - self.centroids[j]) ** 2).sum(axis=2).argmin(axis=1) for j in range(parts.shape[1])], axis=1)
        return improve(parts, self.centroids, codes, sweeps)


def improve(parts: np.ndarray, centroids: np.ndarray, codes: np.ndarray, sweeps: int) -> np.ndarray:
    n, m, _ = parts.shape
    rows = np.arange(n)
    norm = np.maximum((parts**2).sum(axis=(1, 2)), 1e-30)
    along = np.stack([((parts[:, j] - centroids[j][codes[:, j]]) * parts[:, j]).sum(axis=1) for j in range(m)], axis=1)
    total = along.sum(axis=1)
    for _ in range(sweeps):
        for j in range(m):
            off = parts[:, j, None] - centroids[j]
            each = (off * parts[:, j, None]).sum(axis=2)
            rest = total - along[:, j]
            cost = (off**2).sum(axis=2) + (PARALLEL - 1) * (rest[:, None] + each) ** 2 / norm[:, None]
            codes[:, j] = cost.argmin(axis=1)
            along[:, j] = each[rows, codes[:, j]]
            total = rest + along[:, j]
    return codes


def fit(x: np.ndarray, rounds: int = 8) -> Codebooks:
    """Codebooks for the rows of `x`: alternates coding and the closed-form best centroids of the score-aware loss."""
    dims = x.shape[1]
    m = -(-dims // SUBSPACE)
    rng = np.random.default_rng(17)
    book = Codebooks(np.zeros((m, CENTROIDS, SUBSPACE)), dims)
    parts = book.split(x)
    pick = rng.permutation(len(x))[:CENTROIDS]
    centroids = np.stack([parts[np.resize(pick, CENTROIDS), j] + 1e-9 * rng.standard_normal((CENTROIDS, SUBSPACE)) for j in range(m)])
    codes = np.stack([((parts[:, j, None] - centroids[j]) ** 2).sum(axis=2).argmin(axis=1) for j in range(m)], axis=1)
    norm = np.maximum((parts**2).sum(axis=(1, 2)), 1e-30)
    for turn in range(rounds):
        weight = (PARALLEL - 1) * (turn > 1)  # plain k-means first
        along = np.stack([((parts[:, j] - centroids[j][codes[:, j]]) * parts[:, j]).sum(axis=1) for j in range(m)], axis=1)
        for j in range(m):
            p = parts[:, j]
            rest = along.sum(axis=1) - along[:, j]
            left = np.eye(SUBSPACE) + weight * p[:, :, None] * p[:, None, :] / norm[:, None, None]
            right = p + weight * p * ((rest + (p**2).sum(axis=1)) / norm)[:, None]
            for c in range(CENTROIDS):
                own = codes[:, j] == c
                if own.any():
                    centroids[j, c] = np.linalg.solve(left[own].sum(axis=0), right[own].sum(axis=0))
            along[:, j] = ((p - centroids[j][codes[:, j]]) * p).sum(axis=1)
        if weight:
            codes = improve(parts, centroids, codes, 1)
        else:
            codes = np.stack([((parts[:, j, None] - centroids[j]) ** 2).sum(axis=2).argmin(axis=1) for j in range(m)], axis=1)
    return Codebooks(centroids, dims)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two 4-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], axis=1)
    return (codes[:, ::2] | (codes[:, 1::2] << 4)).astype(np.uint8)


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    v = vector.cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


_CODED = "vec_id bigint, vector array<double>, list int, code binary, half double, off double, far double"


def index(vectors: DataFrame, book: Codebooks, lists: Lists) -> DataFrame:
    """vec_id, vector, list, code (packed), half (half the squared norm), off (the residual's length) and far (the coded vector's squared norm) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                x = _matrix(part.column("vector"))
                codes = book.encode(x)
                coded = book.decode(codes)
                half, off, far = (x**2).sum(axis=1) / 2, np.sqrt(((x - coded) ** 2).sum(axis=1)), (coded**2).sum(axis=1)
                columns = [part.column("vec_id"), part.column("vector"), pa.array(lists.nearest(x).astype(np.int32)), pa.array([c.tobytes() for c in pack(codes)], pa.binary()), pa.array(half), pa.array(off), pa.array(far)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "list", "code", "half", "off", "far"])

    coded = vectors.mapInArrow(run, _CODED)
    if len(lists.centroids) > 1:  # a list's rows follow each other; a large list is dealt to several tasks
        coded = coded.repartition("list", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(STRANDS))).sortWithinPartitions("list")
    return coded


def _least(q: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (query, id, distance) the first `k` of each query, by distance and then id."""
    order = np.lexsort((ids, dist, q))
    q = q[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], ids[order][kept], dist[order][kept]


def _measured(x: np.ndarray, vec_ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, q: np.ndarray, r: np.ndarray, best: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`best` with the pairs of queries `q` and rows `r`, measured on the original vectors."""
    for s in range(0, len(q), PAIRS):
        some, row = q[s : s + PAIRS], r[s : s + PAIRS]
        other = vec_ids[row] != query_ids[some]
        some, row = some[other], row[other]
        dist = np.sqrt(((x[row] - queries[some]) ** 2).sum(axis=1))
        fine = np.isfinite(dist)
        best = _least(*(np.concatenate([a, b]) for a, b in zip(best, (some[fine], vec_ids[row[fine]], dist[fine]), strict=True)), k)
    return best


def _scan(book: Codebooks, lists: Lists, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """The `k` nearest rows of a task's blocks for the queries that visit their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_q = len(query_ids)
        m, c, _ = book.centroids.shape
        exact_tables = np.einsum("qjd,jcd->jqc", book.split(queries), book.centroids)
        tables = exact_tables.astype(np.float32)
        reach = np.abs(exact_tables).max(axis=2).sum(axis=0)
        square = (queries**2).sum(axis=1)
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        best = {s: nothing for s in range(0, n_q, 256)}
        goes = np.zeros((n_q, len(lists.centroids)), dtype=bool)
        np.put_along_axis(goes, lists.visited(queries), True, axis=1)

        def blocks() -> Iterator[pa.RecordBatch]:
            """Blocks of rows of one list."""
            pending: list[pa.RecordBatch] = []
            held, last = 0, None
            for batch in batches:
                own = np.asarray(batch.column("list"))
                edges = np.unique(np.concatenate([np.flatnonzero(own[1:] != own[:-1]) + 1, np.arange(0, len(own), BLOCK), [len(own)]]))
                for s, e in zip(edges, edges[1:], strict=False):
                    part = batch.slice(s, e - s)
                    if pending and (held + part.num_rows > BLOCK or own[s] != last):
                        yield pa.concat_batches(pending)
                        pending, held = [], 0
                    pending.append(part)
                    held, last = held + part.num_rows, own[s]
            if held:
                yield pa.concat_batches(pending)

        for block in blocks():
            visitors = goes[:, block.column("list")[0].as_py()]
            x, vec_ids = _matrix(block.column("vector")), np.asarray(block.column("vec_id"))
            half, off, far = (np.asarray(block.column(name)) for name in ("half", "off", "far"))
            codes = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            codes = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(x), -1)[:, :m].astype(np.int64)
            wide = min(len(x), RERANK * k + 1)
            for s in best:
                names, whole = query_ids[s : s + 256], queries[s : s + 256]
                here = np.flatnonzero(visitors[s : s + 256])
                if not len(here):
                    continue
                q, length = whole[here], square[s + here]
                score = np.repeat(-half[None, :].astype(np.float32), len(q), axis=0)
                for j in range(m):
                    score += tables[j, s + here][:, codes[:, j]]
                near = np.argpartition(-score, wide - 1, axis=1)[:, :wide] if wide < len(x) else np.repeat(np.arange(len(x))[None], len(q), axis=0)
                best[s] = _measured(x, vec_ids, names, whole, np.repeat(here, wide), near.ravel(), best[s], k)
                if wide == len(x):
                    continue
                limit = np.full(len(whole), np.inf)  # a query's k-th distance so far
                last = np.arange(len(best[s][0])) - np.searchsorted(best[s][0], best[s][0]) == k - 1
                limit[best[s][0][last]] = best[s][2][last]
                limit = limit[here]
                # A row can't be nearer than its coded vector less the residual's length: |q - coded| <= limit + off.
                slack = 2.0**-20 * (m + 2) * (reach[s + here] + half.max()) + 2.0**-40 * (far.max() + off.max() ** 2) + 1e-36
                room = (limit**2 - length + slack)[:, None] + (2 * half - far + off**2)[None, :] + 2 * limit[:, None] * off[None, :]
                may = ~(-2.0 * score > room) | ~np.isfinite(2.0 * score)
                np.put_along_axis(may, near, False, axis=1)
                rows = np.flatnonzero(may.any(axis=0))
                if not len(rows):
                    continue
                # Products of whole vectors leave rounding alone in doubt; what is within it is measured.
                squares = length[:, None] + 2 * half[rows][None, :]
                beyond = squares - 2 * (q @ x[rows].T) - 2.0**-50 * (x.shape[1] + 8) * squares > (limit**2)[:, None]
                some, row = np.nonzero(may[:, rows] & ~beyond)
                best[s] = _measured(x, vec_ids, names, whole, here[some], rows[row], best[s], k)
        for s, (q, ids, dist) in best.items():
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[s + q]), pa.array(ids), pa.array(dist)], names=["query_id", "vec_id", "score"])

    return run


def _passes(sizes: list[tuple[int, int]]) -> list[tuple[list[int], int, int]]:
    """Groups of lists with at most `QUERIES_A_PASS` queries, as (lists, parts, part); a list of more queries is dealt out by hash."""
    out: list[tuple[list[int], int, int]] = []
    group: list[int] = []
    held = 0
    for own, n in sorted(sizes):
        if n > QUERIES_A_PASS:
            parts = -(-n // QUERIES_A_PASS)
            out += [([own], parts, p) for p in range(parts)]
            continue
        if held + n > QUERIES_A_PASS:
            out.append((group, 1, 0))
            group, held = [], 0
        group, held = [*group, own], held + n
    return [*out, (group, 1, 0)] if group else out


def nearest(vectors: DataFrame, modulus: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score for the rows of `vectors` (vec_id, embedding) whose vec_id is divisible by `modulus`.

    Up to `LIST_ROWS` rows the answer is exact; beyond, a query visits the lists near
    it, and within them the answer is exact, whatever share is copies or near copies.
    score is the Euclidean distance in double precision on the original vectors;
    ties go to the smaller vec_id; all candidates met come back if fewer than `k`.

    A row is no candidate for queries of its own vec_id.  A vec_id that occurs in
    several rows is one query, with the vector that sorts first, and its rows are
    candidates each.  Rows with a null vec_id, or a vector that is null, empty, zero,
    or has null or non-finite components take no part, nor do vectors of another
    length than the most frequent one (ties: the longest).  No rows give no rows.

    Queries are sent in passes of a bounded number; a pass holds queries of
    neighbouring lists and reads only the lists that they visit.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if lengths is None:
        return spark.createDataFrame([], out)
    rows = rows.filter(F.size("vector") == lengths["d"])
    share = int(min(1.0, TRAIN_ROWS / lengths["count"]) * (1 << 60))
    sampled = rows.filter(F.shiftrightunsigned(F.xxhash64("vec_id", "vector"), 4) <= share).orderBy("vec_id", "vector").select("vector").toArrow()
    sample = _matrix((sampled if sampled.num_rows else rows.limit(TRAIN_ROWS).select("vector").toArrow()).column("vector").combine_chunks())
    book, lists = fit(sample), coarse(sample, lengths["count"], k)
    coded = cut(index(rows, book, lists))
    asked = cut(coded.filter(F.col("vec_id") % modulus == 0).groupBy("vec_id").agg(F.min(F.struct("vector", "list")).alias("q")).select("vec_id", "q.*"))
    tables, held = [], []
    passes = _passes([(r["list"], r["count"]) for r in asked.groupBy("list").count().collect()])
    for i, (own, parts, part) in enumerate(passes):
        some = asked.filter(F.col("list").isin(own) & (F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)) == part)).select("vec_id", "vector").toArrow()
        if some.num_rows:
            queries = _matrix(some.column("vector").combine_chunks())
            near = coded.filter(F.col("list").isin(np.unique(lists.visited(queries)).tolist()))
            held.append(near.mapInArrow(_scan(book, lists, np.asarray(some.column("vec_id")), queries, k), "query_id bigint, vec_id bigint, score double"))
        if held and (len(held) == PASSES_A_TABLE or i == len(passes) - 1):
            found = reduce(DataFrame.union, held)
            tables.append(cut(found) if i < len(passes) - 1 or tables else found)
            held = []
    if not tables:
        return spark.createDataFrame([], out)
    first = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    strands = reduce(DataFrame.union, tables).groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(STRANDS)).alias("strand")).agg(first.alias("top"))
    top = strands.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("rank", "t")).select("query_id", (F.col("rank") + 1).alias("rank"), "t.vec_id", "t.score")
