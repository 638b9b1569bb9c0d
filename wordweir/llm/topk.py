"""Exact top-k search by inner product, pruned by multi-resolution segment statistics.

At each resolution a vector is cut into segments of equal length, each with its mean and its deviation (the
norm of what is left after the mean is taken away). In a segment the inner product of two vectors is at
most length * mean * mean + deviation * deviation, so the sum over segments bounds the score from above (for
vectors of fixed norms: the distance from below). Candidates go from coarse to fine segments; only
those whose bound reaches the query's k-th best score so far stay, and the survivors are scored exactly.

Vectors are rotated first, which changes no inner product: the principal directions of a bounded sample (``SAMPLE`` vectors)
are laid on the Haar functions, coarse to fine. The means of s segments then hold just the s strongest directions, and a
deviation what is left of the others, so few segments tell far candidates apart. The sample decides how much is pruned, never a result.

Queries and candidates are dealt into blocks of bounded bytes; a cell is one block of either. A first block of candidates
(about ``FIRST`` rows by hash) is searched before all others: its k-th scores are floors for every other cell, which then returns only
candidates that reach them. Within a cell a query without a floor gets one from the candidates of the best bounds.
Nothing is broadcast but the rotation.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; vectors meet only
others of the same length; rows with the query's own id are not its candidates, repeated ones included; ties go to the smaller id; candidate
rows that repeat an id each take a rank, of query rows that do the one with the smallest vector asks; scores beyond 64 bits are held at the limits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bytes of a block of queries and of candidates (eight for each component), rows of the first block, and pairs of a tile.
QUERY_BYTES, CANDIDATE_BYTES, FIRST, TILE = 8 << 20, 32 << 20, 4096, 1 << 21
#: Vectors of the sample that the rotation follows, and the longest vectors that are rotated (a rotation is square).
SAMPLE, MAX_ROTATED = 2000, 2048
#: Rows below which a block is not made smaller for the sake of more tasks.
LEAST_ROWS = 512
_SAFE = float(1 << 52)


def integer_vector(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a long; null if the vector has a null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def resolutions(dim: int) -> list[tuple[int, int]]:
    """(segments, how many of the first ones are cut to single components), coarse to fine; segments divide the length."""
    even = [s for s in (4, 8, 16, 32, 64, 128) if s < dim and dim % s == 0]
    fine = [(even[-1], even[-1] * k // 8) for k in (4, 6, 7)] if even else []
    return [(s, 0) for s in even] + fine


def haar(dim: int) -> np.ndarray:
    """Orthonormal rows: for each number of segments s that divides ``dim``, the first s of them span what is constant on s segments."""
    levels = [1, *(s for s, singles in resolutions(dim) if not singles), dim]
    rows = np.zeros((0, dim))
    for s in levels:
        flat = np.kron(np.eye(s), np.ones(dim // s)) / np.sqrt(dim // s)
        new = flat - flat @ rows.T @ rows
        u, w, _ = np.linalg.svd(new.T, full_matrices=False)
        rows = np.concatenate([rows, u.T[: s - len(rows)]])
    return rows


def rotation(sample: np.ndarray) -> np.ndarray:
    """The square matrix R (x becomes x R) that lays the principal directions of the sample on the Haar functions."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, ::-1] @ haar(sample.shape[1])


def statistics(v: np.ndarray, segments: int, singles: int = 0) -> np.ndarray:
    """Per vector, sqrt(length) * mean and deviation of each segment: their inner products are the bound.

    Of the first ``singles`` segments every component is a segment of its own, without deviation.
    """
    length = v.shape[1] // segments
    parts = v[:, singles * length :].reshape(len(v), segments - singles, length)
    mean = parts.mean(2)
    dev = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2))
    return np.concatenate([v[:, : singles * length], mean * np.sqrt(length), dev], 1)


def _scorer(q: np.ndarray, c: np.ndarray) -> Callable:
    """Exact scores of pairs (row of q, row of c)."""
    safe = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * q.shape[1] < _SAFE
    qf, cf = (q.astype(np.float64), c.astype(np.float64)) if safe else (q.astype(object), c.astype(object))

    def scores(qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
        out = np.zeros(len(qi), np.int64)
        for i in range(0, len(qi), 65536):
            u, v = qf[qi[i : i + 65536]], cf[ci[i : i + 65536]]
            if safe:
                out[i : i + 65536] = np.einsum("ij,ij->i", u, v)
            else:
                out[i : i + 65536] = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in (u * v).sum(1)]
        return out

    return scores


def _best(qi: np.ndarray, cid: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties to the smaller id."""
    order = np.lexsort((cid, ~score, qi))  # ~s orders as -s does, and has no overflow
    qi, cid, score = qi[order], cid[order], score[order]
    begin = np.searchsorted(qi, qi, "left")
    keep = np.arange(len(qi)) - begin < k
    return qi[keep], cid[keep], score[keep]


def search(
    qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int,
    turn: np.ndarray | None = None, floor: np.ndarray | None = None, tally: dict[str, int] | None = None,
) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best among the candidates of at least the query's ``floor``.

    ``turn`` is a rotation, and ``tally`` counts the pairs, those that each resolution leaves, and those scored exactly.
    """
    tally = {} if tally is None else tally
    dim = q.shape[1]
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    qt, ct = (qf, cf) if turn is None else (qf @ turn, cf @ turn)
    slack = 1e-6 + 1e-9 * float(np.abs(qf).max(initial=0)) * float(np.abs(cf).max(initial=0)) * dim
    levels = [(r, statistics(qt, *r), statistics(ct, *r)) for r in resolutions(dim)]
    floor = np.full(len(qid), -np.inf) if floor is None else floor.astype(np.float64)
    exact = _scorer(q, c)
    best = tuple(np.zeros(0, np.int64) for _ in range(3))
    wide = max(1, TILE // max(1, min(len(qid), 1024)))
    for x in range(0, len(qid), 1024):
        y = min(len(qid), x + 1024)
        mine = tuple(np.zeros(0, np.int64) for _ in range(3))
        for a in range(0, len(cid), wide):
            b = min(len(cid), a + wide)
            fits = qid[x:y, None] != cid[None, a:b]
            tally["pairs"] = tally.get("pairs", 0) + int(fits.sum())
            bare = np.flatnonzero(~np.isfinite(floor[x:y]))
            if len(bare) and levels and b - a > 2 * k:
                # candidates of the best bounds give these queries a first floor
                _, sq, sc = levels[-1]
                bound = np.where(fits[bare], sq[x:y][bare] @ sc[a:b].T, -np.inf)
                pick = np.argpartition(bound, -2 * k, axis=1)[:, -2 * k :]
                done = bare.repeat(2 * k), pick.ravel()
                good = fits[done]
                done = done[0][good], done[1][good]
                got = exact(done[0] + x, done[1] + a)
                tally["exact"] = tally.get("exact", 0) + len(got)
                mine = _best(*(np.append(m, n) for m, n in zip(mine, (done[0] + x, cid[a:b][done[1]], got), strict=True)), k)
                fits[done] = False
                self_floor(floor, *mine, k)
            least = floor[x:y] - slack
            dense = True  # a mask over the tile, as long as many pairs are left
            for r, sq, sc in levels:
                if dense:
                    fits &= sq[x:y] @ sc[a:b].T >= least[:, None]
                    left = int(fits.sum())
                    if left * 16 < fits.size:
                        dense, (qi, ci) = False, np.nonzero(fits)
                else:
                    keep = np.zeros(len(qi), bool)
                    for i in range(0, len(qi), 1 << 16):
                        u, v = qi[i : i + (1 << 16)], ci[i : i + (1 << 16)]
                        keep[i : i + (1 << 16)] = np.einsum("ij,ij->i", sq[x + u], sc[a + v]) >= least[u]
                    qi, ci = qi[keep], ci[keep]
                    left = len(qi)
                tally[r] = tally.get(r, 0) + left
            if dense:
                qi, ci = np.nonzero(fits)
            tally["exact"] = tally.get("exact", 0) + len(qi)
            score = exact(qi + x, ci + a)
            good = score >= floor[x:y][qi]
            new = qi[good] + x, cid[a:b][ci[good]], score[good]
            mine = _best(*(np.append(m, n) for m, n in zip(mine, new, strict=True)), k)
            self_floor(floor, *mine, k)
        best = tuple(np.append(m, n) for m, n in zip(best, mine, strict=True))
    return [(int(qid[i]), int(d), int(s)) for i, d, s in zip(*best, strict=True)]


def self_floor(floor: np.ndarray, qi: np.ndarray, cid: np.ndarray, score: np.ndarray, k: int) -> None:
    """Raise the floors to the k-th scores of the queries that have k rows (in the order of ``_best``)."""
    if len(qi):
        last = np.append(np.flatnonzero(np.diff(qi)), len(qi) - 1)
        full = np.diff(np.append(-1, last)) == k
        floor[qi[last[full]]] = np.maximum(floor[qi[last[full]]], score[last[full]])


def _vectors(t: pa.Table) -> np.ndarray:
    flat = t.column("v").combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def rotations(vectors: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """A rotation for each of the sample's lengths; the sample is about SAMPLE rows by hash."""
    some = F.pmod(F.xxhash64("id", "v", F.lit(3)), F.lit(max(1, rows // SAMPLE))) == 0
    found: dict[int, list] = {}
    for r in vectors.where(some & (F.size("v") <= MAX_ROTATED)).select("v").limit(2 * SAMPLE).collect():
        found.setdefault(len(r["v"]), []).append(r["v"])
    return {d: rotation(np.array(v, np.float64)) for d, v in found.items() if d and resolutions(d)}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``vectors`` and ``queries``: (id long, v array<long>). Returns query_id, rank, id, score."""
    c = cut(vectors.where(F.col("v").isNotNull() & F.col("id").isNotNull()).select("id", "v"))
    q = cut(queries.where(F.col("v").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v")))
    sizes = [df.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("v")), F.lit(0))).first() for df in (q, c)]
    tasks = c.sparkSession.sparkContext.defaultParallelism
    turn = c.sparkSession.sparkContext.broadcast(rotations(c, sizes[1][0]))

    def blocks(size: tuple, most: int, tasks: int) -> int:
        return max(1, -(-size[1] // most), min(tasks, size[0] // LEAST_ROWS))

    deal = lambda n, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    first = deal(max(1, sizes[1][0] // FIRST), 4) == 0
    by = ["dim", "i", "j"]

    def searched(q: DataFrame, c: DataFrame, nq: int, nc: int) -> DataFrame:
        """(query_id, id, score): each cell's best at or above the queries' floors (null: none)."""
        dim = F.size("v").alias("dim")
        q = q.select("id", "v", "floor", dim, deal(nq, 1).alias("i"), each(nc).alias("j"))
        c = c.select("id", "v", dim, deal(nc, 2).alias("j"), each(nq).alias("i"))

        def cell(a: pa.Table, b: pa.Table) -> pa.Table:
            rows = []
            if a.num_rows and b.num_rows and len(a.column("v")[0]):
                b = b.sort_by("id")
                floor = a.column("floor").to_numpy().astype(np.float64)
                va, vb = _vectors(a), _vectors(b)
                # a floor beyond 2 ** 53 may be rounded up
                floor = np.where(np.isnan(floor), -np.inf, floor - np.abs(floor) * 2.0**-50)
                rows = search(a.column("id").to_numpy(), va, b.column("id").to_numpy(), vb, k, turn.value.get(va.shape[1]), floor)
            elif a.num_rows:
                ids = sorted(b.column("id").to_pylist())
                rows = [(p, d, 0) for p in a.column("id").to_pylist() for d in [x for x in ids if x != p][:k]]
            names = ("query_id", "id", "score")
            return pa.table({n: pa.array([r[x] for r in rows], pa.int64()) for x, n in enumerate(names)})

        return q.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(cell, "query_id bigint, id bigint, score bigint")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    seed = cut(searched(q.withColumn("floor", F.lit(None).cast("bigint")), c.where(first), blocks(sizes[0], QUERY_BYTES, tasks), 1))
    if sizes[1][0] < 2 * FIRST:  # the first block is all
        return best(seed)
    floors = best(seed).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    nq = blocks(sizes[0], QUERY_BYTES, 1)
    more = searched(cut(q.join(floors, "id", "left").select("id", "v", "floor")), c.where(~first), nq, blocks(sizes[1], CANDIDATE_BYTES, 2 * tasks))
    return best(seed.unionByName(more))
