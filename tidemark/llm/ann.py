"""Nearest neighbours by a block matrix join of int8 tiles with quantisation error bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import cut_lineage

#: Bytes of a tile's two sides (queries, candidates), and queries that are multiplied at a time. Candidates are copied once for each block
#: of queries, so that side is the larger one.
QUERY_BYTES, CANDIDATE_BYTES, QUERIES = 8 << 20, 2 << 20, 256
#: Relative slack for the rounding of the bounds themselves.
SLACK = 1e-9
#: The least double above 0.
LEAST = 5e-324


def usable(embedding: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale of each row, norm of the coded vector and norm of what the code misses.

    Norms are those of x over its scale, so that neither very large nor very small components leave the range of squares.
    """
    scale = np.maximum(np.abs(x).max(axis=1) / 127.0, LEAST)
    relative = x / scale[:, None]
    codes = np.clip(np.rint(relative), -127, 127)
    return codes.astype(np.int8), scale, np.linalg.norm(codes, axis=1) * scale, np.linalg.norm(relative - codes, axis=1) * scale


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component to the last: the same bits on any machine."""
    total = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        total += x * y
    return total


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, q_own: np.ndarray | None = None, c_own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of at least each query's k best candidates in the tile, ties at the end included.

    The product of the codes is exact: sums of products of int8 codes stay below 2 ** 24 in up to 1040 dimensions, and
    wider vectors are multiplied in double precision. With it and the bound on what the codes miss, every pair has a least
    and a greatest possible score; pairs that can't reach the k-th greatest least score are discarded. A pair whose bounds leave the
    range of doubles survives. Rows of equal ``q_own`` and ``c_own`` (or ids) are one row and no pair.
    """
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    q_own, c_own = qid if q_own is None else q_own, cid if c_own is None else c_own
    out: tuple[list, list, list] = ([], [], [])
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        qc, qs, qn, qe = quantised(q)
        cc, cs, cn, ce = quantised(c)
        cand = np.ascontiguousarray(cc.T.astype(kind))
        for a in range(0, len(qid), QUERIES):
            s = slice(a, a + QUERIES)
            mid = (qc[s].astype(kind) @ cand).astype(np.float64) * qs[s, None] * cs[None, :]
            # q.c = coded.coded + missed.c + coded.missed; each of the last two is at most a product of norms.
            miss = (qe[s, None] * (cn + ce)[None, :] + qn[s, None] * ce[None, :]) * (1 + SLACK) + SLACK * qn[s, None] * cn[None, :] + q.shape[1] * LEAST
            told = np.isfinite(mid) & np.isfinite(miss)
            other = q_own[s, None] != c_own[None, :]
            low = np.where(told & other, mid - miss, -np.inf)
            if low.shape[1] > k:
                least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
            else:
                least = np.full(len(low), -np.inf)
            i, j = np.nonzero(other & (~told | (mid + miss >= least[:, None])))
            exact = inner(q[s][i], c[j])
            # Of the survivors only each query's k best go on; a score that is no number (of infinite parts) comes last.
            order = np.lexsort((cid[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            keep = nth < k
            out[0].append(qid[s][i[keep]])
            out[1].append(cid[j[keep]])
            out[2].append(exact[keep])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def nearest(vectors: DataFrame, queries: DataFrame | Column, k: int = 20, block: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query vector the ``k`` others of the largest inner product, exactly.

    ``queries`` is a condition on the rows of ``vectors``: then every row but the query's own is a candidate, other rows of its id
    among them; or a table of its own: then rows of the query's id are no candidates. Ties go to the smaller vec_id. Each row is a
    vector of its own, and a query of its own if it is one, however often its id repeats. Unusable vectors (see ``usable``) and null
    ids take no part on either side. Scores beyond doubles are infinite, or no number, which comes last. Vectors of
    another dimension than the query's are no candidates of it. Every tile of a block of queries and a block of candidates is
    one group; both sides are copied to the tiles they are in, and a group's size, bounded in bytes (or by ``block`` rows a
    side), doesn't depend on the data. Other columns, whatever their names, are not read; an empty table gives none.
    """
    within = isinstance(queries, Column)

    def clean(df: DataFrame) -> DataFrame:
        columns = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")]
        rows = df.select(*columns, *([F.coalesce(queries, F.lit(False)).alias("asks")] if within else []))
        # Held apart, so that the number that tells rows apart stays.
        return cut_lineage(rows.filter(F.col("id").isNotNull() & usable(F.col("v")))).withColumn("row", F.monotonically_increasing_id())

    cands = clean(vectors)
    asked = cands.filter("asks") if within else clean(queries)
    own = F.col("row" if within else "id").alias("own")
    sizes = []
    for rows, size in ((cands, CANDIDATE_BYTES), (asked, QUERY_BYTES)):
        held = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
        sizes.append(max(1, -(-held["n"] // (block or max(1, size // (8 * (held["dim"] or 1)))))))
    n_c, n_q = sizes
    number = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("row")), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dim = F.size("v").alias("dim")
    left = asked.select("row", "id", own, "v", dim, number(n_q, 1).alias("qb")).select("*", spread(n_c).alias("cb"))
    # Under names of their own: both sides may be rows of one table.
    right = cands.select(F.col("id").alias("c_id"), F.col("row" if within else "id").alias("c_own"), F.col("v").alias("c"), dim, number(n_c, 2).alias("cb")).select("*", spread(n_q).alias("qb"))

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        at, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if a.num_rows and b.num_rows:
            at, found, score = tile(np.arange(a.num_rows), matrix(a["v"].combine_chunks()), b["c_id"].to_numpy(), matrix(b["c"].combine_chunks()), k, a["own"].to_numpy(), b["c_own"].to_numpy())
        asks = pa.array(at, pa.int64())
        return pa.table({"row": a["row"].take(asks), "query_id": a["id"].take(asks), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

    keys = ("dim", "qb", "cb")
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(join, "row long, query_id long, vec_id long, score double")

    def merge(own: pd.DataFrame) -> pd.DataFrame:
        """The k best of each query by a heap over what its tiles found."""
        out = []
        own = own.sort_values("row", kind="stable")
        _, starts = np.unique(own["row"].to_numpy(), return_index=True)
        ids, score, vec = own["query_id"].to_numpy(), own["score"].to_numpy(), own["vec_id"].to_numpy()
        none = np.isnan(score)
        lost, down = none.tolist(), np.where(none, 0.0, -score).tolist()
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True):
            best = heapq.nsmallest(k, zip(lost[a:z], down[a:z], vec[a:z].tolist(), strict=True))
            out += [(ids[a], r, v, float("nan") if no else -s) for r, (no, s, v) in enumerate(best, 1)]
        return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    # About a thousand queries in a group, each with k rows of every candidate block.
    bucket = F.pmod(F.xxhash64(F.lit(3), F.col("row")), F.lit(max(1, 16 * n_q)))
    return tiles.groupBy(bucket.alias("b")).applyInPandas(merge, "query_id long, rank int, vec_id long, score double")
