"""SimHash fingerprints, links by pivot distance tables, and their connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import cut_lineage, own_names
from tidemark.operators.components import components

BITS, SEED = 64, 42
#: Fingerprints that differ in this many bits at most are linked.
MAX_BITS = 3
#: Reference fingerprints of the pivot tables.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, seed=SEED) for i in range(16)], dtype=np.uint64)
#: Of 5 blocks at least 2 are equal in a linked pair: 10 keys of 25 or 26 bits find all pairs.
FIRST_BLOCKS, FIRST_KEPT = 5, 2
#: A bucket of more fingerprints is split by a second family of keys over its free bits (see ``finer``).
BUCKET = 8192
#: Bytes of text whose shingles are counted together.
SLICE = 4 << 20
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def hashes(text: str) -> bytes:
    """XXH64 of each three-word shingle, 8 bytes each, highest first; of the whole sequence where words are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < 3:
        return xxhash.xxh64_digest(b" ".join(words), seed=SEED) if words else b""
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:-2].tolist()
    h = xxhash.xxh64_digest
    return b"".join([h(joined[a:b], SEED) for a, b in zip(starts, (ends[2:] - 1).tolist(), strict=True)])


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """64-bit fingerprints; null texts and texts without words have 0."""
    out, at = np.zeros(len(texts), dtype=np.uint64), 0
    while at < len(texts):
        parts, total, begin = [], 0, at
        while at < len(texts) and (total < SLICE or at == begin):
            parts.append(hashes(texts[at] or ""))
            total += len(texts[at] or "")
            at += 1
        n = np.fromiter((len(p) // 8 for p in parts), dtype=np.int64, count=len(parts))
        rows = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, 8)
        base = np.repeat(np.arange(len(parts), dtype=np.int64) * 256, n)
        counts = np.concatenate([np.bincount(base + rows[:, k], minlength=256 * len(parts)).reshape(len(parts), 256) @ BYTE_BITS for k in range(8)], axis=1)
        out[begin:at] = np.packbits(counts * 2 > n[:, None], axis=1).view(">u8").ravel()
    return out


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fingerprints(part.column(2).to_pylist()).view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def masks(free: int, blocks: int, kept: int) -> list[int]:
    """Masks that keep ``kept`` of ``blocks`` near-equal parts of the bits set in ``free``."""
    bits = [i for i in range(BITS) if free >> i & 1]
    parts = [sum(1 << int(b) for b in p) for p in np.array_split(np.array(bits), blocks)]
    return [sum(c) for c in combinations(parts, kept)]


FULL = (1 << BITS) - 1
FIRST = masks(FULL, FIRST_BLOCKS, FIRST_KEPT)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distances(fps: np.ndarray) -> np.ndarray:
    """The pivot table: Hamming distance of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int16)


def near_rows(fps: np.ndarray, table: np.ndarray, i: int, rest: slice) -> np.ndarray:
    """Indices in ``rest`` of fingerprints near the i-th: pivots discard first, the survivors are verified."""
    at = np.arange(rest.start, rest.stop)
    for p in range(0, table.shape[1], 4):
        keep = (np.abs(table[at, p : p + 4] - table[i, p : p + 4]) <= MAX_BITS).all(axis=1)
        at = at[keep]
        if not at.size:
            return at
    return at[np.bitwise_count(fps[at] ^ fps[i]) <= MAX_BITS]


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what links of a bucket connect, fewer than its fingerprints; no pair table is held."""
    table = distances(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    first = table[:, 0]
    root = np.arange(len(fps))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for i, stop in enumerate(np.searchsorted(first, first + MAX_BITS, side="right").tolist()):
        if stop > i + 1:
            for j in near_rows(fps, table, i, slice(i + 1, stop)).tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((int(fps[i]), int(fps[j])))
    return edges


def flips(free: int) -> np.ndarray:
    bits = [1 << i for i in range(BITS) if free >> i & 1]
    return np.array([sum(c) for n in range(1, MAX_BITS + 1) for c in combinations(bits, n)], dtype=np.uint64)


def dense_forest(fps: np.ndarray, free: int) -> list[tuple[int, int]]:
    """As ``forest`` for a large bucket with few free bits: flips of up to three bits are looked up in the sorted bucket.

    Each round gives all fingerprints the least label found near them, then follows labels of labels.
    """
    fps = np.sort(fps)
    label = np.arange(len(fps))
    links = []
    for flip in flips(free):
        other = fps ^ flip
        at = np.searchsorted(fps, other)
        at[at == len(fps)] = 0
        links.append((np.flatnonzero(fps[at] == other), at[fps[at] == other]))
    while True:
        new = label.copy()
        for a, b in links:
            np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(fps[i]), int(fps[r])) for i, r in enumerate(label.tolist()) if r != i]


def runs_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """Buckets (mask number, key, fingerprints, whole) of rows sorted by them; one over ``limit`` comes in parts that aren't whole."""
    held: tuple[int, int] | None = None
    parts: list[np.ndarray] = []
    size, over = 0, False

    def give() -> tuple[int, int, np.ndarray, bool]:
        return held[0], held[1], np.concatenate(parts), not over

    for b in batches:
        if not b.num_rows:
            continue
        t, key, fp = (b.column(i).to_numpy() for i in range(3))
        edge = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        starts, stops = np.concatenate([[0], edge]), np.concatenate([edge, [len(t)]])
        # Runs of one row can't link; only the first and last may go on in another batch.
        keep = (stops - starts > 1) | (starts == 0) | (stops == len(t))
        for a, z in zip(starts[keep].tolist(), stops[keep].tolist(), strict=True):
            now = (int(t[a]), int(key[a]))
            if now != held:
                if size > 1 or over and size:
                    yield give()
                held, parts, size, over = now, [], 0, False
            parts.append(fp[a:z].view(np.uint64))
            size += z - a
            if size > limit:
                over = True
                yield give()
                parts, size = [], 0
    if size > 1 or over and size:
        yield give()


def link(fps: DataFrame, limit: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints of ``fp`` just as all links of at most three bits do.

    Candidates meet in buckets of equal key, by the pigeonhole principle without loss. In a bucket the pivot tables discard
    and the rest is verified. What goes on is a forest, never all pairs. Buckets over ``limit`` are keyed again by three of
    six parts of their free bits; 19 or 20 free bits are then left, so no bucket holds more than 2 ** 20 fingerprints.
    """
    out = "a long, b long, t int, key long"

    def keyed(rows: DataFrame, pairs: Column) -> DataFrame:
        return rows.select("fp", F.explode(pairs).alias("k")).select("k.t", "k.key", "fp").repartition("t", "key").sortWithinPartitions("t", "key", "fp")

    def of(numbered: list[tuple[int, int]]) -> Column:
        return F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in numbered])

    def table(edges: list[tuple[int, int]], spilled: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if edges:
            e = np.array(edges, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.nulls(len(e), pa.int32()), pa.nulls(len(e), pa.int64())], names=["a", "b", "t", "key"])
        for t, members in spilled:
            yield pa.RecordBatch.from_arrays([pa.array(members.view(np.int64)), pa.nulls(len(members), pa.int64()), pa.array(np.full(len(members), t, dtype=np.int32)), pa.nulls(len(members), pa.int64())], names=["a", "b", "t", "key"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for t, _, members, whole in runs_of(batches, limit):
            if whole:
                edges += forest(members)
            else:
                yield from table([], [(t, members)])
            if len(edges) > 50_000:
                yield from table(edges, [])
                edges = []
        yield from table(edges, [])

    found = cut_lineage(keyed(fps, of(list(enumerate(FIRST)))).mapInArrow(first, out))
    edges = found.filter("t is null").select("a", "b")
    spilled = found.filter("t is not null").select(F.col("a").alias("fp"), "t")
    if not spilled.take(1):
        return edges
    return edges.unionByName(finer(spilled))


def finer(spilled: DataFrame) -> DataFrame:
    """Edges in overfull buckets: (fp, t) are members of a bucket of the t-th mask; the key now holds three more parts."""
    second = {t: masks(FULL ^ m, 6, 3) for t, m in enumerate(FIRST)}
    numbered = F.coalesce(*[F.when(F.col("t") == t, F.array(*[F.struct(F.lit(100 * t + i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(FIRST[t] | m))).alias("key")) for i, m in enumerate(ms)])) for t, ms in second.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, members, _ in runs_of(batches, 1 << 20):
            m = FIRST[t // 100] | second[t // 100][t % 100]
            e = forest(members) if len(members) < 512 else dense_forest(members, FULL ^ m)
            if e:
                e = np.array(e, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    rows = spilled.select("fp", F.explode(numbered).alias("k")).select("k.t", "k.key", "fp").repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return rows.mapInArrow(run, "a long, b long")


def firsts(rows: DataFrame, first: Column, edges_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, first) of every distinct ``fp`` of ``rows``: the least ``first`` that the edges between them reach from it.

    Equal fingerprints are folded before the search, so copies cost nothing there.
    """
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min(first).alias("least")))
    stars = components(edges_of(distinct.select("fp")))
    rooted = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("first")))
    return cut_lineage(rooted.join(named, "root").select("fp", "first"))


def first_by_fingerprint(rows: DataFrame, first: Column, limit: int = BUCKET) -> DataFrame:
    """(fp, first) as ``firsts`` gives it, over links of at most three bits."""
    return firsts(rows, first, lambda fps: link(fps, limit))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the least doc_id that links reach. Null and wordless texts have fingerprint 0, which links as any
    other. Rows without a doc_id link, but give no component_id; where no row of a component has one it is null. Repeated
    rows each have a row; very long texts are read whole; other columns, whatever their names, are not read. An empty table
    gives none.
    """
    rows = cut_lineage(fingerprint_rows(docs, id_col, text_col).select("doc_id", "fp"))
    found = first_by_fingerprint(rows, F.col("doc_id"), limit)
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BUCKET) -> DataFrame:
    """The same columns; of each component one row stays, that of the least id, and of the least text hash in it.

    Rows are told apart by id and text: an id that comes with several texts stays once for each component in which it is
    the least. Rows without an id come last, so one of them stays only where no row of its component has an id. Null and
    wordless texts are alike; very long texts are read whole; columns of any other name pass as they are; an empty table gives none.
    """
    rows = cut_lineage(fingerprint_rows(docs, id_col, text_col))
    return keep_first(docs, rows, lambda fps: link(fps, limit), id_col, text_col)


def row_key(c: Column) -> Column:
    """An id that is missing joins as the least long; together with the text hash no other row means the same."""
    return F.coalesce(c.cast("long"), F.lit(-(1 << 63)).cast("long"))


def keep_first(docs: DataFrame, rows: DataFrame, edges_of: Callable[[DataFrame], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are the first of a component, told apart by doc_id and text_hash of ``rows``."""
    own = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("text_hash"))
    kept = rows.join(firsts(rows, own, edges_of), "fp").filter(own == F.col("first"))
    row, text = own_names(docs, "tm_id", "tm_text")
    keys = cut_lineage(kept.select(row_key(F.col("doc_id")).alias(row), F.col("text_hash").alias(text)).distinct())
    keyed = docs.withColumns({row: row_key(F.col(id_col)), text: F.xxhash64(text_col)})
    return keyed.join(keys, [row, text], "left_semi").dropDuplicates([row, text]).select(*docs.columns)
