"""WARC archives of pages, read back and ordered by an external merge of capture runs."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import cut_lineage, shared_dir, shuffle_partitions

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
LEVEL = 1
#: An archive of so many bytes is closed and the next one begun; one task reads an archive.
ARCHIVE_BYTES = 1 << 30
#: Index rows that one task merges, some 300 bytes each; more captures make more ranges.
RANGE_ROWS = 200_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "page_id long, url string, url_key string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, run long, seq long"


def url_key(url: Column) -> Column:
    """The URL with its host reversed and neither scheme, www., port 80 or 443 nor fragment, in lower case: com,example)/path?query."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r":(80|443)$", ""), r"^www\d*\.", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def captured(page_id: int | None) -> str:
    """The time of a capture; the pages have none, so their ids count nanoseconds, which tells any two ids apart (missing: 0)."""
    seconds, rest = divmod(page_id or 0, 10**9)
    return (EPOCH + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S") + f".{rest:09d}Z"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit has the response's headers, full length among them, but not its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if kind == "revisit" else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}')}>", f"WARC-Date: {captured(page_id)}"]
    head += [f"WARC-Target-URI: {target}"] * (url is not None) + [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    head += [f"X-Page-Id: {page_id}"] * (page_id is not None)
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}')}>", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; a payload that doesn't have its digest or length is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if len(body) != int(fields["Content-Length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload doesn't have its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "captured": fields["WARC-Date"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if kind == "response" else None}


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload one with a smaller page_id has too."""
    found = pages.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n")).filter(F.col("n") >= LEAST_BYTES)
    first = found.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("held")).filter("held > 1").drop("held")
    # From files, so that the join can split the rows of one payload that very many pages have.
    return found.join(cut_lineage(first), "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record for every row into gzipped archives in ``folder``; returns their names and sizes.

    Rows stay in the tasks that join them with their payload's first page; each task sorts its own by URL key, time and id
    and begins another archive whenever one has ``archive_bytes``: an archive is a sorted capture run.
    A task writes to a name of its own attempt and renames it when it is whole, so a lost or repeated task leaves nothing
    half-written under a final name. Null payloads are empty; null URLs have no target; null ids are responses.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    known = revisits(pages).select(F.col("page_id").alias("tm_id"), F.col("digest").alias("tm_digest"), "refers_to")
    keyed = pages.withColumn("digest", F.sha2("html", 256))
    rows = keyed.join(known, (F.col("page_id") == F.col("tm_id")) & (F.col("digest") == F.col("tm_digest")), "left").select("page_id", "url", "html", "digest", "refers_to", url_key(F.col("url")).alias("url_key"))
    rows = rows.sortWithinPartitions("url_key", F.col("page_id").asc_nulls_first(), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        out, done, n, size, name, draft = None, [], 0, 0, "", ""

        def close() -> None:
            out.close()
            store.move(draft, f"{root}/{name}")
            done.append((task.partitionId() << 20 | len(done), f"{folder}/{name}", n, size))

        for b in batches:
            for page_id, url, html, digest, refers_to in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if out is None:
                    name = f"run-{task.partitionId():06d}-{len(done):06d}.warc.gz"
                    draft, n, size = f"{root}/.{name}.{task.taskAttemptId()}", 0, 0
                    out = store.open_output_stream(draft)
                packed = gzip.compress(record("response" if refers_to is None else "revisit", page_id, url, html.encode("utf-8"), digest, refers_to), LEVEL, mtime=0)
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["run", "archive", "records", "bytes"])

    return cut_lineage(rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "run long, archive string, records long, bytes long"))


def records_of(archive: str) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record of an archive, read in pieces; a record is one gzip member."""
    store, path = filesystem(archive)
    with store.open_input_stream(path, compression=None) as f:
        offset, data = 0, f.read(1 << 20)
        while data:
            unzip, parts, used = zlib.decompressobj(31), [], 0
            while not unzip.eof:
                if not data:
                    raise ValueError(f"{archive} is cut off")
                parts.append(unzip.decompress(data))
                used += len(data) - len(unzip.unused_data)
                data = unzip.unused_data if unzip.eof else f.read(1 << 20)
            yield offset, b"".join(parts)
            offset += used
            data = data or f.read(1 << 20)


def read_archives(archives: DataFrame) -> DataFrame:
    """Capture index rows (see SCHEMA) of all records; ``archives`` has run and archive. One task reads an archive at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, archive in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for seq, (offset, raw) in enumerate(records_of(archive)):
                    r = parse(raw)
                    rows.append({**{k: v for k, v in r.items() if k != "payload"}, "archive": archive, "offset": offset, "run": number, "seq": seq})
                    if len(rows) >= 5000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "captured": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "archive": pa.string(), "offset": pa.int64(), "run": pa.int64(), "seq": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], names=list(kinds))

    schema = ", ".join(x for x in SCHEMA.split(", ") if not x.startswith("url_key"))
    n = archives.count()
    dealt = archives.select("run", "archive").repartition(max(1, min(n, shuffle_partitions(archives.sparkSession))), "run")
    return dealt.mapInArrow(run, schema).withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """k-way merge of sorted iterators of (key, value): each inner node keeps the loser of its match, the winner goes up."""

    DONE = (1, ())

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [self.pull(i) for i in range(len(runs))] or [(self.DONE, None)]
        self.losers = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.beats(a, b) else (b, a)
        self.top = winners[1] if self.k > 1 else 0

    def pull(self, i: int) -> tuple:
        found = next(self.runs[i], None)
        return (self.DONE, None) if found is None else ((0, found[0]), found[1])

    def beats(self, a: int, b: int) -> bool:
        return (self.heads[a][0], a) < (self.heads[b][0], b)

    def __iter__(self) -> Iterator:
        while self.heads[self.top][0] != self.DONE:
            yield self.heads[self.top][1]
            i = self.top
            self.heads[i] = self.pull(i)
            node = (i + self.k) // 2
            while node:
                if self.beats(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.top = i


def merge_runs(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All index rows in global order of URL key, time and page id, with ``place`` rising along it.

    The order is cut into ranges of about ``range_rows`` rows at most, a URL of very many captures over several. A task gets
    of every run the slice in its range, in the run's own order, and merges the slices by a loser tree. It holds the range
    as Arrow columns; of each slice a few rows at a time become keys, and what is merged goes on at once.
    """
    n = max(shuffle_partitions(index.sparkSession), -(-index.count() // range_rows))
    keys = ["url_key", "captured", F.col("page_id").asc_nulls_first(), "run", "seq"]
    columns = index.columns

    def slice_keys(held: pa.Table, a: int, z: int) -> Iterator[tuple]:
        for at in range(a, z, 256):
            part = held.slice(at, min(256, z - at))
            rows = zip(*[part[c].to_pylist() for c in ("url_key", "captured", "page_id", "run", "seq")], strict=True)
            for i, (u, t, p, r, s) in enumerate(rows, at):
                yield (u.encode("utf-8"), t, p is not None, p or 0, r, s), i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        held = pa.Table.from_batches(got).combine_chunks()
        number = held["run"].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1, [len(number)]]).tolist()
        merged: list[int] = []
        for i in LoserTree([slice_keys(held, a, z) for a, z in zip(starts[:-1], starts[1:], strict=True)]):
            merged.append(i)
            if len(merged) == 5000:
                yield from held.take(pa.array(merged)).to_batches()
                merged = []
        if merged:
            yield from held.take(pa.array(merged)).to_batches()

    dealt = index.select(*columns).repartitionByRange(n, *keys).sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(run, index.schema).withColumn("place", F.monotonically_increasing_id())


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


def capture_histories(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, read these back, and return every capture in order of its URL key and time (see SCHEMA, place).

    Of records with equal payloads of at least 100 bytes the one of the least page_id is the response and the others revisit
    it. Repeated rows of one id and payload are responses or revisits alike. A long payload is held whole by the task that
    writes or reads it; other columns, whatever their names, are not read. An empty table gives no archive and no rows.
    """
    archives = write_archives(pages, folder or new_folder(pages.sparkSession))
    return merge_runs(cut_lineage(read_archives(archives)))
