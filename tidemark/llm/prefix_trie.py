"""Prefix trie of conversations: subtree totals by leaf-peeling message passing between heavy paths."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import cut_lineage, shuffle_partitions

#: Turns of one conversation (nodes of one path) that one window holds together; longer ones are run over block by block.
BLOCK = 1024
#: Ids in one piece of a list that is hashed.
PIECE = 20_000
LOW = (1 << 33) - 1


def running(rows: DataFrame, keys: list[str], at: str, made: dict[str, Column], join: Callable[[Column, Column], Column], longest: int, block: int, backwards: bool = False) -> DataFrame:
    """``rows`` with each aggregate of ``made`` run along ``at`` (from 0) of equal ``keys``, from the row itself to the first, or last, one.

    Where the longest run is over ``block`` rows, each block is run over by itself and joined (``join``) with the totals of the
    blocks before it, so that no task holds a long run.
    """
    out = list(made)
    rows = rows.withColumn("block", F.floor(F.col(at) / block).cast("long"))
    way, beside = (F.desc, 1) if backwards else (F.asc, -1)
    within = rows.withColumns({o: f.over(Window.partitionBy(*keys, "block").orderBy(way(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)) for o, f in made.items()})
    if longest < block:
        return within.drop("block")
    totals = rows.groupBy(*keys, "block").agg(*[f.alias(o) for o, f in made.items()])
    # One row for each block; blocks of a run are together here.
    order = Window.partitionBy(*keys).orderBy("block")
    frame = order.rowsBetween(*((1, Window.unboundedFollowing) if beside > 0 else (Window.unboundedPreceding, -1)))
    again = {"sum": F.sum, "max": F.max, "xor": F.bit_xor}
    kind = {o: again[o.split("_")[0]] for o in out}
    carried = totals.select(*keys, "block", *[kind[o](o).over(frame).alias(f"c_{o}") for o in out]).filter(" or ".join(f"c_{o} is not null" for o in out))
    joined = within.join(carried, [*keys, "block"], "left")
    return joined.withColumns({o: F.when(F.col(f"c_{o}").isNull(), F.col(o)).when(F.col(o).isNull(), F.col(f"c_{o}")).otherwise(join(F.col(o), F.col(f"c_{o}"))) for o in out}).drop("block", *[f"c_{o}" for o in out])


def ranked(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, rank from 1, x, y, n_bytes) of every turn, in order of turn, null first; x and y stand for role and text.

    Turns of one number are ordered by their content; equal ones are alike. A long conversation is ordered by many tasks: rows are
    sorted in ranges, and a turn's rank is its place among all rows less that of its conversation's first turn.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    content = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), content.alias("m"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.select("conv", "turn", F.xxhash64("m").alias("x"), F.xxhash64(F.lit(1), "m").alias("y"), "n_bytes").withColumn("salt", F.monotonically_increasing_id())
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("x"), F.col("y"), F.col("salt")]
    laid = rows.repartitionByRange(shuffle_partitions(turns.sparkSession), *keys).sortWithinPartitions(*keys)
    laid = cut_lineage(laid.select("conv", "x", "y", "n_bytes", F.monotonically_increasing_id().alias("at")))
    # As many rows as ranges.
    sizes = laid.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    firsts = laid.groupBy("conv").agg(F.min("at").alias("first"))
    placed = lambda df, at: df.withColumn("part", F.shiftright(at, 33)).join(F.broadcast(starts), "part").withColumn(at, F.col("before") + F.col(at).bitwiseAND(F.lit(LOW))).drop("part", "before")
    return placed(laid, "at").join(placed(firsts, "first"), "conv").select("conv", (F.col("at") - F.col("first") + 1).alias("rank"), "x", "y", "n_bytes")


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """Conversations that begin as the first of their group does: (conv, depth, x, y, n_bytes, last).

    ``turns`` as ``ranked`` gives them. Conversation c takes the first h = crc32(c) % ``heads`` turns of c - c % ``group``, then its own
    after its first h. Each conversation also has a row of depth 0 without content.
    """
    turns = cut_lineage(turns)
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(heads)))
    sizes = sizes.withColumn("base", F.col("conv") - F.col("conv") % group)
    taken = F.when(F.col("base_n").isNull(), F.lit(0).cast("long")).otherwise(F.least("base_n", "h"))
    known = sizes.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    known = cut_lineage(known.select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    asked = known.filter("taken > 0").select("conv", F.col("size"), "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))).alias("rank"))
    # At most heads - 1 turns of a conversation are asked for, by at most 2 group - 1 others.
    first = turns.filter(F.col("rank") < heads).withColumnRenamed("conv", "base")
    copied = asked.join(first, ["base", "rank"]).select("conv", F.col("rank").alias("depth"), "x", "y", "n_bytes", (F.col("rank") == F.col("size")).alias("last"))
    depth = F.col("taken") + F.col("rank") - F.col("h")
    own = turns.join(known, "conv").filter(F.col("rank") > F.col("h")).select("conv", depth.alias("depth"), "x", "y", "n_bytes", (depth == F.col("size")).alias("last"))
    zero = F.lit(0).cast("long")
    roots = known.select("conv", zero.alias("depth"), zero.alias("x"), zero.alias("y"), zero.alias("n_bytes"), (F.col("size") == 0).alias("last"))
    return copied.unionByName(own).unionByName(roots)


def as_conversations(turns: DataFrame) -> DataFrame:
    """``ranked`` turns as they are, in the shape of ``rebuilt``."""
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    roots = sizes.select("conv", zero.alias("depth"), zero.alias("x"), zero.alias("y"), zero.alias("n_bytes"), F.lit(False).alias("last"))
    return turns.join(sizes, "conv").select("conv", F.col("rank").alias("depth"), "x", "y", "n_bytes", (F.col("rank") == F.col("n")).alias("last")).unionByName(roots)


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of all conversations' prefixes, and (conv_id, depth, ends) for each conversation that ends at a node.

    ``conversations``: (conv, depth, x, y, n_bytes, last), each conversation with a row of depth 0. A node is known by its least member ``conv_id``
    and its ``depth``; nodes carry parent_conv_id, n_convs, n_children, n_leaves and saved_tokens (see the query). An empty table gives none of both.

    A prefix is known by the exclusive or of 128 bits of each of its turns with its depth, which needs no order. Of a node's children the one
    of most members (then of least id) goes on its heavy path, others begin a path of their own, so that a conversation crosses at most
    log2(conversations) paths. Messages go between paths: a path counts those that hang off it; one that waits for none sends its
    total to the node it hangs off, whose path counts down, until only that of the root is left, after as many rounds. Inside a path
    totals are running sums. Equal conversations are folded where they are counted; no list of members is gathered.
    """
    spark = conversations.sparkSession
    here, there = F.xxhash64("x", "y", "depth"), F.xxhash64("depth", "y", "x")
    turns = conversations.withColumns({"a": F.when(F.col("depth") > 0, here).otherwise(0), "b": F.when(F.col("depth") > 0, there).otherwise(0)})
    turns = cut_lineage(turns.select("conv", "depth", "a", "b", "n_bytes", "last"))
    longest = turns.agg(F.max("depth")).first()[0]
    rows = running(turns, ["conv"], "depth", {"xor_a": F.bit_xor("a"), "xor_b": F.bit_xor("b")}, lambda x, y: x.bitwiseXOR(y), longest or 0, block)
    before = {"before_a": F.col("xor_a").bitwiseXOR(F.col("a")), "before_b": F.col("xor_b").bitwiseXOR(F.col("b"))}
    rows = cut_lineage(rows.withColumns(before).drop("a", "b"))
    key, up = ["depth", "xor_a", "xor_b"], [(F.col("depth") - 1).alias("depth"), F.col("before_a").alias("xor_a"), F.col("before_b").alias("xor_b")]
    nodes = cut_lineage(rows.groupBy(*key).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min("before_a").alias("before_a"), F.min("before_b").alias("before_b")))
    below = nodes.filter("depth > 0").select(*up, "n_convs", "conv_id").groupBy(*key).agg(F.count("*").alias("n_children"), (-F.max(F.struct("n_convs", -F.col("conv_id")))["col2"]).alias("heavy"))
    parents = cut_lineage(nodes.join(below, key, "left").select(*key, "conv_id", "n_convs", "n_bytes", "before_a", "before_b", F.coalesce("n_children", F.lit(0)).alias("n_children"), "heavy"))
    # The root, which all its children would meet, is one row that the driver knows.
    root = parents.filter("depth = 0").select("conv_id", "heavy", "n_convs", "n_children").first()
    if root is None:
        kinds = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
        return spark.createDataFrame([], kinds), spark.createDataFrame([], "conv_id long, depth long, ends long")
    over = parents.select((F.col("depth") + 1).alias("depth"), F.col("xor_a").alias("before_a"), F.col("xor_b").alias("before_b"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("heir"))
    own = ["conv_id", "n_convs", "n_children", "n_bytes"]
    top_ones = parents.filter("depth = 1").select(*key, *own, F.lit(root["conv_id"]).alias("parent_conv_id"), F.lit(root["heavy"]).cast("long").alias("heir"))
    deeper = parents.filter("depth > 1").join(over.filter("depth > 1"), ["depth", "before_a", "before_b"]).select(*key, *own, "parent_conv_id", "heir")
    placed = top_ones.unionByName(deeper).withColumn("light", F.col("conv_id") != F.col("heir")).drop("heir")
    # Each conversation walks down; the last light node on its way begins the path that it is on.
    begins = lambda df, light: df.withColumn("top", F.when(light, F.struct(F.col("depth").alias("d"), F.col("conv_id").alias("c"))))
    walked = begins(rows.filter("depth > 0").select("conv", "last", *key).join(placed, key), F.col("light"))
    roots = rows.filter("depth = 0").select("conv", "last", *key, F.lit(root["conv_id"]).alias("conv_id"), F.lit(root["n_convs"]).alias("n_convs"), F.lit(root["n_children"]).alias("n_children"), F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(True).alias("light"))
    walked = walked.unionByName(begins(roots, F.lit(True)))
    walked = cut_lineage(running(walked, ["conv"], "depth", {"max_top": F.max("top")}, F.greatest, longest, block).drop("top", "xor_a", "xor_b"))
    ends = walked.filter("last").select("conv_id", "depth", F.col("conv").alias("ends"))
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    held = walked.filter("conv = conv_id").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", saved.alias("saved"), F.col("max_top.d").alias("top"), F.col("max_top.c").alias("path"))

    paths = held.groupBy("top", "path").agg(F.sum("saved").alias("saved"), F.sum(F.greatest(F.col("n_children") - 1, F.lit(0))).alias("waits"), F.max(F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id"))).alias("on"))
    hung = held.select((F.col("depth") + 1).alias("top"), F.col("conv_id").alias("on"), F.col("top").alias("to_top"), F.col("path").alias("to_path"))
    active = cut_lineage(paths.withColumn("leaves", F.lit(1).cast("long")).join(hung, ["top", "on"], "left"))
    sent = []
    while True:
        done = active.filter("waits = 0 and top > 0")
        messages = done.groupBy(F.col("to_top").alias("top"), F.col("to_path").alias("path")).agg(F.count("*").alias("came"), F.sum("saved").alias("saved_"), F.sum("leaves").alias("leaves_"))
        sent.append(done.select("on", (F.col("top") - 1).alias("depth"), "saved", "leaves"))
        left = active.filter("waits > 0").join(messages, ["top", "path"], "left")
        more = lambda c: F.col(c) + F.coalesce(f"{c}_", F.lit(0))
        active = cut_lineage(left.select("top", "path", "on", "to_top", "to_path", (F.col("waits") - F.coalesce("came", F.lit(0))).alias("waits"), more("saved").alias("saved"), more("leaves").alias("leaves")))
        if active.filter("top > 0").isEmpty():
            break
    got = sent[0]
    for more_ in sent[1:]:
        got = got.unionByName(more_)
    got = got.groupBy(F.col("on").alias("conv_id"), "depth").agg(F.sum("saved").alias("saved_"), F.sum("leaves").alias("leaves_"))
    nodes = held.join(got, ["conv_id", "depth"], "left").withColumns({"saved": F.col("saved") + F.coalesce("saved_", F.lit(0)), "leaves": F.coalesce("leaves_", F.lit(0))}).drop("saved_", "leaves_")
    nodes = running(nodes, ["top", "path"], "depth", {"sum_saved": F.sum("saved"), "sum_leaves": F.sum("leaves")}, lambda x, y: x + y, longest, block, backwards=True)
    # Each path ends at one leaf of its own.
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("sum_leaves") + 1).alias("n_leaves"), F.col("sum_saved").alias("saved_tokens")), ends


def hashed_lists(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and ``sha256`` of the decimal values of each key, in ascending order, comma-joined.

    Values are sorted in ranges over all tasks, which write them as pieces of a list; only these pieces, a few large rows of a
    long list, meet in the task that hashes it, one at a time.
    """
    n = shuffle_partitions(rows.sparkSession)
    kinds = ", ".join(f"{k} long" for k in keys)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = list(zip(*[b.column(i).to_pylist() for i in range(len(keys))], strict=True))
            values = b.column(len(keys)).to_pylist()
            out, at = [], 0
            for i in range(1, len(own) + 1):
                if i == len(own) or own[i] != own[at] or i - at == PIECE:
                    out.append((*own[at], values[at], ",".join(map(str, values[at:i]))))
                    at = i
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * (len(keys) + 1) + [pa.string()], strict=True)], names=[*keys, "first", "piece"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            out = []
            for *own, _, piece in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True):
                if own != last:
                    if state:
                        out.append((*last, state.hexdigest()))
                    last, state = own, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield batch(out)
        if state:
            yield batch([(*last, state.hexdigest())])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * len(keys) + [pa.string()], strict=True)], names=[*keys, "sha256"])

    laid = rows.select(*keys, value).repartitionByRange(n, *keys, value).sortWithinPartitions(*keys, value)
    listed = laid.mapInArrow(pieces, f"{kinds}, first long, piece string")
    return listed.repartition(n, *keys).sortWithinPartitions(*keys, "first").mapInArrow(hashes, f"{kinds}, sha256 string")


def with_ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``nodes`` with ``ends_sha256``, the digest of the ids of conversations that end at each."""
    digests = hashed_lists(ends, ["conv_id", "depth"], "ends")
    return nodes.join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest()))).drop("sha256")
