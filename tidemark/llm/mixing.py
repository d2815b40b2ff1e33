"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import cut_lineage, own_names

#: Means above this are drawn as a sum of independent Poisson counts, so that exp(-mean) stays a normal number.
CHUNK_MEAN = 64.0
#: Sources beyond this many are joined by a shuffle instead of a broadcast (up to 180 doubles each), and so are keys of
#: repeated rows (a long each).
BROADCAST_SOURCES, BROADCAST_REPEATED = 10_000, 500_000


def uniform(seed: int, row: Column, chunk: Column) -> Column:
    """A number in (0, 1) that only the seed, the row's own text (see ``row_text``) and the chunk decide."""
    text = F.concat_ws(":", F.lit(str(seed)), row, chunk.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def row_text(doc_id: Column, text: Column) -> Column:
    """What a row draws by: its id (missing: empty) and the hash of its text (missing: empty)."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit("")))


def numbered_repeats(docs: DataFrame, row: str, text: Column, doc_id: Column) -> DataFrame:
    """With the column ``row``: what each row draws by; rows that share id and text have their place in the input in it too."""
    key, place, repeated = own_names(docs, "tm_key", "tm_place", "tm_repeated")
    own = row_text(doc_id, text)
    many = cut_lineage(docs.groupBy(F.xxhash64(own).alias(key)).agg(F.count("*").alias("c")).filter("c > 1").select(key))
    n = many.count()
    if not n:
        return docs.withColumn(row, own)
    many = many.withColumn(repeated, F.lit(True))
    placed = docs.withColumns({row: own, place: F.monotonically_increasing_id()}).withColumn(key, F.xxhash64(row))
    joined = placed.join(F.broadcast(many) if n <= BROADCAST_REPEATED else many, key, "left")
    return joined.withColumn(row, F.concat_ws(":", row, F.when(F.col(repeated), F.col(place).cast("string")))).select(*docs.columns, row)


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: float | None = None, source_col: str = "source") -> tuple[DataFrame, int]:
    """One row per source: its mean repetition rate, the chunks it is drawn in and their distribution function."""
    counts = cut_lineage(docs.groupBy(F.col(source_col).alias("tm_source")).agg(F.count("*").alias("tm_n")))
    if weights is None:
        weight = F.pow("tm_n", F.lit(float(alpha)))
    else:
        weight = F.lit(0.0)
        for source, value in weights.items():
            if value < 0:
                raise ValueError("a weight is negative")
            weight = F.when(F.col("tm_source").eqNullSafe(F.lit(source)), float(value)).otherwise(weight)
    counts = counts.withColumn("tm_w", weight)
    whole = counts.agg(F.sum("tm_n").alias("n"), F.sum("tm_w").alias("w"), F.count("*").alias("sources")).first()
    target, all_weight = float(whole["n"] or 0 if total is None else total), float(whole["w"] or 0) or 1.0
    rates = counts.withColumn("tm_mean", F.lit(target) * F.col("tm_w") / F.lit(all_weight) / F.col("tm_n"))
    rates = rates.withColumn("tm_chunks", F.greatest(F.lit(1), F.ceil(F.col("tm_mean") / CHUNK_MEAN).cast("int")))
    mean = F.col("tm_mean") / F.col("tm_chunks")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])
    return rates.select("tm_source", "tm_mean", "tm_chunks", cdf.alias("tm_cdf")), int(whole["sources"])


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: float | None = None, seed: int = 42, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", copy_col: str | None = "copy"
) -> DataFrame:
    """Every document as often as a Poisson count says whose mean brings its source to its target weight; in random order.

    ``weights``: source to weight (others get none); without it a source of n rows weighs ``n ** alpha``.
    ``total``: expected rows out, as many as come in by default. The count inverts the Poisson distribution at a number
    hashed from the seed, the id and the text, so a run can be repeated and a row needs no other row. Rows that share id
    and text, ids missing or not, draw each for itself, by their place in the input besides; for them a run repeats while the input is laid out alike.
    The copies are dealt over all tasks by a hash of the same and of the copy, and sorted by it there. Null sources are one
    source; null and empty texts are rows as any other; of a long text only the hash counts; columns of any other name pass
    as they are; an empty table gives none. ``copy_col`` counts copies from 1 (None: it is left out; a column of that name in the input is replaced).
    """
    rates, sources = repetition_rates(docs, weights, alpha, total, source_col)
    names = docs.columns
    row, drawn, count, copy, order, *own = own_names(docs, "tm_row", "tm_u", "tm_count", "tm_copy", "tm_order", "tm_source", "tm_mean", "tm_chunks", "tm_cdf")
    rates = rates.toDF(*own)
    source, _, chunks, cdf = own
    if sources <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    numbered = numbered_repeats(docs, row, F.col(text_col), F.col(id_col))
    joined = numbered.join(rates, F.col(source_col).eqNullSafe(F.col(source)), "inner")
    draws = F.aggregate(
        F.sequence(F.lit(1), F.col(chunks)),
        F.lit(0),
        lambda acc, j: acc + F.size(F.filter(cdf, lambda c: c < uniform(seed, F.col(row), j))),
    )
    # One chunk is the common case: there the number is hashed once for a row, not once for each step of the search.
    one = F.size(F.filter(cdf, lambda c: c < F.col(drawn)))
    counted = joined.withColumn(drawn, uniform(seed, F.col(row), F.lit(1))).withColumn(count, F.when(F.col(chunks) == 1, one).otherwise(draws))
    copies = counted.filter(F.col(count) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count))))
    copies = copies.withColumn(order, F.xxhash64(F.lit(seed), F.col(row), F.col(copy)))
    kept = [F.col(c) for c in names if c != copy_col] + ([F.col(copy).alias(copy_col)] if copy_col else [])
    return copies.repartition(order).sortWithinPartitions(order).select(*kept)
