"""Normalisation of distinct raw values through a stored mapping, a fuzzy layer and a provider."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.similarity import token_set_udf
from tidemark.functions.text import clean, compose_address, expand_point, has_marker, keep_known, score_words, strip_marker
from tidemark.operators.aggregates import mode_by
from tidemark.schema import UNASSIGNED
from tidemark.sources.shared import checked, shared_dir
from tidemark.sources.store import Mapping
from tidemark.sources.versions import Versions

CATEGORY_RATIO, BATCH = 90, 100
PAIR_FIELDS = ["client_normalized", "client_qualifier", "point_name", "city", "street", "house", "korpus", "apartment"]
#: A provider turns a batch of raw values (texts, or pairs of client and address) into a row (dict) for each; what it leaves
#: out is tried again in the next run. Fields of a pair come from its own texts alone, the city from the address alone; a
#: problem has a short phrase and one to three names of the closed list.
Provider = Callable[[list], dict]


def pair_key(client: Column, address: Column) -> Column:
    return F.lower(F.concat(clean(client), F.lit("||"), clean(address)))


def distinct_pairs(df: DataFrame) -> DataFrame:
    rows = df.select(clean(F.col("client_raw")).alias("client_raw"), clean(F.col("address_raw")).alias("address_raw"))
    return rows.filter("client_raw <> '' or address_raw <> ''").distinct().withColumn("key", pair_key(F.col("client_raw"), F.col("address_raw")))


def distinct_problems(df: DataFrame) -> DataFrame:
    return df.select(clean(F.col("problem_raw")).alias("problem_raw")).filter("problem_raw <> ''").distinct().withColumn("key", F.lower("problem_raw"))


def misses(keys: DataFrame, store: DataFrame) -> DataFrame:
    """Keys that the stored mapping lacks."""
    return keys.join(store.select("key"), "key", "left_anti")


def match_category(problems: DataFrame, categories: list[str], text: str = "problem_raw") -> DataFrame:
    """With ``category``: the best token-set score from 90 up, the longer name and then the earlier of equals; else null.

    The closed list is an array literal that each distinct text is exploded against; no join.
    """
    if not categories:
        return problems.withColumn("category", F.lit(None).cast("string"))
    names = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("name")) for i, c in enumerate(categories)])
    each = problems.select(text, F.explode(names).alias("c")).select(text, "c.*")
    # Where one side's words all stand in the other the score is 100, which needs no UDF.
    a, b = score_words(F.col(text)), score_words(F.col("name"))
    held = (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))
    whole = each.withColumn("held_", held)
    scored = whole.filter("held_").withColumn("score", F.lit(100)).unionByName(whole.filter("not held_").withColumn("score", token_set_udf(text, "name")))
    best = scored.filter(F.col("score") >= CATEGORY_RATIO).groupBy(text).agg(F.max_by("name", F.struct("score", F.length("name"), -F.col("ord"))).alias("category"))
    return problems.join(best, text, "left")


def retrying(provider: Provider, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Provider:
    """A provider that is asked again after an error, after twice the time each time; the last error goes on."""

    def ask_again(items: list) -> dict:
        for nth in range(tries):
            try:
                return provider(items)
            except Exception:  # noqa: BLE001  a remote model fails in many ways
                if nth + 1 == tries:
                    raise
                sleep(wait * 2**nth)
        return {}

    return ask_again


def ask(keys: DataFrame, raw: list[str], provider: Provider, schema: str, workers: int = 20, batch: int = BATCH, failures: Accumulator | None = None) -> DataFrame:
    """Rows that the provider gives for the values of the ``raw`` columns, in batches; at most ``workers`` tasks call it at a time.

    It gets the values as they were written, in key order, and never sees the key. Values that it fails on, and answers to values that it
    wasn't asked for, come out nowhere, so they are not stored and count as misses again. Of keys that repeat the least raw values are asked.
    ``failures`` counts batches that failed (again, if their task runs again).
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                items = part[raw[0]].tolist() if len(raw) == 1 else list(zip(*[part[c] for c in raw], strict=True))
                try:
                    found = provider(items)
                except Exception:  # noqa: BLE001  a provider's error costs its batch, not the run
                    if failures is not None:
                        failures.add(1)
                    continue
                yield pd.DataFrame([{"key": k, **found[x]} for k, x in zip(part["key"], items, strict=True) if x in found], columns=names)

    once = keys.groupBy("key").agg(F.min(F.struct(*raw)).alias("r")).select("key", "r.*")
    return once.repartition(workers).sortWithinPartitions("key").mapInPandas(run, schema)


def normalise_problems(problems: DataFrame, store: DataFrame, categories: list[str], provider: Provider, batch: int = BATCH, failures: Accumulator | None = None) -> DataFrame:
    """New mapping rows (key, normalized, tags): the fuzzy layer first, the provider for what it leaves."""
    # Texts that differ by case alone are one key.
    missing = match_category(misses(problems, store).groupBy("key").agg(F.min("problem_raw").alias("problem_raw")), categories)
    sure = missing.filter("category is not null").select("key", F.col("category").alias("normalized"), F.array("category").alias("tags"))
    left = missing.filter("category is null").select("key", "problem_raw")
    asked = ask(left, ["problem_raw"], provider, "key string, normalized string, tags array<string>", batch=batch, failures=failures).join(left, "key")
    phrase = F.when(clean(F.col("normalized")) == "", F.col("problem_raw")).otherwise(F.col("normalized"))
    return sure.unionByName(asked.select("key", phrase.alias("normalized"), keep_known(F.col("tags"), categories, UNASSIGNED).alias("tags")))


def normalise_pairs(pairs: DataFrame, store: DataFrame, provider: Provider, qualifiers: dict[str, str], brands: dict[str, str], default_brand: str, batch: int = BATCH, failures: Accumulator | None = None) -> DataFrame:
    """New mapping rows of client and address pairs: the provider extracts fields, the rest is deterministic."""
    asked = ask(misses(pairs, store), ["client_raw", "address_raw"], provider, "key string, " + ", ".join(f"{c} string" for c in PAIR_FIELDS), batch=batch, failures=failures)
    address = compose_address(*[F.col(c) for c in ("city", "street", "house", "korpus", "apartment")])
    return asked.select("key", clean(F.col("client_normalized")).alias("client_normalized"), clean(F.col("client_qualifier")).alias("client_qualifier"), expand_point(F.col("point_name"), qualifiers, brands, default_brand).alias("point_name"), address.alias("address_normalized"), clean(F.col("city")).alias("city"))


def store_in_slices(keys: DataFrame, mapping: Mapping, compute: Callable[[DataFrame, DataFrame], DataFrame], stop: Callable[[], bool] | None = None) -> int:
    """Add to ``mapping`` what ``compute`` (of keys and the stored mapping) gives for the keys that it lacks, a slice of them at a time; how many keys it lacks then.

    Keys are laid out once by the hash that the mapping is laid out by, so that each slice reads its own keys and its own part of the store.
    Each is stored before the next one begins: a run that fails or is stopped loses one slice, and the next run goes on from there.
    """
    spark = keys.sparkSession
    laid = Versions(spark, f"{shared_dir(spark)}/keys-{uuid.uuid4().hex}")
    keys.withColumn("slice", mapping.slice_of(F.col("key"))).write.partitionBy("slice").parquet(f"{laid.path}/all")
    left = 0
    try:
        for name in laid.entries("all"):
            if not name.startswith("slice="):
                continue
            checked(stop)
            part, own = int(name[6:]), spark.read.schema(keys.schema).parquet(f"{laid.path}/all/{name}")
            mapping.add(compute(own, mapping.read(part)), part)
            left += misses(own, mapping.read(part)).select("key").distinct().count()
    finally:
        laid.remove("")
    return left


def completed(keys: DataFrame, store: DataFrame, compute: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The stored mapping and, for keys that it lacks, what ``compute`` (asking for one value at a time) gives now; nothing is stored."""
    found = compute(keys, store)
    return store.select(*found.columns).unionByName(found)


def layer_statistics(problems: DataFrame, store: DataFrame, categories: list[str]) -> DataFrame:
    """One row: distinct texts, how many are stored, how many the fuzzy layer settles, and how many are left for the provider."""
    every = problems.groupBy("key").agg(F.min("problem_raw").alias("problem_raw")).join(store.select("key", F.lit(True).alias("held_")), "key", "left")
    scored = match_category(every, categories)
    new = F.col("held_").isNull()
    return scored.agg(F.count("*").alias("texts"), F.count_if(~new).alias("cache_hits"), F.count_if(new & F.col("category").isNotNull()).alias("layer1_matches"), F.count_if(new & F.col("category").isNull()).alias("asked"))


def unify_qualifiers(store: DataFrame) -> DataFrame:
    """The stored pairs with one spelling for each qualifier: the most frequent that has a legal form, where there is one."""
    own = clean(F.col("client_qualifier"))
    bare = F.translate(F.lower(clean(strip_marker(own))), "ё", "е")
    rows = store.withColumn("q_", own).withColumn("bare_", F.when(own != "", bare))
    best = mode_by(rows.filter(has_marker(F.col("q_"))).withColumn("s_", F.xxhash64("key")), ["bare_"], "q_", "s_", "best_")
    return rows.join(best, "bare_", "left").withColumn("client_qualifier", F.coalesce("best_", "client_qualifier")).select(*store.columns)


def apply_pairs(df: DataFrame, store: DataFrame) -> DataFrame:
    """Tickets with the normalised fields of their pair; pairs that aren't stored have empty ones."""
    held = store.select(F.col("key").alias("k_"), "client_normalized", "point_name", "address_normalized", F.col("city").alias("address_city"))
    joined = df.withColumn("k_", pair_key(F.col("client_raw"), F.col("address_raw"))).join(held, "k_", "left").drop("k_")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("client_normalized", "point_name", "address_normalized", "address_city")})


def apply_problems(df: DataFrame, store: DataFrame) -> DataFrame:
    held = store.select(F.col("key").alias("k_"), F.col("normalized").alias("problem_normalized"), F.col("tags").alias("problem_tags"))
    return df.withColumn("k_", F.lower(clean(F.col("problem_raw")))).join(held, "k_", "left").drop("k_").withColumn("problem_normalized", F.coalesce("problem_normalized", F.lit("")))
