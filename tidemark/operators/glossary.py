"""Glossary terms for a whole column of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.similarity import token_sort_udf
from tidemark.functions.text import clean, sorted_words
from tidemark.sources.store import Glossary

#: A name that holds the text, or is held by it, scores this at least.
HELD_SCORE = 85


def held_in(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def lookup(rows: DataFrame, glossary: Glossary, text: str, top_k: int = 5, min_score: int = 50) -> DataFrame:
    """For each distinct text that isn't blank, the ``top_k`` terms nearest to it: the text, rank (from 1), term, score.

    As ``Glossary.lookup`` for one text: a term counts by its best name, ties go to the earlier term. The glossary is a closed list that a
    person writes, so it is an array literal that each distinct text is exploded against; names whose lengths alone keep them under
    ``min_score`` are dropped before they are scored. A text meets no more rows than the glossary has names.
    """
    names = [(i, t.term, n.lower()) for i, t in enumerate(glossary.terms.values()) for n in (t.term, *t.aliases)]
    out = rows.select(F.col(text).alias("text_")).filter(clean(F.col("text_")) != "").distinct()
    if not names:
        return out.select(F.col("text_").alias(text), F.lit(0).alias("rank"), F.lit("").alias("term"), F.lit(0).alias("score")).limit(0)
    listed = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(term).alias("term"), F.lit(name).alias("name")) for i, term, name in names])
    each = out.select("text_", F.lower(clean(F.col("text_"))).alias("q"), F.explode(listed).alias("n")).select("text_", "q", "n.*")
    a, b = F.length(sorted_words(F.col("q"))), F.length(sorted_words(F.col("name")))
    near = each.withColumn("held", held_in(F.col("q"), F.col("name"))).filter(F.col("held") | (200 * F.least(a, b) >= (min_score - 1) * (a + b)))
    scored = near.withColumn("own", token_sort_udf("q", "name"))
    scored = scored.withColumn("score", F.when(F.col("held"), F.greatest("own", F.lit(HELD_SCORE))).otherwise(F.col("own"))).filter(F.col("score") >= min_score)
    best = scored.groupBy("text_", "ord", "term").agg(F.max("score").alias("score"))
    ranked = best.groupBy("text_").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord", "term", "score"))), 1, top_k).alias("best"))
    return ranked.select("text_", F.posexplode("best").alias("at", "b")).select(F.col("text_").alias(text), (F.col("at") + 1).alias("rank"), "b.term", "b.score")
