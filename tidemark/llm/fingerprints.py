"""I-Match document fingerprints over randomised lexicon subsets (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import bind, block_of, cut_lineage, cut_points, shuffle_partitions

#: A subset draws its terms by one byte of their hash; within it, four densities: every 4th, 16th, 64th and 256th term.
SUBSETS, DENSITIES = 8, (4, 16, 64, 256)
#: The densest level is for texts of at most this many distinct terms only: the others' terms outside 1 in 16 are not shuffled.
SHORT = 64
#: A cell of the fingerprint whose subset has no term of the document, or whose level is not for its text.
EMPTY = "-"
#: A lexicon of more terms than this is joined by a shuffle instead of a broadcast (16 bytes a term).
BROADCAST_TERMS = 2_000_000


def terms(text: Column) -> Column:
    """The distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def distinct_texts(docs: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """One row of each text, and how many they are. Only texts that repeat are shuffled, folded before that in each task."""
    rows = docs.select(F.xxhash64(text_col).alias("h"), text_col)
    held = rows.groupBy("h").agg(F.count("*").alias("c"))
    repeated = cut_lineage(held.filter("c > 1").select("h", "c"))
    k, copies = repeated.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    known = repeated.select("h")
    if k <= BROADCAST_TERMS:
        known = F.broadcast(known)
    once = rows.join(known, "h", "left_anti").select(text_col)
    return once.unionByName(rows.join(known, "h", "left_semi").dropDuplicates(["h"]).select(text_col)), docs.count() - copies + k


def lexicon(docs: DataFrame, low: float = 0.002, high: float = 0.1, text_col: str = "text", fold: bool = False) -> tuple[DataFrame, int]:
    """Hashes of the terms that between ``low`` and ``high`` of all documents hold (two at least), and how many they are.

    With ``fold`` copies of a text count once, so that they neither push its terms out of the band nor lift them into it.

    The band is one of inverse document frequency, from -ln(high) to -ln(low). A document of d distinct terms on average
    allows d / low terms in it however many documents there are, which bounds the lexicon.
    """
    docs, n = distinct_texts(docs, text_col) if fold else (docs, docs.count())
    held = docs.select(F.explode(terms(F.col(text_col))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    found = cut_lineage(held.filter((F.col("df") >= max(2, n * low)) & (F.col("df") <= max(2, n * high))).select(F.xxhash64("t").alias("h")).distinct())
    return found, found.count()


def field(h: Column, k: int) -> Column:
    return F.shiftrightunsigned(h, 8 * k).bitwiseAND(F.lit(255))


def drawn(k: int, density: int) -> Callable[[Column], Column]:
    """Whether a term of this hash belongs to the k-th subset at the density."""
    return lambda h: field(h, k).bitwiseAND(F.lit(density - 1)) == 0


def cells(hashes: Column, short: Column) -> Column:
    """For each subset and density the hash of the sorted terms that fall into it; the densest level for short texts only."""
    none = F.xxhash64(F.array().cast("array<bigint>"))
    rarer = [lambda h, k, d=d: F.call_function("shiftrightunsigned", h, k * 8).bitwiseAND(F.lit(d - 1)) == 0 for d in DENSITIES]

    def levels(a: Column, k: Column) -> Column:
        return F.array(F.when(short, F.xxhash64(a)).otherwise(none), *[F.xxhash64(kept(a, k, r)) for r in rarer[1:]])

    def subset(own: Column) -> Callable[[Column], Column]:
        return lambda k: bind(F.filter(own, lambda h: rarer[0](h, k)), lambda a: levels(a, k))

    def kept(a: Column, k: Column, test: Callable) -> Column:
        return F.filter(a, lambda h: test(h, k))

    found = bind(F.array_sort(hashes), lambda own: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), subset(own))))
    return F.transform(found, lambda x: F.when(x == none, F.lit(EMPTY)).otherwise(F.lower(F.substring(F.lpad(F.hex(x), 16, "0"), 1, 8))))


def fingerprint(rows: DataFrame, words: DataFrame, n_words: int, key: str, text_cols: list[str]) -> DataFrame:
    """key and, for each text column, ``<column>_cells``: the hashes of its terms in each lexicon subset.

    Texts without any drawn term get one hash of the whole text in all cells. Needs ``key`` to be unique.
    """
    if n_words <= BROADCAST_TERMS:
        words = F.broadcast(words)
    version = F.explode(F.array(*[F.struct(F.lit(i).alias("v"), F.col(c).alias("x")) for i, c in enumerate(text_cols)]))
    held = rows.select(key, version.alias("s")).select(key, "s.v", terms(F.col("s.x")).alias("ts")).withColumn("short", F.size("ts") <= SHORT)
    each = held.select(key, "v", "short", F.explode("ts").alias("t")).select(key, "v", "short", F.xxhash64("t").alias("h"))
    wanted = F.col("short")
    for k in range(SUBSETS):
        wanted = wanted | drawn(k, DENSITIES[1])(F.col("h"))
    sides = []
    for i, c in enumerate(text_cols):
        own = F.col("v") == i
        sides += [F.collect_set(F.when(own, F.col("h"))).alias(f"{c}_cells"), F.bool_or(own & F.col("short")).alias(f"{c}_short")]
    picked = each.filter(wanted).join(words, "h").groupBy(key).agg(*sides)
    return picked.select(key, *[cells(F.col(f"{c}_cells"), F.col(f"{c}_short")).alias(f"{c}_cells") for c in text_cols])


def likeness(a: Column, b: Column) -> Column:
    """1 for equal cells; else the greatest share, over the densities, of equal cells among one more than either fills.

    Dense subsets tell apart short texts and sparse ones long texts: the density that suits the pair counts.
    """
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))

    def share(level: int) -> Column:
        own = F.filter(pairs, lambda p, i: ((p["x"] != EMPTY) | (p["y"] != EMPTY)) & (i % len(DENSITIES) == level))
        return bind(own, lambda o: F.size(F.filter(o, lambda p: p["x"] == p["y"])) / (F.size(o) + 1))

    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(*[share(i) for i in range(len(DENSITIES))]))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty), next_text, at and next_at: each row beside the one that follows in id order, the last beside the first.

    One shuffle of the texts: rows go to blocks of the id order, and the first row of a block also goes, as a guest, to the
    block before it. ``at`` numbers rows inside their block. Null ids come first; equal ids are ordered by text.
    """
    cuts, least, nulls = cut_points(docs, id_col, 8 * shuffle_partitions(docs.sparkSession))
    last = len(cuts)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), block_of(F.col(id_col), cuts).alias("b"))
    first = F.when(F.col("b") == 0, F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)).otherwise(F.col("doc_id") == F.get(F.split(F.lit(",".join(map(str, cuts)) or "0"), ",").cast("array<bigint>"), F.col("b") - 1))
    home = F.struct(F.col("b").alias("block"), F.lit(0).alias("guest"))
    away = F.struct(F.when(F.col("b") == 0, F.lit(last)).otherwise(F.col("b") - 1).alias("block"), F.lit(1).alias("guest"))
    dealt = rows.withColumn("p", F.explode(F.when(F.coalesce(first, F.lit(False)), F.array(home, away)).otherwise(F.array(home)))).select("doc_id", "text", "p.block", "p.guest")
    order = Window.partitionBy("block").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    seen = dealt.select("*", F.lead("text").over(order).alias("next_text"), F.lead("guest").over(order).alias("next_guest"), F.row_number().over(order).alias("nth")).filter("guest = 0")
    at = lambda block, nth: block.cast("long") * (1 << 40) + nth
    after = F.when(F.col("next_guest") == 1, at(F.when(F.col("block") == last, F.lit(0)).otherwise(F.col("block") + 1), F.lit(1))).otherwise(at(F.col("block"), F.col("nth") + 1))
    return seen.select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"), at(F.col("block"), F.col("nth")).alias("at"), after.alias("next_at"))


def fingerprint_edits(docs: DataFrame, low: float = 0.002, high: float = 0.1, id_col: str = "doc_id", text_col: str = "text", fold: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text ends, for its last quarter, in the start of the next document in id order. Null texts are empty ones;
    a single row is its own next. Equal texts have equal fingerprints. Ids are numbers; rows that share one, missing ones
    among them, lie in one block, which one task orders with their texts, spilling what it can't hold. Repeated rows each have a row; very long texts
    are read whole; other columns, whatever their names, are not read. An empty table gives none.
    """
    words, n_words = lexicon(docs, low, high, text_col, fold)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    pairs = with_next(docs, id_col, text_col).withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.substring(F.col("next_text"), F.lit(1), quarter)))
    marks = fingerprint(pairs, words, n_words, "at", ["text", "edited"])
    facts = pairs.select("at", "next_at", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("tx"), F.xxhash64("edited").alias("ex"))
    whole = lambda c, x: F.when(c.isNull() | ~F.exists(c, lambda v: v != EMPTY), F.array_repeat(F.lower(F.substring(F.lpad(F.hex(x), 16, "0"), 1, 8)), SUBSETS * len(DENSITIES))).otherwise(c)
    found = cut_lineage(facts.join(marks, "at", "left").select("at", "next_at", "doc_id", "n_chars", "edited_sha256", whole(F.col("text_cells"), F.col("tx")).alias("a"), whole(F.col("edited_cells"), F.col("ex")).alias("e")))
    after = found.select(F.col("at").alias("next_at"), F.col("a").alias("b"))
    return found.join(after, "next_at", "left").select(
        "doc_id", "n_chars", "edited_sha256", F.concat_ws(".", "a").alias("fingerprint"), F.concat_ws(".", "e").alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("b")).alias("near_next")
    )
