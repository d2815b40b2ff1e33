"""Deterministic entity resolution over the whole ticket table.

Each step derives a small table of decisions by aggregates and joins it back. Blank keys, the natural hot ones, become null
before a join and so meet nothing. Ties go to the least ingest_seq.

Steps take rows or profiles: a profile stands for all rows of the same four fields, with their number and their least and greatest
ingest_seq. ``reconcile`` runs them on profiles and touches the rows at its begin and end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.similarity import token_set_udf
from tidemark.functions.text import address_fingerprint, clean, leads_with_form, legal_forms, norm_key, null_if_blank, point_key, score_words, split_point, token_set
from tidemark.operators.aggregates import keep_first, mode_by
from tidemark.operators.components import components
from tidemark.schema import FLAG_FORM, FLAG_GUESSED, FLAG_SHARED, FLAG_TERRITORY
from tidemark.sources.shared import cut_lineage, settled, spread

MERGE_RATIO = 85
FIELDS = ["client_normalized", "point_name", "address_normalized", "address_city"]
#: Columns of profiles: rows of a profile, the greatest ingest_seq among them, the profile's number, and its values before a step.
ROWS, LAST, PROFILE, WAS = "rows_", "last_seq_", "profile_", "was_"
#: Keys of the address that profiles carry from step to step (see ``housed``); a step that changes addresses renews or drops them.
KEYS = ["fp_", "town_"]
#: Clients that are broadcast to find what is known of them; more are not looked for first.
FEW_CLIENTS = 200_000


def client() -> Column:
    return F.col("client_normalized")


def sign() -> Column:
    return F.col("point_name")


def address() -> Column:
    return F.col("address_normalized")


def town() -> Column:
    return F.col("address_city")


def trimmed(c: Column) -> Column:
    """``clean`` of text that isn't null; most has no white space at its ends, nor a line's end, and stays without a pattern."""
    return F.when(F.btrim(c, F.lit(" \t\n\x0b\f\r\u0085\u2028\u2029")) == c, c).otherwise(clean(c))


def prepared(df: DataFrame) -> DataFrame:
    """Missing text as empty, trimmed; an empty list of flags. A small file is spread over the cores: what follows computes much from each row."""
    rows = spread(df).withColumns({c: trimmed(F.coalesce(c, F.lit(""))) for c in FIELDS})
    return rows.withColumn("point_flags", F.array().cast("array<string>"))


def profiles(rows: DataFrame) -> DataFrame:
    """One row for all rows of the same fields; see ``ROWS``."""
    same = rows.groupBy(*FIELDS).agg(F.count("*").alias(ROWS), F.min("ingest_seq").alias("ingest_seq"), F.max("ingest_seq").alias(LAST))
    return settled(same.withColumn(PROFILE, F.monotonically_increasing_id()))


def row_count(df: DataFrame) -> Column:
    """How many rows a group has, also where it is of profiles."""
    return F.sum(ROWS) if ROWS in df.columns else F.count("*")


def last_seq(df: DataFrame) -> str:
    return LAST if LAST in df.columns else "ingest_seq"


def housed(df: DataFrame) -> DataFrame:
    """With fp_, the fingerprint of the address, and town_, the key of its city: both cost much and are worked out once for each address, unless the rows carry them."""
    if "fp_" in df.columns:
        return df
    place = ["address_normalized", "address_city"]
    known = settled(df.select(*place).distinct().withColumns({"fp_": address_fingerprint(address(), town()), "town_": norm_key(town())}))
    return df.join(known, place, "left")


def house() -> Column:
    """``known_house`` of rows that are ``housed``."""
    return F.concat("town_", F.lit("|"), null_if_blank(F.col("fp_")))


def identity() -> Column:
    return F.when(client() != "", client()).otherwise(sign())


def one_value(column: str) -> list[Column]:
    """Least and greatest, lo_ and hi_: equal where all rows have one value. Unlike a count of distinct values, one pass without copies of the rows."""
    return [F.min(column).alias(f"lo_{column}"), F.max(column).alias(f"hi_{column}")]


def flagged(when: Column, flag: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)) & ~F.array_contains("point_flags", flag), F.array_append("point_flags", flag)).otherwise(F.col("point_flags"))


def common_share(threshold: int) -> float:
    """The least share of a name's characters that it has in common with one that scores ``threshold``, or that words shared by both make up."""
    t = (threshold - 0.5) / 100
    return t / (2 - t)


def rarest(rows: DataFrame, keys: list[str], token: str, most: Column) -> DataFrame:
    """The ``most`` tokens of each name that the fewest names of its house have."""
    spread_ = rows.groupBy("fp", token).agg(F.count("*").alias("df_"))
    order = Window.partitionBy(*keys).orderBy("df_", token)
    return rows.join(spread_, ["fp", token]).withColumn("r_", F.row_number().over(order)).filter(F.col("r_") <= most).drop("r_", "df_")


def similar_names(names: DataFrame, threshold: int) -> DataFrame:
    """(fp, a, b), a < b: names of one house that score ``threshold`` and are safe to merge. ``names``: distinct (fp, name).

    Of names that may merge one has no long word of its own (see ``safe_to_merge``), so its rarest long word stands in the other, too:
    names meet by that one word, of about the same length. Names without a long word meet others by characters: two that score
    share so many (see ``common_share``) that one of the rarest few of the one, as many as it may lack and one more, is among the other's.
    """
    share = common_share(threshold)
    name = F.col("name")
    facts = names.withColumns({"forms": legal_forms(name), "words": F.filter(token_set(name), lambda w: F.length(w) >= 4), "n": F.length(name)})
    facts = spread(cut_lineage(facts))
    side = F.struct("name", "forms", "words", "n")
    longs = facts.select("fp", side.alias("y"), F.explode("words").alias("w"))
    one = rarest(longs.select("fp", F.col("y").alias("x"), "w"), ["fp", "x"], "w", F.lit(1))
    like = lambda x, y: F.least(x["n"], y["n"]) / F.greatest(x["n"], y["n"]) >= 0.5
    x, y = F.col("x"), F.col("y")
    held = F.size(F.array_except(x["words"], y["words"])) == 0
    pairs = one.join(longs, ["fp", "w"]).filter(like(x, y) & held).select("fp", "x", "y")
    bare = facts.filter("size(words) = 0")
    if not bare.isEmpty():
        pairs = pairs.unionByName(by_characters(facts.join(bare.select("fp").distinct(), "fp"), side, share).filter(like(x, y)))
    safe = ~((F.size(x["forms"]) > 0) & (F.size(y["forms"]) > 0) & (x["forms"] != y["forms"]))
    # The native tests come first, the UDF sees what they leave.
    near = pairs.filter((x["name"] != y["name"]) & safe).select("fp", F.least("x.name", "y.name").alias("a"), F.greatest("x.name", "y.name").alias("b")).distinct()
    near = settled(near.withColumn("whole", holds_all(F.col("a"), F.col("b"))))
    scored = near.filter("not whole").withColumn("score", token_set_udf("a", "b")).filter(F.col("score") >= threshold)
    return near.filter(F.col("whole") & F.lit(threshold <= 100)).select("fp", "a", "b").unionByName(scored.select("fp", "a", "b"))


def holds_all(a: Column, b: Column) -> Column:
    """Whether all words of one name stand in the other, which scores 100. False where the alphabets are others than Latin without accents and Cyrillic: there the score decides."""
    plain, x, y = "^[\\x00-\\x7f\u0400-\u04ff]*$", score_words(a), score_words(b)
    held = ((F.size(x) > 0) & (F.size(F.array_except(x, y)) == 0)) | ((F.size(y) > 0) & (F.size(F.array_except(y, x)) == 0))
    return a.rlike(plain) & b.rlike(plain) & held


def by_characters(facts: DataFrame, side: Column, share: float) -> DataFrame:
    """(fp, x, y): names without long words beside those of their house that one of their rarest characters, or of the other's, leads to."""
    letters = F.array_sort(F.split(F.array_join(F.array_sort(score_words(F.col("name"))), " "), ""))
    # The nth one of a character is a token of its own.
    tokens = F.transform(letters, lambda c, i: F.concat(c, (i + 1 - F.array_position(letters, c)).cast("string")))
    each = cut_lineage(facts.select("fp", side.alias("y"), F.size(letters).alias("k"), F.explode(F.filter(tokens, lambda c: c != "")).alias("c")))
    may_lack = F.col("k") - F.ceil(F.col("k") * share - 1e-9) + 1
    few = rarest(each, ["fp", "y"], "c", may_lack)
    short, other = each.filter("size(y.words) = 0"), F.col("y").alias("x")
    return few.filter("size(y.words) = 0").select("fp", "c", other).join(each, ["fp", "c"]).select("fp", "x", "y").unionByName(short.select("fp", "c", other).join(few, ["fp", "c"]).select("fp", "x", "y"))


def client_renames(df: DataFrame, threshold: int = MERGE_RATIO) -> DataFrame:
    """(name, canonical): names at one house that are similar and safe to merge become the fullest with a leading legal form."""
    names = housed(df).select(F.col("fp_").alias("fp"), client().alias("name")).filter("fp <> '' and name <> ''").distinct()
    edges = similar_names(names, threshold)
    node = lambda c: F.struct("fp", F.col(c).alias("name"))
    stars = components(edges.select(node("a").alias("a"), node("b").alias("b")))
    grouped = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()).select("root", "node.fp", "node.name")
    # The fullest with a form in front, the first in order of equals: the least of these.
    best = F.min(F.struct((~leads_with_form(F.col("name"))).alias("bare"), (-F.length("name")).alias("n"), "name"))["name"]
    renames = grouped.join(grouped.groupBy("root").agg(best.alias("canonical")), "root").filter("name <> canonical")
    return renames.groupBy("name").agg(F.max_by("canonical", "fp").alias("canonical"))


def merge_clients(df: DataFrame, threshold: int = MERGE_RATIO) -> DataFrame:
    renames = settled(client_renames(df, threshold).withColumnRenamed("name", "client_normalized"))
    return df.join(renames, "client_normalized", "left").withColumn("client_normalized", F.coalesce("canonical", "client_normalized")).select(*df.columns)


def swap_roles(df: DataFrame) -> DataFrame:
    """A sign with one owner that is a client elsewhere is that owner: the more frequent of both names stays, the sign on ties."""
    names = settled(spelt(df, "client_normalized").withColumn("ck_", norm_key(client())))
    freq = names.groupBy("ck_").agg(F.sum("n_").alias("n"))
    both = df.filter((client() != "") & (sign() != "")).withColumn("ck_", norm_key(client()))
    signs = both.groupBy("point_name").agg(*one_value("ck_"), F.max_by(client(), last_seq(df)).alias("owner")).filter("lo_ck_ = hi_ck_")
    pairs = signs.select(F.col("point_name").alias("sign"), norm_key(sign()).alias("sk"), "owner", norm_key(F.col("owner")).alias("ok")).filter("sk <> ok")
    fs, fo = freq.select(F.col("ck_").alias("sk"), F.col("n").alias("sn")), freq.select(F.col("ck_").alias("ok"), F.col("n").alias("on_"))
    sign_wins = F.col("sn") >= F.col("on_")
    decided = pairs.join(fs, "sk").join(fo, "ok").select(F.when(sign_wins, F.col("ok")).otherwise(F.col("sk")).alias("ck_"), F.when(sign_wins, F.col("sign")).otherwise(F.col("owner")).alias("winner"), "sign")
    decided = decided.groupBy("ck_").agg(F.max_by("winner", "sign").alias("winner"))
    moves = settled(names.filter("ck_ <> ''").join(decided, "ck_").filter(F.col("winner") != client()).select("client_normalized", "winner"))
    moved = F.col("winner").isNotNull()
    joined = df.join(moves, "client_normalized", "left").withColumn("point_name", F.when(moved & (sign() == ""), client()).otherwise(sign()))
    return joined.withColumn("client_normalized", F.coalesce("winner", client())).select(*df.columns)


def respelt(each: DataFrame, value: str) -> DataFrame:
    """Rows of ``each`` (k_, ``value``, n_, s_ and others) whose value isn't the most frequent one of k_, the first of equals, with that as best_."""
    best = each.groupBy("k_").agg(F.max_by(value, F.struct("n_", -F.col("s_"), value)).alias("best_"), *one_value(value)).filter(f"lo_{value} <> hi_{value}")
    return each.join(best.select("k_", "best_"), "k_").filter(F.col(value) != F.col("best_"))


def spelt(df: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` with their number and least ingest_seq."""
    return df.filter(F.col(column) != "").groupBy(column).agg(row_count(df).alias("n_"), F.min("ingest_seq").alias("s_"))


def put(df: DataFrame, column: str, best: DataFrame, by: list[str]) -> DataFrame:
    return df.join(best, by, "left").withColumn(column, F.coalesce("best_", column)).select(*df.columns)


def unify(df: DataFrame, column: str, key: Column) -> DataFrame:
    """``column`` in the most frequent spelling of its key, which is of the column alone; blank ones stay. Only values that change are joined."""
    return put(df, column, respellings(df, column, key), [column])


def respellings(df: DataFrame, column: str, key: Column) -> DataFrame:
    """(column, best_) of the values that aren't the most frequent spelling of their key."""
    each = spelt(df, column).withColumn("k_", key).filter("k_ <> ''")
    return settled(respelt(each, column).select(column, "best_"))


def one_spelling(df: DataFrame, best: DataFrame) -> DataFrame:
    """Cities as ``best`` has them (see ``respellings``), also where the address begins with one."""
    one = put(df.withColumn("old_", town()), "address_city", best, ["address_city"])
    swapped = F.when((F.col("old_") != town()) & F.startswith(address(), F.col("old_")), F.concat(town(), F.substring(address(), F.length("old_") + 1, F.length(address())))).otherwise(address())
    return one.withColumn("address_normalized", swapped).drop("old_")


def reconcile_addresses(df: DataFrame, default_city: str | None = None) -> DataFrame:
    """One spelling for each city, then cities for addresses with a digit and none.

    The ladder: the usual city of this client at this house, the client's only city, a known city among the words of the
    point's name, the default if one is given.
    """
    columns, bare = df.columns, [c for c in df.columns if c not in KEYS]
    best = respellings(df, "address_city", norm_key(town()))
    need = (town() == "") & (address() != "") & address().rlike(r"\d")
    carried = "fp_" in df.columns
    one = df.withColumn("need_", need) if carried and best.isEmpty() else settled(housed(one_spelling(df.select(*bare), best)).withColumn("need_", need))
    need = F.col("need_")
    asking = settled(one.filter(need).select("client_normalized").distinct())
    known = one.filter(town() != "")
    asked = known.join(F.broadcast(asking), "client_normalized", "left_semi") if asking.count() <= FEW_CLIENTS else known
    by_house = mode_by(asked, ["client_normalized", "fp_"], "address_city", out="house_city", n=row_count(df))
    by_client = asked.groupBy("client_normalized").agg(F.min("address_city").alias("client_city"), F.max("address_city").alias("hi_")).filter("client_city = hi_").drop("hi_")
    vocabulary = known.groupBy(F.col("town_").alias("word_")).agg(F.min("address_city").alias("name_city")).filter("word_ <> ''")
    # The first word of a sign that is a city: words of the rows in need meet the vocabulary by an equi-join.
    signs = one.filter(need).select("point_name").filter("point_name <> ''").distinct()
    words = signs.select("point_name", F.posexplode(F.split("point_name", r"\s+")).alias("pos", "w")).withColumn("word_", norm_key(F.col("w")))
    by_name = words.join(vocabulary, "word_").groupBy("point_name").agg(F.min_by("name_city", "pos").alias("name_city"))
    missing = one.filter(need).join(by_house, ["client_normalized", "fp_"], "left").join(by_client, "client_normalized", "left").join(by_name, "point_name", "left")
    city = F.coalesce("house_city", "client_city", "name_city", F.lit(default_city).cast("string"))
    filled = missing.withColumn("c_", city).withColumn("address_normalized", F.when(F.col("c_").isNotNull(), F.concat("c_", F.lit(", "), address())).otherwise(address())).withColumn("address_city", F.coalesce("c_", F.lit("")))
    filled = filled.select(*bare)
    return (housed(settled(filled)) if carried else filled).select(*columns).unionByName(one.filter(~need).select(*columns))


def backfill_identity(df: DataFrame) -> DataFrame:
    """Rows with an address alone get the one identity of their house, or city-blind of their fingerprint; flagged."""
    keyed = housed(df).withColumn("id_", identity()).withColumn("print_", F.when(address() != "", F.col("fp_"))).withColumn("house_", F.concat("town_", F.lit("|"), "print_"))
    # Keys are worked out once, here and in other steps that use them more than once.
    keyed = keyed if "fp_" in df.columns else settled(keyed)
    named = keyed.filter((F.col("id_") != "") & (address() != ""))
    # Only houses of one identity matter: there the least is the greatest.
    one = F.min("id_") == F.max("id_")
    stats = [F.when(one, 1).otherwise(2).alias("n"), F.min("id_").alias("owner"), F.bool_and(client() != "").alias("all_clients")]
    houses = named.groupBy("house_").agg(*stats)
    prints = named.groupBy("print_").agg(F.when(one, 1).otherwise(2).alias("fp_n"), F.min("id_").alias("fp_owner"), F.min_by("house_", "house_").alias("fp_house")).filter("fp_n = 1")
    prints = prints.join(houses.select(F.col("house_").alias("fp_house"), F.col("all_clients").alias("fp_clients")), "fp_house").select("print_", "fp_owner", "fp_clients")
    bare = (F.col("id_") == "") & (address() != "")
    joined = keyed.filter(bare).join(houses, "house_", "left").join(prints, "print_", "left")
    blind = F.col("n").isNull() & (town() == "")
    owner = F.when(F.col("n") == 1, F.col("owner")).when(blind, F.col("fp_owner"))
    as_client = F.when(F.col("n") == 1, F.col("all_clients")).otherwise(F.col("fp_clients"))
    fixed = joined.withColumn("o_", owner).withColumn("as_", as_client)
    fixed = fixed.withColumn("point_flags", flagged(F.col("o_").isNotNull(), FLAG_GUESSED)).withColumn("client_normalized", F.when(F.col("o_").isNotNull() & F.col("as_"), F.col("o_")).otherwise(client())).withColumn("point_name", F.when(F.col("o_").isNotNull() & ~F.col("as_"), F.col("o_")).otherwise(sign()))
    return fixed.select(*df.columns).unionByName(keyed.filter(~bare).select(*df.columns))


def fill_forms(df: DataFrame, qualifiers: dict[str, str]) -> DataFrame:
    """Where a house has one brand and one form, rows without the form get the usual full name; flagged."""
    if not qualifiers:
        return df
    parts = housed(df).withColumn("id_", identity()).withColumn("s_", split_point(F.col("id_"), qualifiers)).withColumn("house_", F.when(F.col("id_") != "", house()))
    parts = settled(parts.select(*df.columns, "id_", "house_", norm_key(F.col("s_.brand")).alias("brand_"), null_if_blank(F.col("s_.form")).alias("form_"), (F.col("s_.form") == "").alias("formless_")))
    eligible = parts.filter("house_ is not null")
    houses = eligible.groupBy("house_").agg(*one_value("brand_"), *one_value("form_")).filter("lo_brand_ = hi_brand_ and lo_form_ = hi_form_").select("house_")
    full = settled(mode_by(eligible.filter("form_ is not null"), ["house_"], "id_", out="full_", n=row_count(df)).join(houses, "house_"))
    joined = parts.join(full, "house_", "left").withColumn("fill_", F.col("full_").isNotNull() & F.col("formless_"))
    by_client = F.col("fill_") & (client() != "")
    joined = joined.withColumn("point_flags", flagged(F.col("fill_"), FLAG_FORM)).withColumn("c2_", F.when(by_client, F.col("full_")).otherwise(client())).withColumn("point_name", F.when(F.col("fill_") & (client() == ""), F.col("full_")).otherwise(sign()))
    return joined.withColumn("client_normalized", F.col("c2_")).select(*df.columns)


def reconcile_points(df: DataFrame) -> DataFrame:
    """Blank point names from the usual one of the client at the house, then one spelling for each name."""
    keyed = housed(df) if "fp_" in df.columns else settled(housed(df))
    usual = mode_by(keyed.filter((sign() != "") & (F.col("fp_") != "")), ["client_normalized", "fp_"], "point_name", out="usual_", n=row_count(df))
    filled = keyed.filter(sign() == "").join(usual, ["client_normalized", "fp_"], "left").withColumn("point_name", F.coalesce("usual_", F.lit("")))
    return unify(settled(filled.select(*df.columns).unionByName(keyed.filter(sign() != "").select(*df.columns))), "point_name", norm_key(sign()))


def canonicalise(df: DataFrame) -> DataFrame:
    """Clients and point names, pooled, in the most frequent spelling; then addresses of one identity, city and house."""
    names = ("client_normalized", "point_name")
    pooled = [spelt(df, c).select(F.col(c).alias("v"), "n_", "s_", *[F.lit(c == other).alias(f"in_{other}") for other in names]) for c in names]
    each = pooled[0].unionByName(pooled[1]).groupBy("v").agg(F.sum("n_").alias("n_"), F.min("s_").alias("s_"), *[F.bool_or(f"in_{c}").alias(f"in_{c}") for c in names])
    best = settled(respelt(each.withColumn("k_", norm_key(F.col("v"))).filter("k_ <> ''"), "v"))
    out = df
    for column in names:
        # Each column meets its own values: a few signs stay few, however many clients are spelt anew.
        out = put(out, column, settled(best.filter(f"in_{column}").select(F.col("v").alias(column), "best_")), [column])
    keyed = settled(housed(out).withColumn("h_", F.concat(norm_key(identity()), F.lit("|"), house())).select(*df.columns, "h_"))
    there = keyed.filter((address() != "") & F.col("h_").isNotNull())
    each = there.groupBy(F.col("h_").alias("k_"), "address_normalized").agg(row_count(df).alias("n_"), F.min("ingest_seq").alias("s_"))
    moved = settled(respelt(each, "address_normalized").select(F.col("k_").alias("h_"), "address_normalized", "best_"))
    return put(keyed, "address_normalized", moved, ["h_", "address_normalized"]).select(*[c for c in df.columns if c not in KEYS])


def add_point_key(df: DataFrame) -> DataFrame:
    return df.withColumn("point_key", point_key(identity(), address()))


def flag_shared(df: DataFrame, qualifiers: dict[str, str]) -> DataFrame:
    """Flags: one house and sign with several clients; one house, brand and form with several territories."""
    part = split_point(sign(), qualifiers)
    signs = df.select("point_name").distinct().withColumn("sign_", norm_key(sign())).withColumn("s_", part)
    signs = settled(signs.select("point_name", "sign_", norm_key(F.col("s_.brand")).alias("b"), F.col("s_.form").alias("f"), null_if_blank(F.col("s_.territory")).alias("t")))
    keyed = housed(df).withColumn("house_", F.when((address() != "") & (sign() != ""), house())).join(signs, "point_name", "left")
    keyed = settled(keyed.select(*df.columns, "house_", "sign_", "b", "f", "t"))
    there = keyed.filter("house_ is not null")
    shared = settled(there.filter(client() != "").groupBy("house_", "sign_").agg(*one_value("client_normalized")).filter("lo_client_normalized <> hi_client_normalized").select("house_", "sign_", F.lit(True).alias("shared_")))
    marks = there.groupBy("house_").agg(*one_value("b"), *one_value("f"), *one_value("t"))
    torn = settled(marks.filter("lo_b = hi_b and lo_f = hi_f and lo_t <> hi_t").select("house_", F.lit(bool(qualifiers)).alias("torn_")))
    joined = keyed.join(shared, ["house_", "sign_"], "left").join(torn, "house_", "left")
    return joined.withColumn("point_flags", flagged(F.col("shared_") & (client() != ""), FLAG_SHARED)).withColumn("point_flags", flagged(F.col("torn_"), FLAG_TERRITORY)).select(*df.columns)


def steps(qualifiers: dict[str, str], default_city: str | None) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The steps in their fixed order, by the names that the report uses."""
    return [
        ("client_merges", merge_clients),
        ("role_swaps", swap_roles),
        ("address_backfills", reconcile_addresses),
        ("identity_backfills", backfill_identity),
        ("default_cities", lambda d: reconcile_addresses(d, default_city)),
        ("form_fills", lambda d: fill_forms(d, qualifiers)),
        ("point_name_changes", reconcile_points),
        ("canonical", canonicalise),
        ("point_keys", add_point_key),
        ("alerts", lambda d: flag_shared(d, qualifiers)),
    ]


def values() -> Column:
    return F.array(*[F.col(c) for c in FIELDS], F.array_join("point_flags", ", "))


def changes(after: DataFrame, step: str) -> DataFrame:
    """(step, profile_, rows_, column, old, new) of every field of a profile that differs from what it ``was_``."""
    names = F.array(*[F.lit(c) for c in (*FIELDS, "point_flags")])
    each = F.filter(F.arrays_zip(names.alias("column"), F.col(WAS).alias("old"), values().alias("new")), lambda x: x["old"] != x["new"])
    return after.select(F.lit(step).alias("step"), PROFILE, ROWS, F.explode(each).alias("c")).select("step", PROFILE, ROWS, "c.column", "c.old", "c.new")


def stepped(same: DataFrame, qualifiers: dict[str, str], default_city: str | None, told: bool) -> tuple[DataFrame, DataFrame | None]:
    """Profiles after all steps in their fixed order and, if ``told``, their ``changes``; what each step gives is stored, as the next one reads it several times."""
    out, report = settled(housed(settled(prepared(same)))), None
    for name, step in steps(qualifiers, default_city):
        # What a step changes travels with its profiles: no join of before and after.
        out = step(out.withColumn(WAS, values()) if told else out)
        if name == "point_keys":
            continue
        out = settled(out)
        if told:
            found = changes(out, name)
            report = found if report is None else report.unionByName(found)
    return out, report


def held_rows(df: DataFrame) -> DataFrame:
    """The rows as they were read once, missing text as empty."""
    return settled(spread(df).withColumns({c: F.coalesce(c, F.lit("")) for c in FIELDS}))


def of_rows(rows: DataFrame, same: DataFrame, out: DataFrame) -> DataFrame:
    """Rows with what was made of their profiles. ``same``: profiles as ``rows`` has their fields, ``out``: after the steps."""
    made = [*FIELDS, "point_flags", "point_key"]
    new = same.select(PROFILE, *FIELDS).join(out.select(PROFILE, *[F.col(c).alias(f"new_{c}") for c in made]), PROFILE).drop(PROFILE)
    columns = [*rows.columns, *[c for c in made if c not in rows.columns]]
    return rows.join(new, FIELDS).select(*[F.col(f"new_{c}").alias(c) if c in made else F.col(c) for c in columns])


def reconcile(df: DataFrame, qualifiers: dict[str, str], default_city: str | None = None) -> DataFrame:
    """All steps in their fixed order, on profiles; the rows are read at the begin and joined at the end."""
    rows = held_rows(df)
    same = profiles(rows)
    return of_rows(rows, same, stepped(same, qualifiers, default_city, False)[0])


def reconcile_with_report(df: DataFrame, qualifiers: dict[str, str], default_city: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The reconciled rows, and (step, ingest_seq, column, old, new) of every change that a step made to them, worked out only when it is read.

    Needs ingest_seq to be unique.
    """
    rows = held_rows(df)
    same = profiles(rows)
    out, report = stepped(same, qualifiers, default_city, True)
    each = rows.select("ingest_seq", *FIELDS).join(same.select(PROFILE, *FIELDS), FIELDS).select("ingest_seq", PROFILE)
    return of_rows(rows, same, out), each.join(report, PROFILE).select("step", "ingest_seq", "column", "old", "new")


def change_counts(df: DataFrame, qualifiers: dict[str, str], default_city: str | None = None) -> DataFrame:
    """``report_counts`` of all changes, from profiles: the rows themselves are not joined."""
    return report_counts(stepped(profiles(held_rows(df)), qualifiers, default_city, True)[1])


def report_counts(report: DataFrame) -> DataFrame:
    """Changed values by step and column."""
    return report.groupBy("step", "column").agg(F.coalesce(row_count(report), F.lit(0)).alias("n"))


def flags_text(df: DataFrame) -> DataFrame:
    return df.withColumn("point_flags", F.array_join("point_flags", ", "))


def deduplicate(df: DataFrame) -> DataFrame:
    return keep_first(df, "ticket_id", ["ingest_seq"])
