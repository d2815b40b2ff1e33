"""Reconciliation runs on profiles, one for all rows of the same fields, and gives what its steps give on the rows."""

from pyspark.sql import functions as F

from tidemark.operators import reconcile
from tidemark.plans import queries
from tidemark.plans.views import messy

MADE = ["client_normalized", "point_name", "address_normalized", "address_city", "point_flags", "point_key"]


def many(spark, sf):
    """Rows of which each stands three times, with white space, missing text and a column of their own."""
    copies = messy(spark, sf).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rows = copies.withColumn("ingest_seq", F.col("ingest_seq") * 3 + F.col("copy")).withColumn("own", F.col("ingest_seq") + 1)
    rows = rows.withColumn("client_normalized", F.when((F.col("copy") == 1) & (F.col("client_normalized") != ""), F.concat("client_normalized", F.lit("\n"))).otherwise(F.col("client_normalized")))
    return rows.withColumn("point_name", F.when(F.col("point_name") != "", F.col("point_name"))).drop("copy")


def test_profiles_give_what_rows_give(spark, sf):
    rows = many(spark, sf)
    plain = reconcile.prepared(rows)
    for _, step in reconcile.steps(queries.QUALIFIERS, "DEFAULT"):
        plain = reconcile.settled(step(plain))
    found, report = reconcile.reconcile_with_report(rows, queries.QUALIFIERS, "DEFAULT")
    assert found.columns == [*rows.columns, "point_flags", "point_key"]
    facts = lambda d: sorted(map(tuple, d.select("ingest_seq", "own", *MADE).collect()))
    assert facts(found) == facts(plain)
    counted = {tuple(r) for r in reconcile.change_counts(rows, queries.QUALIFIERS, "DEFAULT").collect()}
    assert counted == {tuple(r) for r in reconcile.report_counts(report).collect()}


def test_steps_see_each_profile_once(spark, sf, monkeypatch):
    rows, seen = many(spark, sf), []

    def steps(*_):
        return [("seen", lambda d: seen.append(d.count()) or d), ("point_keys", reconcile.add_point_key)]

    monkeypatch.setattr(reconcile, "steps", steps)
    assert reconcile.reconcile(rows, {}).count() == rows.count()
    assert seen == [rows.select(*reconcile.FIELDS).distinct().count()] and seen[0] < rows.count()


def test_trimmed_is_clean(spark):
    texts = ["a", " a", "a \n", "a \u0085", "a  ", "\u0085", "", " ", "a ", " a b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(reconcile.trimmed(F.col("t")), reconcile.clean(F.col("t"))).collect()
    assert all(a == b for a, b in got)


def test_a_name_in_another_needs_no_score(spark, monkeypatch):
    names = spark.createDataFrame([("h", n) for n in ("Альфа 12", "АЛЬФА 12", "Альфа")], "fp string, name string")

    def fails(*_):
        return F.raise_error(F.lit("scored")).cast("int")

    monkeypatch.setattr(reconcile, "token_set_udf", fails)
    assert {(r.a, r.b) for r in reconcile.similar_names(names, 85).collect()} == {("АЛЬФА 12", "Альфа 12"), ("АЛЬФА 12", "Альфа"), ("Альфа", "Альфа 12")}
