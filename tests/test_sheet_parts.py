"""A large sheet is written and read by many tasks."""

from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.sources import sheets
from tidemark.streaming import refresh


def grid(spark, n, mark):
    """A sheet of n rows with gaps and broken lines in cells, and a small one that begins below its first row."""
    k = F.col("id").cast("int")
    wide = F.concat(F.lit(mark), *[F.sha2(F.concat(k.cast("string"), F.lit(f" {i}")), 256) for i in range(40)])
    cells = F.when(k == 0, F.array(*map(F.lit, ["Номер", "Дата", "Контрагент"]))).otherwise(F.array(k.cast("string"), F.lit("03.02.2024"), F.concat(F.lit('a "b",\n'), wide)))
    large = spark.range(n).select(F.lit("book").alias("_table_name"), F.lit("large").alias("_sheet_name"), F.when(k == 0, 0).otherwise(k * 2 + 3).alias("row_idx"), cells.alias("cells"))
    return large.unionByName(spark.createDataFrame([("book", "small", 2, ["x", None])], "_table_name string, _sheet_name string, row_idx int, cells array<string>"))


def test_a_large_sheet_is_the_work_of_many_tasks(spark, tmp_path):
    folder, table, seen = f"{tmp_path}/in", sheets.Tickets(spark, f"{tmp_path}/t"), f"{tmp_path}/seen"
    for n, mark in ((4000, "one"), (5000, "two"), (6000, "three")):
        assert sheets.write_sheets(grid(spark, n, mark), folder) == 2
        found = sheets.read_grid(spark, folder)
        assert found.rdd.getNumPartitions() > 2
        got = {(r._sheet_name, r.row_idx): r.cells for r in found.filter("error is null").collect()}
        want = {(r._sheet_name, r.row_idx): [c or "" for c in r.cells] for r in grid(spark, n, mark).collect()}
        blank = {("large", i): [] for i in range(2 * n + 2)} | {("small", i): [] for i in range(3)}
        assert got == blank | want and found.filter("error is not null").count() == 0
        head = sheets.read_grid(spark, folder, [{"table_name": "book", "sheet_name": "large"}], ingest.HEADER_ROWS)
        assert head.rdd.getNumPartitions() == 1 and [r.row_idx for r in head.orderBy("row_idx").collect()] == list(range(ingest.HEADER_ROWS))
        refresh.refresh(spark, folder, table, seen)
        assert table.all().count() == n - 1 and {r[0] for r in table.all().select("_sheet_name").distinct().collect()} == {"large"}
    # What the last but one write left is gone, and a small sheet takes the place of a large one.
    assert len(list((tmp_path / "in" / "book" / "large.parts").glob("*.part"))) < 3 * spark.sparkContext.defaultParallelism
    sheets.write_sheets(grid(spark, 3, "few"), folder)
    assert not (tmp_path / "in" / "book" / "large.sheet").exists() and not list((tmp_path / "in" / "book" / "large.parts").iterdir())
    refresh.refresh(spark, folder, table, seen)
    assert table.all().count() == 2
    sheets.remove_sheet(folder, "book", "large")
    refresh.refresh(spark, folder, table, seen)
    assert table.all().count() == 0
