"""From raw sheet grids to typed tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import dated_text, parse_date
from tidemark.functions.similarity import ratio_udf
from tidemark.functions.text import clean, ticket_number
from tidemark.operators.aggregates import keep_first
from tidemark.sources.shared import settled
from tidemark.sources.sheets import Tickets

# Header words and the columns they stand for.
HEADERS = [
    ("статус", "status"), ("дата", "date"), ("номер", "ticket_id"), ("группа события", "event_group"), ("вид события", "event_type"), ("контрагент", "client_raw"),
    ("точка", "address_raw"), ("торг точка", "address_raw"), ("описание", "problem_raw"), ("содержание", "comment"), ("ответственный", "assignee"), ("автор", "author"),
]
HEADER_ROWS, LEAST_MATCHES, LEAST_RATIO = 5, 2, 80
SHEET = ["_table_name", "_sheet_name"]


def header_cells(grid: DataFrame) -> DataFrame:
    """Cells of the first rows of each sheet beside every header word; a few rows for each sheet."""
    cells = grid.filter(F.col("row_idx") < HEADER_ROWS).select(*SHEET, "row_idx", F.posexplode("cells").alias("pos", "cell")).withColumn("cell", F.lower(clean(F.col("cell"))))
    # An array literal instead of a join with the twelve words.
    words = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(w).alias("word"), F.lit(t).alias("target")) for i, (w, t) in enumerate(HEADERS)])
    return cells.select("*", F.explode(words).alias("h")).select(*SHEET, "row_idx", "pos", "cell", "h.*")


def header_rows(grid: DataFrame) -> DataFrame:
    """The header row of each sheet: the first of the first five with two cells that hold or resemble a header word."""
    near = header_cells(grid).withColumn("score", ratio_udf("word", "cell"))
    hits = near.filter(F.contains("cell", "word") | (F.col("score") > LEAST_RATIO)).groupBy(*SHEET, "row_idx").agg(F.count_distinct("pos").alias("n"))
    return hits.filter(F.col("n") >= LEAST_MATCHES).groupBy(*SHEET).agg(F.min("row_idx").alias("header_row"))


def column_map(grid: DataFrame) -> DataFrame:
    """header_row and ``mapping`` (target to position) of each sheet that has a header."""
    heads = header_rows(grid)
    cells = header_cells(grid).join(heads, SHEET).filter("row_idx = header_row and cell <> ''").withColumn("score", ratio_udf("cell", "word"))
    best = cells.groupBy(*SHEET, "header_row", "pos").agg(F.max_by(F.struct("target", "score"), F.struct("score", -F.col("ord"))).alias("b")).filter(F.col("b.score") >= LEAST_RATIO)
    # Two headers of one target: the rightmost counts.
    places = best.groupBy(*SHEET, "header_row", F.col("b.target").alias("target")).agg(F.max("pos").alias("pos"))
    return places.groupBy(*SHEET, "header_row").agg(F.map_from_entries(F.collect_list(F.struct("target", "pos"))).alias("mapping"))


def readable(grid: DataFrame) -> DataFrame:
    return grid.filter("error is null") if "error" in grid.columns else grid


def numbered_sheets(grid: DataFrame) -> DataFrame:
    """``column_map`` of the first rows of sheets with ``sheet_no``: the sheet's place in the order of tables and sheets. One row for each sheet."""
    return column_map(readable(grid)).withColumn("sheet_no", F.row_number().over(Window.orderBy(*SHEET)).cast("long"))


def not_blank() -> Column:
    return F.exists("cells", lambda x: x.isNotNull() & (x != ""))


def rejected_sheets(grid: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(_table_name, _sheet_name, reason) of sheets that give no tickets: those that couldn't be read, with the error, and those without a header.

    A sheet that breaks off keeps the tickets before the break, and is listed.
    """
    none = readable(grid).select(*SHEET).distinct().join(column_map(readable(grid if heads is None else heads)).select(*SHEET), SHEET, "left_anti").withColumn("reason", F.lit("no header"))
    if "error" not in grid.columns:
        return none
    broken = grid.filter("error is not null").groupBy(*SHEET).agg(F.min("error").alias("reason"))
    return none.join(broken, SHEET, "left_anti").unionByName(broken)


def statistics(grid: DataFrame) -> DataFrame:
    """One row: tables, sheets, rejected sheets, rows below headers, blank ones of them, tickets, and how many of these repeat an id."""
    rows = readable(grid).join(numbered_sheets(grid), SHEET).filter("row_idx > header_row")
    read = rows.agg(
        F.count_distinct("_table_name").alias("tables"), F.count_distinct(*SHEET).alias("sheets"), F.count("*").alias("rows_below_headers"), F.count_if(~not_blank()).alias("rows_skipped"), F.count_if(not_blank()).alias("tickets")
    )
    ids = tickets(grid).filter(F.trim(F.coalesce("ticket_id", F.lit(""))) != "").groupBy("ticket_id").agg((F.count("*") - 1).alias("more"))
    again = ids.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("duplicates"))
    # Three tables of one row.
    return read.join(again, F.lit(True)).join(rejected_sheets(grid).agg(F.count("*").alias("sheets_rejected")), F.lit(True))


def tickets(grid: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Typed tickets of all sheets with a header, from the rows below it; blank rows and sheets without a header go.

    ``grid``: _table_name, _sheet_name, row_idx, cells and, from ``read_grid``, error (see ``rejected_sheets``). ingest_seq is the
    row's place in the order of tables, sheets and rows; it orders ties over all sheets. ``heads`` are the first HEADER_ROWS rows of each sheet, if
    the source can read these alone (``read_grid(..., rows=HEADER_ROWS)``): else they are filtered out of a second reading of the grid.
    """
    maps = numbered_sheets(grid if heads is None else heads)
    # As many rows as sheets. Without the hint Spark, which doesn't know its size beforehand, brings all rows of a sheet to one task.
    return typed(readable(grid).join(F.broadcast(maps), SHEET).filter("row_idx > header_row").filter(not_blank()))


def typed(rows: DataFrame) -> DataFrame:
    """Tickets of grid rows beside ``mapping`` and ``sheet_no`` of their sheet (see ``numbered_sheets``)."""

    def field(name: str) -> Column:
        return F.get("cells", F.col("mapping")[name])

    text = lambda name: F.when(field(name).isNotNull(), clean(field(name)))
    out = {name: text(name).alias(name) for name in ("status", "event_group", "event_type", "problem_raw", "assignee", "author", "comment")}
    out |= {name: clean(field(name)).alias(name) for name in ("client_raw", "address_raw")}
    out["ticket_id"] = F.when(F.col("mapping")["ticket_id"].isNotNull(), ticket_number(field("ticket_id"))).alias("ticket_id")
    out["date"] = field("date").alias("date")
    found = rows.select(*out.values(), *SHEET, parse_date(field("date")).alias("event_ts"), (F.shiftleft("sheet_no", 32) + F.col("row_idx")).alias("ingest_seq"))
    # Parsing costs most of a row; it is done once for both columns.
    return found.withColumn("date", dated_text(F.col("event_ts"), F.col("date")))


def stored(grid: DataFrame, table: Tickets, heads: DataFrame | None = None) -> dict[str, int]:
    """Write the tickets of all sheets, one of each id, to ``table``; the figures of ``statistics``, counted by the write itself.

    They are observed where rows pass on their way to the table, so nothing is read again for them; what the driver gets besides is the names of
    the sheets. Typed rows go to the shared folder first: rows with an id and rows without are then read from there, and the grid is typed once. Lost executors: rows of a stage that runs again after it had finished count again (the table holds them once).
    """
    maps = numbered_sheets(grid if heads is None else heads)
    errors = F.col("error").isNotNull() if "error" in grid.columns else F.lit(False)
    rows = grid.withColumn("broken_", errors).join(F.broadcast(maps), SHEET, "left")
    below = ~F.col("broken_") & F.coalesce(F.col("row_idx") > F.col("header_row"), F.lit(False))
    sheet, read, named, kept = F.struct(*SHEET), Observation(), Observation(), Observation()
    sets = {"held_": below, "lost_": F.col("broken_"), "bare_": ~F.col("broken_") & F.col("header_row").isNull()}
    rows = rows.observe(read, F.count_if(below).alias("rows_below_headers"), F.count_if(below & ~not_blank()).alias("rows_skipped"), *[F.collect_set(F.when(c, sheet)).alias(n) for n, c in sets.items()])
    has_id = F.count_if(F.trim(F.coalesce("ticket_id", F.lit(""))) != "").alias("n")
    all_ = settled(typed(rows.filter(below & not_blank())).observe(named, has_id, F.count("*").alias("tickets")))
    table.write(keep_first(all_, "ticket_id", ["ingest_seq"]).observe(kept, has_id))
    seen, before = read.get, named.get
    names = {n: {tuple(x) for x in seen[n]} for n in sets}
    return {
        "tables": len({t for t, _ in names["held_"]}), "sheets": len(names["held_"]), "rows_below_headers": seen["rows_below_headers"], "rows_skipped": seen["rows_skipped"],
        "tickets": before["tickets"], "duplicates": before["n"] - kept.get["n"], "sheets_rejected": len(names["lost_"] | names["bare_"]),
    }


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
