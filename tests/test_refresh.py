"""Stored tables that are swapped in one step, sheets read in part, and refreshes of what changed."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.oracle import differences
from tidemark.operators import ingest
from tidemark.plans import queries, router, tools
from tidemark.plans.views import tickets
from tidemark.sources import sheets, store
from tidemark.sources.versions import Conflict, Versions
from tidemark.streaming import refresh

HEAD = "Номер,Дата,Контрагент\n"


def book(folder, **texts):
    (folder / "book").mkdir(parents=True, exist_ok=True)
    for name, text in texts.items():
        (folder / "book" / f"{name}.csv").write_text(HEAD + text, encoding="utf-8")


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", ["ingest_statistics", "rejected_sheets", "sheets_read_back", "incremental_refresh", "rewritten_table"])
def test_queries_match_sql(spark, sf, name):
    assert differences(spark, sf, name, queries.QUERIES[name], queries.SQL[name]) == ""


def test_a_crash_before_the_swap_leaves_table_and_catalogue(spark, sf, tmp_path, monkeypatch):
    table, kept = sheets.Tickets(spark, f"{tmp_path}/t"), sheets.Catalogue(spark, f"{tmp_path}/c")
    rows = tickets(spark, sf)
    table.write(rows)
    kept.save(table.catalogue())
    before, listed, entries = rows_of(table.all()), rows_of(table.catalogue()), kept.sheets()

    def crash(*_):
        raise OSError("no more")

    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", crash)
        for write in (lambda: table.write(rows.limit(3)), lambda: table.refresh(rows.limit(0), [("odd", "F")]), kept.clear):
            with pytest.raises(OSError):
                write()
    assert rows_of(table.all()) == before and rows_of(table.catalogue()) == listed and kept.sheets() == entries
    table.write(table.all().filter("_table_name = 'odd'"))
    assert 0 < len(rows_of(table.all())) < len(before) and {r[0] for r in table.catalogue().collect()} == {"odd"}


def test_old_versions_stay_for_their_readers(spark, tmp_path):
    table = sheets.Tickets(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.all()
    frame = lambda x: spark.createDataFrame([("a", x, None)], "_table_name string, _sheet_name string, event_ts timestamp_ntz")
    table.write(frame("007"))
    old = table.all()
    table.write(frame("x/y = 1%"))
    assert table.versions.sweep(3600) == [] and [r._sheet_name for r in old.collect()] == ["007"]
    assert len(table.versions.sweep(0)) == 1 and [r._sheet_name for r in table.all().collect()] == ["x/y = 1%"]
    table.refresh(frame("007"), [("a", "007")])
    assert sorted(r._sheet_name for r in table.all().collect()) == ["007", "x/y = 1%"] and table.versions.sweep(0) == []
    table.refresh(frame("none").limit(0), [("a", "007")])
    assert [r._sheet_name for r in table.all().collect()] == ["x/y = 1%"]
    table.write(frame("none").limit(0))
    assert table.all().count() == 0 and table.all().columns == old.columns


def test_of_two_writers_one_is_told(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    assert versions.read() == (0, {})
    versions.commit(0, {"x": "é"})
    with pytest.raises(Conflict):
        versions.commit(0, {"x": 2})
    assert versions.read() == (1, {"x": "é"}) and os.listdir(tmp_path / "_versions") == ["000000000001.json"] or len(os.listdir(tmp_path / "_versions")) == 2


def test_columns_that_come_later_are_null_before(spark, tmp_path):
    table = sheets.Tickets(spark, f"{tmp_path}/t")
    table.write(spark.createDataFrame([("a", "1", None, 5)], "_table_name string, _sheet_name string, event_ts timestamp_ntz, x int"))
    table.refresh(spark.createDataFrame([("a", "2", None, "new")], "_table_name string, _sheet_name string, event_ts timestamp_ntz, y string"), [("a", "2")])
    assert {(r._sheet_name, r.x, r.y) for r in table.all().collect()} == {("1", 5, None), ("2", None, "new")}


def test_only_chosen_sheets_are_opened(spark, tmp_path, monkeypatch):
    book(tmp_path, **{f"s{i}": f"{i},03.02.2024,x\n" * 50 for i in range(5)})
    opened = []
    real = sheets.filesystem

    class Counting:
        def __init__(self, store):
            self.store = store

        def open_input_stream(self, path):
            opened.append(path.split("/")[-1])
            return self.store.open_input_stream(path)

        def __getattr__(self, name):
            return getattr(self.store, name)

    monkeypatch.setattr(sheets, "filesystem", lambda p: (Counting(real(p)[0]), real(p)[1]))
    reader = sheets.SheetReader(str(tmp_path), [["book", "s1"], ["book", "s3"], ["book", "none"]], 5)
    assert [len(list(reader.read(p))) for p in reader.partitions()] == [5, 5] and opened == ["s1.csv", "s3.csv"]
    grid = sheets.read_grid(spark, str(tmp_path), [{"table_name": "book", "sheet_name": "s1"}, {"table_name": "book"}])
    assert grid.rdd.getNumPartitions() == 1 and grid.count() == 51
    assert sheets.read_grid(spark, str(tmp_path), []).count() == 0
    # Two uses of one grid don't share what they leave out.
    every = sheets.read_grid(spark, str(tmp_path))
    assert every.filter("_sheet_name = 's1'").unionByName(every.filter("row_idx < 2")).count() == 51 + 10


def test_sheets_come_back_as_they_were_written(spark, tmp_path):
    rows = [("t", "a", 0, ["x", None, 'q"u,o\nte']), ("t", "a", 3, ["é"]), ("t", "b c", 1, [""]), ("u", "a", 0, [])]
    assert sheets.write_sheets(spark.createDataFrame(rows, "_table_name string, _sheet_name string, row_idx int, cells array<string>"), str(tmp_path)) == 3
    got = {(r._table_name, r._sheet_name, r.row_idx): r.cells for r in sheets.read_grid(spark, str(tmp_path)).collect()}
    assert got["t", "a", 0] == ["x", "", 'q"u,o\nte'] and got["t", "a", 3] == ["é"] and got["t", "a", 1] == got["t", "a", 2] == [] and got["t", "b c", 1] == [""]


def same_as_full(spark, folder, table):
    full = ingest.tickets(sheets.read_grid(spark, str(folder)), sheets.read_grid(spark, str(folder), rows=ingest.HEADER_ROWS))
    want = {tuple(r) for r in full.select("ticket_id", "client_raw", "_sheet_name").collect()}
    got = table.in_order().orderBy("ingest_seq").select("ticket_id", "client_raw", "_sheet_name").collect()
    return {tuple(r) for r in got} == want and [r["ticket_id"] for r in got] == [r["ticket_id"] for r in full.orderBy("ingest_seq").collect()]


def test_refreshes_read_what_changed(spark, tmp_path):
    folder, table, seen = tmp_path / "in", sheets.Tickets(spark, f"{tmp_path}/t"), f"{tmp_path}/seen"
    book(folder, a="1,03.02.2024,x\n2,04.02.2024,y\n", b="3,05.02.2024,z\n", c="4,05.02.2024,z\n")
    (folder / "book" / "none.csv").write_text("a,b\n")
    run = lambda: refresh.refresh(spark, str(folder), table, seen)
    run()
    assert same_as_full(spark, folder, table) and table.versions.read()[0] == 1
    run()
    assert table.versions.read()[0] == 1
    first = table.versions.read()[1]["sheets"]
    book(folder, a="1,03.02.2024,x\n9,04.02.2024,new\n", d="5,05.02.2024,w\n")
    (folder / "book" / "b.csv").unlink()
    (folder / "book" / "c.csv").write_bytes(HEAD.encode() + b"4,05.02.2024,z\n" * 2000 + b"\xff\xfe,\n")
    run()
    held = table.versions.read()[1]
    assert same_as_full(spark, folder, table) and {k: held["sheets"].get(k) == v for k, v in first.items()} == {'["book", "a"]': False, '["book", "b"]': False, '["book", "c"]': False}
    told = {r._sheet_name: r.reason for r in table.rejected().collect()}
    assert told.keys() == {"none", "c"} and told["none"] == "no header" and "utf-8" in told["c"]
    # Mended, it is no longer told of; nothing else is read again.
    book(folder, c="4,05.02.2024,z\n")
    run()
    assert {r._sheet_name for r in table.rejected().collect()} == {"none"} and table.versions.read()[1]["sheets"]['["book", "d"]'] == held["sheets"]['["book", "d"]']


def test_a_batch_replayed_after_a_crash_changes_nothing(spark, tmp_path):
    folder, table, seen = tmp_path / "in", sheets.Tickets(spark, f"{tmp_path}/t"), tmp_path / "seen"
    book(folder, a="1,03.02.2024,x\n")
    refresh.refresh(spark, str(folder), table, str(seen))
    # The table was swapped, but the stream died before it could note the batch.
    for f in (seen / "commits").iterdir():
        f.unlink()
    before = table.versions.read()
    refresh.refresh(spark, str(folder), table, str(seen))
    assert table.versions.read() == before and len(list((seen / "commits").glob("[0-9]*"))) == 1
    # Another stream over the same folder counts from 0 and is heard.
    book(folder, b="2,03.02.2024,x\n")
    refresh.refresh(spark, str(folder), table, f"{tmp_path}/other")
    assert same_as_full(spark, folder, table)


def test_the_write_counts_what_a_second_pass_counts(spark, tmp_path):
    book(tmp_path / "in", a="1,03.02.2024,x\n1,04.02.2024,y\n,,\n,05.02.2024,z\n", b="1,05.02.2024,z\n7\n", e="")
    (tmp_path / "in" / "book" / "none.csv").write_text("a,b\n")
    (tmp_path / "in" / "book" / "bad.csv").write_bytes(b"\xff\xfe\x00")
    grid, table = sheets.read_grid(spark, f"{tmp_path}/in"), sheets.Tickets(spark, f"{tmp_path}/t")
    got = ingest.stored(grid, table)
    assert got == ingest.statistics(grid).first().asDict() and got["duplicates"] == 2 and got["sheets_rejected"] == 2
    assert table.all().count() == got["tickets"] - got["duplicates"]


@pytest.mark.parametrize("name", ["ооо (альфа", "*", "a\\", "[", "x{2,1}"])
def test_broken_patterns_give_a_message(spark, sf, tmp_path, name):
    table = sheets.Tickets(spark, f"{tmp_path}/t")
    table.write(tickets(spark, sf))
    log = store.QueryLog(spark, f"{tmp_path}/log")
    engine = router.Engine(table, log=log)
    chosen = [{"table_name": "odd", "sheet_name": "F"}]
    said, result = engine.ask(f"клиент {name}", chosen)
    told = engine.answer(f"клиент {name}", chosen)
    assert result is None and "could not be answered" in said and told.answer == said and told.preview_data.count() == 0
    assert {(r["tool"], r["summary"]) for r in log.read().collect()} == {("search_client", said)}
    for tool, arguments in (("search_point", {"point_query": f"a | {name}"}), ("search_problem", {"problem_query": name}), ("search_combined", {"problem_query": "x", "client_query": name})):
        with pytest.raises(ValueError, match="regular expression"):
            tools.execute_tool(tool, arguments, table.all())


def test_what_fails_only_when_it_runs_gives_a_message(spark, sf, tmp_path):
    table = sheets.Tickets(spark, f"{tmp_path}/t")
    table.write(tickets(spark, sf).withColumn("point_name", F.lit("x")))
    log = store.QueryLog(spark, f"{tmp_path}/log")
    engine = router.Engine(table, log=log)
    for f in Path(f"{tmp_path}/t").rglob("*.parquet"):
        f.write_bytes(b"no parquet file at all")
    told = engine.answer("топ клиентов: кто чаще", [{"table_name": "odd", "sheet_name": "F"}])
    assert "could not be answered" in told.answer and [r["summary"] for r in log.read().collect()] == [told.answer]


def test_stored_types_the_grid_once(spark, sf):
    """Every row of the grid passes the typing once, however many parts of the table are made from it."""
    seen = spark.sparkContext.accumulator(0)

    def passed(n):
        seen.add(1)
        return n

    rows = queries.grid(spark, sf)
    no = F.udf(passed, "int").asNondeterministic()("row_idx")
    found = ingest.stored(rows.withColumn("row_idx", no), sheets.Tickets(spark, queries.scratch(spark, "once")), rows)
    assert found["tickets"] > 0 and seen.value == rows.count()
