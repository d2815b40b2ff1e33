"""Spreadsheets as grids of strings: a Spark data source over a folder of CSV sheets, and the stored ticket table.

Layout: ``<folder>/<table>/<sheet>.csv``. One partition reads one file; a file that can't be read gives one row with an error.
A large sheet that was written from here lies in parts: ``<sheet>.sheet`` lists them with their rows, and is renamed into place last.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.sources.versions import Versions

REMOVED = "removed"
GRID = "_table_name string, _sheet_name string, row_idx int, cells array<string>, error string"
SHEET = ["_table_name", "_sheet_name"]


class SheetPart(InputPartition):
    """A file whose first row is row ``first`` of its sheet; rows from ``start`` to there are blank."""

    def __init__(self, table: str, sheet: str, path: str, removed: bool = False, start: int = 0, first: int = 0):
        self.table, self.sheet, self.path, self.removed, self.start, self.first = table, sheet, path, removed, start, first


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def list_sheets(folder: str, page: int = 1000) -> Iterator[list[dict]]:
    """Pages of {table, sheet, path, stamp}, in order; a folder that can't be listed ends the list. ``stamp`` is time and size."""
    try:
        store, root = filesystem(folder)
        files = [i for i in store.get_file_info(pafs.FileSelector(root, recursive=True)) if i.path.endswith((".csv", ".sheet"))]
    except OSError:
        return
    # Of a sheet that is there as a file and in parts, as it is while one replaces the other, the later one counts.
    latest = {i.path.rsplit(".", 1)[0]: i for i in sorted(files, key=lambda i: i.mtime_ns)}
    found = sorted((i.path, f"{i.mtime_ns}:{i.size}") for i in latest.values())
    for a in range(0, len(found), page):
        yield [{"table": p.split("/")[-2], "sheet": p.split("/")[-1].rsplit(".", 1)[0], "path": p, "stamp": stamp} for p, stamp in found[a : a + page]]


def listed(store: pafs.FileSystem, path: str) -> dict:
    """What ``<sheet>.sheet`` lists: parts as [name, first row, last row] in order, and the names of parts that it replaced. Nothing if there is no such file."""
    try:
        with store.open_input_stream(path) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return {"parts": [], "before": []}


def files_of(folder: str, table: str, sheet: str, path: str) -> list[SheetPart]:
    """The file of a sheet, or its parts."""
    if not path.endswith(".sheet"):
        return [SheetPart(table, sheet, path)]
    parts = listed(filesystem(folder)[0], path)["parts"]
    starts = [0] + [last + 1 for _, _, last in parts]
    return [SheetPart(table, sheet, f"{path.rsplit('/', 1)[0]}/{name}", False, start, first) for start, (name, first, _) in zip(starts, parts, strict=False)]


def read_sheet(folder: str, part: SheetPart, rows: int | None = None) -> Iterator[tuple]:
    """What a file has of the first ``rows`` rows of its sheet, or all. An error ends it, with a row that tells it; so does that the sheet is gone."""
    if part.removed:
        yield (part.table, part.sheet, None, None, REMOVED)
    if not part.path or part.removed:
        return
    end = part.first if rows is None else min(rows, part.first)
    for i in range(part.start, end):
        yield (part.table, part.sheet, i, [], None)
    if rows is not None and rows <= part.first:
        return
    try:
        store, _ = filesystem(folder)
        with store.open_input_stream(part.path) as f:
            text = io.TextIOWrapper(f, encoding="utf-8", newline="")
            for i, row in enumerate(islice(csv.reader(text), None if rows is None else rows - part.first), part.first):
                yield (part.table, part.sheet, i, row, None)
    except (OSError, UnicodeDecodeError, csv.Error) as e:
        yield (part.table, part.sheet, None, None, str(e)[:500])


class SheetReader(DataSourceReader):
    """Sheets that aren't chosen are not opened, and a bound on rows ends a sheet early.

    Both are options of the source. The filters that Spark can push to a Python source are not taken: it keeps them with the loaded
    relation, where another use of the same frame meets them.
    """

    def __init__(self, folder: str, chosen: list[list[str]] | None = None, rows: int | None = None):
        self.folder, self.rows = folder, rows
        self.chosen = None if chosen is None else {tuple(c) for c in chosen}

    def partitions(self) -> list[InputPartition]:
        found = (s for page in list_sheets(self.folder) for s in page)
        taken = (s for s in found if self.chosen is None or (s["table"], s["sheet"]) in self.chosen)
        parts = (p for s in taken for p in files_of(self.folder, s["table"], s["sheet"], s["path"]))
        return [p for p in parts if self.rows is None or p.start < self.rows] or [SheetPart("", "", "")]

    def read(self, part: SheetPart) -> Iterator[tuple]:
        return read_sheet(self.folder, part, self.rows)


class SheetStream(DataSourceStreamReader):
    """Sheets that are new, changed or gone since the last batch. An offset has time and size of each sheet: one entry a sheet."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {json.dumps([s["table"], s["sheet"], s["path"]], ensure_ascii=False): s["stamp"] for page in list_sheets(self.folder) for s in page}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        changed = [p for k, stamp in end.items() if start.get(k) != stamp for p in files_of(self.folder, *json.loads(k))]
        gone = [SheetPart(*json.loads(k), removed=True) for k in start if k not in end]
        return changed + gone or [SheetPart("", "", "")]

    def read(self, part: SheetPart) -> Iterator[tuple]:
        return read_sheet(self.folder, part)


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return GRID

    def reader(self, schema) -> DataSourceReader:
        return SheetReader(self.options["path"], json.loads(self.options.get("chosen", "null")), json.loads(self.options.get("rows", "null")))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return SheetStream(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(SheetSource)
    return spark


def read_grid(spark: SparkSession, folder: str, chosen: list[dict] | None = None, rows: int | None = None) -> DataFrame:
    """All sheets as one grid, or the ``chosen`` ones (see ``select_sheets``), of which no others are opened, or the first ``rows`` rows of each."""
    source = registered(spark).read.format("sheets")
    if chosen is not None:
        source = source.option("chosen", json.dumps(chosen_pairs(chosen), ensure_ascii=False))
    return source.option("rows", json.dumps(rows)).load(folder)


def write_sheets(grid: DataFrame, folder: str) -> int:
    """A grid as sheets; how many there are. Tasks stream ranges of rows of the sheets to files, so that a large sheet is the work of many.

    A sheet of one range becomes ``<sheet>.csv``, one of more is listed in ``<sheet>.sheet``; either is renamed into place when all files are
    written. Rows lie where row_idx puts them, with blank lines between; null cells are empty ones. Files of sheets that the grid lacks stay.
    """
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = filesystem(folder)
        last, out, at, done = None, None, 0, []
        for b in batches:
            for table, sheet, i, cells in zip(*[b.column(c).to_pylist() for c in range(4)], strict=True):
                if (table, sheet) != last:
                    if out:
                        out.close()
                        done[-1].append(at - 1)
                    last, at = (table, sheet), i
                    name = f"{sheet}.parts/{run_id}-{TaskContext.get().taskAttemptId()}-{i}.part"
                    done.append([table, sheet, name, i])
                    store.create_dir(f"{root}/{table}/{sheet}.parts", recursive=True)
                    out = io.TextIOWrapper(store.open_output_stream(f"{root}/{table}/{name}"), encoding="utf-8", newline="")
                    writer = csv.writer(out)
                out.write("\r\n" * (i - at))
                writer.writerow(["" if c is None else c for c in cells or []])
                at = i + 1
        if out:
            out.close()
            done[-1].append(at - 1)
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        names = [*SHEET, "name", "first", "last"]
        yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], t) for c, t in enumerate(types)], names=names)

    rows = grid.select(*SHEET, "row_idx", "cells").repartitionByRange(*SHEET, "row_idx").sortWithinPartitions(*SHEET, "row_idx")
    # One row a file.
    files = rows.mapInArrow(run, "_table_name string, _sheet_name string, name string, first int, last int").collect()
    sheets: dict[tuple[str, str], list] = {}
    for table, sheet, *part in sorted(map(tuple, files), key=lambda f: (f[0], f[1], f[3])):
        sheets.setdefault((table, sheet), []).append(part)
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda item: put_sheet(folder, *item[0], item[1]), sheets.items()))
    return len(sheets)


def put_sheet(folder: str, table: str, sheet: str, parts: list[list]) -> None:
    """Make ``parts`` the sheet. The parts that they replace stay until the next time, for readers that began before."""
    store, root = filesystem(folder)
    home = f"{root}/{table}"
    old = listed(store, f"{home}/{sheet}.sheet")
    if len(parts) == 1 and parts[0][1] == 0:
        store.move(f"{home}/{parts[0][0]}", f"{home}/{sheet}.csv")
        gone = [f"{sheet}.sheet"] if old["parts"] else []
        gone += [name for name, _, _ in old["parts"]]
    else:
        own = f"{home}/{parts[0][0]}.tmp"
        with store.open_output_stream(own) as f:
            f.write(json.dumps({"parts": parts, "before": [name for name, _, _ in old["parts"]]}, ensure_ascii=False).encode())
        store.move(own, f"{home}/{sheet}.sheet")
        gone = [f"{sheet}.csv"]
    drop(store, [f"{home}/{name}" for name in gone + old["before"]])


def drop(store: pafs.FileSystem, paths: list[str]) -> bool:
    """Delete those of the files that are there; whether any was."""
    there = [i.path for i in store.get_file_info(paths) if i.type == pafs.FileType.File]
    for path in there:
        store.delete_file(path)
    return bool(there)


def remove_sheet(folder: str, table: str, sheet: str) -> None:
    store, root = filesystem(folder)
    home = f"{root}/{table}"
    old = listed(store, f"{home}/{sheet}.sheet")
    names = [name for name, _, _ in old["parts"]] + old["before"]
    if not drop(store, [f"{home}/{sheet}.csv", f"{home}/{sheet}.sheet"]):
        raise FileNotFoundError(f"{home}/{sheet}.csv")
    drop(store, [f"{home}/{name}" for name in names])


def catalogue_of(tables: DataFrame) -> DataFrame:
    """Rows, whether there are any, and first and last date of each sheet."""
    day = F.date_format(F.min("event_ts"), "yyyy-MM-dd"), F.date_format(F.max("event_ts"), "yyyy-MM-dd")
    return tables.groupBy(*SHEET).agg(F.count("*").alias("row_count"), (F.count("*") > 0).alias("has_data"), F.coalesce(day[0], F.lit("")).alias("date_min"), F.coalesce(day[1], F.lit("")).alias("date_max"))


def by_first_date(catalogue: DataFrame) -> DataFrame:
    return catalogue.orderBy(F.when(F.col("date_min") != "", F.col("date_min")).asc_nulls_last(), *SHEET)


def table_names(tables: DataFrame) -> DataFrame:
    return tables.select("_table_name").distinct().orderBy("_table_name")


class Catalogue:
    """The stored catalogue of sheets (see ``catalogue_of``): one entry a sheet, replaced as a whole in one step."""

    SCHEMA = "_table_name string, _sheet_name string, row_count long, has_data boolean, date_min string, date_max string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def save(self, catalogue: DataFrame) -> None:
        number, _ = self.versions.read()
        rows = [list(r) for r in catalogue.select(*[c.split()[0] for c in self.SCHEMA.split(", ")]).collect()]
        self.versions.commit(number, {"rows": rows})

    def load(self) -> DataFrame | None:
        """The catalogue, or None if none was ever saved."""
        number, content = self.versions.read()
        return self.spark.createDataFrame([tuple(r) for r in content["rows"]], self.SCHEMA) if number else None

    def clear(self) -> None:
        self.save(self.spark.createDataFrame([], self.SCHEMA))

    def update(self, tickets: DataFrame) -> None:
        """Replace the entries of the sheets that ``tickets`` holds, keep the others."""
        new, old = catalogue_of(tickets), self.load()
        self.save(new if old is None else old.join(new, SHEET, "left_anti").unionByName(new.select(*old.columns)))

    def sheets(self) -> list[dict]:
        """All entries in order of their first date."""
        found = self.load()
        return [] if found is None else [r.asDict() for r in by_first_date(found).collect()]


class Tickets:
    """The stored ticket table, partitioned by sheet so that a selection of sheets prunes files.

    A version names, for each sheet, the folder that holds its rows, and its entry of the catalogue: a refresh writes the sheets that changed
    and swaps table and catalogue in one step. Until then, and after a crash, readers see the old ones; a table can be rewritten from itself.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)

    def write(self, df: DataFrame) -> None:
        """Replace the whole table."""
        number, _ = self.versions.read()
        self._store(number, df, {}, None, {}, None)

    def refresh(self, df: DataFrame, changed: list[tuple[str, str]], rejected: dict[str, str] | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Replace the sheets ``changed`` by their rows in ``df``, keep the others. False, and nothing is done, if ``batch`` was stored before.

        ``batch`` is a stream's name and its number; ``rejected`` tells why sheets (by ``sheet_key``) gave no tickets. Sheets of ``df`` must be among the changed ones.
        """
        number, content = self.versions.read()
        if batch and content.get("batch") and content["batch"][0] == batch[0] and content["batch"][1] >= batch[1]:
            return False
        keys = {sheet_key(*c) for c in changed}
        keep = {k: v for k, v in content.get("sheets", {}).items() if k not in keys}
        told = {k: v for k, v in content.get("rejected", {}).items() if k not in keys} | (rejected or {})
        self._store(number, df, keep, content.get("schema"), told, list(batch) if batch else content.get("batch"))
        return True

    def _store(self, number: int, df: DataFrame, keep: dict, schema: str | None, rejected: dict, batch: list | None) -> None:
        folder = self.versions.folder()
        df.write.partitionBy(*SHEET).parquet(f"{self.path}/{folder}")
        fields = {f.name: f for f in T.StructType.fromJson(json.loads(schema)).fields} if schema else {}
        whole = T.StructType(list((fields | {f.name: f for f in df.schema.fields}).values()))
        written = self._scan(df.schema, [folder])
        # One row a sheet.
        entries = {sheet_key(r["_table_name"], r["_sheet_name"]): [folder, r["row_count"], r["date_min"], r["date_max"]] for r in catalogue_of(written).collect()}
        sheets = keep | entries
        self.versions.commit(number, {"schema": whole.json(), "sheets": sheets, "folders": sorted({v[0] for v in sheets.values()}), "rejected": rejected, "batch": batch})

    def _scan(self, schema: T.StructType, places: list[str]) -> DataFrame:
        names = [f.name for f in schema.fields]
        if not places:
            return self.spark.createDataFrame([], schema)
        # Partition columns are named, so that a sheet called 007 stays text.
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{p}" for p in places]).select(*names)

    def all(self) -> DataFrame:
        """All rows of the current version, which stays as it is however often the table is replaced meanwhile (see ``Versions.sweep``)."""
        _, content = self.versions.read()
        if not content:
            raise FileNotFoundError(f"no ticket table at {self.path}")
        parts = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        dirs = [f"{v[0]}/" + "/".join(parts.getPartitionPathString(c, x) for c, x in zip(SHEET, json.loads(k), strict=True)) for k, v in content["sheets"].items()]
        return self._scan(T.StructType.fromJson(json.loads(content["schema"])), dirs)

    def in_order(self) -> DataFrame:
        """All rows with ingest_seq by the order of tables, sheets and rows, as an ingest of all sheets at once numbers them."""
        order = sorted(json.loads(k) for k in self.versions.read()[1]["sheets"])
        # One row a sheet.
        numbers = self.spark.createDataFrame([(*k, n) for n, k in enumerate(order, 1)], "_table_name string, _sheet_name string, no_ long")
        rows = self.all()
        seq = F.shiftleft("no_", 32) + F.col("ingest_seq").bitwiseAND(F.lit((1 << 32) - 1))
        return rows.join(numbers, SHEET).withColumn("ingest_seq", seq).select(*rows.columns)

    def catalogue(self) -> DataFrame:
        """The catalogue of the same version."""
        rows = [(*json.loads(k), n, True, lo, hi) for k, (_, n, lo, hi) in self.versions.read()[1].get("sheets", {}).items()]
        return self.spark.createDataFrame(rows, Catalogue.SCHEMA)

    def rejected(self) -> DataFrame:
        """(_table_name, _sheet_name, reason) of the sheets that gave no tickets, or broke off, when they were last read."""
        rows = [(*json.loads(k), reason) for k, reason in self.versions.read()[1].get("rejected", {}).items()]
        return self.spark.createDataFrame(rows, "_table_name string, _sheet_name string, reason string")

    def sheets(self, chosen: list[dict]) -> DataFrame:
        return select_sheets(self.all(), chosen)


def sheet_key(table: str, sheet: str) -> str:
    return json.dumps([table, sheet], ensure_ascii=False)


def select_sheets(df: DataFrame, chosen: list[dict]) -> DataFrame:
    """Rows of the chosen (table_name, sheet_name) pairs; pairs that lack either are skipped, none chosen gives no rows.

    A predicate on the partition columns: files of other sheets aren't read.
    """
    keep = F.lit(False)
    for table, sheet in chosen_pairs(chosen):
        keep = keep | ((F.col("_table_name") == table) & (F.col("_sheet_name") == sheet))
    return df.filter(keep)


def chosen_pairs(chosen: list[dict]) -> list[tuple[str, str]]:
    return [(c["table_name"], c["sheet_name"]) for c in chosen if c.get("table_name") and c.get("sheet_name")]


def tag_example(df: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """The first row that has tags, by its problem columns; no row where none has."""
    columns = [c for c in ("problem_raw", "problem_normalized", "problem_tags") if c in df.columns]
    tagged = df.filter(F.coalesce(F.size("problem_tags"), F.lit(0)) > 0)
    return tagged.agg(F.min_by(F.struct(*columns), seq).alias("r")).filter("r is not null").select("r.*")


def tag_report(df: DataFrame) -> DataFrame:
    """How many rows there are, how many have tags, and how many sheets they come from."""
    return df.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.size("problem_tags"), F.lit(0)) > 0).alias("tagged"), F.count_distinct(*SHEET).alias("sheets"))
