"""The mapping store by slices, the query log, failed providers and cancelled runs."""

import threading
import time
from datetime import UTC, date, datetime

import pytest

from tests.oracle import differences
from tidemark.operators import normalize
from tidemark.plans import queries
from tidemark.sources import shared, store

SCHEMA = "key string, normalized string, tags array<string>"


def test_query_matches_sql(spark, sf):
    assert differences(spark, sf, "stored_problems", queries.stored_problems, queries.SQL["stored_problems"]) == ""


def problems_of(spark, n):
    return normalize.distinct_problems(spark.createDataFrame([(f"Problem {i}",) for i in range(n)], "problem_raw string"))


def test_a_slice_reads_its_own_part(spark, tmp_path):
    mapping, seen = store.Mapping(spark, f"{tmp_path}/m", SCHEMA, slices=3), []
    provider = lambda items: {x: {"normalized": x, "tags": []} for x in items}

    def compute(keys, held):
        seen.append((keys.inputFiles(), held.inputFiles()))
        return normalize.normalise_problems(keys, held, [], provider)

    assert normalize.store_in_slices(problems_of(spark, 30), mapping, compute) == 0
    assert normalize.store_in_slices(problems_of(spark, 60), mapping, compute) == 0
    assert len(seen) == 6 and mapping.read().count() == 60
    for i, (keys, held) in enumerate(seen):
        assert keys and all(f"slice={i % 3}/" in f for f in [*keys, *held]) and bool(held) == (i > 2)
    # How the mapping is laid out stays, whatever a later caller asks for.
    assert store.Mapping(spark, f"{tmp_path}/m", SCHEMA, slices=7).slices == 3


def test_changed_keys_leave_its_size(spark, tmp_path):
    mapping = store.Mapping(spark, f"{tmp_path}/m", SCHEMA, slices=2)
    sizes = []
    for run in range(10):
        mapping.add(spark.createDataFrame([(f"k{i}", f"run {run}", ["t"]) for i in range(500)], SCHEMA))
        mapping.versions.sweep(0)
        sizes.append(sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")))
        assert {r.normalized for r in mapping.read().collect()} == {f"run {run}"}
    assert mapping.read().count() == 500 and max(sizes[5:]) <= max(sizes[:5])
    mapping.add(spark.createDataFrame([("new", "x", None)], SCHEMA))
    mapping.compact()
    assert mapping.read().count() == 501 and all(len(d) == 1 for d in mapping.versions.read()[1]["pieces"].values())
    mapping.compact()
    mapping.clear()
    assert mapping.read().count() == 0 and mapping.read(1).count() == 0


def test_failed_batches_are_counted(spark):
    failures = spark.sparkContext.accumulator(0)

    def provider(items):
        if any("7" in x for x in items):
            raise OSError
        return {x: {"normalized": x, "tags": []} for x in items}

    found = normalize.normalise_problems(problems_of(spark, 20), spark.createDataFrame([], "key string"), [], provider, batch=1, failures=failures).collect()
    assert len(found) == 18 and failures.value == 2


def test_a_running_provider_is_stopped(spark, tmp_path):
    mapping = store.Mapping(spark, f"{tmp_path}/m", SCHEMA, slices=2)
    fast = lambda items: {x: {"normalized": x, "tags": []} for x in items}

    def slow(items):
        time.sleep(120)
        return {}

    calls = []

    def compute(keys, held):
        calls.append(1)
        return normalize.normalise_problems(keys, held, [], fast if len(calls) == 1 else slow)

    began = []

    def stop():
        while len(calls) < 2:
            time.sleep(0.05)
        time.sleep(4)
        began.append(time.time())
        shared.cancel(spark, "slow-run")

    threading.Thread(target=stop, daemon=True).start()
    with pytest.raises(Exception, match="cancel"), shared.cancellable(spark, "slow-run"):
        normalize.store_in_slices(problems_of(spark, 30), mapping, compute)
    assert time.time() - began[0] < 5 and 0 < mapping.read().count() < 30


def test_closed_days_of_the_log_become_one_file(spark, tmp_path):
    log = store.QueryLog(spark, f"{tmp_path}/log")
    assert log.compact() == []
    for i in range(6):
        log.add("question", f"q{i}", at=datetime(2024, 1, 1 + i % 3, 12, tzinfo=UTC))
    files = lambda: sorted((p.parent.name, 1) for p in (tmp_path / "log").rglob("*.parquet"))
    assert log.compact(date(2024, 1, 3)) == ["2024-01-01", "2024-01-02"] and len(files()) == 4
    assert {r.question for r in log.read().collect()} == {f"q{i}" for i in range(6)} and log.compact(date(2024, 1, 3)) == []
    # A crash after the copy: entries are there twice, and count once.
    part = next((tmp_path / "log" / "day=2024-01-02").glob("*.parquet"))
    part.with_name("part-again.parquet").write_bytes(part.read_bytes())
    assert log.read().count() == 6 and log.compact(date(2024, 1, 3)) == ["2024-01-02"] and log.read().count() == 6
    one = sum(p.stat().st_size for p in (tmp_path / "log" / "day=2024-01-03").glob("*.parquet"))
    assert log.keep(one) == ["2024-01-01", "2024-01-02"] and {r.question for r in log.read().collect()} == {"q2", "q5"}
