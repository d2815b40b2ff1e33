import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle import differences
from tidemark.functions import dates, similarity, text
from tidemark.operators import aggregates, ingest, normalize, reconcile
from tidemark.plans import queries, router, tools
from tidemark.plans.views import messy, tickets
from tidemark.sources import shared, sheets, store
from tidemark.streaming import refresh

FIELDS = "ingest_seq long, client_normalized string, point_name string, address_normalized string, address_city string"
QUALIFIERS = {"pro": "Pro", "franch": "Franchise"}


def scalar(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


# --- every query with SQL, at the smallest scale


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    said = differences(spark, sf, name, queries.QUERIES[name], queries.SQL[name])
    assert not said or "no rows to compare" in said


def test_queries_without_sql_are_tested_below():
    assert set(queries.QUERIES) - set(queries.SQL) == {"category_match", "fuzzy_ratios", "glossary_matches", "client_cluster", "reconcile_all", "reconcile_report"}


def test_fuzzy_queries_by_brute_force(spark, sf):
    for r in queries.fuzzy_ratios(spark, sf).collect():
        assert (r.ratio, r.token_set, r.token_sort) == tuple(f(r.p_name, r.p_type) for f in (similarity.ratio, similarity.token_set_ratio, similarity.token_sort_ratio))
    names = ["Economy", "Standard", "Standard part", "Promo: large", "Medium or small"]
    got = queries.category_match(spark, sf).collect()
    assert len(got) == len({r.problem_raw for r in got}) > 20
    for r in got:
        scores = [(similarity.token_set_ratio(r.problem_raw, n), len(n), -i, n) for i, n in enumerate(names)]
        assert r.category == (max(scores)[3] if max(scores)[0] >= 90 else None)


def test_score_words_are_the_scores_words(spark):
    texts = ["Принтер №5, ёлка", "a_b c", "x\u00ffy z", "é café", "", None, "  A  a ", "e\u0301 b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(normalize.score_words(F.col("t"))).collect()
    assert [set(r[0]) for r in got] == [set(similarity.words(t)) for t in texts]


def brute_renames(rows):
    """(name, canonical) by all pairs of names at each house."""
    forms = lambda n: {w for w in re.findall(r"[0-9a-zа-яё]+", n.lower()) if w in text.LEGAL_FORMS}
    tokens = lambda n: set(re.findall(r"[0-9a-zа-яё]+", n.lower()))
    front = lambda n: bool(re.match(rf"\s*({'|'.join(text.LEGAL_FORMS)})\b", n.lower()))

    def safe(a, b):
        own = lambda x, y: any(len(w) >= 4 for w in tokens(x) - tokens(y))
        return not (forms(a) and forms(b) and forms(a) != forms(b)) and min(len(a), len(b)) / max(len(a), len(b)) >= 0.5 and not (own(a, b) and own(b, a))

    houses = {}
    for fp, name in rows:
        houses.setdefault(fp, set()).add(name)
    out = {}
    for fp, names in sorted(houses.items()):
        root = {n: n for n in names}
        for a in sorted(names):
            for b in sorted(names):
                if a < b and safe(a, b) and similarity.token_set_ratio(a, b) >= 85:
                    x, y = root[a], root[b]
                    root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
        for n in names:
            own = [m for m in names if root[m] == root[n]]
            best = min(own, key=lambda m: (not front(m), -len(m), m))
            if best != n:
                out[n] = best
    return out


def test_client_cluster_by_brute_force(spark, sf):
    got = {r.name: r.canonical for r in queries.client_cluster(spark, sf).collect()}
    rows = messy(spark, sf).select(text.address_fingerprint(F.col("address_normalized"), F.col("address_city")), "client_normalized").collect()
    assert got == brute_renames([(fp, n) for fp, n in rows if fp and n])
    rng = random.Random(5)
    words = ["альфа", "бета", "гамма", "ооо", "ип", "аб", "вг", "дельта", "эпсилон"]
    names = [" ".join(rng.sample(words, rng.randint(1, 4))).title() for _ in range(150)]
    rows = [(i, n, "", f"Улица {i % 3}", "") for i, n in enumerate(names)]
    df = reconcile.prepared(spark.createDataFrame(rows, FIELDS))
    want = brute_renames([(f"{i % 3}", n) for i, n in enumerate(names)])
    assert {r.name: r.canonical for r in reconcile.client_renames(df).collect()} == want and len(want) > 10


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


# --- scalar functions


@pytest.mark.parametrize(
    ("address", "city", "want"),
    [
        ("Бург, мкр Светлый, д 2", "Бург", "светлый2"),
        ("Светлый м-н 2", "", "светлый2"),
        ("бург, Светлый, 2", "Бург", "светлый2"),
        ("Ёлочная, 1Ж", "", "елочная1ж"),
        ("", "Бург", ""),
        (None, None, ""),
    ],
)
def test_fingerprint(spark, address, city, want):
    assert scalar(spark, text.address_fingerprint(F.col("a"), F.col("c")), a=address, c=city) == want


@pytest.mark.parametrize(("raw", "want"), [("№ 12-345 x 6-7", "12-345"), ("  abc ", "abc"), (None, ""), ("12", "12")])
def test_ticket_number(spark, raw, want):
    assert scalar(spark, text.ticket_number(F.col("x")), x=raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Pro North", "Home Pro North"),
        ("North PRO", "Home Pro North"),
        ("Home franch", "Home Franchise"),
        ("franch Rotor", "Rotor Franchise"),
        ("franch South rotor", "Rotor Franchise South"),
        ("Franch Home // Rotor", "Home Franchise Rotor"),
        ("Profile street", "Profile street"),
        ("  plain  name ", "plain  name"),
        ("", ""),
        (None, ""),
    ],
)
def test_expand_point(spark, raw, want):
    assert scalar(spark, text.expand_point(F.col("x"), QUALIFIERS, {"rotor": "Rotor"}, "Home"), x=raw) == want


@pytest.mark.parametrize(("name", "want"), [("Home Pro North East", ("Home", "Pro", "North East")), ("Home franch", ("Home", "Franchise", "")), ("Cafe Domino", ("Cafe Domino", "", "")), ("pro", ("", "Pro", "")), (None, ("", "", ""))])
def test_split_point(spark, name, want):
    assert tuple(scalar(spark, text.split_point(F.col("x"), QUALIFIERS), x=name)) == want


@pytest.mark.parametrize(("parts", "want"), [(("C", "S", "1", "2", "3"), "C, S, 1/2, 3"), (("C", "S", "", "2", None), "C, S"), ((None, " S ", "1", "", ""), "S, 1"), ((None,) * 5, "")])
def test_compose_address(spark, parts, want):
    assert scalar(spark, text.compose_address(*[F.col(c) for c in "abcde"]), **dict(zip("abcde", parts, strict=True))) == want


@pytest.mark.parametrize(("a", "b", "want"), [("ООО Альфа", "ИП Альфа", False), ("Альфа", "Альфа Инвест Групп", False), ("ИП Иванов Иван Петрович", "ИП Иванов Юрий Петрович", False), ("ООО Альфа Бета", "Альфа Бета ООО", True), ("Альфа Бета (проф)", "Альфа Бета", True)])
def test_safe_to_merge(spark, a, b, want):
    assert scalar(spark, text.safe_to_merge(F.col("a"), F.col("b")), a=a, b=b) == want


def test_similarity_scores():
    assert similarity.ratio("abc", "abd") == 67 and similarity.ratio("", "a") == 0 and similarity.ratio(None, "a") == 0
    assert similarity.token_set_ratio("fix of the printer", "Printer") == 100 and similarity.token_sort_ratio("b a", "A, b") == 100
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in "xy")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity.common_of([a], [b])[0] == table[-1][-1]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("03.02.2024 10:11:12", "2024-02-03 10:11:12"), ("03/02/2024 10:11", "2024-02-03 10:11:00"), ("03.02.24 10:11:12", "2024-02-03 10:11:12"), ("03.02.2024", "2024-02-03 00:00:00"), ("2024-02-03 10:11:12", "2024-02-03 10:11:12"), ("soon", "soon"), ("", ""), (None, None)],
)
def test_dates(spark, raw, want):
    assert scalar(spark, dates.date_text(F.col("x")), x=raw) == want


def test_date_windows(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-05", "2024-01-06", "2024-01-07 00:00:00", "2024-01-09", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d string").withColumn("event_ts", F.col("d").cast("timestamp_ntz"))
    ids = lambda **k: sorted(r.i for r in dates.filter_by_date(df, **k).collect())
    assert ids() == [0, 1, 2, 3, 4, 5]
    assert ids(consecutive_days=2, last_n_days=1) == [2, 3, 4] and ids(consecutive_days=4) == []
    assert ids(last_n_days=2, as_of="2024-01-07", date_from="2024-01-01", date_to="2024-01-01") == [2, 3, 4, 5]
    assert ids(date_from="2024-01-02", date_to="2024-01-05") == [1, 2] and ids(date_from="2024-01-02") == [0, 1, 2, 3, 4, 5]


# --- ingest, normalisation, sources


def test_sheets_to_tickets(spark, tmp_path):
    (tmp_path / "book").mkdir()
    (tmp_path / "book" / "one.csv").write_text("Журнал\nНомер,Дата,Контрагент,Точка,Описание\n7-1 x,03.02.2024 10:11,ООО А,\"Бург, Мира 1\",не печатает\n,,,,\n7-2\n", encoding="utf-8")
    (tmp_path / "book" / "none.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    (tmp_path / "book" / "bad.csv").write_bytes(b"\xff\xfe\x00")
    grid = sheets.read_grid(spark, str(tmp_path))
    assert grid.filter("error is not null").count() == 1
    got = ingest.tickets(grid).orderBy("ingest_seq").collect()
    assert {tuple(r)[:2]: r.reason for r in ingest.rejected_sheets(grid).collect()}.keys() == {("book", "bad"), ("book", "none")}
    assert [(r.ticket_id, r.date, r.client_raw, r.address_raw, r.problem_raw, r._sheet_name) for r in got] == [("7-1", "2024-02-03 10:11:00", "ООО А", "Бург, Мира 1", "не печатает", "one"), ("7-2", None, "", "", None, "one")]
    assert sheets.read_grid(spark, str(tmp_path / "nothing")).count() == 0


def test_normalisation_layers(spark, tmp_path):
    problems = spark.createDataFrame([("Printer is broken",), ("printer is broken",), (" ",), (None,), ("Odd Thing",), ("lost",)], "problem_raw string")
    held = store.Mapping(spark, f"{tmp_path}/m", "key string, normalized string, tags array<string>")
    assert held.read().count() == 0
    provider = lambda items: {x: {"normalized": "", "tags": ["Other", "x"]} for x in items if x != "lost"}
    keys = normalize.distinct_problems(problems)
    new = normalize.normalise_problems(keys, held.read(), ["Printer", "Printer is broken", "Other"], provider)
    got = {r.key: (r.normalized, r.tags) for r in new.collect()}
    assert got == {"printer is broken": ("Printer is broken", ["Printer is broken"]), "odd thing": ("Odd Thing", ["Other"])}
    held.add(new)
    assert {r.key for r in normalize.misses(keys, held.read()).collect()} == {"lost"}
    rows = normalize.apply_problems(problems, held.read()).collect()
    assert Counter(r.problem_normalized for r in rows) == Counter({"Printer is broken": 2, "": 3, "Odd Thing": 1})
    held.clear()
    assert held.read().count() == 0


def test_pairs_through_provider(spark):
    raw = spark.createDataFrame([(" ООО А ", "Мира 1"), ("ооо а", "мира 1"), ("", "")], "client_raw string, address_raw string")
    pairs = normalize.distinct_pairs(raw)
    fields = {"client_normalized": "ООО А", "client_qualifier": "", "point_name": "pro North", "city": "Бург", "street": "Мира", "house": "1", "korpus": "2", "apartment": ""}
    empty = spark.createDataFrame([], "key string")
    mapped = normalize.normalise_pairs(pairs, empty, lambda keys: dict.fromkeys(keys, fields), QUALIFIERS, {}, "Home")
    got = normalize.apply_pairs(raw, mapped).collect()
    assert Counter((r.client_normalized, r.point_name, r.address_normalized, r.address_city) for r in got) == Counter({("ООО А", "Home Pro North", "Бург, Мира, 1/2", "Бург"): 2, ("",) * 4: 1})


def test_providers_get_what_was_written(spark, tmp_path):
    raw = spark.createDataFrame([(" ООО Ромашка ", "Бург, Мира 1"), ("ОАО Лютик", "Град")], "client_raw string, address_raw string")
    seen = tmp_path / "seen"
    seen.mkdir()

    def provider(items):
        (seen / f"{len(list(seen.iterdir()))}-{abs(hash(tuple(items)))}").write_text(json.dumps(items, ensure_ascii=False))
        return {("никто", ""): {}, **{(c, a): dict.fromkeys(normalize.PAIR_FIELDS, "") | {"client_normalized": c, "city": a} for c, a in items}}

    got = normalize.normalise_pairs(normalize.distinct_pairs(raw), spark.createDataFrame([], "key string"), provider, {}, {}, "Home").collect()
    assert {(r.key, r.client_normalized, r.city) for r in got} == {("ооо ромашка||бург, мира 1", "ООО Ромашка", "Бург, Мира 1"), ("оао лютик||град", "ОАО Лютик", "Град")}
    asked = [tuple(x) for p in seen.iterdir() for x in json.loads(p.read_text())]
    assert set(asked) == {("ООО Ромашка", "Бург, Мира 1"), ("ОАО Лютик", "Град")}


def test_retries_and_their_waits():
    calls, waits = [], []

    def flaky(items):
        calls.append(items)
        if len(calls) < 3:
            raise OSError
        return {"x": 1}

    assert normalize.retrying(flaky, 3, 1.0, waits.append)(["x"]) == {"x": 1} and waits == [1.0, 2.0]
    calls.clear()
    with pytest.raises(OSError):
        normalize.retrying(flaky, 2, 1.0, waits.append)(["x"])


def test_slices_are_stored_one_by_one(spark, tmp_path):
    problems = normalize.distinct_problems(spark.createDataFrame([(f"Problem {i}",) for i in range(40)], "problem_raw string"))
    mapping = store.Mapping(spark, f"{tmp_path}/m", "key string, normalized string, tags array<string>", slices=4)
    provider = lambda items: {x: {"normalized": x, "tags": []} for x in items}
    compute = lambda keys, held: normalize.normalise_problems(keys, held, [], provider)
    asked = iter([False, False, True])
    with pytest.raises(shared.Cancelled):
        normalize.store_in_slices(problems, mapping, compute, lambda: next(asked))
    n = mapping.read().count()
    assert 0 < n < 40 and normalize.completed(problems, mapping.read(), compute).count() == 40 and mapping.read().count() == n
    assert normalize.store_in_slices(problems, mapping, compute) == 0 and mapping.read().count() == 40


def test_jobs_are_cancelled_by_tag(spark):
    import threading
    import time

    def stop():
        for _ in range(100):
            time.sleep(0.1)
            shared.cancel(spark, "run-1")

    threading.Thread(target=stop, daemon=True).start()
    with pytest.raises(Exception, match="cancel"), shared.cancellable(spark, "run-1"):
        spark.range(0, 10**13).selectExpr("sum(hash(id))").collect()


def test_catalogue_is_stored(spark, sf, tmp_path):
    kept = sheets.Catalogue(spark, f"{tmp_path}/c")
    assert kept.load() is None and kept.sheets() == []
    rows = tickets(spark, sf)
    kept.update(rows.filter("_table_name = 'odd'"))
    kept.update(rows.filter("_table_name = 'even' or _sheet_name = 'F'"))
    want = {(r._table_name, r._sheet_name): r["count"] for r in rows.groupBy("_table_name", "_sheet_name").count().collect()}
    assert {(s["_table_name"], s["_sheet_name"]): s["row_count"] for s in kept.sheets()} == want
    assert [s["date_min"] for s in kept.sheets()] == sorted(s["date_min"] for s in kept.sheets())
    kept.clear()
    assert kept.sheets() == [] and kept.load().count() == 0


def test_categories_are_rendered():
    found = [("B", "what b is"), ("A", "")]
    assert store.category_names(found) == ["B", "A"] and store.category_description(found, "B") == "what b is" and store.category_description(found, "C") is None
    assert store.render_categories(found) == "- B: what b is\n- A"


def test_ticket_store_prunes_sheets(spark, sf, tmp_path):
    kept = sheets.Tickets(spark, str(tmp_path / "t"))
    kept.write(tickets(spark, sf))
    chosen = kept.sheets([{"table_name": "odd", "sheet_name": "F"}])
    assert chosen.count() == kept.all().filter("_table_name = 'odd' and _sheet_name = 'F'").count() > 0
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_table_name[^\]]*_sheet_name", plan) and kept.sheets([]).count() == 0


def test_config_and_glossary(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"categories": [{"name": "A", "description": "x"}, {"name": " A "}, {"name": ""}, "B"]}))
    assert store.read_categories(str(tmp_path / "c.json")) == [("A", "x"), ("B", "")] and store.read_categories(str(tmp_path / "no.json")) == []
    (tmp_path / "g.json").write_text(json.dumps({"Pro": {"qualifier": True, "aliases": ["prof."]}, "Rotor": {"standalone_brand": True, "meaning": "a chain"}}))
    g = store.Glossary.read(str(tmp_path / "g.json"))
    assert g.qualifiers() == {"pro": "Pro", "prof": "Pro"} and g.brands() == {"rotor": "Rotor"} and g.alias_map()["prof"] == "Pro"
    assert g.lookup("the rotor shop")[0]["term"] == "Rotor" and g.lookup(" ") == []


# --- reconciliation scenarios


def run(spark, rows, step):
    df = reconcile.prepared(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FIELDS))
    return [(r.client_normalized, r.point_name, r.address_normalized, r.address_city, r.point_flags) for r in step(df).orderBy("ingest_seq").collect()]


def test_merge_clients(spark):
    rows = [("Альфа Бета ООО", "", "Мира 1", ""), ("ООО Альфа Бета", "", "ул. Мира, д. 1", ""), ("Альфа Бета ООО", "", "Иная 5", ""), ("ИП Альфа Бета", "", "Мира 1", ""), ("Гамма", "", "Мира 1", "")]
    assert [r[0] for r in run(spark, rows, reconcile.merge_clients)] == ["ООО Альфа Бета", "ООО Альфа Бета", "ООО Альфа Бета", "ИП Альфа Бета", "Гамма"]


def test_swap_roles(spark):
    rows = [("Owner", "Sign", "", "")] * 2 + [("Sign", "", "", "")] + [("One", "Net", "", ""), ("Two", "Net", "", ""), ("Net", "", "", "")]
    assert [r[:2] for r in run(spark, rows, reconcile.swap_roles)] == [("Owner", "Sign")] * 2 + [("Owner", "Sign"), ("One", "Net"), ("Two", "Net"), ("Net", "")]
    assert [r[0] for r in run(spark, rows[1:3], reconcile.swap_roles)] == ["Sign", "Sign"]


def test_address_ladder(spark):
    rows = [("A", "", "Бург, Мира 1", "Бург"), ("A", "", "Мира 1", ""), ("A", "", "Новая 2", ""), ("B", "", "Град, X 1", "Град"), ("B", "", "Бург, Y 1", "Бург"), ("B", "shop Град", "Z 1", ""), ("C", "", "W 1", ""), ("C", "", "office", ""), ("D", "", "бург, Q 1", "бург"), ("E", "", "Бург, Q 2", "Бург")]
    got = run(spark, rows, lambda d: reconcile.reconcile_addresses(d))
    assert [r[2] for r in got] == ["Бург, Мира 1", "Бург, Мира 1", "Бург, Новая 2", "Град, X 1", "Бург, Y 1", "Град, Z 1", "W 1", "office", "Бург, Q 1", "Бург, Q 2"]
    assert run(spark, rows, lambda d: reconcile.reconcile_addresses(d, "Дом"))[6][2:4] == ("Дом, W 1", "Дом")


def test_backfill_and_forms(spark):
    rows = [("", "", "Бург, Мира 1", "Бург"), ("A", "", "Бург, Мира, д. 1", "Бург"), ("", "", "Бург, X 2", "Бург"), ("B", "", "Бург, X 2", "Бург"), ("C", "", "Бург, X 2", "Бург"), ("", "", "Мира 1", ""), ("", "Sign", "Бург, Y 3", "Бург"), ("", "", "Бург, Y 3", "Бург")]
    got = run(spark, rows, reconcile.backfill_identity)
    assert [r[:2] for r in got] == [("A", ""), ("A", ""), ("", ""), ("B", ""), ("C", ""), ("A", ""), ("", "Sign"), ("", "Sign")]
    assert [bool(r[4]) for r in got] == [True, False, False, False, False, True, False, True]
    forms = [("Home Pro", "", "M 1", ""), ("home", "", "M 1", ""), ("Home Pro", "", "N 2", ""), ("Home Franch", "", "N 2", ""), ("Home", "", "N 2", "")]
    assert [r[0] for r in run(spark, forms, lambda d: reconcile.fill_forms(d, QUALIFIERS))] == ["Home Pro", "Home Pro", "Home Pro", "Home Franch", "Home"]


def test_flags_keys_and_ties(spark):
    rows = [("A", "Sign", "M 1", ""), ("B", "sign", "M 1", ""), ("A", "Home Pro North", "N 2", ""), ("A", "Home Pro South", "N 2", ""), ("", "", "K", ""), ("", "", "", "")]
    got = run(spark, rows, lambda d: reconcile.flag_shared(d, QUALIFIERS))
    assert [r[4] for r in got] == [["one sign, several owners"]] * 2 + [["territories differ"]] * 2 + [[], []]
    df = reconcile.add_point_key(reconcile.prepared(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FIELDS)))
    assert [r.point_key for r in df.orderBy("ingest_seq").collect()][3:] == ["A | N 2", "K", None]
    assert [r[0] for r in run(spark, [("Аб", "", "", ""), ("аб", "", "", "")], reconcile.canonicalise)] == ["Аб", "Аб"]


def test_reconcile_keeps_rows_whatever_the_partitions(spark, sf):
    rows = messy(spark, sf)
    facts = lambda d: Counter(tuple(r) for r in reconcile.flags_text(d).select("ingest_seq", "client_normalized", "point_name", "address_normalized", "address_city", "point_key", "point_flags").collect())
    one = facts(reconcile.reconcile(rows, queries.QUALIFIERS, "DEFAULT"))
    assert one == facts(reconcile.reconcile(rows.repartition(7), queries.QUALIFIERS, "DEFAULT")) and sum(one.values()) == rows.count()


def test_report_lists_every_change(spark, sf):
    rows = messy(spark, sf)
    out, report = reconcile.reconcile_with_report(rows, queries.QUALIFIERS, "DEFAULT")
    fields = [*reconcile.FIELDS, "point_flags"]
    start = {r.ingest_seq: [r[c] for c in fields] for r in reconcile.flags_text(reconcile.prepared(rows)).collect()}
    order = {name: i for i, (name, _) in enumerate(reconcile.steps({}, None))}
    for r in sorted(report.collect(), key=lambda r: order[r.step]):
        own = start[r.ingest_seq]
        assert own[fields.index(r.column)] == r.old != r.new
        own[fields.index(r.column)] = r.new
    assert start == {r.ingest_seq: [r[c] for c in fields] for r in reconcile.flags_text(out).collect()}
    counts = {(r.step, r.column): r.n for r in reconcile.report_counts(report).collect()}
    assert sum(counts.values()) == report.count() and ("default_cities", "address_city") in counts


def test_answer_has_facts_and_numbers(spark, sf):
    said = tools.format_answer(tools.search_client_by_date(tickets(spark, sf), "#", date_from="1996-02-01", date_to="1996-02-29"), "so it is", 5)
    rows = said.preview_data.collect()
    assert [r.no for r in rows] == [1, 2, 3, 4, 5] and [r.Date for r in rows] == sorted((r.Date for r in rows), reverse=True)
    assert re.fullmatch(r"tickets: \d+, last on 1996-02-\d\d 00:00:00, 1996-02-01 to 1996-02-29", said.summary) and said.answer == "so it is"
    assert tools.format_answer(tools.get_top_clients(tickets(spark, sf))).preview_data.columns[0] == "no"


def test_date_text_alone_is_filtered(spark):
    df = spark.createDataFrame([(1, "03.02.2024"), (2, "2024-02-09 10:00:00"), (3, "soon"), (4, None)], "id int, date string")
    assert [r.id for r in dates.filter_by_date(df, date_from="2024-02-01", date_to="2024-02-05").collect()] == [1]
    assert sorted(r.id for r in dates.filter_by_date(df).collect()) == [1, 2] and dates.filter_by_date(df.drop("date")).count() == 4


@pytest.mark.parametrize(
    ("raw", "want"),
    [("заявка от 3/2/2024 9:05 вечер", "2024-02-03 09:05:00"), ("on 03-02-24, x", "2024-02-03 00:00:00"), ("3 Feb 2024 10:00:05", "2024-02-03 10:00:05"), ("3 december, 2024", "2024-12-03 00:00:00"), ("at 2024-2-3 10:11", "2024-02-03 10:11:00"), ("31.02.2024", "31.02.2024"), ("12345", "12345"), ("1-2-3", "1-2-3")],
)
def test_dates_inside_texts(spark, raw, want):
    assert scalar(spark, dates.date_text(F.col("x")), x=raw) == want


def test_numbers_by_ranges(spark):
    df = spark.range(0, 5000).select(F.expr("(id * 7919) % 5000").alias("v"))
    got = aggregates.numbered_by_ranges(df.repartition(5), F.desc("v")).collect()
    assert sorted((r.no, r.v) for r in got) == [(i + 1, 4999 - i) for i in range(5000)]


def test_reactions_are_logged(spark, tmp_path):
    log = store.QueryLog(spark, str(tmp_path / "log"))
    log.add("question", "q")
    log.react("q", "up", "thanks")
    assert {(r.kind, r.summary) for r in log.read().collect()} == {("question", ""), ("reaction", "up thanks")}


def test_deduplicate_keeps_rows_without_id(spark):
    df = spark.createDataFrame([("1-1", 2), ("1-1", 1), ("", 3), ("", 4), (None, 5), (" ", 6)], "ticket_id string, ingest_seq long")
    assert sorted(r.ingest_seq for r in reconcile.deduplicate(df).collect()) == [1, 3, 4, 5, 6]


# --- tools, router, streaming


def test_tools_and_router(spark, sf, tmp_path):
    kept = sheets.Tickets(spark, str(tmp_path / "t"))
    kept.write(tickets(spark, sf))
    log = store.QueryLog(spark, str(tmp_path / "log"))
    engine = router.Engine(kept, log=log)
    every = [{"table_name": t, "sheet_name": s} for t in ("odd", "even") for s in "FOP"]
    tool, result = engine.ask("Топ 5: кто чаще обращается", every)
    assert tool == "get_top_clients" and result.table.count() == 5
    assert engine.ask("что-то другое", every) == ("No tool fits the question.", None)
    assert router.Engine(kept, choose=lambda q: '```json\n{"tool": "nope"}\n```').ask("x", every)[0].startswith("The question could not")
    assert log.read().count() == 2 and log.keep(0) and log.keep(10**9) == []
    with pytest.raises(ValueError):
        tools.execute_tool("nope", {}, kept.all())
    with pytest.raises(ValueError):
        tools.execute_tool("search_client", {"name": "x"}, kept.all())


@pytest.mark.parametrize(
    ("question", "tool", "arguments"),
    [
        ("топ точек топ-7", "get_top_points", {"n": 7}),
        ("частые проблемы", "get_top_problems", {"n": 20}),
        ("сканер у ромашка", "search_combined", {"client_query": "ромашка", "problem_query": "сканер"}),
        ("клиент ромашка плюс", "search_client", {"client_name": "ромашка плюс"}),
        ("точка мира 1", "search_point", {"point_query": "мира 1"}),
        ("касса не работает", "search_problem", {"problem_query": "касса"}),
    ],
)
def test_keywords(question, tool, arguments):
    assert router.by_keywords(question) == {"tool": tool, "arguments": arguments}


def test_extract_json():
    assert tools.extract_json('```json\n["a"]\n```') == ["a"] and tools.extract_json('so: {"a": 1} ok') == {"a": 1} and tools.extract_json("none") is None


def test_streams(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    for name, df in (("firsts", refresh.first_of_each(stream, "event_id", "ts")), ("days", refresh.daily_counts(stream, "event_type", "ts", "400 days"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "firsts" else "complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("firsts").count() == events.select("event_id").distinct().count()
    assert spark.table("days").agg(F.sum("n")).first()[0] == events.count()


def test_sheets_and_runs_cover_whole_tables(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    assert queries.grid(spark, sf).filter("row_idx >= 5 and _sheet_name <> 's3'").count() == orders.count() > 400


def test_each_user_has_a_run(spark):
    rows = [(u, f"2024-01-{d:02d} 0{u}:00:00") for u, days in ((1, (1, 2, 5, 6, 7)), (2, (1, 2, 3)), (3, (1, 3))) for d in days]
    df = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    got = dates.filter_by_date(df, consecutive_days=3, ts="ts", by=["user_id"])
    assert sorted((r.user_id, r.ts.day) for r in got.collect()) == [(1, 5), (1, 6), (1, 7), (2, 1), (2, 2), (2, 3)]
