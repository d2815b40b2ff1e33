"""Providers by rules, the contracts that hold any provider, and the glossary for a column."""

import pytest

from tests.oracle import differences
from tidemark.functions import similarity
from tidemark.operators import glossary, providers
from tidemark.plans import queries
from tidemark.schema import UNASSIGNED
from tidemark.sources import store

ADDRESSES = [
    ("г Бург, ул Белинского, д 86, помещ 98", "Бург", "Белинского", "86", "", "98"),
    ("г. Град, д. Дербыши, Трактовая, 1ж", "Дербыши", "Трактовая", "1ж", "", ""),
    ("пгт Мортка, 4 мкрн, 7, корп. 2", "Мортка", "мкр. 4", "7", "2", ""),
    ("Бург, Светлый м-н, 5", "Бург", "мкр. Светлый", "5", "", ""),
    ("офис", "", "офис", "", "", ""),
    ("Томина/Урицкого, 3", "Томина/Урицкого", "", "3", "", ""),
    ("", "", "", "", "", ""),
    (" , ,", "", "", "", "", ""),
]


@pytest.mark.parametrize(("address", "city", "street", "house", "korpus", "apartment"), ADDRESSES)
def test_pairs_by_rules(address, city, street, house, korpus, apartment):
    got = providers.pairs_by_rules([("Ромашка ООО", address)])["Ромашка ООО", address]
    assert tuple(got[f] for f in providers.PAIR_FIELDS) == ("ООО Ромашка", "", "", city, street, house, korpus, apartment)


def test_qualifier_ends_the_address():
    got = providers.pairs_by_rules([("ФУД РИТЭЙЛ", "Бург, Крауля, д. 6 / Марчук"), ("", "Бург, Крауля, д. 6 / Марчук")])
    first, second = got["ФУД РИТЭЙЛ", "Бург, Крауля, д. 6 / Марчук"], got["", "Бург, Крауля, д. 6 / Марчук"]
    assert (first["client_qualifier"], first["house"]) == ("ИП Марчук", "6") and second["client_qualifier"] == ""


def test_any_provider_of_pairs_is_held():
    rows = {
        ("Проф Сургут", "Мира 1"): {"client_normalized": " Проф ЗАО", "city": "Сургут", "client_qualifier": "ИП Иванов", "street": "ул. Мира", "house": 1, "junk": "x"},
        ("А", "Екб, Мира"): {"city": "Екатеринбург", "client_qualifier": None},
        ("Сургут", "г. Сургут"): {"city": "г. Сургут"},
        ("Б", ""): {"city": "Бург"},
        ("В", "x"): "no row",
    }
    got = providers.pairs_held(lambda items: rows)(list(rows))
    row = got["Проф Сургут", "Мира 1"]
    assert list(row) == list(providers.PAIR_FIELDS)
    assert (row["client_normalized"], row["city"], row["client_qualifier"], row["street"], row["house"]) == ("ЗАО Проф", "", "", "Мира", "1")
    assert got["А", "Екб, Мира"]["city"] == "Екатеринбург" and got["Сургут", "г. Сургут"]["city"] == "Сургут" and got["Б", ""]["city"] == "" and ("В", "x") not in got


def test_any_provider_of_problems_is_held():
    rows = {"a": {"normalized": "1 2 3 4 5 6 7 8", "tags": ["C", "no", "B", "C", "A", "D"]}, "b": {"normalized": " ", "tags": "C"}, "c": None}
    assert providers.problems_held(lambda items: rows, list("ABCD"))(["a", "b", "c"]) == {"a": {"normalized": "1 2 3 4 5 6 7", "tags": ["C", "B", "A"]}, "b": {"normalized": "b", "tags": [UNASSIGNED]}}
    ask = providers.problems_by_rules([("Scanner", "reads codes"), ("Printer", "paper, codes")])
    got = ask(["Printer takes no paper", "codes", "hello"])
    assert [got[t]["tags"] for t in ("Printer takes no paper", "codes", "hello")] == [["Printer"], ["Scanner", "Printer"], [UNASSIGNED]]


def near(terms, said, k, least):
    """(term, score), as read from the description: best name of each term, in order."""
    best = {}
    for t in terms:
        for name in (t.term.lower(), *(a.lower() for a in t.aliases)):
            q = said.strip().lower()
            score = max(similarity.token_sort_ratio(q, name), 85 if name in q or q in name else 0)
            if score >= least:
                best[t.term] = max(score, best.get(t.term, 0))
    return sorted(best.items(), key=lambda x: -x[1])[:k]


@pytest.mark.parametrize(("k", "least"), [(5, 50), (2, 30), (1, 86)])
def test_glossary_of_a_column(spark, k, least):
    terms = [store.Term("Касса", aliases=("ккт", "касса онлайн")), store.Term("Scanner", aliases=("code reader", "reader of codes")), store.Term("Pos", aliases=("касса",)), store.Term("é")]
    texts = ["касса", "Онлайн касса!", "reader code", " scaner ", "сломалась касса и scanner", "zz", "", "  ", None, "касса", "x" * 5000, "%_\\"]
    rows = spark.createDataFrame([(t, 1) for t in texts], "said string, term int")
    got = {}
    for r in sorted(glossary.lookup(rows, store.Glossary(terms), "said", k, least).collect(), key=lambda r: r["rank"]):
        got.setdefault(r[0], []).append((r["term"], r["score"]))
        assert r["rank"] == len(got[r[0]])
    want = {t: near(terms, t, k, least) for t in texts if t and t.strip()}
    assert got == {t: w for t, w in want.items() if w}
    assert glossary.lookup(rows, store.Glossary([]), "said").count() == 0 and glossary.lookup(rows.limit(0), store.Glossary(terms), "said").count() == 0


def test_glossary_query_by_brute_force(spark, sf):
    got = {}
    for r in sorted(queries.glossary_matches(spark, sf).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.said, []).append((r.term, r.score))
    said = {x for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name", "p_type").collect() for x in r}
    want = {t: near(queries.TERMS, t, 3, 50) for t in said}
    assert got == {t: w for t, w in want.items() if w} and len(got) > 3


NEW = ["problems_by_rules_of_words", "pairs_with_kinds", "word_sets", "legal_form_sets", "sheets_united", "raw_preview", "analyst_rows", "answer_envelope"]


@pytest.mark.parametrize("name", NEW)
def test_new_queries_have_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0 and not differences(spark, sf, name, queries.QUERIES[name], queries.SQL[name])
