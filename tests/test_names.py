"""Similar names of a house, components, and scores of whole batches, against plain versions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.test_engine import brute_renames
from tidemark.functions import similarity
from tidemark.operators import reconcile
from tidemark.operators.components import components
from tidemark.plans import queries


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def plain_ratio(a, b):
    return round(200 * plain_common(a, b) / (len(a) + len(b))) if a and b else 0


def plain_words(s):
    return re.sub(r"\W", " ", re.sub("[\x80-\xff]", "", s or "")).lower().split()


def plain_sort(a, b):
    return plain_ratio(" ".join(sorted(plain_words(a))), " ".join(sorted(plain_words(b))))


def plain_set(a, b):
    x, y = set(plain_words(a)), set(plain_words(b))
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    left, right = (f"{both} {' '.join(sorted(own))}".strip() for own in (x - y, y - x))
    return max(plain_ratio(both, left), plain_ratio(both, right), plain_ratio(left, right))


def some_pairs(n, seed=1):
    rng = random.Random(seed)
    parts = ["альфа", "бета", "ооо", "ип", "gamma", "Delta", "é", "naïve", "x", "yy", "1", "№5", "🙂", "\0", "İ"]
    name = lambda: " ".join(rng.choice(parts) + rng.choice(["", "", "a"]) for _ in range(rng.randint(0, 6)))
    long = lambda k: "".join(rng.choice("abc d") for _ in range(k))
    return [(name(), name()) for _ in range(n)] + [(long(k), long(rng.randint(0, 150))) for k in (1, 7, 8, 9, 16, 17, 32, 33, 63, 64, 65, 127, 128, 129, 200)]


@pytest.mark.parametrize("name, plain", [("ratio", plain_ratio), ("token_sort_ratio", plain_sort), ("token_set_ratio", plain_set)])
def test_scores_of_a_batch_match_a_plain_version(name, plain):
    pairs = some_pairs(3000)
    got = getattr(similarity, f"{name}s")([a for a, _ in pairs], [b for _, b in pairs])
    assert [(p, int(s)) for p, s in zip(pairs, got, strict=True)] == [(p, plain(*p)) for p in pairs]
    assert getattr(similarity, name)(None, "a") == 0 and getattr(similarity, name)("a b", "a b") == 100


def test_ratios_of_parts_by_exact_rows(spark, sf):
    rows = queries.fuzzy_ratios(spark, sf).collect()
    parts = {r["p_partkey"]: (r["p_name"], r["p_type"]) for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    assert len(rows) == len(parts)
    for r in rows:
        p = parts[r["p_partkey"]]
        assert (r["ratio"], r["token_set"], r["token_sort"]) == (plain_ratio(*p), plain_set(*p), plain_sort(*p))


def test_categories_of_parts_by_exact_rows(spark, sf):
    names = ["Economy", "Standard", "Standard part", "Promo: large", "Medium or small"]
    for r in queries.category_match(spark, sf).collect():
        scored = [(plain_set(r["problem_raw"], c), len(c), -i, c) for i, c in enumerate(names)]
        best = max(s for s in scored)
        assert r["category"] == (best[3] if best[0] >= 90 else None)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_names_that_merge_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    short = ["аб", "вг", "ип", "ооо", "а", "б", "1", "22", "дом", "ёж"]
    mixed = [*short, "альфа", "альфы", "бета", "гамма"]
    names = [" ".join(rng.choice(short if rng.random() < 0.7 else mixed) for _ in range(rng.randint(1, 6))).title() for _ in range(220)]
    rows = [(f"дома{i % 2}", n) for i, n in enumerate(names)]
    frame = spark.createDataFrame([(i, n, "", f"Дома {i % 2}", "") for i, (_, n) in enumerate(rows)], "ingest_seq long, client_normalized string, point_name string, address_normalized string, address_city string")
    want = brute_renames(rows)
    assert {r.name: r.canonical for r in reconcile.client_renames(reconcile.prepared(frame)).collect()} == want and len(want) > 10


def test_a_house_of_many_names_with_a_common_word(spark):
    rng = random.Random(1)
    part = lambda k: "".join(rng.choice(["ка", "ро", "ми", "лу", "сте", "вар", "но", "ти"]) for _ in range(k))
    names = spark.createDataFrame([("улица1", f"ООО Компания {part(4)} {part(3)}") for _ in range(10_000)], "fp string, name string").distinct()
    began = time.time()
    reconcile.similar_names(names, 85).count()
    assert time.time() - began < 60


def test_components(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randint(0, 300):03}", f"n{rng.randint(0, 300):03}") for _ in range(200)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(100)] + [("s", f"t{i}") for i in range(100)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}
    pairs = spark.createDataFrame([(1, "b", 1, "a"), (2, "b", 2, "a")], "f int, x string, g int, y string").select(F.struct("f", "x").alias("a"), F.struct(F.col("g").alias("f"), F.col("y").alias("x")).alias("b"))
    assert {(tuple(r.node), tuple(r.root)) for r in components(pairs).collect()} == {((1, "b"), (1, "a")), ((2, "b"), (2, "a"))}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
