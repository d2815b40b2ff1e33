"""License scans, whitening and the prefix trie against plain versions of them."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.oracle import differences
from tidemark.llm import licenses, prefix_trie, queries, whitening

# --- licenses


def plain_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted(i for phrase in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    labels = sorted({label for phrase, label in licenses.BASE.items() if f" {phrase} " in f" {' '.join(words)} "})
    return len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(labels)


TEXTS = [
    "MIT License mit license MIT-license", "mit  \n license!apache.license", "summit license", "mit licenses", "İMIT License éMIT license", "general public license general public license", "the gnu lesser general public license",
    "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+\n", "spdx license identifier without an expression", "SPDX-License-Identifier: MIT SPDX-License-Identifier: ISC", "x" * 5, "mit license " * 30_000, "\x00mit\x7flicense",
]


def licensed(spark, rows):
    return {r["doc_id"]: r for r in licenses.digest(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, findings string, n_words string"))).collect()}


def test_base_phrases_are_found_as_by_a_plain_search(spark):
    found = licensed(spark, [(i, t, "x", None) for i, t in enumerate(TEXTS)] + [(100, None, None, None), (101, "", None, None)])
    for i, t in [*enumerate(TEXTS), (100, None), (101, "")]:
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(t), t[:40]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert found[7]["labels"] == "apache-2.0,gpl-2.0+,mit" and found[9]["labels"] == "isc,mit" and found[8]["labels"] == ""
    assert found[6]["labels"] == "gpl,lgpl" and found[100]["score"] == 0


def test_repeated_rows_missing_ids_and_empty_tables(spark, odd, none):
    rows = licenses.digest(licenses.scan_licenses(odd)).collect()
    assert len(rows) == odd.count() and sum(r["doc_id"] is None for r in rows) == 1
    assert licenses.digest(licenses.scan_licenses(none)).count() == 0


@pytest.mark.parametrize(
    "text, level",
    [
        ("mit", 0.2), ("mit or gpl-3.0", 0.2), ("mit and gpl-3.0", 0.7), ("mit or gpl-3.0 and agpl-3.0", 0.2), ("(mit or gpl-3.0) and agpl-3.0", 0.9), ("gpl-2.0 with classpath-exception-2.0", 0.5),
        ("agpl-3.0 or gpl-2.0 with x and mit", 0.5), ("mit or", 0.2), ("(agpl-3.0 and (mit", 0.9), ("mit) and agpl-3.0", 0.2), ("mit is a licence", 0.2), ("unheard-of", 0.5), ("cc-by-nc-4.0 or cc-by-4.0", 0.2),
    ],
)
def test_expressions_evaluate_by_rank_of_their_operators(text, level):
    assert licenses.parsed(text.encode())[2] == pytest.approx(level)


def test_no_expression():
    assert all(licenses.parsed(t) is None for t in (b"", b"and mit", b"((", b") mit", b"x" * 65))


# --- whitening


def test_small_eigenvalues_are_accurate():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    # A graded matrix D C D with C well-conditioned has eigenvalues of full relative accuracy.
    c, grade = q @ np.diag(rng.uniform(1, 2, 24)) @ q.T, 10.0 ** -np.arange(24)
    values, vectors = whitening.jacobi(c * np.outer(grade, grade))
    # Those of the inverse, which is graded the other way, come from the largest down.
    inverse = whitening.jacobi(np.linalg.inv(c) / np.outer(grade, grade))[0]
    assert np.abs(values * inverse[::-1] - 1).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(24)).max() < 1e-13
    m = rng.normal(size=(7, 40)) @ rng.normal(size=(40, 7))
    m = m + m.T
    values, vectors = whitening.jacobi(m)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1]) and np.allclose(vectors * values @ vectors.T, m)
    assert whitening.jacobi(np.zeros((1, 1)))[0] == [0] and (whitening.jacobi(np.zeros((4, 4)))[1] == np.eye(4)).all()


def plain_whitening(rows, k=8):
    good = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    total = [sum(r[j] for r in x) for j in range(d)]
    z = np.array([[n * r[j] - total[j] for j in range(d)] for r in x], dtype=object)
    deviation = (z**2).sum(axis=1)
    y = np.array(z / n, dtype=float)
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return {i: (dev, w) for (i, _), dev, w in zip(good, deviation, y @ v / np.sqrt(e), strict=True)}, e, n


def test_whitened_vectors_match_a_plain_version(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in np.float32(rng.normal(size=10) * np.arange(1, 11) / 7)]) for i in range(300)]
    rows += [(1000, None), (1001, [None] * 10), (1002, [float("nan")] * 10), (1003, [float("inf")] * 10), (None, rows[0][1]), (1004, [1.0] * 3)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n string")
    got = defaultdict(dict)
    for r in whitening.whiten(frame).collect():
        got[r["vec_id"]][r["component"]] = r
    want, e, n = plain_whitening(rows[:-1])
    assert set(got) == set(want)
    signs = np.sign([got[5][c]["whitened"] * want[5][1][c - 1] for c in range(1, 9)])
    for i, (deviation, w) in want.items():
        assert sorted(got[i]) == list(range(1, 9)) and got[i][1]["n"] == n and int(got[i][1]["deviation"]) == deviation
        assert np.allclose([got[i][c]["whitened"] for c in range(1, 9)] * signs, w, atol=1e-9)
    assert got[5][1]["identity_error"] < 1e-9 and got[5][2]["explained"] == pytest.approx(e[1] / whitening.whiten(frame, k=10).filter("vec_id = 5").selectExpr("1 / sum(explained) as s").first()["s"] / sum(np.linalg.eigvalsh(np.cov(np.array([np.floor(1024 * np.array(v)) for _, v in rows[:300]] + [np.floor(1024 * np.array(rows[0][1]))]).T, bias=True))))


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    alike = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).collect()
    assert len(alike) == 6 and all(r["whitened"] == 0 and r["deviation"] == 0 and r["identity_error"] == 1 for r in alike)
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 3.0])], schema)).collect()
    x = [[1 << 40, 100_000], [-(1 << 40), 101_024], [105_120, 103_072]]
    for r in far:
        own, n = x[r["vec_id"] - 1], 3
        assert int(r["deviation"]) == sum((n * own[j] - sum(y[j] for y in x)) ** 2 for j in range(2)) and np.isfinite(r["whitened"])


def test_products_are_exact_beyond_doubles():
    z = np.floor(np.random.default_rng(0).normal(size=(100, 5)) * 2**38)
    own = z.astype(np.int64).astype(object)
    assert (whitening.products(z) == own.T @ own).all()


# --- prefix trie


def plain_rebuilt(turns):
    held = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            held[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda a: a[0])] for c, v in held.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def plain_trie(chats):
    members = defaultdict(list)
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    ends = {node: ",".join(str(c) for c in sorted(m) if len(chats[c]) == len(node)) for node, m in members.items()}
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends[node].encode()).hexdigest()) for node, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, depth string"


def trie_of(spark, turns, plain=False, block=prefix_trie.BLOCK):
    ranked = prefix_trie.ranked(spark.createDataFrame([(*t, "x") for t in turns], TURNS))
    found = prefix_trie.with_ends(*prefix_trie.prefix_trie(prefix_trie.as_conversations(ranked) if plain else prefix_trie.rebuilt(ranked), block))
    return sorted(tuple(r) for r in found.select(*COLUMNS).collect())


def some_chats(seed, n, longest, kinds):
    rng = np.random.default_rng(seed)
    return [(int(c), int(t) if t else None, ["user", "assistant", None][t % 3], [None, "", "hé", "x" * 5, "y"][int(rng.integers(kinds))]) for c in rng.choice(3 * n, n, replace=False) for t in range(int(rng.integers(1, longest)))]


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 3)])
def test_tries_match_a_plain_version(spark, seed, block):
    turns = some_chats(seed, 120, 12, 3)
    assert trie_of(spark, turns, block=block) == plain_trie(plain_rebuilt(turns))


def test_deep_tries_take_few_rounds(spark, monkeypatch):
    """Each conversation is the one before and one more turn, and each also ends in a turn of its own: plain peeling takes a round for each depth."""
    turns = [(c, t, "user", "same" if t < c else f"own {c}") for c in range(40) for t in range(c + 1)]
    cut, rounds = prefix_trie.cut_lineage, []
    monkeypatch.setattr(prefix_trie, "cut_lineage", lambda df: rounds.append("waits" in df.columns) or cut(df))
    chats = {c: [("user", "same" if t < c else f"own {c}") for t in range(c + 1)] for c in range(40)}
    assert trie_of(spark, turns, plain=True, block=7) == plain_trie(chats)
    assert sum(rounds) <= 8


def test_odd_conversations(spark):
    same = [(c, t, "user", f"t{t}") for c in range(30) for t in range(12)]
    odd = [*same, (None, 1, "user", "lost"), (77, None, None, None), (77, 1, "user", "x"), (78, 3, "user", "a" * 100_000), (79, 1, None, "b"), (1000, 2, "user", "late"), (1000, 1, "user", "soon")]
    assert trie_of(spark, odd) == plain_trie(plain_rebuilt(odd))
    # Turns of one number and repeated rows stand in an order of their content, so that conversations that hold the same are one.
    tied = trie_of(spark, [(5, 1, "user", "a"), (5, 1, "user", "b"), (5, 1, "user", "a"), (10, 1, "user", "b"), (10, 1, "user", "a"), (10, 1, "user", "a")], plain=True)
    assert [r[3] for r in tied] == [2, 2, 2, 2]
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "user", "x")]) == []


def test_long_lists_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = spark.createDataFrame([(i % 3 // 2, 1, i) for i in range(1000)], "conv_id long, depth long, ends long")
    got = {r["conv_id"]: r["sha256"] for r in prefix_trie.hashed_lists(rows, ["conv_id", "depth"], "ends").collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(1000) if i % 3 // 2 == k).encode()).hexdigest() for k in (0, 1)}


@pytest.mark.parametrize("name", ["op11_scan_licenses", "op13_prefix_trie"])
def test_queries_match_sql(spark, sf, name):
    assert differences(spark, sf, name, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def test_whitening_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, _, n = plain_whitening(rows)
    got = queries.op12_whiten(spark, sf).collect()
    assert len(got) == 8 * n == 8 * len(rows)
    assert all(r["deviation"] == want[r["vec_id"]][0] and r["identity_error"] < 1e-4 and abs(abs(r["whitened"]) - abs(want[r["vec_id"]][1][r["component"] - 1])) < 1e-6 for r in got)
