import hashlib
import json
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DATA
from tests.llm.test_documents import brute_similar, merged, poisson_count, unit
from tidemark.llm import ann, chat, langid, warc
from tidemark.llm.queries import labelled

# --- 4: chat

TURNS = "conv_id long, turn long, role string, text string, rendered string"


def brute_cost(roles):
    """The least cost over all roles and merges, empty messages counted by a search of their own."""
    best = None
    for new in product(range(3), repeat=len(roles)):
        for merged in product((False, True), repeat=len(roles)):
            cost, state = 0, 3
            for role, n, m in zip(roles, new, merged, strict=True):
                cost += chat.RELABEL * (role != n)
                if m:
                    if n != state:
                        break
                    cost += chat.MERGE
                else:
                    path = chat.inserted(state, n)
                    if path is None:
                        break
                    cost += chat.INSERT * len(path)
                state = n
            else:
                cost += chat.INSERT * len(chat.ending(state))
                best = cost if best is None else min(best, cost)
    return best


def messages(text):
    return [m.split("|>\n", 1) for m in text.split("<|end|>\n")[:-1] for m in [m.removeprefix("<|")]]


def legal(roles):
    body = roles[1:] if roles and roles[0] == "system" else roles
    return len(body) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body))


def check_chats(rows, got):
    convs = defaultdict(list)
    for r in got:
        convs[r.conv_id].append(r)
    assert Counter(r.conv_id for r in rows) == Counter(r.conv_id for r in got)
    for conv, own in convs.items():
        own.sort(key=lambda r: r.place)
        text = "".join(r.rendered for r in own)
        found = messages(text)
        assert text.endswith(chat.TAIL) and legal([m[0] for m in found])
        assert len({r.cost for r in own}) == 1
        assert sum(text.count(t) >= 1 for t in (r.text for r in rows if r.conv_id == conv and r.text)) == sum(bool(r.text) for r in rows if r.conv_id == conv)
        if len(own) <= 6:
            assert own[0].cost == brute_cost([chat.role_of(r.old_role) for r in own])


def test_repair_is_the_cheapest():
    for n in range(1, 5):
        for roles in product((0, 1, 2, None), repeat=n):
            fixed, begin, end = chat.repair(list(roles))
            cost = chat.costs_from([chat.NEVER] * 3 + [0], list(roles))[end] + chat.END_COST[end]
            assert begin == 3 and len(fixed) == n and cost == brute_cost(roles)


def test_chats_of_the_table(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    check_chats(turns.collect(), chat.format_chats(turns).collect())


def test_chats_odd_rows(spark):
    rows = [(1, 0, "user", "hi", None), (1, 1, None, "who", None), (1, 1, None, "who", None), (None, 0, "assistant", None, None), (None, None, "SYSTEM ", "", None), (2, 5, "tool", "x" * 50_000, None), (3, 0, "system", "s", None), (3, 1, "system", "t", None)]
    turns = spark.createDataFrame(rows, TURNS)
    check_chats(turns.collect(), chat.format_chats(turns).collect())
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_long_chat_over_many_tasks(spark):
    rng = np.random.default_rng(1)
    roles = [["user", "assistant", "system", "tool"][i] for i in rng.choice(4, 3000, p=[0.45, 0.45, 0.05, 0.05])]
    rows = [(7, i, r, f"turn {i}.", None) for i, r in enumerate(roles)] + [(c, i, "user", f"short {c} {i}.", None) for c in (6, 8) for i in range(3)]
    got = chat.format_chats(spark.createDataFrame(rows, TURNS).repartition(3)).collect()
    own = sorted((r for r in got if r.conv_id == 7), key=lambda r: r.turn)
    assert [r.place for r in own] == sorted(r.place for r in own) and len({r.place >> 33 for r in own}) > 2
    assert legal([m[0] for m in messages("".join(r.rendered for r in own))])
    costs = chat.costs_from([chat.NEVER] * 3 + [0], [chat.role_of(r) for r in roles])
    assert {r.cost for r in own} == {min(c + chat.END_COST[s] for s, c in enumerate(costs))}
    parts = "".join(r.rendered for r in own)
    spent = sum(chat.RELABEL * (r.role != r.old_role) for r in own) + chat.INSERT * sum(m[1] == "" for m in messages(parts)) + chat.MERGE * sum(r.action == "merge" for r in own)
    assert {r.cost for r in own} == {spent}


# --- 7: nearest neighbours


def brute_nearest(rows, queries, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    out = []
    for q in queries:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out += [(q, n, int(ids[j]), float(s[j])) for n, j in enumerate(order, 1)]
    return out


def same_nearest(got, want):
    assert [(a[0], a[1]) for a in got] == [(a[0], a[1]) for a in want]
    assert np.allclose([a[3] for a in got], [a[3] for a in want], rtol=0, atol=1e-12)
    assert sum(a[2] != b[2] for a, b in zip(got, want, strict=True)) <= 0.001 * len(want)


@pytest.mark.parametrize("block", [4096, 97])
def test_nearest_by_brute_force(spark, sf, block):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = sorted(tuple(r) for r in ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), block=block).collect())
    same_nearest(got, sorted(brute_nearest(rows, sorted(i for i, _ in rows if i % 20 == 0), 20)))


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], None), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [], 1), (None, [1.0, 1.0], 1), (9, [-1.0, 0.5], 1), (9, [-1.0, 0.5], 1), (10, [1.0, 2.0, 3.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in ann.nearest(vectors, vectors.filter("vec_id % 20 = 0 or vec_id = 10"), k=3).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 9, -1.0)]
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_nearest_of_all_finite_vectors(spark):
    """Components whose squares leave the range of doubles, on both ends, and ids that repeat."""
    tiny = 5e-324
    rows = [(0, [1e160, 1.0]), (20, [1e160, 1.0]), (40, [1e-170, tiny]), (60, [tiny, 0.0]), (1, [1.0, 0.0]), (2, [1e-170, 1e-170]), (3, [1e200, -1e200]), (5, [0.0, 1e300]), (7, [2.0, 1.0]), (7, [9.0, 9.0]), (80, [1.0, 1.0]), (80, [1.0, 2.0]), (80, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=7, block=3).collect())
    want = []
    for i, (q, x) in enumerate(rows):
        if q % 20 == 0:
            with np.errstate(over="ignore"):
                scores = [(-float(np.float64(x[0]) * y[0] + np.float64(x[1]) * y[1]), c) for j, (c, y) in enumerate(rows) if j != i]
            want += [(q, n, c, -s) for n, (s, c) in enumerate(sorted(scores)[:7], 1)]
    assert got == sorted(want)
    assert {r[2] for r in got if r[0] == 80} >= {7, 80}


def test_nearest_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 64)) * rng.lognormal(size=(300, 1), sigma=3), rng.normal(size=(500, 64))
    qi, ci, s = ann.tile(np.arange(300), x, np.arange(500) + 1000, y, 7)
    full = x @ y.T
    for q in range(300):
        assert set(np.argsort(-full[q])[:7] + 1000) == set(ci[qi == q].tolist())


# --- 10: WARC

PAGES = "page_id long, url string, html string, seq string"


def brute_warc(rows):
    first, out = {}, Counter()
    for r in rows:
        body = (r.html or "").encode()
        if len(body) >= 100 and r.page_id is not None:
            first[body] = min(first.get(body, r.page_id), r.page_id)
    for r in rows:
        body = (r.html or "").encode()
        at = first.get(body)
        again = at is not None and r.page_id is not None and r.page_id != at
        out[(r.page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", at if again else None)] += 1
    return out


def facts(rows):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)


def test_warc_by_brute_force(spark, sf):
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    got = warc.capture_histories(pages)
    rows = got.collect()
    assert facts(rows) == brute_warc(pages.collect())
    order = [(r.url_key.encode(), r.captured, r.page_id) for r in sorted(rows, key=lambda r: r.place)]
    assert order == sorted(order)


def test_warc_odd_rows(spark, tmp_path):
    big = "é<p>" * 60_000
    rows = [(1, "http://a.example.com/x", big, "s"), (0, "http://www.example.com:80/x#y", big, "s"), (2, None, "short", "s"), (3, "u\r\nv", "short", None), (4, "", None, None), (5, "http://a.example.com", "", None), (None, "http://b", big, None), (6, "http://a", big, None), (6, "http://a", big, None), (7, "http://a", "x" * 100, None), (8, "http://a", "x" * 100, None), (9, "http://a", "y" * 99, None), (10, "http://a", "y" * 99, None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    folder = f"file://{tmp_path}/w"
    got = warc.capture_histories(pages, folder).collect()
    assert facts(got) == brute_warc(pages.collect())
    by_archive = {a: dict(warc.records_of(a)) for a in {r.archive for r in got}}
    for r in got:
        back = warc.parse(by_archive[r.archive][r.offset])
        assert back["page_id"] == r.page_id and (back["payload"] is None) == (r.record_type == "revisit")
    assert warc.capture_histories(pages.limit(0)).count() == 0
    keys = {r.page_id: r.url_key for r in got}
    assert keys[0] == "com,example)/x" and keys[1] == "com,example,a)/x" and keys[5] == "com,example,a)/"


def test_warc_times_follow_all_ids(spark):
    ids = [-(2**63), -5, -1, 0, 1, 10**9, 10**10, 10**10 + 1, 2**63 - 1]
    assert sorted(map(warc.captured, ids)) == [warc.captured(i) for i in ids] and len({warc.captured(i) for i in ids}) == len(ids)
    pages = spark.createDataFrame([(i, "http://a/x", f"body {i}", None) for i in ids], PAGES)
    got = sorted(warc.capture_histories(pages).collect(), key=lambda r: r.place)
    assert [r.page_id for r in got] == ids and [r.captured for r in got] == [warc.captured(i) for i in ids]


def test_warc_many_small_archives_and_ranges(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").repartition(3)
    archives = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=20_000)
    assert archives.count() > 6 and archives.select("run").distinct().count() == archives.count()
    rows = warc.merge_runs(warc.read_archives(archives), 20).collect()
    assert facts(rows) == brute_warc(pages.collect()) and len({r.place >> 33 for r in rows}) > 8
    order = [(r.url_key.encode(), r.captured, r.page_id) for r in sorted(rows, key=lambda r: r.place)]
    assert order == sorted(order)


def test_warc_finds_damage():
    raw = warc.record("response", 1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse(raw)["payload"] == b"payload"
    for bad in (raw.replace(b"payload", b"PAYLOAD"), raw[:-6], b"x" + raw):
        with pytest.raises(ValueError):
            warc.parse(bad)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = np.random.default_rng(k)
    runs = [sorted(rng.integers(0, 50, n).tolist()) for n in rng.integers(0, 40, k)]
    assert list(warc.LoserTree([((x, x) for x in r) for r in runs])) == sorted(x for r in runs for x in r)


# --- the pipeline


def test_pipeline_runs_all_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mix", "encode"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and got.filter(~F.col("round_trip")).count() == 0
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in got.collect()} <= ids and json.dumps(got.schema.jsonValue())


def test_pipeline_odd_rows(spark, odd, none, tmp_path):
    """Every stage on the odd rows that its predecessor kept, with an extra column and one that an operator uses itself."""
    texts = langid.learned(labelled(odd))
    docs = odd.withColumn("tm_id", F.lit("own"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        out[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "encode":
            assert out[name].columns == odd.columns + ["tm_id"], name
        docs = out[name]
    ids = {name: sorted((r.doc_id for r in df.collect()), key=str) for name, df in out.items()}
    # Null, empty and letterless texts go; then copies; secrets cost no row.
    assert ids["language"] == sorted([1, 2, 2, 5, 6, 8, 10, 11, 12, None], key=str)
    assert ids["near_duplicates"] == ids["secrets"] == sorted([1, 5, 6, 8, 10, 11, 12, None], key=str)
    assert set(ids["mix"]) <= set(ids["secrets"]) and ids["encode"] == ids["mix"]
    assert {r.lang for r in out["language"].collect()} <= set(texts)
    left = {r.doc_id: r.text for r in out["secrets"].collect()}
    assert left[5] == "[SECRET] and [SECRET] then [SECRET]" and len(left[8]) == len("le chat est sur la table et " * 2000)
    lengths = {r.doc_id: r.n_tokens for r in out["encode"].collect()}
    assert all(n > 0 for n in lengths.values())
    df = none.withColumn("tm_id", F.lit("own"))
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, df, "").collect()
        assert rows == []


def test_pipeline_stages_by_brute_force(spark, sf):
    """The rows that run() gives, by plain versions of the stages one after the other."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    parser = langid.CrossParser(langid.learned(labelled(docs)))
    rows = [r.asDict() for r in docs.collect()]
    near = parser.predict([r["text"] for r in rows])[2]
    rows = [r for r, ok in zip(rows, near, strict=True) if ok]
    kept = set(brute_similar([(r["doc_id"], r["text"]) for r in rows])[0])
    rows = [r | {"text": merged(r["text"])} for r in rows if r["doc_id"] in kept]
    n = Counter(r["source"] for r in rows)
    w = {s: c**0.5 for s, c in n.items()}
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += poisson_count(unit(42, r["doc_id"], r["text"]), len(rows) * w[r["source"]] / sum(w.values()) / n[r["source"]])
    import sentencepiece

    from tidemark.llm import sentencepiece_codec

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)
    ids = {r["doc_id"]: lib.encode(r["text"]) for r in rows}
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == Counter({d: k for d, k in want.items() if k})
    assert all(r.ids == ids[r.doc_id] and r.round_trip for r in got)
