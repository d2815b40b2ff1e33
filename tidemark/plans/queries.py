"""The registered queries of the engine's operators, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, similarity, text
from tidemark.operators import aggregates, glossary, ingest, normalize, providers, reconcile
from tidemark.plans import tools
from tidemark.plans.views import MESSY_SQL, TAGS_SQL, TICKETS_SQL, messy, read, tagged, tickets
from tidemark.schema import UNASSIGNED
from tidemark.sources import sheets, store
from tidemark.sources.shared import shared_dir
from tidemark.streaming import refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUALIFIERS = {"building": "Building", "машина": "Машина"}
AS_OF = "2001-08-02 00:00:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- reports and aggregates

FIRST_THREE = """names AS (SELECT {key} AS k, point_name AS v, min(ingest_seq) AS s FROM tickets GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, v) AS r, count(*) OVER (PARTITION BY k) AS n FROM names),
items AS (SELECT k, string_agg(v, ', ' ORDER BY r) || CASE WHEN max(n) > 3 THEN ' +' || (max(n) - 3) ELSE '' END AS points FROM ranked WHERE r <= 3 GROUP BY k)"""


def top_sql(key: str, where: str, limit: str) -> str:
    return f"""WITH {TICKETS_SQL}, {FIRST_THREE.format(key=key)},
best AS (SELECT {key} AS k, count(*) AS tickets FROM tickets GROUP BY 1 {where} ORDER BY 2 DESC, 1 {limit})
SELECT row_number() OVER (ORDER BY tickets DESC, best.k) AS no, best.k AS {key}, coalesce(points, '—') AS points, tickets FROM best LEFT JOIN items ON best.k = items.k"""


@query(top_sql("client_normalized", "", "LIMIT 20"))
def top_clients(spark, sf_dir):
    return tools.get_top_clients(tickets(spark, sf_dir)).table


@query(top_sql("client_normalized", "HAVING count(*) > 18", ""))
def top_clients_having(spark, sf_dir):
    return tools.get_top_clients(tickets(spark, sf_dir), n=0, min_tickets=18).table


@query(top_sql("point_key", "", "LIMIT 25"))
def top_points_with_brands(spark, sf_dir):
    return tools.get_top_points(tickets(spark, sf_dir), n=25).table


@query(f"""WITH {TAGS_SQL}, each AS (SELECT unnest(problem_tags) AS tag, problem_normalized AS v, ingest_seq FROM tagged),
names AS (SELECT tag, v, min(ingest_seq) AS s FROM each GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY s, v) AS r FROM names),
items AS (SELECT tag, string_agg(v, '; ' ORDER BY r) AS examples FROM ranked WHERE r <= 3 GROUP BY tag), best AS (SELECT tag, count(*) AS tickets FROM each GROUP BY 1)
SELECT row_number() OVER (ORDER BY tickets DESC, best.tag) AS no, best.tag, tickets, examples FROM best JOIN items ON best.tag = items.tag ORDER BY 1 LIMIT 20""")
def top_tags_with_examples(spark, sf_dir):
    return tools.get_top_problems(tagged(spark, sf_dir)).table


@query(f"WITH {TAGS_SQL} SELECT tag, count(*) AS tickets FROM (SELECT unnest(problem_tags) AS tag FROM tagged) GROUP BY 1")
def tag_counts(spark, sf_dir):
    return aggregates.counts(tagged(spark, sf_dir).select(F.explode("problem_tags").alias("tag")), "tag")


@query(f"""WITH {TICKETS_SQL}, names AS (SELECT address_city, client_normalized AS v, min(ingest_seq) AS s FROM tickets GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY address_city ORDER BY s, v) AS r, count(*) OVER (PARTITION BY address_city) AS n FROM names)
SELECT address_city, string_agg(v, ', ' ORDER BY r) || CASE WHEN max(n) > 3 THEN ' +' || (max(n) - 3) ELSE '' END AS items FROM ranked WHERE r <= 3 GROUP BY 1""")
def brand_rollup(spark, sf_dir):
    return aggregates.first_distinct(tickets(spark, sf_dir), "address_city", "client_normalized", 3)


MODE_SQL = """mode_of AS (SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY n DESC, s) AS r FROM (SELECT k, v, count(*) AS n, min(s) AS s FROM pool GROUP BY 1, 2)) WHERE r = 1)"""
NORM = "regexp_replace(replace(lower({0}), 'ё', 'е'), '[^0-9a-zа-я]', '', 'g')"


@query(f"WITH {MESSY_SQL}, pool AS (SELECT {NORM.format('point_name')} AS k, point_name AS v, ingest_seq AS s FROM messy WHERE point_name <> ''), {MODE_SQL} SELECT k, v AS mode FROM mode_of")
def mode_first_seen(spark, sf_dir):
    rows = messy(spark, sf_dir).filter("point_name <> ''").withColumn("k", text.norm_key(F.col("point_name")))
    return aggregates.mode_by(rows, ["k"], "point_name")


@query("SELECT p_brand, n, first_seq FROM (SELECT p_brand, count(*) AS n, min(p_partkey) AS first_seq FROM part GROUP BY 1)")
def distinct_in_order(spark, sf_dir):
    return aggregates.frequent_values(read(spark, sf_dir, "part"), "p_brand", 3000, "p_partkey")


@query("SELECT p_name, n, first_seq FROM (SELECT p_name, count(*) AS n, min(p_partkey) AS first_seq FROM part GROUP BY 1) ORDER BY n DESC, first_seq LIMIT 50")
def frequency_capped(spark, sf_dir):
    return aggregates.frequent_values(read(spark, sf_dir, "part"), "p_name", 50, "p_partkey")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r = 1")
def dedup_keep_first(spark, sf_dir):
    return aggregates.keep_first(read(spark, sf_dir, "conversations"), "conv_id", ["turn"])


# --- search and dates


PREVIEW_SQL = """SELECT date AS "Date", client_normalized AS "Client", point_name AS "Point", address_normalized AS "Address", problem_normalized AS "Problem", status AS "Status", ticket_id AS "Ticket" """
ONE_CLIENT = "regexp_matches(client_normalized, 'customer#0*12[0-9]$', 'i')"


@query(f"""WITH {TICKETS_SQL}, found AS (SELECT * FROM tickets WHERE {ONE_CLIENT}),
usual AS (SELECT problem_normalized AS p, count(*) AS n FROM found GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT count(*) AS tickets, max(date) AS last_date, (SELECT string_agg(p || ' ' || n, '; ' ORDER BY n DESC, p) FROM usual) AS top_problems FROM found""")
def search_client(spark, sf_dir):
    return tools.search_client(tickets(spark, sf_dir), "customer#0*12[0-9]$").facts


@query(f"WITH {TICKETS_SQL} {PREVIEW_SQL} FROM tickets WHERE {ONE_CLIENT}")
def search_client_table(spark, sf_dir):
    return tools.search_client(tickets(spark, sf_dir), "customer#0*12[0-9]$").table


@query(f"WITH {TICKETS_SQL} {PREVIEW_SQL} FROM tickets WHERE regexp_matches(client_normalized, '00001', 'i') AND regexp_matches(address_normalized, 'УЛ. b', 'i')")
def search_point_two_part(spark, sf_dir):
    return tools.search_point(tickets(spark, sf_dir), " 00001 | УЛ. b | ignored").table


@query(f"WITH {TICKETS_SQL} {PREVIEW_SQL} FROM tickets WHERE regexp_matches(point_key, 'Д\\. 7$', 'i')")
def search_point_one_part(spark, sf_dir):
    return tools.search_point(tickets(spark, sf_dir), r"Д\. 7$").table


@query(f"WITH {TICKETS_SQL} {PREVIEW_SQL} FROM tickets WHERE regexp_matches(client_normalized, '#', 'i') AND event_ts >= TIMESTAMP '1996-02-01' AND event_ts < TIMESTAMP '1996-03-01'")
def client_date_range(spark, sf_dir):
    return tools.search_client_by_date(tickets(spark, sf_dir), "#", date_from="1996-02-01", date_to="1996-02-29").table


@query(f"WITH {TICKETS_SQL} {PREVIEW_SQL} FROM tickets WHERE event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND regexp_matches(point_key, 'a', 'i')")
def point_last_n_days(spark, sf_dir):
    return tools.search_point_by_date(tickets(spark, sf_dir), "a", last_n_days=30, as_of=AS_OF).table


ISLANDS = """days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), numbered AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS g FROM days),
runs AS (SELECT user_id, min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM numbered GROUP BY user_id, g), best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY days DESC, first_day) AS r FROM runs WHERE days >= 5)"""


@query(f"WITH {ISLANDS} SELECT user_id, first_day, last_day, days FROM best WHERE r = 1")
def consecutive_days(spark, sf_dir):
    return dates.longest_runs(read(spark, sf_dir, "events"), "ts", 5, ["user_id"])


@query("""WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), numbered AS (SELECT *, d - CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS g FROM days),
runs AS (SELECT min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM numbered GROUP BY g HAVING count(*) >= 5), best AS (SELECT * FROM runs ORDER BY days DESC, first_day LIMIT 1)
SELECT event_id, ts, user_id FROM events, best WHERE ts >= first_day AND ts <= CAST(last_day + 1 AS TIMESTAMP)""")
def rows_of_longest_run(spark, sf_dir):
    return dates.filter_by_date(read(spark, sf_dir, "events"), consecutive_days=5, ts="ts").select("event_id", "ts", "user_id")


@query(f"WITH {ISLANDS} SELECT event_id, ts, e.user_id FROM events e JOIN best b ON b.user_id = e.user_id WHERE r = 1 AND ts >= first_day AND ts <= CAST(last_day + 1 AS TIMESTAMP)")
def rows_of_longest_runs(spark, sf_dir):
    return dates.filter_by_date(read(spark, sf_dir, "events"), consecutive_days=5, ts="ts", by=["user_id"]).select("event_id", "ts", "user_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(tion|schaft)', 'i')")
def keyword_or(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(tools.any_word(F.col("text"), "tion schaft")).select("doc_id")


@query(f"WITH {TICKETS_SQL} SELECT count(*) AS tickets, max(date) AS last_date, count(DISTINCT client_normalized) AS clients FROM tickets WHERE problem_normalized IN ('1-URGENT', '2-HIGH')")
def search_problem_selected(spark, sf_dir):
    pick = lambda q, phrases: [p for p in phrases if p[:1] in "12"]
    return tools.search_problem(tickets(spark, sf_dir), "soon", pick).facts


@query(f"WITH {TICKETS_SQL} {PREVIEW_SQL} FROM tickets WHERE regexp_matches(problem_normalized, '(urgent|low)', 'i') AND event_ts >= TIMESTAMP '1997-01-01' AND event_ts < TIMESTAMP '1997-02-01'")
def search_problem_by_date(spark, sf_dir):
    return tools.execute_tool("search_problem_by_date", {"problem_query": "urgent low", "date_from": "1997-01-01", "date_to": "1997-01-31"}, tickets(spark, sf_dir)).table


@query(f"WITH {TICKETS_SQL} {PREVIEW_SQL} FROM tickets WHERE regexp_matches(client_normalized, '#0*5', 'i') AND regexp_matches(problem_normalized, '(urgent)', 'i')")
def search_combined(spark, sf_dir):
    return tools.search_combined(tickets(spark, sf_dir), "urgent", client_query="#0*5").table


# --- scalar functions

FP = "array_to_string([y FOR y IN [" + NORM.format("x") + " FOR x IN regexp_split_to_array({0}, '[\\s,]+')] IF y <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in text.ADDRESS_TYPE_WORDS) + "], y)], '')"
REST = "CASE WHEN address_city <> '' AND starts_with(lower(address_normalized), lower(address_city || ',')) THEN substr(address_normalized, length(address_city) + 2) ELSE address_normalized END"


@query(f"SELECT page_id, {NORM.format('url')} AS key, regexp_replace(lower(url), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS word FROM pages")
def norm_keys(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.norm_key(F.col("url")).alias("key"), text.word_key(F.col("url")).alias("word"))


@query(f"WITH {MESSY_SQL} SELECT ingest_seq, {FP.format(REST)} AS fp, {NORM.format('address_city')} || '|' || {FP.format(REST)} AS house FROM messy")
def fingerprints(spark, sf_dir):
    a, c = F.col("address_normalized"), F.col("address_city")
    return messy(spark, sf_dir).select("ingest_seq", text.address_fingerprint(a, c).alias("fp"), text.house_key(a, c).alias("house"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(x, '\\d+-\\d+') THEN regexp_extract(x, '\\d+-\\d+') ELSE trim(x) END AS id FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_name || ' ' ELSE 'no ' || p_partkey || '-' || p_size || '-1 x' END AS x FROM part)")
def extract_id(spark, sf_dir):
    x = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).otherwise(F.concat(F.lit("no "), F.col("p_partkey").cast("string"), F.lit("-"), F.col("p_size").cast("string"), F.lit("-1 x")))
    return read(spark, sf_dir, "part").select("p_partkey", text.ticket_number(x).alias("id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'on ' || o_orderkey ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS d FROM orders""")
def parse_dates(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    shapes = ["dd.MM.yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy", "dd/MM/yyyy HH:mm:ss"]
    raw = F.concat(F.lit("on "), k.cast("string"))
    for i, shape in enumerate(shapes):
        raw = F.when(k % 6 == i, F.date_format(d, shape)).otherwise(raw)
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.date_text(raw).alias("d"))


@query("""SELECT c_custkey, concat_ws(', ', nullif(n_name, ''), CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 90 AS VARCHAR) || '/' || (c_custkey % 7) ELSE CAST(c_custkey % 90 AS VARCHAR) END) AS address FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def compose_addresses(spark, sf_dir):
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return rows.select(k, text.compose_address(F.col("n_name"), F.when(k % 4 != 0, F.col("c_mktsegment")), F.when(k % 5 != 0, (k % 90).cast("string")), F.when(k % 3 == 0, (k % 7).cast("string")), F.lit(None).cast("string")).alias("address"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' ' || p_size WHEN p_partkey % 3 = 1 THEN 'Home Pro ' || p_brand ELSE 'Rotor Pro ' || p_size END AS point FROM part""")
def expand_points(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = F.when(k % 3 == 0, F.concat_ws(" ", "p_brand", size)).when(k % 3 == 1, F.concat_ws(" // ", "p_brand", F.lit("PRO"))).otherwise(F.concat_ws(" ", F.lit("pro."), size, F.lit("ROTOR")))
    return read(spark, sf_dir, "part").select(k, text.expand_point(raw, {"pro": "Pro"}, {"rotor": "Rotor"}, "Home").alias("point"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Home' ELSE 'Home ' || p_size END AS brand, CASE WHEN p_partkey % 2 = 0 THEN 'Pro' ELSE '' END AS form, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS territory FROM part""")
def split_points(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 2 == 0, F.concat_ws(" ", F.lit("Home pro"), "p_brand")).otherwise(F.concat_ws(" ", F.lit("Home"), F.col("p_size").cast("string")))
    return read(spark, sf_dir, "part").select(k, text.split_point(raw, {"pro": "Pro"}).alias("s")).select("p_partkey", "s.*")


@query(f"WITH {TAGS_SQL} SELECT ticket_id, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE ['{UNASSIGNED}'] END, '|') AS tags FROM (SELECT ticket_id, [x FOR x IN problem_tags IF x IN ('ECONOMY', 'STANDARD')] AS kept FROM tagged)")
def tag_intersect(spark, sf_dir):
    return tagged(spark, sf_dir).select("ticket_id", F.array_join(text.keep_known(F.col("problem_tags"), ["ECONOMY", "STANDARD"], UNASSIGNED), "|").alias("tags"))


# --- sources and normalisation


@query(f"WITH {TICKETS_SQL} SELECT ticket_id, _table_name, _sheet_name FROM tickets WHERE (_table_name = 'even' AND _sheet_name = 'F') OR (_table_name = 'odd' AND _sheet_name = 'O')")
def sheet_semi_scan(spark, sf_dir):
    chosen = [{"table_name": "even", "sheet_name": "F"}, {"table_name": "odd", "sheet_name": "O"}, {"table_name": "odd"}]
    return sheets.select_sheets(tickets(spark, sf_dir), chosen).select("ticket_id", "_table_name", "_sheet_name")


@query(f"WITH {TICKETS_SQL} SELECT _table_name, _sheet_name, count(*) AS row_count, true AS has_data, strftime(min(event_ts), '%Y-%m-%d') AS date_min, strftime(max(event_ts), '%Y-%m-%d') AS date_max FROM tickets GROUP BY 1, 2")
def catalog(spark, sf_dir):
    return sheets.by_first_date(sheets.catalogue_of(tickets(spark, sf_dir)))


@query(f"WITH {TICKETS_SQL} SELECT DISTINCT _table_name FROM tickets")
def table_names(spark, sf_dir):
    return sheets.table_names(tickets(spark, sf_dir))


@query(f"WITH {TAGS_SQL} SELECT count(*) AS rows, count(*) FILTER (len(problem_tags) > 0) AS tagged, 1 AS sheets FROM tagged")
def tag_check(spark, sf_dir):
    return sheets.tag_report(tagged(spark, sf_dir).withColumns({"_table_name": F.lit("t"), "_sheet_name": F.lit("s")}))


RAW_PAIRS = "SELECT DISTINCT trim(lower(c_mktsegment)) AS client_raw, trim(n_name) AS address_raw FROM customer JOIN nation ON c_nationkey = n_nationkey"


def raw_pairs(spark, sf_dir):
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("client_raw"), F.concat("n_name", F.lit(" ")).alias("address_raw"))


@query(f"SELECT client_raw, address_raw, lower(client_raw || '||' || address_raw) AS key FROM ({RAW_PAIRS})")
def distinct_pairs(spark, sf_dir):
    return normalize.distinct_pairs(raw_pairs(spark, sf_dir))


@query(f"SELECT lower(client_raw || '||' || address_raw) AS key FROM ({RAW_PAIRS}) WHERE client_raw || address_raw NOT IN (SELECT lower(c_mktsegment) || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 20)")
def cache_anti(spark, sf_dir):
    known = read(spark, sf_dir, "nation").filter("n_nationkey < 20")
    segments = read(spark, sf_dir, "customer")
    store = segments.join(known, segments.c_nationkey == known.n_nationkey).select(normalize.pair_key(F.col("c_mktsegment"), F.col("n_name")).alias("key")).distinct()
    return normalize.misses(normalize.distinct_pairs(raw_pairs(spark, sf_dir)), store).select("key")


@query("SELECT trim(lower(c_mktsegment)) AS client_raw, CASE WHEN n_nationkey < 12 THEN upper(n_name) ELSE '' END AS address_normalized, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def cache_lookup(spark, sf_dir):
    pairs = normalize.distinct_pairs(raw_pairs(spark, sf_dir))
    known = read(spark, sf_dir, "nation").filter("n_nationkey < 12").select(F.col("n_name").alias("address_raw"))
    store = pairs.join(known, "address_raw").select("key", F.col("client_raw").alias("client_normalized"), F.lit("").alias("point_name"), F.upper("address_raw").alias("address_normalized"), F.lit("").alias("city"))
    return normalize.apply_pairs(raw_pairs(spark, sf_dir), store).groupBy(F.trim("client_raw").alias("client_raw"), "address_normalized").agg(F.count("*").alias("n"))


@query()
def category_match(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("problem_raw")).distinct()
    return normalize.match_category(parts, ["Economy", "Standard", "Standard part", "Promo: large", "Medium or small"])


@query()
def fuzzy_ratios(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return rows.withColumns({"ratio": similarity.ratio_udf("p_name", "p_type"), "token_set": similarity.token_set_udf("p_name", "p_type"), "token_sort": similarity.token_sort_udf("p_name", "p_type")})


@query(f"""WITH pool AS (SELECT replace(lower(c_mktsegment), 'ё', 'е') AS k, q AS v, hash AS s FROM (SELECT c_mktsegment, q, 0 AS hash FROM (SELECT c_mktsegment, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN 'ООО ' || c_mktsegment WHEN c_custkey % 9 = 2 THEN 'ИП ' || c_mktsegment ELSE '' END AS q FROM customer) WHERE starts_with(q, 'ООО ') OR starts_with(q, 'ИП '))), {MODE_SQL}
SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN q = '' THEN '' ELSE v END AS client_qualifier FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN 'ООО ' || c_mktsegment WHEN c_custkey % 9 = 2 THEN 'ИП ' || c_mktsegment ELSE '' END AS q FROM customer) JOIN mode_of ON k = lower(c_mktsegment)""")
def qualifier_unify(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    own = F.when(k % 3 == 0, s).when(k % 3 == 1, F.concat(F.lit("ООО "), s)).when(k % 9 == 2, F.concat(F.lit("ИП "), s)).otherwise("")
    return normalize.unify_qualifiers(read(spark, sf_dir, "customer").select(k.cast("string").alias("key"), own.alias("client_qualifier")))


def grid(spark, sf_dir):
    """Sheets over all orders: two with headers (the second below a title, one word misspelt), one without, and one that repeats
    ids of the first with lower row numbers. Every tenth row is blank, and every tenth ends early."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    row = lambda client: F.array(k.cast("string"), F.date_format("o_orderdate", "dd.MM.yyyy HH:mm"), client, F.lit(""))
    whole = row(F.concat(F.lit(" client "), F.col("o_custkey").cast("string")))
    cells = F.when(k % 10 == 0, F.array(F.lit(""), F.lit(None).cast("string"))).when(k % 10 == 1, F.slice(whole, 1, 2)).otherwise(whole)
    sheet = lambda name: [F.lit("book").alias("_table_name"), name.alias("_sheet_name")]
    body = o.select(*sheet(F.concat(F.lit("s"), (k % 3).cast("string"))), (k + 5).cast("int").alias("row_idx"), cells.alias("cells"))
    again = o.filter(k % 6 == 0).select(*sheet(F.lit("s3")), (k + 1).cast("int").alias("row_idx"), row(F.lit("other")).alias("cells"))
    head = ["Номер", "Дата", "Контрагент", "Автор"]
    heads = [("book", "s0", 0, head), ("book", "s1", 0, ["Отчёт"]), ("book", "s1", 2, ["Номер заявки", "Дата", "Контрогент", None]), ("book", "s2", 0, ["a", "b"]), ("book", "s3", 0, head)]
    return spark.createDataFrame(heads, "_table_name string, _sheet_name string, row_idx int, cells array<string>").unionByName(body).unionByName(again)


def scratch(spark, name):
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


INGESTED = """ingested AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS ticket_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date,
  CASE WHEN o_orderkey % 10 = 1 THEN '' ELSE 'client ' || o_custkey END AS client_raw, 's' || (o_orderkey % 3) AS _sheet_name FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 10 <> 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'other', 's3' FROM orders WHERE o_orderkey % 6 = 0)"""


@query(f"WITH {INGESTED} SELECT * FROM ingested")
def ingest_sheets(spark, sf_dir):
    return ingest.tickets(grid(spark, sf_dir)).select("ticket_id", "date", "client_raw", "_sheet_name")


@query(f"WITH {INGESTED} SELECT ticket_id, client_raw, _sheet_name FROM ingested i WHERE NOT (_sheet_name = 's3' AND EXISTS (SELECT 1 FROM ingested j WHERE j.ticket_id = i.ticket_id AND j._sheet_name = 's0'))")
def ingest_dedup_over_sheets(spark, sf_dir):
    return reconcile.deduplicate(ingest.tickets(grid(spark, sf_dir))).select("ticket_id", "client_raw", "_sheet_name")


@query(f"""WITH {INGESTED} SELECT CAST(1 AS BIGINT) AS tables, CAST(3 AS BIGINT) AS sheets, count(*) + (SELECT count(*) FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 10 = 0) AS rows_below_headers,
(SELECT count(*) FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 10 = 0) AS rows_skipped, count(*) AS tickets, count(ticket_id) - count(DISTINCT ticket_id) AS duplicates, CAST(1 AS BIGINT) AS sheets_rejected FROM ingested""")
def ingest_statistics(spark, sf_dir):
    """Counted by the write that stores the tickets."""
    found = ingest.stored(grid(spark, sf_dir), sheets.Tickets(spark, scratch(spark, "ingested")))
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{name} long" for name in found))


@query("SELECT 'book' AS _table_name, 's2' AS _sheet_name, 'no header' AS reason FROM orders WHERE o_orderkey % 3 = 2 HAVING count(*) > 0")
def rejected_sheets(spark, sf_dir):
    return ingest.rejected_sheets(grid(spark, sf_dir))


@query(f"WITH {INGESTED} SELECT * FROM ingested WHERE _sheet_name IN ('s0', 's3')")
def sheets_read_back(spark, sf_dir):
    """Orders written as sheets; of these two are chosen, so that the source opens no others."""
    folder = scratch(spark, "sheets")
    sheets.write_sheets(grid(spark, sf_dir), folder)
    chosen = [{"table_name": "book", "sheet_name": name} for name in ("s0", "s3")]
    heads = sheets.read_grid(spark, folder, chosen, ingest.HEADER_ROWS)
    return ingest.tickets(sheets.read_grid(spark, folder, chosen), heads).select("ticket_id", "date", "client_raw", "_sheet_name")


@query(f"""WITH {INGESTED}, now_ AS (SELECT * FROM ingested WHERE (_sheet_name = 's0' AND CAST(ticket_id AS BIGINT) % 4 = 0) OR _sheet_name = 's3')
SELECT ticket_id, client_raw, _sheet_name FROM now_ i WHERE NOT (_sheet_name = 's3' AND EXISTS (SELECT 1 FROM now_ j WHERE j.ticket_id = i.ticket_id AND j._sheet_name = 's0'))""")
def incremental_refresh(spark, sf_dir):
    """A table that follows its sheets: after a first refresh one sheet changes, one goes and one comes; the second refresh reads only these."""
    folder, rows = scratch(spark, "sheets"), grid(spark, sf_dir)
    table, seen = sheets.Tickets(spark, scratch(spark, "table")), scratch(spark, "seen")
    sheets.write_sheets(rows.filter("_sheet_name <> 's3'"), folder)
    refresh.refresh(spark, folder, table, seen)
    sheets.write_sheets(rows.filter("_sheet_name = 's3' or _sheet_name = 's0' and (row_idx = 0 or (row_idx - 5) % 4 = 0)"), folder)
    sheets.remove_sheet(folder, "book", "s1")
    refresh.refresh(spark, folder, table, seen)
    return reconcile.deduplicate(table.in_order()).select("ticket_id", "client_raw", "_sheet_name")


@query(f"WITH {TICKETS_SQL} SELECT ticket_id, CASE WHEN _sheet_name = 'F' AND _table_name = 'odd' THEN 'again ' || status ELSE status END AS status, _table_name, _sheet_name FROM tickets")
def rewritten_table(spark, sf_dir):
    """A stored table rewritten from itself, and then one of its sheets."""
    table = sheets.Tickets(spark, scratch(spark, "table"))
    table.write(tickets(spark, sf_dir))
    table.write(table.all().withColumn("status", F.concat(F.lit("again "), "status")))
    of_sheet = (F.col("_table_name") == "odd") & (F.col("_sheet_name") == "F")
    others = table.catalogue().filter(~of_sheet).select(*sheets.SHEET).collect()
    table.refresh(table.all().filter(~of_sheet).withColumn("status", F.substring("status", 7, 100)), [tuple(r) for r in others])
    return table.all().select("ticket_id", "status", *sheets.SHEET)


@query("""SELECT 'book' AS _table_name, * FROM (VALUES ('s0', 0, 'ticket_id', 0), ('s0', 0, 'date', 1), ('s0', 0, 'client_raw', 2), ('s0', 0, 'author', 3), ('s1', 2, 'date', 1), ('s1', 2, 'client_raw', 2),
('s3', 0, 'ticket_id', 0), ('s3', 0, 'date', 1), ('s3', 0, 'client_raw', 2), ('s3', 0, 'author', 3)) t(_sheet_name, header_row, target, pos)""")
def header_map(spark, sf_dir):
    return ingest.column_map(grid(spark, sf_dir)).select("_table_name", "_sheet_name", "header_row", F.explode("mapping").alias("target", "pos"))


@query("""WITH raw AS (SELECT DISTINCT 'ООО ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS c, n_name AS city FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT lower(c || '||' || city || ', Main St, 5') AS key, c AS client_normalized, '' AS point_name, city || ', Main St, 5' AS address_normalized, city FROM raw""")
def normalised_pairs(spark, sf_dir):
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    client = F.concat(F.lit("ООО "), F.initcap("c_mktsegment"))
    raw = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(client.alias("client_raw"), F.concat("n_name", F.lit(", Main St, 5")).alias("address_raw"))
    none = spark.createDataFrame([], "key string")
    found = normalize.normalise_pairs(normalize.distinct_pairs(raw), none, providers.pairs_by_rules, {}, {}, "Home")
    return found.select("key", "client_normalized", "point_name", "address_normalized", "city")


def problems_by_rules(items: list) -> dict:
    """A provider without a model: it loses one text, has no words for another, and repeats the rest."""
    return {x: {"normalized": "" if x.startswith("PROMO") else x + "!", "tags": [] if x.startswith("PROMO") else ["Economy", "junk"]} for x in items if not x.startswith("SMALL")}


def type_problems(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.lower("p_type"))
    return normalize.distinct_problems(read(spark, sf_dir, "part").select(F.concat(kind, F.lit(" x")).alias("problem_raw")))


NORMALISED = """SELECT lower(p_type) || ' x' AS key, CASE WHEN p_type = 'ECONOMY' THEN 'Economy' WHEN p_type = 'PROMO' THEN 'PROMO x' ELSE p_type || ' x!' END AS normalized,
CASE WHEN p_type = 'PROMO' THEN 'unassigned' ELSE 'Economy' END AS tags FROM (SELECT DISTINCT p_type FROM part) WHERE p_type <> 'SMALL'"""


@query(NORMALISED)
def stored_problems(spark, sf_dir):
    """Through the mapping store: one slice of keys after the other, then a run that only finds what the first one lost, then compaction."""
    mapping = store.Mapping(spark, scratch(spark, "mapping"), "key string, normalized string, tags array<string>", slices=4)
    for _ in range(2):
        normalize.store_in_slices(type_problems(spark, sf_dir), mapping, lambda keys, held: normalize.normalise_problems(keys, held, ["Economy"], problems_by_rules))
    mapping.compact()
    return mapping.read().withColumn("tags", F.array_join("tags", "|"))


@query(NORMALISED)
def normalised_problems(spark, sf_dir):
    none = spark.createDataFrame([], "key string")
    found = normalize.normalise_problems(type_problems(spark, sf_dir), none, ["Economy"], problems_by_rules)
    return found.withColumn("tags", F.array_join("tags", "|"))


@query("""SELECT count(DISTINCT p_type) AS texts, count(DISTINCT p_type) FILTER (p_type = 'STANDARD') AS cache_hits, count(DISTINCT p_type) FILTER (p_type = 'ECONOMY') AS layer1_matches,
count(DISTINCT p_type) FILTER (p_type NOT IN ('STANDARD', 'ECONOMY')) AS asked FROM part""")
def layer_statistics(spark, sf_dir):
    held = spark.createDataFrame([("standard x",)], "key string")
    return normalize.layer_statistics(type_problems(spark, sf_dir), held, ["Economy"])


@query(f"WITH {TAGS_SQL} SELECT problem_normalized, array_to_string(problem_tags, '|') AS problem_tags FROM tagged WHERE len(problem_tags) > 0 ORDER BY ingest_seq LIMIT 1")
def tag_example(spark, sf_dir):
    return sheets.tag_example(tagged(spark, sf_dir)).select("problem_normalized", F.array_join("problem_tags", "|").alias("problem_tags"))


@query("""WITH found AS (SELECT DISTINCT p_type FROM part) SELECT lower(p_type) || ' x' AS key, CASE WHEN p_type = 'ECONOMY' THEN 'Economy' ELSE p_type || ' x' END AS normalized,
CASE WHEN p_type = 'ECONOMY' THEN 'Economy' WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'Sizes' ELSE 'unassigned' END AS tags FROM found""")
def problems_by_rules_of_words(spark, sf_dir):
    """Categories by the words of their descriptions, from the provider that needs no model."""
    listed = [("Economy", ""), ("Sizes", "small, medium or large")]
    found = normalize.normalise_problems(type_problems(spark, sf_dir), spark.createDataFrame([], "key string"), store.category_names(listed), providers.problems_by_rules(listed))
    return found.withColumn("tags", F.array_join("tags", "|"))


@query("""SELECT DISTINCT lower('Shop ' || c_mktsegment || ' ООО||г. ' || n_name || ', ул. Main, д. ' || (c_custkey % 40) || ', оф. 7') AS key, 'ООО Shop ' || c_mktsegment AS client_normalized,
n_name AS city, n_name || ', Main, ' || (c_custkey % 40) || ', 7' AS address_normalized FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def pairs_with_kinds(spark, sf_dir):
    """Addresses whose parts say their kind, and clients whose legal form stands last."""
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    address = F.concat(F.lit("г. "), "n_name", F.lit(", ул. Main, д. "), (F.col("c_custkey") % 40).cast("string"), F.lit(", оф. 7"))
    client = F.concat(F.lit("Shop "), "c_mktsegment", F.lit(" ООО"))
    raw = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(client.alias("client_raw"), address.alias("address_raw"))
    found = normalize.normalise_pairs(normalize.distinct_pairs(raw), spark.createDataFrame([], "key string"), providers.pairs_by_rules, {}, {}, "Home")
    return found.select("key", "client_normalized", "city", "address_normalized")


TERMS = [store.Term("Economy", aliases=("cheap", "low price")), store.Term("Standard part", aliases=("plain",)), store.Term("Polished", aliases=("small polish",)), store.Term("Promotion", aliases=("promo",))]


@query()
def glossary_matches(spark, sf_dir):
    """Terms near the names and the types of all parts."""
    part = read(spark, sf_dir, "part")
    return glossary.lookup(part.select(F.explode(F.array("p_name", "p_type")).alias("said")), store.Glossary(TERMS), "said", top_k=3)


WORD_SET = "list_sort(list_distinct([w FOR w IN string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^0-9a-zа-яё\\s]', ' ', 'g'), '\\s+') IF w <> '']))"


@query(f"SELECT doc_id, CAST(len({WORD_SET}) AS INT) AS n_words, array_to_string({WORD_SET}, ' ') AS words FROM documents")
def word_sets(spark, sf_dir):
    words = F.array_sort(text.token_set(F.col("text")))
    return read(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("n_words"), F.array_join("w", " ").alias("words"))


FORMS_SQL = "('ип', 'ооо', 'зао', 'оао', 'пао', 'ао', 'нко', 'ано')"


@query(f"""WITH named AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ООО "' WHEN 1 THEN ' ип ' WHEN 2 THEN 'Ао-ЗАО ' ELSE 'Паола ' END || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' (ООО)' ELSE '' END AS name FROM customer),
parts AS (SELECT *, string_split_regex(lower(name), '[^0-9a-zа-яё_]+') AS w FROM named)
SELECT c_custkey, array_to_string(list_sort(list_distinct([x FOR x IN w IF x IN {FORMS_SQL}])), ',') AS forms, [x FOR x IN w IF x <> ''][1] IN {FORMS_SQL} AS leads FROM parts""")
def legal_form_sets(spark, sf_dir):
    k = F.col("c_custkey")
    head = F.when(k % 4 == 0, 'ООО "').when(k % 4 == 1, " ип ").when(k % 4 == 2, "Ао-ЗАО ").otherwise("Паола ")
    name = F.concat(head, "c_mktsegment", F.when(k % 3 == 0, " (ООО)").otherwise(""))
    return read(spark, sf_dir, "customer").select(k, F.array_join(text.legal_forms(name), ",").alias("forms"), text.leads_with_form(name).alias("leads"))


@query(f"""WITH {TICKETS_SQL} SELECT ticket_id, status, NULL AS comment FROM tickets WHERE status = 'F' UNION ALL SELECT ticket_id, NULL, 'late' FROM tickets WHERE status = 'O'
UNION ALL SELECT ticket_id, status, date FROM tickets WHERE status = 'P'""")
def sheets_united(spark, sf_dir):
    """Sheets that don't have the same columns, one below the other."""
    t = tickets(spark, sf_dir)
    of = lambda status: t.filter(F.col("status") == status)
    return ingest.union_all([of("F").select("ticket_id", "status"), of("O").select("ticket_id", F.lit("late").alias("comment")), of("P").select("status", F.col("date").alias("comment"), "ticket_id")])


@query(f"WITH {TICKETS_SQL} SELECT date, client_normalized, point_name, address_normalized, problem_normalized, status, ticket_id FROM tickets ORDER BY ingest_seq LIMIT 100")
def raw_preview(spark, sf_dir):
    return tools.raw_preview(tickets(spark, sf_dir).orderBy("ingest_seq"))


@query(f"""WITH {TICKETS_SQL} SELECT date, client_normalized, point_name, address_normalized, left(repeat(problem_normalized, 9), 80) AS problem_normalized, CASE WHEN status = 'P' THEN '—' ELSE status END AS status, ticket_id
FROM tickets ORDER BY ingest_seq DESC LIMIT 300""")
def analyst_rows(spark, sf_dir):
    t = tickets(spark, sf_dir).withColumn("problem_normalized", F.repeat("problem_normalized", F.lit(9))).withColumn("status", F.when(F.col("status") != "P", F.col("status")))
    return tools.digest_rows(t.orderBy(F.desc("ingest_seq")))


@query(f"""WITH {TICKETS_SQL}, found AS (SELECT * FROM tickets WHERE problem_normalized ILIKE '%urgent%'),
best AS (SELECT client_normalized, count(*) AS tickets FROM tickets GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30)
SELECT row_number() OVER (ORDER BY tickets DESC, client_normalized) AS no, client_normalized, tickets, (SELECT 'tickets: ' || count(*) || ', last on ' || max(date) || ', clients: ' || count(DISTINCT client_normalized) FROM found) AS summary
FROM best ORDER BY 1 LIMIT 12""")
def answer_envelope(spark, sf_dir):
    """A line of facts about one search, beside the bounded table of a report."""
    t = tickets(spark, sf_dir)
    said = tools.format_answer(tools.Result(tools.get_top_clients(t, n=30).table, tools.search_problem(t, "urgent").facts), rows=12)
    return said.preview_data.select("no", "client_normalized", "tickets", F.lit(said.summary).alias("summary"))


# --- reconciliation


@query(f"WITH {MESSY_SQL}, pool AS (SELECT {NORM.format('v')} AS k, v, s FROM (SELECT client_normalized AS v, ingest_seq AS s FROM messy UNION ALL SELECT point_name, ingest_seq FROM messy) WHERE v <> ''), {MODE_SQL} SELECT ingest_seq, coalesce(a.v, client_normalized) AS client_normalized, coalesce(b.v, point_name) AS point_name FROM messy LEFT JOIN mode_of a ON a.k = {NORM.format('client_normalized')} LEFT JOIN mode_of b ON b.k = {NORM.format('point_name')}")
def canonical_names(spark, sf_dir):
    return reconcile.canonicalise(reconcile.prepared(messy(spark, sf_dir))).select("ingest_seq", "client_normalized", "point_name")


HOUSE = f"{NORM.format('address_city')} || '|' || {FP.format(REST)}"


@query(f"""WITH {MESSY_SQL}, f AS (SELECT *, {FP.format(REST)} AS fp FROM messy), known AS (SELECT * FROM f WHERE address_city <> ''),
pool AS (SELECT client_normalized || '~' || fp AS k, address_city AS v, ingest_seq AS s FROM known), {MODE_SQL},
single AS (SELECT client_normalized, min(address_city) AS c FROM known GROUP BY 1 HAVING count(DISTINCT address_city) = 1)
SELECT ingest_seq, coalesce(nullif(address_city, ''), m.v, s.c, 'DEFAULT') AS address_city, CASE WHEN address_city = '' THEN coalesce(m.v, s.c, 'DEFAULT') || ', ' ELSE '' END || address_normalized AS address_normalized
FROM f LEFT JOIN mode_of m ON m.k = f.client_normalized || '~' || fp LEFT JOIN single s ON s.client_normalized = f.client_normalized""")
def ladder_fill(spark, sf_dir):
    return reconcile.reconcile_addresses(reconcile.prepared(messy(spark, sf_dir)), "DEFAULT").select("ingest_seq", "address_city", "address_normalized")


@query(f"""WITH {MESSY_SQL}, f AS (SELECT *, {FP.format(REST)} AS fp FROM messy), pool AS (SELECT client_normalized || '~' || fp AS k, point_name AS v, ingest_seq AS s FROM f WHERE point_name <> ''), {MODE_SQL},
filled AS (SELECT ingest_seq, CASE WHEN point_name = '' THEN coalesce(m.v, '') ELSE point_name END AS p FROM f LEFT JOIN mode_of m ON m.k = client_normalized || '~' || fp),
spell AS (SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY n DESC, s) AS r FROM (SELECT lower(p) AS k, p AS v, count(*) AS n, min(ingest_seq) AS s FROM filled WHERE p <> '' GROUP BY 1, 2)) WHERE r = 1)
SELECT ingest_seq, coalesce(v, p) AS point_name FROM filled LEFT JOIN spell ON k = lower(p)""")
def fill_from_group(spark, sf_dir):
    return reconcile.reconcile_points(reconcile.prepared(messy(spark, sf_dir))).select("ingest_seq", "point_name")


@query(f"""WITH {MESSY_SQL}, bare AS (SELECT ingest_seq, client_normalized AS c, CASE WHEN client_normalized = '' THEN '' ELSE point_name END AS p, address_city, address_normalized, {HOUSE} AS house, {FP.format(REST)} AS fp FROM messy),
named AS (SELECT *, CASE WHEN c <> '' THEN c ELSE p END AS id FROM bare), houses AS (SELECT house, count(DISTINCT id) AS n, min(id) AS owner FROM named WHERE id <> '' GROUP BY 1),
prints AS (SELECT fp, min(id) AS owner FROM named WHERE id <> '' GROUP BY 1 HAVING count(DISTINCT id) = 1)
SELECT ingest_seq, coalesce(nullif(c, ''), CASE WHEN n = 1 THEN h.owner WHEN n IS NULL AND address_city = '' THEN p2.owner END, '') AS client_normalized
FROM named LEFT JOIN houses h ON h.house = named.house LEFT JOIN prints p2 ON p2.fp = named.fp""")
def backfill_identity(spark, sf_dir):
    rows = messy(spark, sf_dir).withColumn("point_name", F.when(F.col("client_normalized") == "", "").otherwise(F.col("point_name")))
    return reconcile.backfill_identity(reconcile.prepared(rows)).select("ingest_seq", "client_normalized")


@query(f"WITH {MESSY_SQL} SELECT ingest_seq, nullif(concat_ws(' | ', nullif(CASE WHEN client_normalized <> '' THEN client_normalized ELSE point_name END, ''), nullif(address_normalized, '')), '') AS point_key FROM messy")
def point_keys(spark, sf_dir):
    return reconcile.add_point_key(reconcile.prepared(messy(spark, sf_dir))).select("ingest_seq", "point_key")


@query(f"""WITH {MESSY_SQL}, f AS (SELECT *, {HOUSE} AS house, lower(point_name) AS sign FROM messy), s AS (SELECT house, sign FROM f WHERE point_name <> '' AND client_normalized <> '' GROUP BY 1, 2 HAVING count(DISTINCT client_normalized) > 1)
SELECT ingest_seq, CASE WHEN s.house IS NOT NULL AND client_normalized <> '' AND point_name <> '' THEN 'one sign, several owners' ELSE '' END AS point_flags FROM f LEFT JOIN s ON s.house = f.house AND s.sign = f.sign""")
def shared_flags(spark, sf_dir):
    return reconcile.flags_text(reconcile.flag_shared(reconcile.prepared(messy(spark, sf_dir)), {})).select("ingest_seq", "point_flags")


@query()
def client_cluster(spark, sf_dir):
    return reconcile.client_renames(reconcile.prepared(messy(spark, sf_dir)))


SIGNS_SQL = f"""{MESSY_SQL}, rows_ AS (SELECT ingest_seq, CASE WHEN ingest_seq % 3 = 0 AND client_normalized <> '' THEN 'Sign ' || lower(client_normalized) ELSE client_normalized END AS c,
  CASE WHEN ingest_seq % 3 = 0 OR client_normalized = '' THEN '' ELSE 'Sign ' || lower(client_normalized) END AS p FROM messy),
freq AS (SELECT {NORM.format('c')} AS k, count(*) AS n FROM rows_ WHERE c <> '' GROUP BY 1),
signs AS (SELECT p, arg_max(c, ingest_seq) AS owner FROM rows_ WHERE c <> '' AND p <> '' GROUP BY 1 HAVING count(DISTINCT {NORM.format('c')}) = 1),
pairs AS (SELECT p, owner, {NORM.format('p')} AS sk, {NORM.format('owner')} AS ok FROM signs),
decided AS (SELECT CASE WHEN s.n >= o.n THEN ok ELSE sk END AS k, CASE WHEN s.n >= o.n THEN p ELSE owner END AS winner, p FROM pairs JOIN freq s ON s.k = sk JOIN freq o ON o.k = ok WHERE sk <> ok),
best AS (SELECT k, arg_max(winner, p) AS winner FROM decided GROUP BY 1)"""


@query(f"""WITH {SIGNS_SQL} SELECT ingest_seq, coalesce(winner, c) AS client_normalized, CASE WHEN winner <> c AND p = '' THEN c ELSE p END AS point_name
FROM rows_ LEFT JOIN best ON c <> '' AND k = {NORM.format('c')}""")
def role_swap(spark, sf_dir):
    """Every third row of a client is under the sign that its other rows carry."""
    c, third = F.col("client_normalized"), F.col("ingest_seq") % 3 == 0
    named = F.concat(F.lit("Sign "), F.lower(c))
    rows = messy(spark, sf_dir).withColumn("point_name", F.when(third | (c == ""), "").otherwise(named))
    rows = rows.withColumn("client_normalized", F.when(third & (c != ""), named).otherwise(c))
    return reconcile.swap_roles(reconcile.prepared(rows)).select("ingest_seq", "client_normalized", "point_name")


@query(f"""WITH {MESSY_SQL}, f AS (SELECT ingest_seq, {HOUSE} AS house, {FP.format(REST)} AS fp FROM messy), full_ AS (SELECT house, bool_or(ingest_seq % 2 = 0) AS known FROM f WHERE fp <> '' GROUP BY 1)
SELECT ingest_seq, CASE WHEN ingest_seq % 2 = 0 OR known THEN 'Home Building North' ELSE 'home' END AS client_normalized, CASE WHEN ingest_seq % 2 = 1 AND known THEN 'form filled' ELSE '' END AS point_flags
FROM f LEFT JOIN full_ USING (house)""")
def fill_forms(spark, sf_dir):
    rows = messy(spark, sf_dir).withColumn("client_normalized", F.when(F.col("ingest_seq") % 2 == 0, "Home Building North").otherwise("home"))
    return reconcile.flags_text(reconcile.fill_forms(reconcile.prepared(rows), QUALIFIERS)).select("ingest_seq", "client_normalized", "point_flags")


@query(f"""WITH {MESSY_SQL}, f AS (SELECT ingest_seq, address_city, CASE WHEN ingest_seq % 4 = 0 THEN upper(address_normalized) ELSE address_normalized END AS address_normalized,
  CASE WHEN client_normalized <> '' THEN client_normalized ELSE point_name END AS id FROM messy),
g AS (SELECT *, {NORM.format('id')} || '|' || {NORM.format('address_city')} || '|' || {FP.format(REST)} AS k FROM f), pool AS (SELECT k, address_normalized AS v, ingest_seq AS s FROM g), {MODE_SQL}
SELECT ingest_seq, v AS address_normalized FROM g JOIN mode_of USING (k)""")
def canonical_addresses(spark, sf_dir):
    rows = messy(spark, sf_dir).withColumn("address_normalized", F.when(F.col("ingest_seq") % 4 == 0, F.upper("address_normalized")).otherwise(F.col("address_normalized")))
    return reconcile.canonicalise(reconcile.prepared(rows)).select("ingest_seq", "address_normalized")


@query()
def reconcile_report(spark, sf_dir):
    return reconcile.change_counts(messy(spark, sf_dir), QUALIFIERS, "DEFAULT")


@query()
def reconcile_all(spark, sf_dir):
    return reconcile.flags_text(reconcile.reconcile(messy(spark, sf_dir), QUALIFIERS, "DEFAULT"))
