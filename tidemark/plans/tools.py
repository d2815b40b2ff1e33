"""The ten query tools as lazy plans, their catalogue, and the executor."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import filter_by_date
from tidemark.operators.aggregates import counts, first_distinct, frequent_values, numbered, numbered_by_ranges, preview, top, with_items
from tidemark.schema import DASH

PREVIEW = {"date": "Date", "client_normalized": "Client", "point_name": "Point", "address_normalized": "Address", "problem_normalized": "Problem", "status": "Status", "assignee": "Assignee", "ticket_id": "Ticket"}
#: Picks, from numbered distinct phrases, those that a query means; anything but a list means it can't.
Selector = Callable[[str, list[str]], object]


@dataclass
class Result:
    """What a tool gives back: a table, a lazy one-row summary of it, and the words that describe the period."""

    table: DataFrame
    facts: DataFrame | None = None
    period: str = ""
    figure: object = field(default=None)


@dataclass
class Answer:
    """What a user reads: a line of facts, the words of an analyst if there are any, a numbered table of bounded size, a figure."""

    summary: str
    answer: str
    preview_data: DataFrame
    figure: object = None


def format_answer(result: Result, answer: str = "", rows: int = 100) -> Answer:
    """Runs the one-row summary of a tool's result and takes the first ``rows`` of its table, numbered as they come."""
    said = [result.period] if result.period else []
    if result.facts is not None:
        facts_ = result.facts.first().asDict()
        said = [f"tickets: {facts_['tickets']}", f"last on {facts_['last_date'] or DASH}", *said]
        said += [f"{name.replace('_', ' ')}: {value}" for name, value in facts_.items() if name not in ("tickets", "last_date")]
    table = result.table.limit(rows)
    if "no" not in table.columns:
        names = table.columns
        table = table.select(F.monotonically_increasing_id().alias("at_"), "*").coalesce(1)
        table = table.select(F.row_number().over(Window.orderBy("at_")).alias("no"), *names)
    return Answer(", ".join(said), answer, table, result.figure)


def valid(pattern: str) -> str:
    """The pattern, or a ValueError now instead of a failed job later: plans are lazy."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        raise ValueError(f"not a regular expression: {str(e).splitlines()[0]}") from None
    return pattern


def contains(c: Column, pattern: str) -> Column:
    """Case-insensitive search by a regular expression; null doesn't match."""
    return F.coalesce(c.rlike(valid(f"(?iu){pattern.strip()}")), F.lit(False))


def two_part(pattern: str, client: Column, address: Column, key: Column) -> Column:
    """``client | address``: both must match; without a bar the key must."""
    parts = [p.strip() for p in pattern.split("|")]
    return contains(client, parts[0]) & contains(address, parts[1]) if len(parts) > 1 else contains(key, parts[0])


def any_word(c: Column, query: str) -> Column:
    words = query.split()
    return contains(c, "(" + "|".join(words) + ")") if words else F.lit(False)


def period_text(date_from=None, date_to=None, last_n_days=None, consecutive_days=None) -> str:
    if last_n_days:
        return f"last {last_n_days} days"
    if date_from and date_to:
        return f"{date_from} to {date_to}"
    return f"{consecutive_days} days in a row" if consecutive_days else ""


def facts(df: DataFrame, *more: Column) -> DataFrame:
    return df.agg(F.count("*").alias("tickets"), F.max("date").alias("last_date"), *more)


def top_keys(df: DataFrame, key: str, n: int, min_tickets: int) -> DataFrame:
    """The largest keys with the first three point names of each; names are gathered for the keys of the report only."""
    best = top(counts(df, key), key, n, min_tickets)
    own = df.join(best.select(key), key, "left_semi") if n > 0 else df
    rows = with_items(best, first_distinct(own, key, "point_name", 3, out="points"), key, "points").select(key, "points", "tickets")
    return (numbered if n > 0 else numbered_by_ranges)(rows, F.desc("tickets"), F.asc(key))


def get_top_clients(df: DataFrame, n: int = 20, min_tickets: int = 2) -> Result:
    return Result(top_keys(df, "client_normalized", n, min_tickets))


def get_top_points(df: DataFrame, n: int = 20, min_tickets: int = 2) -> Result:
    return Result(top_keys(df, "point_key", n, min_tickets))


def get_top_problems(df: DataFrame, n: int = 20, min_tickets: int = 2) -> Result:
    """Tickets by tag, with three example phrases; a ticket with several tags counts for each."""
    tagged = df.filter(F.coalesce(F.size("problem_tags"), F.lit(0)) > 0).select("*", F.explode("problem_tags").alias("tag"))
    best = top(counts(tagged, "tag"), "tag", n, min_tickets)
    examples = first_distinct(tagged, "tag", "problem_normalized", 3, out="examples", overflow=False, sep="; ")
    return Result(numbered(with_items(best, examples, "tag", "examples").select("tag", "tickets", "examples"), F.desc("tickets"), F.asc("tag")))


def search_client(df: DataFrame, client_name: str) -> Result:
    found = df.filter(contains(F.col("client_normalized"), client_name))
    usual = counts(found, "problem_normalized").orderBy(F.desc("tickets"), "problem_normalized").limit(5)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("tickets")).alias("n"), "problem_normalized")))
    named = F.array_join(F.transform(listed, lambda x: F.concat(x["problem_normalized"], F.lit(" "), (-x["n"]).cast("string"))), "; ")
    # Five rows at most, beside one.
    return Result(preview(found, PREVIEW), facts(found).join(usual.agg(named.alias("top_problems")), F.lit(True)))


def dated(found: DataFrame, as_of: str | None, **when) -> Result:
    kept = filter_by_date(found, as_of=as_of, **when)
    return Result(preview(kept, PREVIEW), facts(kept), period_text(**when))


def search_client_by_date(df: DataFrame, client_name: str, date_from=None, date_to=None, last_n_days=None, consecutive_days=None, as_of=None) -> Result:
    return dated(df.filter(contains(F.col("client_normalized"), client_name)), as_of, date_from=date_from, date_to=date_to, last_n_days=last_n_days, consecutive_days=consecutive_days)


def at_point(df: DataFrame, query: str) -> DataFrame:
    return df.filter(two_part(query, F.col("client_normalized"), F.col("address_normalized"), F.col("point_key")))


def search_point(df: DataFrame, point_query: str) -> Result:
    found = at_point(df, point_query)
    return Result(preview(found, PREVIEW), facts(found))


def search_point_by_date(df: DataFrame, point_query: str, date_from=None, date_to=None, last_n_days=None, consecutive_days=None, as_of=None) -> Result:
    return dated(at_point(df, point_query), as_of, date_from=date_from, date_to=date_to, last_n_days=last_n_days, consecutive_days=consecutive_days)


def select_problems(df: DataFrame, query: str, select: Selector | None = None) -> DataFrame:
    """Rows whose phrase the selector picks among at most 3000 distinct ones, else those that hold any word of the query."""
    if select is not None:
        phrases = [r[0] for r in frequent_values(df, "problem_normalized").select("problem_normalized").collect()]
        chosen = select(query, phrases)
        if isinstance(chosen, str):
            chosen = extract_json(chosen)
        if isinstance(chosen, list):
            wanted = sorted({str(p) for p in chosen})
            return df.filter(F.col("problem_normalized").isin(wanted)) if wanted else df.limit(0)
    return df.filter(any_word(F.col("problem_normalized"), query))


def search_problem(df: DataFrame, problem_query: str, select: Selector | None = None) -> Result:
    found = select_problems(df, problem_query, select)
    return Result(preview(found, PREVIEW), facts(found, F.count_distinct("client_normalized").alias("clients")))


def search_problem_by_date(df: DataFrame, problem_query: str, date_from=None, date_to=None, last_n_days=None, consecutive_days=None, as_of=None, select: Selector | None = None) -> Result:
    return dated(select_problems(df, problem_query, select), as_of, date_from=date_from, date_to=date_to, last_n_days=last_n_days, consecutive_days=consecutive_days)


def search_combined(df: DataFrame, problem_query: str, client_query: str | None = None, point_query: str | None = None, select: Selector | None = None) -> Result:
    """The cheap filter first (a point wins over a client), then the problem."""
    found = at_point(df, point_query) if point_query else df.filter(contains(F.col("client_normalized"), client_query)) if client_query else df
    found = select_problems(found, problem_query, select)
    return Result(preview(found, PREVIEW), facts(found))


def extract_json(text: str) -> object | None:
    """The JSON value in a text, with or without a code fence around it; None if there is none."""
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text or "")
    for own in (body, *re.findall(r"[\[{].*[\]}]", body, re.S)):
        try:
            return json.loads(own)
        except ValueError:
            continue
    return None


def params(required: list[str], *names: str) -> dict:
    kinds = {"n": "integer", "min_tickets": "integer", "last_n_days": "integer", "consecutive_days": "integer"}
    return {"type": "object", "properties": {p: {"type": kinds.get(p, "string")} for p in (*required, *names)}, "required": required}


WHEN = ("date_from", "date_to", "last_n_days", "consecutive_days")
#: Tool name to function, JSON Schema of its arguments, and whether it takes a selector.
TOOLS: dict[str, tuple[Callable[..., Result], dict, bool]] = {
    "get_top_clients": (get_top_clients, params([], "n", "min_tickets"), False),
    "search_client": (search_client, params(["client_name"]), False),
    "search_client_by_date": (search_client_by_date, params(["client_name"], *WHEN), False),
    "get_top_points": (get_top_points, params([], "n", "min_tickets"), False),
    "search_point": (search_point, params(["point_query"]), False),
    "search_point_by_date": (search_point_by_date, params(["point_query"], *WHEN), False),
    "get_top_problems": (get_top_problems, params([], "n", "min_tickets"), False),
    "search_problem": (search_problem, params(["problem_query"]), True),
    "search_problem_by_date": (search_problem_by_date, params(["problem_query"], *WHEN), True),
    "search_combined": (search_combined, params(["problem_query"], "client_query", "point_query"), True),
}


def execute_tool(name: str, arguments: dict, df: DataFrame, select: Selector | None = None) -> Result:
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    run, schema, selects = TOOLS[name]
    unknown = set(arguments) - set(schema["properties"]) - {"as_of"}
    if unknown or set(schema["required"]) - set(arguments):
        raise ValueError(f"{name}: arguments don't fit {sorted(schema['properties'])}")
    return run(df, **arguments, **({"select": select} if selects else {}))


def raw_preview(df: DataFrame, n: int = 100) -> DataFrame:
    return df.select(*[c for c in PREVIEW if c in df.columns][:7]).limit(n)


def digest_rows(df: DataFrame, rows: int = 300, chars: int = 80) -> DataFrame:
    """Up to 300 rows with texts cut to 80 characters, for a reader of bounded input."""
    return df.select(*[F.coalesce(F.substring(F.col(c).cast("string"), 1, chars), F.lit(DASH)).alias(c) for c in PREVIEW if c in df.columns]).limit(rows)
