"""From a question to a tool call: a provider if there is one, else keywords."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.plans.tools import Answer, Result, Selector, digest_rows, execute_tool, extract_json, format_answer
from tidemark.sources.sheets import Tickets
from tidemark.sources.store import QueryLog

# Phrases that choose a report, and words that name a problem.
TOP_CLIENTS = ["кто чаще", "топ клиент", "самые частые клиенты", "клиенты чаще всего"]
TOP_POINTS = ["топ точек", "какие точки", "точки чаще всего", "активные точки", "топ магазин"]
TOP_PROBLEMS = ["проблем", "ошибок", "сбоев", "частые проблемы", "топ проблем"]
PROBLEM_WORDS = ["проблем", "ошибк", "сканер", "касс", "егаис", "утм", "честный знак"]
REPORTS = [("get_top_clients", TOP_CLIENTS), ("get_top_points", TOP_POINTS), ("get_top_problems", TOP_PROBLEMS)]
# What stands before a client's and a point's name of up to three and four words.
CLIENT = re.compile(r"(?:клиент[а]?|у|для)\s+([^\s]+(?:\s+[^\s]+){0,2})")
POINT = re.compile(r"(?:точк[аиеу]|магазин[ае]?)\s+([^\s]+(?:\s+[^\s]+){0,3})")
COUNT = re.compile(r"топ[-\s]*(\d+)")

Chooser = Callable[[str], str]


def by_keywords(question: str) -> dict | None:
    """{tool, arguments} by the first rule that fits: reports, client and problem, client, point, problem."""
    q = question.lower()
    for tool, phrases in REPORTS:
        if any(p in q for p in phrases):
            n = COUNT.search(q)
            return {"tool": tool, "arguments": {"n": int(n.group(1)) if n else 20}}
    found = [m.group() for w in PROBLEM_WORDS if (m := re.search(rf"\b\w*{w}\w*\b", q))]
    client, point, problem = CLIENT.search(q), POINT.search(q), " ".join(found)
    if client and problem:
        return {"tool": "search_combined", "arguments": {"client_query": client.group(1), "problem_query": problem}}
    if client:
        return {"tool": "search_client", "arguments": {"client_name": client.group(1)}}
    if point:
        return {"tool": "search_point", "arguments": {"point_query": point.group(1)}}
    return {"tool": "search_problem", "arguments": {"problem_query": problem}} if problem else None


def by_provider(question: str, choose: Chooser | None) -> dict | None:
    call = extract_json(choose(question)) if choose else None
    return {"tool": call["tool"], "arguments": call.get("arguments") or {}} if isinstance(call, dict) and call.get("tool") else None


def failed(e: Exception) -> str:
    return f"The question could not be answered ({e if isinstance(e, ValueError) else type(e).__name__})."


class Engine:
    """Answers questions over selected sheets of a stored ticket table."""

    def __init__(self, tickets: Tickets, choose: Chooser | None = None, select: Selector | None = None, analyse: Callable[[str, list[dict]], str] | None = None, log: QueryLog | None = None):
        self.tickets, self.choose, self.select, self.analyse, self.log = tickets, choose, select, analyse, log

    def ask(self, question: str, sheets: list[dict]) -> tuple[str, Result | None]:
        """The tool's name and result; without a fitting tool the analyst's words, if there is one. Errors give a message."""
        told, result, call = self._call(question, sheets)
        self._note(question, told, call)
        return told, result

    def answer(self, question: str, sheets: list[dict]) -> Answer:
        """``ask`` as a reader gets it: facts and a numbered preview, or the words that say why there is none.

        Results are lazy, so this is where they run; what fails then gives a message, too, and the log has it.
        """
        told, result, call = self._call(question, sheets)
        if result is not None:
            try:
                out = format_answer(result)
                out.preview_data = self._held(out.preview_data)
            except Exception as e:  # noqa: BLE001
                told, result = failed(e), None
        self._note(question, told, call)
        return Answer("", told, self.tickets.sheets([])) if result is None else out

    def _call(self, question: str, sheets: list[dict]) -> tuple[str, Result | None, dict | None]:
        call = None
        try:
            df = self.tickets.sheets(sheets)
            call = by_provider(question, self.choose) or by_keywords(question)
            if call is None:
                return self.direct(question, df), None, None
            return call["tool"], execute_tool(call["tool"], call["arguments"], df, self.select), call
        except Exception as e:  # noqa: BLE001
            return failed(e), None, call

    def _note(self, question: str, told: str, call: dict | None) -> None:
        if self.log:
            self.log.add("question", question, (call or {}).get("tool", ""), (call or {}).get("arguments"), told)

    @staticmethod
    def _held(preview: DataFrame) -> DataFrame:
        """The preview, at most a hundred rows, as it is now."""
        return preview.sparkSession.createDataFrame(preview.collect(), preview.schema)

    def direct(self, question: str, df: DataFrame) -> str:
        if not self.analyse:
            return "No tool fits the question."
        return self.analyse(question, [r.asDict() for r in digest_rows(df).collect()])
