"""License scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard evaluates licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that must be found, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices of common licences, as words, with the identifiers they stand for.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit", "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0", "lesser general public license": "lgpl", "affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "redistribution and use in source and binary forms": "bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc", "zlib license": "zlib", "boost software license": "bsl-1.0", "this is free and unencumbered software released into the public domain": "unlicense", "cc0 1 0": "cc0-1.0",
    "cc by 4 0": "cc-by-4.0", "cc by sa 4 0": "cc-by-sa-4.0", "cc by nc 4 0": "cc-by-nc-4.0", "cc by nc sa 4 0": "cc-by-nc-sa-4.0", "cc by nd 4 0": "cc-by-nd-4.0", "cc by nc nd 4 0": "cc-by-nc-nd-4.0",
}
# Tags before a licence expression, as words.
TAGS = ("spdx license identifier", "license expression")
#: How much the licences of a family restrict use, by the longest of these beginnings of their names; others are unknown.
RESTRICTS = {
    "cc0": 0.1, "unlicense": 0.1, "0bsd": 0.1, "mit": 0.2, "apache": 0.2, "bsd": 0.2, "isc": 0.2, "zlib": 0.2, "bsl": 0.2, "cc-by": 0.2,
    "lgpl": 0.5, "mpl": 0.5, "epl": 0.5, "gpl": 0.7, "cc-by-sa": 0.7, "agpl": 0.9, "sspl": 0.9, "cc-by-nc": 1.0, "cc-by-nd": 1.0,
}
UNKNOWN, EXCEPTION, LEAST = 0.5, 0.2, 0.1
BINDS = {"or": 1, "and": 2, "with": 3}
#: Between words stand all ASCII characters but letters and digits; A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
OPENS = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")
TOKEN = re.compile(rb"[ \t]*(?:([()])|([0-9A-Za-z][0-9A-Za-z.+-]{0,63})(?![0-9A-Za-z.+-]))")
FINDING = "struct<kind:string,labels:array<string>,start:bigint,words:int,expression:string,restricts:double>"


def restricts(label: str) -> float:
    fits = [p for p in RESTRICTS if label.startswith(p)]
    return RESTRICTS[max(fits, key=len)] if fits else UNKNOWN


def combined(op: str, a: float, b: float) -> float:
    """``and`` binds to the stricter side, ``or`` leaves the laxer one to choose, an exception loosens a licence by a step."""
    return max(a, b) if op == "and" else min(a, b) if op == "or" else max(LEAST, a - EXCEPTION)


def parsed(text: bytes, at: int = 0) -> tuple[list[str], list[str], float] | None:
    """(tokens, licences, restriction) of the longest licence expression at ``at``, None where none stands there.

    It ends where a name or an operator is out of place, as prose after it is. An operator without a right side, and brackets
    never closed, count for nothing; a name of over 64 characters is none.
    """
    values: list[float] = []
    ops: list[str] = []
    tokens: list[str] = []
    names: list[str] = []
    operand = True

    def reduce() -> None:
        op, right = ops.pop(), values.pop()
        values.append(combined(op, values.pop(), right))

    while m := TOKEN.match(text, at):
        bracket, word = m.group(1), (m.group(2) or b"").decode().lower().rstrip(".-")
        if operand:
            after_with = bool(ops) and ops[-1] == "with"
            if bracket == b"(" and not after_with:
                ops.append("(")
            elif word and word not in BINDS:
                values.append(restricts(word))
                if not after_with:
                    names.append(word)
                operand = False
            else:
                break
        elif bracket == b")":
            if "(" not in ops:
                break
            while ops[-1] != "(":
                reduce()
            ops.pop()
        elif word in BINDS:
            if word == "with" and tokens[-1] == ")":
                break
            while ops and ops[-1] != "(" and BINDS[ops[-1]] >= BINDS[word]:
                reduce()
            ops.append(word)
            operand = True
        else:
            break
        tokens.append(bracket.decode() if bracket else word)
        at = m.end()
    if not values:
        return None
    while operand and ops:  # what lacks its right side
        ops.pop()
        tokens.pop()
        operand = bool(tokens) and (tokens[-1] in BINDS or tokens[-1] == "(")
    while ops:
        if ops[-1] == "(":
            ops.pop()
        else:
            reduce()
    return tokens, names, values[-1]


def automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    """Over words between single spaces; a phrase may be a base one and a notice at once."""
    held: dict[str, list[tuple[str, str]]] = {}
    for kind, words in (("base", BASE), ("notice", phrases), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in words.items():
            held.setdefault(f" {phrase} ", []).append((kind, label))
    out = ahocorasick.Automaton()
    for phrase, uses in held.items():
        out.add_word(phrase, (phrase, uses))
    out.make_automaton()
    return out


def spaced(text: bytes) -> bytes:
    """The words of a text, each between two single spaces."""
    t = text.translate(FOLD)
    while b"  " in t:
        t = t.replace(b"  ", b" ")
    return b" " + t.strip(b" ") + b" "


def findings(text: bytes, search: ahocorasick.Automaton) -> tuple[int, list[dict]]:
    """How many words a text has, and what is found in it, by place."""
    words = spaced(text)
    n = words.count(b" ") - 1 if len(words) > 2 else 0
    held, out, tagged, seen, at = words.decode(), [], [], 0, 0
    hits = sorted((end - len(phrase) + 1, phrase, uses) for end, (phrase, uses) in search.iter(held))
    for start, phrase, uses in hits:
        seen, at = seen + held.count(" ", at, start), start
        size = phrase.count(" ") - 1
        for kind, label in uses:
            if kind == "tag":
                tagged.append((seen, size))
            else:
                out.append({"kind": kind, "labels": [label], "start": seen, "words": size, "expression": None, "restricts": restricts(label)})
    if tagged:
        # Tags are rare; only then are words looked up in the text as it was written, all of them in one pass.
        last = {start + size - 1: (start, size) for start, size in tagged}
        for i, m in enumerate(WORD.finditer(text)):
            if i in last and (opens := OPENS.match(text, m.end())) and (found := parsed(text, opens.end())):
                start, size = last[i]
                out.append({"kind": "tag", "labels": sorted(set(found[1])), "start": start, "words": size, "expression": " ".join(found[0]), "restricts": found[2]})
        out.sort(key=lambda f: (f["start"], f["words"], f["kind"]))
    return n, out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words and ``findings`` (kind base, notice or tag; labels; first word and words; expression; how much it restricts) of every row.

    Words are what stands between ASCII characters other than letters and digits, A-Z lower-cased. Phrases are looked for among
    them by one Aho-Corasick automaton, whatever stands between the words. A tag counts if a colon or equals sign and a licence
    expression follow it in the text. Null texts are empty ones; rows without an id, repeated rows and very long texts are
    scanned as any other; other columns, whatever their names, are not read; an empty table gives none. No shuffle.
    """
    phrases = NOTICES if notices is None else notices
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("labels", pa.list_(pa.string())), ("start", pa.int64()), ("words", pa.int32()), ("expression", pa.string()), ("restricts", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton(phrases)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            done = [findings(t.as_py() or b"", search) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in done], pa.int64()), pa.array([f for _, f in done], kinds)], names=["doc_id", "n_words", "findings"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, findings array<{FINDING}>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, places of base phrases, labels, and as ``score`` how much the strictest finding restricts use (0: nothing found)."""
    base = F.filter("findings", lambda f: f["kind"] == "base")
    starts = F.transform(base, lambda f: f["start"])
    joined = lambda fs: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(fs, lambda f: f["labels"])))), ",")
    score = F.coalesce(F.array_max(F.transform("findings", lambda f: f["restricts"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("findings")).alias("labels"), score.alias("score"))
