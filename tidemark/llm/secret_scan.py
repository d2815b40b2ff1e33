"""Secret scans through an incremental ledger of content-addressed blobs (DataFrame functions only)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import bind, cut_lineage, distinct_by, own_names, shared_dir

#: The base rules. Kind, pattern, group whose length counts, least length, text that any match holds.
BASE_RULES = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, None),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    ("hex", r"[0-9a-f]{16,}", 0, 16, None),
]
#: Kinds that only this library looks for; the first is found by ``private_keys``.
MORE_RULES = [
    ("pem", None, 0, 1, "PRIVATE KEY"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, "eyJ"),
]
#: The lines around a private key, and lines of one that is cut off: headers, and words of base64.
KEY_MARK = r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
KEY_HEADER, KEY_WORD = r"^\s*[A-Za-z0-9-]+: ", r"[A-Za-z0-9+/=]{16,}"
#: Rule version to its rules: a blob is scanned once for each version, ever. A changed rule needs a new version name.
RULE_SETS = {"base-1": BASE_RULES, "more-3": MORE_RULES}
KINDS = [kind for rules in RULE_SETS.values() for kind, *_ in rules]
SPAN = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"
#: Addresses and findings that are broadcast at most (some 150 bytes each); beyond, joins shuffle.
BROADCAST_BLOBS, BROADCAST_SPANS = 50_000, 500_000
#: Matches of a text that are added up at a time, and its characters that are cut out together.
STEP, PIECE = 256, 4096


def running(items: Column, kind: str, start: Column, step: Callable[[Column, Column], Column], one: str) -> Column:
    """What ``step`` appends over all ``items``, as an array of ``kind``; its state goes on from item to item.

    ``step`` takes (state, item) and gives a struct of the next state, ``at``, and of what it appends, ``add`` (an array);
    ``one`` is the state's type. Items are taken in runs of STEP, so that an array never grows by single items to more than that: arrays
    can't be appended to in place, and one for all items would be copied for each of them.
    """
    empty, nested = F.array().cast(kind), F.array().cast(f"array<{kind}>")

    def inner(state: Column, item: Column) -> Column:
        return bind(step(state["at"], item), lambda r: F.struct(r["at"].alias("at"), F.when(F.size(r["add"]) > 0, F.concat(state["out"], r["add"])).otherwise(state["out"]).alias("out")))

    def outer(state: Column, run: Column) -> Column:
        own = F.aggregate(run, F.struct(state["at"].alias("at"), empty.alias("out")), inner)
        return bind(own, lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")))

    runs = bind(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STEP).cast("int")), lambda i: F.slice(x, i * STEP + 1, F.lit(STEP))))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(runs, F.struct(start.cast(one).alias("at"), nested.alias("out")), outer, lambda r: r["out"]))).otherwise(empty)


def spans(text: Column, kind: str, pattern: str, group: int, least: int, needs: str | None) -> Column:
    """Code-point spans of the leftmost non-overlapping matches whose group is long enough, as ``SPAN``.

    The pieces between matches and the matches themselves alternate, so their lengths add up to positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = lambda c: F.transform(c, lambda x: F.char_length(x).cast("long"))
    columns = [sizes(F.split(text, pattern, -1)).alias("gap"), sizes(found).alias("len")]
    if group:
        columns.append(sizes(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("own"))

    def step(at: Column, p: Column) -> Column:
        begin, end = at + p["gap"], at + p["gap"] + p["len"]
        one = F.array(F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"), F.lit(kind).alias("kind")))
        # What stands after the last match has no length of a match.
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(p["own" if group else "len"] >= least, one).otherwise(F.array().cast(SPAN)).alias("add"))

    # The cheap test first: most texts hold no match, and are split only if they do.
    maybe = text.rlike(pattern) if needs is None else text.contains(needs)
    return F.coalesce(F.when(maybe, running(F.arrays_zip(*columns), SPAN, F.lit(0), step, "bigint")), F.array().cast(SPAN))


def key_lines(after: Column) -> Column:
    """Characters of ``after``, the text behind the first line of a private key, up to the end of its last line.

    Lines go on while they are blank, headers, or words of base64 of 16 characters or more; blank lines at the end don't count.
    """
    words = lambda line: F.trim(F.regexp_replace(F.regexp_replace(line, KEY_WORD, ""), r"\s", ""))
    blank = lambda line: ~line.rlike(r"\S")

    def among(lines: Column) -> Column:
        # The rest of the first line is none of a header.
        own = F.transform(lines, lambda line, i: (words(line) == "") | ((i > 0) & line.rlike(KEY_HEADER)))
        n = F.coalesce(F.nullif(F.array_position(own, False), F.lit(0)) - 1, F.size(lines).cast("long")).cast("int")
        kept = F.transform(F.slice(lines, F.lit(1), n), lambda line: F.struct((F.char_length(line) + 1).cast("long").alias("n"), blank(line).alias("blank")))
        # Length so far, and length up to the last line that wasn't blank.
        start = F.struct(F.lit(0).cast("long").alias("all"), F.lit(0).cast("long").alias("end"))
        return F.aggregate(kept, start, lambda s, x: F.struct((s["all"] + x["n"]).alias("all"), F.when(x["blank"], s["end"]).otherwise(s["all"] + x["n"] - 1).alias("end")), lambda s: s["end"])

    return bind(F.split(after, "\n", -1), among)


def private_keys(text: Column) -> Column:
    """Spans of private keys: from a BEGIN line to its END line, however long, or as far as the lines of a key go where another BEGIN or no mark follows.

    Between marks the text is cut into pieces, so each character is looked at a bounded number of times.
    """
    kinds, marks, pieces = F.regexp_extract_all(text, F.lit(KEY_MARK), F.lit(1)), F.regexp_extract_all(text, F.lit(KEY_MARK), F.lit(0)), F.split(text, KEY_MARK, -1)
    size = lambda c: F.char_length(c).cast("long")

    def items(all_: Column) -> Column:
        def one(mark: Column, i: Column) -> Column:
            after, closed = F.get(all_["pieces"], i + 1), F.coalesce(F.get(all_["kinds"], i + 1) == "END", F.lit(False))
            more = F.when(closed, size(after) + size(F.get(all_["marks"], i + 1))).otherwise(key_lines(after))
            return F.struct(size(F.get(all_["pieces"], i)).alias("gap"), size(mark).alias("len"), F.when(F.get(all_["kinds"], i) == "BEGIN", more).alias("more"))

        return F.transform(all_["marks"], one)

    def step(at: Column, p: Column) -> Column:
        begin, end = at + p["gap"], at + p["gap"] + p["len"]
        span = F.struct(begin.alias("start"), F.lit(KINDS.index("pem")).alias("ord"), (end + p["more"]).alias("end"), F.lit("pem").alias("kind"))
        return F.struct(end.alias("at"), F.when(p["more"].isNotNull(), F.array(span)).otherwise(F.array().cast(SPAN)).alias("add"))

    found = bind(F.struct(kinds.alias("kinds"), marks.alias("marks"), pieces.alias("pieces")), items)
    return F.coalesce(F.when(text.contains("PRIVATE KEY") & text.contains("-----BEGIN "), running(found, SPAN, F.lit(0), step, "bigint")), F.array().cast(SPAN))


def rule_spans(text: Column, rules: list[tuple]) -> Column:
    return F.concat(*[spans(text, *rule) if rule[1] else private_keys(text) for rule in rules])


def scan_unseen(blobs: DataFrame, ledger: str, rule_sets: dict[str, list[tuple]]) -> None:
    """Append to the ledger one row (blob, rule_version, findings) for each pair that it lacks; ``blobs``: blob, text.

    Texts stay where they are: only those of blobs that repeat, or of very many unseen blobs beside an old ledger, are shuffled.
    """
    spark = blobs.sparkSession
    versions = F.array(*[F.lit(v) for v in rule_sets])
    todo = distinct_by(blobs, "blob", BROADCAST_BLOBS).withColumn("todo", versions)
    if ledger_exists(ledger):
        seen = spark.read.parquet(ledger).groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        unseen = blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
        unseen = cut_lineage(unseen.filter(F.size("todo") > 0))
        asked = F.broadcast(unseen) if unseen.count() <= BROADCAST_BLOBS else unseen
        todo = distinct_by(blobs.join(asked, "blob"), "blob", BROADCAST_BLOBS)
    each = F.array(*[F.when(F.array_contains("todo", v), F.struct(F.lit(v).alias("rule_version"), rule_spans(F.col("text"), rules).alias("findings"))) for v, rules in rule_sets.items()])
    found = todo.select("blob", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("blob", "f.rule_version", "f.findings")
    found.write.mode("append").parquet(ledger)


def ledger_exists(ledger: str) -> bool:
    store, path = pafs.FileSystem.from_uri(ledger if ":/" in ledger else f"file://{ledger}")
    return store.get_file_info(f"{path}/_SUCCESS").type == pafs.FileType.File


def new_ledger(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"


def findings(docs: DataFrame, ledger: str, rule_sets: dict[str, list[tuple]] | None = None, text_col: str = "text", blob_col: str = "tm_blob", spans_col: str = "tm_spans") -> DataFrame:
    """``docs`` with its blob address and the spans found in it (null: none), in two new columns.

    Every row is one version of one path. Equal contents are one blob; only pairs of blob and rule version that the ledger
    lacks are scanned, whole. Null texts are empty.
    """
    spark, rule_sets = docs.sparkSession, rule_sets or RULE_SETS
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumn(blob_col, F.sha2(text, 256))
    scan_unseen(docs.select(F.col(blob_col).alias("blob"), text.alias("text")), ledger, rule_sets)
    held = spark.read.parquet(ledger).filter(F.col("rule_version").isin(*rule_sets) & (F.size("findings") > 0))
    # From files again, so that the join below can split the rows of one blob that very many paths hold.
    found = F.array_sort(F.flatten(F.collect_list("findings")))
    # Sorted, so that a span found twice stands beside itself.
    once = bind(F.col(spans_col), lambda all_: F.filter(all_, lambda s, i: (i == 0) | (s != F.get(all_, i - 1))))
    by_blob = cut_lineage(held.groupBy(F.col("blob").alias(blob_col)).agg(found.alias(spans_col)).withColumn(spans_col, once))
    size = by_blob.agg(F.count("*").alias("blobs"), F.sum(F.size(spans_col)).alias("spans")).first()
    small = size["blobs"] <= BROADCAST_BLOBS and (size["spans"] or 0) <= BROADCAST_SPANS
    return docs.join(F.broadcast(by_blob) if small else by_blob, blob_col, "left")


def scan_secrets(docs: DataFrame, ledger: str | None = None, rule_sets: dict[str, list[tuple]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob and spans (start, ord, end, kind; sorted) of every row; rows without a secret have an empty array.

    Without ``ledger`` the scan starts a new one in the shared folder. Null texts are empty; repeated rows and rows without
    an id each have their own result; very long texts are scanned whole, in time that grows little faster than their
    matches; spans of one place are ordered as the kinds are listed; other columns, whatever their names, are not read; an
    empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = findings(rows, ledger or new_ledger(docs.sparkSession), rule_sets)
    return found.select("doc_id", F.col("tm_blob").alias("blob"), F.coalesce("tm_spans", F.array().cast(SPAN)).alias("spans"))


def without(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each run of overlapping ``spans`` (sorted) replaced by ``mark``.

    The text is cut into pieces of PIECE characters first, as reaching a character means reading all before it.
    """
    gap = "array<struct<a:bigint,z:bigint>>"

    def step(at: Column, s: Column) -> Column:
        # Kept parts lie between the end of all spans so far and the next start.
        return F.struct(F.greatest(at, s["end"]).alias("at"), F.when(s["start"] >= at, F.array(F.struct(at.alias("a"), s["start"].alias("z")))).otherwise(F.array().cast(gap)).alias("add"))

    def cut(pieces: Column, a: Column, z: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        own = F.array_join(F.slice(pieces, first + 1, F.greatest(F.lit(0), F.ceil(z / PIECE).cast("int") - first)), "")
        return F.substring(own, (a - first * PIECE + 1).cast("int"), (z - a).cast("int"))

    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    kept = F.concat(running(spans, gap, F.lit(0), step, "bigint"), F.array(F.struct(end.alias("a"), F.char_length(text).cast("long").alias("z"))))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return bind(pieces, lambda p: F.array_join(F.transform(kept, lambda k: cut(p, k["a"], k["z"])), mark))


def redact(docs: DataFrame, ledger: str | None = None, mark: str = "[SECRET]", text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with each secret (overlapping ones as one) replaced by ``mark``.

    Null texts stay null; repeated rows all stay; very long texts are redacted whole; n_chars follows where a text changed;
    columns of any other name pass as they are; an empty table gives none.
    """
    columns = docs.columns
    blob, spans, new = own_names(docs, "tm_blob", "tm_spans", "tm_text")
    found = findings(docs, ledger or new_ledger(docs.sparkSession), None, text_col, blob, spans)
    changed = F.col(spans).isNotNull() & F.col(text_col).isNotNull()
    # A step of its own: in one select the new text's alias would be taken for the text that the lambdas read.
    found = found.withColumn(new, F.when(changed, without(F.col(text_col), F.col(spans), mark)).otherwise(F.col(text_col)))
    out = {text_col: F.col(new)}
    if n_chars_col in columns:
        out[n_chars_col] = F.when(changed, F.char_length(new).cast("long")).otherwise(F.col(n_chars_col))
    return found.select(*[out[c].alias(c) if c in out else F.col(c) for c in columns])


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of ``scan_secrets``: counts of the base kinds, a hash of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_RULES))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind, *_ in BASE_RULES], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
