"""Text functions as Column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name the kind of a place or part of a building and are left out of an address fingerprint.
ADDRESS_TYPE_WORDS = [
    "ул", "улица", "мкр", "мкрн", "микрорайон", "мн", "микн", "квл", "квартал", "пер", "переулок", "пркт", "просп", "проспект", "ш", "шоссе", "бр", "бульвар",
    "наб", "набережная", "проезд", "тракт", "аллея", "линия", "д", "дом", "влд", "двлд", "зд", "здание", "уч", "участок", "корп", "корпус", "стр", "строение",
    "кв", "квартира", "пом", "помещ", "помещение", "оф", "офис", "эт", "этаж",
]
# Legal forms of companies, and those that may stand before a client's qualifier.
LEGAL_FORMS = ["ип", "ооо", "зао", "оао", "пао", "ао", "нко", "ано"]
MARKER_FORMS = ["ИП", "ООО", "ЗАО", "ОАО", "ПАО", "АО"]

WORD_END = r"(?![0-9\p{L}_])"
WORD_START = r"(?<![0-9\p{L}_])"


def clean(c: Column) -> Column:
    """Trimmed of all white space; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def null_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def norm_key(c: Column) -> Column:
    """Comparison key: lower case, ё as е, only digits and Latin or Russian letters."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е"), "[^0-9a-zа-я]", "")


def word_key(c: Column) -> Column:
    """Lower case letters and digits of any script."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def address_fingerprint(address: Column, city: Column) -> Column:
    """Street and house without city, kind words, case and punctuation: the anchor of "the same house".

    Patterns over the whole text, not a lambda over its words: these stay in generated code.
    """
    a, prefix = clean(address), F.concat(F.coalesce(city, F.lit("")), F.lit(","))
    cut = (F.length(prefix) > 1) & F.startswith(F.lower(a), F.lower(prefix))
    tail = F.when(cut, F.substring(a, F.length(prefix) + 1, F.length(a))).otherwise(a)
    keys = F.regexp_replace(F.translate(F.lower(tail), "ё", "е"), r"[^0-9a-zа-я\s,]", "")
    return F.regexp_replace(F.regexp_replace(keys, rf"(?<![^\s,])(?:{'|'.join(ADDRESS_TYPE_WORDS)})(?![^\s,])", ""), r"[\s,]+", "")


def house_key(address: Column, city: Column) -> Column:
    return F.concat(norm_key(city), F.lit("|"), address_fingerprint(address, city))


def known_house(address: Column, city: Column) -> Column:
    """``house_key``, null where the address has no fingerprint; the fingerprint, which is costly, is worked out once."""
    return F.concat(norm_key(city), F.lit("|"), null_if_blank(address_fingerprint(address, city)))


def token_set(c: Column) -> Column:
    """Distinct lower-case words of digits and Latin or Russian letters."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^0-9a-zа-яё\s]", " "), r"\s+"), lambda x: x != ""))


def all_score_words(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[\u0080-\u00ff]", ""), r"[^\p{L}\p{N}_]", " ")
    return F.filter(F.split(F.lower(bare), r"\s+"), lambda w: w != "")


def score_words(c: Column) -> Column:
    """The distinct words that the token-set score compares (see ``similarity.words``)."""
    return F.array_distinct(all_score_words(c))


def sorted_words(c: Column) -> Column:
    """The text that the token-sort score compares: its words, repeats included, in order."""
    return F.array_join(F.array_sort(all_score_words(c)), " ")


def legal_forms(c: Column) -> Column:
    """The distinct legal forms in a name, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"{WORD_START}({'|'.join(LEGAL_FORMS)}){WORD_END}"), F.lit(1))))


def leads_with_form(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(rf"^\s*({'|'.join(LEGAL_FORMS)}){WORD_END}"), F.lit(False))


def strip_marker(c: Column) -> Column:
    """Without one leading legal form."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?iu)^({'|'.join(MARKER_FORMS)})\s+", "")


def has_marker(c: Column) -> Column:
    return F.coalesce(c.rlike(rf"(?iu)^({'|'.join(MARKER_FORMS)})\s+"), F.lit(False))


def ticket_number(c: Column) -> Column:
    """The first digits-digits, else the trimmed text; null becomes empty."""
    return F.coalesce(null_if_blank(F.regexp_extract(c, r"\d+-\d+", 0)), clean(c))


def compose_address(city: Column, street: Column, house: Column, block: Column, flat: Column) -> Column:
    """``city, street, house[/block], flat`` without empty parts; a block needs a house."""
    city, street, house, block, flat = (clean(x) for x in (city, street, house, block, flat))
    full = F.when(house == "", F.lit("")).when(block == "", house).otherwise(F.concat_ws("/", house, block))
    return F.concat_ws(", ", *[null_if_blank(x) for x in (city, street, full, flat)])


def keep_known(tags: Column, known: list[str], fallback: str) -> Column:
    """Tags in the closed list, in their order; only the fallback where none is."""
    allowed = F.array(*[F.lit(x) for x in known]) if known else F.array().cast("array<string>")
    kept = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.array_contains(allowed, t))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(fallback)))


def lookup(words: dict[str, str]) -> Column:
    """A small dictionary (the glossary's, a few dozen words) as a map literal."""
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv]) if words else F.create_map().cast("map<string,string>")


def expand_point(raw: Column, qualifiers: dict[str, str], brands: dict[str, str], default_brand: str) -> Column:
    """``<brand> <qualifier> <rest>`` for names that hold a qualifier word; other names only trimmed.

    Words match whole, by ``word_key``. The first qualifier counts. A listed brand replaces the default one, unless the
    default is written out: then the listed one opens the rest.
    """
    text = clean(raw)
    if not qualifiers:
        return text
    q, b, own = lookup(qualifiers), lookup(brands), F.lower(F.lit(default_brand))
    start = F.struct(F.lit(None).cast("string").alias("q"), F.lit(None).cast("string").alias("b"), F.lit(False).alias("own"), F.array().cast("array<string>").alias("tail"))

    def step(acc: Column, token: Column) -> Column:
        key = word_key(token)
        is_q = acc["q"].isNull() & q[key].isNotNull()
        is_own = ~is_q & (key == own)
        is_b = ~is_q & ~is_own & acc["b"].isNull() & b[key].isNotNull()
        return F.struct(
            F.when(is_q, q[key]).otherwise(acc["q"]).alias("q"),
            F.when(is_b, b[key]).otherwise(acc["b"]).alias("b"),
            (acc["own"] | is_own).alias("own"),
            F.when((key == "") | is_q | is_own | is_b, acc["tail"]).otherwise(F.concat(acc["tail"], F.array(token))).alias("tail"),
        )

    def finish(acc: Column) -> Column:
        head = F.when(acc["own"], F.lit(default_brand)).otherwise(F.coalesce(acc["b"], F.lit(default_brand)))
        demoted = F.when(acc["own"] & acc["b"].isNotNull(), F.array(acc["b"])).otherwise(F.array().cast("array<string>"))
        return F.when(acc["q"].isNull(), text).otherwise(F.array_join(F.concat(F.array(head, acc["q"]), demoted, acc["tail"]), " "))

    return F.aggregate(F.split(text, r"\s+"), start, step, finish)


def split_point(name: Column, qualifiers: dict[str, str]) -> Column:
    """struct(brand, form, territory); a name without a qualifier word is all brand."""
    text = F.coalesce(name, F.lit(""))
    whole = F.struct(text.alias("brand"), F.lit("").alias("form"), F.lit("").alias("territory"))
    if not qualifiers:
        return whole
    q = lookup(qualifiers)
    # Few names have one; the others aren't taken apart.
    keyed = F.regexp_replace(F.translate(F.lower(text), "ё", "е"), r"[^0-9a-zа-я\s]", "")
    some = keyed.rlike(rf"(?<!\S)(?:{'|'.join(qualifiers)})(?!\S)")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    at = F.coalesce(F.array_position(F.transform(words, lambda w: q[norm_key(w)].isNotNull()), True), F.lit(0)).cast("int")
    rest = F.filter(words, lambda w, i: i != at - 1)
    parts = F.struct(F.coalesce(F.get(rest, F.lit(0)), F.lit("")).alias("brand"), q[norm_key(F.get(words, at - 1))].alias("form"), F.array_join(F.slice(rest, F.lit(2), F.size(words)), " ").alias("territory"))
    return F.when(some, F.when(at > 0, parts).otherwise(whole)).otherwise(whole)


def safe_to_merge(a: Column, b: Column) -> Column:
    """Whether two similar names may be one: no two different legal forms, no name much shorter, no own long word on both sides."""
    fa, fb = legal_forms(a), legal_forms(b)
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    own = lambda x, y: F.exists(F.array_except(token_set(x), token_set(y)), lambda w: F.length(w) >= 4)
    return ~((F.size(fa) > 0) & (F.size(fb) > 0) & (fa != fb)) & (ratio >= 0.5) & ~(own(a, b) & own(b, a))


def point_key(identity: Column, address: Column) -> Column:
    """``identity | address``, whichever of them there is, or null."""
    return null_if_blank(F.concat_ws(" | ", null_if_blank(clean(identity)), null_if_blank(clean(address))))
