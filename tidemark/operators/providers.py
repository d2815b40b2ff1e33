"""What providers of the normalisation may answer, and providers by rules that need no model.

A provider gets a batch of raw values and answers with a row for each (see ``normalize.Provider``). ``pairs_held`` and ``problems_held`` wrap any
provider, a remote model's too: what breaks the contract is put right where the pair's own texts settle it and emptied where they don't, so that
no guess is stored.

* Pairs: a client has its legal form first; a qualifier is a name that stands in the texts; the city comes from the address alone; address
  fields are bare names and numbers, except that blocks of a town keep their kind, in one form and in front.
* Problems: a phrase of at most seven words, one to three categories of the closed list; what fits none of them is unassigned.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from tidemark.functions.text import LEGAL_FORMS
from tidemark.schema import UNASSIGNED

Provider = Callable[[list], dict]
PAIR_FIELDS = ("client_normalized", "client_qualifier", "point_name", "city", "street", "house", "korpus", "apartment")
MOST_WORDS, MOST_TAGS = 7, 3

# Words for the kind of an address part, by the field that the part goes to.
KINDS = {
    "city": ["г", "гор", "город", "п", "пос", "поселок", "посёлок", "пгт", "с", "село", "ст", "станция", "деревня"],
    "street": ["ул", "улица", "просп", "проспект", "пр-кт", "пер", "переулок", "ш", "шоссе", "б-р", "бульвар", "наб", "набережная", "проезд"],
    "house": ["д", "дом"],
    "korpus": ["корп", "корпус", "стр", "строение"],
    "apartment": ["кв", "квартира", "пом", "помещ", "помещение", "оф", "офис"],
}
# Kinds that stay, by the one form that they get.
BLOCKS = {"мкр.": ["мкр", "мкрн", "микрорайон", "м-н", "мик-н"], "кв-л": ["кв-л", "квартал"]}

FIELD_OF = {word: field for field, own in KINDS.items() for word in own}
BLOCK_OF = {word: form for form, own in BLOCKS.items() for word in own}
WORDS, QUALIFIER = re.compile(r"\w+"), re.compile(r"\s/\s*([^\W\d_]{2,})\s*$")


def found_words(text: str) -> set[str]:
    return set(WORDS.findall(text.lower().replace("ё", "е")))


def form_first(client: str) -> str:
    """The client with a legal form that ends it in front: the form is a mark, not part of the name."""
    head, _, last = client.rpartition(" ")
    return f"{last.upper()} {head.rstrip(', ')}" if head and last.lower() in LEGAL_FORMS else client


def bare(part: str) -> tuple[str, str]:
    """(field, value) of a part of an address: the field that its kind word names, or none, and what is left without that word."""
    words = part.split()
    for at in (0, -1):
        kind = words[at].lower().rstrip(".") if len(words) > 1 else ""
        rest = " ".join(words[1:] if at == 0 else words[:-1])
        if kind in BLOCK_OF:
            return "street", f"{BLOCK_OF[kind]} {rest}"
        # Before a name this kind of a house is a village.
        if kind in FIELD_OF and (at == 0 or FIELD_OF[kind] in ("city", "street")):
            return ("city" if kind == "д" and not rest[0].isdigit() else FIELD_OF[kind]), rest
    return "", part


def pairs_held(provider: Provider) -> Provider:
    """The provider, held to the contract of pairs. Answers that aren't rows are left out, so that they are asked for again."""

    def held(items: list) -> dict:
        out = {}
        for (client, address), row in provider(items).items():
            if not isinstance(row, dict):
                continue
            got = {f: str(row.get(f) or "").strip() for f in PAIR_FIELDS}
            in_client, in_address = found_words(client), found_words(address)
            got["client_normalized"] = form_first(got["client_normalized"])
            if not found_words(got["client_qualifier"]) - set(LEGAL_FORMS) <= in_client | in_address:
                got["client_qualifier"] = ""
            for field in ("city", "street", "house", "korpus", "apartment"):
                got[field] = bare(got[field])[1] if got[field] else ""
            city = found_words(got["city"])
            # A city may be spelled out of a short form of the address; one that the client's text alone has is a territory, not a place.
            if not in_address or (city <= in_client and not city <= in_address):
                got["city"] = ""
            out[client, address] = got
        return out

    return held


def problems_held(provider: Provider, categories: list[str]) -> Provider:
    """The provider, held to the contract of problems. Answers that aren't rows are left out, so that they are asked for again."""
    known = set(categories)

    def held(items: list) -> dict:
        out = {}
        for text, row in provider(items).items():
            if isinstance(row, dict):
                tags = row.get("tags")
                tags = [t for t in dict.fromkeys(tags if isinstance(tags, list) else []) if t in known][:MOST_TAGS]
                phrase = " ".join(str(row.get("normalized") or "").split()[:MOST_WORDS])
                out[text] = {"normalized": phrase or text, "tags": tags or [UNASSIGNED]}
        return out

    return held


def pair_by_rules(client: str, address: str) -> dict:
    """The client as it is written, the address by the kind words of its parts, else by their places: city, street, house, the rest."""
    row = dict.fromkeys(PAIR_FIELDS, "")
    row["client_normalized"] = client
    second = QUALIFIER.search(address)
    if second and client:
        row["client_qualifier"], address = f"ИП {second[1]}", address[: second.start()]
    parts = [p.strip() for p in address.split(",") if p.strip()]
    sorted_ = [bare(p) for p in parts]
    if len(parts) == 1 and not sorted_[0][0] and not any(c.isdigit() for c in address):
        return row | {"street": parts[0]}
    for field, value in sorted_:
        if not field:
            places = ("house", "korpus", "apartment") if value[0].isdigit() else ("city", "street")
            field = next((f for f in places if not row[f]), places[-1])
        # Of several the last is kept: a village follows its town.
        row[field] = value
    return row


def pairs_by_rules(items: list) -> dict:
    """A provider of pairs without a model."""
    return pairs_held(lambda own: {(c, a): pair_by_rules(c, a) for c, a in own})(items)


def problems_by_rules(categories: list[tuple[str, str]]) -> Provider:
    """A provider of problems without a model: the first words, and the categories whose name or description shares most words with the text."""
    wanted = [(name, found_words(f"{name} {said}")) for name, said in categories]

    def ask(items: list) -> dict:
        out = {}
        for text in items:
            own = found_words(text)
            shared = sorted(((-len(own & words), at, name) for at, (name, words) in enumerate(wanted) if own & words))
            out[text] = {"normalized": text, "tags": [name for _, _, name in shared]}
        return out

    return problems_held(ask, [name for name, _ in categories])
