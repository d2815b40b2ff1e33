"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import give_back, small_batches

#: Bounds of the labelled sample, parameters of ``learned``: rows of a language, characters of a row (a window at a hashed
#: place), and languages; more languages are an error.
SAMPLE_ROWS, ROW_CHARS, LANGUAGES = 256, 256, 200
#: Shares in which a language's sample is cut down before it comes together.
SHARES = 64
#: Symbols parsed in one piece; pieces of all texts advance together, and phrases go on over their ends.
PIECE = 512
#: Symbols times languages that are parsed together.
SLICE = 1 << 22
UNKNOWN, GAP = 0, 1
UNDETERMINED = "und"
#: A text is in no learned language if even the nearest needs over MAX_BITS for each symbol (a parameter), SPARE phrases not
#: counted, which let short texts stay. Text of a learned language needs 2 to 4, random letters 9 and more, strange scripts 15.
MAX_BITS, SPARE = 7.0, 4


def learned(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = SAMPLE_ROWS, chars: int = ROW_CHARS, languages: int = LANGUAGES) -> dict[str, str]:
    """Language to training text: windows of a bounded sample of the labelled rows, those of the least hashes.

    The driver gets ``rows`` windows of ``chars`` characters for each language at most, and an error for over ``languages``
    of them. Tasks cut their rows to the sample before any shuffle; a window's place depends on id and length alone. Null
    labels and texts and texts without a letter aren't learned from; equal windows count once; an empty table gives none.
    """
    named = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    h = F.xxhash64(F.lit(7), F.col(id_col))
    begin = F.pmod(h, F.greatest(F.lit(1), F.char_length(text_col) - chars + 1).cast("long")).cast("int") + 1
    least = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "piece"))
    found = named.select(F.col(lang_col).alias("lang"), h.alias("h"), F.substring(F.col(text_col), begin, F.lit(chars)).alias("piece"))
    # First within shares of a language, so that no task gets the samples of all tasks.
    shares = found.withColumn("share", F.pmod("h", F.lit(SHARES))).withColumn("nth", least("lang", "share")).filter(F.col("nth") <= rows).drop("share")
    sample = shares.withColumn("nth", least("lang")).filter(F.col("nth") <= rows)
    # The limit only bounds what the driver gets before it sees that there are too many.
    held = sample.limit(languages * rows + 1).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(held, key=lambda r: (r["lang"], r["nth"])):
        own = texts.setdefault(r["lang"], [])
        if r["piece"] not in own:
            own.append(r["piece"])
    if len(texts) > languages or len(held) > languages * rows:
        raise ValueError(f"over {languages} languages are labelled")
    return {lang: "\0".join(pieces) for lang, pieces in texts.items()}


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of the runs of ``symbols`` between UNKNOWN ones; state 0 is its start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        if c == UNKNOWN:
            last = 0
            continue
        if c in nxt[last] and length[q := nxt[last][c]] == length[last] + 1:
            last = q
            continue
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = copy
                link[cur] = copy
                if last == q:
                    last = copy
        last = cur
    return nxt


class Transitions:
    """All automata in one array: the transition of a state by a symbol lies at state + symbol, beside the state itself.

    States are numbered so that no two transitions meet: they draw places until all of theirs are free, those of most
    transitions first. Some 40 bytes a transition; one look at memory for a step.
    """

    def __init__(self, owner: np.ndarray, symbol: np.ndarray, target: np.ndarray, states: int, width: int):
        degree = np.bincount(owner, minlength=states)
        order = np.argsort(owner, kind="stable")
        owner, symbol, target = owner[order], symbol[order], target[order]
        first = np.cumsum(degree) - degree
        room = max(64, 3 * len(owner), 2 * states)
        self.place = np.full(states, -1, dtype=np.int64)
        taken, used = np.zeros(room + width, dtype=bool), np.zeros(room, dtype=bool)
        rng = np.random.default_rng(1)
        low = [0, 1, 2, 4, 8, 16, 32, 64, 256, 1 << 40]
        for a, z in zip(low[-2::-1], low[:0:-1], strict=True):
            left, rounds = np.flatnonzero((degree >= a) & (degree < z)), 0
            while left.size:
                rounds += 1
                if rounds % 64 == 0:
                    taken, used = np.concatenate([taken, np.zeros(room, dtype=bool)]), np.concatenate([used, np.zeros(room, dtype=bool)])
                guess = rng.integers(0, len(used), len(left))
                n = degree[left]
                nth = np.repeat(np.arange(len(left)), n)
                own = np.arange(len(nth)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[left], n)
                slot = guess[nth] + symbol[own]
                # Of those that want one place, the last to claim it may have it.
                claim, claims = np.zeros(len(taken), dtype=np.int32), np.zeros(len(used), dtype=np.int32)
                claim[slot], claims[guess] = nth, np.arange(len(left))
                bad = taken[slot] | (claim[slot] != nth)
                ok = ~used[guess] & (claims[guess] == np.arange(len(left))) & (np.bincount(nth[bad], minlength=len(left)) == 0)
                self.place[left[ok]] = guess[ok]
                used[guess[ok]] = True
                taken[slot[ok[nth]]] = True
                left = left[~ok]
        self.table = np.full(len(taken), -1, dtype=np.int64)
        self.table[self.place[owner] + symbol] = self.place[owner] << 32 | self.place[target]

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each state goes by the symbol, and whether it goes anywhere (else the first is of no meaning)."""
        held = self.table.take(state + symbol)
        return held & 0xFFFFFFFF, (held >> 32) == state


class CrossParser:
    """Parses texts into the longest phrases that a language's training text holds; the fewest for its size wins.

    A language's phrases come from its suffix automaton: a phrase goes on while there is a transition. Every letter of the
    training texts is a symbol of its own, others are phrases of one symbol in every language.
    """

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        letters = sorted({c.lower()[0] for t in texts.values() for c in t if c.isalpha()})
        number = {c: i + 2 for i, c in enumerate(letters)}
        self.symbols = np.full(0x110000, GAP, dtype=np.int32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                self.symbols[i] = number.get(c.lower()[0], UNKNOWN)
        self.symbols[0xD800:0xE000] = GAP
        self.width = len(letters) + 2
        owner, symbol, target, starts, sizes, at = [], [], [], [], [], 0
        for lang in self.langs:
            symbols, _, _ = self.read([texts[lang].replace("\0", "\U0010ffff")], split="\U0010ffff")
            nxt = automaton(symbols.tolist())
            degree = np.fromiter(map(len, nxt), dtype=np.int64, count=len(nxt))
            owner.append(at + np.repeat(np.arange(len(nxt)), degree))
            symbol.append(np.fromiter((c for own in nxt for c in own), dtype=np.int64, count=degree.sum()))
            target.append(at + np.fromiter((to for own in nxt for to in own.values()), dtype=np.int64, count=degree.sum()))
            starts.append(at)
            sizes.append(max(2, len(symbols)))
            at += len(nxt)
        if self.langs:
            self.edges = Transitions(np.concatenate(owner), np.concatenate(symbol), np.concatenate(target), at, self.width)
            self.starts = self.edges.place[starts]
            every = np.arange(self.width)
            self.known = np.array([self.edges.follow(np.full(self.width, at), every)[1] for at in self.starts])
        self.bits = np.log2(np.array(sizes, dtype=float))

    def read(self, texts: list[str], split: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, runs of non-letters as one; how many each text has; whether it has a letter."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = self.symbols[points]
        if split:
            symbols[points == ord(split)] = UNKNOWN
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        gap = symbols == GAP
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[np.concatenate([[0], ends])])
        return symbols[keep], count(keep), count(~gap) > 0

    def step(self, state: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after a symbol, and whether a phrase starts with it."""
        to, goes = self.edges.follow(state, symbol)
        first = ~goes
        again = np.flatnonzero(first)
        if again.size:
            own = start.ravel()[again]
            back, goes = self.edges.follow(own, np.broadcast_to(symbol, to.shape).ravel()[again])
            # A symbol that no phrase starts with is one by itself.
            to.ravel()[again] = np.where(goes, back, own)
        return to, first | (state == start)

    def phrases(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Phrases of each text by language, counted where they start.

        All pieces of all texts are parsed at once as if a phrase started with each. Then every piece is parsed again from
        the state in which the piece before it ends, until a phrase starts where one did the first time: from there on
        both are the same. A piece that ends in another state than was taken for it sends its next piece round once more.
        """
        pieces = -(-counts // PIECE)
        text = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.cumsum(counts) - counts, pieces) + nth * PIECE
        size = np.minimum(PIECE, np.repeat(counts, pieces) - nth * PIECE)
        order = np.argsort(-size, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        # Lanes are pieces, longest first, times languages; the next piece of a text by its lane, -1 for the last.
        after = np.where(np.append(nth[1:] > 0, False), np.append(place[1:], 0), -1)[order]
        begin, size, text = begin[order], size[order], text[order]
        k, n = len(self.langs), len(text)
        start = np.repeat(self.starts, n).reshape(k, n)
        state = start.copy()
        longest = int(size[0]) if n else 0
        marks = np.zeros((longest, k, n), dtype=bool)
        active = np.searchsorted(-size, -np.arange(longest), side="left")
        for j in range(longest):
            m = int(active[j])
            state[:, :m], marks[j, :, :m] = self.step(state[:, :m], start[:, :m], symbols[begin[:m] + j][None, :])
        total = marks.sum(axis=0, dtype=np.int64).ravel()
        ends, first_ends, starts = state.ravel().copy(), state.ravel(), start.ravel()
        upto = np.cumsum(marks, axis=0, dtype=np.int16).reshape(longest, k * n) if longest else np.zeros((0, k * n), np.int16)
        marks = marks.reshape(longest, k * n)
        lane = np.arange(k * n)
        follow = np.where(after[lane % max(n, 1)] >= 0, lane // max(n, 1) * n + after[lane % max(n, 1)], -1) if n else lane
        todo = np.flatnonzero((follow >= 0) & (ends != starts))
        while todo.size:
            # Each lane of ``todo`` ended in a new state: its next piece is parsed from there.
            lanes, now = follow[todo], ends[todo]
            changed, j = [], 0
            spent = np.zeros(len(lanes), dtype=np.int64)
            while lanes.size:
                over = size[lanes % n] <= j
                if over.any():  # never met: the piece ends as this parse does
                    gone = lanes[over]
                    total[gone] = spent[over]
                    changed.append(gone[ends[gone] != now[over]])
                    ends[gone] = now[over]
                    lanes, now, spent = lanes[~over], now[~over], spent[~over]
                    continue
                now, first = self.step(now, starts[lanes], symbols[begin[lanes % n] + j])
                met = first & marks[j, lanes]
                if met.any():
                    gone = lanes[met]
                    total[gone] = spent[met] + upto[size[gone % n] - 1, gone] - upto[j, gone] + 1
                    changed.append(gone[ends[gone] != first_ends[gone]])
                    ends[gone] = first_ends[gone]
                    keep = ~met
                    lanes, now, spent, first = lanes[keep], now[keep], spent[keep], first[keep]
                spent += first
                j += 1
            todo = np.concatenate(changed) if changed else np.zeros(0, np.int64)
            todo = todo[follow[todo] >= 0]
        out = np.zeros((len(counts), k))
        for i, own in enumerate(total.reshape(k, n)):
            out[:, i] = np.bincount(text, weights=own, minlength=len(counts))
        return out

    def strangers(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Symbols of each text that a language's training text doesn't hold, by language."""
        odd = np.flatnonzero(~self.known.all(axis=0)[symbols])
        text = np.searchsorted(np.cumsum(counts), odd, side="right")
        return np.stack([np.bincount(text[~known[symbols[odd]]], minlength=len(counts)) for known in self.known], axis=1)

    def predict(self, texts: list[str | None], max_bits: float = MAX_BITS) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and whether it is in a learned language (see MAX_BITS) at all.

        The score is the winner's share of the inverse entropies of all languages.
        """
        symbols, counts, letters = self.read([t or "" for t in texts])
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), letters
        # A strange symbol costs twice: a phrase that points nowhere, and the symbol itself.
        spent = self.phrases(symbols, counts) + self.strangers(symbols, counts)
        entropy = spent * self.bits[None, :] / np.maximum(counts, 1)[:, None]
        inverse = 1 / np.maximum(entropy, 1e-9)
        best = inverse.argmax(axis=1)
        score = np.where(letters, inverse.max(axis=1) / inverse.sum(axis=1), 0.0)
        row = np.arange(len(best))
        near = letters & ((spent[row, best] - SPARE) * self.bits[best] <= max_bits * counts)
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], score, near


_parsers: dict[tuple, CrossParser] = {}


def parser(texts: dict[str, str]) -> CrossParser:
    """One parser for each model and worker process."""
    key = tuple(sorted(texts.items()))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(texts)
    return _parsers[key]


def identify(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row; reads nothing but the text.

    Null texts and texts without a letter are ``und`` with score 0; ties go to the language that sorts first. Without any
    learned language all are ``und``. Very long texts are parsed whole, in pieces side by side; repeated rows and rows without an id each
    have their result; other columns, whatever their names, are not read; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(texts)
        for b in batches:
            for a, z, own in text_slices(b.column(1), len(texts)):
                langs, score, _ = p.predict(own)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])
            give_back()

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def text_slices(column: pa.Array, langs: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """Texts that are parsed together: fewer characters for more languages, so that a worker's memory stays the same."""
    texts, at, chars = column.to_pylist(), 0, SLICE // max(1, langs)
    while at < len(texts):
        begin, total = at, 0
        while at < len(texts) and (total < chars or at == begin):
            total += len(texts[at] or "")
            at += 1
        yield begin, at, texts[begin:at]


def keep_identified(docs: DataFrame, texts: dict[str, str], text_col: str = "text", lang_col: str = "lang", max_bits: float = MAX_BITS) -> DataFrame:
    """The rows whose text is in a learned language by its cross-parsing entropy (see MAX_BITS); the others are rejected.

    Rows without a label get the predicted one; all else stays as it is, columns of any other name among it. Null texts and
    texts without a letter go; without any learned language no other text can be rejected, nor labelled. Rows stay where
    they are, repeated ones among them: each task parses its own texts whole and drops its own rejects, without a shuffle. An
    empty table gives none.
    """

    at, lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(texts)
        for b in batches:
            keep: list[bool] = []
            found: list[str] = []
            for _, _, own in text_slices(b.column(at), len(texts)):
                langs, _, near = p.predict(own, max_bits)
                keep += near.tolist()
                found += langs
            if texts:
                named = pa.array([x or y for x, y in zip(b.column(lang).to_pylist(), found, strict=True)], b.schema.field(lang).type)
                b = b.set_column(lang, b.schema.field(lang), named)
            yield b.filter(pa.array(keep, pa.bool_()))
            give_back()

    return small_batches(docs).mapInArrow(run, docs.schema)
