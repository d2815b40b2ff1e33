"""SentencePiece encoding and decoding by a batched numpy Viterbi over words of equal length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import freeing, give_back, small_batches

#: The public model file; a parameter of everything below.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bases of the two rolling hashes of code points.
BASE, CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
UNIGRAM, BPE = 1, 2
#: Words that one worker remembers, some 50 bytes each, and characters that advance together.
WORDS, TOGETHER = 1_000_000, 1 << 15
#: Bits of the slot of a remembered pair of pieces, and of the filter before the search among piece keys.
PAIR_BITS, FILTER_BITS = 21, 20
#: Characters of text that are encoded together.
SLICE = 1 << 20


class Codec:
    """Encodes as the model's own library does, and decodes.

    A Viterbi pass reads all words of one length at once. At each position the hashes of the substrings that end there are
    looked up in the sorted hashes of the pieces, and the maximum over their lengths becomes the back pointer. In a unigram
    model a path's score is its sum of piece scores. In a BPE model the last piece of a prefix is the one piece that stands
    next to the last piece of what is before it when BPE encodes just these two; so a step scores 0 if its two pieces are
    such neighbours and minus infinity if not, and the only finite path is the BPE encoding. Neighbours are remembered.

    A word is a run of characters that pieces may join: it ends before a space, and between two characters that stand
    side by side in no piece, which no path can cross. Words are told apart by two 64-bit hashes and remembered.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with identity normalisation and a dummy prefix are read")
        kinds = [p.type for p in proto.pieces]
        if 4 in kinds or any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type == 1):
            raise ValueError("user-defined pieces and pieces with inner spaces aren't read")
        self.kind, self.unk = spec.model_type, kinds.index(2)
        self.pieces = [p.piece for p in proto.pieces]
        #: Stand-ins in pairs of pieces: the start of a word, a character without a piece.
        self.start, self.lone, self.span = len(self.pieces), len(self.pieces) + 1, len(self.pieces) + 2
        self.scores = np.array([p.score for p in proto.pieces])
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.byte_ids = np.array([i for i, k in enumerate(kinds) if k == 6], dtype=np.int32) if spec.byte_fallback else None
        self.rank = {p: float(self.scores[i]) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        known = sorted((self.hash(p, BASE), i) for p, i in self.ids.items())
        self.keys = np.array([h for h, _ in known], dtype=np.uint64)
        self.key_ids = np.array([i for _, i in known], dtype=np.int64)
        self.checks = np.array([self.hash(self.pieces[i], CHECK) for _, i in known], dtype=np.uint64)
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.unk_score = float(self.scores[list(self.ids.values())].min()) - 10.0
        text = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.piece_bytes = np.frombuffer(b"".join(text), dtype=np.uint8)
        self.piece_sizes = np.array([len(x) for x in text], dtype=np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.pair_keys, self.pair_ok = np.full(1 << PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << PAIR_BITS, dtype=bool)
        self.present = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.present[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.powers, self.powers2 = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, b, np.uint64)])) for b in (BASE, CHECK))
        #: Number of each character that pieces hold (0: none does), and which may stand side by side in a word.
        alphabet = sorted({c for p in self.ids for c in p})
        self.letter = np.zeros(0x110000, dtype=np.int32)
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.joins = np.zeros((len(alphabet) + 1, len(alphabet) + 1), dtype=bool)
        for p in self.ids:
            own = self.letter[[ord(c) for c in p]]
            self.joins[own[:-1], own[1:]] = True
        # Without bytes a run of unknown characters is one id, so it stays together.
        self.joins[0, 0] = self.byte_ids is None
        self.trees: dict[str, tuple[str, str, bool]] = {}
        self.forget()

    @staticmethod
    def hash(text: str, base: np.uint64) -> int:
        h = 0
        for c in text:
            h = (h * int(base) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def forget(self) -> None:
        """No word is remembered: sorted hashes of the words, their second hashes, and the number under which each is kept."""
        self.known, self.known2, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def best(self, parts: list[str]) -> int:
        """Which neighbours BPE joins next: those of the best piece, the leftmost of equals; -1 if none make a piece."""
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = self.rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r > best):
                best, at = r, i
        return at

    def merged(self, text: str) -> list[str]:
        """BPE by its definition, for short strings."""
        parts = list(text)
        while len(parts) > 1 and (at := self.best(parts)) >= 0:
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def tree(self, piece: str) -> tuple[str, str, bool]:
        """The two parts that BPE joins last into a piece, and whether it joins in order of rank all the way; cached."""
        found = self.trees.get(piece)
        if found is None:
            if len(piece) == 1:
                found = ("", "", True)
            else:
                parts, last = list(piece), ("", "")
                while len(parts) > 1 and (at := self.best(parts)) >= 0:
                    last = (parts[at], parts[at + 1])
                    parts[at : at + 2] = ["".join(last)]
                plain = len(parts) == 1 and all(len(x) == 1 or self.tree(x)[2] and self.rank[x] > self.rank[piece] for x in last)
                found = (*last, plain) if len(parts) == 1 else ("", "", False)
            self.trees[piece] = found
        return found

    def neighbours(self, key: int) -> bool:
        """Whether BPE leaves the two pieces as they are when they stand alone, side by side.

        It does unless, at some time, the parts at their border make a piece that ranks above what either part joins next.
        The pieces' trees tell which parts stand there at one time; pieces that don't join in order of rank are simulated.
        """
        a, b = divmod(key, self.span)
        right = self.pieces[b]
        if a >= self.start:
            return self.merged(right) == [right]
        left = self.pieces[a]
        if left + right in self.rank:
            return False
        if not (self.tree(left)[2] and self.tree(right)[2]):
            return self.merged(left + right) == [left, right]
        rank, end_left, end_right = self.rank, -np.inf, -np.inf
        formed = lambda x: rank[x] if len(x) > 1 else np.inf
        while len(left) > 1 or len(right) > 1:
            if formed(left) < formed(right):
                end_left, left = rank[left], self.tree(left)[1]
            else:
                end_right, right = rank[right], self.tree(right)[0]
            p = rank.get(left + right)
            if p is not None and p > end_left and p >= end_right:
                return False
        return True

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.span + right
        slot = (keys.astype(np.uint64) * BASE >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_keys[slot] != keys)
        if new.size:
            # A slot holds the last pair that came to it; the others are worked out again.
            once, where = np.unique(keys[new], return_inverse=True)
            ok[new] = np.fromiter(map(self.neighbours, once.tolist()), dtype=bool, count=len(once))[where]
            self.pair_keys[slot[new]] = keys[new]
            self.pair_ok[slot[new]] = ok[new]
            wrong = new[self.pair_keys[slot[new]] != keys[new]]
            if wrong.size:  # two new pairs of one slot: no value stays that may be another pair's
                self.pair_keys[slot[wrong]] = -1
        return ok

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of words of one length, given as rows of code points, one after the other; and how many each has.

        -1 marks a character without a piece. At a position all lengths of the last piece are looked up at once, so that
        a long word alone costs few calls a character.
        """
        m, n = words.shape
        one = np.ascontiguousarray(words.T).astype(np.uint64) + np.uint64(1)
        pre, chk = np.zeros((n + 1, m), np.uint64), np.zeros((n + 1, m), np.uint64)
        for j in range(n):
            pre[j + 1], chk[j + 1] = pre[j] * BASE + one[j], chk[j] * CHECK + one[j]
        score = np.full((n + 1, m), -np.inf, np.float32 if self.kind == BPE else np.float64)
        score[0] = 0
        last, size = np.full((n + 1, m), self.start, np.int32), np.zeros((n + 1, m), np.int32)
        powers, shift, unknown = self.powers[1:, None], np.uint64(64 - FILTER_BITS), self.unk_score if self.kind == UNIGRAM else 0.0
        for j in range(1, n + 1):
            low = max(0, j - self.longest)
            # Row w is of the substrings of w + 1 characters that end here.
            h = pre[j] - pre[low:j][::-1] * powers[: j - low]
            width, word = np.nonzero(self.present[(h >> shift).astype(np.int64)])
            own = h[width, word]
            at = np.searchsorted(self.keys, own)
            at[at == len(self.keys)] = 0
            real = self.keys[at] == own
            width, word, at = width[real] + 1, word[real], at[real]
            real = self.checks[at] == chk[j, word] - chk[j - width, word] * self.powers2[width]
            width, word, piece = width[real], word[real], self.key_ids[at[real]]
            single = word[width == 1]
            if single.size < m:
                lone = np.ones(m, bool)
                lone[single] = False
                score[j, lone], last[j, lone], size[j, lone] = score[j - 1, lone] + unknown, self.lone, 1
            if self.kind == UNIGRAM:
                step = score[j - width, word] + self.scores[piece]
                # The best of a word's steps is written last.
                order = np.argsort(step, kind="stable")
                order = order[step[order] > score[j, word[order]]]
            else:
                step = score[j - width, word]
                order = np.flatnonzero(step == 0)
                order = order[self.may_follow(last[j - width[order], word[order]].astype(np.int64), piece[order])]
            won = word[order]
            score[j, won], last[j, won], size[j, won] = step[order], piece[order], width[order]
        at, live = np.full(m, n), np.arange(m)
        rows, ids = [], []
        while live.size:
            here = at[live]
            rows.append(live)
            ids.append(last[here, live])
            at[live] = here - size[here, live]
            if (at[live] == here).any():
                raise ValueError("a word has no path")
            live = live[at[live] > 0]
        row, flat = np.concatenate(rows[::-1]), np.concatenate(ids[::-1])
        flat[flat == self.lone] = -1
        return flat[np.argsort(row, kind="stable")].astype(np.int32), np.bincount(row, minlength=m)

    def spell(self, word: str, pieces: list[int]) -> list[int]:
        """Ids with bytes (or the unknown id, one for a run) in place of characters without a piece."""
        out, at = [], 0
        for i in pieces:
            if i >= 0:
                out.append(i)
                at += len(self.pieces[i])
                continue
            if self.byte_ids is not None:
                out += self.byte_ids[list(word[at].encode("utf-8"))].tolist()
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
            at += 1
        return out

    def learn(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Encode the words points[s : s + n], those of equal length together; the number under which each is kept."""
        order = np.argsort(sizes, kind="stable")
        lengths, firsts = np.unique(sizes[order], return_index=True)
        flats, counts = [self.flat], [self.sizes]
        for n, a, z in zip(lengths.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(order)], strict=True):
            many = max(1, TOGETHER // n)
            for at in range(a, z, many):
                words = points[starts[order[at : min(z, at + many)], None] + np.arange(n)]
                flat, held = self.viterbi(words)
                ends = np.cumsum(held)
                odd = np.flatnonzero(np.add.reduceat(flat < 0, ends - held))
                if odd.size:
                    pieces, lone = [], 0
                    for w in odd.tolist():
                        begin = int(ends[w] - held[w])
                        spelt = np.array(self.spell("".join(map(chr, words[w].tolist())), flat[begin : ends[w]].tolist()), dtype=np.int32)
                        pieces += [flat[lone:begin], spelt]
                        lone = int(ends[w])
                    held[odd] = [len(x) for x in pieces[1::2]]
                    flat = np.concatenate([*pieces, flat[lone:]])
                flats.append(flat)
                counts.append(held)
        numbers = np.empty(len(order), dtype=np.int64)
        numbers[order] = len(self.starts) + np.arange(len(order))
        self.flat, self.sizes = np.concatenate(flats), np.concatenate(counts)
        self.starts = np.cumsum(self.sizes) - self.sizes
        return numbers

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, spaces replaced and one in front of each text; where words start; words of each text."""
        points = np.frombuffer("".join(SPACE + t.replace(" ", SPACE) for t in texts if t).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter((len(t) + 1 if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(lengths)
        letter, space = self.letter[points], points == ord(SPACE)
        cut = np.ones(len(points), dtype=bool)
        cut[1:] = ~self.joins[letter[:-1], letter[1:]] & ~(space[:-1] & space[1:]) | space[1:] & ~space[:-1]
        cut[(ends - lengths)[lengths > 0]] = True
        before = np.concatenate([[0], np.cumsum(cut)])
        return points, np.flatnonzero(cut), before[ends] - before[ends - lengths]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if len(self.sizes) > WORDS:
            self.forget()
        points, starts, counts = self.words(texts)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        ends = np.append(starts[1:], len(points))
        hashes, checks = (word_hashes(points, starts, ends, base) for base in (BASE, CHECK))
        once, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if (checks[first][which] != checks).any():  # two words of one hash: as good as never, and then told apart by both
            _, first, which = np.unique(np.rec.fromarrays([hashes, checks]), return_index=True, return_inverse=True)
            once = hashes[first]
        twice = checks[first]
        at = np.minimum(np.searchsorted(self.known, once), max(0, len(self.known) - 1))
        held = (self.known[at] == once) & (self.known2[at] == twice) if len(self.known) else np.zeros(len(once), bool)
        word = np.zeros(len(once), dtype=np.int64)
        word[held] = self.number[at[held]]
        new = np.flatnonzero(~held)
        if new.size:
            word[new] = self.learn(points, starts[first[new]], (ends - starts)[first[new]])
            if len(self.known):
                new = new[self.known[at[new]] != once[new]]
            new = new[np.unique(once[new], return_index=True)[1]]
            place = np.searchsorted(self.known, once[new])
            self.known, self.known2, self.number = (np.insert(old, place, add) for old, add in ((self.known, once[new]), (self.known2, twice[new]), (self.number, word[new])))
        word = word[which]
        sizes = self.sizes[word]
        ids = gather(self.flat, self.starts[word], sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return ids, upto[bounds[1:]] - upto[bounds[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; bytes that ids spell wrongly stay as they are."""
        ids = ids.astype(np.int64)
        if ids.size and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("an id isn't in the model")
        flat = gather(self.piece_bytes, self.piece_starts[ids], self.piece_sizes[ids]).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.piece_sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        return [flat[a + (flat[a : a + 1] == b" ") : z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """The rolling hash of points[s : e] for each start and end, from one running sum over all points."""
    n = len(points)
    power, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (base, np.uint64(pow(int(base), -1, 1 << 64))))
    total = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * back[:n])])
    return (total[ends] - total[starts]) * power[ends - 1]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for each start and size, one after the other."""
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return flat[shift + np.arange(len(shift))]


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec for each model and worker process."""
    if hash(model) not in _codecs:
        _codecs.clear()
        _codecs[hash(model)] = Codec(model)
    return _codecs[hash(model)]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def slices(texts: list[str], chars: int = SLICE) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        begin, total = at, 0
        while at < len(texts) and (total < chars or at == begin):
            total += len(texts[at])
            at += 1
        yield begin, at


def encode_texts(docs: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of every row.

    round_trip: whether decoding gives the text back; only texts that hold U+2581 itself, which decodes to a space, don't.
    Null and empty texts have no ids and come back empty; repeated rows each have their own; ids may be null; an empty table
    gives none; other columns, whatever their names, are not read. No shuffle; a task holds one slice of its texts at a
    time. A very long text is a slice by itself, and a very long word takes a few dozen microseconds a character.
    """
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for a, z in slices(texts):
                ids, counts = c.encode(texts[a:z])
                same = [x == t.encode() for x, t in zip(c.decode(ids, counts), texts[a:z], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), lists, pa.array(counts.astype(np.int32)), pa.array(same)], names=["doc_id", "ids", "n_tokens", "round_trip"])
                del ids, counts, same, lists
            del texts
            give_back()

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def decode_ids(rows: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row; null ids, and none at all, give an empty text, wrong UTF-8 becomes U+FFFD.

    Repeated rows each have their text; doc_ids may be null; a very long row is decoded whole; an empty table gives none; other
    columns, whatever their names, are not read.
    """
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in freeing(batches):
            lists = [x or [] for x in b.column(1).to_pylist()]
            counts = np.array([len(x) for x in lists], dtype=np.int64)
            texts = c.decode(np.array([i for x in lists for i in x], dtype=np.int64), counts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return small_batches(rows).select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
