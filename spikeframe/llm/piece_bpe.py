"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

Every prefix of a text has one last token: the encoding of a prefix is the start of an encoding, and two encodings side by
side are one if their neighbouring tokens stay apart when merged alone. So an automaton over all pieces gives, at each
position, the pieces that end there; the one that is compatible with the last token of the prefix before it is stored, and
the tokens are recovered backwards from the text's end. The time is linear in the text, however long it is.

Where no piece holds the two characters at a border, nothing merges across it: texts are cut before the space symbol, and
what stands between two cuts is encoded once for each worker's cache. Short words of a batch fill their tables side by side,
position by position; a long one has a table of its own.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, pieces

#: Fixed: the symbol that stands for a space.
SPACE = "▁"
#: A worker's caches hold so many words of up to WORD characters, and so many pairs of tokens.
CACHE, WORD, PAIRS = 800_000, 64, 1_000_000
SLOTS = 21
#: Text bytes encoded at once.
CHUNK = 2 << 20


class PieceModel:
    """Pieces, scores and special ids of a BPE model with byte fallback; picklable, of the file's size."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], control: list[int], unknown: int, end: int):
        self.ids = {p: i for p, (i, _) in scores.items()}
        order = {s: k for k, s in enumerate(sorted({-s for _, s in scores.values()}))}
        #: Lower ranks merge first; equal scores have equal ranks and merge from the left.
        self.rank = {p: order[-s] for p, (_, s) in scores.items()}
        self.byte_ids, self.control, self.unknown, self.end = byte_ids, frozenset(control), unknown, end

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Reads the vocabulary; a model that normalises texts, adds no leading space or has no byte fallback is refused."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("ﬁ  x\t") != f"{SPACE}ﬁ{SPACE * 2}x\t":
            raise ValueError("only models without normalisation and with a leading space are supported")
        size = range(sp.vocab_size())
        odd = {i for i in size if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not sp.is_byte(i) for i in byte_ids) or any(sp.is_unused(i) for i in size):
            raise ValueError("only models with byte fallback and without unused pieces are supported")
        return cls({sp.id_to_piece(i): (i, sp.get_score(i)) for i in size if i not in odd}, byte_ids, [i for i in size if sp.is_control(i)], sp.unk_id(), sp.eos_id())


class PieceEncoder:
    """Encodes and decodes texts; keeps words and pairs of tokens that it has met."""

    def __init__(self, model: PieceModel):
        self.model, self.pairs = model, {}
        #: Pairs once more, as arrays that many are looked up in at once; a slot holds the last pair that fell to it.
        self.slot_key, self.slot_hit = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)
        #: Ids of words: without the space symbol if one space leads, else with all their spaces.
        self.words: dict[str, bytes] = {}
        # characters that are parts of pieces but no pieces themselves can still be merged
        self.texts = ["", *model.ids, *sorted({c for p in model.ids for c in p} - model.ids.keys())]
        self.automaton = ahocorasick.Automaton()
        #: Tokens of single characters by code point (0: no piece holds the character); the automaton has the longer pieces.
        self.single = np.zeros(0x110000, np.int32)
        for k, p in enumerate(self.texts):
            if len(p) > 1:
                self.automaton.add_word(p, k)
            elif p:
                self.single[ord(p)] = k
        self.automaton.make_automaton()
        #: Tokens from here on are characters that no piece holds; token 0 stands for a text's start. Nothing merges with either.
        self.strange = len(self.texts)
        self.numbers: dict[int, int] = {}
        self.size = np.array([1, *map(len, self.texts[1:])], np.int64)
        self.out = [np.zeros(0, np.int32), *(np.array([model.ids[p]], np.int32) if p in model.ids else self.fallback(p) for p in self.texts[1:])]
        self.tables()
        whole = not any(a != SPACE and b == SPACE for p in model.ids for a, b in zip(p, p[1:]))
        self.split = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if whole else None
        surface = {i: p.replace(SPACE, " ").encode() for p, i in model.ids.items()}
        self.surface = surface | {i: bytes([b]) for b, i in enumerate(model.byte_ids)} | {i: b"" for i in model.control} | {model.unknown: " ⁇ ".encode()}
        self.led = frozenset(i for p, i in model.ids.items() if p.startswith(SPACE))

    def fallback(self, c: str) -> np.ndarray:
        return np.array([self.model.byte_ids[b] for b in c.encode()], np.int32)

    def tables(self) -> None:
        self.out_len = np.array(list(map(len, self.out)), np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out_ids = np.concatenate(self.out)

    def number(self, codes: np.ndarray) -> np.ndarray:
        """Tokens of characters that no piece holds."""
        kinds, which = np.unique(codes, return_inverse=True)
        new = [c for c in kinds.tolist() if c not in self.numbers]
        for c in new:
            self.numbers[c] = len(self.out)
            self.out.append(self.fallback(chr(c)))
        if new:
            self.size = np.concatenate([self.size, np.ones(len(new), np.int64)])
            self.tables()
        return np.array([self.numbers[c] for c in kinds.tolist()], np.int64)[which]

    def merge(self, text: str) -> list[str]:
        """Merges as the rule says, for two tokens' text."""
        sym, rank = list(text), self.model.rank
        ranks = [rank.get(a + b) for a, b in zip(sym, sym[1:])]
        while some := [r for r in ranks if r is not None]:
            i = ranks.index(min(some))
            sym[i : i + 2] = [sym[i] + sym[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(sym[i - 1] + sym[i])
            if i < len(ranks):
                ranks[i] = rank.get(sym[i] + sym[i + 1])
        return sym

    def compatible(self, key: int) -> bool:
        """Whether two tokens, left << 32 | right, stay apart and each whole when their text is merged alone."""
        hit = self.pairs.get(key)
        if hit is None:
            two = [self.texts[k] for k in (key >> 32, key & 0xFFFFFFFF) if k]
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            hit = self.pairs[key] = self.merge("".join(two)) == two
        return hit

    def all_compatible(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys.view(np.uint64) * np.uint64(BASE) >> np.uint64(64 - SLOTS)).astype(np.int64)
        miss = self.slot_key[slot] != keys
        hit = self.slot_hit[slot]
        if miss.any():
            new, which = np.unique(keys[miss], return_inverse=True)
            found = np.array([self.compatible(k) for k in new.tolist()])
            hit[miss] = found[which]
            self.slot_key[slot[miss]], self.slot_hit[slot[miss]] = keys[miss], hit[miss]
        return hit

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends and tokens of all pieces in the text; and the prefix table, which holds the strange characters only."""
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        single = self.single[codes].astype(np.int64)
        last = np.zeros(len(text) + 1, np.int64)
        known, odd = np.flatnonzero(single), np.flatnonzero(single == 0)
        if len(odd):
            last[odd + 1] = self.number(codes[odd])
        return np.concatenate([known, found[:, 0]]) + 1, np.concatenate([single[known], found[:, 1]]), last

    def encode_long(self, word: str) -> bytes:
        """Little-endian int32 ids of one word of any length."""
        ends, tokens, found = self.matches(word)
        by = np.argsort(ends, kind="stable")
        ends, tokens = ends[by], tokens[by]
        last, strange = found.tolist(), self.strange
        for at, token, before in zip(ends.tolist(), tokens.tolist(), (ends - self.size[tokens]).tolist()):
            if not last[at]:
                left = last[before]
                if self.compatible((left if left < strange else 0) << 32 | token):
                    last[at] = token
        ids, at, size = [], len(word), self.size.tolist()
        while at:
            ids.append(self.out[last[at]])
            at -= size[last[at]]
        return np.concatenate(ids[::-1]).astype("<i4").tobytes()

    def encode_short(self, words: list[str]) -> list[bytes]:
        """The same for words that stand side by side with no merge across their borders: the tables are filled by position in the words."""
        sizes = np.array(list(map(len, words)), np.int64)
        stop = np.cumsum(sizes)
        start = stop - sizes
        ends, tokens, last = self.matches("".join(words))
        step = (ends - start[np.searchsorted(stop, ends)]).astype(np.int16)
        by = np.argsort(step, kind="stable")
        ends, tokens, step = ends[by], tokens[by], step[by]
        for some in np.split(np.arange(len(by)), np.flatnonzero(np.diff(step)) + 1):
            end, token = ends[some], tokens[some]
            left = last[end - self.size[token]]
            left[(left >= self.strange) | (end - self.size[token] == start[np.searchsorted(stop, end)])] = 0
            ok = self.all_compatible(left << 32 | token)
            last[end[ok]] = token[ok]
        # backwards, one token of every word at a time
        live, at, taken, of = np.arange(len(words)), stop.copy(), [], []
        while len(live):
            token = last[at[live]]
            taken.append(token)
            of.append(live)
            at[live] -= self.size[token]
            live = live[at[live] > start[live]]
        of, taken = np.concatenate(of[::-1]), np.concatenate(taken[::-1])
        by = np.argsort(of, kind="stable")
        of, taken = of[by], taken[by]
        n = self.out_len[taken]
        total = np.cumsum(n)
        ids = self.out_ids[np.repeat(self.out_at[taken] - (total - n), n) + np.arange(total[-1])].astype("<i4").tobytes()
        cuts = [0, *(4 * np.cumsum(np.bincount(of, n, len(words)).astype(np.int64))).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def split_text(self, text: str) -> tuple[str, list[str]]:
        """Words, and what stands before each: where each follows one space, the space symbol is left out of them."""
        if self.split is not None and not (SPACE in text or "  " in text or text[:1] == " "):
            return SPACE, text.split(" ")
        text = SPACE + text.replace(" ", SPACE)
        return "", self.split.findall(text) if self.split else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each text, the end id last."""
        words, end = self.words, self.model.end.to_bytes(4, "little")
        if len(words) > CACHE:
            words.clear()
        parts = [self.split_text(t) if t else ("", []) for t in texts]
        new = {w: lead + w for lead, some in parts for w in some if w not in words}
        # what ends in spaces would merge with the spaces of a next word
        long = {w: self.encode_long(full) for w, full in new.items() if len(full) > WORD or full[-1] == SPACE}
        if short := [w for w in new if w not in long]:
            words.update(zip(short, self.encode_short([new[w] for w in short])))
        get = words.__getitem__ if not long else lambda w: long[w] if w in long else words[w]
        return [b"".join(map(get, some)) + end for _, some in parts]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: control ids are nothing, one leading space goes, each byte that is no UTF-8 is U+FFFD; other ids raise KeyError."""
        control = self.model.control
        if control.isdisjoint(ids):
            return self.decode_run(ids, True)
        if control.isdisjoint(ids[:-1]):
            return self.decode_run(ids[:-1], True)
        out, run, first = [], [], True
        for i in [*ids, self.model.end]:  # bytes on the two sides of a control id are no character
            if i not in control:
                run.append(i)
            elif run:
                out.append(self.decode_run(run, first))
                run, first = [], False
        return "".join(out)

    def decode_run(self, ids: list[int], first: bool) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        if first and ids and ids[0] in self.led:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "one_by_one")


def _one_by_one(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("one_by_one", _one_by_one)


_encoders: dict[int, PieceEncoder] = {}


def _round_trip(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if id(model) not in _encoders:
            _encoders.clear()  # a worker that is used again keeps one model
            _encoders[id(model)] = PieceEncoder(model)
        enc = _encoders[id(model)]
        for piece in pieces(batches, "_text", CHUNK):
            raw = enc.encode(piece.column("_text").to_pylist())
            ids = np.frombuffer(b"".join(raw), "<i4")
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)])
            flat = ids.tolist()
            decoded = [enc.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(np.diff(ends)), lists, pa.array(decoded, pa.string())], ["_id", "n_tokens", "ids", "decoded"])

    return run


def encode_decode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text with the end id, and the text that they decode to.

    Returns `id_col`, n_tokens, ids (array of int) and decoded, one row for each input row; an empty table gives none.
    `model` is the path of a SentencePiece BPE file, whose vocabulary is read on the driver and broadcast: its size does not
    depend on the data. A null or empty text has the end id alone and decodes to the empty text; ids may be null or
    repeated; repeated rows are encoded alike; other columns are left aside. A text is encoded whole, in memory of its size.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(PieceModel.load(model))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_round_trip(shared), f"_id {kind}, n_tokens long, ids array<int>, decoded string").withColumnRenamed("_id", id_col)
