"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

A merge list has a sufficient lookahead: a number L such that what stands more than L symbols to the right of a
token's end cannot change that token. `Bpe.lookahead` computes it from the list. Two inputs that share a prefix
differ, after each merge rule in order of rank, only right of a frontier. A rule (u, v) can move the frontier left,
by |u|, only if v begins with the token that the rule before it left standing at the frontier, so L is the
heaviest chain of such rules. The encoder holds a window of symbols, merges it, emits the tokens that end more than L
symbols before the window's end and keeps the rest; memory does not grow with the length of a word.

Words repeat, so the ids of short white-space-free pieces are remembered in a table of bounded size per worker.

Defined results: null and empty texts have no ids and decode to the empty text; special-token strings in a text
become their ids, as the tokenizers library does by default; characters that the vocabulary lacks are dropped. The
operators add one column (any name, replacing one of that name) and leave all other columns and rows as they are.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: Unicode White_Space, which the normalizer folds to one blank.
SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Letters that are composed and that lower one by one, then marks that form one word.
PLAIN = regex.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*$%&#]*)")
#: Pieces up to this length are remembered, at most so many per worker.
PIECE, KEPT = 48, 500_000
#: A rule is its rank above 32 bits of the merged token's id.
NEVER, IDS = 1 << 62, (1 << 32) - 1


PACK = struct.Struct("<I").pack


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as itself, the others from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, library = spec["model"], Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.letters = byte_letters()
        self.normalize = library.normalizer.normalize_str if library.normalizer else str
        self.words = library.pre_tokenizer.pre_tokenize_str  # words in byte letters
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.merges = {}
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault((self.vocab[a], self.vocab[b]), rank << 32 | self.vocab[a + b])
        self.size = {i: len(s.removesuffix(self.end) if self.end else s) for s, i in self.vocab.items()}
        self.lookahead = self._lookahead(pairs)
        self.known: dict[str, bytes] = {}
        self.letter = dict(enumerate(self.letters))

    def _symbols(self, token: str) -> int:
        return self.size[self.vocab[token]]

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        heaviest: dict[str, int] = {}
        most = 0
        for u, v in pairs:
            before = max((heaviest.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
            weight = self._symbols(u) + before
            heaviest[u] = max(heaviest.get(u, 0), weight)
            most = max(most, weight)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the rules to a bounded window: the lowest rank first, leftmost first."""
        rule, ids = self.merges.get, list(ids)
        found = [rule(p, NEVER) for p in zip(ids, ids[1:])]
        while found and (best := min(found)) != NEVER:
            k = found.index(best)
            ids[k] = best & IDS
            del ids[k + 1], found[k]
            if k:
                found[k - 1] = rule((ids[k - 1], ids[k]), NEVER)
            if k < len(found):
                found[k] = rule((ids[k], ids[k + 1]), NEVER)
        return ids

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Token ids of one word, each as soon as it is stable."""
        limit, window = 4 * self.lookahead + 64, []
        for s in symbols:
            window.append(s)
            if len(window) == limit:
                at, keep = 0, limit - self.lookahead
                for t in self.merge(window):
                    if at + self.size[t] >= keep:
                        break
                    yield t
                    at += self.size[t]
                window = window[at:]
        yield from self.merge(window)

    def word(self, word: str) -> bytes:
        """Packed ids of one word in byte letters."""
        if not word:
            return b""
        symbols = [*word[:-1], word[-1] + self.end]
        ids = [i for i in map(self.vocab.get, symbols) if i is not None]
        ids = self.merge(ids) if len(ids) <= self.lookahead else list(self.stream(ids))
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, piece: str) -> bytes:
        """Packed ids of a text without white space."""
        if plain := PLAIN.fullmatch(piece):  # the pre-tokenizer and normalizer only lower it and part the marks
            word, marks = plain[1].lower(), plain[2]
            packed = self.known.get(word)
            if packed is None:
                packed = self.word(word if word.isascii() else word.encode().decode("latin-1").translate(self.letter))
                self.keep(self.known, word, packed)
            return packed + (self.known.get(marks) or self.piece_of(marks)) if marks else packed
        return self.piece_of(piece)

    def piece_of(self, piece: str) -> bytes:
        packed = b"".join([self.word(w) for w, _ in self.words(self.normalize(piece))])
        self.keep(self.known, piece, packed)
        return packed

    @staticmethod
    def keep(known: dict[str, bytes], key: str, packed: bytes) -> None:
        if len(key) <= PIECE:
            if len(known) >= KEPT:
                known.clear()
            known[key] = packed

    def plain(self, text: str) -> bytes:
        pieces = SPACE.split(text) if ODD_SPACE.search(text) else text.split()
        known = self.known.get
        return b"".join([known(p) or self.piece(p) for p in pieces if p])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or "<" not in text:
            return self.plain(text)
        return b"".join(PACK(self.special[p]) if p in self.special else self.plain(p) for p in self.cut.split(text))


class Decoder:
    """Incremental: feed() gives the text that is sure so far, close() the rest.

    "tokens" joins the vocabulary's strings with blanks, as the tokenizers library does for a file without a
    decoder; "text" turns byte letters back to bytes and a word's end to a blank. The state is whether a token
    came before and up to three bytes of an unfinished character.
    """

    def __init__(self, bpe: Bpe, form: str = "tokens"):
        self.table, self.first = token_bytes(bpe, form), form == "tokens"
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        data = b"".join([self.table[i] for i in ids])
        if self.first and data:
            data, self.first = data[1:], False
        return self.state.decode(data)

    def close(self) -> str:
        return self.state.decode(b"", final=True)


@functools.cache
def _tables(bpe: Bpe) -> dict:
    return {}


def token_bytes(bpe: Bpe, form: str) -> dict[int, bytes]:
    made = _tables(bpe)
    if form not in made:
        back = {c: bytes([b]) for b, c in enumerate(bpe.letters)}

        def text(s: str) -> bytes:
            if s in bpe.special:
                return s.encode()
            body = s.removesuffix(bpe.end) if bpe.end else s
            return b"".join(back[c] for c in body) + b" " * (len(body) < len(s))

        made[form] = {i: b" " + s.encode() if form == "tokens" else text(s) for i, s in bpe.strings.items()}
    return made[form]


@functools.cache
def load(path: str) -> Bpe:
    """One per worker."""
    return Bpe(path)


def encode(text: Column, path: str) -> Column:
    """Token ids of each text as binary, little-endian unsigned 32-bit."""

    @arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([bpe.encode(x.as_py() or "") for x in texts], pa.binary())

    return of(text)


def decode(ids: Column, path: str, form: str = "tokens", block: int = 1 << 16) -> Column:
    """Text of each packed id sequence; see Decoder for `form`."""

    @arrow_udf("string")
    def of(packed: pa.Array) -> pa.Array:
        bpe, out = load(path), []
        for x in packed:
            data, machine = x.as_py() or b"", Decoder(bpe, form)
            parts = [machine.feed(memoryview(data)[a : a + 4 * block].cast("I")) for a in range(0, len(data), 4 * block)]
            out.append("".join(parts) + machine.close())
        return pa.array(out, pa.string())

    return of(ids)


def digests(text: Column, path: str, form: str = "tokens", block: int = 1 << 16) -> Column:
    """Struct of the number of ids, the SHA-256 of the packed ids and that of the decoded text, as `encode` and `decode` give them.

    Each text is encoded once and decoded block by block; neither ids nor decoded texts of a batch are held or sent back.
    """

    @arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def of(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        counts, ids, decoded = zip(*(digest(bpe, x.as_py() or "", form, block) for x in texts), strict=True) if len(texts) else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return of(text)


def digest(bpe: Bpe, text: str, form: str, block: int) -> tuple[int, str, str]:
    data, machine, back = bpe.encode(text), Decoder(bpe, form), hashlib.sha256()
    for a in range(0, len(data), 4 * block):
        back.update(machine.feed(memoryview(data)[a : a + 4 * block].cast("I")).encode())
    back.update(machine.close().encode())
    return len(data) // 4, hashlib.sha256(data).hexdigest(), back.hexdigest()
