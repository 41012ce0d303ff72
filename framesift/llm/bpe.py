"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming inverse.

Every prefix of a piece has one BPE encoding, and a sequence of tokens is an encoding exactly if each token encodes
itself and each adjacent pair encodes to itself. That makes BPE a rational function: a nondeterministic transducer
reads bytes down the vocabulary's trie, may end a token wherever the pair (previous token, token) is compatible, and
goes on at the root. Determinising by subsets with delays, as for any string transducer, gives states that are sets of
(previous token, trie node, tokens not yet written); what all members agree on is written at once, so output lags
input by a bounded lookahead. States and transitions are made when a text first needs them and dropped together when
there are too many.

Null text is encoded like an empty one; neither has tokens. Texts of any length go through piece by piece.
"""

from __future__ import annotations

import base64
import gc
import sys
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.held import held



class Limits(NamedTuple):
    """States of an automaton, words and pieces that are remembered (and as many of the time before).

    What is forgotten is worked out again: less memory takes more time and changes nothing else. The large ones take
    about 360 MB of a worker, the small ones 140.
    """

    states: int = 200_000
    words: int = 300_000
    pieces: int = 100_000


LARGE, SMALL = Limits(), Limits(50_000, 50_000, 25_000)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merges:
    """The vocabulary: its trie, and which tokens may follow which."""

    def __init__(self, ranks: dict[bytes, int], pair_rank=None, limit: int = LARGE.states):
        self.limit = limit
        self.ranks, self.pair_rank = ranks, pair_rank or (lambda a, b: ranks.get(a + b))
        self.token = {v: k for k, v in ranks.items()}
        self.edges: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for text, rank in ranks.items():
            node = 0
            for byte in text:
                if byte not in self.edges[node]:
                    self.edges[node][byte] = len(self.edges)
                    self.edges.append({})
                    self.ends.append(-1)
                node = self.edges[node][byte]
            self.ends[node] = rank
        self.known: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[bytes, float]] | None] = {}

    def merge(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """Plain BPE: join the adjacent pair of lowest rank, the leftmost first, until none can be joined or ``stop`` are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            ranked = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.pair_rank(a, b)) is not None]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def born(self, part: bytes) -> float | None:
        """The rank of the merge that makes this part, -1 for a byte, None if none does."""
        if len(part) < 2:
            return -1
        halves = self.merge(part, 2)
        return self.pair_rank(*halves) if len(halves) == 2 else None

    def spine(self, token: int, right: bool) -> list[tuple[bytes, float]] | None:
        """The parts at one edge of a token while it is built, each with the rank of the merge that takes it up.

        None if the token doesn't encode itself, or a merge in it is older than the parts it joins.
        """
        found, part, taken = [], self.token[token], float("inf")
        while True:
            found.append((part, taken))
            if len(part) == 1:
                return found
            taken = self.born(part)
            if taken is None:
                return None
            halves = self.merge(part, 2)
            if any((b := self.born(x)) is None or b >= taken for x in halves):
                return None
            part = halves[right]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether ``before`` then ``token`` is an encoding; before is -1 at the start of a piece.

        It is unless a merge over the boundary comes first: one of a part at the right edge of ``before`` with one at
        the left edge of ``token``, of lower rank than the merges that take these up (of two equal the left comes first).
        """
        key = (before, token)
        known = self.known.get(key)
        if known is not None:
            return known
        if len(self.known) > 4 * self.limit:
            self.known.clear()
        for which, right in ((before, True), (token, False)):
            if which >= 0 and (which, right) not in self.spines:
                self.spines[which, right] = self.spine(which, right)
        left, after = self.spines.get((before, True)), self.spines[token, False]
        if after is None or before >= 0 and left is None:
            want = [self.token[x] for x in key if x >= 0]
            found = self.merge(b"".join(want)) == want
        else:
            rank = self.pair_rank
            found = before < 0 or not any((r := rank(a, b)) is not None and r < x and r <= y for a, x in left for b, y in after)
        self.known[key] = found
        return found


class State(dict):
    """A determinised state: its members, and by byte the state reached and the output, worked out when first needed."""

    __slots__ = ("machine", "members")

    def __init__(self, machine: Transducer, members: tuple):
        self.machine, self.members = machine, members

    def __missing__(self, byte: int) -> tuple:
        found = self[byte] = self.machine.move(self.members, byte)
        return found


class Transducer:
    """Encodes pieces. A state has members (previous token, trie node, output not yet written).

    ``whole`` gives pieces that are tokens these at once, as tiktoken does.
    """

    nothing: tuple | int = ()

    def __init__(self, merges: Merges, whole: bool = True):
        self.merges, self.whole, self.states = merges, whole, {}
        self.clear()

    def clear(self) -> None:
        for state in self.states.values():
            state.clear()  # states know each other: untied, they are freed at once
        start = ((-1, 0, self.nothing),)
        self.start = State(self, start)
        self.states = {start: self.start}

    def add(self, late, token: int):
        return (*late, token)

    def agree(self, outputs: list) -> int:
        """How much all outputs start with."""
        first = outputs[0]
        shared = len(first)
        for other in outputs:
            while shared and other[:shared] != first[:shared]:
                shared -= 1
        return shared

    def without(self, late, shared):
        return late[shared:]

    def move(self, members: tuple, byte: int) -> tuple:
        """Determinise one transition: the state reached, and the output that is now certain.

        Members are in order of where their open token began, and the one between tokens, which every prefix has, is
        the last; so equal sets are equal tuples.
        """
        merges, grown, between = self.merges, [], None
        edges, ends, known = merges.edges, merges.ends, merges.known
        for before, node, late in members:
            node = edges[node].get(byte)
            if node is None:
                continue
            if edges[node]:
                grown.append((before, node, late))
            token = ends[node]
            if token >= 0:
                fits = known.get((before, token))
                if fits or fits is None and merges.may_follow(before, token):
                    between = (token, 0, self.add(late, token))
        grown.append(between)
        shared = self.agree([late for _, _, late in grown])
        sure = self.nothing
        if shared:
            sure = between[2][:shared] if self.nothing == () else shared
            grown = [(before, node, self.without(late, shared)) for before, node, late in grown]
        key = tuple(grown)
        reached = self.states.get(key)
        if reached is None:
            reached = self.states[key] = State(self, key)
        return reached, sure

    def encode(self, piece: bytes):
        """All output for a piece; at its end that of the one member that is between tokens."""
        if self.whole and (token := self.merges.ranks.get(piece)) is not None:
            return self.add(self.nothing, token)
        if len(self.states) > self.merges.limit:
            self.clear()
        state, out = self.start, self.nothing
        for byte in piece:
            state, sure = state[byte]
            if sure:
                out += sure
        return out + state.members[-1][2]


class CountTransducer(Transducer):
    """The same machine with token counts on its transitions in place of the tokens."""

    nothing = 0

    def add(self, late: int, token: int) -> int:
        return late + 1

    def agree(self, outputs: list[int]) -> int:
        return min(outputs)

    def without(self, late: int, shared: int) -> int:
        return late - shared


class Recent(dict):
    """Results by text, worked out when first needed. When there are too many, those not used since the last time go."""

    def __init__(self, convert, limit: int = LARGE.pieces):
        super().__init__()
        self.convert, self.limit, self.older = convert, limit, {}

    def __missing__(self, text: str):
        found = self.older.get(text)
        if found is None:
            found = self.convert(text)
        if len(text) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class TextEncoder:
    """Joins ``convert`` over the words of whole texts: bytes for ids, numbers for counts.

    Texts are cut at spaces, and a word keeps the space before it: between a character that is not white space and a
    space the pattern always ends a piece, so pieces of such words are those of the whole text. That fails only for
    words that are all white space, and texts with these are split as a whole. A word of letters is one piece, and so
    is what a comma or full stop after one leaves; other words go to ``convert``, which splits by the pattern.
    """

    def __init__(self, convert, piece, limits: Limits = LARGE):
        self.convert, self.piece = convert, piece
        self.first, self.rest = Recent(convert, limits.pieces), Recent(self.word, limits.words)
        self.ends = {c: piece(c) for c in ",."}

    def word(self, word: str):
        if word.isalpha():
            return self.piece(" " + word)
        end = self.ends.get(word[-1])
        if end is not None and word[:-1].isalpha():
            return self.rest[word[:-1]] + end
        return self.convert(" " + word)

    def cut(self, text: str):
        """What the first word becomes, and an iterator over the others; the whole text's for one that can't be cut."""
        words = text.split(" ")
        if not all(words) or any(map(str.isspace, words)):
            return self.convert(text), ()
        first = self.first[words[0]]
        del words[0]
        return first, map(self.rest.__getitem__, words)


class BpeEncoder:
    """Whole texts to ids, each match of ``pattern`` separately, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limits: Limits = LARGE):
        self.split = regex.compile(pattern).findall
        self.transducer = Transducer(Merges(ranks, limit=limits.states))
        self.pieces = Recent(self.piece, limits.pieces)
        self.words = TextEncoder(self.convert, self.piece, limits)

    def piece(self, text: str) -> bytes:
        return array("I", self.transducer.encode(text.encode("utf-8", "surrogatepass"))).tobytes()

    def convert(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        first, rest = self.words.cut(text or "")
        ids = first + b"".join(rest)
        return ids if sys.byteorder == "little" else np.frombuffer(ids, ">u4").astype("<u4").tobytes()


#: By lead byte, how many bytes a UTF-8 sequence has; 0 for bytes that cannot lead one.
UTF8_LENGTH = [1] * 0x80 + [0] * 0x42 + [2] * 0x1E + [3] * 0x10 + [4] * 0x05 + [0] * 0x0B


class Utf8Stream:
    """An incremental UTF-8 state machine: text comes out as soon as its bytes are complete.

    The state is the start of an unfinished sequence, three bytes at most. Malformed bytes give U+FFFD as
    bytes.decode(errors="replace") does over the whole input.
    """

    def __init__(self):
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:  # a lead byte, or one that stands alone
                if UTF8_LENGTH[byte] > back and self.could_go_on(data[-back:]):
                    cut -= back
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def could_go_on(start: bytes) -> bool:
        """Whether more bytes can complete this: the second byte rules out overlong forms, surrogates and the rest."""
        if len(start) < 2:
            return True
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(start[0], (0x80, 0xBF))
        return low <= start[1] <= high

    def finish(self) -> str:
        left, self.open = self.open, b""
        return left.decode("utf-8", "replace")


class BpeDecoder:
    """Ids to bytes, or to text as a stream."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = [b""] * (max(ranks.values()) + 1)
        for text, rank in ranks.items():
            self.token[rank] = text

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def stream(self, blocks: Iterable[bytes]) -> Iterator[str]:
        utf8 = Utf8Stream()
        for block in blocks:
            yield utf8.feed(self.decode(block))
        yield utf8.finish()


@contextmanager
def no_collection():
    """Automata are many small tuples without cycles; collecting garbage among them takes longer than using them."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def codec(path: str, pattern: str, limits: Limits = LARGE) -> tuple[BpeEncoder, BpeDecoder]:
    """Encoder and decoder of a rank file, kept in the worker."""

    def build():
        ranks = read_ranks(path)
        return BpeEncoder(ranks, pattern, limits), BpeDecoder(ranks)

    return held(("bpe", path, pattern, limits), build)


#: Bytes of ids decoded at a time, and rows encoded before they are passed on.
BLOCK, ROWS = 1 << 18, 500


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limits: Limits = LARGE) -> DataFrame:
    """Each row's ``keep`` columns, with ids (binary, little-endian u32), n_tokens and decoded (the text read back).

    Rows come one for one, repeated ones too; null and empty texts have no tokens. The work is a map over rows without
    a shuffle, so a lost executor costs its own tasks. Other columns of ``docs`` are not read, whatever their names; columns
    called ids, n_tokens or decoded can't be among those kept.
    """
    if taken := {"ids", "n_tokens", "decoded"}.intersection(c.lower() for c in keep):
        raise ValueError(f"columns {sorted(taken)} are made here")
    source = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches):
        encoder, decoder = codec(path, pattern, limits)
        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, len(whole), ROWS)):
                with no_collection():
                    ids = [encoder.encode(t) for t in batch.column(len(keep)).to_pylist()]
                decoded = ["".join(decoder.stream(x[i : i + BLOCK] for i in range(0, len(x), BLOCK))) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(keep)], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.string())],
                    [*keep, "ids", "n_tokens", "decoded"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, ids binary, n_tokens bigint, decoded string")


def digest_documents(docs: DataFrame, path: str, pattern: str, limits: Limits = LARGE) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes."""
    out = encode_documents(docs, path, pattern, limits=limits)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
