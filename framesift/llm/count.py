"""Token counts by a compiled finite-state tokenizer.

The tokenizer is a composition of deterministic automata: special strings, the split pattern, and byte-level BPE
determinised with the number of tokens it emits on each transition (``bpe.CountTransducer``). Together they have states of
three parts (``State``): the kind of piece that is open, the members of the BPE state reached in it, and at most a few
characters that what follows must decide on. Members are places in the vocabulary's trie, so a state has the same name in
every worker.

A text is cut into chunks that are counted apart. A chunk maps the state before it to the state after it and a count. Where
a space follows a character that is not white space, a piece ends and the next begins whatever came before, so there the
state is the start state. From the last such place in the characters before a chunk its entry state is known, and its map is
needed at that state alone. Maps compose in order by adding their counts, which is a sum over the cluster. Only where no such
place is near, as inside one very long word, is what precedes the chunk's first one kept back as text and run through in order
from the state that the chunk before it ends in.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.bpe import CountTransducer, Merges, Recent, TextEncoder, no_collection
from framesift.llm.bpe import State as BpeState
from framesift.llm.held import held
from framesift.plans.staging import stage

#: Characters of a chunk, and those before it in which its entry state is looked for.
CHUNK, LOOK = 1 << 16, 256
#: The split pattern that is compiled, and its contractions.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
#: How an open piece of each kind goes on.
RUNS = {kind: regex.compile(run).match for kind, run in {"letters": r"\p{L}*", "numbers": r"\p{N}*", "marks": r"[^\s\p{L}\p{N}]*", "space": r"\s*"}.items()}
FIRST_CUT, LAST_CUT = regex.compile(r"(?<=\S) ").search, regex.compile(r"(?r)(?<=\S) ").search


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class State(NamedTuple):
    """Where the tokenizer stands: the kind of the open piece ("" for none), its BPE members, and what is undecided: the last
    character of white space, an apostrophe that may begin a contraction, the start of a special string."""

    kind: str
    members: tuple
    pending: str


BETWEEN = ((-1, 0, 0),)
START = State("", BETWEEN, "")


class Counter:
    """Counts the tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        if model["model"]["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space") or model["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is compiled")
        letters = byte_letters()
        self.special = [t["content"] for t in model["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in model["added_tokens"]) or any(" " in t for t in self.special):
            raise ValueError("special tokens that take white space with them are not compiled")
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocabulary = {to_bytes(k): v for k, v in model["model"]["vocab"].items() if k not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        rank = {(to_bytes(a), to_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        if model["model"].get("ignore_merges"):
            raise ValueError("pieces that skip their merges are not compiled")
        self.transducer = CountTransducer(Merges(vocabulary, lambda a, b: rank.get((a, b))), whole=False)
        if pattern != SPLIT:
            raise ValueError("only the pattern SPLIT is compiled")
        self.split, self.find = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda s: [s]
        self.pieces = Recent(self.piece)
        self.words = TextEncoder(self.convert, self.piece)

    def piece(self, text: str) -> int:
        return self.transducer.encode(text.encode("utf-8", "surrogatepass"))

    def convert(self, text: str) -> int:
        total = 0
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                total += 1
                continue
            total += sum(map(self.pieces.__getitem__, self.split(part)))
        return total

    def count(self, text: str | None) -> int:
        first, rest = self.words.cut(text or "")
        return first + sum(rest)

    def feed(self, members: tuple, text: str) -> tuple[tuple, int]:
        """The BPE state after these characters of an open piece, and the tokens that are certain by then."""
        machine, total = self.transducer, 0
        state = machine.states.get(members) or machine.states.setdefault(members, BpeState(machine, members))
        for byte in text.encode("utf-8", "surrogatepass"):
            state, sure = state[byte]
            total += sure
        return state.members, total

    def run(self, state: State, text: str, final: bool = False) -> tuple[State, int]:
        """The state after ``text`` and the tokens emitted on the way; at the end of the whole text all that are left."""
        (kind, members, pending), total = state, 0
        parts = self.cut(pending + text)
        for i, part in enumerate(parts):
            if i % 2:  # a special string, before which everything is decided
                total, kind, members = total + 1, "", BETWEEN
                continue
            ends = final or i < len(parts) - 1
            open_at = len(part) if ends else len(part) - self.begun(part)
            kind, members, rest, n = self.segment(kind, members, part[:open_at], ends)
            total, pending = total + n, rest + part[open_at:]
        return State(kind, members, pending), total

    def begun(self, text: str) -> int:
        """How long the longest end of the text is that a special string may begin with."""
        most = max(map(len, self.special), default=1) - 1
        return next((n for n in range(min(most, len(text)), 0, -1) if any(s.startswith(text[-n:]) for s in self.special)), 0)

    def segment(self, kind: str, members: tuple, text: str, ends: bool) -> tuple[str, tuple, str, int]:
        """Characters without special strings: kind and members of the open piece, what is undecided, tokens emitted."""
        at = total = 0
        if kind:
            at = RUNS[kind](text).end()
            whole = at == len(text)
            if kind == "space" and not (whole and ends):
                at = max(at - 1, 0)  # the last one belongs to what follows
            members, total = self.feed(members, text[:at])
            if whole and not ends:
                return kind, members, text[at:], total
            total += members[-1][2]
        spans = [m.span() for m in self.find(text, at)]
        if ends or not spans:
            return "", BETWEEN, "", total + sum(self.pieces[text[a:b]] for a, b in spans)
        first, end = spans.pop()
        last = text[first:end]
        if last in ("l", "r", "v") and spans and text[slice(*spans[-1])] == "'":
            first, last = spans.pop()[0], "'" + last
        total += sum(self.pieces[text[a:b]] for a, b in spans)
        if last in CONTRACTIONS:
            return "", BETWEEN, "", total + self.pieces[last]
        if last[0] == "'" and last in ("'", "'l", "'r", "'v"):
            return "", BETWEEN, last, total
        kind = next(k for k, run in RUNS.items() if run(last[-1]).end())
        kept = last[-1] if kind == "space" else ""
        members, n = self.feed(BETWEEN, last[: len(last) - len(kept)])
        return kind, members, kept, total + n

    def entry(self, before: str) -> State | None:
        """The state after ``before``, which may be the end of a longer text, if it can be told from it."""
        found = LAST_CUT(before)
        return self.run(START, before[found.start() :])[0] if found else None

    def map(self, state: State, chunk: str, final: bool = False) -> tuple[State, int]:
        """What ``run`` gives; between the first and the last place that cuts the chunk its words are counted as words."""
        first, last = FIRST_CUT(chunk), LAST_CUT(chunk)
        if not first or first.start() == last.start():
            return self.run(state, chunk, final)
        a, b = first.start(), last.start()
        _, head = self.run(state, chunk[:a], True)
        after, tail = self.run(START, chunk[b:], final)
        return after, head + self.count(chunk[a:b]) + tail


def counter(path: str, pattern: str) -> Counter:
    """Kept in the worker."""
    return held(("count", path, pattern), lambda: Counter(path, pattern))


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``; null texts count as empty, with 0 of each.

    Texts of at most ``chunk`` characters are one chunk, counted where they are read. Longer ones are cut and the chunks
    dealt out over the cluster, each with the characters before it, so a very long text takes many tasks and copies of it no
    more; their counts are summed by row. Repeated rows are rows of their own. Other columns are not read.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")

    def whole(batches):
        machine = counter(path, pattern)
        for batch in batches:
            with no_collection():
                counts = [machine.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    keys = "doc_id bigint, n_bytes bigint, row bigint, ix bigint"

    def cut(batches):
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "row", "text")]):
                text, ends = row[3], len(row[3])
                for at in range(0, ends, 64 * chunk):
                    some = range(at, min(at + 64 * chunk, ends), chunk)
                    columns = [pa.array([x] * len(some), pa.int64()) for x in row[:3]] + [pa.array([i // chunk for i in some], pa.int64())]
                    columns += [pa.array([text[max(i - LOOK, 0) : i] for i in some]), pa.array([text[i : i + chunk] for i in some]), pa.array([i + chunk >= ends for i in some])]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "row", "ix", "before", "part", "final"])

    def mapped(batches):
        machine = counter(path, pattern)

        def one(ix, before, part, final):
            """Tokens, the text that is kept back, whether a piece ends there, and the state after the chunk where the next
            one can't tell it."""
            entry, back = (START if ix == 0 else machine.entry(before)), None
            if entry is None:
                first = FIRST_CUT(before[-1:] + part)
                if first is None:
                    return 0, part, final, None
                at = first.start() - len(before[-1:])
                entry, back, part, before = START, part[:at], part[at:], before + part[:at]
            after, n = machine.map(entry, part, final)
            return n, back, True, None if final or LAST_CUT((before + part)[-LOOK:]) else json.dumps(after)

        for batch in batches:
            with no_collection():
                found = [one(*x) for x in zip(*[batch.column(c).to_pylist() for c in ("ix", "before", "part", "final")])]
            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.string())
            made = [pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "n_bytes", "row", "ix")], *made], ["doc_id", "n_bytes", "row", "ix", "n", "back", "ends", "after"])

    def run_through(batches):
        """Rows in order: what was kept back, from the state before it; one text at a time, whatever its length."""
        machine, state, last = counter(path, pattern), START, None
        for batch in batches:
            counts = []
            with no_collection():
                for row, back, ends, after in zip(*[batch.column(c).to_pylist() for c in ("row", "back", "ends", "after")]):
                    state, last, n = (START if row != last else state), row, 0
                    if back is not None:
                        state, n = machine.run(state, back, ends)
                    if after is not None:
                        kind, members, pending = json.loads(after)
                        state = State(kind, tuple(map(tuple, members)), pending)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "n_bytes", "row")], pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "row", "n"])

    out = "doc_id bigint, n_bytes bigint, n_tokens bigint"
    short = base.where(F.length("text") <= chunk).select("doc_id", "text", n_bytes).mapInArrow(whole, out)
    long = base.where(F.length("text") > chunk).select("doc_id", n_bytes, F.monotonically_increasing_id().alias("row"), "text")
    parts = long.mapInArrow(cut, f"{keys}, before string, part string, final boolean").repartition("row", "ix")
    maps = stage(parts.mapInArrow(mapped, f"{keys}, n bigint, back string, ends boolean, after string"), "count-maps")
    open_ends = maps.where("back IS NOT NULL OR after IS NOT NULL")
    rest = open_ends.repartition("row").sortWithinPartitions("row", "ix").mapInArrow(run_through, "doc_id bigint, n_bytes bigint, row bigint, n bigint")
    sums = maps.select("doc_id", "n_bytes", "row", "n").unionByName(rest).groupBy("row", "doc_id", "n_bytes").agg(F.sum("n").alias("n_tokens"))
    return short.unionByName(sums.select("doc_id", "n_bytes", "n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
