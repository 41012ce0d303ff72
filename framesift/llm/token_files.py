"""Token ids as Parquet files that can be read in part.

A file holds a run of documents in doc_id order: id, number of tokens, where they start within the file, and the ids as
a list of 32-bit integers. Ids are dictionary-encoded (a page's ids take 16 bits or fewer before compression), the
three counters by delta, which the second writer version gives integers that no dictionary helps. Row groups and pages
have set sizes and every column chunk its page index, so a range of documents costs the pages it lies on, and a query
of counts reads no ids.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.count import byte_letters
from framesift.llm.held import held, release
from framesift.plans.staging import shared_path

#: Bytes of text of a file, bytes of a row group and of a page, and rows of a page.
FILE_BYTES, ROW_GROUP, PAGE, PAGE_ROWS = 64 << 20, 32 << 20, 256 << 10, 1_000

#: Rows and bytes of text that are encoded together.
SLICE, SLICE_BYTES = 4_000, 12 << 20
#: Words a worker remembers, and files whose totals are broadcast.
MAX_KNOWN, MAX_BROADCAST_FILES = 500_000, 200_000
#: Where a piece ends whatever stands around: before a space or line feed that follows a character which is not white space.
CUT, ENDS = re.compile(r"(?<=\S)(?=[ \n])"), ",."
#: What byte-level vocabularies write each byte as.
LETTERS = {byte: ord(letter) for letter, byte in byte_letters().items()}

FILE_SCHEMA = "doc_id bigint, n_tokens bigint, start_in_file bigint, file int, ids array<int>"


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``starts``, one run after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class LibraryEncoder:
    """Whole texts by the tokenizers library, each different word once.

    The byte-level split ends a piece before a space or line feed that follows a character which is not white space, so
    what stands between two such places can be encoded alone and gives what the whole text gives. Texts are cut there
    (``words``), different words are told apart by Arrow's dictionary encoding, and ids are put together by place in one
    array of the ids of all known words. When these are too many the half not met for longest is forgotten.
    """

    def __init__(self, path: str, room: int = MAX_KNOWN):
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[-1]
        self.known = pa.array([], pa.string())
        self.starts, self.sizes, self.met = (np.zeros(0, np.int64) for _ in range(3))
        self.store, self.turn = np.zeros(0, np.int32), 0
        # the short ways hold for the usual byte-level BPE: one split by the common pattern, no normalizer
        parts = json.loads(self.tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        self.plain = parts["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not parts["normalizer"] and not any(t["content"].isalpha() for t in parts["added_tokens"])
        single = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ENDS + "\n"}
        self.plain &= all(len(x) == 1 for x in single.values())
        self.ends, self.feed = {c: x[0] for c, x in single.items()}, single["\n"][0]

    def ids(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [array("i", e.ids).tobytes() for e in encode(texts, add_special_tokens=False)]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of words without white space inside, each after a space: a line each in one text, cut at the line feeds."""
        out, feed = [], self.line_feed
        for i in range(0, len(words), 200):
            some = words[i : i + 200]
            raw = self.ids(["\n".join([" " + w for w in some])])[0]
            cuts = (4 * np.flatnonzero(np.frombuffer(raw, np.int32) == feed)).tolist()
            if len(cuts) != len(some) - 1:  # a word brought a line feed of its own
                out += self.ids([" " + w for w in some])
                continue
            out += [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)])]
        return out

    def letter_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces of the split, which the library's model takes at once, and how many each piece has."""
        take, flat, sizes = self.tokenizer.model.tokenize, [], []
        for piece in "\t".join(pieces).encode().decode("latin-1").translate(LETTERS).split(chr(LETTERS[ord("\t")])) if pieces else ():
            found = take(piece)
            sizes.append(len(found))
            flat += [x.id for x in found]
        return np.array(flat, np.int32), np.array(sizes, np.int64)

    def learn(self, words: list[str]) -> None:
        """New words. Those of letters are one piece of the split; a comma or full stop after letters is a piece, and so is
        the line feed that a word begins with; others are for the library to split."""
        if self.plain:
            cores = {w: core for w in words if (core := w[:-1] if w[-1:] in ENDS else w) and (core[1:] if core[0] == "\n" else core).isalpha()}
            every = list(set(cores.values()))
            fresh = [w for w, i in zip(every, self.look_up(pa.array(every, pa.string())).tolist()) if i < 0]
            lines = [w for w in fresh if w[0] == "\n"]
            spaced = [w for w in fresh if w[0] != "\n"]
            self.enter(spaced, *self.letter_ids([" " + w for w in spaced]))
            ids, sizes = self.letter_ids([w[1:] for w in lines])
            ids = np.insert(ids, np.cumsum(sizes) - sizes, self.feed) if lines else ids
            self.enter(lines, ids, sizes + 1)
            if ended := [w for w, core in cores.items() if w is not core]:
                at = self.look_up(pa.array([cores[w] for w in ended], pa.string()))
                ids, sizes = self.store[spans(self.starts[at], self.sizes[at])], self.sizes[at]
                self.enter(ended, np.insert(ids, np.cumsum(sizes), [self.ends[w[-1]] for w in ended]), sizes + 1)
            words = [w for w in words if w not in cores]
        whole = [w for w in words if w.split() == [w]]
        rest = [w for w in words if w.split() != [w]]
        raw = self.word_ids(whole) + [x for i in range(0, len(rest), 500) for x in self.ids([w if w[:1] in (" ", "\n") else " " + w for w in rest[i : i + 500]])]
        self.enter(whole + rest, np.frombuffer(b"".join(raw), np.int32), np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw)))

    def enter(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        if words:
            self.known = pa.concat_arrays([self.known, pa.array(words, pa.string())])
            self.starts = np.concatenate([self.starts, len(self.store) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.met = np.concatenate([self.met, np.full(len(sizes), self.turn, np.int64)])
            self.store = np.concatenate([self.store, ids])

    def forget(self) -> None:
        """Only the half that was met last stays."""
        stay = self.met > np.median(self.met)
        self.known = self.known.filter(pa.array(stay))
        self.store = self.store[spans(self.starts[stay], self.sizes[stay])]
        self.sizes, self.met = self.sizes[stay], self.met[stay]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def look_up(self, words: pa.Array) -> np.ndarray:
        """Where each word stands among the known ones, -1 for others."""
        return pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each word stands among the known ones, new ones having been learnt."""
        coded = words.dictionary_encode()
        if len(self.known) > self.room:
            self.forget()
        found = self.look_up(coded.dictionary)
        new = coded.dictionary.filter(pa.array(found < 0))
        self.learn(new.to_pylist())
        found[found < 0] = self.look_up(new)
        self.turn += 1
        self.met[found] = self.turn
        return found[coded.indices.to_numpy()]

    @staticmethod
    def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, and how many each text has, one at least.

        A word that does not begin with a line feed or space stands after a space; those that do are as they are.
        """
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy()
        odd = pc.or_(pc.equal(pc.binary_length(flat), 0), pc.utf8_is_space(flat)).to_numpy(zero_copy_only=False)
        if not odd.any():
            return flat, counts
        ends = np.concatenate([[0], np.cumsum(odd)])[np.cumsum(counts)]
        parts, counts = [], counts.copy()
        for i in np.flatnonzero(np.diff(ends, prepend=0)).tolist():  # spaces next to white space do not cut
            first, *rest = CUT.split(texts[i].as_py())
            parts.append((i, [first, *[r[1:] if r[0] == " " and not r[1:2].isspace() else r for r in rest]]))
        starts = np.cumsum(counts) - counts
        pieces, at = [], 0
        for i, words in parts:
            pieces += [flat.slice(starts[at], starts[i] - starts[at]), pa.array(words, pa.string())]
            counts[i], at = len(words), i + 1
        if at < len(counts):
            pieces.append(flat.slice(starts[at]))
        return pa.concat_arrays(pieces), counts

    def encode(self, texts: pa.Array, tail: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``tail`` after each, and how many each text has."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        flat, counts = self.words(texts)
        heads = np.cumsum(counts) - counts
        inner = np.ones(len(flat), bool)
        inner[heads] = False
        place = self.places(flat.filter(pa.array(inner)))
        raw = self.ids(flat.take(pa.array(heads)).to_pylist())
        head_sizes = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
        store = np.concatenate([self.store, np.frombuffer(b"".join(raw), np.int32), np.array(tail, np.int32)])
        # a text is its head, its words, and the tail
        first = heads + np.arange(len(counts))
        last = first + counts
        starts, sizes = np.zeros(len(flat) + len(counts), np.int64), np.zeros(len(flat) + len(counts), np.int64)
        starts[first], sizes[first] = len(self.store) + np.cumsum(head_sizes) - head_sizes, head_sizes
        starts[last], sizes[last] = len(store) - len(tail), len(tail)
        middle = np.ones(len(starts), bool)
        middle[first] = middle[last] = False
        starts[middle], sizes[middle] = self.starts[place], self.sizes[place]
        return store[spans(starts, sizes)], np.add.reduceat(sizes, first)


def slices(batch: pa.RecordBatch, column: str):
    """The batch in parts of at most SLICE rows and about SLICE_BYTES bytes of text."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    number = np.maximum(np.cumsum(sizes) // SLICE_BYTES, np.arange(len(sizes)) // SLICE)
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))


def library_encoder(path: str) -> LibraryEncoder:
    """Kept in the worker."""
    return held(("library", path), lambda: LibraryEncoder(path))


def write_token_files(docs: DataFrame, tokenizer: str, out: str, end_id: int | None = 0, files: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write the ids under ``out``, in ascending doc_id order over the files.

    A null text is empty. ``end_id`` is appended to each document. Rows are range-partitioned by doc_id, then by a hash
    of the text, then by their place in the input, which splits even a row that fills a third of the table; null ids come
    first; repeated rows are written as often as they come. There are ``files`` files, or one for each FILE_BYTES bytes of
    text. Text is moved, not ids: it is smaller. Other columns are not written.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    n = files or 1 + int(base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES
    dealt = base.repartitionByRange(n, *ordered).sortWithinPartitions(ordered[0], ordered[1], "text")
    tail = [] if end_id is None else [end_id]

    def encode(batches):
        from pyspark import TaskContext

        encoder, file, start = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                values, counts = encoder.encode(batch.column("text"), tail)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(start + ends - counts), pa.array(np.full(len(counts), file, np.int32)), lists], ["doc_id", "n_tokens", "start_in_file", "file", "ids"])
                start += int(counts.sum())

    (
        dealt.mapInArrow(encode, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(out)
    )


def files_before(rows: DataFrame) -> DataFrame:
    """file and before, the ids of all files before it: from the files' totals, a query that reads two small columns.

    One row a file; broadcast if they are no more than MAX_BROADCAST_FILES, so that what is joined stays where it is.
    """
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    return F.broadcast(before) if len(rows.inputFiles()) <= MAX_BROADCAST_FILES else before


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids; a filter on doc_id reaches the pages' statistics."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    return rows.join(files_before(rows), "file").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


def token_checksums(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of the ids as little-endian 32-bit integers, read from the files.

    A task opens its files and takes their pages in batches of PAGE_ROWS rows, so it holds few ids at a time.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    files = spark.createDataFrame([(f,) for f in rows.inputFiles()], "path string")

    def run(batches):
        release()
        for batch in batches:
            for name in batch.column("path").to_pylist():
                system, inner = fs.FileSystem.from_uri(name)
                with system.open_input_file(inner) as file:
                    for part in pq.ParquetFile(file).iter_batches(PAGE_ROWS):
                        lists = part.column("ids")
                        values, at = np.asarray(lists.values.to_numpy(zero_copy_only=False), "<i4"), lists.offsets.to_numpy().tolist()
                        sums = [zlib.crc32(values[a:b]) for a, b in zip(at, at[1:])]
                        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("file", "doc_id", "start_in_file", "n_tokens")], pa.array(sums, pa.int64())], ["file", "doc_id", "start_in_file", "n_tokens", "ids_crc32"])

    found = files.repartition(max(1, files.count()), "path").mapInArrow(run, "file int, doc_id bigint, start_in_file bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(files_before(rows), "file").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write, read back, and digest."""
    path = shared_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer, path, end_id)
    return token_checksums(docs.sparkSession, path)
