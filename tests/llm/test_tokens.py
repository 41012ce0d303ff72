"""Transducers, counts and token files against the libraries."""

import random
from collections import Counter as Bag

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framesift.llm import bpe, count, token_files
from framesift.llm.queries import split_pattern, tokenizer_file
from tests.llm.helpers import crc, frame, odd_documents, sha, u32

tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")
RANKS, JSON = tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_file("byte_bpe_50k.json")
POOL = [*" \n\t'  \x1c\x1d\x85᠎​", *"abcdefst dmREVELL'", *"0123²½٣", *"éüñ漢字かな한🎉", "  ", "   ", "\n\n", "\r\n", "'s", "'ll", "<|endoftext|>", "!!", "...", "aaaaaaaa", "\x00", "ſ"]


def fuzz(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(POOL) for _ in range(r.randrange(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_transducer_equals_library(tik):
    encoder, decoder = bpe.codec(RANKS, split_pattern())
    for text in fuzz(3000) + ["a" * 5000, "", "x" * 300 + "\n" * 200]:
        want = u32(tik.encode_ordinary(text))
        assert encoder.encode(text) == want
        assert "".join(decoder.stream(want[i : i + 4] for i in range(0, len(want), 4))) == text


def test_toy_merges_equal_plain_bpe():
    """Vocabularies whose merges compete: any piece must give what joining the lowest pair first gives."""
    for seed in range(30):
        r = random.Random(seed)
        ranks = {bytes([b]): b for b in b"abc"}
        parts = list(ranks)
        while len(ranks) < 15:
            new = r.choice(parts) + r.choice(parts)
            if len(new) <= 6 and new not in ranks:
                ranks[new] = 1000 + len(ranks)
                parts.append(new)
        merges = bpe.Merges(ranks)
        machine, counts = bpe.Transducer(merges, whole=False), bpe.CountTransducer(merges, whole=False)
        for _ in range(200):
            piece = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 25)))
            want = [ranks[p] for p in merges.merge(piece)]
            assert list(machine.encode(piece)) == want and counts.encode(piece) == len(want)


def test_states_can_be_dropped():
    small = bpe.BpeEncoder(bpe.read_ranks(RANKS), split_pattern(), bpe.Limits(5, 3, 3))
    large = bpe.codec(RANKS, split_pattern())[0]
    text = " ".join(fuzz(50, 9))
    assert small.encode(text) == large.encode(text)


def test_utf8_stream_equals_whole_decoding():
    r = random.Random(4)
    for _ in range(2000):
        data = bytes(r.choice([*b"ab", 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x8E, 0x89, 0xED, 0xA0, 0xF4, 0x90, 0xC0, 0xFF]) for _ in range(r.randrange(0, 12)))
        s = bpe.Utf8Stream()
        got = "".join(s.feed(data[i : i + 1]) for i in range(len(data))) + s.finish()
        assert got == data.decode("utf-8", "replace")


def test_digests(spark, tik):
    got = Bag(tuple(r) for r in bpe.digest_documents(frame(spark), RANKS, split_pattern()).collect())
    want = Bag((i, len(ids := tik.encode_ordinary(t or "")), sha(u32(ids)), sha((t or "").encode())) for i, t, *_ in odd_documents())
    assert got == want
    assert bpe.digest_documents(frame(spark, []), RANKS, split_pattern()).count() == 0


def test_maps_of_any_chunks_compose(library):
    """From one character on: the states chunks end in are those the next ones begin in, and counts add up to the library's."""
    machine = count.counter(JSON, split_pattern())
    r = random.Random(7)
    texts = fuzz(1500, 3) + ["don't we'll 'llama ''s 'r 'x", "a<|endoftext|>b <|endof <|endoftext|> \n<|endoftext|>", "x" * 900, "word " * 60, "  \n " * 50, "漢字" * 200]
    for text in texts:
        want = len(library.encode(text, add_special_tokens=False).ids)
        for size in (1, 2, 7, 300, None):
            cuts = sorted(r.sample(range(1, max(2, len(text))), min(len(text) // 3, 6))) if size is None and len(text) > 6 else [*range(size or 1, len(text), size or 1)]
            state, total = count.START, 0
            for a, b in zip([0, *cuts], [*cuts, len(text)]):
                known = machine.entry(text[:a])
                assert known is None or known == state
                state, n = machine.map(state, text[a:b], b == len(text))
                total += n
            assert total == want
        assert machine.count(text) == want


def test_states_are_the_same_in_every_machine():
    """Names of states do not depend on what a machine has read before."""
    one, two = count.Counter(JSON, split_pattern()), count.counter(JSON, split_pattern())
    for text in fuzz(200, 11) + ["unfinished wo", "x" * 50, "tail \n", "it'l"]:
        assert one.run(count.START, text) == two.run(count.START, text)


def test_very_long_texts_without_a_space(spark, library):
    texts = ["q" * 5000, "漢字" * 2000, "ab1!" * 1200, "\n" * 3000, "x" * 700 + " " + "y" * 700 + " z " + "=" * 900, "a b " * 900 + "w" * 2000 + " end"]
    rows = [(i, t, "en", "a", 0, 0, "", 0.0, "") for i, t in enumerate(texts + texts[:2] + texts[:1])]
    want = Bag((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 30) for i, t, *_ in rows)
    assert Bag(tuple(r) for r in count.count_tokens(frame(spark, rows), JSON, split_pattern(), limit=30, chunk=100).collect()) == want


@pytest.mark.parametrize("room", [50, 400_000])
def test_library_encoder_equals_whole_texts(library, room):
    """Also with white space of every kind side by side, and words that are soon forgotten."""
    encoder = token_files.LibraryEncoder(JSON, room)
    r = random.Random(8)
    parts = ["a", "b", "é", " ", " ", "\n", "\t", "\r\n", "\x0b", "\x1c", "'s", "'", "1", "23", ",", ".", "<|endoftext|>", "漢", "ß", "don't", "word", "ª", "\u0301", "x²", "\x85"]
    texts = fuzz(2000, 5) + [" ".join(fuzz(40, 6))] + ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(3000)]
    for at in range(0, len(texts), 1500):
        some = texts[at : at + 1500]
        values, counts = encoder.encode(pa.array(some, pa.string()), [0])
        want = [[*e.ids, 0] for e in library.encode_batch(some, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and values.tolist() == [i for ids in want for i in ids]


def test_equal_rows_are_dealt_over_the_files(spark):
    """One row that fills the table is written by many tasks, and starts still follow each other."""
    from framesift.plans.staging import shared_path

    rows = [(5, "the same text", "en", "a", 0, 0, "", 0.0, "")] * 300
    path = shared_path(spark, "test-tokens")
    token_files.write_token_files(frame(spark, rows, partitions=5), JSON, path, files=6)
    per_file = spark.read.parquet(path).groupBy("file").count().collect()
    got = sorted(token_files.token_checksums(spark, path).collect(), key=lambda r: r.start)
    assert len(per_file) > 3 and [r.start for r in got] == [i * got[0].n_tokens for i in range(300)]


def test_token_files(spark, library):
    rows = odd_documents()
    got = sorted(token_files.token_file_digests(frame(spark), JSON).collect(), key=lambda r: (r.start, r.n_tokens))
    ids = {t or "": [*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t, *_ in rows}
    assert Bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Bag((i, len(ids[t or ""]), crc(ids[t or ""])) for i, t, *_ in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    assert token_files.token_file_digests(frame(spark, []), JSON).count() == 0


def test_token_files_are_read_in_part(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    out = f"file://{tmp_path}/tokens"
    token_files.write_token_files(frame(spark), JSON, out)
    files = sorted(glob.glob(f"{tmp_path}/tokens/*.parquet"))
    chunk = pq.ParquetFile(files[0]).metadata.row_group(0)
    by_name = {chunk.column(i).path_in_schema: chunk.column(i) for i in range(chunk.num_columns)}
    assert "RLE_DICTIONARY" in by_name["ids.list.element"].encodings and all(c.has_column_index for c in by_name.values())
    back = token_files.read_token_files(spark, out)
    one = back.where(F.col("doc_id") == 7).collect()
    assert len(one) == 1 and one[0].ids[-1] == 0 and len(one[0].ids) == one[0].n_tokens
