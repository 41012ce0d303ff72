import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framesift.llm import golay, neardup
from framesift.llm.components import components
from tests.llm.helpers import Union, bits, frame, lowered, odd_documents, prose, rng, words_of


def test_golay_words_have_one_nearest_codeword():
    keys, counts = golay.keys(np.arange(1 << 14) * 509 % (1 << 23))
    assert set(counts.tolist()) == {1, 6} and keys.max() < 4096


def test_words_two_bits_apart_share_a_key():
    """All error pairs for some words: the claim is linear, so the words' syndromes are what matters."""
    words = rng().integers(0, 1 << 23, 60)
    flips = [0, *(1 << i for i in range(23)), *((1 << i) | (1 << j) for i, j in combinations(range(23), 2))]
    near = words[:, None] ^ np.array(flips)[None, :]
    a, _ = golay.keys(words)
    b, _ = golay.keys(near.ravel())
    b = b.reshape(*near.shape, -1)
    shared = (a[:, None, :, None] == b[:, :, None, :]) & (a >= 0)[:, None, :, None]
    assert shared.any(axis=(2, 3)).all()


def test_keys_find_every_pair_within_the_radius():
    r = rng(1)
    base = r.integers(0, 1 << 63, 500).astype(np.uint64)
    other = base.copy()
    for i in range(len(other)):
        for b in r.choice(64, 5, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    (ra, ka), (rb, kb) = neardup.fingerprint_keys(base, 0), neardup.fingerprint_keys(other, 0)
    mine, theirs = set(zip(ra.tolist(), ka.tolist())), set(zip(rb.tolist(), kb.tolist()))
    assert {i for i, _ in mine & theirs} == set(range(500))


def test_components_match_union(spark):
    r = random.Random(2)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 8), (8, 7)]
    u = Union()
    for a, b in pairs:
        if a != b:
            u.join(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {n: u.find(n) for n in u.up}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_print(text):
    w = words_of(lowered(text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_copies(seed=3, n=40):
    """Long texts that differ in a word or two, so that fingerprints differ in a few bits."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(900)]
    rows = []
    for i in range(n):
        words = base.copy()
        for _ in range(r.randrange(0, 6)):
            words[r.randrange(900)] = f"v{r.randrange(99)}"
        rows.append((200 + i, " ".join(words), "en", "a", 0, 0, "", 0.0, ""))
    return rows


@pytest.mark.parametrize("limit", [4, neardup.LIMIT])
def test_groups_match_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(neardup, "BUFFER", 64 if limit == 4 else neardup.BUFFER)
    rows = odd_documents() + near_copies()
    prints = [(i, plain_print(t)) for i, t, *_ in rows]
    u = Union()
    for (_, a), (_, b) in combinations(prints, 2):
        if bits(a, b) <= 4:
            u.join(a, b)
    least = {}
    for i, p in prints:
        root = u.find(p)
        least[root] = min([x for x in (least.get(root), i) if x is not None], default=None)
    got = neardup.near_duplicates(frame(spark, rows), limit=limit).select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("f"), "component_id").collect()
    assert sorted(map(repr, got)) == sorted(repr(type(got[0])(doc_id=i, f=f"{p:016x}", component_id=least[u.find(p)])) for i, p in prints)


def test_empty_table(spark):
    assert neardup.simhash_groups(frame(spark, [])).count() == 0
    assert neardup.drop_near_duplicates(frame(spark, []), 2, (42, 43), 5, 10).count() == 0


def test_dedup_keeps_one_of_each_group_and_all_columns(spark):
    r = random.Random(8)
    rows = [(i, prose(r, 150) + f" unique{i} " * 3, "en", "a", 1, 7, "mine", 0.5, "kept") for i in range(20)]
    copies = [(100 + i, rows[i][1], *rows[i][2:]) for i in range(5)] + [rows[0]]
    near = [(200 + i, rows[i][1].replace("unique", "Unique", 1) + " more", *rows[i][2:]) for i in range(5, 8)]
    got = neardup.drop_near_duplicates(frame(spark, rows + copies + near), 2, (42, 43, 44), 5, 25)
    assert sorted(x.doc_id for x in got.collect()) == list(range(20))
    assert got.columns == frame(spark).columns
    assert all(x["size"] == 7 and x.component_id == "kept" for x in got.collect())
