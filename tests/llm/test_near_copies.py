"""Near copies of the pipeline are those of five-word shingles with Jaccard 0.8 or more, and no others."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from framesift.llm import shingles, simhash
from tests.llm.helpers import Union, bits, frame, lowered, odd_documents, words_of


def plain_set(text):
    w = words_of(lowered(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def words(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def appended(r, base, similarity):
    """With a block at the end, so that the similarity is just at or over this."""
    n = len(base) - 4
    return base + words(r, int(n / similarity) - n)


def edited(r, base, count):
    """With so many single words changed, evenly apart."""
    out = base.copy()
    for k in range(count):
        out[(2 * k + 1) * len(base) // (2 * count)] = f"v{r.randrange(5000)}"
    return out


def row(i, w):
    return (i, " ".join(w), "en", "a", 0, 7, "mine", 0.5, "kept")


def dropped_to(spark, rows):
    return sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect())


def plain_kept(rows):
    """Brute force over distinct rows with ids."""
    sets = [plain_set(t) for _, t, *_ in rows]
    u = Union()
    for i in range(len(rows)):
        u.find(i)
    for i, j in combinations(range(len(rows)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            u.join(i, j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(u.find(i), []).append(rows[i][0])
    return sorted(min(g) for g in groups.values())


def test_different_documents_stay(spark):
    """Pairs at 0.6 to 0.79 whose word pairs give close fingerprints."""
    r = random.Random(1)
    rows = []
    for i in range(30):
        base = words(r, 300)
        other = edited(r, base, 8 + i % 6)
        assert 0.6 < jaccard(plain_set(" ".join(base)), plain_set(" ".join(other))) < 0.8
        rows += [row(2 * i, base), row(2 * i + 1, other)]
    assert dropped_to(spark, rows) == list(range(60))


def test_copies_with_a_block_go(spark):
    r = random.Random(2)
    rows = []
    for i in range(30):
        base = words(r, 300)
        other = appended(r, base, [0.8, 0.82, 0.85, 0.9][i % 4])
        assert 0.8 <= jaccard(plain_set(" ".join(base)), plain_set(" ".join(other))) < 0.91
        rows += [row(2 * i, base), row(2 * i + 1, other)]
    assert dropped_to(spark, rows) == list(range(0, 60, 2))


@pytest.mark.parametrize("block", [3, shingles.BLOCK])
def test_kept_rows_match_brute_force(spark, block, monkeypatch):
    """Odd documents, chains, and a group of copies of one text, in one block or dealt out over many."""
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "SENT", 0 if block == 3 else shingles.SENT)
    r = random.Random(3)
    rows = [x for x in dict.fromkeys(odd_documents()) if x[0] is not None]
    for g in range(4):
        base = words(r, 200)
        for i in range(12):
            rows.append(row(1000 + 100 * g + i, edited(r, base, r.randrange(1, 7)) if i % 3 else appended(r, base, r.choice([0.75, 0.8, 0.9]))))
    assert dropped_to(spark, rows) == plain_kept(rows)


def test_different_texts_under_one_id_stay(spark):
    r = random.Random(6)
    texts = [words(r, 100) for _ in range(4)]
    rows = [row(1, texts[0]), row(1, texts[1]), row(1, texts[1]), row(1, edited(r, texts[0], 1)), row(2, texts[1]), row(2, texts[2]), row(3, texts[2]), row(0, texts[3]), row(1, texts[3])]
    got = sorted((x.doc_id, x.text) for x in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect())
    assert [i for i, _ in got] == [0, 1, 1, 2]
    assert {t for i, t in got if i != 1} == {rows[7][1], rows[5][1]}
    assert {t for i, t in got if i == 1} - {rows[0][1], rows[3][1]} == {rows[1][1]}  # and one of the two near copies


def test_links_are_exact_at_the_border():
    sets = [np.arange(80, dtype=np.uint64), np.arange(100, dtype=np.uint64), np.arange(101, dtype=np.uint64) + np.uint64(1000), np.arange(80, dtype=np.uint64) + np.uint64(1000)]
    a, b = shingles.near_links(np.array([1, 2, 3, 4]), np.zeros(4, int), sets)
    assert list(zip(a.tolist(), b.tolist())) == [(1, 2)]
    assert len(shingles.near_links(np.array([1, 2]), np.zeros(2, int), [np.zeros(0, np.uint64), sets[0]])[0]) == 0


def searches(a, b):
    """Whether SimHash and whether the bands propose this pair."""
    prints = [[simhash.fingerprint(t, corpus_pipeline.WIDTH, s) for s in corpus_pipeline.SEEDS] for t in (a, b)]
    apart = [bits(x, y) for x, y in zip(*prints)]
    return min(apart) <= corpus_pipeline.RADIUS and sum(apart) <= corpus_pipeline.TOTAL, bool((shingles.band_keys(shingles.shingle_set(a)) == shingles.band_keys(shingles.shingle_set(b))).any())


def measured(n_words=600, trials=400, seed=4):
    """Share of pairs found by SimHash, by bands and by either: for each kind of edit and similarity."""
    r, out = random.Random(seed), {}
    for kind in ("block", "scattered"):
        for j in (0.95, 0.9, 0.85, 0.8):
            found = []
            for _ in range(trials):
                base = [f"w{x}" for x in r.sample(range(100_000), n_words)]
                other = appended(r, base, j) if kind == "block" else edited(r, base, int((n_words - 4) * (1 - j) / (1 + j) / 5))
                assert jaccard(plain_set(" ".join(base)), plain_set(" ".join(other))) >= j
                found.append(searches(" ".join(base), " ".join(other)))
            s, b = np.array(found).T
            out[kind, j] = s.mean(), b.mean(), (s | b).mean()
    return out


def test_recall_by_similarity():
    """``measured()`` gives the README's figures; fewer trials here."""
    for (kind, j), (_, _, either) in measured(n_words=300, trials=40).items():
        assert either == 1, (kind, j)
