import math
import random
import re
from collections import Counter

import numpy as np

from framesift.llm import ordinal, rules
from tests.llm.helpers import SCHEMA, frame, odd_documents, prose, words_of


def plain_stats(text):
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures(spark):
    texts = ["a b c a b c", "x x x x x", "one\none\n \n\none", "a|b # $ % <x>", "", None, "é É ß z", "a b", "aa bb cc dd aa bb cc"]
    for t in texts + [x[1] for x in odd_documents()]:
        assert rules.text_stats(t)[:5] == plain_stats(t)
    got = Counter(tuple(r)[:6] for r in rules.judge(frame(spark)).collect())
    assert got == Counter((x[0], *plain_stats(x[1])) for x in odd_documents())
    assert rules.judge(frame(spark, [])).count() == 0 and rules.keep_good(frame(spark, [])).count() == 0


def corpus(seed=1, n=400):
    """Mostly prose; some symbol spam, lists and shouting."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeinorst") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    rows, junk = [], set()
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(60, 200))]
        if i % 8 == 0:
            junk.add(i)
            kind = i // 8 % 3
            words = [w + r.choice(["###", "%%%"]) for w in words] if kind == 0 else [x for w in words for x in (w, "|")] if kind == 1 else ["spam", "spam", "eggs"] * 40
        rows.append((i, " ".join(words), "en", "s", 1, 7, "mine", 0.5, "kept"))
    return rows, junk


def test_label_model_finds_junk_without_labels(spark):
    rows, junk = corpus()
    got = {r.doc_id: r for r in rules.judge(frame(spark, rows)).collect()}
    assert {i for i, r in got.items() if not r.kept} == junk
    kept = rules.keep_good(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == set(got) - junk and kept.columns == frame(spark).columns
    assert all(r["size"] == 7 for r in kept.collect())


def test_fit_is_that_of_single_documents():
    """Counting equal votes changes nothing: the fit of patterns with counts is the fit of the rows."""
    r = np.random.default_rng(0)
    rows = r.integers(0, 27, 300)
    patterns, counts = np.unique(rows, return_counts=True)
    assert np.allclose(rules.fit(patterns, counts.astype(float), 3), rules.fit(rows, np.ones(300), 3))
    assert rules.fit(np.zeros(0, int), np.zeros(0), 3).shape == (27,)


def plain_votes(text):
    """The votes of the rules on one text, from words and letters: -1 bad, 1 good, 0 neither."""
    words, (n_words, chars, symbols, dup_lines, repeats) = words_of(text), plain_stats(text)
    n, some = max(n_words, 1), n_words >= 20
    pick = lambda bad, good: -1 if bad else 1 if good else 0
    letter = lambda c: c.isascii() and c.isalpha() or not c.isascii()
    upper = sum(w.encode().isupper() for w in words)
    lettered = sum(any(map(letter, w)) for w in words)
    size = lambda cs: sum(len(c.encode()) for c in cs)
    every = size("".join(words))
    letters = size(c for w in words for c in w if letter(c))
    return [
        pick(symbols / n > 0.1, some and symbols / n < 0.01),
        pick(repeats / n > 0.3, some and repeats / n < 0.05),
        pick(some and upper / n > 0.4, some and upper / n < 0.1),
        pick(some and len(set(words)) / n < 0.15, n_words >= 40 and len(set(words)) / n > 0.35),
        pick(n_words < 10, n_words >= 50),
        pick(chars / n < 2.5 or chars / n > 12, 3.5 <= chars / n <= 9),
        pick(dup_lines >= 5, dup_lines == 0),
        pick(some and lettered / n < 0.8, some and lettered / n > 0.95),
        pick(some and letters < 0.7 * every, some and letters > 0.9 * every),
    ]


def plain_posteriors(texts):
    """Expectation-maximisation over single documents, a number at a time."""
    seen = [plain_votes(t) for t in texts]
    prior, chance = [1 - rules.PRIOR_GOOD, rules.PRIOR_GOOD], [[0.4] * 9, [0.02] * 9]

    def posterior(v):
        weight = [math.prod([prior[c], *[chance[c][j] if x < 0 else 1 - chance[c][j] if x > 0 else 1.0 for j, x in enumerate(v)]]) for c in (0, 1)]
        return weight[1] / sum(weight)

    for _ in range(rules.ROUNDS):
        good = [posterior(v) for v in seen]
        fresh = []
        for c, start in ((0, 0.4), (1, 0.02)):
            row = []
            for j in range(9):
                share = lambda sign: sum((g if c else 1 - g) for g, v in zip(good, seen) if v[j] == sign)  # noqa: B023, E731
                bad, fine = share(-1), share(1)
                row.append((bad + rules.PSEUDO * start) / (bad + fine + rules.PSEUDO))
            fresh.append(row)
        mass = sum(good)
        prior = [(len(seen) - mass + rules.PSEUDO * (1 - rules.PRIOR_GOOD)) / (len(seen) + rules.PSEUDO), (mass + rules.PSEUDO * rules.PRIOR_GOOD) / (len(seen) + rules.PSEUDO)]
        moved = max(abs(a - b) for x, y in zip(fresh, chance) for a, b in zip(x, y))
        chance = fresh
        if moved < 1e-9:
            break
    return [posterior(v) for v in seen]


def test_verdicts_are_those_of_plain_maximisation(spark):
    rows = corpus()[0] + odd_documents()
    expected = Counter()
    for (i, t, *_), p in zip(rows, plain_posteriors([x[1] for x in rows])):
        n_words, _, _, _, repeats = plain_stats(t)
        failed = n_words < 50 or 100 * repeats > 50 * n_words
        assert abs(p - 0.5) > 1e-6
        expected[i, failed, not failed and p >= 0.5, round(p, 6)] += 1
    got = Counter((r.doc_id, r.base_failed, r.kept, round(r.posterior, 6)) for r in rules.judge(frame(spark, rows)).collect())
    assert got == expected
    stay = Counter(i for (i, _, kept, _), n in expected.items() for _ in range(n) if kept)
    assert Counter(r.doc_id for r in rules.keep_good(frame(spark, rows)).collect()) == stay


def rated(seed=2, n=900):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeinorst") for _ in range(r.randrange(2, 7))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(30, 120))]
        quality, toxic = int(r.random() < 0.7), int(r.random() < 0.3)
        if not quality:
            words = [w + "%%%" for w in words]
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["foo", "bar", "baz"])
        docs.append((i, " ".join(words), "en", "s", 1, 7, "mine", 0.5, "kept"))
        labels.append((i, quality, toxic))
    return docs, labels


LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_ratings(spark):
    docs, labels = rated()
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(1, None, 0), (None, 1, 1), (3, 5, 0), (5, labels[5][1], labels[5][2])], LABELS)
    got = {r.doc_id: r for r in ordinal.classify(frame(spark, docs), known).collect()}
    held_out = [x for x in labels if not x[0] % 2]
    right = [got[i].kept == bool(q and not t) for i, q, t in held_out]
    assert np.mean(right) > 0.95
    grade = lambda q, t: q + 1 - t
    means = [np.mean([got[i].expected_grade for i, q, t in held_out if grade(q, t) == g]) for g in range(3)]
    assert means[0] < means[1] < means[2] and all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())


def test_scores_equal_features_times_weights():
    model = ordinal.Model(np.random.default_rng(1).normal(size=ordinal.BUCKETS), np.array([-1.0, 1.0]))
    of, score = ordinal.Features(), ordinal.Features(model.weights)
    for _, t, *_ in odd_documents():
        assert abs(sum(model.weights[b] * v for b, v in of.of(t).items()) - score.score(t)) < 1e-9


def test_odd_tables(spark):
    none = spark.createDataFrame([], LABELS)
    got = ordinal.classify(frame(spark), none).collect()
    assert len(got) == len(odd_documents()) and all(r.kept for r in got)
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], LABELS)
    assert ordinal.classify(frame(spark, []), some).count() == 0
    kept = ordinal.select_good(frame(spark), some)
    assert kept.columns == frame(spark).columns and set(SCHEMA.split(", ")[1].split()) == {"text", "string"}
    again = ordinal.classify(frame(spark, partitions=5), some).collect()
    assert Counter(map(tuple, ordinal.classify(frame(spark), some).collect())) == Counter(map(tuple, again))
    assert prose(random.Random(0), 3)


def plain_fit_gradient(rows, grades, model, penalty):
    """The slope of the penalised likelihood along each weight in use and each threshold, by differences."""
    used = sorted({b for at, _ in rows for b in at.tolist() if model.weights[b]})

    def value(weights, cuts):
        edges, total = [-math.inf, *cuts, math.inf], 0.0
        for (at, v), g in zip(rows, grades):
            s = sum(weights[b] * x for b, x in zip(at.tolist(), v.tolist()))
            tail = lambda c: 1.0 if c == -math.inf else 0.0 if c == math.inf else 1 / (1 + math.exp(c - s))  # noqa: B023, E731
            total += math.log(tail(edges[g]) - tail(edges[g + 1]))
        return total / len(rows) - penalty * sum(weights[b] ** 2 for b in used)

    base, out = {b: float(model.weights[b]) for b in used}, []
    base = {b: base.get(b, 0.0) for at, _ in rows for b in at.tolist()}
    cuts = model.thresholds.tolist()
    step = 1e-4
    for b in used[:12]:
        up, down = dict(base), dict(base)
        up[b], down[b] = base[b] + step, base[b] - step
        out.append((value(up, cuts) - value(down, cuts)) / (2 * step))
    for i in range(len(cuts)):
        up, down = list(cuts), list(cuts)
        up[i], down[i] = cuts[i] + step, cuts[i] - step
        out.append((value(base, up) - value(base, down)) / (2 * step))
    return out


def test_fit_is_at_the_top_of_the_likelihood():
    docs, labels = rated(n=300)
    features = ordinal.Features()
    rows = [(np.array(list(f)), np.array(list(f.values()))) for f in (features.of(t) for _, t, *_ in docs)]
    grades = np.array([q + 1 - t for _, q, t in labels])
    model = ordinal.fit(rows, grades)
    assert (np.diff(model.thresholds) > 0).all() and np.count_nonzero(model.weights)
    assert np.abs(plain_fit_gradient(rows, grades.tolist(), model, ordinal.PENALTY)).max() < 5e-3


def test_every_row_is_scored_by_the_fitted_model(spark):
    docs, labels = rated(n=300)
    known = spark.createDataFrame(labels, LABELS)
    rows = docs + odd_documents()[-12:]
    model = ordinal.train(frame(spark, rows), known)
    features, expected = ordinal.Features(), Counter()
    for i, t, *_ in rows:
        s = sum(model.weights[b] * v for b, v in features.of(t).items())
        tails = [1 / (1 + math.exp(c - s)) for c in model.thresholds]
        expected[i, round(sum(tails), 5), tails[1] >= 0.5] += 1
    got = Counter((r.doc_id, round(r.expected_grade, 5), r.kept) for r in ordinal.classify(frame(spark, rows), known).collect())
    assert got == expected


def test_a_rated_id_on_very_many_rows_is_one_rating(spark):
    docs, labels = rated(n=200)
    many = [(docs[5][0], f"other text {i}", *docs[5][2:]) for i in range(20_000)]
    known = spark.createDataFrame(labels, LABELS)
    seen = []
    original, ordinal.fit = ordinal.fit, lambda rows, grades: seen.append(len(rows)) or original(rows, grades)
    try:
        one, two = [ordinal.train(frame(spark, docs + many, partitions=p), known, sample=200) for p in (2, 5)]
    finally:
        ordinal.fit = original
    assert seen == [200, 200] and (one.weights == two.weights).all() and (one.thresholds == two.thresholds).all()
