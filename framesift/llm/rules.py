"""Quality rules as weak supervision.

Each rule votes on a document: good, bad, or abstains. No rule is trusted as such. How often each one votes which way
on good and on bad documents is estimated by expectation-maximisation over the votes of the whole corpus (a latent-class
model with rules independent given the class), and a document is kept if its posterior probability of being good is at
least a half. Since votes are few, documents with equal votes form one pattern: patterns are counted over all documents
before the shuffle, and expectation-maximisation runs exactly on at most 3^rules counts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.held import release
from framesift.plans.staging import stage

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_distinct", "n_lettered", "letter_bytes", "word_bytes")
#: ASCII bytes that are no letters and no white space; bytes from 0x80 on belong to letters of other alphabets.
OTHER = bytes(b for b in range(0x80) if not chr(b).isalpha() and b not in SPACES)
BAD, ABSTAIN, GOOD = 0, 1, 2
PRIOR_GOOD, PSEUDO, ROUNDS = 0.8, 2.0, 200


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # more distinct words than 21 bits tell apart: number the pairs first
        _, pairs = np.unique(np.stack([ids[:-2], ids[1:-1]]), axis=1, return_inverse=True)
        windows = pairs.reshape(-1) * len(number) + ids[2:]
    order = np.sort(windows)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    again = np.flatnonzero(np.isin(windows, twice))
    hit = np.zeros(len(words), bool)
    for i in range(3):
        hit[again + i] = True
    return int(hit.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of STATS. Words are runs without the bytes 0x20 and 0x09-0x0D; a null text has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0,) * len(STATS)  # every symbol would be a word
    chars = len(text) - sum(map(raw.count, (bytes([b]) for b in SPACES)))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = Counter(line for line in raw.split(b"\n") if line.strip(SPACES))
    upper = sum(map(bytes.isupper, words))
    lettered = raw.translate(None, OTHER).split()
    sizes = sum(map(len, lettered)), sum(map(len, words))
    return (len(words), chars, symbols, sum(lines.values()) - len(lines), repeated_words(words), upper, len(set(words)), len(lettered), *sizes)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and STATS of every row's whole text."""
    source = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches):
        release()
        for batch in batches:
            rows = [text_stats(t) for t in batch.column(len(keep)).to_pylist()]
            found = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *found], [*keep, *STATS])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(run, fields + ", ".join(f"{s} bigint" for s in STATS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def votes() -> list[Column]:
    """The rules. Each looks at a trait of its own, since the model takes them as independent given the class, and
    abstains in between or where there is too little text to say."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    some = F.col("n_words") >= 20
    per_word = F.col("n_symbols") / n
    return [
        vote(per_word > 0.1, some & (per_word < 0.01)),
        vote(F.col("n_repeat_words") / n > 0.3, some & (F.col("n_repeat_words") / n < 0.05)),
        vote(some & (F.col("n_upper_words") / n > 0.4), some & (F.col("n_upper_words") / n < 0.1)),
        vote(some & (F.col("n_distinct") / n < 0.15), (F.col("n_words") >= 40) & (F.col("n_distinct") / n > 0.35)),
        vote(F.col("n_words") < 10, F.col("n_words") >= 50),
        vote((F.col("word_chars") / n < 2.5) | (F.col("word_chars") / n > 12), (F.col("word_chars") / n >= 3.5) & (F.col("word_chars") / n <= 9)),
        vote(F.col("n_dup_lines") >= 5, F.col("n_dup_lines") == 0),
        vote(some & (F.col("n_lettered") / n < 0.8), some & (F.col("n_lettered") / n > 0.95)),
        vote(some & (F.col("letter_bytes") < 0.7 * F.col("word_bytes")), some & (F.col("letter_bytes") > 0.9 * F.col("word_bytes"))),
    ]


def pattern() -> Column:
    """All votes as one number, base 3."""
    out = F.lit(0)
    for v in votes():
        out = out * 3 + v
    return out.cast("int")


def fit(patterns: np.ndarray, counts: np.ndarray, rules: int) -> np.ndarray:
    """The posterior probability of being good of every possible pattern.

    For each rule and class the model has the chance of voting bad, given that the rule votes; an abstention says
    nothing. It starts from rules that seldom fault good documents and often bad ones, which fixes which class is the
    good one; estimates are kept off 0 and 1 by PSEUDO documents that vote like the start.
    """
    digits = lambda p: np.stack([p // 3 ** (rules - 1 - i) % 3 for i in range(rules)], axis=1)
    prior, start = np.array([1 - PRIOR_GOOD, PRIOR_GOOD]), np.array([0.4, 0.02])
    chance = np.repeat(start[:, None], rules, axis=1)  # of a bad vote, by class and rule

    def posterior(votes):
        log = np.log(prior) + (votes == BAD) @ np.log(chance).T + (votes == GOOD) @ np.log(1 - chance).T
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    seen = digits(patterns)
    for _ in range(ROUNDS if len(patterns) else 0):
        share = posterior(seen) * counts[:, None]
        mass = share.sum(axis=0)
        bad, good = share.T @ (seen == BAD), share.T @ (seen == GOOD)
        fresh = (bad + PSEUDO * start[:, None]) / (bad + good + PSEUDO)
        prior = (mass + PSEUDO * np.array([1 - PRIOR_GOOD, PRIOR_GOOD])) / (mass.sum() + PSEUDO)
        moved, chance = np.abs(fresh - chance).max(), fresh
        if moved < 1e-9:
            break
    return posterior(digits(np.arange(3**rules)))[:, 1]


def label_model(measured: DataFrame) -> Column:
    """Counts the patterns of all rows, fits, and gives the posterior as a column over the same columns.

    What comes to the driver is one row for each pattern that occurs, 3^9 = 19683 at most.
    """
    rules = len(votes())
    found = measured.groupBy(pattern().alias("p")).count().collect()
    good = fit(np.array([r["p"] for r in found], np.int64), np.array([r["count"] for r in found], float), rules)
    return F.element_at(F.lit([round(float(g), 9) for g in good]), pattern() + 1)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and posterior, for each row of ``docs`` (doc_id, text; no others are read).

    kept is false where the base rules fail, else posterior >= 0.5, so a tie is kept. A null or empty text has no words and
    fails. Whole texts are measured, whatever their length. The model is one of all rows given, repeated rows as often as they
    come, and rows with equal texts are judged alike; an empty table gives no rows.
    """
    measured = stage(measure(docs, ["doc_id"]), "measures")
    good = label_model(measured)
    rows = measured.select("*", good.alias("posterior"), base_failed().alias("base_failed"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"), "posterior",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all columns as they were.

    Texts are measured twice, once for the counts and once to decide: that moves nothing between tasks, where carrying
    decisions back to texts would shuffle the corpus.
    """
    good = label_model(measure(docs, []))
    names = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(c).alias(n) for n, c in names.items()], F.col("text"))
    rows = measure(renamed, list(names))
    kept = rows.where(~base_failed() & (good >= 0.5))
    return kept.select(*[F.col(n).alias(c) for n, c in names.items()])
