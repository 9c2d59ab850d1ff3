"""Interpolated scores against a plain model over dictionaries."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from boardsift.llm import interpolation as lm

SCHEMA = "doc_id bigint, text string, block string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(i, cfg):
    if i is None or zlib.crc32(str(i).encode()) % 7 == 2:
        return lm.TEST
    return lm.DELETED if zlib.crc32(str(i).encode()) // 7 % cfg.deleted_share == 0 else lm.TRAIN


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def counted(docs, order):
    """{gram: count}, with begin marks, and counts of the histories."""
    grams, before = Counter(), Counter()
    for text in docs:
        t = [None] * (order - 1) + tokens(text)
        for k in range(order - 1, len(t)):
            for size in range(1, order + 1):
                gram = tuple(t[k - size + 1:k + 1])
                grams[gram] += 1
                before[gram[:-1], size] += 1
    return grams, before


def estimated(text, grams, before, order, words):
    t = [None] * (order - 1) + tokens(text)
    for k in range(order - 1, len(t)):
        f, bucket = [1 / (words + 1)], ()
        for size in range(1, order + 1):
            gram = tuple(t[k - size + 1:k + 1])
            n = before[gram[:-1], size]
            f.append(grams[gram] / n if n else 0.0)
            if size > 1:
                bucket += (n.bit_length(),)
        yield bucket, f


def normal(w, bucket):
    w = [x if k < 2 or bucket[k - 2] else 0 for k, x in enumerate(w)]
    return [x / sum(w) for x in w]


def brute(rows, cfg):
    train = [t for i, t in rows if split(i, cfg) != lm.TEST]
    grams, before = counted(train, cfg.order)
    kept = counted([t for i, t in rows if split(i, cfg) == lm.TRAIN], cfg.order)
    words = len({g for g in grams if len(g) == 1})
    n = sum(c for g, c in grams.items() if len(g) == 1)
    events = [e for i, t in rows if split(i, cfg) == lm.DELETED for e in estimated(t, *kept, cfg.order, words)]
    ones = [1.0] * (cfg.order + 1)
    weights = {}
    for _ in range(cfg.rounds if events else 0):
        sums = {}
        for bucket, f in events:
            w = weights.get(bucket) or normal(ones, bucket)
            p = [a * b for a, b in zip(w, f)]
            sums.setdefault(bucket, []).append([x / sum(p) for x in p])
        sums = {b: [sum(c) for c in zip(*v)] for b, v in sums.items()}
        pooled = [sum(c) for c in zip(*sums.values())]
        ones = [x / sum(pooled) + 1e-9 for x in pooled]
        weights = {b: normal([x + y for x, y in zip(v, ones)], b) for b, v in sums.items()}
    out = []
    for i, t in rows:
        c = [grams[(w,)] for w in tokens(t)]
        mix = sum(math.log10(sum(a * b for a, b in zip(weights.get(k) or normal(ones, k), f)))
                  for k, f in estimated(t, grams, before, cfg.order, words))
        out.append((str(i), len(c), sum(x > 0 for x in c), sum(math.log10((x + 1) / (n + words + 1)) for x in c), mix))
    return sorted(out), n


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"W{k}" for k in range(30)] + ["É", "x y", " ", "a\x00b"]
    text = lambda: rng.choice([" ", "\n", "\t\r "]).join(rng.choice(vocab[:rng.choice([3, 12, 34])]) for _ in range(rng.randrange(40)))
    rows = [(i, text()) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (None, "w1 w2 unseen"), (4, rows[5][1]), rows[6], rows[6],
                   (n + 3, " ".join(f"w{k % 30}" for k in range(3000)))]


def got(spark, rows, cfg):
    df = spark.createDataFrame([(i, t, "own", "own") for i, t in rows], SCHEMA).repartition(3)
    out, totals = lm.score(df, cfg)
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in out.collect()), totals.tokens


@pytest.mark.parametrize("order,block,part", [(2, 1 << 21, 1 << 20), (3, 64, 128), (1, 200, 300), (2, 50, 32)])
def test_scores_equal_plain_model(spark, order, block, part):
    cfg = lm.Settings(order=order, block=block, part=part, deleted_share=4, rounds=5)
    rows = corpus(order, 60)
    (found, n), (want, m) = got(spark, rows, cfg), brute(rows, cfg)
    assert n == m and [r[:3] for r in found] == [r[:3] for r in want]
    for a, b in zip(found, want):
        assert a[3:] == pytest.approx(b[3:], rel=1e-5)


@pytest.mark.parametrize("rows", [[], [(2, "held out or not")], [(None, None)]])
def test_little_or_no_training_text(spark, rows):
    (found, _), (want, _) = got(spark, rows, lm.Settings()), brute(rows, lm.Settings())
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert all(a[3:] == pytest.approx(b[3:], rel=1e-5) for a, b in zip(found, want))


def test_probabilities_add_up_to_one(spark):
    """Over all known words and one unknown, after any history."""
    cfg = lm.Settings(order=3)
    grams, before = counted(["a b a", "b a c", "a b"], 3)
    words = 4
    rng = np.random.default_rng(2)
    weights = lm.normalised(rng.random((64**2, 4)) + 0.1, 3)
    for history in ["a b", "b a", "zz b", "zz zz", ""]:
        total = 0.0
        for w in ["a", "b", "c", "", "new"]:
            t = [None, None] + history.split() + [w]
            f, bucket = [1 / (words + 1)], 0
            for size in range(1, cfg.order + 1):
                gram = tuple(t[len(t) - size:])
                n = before[gram[:-1], size]
                f.append(grams[gram] / n if n else 0.0)
                bucket = bucket * 64 + n.bit_length() if size > 1 else 0
            total += float(weights[bucket] @ f)
        assert total == pytest.approx(1)


def test_likelihood_rises_with_each_round():
    rng = np.random.default_rng(3)
    bucket, f = rng.integers(0, 5, 400), rng.random((3, 400))
    weights, last = lm.normalised(np.ones((64, 3)), 2), -np.inf
    for _ in range(15):
        now = np.log((weights[bucket].T * np.where(lm.seen(2)[bucket].T, f, 0)).sum(0)).sum()
        assert now >= last - 0.5  # one pooled token a bucket is added
        last = now
        weights = lm.maximised(lm.expected(weights, bucket, np.where(lm.seen(2)[bucket].T, f, 0)), 2)
