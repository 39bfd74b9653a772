import hashlib
import random

import numpy as np

from repolith.llm import window_dedup
from repolith.llm.window_dedup import dedup_windows, equal_windows
from tests.llm.data import docs


def brute_windows(pairs, width):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in pairs]
    big = 1 << 63
    for i, w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, big), big - 1 if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (big - 1 if i is None else i):
                gone |= set(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["the", "a", "é", "Of", "x\x00y", " ", "zz", "long" * 9, "on", "and"]
    passage = [r.choice(words) for _ in range(40)]
    pairs = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(0, 80))]
        if r.random() < 0.5:
            k = r.randint(0, len(w))
            a, b = sorted(r.sample(range(41), 2))
            w[k:k] = passage[a:b]
        pairs.append((i, r.choice([" ", "\n", "  "]).join(w)))
    pairs += [(100, pairs[3][1]), (-5, pairs[4][1]), (7, pairs[3][1]), (None, pairs[3][1]), (101, None), (102, ""), (103, "the " * 500), (2, "the " * 100)]
    return pairs + [pairs[-1]]


def test_windows_against_brute_force(spark):
    for seed, per_bucket in ((1, 20_000), (2, 7), (3, 2)):
        pairs = corpus(seed)
        for width, probe in ((8, 2), (13, 4)):
            got = dedup_windows(docs(spark, pairs).repartition(3), width, probe, per_bucket)
            assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == brute_windows(pairs, width)
    assert dedup_windows(docs(spark, {})).count() == 0


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_collide_in_polynomial_hashes(spark):
    same = " ".join(f"w{i}" for i in range(49))
    pairs = [(1, f"{same} {thue_morse(2048, 'a', 'b')}"), (2, f"{same} {thue_morse(2048, 'b', 'a')}")]
    for per_bucket in (20_000, 1):  # in a bucket, and as hot windows
        got = dedup_windows(docs(spark, pairs), per_bucket=per_bucket)
        assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == brute_windows(pairs, 50)


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(window_dedup, "span_hash", lambda h, width, c: (h[: len(h) - width + 1] % np.uint64(2)))
    words = np.array([random.Random(4).randint(0, 2) for _ in range(300)])
    at = np.arange(297)
    group = equal_windows(words, at, 4)
    shown = {}
    for i, g in zip(at.tolist(), group.tolist()):
        assert shown.setdefault(g, tuple(words[i : i + 4])) == tuple(words[i : i + 4])
    assert len(shown) == len({tuple(words[i : i + 4]) for i in at.tolist()})
