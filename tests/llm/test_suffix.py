import hashlib
import random
from collections import Counter

import numpy as np

from repolith.llm.induced import SuffixQueue, sort_suffixes
from repolith.llm.suffix_dedup import MEMORY, dedup_substrings, repeated
from repolith.llm.superkmers import pack
from tests.llm.data import docs


def brute_suffixes(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0][: len(text)]
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        lcp.append(k)
    return order, lcp


def test_sort_suffixes_against_brute_force():
    r = random.Random(3)
    cases = [b"", b"a", b"aa", b"ab", b"ba", b"mississippi", b"\x00\x00", b"abcabcabc\x00abc", b"aaaaabaaaaab" * 5, bytes(range(256)) * 2]
    cases += [bytes(r.choice(b"ab\x00") for _ in range(r.randint(1, 60))) for _ in range(150)]
    cases += [bytes(r.choice(b"abcdefgh \xff") for _ in range(400)) * r.randint(1, 3) for _ in range(10)]
    for text in cases:
        order, lcp = sort_suffixes(np.frombuffer(text, np.uint8), 5000, memory=r.choice([10, 1 << 20]))
        expected = brute_suffixes(text)
        assert order.tolist() == expected[0], text
        assert lcp.tolist() == expected[1], text
        order, lcp = sort_suffixes(np.frombuffer(text, np.uint8), 6)
        assert [text[i : i + 6] for i in order] == sorted(text[i : i + 6] for i in range(len(text)))
        assert [min(6, v) for v in lcp] == [min(6, v) for v in expected[1]]


def brute(pairs, width):
    data = [(i, (t or "").encode()) for i, t in pairs]
    count = Counter(b[k : k + width] for _, b in data for k in range(len(b) - width + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k + 1 : k + 1 + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    make = lambda n: "".join(r.choice("abcdeé \n") for _ in range(n))
    passage = make(150)
    pairs = []
    for i in range(50):
        t = make(r.randint(0, 200))
        if r.random() < 0.6:
            a, b = sorted(r.sample(range(151), 2))
            t += passage[a:b] + make(r.randint(0, 50))
        pairs.append((i, t))
    pairs += [(100, pairs[3][1]), (3, pairs[5][1]), (None, pairs[6][1]), (None, None), (101, ""), (102, "ab" * 90), (103, "x" * 90), (104, "\x00" * 70), (105, make(40) * 2)]
    return pairs + [pairs[4]]


def test_substrings_against_brute_force(spark):
    for seed, per_shard in ((1, 40_000), (2, 9), (3, 3)):
        pairs = corpus(seed)
        for width, probe in ((30, 8), (41, 4)):
            got = dedup_substrings(docs(spark, pairs).repartition(3), width, probe, per_shard)
            assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute(pairs, width)
    assert dedup_substrings(docs(spark, {})).count() == 0


def test_no_string_reaches_over_the_joint(spark):
    r = random.Random(5)
    make = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    pairs = []
    for i in range(30):  # c ends like a and begins like b, with U+0000 between
        a, b = make(60, "ab\x00"), make(60, "ab\x00")
        pairs += [(3 * i, a), (3 * i + 1, b), (3 * i + 2, a[-25:] + "\x00" + b[:25])]
    got = dedup_substrings(docs(spark, pairs).repartition(2), 30, 8)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute(pairs, 30)


def test_spills_and_several_levels_at_production_settings():
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(500)]
    base = " ".join(r.choice(words) for _ in range(120_000)).encode()
    text = np.frombuffer(base + b"|" + base[:200_000] + b"!" + base[100_000:400_000], np.uint8)
    assert len(text) > MEMORY
    levels = []
    order, lcp = sort_suffixes(text, 400, MEMORY, levels)
    assert len(levels) > 2
    data = text.tobytes()
    at = order.astype(np.int64)
    assert np.array_equal(np.sort(at), np.arange(len(text)))
    for i in r.sample(range(1, len(at)), 3000):
        a, b = data[at[i - 1] : at[i - 1] + 400], data[at[i] : at[i] + 400]
        k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert a <= b and min(400, lcp[i]) == k
    inside, spilled = SuffixQueue(1 << 30), SuffixQueue(50)
    for queue in (inside, spilled):
        s = random.Random(1)
        for step in range(200):
            char = np.sort(np.array([s.randint(step // 20, 30) for _ in range(20)], np.int32))
            queue.push(char, np.arange(20, dtype=np.int32) + 20 * step, np.ones(20, np.int32))
    assert spilled.spilled > 0
    for last in range(31):
        assert all(np.array_equal(a, b) for a, b in zip(inside.pop(last), spilled.pop(last)))


def test_shard_larger_than_memory():
    r = random.Random(2)
    texts = [bytes(r.choice(b"abc") for _ in range(120)) for _ in range(40)]
    texts += [texts[i][20:90] + bytes(r.choice(b"abc") for _ in range(30)) for i in range(30)]
    n = len(texts)
    columns = [np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.array([len(t) for t in texts])]
    small, large = (repeated([pack(columns, b"".join(texts))], 50, memory) for memory in (64, 1 << 24))
    assert len(small["id"]) and all(np.array_equal(small[k], large[k]) for k in small)
