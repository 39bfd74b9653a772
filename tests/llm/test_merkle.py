import hashlib
import random
import zlib

from pyspark.sql import functions as F

from repolith.llm.merkle import FIELDS, manifest, tamper_check
from tests.llm.data import SCHEMA, docs


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def climb(nodes):
    """(root, path of every leaf), a path being (left, right) by level."""
    paths, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k in range(len(run)):
                for i in owner[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            held.append([i for k in range(len(run)) for i in owner[a + k]])
        nodes, owner = up, held
    return nodes[0], paths


def brute(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, subroots = [], []
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, leaf(r)))
        root, paths = climb([leaf(r) for r in own])
        subroots.append(root)
        trees.append((own, paths))
    root, above = climb(subroots) if subroots else (None, [])
    out = []
    for (own, paths), sub, rest in zip(trees, subroots, above):
        for r, path in zip(own, paths):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            text = r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            h = leaf({**r, "text": text} if hit else r)
            for left, right in path + rest:
                h = sha(left, h, right)
            out.append((r["doc_id"], leaf(r), sub, root, sha(*[a + b for a, b in path + rest]), h, h == root))
    return sorted(out, key=repr)


def check(spark, rows):
    frame = spark.createDataFrame([tuple(r.get(f) for f in ("doc_id", "text", "lang", "source", "n_chars")) + ("x", 1, "y") for r in rows], SCHEMA)
    got = tamper_check(frame.repartition(3), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    found = sorted(map(tuple, got.collect()), key=repr)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found == brute(rows)
    return found


def test_manifest_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [{"doc_id": i, "text": rng.choice(["", "Éa", "The End", "lower", None]) if i % 5 else f"Text {i}", "lang": "hot", "source": rng.choice(["s", None, ""]), "n_chars": i % 7 or None} for i in range(530)]
    rows += [{"doc_id": 1000 + i, "text": "ab" * 60_000 + str(i), "lang": lang, "source": "s", "n_chars": 1} for i, lang in enumerate([None, "", "é", "z", "de", "es", "fr", "it", "pt", "ru", "Z"] * 2)]
    rows += [{"doc_id": 7777, "text": "A", "lang": "lone", "source": "s", "n_chars": 1}]
    rows += [{"doc_id": 3, "text": "The End", "lang": "hot", "source": "s", "n_chars": 3}] * 2 + [{"doc_id": None, "text": "Nothing", "lang": "hot", "source": None, "n_chars": None}] * 9
    found = check(spark, rows)
    assert {v for *_, v in found} == {True, False}


def test_small_tables(spark):
    assert check(spark, []) == []
    (one,) = check(spark, [{"doc_id": 1, "text": "a", "lang": "en", "source": "s", "n_chars": 1}])
    assert one[1] == one[2] == one[3] == one[5]
    rows = [{"doc_id": i, "text": "Same", "lang": "en", "source": "s", "n_chars": 4} for i in range(9)]
    check(spark, rows)  # the second run has one node


def test_manifest_of_other_columns(spark):
    frame = docs(spark, {1: "a", 2: "b", 3: "c"})
    got = {r["doc_id"]: r for r in manifest(frame, ("doc_id", "text"), "source").collect()}
    assert got[1]["leaf"] == sha("1:1", "1:a") and got[1]["root"] == sha(*[got[i]["leaf"] for i in (1, 2, 3)])
    assert got[2]["siblings"] == got[1]["leaf"] + got[3]["leaf"]
