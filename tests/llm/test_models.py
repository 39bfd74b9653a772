import random
import zlib

import pytest
from pyspark.sql import functions as F

from repolith.llm import language_id, toxicity
from repolith.llm.common import table
from tests.llm.data import docs

SF = "/root/testdata/sf0.01"


def test_language_id_held_out(spark):
    frame = table(spark, SF, "documents")
    model = language_id.fit(language_id.training_rows(frame, language_id.held_out()))
    found = language_id.identify(frame.select("doc_id", "text"), model, ["doc_id"]).collect()
    truth = {r["doc_id"]: r["lang"] for r in frame.select("doc_id", "lang").collect()}
    out = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(found) == 1000 and out
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    odd = docs(spark, {1: None, 2: "", 3: "123 ?!", 4: "語 " * 50, 5: "the of and that the " * 2000, 6: "a"})
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd, model, ["doc_id", "mark"]).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[5][0] == "en" and got[5][1] > 0.5
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = {r["doc_id"] for r in language_id.accepted(odd, model).collect()}
    assert 5 in kept and not kept & {1, 2, 3, 4}
    assert language_id.accepted(odd, model).columns == odd.columns
    empty = language_id.fit(language_id.training_rows(docs(spark, {}), language_id.held_out()))
    assert {r["lang_pred"] for r in language_id.identify(odd, empty, ["doc_id"]).collect()} == {"und"}


def model_of(words):
    counts = {}
    for w, n in words.items():
        w = "^^" + w + "$"
        for i in range(len(w) - 2):
            counts[w[i : i + 3]] = counts.get(w[i : i + 3], 0) + n
    return toxicity.LanguageModel.from_counts(counts)


WORDS = {"idiot": 50, "stupid": 50, "the": 500, "loser": 50, "trash": 40, "moron": 40, "dumb": 50, "such": 90, "a": 500, "today": 90, "i": 300, "good": 60}


def test_decode():
    model = model_of(WORDS)
    shown = {"1d10t": "idiot", "$tup1d": "stupid", "l.o.s.e.r": "loser", "trrrash": "trash", "m0r0n": "moron", "idiot": "idiot"}
    shown |= {"i" * 40 + "diot": "idiot", "..........".join("idiot"): "idiot", "i" * 3000 + "diot": "idiot"}
    for noisy, plain in shown.items():
        assert toxicity.decode(noisy, model) == [plain], noisy
        assert toxicity.skeleton(noisy) == toxicity.skeleton(plain)
    restorer = toxicity.Restorer(model, ["idiot", "moron", "los*"])
    assert restorer.features("you 1D10T!! m o r o n, l.o.s.e.r the") == {"idiot", "moron"}
    assert toxicity.Restorer(model, ["lose*"]).features("l.o.s.e.r the") == {"lose*"}
    assert toxicity.Restorer(model, []).features("idiot m o r o n") == set()


def readings(written):
    """Every path of the lattice: (words joined by $, cost of the channel)."""
    paths, previous = [("", 0.0)], ""
    for char in written:
        out = []
        letters = [(x, toxicity.SUBSTITUTE) for x in toxicity.LEET.get(char, "")] + ([(char, 0.0)] if char.isalpha() else [])
        for text, cost in paths:
            if char == " " or char in toxicity.SEPARATORS:
                out.append((text, cost + toxicity.SEPARATE))
            elif char == previous:
                out.append((text, cost + toxicity.REPEAT))
            elif not letters:
                out.append((text, cost + 3 * toxicity.SEPARATE))
            if not letters and text and text[-1] != "$":
                out.append((text + "$", cost))
            out += [(text + x, cost + c + (toxicity.KEEP_REPEAT if char == previous else 0.0)) for x, c in letters]
        paths, previous = out, char if char != " " else previous
    return paths


def test_viterbi_against_all_paths():
    r, model = random.Random(6), model_of(WORDS)
    for _ in range(150):
        written = "".join(r.choice("idot10m.- sr$") for _ in range(r.randint(1, 8))).strip() or "x"
        total = {}
        for text, cost in readings(written):
            for word in [w for w in text.split("$") if w] if text else []:
                padded = "^^" + word + "$"
                cost += sum(model.cost(padded[i : i + 2], padded[i + 2]) for i in range(len(padded) - 2))
            total[text.rstrip("$")] = min(cost, total.get(text.rstrip("$"), 1e9))
        got = "$".join(toxicity.decode(written, model))
        assert abs(total[got] - min(total.values())) < 1e-9, (written, got)
        assert toxicity.skeleton("".join(got.split("$"))) == toxicity.skeleton(written)


@pytest.mark.parametrize("noise", [False, True])
def test_toxicity_held_out(spark, noise):
    frame, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    if noise:  # obfuscated copies of held-out documents
        spoiled = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "idiot", "1d10t"), "moron", "m0r0n"), "clown", "c.l.o.w.n")
        frame = frame.withColumn("text", F.when(toxicity.held_out(), spoiled).otherwise(F.col("text")))
    out = [r for r in toxicity.score_toxicity(frame, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    hit = [r["predicted"] == truth[r["doc_id"]] for r in out]
    assert len(out) > 40 and sum(hit) >= 0.95 * len(hit)


def test_toxicity_odd_rows(spark):
    frame = docs(spark, {1: None, 2: "", 3: "x " * 50_000, None: "you idiot", 5: "1" * 1000, 6: "a.b.c.d"})
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.score_toxicity(frame, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    assert toxicity.score_toxicity(frame.where("false"), labels).count() == 0


def test_spelt_words_beside_others():
    """Blanks are part of the lattice: spelt-out words beside others, words in pieces; and doubled letters."""
    restorer = toxicity.Restorer(model_of(WORDS), ["a", "dumb", "idiot", "moron"])
    found = restorer.features
    assert {"a", "moron"} <= found("such a m o r o n today")
    assert {"a", "dumb", "idiot"} <= found("a d u m b i d i o t")
    assert "moron" in found("i m 0 r o n")
    assert "moron" in found("such mor on today") and "idiot" in found("idi ot") and "idiot" in found("id io t")
    assert found("idiiot") == {"idiot"} and found("good") == set()


def test_signs_end_words():
    restorer = toxicity.Restorer(model_of(WORDS | {"you": 90, "hello": 50}), ["idiot", "moron", "moro*"])
    for text, want in (("you.idiot", {"idiot"}), ("idiot,moron", {"idiot", "moron", "moro*"}), ("good/1d10t", {"idiot"}), ("hello...m0r0n!", {"moron", "moro*"}), ("the-day", set()), ("i.d.i.o.t", {"idiot"}), ("a" * 300_000 + ",idiot", {"idiot"})):
        assert restorer.features(text) == want, text


def test_rare_toxic_words_and_near_copies(spark):
    """A word of one toxic document in a hundred is learned; the words of a group of near copies are not."""
    r = random.Random(1)
    word = lambda n: "".join(r.choice("bcdfghjklmnpqrstvwxz") + r.choice("aeiou") for _ in range(n))
    bad, good = [word(4) for _ in range(100)], [word(3) for _ in range(2000)]
    rows = []
    for i in range(6000):
        tokens = [r.choice(good) for _ in range(30)]
        if i < 2000:
            tokens.insert(r.randrange(30), bad[i % 100])
        rows.append((i, " ".join(tokens), int(i < 2000)))
    base = [word(5) for _ in range(40)]
    rows += [(7000 + i, " ".join([*base[: i % 40], "odd", *base[i % 40 :], "tail", bad[i % 100]]), 1) for i in range(400)]
    rows += [(9000, " ".join(base), 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score_toxicity(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).join(frame, "doc_id").collect()
    held = [x for x in got if x["held_out"] and x["doc_id"] < 7000]
    assert sum(x["predicted"] for x in held if x["toxic"]) > 0.97 * sum(x["toxic"] for x in held)
    assert sum(x["predicted"] for x in held if not x["toxic"]) < 0.01 * len(held)
    assert [x["predicted"] for x in got if x["doc_id"] == 9000] == [0]


def test_toxicity_ties_and_repeated_rows(spark):
    pairs = [(i, f"you moron {i}") for i in range(40)] + [(100 + i, f"good day {i}") for i in range(60)]
    pairs += [(7, "good day"), (7, "you moron 7"), (7, "you moron 7"), (300, "such a m o r o n"), (301, "m0r0n"), (302, None)]
    labels = spark.createDataFrame([(i, int(i < 100), 1) for i, _ in pairs[:100]] + [(7, 1, 0)], "doc_id long, toxic int, quality int")
    frame = docs(spark, pairs).withColumnsRenamed({"size": "score", "mark": "found"})
    got = toxicity.score_toxicity(frame, labels).collect()
    assert len(got) == len(pairs)
    by_text = {}
    for r in got:
        by_text.setdefault(r["doc_id"], []).append((r["score"], r["predicted"]))
    assert [p for _, p in sorted(by_text[7])] == [0, 1, 1, 1] and by_text[300][0][1] == by_text[301][0][1] == 1 and by_text[302][0][1] == 0


def test_language_filter_against_exact_sets(spark):
    """Shares by the filter are those by exact sets of n-grams, but for false positives."""
    frame = table(spark, SF, "documents").limit(300).cache()
    rows = frame.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    model = language_id.fit(rows, fit_rows=10**9)
    counts = {}
    for r in rows.select("lang", F.lower("text").alias("t")).distinct().collect():
        for g in language_id.grams([r["t"].encode()])[0].tolist():
            counts.setdefault(r["lang"], {}).setdefault(g, 0)
            counts[r["lang"]][g] += 1
    sets = {k: set(v) for k, v in counts.items()}
    assert model.languages == sorted(sets)
    texts = [r["t"].encode() for r in rows.select(F.lower("text").alias("t")).collect()]
    got = language_id.shares(model, texts)
    for i, t in enumerate(texts):
        have = language_id.grams([t])[0].tolist()
        exact = [sum(g in sets[k] for g in have) / max(1, len(have)) for k in model.languages]
        assert max(abs(a - b) for a, b in zip(got[i], exact)) < 0.15
        if len(have) > 300:
            top = sorted(exact)[-2:]
            assert max(abs(a - b) for a, b in zip(got[i], exact)) < 0.03
            assert top[1] - top[0] < 0.06 or got[i].argmax() == exact.index(top[1])


def test_many_languages_repeated_ids_and_clashing_names(spark):
    r = random.Random(8)
    words = {f"l{k:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for k in range(140)}
    pairs = [(k, " ".join(r.choice(words[k]) for _ in range(60)), k) for k in words for _ in range(3)]
    shape = "doc_id long, text string, lang string, score int, lang_pred string, _text string"
    frame = spark.createDataFrame([(i % 50, t, k, 1, "x", "y") for i, (_, t, k) in enumerate(pairs)] * 2, shape)
    model = language_id.fit(frame.select("doc_id", "text", "lang"))
    assert len(model.languages) == 140 and model.slots.shape[1] == 3
    got = language_id.identify(frame.select("doc_id", "text", "lang", "_text"), model, ["lang", "_text"]).collect()
    assert len(got) == 840 and all(x["lang"] == x["lang_pred"] for x in got)
    kept = language_id.accepted(frame, model)
    assert kept.columns == frame.columns and kept.count() == 840


def test_language_of_one_document(spark):
    """One short document is enough to learn a language."""
    pairs = [(i, "the house of the king is on the hill and the river", "en") for i in range(20)] + [(50, "el perro y la casa de los reyes", "es")]
    model = language_id.fit(spark.createDataFrame(pairs, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "es"]
    asked = spark.createDataFrame([(1, "la casa de los perros"), (2, "the river of the king")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(asked, model, ["doc_id"]).collect()} == {1: "es", 2: "en"}


def test_language_sample_is_bounded(spark):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") < 19_000, "a").otherwise("b").alias("lang"))
    hot = frame.limit(1).crossJoin(spark.range(5000)).select(frame.columns)
    sizes = {r["lang"]: r["count"] for r in language_id.sampled(frame.union(hot), 500).groupBy("lang").count().collect()}
    assert 300 < sizes["a"] < 620 and 400 < sizes["b"] < 600
