import random
import re
import time
from pathlib import Path

from pyspark.sql import functions as F

from repolith.llm import line_dedup
from repolith.llm.line_dedup import bitmaps, dedup_lines, flagged, neighbours, plausible, prefix_pairs, shingles, similar, unsettled
from tests.llm.data import docs


def norm(line):
    return re.sub(r"[ \t\r\x0b\f]+", " ", line.lower()).strip(" ")


def grams(line):
    return {line[i : i + 12] for i in range(max(1, len(line) - 11))}


def brute(pairs, least=20, similarity=0.8):
    """All pairs of distinct lines; the MinHash operator misses a link with a small chance only."""
    big = 1 << 63
    places = {}
    for n, (i, t) in enumerate(pairs):
        for k, raw in enumerate((t or "").split("\n")):
            if len(raw.strip(" ")) >= least:
                places.setdefault(norm(raw), []).append((big if i is None else i, k, n))
    lines = list(places)
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {x: grams(x) for x in lines}
    for a in lines:
        for b in lines:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    keep = {}
    for x in lines:
        keep[find(x)] = min([keep.get(find(x), (big, big, big)), *places[x]])
    out = []
    for n, (i, t) in enumerate(pairs):
        kept = [raw for k, raw in enumerate((t or "").split("\n")) if len(raw.strip(" ")) < least or keep[find(norm(raw))][:2] == (big if i is None else i, k)]
        out.append((i, None if t is None else "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    pool = [" ".join(word() for _ in range(r.randint(4, 40))) for _ in range(60)]
    common = "this line is in very many documents indeed"

    def vary(line):
        w = line.split()
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = word()
        return r.choice([" ", "  "]).join(w).title() if r.random() < 0.3 else " ".join(w)

    pairs = [(i, "\n".join([vary(r.choice(pool)) for _ in range(r.randint(0, 6))] + r.choice([[], [common], ["", "short"]]))) for i in range(120)]
    pairs += [(500, None), (501, ""), (502, "\n\n"), (503, "é" * 60_000), (504, "é" * 60_000 + "\n" + common), (None, common), (505, "one word only in this line\nONE word only  in this line")]
    got = dedup_lines(docs(spark, pairs).repartition(3)).collect()
    assert sorted(((x["doc_id"], x["text"]) for x in got), key=repr) == brute(pairs)
    by = {x["doc_id"]: x for x in got}
    assert by[505]["_n_lines"] == 2 and by[505]["_n_removed"] == 1 and by[500]["_n_lines"] == 0
    assert dedup_lines(docs(spark, {})).count() == 0


def test_hot_band_without_links(spark):
    """Many lines share half of their words: work must not take all pairs, and must find the links."""
    r = random.Random(7)
    shared = " ".join(f"common{i}" for i in range(12))
    own = [" ".join("".join(r.choice("klmnopqrst") for _ in range(7)) for _ in range(12)) for _ in range(80)]
    lines = [shared + " " + o for o in own] + [shared + " " + own[i] + " x" for i in (5, 50)]
    pairs = list(enumerate(lines))
    got = dedup_lines(docs(spark, pairs)).collect()
    assert sorted(((x["doc_id"], x["text"]) for x in got), key=repr) == brute(pairs)


def test_recall_in_a_templated_group(spark):
    """Lines of one template are just below the threshold (0.75), and each has one true partner."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(11))
    template = [word() for _ in range(36)]
    lines = []
    for _ in range(200):
        own = template + [word() for _ in range(6)]
        lines += [" ".join(own), " ".join([*own, word()])]
    r.shuffle(lines)
    pairs = list(enumerate(lines))
    got = dedup_lines(docs(spark, pairs)).collect()
    expected = brute(pairs)
    assert sum(t == "" for _, t in expected) == 200
    assert sorted(((x["doc_id"], x["text"]) for x in got), key=repr) == expected


def test_lines_without_blanks(spark):
    """URLs and CJK lines are compared as a whole: here every shingle of 12 characters counts."""
    r = random.Random(12)
    cjk = lambda n: "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))
    tail = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789/-") for _ in range(n))
    lines = ["https://www.alpha.example/articles/one.html", "https://www.beta.org/other/page?id=77"]
    for _ in range(12):
        start, url = cjk(12), tail(150)
        lines += [start + cjk(40), start + cjk(40), "https://www." + url, "https://www." + url + "?a", "https://www." + tail(60)]
        text = cjk(120)
        lines += [text, text[:-1] + "\u4dff", text[:60] + cjk(60)]
    r.shuffle(lines)
    sets = [{x[i : i + 12] for i in range(len(x) - 11)} for x in lines]
    near = [[k for k in range(n) if len(sets[n] & sets[k]) >= 0.8 * len(sets[n] | sets[k])] for n in range(len(lines))]
    expected = {n for n in range(len(lines)) if near[n]}
    assert len(expected) == 24
    got = dedup_lines(docs(spark, list(enumerate(lines)))).collect()
    assert {x["doc_id"] for x in got if x["_n_removed"]} == expected


def test_prefix_filter_finds_every_pair_once(spark):
    """Sets of one template, of many sizes and of small universes: no pair from 0.8 on is missed or met twice."""
    r = random.Random(13)
    template = r.sample(range(10**6), 60)
    sets = [set(template) | {r.randrange(10**6) for _ in range(r.randint(0, 20))} for _ in range(60)]
    sets += [set(r.sample(range(24), r.randint(1, 24))) for _ in range(80)]
    sets += [{*x, -5} for x in sets[::7]]
    root = [k % 50 for k in range(len(sets))]
    rows = spark.createDataFrame([(k, sorted(x)) for k, x in enumerate(sets)], "lid long, hashes array<int>")
    lines = spark.createDataFrame(list(enumerate(root)), "lid long, root long")
    got = [(min(x), max(x)) for x in prefix_pairs(lines, rows, 0.8).collect()]
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    wanted = {(a, b) for b in range(len(sets)) for a in range(b) if root[a] != root[b] and near(sets[a], sets[b])}
    assert len(got) == len(set(got)) and wanted <= set(got) and len(wanted) > 100


def test_flags_miss_no_key(spark):
    keys = ["xxhash64(id) as id", "cast(null as long) as proof", "cast(id % 7 as int) as pos"]
    rows, wanted = spark.range(60_000).selectExpr(*keys), spark.range(0, 60_000, 40).selectExpr(*keys)
    out = flagged(rows, wanted, ["id", "proof", "pos"], "may")
    assert out.columns == ["id", "proof", "pos", "may"] and out.count() == 60_000
    found = out.where("may").select("id")
    assert wanted.select("id").subtract(found).isEmpty() and found.count() < 1500 + 3000
    assert flagged(rows, wanted.limit(0), ["id", "proof", "pos"], "may").where("may").isEmpty()


def test_texts_that_stay_and_texts_that_travel(spark, monkeypatch):
    """Beyond what a broadcast holds, texts that lose lines are joined and the others passed on."""
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    common = "this line is in very many documents indeed"
    pairs = [(i, f"line of its own with the number {i * 7919} and {i * 104729}\n" + common * (i % 2)) for i in range(40)]
    pairs += [(90, None), (91, ""), (None, common), (92, common), (92, common)]
    table = docs(spark, pairs)
    got = dedup_lines(table)
    assert got.columns == [*table.columns, "_n_lines", "_n_removed"]
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=repr) == brute(pairs)


def test_shuffle_files_go_while_it_runs(spark):
    """Of all that line dedup shuffles, only what its result still needs is on disk when it returns."""
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    pairs = [(i, "\n".join(" ".join(word() for _ in range(12)) for _ in range(10))) for i in range(2000)]
    pairs += [(i + 2000, t + " x") for i, t in pairs]
    folders = [Path(str(d)) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    size = lambda: sum(p.stat().st_size for d in folders for p in d.rglob("shuffle_*") if p.exists())
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = size()
    got = dedup_lines(docs(spark, pairs))
    time.sleep(2)
    assert size() - before < 1_000_000
    assert got.where("_n_removed > 0").count() > 1900


def test_similar_lines_share_a_small_key_or_stay_unsettled(spark):
    """Of sets of many sizes, some in groups of more than SMALL_BAND, each similar pair of two roots is met."""
    r = random.Random(16)
    sets = []
    for size in (1, 2, 3, 4, 5, 9, 15, 16, 17, 20, 31, 33, 60, 300):
        for copies in (2, 3, 12):
            base = r.sample(range(10**9), size)
            for _ in range(copies):
                most = max(0, round(size * 0.1))
                sets.append(set(base[r.randint(0, most) :]) | {r.randrange(10**9) for _ in range(r.randint(0, most + 1))})
    sketches = spark.createDataFrame([(k, sorted(x)[: line_dedup.SKETCH]) for k, x in enumerate(sets)], "lid long, low array<int>")
    near = neighbours(spark.createDataFrame([(k, k) for k in range(len(sets))], "lid long, root long"), sketches)
    rest = {x["lid"] for x in unsettled(near, spark.createDataFrame([], "node long, root long")).collect()}
    keys = {}
    for x in near.where(f"size <= {line_dedup.SMALL_BAND}").collect():
        keys.setdefault(x["lid"], set()).add(x["key"])
    wanted = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    met = [keys.get(a, set()) & keys.get(b, set()) or {a, b} <= rest for a, b in wanted]
    assert len(wanted) > 100 and all(met) and any({a, b} <= rest for a, b in wanted) and len(rest) <= 14 * 12


def test_lines_of_one_phrase_do_not_reach_the_prefix_filter(spark, monkeypatch):
    """A phrase that many unlike lines hold makes large bands of them; their sketches tell that none has a partner."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    lines = [" ".join([*(word() for _ in range(6)), "common words of them", *(word() for _ in range(6))]) for _ in range(600)]
    calls = []
    monkeypatch.setattr(line_dedup, "prefix_pairs", lambda *args: calls.append(1) or prefix_pairs(*args))
    pairs = [*enumerate(lines), (600, lines[7] + " x"), (601, lines[300] + " x")]
    got = dedup_lines(docs(spark, pairs)).where("_n_removed > 0").select("doc_id").collect()
    assert sorted(x[0] for x in got) == [600, 601] and not calls


def test_shingles_of_bytes_and_of_characters(spark):
    r = random.Random(18)
    lines = ["".join(r.choice(letters) for _ in range(n)) for letters in ("abc ", "aé", "a\u65e5\U0001f600") for n in (1, 11, 12, 13, 47, 48, 59, 60, 200)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")
    got = {x["k"]: x["found"] for x in rows.select("k", shingles(rows["line"]).alias("found")).collect()}
    grammed = spark.createDataFrame([(k, g) for k, x in enumerate(lines) for g in grams(x)], "k int, g string")
    expected = {x["k"]: sorted(x["h"]) for x in grammed.groupBy("k").agg(F.collect_set(F.hash("g")).alias("h")).collect()}
    assert got == expected


def test_bitmaps_lose_no_pair_and_spare_comparisons(spark):
    """Of pairs of sets, those from 0.8 on are found wherever their hashes lie, and few that are far below are compared."""
    r = random.Random(19)
    sets, edges = [], []

    def pair(x, y):
        edges.append((len(sets) + 1, len(sets)))
        sets.extend((set(x), set(y)))

    for n in (1, 5, 40, 400, 3000):
        for share in (0.0, 0.5, 0.8, 0.88, 0.9, 1.0):
            common = r.sample(range(-(2**31), 2**31), round(n * share))
            own = lambda: r.sample(range(-(2**31), 2**31), n - len(common))
            pair(common + own(), common + own())
    common = r.sample(range(10**9), 200)
    pair([*common, *range(-100, -80)], [*common, *range(-80, -60)])  # no smallest hash in common, similarity 0.83
    rows = spark.createDataFrame([(k, sorted(x)) for k, x in enumerate(sets)], "lid long, hashes array<int>")
    pairs, maps = spark.createDataFrame(edges, "a long, b long"), bitmaps(rows)
    near = {(a, b) for a, b in edges if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {tuple(x) for x in similar(pairs, rows, maps, 0.8).collect()} == near and (len(sets) - 1, len(sets) - 2) in near
    compared = {tuple(x) for x in plausible(pairs, maps, 0.8).collect()}
    assert near <= compared and all(len(sets[a] & sets[b]) > 0.6 * len(sets[a] | sets[b]) or len(sets[a]) > 1024 for a, b in compared)


def test_only_lines_are_kept(spark, monkeypatch):
    """Sets of shingles take many times the bytes of their lines; no frame that is kept has them."""
    r = random.Random(20)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    shared = " ".join(f"common{i}" for i in range(12))
    own = [" ".join(word() for _ in range(12)) for _ in range(40)]
    pairs = list(enumerate([shared + " " + o for o in own] + [shared + " " + o + " x" for o in own[::4]]))
    kept = []
    for name in ("cut", "compact"):
        monkeypatch.setattr(line_dedup, name, lambda df, f=getattr(line_dedup, name): kept.append(df.columns) or f(df))
    got = dedup_lines(docs(spark, pairs)).collect()
    assert sorted(((x["doc_id"], x["text"]) for x in got), key=repr) == brute(pairs)
    assert kept and not any("hashes" in columns or "line" in columns for columns in kept)
    lines = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(pairs)], "lid long, line string")
    sets = spark.createDataFrame([(k, [hash(g) % 2**31 for g in sorted(grams(x))]) for k, (_, x) in enumerate(pairs)], "lid long, hashes array<int>")
    roots = lines.select("lid", "lid").toDF("lid", "root")
    found = [{tuple(sorted(x)) for x in prefix_pairs(roots, kind, 0.8).collect()} for kind in (lines, sets)]
    assert all(len(x) >= 10 and {(4 * k, 40 + k) for k in range(10)} <= x for x in found)
