import re

from repolith.llm.decontamination import UNITS, contamination, decontaminated
from tests.llm.data import docs, rows

ITEMS = [
    (1, "Alice met Bob and gave Bob 12 apples for 3 dollars in town before the long walk back home"),
    (2, "what is the capital city of that northern country with many lakes and islands in it"),
    (3, "too short item"),
    (4, "five words make an item"),
    (5, None),
    (2, "what is the capital city of that northern country with many lakes and islands in it"),
]


def tokens(text, names):
    """Tokens as (word, None) or (type, filler). names: which capitalised words are names ("inside" sentences, "all", "none")."""
    out, opens = [], True
    for raw in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        word = raw.lower().translate(str.maketrans("", "", "\"'()[]{}<>.,;:!?*_`~"))
        if re.search("[0-9]", word):
            out.append(("#", word))
        elif word in UNITS:
            out.append(("unit", word))
        elif raw[0] != raw[0].lower() and (names == "all" or names == "inside" and not opens):
            out.append(("name", word))
        else:
            out.append((word, None))
        opens = raw[-1] in ".!?:"
    return out


def share(d, q, width):
    """Largest share, over the readings q of the item, of its windows that the document has in consistent places."""
    w, best = min(width, len(q[0])), 0
    aligned = {}
    for n, item in enumerate(q):
        places = {}
        for b in range(len(item) - w + 1):
            places.setdefault(tuple(x[0] for x in item[b : b + w]), []).append(b)
        for reading in d:
            words = [x[0] for x in reading]
            for a in range(len(words) - w + 1):
                for b in places.get(tuple(words[a : a + w]), ()):
                    hits = aligned.setdefault((n, a - b), [])
                    hits.append((b, {(x, y[1]) for x, y in zip(reading[a : a + w], item[b : b + w]) if y[1] is not None}))

    def agree(n, shift):
        fill = set().union(*[f for _, f in aligned.get((n, shift), [])])
        return len({x for x, _ in fill}) == len(fill) == len({y for _, y in fill})

    for n in range(len(q)):
        places = {b for (m, shift), hits in aligned.items() if m == n and agree(n, shift) and agree(0, shift) for b, _ in hits}
        best = max(best, len(places) / (len(q[0]) - w + 1))
    return best


def brute(pairs, items, width=8, least=4, coverage=0.5):
    out = []
    for i, text in pairs:
        d, leaked = [tokens(text, n) for n in ("inside", "all", "none")], set()
        for item, t in items:
            if t is None:
                continue
            if len(t.split()) < least:
                plain = lambda x: [re.sub(r"""["'()\[\]{}<>.,;:!?*_`~]""", "", w) for w in x.lower().split()]
                if any(plain(line) == plain(t) for line in (text or "").split("\n")):
                    leaked.add(item)
            elif share(d, [tokens(t, n) for n in ("inside", "all", "none")], width) >= coverage:
                leaked.add(item)
        out.append((i, bool(leaked), len(leaked)))
    return sorted(out, key=repr)


def test_contamination(spark):
    long = "filler words here " * 3000
    pairs = [
        (1, long + ITEMS[0][1] + " " + long),
        (2, "So: Carol met Dave and gave Dave 99 apples for 7 euros in town before the long walk back home."),
        (3, "Carol met Dave and gave Erin 99 apples for 7 euros in town before the long walk back home"),
        (4, "WHAT is the capital, city of that northern country"),
        (5, "He asked: what is the capital city of that northern country with many lakes and (islands) in it!"),
        (6, None),
        (7, ""),
        (8, "too short item"),
        (9, "see: five words make an item here"),
        (None, ITEMS[1][1]),
        (10, "clean text about nothing"),
        (10, ITEMS[1][1]),
        (11, ITEMS[0][1] + " " + ITEMS[1][1]),
    ]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contamination(docs(spark, pairs), items)
    assert rows(got, "doc_id", "contaminated", "n_items") == brute(pairs, ITEMS)
    assert {r["doc_id"] for r in got.where("contaminated").collect()} == {1, 2, 5, 8, 9, None, 10, 11}
    kept = decontaminated(docs(spark, pairs), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7, 10]
    assert kept.columns == docs(spark, {}).columns
    assert contamination(docs(spark, {}), items).count() == 0
    assert contamination(docs(spark, pairs), items.where("false")).where("contaminated").count() == 0
    assert decontaminated(docs(spark, pairs), items.where("item_id = 3")).count() == len(pairs) - 1


def test_conflicts_and_excerpts(spark):
    plain = " ".join(f"{a}{b}" for a in ("red", "blue", "green", "brown", "white") for b in ("stone", "leaf", "river", "cloud", "field", "road"))
    item = f"when Alice had 5 pears and then Bob took 5 plums from Alice at noon {plain} while Alice and Bob ate the rest of them at home"
    short = "they say that one box holds 3 pens and the other box holds 4 pens so count all pens"
    items = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    words = item.split()
    pairs = [
        (1, item.replace("5 plums", "6 plums")),
        (2, item.replace("from Alice", "from Carol")),
        (3, short.replace("3", "6").replace("4", "6")),
        (4, item.replace("5 pears", "7 pears").replace("5 plums", "9 plums")),
        (5, "so it goes " + " ".join(words[14:38]) + " and no more"),
        (6, "so it goes " + " ".join(words[14:32]) + " and no more"),
        (7, "nothing of this is in any of those items at all"),
        (8, item),
    ]
    got = contamination(docs(spark, pairs), items)
    assert {r["doc_id"] for r in got.where("contaminated").collect()} == {1, 2, 3, 4, 5, 8}
    assert {r["doc_id"] for r in decontaminated(docs(spark, pairs), items).collect()} == {6, 7}


def test_number_tables_and_repeated_rows(spark):
    """Windows of slots only are matched by their fillers, so tables of numbers do not meet each other everywhere."""
    table = " ".join(str(i % 10) for i in range(30_000))
    items = [(1, " ".join(str(i * i) for i in range(40))), (2, "0 " * 300), (3, "Pick 4 of 9 cards")]
    pairs = [(1, table), (2, "zero " + "0 " * 20_000), (3, items[0][1] + " end"), (4, "text " + items[2][1]), (4, "text " + items[2][1]), (5, None)]
    got = contamination(docs(spark, pairs), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "contaminated") == [(1, False), (2, True), (3, True), (4, True), (4, True), (5, False)]


def test_case_and_place_do_not_hide_an_item(spark):
    items = [
        (1, "Who painted the ceiling of that chapel"),
        (2, "Alice met Bob and gave Bob 12 apples for 3 dollars in town before the long walk back home at night"),
        (3, "Pick 4 of 9 cards"),
        (4, "Él vio Ávila. École of five words more and then some"),
    ]
    pairs = [
        (1, "question Who painted the ceiling of that chapel"),
        (2, "he asked: who painted the ceiling of that chapel? nobody knew"),
        (3, items[1][1].lower()),
        (4, items[1][1].upper()),
        (5, "They say alice met bob and gave bob 15 apples for 4 dollars in town before the long walk back home at night"),
        (6, "He wrote Carol met Dave and gave Dave 99 apples for 7 euros in town before the long walk back home at night"),
        (7, "to pick 4 of 9 cards is easy"),
        (8, "And Pick 5 of 7 cards"),
        (9, "él vio ávila. école of five words more and then some"),
        (10, "Carol met Dave and gave Erin 99 apples for 7 euros in town by day"),
        (11, "Who painted the ceiling of this chapel"),
        (12, "Pick any of those cards"),
        (13, "who then painted the ceiling of that chapel"),
    ]
    got = contamination(docs(spark, pairs), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "contaminated", "n_items") == brute(pairs, items)
    assert {r["doc_id"]: r["item_id"] for r in got.where("contaminated").collect()} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2, 7: 3, 8: 3, 9: 4}
    assert {r["coverage"] for r in got.where("doc_id in (3, 4)").collect()} == {1.0}
