"""Benchmark decontamination by template canonicalisation and slot consistency."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm.common import NO_ID, broadcast_if_small, fresh, in_python, quoted, tagged
from repolith.llm.superkmers import _C1, _C2, identified, mix, span_hash, window_starts, word_hashes

#: Words of a template window; an item with fewer words is one window. Items of fewer than WHOLE_LINE words can not be told
#: from chance within a text, so they are looked for as whole lines.
WIDTH, WHOLE_LINE = 8, 4
#: A document leaks an item when windows in consistent places cover this share of the item's, or so many words in a row.
COVERAGE, RUN = 0.5, 20
#: Bits of the filter of benchmark windows (a fixed 2 MB, whatever the benchmark's size).
FILTER_BITS = 24
# Units of measure that are one slot type.
UNITS = (
    "mm cm m km inch inches in. ft feet foot yard yards mile miles mg g kg lb lbs pound pounds oz ton tons tonnes ml l litre litres "
    "liter liters gallon gallons s sec second seconds min minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur percent % degrees °c °f mph kmh km/h watt watts volt volts"
).split()

#: The kind of a name among slot types; ways to tell names.
NAMED, READINGS = 2, 3
NUMBER, NAME, UNIT = (np.uint64(0xF00000000000000 + k) for k in (1, 2, 3))
_PUNCTUATION = b"\"'()[]{}<>.,;:!?*_`~"
_CHUNK = 2 << 20


def template(texts: list[bytes]):
    """(token hashes, slot type of each token) under each of READINGS, tokens, first token of each text.

    Tokens lose ASCII punctuation and case. A token with a digit is a number; a unit of measure is a unit. What is a name
    depends on the reading: a capitalised word that does not begin a sentence, any capitalised word, or none, so that a
    change of case or a quotation within a sentence leaves one reading that fits. All of a type share one hash.
    """
    first = [0]
    raw: list[bytes] = []
    for t in texts:
        raw += t.split()
        first.append(len(raw))
    first = np.array(first)
    if not raw:
        return [(np.empty(0, np.uint64), np.empty(0, np.int8))] * READINGS, [], first
    buffer = b" ".join(raw) + b" "
    data = np.frombuffer(buffer, np.uint8)
    gap = np.flatnonzero(data == 32)
    begin = np.append(0, gap[:-1] + 1)
    stop = np.isin(data[gap - 1], np.frombuffer(b".!?:", np.uint8))
    opens = np.append(True, stop[:-1])
    opens[first[:-1][first[:-1] < len(raw)]] = True
    digit = np.add.reduceat(((data >= 48) & (data <= 57)).astype(np.int32), begin) > 0
    lower = buffer.decode(errors="replace").lower().encode()
    bare = lower.translate(None, _PUNCTUATION)
    words = bare.split(b" ")[: len(raw)]
    low = np.frombuffer(lower, np.uint8)
    low_begin = np.append(0, np.flatnonzero(low == 32)[:-1] + 1)
    capital = (data[begin] >= 65) & (data[begin] <= 90)
    for i in np.flatnonzero((data[begin] >= 0xC3) & (data[begin] <= 0xD5)).tolist():  # capitals of other letters have two bytes
        at, to = begin[i], low_begin[i]
        capital[i] = buffer[at : at + 2] != lower[to : to + 2]
    data = np.frombuffer(bare, np.uint8)
    gap = np.flatnonzero(data == 32)
    begin = np.append(0, gap[:-1] + 1)
    plain = word_hashes(data, begin, gap, _C1)
    unit = np.isin(plain, _UNIT_HASHES)
    out = []
    for names in (capital & ~opens, capital, np.zeros(len(raw), bool)):
        kind, hashes = np.zeros(len(raw), np.int8), plain.copy()
        for k, (held, value) in enumerate(((digit, NUMBER), (names & ~digit & ~unit, NAME), (unit & ~digit, UNIT)), 1):
            kind[held], hashes[held] = k, value
        out.append((hashes, kind))
    return out, words, first


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(b" ".join(u.encode() for u in UNITS) + b" ", np.uint8)
    gap = np.flatnonzero(data == 32)
    return word_hashes(data, np.append(0, gap[:-1] + 1), gap, _C1)


_UNIT_HASHES = _unit_hashes()


def _windows(widths: tuple[int, ...] | None, width: int, least: int, bits: np.ndarray | None):
    """(window, id, proof, reading, at, slots) of texts (id, proof, text).

    Of benchmark items (bits is None) each window, ``width`` words or the whole item, under each reading; of documents,
    the windows of the given widths that the filter may hold, under the first reading that gives them. slots: places in the window of typed tokens, the tokens and their types.
    """

    def run(batches):
        for batch in batches:
            ids, proofs = (np.array(batch.column(i).to_pylist(), np.int64) for i in (0, 1))
            texts = [t.as_py() or b"" for t in batch.column(2)]
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= _CHUNK):
                    size += len(texts[j])
                    j += 1
                yield from _some(ids[i:j], proofs[i:j], *template(texts[i:j]), widths, width, least, bits)
                i = j

    return run


def _some(ids, proofs, readings, tokens, first, widths, width, least, bits):
    size = np.diff(first)
    for w in widths or sorted({int(min(width, n)) for n in size if n >= least}):
        every, plain = window_starts(first, w), None
        for reading, (hashes, kind) in enumerate(readings):
            value = mix(span_hash(hashes, w, _C2) + np.uint64(w))
            at, typed = every, np.append(0, np.cumsum(kind > 0))
            for k in at[typed[at + w] - typed[at] == w].tolist():  # without a word of its own a template would match anything: its fillers count
                value[k] = xxhash.xxh64_intdigest(b" ".join(tokens[k : k + w]), w)
            if bits is None:
                doc = np.searchsorted(first, at, "right") - 1
                at = at[np.minimum(size[doc], width) == w]
            elif len(at):
                if plain is not None:  # as under the first reading: once is enough
                    at = at[value[at] != plain[at]]
                place = (value[at] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                at = at[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
            plain = value if plain is None else plain
            if not len(at):
                continue
            doc = np.searchsorted(first, at, "right") - 1
            slots = [
                [(k - a, tokens[k].decode(errors="replace"), int(kind[k])) for k in range(a, a + w) if kind[k]] if typed[a + w] > typed[a] else []
                for a in at.tolist()
            ]
            columns = [pa.array(value[at].view(np.int64)), pa.array(ids[doc]), pa.array(proofs[doc]), pa.array(np.full(len(at), reading, np.int32)), pa.array((at - first[doc]).astype(np.int32))]
            slots = pa.array([[{"place": p, "token": t, "kind": k} for p, t, k in s] for s in slots], pa.list_(pa.struct([("place", pa.int32()), ("token", pa.string()), ("kind", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*columns, slots], ["window", "id", "proof", "reading", "at", "slots"])


_SCHEMA = "window long, id long, proof long, reading int, at int, slots array<struct<place int, token string, kind int>>"


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: int = WHOLE_LINE) -> DataFrame:
    """(id, proof, item_id, windows, coverage, words) of documents and items that share template windows.

    Windows of both sides are joined by hash. Those of documents pass a filter of fixed size first, so that few
    of them travel. Alignments (document place minus item place) are looked at under each of the item's readings on its
    own, and the reading that fits best counts. A window without slots, or whose fillers are the item's, always counts.
    Others count if each number and unit of the item meets one filler within the window (equal values may be so by
    chance), and each name of the item meets one name in the whole alignment, under this and the first reading. The coverage is the share of the item's
    distinct windows that count; words is the longest run of words that they cover in one alignment.
    """
    items = benchmark.where("text is not null").groupBy("item_id", "text").agg(F.lit(0).cast("long").alias("proof"))
    items = items.select(F.col("item_id").cast("long").alias("id"), "proof", F.col("text").cast("binary").alias("text"))
    items = in_python(items, _windows(None, width, least, None), _SCHEMA)
    place = F.shiftrightunsigned("window", 64 - FILTER_BITS)
    byte = F.shiftright(place, 3)
    used = items.groupBy(byte.alias("byte")).agg(F.bit_or(F.expr(f"1 << cast(shiftrightunsigned(window, {64 - FILTER_BITS}) & 7 as int)")).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in used.collect():  # at most 2**21 rows
        bits[r["byte"]] = r["bits"]
    # Items of fewer words than a window are matched at their own length: at most ``width`` lengths.
    lengths = F.size(F.split(F.trim(F.regexp_replace(F.col("text").cast("string"), r"[\x20\x09-\x0D]+", " ")), " "))
    found = benchmark.where("text is not null").select(F.least(lengths, F.lit(width)).alias("w")).where(F.col("w") >= least).distinct().collect()
    widths = tuple(sorted(r["w"] for r in found))
    if not widths:
        return items.select("id", "proof", F.col("id").alias("item_id"), F.lit(0).alias("windows"), F.lit(0.0).alias("coverage"), F.lit(0).alias("words")).where("false")
    here = in_python(identified(docs), _windows(widths, width, least, bits), _SCHEMA)
    # A window that an item has at many places counts once, at the first, so equal places never meet as pairs.
    first = F.min(F.struct("at", "slots")).alias("first")
    there = items.groupBy("window", F.col("id").alias("item_id"), "reading").agg(first)
    sizes = there.groupBy("item_id", "reading").agg(F.count("*").alias("n_item"))
    there = there.join(sizes, ["item_id", "reading"]).select("window", "item_id", "reading", F.col("first.at").alias("item_at"), "n_item", F.col("first.slots").alias("item_slots"))
    both = here.drop("reading").join(there, "window")
    zipped = F.arrays_zip(F.col("slots.token").alias("d"), F.col("item_slots.token").alias("i"), F.col("slots.kind").alias("k"))
    pairs = lambda wanted: F.array_distinct(F.transform(F.filter("pairs", wanted), lambda s: F.struct(s["d"].alias("d"), s["i"].alias("i"))))
    both = both.withColumn("pairs", zipped)
    both = both.withColumns({"names": pairs(lambda s: s["k"] == NAMED), "values": pairs(lambda s: s["k"] != NAMED), "same": F.forall("pairs", lambda s: s["d"] == s["i"])})
    function = lambda c: F.size(F.array_distinct(f"{c}.i")) == F.size(c)
    keys = ["id", "proof", "item_id"]
    own = [*keys, "reading"]
    under = lambda r, x: F.when(F.col("reading") == r, x)
    seen = lambda r: F.struct(
        F.lit(r).alias("reading"),
        F.array_distinct(F.flatten(F.collect_set(under(r, F.col("names"))))).alias("names"),
        F.collect_set(under(r, F.when(function("values"), F.col("item_at")))).alias("fitting"),
        F.collect_set(under(r, F.when(F.col("same"), F.col("item_at")))).alias("same"),
        F.max(under(r, F.col("n_item"))).alias("n_item"),
    )
    aligned = both.groupBy(*keys, (F.col("at") - F.col("item_at")).alias("shift")).agg(F.array(*map(seen, range(READINGS))).alias("all"))
    agree = F.expr("size(array_distinct(all[0].names.i)) = size(all[0].names)")
    aligned = aligned.select(*keys, agree.alias("agree"), F.inline("all"))
    aligned = aligned.withColumn("places", F.sort_array(F.when(F.col("agree") & function("names"), F.col("fitting")).otherwise(F.col("same")))).where("size(places) > 0")
    longest = F.expr(
        "aggregate(places, struct(0 as best, 0 as run, -2 as last), (s, p) -> struct("
        "greatest(s.best, if(p = s.last + 1, s.run + 1, 1)) as best, if(p = s.last + 1, s.run + 1, 1) as run, p as last), s -> s.best)"
    )
    covered = aligned.withColumn("run", longest).groupBy(*own).agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("windows"), F.max("n_item").alias("n_item"), F.max("run").alias("run")
    )
    best = F.max(F.struct((F.col("windows") / F.col("n_item")).alias("coverage"), "windows")).alias("best")
    best = covered.groupBy(*keys).agg(best, (F.max("run") + (width - 1)).alias("words"))
    return best.select(*keys, "best.windows", "best.coverage", "words")


def line_key(text):
    """A line without case, ASCII punctuation and extra blanks."""
    bare = F.regexp_replace(F.lower(text), r"""["'()\[\]{}<>.,;:!?*_`~]+""", "")
    return F.trim(F.regexp_replace(bare, r"[\x20\x09-\x0D]+", " "))


def whole_lines(docs: DataFrame, benchmark: DataFrame, least: int = WHOLE_LINE) -> DataFrame:
    """(id, proof, item_id) of documents of which a line is an item of fewer than ``least`` words."""
    short = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), line_key(F.col("text")).alias("key"))
    short = short.where((F.col("key") != "") & (F.size(F.split("key", " ")) < least)).distinct()
    short = broadcast_if_small(short)
    lines = identified(docs).select("id", "proof", F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line"))
    lines = lines.select("id", "proof", line_key(F.col("line")).alias("key"))
    return lines.join(short, "key").select("id", "proof", "item_id").distinct()


def _leaked(coverage: float, width: int = WIDTH):
    return (F.col("coverage") >= coverage) | (F.col("words") >= max(RUN, width))


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items (items leaked), item_id (most covered, then smallest),
    coverage (of that item, 0 if no window matches), proof.

    Null and empty texts are clean; so is every document if the benchmark is empty. Items of fewer than
    WHOLE_LINE words are leaked by a document of which they are a line. Rows that repeat a doc_id are judged by
    their own text. Other columns are ignored.
    """
    short = whole_lines(docs, benchmark).select("id", "proof", "item_id", F.lit(1).alias("windows"), F.lit(1.0).alias("coverage"), F.lit(1).alias("words"))
    found = leaks(docs, benchmark, width).union(short)
    best = F.max_by("item_id", F.struct("coverage", -F.col("item_id"))).alias("item_id")
    found = found.groupBy("id", "proof").agg(F.count(F.when(_leaked(coverage, width), 1)).alias("n_items"), best, F.max("coverage").alias("coverage"))
    rows = identified(docs).select("id", "proof").join(found, ["id", "proof"], "left")
    return rows.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        F.coalesce(F.col("n_items") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "item_id",
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        "proof",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents, all columns, that leak no item."""
    leaked = leaks(docs, benchmark).where(_leaked(coverage)).select("id", "proof").distinct()
    leaked = leaked.union(whole_lines(docs, benchmark).select("id", "proof")).distinct()
    id_, proof = fresh(docs.columns, "_id", "_proof")
    leaked = broadcast_if_small(leaked.select(F.col("id").alias(id_), F.col("proof").alias(proof)))
    return tagged(docs, id_, proof).join(leaked, [id_, proof], "left_anti").select(*quoted(docs.columns))
