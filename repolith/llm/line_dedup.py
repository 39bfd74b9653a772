"""Fuzzy line dedup by MinHash (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm.common import BROADCAST_ROWS, broadcast_if_small, compact, components, cut, fresh, quoted, saved, swept, tagged

#: Characters of a shingle, one at every place of a line; lines with fewer than LEAST_CHARS are left alone.
SHINGLE, LEAST_CHARS = 12, 20
#: Places of a line that are cut out at once, so that the work stays in proportion to the length of a line.
STRETCH = 48
#: Jaccard similarity from which lines are linked.
SIMILARITY = 0.8
#: Hashes of a signature. Bands are its pairs.
SIGNATURE = 4
#: Smallest hashes of a line's set, whose keys tell which lines of open bands meet.
SKETCH = 32
#: Keys that similar lines share at least: hashes that follow each other in both sketches, and in sketches of fewer than SHORT
#: hashes each one (up to twice as many: both kinds). Random pairs of similarity 0.8 with 40 to 2000 shingles shared 20 at the
#: median, and none of 140,000 less than 4; of up to 32 shingles, every pair must share 3, or all if it has fewer.
NEIGHBOURS, SHORT = 3, 16
#: Keys of at most this many lines have all pairs of different components verified; lines that share larger ones use finer
#: bands, each three of the FINER smallest hashes, and then the prefix filter.
SMALL_BAND, FINER = 8, 6
#: 64-bit words of a line's bitmap; longer lines of one shingle that a block of the prefix filter's join takes.
BITMAP, BLOCK = 16, 1000
#: Bits of the filter for wanted lines: those of one of Spark's bitmaps, of 4 KB; a line's share; bitmaps at most (16 MB).
PIECE, BITS, PIECES = 32768, 64, 4096


def normalised(line: Column) -> Column:
    """A lower-case line with runs of white space as one blank."""
    odd = line.contains("  ")
    for c in "\t\r\x0b\x0c":
        odd = odd | line.contains(c)
    return F.trim(F.when(odd, F.regexp_replace(line, r"[ \t\r\x0B\f]+", " ")).otherwise(line))


def texts_of(docs: DataFrame) -> DataFrame:
    """(id, proof, raw): the lower-case lines of whole texts."""
    rows = tagged(docs.select("doc_id", "text"), "id", "proof")
    return rows.select("id", "proof", F.split(F.lower(F.coalesce("text", F.lit(""))), "\n").alias("raw"))


def lines_of(docs: DataFrame, least_chars: int) -> DataFrame:
    """(id, proof, pos, line): the lines of whole texts, normalised. Short and blank ones are left out."""
    lines = texts_of(docs).select("id", "proof", F.posexplode("raw").alias("pos", "raw"))
    lines = lines.where(F.char_length(F.trim("raw")) >= least_chars)
    return lines.select("id", "proof", "pos", normalised(F.col("raw")).alias("line"))


def keys_of(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def shingles(line: Column, width: int = SHINGLE) -> Column:
    """Sorted distinct 32-bit hashes of all ``width`` characters in a row (of a shorter line, the line)."""
    stretches = F.regexp_extract_all(line, F.lit("(?s)(?=(.{1,%d})).{1,%d}" % (STRETCH + width - 1, STRETCH)), F.lit(1))
    places = lambda x: F.sequence(F.lit(1), F.greatest(F.char_length(x) - (width - 1), F.lit(1)))
    cut_out = lambda x: F.transform(places(x), lambda i: F.hash(F.substring(x, i, width)))
    # The last stretch of a longer line may be too short for a shingle of its own.
    whole = F.filter(stretches, lambda x, i: (i == 0) | (F.char_length(x) >= width))
    # Where all characters are bytes, a place is found at once and no stretches are needed; the hashes are the same.
    ascii_ = (line != "") & (F.octet_length(line) == F.char_length(line))
    found = F.when(ascii_, F.transform(F.array(line.cast("binary")), cut_out)).otherwise(F.transform(whole, cut_out))
    return F.sort_array(F.array_distinct(F.flatten(found)))


def signature(line: Column, size: int, width: int = SHINGLE) -> Column:
    """Half the bits of the ``size`` smallest hashes among the shingles (shorter at the end) that begin at words, and at all places of
    words that are longer: a sample of the line's shingles that its content decides, so like lines have like samples.
    """
    pattern = r"(?s)(?=(.{1,%d}))(?:[^ ]{1,%d}+(?: |\z)|[^ ])" % (width, width)
    found = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
    low = F.slice(F.sort_array(F.array_distinct(F.transform(found, lambda s: F.xxhash64(s)))), 1, size)
    return F.transform(low, lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))


def bands(low: Column, size: int = SIGNATURE) -> Column:
    """Band keys of the ``size`` smallest hashes, a bottom-k MinHash signature: each pair; of one hash, itself."""
    at = lambda i: F.try_element_at(low, F.lit(i))
    pairs = [F.when(at(j).isNotNull(), F.xxhash64(at(i), at(j))) for j in range(2, size + 1) for i in range(1, j)]
    return F.when(F.size(low) == 1, F.array(F.xxhash64(at(1)))).otherwise(F.array_compact(F.array(*pairs)))


def finer_bands(low: Column, size: int = FINER) -> Column:
    """Band keys of three each of the ``size`` smallest hashes."""
    at = lambda i: F.try_element_at(low, F.lit(i))
    threes = [F.when(at(k).isNotNull(), F.xxhash64(at(i), at(j), at(k))) for k in range(3, size + 1) for j in range(2, k) for i in range(1, j)]
    return F.array_compact(F.array(*threes))


def with_hashes(sets: DataFrame) -> DataFrame:
    """(lid, hashes) of ``sets``, which have these columns or lines (lid, line), whose sets are made here.

    Lines take a tenth of the bytes of their sets, so they are kept; rows that are not needed should go before.
    """
    return sets if "hashes" in sets.columns else sets.select("lid", shingles(F.col("line")).alias("hashes"))


def bitmaps(sets: DataFrame) -> DataFrame:
    """(lid, n, b0, b1, ...): size and parity bits of ``sets`` (as of ``with_hashes``): two sets differ in at least as many
    elements as their bitmaps differ in bits."""
    # The inner kind of explode has Spark filter by the size of the sets, and make them twice more for that.
    words = with_hashes(sets).select("lid", F.size("hashes").alias("n"), F.explode_outer("hashes").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    word = F.shiftrightunsigned("h", 6).bitwiseAND(BITMAP - 1)
    parity = [F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0).cast("long")).alias(f"b{k}") for k in range(BITMAP)]
    return words.groupBy("lid").agg(F.first("n").alias("n"), *parity)


def apart(x: str, y: str) -> Column:
    """In how many bits two bitmaps differ, their columns having ``x`` and ``y`` at the end."""
    return sum((F.bit_count(F.col(f"b{k}{x}").bitwiseXOR(F.col(f"b{k}{y}"))) for k in range(BITMAP)), F.lit(0))


def in_common(n: Column, m: Column, similarity: float) -> Column:
    """How many elements sets of n and m elements must have in common to be similar."""
    return (n + m) * (similarity / (1 + similarity)) - 1e-9


def plausible(edges: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) that may be similar by the sizes and bitmaps of ``maps`` (as of ``bitmaps``); no similar one is lost."""
    side = lambda x: maps.select(*(F.col(c).alias(x if c == "lid" else f"{c}_{x}") for c in maps.columns))
    n, m = F.col("n_a"), F.col("n_b")
    both = edges.join(side("a"), "a").join(side("b"), "b").where(F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9)
    return both.where(n + m - apart("_a", "_b") >= 2 * in_common(n, m, similarity)).select("a", "b")


def similar(edges: DataFrame, sets: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose exact Jaccard similarity reaches ``similarity``. sets: as of ``with_hashes``.

    Bitmaps go first, so that few sets travel in vain.
    """
    edges = compact(plausible(edges, maps, similarity))
    swept(edges.sparkSession)
    needed = edges.select(F.explode(F.array("a", "b")).alias("lid")).distinct()
    sets = with_hashes(sets.join(broadcast_if_small(needed), "lid", "left_semi"))
    left = sets.select(F.col("lid").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("lid").alias("b"), F.col("hashes").alias("hb"))
    both = edges.join(left, "a").join(right, "b")
    least = in_common(F.size("ha"), F.size("hb"), similarity)
    return both.where(F.size(F.array_intersect("ha", "hb")) >= least).select("a", "b")


def joined(roots: DataFrame, pairs: DataFrame, sets: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """``roots`` (node, root) with the pairs (a, b) that are similar put into one component."""
    found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(found.union(similar(pairs, sets, maps, similarity)), "a", "b")
    swept(roots.sparkSession)
    return roots


def open_bands(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, size, lid, root) of the bands whose lines are in several components."""
    members = shared.join(roots, F.col("lid") == F.col("node"), "left")
    members = members.select("band", "size", "lid", F.coalesce("root", "lid").alias("root"))
    split = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return members.join(split.select("band"), "band")


def neighbours(lines: DataFrame, sketches: DataFrame) -> DataFrame:
    """(lid, root, few, key, size): the keys that ``lines`` (lid, root) share with lines of other roots, and by how many lines
    in all; few: whether the line has so few hashes that one shared key is enough."""
    n, low = F.size("low"), F.col("low")
    after = F.zip_with(F.slice(low, F.lit(1), n - 1), F.slice(low, F.lit(2), n - 1), lambda x, y: F.xxhash64(x, y))
    each = F.transform(low, lambda x: F.xxhash64(x))
    keys = F.when(n < SHORT, each).when(n < 2 * SHORT, F.concat(each, after)).otherwise(after)
    rows = sketches.join(broadcast_if_small(lines), "lid").select("lid", "root", (n < NEIGHBOURS).alias("few"), F.explode(keys).alias("key"))
    met = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size"))
    met = compact(met.where("least < most").select("key", "size"))
    return compact(flagged(rows, met, ["key"], "may").where("may").drop("may").join(broadcast_if_small(met), "key"))


def unsettled(near: DataFrame, roots: DataFrame) -> DataFrame:
    """(lid, root): lines of ``near`` that share so many large keys with other components that a pair may have no small one."""
    rows = near.where(F.col("size") > SMALL_BAND).select("lid", "few", "key").join(roots, F.col("lid") == F.col("node"), "left")
    rows = rows.select("lid", "few", "key", F.coalesce("root", "lid").alias("root"))
    met = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    lines = rows.join(met, "key").groupBy("lid", "root", "few").count()
    return compact(lines.where((F.col("count") >= NEIGHBOURS) | F.col("few")).select("lid", "root"))


def central(sketches: DataFrame) -> DataFrame:
    """(lid, low, rank): how often a line's hashes occur among all the lines: a line in the middle of its kin ranks high."""
    words = sketches.select("lid", F.explode("low").alias("h"))
    often = words.groupBy("h").agg(F.count("*").alias("often"))
    rank = words.join(often, "h").groupBy("lid").agg(F.sum("often").alias("rank"))
    return sketches.select("lid", "low").join(rank, "lid")


def prefix_pairs(lines: DataFrame, sets: DataFrame, similarity: float, maps: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of ``lines`` (lid, root) with different roots, among them all whose similarity is reached.

    A line needs at least ``similarity`` of its shingles in common with a shorter one, and more with one as long or
    longer, so one of the rarest shingles of the shorter line is among the rarest of the longer: a ninth and a fifth
    of them at 0.8, rare being told among ``lines``. Shingles of a template are seldom so rare and then bring no pair
    together. Sizes and bitmaps bound what two lines can have in common at most; pairs that fail are never rows.
    maps: the bitmaps of the sets, if they are there already.
    """
    lines = broadcast_if_small(lines)
    members = with_hashes(sets.join(lines, "lid", "left_semi"))
    words = members.select("lid", F.explode_outer("hashes").alias("h"))
    often = words.groupBy("h").agg(F.count("*").alias("often")).where("often > 1")
    # A number that stands for the shingle and sorts rare ones first.
    order = F.shiftleft("often", 32).bitwiseOR(F.col("h").cast("long").bitwiseAND(0xFFFFFFFF))
    ranked = words.join(often, "h").groupBy("lid").agg(F.sort_array(F.collect_list(order)).alias("common"))
    maps = (bitmaps(members) if maps is None else maps).join(lines, "lid")
    alone = F.col("n") - F.size("common")  # shingles of no other line are the rarest of all
    first = lambda share: F.greatest(F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1 - alone, F.lit(0)).cast("int")
    shingle = lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int")
    rarest = lambda share: F.transform(F.slice("common", F.lit(1), first(share)), shingle)
    bits = [f"b{k}" for k in range(BITMAP)]
    prefix = ranked.join(maps, "lid").select("lid", "root", "n", rarest(similarity).alias("pre"), rarest(2 * similarity / (1 + similarity)).alias("short"), *bits)
    prefix = compact(prefix.where(F.size("pre") > 0))
    swept(prefix.sparkSession)
    # Only shingles at which two lines can meet go on; a row knows the rarer ones of its line.
    shared = prefix.select(F.explode("pre").alias("h")).groupBy("h").agg(F.count("*").alias("lines")).where("lines > 1")
    shared = shared.join(prefix.select(F.explode("short").alias("h")).distinct(), "h")
    blocks = broadcast_if_small(shared.select("h", F.ceil(F.col("lines") / BLOCK).cast("int").alias("blocks")))
    at = lambda side: prefix.select("lid", "root", "n", *bits, side, F.posexplode(side).alias("at", "h")).withColumn("rarer", F.slice(side, F.lit(1), F.col("at"))).join(blocks, "h")
    left = at("pre").withColumn("block", F.pmod(F.xxhash64("lid"), F.col("blocks").cast("long")).cast("int"))
    left = left.select("h", "block", "lid", "root", "n", "rarer", *bits)
    right = at("short").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select("h", "block", *(F.col(c).alias(f"{c}_b") for c in ("lid", "root", "n", "rarer", *bits)))
    both = F.col("n") + F.col("n_b")
    least = in_common(F.col("n"), F.col("n_b"), similarity)
    longer = (F.col("n") > F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("lid") > F.col("lid_b")))
    near = longer & (F.col("root") != F.col("root_b")) & (F.col("n_b") >= F.col("n") * similarity - 1e-9) & (both - apart("", "_b") >= 2 * least)
    near = near & ~F.arrays_overlap("rarer", "rarer_b")  # a pair meets once, at the rarest shingle that its lines share
    same = (left["h"] == right["h"]) & (left["block"] == right["block"])
    return left.join(right.hint("merge"), same & near).select(F.col("lid").alias("a"), F.col("lid_b").alias("b"))


def flagged(rows: DataFrame, wanted: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """``rows`` with a column ``flag``, true where ``keys`` are among those of ``wanted``, and for few others.

    It is read from a broadcast filter of bits, so that only the rows which are true need to be shuffled to meet ``wanted``.
    """
    pieces = max(1, min(PIECES, wanted.count() * BITS // PIECE))
    piece_, bit_, bits_ = fresh([*rows.columns, flag], "_piece", "_bit", "_bits")
    key = F.xxhash64(*keys)
    piece, bit = F.pmod(key, F.lit(pieces)), F.shiftrightunsigned(key, 24).bitwiseAND(PIECE - 1)
    bits = wanted.select(piece.alias(piece_), bit.alias(bit_)).repartition(piece_)
    bits = bits.groupBy(piece_).agg(F.call_function("bitmap_construct_agg", F.col(bit_)).alias(bits_))
    # As 64-bit words, whose first byte is the highest.
    word = lambda i: F.conv(F.hex(F.substring(F.col(bits_), i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    bits = bits.select(piece_, F.transform(F.sequence(F.lit(0), F.lit(PIECE // 64 - 1)), word).alias(bits_))
    rows = rows.withColumns({piece_: piece, bit_: bit}).join(F.broadcast(cut(bits)), piece_, "left")
    word = F.get(F.col(bits_), F.shiftright(bit_, 6).cast("int"))
    at = F.col(bit_).bitwiseAND(63).bitwiseXOR(56).cast("int")
    return rows.withColumn(flag, F.coalesce(F.getbit(word, at) == 1, F.lit(False))).drop(piece_, bit_, bits_)


def signed(lines: DataFrame) -> DataFrame:
    """(id, proof, pos, k1, k2, low): each line's place, the bits that stand for it, and its signature."""
    return lines.select("id", "proof", "pos", *keys_of(F.col("line")), signature(F.col("line"), SIGNATURE).alias("low"))


def groups(lines: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(k1, k2, n, first, keep): each distinct line of ``lines`` (as of ``signed``) that is repeated or has similar
    ones: how often it occurs, its first place, and the place that stays.

    Equal lines become one row before anything else, so a very common line costs what any line does. In each
    band, lines are linked to the smallest one and verified. Where that leaves a band of three or more lines in
    several components, its lines meet again at the keys of their sketches, and all pairs at small keys are verified. Lines
    that share large keys with other components are linked to the most central one of their band and of finer bands, of three
    hashes each; what shares large keys even then goes through a prefix filter, which finds every pair among them; each is
    compared exactly.
    """
    place = F.struct("id", "proof", "pos")
    distinct = lines.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.first("low").alias("low"))
    distinct = saved(distinct.withColumn("lid", F.monotonically_increasing_id()), "distinct")
    swept(distinct.sparkSession)
    banded = distinct.select("lid", F.explode(bands(F.col("low"))).alias("band"))
    shared = compact(banded.groupBy("band").agg(F.min("lid").alias("rep"), F.count("*").alias("size")).where("size > 1"))
    swept(shared.sparkSession)
    # Most bands have one line; their rows need not travel a second time.
    shared = cut(flagged(banded, shared, ["band"], "may").where("may").select("band", "lid").join(shared, "band"))
    edges = compact(shared.where("lid <> rep").select(F.col("lid").alias("a"), F.col("rep").alias("b")).distinct())

    places = compact(shared.select("lid").distinct().join(distinct.select("lid", "first"), "lid").select("lid", "first.*"))
    swept(places.sparkSession)
    # Lines travel and are kept, for their sets take many times the bytes, and only those that may be wanted.
    sets = texts_of(docs).select("id", "proof", F.posexplode("raw").alias("pos", "raw"))
    sets = flagged(sets, places, ["id", "proof", "pos"], "may").where("may").join(places, ["id", "proof", "pos"]).select("lid", "raw").dropDuplicates(["lid"])
    sets = saved(sets.select("lid", normalised(F.col("raw")).alias("line")), "candidates")
    maps = cut(bitmaps(sets))
    swept(maps.sparkSession)
    found = compact(similar(edges, sets, maps, similarity))
    swept(found.sparkSession)
    roots = components(found, "a", "b")
    open_ = compact(open_bands(shared.where("size > 2"), roots))
    asked = open_.select("lid", "root").distinct()
    few = broadcast_if_small(asked.select("lid"))
    sketches = cut(with_hashes(sets.join(few, "lid", "left_semi")).select("lid", F.slice("hashes", 1, SKETCH).alias("low")))
    near = neighbours(asked, sketches)
    swept(near.sparkSession)
    small = near.where(F.col("size") <= SMALL_BAND)
    other = small.select("key", F.col("lid").alias("b"), F.col("root").alias("root_b"))
    pairs = small.join(other, "key").where("root < root_b").select(F.greatest("lid", "b").alias("a"), F.least("lid", "b").alias("b"))
    roots = joined(roots, compact(pairs.distinct()), sets, maps, similarity)
    large = unsettled(near, roots)
    if not large.isEmpty():
        lines = broadcast_if_small(large.select("lid"))
        ranks = compact(central(sketches.join(lines, "lid")))
        finer = ranks.select("lid", "rank", F.explode(finer_bands(F.slice("low", 1, FINER))).alias("band"))
        finer = finer.union(shared.where(F.col("size") > SMALL_BAND).join(ranks, "lid").select("lid", "rank", "band"))
        middle = finer.groupBy("band").agg(F.max_by("lid", F.struct("rank", "lid")).alias("rep"), F.count("*").alias("size")).where("size > 1")
        stars = finer.join(middle, "band").where("lid <> rep").select(F.greatest("lid", "rep").alias("a"), F.least("lid", "rep").alias("b"))
        roots = joined(roots, compact(stars.distinct()), sets, maps, similarity)
        large = unsettled(near, roots)
    if not large.isEmpty():
        roots = joined(roots, prefix_pairs(large, sets, similarity, maps), sets, maps, similarity)

    rooted = distinct.drop("low").join(roots, F.col("lid") == F.col("node"), "left").drop("node")
    rooted = rooted.withColumn("root", F.coalesce("root", "lid"))
    many = roots.select(F.col("root").alias("lid")).distinct().withColumn("many", F.lit(True))
    rooted = rooted.join(many, "lid", "left").where((F.col("n") > 1) | (F.col("root") != F.col("lid")) | F.col("many"))
    rooted = compact(rooted.drop("many"))
    keep = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    return rooted.join(keep, "root").select("k1", "k2", "n", "first", "keep")


def removals(docs: DataFrame, similarity: float = SIMILARITY, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, proof, pos): the lines to remove."""
    lines = saved(signed(lines_of(docs, least_chars)), "lines")
    repeated = cut(groups(lines, docs, similarity))
    swept(repeated.sparkSession)
    places = lines.drop("low")
    gone = places.join(repeated.select("k1", "k2", "keep"), ["k1", "k2"]).where(F.struct("id", "proof", "pos") != F.col("keep"))
    return compact(gone.select("id", "proof", "pos"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The documents, all columns, with text reduced to lines that stay, and _n_lines and _n_removed.

    Lines (parted by line feeds) are compared lower-cased with white space collapsed. Of each component of lines
    whose sets of character shingles are similar, the first by (doc_id, place) stays, everywhere else its members go.
    Lines of fewer than ``least_chars`` characters between blanks at their ends are left alone. Null text stays null
    and has no lines. A null doc_id is larger than any other; rows that repeat doc_id and text share their fate. An
    empty table gives an empty result. Columns named _n_lines or _n_removed are replaced.
    """
    docs = docs.drop("_n_lines", "_n_removed")
    gone = removals(docs, similarity, least_chars)
    swept(gone.sparkSession)
    id_, proof, dropped, loses = fresh(docs.columns, "_id", "_proof", "_drop", "_loses")
    drop = gone.groupBy(F.col("id").alias(id_), F.col("proof").alias(proof)).agg(F.collect_set("pos").alias(dropped))
    rows = tagged(docs, id_, proof)
    if gone.count() <= BROADCAST_ROWS:  # of a few dozen bytes each
        joined = rows.join(F.broadcast(drop), [id_, proof], "left")
    else:  # texts that lose no line stay where they are
        drop = cut(drop)
        rows = flagged(rows, drop, [id_, proof], loses)
        joined = rows.where(F.col(loses)).join(drop, [id_, proof], "left")
        joined = joined.unionByName(rows.where(~F.col(loses)), allowMissingColumns=True)
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(dropped, i))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).cast("long")
    n_removed = F.when(F.col(dropped).isNull(), 0).otherwise(F.size(dropped)).cast("long")
    text = F.when(F.col(dropped).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = joined.select("*", n_lines.alias("_n_lines"), n_removed.alias("_n_removed")).withColumn("text", text)
    return out.select(*quoted(docs.columns), "_n_lines", "_n_removed")
