"""Toxicity: obfuscated words are restored by a noisy-channel Viterbi decoder, then the text is scored."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.llm.common import broadcast_if_small, crc_bucket, cut, in_python, saved, schema_of

# What a written character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = set(".-_*'~^`·,/\\")
#: Channel costs (negative log): a substitution, a separator within a word, a repeated letter dropped or kept.
SUBSTITUTE, SEPARATE, REPEAT, KEEP_REPEAT = 1.0, 0.5, 0.5, 1.5
#: Words that a task counts or remembers at once.
HELD = 200_000
#: Letters that the model tells apart: Latin ones, as fixed ranges of code points. All others count as one letter, for
#: the channel never writes them. This bounds the trigrams, whatever scripts the corpus holds.
LETTERS, OTHER = frozenset(map(chr, [*range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x180)])), "\u00a4"
#: Features of a word are the word and its beginnings of these lengths. The model keeps those that are at least LEAST_ODDS
#: likelier (natural log) in toxic texts, by a likelihood-ratio test whose statistic is at least LEAST_PROOF (a chance
#: below 1 in 10**4 a feature). Of toxic texts those count in which a feature has other neighbours, else near copies of one
#: text would give all its words.
BEGINNINGS, LEAST_ODDS, LEAST_PROOF = (4, 5, 6), 2.0, 16.0
#: The model is fitted on so many documents of each label on average, those of the smallest hash of the text.
FIT_ROWS = 100_000

_EDGE = "\"'()[]{}<>«»“”‘’.,;:!?%&*#$…-–—_/\\|"
_OPENING = "\"'()[]{}<>«»“”‘’.,;:?%&*#…-–—_/\\"
_AROUND = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_RUN = re.compile(r"(.)\1+")
_DOUBLE = re.compile(r"(.)\1")
_INNER = re.compile(r"[^\W_][\W_]+(?=[^\W_])")


@dataclass
class LanguageModel:
    """Log probability of a letter after two others, with back-off. ^ and $ mark a word's ends."""

    three: dict[str, float]
    one: dict[str, float]

    @staticmethod
    def from_counts(counts: dict[str, int]) -> LanguageModel:
        """counts: letter trigrams of padded words and how often they occur."""
        two, one, total = Counter(), Counter(), sum(counts.values())
        for g, n in counts.items():
            two[g[:2]] += n
            one[g[2]] += n
        return LanguageModel({g: math.log(n / two[g[:2]]) for g, n in counts.items()}, {c: math.log(n / total) for c, n in one.items()})

    def cost(self, before: str, letter: str) -> float:
        got = self.three.get(before + letter)
        return -got if got is not None else 4.0 - self.one.get(letter, -12.0)


def _trigrams(batches):
    """Letter trigrams of the words of all texts. Each task counts its words first, and then the letters of each once."""
    words: Counter = Counter()
    for batch in batches:
        for t in batch.column(0):
            words.update((t.as_py() or "").lower().split())
            if len(words) > HELD:
                yield _letters(words)
                words = Counter()
    yield _letters(words)


def _letters(words: Counter) -> pa.RecordBatch:
    counts: Counter = Counter()
    for token, n in words.items():
        word = token if token.isalpha() else _AROUND.sub("", token)
        if not word.isalpha():
            continue
        padded = f"^^{word}$" if LETTERS.issuperset(word) else f"^^{''.join(c if c in LETTERS else OTHER for c in word)}$"
        for i in range(len(padded) - 2):
            counts[padded[i : i + 3]] += n
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["three", "n"])


def language_model(docs: DataFrame) -> LanguageModel:
    """Letter trigrams of the words of every document, at most len(LETTERS) + 3 cubed.

    Words with anything but letters inside are left out: they are what the channel makes of words.
    """
    threes = in_python(docs.select("text"), _trigrams, "three string, n long").groupBy("three").agg(F.sum("n").alias("n"))
    return LanguageModel.from_counts({r["three"]: r["n"] for r in sorted(threes.collect())})


def decode(written: str, model: LanguageModel) -> list[str]:
    """Likeliest words behind letters, signs and blanks: Viterbi over the lattice of what each may stand for.

    A state is the last two letters of the current word. A sign may be a letter, or a separator within a word, or the
    repeat of the sign before. A blank, or a sign that is no letter, lies within a word, as a separator, or ends one. There are at most as many
    states as pairs of letters, so the work is in proportion to the length; none is dropped. A path is a chain
    (before, letter); $ ends a word.
    """
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    previous = ""
    for char in written:
        readings = [(x, SUBSTITUTE) for x in LEET.get(char, "")]
        readings += [(char, 0.0)] if char.isalpha() else []
        drop = SEPARATE if char == " " or char in SEPARATORS else REPEAT if char == previous else None if readings else 3 * SEPARATE
        keep = KEEP_REPEAT if char == previous else 0.0
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (cost, path) in states.items():
            if drop is not None and (c := cost + drop) < after.get(state, (math.inf,))[0]:
                after[state] = (c, path)
            if not readings and state != "^^" and (c := cost + model.cost(state, "$")) < after.get("^^", (math.inf,))[0]:
                after["^^"] = (c, (path, "$"))
            for letter, channel in readings:
                known = letter if letter in LETTERS else OTHER
                c = cost + channel + keep + model.cost(state, known)
                key = state[1] + known
                if c < after.get(key, (math.inf,))[0]:
                    after[key] = (c, (path, letter))
        states = after
        previous = char if char != " " else previous
    _, _, path = min((cost + (model.cost(state, "$") if state != "^^" else 0.0), state, path) for state, (cost, path) in states.items())
    letters = []
    while path is not None:
        path, letter = path
        letters.append(letter)
    return [w for w in "".join(reversed(letters)).split("$") if w]


class _Skeleton(dict):
    """Signs to the letter they may stand for (i and l are one), letters to themselves, all else to nothing."""

    def __missing__(self, code: int):
        char = chr(code)
        read = LEET.get(char, char if char.isalpha() else "")[:1].replace("l", "i")
        self[code] = read or None
        return self[code]


_SKELETON = _Skeleton()


def skeleton(written: str) -> str:
    """What all readings of the decoder have in common: letters without repeats. If ``decode`` of a run of signs can
    give a word, their skeletons are equal; so where no wanted skeleton is found nothing needs to be decoded.
    """
    return _RUN.sub(r"\1", written.translate(_SKELETON))


def features(word: str) -> tuple[str, ...]:
    return (word, *[word[:n] + "*" for n in BEGINNINGS if len(word) >= n])


def bare(token: str) -> str:
    return token.rstrip(_EDGE).lstrip(_OPENING)


class Restorer:
    """Finds the wanted features of texts, in words as written and as restored.

    What a token stands for is remembered. Tokens, runs of single signs, and neighbours that together may spell a
    wanted word go to the decoder if their skeleton has that of a wanted feature.
    """

    def __init__(self, model: LanguageModel, wanted):
        self.model, self.wanted = model, frozenset(wanted)
        self.words = {skeleton(f) for f in self.wanted if f[-1] != "*"}
        self.stems = {skeleton(f[:-1]) for f in self.wanted if f[-1] == "*"} - {""}
        self.lengths = sorted({len(s) for s in self.stems})
        self.least = min(3, min(map(len, self.words | self.stems), default=0))
        self.heads = {s[: self.least] for s in self.words | self.stems}
        #: Beginnings of the skeletons of wanted words: what more pieces can complete.
        self.open = {s[:n] for s in self.words for n in range(1, len(s))}
        any_of = "|".join(sorted(map(re.escape, self.words | self.stems)))
        self.inside = re.compile(any_of) if any_of else None
        self.known: dict[str, tuple[str, ...]] = {}
        self.signs: set[str] = set()
        self.special: dict[str, str] = {}

    def may_be(self, bones: str) -> bool:
        if bones[: self.least] not in self.heads:
            return False
        return bones in self.words or any(bones[:n] in self.stems for n in self.lengths)

    def parted(self, written: str) -> bool:
        """Whether a word between signs, or all from a sign on, may be a wanted one."""
        marks = [m.span() for m in _INNER.finditer(written)]
        begins = [0, *[end for _, end in marks]]
        return any(self.may_be(skeleton(written[a:])) or self.may_be(skeleton(written[a : b + 1])) for a, b in zip(begins, [*[begin for begin, _ in marks], len(written)]))

    def of_words(self, words: list[str]) -> tuple[str, ...]:
        return tuple(f for w in words for f in features(w) if f in self.wanted)

    def token(self, token: str) -> tuple[str, ...]:
        """Features of a token. A word with a doubled letter is also read as the channel's, and so are several words that
        signs part.
        """
        head = token[:3].replace("l", "i")
        inner = None if token.isalpha() else _INNER.search(token)
        if not inner and self.least > 2 and len(head) == 3 and head.isalpha() and head[0] != head[1] != head[2] and head not in self.heads:
            return ()
        written = bare(token)
        bones = skeleton(written)
        if len(token) == 1 or len(written) == 1:
            self.signs.add(token)
        if token in self.signs or bones in self.open:
            self.special[token] = bones
        if not self.may_be(bones) and not (inner and self.parted(written)):
            return ()
        plain = written.isalpha()
        found = self.of_words([written]) if plain else ()
        if not plain or _DOUBLE.search(written):
            found += self.of_words(decode(written, self.model))
        return found

    def pieces(self, tokens: list[str], special: list[int]) -> list[str]:
        """Features of runs of single signs, and of a token with those after it that complete a wanted skeleton."""
        found: list[str] = []
        done = -1
        for i in special:
            if i < done:
                continue
            j = i
            while j < len(tokens) and tokens[j] in self.signs:
                j += 1
            if j - i > 2:
                done = j
                run = " ".join(t if len(t) == 1 else bare(t) for t in tokens[i:j])
                if self.inside and self.inside.search(skeleton(run)):
                    found += self.of_words(decode(run, self.model))
                continue
            bones, j = self.special[tokens[i]], i + 1
            if not bones:
                continue
            if j < len(tokens) and (head := tokens[j][0]).isalpha():  # most neighbours do not go on as a wanted word does
                more = bones + ("i" if head == "l" else head)
                if more[-1] != more[-2] and more not in self.open and more not in self.words:
                    continue
            while bones in self.open and j < len(tokens):
                bones = skeleton(bones + bare(tokens[j]))
                j += 1
            if j > i + 1 and bones in self.words:
                found += self.of_words(decode(" ".join(map(bare, tokens[i:j])), self.model))
        return found

    def features(self, text: str | None) -> set[str]:
        """Distinct wanted features of a text."""
        found: set[str] = set()
        tokens, known = (text or "").lower().split(), self.known
        for token in set(tokens):
            got = known.get(token)
            if got is None:
                got = known[token] = self.token(token)
            if got:
                found.update(got)
        held = self.special
        found.update(self.pieces(tokens, [i for i, t in enumerate(tokens) if t in held]))
        if len(known) > HELD:
            for memory in (held, self.signs, known):
                memory.clear()
        return found


def _feature_counts(among):
    """Documents by feature of their words as written. among: broadcast set of features that count (None: all)."""

    def run(batches):
        counts: Counter = Counter()
        known: dict[str, tuple[str, ...]] = {}
        wanted = among.value if among else None
        for batch in batches:
            for text in batch.column(0):
                found: set[str] = set()
                for token in set((text.as_py() or "").lower().split()):
                    got = known.get(token)
                    if got is None:
                        if len(known) > HELD:
                            known.clear()
                        got = features(word) if (word := bare(token)).isalpha() else ()
                        if wanted is not None:
                            got = tuple(f for f in got if f in wanted)
                        known[token] = got
                    if got:
                        found.update(got)
                counts.update(found)
                if len(counts) > HELD:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    return run


def _contexts(among):
    """(feature, context): the neighbours of each text's first word, as written, with each feature of the set."""

    def run(batches):
        for batch in batches:
            out: set[tuple[str, int]] = set()
            for text in batch.column(0):
                tokens, found = ["", *(text.as_py() or "").lower().split(), ""], {}
                for i in range(1, len(tokens) - 1):
                    if (word := bare(tokens[i])).isalpha():
                        for f in features(word):
                            if f in among.value:
                                found.setdefault(f, xxhash.xxh64_intdigest(f"{bare(tokens[i - 1])} {bare(tokens[i + 1])}".encode()) >> 1)
                out.update(found.items())
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.string()), pa.array([c for _, c in out], pa.int64())], ["feature", "context"])

    return run


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])


def odds(clean: Column, toxic: Column, n_clean: int, n_toxic: int) -> Column:
    """Log ratio of a feature's document rates in toxic and clean texts."""
    return F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))


def wanted_features(labelled: DataFrame, clean: int, toxic: int) -> list[str]:
    """Features of words as written that tell toxic texts from clean ones. labelled: (toxic, text), of distinct texts;
    what is collected is bounded by FIT_ROWS.

    Features of toxic texts are counted first; those of clean ones only where enough toxic texts have them; the contexts
    of those that are left at last.
    """
    rate = (toxic + 1) / (toxic + clean + 2)
    count = lambda label, among: (
        in_python(labelled.where(F.col("toxic") == label).select("text"), _feature_counts(among), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    )
    often = count(1, None).where(F.col("n") * (-2 * math.log(rate)) >= LEAST_PROOF)
    often = {r["feature"]: r["n"] for r in often.collect()}
    among = labelled.sparkSession.sparkContext.broadcast(frozenset(often))
    in_clean = {r["feature"]: r["n"] for r in count(0, among).collect()}

    def tells(t: int, c: int) -> bool:
        proof = 2 * sum(k * math.log(k / ((t + c) * r)) for k, r in ((t, rate), (c, 1 - rate)) if k)
        return proof >= LEAST_PROOF and math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) >= LEAST_ODDS

    among = labelled.sparkSession.sparkContext.broadcast(frozenset(f for f, t in often.items() if tells(t, in_clean.get(f, 0))))
    contexts = in_python(labelled.where(F.col("toxic") == 1).select("text"), _contexts(among), "feature string, context long").distinct()
    seen = {r["feature"]: r["n"] for r in contexts.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    return sorted(f for f, t in seen.items() if tells(t, in_clean.get(f, 0)))


def _restored(model: LanguageModel, wanted: list[str], text: str):
    def run(batches):
        restorer, place = Restorer(model, wanted), {f: i for i, f in enumerate(wanted)}
        for batch in batches:
            found = [sorted(place[f] for f in restorer.features(t.as_py())) for t in batch.column(text)]
            keep = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(found, pa.list_(pa.int32()))], [*keep, "found"])

    return run


def restored(texts: DataFrame, model: LanguageModel, wanted: list[str], text: str = "text") -> DataFrame:
    """The columns of ``texts`` but the text, and found: the places in ``wanted`` of its distinct features."""
    return in_python(texts, _restored(model, wanted, text), f"{schema_of(texts.drop(text))}, found array<int>")


def _logistic(known: DataFrame, steps: int = 25) -> tuple[float, float]:
    """Slope and offset by Newton's method with step halving, on a histogram of strengths (at most 2001 bins)."""
    bins = known.groupBy(F.least(F.round(F.col("strength") * 4), F.lit(2000)).alias("b"), "toxic").count().collect()
    data = [(r["b"] / 4, r["toxic"], r["count"]) for r in bins]
    if len({t for _, t, _ in data}) < 2:
        return 1.0, -3.0
    def loss(w: float, b: float) -> float:
        out = 0.05 * w * w + 0.005 * b * b
        for x, t, n in data:
            z = (w * x + b) * (-1 if t else 1)
            out += n * (z if z > 30 else math.log1p(math.exp(z)))
        return out

    w, b = 0.5, -1.0
    for _ in range(steps):
        gw = gb = hww = hwb = hbb = 0.0
        for x, t, n in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, w * x + b))))
            e, h = n * (p - t), n * p * (1 - p)
            gw, gb, hww, hwb, hbb = gw + e * x, gb + e, hww + h * x * x, hwb + h * x, hbb + h
        gw, gb, hww, hbb = gw + 0.1 * w, gb + 0.01 * b, hww + 0.1, hbb + 0.01
        det = hww * hbb - hwb * hwb
        dw, db, scale = (hbb * gw - hwb * gb) / det, (hww * gb - hwb * gw) / det, 1.0
        while scale > 1e-6 and loss(w - scale * dw, b - scale * db) >= loss(w, b):
            scale /= 2
        w, b = w - scale * dw, b - scale * db
    return max(w, 1e-3), b


def distinct_sample(labelled: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(toxic, text): equal texts of one label once, and about ``rows`` texts of each label, those of the smallest hash."""
    keyed = labelled.withColumn("_key", F.xxhash64("text"))
    keys = keyed.select("toxic", "_key").distinct()
    sizes = {r["toxic"]: r["n"] for r in keys.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    kept = F.lit(False)
    for label, n in sizes.items():
        kept = F.when(F.col("toxic") == label, F.shiftrightunsigned("_key", 1) < F.lit(float(1 << 63)) * rows / n).otherwise(kept)
    return keyed.where(kept).groupBy("toxic", "_key").agg(F.first("text").alias("text")).select("toxic", "text")


def held_out(folds: int = 5, fold: int = 0):
    return F.coalesce(crc_bucket(F.col("doc_id"), folds) == fold, F.lit(False))


def _by_label(known: DataFrame) -> tuple[int, int]:
    """Rows that are clean, and toxic."""
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return totals.get(0, 0), totals.get(1, 0)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    The letters' model counts the words of all documents. Labels are learned only from rows that are not held out:
    features that tell toxic texts are chosen among words as written, then all texts are restored and searched for
    them; a feature's weight is the log ratio of its document rates in restored labelled texts, and a logistic curve
    maps a text's sum of weights to a probability.

    Null and empty texts are scored as texts without words. Rows that repeat a doc_id are scored each by its own
    text. Without labels of both kinds nothing is predicted toxic. An empty table gives an empty result; other
    columns are ignored.
    """
    labels = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = broadcast_if_small(labels)
    known = docs.where(~held_out()).select("doc_id", "text").where("text is not null").join(labels, "doc_id").select("toxic", "text")
    known = saved(distinct_sample(known), "labelled")
    clean, toxic = _by_label(known)
    wanted = wanted_features(known, clean, toxic) if clean and toxic else []
    language = language_model(docs) if wanted else LanguageModel({}, {})
    found = cut(restored(docs.select("doc_id", held_out().alias("held_out"), F.xxhash64("text").alias("key"), F.col("text").isNotNull().alias("written"), "text"), language, wanted))
    known = found.where(~F.col("held_out") & F.col("written")).join(labels, "doc_id").groupBy("toxic", "key").agg(F.first("found").alias("found"))
    clean, toxic = _by_label(known)
    counts = known.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(F.count(F.when(F.col("toxic") == 0, 1)).alias("clean"), F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic"))
    weights = {r["f"]: r["w"] for r in counts.select("f", odds(F.col("clean"), F.col("toxic"), clean, toxic).alias("w")).collect()}
    table = F.array(*[F.lit(max(0.0, weights.get(i, 0.0))) for i in range(len(wanted))] or [F.lit(0.0)])
    strength = F.aggregate("found", F.lit(0.0), lambda s, i: s + F.element_at(table, i + 1))
    slope, offset = _logistic(known.select("toxic", strength.alias("strength")))
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), strength * slope + offset))
    score = 1 / (1 + F.exp(-x))
    return found.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
