"""Language ID with bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.llm.common import broadcast_if_small, crc_bucket, cut, fresh, in_python, quoted, schema_of
from repolith.llm.superkmers import mix

#: Bytes of an n-gram; hashes of an n-gram; slots of the filter for each n-gram of the language that has most.
GRAM, HASHES, SPARE = 4, 3, 8
#: The model is fitted on so many documents of each language on average, those of the smallest hash of identifier and text.
FIT_ROWS = 1000
#: Bytes of text that are looked up at once; longer texts are counted piece by piece.
PIECE = 1 << 20
UNDETERMINED = "und"
#: Rejected below this share of n-grams known to the best language.
LEAST_SCORE = 0.05

# Letters of ASCII and all bytes of longer characters stay; anything else parts words.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    """Bit l % 64 of word l // 64 of a slot: language l has an n-gram there. false_rate: chance that a language's
    filter claims an n-gram that it lacks.
    """

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of lower-cased texts, and how many each text has. Words keep one blank on either side."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    length = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), length + 1)
    owner = np.append(owner[:1], owner) if len(texts) else np.zeros(len(data), np.int64)
    clean = np.where(_LETTER[data], data, 32)
    keep = (clean != 32) | np.append(True, clean[:-1] != 32)
    clean, owner = clean[keep].astype(np.uint64), owner[: len(keep)][keep]
    n = len(clean) - GRAM + 1
    if n <= 0 or not len(texts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    code = np.zeros(n, np.uint64)
    for k in range(GRAM):
        code = (code << np.uint64(8)) | clean[k : k + n]
    inside = owner[:n] == owner[GRAM - 1 : GRAM - 1 + n]
    return code[inside], np.bincount(owner[:n][inside], minlength=len(texts))


def slots_of(code: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of n-grams in a filter of ``size`` slots, a power of two up to 2**32."""
    h = mix(code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(i) * step) % np.uint64(size)).astype(np.int64) for i in range(HASHES)]


def _grams_of(batches):
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).to_pylist()
        for lang in set(langs):
            code = np.unique(grams([texts[i] or b"" for i in np.flatnonzero(langs == lang)])[0])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64))], ["lang", "gram"])


def _slices(names: list[str], size: int):
    place = {name: i for i, name in enumerate(names)}

    def run(batches):
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for at in slots_of(batch.column(1).to_numpy().view(np.uint64), size):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lang)], ["slot", "lang"])

    return run


def sampled(labelled: DataFrame, fit_rows: int) -> DataFrame:
    """(lang, text): about ``fit_rows`` documents of each language, all of those with fewer; equal rows once.

    A document is taken if its hash is below its language's share, so no language is ever sorted or in one task.
    """
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("_n"))
    key = F.xxhash64("doc_id", "text")
    rows = labelled.select("lang", "text", key.alias("_key")).join(broadcast_if_small(sizes), "lang")
    rows = rows.where(F.shiftrightunsigned("_key", 1) < F.lit(float(1 << 63)) * fit_rows / F.col("_n"))
    return rows.groupBy("lang", "_key").agg(F.first("text").alias("text")).select("lang", "text")


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on (doc_id, text, lang). ``fit_rows`` bounds the sample, and with it the filter; one document is enough for a language."""
    sample = sampled(labelled, fit_rows).select("lang", F.lower("text").cast("binary").alias("text"))
    counts = cut(in_python(sample, _grams_of, "lang string, gram long").distinct())
    found = counts.groupBy("lang").agg(F.count("*").alias("n")).collect()
    names = sorted(r["lang"] for r in found)
    size = 1 << max(10, (SPARE * max([r["n"] for r in found], default=1) - 1).bit_length())
    slots = np.zeros((size, max(1, -(-len(names) // 64))), np.uint64)
    if names:
        bits = in_python(counts.select("lang", "gram"), _slices(names, size), "slot long, lang long")
        word, bit = F.shiftright("lang", 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("lang") % 64).cast("int"))
        bits = bits.groupBy("slot", word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # a row for each word of the filter at most
        slots[bits["slot"].to_numpy(), bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    false_rate = np.array([float(_bit(slots, k).mean()) ** HASHES for k in range(len(names))])
    return Model(names, slots, false_rate)


def _bit(masks: np.ndarray, language: int) -> np.ndarray:
    return (masks[:, language // 64] >> np.uint64(language % 64)) & np.uint64(1)


def held_by(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many of each text's n-grams each language claims, and how many n-grams it has."""
    code, n = grams(texts)
    held = np.zeros((len(texts), len(model.languages)))
    if len(code):
        masks = None
        for at in slots_of(code, len(model.slots)):
            masks = model.slots[at] if masks is None else masks & model.slots[at]
        some = np.flatnonzero(n)
        heads = (np.cumsum(n) - n)[some]
        for k in range(len(model.languages)):
            held[some, k] = np.add.reduceat(_bit(masks, k).astype(np.int64), heads)
    return held, n


def shares(model: Model, texts: list[bytes]) -> np.ndarray:
    """Share of each text's n-grams that each language has, corrected for false positives."""
    held, n = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    pieces, owners, size = [], [], 0

    def look_up():
        got, count = held_by(model, pieces)
        np.add.at(held, owners, got)
        np.add.at(n, owners, count)

    for i, text in enumerate(texts):
        for j in range(0, max(1, len(text)), PIECE):
            piece = text[j : j + PIECE]
            if pieces and size + len(piece) > PIECE:
                look_up()
                pieces, owners, size = [], [], 0
            pieces.append(piece)
            owners.append(i)
            size += len(piece)
    if pieces:
        look_up()
    rate = model.false_rate
    return np.clip((held / np.maximum(n, 1)[:, None] - rate) / np.maximum(1 - rate, 1e-9), 0, 1)


def _predict(shared, text: str, lettered: str, names: tuple[str, str]):
    def run(batches):
        model = shared.value
        for batch in batches:
            share = shares(model, [t.as_py() or b"" for t in batch.column(text)])
            picks = share.argmax(axis=1).tolist() if model.languages else [0] * batch.num_rows
            scores = share.max(axis=1, initial=0.0).tolist()
            known = batch.column(lettered).to_pylist()
            found = [model.languages[p] if ok and model.languages else UNDETERMINED for p, ok in zip(picks, known)]
            scores = [s if ok else 0.0 for s, ok in zip(scores, known)]
            kept = [n for n in batch.schema.names if n not in (text, lettered)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*kept, *names])

    return run


def training_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def held_out(folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(crc_bucket(F.col("doc_id"), folds) == fold, F.lit(False))


def identify(docs: DataFrame, model: Model, carry: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``carry`` columns of each document with lang_pred and score (or the two ``names`` given).

    A slot of the filter holds a bit for each language, so one look-up tells all languages that have an n-gram;
    the bits are counted by language over the whole text, corrected for each filter's rate of false positives,
    and the largest share wins (ties: first by name). lang_pred is ``und`` and score 0 for null text and text
    without a letter. Texts whose n-grams no language has get score 0. Repeated rows each get a row; an empty table
    gives an empty result. ``names`` must not be among ``carry``.
    """
    text, lettered = fresh([*carry, *names], "_text", "_lettered")
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    texts = docs.select(*quoted(carry), F.lower("text").cast("binary").alias(text), known.alias(lettered))
    schema = f"{schema_of(docs.select(*quoted(carry)))}, {names[0]} string, {names[1]} double"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return in_python(texts, _predict(shared, text, lettered, names), schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Documents, all columns, whose language is determined with at least LEAST_SCORE."""
    lang, score = fresh(docs.columns, "lang_pred", "score")
    found = identify(docs, model, docs.columns, (lang, score))
    return found.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*quoted(docs.columns))
