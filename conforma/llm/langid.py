"""Language identification by rank-order n-gram profiles (out-of-place distance).

Every language's profile holds its PROFILE most frequent character 1- to 3-grams over all training
texts, words padded with one blank on each side. A text's own most frequent n-grams are compared to
each profile: an n-gram adds the difference of its ranks, or PROFILE where the profile lacks it. The
nearest profile wins; equal distances go to the smaller language name.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is any text if
nothing was learned; training rows with a null language are ignored; equal counts are ranked by
code points; repeated documents each give a row; other columns are ignored; an empty table gives an
empty result. The learned table has PROFILE rows a language; more than MAX_LANGUAGES are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_remainder, table

PROFILE = 400
MAX_LANGUAGES = 5_000
PARTS = 64  # of a language's n-grams, each with candidates for its profile
UNKNOWN = "und"
FOLD_POINTS = 0x20000  # letters beyond this (none that is cased) count as one letter

_SHIFT = np.int64(21)
_fold: np.ndarray | None = None


def _folded() -> np.ndarray:
    """Code point to that of its lower-case letter, 0 for what is no letter."""
    global _fold
    if _fold is None:
        table = np.zeros(FOLD_POINTS + 1, np.int64)
        for c in range(FOLD_POINTS):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        table[FOLD_POINTS] = FOLD_POINTS
        _fold = table
    return _fold


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes, ascending, and counts of the text's 1- to 3-grams.

    A code holds up to three code points of 21 bits, the first one highest; a blank is bit pattern 1.
    """
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    points = _folded()[np.minimum(raw, FOLD_POINTS)]
    letter = points > 0
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kept = letter | np.concatenate([[False], letter[:-1]])
    points = np.where(letter, points, 1)[kept]
    points = np.concatenate([[1], points, [1]]) if points[-1] != 1 else np.concatenate([[1], points])
    single = points[points > 1]
    pair = (points[:-1] << _SHIFT) | points[1:]
    triple = (pair[:-1] << _SHIFT) | points[2:]
    codes = np.concatenate([single, pair, triple[points[1:-1] > 1]])
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first, equal counts by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


class _Sums:
    """Counts by code, summed now and then."""

    def __init__(self):
        self.parts, self.waiting = [], 0

    def add(self, codes, counts):
        self.parts.append((codes, counts))
        self.waiting += len(codes)
        if self.waiting > 1 << 20:
            self.compact()

    def compact(self):
        codes = np.concatenate([c for c, _ in self.parts])
        counts = np.concatenate([n for _, n in self.parts])
        codes, place = np.unique(codes, return_inverse=True)
        counts = np.bincount(place, counts, len(codes)).astype(np.int64)
        self.parts, self.waiting = [(codes, counts)], 0
        return codes, counts


def learn(training: DataFrame, profile: int = PROFILE) -> DataFrame:
    """lang, code, rank (from 0) over all training rows; needs columns text and lang."""

    def count(batches):
        sums: dict[str, _Sums] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                codes, counts = ngram_counts(text.as_py())
                if len(codes):
                    sums.setdefault(lang.as_py(), _Sums()).add(codes, counts)
        for lang, own in sums.items():
            codes, counts = own.compact()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                names=["lang", "code", "n"],
            )

    rows = training.select(F.col("lang").cast("string"), "text").dropna()
    counted = rows.mapInArrow(count, "lang string, code long, n long")
    summed = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    part = F.pmod(F.xxhash64("code"), F.lit(PARTS))
    of_part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.desc("n"), "code"))
    best = summed.withColumn("part", part).withColumn("place", of_part).filter(F.col("place") <= profile)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = best.withColumn("place", place).filter(F.col("place") <= profile)
    return best.select("lang", "code", (F.col("place") - 1).alias("rank"))


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        place = {x: i for i, x in enumerate(self.langs)}
        self.codes = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for lang, code, rank in rows:
            self.ranks[place[lang], np.searchsorted(self.codes, code)] = rank

    def predict(self, text: str) -> tuple[str, float]:
        codes, counts = ngram_counts(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        top = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, top)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == top
        ranks = self.ranks[:, np.where(known, at, len(self.codes))]
        out = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top)))).sum(1)
        best = int(np.argmin(out))
        return self.langs[best], 1.0 - float(out[best]) / (self.size * len(top))


def identify(docs: DataFrame, profiles: DataFrame, profile: int = PROFILE) -> DataFrame:
    """All columns of docs, with lang_pred and score (1: the text has the profile's own order)."""
    rows = [tuple(r) for r in profiles.limit(MAX_LANGUAGES * profile + 1).collect()]
    if len(rows) > MAX_LANGUAGES * profile:
        raise ValueError(f"at most {MAX_LANGUAGES} languages' profiles can be sent to every task")
    model = Profiles(rows, profile)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [shared.value.predict(t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([x for x, _ in found], pa.string()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    others = docs.drop("lang_pred", "score", "__text").withColumn("__text", F.col("text"))
    kept = [f for f in others.schema.fields if f.name != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return others.mapInArrow(run, f"{schema}, lang_pred string, score double")


def predict(docs: DataFrame, training: Column, profile: int = PROFILE) -> DataFrame:
    """identify() with profiles learned from the rows of docs where training holds."""
    learned = learn(docs.filter(training).select("text", "lang"), profile)
    return identify(docs, learned, profile)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder(4) == 2
    learned = learn(docs.filter(~held_out).select("text", "lang"))
    found = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), learned)
    return found.select("doc_id", "held_out", "lang_pred", "score")
