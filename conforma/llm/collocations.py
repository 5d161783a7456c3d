"""Phrases whose words come together more often than their parts would, mined by Suffix-sigma.

Every word begins a suffix: its piece's words from there on, at most MAX_WORDS of them. Tasks count the equal
suffixes of a block of words, and send those of a language and first word to one bucket, as one row a block and
bucket: a list of words, and suffixes as places in it. A bucket's suffixes are sorted reverse-lexicographically;
then all that begin with one phrase follow each other, and one pass with a stack of open prefixes counts every
phrase (in numpy: a prefix is pushed where one of its words differs from the row above, and popped with its sum
at the next such row). Phrases are joined with their parts afterwards.

The number of buckets follows the texts' size. A first word (or longer prefix) that would fill much of a bucket is
dealt by its next word as well; a small sample of the rows says which, and has no influence on the result, as the
sums of such prefixes are added up over buckets.

Defined cases: a null text has no words; a null language is ``und``; repeated rows and rows without an id count as
often as they are there; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, binaries, mix64, table

MAX_WORDS = 3
LEAST = 10
KEPT = 2000
SHARE = 50
BLOCK_WORDS = 3_000_000
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
SAMPLE_BYTES = 20 << 20

_LETTERS = bytes(range(65, 91))
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_LETTERS + _BREAKS + b"\t", _LETTERS.lower() + b"." * len(_BREAKS) + b" ")
_BREAK = b"."


class Words(dict):
    """Numbers of words in the order of their first use; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, self), np.uint64, len(self))


def word_runs(texts: list[bytes]):
    """Lists of words of some texts, with a break after each piece, a few megabytes at a time."""
    raw = _BREAK.join([*texts, b""]).translate(_FOLD).replace(_BREAK, b" . ")
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + CHUNK_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def suffixes(ids: np.ndarray, max_words: int) -> list[np.ndarray]:
    """Columns of the suffixes that begin at any but the last max_words - 1 places."""
    n = len(ids) - max_words + 1
    starts = np.flatnonzero(ids[: max(n, 0)])
    columns = [ids[starts]]
    for d in range(1, max_words):
        columns.append(np.where(columns[-1] == 0, 0, ids[starts + d]))
    return columns


def row_keys(columns: list[np.ndarray], size: int) -> np.ndarray:
    """A number for each row of columns of numbers below size; it orders rows by their columns."""
    key, top = columns[0].astype(np.int64), size
    for column in columns[1:]:
        if top > (1 << 62) // size:
            seen, key = np.unique(key, return_inverse=True)
            top = len(seen) + 1
        key, top = key * size + column, top * size
    return key


def counted_rows(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows, and how often each is there."""
    key = row_keys(columns, size)
    order = np.argsort(key)
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    return [c[order[starts]] for c in columns], np.diff(starts, append=len(key))


def prefix_hashes(columns: list[np.ndarray], hashes: np.ndarray, lang: str) -> list[np.ndarray]:
    """A hash of the first 1, 2, ... words of each row, with the language."""
    seed = np.uint64(zlib.crc32(lang.encode("utf-8", "surrogatepass")))
    with np.errstate(over="ignore"):
        out = [mix64(hashes[columns[0]] ^ (seed << np.uint64(32)))]
        for column in columns[1:]:
            out.append(mix64(out[-1] * np.uint64(31) + hashes[column]))
    return out


def dealt(prefixes: list[np.ndarray], hot: np.ndarray, buckets: int) -> np.ndarray:
    """Each row's bucket: by its first word's hash, by that of more words as long as the prefix is hot."""
    place = prefixes[0]
    for d in range(1, len(prefixes)):
        place = np.where(np.isin(prefixes[d - 1], hot), prefixes[d], place)
    return (place % np.uint64(buckets)).astype(np.int64)


def language_texts(batch):
    langs = batch.column(0).to_pylist()
    return zip(["und" if x is None else x for x in langs], batch.column(1).cast(pa.binary()).to_pylist(), strict=True)


def packed(columns: list[np.ndarray], counts: np.ndarray, bucket: np.ndarray, vocabulary: np.ndarray, lang: str) -> pa.RecordBatch:
    """A row for each bucket: its words, its suffixes' columns of places in that list, their counts."""
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    words, places = [], []
    for rows in np.split(order, starts[1:]):
        used, place = np.unique(np.concatenate([[0], *(c[rows] for c in columns)]), return_inverse=True)
        words.append(b" ".join(vocabulary[used[1:]]))
        places.append(place[1:].astype("<u2" if len(used) < 1 << 16 else "<u4").tobytes())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(words), pa.string()),
            pa.array(bucket[order[starts]], pa.int64()),
            pa.array(words, pa.binary()),
            pa.array(places, pa.binary()),
            binaries(counts[order].astype("<u4"), np.diff(starts, append=len(order))),
        ],
        names=["lang", "bucket", "words", "places", "counts"],
    )


def block_rows(docs: DataFrame, max_words: int, hot: np.ndarray, buckets: int, block_words: int) -> DataFrame:
    """lang, bucket, words, places, counts: each task's suffixes, a block of words at a time."""

    def run(batches):
        words, parts, waiting = Words(), defaultdict(list), defaultdict(list)
        held = size = 0

        def read():
            nonlocal held, size
            for lang, texts in waiting.items():
                for run_ in word_runs(texts):
                    ids = words.numbers(run_)
                    parts[lang].append(ids)
                    held += len(ids)
                    if held >= block_words:
                        yield from flush()
            waiting.clear()
            size = 0

        def flush(last: bool = False):
            """Sends the held words' suffixes; those that a later word may continue are held on."""
            nonlocal words, parts, held
            vocabulary, hashes = np.array(list(words), object), words.hashes()
            again, rest = Words(), defaultdict(list)
            for lang, own in parts.items():
                ids = np.concatenate([*own, np.zeros(max_words - 1, np.int32)] if last else own)
                columns = suffixes(ids, max_words)
                if len(columns[0]):
                    columns, counts = counted_rows(columns, len(words))
                    bucket = dealt(prefix_hashes(columns, hashes, lang), hot, buckets)
                    yield packed(columns, counts, bucket, vocabulary, lang)
                if not last and max_words > 1:
                    rest[lang].append(again.numbers(list(vocabulary[ids[1 - max_words :]])))
            words, parts, held = again, rest, 0

        for batch in batches:
            for lang, text in language_texts(batch):
                if text:
                    waiting[lang].append(text)
                    size += len(text)
                    if size >= CHUNK_BYTES:
                        yield from read()
        yield from read()
        yield from flush(True)

    return docs.select("lang", "text").mapInArrow(run, "lang string, bucket long, words binary, places binary, counts binary")


def stack_counts(columns: list[np.ndarray], counts: np.ndarray, end: int):
    """For each depth: rows that begin a prefix of so many words, and the prefix's count. Rows come sorted.

    ``opened`` marks where the stack is unwound to above this depth: there the last prefix is popped and
    this row's is pushed, unless the row has ended before (its word is ``end``).
    """
    opened = np.zeros(len(counts), bool)
    opened[:1] = True
    for column in columns:
        opened[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(opened)
        sums = np.add.reduceat(counts, starts)
        there = column[starts] != end
        yield starts[there], sums[there]


def bucket_counts(rows: pa.Table, lang: str, max_words: int, least: int, hot: np.ndarray) -> pa.Table:
    """phrase, words, a, whole of a bucket's phrases, and a row without a phrase: its number of word occurrences."""
    known, columns, counts = Words(), [[] for _ in range(max_words)], []
    for words, places, number in zip(*(rows[c].to_pylist() for c in ("words", "places", "counts")), strict=True):
        counts.append(np.frombuffer(number, "<u4").astype(np.int64))
        number_of = np.append(np.int32(0), known.numbers(words.split(b" ")))
        width = len(places) // (len(counts[-1]) * max_words)
        place = np.frombuffer(places, f"<u{width}").reshape(max_words, -1)
        for d in range(max_words):
            columns[d].append(number_of[place[d]])
    columns, counts = [np.concatenate(c) for c in columns], np.concatenate(counts)
    vocabulary = np.array(list(known), object)
    size = len(vocabulary)
    falling = np.array(sorted(range(1, size), key=vocabulary.__getitem__, reverse=True), np.int64)
    rank = np.empty(size, np.int64)
    rank[falling] = np.arange(size - 1)
    rank[0] = end = size - 1  # what ends earlier comes after its continuations
    order = np.argsort(row_keys([rank[c] for c in columns], size), kind="stable")
    columns, counts = [c[order] for c in columns], counts[order]
    out = [(None, 0, int(counts.sum()), True)]
    hashes = prefix_hashes(columns, known.hashes(), lang)
    for d, (starts, sums) in enumerate(stack_counts([rank[c] for c in columns], counts, end)):
        parted = np.isin(hashes[d][starts], hot) if d + 1 < max_words else np.zeros(len(starts), bool)
        keep = np.flatnonzero(parted | (sums >= least))
        text = vocabulary[columns[0][starts[keep]]]
        for c in columns[1 : d + 1]:
            text = text + b" " + vocabulary[c[starts[keep]]]
        out += zip(text, [d + 1] * len(keep), sums[keep].tolist(), (~parted[keep]).tolist(), strict=True)
    phrase, n, a, whole = zip(*out, strict=True)
    return pa.table(
        {
            "lang": pa.array([lang] * len(out), pa.string()),
            "phrase": pa.array(phrase, pa.binary()),
            "words": pa.array(n, pa.int32()),
            "a": pa.array(a, pa.int64()),
            "whole": pa.array(whole, pa.bool_()),
        }
    )


def hot_prefixes(docs: DataFrame, max_words: int, size: int, bucket_bytes: int) -> np.ndarray:
    """Hashes of prefixes that would fill a quarter of a bucket or more, by a sample; at most four for each
    bucket and depth."""
    share = min(1.0, max(SAMPLE_BYTES / max(size, 1), 0.001))
    rows = docs if share == 1 else docs.filter(F.rand(11) < share)

    def run(batches):
        for batch in batches:
            for lang, text in language_texts(batch):
                for run_ in word_runs([text or b""]):
                    words = Words()
                    ids = np.append(words.numbers(run_), np.zeros(max_words - 1, np.int32))
                    for own in prefix_hashes(suffixes(ids, max_words), words.hashes(), lang)[:-1]:
                        key, n = np.unique(own, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    if max_words < 2:
        return np.empty(0, np.uint64)
    found = rows.select("lang", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    bytes_a_word = 6
    found = found.filter(F.col("n") * bytes_a_word >= bucket_bytes * share / 4)
    return np.array([r["key"] for r in found.select("key").collect()], np.int64).view(np.uint64)


def phrase_counts(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    least: int = LEAST,
    bucket_bytes: int = BUCKET_BYTES,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of at most max_words words that occur least times or more;
    (lang, n) with the number of words of each language."""
    scratch = Scratch(docs.sparkSession, "collocations")
    rows = docs.select("lang", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(16, math.ceil(size / bucket_bytes))
    hot = hot_prefixes(rows, max_words, size, bucket_bytes)
    blocks = block_rows(rows, max_words, hot, buckets, block_words)
    counted = blocks.groupBy("lang", "bucket").applyInArrow(
        lambda key, t: bucket_counts(t, key[0].as_py(), max_words, least, hot),
        "lang string, phrase binary, words int, a long, whole boolean",
    )
    counted = scratch.write(counted.withColumn("phrase", F.col("phrase").cast("string")), "counts")
    total = counted.filter("phrase is null").groupBy("lang").agg(F.sum("a").alias("n"))
    found = counted.filter("phrase is not null")
    parted = found.filter("not whole").groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))
    parted = parted.filter(F.col("a") >= least)
    return found.filter("whole").select("lang", "phrase", "words", "a").unionByName(parted), total


def collocations(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    least: int = LEAST,
    kept: int = KEPT,
    share: int = SHARE,
    bucket_bytes: int = BUCKET_BYTES,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two words or more.

    A phrase that occurs a times is scored by its worst cut into a part that occurs l and one that occurs r times:
    floor(1000000 a a / (l r)), in decimals of 38 digits. It goes if a longer phrase that holds it has share percent
    of its occurrences or more.
    """
    parts, total = phrase_counts(docs, max_words, least, bucket_bytes, block_words)
    scratch = Scratch(docs.sparkSession, "collocations-scores")
    candidates = parts.filter("words >= 2")
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    of_left = parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    of_right = parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    both = cuts.join(of_left, ["lang", "left"]).join(of_right, ["lang", "right"])
    wide = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    both = both.withColumn("above", F.lit(1000000).cast("decimal(7,0)") * (wide["a"] * wide["a"]))
    both = both.withColumn("score", F.expr("above div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = both.groupBy("lang", "phrase", "a").agg(least_cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    longer = candidates.filter("words >= 3").withColumn("w", F.split("phrase", " "))
    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    )
    inside = longer.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("of_longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("of_longer").alias("of_longer"))
    stay = scored.join(inside, ["lang", "phrase"], "left")
    stay = stay.filter(F.coalesce(100 * F.col("of_longer") < share * F.col("a"), F.lit(True)))
    stay = scratch.write(stay.drop("of_longer"), "scored")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = max(1, math.isqrt(stay.count() // kept))  # either step sorts about as many rows a task
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*best)
    near = stay.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= kept)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    ranked = ranked.filter(F.col("rank") <= kept).join(total, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), total AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM listed GROUP BY lang
), grams AS (
  SELECT lang, words, unnest(list_transform(range(1, CAST(len(w) AS BIGINT) - words + 2),
                                            lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase
  FROM listed, (SELECT unnest([1, 2, 3]) AS words)
), counts AS (
  SELECT lang, words, phrase, count(*) AS a FROM grams GROUP BY lang, words, phrase HAVING count(*) >= 10
), cuts AS (
  SELECT lang, words, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS left_part,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS right_part
  FROM counts, (SELECT unnest([1, 2]) AS k) WHERE k < words
), scored AS (
  SELECT c.lang, c.words, c.phrase, c.a, c.k, x.a AS l, y.a AS r,
         CAST((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.left_part
              JOIN counts y ON y.lang = c.lang AND y.phrase = c.right_part
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '),
                       array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase, a
  FROM counts WHERE words = 3
), longest AS (
  SELECT lang, phrase, max(a) AS of_longer FROM inner_phrases GROUP BY lang, phrase
), ranked AS (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank,
         w.phrase, w.a, w.l, w.r, w.score
  FROM worst w LEFT JOIN longest i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE i.of_longer IS NULL OR 100 * i.of_longer < 50 * w.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
