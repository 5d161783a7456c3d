"""Benchmark decontamination: an FM-index per training shard, searched for test phrases.

A phrase is a run of 13 consecutive words of a test item, or a shorter item as a whole. Each task
takes its documents in shards of bounded size. A shard's words become symbols, where a run of words
that no phrase has is one separator; over those the task builds an FM-index, searches all phrases
backward through wavelet-tree ranks, locates the occurrences by sampled suffix positions and merges
them into spans. Test items are searched in blocks of bounded size, one block in a pass over the documents, so
that no worker holds more than one block. With one block, documents aren't shuffled. With more, each pass
but the last writes the hits of texts that have any, by the texts' digests, into the shared folder; the
last pass's rows are joined with those (by digest, so that copies of a text are found again whatever the
order of rows), and spans merged.

Defined cases: a null or wordless text has no words, spans or items; a test item whose id or text is
null, or without words, has no phrase; items of the same id count as one; repeated documents each
give a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table, utf8
from .fm_index import FMIndex

WINDOW = 13
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 16 << 20

#: A-Z become lower case, bytes of no word become blanks.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)

FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def words(text: str) -> list[bytes]:
    return utf8(text).translate(_FOLD).split()


class Phrases:
    """The distinct phrases of a block of items, as rows of symbols from 1 on."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        symbols: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            row = [symbols.setdefault(w, len(symbols) + 1) for w in words(text)]
            for start in range(max(1, len(row) - window + 1) if row else 0):
                owners.setdefault(tuple(row[start : start + window]), set()).add(item_id)
        self.symbols = symbols
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.rows = np.zeros((len(owners), max(map(len, owners), default=0)), np.int64)
        for i, phrase in enumerate(owners):
            self.rows[i, : len(phrase)] = phrase
        self.ids = sorted({x for s in owners.values() for x in s})
        place = {x: i for i, x in enumerate(self.ids)}
        self.owner = np.array([place[x] for s in owners.values() for x in s], np.int64)
        self.owner_start = np.concatenate([[0], np.cumsum([len(s) for s in owners.values()])])


def _occurrences(shard: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place) of all occurrences; places count the shard's words, one more per document."""
    none = np.empty(0, np.int64)
    if not len(phrases.lengths):
        return none, none
    get = phrases.symbols.get
    flat = np.zeros(sum(map(len, shard)) + len(shard), np.int64)
    at = 0
    for doc in shard:
        flat[at : at + len(doc)] = [get(w, 0) for w in doc]
        at += len(doc) + 1
    kept = np.flatnonzero((flat != 0) | np.concatenate([[True], flat[:-1] != 0]))
    index = FMIndex(np.append(flat[kept], 0), len(phrases.symbols) + 1)
    low, high = index.search(phrases.rows, phrases.lengths)
    counts = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return phrase, kept[index.locate(first + np.arange(len(phrase)))]


def _scan(shard: list[list[bytes]], phrases: Phrases) -> Iterator[tuple[list, list]]:
    """(spans, items) of each document of a shard."""
    starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in shard])])
    change = np.zeros(starts[-1] + 1, np.int64)
    items: list[set[str]] = [set() for _ in shard]
    phrase, place = _occurrences(shard, phrases)
    change += np.bincount(place, minlength=len(change))
    change -= np.bincount(place + phrases.lengths[phrase], minlength=len(change))
    doc = np.searchsorted(starts, place, "right") - 1
    for d, p in np.unique(np.stack([doc, phrase], 1), axis=0):
        own = phrases.owner[phrases.owner_start[p] : phrases.owner_start[p + 1]]
        items[d].update(phrases.ids[o] for o in own)
    hit = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    doc = np.searchsorted(starts, begin, "right") - 1
    spans: list[list] = [[] for _ in shard]
    for d, a, b in zip(doc, begin - starts[doc], end - starts[doc], strict=True):
        spans[d].append({"start": int(a), "end": int(b)})
    for own, found in zip(spans, items, strict=True):
        yield own, sorted(found)


def _pass(rows: DataFrame, shared, shard_words: int) -> DataFrame:
    """rows without their text, __text, which is searched for a block of phrases."""
    kept = [c for c in rows.columns if c != "__text"]
    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept) + FOUND

    def run(batches):
        out_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def flush(parts, shard):
            found = list(_scan(shard, shared.value))
            own = pa.Table.from_batches(parts).combine_chunks().to_batches()[0].columns if kept else []
            return pa.RecordBatch.from_arrays(
                [
                    *own,
                    pa.array([len(d) for d in shard], pa.int64()),
                    pa.array([s for s, _ in found], out_type),
                    pa.array([i for _, i in found], pa.list_(pa.string())),
                ],
                names=[*kept, "n_words", "spans", "items"],
            )

        parts, shard, n = [], [], 0
        for batch in batches:
            texts = batch.column("__text")
            own, start = batch.select(kept), 0
            for i in range(batch.num_rows):
                shard.append(words(texts[i].as_py() or ""))
                n += len(shard[-1]) + 1
                if n >= shard_words:
                    yield flush([*parts, own.slice(start, i + 1 - start)], shard)
                    parts, shard, n, start = [], [], 0, i + 1
            if start < batch.num_rows:
                parts.append(own.slice(start))
        if shard:
            yield flush(parts, shard)

    return rows.mapInArrow(run, schema)


def _joined(spans: pa.Array) -> pa.Array:
    """Spans of each row in order, those that meet or overlap joined."""
    flat, sizes = spans.flatten(), np.diff(np.asarray(spans.offsets))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start, end = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
    shift = owner * (int(end.max(initial=0)) + 1)  # spans of different rows never meet
    order = np.lexsort((start, owner))
    start, end, shift, owner = (x[order] for x in (start, end, shift, owner))
    reach = np.maximum.accumulate(end + shift)
    fresh = np.append(True, start[1:] + shift[1:] > reach[:-1])[: len(start)] | np.append(True, owner[1:] != owner[:-1])[: len(start)]
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(start))[: len(at)] - 1
    out = pa.StructArray.from_arrays([pa.array(start[at]), pa.array((reach - shift)[last])], names=["start", "end"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(sizes)))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), out)


def _with_hits(found: DataFrame, hits: DataFrame) -> DataFrame:
    """found's rows with the spans and items that other passes found in the same text."""
    more = hits.groupBy("__digest").agg(
        F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items")
    )
    joined = F.arrow_udf(_joined, "array<struct<start: long, end: long>>")
    none = [F.array().cast(f"array<{k}>") for k in ("struct<start: long, end: long>", "string")]
    rows = found.join(more, "__digest", "left")
    spans = joined(F.concat("spans", F.coalesce("__spans", none[0])))
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("__items", none[1]))))
    return rows.withColumn("spans", spans).withColumn("items", items).drop("__digest", "__spans", "__items")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs' columns (or those in keep), n_words, spans (of words inside a phrase's occurrence) and
    items (the ids of test items with such phrases)."""
    spark = docs.sparkSession
    tests = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    tests = tests.dropna()
    size = tests.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).head()[0]
    n_blocks = max(1, -(-size // block_bytes))
    others = docs.drop("n_words", "spans", "items")
    keep = [c for c in keep or others.columns if c in others.columns]
    scratch, hits = Scratch(spark, "decontaminate"), []
    for b in range(n_blocks):
        block = tests.filter(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == b)
        shared = spark.sparkContext.broadcast(Phrases([(r.i, r.t) for r in block.collect()], window))
        text, key = F.col("text").alias("__text"), F.sha2(F.col("text").cast("binary"), 256).alias("__digest")
        if b == n_blocks - 1:
            break
        found = _pass(others.select(key, text), shared, shard_words).filter(F.size("items") > 0)
        hits.append(scratch.write(found.drop("n_words").dropDuplicates(["__digest"]), f"pass-{b}"))
        shared.destroy()
    if not hits:
        return _pass(others.select(*keep, text), shared, shard_words)
    found = _pass(others.select(*keep, key, text), shared, shard_words)
    return _with_hits(found, reduce(DataFrame.unionAll, hits))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    return found.select(
        *[c for c in found.columns if c not in ("n_words", "spans", "items")],
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return digest(decontaminate(docs, benchmark, ["doc_id"]))
