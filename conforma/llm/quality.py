"""Quality rules whose thresholds adapt to each language and source.

Every document gives a few counts. Documents that pass the base rules feed quantile sketches of four
metrics, one for each language and source: counts of logarithmic buckets (a value is known to within
GAMMA / 2), which merge by addition. A group's outer and middle quantiles are drawn to its
language's, and those to all documents', as if PRIOR documents of those were in the group, so that small
groups lean on larger ones without a step. A fence lies so many times (reach) as far beyond an outer quantile as
that is from the middle. Nine documents in ten or more repeat no line and no window in any group, so that their habits show
in the last hundredth only: tail and reach belong to a metric. Documents join their group's fences and are kept if all
metrics lie inside; a single symbol, repeated line or repeated window fails no document, nor does a symbol in 200 words.

Defined cases: a null or blank text has zero counts and fails; a null language or source is a group
like any other; repeated documents each count and give a row; other columns are ignored; an empty
table gives an empty result; where no document passes the base rules nothing is fenced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table, utf8

GAMMA = 1.04
SMALLEST = 1e-3
PRIOR = 100
TAIL = 0.1
REACH = 3.0
RARE_TAIL = 0.01
RARE_REACH = 0.5
WORDS_A_SYMBOL = 200

#: Metric: whether low values fail, too; its outer quantiles (tail, 1 - tail) and its reach.
METRICS = {
    "word_length": (True, TAIL, REACH),
    "symbols": (False, TAIL, REACH),
    "dup_lines": (False, RARE_TAIL, RARE_REACH),
    "repeats": (False, RARE_TAIL, RARE_REACH),
}

SHINGLE = 8
_BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
_SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes], width: int = SHINGLE) -> int:
    """Words inside windows of width words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    quick = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for i in range(width):
            key = (key ^ quick[i : i + n]) * _MULTIPLIER
            key ^= key >> np.uint64(29)
    key.sort()
    if (key[1:] != key[:-1]).all():
        return 0
    ids: dict[bytes, int] = {}
    rank = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    have = 1
    while have < width:  # names for windows of twice as many words
        step = min(have, width - have)
        pair = rank[: len(rank) - step] * len(words) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        have += step
    again = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.bincount(again, minlength=len(words) + 1) - np.bincount(
        again + width, minlength=len(words) + 1
    )
    return int((np.cumsum(edge) > 0).sum())


def counts(text: str) -> tuple[int, ...]:
    raw = utf8(text)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(raw.count, _BLANKS)),
        sum(map(raw.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document."""
    rows = docs.select("doc_id", F.col("lang"), F.col("source"), "text")
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])

    def run(batches):
        for batch in batches:
            found = [counts(x.as_py() or "") for x in batch.column(3)]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
            columns = columns or [pa.array([], pa.int64()) for _ in COUNTS]
            names = ["doc_id", "lang", "source", *COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=names)

    return rows.mapInArrow(run, head + "".join(f", {c} long" for c in COUNTS))


def base_failed() -> Column:
    words = F.col("n_words")
    return (words < 20) | (100 * F.col("n_repeat_words") > 30 * words)


def metrics(spared: bool = False) -> dict[str, Column]:
    """The metrics; if spared, without a single occurrence of what they count, or a symbol in WORDS_A_SYMBOL words."""
    words, one = F.greatest(F.col("n_words"), F.lit(1)), int(spared)

    def without(count: str, least: int | Column) -> Column:
        return F.greatest(F.col(count) - least * one, F.lit(0))

    return {
        "word_length": F.col("word_chars") / words,
        "symbols": without("n_symbols", 1 + F.floor(words / WORDS_A_SYMBOL)) / words,
        "dup_lines": without("n_dup_lines", 1) / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": without("n_repeat_words", 2 * SHINGLE) / words,
    }


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: the sketch of each group."""
    step = math.log(GAMMA)

    def bucket(value: Column) -> Column:
        index = F.ceil(F.log(value / SMALLEST) / step).cast("int")
        return F.when(value <= SMALLEST, F.lit(0)).otherwise(index)

    each = F.array(
        *[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metrics().items()]
    )
    rows = measured.select("lang", "source", F.explode(each).alias("m"))
    return rows.groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, docs and the metric's quantiles low, mid and high of sketches merged by keys.

    A window holds one sketch: some hundreds of buckets, however many documents they count.
    """
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    below = F.sum("n").over(group.orderBy("bucket"))
    value = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(
        F.lit(SMALLEST) * F.pow(F.lit(GAMMA), F.col("bucket") - 0.5)
    )
    placed = merged.select(
        *keys, "metric", value.alias("v"), below.alias("below"), F.sum("n").over(group).alias("docs")
    )
    tails = F.create_map(*[F.lit(x) for name, (_, tail, _) in METRICS.items() for x in (name, tail)])[F.col("metric")]
    placed = placed.withColumn("tail", tails)
    at = {"low": F.col("tail"), "mid": F.lit(0.5), "high": 1 - F.col("tail")}
    return placed.groupBy(*keys, "metric").agg(
        F.first("docs").alias("docs"),
        *[F.min(F.when(F.col("below") >= p * F.col("docs"), F.col("v"))).alias(name) for name, p in at.items()],
    )


def fences(sketch: DataFrame, prior: float = PRIOR) -> DataFrame:
    """lang, source, and low_<metric> and high_<metric>."""
    names = ("low", "mid", "high")

    def drawn(own: DataFrame, to: DataFrame, on: Column, keys: list[str]) -> DataFrame:
        docs = F.col("docs").cast("double")
        values = [((F.col(q) * docs + F.col(f"{q}_") * prior) / (docs + prior)).alias(q) for q in names]
        return own.join(to.withColumnsRenamed({c: f"{c}_" for c in to.columns}), on).select(*keys, "metric", *values)

    same = F.col("metric") == F.col("metric_")
    of_lang = drawn(quantiles(sketch, ["lang"]), quantiles(sketch, []), same, ["lang"])
    same &= F.col("lang").eqNullSafe(F.col("lang_"))
    rows = drawn(quantiles(sketch, ["lang", "source"]), of_lang, same, ["lang", "source"])
    out = []
    for metric, (both, _, reach) in METRICS.items():
        mine = F.col("metric") == metric
        low = F.col("low") - reach * (F.col("mid") - F.col("low")) if both else F.lit(-1.0)
        out.append(F.max(F.when(mine, low)).alias(f"low_{metric}"))
        out.append(F.max(F.when(mine, F.col("high") + reach * (F.col("high") - F.col("mid")))).alias(f"high_{metric}"))
    return rows.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the fences that were applied.

    A group's fences are a row; Spark sends them to the tasks or, beyond its broadcast limit, splits
    a hot group's documents (adaptive skew join).
    """
    measured = Scratch(docs.sparkSession, "quality").write(measure(docs), "counts")
    passed = measured.filter(~base_failed())
    limits = fences(sketches(passed), prior).select(
        F.col("lang").alias("lang_"), F.col("source").alias("source_"),
        *[f"{side}_{m}" for m in METRICS for side in ("low", "high")],
    )
    same = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    inside = F.lit(True)
    for name, value in metrics(spared=True).items():
        inside &= F.coalesce(value.between(F.col(f"low_{name}"), F.col(f"high_{name}")), F.lit(True))
    joined = measured.join(limits, same, "left").drop("lang_", "source_")
    failed = base_failed()
    return joined.withColumns({"base_failed": failed, "kept": ~failed & inside})


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", *COUNTS[:5], "base_failed", "kept"
    )
