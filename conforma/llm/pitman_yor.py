"""Language-model scores from a hierarchical Pitman-Yor model of words after words, and of their spelling.

The word after another is drawn from that one's restaurant. Words with a
share of at least 1 / OWN of all tokens, by a merged table of CELLS hashed counts, have a restaurant each (at most OWN);
all others share those of their last byte, and a document's begin has one. The parent of all these is the
restaurant of words without a context, whose base distribution spells them, byte by byte; the byte
after two others is drawn from that context's restaurant, whose parent is the shorter context's, whose
parent is that of no context, whose base is uniform. So every word, seen or not, has a probability, and those
of all words and the end sum to 1 in each context.

Seating is sampled by Gibbs sweeps: all customers of a dish are seated anew by the Chinese-restaurant rule,
given the other dishes' tables of the sweep before; tables of the contexts are customers of the parent,
and its tables those of the spelling (at most 2^24 different contexts and bytes, so this is done on the
driver). The first 32 customers of a dish sit down one by one, later ones in groups of a sixteenth of those seated,
of whom the expected number, rounded by chance, open tables. Chance is a hash of word, context, sweep and step, so that
neither partitions nor batches change a sweep. Predictive probabilities are averaged over the sweeps; the
first guess, one table for each dish, doesn't count.

Each task turns its documents, in blocks of bounded size, into a dictionary of words with their contexts
and vectors of (word in context, count). Only dictionaries are shuffled by word; what a word scores in its contexts goes
back to its blocks. A word has one entry a block in such a list, however often it occurs.

Defined cases: a null or empty text is its end token; a null id is in training; repeated documents
each count and give a row; other columns are ignored; an empty table gives an empty result; without
training documents words are spelled uniformly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binaries, id_remainder, merged_cells, mix64, pack_cells, table, unpacked, utf8, word_hashes

BLOCK_TOKENS = 3 << 20
END = b" "
END_BASE = 0.01
END_HASH = np.uint64(0x9E3779B97F4A7C15)
CELLS = 1 << 20
OWN = 1 << 11
CONTEXTS = 256 + OWN
THETA_CONTEXT, THETA_WORD, THETA_BYTE, DISCOUNT_BYTE = 1.0, 1.0, 1.0, 0.5
SWEEPS = 3
BYTE_SWEEPS = 5


def tokens(text: str) -> list[bytes]:
    return utf8(text).lower().split()


def seeds(keys: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(keys.astype(np.uint64) * np.uint64(2) + np.uint64(1) + np.uint64(turn) * np.uint64(0xD1342543DE82EF95))


def seat(customers: np.ndarray, new: np.ndarray, discount: float, seeds: np.ndarray) -> np.ndarray:
    """Tables of dishes whose customers sit down one after the other.

    new: the weight of a new table, (theta + discount * all tables) * base probability. Once more than
    16 sit, a sixteenth as many come together and see the same tables.
    """
    tables = (customers > 0).astype(np.int64)
    seated = tables.copy()
    live = np.flatnonzero(seated < customers)
    step = 0
    while len(live):
        s, t, a = seated[live], tables[live], new[live]
        group = np.minimum(np.maximum(1, s // 16), customers[live] - s)
        p = a / (a + s + (group - 1) / 2 - discount * t)
        step += 1
        with np.errstate(over="ignore"):
            chance = (mix64(seeds[live] + np.uint64(step)) >> np.uint64(11)) * 2.0**-53
        tables[live] += np.floor(group * np.clip(p, 0, 1) + chance).astype(np.int64)
        seated[live] = s + group
        live = live[seated[live] < customers[live]]
    return tables


@dataclass
class Spelling:
    """Probabilities of bytes: those of seen contexts' bytes, and what contexts leave to parents."""

    keys: np.ndarray  # two bytes and the next one, ascending
    probs: np.ndarray  # log of the next one's probability
    left: np.ndarray  # log share of each two-byte context's parent
    parent: np.ndarray  # log probability after one byte, [byte, next]

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """Natural logs of the words' probabilities."""
        raw = np.frombuffer(END.join(words) + END, np.uint8).astype(np.int64)
        before = np.concatenate([[32], raw[:-1]])
        first = np.where(before == 32, 32, np.concatenate([[32, 32], raw[:-2]])[: len(raw)])
        context = (first << 8) | before
        key = (context << 8) | raw
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        seen = self.keys[at] == key if len(self.keys) else np.zeros(len(raw), bool)
        logs = self.left[context] + self.parent[before, raw]
        logs[seen] = self.probs[at[seen]]
        starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])[:-1]])
        return np.add.reduceat(logs, starts)


def spell_counts(words: list[bytes], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of three bytes and how often the words' tables use them."""
    raw = np.frombuffer(END.join(words) + END, np.uint8).astype(np.int64)
    before = np.concatenate([[32], raw[:-1]])
    first = np.where(before == 32, 32, np.concatenate([[32, 32], raw[:-2]])[: len(raw)])
    key = (first << 16) | (before << 8) | raw
    each = np.repeat(weight, [len(w) + 1 for w in words])
    keys, place = np.unique(key, return_inverse=True)
    return keys, np.bincount(place, each, len(keys)).astype(np.int64)


def seat_bytes(keys: np.ndarray, counts: np.ndarray, sweeps: int, seed: int) -> Spelling:
    """Gibbs sweeps over the bytes' restaurants; the last sweep's predictive probabilities."""
    theta, d = THETA_BYTE, DISCOUNT_BYTE
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    context, short, byte = keys >> 8, keys & 0xFFFF, keys & 0xFF
    prob1 = np.full((256, 256), 1 / 256)
    total2, all2 = np.bincount(context, counts, 65536), np.bincount(context, minlength=65536)
    t2 = np.ones(len(keys), np.int64)
    t1, t0 = None, None
    for turn in range(seed * sweeps, (seed + 1) * sweeps):
        parent = prob1[(keys >> 8) & 0xFF, byte]
        t2 = seat(counts, (theta + d * all2[context]) * parent, d, seeds(keys, turn))
        all2 = np.bincount(context, t2, 65536)
        n1 = np.bincount(short, t2, 65536).astype(np.int64).reshape(256, 256)
        t1 = (n1 > 0).astype(np.int64) if t1 is None else t1
        prob0 = np.full(256, 1 / 256)
        for _ in range(2):
            t1 = seat(
                n1.ravel(), ((theta + d * t1.sum(1))[:, None] * prob0).ravel(), d, seeds(np.arange(65536), turn)
            ).reshape(256, 256)
            n0 = t1.sum(0)
            t0 = seat(n0, np.full(256, (theta + d * (t0.sum() if t0 is not None else 256)) / 256), d, seeds(np.arange(256), turn))
            prob0 = (np.maximum(n0 - d * t0, 0) + (theta + d * t0.sum()) / 256) / (theta + n0.sum())
        rest = (theta + d * t1.sum(1))[:, None] * prob0
        prob1 = (np.maximum(n1 - d * t1, 0) + rest) / (theta + n1.sum(1))[:, None]
    left = (theta + d * all2) / (theta + total2)
    probs = (counts - d * t2) / (theta + total2[context]) + left[context] * prob1[(keys >> 8) & 0xFF, byte]
    return Spelling(keys, np.log(probs), np.log(left), np.log(prob1))


@dataclass
class Sample:
    """A sweep's totals, by context and for the parent, and the spelling that they give."""

    tables: np.ndarray
    words: int  # the parent's customers
    word_tables: int
    spelling: Spelling


@dataclass
class Model:
    customers: np.ndarray  # training tokens by context
    context_discount: float
    word_discount: float
    samples: list[Sample]


def base_logs(words: list[bytes], spelling: Spelling) -> np.ndarray:
    logs = np.full(len(words), np.log(END_BASE))
    own = [i for i, w in enumerate(words) if w != END]
    if own:
        logs[own] = np.log1p(-END_BASE) + spelling.log_words([words[i] for i in own])
    return logs


def hashes_of(words: list[bytes]) -> np.ndarray:
    out = np.full(len(words), END_HASH)
    own = [i for i, w in enumerate(words) if w != END]
    if own:
        out[own] = word_hashes(b" ".join([words[i] for i in own]))
    return out


def gibbs(words: list[bytes], owner: np.ndarray, context: np.ndarray, counts: np.ndarray, model: Model | None, last: bool = False):
    """For each of the model's samples: tables of (word, context), customers and tables of words, and the
    pairs' predictive probabilities; at last, unless last, the state that follows, without those.

    owner: the place of each pair's word in words. The first state has one table for each dish.
    """
    with np.errstate(over="ignore"):
        of_word = hashes_of(words)
        of_pair = mix64(of_word[owner] * np.uint64(31) + context.astype(np.uint64))
    tables = (counts > 0).astype(np.int64)
    customers = np.bincount(owner, tables, len(words)).astype(np.int64)
    word_tables = (customers > 0).astype(np.int64)
    samples = model.samples if model else []
    for turn, s in enumerate(samples):
        base = np.exp(base_logs(words, s.spelling))
        d1, d2 = model.word_discount, model.context_discount
        new = (THETA_WORD + d1 * s.word_tables) * base
        p = (customers - d1 * word_tables + new) / (THETA_WORD + s.words)
        rest = (THETA_CONTEXT + d2 * s.tables[context]) * p[owner]
        yield tables, customers, word_tables, (counts - d2 * tables + rest) / (THETA_CONTEXT + model.customers[context])
        if last and turn == len(samples) - 1:
            return
        tables = seat(counts, rest, d2, seeds(of_pair, turn))
        customers = np.bincount(owner, tables, len(words)).astype(np.int64)
        word_tables = seat(customers, new, d1, seeds(of_word, turn))
    yield tables, customers, word_tables, None


def context_table(docs: DataFrame, held_out: Column) -> np.ndarray:
    """The context of every cell of words' hashes, -1 where words share that of their last byte."""

    def run(batches):
        counts, some = np.zeros(CELLS, np.int64), False
        for batch in batches:
            for x in batch.column(0):
                own = word_hashes(utf8(x.as_py() or "").lower())
                np.add.at(counts, (own >> np.uint64(44)).astype(np.int64), 1)
                some = some or len(own) > 0
        if some:
            used, packed = pack_cells(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])

    counts = merged_cells(docs.filter(~held_out).select("text").mapInArrow(run, "chunk int, counts binary"), CELLS)
    frequent = np.flatnonzero((counts > 0) & (counts * OWN >= counts.sum()))
    out = np.full(CELLS, -1, np.int16)
    out[frequent] = 256 + np.arange(len(frequent))
    return out


def contexts_of(words: list[bytes], own: np.ndarray) -> np.ndarray:
    """The restaurants of what follows each word; that of END, the begin of a document, is no word's."""
    found = own[(hashes_of(words) >> np.uint64(44)).astype(np.int64)].astype(np.int64)
    last = np.array([w[-1] for w in words], np.int64)
    return np.where((found >= 0) & (last != 32), found, last)


def blocks(docs: DataFrame, held_out: Column, own: np.ndarray, block_tokens: int) -> DataFrame:
    """Rows of two kinds, by block: (word, first, contexts, counts) and (doc_id, held_out, n_tokens, ids, tfs).

    A word's pairs with its contexts (uint16) have consecutive numbers from first on; counts (uint32) are those of training. ids are the
    differences of a document's ascending pair numbers, tfs its counts (uint32).
    """
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(own)
    schema = (
        f"block long, doc_id {kind}, held_out boolean, n_tokens long, ids binary, tfs binary, "
        "word binary, first int, contexts binary, counts binary"
    )

    def run(batches):
        id_type = None
        number = TaskContext.get().partitionId() << 32

        def rows_of(n, **columns):
            types = dict(
                block=pa.int64(), doc_id=id_type, held_out=pa.bool_(), n_tokens=pa.int64(), ids=pa.binary(),
                tfs=pa.binary(), word=pa.binary(), first=pa.int32(), contexts=pa.binary(), counts=pa.binary(),
            )
            columns["block"] = np.full(n, number)
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in types.items()], names=list(types)
            )

        def flush(words, docs_):
            names = list(words)
            words.clear()
            lengths = np.array([len(p) for _, _, p in docs_], np.int64)
            seq = np.concatenate([p for _, _, p in docs_])
            docs_ = [(d, h) for d, h, _ in docs_]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            rank = np.argsort(-np.bincount(seq, minlength=len(names)), kind="stable")
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            before = contexts_of(names, shared.value).astype(np.int16)[seq]
            before[1:] = before[:-1]
            before[starts] = 32
            # pairs and their places in one array, sorted in place
            bits = len(seq).bit_length()
            keys = place[seq]
            del seq
            keys *= CONTEXTS
            keys += before
            keys <<= bits
            keys |= np.arange(len(keys))
            keys.sort()
            fresh = np.append(True, keys[1:] >> bits != keys[:-1] >> bits)
            pair = keys[fresh] >> bits
            keys &= (1 << bits) - 1
            seq = np.empty(len(keys), np.int32)
            seq[keys] = np.cumsum(fresh, dtype=np.int32) - 1
            del keys, fresh
            train = np.repeat(np.array([not h for _, h in docs_]), lengths)
            counts = np.bincount(seq[train], minlength=len(pair)).astype("<u4")
            word, context = pair // CONTEXTS, (pair % CONTEXTS).astype("<u2")
            first = np.searchsorted(word, np.arange(len(names) + 1))
            for a in range(0, len(rank), 50_000):
                z = min(len(rank), a + 50_000)
                n = np.diff(first[a : z + 1])
                yield rows_of(
                    z - a, word=[names[i] for i in rank[a:z]], first=first[a:z].astype(np.int32),
                    contexts=binaries(context[first[a] : first[z]], n), counts=binaries(counts[first[a] : first[z]], n),
                )
            for a in range(0, len(docs_), 2_000):
                part, ids, tfs = docs_[a : a + 2_000], [], []
                for s, n in zip(starts[a : a + 2_000], lengths[a : a + 2_000], strict=True):
                    own_, tf = np.unique(seq[s : s + n], return_counts=True)
                    ids.append(np.diff(own_, prepend=0).astype("<u4").tobytes())
                    tfs.append(tf.astype("<u4").tobytes())
                yield rows_of(
                    len(part), doc_id=[d for d, _ in part], held_out=[h for _, h in part],
                    n_tokens=lengths[a : a + 2_000], ids=ids, tfs=tfs,
                )

        n, words, docs_ = 0, {}, []
        for batch in batches:
            id_type = batch.column(0).type
            for i in range(batch.num_rows):
                text = tokens(batch.column(2)[i].as_py() or "")
                text.append(END)
                places = np.array([words.setdefault(w, len(words)) for w in text], np.uint32)
                docs_.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), places))
                n += len(text)
                if n >= block_tokens:
                    yield from flush(words, docs_)
                    number += 1
                    n, words, docs_ = 0, {}, []
        if docs_:
            yield from flush(words, docs_)

    return rows.mapInArrow(run, schema)


PLACES = "array<struct<block: long, first: int, contexts: binary>>"


#: Entries of a word that are merged in one row.
FAN_IN = 64


def _merged(rows: DataFrame, places: bool) -> DataFrame:
    """(word, part, contexts, counts (int64)), summed over a row's list p of counts; with p's places, if asked."""
    kind = "<u4" if places else "<i8"

    def run(batches):
        for batch in batches:
            lists = batch.column("p")
            of_place = lists.flatten()
            per_word = np.diff(np.asarray(lists.offsets))
            contexts, n = unpacked(of_place.field("contexts"), "<u2")
            counts, _ = unpacked(of_place.field("counts"), kind)
            owner = np.repeat(np.repeat(np.arange(len(per_word)), per_word), n)
            key, at = np.unique(owner * CONTEXTS + contexts, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, counts.astype(np.int64))
            sizes = np.bincount(key // CONTEXTS, minlength=batch.num_rows)
            out = [*batch.select(["word", "part"]).columns, binaries((key % CONTEXTS).astype("<u2"), sizes), binaries(total, sizes)]
            if places:
                kept = pa.StructArray.from_arrays([of_place.field(c) for c in ("block", "first", "contexts")], names=["block", "first", "contexts"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_word)]), pa.int32())
                out.append(pa.ListArray.from_arrays(offsets, kept))
            yield pa.RecordBatch.from_arrays(out, names=["word", "part", "contexts", "counts", *["places"][: int(places)]])

    return rows.mapInArrow(run, "word binary, part long, contexts binary, counts binary" + (f", places {PLACES}" if places else ""))


def merged_words(split: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(word, contexts (uint16), counts (int64)) over all blocks, and (word, places) by parts of blocks.

    A word's blocks are dealt to parts of about FAN_IN, merged there, then FAN_IN parts at a time, so that no row
    grows with the number of blocks. With one part both are the same table.
    """
    parts = -(-split.select("block").distinct().count() // FAN_IN) or 1
    rows = split.filter(F.col("word").isNotNull()).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
    rows = rows.groupBy("word", "part").agg(F.collect_list(F.struct("block", "first", "contexts", "counts")).alias("p"))
    words = places = scratch.write(_merged(rows, True), "words")
    level = 0
    while parts > 1:
        parts, level = -(-parts // FAN_IN), level + 1
        rows = words.select("word", F.pmod("part", F.lit(parts)).alias("part"), "contexts", "counts")
        rows = rows.groupBy("word", "part").agg(F.collect_list(F.struct("contexts", "counts")).alias("p"))
        words = scratch.write(_merged(rows, False), f"words-{level}")
    return words, places


def _pairs(batch) -> tuple:
    """words, owner, context and count of the pairs in a batch of (word, contexts, counts)."""
    context, n = unpacked(batch.column("contexts"), "<u2")
    counts, _ = unpacked(batch.column("counts"), "<i8")
    return batch.column("word").to_pylist(), np.repeat(np.arange(len(n)), n), context.astype(np.int64), counts


# What a sweep sums: spelled bytes by keys from 0 on, and by these and further down, totals.
_WORDS, _WORD_TABLES, _ONCE, _TWICE, _WORD_ONCE, _WORD_TWICE, _TYPES = range(-1, -8, -1)
_TABLES, _CUSTOMERS = -1_000, -100_000


def _sweep(words: DataFrame, model: Model | None) -> dict:
    """The totals of the model's next state."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, owner, context, counts = _pairs(batch)
            for tables, customers, word_tables, _ in gibbs(own, owner, context, counts, shared.value):  # noqa: B007
                pass
            k = np.arange(CONTEXTS)
            keys = [[_WORDS, _WORD_TABLES, _ONCE, _TWICE, _WORD_ONCE, _WORD_TWICE, _TYPES], _TABLES - k, _CUSTOMERS - k]
            sums = [
                [customers.sum(), word_tables.sum(), (counts == 1).sum(), (counts == 2).sum(), (customers == 1).sum(), (customers == 2).sum(), (customers > 0).sum()],
                np.bincount(context, tables, CONTEXTS), np.bincount(context, counts, CONTEXTS),
            ]
            real = [i for i, w in enumerate(own) if w != END and word_tables[i]]
            if real:
                spelled, n = spell_counts([own[i] for i in real], word_tables[real])
                keys.append(spelled)
                sums.append(n)
            keys, sums = np.concatenate(keys).astype(np.int64), np.concatenate(sums).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[sums > 0]), pa.array(sums[sums > 0])], names=["key", "n"])

    counted = words.select("word", "contexts", "counts").mapInArrow(run, "key long, n long")
    rows = counted.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows["key"].to_pylist(), rows["n"].to_pylist(), strict=True))


def fit(words: DataFrame, sweeps: int = SWEEPS) -> tuple[Model, int]:
    """The model after so many sweeps, and the number of training words."""
    model, types = None, 0
    for turn in range(sweeps + 1):
        found = _sweep(words, model)
        of = lambda key: int(found.get(key, 0))  # noqa: B023, E731
        if model is None:
            by_context = np.array([of(_CUSTOMERS - k) for k in range(CONTEXTS)], np.int64)
            discount = lambda once, twice: min(0.95, max(0.05, of(once) / max(1, of(once) + 2 * of(twice))))  # noqa: B023, E731
            model, types = Model(by_context, discount(_ONCE, _TWICE), discount(_WORD_ONCE, _WORD_TWICE), []), of(_TYPES)
        keys = np.array(sorted(k for k in found if k >= 0), np.int64)
        spelling = seat_bytes(keys, np.array([found[k] for k in keys.tolist()], np.int64), BYTE_SWEEPS, turn)
        model.samples.append(Sample(np.array([of(_TABLES - k) for k in range(CONTEXTS)], np.int64), of(_WORDS), of(_WORD_TABLES), spelling))
    return model, types


def score(
    docs: DataFrame, held_out: Column, block_tokens: int = BLOCK_TOKENS, sweeps: int = SWEEPS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    scratch = Scratch(docs.sparkSession, "pitman-yor")
    split = scratch.write(blocks(docs, held_out, context_table(docs, held_out), block_tokens), "blocks")
    words, places = merged_words(split, scratch)
    model, v = fit(words, sweeps)
    n = int(model.customers.sum())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, owner, context, counts = _pairs(batch)
            states = [x[3] for x in gibbs(own, owner, context, counts, shared.value, last=True)]
            kept = states[1:] or states
            logs = np.log10(np.maximum(sum(kept) / len(kept), 1e-300)).astype("<f4")
            total = np.bincount(owner, counts, len(own)).astype(np.int64)
            sizes = np.bincount(owner, minlength=len(own))
            more = {c: batch.column(c) for c in batch.schema.names if c == "places"}
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("contexts"), binaries(logs, sizes), pa.array(total), *more.values()],
                names=["word", "contexts", "logs", "c", *more],
            )

    def placed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            context, sizes = unpacked(batch.column("contexts"), "<u2")
            logs, _ = unpacked(batch.column("logs"), "<f4")
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            lists = batch.column("places")
            of, per_word = lists.flatten(), np.diff(np.asarray(lists.offsets))
            wanted, each = unpacked(of.field("contexts"), "<u2")
            of_place = np.repeat(np.arange(batch.num_rows), per_word)
            at = np.searchsorted(owner * CONTEXTS + context, np.repeat(of_place, each) * CONTEXTS + wanted)
            yield pa.RecordBatch.from_arrays(
                [of.field("block"), of.field("first"), batch.column("c").take(pa.array(of_place)), binaries(logs[at], each)],
                names=["block", "first", "c", "logs"],
            )

    stats, found = "word binary, contexts binary, logs binary, c long", "block long, first int, c long, logs binary"
    if words is places:
        stats = words.mapInArrow(lambda batches: placed(predict(batches)), found)
    else:
        stats = words.select("word", "contexts", "counts").mapInArrow(predict, stats)
        stats = stats.join(places.select("word", "places"), "word").mapInArrow(placed, found)
    vectors = split.filter(F.col("word").isNull()).select("block", "doc_id", "held_out", "n_tokens", "ids", "tfs")

    def of_block(vectors_: pa.Table, stats_: pa.Table) -> pa.Table:
        stats_ = stats_.take(pa.array(np.argsort(stats_["first"].to_numpy()))).combine_chunks()
        logs, each = unpacked(stats_["logs"].combine_chunks(), "<f4")
        counts = np.repeat(stats_["c"].to_numpy(), each)
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
        known, logs = counts > 0, logs.astype(np.float64)
        out = []
        for ids, tfs in zip(vectors_["ids"], vectors_["tfs"], strict=True):
            own = np.cumsum(np.frombuffer(ids.as_py(), "<u4"), dtype=np.int64)
            tf = np.frombuffer(tfs.as_py(), "<u4").astype(np.int64)
            out.append((tf[known[own]].sum(), float(tf @ base[own]), float(tf @ logs[own])))
        known_, base_, score_ = (np.array(x) for x in zip(*out, strict=True))
        return pa.table(
            {
                "doc_id": vectors_["doc_id"],
                "held_out": vectors_["held_out"],
                "n_tokens": vectors_["n_tokens"],
                "n_known": pa.array(known_.astype(np.int64)),
                "train_tokens": pa.array(np.full(len(out), n)),
                "base_score": pa.array(base_),
                "score": pa.array(score_),
            }
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = vectors.groupBy("block").cogroup(stats.groupBy("block")).applyInArrow(
        of_block,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def query(spark, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), id_remainder(10) == 0)
    return found.drop("perplexity")
