"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its learned vector, if the vocabulary has it, next to the mean of its character
3-grams' vectors. Two gated recurrent layers, one in each direction, read windows of WINDOW words
that overlap by half; attention pools their states, and a text scores as its highest window. The
network is trained on the driver from a bounded sample of labelled rows: at most SAMPLE a label, the
smallest hashes of ids, with all their windows. In each pass a toxic text shows
the window that scores highest (the first time, the one with the most telling words), any other text
that one and some more. Every window of every text is scored.

Defined cases: a null text or one without words scores 0; labels with a null id or value are ignored,
repeated ones count once (toxic if any is); without both labels in the sample every score is 0;
repeated documents each give a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, table
from .decontaminate import words as split_words

WINDOW = 32
STRIDE = 16
SAMPLE = 1500
VOCABULARY = 4096
BUCKETS = 2048
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
EPOCHS = 8
GROUP_WORDS = 100_000
CACHED_WORDS = 150_000


def window_starts(n: int) -> np.ndarray:
    """Where the windows of a text of n words begin; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - WINDOW, STRIDE)
    return np.append(starts, n - WINDOW)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end: the place of each window's words, -1 past a short text's end, and
    each window's text."""
    per_text = [window_starts(int(n)) for n in lengths]
    text = np.repeat(np.arange(len(lengths)), [len(s) for s in per_text])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    starts = np.concatenate([np.empty(0, np.int64), *per_text])
    inner = starts[:, None] + np.arange(WINDOW)
    places = np.where(inner < lengths[text][:, None], begin[text][:, None] + inner, -1)
    return places, text


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character 3-grams of words with blanks around, and each word's first one."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    codes = (raw[:-2] << np.uint64(16)) | (raw[1:-1] << np.uint64(8)) | raw[2:]
    inside = raw[1:-1] != 32
    codes = codes[inside]
    buckets = ((codes * np.uint64(2654435761)) >> np.uint64(13)) % np.uint64(BUCKETS)
    firsts = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]])
    return buckets.astype(np.int64), firsts.astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters, forward pass and gradients. Word 0 is unknown; inputs of absent words are masked."""

    def __init__(self, vocabulary: list[bytes], telling: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        size = WORD_DIM + CHAR_DIM

        def normal(*shape, scale=None):
            return rng.normal(0, scale or 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        p = {
            "word": normal(len(vocabulary) + 1, WORD_DIM, scale=0.1),
            "char": normal(BUCKETS, CHAR_DIM, scale=0.1),
            "A": normal(2 * HIDDEN, ATTENTION),
            "a": np.zeros(ATTENTION, np.float32),
            "v": normal(ATTENTION),
            "w": normal(2 * HIDDEN),
            "b": np.zeros(1, np.float32),
        }
        p["word"][1:, 0] = telling
        for d in "fb":
            p[f"W{d}"] = normal(size, 3 * HIDDEN)
            p[f"U{d}"] = normal(HIDDEN, 3 * HIDDEN)
            p[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
        self.p = p

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """The input vectors of distinct words."""
        ids = np.array([self.ids.get(w, 0) for w in words], np.int64)
        buckets, firsts = char_grams(words)
        sums = np.add.reduceat(self.p["char"][buckets], firsts, axis=0)
        counts = np.diff(np.append(firsts, len(buckets)))[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][ids], sums / counts], 1)

    def projections(self, words: list[bytes]) -> np.ndarray:
        """What the two layers' gates take from each word."""
        x = self.inputs(words)
        return np.concatenate([x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"], 1)

    def _layer(self, d: str, gates: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (steps, windows, HIDDEN); gates and mask are by step in reading order."""
        U, H = self.p[f"U{d}"], HIDDEN
        h = np.zeros((gates.shape[1], H), np.float32)
        states = np.empty((len(gates), gates.shape[1], H), np.float32)
        for t in range(len(gates)):
            hu = h @ U
            zr = sigmoid(gates[t, :, : 2 * H] + hu[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(gates[t, :, 2 * H :] + r * hu[:, 2 * H :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((h, z, r, n, hu[:, 2 * H :]))
            h = np.where(mask[t][:, None], new, h)
            states[t] = h
        return states

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows from projections (steps, windows, 6 HIDDEN) and mask (steps, windows)."""
        p, H = self.p, HIDDEN
        kf, kb = ([], []) if keep is not None else (None, None)
        f = self._layer("f", gates[:, :, : 3 * H], mask, kf)
        b = self._layer("b", gates[::-1, :, 3 * H :], mask[::-1], kb)[::-1]
        states = np.concatenate([f, b], 2)
        u = np.tanh(states @ p["A"] + p["a"])
        e = np.where(mask, u @ p["v"], -1e9)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = (alpha[:, :, None] * states).sum(0)
        if keep is not None:
            keep.update(kf=kf, kb=kb, states=states, u=u, alpha=alpha, pooled=pooled, mask=mask)
        return pooled @ p["w"] + p["b"][0]

    def _back_layer(self, d: str, kept: list, mask: np.ndarray, dstates: np.ndarray, g: dict) -> np.ndarray:
        U, H = self.p[f"U{d}"], HIDDEN
        dgates = np.zeros((len(kept), mask.shape[1], 3 * H), np.float32)
        dh = np.zeros((mask.shape[1], H), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            h, z, r, n, hun = kept[t]
            dh = dh + dstates[t]
            m = mask[t][:, None]
            dnew = np.where(m, dh, 0)
            dz = dnew * (h - n) * z * (1 - z)
            dn = dnew * (1 - z) * (1 - n * n)
            dr = dn * hun * r * (1 - r)
            dgates[t] = np.concatenate([dz, dr, dn], 1)
            dhu = np.concatenate([dz, dr, dn * r], 1)
            g[f"U{d}"] += h.T @ dhu
            dh = np.where(m, dnew * z, dh) + dhu @ U.T
        return dgates

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray, weight: np.ndarray):
        """Loss, gradients and that of the inputs x (steps, windows, WORD_DIM + CHAR_DIM)."""
        p, H = self.p, HIDDEN
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        gates = np.concatenate([x @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"], 2)
        k: dict = {}
        logits = self.forward(gates, mask, k)
        prob = sigmoid(logits)
        loss = -(weight * np.log(np.where(labels, prob, 1 - prob) + 1e-7)).mean()
        dlogit = (weight * (prob - labels) / len(labels)).astype(np.float32)
        g["w"], g["b"] = k["pooled"].T @ dlogit, dlogit.sum(keepdims=True)
        dpooled = dlogit[:, None] * p["w"]
        dalpha = (dpooled[None] * k["states"]).sum(2)
        dstates = k["alpha"][:, :, None] * dpooled[None]
        de = k["alpha"] * (dalpha - (k["alpha"] * dalpha).sum(0))
        du = de[:, :, None] * p["v"] * (1 - k["u"] ** 2)
        g["v"] = (de[:, :, None] * k["u"]).sum((0, 1))
        g["A"], g["a"] = np.einsum("tbi,tbj->ij", k["states"], du), du.sum((0, 1))
        dstates += du @ p["A"].T
        df = self._back_layer("f", k["kf"], mask, dstates[:, :, :H], g)
        db = self._back_layer("b", k["kb"], mask[::-1], dstates[::-1, :, H:], g)[::-1]
        dx = np.zeros_like(x)
        for d, dg in (("f", df), ("b", db)):
            g[f"W{d}"] = np.einsum("tbi,tbj->ij", x, dg)
            g[f"c{d}"] = dg.sum((0, 1))
            dx += dg @ p[f"W{d}"].T
        return loss, g, dx


class _Scorer:
    """Scores texts given as words, keeping the projections of words it has met."""

    def __init__(self, network: Network):
        self.network, self.row, self.table = network, {}, np.empty((0, 6 * HIDDEN), np.float32)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        if len(self.row) > CACHED_WORDS:
            self.row, self.table = {}, np.empty((0, 6 * HIDDEN), np.float32)
        row = self.row
        new = [w for w in dict.fromkeys(words) if w not in row]
        if new:
            base = len(row)
            row.update((w, base + i) for i, w in enumerate(new))
            self.table = np.concatenate([self.table[:base], self.network.projections(new)])
        return np.array([row[w] for w in words], np.int64)

    def window_logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, texts and places of all windows."""
        places, text = windows(np.array([len(t) for t in texts], np.int64))
        if not len(places):
            return np.empty(0, np.float32), text, places
        rows = self._rows([w for t in texts for w in t])
        logits = np.empty(len(places), np.float32)
        for a in range(0, len(places), 4096):
            part = places[a : a + 4096].T
            mask = part >= 0
            gates = self.table[rows[np.maximum(part, 0)]]
            logits[a : a + 4096] = self.network.forward(gates, mask)
        return logits, text, places

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        logits, text, _ = self.window_logits(texts)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, logits)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-best))


def train(texts: list[list[bytes]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    sets = [set(t) for t in texts]
    found: dict[bytes, list[int]] = {}
    for own, y in zip(sets, labels, strict=True):
        for w in own:
            found.setdefault(w, [0, 0])[int(y)] += 1
    n = np.bincount(labels.astype(int), minlength=2)
    common = {w: c for w, c in found.items() if sum(c) > 2}
    odds = {
        w: np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1)) for w, c in common.items()
    }
    best = sorted(common, key=lambda w: (-abs(odds[w]) * np.sqrt(sum(common[w])), w))[:VOCABULARY]
    network = Network(best, np.clip([0.25 * odds[w] for w in best], -1, 1), seed)

    lengths = np.array([len(t) for t in texts], np.int64)
    places, text = windows(lengths)
    distinct = list(dict.fromkeys(w for t in texts for w in t))
    at = {w: i for i, w in enumerate(distinct)}
    flat = np.array([at[w] for t in texts for w in t], np.int64)
    ids = np.array([network.ids.get(w, 0) for w in distinct], np.int64)
    buckets, firsts = char_grams(distinct)
    grams = np.diff(np.append(firsts, len(buckets)))

    telling = np.array([odds.get(w, 0.0) for w in distinct], np.float32)
    logits = np.where(places >= 0, telling[flat[np.maximum(places, 0)]], -9).max(1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch:
            table = network.projections(distinct)
            for a in range(0, len(places), 4096):
                part = places[a : a + 4096].T
                logits[a : a + 4096] = network.forward(table[flat[np.maximum(part, 0)]], part >= 0)
        by = np.lexsort((-logits, text))
        tops = by[np.concatenate([[True], text[by][1:] != text[by][:-1]])]
        more = rng.permutation(np.flatnonzero(~labels[text]))[: len(tops)]
        chosen = rng.permutation(np.concatenate([tops, more]))
        for a in range(0, len(chosen), 128):
            pick = chosen[a : a + 128]
            part = places[pick].T
            mask = part >= 0
            words, back = np.unique(flat[np.maximum(part, 0)], return_inverse=True)
            own = [distinct[w] for w in words]
            back = back.reshape(part.shape)
            x = network.inputs(own)[back]
            y = labels[text[pick]].astype(np.float32)
            _, g, dx = network.gradients(x, mask, y, np.ones(len(y), np.float32))
            sums = np.zeros((len(words), dx.shape[2]), np.float32)
            np.add.at(sums, back[mask], dx[mask])
            g["word"], g["char"] = np.zeros_like(network.p["word"]), np.zeros_like(network.p["char"])
            np.add.at(g["word"], ids[words], sums[:, :WORD_DIM])
            rows = np.concatenate([np.arange(firsts[w], firsts[w] + grams[w]) for w in words])
            share = np.repeat(sums[:, WORD_DIM:] / grams[words][:, None], grams[words], axis=0)
            np.add.at(g["char"], buckets[rows], share)
            step += 1
            for k, v in network.p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return network


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Trains on at most sample labelled rows of either label."""
    known = labels.select("doc_id", "toxic").dropna()
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    by_hash = known.orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = by_hash.filter("toxic").limit(sample).unionByName(by_hash.filter("not toxic").limit(sample))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.toxic, split_words(r.text or "")) for r in texts.toLocalIterator())
    rows = [r for r in rows if r[2]]
    y = np.array([r[1] for r in rows], bool)
    if not y.any() or y.all():
        return None
    return train([r[2] for r in rows], y)


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, n_windows and score of every text."""
    rows = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scorer = _Scorer(shared.value) if shared.value else None
        for batch in batches:
            scores, counts, texts, waiting = [], [], [], 0

            def flush():
                scores.extend(scorer.scores(texts) if scorer else [0.0] * len(texts))  # noqa: B023
                texts.clear()  # noqa: B023

            for x in batch.column(1):
                own = split_words(x.as_py() or "")
                texts.append(own)
                counts.append(len(window_starts(len(own))))
                waiting += len(own)
                if waiting >= GROUP_WORDS:
                    flush()
                    waiting = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(scores, pa.float64())],
                names=["doc_id", "n_windows", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_windows long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = fit(docs, labels.filter(id_remainder(5) != 0))
    return score(docs, network).select(
        "doc_id",
        (id_remainder(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
