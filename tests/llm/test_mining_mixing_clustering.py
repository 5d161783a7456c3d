"""Phrases, mixes and clusters: brute force on fixtures, and odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from conforma.llm import ball_kmeans, collocations, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank string, n long, size string"
SMALL = "the of a cat dog sat on mat new york city red hot".split()


def docs(spark, rows):
    full = [(i, t, lang, src, None if t is None else len(t), 0.5, "clash", 7, "clash") for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def text(rng, n):
    out = []
    for i in rng.integers(0, len(SMALL), n):
        out.append(SMALL[i].upper() if rng.random() < 0.2 else SMALL[i])
        out.append(rng.choice([" "] * 12 + [". ", ",", "\n", "\t", "  ", "\x0b", "\r\n"]))
    return "".join(out)


# ---- phrases


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def brute_phrases(rows, max_words=3, least=10, kept=2000):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        scored = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 50 * a for b in longer):
                continue
            cuts = [(10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:kept], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def phrase_rows():
    rng = np.random.default_rng(3)
    rows = [(i, text(rng, int(rng.integers(0, 120))), ["en", "fr", None][i % 3], "s") for i in range(60)]
    rows += [(90, None, "en", None), (91, "", "de", None), (92, " \t\n.,", None, "s"), (None, "new york new york" * 9, "en", "s")]
    rows += [(93, "é ö É Ö " * 30 + "😀 x\x00y " * 12, "fr", "s")] * 2
    rows.append((94, "the cat " * 4000, "en", "s"))  # one very common pair, longer than a block
    rows.append((95, "x" * 30000 + " " + "the new " * 20, "en", "s"))
    return rows


@pytest.mark.parametrize("size", [{}, {"bucket_bytes": 400, "block_words": 500}], ids=["one block", "many blocks"])
def test_phrases(spark, size):
    rows = phrase_rows()
    got = collocations.collocations(docs(spark, rows), **size)
    assert {tuple(r) for r in got.collect()} == brute_phrases(rows)


def test_phrases_of_up_to_four_words_and_few_kept(spark):
    rows = phrase_rows()[:60]
    got = collocations.collocations(docs(spark, rows), max_words=4, least=3, kept=7, bucket_bytes=2000)
    assert {tuple(r) for r in got.collect()} == brute_phrases(rows, 4, 3, 7)


def test_hot_words_and_pairs_are_dealt_to_many_buckets(spark):
    """A third of all words are one word, most in one pair: no bucket holds them all."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"of the w{rng.integers(0, 4000)} v{rng.integers(0, 4000)}" for _ in range(100)), "en", "s") for i in range(60)]
    df = docs(spark, rows).select("lang", "text")
    size = sum(len(r[1]) for r in rows)
    hot = collocations.hot_prefixes(df, 3, size, 4000)
    assert len(hot) >= 2
    blocks = collocations.block_rows(df, 3, hot, 40, 1000).collect()
    held = Counter()
    for r in blocks:
        held[r["bucket"]] += sum(np.frombuffer(r["counts"], "<u4"))
    assert sum(held.values()) == 60 * 400
    assert max(held.values()) < 60 * 400 / 6


def test_score_beyond_64_bits(spark):
    schema = "lang string, phrase string, words int, a long"
    parts = [("en", "a", 1, 4 * 10**12), ("en", "b", 1, 5 * 10**12), ("en", "a b", 2, 3 * 10**12)]
    found = spark.createDataFrame(parts, schema), spark.createDataFrame([("en", 10**13)], "lang string, n long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(collocations, "phrase_counts", lambda *_: found)
        (row,) = collocations.collocations(spark.createDataFrame([], DOCS)).collect()
    assert row["score"] == 10**6 * (3 * 10**12) ** 2 // (20 * 10**24) == 450000


def test_stack_counts_are_prefix_counts():
    rng = np.random.default_rng(1)
    rows = sorted({tuple(sorted(rng.integers(0, 4, 3).tolist())) for _ in range(40)})
    columns = [np.array(c) for c in zip(*rows, strict=True)]
    counts = rng.integers(1, 9, len(rows))
    end = 3
    for d, (starts, sums) in enumerate(collocations.stack_counts(columns, counts, end), 1):
        want = Counter()
        for r, n in zip(rows, counts, strict=True):
            if r[d - 1] != end:
                want[r[:d]] += int(n)
        assert {rows[i][:d]: int(n) for i, n in zip(starts, sums, strict=True)} == want


# ---- mixes


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes, weights=(3, 1, 2), total=1.5, limit=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = total * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > limit * sizes[s]}
        if not above:
            return out | share
        for s in above:
            out[s] = limit * sizes[s]
            left -= out[s]
        free -= above
    return out


def mix_rows():
    rng = np.random.default_rng(8)
    names = ["b", "a", "Z", "é", None, "c", "tiny", "😀"]
    rows = [(i, " ".join(["w"] * int(rng.geometric(0.02))), "en", names[int(rng.geometric(0.4)) % 8]) for i in range(600)]
    rows += [(700 + i, "same text of six small words", "en", "a") for i in range(200)]
    rows += [(1, "x y", "en", "b")] * 5 + [(None, "no id here", "en", "a")] * 4
    rows += [(900, None, "en", "a"), (901, "", "en", None), (902, " \n", "en", "empty"), (903, "long " * 30000, "fr", "c")]
    return rows


@pytest.mark.parametrize("ranked", [2000, 7])
def test_mix(spark, ranked):
    rows = mix_rows()
    found = mixing.mix(docs(spark, rows), ranked=ranked).collect()
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(i), words(t)) for i, t, *_ in rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    want, taken, longest = brute_targets(sizes), Counter(), {s: 0 for s in sizes}
    for r in found:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in sizes:  # lengths are many: the sum is met to a word, but for the source of one long text
        assert abs(taken[s] - want[s]) <= (1 if s != "c" else 30000), s
    again = mixing.mix(docs(spark, rows[::-1]).coalesce(1), ranked=ranked).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mix_takes_whole_rows_as_often_as_it_says(spark):
    rows = mix_rows()
    table = docs(spark, rows)
    mixed = mixing.mix(table)
    got = mixing.take(table, mixed)
    assert got.columns == table.columns
    want = {r.source: r.n for r in mixed.groupBy("source").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect()}
    assert {r["source"]: r["count"] for r in got.groupBy("source").count().collect()} == {s: n for s, n in want.items() if n}


def test_mix_with_other_weights_and_sizes(spark):
    from pyspark.sql import functions as F

    rows = [(i, "x" * (i % 50 + 1), "en", f"s{i % 2}") for i in range(400)]
    found = mixing.mix(docs(spark, rows), weights=(1, 3), total=0.5, size=F.char_length("text"), reserve=20).collect()
    taken = Counter()
    for r in found:
        taken[r.source] += r.copies * r.size
    whole = sum(len(t) for _, t, *_ in rows)
    assert abs(taken["s0"] - whole * 0.125) <= 1
    assert abs(taken["s1"] - whole * 0.375) <= 1


def test_nearest_sum_against_all_sums():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = rng.choice(np.arange(2, 40), int(rng.integers(1, 5)), replace=False)
        counts = rng.integers(1, 5, len(lengths))
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = int(rng.integers(1, 120))
        top = budget + int(lengths.min())
        used = mixing.nearest_sum(lengths, counts, budget, top)
        assert (used <= counts).all()
        assert abs(int((used * lengths).sum()) - budget) == min(abs(s - budget) for s in sums if s <= top)


def test_fit_with_lengths_far_above_the_reserve():
    lengths, counts = np.array([0, 1_000_000, 1_700_000]), np.array([5, 10, 3])
    taken = mixing.fit(lengths, counts, 6_800_000, reserve=1000)
    assert abs(int((taken * lengths).sum()) - 6_800_000) <= 500_000
    assert (taken <= counts).all()


# ---- clusters


def vector_rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.3, (9, 8))
    rows = [(i, (centres[i % 9] + rng.normal(0, 0.05, 8)).tolist()) for i in range(500)]
    rows += [(500 + i, rows[3][1]) for i in range(150)] + [rows[7]] * 5 + [(None, [0.1] * 8), (None, [0.2] * 8)]
    odd = [[0.1] * 7, [0.1] * 9, [], None, [0.1] * 7 + [None], [0.1] * 7 + [float("nan")], [0.1] * 7 + [float("inf")]]
    return rows, [(1000 + i, v) for i, v in enumerate(odd)]


def brute_clusters(rows, k, rounds):
    vecs = [(i, tuple(math.floor(256 * x) for x in np.array(v, np.float32).astype(float).tolist())) for i, v in rows]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(vecs, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for turn in range(rounds + 1):
        got = [nearest(v) for _, v in vecs]
        if turn < rounds:
            for j in range(len(cents)):
                own = [v for (_, v), (_, at) in zip(vecs, got, strict=True) if at == j]
                if own:
                    cents[j] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    return sorted(((str(i), j, d) for (i, _), (d, j) in zip(vecs, got, strict=True))), [list(c) for c in cents]


@pytest.mark.parametrize("k", [1, 12, 900])
def test_clusters(spark, k):
    rows, odd = vector_rows()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, cluster int, distance string")
    found, cents = ball_kmeans.clusters(df.repartition(3), k=k, rounds=3, dim=8)
    want, want_cents = brute_clusters(rows, k, 3)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want
    assert cents.tolist() == want_cents


def test_balls_spare_comparisons_and_keep_ties():
    rng = np.random.default_rng(6)
    cents = rng.integers(-300, 300, (30, 8))
    rows = np.concatenate([cents[rng.integers(0, 30, 3000)] + rng.integers(-9, 10, (3000, 8)), (cents[:1] + cents[1:2]) // 2 * np.ones((3, 1), np.int64)])
    want = ball_kmeans.compared(rows, cents)
    halves = ball_kmeans.quarters(cents)
    best, distance, spent = ball_kmeans.reassigned(rows, want[0], cents, halves)
    assert (best == want[0]).all()
    assert (distance == want[1]).all()
    assert spent < 3000 * 29 / 10
    anywhere = rng.integers(0, 30, len(rows))
    best, distance, _ = ball_kmeans.reassigned(rows, anywhere, cents, halves)
    assert (best == want[0]).all()
    assert (distance == want[1]).all()
    grid = np.array([[0, 0], [2, 0], [0, 2], [2, 2]])  # (1, 1) is as far from all four
    for before in range(4):
        best, _, _ = ball_kmeans.reassigned(np.array([[1, 1]]), np.array([before]), grid, ball_kmeans.quarters(grid))
        assert best[0] == 0


def test_components_of_any_size(spark):
    df = spark.createDataFrame([(1, [3e38] * 4), (2, [-3e38] * 4), (3, [0.0] * 4)], "vec_id long, embedding array<float>")
    found, _ = ball_kmeans.clusters(df, k=2, rounds=2, dim=4)
    assert {r.vec_id for r in found.collect()} == {1, 2, 3}
