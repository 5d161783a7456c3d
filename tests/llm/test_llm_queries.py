"""Every operator on Spark: brute force on a small fixture, and the odd rows that tables may have."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from conforma.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string"
PROSE = "the cat sat on the mat and the dog ran over the green hill to the old house by the river where ".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(PROSE[i] + ("s" if rng.random() < 0.3 else "") + str(int(rng.integers(0, 40)) or "") for i in rng.integers(0, len(PROSE), n))


def rows():
    a = prose(1, 120)
    b = a.split(" ")
    near = " ".join([*b[:60], "changed", *b[61:]])
    passage = prose(9, 70)
    item = prose(5, 20)
    out = [
        (1, a, "en", "s1"),
        (2, a, "en", "s1"),
        (3, near, "en", "s1"),
        (4, prose(2, 30) + " " + passage, "en", "s2"),
        (5, passage + "\n" + prose(3, 40), "en", None),
        (6, prose(4, 50) + " " + item, None, "s2"),
        (7, item.upper(), "en", "s1"),
        (8, None, "en", "s1"),
        (9, "", None, None),
        (10, " \n\t ", "de", "s2"),
        (11, "Der Hund und die Katze sind müde, aber das Haus ist schön. " * 3, "de", "s2"),
        (12, "Der Mann und das Kind gehen in den Wald, wo die Bäume stehen. " * 3, "de", "s2"),
        (13, "Released under the MIT License.\nsome words here", "en", "s1"),
        (14, "Mail a.b@mail.example.com or 10.1.2.3, card 4111111111111111.", "en", "s1"),
        (15, "x " * 5000, "en", "s1"),
        (15, "x " * 5000, "en", "s1"),
        (None, a, "en", "s1"),
        (None, "only here without an id", "en", "s1"),
        (16, "idiot " + prose(6, 40), "en", "s1"),
        (17, "12 34 !!", "en", "s1"),
    ]
    return [(i, t, lang, src, None if t is None else len(t), 0.5, "clash") for i, t, lang, src in out], item


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs, item = rows()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    bench = [(1, item), (2, item + " end"), (10, prose(77, 5)), (3, None), (None, "no id"), (4, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(16, 1, 1), (1, 1, 0), (2, 1, 0), (3, 0, 0), (None, 1, 1), (4, 1, None), (16, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    kinds = {"documents": DOCS, "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int"}
    for name, kind in (kinds | {"embeddings": "vec_id long, embedding array<float>, label int"}).items():
        spark.createDataFrame([], kind).write.parquet(f"{path}/{name}.parquet")
    return path


def collect(spark, path, name):
    return [r.asDict() for r in Q.queries()[name](spark, path).collect()]


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables(spark, empty, name):
    assert collect(spark, empty, name) == []


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_decontaminate(spark, data):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    _, item = rows()
    windows = {}
    for i, t in ((1, item), (2, item + " end"), (10, prose(77, 5))):
        w = words(t)
        for k in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    want = Counter()
    for i, t, *_ in rows()[0]:
        w, hit, items = words(t), set(), set()
        for own, ids in windows.items():
            for k in range(len(w) - len(own) + 1):
                if tuple(w[k : k + len(own)]) == own:
                    hit.update(range(k, k + len(own)))
                    items |= ids
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        want[i, len(w), len(hit), len(items), digest, len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    assert Counter(tuple(r.values()) for r in collect(spark, data, "op1_decontaminate")) == want


def test_benchmark_in_blocks(spark, data):
    from conforma.llm import decontaminate as D

    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    whole, parts = (
        sorted(map(str, D.digest(D.decontaminate(docs, bench, ["doc_id"], **k)).collect()))
        for k in ({}, {"block_bytes": 50, "shard_words": 64})
    )
    assert whole == parts
    docs = docs.union(docs.limit(3))  # copies, and all of a document's columns
    spans = [
        sorted(map(str, D.decontaminate(docs, bench, **k).collect())) for k in ({}, {"block_bytes": 50, "shard_words": 64})
    ]
    assert spans[0] == spans[1]


def test_pack(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = collect(spark, data, "op2_pack")
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t, *_ in rows()[0]:
        if i in (None, 15):
            continue
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for start, length, crc, total in sorted(pieces[i]):
            assert (start, total) == (at, len(ids))
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)


def test_language(spark, data):
    got = {r["doc_id"]: r for r in collect(spark, data, "op3_language")}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (8, 9, 10, 17))
    assert {got[i]["lang_pred"] for i in (11, 12)} == {"de"} and got[1]["lang_pred"] == "en"
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 for r in got.values())


def held_out(spark, sf, name, truth, column):
    """(truth, result) of the query's held-out rows on a test table; rows without a truth are left out."""
    path = Path("/root/testdata") / sf
    if not path.exists():
        pytest.skip("no test tables")
    known = spark.read.parquet(f"{path}/{truth}.parquet").select("doc_id", column).dropna()
    rows = Q.queries()[name](spark, str(path)).filter("held_out").join(known, "doc_id").collect()
    assert rows
    return rows


def test_language_of_held_out_texts(spark):
    rows = held_out(spark, "sf0.01", "op3_language", "documents", "lang")
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_toxicity_of_held_out_texts(spark):
    """Of toxic texts four fifths are found, of others at most one in twenty is taken for one."""
    rows = held_out(spark, "sf0.1", "op6_toxicity", "labels", "toxic")
    found, false = ([r.predicted for r in rows if bool(r.toxic) == kind] for kind in (True, False))
    assert sum(found) >= 0.8 * len(found) and sum(false) <= 0.05 * len(false)


def test_pii(spark, data):
    got = {r["doc_id"]: r for r in collect(spark, data, "op4_pii")}
    assert got[8]["text"] is None and got[9]["text"] == "" and got[1]["text"] == rows()[0][0][1]
    assert (got[14]["n_email"], got[14]["n_ip"], got[14]["n_card"]) == (1, 1, 1)
    assert not re.search("a.b@mail|10\\.1\\.2\\.3|4111111111111111", got[14]["text"])


def test_quality(spark, data):
    got = collect(spark, data, "op5_quality")
    assert len(got) == len(rows()[0])
    by = {r["doc_id"]: r for r in got}
    for i, t, *_ in rows()[0]:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert by[i]["n_words"] == len(w) and by[i]["word_chars"] == sum(map(len, w))
        failed = len(w) < 20 or 100 * by[i]["n_repeat_words"] > 30 * len(w)
        assert by[i]["base_failed"] == failed and (not failed or not by[i]["kept"])
    assert by[1]["kept"] and by[15]["n_repeat_words"] == 5000


def test_sketch_quantiles(spark):
    from conforma.llm import quality
    from pyspark.sql import functions as F

    df = spark.range(1, 401).select(
        F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(100).alias("n_words"),
        (F.col("id") * 10).alias("word_chars"), F.lit(0).alias("n_symbols"), F.lit(0).alias("n_dup_lines"),
        F.lit(1).alias("n_lines"), F.lit(0).alias("n_repeat_words"),
    )
    got = {r["metric"]: r for r in quality.quantiles(quality.sketches(df), ["lang", "source"]).collect()}
    for name, want in (("low", 4), ("mid", 20), ("high", 36)):
        assert got["word_length"][name] == pytest.approx(want, rel=quality.GAMMA - 1)
    assert got["symbols"]["high"] == 0


def quality_corpus():
    """Clean texts of groups with different habits, and texts that only one metric's own fence rejects."""
    rng = np.random.default_rng(8)
    docs, odd = [], {}
    for lang, source, n, base in (("en", "a", 300, 4), ("en", "b", 40, 5), ("de", "a", 120, 9), (None, "c", 7, 5)):
        for _ in range(n):
            words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(base - 2, base + 3)))) for _ in range(int(rng.integers(30, 60)))]
            if source == "b" and rng.random() < 0.5:
                words[3] += "#" * int(rng.integers(1, 5))
            docs.append((" ".join(words), lang, source))
    base = docs[0][0].split()
    for kind, text in (
        ("word_length", " ".join(w * 5 for w in base)), ("symbols", " ".join([*base, "$$$", "%%%", "###"])),
        ("dup_lines", "\n".join([*(" ".join(base[i : i + 5]) for i in range(0, 40, 5)), *["same line"] * 4])),
        ("repeats", " ".join([*base, *(x for i in range(100) for x in (f"u{i}",)), *base[:12]])),
    ):
        odd[len(docs)] = kind
        docs.append((text, "en", "a"))
    return docs, odd


def test_quality_verdicts_are_those_of_exact_quantiles(spark):
    from conforma.llm import quality as Q

    docs, odd = quality_corpus()
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in Q.judge(df).collect()}
    counts = np.array([Q.counts(t) for t, *_ in docs], float)
    n, lines = np.maximum(counts[:, 0], 1), np.maximum(counts[:, 5], 1)
    units = {"word_length": (1, n, 0), "symbols": (2, n, 1), "dup_lines": (3, lines, 1), "repeats": (4, n, 16)}
    failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
    inside, sure = ~failed, np.ones(len(docs), bool)
    for name, (column, over, unit) in units.items():
        _, tail, reach = Q.METRICS[name]
        outer = (tail, 0.5, 1 - tail)
        unit = unit + n // Q.WORDS_A_SYMBOL if name == "symbols" else unit
        value, spared = counts[:, column] / over, np.maximum(counts[:, column] - unit, 0) / over
        at = lambda keep, p: np.quantile(value[keep & ~failed], p, method="inverted_cdf")  # noqa: B023, E731
        for i, (_, lang, source) in enumerate(docs):
            own, of_lang = (np.array([d[1:k] == (lang, source)[: k - 1] for d in docs]) for k in (3, 2))
            q = np.array([at(np.ones(len(docs), bool), p) for p in outer])
            for group in (of_lang, own):
                size = (group & ~failed).sum()
                q = (size * np.array([at(group, p) for p in outer]) + Q.PRIOR * q) / (size + Q.PRIOR)
            low = q[0] - reach * (q[1] - q[0]) if name == "word_length" else -1
            high = q[2] + reach * (q[2] - q[1])
            inside[i] &= low <= spared[i] <= high
            error = (Q.GAMMA - 1) / 2 * ((1 + reach) * q[2] + reach * q[1])
            sure[i] &= min(abs(spared[i] - low), abs(spared[i] - high)) > error or spared[i] == high == 0
            if name == "word_length" or high > 0:
                assert rows[i][f"high_{name}"] == pytest.approx(high, abs=error)
    assert [bool(rows[i].kept) for i in np.flatnonzero(sure)] == inside[sure].tolist() and sure.mean() > 0.9
    for i, kind in odd.items():
        r = rows[i].asDict()
        mine = {"word_length": r["word_chars"] / r["n_words"], "symbols": r["n_symbols"] / r["n_words"], "dup_lines": r["n_dup_lines"] / r["n_lines"], "repeats": r["n_repeat_words"] / r["n_words"]}
        assert not r["base_failed"] and not r["kept"], kind
        assert [k for k, v in mine.items() if v > r[f"high_{k}"]] == [kind]
    assert np.mean([rows[i].kept for i in range(len(docs)) if i not in odd]) > 0.97


def test_quality_fences_follow_the_habits_of_groups(spark):
    """Groups that differ in one habit each have other fences in that metric, and texts of a habit stay in their group."""
    from conforma.llm import quality as Q

    rng = np.random.default_rng(3)
    docs = []
    for source in ("plain", "long words", "symbols", "lines", "repeats"):
        for k in range(400):
            size = 9 if source == "long words" else 5
            lines = [" ".join("".join(rng.choice(list("abcdefgh"), size)) for _ in range(10)) for _ in range(8)]
            if source == "symbols" and k % 4:
                lines[0] = lines[0].replace(" ", " $ ")
            if source == "lines" and k % 20 == 0:
                lines += [lines[3][:12]] * 3
            if source == "repeats" and k % 20 == 0:
                lines.append("so " + " ".join(lines[5].split()[:9]))
            docs.append((len(docs), "\n".join(lines), "en", source))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    rows = Q.judge(df).collect()
    high = {(r.source, m): r[f"high_{m}"] for r in rows for m in Q.METRICS}
    for source, metric in (("long words", "word_length"), ("symbols", "symbols"), ("lines", "dup_lines"), ("repeats", "repeats")):
        assert high[source, metric] > 1.25 * high["plain", metric], metric
    for source in ("plain", "long words", "symbols", "lines", "repeats"):
        assert np.mean([r.kept for r in rows if r.source == source]) > 0.97, source
    assert len({round(high[s, "repeats"], 6) for s in ("plain", "symbols", "repeats")}) > 1


def test_toxicity(spark, data):
    got = collect(spark, data, "op6_toxicity")
    assert len(got) == len(rows()[0])
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_pitman_yor(spark, data):
    got = collect(spark, data, "op7_pitman_yor")
    toks = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    c = Counter(w for i, t, *_ in rows()[0] if i is None or zlib.crc32(str(i).encode()) % 10 for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = {i: toks(t) for i, t, *_ in rows()[0] if i is not None}
    assert len(got) == len(rows()[0])
    for r in got:
        assert r["train_tokens"] == n and r["score"] < 0
        if r["doc_id"] is None:
            continue
        own = want[r["doc_id"]]
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(c[w] > 0 for w in own)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert r["base_score"] == pytest.approx(base)


def prose_scores(spark, partitions, block_tokens, arrow=10_000):
    from conforma.llm import pitman_yor
    from pyspark.sql import functions as F

    rng = np.random.default_rng(12)
    follow = {w: list(rng.choice(PROSE, 3)) for w in PROSE}

    def walk(n):
        out = [str(rng.choice(PROSE))]
        while len(out) < n:
            out.append(str(rng.choice(follow[out[-1]])))
        return out

    docs = [(i, " ".join(walk(60))) for i in range(200)]
    held = [walk(40) for _ in range(10)]
    docs += [(1000 + i, " ".join(w)) for i, w in enumerate(held)]
    docs += [(2000 + i, " ".join(rng.permutation(w))) for i, w in enumerate(held)]
    docs += [(3000 + i, " ".join("".join(rng.choice(list("qxzjkvw#%19"), 7)) for _ in range(40))) for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
    try:
        rows = pitman_yor.score(df, F.col("doc_id") >= 1000, block_tokens).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    return {r.doc_id: r.score for r in rows}


def test_pitman_yor_ranks_held_out_texts(spark, monkeypatch):
    """Prose above the same words in any order, and both above junk, whatever the partitions and blocks."""
    got = prose_scores(spark, 2, 1 << 20)
    for i in range(10):
        assert got[1000 + i] > got[2000 + i] > got[3000 + i]
    monkeypatch.setattr("conforma.llm.pitman_yor.FAN_IN", 3)  # three levels of merging
    other = prose_scores(spark, 7, 700, 13)
    assert all(other[i] == pytest.approx(x, rel=1e-6) for i, x in got.items())


def test_licences(spark, data):
    got = collect(spark, data, "op8_licences")
    assert len(got) == len(rows()[0])
    assert {r["doc_id"]: r["families"] for r in got if r["families"]} == {13: "MIT"}


def test_wrapped_licences(spark):
    import textwrap

    from conforma.llm import licences

    docs, want = [], {}
    for family in licences.TEMPLATES:
        notice = max(licences.TEMPLATES[family], key=len)
        for mark in ("", " * ", "# ", "// ", "dnl "):
            at = len(docs)
            body = textwrap.indent("\n".join(textwrap.wrap(notice, 40 if len(notice) < 90 else 72)), mark)
            docs.append((at, f"{mark}\n{mark}Copyright someone\n{mark}\n{body}\n{mark}\n\nint x = 1;\nreturn x;"))
            want[at] = family
    docs += [(1000, "some plain words\nin lines that\n\ndeclare nothing at all"), (1001, None), (1002, "Released under the MIT License.\nsome words here")]
    want |= {1000: "", 1001: "", 1002: "MIT"}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(df, licences.train(["some plain words in lines that say nothing"] * 3)).collect()}
    assert {i: ",".join(r.families) for i, r in got.items()} == want
    assert {r.n_licensed for i, r in got.items() if i not in (1000, 1001)} == {1} and got[1001].n_licensed == 0


def licence_rows(text, model):
    """(families, probabilities) of a text's lines and paragraphs, one after another in plain Python."""
    import regex

    from conforma.llm import licences

    def verdict(words):
        own = licences.grams(words)
        z = model.bias.astype(float)
        for g in own & set(model.features):
            z = z + model.weights[model.features.index(g)]
        p = np.exp((z - z.max()) / model.temperature)
        best, p = model.families[int(p.argmax())], p.max() / p.sum()
        pairs = [{g for g in licences.grams(licences.tokens(t)) if g.count(" ") == 1} for t in licences.TEMPLATES.get(best, ())]
        sure = p >= model.least and any(len(own & x) >= licences.CONFIRM * len(x) for x in pairs)
        return [(best, p)] if sure else []

    out = []
    for run in regex.split(licences.BETWEEN, regex.sub(licences.MARKS, "", text or "")):
        own = [licences.tokens(x) for x in run.split("\n")]
        found = [v for words in own for v in verdict(words)]
        whole = verdict([w for words in own for w in words]) if len(own) > 1 else []
        if whole and whole[0][0] not in {f for f, _ in found}:
            found = [v for v in found if v[0] not in whole[0][0]] + whole
        out += found
    return sorted(f for f, _ in out), max((p for _, p in out), default=None)


def test_licences_are_those_of_brute_force(spark):
    import textwrap

    from conforma.llm import licences

    rng = np.random.default_rng(4)
    notices = [t for ts in licences.TEMPLATES.values() for t in ts]
    docs = [(0, None), (1, ""), (2, "\n\n")]
    for i in range(3, 120):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            words = str(rng.choice(notices)).split(" ") if rng.random() < 0.7 else prose(i, 25).split(" ")
            words = [w for w in words if rng.random() > rng.choice([0, 0.1, 0.3])]
            mark = str(rng.choice(["", "# ", "dnl ", " * "]))
            body = textwrap.indent("\n".join(textwrap.wrap(" ".join(words), int(rng.choice([30, 72, 4000])))), mark)
            parts.append(body + str(rng.choice(["\n", f"\n{mark}\n", "\n\n"])))
        docs.append((i, "".join(parts)))
    model = licences.train([prose(i, 12) for i in range(50)])
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        families, p = licence_rows(text, model)
        assert got[i].families == sorted(set(families)) and got[i].n_licensed == len(families)
        assert got[i].n_paragraphs == sum(x.strip(" ") != "" for x in (text or "").split("\n"))
        assert got[i].probability == (None if p is None else pytest.approx(p, rel=1e-4))
    assert {f for r in got.values() for f in r.families} == set(licences.TEMPLATES)


def test_confirmed_texts_have_a_telling_word():
    from conforma.llm import licences

    words = set(licences.telling())
    for templates in licences.TEMPLATES.values():
        for t in templates:
            pairs = {g for g in licences.grams(licences.tokens(t)) if g.count(" ") == 1}
            assert sum(not words & set(g.split(" ")) for g in pairs) < licences.CONFIRM * len(pairs)


def test_licences_of_full_texts_tags_and_neighbours(spark):
    """Heads and grants of full texts, tags, versions and wrapped notices; families that were never taught are unknown."""
    from conforma.llm import licences

    cases = {
        "AGPL": [
            "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Affero General"
            " Public License as\n# published by the Free Software Foundation, either version 3 of the\n# License, or (at your option)"
            " any later version.",
            "// SPDX-License-Identifier: AGPL-3.0-or-later",
        ],
        "Apache-2.0": ["                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/"],
        "BSD": ["SPDX-License-Identifier: BSD-3-Clause"],
        "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 2.5."],
        "CC-BY-SA": [
            "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "Licensed under CC BY-SA 3.0"
        ],
        "EPL-2.0": [
            "/* This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n"
            " * which is available at https://www.eclipse.org/legal/epl-2.0/ */"
        ],
        "GPL": ["GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-2.0-only"],
        "ISC": [
            "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted,"
            " provided that the above\ncopyright notice and this permission notice appear in all copies."
        ],
        "Public domain": [
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or"
            " as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.",
        ],
        "": [
            "SPDX-License-Identifier: Zlib", "Licensed under the Zlib License.", "Licensed under the Academic Free License, version 3.0.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the Harbour Licence as published"
            " by the Harbour Board, either version 3 of the License, or (at your option) any later version.",
            "Licensed under the Harbour Public License, version 2.0.", "Released under the Harbour License.",
            "Permission is granted to copy this document under the terms of the GNU Free Documentation License, Version 1.3.",
            "We compare the GNU General Public License with others.",
        ],
    }
    rows = [(f, t) for f, ts in cases.items() for t in ts]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    words = "rivers carry sand to the sea while towns keep ledgers of grain and boats wait for wind near old stone quays".split()
    model = licences.train([" ".join(words[(i * 7 + j * (i % 5 + 1)) % len(words)] for j in range(9)) for i in range(200)])
    got = {r.doc_id: ",".join(r.families) for r in licences.scan(df, model).collect()}
    assert [(got[i], t) for i, (_, t) in enumerate(rows)] == rows


def test_licence_plan_has_no_python(spark, data):
    plan = Q.queries()["op8_licences"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_jaccard(spark, data):
    got = {r["doc_id"]: r for r in collect(spark, data, "op9_jaccard") if r["doc_id"] is not None}
    sets = {}
    for i, t, *_ in rows()[0]:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets if i is not None}
    for i in root:
        for j in root:
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), root[i]) for i in root}
    assert root[3] == 1 and root[2] == 1


def test_jaccard_of_many_near_copies(spark):
    from conforma.llm import jaccard

    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    texts = [(0, " ".join(base))]
    for i in range(1, 60):
        own = list(base)
        for k in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            own[k] = f"x{i}_{k}"
        texts.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts}
    root = {i: i for i in sets}
    for i in root:
        for j in range(i):
            o = len(sets[i] & sets[j])
            if 100 * o >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert got == root and len(set(root.values())) > 1


def components(texts):
    """By all pairs of texts (id, text)."""
    sets = {}
    for i, t in texts:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    for i in root:
        for j in root:
            if j < i:
                o = len(sets[i] & sets[j])
                if 100 * o >= 75 * len(sets[i] | sets[j]):
                    a, b = root[i], root[j]
                    root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return root


def linked(spark, texts, **parameters):
    from conforma.llm import jaccard

    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return {r.doc_id: r.component_id for r in jaccard.link(docs, **parameters).collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_in_many_blocks(spark, monkeypatch, seed):
    """Families of copies around the threshold, in lists and groups that are cut into parts and blocks."""
    from conforma.llm import jaccard

    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(seed)
    texts = []
    for family in range(6):
        base = [f"f{family}w{i}" if i % 3 else f"c{i}" for i in range(90)]
        for _ in range(int(rng.integers(5, 25))):
            own = list(base)
            for k in rng.choice(90, int(rng.integers(0, 6)), replace=False):
                own[k] = f"x{int(rng.integers(0, 60))}"
            cut = int(rng.integers(0, 12))
            texts.append((len(texts), " ".join(own[cut:] + [f"t{j}" for j in range(int(rng.integers(0, 20)))])))
    want = components(texts)
    assert 6 < len(set(want.values())) < len(texts)
    assert linked(spark, texts, block=300, split=3) == want


def test_jaccard_at_the_threshold_behind_a_longer_leader(spark):
    """B and B with 25 more words are 75/100 similar; in their only common list a long text leads, and
    what they share besides lies behind the other one's first shingles."""
    texts = []
    for k in range(12):
        b = [f"k{k}b{i}" for i in range(79)]
        a = b + [f"k{k}r{i}" for i in range(25)]
        long = b[:5] + [f"k{k}l{i}" for i in range(400)]
        n = len(texts)
        texts += [(n, " ".join(long)), (n + 1, " ".join(b)), (n + 2, " ".join(a))]
        for j in range(1, 70, 7):  # texts that make all of b's other shingles frequent
            texts.append((n + 2 + j, " ".join(b[j : j + 12] + [f"k{k}j{j}f{i}" for i in range(60)])))
        texts = sorted(texts)
    texts = [(i, t) for i, (_, t) in enumerate(texts)]
    want = components(texts)
    assert linked(spark, texts) == want and len(set(want.values())) == len(texts) - 12


def test_few_shared_first_shingles_suffice():
    from conforma.llm import jaccard

    for n in range(1, 60):
        for m in range(n, 60):
            need = -(-75 * (n + m) // 175)
            if need <= n:
                behind = -(-75 * m // 100) - 1
                assert jaccard.least_shared(np.int64(n), np.int64(m)) <= max(1, need - behind)


def test_components_of_a_long_path(spark):
    from conforma.llm.common import Scratch
    from conforma.llm.components import connected

    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 100)], "u long, v long")
    got = {r.node: r.component for r in connected(edges, Scratch(spark, "test")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 90: 90, 100: 90}


def test_passages(spark, data):
    got = {(r["doc_id"], r["source_id"]): r for r in collect(spark, data, "op10_passages")}
    assert {(2, 1), (3, 1), (5, 4)} <= set(got)
    assert all(r["end"] - r["start"] >= 50 and r["similarity"] >= 0.75 for r in got.values())
    r = got[5, 4]
    assert (r["start"], r["source_start"]) == (0, 30) and r["end"] == 70
    assert not {d for d, _ in got} & {4, 8, 9, 11, 16}


def test_passages_against_all_pairs(spark):
    """Families of edited passages among other words and lines that recur everywhere: at least nine in ten of the
    documents that a comparison of all pairs of texts finds, and nothing that isn't similar."""
    from conforma.llm import passages

    rng = np.random.default_rng(21)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    lines = [word(20) for _ in range(4)]
    texts = []
    for _ in range(45):
        base = word(int(rng.integers(52, 120)))
        for _ in range(int(rng.integers(2, 5))):
            own = list(base)
            for k in rng.choice(len(own), int(rng.integers(0, 4)), replace=False):
                own[k] = word(1)[0]
            texts.append([*word(int(rng.integers(0, 80))), *lines[int(rng.integers(0, 4))], *own, *word(int(rng.integers(0, 80)))])
    texts += [[*word(60), *lines[i % 4], *word(60)] for i in range(20)]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    want = set()
    sets = [passages.text_shingles(" ".join(t)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if passages.passages(sets[i], sets[j], 46):
                want.add(i)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = passages.repeats(df).collect()
    for r in found:
        a, b = texts[r.doc_id][r.start : r.end], texts[r.source_id][r.source_start : r.source_end]
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        assert r.source_id < r.doc_id and r.end - r.start >= 50 and len(a & b) >= 0.75 * len(a | b)
    got = {r.doc_id for r in found}
    assert len(got & want) >= 0.9 * len(want) and len(want) > 40


@pytest.mark.parametrize("copies,families,words", [(6, 8, 60), (12, 6, 70), (50, 2, 60)])
def test_passages_of_edited_families(spark, copies, families, words):
    """One word changed in each copy, so that many copies are near misses of each other: a comparison of all pairs
    (plain sets of 5-word shingles over all spans of 50 words or more of the copies) is the truth."""
    from conforma.llm import passages

    rng = np.random.default_rng(copies)
    texts, family, place = [], [], []
    for f in range(families):
        for _ in range(copies):
            own = [f"f{f}w{i}" for i in range(words)]
            own[int(rng.integers(0, words))] = f"x{rng.integers(0, 10**9)}"
            head = [f"h{x}" for x in rng.integers(0, 10**9, int(rng.integers(0, 60)))]
            texts.append([*head, *own, *[f"t{x}" for x in rng.integers(0, 10**9, int(rng.integers(0, 60)))]])
            family.append(f)
            place.append(len(head))
    order = rng.permutation(len(texts))
    texts, family, place = ([x[i] for i in order] for x in (texts, family, place))
    cut = lambda i, a, b: {tuple(texts[i][place[i] + k : place[i] + k + 5]) for k in range(a, b - 4)}
    pairs = set()
    for i in range(len(texts)):
        for j in (j for j in range(i) if family[j] == family[i]):
            spans = [(a, b) for a in range(0, words - 49) for b in range(a + 50, words + 1)]
            if any(len(cut(i, *x) & cut(j, *x)) >= 0.75 * len(cut(i, *x) | cut(j, *x)) for x in spans):
                pairs.add((i, j))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = passages.classes(passages.repeats(df)).collect()
    assert all(family[r.doc_id] == family[r.source_id] and r.source_id < r.doc_id and r.class_id <= r.source_id for r in rows)
    for r in rows:
        a, b = texts[r.doc_id][r.start : r.end], texts[r.source_id][r.source_start : r.source_end]
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        assert len(a & b) >= 0.75 * len(a | b)
    want = {i for i, _ in pairs}
    assert len({r.doc_id for r in rows} & want) >= 0.9 * len(want) and len(want) > copies
    of = {r.doc_id: r.class_id for r in rows} | {r.source_id: r.class_id for r in rows}
    assert sum(i in of and of.get(i) == of.get(j) for i, j in pairs) >= 0.9 * len(pairs)


@pytest.mark.parametrize("limit", [1, 256])
def test_passages_behind_other_leaders(spark, monkeypatch, limit):
    """Two documents share a passage; others, of smaller ids and of ids between theirs, have a few words of it each."""
    from conforma.llm import passages

    monkeypatch.setattr(passages, "SLICE", limit)
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    texts, want = [], set()
    for _ in range(20):
        own = word(60)
        few = lambda: [[*word(30), *own[i : i + 12], *word(30)] for i in range(0, 52, 8)]  # noqa: E731, B023
        texts += [*few(), [*word(20), *own, *word(20)], *few(), [*word(40), *own[:30], "changed", *own[31:], *word(9)]]
        want.add((len(texts) - 1, len(texts) - 9))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.source_id) for r in passages.repeats(df).collect()}
    assert got <= want and len(got) >= 19


def test_passages_in_blocks_of_two(spark, monkeypatch):
    from conforma.llm import passages

    monkeypatch.setattr(passages, "OPEN_BLOCK", 2)
    monkeypatch.setattr(passages, "SLICE", 2)
    test_passages_of_edited_families(spark, 6, 8, 60)


def test_passages_take_no_texts(spark):
    """Long documents that share a short passage: pairs take the shingles of what their windows cover, not whole texts."""
    from conforma.llm import passages

    rng = np.random.default_rng(12)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    own = word(80)
    texts = [[*word(4000), *own[:i], "changed", *own[i + 1 :], *word(4000)] for i in (10, 20, 40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    window = "array(struct(0 k, 3980 l, 4090 r, 3980 sl, 4090 sr), struct(3 k, 3990 l, 4080 r, 3990 sl, 4080 sr)) w"
    pairs = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "doc long, source long").selectExpr("doc", "source", window, "false same")
    spans = passages.covered(pairs, 46, 2)
    assert {(r.a, r.b, r.c, r.d) for r in spans.collect()} == {(3990, 4081, 3980, 4091)}
    taken = passages.taken(spans, docs.withColumnRenamed("doc_id", "id"), 5).collect()
    assert len(taken) == 3 and sum(len(r.own) for r in taken) == 3 * 91 * passages.BYTES
    got = passages.verified(pairs, docs, 50, 2, 5).collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(1, 0), (2, 0), (2, 1)}
    for r in got:
        a, b = texts[r.doc_id][r.start : r.end], texts[r.source_id][r.source_start : r.source_end]
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        assert r.similarity == pytest.approx(len(a & b) / len(a | b))


def test_passages_remove_tables_that_no_plan_reads(spark):
    from conforma.llm import passages
    from conforma.llm.common import shared_root

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in [*rng.integers(0, 10**9, 30), *range(100 * (i % 3), 100 * (i % 3) + 80)]) for i in range(12)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    root = Path(shared_root(spark).removeprefix("file:"))
    before = set(root.glob("passages-*"))
    rows = passages.repeats(df)
    assert {r.doc_id for r in rows.collect()} == set(range(3, 12))
    left = {x.name for folder in set(root.glob("passages-*")) - before for x in folder.iterdir()}
    assert "more" in left and not left & {"matched", "pairs", "near", "candidates"}


def test_pipeline(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs
    ids = {}
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, data)
        assert kept.columns == docs.columns
        ids[name] = sorted(r.doc_id or 0 for r in kept.select("doc_id").collect())
    assert 8 not in ids["language"] and 17 not in ids["language"] and 1 in ids["language"]
    assert 2 not in ids["near_duplicates"] and 3 not in ids["near_duplicates"] and ids["near_duplicates"].count(15) == 1
    assert 7 not in ids["contamination"] and 6 not in ids["contamination"] and 16 in ids["contamination"]
    final = P.run(spark, data)
    assert sorted({r.doc_id or 0 for r in final.collect()}) == sorted(set(ids["pseudonyms"]))


@pytest.mark.parametrize("n", [5, 40, 900])
def test_background_lines_are_whole_and_have_the_smallest_hashes(spark, n):
    from conforma.llm import licences
    from pyspark.sql import functions as F

    texts = [(i, "\n".join(f"line {i % 90} {j} " + "word " * (j * 40 + 3) for j in range(4)) + "\nshort\n" + "copied in every text " * 2) for i in range(150)]
    df = spark.createDataFrame([*texts, (None, None)], "doc_id long, text string")
    lines = df.select(F.explode(F.split("text", "\n")).alias("x")).filter("length(x) > 20").distinct()
    want = [r.x for r in lines.orderBy(F.xxhash64("x"), "x").limit(n).collect()]
    got = licences.background(df, n)
    assert got == want and len(got) == min(n, 361) and max(map(len, got)) > 400
    assert licences.background(df.limit(0), n) == []
