"""Exact n-gram Jaccard self-join by T-occurrence search over inverted lists.

Documents with equal shingle sets form one class, represented by its least id. All shingles have one
order, rare ones first (by a merged table of CELLS hashed counts, then by hash). Two sets with the
required overlap share one of each one's first n - ceil(0.75 n) + 1 shingles, so inverted lists of
those name every candidate.

A first round verifies each list's members against its leader, the member with the smallest part of
shingles in no list (the original among its copies), which joins most groups of near copies. What is
left are lists whose members belong to several components; the members of all such lists of one least
id are a group. A second round searches groups without their texts: two members whose first shingles
have t in common share at most t and what is left of the longer set (`least_shared`), which leaves few
members that can be in a pair at all. Only those members' whole sets are fetched and compared. A group
is cut into blocks by hash, and every pair of its blocks is searched by one task.

A search takes a document as the query and merges its inverted lists over its candidates, except for
the longest, which are probed by binary search for what has come far enough (DivideSkip): for a
leader by a heap, for a block with numpy, where the merge counts the lists' concatenation.

Defined cases: a null or wordless text has no shingles and no links; a text of fewer words than a
shingle is one shingle; rows of one id are one document; a null id takes part through its text's
class alone (its component is the class's, null if the class has no id); other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, merged_cells, pack_cells, shingle_hashes, table, utf8, word_hashes
from .components import connected

WIDTH = 5
PERCENT = 75
CELLS = 1 << 20
BLOCK = 1 << 18  # shingles of a block's documents
SPLIT = 1 << 16  # rows of an inverted list in one task
BROADCAST_ROWS = 1_000_000  # candidates' ids, 16 bytes each


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The ascending distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(word_hashes(utf8(text).lower()), width))


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def prefix(own: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles, in the common order, of which a linked set shares one."""
    n = len(own)
    size = n - -(-percent * n // 100) + 1
    return own[np.lexsort((own, counts[cells(own)]))[:size]]


def t_occurrence(lists: list[list[int]], needed: list[int], skip: int | None = None) -> dict[int, int]:
    """Members in at least needed[member] of the ascending lists, with that number.

    DivideSkip: the longest lists are set aside; members found in enough of the others, merged by a
    heap, are looked up in those by binary search. Equal lists are merged once, with a weight.
    """
    weights = Counter(map(tuple, lists))
    by_length = sorted(weights, key=lambda x: (-len(x), x))
    least = min(needed, default=0)
    if skip is None:
        skip = max(0, int((least - 1) / (0.01 * np.log2(max(2, len(by_length[0]) if by_length else 2)) + 1)))
    long, aside = [], 0
    for x in by_length:
        if len(x) < 8 or aside + weights[x] > skip or aside + weights[x] >= least:
            break
        long.append(x)
        aside += weights[x]
    short = by_length[len(long) :]
    heap = [(x[0], k, 0) for k, x in enumerate(short) if x]
    heapq.heapify(heap)
    found = {}
    while heap:
        member, count = heap[0][0], 0
        while heap and heap[0][0] == member:
            _, k, at = heap[0]
            count += weights[short[k]]
            if at + 1 < len(short[k]):
                heapq.heapreplace(heap, (short[k][at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
        if count >= needed[member] - aside:
            for x in long:
                at = bisect_left(x, member)
                if at < len(x) and x[at] == member:
                    count += weights[x]
            if count >= needed[member]:
                found[member] = count
    return found


def search(query: np.ndarray, members: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Which members' sets have the Jaccard similarity with the query's."""
    needed = [max(1, -(-percent * (len(query) + len(m)) // (100 + percent))) for m in members]
    places, owners = [], []
    for j, m in enumerate(members):
        at = np.searchsorted(query, m)
        hit = query[np.minimum(at, len(query) - 1)] == m
        places.append(at[hit])
        owners.append(np.full(int(hit.sum()), j))
    place, owner = np.concatenate(places), np.concatenate(owners)
    by = np.lexsort((owner, place))
    place, owner = place[by], owner[by]
    cuts = np.flatnonzero(np.diff(place)) + 1
    lists = [x.tolist() for x in np.split(owner, cuts)] if len(owner) else []
    return sorted(t_occurrence(lists, needed))


def least_shared(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many of their first shingles two linked sets of n and m share at least.

    They share ceil(percent (n + m) / (100 + percent)) in all. Common ones that are not first in both lie
    behind the first ones of the set whose first ones end earlier, which has ceil(0.75 n) - 1 of those.
    """
    rest = -(-percent * np.maximum(n, m) // 100) - 1
    return np.maximum(1, -(-percent * (n + m) // (100 + percent)) - rest)


def search_blocks(
    sets: list[np.ndarray], component: np.ndarray, block: np.ndarray, percent: int = PERCENT, n: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Places of sets of different components (and blocks, if there are two) with the similarity; one
    pair for each two components that such pairs join.

    With n, sets hold only (shortened hashes of) the first shingles of sets of n, and the pairs are all
    that have least_shared of them.
    """
    size = np.array([len(x) for x in sets], np.int64)
    whole, n_sets = n is None, len(sets)
    if n_sets < 2:
        return []
    n = size if whole else n
    owner = np.repeat(np.arange(n_sets), size)
    _, which, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = df[which] > 1
    which, owner = which[kept], owner[kept]
    by = np.lexsort((owner, which))
    key = which[by] * n_sets + owner[by]
    posting, first = owner[by], np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(df)))])
    starts = np.searchsorted(owner, np.arange(n_sets + 1))
    two = len(np.unique(block)) > 1
    root = {int(c): int(c) for c in component}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for q in np.flatnonzero(block == block.min()):
        needed = -(-percent * (n[q] + n) // (100 + percent)) if whole else least_shared(n[q], n, percent)
        open_ = (component != component[q]) & (100 * np.minimum(n, n[q]) >= percent * np.maximum(n, n[q]))
        open_ &= (block != block[q]) if two else (np.arange(n_sets) > q)
        own = which[starts[q] : starts[q + 1]]
        if not open_.any() or len(own) < needed[open_].min():
            continue
        least = int(needed[open_].min())
        length = first[own + 1] - first[own]
        own = own[np.argsort(-length, kind="stable")]
        skip = min(least - 1, int((least - 1) / (0.01 * np.log2(max(2, length.max())) + 1)))
        long, short = own[:skip], own[skip:]
        merged = np.concatenate([posting[first[x] : first[x + 1]] for x in short])
        counts = np.bincount(merged, minlength=n_sets)
        near = np.flatnonzero(open_ & (counts >= needed - skip))
        if not len(near):
            continue
        if skip:
            wanted = long[:, None] * n_sets + near
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            counts[near] += (key[at] == wanted).sum(0)
        found = near[counts[near] >= needed[near]]
        if not whole:
            out += [(int(q), int(m)) for m in found]
            continue
        for m in found:
            a, b = find(int(component[q])), find(int(component[m]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(q), int(m)))
    return out


def classes(docs: DataFrame, scratch: Scratch, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, key, sig of every document, and the counts of shingles by cell."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            n, keys, sigs = [], [], []
            for x in batch.column(1):
                own = shingles(x.as_py() or "", width)
                n.append(len(own))
                sig = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
                sigs.append(sig)
                keys.append(int.from_bytes(sig[:8], "little", signed=True) if sig else None)
                np.add.at(counts, cells(own), 1)
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(sigs, pa.binary()), *none],
                names=["doc_id", "n", "key", "sig", "chunk", "counts"],
            )
        if id_type is not None:
            used, packed = pack_cells(counts)
            k = len(used)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()),
                 pa.array(used, pa.int32()), pa.array(packed, pa.binary())],
                names=["doc_id", "n", "key", "sig", "chunk", "counts"],
            )

    schema = f"doc_id {kind}, n long, key long, sig binary, chunk int, counts binary"
    both = scratch.write(rows.mapInArrow(run, schema), "documents")

    counts = merged_cells(both.filter("chunk is not null").select("chunk", "counts"), CELLS)
    return both.filter("chunk is null").select("doc_id", "n", "key", "sig"), counts


def lists(
    docs: DataFrame, counts: np.ndarray, width: int = WIDTH, percent: int = PERCENT, split: int = SPLIT
) -> DataFrame:
    """h, key, n, lead, lead_n: the inverted lists of the sets' first shingles that hold two classes or
    more. A list's leader is the member with the smallest part of rarer shingles.

    A task gives each class once, so that copies don't make a list long. A list that could have more than
    split rows (and more than four times the mean of a cell) is cut by the members' keys into parts with
    leaders of their own; a part may then be of one class.
    """
    kind = np.int32 if counts.max() < 1 << 31 else np.int64
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(kind))
    longest = max(split, 4 * int(counts.sum()) // CELLS)

    def emit(batches):
        seen: set[bytes] = set()
        for batch in batches:
            parts, rows = [], 0

            def out():
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "key", "at", "part"])

            for x in batch.column(0):
                own = shingles(x.as_py() or "", width)
                if not len(own):
                    continue
                sig = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                if sig in seen:
                    continue
                seen.add(sig)
                first = prefix(own, shared.value, percent)
                key = int.from_bytes(sig[:8], "little", signed=True)
                at = (len(own) << 32) | np.arange(len(first), dtype=np.int64)
                n_parts = shared.value[cells(first)] // longest + 1
                part = ((key & 0xFFFFFF) % n_parts + np.where(n_parts > 1, 1, 0)).astype(np.int32)
                parts.append((first.view(np.int64), np.full(len(first), key, np.int64), at, part))
                rows += len(first)
                if rows > 200_000:
                    yield out()
                    parts, rows = [], 0
            if rows:
                yield out()

    def shared_only(batches):
        """Rows come by h and part, from the leader on. Goes out: all members of parts of two different
        keys, and of parts of lists that were cut."""
        lead, last, alone = (0, 0, 0), None, False
        for batch in batches:
            h, key, at, part = (batch.column(i).to_numpy() for i in range(4))
            if not len(h):
                continue
            before = last if last is not None else (~h[0], 0, 0)
            old_h, old_key, old_part = (np.append(b, x[:-1]) for b, x in zip(before, (h, key, part), strict=True))
            other = (h != old_h) | (part != old_part)
            new = other | (key != old_key)
            last = h[-1], key[-1], part[-1]
            h, key, n, cut, starts = h[new], key[new], at[new] >> 32, part[new] > 0, other[new]
            if not len(h):
                continue
            # row 0 is the leader of the list that the last batch ended with
            h, key, n = (np.append(a, b) for a, b in zip(lead, (h, key, n), strict=True))
            starts = np.append(True, starts)
            first = np.maximum.accumulate(np.where(starts, np.arange(len(h)), 0))
            go = ~starts
            go[:-1] |= starts[:-1] & ~starts[1:]
            go[1:] |= cut
            if not alone:
                go[0] = False
            lead = h[first[-1]], key[first[-1]], n[first[-1]]
            alone = (bool(starts[-1]) and not go[-1]) or (first[-1] == 0 and alone and not go[0])
            if go.any():
                columns = h[go], key[go], n[go], key[first][go], n[first][go]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "key", "n", "lead", "lead_n"])

    rows = docs.select("text").mapInArrow(emit, "h long, key long, at long, part int")
    share = F.expr("(at & 4294967295L) / shiftright(at, 32)")
    held = rows.repartition("h", "part").sortWithinPartitions("h", "part", share, "key")
    return held.mapInArrow(shared_only, "h long, key long, n long, lead long, lead_n long")


def small(df: DataFrame) -> DataFrame:
    """For a join: sent to all tasks if it has few rows, else left to be shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, text of wanted documents (id)."""
    return docs.select(F.col("doc_id").alias("id"), "text").join(small(wanted), "id", "left_semi")


def verify(docs: DataFrame, pairs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Those pairs (u, v) whose sets have the similarity; best with few different u."""
    kind = pairs.schema["u"].dataType.simpleString()
    of_v = docs.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")).join(small(pairs), "v")
    of_u = _texts(docs, pairs.select(F.col("u").alias("id")).distinct())
    of_u = of_u.select(F.col("id").alias("u"), F.col("text").alias("text_u"))
    rows = of_v.join(of_u, "u").select("u", "v", "text_u", "text_v")

    def run(batches):
        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, at = [], 0
            while at < len(u):  # rows of one query come together
                end, text = at, batch.column(2)[at].as_py()
                while end < len(u) and u[end] == u[at] and batch.column(2)[end].as_py() == text:
                    end += 1
                members = [shingles(batch.column(3)[i].as_py() or "", width) for i in range(at, end)]
                out += [at + j for j in search(shingles(text or "", width), members, percent)]
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(out, pa.int64())) for i in (0, 1)], names=["u", "v"])

    return rows.mapInArrow(run, f"u {kind}, v {kind}").distinct()


def blocked(members: DataFrame, kept: list[str], weight: Column, most: int) -> DataFrame:
    """Rows of groups g, once for every pair (i, j) of their group's blocks that theirs is in.

    A group has as many blocks as its members' weights need, with most of them in each. Rows are dealt by
    pairs of blocks, not by groups.
    """
    groups = members.groupBy("g").agg((F.floor((F.sum(weight) - 1) / most) + 1).alias("blocks"))
    placed = members.join(groups, "g")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    placed = placed.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *kept)
    return placed.repartition("g", "i", "j")


def mixed_lists(held: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """g, rep, n, c, first: the groups of lists whose members are of several components, with the members'
    first shingles (32 bits of each) in such lists."""
    rows = held.select("h", "key").distinct().join(known, "key").select("h", "rep", "n", "c")
    of_list = rows.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("rep").alias("g"))
    mixed = rows.join(of_list.filter("c0 < c1").drop("c0", "c1"), "h")
    code = F.col("h").bitwiseAND(0x7FFFFFFF).cast("int")
    of_rep = mixed.groupBy("rep").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.sort_array(F.collect_list(code)).alias("first"))
    # What two sets of different components share among their first shingles are mixed lists of both; of the
    # others, whichever set's first shingles end earlier has ceil(0.75 n) - 1 left. That bound is least where
    # the partner is smallest or largest.
    least = F.lit(percent / (100 + percent))
    few = F.greatest("n0", percent * F.col("n") / 100)
    many = F.least("n1", 100 * F.col("n") / percent)

    def short_of(other: Column) -> Column:
        return least * (F.col("n") + other) - percent * F.greatest(F.col("n"), other) / 100

    groups = mixed.groupBy("rep", "g").agg(F.min(F.least(short_of(few), short_of(many))).alias("short"))
    able = groups.join(of_rep, "rep").filter(F.size("first") + 1 >= F.col("short"))
    return able.select("g", "rep", "n", "c", "first")


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession, "jaccard")
    members, counts = classes(docs, scratch, width)
    reps = members.filter("key is not null").groupBy("key", "sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    reps = scratch.write(reps, "classes")
    named = reps.filter("rep is not null").select("key", "rep")
    held = scratch.write(lists(docs, counts, width, percent, split), "lists")
    near = percent * F.greatest("n", "lead_n") <= 100 * F.least("n", "lead_n")
    pairs = held.filter((F.col("key") != F.col("lead")) & near).select("lead", "key").distinct()
    pairs = pairs.join(named.select(F.col("key").alias("lead"), F.col("rep").alias("u")), "lead")
    pairs = pairs.join(named.withColumnRenamed("rep", "v"), "key").select("u", "v").filter("u <> v")
    pairs = scratch.write(pairs.distinct(), "pairs")
    edges = scratch.write(verify(docs, pairs, width, percent), "links")
    found = connected(edges, scratch)

    known = reps.filter("rep is not null").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    mixed = scratch.write(mixed_lists(held, known, percent), "mixed")
    if mixed.head(1):
        kind = docs.schema["doc_id"].dataType.simpleString()

        def places(t: pa.Table) -> tuple:
            names = {x: k for k, x in enumerate(t["c"].unique().to_pylist())}
            return np.array([names[x] for x in t["c"].to_pylist()]), t["block"].to_numpy()

        def of_first(t: pa.Table) -> pa.Table:
            sets = [x.values.to_numpy() for x in t["first"]]
            got = search_blocks(sets, *places(t), percent, t["n"].to_numpy())
            chosen = pa.array(sorted({x for pair in got for x in pair}), pa.int64())
            return t.select(["g", "rep", "c", "n"]).take(chosen)

        rows = blocked(mixed, ["rep", "n", "c", "first"], F.size("first"), block)
        able = rows.groupBy("g", "i", "j").applyInArrow(of_first, f"g {kind}, rep {kind}, c {kind}, n long")
        able = scratch.write(able.distinct(), "able")
        scratch.remove("mixed", "lists")

        def of_sets(t: pa.Table) -> pa.Table:
            sets = [shingles(x.as_py() or "", width) for x in t["text"]]
            got = search_blocks(sets, *places(t), percent)
            u, v = ([p[k] for p in got] for k in (0, 1))
            reps = t["rep"].combine_chunks()
            return pa.table({"u": reps.take(pa.array(u, pa.int64())), "v": reps.take(pa.array(v, pa.int64()))})

        rows = blocked(able, ["rep", "c"], F.col("n"), block)
        texts = _texts(docs, able.select(F.col("rep").alias("id")).distinct()).withColumnRenamed("id", "rep")
        rows = rows.join(texts, "rep").repartition("g", "i", "j")
        more = rows.groupBy("g", "i", "j").applyInArrow(of_sets, f"u {kind}, v {kind}")
        more = scratch.write(more.filter("u <> v"), "more")
        found = connected(edges.unionByName(more), scratch, "all")
        scratch.remove("able", "more")
    scratch.remove("pairs", "links")

    of_class = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("key", "sig", F.coalesce("component", "rep").alias("component_id"))
    out = members.join(of_class, ["key", "sig"], "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
