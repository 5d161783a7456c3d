"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs LINEAR * n + n * n / capacity: the linear layers plus attention inside the
piece. Whole capacities are cut off long documents first; the rest, in bins of about a million tokens
inside each task, goes in descending order of length to the cheapest sequence that still has room. A
bin has just as many sequences as its tokens need, so that in the end a few pieces find no room as a
whole; those are cut over the sequences with the most room. Padding is less than one sequence a bin,
and nothing is shuffled.

Defined cases: a null or empty text is its end token alone; repeated documents are packed each time;
a text of any length is cut; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

CAPACITY = 1024
LINEAR = 4.0
BIN_TOKENS = 1 << 20
CACHED_CHUNKS = 200_000
END_ID = 0


class _Cache(dict):
    """Bytes of the ids of a chunk of text, worked out when first asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED_CHUNKS:
            self.clear()
        self[chunk] = out = self.encode(chunk)
        return out


def encoder(name: str = "byte_bpe_50k") -> Callable[[str], bytes]:
    """Text to its ids as little-endian uint32 bytes.

    Byte-level BPE never joins across a single blank between two other characters, so the parts
    between such blanks are encoded apart, and most are known already. Texts with runs of blanks or
    with a special token's string are encoded as a whole. The rank file and the tokenizer file hold
    one vocabulary; the tests compare their ids.
    """
    import tiktoken
    from tokenizers import Tokenizer

    special = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    strings = [t.content for t in special.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding(
        name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )

    def encode(text: str) -> bytes:
        return np.array(plain.encode_ordinary(text), "<u4").tobytes()

    after_blank = _Cache(lambda chunk: encode(" " + chunk))

    def ids(text: str) -> bytes:
        if any(s in text for s in strings):
            return np.array(special.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " in text:
            return encode(text)
        first, *rest = text.split(" ")
        return encode(first) + b"".join([after_blank[x] for x in rest])

    return ids


def balance(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, sequence) that pack pieces shorter than capacity."""
    n = max(1, -(-int(lengths.sum()) // capacity))
    room = np.full(n, capacity)
    cheapest = [(0.0, s) for s in range(n)]
    out, left = [], []
    for piece in np.argsort(-lengths, kind="stable"):
        length = int(lengths[piece])
        aside = []
        while cheapest and room[cheapest[0][1]] < length and len(aside) < 16:
            aside.append(heapq.heappop(cheapest))
        if cheapest and room[cheapest[0][1]] >= length:
            s = cheapest[0][1]
        else:  # the cheapest few are full: look at all
            cost = dict((s, c) for c, s in cheapest + aside)
            fits = np.flatnonzero(room >= length)
            s = min(fits, key=lambda x: (cost.get(x, np.inf), x), default=None) if len(fits) else None
        for c, a in aside:
            if room[a]:
                heapq.heappush(cheapest, (c, a))
        if s is None:
            left.append(piece)
            continue
        out.append((piece, 0, length, int(s)))
        room[s] -= length
        extra = LINEAR * length + length * length / capacity
        at = next(i for i, (_, x) in enumerate(cheapest) if x == s)
        c = cheapest[at][0] + extra
        if at == 0:
            heapq.heapreplace(cheapest, (c, s)) if room[s] else heapq.heappop(cheapest)
        else:
            cheapest[at] = (c, s)
            cheapest[:] = [(x, y) for x, y in cheapest if room[y]]
            heapq.heapify(cheapest)
    most = [(-int(r), s) for s, r in enumerate(room) if r]
    heapq.heapify(most)
    for piece in left:
        start, length = 0, int(lengths[piece])
        while start < length:
            r, s = heapq.heappop(most)
            part = min(-r, length - start)
            out.append((piece, start, part, s))
            start += part
            if part < -r:
                heapq.heappush(most, (r + part, s))
    return out


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str = "byte_bpe_50k",
    bin_tokens: int = BIN_TOKENS,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian uint32 as binary), doc_tokens, sequence_id
    (unique), offset."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long"
    )

    def run(batches):
        encode = encoder(tokenizer)
        next_sequence = TaskContext.get().partitionId() << 33
        end = np.array([END_ID], "<u4").tobytes()
        id_type = None

        def flush(pieces, first_sequence):
            """pieces: (doc id, start, ids, doc_tokens), each at most one capacity long."""
            lengths = np.array([len(p[2]) // 4 for p in pieces])
            whole = np.flatnonzero(lengths == capacity)
            rest = np.flatnonzero(lengths < capacity)
            placed = [(i, 0, capacity, s) for s, i in enumerate(whole)]
            placed += [
                (rest[p], start, n, len(whole) + s)
                for p, start, n, s in balance(lengths[rest], capacity)
                if len(rest)
            ]
            used: dict[int, int] = {}
            out = []
            for p, start, n, s in placed:
                doc, at, ids, total = pieces[p]
                offset = used.get(s, 0)
                used[s] = offset + n
                part = ids[4 * start : 4 * (start + n)]
                out.append((doc, at + start, n, part, total, first_sequence + s, offset))
            columns = list(zip(*out, strict=True))
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            ), len(used)

        pieces, n = [], 0
        for batch in batches:
            id_type = batch.column(0).type
            for i in range(batch.num_rows):
                doc = batch.column(0)[i].as_py()
                ids = encode(batch.column(1)[i].as_py() or "") + end
                total = len(ids) // 4
                for at in range(0, total, capacity):
                    pieces.append((doc, at, ids[4 * at : 4 * (at + capacity)], total))
                n += total
                if n >= bin_tokens:
                    out, used = flush(pieces, next_sequence)
                    yield out
                    next_sequence += used
                    pieces, n = [], 0
        if pieces:
            yield flush(pieces, next_sequence)[0]

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
