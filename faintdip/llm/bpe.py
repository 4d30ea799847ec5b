"""Byte-level BPE over whole texts.

Texts are cut into pieces; each distinct piece of a block of texts is encoded once and the
ids of every text are put together from them; decoding joins the pieces of the ids. Nothing
is shuffled, so no key can be hot.

fold_expression() encodes with Spark's higher-order functions and literal ranks. It gives
the same ids but takes some 150 microseconds a piece, so encode() merges all distinct pieces
of a block together with array operations instead (README has the figures).
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import ranges, release, slices

#: Bytes of text in a block, whose distinct pieces are encoded once, and the longest piece that is merged together
#: with others, in as many rounds as it has merges; longer ones take a heap each. Bytes of pieces that are merged together:
#: a round has some ten arrays of eight bytes for each of them.
BLOCK = 2 << 20
FOLD = 64
TOGETHER = 1 << 17
#: Slots (a prime) of each half of the merge table, and the factors that spread right and left over either half.
SLOTS, SPREAD = 262_139, ((1, 65_536), (74_713, 31_337))


def read_ranks(path: str) -> list[bytes]:
    """Pieces by rank from a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    out = [b""] * (1 + max(int(b) for _, b in rows))
    for a, b in rows:
        out[int(b)] = base64.b64decode(a)
    return out


def merge_table(pieces: list[bytes]) -> np.ndarray:
    """A cuckoo table of (left * 2**16 + right) * 2**16 + rank + 1: a key is in one of two slots.

    Every way to part a piece into two pieces is a merge with the rank of the whole.
    """
    if len(pieces) >= 1 << 16:
        raise ValueError("a merge table holds ranks of 16 bits; longer vocabularies are merged piece by piece")
    rank = {p: i for i, p in enumerate(pieces) if p}
    table = [0] * (2 * SLOTS)
    for p, r in rank.items():
        for k in range(1, len(p)):
            if (a := rank.get(p[:k])) is not None and (b := rank.get(p[k:])) is not None:
                entry, half = (((a << 16) + b) << 16) + r + 1, 0
                for _ in range(500):
                    at = half * SLOTS + ((entry >> 16 & 65535) * SPREAD[half][0] + (entry >> 32) * SPREAD[half][1]) % SLOTS
                    entry, table[at] = table[at], entry
                    if not entry:
                        break
                    half = 1 - at // SLOTS
                else:
                    raise ValueError("the merge table is too full")
    return np.array(table)


def literal(values, kind: str) -> str:
    """An array literal that the optimizer folds once, however long."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"


def fold_expression(pieces: list[bytes], word: str) -> str:
    """SQL that folds ranked merges over the bytes of a binary expression; an array of ranks.

    transform over an array of one value stands for "let". The ranks are literal arrays.
    """
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    tab, single = literal(merge_table(pieces).tolist(), "bigint"), {p[0]: i for i, p in enumerate(pieces) if len(p) == 1}
    slot = lambda half: f"get({tab}, cast({half * SLOTS} + (b * {SPREAD[half][0]}L + a * {SPREAD[half][1]}L) % {SLOTS} as int))"
    found = lambda half, other: f"if({slot(half)} div 65536 = a * 65536L + b, {slot(half)} % 65536 - 1, {other})"
    rank = found(0, found(1, "null"))
    merged = "concat(slice(p, 1, c - 1), array(cast(m as int)), slice(p, c + 2, size(p)))"
    best = let("m", "array_min(r)", f"if(m is null, p, {let('c', 'cast(array_position(r, m) as int)', merged)})")
    step = f"if(size(p) < 2, p, {let('r', f'zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (a, b) -> {rank})', best)})"
    start = f"transform(sequence(1, octet_length({word})), i -> get({literal([single[i] for i in range(256)], 'int')}, cast(conv(hex(substring({word}, i, 1)), 16, 10) as int)))"
    return f"aggregate(sequence(1, octet_length({word})), {start}, (p, s) -> {step})"


def merge_with_heap(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ranked merges, always the lowest rank and then the leftmost, in n log n steps."""
    n = len(piece)
    start, nxt, prv = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], alive[j], nxt[i] = end[j], False, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := rank.get(piece[start[i] : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if (h := prv[i]) >= 0 and (r := rank.get(piece[start[h] : end[i]])) is not None:
            heapq.heappush(heap, (r, h, end[i]))
    return [rank[piece[start[i] : end[i]]] for i in range(n) if alive[i]]


NONE = np.int64(1) << 62


def merge_together(raw: np.ndarray, off: np.ndarray, table: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranked merges in many pieces at once: each round does every piece's best merge.

    raw holds the pieces' bytes, off where each begins. Returns ids and how many each has.
    """
    n = len(off) - 1
    ids, owner = single[raw], np.repeat(np.arange(n), np.diff(off))
    count, done = np.zeros(n, np.int64), []
    while len(ids):
        a, b = ids[:-1], ids[1:]
        x = table[(b * SPREAD[0][0] + a * SPREAD[0][1]) % SLOTS]
        y = table[SLOTS + (b * SPREAD[1][0] + a * SPREAD[1][1]) % SLOTS]
        key = (a << 16) + b
        rank = np.where(x >> 16 == key, x & 65535, np.where(y >> 16 == key, y & 65535, 0)) - 1
        best = np.full(len(ids), NONE)
        best[:-1] = np.where((rank >= 0) & (owner[:-1] == owner[1:]), (rank << 32) + np.arange(len(rank)), NONE)
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        least = np.minimum.reduceat(best, begin)
        size = np.diff(np.append(begin, len(ids)))
        over = least == NONE
        if over.any():
            out = np.repeat(over, size)
            done.append((owner[out], ids[out]))
            count[owner[begin[over]]] = size[over]
        at = least[~over] & 0xFFFFFFFF
        ids[at] = least[~over] >> 32
        keep = np.repeat(~over, size)
        keep[at + 1] = False
        ids, owner = ids[keep], owner[keep]
    if not done:
        return np.empty(0, np.int64), count
    begin = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for who, what in done:
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        out[begin[who] + np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))] = what
    return out, count


class Encoder:
    """Encodes lists of texts; equal pieces of a list are encoded once."""

    def __init__(self, pieces: list[bytes], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.rank = {p: i for i, p in enumerate(pieces) if p}
        self.table = merge_table(pieces) if len(pieces) < 1 << 16 else None
        self.single = np.array([self.rank[bytes([i])] for i in range(256)])

    def pieces_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        short = [self.table is not None and len(w) <= FOLD for w in words]
        raw = np.frombuffer(b"".join(w for w, s in zip(words, short) if s), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(w) for w, s in zip(words, short) if s], dtype=np.int64)])
        # pieces have a byte at least and FOLD at most, so every cut is a place of its own
        cuts = np.unique(np.append(np.searchsorted(off, np.arange(0, len(raw), TOGETHER)), len(off) - 1)).tolist()
        done = [merge_together(raw[off[a] : off[b]], off[a : b + 1] - off[a], self.table, self.single) for a, b in zip(cuts, cuts[1:])]
        ids, count = (np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64), np.empty(0, np.int64))
        if all(short):
            return ids, count
        lists = iter(np.split(ids, np.cumsum(count)[:-1]) if len(count) else ())
        lists = [next(lists) if s else np.array(merge_with_heap(w, self.rank)) for w, s in zip(words, short)]
        return np.concatenate(lists), np.array([len(x) for x in lists])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin."""
        number: dict[str, int] = {}
        per, flat = [], []
        for t in texts:
            got = [number.setdefault(p, len(number)) for p in self.find(t)]
            per.append(len(got))
            flat.append(np.array(got, np.int32))
        flat = np.concatenate(flat) if flat else np.empty(0, np.int32)
        value, count = self.pieces_of([p.encode() for p in number])
        n = count[flat] if len(count) else np.empty(0, np.int64)
        begin = np.cumsum(count) - count
        ids = value[np.repeat(begin[flat], n) + ranges(n)] if len(n) else value
        return ids, np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(per, dtype=np.int64)])]


def _encoded(docs: DataFrame, ranks: str, pattern: str, id_col: str, text_col: str, block: int, build, kind: str) -> DataFrame:
    pieces = read_ranks(ranks)

    def run(batches):
        encoder = Encoder(pieces, pattern)
        for batch in batches:
            for i, buf, off in slices(batch.column(1), block):
                raw, at = buf.tobytes(), off.tolist()
                ids, begin = encoder([raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])])
                names, cols = build(pieces, ids, begin)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(at) - 1), *cols], [id_col, *names])
                del raw, ids, begin, cols
            release()

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` long, {kind}")


def encode(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: the id, and ids (array<int>) of the whole text.

    ranks is the path of a rank file on the driver, pattern the expression whose matches are
    encoded one by one. Null and empty texts have no ids; null ids, ties and repeated rows
    pass through; other columns are ignored. Bytes that aren't UTF-8 become U+FFFD first.
    """

    def build(pieces, ids, begin):
        return ["ids"], [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))]

    return _encoded(docs, ranks, pattern, id_col, text_col, block, build, "ids array<int>")


def decode(docs: DataFrame, ranks: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row of docs: the id, and decoded (binary), the pieces of its ids joined.

    A null list gives null; an unknown or null id raises an error. Ties and repeated rows pass
    through, an empty table gives none, other columns are ignored.
    """
    piece = {i: p for i, p in enumerate(read_ranks(ranks)) if p}

    def run(batches):
        for batch in batches:
            out = [None if x is None else b"".join(map(piece.__getitem__, x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` long, decoded binary")


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, texts: bool = False, lists: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_tokens, ids_sha256 (little-endian unsigned 32-bit
    ids) and decoded_sha256 of the ids' pieces joined; with texts also decoded (binary) itself,
    with lists also ids (array<int>).

    Edge cases are those of encode().
    """

    def build(pieces, ids, begin):
        raw, end = ids.astype("<u4").tobytes(), begin.tolist()
        decoded = [b"".join(map(pieces.__getitem__, ids[a:b].tolist())) for a, b in zip(end, end[1:])]
        cols = [
            pa.array(np.diff(begin)),
            pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(end, end[1:])]),
            pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
        ]
        if texts:
            cols.append(pa.array(decoded, pa.binary()))
        if lists:
            cols.append(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32())))
        return ["n_tokens", "ids_sha256", "decoded_sha256", *["decoded"] * texts, *["ids"] * lists], cols

    return _encoded(docs, ranks, pattern, id_col, text_col, block, build, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded binary" * texts + ", ids array<int>" * lists)
