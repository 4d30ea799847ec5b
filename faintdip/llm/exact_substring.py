"""Exact repeated windows by a depth-limited most-significant-digit radix sort of suffixes.

Suffixes are ordered only through the threshold length. The first digit is a sampled anchor:
of the byte runs inside a window the one with the least hash, which equal windows have at the
same place. Anchors that only one document has end there, as do their suffixes. For the others
the stretches of windows around them go to the task of their anchor, where passes over digits
of eight bytes refine groups until suffixes differ or the threshold is reached; the groups that
are still equal then are exactly the repeated windows.

Texts are dealt to parts once; what is learned about anchors and windows returns to the part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import binary, mix, per_text, powers, prefix_hash, ranges, slices, span_hash

#: Bytes of text in a part.
PART = 4 << 20
#: Suffixes that one sort handles at once.
SORT = 1 << 22


def anchors(buf: np.ndarray, off: np.ndarray, window: int, gram: int):
    """Stretches of windows that share an anchor: first window, number of windows, anchor hash.

    Every window that lies in one text belongs to exactly one stretch.
    """
    wide = window - gram + 1
    n = len(buf) - gram + 1
    if n < wide:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    p = prefix_hash(buf)
    h = mix((p[gram:] - p[:-gram]) * powers(n, "down"))
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    m = (h & ~low) | np.arange(n, dtype=np.uint64)
    have = 1
    while have < wide:  # the least of ever longer runs
        step = min(have, wide - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    at = (m & low).astype(np.int64)
    inside = np.zeros(len(at) + 1, np.int64)
    begin = off[:-1]
    stop = np.maximum(off[1:] - window + 1, begin)
    ok = stop > begin
    np.add.at(inside, np.minimum(begin[ok], len(at)), 1)
    np.add.at(inside, np.minimum(stop[ok], len(at)), -1)
    valid = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(valid):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    a = at[valid]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    return valid[new], np.diff(np.append(new, len(a))), h[a[new]]


def radix_groups(buf: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes equal through length bytes: their numbers, grouped, and the group of each.

    Passes take eight bytes, the most significant first; a suffix alone in its group drops out.
    """
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(pad, 8)
    who, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    for depth in range(0, length, 8):
        if not len(who):
            break
        digit = np.ascontiguousarray(view[start[who] + depth]).view(">u8").ravel().astype(np.uint64)
        if length - depth < 8:
            digit >>= np.uint64(8 * (8 - (length - depth)))
        order = np.argsort(digit)
        if depth:
            order = order[np.argsort(group[order], kind="stable")]
        d, g = digit[order], group[order]
        new = np.ones(len(order), bool)
        new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1
        who, group = who[order][many], number[many]
        group = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]])) if len(group) else group
    return who, group


def repeated_windows(buf, first, count, owner, anchor, window):
    """Of each stretch's windows, which also start in a smaller owner: runs (stretch, window, number)."""
    out = []
    order = np.argsort(anchor, kind="stable")
    upto = np.cumsum(count[order])
    i = 0
    while i < len(order):
        # whole anchors, some SORT suffixes at a time
        j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SORT, "right"))
        j = max(j, i + 1)
        while j < len(order) and anchor[order[j]] == anchor[order[j - 1]]:
            j += 1
        some = order[i:j]
        i = j
        n = count[some]
        stretch, k = np.repeat(some, n), ranges(n)
        who, group = radix_groups(buf, first[stretch] + k, window)
        if not len(who):
            continue
        o = owner[stretch[who]]
        least = np.minimum.reduceat(o, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))[group]
        hit = np.sort(who[o > least])
        if len(hit):
            s, w = stretch[hit], k[hit]
            new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (w[1:] != w[:-1] + 1)]))
            out.append((s[new], w[new], np.diff(np.append(new, len(s)))))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    return tuple(map(np.concatenate, zip(*out)))


def _runs(bucket: np.ndarray):
    """Order by bucket, and (bucket, begin, end) of each run in that order."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
    return order, [(int(b[x]), x, y) for x, y in zip(cut, cut[1:])]


def _ragged(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The byte ranges, one after another."""
    return buf[np.repeat(start, length) + ranges(length)]


def _by_bucket(batches):
    """(bucket, rows) for packed runs that were dealt out and sorted by bucket; one bucket is held at a time."""
    held: list = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["bucket"] != row["bucket"]:
                yield held[-1]["bucket"], held
                held = []
            held.append(row)
    if held:
        yield held[-1]["bucket"], held


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which byte ranges of these sizes, none of them zero, are equal at a and at b."""
    out = np.ones(len(size), bool)
    upto = np.cumsum(size)
    i = 0
    while i < len(size):  # SORT bytes at a time
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SORT, "right")))
        same = _ragged(raw, a[i:j], size[i:j]) == _ragged(raw, b[i:j], size[i:j])
        out[i:j] = np.logical_and.reduceat(same, np.cumsum(size[i:j]) - size[i:j])
        i = j
    return out


def _part(texts: pa.Table, notes: pa.Table):
    """A part's rows in a fixed order: ids, texts, which are exact copies, and which take part."""
    order = pc.sort_indices(texts, [("doc_id", "ascending"), ("text", "ascending")])
    column = binary(texts["text"].take(order))
    ids = texts["doc_id"].combine_chunks().take(order)
    flags = notes.filter(pc.is_valid(notes["digest"]))
    least = dict(zip(flags["digest"].to_pylist(), flags["least"].to_pylist()))
    copy = np.zeros(len(ids), bool)
    if least:
        copy[:] = [d is not None and least.get(hashlib.sha256(x.as_buffer()).digest(), d) < d for d, x in zip(ids.to_pylist(), column)]
    return ids, column, copy, ~copy & np.asarray(ids.is_valid())


def _stretches(column, use, window, gram):
    """For each slice of the texts in use: row, place in the text, windows and anchor of each stretch, the bytes, place in them."""
    number = np.flatnonzero(use)
    for i, buf, off in slices(column.take(pa.array(number))):
        first, count, anchor = anchors(buf, off, window, gram)
        t = np.searchsorted(off, first, "right") - 1
        yield number[i + t], first - off[t], count, anchor, buf, first


def dedup_substrings(docs: DataFrame, *, window: int = 50, gram: int = 20, texts: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans,
    kept_sha256; with texts also kept (binary).

    A byte goes if a string of `window` bytes that covers it also starts in a row with a smaller
    doc_id, judged on the input. Null and empty texts have no bytes; rows with a null doc_id
    neither lose bytes nor cause losses, and rows of the same doc_id don't affect one another.
    Other columns are ignored. gram, below window, is the length of an anchor.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, buckets = max(partitions, -(-total // PART)), 4 * partitions
    part = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(parts)).cast("long").alias("part")
    placed = docs.select(part, "doc_id", "text").repartition(partitions, "part")

    # all windows of a text whose SHA-256 a smaller id has too repeat, so one of each group of copies takes part for all;
    # a part is told once of a digest, however many copies it has
    digest = docs.filter("doc_id is not null").groupBy(part, F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    least = digest.groupBy("digest").agg(F.min("low").alias("least"))
    copies = digest.join(least, "digest").filter("high > least").select("part", "digest", "least")

    def joined(notes: DataFrame, names: list[str]) -> DataFrame:
        """Notes for parts, with the copies, of which some rows have all other columns null."""
        return notes.unionByName(copies, allowMissingColumns=True).select("part", *names, "digest", "least")

    def pack(anchor):
        """Bucket, and 32 bits of what else the anchor's hash says."""
        return (anchor % np.uint64(buckets)).astype(np.int64), (anchor // np.uint64(buckets) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def first_digit(key, mine, notes):
        ids, column, _, use = _part(mine, notes)
        owner = np.asarray(ids.fill_null(0))
        found = [(anchor, owner[row]) for row, _, _, anchor, _, _ in _stretches(column, use, window, gram)]
        a, d = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        order = np.lexsort((d, a))
        a, d = a[order], d[order]
        new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
        shared = d[new] != d[np.append(new[1:], len(a)) - 1] if len(a) else np.empty(0, bool)  # in two documents of this part
        bucket, low = pack(a[new])
        order, runs = _runs(bucket)
        low, shared = low[order], shared[order]
        return pa.table({
            "part": pa.array([key[0].as_py()] * len(runs), pa.int64()),
            "bucket": pa.array([b for b, _, _ in runs], pa.int64()),
            "low": pa.array([low[x:y].tobytes() for _, x, y in runs], pa.binary()),
            "shared": pa.array([np.packbits(shared[x:y]).tobytes() for _, x, y in runs], pa.binary()),
        })

    def meet(batches):
        """Of every part's anchors, those that another document has too."""
        for bucket, rows in _by_bucket(batches):
            low = [np.frombuffer(r["low"], np.uint32) for r in rows]
            flag = [np.unpackbits(np.frombuffer(r["shared"], np.uint8))[: len(x)] for r, x in zip(rows, low)]
            value, number, times = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
            again = (times > 1) | (np.bincount(number, np.concatenate(flag), len(value)) > 0)
            keep = [x[again[np.searchsorted(value, x)]] for x in low]
            out = [(r["part"], k) for r, k in zip(rows, keep) if len(k)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in out], pa.int64()), pa.array([bucket] * len(out), pa.int64()), pa.array([k.tobytes() for _, k in out], pa.binary())],
                    ["part", "bucket", "low"],
                )

    def stretches(key, mine, notes):
        """Stretches around repeated anchors, for the anchors' tasks; runs already known to repeat under negative buckets."""
        ids, column, _, use = _part(mine, notes)
        owner, me = np.asarray(ids.fill_null(0)), key[0].as_py()
        some = notes.filter(pc.is_valid(notes["low"]))
        rows = []
        if some.num_rows:
            wanted = np.sort(np.concatenate([(np.frombuffer(x, np.uint32).astype(np.uint64) << np.uint64(32)) + np.uint64(b) for b, x in zip(some["bucket"].to_pylist(), some["low"].to_pylist())]))
            got = []
            for row, place, count, anchor, buf, first in _stretches(column, use, window, gram):
                bucket, low = pack(anchor)
                k = (low.astype(np.uint64) << np.uint64(32)) + bucket.astype(np.uint64)
                h = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, k), len(wanted) - 1)] == k)
                if len(h):
                    size = count[h] + window - 1
                    same = span_hash(buf, first[h], first[h] + size)
                    got.append((row[h], place[h], count[h], bucket[h], k[h], same, _ragged(buf, first[h], size)))
            if got:
                row, place, count, bucket, k, same, raw = map(np.concatenate, zip(*got))
                size = count + window - 1
                begin = np.cumsum(size) - size
                # the smallest document of a part stands for all of its equal stretches
                order = np.lexsort((owner[row], same))
                s = same[order]
                new = np.concatenate([[True], s[1:] != s[:-1]])
                chief = np.empty(len(order), np.int64)
                chief[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
                # hashes only propose: bytes decide
                known = np.flatnonzero((owner[row] > owner[row[chief]]) & (size == size[chief]))
                known = known[_equal(raw, begin[known], begin[chief[known]], size[known])]
                if len(known):
                    rows.append((-1 - me % buckets, row[known], place[known], count[known], None, None, None))
                rest = np.setdiff1d(np.arange(len(row)), known)
                order, runs = _runs(bucket[rest])
                for b, x, y in runs:
                    at = rest[order[x:y]]
                    rows.append((b, row[at], place[at], count[at], owner[row[at]], k[at], _ragged(raw, begin[at], size[at])))
        blob = lambda i, kind: pa.array([None if r[i] is None else r[i].astype(kind).tobytes() for r in rows], pa.binary())
        return pa.table({
            "part": pa.array([me] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int64()), "row": blob(1, "i4"), "place": blob(2, "i4"),
            "count": blob(3, "i4"), "owner": blob(4, "i8"), "anchor": blob(5, "u8"), "raw": blob(6, "u1"),
        })

    def sort(batches):
        """Sorts the suffixes of each bucket; runs of windows that repeat, for the parts they are from."""
        for bucket, rows in _by_bucket(batches):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array([r["part"] for r in rows], pa.int64()), *(pa.array([r[c] for r in rows], pa.binary()) for c in ("row", "place", "count"))], ["part", "row", "place", "count"])
                continue
            take = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in rows])
            row, place, count, owner, anchor, raw = (take(c, k) for c, k in (("row", "i4"), ("place", "i4"), ("count", "i4"), ("owner", "i8"), ("anchor", "u8"), ("raw", "u1")))
            count = count.astype(np.int64)
            size = count + window - 1
            s, w, n = repeated_windows(raw, np.cumsum(size) - size, count, owner, anchor, window)
            of = np.repeat(np.arange(len(rows)), [len(r["row"]) // 4 for r in rows])[s]
            order = np.argsort(of, kind="stable")
            s, w, n, of = s[order], w[order], n[order], of[order]
            cut = np.searchsorted(of, np.arange(len(rows) + 1))
            out = [(r["part"], row[s[x:y]], place[s[x:y]] + w[x:y], n[x:y]) for r, x, y in zip(rows, cut, cut[1:]) if y > x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), *(pa.array([o[i].astype("i4").tobytes() for o in out], pa.binary()) for i in (1, 2, 3))], ["part", "row", "place", "count"])

    def remove(key, mine, notes):
        ids, column, copy, _ = _part(mine, notes)
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        buf = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
        off = off - off[0]
        some = notes.filter(pc.is_valid(notes["row"]))
        take = lambda c: np.concatenate([np.frombuffer(x, "i4") for x in some[c].to_pylist()] or [np.empty(0, "i4")]).astype(np.int64)
        begin = off[take("row")] + take("place")
        size = np.diff(off)
        whole = copy & (size >= window)
        change = np.zeros(len(buf) + 1, np.int32)
        np.add.at(change, np.concatenate([begin, off[:-1][whole]]), 1)
        np.add.at(change, np.concatenate([begin + take("count") - 1 + window, off[1:][whole]]), -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        starts = off[:-1][size > 0]
        edge[starts] = gone[starts]
        left = [buf[a:b][~gone[a:b]].tobytes() for a, b in zip(off.tolist(), off[1:].tolist())]
        cols = {"doc_id": ids, "n_bytes": size, "n_removed": per_text(gone, off), "n_spans": per_text(edge, off), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in left]}
        return pa.table(cols | ({"kept": pa.array(left, pa.binary())} if texts else {}))

    mine = placed.groupBy("part")
    digits = mine.cogroup(copies.groupBy("part")).applyInArrow(first_digit, "part long, bucket long, low binary, shared binary")
    again = digits.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "part long, bucket long, low binary")
    sent = mine.cogroup(joined(again, ["bucket", "low"]).groupBy("part")).applyInArrow(
        stretches, "part long, bucket long, row binary, place binary, count binary, owner binary, anchor binary, raw binary"
    )
    windows = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort, "part long, row binary, place binary, count binary")
    return mine.cogroup(joined(windows, ["row", "place", "count"]).groupBy("part")).applyInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    )
