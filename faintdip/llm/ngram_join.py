"""n-gram Jaccard join on count vectors.

A text is its set of word shingles. Shingles are in one order for all texts: those known to be
frequent come last. Two sets that are similar enough share a shingle among the first few of
either; such shingles bring texts together, and never miss a pair. Where the bar is high, a sketch
of each set travels with them, and parts most that met by chance. Among those that met, an
R-tree over the vectors that count each set's shingles by hashed group bounds each overlap by the
summed coordinate minima, node against node and then point against point; what it leaves is
verified on the whole sets, unless it is already in one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, small_components
from .state import broadcast_if_small, cut, written
from .flat import LOWER, mix, neighbours, ranges, release, shingle_hash, slices, span_hash, words

#: Shingles for each coordinate of a count vector, and its least coordinates; points in a leaf, leaves under
#: an inner node, and texts of a page and their numbers of 8 bytes: larger clusters are joined page by page.
#: With about so many shingles a coordinate, unrelated sets differ by 0.4 of their size or more,
#: similar ones by 0.2 or less, whatever their size.
EACH, LEAST, LEAF, FANOUT, PAGE, NUMBERS = 8, 32, 32, 16, 4096, 1 << 22
#: Shingles that a task gathers before it hands their keys on.
GATHER = 1 << 21
#: Frequent shingles: in so many texts of a gathering at least, so many of a gathering, and of the corpus, at most.
#: Which ones are known only changes how many texts meet for nothing.
OFTEN, SOME, FREQUENT = 2, 1 << 16, 1 << 19
#: Counts of a sketch, of four bits each, and the percentage from which sets are sketched: below it, sets have so many first
#: shingles that the sketches beside them would outweigh the texts. Of more sets than ALIKE with one key and size class a task
#: passes on one, and so many with one key are compared pair by pair.
COUNTS, SKETCHED, ALIKE, COMPARED = 32, 85, 16, 512
#: Below that percentage: how many first shingles two sets share at least if both are of size class LONG or more, as each sends so many
#: more but one. Sets that met by chance share fewer. Only the pairs of up to PAIRED sets with one key are counted, COUNTED at a time.
SHARED, LONG, PAIRED, COUNTED = 3, 10, 32, 1 << 20


def first_shingles(e: np.ndarray, at: np.ndarray, percent: int, frequent: tuple[np.ndarray, np.ndarray], shared: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the first shingles of each set, the set of each, and the set's size class.

    Similar sets overlap in percent / 100 of the larger at least, so each has a common shingle
    among all but that many less one, in any order that is the same for all sets, and one more for each one more. Sizes of similar
    sets are in the same class or in neighbouring ones. Sets of class LONG or more send so many that similar ones have shared in common.
    """
    n = np.diff(at)
    of = np.repeat(np.arange(len(n)), n)
    known, rank = frequent
    if len(known):
        where = np.minimum(np.searchsorted(known, e), len(known) - 1)
        last = np.where(known[where] == e, rank[where], 0).astype(np.int64)
        if last.any():
            e = e[np.argsort(of * 64 + last, kind="stable")]
    size_class = np.floor(np.log(np.maximum(n, 1)) / np.log(max(100 / percent, 1.01)) + 1e-9).astype(np.int64)
    least = (percent * n + 99) // 100
    first = np.where(n > 0, n - least + needed(size_class, np.minimum(shared, least)), 0)
    set_of = np.repeat(np.arange(len(n)), first)
    return mix(e[at[:-1][set_of] + ranges(first)] + np.uint64(5)), set_of, size_class[set_of]


def needed(size_class: np.ndarray, shared):
    """How many first shingles a set of that size class has in common with any similar one that is not smaller."""
    return np.where(size_class >= LONG, shared, 1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a slice, sorted within each text, and where each text's begin."""
    n = len(off) - 1
    low = LOWER[buf]
    start, end, text = words(low, off)
    word = span_hash(low, start, end)
    full = neighbours(text, size)
    e, of = (shingle_hash(word, size)[full], text[: len(full)][full]) if len(full) else (word[:0], text[:0])
    count = np.bincount(text, minlength=n)
    for k in range(1, size):  # short texts are one shingle
        first = np.searchsorted(text, np.flatnonzero(count == k))
        if len(first):
            whole = np.zeros(len(first), np.uint64)
            for i in range(k):
                whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + word[first + i] + np.uint64(1000 * k + i))
            e, of = np.concatenate([e, whole]), np.concatenate([of, text[first]])
    order = np.argsort(e)
    order = order[np.argsort(of[order].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
    e, of = e[order], of[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (of[1:] != of[:-1])
    e, of = e[new], of[new]
    return e, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


def sketches(e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """COUNTS counts of each set's elements by hash, modulo 16, two in a byte."""
    n = len(at) - 1
    of = np.repeat(np.arange(n), np.diff(at))
    g = (mix(e + np.uint64(7)) % np.uint64(COUNTS)).astype(np.int64)
    some = (np.bincount(of * COUNTS + g, minlength=n * COUNTS) & 15).astype(np.uint8).reshape(n, COUNTS)
    return some[:, ::2] | some[:, 1::2] << 4


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many elements two sets differ at least, by their sketches: counts on a ring of 16 are no farther apart than those of whole sets."""
    out = np.zeros(len(x), np.int64)
    for a, b in ((x & 15, y & 15), (x >> 4, y >> 4)):
        d = (a - b) & 15
        out += np.minimum(d, 16 - d).sum(1, dtype=np.int64)
    return out


def alike(run: np.ndarray, classes: np.ndarray, some: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places) within runs, sorted by size class, that sketches and size classes let be similar."""
    # similar sets differ in (100 - percent) / (100 + percent) of their summed sizes at most
    most = np.ceil(max(100 / percent, 1.01) ** (np.arange(int(classes.max(initial=0)) + 1) + 1.0)) + 1
    found, k, at = [], 0, np.arange(len(run))
    while True:
        k += 1
        at = at[at + k < len(run)]
        at = at[(run[at] == run[at + k]) & (classes[at + k] - classes[at] <= 1)]
        if not len(at):
            break
        for i in range(0, len(at), 1 << 16):
            a = at[i : i + (1 << 16)]
            a = a[(100 + percent) * apart(some[a], some[a + k]) <= (100 - percent) * (most[classes[a]] + most[classes[a + k]])]
            found.append((a, a + k))
    return tuple(map(np.concatenate, zip(*found))) if found else (at[:0], at[:0])


def added(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair (a, b) once, with its sum of n."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[new], b[new], np.add.reduceat(n, new) if len(a) else n


def totals(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum modulo 2**64 of each run values[at[i]:at[i + 1]]."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def signatures(e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits that tell sets apart: (n, 2) uint64."""
    return np.stack([totals(mix(e + np.uint64(11)), at), totals(mix(e ^ np.uint64(0x5851F42D4C957F2D)), at)], 1)


def dimensions(n: np.ndarray) -> np.ndarray:
    """Coordinates of the count vectors of sets of n: powers of two, so that a longer vector folds into a shorter."""
    return np.maximum(LEAST, 2 ** np.ceil(np.log2(np.maximum(n, 1) / EACH)).astype(np.int64).clip(0))


def count_vectors(e: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of each set's elements fall in each of its groups, one set after another, and where each begins."""
    d = dimensions(np.diff(at))
    begin = np.concatenate([[0], np.cumsum(d)])
    of = np.repeat(np.arange(len(d)), np.diff(at))
    g = (mix(e + np.uint64(3)) & (d[of] - 1).astype(np.uint64)).astype(np.int64)
    return np.bincount(begin[of] + g, minlength=int(begin[-1])), begin


def folded(flat: np.ndarray, begin: np.ndarray, which: np.ndarray, d: int) -> np.ndarray:
    """The count vectors of some sets at d coordinates: those of longer vectors that agree modulo d are added."""
    own = np.diff(begin)[which]
    out = np.zeros((len(which), d), np.int32)
    for k in np.unique(own):
        at = np.flatnonzero(own == k)
        out[at] = flat[begin[which[at]][:, None] + np.arange(k)].reshape(len(at), k // d, d).sum(1)
    return out


def width(n: int):
    """The type of counts of a set of n."""
    return np.uint16 if n < 1 << 16 else np.uint32


def described(docs: DataFrame, size: int) -> DataFrame:
    """(task, doc_id, n_shingles, sig, vec, often, times): signature and count vector, null for an empty set; for each
    gathering of a task there is a row without these that has its frequent shingles, and in how many different sets they are."""

    def run(batches):
        held, many, signs = [], 0, set()

        def frequent():
            e, n = np.unique(np.concatenate(held), return_counts=True)
            some = np.flatnonzero(n >= OFTEN)
            some = some[np.argsort(-n[some], kind="stable")[:SOME]]
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([e[some].tobytes()]), pa.array([n[some].astype(np.int64).tobytes()])], names)

        for batch in batches:
            for i, buf, off in slices(batch.column(1)):
                e, at = shingle_sets(buf, off, size)
                n = np.diff(at)
                sig = [bytes(x) if k else None for x, k in zip(signatures(e, at).view(np.uint8).reshape(len(n), 16), n)]
                known = batch.column(0).slice(i, len(n)).is_valid().to_pylist()
                new = np.array([s is not None and k and not (s in signs or signs.add(s)) for s, k in zip(sig, known)], bool)
                # equal sets need one vector
                flat, begin = count_vectors(e, at)
                vec = pa.array([flat[a:b].astype(width(k)).tobytes() if one else None for a, b, k, one in zip(begin, begin[1:], n, new)], pa.binary())
                held.append(e[np.repeat(new, n)])
                many += len(held[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(n)), pa.array(n), pa.array(sig, pa.binary()), vec, pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary())], names)
                if many > GATHER:
                    yield frequent()
                    held, many, signs = [], 0, set()
        if many:
            yield frequent()
        held = []
        release()

    names = ["doc_id", "n_shingles", "sig", "vec", "often", "times"]
    return docs.mapInArrow(run, "doc_id long, n_shingles long, sig binary, vec binary, often binary, times binary").withColumn("task", F.spark_partition_id())


def frequent_shingles(about: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT shingles, sorted, and the rank of each: the logarithm of how many sets are known to have it."""

    def run(batches):
        for batch in batches:
            for often, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(often, np.int64)), pa.array(np.frombuffer(times, np.int64))], ["e", "n"])

    each = about.filter("often is not null").select("often", "times").mapInArrow(run, "e long, n long")
    counted = cut(each.groupBy("e").agg(F.sum("n").alias("n")).withColumn("level", F.floor(F.log2("n"))))
    room, least = FREQUENT, 64
    for r in sorted(counted.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # at most 64 rows
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    got = counted.filter(F.col("level") >= least).select("e", "n").toArrow()
    e, n = np.asarray(got["e"]).view(np.uint64), np.asarray(got["n"])
    order = np.argsort(e)
    return e[order], np.minimum(1 + np.floor(np.log2(np.maximum(n[order], 1))), 63).astype(np.uint8)


def meetings(docs: DataFrame, size: int, percent: int, buckets: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Edges (a, b) between documents that share one of their first shingles, and are near in size.

    Keys travel in packed runs. A task passes on one document for each key and size class that many of
    its documents share, and hangs the others on it directly, so a key that a third of all
    documents share is a few entries a task. Such a document stands for sets unlike its own, so all that meet it are joined, and
    so are all of a key with more than COMPARED entries. The other sets with a key are joined where their sketches let them be
    similar; without sketches, where they share as many first shingles as similar sets do (with more than PAIRED entries of a key, all are).
    """
    sketched = percent >= SKETCHED
    shared = 1 if sketched else SHARED
    stands = 1 << 15  # in an entry's size class

    def packed(keys, owners, classes, of, some, same):
        """Rows of (bucket, keys, owners, classes, sketches), and local edges under negative buckets. An entry's sketch is some[of]."""
        order = np.lexsort((owners, classes, keys))
        keys, owners, classes, of = keys[order], owners[order], classes[order], of[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])
        begin, run = np.flatnonzero(first), np.cumsum(first) - 1
        many = np.diff(np.append(begin, len(keys))) > ALIKE
        root = owners[begin][run]
        pairs = np.unique(np.concatenate([np.stack([owners, root], 1)[many[run] & (owners != root)], same]), axis=0)
        keep = first | ~many[run]
        classes = np.where(many[run], classes | stands, classes)
        keys, owners, classes, of = keys[keep], owners[keep], classes[keep], of[keep]
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, owners, classes, of, bucket = keys[order], owners[order], classes[order], of[order], bucket[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.array([0])
        # 40 bits beside the bucket tell keys apart; a chance match only costs a comparison
        rest = (keys // np.uint64(buckets) & np.uint64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        base = int(owners.min()) if len(owners) else 0
        small = np.int32 if len(owners) and int(owners.max()) - base < 1 << 31 else np.int64
        base = base if small is np.int32 else 0
        rows = [(int(bucket[a]), rest[a:b].tobytes(), (owners[a:b] - base).astype(small).tobytes(), classes[a:b].astype(np.uint16).tobytes(), some[of[a:b]].tobytes(), base) for a, b in zip(cut, cut[1:])]
        for k in range(0, len(pairs), 1 << 16):
            two = np.ascontiguousarray(pairs[k : k + (1 << 16)].T)
            rows.append((-1 - int(two.sum() % buckets), two[0].tobytes(), two[1].tobytes(), None, None, 0))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], names) if rows else None

    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT entries

    def send(batches):
        held, same, many, signs = [], [], 0, {}

        def gathered():
            pairs = np.array(same, np.int64).reshape(-1, 2)
            begin = np.cumsum([0, *(len(some) for *_, some in held)])
            keys, owners, classes, of = (np.concatenate(x) for x in zip(*((k, o, c, of + b) for (k, o, c, of, _), b in zip(held, begin))))
            return packed(keys, owners, classes, of, np.concatenate([some for *_, some in held]), pairs)

        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0))
            known = ~np.asarray(batch.column(0).is_null())
            for i, buf, off in slices(batch.column(1)):
                e, at = shingle_sets(buf, off, size)
                sig = [bytes(x) for x in signatures(e, at).view(np.uint8).reshape(len(off) - 1, 16)]
                n, use = np.diff(at), np.zeros(len(sig), bool)
                for k in np.flatnonzero((n > 0) & known[i : i + len(sig)]).tolist():
                    own = int(ids[i + k])
                    # equal sets meet by signature elsewhere, where the smallest document stands for them: one of them, tied to that, is enough here
                    if sig[k] not in signs:
                        signs[sig[k]], use[k] = own, True
                    elif own < signs[sig[k]]:
                        same.append((own, signs[sig[k]]))
                e = e[np.repeat(use, n)]
                if not len(e):
                    continue
                at = np.concatenate([[0], np.cumsum(n[use])])
                keys, owners, classes = first_shingles(e, at, percent, sent.value, shared)
                some = sketches(e, at) if sketched else np.zeros((len(at) - 1, 0), np.uint8)
                held.append((keys, ids[i : i + len(off) - 1][use][owners], classes, owners, some))
                many += len(e)
                if many > GATHER:
                    yield gathered()
                    held, same, many, signs = [], [], 0, {}
        if held:
            yield gathered()
        held = []
        release()

    nothing = (np.zeros(0, np.int64),) * 3

    def met(rows):
        """Edges of one bucket's rows, and pairs with how much they add to the first shingles that they share."""
        if rows[0]["bucket"] < 0:
            return np.concatenate([np.stack([np.frombuffer(r["keys"], np.int64), np.frombuffer(r["owners"], np.int64)], 1) for r in rows]), nothing
        owners = np.concatenate([np.frombuffer(r["owners"], np.int32 if 5 * len(r["owners"]) == 4 * len(r["keys"]) else np.int64).astype(np.int64) + r["base"] for r in rows])
        classes = np.concatenate([np.frombuffer(r["classes"], np.uint16) for r in rows]).astype(np.int64)
        keys = np.zeros((len(owners), 8), np.uint8)
        keys[:, :5] = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint8).reshape(-1, 5)
        keys = keys.view("<u8").ravel()
        standing, classes = classes >= stands, classes & (stands - 1)
        order = np.lexsort((owners, classes, keys))
        keys, owners, classes, standing = keys[order], owners[order], classes[order], standing[order]
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (classes[1:] - classes[:-1] > 1)])
        begin, run = np.flatnonzero(first), np.cumsum(first) - 1
        whole = (np.maximum.reduceat(standing, begin) | (np.diff(np.append(begin, len(keys))) > (COMPARED if sketched else PAIRED)))[run]
        hung = np.stack([owners, owners[begin][run]], 1)[whole]
        # single entries meet nothing
        size = np.diff(np.append(begin, len(keys)))[run]
        left = np.flatnonzero(~whole & (size > 1))
        if sketched:
            some = np.frombuffer(b"".join(r["sketches"] for r in rows), np.uint8).reshape(-1, COUNTS // 2)[order[left]]
            a, b = alike(run[left], classes[left], some, percent)
            return np.concatenate([hung, np.stack([owners[left[a]], owners[left[b]]], 1)]), nothing
        owners, classes, run = owners[left], classes[left], run[left]
        near, at, k = [nothing], np.arange(len(run)), 0
        while len(at):
            k += 1
            at = at[at + k < len(run)]
            at = at[(run[at] == run[at + k]) & (classes[at + k] - classes[at] <= 1)]
            x, y = owners[at], owners[at + k]
            # classes rise within a run; a pair that needs fewer has the others beforehand
            near.append((np.maximum(x, y), np.minimum(x, y), 1 + shared - needed(classes[at], shared)))
        return hung, added(*map(np.concatenate, zip(*near)))

    def meet(batches):
        held: list = []
        pairs, waiting = [], 0

        def edges():
            nonlocal waiting
            two, found = met(held)
            if len(found[0]):
                pairs.append(found)
                waiting += len(found[0])
            node, least = small_components(*two.T)
            some = node != least
            return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(least[some]), pa.array(np.full(int(some.sum()), shared))], ["a", "b", "n"])

        def counted():
            nonlocal pairs, waiting
            found = added(*map(np.concatenate, zip(*pairs)))
            pairs, waiting = [], 0
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "n"])

        for batch in batches:
            for row in batch.to_pylist():  # sorted by bucket: one is held at a time
                if held and held[-1]["bucket"] != row["bucket"]:
                    yield edges()
                    held = []
                    if waiting > COUNTED:
                        yield counted()
                held.append(row)
        if held:
            yield edges()
        if pairs:
            yield counted()
        held = []
        release()

    names = ["bucket", "keys", "owners", "classes", "sketches", "base"]
    runs = docs.mapInArrow(send, "bucket long, keys binary, owners binary, classes binary, sketches binary, base long")
    found = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a long, b long, n long")
    if sketched:
        return found.select("a", "b")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= shared).select("a", "b")


class Forest:
    """Components among numbered points."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        self.label[self.label == max(x, y)] = min(x, y)
        return True


class Tree:
    """An R-tree of two storeys: leaves are runs of points sorted by size and count vector, inner nodes runs of leaves.

    A node's box is its coordinate maxima, and its least size.
    """

    def __init__(self, points: np.ndarray, n: np.ndarray, vec: np.ndarray):
        order = np.lexsort((*vec.T[:8][::-1], n[points]))
        self.points, self.vec, self.n = points[order], vec[order], n[points[order]]
        self.leaves, self.inner = self.boxes(LEAF), self.boxes(LEAF * FANOUT)

    def boxes(self, run: int):
        cut = np.arange(0, len(self.points), run)
        return np.maximum.reduceat(self.vec, cut), np.minimum.reduceat(self.n, cut)

    def leaf(self, k: int):
        s = slice(k * LEAF, (k + 1) * LEAF)
        return self.points[s], (self.vec[s], self.n[s])


def meeting_leaves(a: Tree, b: Tree, percent: int, same: bool):
    """Pairs of leaves, and which of their points the bound lets meet."""

    def may(x, y):
        # the needed overlap of two sets is percent / (100 + percent) of their summed sizes
        most = np.minimum(x[0][:, None], y[0][None]).sum(2, dtype=np.int64)
        return (100 + percent) * most >= percent * (x[1][:, None] + y[1][None])

    above = may(a.inner, b.inner)
    for i, j in zip(*np.nonzero(np.triu(above) if same else above)):
        s, t = (slice(k * FANOUT, (k + 1) * FANOUT) for k in (i, j))
        for x, y in zip(*np.nonzero(may([v[s] for v in a.leaves], [v[t] for v in b.leaves]))):
            p, q = i * FANOUT + x, j * FANOUT + y
            if not same or p <= q:
                (u, box_u), (v, box_v) = a.leaf(p), b.leaf(q)
                yield u, v, may(box_u, box_v)


def rtree_join(n: np.ndarray, flat: np.ndarray, begin: np.ndarray, page: np.ndarray, percent: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links (numbers of points) that span the components of the points' similarity graph.

    Points are sets of n shingles with count vectors (flat, begin). There is a tree for each number of
    coordinates; trees of different numbers meet at the smaller. With sets, links are verified on them;
    without, a link says no more than that the bound allows it. If there are two pages, only pairs
    across are looked at, as the pairs within have tasks of their own.
    """
    across = len(np.unique(page)) > 1
    forest, links = Forest(len(n)), []
    d = np.diff(begin)
    kinds = np.unique(d)
    for i, small in enumerate(kinds):
        mine = np.flatnonzero(d == small)
        tree = Tree(mine, n, folded(flat, begin, mine, small))
        for large in kinds[i:]:
            others = np.flatnonzero(d == large)
            if 100 * n[mine].max() < percent * n[others].min():
                continue
            other = tree if large == small else Tree(others, n, folded(flat, begin, others, small))
            for u, v, ok in meeting_leaves(tree, other, percent, large == small):
                ok &= forest.label[u][:, None] != forest.label[v][None]
                if across:
                    ok &= page[u][:, None] != page[v][None]
                for r, c in zip(*np.nonzero(ok)):
                    s, t = int(u[r]), int(v[c])
                    if forest.label[s] == forest.label[t]:
                        continue
                    if sets is not None:
                        both = len(np.intersect1d(sets[s], sets[t], assume_unique=True))
                        if 100 * both < percent * (n[s] + n[t] - both):
                            continue
                    forest.join(s, t)
                    links.append((s, t))
    return links


def paged(members: DataFrame, percent: int, each: int = 1) -> DataFrame:
    """members (doc_id, cluster, n_shingles, ...) dealt out to tasks (cluster, p, q), with their page.

    A cluster of more than PAGE texts or NUMBERS numbers, of which a text has one for `each` shingles, is cut by size,
    and a size with many of them by hash; every two pages whose sizes can be similar are one task. So a task's memory is bounded, however
    large the cluster is, and no task sees all of a cluster to cut it.
    """
    level = F.floor(F.log(F.col("n_shingles").cast("double")) * 4).cast("int")
    members = members.withColumn("level", level)
    sizes = members.groupBy("cluster", "level").agg(F.count("*").alias("here"), (F.sum("n_shingles") / each).alias("there"))
    whole = sizes.groupBy("cluster").agg(F.sum("here").alias("all"), F.sum("there").alias("shingles")).filter((F.col("all") > PAGE) | (F.col("shingles") > NUMBERS))
    cuts = F.greatest(F.ceil(F.col("here") / PAGE), F.ceil(F.col("there") / NUMBERS))
    sizes = sizes.join(whole.select("cluster"), "cluster").select("cluster", "level", cuts.alias("cuts"))
    page = F.col("level") * (1 << 20) + F.pmod(F.xxhash64("doc_id"), F.col("cuts"))
    members = members.join(sizes, ["cluster", "level"], "left").withColumn("page", F.coalesce(page, F.lit(0)).cast("int")).drop("level", "cuts")
    span = members.groupBy("cluster", "page").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    p, q = span.alias("p"), span.alias("q")
    near = (F.col("p.cluster") == F.col("q.cluster")) & (F.col("p.page") <= F.col("q.page")) & (100 * F.col("p.high") >= percent * F.col("q.low"))
    tasks = p.join(q, near).select(F.col("p.cluster").alias("cluster"), F.col("p.page").alias("p"), F.col("q.page").alias("q"))
    mine = F.explode(F.array_distinct(F.array("p", "q"))).alias("page")
    return members.join(tasks.select("cluster", "p", "q", mine), ["cluster", "page"])


def _pairs(ids: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table({"a": ids[a], "b": ids[b]})


def bounded_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span what the bound on count vectors leaves of each cluster; members have vec."""

    def join(t: pa.Table) -> pa.Table:
        n = np.asarray(t["n_shingles"])
        flat = np.concatenate([np.frombuffer(x, width(k)) for x, k in zip(t["vec"].to_pylist(), n)])
        return _pairs(np.asarray(t["doc_id"]), rtree_join(n, flat, np.concatenate([[0], np.cumsum(dimensions(n))]), np.asarray(t["page"]), percent))

    return paged(members, percent, EACH).select("cluster", "p", "q", "page", "doc_id", "n_shingles", "vec").groupBy("cluster", "p", "q").applyInArrow(join, "a long, b long")


def verified_links(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that span the components, verified on whole sets, within clusters of members."""
    placed = paged(members, percent).groupBy("doc_id").agg(F.collect_set(F.struct("cluster", "p", "q", "page")).alias("tasks"))

    def sets(batches):
        for batch in batches:
            for i, buf, off in slices(batch.column(1)):
                e, at = shingle_sets(buf, off, size)
                k = len(off) - 1
                blob = pa.Array.from_buffers(pa.large_binary(), k, [None, pa.py_buffer((at * 8).astype(np.int64).tobytes()), pa.py_buffer(e.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, k), blob.cast(pa.binary()), batch.column(2).slice(i, k)], ["doc_id", "shingles", "tasks"])

    kind = "array<struct<cluster:long,p:int,q:int,page:int>>"
    found = docs.join(placed, "doc_id").select("doc_id", "text", "tasks").mapInArrow(sets, f"doc_id long, shingles binary, tasks {kind}")
    rows = found.select("doc_id", "shingles", F.inline("tasks"))

    def join(t: pa.Table) -> pa.Table:
        some = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        n = np.array([len(x) for x in some])
        vectors = count_vectors(np.concatenate(some), np.concatenate([[0], np.cumsum(n)]))
        return _pairs(np.asarray(t["doc_id"]), rtree_join(n, *vectors, np.asarray(t["page"]), percent, some))

    return rows.groupBy("cluster", "p", "q").applyInArrow(join, "a long, b long")


def jaccard_components(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Documents link when their sets of `words`-word shingles have a Jaccard similarity of at
    least percent / 100; component_id is the smallest doc_id reachable by links. Words are runs
    without white space, A-Z lower-cased; a text of fewer words is one shingle. Null and empty
    texts have the empty set and link with nothing; a null doc_id links with nothing and has a
    null component. Rows that repeat a doc_id are one node with the links of each. Other columns
    are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    about = cut(described(docs, words))
    keyed = about.filter("doc_id is not null and sig is not null")
    # equal sets stand for one another; tasks collapse them first, so that no set's copies all meet in one task
    held = keyed.groupBy("sig", "task").agg(F.min("doc_id").alias("low"))
    first = held.groupBy("sig").agg(F.min("low").alias("rep"))
    held = cut(held.join(first, "sig"))
    # a doc_id that rows of different texts share is one node with the links of each
    texts = keyed.groupBy("doc_id").agg(F.min("sig").alias("x"), F.max("sig").alias("y")).filter("x <> y").select("doc_id")
    shared = keyed.join(texts, "doc_id", "left_semi").select("doc_id", "sig", "task").distinct().join(held, ["sig", "task"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    met = meetings(docs, words, percent, buckets, frequent_shingles(about))
    # a task's smallest document of a set stands for it there; it is known by the set's smallest
    local = held.filter("low <> rep").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    clusters = components(met.unionByName(local))
    label = lambda c: c.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    # a set's vector is with its first document in a task, whichever that is
    one = held.groupBy("sig").agg(F.first("rep").alias("doc_id"))
    vectors = keyed.filter("vec is not null").groupBy("sig").agg(F.first("n_shingles").alias("n_shingles"), F.first("vec").alias("vec"))
    members = label(clusters).join(one, "doc_id").join(vectors, "sig").select("doc_id", "cluster", "n_shingles", "vec")
    tight = label(components(bounded_links(cut(members), percent)))
    sizes = members.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    links = verified_links(docs, cut(tight.join(sizes, "doc_id")), words, percent)
    joined = components(links.unionByName(shared))
    sets = held.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("sig", "task", F.coalesce("component", "rep").alias("component"))
    out = about.filter("n_shingles is not null").join(sets, ["sig", "task"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates: one row of each component stays, with all columns, whatever their names.

    That is the row with the smallest doc_id; of equal ids the one whose columns have the smallest
    xxhash64. Rows that repeat a doc_id with texts that are not similar each stay, as do rows with a
    null doc_id, and all with a null or empty text; an empty table stays empty.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "rows")
    found = jaccard_components(rows.select(F.col("rid").alias("doc_id"), F.when(F.col("row.doc_id").isNotNull(), F.col("row.text")).alias("text")), **options)
    linked = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("rid"), F.col("component_id").alias("one"))
    members = cut(linked.unionByName(linked.select(F.col("one").alias("rid"), "one").distinct()))
    best = F.min(F.struct(F.col("row.doc_id").alias("doc_id"), F.xxhash64("row").alias("hash"), F.col("rid")))
    stays = rows.join(members, "rid").groupBy("one").agg(best.alias("best")).select("best.rid")
    goes = cut(members.select("rid").join(stays, "rid", "left_anti"))
    return rows.join(broadcast_if_small(goes, F.lit(16)), "rid", "left_anti").select("row.*")
