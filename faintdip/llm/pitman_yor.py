"""Scoring texts with a hierarchical Pitman-Yor model learned from the corpus.

A text is its tokens and an end. Restaurants share parents on four storeys:

* a restaurant for each text, whose customers are the tokens so far: what a text has used before,
  it is likely to use again;
* its parent, at each token, the restaurant of the context, which is the previous word; a text's
  first token has a context of its own. Its customers are all training tokens after that word;
* the restaurant of the whole corpus, a dish for every token known from training and one for all
  others, as in the base score. Its customers are the tables of the contexts' restaurants;
* the spelling of tokens, which tells rare tokens apart; what it gives to spellings that training
  doesn't have is the probability of the dish of unknown tokens. Its customers are the distinct
  training tokens, each once. A byte is drawn in two steps, its class (32 of them; letters are
  their own) after the last four classes, then the byte within its class after the byte before
  and the class before that. Both are trees of restaurants: the context that lacks the oldest item
  is the parent.

In all restaurants but a text's own, customers of a dish are taken out and seated again by the
Chinese-restaurant process, Gibbs sweep by sweep, and table counts or predictive probabilities are
averaged over the sweeps after burn-in. Tables send customers to the parent. Contexts of a bucket
are seated together; the parent's probability of a token is there its share of their tables.
Spelling contexts are at most 32**4 whatever the corpus, so that part of the model has a fixed
bound and can be sent to all tasks; the corpus and context storeys grow with the corpus and are
dealt out by token and by context, each part of the texts getting back what it uses.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import LOWER, mix, ranges, slices, span_hash, words
from .state import cut

#: Classes of bytes: space, a to z, end, digits, first and further bytes of longer characters, the rest.
CLASSES = 32
CLASS = np.full(256, 31, np.int64)
CLASS[0x20] = 0
CLASS[0x61:0x7B] = np.arange(1, 27)
CLASS[0x0A] = 27
CLASS[0x30:0x3A] = 28
CLASS[0xC0:] = 29
CLASS[0x80:0xC0] = 30
WIDE = 28  # classes from here on have several bytes

DEPTH = 4
SPACE, STOP = 0x20, 0x0A
SPELL = CLASSES ** (DEPTH + 1)  # keys of the second step come after those of the first

#: Discount and strength of spelling contexts, of the corpus restaurant and of a text's.
DISCOUNT, STRENGTH = 0.4, 1.0
#: The same of a context of one previous word.
CONTEXT = (0.8, 1.0)
CORPUS = (0.6, 100.0)
TEXT = (0.5, 500.0)
SWEEPS, BURN_IN, SEED = 6, 2, 7
#: Share of a dish's seated customers that the next run of customers has at most.
RUN = 0.05
#: The same of contexts, which are many.
CONTEXT_SWEEPS, CONTEXT_BURN_IN = 3, 1
#: Bytes of text in a part.
PART = 12 << 20
#: Buckets that tokens and contexts are dealt to, and those for spelling. They double with every doubling of the
#: texts beyond so many bytes, so that a bucket's size has a bound, and hang on nothing else, so that no setting changes scores.
SHARDS, TYPES, PLAIN = 256, 128, 4 << 30
#: Bytes of a token's hash that travel with a pair, and the context of a text's first token.
WORD, FIRST = 6, np.uint64(0)


def stream(low: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Words as byte runs closed by a space, each after DEPTH spaces that only serve as context.

    Returns the bytes, and where each word's own begin and end.
    """
    size = end - start
    stop = np.cumsum(size + 1 + DEPTH)
    begin = stop - size - 1
    out = np.full(int(stop[-1]) if len(stop) else 0, SPACE, np.uint8)
    at = ranges(size)
    out[np.repeat(begin, size) + at] = low[np.repeat(start, size) + at]
    return out, begin, stop


def tokens(buf: np.ndarray, off: np.ndarray):
    """Lower-cased bytes with an end byte at their end; starts, ends, texts and hashes of all tokens, in order.

    Each text's last token is its end, spelled as that byte.
    """
    low = np.append(LOWER[buf], np.uint8(STOP))
    start, end, text = words(low[:-1], off)
    n = len(off) - 1
    at = np.cumsum(np.bincount(text, minlength=n))
    start, end = np.insert(start, at, len(buf)), np.insert(end, at, len(buf) + 1)
    text = np.insert(text, at, np.arange(n))
    return low, start, end, text, span_hash(low, start, end)


def keys(out: np.ndarray, begin: np.ndarray, stop: np.ndarray):
    """Of each own byte: class context of DEPTH, class; and key of the second step, or -1 where a class has one byte."""
    cls = CLASS[out]
    own = np.repeat(begin, stop - begin) + ranges(stop - begin)
    context = np.zeros(len(own), np.int64)
    for i in range(1, DEPTH + 1):  # the newest class leads, so a parent is a prefix
        context = context * CLASSES + cls[own - i]
    w = cls[own]
    second = np.where(w >= WIDE, (((w - WIDE) * 256 + out[own - 1]) * CLASSES + cls[own - 2]) * 256 + out[own], -1)
    return own, context, w, second


def seat(count, parent, tables, total, rng, discount: float = DISCOUNT, strength: float = STRENGTH) -> np.ndarray:
    """Seats all customers of each dish again, others' tables as they are: new numbers of tables.

    count customers, the parent's probability of the dish, its tables, and all of its restaurant's.

    Customers come in runs of up to RUN of those seated, one by one while these are few; how many
    of a run open tables is the urn's beta-binomial draw. So work grows with the logarithm of
    the customers.
    """
    t, seated = np.ones(len(count)), np.ones(len(count))
    others = total - tables
    live = np.arange(len(count))
    while True:
        live = live[seated[live] < count[live]]
        if not len(live):
            return t
        a = seated[live] - discount * t[live]
        b = np.maximum((strength + discount * (others[live] + t[live])) * parent[live], 1e-300)
        run = np.minimum(np.maximum(np.floor(RUN * seated[live]), 1), count[live] - seated[live])
        new = (rng.random(len(live)) * (a + b) < b).astype(float)
        many = np.flatnonzero(run > 1)
        if len(many):
            new[many] = rng.binomial(run[many].astype(np.int64), rng.beta(b[many], a[many]))
        t[live] += new
        seated[live] += run


def predictive(leaf: np.ndarray, base: np.ndarray, fans: list[int], seed: int):
    """Averaged predictive probabilities of the leaves' restaurants and of their parents'.

    leaf is contexts x dishes of counts; fans are the numbers of children from the root down.
    """
    rng = np.random.default_rng(seed)
    sizes = np.cumprod([1, *fans])
    dishes = leaf.shape[1]

    def down(counts, tables):
        p, out = base[None], []
        for c, t, size in zip(counts, tables, sizes):
            p = np.repeat(p, size // len(p), 0)
            n, all_t = c.sum(1, keepdims=True), t.sum(1, keepdims=True)
            p = np.where(n > 0, (c - DISCOUNT * t + (STRENGTH + DISCOUNT * all_t) * p) / (STRENGTH + n), p)
            out.append(p)
        return out

    # to begin with, a table for each dish and child that serves it
    counts = [leaf.astype(float)]
    for fan in reversed(fans):
        counts.insert(0, (counts[0] > 0).reshape(-1, fan, dishes).sum(1).astype(float))
    tables = [(c > 0).astype(float) for c in counts]
    total = None
    for sweep in range(SWEEPS):
        probs = down(counts, tables)
        for level in range(len(sizes) - 1, -1, -1):
            c = counts[level]
            u, w = np.nonzero(c)
            parent = base[w] if level == 0 else probs[level - 1][u // fans[level - 1], w]
            t = seat(c[u, w], parent, np.minimum(tables[level][u, w], c[u, w]), tables[level].sum(1)[u], rng)
            tables[level] = np.zeros_like(c)
            tables[level][u, w] = t
            if level:
                counts[level - 1] = tables[level].reshape(-1, fans[level - 1], dishes).sum(1)
                tables[level - 1] = np.minimum(np.maximum(tables[level - 1], counts[level - 1] > 0), counts[level - 1])
        if sweep >= BURN_IN:
            got = down(counts, tables)[-2:]
            total = got if total is None else [x + y for x, y in zip(total, got)]
    return [x / (SWEEPS - BURN_IN) for x in total]


def held_out(ids: pa.Array) -> np.ndarray:
    """Texts whose id, as text, has a crc32 that 10 divides; a null id counts as empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids.to_pylist()], bool)


def doublings(total: int) -> int:
    """How often the numbers of buckets double for texts of total bytes."""
    return max(0, -(-total // PLAIN) - 1).bit_length()


def token_types(docs: DataFrame, types: int = TYPES) -> DataFrame:
    """(bucket, size, bytes): spellings of the distinct tokens of training texts, packed; one may come from several tasks."""

    def run(batches):
        held, many = [], 0

        def merged():
            value, size, raw = (np.concatenate(x) for x in zip(*held))
            one = np.unique(value, return_index=True)[1]
            start = np.cumsum(size) - size
            return value[one], size[one], raw[np.repeat(start[one], size[one]) + ranges(size[one])]

        def rows():
            value, size, raw = merged()
            order = np.argsort(value % np.uint64(types), kind="stable")
            start = (np.cumsum(size) - size)[order]
            bucket, size = (value[order] % np.uint64(types)).astype(np.int64), size[order]
            raw, ends = raw[np.repeat(start, size) + ranges(size)], np.append(0, np.cumsum(size))
            at = runs(bucket)
            pairs = list(zip(at, at[1:]))
            columns = [[int(bucket[i]) for i, _ in pairs], [narrow(size[i:j]) for i, j in pairs], [raw[ends[i] : ends[j]].tobytes() for i, j in pairs], [j - i for i, j in pairs]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64()))], ["bucket", "size", "bytes", "many"])

        for batch in batches:
            keep = pa.array(~held_out(batch.column(0)))
            for _, buf, off in slices(batch.column(1).filter(keep)):
                low, start, end, _, value = tokens(buf, off)
                value, one, _ = distinct(value)
                size = (end - start)[one]
                held.append((value, size, low[np.repeat(start[one], size) + ranges(size)]))
                many += len(value)
                if many > 1 << 20:
                    held = [merged()]
                    many = len(held[0][0])
                    if many > 1 << 19:
                        yield rows()
                        held, many = [], 0
        if held:
            yield rows()

    return docs.mapInArrow(run, "bucket long, size binary, bytes binary, many long")


def byte_counts(docs: DataFrame, types: int = TYPES) -> DataFrame:
    """(key, n) of both steps of spelling, over the distinct tokens of the training texts, each once."""

    def run(key, t):
        some = t.to_pylist()
        size = np.concatenate([wide(r["size"], r["many"]) for r in some])
        low = np.concatenate([np.frombuffer(r["bytes"], np.uint8) for r in some])
        stop = np.cumsum(size)
        start, value = stop - size, []
        for i in range(0, len(size), 1 << 16):
            a, b = start[i : i + (1 << 16)], stop[i : i + (1 << 16)]
            value.append(span_hash(low[a[0] : b[-1]], a - a[0], b - a[0]))
        one = distinct(np.concatenate(value))[1]
        held = []
        for i in range(0, len(one), 1 << 16):
            at = one[i : i + (1 << 16)]
            _, context, w, second = keys(*stream(low, start[at], stop[at]))
            held.append(np.unique(np.concatenate([context * CLASSES + w, SPELL + second[second >= 0]]), return_counts=True))
        k, n = (np.concatenate(x) for x in zip(*held))
        k, at = np.unique(k, return_inverse=True)
        return pa.table({"key": k.astype(np.int64), "n": np.bincount(at, n, len(k)).astype(np.int64)})

    return token_types(docs, types).groupBy("bucket").applyInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def distinct(x: np.ndarray):
    """As np.unique: sorted values, the index of one of each, and the place of each."""
    order = np.argsort(x)
    y = x[order]
    new = np.ones(len(x), bool)
    new[1:] = y[1:] != y[:-1]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return y[new], order[new], at


def runs(bucket: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)


def narrow(n: np.ndarray) -> bytes:
    """Counts in the least of 1, 4 and 8 bytes that holds them all; first all lowest bytes, so that the others' zeros compress."""
    top = n.max() if len(n) else 0
    width = 1 if top < 256 else 4 if top < 1 << 31 else 8
    return np.ascontiguousarray(n.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def wide(raw: bytes, many: int) -> np.ndarray:
    """The counts that narrow packed."""
    out = np.zeros((many, 8), np.uint8)
    if many:
        out[:, : len(raw) // many] = np.frombuffer(raw, np.uint8).reshape(-1, many).T
    return out.reshape(-1).view("<i8").astype(np.int64)


def short(w: np.ndarray) -> bytes:
    """The lower WORD bytes of hashes."""
    return np.ascontiguousarray(w.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD]).tobytes()


def long(raw: bytes) -> np.ndarray:
    """The hashes that short packed, with zeros above."""
    out = np.zeros((len(raw) // WORD, 8), np.uint8)
    out[:, :WORD] = np.frombuffer(raw, np.uint8).reshape(-1, WORD)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash for a context and a token."""
    return mix(u * np.uint64(0xD6E8FEB86659FD93) + w)


class Model:
    """Predictive probabilities of both steps: log10, by context and outcome.

    Contexts of the greatest depth that occurred have rows of their own; all others use the
    context that lacks the oldest item.
    """

    def __init__(self, parts: list[dict]):
        self.first_shallow = np.empty((CLASSES ** (DEPTH - 1), CLASSES), np.float32)
        self.second_shallow = np.empty((CLASSES - WIDE) * 256 * 256, np.float32).reshape(-1, 256)
        deep: dict[str, list] = {"first": [], "second": []}
        for p in parts:
            g, step = p["part"], "first" if p["part"] < CLASSES else "second"
            shallow = np.frombuffer(p["shallow"], np.float32)
            if step == "first":
                self.first_shallow.reshape(CLASSES, -1)[g] = shallow
            else:
                self.second_shallow.reshape(CLASSES - WIDE, -1)[g - CLASSES] = shallow
            deep[step].append((np.frombuffer(p["rows"], np.int32), np.frombuffer(p["deep"], np.float32)))
        self.first_at, self.first_deep = self._table(deep["first"], CLASSES**DEPTH, CLASSES)
        self.second_at, self.second_deep = self._table(deep["second"], (CLASSES - WIDE) * 256 * CLASSES, 256)

    @staticmethod
    def _table(some, contexts, dishes):
        rows = np.concatenate([r for r, _ in some])
        at = np.full(contexts, -1, np.int32)
        at[rows] = np.arange(len(rows))
        return at, np.concatenate([d.reshape(-1, dishes) for _, d in some]) if len(rows) else np.zeros((1, dishes), np.float32)

    def log10(self, out, begin, stop) -> np.ndarray:
        """log10 probability of each word of a stream."""
        own, context, w, second = keys(out, begin, stop)
        row = self.first_at[context]
        p = np.where(row >= 0, self.first_deep[row, w], self.first_shallow[context // CLASSES, w]).astype(np.float64)
        at = np.flatnonzero(second >= 0)
        ctx, byte = second[at] >> 8, second[at] & 255
        row = self.second_at[ctx]
        p[at] += np.where(row >= 0, self.second_deep[row, byte], self.second_shallow[ctx // CLASSES, byte])
        sums = np.concatenate([[0.0], np.cumsum(p)])
        ends = np.cumsum(stop - begin)
        return sums[ends] - sums[ends - (stop - begin)]


def learn(docs: DataFrame, types: int = TYPES) -> Model:
    """The model of (doc_id, text): Gibbs sampling runs in a task for each newest class, of at most 32**4 cells."""
    counts = cut(byte_counts(docs, types))
    # the root shares one measure: in how many contexts each class occurs
    seen = counts.filter(F.col("key") < SPELL).select((F.col("key") % CLASSES).alias("w"), F.floor(F.col("key") / CLASSES**3).alias("u")).distinct().groupBy("w").count().collect()
    base = np.ones(CLASSES)
    for r in seen:
        base[r["w"]] += r["count"]
    base /= base.sum()
    second = F.col("key") - SPELL
    group = F.when(F.col("key") < SPELL, F.floor(F.col("key") / CLASSES**DEPTH)).otherwise(CLASSES + F.floor(second / (256 * CLASSES * 256)))
    cell = F.when(F.col("key") < SPELL, F.col("key") % CLASSES**DEPTH).otherwise(second % (256 * CLASSES * 256))

    def sample(key, t):
        g = int(key[0].as_py())
        real = t.filter(pc.greater_equal(t["cell"], 0))
        cells, n = np.asarray(real["cell"]).astype(np.int64), np.asarray(real["n"])
        if g < CLASSES:
            fans, dishes, measure = [CLASSES] * (DEPTH - 1), CLASSES, base
        else:
            fans, dishes, measure = [256, CLASSES], 256, (CLASS == WIDE + g - CLASSES).astype(float)
            measure = measure / measure.sum()
        leaves = int(np.prod(fans))
        leaf = np.bincount(cells, n, leaves * dishes).reshape(leaves, dishes)
        shallow, deep = predictive(leaf, measure, fans, SEED + g)
        rows = np.flatnonzero(leaf.sum(1))
        with np.errstate(divide="ignore"):
            shallow, some = np.log10(shallow).astype(np.float32), np.log10(deep[rows]).astype(np.float32)
        first = g * leaves if g < CLASSES else (g - CLASSES) * leaves
        return pa.table({"part": [g], "shallow": [shallow.tobytes()], "rows": [(rows + first).astype(np.int32).tobytes()], "deep": [some.tobytes()]})

    every = counts.sparkSession.range(CLASSES + CLASSES - WIDE).select(F.col("id").alias("group"), F.lit(-1).cast("long").alias("cell"), F.lit(0).cast("long").alias("n"))
    cells = counts.select(group.cast("long").alias("group"), cell.cast("long").alias("cell"), "n").unionByName(every)
    got = cells.repartition(CLASSES + CLASSES - WIDE, "group").groupBy("group").applyInArrow(sample, "part long, shallow binary, rows binary, deep binary")
    return Model([r.asDict() for r in got.collect()])  # at most 32**5 probabilities


def scored(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score. Both scores are log10 probabilities over the tokens known from
    training and one more for all others; 10 ** (-score / n_tokens) is a perplexity.

    Texts whose crc32(doc_id as text) is divisible by 10 are held out, the others train the model
    and the base counts. Null and empty texts are a lone end; a null doc_id counts as the empty
    text. Ties and repeated rows are scored and counted row by row. With no training text every
    token is unknown. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions, -(-total // PART))
    shards = SHARDS << doublings(total)
    model = learn(docs, TYPES << doublings(total))
    part = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(parts)).cast("long").alias("part")
    placed = docs.select(part, "doc_id", "text").repartition(partitions, "part")

    sent = spark.sparkContext.broadcast(model)

    def vocabulary(t):
        """Distinct tokens of a part and FIRST, by bucket: values, their numbers in training texts, their spelling's log10 probability.
        Pairs of a context and a token, as context * tokens + token, and their numbers. Of each token in order: text, token, pair."""
        keep = ~held_out(t["doc_id"].combine_chunks())
        seen, spelled, held, texts = np.array([FIRST]), np.zeros(1), [], []
        for i, buf, off in slices(t["text"]):
            low, start, end, text, w = tokens(buf, off)
            value, one, _ = distinct(w)
            fresh = seen[np.minimum(np.searchsorted(seen, value), len(seen) - 1)] != value
            value, one = value[fresh], one[fresh]
            seen, spelled = np.append(seen, value), np.append(spelled, sent.value.log10(*stream(low, start[one], end[one])))
            order = np.argsort(seen)
            seen, spelled = seen[order], spelled[order]
            held.append(w)
            texts.append(text + i)
        text = np.concatenate(texts)
        at = distinct(np.concatenate(held))[2] + 1  # FIRST is the least
        order = np.argsort(seen % np.uint64(shards), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at, value, spelled = rank[at], seen[order], spelled[order]
        u = np.append(0, at[:-1])
        u[np.flatnonzero(np.append(True, text[1:] != text[:-1]))] = rank[0]
        both, _, pairs = distinct(u * len(value) + at)
        trains = keep[text]
        n, m = np.bincount(at, trains, len(value)).astype(np.int64), np.bincount(pairs, trains, len(both)).astype(np.int64)
        return (value, n, spelled), (both, m), (text, at, pairs)

    def spans(value):
        """Begin and end of each bucket's run."""
        bucket = (value % np.uint64(shards)).astype(np.int64)
        at = runs(bucket)
        return {int(bucket[a]): (int(a), int(b)) for a, b in zip(at, at[1:])}

    def tell(key, t):
        (value, n, spelled), (both, m), _ = vocabulary(t)
        size = np.bincount(both // len(value), minlength=len(value))
        ends, w = np.append(0, np.cumsum(size)), value[both % len(value)]
        rows = []
        for k, (a, b) in spans(value).items():
            c, d = ends[a], ends[b]
            rows.append((key[0].as_py(), k, value[a:b].tobytes(), narrow(n[a:b]), spelled[a:b].astype(np.float32).tobytes(), narrow(size[a:b]), short(w[c:d]), narrow(m[c:d])))
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 6)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "bucket", "value", "n", "spelled", "size", "word", "m"])

    def restaurants(some):
        """A bucket's tokens and those that follow them: hashes, one entry of each, each entry's place; the place of each pair told; tokens, customers and contexts of the pairs."""
        value, first, at = distinct(np.concatenate([np.frombuffer(r["value"], np.uint64) for r in some]))
        context = np.repeat(at, np.concatenate([wide(r["size"], len(r["value"]) // 8) for r in some]))
        w = np.concatenate([long(r["word"]) for r in some])
        m = np.concatenate([wide(r["m"], len(r["word"]) // WORD) for r in some])
        _, one, place = distinct(pair(context.astype(np.uint64), w))
        return (value, first, at), place, w[one], np.bincount(place, m, len(one)), context[one]

    def send(key, t):
        """What the context restaurants of a bucket send to the corpus restaurant: each token's tables, by its bucket."""
        _, _, w, c, context = restaurants(t.to_pylist())
        tables = context_tables(context, w, c, SEED + key[0].as_py())[0]
        w, tables = w[c > 0], tables[c > 0]
        w, _, at = distinct(w)
        seats = np.bincount(at, tables, len(w))
        order = np.argsort(w % np.uint64(shards), kind="stable")
        w, seats = w[order], seats[order]
        rows = [(k, short(w[a:b]), seats[a:b].astype(np.float32).tobytes()) for k, (a, b) in spans(w).items()]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "word": pa.array([r[1] for r in rows], pa.binary()), "seats": pa.array([r[2] for r in rows], pa.binary())})

    names = {"part": "long", "bucket": "long", "n": "binary", "left": "binary", "tables_after": "binary", "c": "binary", "many": "binary", "tokens": "long", "types": "long", "customers": "long", "tables": "double", "spelled": "double"}

    def count(key, t, sums_of):
        """Customers and tables of a bucket's tokens, contexts and pairs, back to the parts that told of them; the bucket's sums to every part."""
        bucket, some = key[0].as_py(), t.to_pylist()
        (value, first, at), place, w_of, c, context = restaurants(some)
        sizes = [len(r["value"]) // 8 for r in some]
        n = np.bincount(at, np.concatenate([wide(r["n"], k) for r, k in zip(some, sizes)]), len(value)).astype(np.int64)
        spelled = 10.0 ** np.concatenate([np.frombuffer(r["spelled"], np.float32) for r in some])[first].astype(float)
        got = sums_of.to_pylist()
        k = np.zeros(len(value))
        if got:
            w = np.concatenate([long(r["word"]) for r in got])
            seats = np.concatenate([np.frombuffer(r["seats"], np.float32) for r in got])
            w, _, of = distinct(w)
            seats = np.bincount(of, seats, len(w))
            mine = value & np.uint64((1 << 8 * WORD) - 1)
            where = np.minimum(np.searchsorted(w, mine), len(w) - 1)
            k = np.where(w[where] == mine, seats[where], 0.0)
        k = np.where(n > 0, np.maximum(np.rint(k), 1), 0).astype(np.int64)
        tables = sampled_tables(k, spelled, shards, SEED + bucket)
        sums = (int(n.sum()), int((n > 0).sum()), int(k.sum()), float(tables.sum()), float(spelled[n > 0].sum()))
        left = (k - CORPUS[0] * tables).astype(np.float32)
        seats, share = context_tables(context, w_of, c, SEED + bucket)
        after, c = np.bincount(context, seats, len(value)).astype(np.float32), c.astype(np.int64)
        rows, i, j = [], 0, 0
        for r, size in zip(some, sizes):
            a, b = at[i : i + size], place[j : j + len(r["word"]) // WORD]
            i, j = i + len(a), j + len(b)
            rows.append((r["part"], bucket, narrow(n[a]), left[a].tobytes(), after[a].tobytes(), narrow(c[b]), share[b][c[b] > 1].tobytes(), *sums))
        rows += [(p, bucket, *[None] * 5, *sums) for p in set(range(parts)) - {r["part"] for r in some}]
        kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
        return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows), names.values())], list(names))

    # one job, so that the texts and what is told of them are dealt out once each
    told = placed.groupBy("part").applyInArrow(tell, "part long, bucket long, value binary, n binary, spelled binary, size binary, word binary, m binary").repartition(partitions, "bucket")
    tables = told.groupBy("bucket").applyInArrow(send, "bucket long, word binary, seats binary")
    counted = told.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(count, ", ".join(f"{n} {k}" for n, k in names.items()))

    def score(key, t, notes):
        if not t.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        (value, _, spelled), (both, _), (text, at, pairs) = vocabulary(t)
        u, ones = both // len(value), spans(value)
        ends = np.append(0, np.cumsum(np.bincount(u, minlength=len(value))))
        known, left, after, c, seats = np.zeros(len(value), np.int64), np.zeros(len(value)), np.zeros(len(value)), np.zeros(len(both)), np.zeros(len(both))
        notes = sorted(notes.to_pylist(), key=lambda r: r["bucket"])
        n_all, n_types, n_customers, n_tables, n_spelled = (sum(r[k] for r in notes) for k in ("tokens", "types", "customers", "tables", "spelled"))
        for r in notes:
            if r["n"] is not None:
                a, b = ones[r["bucket"]]
                known[a:b], left[a:b], after[a:b] = wide(r["n"], b - a), np.frombuffer(r["left"], np.float32), np.frombuffer(r["tables_after"], np.float32)
                here = slice(ends[a], ends[b])
                c[here] = wide(r["c"], ends[b] - ends[a])
                seats[here] = unpacked_tables(c[here], np.frombuffer(r["many"], np.uint8))
        log, share = np.log10(known + 0.1), np.log10(n_all + 0.1 * (n_types + 1))
        d, strength = CORPUS
        spelled = np.where(known > 0, 10.0**spelled, max(1 - n_spelled, 1e-9))
        dish = (left + (strength + d * n_tables) * spelled) / (strength + n_customers)
        # every token but an end has one after it; a text's first comes after FIRST, as often as there are ends
        customers = np.where(value == FIRST, known[at[-1]], known)
        parent = in_context(c, seats, customers[u], after[u], dish[both % len(value)])
        ids = t["doc_id"].combine_chunks()
        n = len(ids)
        n_tokens, n_known = np.bincount(text, minlength=n), np.bincount(text, known[at] > 0, n).astype(np.int64)
        base = np.bincount(text, log[at], n) - n_tokens * share
        model_score = np.bincount(text, np.log10(in_text(text, np.where(known[at] > 0, at, len(value)), parent[pairs])), n)
        return pa.table({"doc_id": ids, "held_out": held_out(ids), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(len(ids), n_all), "base_score": base, "score": model_score})

    return placed.groupBy("part").cogroup(counted.groupBy("part")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def in_context(c: np.ndarray, seats: np.ndarray, customers: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Predictive probability of tokens after their contexts; c of a context's customers have the token, at so many of its tables."""
    d, strength = CONTEXT
    return (c - d * seats + (strength + d * tables) * parent) / (strength + customers)


def context_tables(context: np.ndarray, w: np.ndarray, c: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each pair of a context and a token that c customers have, averaged over sweeps; and where c is above one, what they
    are of the most that they can be, in 255ths, which is as exact as they are told."""
    t = (c > 0).astype(float)
    share, many = np.zeros(len(c), np.uint8), np.flatnonzero(c > 1)
    if len(many):
        dish, rng, total = distinct(w)[2], np.random.default_rng(seed), np.zeros(len(many))
        for sweep in range(CONTEXT_SWEEPS):
            served = np.bincount(dish, t)
            t[many] = seat(c[many].astype(float), (served / served.sum())[dish[many]], t[many], np.bincount(context, t)[context[many]], rng, *CONTEXT)
            if sweep >= CONTEXT_BURN_IN:
                total += t[many]
        total /= CONTEXT_SWEEPS - CONTEXT_BURN_IN
        share[many] = np.rint(255 * (total - 1) / (c[many] - 1))
    return unpacked_tables(c, share[many]), share


def unpacked_tables(c: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Tables of pairs with c customers; share is for those with more than one."""
    t, many = (c > 0).astype(float), c > 1
    t[many] = 1 + share / 255 * (c[many] - 1)
    return t


def sampled_tables(count: np.ndarray, spelled: np.ndarray, buckets: int, seed: int) -> np.ndarray:
    """Tables of each dish of the corpus restaurant, averaged over sweeps.

    Tokens are dealt to buckets by hash, so a bucket's tables stand for their share of all.
    """
    rng = np.random.default_rng(seed)
    at = np.flatnonzero(count)
    c, p = count[at].astype(float), spelled[at]
    t, total = np.ones(len(at)), np.zeros(len(count))
    for sweep in range(SWEEPS):
        t = seat(c, p, t, np.full(len(at), t.sum() * buckets), rng, *CORPUS)
        if sweep >= BURN_IN:
            total[at] += t
    return total / (SWEEPS - BURN_IN)


def in_text(text: np.ndarray, dish: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Predictive probability of each token in its text's restaurant, which seats them one by one.

    text and dish are those of each token, in order; a dish's first customer opens its table.
    """
    d, strength = TEXT
    order = np.argsort(text * np.int64(dish.max() + 1 if len(dish) else 1) + dish, kind="stable")
    a, b = text[order], dish[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
    before = np.empty(len(text), np.int64)
    before[order] = ranges(np.diff(np.append(new, len(a))))
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.empty(0, np.int64)
    place = ranges(np.diff(np.append(first, len(text))))
    opened = np.concatenate([[0], np.cumsum(before == 0)])[:-1]
    opened = opened - np.repeat(opened[first], np.diff(np.append(first, len(text))))
    return (np.where(before > 0, before - d, 0.0) + (strength + d * opened) * parent) / (strength + place)
