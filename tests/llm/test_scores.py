"""The language model's scores against plain Python that counts, seats and predicts restaurant by restaurant."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest


def tokens(t):
    return [w.encode() for w in re.split("[\x20\x09-\x0d]+", t.lower()) if w] + [b"\n"]


def test_scores_by_brute_force(spark):
    from faintdip.llm import pitman_yor as P
    from faintdip.llm.flat import span_hash

    rng = random.Random(9)
    names = ["w" + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(25)]
    rows = [(i, " ".join(rng.choice(names) if rng.random() < 0.5 else names[(i + k) % 25] for k in range(rng.randint(0, 30)))) for i in range(80)]
    rows += [(500 + i, " ".join([*names[:6], f"new{i}"])) for i in range(20)] + [(None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    sort = {}

    def h(w):
        if w is None:
            return 0
        if w not in sort:
            buf = np.frombuffer(w, np.uint8)
            sort[w] = int(span_hash(buf, np.array([0]), np.array([len(buf)]))[0])
        return sort[w]

    # counts; None is the context of a first token
    n, pairs = collections.Counter(), collections.defaultdict(collections.Counter)
    every = {None}
    for i, t in rows:
        for u, w in zip([None, *tokens(t)], tokens(t)):
            every.add(w)
            n[w] += not out(i)
            pairs[u][w] += not out(i)
    # spelling
    model = P.learn(docs)
    spelled = {}
    for w in every - {None}:
        buf = np.frombuffer(w, np.uint8)
        spelled[w] = 10 ** float(np.float32(model.log10(*P.stream(buf, np.array([0]), np.array([len(buf)])))[0]))
    # contexts, a bucket at a time, in the order of hashes
    low48 = lambda w: h(w) & ((1 << 48) - 1)
    buckets = collections.defaultdict(list)
    for w in sorted(every, key=h):
        buckets[h(w) % P.SHARDS].append(w)
    seats, seated = collections.Counter(), {}
    for b, members in buckets.items():
        flat = [(x, w) for x, u in enumerate(members) for w in pairs[u]]
        if not flat:
            continue
        key = P.pair(np.array([x for x, _ in flat], np.uint64), np.array([low48(w) for _, w in flat], np.uint64))
        flat = [flat[k] for k in np.argsort(key)]
        c = np.array([pairs[members[x]][w] for x, w in flat], float)
        t, _ = P.context_tables(np.array([x for x, _ in flat]), np.array([low48(w) for _, w in flat], np.uint64), c, P.SEED + b)
        assert ((t >= (c > 0)) & (t <= c)).all()
        for (x, w), k in zip(flat, t):
            seated[members[x], w] = k
            seats[w] += k
    # the corpus
    customers, tables = {}, {}
    for b, members in buckets.items():
        k = np.array([max(round(seats[w]), 1) if n[w] else 0 for w in members])
        t = P.sampled_tables(k, np.array([spelled.get(w, 1.0) for w in members]), P.SHARDS, P.SEED + b)
        customers |= dict(zip(members, k.tolist()))
        tables |= dict(zip(members, t.tolist()))
    discount, strength = P.CORPUS
    total, opened = sum(customers.values()), sum(tables.values())
    unknown = 1 - sum(spelled[w] for w in every if w is not None and n[w])
    dish = lambda w: (customers[w] - discount * tables[w] + (strength + discount * opened) * (spelled[w] if n[w] else unknown)) / (strength + total)

    def parent(u, w):
        d, s = P.CONTEXT
        c = pairs[u][w]
        all_c, all_t = sum(pairs[u].values()), sum(seated.get((u, x), 0) for x in pairs[u])
        return (c - d * seated.get((u, w), 0) + (s + d * all_t) * dish(w)) / (s + all_c)

    want = []
    for i, t in rows:
        d, s = P.TEXT
        score, seen = 0.0, collections.Counter()
        for u, w in zip([None, *tokens(t)], tokens(t)):
            x = w if n[w] else None
            score += math.log10((max(seen[x] - d, 0) * (seen[x] > 0) + (s + d * len(seen)) * parent(u, w)) / (s + sum(seen.values())))
            seen[x] += 1
        want.append((str(i), t, score))
    got = {(str(r["doc_id"]), r["n_tokens"]): r["score"] for r in P.scored(docs).collect()}
    assert len(got) > 90
    for i, t, score in want:
        assert got[i, len(tokens(t))] == pytest.approx(score, abs=2e-3), (i, t)


def test_buckets_grow_with_texts_only():
    from faintdip.llm.pitman_yor import PLAIN, doublings

    assert [doublings(x) for x in (0, 1, PLAIN, PLAIN + 1, 2 * PLAIN, 5 * PLAIN, 100 << 40)] == [0, 0, 0, 1, 1, 3, 15]


def test_long_vocabularies():
    """Ranks of more than 16 bits take the way without a merge table."""
    import public_tokenizers as T
    import tiktoken

    from faintdip.llm.bpe import Encoder, merge_table, read_ranks

    pieces = read_ranks(T.path("byte_bpe_multi_50k.tiktoken"))
    more = pieces + [b"\xff\xfe%d" % i for i in range((1 << 16) - len(pieces) + 10)]
    with pytest.raises(ValueError):
        merge_table(more)
    enc = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks={p: i for i, p in enumerate(more)}, special_tokens={})
    texts = ["Hello there, world!", "", "été 12345 \n\n x" * 5]
    ids, begin = Encoder(more, T.PATTERN)(texts)
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [enc.encode_ordinary(t) for t in texts]


def test_all_labelled_documents_count(spark):
    """More good documents than the bound that there was."""
    import math

    from faintdip.llm.quality import BUCKETS, quality_rules

    n = 20_010
    docs = spark.range(n + 10).selectExpr("id as doc_id", f"if(id < {n}, 'x', 'y') as text")
    labels = spark.range(n + 10).selectExpr("id as doc_id", f"if(id < {n}, 1, 0) as quality")
    got = {round(r["score"], 9): r["threshold"] for r in quality_rules(docs, labels).select("score", "threshold").distinct().collect()}
    x = math.log((n + 1) / (n + BUCKETS)) - math.log((n + 1) / (n + 10 + BUCKETS))
    y = math.log(1 / (n + BUCKETS)) - math.log(11 / (n + 10 + BUCKETS))
    assert set(got) == {round(x, 9), round(y, 9)} and all(abs(t - (x + y) / 2) < 1e-9 for t in got.values())
