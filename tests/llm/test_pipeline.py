import collections
import re

import pytest

import corpus_pipeline


def test_stages_by_brute_force(spark, sf, tmp_path):
    """Each stage on all that its predecessor kept, against plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append((name, before, docs))
    (_, raw, a), (_, b_in, b), (_, c_in, c), (_, d_in, d), (_, e_in, e) = seen
    for frame in (a, b, c, d):
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert not [i for i in b_in if quality.get(i) == 0]
    long = [i for i, t in raw.items() if quality.get(i) == 1 and len(t.split()) >= 60]
    assert len([i for i in long if i in b_in]) >= 0.95 * len(long)
    # near-duplicates
    sets = {}
    for i, t in b_in.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y])
            if x < y and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                p, q = find(x), find(y)
                label[max(p, q)] = min(p, q)
    assert set(c_in) == {find(i) for i in sets}
    # benchmark
    find_words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    wins = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = find_words(r["text"])
        for k in range(max(1, len(w) - 9)):
            wins[len(w[k : k + 10])].add(tuple(w[k : k + 10]))
    bad = {i for i, t in c_in.items() for w in [find_words(t)] for n, some in wins.items() for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in some}
    assert set(d_in) == set(c_in) - bad and bad
    # secrets: rows stay, and what is not a secret stays as it was
    assert set(e_in) == set(d_in)
    assert all(e_in[i] == t or "[SECRET]" in e_in[i] for i, t in d_in.items())
    assert {r["doc_id"] for r in e.collect()} == set(e_in)


def test_stages_on_odd_rows(spark, sf):
    """Null, empty and very long texts, null and repeated ids, clashing columns, and no rows at all."""
    from pyspark.sql import functions as F

    words = " ".join(f"word{i}" for i in range(80))
    odd = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (None, words, "en", None, 1), (-3, words + " token = 'abcDEF123456'", "en", "s", 2), (-3, words + " token = 'abcDEF123456'", "en", "s", 2), (-4, " ".join(f"x{i}" for i in range(60_000)), "en", "s", 3)]
    base = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    clash = {c: F.lit(c) for c in ("row", "rid", "score", "kept", "component", "words", "n_words", "ids", "label")}
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).withColumns(clash).cache()
    all_odd = [-4, -3, -3, -2, -1, None]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "tokens" or out.columns == docs.columns, name
        got = sorted((r["doc_id"] for r in out.select("doc_id").collect() if r["doc_id"] is None or r["doc_id"] < 0), key=lambda i: i or 0)
        if name == "quality_rules":
            assert set(got) <= {-4, -3, None}  # the others have no words
        else:
            assert got == ([-4, -3, -2, -1, None] if name == "near_duplicates" else all_odd), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.filter("n_tokens <> size(ids)").count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op2_decontamination", "op7_chat_format"])
def test_sql_of_text_operators(spark, sf, name):
    import duckdb

    from faintdip.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in QUERIES[name](spark, sf).select(*cols).collect())


def test_stages_take_small_batches(spark, sf):
    """Texts are long rows: workers get 1,000 of them at a time at most, and run() restores the session."""
    import corpus_pipeline as P
    import pyarrow as pa

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    were = {k: spark.conf.get(k) for k in P.BATCHES}
    try:
        for before, most in (("10000", 1000), ("0", 1000), ("70", 70)):
            spark.conf.set(key, before)
            P.tokens(spark, spark.createDataFrame([], "doc_id long, text string"), sf)
            assert max(r["n"] for r in spark.range(2500, numPartitions=1).mapInArrow(rows, "n long").collect()) == most
        spark.conf.set(key, "10000")
        P.run(spark, sf)
        assert spark.conf.get(key) == "10000"
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
