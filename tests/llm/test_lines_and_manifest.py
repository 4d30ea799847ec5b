"""Line dedup and the Merkle manifest against brute force, with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, gone int, pos string, g string, h1 int, leaf int, salt string"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source, n_chars) with clashing columns."""
    return spark.createDataFrame([(*r, 1, "p", "g", 2, 3, "s") for r in rows], COLUMNS)


def odd_rows(seed=0):
    rng = random.Random(seed)
    lines = ["A common line here", "  a COMMON line here\t", "short", "ÀÉÎ long enough Ünïcode", "àÉÎ long enough Ünïcode", "\x0bexactly10c\x0c", "exactly10C", "", "   ", "another line of text"] + [f"line number {i}" for i in range(12)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))), rng.choice(["en", "de", "", "Z", None]), "src", rng.choice([None, i])) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "", 0), (102, "\n\n", "en", "s", 2), (103, "A common line here\n" * 3000, "en", "s", 9), (104, "x" * 200_000 + "\nanother line of text", "fr", "s", 1)]
    # rows that repeat, an id with other texts, null ids
    rows += [rows[3], rows[3], (5, "A common line here\nonly here, but twice\nonly here, but twice", "en", "s", 7), (None, "a common line here\nnull id, first line", "en", "s", 7), (None, "null id, first line", None, "s", 7)]
    return rows


def brute_lines(rows, least_docs=2, least_chars=10):
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOW)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        ids = lambda k: [x for x in holders[k] if x is not None]  # noqa: B023, E731
        kept = [x for x in lines if not (len(key(x)) >= least_chars and len(holders[key(x)]) >= least_docs and (i is None or i != min(ids(key(x)))))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def plain(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("least_docs, least_chars", [(2, 10), (4, 5)])
def test_lines(spark, monkeypatch, least_docs, least_chars):
    from faintdip.llm import line_dedup

    rows = odd_rows()
    want = plain(brute_lines(rows, least_docs, least_chars))
    for hot in (1 / 2000, 1 / 20):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        got = line_dedup.dedup_lines(frame(spark, rows).repartition(5), least_docs, least_chars)
        assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
        assert plain(tuple(r) for r in got.collect()) == want


def test_lines_of_no_rows(spark):
    from faintdip.llm.line_dedup import dedup_lines

    assert dedup_lines(frame(spark, odd_rows()).limit(0)).count() == 0


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, source, lang, n, text):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def tree(nodes):
    """All levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[k : k + 2]) for k in range(0, len(last), 2)])
    return levels


def path(levels, k):
    """(is left, digest) of the siblings of leaf k, with an empty digest where it is alone."""
    out = []
    for nodes in levels[:-1]:
        other = k ^ 1
        out.append((k % 2 == 1, nodes[other] if other < len(nodes) else ""))
        k //= 2
    return out


def brute_manifest(rows):
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        bad = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        honest = leaf_of(i, source, lang, n, text)
        groups[lang].append(((i is not None, i or 0), honest, leaf_of(i, source, lang, n + 1, text) if bad else honest, i))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: tree([x[1] for x in sorted(groups[lang])]) for lang in order}
    top = tree([trees[lang][-1][0] for lang in order])
    out = []
    for place, lang in enumerate(order):
        for k, (_, honest, claimed, i) in enumerate(sorted(groups[lang])):
            proof = path(trees[lang], k) + path(top, place)
            node = claimed
            for left, other in proof:
                node = digest(other, node) if left else digest(node, other)
            root = top[-1][0]
            out.append((i, honest, trees[lang][-1][0], root, digest(*(x for _, x in proof)), node, node == root))
    return out


@pytest.mark.parametrize("tier", [8, 2, 1])
def test_manifest(spark, tmp_path, monkeypatch, tier):
    from faintdip.llm import merkle
    from faintdip.llm.queries import op12_merkle_manifest

    monkeypatch.setattr(merkle, "TIER", tier)
    monkeypatch.setattr(merkle, "BLOCK", 1 << tier)
    # one language of 300 rows, one of a single row, 40 copies of a row
    rows = odd_rows() + [(1000 + i, f"text {i}", "xx", "s", i) for i in range(300 if tier == 8 else 37)] + [(9999, "alone", "zz", "s", 5)] + [(9000, "same", "xx", "s", 4)] * 40
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_manifest(rows)
    got = [tuple(r) for r in op12_merkle_manifest(spark, str(tmp_path)).collect()]
    assert plain(got) == plain(want)
    assert any(not x[-1] for x in want) and len({x[3] for x in got}) == 1


def test_manifest_of_few_rows(spark):
    from faintdip.llm.merkle import fold, manifest

    assert manifest(frame(spark, odd_rows()).limit(0)).count() == 0
    one = manifest(frame(spark, [(1, "a", None, None, None)])).first()
    assert one["leaf"] == one["claimed"] == one["subroot"] == one["root"] == leaf_of(1, None, None, None, "a") and one["siblings"] == [] and one["lang"] is None
    two = manifest(frame(spark, [(2, "b", "en", "s", 1), (1, "a", "en", "s", 1)])).withColumn("back", fold(F.col("leaf"), F.col("siblings"))).orderBy("doc_id").collect()
    assert [r["idx"] for r in two] == [0, 1] and all(r["back"] == r["root"] == digest(two[0]["leaf"], two[1]["leaf"]) for r in two)
