"""Token files read in splits, against a scan in one piece."""

import numpy as np
import pytest

from faintdip.llm.token_files import token_counts


@pytest.fixture
def splits(spark):
    """Splits of a given number of bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def size(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")
        spark.conf.set(names[2], "1")

    yield size
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def sizes(ids, end):
    """Documents' sizes, one token after the other."""
    out, n = [], 0
    for x in ids:
        if x == end:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + ([n] if n else [])


def cases():
    rng = np.random.default_rng(5)
    any_byte = rng.integers(0, 65536, 700).astype("<u2")
    few = rng.choice(np.array([0, 10, 10 * 256, 2570, 7, 256], "<u2"), 900)
    mark = np.frombuffer(b"\xef\xbb\xbf\x01" + bytes(few[:40].tobytes()), "<u2")
    return [
        ("<u2", any_byte), ("<u2", few), ("<u2", np.concatenate([few, np.array([10 * 256], "<u2")])), ("<u2", np.concatenate([few, np.array([0], "<u2")])), ("<u2", mark), ("<u2", np.frombuffer(b"\xef\xbb\xbf\n", "<u2")),
        ("<u2", np.zeros(300, "<u2")), ("<u2", np.full(300, 2570, "<u2")), ("<u2", np.full(300, 7, "<u2")),
        ("<u4", few.astype("<u4") * np.uint32(257)), ("<u4", np.where(rng.random(400) < 0.1, 0, rng.integers(0, 1 << 32, 400)).astype("<u4")),
    ]


@pytest.mark.parametrize("split", [5, 100])
def test_splits_like_one_piece(spark, splits, tmp_path, split):
    splits(split)
    for kind in ("<u2", "<u4"):
        some = [ids for k, ids in cases() if k == kind]
        folder = tmp_path / kind[1:]
        folder.mkdir()
        for i, ids in enumerate(some):
            (folder / f"{i}.bin").write_bytes(ids[: 100 if split == 5 else None].tobytes())
        got = {}
        # some files whole, the others in splits
        for r in token_counts(spark, str(folder), kind=kind, block=24, whole=8).collect():
            got.setdefault(int(r["file"].rpartition("/")[2][:-4]), {})[r["doc"]] = r["n_tokens"]
        for i, ids in enumerate(some):
            want = sizes(ids[: 100 if split == 5 else None], 0)
            assert got.get(i, {}) == dict(enumerate(want)), (kind, i, split)


def test_no_whole_number_of_tokens(spark, splits, tmp_path):
    splits(16)
    (tmp_path / "a.bin").write_bytes(b"x" * 101)
    with pytest.raises(Exception, match="not a whole number of tokens"):
        token_counts(spark, str(tmp_path), whole=8).collect()
