"""Token counts of flat, unindexed token files.

A flat file is nothing but token ids, each document's followed by an end-of-document id. The
files are read in blocks; each block is searched for separators with array operations and
says only how it begins, what lies inside and how it ends. Documents that cross blocks are
put together by a prefix scan over the blocks of their file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .flat import slices, span_hash, words
from .state import cut, is_small

#: Two-byte ids; 0 ends a document.
KIND, END = "<u2", 0
#: Bytes of a block, and of the largest file that a task reads whole; longer files are read in splits.
BLOCK, WHOLE = 1 << 20, 256 << 20


def write_token_files(docs: DataFrame, path: str) -> None:
    """Writes the words of every text as flat files of two-byte hashed ids, END after each text.

    Spark's text writer puts down raw bytes and, as line separator, the END id, so the folder
    can be in any store that Spark writes. Null and empty texts are a lone END.
    """

    def run(batches):
        for batch in batches:
            for _, buf, off in slices(batch.column(0)):
                start, end, text = words(buf, off)
                ids = (span_hash(buf, start, end) % np.uint64(65535) + np.uint64(1)).astype(KIND)
                n = np.bincount(text, minlength=len(off) - 1)
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32) * 2
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(ids.tobytes())])], ["ids"])

    docs.select("text").mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value")).write.option("lineSep", "\0\0").text(path)


NAMES = ["file", "block", "tokens", "seps", "head", "tail", "inner"]
BLOCKS = pa.schema([("file", pa.string()), *((n, pa.int64()) for n in NAMES[1:-1]), ("inner", pa.list_(pa.int64()))])
BLOCKS_SQL = "file string, block long, tokens long, seps long, head long, tail long, inner array<long>"


def searched(file: str, block: int, ids: np.ndarray, end: int) -> tuple:
    """What a block says of itself: see blocks()."""
    at = np.flatnonzero(ids == end)
    head, tail = (int(at[0]), len(ids) - 1 - int(at[-1])) if len(at) else (len(ids), 0)
    return file, block, len(ids), len(at), head, tail, (np.diff(at) - 1).tolist()


def blocks(spark: SparkSession, path: str, *, kind: str = KIND, end: int = END, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """(file, block, tokens, seps, head, tail, inner): per block its tokens, separators, tokens before
    the first and after the last separator, and the sizes of documents that lie inside.

    block is the number of the block's first token. Files of more than `whole` bytes are read in splits.
    """
    width = np.dtype(kind).itemsize
    step = max(block // width, 1) * width

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                raw, file = np.frombuffer(batch.column(1)[k].as_buffer(), np.uint8), batch.column(0)[k].as_py()
                if len(raw) % width:
                    raise ValueError(f"{file}: not a whole number of tokens")
                rows = [searched(file, i // width, raw[i : i + step].view(kind), end) for i in range(0, len(raw), step)]
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows], BLOCKS)

    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0)
    small = files.filter(F.col("length") <= whole).select(F.col("_metadata")["file_path"], "content").mapInArrow(run, BLOCKS_SQL)
    # only lengths are read here
    if files.filter(F.col("length") > whole).select("path").isEmpty():
        return small
    return small.unionByName(split_blocks(spark, path, kind, end, step, whole))


def split_blocks(spark: SparkSession, path: str, kind: str, end: int, step: int, whole: int) -> DataFrame:
    """blocks() of the files of more than `whole` bytes, each read by as many tasks as it has splits.

    Spark's line reader cuts files at the byte 10, so a split is whole lines, and the bytes of a file are its lines with
    that byte between them. A first pass counts each split's bytes; running sums say where each begins, so the second
    pass knows where tokens do. Tokens that lie across two splits are put together from their pieces. A stretch of 2 GB
    without the byte 10, and a name that ends like a compressed file's, are errors.
    """
    width = np.dtype(kind).itemsize
    mark = b"\xef\xbb\xbf"  # at the start of a file the line reader takes it for a byte order mark and leaves it out
    m = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("start"), m["file_size"].alias("size"), F.col("value").cast("binary").alias("line"))
    lines = lines.filter(F.col("size") > whole)
    per = cut(lines.groupBy("file", "size", "start").agg(F.sum(F.octet_length("line") + 1).alias("n")))
    file = W.partitionBy("file")
    lost = F.col("size") - F.sum("n").over(file)  # 0, or -1 without a last byte 10, or three more without the mark
    known = F.when(F.col("size") % width != 0, F.raise_error(F.concat("file", F.lit(": not a whole number of tokens")))).when(~lost.isin(0, -1, len(mark), len(mark) - 1), F.raise_error(F.concat("file", F.lit(": was not read byte by byte"))))
    before = F.coalesce(F.sum("n").over(file.orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = lost > 0
    first = F.col("start") == F.min("start").over(file)
    begin = F.when(first, 0).otherwise(before + F.when(marked, len(mark)).otherwise(0))
    starts = cut(per.select("file", "start", F.coalesce(known, begin).cast("long").alias("begin"), (marked & first).alias("marked")))
    # a split's lines stay in order: beside a broadcast table, or sorted again beyond its bound
    lines = lines.withColumn("k", F.monotonically_increasing_id())
    small = is_small(starts, F.length("file") + 32)
    placed = lines.join(F.broadcast(starts) if small else starts, ["file", "start"], "left")
    if not small:
        placed = placed.repartition("file", "start").sortWithinPartitions("file", "start", "k")
    begin = F.coalesce("begin", F.raise_error(F.lit("splits changed between two passes")).cast("long"))
    placed = placed.select("file", "start", "size", "line", begin.alias("begin"), "marked")

    def run(batches):
        """Blocks of whole tokens, and pieces of tokens (tokens 0) with their bytes as numbers."""
        split, held, at, first = None, bytearray(), 0, 0

        def taken(all_of: bool):
            # the bytes held begin at byte `at` of the file
            nonlocal at
            skip = min(-at % width, len(held)) if at == first else 0
            n = (len(held) - skip) // width * width
            if not all_of:
                n = n // step * step
            rows = [piece(at, held[:skip])] if skip and (n or all_of) else []
            if not (n or all_of):
                return rows
            raw = np.frombuffer(bytes(held[skip : skip + n]), np.uint8)
            rows += [searched(split[0], (at + skip + i) // width, raw[i : i + step].view(kind), end) for i in range(0, n, step)]
            if all_of and skip + n < len(held):
                rows.append(piece(at + skip + n, held[skip + n :]))
            del held[: skip + n]
            at += skip + n
            return rows

        def piece(where, some):
            return split[0], where // width, 0, 0, where, 0, list(some)

        def batch_of(rows):
            return pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows], BLOCKS)

        for batch in batches:
            for row in batch.to_pylist():
                if split != (row["file"], row["start"]):
                    if held and (rows := taken(True)):
                        yield batch_of(rows)
                    split, at, first = (row["file"], row["start"]), row["begin"], row["begin"]
                    held = bytearray(mark if row["marked"] else b"")
                held += row["line"]
                if at + len(held) < row["size"]:
                    held += b"\n"
                if len(held) >= 2 * step and (rows := taken(False)):
                    yield batch_of(rows)
        if held and (rows := taken(True)):
            yield batch_of(rows)

    def joined(batches):
        for batch in batches:
            rows = [searched(r["file"], r["block"], np.frombuffer(bytes(x for p in r["pieces"] for x in p["inner"]), kind), end) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows], BLOCKS)

    found = cut(placed.mapInArrow(run, BLOCKS_SQL))
    pieces = found.filter("tokens = 0").groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("head", "inner"))).alias("pieces"))  # a token's bytes at most
    return found.filter("tokens > 0").unionByName(pieces.mapInArrow(joined, BLOCKS_SQL))


def token_counts(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, doc, n_tokens): the documents of every file in order, and their tokens without END.

    Two ENDs in a row are a document without tokens. Tokens after the last END of a file are a
    document too; a file that ends with END has none there. Empty files have no documents.
    options are kind, end, block and whole of blocks().
    """
    b = blocks(spark, path, **options)
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # an open document began in the last block with a separator: its tail and all blocks since
    run = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("docs", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    b = b.withColumn("whole", F.sum(F.when(F.col("seps") == 0, F.col("tokens")).otherwise(0)).over(run)).withColumn("last", F.max(F.when(F.col("seps") > 0, F.struct("block", "tail", "whole"))).over(before))
    b = b.withColumn("whole_before", F.col("whole") - F.when(F.col("seps") == 0, F.col("tokens")).otherwise(0))
    opened = F.coalesce(F.col("last.tail") + F.col("whole_before") - F.col("last.whole"), F.col("whole_before"))
    b = b.withColumn("opened", opened).withColumn("next", F.lead("block").over(W.partitionBy("file").orderBy("block")))
    closing = F.when(F.col("seps") > 0, F.array(F.col("opened") + F.col("head"))).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("opened") + F.col("tokens"))
    ending = F.when(F.col("next").isNull() & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<bigint>"))
    return b.select("file", "docs", F.posexplode(F.concat(closing, "inner", ending)).alias("i", "n_tokens")).select("file", (F.col("docs") + F.col("i")).alias("doc"), "n_tokens")
