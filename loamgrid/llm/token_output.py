"""Token files: frequency-ranked ids in byte-aligned codes with separate control bytes."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir
from .tokens import PieceEncoder

#: Ids in one block, but for the rest of the document that fills it.
BLOCK_IDS = 1 << 20
#: Ids in one file, about.
FILE_IDS = 8 << 20
_DOCS_AT_ONCE = 512
#: Byte lengths of the four codes that a control byte describes.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode_codes(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of 32-bit numbers: two control bits a number hold its length less one, 1 to 4 bytes of data."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    more = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    control = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    control[: len(ranks)] = more
    control = control.reshape(-1, 4)
    packed = control[:, 0] | control[:, 1] << 2 | control[:, 2] << 4 | control[:, 3] << 6
    if len(ranks) and int(ranks.max()) < 1 << 16:  # the common case needs half the mask
        kept = np.empty((len(ranks), 2), bool)
        kept[:, 0], kept[:, 1] = True, more
        data = ranks.astype("<u2").view(np.uint8).reshape(-1, 2)[kept]
    else:
        data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= more[:, None]]
    return packed.tobytes(), data.tobytes()


def decode_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again: lengths come from a table of all control bytes."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    wide = 2 if n and lengths.max() <= 2 else 4
    out = np.zeros((n, wide), np.uint8)
    out[np.arange(wide, dtype=np.uint8) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u2" if wide == 2 else "<u4").reshape(-1).astype(np.uint32)


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, tie, ids, counts): each text's ids and `end_id`, as bytes of little-endian integers.

    Each task adds one row that holds its counts of all `size` ids in `counts`,
    which is null in all other rows.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        total, names, kinds = np.zeros(size, np.int64), ["id", "tie", "ids", "counts"], None
        for b in batches:
            kinds = [b.schema.field(0).type, pa.int64(), pa.binary(), pa.binary()]
            for at in range(0, b.num_rows, _DOCS_AT_ONCE):
                part = b.slice(at, _DOCS_AT_ONCE)
                ids = [(encoder.encode(bytes(x.as_buffer())) if x.is_valid else b"") + end for x in part.column(2)]
                total += np.bincount(np.frombuffer(b"".join(ids), encoder.dtype), minlength=size)
                columns = [part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
        if kinds:
            row = [[None], [None], [None], [total.astype("<i8").tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))
    return rows.mapInArrow(encoded, f"id {kind}, tie long, ids binary, counts binary")


def _counted(ids: DataFrame) -> list[tuple[int, int]]:
    """(id, count) over all documents; at most one row per id of the vocabulary."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.sum([np.frombuffer(x.as_buffer(), "<i8") for x in b.column(0)], axis=0)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = ids.filter("counts is not null").select("counts").mapInArrow(opened, "id long, n long")
    return [(r[0], r[1]) for r in rows.groupBy("id").agg(F.sum("n").alias("n")).collect()]


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Tokenize all documents and write them in ascending id order.

    Layout: `path/blocks`, Parquet rows (part, block, doc_ids, lengths, control,
    data); `path/ranks`, (rank, id).  Ids are ranked by their global frequency,
    most frequent first, so the most frequent 256 take one byte.  Files are cut
    by range of ids; `part` counts them in order and `block` counts in a part.
    Texts are tokenized once, into a table in the shared folder.

    A null text is empty (the end id alone); a null id sorts first; rows with
    one id follow each other by a hash of their texts; equal rows stay, all of
    them; an empty table gives no blocks; further columns are ignored.
    """
    spark = docs.sparkSession
    encoder = PieceEncoder.shared(tokenizer)
    size, dtype = max(encoder.size, end_id + 1), encoder.dtype.str
    at = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    raw = token_ids(docs, tokenizer, end_id, size, id_col, text_col)
    raw.write.option("compression", "zstd").parquet(at)
    ids = spark.read.schema(raw.schema).parquet(at)
    counts = sorted(_counted(ids), key=lambda r: (-r[1], r[0]))
    order = np.array([r[0] for r in counts], np.int64)
    rank_of = np.zeros(size, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank long, id long").write.parquet(f"{path}/ranks")
    kind = raw.schema["id"].dataType.simpleString()
    id_type = pa.list_(_arrow_type(raw))
    files = max(1, -(-sum(r[1] for r in counts) // FILE_IDS))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        PieceEncoder.release()  # its memory is of more use to this stage
        part, block = TaskContext.get().partitionId(), 0
        names, texts, n = [], [], 0

        def out() -> pa.RecordBatch:
            lengths = np.array([len(t) // encoder_size for t in texts], np.int64)
            control, data = encode_codes(rank_of[np.frombuffer(b"".join(texts), dtype)])
            row = [[part], [block], [names], [lengths], [control], [data]]
            kinds = [pa.int32(), pa.int32(), id_type, pa.list_(pa.int64()), pa.binary(), pa.binary()]
            columns = ["part", "block", "doc_ids", "lengths", "control", "data"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], columns)

        encoder_size = np.dtype(dtype).itemsize
        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                names.append(name)
                texts.append(bytes(x.as_buffer()))
                n += len(texts[-1]) // encoder_size
                if n >= BLOCK_IDS:
                    yield out()
                    block, names, texts, n = block + 1, [], [], 0
        if names:
            yield out()

    placed = ids.filter("counts is null").repartitionByRange(files, "id", "tie").sortWithinPartitions("id", "tie").select("id", "ids")
    schema = f"part int, block int, doc_ids array<{kind}>, lengths array<long>, control binary, data binary"
    placed.mapInArrow(blocks, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _arrow_type(raw: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(raw.schema["id"].dataType)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of each document, decoded from the files.

    `ids` are the bytes of little-endian 32-bit integers.

    `start` counts the ids of all documents before it: part totals are summed
    over the few parts, block totals inside each part, lengths inside a block.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    # at most one row per id of the vocabulary
    id_of = np.array([r[0] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()], "<u4")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lengths = np.asarray(b.column(3)[i].values, np.int64)
                total = int(lengths.sum())
                ids = id_of[decode_codes(bytes(b.column(4)[i].as_buffer()), bytes(b.column(5)[i].as_buffer()), total)]
                stops = np.cumsum(lengths)
                each = [ids[z - n : z].tobytes() for z, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
                m = len(lengths)
                columns = {
                    "part": pa.array(np.full(m, b.column(0)[i].as_py(), np.int32)),
                    "block": pa.array(np.full(m, b.column(1)[i].as_py(), np.int32)),
                    "id": b.column(2)[i].values,
                    "inside": pa.array(stops - lengths),
                    "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(each, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"part int, block int, id {kind}, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = blocks.select("part", "block", "doc_ids", "lengths", "control", "data").mapInArrow(decoded, schema)
    sizes = blocks.select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("block_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    starts = sizes.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("at"))
    return rows.join(starts, ["part", "block"]).select(
        "id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents through the files and back."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    back = read_tokens(spark, path, with_ids=False)
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
