"""Token-id files: blocks of concatenated ids whose document boundaries are Elias-Fano encoded.

A block holds a run of documents in ascending doc_id order: the ids in 2 or 4 bytes each, and the end of every
document as an Elias-Fano sequence (n * (2 + log2(u / n)) bits) with a sampled select index.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_row, only, ready, rows_by_chars, scratch, trimmed, vocabulary
from .encoding import encoder

SAMPLE = 256
BLOCK_IDS = 1 << 19
SCHEMA = "part long, block long, n_docs long, n_ids long, width int, doc_ids array<bigint>, ef_low binary, ef_high binary, ef_bits int, ef_select binary, ids binary"
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space, with select."""

    def __init__(self, n: int, bits: int, low: bytes, high: bytes, select: bytes):
        self.n, self.bits = n, bits
        self.low, self.high, self.samples = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(select, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) + 1 if len(v) else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes())

    def _lows(self, i: int, n: int) -> np.ndarray:
        if not self.bits:
            return np.zeros(n, np.int64)
        a = i * self.bits
        got = np.unpackbits(self.low[a // 8 : (a + n * self.bits + 7) // 8], bitorder="little")[a % 8 : a % 8 + n * self.bits]
        return got.reshape(n, self.bits).astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, count ones byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        pos, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        if left:
            byte, head = pos // 8, pos % 8
            ones = int(_ONES[self.high[byte] >> head])
            left += 1
            while ones < left:
                left, byte, head = left - ones, byte + 1, 0
                ones = int(_ONES[self.high[byte]])
            word = int(self.high[byte]) >> head
            for k in range(8):
                left -= word >> k & 1
                if not left:
                    pos = byte * 8 + head + k
                    break
        return (pos - i) << self.bits | int(self._lows(i, 1)[0])

    def select_run(self, k: int) -> np.ndarray:
        """The values k * SAMPLE to (k + 1) * SAMPLE - 1, as far as there are any, from one sample on."""
        i = k * SAMPLE
        n = min(SAMPLE, self.n - i)
        if n <= 0:
            raise IndexError(i)
        pos = int(self.samples[k])
        to = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[pos // 8 : (to + 7) // 8], bitorder="little")[pos % 8 :])[:n] + pos
        return (ones - np.arange(i, i + n)) << self.bits | self._lows(i, n)

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


def _block(part: int, block: int, docs: list, ids: list[np.ndarray]) -> dict:
    data = np.concatenate(ids)
    width = 2 if int(data.max()) < 1 << 16 else 4
    ef = EliasFano.of(np.cumsum([len(x) for x in ids]))
    return {"part": part, "block": block, "n_docs": len(docs), "n_ids": len(data), "width": width, "doc_ids": docs, "ef_low": ef.low.tobytes(), "ef_high": ef.high.tobytes(), "ef_bits": ef.bits, "ef_select": ef.samples.tobytes(), "ids": data.astype(f"<u{width}").tobytes()}


def _writer(path: str, byte_level: bool, end_id: int, block_ids: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])
        enc, part, block = encoder(path, byte_level), TaskContext.get().partitionId(), 0
        docs, ids, n = [], [], 0

        def flush():
            return pa.RecordBatch.from_pylist([_block(part, block, docs, ids)], schema=schema)

        for b in rows_by_chars(batches, 1, most_rows=4096):
            flat, lens = enc.encode([t or "" for t in b.column(1).to_pylist()])
            ends = np.cumsum(lens + 1)
            out = np.full(len(flat) + len(lens), end_id, np.uint32)
            inner = np.ones(len(out), bool)
            inner[ends - 1] = False
            out[inner] = flat
            for d, a, z in zip(b.column(0).to_pylist(), (ends - lens - 1).tolist(), ends.tolist(), strict=True):
                docs.append(d)
                ids.append(out[a:z])
                n += z - a
                if n >= block_ids:
                    yield flush()
                    docs, ids, n, block = [], [], 0, block + 1
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, vocab: str, end_id: int, byte_level: bool = True, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text (null: empty), append end_id, and write blocks in ascending doc_id order to path.

    Range partitioning by doc_id is the one shuffle. Equal doc_ids lie together, ordered by text; a null doc_id
    comes first. A block ends with the document that reaches block_ids ids, so memory does not follow a partition.
    """
    spark = ready(docs.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (only(docs, "doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(trimmed(_writer(vocab, byte_level, end_id, block_ids)), SCHEMA).write.parquet(path))


def _opened(r: dict) -> tuple[EliasFano, np.ndarray]:
    return EliasFano(r["n_docs"], r["ef_bits"], r["ef_low"], r["ef_high"], r["ef_select"]), np.frombuffer(r["ids"], f"<u{r['width']}")


def _rows(r: dict, doc_ids, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, with_ids: bool):
    import pyarrow as pa

    parts = [ids[a:z].astype("<u4") for a, z in zip(starts, ends, strict=True)]
    out = {"doc_id": pa.array(doc_ids, pa.int64()), "part": pa.array([r["part"]] * len(ends), pa.int64()), "block": pa.array([r["block"]] * len(ends), pa.int64()), "at": pa.array(starts, pa.int64()), "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64())}
    if with_ids:
        out["ids"] = pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict(out)


def _reader(with_ids: bool):
    """All documents of every block, a run of SAMPLE boundaries at a time: no table of a block's boundaries is made."""

    def run(batches):
        for r in by_row(batches):
            ef, ids = _opened(r)
            before = 0
            for k in range(0, ef.n, SAMPLE):
                ends = ef.select_run(k // SAMPLE)
                yield _rows(r, r["doc_ids"][k : k + SAMPLE], np.concatenate(([before], ends[:-1])), ends, ids, with_ids)
                before = int(ends[-1])

    return run


def _finder(wanted: np.ndarray):
    """The wanted documents alone: a document's boundaries are two selects."""

    def run(batches):
        for r in by_row(batches):
            have = np.array([-1 if x is None else x for x in r["doc_ids"]], np.int64)
            at = np.flatnonzero(np.isin(have, wanted) & np.array([x is not None for x in r["doc_ids"]], bool))
            if len(at):
                ef, ids = _opened(r)
                ends = np.array([ef.select(int(i)) for i in at], np.int64)
                starts = np.array([ef.select(int(i) - 1) if i else 0 for i in at], np.int64)
                yield _rows(r, have[at], starts, ends, ids, True)

    return run


def _based(blocks: DataFrame, docs: DataFrame, with_ids: bool) -> DataFrame:
    """Documents with their start in the whole table: blocks' sizes are summed within a part, parts' sizes over parts."""
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    base = sizes.join(before, "part").select("part", "block", (F.col("before") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")).alias("base"))
    return docs.join(base, ["part", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return ready(spark).read.schema(SCHEMA).parquet(path)


ROWS = "doc_id long, part long, block long, at long, n_tokens long, ids_crc32 long"
IN_BLOCK = ("part", "block", "n_docs", "width", "doc_ids", "ef_low", "ef_high", "ef_bits", "ef_select", "ids")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in the whole table), n_tokens, ids_crc32 and, if asked, ids."""
    blocks = _blocks(spark, path)
    docs = blocks.select(*IN_BLOCK).mapInArrow(_reader(with_ids), ROWS + ", ids array<bigint>" * with_ids)
    return _based(blocks, docs, with_ids)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The same with ids, of the documents named (a list that the driver holds), of which a block's others are not decoded."""
    blocks = _blocks(spark, path)
    wanted = np.array(sorted(set(doc_ids)), np.int64)
    docs = blocks.select(*IN_BLOCK).mapInArrow(_finder(wanted), ROWS + ", ids array<bigint>")
    return _based(blocks, docs, True)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids in the block format, read the files back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(ready(spark), "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary("byte_bpe_50k.json"), 2)
    return read_tokens(spark, path)
