"""Sequence packing by the sum-of-squares rule, online and in each partition alone (no shuffle)."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import only, ready, rows_by_chars, trimmed, vocabulary
from .encoding import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Fill levels of the open sequences in an array n[level]; a piece goes where the sum of n[level]^2 grows least."""

    def __init__(self, size: int):
        self.size = size
        self.n = np.zeros(size + 1, np.int64)
        self.bins: list[list[list]] = [[] for _ in range(size + 1)]  # by level, sequences as lists of pieces

    def place(self, piece: tuple, length: int) -> list | None:
        """Add a piece of at most size ids; the sequence, if that fills it."""
        size, n = self.size, self.n
        low, high = n[: size - length + 1], n[length:]
        # A move from level h to h + length changes the sum by (2 n[h+length] + 1) - (2 n[h] - 1); full ones are not counted.
        cost = 2 * high + 1
        cost[-1] = 0
        cost[1:] -= 2 * low[1:] - 1
        cost[1:][low[1:] == 0] = np.iinfo(np.int64).max
        h = int(np.argmin(cost))
        if h:
            n[h] -= 1
            seq = self.bins[h].pop()
        else:
            seq = []
        seq.append(piece)
        if h + length == size:
            return seq
        n[h + length] += 1
        self.bins[h + length].append(seq)
        return None

    def close(self) -> list[list]:
        """End all open sequences without padding: the emptiest are cut to fill the others, the last into powers of two."""
        left = [(h, s) for h in range(1, self.size) for s in self.bins[h]]
        self.__init__(self.size)
        done, spare = [], []  # spare: pieces cut loose
        lo, hi = 0, len(left) - 1
        while lo <= hi:
            h, seq = left[hi]
            hi -= 1
            room = self.size - h
            while room and (spare or lo <= hi):
                if not spare:
                    spare, lo = left[lo][1], lo + 1
                d, start, ids, total = spare.pop()
                k = min(room, len(ids) // 4)
                seq.append((d, start, ids[: 4 * k], total))
                if 4 * k < len(ids):
                    spare.append((d, start + k, ids[4 * k :], total))
                room -= k
            (done.append(seq) if not room else spare.extend(seq))
        n = sum(len(p[2]) // 4 for p in spare)
        while n:
            size = min(self.size, 1 << n.bit_length() - 1)
            seq, room = [], size
            while room:
                d, start, ids, total = spare.pop()
                k = min(room, len(ids) // 4)
                seq.append((d, start, ids[: 4 * k], total))
                if 4 * k < len(ids):
                    spare.append((d, start + k, ids[4 * k :], total))
                room -= k
            done.append(seq)
            n -= size
        return done


def _packer(path: str, byte_level: bool, end_id: int, size: int, with_ids: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, first, n_seq = encoder(path, byte_level), TaskContext.get().partitionId() << 36, 0
        end = np.array([end_id], "<u4").tobytes()
        names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
        levels = SumOfSquares(size)

        def rows(seqs):
            nonlocal n_seq
            cols = [[] for _ in names]
            for seq in seqs:
                at = 0
                for d, start, ids, total in seq:
                    for c, v in zip(cols, (d, start, len(ids) // 4, zlib.crc32(ids), total, first + n_seq, at, np.frombuffer(ids, "<u4").astype(np.int64) if with_ids else None), strict=False):
                        c.append(v)
                    at += len(ids) // 4
                n_seq += 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for b in rows_by_chars(batches, 1, most_rows=4096):
            full = []
            flat, lens = enc.encode([t or "" for t in b.column(1).to_pylist()])
            data, ends = flat.astype("<u4").tobytes(), np.cumsum(lens).tolist()
            for d, n, z in zip(b.column(0).to_pylist(), lens.tolist(), ends, strict=True):
                x, total = data[4 * (z - n) : 4 * z] + end, n + 1
                for at in range(0, total, size):
                    k = min(size, total - at)
                    piece = (d, at, x[4 * at : 4 * (at + k)], total)
                    if (seq := [piece] if k == size else levels.place(piece, k)) is not None:
                        full.append(seq)
            if full:
                yield rows(full)
        if full := levels.close():
            yield rows(full)

    return run


def pack(docs: DataFrame, vocab: str, end_id: int, byte_level: bool, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pack all documents (null text: empty, which still has its end id) into sequences of at most size ids.

    Each partition of docs is packed online on its own, so nothing is shuffled: whole windows of a document longer
    than size stand alone, its rest is placed by the sum-of-squares rule. Sequences still open at a partition's end are
    closed by cutting pieces, and what remains is cut into powers of two, which need no padding. Empty and very long
    texts, ties between levels (the lowest is taken) and other columns change nothing in that.
    Repeated doc_ids stay separate documents. sequence_id is unique, not dense.
    """
    ready(docs.sparkSession)
    return only(docs, "doc_id", "text").mapInArrow(trimmed(_packer(vocab, byte_level, end_id, size, with_ids)), SCHEMA + ", ids array<bigint>" * with_ids)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents with the word vocabulary and end id 1: one row per piece."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"), 1, False)
