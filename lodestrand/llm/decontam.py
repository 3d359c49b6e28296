"""Benchmark decontamination over a distributed positional inverted index.

The index is split by document: a block holds, for its own run of documents, the sorted hashes of their words and each
word's sorted positions. It is made once, whatever the test set. The test set's windows go to every block; each starts
from its rarest word's positions there and is intersected with the other words' lists, shifted by their offsets, in
order of rarity.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, drop_stored, only, ready, rows_by_chars, scratch, stored, trimmed
from .near_dedup import _word_hashes

WINDOW = 13
BLOCK_WORDS = 1 << 16
#: Words of the test set that go to the tasks at a time, 8 bytes each.
TEST_WORDS = 1 << 20
INDEX = "part long, block long, doc_ids array<bigint>, n_words array<bigint>, terms binary, dfs binary, postings binary"
HITS = "doc_id long, part long, ordinal long, n_words long, spans array<struct<s:bigint,e:bigint>>, item_ids array<bigint>, near_item_ids array<bigint>, whole boolean"
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_GAPS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z alone) words of texts, one text after the other, and how many each has (a null: none)."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    h, at = _word_hashes(b"\n".join(raw).lower(), _GAP, _GAPS)
    return h, np.diff(np.searchsorted(at, np.cumsum([0, *[len(x) + 1 for x in raw]])))


def _indexer(block_words: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        docs, counts, stream, n = [], [], [], 0

        def flush():
            lens = np.array(counts, np.int64)
            h = np.concatenate(stream)
            at = np.arange(len(h)) + np.repeat(np.arange(len(lens)), lens)  # a place between documents stays free: no phrase crosses it
            order = np.argsort(h, kind="stable")
            terms, dfs = np.unique(h[order], return_counts=True)
            parts = (("part", pa.int64(), part), ("block", pa.int64(), block), ("doc_ids", pa.list_(pa.int64()), docs), ("n_words", pa.list_(pa.int64()), counts), ("terms", pa.binary(), terms.astype("<u8").tobytes()), ("dfs", pa.binary(), dfs.astype("<u4").tobytes()), ("postings", pa.binary(), at[order].astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for _, k, v in parts], names=[name for name, _, _ in parts])

        for b in rows_by_chars(batches, 1, most_chars=1 << 19):
            h, lens = word_hashes(b.column(1).to_pylist())
            docs += b.column(0).to_pylist()
            counts += lens.tolist()
            stream.append(h)
            n += len(h) + b.num_rows
            if n >= block_words:
                yield flush()
                docs, counts, stream, n, block = [], [], [], 0, block + 1
        if docs:
            yield flush()

    return run


def build_index(docs: DataFrame, path: str, block_words: int = BLOCK_WORDS) -> None:
    """Write the positional index of all words of all documents to path. Nothing is shuffled; a block ends with the batch that fills it.

    Hashes do not compress, and values of a megabyte make compressors hold that much memory outside the heap.
    """
    ready(docs.sparkSession)
    only(docs, "doc_id", "text").mapInArrow(trimmed(_indexer(block_words)), INDEX).write.option("compression", "none").parquet(path)


class Block:
    """One block of the index: its words' lists, looked up by hash."""

    def __init__(self, terms: bytes, dfs: bytes, postings: bytes, n_words: np.ndarray):
        self.terms, self.dfs = np.frombuffer(terms, "<u8"), np.frombuffer(dfs, "<u4").astype(np.int64)
        self.offs = np.cumsum(self.dfs) - self.dfs
        self.post = np.frombuffer(postings, "<u4").astype(np.int64)
        self.keys = np.repeat(np.arange(len(self.dfs)) << 32, self.dfs) | self.post  # all lists one after the other
        self.begins = np.cumsum(n_words + 1) - (n_words + 1)
        self.ends = self.begins + n_words

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of every word here, and the length of its list (0: not in this block)."""
        if not len(self.terms):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return at, np.where(self.terms[at] == hashes, self.dfs[at], 0)

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the place lies in the term's list."""
        want = term << 32 | place
        return self.keys[np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)] == want

    def next(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The least position of the term from place on; beyond all positions if there is none."""
        k = np.searchsorted(self.keys, term << 32 | np.maximum(place, 0))
        found = self.keys[np.minimum(k, len(self.keys) - 1)]
        return np.where((k < len(self.keys)) & (found >> 32 == term), found & 0xFFFFFFFF, 1 << 40)

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, place, "right") - 1


class Phrases:
    """A part of the test set: its words' hashes one after the other, and for each item's piece its number and length."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray, lens: np.ndarray, length: int):
        self.hashes, self.items, self.lens, self.length = hashes, items, lens, length

    def windows(self):
        """(words, first word of each window, its item) by length: whole windows, and shorter items by their length."""
        first = np.cumsum(self.lens) - self.lens
        for n in np.unique(np.minimum(self.lens, self.length)):
            own = np.flatnonzero(np.minimum(self.lens, self.length) == n)
            count = self.lens[own] - n + 1 if n == self.length else np.ones(len(own), np.int64)
            inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            if n:
                yield int(n), np.repeat(first[own], count) + inner, np.repeat(self.items[own], count)

    def _started(self, block: Block, most: int):
        """(words, windows' terms by rarity, their offsets, items, window and position of its rarest term), a bounded number at a time."""
        at, df = block.look_up(self.hashes)
        for n, start, items in self.windows():
            there = np.lib.stride_tricks.sliding_window_view(df, n).min(1) > 0
            live = np.flatnonzero(there[start])
            for a in range(0, len(live), 1 << 16):
                rows = start[live[a : a + (1 << 16)], None] + np.arange(n)
                order = np.argsort(df[rows], axis=1, kind="stable")
                terms = np.take_along_axis(at[rows], order, 1)
                own = items[live[a : a + (1 << 16)]]
                count = block.dfs[terms[:, 0]]
                ends = np.cumsum(count)
                k = 0
                while k < len(terms):
                    to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, "right")))
                    c = count[k:to]
                    w = np.repeat(np.arange(k, to), c)
                    inner = np.arange(len(w)) - np.repeat(np.cumsum(c) - c, c)
                    yield n, terms, order, own, w, block.post[block.offs[terms[w, 0]] + inner]
                    k = to

    def matches(self, block: Block, most: int = 1 << 20):
        """(start position, words, item) of every exact occurrence in a block."""
        for n, terms, order, items, w, place in self._started(block, most):
            start = place - order[w, 0]
            keep = start >= 0
            start, w = start[keep], w[keep]
            for k in range(1, n):
                if not len(w):
                    break
                keep = block.has(terms[w, k], start + order[w, k])
                start, w = start[keep], w[keep]
            if len(w):
                yield start, n, items[w]

    def near(self, block: Block, slop: int, most: int = 1 << 20):
        """(position, item) where all of a window's words lie in a document, in any order, within its length plus slop words."""
        for n, terms, _, items, w, place in self._started(block, most):
            reach = n + slop - 1
            for k in range(1, n):
                if not len(w):
                    break
                keep = block.next(terms[w, k], place - reach) <= place + reach
                place, w = place[keep], w[keep]
            for a in range(0, len(w), 4096):
                p, v = place[a : a + 4096], w[a : a + 4096]
                d = block.doc(p)
                begin = p[:, None] - np.arange(reach + 1)
                ok = begin >= block.begins[d][:, None]
                last = np.minimum(begin + reach, block.ends[d][:, None] - 1)
                for k in range(1, n):
                    ok &= block.next(np.broadcast_to(terms[v, k][:, None], begin.shape), begin) <= last
                good = ok.any(1)
                yield p[good], items[v[good]]


def _searcher(phrases: Phrases, slop: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                name = {x: r.column(k)[0] for k, x in enumerate(b.schema.names)}
                n_words = np.array(name["n_words"].as_py(), np.int64)
                block = Block(*(name[x].as_buffer() for x in ("terms", "dfs", "postings")), n_words)
                docs, total = len(n_words), int((n_words + 1).sum())
                change, whole = np.zeros(total + 1, np.int64), np.zeros(docs, bool)
                pairs = []  # document, item
                for start, n, item in phrases.matches(block):
                    np.add.at(change, start, 1)
                    np.add.at(change, start + n, -1)
                    d = block.doc(start)
                    whole[d] |= n == phrases.length
                    pairs.append(np.unique(np.stack([d, item], 1), axis=0))
                near = [np.unique(np.stack([block.doc(p), item], 1), axis=0) for p, item in phrases.near(block, slop) if len(p)] if slop else []
                edge = np.diff(np.cumsum(change) > 0, prepend=False, append=False)
                at = np.flatnonzero(edge).reshape(-1, 2)
                spans: list[list] = [[] for _ in range(docs)]
                for d, (s, e) in zip(block.doc(at[:, 0]).tolist(), (at - block.begins[block.doc(at[:, 0])][:, None]).tolist(), strict=True):
                    spans[d].append({"s": s, "e": e})
                exact: list[set] = [set() for _ in range(docs)]
                about: list[set] = [set() for _ in range(docs)]
                for into, found in ((exact, pairs), (about, near)):
                    for d, x in (y for f in found for y in f.tolist()):
                        into[d].add(x)
                first = name["block"].as_py() << 32
                ids = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(name["doc_ids"].as_py(), pa.int64()), pa.array([name["part"].as_py()] * docs, pa.int64()), pa.array(range(first, first + docs), pa.int64()), pa.array(n_words), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array([sorted(x) for x in exact], ids), pa.array([sorted(x - y) for x, y in zip(about, exact, strict=True)], ids), pa.array(whole)], names=[x.split()[0] for x in HITS.split(", ")])

    return run


def _item_hashes(batches):
    import pyarrow as pa

    for b in rows_by_chars(batches, 1):
        h, lens = word_hashes(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<u8").tobytes() for x in np.split(h, np.cumsum(lens)[:-1])], pa.binary())], names=["item_id", "words"])


def item_blocks(items: DataFrame, length: int = WINDOW, most_words: int = TEST_WORDS):
    """The test set as Phrases of at most about most_words words; longer items are dealt in pieces that overlap by a window less a word.

    Only hashes of words reach the driver, one item at a time. An item with a null id or text, or without words, is none.
    """
    bench = only(items, "item_id", "text").where("item_id is not null and text is not null")
    rows = stored(bench.mapInArrow(_item_hashes, "item_id long, words binary").where("length(words) > 0").distinct(), "items")
    parts, ids, lens, n = [], [], [], 0

    def made():
        return Phrases(np.concatenate(parts), np.array(ids, np.int64), np.array(lens, np.int64), length)

    for r in rows.toLocalIterator():
        h = np.frombuffer(r.words, "<u8").astype(np.uint64)
        for a in range(0, max(1, len(h) - length + 1), max(1, most_words)):
            x = h[a : a + most_words + length - 1]
            parts.append(x)
            ids.append(r.item_id)
            lens.append(len(x))
            n += len(x)
            if n >= most_words:
                yield made()
                parts, ids, lens, n = [], [], [], 0
    if parts:
        yield made()
    drop_stored(rows)


def find_phrases(docs: DataFrame, items: DataFrame, length: int = WINDOW, slop: int = 0, most_words: int = TEST_WORDS) -> DataFrame:
    """Per document: n_words, n_hit, the hit word spans, ids of items found exactly and (slop > 0) nearby, and whole: whether a window of `length` words was hit.

    The index is made in one pass over docs. The test set goes to the index's blocks a bounded part at a time; where it
    has several, the documents' results are put together. Null or empty texts have no words and no hits. Every row of
    docs gives one row, repeated ids too; of equal items each is named.
    """
    spark = ready(docs.sparkSession)
    path = scratch(spark, "index")
    build_index(docs, path)
    index = spark.read.schema(INDEX).parquet(path)
    parts = [index.mapInArrow(_searcher(p, slop), HITS) for p in item_blocks(items, length, most_words)]
    if not parts:
        parts = [index.mapInArrow(_searcher(Phrases(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), length), 0), HITS)]
    found = parts[0]
    if len(parts) > 1:
        for x in parts[1:]:
            found = found.unionByName(x)
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "item_ids", "near_item_ids")]
        found = found.groupBy("doc_id", "part", "ordinal", "n_words").agg(*lists, F.max("whole").alias("whole"))
        found = found.withColumn("item_ids", F.array_sort(F.array_distinct("item_ids")))
        found = found.withColumn("near_item_ids", F.array_sort(F.array_except("near_item_ids", "item_ids")))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["to"]), F.lit(0).cast("long"))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    n_hit = F.aggregate(F.array_sort("spans"), zero, step, lambda acc: acc["n"])
    found = stored(found.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "item_ids", "near_item_ids", "whole"), "hits")
    drop_path(spark, path)
    return found


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of 13-word benchmark windows in every document, with the items' digest. Proximity has no part in these columns."""
    found = find_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
