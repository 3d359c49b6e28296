"""Near-duplicate documents with SetSketch registers.

Register i of a set is 1 + floor(-log_b of the least of its elements' i-th exponential hashes), cut to 16 bits: the
minima are spaced exponentially, registers of a union are the larger ones of its parts, and equal registers are as
likely as sets are alike. Bands of registers give candidates, a joint likelihood of three register counts and the known
set sizes leaves out the hopeless, and whole shingle sets confirm the rest.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, drop_stored, only, ready, rows_by_chars, stored, trimmed

REGISTERS, BAND = 128, 4
BASE, RATE, TOP = 1.0005, 20.0, (1 << 16) - 2
#: Standard deviations of equal registers below the threshold at which a pair is left out unseen: under one in a million.
DEVIATIONS = 5.0
#: Rows of a bucket beyond which its pairs are not taken one by one but found by the sets' rarest shingles.
DIRECT = 64
#: Shingles of more members than this are ordered by hash alone.
RARE = 64
_rng = np.random.default_rng(7919)
_A = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PIECE = 1 << 20
_R = 0x9FB21C651E98DF25
_SPACE = re.compile(rb"[\x20\t-\r]")
_IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.full(max(n, PIECE + 4096), r, np.uint64) for r in (_R, pow(_R, -1, 1 << 64))]
        for p in _powers:
            p[0] = 1
            np.cumprod(p, out=p)
    return _powers


def _word_hashes(data: bytes, gap: np.ndarray = _IS_SPACE, cut: re.Pattern = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a byte string and where they begin: differences of prefix sums of byte * R^place.

    gap: by byte, whether it parts words; cut: a pattern of one such byte.
    """
    hashes, begins, at = [], [], 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        if to < len(data):  # cut at white space, so that no word is in two pieces
            m = cut.search(data, to)
            to = m.end() if m else len(data)
        x = np.frombuffer(data, np.uint8, to - at, at)
        edge = np.diff(gap[x], prepend=True, append=True)
        i = np.flatnonzero(edge).reshape(-1, 2)
        up, down = _power_tables(len(x) + 1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTES[x] * up[: len(x)], out=sums[1:])
        hashes.append(_mix((sums[i[:, 1]] - sums[i[:, 0]]) * down[i[:, 0]]))
        begins.append(i[:, 0] + at)
        at = to
    return (np.concatenate(hashes), np.concatenate(begins)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def streams(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its shingles of lower-cased (A-Z) words in order.

    A text of fewer words than size is one shingle, a null or blank one has none.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    h, at = _word_hashes(b"\n".join(raw).lower())
    n = np.diff(np.searchsorted(at, np.cumsum([0, *[len(x) + 1 for x in raw]])))
    first = np.cumsum(n) - n
    made = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.cumsum(made)
    doc = np.repeat(np.arange(len(n)), n)
    total = max(0, len(h) - size + 1)

    def joined(begin: np.ndarray | slice, words: int) -> np.ndarray:
        out = None
        for k in range(words):
            x = h[k : k + total] if isinstance(begin, slice) else h[begin + k]
            out = _mix((np.uint64(0x9E3779B97F4A7C15 * words & 0xFFFFFFFFFFFFFFFF) if out is None else out) + x)
        return out

    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    whole = np.ones(len(out), bool)
    for k in range(1, size):
        few = np.flatnonzero(n == k)
        out[(ends - 1)[few]] = joined(first[few], k) if len(few) else 0
        whole[(ends - 1)[few]] = False
    if total:
        out[whole] = joined(slice(0), size)[doc[:total] == doc[size - 1 :]]
    return np.split(out, ends[:-1]) if len(ends) else []


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(streams([text], size)[0])


def registers(hashes: np.ndarray) -> np.ndarray:
    """The SetSketch registers of a set of hashes; zeros for the empty set. Mergeable by np.maximum."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    h = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    for a in range(0, len(h), 2048):
        np.minimum(low, (h[a : a + 2048, None] * _A + _B).min(0), out=low)
    x = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) - _SHIFT, 1, TOP + 1).astype(np.uint16)


#: Registers of sets between one and 2^30 elements lie above this, so that they fit 16 bits.
_SHIFT = np.floor(1 - np.log(-np.log1p(-1 + 0.5 / 2.0**32) / RATE) / np.log(BASE))


def likeness(u: np.ndarray, v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Most likely resemblance of pairs of sets, given registers (pairs by REGISTERS) and set sizes."""
    up, down = (u > v).sum(1), (u < v).sum(1)
    same = REGISTERS - up - down
    s = n_u + n_v
    a, b = n_u / s, n_v / s
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    most = np.minimum(n_u, n_v) / np.maximum(n_u, n_v)
    best, at = np.full(len(s), -np.inf), np.zeros(len(s))
    for f in np.linspace(0, 1, 101):
        j = f * most
        # inclusion: |U - V| / |U u V| = a - b j, over the sizes' sum
        x, y = p(np.maximum(a - b * j, 0)), p(np.maximum(b - a * j, 0))
        with np.errstate(divide="ignore"):
            like = np.where(up, up * np.log(np.maximum(x, 1e-12)), 0) + np.where(down, down * np.log(np.maximum(y, 1e-12)), 0) + np.where(same, same * np.log(np.maximum(1 - x - y, 1e-12)), 0)
        better = like > best
        best, at = np.where(better, like, best), np.where(better, j, at)
    return at


def _sketcher(size: int):
    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in rows_by_chars(batches, 1):
            n, digest, regs = [], [], []
            for s in map(np.unique, streams(b.column(1).to_pylist(), size)):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "digest", "regs"])

    return run


def _keys() -> F.Column:
    """The keys of a set's bands: hashes of BAND registers and the band's place."""
    return F.array(*[F.xxhash64(F.substring("regs", 2 * a + 1, 2 * BAND), F.lit(a)) for a in range(0, REGISTERS, BAND)])


def _open(batches):
    import pyarrow as pa

    for b in batches:
        regs = [np.frombuffer(r, np.uint16).astype(np.int32) for r in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(regs, pa.list_(pa.int32()))], names=["id", "r"])


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs (a, b), the smaller id first."""
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _plausible(percent: int):
    least = percent / 100

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            regs = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5)]
            n_a, n_b = (b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
            keep = likeness(*regs, n_a, n_b) >= least - DEVIATIONS * np.sqrt(least * (1 - least) / REGISTERS)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in (0, 1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _sets(size: int):
    def run(batches):
        import pyarrow as pa

        for b in rows_by_chars(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(s).tobytes() for s in streams(b.column(1).to_pylist(), size)], pa.binary())], names=["id", "s"])

    return run


def _confirm(percent: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (s, t) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)  # read where Arrow has them
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole shingle sets are alike enough: a stored table.

    A set goes to the pairs in which it is a, and once to the place where the sets of all its partners meet it.
    """
    info = reps.select(F.col("id"), "n", "regs")
    wide = pairs.join(info.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("r_a")), "a").join(info.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("r_b")), "b")
    likely = stored(wide.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(_plausible(percent), "a long, b long"), "pairs")
    used = stored(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "used")
    sets = among(sets, used)
    two = likely.join(sets.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b")
    found = stored(two.select("a", "b", "s_a", "s_b").mapInArrow(_confirm(percent), "a long, b long"), "edges")
    drop_stored(likely, used)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the least id reachable over edges (a, b), for every id that has one.

    Each round gives every node the least label around it and then its label's label, so paths shorten twofold and
    more; labels are written to the shared folder each round.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        low = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("comp", "m").alias("c"), F.col("comp").alias("old"))
        jump = labels.select(F.col("id").alias("c"), F.col("comp").alias("cc"))
        new = stored(low.join(jump, "c", "left").select("id", F.least("c", F.coalesce("cc", "c")).alias("comp"), "old"), "labels")
        changed = new.where("comp <> old").limit(1).count()
        drop_stored(labels, *[] if changed else [both])
        labels = new.select("id", "comp")
        if not changed:
            return labels


def _lists(most: int, rows: int = 1 << 20):
    """A part's inverted lists: every shingle once with the number of its sets there and, up to `most`, their ids."""

    def run(batches):
        import pyarrow as pa

        def made(ids, sets):
            s = np.concatenate(sets)
            order = np.argsort(s, kind="stable")
            own = np.repeat(np.array(ids, np.int64), [len(x) for x in sets])[order]
            x, first, n = np.unique(s[order], return_index=True, return_counts=True)
            few = n <= most
            lens = np.where(few, n, 0)
            take = own[np.repeat(first, lens) + np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)]
            ends = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(take))], names=["s", "c", "ids"])

        ids, sets, n = [], [], 0
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                sets.append(np.frombuffer(x.as_buffer(), np.int64))
                n += len(sets[-1])
                if n >= rows:
                    yield made(ids, sets)
                    ids, sets, n = [], [], 0
        if sets:
            yield made(ids, sets)

    return run


def _rarest(percent: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols: list[list] = [[], [], [], []]
            for i, s, own, rare in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                s, own, rare = np.frombuffer(s, np.int64), np.array(own or (), np.int64), np.array(rare or (), np.int64)
                own, rare = own[np.isin(own, s)], rare[np.isin(rare, s)]  # where rows repeat an id
                last = len(s) + (-len(s) * percent // 100) + 1  # places of the order in which alike sets must share one
                order = np.concatenate((rare, s[~np.isin(s, np.concatenate((own, rare)))]))[: max(0, last - len(own))]
                cols[0].append(np.full(len(order), i))
                cols[1].append(np.arange(len(own), len(own) + len(order), dtype=np.int32))
                cols[2].append(order)
                cols[3].append(np.full(len(order), len(s)))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["id", "p", "s", "n"])

    return run


def by_rarity(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (id_a, id_b) of members (id, comp) of different components that may link; none that links is left out.

    Shingles are ordered by how many members have them, those of more than RARE members last and by hash. Sets alike
    enough share one of their first n - ceil(n * percent / 100) + 1 shingles of any one order, and the first shared one, at
    places p and q of the two orders by rarity, leaves room for enough others: min(n_a - p, n_b - q). A shingle's
    members of its largest component meet those of others alone. What a text has rarely is what sets it apart, so
    members of a large group that nothing links with meet few.
    """
    used = stored(members.select("id").distinct(), "used")
    sets = among(sets, used)
    lists = stored(sets.mapInArrow(_lists(RARE), "s long, c long, ids array<bigint>"), "lists")
    seen = lists.groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") <= RARE)
    rare = lists.drop("c").join(seen, "s").select(F.explode("ids").alias("id"), "c", "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("o")).select("id", F.filter("o", lambda x: x["c"] == 1)["s"].alias("own"), F.filter("o", lambda x: x["c"] > 1)["s"].alias("rare"))
    first = sets.join(rare, "id", "left").select("id", "s", "own", "rare").mapInArrow(_rarest(percent), "id long, p int, s long, n long")
    first = stored(first.join(members, "id").select("id", "n", "comp", "p", "s"), "rarest")
    drop_stored(lists)
    # stored before the join, so that Spark can split the rows of a hot shingle
    top = stored(first.groupBy("s", "comp").agg(F.count("*").alias("c")).groupBy("s").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("s", "top"), "top")
    left = first.join(top, "s").where("comp <> top").select("s", *[F.col(c).alias(f"{c}_a") for c in ("id", "n", "comp", "p")])
    right = first.select(F.col("s").alias("t"), *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "comp", "p")])
    room = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    pairs = stored(left.join(right, (F.col("s") == F.col("t")) & (F.col("comp_a") != F.col("comp_b")) & (room * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))).select("id_a", "id_b").distinct(), "rare")
    drop_stored(first, top, used)
    return pairs


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents link where 100 * |intersection| >= percent * |union| of their shingle sets (size words; a shorter text
    is one shingle; null, empty or blank text has none and links with nothing). component_id is the least doc_id
    reachable; of rows that repeat a doc_id all get the same answer from their own texts' links together. A null
    doc_id is its own component (null) and kept.

    Equal sets are one class with its least doc_id for it. A class first meets the most central member of each of its
    buckets (the one whose buckets hold most rows), which makes most of a large group one component. Of buckets that
    still hold several components, those of up to DIRECT rows have all pairs of different components taken, each in
    the first bucket it shares, but for those whose equal registers lie DEVIATIONS standard deviations below the
    threshold. The members of larger ones are joined on their rarest shingles (see by_rarity), which finds every link
    among them. No bucket is cut short.
    """
    ready(docs.sparkSession)
    docs = only(docs, "doc_id", "text")
    sketch = stored(docs.mapInArrow(trimmed(_sketcher(size)), "doc_id long, n long, digest binary, regs binary"), "sketch")
    classes = stored(sketch.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes")
    reps = classes.select("id", "n", "regs")
    band = reps.select("id", F.explode(_keys()).alias("k"))
    shared = stored(band.join(band.groupBy("k").agg(F.count("*").alias("size")).where("size > 1"), "k"), "shared")
    # the whole sets of classes that share a bucket are made and stored once
    used = stored(shared.select(F.col("id").alias("doc_id")).distinct(), "used")
    sets = stored(among(docs, used).select("doc_id", "text").mapInArrow(trimmed(_sets(size)), "id long, s binary").where("length(s) > 0"), "sets")
    central = shared.groupBy("id").agg(F.sum("size").alias("c"))
    lead = shared.join(central, "id").groupBy("k").agg(F.max_by("id", F.struct("c", -F.col("id"))).alias("b"))
    tried = stored(_ordered(shared.join(lead, "k").where("id <> b"), "id", "b"), "tried")
    edges = confirmed(tried, reps, sets, percent)
    comp = components(edges)
    drop_stored(edges)
    flat = shared.join(comp, "id", "left").select("id", "k", "size", F.coalesce("comp", "id").alias("comp"))
    mixed = flat.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("k")
    rest = stored(flat.join(mixed, "k"), "mixed")
    drop_stored(shared, used)
    few = rest.where(F.col("size") <= DIRECT)
    some = reps.join(few.select("id").distinct(), "id", "left_semi")
    wide = some.select("id", "n", _keys().alias("keys")).join(some.mapInArrow(_open, "id long, r array<int>"), "id")
    few = few.join(wide, "id")
    left, right = (few.select("k", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "comp", "keys", "r")]) for s in "ab")
    same = F.aggregate(F.zip_with("r_a", "r_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda x, y: x + y)
    p = percent / 100
    enough = REGISTERS * p - DEVIATIONS * (REGISTERS * p * (1 - p)) ** 0.5
    cross = left.join(right, (left["k"] == right["k"]) & (F.col("comp_a") < F.col("comp_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.element_at(F.array_intersect("keys_a", "keys_b"), 1) == left["k"]) & (same >= enough))
    rare = by_rarity(sets, rest.where(F.col("size") > DIRECT).select("id", "comp").distinct(), percent)
    open_pairs = stored(_ordered(cross.select("id_a", "id_b").union(rare), "id_a", "id_b").join(tried, ["a", "b"], "left_anti"), "open")
    drop_stored(rest, tried, rare)
    more = confirmed(open_pairs, reps, sets, percent)
    drop_stored(sets, open_pairs)
    edges = comp.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(more)
    # rows that repeat a doc_id with another text tie their classes together
    same = sketch.where("digest is not null and doc_id is not null").select("doc_id", "digest").distinct().join(classes.select("digest", "id"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    again = same.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a")
    ties = stored(same.join(again, "a", "left_semi"), "ties")
    final = components(edges.union(ties))
    tied = ties.select(F.col("a").alias("doc_id")).distinct().join(final.select(F.col("id").alias("doc_id"), F.col("comp").alias("tied")), "doc_id")
    out = sketch.join(classes.select("digest", "id"), "digest", "left").join(final, "id", "left").join(tied, "doc_id", "left")
    comp_id = F.coalesce("tied", "comp", "id", "doc_id")
    out = stored(out.select("doc_id", F.col("n").alias("n_shingles"), comp_id.alias("component_id"), F.coalesce(F.col("doc_id") == comp_id, F.lit(True)).alias("kept")), "components")
    drop_stored(sketch, classes, comp, more, ties, final)
    return out


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 3-word shingle sets alike by 0.85 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS root, doc_id AS d FROM w UNION SELECT r.root, g.b FROM r JOIN g ON r.d = g.a),
m AS (SELECT d, min(root) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN m ON m.d = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
