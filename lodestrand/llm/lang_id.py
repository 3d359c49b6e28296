"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from a hash of its code point. An n-gram is the product of its letters' vectors, each rotated by its
place; a text is the sum of its n-grams, a language the sum of its texts. Texts are compared with languages by cosine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, ready, rows_by_chars, trimmed
from .near_dedup import _mix

DIMENSIONS = 1024
TRAIN_ROWS = 40_000
MAX_LANGS = 1024
TEMPERATURE = 0.05
_BITS = 21
_tables: dict = {}


def _letters() -> np.ndarray:
    """By code point: the lower-case letter it stands for; 0: no letter."""
    if not _tables:
        table = np.zeros(0x110000, np.int64)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                table[cp] = ord(c.lower()[0])
        _tables["at"] = table
    return _tables["at"]


def _vectors(letters: np.ndarray) -> np.ndarray:
    """By rotation and letter: its vector of +1 and -1, whose bits are hashes of the code point."""
    x = _mix((letters.astype(np.uint64)[:, None] << np.uint64(8)) + np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(_mix(x).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    base = bits.astype(np.int8) * np.int8(2) - np.int8(1)
    return np.stack([np.roll(base, r, 1) for r in (2, 1, 0)])


def _trigrams(text: str) -> np.ndarray:
    """The codes of a text's letter trigrams; each run of other characters counts as one space."""
    s = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    s = np.concatenate(([0], s, [0]))
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = s[keep]
    return (s[:-2] << 2 * _BITS) | (s[1:-1] << _BITS) | s[2:] if len(s) > 2 else np.zeros(0, np.int64)


def profiles(texts: list[str | None], most_cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of texts, of unit length, and whether each has a letter.

    A trigram weighs the root of its count in sixteenths: sums of whole numbers come out the same in any batch.
    """
    out, has = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool)
    piece = 1 << 20
    codes, times = [], []
    for t in texts:
        found = [_trigrams(t[max(0, a - 2) : a + piece]) for a in range(0, len(t), piece)] if t else []
        x, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        codes.append(x)
        times.append(np.rint(16 * np.sqrt(n.astype(np.float32))))
    lens = np.array([len(x) for x in codes], np.int64)
    if not lens.sum():
        return out, has
    used, place = np.unique(np.concatenate(codes), return_inverse=True)
    weight, ends = np.concatenate(times), np.cumsum(lens)
    low = (1 << _BITS) - 1
    letters, at = np.unique(np.concatenate([used >> 2 * _BITS, used >> _BITS & low, used & low]), return_inverse=True)
    a, b, c = at.reshape(3, -1)
    vectors = _vectors(letters)
    step = max(1, most_cells // len(used))
    for k in range(0, len(texts), step):
        n = min(step, len(texts) - k)
        span = slice(int(ends[k] - lens[k]), int(ends[k + n - 1]))
        counts = np.zeros((n, len(used)), np.float32)
        counts[np.repeat(np.arange(n), lens[k : k + n]), place[span]] = weight[span]
        got = np.zeros((n, DIMENSIONS), np.float32)
        for u in range(0, len(used), 4096):
            z = slice(u, u + 4096)
            got += counts[:, z] @ (vectors[0][a[z]] * vectors[1][b[z]] * vectors[2][c[z]]).astype(np.float32)
        norm = np.sqrt((got.astype(np.float64) ** 2).sum(1, keepdims=True))
        out[k : k + n] = got / np.where(norm, norm, 1)
        has[k : k + n] = lens[k : k + n] > 0
    return out, has


def _bundle(batches):
    import pyarrow as pa

    sums: dict = {}
    for b in rows_by_chars(batches, 0):
        vecs, has = profiles(b.column(0).to_pylist())
        for lang, v, ok in zip(b.column(1).to_pylist(), np.rint(vecs * 10_000).astype(np.int64), has, strict=True):
            if ok:
                sums[lang] = sums.get(lang, 0) + v
    if sums:
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums)), "v": pa.array(list(sums.values()), pa.list_(pa.int64()))})


def train(labelled: DataFrame, most_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Language prototypes from columns text and lang (null in either is left out).

    At most about most_rows rows are fitted: those whose hash of the text falls under most_rows / (all rows), the same
    ones however the table is partitioned. Sums are of integers, so their order does not matter. The prototypes'
    common mean is taken off, which leaves what tells languages apart. Of languages equally near the first by name is
    predicted. Copies of a text are in the sample together or not at all, so where a few texts make up most rows the
    sample may hold more or fewer rows than most_rows.
    """
    ready(labelled.sparkSession)
    rows = only(labelled, "text", "lang").where("text is not null and lang is not null")
    n = rows.count()
    if n > most_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(most_rows / n * (1 << 30)))
    sums = rows.mapInArrow(_bundle, "lang string, v array<bigint>")
    got = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = got.orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    protos = np.array([[p.x for p in r.v] for r in found], np.float64).reshape(len(found), DIMENSIONS)
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    mean = protos.mean(0) if len(found) > 1 else np.zeros(DIMENSIONS)
    own = protos - mean
    return [r.lang for r in found], np.concatenate([[mean], own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)]).astype(np.float32)


def predict(vecs: np.ndarray, has: np.ndarray, langs: list[str], protos: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (its share among the languages) and cosine to the nearest prototype."""
    if not langs:
        return ["und"] * len(vecs), np.zeros(len(vecs)), np.zeros(len(vecs))
    own = vecs - protos[0]
    cos = (own @ protos[1:].T).astype(np.float64) / np.maximum(np.linalg.norm(own, axis=1), 1e-12)[:, None]
    best = cos.argmax(1)
    share = 1 / np.exp((cos - cos.max(1, keepdims=True)) / TEMPERATURE).sum(1)
    return [langs[k] if ok else "und" for k, ok in zip(best, has, strict=True)], np.where(has, share, 0.0), np.where(has, cos.max(1), 0.0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *keep: str) -> DataFrame:
    """Columns `keep` of docs, then lang_pred, score and cosine, from column text alone.

    Null text, or one without a letter: `und`, score 0. The model is a row per language, at most MAX_LANGS, so it
    goes to the tasks as it is. A long text is read in pieces, all of it.
    """
    langs, protos = model
    ready(docs.sparkSession)
    names, docs = list(keep), only(docs, *{*keep, "text"})
    at = names.index("text") if "text" in names else len(names)

    def run(batches):
        import pyarrow as pa

        for b in rows_by_chars(batches, at):
            lang, score, cos = predict(*profiles(b.column(at).to_pylist()), langs, protos)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score), pa.array(cos)], names=[*names, "lang_pred", "score", "cosine"])

    rows = docs.select(*names, *[] if "text" in names else ["text"])
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[: len(names)])
    return rows.mapInArrow(trimmed(run), kinds + ", lang_pred string, score double, cosine double")


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op2_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model, "doc_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
