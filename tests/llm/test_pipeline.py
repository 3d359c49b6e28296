"""Every stage of the pipeline against brute force, on a table with null, empty, repeated, tied and long rows."""

import functools
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lodestrand.llm import common, near_dedup, secret_scan

RNG = random.Random(31)
ALPHABETS = {"aa": "abcdefghik", "bb": "lmnopqrstu", "cc": "абвгдежзик"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT2 string"


def prose(n, lang="aa"):
    return " ".join("".join(RNG.choice(ALPHABETS[lang]) for _ in range(RNG.randint(3, 7))) for _ in range(n))


ITEMS = [(1, prose(40)), (2, prose(5)), (3, None), (4, ""), (None, prose(30))]
BASE = prose(80)


@functools.cache
def table():
    rows = [(i, prose(60, lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 12)]
    rows += [(100 + i, BASE if i < 3 else BASE + " " + prose(2), "aa") for i in range(6)]  # copies and near copies
    rows += [(200, prose(400) + " " + " ".join(ITEMS[0][1].split()[3:17]) + " " + prose(400), "aa")]  # a window in a long text
    rows += [(201, prose(30) + " " + " ".join(ITEMS[0][1].split()[3:15]) + " " + prose(30), "aa")]  # a word less than a window
    rows += [(202, prose(40) + " " + ITEMS[1][1] + " " + prose(10), "aa"), (203, prose(300) + " " + ITEMS[1][1], "aa")]
    rows += [(300, prose(30) + " password = hunter2hunter2 " + prose(10), "bb"), (301, prose(20) + " 0123456789abcdef0123456789abcdef", "bb")]
    rows += [(400, None, None), (401, "", "aa"), (402, "12 34 --", "aa"), (403, "  \n ", None)]
    rows += [(500, prose(50, "bb"), "bb"), (500, prose(50, "bb"), "bb"), (None, prose(50), None), (None, prose(50), None), (None, BASE, None)]
    rows += [(501, (t := prose(50, "bb")), "bb"), (501, t, "bb"), (502, prose(9000), "aa")]
    return [(i, t, lang, "src", len(t or ""), "clash") for i, t, lang in rows]


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(table(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def shingle_set(t, k=5):
    w = (t or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=repr)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def docs(spark, where):
    return spark.read.parquet(f"{where}/documents.parquet").withColumnRenamed("TEXT2", "Text")


def test_language_stage_keeps_what_has_a_language(spark, where, docs):
    got = rows_of(stage("language_id")(spark, docs, where))
    assert got == sorted((r[:5] for r in table() if re.search(r"[^\W\d_]", r[1] or "")), key=repr)


def test_dedup_stage_keeps_one_of_each_group(spark, where, docs):
    got = rows_of(stage("near_dedup")(spark, docs, where))
    rows = [r[:5] for r in table()]
    sets = [shingle_set(r[1]) for r in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                comp[find(a)] = find(b)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r)
    assert len(got) == len(groups) and set(got) <= set(rows)
    for members in groups.values():
        kept = list({r for r in members if r in got})
        assert len(kept) == 1 or not shingle_set(members[0][1])
        if len(members) > 1 and all(r[0] is not None for r in members):
            assert kept[0][0] == min(r[0] for r in members)


def hits(text, items):
    w, hit, whole = (text or "").split(), set(), False
    for i, t in items:
        u = (t or "").split()
        for a in range(max(1, len(u) - 12) if u and i is not None else 0):
            x = u[a : a + 13]
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit.update(range(s, s + len(x)))
                    whole |= len(x) == 13
    return len(hit), len(w), whole


def test_decontamination_stage_drops_every_passage(spark, where, docs):
    got = rows_of(stage("decontamination")(spark, docs, where))
    gone = lambda t: (lambda n, m, whole: whole or n > 0 and 20 * n >= m)(*hits(t, ITEMS))
    assert got == sorted((r[:5] for r in table() if not gone(r[1])), key=repr)
    ids = {r[0] for r in got}
    assert 200 not in ids and 202 not in ids and 201 in ids and 203 in ids


def test_secret_stage_redacts_and_keeps_every_row(spark, where, docs):
    got = rows_of(stage("secret_scan")(spark, docs, where))
    model = secret_scan.trained(docs)
    want = []
    for i, t, lang, source, n, _ in table():
        spans = secret_scan.all_spans([t or ""], model)[0]
        assert set(secret_scan.base_spans(t or "")) <= set(spans)
        hidden = [any(a <= k < z for a, _, z in spans) for k in range(len(t or ""))]
        out = "".join("[SECRET]" if h and not (k and hidden[k - 1]) else "" if h else c for k, (c, h) in enumerate(zip(t or "", hidden, strict=True)))
        want.append((i, t if t is None else out, lang, source, len(out) if spans else n))
    assert got == sorted(want, key=repr) and not any("hunter2" in (r[1] or "") for r in got)


def test_packing_stage_places_every_id_once(spark, where, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(common.vocabulary("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    pieces, seqs = {}, {}
    for r in stage("packing")(spark, docs, where).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for i, t, *_ in table():
        want.setdefault(i, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    assert set(want) == set(pieces)
    for i, docs_ids in want.items():
        assert sum(p[1] for p in pieces[i]) == sum(map(len, docs_ids))
        assert all(any(n == len(x) and zlib.crc32(x[a : a + k].tobytes()) == c for x in docs_ids) for a, k, c, n in pieces[i])
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


def test_whole_run_and_empty_tables(spark, where, tmp_path):
    got = corpus_pipeline.run(spark, where)
    assert got.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] and got.count() > 30
    spark.createDataFrame([], SCHEMA).drop("TEXT2").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_sets_of_the_stage_are_those_of_the_operator():
    assert all(len(near_dedup.shingles(r[1], 5)) == len(shingle_set(r[1])) for r in table())
