"""Operators against brute force on small tables with nulls, empty, repeated, tied and long rows."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import chat_format, common, decontam, encoding, fingerprints, html_extract, lang_id, near_dedup, packing, secret_scan, substring_dedup, token_output

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE, PASSAGE = prose(120), prose(70)
TEXTS = [BASE, BASE, BASE + " one more", " ".join(BASE.split()[:110]), prose(80) + " " + PASSAGE + " " + prose(60), PASSAGE + " " + prose(90), "", None, "  \t\n", "ab", "ab", "Zoë <|endoftext|> it's   wide\n\n\nspace x", prose(9000), "12345 67"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])] + [(None, "lost id")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else "xx", "src", 0, "clash") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT2 string").withColumnRenamed("TEXT2", "Text").repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return common.only(docs, "doc_id", "text")


ATOMS = ["'s", "'ll", " ", "  ", "\n", "\n\n", "\t", "don't", "word", "Wörld", "Ünï", "Œuvre", "œ", "É", "ÿ", "Ÿ", "×", "÷", "12", "7", "3.14", "...", "<|endoftext|>", "\u00a0", "\u3000", "日本", "\u0301", "é", "’", "“x”", "\r\n", "ſ", "ß", "İ", "\x00", "\x7f", "½", "²", "x" * 70, " -", "_", "\u200b", "\x85", "\x1c", "A", "b", "Ħ", "A\u030a", "Å"]


def none_like(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@functools.cache
def tokenizer(name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(common.vocabulary(name))
    tok.encode_special_tokens = True
    return tok


def ids_of(text, name, end, byte_level):
    tok = tokenizer(name)
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize(("name", "byte_level"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_encoding_is_the_tokenizers(name, byte_level):
    texts = [t or "" for t in TEXTS] + ["don't  stop", " a", "a ", "\n x\n\ny", "ÀÉ œuvre d'été 12'34 --- ...", "中文 字 😀😀 x", "　a b c", "x\r\n y"]
    check = lambda enc, some: [x.tolist() for x in np.split(*(lambda ids, n: (ids, np.cumsum(n)[:-1]))(*enc.encode(some)))] == [ids_of(t, name, 0, byte_level)[:-1].tolist() for t in some]
    assert check(encoding.Encoder(common.vocabulary(name), byte_level), texts)
    rng, small = random.Random(5), encoding.Encoder(common.vocabulary(name), byte_level, most=200)
    for _ in range(20):  # a table that is full again and again
        assert check(small, ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 12))) for _ in range(100)])


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    monkeypatch.setattr(encoding, "PIECE_CHARS", 300)
    enc = encoding.Encoder(common.vocabulary("byte_bpe_50k.json"), True)
    texts = [prose(500), "", "x" * 2000, " \n " * 300, prose(200) + "\n\n  " + prose(200), "é’ " * 400]
    ids, n = enc.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [ids_of(t, "byte_bpe_50k.json", 0, True)[:-1].tolist() for t in texts]
    assert enc.encode([])[0].tolist() == []


def test_elias_fano_selects_every_end():
    for values in ([], [0], [0, 0, 0], sorted(RNG.randrange(10**6) for _ in range(3000)), list(range(700))):
        ef = token_output.EliasFano.of(np.array(values, np.int64))
        assert [ef.select(i) for i in range(len(values))] == values
        assert [int(x) for k in range(0, len(values), token_output.SAMPLE) for x in ef.select_run(k // token_output.SAMPLE)] == values
        n, top = len(values), max(values, default=0) + 1
        assert 8 * ef.nbytes() <= n * (2 + max(0, (top // max(n, 1)).bit_length())) + 64  # near n * (2 + log2(u / n)) bits


def test_token_files_round_trip(spark, docs):
    path = common.scratch(common.ready(spark), "t")
    token_output.write_tokens(docs, path, common.vocabulary("byte_bpe_50k.json"), 2, block_ids=500)
    got = token_output.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    want = [(i, ids_of(t, "byte_bpe_50k.json", 2, True)) for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    at = 0
    for r, (i, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        at += len(ids)
    some = token_output.read_documents(spark, path, [0, 8, 12, 4000]).collect()
    whole = {r.doc_id: r for r in got}
    assert sorted(r.doc_id for r in some) == [0, 8, 12] and all(r == whole[r.doc_id] for r in some)
    empty = common.scratch(spark, "t")
    token_output.write_tokens(none_like(spark), empty, common.vocabulary("byte_bpe_50k.json"), 2)
    assert token_output.read_tokens(spark, empty).count() == 0


def test_packing_covers_every_id_once(spark, docs):
    got = packing.pack(docs, common.vocabulary("word_bpe_49k.json"), 1, False, size=256, with_ids=True).collect()
    pieces, seqs = {}, {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in ROWS:
        want = ids_of(t, "word_bpe_49k.json", 1, False).tolist()
        own = sorted(pieces[i], key=lambda p: p[0])
        times = sum(1 for r in ROWS if r[0] == i)
        assert sum(len(x[1]) for x in own) == times * len(want)
        assert all(ids == want[a : a + len(ids)] and n == len(want) for a, ids, n in own)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == 256 or at & (at - 1) == 0 and at < 256


def test_sum_of_squares_takes_the_least_rise():
    levels, rng = packing.SumOfSquares(16), random.Random(1)
    for k in range(300):
        before, length = levels.n.copy(), rng.randint(1, 15)
        cost = {}
        for h in range(16 - length + 1):
            if h == 0 or before[h]:
                n = before.copy()
                n[h] -= h > 0
                n[h + length] += h + length < 16
                cost[h] = int((n[:16] ** 2).sum())
        levels.place((k, 0, b"", 0), length)
        assert int((levels.n[:16] ** 2).sum()) == min(cost.values())


def test_language_of_held_out_documents(spark):
    rng = random.Random(3)
    alphabets = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "abcdqrst"}
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(40))
    rows = [(i, make(alphabets[k]), k) for i, k in enumerate(sorted(alphabets) * 40)] + [(900, None, "aa"), (901, "123 --", "bb"), (902, "", None), (903, make("abcdefgh"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = lang_id.train(df.where(~lang_id.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in lang_id.identify(df, model, "doc_id").collect()}
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows[:120])
    again = lang_id.train(df.where(~lang_id.held_out(F.col("doc_id"))).repartition(2))
    assert again[0] == model[0] and np.array_equal(again[1], model[1])
    assert lang_id.identify(df, lang_id.train(df.limit(0)), "doc_id").where("lang_pred = 'und'").count() == len(rows)


def brute_hits(text, items, n=13):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall((text or "").encode().lower())
    hit, found = set(), set()
    for i, t in items:
        u = word.findall((t or "").encode().lower())
        for a in range(max(1, len(u) - n + 1) if u else 0):
            x = u[a : a + n]
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit.update(range(s, s + len(x)))
                    found.add(i)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most_words", [1 << 20, 9])
def test_benchmark_hits(spark, docs, most_words):
    items = [(1, PASSAGE), (2, "ab"), (3, None), (4, "!!"), (5, " ".join(BASE.upper().split()[20:40])), (5, "67"), (None, BASE)]
    got = decontam.find_phrases(docs, spark.createDataFrame(items, "item_id long, text string"), most_words=most_words).collect()
    want = sorted((i if i is not None else -1, *brute_hits(t, [x for x in items if x[0] is not None])) for i, t in ROWS)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, sorted(set(r.item_ids))) for r in got) == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x one two gap three y"), (2, "three one two"), (3, "one two")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.find_phrases(docs, spark.createDataFrame([(7, "one two three")], "item_id long, text string"), slop=1).collect()}
    assert [got[i].near_item_ids for i in (1, 2, 3)] == [[7], [7], []] and all(r.n_hit == 0 for r in got.values())


def test_proximity_against_brute_force(spark):
    rng = random.Random(17)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    items = [(i, " ".join(rng.choice("abcdefghi") for _ in range(rng.randint(1, 7)))) for i in range(40)]
    got = decontam.find_phrases(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string"), length=4, slop=2, most_words=50).collect()
    for r in got:
        w, exact, near = texts[r.doc_id].split(), set(), set()
        for i, t in items:
            u = t.split()
            for a in range(max(1, len(u) - 3)):
                x = u[a : a + 4]
                exact |= {i for s in range(len(w)) if w[s : s + len(x)] == x}
                near |= {i for s in range(len(w)) if set(x) <= set(w[s : s + len(x) + 2])}
        assert set(r.item_ids) == exact and set(r.near_item_ids) == near - exact


def shingle_set(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    comp = {i: i for i, _ in sets}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    return {i: find(i) for i in comp}


@pytest.mark.parametrize("direct", [64, 2])
def test_near_duplicates(spark, docs, monkeypatch, direct):
    monkeypatch.setattr(near_dedup, "DIRECT", direct)  # at 2 most groups go by their rarest shingles
    rng = random.Random(5)
    base, more = prose(90, rng).split(), []
    for i in range(40):  # a group of copies with few to many words changed
        w = list(base)
        for k in rng.sample(range(90), i % 14):
            w[k] = rng.choice(WORDS)
        more.append((100 + i, " ".join(w)))
    rows = ROWS + more
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(df, 3, 85).collect()
    want = brute_components(rows, 3, 85)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert {(r.doc_id, r.n_shingles) for r in got} == {(i, len(shingle_set(t, 3))) for i, t in rows}


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(none_like(spark)).count() == 0


def test_registers_merge_and_estimate():
    a, b = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(1001, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    u, v = near_dedup.registers(a), near_dedup.registers(b)
    assert np.array_equal(np.maximum(u, v), near_dedup.registers(np.union1d(a, b)))
    assert abs(near_dedup.likeness(u[None].astype(int), v[None].astype(int), np.array([4000.0]), np.array([4000.0]))[0] - 0.6) < 0.15


def test_fingerprints(spark, docs):
    small = fingerprints.with_sketch(docs.select(docs.columns[0]).limit(0).select(F.lit("x").alias("text")), "text", "s")
    assert small.count() == 0
    df = spark.createDataFrame([(1, BASE), (2, BASE + " one more"), (3, ""), (4, None), (5, PASSAGE), (6, "ab")], "doc_id long, text string")
    s = {r.doc_id: r.s for r in fingerprints.with_sketch(df, "text", "s").collect()}
    assert s[3] == s[4] == [] and len(s[6]) == 1 and s[1] == sorted(s[1])
    pair = spark.createDataFrame([(s[1], s[2], s[5], s[3])], "a array<long>, b array<long>, c array<long>, e array<long>")
    r = pair.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("ab"), fingerprints.resemblance(F.col("a"), F.col("c")).alias("ac"), fingerprints.containment(F.col("a"), F.col("b")).alias("inside"), fingerprints.resemblance(F.col("e"), F.col("e")).alias("ee"), fingerprints.distinct_count(F.col("a")).alias("n")).first()
    exact = len(shingle_set(BASE, 5) & shingle_set(BASE + " one more", 5)) / len(shingle_set(BASE, 5) | shingle_set(BASE + " one more", 5))
    assert abs(r.ab - exact) < 1e-9 and r.ac < 0.1 and r.inside > 0.95 and r.ee == 1 and r.n == len(shingle_set(BASE, 5))
    both = fingerprints.merged(spark.createDataFrame([(1, s[1]), (1, s[5])], "g long, s array<long>"), "s", "g").first().s
    assert both == sorted(set(s[1]) | set(s[5]))[: fingerprints.K]


def test_edited_texts(spark, docs):
    got = fingerprints.edited_pairs(docs).select("doc_id", "text", "lent").collect()
    order = sorted({i for i, _ in ROWS if i is not None}, reverse=True) + [None]
    first = {}
    for i, t in ROWS:
        first[i] = min(first.get(i, t or ""), t or "")
    after = {i: first[order[(k + 1) % len(order)]] for k, i in enumerate(order)}
    assert len(got) == len(ROWS)
    for r in got:
        third = len(r.text) // 3
        assert (r.lent or "")[:third] == after[r.doc_id][:third]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secrets(spark):
    key = "AKIA" + "Q7Z2" * 4
    texts = ["nothing here", None, "", f"x {key} y", 'Password: "hunter2hunter2" end', "token=short", "0123456789abcdef" * 2, "z" * 3000 + " api_key = abcdefgh1234 " + "é" * 50, "ghp_" + "a8Kd72LqPz0Xw9Rt5Yv3Bn6Mc1Hj4Fs7Gd2" + " is it"]
    got = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id").orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        said = ",".join(f"{secret_scan.KINDS[k]}:{a}:{z}" for a, k, z in sorted(base))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert all(x in r.spans.split(",") for x in said.split(",") if x)
    assert got[1].redacted is None and key not in got[3].redacted and got[0].redacted == "nothing here"


def test_network_keeps_its_recall():
    model = secret_scan.default_model()
    parts, labels = secret_scan.example_findings(600, seed=99)
    p = model.probability(model.logits(parts))
    assert (p[labels > 0] >= model.threshold).mean() > 0.9 and (p[labels == 0] >= model.threshold).mean() < 0.15


def test_compact_windows_stand_for_every_stretch():
    rng = np.random.default_rng(3)
    h = np.concatenate((rng.integers(1, 12, 60), [0], rng.integers(1, 200, 40))).astype(np.uint32)
    left, c, r = (x.tolist() for x in substring_dedup.compact_windows(h, 8, 60))
    for a in range(len(h)):
        for z in range(a + 7, len(h)):
            if (h[a : z + 1] > 0).all():
                k = a + int(np.argmin(h[a : z + 1]))
                assert any(l <= a and i == k and z <= e for l, i, e in zip(left, c, r, strict=True))


def test_repeated_passages(spark, docs):
    got = {(r.doc_id, r.other_id): r for r in substring_dedup.repeated_passages(docs).collect()}
    r = got[5, 4]
    a, b = TEXTS[5].split()[r.start : r.end], TEXTS[4].split()[r.other_start : r.other_end]
    assert len(a) >= 50 and " ".join(a) in PASSAGE + " " + prose(0) and r.similarity >= 0.8 and len(b) >= 50
    assert (1, 0) in got and got[1, 0].similarity == 1.0 and {x[0] for x in got} <= {1, 2, 3, 5}
    assert substring_dedup.repeated_passages(none_like(spark)).count() == 0


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 0.9), (1, 3, 1, "assistant", None, 0.1), (1, 4, 2, "user", "more", None), (2, 5, 99, None, "alone", 0.5), (3, 6, 7, "user", "x", 0.0), (3, 7, 6, "user", "cycle", 0.0)]
    df = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = {(r.conv_id, r.leaf): [(t.role, t.text) for t in r.turns] for r in chat_format.conversations(df).collect()}
    assert got == {(1, 4): [("user", "q"), ("assistant", "a"), ("user", "more")], (1, 3): [("user", "q"), ("assistant", "")], (2, 5): [("", "alone")]}
    assert {(r.conv_id, r.leaf) for r in chat_format.conversations(df, 1).collect()} == {(1, 4), (2, 5)}


def test_template_is_reversible():
    turns = [("user", chat_format.TRICK), ("a\n%0A<|im_end|>", "<|\\im_start|> \\<|\\\\im_end|>\n"), ("assistant", "")]
    text = "".join(chat_format.format_turn(r, t)[0] for r, t in turns)
    assert chat_format.read_back(text) == turns


def test_long_thread(spark):
    rows = spark.range(70).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat_format.format_chats(chat_format.linear(rows)).first()
    assert [t for _, t in chat_format.read_back(r.formatted)] == [str(i) for i in range(70)]


PAGE = "<html><head><title>t</title></head><body><nav>Menu</nav><div class='promo-x'>Site line</div><article><h1>A &amp; B{0}</h1><p>One <b>two</b>\n three{0}</p><ul><li>x{0}<li>y</ul><div class=related>more</div></article><footer>f</footer></body></html>"


def test_main_text(spark):
    pages = [(i, f"http://Host.example:80/{i}", PAGE.format(i)) for i in range(8)] + [(8, None, "<p>a<p>b&lt;"), (9, "x", None), (10, "http://h/", ""), (11, "http://host.example/", "<div>" * 3000 + "deep")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0].text == "A & B0\nOne two three0\nx0\ny" and got[8].text == "a\nb<" and got[9].text == got[10].text == "" and got[11].text == "deep"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_site_template_without_an_article(spark):
    page = "<body><div><div>Same on every page of this site</div><div>Own words {0} here</div></div></body>"
    got = html_extract.extract(spark.createDataFrame([(i, "http://s.example/a", page.format(i)) for i in range(10)], "page_id long, url string, html string")).collect()
    assert all(r.text == f"Own words {r.page_id} here" for r in got)


def hashed(t, k=5):
    return near_dedup.streams([t], k)[0].astype(np.uint32)


def test_passages_beyond_the_least_document(spark):
    rng = random.Random(11)
    line = min((prose(5, rng) for _ in range(4000)), key=lambda t: int(near_dedup._mix(near_dedup.streams([t], 5)[0] ^ substring_dedup._SEEDS[0])[0] >> np.uint64(32)))
    shared = [f"{prose(30, rng)} {line} {prose(30, rng)}" for _ in range(3)]
    rows = [(0, f"{prose(60, rng)} {line} {prose(60, rng)}")] + [(1 + i, f"{prose(60, rng)} {shared[i % 3]} {prose(60, rng)}") for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in substring_dedup.repeated_passages(df, hashes=1).collect():
        got.setdefault(r.doc_id, set()).add(r.other_id)
    for i, t in rows:
        brute = {j for j, u in rows if j < i and substring_dedup.passages(hashed(t), hashed(u), 46, 80)}
        assert bool(brute) == bool(got.get(i)) and got.get(i, set()) <= brute
    assert sorted(got) == list(range(4, 25))


@pytest.mark.parametrize("changed", [0, 1])
def test_passages_behind_pieces_of_them(spark, changed):
    """40 pairs share a passage of 60 words, in the second case one word changed; lesser documents hold 20 words of each."""
    rng = random.Random(23 + changed)
    rows, brute = [], set()
    for k in range(40):
        p = [rng.choice(WORDS) for _ in range(60)]
        q = list(p)
        for i in rng.sample(range(60), changed):
            q[i] = rng.choice(WORDS)
        for j in range(3):  # pieces that hold most roots of the passage
            rows.append((3 * k + j, f"{prose(40, rng)} {' '.join(p[20 * j : 20 * j + 20])} {prose(40, rng)}"))
        a, b = f"{prose(50, rng)} {' '.join(p)} {prose(50, rng)}", f"{prose(50, rng)} {' '.join(q)} {prose(50, rng)}"
        rows += [(1000 + 2 * k, a), (1001 + 2 * k, b)]
        if substring_dedup.passages(hashed(b), hashed(a), 46, 80):
            brute.add((1001 + 2 * k, 1000 + 2 * k))
    got = {(r.doc_id, r.other_id) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(brute) >= 30 and got <= brute and len(got) >= (1 - 0.05 * changed) * len(brute)


def test_passages_like_one_that_is_like_the_least(spark):
    """In 40 groups B is A with a word changed, C is B with another one changed: B is like both, C is like B alone."""
    rng = random.Random(31)
    rows, brute = [], set()
    for k in range(40):
        p = [rng.choice(WORDS) for _ in range(60)]
        for j, at in enumerate((None, 25, 33)):
            if at:
                p[at] = f"other{k}x{j}"
            rows.append((3 * k + j, f"{prose(40, rng)} {' '.join(p)} {prose(40, rng)}"))
        brute |= {(i, j) for i, t in rows[-3:] for j, u in rows[-3:] if j < i and substring_dedup.passages(hashed(t), hashed(u), 46, 80)}
    got = {(r.doc_id, r.other_id) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert brute == {(3 * k + j, 3 * k + j - 1) for k in range(40) for j in (1, 2)}
    assert got <= brute and len(got) >= 0.95 * len(brute)


@pytest.mark.parametrize("common", [36, 37])
def test_shared_lines_a_shingle_too_short(spark, common):
    """Of 40 windows that share just as many shingles as a passage needs keys are left, of one less none."""
    rng = random.Random(common)
    line = prose(common + 4, rng)
    rows = [(i, f"{' '.join(f'a{i}x{j}' for j in range(70))} {line} {' '.join(f'z{i}x{j}' for j in range(70))}") for i in range(40)]
    streams = spark.createDataFrame([(i, bytes(hashed(t).tobytes())) for i, t in rows], "doc long, s binary")
    big = spark.createDataFrame([(1, i, 90, 70 - 46, 140) for i, _ in rows], "key long, doc long, c int, l int, r int")
    assert (substring_dedup._refined(big, streams, 46, 80).count() > 0) == (common > 36)


@pytest.mark.parametrize("common", [40, 41])
def test_lines_too_short_for_the_partner_too(spark, common):
    """At 0.8 two passages of 46 shingles share 41: 41 / (46 + 46 - 41) is the first above it."""
    rng = random.Random(common)
    line = prose(45, rng).split()
    rows = []
    for i in range(40):  # 46 shingles around the root, of which the last are the document's own
        rows.append((i, f"{' '.join(f'a{i}x{j}' for j in range(60))} {' '.join(line[: common + 4])} {' '.join(f'z{i}x{j}' for j in range(70))}"))
    streams = spark.createDataFrame([(i, bytes(hashed(t).tobytes())) for i, t in rows], "doc long, s binary")
    big = spark.createDataFrame([(1, i, 80, 20, 125) for i, _ in rows], "key long, doc long, c int, l int, r int")
    assert (substring_dedup._refined(big, streams, 46, 80, True).count() > 0) == (common > 40)


def test_many_edited_copies_are_not_compared_in_all_pairs(spark, monkeypatch):
    """60 copies with words changed here and there: documents and links as by brute force, without comparing each pair."""
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(160)]
    rows = [(i, " ".join(f"new{i}x{j}" if rng.random() < 0.012 * (i % 4) else w for j, w in enumerate(base))) for i in range(60)]
    texts = [hashed(t) for _, t in rows]
    brute = [(i, j) for i in range(60) for j in range(i) if substring_dedup.passages(texts[i], texts[j], 46, 80)]
    compared, run = [], substring_dedup._confirmed
    monkeypatch.setattr(substring_dedup, "_confirmed", lambda pairs, *rest: compared.append(pairs.count()) or run(pairs, *rest))
    got = {(r.doc_id, r.other_id) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    linked = lambda pairs: {(r.id, r.comp) for r in near_dedup.components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    print("compared", compared, "found", len(got), "brute", len(brute))
    assert got <= set(brute) and {a for a, _ in got} == {a for a, _ in brute} and linked(got) == linked(brute)
    assert sum(compared) < 60 * 5


@pytest.mark.parametrize(("words", "gap"), [(60, 11), (60, 14), (55, 9), (55, 14), (70, 13)])
def test_passages_parted_by_other_words(words, gap):
    rng = random.Random(words * gap)
    parts = [prose(words, rng) for _ in range(4)]
    x, y = (hashed(f"{prose(30, rng)} " + f" {prose(gap, rng)} ".join(p for p in parts) + f" {prose(30, rng)}") for _ in range(2))
    for u, v in ((x, y), (y, x)):
        got = substring_dedup.passages(u, v, 46, 80)
        for k in range(4):  # each passage lies in what is found, but for a few words at its ends
            a = 30 + k * (words + gap)
            assert any(s <= a + 2 and z >= a + words - 6 for s, z, *_ in got)


@pytest.mark.parametrize("first", [0x3B1, 0x430, 0x627, 0x5D0, 0x10D0])
def test_letters_of_one_script_tell_languages_apart(first):
    letters = [chr(c) for c in range(first, first + 24) if chr(c).isalpha()]
    vecs = lang_id._vectors(np.array([ord(c) for c in letters]))[0]
    assert len(np.unique(vecs, axis=0)) == len(letters)
    rng = random.Random(first)
    words = [["".join(rng.choice(letters) for _ in range(5)) for _ in range(60)] for _ in range(4)]
    make = lambda k: " ".join(rng.choice(words[k]) for _ in range(80))
    protos = np.array([lang_id.profiles([make(k) for _ in range(20)])[0].sum(0) for k in range(4)])
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    mean = protos.mean(0)
    model = np.concatenate([[mean], (protos - mean) / np.linalg.norm(protos - mean, axis=1, keepdims=True)])
    truth = [k for k in range(4) for _ in range(10)]
    lang, score, _ = lang_id.predict(*lang_id.profiles([make(k) for k in truth]), list("abcd"), model)
    assert lang == ["abcd"[k] for k in truth] and score.min() > 0.9


def test_keys_of_letters_alone_are_scanned():
    model = secret_scan.default_model()
    rng = random.Random(21)
    keys = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(24)) for _ in range(100)]
    texts = [f"the value of key: {k} was sent" for k in keys]
    found = secret_scan.all_spans(texts, model)
    assert sum((18, 3, 42) in x for x in found) >= 90
    parts, labels = secret_scan.example_findings(1200, seed=98)
    seen = [secret_scan.as_seen(p) for p, y in zip(parts, labels, strict=True) if y]
    assert sum(p is not None and model.probability(model.logits([p]))[0] >= model.threshold for p in seen) >= 0.98 * len(seen)


def test_threshold_keeps_the_recall_below_one_half():
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("abcdefgh12345678") for _ in range(20))
    parts = [("", key(), "") for _ in range(800)]
    model = secret_scan.CharCNN().fit(parts, np.array([rng.random() < 0.2 for _ in parts], np.float32), epochs=1)
    assert model.threshold < 0.5  # labels without a pattern: every probability is near a fifth


def test_copies_of_a_page_are_no_template(spark):
    page = "<html><body><div><section>Own words {0} here</section></div></body></html>"
    copy = "<html><body><article><div>The copied article</div></article></body></html>"
    bare = "<html><body><section>Copied without an article</section></body></html>"
    pages = [(i, "http://c.example/a", page.format(i)) for i in range(6)] + [(10 + i, "http://c.example/b", copy) for i in range(10)] + [(30 + i, "http://c.example/c", bare) for i in range(10)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own words {i} here" if i < 10 else "The copied article" if i < 30 else "Copied without an article" for i, _, _ in pages}


def test_block_on_a_fifth_of_a_large_host_is_template(spark):
    page = "<body><div>Own words {0} here</div>{1}</body>"
    pages = [(i, "http://l.example/a", page.format(i, "<div>Said on a fifth of the pages</div>" if i % 5 == 0 else "")) for i in range(600)]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Own words {r.page_id} here" for r in got)


def test_recurrence_alone_tells_template_from_text(spark):
    """Names mean nothing here, and the notice stands inside the article: only its recurrence tells it from text."""
    page = "<body><article class='q7'><h2 class='a1'>Title {0}</h2><div class='zz'><p class='x9'>Read more of our stories every day</p></div><p class='x9'>Own words {0} here</p><p>Subscribe to hear from us again</p><ul><li>yes</li></ul></article></body>"
    few = [(100 + i, "http://few.example/a", page.format(i)) for i in range(2)]
    got = html_extract.extract(spark.createDataFrame([(i, "http://r.example/a", page.format(i)) for i in range(12)] + few, "page_id long, url string, html string")).collect()
    assert all(r.text == (f"Title {r.page_id}\nOwn words {r.page_id} here" if r.page_id < 100 else f"Title {r.page_id - 100}\nRead more of our stories every day\nOwn words {r.page_id - 100} here\nSubscribe to hear from us again\nyes") or r.page_id < 100 and r.text == f"Title {r.page_id}\nOwn words {r.page_id} here\nyes" for r in got)


@pytest.mark.parametrize(("page", "text"), [
    ("""<article><p class="a"">Hello</p><p>World "x" end</p></article>""", 'Hello\nWorld "x" end'),
    ("""<p>see <a href=foo">link</a> tail</p><p>World""", "see link tail\nWorld"),
    ("""<p title='it's'>a</p><p>b's</p>""", "a\nb's"),
    ("""<p title="1 > 0">a</p><p data-x = 'nav'>b</p>""", "a\nb"),
    ("<p class=>a</p><p =x>b</p><p/>c", "a\nb\nc"),
    ("""<p title="never closed>a</p><p>b</p>""", "a\nb"),
])
def test_stray_quotes(page, text):
    assert html_extract.main_text(page) == text


def test_null_conversations_stay_apart(spark, tmp_path):
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (-2, 1, "user", "c"), (7, None, None, None), (7, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.turns_sha256) for r in chat_format.op8_chat_format(spark, str(tmp_path)).collect()}
    digest = lambda *t: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
    assert got == {None: (2, digest(("user", "a"), ("assistant", "b"))), -2: (1, digest(("user", "c"))), 7: (2, digest(("", ""), ("", ""))), -1: (2, digest(("user", chat_format.TRICK), ("assistant", chat_format.TRICK)))}


def test_a_key_without_a_keyword_is_found_by_the_network_alone(spark):
    rng = random.Random(8)
    key = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(36))
    rows = [(i, f"{prose(30)} password = {''.join(rng.choice(WORDS[:50]) for _ in range(4))}{i} {prose(20)}", "b") for i in range(60)] + [(90, f"{prose(20)} sent {key} today {prose(10)}", "b"), (91, None, "b"), (92, "", "b"), (92, "", "b"), (93, "x" * 5000 + " " + key + " " + prose(4000), "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string").withColumnRenamed("other", "TEXT").repartition(3)
    model = secret_scan.trained(df)
    got = secret_scan.scan(df, "doc_id", model=model).collect()
    spans = {r.doc_id: r.spans for r in got}
    assert len(got) == len(rows) and not secret_scan.base_spans(rows[60][1])
    a = rows[60][1].index(key)
    assert f"model:{a}:{a + 36}" in spans[90].split(",") and "model:5001:5037" in spans[93].split(",") and spans[91] == spans[92] == ""
    assert secret_scan.scan(df.limit(0), "doc_id", model=secret_scan.trained(df.limit(0))).count() == 0


def test_overlaps_are_found_side_by_side():
    rng = random.Random(2)
    for _ in range(200):
        cuts = sorted(rng.sample(range(120), 12))
        runs = list(zip(cuts[::2], cuts[1::2], strict=True))
        spans = sorted((a, 0, a + rng.randint(1, 30)) for a in rng.sample(range(100), 5))
        assert secret_scan._overlapping(runs, spans) == [(a, z) for a, z in runs if any(s < z and a < e for s, _, e in spans)]
