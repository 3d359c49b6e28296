"""Secret scanning: fixed patterns, and a character convolutional network over every other candidate and its context."""

from __future__ import annotations

import hashlib
import re
import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, ready, rows_by_chars, trimmed

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is found whole, a shorter one not at all
_TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_MAYBE = re.compile(rb"passw|secret|token|api_?key")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
LEFT, RIGHT, WIDTH = 24, 8, 5
SEED, FINDINGS, RECALL = 11, 2400, 0.99
#: Of the corpus's own findings at most so many are learned, from about so many rows; longer ones are not learned.
CORPUS_FINDINGS, CORPUS_ROWS, LONGEST_LABEL = 800, 40_000, 512


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points of the fixed patterns' matches, leftmost and apart within a kind."""
    out = []
    raw = text.encode("utf-8", "surrogatepass")
    if _MAYBE.search(raw.lower()):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _DIGIT.search(text) or _HEX.search(text):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of 16 or more key characters with a letter, without the points and dashes at their ends."""
    out = []
    for m in _TOKEN.finditer(text):
        if _LETTER.search(m[0]):
            a, z = m.start() + len(m[0]) - len(m[0].lstrip(".-/=_")), m.end() - len(m[0]) + len(m[0].rstrip(".-/"))
            if z - a >= 16:
                out.append((a, z))
    return out


_FEATURES = np.zeros((129, 14), np.float32)  # by character (128: any other): a random code and its classes
_FEATURES[1:, :7] = np.random.default_rng(5).normal(0, 0.5, (128, 7))
for _i, _set in enumerate((string.digits, "abcdef", string.ascii_lowercase, string.ascii_uppercase, "aeiouAEIOU", "+/=_", ".-@:;,\"' ")):
    _FEATURES[[ord(c) for c in _set], 7 + _i] = 1


def _codes(s: str) -> np.ndarray:
    return np.minimum(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4"), 128).astype(np.int64)


def _unfold(codes: np.ndarray) -> np.ndarray:
    """(rows, length) codes to (rows, length, WIDTH * features); code 0 is padding."""
    x = _FEATURES[np.pad(codes, ((0, 0), (WIDTH // 2, WIDTH // 2)))]
    n = codes.shape[1]
    return np.concatenate([x[:, k : k + n] for k in range(WIDTH)], 2)


def as_seen(part: tuple[str, str, str]) -> tuple[str, str, str] | None:
    """A finding in its context as candidates() cuts it out; None if it is no candidate."""
    text, a, z = "".join(part), len(part[0]), len(part[0]) + len(part[1])
    for s, e in candidates(text):
        if s < z and a < e:
            return text[max(0, s - LEFT) : s], text[s:e], text[e : e + RIGHT]
    return None


class CharCNN:
    """One convolution over the candidate (largest and mean response) and one over its context (largest), then a logistic unit."""

    def __init__(self, filters: int = 24, around: int = 12, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = WIDTH * _FEATURES.shape[1]
        self.p = [rng.normal(0, (2 / d) ** 0.5, (d, filters)), np.zeros(filters), rng.normal(0, (2 / d) ** 0.5, (d, around)), np.zeros(around), rng.normal(0, 0.1, 2 * filters + around), np.zeros(1)]
        self.p = [x.astype(np.float32) for x in self.p]
        self.scale, self.threshold = (1.0, 0.0), 0.5

    def _forward(self, cand: np.ndarray, context: np.ndarray):
        w, b, v, c, o, z = self.p
        x, y = _unfold(cand), _unfold(context)
        mask = (cand > 0)[:, :, None]
        h = np.maximum(x @ w + b, 0) * mask
        g = np.maximum(y @ v + c, 0)
        n = np.maximum(mask.sum(1), 1)
        f = np.concatenate([h.max(1), h.sum(1) / n, g.max(1)], 1)
        return x, y, h, g, n, f, f @ o + z

    def logits(self, parts: list[tuple[str, str, str]]) -> np.ndarray:
        """Of (left context, candidate, right context): a long candidate is read whole, alone."""
        out = np.zeros(len(parts))
        order = sorted(range(len(parts)), key=lambda i: len(parts[i][1]))
        at = 0
        while at < len(order):
            k = 1
            while at + k < len(order) and (k + 1) * max(64, len(parts[order[at + k]][1])) <= 1 << 14:
                k += 1
            rows = order[at : at + k]
            out[rows] = self._forward(*self._batch([parts[i] for i in rows]))[-1]
            at += k
        return out

    @staticmethod
    def _batch(parts: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
        cand = np.zeros((len(parts), max(len(c) for _, c, _ in parts)), np.int64)
        context = np.zeros((len(parts), LEFT + RIGHT + 1), np.int64)
        for i, (a, c, z) in enumerate(parts):
            cand[i, : len(c)] = _codes(c)
            if a:
                context[i, LEFT - len(a) : LEFT] = _codes(a)
            if z:
                context[i, LEFT + 1 : LEFT + 1 + len(z)] = _codes(z)
        return cand, context

    def fit(self, parts: list[tuple[str, str, str]], labels: np.ndarray, epochs: int = 4, rate: float = 0.004, recall: float = RECALL) -> CharCNN:
        """Adam on three quarters; on the rest fit a logistic calibration and take the highest threshold that keeps the recall, a finding that candidates() misses counting as lost."""
        rng = np.random.default_rng(SEED)
        seen = [as_seen(p) for p in parts]
        lost = np.array([p is None for p in seen], bool)
        parts = [q or p for p, q in zip(parts, seen, strict=True)]
        order = rng.permutation(len(parts))
        cut = len(parts) * 3 // 4
        m, s, t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0
        for _ in range(epochs):
            for at in range(0, cut, 128):
                rows = order[:cut][at : at + 128]
                x, y, h, g, n, f, logit = self._forward(*self._batch([parts[i] for i in rows]))
                e = ((1 / (1 + np.exp(-logit)) - labels[rows]) / len(rows)).astype(np.float32)
                w, b, v, c, o, z = self.p
                k, df = w.shape[1], e[:, None] * o
                dh = np.where(h > 0, (df[:, k : 2 * k] / n)[:, None, :], 0)
                i, j = np.ogrid[: len(rows), :k]
                dh[i, h.argmax(1), j] += df[:, :k] * (h.max(1) > 0)
                dg = np.zeros_like(g)
                i, j = np.ogrid[: len(rows), : v.shape[1]]
                dg[i, g.argmax(1), j] = df[:, 2 * k :] * (g.max(1) > 0)
                flat = lambda u: u.reshape(-1, u.shape[2])
                grads = [flat(x).T @ flat(dh), dh.sum((0, 1)), flat(y).T @ flat(dg), dg.sum((0, 1)), f.T @ e, e.sum(keepdims=True)]
                t += 1
                for q, grad in enumerate(grads):
                    m[q] += 0.1 * (grad - m[q])
                    s[q] += 0.001 * (grad * grad - s[q])
                    self.p[q] -= (rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(s[q] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        rest = order[cut:]
        got, want = self.logits([parts[i] for i in rest]), labels[rest].astype(float)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * got + b, -30, 30)))
            r, d = p - want, p * (1 - p) + 1e-9
            grad = np.array([(r * got).sum() + 1e-3 * (a - 1), r.sum()])
            step = np.linalg.solve(np.array([[(d * got * got).sum() + 1e-3, (d * got).sum()], [(d * got).sum(), d.sum() + 1e-6]]), grad)
            a, b = a - step[0], b - step[1]
        self.scale = float(a), float(b)
        good = np.sort(np.where(lost[rest], 0, self.probability(got))[want > 0])
        self.threshold = float(good[int((1 - recall) * len(good))]) if len(good) else 0.5
        return self

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logits + self.scale[1], -30, 30)))


def example_findings(n: int = FINDINGS, seed: int = SEED) -> tuple[list[tuple[str, str, str]], np.ndarray]:
    """Labelled findings made by rule: keys of known forms against words, identifiers, paths, hosts, dates and numbers, in context."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    alnum = string.ascii_letters + string.digits
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "in", "ed", "ou", "sch", "ver", "ción", "les", "be", "ti", "na"], rng.integers(1, 5)))
    plain = lambda: word().replace("ó", "o")
    digits = lambda a, z: pick(string.digits, rng.integers(a, z))
    yes = [lambda: pick("0123456789abcdef", rng.choice([32, 40, 48, 64])), lambda: pick(alnum, rng.integers(20, 64)), lambda: pick(alnum + "+/", rng.integers(24, 60)) + "=" * rng.integers(0, 3), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: rng.choice(["ghp_", "sk-", "xoxb-", "glpat-", "pk_live_"]) + pick(alnum, rng.integers(24, 40)), lambda: pick(alnum + "_-", rng.integers(20, 48)), lambda: pick(string.ascii_letters, rng.integers(18, 40)), lambda: "eyJ" + pick(alnum, 24) + "." + pick(alnum, 30) + "." + pick(alnum + "_-", 30)]
    no = [lambda: f"{plain()}{digits(1, 4)}.{plain()}.example.com", lambda: "/".join(plain() for _ in range(3)) + f"/{digits(1, 5)}.html", lambda: f"{plain()}_{plain()}_{digits(2, 9)}.{rng.choice(['pdf', 'txt', 'png', 'tar.gz'])}", lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}T{rng.integers(0, 24):02}.{digits(2, 3)}", lambda: f"{plain()}-{plain()}-{plain()}-{digits(1, 5)}", lambda: f"v{rng.integers(1, 9)}.{rng.integers(0, 30)}.{rng.integers(0, 30)}-{plain()}.{digits(1, 3)}+{plain()}", lambda: f"{plain().title()}{plain().title()}{plain().title()}{digits(1, 3)}", lambda: f"{plain()}{digits(1, 2)}{plain()}{plain()}{plain()}", lambda: f"10.{digits(4, 5)}/{plain()}.{digits(4, 7)}.{digits(2, 4)}", lambda: f"{plain().upper()}-{digits(3, 6)}/{digits(2, 5)}-{plain().upper()}", lambda: f"{digits(10, 16)}{rng.choice(['kg', 'ms', 'px', 'USD'])}", lambda: "=" * 12 + f"{plain()}{digits(1, 3)}" + "=" * 5, lambda: "".join(plain() for _ in range(4)), lambda: "".join(plain().title() for _ in range(5)), lambda: "-".join(plain() for _ in range(5)), lambda: "/".join(plain() for _ in range(5)), lambda: "_".join(plain() for _ in range(5)).upper(), lambda: ".".join(plain() for _ in range(5)), lambda: "=" * 12 + plain().title() + "=" * 5]
    lead_yes = ['token = "', "key: ", "Authorization: Bearer ", "secret=", "--password ", "apikey='", "credentials ", "export AUTH=", "is "]
    lead_no = ["see ", "at ", "file ", "https://", "on ", "und.", "@", "version ", "(", "Fig. "]
    parts, labels = [], []
    for k in range(n):
        good = k % 2
        s = yes[rng.integers(len(yes))]() if good else no[rng.integers(len(no))]()
        s = s if len(s) >= 16 else s + "".join(plain() for _ in range(8))
        lead = rng.choice(lead_yes if good and rng.random() < 0.7 else lead_no if not good and rng.random() < 0.7 else ["", " ", "\n", ": "])
        left = (" ".join(word() for _ in range(5)) + " " + lead)[-LEFT:]
        right = (rng.choice(['"', " ", ".", ",", "\n", "'"]) + " ".join(word() for _ in range(3)))[:RIGHT]
        parts.append((left, s, right))
        labels.append(good)
    return parts, np.array(labels, np.float32)


_models: dict = {}


def default_model() -> CharCNN:
    """The network trained on example_findings(), once in a process."""
    if "default" not in _models:
        _models["default"] = CharCNN().fit(*example_findings())
    return _models["default"]


def _parts(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, str, str]]:
    return [(text[max(0, a - LEFT) : a], text[a:z], text[z : z + RIGHT]) for a, z in spans]


def _overlapping(runs: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The runs, which are apart, that touch a span; both sorted, walked side by side."""
    out, k, most = [], 0, 0
    for a, z in runs:
        while k < len(spans) and spans[k][0] < z:
            most = max(most, spans[k][2])
            k += 1
        if most > a:
            out.append((a, z))
    return out


def _labelled(batches):
    import pyarrow as pa

    for b in rows_by_chars(batches, 0):
        found = []
        for t in b.column(0).to_pylist():
            if t and (base := base_spans(t)):
                found += [p for p in _parts(t, _overlapping(candidates(t), base)) if len(p[1]) <= LONGEST_LABEL]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*found, strict=True) if found else ([], [], []))], names=["a", "b", "c"])


def corpus_findings(docs: DataFrame, most: int = CORPUS_FINDINGS, most_rows: int = CORPUS_ROWS) -> list[tuple[str, str, str]]:
    """Up to `most` different secrets of the fixed patterns in their context, from about most_rows rows: those of the least hashes."""
    rows = only(docs, "text").where("text is not null")
    n = rows.count()
    if n > most_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(most_rows / n * (1 << 30)))
    found = rows.mapInArrow(_labelled, "a string, b string, c string").distinct()
    return [(r.a, r.b, r.c) for r in found.orderBy(F.xxhash64("a", "b", "c"), "a", "b", "c").limit(most).collect()]


def trained(docs: DataFrame) -> CharCNN:
    """The network trained on findings made by rule and on the corpus's own (see corpus_findings for their bound)."""
    ready(docs.sparkSession)
    parts, labels = example_findings()
    own = corpus_findings(docs)
    return CharCNN().fit(parts + own, np.concatenate([labels, np.ones(len(own), np.float32)]))


def all_spans(texts: list[str], model: CharCNN | None) -> list[list[tuple[int, int, int]]]:
    """Per text the fixed patterns' spans, and all candidates that the model accepts, those under a pattern too."""
    out, parts, at = [base_spans(t) for t in texts], [], []
    for i, t in enumerate(texts if model else []):
        found = candidates(t)
        parts += _parts(t, found)
        at += [(i, a, z) for a, z in found]
    for k in range(0, len(parts), 4096):
        for (i, a, z), p in zip(at[k : k + 4096], model.probability(model.logits(parts[k : k + 4096])), strict=True):
            if p >= model.threshold:
                out[i].append((a, 3, z))
    return [sorted(x) for x in out]


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones together, replaced by mark."""
    out, at = [], 0
    for a, _, z in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join([*out, text[at:]]) if spans else text


def scan(docs: DataFrame, *keep: str, model: CharCNN | None = None) -> DataFrame:
    """Columns `keep` of docs, then n_assign, n_access, n_hex, base_sha256, spans, and the text with its secrets redacted.

    Null text counts as empty and stays null when redacted. The network's few thousand weights go to the tasks; without
    a model it is the one of the rules alone. Each text is scanned whole, a repeated row again.
    """
    ready(docs.sparkSession)
    model, names, docs = model or default_model(), list(keep), only(docs, *{*keep, "text"})
    at = names.index("text") if "text" in names else len(names)

    def run(batches):
        import pyarrow as pa

        for b in rows_by_chars(batches, at):
            texts = b.column(at).to_pylist()
            found = all_spans([t or "" for t in texts], model)
            said = lambda s: ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in s)
            base = [[x for x in s if x[1] < 3] for s in found]
            counts = [pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(3)]
            digest = [hashlib.sha256(said(s).encode()).hexdigest() for s in base]
            clean = [t if t is None else redact(t, s) for t, s in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *counts, pa.array(digest, pa.string()), pa.array([said(s) for s in found], pa.string()), pa.array(clean, pa.string())], names=[*names, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    rows = docs.select(*names, *[] if "text" in names else ["text"])
    kinds = "".join(f"`{n}` {t}, " for n, t in rows.dtypes[: len(names)])
    return rows.mapInArrow(trimmed(run), kinds + "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the fixed patterns' spans, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, "doc_id", model=trained(docs)).drop("redacted")
