"""Quality rules: plain text rules, then a hashed n-gram logistic regression with calibrated probabilities.

The classifier takes word n-grams (1, 2) and byte n-grams (3, 5) hashed into a table of 2**16
weights. It is trained on a bounded sample of labelled rows (``max_rows``, a documented bound), a
fifth of which is held out to fit the calibration (Platt). Scoring runs in Arrow batches; the
threshold is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, joined_words, mix, pieces, texts_of, tune, windows

BITS = 16
DIM = 1 << BITS
#: Bound on the labelled rows that training uses, least hash of the id first.
MAX_ROWS = 2000
#: Words and bytes of a long text that are looked at at once.
PART = 1 << 21
#: A document is rejected if its calibrated probability of being good is below this.
THRESHOLD = 0.2
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
BASE_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
)


def base_rules(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The rule columns of one text; null: no words. All exact counts, linear in the text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    triples = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(triples)) < len(triples):
        ids: dict[tuple, int] = {}
        code = np.fromiter((ids.setdefault(x, len(ids)) for x in triples), dtype=np.int64, count=len(triples))
        twice = np.bincount(code)[code] > 1
        cover = np.zeros(n, dtype=bool)
        for k in range(3):
            cover[k : n - 2 + k] |= twice
        repeat = int(cover.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n


def _families(hashes: np.ndarray, at: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text, feature, family) of a run of texts: word hashes and where each text's begin, bytes (a line feed between texts) and their numbers."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.repeat(np.arange(len(sizes)), sizes + 1)
    place[np.cumsum(sizes + 1) - 1] = -1  # what stands between texts is in none
    place = place[: len(data)]
    for n in (1, 2):
        h = windows(hashes, n)
        ok = owner[: len(h)] == owner[n - 1 :][: len(h)]
        yield owner[: len(h)][ok], _slot(h[ok], n), n
    data = data.astype(np.uint64)
    for n in (3, 5):
        if len(data) >= n:
            h = np.zeros(len(data) - n + 1, dtype=np.uint64)
            for k in range(n):
                h |= data[k : len(data) - n + 1 + k] << np.uint64(8 * k)
            ok = (place[: len(h)] == place[n - 1 :]) & (place[: len(h)] >= 0)
            yield place[: len(h)][ok], _slot(mix(h[ok] + np.uint64(n)), n + 10), n


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h ^ np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int32)


def _families_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    hashes, at = joined_words(texts)
    sizes = np.array([len(t) for t in texts])
    yield from _families(hashes, at, np.frombuffer(b"\n".join(texts), dtype=np.uint8), sizes)


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, weight) triples of a run of texts; each family's weights sum to 1 in a text."""
    docs, feats, weights = [], [], []
    for doc, feat, _ in _families_of(texts):
        docs.append(doc)
        feats.append(feat)
        weights.append((1.0 / np.maximum(np.bincount(doc, minlength=len(texts)), 1))[doc].astype(np.float32))
    return np.concatenate(docs), np.concatenate(feats), np.concatenate(weights)


def _sparse(batch: pa.RecordBatch) -> pa.RecordBatch:
    """For training: the summed features of each text."""
    out: list[tuple[bytes, bytes]] = []
    texts = texts_of(batch)
    for i, j in pieces(texts, 1 << 20):
        doc, feat, weight = _features(texts[i:j])
        code = doc.astype(np.int64) << BITS | feat
        uniq, inverse = np.unique(code, return_inverse=True)
        total = np.bincount(inverse, weights=weight).astype(np.float32)
        cut = np.searchsorted(uniq, np.arange(j - i + 1, dtype=np.int64) << BITS)
        for k in range(j - i):
            part = slice(cut[k], cut[k + 1])
            out.append(((uniq[part] & (DIM - 1)).astype(np.int32).tobytes(), total[part].tobytes()))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())],
        ["doc_id", "quality", "feats", "weights"],
    )


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seed: int = 7) -> dict:
    """Weights, bias and calibration. With fewer than 20 rows or one class only: a model that keeps all.

    Rows with a null text or label take no part. The sample holds at most max_rows documents, each with one text (of several under
    an id the one of the least features); what comes to the driver is their hashed features, under 16 thousand numbers for a usual text
    and never over 2**16.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    chosen = (
        labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(key, "doc_id").limit(max_rows)
    )
    sparse = arrow_map(
        docs.where("text is not null").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id").select("doc_id", "quality", "text"),
        _sparse, "doc_id long, quality int, feats binary, weights binary",
    )
    least = F.min(F.struct("feats", "weights", "quality"))
    rows = sparse.groupBy("doc_id").agg(least.alias("one")).select("one.*").toLocalIterator()
    y, counts, feats, weights = [], [], [], []
    for r in rows:
        y.append(1.0 if r["quality"] > 0 else 0.0)
        f = np.frombuffer(r["feats"], dtype=np.int32)
        counts.append(len(f))
        feats.append(f)
        weights.append(np.frombuffer(r["weights"], dtype=np.float32))
    if len(y) < 20 or min(sum(y), len(y) - sum(y)) < 5:
        return {"w": np.zeros(DIM, np.float32), "a": 0.0, "b": 20.0, "rows": len(y)}
    order = sorted(range(len(y)), key=lambda i: (counts[i], feats[i][:8].tobytes(), weights[i][:8].tobytes(), y[i]))
    y = np.array([y[i] for i in order])
    doc = np.repeat(np.arange(len(y), dtype=np.int32), [counts[i] for i in order])
    feat, x = np.concatenate([feats[i] for i in order]), np.concatenate([weights[i] for i in order])
    del feats, weights
    scale = 1.0 / np.sqrt(np.bincount(feat, weights=x * x, minlength=DIM) / len(y) + 1e-6)
    x *= scale.astype(np.float32)[feat]
    held = np.arange(len(y)) % 5 == 0
    sample = np.where(held, 0.0, 1.0)
    sample *= np.where(y == 1, 0.5 / max(1, sample[y == 1].sum()), 0.5 / max(1, sample[y == 0].sum()))
    w, m, v, bias = np.zeros(DIM), np.zeros(DIM + 1), np.zeros(DIM + 1), 0.0
    for step in range(1, 81):
        z = _sums(doc, x, w, feat, len(y)) + bias
        g = sample * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.append(_sums(feat, x, g, doc, DIM) + 1e-4 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:DIM], bias - move[DIM]
    z = _sums(doc, x, w, feat, len(y))
    a, b = _platt(z[held] + bias, y[held])
    return {"w": (w * scale).astype(np.float32), "a": a, "b": a * bias + b, "rows": len(y)}


def _sums(to: np.ndarray, x: np.ndarray, values: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """Sums of x * values[of] by to, in parts, so that no copy of all the features is made."""
    out = np.zeros(size)
    for k in range(0, len(x), 1 << 20):
        part = slice(k, k + (1 << 20))
        out += np.bincount(to[part], weights=x[part] * values[of[part]], minlength=size)
    return out


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic calibration, by Newton steps, with Platt's smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(float(np.std(z)), 1e-6)
    u, theta = z / spread, np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * u + theta[1], -30, 30)))
        g = np.array([((p - t) * u).sum(), (p - t).sum()])
        r = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(r * u * u).sum() + 1e-3, (r * u).sum()], [(r * u).sum(), r.sum() + 1e-3]])
        theta = theta - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(theta[0], 0.0) / spread), float(theta[1])


def probabilities(texts: list[bytes], model: dict) -> np.ndarray:
    """Calibrated probability of each text being good; one of any length is scored as a whole."""
    w, out = model["w"].astype(np.float64), np.empty(len(texts))
    for i, j in pieces(texts, 1 << 20):
        if len(texts[i]) > PART:
            out[i] = _raw_long(texts[i], w)
        else:
            out[i:j] = sum(np.bincount(doc, weights=w[feat], minlength=j - i) / np.maximum(np.bincount(doc, minlength=j - i), 1) for doc, feat, _ in _families_of(texts[i:j]))
    return 1 / (1 + np.exp(-np.clip(model["a"] * out + model["b"], -40, 40)))


def _raw_long(text: bytes, w: np.ndarray) -> float:
    """The sums of all n-grams of a text, taken part by part; parts overlap by the words and bytes that n-grams reach over."""
    hashes, _ = joined_words([text])
    data = np.frombuffer(text, dtype=np.uint8)
    none = np.zeros(0, np.uint64), np.zeros(2, np.int64)
    nothing = np.zeros(1, np.int64)
    total, count = np.zeros(6), np.zeros(6)
    for i in range(0, max(len(hashes), 1), PART):
        for n in (1, 2):
            part = hashes[i : i + PART + n - 1]
            for _, feat, family in _families(part, np.array([0, len(part)]), data[:0], nothing):
                if family == n:
                    total[n] += w[feat].sum()
                    count[n] += len(feat)
    for i in range(0, len(data), PART):
        for n in (3, 5):
            part = data[i : i + PART + n - 1]
            for _, feat, family in _families(*none, part, np.array([len(part)])):
                if family == n:
                    total[n] += w[feat].sum()
                    count[n] += len(feat)
    return float((total / np.maximum(count, 1)).sum())


def judge(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows and columns with the rule columns, ``p_quality`` and ``kept`` added.

    Null and empty texts have no words and fail. A text fails by the rules, or by a probability under
    threshold. Columns of docs that bear one of the added names are replaced. Repeated rows each get
    their own verdict, which depends on the text alone.
    """
    tune(docs.sparkSession)
    added = [x.split()[0] for x in BASE_SCHEMA.split(", ")] + ["p_quality", "kept"]
    docs = docs.drop(*added)
    small = {"w": model["w"], "a": model["a"], "b": model["b"]}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        base = [base_rules(t) for t in texts]
        p = probabilities([(t or "").encode() for t in texts], small)
        columns = [pa.array(c) for c in zip(*base)]
        kept = pa.array([not b[5] and bool(q >= threshold) for b, q in zip(base, p)])
        arrays = [*batch.columns, *columns, pa.array(p, pa.float64()), kept]
        return pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, f"{fields}, {BASE_SCHEMA}, p_quality double, kept boolean")
