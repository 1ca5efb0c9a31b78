"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights.

The order is two: a token given the one before it, backed off to the token alone. (A third order would
have to move some seventeen bytes for nearly every token of the corpus.)

1. Token counts of the training documents: a table of (token, count), each a 64-bit hash.
2. Blocks of documents pack their (token, context, document) counts by token into one compressed row for
   each of P ranges that it has any of (so never more rows than pairs); words of more than a quarter of a range are spread by their context, and
   their counts go along (at most ``HOT`` of them). One exchange brings all that concerns a pair together.
3. A range adds up its pairs' counts, writes them to the partitioned table of the model, and sends back
   sums by document: of logarithms of counts, and how many tokens have each discount. Pairs that
   training never saw are written with their context, for step 4.
4. Contexts sum what their pairs keep and what backoff would give these pairs; hence the weight.
5. Sums by document, discounts and the backed-off tokens make the scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_words, mix, table, texts_of, tune

#: Tokens in a range and in a block of documents, and documents in a block.
RANGE, BLOCK, BLOCK_DOCS = 1_500_000, 1_100_000, 50_000
#: Most tokens that are spread by their contexts; what is less frequent than all these has at most one in HOT of all tokens.
HOT = 1 << 16
#: Counts above this, which Katz leaves alone, are discounted by LARGE: else a context of such counts only would leave nothing to back off to.
MAX_DISCOUNTED, LARGE = 5, 0.9995
END, START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x57A2757A2757A273)
_COLUMNS = "kind string, h long, w long, c long, cw long, block long, idx int, n long, x double, data binary"
_SCHEMA = pa.schema(
    [("kind", pa.string()), ("h", pa.int64()), ("w", pa.int64()), ("c", pa.int64()), ("cw", pa.int64()), ("block", pa.int64())]
    + [("idx", pa.int32()), ("n", pa.int64()), ("x", pa.float64()), ("data", pa.binary())]
)


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text, modulo 10, is 0; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def discounts(counts_of_counts: dict[int, int]) -> list[float]:
    """Katz's factors for counts 1 to MAX_DISCOUNTED, then LARGE; where the counts are too thin, (r - 1/2) / r."""
    k, n = MAX_DISCOUNTED, counts_of_counts
    common = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    out = []
    for r in range(1, k + 1):
        d = 0.0
        if n.get(r) and common < 1:
            d = ((r + 1) * n.get(r + 1, 0) / n[r] / r - common) / (1 - common)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return [*out, LARGE]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, word counts, tokens, contexts) of blocks of whole documents; tokens and contexts are lower-cased hashes."""
    ids, counts, tokens, contexts, size = [], [], [], [], 0
    for batch in batches:
        texts, names = texts_of(batch), batch.column("doc_id").to_pylist()
        i = 0
        while i < len(texts):
            j, run = i, 0
            while j < len(texts) and (j == i or run + len(texts[j]) < 1 << 20):
                run += len(texts[j]) + 1
                j += 1
            hashes, at = joined_words(texts[i:j], lower=True)
            n = np.diff(at)
            ends = np.cumsum(n + 1) - 1
            t = np.empty(len(hashes) + len(n), dtype=np.uint64)
            last = np.zeros(len(t), dtype=bool)
            last[ends] = True
            t[~last], t[last] = hashes, END
            c = np.empty_like(t)
            c[1:] = t[:-1]
            c[np.concatenate(([0], ends[:-1] + 1))] = START
            ids += names[i:j]
            counts.append(n), tokens.append(t), contexts.append(c)
            size += len(t)
            if size >= BLOCK or len(ids) >= BLOCK_DOCS:
                yield ids, np.concatenate(counts), np.concatenate(tokens), np.concatenate(contexts)
                ids, counts, tokens, contexts, size = [], [], [], [], 0
            i = j
    if ids:
        yield ids, np.concatenate(counts), np.concatenate(tokens), np.concatenate(contexts)


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, counts, tokens, _ in _blocks(batches):
        held = np.repeat([held_out(i) for i in ids], counts + 1)
        w, n = np.unique(tokens[~held], return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(w.view(np.int64)), pa.array([None], pa.int64())]),
             pa.concat_arrays([pa.array(n.astype(np.int64)), pa.array([int(held.sum())], pa.int64())])],
            ["w", "n"],
        )


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), len(a))]], dtype=np.int64)
    return zstandard.compress(head.tobytes() + b"".join(a.tobytes() for a in arrays), 3)


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    out, at = [], 8 + 16 * n
    for char, size in zip(head[::2], head[1::2]):
        out.append(np.frombuffer(raw, np.dtype(chr(char)), int(size), at))
        at += out[-1].nbytes
    return out


def _range_of(tokens: np.ndarray, contexts: np.ndarray, hot: np.ndarray, ranges: int) -> np.ndarray:
    key = tokens
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        key = np.where(hot[at] == tokens, mix(contexts ^ np.uint64(7)) + tokens, tokens)
    return (mix(key) % np.uint64(ranges)).astype(np.int64)


def _packer(hot: np.ndarray, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, (ids, counts, tokens, contexts) in enumerate(_blocks(batches)):
            block = part << 24 | k
            doc = np.repeat(np.arange(len(ids), dtype=np.uint16), counts + 1)
            held = np.array([held_out(i) for i in ids])
            known = np.array([i is not None for i in ids])
            names = np.array([i or 0 for i in ids], dtype=np.int64)
            rows = [(1, block, block, _pack(names, known.astype(np.uint8), held.astype(np.uint8), counts.astype(np.int64)))]
            to = _range_of(tokens, contexts, hot, ranges)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(ranges + 1))
            for p in np.flatnonzero(np.diff(cut)):
                at = order[cut[p] : cut[p + 1]]
                at = at[np.lexsort((doc[at], contexts[at], tokens[at]))]
                t, c, d = tokens[at], contexts[at], doc[at]
                new_pair = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
                new = new_pair.copy()
                new[1:] |= d[1:] != d[:-1]
                first, pair = np.flatnonzero(new), np.flatnonzero(new_pair)
                n = np.diff(np.append(first, len(t))).astype(np.uint32)
                entries = np.diff(np.append(np.searchsorted(first, pair), len(first))).astype(np.uint32)
                trained = np.add.reduceat(np.where(held[d[first]], 0, n), np.searchsorted(first, pair)).astype(np.uint32)
                words = np.flatnonzero(np.concatenate(([True], t[pair][1:] != t[pair][:-1])))
                pairs = np.diff(np.append(words, len(pair))).astype(np.uint32)
                rows.append((0, int(p), block, _pack(t[pair][words], pairs, c[pair], entries, trained, d[first], n)))
                if len(rows) >= 64:
                    yield _packed(rows)
                    rows = []
            if rows:
                yield _packed(rows)

    return run


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["side", "key", "block", "data"])


def _out(kind: str, rows: int, **columns) -> pa.Table:
    columns["kind"] = pa.DictionaryArray.from_arrays(pa.array(np.zeros(rows, np.int8)), pa.array([kind])).cast(pa.string())
    empty = {t: pa.nulls(rows, t) for t in set(_SCHEMA.types)}  # one array of nulls a type, shared by its columns
    return pa.table([pa.array(columns[f.name]) if f.name in columns else empty[f.type] for f in _SCHEMA], schema=_SCHEMA)


def _range_counts(hot: np.ndarray, hot_counts: np.ndarray, unigram: list[float], total: int, unknown: float):
    def of_token(c: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *unigram])[np.minimum(c, MAX_DISCOUNTED + 1)]
        return np.where(c > 0, d * c / max(total, 1), unknown)

    def run(group: pa.Table) -> pa.Table:
        if group.column("side")[0].as_py() == 1:
            return pa.concat_tables([_out("docs", 1, block=[b], data=[d]) for b, d in zip(group.column("block").to_pylist(), group.column("data").to_pylist())])
        blocks, w, h, trained, entries, sizes = group.column("block").to_pylist(), [], [], [], [], []
        for chunk in group.column("data"):
            words, pairs, contexts, count, train, doc, n = _unpack(chunk.as_py())
            w.append(np.repeat(words, pairs)), h.append(contexts), trained.append(train)
            entries.append((count, doc, n)), sizes.append(len(contexts))
        w, h, trained = np.concatenate(w), np.concatenate(h), np.concatenate(trained).astype(np.float64)
        with np.errstate(over="ignore"):
            key = mix(mix(w) + h)
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        w, h, which = w[one], h[one], which.astype(np.int32)
        c = np.bincount(which, weights=trained).astype(np.int64)
        del key, one, trained
        tokens, token = np.unique(w, return_inverse=True)
        cw = np.bincount(token, weights=c).astype(np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
            cw = np.where(hot[at] == tokens, hot_counts[at], cw)
        cw, last = cw[token], tokens[token] == END
        prob = np.log10(of_token(cw))
        base = np.log10(cw + 0.1)
        follow = np.where((cw > 0) & ~last, np.log10(np.maximum(cw, 1)), 0.0)
        both = np.where(c > 0, np.log10(np.maximum(c, 1)), 0.0) - follow
        out, at = [], 0
        for block, size, (count, doc, n) in zip(blocks, sizes, entries):
            pair = np.repeat(which[at : at + size], count)
            at += size
            docs = int(doc.max()) + 1
            add = lambda x: np.bincount(doc, weights=x, minlength=docs)
            level = np.minimum(c[pair], MAX_DISCOUNTED + 1)
            seen = np.bincount(doc.astype(np.int64) * (MAX_DISCOUNTED + 2) + level, weights=n, minlength=docs * (MAX_DISCOUNTED + 2)).astype(np.uint32)
            data = _pack(add(n * base[pair]), add(n * both[pair]), add(np.where(cw[pair] > 0, n, 0)).astype(np.uint32), seen)
            out.append(_out("sums", 1, block=[block], data=[data]))
            never = np.flatnonzero(level == 0)
            if len(never):
                p = pair[never]
                out.append(_out("backed", len(p), h=h[p].view(np.int64), block=np.full(len(p), block), idx=doc[never].astype(np.int32), n=n[never].astype(np.int64), x=prob[p]))
        order = np.flatnonzero(c > 0)
        order = order[np.lexsort((h[order], w[order]))]
        out.append(_out("pairs", len(order), h=h[order].view(np.int64), w=w[order].view(np.int64), c=c[order], cw=cw[order]))
        return pa.concat_tables(out)

    return run


def _doc_sums(logs: list[float], norm: float, start_log: float):
    def run(group: pa.Table) -> pa.Table:
        kinds, data = group.column("kind").to_pylist(), group.column("data")
        names, known_id, held, counts = _unpack(data[kinds.index("docs")].as_py())
        n, block = len(names), group.column("block")[0].as_py()
        base, both, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        levels = np.zeros(n * (MAX_DISCOUNTED + 2), np.int64)
        parts = sorted((data[k].as_py() for k, kind in enumerate(kinds) if kind == "sums"))
        for part in parts:  # in a fixed order, so that sums do not depend on which came first
            b, x, y, lv = _unpack(part)
            base[: len(b)] += b
            both[: len(x)] += x
            known[: len(y)] += y
            levels[: len(lv)] += lv
        seen = levels.reshape(n, -1)[:, 1:] @ np.array(logs)
        size = counts + 1
        ids = pa.array(names, mask=known_id == 0)
        return pa.table({
            "block": np.full(n, block), "idx": np.arange(n, dtype=np.int32), "doc_id": ids, "held_out": held.astype(bool), "n_tokens": size,
            "n_known": known, "base_score": base - size * norm, "seen_score": both + seen - start_log,
        })

    return run


def _levels(counts: Column) -> Column:
    return F.least(counts, F.lit(MAX_DISCOUNTED + 1))


def _counts_of_counts(df: DataFrame, column: str) -> dict[int, int]:
    rows = df.where(F.col(column) <= MAX_DISCOUNTED + 1).groupBy(column).count().collect()
    return {r[0]: r[1] for r in rows}


class Model(NamedTuple):
    """A trained model: tables in the shared folder and a handful of numbers.

    unigrams (w, c), bigrams (h, w, c), contexts (h, weight, follow): weight and follow are log10 of the backoff weight and of the
    context's count. Tokens are 64-bit hashes. blocks: what score() needs of the counted documents themselves.
    """

    unigrams: DataFrame
    bigrams: DataFrame
    contexts: DataFrame
    blocks: DataFrame
    total: int
    kinds: int
    documents: int
    unknown: float
    unigram_discounts: list[float]
    bigram_discounts: list[float]


def _levelled(discount: list[float], counts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, discount)), _levels(counts).cast("int"))


def train(docs: DataFrame) -> Model:
    """Counts the training documents of docs (doc_id, text, ...), discounts them and stores the weights that make each context's probabilities sum to 1."""
    tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    counted = docs.mapInArrow(_token_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("c"))
    tokens = table(counted, "tokens")
    stat = tokens.agg(
        F.coalesce(F.sum(F.when(F.col("w").isNotNull(), F.col("c"))), F.lit(0)),
        F.count("w"),
        F.coalesce(F.sum("c"), F.lit(0)),
        F.coalesce(F.max(F.when(F.col("w") == int(END.view(np.int64)), F.col("c"))), F.lit(0)),
    ).first()
    total, kinds, everything, trained_docs = stat
    unigrams = tokens.where(F.col("w").isNotNull())
    ranges = max(1, -(-everything // RANGE))
    limit = max(1, total // (4 * ranges))
    frequent = unigrams.where(F.col("c") > limit).orderBy(F.col("c").desc(), "w").limit(HOT).collect()
    hot_rows = sorted((np.int64(r["w"]).view(np.uint64), r["c"]) for r in frequent)
    hot, hot_counts = np.array([w for w, _ in hot_rows], np.uint64), np.array([c for _, c in hot_rows], np.int64)
    unigram = discounts(_counts_of_counts(unigrams, "c"))
    kept = _levelled(unigram, F.col("c")) * F.col("c")
    unknown = 1 - (unigrams.where("c > 0").agg(F.coalesce(F.sum(kept), F.lit(0.0))).first()[0] / total if total else 0.0)
    packed = docs.mapInArrow(_packer(hot, ranges), "side int, key long, block long, data binary")
    # more partitions than keys, so that a task seldom sorts the rows of two ranges
    packed = packed.repartition(4 * ranges, "side", "key")
    found = table(packed.groupBy("side", "key").applyInArrow(_range_counts(hot, hot_counts, unigram, total, unknown), _COLUMNS), "model", ["kind"])
    pairs = found.where("kind = 'pairs'").select("h", "w", "c", "cw")
    bigram = discounts(_counts_of_counts(pairs, "c"))
    keep = _levelled(bigram, F.col("c")) * F.col("c")
    lower = _levelled(unigram, F.col("cw")) * F.col("cw") / float(max(total, 1))
    contexts = pairs.groupBy("h").agg(F.sum("c").alias("ch"), F.sum(keep).alias("kept"), F.sum(lower).alias("lower"))
    weight = F.log10((1 - F.col("kept") / F.col("ch")) / F.greatest(1 - F.col("lower"), F.lit(1e-300)))
    follow = F.when(F.col("h") != int(START.view(np.int64)), F.log10(F.col("ch").cast("double"))).otherwise(F.lit(float(np.log10(max(trained_docs, 1)))))
    contexts = table(contexts.select("h", weight.alias("weight"), follow.alias("follow")), "weights")
    return Model(unigrams, pairs.select("h", "w", "c"), contexts, found, int(total), int(kinds), int(trained_docs), float(unknown), unigram, bigram)


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, h, w, n) of the texts of rows (doc_id: their key, text)."""
    for ids, counts, tokens, contexts in _blocks(batches):
        row = np.repeat(np.array(ids, np.int64), counts + 1)
        order = np.lexsort((tokens, contexts, row))
        r, h, w = row[order], contexts[order], tokens[order]
        begin = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1]) | (w[1:] != w[:-1]))))
        n = np.diff(np.append(begin, len(r)))
        for k in range(0, len(begin), 1 << 16):
            at = begin[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(r[at]), pa.array(h[at].view(np.int64)), pa.array(w[at].view(np.int64)), pa.array(n[k : k + (1 << 16)])], ["key", "h", "w", "n"])


def apply(model: Model, docs: DataFrame) -> DataFrame:
    """docs' rows and columns with n_tokens and score (log10) added, from the stored tables; any documents, not only those that were counted.

    A pair that was counted has its discounted share; else its context's weight goes to the token alone, and
    what no table knows to the mass left for unknown tokens. A context that was never met weighs 1.
    """
    tune(docs.sparkSession)
    docs = docs.drop("n_tokens", "score")
    key = F.xxhash64(F.col("text"))
    texts = docs.select(key.alias("doc_id"), "text").dropDuplicates(["doc_id"])
    rows = texts.mapInArrow(_pairs_of, "key long, h long, w long, n long")
    rows = rows.join(model.bigrams, ["h", "w"], "left").join(model.unigrams.withColumnRenamed("c", "cw"), "w", "left").join(model.contexts, "h", "left")
    alone = F.when(F.col("cw") > 0, F.log10(_levelled(model.unigram_discounts, F.col("cw")) * F.col("cw") / float(max(model.total, 1)))).otherwise(F.lit(float(np.log10(model.unknown)) if model.unknown > 0 else float("-inf")))
    pair = F.log10(_levelled(model.bigram_discounts, F.col("c")) * F.col("c")) - F.col("follow")
    logp = F.when(F.col("c") > 0, pair).otherwise(F.coalesce("weight", F.lit(0.0)) + alone)
    sums = rows.groupBy("key").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * logp).alias("score"))
    return docs.withColumn("_key", key).join(sums, F.col("_key") == F.col("key")).drop("_key", "key")


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each of docs (doc_id, text, ...).

    Trains on the training documents and scores all in the same pass. Null text: empty, whose only token is the end. Repeated rows are documents
    of their own. With no training document every token is unknown. The score is the sum of log10 probabilities.
    """
    model = train(docs)
    found, contexts, total, trained_docs = model.blocks, model.contexts, model.total, model.documents
    backed = found.where("kind = 'backed'").select("h", "block", "idx", "n", "x").join(contexts, "h", "left")
    backed = backed.groupBy("block", "idx").agg(
        F.sum(F.col("n") * (F.col("x") + F.coalesce("weight", F.lit(0.0)) + F.coalesce("follow", F.lit(0.0)))).alias("backed")
    )
    norm = float(np.log10(total + 0.1 * (model.kinds + 1)))
    shape = "block long, idx int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, seen_score double"
    logs = [float(np.log10(d)) for d in model.bigram_discounts]
    start_log = float(np.log10(max(trained_docs, 1)))
    sums = found.where("kind in ('docs', 'sums')").select("kind", "block", "data").groupBy("block").applyInArrow(_doc_sums(logs, norm, start_log), shape)
    return sums.join(backed, ["block", "idx"], "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).alias("train_tokens"), "base_score",
        (F.col("seen_score") + F.coalesce("backed", F.lit(0.0))).alias("score"),
    )
