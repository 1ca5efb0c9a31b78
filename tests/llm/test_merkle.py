"""The Merkle manifest against a plain tree in memory."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from barlake.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def H(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def told(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(row, text=...):
    doc_id, own, lang, source, n_chars = row
    return H("".join(told(x) for x in (doc_id, source, lang, n_chars, own if text is ... else text)))


def plain_tree(nodes):
    """Root, and for each node its siblings up to the root."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, j in enumerate(at):
            run = level[j // 8 * 8 : j // 8 * 8 + 8]
            proofs[k] += run[: j % 8] + run[j % 8 + 1 :]
            at[k] = j // 8
        level = [H("".join(level[j : j + 8])) for j in range(0, len(level), 8)]
    return level[0], proofs


def truth(rows):
    by_lang: dict = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = (own, *plain_tree([leaf_of(r) for r in own]))
    root, tops = plain_tree([trees[lang][1] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        own, subroot, proofs = trees[lang]
        out += [(r[0], leaf_of(r), subroot, root, H("".join(p + top))) for r, p in zip(own, proofs)]
    return sorted(out, key=str)


def check(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(parts).selectExpr("*", "1 as g", "2 as i", "'x' as digest", "'y' as path", "3 as block")
    tried = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    found = merkle.audit(merkle.manifest(docs, tried)).collect()
    assert sorted([(r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof_sha256) for r in found], key=str) == truth(rows)
    return found


def test_manifest_against_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)  # several rounds of blocks
    monkeypatch.setattr(merkle, "BLOCK", 64)
    rng = random.Random(1)
    sizes = {None: 1, "": 9, "de": 64, "en": 700, "fr": 65, "é": 8, "z": 513} | {f"l{k}": 1 + k % 3 for k in range(70)}
    rows = [(rng.randrange(2000), rng.choice(["Text", "text", "", None, "é\n" * 9]), lang, rng.choice([None, "", "src:1"]), rng.choice([None, 0, 12])) for lang, n in sizes.items() for _ in range(n)]
    found = check(spark, rows)
    by_text = {leaf_of(r): r for r in rows}
    for r in found:
        changed = by_text[r.leaf.hex()][1] == "Text" and r.doc_id is not None and r.doc_id % 3 == 0
        assert r.verified is (not changed) and (r.folded_root == r.root) is r.verified


def test_manifest_of_odd_rows(spark):
    assert check(spark, [(5, "one", "en", "s", 3)])[0].verified
    rows = [(None, None, None, None, None)] * 3 + [(1, "same", "en", "s", 4)] * 20 + [(1, "other", "en", "s", 5), (2, "A" * 300_000, "en", None, 1)]
    check(spark, rows)
    check(spark, rows, parts=1)
    assert merkle.audit(merkle.manifest(spark.createDataFrame([], COLUMNS), F.col("text"))).collect() == []


def test_fold_notices_any_change():
    nodes = [bytes([k]) * 32 for k in range(75)]
    root, paths = merkle.walk(nodes, 3)
    for k, (node, path) in enumerate(zip(nodes, paths)):
        assert merkle.fold(node, path, [(k, 75)]) == root
        assert merkle.fold(nodes[k - 1], path, [(k, 75)]) != root
