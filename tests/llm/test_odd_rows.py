"""Odd rows, large groups, values just over old bounds, and results that must not depend on how rows are dealt."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barlake.llm import byte_bpe, common, exact_topk, jaccard_join, katz_lm, pii, quality_rules, queries, source_mix, substring_dedup, suffix_dedup, url_filters

from .test_llm import jaccard_truth, sentence, topk_truth, windows_truth, words

SHAPE = "doc_id long, text string"


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), SHAPE)


def covered(rows, one="doc_id", start="start", end="end"):
    out = {}
    for r in rows:
        out.setdefault(r[one], set()).update(range(r[start], r[end]))
    return out


def versions(rng, n, size, edits):
    passage, out = sentence(rng, size).split(), []
    for k in range(n):
        out.append(list(passage))
        for p in rng.sample(range(size), edits):
            passage[p] = f"new{k}n{p}"
    return out


def test_substring_results_do_not_depend_on_partitions(spark):
    rng = random.Random(31)
    texts = {k: " ".join([sentence(rng, 20), *w, sentence(rng, 20)]) for k, w in enumerate(versions(rng, 90, 80, 2))}
    shared = sentence(rng, 55)
    texts |= {k: sentence(rng, 30) + " " + shared + " " + sentence(rng, 30) for k in range(100, 180)}
    docs, got = frame(spark, texts), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts, dealt in ((1, 3), (4, 1), (40, 13)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got.append(Counter(tuple(r) for r in substring_dedup.find(docs.repartition(dealt)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2] and len(got[0]) > 100


def test_substring_large_groups_lose_no_member(spark):
    """Groups far over GROUP places: every text whose passage another has is found, nearly all its words, and the classes hold together."""
    rng = random.Random(32)
    base = sentence(rng, 120).split()
    texts = {}
    for k in range(220):  # near copies, all linked to most others
        w = list(base)
        for p in rng.sample(range(120), 6):
            w[p] = f"e{k}n{p}"
        texts[k] = " ".join([sentence(rng, 15), *w, sentence(rng, 15)])
    line = sentence(rng, 52)
    texts |= {k: sentence(rng, 25) + " " + line + " " + sentence(rng, 25) for k in range(300, 500)}
    short = sentence(rng, 20)
    texts |= {k: sentence(rng, 40) + " " + short + " " + sentence(rng, 40) for k in range(600, 700)}
    rows = substring_dedup.find(frame(spark, texts)).collect()
    got = covered(rows)
    for k, v in covered(rows, "other_id", "other_start", "other_end").items():
        got.setdefault(k, set()).update(v)
    assert set(got) == set(range(220)) | set(range(300, 500))
    assert sum(len(got[k] & set(range(15, 135))) for k in range(220)) >= 0.98 * 220 * 120
    assert all(set(range(25, 77)) <= got[k] for k in range(300, 500))
    parent = {k: k for k in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        parent[root(r["doc_id"])] = root(r["other_id"])
    assert len({root(k) for k in got}) == 2


def test_substring_splits_hot_keys(spark, monkeypatch):
    rng = random.Random(45)
    line = sentence(rng, 54)
    texts = {k: sentence(rng, 20) + " " + line + " " + sentence(rng, 20) for k in range(400)} | {k: sentence(rng, 90) for k in range(400, 420)}
    for name, value in (("HOT", 100), ("SAMPLED", 2), ("LINKED", 8)):
        monkeypatch.setattr(substring_dedup, name, value)
    hot = substring_dedup.frequent_keys(frame(spark, texts))
    assert len(hot) == 51 and all(3 <= n <= 6 for n in hot.values())
    rows = substring_dedup.find(frame(spark, texts)).collect()
    got = covered(rows)
    for k, v in covered(rows, "other_id", "other_start", "other_end").items():
        got.setdefault(k, set()).update(v)
    assert set(got) == set(range(400)) and all(set(range(20, 74)) <= v for v in got.values())
    links = {k: set() for k in got}
    for r in rows:
        links[r["doc_id"]].add(r["other_id"]), links[r["other_id"]].add(r["doc_id"])
    seen, todo = {0}, [0]
    while todo:
        new = links[todo.pop()] - seen
        seen |= new
        todo += new
    assert seen == set(range(400)) and len(rows) < 400 * 12


def test_substring_recall_on_drifting_versions(spark):
    rng = random.Random(33)
    made = versions(rng, 200, 200, 4)
    texts = {k: " ".join([sentence(rng, 30), *w, sentence(rng, 30)]) for k, w in enumerate(made)}
    truth = {(a, b) for a, b in combinations(range(200), 2) if sum(x == y for x, y in zip(made[a], made[b])) >= 160}
    got = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in substring_dedup.find(frame(spark, texts)).collect()}
    assert len(truth) > 1500 and len(truth & got) >= 0.9 * len(truth)


def test_passages_of_an_id_at_two_texts_and_null_ids(spark):
    rng = random.Random(34)
    a, b = sentence(rng, 70), sentence(rng, 70)
    rows = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, "y " + b), (None, a), (4, None), (5, "")], SHAPE).withColumn("spans", F.lit("clash"))
    assert {(r["doc_id"], r["n_words"]) for r in suffix_dedup.find(rows).collect()} == {(1, 70), (2, 71), (3, 71)}
    got = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in substring_dedup.find(rows).collect()}
    assert got == {(1, 2), (1, 3)}


def test_suffix_order_alone_finds_nearly_all(spark):
    rng = random.Random(35)
    texts = {k: " ".join(sentence(rng, 40) if rng.random() < 0.7 else s for s in rng.choices([sentence(rng, n) for n in (52, 60, 75)], k=3)) for k in range(60)}
    rows = suffix_dedup.find(frame(spark, texts)).collect()
    got = {r["doc_id"]: {x for s in r["spans"] for x in range(s["start"], s["end"])} for r in rows}
    assert got == windows_truth(texts) and sum(r["n_rest"] for r in rows) <= 0.05 * sum(r["n_repeated"] for r in rows)


def test_jaccard_of_an_id_at_two_texts_and_null_ids(spark):
    rng = random.Random(36)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(3, a), (7, b), (7, a), (9, b), (11, c), (None, c + " more"), (None, None), (12, " ")]
    got = jaccard_join.join(spark.createDataFrame(rows, SHAPE).withColumn("copies", F.lit(1))).collect()
    assert len(got) == len(rows)
    classes = {}
    for r in got:
        if r["text_key"] is not None:
            classes.setdefault(r["class_key"], []).append((r["doc_id"], r["class_id"], r["n_links"]))
    assert sorted(sorted(map(str, v)) for v in classes.values()) == sorted(sorted(map(str, v)) for v in ([(3, 3, 1), (7, 3, 1)], [(7, 7, 1), (9, 7, 1)], [(11, 11, 1), (None, 11, 1)]))
    assert {(r["doc_id"], r["class_id"]) for r in got if r["text_key"] is None} == {(None, None), (12, 12)}


def test_jaccard_recall_on_the_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(700).collect()}
    links, least = jaccard_truth(texts)
    got = {r["doc_id"]: r for r in jaccard_join.join(frame(spark, texts)).collect()}
    wanted, found = sum(map(len, links.values())), sum(min(r["n_links"], len(links[k])) for k, r in got.items())
    assert wanted > 20 and found >= 0.999 * wanted and sum(got[k]["class_id"] == least[k] for k in texts) >= 0.999 * len(texts)


def test_prefix_is_shortened_until_the_recall():
    assert jaccard_join.prefix_depth(0.8, 0.9999) == 5 and jaccard_join.prefix_depth(0.99, 0.9) == jaccard_join.DEPTH and jaccard_join.prefix_depth(0.4, 0.999) < 3
    rng = np.random.default_rng(37)
    sig = rng.integers(0, 4, (50, jaccard_join.TREES * jaccard_join.DEPTH)).astype(np.uint32)
    for t, (order, shared) in enumerate(jaccard_join._common_prefixes(sig)):
        rows = [tuple(r) for r in sig[order].reshape(50, jaccard_join.TREES, jaccard_join.DEPTH)[:, t]]
        assert rows == sorted(rows)
        for k in range(1, 50):
            assert shared[k] == next((i for i in range(jaccard_join.DEPTH) if rows[k][i] != rows[k - 1][i]), jaccard_join.DEPTH)


def test_pii_context_and_neighbours(spark):
    one, two = "DE89370400440532013000", "GB82WEST12345698765432"
    assert pii.find(f"pay {one} {two} now")[2] == f"iban:4:{4 + len(one)},iban:{5 + len(one)}:{5 + len(one) + len(two)}"
    assert "iban" not in pii.find(f"invoice {one}")[2] and "iban" in pii.find(f"invoice to account {one}")[2] and "iban" in pii.find(f"reorder {one}")[2]
    assert "ssn" in pii.find("ssn border 123-45-6789")[2] and "ssn" not in pii.find("ssn order 123-45-6789")[2]
    assert pii.detect(spark.createDataFrame([], SHAPE)).count() == 0
    twice = pii.detect(spark.createDataFrame([(1, "a@b.de"), (1, "a@b.de")], SHAPE)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_quality_of_texts_over_the_part(monkeypatch):
    rng, model = np.random.default_rng(38), {"w": np.random.default_rng(39).normal(size=quality_rules.DIM).astype(np.float32), "a": 1.0, "b": 0.1}
    texts = [" ".join(rng.choice(["ab", "cde", "f", "é", "word"], 400)).encode() for _ in range(5)] + [b"x" * 900, b"", b"a b"]
    whole = quality_rules.probabilities(texts, model)
    monkeypatch.setattr(quality_rules, "PART", 97)
    assert np.allclose(quality_rules.probabilities(texts, model), whole, rtol=0, atol=1e-9)


def test_quality_training_takes_one_text_a_label(spark):
    rng = random.Random(40)
    rows = [(k, sentence(rng, 60) if k % 2 else "junk # " * 60) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    once = quality_rules.train(spark.createDataFrame(rows, SHAPE), labels)
    assert once["rows"] == 60 == quality_rules.train(spark.createDataFrame(rows + rows * 2, SHAPE), labels)["rows"]


def test_bpe_of_long_pieces_and_repeated_rows(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(queries.VOCABULARY)
    codec = byte_bpe.codec(byte_bpe.read_vocabulary(path), public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(41)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "abc xyz", "-=_", "日本語", "aA1") for n in (999, 1001, 6000)]
    for text, (ids, back) in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text) and back == text.encode()
    rows = byte_bpe.encode(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], SHAPE), path, public_tokenizers.PATTERN).collect()
    assert len(rows) == 3 and Counter(r["n_tokens"] for r in rows) == {2: 2, 0: 1}


def test_topk_of_repeated_rows_over_many_clusters(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "SHARD", 60)
    monkeypatch.setattr(exact_topk, "CENTRES", 5)
    rng = np.random.default_rng(42)
    centres = rng.normal(size=(6, 10)) * 3
    data = [(k, (centres[k % 6] + rng.normal(size=10) * 0.3).tolist()) for k in range(500)] + [(1000 + k, [0.5] * 10) for k in range(200)] + [(7, [2.0] * 10), (7, [2.0] * 10)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in exact_topk.search(rows, rows.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ints = [(k, np.floor(np.array(v) * 256)) for k, v in data]
    assert got == topk_truth(ints, [(k, v) for k, v in ints if k % 50 == 0], 5)


def test_url_ties_repeats_and_long_links(spark):
    far = "x" * 40
    rows = [
        (1, "http://good.com/a", f'<a href{" " * 30}={" " * 30}"{"h" * 60}://both.org/x">'), (2, "http://bad.net/es/x", None), (3, "http://both.org/", '<a href="//bad.net/">'),
        (3, "http://both.org/", '<a href="//bad.net/">'), (4, f"http://{far}.org", "<p>" + "href=" * 20_000),
    ]
    got = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("trust", F.lit(1))).collect()
    assert Counter((r["page_id"], r["verdict"]) for r in got) == {(1, "allow"): 1, (2, "block"): 1, (3, "allow"): 2, (4, "allow"): 1}


def test_katz_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b a"), (1, "a b a"), (None, None), (20, "c")], SHAPE)
    got = katz_lm.score(rows.withColumn("kind", F.lit("clash"))).collect()
    assert len(got) == 4 and len({(r["n_tokens"], round(r["score"], 9)) for r in got if r["doc_id"] == 1}) == 1


def test_mix_tilts_rates_by_size_and_keeps_odd_columns(spark):
    rng = random.Random(43)
    rows = [(k, sentence(rng, 10 if k % 2 else 100), "big" if k % 4 else "small") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1)).withColumn("cell", F.lit(2))
    got = source_mix.mix(docs).collect()
    rate = {(s, n): np.mean([r["copies"] for r in got if (r["source"], r["size"]) == (s, n)]) for s, n in {(r["source"], r["size"]) for r in got}}
    for s in ("big", "small"):
        mine = [r for r in got if r["source"] == s]
        share = mine[0]["target"] / mine[0]["source_size"]
        sizes = sorted(n for t, n in rate if t == s)
        # tilted towards long texts where the source must grow, towards short ones where it must shrink
        assert (share - 1) * (rate[s, sizes[-1]] - rate[s, sizes[0]]) >= 0 and abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 0.01 * mine[0]["target"]
    same = [(5, "one two three", "s")] * 500 + [(k, "one two three four", "t") for k in range(500)]
    taken = source_mix.mix(spark.createDataFrame(same, "doc_id long, text string, source string")).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")), F.max("target")).collect()
    assert all(abs(r[1] - r[2]) <= 60 for r in taken)


def test_pipeline_keeps_texts_that_share_an_id(spark):
    rng = random.Random(44)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(3, a), (7, b), (7, a), (9, b), (11, c), (11, c), (None, c)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], shape)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(3, a), (7, b), (11, c)]) and kept.columns == docs.columns
    none = spark.createDataFrame([], shape)
    assert corpus_pipeline.near_duplicates(spark, none, "").count() == 0 and corpus_pipeline.mixing(spark, none, "").count() == 0 and corpus_pipeline.tokens(spark, none, "").count() == 0
    mixed = corpus_pipeline.mixing(spark, docs.withColumn("copies", F.lit(1)).withColumn("row_id", F.lit(2)), "")
    assert mixed.columns == [*docs.columns, "copies", "row_id"] and {(r["doc_id"], r["text"]) for r in mixed.collect()} <= set(rows)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], shape).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    from barlake.llm.common import shared_folder

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_word_helper_counts_like_the_pattern():
    assert words("a\x0bb c\x1cd") == ["a", "b", "c\x1cd"]


def signed(texts):
    runs = {k: (sig, s) for k, s, sig in jaccard_join._signature_runs([t.encode() for t in texts])}
    return np.array([runs[k][0] for k in range(len(texts))]), [runs[k][1] for k in range(len(texts))]


def test_prefix_is_shortened_as_far_as_the_recall_asks():
    """Close copies among strangers end at the full depth; pairs near the threshold that have not met drive the search on; nothing is lost."""
    rng = random.Random(41)
    close, near, strangers = [], [], [sentence(rng, 150) for _ in range(30)]
    for _ in range(12):
        base = sentence(rng, 200).split()
        close.append(" ".join(base))
        close.append(" ".join([*base[:100], "changed", *base[101:]]))
    for _ in range(60):  # about 0.8 to 0.83 of the shingles are common
        base = sentence(rng, 200).split()
        near.append(" ".join(base))
        for k in (20, 70, 120, 170):
            base[k] = f"other{k}"
        near.append(" ".join(base))

    def run(texts, target=jaccard_join.TARGET_RECALL):
        sig, sets = signed(texts)
        pairs, depth = jaccard_join.shortened(sig, sets, np.triu(np.ones((len(texts), len(texts)), bool), 1), 5, 0.8, target)
        truth = {(a, b) for a, b in combinations(range(len(texts)), 2) if (c := len(np.intersect1d(sets[a], sets[b]))) >= 0.8 * (len(sets[a]) + len(sets[b]) - c)}
        return set(pairs), truth, depth

    found, truth, depth = run(close + strangers)
    assert found == truth and len(truth) == 12 and depth == jaccard_join.DEPTH
    # what has not met at the full depth, and what the estimate makes of it
    met, truth, depth = run(near + strangers, target=0.5)
    assert depth == jaccard_join.DEPTH
    found, truth, depth = run(near + strangers)
    assert len(truth) >= 55 and found == truth and (depth < jaccard_join.DEPTH) == (len(met) < len(truth))
    lost = [k for k in range(60) if (2 * k, 2 * k + 1) in truth - met]
    hard = [t for k in (lost or [0]) for t in near[2 * k : 2 * k + 2]] + strangers
    found, truth, depth = run(hard)
    assert found == truth and (not lost or depth < jaccard_join.DEPTH)
    assert run(strangers)[2] == jaccard_join.DEPTH


def test_an_estimate_short_of_the_target_goes_on(monkeypatch):
    """Signatures that agree well and yet share no prefix: the guarantee of a depth is met, the estimate is not."""
    n = jaccard_join.TREES * jaccard_join.DEPTH
    one = np.arange(1, n + 1, dtype=np.uint32)
    two = one.reshape(jaccard_join.TREES, jaccard_join.DEPTH).copy()
    two[:, 5] += 1000  # every trie parts at the sixth value: they meet at depth 5 only
    sig, same = np.stack([one, two.ravel()]), np.arange(100, dtype=np.uint64)
    open_ = np.array([[False, True], [False, False]])
    assert jaccard_join.shortened(sig, [same, same], open_, 5, 0.8, 0.9) == ([(0, 1)], 5)
    far = np.stack([one, one + np.uint32(5000)])
    assert jaccard_join.shortened(far, [same, same], open_, 5, 0.8, 0.9) == ([], jaccard_join.DEPTH)


def test_substring_classes_stand_for_the_pairs_that_are_not_listed(spark):
    """150 versions of one passage, 8 words of 100 changed in each: not all pairs are listed, but every version stands in the one class; others do not."""
    rng = random.Random(44)
    texts = {k + 10: " ".join([sentence(rng, 10), *w, sentence(rng, 10)]) for k, w in enumerate(versions(rng, 150, 100, 8))}
    pair = sentence(rng, 60)
    texts |= {300: pair + " " + sentence(rng, 30), 301: sentence(rng, 20) + " " + pair, 302: sentence(rng, 90), 400: texts[10], 501: sentence(rng, 70)}
    texts[502] = texts[501]
    rows = substring_dedup.find(frame(spark, texts)).collect()
    classes: dict = {}
    for r in rows:
        classes.setdefault(r["class_id"], set()).update((r["doc_id"], r["other_id"]))
    assert classes == {10: {*range(10, 160), 400}, 300: {300, 301}, 501: {501, 502}}


def test_substring_passages_go_on_without_seeds(spark):
    """300 common words, 200 equal and 100 of which every fourth differs: no seed in those, behind or in front, nor in 300 of them."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 1 << 40, n)]
    changed = lambda run: [f"x{k}" if k % 4 == 3 else w for k, w in enumerate(run)]
    texts, at = {}, {}
    for k, (head, core, tail) in enumerate([(0, 200, 100), (100, 200, 0), (0, 1200, 300), (300, 1200, 0), (100, 600, 100)]):
        one, two, three = word(head), word(core), word(tail)
        texts[2 * k] = " ".join(word(400) + one + two + three + word(400))
        texts[2 * k + 1] = " ".join(word(30) + changed(one) + two + changed(three) + word(500))
        at[2 * k] = 400, 400 + head + core + tail
        at[2 * k + 1] = 30, 30 + head + core + tail
    rows = substring_dedup.find(frame(spark, texts)).collect()
    found = {}
    for r in rows:
        assert found.setdefault(min(r["doc_id"], r["other_id"]), r) is r
        for doc, start, end in ((r["doc_id"], r["start"], r["end"]), (r["other_id"], r["other_start"], r["other_end"])):
            assert abs(start - at[doc][0]) <= 2 and abs(end - at[doc][1]) <= 2, (doc, start, end, at[doc])
        assert r["similarity"] > 0.9
    assert sorted(found) == [0, 2, 4, 6, 8]
    # texts that end while the passage runs, and a text that is nothing but its end
    run = word(200)
    short = {0: " ".join(word(50) + run), 1: " ".join(run[:120] + changed(run[120:])), 2: " ".join(run[:60])}
    got = {(r["doc_id"], r["other_id"]): r for r in substring_dedup.find(frame(spark, short)).collect()}
    assert {tuple(sorted(k)) for k in got} == {(0, 1), (0, 2), (1, 2)}
    (pair,) = (r for k, r in got.items() if set(k) == {0, 1})
    assert {pair["end"] - pair["start"], pair["other_end"] - pair["other_start"]} <= set(range(198, 202))


def test_substring_lists_all_pairs_of_large_groups(spark, monkeypatch):
    """150 versions of one passage, 8 words of 100 changed in each on its own, are linked all to all, but for two that share a third one's words; so are 40 where their keys are split."""
    rng = random.Random(46)
    base = sentence(rng, 100).split()
    made = []
    for k in range(150):
        made.append(list(base))
        for p in rng.sample(range(100), 8):
            made[k][p] = f"e{k}n{p}"
    texts = {k: " ".join([sentence(rng, 20), *w, sentence(rng, 20)]) for k, w in enumerate(made)}
    equal = lambda a, b: max(len(run) for run in "".join(".x"[x != y] for x, y in zip(made[a], made[b])).split("x"))

    def missed(n):
        got = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in substring_dedup.find(frame(spark, {k: texts[k] for k in range(n)})).collect()}
        rest = set(combinations(range(n), 2)) - got
        assert all(equal(a, b) >= 50 and any({tuple(sorted((a, c))), tuple(sorted((b, c)))} <= got for c in range(n)) for a, b in rest)
        return len(rest)

    assert missed(150) < 10
    for name, value in (("HOT", 12), ("SAMPLED", 2), ("GROUP", 8), ("ROUND", 300)):
        monkeypatch.setattr(substring_dedup, name, value)
    assert substring_dedup.frequent_keys(frame(spark, texts)) and missed(40) < 10


def test_substring_short_lines_cost_no_pairs(spark, monkeypatch):
    """A line of 13 words in 160 texts makes no chains of all with all; a passage that is this line and pieces of three words, and no four in a row elsewhere, is found."""
    rng = random.Random(47)
    line = sentence(rng, 13)
    texts = {k: " ".join([sentence(rng, 40), line, sentence(rng, 40)]) for k in range(160)}
    for k in range(0, 20, 2):
        before, behind = (texts[k].split(f" {line} ")[n].split() for n in (0, 1))
        behind = [f"e{k}n{p}" if p % 4 == 0 else w for p, w in enumerate(behind)]
        texts[k + 1] = " ".join([sentence(rng, 40), line, *behind])
    made, write = [], substring_dedup.table

    def table(df, name):
        out = write(df, name)
        if name == "chains":
            made.append(out.count())
        return out

    for name, value in (("SAMPLED", 1), ("LINE", 64), ("table", table)):
        monkeypatch.setattr(substring_dedup, name, value)
    got = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in substring_dedup.find(frame(spark, texts)).collect()}
    assert got == {(k, k + 1) for k in range(0, 20, 2)} and made[0] < 500


def found_and_chains(spark, monkeypatch, texts):
    made, write = [], substring_dedup.table

    def table(df, name):
        out = write(df, name)
        if name == "chains":
            made.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "table", table)
    return {tuple(sorted((r["doc_id"], r["other_id"]))) for r in substring_dedup.find(frame(spark, texts)).collect()}, made[0]


def test_substring_runs_of_one_word_cost_no_pairs(spark, monkeypatch):
    """100 texts that have a word 20 to 48 times in a row make no chains of all with all; those that go on alike, at once or behind a few edits, before it or behind it, are found."""
    rng = random.Random(48)
    run = lambda w, n: " ".join([w] * n)
    texts = {k: " ".join([run(f"a{k}", 30), run("the", rng.randint(20, 48)), run(f"b{k}", 30)]) for k in range(100)}
    for p in range(4):
        for k, (n, m) in enumerate(((46, 31), (43, 40))):
            texts[100 + 6 * p + k] = " ".join([run(f"c{p}k{k}", 20), run("the", n), run(f"d{p}", m), f"e{p}k{k}"])
            texts[102 + 6 * p + k] = " ".join([f"f{p}k{k}", run(f"g{p}", m), run("the", n), run(f"h{p}k{k}", 20)])
            texts[104 + 6 * p + k] = " ".join([run("the", n), f"i{p}k{k} " * (k + 2), run(f"j{p}", m)])
    for k in range(2):
        texts[124 + k] = " ".join([run("the", 9), f"l{k}", run("the", 8 + k), f"m{k}", run("n", 30 + k), f"o{k}", run("the", 12)])
    got, chains = found_and_chains(spark, monkeypatch, texts)
    assert got == {(k, k + 1) for k in range(100, 126, 2)} and chains < 5000


def test_substring_runs_of_one_word_go_on(spark):
    """Two texts whose runs of one word are followed by the same words are listed, though a third one has 50 of that word too."""
    run = lambda w, n: " ".join([w] * n)
    texts = {0: run("the", 60), 1: f"a {run('the', 80)} {run('it', 70)}", 2: f"b {run('the', 70)} {run('it', 60)} c", 3: f"d {run('the', 55)} e"}
    rows = substring_dedup.find(frame(spark, texts)).collect()
    assert any({r["doc_id"], r["other_id"]} == {1, 2} and r["end"] - r["start"] >= 130 for r in rows)
    assert {0, 1, 2, 3} == {k for r in rows for k in (r["doc_id"], r["other_id"])}


def test_substring_lines_at_ends_of_texts_cost_no_pairs(spark, monkeypatch):
    """What two texts have behind their ends is no common run; pieces that are met in several ways give a pair once."""
    rng = random.Random(49)
    line = sentence(rng, 13)
    texts = {k: " ".join([sentence(rng, 40), line] if k % 2 else [line, sentence(rng, 40)]) for k in range(160)}
    for name, value in (("SAMPLED", 1), ("LINE", 64)):
        monkeypatch.setattr(substring_dedup, name, value)
    got, chains = found_and_chains(spark, monkeypatch, texts)
    assert got == set() and chains < 100
    words = np.arange(1, 245, dtype="<u2")[None, :].repeat(2, axis=0)
    words[1, [110, 130]] = 999
    pairs = list(substring_dedup._elsewhere(np.array([0]), np.array([2]), np.arange(2), words, 21))
    assert [len(i) for i, _ in pairs] == [1]


def test_substring_keys_go_in_turns():
    """A turn sends the keys of its own buckets only, lines and runs of one word too, and all turns send what one would."""
    rng = random.Random(50)
    line = sentence(rng, 13)
    texts = [" ".join([sentence(rng, 200), line, " ".join(["the"] * (5 + k)), sentence(rng, 50)]) for k in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts)], ["doc_id", "text"])
    lines = np.sort(substring_dedup._text_keys(*common.joined_words([line.encode()]))[2])

    def sent(turn, turns):
        out = Counter()
        for b in substring_dedup._keys(8, {int(lines[0]): 3}, 4, 50, lines, 120, turn, turns)(iter([batch])):
            out.update(zip(b.column("bucket").to_pylist(), b.column("data").to_pylist()))
        return out

    every, turns = sent(0, 1), [sent(k, 2) for k in range(2)]
    assert {b // 8 for b, _ in every} == {0, 1, 2}
    assert all(b % 2 == k for k in range(2) for b, _ in turns[k]) and turns[0] + turns[1] == every
