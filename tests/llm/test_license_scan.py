"""The license scan against a plain reading of the same rules."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from barlake.llm import license_scan, queries

from .test_llm import sentence
from .test_odd_rows import SHAPE, frame

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
COLUMNS = "doc_id n_words n_base first_word last_word base_labels labels score".split()
NOTICE = dict(license_scan.NOTICES)


def read(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base_of(text):
    w = read(text)
    at = sorted((i, label) for label, p in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()]


def by_sql(rows):
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.execute("create table documents as select doc_id, cast(text as varchar) as text from given")
    return con.sql(queries.oracle_sql()["op13_license_scan"]).fetchall()


def edited(rng, text, share, gaps=0):
    """Words replaced, and some put in or left out."""
    w = text.split()
    for k in rng.sample(range(len(w)), int(share * len(w))):
        w[k] = f"changed{k}"
    for k in sorted(rng.sample(range(len(w)), gaps), reverse=True):
        w[k : k + 1] = [w[k], "put", "in"] if k % 2 else []
    return " ".join(w)


def test_scan_against_sql_and_plain_reading(spark):
    rng, texts = random.Random(3), {}
    lines = [*license_scan.PHRASES, *license_scan.NOTICES]
    for k in range(60):
        parts = [sentence(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            label, text = rng.choice(lines)
            parts += [edited(rng, text, rng.choice([0, 0, 0.05, 0.15, 0.3]), rng.choice([0, 0, 2]) if len(text.split()) > 20 else 0), sentence(rng, rng.randint(0, 20))]
        texts[k] = rng.choice([" ", "\n", ", "]).join(parts)
    got = rows_of(license_scan.scan(frame(spark, texts).repartition(5)))
    assert Counter(got) == Counter(by_sql(list(texts.items())))
    assert {r[0]: r[1:6] for r in got} == {k: base_of(t) for k, t in texts.items()}


def test_edited_and_short_notices(spark):
    rng = random.Random(4)
    texts = {
        0: sentence(rng, 300) + " " + edited(rng, NOTICE["mit"], 0.15, 2) + " " + sentence(rng, 300),
        1: edited(rng, NOTICE["mit"], 0.6),
        2: "Licensed under CC BY-NC 4.0.",
        3: "licensed under cc by-nd 4.0",
        4: "The MIT\n\nLICENSE. " * 3,
        5: "gnu general public domain license",
        6: "the Kt license and İ mit licensé",
        7: NOTICE["isc"] + " " + NOTICE["isc"],
    }
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, texts)).collect()}
    assert got[0].labels == "mit" and 0.8 <= got[0].score < 1 and got[0].n_base == 0
    span = got[0].spans[0]
    assert 297 <= span.start <= 303 and abs(span.end - span.start - len(read(NOTICE["mit"]))) <= 8
    assert got[1].labels == "" and got[3].labels == "" and got[5].labels == "" and got[6].labels == "" and got[6].n_words == 7
    assert got[2].labels == "cc-by-nc" and got[2].base_labels == "" and got[2].score == 1
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels) == (3, 1, 7, "mit")
    assert [s.label for s in got[7].spans] == ["isc", "isc"]


def test_replaced_words_lose_no_notice_of_enough_share(spark):
    """At most a fifth of the words replaced anywhere: found, however the changes lie, if three words in a row are left at the votes asked for."""
    rng = random.Random(8)
    texts = {k: sentence(rng, 5) + " " + edited(rng, rng.choice([NOTICE["mit"], NOTICE["gpl"], NOTICE["warranty"]]), rng.choice([0.05, 0.1, 0.18])) for k in range(40)}
    assert all(r.labels for r in license_scan.scan(frame(spark, texts)).collect())


def test_odd_rows_and_both_joins(spark, monkeypatch):
    rows = [(1, None), (2, ""), (None, "mit license"), (None, "mit license"), (None, None), (3, "MIT License"), (3, "MIT License"), (3, "apache license"), (4, "x"), (5, "中文 mit license 中文"), (6, "mit " * 3 + "license"), (7, "a b " * 100_000 + "general public license " * 500)]
    docs = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 as template", "2 as k1", "'' as words", "0 as copies", "'x' as label", "7 as n_words").repartition(4)
    want = Counter((d, *base_of(t)) for d, t in rows)
    for most in (license_scan.BROADCAST_KEYS, 0):
        monkeypatch.setattr(license_scan, "BROADCAST_KEYS", most)
        assert Counter(r[:6] for r in rows_of(license_scan.scan(docs))) == want
    assert rows_of(license_scan.scan(frame(spark, {}))) == []
    assert {r.labels for r in license_scan.scan(docs, [("own", "a b a")], []).collect()} == {"", "own"}
    with pytest.raises(Exception, match="too short"):
        license_scan.scan(docs, [("bad", "one")], []).collect()


def test_no_python_in_the_plan(spark):
    plan = license_scan.scan(frame(spark, {1: "mit license"}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
