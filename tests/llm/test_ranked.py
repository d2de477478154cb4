"""Ranked search against exhaustive scoring and against SQL."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tutelage.llm import ranked
from tutelage.llm.setup import prepare

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id long, rank int"
ITEMS = "item_id long, text string, doc_id long"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def exhaustive(docs, items, k):
    words = [terms(t) for _, t in docs]
    n_docs, length = sum(bool(w) for w in words), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), own in zip(docs, words):
            tf, m = Counter(own), own and 75 + 25 * len(own) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
                        for t in terms(text) if tf[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def corpus(seed=1, n=300):
    rng = np.random.default_rng(seed)
    vocab = np.array([f"w{i}" for i in range(80)])
    share = 1 / np.arange(1, 81)
    draw = lambda size: " ".join(rng.choice(vocab, size, p=share / share.sum()))
    docs = [(int(i), draw(int(rng.integers(1, 60)))) for i in range(n)]
    docs += [(None, "w79 w78 w77"), (None, None), (n + 1, ""), (n + 2, " ,;-"), (n + 3, "É\U0001F600 ÀB w5-W6,w7_w8"), (5, docs[5][1]),
             (n + 4, docs[4][1].upper()), (n + 5, "w1 " * 3000), (n + 6, "x" * 5000), *[(n + 10 + i, docs[9][1]) for i in range(40)]]
    items = [(int(i), draw(int(rng.integers(1, 30)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "unheard"), (23, "É\U0001F600 é"), (24, "w1"), (24, "w1"), (None, "w79 w79 w2"), (25, docs[9][1])]
    return docs, items


@pytest.mark.parametrize("k, pass_bytes", [(20, 1 << 20), (3, 200)])
def test_search_equals_exhaustive_scoring(spark, monkeypatch, k, pass_bytes):
    prepare(spark)
    monkeypatch.setattr(ranked, "PASS_BYTES", pass_bytes)
    docs, items = corpus()
    got = ranked.search(spark.createDataFrame([(*d, 9, 9) for d in docs], DOCS).repartition(3),
                        spark.createDataFrame([(*i, 7) for i in items], ITEMS), k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == exhaustive(docs, items, k)


def test_empty_tables(spark):
    prepare(spark)
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", 0, 0)], DOCS)
    asked = spark.createDataFrame([(1, "a", 0)], ITEMS)
    assert [ranked.search(d, i).count() for d, i in ((docs, items), (docs, asked), (some, items), (some, asked))] == [0, 0, 0, 1]


def test_frequent_terms_make_no_accumulators():
    """Two rare terms fill the list; the frequent one then only updates what can still win."""
    n = 1000
    doc = np.concatenate([np.arange(30), np.arange(30), np.arange(n)])
    term = np.repeat([0, 1, 2], [30, 30, n])
    order = np.lexsort((term, doc))
    block = ranked.Block.of(term[order], np.ones(len(doc), np.int64), doc[order], np.full(n, 100), 3)
    query = ranked.Query(0, 0, np.array([0, 1, 2]), np.array([5000, 4000, 10]))
    sums, made = np.zeros(n, np.int64), np.zeros(n, bool)
    found = ranked.candidates(block, query, 20, 1, sums, made)
    assert found.tolist() == list(range(30))
    impact = 10**9 // (1000 + 1200)
    assert set(sums[found].tolist()) == {9010 * impact} and sums[30:].sum() == 0
    # a bar that earlier documents set can close the list before the first term
    assert ranked.candidates(block, query, 20, 10**12, np.zeros(n, np.int64), np.zeros(n, bool)).tolist() == []


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()["op13_ranked_search"])
    columns = [c[0] for c in want.description]
    got = entry.queries()["op13_ranked_search"](spark, SF).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
