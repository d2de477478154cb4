"""Secrets: time with many matches, rows without an id, ownership counts."""

import hashlib
import re
import time
from collections import defaultdict

from tutelage.llm import secrets
from tutelage.llm.setup import prepare

KIND = "doc_id long, text string, source string, n_chars int, row long"


def test_many_matches_in_one_text(spark):
    prepare(spark)
    text = "".join(f"password = 'value{i:05d}' and {i:024x}\n" for i in range(10_000))
    start = time.time()
    got = secrets.scan(spark.createDataFrame([(1, text, "a", 0, 0)], KIND)).first()
    assert time.time() - start < 60
    assert (got.n_assign, got.n_hex) == (10_000, 10_000)
    want = [(m.start(), r, f"{k}:{m.start()}:{m.end()}") for r, (k, p) in enumerate(secrets.BASE.items())
            for m in re.finditer(p, text) if k != "assign" or len(m[2]) >= 6]
    assert got.base_sha256 == hashlib.sha256(",".join(x for *_, x in sorted(want)).encode()).hexdigest()


def test_rows_without_an_id_and_repeated_ids_are_redacted(spark):
    prepare(spark)
    rows = [(None, "token: abcdef1", "a", 14, 1), (None, "nothing", "a", 7, 2), (3, "secret=hunter22 x", "b", 0, 3),
            (3, "plain", "b", 5, 4), (4, None, None, None, 5), (5, "", "a", 0, 6)]
    got = {r.row: (r.doc_id, r.text, r.n_chars) for r in secrets.redact(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {1: (None, "[secret]", 8), 2: (None, "nothing", 7), 3: (3, "[secret] x", 10), 4: (3, "plain", 5),
                   5: (4, None, None), 6: (5, "", 0)}
    assert secrets.redact(spark.createDataFrame([], KIND)).count() == 0


def test_ownership_equals_plain_counts(spark):
    prepare(spark)
    keys = ["Abc123Def456Ghi789Jk0x", "Zz9Yy8Xx7Ww6Vv5Uu4Tt3q", "password: hunter2222"]
    rows = [(i, f"see {keys[i % 3]} here", f"s{i % (2 if i % 3 else 5)}", 0, i) for i in range(30)]
    rows.append((99, "only Qq1Ww2Ee3Rr4Tt5Yy6Uu here Qq1Ww2Ee3Rr4Tt5Yy6Uu", None, 0, 99))
    owners = defaultdict(set)
    for _, text, owner, *_ in rows:
        for m in re.finditer(secrets.OWNED, text):
            owners[m[0]].add(owner)
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, KIND)).collect()}
    for doc_id, text, *_ in rows:
        want = [f"owned:{m.start()}:{m.end()}" for m in re.finditer(secrets.OWNED, text) if len(owners[m[0]]) == 1]
        assert [s for s in got[doc_id].spans.split(",") if s.startswith("owned")] == want
    assert got[99].n_live == 2 and got[2].n_copied + got[2].n_live == 1
