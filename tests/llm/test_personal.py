"""Personal data against the plain forms, and disclosing terms against counts in plain Python."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pytest

from tutelage.llm import personal
from tutelage.llm.setup import prepare

KIND = "doc_id long, text string, spans string, row int"
FORMS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == 1:
        return all(int(p) <= 255 for p in found.split("."))
    if kind == 2:
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def plain(text):
    return [(k, *m.span()) for k, form in enumerate(FORMS) for m in re.finditer(form, text or "") if passes(k, m[0])]


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_equal_the_plain_forms(seed):
    rng = random.Random(seed)
    letters = ["a", "Z", "0", "1", "5", "9", "25", ".", "@", "+", "-", " ", "%", "(", ")", "é", "\n", "4111 1111 1111 1111", "10.0.0.1", "x@y.z"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(1, 24)))
        assert [s[:3] for s in personal.base_spans(text)] == plain(text), text


def test_very_long_texts_take_linear_time():
    start = time.time()
    for text in ("a" * 3_000_000, "1" * 3_000_000, "1." * 1_500_000, "1 " * 1_500_000, "+1" + " " * 3_000_000, "a@" * 1_500_000,
                 "a@b.c " * 200_000):
        spans = personal.base_spans(text)
        list(personal.contexts(text, spans[:1000]))
    assert time.time() - start < 60


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def told(docs, least=3, threshold=0.9):
    """Spans of disclosing terms of each row, counted in plain Python."""
    entities, terms, pairs, places = defaultdict(set), defaultdict(set), defaultdict(set), []
    for row, (_, text) in enumerate(docs):
        text = text or ""
        for w in TERM.finditer(text):
            terms[w[0].lower()].add(row)
        spans = [(k, a, b, v) for k, a, b, v in personal.base_spans(text)]
        free = [w for w in TERM.finditer(text) if not any(w.start() < b and a < w.end() for _, a, b, _ in spans)]
        for k, a, b, value in spans:
            entities[k, value].add(row)
            words = list(TERM.finditer(text))
            near = [w for w in words if w.end() <= a][-6:] + [w for w in words if w.start() >= b][:6]
            for w in near:
                if any(w.span() == f.span() for f in free):
                    pairs[(k, value), w[0].lower()].add(row)
                    places.append((row, (k, value), w[0].lower(), w.span()))
    out = defaultdict(set)
    for row, e, t, span in places:
        c, df_e, df_t, n = len(pairs[e, t]), len(entities[e]), len(terms[t]), len(docs)
        if c >= least and df_e < n and math.log2(n * c / (df_e * df_t)) >= threshold * math.log2(n / df_e):
            out[row].add(span)
    return out


def made():
    rng = random.Random(8)
    filler = [f"word{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choices(filler, k=n))
    docs = [(i, f"{say(20)} Ada Quill, ada@quill.org or +1 (555) 010-9999 {say(10)}") for i in range(4)]
    docs += [(10 + i, f"{say(15)} card 4111 1111 1111 1111 of Bo {say(3)}") for i in range(3)]
    docs += [(20, "nobody but Bo here"), (21, "Ada alone"), *[(30 + i, say(40)) for i in range(60)]]
    docs += [(None, "Ada Quill ADA@quill.org"), (None, None), (98, ""), (99, "\U0001F600 é x@y.z " + "long" * 2000), (0, docs[0][1])]
    return docs


@pytest.mark.parametrize("per_pass", [2_000_000, 5])
def test_find_equals_plain_counts(spark, monkeypatch, per_pass):
    prepare(spark)
    monkeypatch.setattr(personal, "PASS_TERMS", per_pass)
    docs = made()
    got = personal.find(spark.createDataFrame([(*d, "x", 1) for d in docs], KIND).repartition(3))
    terms = told(docs)
    assert terms and set(terms) <= {0, 1, 2, 3, 4, 5, 6, 69, 73}
    want = []
    for row, (doc_id, text) in enumerate(docs):
        base = plain(text)
        listed = [f"{personal.KINDS[k]}:{a}:{b}" for k, a, b in base]
        own = sorted(terms[row])
        want.append((doc_id, *(sum(k == j for k, _, _ in base) for j in range(4)), hashlib.sha256(",".join(listed).encode()).hexdigest(),
                     ",".join(listed + [f"term:{a}:{b}" for a, b in own]), len(own)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_sanitise_hides_values_and_what_tells_them(spark):
    prepare(spark)
    docs = made()
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], KIND)
    clean = personal.sanitise(table)
    assert clean.columns == table.columns
    texts = [r.text for r in clean.collect()]
    assert not [t for t in texts if t and ("quill" in t.lower() or "4111" in t)]
    assert sum(t is None for t in texts) == 1 and any(t == "Ada alone" for t in texts)
    assert any("[email]" in t and "[phone]" in t for t in texts if t)


def test_empty_table(spark):
    empty = spark.createDataFrame([], KIND)
    assert personal.find(empty).count() == 0 and personal.sanitise(empty).count() == 0
