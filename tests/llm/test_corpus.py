"""The corpus operators against brute force on small tables with the awkward cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tutelage.llm import (
    hyperplane, langid, minhash, ngram_lm, packing, passages, rans, rendezvous, secrets, simhash,
)
from tutelage.llm.components import connected_components
from tutelage.llm.setup import TOKENIZER, prepare
from tutelage.llm.tokens import PieceTokenizer
from tutelage.llm.words import read_words, text_bytes

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, ids string"
RNG = np.random.default_rng(5)
VOCAB = ["".join(RNG.choice(list("abcdefgh"), 5)) for _ in range(400)]
PARA = [VOCAB[i] for i in RNG.integers(0, 400, 120)]


def made():
    """Copies, near copies, a repeated row, blanks, a long text, nulls; columns that clash."""
    base = " ".join(PARA)
    near = " ".join([*PARA[:60], "changed", *PARA[61:]])
    other = " ".join(VOCAB[i] for i in RNG.integers(0, 400, 90))
    quote = " ".join([*(VOCAB[i] for i in RNG.integers(0, 400, 30)), *PARA[10:75], *(VOCAB[i] for i in RNG.integers(0, 400, 40))])
    texts = {1: base, 2: base.upper(), 3: near, 4: other, 5: None, 6: "", 7: " \t\n", 8: "one", 9: "one", 10: "one two",
             11: quote, 12: " ".join(VOCAB[i] for i in RNG.integers(0, 400, 20_000)), 13: "password = 'hunter22' AKIA" + "B2" * 10,
             14: "é\U0001F600 0123456789abcdef01234567 token: ab", 15: "12345 !!", 16: "x <|endoftext|> y"}
    out = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", None if t is None else len(t), 0, 0, "x") for i, t in texts.items()]
    return [*out, out[3], (None, "no id here", None, None, 10, 0, 0, "x")]


ROWS = made()


def rows():
    return ROWS


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame(rows(), KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, k):
    w = words(text)
    return [tuple(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []


def components(nodes, links):
    least = {n: n for n in nodes}
    for _ in nodes:
        for u, v in links:
            least[u] = least[v] = min(least[u], least[v])
    return least


def test_words_match_the_definition():
    texts = ["", " a\tB  c", None, "É é\x85x\x1cy", "one", "a " * 5]
    got = read_words(*text_bytes(pa.array(texts)))
    for d, text in enumerate(texts):
        raw = (text or "").encode()
        own = slice(got.first[d], got.first[d + 1])
        assert [raw[a:b].decode().lower().encode() for a, b in zip(got.starts[own], got.ends[own])] == [
            w.lower().encode() for w in words(text)]


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (8, 7), (7, 9), (3, 20), (11, 11), (None, 2)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {3: 3, 4: 3, 5: 3, 20: 3, 7: 7, 8: 7, 9: 7}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k):
    by_id = {r[0]: set(shingles(r[1], k)) for r in rows() if r[0]}
    links = [(u, v) for u, a in by_id.items() for v, b in by_id.items()
             if u < v and a and b and 100 * len(a & b) >= 80 * len(a | b)]
    least = components(by_id, links)
    want = Counter((r[0], len(by_id[r[0]]) if r[0] else len(set(shingles(r[1], k))), least.get(r[0]),
                    least.get(r[0]) == r[0]) for r in rows())
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs, words=k).collect())
    assert got == want


@pytest.mark.parametrize(("small", "part"), [(8, 1 << 20), (1, 300)])
def test_near_duplicates_in_drifting_groups(spark, monkeypatch, small, part):
    """Groups whose ends are unlike each other, some texts linked to a single other one."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "PART", part)
    rng = np.random.default_rng(3)
    texts = []
    for group in range(2):
        base = [VOCAB[i] for i in rng.integers(0, 400, 150)]
        for _ in range(40):
            text = list(base)
            for at in rng.integers(0, 150, int(rng.integers(3, 14))):
                text[at] = VOCAB[rng.integers(0, 400)]
            texts.append(" ".join(text))
            if rng.random() < 0.2:
                base = text
    sets = {i: set(shingles(x, 2)) for i, x in enumerate(texts)}
    links = [(u, v) for u, a in sets.items() for v, b in sets.items() if u < v and 100 * len(a & b) >= 80 * len(a | b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=2).collect()}
    assert got == components(sets, links)
    assert len(set(got.values())) > 2


def test_language(spark, empty):
    pairs = [(i, ("the of and in to is " if i % 2 else "der die und das ist ein ") * 5, "en" if i % 2 else "de") for i in range(60)]
    extra = [(100, None, "en"), (101, "12 !!", "en"), (102, "the and of", None), (None, "und das", "de")]
    found = langid.identify(spark.createDataFrame(pairs + extra, "doc_id long, text string, lang string")).collect()
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == lang and 0 <= by_id[i].score <= 1 for i, _, lang in pairs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    assert by_id[100].lang_pred == by_id[101].lang_pred == "und" and by_id[102].lang_pred == "en"
    assert langid.identify(empty).count() == 0


def test_language_costs_are_exact():
    counts = np.zeros((2, 256), np.float32)  # nodes: the empty context, the context a
    counts[0, [97, 98]], counts[1, 98] = [3, 1], 2
    bits = langid._costs(counts, np.array([1]), np.array([0, 1]), np.array([0, 0]))[0]
    assert bits[98] == pytest.approx(-np.log2(2 / 3))
    # escape, then among what is left of the shorter context, then evenly
    assert bits[97] == pytest.approx(-np.log2(1 / 3) - np.log2(3 / 4))
    assert bits[1] == pytest.approx(-np.log2(1 / 3) - np.log2(1 / 4) + np.log2(254))


def test_language_on_held_out_rows(spark):
    found = entry.queries()["op1_language"](spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()


def test_tokens_equal_the_library():
    parts = [" ", "  ", "\n", " \n", "\t", "a", "é", "!", "\x1c", "'s", "9", "ab ", "　", "<|endoftext|>", "\0", "\xa0", "A,"]
    texts = ["".join(RNG.choice(parts, RNG.integers(0, 12))) for _ in range(4000)] + [None]
    own = PieceTokenizer(TOKENIZER)
    ids, first = own.encode(pa.array(texts))
    want = Tokenizer.from_file(TOKENIZER).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(w.ids == ids[a:b].tolist() for w, a, b in zip(want, first, first[1:]))


def ids_of(text):
    return np.array(Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_packing(docs, empty):
    pieces = packing.pack(docs, TOKENIZER).collect()
    line = defaultdict(list)
    for p in pieces:
        line[p.sequence_id].append(p)
    for s, own in line.items():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        assert s == max(line) or sum(p.length for p in own) == 1024
    text = {r[0]: r[1] for r in rows()}
    for i in (1, 5, 12, 16):
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == ids_of(text[i]).tobytes()
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_token_files(docs, empty):
    found = rans.round_trip(docs, TOKENIZER).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == Counter((r[0], ids_of(r[1]).tobytes()) for r in rows())
    found.sort(key=lambda r: r.start)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    assert [r.doc_id or -1 for r in found] == sorted(r.doc_id or -1 for r in found)
    assert rans.round_trip(empty, TOKENIZER).count() == 0


def test_damaged_block_is_noticed():
    blocks = [RNG.integers(0, 500, n).astype(np.uint32) for n in (1, 64, 1000, 0, 777)]
    counts = Counter(np.concatenate(blocks).tolist())
    table = rans.Frequencies.of(counts)
    coded = rans.encode_blocks(blocks, table)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, rans.decode_blocks(coded, table, table.symbols())))
    bad = bytearray(coded[2])
    bad[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode_blocks([bytes(bad)], table, table.symbols())


def test_vectors(spark):
    base = RNG.standard_normal((40, 16))
    group = base[0] + 0.05 * RNG.standard_normal((30, 16))
    data = [(i, v.tolist(), i % 2) for i, v in enumerate(np.concatenate([base, group, group[:5], 3 * base[:4]]))]
    data += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, base[0].tolist(), None), (504, [], 1),
             (505, [None] * 16, 0), (506, base[0].tolist()[:8], 0)]
    good = {i: (np.array(v), lab) for i, v, lab in data if i < 500 or i == 506}
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98
    links = [(u, v) for u, (a, x) in good.items() for v, (b, y) in good.items() if u < v and x == y and cos(a, b)]
    least = components([r[0] for r in data], links)
    count = Counter(x for pair in links for x in pair)
    hyperplane.PART_ROWS, before = 8, hyperplane.PART_ROWS
    try:
        got = {tuple(r) for r in hyperplane.near_vectors(
            spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    finally:
        hyperplane.PART_ROWS = before
    assert got == {(i, count[i], least[i], least[i] == i) for i, _, _ in data}


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, docs, empty):
    both = docs.select("doc_id", "text", "source").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr(
        "doc_id + 1000", "text", "source")).union(spark.createDataFrame(
            [(900, "token=token:abcdefgh \u0001 Ab3Cd5Ef7Gh9Ij1Kl2Mn3", "s")], "doc_id long, text string, source string"))
    found = {r.doc_id: r for r in secrets.scan(both).collect()}
    for r in both.collect():
        want = base_spans(r.text or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        got = found[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(s[3] == k for s in want) for k in secrets.BASE)
        assert set(filter(None, listed.split(","))) <= set(got.spans.split(","))
    assert "owned" in found[900].spans
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert "hunter22" not in clean[13] and "AKIA" not in clean[13] and clean[4] == dict((r[0], r[1]) for r in rows())[4]
    assert secrets.scan(empty).count() == 0


def test_shards(docs, empty):
    found = rendezvous.shard_documents(docs).collect()
    assert len(found) == len(rows())
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    assert all(r.grown_shard in (r.shard, 16) for r in found)
    text = {r[0]: (r[1] or "").encode() for r in rows()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in found)
    assert rendezvous.shard_documents(empty).count() == 0


def test_weights_decide_how_much_a_shard_gets(spark):
    ids = spark.range(20_000)
    n = Counter(r.shard for r in rendezvous.assign_shards(ids, "id", [1.0, 3.0]).collect())
    assert n[1] / n[0] == pytest.approx(3, rel=0.1)


def test_passages(docs, empty):
    found = {(r.doc_id, r.like_id): r for r in passages.repeated_passages(docs).collect()}
    assert {(2, 1), (3, 1), (11, 1)} <= set(found)
    assert not {i for pair in found for i in pair} & {4, 8, 9, 10, 12, 13, 14}
    quote = found[11, 1]
    assert quote.start_word <= 32 and quote.end_word >= 93 and quote.like_end - quote.like_start >= 60
    assert passages.repeated_passages(empty).count() == 0


@pytest.mark.parametrize("edit", [1, -1])
def test_passages_with_a_word_more_or_less(spark, edit):
    # 50 to 60 words in unrelated context; one word is inserted, or deleted where 50 remain
    rng = np.random.default_rng(7)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 60, n)]
    pairs = []
    for k in range(60):
        own = fresh(52 + k % 9)
        at = len(own) // 2
        other = own[:at] + (fresh(1) + own[at:] if edit > 0 else own[at + 1:])
        pairs += [(2 * k, " ".join(fresh(80) + own + fresh(80))), (2 * k + 1, " ".join(fresh(70) + other + fresh(90)))]
    found = passages.repeated_passages(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.like_id) for r in found} == {(2 * k + 1, 2 * k) for k in range(60)}


def test_passages_side_by_side_that_are_apart_elsewhere():
    rng = np.random.default_rng(8)
    fresh = lambda n: rng.integers(0, 1 << 62, n)
    one, two = fresh(46), fresh(46)
    edited = np.concatenate([one[:20], fresh(5), one[24:]])
    for gap in (0, 8, 30, 60):
        b = np.concatenate([fresh(9), one, fresh(gap), two, fresh(9)])
        for between in (30, 300):
            for p, q in ((one, two), (two, one), (edited, two)):
                # a fragment of the first passage comes before it
                a = np.concatenate([fresh(5), one[:30], fresh(20), p, fresh(between), q, fresh(5)])
                got = {(y, v) for x, y, u, v, like in passages.common_passages(a, b, 46, 0.8)}
                first, second = 55 + len(p), 55 + len(p) + between + len(q)
                ends = (second, first) if p is two else (first, second)
                assert got == {(ends[0], 55), (ends[1], 101 + gap)}, (gap, between)


def test_passages_around_a_fragment(spark):
    # the smallest id has a fragment of what two others hold whole
    rng = np.random.default_rng(9)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 60, n)]
    texts = []
    for _ in range(150):
        own = fresh(50)
        texts += [fresh(90) + own[:40] + fresh(90), fresh(90) + own + fresh(90), fresh(90) + own + fresh(90)]
    found = passages.repeated_passages(
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.like_id) for r in found} >= {(3 * k + 2, 3 * k + 1) for k in range(150)}


@pytest.mark.parametrize("size", [10, 24, 200])
def test_passages_like_one_that_is_settled(spark, size):
    # x is like y and y is like the centre, but x is not like the centre; the rest are like the centre
    rng = np.random.default_rng(size)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 60, n)]
    texts, families = [], 20
    for _ in range(families):
        own = fresh(60)
        y = [*fresh(3), *own[3:]]
        x = [*y[:-4], *fresh(4)]
        others = [[*own[:30 + k % 20], *fresh(1), *own[31 + k % 20:]] for k in range(size - 3)]
        texts += [fresh(50) + t + fresh(50) for t in [own, *others, y, x]]
    found = passages.repeated_passages(
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    linked = {(r.doc_id, r.like_id) for r in found}
    for k in range(families):
        own = range(k * size, k * size + size)
        assert {d for d, _ in linked if d in own} >= set(own[1:])
    assert all(d // size == e // size for d, e in linked)


@pytest.mark.parametrize("edits", [0, 3])
def test_second_look_meets_windows_in_bulk(monkeypatch, edits):
    """Families around one shingle; where a stretch is the same its windows are linked without a comparison."""
    rng = np.random.default_rng(11)
    around = []
    for family in range(6):
        base = rng.integers(0, 1 << 31, 117)
        for _ in range(15):
            own = base.copy()
            own[:25] = rng.integers(0, 1 << 31, 25)
            own[rng.integers(27, 57, edits)] = rng.integers(0, 1 << 31, edits)
            own[58] = 7
            around.append(own.astype(np.int32))
    n = len(around)
    by = rng.permutation(n)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(np.full(n, 100)), pa.array(np.zeros(n, bool)),
         pa.array([around[i] for i in by], pa.list_(pa.int32()))], ["key", "doc_id", "c", "settled", "around"])
    whole = passages.common_passages
    want = components(range(n), [(u, v) for u in range(n) for v in range(u) if whole(around[by[u]], around[by[v]], 46, 0.8)])
    calls = []
    monkeypatch.setattr(passages, "common_passages", lambda *a: calls.append(1) or whole(*a))
    links = [p for b in passages._second_look(46, 0.8)(iter([batch])) for p in zip(b["a_doc"].to_pylist(), b["b_doc"].to_pylist())]
    assert components(range(n), links) == want
    assert len(set(want.values())) == 6
    assert edits or not calls


def test_windows_inside_a_run_are_its_ends():
    # "the" 300 times between other words: a run's windows are those of its first and last wide place
    text = " ".join([*(f"a{k}" for k in range(60)), *["the"] * 300, *(f"b{k}" for k in range(60))])
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    out = [b for b in passages._windows(50)(iter([batch]))]
    places = np.concatenate([b["place"].to_numpy() for b in out]) >> 2 * passages.REACH_BITS
    run = places[(places >= 60) & (places <= 355)]
    assert 60 in run and 2 <= len(run) <= 2 * passages.HASHES
    again = np.array([False, False, True, True, True, True, False, True])
    assert passages.run_ends(np.array([0, 1, 2, 3, 4, 6, 7]), again).tolist() == [True, True, False, False, True, True, True]


@pytest.mark.parametrize("tail", [30, 60])
def test_passages_that_begin_in_runs_of_different_length(spark, tail):
    # a run and the words after it, or before it, repeat; the runs are of different length
    rng = np.random.default_rng(tail)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 60, n)]
    texts, families = [], 20
    for k in range(families):
        own = fresh(tail)
        for size in (60, 400, 25, 180):
            run = [f"the{k}"] * size
            texts.append([*fresh(70), *run, *own, *fresh(70)] if k % 2 else [*fresh(70), *own, *run, *fresh(70)])
    found = passages.repeated_passages(
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    linked = {(r.doc_id, r.like_id) for r in found}
    assert all(d // 4 == e // 4 for d, e in linked)
    of = components(range(len(texts)), linked)
    assert all(len({of[4 * k + j] for j in range(4)}) == 1 for k in range(families))


def test_second_look_at_a_common_phrase(monkeypatch):
    """Windows that share a phrase around c and nothing else are not met, however many they are."""
    rng = np.random.default_rng(12)
    n = 3000
    around = rng.integers(0, 1 << 31, (n, 117)).astype(np.int32)
    around[:, 50:67] = np.arange(17)
    around[n - 1, 20:100] = around[5, 20:100]
    met = []     # meetings that are looked up or counters that are kept for them
    whole, count = np.unique, np.bincount
    monkeypatch.setattr(np, "unique", lambda x, **k: met.append(0 if k else len(x)) or whole(x, **k))
    monkeypatch.setattr(np, "bincount", lambda x, **k: met.append(k.get("minlength", 0)) or count(x, **k))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(np.full(n, 100)), pa.array(np.zeros(n, bool)),
         pa.array(list(around), pa.list_(pa.int32()))], ["key", "doc_id", "c", "settled", "around"])
    links = [p for b in passages._second_look(46, 0.8)(iter([batch])) for p in zip(b["a_doc"].to_pylist(), b["b_doc"].to_pylist())]
    assert links == [(5, n - 1)]
    assert 0 < sum(met) < 40 * n


def test_pairs_that_share_too_little_are_not_compared():
    rng = np.random.default_rng(13)
    pairs = []
    for _ in range(300):
        a = rng.integers(0, 1 << 31, rng.integers(0, 150))
        b = rng.integers(0, 1 << 31, rng.integers(0, 150))
        if len(a) and len(b):
            size = int(rng.integers(0, min(len(a), len(b)) + 1))
            b[len(b) - size:] = a[:size]
        pairs.append((a, b))
    sizes = [np.array([len(p[k]) for p in pairs]) for k in range(2)]
    may = passages.may_share(np.concatenate([p[0] for p in pairs]), sizes[0], np.concatenate([p[1] for p in pairs]), sizes[1], 46, 0.8)
    has = np.array([bool(passages.common_passages(a, b, 46, 0.8)) for a, b in pairs])
    assert not (has & ~may).any()
    assert has.sum() and (~may).sum() > 50


def test_wide_nodes_of_many_texts():
    values = RNG.integers(0, 40, 400).astype(np.uint64)
    first = np.array([0, 0, 5, 17, 17, 140, 152, 400, 400])
    want = [tuple(int(x) + a for x in node) for a, b in zip(first, first[1:])
            for node in zip(*wide(values[a:b]))]
    assert list(zip(*(x.tolist() for x in passages.wide_nodes(values, 12, first)))) == want


def wide(values):
    return passages.wide_nodes(values, 12)


def test_wide_nodes_equal_the_tree():
    values = RNG.integers(0, 40, 300).astype(np.uint64)
    want = set()
    for c in range(300):
        low = c
        while low and values[low - 1] > values[c]:
            low -= 1
        high = c
        while high < 299 and values[high + 1] >= values[c]:
            high += 1
        if high - low + 1 >= 12:
            want.add((c, low, high))
    assert set(zip(*(x.tolist() for x in passages.wide_nodes(values, 12)))) == want


def test_decontamination(spark, docs, empty):
    item = PARA[20:60]
    edited = [*item[:30], "new", *item[31:]]
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(edited)), (3, None), (4, ""), (5, "one"), (6, " ".join(VOCAB[:30]))],
                                  "item_id long, text string")
    bags = {r.item_id: (Counter(shingles(r.text, 5)), len(words(r.text))) for r in items.collect() if r.text}
    want = {}
    for r in rows():
        w = words(r[1])
        for i, (bag, size) in bags.items():
            if not w or (size < 5) != (len(w) < 5):
                continue
            size = max(size, 5)  # a shorter item is held against whole texts
            for at in range(max(len(w) - size, 0) + 1):
                own = Counter(shingles(" ".join(w[at:at + size]), 5))
                like = sum((own & bag).values()) / sum((own | bag).values())
                if like >= 0.8 and like > want.get((r[0], i), (0, 0))[1]:
                    want[r[0], i] = (at, like)
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in simhash.contaminated(docs, items).collect()}
    assert got == {k: (a, pytest.approx(b)) for k, (a, b) in want.items()} and (1, 1) in got
    assert simhash.contaminated(empty, items).count() == 0
    assert simhash.contaminated(docs, items.where("item_id > 90")).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.01, 1.0])
def test_scores(docs, empty, spark, share, monkeypatch):
    # all pairs sent to the tasks, some, or none: the losses are the same
    monkeypatch.setattr(ngram_lm, "PAIR_SHARE", share)
    target = spark.createDataFrame([(1,), (3,), (None,)], "doc_id long")
    found = {r.doc_id: r for r in ngram_lm.score(docs, target).collect()}
    assert found[2].score < 0 < found[4].score and found[5].score is None and found[7].n_words == 0
    single = [Counter(), Counter()]
    pair = [Counter(), Counter()]
    for r in rows():
        w, b = words(r[1]), 0 if r[0] in (1, 3) else 1
        single[b].update(w)
        pair[b].update(zip(w, w[1:]))
    kinds = set(single[0]) | set(single[1])
    context = [Counter(), Counter()]
    for b in (0, 1):
        for (v, _), c in pair[b].items():
            context[b][v] += c

    def loss(w, b):
        plain = lambda x: (single[b][x] + 1) / (sum(single[b].values()) + len(kinds) + 1)
        total = -np.log2(plain(w[0]))
        for v, x in zip(w, w[1:]):
            kept = {y: c for (u, y), c in pair[b].items() if u == v}
            c = max(context[b][v], 1)
            left = 1 - sum(max(n - 0.75, 0) for n in kept.values()) / c
            total -= np.log2(max(kept.get(x, 0) - 0.75, 0) / c + left * plain(x))
        return total / len(w)

    for i in (1, 10, 13):
        w = words(dict((r[0], r[1]) for r in rows())[i])
        assert found[i].target_bits == pytest.approx(loss(w, 0)) and found[i].background_bits == pytest.approx(loss(w, 1))
    assert ngram_lm.score(empty, target).count() == 0


@pytest.mark.parametrize("name", ["op2_near_duplicates", "op6_near_vectors"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, entry.queries()[name](spark, SF).select(*columns).collect())) == sorted(want.fetchall())


def test_pipeline_stages(spark, docs):
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 8, 9, 10, 11, 12, 13, 14, 16, None}
    one = corpus_pipeline.near_dedup(spark, docs, SF)
    assert Counter(r.doc_id for r in one.collect()) == Counter([1, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15, 16, None])
    assert corpus_pipeline.hide_secrets(spark, docs, SF).columns == docs.columns
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n <> 1024").count() <= 1
