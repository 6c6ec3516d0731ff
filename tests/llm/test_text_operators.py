"""Spelling variants, suffix sorting and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quillgrid.llm import anchors, induced, periodic, slabs, spelling, suffixes

SCHEMA = "doc_id bigint, text string, word string, n int, slab int, bucket int, runs int, root int"
FOLDER = "/root/testdata/sf0.001"


def documents(spark, texts):
    """Texts with ids; a pair gives its own id. Further columns have names that the operators use."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in rows], SCHEMA)


def given(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


ODD = ["", None, "one", " \n\t ", "a\x00b " * 40, "x" * 3000, "naïve ½ 漢字 " * 30, "y " * 400, (2, "one"), (None, "no id " * 30), (None, None)]


# Spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 5 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def plain_counts(rows):
    counts = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("seed", range(3))
def test_variants_of_counts(spark, seed):
    rng = random.Random(seed)
    words = {}
    while len(words) < 300:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        words[w] = rng.choice([5, 25, 26, 125, 1000, rng.randint(5, 700)])
    got = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n bigint"))
    assert {tuple(r) for r in got.collect()} == plain_variants(words)


@pytest.mark.parametrize("texts", [None, ODD, [], [None]])
def test_variants_of_texts(spark, texts):
    if texts is None:
        texts = [*given(spark), *given(spark)[:40], *ODD, (7, "Straßen strassen ÀÉÎÕÜ Àéîõü " * 9)]
    df = documents(spark, texts)
    got = spelling.variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(plain_counts([(r.doc_id, r.text) for r in df.collect()]))
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


# Suffix sorting


def test_induced_order():
    rng = random.Random(4)
    for case in range(200):
        letters = rng.choice([1, 2, 3, 9, 244])
        text = b""
        for _ in range(rng.randint(1, 9)):
            unit = bytes(rng.randint(1, letters) for _ in range(rng.randint(1, 6)))
            text += (unit * 40)[: rng.randint(1, 60)] + b"\0"
        order, shared = induced.suffix_order(np.frombuffer(text, np.uint8), rng.choice([6, 64]), rng.choice([1, 1 << 20]))
        suffixes_ = [text[i : text.index(0, i) + 1] for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(text))) and suffixes_ == sorted(suffixes_), text
        for a, b, got in zip(suffixes_, suffixes_[1:], shared[1:].tolist()):
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y or not x), min(len(a), len(b)))
            assert min(got, len(a) - 1, len(b) - 1) == min(same, len(a) - 1, len(b) - 1), text


def test_queues_beyond_memory():
    queues = induced.Queues(100)
    for i in range(30):
        queues.push(i % 3, np.arange(i, i + 5), np.full(5, i, np.uint8))
    for q in range(3):
        a, b = queues.pop(q)
        assert a.tolist() == [x for i in range(q, 30, 3) for x in range(i, i + 5)]
        assert b.tolist() == [i for i in range(q, 30, 3) for _ in range(5)]
    assert queues.pop(0) is None


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(1)
    raw = np.concatenate([rng.integers(97, 100, 700_000), np.full(900, 97), np.tile(rng.integers(97, 123, 400), 3)]).astype(np.uint8)
    ends = np.array([100, 100, 149, 300_000, 300_049, len(raw)])
    first, count, owner, key = anchors.anchor_runs(raw, ends)
    strings = {}
    for f, c, o, k in zip(first.tolist(), count.tolist(), owner.tolist(), key.tolist()):
        assert f + c + anchors.WINDOW - 1 <= ends[o] and (o == 0 or f >= ends[o - 1])
        for i in range(f, f + c):
            assert strings.setdefault(raw[i : i + anchors.WINDOW].tobytes(), k) == k
    sizes = np.diff(ends, prepend=0)
    assert count.sum() == np.maximum(sizes - anchors.WINDOW + 1, 0).sum()


def plain_removal(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if i is not None and first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def passages(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab é") for _ in range(n)) for n in (10, 30, 49, 50, 51, 80, 300)]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(60)]


@pytest.mark.parametrize("slab_bytes, hot", [(8 << 20, 256), (2000, 1)])
@pytest.mark.parametrize("kind", ["given", "passages", "odd", "empty"])
def test_removal(spark, monkeypatch, kind, slab_bytes, hot):
    monkeypatch.setattr(suffixes, "SLAB_BYTES", slab_bytes)
    monkeypatch.setattr(suffixes, "HOT_SLABS", hot)
    texts = {"given": given(spark)[:120] if kind == "given" else [], "passages": passages(1), "odd": [*ODD, *ODD], "empty": []}[kind]
    df = documents(spark, texts)
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    got = suffixes.removal_digests(df).collect()
    assert Counter(tuple(r) for r in got) == plain_removal(rows)


@pytest.mark.parametrize("kind", ["passages", "odd"])
def test_removal_with_strings_dealt_out_one_by_one(spark, monkeypatch, kind):
    monkeypatch.setattr(suffixes, "SLAB_BYTES", 2000)
    monkeypatch.setattr(suffixes, "HOT_SLABS", 1)
    monkeypatch.setattr(suffixes, "HOT_STRETCHES", 2)
    df = documents(spark, passages(1) if kind == "passages" else [*ODD, *ODD])
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    assert Counter(tuple(r) for r in suffixes.removal_digests(df).collect()) == plain_removal(rows)


def anchor_states(texts_by_slab):
    """What becomes of the anchors of slabs with one document a text."""
    made = [suffixes.Slab(b"".join(t), np.array([len(x) for x in t]), [1000 * i + k for k in range(len(t))], 1) for i, t in enumerate(texts_by_slab)]
    pieces = [(i, slabs.pack_arrays(*slabs.pack_sorted(s.key_rest), s.several)) for i, s in enumerate(made)]
    return [slabs.unpack_arrays(value, "u1")[0] for _, value in suffixes._shared_anchors(iter(pieces))]


def test_an_anchor_in_many_slabs_keeps_its_stretches_whole(monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_SLABS", 3)
    line = b"a line of sixty bytes or so that every one of the slabs holds"
    once = anchor_states([[line]] * 5)
    assert set(np.concatenate(once).tolist()) == {1}
    monkeypatch.setattr(suffixes, "HOT_STRETCHES", 60)
    assert set(np.concatenate(anchor_states([[line]] * 5)).tolist()) == {1}
    assert set(np.concatenate(anchor_states([[line] * 16] * 5)).tolist()) == {2}  # 16 stretches an anchor in each of five slabs
    assert set(np.concatenate(anchor_states([[line * 40]])).tolist()) == {0}  # many stretches, but of one document


def test_removal_writes_only_the_texts(spark, monkeypatch):
    names = []
    monkeypatch.setattr(suffixes, "written", lambda df, name: names.append((name, df.drop("units").columns, df.filter("units is not null").count())) or df)
    suffixes.removal_digests(documents(spark, passages(1))).collect()
    assert names == [("suffix-texts", ["slab", "ids", "sizes", "raw"], 0)]


def test_removed_spans(spark):
    shared = "".join(chr(97 + i % 23) for i in range(70))
    got = {r.doc_id: r for r in suffixes.without_repeats(documents(spark, [f"1{shared}2", f"one {shared} two {shared}é"])).collect()}
    assert got[0].spans == [] and bytes(got[0].kept).decode() == f"1{shared}2"
    assert [tuple(s) for s in got[1].spans] == [(4, 74), (79, 149)] and bytes(got[1].kept).decode() == "one  two é"


# Periodic runs


def plain_runs(words):
    n, found = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and j > i:
                smaller = any(words[i : j + q - p] == words[i + p : j + q] for p in range(1, q))
                if not smaller:
                    found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def mixture(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        unit = [rng.randint(0, rng.choice([1, 2, 30])) for _ in range(rng.randint(1, 12))]
        words += (unit * 100)[: rng.randint(0, 90)] + [rng.randint(0, 50) for _ in range(rng.randint(0, 4))]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        texts = [mixture(rng) for _ in range(rng.randint(1, 5))]
        got = periodic.find_runs(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts], np.int64))
        assert [got.get(i, []) for i in range(len(texts))] == [plain_runs(t) for t in texts]


def test_long_run_of_one_word():
    assert periodic.find_runs(np.zeros(100_000, np.int64), np.array([100_000])) == {0: [(0, 100_000, 1)]}


@pytest.mark.parametrize("kind", ["given", "mixtures", "odd", "empty"])
def test_run_digests(spark, kind):
    rng = random.Random(8)
    mixed = [" ".join(map(str, mixture(rng))) for _ in range(60)]
    texts = {"given": given(spark)[:80], "mixtures": [*mixed, *mixed[:5], "\x0ba b\x0c" * 40], "odd": ODD, "empty": []}[kind]
    df = documents(spark, texts)
    want = Counter()
    for r in df.collect():
        words = (r.text or "").encode().split()
        n, h = len(words), zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode())
        if h % 10 == 0 and n:
            a, p = (h // 10) % n, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        want[(r.doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)] += 1
    assert Counter(tuple(r) for r in periodic.run_digests(df).collect()) == want
