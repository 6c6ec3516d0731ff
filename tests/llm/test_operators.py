"""The dealt operators against brute force on small tables, with nulls, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from quillgrid.llm import bpe, cross_entropy, importance, license_scan, merkle, packing, similar, simhash, slabs, topk, toxicity, warc

SCHEMA = "doc_id bigint, text string, lang string, fp int, `range` int, rank int, slab int"
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}


def documents(spark, texts):
    """Texts with ids; a pair gives its own id. Further columns have names that the operators use."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 4) for i, t in rows], SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "the", "or", "ti", "é", "sh"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


ODD = ["", None, "one", "Two words.", " \n\t ", "a\n\nb", "x" * 5000, "naïve ½ ٣ 漢字 \x1c it's 12", "ends  ", prose(1, 3000), "one", (2, "one"), (None, "no id"), (None, None)]


@pytest.mark.parametrize("texts", [ODD, [], ["only"], [None]])
def test_fingerprints(spark, texts):
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t or "") for i, t in rows]
    got = merkle.compare_with_next(documents(spark, texts)).collect()
    assert sorted(r.n_chars for r in got) == sorted(len(t) for _, t in rows)
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(r.fingerprint, 0)
    assert len(by_text) == len({t for _, t in rows})
    ids = [i for i, _ in rows]
    if None not in ids and len(set(ids)) == len(ids):
        order = sorted(rows, key=lambda r: -r[0])
        want = {i: hashlib.sha256(merkle.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest() for k, (i, t) in enumerate(order)}
        assert {r.doc_id: r.edited_sha256 for r in got} == want


def test_fingerprints_of_many_ranges(spark):
    texts = [prose(i, i % 40) for i in range(200)]
    want = {i: hashlib.sha256(merkle.edited(t, texts[i - 1]).encode()).hexdigest() for i, t in enumerate(texts)}
    got = merkle.compare_with_next(documents(spark, texts)).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == want and len(got) == 200


def test_likeness_follows_the_edit():
    text = prose(3, 2000)
    mark = merkle.fingerprint(text)
    assert merkle.likeness(mark, merkle.fingerprint(text)) == 1
    assert 0.6 < merkle.likeness(mark, merkle.fingerprint(merkle.edited(text, prose(4, 2000) * 2))) < 0.75
    assert merkle.likeness(mark, merkle.fingerprint("")) == 0


def test_likeness_of_text_that_repeats_itself():
    text = "hello world. " * 400
    mark = merkle.fingerprint(text)
    assert all(len(x) <= 255 for x in merkle._spans(text.encode()))
    assert 0.6 < merkle.likeness(mark, merkle.fingerprint(merkle.edited(text, prose(4, 2000)))) < 0.72


def test_likeness_counts_common_leaves():
    """Against the leaves themselves: copies of a leaf count as often as both texts have them."""
    from collections import Counter

    rng = random.Random(11)
    for _ in range(60):
        parts = [prose(i, 25) + rng.choice(["\n", "\n\n", " "]) for i in range(6)]
        a, b = ("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(2))
        leaves = [Counter(x for line in t.encode().splitlines(keepends=True) for x in merkle._spans(line)) for t in (a, b)]
        both = sum(len(x) * n for x, n in (leaves[0] & leaves[1]).items())
        want = 1.0 if a == b else 2 * both / max(len(a.encode()) + len(b.encode()), 1)
        # A section that is equal as a whole is set aside first, so a leaf elsewhere can miss its copy, never find too much.
        got = merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b))
        assert got == pytest.approx(want, abs=1e-9)


def test_edit_ranges_locate_edits():
    rng = random.Random(12)
    for _ in range(40):
        text = "".join(prose(rng.randrange(1000), 30) + rng.choice(["\n", "\n\n"]) for _ in range(20))
        at = rng.randrange(len(text))
        new = text[:at] + rng.choice(["", "inserted words here ", "é\n\n"]) + text[at + rng.choice([0, 7]) :]
        a, b = text.encode(), new.encode()
        ranges = merkle.edit_ranges(merkle.fingerprint(text), merkle.fingerprint(new))
        assert bool(ranges) == (a != b)
        rebuilt, place = b"", 0
        for a0, a1, b0, b1 in ranges:
            rebuilt += a[place:a0] + b[b0:b1]
            place = a1
        assert rebuilt + a[place:] == b
        assert sum(r[1] - r[0] for r in ranges) <= 800 < len(a)
    assert merkle.edit_ranges(merkle.fingerprint(""), merkle.fingerprint("abc")) == [(0, 0, 0, 3)]


@pytest.mark.parametrize("bounds", [[], [5], list(range(0, 50, 7)), list(range(100))])
def test_range_of(spark, bounds):
    df = spark.range(-3, 120).withColumn("r", merkle._range_of(F.col("id"), bounds))
    assert all(r.r == sum(b > r.id for b in bounds) for r in df.collect())


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(20):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 300))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        runs = packing.plan(histogram, 64)
        bins = {}
        for length, first, used, per, at, offset in runs:
            for b in range(used):
                for j in range(per):
                    bins.setdefault(at + b, []).append((offset + j * length, length))
        assert sorted(x for b in bins.values() for _, x in b) == sorted(lengths)
        room = []
        for x in sorted(lengths, reverse=True):
            fits = [i for i, r in enumerate(room) if r >= x]
            best = min(fits, key=lambda i: room[i]) if fits else None
            if best is None:
                room.append(64 - x)
            else:
                room[best] -= x
        assert len(bins) == len(room)
        for b in bins.values():
            places = sorted(b)
            assert all(s + n == t for (s, n), (t, _) in zip(places, places[1:])) and places[0][0] == 0 and sum(places[-1]) <= 64


@pytest.mark.parametrize("texts", [[*ODD, "a<|endoftext|>b", "a <|endoftext|>"], []])
def test_packing(spark, texts):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(documents(spark, texts)).collect()
    want = []
    for t in texts:
        i, text = t if isinstance(t, tuple) else (None, t)
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 2]
        want += [(s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for s, n in packing.cut(len(ids), 1024)]
    assert sorted((r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 1024


def reference_fingerprint(text):
    words = [w for w in text.encode().lower().replace(b"\x0b", b" ").split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(spark):
    base = prose(8, 200).split()
    texts = []
    for i in range(120):
        words = list(base)
        words[i % 50] = f"w{i % 37}"
        texts.append(" ".join(words))
    texts += [prose(100 + i, 60) for i in range(60)] + ODD[:9]
    fps = [reference_fingerprint(t or "") for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: (f"{fps[i]:016x}", group[i]) for i in range(len(texts))}


def test_links_lose_no_near_pair(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 150:
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    values = sorted(values)
    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint")

    def groups(pairs):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for v in values:
            out.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, out.values()))

    want = groups((a, b) for a in values for b in values if (a ^ b).bit_count() <= 4)
    for block in (4096, 16):  # the small one splits crowded keys
        got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(fps, block).collect()]
        assert groups(got) == want and all((a ^ b).bit_count() <= 4 for a, b in got)


def test_repeated_rows_and_missing_ids_in_the_dedup(spark):
    rows = [(5, "same text here now"), (5, "same text here now"), (None, "same text here now"), (None, "all alone in this one")]
    assert {r.component_id for r in simhash.near_duplicates(documents(spark, rows)).collect()} == {5, None}
    kept = similar.without_near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.text) for r in kept) == [(False, "same text here now"), (True, "all alone in this one")]
    assert similar.without_near_duplicates(documents(spark, [])).count() == 0
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_similar_texts_equal_brute_force(spark):
    base = prose(8, 300).split()
    texts = []
    for i in range(90):
        words = list(base)
        for j in range(i % 10):
            words[(i * 37 + j * 29) % 300] = f"w{i}x{j}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:150]) + " " + prose(200 + i, 150) for i in range(30)] + ODD[:9] + ["A b", "a B"]
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert corpus_pipeline.drop_near_duplicates(spark, documents(spark, texts), "").columns == documents(spark, []).columns
    for block in (4096, 8):  # the small one splits crowded keys
        kept = similar.without_near_duplicates(documents(spark, texts).repartition(3), block=block)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group))
        assert {r.doc_id: r.text for r in kept.collect()} == {i: texts[i] for i in set(group)}


def test_links_of_near_copies_are_linear(spark):
    def linked(n):
        base, texts = prose(9, 120).split(), []
        for i in range(n):
            words, rng = list(base), random.Random(i)
            for j in rng.sample(range(120), rng.randint(1, 4)):
                words[j] = f"w{i}x{j}"
            texts.append(" ".join(words))
        marked = similar.written(similar._marked(documents(spark, texts), 5, (4, 5)), "marked")
        blocks = similar._blocks(marked)
        return blocks.count(), similar.links(marked).count()

    for n in (500, 2000):
        members, links = linked(n)
        assert members < 12 * n and links < 3 * n


def test_maximal_segments():
    assert toxicity.maximal_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(4, 0, 1), (3, 2, 3), (7, 4, 11)]
    assert toxicity.maximal_segments([]) == [] and toxicity.maximal_segments([-1.0]) == []


def test_toxicity_of_unseen_forms(spark):
    texts, marks = [], []
    for i in range(240):
        bad = i % 4 == 0
        words = prose(i, 80).split()
        if bad:
            words[10] = f"grumblat{i % 7}"
            words[40] = "grumbler"
        texts.append(" ".join(words))
        marks.append((i, 1, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    docs = documents(spark, [*texts, "", None, "a grumblatxyz and a grumblatq"])
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i].predicted == 1) == (i % 4 == 0) for i in range(240))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert got[242].predicted == 1 and got[240].predicted == 0 and got[240].score == got[241].score
    assert {r.doc_id for r in toxicity.without_toxic(docs, model).collect()} == {i for i in range(242) if i % 4 or i > 239}
    assert {r.doc_id for r in toxicity.passages(docs, model).filter("worth > 0.7").collect()} >= {0, 4, 8}
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} == {0}


def test_importance_resampling(spark):
    good = [prose(i, 60) for i in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in prose(i, 60).split()) for i in range(50)]
    docs = documents(spark, [*good, *bad, "", None])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    ratios = importance.fit(docs, labels)
    got = {r.doc_id: r.selected for r in importance.resample(docs, ratios).collect()}
    assert got == {i: int(i < 150 or i > 199) for i in range(202)}
    assert {r.doc_id for r in importance.selected_rows(docs, ratios).collect()} == {i for i, s in got.items() if s}
    assert importance.resample(docs, ratios, k=10).filter("selected = 1").count() == 10
    assert importance.resample(documents(spark, []), ratios).count() == 0


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(importance, "_DEALT", 5)
    values = [random.Random(1).gauss(0, 1) for _ in range(500)] + [0.5] * 30
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 250, 530):
        assert importance.kth_largest(df, "x", k, bins=8) == sorted(values, reverse=True)[k - 1]


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0] * 7 + [None]), (303, [float("nan")] * 8), (7, rows[7][1]), (20, rows[20][1]), (400, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    fine = [(i, np.floor(64 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v and all(x is not None and x == x for x in v)]
    want = set()
    for q, v in {i: v for i, v in fine if i % 20 == 0}.items():
        scores = sorted(((-int(v @ w), i) for i, w in fine if i != q and len(w) == len(v)))[:20]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0.5, 40.0, 30_000.0])
def test_top_k_reads_few_exact_vectors(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, spread) for _ in range(12)], i, i, i) for i in range(400)]
    rows += [(500 + i, rows[i % 3][1], 0, 0, 0) for i in range(30)]  # ties
    # Columns with names that the operator uses.
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, block int, stripe int, uid int")
    whole = [(r[0], np.floor(64 * np.array(r[1]))) for r in rows]
    want = set()
    for q, v in whole:
        if q % 20 == 0:
            scores = sorted((-int(sum(int(a) * int(b) for a, b in zip(v, w))), i) for i, w in whole if i != q)[:20]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    vectors = topk._numbered(df)
    queries = vectors.filter("vec_id % 20 = 0")
    read = topk._by_approximation(vectors, queries, 20, 4).count()
    assert read < 3 * 20 * queries.count()  # of 429 each


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for scale in (3, 300, 1e6):
        v, q = (np.floor(rng.normal(size=(n, 9)) * scale) for n in (50, 8))
        low, step, width, cells = topk.cells_of(v)
        lower, upper = topk.bounds(q, low, step, width, cells)
        exact = q @ v.T
        assert (lower <= exact).all() and (exact <= upper).all()
        assert scale > 3 or np.allclose(lower, upper, atol=1e-6)


def test_top_k_of_large_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(100)]
    rows += [(100, [3e5] * 64), (101, [-3e5] * 64), (102, [2.0**24 - 1] * 64), (103, [2.0**22 + 1] * 64), (104, [float("inf")] * 64), (105, [1e9] + [0.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole = {i: [int(x // 1) for x in 64 * np.array(v, np.float32).astype(float)] for i, v in rows if i != 104}
    want = set()
    for q in range(0, 101, 20):
        scores = sorted((-sum(x * y for x, y in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:20]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want


@pytest.mark.parametrize("texts", [ODD, []])
def test_bpe(spark, texts):
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    plain = [(t[1] if isinstance(t, tuple) else t) or "" for t in texts]
    got = bpe.round_trip(documents(spark, texts)).collect()
    want = sorted((len(i := encoder.encode_ordinary(t)), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in plain)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    decoded = bpe.decode(bpe.encode(documents(spark, texts)))
    assert sorted(r.text for r in decoded.collect()) == sorted(plain)


def test_codes():
    rng = np.random.default_rng(1)
    for top in (1, 240, 70_000, 1 << 21):
        codes = rng.integers(0, top, 5000)
        assert (slabs.unpack_codes(slabs.pack_codes(codes)) == codes).all()
    assert len(slabs.unpack_codes(slabs.pack_codes(np.empty(0, np.int64)))) == 0


def test_license_scan(spark):
    mit = dict(license_scan.TEXTS)["MIT"]
    texts = [
        "Copyright (c) 2020 Someone\n\n" + mit.replace("\n", " "),
        "  RELEASED under the MIT Licence ",
        "Released under the MIT License. And more.",
        "",
        None,
        "Copyright 2021 A. All rights reserved.",
    ]
    bsd = dict(license_scan.TEXTS)["BSD-3-Clause"]
    texts += [
        "MIT License\n\nCopyright Joyent, Inc. and other contributors\n\n" + mit,
        "The MIT License (MIT)\nCopyright Jane Doe 2020\n" + mit.replace("software", "Software"),
        "BSD 3-Clause License\n\nCopyright (c) 2019, A\nAll rights reserved.\n\n" + bsd.replace("copyright holder nor", "Copyright Owner nor"),
        "Some prose.\nReleased under the MIT Licence.\nMore.\n\n" + mit.replace("\n", " ") + "\n\nEnd. Licensed under CC BY-NC 4.0.",
        "MIT License\n",
        (None, "x\nLicensed under CC BY-NC 4.0."),
        (None, None),
    ]
    known = license_scan.known_licenses(spark)
    rows = license_scan.scan(documents(spark, [*texts, (1, "again, released under\nReleased under the MIT License.")]), known).collect()
    got = {r.doc_id: r.license_id for r in rows if r.doc_id not in (None, 1)}
    assert got == {0: "MIT", 2: None, 3: None, 4: None, 5: None, 6: "MIT", 7: "MIT", 8: "BSD-3-Clause", 9: None, 10: None}
    assert sorted((r.license_id or "", r.part_license_ids) for r in rows if r.doc_id == 1) == [("", "MIT-notice"), ("MIT-notice", "MIT-notice")]
    assert [r.part_license_ids for r in rows if r.doc_id == 9] == ["MIT,MIT-notice"]
    assert [r.part_license_ids for r in rows if r.doc_id is None] == ["CC-BY-NC-4.0-notice"] * 2
    assert license_scan.scan(documents(spark, []), known).count() == 0
    every = {i: t for i, t in [*license_scan.NOTICES, *license_scan.TEXTS]}
    named = license_scan.scan(documents(spark, list(every.values())), known).collect()
    assert [r.license_id for r in sorted(named, key=lambda r: r.doc_id)] == list(every)


def test_cross_entropy(spark):
    import math
    from collections import Counter

    texts = ["a b a", "a b", "c c c d", "", None, "a b c"]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 2), 0) for i in range(6)], "doc_id bigint, quality int, toxic int")
    good = [i for i in range(2) if zlib.crc32(str(i).encode()) % 3 != 1]
    got = {r.doc_id: r for r in cross_entropy.score(docs, labels).collect()}

    def model(ids):
        words = [(texts[i] or "").split() for i in ids]
        uni = Counter(w for t in words for w in t)
        two = Counter(p for t in words for p in zip(["<", *t], t))
        first = sum(1 for t in words if t)

        def loss(before, w):
            p = (uni[w] + 1000 / 4) / (sum(uni.values()) + 1000)
            return -math.log((two[before, w] + 200 * p) / ((first if before == "<" else uni[before]) + 200))

        return loss

    target, background = model(good), model(range(6))
    for i, t in enumerate(texts):
        words = (t or "").split()
        for column, loss in (("target_loss", target), ("background_loss", background)):
            want = sum(loss(b, w) for b, w in zip(["<", *words], words)) / max(len(words), 1)
            assert got[i][column] == pytest.approx(want, abs=1e-5)
        assert got[i].n_tokens == len(words)
    assert cross_entropy.score(documents(spark, []), labels).count() == 0


def test_cross_entropy_learns_from_every_training_label(spark):
    n = 40_000
    docs = spark.range(n + 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, "a").otherwise("b").alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    good = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(n))
    last = cross_entropy.score(docs, labels).filter(F.col("doc_id") == n).first()
    p = (0 + 1000 / 2) / (good + 1000)
    assert good > 20_000 and last.target_loss == pytest.approx(-np.log(200 * p / (good + 200)), abs=1e-9)


def test_cross_entropy_moves_no_text_to_the_labels(spark, monkeypatch):
    plans, real = {}, cross_entropy.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().toString()
        return real(df, name)

    monkeypatch.setattr(cross_entropy, "written", noted)
    docs = documents(spark, ["a b", None, "a c", "a b"])
    twice = docs.union(docs.filter("doc_id = 0")).union(docs.selectExpr("cast(null as bigint)", *docs.columns[1:]))
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (2, 0), (99, 1)], "doc_id bigint, quality int")
    got = cross_entropy.score(twice, labels).collect()
    assert not any(x in plans["lm-slabs"] for x in ("Join", "Exchange"))  # texts are read, put in slabs and written
    assert len(got) == 9 and len({(r.doc_id, r.score) for r in got if r.doc_id is not None}) == 4
    assert {r.score for r in got if r.doc_id is None} == {r.score for r in got if r.doc_id is not None}


def test_pipeline_links_near_fingerprints(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    texts = [" ".join(base)]
    while len(texts) < 2:  # near by fingerprint, but not by shingles
        words = list(base)
        for at in rng.choice(400, 22, replace=False):
            words[at] = "x%d" % rng.integers(0, 10**6)
        a, b = (simhash.text_fingerprint(" ".join(w).encode()) for w in (base, words))
        sets = [similar.shingle_set(" ".join(w)) for w in (base, words)]
        if (a ^ b).bit_count() <= 4 and len(np.intersect1d(*sets)) < 0.8 * len(np.union1d(*sets)):
            texts.append(" ".join(words))
    docs = documents(spark, [*texts, "something else"])
    assert similar.without_near_duplicates(docs).count() == 3
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 2]


def test_warc(spark, tmp_path):
    big = "é" * 3000
    rows = [(3, "http://a/ b", big), (1, None, big), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (5, "u", None), (None, "u", big), (6, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(warc.round_trip(pages).collect(), key=lambda r: (r.page_id is None, r.page_id, r.record_type))
    raw = {r[0]: (r[2] or "").encode() for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(raw[r.page_id]), hashlib.sha256(raw[r.page_id]).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 1) if r.page_id in (3, None) else ("response", None))
    chunks = warc.chunk_rows(pages, warc.plan_records(pages), chunk_bytes=1000)
    back = warc.read_archives(warc.write_archives(chunks, str(tmp_path / "w")), chunk_bytes=700)
    parts = [r for r in back.filter("id = '1'").orderBy("chunk_no").collect()]
    assert b"".join(bytes(p.data) for p in parts).decode() == big and len(parts) == 9
    assert [p.payload_digest for p in parts] == [hashlib.sha256(big.encode()[: 700 * (i + 1)]).hexdigest() for i in range(9)]
    assert warc.round_trip(pages.limit(0)).count() == 0
