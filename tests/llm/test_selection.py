"""Importance resampling, SimHash groups and the filter audit against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from eventloom.llm import audit, importance, simhash, skew, text
from eventloom.llm.graph import stored
from tests.llm.conftest import DOCS, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans(text.UPPER, text.LOWER)
ODD = [None, "", " ", "\n\n", "é", "a", "A b\tC\x0bd", "x" * 3000, "日本語 テキスト", "\x00 \x7f", "a\n" * 50,
       "One\ntwo\n\nthree four\nfive", "\n-\nlast", "UPPER Lower\r\nwith feed"]


def corpus(rng):
    """Odd rows, shared lines, copies, a hot line, near copies, repeated rows and null ids."""
    shared = [prose(rng, 8) for _ in range(5)]
    texts = list(ODD)
    for _ in range(60):
        body = [prose(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 5))]
        texts.append("\n".join([shared[0], *body, rng.choice(shared)]))
    base = prose(rng, 120).split()
    for _ in range(80):
        changed = list(base)
        for _ in range(rng.randrange(6)):
            changed[rng.randrange(len(changed))] = prose(rng, 1)
        texts.append(" ".join(changed))
    texts += [texts[20]] * 40 + [f"{prose(rng, 60)} $5 | &"] * 3 + [prose(rng, 60).upper()]
    # One text longer than a slice.
    texts.append(prose(rng, 2 * text.SLICE_BYTES // 8))
    rows = [(i * 3, t, "en") for i, t in enumerate(texts)]
    return rows + [rows[20], rows[15], (None, texts[20], "en"), (None, None, "en"), (-7, texts[16], "en")]


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(31))


# ------------------------------------------------------------------ helpers

def test_join_spread_by_brute_force(spark):
    keys = [1] * 3000 + [2] * 40 + list(range(10, 1500))
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, i long").repartition(5)
    sizes = Counter(keys)
    right = stored(spark.createDataFrame([(k, n, f"v{k}") for k, n in sizes.items()], "key long, n long, v string"), "right")
    joined = skew.join_spread(left, right, "key", "n")
    assert sorted((r.key, r.i, r.v) for r in joined.collect()) == sorted((k, i, f"v{k}") for i, k in enumerate(keys))
    assert skew.join_spread(left.limit(0), stored(right.limit(0), "none"), "key", "n").count() == 0


def test_places_are_the_sorted_order(spark):
    rng = random.Random(3)
    values = [(rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(values, "a long, b long").repartition(7)
    got = skew.ranked(df, [df["a"].desc(), df["b"].asc()], "ranked").collect()
    want = sorted(values, key=lambda v: (-v[0], v[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == want
    assert sorted(r.place for r in got) == list(range(1, 2001))


def test_crc_of_joined_texts():
    rng = random.Random(8)
    crc = importance.Crc()
    left = [rng.randbytes(rng.randrange(30)) for _ in range(200)]
    right = [rng.randbytes(rng.choice([0, 1, 7, 255, 256, 70_000])) for _ in range(200)]
    codes = [np.array([zlib.crc32(x) for x in side], dtype=np.uint32) for side in (left, right)]
    got = crc.joined(*codes, np.array([len(x) for x in right]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right, strict=True)]


# ------------------------------------------------------------------ importance resampling

def features(value):
    w = WORD.findall((value or "").translate(FOLD))
    return [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def expected_scores(rows, target):
    def count(texts):
        total = Counter()
        for t in texts:
            total.update(zlib.crc32(f.encode()) % 10000 for f in features(t)[0])
        return total

    s, t = count(r[1] for r in rows), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
            for b in range(10000)]
    found = []
    for doc_id, value, *_ in rows:
        grams, words = features(value)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in grams)
        name = "null" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"42:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([doc_id, len(grams), weight, score, words])
    eligible = sorted((r for r in found if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(eligible[:len(eligible) * 5 // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in found]


def in_order(found):
    return sorted(found, key=str)


def test_importance_by_brute_force(spark, documents, rows):
    target = [prose(random.Random(9), 25), None, "", "alpha1\nbeta2 gamma3", "one"]
    bench = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = importance.report(documents(rows, extra=True), bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert in_order(tuple(r) for r in got.collect()) == in_order(expected_scores(rows, target))


def test_importance_of_empty_tables(spark, documents):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert importance.report(documents([]), nothing).count() == 0
    rows = [(i, prose(random.Random(i), 30), "en") for i in range(40)]
    got = importance.report(documents(rows), nothing).collect()
    assert in_order(tuple(r) for r in got) == in_order(expected_scores(rows, []))
    assert sum(r["rank"] is not None for r in got) == 2


def test_a_line_is_hashed_once(documents):
    rows = [(i, f"the same line here\nown{i} words{i}\nthe same line here", "en") for i in range(30)]
    cut = importance.segments(documents(rows))
    lines = {r.n: r.buckets for r in cut.lines.collect()}
    assert cut.lines.count() == 31 and 60 in lines
    # Four words make nine features of 16 bits.
    assert len(lines[60]) == 18


# ------------------------------------------------------------------ SimHash

def fingerprint(value):
    import xxhash

    w = SOLID.findall((value or "").translate(FOLD))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def expected_groups(rows):
    codes = [fingerprint(r[1]) for r in rows]
    distinct = sorted(set(codes))
    parent = {c: c for c in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(a)] = find(b)
    least = {}
    for (doc_id, *_), c in zip(rows, codes, strict=True):
        root = find(c)
        least.setdefault(root, None)
        if doc_id is not None and (least[root] is None or doc_id < least[root]):
            least[root] = doc_id
    return [(r[0], f"{c:016x}", least[find(c)]) for r, c in zip(rows, codes, strict=True)]


def test_simhash_by_brute_force(documents, rows):
    got = simhash.report(documents(rows, extra=True))
    want = expected_groups(rows)
    assert in_order(tuple(r) for r in got.collect()) == in_order(want)
    assert len({w[2] for w in want}) < len({w[1] for w in want})


def test_simhash_of_empty_table_and_lone_null(spark, documents):
    assert simhash.report(documents([])).count() == 0
    got = simhash.report(documents([(None, "one two three four", "en")])).collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(None, None)]


def test_fingerprint_in_pieces(monkeypatch):
    values = ["a b c d e f g", None, "x", "one two " * 40]
    whole = simhash.fingerprints(pa.array(values), text.Hasher()).tolist()
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 3)
    assert simhash.fingerprints(pa.array(values), text.Hasher()).tolist() == whole
    assert whole == [fingerprint(v) for v in values]


def _signed(code):
    return code - (1 << 64) if code >> 63 else code


def test_no_link_is_lost_on_the_ring(spark):
    """Every pair of up to three differing bits shares a key and passes the chains; chains prune."""
    rng = random.Random(12)
    pairs = []
    for n in list(range(4)) * 250 + [4, 5, 6, 8] * 250:
        a = rng.getrandbits(64)
        b = a
        # Bits in one corner as well as anywhere.
        places = rng.sample(range(64), n) if rng.random() < 0.5 else rng.sample(range(16), n)
        for p in places:
            b ^= 1 << p
        pairs.append((_signed(a), _signed(b), n))
    df = spark.createDataFrame(pairs, "a long, b long, n int")
    a, b = df["a"], df["b"]
    from pyspark.sql import functions as F

    got = df.select("n", F.arrays_overlap(simhash.ring_keys(a), simhash.ring_keys(b)).alias("met"),
                    simhash.on_budget(a.bitwiseXOR(b)).alias("chained")).collect()
    assert all(r.met and r.chained for r in got if r.n <= 3)
    far = [r for r in got if r.n >= 5]
    assert sum(r.chained for r in far) < 0.5 * len(far)
    assert simhash.verify(df).count() == 1000


def test_a_large_group_of_unlike_codes_by_brute_force(spark):
    """Codes in one key that are near some and far from most of the others."""
    rng = random.Random(5)
    base = rng.getrandbits(64) & ~0xFFFFFF
    codes = sorted({base | rng.getrandbits(24) for _ in range(700)})
    prints = spark.createDataFrame([(i, _signed(c)) for i, c in enumerate(codes)], "doc_id long, code long")
    got = {r.code: r.component_id for r in simhash.groups(prints).collect()}
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(codes)), 2):
        if (codes[i] ^ codes[j]).bit_count() <= 3:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    assert got == {_signed(c): find(i) for i, c in enumerate(codes)}


def test_unlike_codes_of_a_key_are_no_rows(spark, monkeypatch):
    """Small keys are paired off in one join whose condition drops the unlike; no further rounds."""
    rng = random.Random(6)
    base = rng.getrandbits(64) & ~0xFFFFFFFF
    codes = sorted({base | rng.getrandbits(32) for _ in range(100)})
    prints = spark.createDataFrame([(i, _signed(c)) for i, c in enumerate(codes)], "doc_id long, code long")
    seen = []
    verify = simhash.verify
    monkeypatch.setattr(simhash, "verify", lambda pairs: seen.append(pairs.count()) or verify(pairs))
    simhash.groups(prints).collect()
    near = sum((a ^ b).bit_count() <= 3 for a, b in itertools.combinations(codes, 2))
    assert seen == [near]


# ------------------------------------------------------------------ filter audit

def expected_audit(rows, labels):
    failed, first = [], {}
    for doc_id, value, _, source in rows:
        t = value or ""
        if doc_id is not None:
            first[t] = min(doc_id, first.get(t, doc_id))
    for doc_id, value, _, source in rows:
        t = value or ""
        w = SOLID.findall(t)
        out = set()
        if len(w) < 50:
            out.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            out.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            out.add("C")
        if re.search(r"[#$%&*|]", t):
            out.add("D")
        if doc_id is not None and doc_id > first[t]:
            out.add("E")
        good = any(d == doc_id and q == 1 for d, q, _ in labels if d is not None)
        toxic = any(d == doc_id and x == 1 for d, _, x in labels if d is not None)
        failed.append((source or "", out, good, toxic))
    want = []
    for part in {f[0] for f in failed}:
        mine = [f[1:] for f in failed if f[0] == part]
        shapley = Counter()
        lines = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                fails = sum(f in d[0] for d in mine)
                lines.append((part, order, step, f, len(left), len(gone), fails - len(gone),
                              sum(d[0] == {f} for d in mine), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        want += [(*ln[:3], *ln[4:], shapley[ln[3]]) for ln in lines]
    return want


def audited(spark, documents, rows, labels):
    fields = T.StructType([f for f in DOCS.fields if f.name != "n_chars"] + [T.StructField("mask", T.StringType())])
    df = spark.createDataFrame([(*r, "clash") for r in rows], fields).repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.report(df, told)
    assert got.columns == ["part", "filter_order", "step", *audit.COUNTS]
    return sorted(tuple(r) for r in got.collect())


def test_audit_by_brute_force(spark, documents, rows):
    rng = random.Random(2)
    sources = ["a", "b", None, ""]
    full = [(d, t, lang, rng.choice(sources)) for d, t, lang in rows]
    labels = [(d, rng.randrange(2), rng.randrange(2)) for d, *_ in rows if d is not None and rng.random() < 0.6]
    labels += [(None, 1, 1), (rows[20][0], 1, None), (rows[20][0], 0, 1), (10**9, 1, 1)]
    assert audited(spark, documents, full, labels) == sorted(expected_audit(full, labels))


def test_audit_of_empty_tables(spark, documents):
    assert audited(spark, documents, [], []) == []
    assert audited(spark, documents, [(1, "x", "en", "s")], []) == sorted(expected_audit([(1, "x", "en", "s")], []))


def test_fields_do_not_overflow():
    """Counts next to each other at the size of a whole long stay apart."""
    integers = audit.packed("ABC")
    most = (1 << 62) - 1
    total = sum(most * i for i in (integers[1], integers[2]))
    got = audit.unpacked(total, "ABC")
    for o, order in enumerate(audit.orders("ABC")):
        assert got[o].tolist() == [most if f in "AB" else 0 for f in order]
