import hashlib
import random

from helpers import clashing, documents, frame, mirror_words, odd
from pyspark.sql import functions as F

from quadra.llm import embedding_dedup, hamming_search, simhash, substring_dedup
from quadra.llm.text import bucket_of


def groups_of(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_planes_agree_with_brute_force():
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for _ in range(6):
            w = v
            for _ in range(rng.randint(1, 4)):
                w ^= 1 << rng.randrange(64)
            values.append(w)
    values = list(dict.fromkeys(values))
    for radius in (0, 1, 2, 3):
        want = groups_of([(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= radius], range(len(values)))
        assert groups_of(simhash.linked(values, radius), range(len(values))) == want
        half = len(values) // 2
        within = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= radius and (j < half <= i)]
        assert groups_of(simhash.linked(values[:half], radius, values[half:]), range(len(values))) == groups_of(within, range(len(values)))
    planes = simhash.Planes(values)
    for q in values[:30]:
        for radius in range(6):
            assert [i for i in range(len(values)) if planes.near(q, radius) >> i & 1] == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= radius]


def test_fingerprint_by_hand():
    import xxhash

    votes = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d", b"c d e")]
    want = sum(1 << b for b in range(64) if sum(v >> b & 1 for v in votes) * 2 > 3)
    assert simhash.fingerprint("A b\tC  d e") == want
    assert simhash.fingerprint("one Two") == xxhash.xxh64_intdigest(b"one two", 42) and simhash.fingerprint(" ") == 0


def test_simhash_groups(spark, data):
    docs = documents(spark, data, 200).unionByName(odd(spark)).unionByName(frame(spark, [(7000, "alpha beta gamma delta " * 30), (7001, "alpha beta gamma delta " * 30 + "x")]))
    rows = docs.collect()
    out = simhash.near_duplicates(clashing(docs)).collect()
    prints = [simhash.fingerprint(r.text) for r in rows]
    assert sorted((r.doc_id or -1, int(r.fingerprint, 16)) for r in out) == sorted((r.doc_id or -1, p) for r, p in zip(rows, prints, strict=True))
    distinct = sorted(set(prints))
    same = groups_of([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2], distinct)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r.doc_id is not None:
            least[same[p]] = min(least.get(same[p], r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(same[int(r.fingerprint, 16)]) for r in out)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_chains_through_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: docs.select("doc_id", F.col("n_chars").alias("fp")))
    rows = [(5, None, None, None, 0), (None, None, None, None, 3), (4, None, None, None, 15), (3, None, None, None, 127 << 40)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert {r.doc_id: r.component_id for r in out} == {5: 4, None: 4, 4: 4, 3: 3}


def test_large_keys_are_compared_in_parts(spark):
    """Keys of many fingerprints, 40 members at most in a part."""
    rng = random.Random(8)
    values = set()
    while len(values) < 900:
        v = rng.getrandbits(20)
        values |= {v, v ^ (1 << rng.randrange(20)), v ^ (3 << rng.randrange(19))}
    values = sorted(values)
    want = groups_of([(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2], values)
    for large in (40, 8192):
        found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, large).collect()
        assert all((r.src ^ r.dst).bit_count() <= 2 for r in found)
        assert groups_of([(r.src, r.dst) for r in found], values) == want


def test_six_thousand_fingerprints_by_planes():
    rng = random.Random(9)
    values = list({rng.getrandbits(21) for _ in range(6100)})
    assert len(values) > 6000
    known, want = {v: i for i, v in enumerate(values)}, []
    for v, i in known.items():
        near = [v ^ (1 << b) for b in range(21)] + [v ^ (1 << b) ^ (1 << c) for b in range(21) for c in range(b)]
        want += [(i, known[w]) for w in near if w in known]
    assert groups_of(simhash.linked(values, 2), range(len(values))) == groups_of(want, range(len(values)))


def substring_by_hand(rows, size=20):
    seen, out = {}, []
    for r in sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id):
        words = (r.text or "").encode().split()
        for i in range(len(words) - size + 1):
            seen.setdefault(b" ".join(words[i : i + size]), (r.doc_id, i))
    for r in rows:
        words = (r.text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - size + 1) if r.doc_id is not None else ():
            if seen[b" ".join(words[i : i + size])] != (r.doc_id, i):
                gone[i : i + size] = [True] * size
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((r.doc_id if r.doc_id is not None else -1, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, data):
    passage = " ".join(f"p{k}" for k in range(60))
    more = [(8000, f"start here {passage} end"), (8001, f"{passage} and {passage}"), (8002, " ".join(f"p{k}" for k in range(19))), (8003, "x " + " ".join(f"p{k}" for k in range(7, 29)) + " y"), (8004, "tick " * 70), (8005, "a\x1cb c " * 25)]
    docs = documents(spark, data, 200).unionByName(odd(spark)).unionByName(frame(spark, more))
    rows = docs.collect()
    out = substring_dedup.digest(clashing(docs)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in out) == substring_by_hand(rows)
    text = {r.doc_id: r for r in substring_dedup.rewrite(clashing(docs)).collect()}
    assert text[8001].text == "and" and text[8000].text == more[0][1] and text[8003].text == "x y" and text[8001].payload == "x"
    assert substring_dedup.digest(frame(spark, [])).count() == 0
    assert substring_dedup.digest(docs.withColumn("doc_id", F.col("doc_id").cast("int"))).count() == len(rows)


def test_small_chunks_and_groups_give_the_same(spark, data):
    docs = documents(spark, data, 200)
    want = sorted(map(tuple, substring_dedup.digest(docs).collect()))
    assert sorted(map(tuple, substring_dedup.digest(docs, chunk=500, group_bytes=20_000).collect())) == want
    assert sum(r[2] for r in want)


def test_words_that_sums_of_powers_confuse_are_no_repeat(spark):
    first, second = mirror_words()
    same = " ".join(f"s{k}" for k in range(19))
    out = substring_dedup.digest(frame(spark, [(1, f"{same} {first}"), (2, f"{same} {second}"), (3, f"{same} {first}")])).collect()
    assert {r.doc_id: r.n_removed for r in out} == {1: 0, 2: 0, 3: 20}


def test_bucket_is_sparks(spark):
    import numpy as np

    ids = [0, 1, -1, 7, 2**62, -(2**63), 123456789]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(F.pmod(F.xxhash64("id"), F.lit(97))).collect()]
    assert got == bucket_of(np.array(ids), 97).tolist()


def vectors(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        v = [rng.gauss(0, 1) for _ in range(16)]
        rows.append((len(rows), v, k % 3))
        for scale in (0.01, 0.05, 0.08)[: k % 4]:
            rows.append((len(rows), [x + rng.gauss(0, scale) for x in v], k % 3))
    base = rows[5][1]
    rows += [(len(rows) + k, base, rows[5][2]) for k in range(20)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1), (2004, base, None), (2005, [], 1), (2006, [float("inf")] + [1.0] * 15, 1), (2007, [-0.0, *base[1:]], 2), (2008, [2 * x for x in base], rows[5][2])]
    return rows


def test_embedding_links(spark):
    rows = vectors(spark)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("x"))
    import numpy as np

    able = {i: np.array(v) / np.linalg.norm(v) for i, v, label in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: lab for i, _, lab in rows}
    links = [(a, b) for a in able for b in able if a < b and label[a] == label[b] and able[a] @ able[b] >= 0.98]
    same = groups_of(links, [i for i, _, _ in rows])
    count = dict.fromkeys(same, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    for cell in (1024, 40):
        out = embedding_dedup.near_duplicates(df, cell=cell).collect()
        assert len(out) == len(rows)
        found = sum(r.n_links for r in out)
        assert found >= 0.98 * sum(count.values()) and all(r.n_links <= count[r.vec_id] for r in out)
        assert sum(r.component_id == same[r.vec_id] for r in out) >= 0.98 * len(out) and all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_that_share_an_id_or_have_none(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(7, a, "x"), (7, b, "x"), (9, [2.0, 0.001, 0.0, 0.0], "x"), (3, [0.001, 1.0, 0.0, 0.0], "x"), (None, [1.0, 0.002, 0.0, 0.0], "x"), (None, a, "y"), (None, None, "x"), (5, a, "y")]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=str)
    assert got == sorted([(7, 2, 7, True), (7, 1, 3, False), (9, 2, 7, False), (3, 1, 3, True), (None, 2, 7, False), (None, 1, 5, False), (None, 0, None, True), (5, 1, 5, True)], key=str)


def test_collision_counts_find_pairs_at_the_threshold():
    """Pairs of cosine 0.98 exactly, in few and in many dimensions."""
    import numpy as np

    rng = np.random.default_rng(4)
    for dim in (2, 3, 8, 64, 768):
        a, b = rng.standard_normal((2, 2000, dim))
        a /= np.linalg.norm(a, axis=1)[:, None]
        b -= np.einsum("ij,ij->i", a, b)[:, None] * a
        b /= np.linalg.norm(b, axis=1)[:, None]
        b = 0.9800001 * a + np.sqrt(1 - 0.9800001**2) * b
        d = embedding_dedup.directions(dim)
        reach, needed = embedding_dedup.calibrate(dim, 0.98, 0.999, embedding_dedup.LISTS)
        assert needed > 0
        found = set()
        for qi, ti in embedding_dedup._pairs(a @ d, a, b @ d, b, 0.98, reach, needed):
            found |= {q for q, t in zip(qi.tolist(), ti.tolist(), strict=True) if q == t}
        assert len(found) >= 1990, (dim, len(found))


def test_hamming_search(spark):
    rng = random.Random(9)
    rows = [(k, [rng.gauss(0, 1) for _ in range(64)]) for k in range(400)] + [(500, None), (501, []), (502, [None] * 64), (None, [1.0] * 64)]
    rows += [(600 + k, rows[3][1]) for k in range(15)]
    codes = hamming_search.codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit("x")))
    bits = {i: sum(1 << b for b, x in enumerate(v) if (x or 0) > 0) for i, v in rows if v and i is not None}
    got: dict = {}
    for r in hamming_search.top_k(codes, codes.where("id % 50 = 0 or id = 3"), 10).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.distance, r.neighbor_id))
    want = {q: [(k + 1, d, i) for k, (d, i) in enumerate(sorted(((bits[q] ^ c).bit_count(), i) for i, c in bits.items() if i != q)[:10])] for q in bits if q % 50 == 0 or q == 3}
    assert {q: sorted(v) for q, v in got.items()} == want
    assert hamming_search.top_k(codes.limit(0), codes, 3).count() == 0


def test_hamming_search_over_many_blocks(spark):
    """Frequent segment values, cut blocks, ids with several codes, copies, against brute force."""
    rng = random.Random(12)
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    rows = [(i, rng.getrandbits(64)) for i in range(900)]
    rows += [(1000 + i, rng.getrandbits(48) << 16 | 0x1234) for i in range(500)]  # a third share one segment
    rows += [(2000 + i, rows[0][1]) for i in range(60)] + [(3000 + i, rows[0][1] ^ 1 << rng.randrange(64)) for i in range(30)]
    rows += [(7, rng.getrandbits(64)) for _ in range(30)] + [(8, rows[8][1] ^ 1 << i) for i in range(20)] + [rows[9]] * 15
    df = spark.createDataFrame([(i, signed(c)) for i, c in rows], "id long, code long")
    ask = {0, 7, 8, 9, 50, 1000, 1050, 2001, 3001}
    want = {}
    for i in ask:
        own = {c for j, c in rows if j == i}
        if len(own) == 1:
            (code,) = own
            want[i] = [(r + 1, d, j) for r, (d, j) in enumerate(sorted(((code ^ c).bit_count(), j) for j, c in rows if j != i)[:10])]
    for size in (16384, 100):
        got: dict = {}
        for r in hamming_search.top_k(df, df.where(F.col("id").isin(sorted(want))), 10, block_rows=size).collect():
            got.setdefault(r.vec_id, []).append((r.rank, r.distance, r.neighbor_id))
        assert {q: sorted(v) for q, v in got.items()} == want
    one = spark.createDataFrame([(8, signed(rows[8][1]))], "id long, code long")
    got = sorted((r.rank, r.distance, r.neighbor_id) for r in hamming_search.top_k(df, one, 10).collect())
    assert got == [(r + 1, d, j) for r, (d, j) in enumerate(sorted(((rows[8][1] ^ c).bit_count(), j) for j, c in rows if j != 8)[:10])]
