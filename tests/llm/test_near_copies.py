import random

import corpus_pipeline
from helpers import clashing, frame, odd

from quadra.llm import near_copies


def jaccard(a, b):
    cut = lambda t: {" ".join(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))}
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


def edited(rng, n=25):
    """Texts, and copies of them with more and more words changed."""
    words = [f"w{k}" for k in range(3000)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(100, 400))]
        out.append(" ".join(base))
        for changed in (0.004, 0.01, 0.015, 0.02, 0.03, 0.06):
            out.append(" ".join(rng.choice(words) if rng.random() < changed else w for w in base))
    return out


def groups(texts, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and jaccard(texts[i], texts[j]) >= 0.8:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_stage_against_brute_force(spark):
    texts = edited(random.Random(4))
    docs = clashing(frame(spark, list(enumerate(texts))))
    want = sorted(set(groups(texts, range(len(texts))).values()))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, None)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_pairs_that_miss_the_head_of_a_key(spark):
    """A chain: only neighbours are similar, whichever of them the others are compared with first."""
    words = [f"c{k}" for k in range(500)]
    texts = [" ".join(words[k : k + 200]) for k in range(0, 200, 18)]
    kept = near_copies.first_of_group(frame(spark, list(enumerate(texts)))).collect()
    assert [r.doc_id for r in kept] == [0] and jaccard(texts[0], texts[1]) >= 0.8 > jaccard(texts[0], texts[2])


def test_odd_rows(spark):
    kept = near_copies.first_of_group(odd(spark)).collect()
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
    assert sorted(set(ids)) == [9001, 9004, 9005, 9006] and sum(r.doc_id is None for r in kept) == 2
    assert near_copies.first_of_group(frame(spark, [])).count() == 0
    few = frame(spark, [(1, "a b c"), (2, "A  b\tc"), (3, "a b d")])
    assert sorted(r.doc_id for r in near_copies.first_of_group(few).collect()) == [1, 3]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (2, "quite another text of the same id"), (3, "one"), (3, "two"), (4, "same"), (4, "same"), (4, "SAME")]
    kept = near_copies.first_of_group(clashing(frame(spark, rows))).collect()
    got = sorted((r.doc_id, (r.text or "").lower()) for r in kept)
    assert got == [(1, rows[0][1]), (2, rows[2][1]), (3, "one"), (3, "two"), (4, "same")]


def test_large_groups_in_parts(spark):
    """Many texts under the same keys, of several components, with parts of three members."""
    rng, texts = random.Random(12), []
    common = [f"c{k}" for k in range(120)]
    for k in range(30):
        words = list(common)
        at = rng.randrange(60)
        words[at : at + 6 + k % 20] = [f"x{k // 3}y{j}" for j in range(6 + k % 20)]
        texts.append(" ".join(words))
    docs = frame(spark, list(enumerate(texts)))
    prints = near_copies.sketches(docs)
    fp = {r.doc_id: r.fp for r in prints.collect()}
    want = groups(texts, range(len(texts)))
    assert 1 < len(set(want.values())) < len(texts)
    for large in (3, 8192):
        found = {r.node: r.component for r in near_copies.classes(docs, prints, large=large).collect()}
        same = {}
        for i in range(len(texts)):
            assert same.setdefault(want[i], found.get(fp[i], fp[i])) == found.get(fp[i], fp[i])
        assert len(set(same.values())) == len(same)


def test_fingerprints_are_within_the_radius():
    import numpy as np
    import pyarrow as pa

    rng, far = random.Random(6), []
    for _ in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((8, 9, 12, 30, 120)))]
        copy = base[:-1] if len(base) < 30 else base[: -(len(base) // 6)]
        found, begins = near_copies._shingles(pa.array([" ".join(base), " ".join(copy)]), 5)
        if jaccard(" ".join(base), " ".join(copy)) >= 0.8:
            x, y = near_copies._bits(found, begins, np.arange(2)).tolist()
            far.append((x ^ y).bit_count())
    assert len(far) > 200 and max(far) <= near_copies.RADIUS


def test_pairs_come_through_planes_as_forests(spark):
    """Many texts that are near, yet mostly not similar: what is sent grows with the texts, not with their pairs; pairs of two are compared alike."""
    rng, texts = random.Random(3), []
    common = [f"c{k}" for k in range(146)]
    for k in range(200):
        words = list(common)
        for _ in range(4 if k % 4 else 1):
            words[rng.randrange(len(words))] = f"x{k}y{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = frame(spark, list(enumerate(texts)))
    prints = near_copies.sketches(docs)
    nodes = prints.select("fp", "n", "bits", "keys")
    sent = near_copies._candidates(nodes, 0.8, 8192).count()
    assert 0 < sent < near_copies.BANDS * len(texts)
    want = groups(texts, range(len(texts)))
    found = {r.node: r.component for r in near_copies.classes(docs, prints).collect()}
    fp = {r.doc_id: r.fp for r in prints.collect()}
    same = {}
    for i in range(len(texts)):
        assert same.setdefault(want[i], found.get(fp[i], fp[i])) == found.get(fp[i], fp[i])
    assert 1 < len(set(same.values())) == len(same) < len(texts)
    far = (1 << near_copies.RADIUS + 1) - 1
    for bits, pairs in ((far, 0), (far >> 1, 1)):
        two = spark.createDataFrame([(1, 9, 0, [7]), (2, 9, bits, [7])], "fp long, n long, bits long, keys array<long>")
        assert near_copies._candidates(two, 0.8, 8192).count() == pairs
