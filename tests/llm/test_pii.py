import hashlib
import random
import re

from helpers import clashing
from helpers import odd as odd_rows

from quadra.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and plain_luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def plain_luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    out = []
    for k, (_, pattern, ok) in enumerate(BASE):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(out)


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(5)
    pool = ["a", "B", "0", "1", "25", "255", "256", "4111111111111111", "4111 1111 1111 1111", ".", "..", "@", "-", "_", "+", "(", ")", " ", "é", "\n", "x.y", "%", "a@b.c", "1.2.3.4", "+1 (200) 555-0100"]
    for _ in range(6000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_stay_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "." * 300_000 + "@b"):
        pii.base_spans(text)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"please write to our desk at u{i}@mail.example for help", "en", "s", 0) for i in range(6)]
    rows += [(10, "please write to our desk at k77-desk-9 for help", "en", "s", 0), (11, "the year 2024x was good", "en", "s", 0), (12, None, "en", "s", 0), (13, "", "en", "s", 0)]
    out = {r.doc_id: r for r in pii.digest(frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    assert out[10].spans == "email:28:38" and out[10].n_email == 0 and out[10].n_added == 1
    assert out[11].spans == "" and out[12].spans == "" and out[13].base_sha256 == hashlib.sha256(b"").hexdigest()
    text = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert text[10] == "please write to our desk at [EMAIL] for help" and text[0] == text[10] and text[12] is None


def by_hand(texts, rounds, accept, support=2):
    """Discovered (row, start, end), with scores computed plainly over the pattern-instance graph."""
    met, totals = [], {}
    for row, text in enumerate(texts):
        words = [m.span() for m in re.finditer(r"[^ ]+", text)]
        low = [text[a:b].lower() for a, b in words]
        for k, w in enumerate(low):
            for gram in ((w,), tuple(low[k - 1 : k + 1])):
                totals[gram] = totals.get(gram, 0) + (len(gram) < 2 or k > 0)
        base = brute(text)
        spans = [(s, e, True) for s, _, e in base]
        spans += [(a, b, False) for a, b in words if b - a >= 5 and re.search("[0-9@]", text[a:b]) and not any(s < b and e > a for s, _, e in base)]
        for s, e, seed in spans:
            k = next(i for i, (a, b) in enumerate(words) if a <= s < b)
            j = next(i for i, (a, b) in enumerate(words) if a < e <= b)
            around = [(0, tuple(low[k - n : k])) for n in (1, 2) if k >= n] + [(1, tuple(low[j + 1 : j + 2]))] * (j + 1 < len(low))
            met += [(p, text[s:e].replace(" ", ""), seed, (row, s, e)) for p in around]
    patterns = {p for p, *_ in met if len({m[1] for m in met if m[0] == p}) >= support}
    seeds = {m[1] for m in met if m[2]}
    score = {m[1]: float(m[1] in seeds) for m in met}
    for _ in range(rounds):
        hits = {p: sum(score[m[1]] for m in met if m[0] == p) for p in patterns}
        size = {p: sum(m[0] == p for m in met) for p in patterns}
        for i in score:
            score[i] = max([hits[m[0]] / (size[m[0]] + 1) for m in met if m[1] == i and m[0] in patterns] + [0.0]) if i not in seeds else 1.0
    good = {p for p in patterns if hits[p] / max(size[p], totals[p[1]]) >= accept}
    return {m[3] for m in met if m[0] in good and not m[2]}


def test_patterns_met_through_discovered_instances(spark):
    """Keys stand after "key =" only, where no seed does; what vouches for them is the word after, which seeds have too. Numbers in running text stay."""
    rng = random.Random(2)
    plain = ["of", "the", "and", "to", "in", "was", "with", "for"]
    texts, planted = [], set()
    for row in range(160):
        words = [rng.choice(plain) for _ in range(30)]
        if row % 2:
            words[10] = f"u{row}@mail.example"
        if row % 4 == 0:
            words[12:15] = ["key", "=", f"k{row:05d}zz"]
        if row % 32 == 2:
            words[20] = f"{row}00000"
        texts.append(" ".join(words))
        if row % 4 == 0:
            at = texts[-1].index(words[14])
            planted.add((row, at, at + len(words[14])))
    out = pii.search(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()
    found = {(r.doc_id, s, e) for r in out for s, _, e in pii.parse_spans(r.added)}
    assert found == by_hand(texts, 8, 0.5)
    assert found == planted, "precision and recall of 1"


def test_words_and_contexts_of_any_length():
    text = "x" * 100_000 + " call " + "y" * 70_000 + "7 " + "1.2.3.4," * 20_000
    own = list(pii._occurrences(text, pii.base_spans(text)))
    assert sum(k == 1 for _, _, k, *_ in own) == 20_000
    assert [(e - s, left[-4:], right) for s, e, k, left, right in own if k < 0] == [(70_001, "call", "1.2.3.4," * 20_000)]
    assert all(left == text[100_001:].split(" 1")[0] for _, _, k, left, _ in own if k == 1)


def test_discoveries_on_a_table(spark):
    """Every key written as token = "..." is found, and numbers in running text are left alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    keys, added, wrong = set(), set(), 0
    for r in rows.values():
        keys |= {(r.doc_id, m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-fA-F]{40})"', r.text or "", re.IGNORECASE)}
    for r in pii.search(docs).collect():
        for s, _, e in pii.parse_spans(r.added):
            added.add((r.doc_id, s, e))
            wrong += (r.doc_id, s, e) not in keys
    assert keys and added >= keys and wrong <= 0.1 * len(keys)


def test_digest_on_a_table_and_odd_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = frame(spark, [(None, "a@b.cc", "x", "y", 1), (None, None, None, None, None), (7, "same 10.0.0.1", "x", "y", 1), (7, "same 10.0.0.1", "x", "y", 1), (7, "other +1 200 555 0100", "x", "y", 1)])
    both = docs.unionByName(odd)
    out = pii.digest(both).toPandas()
    rows = both.collect()
    assert len(out) == len(rows)
    want = sorted((r.doc_id if r.doc_id is not None else -1, hashlib.sha256(",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in brute(r.text or "")).encode()).hexdigest()) for r in rows)
    got = sorted((-1 if d != d else int(d), h) for d, h in zip(out.doc_id, out.base_sha256, strict=True))
    assert got == want
    assert pii.digest(frame(spark, [])).count() == 0
    kept = pii.redact(clashing(both))
    assert kept.columns == clashing(both).columns and kept.count() == len(rows)
    assert pii.digest(clashing(odd_rows(spark))).count() == 10
