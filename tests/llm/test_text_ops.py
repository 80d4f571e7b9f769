import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import clashing, documents, frame, mirror_words, odd

from quadra.llm import packing, pitman_yor, sentencepiece_codec, token_orc, tokens, toxicity
from quadra.runtime import scratch_path

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def strings(n, pool, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_word_encoder_is_the_library():
    own = tokens.Encoder(WORD)
    fixed = ["İstanbul ÀÉ ÿŸ ß ẞ", "<|endoftext|> x <|ENDOFTEXT|> a<|startoftext|>b", "don't can'T we'll i'd 's' 're", "1234 ½ ²x", "é ́a Å", "a b \x1c c\x85d", "ΣΑΣ", "🙂 zero​width", "", " \n", "x" * 500, "ª º µ × ÷", "Ⅷ ٣"]
    for text in fixed + strings(1500, list("aAéÉß'sStTdDlLmMrReEvV19 \t.,|<>_-́İ日½🙂 "), 3):
        assert own.encode(text.encode()).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_streaming_viterbi_is_the_library():
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), sentencepiece_codec.Codec(PIECE)
    fixed = [" ", " a", "a ", "  ", "", " x  y   z", " " * 40 + "b" + " " * 33, "x" * 9000, "thequickbrownfox" * 300, "日" * 300, "a▁b", "\x00"]
    for text in fixed + strings(1500, [*"aeiouthsn  \n\t.,|é日½🙂▁<>0129_-", "  ", "   ", "the", "ing", " " * 17], 4):
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text), text
        assert own.decode(ids) == text.replace("▁", " ")


def test_runs_of_spaces_are_the_library():
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), sentencepiece_codec.Codec(PIECE)
    for n in [*range(1, 80), 127, 1000, 4099]:
        for text in (" " * n, " " * n + "word", "a" + " " * n + "b" + " " * (n + 1)):
            assert own.encode(text).tolist() == library.encode(text), n
    ids = own.encode("x" + " " * 1_000_000 + "y")  # in time that is linear in the run
    assert own.decode(ids) == "x" + " " * 1_000_000 + "y"


def test_viterbi_window_is_bounded():
    own = sentencepiece_codec.Codec(PIECE)
    walk, ids, text = sentencepiece_codec.Viterbi(own.v), [], "thequickbrownfoxjumps" * 2000
    for k in range(0, len(text), 7):
        ids += walk.feed(text[k : k + 7])
    assert ids + walk.finish() == own._stretch(text) and walk.open < 400


def test_sentencepiece_tables(spark, data):
    docs = documents(spark, data).unionByName(odd(spark))
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(clashing(docs), PIECE), PIECE).collect()
    assert sorted(r.text for r in out) == sorted((r.text or "") for r in docs.collect())
    assert sentencepiece_codec.digest(frame(spark, []), PIECE).count() == 0


def test_fullest_against_all_subsets():
    rng = random.Random(6)
    for _ in range(200):
        counts = collections.Counter(rng.randint(1, 30) for _ in range(rng.randint(0, 9)))
        room = rng.randint(0, 80)
        chosen = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert not collections.Counter(chosen) - counts and sum(chosen) <= room
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums if s + x <= room}
        assert sum(chosen) == max(sums)


def test_packing(spark, data):
    docs = documents(spark, data, 200).unionByName(odd(spark))
    own = tokens.Encoder(WORD)
    want = []
    for r in docs.collect():
        ids = [*own.encode((r.text or "").encode()).tolist(), 0]
        want += [(-1 if r.doc_id is None else r.doc_id, k, a, len(ids[a : a + 2048]), tokens.crc(np.array(ids[a : a + 2048]))) for k, a in enumerate(range(0, len(ids), 2048))]
    out = packing.pack(clashing(docs), WORD, ids=True)
    rows = out.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(w[3] for w in want) // 2048)
    assert len(bins) <= least + max(1, least // 100)
    whole = packing.sequences(out).collect()
    assert len(whole) == len(bins) and max(len(r.input_ids) for r in whole) <= 2048
    assert packing.pack(frame(spark, []), WORD).count() == 0


def test_token_orc(spark, data):
    docs = documents(spark, data, 200).unionByName(odd(spark))
    path = scratch_path(spark, "test-orc")
    token_orc.write(clashing(docs), WORD, path)
    own, at, want = tokens.Encoder(WORD), 0, []
    rows = [(r.doc_id, [*own.encode((r.text or "").encode()).tolist(), 2]) for r in docs.collect()]
    out = token_orc.digest(spark, path).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == sorted((-1 if d is None else d, len(i), tokens.crc(np.array(i))) for d, i in rows)
    ordered = sorted(out, key=lambda r: r.start)
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in ordered if r.doc_id is not None]
    assert ids == sorted(ids)
    one = token_orc.read(spark, path).where("doc_id = 17").collect()
    assert [r.ids for r in one] == [i for d, i in rows if d == 17]
    from pathlib import Path

    from pyarrow import orc

    files = [f for f in (orc.ORCFile(p) for p in sorted(Path(path.removeprefix("file:")).glob("*.orc"))) if f.nrows]
    for f in files:  # version 0.12 is run-length encoding 2
        assert f.row_index_stride == 1000 and str(f.file_version) == "0.12" and str(f.compression).lower() == "zstd"
        t = f.read()
        want.append(([(d, len(i)) for d, i in zip(t["doc_id"].to_pylist(), t["ids"].to_pylist(), strict=True)]))
    in_files = [x for part in sorted(want, key=lambda p: -1 if p[0][0] is None else p[0][0]) for x in part]
    assert [(r.doc_id, r.n_tokens) for r in ordered] == in_files, "start is the place in the files, also of repeated ids"


def test_pitman_yor_counts_and_perplexity(spark, data):
    docs = documents(spark, data, 200)
    both = docs.unionByName(odd(spark))
    out = pitman_yor.digest(clashing(both)).collect()
    rows = [(r.doc_id, [*(r.text or "").encode().lower().split(), None]) for r in both.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = collections.Counter(w for d, ws in rows if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if d is None else d, len(ws), sum(count[w] > 0 for w in ws), sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in out)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9)
    assert all(r.held_out == held(r.doc_id) and r.train_tokens == n for r in out)
    out = {r.doc_id: r for r in out if r.doc_id is not None}
    for part in (True, False):
        own = [r for d, r in out.items() if r.held_out is part and d < 9000]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert pitman_yor.digest(frame(spark, [])).count() == 0


def test_predictive_probabilities_sum_to_one(spark, data):
    """Over all words and the unknown, in any context."""
    docs = documents(spark, data, 40)
    model = pitman_yor.fit(docs)
    states = [pitman_yor.State.unpack(bytes(r.state)) for r in model.state.collect()]
    for context in (0, 1, 77, 500, 1024):
        total = pitman_yor.probabilities(None, np.array([-1]), np.array([context]), model.samples, model.words, model.settings)[0]
        for x in states:
            total += pitman_yor.probabilities(x, np.arange(len(x.words)), np.full(len(x.words), context), model.samples, model.words, model.settings).sum()
        assert total == pytest.approx(1, abs=1e-9)


def test_scores_do_not_depend_on_partitions(spark, data):
    docs, found = documents(spark, data, 60), []
    for n in ("3", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, pitman_yor.digest(docs).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_unseen_words_are_unknown_whatever_sums_of_powers_say(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    other = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 != 2)
    first, second = mirror_words()
    out = {r.doc_id: r for r in pitman_yor.digest(frame(spark, [(other, first), (held, second)])).collect()}
    assert out[held].held_out and out[held].n_known == 1 and out[other].n_known == 2


def test_log_gamma():
    for x in (0.01, 0.25, 0.7, 1.0, 3.3, 50.5, 12345.25):
        assert pitman_yor.log_gamma(np.array([x]))[0] == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-10)


def test_seating_is_the_chinese_restaurant_process():
    """Against seating one by one: means over many cells, for few and for thousands of customers."""
    rng = np.random.default_rng(0)
    for c, weight, cells in ((2, 0.5, 20_000), (7, 2.0, 20_000), (300, 0.3, 4000), (3000, 6.0, 400)):
        keys = rng.integers(0, 1 << 63, cells).astype(np.uint64)
        t = pitman_yor.seat(np.full(cells, c), np.full(cells, weight), 0.75, keys, 1)
        plain = np.ones(cells)
        for seated in range(1, c):
            plain += rng.random(cells) < weight / (seated - 0.75 * plain + weight)
        assert (t >= 1).all() and (t <= c).all()
        assert t.mean() == pytest.approx(plain.mean(), abs=5 * (t.std() + plain.std()) / math.sqrt(cells) + 1e-9)
        assert t.std() == pytest.approx(plain.std(), rel=0.2)


def labelled(spark, n=400):
    rng = random.Random(8)
    neutral, rude = [f"word{k}" for k in range(200)], ["vileterm", "nastyterm"]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(neutral) for _ in range(40)]
        toxic = k % 4 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(rude)
        if toxic and k % 8 == 0 or k % 29 == 0:
            words[rng.randrange(39)] = "muslim"
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_and_group_mentions(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    model = toxicity.fit(clashing(docs), toxicity.learning(labels))
    out = toxicity.digest(clashing(docs.unionByName(odd(spark))), model).collect()
    held = [r for r in out if r.held_out and r.doc_id in truth]
    words = {r.doc_id: r.text.split() for r in docs.collect()}
    sure = [r for r in held if truth[r.doc_id] == int(any(w in ("vileterm", "nastyterm") for w in words[r.doc_id]))]
    assert len(sure) > 40 and sum(r.predicted == truth[r.doc_id] for r in sure) >= 0.95 * len(sure)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out) and len(out) == 410
    plain = toxicity.fit(docs, toxicity.learning(labels), fairness=0.0)
    assert model.swaps > 50
    mentions = frame(spark, [(1, "word1 word2 muslim word3"), (2, "word1 word2 people word3"), (3, "word1 word2 christian word3")])
    fair = [r.score for r in toxicity.digest(mentions, model).collect()]
    unfair = [r.score for r in toxicity.digest(mentions, plain).collect()]
    assert max(fair) - min(fair) < 0.25 * (max(unfair) - min(unfair))
    neutral = frame(spark, [(k, f"word{k % 50} word{k % 47} muslim word{k % 43}") for k in range(200)])
    flagged = [sum(r.predicted for r in toxicity.digest(neutral, m).collect()) for m in (model, plain)]
    assert flagged[0] <= 2 and flagged[1] >= 20, "false positives on neutral mentions, with and without the penalty"
    assert toxicity.accepted(clashing(docs), model).columns == clashing(docs).columns


def test_toxicity_held_out_rows_of_a_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.fit(docs, toxicity.learning(labels))
    pairs = [g for g in model.groups if len(g) == 2]
    assert model.swaps > 1000 and len(pairs) > 3
    held = toxicity.digest(docs, model).where("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in held if r.toxic]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in held if not r.toxic) <= 0.01 * len(held)


def test_swapped_texts_by_hand():
    import pyarrow as pa

    texts = ["the muslimx muslim sat", "jewish and muslim", "nothing here", "jewish jewish"]
    words = toxicity.Words(pa.array(texts), lower=True, letters=True)
    names = {w: tuple(f) for w, f in zip(" ".join(texts).split(), toxicity._features(words).tolist(), strict=True)}
    rows = [set(t.split()) for t in texts]
    one, two = "muslim", "jewish"
    want = {}
    for row in rows:
        for a, b in ((one, two), (two, one)):
            if a in row:
                before, after = ({f for w in r for f in names[w]} for r in (row, row - {a} | {b}))
                change = tuple(sorted([(f, -1) for f in before - after] + [(f, 1) for f in after - before]))
                want[change] = want.get(change, 0) + 1
    row = np.array([r for r, ws in enumerate(rows) for _ in ws])
    found = np.array([names[w] for ws in rows for w in ws])
    assert toxicity._swaps(found, row, {names[w][0]: names[w] for w in (one, two)}, [[names[one][0], names[two][0]]]) == want


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 20)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert all(r.score < 0.5 for r in toxicity.digest(docs, toxicity.fit(docs, some)).collect())
    assert toxicity.digest(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_context_is_the_whole_word_before(spark):
    """Two words that end alike are different contexts, for texts learnt from and for those held out."""
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:4]
    other = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 != 2][:40]
    learnt = [(k, "aathe cat" if i % 2 else "bbthe dog") for i, k in enumerate(other)]
    asked = list(zip(held, ("aathe cat", "aathe dog", "bbthe dog", "bbthe cat"), strict=True))
    out = {r.doc_id: r.score for r in pitman_yor.digest(frame(spark, learnt + asked)).collect()}
    seen, unseen, seen_too, unseen_too = (out[k] for k in held)
    assert seen > unseen + 0.5 and seen_too > unseen_too + 0.5
    assert out[other[1]] == seen and out[other[0]] == seen_too


def test_probabilities_after_a_word_sum_to_one(spark, data):
    """Over all words and the unknown, after frequent words, the start and a word that was never seen."""
    model = pitman_yor.fit(documents(spark, data, 40))
    states = [pitman_yor.State.unpack(bytes(r.state)) for r in model.state.collect()]
    known = np.unique(np.concatenate([x.contexts for x in states]))
    for u in (pitman_yor.START, *known[:5], np.uint64(12345)):
        totals, kind = np.zeros(1 + len(model.samples), np.int64), 7
        for x in states:
            own = x.contexts[x.before] == u
            totals += [x.n[own].sum(), *(t[0][own].sum() for t in x.kept)]
            kind = int(x.kind[x.contexts == u][0]) if (x.contexts == u).any() else kind
        before = lambda size, at: (np.full(size, at), np.full(size, totals[0]), [np.full(size, t) for t in totals[1:]])
        total = pitman_yor.probabilities(None, np.array([-1]), np.array([kind]), model.samples, model.words, model.settings, before(1, -1))[0]
        for x in states:
            size, at = len(x.words), int(np.flatnonzero(x.contexts == u)[0]) if (x.contexts == u).any() else -1
            total += pitman_yor.probabilities(x, np.arange(size), np.full(size, kind), model.samples, model.words, model.settings, before(size, at)).sum()
        assert total == pytest.approx(1, abs=1e-9)


def shuffled(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_what_a_token_sends(spark, data, monkeypatch):
    """Bytes of all exchanges, rows between buckets, and equal results for any number of buckets."""
    docs, found = documents(spark, data, 400), []
    tokens = sum(len((r.text or "").split()) + 1 for r in docs.collect())
    for size in (6 << 20, 1 << 16):
        monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", size)
        before = shuffled(spark)
        found.append(sorted(map(tuple, pitman_yor.digest(docs).collect())))
        if not found[1:]:
            sent = shuffled(spark) - before
    assert found[0] == found[1]
    assert sent < 60 * tokens  # 45 measured; 100 when every sweep moved all cells and every token the hash before it


def test_few_buckets_for_a_small_table_over_many_partitions(spark, data):
    """Buckets send rows to each other: their number follows the text, not the partitions."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert pitman_yor.fit(documents(spark, data, 20)).buckets < 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
