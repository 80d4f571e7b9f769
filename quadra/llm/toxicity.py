"""A toxicity classifier with counterfactual regularisation.

Model. Logistic regression on the presence of words and of word beginnings of four and five bytes (hashed to 2**20 features; those in two sampled rows or more have a weight; a feature's
value grows smoothly with its correlation with the label, so that rare words do not learn the rows by heart). It is fitted in one task from a bounded sample of labelled rows; scoring is one map over whole texts.

Counterfactuals. Identity groups are lists of terms that may stand for one another: those of `groups` (a parameter), and pairs induced from the labelled
texts, namely words that are about as frequent under both labels and are each other's nearest neighbour by the words that stand
beside them. For each sampled text and each group term in it, every other term of the group is put in its place; training adds
`fairness` times the mean squared change of score (in logits) over all these swaps to the loss, so that a group term cannot carry
weight of its own and neutral mentions stay neutral.

Defined cases: null and empty texts are scored by the intercept alone; rows that repeat a doc_id are scored each by
itself; labels that disagree on a doc_id count as toxic; without labels of both kinds every score is the share of toxic labels (0.0
without any); an empty table gives no rows; extra columns, whatever their names, are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadra import runtime
from quadra.llm.text import U, Words, fresh, release, slices

FEATURE_BITS = 20
#: Rows of each label that the fit takes at most (those of smallest hashed doc_id), and the bytes of their texts: rows beyond stay out whole.
SAMPLE, SAMPLE_BYTES = (2000, 4000), 64 << 20
#: A word is a candidate for an induced pair from this share of the rows of either label, within this factor between the labels.
SHARE, BALANCE = 0.02, 2.0
_SKETCH = 128
#: A word whose squared correlation with the label is this has a quarter of the full feature value.
PHI = 0.02
#: Group terms, by language; a swap stays in its list (fixed values).
GROUPS = (
    ("people", "women", "men", "black", "white", "asian", "latino", "gay", "lesbian", "straight", "transgender", "muslim", "jewish", "christian", "hindu", "immigrants", "refugees", "disabled", "deaf", "elderly"),
    ("gens", "femmes", "hommes", "noirs", "blancs", "musulmans", "juifs", "chrétiens", "immigrés", "réfugiés", "handicapés", "gays"),
    ("leute", "frauen", "männer", "schwarze", "weiße", "muslime", "juden", "christen", "flüchtlinge", "behinderte", "schwule"),
    ("gente", "mujeres", "hombres", "negros", "blancos", "musulmanes", "judíos", "cristianos", "inmigrantes", "refugiados", "discapacitados"),
)


def _features(words: Words) -> np.ndarray:
    """For each word three feature numbers: itself, its first four and its first five bytes (itself again if it is no longer)."""
    whole = words.hashes()
    sizes = words.ends - words.starts
    out = [whole]
    for n in (4, 5):
        out.append(np.where(sizes > n, words.hashes(1, most=n) + U(n), whole))
    return (np.stack(out, axis=1) & U((1 << FEATURE_BITS) - 1)).astype(np.int64)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = Words(batch.column("text"), lower=True, letters=True)
        listed = pa.ListArray.from_arrays(pa.array((3 * words.rows).astype(np.int32)), pa.array(_features(words).ravel().astype(np.int32)))
        yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), listed], names=["doc_id", "toxic", "words"])


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    intercept: float
    #: Swapped versions of sampled texts that the loss compared with their originals, and the groups of features they came from.
    swaps: int = 0
    groups: list | None = None

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << FEATURE_BITS)
        out[self.features] = self.weights
        return out


def _constant(share: float) -> Model:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))


def induced(words: np.ndarray, ends: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
    """Pairs of features that are each other's nearest neighbour by their contexts, among those as frequent under both labels.
    words: the features of all rows' words, in order; ends: where each row's words end."""
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    seen = np.unique((row << FEATURE_BITS) | words)
    feature, label = seen & ((1 << FEATURE_BITS) - 1), toxic[seen >> FEATURE_BITS] > 0
    n = [int((toxic <= 0).sum()), int((toxic > 0).sum())]
    share = [np.bincount(feature[label == k], minlength=1 << FEATURE_BITS) / n[k] for k in (False, True)]
    chosen = np.flatnonzero((np.minimum(*share) >= SHARE) & (np.maximum(*share) <= BALANCE * np.minimum(*share)))
    if len(chosen) < 2:
        return []
    place = np.full(1 << FEATURE_BITS, -1)
    place[chosen] = np.arange(len(chosen))
    sketch = np.zeros((len(chosen), 2 * _SKETCH))
    beside = row[1:] == row[:-1]
    for own, other, side in ((words[1:], words[:-1], 0), (words[:-1], words[1:], _SKETCH)):
        at = place[own]
        ok = beside & (at >= 0)
        np.add.at(sketch, (at[ok], side + other[ok] % _SKETCH), 1)
    sketch = np.sqrt(sketch)
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-12)
    near = np.empty(len(chosen), np.int64)
    for a in range(0, len(chosen), 512):
        like = sketch[a : a + 512] @ sketch.T
        like[np.arange(len(like)), np.arange(a, a + len(like))] = -1
        near[a : a + 512] = like.argmax(axis=1)
    first = np.flatnonzero((near[near] == np.arange(len(chosen))) & (np.arange(len(chosen)) < near))
    return [chosen[[k, near[k]]] for k in first.tolist()]


def _swaps(word: np.ndarray, row: np.ndarray, own: dict[int, tuple], groups: list[list[int]]) -> dict[tuple, int]:
    """How many texts change in the same way: {((feature, +1 or -1), ...): texts} over all swaps of one group term for another.
    word, row: the distinct words of each row, three features each; own: the three features of each group term."""
    other: dict[int, set[int]] = {}
    for group in groups:
        for t in group:
            other.setdefault(t, set()).update(x for x in group if x != t)
    touched = np.zeros(1 << FEATURE_BITS, bool)
    touched[[f for t in other for f in own[t]]] = True
    carried: dict[int, int] = {}  # how many distinct words of a row carry a feature
    for k in range(3):
        ok = touched[word[:, k]] & (word[:, k] != word[:, 0] if k else True)
        if k == 2:
            ok &= word[:, 2] != word[:, 1]
        key, n = np.unique((row[ok] << FEATURE_BITS) | word[ok, k], return_counts=True)
        for a, b in zip(key.tolist(), n.tolist(), strict=True):
            carried[a] = carried.get(a, 0) + b
    is_term = np.zeros(1 << FEATURE_BITS, bool)
    is_term[list(other)] = True
    hit = is_term[word[:, 0]]
    count: dict[tuple, int] = {}
    for t, r in zip(word[hit, 0].tolist(), row[hit].tolist(), strict=True):
        at, old = r << FEATURE_BITS, set(own[t])
        for x in other[t]:
            new = set(own[x])
            change = [(f, -1) for f in old - new if carried.get(at | f) == 1] + [(f, 1) for f in new - old if at | f not in carried]
            if change:
                key = tuple(sorted(change))
                count[key] = count.get(key, 0) + 1
    return count


def train(words: np.ndarray, ends: np.ndarray, toxic: np.ndarray, groups: tuple = GROUPS, fairness: float = 50.0, ridge: float = 1e-5, steps: int = 120) -> Model:
    """Fit the weights. words: three features of each of all rows' words, in order; ends: where each row's words end; toxic: each row's label."""
    words, ends, toxic = np.asarray(words, np.int32).reshape(-1, 3), np.asarray(ends, np.int64), np.asarray(toxic, float)
    if not len(toxic) or toxic.min() == toxic.max():
        return _constant(float(toxic.mean()) if len(toxic) else 0.0)
    n, n1 = len(toxic), toxic.sum()
    row = np.repeat(np.arange(n), np.diff(ends, prepend=0))
    own: dict[int, tuple] = {}
    listed = []
    for group in groups:
        terms = [tuple(f) for f in _features(Words(pa.array(list(group)), lower=True, letters=True)).tolist()]
        own |= {f[0]: f for f in terms}
        listed.append([f[0] for f in terms])
    _, first = np.unique((row << FEATURE_BITS) | words[:, 0], return_index=True)
    kinds = np.unique(words[:, 0], return_index=True)[1]
    for one in induced(words[:, 0], ends, toxic):
        listed.append(one.tolist())
        own |= {f[0]: tuple(f) for f in words[kinds[np.searchsorted(words[kinds, 0], one)]].tolist()}
    words, row = words[first], row[first]
    swaps = _swaps(words, row, own, listed)
    seen = np.unique((row[:, None] << FEATURE_BITS) | words)
    del words, first, kinds
    row, flat = (seen >> FEATURE_BITS).astype(np.int32), (seen & ((1 << FEATURE_BITS) - 1)).astype(np.int32)
    del seen
    often = np.bincount(flat, minlength=1 << FEATURE_BITS)
    times = np.array(list(swaps.values()), float)
    moved = np.array([f for change in swaps for f, _ in change], np.int64)
    sign = np.array([by for change in swaps for _, by in change], float)
    swap = np.repeat(np.arange(len(swaps)), [len(change) for change in swaps])
    chosen = np.union1d(np.flatnonzero(often >= 2), moved)
    if not len(chosen):
        return _constant(n1 / n)
    place = np.full(1 << FEATURE_BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    both, toxics = often[chosen].astype(float), np.bincount(flat, weights=toxic[row], minlength=1 << FEATURE_BITS)[chosen]
    phi = (toxics * (n - n1) - (both - toxics) * n1) ** 2 / np.maximum(both * (n - both) * n1 * (n - n1), 1e-12)
    value = (phi / (phi + PHI)) ** 2
    keep = place[flat] >= 0
    row, at, moved = row[keep], place[flat[keep]], place[moved]
    x, sign = value[at].astype(np.float32), sign * value[moved]
    del keep, flat, place
    balance = np.where(toxic > 0, 0.5 / n1, 0.5 / (n - n1))
    w, b = np.zeros(len(chosen)), 0.0
    m1, m2, c1, c2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam over the whole sample
        logit = np.bincount(row, weights=x * w[at], minlength=n) + b
        err = balance * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic)
        g = np.bincount(at, weights=x * err[row], minlength=len(w)) + ridge * w
        if len(times):
            change = 2 * fairness / times.sum() * times * np.bincount(swap, weights=sign * w[moved], minlength=len(times))
            g += np.bincount(moved, weights=sign * change[swap], minlength=len(w))
        h = float(err.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        c1, c2 = 0.9 * c1 + 0.1 * h, 0.999 * c2 + 0.001 * h * h
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w = w - 0.15 * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-8)
        b -= 0.15 * (c1 / fix1) / (np.sqrt(c2 / fix2) + 1e-8)
    return Model(chosen.astype(np.int64), w * value, float(b), int(times.sum()), listed)


_SAMPLED = "doc_id long, toxic int, words array<int>"


def _fit(batches: Iterator[pa.RecordBatch], groups: tuple, fairness: float) -> Iterator[pa.RecordBatch]:
    """All sampled rows to a model: kind 0 has weights, 1 the intercept, 2 the swaps, 3 the members of the groups."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")])
        listed = table.column("words").combine_chunks()
        ends = np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False)) // 3
        model = train(listed.flatten().to_numpy(zero_copy_only=False), ends, table.column("toxic").to_numpy().astype(float), groups, fairness)
    else:
        model = _constant(0.0)
    used = np.flatnonzero(model.weights)
    members = [(f, g) for g, group in enumerate(model.groups or []) for f in group]
    feature = [*model.features[used].tolist(), 0, 0, *(f for f, _ in members)]
    value = [*model.weights[used].tolist(), model.intercept, float(model.swaps), *(float(g) for _, g in members)]
    kind = [0] * len(used) + [1, 2] + [3] * len(members)
    release()
    yield pa.record_batch([pa.array(kind, pa.int8()), pa.array(feature, pa.int64()), pa.array(value, pa.float64())], names=["kind", "feature", "value"])


def learning(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of doc_id as text, modulo 5, is not 0."""
    return labels.where("toxic is not null and doc_id is not null and crc32(cast(cast(doc_id as bigint) as string)) % 5 <> 0")


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, sample_bytes: int = SAMPLE_BYTES, groups: tuple = GROUPS, fairness: float = 50.0) -> Model:
    """Fit on at most sample[0] toxic and sample[1] other rows of docs whose doc_id is in labels (doc_id, toxic), in order of the hashed
    doc_id as long as their texts have sample_bytes at most."""
    runtime.ship(docs.sparkSession)
    each = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    by = F.xxhash64("doc_id")
    picks = [each.where(f"toxic {test}").orderBy(by, "doc_id").limit(n) for test, n in (("> 0", sample[0]), ("<= 0", sample[1]))]
    ids = F.broadcast(picks[0].unionAll(picks[1]))  # sum(sample) rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")
    sizes = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size")).select("doc_id", "size", by.alias("by")).toArrow().sort_by([("by", "ascending"), ("doc_id", "ascending")])
    if sum(size or 0 for size in sizes.column("size").to_pylist()) > sample_bytes:
        within = np.cumsum([size or 0 for size in sizes.column("size").to_pylist()]) <= sample_bytes
        rows = rows.where(F.col("doc_id").isin(np.array(sizes.column("doc_id").to_pylist())[within].tolist()))
    sampled = rows.mapInArrow(_sampled, _SAMPLED).repartition(1)  # sum(sample) rows and sample_bytes of text at most
    fitted = sampled.mapInArrow(partial(_fit, groups=groups, fairness=fairness), "kind byte, feature long, value double").toArrow()
    kind, feature, value = (fitted.column(c).to_numpy() for c in ("kind", "feature", "value"))
    members = [feature[(kind == 3) & (value == g)].tolist() for g in range(int(value[kind == 3].max(initial=-1)) + 1)]
    return Model(feature[kind == 0], value[kind == 0], float(value[kind == 1][0]), int(value[kind == 2][0]), members)


def _score(batches: Iterator[pa.RecordBatch], model: Model, name: str) -> Iterator[pa.RecordBatch]:
    """Each row with its score as one more column, the last."""
    weights = model.dense()
    for batch in slices(batches):
        words = Words(batch.column("text"), lower=True, letters=True)
        found = _features(words)
        row = np.repeat(np.arange(batch.num_rows), words.counts)
        word, kind = np.nonzero(weights[found])
        pair = np.unique((row[word] << FEATURE_BITS) | found[word, kind])
        logit = model.intercept + np.bincount(pair >> FEATURE_BITS, weights=weights[pair & ((1 << FEATURE_BITS) - 1)], minlength=batch.num_rows)
        score = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], schema=batch.schema.append(pa.field(name, pa.float64())))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with their scores as a column of that name, the last."""
    runtime.ship(docs.sparkSession)
    model = Model(model.features, model.weights, model.intercept)
    return docs.mapInArrow(partial(_score, model=model, name=name), docs.withColumn(name, F.lit(0.0)).schema)


def digest(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)")
    return scored(plain, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score under 0.5."""
    name = fresh("score", docs.columns)
    return scored(docs, model, name).where(F.col(name) < 0.5).select(*docs.columns)
