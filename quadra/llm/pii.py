"""Personal data: base formats, and a bootstrapped contextual search for identifiers that no format covers.

Base formats (email, ip, card, phone) are leftmost, non-overlapping matches for each kind; a match that fails its
check (parts up to 255; Luhn; digit count) is dropped.

Bootstrapping. Base spans are the seed entities. The words around an entity are its lexical patterns: the word before, the two words
before, the word after. Identifier-shaped words (five characters or more with a digit, or an @) are the candidate instances. Patterns beside `support`
distinct instances or more make a graph with the instances, over which scores are computed in turns. An instance that is a seed scores 1; any other
the reliability of its best pattern. A pattern's reliability is the mean score of the instances that it extracts (one more counted as wrong); its
confidence is the sum of those scores over all occurrences of its words in the whole corpus. So a context of running text may vouch for an instance without
discovering anything, while a context that little else than identifiers stand in is accepted (confidence `accept` or more), even if all that
it extracts was met in the turns before: patterns induce instances, those induce patterns. Accepted patterns discover
their instances as new spans, whose kind is that of most of the pattern's seeds, or `identifier` where it has none. Base spans always stay.

Execution. One pass writes each row's base spans and candidate occurrences (small tables in the shared folder); a second pass counts the occurrences
of the patterns of the graph, found through a bit set of fixed size (2**22 bits). Scores are DataFrame aggregates; text is never shuffled.

Defined cases: null text is empty; rows that repeat a doc_id (or have none) are searched each by itself, under a key made of doc_id and 128 bits of
the text's hashes; an empty table gives no rows; words and contexts may be of any length; extra columns, whatever their names, are ignored or kept; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadra import runtime
from quadra.llm.text import U, Words, fresh, slices

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans: those of the base formats, and what contexts discovered that no seed's kind fits.
ALL_KINDS = (*KINDS, "identifier")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits either begins a match or holds none, so only its start need be tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bits of the set of patterns whose occurrences are counted.
SET_BITS = 22


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base formats, sorted by start, then kind."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            done = found.end()
            out.append((begin, 0, done))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _occurrences(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, str, str]]:
    """(start, end, kind, two words before, word after) of the base spans and, with kind -1, of the identifier-shaped words that touch none."""
    if not base and not _MARK.search(text):
        return
    words = [m.span() for m in _WORD.finditer(text)]
    begins = [w[0] for w in words]
    taken, own, k, reach = sorted((s, e) for s, _, e in base), [(s, e, kind) for s, kind, e in base], 0, 0
    for a, b in words:
        if not _MARK.search(text, a, b):
            continue
        while a < b and not text[a].isalnum():
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if b - a >= 5 and reach <= a:
            own.append((a, b, -1))
    for s, e, kind in own:
        first, last = bisect_right(begins, s) - 1, bisect_right(begins, e - 1) - 1
        yield s, e, kind, " ".join(text[a:b] for a, b in words[max(0, first - 2) : first]), " ".join(text[a:b] for a, b in words[last + 1 : last + 2])


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SCANNED = "row_key string, doc_id long, base string, occurrences array<struct<start:int,end:int,kind:byte,instance:long,word:long,words:long,after:long>>"
_OCCURRENCE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int8()), ("instance", pa.int64()), ("word", pa.int64()), ("words", pa.int64()), ("after", pa.int64())])


def _grams(contexts: list[str]) -> tuple[list, list]:
    """The hash of the last word of each context and of its two words; None where there is none."""
    seen = Words(pa.array(contexts, pa.string()), lower=True)
    each = seen.hashes()
    last, pair = [None] * len(contexts), [None] * len(contexts)
    own = each.view(np.int64).tolist()
    for r, (a, b) in enumerate(zip(seen.rows[:-1].tolist(), seen.rows[1:].tolist(), strict=True)):
        if b > a:
            last[r] = own[b - 1]
    two, row, _ = seen.windows(2, hashes=each)
    for h, r in zip(two.view(np.int64).tolist(), row.tolist(), strict=True):
        pair[r] = h
    return last, pair


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        bases, counts, places, before, after, instances = [], [], [], [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            bases.append(spans_text(base))
            own = list(_occurrences(text, base))
            counts.append(len(own))
            for s, e, k, left, right in own:
                places.append((s, e, k if k >= 0 else None))
                before.append(left)
                after.append(right)
                instances.append(xxhash.xxh64_intdigest(_SPACE.sub("", text[s:e])) - (1 << 63))
        (word, words), (next_word, _) = _grams(before), _grams(after)
        columns = [*(list(c) for c in zip(*places, strict=True)), instances, word, words, next_word] if places else [[]] * 7
        flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OCCURRENCE, strict=True)], fields=list(_OCCURRENCE))
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), flat)
        yield pa.record_batch([batch.column("row_key"), batch.column("doc_id"), pa.array(bases, pa.string()), listed], names=["row_key", "doc_id", "base", "occurrences"])


def _count(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Occurrences of the patterns in the bit set `wanted`, summed over a task's rows (in parts of a bounded number of patterns)."""
    held = [(np.empty(0, np.uint64), np.empty(0, np.int64))]

    def merged():
        value, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return value, np.bincount(back, weights=np.concatenate([h[1] for h in held]), minlength=len(value)).astype(np.int64)

    def row(value, n):
        return pa.record_batch([pa.array(value.view(np.int64)), pa.array(n)], names=["gram", "n"])

    for batch in slices(batches):
        words = Words(batch.column("text"), lower=True)
        each = words.hashes()
        two = words.windows(2, hashes=each)[0]
        found = []
        for h in (each, two):
            at = (h & U((1 << SET_BITS) - 1)).astype(np.int64)
            found.append(h[(wanted[at >> 6] >> (at & 63).astype(np.uint64)) & U(1) > 0])
        held.append(np.unique(np.concatenate(found), return_counts=True))
        if len(held) >= 32:
            held = [merged()]
            if len(held[0][0]) > 1_000_000:
                yield row(*held.pop())
                held = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
    yield row(*merged())


def _graph(scanned: DataFrame, docs: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """(places: occurrences with their patterns; links of patterns, beside `support` or more distinct instances, with instances)."""
    spark = docs.sparkSession
    each = scanned.select("row_key", F.explode("occurrences").alias("o")).select("row_key", "o.*")
    sides = F.array(*[F.struct(F.lit(side).cast("byte").alias("side"), F.col(c).alias("gram")) for c, side in (("word", 0), ("words", 0), ("after", 1))])
    places = each.select("row_key", "start", "end", "kind", "instance", F.explode(sides).alias("p")).select("row_key", "start", "end", "kind", "instance", "p.side", "p.gram").where("gram is not null")
    places = runtime.save(places, "pii-places")
    links = places.groupBy("gram", "side", "instance").agg(F.count("*").alias("n"), F.max(F.col("kind").isNotNull()).alias("seed"))
    links = runtime.save(links, "pii-pairs")
    plenty = links.groupBy("gram", "side").agg(F.count("*").alias("d"), F.sum("n").alias("met")).where(F.col("d") >= support).select("gram", "side", "met")
    plenty = runtime.save(plenty, "pii-plenty")
    low = F.col("gram").bitwiseAND(F.lit((1 << SET_BITS) - 1))
    cells = plenty.groupBy(F.shiftright(low, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(gram & {63} as int))")).alias("bits")).collect()
    wanted = np.zeros(1 << (SET_BITS - 6), np.uint64)
    for r in cells:  # at most 2**16 of them
        wanted[r["cell"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    if not cells:
        return places, spark.createDataFrame([], "gram long, side byte, met long, total long, instance long, n long, seed boolean")
    counted = docs.select("text").where("text is not null").mapInArrow(partial(_count, wanted=wanted), "gram long, n long")
    totals = counted.groupBy("gram").agg(F.sum("n").alias("total"))
    known = plenty.join(totals, "gram").select("gram", "side", "met", F.greatest("met", "total").alias("total"))
    return places, runtime.save(links.join(known, ["gram", "side"]), "pii-links")


def scores(links: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """links: gram, side, met, total, instance, n, seed. (gram, side, confidence of each pattern; instance, score)."""
    seed = F.col("seed").cast("double")
    instances = links.groupBy("instance").agg(F.max(seed).alias("score"))
    patterns = None
    for _ in range(rounds):
        joined = links.join(instances, "instance")
        patterns = joined.groupBy("gram", "side", "met", "total").agg(F.sum(F.col("n") * F.col("score")).alias("hits"))
        patterns = runtime.save(patterns.select("gram", "side", (F.col("hits") / (F.col("met") + 1)).alias("reliability"), (F.col("hits") / F.col("total")).alias("confidence")), "pii-scores")
        instances = links.join(patterns, ["gram", "side"]).groupBy("instance").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(F.col("reliability"))).alias("score"))
    return patterns, instances


def _accepted(places: DataFrame, links: DataFrame, rounds: int, accept: float) -> DataFrame:
    """gram, side, score, pattern_kind (a place in ALL_KINDS) of the accepted patterns."""
    patterns, _ = scores(links, rounds)
    good = patterns.where(F.col("confidence") >= accept).select("gram", "side", F.col("confidence").alias("score"))
    kinds = places.where("kind is not null").groupBy("gram", "side", "kind").agg(F.count("*").alias("n"))
    most = kinds.groupBy("gram", "side").agg(F.max(F.struct("n", (-F.col("kind")).alias("k"))).alias("most"))
    kind = F.coalesce((-F.col("most.k")).cast("byte"), F.lit(len(KINDS)).cast("byte"))
    return runtime.save(good.join(most, ["gram", "side"], "left").select("gram", "side", "score", kind.alias("pattern_kind")), "pii-patterns")


def search(docs: DataFrame, rounds: int = 8, accept: float = 0.5, support: int = 2) -> DataFrame:
    """row_key, doc_id, base, added for each row of docs: spans as kind:start:end, comma-joined, in order; `added` are those that contexts discovered."""
    runtime.ship(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", _row_key())
    scanned = runtime.save(keyed.mapInArrow(_scan, _SCANNED), "pii-scan")
    places, links = _graph(scanned, docs, support)
    patterns = _accepted(places, links, rounds, accept)
    found = places.where("kind is null").join(patterns, ["gram", "side"])
    found = found.groupBy("row_key", "start", "end").agg(F.max(F.struct("score", (-F.col("pattern_kind")).alias("k"))).alias("best"))
    found = found.select("row_key", "start", (-F.col("best.k")).cast("int").alias("kind"), "end")
    added = found.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("spans"))
    names = F.array(*map(F.lit, ALL_KINDS))
    written = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))
    added = runtime.save(added.select("row_key", written.alias("added")), "pii-added")
    return scanned.select("row_key", "doc_id", "base").join(added, "row_key", "left").select("row_key", "doc_id", "base", F.coalesce("added", F.lit("")).alias("added"))


def _row_key():
    """A key that equal rows share and other rows, even of that doc_id, do not."""
    return F.concat_ws(":", F.col("doc_id").cast("long"), F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))


def parse_spans(written: str) -> list[tuple[int, int, int]]:
    out = []
    for item in written.split(",") if written else ():
        kind, start, end = item.split(":")
        out.append((int(start), ALL_KINDS.index(kind), int(end)))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [[] for _ in KINDS]
        digests, spans, extra = [], [], []
        for base, added in zip(batch.column("base").to_pylist(), batch.column("added").to_pylist(), strict=True):
            own = parse_spans(base)
            for k in range(len(KINDS)):
                counts[k].append(sum(1 for s in own if s[1] == k))
            digests.append(hashlib.sha256(base.encode()).hexdigest())
            more = parse_spans(added)
            spans.append(spans_text(sorted(own + more)))
            extra.append(len(more))
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans), pa.array(extra, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])


def digest(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added."""
    return search(docs, **settings).select("doc_id", "base", "added").mapInArrow(_digest, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the first names the whole."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{ALL_KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column has the discovered spans of each row; it goes."""
    for batch in slices(batches):
        texts = []
        for text, added in zip(batch.column("text").to_pylist(), batch.columns[-1].to_pylist(), strict=True):
            spans = base_spans(text) if text else []
            spans += parse_spans(added or "")
            texts.append(mask(text, spans) if spans else text)
        kept = batch.select(range(batch.num_columns - 1))
        columns = [pa.array(texts, f.type) if f.name == "text" else kept.column(i) for i, f in enumerate(kept.schema)]
        yield pa.record_batch(columns, schema=kept.schema)


def redact(docs: DataFrame, **settings) -> DataFrame:
    """docs with the spans in `text` replaced by [EMAIL], [IP], [CARD], [PHONE] or [IDENTIFIER]. Base spans are found again in the same pass;
    only discovered spans are joined, from a written table whose size Spark knows."""
    key, added = fresh("key", docs.columns), fresh("found", docs.columns)
    found = search(docs, **settings).where("added <> ''").select(F.col("row_key").alias(key), F.col("added").alias(added)).distinct()
    found = runtime.save(found, "pii-found")
    keyed = docs.withColumn(key, _row_key()).join(found, key, "left").select(*docs.columns, added)
    return keyed.mapInArrow(_mask, docs.schema)
