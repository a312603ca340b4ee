"""Removal of long repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Sorting every suffix is not needed: each
window of that length has an anchor, its 32-byte gram of smallest hash (leftmost of equals). Equal windows have equal anchors at
equal offsets, so only suffixes that start at anchors are sorted, and only where the gram occurs twice or more in all texts.

1. Count anchor grams; keep bit maps of repeated and of very frequent grams.
2. Each task sorts its anchor suffixes, merges equal ones and writes them front-coded (shared prefix length and the rest, the
   left context likewise), one run per partition. Suffixes are ordered by a second hash of their gram, then by bytes:
   partitions are even without sampling, and a gram never spans two.
3. Each partition merges its runs with a loser tree that keeps the common prefix with the last winner and compares on from
   there, which also yields the common prefix of neighbours. A window at offset o left of its anchor is repeated if the
   suffixes agree on length - o bytes and the left contexts on o bytes; no suffix is compared again.
4. Grams above ``FREQUENT`` occurrences go another exact way: hashes (2 x 64 bits) of all their windows are counted.

Texts are told apart by hash; equal texts of ``length`` bytes or more repeat each other whole and are not sent anywhere.

Defined results: a null text is empty; texts shorter than ``length`` keep everything; a repeated row repeats its text; ids may
repeat or be null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerovigil.llm import textkit as K
from aerovigil.llm.frames import bit_filter, in_filter
from aerovigil.session import durable

LENGTH, GRAM = 400, 32
FILTER_BITS = 24
FREQUENT = 50_000          #: Occurrences of a gram above which its windows are counted instead of sorted in one task.
SLICE_BYTES = 1 << 19      #: Text bytes whose windows are looked at together.
RUN_BYTES = 10 << 20       #: Suffix bytes that a task holds before it writes sorted runs.
PART_BYTES = 12 << 20      #: Suffix bytes aimed at for one partition.
PAIRWISE = 96              #: Suffixes of one gram up to which pairs are compared; above, offsets are grouped.

_OTHER = np.roll(np.arange(256, dtype=np.uint8) * np.uint8(167), 91)  # a second, independent byte code for 128-bit hashes


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows that share an anchor: row, anchor, first and last window start, gram hash."""
    n = len(data)
    wide = length - GRAM + 1
    size = np.diff(offsets)
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    if not (size >= length).any():
        return none
    grams = n - GRAM + 1
    prefix = K.prefix_hash(data)
    at = np.arange(grams)
    code = K.span_hash(prefix, at, at + GRAM)
    key = (code & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    pad = -grams % wide
    blocks = np.concatenate((key, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:n - length + 1], ahead[wide - 1:wide - 1 + n - length + 1])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)[:len(anchor)]
    valid = np.flatnonzero(np.arange(len(anchor)) + length <= offsets[1:][row])
    anchor, row = anchor[valid], row[valid]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
    last = np.append(first[1:], len(anchor)) - 1
    return row[first], anchor[first], valid[first], valid[last], code[anchor[first]]


def _common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix of two strings known to share h bytes."""
    most, step = min(len(a), len(b)), 16
    while h < most:
        if a[h:h + step] == b[h:h + step]:
            h = min(most, h + step)
            step *= 2
        elif step == 1:
            return h
        else:
            step = max(1, step // 4)
    return most


def encode_run(entries: list[tuple[bytes, bytes, int, bytes]]) -> bytes:
    """Sorted (suffix, left context, times, places) as front-coded bytes."""
    out, last, left0 = [], b"", b""
    for suffix, left, times, places in entries:
        h, g = _common(last, suffix, 0), _common(left0[::-1], left[::-1], 0)
        head = np.array([h, len(suffix) - h, g, len(left) - g, min(times, 2), len(places)], "<u4").tobytes()
        out += [head, suffix[h:], left[:len(left) - g], places]
        last, left0 = suffix, left
    return b"".join(out)


def decode_run(run: bytes) -> Iterator[tuple[int, bytes, bytes, int, bytes]]:
    """(prefix shared with the suffix before, suffix, left context, times, places), one after the other."""
    at, last, left0 = 0, b"", b""
    while at < len(run):
        h, more, g, front, times, size = np.frombuffer(run, "<u4", 6, at).tolist()
        at += 24
        last = last[:h] + run[at:at + more]
        at += more
        left0 = run[at:at + front] + left0[len(left0) - g:]
        at += front
        yield h, last, left0, times, run[at:at + size]
        at += size


def merge(runs: list[Iterator]) -> Iterator[tuple[int, bytes, bytes, int, bytes]]:
    """All runs in one order, each suffix with the prefix it shares with the one before. The loser tree keeps, for every loser,
    the prefix shared with the winner that beat it, so a comparison starts where the last one ended."""
    width = 1
    while width < len(runs):
        width *= 2
    runs = runs + [iter(())] * (width - len(runs))
    heads = [next(r, None) for r in runs]
    shared = [0] * width
    tree = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix becomes that with the winner."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        h = _common(x, y, shared[a])
        win, lose = (a, b) if x[h:h + 1] <= y[h:h + 1] else (b, a)
        shared[lose] = h
        return win, lose

    champion = list(range(width))
    for level in range(width.bit_length() - 1):
        base = width >> (level + 1)
        nxt = []
        for i in range(0, len(champion), 2):
            win, lose = play(champion[i], champion[i + 1])
            tree[base + i // 2] = lose
            nxt.append(win)
        champion = nxt
    best = champion[0]
    while heads[best] is not None:
        _, suffix, left, times, places = heads[best]
        yield shared[best], suffix, left, times, places
        heads[best] = next(runs[best], None)
        shared[best] = heads[best][0] if heads[best] is not None else 0
        node = (width + best) // 2
        while node:
            best, tree[node] = play(best, tree[node])
            node //= 2


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges with inclusive ends, overlapping and adjacent ones merged."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_offsets(suffixes: list[bytes], lefts: list[bytes], times: list[int], common: list[int],
                     length: int) -> list[list[tuple[int, int]]]:
    """Offsets (from, to) of repeated windows for each suffix of one gram. ``common``: prefix shared with the one before, both
    without the hash in front. Suffix i has windows at offsets length - len(suffix) .. len(left)."""
    m = len(suffixes)
    low = [length - len(s) for s in suffixes]
    high = [len(x) for x in lefts]
    out: list[list[tuple[int, int]]] = [[(low[i], high[i])] if times[i] > 1 else [] for i in range(m)]
    if m < 2:
        return out
    if m <= PAIRWISE:
        back = [x[::-1] for x in lefts]
        for i in range(m):
            r = length
            for j in range(i + 1, m):
                r = min(r, common[j])
                if times[i] > 1 and times[j] > 1:
                    continue
                top = min(high[i], high[j])
                a = max(low[i], low[j], length - r)
                if a > top:
                    continue
                b = min(top, _common(back[i], back[j], 0))
                if a <= b:
                    out[i].append((a, b))
                    out[j].append((a, b))
        return out
    low_, high_ = np.array(low), np.array(high)
    widest = int(high_.max())
    left = np.zeros((m, widest + 1), np.uint8)
    for i, x in enumerate(lefts):
        left[i, :len(x)] = np.frombuffer(x, np.uint8)[::-1]
    agree = np.array(common)
    code, power, since = np.zeros(m, np.uint64), K.powers(widest + 2), np.full(m, -1)
    for o in range(widest + 2):
        here = np.flatnonzero((low_ <= o) & (o <= high_))
        flag = np.zeros(m, bool)
        if len(here) > 1:
            block = np.cumsum(agree < length - o).astype(np.uint64)
            key = K.mix(code[here] ^ K.mix(block[here]))
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            flag[here[count[back] > 1]] = True
        for i in np.flatnonzero(flag & (since < 0)):
            since[i] = o
        for i in np.flatnonzero(~flag & (since >= 0)):
            out[i].append((int(since[i]), o - 1))
            since[i] = -1
        if o <= widest:
            code = code + (left[:, o].astype(np.uint64) + np.uint64(1)) * power[o]
    return out


def _runs(texts: DataFrame, repeated, frequent, parts: int, length: int) -> DataFrame:
    """(part, run): front-coded sorted runs of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, hot = np.unpackbits(np.frombuffer(repeated.value, np.uint8)), np.unpackbits(np.frombuffer(frequent.value, np.uint8))
        mask = np.uint64((1 << FILTER_BITS) - 1)
        held: dict[tuple[bytes, bytes], dict] = {}
        size = 0

        def flush():
            by: dict[int, list] = {}
            for (suffix, left), found in held.items():
                places = np.array([p for p in found if p is not None], "<i8").tobytes()
                by.setdefault(int.from_bytes(suffix[:8], "big") * parts >> 64, []).append((suffix, left, found[None], places))
            for part, entries in by.items():
                entries.sort(key=lambda e: e[0])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([encode_run(entries)], pa.binary())], ["part", "run"])
            held.clear()

        for batch in K.slices(batches, "text", SLICE_BYTES):
            data, offsets = K.utf8(batch.column("text"))
            row, anchor, first, last, code = anchors(data, offsets, length)
            slot = (code & mask).astype(np.int64)
            use = np.flatnonzero(often[slot].astype(bool) & ~hot[slot].astype(bool))
            t1, t2 = (batch.column(c).to_numpy() for c in ("t1", "t2"))
            raw = data.tobytes()
            code = K.mix(code + np.uint64(1))  # anchors have the smallest hashes: spread them over all partitions
            for r, p, a, b, h in zip(row[use].tolist(), anchor[use].tolist(), first[use].tolist(), last[use].tolist(), code[use].tolist()):
                key = (h.to_bytes(8, "big") + raw[p:b + length], raw[a:p])
                found = held.get(key)
                if found is None:
                    found = held[key] = {None: 0}
                    size += len(key[0]) + len(key[1])
                found[None] += 1
                found[int(t1[r]), int(t2[r]), p - int(offsets[r])] = 1
            if size > RUN_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return texts.mapInArrow(run, "part int, run binary")


def _merged(runs: DataFrame, length: int) -> DataFrame:
    """(t1, t2, lo, hi): byte ranges of texts that repeat, from the merged runs of each partition."""
    def resolve(group: list) -> list[tuple[int, int, int, int]]:
        entries: list[list] = []
        alike: dict[bytes, list] = {}
        for h, suffix, left, times, places in group:  # equal suffixes with equal left context are one entry
            if not entries or entries[-1][0] != suffix:
                alike = {}
            if left in alike:
                alike[left][2] += times
                alike[left][4].append(places)
            else:
                alike[left] = [suffix, left, times, h, [places]]
                entries.append(alike[left])
        found = repeated_offsets([e[0][8:] for e in entries], [e[1] for e in entries], [e[2] for e in entries],
                                 [e[3] - 8 for e in entries], length)
        return [(x, y, p - b, p - a + length) for e, spans in zip(entries, found) if spans
                for x, y, p in np.unique(np.frombuffer(b"".join(e[4]), "<i8").reshape(-1, 3), axis=0).tolist() for a, b in union(spans)]

    names = ["t1", "t2", "lo", "hi"]

    def run(_: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [r.as_py() for part in parts for r in part.column("run")]
        group, out = [], []
        for entry in merge([decode_run(r) for r in coded]):
            if group and entry[0] < 8:  # another gram
                if len(group) > 1 or group[0][3] > 1:
                    out += resolve(group)
                group = []
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
                    out = []
            group.append(entry)
        if group:
            out += resolve(group)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return runs.groupBy("part").applyInArrow(run, "t1 long, t2 long, lo long, hi long")


def _counted(texts: DataFrame, frequent, length: int) -> DataFrame:
    """The same ranges for very frequent grams, by counting hashes of their windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(np.frombuffer(frequent.value, np.uint8))
        for batch in K.slices(batches, "text", SLICE_BYTES):
            data, offsets = K.utf8(batch.column("text"))
            row, _, first, last, code = anchors(data, offsets, length)
            use = hot[(code & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)].astype(bool)
            row, first, last = row[use], first[use], last[use]
            many = last - first + 1
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
            if not len(at):
                continue
            one, two = (K.span_hash(K.prefix_hash(d), at, at + length) for d in (data, _OTHER[data]))
            owner = np.repeat(row, many)
            yield pa.RecordBatch.from_arrays(
                [K.to_long(one), K.to_long(two), batch.column("t1").take(pa.array(owner)), batch.column("t2").take(pa.array(owner)),
                 pa.array(at - offsets[owner])], ["w1", "w2", "t1", "t2", "lo"])

    windows = durable(texts.mapInArrow(run, "w1 long, w2 long, t1 long, t2 long, lo long"))
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return windows.join(twice, ["w1", "w2"]).select("t1", "t2", "lo", (F.col("lo") + length).alias("hi")).distinct()


def repeated(docs: DataFrame, length: int = LENGTH, text: str = "text", frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Byte ranges (t1, t2, lo, hi) that repeat in texts met once, and the hashes (t1, t2) of texts met more often."""
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"), *_hashes(text)).filter(F.octet_length("text") >= length)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text", SLICE_BYTES):
            code, times = np.unique(anchors(*K.utf8(batch.column("text")), length)[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([K.to_long(code), pa.array(times)], ["gram", "n"])

    counted = texts.select("text").mapInArrow(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    often = durable(counted.filter("n > 1"))
    total, hot = often.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") > frequent, F.col("n"))), F.lit(0))).first()
    bits = spark.sparkContext.broadcast(bit_filter(often, "gram", FILTER_BITS))
    hot_bits = spark.sparkContext.broadcast(bit_filter(often.filter(F.col("n") > frequent), "gram", FILTER_BITS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) * 600 // PART_BYTES))
    spans = _merged(_runs(texts, bits, hot_bits, parts, length), length)
    if hot:
        spans = spans.unionByName(_counted(texts, hot_bits, length))
    copies = texts.groupBy("t1", "t2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return spans, copies


def _hashes(text: str) -> list:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def strip(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT,
          with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): what stays of each document row; ``kept`` are the bytes."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans, copies = repeated(plain, length, "text", frequent)
    copies = durable(copies)
    # One row per text from here on: its ranges, whose number its length bounds. Written before the next join, which would
    # otherwise be moved below the grouping.
    each = durable(spans.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")))
    own = each.join(copies, ["t1", "t2"], "left_anti")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(own, "t1", FILTER_BITS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text", SLICE_BYTES):
            rows = []
            for t, own_spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, out, at, removed, n = t.encode(), [], 0, 0, 0
                for s in own_spans:
                    if s["lo"] > at or not n:
                        out.append(raw[at:s["lo"]])
                        n += 1
                        removed += s["hi"] - s["lo"]
                        at = s["hi"]
                    elif s["hi"] > at:
                        removed += s["hi"] - at
                        at = s["hi"]
                kept = b"".join([*out, raw[at:]])
                rows.append((removed, n, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), *columns], result.fieldNames())

    texts = plain.select("text", *_hashes("text"))
    need = in_filter(texts, "t1", FILTER_BITS, bits, True)
    result = T._parse_datatype_string("t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    done = need.join(own, ["t1", "t2"]).mapInArrow(cut, result)
    nothing = hashlib.sha256(b"").hexdigest()
    gone = copies.select("t1", "t2", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                         F.lit(nothing).alias("kept_sha256"), F.lit(b"").alias("kept"))
    rows = plain.select("doc_id", *_hashes("text"), F.octet_length("text").cast("long").alias("n_bytes"),
                        F.sha2("text", 256).alias("_sha"), *([F.encode("text", "UTF-8").alias("_text")] if with_text else []))
    out = rows.join(done.unionByName(gone), ["t1", "t2"], "left")
    changed = F.col("n_spans").isNotNull()
    return out.select(F.col("doc_id").alias(doc_id), "n_bytes",
                      F.when(changed, F.coalesce("n_removed", "n_bytes")).otherwise(F.lit(0)).alias("n_removed"),
                      F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"),
                      *([F.coalesce("kept", "_text").alias("kept")] if with_text else []))
