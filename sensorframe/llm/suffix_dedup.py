"""Removal of repeated byte strings by maximal repeats of an enhanced suffix array."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import bare, text_or_empty, written
from sensorframe.llm.tokens import _BYTE, _base_powers, mix, pieces, raw, texts_of

#: Windows of one text that are looked at together.
BLOCK = 1 << 20
#: Contexts of one anchor string that go to one task at most, and contexts that a task sorts together.
GROUP, CHUNK = 1000, 8192

_PLACE = "t1 long, t2 long, at int, low int, high int"
_CONTEXT = f"key long, ctx long, cls long, {_PLACE}, known boolean, head binary, tail binary"
_SPAN = "grp long, key long, ctx long, t1 long, t2 long, at int, start int, stop int"


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 64, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    Texts are UTF-8 bytes. Every byte goes that a string of ``length`` bytes covers which also starts anywhere else, in
    another text or in this one, overlaps included; what is left is ``kept``, which may cut characters. ``n_spans``
    counts the maximal runs of removed bytes. Strings are judged on the input, so all copies go.

    A null text counts as empty, with nothing to remove; a text under ``length`` bytes stays whole. Repeated rows are
    copies of each other, so texts of ``length`` bytes or more that occur twice go entirely. A null doc_id is kept as it
    is. Texts of any length are looked at in blocks of windows. Columns other than doc_id and text are not read. An empty
    table gives an empty result.

    How: see ``_spans``. Texts are known by two 64-bit hashes, windows by two others; see README.
    """
    texts = _texts(docs)
    spans = _spans(texts, length, gram, group, False)
    spans = written(spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))  # saved, so that Spark can split what copies of a text bring to the join

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            rows = zip(texts_of(batch.column("text")).cast(pa.large_binary()), batch.column("spans"))
            out: list[tuple[int, int, int, bytes]] = []
            for text, found in rows:
                data = text.as_py()
                kept, at, n = [], 0, 0
                if found.is_valid:
                    starts, stops = _merged(found.values.field("start").to_numpy(), found.values.field("stop").to_numpy())
                    n = len(starts)
                    for start, stop in zip(starts.tolist(), stops.tolist()):
                        kept.append(data[at:start])
                        at = stop
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((len(data), len(data) - len(left), n, left))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.record_batch([ids, *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    joined = texts.join(spans, ["t1", "t2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_groups(docs: DataFrame, length: int = 400, gram: int = 64, group: int = GROUP) -> DataFrame:
    """All occurrences of repeats of ``length`` bytes or more: grp, doc_id, start, stop (bytes). Rows of one grp are
    equal strings. Nulls, short texts, repeated rows and empty tables are as in ``remove_repeats``."""
    texts = _texts(docs)
    spans = _spans(texts, length, gram, group, True).distinct()
    return texts.select("t1", "t2", "doc_id").join(spans, ["t1", "t2"]).select("grp", "doc_id", "start", "stop")


def _texts(docs: DataFrame) -> DataFrame:
    own = bare(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return own.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("again"), "text").alias("t2"), "doc_id", "text")


def _merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch as one."""
    order = np.argsort(starts)
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], starts[1:] > stops[:-1]])
    return starts[new], stops[np.append(np.flatnonzero(new)[1:] - 1, len(stops) - 1)]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(at, low, high, key) for texts in ``data``: each window of ``length`` bytes has an anchor, the ``gram``-byte
    string in it with the least hash, the first one of equals. ``at`` is where it stands, windows from ``low`` to ``high``
    are those that have it, ``key`` is its hash. Equal windows have their anchors at the same place."""
    n, wide = len(data), length - gram + 1
    m = n - length + 1
    if m < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    power, inverse = _base_powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.multiply(_BYTE[data], power[:n], out=total[1:])
    np.cumsum(total, out=total)
    key = mix((total[gram:] - total[: n - gram + 1]) * inverse[: n - gram + 1])
    place = np.uint64(0xFFFFFF)
    packed = np.full(-(-len(key) // wide) * wide, ~np.uint64(0))
    packed[: len(key)] = (key & ~place) | np.arange(len(key), dtype=np.uint64)
    rows = packed.reshape(-1, wide)  # the least of any stretch is that of the end of one row or the beginning of the next
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:m], ahead[wide - 1 : wide - 1 + m]) & place).astype(np.int64)
    window = np.flatnonzero(np.arange(m) + length <= np.repeat(offsets[1:], np.diff(offsets))[:m])
    at = at[window]
    new = np.ones(len(window), bool)
    new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], window[first], window[np.append(first[1:], len(window)) - 1] if len(first) else first, key[at[first]]


def _digest(data: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(data, seed)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, ctx, t1, t2, at, low, high): a row for each anchor of each text. ``ctx`` is the hash of all that its windows
    cover and of its place therein."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts_of(batch.column("text"))
            keys = [batch.column(t).to_numpy(zero_copy_only=False) for t in ("t1", "t2")]
            for begin, end in pieces(column):
                data, offsets = raw(column.slice(begin, end - begin))
                for base in range(0, max(1, len(data) if end - begin == 1 else 1), BLOCK):
                    part, edges = (data[base : base + BLOCK + length - 1], offsets) if end - begin == 1 else (data, offsets)
                    if end - begin == 1:
                        edges = np.array([0, len(part)])
                    at, low, high, key = anchors(part, edges, length, gram)
                    if not len(at):
                        continue
                    held = part.tobytes()
                    ctx = [_digest(held[a:b], s) for a, b, s in zip(low.tolist(), (high + length).tolist(), (at - low).tolist())]
                    of = np.searchsorted(edges, low, side="right") - 1
                    places = [pa.array((x - edges[of] + base).astype(np.int32)) for x in (at, low, high)]
                    yield pa.record_batch(
                        [pa.array(key.view(np.int64)), _signed(ctx), *[pa.array(k[begin + of]) for k in keys], *places],
                        names=["key", "ctx", "t1", "t2", "at", "low", "high"],
                    )

    return texts.filter(F.octet_length("text") >= length).select("t1", "t2", "text").mapInArrow(find, f"key long, ctx long, {_PLACE}")


def _spans(texts: DataFrame, length: int, gram: int, group: int, all_: bool) -> DataFrame:
    """(grp, t1, t2, start, stop): repeats of ``length`` bytes or more and where they stand; with ``all_`` every
    occurrence of each group, else as many as cover all that is repeated.

    The suffix array is sparse: it has the suffixes that begin at anchors, which are about one in 170. Windows are equal
    only if their anchors and what surrounds them are. Anchor strings that occur once are left out first. Anchors that
    agree in all that their windows cover are then one class, found by an aggregation; a class of two or more is a
    repeat with all its windows. The classes of an anchor string, one member of each, are compared as in
    ``maximal_repeats``, all those of a string in one task. A string with more than ``group`` classes is cut in
    halves by what its windows have before the anchor: the windows of half of these offsets share a longer core, so
    that each half falls into smaller groups by core, until groups are small or windows equal their cores.
    """
    found = written(_anchored(texts, length, gram))
    often = written(found.groupBy("key").count().filter("count > 1").select("key"))  # saved, so that Spark can split what a common key brings to the join
    found = written(found.join(often, "key", "left_semi").withColumn("cls", F.xxhash64("key", "ctx")))
    place = F.struct("t1", "t2", "at", "low", "high")
    classes = written(found.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.lit(False).alias("known"), F.min(place).alias("place")))
    spans = [_of_classes(found, _final(classes, group, all_), length).select("grp", "t1", "t2", "start", "stop")]
    # Classes are compared where one of them has a single member.
    sizes = written(classes.groupBy("key").agg(F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1 and least = 1" if not all_ else "size > 1"))
    open_ = classes.join(sizes, "key").select("key", "ctx", "size", (F.col("n") > 1).alias("known"), F.xxhash64("key", "ctx").alias("cls"), "place.*")
    # Copies of a text may have been read by several tasks.
    rows, reach = written(_contexts(texts, open_, length)), [(0, length - gram)]
    while True:
        largest = rows.agg(F.max("size")).first()[0]
        if largest is None:
            break
        few = rows.filter(F.col("size") <= group) if largest > group else rows
        seen = _compared(few.repartition("key"), length, gram, all_)
        if all_:
            seen = _everywhere(seen.join(few.select("key", "ctx", "cls").distinct(), ["key", "ctx"]), found)
        spans.append(seen.select("grp", "t1", "t2", "start", "stop"))
        if largest <= group:
            break
        reach = [half for low, high in reach for half in ((low, (low + high) // 2), ((low + high) // 2 + 1, high)) if half[0] <= half[1]]
        many = rows.filter(F.col("size") > group).dropDuplicates(["key", "ctx", "cls"])
        halves = written(_halves(many, reach, length))
        classes = written(halves.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.max("known").alias("known"), F.min(place).alias("place")))
        whole = _of_classes(halves, _final(classes, group, all_), length)
        spans.append((_everywhere(whole, found) if all_ else whole).select("grp", "t1", "t2", "start", "stop"))
        sizes = classes.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        one = classes.join(sizes, "key").select("key", "ctx", "size", (F.col("known") | (F.col("n") > 1)).alias("known"), "place.*")
        same = ["key", "ctx"] if all_ else ["key", "ctx", "t1", "t2", "at", "low", "high"]
        rest = halves.drop("known").join(one.select("size", "known", *same), same)
        rows = written(rest.select(*[c.split()[0] for c in _CONTEXT.split(", ")], "size"))
    return functools.reduce(DataFrame.unionByName, spans)


def _final(classes: DataFrame, group: int, all_: bool) -> DataFrame:
    """Classes that are repeats; with ``all_`` those only that are not compared again in halves, where what they have in
    common with others is cut likewise."""
    if not all_:
        return classes.filter("n > 1").select("key", "ctx")
    few = classes.groupBy("key").count().filter(F.col("count") <= group).select("key")
    return classes.filter("n > 1 or known").join(few, "key", "left_semi").select("key", "ctx")


def _of_classes(members: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """All that the windows of members of ``classes`` cover."""
    whole = members.join(classes, ["key", "ctx"], "left_semi")
    return whole.select(F.col("ctx").alias("grp"), "t1", "t2", "at", F.col("low").alias("start"), (F.col("high") + length).alias("stop"), "cls")


def _everywhere(spans: DataFrame, found: DataFrame) -> DataFrame:
    """Spans of one member of a class, for all its members."""
    back = spans.select("grp", "cls", (F.col("start") - F.col("at")).alias("start"), (F.col("stop") - F.col("at")).alias("stop"))
    return back.join(found, "cls").withColumns({"start": F.col("at") + F.col("start"), "stop": F.col("at") + F.col("stop")})


def _contexts(texts: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """``places`` with the bytes of their windows before the anchor (``head``) and from it on (``tail``). Of texts that
    occur more than once each task reads one."""
    listed = written(places.groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "ctx", "cls", "size", "known", "at", "low", "high")).alias("places")))  # saved, as above

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for text, t1, t2, found in zip(texts_of(batch.column("text")).cast(pa.large_binary()), batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), batch.column("places")):
                if (t1, t2) in seen:
                    continue
                seen.add((t1, t2))
                data, all_ = text.as_py(), found.values
                for begin in range(0, len(all_), CHUNK):
                    rows = all_.slice(begin, CHUNK)
                    at, low, high = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("at", "low", "high"))
                    heads = [data[a:b] for a, b in zip(low.tolist(), at.tolist())]
                    tails = [data[a:b] for a, b in zip(at.tolist(), (high + length).tolist())]
                    yield pa.record_batch(
                        [rows.field("key"), rows.field("ctx"), rows.field("cls"), pa.array([t1] * len(at)), pa.array([t2] * len(at)), *[rows.field(c) for c in ("at", "low", "high", "known")],
                         pa.array(heads, pa.binary()), pa.array(tails, pa.binary()), rows.field("size")],
                        names=[*[c.split()[0] for c in _CONTEXT.split(", ")], "size"],
                    )

    own = texts.filter(F.octet_length("text") >= length).drop("doc_id")
    return own.join(listed, ["t1", "t2"]).select("text", "t1", "t2", "places").mapInArrow(cut, f"{_CONTEXT}, size long")


def _halves(rows: DataFrame, reach: list[tuple[int, int]], length: int) -> DataFrame:
    """Contexts cut to the windows with offsets of one range, for each range that they have windows in, keyed by what
    all windows of the range share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _CONTEXT.split(", ")]
        for batch in batches:
            out = []
            for row in batch.select(names).to_pylist():
                head, tail = row["head"], row["tail"]
                for low, high in reach:
                    least, most = max(low, length - len(tail)), min(high, len(head))
                    if least > most:
                        continue
                    before, after = head[len(head) - most :], tail[: length - least]
                    core = head[len(head) - low :] + tail[: length - high]
                    seed = row["key"] & ((1 << 64) - 1)
                    out.append({**row, "head": before, "tail": after, "low": row["at"] - most, "high": row["at"] - least,
                                "key": _digest(core + bytes([low & 255, low >> 8]), seed), "ctx": _digest(before + after, most)})
            if out:
                columns = [_signed([r[c] for r in out]) if c in ("key", "ctx") else pa.array([r[c] for r in out], batch.schema.field(c).type) for c in names]
                yield pa.record_batch(columns, names=names)

    return rows.mapInArrow(cut, _CONTEXT)


def _compared(rows: DataFrame, length: int, gram: int, all_: bool) -> DataFrame:
    """Repeats among the contexts of each key; ``rows`` are dealt by key. Equal rows count once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def result(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            same = np.stack([rows.column(c).to_numpy() for c in ("key", "ctx")])
            rows = rows.filter(pa.array(np.concatenate([[True], (same[:, 1:] != same[:, :-1]).any(axis=0)])))
            heads, tails = ([x.as_py() for x in rows.column(c)] for c in ("head", "tail"))
            known = rows.column("known").to_numpy()
            t1, t2, at, key, ctx = (rows.column(c).to_numpy() for c in ("t1", "t2", "at", "key", "ctx"))
            best = np.where(known & (not all_), np.iinfo(np.int32).max, -1)
            who, before, after, group = [], [], [], []
            for number, (back, ahead, members) in enumerate(maximal_repeats(heads, tails, length, gram)):
                gain = members if all_ else [i for i in members if best[i] < back]
                if not all_:
                    best[gain] = back
                who += gain
                before += [back] * len(gain)
                after += [ahead] * len(gain)
                first = members[0]
                group += [_digest(heads[first][len(heads[first]) - back :] + tails[first][:ahead], back)] * len(gain)  # as a class's ctx
            if who:
                i = np.array(who)
                start, stop = at[i] - np.array(before, np.int32), at[i] + np.array(after, np.int32)
                columns = [np.array(group, np.uint64).view(np.int64), key[i], ctx[i], t1[i], t2[i], at[i], start, stop]
                yield pa.record_batch([pa.array(c) for c in columns], names=[c.split()[0] for c in _SPAN.split(", ")])

        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= CHUNK:
                rows = pa.Table.from_batches(held)
                key = rows.column("key").to_numpy()
                whole = int(np.searchsorted(key, key[-1]))  # of the last key there may be more to come
                if whole:
                    yield from result(rows.slice(0, whole))
                    held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield from result(pa.Table.from_batches(held))

    dealt = rows.sortWithinPartitions("key", "ctx").select("key", "ctx", "t1", "t2", "at", "known", "head", "tail")
    return dealt.mapInArrow(compare, _SPAN)


def _sorted(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``strings`` and how many bytes each has in common with the next in that order."""
    order = np.array(sorted(range(len(strings)), key=strings.__getitem__))
    sizes = np.array([len(s) for s in strings])[order]
    table = np.frombuffer(b"".join(strings[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(strings), width)
    other = table[1:] != table[:-1]
    common = np.where(other.any(axis=1), other.argmax(axis=1), width)
    return order, np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))


class _Least:
    """The least of any stretch of ``values``, from tables of the least of 1, 2, 4, ... consecutive ones."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            step = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def __call__(self, begin: int, end: int) -> int:
        level = (end - begin).bit_length() - 1
        row = self.levels[level]
        return int(min(row[begin], row[end - (1 << level)]))


def _intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(n, first, last) of the intervals of a sorted list whose members have n >= ``least`` bytes in common, and none
    beside them has: those inside others first. ``common`` has what neighbours share."""
    stack: list[tuple[int, int]] = []
    for i, n in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > n:
            most, first = stack.pop()
            yield most, first, i
        if n >= least and (not stack or stack[-1][0] < n):
            stack.append((n, first))


def maximal_repeats(heads: list[bytes], tails: list[bytes], length: int, gram: int) -> Iterator[tuple[int, int, list[int]]]:
    """(back, ahead, members): members agree in the last ``back`` bytes of their heads and the first ``ahead`` of
    their tails, ``length`` or more in all, and neither in a byte more on either side; all that agree are listed.

    Tails are suffixes from an anchor on. Their order and common prefixes are an enhanced suffix array, its intervals the
    nodes of the tree of common prefixes, found by a scan with a stack, children first. Members of a node are ordered by
    what extends them to the left: intervals of these are the strings that the node's prefix can be extended to. Such a
    string is a maximal repeat if its members differ on the right as well, that is if their own common prefix is
    the node's. Heads and tails end with what their windows cover, and no two such ends are equal.
    """
    if len(tails) < 2:
        return
    order, common = _sorted(tails, length)
    by_head, shared = _sorted([h[::-1] for h in heads], length)
    rank = np.empty(len(heads), np.int64)
    rank[by_head] = np.arange(len(heads))
    place = np.empty(len(tails), np.int64)
    place[order] = np.arange(len(tails))
    least_common, least_shared = _Least(common), _Least(shared)
    longest = max(map(len, heads))
    for ahead, first, last in _intervals(common.tolist(), max(gram, length - longest)):
        if last - first == 1:
            one, two = sorted((int(rank[order[first]]), int(rank[order[last]])))
            back = least_shared(one, two)
            if back + ahead >= length:
                yield back, ahead, [int(order[first]), int(order[last])]
            continue
        ranks = np.sort(rank[order[first : last + 1]])
        level = np.frexp(np.diff(ranks).astype(float))[1] - 1
        near = np.empty(len(level), np.int64)
        for k in np.unique(level):
            at = level == k
            row = least_shared.levels[k]
            near[at] = np.minimum(row[ranks[:-1][at]], row[ranks[1:][at] - (1 << int(k))])
        for back, left, right in _intervals(near.tolist(), length - ahead):
            members = by_head[ranks[left : right + 1]]
            where = place[members]
            if least_common(int(where.min()), int(where.max())) == ahead:
                yield back, ahead, members.tolist()
