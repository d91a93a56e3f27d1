"""Phrase collocations by language, counted in quotient filters of permuted word ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm import quotient_filter as qf
from sensorframe.llm.common import bare, written
from sensorframe.llm.tokens import _LOWER, raw, texts_of

#: What ends a piece, and what parts its words.
STOPS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

#: Bytes of text that are encoded together; a longer text makes a shard of its own.
SHARD = 1 << 22
#: Words whose n-grams are packed together, counted n-grams that a task holds before it sends them on, and those that a range of all keys may get.
#: They set a worker's memory, not the result: some 60 MB in counting and 50 MB in merging.
SLICE = 1 << 16
HELD = 1 << 18
RANGE = 1 << 20

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(STOPS)] = 2


def collocations(docs: DataFrame, least: int = 10, keep: int = 2000, share: int = 50) -> DataFrame:
    """The ``keep`` strongest phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``STOPS`` and these into words at ``BLANKS``. Per language, n is
    the number of words, a a phrase's occurrences within pieces, ``least`` or more. A cut of the phrase in two gives
    score floor(1000000 a a / (l r)) with the occurrences l and r of its parts; the cut with the lowest score counts,
    of equal ones the first. A phrase inside a longer candidate that has ``share`` percent of its occurrences or more
    is dropped. Ranks are by score and a, falling, and by phrase in the order of its bytes.

    How: tasks cut their texts into shards, which hold each word once, and texts as positions in that list. Words are
    summed over the lists; the frequent ones get consecutive ids, which go back to the shards that have the word. Each
    shard's n-grams of ids are packed, permuted and counted in quotient filters by range of the permuted key; a task
    merges those of its shards, and the filters of a range are merged across tasks. A common word or phrase is one
    entry of a shard, so no key has a large group, and a range has a bounded number of entries.

    A null text counts as empty, a null lang as "und", a "und" of the table included. Repeated rows count each time.
    Empty tables give an empty result; languages without such a phrase have no row. Columns other than text and lang
    are not read.
    """
    shards = written(_shards(docs))
    total = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    # Words inside phrases that count have their occurrences or more.
    lists = shards.select("shard", "lang", F.posexplode("words").alias("at", "x")).select("shard", "lang", "at", "x.word", "x.f")
    words = _numbered(lists.groupBy("lang", "word").agg(F.sum("f").alias("f")).filter(F.col("f") >= least))
    n_ids, n_words = words.count(), shards.agg(F.sum("n")).first()[0] or 0
    bits = max(2, -(-(n_ids + 1).bit_length() // 2) * 2)
    ids = lists.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard")
    ids = ids.agg(F.collect_list(F.struct("at", "id")).alias("ids"))
    grams = written(_grams(shards.select("shard", "codes").join(ids, "shard"), bits, n_words, least))
    return _ranked(grams, words, total, least, keep, share)


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts, lower-cased, and for each word whether it begins a piece. ``offsets`` of the texts in data."""
    kind = _KIND[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = kind == 0
    first = inside[1:] & ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[1:][edges]  # a text starts a word, whatever the text before it ended with
    starts = np.flatnonzero(first)
    before = np.cumsum(inside[1:], dtype=np.uint32)  # bytes of words up to and with each byte
    at = np.zeros(len(starts) + 1, np.int64)
    at[:-1] = before[starts]
    at[:-1] -= 1
    at[-1] = before[-1] if len(before) else 0
    del before
    text = _LOWER[data[inside[1:]]]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(text.tobytes())])
    piece = np.cumsum(kind == 2, dtype=np.uint32)[starts].astype(np.int64) + np.searchsorted(offsets[:-1], starts, side="right")
    return words.dictionary_encode(), np.concatenate([[True], piece[1:] != piece[:-1]])[: len(starts)]


def _shards(docs: DataFrame) -> DataFrame:
    """(shard, lang, words, codes, n): each word once, with its occurrences, and the texts as positions in ``words``
    from 1, with a 0 before each piece, in planes of bytes."""
    schema = "shard long, lang string, words array<struct<word:string,f:long>>, codes binary, n long"

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[pa.DictionaryArray, np.ndarray]]] = {}
        size: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def rows(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            parts = held.pop(lang)
            size.pop(lang)
            chunks = pa.chunked_array([w for w, _ in parts]).unify_dictionaries()
            codes = np.concatenate([c.indices.to_numpy().astype(np.uint32) for c in chunks.chunks]) + np.uint32(1)
            if not len(codes):
                return
            dictionary, first = chunks.chunk(0).dictionary, np.concatenate([x for _, x in parts])
            out = np.zeros(len(codes) + first.sum(), np.uint32)
            out[np.arange(len(codes)) + np.cumsum(first)] = codes
            f = np.bincount(codes)[1:]
            values = pa.StructArray.from_arrays([dictionary.cast(pa.large_string()).cast(pa.string()), pa.array(f, pa.int64())], names=["word", "f"])
            listed = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            planes = np.ascontiguousarray(out.view(np.uint8).reshape(-1, 4).T).tobytes()
            yield pa.record_batch([pa.array([number]), pa.array([lang]), listed, pa.array([planes]), pa.array([len(codes)])], names=["shard", "lang", "words", "codes", "n"])
            number += 1

        for batch in batches:
            texts, langs = texts_of(batch.column("text")), pc.fill_null(batch.column("lang"), "und")
            for lang in pc.unique(langs).to_pylist():
                data, offsets = raw(texts.filter(pc.equal(langs, lang)))
                begin = 0
                while begin < len(offsets) - 1:  # whole texts, about a quarter of SHARD: encoding takes many times their bytes
                    end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SHARD // 4, side="right")) - 1)
                    held.setdefault(lang, []).append(encode(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]))
                    size[lang] = size.get(lang, 0) + int(offsets[end] - offsets[begin])
                    begin = end
                    if size[lang] >= SHARD:
                        yield from rows(lang)
            while sum(size.values()) > 2 * SHARD:
                yield from rows(max(size, key=size.get))
        for lang in list(held):
            yield from rows(lang)

    return bare(docs, "text", "lang").mapInArrow(shard, schema)


def _numbered(words: DataFrame) -> DataFrame:
    """``words``, saved, with ids from 1 without gaps: what earlier partitions hold, and the place in one's own. The
    driver gets one count for each partition."""
    own = words.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    saved = written(own)
    before, counts = 0, []
    for row in saved.groupBy("part").count().orderBy("part").collect():
        counts.append((row["part"], before))
        before += row["count"]
    offsets = words.sparkSession.createDataFrame(counts, "part int, before long")
    return saved.join(F.broadcast(offsets), "part").select("lang", "word", "f", (F.col("before") + F.col("at") + 1).alias("id"))


def _grams(shards: DataFrame, bits: int, n_words: int, least: int) -> DataFrame:
    """(w1, w2, w3, a) of the phrases of two (w3 is 0) and three words with ids of ``bits`` bits that occur ``least``
    times or more."""
    width, half = 3 * bits // 2, np.uint64(bits // 2)
    range_bits = min(width - 1, max(0, (2 * n_words // RANGE).bit_length()))
    own = np.uint64(width - range_bits)

    def keys(codes: pa.Buffer, at: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        local = np.ascontiguousarray(np.frombuffer(codes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
        table = np.zeros(int(local.max()) + 1, np.uint64)
        table[np.asarray(at) + 1] = ids
        words = np.append(table[local], np.zeros(2, np.uint64))
        for begin in range(0, len(local), SLICE):
            yield packed(words[begin : begin + SLICE + 2])

    def packed(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two, three = words[:-2], words[1:-1], words[2:]
        pair = (one > 0) & (two > 0)
        triple = pair & (three > 0)
        one, two = np.concatenate([one[pair], one[triple]]), np.concatenate([two[pair], two[triple]])
        three = np.concatenate([np.zeros(pair.sum(), np.uint64), three[triple]])
        mask = np.uint64((1 << (bits // 2)) - 1)
        return (one << half) | (two >> half), ((two & mask) << np.uint64(bits)) | three

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            hi, lo, counts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return qf.tally(hi, lo, width, counts)

        def filters() -> Iterator[pa.RecordBatch]:
            hi, lo, counts = held[0]
            numbers = (hi >> own).astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(hi) else np.zeros(0, np.int64)
            end = np.append(begin[1:], len(hi))
            built = [qf.build(hi[b:e], lo[b:e], counts[b:e], width, range_bits) for b, e in zip(begin, end)]
            yield pa.record_batch([pa.array(numbers[begin], pa.int64()), pa.array(built, pa.binary())], names=["range", "filter"])

        for batch in batches:
            for codes, ids in zip(batch.column("codes"), batch.column("ids")):
                pairs = ids.values
                at, of = pairs.field("at").to_numpy(), pairs.field("id").to_numpy()
                for hi, lo in keys(codes.as_buffer(), at, of):
                    held.append(qf.tally(*qf.permute(hi, lo, width), width))
                    if sum(len(h[0]) for h in held) >= 2 * HELD:
                        held.append(merged())
                        if len(held[0][0]) >= HELD:
                            yield from filters()
                            held.clear()
        if held:
            held.append(merged())
            yield from filters()

    def total(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        hi, lo, counts = qf.merge([f.as_buffer().to_pybytes() for f in table.column("filter")], width, range_bits, key[0].as_py())
        often = counts >= least
        hi, lo = qf.restore(hi[often], lo[often], width)
        mask, low = np.uint64((1 << (bits // 2)) - 1), np.uint64((1 << bits) - 1)
        w2 = ((hi & mask) << half) | (lo >> np.uint64(bits))
        return pa.table([pa.array(x.astype(np.int64)) for x in (hi >> half, w2, lo & low, counts[often])], names=["w1", "w2", "w3", "a"])

    ranges = shards.select("codes", "ids").mapInArrow(count, "range long, filter binary")
    return ranges.groupBy("range").applyInArrow(total, "w1 long, w2 long, w3 long, a long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact for counts of up to 15 digits."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (a * a), left * right).cast("long")


def _ranked(grams: DataFrame, words: DataFrame, total: DataFrame, least: int, keep: int, share: int) -> DataFrame:
    def word(k: int) -> DataFrame:
        return words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 1 else []))

    pairs, triples = grams.filter("w3 = 0"), grams.filter("w3 > 0")
    inside = triples.select("w1", "w2", "a").unionAll(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    inside = inside.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    pairs = pairs.join(inside, ["w1", "w2"], "left").filter(f"longer is null or 100 * longer < {share} * a")
    pairs = pairs.join(word(1), "w1").join(word(2), "w2").select(
        "lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score")
    )
    both = grams.filter("w3 = 0")
    head = both.select("w1", "w2", F.col("a").alias("f12"))
    tail = both.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    triples = triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    one, two = _score(F.col("a"), F.col("f1"), F.col("f23")), _score(F.col("a"), F.col("f12"), F.col("f3"))
    triples = triples.withColumns({"one": one, "two": two}).withColumn("early", F.col("one") <= F.col("two"))
    triples = triples.select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
        F.when(F.col("early"), F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(F.col("early"), F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("one", "two").alias("score"),
    )
    # The first ones of each part of a language's phrases hold the first ones of all.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    all_ = pairs.unionByName(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = all_.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= keep)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= keep)
    return best.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
