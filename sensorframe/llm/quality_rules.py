"""Quality rules: rule statistics of every text, judged by an isolation forest calibrated on labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import Held, bare, written
from sensorframe.llm.tokens import pieces, raw, shingles, span_hashes, split, texts_of

MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"

#: Counts of a text, and the rule statistics made of them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_top")
STATS = ("word_chars / n_words", "n_symbols / n_words", "n_upper / word_chars", "n_marks / n_words", "n_top / n_words")
#: Repetition has a forest of its own: good texts repeat lines too, so in one forest it would hide what the others tell.
REPEATS = ("n_dup_lines / n_words", "n_repeat_words / n_words")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS)

TREES, SUBSAMPLE, SCORE_STEPS = 200, 256, 2000


def _table(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_SYMBOL, _MARK = _table(SYMBOLS), _table(b"!?")
_UPPER = _table(bytes(range(65, 91)))
_INNER = np.zeros(256, bool)
_INNER[0x80:0xC0] = True  # bytes within a code point
_SPACE = _table(b" \t\n\v\f\r")


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def count_texts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """``COUNTS`` of each text."""
    n = len(offsets) - 1
    words = split(data, offsets)
    first = words.first
    n_words = np.diff(first)
    owner = np.repeat(np.arange(n), n_words)
    hashes = words.hashes()

    # Words of three-word windows that come twice or more in the text.
    full = np.where(n_words < 3, 0, n_words)
    keep = np.repeat(n_words >= 3, n_words)
    kept_first = np.concatenate([[0], np.cumsum(full)])
    triples, triple_first = shingles(hashes[keep], kept_first, 3)
    who = np.repeat(np.arange(n), np.diff(triple_first))
    order = np.lexsort((triples, who))
    a, b = triples[order], who[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    twice = np.zeros(len(a) + 1, bool)
    twice[1:-1] |= same
    repeated = np.zeros(len(a), bool)
    repeated[order] = twice[:-1] | twice[1:]
    start = np.flatnonzero(repeated) + (kept_first[:-1] - triple_first[:-1])[who[repeated]]  # among the words
    covered = np.zeros(int(kept_first[-1]) + 2, bool)
    for k in range(3):
        covered[start + k] = True
    n_repeat = _per_text(covered[: int(kept_first[-1])], kept_first)

    # The commonest word's uses.
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    edge = np.ones(len(h), bool)
    edge[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(edge)
    n_top = np.zeros(n, np.int64)
    np.maximum.at(n_top, o[at], np.diff(np.append(at, len(h))))

    # Lines with a word that equal an earlier line of the text.
    newline = np.flatnonzero(data == 10)
    line_starts = np.concatenate([offsets[:-1], newline + 1])
    line_owner = np.concatenate([np.arange(n), np.searchsorted(offsets, newline, side="right") - 1])
    order = np.lexsort((line_starts, line_owner))
    line_starts, line_owner = line_starts[order], line_owner[order]
    line_ends = np.append(line_starts[1:] - 1, 0)
    last = np.append(line_owner[1:] != line_owner[:-1], True)
    line_ends[last] = offsets[line_owner[last] + 1]
    worded = np.searchsorted(words.starts, line_starts) < np.searchsorted(words.starts, line_ends)
    lines, line_who = span_hashes(data, line_starts[worded], line_ends[worded]), line_owner[worded]
    order = np.lexsort((lines, line_who))
    a, b = lines[order], line_who[order]
    dup = np.zeros(len(a), bool)
    dup[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    n_dup = np.bincount(b[dup], minlength=n)

    return [
        n_words, _per_text(~(_SPACE[data] | _INNER[data]), offsets), _per_text(_SYMBOL[data], offsets), n_dup, n_repeat,
        _per_text(_UPPER[data], offsets), _per_text(_MARK[data], offsets), n_top,
    ]


def rule_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``COUNTS`` of every text; the last column of ``docs`` must be the text."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [SCHEMA])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(batch.num_columns - 1))
            for begin, end in pieces(texts):
                columns = count_texts(*raw(texts.slice(begin, end - begin)))
                yield pa.record_batch(
                    [*[batch.column(i).slice(begin, end - begin) for i in range(len(keep))], *[pa.array(c.astype(np.int64)) for c in columns]],
                    names=[*keep, *COUNTS],
                )

    return docs.mapInArrow(count, schema)


def stats_of(counts: list[np.ndarray], stats: tuple[str, ...] = STATS) -> np.ndarray:
    c = dict(zip(COUNTS, [x.astype(float) for x in counts]))
    columns = []
    for stat in stats:
        above, below = stat.split(" / ")
        columns.append(c[above] / np.maximum(c[below], 1))
    return np.column_stack(columns)


@dataclass
class Forest:
    """Trees as arrays: split column (-1 in leaves), split value, left child (right is next), path length."""

    column: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Near 1 for rows that few splits set apart, under 0.5 for ordinary ones."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                column = self.column[node]
                open_ = column >= 0
                if not open_.any():
                    break
                right = x[rows, np.maximum(column, 0)] >= self.value[node]
                node = np.where(open_, self.left[node] + right, node)
            total += self.length[node]
        return 2.0 ** (-total / len(self.roots) / self.norm)


def _average_path(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def fit_forest(sample: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 1) -> Forest:
    """An isolation forest: each tree splits a subsample at random columns and random values until rows stand alone
    or the depth reaches log2 of the subsample."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(sample))
    deepest = int(np.ceil(np.log2(max(size, 2))))
    column, value, left, length, roots = [], [], [], [], []

    def new() -> int:
        for a in (column, value, left, length):
            a.append(0)
        return len(column) - 1

    for _ in range(trees):
        roots.append(new())
        open_ = [(roots[-1], sample[rng.choice(len(sample), size, replace=False)], 0)]
        while open_:
            node, rows, depth = open_.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            free = np.flatnonzero(high > low)
            if depth >= deepest or len(rows) < 2 or not len(free):
                column[node], length[node] = -1, depth + _average_path(len(rows))
                continue
            c = int(rng.choice(free))
            v = rng.uniform(low[c], high[c])
            column[node], value[node] = c, v
            a, b = new(), new()
            left[node] = a
            right = rows[:, c] >= v
            open_ += [(a, rows[~right], depth + 1), (b, rows[right], depth + 1)]
    return Forest(np.array(column), np.array(value, float), np.array(left), np.array(length, float), np.array(roots), max(_average_path(size), 1e-9))


def score_column(forest: Forest, stats: tuple[str, ...] = STATS) -> Column:
    """The forest's score of a row with ``COUNTS``."""

    @F.pandas_udf("double")
    def score(counts: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.scores(stats_of([counts[c].to_numpy() for c in COUNTS], stats)))

    return score(F.struct(*COUNTS))


def failed() -> Column:
    """The base rules: too short, or for the most part repeated."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def calibrate(scored: DataFrame, labels: DataFrame, spare: float = 0.005) -> float:
    """The score from which rows are rejected, from all labelled rows that pass the base rules: on a grid of scores,
    the threshold that puts most labelled rows on their own side among those that reject at most ``spare`` of the
    good ones. Counts per grid step and label are summed in Spark. Without labels of both kinds, or where no threshold parts
    them, nothing is rejected."""
    rows = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null").distinct()
    joined = scored.filter(~failed()).select("doc_id", F.floor(F.col("score") * SCORE_STEPS).cast("int").alias("step")).join(rows, "doc_id")
    found = joined.groupBy("step", (F.col("quality") > 0).alias("good")).count().collect()
    counts = np.zeros((2, SCORE_STEPS + 2))
    for r in found:
        counts[int(r.good), min(max(r.step, 0), SCORE_STEPS)] += r["count"]
    if not counts[0].sum() or not counts[1].sum():
        return 2.0
    rejected = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # of each kind, at or above each step
    gain = np.where(rejected[1] <= spare * counts[1].sum(), rejected[0] - rejected[1], -1.0)
    if gain.max() <= 0:
        return 2.0
    best = np.flatnonzero(gain == gain.max())
    return int(best[len(best) // 2]) / SCORE_STEPS  # amid the steps that are as good


@dataclass
class Model:
    """A forest of ratios and one of repetition, and the scores from which each rejects."""

    forest: Forest
    limit: float
    repeats: Forest
    repeat_limit: float

    def scored(self, df: DataFrame) -> DataFrame:
        df = df.withColumns({"score": score_column(self.forest), "repeat_score": score_column(self.repeats, REPEATS)})
        return df.withColumn("sound", ~failed() & (F.col("score") < self.limit) & (F.col("repeat_score") < self.repeat_limit))


def model_from(counted: DataFrame, labels: DataFrame, sample: int = 20_000, seed: int = 1) -> Model:
    """The model of the saved ``counted`` (doc_id, ``COUNTS``). Forests are fitted on a bounded sample of ``sample`` rows,
    picked by a hash; the thresholds on the scores of all labelled rows, that of repetition on those the other one keeps."""
    mine = F.xxhash64(F.lit(seed), *COUNTS, "doc_id")
    rows = counted.filter(~failed()).orderBy(mine, *COUNTS).limit(sample).select(*COUNTS).toPandas()
    if not len(rows):
        rows.loc[0] = 0
    rows = rows.sort_values(list(COUNTS))
    values, known = [rows[c].to_numpy() for c in COUNTS], bare(labels, "doc_id", "quality")
    forest, repeats = fit_forest(stats_of(values), seed=seed), fit_forest(stats_of(values, REPEATS), seed=seed)
    scored = counted.withColumn("first", score_column(forest))
    limit = calibrate(scored.withColumn("score", F.col("first")), known)
    rest = scored.filter(F.col("first") < limit).withColumn("score", score_column(repeats, REPEATS))
    return Model(forest, limit, repeats, calibrate(rest, known))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the ``COUNTS``, base_failed, score, repeat_score, kept.

    Statistics of all texts are counted once and saved. An isolation forest over their ratios, and one over the shares of
    repetition, give each row a score, from the mean length of its paths; rows fail if the base rules fail (under 50 words, or more than half of the
    words in repeated three-word windows) or a score reaches its threshold calibrated on labelled rows.

    A null text counts as empty and fails. Null doc_ids are kept and match no label; repeated rows give a row each.
    Without labels only the base rules reject. Columns of other names are not read.
    """
    counted = written(rule_counts(bare(docs, "doc_id", "text"), "doc_id"))
    scored = model_from(counted, labels).scored(counted)
    return scored.select("doc_id", *COUNTS, failed().alias("base_failed"), "score", "repeat_score", F.col("sound").alias("kept"))


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns, whatever their names. Rows are saved
    with their counts, so texts are gone through once, of any length; the model is fitted and calibrated on all of them. Null
    texts go, as they have no words; an empty table stays empty."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(text: pd.Series) -> pd.DataFrame:
        texts = texts_of(pa.array(text, pa.string(), from_pandas=True))
        parts = [count_texts(*raw(texts.slice(begin, end - begin))) for begin, end in pieces(texts)]
        return pd.DataFrame({c: np.concatenate([p[i] for p in parts]) if parts else [] for i, c in enumerate(COUNTS)})

    held = Held(docs)
    counted = written(held.df.withColumn("counts", count(F.col(held.name("text")))).select(*held.own, "counts.*"))
    model = model_from(counted.withColumnRenamed(held.name("doc_id"), "doc_id").select("doc_id", *COUNTS), labels)
    return held.named(model.scored(counted.filter(~failed())).filter("sound"))
