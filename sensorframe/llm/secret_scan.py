"""Secret scans: known forms, and a randomness test battery over encoded-looking runs. SQL functions only."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.common import Held, bare, small, text_or_empty, written


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_RUN = "A-Za-z0-9+/_-"
LEAST_RUN = 16

#: Fixed values. The kinds in the order in which spans at one place are listed; "random" is the battery's.
ASSIGN = (
    f"(?:{'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token')))}|{_either_case('api')}_?{_either_case('key')})"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "random": rf"[{_RUN}]{{{LEAST_RUN},}}={{0,2}}",
}
KINDS = tuple(PATTERNS)

#: Alphabets by which a run may be encoded, the narrowest first.
ALPHABETS = {
    "hex": ("^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^[0-9a-z]+$|^[0-9A-Z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base64": ("^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    "base64url": ("^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
}

#: Upper ends of the length classes, and the share of random runs that may be dismissed as text in each.
LENGTH_CLASSES = (24, 32, 48, 96, 1 << 62)
SHARE = 0.02
P_STEPS = 400

#: Signs of runs in the order of the tables of ``text_scores``, and what is assumed of ordinary text besides its letter
#: pairs: how often a sign's sort (letter, digit, other), small letters and capitals stay, and letter frequencies (per mille of
#: English) that weigh as much as so many words until words of the corpus outweigh them.
SIGNS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SORT_STAYS, SMALL_STAYS, CAPITAL_STAYS = 0.9, 0.85, 0.3
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
LETTERS_WEIGH = 30


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    ``spans`` lists ``kind:start:end`` in code points, end exclusive, by start and then kind. Assignments, access
    keys and hexadecimal runs are found by their form. To these the battery adds runs of at least 16 characters of
    an encoding that mix letter cases or letters and digits, as far as they lie in no other span: for the narrowest
    alphabet that fits, symbols are tested for uniform use (chi-squared), for runs about the alphabet's middle and for serial
    correlation, and their likelihood is compared with that under the letter pairs of the corpus's ordinary words, each under the
    hypothesis that they were drawn at random. The segments between signs that are such
    runs are tested as well, so that the words around a key in a path or a hyphenated name do not hide it. A run that no alphabet
    fits is no secret as a whole; its parts of one alphabet are tested likewise. The combined p-values of all runs
    and parts of the corpus are held, by length class, against a Benjamini-Hochberg limit; what it rejects is text, the others are
    secrets; those that overlap are one span.

    A null text counts as empty and has no span; its digest is that of the empty string. A null doc_id is kept.
    Repeated rows give a row each. Columns other than doc_id and text are not read.
    """
    spans = _spans(docs)
    listed = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))))
    names = F.array(*map(F.lit, KINDS))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.count(F.when(F.col("kind") == KINDS.index(kind), 1))

    grouped = spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), listed.alias("all"), *[count(k).alias(f"n_{k}") for k in KINDS])
    return grouped.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.filter("all", lambda x: x.kind < len(KINDS) - 1)), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
        "n_random",
    )


def _spans(docs: DataFrame, *keep: str) -> DataFrame:
    """(row, doc_id, kind, start, end) of all spans, and for each text a row with a null kind; with ``keep`` columns."""
    found = written(_matches(docs, *keep))
    random = F.col("kind") == len(KINDS) - 1
    spans = found.withColumn("kind", F.when(~(random & _dismissed(dismissal_limits(found))), F.col("kind")))  # a row stays for each text
    columns = ["row", "doc_id", *keep, "kind", "start", "end"]
    others = spans.withColumn("kind", F.when(~random, F.col("kind"))).select(*columns)
    return others.unionByName(_outside(spans.filter("kind is not null"), *keep).select(*columns))


def _outside(spans: DataFrame, *keep: str) -> DataFrame:
    """The stretches that runs cover and no other span does, each as one span, from sums over the ends of all spans."""
    random = F.col("kind") == len(KINDS) - 1

    def end(at: str, step: int) -> Column:
        return F.struct(F.col(at).alias("at"), F.when(random, step).otherwise(0).alias("runs"), F.when(random, 0).otherwise(step).alias("others"))

    ends = spans.select("row", "doc_id", *keep, F.explode(F.array(end("start", 1), end("end", -1))).alias("x")).select("row", "doc_id", *keep, "x.*")
    ends = ends.groupBy("row", "at").agg(*[F.first(c).alias(c) for c in ("doc_id", *keep)], F.sum("runs").alias("runs"), F.sum("others").alias("others"))
    along = Window.partitionBy("row").orderBy("at")
    before = along.rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("inside", (F.sum("runs").over(before) > 0) & (F.sum("others").over(before) == 0))
    turns = ends.withColumn("was", F.lag("inside", 1, False).over(along)).filter("inside <> was")
    # Turns alternate: each stretch begins at one and ends at the next.
    out = turns.withColumn("end", F.lead("at").over(along)).filter("inside").withColumn("start", F.col("at"))
    return out.withColumn("kind", F.lit(len(KINDS) - 1))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``secret_scan`` in text replaced by ``mask``; spans that overlap or touch become one.
    All columns as they were, whatever their names; texts without a span, nulls included, are untouched."""
    keyed = bare(docs, "doc_id", "text").withColumn("text_key", F.xxhash64(text_or_empty()))
    spans = _spans(keyed, "text_key").filter("kind is not null")
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.max("end").over(before) < F.col("start"), F.lit(True))
    number = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    joined = spans.withColumn("opens", opens).withColumn("number", number).groupBy("row", "number")
    joined = joined.agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.min("start").alias("start"), F.max("end").alias("end"))
    listed = joined.groupBy("row").agg(F.first("doc_id").alias("cut_id"), F.first("text_key").alias("cut_key"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    listed = small(written(listed.drop("row").dropDuplicates(["cut_id", "cut_key"])))

    held = Held(docs)
    text = F.col(held.name("text"))
    same = F.col(held.name("doc_id")).eqNullSafe(F.col("cut_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("cut_key"))
    count = F.size("cut")
    left = F.transform(
        F.sequence(F.lit(0), count),
        lambda i: F.substring(
            text,
            F.when(i == 0, 0).otherwise(F.get("cut", i - 1)["end"]) + 1,
            F.when(i == count, F.length(text)).otherwise(F.get("cut", i)["start"]) - F.when(i == 0, 0).otherwise(F.get("cut", i - 1)["end"]),
        ),
    )
    new = F.when(F.col("cut").isNull(), text).otherwise(F.array_join(left, mask))
    return held.named(held.df.join(listed, same, "left"), text=new)


def mixed(run: Column) -> Column:
    """Whether a run has letters and digits, or a capital after a small letter. Each pattern takes one pass: what may
    repeat is possessive and ends at the first sign that it is not for."""
    return (run.rlike("[0-9]") & run.rlike("[A-Za-z]")) | run.rlike("^[^a-z]*+[a-z][^A-Z]*+[A-Z]")


def _matches(docs: DataFrame, *keep: str) -> DataFrame:
    """(row, doc_id, kind, start, end, length, p), one row per match, and one with a null kind per text. p only for
    runs. Match positions are sums over the gaps between matches, taken along each text."""
    texts = bare(docs, "doc_id", *keep, "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", *keep, text_or_empty().alias("text"))
    none = F.expr("cast(array() as array<struct<kind:int, at:int, gap:int, hit:string>>)")

    def of(kind: str) -> Column:
        pattern = PATTERNS[kind]
        hits = F.regexp_extract_all("text", F.lit(pattern), 0)
        gaps = F.split("text", pattern, -1)
        pairs = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
        placed = F.transform(pairs, lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("at"), x.gap.alias("gap"), x.hit.alias("hit")))
        return F.when(F.col("text").rlike(pattern), F.filter(placed, lambda x: x.hit.isNotNull())).otherwise(none)

    hits = texts.select("row", "doc_id", *keep, F.explode_outer(F.concat(*[of(k) for k in KINDS])).alias("m")).select("row", "doc_id", *keep, "m.*")
    along = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("hit")
    placed = hits.withColumn("end", F.sum(F.col("gap") + length).over(along)).withColumn("start", F.col("end") - length)
    random = KINDS.index("random")
    value = F.regexp_extract("hit", ASSIGN, 1)
    failing = ((F.col("kind") == KINDS.index("assign")) & (F.length(value) < 12)) | ((F.col("kind") == random) & ~mixed(F.col("hit")))
    # A text of which every match fails still has to leave a row.
    placed = placed.withColumn("kind", F.when(~failing, F.col("kind"))).withColumn("hit", F.when(F.col("kind") == random, F.regexp_replace("hit", "=+$", "")))
    return battery(_with_parts(placed), text_scores(docs)).select("row", "doc_id", *keep, "kind", "start", "end", F.length("hit").alias("length"), "p")


def _with_parts(placed: DataFrame) -> DataFrame:
    """``placed`` and rows for those parts of its runs that are tested by themselves: the segments between signs, and,
    as a run with signs of both base64 and base64url fits no alphabet, what lies between the ones and between the
    others. Each row stays, whatever its parts."""

    def cut(level: int, signs: str) -> Column:
        return F.transform(F.split("hit", signs, -1), lambda x, i: F.struct(F.lit(level).alias("level"), i.alias("no"), x.alias("part")))

    whole = F.array(F.struct(F.lit(0).alias("level"), F.lit(0).alias("no"), F.col("hit").alias("part")))
    slashed, dashed = F.col("hit").rlike("[+/]"), F.col("hit").rlike("[_-]")
    parts = F.when(slashed & dashed, F.concat(whole, cut(1, "[_-]"), cut(2, "[+/]"), cut(3, "[+/_-]"))).when(slashed | dashed, F.concat(whole, cut(3, "[+/_-]"))).otherwise(whole)
    parts = placed.withColumn("x", F.explode(parts)).select("*", "x.*").drop("x")
    along = Window.partitionBy("row", "kind", "at", "level").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("until", F.sum(F.length("part") + 1).over(along) - 1)
    begin = F.col("start") + F.col("until") - F.length("part")
    stop = F.when(F.col("until") == F.length("hit"), F.col("end")).otherwise(F.col("start") + F.col("until"))  # "=" goes with the last part
    own = F.col("level") == 0
    once = (F.col("level") == 3) | F.col("part").rlike("[+/_-]")  # a part without signs is a segment
    parts = parts.filter(own | (once & (F.length("part") >= LEAST_RUN) & mixed(F.col("part"))))
    return parts.withColumns({"start": F.when(own, F.col("start")).otherwise(begin), "end": F.when(own, F.col("end")).otherwise(stop), "hit": F.col("part")})


def normal_upper(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution; absolute error below 1e-7 (a fixed polynomial)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def letter_pairs(docs: DataFrame) -> dict[str, int]:
    """How often each pair of letters, or "^" and a first letter, is in the different ordinary words of all texts: at
    most 27 x 26 pairs. Words are single-case or begin with a capital and stand by themselves, so that none is part of a run
    to be tested; each counts once, so that text that is repeated often does not outweigh the rest."""
    words = bare(docs, "text").select(F.explode(F.array_distinct(F.split("text", f"[^{_RUN}]+"))).alias("word"))
    words = words.filter(F.col("word").rlike("^(?:[A-Za-z][a-z]+|[A-Z]+)$")).select(F.lower("word").alias("word")).distinct()
    letters = words.select(F.split(F.concat(F.lit("^"), "word"), "").alias("x"))
    pairs = letters.select(F.explode(F.expr("transform(sequence(1, size(x) - 1), i -> concat(x[i - 1], x[i]))")).alias("pair"))
    return {r["pair"]: r["count"] for r in pairs.groupBy("pair").count().collect()}


def text_scores(docs: DataFrame) -> tuple[str, str]:
    """Log-probabilities of each of SIGNS after each other one, and before all at the start, as SQL arrays: those of
    text that mixes letter cases, where a capital after a small letter begins a word, and those of text in one case."""
    counts = letter_pairs(docs)
    letters = SIGNS[:26]
    pairs = {}
    for a in "^" + letters:
        total = sum(counts.get(a + b, 0) for b in letters) + LETTERS_WEIGH
        for b, k in zip(letters, LETTERS):
            pairs[a + b] = math.log((counts.get(a + b, 0) + LETTERS_WEIGH * k / sum(LETTERS)) / total)

    def sort(c: str) -> int:
        return 0 if c.isalpha() else 1 if c.isdigit() else 2

    def score(a: str, b: str, cased: bool) -> float:
        out = math.log(1 / 3 if not a else SORT_STAYS if sort(a) == sort(b) else (1 - SORT_STAYS) / 2)
        if not b.isalpha():
            return out - math.log(10 if b.isdigit() else 4)
        after = a.isalpha() and not (cased and a.islower() and b.isupper())
        if cased:
            stays = SMALL_STAYS if a.islower() else CAPITAL_STAYS
            out += math.log(0.5 if not a.isalpha() else stays if a.islower() == b.islower() else 1 - stays)
        return out + pairs[(a.lower() if after else "^") + b.lower()]

    return tuple(f"array({', '.join(f'{score(a, b, cased):.4f}D' for a in ['', *SIGNS] for b in SIGNS)})" for cased in (True, False))


def battery(df: DataFrame, scores: tuple[str, str]) -> DataFrame:
    """``df`` with ``p``: how well ``hit`` agrees with symbols drawn at random from the narrowest alphabet that it
    fits, against ``text_scores`` and by three tests. Null where hit is null or fits none."""
    cased = F.col("hit")
    alphabet = functools.reduce(
        lambda chain, a: chain.when(cased.rlike(a[0]), F.lit(a[1])), ALPHABETS.values(), F.when(cased.isNull(), F.lit(None))
    )
    df = df.withColumn("alphabet", alphabet)
    # Hexadecimal digits and base 36 are written in either case.
    same_case = F.when(F.length("alphabet").isin(16, 36), F.lower("hit")).otherwise(F.col("hit"))
    df = df.withColumn("cased", same_case).withColumn("symbols", F.expr("transform(split(cased, ''), c -> locate(c, alphabet) - 1)"))
    n, size = F.length("hit").cast("double"), F.length("alphabet").cast("double")
    uses = F.expr("aggregate(transform(split(alphabet, ''), a -> length(cased) - length(replace(cased, a, ''))), 0D, (s, k) -> s + k * k)")
    df = df.withColumns(
        {
            "uses": uses,
            "high": F.expr("cast(size(filter(symbols, s -> 2 * s >= length(alphabet))) as double)"),
            "turns": F.expr(
                "cast(size(filter(sequence(1, greatest(1, size(symbols) - 1)), i -> size(symbols) > 1 and"
                " (2 * symbols[i] >= length(alphabet)) <> (2 * symbols[i - 1] >= length(alphabet)))) as double)"
            ),
            "total": F.expr("aggregate(symbols, 0D, (s, k) -> s + k)"),
            "squares": F.expr("aggregate(symbols, 0D, (s, k) -> s + k * k)"),
            "products": F.expr(
                "aggregate(sequence(1, greatest(1, size(symbols) - 1)), 0D, (s, i) -> s + coalesce(symbols[i] * symbols[i - 1], 0))"
            ),
        }
    )
    chi = F.col("uses") * size / n - n
    uniform = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
    high, low = F.col("high"), n - F.col("high")
    expected = 1 + 2 * high * low / n
    spread = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
    runs = F.when(spread > 0, (F.col("turns") + 1 - expected) / F.sqrt(spread)).otherwise(0.0)
    mean = F.col("total") / n
    variance = F.col("squares") - n * mean * mean
    ends = mean * (2 * F.col("total") - F.element_at("symbols", 1) - F.element_at("symbols", -1))
    serial = F.when(variance > 0, ((F.col("products") - ends + (n - 1) * mean * mean) / variance + 1 / n) * F.sqrt(n)).otherwise(0.0)
    # Each test's statistic and the number of its tails.
    tests = F.array(*[F.struct(z.alias("z"), F.lit(k).alias("tails")) for z, k in ((uniform, 1), (F.abs(runs), 2), (F.abs(serial), 2))])
    smallest = F.array_min(F.transform("tests", lambda t: t.tails * normal_upper(t.z)))
    # How much likelier a run is as text than by random draws exceeds any x with a probability of at most 1 / x under
    # random draws, whatever its length. Text is of one case or not with the same weight; keys without "+/_-" have 62 symbols.
    df = df.withColumn("signs", F.expr(f"transform(split(hit, ''), c -> locate(c, '{SIGNS}'))"))
    mixing, single = (
        F.expr(f"aggregate(sequence(0, size(signs) - 1), 0D, (s, i) -> s + get({table}, if(i = 0, 0, signs[greatest(i - 1, 0)]) * {len(SIGNS)} + signs[i] - 1))")
        for table in scores
    )
    as_text = F.when(F.col("hit").rlike("[a-z]") & F.col("hit").rlike("[A-Z]"), mixing - math.log(2)).otherwise(single - math.log(4))
    drawn = F.when((size == 64) & ~F.col("hit").rlike("[+/_-]"), 62.0).otherwise(size)
    likelier = F.exp(F.least(F.lit(0.0), -(as_text + n * F.log(drawn))))
    # least() alone passes over nulls.
    df = df.withColumn("tests", F.when(F.col("alphabet").isNotNull(), tests))
    return df.withColumn("p", F.when(F.col("tests").isNotNull(), F.least(F.lit(1.0), 4 * F.least(smallest, likelier))))


def _class() -> Column:
    return functools.reduce(lambda chain, k: chain.when(F.col("length") < LENGTH_CLASSES[k], F.lit(k)), range(1, len(LENGTH_CLASSES)), F.when(F.col("length") < LENGTH_CLASSES[0], F.lit(0)))


def _step() -> Column:
    """p on a logarithmic grid, rounded up; a fixed number of steps from 1 down to 1e-40."""
    return F.least(F.lit(P_STEPS), F.floor(-F.log10(F.greatest("p", F.lit(1e-40))) * (P_STEPS / 40))).cast("int")


def dismissal_limits(found: DataFrame) -> dict[int, int]:
    """For each length class the least grid step at which runs are dismissed: Benjamini and Hochberg's rule over the
    counts of all runs by class and step (at most 5 x 401 rows, whatever the corpus)."""
    counts = found.filter("p is not null").groupBy(_class().alias("c"), _step().alias("s")).count().collect()
    limits = {}
    for c in range(len(LENGTH_CLASSES)):
        own = sorted(((r["s"], r["count"]) for r in counts if r["c"] == c), reverse=True)
        total, below = sum(k for _, k in own), 0
        for s, k in own:
            below += k
            if 10 ** (-s * 40 / P_STEPS) <= SHARE * below / total:
                limits[c] = s
    return limits


def _dismissed(limits: dict[int, int]) -> Column:
    out = F.col("p").isNull()
    for c, s in limits.items():
        out = out | ((_class() == c) & (_step() >= s))
    return out
