"""Engineered time-series features of a run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.functions import centred_bounds, trailing_bounds
from sensorframe.operators.layout import HALO, RunLayout, chunk_aware

# Channels, steps, window sizes and cross terms (kind, left, right), in the order
# in which the feature frame lists them. The order decides what the correlation filter keeps.
BASE_CHANNELS = ("Temp", "Hum", "MQ2", "MQ3", "MQ4", "MQ5", "MQ9", "MQ135")
GAS_CHANNELS = BASE_CHANNELS[2:]
TEXT_CHANNELS = BASE_CHANNELS[:2]
LAGS = (1, 2, 3, 4, 5)
WINDOWS = (5, 10, 20)
STATS = ("mean", "std", "min", "max")
DIFFS = (1, 2)
CROSS_TERMS = (
    ("product", "Temp", "Hum"),
    ("ratio", "MQ2", "MQ5"),
    ("product", "MQ3", "MQ135"),
    ("product", "Temp", "MQ2"),
    ("product", "Hum", "MQ9"),
    ("product", "MQ4", "MQ5"),
    ("ratio", "MQ3", "Temp"),
    ("ratio", "MQ9", "Hum"),
    ("ratio", "MQ135", "MQ2"),
    ("lag_product", "MQ2", "MQ2"),
    ("mean_ratio", "MQ9", "MQ9"),
    ("diff_product", "Temp", "MQ3"),
)
EPS = 1e-6
TERM_LAG = 1
TERM_WINDOW = 5

# Rolling windows up to this size are computed from a column for each neighbour, wider ones by doubling.
MAX_OFFSETS = 32


@dataclass(frozen=True)
class FeatureSpec:
    """Which features to make. The defaults over the eight base channels give 164 of them."""

    channels: tuple[str, ...] = BASE_CHANNELS
    lags: tuple[int, ...] = LAGS
    windows: tuple[int, ...] = WINDOWS
    stats: tuple[str, ...] = STATS
    diffs: tuple[int, ...] = DIFFS
    cross: tuple[tuple[str, str, str], ...] = CROSS_TERMS
    eps: float = EPS
    centred: bool = True

    def bounds(self, size: int) -> tuple[int, int]:
        return centred_bounds(size) if self.centred else trailing_bounds(size)

    def reach(self) -> tuple[int, int]:
        """How many rows before and after a row its features look at."""
        sizes = [*self.windows, *([TERM_WINDOW] if any(k == "mean_ratio" for k, _, _ in self.cross) else [])]
        spans = [self.bounds(n) for n in sizes]
        steps = [*self.lags, *self.diffs, *([TERM_LAG] if self.cross else [])]
        return max([0, *steps, *[b for b, _ in spans]]), max([0, *[a for _, a in spans]])

    def features(self) -> list[Feature]:
        """Every engineered feature, in frame order."""
        made = [Feature(f"{c}_lag{k}", "lag", c, size=k) for c in self.channels for k in self.lags]
        made += [
            Feature(f"{c}_roll_{stat}_{n}", "rolling", c, size=n, stat=stat)
            for c in self.channels
            for n in self.windows
            for stat in self.stats
        ]
        made += [Feature(f"{c}_diff{k}", "diff", c, size=k) for c in self.channels for k in self.diffs]
        patterns = {
            "product": "{a}_x_{b}",
            "ratio": "{a}_div_{b}",
            "lag_product": "{a}_x_{b}_lag" + str(TERM_LAG),
            "mean_ratio": "{a}_div_{b}_roll_mean_" + str(TERM_WINDOW),
            "diff_product": "{a}_x_{b}_diff" + str(TERM_LAG),
        }
        return made + [Feature(patterns[kind].format(a=a, b=b), kind, a, b) for kind, a, b in self.cross]

    def names(self) -> list[str]:
        return [*self.channels, *[f.name for f in self.features()]]


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str
    channel: str
    other: str | None = None
    size: int = 0
    stat: str | None = None

    def uses(self, channels: set[str]) -> bool:
        return self.channel in channels or self.other in channels


def _nearest(channel: str, cell: Callable[[str, int], str], before: int, after: int) -> str:
    """The known value closest to the row, within the window."""
    steps = sorted(range(-before, after + 1), key=abs)
    return f"coalesce({', '.join(cell(channel, k) for k in steps)})" if len(steps) > 1 else cell(channel, 0)


def _rolling(
    df: DataFrame, spec: FeatureSpec, wanted: dict[tuple[str, int, str], str], neighbours: dict[tuple[str, int], str]
) -> DataFrame:
    """Replace columns of neighbours, given as (channel, offset) -> name, by rolling statistics, given as
    (channel, size, stat) -> name.

    Spark evaluates a sliding frame anew for every row: all aggregates times the frame's rows.
    Here sums, counts and extremes of a wider window build on those of the next narrower one, all in one projection
    in which Spark evaluates what they share once. Missing neighbours are skipped.
    Sums are taken of distances from the nearest known value: as that value is in the window, the
    square of the sum is at most the window's size times the squared deviations, so their
    difference keeps its digits.
    """
    channels = list(dict.fromkeys(c for c, _, _ in wanted))
    small = {c: sorted({n for x, n, _ in wanted if x == c}) for c in channels}
    short = {c: f"_r{i}" for i, c in enumerate(channels)}
    sums = [c for c in channels if any(x == c and n in small[c] and stat in ("mean", "std") for x, n, stat in wanted)]
    columns = [f"`{c}`" for c in df.columns if c not in neighbours.values()]

    def cell(c: str, k: int) -> str:
        return f"`{c}`" if k == 0 else neighbours[c, k]

    out = df.selectExpr("*", *[f"{_nearest(c, cell, *spec.bounds(small[c][-1]))} AS {short[c]}_near" for c in sums])
    parts, named = [], []
    for c in channels:
        stats = {stat for x, _, stat in wanted if x == c}
        inner, made, near = range(0), {}, f"{short[c]}_near"
        for n in small[c]:
            before, after = spec.bounds(n)
            span = range(-before, after + 1)
            fresh = [cell(c, k) for k in span if k not in inner]
            this = f"{short[c]}_{n}"
            on = {part: [f"({x})"] for part, x in made.items()}
            if c in sums:
                known = [f"if({x} IS NULL, 0, 1)" for x in fresh]
                away = [f"coalesce({x} - {near}, 0D)" for x in fresh]
                made["n"] = " + ".join([*on.get("n", []), *known])
                made["sum"] = " + ".join([*on.get("sum", []), *away])
                if "std" in stats:
                    squares = [f"coalesce(({x} - {near}) * ({x} - {near}), 0D)" for x in fresh]
                    made["squares"] = " + ".join([*on.get("squares", []), *squares])
            for part, f in (("min", "least"), ("max", "greatest")):
                if part in stats:
                    cells = [*on.get(part, []), *fresh]
                    made[part] = f"{f}({', '.join(cells)})" if len(cells) > 1 else cells[0]
            parts += [f"{x} AS {this}_{part}" for part, x in made.items()]
            result = {
                "mean": f"{near} + {this}_sum / {this}_n",
                "std": f"if({this}_n > 1, sqrt(greatest({this}_squares - {this}_sum * {this}_sum / {this}_n, 0D)"
                f" / ({this}_n - 1)), NULL)",
                "min": f"{this}_min",
                "max": f"{this}_max",
            }
            result["mean"] = f"if({this}_n > 0, {result['mean']}, NULL)"
            named += [f"{result[stat]} AS `{wanted[c, n, stat]}`" for stat in STATS if (c, n, stat) in wanted]
            inner = span
    kept = [f"{short[c]}_near" for c in sums]
    return out.selectExpr(*columns, *kept, *parts).selectExpr(*columns, *named)


def _merged(a: str, b: str) -> dict[str, str]:
    """Count, mean and squared deviations of two sets of values from those of each (columns ``a_n``, ``a_mean`` ...)."""
    n = f"({a}_n + {b}_n)"
    apart = f"({b}_mean - {a}_mean)"
    return {
        "n": n,
        "mean": f"if({n} > 0, {a}_mean + {apart} * {b}_n / {n}, 0D)",
        "squares": f"{a}_squares + {b}_squares + if({n} > 0, {apart} * {apart} * {a}_n * {b}_n / {n}, 0D)",
    }


def _doubled(df: DataFrame, layout: RunLayout, spec: FeatureSpec, wanted: dict[tuple[str, int, str], str]) -> DataFrame:
    """Add rolling statistics over windows of any size: the cost grows with the logarithm of the size.

    At level k each row knows count, mean, squared deviations and extremes of the 2^k rows from itself on, merged from
    two rows of the level below. A window of n rows is put together from one row for each bit of n; for extremes two
    stretches that overlap will do. What a row has looks ahead, and a window takes it from its first row. Windows that begin before
    the run take the running value at their last row, or the whole run's if they end after it as well.
    """
    channels = list(dict.fromkeys(c for c, _, _ in wanted))
    sizes = sorted({n for _, n, _ in wanted})
    stats = {(c, n): {s for x, m, s in wanted if (x, m) == (c, n)} for c, n, _ in wanted}
    moments = {c: any({"mean", "std"} & stats.get((c, n), set()) for n in sizes) for c in channels}
    extremes = {c: [s for s in ("min", "max") if any(s in stats.get((c, n), ()) for n in sizes)] for c in channels}
    pick = {"min": "least", "max": "greatest"}
    parts = ("n", "mean", "squares")
    now, acc = {c: f"_d{i}" for i, c in enumerate(channels)}, {}
    over, columns = layout.over(), [f"`{c}`" for c in df.columns]

    def fetch(column: str, step: int) -> str:
        return column if step == 0 else f"{'lead' if step > 0 else 'lag'}({column}, {abs(step)}) {over}"

    first = []
    for c in channels:
        if moments[c]:
            first += [f"if(`{c}` IS NULL, 0D, 1D) AS {now[c]}_n", f"coalesce(CAST(`{c}` AS DOUBLE), 0D) AS {now[c]}_mean", f"0D AS {now[c]}_squares"]
        first += [f"`{c}` AS {now[c]}_{s}" for s in extremes[c]]
    out = df.selectExpr("*", *first)
    for level in range(sizes[-1].bit_length()):
        step = 1 << level
        # What sizes with this bit take from this level, and what the next level takes from it.
        ahead, kept = [], []
        for i, c in enumerate(channels):
            for n in sizes:
                if (c, n) in stats and n & step and moments[c]:
                    off = n & (step - 1)
                    ahead += [f"coalesce({fetch(f'{now[c]}_{p}', off)}, 0D) AS _p{i}_{n}_{p}" for p in parts]
                if (c, n) in stats and n.bit_length() - 1 == level:
                    ahead += [f"{pick[s]}({now[c]}_{s}, {fetch(f'{now[c]}_{s}', n - step)}) AS _w{i}_{n}_{s}" for s in extremes[c]]
            if sizes[-1] >= 2 * step:
                ahead += [f"coalesce({fetch(f'{now[c]}_{p}', step)}, 0D) AS _x{i}_{p}" for p in parts if moments[c]]
                ahead += [f"{pick[s]}({now[c]}_{s}, {fetch(f'{now[c]}_{s}', step)}) AS _x{i}_{s}" for s in extremes[c]]
        out = out.selectExpr("*", *ahead)
        for i, c in enumerate(channels):
            for n in sizes:
                if (c, n) not in stats:
                    continue
                if n & step and moments[c]:
                    new = _merged(acc[c, n], f"_p{i}_{n}") if (c, n) in acc else {p: f"_p{i}_{n}_{p}" for p in parts}
                    acc[c, n] = f"_a{i}_{n}_{level}"
                    kept += [f"{x} AS {acc[c, n]}_{p}" for p, x in new.items()]
                elif (c, n) in acc:
                    kept += [f"{acc[c, n]}_{p}" for p in parts]
                if n.bit_length() - 1 <= level:
                    kept += [f"_w{i}_{n}_{s}" for s in extremes[c]]
            if sizes[-1] >= 2 * step:
                new = _merged(now[c], f"_x{i}") if moments[c] else {}
                now[c] = f"_d{i}_{level + 1}"
                kept += [f"{x} AS {now[c]}_{p}" for p, x in new.items()] + [f"_x{i}_{s} AS {now[c]}_{s}" for s in extremes[c]]
        out = out.selectExpr(*columns, *kept)

    # Values of whole stretches, then running ones and those of the run for windows that begin before it.
    plain = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    place, running, values = [f"row_number() {over} AS _at", f"count(1) {layout.over(None, None)} AS _rows"], [], []
    for (c, n, stat), name in wanted.items():
        i = channels.index(c)
        if stat in ("min", "max"):
            place.append(f"_w{i}_{n}_{stat} AS `_s_{name}`")
        elif stat == "mean":
            place.append(f"if({acc[c, n]}_n > 0, {acc[c, n]}_mean, NULL) AS `_s_{name}`")
        else:
            place.append(f"if({acc[c, n]}_n > 1, sqrt({acc[c, n]}_squares / ({acc[c, n]}_n - 1)), NULL) AS `_s_{name}`")
    used = list(dict.fromkeys((c, stat) for c, _, stat in wanted))
    for c, stat in used:
        k = channels.index(c)
        running += [f"{plain[stat]}(`{c}`) {layout.over(None, 0)} AS _r{k}_{stat}", f"{plain[stat]}(`{c}`) {layout.over(None, None)} AS _all{k}_{stat}"]
    out = out.selectExpr(*columns, *place, *running)
    for (c, n, stat), name in wanted.items():
        before, after = spec.bounds(n)
        k = channels.index(c)
        early = f"if(_at + {after} <= _rows, {fetch(f'_r{k}_{stat}', after)}, _all{k}_{stat})"
        values.append(f"if(_at > {before}, {fetch(f'`_s_{name}`', -before)}, {early}) AS `{name}`")
    return out.selectExpr(*columns, *values)


def _expression(
    f: Feature, layout: RunLayout, spec: FeatureSpec, fill_start: bool, lag: Callable[[str, int], str], named: Callable[[str], str]
) -> str:
    """SQL of a feature that is not a rolling statistic. With ``fill_start`` the rows at the start
    of a run, where a lag or difference has no value yet, take the first one there is. ``named`` gives a window
    function's column."""
    a, b = f"`{f.channel}`", f"`{f.other}`"

    def nth(c: str, k: int) -> str:
        return named(f"nth_value({c}, {k}) {layout.over(None, None)}")

    k, second = f.size or TERM_LAG, TERM_LAG + 1
    if f.kind == "lag":
        rows = named(f"count(1) {layout.over(None, None)}") if fill_start else ""
        first = f"if({rows} > {k}, {nth(a, 1)}, NULL)" if fill_start else ""
        return f"coalesce({lag(a, k)}, {first})" if fill_start else lag(a, k)
    if f.kind == "diff":
        first = f"{nth(a, k + 1)} - {nth(a, 1)}" if fill_start else ""
        return f"coalesce({a} - {lag(a, k)}, {first})" if fill_start else f"{a} - {lag(a, k)}"
    if f.kind == "product":
        return f"{a} * {b}"
    if f.kind == "ratio":
        return f"try_divide({a}, {b} + {spec.eps!r}D)"
    if f.kind == "lag_product":
        first = f"{nth(a, second)} * {nth(b, 1)}" if fill_start else ""
        return f"coalesce({a} * {lag(b, k)}, {first})" if fill_start else f"{a} * {lag(b, k)}"
    if f.kind == "diff_product":
        first = f"{nth(a, second)} * ({nth(b, second)} - {nth(b, 1)})" if fill_start else ""
        return f"coalesce({a} * ({b} - {lag(b, k)}), {first})" if fill_start else f"{a} * ({b} - {lag(b, k)})"
    raise ValueError(f.kind)


@chunk_aware
def engineer(
    df: DataFrame,
    layout: RunLayout,
    spec: FeatureSpec = FeatureSpec(),
    only: Sequence[str] | None = None,
    fill_start: bool = False,
) -> DataFrame:
    """Append the features of ``spec`` (or those named in ``only``). All windows share one
    partitioning and order, so the whole set costs one exchange and one sort. A chunk of a cut run comes with the
    rows beside it; any that lack a lag also have the start of the run with them."""
    features = [f for f in spec.features() if only is None or f.name in only]
    if not features:
        return df
    before, after = spec.reach()
    if fill_start:  # the rows at the start of a run look at those whose lag they take
        after = max(after, before + 1)
    source = layout.dealt(layout.with_halo(df, before, after)) if layout.chunked else df
    rolling = {(f.channel, f.size, f.stat): f.name for f in features if f.kind == "rolling"}
    ratios = [f for f in features if f.kind == "mean_ratio"]
    for f in ratios:
        rolling.setdefault((f.other, TERM_WINDOW, "mean"), f"_mean_{f.other}")
    simple = [f for f in features if f.kind not in ("rolling", "mean_ratio")]
    small = {key: name for key, name in rolling.items() if key[1] <= MAX_OFFSETS}
    sizes = {c: max(n for x, n, _ in small if x == c) for c, _, _ in small}
    stepped = [c for f in simple for c in (f.channel, f.other) if f.kind in ("lag", "diff", "lag_product", "diff_product") and c]
    places = {c: f"_r{i}" for i, c in enumerate(dict.fromkeys([*sizes, *stepped]))} if small else {}
    fetched: dict[str, str] = {}

    def cell(c: str, k: int) -> str:
        return f"`{c}`" if k == 0 else f"get(_around, _at + {k}).{places[c]}"

    def named(window: str) -> str:
        return fetched.setdefault(window, f"_f{len(fetched)}")

    def lag(c: str, k: int) -> str:
        return cell(c.strip("`"), -k) if places and k <= MAX_OFFSETS else named(f"lag({c}, {k}) {layout.over()}")

    columns = [f"`{c}`" for c in source.columns]
    made = [f"{_expression(f, layout, spec, fill_start, lag, named)} AS `{f.name}`" for f in simple]
    neighbours, out = {}, source
    if places:
        steps = [f.size or TERM_LAG for f in simple if f.kind not in ("product", "ratio")]
        back = max([*[spec.bounds(n)[0] for n in sizes.values()], *[k for k in steps if k <= MAX_OFFSETS]])
        ahead = max(spec.bounds(n)[1] for n in sizes.values())
        out = out.selectExpr("*", f"struct({', '.join(f'`{c}` AS {x}' for c, x in places.items())}) AS _cells")
        fetched |= {f"collect_list(_cells) {layout.over(back, ahead)}": "_around", f"least(row_number() {layout.over()} - 1, {back})": "_at"}
        for c, n in sizes.items():
            low, high = spec.bounds(n)
            neighbours |= {(c, k): f"{places[c]}_{'p' if k < 0 else 'n'}{abs(k)}" for k in range(-low, high + 1) if k}
    if fetched:
        out = out.selectExpr(*columns, *[f"{window} AS {name}" for window, name in fetched.items()])
    out = out.selectExpr(*columns, *made, *[f"{cell(*at)} AS {name}" for at, name in neighbours.items()])
    if small:
        out = _rolling(out, spec, small, neighbours)
    if len(small) < len(rolling):
        out = _doubled(out, layout, spec, {key: name for key, name in rolling.items() if key not in small})
    over_mean = {f.name: rolling[f.other, TERM_WINDOW, "mean"] for f in ratios}
    shown = [
        f"try_divide(`{f.channel}`, `{over_mean[f.name]}` + {spec.eps!r}D) AS `{f.name}`"
        if f.name in over_mean
        else f"`{f.name}`"
        for f in features
    ]
    if layout.chunked:
        out = out.where(~F.col(HALO))
    return out.selectExpr(*[f"`{c}`" for c in df.columns], *shown)


def gap_columns(spec: FeatureSpec, layout: RunLayout, repaired: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Which columns may have gaps anywhere, and which only at the start of a run.

    Decided from the layout's column profile, without computing the features. A repaired channel
    has no gaps but in runs without any value, which no interpolation can mend; its rounding
    also keeps it off the one value that makes a guarded denominator 0.
    """
    holes = set(layout.gappy) - set(repaired)
    may_be_zero = {c for c in spec.channels if c in layout.negative and c not in repaired}
    anywhere = [c for c in spec.channels if c in holes]
    leading: list[str] = []
    for f in spec.features():
        by_zero = f.kind in ("ratio", "mean_ratio") and f.other in may_be_zero
        lone_value = f.stat == "std" and spec.bounds(f.size)[1] == 0
        if f.uses(holes) or by_zero or lone_value:
            anywhere.append(f.name)
        elif f.kind in ("lag", "diff", "lag_product", "diff_product"):
            leading.append(f.name)
    return anywhere, leading


def telling_columns(spec: FeatureSpec, holes: Sequence[str]) -> list[str]:
    """Columns that are all known in a row of the interpolated frame only if every column is.

    After interpolation a column is missing in a whole run or nowhere. If the longest lag has a
    value in a run, so have the shorter ones; means and extremes are known where the channel is;
    so are deviations where a difference is, but for channels with ``holes``, whose narrowest
    deviation tells about the wider ones.
    """
    longest, narrowest = max(spec.lags, default=None), min(spec.windows, default=None)
    made = spec.features()
    return [
        *spec.channels,
        *[f.name for f in made if f.kind == "lag" and f.size == longest],
        *[f.name for f in made if f.stat == "std" and f.size == narrowest and (f.channel in holes or not spec.diffs)],
        *[f.name for f in made if f.kind not in ("lag", "rolling")],
    ]


def feature_columns(
    columns: Sequence[str],
    channels: Sequence[str] = BASE_CHANNELS,
    also: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> list[str]:
    """Column names to learn from: the channels, then every column whose name contains
    ``"{channel}_"`` or is listed in ``also``, each once, in frame order, minus ``exclude``."""
    matching = [c for c in columns if any(f"{ch}_" in c for ch in channels) or c in also]
    return [c for c in dict.fromkeys([*channels, *matching]) if c not in exclude]


def project(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` plus those of ``wanted`` that the frame has."""
    present = set(df.columns)
    return df.select(*[f"`{c}`" for c in [*keep, *[c for c in wanted if c in present]]])
