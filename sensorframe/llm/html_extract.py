"""Main text of web pages by the maximum-scoring run of words and tags."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import bare, text_or_empty

#: Elements by their role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead"
    " title tr ul".split()
)
BOILERPLATE = frozenset("nav aside footer form menu head title dialog select button label iframe noscript template object svg annotation annotation-xml".split())
RAW = "script|style|textarea|noscript|template|iframe|svg|select|object|xmp|noembed|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
KNOWN = sorted(BLOCKS | BOILERPLATE | VOID | frozenset("a abbr b big cite code del em font i ins kbd mark q s small span strong sub sup tt u var".split()))
#: Words of a class, id or role that name what is not the article.
NAMED = re.compile(
    r"(?<![a-z])(?:ad|ads|advert\w*|adbox|sponsor\w*|promo\w*|banner|sidebar|side-bar|comment\w*|disqus|repl(?:y|ies)|notice\w*|cookie\w*|consent|gdpr|popup|modal"
    r"|newsletter|subscri\w*|share|sharing|social|related|recommend\w*|menu|nav|navbar|navigation|breadcrumb\w*|footer|masthead|pagination|pager|alert|search|login|signup)(?![a-z])"
)

#: Text that is named after its subject (related-work, share-of-gdp) stays: a name tells something else only if it has no
#: further words than these, and in an article an id only if it is one of few.
AROUND = frozenset("area article articles bar block body bottom box button buttons container content form group inner item items left link links list main outer panel post posts right section slot stories thread top unit widget widgets wrap wrapper".split())
IDS = frozenset("comments disqus disqus_thread sidebar newsletter breadcrumbs pagination navbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_OTHER = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<empty>{RAW})(?:/>|(?=\s)[^>]*+>(?<=[\s\"']/>))|<(?P<raw>{RAW})(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[>\"']")
_CUT = re.compile("<[!/?a-zA-Z]")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

#: What is expected of tags and words that the labelled pages do not have and nothing marks as boilerplate.
OPEN = 0.9
PRIOR = 2.0
TAG_COST, LEAST_COST, LEAST_GAIN = 4.0, 0.02, 0.001


class _Ends:
    """Where tags of a page end: at the first ">" outside of quotes. A quote without a partner is a sign like any other.
    What is found from one sign on is kept for all tags that come to it, so a page is gone through once."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.found: dict[int, int] = {}
        self.seen = (0, -1)  # between the two there is no sign but the second

    def _next(self, at: int) -> int:
        begin, sign = self.seen
        if not begin <= at <= sign:
            m = _SPECIAL.search(self.page, at)
            self.seen = at, (sign := m.start() if m else len(self.page))
        return sign

    def of(self, at: int) -> int:
        """The place of the ">" that ends the tag whose attributes begin at ``at``, or -1."""
        way, sign = [], self._next(at)
        while True:
            if sign in self.found or sign > self.last[">"]:
                end = self.found.get(sign, -1)
                break
            way.append(sign)
            c = self.page[sign]
            if c == ">":
                end = sign
                break
            partner = self.page.find(c, sign + 1) if sign < self.last[c] else sign
            sign = self._next(partner + 1)
        for sign in way:
            self.found[sign] = end
        return end


def tokens(page: str) -> Iterator[tuple[int, int, bool, str | None, bool, str]]:
    """Comments, raw elements and tags: where they begin and end, whether it is a raw element, and the name, whether
    it closes, and the attributes of a tag. What looks like a tag and never ends is text."""
    at, ends = 0, _Ends(page)
    while (begin := page.find("<", at)) >= 0:
        other = _OTHER.match(page, begin) if begin < ends.last[">"] or page.startswith(("<!", "<?"), begin) else None
        if other:
            yield begin, other.end(), bool(other["raw"] or other["empty"]), None, False, ""
            at = other.end()
            continue
        m = _TAG.match(page, begin)
        end = ends.of(m.end()) if m and begin < ends.last[">"] else -1
        if end < 0:
            at = m.end() if m else begin + 1
            continue
        yield begin, end + 1, False, m[2].lower(), bool(m[1]), page[m.end() : end]
        at = end + 1


def named_off(tag: str, attrs: str, inside: bool) -> bool:
    """Whether class, id or role name an element as no part of an article: by a token that has only such names and
    words like box or list. In an article an id does so only if it is one of few; ids of headings, which are made from
    their text, never."""
    found = [(k.lower(), v.strip("\"'").lower()) for k, v in _ATTRIBUTE.findall(attrs)]
    for k, v in found:
        if k == "id" and (tag in HEADINGS or inside or tag in CONTENT):
            if tag not in HEADINGS and tag != "section" and v in IDS:
                return True
            continue
        for token in v.split():
            words = [w for w in re.split(r"[^a-z]+", token) if w]
            if NAMED.fullmatch(token) or (any(map(NAMED.fullmatch, words)) and all(w in AROUND or NAMED.fullmatch(w) for w in words)):
                return True
    return False


def events(page: str) -> Iterator[tuple[str, str, bool]]:
    """The page as (kind, value, hidden): kind "text" has the raw text, "open" and "close" the tag. ``hidden`` says
    that it is in, or opens or ends, something that is named or marked as no part of an article."""
    stack: list[tuple[str, bool]] = []
    open_: Counter = Counter()
    hidden, at = 0, 0
    inside = 0  # open <article> and <main>
    math = 0  # open <math>, whose own tags are not the page's
    for begin, end, raw, tag, closes, attrs in tokens(page):
        if begin > at:
            yield "text", page[at:begin], hidden > 0
        at = end
        if tag is None:
            if raw:
                yield "open", "raw", True
            continue
        if closes:
            if open_[tag]:
                while True:
                    last, off = stack.pop()
                    open_[last] -= 1
                    was = hidden > 0
                    hidden -= off
                    inside -= last in CONTENT
                    formula = math > 0
                    math -= last == "math"
                    if last == tag:
                        break
                if not formula:
                    yield "close", tag, was
            elif tag in BLOCKS:
                yield "close", tag, hidden > 0
            continue
        if tag in BLOCKS and stack and stack[-1][0] in ("p", "li", "option", "dt", "dd") and (stack[-1][0] == "p" or stack[-1][0] == tag):
            last, off = stack.pop()
            open_[last] -= 1
            hidden -= off
        named = tag not in ("html", "body") and attrs.strip(" /") and named_off(tag, attrs, inside > 0)
        off = tag in BOILERPLATE or (tag == "header" and not inside) or bool(named)
        if tag != "math" and not math:
            yield "open", tag, hidden > 0 or off
        if tag not in VOID and not attrs.endswith("/"):
            stack.append((tag, off))
            open_[tag] += 1
            hidden += off
            inside += tag in CONTENT
            math += tag == "math"
    if at < len(page):
        cut = _CUT.search(page, max(at, page.rfind(">") + 1))  # a tag that the page's end cuts short
        yield "text", page[at : cut.start()] if cut else page[at:], hidden > 0


def feature(kind: str, tag: str, hidden: bool) -> str:
    known = tag if tag in _KNOWN else "?"
    return f"{'/' if kind == 'close' else ''}{known}{'!' if hidden else ''}"


_KNOWN = frozenset(KNOWN) | {"raw", ""}


def counts_of(page: str) -> Counter:
    """(feature, inside?) counts of a page labelled by its own <article> or <main>; empty without one."""
    out: Counter = Counter()
    depth, seen, block = 0, False, ""
    for kind, value, hidden in events(page):
        if kind == "text":
            n = len(value.split())
            if n:
                out[f"words {feature('open', block, hidden)}", depth > 0 and not hidden] += n
            continue
        if value in CONTENT:
            depth = max(0, depth + (1 if kind == "open" else -1))
            seen = True
            out[feature(kind, value, hidden), False] += 1
        else:
            out[feature(kind, value, hidden), depth > 0 and not hidden] += 1
        if value in BLOCKS:
            block = value if kind == "open" else ""
    return out if seen else Counter()


def weights_of(counts: dict[tuple[str, bool], float]) -> dict[str, float]:
    """For each feature the smoothed share of its uses inside an article."""
    names = {f for f, _ in counts}
    out = {}
    for f in names:
        prior = 0.0 if f.endswith("!") else OPEN
        inside, outside = counts.get((f, True), 0), counts.get((f, False), 0)
        out[f] = (inside + PRIOR * prior) / (inside + outside + PRIOR)
    return out


def main_text(page: str, weights: dict[str, float]) -> str:
    """The text of the best contiguous region. A word scores the share of its block's words that are content, a tag
    costs by how seldom it lies in content; a linear scan finds the run of greatest sum."""
    best = total = 0.0
    begin = first = last = -1
    items: list[tuple[str, bool]] = []  # (text, or "" for a break; whether it counts)
    block = ""
    for kind, value, hidden in events(page):
        if kind == "text":
            n = len(value.split())
            if n:
                f = f"words {feature('open', block, hidden)}"
                gain = weights.get(f, 0.0 if hidden else OPEN)
                total += n * max(gain, LEAST_GAIN if not hidden else 0.0)
                if total > best:
                    best, first, last = total, begin, len(items)
            items.append((value, not hidden))
            continue
        inside = weights.get(feature(kind, value, hidden), 0.0 if hidden else OPEN)
        total -= LEAST_COST + (0.0 if hidden and total > 0 else TAG_COST * (1 - inside))
        if value in BLOCKS or value == "raw":
            block = value if kind == "open" and value in BLOCKS else ""
            items.append(("", True))
        elif value == "br":
            items.append((" ", not hidden))
        if total <= 0:
            total, begin = 0.0, len(items)
    if first < 0 and best <= 0:
        return ""
    lines, line = [], []
    for value, counts in [*items[max(first, 0) : last + 1], ("", True)]:
        if value == "":
            joined = " ".join(html.unescape("".join(line)).split())
            if joined:
                lines.append(joined)
            line = []
        elif counts:
            line.append(value)
    return "\n".join(lines)


def learn_weights(pages: DataFrame, labelled: int = 5000) -> dict[str, float]:
    """Weights from labelled pages: those whose own markup says where their article is. At most ``labelled`` of them
    are read, picked by a hash of the page; features are a fixed list of tags, so their counts are few rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                total.update(counts_of(page.as_py()))
        keys = list(total)
        yield pa.record_batch(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())],
            names=["feature", "inside", "n"],
        )

    some = bare(pages, "html").filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    keys = some.select(F.xxhash64("html").alias("key"))
    bound = keys.orderBy("key").limit(labelled).agg(F.max("key")).first()[0]
    if bound is None:
        return {}
    picked = some.filter(F.xxhash64("html") <= bound)
    rows = picked.mapInArrow(count, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_of({(r.feature, r.inside): r.n for r in rows})


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Scripts, styles and comments go; menus, headers, footers, sidebars, notices, adverts, forms and reader comments,
    known by element or by their class, id or role, score nothing and are left out of the region found. Character
    references are decoded, white space within a block becomes one space, blocks are joined by a newline in page
    order. A null html, or one without a word of content, gives an empty text; null page_id and url are kept,
    repeated rows give a row each. Other columns are not read. Pages cut short anywhere, unclosed elements and stray
    tags are taken as they come.
    """
    if weights is None:
        weights = learn_weights(pages)
    own = bare(pages, "page_id", "url", "html").select("page_id", "url", text_or_empty("html").alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts = [main_text(page.as_py(), weights) for page in part.column(2)]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return own.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
