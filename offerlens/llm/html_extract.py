"""HTML extraction by the maximum-scoring subsequence of a page's tokens.

A page is read as a sequence of words and tags. Words score positive and tags
negative; the weights come from labelled pages, those that mark their content
with exactly one ``article`` or ``main`` element: each kind of tag, and words
by the element they stand in, get the logarithm of how much more often they
occur inside than outside the marked region. One linear scan finds the
contiguous run of tokens with the largest sum, which then grows to the ends of
the blocks that it cuts into and by its neighbours that are no links. From that region the text is
read block by block, leaving out elements that never hold content (scripts,
forms, menus, notices, adverts, reader comments ...), unless they surround the
region itself.

The counts behind the weights are summed over all labelled pages; they have
one row per kind of element, of which there are at most a few hundred.

Cases: null or empty html, and pages without words, give an empty text;
elements end where HTML ends them, also without a close; stray tags, and a
page cut off anywhere, are read as far as they go; repeated rows give equal texts; an empty table gives an empty result;
columns other than the html pass through.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: FIXED VALUES: element names of HTML by their part in a page.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup
option p pre section summary table tbody td tfoot th thead title tr ul""".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
NEVER = frozenset("""aside button canvas datalist dialog footer form head header iframe input label menu nav noembed
noframes noscript object script select style svg template textarea title""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s samp small span strong sub sup time tt u var".split())
KNOWN = BLOCKS | NEVER | VOID | INLINE
#: FIXED VALUES: elements of ``NEVER`` that hold no content even where they surround the whole region.
LEAF = frozenset("""button canvas datalist head iframe input label noembed noframes noscript object script select style
svg template textarea title""".split())
#: FIXED VALUES: where HTML ends elements whose close may be left out. A block ends an open ``p``; an item ends the item
#: before it, up to the list or table around both; end tags reach no further than ``SCOPE``.
ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul""".split())
ITEMS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "optgroup": ("option", "optgroup"),
         "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"),
         **dict.fromkeys(("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot", "tr", "td", "th", "caption"))}
SCOPE = frozenset("table td th caption object template button".split())
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
#: FIXED VALUES: elements that never stand in a drawing or a formula, so they end one that was left open.
BREAKS_OUT = frozenset("""b blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu
meta ol p pre s small span strong sub sup table tt u ul var""".split())
FOREIGN = ("svg", "math")
#: FIXED VALUES: words in a class, id or role that mark an element as no part of the content; those of ``UNSURE`` only
#: where the element's own words and links agree.
NOISE = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar comment
comments cookie cookies consent notice notices newsletter subscribe subscription share sharing social related
breadcrumb breadcrumbs menu nav navigation navbar footer popup modal pagination disqus replies""".split())
UNSURE = frozenset("banner sponsor sponsored promo notice notices subscription sharing social related modal".split())
#: FIXED VALUES: words that may stand beside a noise word without changing what it says ("ad box", not "related work").
BESIDE = frozenset("""area articles bar block body bottom box button buttons card col column container content header
heading icons inner item items label left link links list main mobile module outer page panel post posts right row
section slot small stories story text title top unit widget wrap wrapper""".split())
#: Words up to which, and share of words in links from which, an element of ``UNSURE`` is none of the content.
SHORT, LINKED = 40, 0.3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: FIXED VALUES: blocks that continue a text where nothing but the page's body surrounds it.
PROSE = HEADINGS | frozenset("p blockquote figure ul ol dl table pre".split())

# Quotes only count after "="; nothing is read twice, so the time grows in proportion to the page.
TOKENS = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)"
    r"|</[^>]*+(?:>|\Z)", re.S)
MARK = re.compile(r"(?<![\w-])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])|\Z", re.I) for n in RAW}

WORD, OPEN, CLOSE = 0, 1, 2


def kind_of(name: str, attrs: str) -> str:
    """A tag's kind: its name, and whether its class, id or role marks it as noise (or says so without being sure).

    A mark is one word of the attribute that is made of noise words and such
    as may stand beside them. Ids of headings are only anchors."""
    base, unsure = name if name in KNOWN else "other", False
    if attrs:
        for m in MARK.finditer(attrs):
            if name in HEADINGS and m[1].lower() == "id":
                continue
            for mark in (m[2] or m[3] or m[4] or "").lower().split():
                words = {w for w in re.split(r"[^a-z]+", mark) if w}
                said = words & NOISE
                if said and words <= NOISE | BESIDE:
                    if not said <= UNSURE:
                        return base + ".noise"
                    unsure = True
    return base + ".unsure" if unsure else base


def tokens(page: str) -> list[tuple[int, str, str, str]]:
    """(what, name, kind, text) in page order; text runs are one WORD token each.

    The text of an OPEN token is ``/`` if the tag ends its element itself,
    which HTML allows for drawings and formulas and for what stands in them."""
    out, at, n, foreign = [], 0, len(page), ""
    while at < n:
        m = TOKENS.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            out.append((WORD, "", "", page[at:stop]))
        if not m:
            break
        at = m.end()
        name = m["name"]
        if name:
            name = name.lower()
            if m["close"]:
                out.append((CLOSE, name, name if name in KNOWN else "other", ""))
                foreign = "" if name == foreign else foreign
                continue
            attrs = m["attrs"] or ""
            if name in BREAKS_OUT:
                foreign = ""
            whole = (foreign or name in FOREIGN) and SELF_CLOSED.search(attrs)
            out.append((OPEN, name, kind_of(name, attrs), "/" if whole else ""))
            if whole:
                continue
            if name in FOREIGN:
                foreign = foreign or name
            if name in RAW_END:  # its content is no markup
                end = RAW_END[name].search(page, at)
                out.append((WORD, "", "", page[at:end.start()]))
                at = end.start()
    return out


def nesting(toks: list) -> tuple[list[str], list[int]]:
    """Per token the kind of the block around it, and for an OPEN token where its element ends.

    The end is the place of the element's own close, or of the token that
    ends it where the close was left out; elements still open end with the page."""
    around, ends = [""] * len(toks), [len(toks)] * len(toks)
    stack: list[tuple[str, str, int]] = []  # name, kind of the block, place
    open_: dict[str, int] = defaultdict(int)

    def leave(depth: int, at: int) -> None:
        while len(stack) > depth:
            name, _, place = stack.pop()
            open_[name] -= 1
            ends[place] = at

    def find(names: tuple, stop: frozenset, passing: frozenset = frozenset()) -> int:
        """Depth of the innermost open element of ``names``, not beyond one of ``stop``; -1 if there is none."""
        if any(open_[x] for x in names):
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] in names:
                    return d
                if stack[d][0] in stop and stack[d][0] not in passing:
                    break
        return -1

    for i, (what, name, kind, text) in enumerate(toks):
        if what == OPEN:
            if (open_["svg"] or open_["math"]) and name in BREAKS_OUT and not (open_["foreignobject"] or open_["desc"]):
                d = find(FOREIGN, frozenset())
                while d >= 0:
                    leave(d, i)
                    d = find(FOREIGN, frozenset())
            if name in ENDS_P and (d := find(("p",), SCOPE)) >= 0:
                leave(d, i)
            if name in ITEMS:
                while (d := find(ITEMS[name], *((frozenset(("table", "template")),) if name in TABLE else
                                                (BLOCKS | SCOPE, frozenset(("address", "div", "p", *ITEMS[name])))))) >= 0:
                    leave(d, i)
            around[i] = stack[-1][1] if stack else ""
            if name in VOID or text == "/":
                ends[i] = i
            else:
                stack.append((name, around[i] if name in INLINE else kind, i))
                open_[name] += 1
            continue
        if what == CLOSE:
            d = find((name,), frozenset(("table", "template")) - {name} if name in TABLE else SCOPE - {name})
            if d >= 0 and name in INLINE:  # it may cross others
                ends[stack[d][2]] = i
                open_[name] -= 1
                del stack[d]
            elif d >= 0:
                leave(d, i)
        around[i] = stack[-1][1] if stack else ""
    return around, ends


def scored(toks: list, around: list[str] | None = None) -> list[tuple[str, int]]:
    """(feature, number of words or 1) per token: words by the element they stand in, tags by kind."""
    around = nesting(toks)[0] if around is None else around
    return [("w:" + around[i], len(text.split())) if what == WORD else (("<" if what == OPEN else "/") + kind, 1)
            for i, (what, _, kind, text) in enumerate(toks)]


def labelled_region(toks: list) -> tuple[int, int] | None:
    """Token range inside the page's only ``article`` (or else ``main``) element."""
    for mark in ("article", "main"):
        at = [i for i, t in enumerate(toks) if t[0] == OPEN and t[1] == mark]
        ends = [i for i, t in enumerate(toks) if t[0] == CLOSE and t[1] == mark]
        if len(at) == 1 and len(ends) == 1 and at[0] < ends[0]:
            return at[0] + 1, ends[0]
    return None


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weight by feature from all labelled pages; without any, the defaults of ``weight``."""
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        inside, outside = defaultdict(int), defaultdict(int)
        for batch in batches:
            for page in batch.column(0).to_pylist():
                toks = tokens(page)
                region = labelled_region(toks)
                if region:
                    for i, (feature, n) in enumerate(scored(toks)):
                        (inside if region[0] <= i < region[1] else outside)[feature] += n
        names = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[k] for k in names], pa.int64()),
                                          pa.array([outside[k] for k in names], pa.int64())], names=["f", "i", "o"])

    marked = pages.select(html_col).where(F.regexp_like(html_col, F.lit("(?i)</(?:article|main)")))
    rows = marked.mapInArrow(count, "f string, i long, o long").groupBy("f").agg(F.sum("i"), F.sum("o")).collect()
    return {f: math.log((i + 0.5) / (o + 0.5)) for f, i, o in rows}


def weight(weights: dict[str, float], feature: str) -> float:
    """Words at least 0.01, tags at most -0.01; unseen: 1 for words, -3 for tags, and noise is worth little."""
    if feature[:2] == "w:":
        kind = feature[2:]
        unseen = 0.01 if kind.endswith((".noise", ".unsure")) or kind in NEVER else 1.0
        return max(0.01, weights.get(feature, unseen))
    return min(-0.01, weights.get(feature, -3.0))


def best_region(values: list[float]) -> tuple[int, int]:
    """The contiguous range with the largest sum: one scan; the first and shortest of equals."""
    best = total = 0.0
    start, region = 0, (0, 0)
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, region = total, (start, i + 1)
    return region


class Layout:
    """Words and linked words of any range of a page's tokens, and its elements."""

    def __init__(self, toks: list, ends: list[int]):
        self.toks, self.ends = toks, ends
        linked, upto = [False] * len(toks), -1
        for i, (what, name, _, _) in enumerate(toks):
            if what == OPEN and name == "a":
                upto = max(upto, ends[i])
            linked[i] = i < upto
        n = [len(t[3].split()) if t[0] == WORD else 0 for t in toks]
        self.words = list(accumulate(n, initial=0))
        self.linked = list(accumulate((k if x else 0 for k, x in zip(n, linked)), initial=0))

    def count(self, a: int, b: int) -> tuple[int, int]:
        """Words, and words in links, of the tokens from a to b."""
        return self.words[b] - self.words[a], self.linked[b] - self.linked[a]

    def after(self, i: int) -> int:
        """The token behind the element that opens at ``i``."""
        name, end = self.toks[i][1], self.ends[i]
        own = end < len(self.toks) and (end == i or self.toks[end][0] == CLOSE and self.toks[end][1] == name)
        return end + 1 if own else end

    def left_out(self, i: int) -> bool:
        """Whether the element that opens at ``i`` is none of the content by its name or marks."""
        _, name, kind, _ = self.toks[i]
        if name in VOID:
            return False
        if kind.endswith(".unsure"):
            n, linked = self.count(i, self.after(i))
            return n <= SHORT or linked >= LINKED * n
        return name in NEVER or kind.endswith(".noise")

    def children(self, a: int, b: int) -> list[tuple[int, int]]:
        """The elements and bare tokens between a and b, as ranges."""
        out = []
        while a < b:
            stop = self.after(a) if self.toks[a][0] == OPEN and self.toks[a][1] not in VOID else a + 1
            out.append((a, min(max(stop, a + 1), b)))
            a = out[-1][1]
        return out


def widened(layout: Layout, region: tuple[int, int]) -> tuple[int, int]:
    """The region, grown by the blocks that it cuts into and by its neighbours in the element around it.

    Kinds of block that the labelled articles lack are dear to the scan, which
    so stops before a closing list or behind a byline. A neighbour is taken if
    at most half of its words are links; what is left out anyway is passed
    over; where nothing but the body surrounds the region, only prose counts."""
    toks, ends = layout.toks, layout.ends
    first, last = region
    if first >= last:
        return region
    around, i = -1, 0
    while i < first:  # the innermost block that holds the whole region
        if toks[i][0] == OPEN and toks[i][1] not in VOID and ends[i] >= last:
            if toks[i][1] not in INLINE:
                around = i
            i += 1
        else:
            i = layout.after(i) if toks[i][0] == OPEN and layout.after(i) <= first else i + 1
    wide = around < 0 or toks[around][1] in ("html", "body")
    parts = layout.children(around + 1, ends[around] if around >= 0 else len(toks))
    inside = [k for k, (a, b) in enumerate(parts) if a < last and b > first]
    if not inside:
        return region

    def takes(k: int) -> bool | None:
        """Whether the part belongs to the text; None: it says nothing."""
        a, b = parts[k]
        what, name, _, text = toks[a]
        n, linked = layout.count(a, b)
        if what != OPEN:
            return not wide if text.strip() else None
        if layout.left_out(a) or not n:
            return None
        return 2 * linked <= n and (name in PROSE or name in INLINE or not wide)

    def grown(steps) -> int | None:
        """The last part on this side that belongs to the text."""
        found = None
        for k in steps:
            good = takes(k)
            if good is False:
                break
            found = k if good else found
        return found

    low, high = grown(range(inside[0] - 1, -1, -1)), grown(range(inside[-1] + 1, len(parts)))
    return parts[inside[0] if low is None else low][0], parts[inside[-1] if high is None else high][1]


def region_text(toks: list, region: tuple[int, int], ends: list[int], values: list[float], layout: Layout | None = None) -> str:
    """The region's blocks, one a line, without the elements that never hold content.

    A class or a form may also stand on what surrounds the content. So an
    element is kept if it opens before the region and reaches to its end, or
    if most of the region's words stand in it and it holds the page's marked
    content or, on a page without such a mark, opens before the region."""
    layout = layout or Layout(toks, ends)
    first, last = region
    worth = list(accumulate((values[i] if toks[i][0] == WORD else 0.0 for i in range(first, last)), initial=0.0))
    marked = labelled_region(toks)

    def surrounds(i: int) -> bool:
        if toks[i][1] in LEAF:
            return False
        if toks[i][1] in ("html", "body") or i < first and ends[i] >= last:
            return True
        inside = worth[min(max(ends[i], first), last) - first] - worth[max(i, first) - first]
        holds = i < marked[0] and ends[i] >= marked[1] if marked else i < first
        return holds and 2 * inside > worth[-1]

    blocks, block, i = [], [], 0
    while i < last:
        what, name, _, text = toks[i]
        if what == OPEN and layout.left_out(i) and not surrounds(i):
            if i >= first:
                blocks.append(block)
                block = []
            i = layout.after(i)
            continue
        if i >= first:
            if what == WORD:
                block.append(text)
            elif name in BLOCKS:
                blocks.append(block)
                block = []
            elif name == "br":
                block.append(" ")
        i += 1
    blocks.append(block)
    lines = (" ".join(_html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(x for x in lines if x)


def page_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    toks = tokens(page)
    around, ends = nesting(toks)
    cache: dict[str, float] = {}
    values = []
    for feature, n in scored(toks, around):
        if feature not in cache:
            cache[feature] = weight(weights, feature)
        values.append(cache[feature] * n)
    layout = Layout(toks, ends)
    return region_text(toks, widened(layout, best_region(values)), ends, values, layout)


def extract(pages: DataFrame, html_col: str = "html", weights: dict[str, float] | None = None,
            out: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html (any column of that name is replaced)."""
    weights = learn_weights(pages, html_col) if weights is None else weights
    keep = [c for c in pages.columns if c not in (html_col, out)]
    schema = pages.select(*keep).schema.add(out, "string")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [page_text(p, weights) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, out])

    return pages.select(*keep, html_col).mapInArrow(run, schema)
