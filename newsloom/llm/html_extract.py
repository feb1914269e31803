"""Main text of web pages by minimum-cut labelling.

A page is read once into blocks: runs of text between block-level tags, each with its element. A logistic classifier gives each
block its log-odds for content from length, links, punctuation, place, heading, and the author's marks (article elements, boilerplate
elements, names such as nav or ad). Its weights are fitted on a bounded sample of the pages, whose marks serve as labels; each sampled block
counts with its marks and without them, so the other features learn what marked blocks look like. The fit is held to fixed starting
weights, which a table without marks keeps.

The log-odds, cut at MOST, become the capacities to the two terminals. Neighbouring blocks, and blocks that follow each other in one element,
are joined by smoothness edges that weaken with their distance in the tree; between neighbours in one element they weigh more than
any single cost. The maximum flow's cut separates content from boilerplate at the least total cost, so a short line inside an
article stays and a long line inside a menu goes.

A name that only ends in a bad word (right-sidebar) does not count if its element holds half of the page's prose, one that begins with it only
if it holds all of at least two paragraphs; names of headings do not count, nor do ids inside an article that are ordinary words.

Character references are decoded, white space inside a block (as str.split sees it, so also no-break spaces) becomes one space, and
the content blocks are joined by line ends in page order; nothing else is dropped or cut. A line break tag is white space.

Null, empty or tag-only html: empty text. Null url or page_id: passed on. Repeated rows come back as often as they stand. Very
long or deeply nested pages: work is linear in the tags, one row at a time is held. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Comment, declaration, tag with whole quoted values, any other tag, text. Possessive, so a tag that is not closed is tried once.
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

# Elements of HTML by their part in a page, and names that sites give to elements.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "title", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "html body head article main section nav header footer aside form fieldset div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd menu table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary dialog button select option optgroup textarea label hgroup search center legend datalist output ins".split()
)
BOILER = {"nav", "footer", "aside", "form", "button", "select", "option", "optgroup", "textarea", "label", "dialog", "menu", "fieldset", "search", "legend", "datalist", "output"}
GOOD_NAMES = set("article articlebody content main entry post story text body bodytext maincontent articletext articlecontent postcontent entrycontent storybody".split())
BAD_NAMES = set(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs crumbs footer foot header head masthead topbar toolbar sidebar side aside rail ad ads adbox adslot adsense adsbygoogle advert adverts "
    "advertisement advertising banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "signin login register share sharing social follow comment comments commentlist disqus discussion reply replies respond reader responses feedback related recommended recommendations trending popular widget widgets "
    "pagination pager paging copyright legal disclaimer skip form search searchbox contentinfo complementary banner dialog alertdialog paywall outbrain taboola hidden".split()
)
HEADERS = {"header", "head", "masthead"}
#: Bad names that are titles of sections as well.
ORDINARY = set("discussion notice notices related share sharing follow form register legal disclaimer copyright feedback reply replies responses reader trending popular search promotion subscription recommendations consent cookie cookies navigation menu side".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTED = {"ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}
#: Elements that are no container of their own.
FLOW = LISTED | HEADINGS | {"p", "blockquote", "pre", "figure", "figcaption", "hgroup", "center"}
#: Words of a paragraph at least.
PROSE = 12
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
BOUND = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}, "thead": {"table"}, "tbody": {"table"}}
#: Features of a block, and the log-odds for content from which the fit starts.
FEATURES = {
    "base": 0.2, "long": 1.5, "short": -0.8, "sentence": 0.6, "links": -3.5, "heading": 0.6, "notice": -7.0, "before prose": -0.5, "after prose": -0.5,
    "in article": 4.2, "beside article": -4.0, "boilerplate element": -12.0, "bad name": -12.0, "good name": 1.2,
}
NAMES, PRIOR = list(FEATURES), np.array(list(FEATURES.values()))
#: The last features are marks of the page's author; the fit sees every block with and without them.
MARKS = 9
#: Pages of the fit, their most characters, blocks a page, and the strength of the start.
SAMPLE, SAMPLE_LENGTH, SAMPLE_BLOCKS, HOLD, SEED = 300, 200_000, 50, 20.0, 42
#: Costs and smoothness in hundredths: a block's cost ends at MOST, so neighbours in one element (NEXT) can outvote it.
MOST, NEXT, SAME_PARENT = 300, 320, 60


class Block:
    """A run of text, its element, and its features."""

    __slots__ = ("text", "element", "x")

    def __init__(self, text: str, element: int, x: list[float]):
        self.text, self.element, self.x = text, element, x


class Page:
    """Blocks with text in page order, and the elements: parent, depth (0 is the page itself)."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parent, self.depth = [0], [0]


class _Reader:
    """One pass over a page's tags; work is linear in them, however deep elements stand in each other."""

    def __init__(self, page: str):
        self.out = Page()
        # by element: tag, inside an article, boilerplate, good name, how bad its name is, container, in a list or table
        self.tag, self.inside, self.boiler, self.good, self.bad, self.container, self.listed = [""], [False], [False], [False], [0], [0], [False]
        self.stack, self.open = [0], {}
        self.menus: list[int] = []  # places in the stack of menus, headers and forms outside an article
        self.found: list[tuple] = []  # words, linked characters, element
        self.text: list[str] = []
        self.linked, self.link_at = 0, -1
        self.read(page)

    def flush(self) -> None:
        if self.text:
            words = html.unescape("".join(self.text)).split()
            if words:
                self.found.append((words, self.linked, self.stack[-1]))
            self.text.clear()
        self.linked = 0

    def pop(self, to: int) -> None:
        self.flush()
        for e in self.stack[to:]:
            self.open[self.tag[e]] -= 1
        del self.stack[to:]
        while self.menus and self.menus[-1] >= to:
            self.menus.pop()
        if self.link_at > len(self.stack):
            self.link_at = -1

    def read(self, page: str) -> None:
        at, last, endless = 0, page.rfind(">") + 1, set()
        while at < len(page):
            m = TOKEN.match(page, at) if at < last else None
            if not m:  # no tag can end after here; one that begins is not text
                self.text.append(re.split("<[a-zA-Z/!?]", page[at:], maxsplit=1)[0])
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                piece = m[0]
                if piece[0] != "<" or piece == "<":
                    self.text.append(piece)
                    if self.link_at >= 0:
                        self.linked += len(piece.strip())
                continue
            tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if tag in RAW and not closing:
                if not attributes.endswith("/"):
                    # a name without an end is looked for once; every end before `last` has its ">"
                    end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, last)
                    if not end:
                        endless.add(tag)
                    at = end.end() if end else (len(page) if tag in ("script", "style", "title") else at)
            elif tag == "br" or tag == "wbr":
                self.text.append(" " if tag == "br" else "")
            elif tag == "hr":
                self.flush()
            elif tag in VOID or tag in RAW:
                continue
            elif tag == "a":
                self.link_at = -1 if closing else len(self.stack)
            elif closing:
                self.close(tag)
            else:
                self.begin(tag, attributes)
        self.flush()

    def close(self, tag: str) -> None:
        if self.open.get(tag):
            i = len(self.stack) - 1
            while self.tag[self.stack[i]] != tag:
                i -= 1
            self.pop(i)
        elif tag in BLOCK:
            self.flush()

    def begin(self, tag: str, attributes: str) -> None:
        up = self.stack[-1]
        good, hidden, bad = _names(tag, attributes, self.inside[up]) if attributes else (False, False, 0)
        if tag not in BLOCK and not bad and not hidden:
            return  # inline
        if tag in BLOCK:
            if self.tag[up] == "p" or tag in HEADINGS and self.tag[up] in HEADINGS:
                self.pop(len(self.stack) - 1)
            if tag in CLOSED_BY and any(self.open.get(t) for t in CLOSED_BY[tag]):
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.tag[self.stack[i]] in BOUND[tag]:
                        break
                    if self.tag[self.stack[i]] in CLOSED_BY[tag]:
                        self.pop(i)
                        break
            if tag in ("article", "main", "footer", "body") and self.menus:  # a menu, header or form that was left open ends here
                self.pop(self.menus[0])
        self.flush()
        up = self.stack[-1]
        boiler = hidden or tag in BOILER or (tag == "header" and not self.inside[up])
        if not attributes.endswith("/") or tag in BLOCK:
            e = len(self.tag)
            self.out.parent.append(up)
            self.out.depth.append(self.out.depth[up] + 1)
            self.tag.append(tag)
            self.inside.append(self.inside[up] or tag in ("article", "main"))
            self.boiler.append(self.boiler[up] or boiler)
            self.good.append(self.good[up] or good)
            self.bad.append(0 if boiler or tag in ("html", "body", "article", "main") else bad)
            self.container.append(self.container[up] if tag in FLOW else e)
            self.listed.append(self.listed[up] or tag in LISTED)
            if tag in ("nav", "header", "form", "footer") and not self.inside[e]:
                self.menus.append(len(self.stack))
            self.stack.append(e)
            self.open[tag] = self.open.get(tag, 0) + 1


def _names(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, int]:
    """Whether an element's names are good; whether it is hidden; 2 if a name begins with a bad word, 1 if it only holds one, else
    0. Inside an article, headers are its own."""
    good, hidden, bad = False, False, 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
        elif name in ("class", "id", "role"):
            names = BAD_NAMES - (HEADERS if inside else set()) - (ORDINARY if inside and name == "id" else set())
            for word in value.split():
                parts = [x for x in re.split(r"[^a-z]+", word) if x]
                whole = "".join(parts)
                if tag not in HEADINGS and not names.isdisjoint([*parts, whole]) and not word.startswith(("has-", "no-", "with-")):
                    bad = max(bad, 2 if parts[0] in names or whole in names else 1)
                elif not GOOD_NAMES.isdisjoint([*parts, whole]):
                    good = True
    return good, hidden, bad


def page_of(page: str) -> Page:
    """Blocks of a page with the features that need the whole page's prose."""
    r = _Reader(page)
    prose = [len(words) >= PROSE and linked <= 0.5 * _size(words) and not r.boiler[e] for words, linked, e in r.found]
    held = [[0, 0] for _ in r.tag]  # paragraphs and their words below each element
    ends: dict[int, list[int]] = {}  # first and last paragraph of each container
    for i, (words, _, e) in enumerate(r.found):
        if prose[i]:
            held[e][0] += 1
            held[e][1] += len(words)
            ends.setdefault(r.container[e], [i, i])[1] = i
    for e in range(len(r.tag) - 1, 0, -1):
        up = held[r.out.parent[e]]
        up[0] += held[e][0]
        up[1] += held[e][1]
    total = held[0]
    bad = [False] * len(r.tag)
    for e in range(1, len(r.tag)):
        n, size = held[e]
        counts = r.bad[e] and not (2 * size >= total[1] > 0 if r.bad[e] == 1 else n == total[0] > 1)
        bad[e] = bool(counts) or bad[r.out.parent[e]]
    main = sum(len(w) for (w, _, e), p in zip(r.found, prose) if p and r.inside[e] and not bad[e])
    has_main = 2 * main >= total[1] > 0 or (not total[1] and any(r.inside))
    span = [i for i, p in enumerate(prose) if p and not bad[r.found[i][2]]]
    begin, end = (span[0], span[-1]) if span else (0, len(r.found))
    for i, (words, linked, e) in enumerate(r.found):
        first, last = ends.get(r.container[e], (len(r.found), -1))
        between = first < i < last or (last >= 0 and r.listed[e])
        x = [
            1, len(words) >= PROSE, len(words) < 4 and not between and r.tag[e] not in HEADINGS, words[-1][-1] in ".!?…:;\"'”»)", linked > 0.5 * _size(words), r.tag[e] in HEADINGS,
            words[0][0] == "©" or words[0].lower() in ("copyright", "(c)"), i < begin and not between, i > end and not between,
            r.inside[e], has_main and not r.inside[e], r.boiler[e], bad[e], r.good[e],
        ]
        r.out.blocks.append(Block(" ".join(words), e, [float(v) for v in x]))
    return r.out


def _size(words: list[str]) -> int:
    return sum(map(len, words)) + len(words) - 1


def costs(blocks: list[Block], weights: np.ndarray = PRIOR) -> list[int]:
    """Cost in hundredths of calling a block boilerplate (positive) or content (negative): its log-odds, at most MOST."""
    if not blocks:
        return []
    odds = np.array([b.x for b in blocks]) @ weights
    return np.clip(np.rint(100 * odds), -MOST, MOST).astype(int).tolist()


def smoothness(page: Page) -> list[tuple[int, int, int]]:
    """Edges (block, block, capacity) between neighbours, weaker with their distance in the tree, and between followers in one element."""
    edges, last = [], {}
    for i, b in enumerate(page.blocks):
        if i:
            x, y, steps = page.blocks[i - 1].element, b.element, 0
            while x != y:
                if page.depth[x] >= page.depth[y]:
                    x = page.parent[x]
                else:
                    y = page.parent[y]
                steps += 1
            edges.append((i - 1, i, NEXT // (1 + steps)))
        for up, part in ((b.element, 1), (page.parent[b.element], 2)):
            j = last.get((up, part))
            if j is not None and j < i - 1:
                edges.append((j, i, SAME_PARENT // part))
            last[up, part] = i
    return edges


def marked(page: Page) -> list[tuple[list[float], int]]:
    """Features of at most SAMPLE_BLOCKS blocks whose label the page's author gives: 1 in an article, 0 in boilerplate elements and names."""
    rows = [(b.x, int(not (b.x[11] or b.x[12]))) for b in page.blocks if b.x[9] or b.x[11] or b.x[12]]
    return rows[:: max(1, -(-len(rows) // SAMPLE_BLOCKS))]


def fitted(rows: list[tuple[list[float], int]], hold: float = HOLD) -> np.ndarray:
    """Log-odds of the features by logistic regression, held to PRIOR; every row counts with its marks and without them."""
    rows = sorted((tuple(x), y) for x, y in rows)
    if not rows:
        return PRIOR
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    bare = x.copy()
    bare[:, MARKS:] = 0
    x, y, w = np.concatenate((x, bare)), np.concatenate((y, y)), PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w)), x.T @ (y - p) - hold * (w - PRIOR))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return np.round(w, 6)


def min_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the blocks on the content side of the cut of least cost; a positive score is the price of calling a block boilerplate,
    a negative score that of calling it content, an edge the price of parting its ends. Dinic's maximum flow."""
    n = len(scores)
    if all(s <= 0 for s in scores) or all(s >= 0 for s in scores):
        return [any(s > 0 for s in scores)] * n  # one side for all costs nothing
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: int, back: int) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            out[x].append(len(to))
            to.append(y)
            cap.append(c)

    source, sink = n, n + 1
    for i, s in enumerate(scores):
        if s > 0:
            arc(source, i, s, 0)
        elif s < 0:
            arc(i, sink, -s, 0)
    for a, b, c in edges:
        if c:
            arc(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, deque([source])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nth, path, x = [0] * (n + 2), [], source
        while True:
            if x == sink:
                least = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not cap[e])
                x = to[path[k] ^ 1]
                del path[k:]
            elif nth[x] < len(out[x]):
                e = out[x][nth[x]]
                if cap[e] and level[to[e]] == level[x] + 1:
                    path.append(e)
                    x = to[e]
                else:
                    nth[x] += 1
            elif path:
                x = to[path.pop() ^ 1]
                nth[x] += 1
            else:
                break


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """Main text of a page."""
    read = page_of(page or "")
    kept = min_cut(costs(read.blocks, weights), smoothness(read))
    return "\n".join(b.text for b, k in zip(read.blocks, kept) if k)


def weights_of(pages: DataFrame, html_col: str = "html") -> np.ndarray:
    """Weights fitted on the SAMPLE pages (of at most SAMPLE_LENGTH characters) whose html has the smallest seeded hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row for h in b.column(0) for row in marked(page_of(h.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.list_(pa.float64())), pa.array([y for _, y in rows], pa.int32())], ["x", "y"])

    few = pages.select(html_col).filter(F.length(html_col) <= SAMPLE_LENGTH).orderBy(F.xxhash64(html_col, F.lit(SEED))).limit(SAMPLE)
    found = few.mapInArrow(run, "x array<double>, y int").toArrow()  # at most SAMPLE * SAMPLE_BLOCKS rows
    return fitted(list(zip(found.column("x").to_pylist(), found.column("y").to_pylist())))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page. Without `weights`, they are fitted on a sample of the pages."""
    kinds = dict(pages.dtypes)
    fit = weights_of(pages, html_col) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in (b.slice(i, 200) for i in range(0, b.num_rows, 200)):
                texts = [main_text(x.as_py(), fit) for x in p.column(2)]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")


def op2_html_extract(spark, sf_dir) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
