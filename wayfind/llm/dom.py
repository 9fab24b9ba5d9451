"""HTML to a tree of block elements and the texts in them.

Inline elements make no nodes: their text belongs to the block around them. What follows from an element's name alone (scripts,
menus, forms and the like), or from the words of its class, id or role, marks its whole subtree as boilerplate, whose text
is not kept. End tags that are missing are implied as browsers do for paragraphs, list items and table cells; an end tag
that closes nothing is ignored. A tag or comment that isn't closed goes on to the end. Elements below DEEP levels belong to
the block at that level.
"""

import re
from html import unescape

from wayfind.llm.common import by_value

by_value(__name__)

DEEP = 64
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
RAW = set("script style title textarea iframe noembed noframes noscript template svg math xmp object canvas audio video select button datalist map".split())
GONE = set("nav footer aside form head menu dialog fieldset".split())  # elements that never hold main text
ENDS_P = set("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table td th tr ul".split())
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
FLOW = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr address center".split())  # one kind of node where they have no class
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner sponsor sponsored promo promos promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter "
    "subscribe subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead topbar toolbar share sharing social related recommended recommendations comment comments commentlist disqus "
    "respond replies reply pagination pager widget widgets search copyright disclaimer adsbygoogle".split()
)
UNLESS = set("has with no without is show hide not".split())  # a word before another that makes it a property of the page

TOKEN = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+[^>=]*+)*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

PLAIN, BOILER, MAIN, ARTICLE, HEADER, HEADING = 0, 1, 2, 4, 8, 16
_known: dict = {}


def named(value: str, among: set) -> bool:
    """Whether the first or last word of a class or id is one of ``among``."""
    for token in value.split():
        words = WORD.findall(CAMEL.sub("-", token).lower())
        if words and words[0] not in UNLESS and (words[0] in among or words[-1] in among):
            return True
    return False


def element(tag: str, raw: str, by_words: bool) -> tuple[str, int]:
    """(signature, flags) of a start tag."""
    key = tag, raw, by_words
    if (hit := _known.get(key)) is not None:
        return hit
    at = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(raw)} if raw else {}
    names = f"{at.get('class', '')} {at.get('id', '')}"
    sig = " ".join([tag, *sorted(set(re.sub(r"\d+", "", names).lower().split()))])
    if sig == tag and tag in FLOW:
        sig = "flow"
    role, flags = at.get("role", "").lower(), PLAIN
    if tag == "article" or role == "article" or at.get("itemprop") == "articleBody":
        flags |= ARTICLE
    elif tag == "main" or role == "main":
        flags |= MAIN
    if tag == "header" or (by_words and tag not in ("html", "body", "main") and named(names, {"header"})):
        flags |= HEADER
    if tag in HEADINGS:
        flags |= HEADING
    if tag in GONE or role in ROLES or "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", at.get("style", "")):
        flags |= BOILER
    if by_words and tag not in ("html", "body", "main") and named(names, WORDS):
        flags |= BOILER
    if len(_known) > 20_000:
        _known.clear()
    _known[key] = sig, flags
    return sig, flags


class Page:
    """nodes: (parent, signature, flags), each after its parent, the first the root; what is inside boilerplate has its flag too.
    blocks: (node, text, characters of it in links), in page order, none of boilerplate. A header outside the article is boilerplate, and of
    one in it only headings count."""

    def __init__(self, html: str, by_words: bool = True):
        self.nodes: list[tuple[int, str, int]] = [(-1, "html", PLAIN)]
        self.blocks: list[tuple[int, str, int]] = []
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.parts: list[str] = []
        self.links, self.in_link, self.skip = 0, False, ""
        at, size = 0, len(html)
        while at < size:
            m = TOKEN.search(html, at)
            begin = m.start() if m else size
            if begin > at and not self.skip and not self.nodes[self.open[-1][1]][2] & BOILER:
                s = html[at:begin]
                s = unescape(s) if "&" in s else s
                self.parts.append(s)
                if self.in_link:
                    self.links += len(s.strip())
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
            elif tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at) if not m[3].endswith("/") else None
                if close or not m[3].endswith("/"):
                    at = close.start() if close else size
            else:
                self.start(tag, m[3], by_words)
        self.flush()

    def flush(self) -> None:
        """End the block that is being read."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            flags = self.nodes[self.open[-1][1]][2]
            if text and (not flags & HEADER or flags & HEADING):
                self.blocks.append((self.open[-1][1], text, min(self.links, len(text))))
            self.parts = []
        self.links, self.in_link, self.skip = 0, False, ""

    def start(self, tag: str, raw: str, by_words: bool) -> None:
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "a":
                self.in_link = True
            if raw and not self.skip and tag not in VOID and element(tag, raw, by_words)[1] & BOILER:
                self.skip = tag
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        self.flush()
        if tag in ("html", "body"):
            self.close(("head",))
            if tag == "html" or any(t == "body" for t, _ in self.open):
                return
        elif self.open[-1][0] == "head":
            self.open.pop()
        if tag in ENDS_P and self.open[-1][0] == "p":
            self.open.pop()
        if tag in HEADINGS and self.open[-1][0] in HEADINGS:
            self.open.pop()
        if tag in SAME:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in WITHIN[tag]:
                    break
                if self.open[k][0] in SAME[tag]:
                    del self.open[k:]
                    break
        parent = self.open[-1][1]
        sig, flags = element(tag, raw, by_words)
        above = self.nodes[parent][2]
        if flags & HEADER and not above & (ARTICLE | MAIN):
            flags |= BOILER
        inherited = above & (BOILER | ARTICLE | MAIN | HEADER)
        if len(self.open) > DEEP:
            self.open.append((tag, parent))
            return
        self.nodes.append((parent, sig, flags | inherited))
        self.open.append((tag, len(self.nodes) - 1))

    def close(self, tags) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                del self.open[k:]
                return

    def end(self, tag: str) -> None:
        if tag in INLINE:
            if tag == self.skip:
                self.skip = ""
            if tag == "a":
                self.in_link = False
            elif tag == "br":
                self.parts.append(" ")
            return
        self.flush()
        if tag not in ("html", "body"):
            self.close((tag,))


Tree = list  # [signature, pages, children, page nodes]


def matched(a: Tree, b: Tree, memo: dict):
    """Simple tree matching of two trees with one signature: the most pairs of nodes, in order and under paired parents, and the
    pairs (i, j) of children."""
    key = id(a), id(b)
    if key in memo:
        return memo[key]
    left, right, pairs = a[2], b[2], []
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, p in enumerate(left, 1):
        for j, q in enumerate(right, 1):
            pair = best[i - 1][j - 1] + matched(p, q, memo)[0] if p[0] == q[0] else 0
            best[i][j] = max(best[i - 1][j], best[i][j - 1], pair)
    i, j = len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    pairs.reverse()
    score = 1 + sum(matched(left[i], right[j], memo)[0] for i, j in pairs)
    memo[key] = score, pairs
    return memo[key]


def merge(a: Tree, b: Tree, memo: dict | None = None) -> None:
    """Make ``a`` hold ``b`` too: paired nodes become one, and others come behind the pair before them."""
    memo = {} if memo is None else memo
    _, pairs = matched(a, b, memo)
    a[1] += b[1]
    a[3] = a[3] + b[3]
    new, at, last = [], 0, 0
    for i, j in [*pairs, (len(a[2]), len(b[2]))]:
        new += a[2][at:i] + b[2][last:j]
        if i < len(a[2]):
            merge(a[2][i], b[2][j], memo)
            new.append(a[2][i])
        at, last = i + 1, j + 1
    a[2] = folded(new)


def folded(children: list[Tree]) -> list[Tree]:
    """Children in which neighbours with one signature are one node."""
    out: list[Tree] = []
    for c in children:
        if out and out[-1][0] == c[0]:
            merge(out[-1], c)
        else:
            out.append(c)
    return out


def skeleton(page: Page) -> Tree:
    """The tree of a page without texts: neighbours with one signature are one node, and what is in flowing text or boilerplate is
    part of its topmost node."""
    own: list[list[int]] = [[] for _ in page.nodes]
    for k, (parent, _, _) in enumerate(page.nodes):
        if parent >= 0:
            own[parent].append(k)

    def inside(k: int) -> list[int]:
        out, todo = [], [k]
        while todo:
            x = todo.pop()
            out.append(x)
            todo += own[x]
        return out

    def tree(k: int) -> Tree:
        _, sig, flags = page.nodes[k]
        if sig == "flow" or flags & BOILER:
            return [sig, 1, [], inside(k)]
        node = [sig, 1, folded([tree(c) for c in own[k]]), [k]]
        return node

    root = tree(0)
    once(root)
    return root


def once(tree: Tree) -> None:
    """Count one page for each node, however many of its elements are in it."""
    tree[1] = 1
    for c in tree[2]:
        once(c)


def bare(tree: Tree, counts: bool = False) -> list:
    """Signatures, page counts if asked for, and children, for JSON."""
    return [tree[0], *([tree[1]] if counts else []), [bare(c, counts) for c in tree[2]]]


def grown(bare_: list, n: int | None = None) -> Tree:
    """A tree from what bare() gives; ``n`` is the page count of trees without counts."""
    if n is None:
        return [bare_[0], bare_[1], [grown(c) for c in bare_[2]], []]
    return [bare_[0], n, [grown(c, n) for c in bare_[1]], []]


def numbered(tree: Tree) -> list[Tree]:
    """Nodes, each after its parent; a node's number is its place."""
    out = [tree]
    for c in tree[2]:
        out += numbered(c)
    return out


def aligned(template: Tree, page: Tree, number: dict[int, int]) -> list[tuple[Tree, int]]:
    """(node of the page's tree, number of the template's node) of all nodes: -1 for one without a partner."""
    memo: dict = {}
    out = []

    def walk(a: Tree | None, b: Tree):
        out.append((b, -1 if a is None else number[id(a)]))
        pairs = {} if a is None else {j: i for i, j in matched(a, b, memo)[1]}
        for j, c in enumerate(b[2]):
            walk(a[2][pairs[j]] if j in pairs else None, c)

    walk(template, page)
    return out
