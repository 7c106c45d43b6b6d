"""Main text of web pages by wrapper induction.

Pages of a host are dealt to blocks; in a block the pages' DOM trees are aligned with a reference tree by simple tree
matching. A text that almost all pages have at the same node is template; slots whose texts vary are content. Parts
that name themselves as furniture (navigation, footers, adverts, forms, comments ...) never count as content, and
where a page marks its article, content lies there.

Every page is aligned; a block holds about BLOCK pages, so a host with a third of all pages is many groups.

Defined cases: a null or empty html has an empty text; a null url belongs to the empty host; broken markup is read as
far as it goes, and an unfinished tag at the end is dropped; copies of an article vote once for a template, and so do
near copies for what makes up most of a page or has fewer than CONSTANT_PAGES voters; repeated rows get a row each; an empty table gives an
empty result; other columns may have any name.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import cut, table
from tallyflow.llm.url_rules import host_of

BLOCK = 64
#: A text is template on this share of the aligned pages, and of this many at least; of fewer pages, on all.
CONSTANT_SHARE, CONSTANT_PAGES = 0.8, 5
#: Pairs of nodes in two lists of children that are scored each with each; larger lists meet in order, see Matcher.
WORK = 1 << 20
#: Pages whose other texts share this much of their words are near copies; with fewer words than this a page has no vote.
COPY_SHARE, OWN_WORDS = 0.5, 5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag ends open elements of these kinds, up to the scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
P_SCOPE = frozenset({"button", "table", "td", "th", "caption", "object"})

FURNITURE_TAGS = frozenset("nav footer aside form button select dialog menu head input label fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class and id names that mark furniture.
FURNITURE_NAMES = frozenset(
    """ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promos promotion banner
    cookie cookies cookiebar consent gdpr privacy notice notices notification notifications alert popup popover modal
    overlay newsletter subscribe subscription signup login register paywall sidebar sidenav side aside rail menu nav
    navbar navigation topnav breadcrumb breadcrumbs pagination pager footer foot comment comments commentlist disqus
    discussion reply replies respond responses share sharing sharebar social socials related recommended
    recommendations recirculation trending popular widget widgets toolbar search searchbox skip copyright disclaimer
    legal colophon tagcloud""".split()
)
#: Names that begin so tell what a part has or lacks, not what it is.
STATES = frozenset("has have no not with without".split())
#: Those that are furniture only outside an article.
OUTER_NAMES = frozenset("header masthead topbar head hero branding logo".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
#: A form or a longer name marks no furniture round more than this many times the text outside all furniture.
WRAPS = 10
NAME = re.compile(r"[A-Za-z][a-z]*|\d+")


class Node:
    """An element, or with tag None a text."""

    __slots__ = ("children", "full", "furniture", "main", "named", "sign", "tag", "text")

    def __init__(self, tag: str | None, text: str = "") -> None:
        self.tag, self.text, self.children, self.furniture, self.main, self.named = tag, text, [], False, 0, False
        self.sign = self.full = 0  # see sign()


def _mark(node: Node, attributes: str, inside: bool) -> None:
    """Sets what tag and attributes say: furniture, or a main region (2: article, 1: main).

    Furniture by a word inside a longer name, or as a form, is ``named``: unwrap() may find that it is the page itself.
    """
    tag = node.tag
    names: set[str] = set()
    tokens: set[str] = set()
    role = prop = ""
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = (a or b or c), name.lower()
            if name in ("class", "id"):
                for token in value.split():
                    words = [w.lower() for w in NAME.findall(token)]
                    if words[:1] and words[0] in STATES:
                        continue
                    tokens.add(token.lower())
                    names |= {token.lower(), *words}
            elif name == "role":
                role = value.lower()
            elif name == "itemprop":
                prop = value.lower()
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                node.furniture = True
    outer = not inside and tag not in ("body", "html", "h1")
    sure = node.furniture or (tag in FURNITURE_TAGS and tag != "form") or role in FURNITURE_ROLES or bool(tokens & FURNITURE_NAMES) or (outer and tag == "header")
    node.furniture = sure or tag == "form" or bool(names & FURNITURE_NAMES) or (outer and bool(names & OUTER_NAMES))
    node.named = not sure
    if tag in ("body", "html"):
        node.furniture = False
    node.main = 2 if tag == "article" or role == "article" or prop == "articlebody" else 1 if tag == "main" or role == "main" else 0


def parse(html: str) -> Node:
    """The DOM tree without raw-text elements; what is surely furniture stays as empty nodes."""
    root = Node("#root")
    stack = [root]
    skip = 0  # depth of the stack at which furniture began
    inside = 0  # depth at which an article or main began
    at, end = 0, len(html)
    match = TOKEN.match
    while at < end:
        m = match(html, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            text = m.group()
            if text == "<":
                follows = html[at : at + 1]
                if follows.isalpha() or follows == "/":  # a tag that never ends
                    close = html.find(">", at)
                    at = end if close < 0 else close + 1
                    continue
            elif text[0] == "<":
                continue
            if not skip:
                last = stack[-1].children
                if last and last[-1].tag is None:
                    last[-1].text += text
                else:
                    last.append(Node(None, text))
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            if skip and len(stack) < skip:
                skip = 0
            if inside and len(stack) < inside:
                inside = 0
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at) if m.group(3)[-1:] != "/" else None
            at = close.end() if close else at if m.group(3)[-1:] == "/" else end
            continue
        if tag in CLOSES or tag in BLOCKS:
            kinds, scope = CLOSES.get(tag, (frozenset(), frozenset()))
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i].tag
                if t in kinds or (t == "p" and tag in BLOCKS):
                    del stack[i:]
                    if t == "p" and not kinds:
                        break
                elif t in scope or t in P_SCOPE or (not kinds and t in BLOCKS):
                    break
            if skip and len(stack) < skip:
                skip = 0
            if inside and len(stack) < inside:
                inside = 0
        node = Node(tag)
        if tag == "br":
            if not skip:
                stack[-1].children.append(Node(None, " "))
            continue
        if tag in VOID:
            if tag == "hr" and not skip:
                stack[-1].children.append(node)
            continue
        _mark(node, m.group(3), bool(inside))
        if not skip:
            stack[-1].children.append(node)
        stack.append(node)
        if node.furniture and not node.named and not skip:
            skip = len(stack)
        if node.main and not inside:
            inside = len(stack)
    unwrap(root)
    return root


def unwrap(root: Node) -> None:
    """Clears ``named`` furniture that is a wrapper of the page: no main region and next to no text lie outside it."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.children
    size: dict[int, int] = {}
    for n in reversed(order):  # children before their parents
        size[id(n)] = len(n.text.strip()) if n.tag is None else 0 if n.furniture and not n.named else sum(size[id(c)] for c in n.children)
    outside, found, todo = 0, [], [root]
    while True:
        while todo:
            n = todo.pop()
            if n.tag is None:
                outside += size[id(n)]
            elif n.furniture:
                if n.named:
                    found.append(n)
            elif n.main and _has_text(n):
                return
            else:
                todo += n.children
        big = max(found, key=lambda n: size[id(n)], default=None)
        if big is None or size[id(big)] <= WRAPS * outside:
            return
        big.furniture = False
        found.remove(big)
        todo = [big]


def regions(root: Node) -> list[Node]:
    """The outermost article elements, or main elements, or the whole page."""
    found: dict[int, list[Node]] = {1: [], 2: []}
    todo: list[tuple[Node, int]] = [(root, 0)]
    while todo:
        node, best = todo.pop()
        if node.furniture:
            continue
        if node.main > best and _has_text(node):
            found[node.main].append(node)
            best = node.main
        todo += [(c, best) for c in reversed(node.children) if c.tag is not None]
    return found[2] or found[1] or [root]


def _has_text(node: Node) -> bool:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag is None:
            if n.text.strip():
                return True
        elif not n.furniture:
            todo += n.children
    return False


def prune(node: Node) -> None:
    """Drops furniture, and space between blocks."""
    todo = [node]
    while todo:
        n = todo.pop()
        n.children = [c for c in n.children if not c.furniture and (c.tag is not None or not c.text.isspace() or n.tag not in ("ul", "ol", "table", "tbody", "tr", "article", "body", "#root", "main"))]
        todo += [c for c in n.children if c.tag is not None]


def sign(root: Node, known: dict, common: set[str], other: str) -> None:
    """Gives every node a number that equal subtrees share (``known`` holds those so far), and its subtree's full score.

    Texts that aren't ``common`` to both trees count as ``other``, one for each tree, as they can equal none there: what
    differs in nothing else has one number, and is scored once.
    """
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.children
    for n in reversed(order):  # children before their parents
        key = tuple(c.sign for c in n.children) if n.tag is not None else n.text if n.text in common else (other,)
        n.sign = known.setdefault((n.tag, key), len(known))
        n.full = 3 if n.tag is None else 1 + sum(c.full for c in n.children)


def each_with_each(x: list[Node], y: list[Node], span: tuple[int, int, int, int]) -> bool:
    """Whether a span's pairs of children are scored each with each: its subtrees have few enough pairs of nodes."""
    i, n, j, m = span
    return sum(c.full for c in x[i:n]) * sum(c.full for c in y[j:m]) <= WORK


def gaps(x: list[Node], y: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """(pairs of equal children that meet in any case, spans of the two lists between them).

    Equal children at both ends of the lists meet: no better matching can be had without them. In a span too large for
    each_with_each(), so do equal children that are the only ones of their kind on either side, as far as they are in order.
    """
    i, j, n, m = 0, 0, len(x), len(y)
    while i < n and i < m and x[i].sign == y[i].sign:
        i += 1
    while n > i and m > i and x[n - 1].sign == y[m - 1].sign:
        n, m = n - 1, m - 1
    j = i
    sure = [(k, k) for k in range(i)] + [(n + k, m + k) for k in range(len(x) - n)]
    if each_with_each(x, y, (i, n, j, m)):
        return sure, [(i, n, j, m)] if n > i and m > j else []
    mine, yours = Counter(c.sign for c in x[i:n]), Counter(c.sign for c in y[j:m])
    at = {c.sign: k for k, c in enumerate(y[j:m], j) if yours[c.sign] == 1}
    both = [(k, at[c.sign]) for k, c in enumerate(x[i:n], i) if mine[c.sign] == 1 and c.sign in at]
    # The longest run of them that goes up on both sides.
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, v) in enumerate(both):
        p = bisect_left(tails, v)
        before.append(ends[p - 1] if p else -1)
        if p == len(tails):
            tails.append(v)
            ends.append(k)
        else:
            tails[p], ends[p] = v, k
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(both[k])
        k = before[k]
    spans = []
    for u, v in [*reversed(chain), (n, m)]:
        if u > i and v > j:
            spans.append((i, u, j, v))
        i, j = u + 1, v + 1
    return sure + chain, spans


def in_order(x: list[Node], y: list[Node], span: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Pairs of children of one tag, met in order: where the runs of tags differ, the nearer next run is gone to."""
    i, n, j, m = span
    later: list[dict[str | None, list[int]]] = [{}, {}]
    for side, (nodes, a, b) in zip(later, ((x, i, n), (y, j, m)), strict=True):
        for k in range(a, b):
            side.setdefault(nodes[k].tag, []).append(k)
    out = []
    while i < n and j < m:
        if x[i].tag == y[j].tag:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        ahead = [at[p] if (at := side.get(tag, [])) and (p := bisect_left(at, k)) < len(at) else end for side, tag, k, end in ((later[0], y[j].tag, i, n), (later[1], x[i].tag, j, m))]
        if ahead[0] - i <= ahead[1] - j:
            i = ahead[0]
        else:
            j = ahead[1]
    return out


class Matcher:
    """Simple tree matching: the score of two trees and the pairs of children that give it.

    The score counts matched nodes; equal texts count three times, so that a constant node meets itself. Scores are kept
    by the subtrees' numbers, and no recursion is used. Children in a span too large for each_with_each() meet in order,
    so the work for a page grows with its nodes.
    """

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], int] = {}

    def value(self, a: Node, b: Node) -> int | None:
        """The score of two nodes, None where it isn't known yet."""
        if a.sign == b.sign:
            return a.full
        if a.tag != b.tag:
            return 0
        if a.tag is None or not a.children or not b.children:
            return 1
        return self.known.get((a.sign, b.sign))

    def score(self, a: Node, b: Node) -> int:
        todo = [(a, b)]
        while todo:
            p, q = todo[-1]
            if self.value(p, q) is not None:
                todo.pop()
                continue
            x, y = p.children, q.children
            sure, spans = gaps(x, y)
            open_, total = [], 1 + sum(x[i].full for i, _ in sure)
            for span in spans:
                i, n, j, m = span
                if each_with_each(x, y, span):
                    open_ += [(u, v) for u in x[i:n] for v in y[j:m] if self.value(u, v) is None]
                else:
                    open_ += [(x[u], y[v]) for u, v in in_order(x, y, span) if self.value(x[u], y[v]) is None]
            if open_:
                todo += open_
                continue
            for span in spans:
                total += sum(self.value(x[i], y[j]) for i, j in self.met(x, y, span))
            self.known[p.sign, q.sign] = total
            todo.pop()
        return self.value(a, b)

    def met(self, x: list[Node], y: list[Node], span: tuple[int, int, int, int]) -> list[tuple[int, int]]:
        """The pairs of a span; the scores of its children are known."""
        i0, n, j0, m = span
        if not each_with_each(x, y, span):
            return in_order(x, y, span)
        best = [[0] * (m - j0 + 1)]
        for p in x[i0:n]:
            up, row = best[-1], [0]
            for j, q in enumerate(y[j0:m]):
                row.append(max(row[j], up[j + 1], up[j] + self.value(p, q)))
            best.append(row)
        pairs = []
        i, j = n - i0, m - j0
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i0 + i, j0 + j))
        return pairs

    def children(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The matched pairs of two matched nodes' children."""
        self.score(a, b)
        x, y = a.children, b.children
        sure, spans = gaps(x, y)
        for span in spans:
            if each_with_each(x, y, span):
                for u in x[span[0] : span[1]]:
                    for v in y[span[2] : span[3]]:
                        self.score(u, v)
            sure = sure + self.met(x, y, span)
        return [(x[i], y[j]) for i, j in sure]


def align(reference: Node, page: Node) -> list[tuple[Node, Node]]:
    """Pairs of text nodes at the same place of two trees."""
    known: dict = {}
    common = {n.text for n in _text_nodes(reference)} & {n.text for n in _text_nodes(page)}
    sign(page, known, common, "page")
    if reference is not page:
        sign(reference, known, common, "reference")
    out, todo, matcher = [], [(reference, page)], Matcher()
    while todo:
        a, b = todo.pop()
        if a.tag is None:
            out.append((a, b))
        else:
            todo += matcher.children(a, b)
    return out


def blocks(node: Node, dropped: set[int]) -> list[str]:
    """Texts of the node's blocks in page order, without dropped text nodes."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(text)
        parts.clear()

    todo: list[Node | None] = [node]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif n.tag is None:
            if id(n) not in dropped:
                parts.append(n.text)
        elif not n.furniture:
            inner = list(reversed(n.children))
            if n.tag in BLOCKS or n.tag == "#root":
                flush()
                todo += [None, *inner]
            else:
                todo += inner
    flush()
    return out


def _needed(n: int) -> float:
    """Votes of n that make a text template."""
    return n if n < CONSTANT_PAGES else max(CONSTANT_PAGES, CONSTANT_SHARE * n)


def _places(tops: list[Node], voters: list[int]) -> list[dict[int, Node]]:
    """For each page, its text nodes by the place that alignment gives them.

    The page of median size is the first reference. While texts that enough voters have are at no place yet, a page
    with most of them is a further one.
    """
    placed: list[dict[int, Node]] = [{} for _ in tops]
    nodes = [_text_nodes(t) for t in tops]
    sizes = sorted(voters, key=lambda i: (sum(len(r.children) for r in tops[i].children), i))
    reference, tried = sizes[len(sizes) // 2], set()
    while reference is not None:
        taken = [{id(b) for b in p.values()} for p in placed]
        for i, top in enumerate(tops):
            for a, b in align(tops[reference], top):
                if id(a) not in taken[reference] and id(b) not in taken[i]:
                    placed[i][id(a)] = b
        tried |= {n.text.strip() for n in nodes[reference]}
        free: dict[int, set[str]] = {}
        for i in voters:
            known = {id(b) for b in placed[i].values()}
            free[i] = {t for n in nodes[i] if id(n) not in known and (t := n.text.strip()) and t not in tried}
        counts = Counter(t for texts in free.values() for t in texts)
        common = {t for t, n in counts.items() if n >= _needed(len(voters))}
        reference = max(voters, key=lambda i: (len(free[i] & common), -i)) if common else None
    return placed


def _fixed(placed: list[dict[int, Node]], groups: dict[int, int]) -> dict[int, str]:
    """The template text of each place that has one; pages of one group have one vote for a text."""
    votes: dict[int, dict[str, set[int]]] = {}
    for i, g in groups.items():
        for place, node in placed[i].items():
            votes.setdefault(place, {}).setdefault(node.text.strip(), set()).add(g)
    need = _needed(len(set(groups.values())))
    best = {k: max(texts.items(), key=lambda t: len(t[1])) for k, texts in votes.items()}
    return {k: text for k, (text, by) in best.items() if text and len(by) >= max(2, need)}


def template_texts(pages: list[list[Node]]) -> list[set[int]]:
    """For each page's regions, the ids of text nodes that are template."""
    signs = [" ".join(x for r in p for x in _texts(r)) for p in pages]
    voters = sorted({s: i for i, s in enumerate(signs) if s}.values())
    dropped: list[set[int]] = [set() for _ in pages]
    if len(voters) < 2:
        return dropped
    tops = []
    for p in pages:
        tops.append(Node("#page"))
        tops[-1].children = p
    placed = _places(tops, voters)
    fixed = _fixed(placed, {i: i for i in voters})
    if not fixed:
        return dropped
    mine = [[b for k, b in p.items() if fixed.get(k) == b.text.strip()] for p in placed]
    plain = [len(voters) >= CONSTANT_PAGES and 2 * sum(len(b.text) for b in m) <= len(s) for m, s in zip(mine, signs, strict=True)]
    if not all(plain):
        groups: dict[int, int] = {}
        heads: list[set[str]] = []
        for i in voters:
            gone = {id(b) for b in mine[i]}
            own = {w for n in _text_nodes(tops[i]) if id(n) not in gone for w in n.text.split()}
            if len(own) < OWN_WORDS:
                continue
            like = (g for g, h in enumerate(heads) if len(own & h) > COPY_SHARE * len(own | h))
            if (g := next(like, None)) is None:
                g = len(heads)
                heads.append(own)
            groups[i] = g
        surely = _fixed(placed, groups)
        mine = [m if ok else [b for k, b in p.items() if surely.get(k) == b.text.strip()] for m, ok, p in zip(mine, plain, placed, strict=True)]
    return [{id(b) for b in m} for m in mine]


def _text_nodes(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.tag is None:
            out.append(n)
        else:
            todo += reversed(n.children)
    return out


def _texts(node: Node) -> list[str]:
    return [n.text.strip() for n in _text_nodes(node)]


def extract_block(pages: list[str | None]) -> list[str]:
    """The main texts of pages of one host."""
    found = []
    for h in pages:
        tops = regions(parse(h)) if h else []
        for r in tops:
            prune(r)
        found.append(tops)
    live = [i for i, p in enumerate(found) if p]
    dropped = dict(zip(live, template_texts([found[i] for i in live]), strict=True))
    return ["\n\n".join(x for r in p for x in blocks(r, dropped[i])) if p else "" for i, p in enumerate(found)]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars)."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    many = cut(counts.select(F.col("host").alias("h_host"), F.ceil(F.col("n") / BLOCK).alias("parts")), "wrapper-hosts")
    # A written table of heavy hosts alone: Spark knows its size and broadcasts it while it is small.
    dealt = rows.join(many, rows["host"] == many["h_host"], "left")
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1)))
    dealt = dealt.select("page_id", "url", "html", "host", part.alias("part"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_id", "url"], kind="stable", na_position="last")
        texts = extract_block([h if isinstance(h, str) else None for h in pdf["html"]])
        return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return dealt.groupBy("host", "part").applyInPandas(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op3_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
