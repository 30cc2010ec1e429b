"""HTML pages as trees of block elements, and their alignment by simple tree matching."""

from __future__ import annotations

import html
import json
import re
from collections import Counter

# Fixed values of the HTML standard: elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp textarea title template svg object".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option optgroup p pre "
    "search section select summary table caption colgroup thead tbody tfoot tr td th ul button label audio video canvas".split()
)
CLOSES_P = BLOCK - frozenset("html head body option optgroup button label audio video canvas dialog".split())
#: A start tag of the first kind ends an open element of the second, up to the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}

# Elements, and words in their class, id or role, that never hold a page's article.
FURNITURE = frozenset("head nav header footer aside form button select fieldset dialog menu search label audio video canvas".split())
FURNITURE_WORD = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert[a-z]*|adsense|banner|sidebar|side|menu|nav(?:bar|igation|list|menu|links?)?|breadcrumbs?|cookies?|consent|gdpr|notices?|"
    r"alerts?|popup|modal|overlay|promo[a-z]*|sponsor[a-z]*|comments?|commentlist|disqus|repl(?:y|ies)|respond|footer|header|"
    r"masthead|shar(?:e|ing)|social|related|recommend[a-z]*|newsletter|subscribe|signup|login|widgets?|toolbar|"
    r"pagination|pager|skip|copyright|complementary|contentinfo|search)(?:$|[^a-z])"
)

#: The same for whole class names inside an article, where other words may well be its subject, and for whole ids there.
INSIDE_WORD = re.compile(
    r"ads?|ad-(?:slot|unit|box|banner|container)|advert[a-z]*|adsense|sponsor(?:ed|s)?|promo(?:tion|ted)?|comments?|"
    r"comment-?(?:list|section|area|form|thread)|disqus|respond|replies|breadcrumbs?|cookie-?(?:banner|notice|consent)|gdpr|"
    r"sidebar|menu|nav|navbar|navigation|newsletter(?:-signup)?|subscribe|signup|login|share|sharing|social|"
    r"(?:social|share)-?(?:share|links|media|buttons|bar)|related|related-?(?:posts|articles|links|stories)|recommended|"
    r"pagination|pager|widget|toolbar|popup|modal|overlay"
)
INSIDE_ID = re.compile(r"comments?|disqus_thread|respond|sidebar|newsletter|cookie-?(?:banner|notice)|related-posts")
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

ARTICLE_WORD = re.compile(r"comments?|comment-(?:body|item|0)|repl(?:y|ies)|ads?|advert[a-z]*|promo|related|teaser")
#: Names such as has-sidebar tell of a page's layout, not of the element.
LAYOUT_WORD = re.compile(r"(?:has|no|with|without|hide|show|is)[-_]")

#: Elements nested deeper than this join their ancestor.
DEEPEST = 100

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"(?P<attrs>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+(?=>|\Z)|[^>]*+)(?P<close>>|\Z)",
    re.S,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    """A block element, or several like siblings that were folded into one."""

    __slots__ = ("label", "kids", "same", "number")

    def __init__(self, label: str, kids: list[Node] | None = None) -> None:
        self.label = label
        self.kids = kids if kids is not None else []
        self.same: Node | None = None
        self.number = -1

    def found(self) -> Node:
        """The node that this one was folded into."""
        node = self
        while node.same is not None:
            node = node.same
        return node

    def preorder(self) -> list[Node]:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            node.number = len(out)
            out.append(node)
            todo.extend(reversed(node.kids))
        return out

    def text(self) -> str:
        return json.dumps(_nested(self), separators=(",", ":"))


def _nested(node: Node) -> list:
    return [node.label, [_nested(k) for k in node.kids]] if node.kids else [node.label]


def read(text: str) -> Node:
    def node(x: list) -> Node:
        return Node(x[0], [node(k) for k in x[1]] if len(x) > 1 else [])

    return node(json.loads(text))


def is_furniture(label: str, inside: bool = False) -> bool:
    """Whether an element of this tag and these names never holds a page's article.

    Ids, which begin with ``#``, are often made of a heading's own words: one
    counts as a whole or by its last word. ``inside`` tells that the element lies in
    an article or main element; there only whole names count. Headings are never
    furniture by name.
    """
    tag, _, names = label.partition(" ")
    if tag in FURNITURE or not names or tag in HEADING or tag in ("html", "body", "main"):
        return tag in FURNITURE
    words = [w for w in names.split() if not LAYOUT_WORD.match(w)]
    if tag == "article":
        return any(ARTICLE_WORD.fullmatch(w.removeprefix("#")) for w in words)
    if inside:
        return any(INSIDE_ID.fullmatch(w[1:]) if w[0] == "#" else INSIDE_WORD.fullmatch(w) for w in words)
    return any(_ends_as_furniture(w[1:]) if w[0] == "#" else FURNITURE_WORD.search(w) for w in words)


def _ends_as_furniture(name: str) -> bool:
    return any(m.end() == len(name) for m in FURNITURE_WORD.finditer(name))


def spread_furniture(root: Node, nodes: int) -> list[bool]:
    """For each numbered node whether it is furniture or lies in some.

    An element around a whole article, such as a page-wide form, is none.
    """
    out = [False] * nodes

    def holds_article(node: Node) -> bool:
        return any(
            k.label.partition(" ")[0] in ("article", "main") and not is_furniture(k.label) or holds_article(k)
            for k in node.kids
        )

    def spread(node: Node, furniture: bool, inside: bool) -> None:
        furniture = furniture or (is_furniture(node.label, inside) and not holds_article(node))
        out[node.number] = furniture
        inside = inside or (node.label.partition(" ")[0] in ("article", "main") and not furniture)
        for kid in node.kids:
            spread(kid, furniture, inside)

    spread(root, False, False)
    return out


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of a page and its blocks of text in page order, each with its element."""
    root = Node("#page")
    stack = [root]
    opened: Counter[str] = Counter()  # open elements by tag, so that a stray end tag needs no search
    blocks: list[tuple[Node, str]] = []
    pending: list[str] = []

    def flush() -> None:
        if pending:
            words = "".join(pending).split()
            if words:
                blocks.append((stack[-1], " ".join(words)))
            pending.clear()

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        stop = token.start() if token else end
        if stop > at:
            piece = page[at:stop]
            pending.append(html.unescape(piece) if "&" in piece else piece)
        if not token:
            break
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["end"]:
            if tag == "br" or tag == "p" and not opened["p"]:
                pending.append(" ")
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].label.partition(" ")[0] == tag:
                    flush()
                    _cut(stack, opened, i)
                    break
            continue
        if tag in RAW:
            if token["close"] and not token["attrs"].endswith("/"):
                close = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(page, at)
                at = close.start() if close else end
            continue
        if tag == "br":
            pending.append(" ")
            continue
        attrs = token["attrs"]
        names = ""
        if "=" in attrs and (found := _NAMES.findall(attrs)):
            words = (f"#{w}" if kind.lower() == "id" else w for kind, a, b, c in found for w in (a or b or c).split())
            names = re.sub(r"[0-9]+", "0", " ".join(words)).lower()
        label = f"{tag} {' '.join(sorted(set(names.split())))}".strip()
        if tag not in BLOCK and not (names and tag not in VOID and is_furniture(label, opened["article"] + opened["main"] > 0)):
            continue
        flush()
        if tag in CLOSES_P:
            _close(stack, opened, {"p"}, {"button", "td", "th", "table", "article", "section", "div", "li", "blockquote"})
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            while _close(stack, opened, ends, bounds):
                pass
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag in VOID:
            continue
        node = Node(label)
        if len(stack) > DEEPEST:
            node.same = stack[DEEPEST]  # open until its own end tag, but no node of the tree
        else:
            stack[-1].kids.append(node)
        stack.append(node)
        opened[tag] += 1
    flush()
    return root, blocks


def _cut(stack: list[Node], opened: Counter[str], i: int) -> None:
    for node in stack[i:]:
        opened[node.label.partition(" ")[0]] -= 1
    del stack[i:]


def _close(stack: list[Node], opened: Counter[str], ends: set[str], bounds: set[str]) -> bool:
    """Close the innermost element of ``ends`` that lies inside of ``bounds``."""
    if not any(opened[tag] for tag in ends):
        return False
    for i in range(len(stack) - 1, 0, -1):
        tag = stack[i].label.partition(" ")[0]
        if tag in ends:
            _cut(stack, opened, i)
            return True
        if tag in bounds:
            return False
    return False


def fold(node: Node) -> Node:
    """The tree with runs of like siblings folded into one, innermost first."""
    kids: list[Node] = []
    for kid in node.kids:
        fold(kid)
        if kids and kids[-1].label == kid.label:
            absorb(kids[-1], kid)
        else:
            kids.append(kid)
    node.kids = kids
    return node


def matching(a: Node, b: Node) -> int:
    """Simple tree matching: the most pairs of nodes that agree in label, order and ancestors."""
    if a.label != b.label:
        return 0
    return 1 + (_table(a.kids, b.kids)[-1][-1] if a.kids and b.kids else 0)


def _table(some: list[Node], others: list[Node]) -> list[list[int]]:
    best = [[0] * (len(others) + 1) for _ in range(len(some) + 1)]
    for i, a in enumerate(some, 1):
        for j, b in enumerate(others, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + matching(a, b))
    return best


def aligned(some: list[Node], others: list[Node]) -> list[tuple[int, int]]:
    """The pairs of children that the best matching of two lists aligns, in order."""
    if [a.label for a in some] == [b.label for b in others]:
        return [(i, i) for i in range(len(some))]
    best = _table(some, others)
    i, j, out = len(some), len(others), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def absorb(tree: Node, other: Node) -> None:
    """Fold ``other`` into ``tree``: aligned nodes become one, the rest is inserted in order."""
    other.same = tree
    if not other.kids:
        return
    partner = {j: i for i, j in aligned(tree.kids, other.kids)}
    kids, used = [], 0
    for j, kid in enumerate(other.kids):
        if j in partner:
            i = partner[j]
            kids += tree.kids[used : i + 1]
            used = i + 1
            absorb(tree.kids[i], kid)
        else:
            kids.append(kid)
    tree.kids = kids + tree.kids[used:]


def place(tree: Node, other: Node, out: dict[int, int]) -> None:
    """Numbers of ``tree``'s nodes for the numbers of ``other``'s, where they align."""
    out[other.number] = tree.number
    for i, j in aligned(tree.kids, other.kids):
        place(tree.kids[i], other.kids[j], out)
