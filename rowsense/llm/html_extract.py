r"""HTML extraction by union-free wrappers, one for each host.

A page is read leniently into a tree of structural elements. Wrappers are union-free regular expressions over the token
streams of such trees: an element's content is a sequence of elements, text slots and repeated groups, each of which may be
optional, and no label stands twice in a sequence. A page is a wrapper of its own; wrappers of one host are aligned again
and again:

- equal labels are aligned in turn; a slot keeps the texts that each page has in it, and is variable but for them;
- a mismatch becomes an optional item;
- an item that comes again, or in another order, makes the stretch between a repeated group.

So a wrapper grows with the labels of a template, not with pages. Every page takes part: tasks align what they read, and
two more rounds align the tasks' wrappers of a host, first in 64 parts.

A host's wrapper gives its rules: where the articles are (all article elements, else main; failing both, the deepest
element that holds most of the variable text). Within named articles, which labelled containers are the template's: those
that stand behind the first paragraph and say the same on all pages (adverts, notices), and those at the end that repeat
labelled items of a short line and a text (readers' comments); paragraphs, headings and lists that pages share stay. Elsewhere,
which labels hold mostly links and which constant texts are the template's. A page that its host's rules don't fit is read by
the rules of a wrapper of its own.

Defined results: null or empty html gives the empty text; a null or broken URL is a host of its own, the empty one; equal
pages give equal texts within a host; rows with equal ids stay; elements nested deeper than DEPTH are read as content of
the deepest. White space is Unicode's; a line break element is white space; formulas are text of their line. Classes, roles and
labels for readers of screens mark what is not the article by whole words or compounds with words of layout only (TEXT_TAGS by
whole words alone); ids only where they stand on ID_TAGS and hold one of ID_WORDS.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import to_batch, whole, written

DEPTH, PARTS, HOSTS_HELD, LABELS_HELD = 100, 64, 2000, 48
#: Share of the article's text that the element to descend to must hold; of links from which an element is a list of links.
MOSTLY, LINKED = 0.6, 0.6
#: Pages from which an equal text is the template's; share of a list's text that its items' first lines have at most.
CONSTANT_PAGES, BYLINE = 3, 0.4

#: Quotes hold anything, but only behind an equals sign; one that is never closed is a character as others.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/><]*)((?:[^"'<>=]++|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Elements by their kind in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template noscript svg annotation annotation-xml object audio video canvas select".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = BLOCK - {"option", "optgroup", "legend", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "body", "html"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
SCOPE = frozenset("ul ol dl table div article section body html main aside nav form".split())
# Elements and words of class, id or role that mark what is not the article.
OUT_TAGS = frozenset("nav aside footer form label output datalist script style noscript template iframe button select textarea dialog menu svg object audio video canvas head title noembed noframes search".split())
OUT_WORDS = frozenset("ad ads adsbygoogle advert adverts advertisement advertising adbox adslot adsense banner promo promotion sponsor sponsored sponsors nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs footer foot sidebar side aside cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations trending pagination pager paging toolbar search login widget widgets copyright legal disclaimer skip masthead topbar complementary contentinfo dialog hidden teaser teasers".split())
HEAD_WORDS = frozenset("header head banner masthead topbar".split())
# Classes that templates put on the body, where their words don't mark.
NEVER_OUT = frozenset("html body article main".split())
# Whole words that mark an article element.
ARTICLE_WORDS = frozenset("ad advert advertisement comment promo promoted recommended related reply sponsored teaser".split())
# Words beside a telling one that leave its meaning; elements that only a whole class or role word marks.
LAYOUT_WORDS = frozenset("area articles bar block bottom box button buttons col column container content entries entry feed form google group inner item items left link links list main news outer page panel post posts products reader readers right row section site slot stories story thread top topics unit user users visitor visitors wrap wrapper x".split())
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
# Elements that an id alone marks, and its words, as slugs of headings are ids too.
ID_TAGS = frozenset("div section ul ol dl table center details figure fieldset".split())
ID_WORDS = frozenset("ad ads adbox adslot adsense nav navbar submenu breadcrumb breadcrumbs footer sidebar comments commentlist disqus respond newsletter masthead topbar pager".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What ends the labels of elements that their attributes mark: as no part of the article, or as a header.
NO_PART, HEADER = ". !", ". ^"


def tells(word: str, marks: frozenset, compound: bool) -> bool:
    """Whether a class, role or id is one of the marks; or, as a compound, made of marks and words of layout."""
    parts = [x for x in re.split(r"[^a-z]+", word) if x]
    if len(parts) < 2:
        return bool(parts) and parts[0] in marks
    return compound and any(x in marks for x in parts) and all(x in OUT_WORDS or x in HEAD_WORDS or x in LAYOUT_WORDS for x in parts)


@lru_cache(10_000)
def mark(tag: str, ids: tuple[str, ...], words: tuple[str, ...]) -> str:
    if tag in NEVER_OUT:
        return NO_PART if tag == "article" and not ARTICLE_WORDS.isdisjoint(words) else ""
    compound = tag not in TEXT_TAGS
    if any(tells(w, OUT_WORDS - HEAD_WORDS, compound) for w in words) or tag in ID_TAGS and any(tells(w, ID_WORDS - HEAD_WORDS, True) for w in ids):
        return NO_PART
    if compound and any(tells(w, HEAD_WORDS, True) for w in words) or tag in ID_TAGS and any(tells(w, HEAD_WORDS, True) for w in ids):
        return HEADER
    return ""


def names(tag: str, attributes: str) -> str:
    """The label: tag, then id and class words with digits as 0, and what the attributes mark."""
    if not attributes or attributes.isspace():
        return tag
    found, ids, words, hidden = [], [], [], False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and UNSEEN.search(value):
            hidden = True
        elif key == "aria-label":
            # Several words say together what the element is.
            words.append("-".join(value.lower().split()))
        elif key in ("class", "id", "role", "itemprop"):
            some = re.sub(r"\d+", "0", value.lower()).split()
            found += some
            (ids if key == "id" else words).extend(some)
    # All words mark; the label holds the first, and the one that rules look for.
    kept = sorted(dict.fromkeys(found), key=lambda w: w != "articlebody")[:7]
    told = NO_PART if hidden else mark(tag, tuple(ids), tuple(words))
    return ".".join([tag, *kept]) + told


class Element:
    __slots__ = ("children", "label", "out", "tag")

    def __init__(self, tag: str, label: str) -> None:
        self.tag, self.label, self.children = tag, label, []
        self.out = tag in OUT_TAGS or tag == "header" or label.endswith((NO_PART, HEADER))

    def is_head(self) -> bool:
        """Left out only as a header, which an article's own header is not."""
        return self.out and self.tag not in OUT_TAGS and not self.label.endswith(NO_PART)


def read_tree(page: str) -> Element:
    """Elements and texts (decoded). Inline elements without class, id or role are left out, but for links."""
    root = Element("html", "html")
    stack, over, at = [root], {}, 0
    n = len(page)

    def text(a: int, b: int) -> None:
        if a < b:
            t = page[a:b]
            stack[-1].children.append(entities.unescape(t) if "&" in t else t)

    def close(found: tuple[str, ...], scope: frozenset) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in found:
                del stack[k:]
                return True
            if stack[k].tag in scope:
                break
        return False

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            break
        text(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        tag, ending = m[2].lower(), bool(m[1])
        if tag in ("html", "body", "head") and ending:
            continue
        if tag == "br" or tag == "hr" or tag == "wbr":
            if tag != "wbr":
                stack[-1].children.append(" " if tag == "br" else Element("hr", "hr"))
            continue
        if tag in VOID:
            continue
        if ending:
            if over.get(tag):
                over[tag] -= 1
                if tag in BLOCK:
                    stack[-1].children.append(Element("hr", "hr"))
            else:
                close((tag,), frozenset() if tag in BLOCK and tag != "p" else SCOPE | {"li", "td", "th"} if tag == "p" else BLOCK)
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n if tag in ("script", "style") else at
            continue
        if tag in ENDS_P:
            close(("p",), SCOPE - {"p"})
        if tag in SIBLINGS:
            close(SIBLINGS[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        if tag == "a":
            close(("a",), BLOCK)
        label = names(tag, m[3])
        if tag == "html":
            continue
        if tag not in BLOCK and tag != "a" and label == tag and tag not in OUT_TAGS:
            continue
        if len(stack) > DEPTH:
            over[tag] = over.get(tag, 0) + 1
            if tag in BLOCK:
                stack[-1].children.append(Element("hr", "hr"))
            continue
        now = Element(tag, label)
        stack[-1].children.append(now)
        if not (m[3].rstrip().endswith("/") and tag not in BLOCK):
            stack.append(now)
    text(at, n)
    return root


# Wrappers are lists of items. Each item is a list: label, least, many, pages, characters, characters in links, content.
# content: an element's or a group's items; of a slot the texts that each page has in it, none if all differ.
SLOT, GROUP = "#", "()"


def as_constant(t: str) -> str:
    """A text that a template may hold; a digest stands for a long one."""
    return t if len(t) <= 64 else f"{len(t)} {hashlib.sha1(t.encode('utf-8', 'surrogatepass')).hexdigest()}"


def constant_size(c: str) -> int:
    return int(c.split(" ", 1)[0]) if len(c) > 41 and c[-41] == " " and c[:-41].isdigit() else len(c)


def item_of(node: Element | str, linked: bool) -> list:
    if isinstance(node, str):
        t = " ".join(node.split())
        return [SLOT, 1, 0, 1, len(t), len(t) if linked else 0, [as_constant(t)]]
    inside = [item_of(c, linked or node.tag == "a") for c in node.children if not (isinstance(c, str) and not c.strip())]
    inside = fold(inside)
    return [node.label, 1, 0, 1, sum(i[4] for i in inside), sum(i[5] for i in inside), inside]


def labels(item: list) -> set[str]:
    return {i[0] for i in item[6]} if item[0] == GROUP else {item[0]}


def merge(a: list, b: list, add_pages: bool) -> list:
    """Two items of one label as one; add_pages: they come from different pages."""
    if a[0] == SLOT:
        inside = sorted(set(a[6]) & set(b[6]) if add_pages else set(a[6]) | set(b[6]))
    elif a[0] == GROUP:
        return grouped([a, b], add_pages)
    else:
        inside = align(a[6], b[6], add_pages)
    return [a[0], a[1] & b[1], a[2] | b[2], a[3] + b[3] if add_pages else max(a[3], b[3]), a[4] + b[4], a[5] + b[5], inside]


def grouped(items: list[list], add_pages: bool) -> list:
    """One repeated group of all items, groups among them opened; a label that comes again is merged."""
    inside: list[list] = []
    place: dict[str, int] = {}
    least = 0
    for it in items:
        least |= it[1]
        for x in it[6] if it[0] == GROUP else [it]:
            if x[0] in place:
                inside[place[x[0]]] = merge(inside[place[x[0]]], x, add_pages)
            else:
                place[x[0]] = len(inside)
                inside.append([x[0], 0, *x[2:]])
    pages = max(x[3] for x in inside)
    return [GROUP, least, 1, pages, sum(x[4] for x in inside), sum(x[5] for x in inside), inside]


def generalised(items: list[list]) -> list[list]:
    """Where a sequence has very many labels of one tag, the tag stands for them."""
    many: dict[str, int] = {}
    for i in items:
        for x in labels(i):
            many[x.split(".", 1)[0]] = many.get(x.split(".", 1)[0], 0) + 1
    wide = {t for t, k in many.items() if k > LABELS_HELD}
    if not wide:
        return items
    told = lambda x: x[-len(NO_PART) :] if x.endswith((NO_PART, HEADER)) else ""
    plain = lambda x: [x[0].split(".", 1)[0] + told(x[0]) if x[0].split(".", 1)[0] in wide else x[0], *x[1:]]
    return fold([[*i[:6], [plain(x) for x in i[6]]] if i[0] == GROUP else plain(i) for i in items])


def fold(items: list[list]) -> list[list]:
    """A sequence in which each label stands once: repetitions become repeated items or groups."""
    out: list[list] = []
    place: dict[str, int] = {}
    for it in items:
        at = [place[x] for x in labels(it) if x in place]
        if not at:
            for x in labels(it):
                place[x] = len(out)
            out.append(it)
            continue
        first = min(at)
        if first == len(out) - 1 and out[first][0] == it[0] != GROUP:
            out[first] = merge(out[first], it, False)
            out[first][2] = 1
            continue
        out[first:] = [grouped([*out[first:], it], False)]
        for x in labels(out[first]):
            place[x] = first
    return out


def align(a: list[list], b: list[list], add_pages: bool = True) -> list[list]:
    """The union-free sequence that takes what either takes."""
    out, met, last = [list(i) for i in a], set(), -1
    for it in b:
        place = {x: k for k, i in enumerate(out) for x in labels(i)}
        at = sorted({place[x] for x in labels(it) if x in place})
        if not at:
            last += 1
            out.insert(last, [it[0], 0, *it[2:]])
            met = {k + (k >= last) for k in met} | {last}
        elif at == [at[0]] and at[0] > last and out[at[0]][0] == it[0]:
            out[at[0]] = merge(out[at[0]], it, add_pages)
            last = at[0]
            met.add(last)
        else:
            first, end = min(at), max(at[-1], last if at[0] <= last else at[-1])
            out[first : end + 1] = [grouped([*out[first : end + 1], it], add_pages)]
            met = {k for k in met if k < first} | {k - (end - first) for k in met if k > end} | {first}
            last = first
    return generalised([i if k in met else [i[0], 0, *i[2:]] for k, i in enumerate(out)])


def wrapper_of(page: str) -> list:
    return item_of(read_tree(page), False)


# Rules.


def rules_of(wrapper: list) -> dict:
    """roots: the labels from the page to the articles' elements; constants, links and cut: texts and paths that are left out."""
    best: dict[tuple, float] = {}

    def walk(item: list, path: tuple, inside: bool) -> float:
        """Characters outside links of what may be the article's."""
        label = item[0]
        if label == SLOT:
            own = item[4] - item[5]
            return own if wrapper[3] < CONSTANT_PAGES else max(0.05 * own, own - sum(map(constant_size, item[6])) * item[3])
        here = path if label == GROUP else (*path, label)
        tag = label.split(".", 1)[0]
        if label != GROUP and Element(tag, label).out and not (inside and Element(tag, label).is_head()):
            return 0.0
        total = sum(walk(i, here, inside or tag in ("article", "main")) for i in item[6])
        if label != GROUP:
            best[here] = best.get(here, 0.0) + total
        return total

    total = walk(wrapper, (), False)
    root: tuple = ("html",)
    named = {p: c for p, c in best.items() if (p[-1].split(".", 1)[0] in ("article", "main") or "articlebody" in p[-1].split(".")) and c > 0}
    articles = {p: c for p, c in named.items() if p[-1].split(".", 1)[0] != "main"} or named
    outer = [p for p in articles if not any(q != p and p[: len(q)] == q for q in articles)]
    if outer and sum(articles[p] for p in outer) >= 0.25 * total:
        return {"roots": [list(p) for p in sorted(outer)], "constants": [], "links": [], "cut": sorted(containers_of(wrapper, set(outer)))}
    repeated = set()

    def many(item: list, path: tuple, under: bool) -> None:
        here = path if item[0] in (GROUP, SLOT) else (*path, item[0])
        if item[0] != SLOT:
            if item[2] or under:
                repeated.add(here)
            for i in item[6]:
                many(i, here, item[0] == GROUP)

    many(wrapper, (), False)
    while True:
        below = {p: c for p, c in best.items() if len(p) == len(root) + 1 and p[: len(root)] == root}
        top = max(below, key=lambda p: (below[p], p), default=None)
        if top is None or not below[top] or below[top] < MOSTLY * best[root] or top in repeated or top[-1].split(".", 1)[0] in ("p", "a", "span", "h1", "h2", "ul", "ol", "table", "blockquote", "pre"):
            break
        root = top
    constants, links = [], []

    def under(item: list, path: tuple) -> None:
        if item[0] == SLOT:
            if item[3] >= CONSTANT_PAGES and path[: len(root)] == root:
                constants.extend([path, c] for c in item[6])
            return
        here = path if item[0] == GROUP else (*path, item[0])
        tag = item[0].split(".", 1)[0]
        if len(here) > len(root) and here[: len(root)] == root and tag in ("ul", "ol", "div", "section", "table", "dl") and item[4] and item[5] > LINKED * item[4] and item[4] < 0.5 * max(1.0, best[root]):
            links.append("/".join(here))
            return
        for i in item[6]:
            under(i, here)

    under(wrapper, ())
    # A template's constants need variable text beside them: copies of one page are no template.
    fixed = sum(constant_size(c) for _, c in constants) * wrapper[3]
    if fixed * 2 > best.get(root, 0.0) + fixed or wrapper[3] < CONSTANT_PAGES:
        constants = []
    # Pages of one host share headings.
    inner = lambda path: path[len(root) : len(root) + 1]
    cut = [["/".join(path), c] for path, c in constants if not any(x.split(".", 1)[0] in HEADINGS for x in inner(path))]
    return {"roots": [list(root)], "constants": cut, "links": links, "cut": []}


# Containers that may be a template's; what a list of articles or figures has and one of comments has not; words of
# what an article says of itself.
CONTAINERS, TOLD = frozenset("div section ul ol center details dl".split()), HEADINGS | frozenset("figure table pre img dt dd th td".split())
OWN_WORDS = frozenset("abstract author authors byline caption credit credits date dateline headline intro lead meta published standfirst subtitle summary title updated".split())


def tag_of(item: list) -> str:
    return item[0].split(".", 1)[0]


def flat(items: list[list]) -> Iterator[tuple[list, bool]]:
    """The elements and slots of a sequence, those of groups with true."""
    for i in items:
        if i[0] == GROUP:
            yield from ((x, True) for x in i[6])
        else:
            yield i, bool(i[2])


def is_constant(item: list) -> bool:
    """Whether each page that has the item says the same in it."""
    if item[0] == SLOT:
        return sum(map(constant_size, item[6])) * item[3] >= item[4]
    return all(is_constant(i) for i in item[6])


def tells_of(item: list) -> set[str]:
    return {tag_of(item)} | {t for i in item[6] if item[0] != SLOT for t in tells_of(i)}


def is_remark(item: list) -> bool:
    """A labelled item of a short line and a text, without headings or figures."""
    if item[0] in (SLOT, GROUP) or "." not in item[0] or tag_of(item) not in BLOCK or tells_of(item) & TOLD or not item[4]:
        return False
    inside = [x for x, _ in flat(item[6]) if x[4]]
    return len(inside) > 1 and inside[0][0] != SLOT and inside[0][4] <= BYLINE * item[4]


def containers_of(wrapper: list, roots: set[tuple]) -> set[str]:
    """Paths of labelled containers of articles that are the template's by place and repetition."""
    cut: set[str] = set()

    def within(item: list, path: tuple) -> None:
        items = list(flat(item[6]))
        texts = [k for k, (x, _) in enumerate(items) if x[4] and (x[0] == SLOT or tag_of(x) == "p")]
        for k, (x, _) in enumerate(items):
            if x[0] == SLOT:
                continue
            here = (*path, x[0])
            if "." in x[0] and tag_of(x) in CONTAINERS and OWN_WORDS.isdisjoint(re.split("[^a-z]+", x[0])) and texts and k > texts[0] and x[4]:
                repeats = [y for y, many in flat(x[6]) if many and is_remark(y)]
                if x[3] >= CONSTANT_PAGES and is_constant(x) or k > texts[-1] and repeats and sum(y[4] for y in repeats) > 0.5 * x[4]:
                    cut.add("/".join(here))
                    continue
            within(x, here)

    def find(item: list, path: tuple) -> None:
        if item[0] == SLOT:
            return
        here = path if item[0] == GROUP else (*path, item[0])
        if here in roots and item[0] != GROUP:
            # Copies of one page are no template.
            if not is_constant(item):
                within(item, here)
            return
        for i in item[6]:
            find(i, here)

    find(wrapper, ())
    return cut


def blocks_of(tree: Element, rules: dict) -> list[str]:
    roots, constants, links = {tuple(r) for r in rules["roots"]}, {tuple(c) for c in rules["constants"]}, {*rules["links"], *rules["cut"]}
    above = {r[:k] for r in roots for k in range(1, len(r) + 1)}
    # Of a tag with very many labels in its wrapper, the bare tag stands for each.
    bare = lambda x: x.split(".", 1)[0] + (x[-len(NO_PART) :] if x.endswith((NO_PART, HEADER)) else "")
    known = {*(x for r in roots for x in r), *(x for p, _ in constants for x in p.split("/")), *(x for p in links for x in p.split("/"))}
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        t = " ".join("".join(run).split())
        run.clear()
        if t:
            out.append(t)

    def has_title(node: Element) -> bool:
        return any(isinstance(c, Element) and (c.tag == "h1" or has_title(c)) for c in node.children)

    def walk(node: Element, path: tuple, taking: bool) -> None:
        here = (*path, node.label if node.label in known or bare(node.label) not in known else bare(node.label))
        if not taking and here not in above:
            return
        if node.out and taking and not (node.is_head() and has_title(node)):
            if node.tag in BLOCK:
                flush()
            return
        key = "/".join(here)
        if key in links:
            return
        now = taking or here in roots
        block = node.tag in BLOCK
        if block:
            flush()
        for c in node.children:
            if isinstance(c, str):
                if now and not (constants and (key, as_constant(" ".join(c.split()))) in constants):
                    run.append(c)
            else:
                walk(c, here, now)
        if block:
            flush()

    walk(tree, (), False)
    flush()
    return out


def main_text(page: str, rules: dict | None) -> str:
    """The article by the host's rules; where they find nothing, by the page's own."""
    if not page:
        return ""
    tree = read_tree(page)
    found = blocks_of(tree, rules) if rules else []
    if not found:
        found = blocks_of(tree, rules_of(item_of(tree, False)))
    return "\n".join(found)


# Spark.


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


MADE = "host string, part int, wrapper string"
MADE_ARROW = pa.schema([("host", pa.string()), ("part", pa.int32()), ("wrapper", pa.string())])


def task_wrappers(pages: DataFrame, url: str, html: str) -> DataFrame:
    """For each task and host, the wrapper of the task's pages (more than one where a task has very many hosts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        part = TaskContext.get().partitionId() % PARTS
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for host, page in zip(*(batch.slice(i, 64).column(c).to_pylist() for c in range(2)), strict=True):
                    if page:
                        one = wrapper_of(page)
                        held[host] = merge(held[host], one, True) if host in held else one
                if len(held) > HOSTS_HELD:
                    yield to_batch([(h, part, json.dumps(w)) for h, w in held.items()], MADE_ARROW)
                    held = {}
        if held:
            yield to_batch([(h, part, json.dumps(w)) for h, w in held.items()], MADE_ARROW)

    return pages.select(host_of(url).alias("host"), whole(html).alias("page")).mapInArrow(run, MADE)


def joined_wrappers(made: DataFrame, *keys: str) -> DataFrame:
    """Wrappers with equal keys aligned, as a sorted stream of which one is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, done = None, None, []
        for batch in batches:
            for x in batch.to_pylist():
                k = tuple(x[c] for c in keys)
                one = json.loads(x["wrapper"])
                if k == key:
                    now = merge(now, one, True)
                    continue
                if key:
                    done.append((key[0], key[1] if len(key) > 1 else 0, json.dumps(now)))
                key, now = k, one
            if len(done) > 200:
                yield to_batch(done, MADE_ARROW)
                done = []
        if key:
            done.append((key[0], key[1] if len(key) > 1 else 0, json.dumps(now)))
        if done:
            yield to_batch(done, MADE_ARROW)

    return made.repartition(*keys).sortWithinPartitions(*keys, "wrapper").mapInArrow(run, MADE)


def infer_rules(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, rules (JSON), wrapper (JSON): a row per host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("wrapper").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([json.dumps(rules_of(json.loads(x))) for x in w], pa.string()), batch.column("wrapper")], names=["host", "rules", "wrapper"])

    joined = joined_wrappers(joined_wrappers(task_wrappers(pages, url, html), "host", "part"), "host")
    return written(joined.mapInArrow(run, "host string, rules string, wrapper string"), "rules")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row. Rules reach the pages by a join whose way Spark picks by their size."""
    rules = infer_rules(pages, url, html).select("host", "rules")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), whole(html).alias("page"), host_of(url).alias("host")).join(rules, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                texts = []
                for page, r in zip(part.column("page").to_pylist(), part.column("rules").to_pylist(), strict=True):
                    if r is not None and r not in known:
                        known = {} if len(known) > HOSTS_HELD else known
                        known[r] = json.loads(r)
                    texts.append(main_text(page, known[r] if r is not None else None))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "page", "rules").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
