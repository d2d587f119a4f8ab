"""Operator 6: main text of web pages by tree scoring.

A page is read into blocks of text under a tree of elements. Each block gives points for its length and
its commas to its parent, half of them to the grandparent and less to those above; a container's points
are discounted by the share of its text that is inside links. The container with the most points is
kept, with those of its siblings that have points and few links or are prose, lists, tables or headings.

Elements that by their kind are no article (navigation, footer, form, script, hidden ones) are not read.
What classes and ids say is weighed: a name counts only if every part of it is a word for page furniture
or for its layout (``comment-list``, but not ``related-work``). Readers' comments, adverts, notices and
bars give no points and are left out of what is kept. Other furniture gives a quarter of its points and
is left out where links, or short text without a heading, agree with its name. A page whose heading
is under such a name is read again without names.

The parser is a small helper that sees one page at a time; Spark deals out the pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etholith.llm.common import query, table

# Element names of the HTML standard by role, and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe object svg select xmp noembed noframes annotation annotation-xml".split())
BREAKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p pre blockquote li td dd dt figcaption h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head nav aside footer form menu button dialog search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
FOREIGN = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promos promotion promotions outbrain taboola "
    "comment comments commentary commentlist disqus respond reply replies cookie cookies consent gdpr notice notices newsletter newsletters subscribe subscription "
    "signup login paywall popup popups modal modals overlay sidebar sidebars widget widgets breadcrumb breadcrumbs menu menus nav navs navbar navigation topnav "
    "footer footers masthead pagination pager toolbar hidden skiplink".split()
)
FURNITURE = frozenset("header headers banner banners related recommended recommendations share sharing social copyright legal disclaimer side skip".split())
LAYOUT = frozenset(
    "left right top bottom main site page global primary secondary box bar block section area wrapper wrap container inner outer list item items link links "
    "button buttons slot unit text content body thread count title panel icon icons posts post articles stories message holder inline native only sr visually author meta".split()
)
#: A head or foot of one of these belongs to it.
OWNERS = frozenset("section article entry post story content chapter".split())
#: Words that also tell of a single paragraph, list item or heading what it is.
TELLING = frozenset(
    "ad ads advert advertisement sponsored promo comment comments reply cookie cookies consent gdpr newsletter subscribe paywall breadcrumb breadcrumbs hidden".split()
)
CHILDREN_OF_PROSE = frozenset("p pre blockquote ul ol dl table figure".split())
FORMS = frozenset("form fieldset".split())
#: An open element of the key is closed by a start tag of the values.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
#: An implied end does not reach beyond these.
FENCES = frozenset("ul ol dl table article section div aside main body html blockquote form nav header footer".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"']++|[\"'])*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: White space of the HTML standard and no-break spaces.
BLANK = re.compile(r"[\s ]+")


UNTOLD, ASIDE, AWAY, UNREAD = range(4)


def _named(word: str, tag: str) -> int:
    """What one class or id says of its element."""
    parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])|\d+", word) if p]
    parts = [p.lower() for p in parts]
    own = [p for p in parts if p in FOREIGN or p in FURNITURE]
    if not own or any(p not in LAYOUT and p not in FOREIGN and p not in FURNITURE for p in parts):
        return UNTOLD
    if parts[0] in OWNERS and own[0] in ("header", "headers", "title"):
        return UNTOLD
    if tag in PROSE:
        return AWAY if any(p in TELLING for p in own) else UNTOLD
    return AWAY if any(p in FOREIGN for p in own) or parts == ["side", "bar"] or parts[:2] == ["skip", "link"] else ASIDE


def _judged(tag: str, attributes: str, in_article: bool, forms: bool, names: bool) -> int:
    """Whether an element is read, and what it says of itself."""
    if (tag in DROPPED and not (forms and tag in FORMS)) or (tag == "header" and not in_article):
        return UNREAD
    if not attributes or tag in ("html", "body"):
        return UNTOLD
    found = UNTOLD
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).strip()
        name = name.lower()
        low = value.lower()
        if name == "hidden" or (name == "aria-hidden" and low == "true"):
            return UNREAD
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", low):
            return UNREAD
        if name == "role" and low in ROLES and not (forms and low == "form"):
            return UNREAD
        if name in ("class", "id") and names:
            found = max([found, *(_named(word, tag) for word in value.split())])
    return found


class Page:
    """Elements (parent, tag, what they say of themselves) in page order, and the text blocks below them with their link text."""

    def __init__(self, source: str, forms: bool = False, names: bool = True):
        self.parent, self.tag, self.said, self.blocks = [-1], ["#root"], [UNTOLD], []
        self._forms, self._names = forms, names
        self._stack, self._open, self._refuse, self._links = [0], Counter(), 0, 0
        self._refused_at, self._text, self._linked, self._owner = [], [], 0, 0
        at, raw = 0, None
        for token in TOKEN.finditer(source):
            if token.start() < at:
                continue
            if token.start() > at:
                self._add(source[at : token.start()])
            at = token.end()
            name = token[2]
            if name is None:
                continue
            name = name.lower()
            if token[1]:
                self._end(name)
            elif name in RAW:
                if token[0].endswith("/>") and name == "svg":
                    continue
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = close.end() if close else len(source)
            else:
                self._start(name, token[3])
        if at < len(source):
            self._add(source[at:])
        self._flush()

    def _add(self, text: str) -> None:
        if not self._refuse and text:
            if not self._text:
                self._owner = next(k for k in reversed(self._stack) if self.tag[k] in BREAKS or k == 0)
            self._text.append(text)
            if self._links:
                self._linked += len(text.strip())

    def _flush(self) -> None:
        if self._text:
            text = BLANK.sub(" ", entities.unescape("".join(self._text))).strip()
            if text:
                self.blocks.append((self._owner, text, min(self._linked, len(text))))
        self._text, self._linked = [], 0

    def _pop(self) -> None:
        k = self._stack.pop()
        name = self.tag[k]
        self._open[name] -= 1
        if name == "a":
            self._links -= 1
        if self._refused_at and self._refused_at[-1] == k:
            self._refused_at.pop()
            self._refuse -= 1

    def _close_through(self, names: frozenset | set, fences: frozenset) -> None:
        if not any(self._open[n] > 0 for n in names):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self.tag[self._stack[depth]]
            if name in names:
                while len(self._stack) > depth:
                    self._pop()
                return
            if name in fences:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name in BREAKS:
            self._flush()
            self._close_through({"p"}, FENCES)
            if name in HEADINGS:
                self._close_through(HEADINGS, FENCES | {"p"})
            if name in CLOSES_BY:
                self._close_through(CLOSES_BY[name], FENCES - {"tbody"})
        if name == "br":
            self._add(" ")
        if name in VOID:
            return
        if name == "body" and self._open["body"] or name == "html" and self._open["html"]:
            return
        if name != "head" and self._open["head"] > 0 and name in BREAKS:
            self._close_through({"head"}, frozenset())
        if attributes.endswith("/") and name not in BREAKS and name not in ("a", "b", "i", "em", "strong", "span"):
            return
        k = len(self.tag)
        self.parent.append(self._stack[-1])
        self.tag.append(name)
        self._stack.append(k)
        self._open[name] += 1
        if name == "a":
            self._links += 1
        said = _judged(name, attributes, self._open["article"] + self._open["main"] + self._open["section"] > 0, self._forms, self._names)
        if name not in BREAKS:  # of a word or two inside a block there is nothing to weigh
            said = UNREAD if said in (AWAY, UNREAD) else UNTOLD
        self.said.append(said)
        if said == UNREAD:
            if name in BREAKS:
                self._flush()
            self._refuse += 1
            self._refused_at.append(k)

    def _end(self, name: str) -> None:
        if name in BREAKS:
            self._flush()
        if name not in VOID and self._open[name] > 0:
            self._close_through({name}, frozenset() if name in BREAKS else FENCES)


CLOSES_BY: dict[str, set[str]] = {}
for _open, _starts in CLOSES.items():
    for _name in _starts:
        CLOSES_BY.setdefault(_name, set()).add(_open)


def main_text(source: str | None) -> str:
    """The article's blocks, joined by two line feeds; empty for null, empty or wholly refused pages."""
    if not source:
        return ""
    page = Page(source)
    if not page.blocks:  # a page that is one form, as some tools write them
        page = Page(source, forms=True)
    away = [False] * len(page.tag)
    for k in range(1, len(away)):
        away[k] = page.said[k] == AWAY or away[page.parent[k]]
    if any(away[k] for k, tag in enumerate(page.tag) if tag == "h1") and not any(tag == "h1" and not away[k] for k, tag in enumerate(page.tag)):
        page = Page(source, names=False)
        away = [False] * len(page.tag)
    blocks = [b for b in page.blocks if not away[b[0]]]
    if not blocks:
        return ""
    n = len(page.tag)
    points, size, linked, longest = [0.0] * n, [0] * n, [0] * n, [0] * n
    for owner, text, links in blocks:
        size[owner] += len(text)
        linked[owner] += links
        longest[owner] = max(longest[owner], 80 if page.tag[owner] in HEADINGS else len(text))
        if len(text) >= 25 and page.tag[owner] not in HEADINGS:
            value = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3)
            # A container with text of its own is the paragraph's parent itself.
            k, share = (page.parent[owner] if page.tag[owner] in PROSE else owner), 1.0
            level, weight = 1, 1.0
            while k > 0:
                weight = min(weight, 0.25 if page.said[k] == ASIDE else 1.0)
                points[k] += value * share * weight
                level += 1
                k, share = page.parent[k], 1 / 2 if level == 2 else 1 / (3 * (level - 1))
    for k in range(n - 1, 0, -1):
        size[page.parent[k]] += size[k]
        linked[page.parent[k]] += linked[k]
        longest[page.parent[k]] = max(longest[page.parent[k]], longest[k])
    score = [p * (1 - linked[k] / size[k]) if size[k] else 0.0 for k, p in enumerate(points)]
    best = max(range(n), key=lambda k: (score[k], -k))
    if score[best] <= 0:
        best = next((k for k in range(n) if page.tag[k] in ("article", "main") and size[k]), 0)
    # An article element around the best container is the article.
    k = best
    while k > 0:
        if page.tag[k] == "article":
            best = k
            break
        k = page.parent[k]
    kept = {best}
    if best and page.tag[best] != "article":
        limit = max(10.0, score[best] / 5)
        for k in range(1, n):
            if page.parent[k] != page.parent[best] or not size[k]:
                continue
            density = linked[k] / size[k]
            prose = page.tag[k] in CHILDREN_OF_PROSE and (density < 0.25 if size[k] > 80 else density == 0)
            # Part of the article, however short beside the best: text worth points, or a section beside a section, with few links.
            part = density < 0.25 and (score[k] > 0 or page.tag[k] == page.tag[best] == "section")
            if part or score[k] >= limit or prose or page.tag[k] in HEADINGS:
                kept.add(k)
    inside = [False] * n
    for k in range(n):
        whole = best == 0 or k in kept or (k > 0 and inside[page.parent[k]])
        # Furniture by its name goes where its links, or short text without a heading, agree.
        agreed = page.said[k] == ASIDE and size[k] and k != best and (linked[k] > 0.3 * size[k] or longest[k] < 80)
        inside[k] = whole and not agreed and (k == 0 or best != 0 or inside[page.parent[k]])
    return "\n\n".join(text for owner, text, _ in blocks if inside[owner])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html`` but with ``text`` (whole main text, '' if none). Rows keep their number and other columns."""
    base = pages.drop("text") if html != "text" else pages
    rest = [(c, t) for c, t in base.dtypes if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array((main_text(x.as_py()) for x in batch[html]), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c, _ in rest), texts], names=[*(c for c, _ in rest), "text"])

    return base.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rest), "text string"]))


@query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
