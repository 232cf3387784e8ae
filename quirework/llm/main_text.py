"""Main-text extraction from web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one labels every block by
rules: link density, length and stop-word density make it good, bad or, if it
is short or of middling density, leave it open; markup that says menu, footer,
form, advert, comment and the like takes it out. Pass two gives each open block
the label of its nearest decided neighbour.

Markup for the article (or main part) is one feature more: it is believed if
pass one finds at least half of the page's good text inside. Then only that part
can hold main text, less density makes its blocks good, and an undecided
neighbourhood counts for a block rather than against it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points below which a block is short, and from which it is long.
SHORT = 70
LONG = 200
#: Share of stop words that makes a long block, a middling one, and one in a believed article good; below the last it is bad.
STOP_LONG = 0.20
STOP_MIDDLING = 0.25
STOP_ARTICLE = 0.10
STOP_LEAST = 0.05
LINKS_MOST = 0.5

# Function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do for from had has have he her
    him his how i if in into is it its more most my no not of on one only or other our out she should so some such than
    that the their them then there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch ein eine einem einen einer es für hat
    haben ich ihr im in ist ja kann mit nach nicht noch nur oder sehr sich sie sind so um und uns unter vom von vor war
    wenn werden wie wir zu zum zur über
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par
    pas plus pour qu que qui sa se ses son sont sur un une vous à été être
    al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no
    nos o para pero por que se sin sobre son su sus también un una y ya
    """.split()
)
# Tag names by role, and words in class or id that mark what isn't main text.
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option optgroup p pre section select
    summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe xmp noembed noframes".split())
OUT = frozenset("nav footer aside form button select dialog menu svg math canvas object audio video head".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
OUT_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner cookie
    cookies consent gdpr notice notices sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer
    masthead topbar comment comments commentlist reply replies respond disqus share sharing social related recommended
    newsletter subscribe popup modal overlay widget widgets login signup pagination pager toolbar copyright""".split()
)
KEPT = frozenset("html body main".split())
#: An article's own classes name topics too, so only these say that it is no page's article.
NO_ARTICLE = frozenset(
    """comment comment-body comment-item comment-entry comment-content comments reply review ad ads advert advertisement
    sponsored promo promotion related teaser widget""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    "p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()),
    "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()),
    "th": frozenset("td th".split()), "option": frozenset("option".split()),
}
SCOPE = frozenset("ul ol table article section div main body aside nav footer header form td th blockquote".split())

_PARAGRAPH = frozenset(["p"])
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]{0,4096}\"|'[^']{0,4096}')*+)>")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Block:
    __slots__ = ("parts", "linked", "out", "inside", "heading")

    def __init__(self, out: bool, inside: bool, heading: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.out, self.inside, self.heading = out, inside, heading

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class _Open:
    """The open elements, with counts and places kept up to date, so that no question walks through them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, int]] = []
        self.places: dict[str, list[int]] = {}
        self.out = self.articles = self.headings = 0

    def push(self, name: str, out: bool, article: bool) -> None:
        at = len(self.stack)
        scope = at if name in SCOPE else self.stack[-1][3] if at else -1
        self.stack.append((name, out, article, scope))
        self.places.setdefault(name, []).append(at)
        self.out += out
        self.articles += article
        self.headings += name in HEADINGS

    def cut(self, at: int) -> None:
        """Closes all elements from that place on."""
        while len(self.stack) > at:
            name, out, article, _ = self.stack.pop()
            self.places[name].pop()
            self.out -= out
            self.articles -= article
            self.headings -= name in HEADINGS

    def close(self, name: str) -> None:
        if self.places.get(name):
            self.cut(self.places[name][-1])

    def close_implied(self, names: frozenset[str]) -> None:
        """Closes the innermost of these names if no scope was opened within it."""
        at = max((p[-1] for n in names if (p := self.places.get(n))), default=-1)
        if at >= 0 and at > self.stack[-1][3]:
            self.cut(at)


def _marked_out(name: str, attrs: str, in_article: bool) -> bool:
    if name in OUT or name == "header" and not in_article:
        return True
    if not attrs or name in KEPT and "hidden" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if name in KEPT:
            continue
        if key == "role" and value.lower() in OUT_ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "itemtype" and value.lower().endswith("/comment"):
            return True
        if key in ("class", "id"):
            if name == "article":
                if NO_ARTICLE.intersection(value.lower().split()):
                    return True
                continue
            words = {w.lower() for w in _PIECE.findall(value)}
            if words & OUT_WORDS or not in_article and "header" in words:
                return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order; time grows with the page, however deep its elements are nested."""
    found: list[Block] = []
    open_ = _Open()
    now: Block | None = None
    links = 0
    at, n = 0, len(page)

    def push_text(s: str) -> None:
        nonlocal now
        s = html.unescape(s) if "&" in s else s
        if now is None:
            if not s.strip():
                return
            now = Block(open_.out > 0, open_.articles > 0, open_.headings > 0)
            found.append(now)
        now.parts.append(s)
        if links:
            now.linked += len(s.strip())

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            push_text(page[at:])
            break
        if lt > at:
            push_text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):  # a tag without end: up to the next >, or all that is left
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                push_text("<")
                at = lt + 1
            continue
        closing, name, attrs = bool(m[1]), m[2].lower(), m[3]
        at = m.end()
        if name == "br":
            push_text(" ")
            continue
        if name in BLOCK:
            now = None
        if closing:
            if name == "a":
                links = 0
            open_.close(name)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>?", re.IGNORECASE).search(page, at)
            at = n if not end else end.end()
            continue
        if name in VOID or attrs.endswith("/") and name not in BLOCK and name != "a":
            continue
        if name == "a":
            links = 1
            continue
        if name in CLOSES:
            open_.close_implied(CLOSES[name])
        elif name in BLOCK:
            open_.close_implied(_PARAGRAPH)  # a block tag ends an open paragraph
        in_article = open_.articles > 0
        out = _marked_out(name, attrs, in_article)
        starts = (name in ("article", "main") or 'role="main"' in attrs) and not out and not open_.out
        if name in BLOCK or out:
            open_.push(name, out, starts)
    return found


def _rule_label(b: Block, text: str, article: bool) -> str | None:
    """Pass one: good, bad, out (by markup) or None (open); ``article``: the block lies in an article that is believed."""
    n = len(text)
    if b.out or not n:
        return "out"
    if b.linked > LINKS_MOST * n:
        return "bad"
    if not article and ("\N{COPYRIGHT SIGN}" in text or n < SHORT and b.linked):
        return "bad"
    if n < SHORT:
        return None
    words = _WORD.findall(text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if article:
        return "good" if stop >= STOP_ARTICLE else None
    if stop >= (STOP_LONG if n >= LONG else STOP_MIDDLING):
        return "good"
    return "bad" if stop < STOP_LEAST else None


def _inherited(labels: list[str | None], blocks: list[Block], undecided: str) -> list[str]:
    """Pass two: open blocks take the label of the nearest decided block; of two different ones as near, a heading is good."""
    # "out" is no neighbour, since markup says nothing about the text around it
    decided = [i for i, x in enumerate(labels) if x in ("good", "bad")]
    out, k = [], 0
    for i, label in enumerate(labels):
        if label is None:
            while k < len(decided) and decided[k] < i:
                k += 1
            near = [(abs(j - i), labels[j]) for j in decided[max(k - 1, 0) : k + 1]]
            closest = {x for d, x in near if d == min(near)[0]}
            label = closest.pop() if len(closest) == 1 else undecided if not closest or not blocks[i].heading else "good"
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """Main text of one page; empty for null and empty pages and where nothing qualifies."""
    if not page:
        return ""
    blocks = blocks_of(page)
    texts = [b.text() for b in blocks]
    labels = [_rule_label(b, t, False) for b, t in zip(blocks, texts)]
    good = [(b.inside, len(t)) for b, t, x in zip(blocks, texts, labels) if x == "good"]
    inside = sum(n for i, n in good if i)
    article = any(b.inside and not b.out for b in blocks) and 2 * inside >= sum(n for _, n in good)
    if article:
        labels = [_rule_label(b, t, True) if b.inside else "out" for b, t in zip(blocks, texts)]
    elif not good:  # a page without any decided text: blocks that aren't short need less to be good
        labels = [_rule_label(b, t, True) if x is None else x for b, t, x in zip(blocks, texts, labels)]
    labels = _inherited(labels, blocks, "good" if article else "bad")
    return " ".join(t for t, x in zip(texts, labels) if x == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Null pages count as empty; text is empty where a page has none; repeated
    rows stay; an empty table gives no rows; other columns are ignored.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(None if pd.isna(t) else t) for t in s], dtype=object)

    return pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), texts(F.col(html_col).cast("string")).alias("text")
    ).withColumn("n_chars", F.length("text").cast("long"))
