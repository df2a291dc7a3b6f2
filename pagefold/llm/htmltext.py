"""HTML main text: flat text blocks, the words and link density of each and its neighbours, and a decision tree.

A page is cut into blocks at block-level tags.  A block's features are its word count and link density, those of the
blocks before and behind it, and where it stands: in a main container, in a container of page furniture, in a heading.
The tree is grown on the small labelled table below and on a few labelled pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import pieces, table

# Element classes of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics".split()
)
#: Elements without text of their own: what is run or drawn, what a form offers, and a formula's other spellings.
RAW = frozenset("script style noscript template iframe object svg select button textarea title audio video canvas annotation annotation-xml".split())
NESTED = frozenset("object svg template".split())
MAIN = frozenset("article main".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose end tag is often left out, and those of them that the start of one ends.
ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
# Words of class, id and role attributes that name furniture, and those that name the article's body.
HINTS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget "
    "footer header masthead topbar toolbar cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login search share sharing social "
    "related recommended comment comments disqus respond reply complementary contentinfo pagination pager".split()
)
# Words that say where or how large a named part is, not what it holds ("sidebar-right", "related-posts").
PLACES = frozenset(
    "area article articles bar block body bottom box button buttons card cards center col column container content element entry fixed form global group head holder icon icons inner item items "
    "left link links list main mobile module outer page panel post posts primary products right row secondary section site slot small stories story text title top trail unit wrap wrapper".split()
)
# Words that turn a hint behind them, or before them, into a state of the page ("has-sidebar", "ad-free").
STATES, STATES_BEHIND = frozenset("has have no non not with without".split()), frozenset("free less".split())
# Words that name furniture at a name's end, whatever stands before them ("user-comments"), or at its beginning.
ENDINGS = frozenset("comments comment replies disqus sidebar navbar nav breadcrumb breadcrumbs ads advert adverts advertisement advertisements newsletter".split())
BEGINNINGS = frozenset("comments comment disqus".split())
BODY_HINTS = frozenset("article post entry story articlebody".split())

#: A quotation mark opens a value only behind "="; elsewhere, and where nothing closes it, it is a character like others.
ATTRIBUTES = r"""((?:[^>=]++|=[ \t\r\n\f]*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)?+)*+)"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+){ATTRIBUTES}>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s/=]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in ("script", "style")}
RAW_TAG = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in RAW}
NAME_PARTS = re.compile(r"[A-Za-z][a-z]*")

FEATURES = ("words", "links", "words_before", "links_before", "words_behind", "links_behind", "in_main", "page_has_main", "in_furniture", "heading", "only_block")

#: The labelled table, of pages with several blocks: features as listed but the last, then 1 for main text.  Links are
#: the share of words inside anchors.
LABELLED = """
9 0 0 0 60 0 1 1 0 1 1
60 0 9 0 45 0 1 1 0 0 1
45 0.1 60 0 3 0 1 1 0 0 1
3 0 45 0 80 0 1 1 0 0 1
1 0 80 0 22 0 1 1 0 0 1
22 0.3 1 0 14 0 1 1 0 0 1
6 1 30 0 40 0 1 1 0 0 1
2 1 2 1 12 1 1 1 0 0 1
120 0 90 0.1 0 0 1 1 0 0 1
4 0 20 0 70 0 1 1 0 1 1
1 0 0 0 1 0 1 1 0 0 1
1 1 0 0 1 1 0 1 1 0 0
1 1 1 1 1 1 0 1 1 0 0
2 1 1 1 9 0 0 1 1 0 0
9 0 1 1 9 0 0 1 1 0 0
12 0 8 0 30 0 0 1 1 0 0
35 0 60 0 8 0 0 1 1 0 0
80 0 9 0 60 0 0 1 1 0 0
6 0 60 0 0 0 0 1 1 0 0
9 0.2 120 0 0 0 0 1 1 0 0
4 0 5 0 6 0 0 1 1 1 0
25 0 12 0 31 0 1 1 1 0 0
14 0.1 40 0 25 0 1 1 1 0 0
3 0 60 0 5 1 1 1 1 0 0
70 0 30 0 40 0 1 1 1 0 0
2 0 50 0 70 0 1 1 1 1 0
5 1 70 0 4 1 1 1 1 0 0
7 0 0 0 20 0 0 1 0 0 0
30 0 7 0 90 0 0 1 0 0 0
90 0 3 0 12 0 0 1 0 0 0
3 0 90 0 5 0 0 1 0 1 0
15 0.9 6 1 40 0 0 1 0 0 0
60 0 15 0 0 0 0 1 0 0 0
70 0 8 0 65 0 0 0 0 0 1
65 0.05 70 0 20 0 0 0 0 0 1
20 0 65 0 90 0 0 0 0 0 1
33 0.2 40 0 28 0 0 0 0 0 1
14 0 60 0 52 0 0 0 0 0 1
8 0 0 0 70 0 0 0 0 1 1
4 0 90 0 60 0 0 0 0 1 1
5 0 70 0 60 0 0 0 0 0 1
110 0 5 0 95 0.1 0 0 0 0 1
1 1 1 1 1 1 0 0 0 0 0
3 1 2 1 4 1 0 0 0 0 0
12 0.9 5 1 60 0 0 0 0 0 0
30 0.8 40 0 4 1 0 0 0 0 0
18 0.6 10 1 6 1 0 0 0 0 0
4 0 3 1 2 1 0 0 0 0 0
6 0 4 1 0 0 0 0 0 0 0
5 0 2 0 3 0 0 0 0 0 0
3 0 4 0 2 0 0 0 0 0 0
2 0 0 0 5 1 0 0 0 1 0
2 1 80 0 3 1 0 0 0 0 0
6 0.8 95 0 4 1 0 0 0 0 0
4 0 70 0 2 0 0 0 0 0 0
8 0 45 0 0 0 0 0 0 0 0
9 0.9 40 0 40 0 0 0 0 0 0
25 0.9 60 0 30 0 0 0 0 0 0
3 0 2 0 50 0 0 0 0 0 0
17 0 2 0 40 0 0 0 0 0 1
16 0 8 0 16 0 0 0 0 0 1
40 0 3 1 60 0 0 0 0 0 1
55 0 0 0 3 0 0 0 0 0 1
28 0.1 7 0 9 0 0 0 0 0 1
9 0 30 0 26 0 0 0 0 0 1
7 0 2 1 45 0 0 0 0 1 1
9 0 1 1 17 0 0 0 0 1 1
5 0 3 0 30 0 0 0 0 1 1
3 0 4 0 60 0 0 0 0 1 1
1 0 2 1 17 0 0 0 0 1 1
2 0 3 1 60 0 0 0 0 1 1
1 0 40 0 60 0 0 0 0 1 1
1 0 0 0 30 0 0 0 0 1 1
40 0 60 0 10 0 0 0 1 0 0
90 0.1 30 0 20 0 0 0 1 0 0
3 1 1 1 2 1 0 0 1 0 0
7 0 2 1 9 0 0 0 1 1 0
"""

#: Labelled pages, written out: a block whose text begins with + is main text.
PAGES = (
    "<p>+Gone.</p>",
    "<body><p>+Short note.</p></body>",
    "<p>+We are closed until the fifth of next month</p>",
    "<nav><a href=/>Home</a> and a few words</nav>",
    "<p>+A page that is one plain paragraph of fifteen words or so, and that has nothing else at all.",
    "<body>+Text that stands in the body alone, as old pages have it, some twenty words long and without any element around it.</body>",
    "<body><a href=/>Home</a></body>",
    "<body><nav><a href=/a>One</a></nav><h1>+Plain title</h1><p>+First paragraph, ten words of text and a little more.</p><p>+Second one with <a href=x>a link</a> inside, and text before and behind it.</p><footer>Contact us</footer></body>",
    "<body><div class=menu><a href=a>News</a> <a href=b>Sport</a></div><main><h2>+Title</h2><p>+Yes.</p><table><tr><td>+Name</td><td>+Forty words of it</td><td class=comments>A reader says something here</td></tr></table></main></body>",
    "<body><article><p>+One.</p><dl><dt>+Term</dt><dd>+What it means</dd></dl></article><aside><p>More from us, a longer list of things to read another day</p></aside></body>",
)


def grow(rows: list[list[float]], least: int = 1) -> tuple | int:
    """A decision tree by Gini impurity: (feature, threshold, tree at or below, tree above), or a label."""
    labels = [r[-1] for r in rows]
    ones = sum(labels)
    if ones in (0, len(rows)):
        return int(labels[0])

    def impurity(part):
        n, k = len(part), sum(r[-1] for r in part)
        return 2 * k * (n - k) / n if n else 0.0

    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            at = (low + high) / 2
            left, right = [r for r in rows if r[f] <= at], [r for r in rows if r[f] > at]
            if min(len(left), len(right)) >= least:
                cost = impurity(left) + impurity(right)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, at, left, right)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, at, left, right = best
    return f, at, grow(left, least), grow(right, least)


def featured(found: list) -> list[tuple]:
    """The features of a page's blocks, as FEATURES lists them."""
    has_main = any(b[3] for b in found)
    share = [b[2] / b[1] for b in found]
    out = []
    for i, (_, words, _, in_main, in_furniture, heading) in enumerate(found):
        before = (found[i - 1][1], share[i - 1]) if i else (0, 0.0)
        behind = (found[i + 1][1], share[i + 1]) if i + 1 < len(found) else (0, 0.0)
        out.append((words, share[i], *before, *behind, in_main, has_main, in_furniture, heading, len(found) == 1))
    return out


def table_rows() -> list[list[float]]:
    return [[*x[:-1], 0.0, x[-1]] for x in ([float(v) for v in line.split()] for line in LABELLED.strip().splitlines())]


def fitted() -> tuple:
    rows = table_rows()
    for page in PAGES:
        found = blocks(page)
        rows += [[*map(float, x), float(b[0].startswith("+"))] for b, x in zip(found, featured(found), strict=True)]
    return grow(rows)


def classify(tree, x) -> int:
    while isinstance(tree, tuple):
        f, at, left, right = tree
        tree = left if x[f] <= at else right
    return tree


def hints(attributes: str) -> tuple[bool, bool, bool]:
    """Whether the element is hidden; whether class, id or role name furniture; whether they name an article's body."""
    hidden, furniture, body = bool(HIDDEN.search(attributes)), False, False
    for m in ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = [p.lower() for p in NAME_PARTS.findall(name)]
            # The whole name must be furniture: "related-posts" is, "related-work" is not.
            plain = all(p in HINTS or p in PLACES for p in parts)
            furniture |= plain and any(p in HINTS and STATES_BEHIND.isdisjoint(parts[i + 1 : i + 2]) for i, p in enumerate(parts))
            furniture |= bool(parts) and (parts[-1] in ENDINGS or parts[0] in BEGINNINGS and STATES_BEHIND.isdisjoint(parts)) and STATES.isdisjoint(parts)
            body |= not BODY_HINTS.isdisjoint(parts) and m[1].lower() == "class"
    return hidden, furniture, body and not furniture and not hidden


def raw_ends(page: str, tag: str) -> dict[int, int]:
    """Where each closed element of a RAW tag begins and ends; a tag that opens again before it closes was left open."""
    out, opened = {}, []
    for m in RAW_TAG[tag].finditer(page):
        if m[1]:
            if opened:
                out[opened.pop()] = m.end()
        elif not m[0].endswith("/>"):
            if tag not in NESTED:
                opened.clear()
            opened.append(m.start())
    return out


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, words in links, in main, in furniture, heading) of every block that has text, in page order."""
    out, held, linked = [], [], []
    open_: list[tuple[str, bool, bool, bool, int]] = []  # tag, main, furniture, hinted furniture, hinted outside
    opened: Counter[str] = Counter()  # tags of open_
    main = furniture = hinted = link = 0  # hinted: furniture by class, id or role alone, inside the nearest MAIN element
    wrapped = 0  # hinted furniture around the MAIN elements that are open
    heading = False
    ends: dict[str, dict[int, int]] = {}
    around: list[int] = []  # for each block: hinted furniture around the MAIN elements that it is in

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                words = text.count(" ") + 1
                in_links = len(html.unescape(" ".join(linked)).split()) if linked else 0
                out.append((text, words, min(words, in_links), main > 0, furniture > 0 or hinted > 0, heading))
                around.append(wrapped)
            held.clear()
            linked.clear()

    def leave() -> str:
        nonlocal main, furniture, hinted, wrapped
        tag, was_main, was_furniture, was_hinted, outside = open_.pop()
        opened[tag] -= 1
        main -= was_main
        furniture -= was_furniture
        hinted += outside - was_hinted
        wrapped -= outside
        return tag

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            held.append(page[at:stop])
            if link:
                linked.append(page[at:stop])
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not m[2] and not page.endswith(">", 0, at):
            break  # a tag that the page's end cuts off
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                if tag in RAW_END:
                    close = RAW_END[tag].search(page, at)
                    at = close.end() if close else end
                else:
                    if tag not in ends:
                        ends[tag] = raw_ends(page, tag)
                    if (close_at := ends[tag].get(m.start())) is not None:
                        at = max(at, close_at)
                    elif tag in ("title", "textarea"):  # left open: its text goes up to the next tag
                        next_tag = page.find("<", at)
                        at = next_tag if next_tag >= 0 else end
                    else:  # left open: an ordinary container
                        flush()
            if tag not in ("svg", "select", "button"):
                continue
            held.append(" ")
        elif tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            held.append(" ")
            if link:
                linked.append(" ")
        elif tag not in INLINE:
            flush()
            if tag in HEADINGS:
                heading = not closing
            elif closing:
                heading = False
            if closing:
                if opened[tag]:
                    while leave() != tag:
                        pass
            elif tag not in VOID and tag not in ("p", "li", "html", "head", "body", *HEADINGS):
                while open_ and open_[-1][0] in ENDS.get(tag, ()):
                    leave()
                hidden, named, body = hints(attributes) if attributes else (False, False, False)
                is_furniture = tag in FURNITURE or (tag == "header" and not main) or hidden and not main and tag not in MAIN
                is_hinted = not is_furniture and named and tag not in MAIN
                is_main = not is_furniture and not is_hinted and (tag in MAIN or body)
                outside = hinted if tag in MAIN else 0
                open_.append((tag, is_main, is_furniture, is_hinted, outside))
                opened[tag] += 1
                main += is_main
                furniture += is_furniture
                hinted += is_hinted - outside
                wrapped += outside
            elif attributes and tag in ("p", "li") and any(hints(attributes)[1 if main else 0 : 2]):
                # Furniture of one block: it ends where the next block begins.
                close = re.compile(rf"</?(?:{tag}|div|section|article|main|footer|aside|nav|ul|ol)\b", re.IGNORECASE).search(page, at)
                at = close.start() if close else end
    flush()
    # The hints around the outermost MAIN elements are a wrapper's; MAIN elements inside more hints are teasers or comments.
    least = min((n for b, n in zip(out, around, strict=True) if b[3] and not b[4]), default=0)
    return [(*b[:4], b[4] or n > least, b[5]) for b, n in zip(out, around, strict=True)]


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    return "\n\n".join(b[0] for b, x in zip(found, featured(found), strict=True) if classify(tree, x))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, *keep, text) of every page, one row for each input row; `keep` may not name a column called text.

    Words that the article hides stay, as do formulas; what a form's controls say goes.  A null or empty page, or one without main text, gives ''.  Character references are decoded, white space in a
    block is one space, blocks are joined by an empty line.  Rows that repeat stay; other columns are not read.
    """
    if "text" in (id_col, *keep):
        raise ValueError("a kept column is called text, as the result's own is: rename it first")
    rows = pages.select(id_col, *keep, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html"))
    at, tree = len(keep) + 1, fitted()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", text string"

    def run(batches):
        for batch in batches:
            for b in pieces(batch, at):
                texts = pa.array([main_text(h, tree) for h in b.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], [*b.schema.names[:-1], "text"])

    return rows.mapInArrow(run, schema)


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLE_SQL: dict[str, str] = {}
