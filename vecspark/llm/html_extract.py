"""Main text of web pages by two passes over their blocks.

A scanner reads the page once, from tag to tag, and matches end tags to elements. Blocks are runs of text between
block-level tags. The first pass decides a block from its link density, its length and its density of stop words, and
from the elements that hold it: menus, page headers and footers, sidebars, notices, adverts, forms and reader comments
are boilerplate by tag, role, class or id; an article or main element is text, links or not, but for such parts of it.
Blocks that stay undecided, mostly short ones, inherit in the second pass the label of the nearest decided neighbours in
the same region, which is the innermost article, main or boilerplate element. Text beside an article that is at
least as long belongs to no article and goes.

Defined results: a null or empty page has an empty text and 0 characters; elements without an end tag end where a parent
or the page ends, and those whose contents are skipped (svg, video, object) have none then; self-closing elements end at once;
comments and scripts without an end take the rest of the page, as in browsers, a tag without its ``>`` too; each
row gets a row, repeated or null ids too; an empty table gives no rows; other columns of the input aren't returned.
Whole pages are processed; time is linear in their length, whatever they hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame, SparkSession

from vecspark.llm.common import ship, sliced

#: Frequent function words of the languages of the corpus.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their if do will each about how up out them then she
    der die das und ist in den von zu mit sich auf für nicht es dem ein eine als auch an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch
    de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux d' l' ou si leur mais comme tout nous sa fait été aussi ces on dont elle cette
    de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde
    """.split()
)

#: Elements that start and end a block.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no other elements, and those that hold text up to their end tag only.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp".split())
#: Elements, beside those, whose contents are no text of the page.
SKIPPED = frozenset("head template svg math object canvas audio video".split())
#: Elements that end where the next of their kind begins.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
#: Elements and roles that hold boilerplate, and parts of class names and ids that say so.
BAD_TAGS = frozenset("nav footer aside form menu dialog button select fieldset".split())
FIRM_TAGS = BAD_TAGS - {"form", "fieldset"} | {"header"}
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|footer|masthead|sidebar|side|aside|widget\w*|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscri\w*|"
    r"comments?|commentlist|replies|reply|respond|disqus|discussion|feedback|share\w*|sharing|social|related|recommend\w*|login|signup|signin|search\w*|pagination|pager|tags|copyright|disclaimer|toolbar|skip)(?=$|[\s_-])",
    re.I,
)
#: Elements that a single paragraph is in, and the names that make one of them boilerplate.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption".split())
BAD_PARAGRAPHS = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|newsletter|subscri\w*|copyright|disclaimer)(?=$|[\s_-])", re.I)
#: Names of a reader's comment, which may be an article in an article.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|reply|respond|disqus)(?=$|[\s_-])", re.I)
#: Names that tell of a layout, as no-sidebar or has-menu.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:no|has|with|without)[_-]\S+", re.I)
HIDDEN = re.compile(r"display\s{0,9}:\s{0,9}none|visibility\s{0,9}:\s{0,9}hidden", re.I)

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The end of a tag, or its next attribute. Nothing in it can match in two ways, so that it never tries again.
ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?)""")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}
WORD = re.compile(r"[^\W\d_]+")

#: Characters of a block from which its stop words decide, and from which their lack does.
LONG, VERY_LONG = 70, 200
#: Share of stop words from which a long block is text, and below which a very long one outside articles is not.
DENSE, SPARSE = 0.12, 0.03
#: Share of a block's characters in links above which it is a menu.
LINKS = 0.5


def scan(page: str) -> list:
    """The page as a list: its texts, and (name, kind, attributes) of its tags; kind is "start", "end" or "empty"."""
    out: list = []
    missing: set[str] = set()  # elements without a further end tag
    at, size = 0, len(page)
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            out.append(page[at:])
            break
        if tag > at:
            out.append(page[at:tag])
        after = page[tag + 1 : tag + 2]
        if after in ("!", "?"):
            comment = page.startswith("<!--", tag)
            end = page.find("-->", tag + 2) if comment else page.find(">", tag)
            at = end + (3 if comment else 1) if end >= 0 else size
            continue
        ending = after == "/"
        named = NAME.match(page, tag + 1 + ending)
        if not named:
            if ending:  # a comment too
                end = page.find(">", tag)
                at = end + 1 if end >= 0 else size
            else:
                out.append("<")
                at = tag + 1
            continue
        name, at, attributes = named[0].lower(), named.end(), {}
        slash = False
        while True:
            m = ATTRIBUTE.match(page, at)
            if not m:
                return out  # a tag without its end
            slash = m[1] is not None and m.start(1) > at and page[m.start(1) - 1] == "/"
            at = m.end()
            if m[1]:
                break
            attributes.setdefault(m[2].lower(), m[3] or m[4] or m[5] or "")
        if ending:
            out.append((name, "end", None))
        elif name in RAW and not (slash and name != "script"):
            end = None if name in missing else ENDS[name].search(page, at)
            if end:
                at = end.start()
            elif name in ("script", "style"):
                break
            else:
                missing.add(name)
        else:
            out.append((name, "empty" if slash or name in VOID else "start", attributes))
    return out


def extents(tokens: list) -> dict[int, tuple[int, bool]]:
    """For each element that is a block or skipped: where it ends, and whether by its own end tag."""
    out: dict[int, tuple[int, bool]] = {}
    stack: list[int] = []
    open_: Counter = Counter()

    def close(at: int, own: bool) -> None:
        first = stack.pop()
        open_[tokens[first][0]] -= 1
        out[first] = at, own

    for i, token in enumerate(tokens):
        if isinstance(token, str):
            continue
        name, kind, _ = token
        if name not in BLOCK_TAGS and name not in SKIPPED:
            continue
        if kind == "end":
            if open_[name]:
                while tokens[stack[-1]][0] != name:
                    close(i, False)
                close(i, True)
            continue
        if name in BLOCK_TAGS:  # ends paragraphs, and a head
            while stack and tokens[stack[-1]][0] in ("p", "head"):
                close(i, tokens[stack[-1]][0] == "head")
        while stack and tokens[stack[-1]][0] in ENDED_BY.get(name, ()):
            close(i, False)
        if kind == "start":
            stack.append(i)
            open_[name] += 1
    while stack:
        close(len(tokens), False)
    return out


def boilerplate(tag: str, attributes: dict[str, str], kind: str) -> bool:
    """Whether an element holds boilerplate; an article's own header is part of it, and articles are never so by name."""
    if tag in BAD_TAGS or tag == "header" and kind != "article":
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in BAD_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attributes.get("style", "")):
        return True
    if tag in ("html", "body", "main"):
        return False
    names = LAYOUT.sub("", f"{attributes.get('class', '')} {attributes.get('id', '')}")
    if tag == "article":
        return kind == "article" and bool(COMMENTS.search(names))
    return bool((BAD_PARAGRAPHS if tag in PARAGRAPHS else BAD_NAMES).search(names))


def blocks(page: str) -> list[tuple[str, float, int, str]]:
    """(text, share of characters in links, region, kind of region: "article", "bad" or "page") of each block.

    An article in a box of boilerplate is boilerplate, unless the page has no other: then the box has no end tag, or its name misleads.
    """
    tokens = scan(page)
    ends = extents(tokens)
    found, articles = _walk(tokens, ends, False)
    return _walk(tokens, ends, True)[0] if articles == {"inner"} else found


def _walk(tokens: list, ends: dict[int, tuple[int, bool]], lift: bool) -> tuple[list[tuple[str, float, int, str]], set[str]]:
    """The blocks; and whether there are articles "outer" and "inner" to boilerplate; ``lift`` takes the latter as such."""
    out: list[tuple[str, float, int, str]] = []
    text: list[str] = []
    linked = links = skipped = 0
    articles: set[str] = set()
    stack: list[tuple[int, int, str, bool]] = []  # where each region ends, and what holds before it
    regions, region, kind, firm = 1, 0, "page", False  # firm: boilerplate whatever is in it

    def flush() -> None:
        nonlocal linked
        raw = "".join(text)
        if found := " ".join(raw.split()):
            out.append((found, linked / max(1, len(raw)), region, kind))
        text.clear()
        linked = 0

    for i, token in enumerate(tokens):
        if i < skipped:
            continue
        if stack and stack[-1][0] <= i:
            flush()
            while stack and stack[-1][0] <= i:
                _, region, kind, firm = stack.pop()
        if isinstance(token, str):
            token = unescape(token) if "&" in token else token
            text.append(token)
            linked += len(token) if links else 0
            continue
        tag, way, attributes = token
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            links = 1 if way == "start" else 0
        elif tag in SKIPPED and way == "start":
            end, closed = ends[i]
            if closed:
                skipped = end
                if tag == "head":
                    flush()
        elif tag in BLOCK_TAGS:
            flush()
            links = 0 if way != "start" or tag in ("p", "li", "div") else links
            if way != "start":
                continue
            own = None
            if boilerplate(tag, attributes, kind):
                own = "bad" if kind != "bad" else None
            elif tag in ("main", "article"):
                if kind != "bad":
                    articles.add("outer")
                    own = "article"
                elif not firm:
                    articles.add("inner")
                    own = "article" if lift else None
            if own:
                stack.append((ends[i][0], region, kind, firm))
                firm = own == "bad" and (ends[i][1] and tag in FIRM_TAGS or bool(COMMENTS.search(f"{attributes.get('class', '')} {attributes.get('id', '')}")))
                region, kind, regions = regions, own, regions + 1
    flush()
    return out, articles


def first_pass(block: tuple[str, float, int, str]) -> bool | None:
    """True for text, False for boilerplate, None where the rules don't decide."""
    text, links, _, kind = block
    if kind == "bad" or kind == "page" and links > LINKS:
        return False
    if len(text) < LONG:
        return False if kind == "page" and ("\xa9" in text or "copyright" in text.lower()) else None
    words = WORD.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density >= DENSE and links <= LINKS / 2:
        return True
    return False if kind == "page" and len(text) >= VERY_LONG and density < SPARSE else None


def second_pass(found: list[tuple[str, float, int, str]], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided ones on both sides in their region.

    In an article one neighbour of text is enough, and none at all; elsewhere both sides must be text, over regions
    if a region has none.
    """
    n = len(found)

    def nearest(order, same_region: bool) -> list[bool | None]:
        last: dict[int, bool] = {}
        out: list[bool | None] = [None] * n
        for i in order:
            key = found[i][2] if same_region else 0
            out[i] = last.get(key)
            if labels[i] is not None:
                last[key] = labels[i]
        return out

    before, after = nearest(range(n), True), nearest(range(n - 1, -1, -1), True)
    page_before, page_after = nearest(range(n), False), nearest(range(n - 1, -1, -1), False)
    out = []
    for i, label in enumerate(labels):
        if label is None:
            sides = [x for x in (before[i], after[i]) if x is not None]
            if found[i][3] == "article":
                label = any(sides) or not sides
            else:
                label = all(sides) if sides else bool(page_before[i] and page_after[i])
        out.append(label)
    size = {k: sum(len(b[0]) for b, label in zip(found, out, strict=True) if label and b[3] == k) for k in ("article", "page")}
    return [label and (b[3] == "article" or size["article"] < size["page"]) for b, label in zip(found, out, strict=True)]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    keep = second_pass(found, [first_pass(b) for b in found])
    return " ".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def html_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of ``pages`` (page_id, url, html). No shuffle."""
    ship(pages.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id AS bigint) AS page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
