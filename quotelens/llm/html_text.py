"""Main text of web pages by two-pass block rules.

A page is cut into blocks. The first pass decides blocks on their own, by
what encloses them, length, link density and stop-word density; short blocks
stay undecided. In the second pass these take the label of the nearest
decided block of their region."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Frequent function words of the languages that are told from menus.
STOP_WORDS = frozenset((
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they "
    "this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous ou par pas plus pour que qui sa "
    "se ses son sur un une vous "
    "aber als am auch auf aus bei das dem den der die ein eine einen er es für hat ich im ist mit nach nicht oder sich "
    "sie sind so und vom von war wie zu zum zur "
    "al con del el esta las lo los más no para pero por si sin su sus todo y").split())
# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg iframe object canvas audio video math select textarea title".split())
BLOCKS = frozenset((
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul").split()) - {"br"}
BOILERPLATE = frozenset("nav footer aside form menu button dialog label legend head".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar".split())
CLASSES = frozenset((
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar aside widget related recommended recommendations menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager footer copyright comment comments commentlist reply replies respond disqus share sharing "
    "social search form hidden skip").split())
HEADER_CLASSES = frozenset("header masthead topbar".split())
MAIN_TAGS = frozenset("article main".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORDS = re.compile(r"[^\W\d_]+")
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

GOOD, BAD, SHORT = 1, -1, 0


def is_boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    """Does this element hold boilerplate? ``inside``: it lies in an article."""
    if tag in BOILERPLATE or tag == "header" and not inside:
        return True
    if not attributes or tag in MAIN_TAGS or tag in ("html", "body"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id"):
            parts = {p.lower() for p in PIECES.findall(value)}
            if parts & CLASSES or not inside and parts & HEADER_CLASSES:
                return True
    return False


def blocks(page: str) -> list[tuple]:
    """``(text, link characters, boilerplate?, region, heading?)`` of each
    block with text; region 0 is outside of articles."""
    out: list[tuple] = []
    text: list[str] = []
    linked = [0]
    stack: list[tuple] = []  # (tag, boilerplate, region)
    bad, region, regions, links, heading = 0, 0, 0, 0, False

    def end() -> None:
        if text:
            got = " ".join("".join(text).split())
            if got:
                out.append((got, linked[0], bad > 0, region, heading))
            text.clear()
        linked[0] = 0

    def say(s: str) -> None:
        text.append(html.unescape(s) if "&" in s else s)
        if links:
            linked[0] += len(s.strip())

    def close(k: int) -> None:
        nonlocal bad, region, links
        while len(stack) > k:
            tag, was_bad, before = stack.pop()
            bad -= was_bad
            region = before
            links -= tag == "a"

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            gt = page.find("-->", lt + 4)
            at = n if gt < 0 else gt + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            gt = page.find(">", lt)
            at = n if gt < 0 else gt + 1
            continue
        m = TAG.match(page, lt)
        if m is None:
            if re.match(r"</?[a-zA-Z]", page[lt:lt + 3]):  # a tag that the page's end cuts off, or with an open quote
                gt = page.find(">", lt)
                at = n if gt < 0 else gt + 1
            else:
                say("<")
                at = lt + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if not closing and tag in SKIPPED:
            if attributes.endswith("/"):
                continue
            over = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            gt = page.find(">", over.start()) if over else -1
            at = n if gt < 0 else gt + 1
            say(" ")
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCKS:
            end()
            heading = False
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in BLOCKS:  # a block ends an open paragraph, a list item the one before
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
            heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
        boiler = is_boilerplate(tag, attributes, region > 0)
        stack.append((tag, boiler, region))
        bad += boiler
        links += tag == "a"
        if tag in MAIN_TAGS and not region:
            regions += 1
            region = regions
    end()
    return out


def first_pass(block: tuple, low: float, high: float, short: int, long: int, max_links: float) -> int:
    """The label of a block on its own."""
    text, linked, boiler, region, heading = block
    if boiler or linked > max_links * len(text):
        return BAD
    words = WORDS.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if region:  # in an article only short blocks are in doubt
        return GOOD if len(text) >= short or density >= high else SHORT
    if heading or len(text) < short:
        return SHORT
    if density >= high:
        return GOOD
    if density >= low:
        return GOOD if len(text) >= long else SHORT
    return BAD


def main_text(page: str | None, low: float = 0.1, high: float = 0.2, short: int = 40, long: int = 200,
              max_links: float = 0.4) -> str:
    """The main text of one page (see ``extract``)."""
    found = blocks(page or "")
    labels = [first_pass(b, low, high, short, long, max_links) for b in found]
    article = any(b[3] and lab != BAD for b, lab in zip(found, labels))
    n = len(found)
    # the nearest decided block before and after, of the same region; an article's insets decide nothing in it
    near: list[list] = [[None] * n, [None] * n]
    for side, order in ((0, range(n)), (1, range(n - 1, -1, -1))):
        last: dict = {}
        for i in order:
            if labels[i] != SHORT and not (found[i][2] and found[i][3]):
                last[found[i][3]] = i
            near[side][i] = last.get(found[i][3])
    keep = []
    for i, (text, _, _, region, heading) in enumerate(found):
        label = labels[i]
        if label == SHORT:
            before, after = near[0][i], near[1][i]
            if before is None and after is None:
                label = GOOD if region else BAD
            elif before is None or after is None:
                label = GOOD if region else labels[after if before is None else before]
            elif heading:
                label = labels[after]
            elif i - before != after - i:
                label = labels[before] if i - before < after - i else labels[after]
            else:
                label = GOOD if GOOD in (labels[before], labels[after]) and region or \
                    labels[before] == labels[after] == GOOD else BAD
        if label == GOOD and (region or not article):
            keep.append(text)
    return "\n\n".join(keep)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text string, n_chars long`` per row: the article's text
    without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, comments and markup. Character references are decoded,
    white space in a block is one space, blocks are joined by an empty line in
    page order. Where a page has an article (or main) element, only blocks in
    it count.

    A null or empty page has an empty text; broken markup is read as far as it
    goes. Null and repeated ids are rows like others, other columns are not
    read, an empty table gives an empty result. One page is one worker's."""
    rows = small_batches(df).select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                     F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())],
                    ["page_id", "url", "text", "n_chars"])
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
