"""Main text of web pages by two passes of block rules.

A page is read once, tag by tag.  Elements that hold no article text by their
name, role, class or id (menus, site headers, footers, sidebars, notices,
adverts, forms, comments, scripts, styles) are passed over, up to the next block
where they are never closed; the rest falls into blocks at block-level tags.

Pass 1 classifies each block by itself.  Mostly links: bad, but undecided for a
heading.  Short: undecided, or bad with links outside an article.  Many stop
words, some in a long block, or a very long block: good.  Few stop words and
some links: bad; without links undecided, as the language may be unknown.

Pass 2 lets undecided blocks inherit from the nearest decided ones.  Between two
of one kind: that kind, but good for a run of undecided blocks without links
that is long in all.  Between different ones the nearer one; equally near, good
for a heading before good text and a paragraph after it.  With one side missing
the other one, but bad for a heading after the last good block.  On a page where
nothing is decided all is good.  A heading that is a link goes with the block
after it.

Article (or main) elements with good blocks are a feature of both passes, never
a decision by themselves: a block outside that is good but not long counts as
undecided, an undecided one there as bad, and between different neighbours an
undecided block inside is good.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sequora.llm.runtime import lean, picked, ship

#: Frequent function words of four languages (fixed values).
STOP_WORDS = frozenset(
    """a about after all also an and are as at be because been but by can could for from had has have he her his i if in into is it its more not
    of on one or other our she so some than that the their them then there these they this to was we were what when which who will with would you
    aber als am an auch auf aus bei das dass dem den der des die doch ein eine einen einer es für hat ich im in ist mit nach nicht noch nur oder
    sich sie sind so über um und von vor war wie wir zu zum zur au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne
    nous on ou par pas plus pour que qui sa se ses son sont sur un une vous al como con del desde el ella entre era eran esos esta este fue ha hay
    las lo los más me muy no o para pero por se ser si sin sobre su sus también una unos y ya así""".split()
)
_ATTRS = r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)"
#: Within the part of a page up to its last >, every start of a tag has an end, so none is looked for in vain.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|textarea|title|iframe|xmp|noembed|noframes)\b{_ATTRS}>.*?(?:</\1\s*+>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:{_ATTRS}|([^>]*+))>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_CUT = re.compile(r"<[a-zA-Z/!?]")
_BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements without article text.
_SKIPPED = frozenset("nav footer aside form menu noscript template svg math select button object canvas audio video dialog head map datalist".split())
_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar toolbar note".split())
_NAME = re.compile(
    r"(?:js|site|page|top|left|right|bottom|global|main|primary|secondary|user|reader|post|article|entry|block|box|section|c|l|m|o|u)?[-_]*"
    r"(?:ad|ads|advert|adverts|advertisement|advertising|adsense|adslot|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices"
    r"|notification|alert|disclaimer|newsletter|subscribe|subscription|signup|login|sidebar|sidebars|side|rail|menu|menus|nav|navbar|navigation|breadcrumb"
    r"|breadcrumbs|footer|foot|colophon|masthead|header|topbar|toolbar|comment|comments|commentlist|disqus|respond|reply|replies|related|recommended"
    r"|recommendations|share|sharing|social|popup|modal|overlay|widget|widgets|pagination|pager|search|searchform|form|copyright|skip|tags|taglist)"
    r"(?:[-_].*|\d*)\Z",
    re.I,
)
_HEADER = re.compile(r"(?:.*[-_])?(?:header|masthead|topbar)\b.*", re.I)
#: In an article or main element's own class or id.
_HOLDER = re.compile(r"(?:comments?|reply|replies|respond|related|ads?|adverts?|advertisement|sponsored|promo|cookies?)(?:[-_].*|\d*)\Z", re.I)
_VALUE = re.compile(r"""(?<![\w-])(class|id|role|aria-hidden|hidden|style)(?![\w-])\s*+(?:=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


def _unwanted(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element holds no article text; `inside` an article, its own header does."""
    if name in _SKIPPED or name == "header" and not inside:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    for m in _VALUE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            if any(_HOLDER.match(c) if name == "article" else _NAME.match(c) and not (inside and _HEADER.match(c)) for c in value.split()):
                return True
        elif key == "role":
            if value.lower() in _ROLES and not (inside and value.lower() == "banner"):
                return True
        elif key == "hidden" and "=" not in m[0] or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True
    return False


def _unclosed(tags: list[re.Match]) -> set[int]:
    """Places in `tags` of start tags that no end tag closes, each name by itself."""
    still: dict[str, list[int]] = {}
    for i, m in enumerate(tags):
        if m[4] is not None:
            name = m[4].lower()
            if not m[3]:
                still.setdefault(name, []).append(i)
            elif still.get(name):
                still[name].pop()
    return {i for found in still.values() for i in found}


def blocks(page: str) -> list[tuple[str, float, str, bool]]:
    """(text, share of its characters in links, tag, in an article or main element) of each block that is not passed over."""
    end = page.rfind(">") + 1
    cut = _CUT.search(page, end)  # a tag or comment that doesn't end
    page = page[: cut.start()] if cut else page
    tags = list(_TAG.finditer(page, 0, end))
    open_ = _unclosed(tags)
    low = {m[4].lower() for m in tags if m[4] is not None and not m[3]}
    holder = "article" if "article" in low else "main" if "main" in low else ""
    out: list[tuple[str, float, str, bool]] = []
    parts: list[tuple[str, bool]] = []
    tag, depth, link, skip, level, done = "", 0, 0, "", 0, 0

    def close() -> None:
        nonlocal parts
        if parts:
            text = html.unescape("".join(t for t, _ in parts))
            text = " ".join(text.split())
            if text:
                linked = sum(len(t.strip()) for t, x in parts if x)
                out.append((text, min(1.0, linked / len(text)), tag, depth > 0))
            parts = []

    for i, m in enumerate(tags):
        if not skip and m.start() > done:
            parts.append((page[done : m.start()], link > 0))
        done = m.end()
        name = m[4]
        if name is None:
            continue
        name, closing, attrs = name.lower(), bool(m[3]), m[5] or m[6] or ""
        if skip:
            if level and name == skip and name not in ("p", "li"):
                level += -1 if closing else 1
                if not level:
                    skip = ""
                continue
            if (not level or skip in ("p", "li")) and (closing and name == skip or name in _BLOCKS):
                same = closing and name == skip
                skip = ""  # left open: up to the next block
                if same:
                    continue
            elif name == "body" or not closing and not depth and name in ("article", "main") and name == holder and not _unwanted(name, attrs, False):
                skip = ""
            else:
                continue
        if name in _BLOCKS:
            close()
            tag, link = ("" if closing else name), 0
        if not closing and _unwanted(name, attrs, depth > 0):
            if name in _BLOCKS or name in _SKIPPED:
                close()
            skip, level = name, int(i not in open_)
            continue
        if name == holder:
            depth = max(0, depth + (-1 if closing else 1))
        elif name == "a":
            link = 0 if closing else 1
        elif name in ("br", "wbr") and not closing:
            parts.append((" " if name == "br" else "", False))
    if not skip and done < len(page):
        parts.append((page[done:], link > 0))
    close()
    return out


def first_pass(text: str, linked: float, tag: str, inside: bool, short: int = 70, long: int = 200, links: tuple[float, float] = (0.4, 0.75), stops: tuple[float, float] = (0.15, 0.25)) -> bool | None:
    """Whether a block is good by itself; None: undecided."""
    if linked > links[1]:
        return None if tag in _HEADINGS else False
    if len(text) < short:
        return None if not linked or inside else False
    words = _LETTERS.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if linked > links[0]:
        return None if density >= stops[0] else False
    if density >= stops[1] or density >= stops[0] and len(text) >= long or len(text) >= 2 * long:
        return True
    return None if density >= stops[0] or not linked or inside else False


def second_pass(found: list[tuple[str, float, str, bool]], kinds: list[bool | None], long: int = 200, links: float = 0.4) -> list[bool]:
    """Each block's kind, undecided ones by their neighbours."""
    titles = [linked > links and tag in _HEADINGS for _, linked, tag, _ in found]
    held = any(k and b[3] for k, b in zip(kinds, found, strict=True))
    if held:
        kinds = [k if b[3] or k is False else (True if len(b[0]) >= long else None) if k else False for k, b in zip(kinds, found, strict=True)]
    known = [i for i, k in enumerate(kinds) if k is not None and not titles[i]]
    free = list(accumulate((len(b[0]) * (k is None and b[1] <= links) for b, k in zip(found, kinds, strict=True)), initial=0))
    out, at = [], 0
    for i, kind in enumerate(kinds):
        if kind is None:
            while at < len(known) and known[at] < i:
                at += 1
            before, after = known[at - 1] if at else None, known[at] if at < len(known) else None
            heading = found[i][2] in _HEADINGS
            if before is None and after is None:
                kind = True
            elif before is None or after is None:
                near = before if after is None else after
                run = free[-1] - free[before + 1] if after is None else free[after]
                kind = after is not None or not heading if kinds[near] else found[i][1] <= links and run >= long
            elif kinds[before] == kinds[after]:
                kind = bool(kinds[before]) or found[i][1] <= links and free[after] - free[before + 1] >= long
            elif held:
                kind = found[i][3]
            else:
                good, bad = (before, after) if kinds[before] else (after, before)
                kind = abs(good - i) < abs(bad - i) or abs(good - i) == abs(bad - i) and (heading if good == after else found[i][2] in ("p", ""))
        out.append(bool(kind))
    for i in range(len(found) - 2, -1, -1):
        if titles[i]:
            out[i] = out[i + 1]
    return out


def main_text(page: str) -> str:
    """The text of the page's good blocks, one to a line."""
    found = blocks(page)
    kinds = second_pass(found, [first_pass(*b) for b in found])
    return "\n".join(b[0] for b, kind in zip(found, kinds, strict=True) if kind)


def decided(page: str) -> dict[str, int]:
    """How many blocks the first pass found good and bad, and the second one, of the undecided."""
    found = blocks(page)
    one = [first_pass(*b) for b in found]
    two = second_pass(found, one)
    return {
        "first_good": sum(k is True for k in one),
        "first_bad": sum(k is False for k in one),
        "second_good": sum(k is None and x for k, x in zip(one, two, strict=True)),
        "second_bad": sum(k is None and not x for k, x in zip(one, two, strict=True)),
    }


@lean
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p.as_py() or "") for p in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Per row of pages (page_id, url, html, any others): page_id, url, text, n_chars (code points).

    Null and empty html, and pages without a good block, give the empty text; null ids and urls stay; repeated rows have equal
    results.  Nothing is shuffled: each page is read alone.
    """
    ship(spark)
    return picked(pages, page_id="long", url="string", html="string").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
