"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is read as a stream of tags and texts, balanced into elements. Elements that matter to structure become symbols: the
tag's name, with a mark if its class, id, role or hidden state says that it is furniture (":b"), may be furniture (":w") or is
content (":m").

1. Texts are compared over each host's pages: a text that stands on at least nine tenths of a host's different pages, and on
   five at least, is an anchor for the alignment; all other texts mismatch somewhere and become slots. The counts are exact, one
   for each page and text, in a Spark aggregation that copies of a page enter once.
2. The wrapper of a host is built by aligning its pages one after another: equal symbols match (an element that holds an anchor
   alone is a symbol of its own); runs of the same symbols, once or several side by side, become repeated groups; symbols that
   one side lacks become optional. Wrappers align with wrappers in the same way, so tasks infer partial ones, which are merged
   by host in two rounds.
3. In the finished wrapper the articles are found for the host: topmost article elements, main ones, and elements marked as
   content; if it has none of them, from the body down, the element that holds at least four fifths of the slots' text outside
   links. Furniture is what is marked so (menus, page headers, footers, asides, forms, adverts, notices, reader comments), and
   what may be furniture by its mark if constants or links are half of its text. Outside articles an element that holds an anchor
   alone is furniture as well. Inside article, main and marked elements nothing goes for standing on many pages. In the element of
   a page without such marks an anchor goes where it is a constant of the wrapper: where at least half of the pages that reach
   its place have it there; elsewhere it is text.
4. A page is aligned with the wrapper in the same way, level by level, so that each of its elements gets the place in the regular
   expression that it stands for; what has no place goes by its symbol, else by what it stands in. The texts in the article's
   elements are the main text. Of the kinds of article a page takes the first (article, main, marked) with at least half as much
   text as the kind with most, so that teasers don't stand for the article; a page that has none is judged by its own wrapper alone.

Bounds: symbols come from a fixed list of names and marks and the host's constants (of which a page has nine tenths), what
stands in elements deeper than 60 counts to the one above unless they are an article, main, marked or furniture and the first of
their kind below the root (so at most six levels more), and equal neighbours fold, so a wrapper's size depends on the host's
layouts, not on its pages.

Nulls and odd rows: null html is empty and has empty text; null or odd urls share a wrapper under the empty host; repeated
rows each have a row; markup that ends inside a tag, comment or script ends there; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_slices

# Element names and the words of class and id tokens.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "object", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "canvas", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "html",
    "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "label", "caption",
}
FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "search", "fieldset", "option"}
FURNITURE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "sidebar", "menu", "navbar",
    "navigation", "nav", "breadcrumb", "breadcrumbs", "comment", "comments", "disqus", "replies", "reply", "respond", "share", "sharing", "social", "related", "recommended", "recommendations", "newsletter", "subscribe", "subscription",
    "signup", "login", "widget", "toolbar", "pagination", "pager", "notice", "notices", "alert", "footer", "paywall", "masthead", "topbar", "aside",
}
#: Words that say nothing beside one of those.
NEUTRAL_WORDS = {
    "slot", "box", "list", "item", "items", "wrap", "wrapper", "container", "section", "area", "bar", "block", "blocks", "link", "links", "button", "buttons", "icon", "icons", "post", "posts", "form", "site", "page", "left", "right", "top", "bottom",
    "inner", "outer", "header", "head", "body", "unit", "zone", "text", "title", "panel", "module", "main", "primary", "secondary", "global", "mobile", "desktop", "inline", "sticky", "fixed", "thread", "row", "col", "column", "group", "holder", "media", "article", "articles", "content", "user", "reader",
}
FURNITURE_TOKENS = {"header", "site-header", "page-header", "top-bar", "skip-link"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
CONTENT_TOKENS = {"content", "main", "main-content", "article", "article-body", "article-content", "post", "post-content", "post-body", "entry", "entry-content", "story", "story-body"}
CLOSES_P = BLOCK - {"button", "label", "option"}
PLAIN = {"html", "body", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6"}
DEPTH = 60

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)(?:>|\Z))", re.S)
_attribute = re.compile(r"(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.I)


def _mark(name: str, attributes: str) -> str:
    """":b", ":w", ":m" or nothing."""
    if not attributes or name in ("html", "body"):
        return ""
    mark, weak = "", False
    for key, a, b, c in _attribute.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            for token in value.split():
                words = [w for w in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", token) if w]
                token, words = token.lower(), [w.lower() for w in words]
                if token in FURNITURE_TOKENS and name not in PLAIN:
                    return ":b"
                if not FURNITURE_WORDS.isdisjoint(words) and (name not in PLAIN and name != "article" or words[0].startswith("comment")):
                    if token != "alert" and all(w in FURNITURE_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in words):
                        return ":b"
                    weak = True
                if token in CONTENT_TOKENS:
                    mark = ":m"
            continue
        value = value.lower()
        if key == "role" and value in FURNITURE_ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return ":b"
        if key == "role" and value == "main" or key == "itemprop" and value == "articlebody":
            mark = ":m"
    return mark or ":w" * weak


def _kind(symbol: str) -> str:
    """What an element means for the article: "article", "main", "m" (marked), "b" (furniture), "h" (a page's header, unless in an article), "w" (may be furniture) or nothing."""
    name, _, mark = symbol.partition("=")[0].partition(":")
    if mark == "b" or name in FURNITURE and name != "header":
        return "b"
    return mark or (name if name in ("article", "main") else "h" if name == "header" else "")


class Link(str):
    """A text inside a link."""

    __slots__ = ()


class Element:
    __slots__ = ("depth", "kids", "name", "owner", "symbol", "taken", "within")

    def __init__(self, name: str, symbol: str, parent: Element | None = None, owner: Element | None = None):
        """An element with an owner is too deep to be one of its own: what stands in it is the owner's."""
        self.name, self.symbol, self.taken, self.owner = name, symbol, False, owner or self
        self.kids = owner.kids if owner else []
        self.depth = self.owner.depth if owner else parent.owner.depth + 1 if parent else 1
        self.within: frozenset = self.owner.within if owner else parent.owner.within | {_kind(symbol)} if parent else frozenset()


BREAK = Element("br", "")


def parse(source: str) -> Element:
    """The page's elements that matter; their kids are elements, texts as written, and BREAK."""
    root = Element("#root", "#root")
    stack, links, at = [root], 0, 0

    def text(raw: str) -> None:
        if raw:
            stack[-1].kids.append(Link(raw) if links else raw)

    def close(name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == name:
                del stack[i:]
                return

    while m := _token.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, attributes = m[2].lower(), m[3] or m[4] or ""
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK or any(e.name == name for e in stack):
                close(name)
                if name in BLOCK:
                    stack[-1].kids.append(BREAK)
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(source, at) if not attributes.endswith("/") else m
            at = end.end() if end else len(source)
            if end is m:
                at = m.end()
            continue
        if name in ("br", "hr"):
            stack[-1].kids.append(BREAK)
        if name in VOID:
            continue
        if name == "a":
            links += not attributes.endswith("/")
        mark = _mark(name, attributes)
        if name not in BLOCK and not mark:
            continue
        if name in CLOSES_P and stack[-1].name == "p":
            stack.pop()
        if name == "li" and stack[-1].name == "li" or name in ("td", "th") and stack[-1].name in ("td", "th") or name == "tr" and stack[-1].name == "tr" or name in ("dd", "dt") and stack[-1].name in ("dd", "dt") or name == "option" and stack[-1].name == "option":
            stack.pop()
        if name == "body":
            close("head")
        if name in BLOCK:
            links = 0 if name in ("article", "section", "div", "p", "li", "nav") else links
        over = stack[-1].owner
        if over.depth < DEPTH or (kind := _kind(name + mark)) and kind not in over.within:
            new = Element(name, name + mark, parent=over)
            over.kids.append(new)
        else:
            new = Element(name, name + mark, owner=over)
            if name in BLOCK:
                over.kids.append(BREAK)
        if not attributes.endswith("/"):
            stack.append(new)
    text(source[at:])
    return root


def pieces(e: Element):
    """The kids of an element, with texts that stand side by side as one list."""
    run: list[str] = []
    for x in e.kids:
        if isinstance(x, str):
            run.append(x)
            continue
        if run:
            yield run
            run = []
        yield x
    if run:
        yield run


def clean(run: list[str]) -> str:
    return " ".join(entities.unescape("".join(run)).split())


def name_of(text: str) -> int:
    """A text's 64-bit name."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def texts_of(e: Element):
    """Names of the texts of a page, in order."""
    for x in pieces(e):
        if isinstance(x, list):
            if text := clean(x):
                yield name_of(text)
        elif x is not BREAK:
            yield from texts_of(x)


# A wrapper node is a dict: l symbol ("#" a slot, "=name" an anchor), q quantifier ("1", "?", "+" or "*"), k kids, t characters of slots directly in it, a those in links, c those of anchors, n pages that have it at this place.
def wrapper_of(e: Element, constants=frozenset(), own: bool = False) -> dict:
    """A page's own wrapper; with `own`, nodes keep their elements (e)."""
    t = a = c = 0
    kids, symbol, only = [], e.symbol, True
    for x in pieces(e):
        if isinstance(x, list):
            if not (text := clean(x)):
                continue
            if constants and (name := name_of(text)) in constants:
                c += len(text)
                kids.append({"l": f"={name}", "q": "1", "k": [], "n": 1})
                continue
            t += len(text)
            a += sum(len(y.strip()) for y in x if isinstance(y, Link))
            kids.append({"l": "#", "q": "1", "k": []})
            only = False
        elif x is not BREAK:
            kids.append(wrapper_of(x, constants, own))
            only = False
    if only and len(kids) == 1 and _kind(symbol) not in ("article", "main", "m"):
        symbol += kids[0]["l"]
    return {"l": symbol, "q": "1", "k": fold(kids), "t": t, "a": min(a, t), "c": c, "n": 1} | ({"e": [e]} if own else {})


def _plus(q: str, more: str) -> str:
    some, none = "+" in (q, more) or "*" in (q, more), "?" in (q, more) or "*" in (q, more)
    return "*" if some and none else "+" if some else "?" if none else "1"


def merged(a: dict, b: dict, more: str = "1", beside: bool = False) -> dict:
    """Both nodes as one; beside: they are neighbours, of the same pages."""
    out = {"l": a["l"], "q": "1" if a["q"] == b["q"] == more == "1" else _plus(_plus(a["q"], b["q"]), more), "k": aligned(a["k"], b["k"], beside) if a["k"] or b["k"] else []}
    if "n" in a or "n" in b:
        n, m = a.get("n", 0), b.get("n", 0)
        out["n"] = max(n, m) if beside else n + m
    if "t" in a or "t" in b:
        out |= {x: a.get(x, 0) + b.get(x, 0) for x in "tac"}
    if "e" in a:
        out["e"] = a["e"] + b["e"]
    return out


def fold(kids: list[dict]) -> list[dict]:
    """Equal runs of one to three symbols side by side become repeated groups."""
    if len(kids) < 2:
        return kids
    out: list[dict] = []
    for x in kids:  # single symbols
        if out and out[-1]["l"] == x["l"]:
            out[-1] = merged(out[-1], x, "+", True)
        else:
            out.append(x)
    for size in (2, 3):
        if len(out) < 2 * size:
            break
        i, done, names = 0, [], [x["l"] for x in out]
        while i < len(out):
            if names[i : i + size] == names[i + size : i + 2 * size]:
                run, name = out[i : i + size], names[i : i + size]
                i += size
                while names[i : i + size] == name:
                    run = [merged(x, y, beside=True) for x, y in zip(run, out[i : i + size], strict=True)]
                    i += size
                done.append({"l": "(" + " ".join(name) + ")", "q": "+", "k": run})
            else:
                done.append(out[i])
                i += 1
        out = done
    return out


def _grouped(kids: list[dict], other: list[dict]) -> list[dict]:
    """kids, with runs that the other side has as a repeated group put into one."""
    for group in (x for x in other if x["l"][0] == "("):
        name, size, i, done = [x["l"] for x in group["k"]], len(group["k"]), 0, []
        while i < len(kids):
            if [x["l"] for x in kids[i : i + size]] == name:
                done.append({"l": group["l"], "q": "1", "k": kids[i : i + size]})
                i += size
            else:
                done.append(kids[i])
                i += 1
        kids = done
    return kids


def aligned(a: list[dict], b: list[dict], beside: bool = False) -> list[dict]:
    """Both sides' streams as one: matches merged, the rest optional."""
    names = [x["l"] for x in a], [x["l"] for x in b]
    if names[0] == names[1] and not any(x[0] == "(" for x in names[0]):  # folded as they are
        return [merged(x, y, beside=beside) for x, y in zip(a, b, strict=True)]
    a, b = _grouped(a, b), _grouped(b, a)
    names = [x["l"] for x in a], [x["l"] for x in b]
    if names[0] == names[1]:
        return fold([merged(x, y, beside=beside) for x, y in zip(a, b, strict=True)])
    out = []
    for kind, i, j, k, m in SequenceMatcher(None, *names, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [merged(x, y, beside=beside) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [x | {"q": _plus(x["q"], "?")} for x in (*a[i:j], *b[k:m])]
    return fold(out)


def pattern(w: dict) -> str:
    """A wrapper as a regular expression, for people."""
    inner = " ".join(pattern(x) for x in w["k"])
    body = "#text" if w["l"] == "#" else "constant" if w["l"][0] == "=" else f"({inner})" if w["l"][0] == "(" else f"<{_tag(w['l'])}>{inner}</{_tag(w['l'])}>"
    return body + w["q"].replace("1", "")


def _tag(symbol: str) -> str:
    return symbol.partition("=")[0]


def _furniture(symbol: str, inside: bool = False) -> bool:
    name, _, mark = _tag(symbol).partition(":")
    return mark == "b" or name in FURNITURE and not (inside and name == "header")


def _sums(w: dict) -> tuple[int, int, int]:
    """Characters of slots, of links and of constants in all of it."""
    t, a, c = w.get("t", 0), w.get("a", 0), w.get("c", 0)
    for x in w["k"]:
        more = _sums(x)
        t, a, c = t + more[0], a + more[1], c + more[2]
    return t, a, c


def _out(w: dict, inside: bool = False, reached: int = 0) -> bool:
    """Whether a node is furniture, by its mark or, where that leaves it open, by its text. reached: in an article that no mark
    shows, the pages that reach the node's place; else 0."""
    if "=" in w["l"] and (2 * w.get("n", 1) >= reached if reached else not inside):
        return True
    if not _tag(w["l"]).endswith(":w"):
        return _furniture(w["l"], inside)
    t, a, c = _sums(w)
    return 2 * max(a, c) >= t + c


def _each(w: dict):
    """Kids, with groups opened."""
    for x in w["k"]:
        if x["l"][0] == "(":
            yield from _each(x)
        elif x["l"][0] not in "#=":
            yield x


def _weight(w: dict, inside: bool = False) -> int:
    return w.get("t", 0) - w.get("a", 0) + inside * w.get("c", 0) + sum(_weight(x, inside) for x in _each(w) if not _out(x, inside))


def _topmost(w: dict, wanted) -> list[dict]:
    return [y for x in _each(w) if not _out(x) for y in ([x] if wanted(_tag(x["l"])) and _weight(x, True) else _topmost(x, wanted))]


def decided(w: dict) -> list[dict]:
    """The wrapper with a mark on what is taken (i), for each kind of article that it has."""
    kinds = [_topmost(w, lambda s: s.startswith("article")), _topmost(w, lambda s: s.startswith("main")), _topmost(w, lambda s: s.endswith(":m"))]
    kinds = [x for x in kinds if x]
    unmarked = not kinds
    if unmarked:
        here = w
        while True:
            whole = _weight(here)
            inner = [x for x in _each(here) if not _out(x) and _tag(x["l"]).partition(":")[0] not in ("p", "li", "td") and "+" not in x["q"] and "*" not in x["q"] and _weight(x) >= 0.8 * whole > 0]
            if not inner:
                break
            here = inner[0]
        kinds = [[here]]

    def flags(x: dict, inside: bool, chosen: set, reached: int) -> dict:
        inside, reached = inside or id(x) in chosen, x.get("n", reached)
        kids = [y if y["l"][0] in "#=" else flags(y, inside, chosen, reached) if y["l"][0] == "(" or not _out(y, inside, reached * unmarked) else dict(y, k=[], i=False, f=True) for y in x["k"]]
        return {"l": x["l"], "q": x["q"], "k": kids, "i": inside}

    return [flags(w, False, {id(x) for x in found}, 1) for found in kinds]


def assign(own: dict, host: dict) -> None:
    """Marks the elements of a page's wrapper that the host's takes, along the aligned kids."""
    for e in own.get("e", ()):
        e.taken = host["i"]
    mine, other = _grouped(own["k"], host["k"]), _grouped(host["k"], own["k"])
    names = [x["l"] for x in mine], [x["l"] for x in other]
    place: dict = {}
    if names[0] == names[1]:
        place = dict(enumerate(other))
    else:
        for i, k, n in SequenceMatcher(None, *names, autojunk=False).get_matching_blocks():
            place |= {i + d: other[k + d] for d in range(n)}
    by_symbol = None
    for at, x in enumerate(mine):
        if x["l"][0] in "#=":
            continue
        found = place.get(at)
        if found is None or "i" not in found and found["l"][0] != "(":
            if by_symbol is None:
                by_symbol = {y["l"]: y for y in _each(host)}
            found = by_symbol.get(x["l"])
        if found is None:
            furniture = x["l"][0] != "(" and _out(x, host.get("i", False))
            found = {"l": x["l"], "q": "1", "k": [], "i": host.get("i", False) and not furniture, "f": furniture}
        if not found.get("f"):
            assign(x, found if "i" in found else {**found, "i": host.get("i", False)})


def main_text(source: str, kinds: list[dict], constants=frozenset()) -> str:
    """The article of a page by its host's wrapper, of the first kind with at least half as much text as any; else by the page's own wrapper."""
    page = parse(source)
    own = wrapper_of(page, constants, True)
    for known in (kinds, None):
        texts = [_text(page, own, flags) for flags in (decided(own) if known is None else known)]
        most = max(map(len, texts), default=0)
        if most:
            return next(x for x in texts if 2 * len(x) >= most)
    return ""


def _text(page: Element, own: dict, flags: dict) -> str:
    """The texts of the page's elements that the flags take."""
    blocks: list[str] = []
    run: list[str] = []

    def clear(e: Element) -> None:
        e.taken = False
        for x in e.kids:
            if isinstance(x, Element) and x is not BREAK:
                clear(x)

    def end() -> None:
        if run:
            if text := clean(run):
                blocks.append(text)
            run.clear()

    def walk(e: Element) -> None:
        for x in pieces(e):
            if isinstance(x, list):
                if e.taken:
                    run.extend(x)
            elif x is BREAK:
                end()
            else:
                block = x.name in BLOCK
                if block:
                    end()
                walk(x)
                if block:
                    end()

    clear(page)
    assign(own, flags)
    walk(page)
    end()
    return " ".join(blocks)


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select(F.col("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def _joined(parts: DataFrame, *keys: str) -> DataFrame:
    """One wrapper for each key, from those of its rows; a task holds one at a time."""

    def run(batches):
        key, now, out = None, None, []

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string()] + [pa.int64()] * (len(keys) - 1) + [pa.string()], strict=True)], names=[*keys, "wrapper"])
            out.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "wrapper")]
            for *k, w in zip(*columns, strict=True):
                w = json.loads(w)
                if k == key:
                    now = merged(now, w)
                else:
                    if key is not None:
                        out.append((*key, json.dumps(now)))
                    key, now = k, w
            if len(out) > 500:
                yield made()
        if key is not None:
            out.append((*key, json.dumps(now)))
        if out:
            yield made()

    schema = ", ".join([f"{keys[0]} string", *(f"{k} long" for k in keys[1:]), "wrapper string"])
    return parts.select(*keys, "wrapper").repartition(*keys).sortWithinPartitions(*keys, "wrapper").mapInArrow(run, schema)


def template_texts(pages: DataFrame, share: float = 0.9, least: int = 5) -> DataFrame:
    """host, constants: names of the texts on at least `share` of a host's different pages, and on `least`, sorted."""

    def read(batches):
        for rows in text_slices(batches, ["host"], "html"):
            names = [list(texts_of(parse(x))) for x in rows["html"]]
            whole = [int.from_bytes(hashlib.blake2b(b"".join(n.to_bytes(8, "big", signed=True) for n in x), digest_size=8).digest(), "big", signed=True) for x in names]
            yield pa.RecordBatch.from_arrays([pa.array(rows["host"]), pa.array(whole), pa.array([list(set(x)) for x in names], pa.list_(pa.int64()))], names=["host", "page", "texts"])

    each = _with_host(pages).select("host", "html").mapInArrow(read, "host string, page long, texts array<long>")
    each = stored(each.groupBy("host", "page").agg(F.first("texts").alias("texts")), "page-texts")
    sizes = each.groupBy("host").agg(F.count("*").alias("_pages")).filter(F.col("_pages") >= least)
    counts = each.select("host", F.explode("texts").alias("text")).groupBy("host", "text").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return stored(counts.join(sizes, "host").filter(F.col("_n") >= share * F.col("_pages")).groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("constants")), "template-texts")


def _dealt(pages: DataFrame, known: DataFrame, deals: int) -> DataFrame:
    """pages with the columns of known (a row for each host), dealt to `deals` copies of its rows."""
    own = _with_host(pages).withColumn("deal", F.pmod(F.xxhash64("page_id", "url"), F.lit(deals)).cast("int"))
    return own.join(known.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))), ["host", "deal"], "left")


def wrappers(pages: DataFrame, constants: DataFrame, deals: int = 16) -> DataFrame:
    """host, wrapper (JSON) over all pages (page_id, url, html); constants: host, constants."""

    def infer(batches):
        held: dict[str, dict] = {}

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([json.dumps(w) for w in held.values()])], names=["host", "wrapper"])
            held.clear()
            return batch

        for rows in text_slices(batches, ["host", "constants"], "html"):
            for host, known, source in zip(rows["host"], rows["constants"], rows["html"], strict=True):
                own = wrapper_of(parse(source), frozenset(known or ()))
                held[host] = merged(held[host], own) if host in held else own
            if len(held) > 2000:
                yield made()
        if held:
            yield made()

    parts = _dealt(pages, constants, deals).select("host", "html", "constants").mapInArrow(infer, "host string, wrapper string")
    some = _joined(parts.withColumn("deal", F.pmod(F.xxhash64("wrapper"), F.lit(32))), "host", "deal")
    return _joined(some, "host")


def extracted(pages: DataFrame, deals: int = 16) -> DataFrame:
    """page_id, url, text, n_chars for every page. Pages of a host are dealt to `deals` copies of its wrapper."""
    constants = template_texts(pages)
    made = stored(wrappers(pages, constants, deals).join(constants, "host", "left"), "wrappers")
    own = _dealt(pages, made, deals)
    kind = dict(own.dtypes)["page_id"]

    def run(batches):
        known: dict[tuple, tuple] = {}
        for rows in text_slices(batches, ["page_id", "url", "wrapper", "constants"], "html"):
            texts = []
            for source, w, c in zip(rows["html"], rows["wrapper"], rows["constants"], strict=True):
                if w not in known:
                    if len(known) > 200:
                        known.clear()
                    known[w] = decided(json.loads(w)), frozenset(c or ())
                texts.append(main_text(source, *known[w]))
            yield pa.RecordBatch.from_arrays([pa.array(rows["page_id"], pa.int64() if kind == "bigint" else None), pa.array(rows["url"], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return own.select("page_id", "url", "html", "wrapper", "constants").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
