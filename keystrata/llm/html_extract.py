"""Main text of web pages by union-free wrappers.

Pages of one host are aligned one after the other into a wrapper: a regular expression without unions
over tags and text slots. Siblings with one shape become a repeated group, also where groups of up to four
alternate; a part that only some pages have becomes optional; text that differs becomes a slot. Each
slot keeps sums of its text and link text. A page's template is the part of the wrapper that its
alignment reaches; slots that hold the article are chosen on that part, so pages of other templates of
the host don't decide. Pages without a host have nothing in common and are wrapped each alone.

Which text is the template's is counted apart: a text that nearly all pages of a host have at one path of
elements is constant and is left out, unless it makes up most of a page's article (then the pages are copies).

Every task aligns the pages that it reads and sends one small wrapper for each host, so a host with a
third of all pages sends as many rows as there are tasks; they are merged in two steps. Wrappers are
joined back to pages by host (broadcast if few, else salted).

Elements nested deeper than DEEPEST keep their text, in page order, as children of the element at that depth.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, workers

#: Elements that don't part text, that never have content, and whose content isn't markup.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe xmp math object".split())
#: A start tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements and words of class names or ids that mark what isn't the article (fixed lists).
NOT_TEXT = frozenset("head nav aside footer form button select input textarea script style noscript template svg iframe menu dialog title math object".split())
NOT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist reply replies "
    "discussion disqus notice notices alert cookie cookies consent popup modal overlay newsletter subscribe signup login search share sharing social related recommended pagination pager toolbar copyright legal".split()
)
#: Words that make a class name tell of the element's surroundings, not of the element: no-comments, has-sidebar.
ABOUT = frozenset("no has with without is not hide hidden".split())
#: A tag's attributes: quoted values don't hold markup, or end where a value may end; with an unclosed quote the tag ends at the first >.
_TAG = re.compile(
    r"<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z))*(?:>|\Z|(?=<))|[^<>]*(?:>|\Z|(?=<))))",
    re.S,
)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_raw_end: dict[str, re.Pattern] = {}

#: A wrapper node: symbol, repeated, optional, children, [characters, link characters] of a slot.
#: A page node: symbol, children or text, link characters.
SLOT, GROUP = "#", "()"
#: Kinds of plan nodes: not marked, article or main element, never taken, not taken outside of the article.
PLAIN, ARTICLE, BARRED, OUTSIDE = range(4)
#: The element with most of a template's text isn't followed on a page with less than this share of its text there.
LEAST_OWN = 0.3
#: A constant text is on at least so many pages, and on this share of those with text at its path. Groups of near
#: copies share text as well, on fewer pages.
LEAST_PAGES, LEAST_SHARE = 4, 0.9
#: Nested elements with nodes of their own, and cells of the exact table of an alignment.
DEEPEST, CELLS = 100, 250_000
#: A form with this share of a host's text is the page's frame (pages that are one form), not a form in it.
FRAME_SHARE = 0.5


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def symbol(tag: str, attributes: str) -> str:
    """Tag name with its class, id and role, digits left out."""
    if not attributes:
        return tag
    names = [f"{m[1].lower()}={m[2] or m[3] or m[4] or ''}" for m in _NAME.finditer(attributes)]
    return tag + "".join("." + re.sub(r"\d+", "", n.split("=", 1)[1]).strip().lower() for n in names)


def parse(page: str) -> list:
    """A tolerant tree of block elements and text slots; inline elements leave their text only."""
    root: list = ["", [], 0]
    stack, text, links, in_link = [root], [], 0, False
    deep: list[str] = []  # symbols of open elements below DEEPEST; each piece of them is a child of the last node on the stack

    def deeper() -> list:
        """Where text goes now: below DEEPEST into a node with the symbol of the barred element around, or else the innermost."""
        if deep:
            stack[DEEPEST][1].append([next((s for s in deep if _barred(s, True)), deep[-1]), [], 0])
            return stack[DEEPEST][1][-1]
        return stack[-1]

    here = root

    def flush() -> None:
        nonlocal text, links
        whole = " ".join(html.unescape("".join(text)).split()) if text else ""
        if whole:
            here[1].append([SLOT, whole, min(links, len(whole))])
        text, links = [], 0

    def add(part: str) -> None:
        nonlocal links
        text.append(part)
        if in_link:
            links += len(part)

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            if "<" not in page[at:] or not page[page.rindex("<") :].lstrip("</")[:1].isalpha():
                add(page[at:])
            else:
                add(page[at : page.rindex("<")])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = False
            if tag in INLINE:
                continue
            flush()
            if any(s.partition(".")[0] == tag for s in deep):
                while deep.pop().partition(".")[0] != tag:
                    pass
                here = deeper()
            elif any(node[0].partition(".")[0] == tag for node in stack[1:]):
                deep.clear()
                while stack.pop()[0].partition(".")[0] != tag:
                    pass
                here = stack[-1]
            continue
        if tag in RAW:
            flush()
            end = _raw_end.setdefault(tag, re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I)).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "a":
            in_link = True
        if tag == "br":
            text.append(" ")
        if tag in INLINE:
            continue
        flush()
        closes = CLOSES.get(tag, ())
        if deep and (deep[-1].partition(".")[0] in closes or deep[-1].partition(".")[0] == "p" and tag in ENDS_P):
            deep.pop()
        for depth in range(len(stack) - 1, 0, -1) if not deep else ():
            name = stack[depth][0].partition(".")[0]
            if name in closes or name == "p" and tag in ENDS_P:
                del stack[depth:]
                break
            if name not in ("p", "td", "th") or name in ("td", "th") and tag not in ("td", "th", "tr"):
                break
        own = symbol(tag, m[3])
        closed = tag in VOID or m[3].rstrip(">").rstrip().endswith("/")
        if len(stack) > DEEPEST:
            if not closed:
                deep.append(own)
            here = deeper()
            continue
        node = [own, [], 0]
        stack[-1][1].append(node)
        if not closed:
            stack.append(node)
        here = stack[-1]
    flush()
    return root


def runs(symbols: list[str]) -> list[tuple[int, int, int]]:
    """(first, period, count): symbols as a sequence of tandem repeats with periods of up to four."""
    out, at, n = [], 0, len(symbols)
    while at < n:
        best = (1, 1)
        for period in (1, 2, 3, 4):
            if at + 2 * period > n and period > 1:
                break
            count = 1
            while symbols[at : at + period] == symbols[at + period * count : at + period * (count + 1)] and at + period * (count + 1) <= n:
                count += 1
            if count > 1 and period * count > best[0] * best[1]:
                best = (period, count)
                if period == 1:
                    break
        out.append((at, *best))
        at += best[0] * best[1]
    return out


def fold(children: list) -> list[tuple[str, list[list]]]:
    """Children as (symbol, instances): runs of one symbol first, then alternating groups of such runs.

    An instance of an element is the page node; of a group, its folded parts.
    """
    names = [c[0] for c in children]
    single = []
    for at, period, count in runs(names):
        if period == 1:
            single.append((names[at], children[at : at + count]))
        else:
            single += [(names[k], [children[k]]) for k in range(at, at + period * count)]
    labels = [s for s, _ in single]
    out = []
    for at, period, count in runs(labels):
        if period > 1 and count > 1:
            out.append((GROUP + " ".join(labels[at : at + period]), [single[k : k + period] for k in range(at, at + period * count, period)]))
        else:
            out += single[at : at + period * count]
    return out


def align(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence of two symbol sequences, as index pairs.

    Where the exact table would have more than CELLS cells, symbols that stand once on either side are matched first,
    as many as can be in order, and what lies between them is aligned; without such symbols each left symbol
    takes its next place on the right.
    """
    pairs, a, b = [], 0, 0
    while a < len(left) and b < len(right) and left[a] == right[b]:
        pairs.append((a, b))
        a, b = a + 1, b + 1
    tail = []
    c, d = len(left), len(right)
    while c > a and d > b and left[c - 1] == right[d - 1]:
        c, d = c - 1, d - 1
        tail.append((c, d))
    x, y = left[a:c], right[b:d]
    if len(x) * len(y) > CELLS:
        pairs += [(a + i, b + j) for i, j in _by_anchors(x, y)]
    elif x and y:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                pairs.append((a + i, b + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return pairs + tail[::-1]


def _by_anchors(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Common symbols of two long sequences in order, in nearly linear time."""
    once = [{s: k for k, s in enumerate(z) if n[s] == 1} for z, n in ((x, Counter(x)), (y, Counter(y)))]
    both = sorted((k, once[1][s]) for s, k in once[0].items() if s in once[1])
    ends: list[int] = []  # the longest rising chain of places in y
    last, before = [], []
    for k, (_, j) in enumerate(both):
        at = bisect.bisect_left(ends, j)
        before.append(last[at - 1] if at else None)
        ends[at : at + 1], last[at : at + 1] = [j], [k]
    chain, k = [], last[-1] if last else None
    while k is not None:
        chain.append(both[k])
        k = before[k]
    if chain:
        out, i, j = [], 0, 0
        for p, q in [*chain[::-1], (len(x), len(y))]:
            out += [(i + u, j + v) for u, v in align(x[i:p], y[j:q])]
            if p < len(x):
                out.append((p, q))
            i, j = p + 1, q + 1
        return out
    places: dict[str, list[int]] = {}
    for j, s in enumerate(y):
        places.setdefault(s, []).append(j)
    out, j = [], 0
    for i, s in enumerate(x):
        own = places.get(s, [])
        at = bisect.bisect_left(own, j)
        if at < len(own) and own[at] - j <= len(x) - i:  # a far place would leave the rest unmatched
            out.append((i, own[at]))
            j = own[at] + 1
    return out


def _wrap(name: str, instances: list) -> list:
    """A wrapper node from the instances of one folded part of a page."""
    node = [name, len(instances) > 1, False, [], [0, 0]]
    for k, one in enumerate(instances):
        if name == SLOT:
            node[4][0] += len(one[1])
            node[4][1] += one[2]
        else:
            parts = [_wrap(*p) for p in (one if name.startswith(GROUP) else fold(one[1]))]
            node[3] = parts if k == 0 else merge(node[3], parts)
    return node


def merge(left: list, right: list) -> list:
    """The wrapper of two sequences of wrapper nodes: common nodes are joined, all others become optional."""
    out, i, j = [], 0, 0
    for a, b in [*align([n[0] for n in left], [n[0] for n in right]), (len(left), len(right))]:
        out += [[*n[:2], True, *n[3:]] for n in (*left[i:a], *right[j:b])]
        if a < len(left) and b < len(right):
            x, y = left[a], right[b]
            out.append([x[0], x[1] or y[1], x[2] or y[2], merge(x[3], y[3]), [x[4][0] + y[4][0], x[4][1] + y[4][1]]])
        i, j = a + 1, b + 1
    return _adjoin(out)


def _adjoin(nodes: list) -> list:
    """Neighbours with one symbol are one repeated node, so that optional parts can't pile up."""
    out: list = []
    for n in nodes:
        if out and out[-1][0] == n[0]:
            x = out[-1]
            out[-1] = [x[0], True, x[2] and n[2], merge(x[3], n[3]), [x[4][0] + n[4][0], x[4][1] + n[4][1]]]
        else:
            out.append(n)
    return out


def wrapper_of(page: str) -> list:
    return _wrapper(parse(page))


def _wrapper(tree: list) -> list:
    return _adjoin([_wrap(*p) for p in fold(tree[1])])


def _key(path: str, text: str = "") -> int:
    """64 bits of a path, or of a text at a path."""
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def slot_keys(node: list, path: str = "") -> set[tuple[int, int | None]]:
    """(path, text) of the slots below a page node, and (path, None) once for each path."""
    out: set = set()
    for child in node[1]:
        if child[0] == SLOT:
            out |= {(_key(path), None), (_key(path), _key(path, child[1]))}
        else:
            out |= slot_keys(child, f"{path}\n{child[0]}")
    return out


def _barred(name: str, inside: bool) -> bool:
    """Whether an element can't be part of the article; inside: within an article or main element."""
    tag, _, rest = name.partition(".")
    if tag in NOT_TEXT or tag == "header" and not inside:
        return True
    if tag in ("html", "body"):  # their classes tell what a page has
        return False
    parts: set[str] = set()
    for one in re.split(r"[.\s]+", rest):
        own = [x for x in re.split(r"[^a-z]+", one) if x]
        # An article or main element is barred by a whole name only: article.comment, not article.comment-count.
        parts.update(own if own and own[0] not in ABOUT and (tag not in ("article", "main") or len(own) == 1) else ())
    return bool(parts & NOT_WORDS) or not inside and bool(parts & {"header", "masthead", "top"})


def regular_expression(nodes: list) -> str:
    """The wrapper in the usual notation, for people."""
    out = []
    for name, repeated, optional, children, _ in nodes:
        inner = "#text" if name == SLOT else regular_expression(children)
        text = inner if name == SLOT else f"({inner})" if name.startswith(GROUP) else f"<{name}>{inner}</>"
        out.append(f"({text})+" if repeated else text)
        if optional:
            out[-1] = f"({out[-1]})?"
    return "".join(out)


def choose(nodes: list) -> list:
    """A plan that mirrors the wrapper: [symbol, kind, children, weight]; a slot's weight is its text that isn't link text.

    What is taken is decided for each page by the part of the plan that it reaches, see extract(). A form around most of
    the host's text is a frame like any other element.
    """
    held: dict[int, int] = {}

    def hold(node: list) -> int:
        held[id(node)] = max(0, node[4][0] - 2 * node[4][1]) + sum(map(hold, node[3]))
        return held[id(node)]

    return _planned(nodes, held, FRAME_SHARE * max(1, sum(map(hold, nodes))))


def _planned(nodes: list, held: dict[int, int], most: float) -> list:
    def kind(node: list) -> int:
        name = node[0]
        if name.partition(".")[0] == "form" and held[id(node)] > most:
            name = "div"
        if name == SLOT or name.startswith(GROUP):
            return PLAIN
        if _barred(name, True):
            return BARRED
        if _barred(name, False):
            return OUTSIDE
        tag, _, rest = name.partition(".")
        return ARTICLE if tag in ("article", "main") or tag in ("div", "section", "td") and set(re.split(r"[^a-z]+", rest)) & {"article", "main"} else PLAIN

    return [[n[0], kind(n), _planned(n[3], held, most), n[4][0] - 2 * n[4][1]] for n in nodes]


def _reached(parts: list, nodes: list, path: str = "") -> list:
    """The page's parts in page order as [plan node, instances below it or the slot's page node with its path].

    A part that the plan doesn't have gets a plan of its own, so that no text is lost.
    """
    names, out, last = [n[0] for n in nodes], [], 0
    places = dict((b, a) for a, b in align(names, [p[0] for p in parts]))
    for k, (name, instances) in enumerate(parts):
        place = places.get(k)
        if place is None:  # an adjoined node takes all later parts of its symbol
            place = next((x for x in (*range(last, len(names)), *range(last)) if names[x] == name), None)
        if place is None:
            node = choose([_wrap(name, instances)])[0]
        else:
            last, node = place, nodes[place]
        for one in instances:
            if name == SLOT:
                out.append([node, [*one, path]])
            elif name.startswith(GROUP):
                out.append([node, _reached(one, node[2], path)])
            else:
                out.append([node, _reached(fold(one[1]), node[2], f"{path}\n{name}")])
    return out


def extract(page: str, plan: list, constant: frozenset[int] = frozenset()) -> str:
    """The article of a page by its host's plan: blocks in page order, joined by line ends.

    Pages of one host may have several templates. A page's template is the part of the plan that it reaches. If that
    has article or main elements that hold text on this page, their slots are taken; otherwise those in the element
    with the most text that isn't link text, by the weights of the slots reached, or by this page's own text where
    it has little of it there. Barred elements are never taken.
    constant: keys of the host's constant texts.
    """

    def slots(items: list, inside: bool) -> list:
        out = []
        for node, below in items:
            if node[0] == SLOT:
                out.append(below)
            elif node[1] != BARRED and (inside or node[1] != OUTSIDE):
                out += slots(below, inside)
        return out

    def in_articles(items: list) -> list:
        out = []
        for node, below in items:
            if node[1] == ARTICLE:
                out += slots(below, True)
            elif node[0] != SLOT and node[1] == PLAIN:
                out += in_articles(below)
        return out

    def own(found: list) -> int:
        return sum(len(x[1]) - 2 * x[2] for x in found)

    def weights(items: list, of: dict) -> dict:
        """Weights of the slots below, each once."""
        for node, below in items:
            if node[0] == SLOT:
                of[id(node)] = node[3]
            elif node[1] in (PLAIN, ARTICLE):
                weights(below, of)
        return of

    def heaviest(parts: dict, share: dict) -> int | None:
        best = max((k for k, x in parts.items() if x[0][0][0] != SLOT), key=share.get, default=None)
        total = sum(share.values())
        name = parts[best][0][0][0] if best is not None else ""
        if best is None or total == 0 or share[best] < 0.7 * total or name.startswith(GROUP) or name.partition(".")[0] in ("p", "ul", "ol", "table", "pre", "blockquote", "dl"):
            return None
        return best

    def in_heaviest(items: list) -> list:
        level = items
        while True:  # go down while one element holds most of the text
            parts: dict[int, list] = {}
            for item in level:
                parts.setdefault(id(item[0]), []).append(item)
            here = {k: max(0, own(slots(x, False))) for k, x in parts.items()}
            best = heaviest(parts, {k: max(0, sum(weights(x, {}).values())) for k, x in parts.items()})
            if best is None or here[best] < LEAST_OWN * sum(here.values()):
                best = heaviest(parts, here)
            if best is None:
                break
            level = [y for x in parts[best] for y in x[1]]
        return slots(level, True)

    items = _reached(fold(parse(page)[1]), plan)
    taken = in_articles(items)
    if own(taken) <= 0:
        other = in_heaviest(items)
        taken = taken if sum(len(x[1]) for x in taken) >= sum(len(x[1]) for x in other) else other
    if constant:
        rest = [x for x in taken if _key(x[3], x[1]) not in constant]
        if 2 * sum(len(x[1]) for x in rest) >= sum(len(x[1]) for x in taken):
            taken = rest
    return "\n".join(x[1] for x in taken)


WRAPPERS = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())])
PARTS = pa.schema([*WRAPPERS, ("path", pa.int64()), ("text", pa.int64()), ("pages", pa.int64())])
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def infer(pages: DataFrame) -> DataFrame:
    """(host, plan, constant) from pages (page_id, url, html); none for pages without a host."""

    @workers.task("pages")
    def local(batches):
        held: dict[str, list] = {}
        seen: Counter = Counter()
        salt = 0
        for batch in common.slices(batches, ["html"], 1 << 22):
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host = host_of(url)
                if not host:
                    continue
                tree = parse(page or "")
                own = _wrapper(tree)
                held[host] = merge(held[host], own) if host in held else own
                seen.update((host, *key) for key in slot_keys(tree))
                salt = (31 * salt + len(page or "")) % 32
            if len(held) > 2000 or len(seen) > 200_000:
                yield from rows(held, seen, salt)
                held, seen = {}, Counter()
        if held:
            yield from rows(held, seen, salt)

    def rows(held: dict[str, list], seen: Counter, salt: int):
        n = len(held)
        yield common.arrow_batch(PARTS, host=list(held), salt=[salt] * n, wrapper=[json.dumps(w, separators=(",", ":")) for w in held.values()], path=[None] * n, text=[None] * n, pages=[None] * n)
        n = len(seen)
        yield common.arrow_batch(PARTS, host=[k[0] for k in seen], salt=[None] * n, wrapper=[None] * n, path=[k[1] for k in seen], text=[k[2] for k in seen], pages=list(seen.values()))

    def join(table: pa.Table) -> pa.Table:
        whole = None
        for text in sorted(table.column("wrapper").to_pylist()):
            whole = json.loads(text) if whole is None else merge(whole, json.loads(text))
        return pa.Table.from_arrays([table.column("host")[:1], table.column("salt")[:1], pa.array([json.dumps(whole, separators=(",", ":"))])], schema=WRAPPERS)

    def finish(table: pa.Table) -> pa.Table:
        whole = json.loads(join(table).column("wrapper")[0].as_py())
        return pa.table({"host": table.column("host")[:1], "plan": pa.array([json.dumps(choose(whole), separators=(",", ":"))])})

    parts = common.materialize(pages.select("url", "html").mapInArrow(local, "host string, salt int, wrapper string, path long, text long, pages long"), "page-parts")
    plans = parts.where("wrapper is not null").select("host", "salt", "wrapper").groupBy("host", "salt").applyInArrow(join, "host string, salt int, wrapper string").groupBy("host").applyInArrow(finish, "host string, plan string")
    counts = parts.where("wrapper is null").groupBy("host", "path", "text").agg(F.sum("pages").alias("pages"))
    paths = common.materialize(counts.where("text is null").select("host", "path", F.col("pages").alias("whole")), "paths")
    often = common.attach(counts.where(F.col("text").isNotNull() & (F.col("pages") >= LEAST_PAGES)), paths, ["host", "path"], paths.count())
    constant = often.where(F.col("pages") >= LEAST_SHARE * F.col("whole")).groupBy("host").agg(F.collect_set("text").alias("constant"))
    return plans.join(constant, "host", "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null pages count as empty; pages of null and odd urls are judged each alone. Repeated rows are extracted each. An empty
    table gives an empty table.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    plans = common.materialize(infer(rows), "wrappers")
    host = F.coalesce(F.lower(F.regexp_extract("url", _HOST.pattern, 1)), F.lit(""))

    @workers.task("pages")
    def run(batches):
        known: dict[str, tuple] = {}
        for batch in common.slices(batches, ["html"], 1 << 22):
            out = []
            for url, page, text, place in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "plan")), range(batch.num_rows), strict=True):
                if text is None:
                    out.append(extract(page or "", choose(wrapper_of(page or ""))))
                    continue
                host = host_of(url)
                if host not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[host] = json.loads(text), frozenset(batch.column("constant")[place].as_py() or ())
                out.append(extract(page or "", *known[host]))
            yield common.arrow_batch(TEXTS, page_id=batch.column("page_id").to_pylist(), url=batch.column("url").to_pylist(), text=out)

    joined = common.attach(rows.withColumn("host", host), plans, ["host"], plans.count(), limit=2000, sized=True)
    return joined.select("page_id", "url", "html", "plan", "constant").mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
