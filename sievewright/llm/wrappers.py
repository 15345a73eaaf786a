"""HTML extraction by union-free regular-expression inference.

A page's token stream becomes an expression of nested items: an element is one item with the items of its
content, neighbours that match are folded into one repeated item, and text is a slot. The pages of a host
are aligned one after the other, in the order of their expressions: items that match are merged, items that do not become optional,
texts that differ become slots while equal ones stay constants. The result is the host's wrapper. Pages of one expression count once, so copies of a page change
nothing. A host's distinct expressions are dealt into buckets of about ``BUCKET_PAGES`` by their digest, and buckets' wrappers are merged ``FAN_IN`` at a time, so
neither a host's rows nor its wrappers meet in one task, and the wrapper does not depend on how rows are dealt to tasks.

The wrapper decides what of a page is main text, item by item (an item is known by its path of labels):
- constants on ``CONSTANT_PAGES`` distinct pages or more, and on most of those that have the item around them, are template, but not the headings, paragraphs, list
  items, ... of main items: what an article says on every page (a heading, a byline) is its own;
- items most of whose varying text stands in two links or more a page are menus, unless most of the host's prose is below them;
- items that HTML or their class names call apart (nav, footer, aside, adverts, forms, comments, ...) are template, unless the wrapper
  shows that nearly all prose of the host, or its main items, are below them (reader comments never are main);
- article and main items hold the main text if the wrapper shows that at least half of the other prose of such pages is below them and they are no
  menus; a page without such an item gives all its text, less the template.
Names are evidence that the alignment confirms or overrules; on hosts without telling names the alignment alone decides.

Null html gives an empty text; a null url belongs to the host ""; repeated rows give repeated rows; an empty table gives no rows; other
columns are ignored; an unclosed element ends with its parent, markup that never closes is read to its end; pages of any length are read whole,
in time linear in their length; elements nested deeper than ``DEPTH`` are one slot of the wrapper, and read all the same; of matches that
tie in an alignment the first is taken.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title".split())
#: Those of RAW that run to the end of the page where no end tag follows.
TO_END = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset(("option", "td", "th", "tr", "li", "dd", "dt", "caption"))
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

APART = frozenset("nav aside form footer button head menu dialog".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe "
    "sidebar widget related share sharing social nav navbar navigation menu breadcrumb breadcrumbs footer comment comments disqus respond replies toolbar pagination pager skip".split()
)
MAIN = frozenset(("article", "main"))
#: Blocks of prose: constants in them stay within main items.
PROSE = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
CONSTANT_PAGES = 4
#: Levels of a wrapper; pages are read to any depth.
DEPTH = 150
BUCKET_PAGES, FAN_IN = 256, 64
BROADCAST_BYTES = 8 << 20
#: Words of ``APART_WORDS`` that reader comments go by.
COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())

_OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
#: Tags with quoted values; a tag whose quotes or end are missing is seen by its last character.
_TOKEN = re.compile(_OTHER + r"|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:[>\"']|\Z)", re.S)
#: Tags that end at the next >, from the first such tag on: quotes can no longer be trusted there.
_LOOSE = re.compile(_OTHER + r"|</?[a-zA-Z][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: What differs from page to page in class names: letters mixed with digits (generated names), numbers.
_GENERATED = re.compile(r"(?<![a-z0-9])(?=[a-z]*\d)(?=\d*[a-z])[a-z0-9]{5,}(?![a-z0-9])|\d{3,}")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_raw_end = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


class Node:
    __slots__ = ("label", "tag", "hidden", "kids")

    def __init__(self, label: str, tag: str, hidden: bool = False):
        self.label, self.tag, self.hidden, self.kids = label, tag, hidden, []


def _node(tag: str, raw: str) -> Node:
    """Labels are the tag and its class names, long numbers alike, marked "*" for a main item, "!" for one that is called apart, "?" for reader comments."""
    attrs = {}
    if len(raw) > len(tag) + 2:
        for m in _ATTR.finditer(raw, len(tag) + 1):
            attrs.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    words = set(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split())
    role = attrs.get("role", "").lower()
    main = tag in MAIN or role in ("main", "article") or "articlebody" in attrs.get("itemprop", "").lower()
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    body = tag in ("html", "body")
    comments = not body and bool(words & COMMENT_WORDS) and (not main or "comment" in words)
    apart = tag in APART or tag in RAW or role in APART_ROLES or not body and not main and bool(words & APART_WORDS)
    mark = "?" if comments else "!" if apart else "*" if main else ""
    return Node(tag + "".join(f".{w}" for w in sorted({_GENERATED.sub("0", w) for w in attrs.get("class", "").split()})) + mark, tag, hidden)


def parse(page: str) -> Node:
    """A tree of the page's elements; texts are str, with character references still in them."""
    root = Node("", "")
    stack, at, token = [root], 0, _TOKEN
    endless: set[str] = set()
    held: Counter[str] = Counter()  # open elements by tag

    def close(upto: int) -> None:
        held.subtract(n.tag for n in stack[upto:])
        del stack[upto:]

    while at < len(page):
        m = token.search(page, at)
        if m and token is _TOKEN and page[m.start() + 1] not in "!?" and m[0][-1] != ">":
            token = _LOOSE
            m = token.match(page, m.start())
        text = page[at:m.start() if m else len(page)]
        if text:
            stack[-1].kids.append(text)
        if not m:
            break
        at, raw = m.end(), m[0]
        if raw[1] in "!?":
            if raw.startswith("<![CDATA["):
                stack[-1].kids.append(raw[9:-3].replace("&", "&amp;"))
            continue
        tag = _NAME.match(raw)[1].lower()
        if raw[1] == "/":
            for i in range(len(stack) - 1, 0, -1) if held[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:  # an inline end tag stays in its block
                    break
            continue
        if tag in RAW:
            if tag in ("svg", "math") and raw.endswith("/>"):
                continue
            end = None if tag in endless else _raw_end[tag].search(page, at)
            if end or tag in TO_END:
                at = end.end() if end else len(page)
                continue
            endless.add(tag)  # none follows: what it holds is apart until its parent ends
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPES[tag]:
                    break
                if stack[i].tag in SIBLINGS[tag]:
                    close(i)
                    break
        node = _node(tag, raw)
        stack[-1].kids.append(node)
        if tag not in VOID and not (raw.endswith("/>") and raw[-3] != "="):
            stack.append(node)
            held[tag] += 1
    return root


# An item: [label, optional, repeated, text, slot chars, pages, kids]; text is None, a constant's hash or "*"
LABEL, OPTIONAL, REPEATED, TEXT, CHARS, PAGES, KIDS = range(7)


def _hash(text: str) -> str:
    import zlib

    return f"{zlib.crc32(text.encode('utf-8', 'surrogatepass')):08x}{len(text):x}"


def _slot(text: str) -> list:
    t = " ".join(text.split())
    return [["#", 0, 0, _hash(t), len(t), 1, []]] if t else []


def texts_below(node: Node) -> str:
    """All texts under ``node`` that are not hidden, in page order."""
    out, todo = [], list(reversed(node.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif not k.hidden:
            todo.extend(reversed(k.kids))
    return " ".join(out)


def expression(node: Node, depth: int = 0) -> list:
    """The page's own union-free expression, neighbours folded; what nests deeper than ``DEPTH`` is one text slot."""
    kids: list = []
    if depth == DEPTH:
        kids = _slot(texts_below(node))
    else:
        for k in node.kids:
            kids += _slot(k) if isinstance(k, str) else [] if k.hidden else [expression(k, depth + 1)]
    return [node.label, 0, 0, None, 0, 1, fold(kids)]


def fold(kids: list) -> list:
    """Neighbouring matches become one repeated item; so do alternating pairs, by folding over one item between."""
    out: list = []
    for k in kids:
        for back in (1, 2):
            if len(out) >= back and out[-back][LABEL] == k[LABEL]:
                out[-back] = merge(out[-back], k, same_page=True)
                out[-back][REPEATED] = 1
                break
        else:
            out.append(k)
    return out


def merge(a: list, b: list, same_page: bool = False) -> list:
    """The least expression that covers both, whose labels are equal."""
    text = a[TEXT] if a[TEXT] == b[TEXT] else "*"
    pages = max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES]
    return [a[LABEL], a[OPTIONAL] | b[OPTIONAL], a[REPEATED] | b[REPEATED], text, a[CHARS] + b[CHARS], pages, align(a[KIDS], b[KIDS], same_page)]


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A common subsequence of two label lists: labels that each list has once anchor it, between anchors the next equal label is taken."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        in_a, in_b = Counter(a[i:n]), Counter(b[j:m])
        at_b = {x: k for k, x in enumerate(b[j:m], j) if in_b[x] == 1}
        once = [(k, at_b[x]) for k, x in enumerate(a[i:n], i) if in_a[x] == 1 and x in at_b]
        anchors = rising(once)
        if anchors:
            for (p, q), (r, t) in zip([(i - 1, j - 1), *anchors], [*anchors, (n, m)]):
                todo.append((p + 1, r, q + 1, t))
            out += anchors
        else:
            places: dict[str, list[int]] = {}
            for k in range(j, m):
                places.setdefault(b[k], []).append(k)
            for k in range(i, n):
                spots = places.get(a[k], ())
                f = bisect_left(spots, j)
                if f < len(spots):
                    out.append((k, spots[f]))
                    j = spots[f] + 1
    return sorted(out)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence whose second members rise."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        f = bisect_left(tails, y)
        before[k] = ends[f - 1] if f else -1
        tails[f:f + 1], ends[f:f + 1] = [y], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list, b: list, same_page: bool) -> list:
    """Items of a common subsequence are merged; what is outside of it becomes optional."""
    one, two = [x[LABEL] for x in a], [x[LABEL] for x in b]
    if one == two:
        return [merge(x, y, same_page) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for p, q in [*matches(one, two), (len(a), len(b))]:
        out += [[x[0], 1, *x[2:]] for x in a[i:p]] + [[x[0], 1, *x[2:]] for x in b[j:q]]
        if p < len(a):
            out.append(merge(a[p], b[q], same_page))
        i, j = p + 1, q + 1
    return fold_optional(out)


def fold_optional(items: list) -> list:
    out: list = []
    for x in items:
        if out and out[-1][LABEL] == x[LABEL]:
            out[-1] = merge(out[-1], x, same_page=True)
            out[-1][REPEATED] = 1
        else:
            out.append(x)
    return out


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _expressions(batches):
    for batch in batches:
        pages = [p or "" for p in batch.column("html").to_pylist()]
        for i, j in slices(pages, 8 << 20):
            out = [json.dumps(expression(parse(p)), separators=(",", ":")) for p in pages[i:j]]
            yield pa.RecordBatch.from_arrays([batch.column("host")[i:j], pa.array(out)], names=["host", "wrapper"])


def _merged(table: pa.Table) -> pa.Table:
    """The wrapper of one group's wrappers, in their own order."""
    out = None
    for w in sorted(table.column("wrapper").to_pylist()):
        w = json.loads(w)
        out = w if out is None else merge(out, w)
    return pa.table({"host": [table.column("host")[0].as_py()], "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int64()), "wrapper": [json.dumps(out, separators=(",", ":"))]})


def _ruled(batches):
    for batch in batches:
        out = [json.dumps(rules(json.loads(w)), separators=(",", ":")) for w in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string()), batch.column("wrapper")], names=["host", "rules", "wrapper"])


class _Mass:
    """What the wrapper shows below one path: characters of prose, in links and constant, links, pages."""

    def __init__(self):
        self.prose = self.link = self.links = self.pages = 0

    def menu(self) -> bool:
        return self.link > 2 * self.prose and self.links >= 2 * self.pages


def rules(wrapper: list) -> dict:
    """What extraction needs of a wrapper: template texts ("not"), paths of template items ("drop") and of main items ("main")."""
    constants, masses = [], {}

    def walk(item: list, path: str, link: bool, around: int) -> _Mass:
        here = f"{path}/{item[LABEL]}"
        below = _Mass()
        if item[LABEL] == "#":
            if item[TEXT] != "*" and item[PAGES] >= CONSTANT_PAGES and 2 * item[PAGES] > around:
                constants.append((path, item[TEXT]))
            elif link:
                below.link = item[CHARS]
            else:
                below.prose = item[CHARS]
            return below
        is_link = item[LABEL].partition(".")[0].rstrip("!?*") == "a"
        for k in item[KIDS]:
            m = walk(k, here, link or is_link, item[PAGES])
            below.prose, below.link, below.links = below.prose + m.prose, below.link + m.link, below.links + m.links
        below.links = item[PAGES] if is_link else below.links
        if item[REPEATED]:
            below.links *= 2
        known = masses.setdefault(here, _Mass())
        known.prose, known.link, known.links, known.pages = known.prose + below.prose, known.link + below.link, known.links + below.links, known.pages + item[PAGES]
        return below

    walk(wrapper, "", False, wrapper[PAGES])
    every = masses[f"/{wrapper[LABEL]}"]
    total = every.prose
    menus = {p for p, m in masses.items() if m.menu() and 2 * m.prose <= total} if total else set()
    above = lambda p: (p[:i] for i in range(1, len(p)) if p[i] == "/")
    comments = {p for p in masses if p.endswith("?")}
    main = [p for p, m in masses.items() if p.endswith("*") and p not in menus and 10 * m.prose * every.pages >= total * m.pages and not any(q in comments or q.endswith("*") for q in above(p))]
    held = sum(masses[p].prose for p in main)
    kept: set[str] = set()  # what holds a good part of the main items' prose is not apart
    for p in main:
        if 2 * masses[p].prose * len(main) >= held:
            kept.update(above(p))
    drop = comments - kept | {p for p, m in masses.items() if p.endswith("!") and p not in kept and 10 * m.prose < 9 * total}
    drop |= {p for p in menus if p not in kept and not any(q in main for q in above(p)) and p not in main} if total else set()
    first = {p for p in drop if not any(q in drop for q in above(p))}
    # the prose that main items compete with, on the pages that have them
    pages = sum(masses[p].pages for p in main)
    other = (total - sum(masses[p].prose for p in first if not any(q in main for q in above(p)))) * min(1.0, pages / max(1, every.pages))
    if 2 * held < other:
        main = []
    main = sorted(p for p in main if not any(q in first for q in [*above(p), p]))
    own = set(main)

    def said(path: str) -> bool:
        """Whether a text there belongs to a main item: its nearest block is one of prose."""
        tags = [x.partition(".")[0].rstrip("!?*") for x in path.split("/")]
        return any(q in own for q in [*above(path), path]) and next((t for t in reversed(tags) if t in BLOCK), "") in PROSE

    outside = [f"{p}|{t}" for p, t in constants if not said(p)]
    return {"not": outside if total else [], "drop": sorted(first), "main": main}


def extract(page: str, rule: dict) -> str:
    """Main text of one page, read against its host's rules: its main items, or all of it, less template items and texts."""
    root = parse(page)
    main, drop, dropped = frozenset(rule.get("main", ())), frozenset(rule.get("drop", ())), frozenset(rule.get("not", ()))
    # stacks of their own, as pages may nest deeper than Python's calls
    by_main, seen = False, [(root, "", 0)] if main else []
    while seen and not by_main:
        node, path, depth = seen.pop()
        here = f"{path}/{node.label}" if depth <= DEPTH else path
        if node.hidden or here in drop:
            continue
        by_main = here in main
        seen += [(k, here, depth + 1) for k in node.kids if not isinstance(k, str)]
    text, template = _read(root, main if by_main else None, dropped, drop)
    # copies of one page have its whole text in common, which is then no template
    if dropped and template and (not text or by_main and template > len(text)):
        text, _ = _read(root, main if by_main else None, frozenset(), drop)
    return text


def _read(root: Node, main: frozenset | None, dropped: frozenset, drop: frozenset) -> tuple[str, int]:
    """The text and how many characters of template it leaves out."""
    blocks: list[str] = []
    line: list[str] = []
    template = 0

    def end() -> None:
        t = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if t:
            blocks.append(t)

    todo: list = [(root, "", 0, main is None)]
    while todo:
        node, path, depth, inside = todo.pop()
        if node is None:
            end()
            continue
        if isinstance(node, str):
            if inside and dropped and f"{path}|{_hash(' '.join(node.split()))}" in dropped:
                template += len(node)
            elif inside:
                line.append(node)
            continue
        here = f"{path}/{node.label}" if depth <= DEPTH else path
        if node.hidden or here in drop:
            if node.tag in BLOCK:
                end()
            continue
        inside = inside or here in main
        if node.tag == "br" and inside:
            line.append(" ")
        if node.tag in BLOCK:
            end()
            todo.append((None, "", 0, False))
        todo.extend((k, here, depth + 1, inside) for k in reversed(node.kids))
    end()
    return "\n".join(blocks), template


def infer(pages: DataFrame, scratch: Scratch, bucket_pages: int = BUCKET_PAGES, fan_in: int = FAN_IN) -> DataFrame:
    """host, rules, wrapper: one row per host."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_expressions, "host string, wrapper string")
    # copies of a page have one expression: each counts once, whatever its rows
    parts = rows.withColumn("mark", F.md5("wrapper")).groupBy("host", "mark").agg(F.first("wrapper").alias("wrapper"))
    parts = scratch.save(parts, "expressions")
    counts = scratch.save(parts.groupBy("host").agg(F.ceil(F.count("*") / bucket_pages).cast("long").alias("buckets")), "counts")
    most = counts.agg(F.max("buckets")).first()[0] or 1
    parts = parts.join(counts, "host").select("host", F.pmod(F.xxhash64("mark"), F.col("buckets")).alias("bucket"), "wrapper")
    schema = "host string, bucket long, wrapper string"
    parts = scratch.save(parts.groupBy("host", "bucket").applyInArrow(_merged, schema), "merged0")
    step = 0
    while most > 1:
        most, step = -(-most // fan_in), step + 1
        up = parts.select("host", F.floor(F.col("bucket") / fan_in).cast("long").alias("bucket"), "wrapper")
        parts = scratch.save(up.groupBy("host", "bucket").applyInArrow(_merged, schema), f"merged{step}")
    return parts.mapInArrow(_ruled, "host string, rules string, wrapper string")


def _extracting(shared):
    def run(batches):
        told = shared.value if shared is not None else None
        parsed: dict[str, dict] = {}
        for batch in batches:
            hosts, pages = batch.column("host").to_pylist(), batch.column("html").to_pylist()
            given = batch.column("rules").to_pylist() if told is None else [told.get(h) for h in hosts]
            out = []
            for g, page in zip(given, pages, strict=True):
                g = g or '{"not":[],"drop":[],"main":[]}'
                if g not in parsed:
                    if len(parsed) > 4096:
                        parsed.clear()
                    parsed[g] = json.loads(g)
                out.append(extract(page or "", parsed[g]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "wrappers")
    rule = scratch.save(infer(pages, scratch), "wrappers").select("host", "rules")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    size = rule.agg(F.sum(F.length("rules") + F.length("host") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # rules are sent whole up to this size, else joined
        shared = spark.sparkContext.broadcast({r["host"]: r["rules"] for r in rule.toLocalIterator()})
        out = rows.mapInArrow(_extracting(shared), "page_id long, url string, text string")
    else:
        out = rows.join(rule, "host", "left").mapInArrow(_extracting(None), "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
