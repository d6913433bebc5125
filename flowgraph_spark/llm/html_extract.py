"""Main text of web pages, by removing the templates of their site.

Every page becomes a tree of elements. Each subtree is hashed with all it
holds, Spark counts on how many pages of its host a hash occurs, and subtrees
that recur there are removed as template, inside articles and outside. Elements that
are page furniture by name or class are removed as well, since a host with few
pages shows no recurrence and what readers write differs from page to page.
Where a host has enough pages to count, all other text stays, wherever on the
page it is; elsewhere an article is the text of its page alone.
"""

import html
import re
from bisect import bisect_left
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .common import bitmap_has, bitmap_of, cut_lineage, forget, slices, texts_of

#: A subtree is template from this many pages of its host on, and this share of them.
MIN_PAGES = 3
MIN_SHARE = 0.01
#: Prose inside an article needs more: this many pages, and more than this share of the host's.
PROSE_PAGES = 10
PROSE_SHARE = 0.5
#: The digest that stands for a host as such, counted like prose: its key is wanted from PROSE_PAGES on.
HOST_MARK = 0
#: Least bits of a table of hashes, and bits for each hash where there are more.
TABLE_BITS = 1 << 25
BITS_PER_KEY = 8

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
FURNITURE = frozenset(
    "head nav header footer aside form button select menu dialog script style title noscript iframe "
    "textarea template svg object audio video canvas".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul caption".split()
)
#: Elements that a start of the keyed element ends, and the elements that stop the search for them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd table tr td th tbody b i em strong a span figure figcaption".split())
#: Of these, parts of a sentence where they stand beside text or in prose, and cells read with their row.
INLINE = frozenset("b i em strong a span".split())
CELLS = frozenset("td th dt dd".split())
MAIN = frozenset({"article", "main"})
#: Words in class, id or role that mark page furniture.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disclaimer|footer|header|"
    r"masthead|menu|nav|navbar|navigation|newsletter|notice|popup|promo\w*|related|respond|share|sharing|"
    r"sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo|search)(?=$|[\s_-])",
    re.IGNORECASE,
)

#: Inside an article one of these words has to end a class, or to begin it before a word of layout.
_IN_ARTICLE = re.compile(
    MARKS.pattern.rpartition("(?=")[0]
    + r"(?=$|\s|[\s_-]+(?:area|bar|block|body|bottom|box|button|container|content|form|frame|group|inner|item|label|left|"
    r"link|links|list|main|outer|panel|right|row|section|slot|text|title|top|unit|wrap|wrapper|\d+)\b)",
    re.IGNORECASE,
)

#: A tag with its attributes, where it ends before the next ``<``; of others the name alone.
_OPEN = re.compile(
    r"<(?:(/?)([a-zA-Z][^\s/>]*)(?:((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>)?|!--|!\[CDATA\[|[!?])"
)
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "marks", "children", "digest", "chars", "main")

    def __init__(self, tag, marks=""):
        self.tag, self.marks, self.children = tag, marks, []


class _Tags:
    """Tags of a page from left to right; a scan that found no end is not run again."""

    def __init__(self, page):
        self.page, self.last = page, {mark: page.rfind(mark) for mark in ">\"'"}
        self.failed = []

    def end(self, at):
        """Place behind the ``>`` that ends a tag, not counting those in quotes; -1 if there is none."""
        if self.last[">"] < at or any(self._same(at, *scan) for scan in self.failed):
            return -1
        lows, highs = [], []
        while True:
            stop = _STOP.search(self.page, at)
            mark, at = (stop.group(), stop.end()) if stop else (None, at)
            if mark == ">":
                return at
            if mark is None or self.last[mark] < at:
                # No end, or a quote that nothing closes.
                self.failed.append((lows, highs))
                return -1
            close = self.page.find(mark, at)
            lows.append(at - 1)
            highs.append(close)
            at = close + 1

    @staticmethod
    def _same(at, lows, highs):
        """Would a scan from ``at`` go on as one that failed: its place is outside the quotes of that."""
        place = bisect_left(lows, at) - 1
        return place < 0 or at > highs[place]


def parse(page):
    """Tree of a page; text nodes are decoded strings. Any input gives a tree."""
    root = Node("html")
    stack, opened = [root], Counter()
    tags, at, text_from, size = _Tags(page), 0, 0, len(page)

    def text_until(place):
        if place > text_from:
            stack[-1].children.append(html.unescape(page[text_from:place]))

    def cut(place):
        for node in stack[place:]:
            opened[node.tag] -= 1
        del stack[place:]

    while at < size:
        match = _OPEN.search(page, at)
        if match is None:
            break
        start, at = match.start(), match.end()
        name = match.group(2)
        if name is None:
            kind = match.group()
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(kind, ">")
            stop = page.find(close, at) if tags.last[">"] >= at else -1
            if stop < 0 and close == ">":
                continue  # no tag, so text
            text_until(start)
            stop = size if stop < 0 else stop
            if close == "]]>":
                stack[-1].children.append(page[at:stop])
            text_from = at = min(size, stop + len(close))
            continue
        attributes, end = match.group(3), at
        if attributes is None:
            end = tags.end(at)
            if end < 0:
                continue
            attributes = page[at : end - 1]
        text_until(start)
        text_from = at = end
        name = name.lower()
        if match.group(1):
            _close(stack, opened, cut, name)
            continue
        if name in ("html", "body"):
            continue  # one of each is implied
        if name in BLOCKS:
            _close(stack, opened, cut, "p", stop=BLOCKS - {"p"})
        if name in CLOSES:
            ended, stop = CLOSES[name]
            if any(opened[tag] for tag in ended):
                outermost = None
                for place in range(len(stack) - 1, 0, -1):
                    if stack[place].tag in stop:
                        break
                    outermost = place if stack[place].tag in ended else outermost
                if outermost is not None:
                    cut(outermost)
        marks = " ".join(
            (k if not v else v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes)
        ) if attributes else ""
        node = Node(name, marks)
        stack[-1].children.append(node)
        if name in VOID or attributes.endswith("/") and name not in BLOCKS and name not in RAW:
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}[^>]*>", re.IGNORECASE).search(page, at) if tags.last[">"] >= at else None
            node.children.append(page[at : stop.start() if stop else size])
            text_from = at = stop.end() if stop else size
            continue
        stack.append(node)
        opened[name] += 1
    text_until(size)
    return root


def _close(stack, opened, cut, name, stop=frozenset()):
    """Ends the innermost open ``name``; nothing if there is none before ``stop``."""
    if not opened[name]:
        return
    for place in range(len(stack) - 1, 0, -1):
        if stack[place].tag == name:
            cut(place)
            return
        if stack[place].tag in stop:
            return


def digest(root):
    """Sets the hash, the text length and whether it holds main content, for every node."""
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        h = xxhash.xxh3_64()
        h.update(f"{node.tag}\0{node.marks}\0")
        node.chars, node.main = 0, node.tag in MAIN
        for child in node.children:
            if isinstance(child, Node):
                h.update(child.digest.to_bytes(8, "little"))
                node.chars += child.chars
                node.main = node.main or child.main
            else:
                text = " ".join(child.split())
                h.update(f"\1{text}\0")
                node.chars += len(text)
        node.digest = h.intdigest()
    return order


def is_furniture(node, inside=False):
    """Page furniture by name, class, id or role; ``inside`` an article the class has to say so plainly."""
    if node.tag in MAIN or node.main:
        return False
    words = _IN_ARTICLE if inside else MARKS
    return node.tag in FURNITURE or bool(node.marks and (node.marks == "hidden" or words.search(node.marks)))


def host_of(url):
    """Host of a URL in lower case without port; '' for null or a URL that has none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def candidates(root):
    """Subtrees that may be template, outermost first, and whether each is prose inside an article.

    Main content is none. In an article parts of a sentence are decided with
    the block they are in, and cells with their row.
    """
    total = root.chars
    found, waiting = [], [(root, False)]
    while waiting:
        node, inside = waiting.pop()
        inside = inside or node.tag in MAIN
        in_text = inside and (node.tag in PROSE or any(isinstance(c, str) and c.strip() for c in node.children))
        for child in node.children:
            if not isinstance(child, Node):
                continue
            part = inside and (child.tag in CELLS or in_text and child.tag in INLINE)
            if not child.main and child.chars and not part and 2 * child.chars <= total:
                found.append((child, inside and child.tag in PROSE))
            waiting.append((child, inside))
    return found


def _key(host, digest_value, prose):
    seeded = xxhash.xxh3_64_intdigest(f"{host}{chr(0) * prose}".encode("utf-8", "replace"), digest_value)
    return seeded & 0x7FFFFFFFFFFFFFFF


def template_counts(pages):
    """``host``, ``key``, ``prose`` and pages per host and subtree hash; a page counts once for each."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                counts = {}
                for url, page in zip(part["url"].to_pylist(), texts_of(part["html"])):
                    host = host_of(url)
                    root = parse(page)
                    digest(root)
                    own = {(host, node.digest, prose) for node, prose in candidates(root)}
                    # A page without a host belongs to no site.
                    for key in own | {(host, None, False)} | ({(host, HOST_MARK, True)} if host else set()):
                        counts[key] = counts.get(key, 0) + 1
                yield pa.record_batch(
                    {
                        "host": pa.array([h for h, _, _ in counts], pa.string()),
                        "key": pa.array([None if d is None else _key(h, d, p) for h, d, p in counts], pa.int64()),
                        "prose": pa.array([p for _, _, p in counts], pa.bool_()),
                        "pages": pa.array(list(counts.values()), pa.int64()),
                    }
                )

    return (
        pages.select("url", "html").mapInArrow(run, "host string, key long, prose boolean, pages long")
        .groupBy("host", "key", "prose").agg(F.sum("pages").alias("pages"))
    )


def templates(counts, min_pages=MIN_PAGES, min_share=MIN_SHARE):
    """Keys of the subtrees that are template on their host."""
    # The null key counts the pages of the host; hosts are few beside subtrees and join by hash.
    hosts = counts.where("key IS NULL").select("host", F.col("pages").alias("all_pages"))
    least = F.when(F.col("prose"), max(PROSE_PAGES, min_pages)).otherwise(min_pages)
    often = counts.where(F.col("key").isNotNull() & (F.col("pages") >= least)).join(hosts, "host")
    most = F.col("pages") > PROSE_SHARE * F.col("all_pages")
    enough = (F.col("pages") >= min_share * F.col("all_pages")) & (~F.col("prose") | most)
    return often.where(enough).select("key").distinct()


def _next_hashes(hashes):
    """As Spark's xxhash64 of each number."""
    digests = (xxhash.xxh64_intdigest(h.tobytes(), 42) for h in np.asarray(hashes, "<i8"))
    return np.fromiter(digests, np.uint64, len(hashes)).view(np.int64)


def cascade(wanted, others, table_bits=TABLE_BITS):
    """Bitmaps that tell the keys of ``wanted`` from those of ``others`` (both tables of ``key``) exactly.

    The first has the bits of ``wanted``, the second those of the others that
    hit the first by chance, the third those of ``wanted`` that hit the second,
    and so on until none is left. Each has BITS_PER_KEY bits a key at least, so
    the sets shrink.
    """
    levels, h, spark = [], F.col("key"), wanted.sparkSession
    first, made = wanted, []
    while count := wanted.count():
        bits = max(table_bits, 1 << (BITS_PER_KEY * count - 1).bit_length())
        levels.append(bitmap_of(wanted.select(h.alias("h")), "h", bits))
        shared = spark.sparkContext.broadcast(levels[-1])

        def run(batches, shared=shared):
            for batch in batches:
                yield batch.filter(pa.array(bitmap_has(shared.value, batch["h"].to_numpy()))).select(["key"])

        hits = others.select("key", h.alias("h")).mapInArrow(run, "key long")
        if len(levels) == 1:
            hits = hits.join(first, "key", "left_anti").distinct()  # a key of both counts as wanted
        wanted, others, h = cut_lineage(hits), wanted, F.xxhash64(h)
        made.append(wanted)
    forget(*made)
    return levels


def cascade_has(levels, keys):
    """Boolean array: is each key, of those the ``levels`` were made of, a wanted one."""
    hashes = np.asarray(keys, np.int64)
    found, left = np.zeros(len(hashes), bool), np.arange(len(hashes))
    for number, level in enumerate(levels):
        if number:
            hashes = _next_hashes(hashes)
        hit = bitmap_has(level, hashes)
        found[left[~hit]] = number % 2 == 1
        left, hashes = left[hit], hashes[hit]
    found[left] = len(levels) % 2 == 1
    return found


def main_text(root, is_template, counted=True):
    """Text of the blocks left, in page order, joined by one space.

    Where templates are not ``counted`` an article is all the text of its page.
    """
    inside_main = [] if counted else _first_main(root)
    blocks, current = [], []

    def flush():
        text = " ".join("".join(current).split())
        current.clear()
        if text:
            blocks.append(text)

    # Depth first without recursion: a marker ends each block element.
    waiting = [(node, True) for node in reversed(inside_main)] or [(root, False)]
    while waiting:
        node, inside = waiting.pop()
        if node is None:
            flush()
            continue
        if isinstance(node, str):
            current.append(node)
            continue
        if is_furniture(node, inside) or is_template(node, inside):
            current.append(" ")
            continue
        if node.tag == "br":
            current.append(" ")
            continue
        inside = inside or node.tag in MAIN
        block = node.tag in BLOCKS
        if block:
            flush()
            waiting.append((None, inside))
        waiting += [(child, inside) for child in reversed(node.children)]
    flush()
    return " ".join(blocks)


def _first_main(root):
    """Outermost articles, or main elements where a page has some, in page order."""
    found, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if node.tag in MAIN and not (node.marks and MARKS.search(node.marks)):
            found.append(node)
            continue
        waiting += [c for c in reversed(node.children) if isinstance(c, Node) and not is_furniture(c)]
    return found


def extract(pages, min_pages=MIN_PAGES, min_share=MIN_SHARE, table_bits=TABLE_BITS):
    """page_id, url, text, n_chars of every row.

    Null or empty html gives an empty text, any other input a tree. A null url
    counts as the host '', which is no site: templates of it are counted, but its
    pages with an article have that alone, as those of hosts with few pages. Repeated rows are extracted each, and count as pages
    each; other columns are not read.

    Template keys travel as bitmaps of ``table_bits`` bits or more, which tell
    all keys of the pages apart: no subtree goes because it shares a bit.
    """
    counts = cut_lineage(template_counts(pages))
    wanted = cut_lineage(templates(counts, min_pages, min_share))
    levels = cascade(wanted, counts.where("key IS NOT NULL").select("key"), table_bits)
    forget(counts, wanted)
    shared = pages.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = []
                for url, page in zip(part["url"].to_pylist(), texts_of(part["html"])):
                    host, root = host_of(url), parse(page)
                    digest(root)
                    chosen = candidates(root)
                    keys = [_key(host, n.digest, prose) for n, prose in chosen]
                    if host:
                        keys.append(_key(host, HOST_MARK, True))
                    hits = cascade_has(shared.value, keys) if keys else []
                    known = {id(n): bool(hit) for (n, _), hit in zip(chosen, hits)}
                    counted = bool(host) and bool(hits[-1])
                    texts.append(main_text(root, lambda node, inside: known.get(id(node), False), counted))
                yield pa.record_batch(
                    [
                        part["page_id"], part["url"], pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
