"""Main text of web pages by equivalence classes of tokens over the pages of a host."""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

KEYS_KEPT = 200_000
CHUNK = 64           # pages of a host that are searched together for frequent tokens
LEAST_PAGES = 2      # one page alone shows nothing that a host repeats
SHARE = 0.9          # of a host's pages that a template token stands in
MOST_TEXT = 0.8      # of the text around it that an element holds to be the root

# Names of HTML elements by their role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LISTS = frozenset("ul ol dl blockquote figure".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object".split())
ASIDE = frozenset("nav header footer aside form button select dialog menu".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Class, id and role names of what is not the article, whole, after one of PLACES, or
# as the first part of a longer name. Other parts of a name say nothing: no-sidebar, share-price.
ASIDE_NAMES = frozenset(
    "ad ads adv advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header login masthead menu modal nav navbar navigation newsletter notice popup promo promotion related "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget "
    "page-footer post-footer entry-footer post-comments entry-comments article-comments related-posts".split())
ASIDE_FIRST = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "masthead menu nav navbar navigation newsletter popup promo sidebar signup social sponsor sponsored subscribe widget".split())
PLACES = frozenset("site main global top bottom left right primary secondary".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMES = re.compile(r"(?<![^\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
PART = re.compile(r"[\s/\x01\x02]+")
NAMED, UNSEEN = MARKS = "\x01\x02"


def _named(attributes: str) -> bool:
    """Whether a class, id or role name is one of what is not the article."""
    for name in " ".join("".join(m) for m in NAMES.findall(attributes)).lower().split():
        if name in ASIDE_NAMES:
            return True
        first, *others = re.split(r"[-_]+", name)
        if others and (first in ASIDE_FIRST or first in PLACES and others[0] in ASIDE_NAMES and len(others) == 1):
            return True
    return False


def _hidden(attributes: str) -> bool:
    """Whether there is an attribute ``hidden``, or a style that shows nothing."""
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    return any(name.lower() == "hidden" or name.lower() == "style" and UNSHOWN.search("".join(values))
               for name, *values in ATTRIBUTE.findall(attributes))


def blocks(page: str | None, opened: list[str] | None = None) -> list[tuple[str, bool, str]]:
    """(path, aside, text) of the text blocks of a page in order.

    The path names the open block elements and their classes; an element that its names mark as aside
    ends in NAMED, a hidden one in UNSEEN. ``opened`` receives the path of every block element. Inline elements do not end a block,
    ``br`` is white space. A paragraph ends where a block begins; what is never closed ends with
    its parent. ``aside`` marks what lies in a menu, header, footer, form or the like.
    """
    page = page or ""
    out: list[tuple[str, bool, str]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, path, aside
    text: list[str] = []
    at = 0

    def flush() -> None:
        if text:
            # Spaces next to a character reference count once it is decoded.
            found = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if found:
                path, aside = (stack[-1][1], stack[-1][2]) if stack else ("", False)
                out.append((path, aside, found))

    def close(depth: int) -> None:
        flush()
        del stack[depth:]

    while match := TAG.search(page, at):
        if match.start() > at:
            text.append(page[at:match.start()])
        at = match.end()
        ending, tag, attributes = match.group(1), (match.group(2) or "").lower(), match.group(3) or ""
        if not tag:
            continue
        if tag in RAW:
            if not ending and not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            text.append(" ")
        elif tag in INLINE:
            continue
        elif ending:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                close(depth)
            else:
                flush()
        else:
            flush()
            if tag in VOID:
                continue
            ends = {"p"} | CLOSES.get(tag, set())
            depth = next((i for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1) if stack[i][0] in ends), None)
            if depth is not None:
                del stack[depth:]
            names = CLASS.search(attributes)
            name = tag + ("." + PART.sub(" ", "".join(x or "" for x in names.groups())).strip().lower() if names else "")
            if attributes and _hidden(attributes):
                name += UNSEEN
            elif attributes and tag not in ("html", "body", "article", "main") and _named(attributes):
                name += NAMED
            aside = bool(stack and stack[-1][2]) or tag in ASIDE or name[-1] in MARKS
            stack.append((tag, (stack[-1][1] + "/" if stack else "") + name, aside))
            if opened is not None:
                opened.append(stack[-1][1])
    if at < len(page):
        # A tag that is cut off at the end of the page is markup.
        text.append(re.sub(r"<[/!?A-Za-z][^<]*\Z", "", page[at:]))
    flush()
    return out


def _tag(path: str) -> str:
    part = path.rpartition("/")[2].rstrip(MARKS)
    return part.partition(".")[0]


def _under(path: str, root: str) -> bool:
    return not root or path == root or path.startswith(root + "/")


def _marked(path: str) -> bool:
    """Whether the element itself is aside."""
    return path[-1:] in (NAMED, UNSEEN) or _tag(path) in ASIDE


def _above(path: str) -> list[str]:
    """The path and those around it up to the page, which is "". An aside element ends the list."""
    out = [path]
    while path and not _marked(path):
        path = path.rpartition("/")[0]
        out.append(path)
    return out


def _aside(path: str, free: frozenset = frozenset()) -> bool:
    """Whether an element of the path is aside. Those in ``free`` are not."""
    while path:
        if _marked(path) and path not in free:
            return True
        path = path.rpartition("/")[0]
    return False


def _in_article(path: str) -> bool:
    return any(part.split(".")[0] in ("article", "main") for part in path.split("/"))


def _host(url_col: str):
    host = F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


# A page once it is read, packed: its element paths, how often each is opened, and its blocks.
PARSED = "page binary"


def parsed(page: str | None) -> tuple[list, ...]:
    opened: list[str] = [""]
    found = blocks(page, opened)
    times = Counter(opened)
    place = {path: k for k, path in enumerate(times)}
    return list(times), list(times.values()), [place[b[0]] for b in found], [b[1] for b in found], [b[2] for b in found]


def _blocks_of(paths: list, at: list, aside: list, text: list) -> list[tuple[str, bool, str]]:
    return [(paths[k], a, t) for k, a, t in zip(at, aside, text)]


def _packed(fields: tuple[list, ...]) -> bytes:
    return zlib.compress(json.dumps(fields, ensure_ascii=False, separators=(",", ":")).encode())


def _pages(batch: pa.RecordBatch):
    """The packed pages of a batch, parsed ones or bags of words, as they were."""
    return (json.loads(zlib.decompress(page.as_buffer())) for page in batch["page"])


def _bag(paths: list, opened: list, at: list, aside: list, text: list) -> tuple[list, ...]:
    """A parsed page without the order of its words: paths, opened, and the elements with text of their
    own, its length and its words in alphabetical order, which pack better."""
    words: dict[int, list[str]] = {}
    own: Counter = Counter()
    for k, t in zip(at, text):
        words.setdefault(k, []).extend(t.split())
        own[k] += len(t) + 1
    return paths, opened, list(words), [own[k] for k in words], [" ".join(sorted(w)) for w in words.values()]


def _tokens(
    paths: list, opened: list, at: list, sizes: list, words: list, known: dict | None = None,
) -> tuple[Counter, Counter, Counter]:
    """Counts of the tokens of a bag, characters beneath its elements that are not in an aside one
    deeper down, and characters that stand directly in its elements.

    A token is an element, by its path, or (path, word) of a block. The page itself is the element "".
    With ``known``, words by their path and elements at None, only its tokens are counted."""
    tokens, beneath, own = Counter(dict(zip(paths, opened))), Counter(), Counter()
    if known is not None:
        elements = known.get(None, ())
        tokens = Counter({path: n for path, n in tokens.items() if path in elements})
    for k, n, t in zip(at, sizes, words):
        path = paths[k]
        found = t.split()
        if known is not None:
            wanted = known.get(path, ())
            found = [w for w in found if w in wanted] if wanted else ()
        tokens.update((path, w) for w in found)
        own[path] = n
    for path, n in own.items():
        for above in _above(path):
            beneath[above] += n
    return tokens, beneath, own


def _counted(*page: list) -> tuple[Counter, Counter, Counter]:
    """As ``_tokens``, of a parsed page."""
    return _tokens(*_bag(*page))


def _distinct(paths: list, opened: list, at: list, aside: list, text: list) -> dict:
    """The tokens of a parsed page once each: words by their path, elements at None."""
    found: dict = {None: set(paths)}
    for k, t in zip(at, text):
        found.setdefault(paths[k], set()).update(t.split())
    return found


class _Chunk:
    """Weights of the tokens of up to ``CHUNK`` pages of a host, as far as they can still be frequent.

    A token that is missing from more than its share of the pages a whole chunk can have is not
    frequent however the chunk goes on, so after the first few pages no token is new."""

    def __init__(self):
        self.pages, self.weight, self.held = 0, 0.0, 0
        self.weights: dict[str | None, Counter] = {}

    def add(self, found: dict, times: int) -> None:
        # The tokens yet unseen are missing from all pages before.
        closed = self.weight > self._bar()
        for path, tokens in found.items():
            counts = self.weights.get(path)
            if counts is None:
                if closed:
                    continue
                counts = self.weights[path] = Counter()
            if closed:
                tokens = counts.keys() & tokens
            before = len(counts)
            if times == 1:
                counts.update(tokens)
            else:
                for token in tokens:
                    counts[token] += 1 / times
            self.held += len(counts) - before
        self.pages += 1
        self.weight += 1 / times
        if self.pages in (CHUNK // 8, CHUNK // 4, CHUNK // 2):
            least = self.weight - self._bar()
            self.weights = {path: Counter({t: w for t, w in counts.items() if w >= least}) for path, counts in self.weights.items()}
            self.held = sum(map(len, self.weights.values()))

    def _bar(self) -> float:
        """The greatest weight of pages that a token may be missing from."""
        return (1 - SHARE) * (self.weight + CHUNK - self.pages) + 1e-5

    def frequent(self) -> list[tuple[str, str | None]]:
        """(path, word) of the tokens that stand in ``SHARE`` of the pages so far."""
        least = SHARE * self.weight - 1e-6
        return [(token, None) if path is None else (path, token)
                for path, counts in self.weights.items() for token, w in counts.items() if w >= least]


def frequent(pages: DataFrame) -> DataFrame:
    """(host, path, word): the tokens that stand in ``SHARE`` of the pages of some chunk of a host.

    A token of that share of all of a host's pages has it in at least one chunk of any division, so
    none is missed, and rare words are never moved. Pages are parsed ones with host and times, see ``templates``."""
    def search(batches):
        seen: dict[str, _Chunk] = {}
        held = 0

        def rows(hosts) -> pa.RecordBatch:
            nonlocal held
            out: list[tuple] = []
            for host in hosts:
                chunk = seen.pop(host)
                held -= chunk.held
                out += [(host, *token) for token in chunk.frequent()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["host", "path", "word"])

        for batch in batches:
            for host, times, page in zip(batch["host"].to_pylist(), batch["times"].to_pylist(), _pages(batch)):
                chunk = seen.get(host)
                if chunk is None:
                    chunk = seen[host] = _Chunk()
                before = chunk.held
                chunk.add(_distinct(*page), times)
                held += chunk.held - before
                if held > KEYS_KEPT:
                    yield rows(list(seen))
                elif chunk.pages >= CHUNK:
                    yield rows([host])
        yield rows(list(seen))

    return pages.select("host", "times", "page").mapInArrow(search, "host string, path string, word string").distinct()


def occurrences(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """(host, path, word, chars, own, pages, total, a, b) of the given tokens over parsed pages with key, host and times.

    ``word`` is null for an element; ``chars`` is its text, without that of aside elements in it, and
    ``own`` what stands directly in it. a and b are sums of hashes of (page, count): equal for tokens
    with equal occurrence vectors, and sums can be combined in any order, so no vector is ever held.
    ``total`` sums the counts."""
    def count(batches):
        seen: dict[tuple, list] = {}

        def rows():
            found = pa.RecordBatch.from_arrays(
                [*(pa.array([k[i] for k in seen], pa.string()) for i in range(3)),
                 *(pa.array([v[i] for v in seen.values()], pa.float64()) for i in range(3)),
                 *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(3, 6))],
                names=["host", "path", "word", "chars", "own", "pages", "total", "a", "b"])
            seen.clear()
            return found

        wanted: dict[str, dict] = {}
        for batch in batches:
            columns = (batch[name].to_pylist() for name in ("key", "host", "times"))
            for i, (key, host, times, page) in enumerate(zip(*columns, _pages(batch))):
                known = wanted.get(host)
                if known is None:
                    if len(wanted) > 64:
                        wanted.clear()
                    known = wanted[host] = {}
                    for t in batch["tokens"][i].as_py():
                        path, word = (None, t["path"]) if t["word"] is None else (t["path"], t["word"])
                        known.setdefault(path, set()).add(word)
                x, y = key & 0x7FFFFFFF, (key >> 32) & 0x7FFFFFFF
                tokens, beneath, own = _tokens(*page, known)
                for token, n in tokens.items():
                    path, word = token if isinstance(token, tuple) else (token, None)
                    slot = seen.setdefault((host, path, word), [0.0, 0.0, 0.0, 0, 0, 0])
                    slot[0] += (beneath[path] if word is None else n * (len(word) + 1)) / times
                    slot[1] += own[path] / times if word is None else 0.0
                    slot[2] += 1 / times
                    slot[3] += n
                    slot[4] += (x * (2 * n + 1) ^ n * 0x9E3779B1) & 0x7FFFFFFF
                    slot[5] += (y * (2 * n + 3) ^ n * 0x85EBCA6B) & 0x7FFFFFFF
                if len(seen) > KEYS_KEPT:
                    yield rows()
        yield rows()

    def bags(batches):
        for batch in batches:
            packed = pa.array([_packed(_bag(*page)) for page in _pages(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], names=["key", "host", "times", "page"])

    lists = tokens.groupBy("host").agg(F.collect_list(F.struct("path", "word")).alias("tokens"))
    # Pages meet the tokens of their host as bags of words, which are smaller to move.
    rows = pages.select("key", "host", "times", "page")
    rows = rows.mapInArrow(bags, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
    found = rows.join(stored(lists), "host").select("key", "host", "times", "page", "tokens").mapInArrow(
        count, "host string, path string, word string, chars double, own double, pages double, total long, a long, b long")
    return found.groupBy("host", "path", "word").agg(*(F.sum(c).alias(c) for c in ("chars", "own", "pages", "total", "a", "b")))


def _root(chars: dict[str, float], own: dict[str, float], free: frozenset = frozenset()) -> tuple[str, str | None]:
    """The root and the path of a title outside of it.

    From the page inwards as long as one element holds ``MOST_TEXT`` of the text and is made of other
    elements. An element lies in the nearest one around it that the template has. If no heading lies
    in the root, it grows to the nearest element that also holds one, unless that is the whole body."""
    inner: dict[str, list[str]] = {}
    for path in chars:
        if path and not _aside(path, free):
            up = path.rpartition("/")[0]
            while up not in chars and up:
                up = up.rpartition("/")[0]
            inner.setdefault(up, []).append(path)
    root = ""
    while True:
        fit = [p for p in inner.get(root, ()) if _tag(p) not in LISTS and own[p] < chars[p] / 2]
        best = max(fit, key=lambda p: (chars[p], p), default=None)
        if best is None or chars[best] < max(1.0, MOST_TEXT * chars[root]):
            break
        root = best
    if _tag(root) in ("", "html", "body"):
        return root, None
    heads = [p for p in chars if _tag(p) in HEADINGS and chars[p] >= 1 and (_heading(p) or not _aside(p, free))]
    heads = [p for p in heads if _tag(p) == min(map(_tag, heads))]
    if not heads or any(_under(p, root) for p in heads):
        return root, None

    def shared(path: str) -> str:
        up = root
        while up and not path.startswith(up + "/"):
            up = up.rpartition("/")[0]
        return up

    title = max(heads, key=lambda p: (len(shared(p)), p))
    up = shared(title)
    return (up, None) if _tag(up) not in ("", "html", "body") else (root, title)


def _template(rows: list[tuple]) -> tuple[str, str | None, list[str], list[tuple[str, str]]] | None:
    """(root, title, free, constant) of a host from its tokens (path, word, chars, own, total, a, b)."""
    size: Counter = Counter()
    for path, word, _, _, *vector in rows:
        # An element gives two tokens, its start and its end.
        size[tuple(vector)] += 1 if word is not None else 2
    chars = {r[0]: r[2] for r in rows if r[1] is None}
    own = {r[0]: r[3] for r in rows if r[1] is None}
    whole = dict(chars)
    constant = sorted((r[0], r[1]) for r in rows if r[1] is not None and size[tuple(r[4:])] > 1)
    weight = {(r[0], r[1]): r[2] for r in rows if r[1] is not None}
    text_of = dict(own)
    # What the site repeats is no slot.
    for token in constant:
        own[token[0]] = own.get(token[0], 0.0) - weight[token]
        for path in _above(token[0]):
            if path in chars:
                chars[path] -= weight[token]
    chars = {p: n if n >= 0.05 * whole[p] else 0.0 for p, n in chars.items()}
    named = [p for p in chars if p.endswith(NAMED)]
    total = chars.get("", 0.0) + sum(chars[p] for p in named)
    free = frozenset(p for p in named if chars[p] > total / 2 and not _aside(p.rpartition("/")[0]))
    for path in free:
        for up in _above(path.rpartition("/")[0]):
            if up in chars:
                chars[up] += chars[path]
    root, title = _root(chars, own, free)
    # An element with text that differs is a slot, and whole: its blocks stay, whatever recurs in some.
    fixed = [t for t in constant if not _in_article(t[0]) and own[t[0]] < 0.001 * text_of.get(t[0], 0.0)]
    return root, title, sorted(free), fixed


def templates(pages: DataFrame) -> DataFrame:
    """(host, root, title, free, constant): the template of every host with ``LEAST_PAGES`` different pages.

    Parsed pages with key, host and an equal ``content`` are copies and count once: the one of the
    smallest key stands for them, and where its row is repeated each takes its part (``times``).
    Tokens with one occurrence vector form a class; classes of at least two tokens that stand in
    ``SHARE`` of the pages are valid. The start and end of an element are two tokens, so elements of
    that support always belong to a valid class; words do if another token has their vector, and are
    what the site puts on every page. ``constant`` are those of elements that hold nothing else; a
    recurring paragraph of an element with text of its own, or in ``article`` or ``main``, is not. Elements nest in the nearest valid one around
    them, and what is in them without being constant is the text of their slots. ``root`` is the
    nearest common ancestor of the slots with text, see ``_root``. Elements in ``free`` hold most of a
    host's text, whatever their names say. Tokens of less support are dropped before they meet, so a
    host's rows are bounded by its pages' size.
    """
    copies = pages.groupBy("host", "content", "key").agg(F.count("*").alias("times"))
    groups = copies.groupBy("host", "content").agg(
        F.min("key").alias("first"), F.sum("times").alias("rows"))
    sizes = groups.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    # Most pages have no copy: only those that have are joined.
    repeated = copies.join(groups.where("rows > 1"), ["host", "content"]).select(
        "host", "key", F.when(F.col("key") == F.col("first"), F.col("times")).otherwise(0).alias("found"))
    sizes, repeated = stored(sizes), stored(repeated)
    single = pages.join(sizes.select("host"), "host", "left_semi").join(repeated, ["host", "key"], "left").withColumn(
        "times", F.coalesce("found", F.lit(1))).where("times > 0")
    tokens = occurrences(single, frequent(single)).join(sizes, "host").where(F.col("pages") >= SHARE * F.col("n") - 1e-6)
    fields = ("path", "word", "chars", "own", "total", "a", "b")

    def build(batches):
        for batch in batches:
            found = [_template([tuple(r[f] for f in fields) for r in rows]) for rows in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t[0] for t in found], pa.string()), pa.array([t[1] for t in found], pa.string()),
                 pa.array([t[2] for t in found], pa.list_(pa.string())),
                 pa.array([[{"path": p, "word": w} for p, w in t[3]] for t in found],
                          pa.list_(pa.struct([("path", pa.string()), ("word", pa.string())])))],
                names=["host", "root", "title", "free", "constant"])

    return tokens.groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("rows")).mapInArrow(
        build, "host string, root string, title string, free array<string>, constant array<struct<path:string,word:string>>")


def _content(found: list[tuple[str, bool, str]]) -> str:
    """The article's text as the page alone shows it, or all text beside menus and the like where
    that is less than half of it, or else all text."""
    plain = "\n".join(x[2] for x in found if not x[1])
    text = "\n".join(article(found, None))
    return (text if 2 * len(text) >= len(plain) else plain) or "\n".join(x[2] for x in found)


def read(rows: DataFrame) -> DataFrame:
    """(id, url, host, key, content) and the PARSED page: html is read once, here. ``content`` is a
    hash of the text by which copies are told."""
    def parse(batches):
        for batch in batches:
            found = [parsed(page) for page in batch.column(4).to_pylist()]
            texts = [_content(_blocks_of(paths, *rest)).encode("utf-8", "replace") for paths, _, *rest in found]
            content = [int.from_bytes(blake2b(t, digest_size=8).digest(), "little", signed=True) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(content, pa.int64()), pa.array([_packed(f) for f in found], pa.binary())],
                names=["id", "url", "host", "key", "content", "page"])

    rows = rows.select("id", "url", "host", "key", "html")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("html").schema)
    return rows.mapInArrow(parse, f"{kinds}, content long, {PARSED}")


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """One row per page: (id, url, text, n_chars).

    The template of the page's host is worked out from all of its different pages (copies count
    once). A page that has the template's root gives the slots beneath it and the title; other pages
    and hosts without a template give what lies in ``article`` or ``main``, or else in the root that
    the page alone shows. Within these, menus, headers, footers, sidebars, forms, adverts, notices
    and comments are left out, and so is what elements hold that say the same on every page. A
    paragraph stays whole, however often the article's host repeats it. Character references are decoded, white space inside a block is
    one space, blocks are trimmed and joined by an empty line. Pages are parsed once, to a stored table.

    Null and empty html give an empty text. Null urls are one host. Null ids and repeated rows are
    rows of their own. An empty table gives no rows; other columns are not looked at.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"),
        _host(url_col).alias("host"),
        F.xxhash64(F.col(id_col).cast("string"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).alias("key"))
    rows = stored(read(rows))
    found = stored(templates(rows.select("key", "host", "content", "page")))
    rows = rows.select("id", "url", "host", "page").join(found, "host", "left")

    def extract(batches):
        sets: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for i, (host, (paths, _, *rest)) in enumerate(zip(batch["host"].to_pylist(), _pages(batch))):
                # Rows of a host follow each other: its template is unpacked once.
                if host not in sets:
                    if len(sets) > 64:
                        sets.clear()
                    root, title, free, constant = (batch[name][i].as_py() for name in ("root", "title", "free", "constant"))
                    sets[host] = (root, frozenset((t["path"], t["word"]) for t in constant or ()), title, frozenset(free or ()))
                texts.append("\n\n".join(article(_blocks_of(paths, *rest), *sets[host])))
            text = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["url"], text, pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"])

    out = rows.select("id", "url").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return rows.mapInArrow(extract, out).withColumnsRenamed({"id": id_col, "url": url_col})


def article(
    found: list[tuple[str, bool, str]], root: str | None, constant: frozenset = frozenset(),
    title: str | None = None, free: frozenset = frozenset(),
) -> list[str]:
    """The article's blocks of a page."""
    if root is not None:
        kept = [x for x in found if (_under(x[0], root) or x[0] == title) and (
            not x[1] or not _aside(x[0], free) or _heading(x[0]) and x[0] != root)]
        # Where elements of a slot are the article by their tags, with most of its text, these are taken.
        if not _in_article(root):
            inside = [x for x in kept if _in_article(x[0]) or x[0] == title]
            if 2 * sum(len(x[2]) for x in inside) > sum(len(x[2]) for x in kept):
                kept = inside
    if root is None or not kept:
        inside = [x for x in found if _in_article(x[0])]
        # Headings in the header of the article are its title.
        kept = [x for x in inside if not x[1] or _heading(x[0])]
        if not inside:
            own: Counter = Counter()
            chars: Counter = Counter({"": 0})
            for path, _, text in found:
                own[path] += len(text)
                for above in _above(path):
                    chars[above] += len(text)
            root, title = _root(chars, own)
            kept = [x for x in found if not x[1] and _under(x[0], root) or x[0] == title]
    return [text for path, _, text in kept
            if not constant or not all((path, w) in constant for w in text.split())]


def _heading(path: str) -> bool:
    """A heading in a header that is directly in the article, or in the root."""
    parts = [p.rstrip(MARKS).split(".")[0] for p in path.split("/")]
    if parts[-1] not in HEADINGS:
        return False
    last = max((i for i, p in enumerate(parts) if p in ("article", "main")), default=None)
    return last is not None and parts[last + 1:-1] in (["header"], ["header", "div"], ["header", "hgroup"])
