"""Operator 9: main text of web pages by wrappers, union-free regular expressions that pages of one host share.

Pages become streams of tags and texts; the unit of alignment is an element with what it holds. Equal neighbours fold
into a repeated group. A host has a wrapper for each template, inferred from all its pages: it starts as one page and is
aligned with the others, exactly and in linear space; what one side lacks becomes optional, texts that differ become
slots. Wrappers of parts of the pages are aligned in the same way, so no task has to hold a host. A page is read by the
wrapper of its template: the article is in the element whose slots hold most text that is not in links, where an article
or main element speaks for all that it holds and other elements for their paragraphs. A page of no known template is a
wrapper of its own. Slots cannot tell a reader's comment from a paragraph, nor an advert within the article from a part
of it: what is left out there is told by the element (aside, nav, form, ...) or by what its class says as a whole.
Nothing here recurses, and no length, depth or number of words is cut.
"""

from __future__ import annotations

import html as entities
import json
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes of regions to broadcast; templates whose numbers of pages are broadcast.
BROADCAST, TEMPLATES = 16 << 20, 100_000
#: Groups of a wrapper (a template that needs more has several, whose slots add up); parts that a template's wrappers are merged in before the last merge.
GROUPS, PARTS = 2_000, 64
#: Different texts that a task counts, and pages that it tells copies by, before it passes on what it has.
TEXTS, COPIES = 50_000, 100_000

# Elements of HTML by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|iframe|template|svg|math|xmp|select|object|canvas"
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
OFF = frozenset("aside button dialog fieldset footer form head menu nav search".split())
OFF_WORDS = frozenset("ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments commentlist contentinfo cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notification pager pagination popup promo related share sharing sidebar sidebars skip social sponsor sponsored subscribe toolbar widget complementary".split())
GENERIC = frozenset("area article bar block bottom box btn card cell center col column container content entry frame group head holder inner item items left link links list main module outer page panel pane post posts region right row section slot thread top unit wrap wrapper".split())
LISTS = frozenset("ul ol dl table tbody tr blockquote pre figure hgroup".split())
TEXTUAL = LISTS | frozenset("address caption dd dt figcaption h1 h2 h3 h4 h5 h6 header li p".split())
WHOLE = frozenset("section p li dt dd figure table".split())
FRAME = frozenset("html body article main".split())
TITLED = WHOLE | frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)>|<(?:[!?]|/?[a-zA-Z])[^>]*(?:>|\Z)|(?P<text>[^<]+|<)""", re.S | re.I)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def says_off(token: str, inside: bool) -> bool:
    """Is a class, role or id, taken whole, a name of what is no article? "share-bar" is, "market-share" is not."""
    words = [w for w in re.split(r"[_\-]+", token) if w and not w.isdigit()]
    off = [w for w in words if w in OFF_WORDS and not (inside and w == "header")]
    return bool(off) and all(w in OFF_WORDS or w in GENERIC for w in words) and not (off == ["header"] and len(words) > 1 and words[0] in ("article", "entry", "post"))


@lru_cache(20_000)
def label(tag: str, attrs: str, inside: bool = False) -> tuple[str, bool]:
    """An element's name in a path (its tag and the words of its class, id and role, without numbers), and whether it holds what is no article.

    The id of a heading is its title, which says nothing of what it holds; that of a section or the like counts whole.
    inside: it is within an article or main element, whose header is a part of it.
    """
    words, off = set(), tag in OFF or (tag == "header" and not inside)
    for m in NAMED.finditer(attrs) if attrs else ():
        said = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() != "id":
            words.update(w for w in re.split(r"[\s_\-]+", said) if not w.isdigit())
            off |= tag not in FRAME and any(says_off(t, inside) for t in said.split())
        elif tag in WHOLE:
            words.add(said.strip())
            off |= said.strip() in OFF_WORDS
        elif tag not in TITLED:
            words.update(w for w in re.split(r"[\s_\-]+", said) if not w.isdigit())
            off |= tag not in FRAME and says_off(said.strip(), inside)
    return ".".join([tag, *sorted(words - {""})]), off


class Paths:
    """Paths of block elements, each a number: 0 is the page. Equal paths are one, so that no path is ever copied."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str, bool], int] = {}
        self.up, self.name, self.off, self.inside = [0], ["#page"], [False], [False]

    def down(self, at: int, tag: str, attrs: str) -> int:
        name, off = label(tag, attrs, self.inside[at])
        key = (at, name, off)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.up)
            self.up.append(at)
            self.name.append(name)
            self.off.append(off or self.off[at])
            self.inside.append(self.inside[at] or tag in ("article", "main"))
        return found

    def tag(self, at: int) -> str:
        return self.name[at].partition(".")[0]

    def path(self, at: int) -> list[str]:
        out = []
        while at:
            out.append(self.name[at])
            at = self.up[at]
        return out[::-1]


def texts(page: str, paths: Paths) -> Iterator[tuple[int, bool, str]]:
    """(path, in a link, text) of each text, and (0, False, "") wherever a block starts or ends."""
    stack: list[tuple[str, int]] = []  # tag and path
    count: Counter[str] = Counter()  # of tags on the stack
    at = links = 0

    def pop(k: int) -> None:
        count.subtract(t for t, _ in stack[k:])
        del stack[k:]

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            yield at, links > 0, text
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            yield at, links > 0, " "
        if tag == "a":
            links = 0 if m["end"] else 1
        if tag not in BLOCK:
            continue
        yield 0, False, ""
        if tag in VOID:
            continue
        links = 0
        if m["end"]:
            if count[tag] > 0:
                pop(next(k for k in _down(len(stack)) if stack[k][0] == tag))
        else:
            if stack and stack[-1][0] == "p":  # a block ends an open paragraph
                pop(len(stack) - 1)
            if tag in ENDS and any(count[t] > 0 for t in ENDS[tag]):
                for k in _down(len(stack)):
                    if stack[k][0] in KEEPS.get(tag, ()):
                        break
                    if stack[k][0] in ENDS[tag]:
                        pop(k)
                        break
            if tag in ("article", "main"):  # a menu, header or form left open ends here
                for k, (t, _) in enumerate(stack):
                    if t in ("nav", "header", "form", "head"):
                        pop(k)
                        break
            stack.append((tag, paths.down(stack[-1][1] if stack else 0, tag, m["attrs"] or "")))
            count[tag] += 1
        at = stack[-1][1] if stack else 0


def _down(n: int) -> range:
    return range(n - 1, -1, -1)


@dataclass
class Group:
    """A part of a wrapper: an element (or, named #, a text), whether it is optional or repeated, and its text: constant, or None for a slot."""

    name: str
    parts: list[Group] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    text: str | int | None = ""  # a number is a text's hash
    free: int = 0  # characters of text outside links, all pages together
    slots: int = 0  # those of texts that are not the same on most pages
    off: bool = False  # what is no article

    def below(self) -> list[Group]:
        """This group and all below, each before what it holds."""
        out, todo = [], [self]
        while todo:
            out.append(todo.pop())
            todo.extend(out[-1].parts)
        return out

    def expression(self) -> str:
        """The wrapper as a union-free regular expression."""
        said: dict[int, str] = {}
        for group in reversed(self.below()):
            inner = ("#SLOT" if group.text is None else str(group.text)) if group.name == "#" else f"<{group.name}>{''.join(said.pop(id(p)) for p in group.parts)}</{group.name}>"
            said[id(group)] = f"({inner})+" if group.repeated and not group.optional else f"({inner})*" if group.repeated else f"({inner})?" if group.optional else inner
        return said[id(self)]


Events = list[tuple[int, bool, str]]


def said(events: Events, paths: Paths) -> Iterator[tuple[int, bool, str]]:
    """(path, in a link, text) of each text in an element, white space within being one space."""
    for at, link, text in events:
        if at and text.strip():
            yield at, link, " ".join(text.split())


def stream(events: Events, paths: Paths, constant: frozenset[tuple[int, str]] = frozenset()) -> Group:
    """A page as elements, with equal neighbours folded. constant: places and texts that most pages have."""
    root = Group("#page")
    open_, group = [0], {0: root}  # the paths from the page to where the last text was, and their groups
    for at, link, word in said(events, paths):
        new, k = [], at
        while k not in group:
            new.append(k)
            k = paths.up[k]
        while open_[-1] != k:
            del group[open_.pop()]
        for p in reversed(new):
            last = group[open_[-1]].parts
            if not last or last[-1].name != paths.name[p] or last[-1].off != paths.off[p]:
                last.append(Group(paths.name[p], off=paths.off[p]))
            open_.append(p)
            group[p] = last[-1]
        free = 0 if link else len(word)
        group[at].parts.append(Group("#", text=word, free=free, slots=0 if (at, word) in constant else free))
    return fold(root)


def fold(root: Group) -> Group:
    """Neighbours of the same name become one repeated group, from below."""
    for group in reversed(root.below()):
        out: list[Group] = []
        for part in group.parts:
            if out and out[-1].name == part.name and out[-1].off == part.off:
                out[-1] = merge(out[-1], part)
                out[-1].repeated = True
            else:
                out.append(part)
        group.parts = out
    return root


def merge(a: Group, b: Group) -> Group:
    """The least wrapper of two groups of one name: parts that align are merged in their turn, what one side lacks is optional."""

    def both(x: Group, y: Group) -> Group:
        return Group(x.name, [], x.optional or y.optional, x.repeated or y.repeated, x.text if x.text == y.text else None, x.free + y.free, x.slots + y.slots, x.off)

    whole = both(a, b)
    todo = [(whole, a, b)]
    while todo:
        out, x, y = todo.pop()
        for p, q in align(x.parts, y.parts):
            if p is not None and q is not None:
                out.parts.append(both(p, q))
                todo.append((out.parts[-1], p, q))
            else:
                one = p if p is not None else q
                one.optional = True
                out.parts.append(one)
    return whole


def align(a: list[Group], b: list[Group]) -> Iterator[tuple[Group | None, Group | None]]:
    """Parts of two groups in order: those of a longest common subsequence of names together, others alone."""
    code: dict[tuple[str, bool], int] = {}
    x, y = ([code.setdefault((g.name, g.off), len(code)) for g in side] for side in (a, b))
    i = j = 0
    for p, q in [*common(x, y), (len(a), len(b))]:
        yield from ((g, None) for g in a[i:p])
        yield from ((None, g) for g in b[j:q])
        if p < len(a):
            yield a[p], b[q]
        i, j = p + 1, q + 1


def common(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by halving one side; space is linear."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        if k - i == 1:
            at = next((n for n in range(j, m) if b[n] == a[i]), None)
            if at is not None:
                out.append((i, at))
            continue
        half = (i + k) // 2
        first = lengths(a[i:half], b[j:m])
        second = lengths(a[half:k][::-1], b[j:m][::-1])[::-1]
        cut = j + int((first + second).argmax())
        todo += [(i, half, j, cut), (half, k, cut, m)]
    return sorted(out)


def lengths(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b; a row of the table is the bits of one number."""
    row = np.asarray(b)
    bits = {x: int.from_bytes(np.packbits(row == x, bitorder="little").tobytes(), "little") for x in set(a) & set(b)}
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        if x in bits:
            u = v & bits[x]
            v = ((v + u) | (v - u)) & full
    zero = np.frombuffer((v ^ full).to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.r_[0, np.cumsum(np.unpackbits(zero, bitorder="little")[: len(b)], dtype=np.int64)]


def wrapper(pages: list[str]) -> Group:
    """The wrapper of pages of one template, aligned one after the other."""
    paths = Paths()
    streams = [list(texts(page, paths)) for page in pages]
    alike = Counter(x for _, events in {p: e for p, e in zip(pages, streams, strict=True)}.items() for x in {(at, word) for at, _, word in said(events, paths)})
    constant = frozenset(x for x, n in alike.items() if n > 1 and 2 * n > len(set(pages)))
    out = Group("#page")
    for k, events in enumerate(streams):
        one = stream(events, paths, constant)
        out = one if k == 0 else merge(out, one)
    return out


#: A region of all article and main elements.
MARKED = ["#article"]


@lru_cache(20_000)
def number(text: str, above: int = 0) -> int:
    """A hash of 64 bits: of a text, or of a name in a path from the hash of the path above."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=above.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


class Masses:
    """Characters of text in slots and in all, by the path of their element: what a template's wrappers say together."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}
        self.up, self.name, self.slots, self.free, self.inside = [0], [""], [0], [0], [False]

    def down(self, above: int, name: str) -> int:
        at = self.known.setdefault((above, name), len(self.up))
        if at == len(self.up):
            self.up.append(above)
            self.name.append(name)
            self.slots.append(0)
            self.free.append(0)
            self.inside.append(self.inside[above] or name.partition(".")[0] in ("article", "main"))
        return at

    def add(self, root: Group) -> None:
        """Add those of a wrapper; what is no article counts nothing."""
        todo = [(p, 0) for p in root.parts]
        while todo:
            group, above = todo.pop()
            if group.off:
                continue
            if group.name == "#":
                self.slots[above] += group.slots
                self.free[above] += group.free
                continue
            at = self.down(above, group.name)
            todo.extend((p, at) for p in group.parts)

    def add_page(self, events: Events, paths: Paths) -> None:
        """Add those of one page, as add does with its stream."""
        place = {0: 0}
        for at, link, word in said(events, paths):
            k, new = at, []
            while paths.off[k]:
                k = paths.up[k]
            on = k == at
            while k not in place:
                new.append(k)
                k = paths.up[k]
            here = place[k]
            for k in reversed(new):
                here = place[k] = self.down(here, paths.name[k])
            if on and not link:
                self.slots[here] += len(word)
                self.free[here] += len(word)

    def take(self, constant: Mapping[int, int]) -> None:
        """Texts that most pages have are no slots: take their characters, by the hash of their path, out of the slots."""
        key = [0] * len(self.up)
        for at in range(1, len(self.up)):
            key[at] = number(self.name[at], key[self.up[at]])
            self.slots[at] -= constant.get(key[at], 0)

    def path(self, at: int) -> list[str]:
        out = []
        while at:
            out.append(self.name[at])
            at = self.up[at]
        return out[::-1]

    def region(self) -> list[str]:
        """Path of the element that holds the article, MARKED for all article and main elements, or nothing if there is no text.

        It is that with most text in slots, or with most text where all pages say the same; the outer one of equals, then
        that of the least path. An element has its own text and that of its paragraphs and the like; article and main
        elements have all that is in them. A list or the like gives way to the element around it, and so does one beside
        which there are only headings, paragraphs and lists.
        """
        n = len(self.up)
        depth, parent = [0] * n, [False] * n
        slots, free = list(self.slots), list(self.free)
        for at in range(1, n):
            depth[at] = depth[self.up[at]] + 1
            parent[self.up[at]] = True
        for at in range(1, n):
            if not parent[at]:
                slots[self.up[at]] += self.slots[at]
                free[self.up[at]] += self.free[at]
        best, where = (0, 0, 0), 0
        for at in range(1, n):
            one = (slots[at], free[at], -depth[at])
            if free[at] and (one > best or (one == best and self.path(at) < self.path(where))):
                best, where = one, at
        marked = sum(self.slots[at] for at in range(n) if self.inside[at]), sum(self.free[at] for at in range(n) if self.inside[at])
        if marked[1] and marked >= best[:2]:
            return MARKED
        tag = lambda at: self.name[at].partition(".")[0]
        line, at = set(), where  # the element and those around it
        while at:
            line.add(at)
            at = self.up[at]
        kids: dict[int, list[int]] = {at: [] for at in line}
        for at in range(1, n):
            if self.up[at] in kids:
                kids[self.up[at]].append(at)
        while self.up[where]:
            above = self.up[where]
            beside = [k for k in kids[above] if k != where]
            if tag(where) in LISTS or (beside and tag(above) not in ("html", "body") and all(tag(k) in TEXTUAL for k in beside)):
                where = above
            else:
                break
        return self.path(where)


def region(root: Group) -> list[str]:
    """The region that one wrapper gives."""
    masses = Masses()
    masses.add(root)
    return masses.region()


def own_region(events: Events, paths: Paths) -> list[str]:
    """The region that a page gives as a wrapper of its own, which tells its template."""
    masses = Masses()
    masses.add_page(events, paths)
    return masses.region()


def regions(pages: list[str]) -> dict[str, list[str]]:
    """The region of each template among a host's pages; a page's template is told by what its own region would be."""
    alike: dict[str, list[str]] = {}
    for page in dict.fromkeys(pages):
        paths = Paths()
        if own := own_region(list(texts(page, paths)), paths):
            alike.setdefault(" ".join(own), []).append(page)
    return {template: region(wrapper(same)) for template, same in alike.items()}


class Gathering:
    """Wrappers aligned one after the other to one, or to several where one would be of more than GROUPS groups."""

    def __init__(self) -> None:
        self.out: Group | None = None
        self.size = 0

    def add(self, one: Group) -> Iterator[Group]:
        """Align one more; a wrapper that is full comes back."""
        n = len(one.below())
        if self.out is not None and self.size + n <= GROUPS:
            self.out = merge(self.out, one)
            self.size = len(self.out.below())
        else:
            yield from self.last()
            self.out, self.size = one, n

    def last(self) -> Iterator[Group]:
        if self.out is not None:
            yield self.out
        self.out = None


def gathered(wrappers: Iterable[Group]) -> Iterator[Group]:
    """The wrappers that these give together."""
    out = Gathering()
    for one in wrappers:
        yield from out.add(one)
    yield from out.last()


def packed(root: Group) -> bytes:
    """A wrapper as bytes, texts as their hashes; slots are left out."""
    flat = [(g.name, len(g.parts), g.optional, g.repeated, number.__wrapped__(g.text) if isinstance(g.text, str) and g.name == "#" else g.text, g.free, g.off) for g in root.below()]
    return pickle.dumps(flat, 5)


def unpacked(data: bytes) -> Group:
    """The wrapper of packed, every text a slot."""
    root, todo = Group(""), []
    todo.append((root, 1))
    for name, n, optional, repeated, text, free, off in pickle.loads(data):
        while not todo[-1][1]:
            todo.pop()
        above, left = todo[-1]
        todo[-1] = above, left - 1
        group = Group(name, [], optional, repeated, text, free, free, off)
        above.parts.append(group)
        todo.append((group, n))
    # below() lists the parts of a group from the last to the first
    out = root.parts[0]
    for group in out.below():
        group.parts.reverse()
    return out


def distinct_texts(events: Events, paths: Paths) -> bytes:
    """(path, text, characters outside links) of each different text of a page that may be of the article, paths and texts as hashes."""
    key: dict[int, int] = {0: 0}
    found: dict[tuple[int, int], int] = {}
    for at, link, word in said(events, paths):
        if paths.off[at]:
            continue
        new, k = [], at
        while k not in key:
            new.append(k)
            k = paths.up[k]
        for k in reversed(new):
            key[k] = number(paths.name[k], key[paths.up[k]])
        x = key[at], number.__wrapped__(word)
        found[x] = found.get(x, 0) + (0 if link else len(word))
    return np.array([(p, t, n) for (p, t), n in found.items()], np.int64).tobytes()


def main_text(page: str, known: Mapping[str, list[str]] | None) -> str:
    """The article's blocks, one in each line: those of the region of the page's template on its host, else of its own region."""
    paths = Paths()
    events = list(texts(page, paths))
    own = own_region(events, paths)
    where = (known or {}).get(" ".join(own))
    return (where and blocks(events, paths, where)) or blocks(events, paths, own)


def blocks(events: Events, paths: Paths, where: list[str]) -> str:
    """The blocks within a region, one in each line."""
    if not where:
        return ""
    fits = [0] * len(paths.up)  # how many names of the region a path has followed; -1: it is another way
    for at in range(1, len(fits)):
        n = fits[paths.up[at]]
        fits[at] = n if n in (-1, len(where)) else n + 1 if paths.name[at] == where[n] else -1
    wanted = [not off and (inside if where == MARKED else n == len(where)) for off, inside, n in zip(paths.off, paths.inside, fits, strict=True)]
    wanted[0] = False
    out: list[str] = []
    own: list[str] = []
    for at, _, text in [*events, (0, False, "")]:
        if not text:
            line = " ".join(entities.unescape("".join(own)).split())
            if line:
                out.append(line)
            own.clear()
        elif wanted[at]:
            own.append(text)
    return "\n".join(out)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[list]]]:
    """Rows of sorted batches by their first columns: each key, and its rows without them, to be read before the next key."""
    rows = ([column[i].as_py() for column in batch.columns] for batch in batches for i in range(batch.num_rows))
    ahead = next(rows, None)

    def one(key: list) -> Iterator[list]:
        nonlocal ahead
        while ahead is not None and ahead[:keys] == key:
            row, ahead = ahead, None
            yield row[keys:]
            ahead = next(rows, None)

    while ahead is not None:
        key = ahead[:keys]
        run = one(key)
        yield tuple(key), run
        for _ in run:
            pass


def _batches(rows: Iterable[Sequence], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about `most` bytes."""
    out: list[Sequence] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        out.append(row)
        size += sum(8 * len(x) if isinstance(x, list) else len(x) if isinstance(x, str | bytes) else 8 for x in row)
        if size >= most:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


_KEY = [("host", pa.string()), ("template", pa.string())]
_RECORD = pa.schema([*_KEY, ("digest", pa.binary()), ("tree", pa.binary()), ("texts", pa.binary())])
_COUNTS = ["path", "text", "n", "free"]
_PART = pa.schema([*_KEY, ("part", pa.int32()), ("pages", pa.int64()), ("tree", pa.binary()), *((c, pa.list_(pa.int64())) for c in _COUNTS)])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page of (host, html) as its template, its stream and its texts; a copy that the task has just had is left out."""

    def rows() -> Iterator[tuple]:
        seen: set[bytes] = set()
        for batch in batches:
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                host, page = host.as_py(), page.as_py()
                digest = blake2b(f"{host}\0{page}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if digest in seen:
                    continue
                if len(seen) >= COPIES:
                    seen.clear()
                seen.add(digest)
                paths = Paths()
                events = list(texts(page, paths))
                if own := own_region(events, paths):
                    yield host, " ".join(own), digest, packed(stream(events, paths)), distinct_texts(events, paths)

    return _batches(rows(), _RECORD)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's wrappers of each template, and how many of its different pages have each text; counts are added up later."""
    part = TaskContext.get().partitionId() % PARTS
    none = [None] * len(_COUNTS)

    def said_by(counts: dict[tuple[int, int], list[int]]) -> list[list[int]]:
        return [[p for p, _ in counts], [t for _, t in counts], [n for n, _ in counts.values()], [free for _, free in counts.values()]]

    def rows() -> Iterator[tuple]:
        for key, run in _runs(batches, 2):
            counts: dict[tuple[int, int], list[int]] = {}
            out, last, pages = Gathering(), None, 0
            for digest, tree, found in run:
                if digest == last:
                    continue
                last = digest
                pages += 1
                for p, t, free in np.frombuffer(found, np.int64).reshape(-1, 3).tolist():
                    have = counts.setdefault((p, t), [0, 0])
                    have[0] += 1
                    have[1] += free
                if len(counts) >= TEXTS:
                    yield *key, part, 0, None, *said_by(counts)
                    counts = {}
                for root in out.add(unpacked(tree)):
                    yield *key, part, 0, packed(root), *none
            for root in out.last():
                yield *key, part, 0, packed(root), *none
            yield *key, part, pages, None, *said_by(counts)

    return _batches(rows(), _PART)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrappers of (host, template, part) aligned with one another."""
    rows = ((*key[:2], packed(root)) for key, run in _runs(batches, 3) for root in gathered(unpacked(tree) for (tree,) in run))
    return _batches(rows, pa.schema([*_KEY, ("tree", pa.binary())]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The region of each template from its wrappers and constant texts, where it is not what a page of it gives by itself."""

    def rows() -> Iterator[tuple]:
        for (host, template), run in _runs(batches, 2):
            masses = Masses()
            constant: dict[int, int] = {}

            def trees() -> Iterator[Group]:
                for tree, path, mass in run:
                    if tree is None:
                        constant[path] = mass
                    else:
                        yield unpacked(tree)

            for root in gathered(trees()):
                masses.add(root)
            masses.take(constant)
            where = masses.region()
            if " ".join(where) != template:
                yield host, template, json.dumps(where)

    return _batches(rows(), pa.schema([*_KEY, ("region", pa.string())]))


def wrapped(rows: DataFrame) -> DataFrame:
    """(host, template, region) of the templates of all pages of (host, html) whose wrappers give another region than a page by itself.

    All different pages count, equal pages of a host once. They are dealt by their hash, so a large host is spread over all
    tasks; what is shuffled is each page's stream with texts as hashes, then wrappers and counts of texts. A text is
    constant if more than half of the template's pages, and two at least, have it in the same place.
    """
    records = rows.mapInArrow(_records, "host string, template string, digest binary, tree binary, texts binary")
    dealt = records.repartition("digest").sortWithinPartitions("host", "template", "digest")
    parts = written(dealt.mapInArrow(_parts, "host string, template string, part int, pages long, tree binary, path array<long>, text array<long>, n array<long>, free array<long>"))
    totals = parts.groupBy("host", "template").agg(F.sum("pages").alias("pages")).where("pages > 1")
    counted = parts.select("host", "template", F.explode(F.arrays_zip(*_COUNTS)).alias("c")).select("host", "template", "c.*")
    common_ = counted.groupBy("host", "template", "path", "text").agg(F.sum("n").alias("n"), F.sum("free").alias("free")).where("n > 1")
    totals = F.broadcast(totals) if totals.count() <= TEMPLATES else totals
    constant = common_.join(totals, ["host", "template"]).where("2 * n > pages").groupBy("host", "template", "path").agg(F.sum("free").alias("mass"))
    trees = parts.where("tree is not null").select("host", "template", "part", "tree").repartition("host", "template", "part").sortWithinPartitions("host", "template", "part")
    merged = trees.mapInArrow(_merged, "host string, template string, tree binary")
    both = merged.select("host", "template", "tree", F.lit(None).cast("long").alias("path"), F.lit(None).cast("long").alias("mass"))
    both = both.unionByName(constant.select("host", "template", F.lit(None).cast("binary").alias("tree"), "path", "mass"))
    return written(both.repartition("host", "template").sortWithinPartitions("host", "template").mapInArrow(_found, "host string, template string, region string"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Character references are decoded, white space within a block is one space, blocks stand in page order with one \\n
    between; n_chars counts code points. A null or empty html, or one without an article, gives an empty text. Wrappers
    come from all pages of a host; a page whose url names no host is read by itself. Repeated rows and null page_ids are
    kept; other columns are ignored; an empty table gives an empty result. Very long and very deep pages are read like
    others. Regions that differ from what pages give by themselves are broadcast if they are small, else joined by host and
    template.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    found = wrapped(rows.where("host <> ''").select("host", "html"))
    size = found.agg(F.coalesce(F.sum(F.length("host") + F.length("template") + F.length("region") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST:
        known: dict[str, dict[str, list[str]]] = {}
        for r in found.collect():
            known.setdefault(r["host"], {})[r["template"]] = json.loads(r["region"])
        shared = pages.sparkSession.sparkContext.broadcast(known)

        def of(row: Sequence) -> Mapping[str, list[str]] | None:
            return shared.value.get(row[3].as_py())
    else:

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                templates = []
                for page in batch.column(2):
                    paths = Paths()
                    templates.append(" ".join(own_region(list(texts(page.as_py(), paths)), paths)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(templates, pa.string())], names=[*batch.schema.names, "template"])

        rows = rows.mapInArrow(named, "page_id long, url string, html string, host string, template string").join(found, ["host", "template"], "left").select("page_id", "url", "html", "template", "region")

        def of(row: Sequence) -> Mapping[str, list[str]] | None:
            return {row[3].as_py(): json.loads(row[4].as_py())} if row[4].is_valid else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(row[2].as_py(), of(row)) for row in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
