"""Text extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a tree of blocks and text slots. For each path of a host's pages the children's labels make a
stream. Neighbouring repeats of a group become a repeated group (unless they are equally many on all pages);
the different streams of a path are aligned one after the other, and what one has and another lacks becomes
an optional group, until one expression describes the path on all pages. Labels of the template keep their
places however many there are; only an irregular run between two of them, longer than ``LONG``, becomes a
repeated group of optional items, so an expression grows with the labels of the template.

Each page is matched against its host's expressions: the place in the expression that a child takes tells
plain neighbours apart (the second ``div`` of a body is another slot than the first). A slot is constant if
``SAME`` pages or more and two thirds of the host's hold it, all with the same text. The container is a
wrapper node: the highest one marked as the article that holds enough of the text, or else the lowest that
holds most of the text of variable slots. A page's text is what its slots below the container hold, without
the constant ones (where the container's text varies for the greater part), and without menus, forms, footers
and sidebars, which are told by their elements, and adverts and reader comments, which are told by what boxes
(not headings or paragraphs) are called.

Scale: label words of classes and ids count only if they recur on a host's pages, so the paths are those of
the template. Streams are folded in the tasks that read them; only different ones, with counts, are shuffled, and
alignments run over groups of about ``FAN``, level by level, so a host with a third of all pages is no larger
a task than others. Slots are summed by aggregates with partial sums. Parsing is linear in the page: elements
nested deeper than ``DEPTH`` belong to the one at that depth. The html is read once for label words,
once for streams, once for slots and once for texts, and joined to one small row for each host.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.ship import ship
from ledgerline.llm.urls import host_of
from ledgerline.session import durable

FAN = 32
#: A marked container is taken if it holds this share of the text that is not left out.
MARKED = 0.2
#: Bytes of wrappers and containers up to which they are broadcast.
FEW_BYTES = 32 << 20
#: Items of an irregular run between template labels above which it becomes a repeated group of optional items.
LONG = 64
#: Children of one element up to which equally many neighbours are told apart by their places.
RAW_STREAM = 128
#: Nested elements up to which each is a node of its own.
DEPTH = 200
#: Pages with the same text from which a slot counts as constant, if they are two thirds of the host's.
SAME = 8
#: Label words on fewer pages than this share of the host's are left off.
OFTEN = 1 / 50
#: Paths with fewer elements than this share of a host's pages get no expression.
RARE = 1 / 200
#: Without one, the way leads down while a single child holds this share.
DOWN = 0.7

BLOCKS = set(
    "html head body p div h1 h2 h3 h4 h5 h6 li ul ol table thead tbody tfoot tr td th caption blockquote pre article "
    "section header footer main aside nav form fieldset figure figcaption dl dt dd address hr details summary center".split()
)
LEFT_OUT = set(
    "head nav footer aside form fieldset script style noscript template select option textarea iframe svg math "
    "canvas object audio video dialog menu input".split()
)
RAW = set("script style textarea title noscript iframe template svg".split())
VOID = set("br img hr meta link input source wbr area base col embed param track".split())
#: Elements that are left out for what they are called.
BOXES = set("div section ul ol dl table figure center details header".split())
#: Words of class, id and role that name what is not the article.
NAMES = set(
    "nav navbar navigation menu header masthead footer sidebar aside widget ad ads advert adverts advertisement banner promo "
    "sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus respond "
    "reply replies share sharing social related recommended breadcrumb breadcrumbs pagination pager subscribe newsletter "
    "signup login search toolbar skip tags meta byline copyright legal disclaimer contentinfo complementary".split()
)
#: Words that may stand beside them in a name ("ad-slot"); any other word ("search-algorithms") means something else.
BESIDE = set(
    "area bar bottom box button buttons container footer form header inner left link links list main panel reader right "
    "section site slot top unit user wrap wrapper".split()
)
ARTICLE = set("article articlebody post-content entry-content article-content article-body story main maincontent".split())
CLOSES_P = BLOCKS - {"html", "head", "body"}

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_WORD = re.compile(r"[a-z][a-z-]*")
_PLACE = re.compile(r"/\d+:")
_BREAK = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _names_another(value: str) -> bool:
    """Whether one of the names in a class, id or role is that of something beside the article."""
    for name in value.split():
        parts = [x for x in _BREAK.split(name) if x]
        if any(x in NAMES for x in parts) and all(x in NAMES or x in BESIDE for x in parts):
            return True
    return False


@functools.lru_cache(maxsize=1 << 14)
def _element(name: str, attributes: str) -> tuple[str, bool, bool]:
    """How an element is called in paths, whether it is left out, and whether it is marked as the article."""
    out, marked, label = name in LEFT_OUT, name in ("article", "main"), name
    for key, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if hidden or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
            out = True
        elif key in ("class", "id", "role", "itemprop"):
            words = _WORD.findall(value)
            marked |= bool(ARTICLE & set(words))
            if name in BOXES and not marked and _names_another(value):
                out = True
            if key in ("class", "id") and words:
                label = f"{name}.{words[0]}"
    return label, out, marked


class Page:
    """Blocks of text with their paths, and the tree of elements and slots."""

    _TOP = ("", "", False, False, 0)

    def __init__(self, source: str, labels: frozenset | None = None):
        self._labels = labels
        self.blocks: list[tuple[str, bool, str]] = []
        self.inside: list[int] = []  # the element of each block
        self.elements: list[tuple[int, str, str]] = [(-1, "", "")]  # parent, path, label; the first is the page
        self.children: list[list[int]] = [[]]  # of each element; 0 is a slot
        self._stack: list[tuple[str, str, bool, bool, int]] = []  # name, path, left out, within the article, element
        self._where: dict[str, list[int]] = {}  # where on the stack elements of a name are
        self._text: list[str] = []
        at, size = 0, len(source)
        while at < size:
            found = _TAG.search(source, at)
            if found is None:
                self._text.append(source[at:])
                break
            if found.start() > at:
                self._text.append(source[at : found.start()])
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if not name:
                continue
            if found[1] or found[4]:
                self._close(name)
                continue
            attributes = found[3] if found[2] else found[6]
            self._open(name, attributes or "")
            if name in RAW and not (attributes or "").endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(source, at)
                at = end.start() if end else size
        self._flush()

    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join(html.unescape("".join(self._text)).split())
        self._text = []
        if text:
            _, path, out, _, at = self._stack[-1] if self._stack else self._TOP
            self.blocks.append((path, out, text))
            self.inside.append(at)
            if self.children[at][-1:] != [0]:
                self.children[at].append(0)

    def _push(self, name: str, attributes: str) -> None:
        _, path, out, inside, at = self._stack[-1] if self._stack else self._TOP
        label, left, marked = _element(name, attributes)
        # a header within the article holds its headline
        out = out or (not inside if name == "header" else left)
        self._where.setdefault(name, []).append(len(self._stack))
        if len(self._stack) < DEPTH:
            if self._labels is not None and label not in self._labels:
                label = name
            label = f"{label}!article" if marked else label
            self.children[at].append(len(self.elements))
            path = f"{path}/{label}"
            self.elements.append((at, path, label))
            self.children.append([])
            at = len(self.elements) - 1
        self._stack.append((name, path, out, inside or marked, at))

    def _pop(self, at: int) -> None:
        while len(self._stack) > at:
            self._where[self._stack.pop()[0]].pop()

    def streams(self) -> list[tuple[str, tuple]]:
        """Each element's path and the labels of its children."""
        labels = [e[2] for e in self.elements]
        return [(e[1], tuple(labels[c] or "#" for c in found)) for e, found in zip(self.elements, self.children)]

    def slots(self, models: dict[str, str]) -> list[str]:
        """The wrapper node of each block: a path whose steps tell the place in the parent's expression."""
        where = [""] * len(self.elements)
        for at, (path, labels) in enumerate(self.streams()):
            if labels:
                for child, label, place in zip(self.children[at], labels, places(models.get(path, "[]"), labels)):
                    if child:
                        where[child] = f"{where[at]}/{place}:{label}"
        return [where[at] for at in self.inside]

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self._flush()
            if name in CLOSES_P and self._where.get("p"):
                self._pop(self._where["p"][-1])
            elif name in ("li", "tr", "td", "th", "dt", "dd") and self._stack and self._stack[-1][0] == name:
                self._pop(len(self._stack) - 1)
            if name not in VOID:
                self._push(name, attributes)
        elif name == "br":
            self._text.append(" ")
        elif name in LEFT_OUT and name not in VOID or name == "title":
            self._flush()
            self._push(name, attributes)

    def _close(self, name: str) -> None:
        if name not in BLOCKS and name not in LEFT_OUT and name != "title":
            return
        if self._where.get(name):
            self._flush()
            self._pop(self._where[name][-1])
        elif name in BLOCKS:
            self._flush()


# --- union-free expressions: tuples of symbols, ("+", items) and ("?", items) ---


def fold(items: tuple, longest: int = 12) -> tuple:
    """Neighbouring repeats of a group as one repeated group, short groups first."""
    items = list(items)
    for size in range(1, longest + 1):
        at = 0
        while at + 2 * size <= len(items):
            group = items[at : at + size]
            n = 1
            while items[at + n * size : at + (n + 1) * size] == group:
                n += 1
            if n > 1:
                inner = group[0][1] if size == 1 and group[0][0] == "+" and isinstance(group[0], tuple) else tuple(group)
                items[at : at + n * size] = [("+", inner)]
            at += 1
    return tuple(items)


def _groups(items: tuple) -> set:
    found = set()
    for x in items:
        if isinstance(x, tuple):
            if x[0] == "+":
                found.add(x[1])
            found |= _groups(x[1])
    return found


def _mark_groups(items: tuple, groups: set) -> tuple:
    """Single occurrences of a group that repeats elsewhere are repeats, too."""
    out = [(x[0], _mark_groups(x[1], groups)) if isinstance(x, tuple) and x[0] == "?" else x for x in items]
    for group in sorted(groups, key=lambda g: (len(g), repr(g))):
        at, size = 0, len(group)
        while at + size <= len(out):
            if tuple(out[at : at + size]) == group:
                out[at : at + size] = [("+", group)]
            at += 1
    return tuple(out)


def _mark_plain(items: tuple, groups: set) -> tuple:
    """Plain occurrences of a group that is optional elsewhere, as one item to be compared with it."""
    out = list(items)
    for group in sorted(groups, key=lambda g: (-len(g), repr(g))):
        at, size = 0, len(group)
        while size > 1 and at + size <= len(out):
            if tuple(out[at : at + size]) == group:
                out[at : at + size] = [("=", group)]
            at += 1
    return tuple(out)


def _is(x, *tags: str) -> bool:
    return isinstance(x, tuple) and x[0] in tags


def _bare(x):
    return x[1] if _is(x, "?", "=") else (x,)


def align(a: tuple, b: tuple) -> tuple:
    """One expression for what either describes: common items stay, the others become optional groups."""
    groups = _groups(a) | _groups(b)
    a, b = _mark_groups(a, groups), _mark_groups(b, groups)
    optional = {x[1] for x in (*a, *b) if _is(x, "?")}
    a, b = _mark_plain(a, optional), _mark_plain(b, optional)
    n, m = len(a), len(b)
    common = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            common[i][j] = (
                common[i + 1][j + 1] + 1 if _bare(a[i]) == _bare(b[j]) else max(common[i + 1][j], common[i][j + 1])
            )
    out, only, i, j = [], [], 0, 0

    def lacking():
        if only:
            # what is optional in a larger group stays so
            group = tuple(y for x in only for y in (_bare(x) if len(only) == 1 or _is(x, "=") else (x,)))
            out.append(("?", group))
            only.clear()

    while i < n and j < m:
        if _bare(a[i]) == _bare(b[j]):
            lacking()
            out.extend([("?", _bare(a[i]))] if _is(a[i], "?") or _is(b[j], "?") else _bare(a[i]))
            i, j = i + 1, j + 1
        elif common[i + 1][j] >= common[i][j + 1]:
            only.append(a[i])
            i += 1
        else:
            lacking()
            only.append(b[j])
            lacking()
            j += 1
    for rest in (a[i:], b[j:]):
        only.extend(rest)
        lacking()
    return fold(tuple(out))


def as_json(items: tuple) -> str:
    return json.dumps(items, ensure_ascii=False, separators=(",", ":"))


def from_json(text: str) -> tuple:
    def back(x):
        return tuple(back(y) for y in x) if isinstance(x, list) else x

    return back(json.loads(text))


def as_expression(items: tuple) -> str:
    """The wrapper as people read it."""
    return " ".join(x if isinstance(x, str) else f"( {as_expression(x[1])} ){x[0]}" for x in items)


def _leaves(items: tuple) -> list[str]:
    return [y for x in items for y in ((x,) if isinstance(x, str) else _leaves(x[1]))]


def widen(items: tuple) -> tuple:
    """An expression for at least the same streams that grows with the different labels only: what occurs once
    keeps its place, and long runs between are any of their labels, any number."""
    often = Counter(_leaves(items))
    out: list = []
    run: list = []

    def end() -> None:
        found = _leaves(tuple(run))
        out.extend(run if len(found) <= LONG else [("+", tuple(("?", (("+", (x,)),)) for x in sorted(set(found))))])
        run.clear()

    for x in items:
        if not _is(x, "+") and all(often[y] == 1 for y in _leaves((x,))):
            end()
            out.append(x)
        else:
            run.append(x)
    end()
    return tuple(out)


@functools.lru_cache(maxsize=1 << 12)
def _stream(labels: tuple) -> str:
    return as_json(labels if len(labels) <= RAW_STREAM else widen(fold(labels)))


def _number(items: tuple, steady: set[str], seen: Counter) -> tuple:
    out = []
    for x in items:
        if isinstance(x, str):
            seen[x] += 1
            out.append(f"{x}\0{seen[x]}" if x in steady else x)
        else:
            out.append((x[0], _number(x[1], steady, seen)) if x[0] == "?" else x)
    return tuple(out)


def _unnumber(items: tuple) -> tuple:
    return tuple(x.split("\0")[0] if isinstance(x, str) else (x[0], _unnumber(x[1])) for x in items)


def merged(expressions: list[str]) -> str:
    """One expression for all. Items of a label that wherever it occurs occurs equally often are no repeats."""
    each = [from_json(x) for x in expressions]
    counts: dict[str, set[int]] = {}
    for items in each:
        seen: Counter = Counter()
        _number(items, set(), seen)
        for x, n in seen.items():
            counts.setdefault(x, set()).add(n)
    repeated = {y for items in each for group in _groups(items) for y in _leaves(group)}
    steady = {x for x, n in counts.items() if len(n) == 1 and x not in repeated}
    each = [fold(_number(items, steady, Counter())) for items in each]
    return as_json(_unnumber(functools.reduce(lambda a, b: widen(align(a, b)), each)))


@functools.lru_cache(maxsize=1 << 12)
def _automaton(expression: str) -> tuple[list[str], list[list[int]], list[int], set[int]]:
    """Symbols by place, places that may follow each, first and last places."""
    symbols, follow = [], []

    def then(ends: list[int], starts: list[int]) -> None:
        for end in ends:
            follow[end] += [x for x in starts if x not in follow[end]]

    def walk(items: tuple) -> tuple[bool, list[int], list[int]]:
        empty, first, last = True, [], []
        for x in items:
            if isinstance(x, str):
                skip, starts, ends = False, [len(symbols)], [len(symbols)]
                symbols.append(x)
                follow.append([])
            else:
                skip, starts, ends = walk(x[1])
                if x[0] == "+":
                    then(ends, starts)
                skip |= x[0] == "?"
            then(last, starts)
            first = first + starts if empty else first
            last = last + ends if skip else ends
            empty &= skip
        return empty, first, last

    _, first, last = walk(from_json(expression))
    return symbols, follow, first, set(last)


@functools.lru_cache(maxsize=1 << 12)
def places(expression: str, labels: tuple) -> tuple[int, ...]:
    """The place each label takes when the expression describes the labels; where it does not, the first
    place of the label, or 0."""
    symbols, follow, first, last = _automaton(expression)
    steps: list[dict[int, int]] = []
    for label in labels:
        now: dict[int, int] = {}
        for was, following in [(-1, first)] if not steps else [(s, follow[s]) for s in sorted(steps[-1])]:
            for to in following:
                if symbols[to] == label:
                    now.setdefault(to, was)
        steps.append(now)
    at = min((s for s in steps[-1] if s in last), default=None)
    if at is None:
        return tuple(symbols.index(x) if x in symbols else 0 for x in labels)
    out = []
    for step in reversed(steps):
        out.append(at)
        at = step[at]
    return tuple(reversed(out))


def whole(models: dict[str, str]) -> tuple:
    """The expressions of all paths in one; an element with more than three children is shown once."""
    shown: set[str] = set()

    def inner(items: tuple, path: str) -> tuple:
        out: list = []
        for x in items:
            if x == "#":
                out.append(x)
            elif isinstance(x, str):
                at = f"{path}/{x}"
                content = from_json(models.get(at, "[]"))
                again = at in shown and len(content) > 3
                shown.add(at)
                out += [x, *(("...",) if again else inner(content, at)), f"/{x}"]
            else:
                out.append((x[0], inner(x[1], path)))
        return tuple(out)

    return inner(from_json(models.get("", "[]")), "")


# --- Spark ---


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """On how many pages each label with a word of class or id stands; the empty label counts pages."""
    for batch in batches:
        seen: Counter = Counter()
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            found = {_element((t[2] or t[5]).lower(), t[3] or t[6] or "")[0] for t in _TAG.finditer(source or "") if t[3] or t[6]}
            seen.update((host, label) for label in found if "." in label)
            seen[(host, "")] += 1
        if seen:
            columns = [*zip(*seen), seen.values()]
            yield pa.record_batch([pa.array(list(c)) for c in columns], ["host", "label", "n"])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple, int] = {}
        for host, source, known in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "labels"))):
            for path, labels in Page(source or "", _labels(known)).streams():
                key = (host, path, _stream(labels))
                seen[key] = seen.get(key, 0) + 1
        if seen:
            keys = list(zip(*seen))
            yield pa.record_batch([*(pa.array(k) for k in keys), pa.array(list(seen.values()), pa.int64())], ["host", "path", "what", "n"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple, list[int]] = {}
        columns = [batch.column(c).to_pylist() for c in ("host", "html", "models", "labels")]
        for host, source, models, known in zip(*columns):
            page, here = Page(source or "", _labels(known)), {}
            kept = [(slot, text) for slot, (_, out, text) in zip(page.slots(_models(models)), page.blocks) if not out]
            for slot, text in kept:
                here.setdefault(slot, []).append(text)
            for slot, texts in here.items():
                text = "\n".join(texts)
                key = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                sums = seen.setdefault((host, slot), [0, 0, key, key])
                sums[:] = sums[0] + 1, sums[1] + len(text), min(sums[2], key), max(sums[3], key)
        if seen:
            columns = [*zip(*seen), *zip(*seen.values())]
            yield pa.record_batch([pa.array(list(c)) for c in columns], ["host", "slot", "n", "chars", "least", "most"])


@functools.lru_cache(maxsize=1 << 10)
def _models(found: str | None) -> dict[str, str]:
    return json.loads(found or "{}")


@functools.lru_cache(maxsize=1 << 10)
def _labels(found: str | None) -> frozenset:
    return frozenset(filter(None, (found or "").split("\n")))


def plain(slot: str) -> str:
    """A wrapper node's path without places."""
    return _PLACE.sub("/", slot)


def container(paths: list[tuple[str, int]]) -> str:
    """The path that holds the article: the highest marked one with enough of the text, or else the lowest
    that holds most of it."""
    total = sum(n for _, n in paths)
    below: dict[str, int] = {}
    for path, n in paths:
        parts = path.split("/")
        for i in range(1, len(parts)):
            step = "/".join(parts[: i + 1])
            below[step] = below.get(step, 0) + n
    marked = [p for p, n in below.items() if p.endswith("!article") and n >= MARKED * total]
    if marked:
        return min(marked, key=lambda p: (p.count("/"), -below[p], p))
    at = ""
    while True:
        children = [p for p in below if p.startswith(f"{at}/") and p.count("/") == at.count("/") + 1]
        best = max(children, key=lambda p: (below[p], p), default=None)
        if best is None or below[best] < DOWN * total or best.rsplit("/", 1)[1].split(".")[0] in ("p", "h1", "li", "td"):
            return at
        at = best


def _known(rows: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with what is known of their host: sent to all tasks while it is small, else by a join that
    Spark splits."""
    known = known.select("host", *columns)
    size = known.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(64)))).first()[0] or 0
    return rows.join(F.broadcast(known) if size <= FEW_BYTES else known, "host", "left")


def _containers(slots: DataFrame) -> DataFrame:
    """``host, container, fixed`` from ``host, slot, n, chars, least, most``: the node as :func:`container` on
    one page, and the constant slots below it, one a line."""
    held = slots.groupBy("host").agg(F.max("n").alias("held"))
    constant = (F.col("n") >= SAME) & (3 * F.col("n") >= 2 * F.col("held")) & (F.col("least") == F.col("most"))
    slots = slots.join(held, "host").withColumn("varying", F.when(constant, 0).otherwise(F.col("chars")))
    total = slots.groupBy("host").agg(F.sum("chars").alias("all"), F.sum("varying").alias("all_varying"))
    parts = F.split("slot", "/")
    step = F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    below = (
        slots.filter("slot <> ''")
        .select("host", "chars", "varying", step.alias("node"))
        .groupBy("host", "node")
        .agg(F.sum("chars").alias("chars"), F.sum("varying").alias("varying"))
    )
    # equal labels at several places are one article
    path, depth = F.regexp_replace("node", "/[0-9]+:", "/"), F.size(F.split("node", "/"))
    marked = below.filter(F.col("node").endswith("!article")).groupBy("host", path.alias("node")).agg(F.sum("chars").alias("chars"))
    marked = marked.join(total, "host").filter(F.col("chars") >= MARKED * F.col("all"))
    marked = marked.groupBy("host").agg(F.min(F.struct(depth.alias("depth"), (-F.col("chars")).alias("less"), "node"))["node"].alias("marked"))
    # more than half of the text lies on one way down only
    mass = F.when(F.col("all_varying") > 0, F.col("varying") >= DOWN * F.col("all_varying")).otherwise(F.col("chars") >= DOWN * F.col("all"))
    way = below.join(total, "host").filter(mass & ~F.col("node").rlike(r"/[0-9]+:(p|h1|li|td)(\.|/|$)"))
    way = way.groupBy("host").agg(F.max_by("node", F.struct(depth, "node")).alias("lowest"))
    chosen = total.join(marked, "host", "left").join(way, "host", "left").select(
        "host", F.coalesce("marked", "lowest", F.lit("")).alias("container")
    )
    at = F.when(F.col("container").rlike("/[0-9]+:"), F.col("slot")).otherwise(F.regexp_replace("slot", "/[0-9]+:", "/"))
    within = slots.join(chosen, "host").filter((at == F.col("container")) | at.startswith(F.concat("container", F.lit("/"))))
    # where pages are copies of each other, their own text is constant, too
    fixed = within.groupBy("host").agg(
        F.sum("chars").alias("chars"),
        F.sum("varying").alias("varying"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("varying") == 0, F.col("slot")))), "\n").alias("fixed"),
    )
    fixed = fixed.filter(2 * F.col("varying") >= F.col("chars")).select("host", "fixed")
    return chosen.join(fixed, "host", "left")


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper, models, labels, container, fixed, n_pages``: for each host its expression as JSON (see
    ``as_expression``), the expressions of its paths as a JSON object, the labels that recur, one a line,
    the wrapper node of the article, with places unless it is marked as such, and the constant slots below it,
    one a line. Pages without a host share the host ``""``."""
    ship(pages.sparkSession)
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    words = durable(rows.mapInArrow(_words, "host string, label string, n long").groupBy("host", "label").agg(F.sum("n").alias("n")))
    n_pages = words.filter("label = ''").select("host", F.col("n").alias("n_pages"))
    # words of single pages, as in the ids of headings, would make their paths and streams all different
    labels = words.join(n_pages, "host").filter(F.col("n") >= OFTEN * F.col("n_pages"))
    labels = labels.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("label")), "\n").alias("labels"))
    labels = durable(labels)
    level = durable(
        _known(rows, labels, "labels").mapInArrow(_streams, "host string, path string, what string, n long")
        .groupBy("host", "path", "what")
        .agg(F.sum("n").alias("n"))
    )
    often = level.groupBy("host", "path").agg(F.sum("n").alias("n")).join(n_pages, "host").filter(F.col("n") >= RARE * F.col("n_pages"))
    level = level.join(often.select("host", "path"), ["host", "path"], "left_semi")
    merge = F.udf(lambda found: merged([r["what"] for r in sorted(found, key=lambda r: (-r["n"], r["what"]))]), "string")
    while True:
        counts = level.groupBy("host", "path").agg(F.count("*").alias("different"))
        if (counts.agg(F.max("different")).first()[0] or 0) <= 1:
            break
        found = F.collect_list(F.struct("n", "what"))
        level = durable(
            level.join(counts, ["host", "path"])
            .groupBy("host", "path", F.pmod(F.xxhash64("what"), F.ceil(F.col("different") / FAN)).alias("bucket"))
            .agg(found.alias("found"), F.sum("n").alias("n"))
            .select("host", "path", F.when(F.size("found") == 1, F.col("found")[0]["what"]).otherwise(merge("found")).alias("what"), "n")
        )
    models = level.groupBy("host").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "what")))).alias("models"))
    models = durable(models.select("host", F.to_json("models").alias("models")).join(labels, "host"))
    slots = durable(
        _known(rows, models, "models", "labels")
        .mapInArrow(_slots, "host string, slot string, n long, chars long, least long, most long")
        .groupBy("host", "slot")
        .agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.min("least").alias("least"), F.max("most").alias("most"))
    )
    show = F.udf(lambda found: as_json(whole(json.loads(found))), "string")
    return durable(
        models.join(n_pages, "host")
        .join(_containers(slots), "host", "left")
        .select("host", show("models").alias("wrapper"), "models", "labels", F.coalesce("container", F.lit("")).alias("container"), F.coalesce("fixed", F.lit("")).alias("fixed"), "n_pages")
    )


def text_of(
    source: str,
    within: str,
    models: dict[str, str] | None = None,
    labels: frozenset | None = None,
    fixed: frozenset = frozenset(),
) -> str:
    """What the page's slots below the host's container hold, but for the constant ones; if this page lacks the
    container, the text below its own."""
    page = Page(source, labels)
    kept = [(slot, path, text) for slot, (path, out, text) in zip(page.slots(models or {}), page.blocks) if not out]
    prefix, found = f"{within}/", []
    if plain(within) != within:
        found = [(slot, text) for slot, _, text in kept if slot == within or slot.startswith(prefix)]
    if not found:
        within = plain(within)
        prefix = f"{within}/"
        found = [(slot, text) for slot, path, text in kept if path == within or path.startswith(prefix)]
    if not found and kept:
        own = container([(path, len(text)) for _, path, text in kept])
        found = [(slot, text) for slot, path, text in kept if path == own or path.startswith(f"{own}/")]
    return "\n".join(text for slot, text in found if slot not in fixed)


def extract(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text``: the main text of each page, its blocks joined by line feeds.

    A null html counts as empty and gives an empty text. Very long and very deep pages are read whole, in linear
    time. Null URLs share one wrapper. Broken markup is read
    as browsers do: a cut-off tag is dropped, missing end tags are implied. Repeated rows stay repeated;
    other columns play no part.
    """
    ship(pages.sparkSession)
    used = ("html", "container", "models", "labels", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                text_of(source or "", within or "", _models(models), _labels(labels), _labels(fixed))
                for source, within, models, labels, fixed in zip(*(batch.column(c).to_pylist() for c in used))
            ]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
        host_of(F.col(url_col)).alias("host"),
    )
    return (
        _known(rows, wrappers, "container", "models", "labels", "fixed")
        .select("page_id", "url", *used)
        .mapInArrow(run, "page_id long, url string, text string")
    )
