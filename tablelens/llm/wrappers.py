"""HTML extraction by wrappers: union-free regular expressions over the token streams of a host.

A page is a stream of tokens: tags (name and class, without other attributes)
and text slots; comments, scripts and styles are no tokens.  Within a page,
neighbouring copies of a token group fold into one repeated group.  What is
left, the page's skeleton, is a short string; pages of a host share few.

A host's wrapper starts as one skeleton and takes in the others one by one: the
streams are aligned, and every mismatch becomes an optional group, a repeated
group, or a text slot; two groups that meet are aligned inside.  Skeletons are
aligned in salted parts first and the parts' wrappers afterwards, so that a hot
host is no single task, and each distinct skeleton is aligned once however many
pages have it.

Every text slot of the wrapper has a role.  A slot inside navigation, page
headers, footers, sidebars, forms, adverts, notices or comments (by tag, class
or id words) is none of the main text.  If the page has text in an article (else
in a main element, else in an element marked as content), the slots inside it
are; each skeleton decides for itself, as a host may have several templates.
Otherwise they are all remaining slots but boilerplate: on hosts of ``MIN_PAGES``
or more pages, slots with one text on several pages whose other texts differ
(white space aside).  What a single page or only copies of a page hold stays.

A page's slots map to the wrapper's through its skeleton, and the texts of main
slots are joined: character references decoded, white space inside a block one
space, blocks joined by a newline in page order; inline tags and line breaks
stay inside their block.

Null html is empty and gives an empty text; so do pages without main text.
Null or odd URLs form the host "".  Unclosed and stray tags are allowed: a
closing tag ends everything open inside it, one without a start is skipped.
Repeated rows stay; other columns never matter.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import json
import operator
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelens.llm.common import stored
from tablelens.llm.url_filter import host_and_path

SALTS = 16
MIN_PAGES = 5
PERIOD = 24  # tokens of the longest group that is folded in one step
BROADCAST_ROWS = 100_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b)|\Z)|<(script|style|noscript|template|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?][^>]*>|<[/!?a-zA-Z][^<>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_OUT_TAGS = frozenset("nav header footer aside form button select option textarea dialog menu object canvas audio video".split())
_PLAIN = frozenset("html body article main header h1 h2 h3 h4 h5 h6".split())  # their class names say nothing
_OUT_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|alert|banner|breadcrumbs?|comments?|cookies?|consent|copyright|disclaimer|disqus|footer|gdpr|header|masthead|menu|modal|nav\w*|newsletter|notices?|notification|popup|promo\w*|related|replies|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|topbar|widget)(?:$|[\s_\d-])",
    re.IGNORECASE,
)
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story)(?:$|[\s_-])", re.IGNORECASE)


def tokens(source: str) -> tuple[list[str], list[str]]:
    """The token stream, text slots as ``#``, and the raw text of every slot.

    White space alone is no slot; it goes before the next slot's text, where it
    separates words of one block and vanishes at the start of another.
    """
    stream: list[str] = []
    texts: list[str] = []
    blank = ""

    def text(piece: str) -> None:
        nonlocal blank
        if piece.isspace():
            blank = " "
        elif piece:
            stream.append("#")
            texts.append(blank + piece)
            blank = ""

    at, open_tags = 0, []
    for m in _TOKEN.finditer(source):
        text(source[at : m.start()])
        at = m.end()
        name = (m.group(3) or "").lower()
        if not name:
            continue
        if m.group(2):
            if name not in open_tags:
                continue
            while open_tags:  # what is open inside ends with it
                last = open_tags.pop()
                stream.append(f"</{last}>")
                if last == name:
                    break
            continue
        if name == "p" and "p" in open_tags and not any(t in _OUT_TAGS or t in ("article", "div", "section", "main", "td", "li", "blockquote") for t in open_tags[len(open_tags) - open_tags[::-1].index("p") :]):
            while True:  # a paragraph ends the paragraph before
                last = open_tags.pop()
                stream.append(f"</{last}>")
                if last == "p":
                    break
        marks = " ".join(x for found in _MARK.findall(m.group(4) or "") for x in found if x)
        stream.append(f"<{name} {re.sub(r'[0-9]+', '0', marks)}>" if marks else f"<{name}>")
        if name not in _VOID and not (m.group(4) or "").endswith("/"):
            open_tags.append(name)
    text(source[at:])
    stream += [f"</{t}>" for t in reversed(open_tags)]
    return stream, texts


# A pattern is a list of items: a token, ["+", pattern] (one or more) or ["?", pattern].


def fold(stream: list[str]) -> tuple[list, list[int]]:
    """Fold neighbouring copies; also the pattern's slot number of every text of the stream."""
    count = 0
    items: list = []  # item, its name, the texts of each of its slots
    for token in stream:
        if token == "#":
            items.append((token, token, [[count]]))
            count += 1
        else:
            items.append((token, token, []))
    for period in range(1, PERIOD + 1):
        n = len(items)
        if n < 2 * period:
            break
        names = [i[1] for i in items]
        if not any(map(operator.eq, names, names[period:])):
            continue
        out: list = []
        at = 0
        while at < n:
            end = at + period
            if end >= n or names[at] != names[end]:
                out.append(items[at])
                at += 1
                continue
            while names[end : end + period] == names[at : at + period] and end + period <= n:
                end += period
            body = [i[0] for i in items[at : at + period]]
            if end - at > period and (period == 1 or _balanced(body)) and not (period == 1 and body[0] != "#" and isinstance(body[0], str)):
                merged = [sum((items[at + c + k][2][s] for c in range(0, end - at, period)), []) for k in range(period) for s in range(len(items[at + k][2]))]
                out.append((["+", body], "(" + " ".join(names[at : at + period]) + ")+", merged))
                at = end
            else:
                out.append(items[at])
                at += 1
        items = out
    owner = {}
    number = 0
    for _, _, own in items:
        for texts in own:
            for t in texts:
                owner[t] = number
            number += 1
    return [i[0] for i in items], [owner[t] for t in range(count)]


def _balanced(body: list) -> bool:
    """Whether a group opens and closes its own elements."""
    depth = 0
    for item in body:
        if isinstance(item, str) and item != "#":
            name = item.strip("</>").split(" ")[0]
            if item.startswith("</"):
                depth -= 1
                if depth < 0:
                    return False
            elif name not in _VOID:
                depth += 1
    return depth == 0


def _meet(a, b) -> bool:
    """Whether two items can be one item of the wrapper."""
    if isinstance(a, list) and isinstance(b, list):
        return _head(a) == _head(b)
    if isinstance(a, list) or isinstance(b, list):
        return False
    return a == b


def _head(item) -> str:
    while isinstance(item, list):
        item = item[1][0]
    return item


def align(wrapper: list, page: list) -> list[tuple[int | None, int | None]]:
    """Pairs of item places (None: only in the other), by the longest common subsequence."""
    low = 0
    while low < min(len(wrapper), len(page)) and wrapper[low] == page[low]:
        low += 1
    a, b = wrapper[low:], page[low:]
    high = 0
    while high < min(len(a), len(b)) and a[len(a) - 1 - high] == b[len(b) - 1 - high]:
        high += 1
    n, m = len(a) - high, len(b) - high
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _meet(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    pairs: list[tuple[int | None, int | None]] = [(k, k) for k in range(low)]
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and _meet(a[i], b[j]):
            pairs.append((low + i, low + j))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            pairs.append((low + i, None))
            i += 1
        else:
            pairs.append((None, low + j))
            j += 1
    return pairs + [(low + n + k, low + m + k) for k in range(high)]


def slots_in(item) -> int:
    return (item == "#") if isinstance(item, str) else sum(slots_in(i) for i in item[1])


def generalise(wrapper: list, page: list) -> tuple[list, list[int], list[int]]:
    """The wrapper that takes in both, and where the slots of each are in it."""
    out: list = []
    mine: list[int] = []
    theirs: list[int] = []
    base = 0

    def optional(group: list, to: list[int]) -> None:
        nonlocal base
        whole = group[0] if len(group) == 1 and isinstance(group[0], list) and group[0][0] == "?" else ["?", group]
        out.append(whole)
        n = slots_in(whole)
        to.extend(range(base, base + n))
        base += n

    left: list = []
    right: list = []

    def flush() -> None:
        for group, to in ((left, mine), (right, theirs)):
            if group:
                optional(list(group), to)
                group.clear()

    for i, j in align(wrapper, page):
        if j is None:
            left.append(wrapper[i])
        elif i is None:
            right.append(page[j])
        else:
            flush()
            a, b = wrapper[i], page[j]
            if a == b:
                n = slots_in(a)
                out.append(a)
                mine.extend(range(base, base + n))
                theirs.extend(range(base, base + n))
            else:
                inner, x, y = generalise(a[1], b[1])
                out.append(["+" if "+" in (a[0], b[0]) else "?", inner] if a[0] == b[0] else ["?", [["+", inner]]])
                n = slots_in(out[-1])
                mine.extend(base + s for s in x)
                theirs.extend(base + s for s in y)
            base += n
    flush()
    return out, mine, theirs


def infer(patterns: list[list]) -> tuple[list, list[list[int]]]:
    """One wrapper for all patterns, and the wrapper slot of every slot of each pattern."""
    wrapper, maps = patterns[0], [list(range(sum(map(slots_in, patterns[0]))))]
    for pattern in patterns[1:]:
        wrapper, mine, theirs = generalise(wrapper, pattern)
        maps = [[mine[s] for s in m] for m in maps] + [theirs]
    return wrapper, maps


def slot_paths(pattern: list) -> list[tuple[str, ...]]:
    """The open tags around every text slot."""
    paths: list[tuple[str, ...]] = []
    stack: list[str] = []

    def walk(items: list) -> None:
        for item in items:
            if isinstance(item, list):
                walk(item[1])
            elif item == "#":
                paths.append(tuple(stack))
            elif item.startswith("</"):
                name = item[2:-1]
                if name in [t[1:-1].split(" ")[0] for t in stack]:
                    while stack and stack.pop()[1:-1].split(" ")[0] != name:
                        pass
            elif item[1:-1].split(" ")[0] not in _VOID:
                stack.append(item)

    walk(pattern)
    return paths


def _named(tag: str) -> tuple[str, str]:
    name, _, marks = tag[1:-1].partition(" ")
    return name, marks


def clean_slots(paths: list[tuple[str, ...]]) -> list[bool]:
    """Which slots lie outside navigation, adverts and the like."""

    def out(path: tuple[str, ...]) -> bool:
        inside = False
        for name, marks in map(_named, path):
            inside = inside or name == "article"
            # an article's own header holds its title
            if name in _OUT_TAGS and not (name == "header" and inside) or marks and name not in _PLAIN and _OUT_WORDS.search(marks):
                return True
        return False

    return [not out(p) for p in paths]


def contained_slots(pattern: list) -> tuple[list[bool], bool]:
    """The clean slots in the container of a page (all clean ones if it has none), and whether it has one."""
    paths = slot_paths(pattern)
    clean = clean_slots(paths)
    for test in (lambda n, m: n == "article", lambda n, m: n == "main" or m == "main", lambda n, m: n in ("div", "section", "td") and bool(_CONTENT.search(m))):
        inside = [c and any(test(*_named(t)) for t in p) for c, p in zip(clean, paths)]
        if any(inside):
            return inside, True
    return clean, False


def boilerplate_slots(pages: int, least: list, most: list, first: list, last: list) -> list[bool]:
    """Slots with one text on pages of more than one body."""
    return [pages >= MIN_PAGES and a == b and c != d for a, b, c, d in zip(least, most, first, last)]


def page_blocks(stream: list[str], texts: list[str], keep: list[bool]) -> str:
    """The kept texts, by blocks: any tag that is not inline ends a block."""
    blocks: list[list[str]] = [[]]
    text = 0
    for token in stream:
        if token == "#":
            if keep[text]:
                blocks[-1].append(texts[text])
            elif texts[text][0].isspace() or texts[text][-1].isspace():
                blocks[-1].append(" ")  # the blank around what is left out
            text += 1
        else:
            name = token.strip("</>").split(" ")[0]
            if name == "br":
                blocks[-1].append(" ")
            elif name not in _INLINE and blocks[-1]:
                blocks.append([])
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def skeleton(source: str) -> tuple[str, list[int], list[str], list[str]]:
    """Skeleton text, its slot of every text, the stream and the texts of one page."""
    stream, texts = tokens(source)
    text, owner = _folded(tuple(stream))
    return text, owner, stream, texts


@functools.lru_cache(maxsize=4096)
def _folded(stream: tuple[str, ...]) -> tuple[str, list[int]]:
    pattern, owner = fold(list(stream))
    return json.dumps(pattern, ensure_ascii=False, separators=(",", ":")), owner


@functools.lru_cache(maxsize=4096)
def _clean(text: str) -> list[bool]:
    return clean_slots(slot_paths(json.loads(text)))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _slot_texts(owner: list[int], texts: list[str], clean: list[bool]) -> tuple[list[int], int]:
    """A hash of the texts in every slot, and one of the page's body: the texts of all clean slots."""
    found: list[list[str]] = [[] for _ in clean]
    for s, t in zip(owner, texts):
        found[s].append(" ".join(t.split()))
    return [_hash("\x00".join(f)) for f in found], _hash("\x00".join(" ".join(t.split()) for s, t in zip(owner, texts) if clean[s]))


_SPANS = ("least", "most", "first", "last")


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct (host, skeleton) of a task: pages, the least and greatest text hash of every slot, and those of the bodies of the pages that hold it."""
    seen: dict[tuple[str, str], list] = {}
    slots = 0

    def rows() -> pa.RecordBatch:
        keys = list(seen)
        spans = [pa.array([seen[k][i] for k in keys], pa.list_(pa.int64())) for i in (1, 2)]
        spans += [pa.array([[seen[k][i]] * len(seen[k][1]) for k in keys], pa.list_(pa.int64())) for i in (3, 4)]
        out = pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.string()), pa.array([seen[k][0] for k in keys]), *spans], names=["host", "skeleton", "pages", *_SPANS])
        seen.clear()
        return out

    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text, owner, _, texts = skeleton(source)
            now, body = _slot_texts(owner, texts, _clean(text))
            have = seen.get((host, text))
            if have is None:
                seen[host, text] = [1, now, now, body, body]
                slots += len(now)
            else:
                have[0] += 1
                have[1:] = list(map(min, have[1], now)), list(map(max, have[2], now)), min(have[3], body), max(have[4], body)
            if len(seen) >= 20_000 or slots >= 500_000:
                slots = 0
                yield rows()
    if seen:
        yield rows()


def _merge(rows: pd.DataFrame, patterns: list[list]) -> tuple[list, int, list[list]]:
    """Infer one wrapper and bring page counts and hashes of its slots together."""
    wrapper, maps = infer(patterns)
    n = sum(map(slots_in, wrapper))
    spans = []
    for name, pick in zip(_SPANS, (min, max, min, max)):
        span: list = [None] * n
        for places, values in zip(maps, rows[name]):
            for place, v in zip(places, values):
                span[place] = v if span[place] is None else pick(span[place], v)
        spans.append(span)
    return wrapper, int(rows["pages"].sum()), spans


def _wrap(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("skeleton")
    patterns = {s: json.loads(s) for s in rows["skeleton"].unique()}
    wrapper, pages, spans = _merge(rows, [patterns[s] for s in rows["skeleton"]])
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "skeleton": [json.dumps(wrapper, ensure_ascii=False, separators=(",", ":"))], "pages": [pages], **{n: [s] for n, s in zip(_SPANS, spans)}})


_WRAPPER = "host string, skeleton string, pages long, " + ", ".join(f"{n} array<long>" for n in _SPANS)


def host_wrappers(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(distinct skeletons, one wrapper per host)."""
    seen = stored(pages.select(host_col, html_col).mapInArrow(_skeletons, _WRAPPER), "skeletons")
    parts = seen.withColumn("salt", F.pmod(F.xxhash64("skeleton"), F.lit(SALTS))).groupBy("host", "salt").applyInPandas(_wrap, _WRAPPER)
    return seen, stored(parts.groupBy("host").applyInPandas(_wrap, _WRAPPER), "wrappers")


def _roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every skeleton, which of its slots hold main text: by its own container, else by its host's wrapper."""
    known: dict[str, tuple[list, list[bool]]] = {}
    for batch in batches:
        bits = []
        for host, text, wrapper, pages, *spans in zip(*(c.to_pylist() for c in batch.columns)):
            pattern = json.loads(text)
            main, settled = contained_slots(pattern)
            if not settled and pages >= MIN_PAGES:
                if host not in known:
                    known.clear()
                    known[host] = json.loads(wrapper), boilerplate_slots(pages, *spans)
                items, boilerplate = known[host]
                _, mine, theirs = generalise(items, pattern)
                back = {place: slot for slot, place in enumerate(mine)}
                main = [m and not (p in back and boilerplate[back[p]]) for m, p in zip(main, theirs)]
            bits.append("".join("1" if m else "0" for m in main))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.string())], names=["host", "skeleton", "main"])


def slot_roles(pages: DataFrame) -> DataFrame:
    """host, mark (a hash of the skeleton), main (one digit per slot of the skeleton)."""
    seen, wrappers = host_wrappers(pages)
    met = seen.select("host", "skeleton").distinct().join(wrappers.withColumnRenamed("skeleton", "wrapper"), "host")
    roles = met.select("host", "skeleton", "wrapper", "pages", *_SPANS).mapInArrow(_roles, "host string, skeleton string, main string")
    return stored(roles.select("host", "skeleton", "main"), "roles")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Id, url and main text of every page."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_and_path(url)[0].alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    roles = slot_roles(rows)
    bulk = roles.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("skeleton")), F.lit(0))).first()
    kind = rows.schema["id"].dataType.simpleString()
    if bulk[0] <= BROADCAST_ROWS and bulk[1] <= 1 << 26:
        table = {(r["host"], r["skeleton"]): r["main"] for r in roles.toLocalIterator()}  # size checked above
        held = rows.sparkSession.sparkContext.broadcast(table)
        return rows.mapInArrow(_texts(lambda host, text, _: held.value[host, text]), f"id {kind}, url string, text string").withColumnRenamed("id", id_col)
    # too many roles to send to every task: pages meet theirs in a shuffle
    named = rows.mapInArrow(_name, f"id {kind}, url string, host string, html string, skeleton string")
    met = named.join(roles, ["host", "skeleton"]).select("id", "url", "host", "html", "main")
    return met.mapInArrow(_texts(lambda host, text, main: main), f"id {kind}, url string, text string").withColumnRenamed("id", id_col)


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = pa.array([skeleton(h)[0] for h in batch.column(3).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, names], names=["id", "url", "host", "html", "skeleton"])


def _texts(role):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            mains = batch.column(4).to_pylist() if batch.num_columns > 4 else [None] * batch.num_rows
            for host, source, main in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), mains):
                text, owner, stream, texts = skeleton(source)
                bits = role(host, text, main)
                out.append(page_blocks(stream, texts, [bits[s] == "1" for s in owner]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])

    return work


def pages_table(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
