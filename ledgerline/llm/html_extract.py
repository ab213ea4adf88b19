"""Main text of web pages by wrapper inference: union-free regular expressions over the token streams of a host's pages.

A page's tokens are its block tags, balanced, with the text between them. The first page of a host is its wrapper; every
further page is aligned with it. Where both have the same tag they go on inside; text that differs becomes a slot, what
only one side has becomes optional, and neighbours (or sequences of neighbours) of one kind become a repeated
group. Aligning is associative enough to be done on parts: each task aligns its pages of a host, then the few wrappers of
a host are aligned in two rounds, so a hot host never meets in one task as pages.

The wrapper decides what is text of the page: its slots are fields. Text that at least ``SAME`` different pages of the
host have in one place is no field, wherever it stands, an article included (its ``h1`` excepted, for near copies of a page
share it); with fewer pages nothing tells what is constant, and all is a field. Slots within menus, headers, footers,
sidebars, notices, adverts, forms and comments, told by tag or by words of class, id and role, are no fields either. A
field's rank is 2 in an article, 1 in main, else 0. A page is read by the fields of its host: by those of the highest rank
that hold at least ``NAMED_PART`` of the text of all its fields, so pages of several templates of a host are read each by
what it has. A page of a
rarer layout, which has more text at places that the host's wrapper lacks than at its fields, is read by the fields of its
own wrapper too.

Defined results. A null or empty page has the text ''. A null url belongs to the host ''. Repeated rows each get their
row and count once for the wrapper. Tags that are never closed end with what holds them; they may be nested to any depth.
Empty tables give empty tables. Extra columns pass through; ``host`` and ``main_text`` replace columns of those names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Generator, Iterable, Iterator
from difflib import SequenceMatcher
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm._common import bound_batches, scratch, table

HOST = r"(?s)^.*?://([^/?#]*)"
#: Names of HTML elements.
BLOCKS = frozenset("html body head article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address hr details summary dialog menu hgroup search center button select label legend".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object audio video canvas option".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("html body head button label legend td th tr thead tbody tfoot caption".split())
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
NEVER = frozenset("head nav footer aside form dialog menu button select label legend search".split())
#: Words of class, id or role that name menus, headers, footers, sidebars, notices, adverts and reader comments.
ASIDE = frozenset("menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead footer contentinfo sidebar complementary cookie cookies consent notice notices alert popup modal overlay ad ads advert adverts advertisement banner promo sponsor sponsored comment comments disqus respond replies".split())
#: Different pages that must have a text in one place for it to be the host's and not theirs.
SAME = 3
#: The least part of a page's fields that an article or main element must hold to be what is read.
NAMED_PART = 0.25
#: Wrappers that a task holds before it passes them on.
HELD = 2000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?][^>]*>|[^<]+|<""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LETTERS = re.compile(r"[A-Za-z]+")


def sign(tag: str, attributes: str) -> str:
    """An element's kind: its tag and the words, without numbers, of class, id and role."""
    if not attributes or "=" not in attributes:
        return tag
    words = {w.lower() for m in NAMED.finditer(attributes) for w in LETTERS.findall(m[2] or m[3] or m[4] or "")}
    return ".".join([tag, *sorted(words)])


def blocks(html: str | None) -> Iterator[tuple[str, str | None]]:
    """The balanced token stream: (kind, None) opens, ("", None) closes, ("#", text) is a block's text."""
    html = html or ""
    open_: list[str] = []
    text: list[str] = []
    at = 0

    def said() -> Iterator[tuple[str, str]]:
        whole = " ".join(unescape("".join(text)).split())
        text.clear()
        if whole:
            yield "#", whole

    while (m := TOKEN.match(html, at)) is not None:
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                text.append(m[0])
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag not in BLOCKS:
            if tag in VOID:
                text.append(" ")
            continue
        if m[1]:
            if tag in open_:
                yield from said()
                while open_.pop() != tag:
                    yield "", None
                yield "", None
            continue
        yield from said()
        ends = ENDED_BY.get(tag, ()) + (("p",) if tag in ENDS_PARAGRAPH else ())
        while open_ and open_[-1] in ends:
            open_.pop()
            yield "", None
        yield sign(tag, m[3]), None
        if tag in VOID or m[3].endswith("/"):
            yield "", None
        else:
            open_.append(tag)
    yield from said()
    for _ in open_:
        yield "", None


# A wrapper's node is a list. Element: [kind, repeated, optional, children]. Text: ["#", optional, mark of the text or
# None for a slot, characters, marks of pages that have it (at most SAME)]. Sequence of neighbours that repeats:
# ["()", True, optional, children]. A root is ["", whether pages differ, False, children].


def tree(html: str | None) -> list:
    """A page's own wrapper."""
    return grown(blocks(html), zlib.crc32((html or "").encode()))


def grown(stream: Iterable[tuple[str, str | None]], page: int = 0) -> list:
    """The wrapper of one page's token stream."""
    root: list = ["", False, False, []]
    stack = [root]
    for kind, text in stream:
        if kind == "#":
            stack[-1][3].append(["#", False, f"{zlib.crc32(text.encode()):x}.{len(text)}", len(text), [page]])
        elif kind:
            node = [kind, False, False, []]
            stack[-1][3].append(node)
            stack.append(node)
        else:
            done = stack.pop()
            done[3] = run(folded(done[3]))
    while len(stack) > 1:
        done = stack.pop()
        done[3] = run(folded(done[3]))
    root[3] = run(folded(root[3]))
    return root


def run(step: Generator) -> list:
    """The result of a generator that yields the generators whose results it waits for: recursion of any depth."""
    stack, value = [step], None
    while stack:
        try:
            step, value = stack[-1].send(value), None
            stack.append(step)
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def aligned(a: list, b: list) -> Generator:
    """The wrapper of what two nodes of one kind match."""
    if a[0] == "#":
        return ["#", a[1] or b[1], a[2] if a[2] == b[2] else None, a[3] + b[3], sorted({*a[4], *b[4]})[:SAME]]
    return [a[0], a[1] or b[1], a[2] or b[2], (yield together(a[3], b[3]))]


def host_aligned(a: list, b: list) -> list:
    """The wrapper of two wrappers of a host."""
    return run(aligned(a, b))


def optional(node: list) -> list:
    return ["#", True, *node[2:]] if node[0] == "#" else [node[0], node[1], True, node[3]]


def shape(node: list) -> str:
    return node[0] if node[0] != "()" else "(" + " ".join(shape(c) for c in node[3]) + ")"


def together(xs: list, ys: list) -> Generator:
    """Children of both: the same ones aligned, the others optional."""
    for have, other in ((xs, ys), (ys, xs)):
        for group in [n for n in have if n[0] == "()"]:
            kinds = [shape(c) for c in group[3]]
            if shape(group) not in [shape(n) for n in other]:
                other[:] = yield gathered(other, kinds, 1)
    a, b = [shape(n) for n in xs], [shape(n) for n in ys]
    out = []
    same = [("equal", 0, len(a), 0, len(b))] if a == b else SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    for what, i, j, k, m in same:
        if what == "equal":
            for x, y in zip(xs[i:j], ys[k:m], strict=True):
                out.append((yield aligned(x, y)))
        else:
            out += [optional(n) for n in xs[i:j]] + [optional(n) for n in ys[k:m]]
    return out if a == b else (yield folded(out))


def gathered(nodes: list, kinds: list[str], least: int) -> Generator:
    """Runs of at least ``least`` occurrences of a sequence of kinds become one repeated group."""
    out, i, n = [], 0, len(kinds)
    shapes = [shape(x) for x in nodes]
    while i < len(nodes):
        group, times, j = None, 0, i
        while shapes[j : j + n] == kinds:
            part = nodes[j : j + n]
            if group is None:
                group = part
            else:
                for k in range(n):
                    group[k] = yield aligned(group[k], part[k])
            times, j = times + 1, j + n
        if times >= least:
            out.append(["()", True, False, group])
            i = j
        else:
            out.append(nodes[i])
            i += 1
    return out


def folded(nodes: list) -> Generator:
    """Neighbours of one kind, then sequences of kinds that repeat, become repeated groups."""
    out: list = []
    for node in nodes:
        if out and out[-1][0] == node[0] and node[0] not in ("()", "#"):
            out[-1] = yield aligned(out[-1], node)
            out[-1][1] = True
        elif out and node[0] == "()" and shape(out[-1]) == shape(node):
            out[-1] = yield aligned(out[-1], node)
        else:
            out.append(node)
    n = 2
    while 2 * n <= len(out):
        shapes = [shape(x) for x in out]
        number = {x: k for k, x in enumerate(shapes)}
        code = np.array([number[x] for x in shapes])
        # a place from which n neighbours are the same as the n after them
        same = np.append(0, np.cumsum(code[:-n] == code[n:]))
        at = np.flatnonzero(same[n:] - same[:-n] == n)
        if len(at):
            out = yield gathered(out, shapes[at[0] : at[0] + n], 2)
        else:
            n += 1
    return out


def pattern(node: list) -> str:
    """The wrapper as a regular expression, for people."""
    if node[0] == "#":
        inner, repeated, opt = "#text" if node[2] is None else "'text'", False, node[1]
    else:
        inner, repeated, opt = " ".join(pattern(c) for c in node[3]), node[0] and node[1], node[0] and node[2]
        inner = inner if node[0] in ("", "()") else f"<{node[0]}> {inner} </>"
    return f"({inner})" + "+" * bool(repeated) + "?" * opt if repeated or opt else inner


def written(node: list) -> str:
    """A wrapper as JSON, flat, however deep it is."""
    flat: list = []
    waiting: list = [node]
    while waiting:
        n = waiting.pop()
        if n is None or n[0] == "#":
            flat.append(n)
        else:
            flat.append(n[:3])
            waiting.append(None)
            waiting += reversed(n[3])
    return json.dumps(flat, separators=(",", ":"))


def reread(text: str) -> list:
    """The wrapper that was written."""
    top: list = ["", False, False, []]
    stack = [top]
    for n in json.loads(text):
        if n is None:
            stack.pop()
            continue
        stack[-1][3].append(n)
        if n[0] != "#":
            n.append([])
            stack.append(n)
    return top[3][0]


def is_aside(kind: str, inside: bool) -> bool:
    tag, *words = kind.split(".")
    return tag in NEVER or (tag == "header" and not inside) or any(w in ASIDE for w in words)


RANKS = {"article": 2, "main": 1}


def below(path: int, kind: str) -> int:
    """The number of the path of an element of this kind."""
    return ((path ^ zlib.crc32(kind.encode())) * 0x9E3779B97F4A7C15 + (path >> 29)) % (1 << 62)


def fields(wrapper: list) -> dict[int, int]:
    """Paths of a wrapper's texts with their ranks; the rank is -1 where the host's pages all have the same."""
    ranks: dict[int, int] = {}
    waiting: list = [(wrapper, 0, 0, "")]
    while waiting:
        node, path, rank, tag = waiting.pop()
        for child in node[3]:
            if child[0] == "#":
                slot = child[2] is None or len(child[4]) < SAME or tag == "h1"
                ranks[path] = max(ranks.get(path, -1), rank if slot else -1)
            elif child[0] == "()":
                waiting.append((child, path, rank, tag))
            elif not is_aside(child[0], rank > 0):
                tag_ = child[0].split(".")[0]
                waiting.append((child, below(path, child[0]), max(rank, RANKS.get(tag_, 0)), tag_))
    return ranks


def read(stream: Iterable[tuple[str, str | None]], wanted: dict[int, int]) -> tuple[str, int]:
    """The blocks at the wanted paths, in page order, of the highest rank that holds enough; and the characters of blocks
    at other paths."""
    path, found, other = [0], [], 0
    for kind, text in stream:
        if kind == "#":
            rank = wanted.get(path[-1])
            if rank is None:
                other += len(text)
            elif rank >= 0:
                found.append((rank, text))
        elif kind:
            path.append(below(path[-1], kind))
        else:
            path.pop()
    whole = sum(len(t) for _, t in found)
    for rank in sorted({r for r, _ in found}, reverse=True):
        own = [t for r, t in found if r >= rank]
        if sum(map(len, own)) >= NAMED_PART * whole:
            return "\n".join(own), other
    return "", other


def main_text(html: str | None, wanted: dict[int, int]) -> str:
    """A page's text by its host's fields; where that is less than what the page has at paths that its host's wrapper
    lacks, by those of its own wrapper too."""
    if not html:
        return ""
    stream = list(blocks(html))
    text, other = read(stream, wanted)
    if len(text) >= other:
        return text
    own = fields(grown(stream))
    lacking = read(stream, {k: v for k, v in own.items() if k not in wanted})[0]
    return read(stream, own | wanted)[0] if len(lacking) > len(text) else text


def _host(url):
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


WRAPPER = "host string, part long, wrapper string"


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per host: its wrapper as JSON, aligned over all of its pages."""

    def of_pages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        seen: set[tuple[str, int]] = set()

        def told() -> pd.DataFrame:
            made = [(h, written(w)) for h, w in held.items()]
            return pd.DataFrame([(h, zlib.crc32(f"{h} {w}".encode()) % 32, w) for h, w in made], columns=["host", "part", "wrapper"])

        for rows in parts:
            for host, page in zip(rows["host"], rows["html"], strict=True):
                mark = host, zlib.crc32((page or "").encode())
                if mark not in seen:
                    seen.add(mark)
                    held[host] = host_aligned(held[host], tree(page)) if host in held else tree(page)
            if len(held) > HELD:
                yield told()
                held.clear()
                seen.clear()
        yield told()

    def of_wrappers(part: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for w in sorted(part["wrapper"]):
            whole = reread(w) if whole is None else host_aligned(whole, reread(w))
        return pd.DataFrame([(part["host"].iat[0], 0, written(whole))], columns=["host", "part", "wrapper"])

    bound_batches(pages.sparkSession)
    rows = pages.select(_host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    made = rows.mapInPandas(of_pages, WRAPPER).groupBy("host", "part").applyInPandas(of_wrappers, WRAPPER)
    return made.groupBy("host").applyInPandas(of_wrappers, WRAPPER).select("host", "wrapper")


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``host`` and ``main_text``."""
    spark = pages.sparkSession
    bound_batches(spark)
    wanted = F.pandas_udf(_fields, "array<struct<path:long,rank:int>>")
    path = scratch(spark, "fields")
    infer(pages, url, html).select("host", wanted("wrapper").alias("_fields")).write.parquet(path)
    plans = spark.read.parquet(path).withColumnRenamed("host", "_host")  # its size decides how Spark joins it
    text = F.pandas_udf(_main_text, "string")
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "main_text")]
    rows = pages.select(F.struct(*rest).alias("_row"), F.col(f"`{html}`").alias("_html"), _host(F.col(f"`{url}`")).alias("host"))
    joined = rows.join(plans, rows.host == plans._host, "left")
    return joined.select("_row.*", "host", text("_html", "_fields").alias("main_text"))


def _fields(wrappers: pd.Series) -> pd.Series:
    return wrappers.map(lambda w: [{"path": p, "rank": r} for p, r in sorted(fields(reread(w)).items())])


def _main_text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, wanted in parts:
        yield pd.Series([main_text(p, {f["path"]: f["rank"] for f in w} if w is not None else {}) for p, w in zip(pages, wanted, strict=True)], dtype=object)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
