"""Main text of web pages by template deduction from equivalence classes of page tokens.

1. A page's tokens are its elements, told apart by the path of tags and classes that leads to them, and
   its units of text, told apart by that path too (a block, a whole list, a table within an article).
   Scripts, styles, comments and controls are no tokens.
2. Pages of one host with the same units are copies and count once. Over the distinct pages of a host, a
   token's occurrence vector is how often each page has it, held as the XOR of one hash for each page and count.
3. Tokens of one host that share a vector are an equivalence class. A class is valid if at least half of
   the host's distinct pages have it and its texts, if some, are on two pages at least and keep their order.
   Classes nest by path: the elements that pages have once make a tree of slots, the texts fill some of them.
4. The article is the slot where the pages differ most: from the whole page on, the template is descended as
   long as one inner slot holds three quarters of the text that is neither a class's nor a link's. Names
   label slots: article and main weigh more, text under a menu, footer, advert and the like weighs nothing.
5. What a page has in that slot is extracted, without the template's texts there (unless those make up most
   of it: then its pages are versions of one text) and without what names mark as no part of an article.
   A page that lacks the slot is its own template.
"""

from __future__ import annotations

import hashlib
import html as entities
import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, hide, map_arrow

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements without content (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text before and after them (fixed values of HTML).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without text of an article, wherever they are.
CONTROLS = frozenset("nav footer button select option head noscript menu dialog label input datalist".split())
#: Elements that hold no part of an article around them.
BOILERPLATE = frozenset("aside form fieldset header".split())
#: Words of a class, id or role that mark a region as no part of an article, also within one.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "cookie cookies consent gdpr popup subscribe newsletter signup login share sharing social related recommended comment comments disqus reply replies "
    "respond pagination pager".split()
)
#: Words that do so outside of articles.
OUTER_MARKS = MARKS | frozenset("banner side widget header masthead footer foot notice notices alert modal overlay search discussion form toolbar copyright".split())
#: Words that say nothing about what a region is.
FILLERS = frozenset(
    "area articles bar block body bottom box button buttons container content group inner item items left link links list main outer page panel posts right section site slot stories thread top unit wrap wrapper".split()
)
#: Elements that a p start tag, or any block, closes (fixed values of HTML).
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ARTICLE = frozenset(("article", "main"))
#: Elements that are one unit with all their items.
LISTS = frozenset(("ul", "ol", "dl"))
#: Elements that can be a slot of a template.
REGIONS = frozenset("body main article section div td center form aside header".split())
#: How much more the text of an element named as an article weighs, and the share of text for which a slot is entered.
NAMED, ENTER = 8, 0.75
#: Two articles of a host may quote the same text; what more of its pages have, or all of them, may be its template's.
LEAST_ON = 3


class Tag:
    """A tag: its name, whether it closes, its label in paths, and what its name and marks say."""

    __slots__ = ("article", "closing", "label", "marked", "name", "outer")

    def __init__(self, name: str, closing: bool, attributes: str):
        self.name, self.closing = name.lower(), closing
        shown, words, roles = [], [], []
        hidden = False
        if attributes and not closing:
            for m in _ATTRIBUTE.finditer(attributes):
                kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower().split()
                hidden |= kind == "hidden"
                words += value
                if kind == "class":
                    shown += value
                elif kind == "role":
                    roles += value
        self.label = self.name if self.name == "body" else ".".join([self.name, *sorted(shown)])
        whole = self.name not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "body")
        self.marked = hidden or self.name in BOILERPLATE - {"header"} or whole and any(_marks(w, MARKS) for w in words)
        self.outer = self.marked and self.name not in ("form", "fieldset") or self.name == "header" or whole and any(_marks(w, OUTER_MARKS) for w in words)
        self.article = not self.outer and (self.name in ARTICLE or "main" in roles or "article" in roles)


def _marks(word: str, marks: frozenset[str]) -> bool:
    """Whether a class is a mark, or marks and words that say nothing."""
    parts = [x for x in re.split(r"[_:/-]+", word) if x]
    return any(x in marks for x in parts) and all(x in marks or x in FILLERS or re.fullmatch(r"\d+(x\d+)?", x) for x in parts)


_TAGS: dict[str, Tag] = {}


def _tag(m: re.Match) -> Tag:
    known = _TAGS.get(m[0])
    if known is None:
        known = Tag(m[3], bool(m[2]), m[4])
        if len(m[0]) <= 200:
            if len(_TAGS) >= 20_000:
                _TAGS.clear()
            _TAGS[m[0]] = known
    return known


def host(url: str = "url") -> Column:
    """The host of a column's addresses in lower case, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


_PATHS: dict[tuple[int, str], int] = {}


def path_of(parent: int, label: str) -> int:
    """The number of the path that leads from a path to an element of this label."""
    known = _PATHS.get((parent, label))
    if known is None:
        if len(_PATHS) >= 50_000:
            _PATHS.clear()
        known = _PATHS[parent, label] = _hash(parent.to_bytes(8, "big", signed=True) + label.encode("utf-8", "replace"))
    return known


class Element:
    """A path of one page: its parent's path, how often it is there, units before it, units in it, and their weight."""

    __slots__ = ("article", "count", "parent", "place", "units", "weight")

    def __init__(self, parent: int, place: int, article: bool):
        self.parent, self.place, self.article = parent, place, article
        self.count = self.units = self.weight = 0


class Unit:
    """Text of a page: its blocks, the paths it lies in (0 first, the page), and how many of those lie around the innermost
    element that is marked, and marked outside of articles (0: none is)."""

    __slots__ = ("blocks", "chain", "heading", "key", "marked", "outer", "weight")


class _Open:
    """An open element and what holds for text in it."""

    __slots__ = ("article", "chain", "heading", "link", "marked", "name", "outer", "skip", "whole")


def parse(page: str | None) -> tuple[list[Unit], dict[int, Element]]:
    """Units of the page in order, and its paths."""
    units: list[Unit] = []
    elements = {0: Element(0, 0, False)}
    elements[0].count = 1
    root = _Open()
    root.name, root.chain, root.marked, root.outer = "", (0,), 0, 0
    root.skip = root.link = root.heading = root.article = False
    root.whole = None
    stack = [root]
    held: list[str] = []
    plain = linked = 0
    at: _Open | None = None
    holder = None

    def end() -> None:
        nonlocal plain, linked, holder
        if not held:
            return
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            # ten for each letter out of links
            weight = 0 if at.outer else 10 * plain + linked
            last = units[-1] if units else None
            if last is not None and at.whole is not None and holder is at.whole and last.chain == at.chain and (last.marked, last.outer) == (at.marked, at.outer):
                last.blocks.append(text)
                last.weight += weight
                new = 0
            else:
                unit = Unit()
                unit.blocks, unit.chain, unit.marked, unit.outer, unit.heading, unit.weight, unit.key = [text], at.chain, at.marked, at.outer, at.heading, weight, 0
                units.append(unit)
                holder = at.whole
                new = 1
            for path in at.chain:
                element = elements[path]
                element.units += new
                element.weight += weight
        plain = linked = 0

    for m in _TOKEN.finditer(page or ""):
        if not m[3]:
            text = m[0]
            if (text[0] != "<" or text == "<") and not stack[-1].skip:
                top = stack[-1]
                if not held:
                    at = top
                elif at is not top and (at.chain is not top.chain or at.whole is not top.whole):
                    end()
                    at = top
                held.append(text)
                if top.link:
                    linked += len(text)
                else:
                    plain += len(text)
            continue
        tag = _tag(m)
        name = tag.name
        block = name in BLOCKS
        if block:
            end()
        elif name == "br" and held:
            held.append(" ")
        if tag.closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            continue
        closes = _CLOSES.get(name, {"p"} if block else ())
        while closes:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name in closes), None)
            # inline elements left open inside are closed with it
            if k is None or any(t.name in BLOCKS and t.name not in closes for t in stack[k + 1 :]):
                break
            del stack[k:]
        if name in VOID:
            continue
        up, new = stack[-1], _Open()
        new.name, new.chain, new.marked, new.outer = name, up.chain, up.marked, up.outer
        new.skip = up.skip or name in CONTROLS or tag.marked and not block
        new.link, new.heading = up.link or name == "a", up.heading or name == "h1"
        new.article = up.article or tag.article and not up.outer
        new.whole = up.whole
        if new.whole is None and (name in LISTS or name == "table" and new.article):
            new.whole = new
        if block and tag.marked:
            new.marked = len(up.chain)
        if block and tag.outer:
            new.outer = len(up.chain)
        if name in REGIONS and not new.skip:
            path = path_of(up.chain[-1], tag.label)
            new.chain = (*up.chain, path)
            element = elements.get(path)
            if element is None:
                element = elements[path] = Element(up.chain[-1], len(units), tag.article and not new.outer)
            element.count += 1
        stack.append(new)
    end()
    for unit in units:
        unit.key = _hash(unit.chain[-1].to_bytes(8, "big", signed=True) + "\n".join(unit.blocks).encode("utf-8", "replace"))
    return units, elements


#: kind 0: a unit of text, 1: an element, 2: an element named as an article. path: that of the parent.
_KINDS = {"token": pa.int64(), "count": pa.int32(), "place": pa.int32(), "kind": pa.int32(), "path": pa.int64(), "weight": pa.int64(), "units": pa.int32()}
_TOKENS = "tokens array<struct<token: long, count: int, place: int, kind: int, path: long, weight: long, units: int>>"


def tokens_of(units: list[Unit], elements: dict[int, Element]) -> list[tuple]:
    """(token, count, first place, kind, path, weight, units) of each token of a page."""
    found = [(path, e.count, e.place, 2 if e.article else 1, e.parent, e.weight, e.units) for path, e in elements.items()]
    first: dict[int, tuple[int, Unit]] = {}
    count = Counter(u.key for u in units)
    weight: Counter[int] = Counter()
    for k, u in enumerate(units):
        first.setdefault(u.key, (k, u))
        weight[u.key] += u.weight
    return found + [(key, count[key], k, 0, u.chain[-1], weight[key], count[key]) for key, (k, u) in first.items()]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, html -> host, content, size, tokens of each page that has some text."""
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.struct(list(_KINDS.items()))))
    for batch in batches:
        out = []
        for own, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            units, elements = parse(page)
            if units:
                content = _hash(b"".join(u.key.to_bytes(8, "big", signed=True) for u in units))
                out.append((own, content, len(units), [dict(zip(_KINDS, t, strict=True)) for t in tokens_of(units, elements)]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["host", "content", "size", "tokens"])


#: Fields of a host's token: vector, mean place, token, pages that have it, times, kind, path, weight, units.
_VECTOR, _PLACE, _TOKEN_AT, _ON, _TIMES, _KIND, _PATH, _WEIGHT, _IN = range(9)


def nest(members: list[tuple], pages: int) -> dict:
    """The template of one host from its frequent tokens, texts of invalid classes left out.

    path: the paths that lead to the article's slot; named: whether its element is named as an article;
    slots: for each path the texts that classes put there, in order.
    """
    once = {m[_TOKEN_AT]: m for m in members if m[_KIND] and 10 * m[_TIMES] <= 11 * m[_ON]}
    texts = [m for m in members if not m[_KIND]]
    parents = {m[_TOKEN_AT]: m[_PATH] for m in members if m[_KIND]}

    def chain(path: int) -> list[int]:
        found = [path]
        while path and path in parents:
            path = parents[path]
            found.append(path)
        return found[::-1]

    # what differs between the pages; where all is the same, what there is
    left = {path: 20 * m[_WEIGHT] for path, m in once.items()}
    for t in texts:
        for path in chain(t[_PATH]):
            if path in left:
                left[path] -= 19 * t[_WEIGHT]
    inner: dict[int, list[int]] = {}
    for path in once:
        if path:
            up = parents[path]
            while up not in once:
                up = parents[up]
            inner.setdefault(up, []).append(path)
    at = 0
    while True:
        named = once[at][_KIND] == 2 if at in once else False
        worth = {p: left[p] * (NAMED if once[p][_KIND] == 2 else 1) for p in inner.get(at, ()) if left[p] > 0 and (once[p][_KIND] == 2 or not named)}
        enough = [p for p, w in worth.items() if w >= ENTER * (w + max(left.get(at, 0) - left[p], 0))]
        if not enough:
            break
        at = max(enough, key=lambda p: (worth[p], -once[p][_PLACE], p))
    # few pages may quote the same text; of the slot's own texts only those on all pages, or on enough of them, are the template's
    inside = [t for t in texts if at in chain(t[_PATH]) and t[_ON] >= min(pages, LEAST_ON)]
    room = once[at][_IN] if at in once else 0
    dropped, share = [], 0.0
    for _, group in itertools.groupby(sorted(inside, key=lambda t: (-t[_ON], t[_VECTOR], t[_PLACE])), key=lambda t: (-t[_ON], t[_VECTOR])):
        group = list(group)
        share += sum(t[_TIMES] for t in group) / max(room, 1)
        if share <= 0.5:
            dropped += group
    slots: dict[int, list[int]] = {}
    for t in sorted([*dropped, *(t for t in texts if at not in chain(t[_PATH]))], key=lambda t: (t[_PLACE], t[_TOKEN_AT])):
        slots.setdefault(t[_PATH], []).append(t[_TOKEN_AT])
    return {"pages": pages, "path": chain(at), "named": named, "slots": [[p, slots[p]] for p in sorted(slots)]}


def in_order(members: list, places: dict[int, int]) -> Iterator[tuple[int, bool]]:
    """(vector, whether this page has the class in its order) of each class of several texts, from texts by vector and mean place."""
    for vector, group in itertools.groupby(members, key=lambda m: m[_VECTOR]):
        at = [places[m[_TOKEN_AT]] for m in group if m[_TOKEN_AT] in places]
        if len(at) > 1:
            yield vector, at == sorted(at)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, pages, members -> the same, members by vector and mean place as JSON."""
    fields = ("vector", "place", "token", "pages", "total", "kind", "path", "weight", "units")
    for batch in batches:
        found = [json.dumps(sorted([m[f] for f in fields] for m in members or [])) for members in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["host", "n", "members"])


def _broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, members, tokens -> host, vector of classes whose order a page breaks, once for each batch."""
    for batch in batches:
        known: dict[str, list] = {}
        found = set()
        for host, members, seen in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if host not in known:
                known[host] = [m for m in json.loads(members) if not m[_KIND]]
            if known[host]:
                found |= {(host, v) for v, kept in in_order(known[host], {u["token"]: u["place"] for u in seen if not u["kind"]}) if not kept}
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["host", "vector"])


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for pages, members, broken in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            bad = set(broken or ())
            found.append(json.dumps(nest([m for m in json.loads(members) if m[_KIND] or m[_VECTOR] not in bad], pages)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["host", "template"])


def templates(pages: DataFrame) -> DataFrame:
    """host, template (JSON) of every host with a text, from all its pages."""
    scratch = Scratch(pages.sparkSession, "html-tokens")
    rows = map_arrow(pages.select(host().alias("host"), "html"), _pages, f"host string, content long, size int, {_TOKENS}")
    distinct = scratch.write(rows.groupBy("host", "content").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens")), "pages")
    each = distinct.select("host", "content", "size", F.inline("tokens"))
    summed = each.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("content", "count")).alias("vector"), F.count(F.lit(1)).alias("pages"), F.sum("count").alias("total"), F.avg(F.col("place") / F.col("size")).alias("place"),
        F.max("kind").alias("kind"), F.first("path").alias("path"), F.sum("weight").alias("weight"), F.sum("units").alias("units"),
    )
    # a token of too few pages is in no valid class: at most twice a page's tokens stay for each host;
    # until then the tokens of a host are spread over several keys
    salts = 32
    sizes = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ranked = summed.filter("pages > 1 or kind > 0").withColumn("salt", F.pmod(F.xxhash64("token"), F.lit(salts)).cast("int"))
    ranked = ranked.join(sizes, ["host", "salt"]).filter(2 * F.col("pages") >= F.col("n"))
    member = F.struct("vector", F.round("place", 9).alias("place"), "token", "pages", "total", "kind", "path", "weight", "units")
    listed = ranked.groupBy("host").agg(F.first("n").alias("n"), F.collect_list(member).alias("members"))
    candidates = scratch.write(map_arrow(listed, _members, "host string, n long, members string"), "members")
    broken = map_arrow(distinct.join(candidates, "host").select("host", "members", "tokens"), _broken, "host string, vector long")
    broken = broken.groupBy("host").agg(F.collect_set("vector").alias("broken"))
    return map_arrow(candidates.join(broken, "host", "left").select("host", "n", "members", "broken"), _templates, "host string, template string")


class Template:
    """Where a host's pages have their article, and the texts that are the template's. An empty one knows nothing."""

    def __init__(self, text: str | None):
        spec = json.loads(text) if text else {"path": [], "named": False, "slots": []}
        self.path, self.named = tuple(spec["path"]), spec["named"]
        self.texts = frozenset(t for _, texts in spec["slots"] for t in texts)


def extract(page: str | None, template: Template) -> str:
    """The page's blocks in the template's slot for the article, one for each line; with an empty template all of its blocks."""
    units, elements = parse(page)
    path, named = template.path, template.named
    if not path:
        return "\n".join(b for u in units for b in u.blocks)
    if path[-1] not in elements:
        own = nest([(0, e.place, p, 1, e.count, 2 if e.article else 1, e.parent, e.weight, e.units) for p, e in elements.items()], 1)
        path, named = tuple(own["path"]), own["named"]
    depth, kept = len(path), []
    for u in units:
        if u.chain[:depth] == path:
            # marks count between the slot and the text
            if u.marked >= depth or not named and u.outer >= depth:
                continue
        elif named or u.outer or not u.heading or u.chain != path[: len(u.chain)]:
            continue  # but for the headings on the way to a slot without a name
        if u.key not in template.texts:
            kept += u.blocks
    return "\n".join(kept)


def main_text(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` plus text (the article's blocks, joined by newlines) and n_chars (its code points).

    The whole html is read; a null one is empty, with an empty text. A null url belongs to a host of
    its own, shared by all without a host. Null or repeated page_ids are rows like others; other
    columns pass through, and a column named text or n_chars is replaced. An empty table gives an
    empty result. Doubled pages change nothing; a host of one page has the template of that page.
    """
    pages, back = hide(pages, "page_id", "url", "html")
    scratch = Scratch(pages.sparkSession, "html-extract")
    known = scratch.write(templates(pages), "templates")
    marked = pages.withColumn("_host", host())
    joined = marked.join(known.withColumnRenamed("host", "_host"), "_host", "left")
    names = pages.columns
    joined = joined.select(*names, F.col("template").alias("_template"))
    at = names.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str | None, Template] = {}
        for batch in batches:
            found = []
            for page, template in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if template not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    parsed[template] = Template(template)
                found.append(extract(page, parsed[template]))
            added = [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *added], [*names, "text", "n_chars"])

    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    found = map_arrow(joined, run, schema)
    return scratch.keep(back(found, "text", "n_chars"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
