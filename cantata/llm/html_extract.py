"""Operator 8: main text of web pages by a host suffix array, with markup as the prior.

A page is parsed once into its visible blocks. All blocks but undisputed main text form the page's token stream. The host suffix array holds
every suffix of the streams of a host's pages, ordered as deep as DEPTH tokens: a repeated substring of DEPTH tokens or more is a chain of overlapping
repeated runs of DEPTH tokens, so what repeated substrings cover is what repeated runs cover, and no deeper order is needed. The array is distributed: a suffix goes to
its host and the hash of these tokens, so suffixes that meet there are the neighbours that agree through DEPTH tokens, and the distinct pages among them are counted
by aggregates that combine before the shuffle, over the whole host however many pages it has. Runs on LEAST_PAGES
pages and more are repeated. What is decided:

* A block outside declared main text is boilerplate if repeated runs cover half of it, and goes.
* Rare boilerplate, which doesn't repeat, goes by markup: menus, forms, asides, comments and so on, by element, role and class name.
* Declared main text (article, main) stays, as articles of a host quote and copy each other. A block of it goes by markup too where an element, a role or a plain class name
  (`comments`, `share-buttons`) within it says so. Where a class name only has such a word among others (`related-work`, `entry-footer`), repetition decides.
* Around declared main text class names and forms decide nothing (`<div class="layout no-sidebar">`, a form around the whole page), unless the page has other main text outside.
* Pages that declare no main text keep the blocks that are left.

The repeated runs are shipped to the pages while they have at most LIMIT bytes; beyond that each page's runs are joined with them.

Defined cases: a null or empty page has an empty text. Tags may be unclosed or misnested, and those that HTML lets out may be missing; a script, style, title or comment without an end
runs to the page's end; a tag whose quotes leave it no end ends at the next ">", and "<" without any ">" behind it is text. Parsing takes time in proportion to the page, however long. A
null URL belongs to the host "". Pages equal in URL and content are one page, and get equal texts. Bytes that aren't UTF-8 become U+FFFD. Other columns aren't looked at.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantata.llm.common import Scratch, frugal, input_bytes, member, mix, small_side, strings, word_hashes
from cantata.llm.url_filter import host_and_path

#: Tokens that a repeated run has at least.
DEPTH = 8
#: Distinct pages of a host that a repeated run stands on at least.
LEAST_PAGES = 2
#: Bytes of the repeated runs that are shipped to the pages.
LIMIT = 32 << 20

#: Elements by what they mean for the text. The content of RAW elements is no markup; the rest of HIDDEN show nothing where they have an end.
RAW = ("script", "style", "title", "textarea", "iframe", "noscript")
HIDDEN = (*RAW, "template", "svg", "math", "select", "object", "canvas", "audio", "video")
CHROME = frozenset("nav footer aside menu dialog button fieldset datalist".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HINTS = frozenset(
    "nav navbar navigation menu header masthead topbar footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe subscription signup login share sharing social related recommended breadcrumb breadcrumbs pagination pager comment comments disqus popup modal overlay widget toolbar".split()
)
#: Words of class names that say where or how, and leave a hint as plain as it is.
PLACES = frozenset("area bar block body bottom box button buttons col column container first form global group inner item items last left link links list main outer page panel post posts primary region right row secondary section site slot top unit wrap wrapper".split())
#: Hints that mean a heading within main text.
HEADS = frozenset("header masthead".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPECIAL = re.compile("[>\"']")
_END_OF = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}
_NAMES = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ROLE = re.compile(r"\brole\s*=\s*[\"']?([a-z]+)", re.I)

#: What a block is: undeclared, main text, cut by markup, main text that repetition decides on.
OPEN, MAIN_TEXT, CUT, DOUBTFUL = 0, 1, 2, 3
#: Until the page is read: main text, and such that repetition decides on, within what may be a wrapper; what a wrapper alone cuts.
_WRAPPED, _WRAPPED_DOUBTFUL, _WRAPPER = 4, 5, 6

#: What an element opens.
_HARD, _SOFT, _WITHIN, _DOUBT, _MAIN = "hard", "soft", "within", "doubt", "main"


def _hint(attributes: str, in_main: bool) -> str:
    """plain, if a class name or id is made of hints and places; mixed, if one has a hint among other words; else nothing."""
    hints, out = HINTS - HEADS if in_main else HINTS, ""
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = set(re.split(r"[^a-z]+", name)) - {""}
            if parts & hints:
                if parts <= hints | PLACES:
                    return "plain"
                out = "mixed"
    return out


def _kind(name: str, attributes: str, in_main: bool) -> str:
    """What an element opens, by its name, role and class names."""
    if name in CHROME or (name == "header" and not in_main):
        return _HARD
    soft = _WITHIN if in_main else _SOFT
    if name == "form":
        return soft
    if attributes and "=" in attributes:
        if role := _ROLE.search(attributes):
            if role[1].lower() in ROLES:
                return _HARD
            if role[1].lower() == "main":
                return _MAIN
        if name not in MAIN and name not in ("body", "html") and (hint := _hint(attributes, in_main)):
            return soft if hint == "plain" else _DOUBT if in_main else ""
    return _MAIN if name in MAIN else ""


class Tags:
    """Tags of a page from the left to the right, in time proportional to its length."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.stop = max(self.last.values())
        self.endless: set[str] = set()  # elements without an end further on
        self.failed: set[int] = set()  # quotes from which no end of a tag is reached

    def end(self, at: int) -> int:
        """Place of the ">" that ends a tag; at: behind its name. Quotes are skipped; if that leaves no end, it is the next ">"."""
        page, tried, k = self.page, [], at
        while k <= self.stop:
            m = _SPECIAL.search(page, k)
            if m is None or m.start() in self.failed:
                break
            if m[0] == ">":
                return m.start()
            tried.append(m.start())
            k = 1 + (page.find(m[0], m.end()) if m.start() < self.last[m[0]] else m.start())
        self.failed.update(tried)
        return page.find(">", at)

    def __iter__(self):
        """(start, end, name, closing, attributes); name is empty for comments and the like, and for hidden elements, whose content is included."""
        page, at = self.page, 0
        while (i := page.find("<", at)) >= 0:
            at = i + 1
            if page.startswith("<!--", i):
                k = page.find("-->", i + 4)
                at = len(page) if k < 0 else k + 3
                yield i, at, "", False, ""
                continue
            if i > self.last[">"]:
                if page.find("<!--", i) < 0:
                    return
                continue
            closing = page.startswith("/", i + 1)
            m = _NAME.match(page, i + 1 + closing)
            if m is None:
                if closing or page[i + 1 : i + 2] in ("!", "?"):
                    at = page.find(">", i) + 1
                    yield i, at, "", False, ""
                continue
            k = self.end(m.end())
            name, attributes = m[0].lower(), page[m.end() : k]
            at = k + 1
            if name in _END_OF and not closing:
                if not (name in ("svg", "math") and attributes.endswith("/")):
                    over = None if name in self.endless else _END_OF[name].search(page, at)
                    if over is not None:
                        at = over.end()
                    elif name in RAW:
                        at = len(page)
                    else:
                        self.endless.add(name)
                yield i, at, "", False, ""
            else:
                yield i, at, name, closing, attributes


def blocks(page: str) -> list[tuple[int, str]]:
    """(OPEN, MAIN_TEXT, CUT or DOUBTFUL, text) of each block that can be seen, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, str]] = []
    outer: list[int] = []  # places of what isn't inline
    count: dict[str, int] = {}  # open elements by name
    depth = {_HARD: 0, _SOFT: 0, _WITHIN: 0, _DOUBT: 0, _MAIN: 0, "": 0}
    parts: list[str] = []
    state = OPEN

    def flush() -> None:
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((state, text))
            parts.clear()

    def here() -> int:
        if depth[_HARD] or depth[_WITHIN]:
            return CUT
        if depth[_MAIN]:
            wrapped = depth[_SOFT] > 0
            return (_WRAPPED_DOUBTFUL if wrapped else DOUBTFUL) if depth[_DOUBT] else _WRAPPED if wrapped else MAIN_TEXT
        return _WRAPPER if depth[_SOFT] else OPEN

    def add(text: str) -> None:
        nonlocal state
        now = here()
        if parts and now != state:
            flush()
        state = now
        parts.append(text)

    def close(upto: int) -> None:
        while len(stack) > upto:
            name, kind = stack.pop()
            depth[kind] -= 1
            count[name] -= 1
        while outer and outer[-1] >= upto:
            outer.pop()

    def innermost(names, through=()) -> int | None:
        """The innermost of these elements, none but inline ones and those in through within it."""
        for k in reversed(outer):
            if stack[k][0] in names:
                return k
            if stack[k][0] not in through:
                return None
        return None

    end = 0
    for start, stop, name, closing, attributes in Tags(page):
        if start > end:
            add(page[end:start])
        end = stop
        if not name:
            continue
        if name not in INLINE:
            flush()
        if closing:
            if count.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            continue
        if name in VOID:
            continue
        if name not in INLINE:
            if (k := innermost(("p",))) is not None:
                close(k)
            if name in SELF_CLOSING and (k := innermost(SELF_CLOSING[name], ("p",))) is not None:
                close(k)
            outer.append(len(stack))
        kind = _kind(name, attributes, depth[_MAIN] > 0)
        stack.append((name, kind))
        depth[kind] += 1
        count[name] = count.get(name, 0) + 1
    if end < len(page):
        add(page[end:])
    flush()
    return _settled(out)


def _settled(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Main text within wrappers is main text if there is no other; without any main text and any undeclared block, what wrappers alone cut is undeclared."""
    kinds = {kind for kind, _ in found}
    if max(kinds, default=0) < _WRAPPED:
        return found
    main = bool(kinds & {MAIN_TEXT, DOUBTFUL})
    inside = bool(kinds & {_WRAPPED, _WRAPPED_DOUBTFUL}) and not main
    undeclared = not main and not inside and OPEN not in kinds
    means = {_WRAPPED: MAIN_TEXT if inside else CUT, _WRAPPED_DOUBTFUL: DOUBTFUL if inside else CUT, _WRAPPER: OPEN if undeclared else CUT}
    return [(means.get(kind, kind), text) for kind, text in found]


def main_text(found: list[tuple[int, str]]) -> str:
    """What markup alone gives."""
    return " ".join(t for kind, t in found if kind in (MAIN_TEXT, DOUBTFUL))


#: Stands before each block in a stream, so that short blocks repeat with their neighbours.
BORDER = "\0"
_STEP = np.uint64(0x9FB21C651E98DF25)


class Streams:
    """Token streams of some pages: the blocks but undisputed main text, each behind a border."""

    def __init__(self, pages: list[list[tuple[int, str]]], hosts: np.ndarray, depth: int = DEPTH):
        tokens, size, blocks_of = [], [], []
        for page in pages:
            n = 0
            for kind, text in page:
                if kind != MAIN_TEXT:
                    mine = [BORDER, *text.split(" ")]
                    tokens += mine
                    blocks_of.append(len(mine))
                    n += len(mine)
            size.append(n)
        self.size = np.array(size, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.block = np.concatenate([[0], np.cumsum(blocks_of)]).astype(np.int64)  # first token of each block, and the end
        self.page = np.repeat(np.arange(len(pages)), self.size)
        self.depth = depth
        h = _hashes(tokens)
        n = len(h)
        self.at = np.flatnonzero(self.first[1:][self.page] - np.arange(n) >= depth) if n else np.zeros(0, np.int64)
        run = mix(hosts[self.page[self.at]])
        for k in range(depth):
            run = mix(run * _STEP + h[self.at + k])
        self.run = run

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """Which tokens lie in a repeated run; repeated: of each run."""
        step = np.zeros(len(self.page) + 1, np.int64)
        np.add.at(step, self.at[repeated], 1)
        np.add.at(step, self.at[repeated] + self.depth, -1)
        return np.cumsum(step[:-1]) > 0

    def verdicts(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which blocks of the streams are boilerplate, and how many words of each page lie in repeated runs."""
        inside = self.covered(repeated)
        total = np.concatenate([[0], np.cumsum(inside)])
        most = 2 * (total[self.block[1:]] - total[self.block[:-1]]) >= np.diff(self.block)
        inside[self.block[:-1]] = False  # borders are no words
        total = np.concatenate([[0], np.cumsum(inside)])
        return most, total[self.first[1:]] - total[self.first[:-1]]


def _hashes(texts: list[str]) -> np.ndarray:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(x) for x in raw]).astype(np.int64) if raw else np.zeros(0, np.int64)
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(x) for x in raw], np.int64), ends)


def _parsed(pages: DataFrame, kept: list[str]) -> DataFrame:
    """Kept columns, key, host, the blocks and their kinds."""
    fields = [*(pages.schema[c] for c in kept), T.StructField("key", T.LongType()), T.StructField("host", T.LongType()), T.StructField("kinds", T.BinaryType()), T.StructField("blocks", T.ArrayType(T.StringType(), False))]
    k = len(kept)

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                found = [blocks(x) for x in strings(part.column(k))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in (*range(k), k + 1, k + 2)), pa.array([bytes(kind for kind, _ in f) for f in found], pa.binary()), pa.array([[t.encode("utf-8", "replace").decode() for _, t in f] for f in found], pa.list_(pa.string()))], names=[f.name for f in fields]
                )

    return pages.select(*kept, "html", "key", "host").mapInArrow(frugal(run), T.StructType(fields))


def _read(batch) -> tuple[list[list[tuple[int, str]]], np.ndarray, np.ndarray]:
    """Blocks, hosts and keys of a batch of parsed pages."""
    at = batch.schema.get_field_index
    found = [list(zip(k, b)) for k, b in zip(batch.column(at("kinds")).to_pylist(), batch.column(at("blocks")).to_pylist())]
    return found, np.asarray(batch.column(at("host"))).view(np.uint64), np.asarray(batch.column(at("key")))


def _parts(batches, rows: int = 512):
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)


def _suffixes(parsed: DataFrame) -> DataFrame:
    """run, lo, hi, pages: of each batch's runs the least and largest page, and how many pages."""

    def run(batches):
        for batch in _parts(batches):
            pages, hosts, keys = _read(batch)
            s = Streams(pages, hosts)
            if not len(s.run):
                continue
            page = s.page[s.at]
            order = np.lexsort([keys[page], s.run])
            value, key = s.run[order], keys[page][order]
            new = np.ones(len(value), bool)
            new[1:] = value[1:] != value[:-1]
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(value))
            fresh = new.copy()
            fresh[1:] |= key[1:] != key[:-1]
            columns = [value[begin].view(np.int64), key[begin], key[end - 1], np.add.reduceat(fresh.astype(np.int64), begin)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["run", "lo", "hi", "pages"])

    return parsed.select("key", "host", "kinds", "blocks").mapInArrow(frugal(run), "run bigint, lo bigint, hi bigint, pages bigint")


def _distinct(parsed: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """parsed without repeated pages; only those that repeat are shuffled."""
    twice = scratch.keep(parsed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "twice", size)
    count = twice.count()
    if not count:
        return parsed
    twice = small_side(twice, count, 16)
    return parsed.join(twice, "key", "left_anti").unionByName(parsed.join(twice, "key", "left_semi").dropDuplicates(["key"]))


def _repeated(parsed: DataFrame, scratch: Scratch, size: int, least_pages: int) -> DataFrame:
    """run: of the runs on several pages of their host."""
    seen = _suffixes(_distinct(parsed, scratch, size)).groupBy("run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("pages").alias("pages"))
    return seen.where((F.col("lo") != F.col("hi")) & (F.col("pages") >= least_pages)).select("run")


def _judged(parsed: DataFrame, kept: list[str], repeated: np.ndarray | None) -> DataFrame:
    """Kept columns, text and n_boilerplate. repeated: the sorted repeated runs; None where parsed has each page's own (column mine)."""
    fields = [*(parsed.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_boilerplate", T.LongType())]
    shipped = parsed.sparkSession.sparkContext.broadcast(repeated)
    k = len(kept)

    def run(batches):
        for batch in _parts(batches):
            pages, hosts, _ = _read(batch)
            s = Streams(pages, hosts)
            known = shipped.value
            if known is None:
                own = [np.asarray(x.values).view(np.uint64) for x in batch.column(batch.schema.get_field_index("mine")) if x.is_valid]
                known = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
            cut, words_ = s.verdicts(member(known, s.run))
            texts, i = [], 0
            for page in pages:
                declared, mine = any(kind in (MAIN_TEXT, DOUBTFUL) for kind, _ in page), []
                for kind, text in page:
                    if kind == MAIN_TEXT:
                        mine.append(text)
                        continue
                    if not cut[i] and (kind == DOUBTFUL or (kind == OPEN and not declared)):
                        mine.append(text)
                    i += 1
                texts.append(" ".join(mine))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(k)), pa.array(texts, pa.string()), pa.array(words_.astype(np.int64))], names=[f.name for f in fields])

    return parsed.select(*kept, "key", "host", "kinds", "blocks", *(["mine"] if "mine" in parsed.columns else [])).mapInArrow(frugal(run), T.StructType(fields))


def _with_own(parsed: DataFrame, repeated: DataFrame) -> DataFrame:
    """parsed with mine: each page's repeated runs, by joins on the run and on the page."""

    def run(batches):
        for batch in _parts(batches):
            pages, hosts, keys = _read(batch)
            s = Streams(pages, hosts)
            yield pa.RecordBatch.from_arrays([pa.array(keys[s.page[s.at]]), pa.array(s.run.view(np.int64))], names=["key", "run"])

    rows = parsed.select("key", "host", "kinds", "blocks").mapInArrow(frugal(run), "key bigint, run bigint")
    own = rows.join(repeated, "run", "left_semi").groupBy("key").agg(F.collect_set("run").alias("mine"))
    return parsed.join(own, "key", "left")


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", keep: tuple[str, ...] = ("page_id", "url"), least_pages: int = LEAST_PAGES, limit: int = LIMIT) -> DataFrame:
    """One row a page: the kept columns, text, and n_boilerplate: words outside undisputed main text in runs that the host's pages repeat."""
    scratch, size = Scratch(pages.sparkSession), input_bytes(pages)
    kept = [f"__k{i}" for i in range(len(keep))]
    page = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    host, _ = host_and_path(F.col(url_col).cast("string"))
    df = pages.select(*(F.col(c).alias(k) for k, c in zip(kept, keep)), page.alias("html"), F.xxhash64(F.col(url_col).cast("string"), page).alias("key"), F.xxhash64(host).alias("host"))
    parsed = scratch.keep(_parsed(df, kept), "parsed", 4 * size)  # parsing takes longer than what else is done with a page
    repeated = scratch.keep(_repeated(parsed, scratch, size, least_pages), "repeated", size)
    if repeated.count() * 8 <= limit:
        known = np.unique(np.asarray(repeated.toArrow().column("run")).astype(np.int64).view(np.uint64))
        found = _judged(parsed, kept, known)
    else:
        found = _judged(_with_own(parsed, repeated), kept, None)
    return found.select(*(F.col(k).alias(c) for k, c in zip(kept, keep)), "text", "n_boilerplate")


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_boilerplate")
