"""Main text of web pages, with site templates removed.

A page is read into blocks of text, and every element's subtree is hashed in two
ways: with its tags, classes and words, and as layout, which is its path from
the root, its tags and classes and the sequence of its children, with all words and
numbers masked and repeated children counted once.  Spark counts, for each host,
on how many different pages a hash occurs, and how many different pages the host has.

- Outside article and main elements, a block goes with the innermost element around
  it if that recurs word for word on a share of the host's pages (and on
  ``min_pages`` at least): where a larger element recurs, all within it recur too.
- Inside them, only a box (a division, list, table or the like) that recurs word for word
  as a whole is deleted.  Headings and paragraphs of an article stay, however
  often other articles repeat them.
- On a page that has an article or main element, a block outside of it also goes if the
  layout around it recurs on half of the host's pages: footers, menus and
  adverts, whose words differ from page to page, are found so.

A page that is a copy of another does not count again.  Elements whose tag, role
or class names them as menu, header, footer, sidebar, notice, advert, form, script,
style or reader comments are left out in any case (with ``lists=False`` only what is never shown
as text, to see what counting alone finds).

Null and empty pages give an empty text; markup that is never closed is closed
by its parents; pages of any length are read whole, in time linear in it but for
lists in lists that are never closed; repeated pages and null keys get equal
results; pages without a host share one; an element on exactly ``min_pages`` pages,
or on exactly the share, is template; an empty table gives an empty result.  Only
key, url and page are read, so extra columns of any name are no matter; the
results' names are fixed.

The parsed pages stay in the checkpoint folder: the result reads them.  Up to
``SENT_MARKS`` template elements are sent to the tasks; beyond that, pages and their
deletions are joined, where Spark's skew join splits a host's hot element.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm import text as T
from rowmill.llm.stored import drop, stored
from rowmill.llm.url_filter import host_of

MIN_PAGES, SHARE, LAYOUT_SHARE = 8, 0.05, 0.5
#: Up to so many template elements (8 bytes each) are sent to the tasks; more are joined.
SENT_MARKS = 1_000_000

#: Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
SKIP = frozenset("script style head title noscript template iframe object embed svg math canvas audio video nav footer aside form button select option textarea input label fieldset dialog menu xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
MAIN = frozenset(("article", "main"))
#: Elements of an article that may hold a part of the site's template.
BOX = frozenset("div section aside ul ol dl table figure center details address".split())
#: Elements that are never shown as text.
UNSEEN = frozenset("script style head title noscript template".split())
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element of one of these names is closed by the next of its group.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
#: Words that name page furniture in class and id attributes.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side-bar|footer|masthead|site-header|page-header|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|widget|pagination|pager|comments?|commentlist|comment-list|disqus|respond|replies|toolbar|skip-link)(?:$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    """An open element; ``block`` is the innermost element at or around it that is no inline one, ``box`` the innermost
    one that may be a box of a template inside an article or main element."""

    __slots__ = ("tag", "skip", "main", "held", "laid", "parts", "own", "block", "box", "path", "kids")

    def __init__(self, tag, skip, main, own, up=None):
        self.tag, self.skip, self.main, self.own, self.held, self.laid, self.parts, self.kids = tag, skip, main, own, [], [], [], []
        self.block = up.block if up and tag in INLINE else self
        self.box = self if up and up.main and tag in BOX else up.box if up else None
        self.path = hashlib.blake2b(up.path + own, digest_size=8).digest() if up else b""

    def child(self, shape: bytes) -> None:
        if not self.kids or self.kids[-1] != shape:
            self.kids.append(shape)


def furniture(tag: str, attrs: dict[str, str], in_main: bool, lists: bool = True) -> bool:
    if not lists:
        return tag in UNSEEN
    if tag in SKIP or (tag == "header" and not in_main):
        return True
    if tag in ("html", "body") or tag in MAIN:
        return False
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    return attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(named.strip() and FURNITURE.search(named))


def read(page: str, lists: bool = True) -> tuple[list[str], list[int | None], list[int | None]]:
    """(blocks, for each the hash of the element that it goes with, and that of the layout around it).

    Text inside an element that is furniture is not in the blocks; a block outside of all elements, or in
    no box of an article, has no hash, and one inside of an article, or on a page without any, no layout."""
    blocks: list[str] = []
    marks: list[int | None] = []
    layouts: list[int | None] = []
    has_main = False
    root = Node("", False, False, b"")
    stack, buf = [root], []
    opened: Counter[str] = Counter()  # how many elements of a tag are open

    def end_block():
        if buf:
            text = _SPACE.sub(" ", "".join(buf)).strip()
            buf.clear()
            if text:
                blocks.append(text)
                marks.append(None)
                layouts.append(None)
                around = stack[-1].block
                if not around.main:
                    around.held.append(len(marks) - 1)
                    around.laid.append(len(marks) - 1)
                elif stack[-1].box:
                    stack[-1].box.held.append(len(marks) - 1)

    def text(raw: str):
        if raw and not stack[-1].skip:
            said = html.unescape(raw) if "&" in raw else raw
            buf.append(said)
            stack[-1].parts.append(said.encode("utf-8", "replace"))
            stack[-1].child(b"words")

    def close():
        node = stack[-1]
        if node.tag not in INLINE:
            end_block()
        stack.pop()
        opened[node.tag] -= 1
        made = hashlib.blake2b(b"\0".join([node.own, *node.parts]), digest_size=8).digest()
        stack[-1].parts.append(made)
        for i in node.held:
            marks[i] = int.from_bytes(made, "little", signed=True)
        shape = hashlib.blake2b(b"\0".join([node.own, *node.kids]), digest_size=8).digest()
        stack[-1].child(shape)
        if node.laid:
            laid = int.from_bytes(hashlib.blake2b(node.path + shape, digest_size=8, key=b"layout").digest(), "little", signed=True)
            for i in node.laid:
                layouts[i] = laid

    def close_to(names, bounds) -> None:
        if not any(opened[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                while len(stack) > k:
                    close()
                return
            if stack[k].tag in bounds:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br" or tag == "p" and not opened["p"]:
                end_block()
            elif opened[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in ENDS_P:
            close_to({"p"}, {"table", "td", "th", "button", "object"} | MAIN)
        if tag in SAME:
            close_to(SAME[tag], HOLDS[tag])
        if tag not in INLINE:
            end_block()
        if tag in VOID:
            stack[-1].parts.append(tag.encode())
            stack[-1].child(tag.encode())
            continue
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m[3])}
        up = stack[-1]
        main = up.main or tag in MAIN or attrs.get("role", "").lower() == "main"
        has_main = has_main or main
        skip = up.skip or furniture(tag, attrs, main, lists)
        stack.append(Node(tag, skip, main, f"{tag} {attrs.get('class', '')} {attrs.get('id', '')}".encode("utf-8", "replace"), up))
        opened[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else size
            text(page[at:stop])
            at = stop
    while len(stack) > 1:
        close()
    end_block()
    return blocks, marks, layouts if has_main else [None] * len(marks)


def parse(pages: DataFrame, key: str, url: str, page: str, lists: bool = True) -> DataFrame:
    """key, host, print (a hash of all text), blocks (compressed) and marks: those of all blocks, then their layouts."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            prints, texts, marks = [], [], []
            for x in T.strings(b.column(2)):
                blocks, own, layouts = read(x or "", lists)
                said = json.dumps(blocks, ensure_ascii=False).encode("utf-8", "replace")
                prints.append(int.from_bytes(hashlib.blake2b(said, digest_size=8).digest(), "little", signed=True))
                texts.append(zlib.compress(said, 1))
                marks.append(own + layouts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.int64()), pa.array(texts, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], [key, "host", "print", "blocks", "marks"])

    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), F.col(page).alias("page"))
    return rows.mapInArrow(run, f"`{key}` {kind}, host string, print long, blocks binary, marks array<bigint>")


def names(host: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """One number for an element of a host."""
    return T.mix(T.mix(host.view(np.uint64)) + mark.view(np.uint64))


def joined(blocks: list[str], gone: list[bool]) -> str:
    """The blocks of which neither the element (first half of ``gone``) nor the layout (second half) goes."""
    n = len(blocks)
    return "\n\n".join(x for x, cut, laid in zip(blocks, gone[:n], gone[n:], strict=True) if not cut and not laid)


def kept():
    """An Arrow UDF (blocks, marks, cut) -> the text of the blocks whose marks are not in cut."""

    @F.arrow_udf("string")
    def text(blocks: pa.Array, marks: pa.Array, cut: pa.Array) -> pa.Array:
        out = []
        for z, own, gone in zip(blocks, marks.to_pylist(), cut.to_pylist(), strict=True):
            gone = set(gone or ())
            out.append(joined(json.loads(zlib.decompress(z.as_py())), [m in gone for m in own]))
        return pa.array(out, pa.string())

    return text


def kept_without(known: np.ndarray):
    """An Arrow UDF (host, blocks, marks) -> the text of the blocks whose ``names`` are not in the sorted ``known``."""

    @F.arrow_udf("string")
    def text(host: pa.Array, blocks: pa.Array, marks: pa.Array) -> pa.Array:
        flat = marks.flatten()
        size = np.diff(marks.offsets.to_numpy())
        name = names(np.repeat(host.to_numpy(), size), flat.fill_null(0).to_numpy())
        at = np.minimum(np.searchsorted(known, name), max(len(known) - 1, 0))
        gone = (known[at] == name if len(known) else np.zeros(len(name), bool)) & ~flat.is_null().to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        return pa.array([joined(json.loads(zlib.decompress(z.as_py())), gone[e - n : e].tolist()) for z, n, e in zip(blocks, size.tolist(), ends.tolist(), strict=True)], pa.string())

    return text


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, layout_share: float = LAYOUT_SHARE, lists: bool = True) -> DataFrame:
    """key, url, text and n_chars for every row of ``pages``.

    Parsed pages are stored in the shared folder, compressed, so markup is read
    once; what is counted are hashes alone."""
    rows = pages.select(F.col(key).alias("_k"), F.col(url).alias("_u"), F.col(page).alias("_p"))
    parsed = parse(rows.withColumn("_k", F.struct("_k", "_u")).select("_k", "_u", "_p"), "_k", "_u", "_p", lists).withColumn("no", F.monotonically_increasing_id())
    parsed = stored(parsed.withColumn("host", F.xxhash64("host")))
    n = F.size("marks") / 2
    both = F.explode(F.array(F.struct(F.lit(False).alias("laid"), F.slice("marks", 1, n.cast("int")).alias("m")), F.struct(F.lit(True).alias("laid"), F.slice("marks", (n + 1).cast("int"), n.cast("int")).alias("m"))))
    each = parsed.select("no", "host", "print", both.alias("b")).select("no", "host", "print", "b.laid", F.explode(F.array_distinct("b.m")).alias("mark"))
    marks = each.where("mark is not null")
    sizes = parsed.select("host", "print").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    on = marks.select("host", "laid", "mark", "print").distinct().groupBy("host", "laid", "mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    least = F.when(F.col("laid"), layout_share).otherwise(share)
    often = stored(on.join(sizes, "host").where(F.col("n") >= least * F.col("n_pages")).select("host", "mark"))
    if often.count() <= SENT_MARKS:
        got = often.toArrow()
        out = parsed.select("_k", kept_without(np.sort(names(got.column("host").to_numpy(), got.column("mark").to_numpy())))("host", "blocks", "marks").alias("text"))
        drop(often)
    else:
        cut = marks.join(often, ["host", "mark"]).groupBy("no").agg(F.collect_set("mark").alias("cut"))
        out = parsed.join(cut, "no", "left").select("_k", kept()("blocks", "marks", "cut").alias("text"))
    return out.select(F.col("_k._k").alias(key), F.col("_k._u").alias(url), "text").withColumn("n_chars", F.char_length("text").cast("long"))
