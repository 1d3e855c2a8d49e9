"""Main text of web pages by a style tree per site: branches of little importance go."""

import functools
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet.llm.storage import stored
from docuvet.llm.textops import portions

#: Elements whose content is never text of an article.
DROPPED = frozenset("script style noscript template head title nav header footer aside form button select textarea option iframe svg canvas object audio video map dialog menu".split())
#: Elements whose content is not markup: it ends at their own end tag only.
RAW = frozenset("script style textarea title noscript iframe template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand inside a line; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag of the same kind ends.
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
MAIN = frozenset("article main".split())
#: Words of class, id and role that name a part around the article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer sidebar side aside widget related recommended share sharing social comment comments reply replies "
    "respond disqus cookie cookies consent notice notices gdpr newsletter subscribe subscription signup login popup modal overlay pager "
    "pagination toolbar toc skip copyright disclaimer complementary contentinfo search".split()
)
#: Those of them that name what readers wrote.
READERS_WORDS = frozenset("comment comments reply replies respond disqus".split())
#: A name with one of these words says what a part has, not what it is.
TELLING_OF_OTHERS = frozenset("has with without no not show hide enabled disabled layout".split())
WORD = re.compile(r"[a-z]+")
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
SPACE = re.compile(r"\s+")

#: A branch goes if its importance is below this and what stands around it has more, where at least so many pages of a host have it.
LEAST_IMPORTANCE, LEAST_PAGES = 0.2, 8
#: A branch that a class, id or role names as noise goes already if its content importance is below this.
NAMED_IMPORTANCE = 0.5
#: How much less each further style of a node counts its own variety against what is below it.
DAMPING = 0.9
#: Largest shares of the text that a name may cover: a part that holds more is what the page is about, whatever it is called.
#: Readers' comments may be longer than the article.
NAMED_SHARE, READERS_SHARE = 0.75, 0.95
PLAIN, NAMED, READERS = range(3)
MASK = (1 << 64) - 1


def _kind(name: str, attributes: str) -> tuple[str, int]:
    """A node's label in the style tree, and whether its attributes name it as noise, as readers' comments, or not."""
    if not attributes or "=" not in attributes:
        return name, PLAIN
    words: list[str] = []
    naming: set[str] = set()
    for key, *values in ATTRIBUTE.findall(attributes):
        for token in next((v for v in values if v), "").lower().split():
            found = WORD.findall(token)
            words += found
            if TELLING_OF_OTHERS.isdisjoint(found):
                naming.update(found)
    kind = READERS if not READERS_WORDS.isdisjoint(naming) else NAMED if not NOISE_WORDS.isdisjoint(naming) else PLAIN
    return ".".join([name, *words]), PLAIN if name in ("html", "body", "article", "main") else kind


class Element:
    """An open element: its node in the style tree, whether its tag or one around it is noise, and digests of its inside.

    ``names``: elements named as noise down to it. ``main``: 0, or within a main element 1 and the names around that; ``top``: its node.
    """

    __slots__ = ("name", "node", "noise", "names", "main", "top", "inline", "branch", "content", "children")

    def __init__(self, name: str, node: int, noise: bool, names: int, main: int, top: int, inline: bool, branch: bool):
        self.name, self.node, self.noise, self.names, self.main, self.top = name, node, noise, names, main, top
        self.inline, self.branch = inline, branch
        self.content, self.children = 0, 0


class Block(NamedTuple):
    """A text as written, its digest, and where it stands; ``glued``: it goes on in the line of the block before."""

    text: str
    digest: int
    node: int
    noise: bool
    main: int
    top: int
    glued: bool


class Page:
    """One page read in a single pass.

    ``blocks``: in order. ``parents``: of each node outside noise tags. ``contents`` and ``styles``: for each finished branch there
    its node with the digest of its text, and of the sequence of its children.
    A node is the chain of labels from the root, whatever its depth; its last two bits tell how its last label is named.
    """

    def __init__(self, source: str | None):
        self.blocks: list[Block] = []
        self.parents: dict[int, int] = {}
        self.inside: set[int] = set()
        self.contents: set[tuple[int, int]] = set()
        self.styles: set[tuple[int, int]] = set()
        self._text: list[str] = []
        self._glue = False
        self._open = [Element("", 0, False, 0, 0, 0, False, True)]
        source = source or ""
        at = 0
        while True:
            m = TAG.search(source, at)
            if m is None:
                break
            if m.start() > at:
                self._text.append(source[at : m.start()])
            at = m.end()
            name = m.group(2)
            if name:
                name = name.lower()
                if m.group(1):
                    self._end(name)
                else:
                    self._begin(name, m.group(3))
                    if name in RAW and not m.group(3).endswith("/"):
                        self._flush()
                        stop = _end_of(name).search(source, at)
                        at = stop.start() if stop else len(source)
        if at < len(source):
            self._text.append(source[at:])
        self._flush()
        while self._open:
            self._pop()
        #: Names around the main element; 0 if there is none. Of several, those with the fewest names around them are it.
        self.main = min((b.main for b in self.blocks if b.main and not b.noise), default=0)

    def surroundings(self) -> dict[int, int]:
        """For each node the digest of the text outside its branches: of the main element's text if it lies in that."""
        below = dict.fromkeys([0, *self.parents], 0)
        total = whole = 0
        for b in self.blocks:
            if not b.noise:
                below[b.node] += b.digest
                whole += b.digest
                total += b.digest if b.main == self.main else 0
        for node, parent in reversed(self.parents.items()):
            below[parent] += below[node]
        return {node: ((total if node in self.inside else whole) - inner) & MASK for node, inner in below.items()}

    def shares(self) -> dict[int, float]:
        """For each node what share of the text of the main element, or of the page without one, its branches hold."""
        held, total = dict.fromkeys([0, *self.parents], 0), 0
        for b in self.blocks:
            if not b.noise and b.main == self.main:
                held[b.node] += len(b.text)
                total += len(b.text)
        for node, parent in reversed(self.parents.items()):
            held[parent] += held[node]
        return {node: n / total if total else 0.0 for node, n in held.items()}

    def asked(self) -> set[int]:
        """Nodes that decide on the blocks of the page's text: from each block up to the main element, or to the root."""
        out: set[int] = set()
        for b in self.blocks:
            node = b.node
            while not b.noise and b.main == self.main and node not in (0, b.top) and node not in out:
                out.add(node)
                node = self.parents[node]
        return out

    def _flush(self, glue: bool = False) -> None:
        if self._text:
            text = "".join(self._text)
            if text.isspace():
                if glue:
                    self._text = [text]
                    return
            else:
                top = self._open[-1]
                digest = xxhash.xxh3_64_intdigest(text)
                top.content = top.content * 0x9E3779B97F4A7C15 + digest & MASK
                self.blocks.append(Block(text, digest, top.node, top.noise, top.main, top.top, self._glue))
                self._glue = glue
            self._text = []
        self._glue = self._glue and glue

    def _pop(self) -> None:
        done = self._open.pop()
        if self._open:
            above = self._open[-1]
            if done.content:
                above.content = xxhash.xxh3_64_intdigest(done.content.to_bytes(8, "little"), above.content)
            if not done.branch:
                above.children = done.children
        if done.branch and not done.noise:
            self.contents.add((done.node, done.content))
            if done.children:
                self.styles.add((done.node, done.children))

    def _down_to(self, at: int) -> None:
        self._flush()
        while len(self._open) > at:
            self._pop()

    def _nearest_block(self) -> int:
        at = len(self._open) - 1
        while self._open[at].inline:
            at -= 1
        return at

    def _begin(self, name: str, attributes: str) -> None:
        if name == "br" or name in VOID:
            if name not in INLINE:
                self._flush()
            return
        label, named = _kind(name, attributes)
        inline = name in INLINE
        if inline:
            if named:
                self._flush(True)
        else:
            self._flush()
            near = self._nearest_block()
            if self._open[near].name == name and name in CLOSES_ITSELF or self._open[near].name == "p":
                self._down_to(near)
        above = self._open[-1]
        node, branch, noise = above.node, named != PLAIN or not inline, above.noise or name in DROPPED
        if branch:
            node = xxhash.xxh3_64_intdigest(label, above.node) >> 3 << 2 | named
            if not noise:
                self.parents[node] = above.node
                if above.main:
                    self.inside.add(node)
            above.children = xxhash.xxh3_64_intdigest(label, above.children) if label != "p" or above.children == 0 else above.children
        main, top = above.main, above.top
        if not main and name in MAIN:
            main, top = above.names + 1, node
        element = Element(name, node, noise, above.names + (named != PLAIN), main, top, inline, branch)
        element.children = 0 if branch else above.children
        self._open.append(element)

    def _end(self, name: str) -> None:
        if name == "br":
            self._flush()
            return
        inline = name in INLINE
        for at in range(len(self._open) - 1, 0, -1):
            if self._open[at].name == name:
                if not inline:
                    self._down_to(at)
                    return
                if any(x.branch for x in self._open[at:]):
                    self._flush(True)
                while len(self._open) > at:
                    self._pop()
                return
            if inline and not self._open[at].inline:
                return
        if not inline:
            self._flush()


@functools.cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.IGNORECASE)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def parsed(pages: DataFrame) -> DataFrame:
    """Style-tree entries of pages (host, html): host (hashed), page (digest of the html), entries (array of node, kind, value), asked.

    Kind 0 is the digest of a branch's text, 1 that of its children, 2 that of the text around it; the last once a node and page.
    ``asked`` lists the nodes that decide on the page's text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 2)):
            node, kind, value, ends, asked = [], [], [], [0], []
            for source in batch.column(2).to_pylist():
                page = Page(source)
                for number, found in enumerate((page.contents, page.styles, page.surroundings().items())):
                    for at, digest in found:
                        node.append(at)
                        value.append(_signed(digest))
                    kind += [number] * len(found)
                ends.append(len(node))
                asked.append(list(page.asked()))
            entries = pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.array(kind, pa.int32()), pa.array(value, pa.int64())], ["node", "kind", "value"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists, pa.array(asked, pa.list_(pa.int64()))], names=["host", "page", "entries", "asked"]
            )

    keyed = pages.select(F.xxhash64("host").alias("host"), F.md5("html").alias("page"), "html")
    return keyed.mapInArrow(run, "host long, page string, entries array<struct<node:long, kind:int, value:long>>, asked array<long>")


def style_trees(pages: DataFrame) -> DataFrame:
    """Importance of every node of every host's merged tree, from pages (host, html); see ``importances``."""
    return importances(parsed(pages))


def importances(entries: DataFrame) -> DataFrame:
    """host, node, pages, host_pages, importance, own, around: of every node of every host's merged tree, from parsed pages.

    For the m pages that have a node, its content importance (``own``) is 1 minus the mean, over its different contents, of the
    entropy log(pages with the content) / log(m): unique contents are important, a text on all pages is not. Its presentation
    importance is the entropy to the base m of its different sequences of children, l of them. Both join as
    (1 - d**l) * presentation + d**l * content with d = ``DAMPING``. A node of one page has importance 1. ``around`` is the content
    importance of the text outside the node on the same pages: on copies of one page it is 0, whatever is repeated there.
    Counts combine before every shuffle, so a host with a third of all pages is no hot key.
    """
    rows = entries.select("host", F.inline("entries"))
    values = rows.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("c"))
    content, style, outside = F.col("kind") == 0, F.col("kind") == 1, F.col("kind") == 2
    nodes = values.groupBy("host", "node").agg(
        F.sum(F.when(outside, F.col("c"))).alias("pages"), F.avg(F.when(content, F.ln("c"))).alias("ln_c"), F.count_if(style).alias("styles"),
        F.sum(F.when(style, F.col("c"))).alias("total"), F.sum(F.when(style, F.col("c") * F.ln("c"))).alias("c_ln_c"),
        F.avg(F.when(outside, F.ln("c"))).alias("ln_around"),
    )
    base = F.ln(F.greatest("pages", F.lit(2)))
    nodes = nodes.withColumns({"own": 1 - F.least(F.lit(1.0), F.col("ln_c") / base), "around": 1 - F.least(F.lit(1.0), F.col("ln_around") / base)})
    variety = F.when(F.col("styles") > 0, F.least(F.lit(1.0), (F.ln("total") - F.col("c_ln_c") / F.col("total")) / base)).otherwise(0.0)
    weight = F.pow(F.lit(DAMPING), F.col("styles"))
    scored = nodes.withColumn("importance", F.when(F.col("pages") > 1, (1 - weight) * variety + weight * F.col("own")).otherwise(1.0))
    roots = nodes.filter("node = 0").select("host", F.col("pages").alias("host_pages"))
    return scored.join(roots, "host").select("host", "node", "pages", "host_pages", "importance", "own", "around")


def judged_branches(trees: DataFrame) -> DataFrame:
    """host, node, verdict: the nodes whose branches go.

    A branch goes if it is of little importance, content included, on enough pages that differ elsewhere. One that is named as
    noise goes at a higher importance already.
    """
    named, poor = F.col("node").bitwiseAND(3) != PLAIN, F.greatest("importance", "own") < LEAST_IMPORTANCE
    goes = F.when(named, F.col("own") < NAMED_IMPORTANCE).otherwise(poor)
    known = trees.filter((F.col("pages") >= LEAST_PAGES) & (F.col("around") >= LEAST_IMPORTANCE) & (F.col("node") != 0))
    return known.filter(goes).select("host", "node", F.col("node").alias("verdict"))


def text_of(source: str | None, verdicts: frozenset[int] = frozenset()) -> str:
    """Blocks of the page's main element, or of the whole page if it has none, without noise and dropped branches.

    A branch that a name covers goes too, unless it holds nearly all of that text, or all would go.
    """
    page = Page(source)
    shares = page.shares()
    bound = {NAMED: NAMED_SHARE, READERS: READERS_SHARE}
    gone: dict[tuple[int, int], bool] = {}

    def lost(b: Block, names: bool) -> bool:
        chain, node = [], b.node
        while node not in (0, b.top) and (node, b.top) not in gone:
            chain.append(node)
            node = page.parents[node]
        state = gone.get((node, b.top), False)
        for node in reversed(chain):
            covered = names and node & 3 and shares[node] <= bound[node & 3]
            state = gone[node, b.top] = state or node in verdicts or bool(covered)
        return state

    for names in (True, False):
        gone.clear()
        lines: list[str] = []
        last = False
        for b in page.blocks:
            kept = not b.noise and b.main == page.main and not lost(b, names)
            if kept and last and b.glued:
                lines[-1] += b.text
            elif kept:
                lines.append(b.text)
            last = kept
        out = [SPACE.sub(" ", html.unescape(x) if "&" in x else x).strip() for x in lines]
        if any(out):
            break
    return "\n".join(x for x in out if x)


def host_of(url: Column) -> Column:
    """Lower-case host of an address; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of web pages (``page_id``, ``url``, ``html``); screening itself has no such records, so these stay general.

    The style trees of all hosts are built from all pages first; then each page loses branches that its host's tree holds of
    little importance, and parts that tags name as navigation, header, footer, aside, form and so on. Readers' comments, notices
    and adverts differ from page to page, so no entropy tells them from an article; a class, id or role that names a branch so makes
    it go, inside main elements too, unless it holds more than ``NAMED_SHARE`` (comments: ``READERS_SHARE``) of the text there; such
    a branch goes if the tree finds its content of little importance. A page with an article or main element gives that element's
    text, whatever the branches around it are named. Copies of an article are articles: nothing goes for being alike on pages that are
    alike around it too. Character references are decoded, white space inside a block becomes one blank, blocks follow each other
    in page order with a line feed between.
    Returns page_id, url, text, n_chars (code points). Null or empty html: an empty text. A url that is null or has no host joins
    the pages without host. Repeated rows give repeated results; other columns are not used; no rows in, none out.
    """
    hosted = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    entries = stored(parsed(hosted), "entries")
    judged = stored(judged_branches(importances(entries)), "branches")
    nodes = entries.select("host", "page", F.explode("asked").alias("node"))
    verdicts = stored(nodes.join(judged, ["host", "node"]).groupBy("host", "page").agg(F.collect_set("verdict").alias("verdicts")), "verdicts")

    @F.arrow_udf("string")
    def run(sources: pa.Array, verdicts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([sources, verdicts], names=["s", "v"])
        out: list[str] = []
        for part in portions(batch, 0):
            lists = part.column(1).to_pylist()
            out += [text_of(s, frozenset(v or ())) for s, v in zip(part.column(0).to_pylist(), lists, strict=True)]
        return pa.array(out, pa.string())

    keyed = hosted.withColumns({"host": F.xxhash64("host"), "page": F.md5("html")}).join(verdicts, ["host", "page"], "left")
    return keyed.select("page_id", "url", run("html", "verdicts").alias("text")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
