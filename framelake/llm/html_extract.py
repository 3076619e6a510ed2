"""Main text of web pages by wrapper induction over the pages of a host.

Each page's tree is reduced to a skeleton of its blocks and marked elements (those with a class, id or role), in which
neighbouring siblings of one label are one node. All distinct skeletons of a host are folded into its wrapper by simple
tree matching (Yang 1991): matched nodes are one node of the wrapper, unmatched ones join it. Over the host's pages,
each wrapper node then has a count of pages and of distinct texts. Nodes whose texts hardly vary are template; those
that vary are content slots, and a page's main text is that of its content slots. Pages of one skeleton and one text
(that of the article, if there is one) count once, whatever their address, adverts and markup.

Regions that vary from page to page and are no content all the same (menus, headers, footers, sidebars, adverts,
notices, forms, comments) are known by tag, class or role. What holds the main element, or an article with its heading,
is never one of these by its class alone; nor, within an article or on a page without one, is a region that holds more
than half of the text, if not by a name of comments: ``layout has-sidebar`` is a page. A form around an article is no region of its own. Where names leave
no text at all, those regions are content that hold most of it. Within an article or main element, plain elements are
content: a passage that several articles share is still text of each. There, marked elements are content or template as
the wrapper has it; a class name alone leaves out a container only, and only if all its parts are names of the list or
say no more than that it is a box: ``comment-list``, not ``related-work``.

The pages are parsed twice, for the skeletons and for the text; what is shuffled is skeletons and hashes, those of all
pages once to find the copies. A host's pages are never gathered: skeletons and texts are counted by grouped sums; a
host's distinct skeletons are dealt out by hash into ``FOLDS`` parts, each folded in sorted order, and then the parts,
so a host of very many layouts is spread over tasks too. Matching costs no more than ``MAX_KIDS`` squared a pair of
nodes: where a node has more runs of siblings, those of one tag are one. A wrapper has up to ``MAX_NODES`` nodes, and a
skeleton ``MAX_DEPTH`` levels; what lies beyond has no evidence against it and is content, if its region is not named.

Defined results: null or empty html gives an empty text; a page without host is extracted without a wrapper, as is a
host of fewer than ``MIN_PAGES`` distinct pages, and a page on which all text is template; repeated rows each get their
text; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import fresh, materialize, pieces
from framelake.llm.dom import Node, parse

#: A wrapper node seen on so many pages is template if at most this share of its texts are distinct.
MIN_PAGES, MAX_DISTINCT = 3, 0.34
#: Parts of a host's distinct skeletons that are folded each for itself.
FOLDS = 64
#: Levels of a skeleton, runs of siblings below one node of it, and nodes of a wrapper.
MAX_DEPTH, MAX_KIDS, MAX_NODES = 200, 64, 4096

# Elements and name parts that mark regions which are no main text, and elements that make blocks.
NO_CONTENT = frozenset("head script style noscript template nav footer aside form iframe object svg canvas math button select textarea dialog menu audio video map input label fieldset".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog toolbar".split())
NO_CONTENT_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side aside menu nav navbar navigation breadcrumb
breadcrumbs footer header masthead topbar comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr notice notices alert newsletter subscribe signup
popup modal overlay share sharing social related recommended recommendations widget widgets toolbar pagination pager paging skip login search tags""".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main
ol p pre section summary table tbody td tfoot th thead tr ul caption""".split())
PROTECTED = frozenset(("article", "main"))
#: Within an article these are left out by their class.
CONTAINERS = frozenset("div section ul ol dl table span figure p".split())
#: Of paragraphs, only those with such a name.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: What a class says beside the name of a region, within an article.
BOXES = frozenset("list slot block wrapper wrap container inner outer section area form item items unit thread group body content label bar links top bottom left right".split())
#: Regions of readers' comments, however much text they hold.
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
#: A region that holds more than this share of the text it stands in is not left out by its class.
MOST = 0.5


def _holders(root: Node) -> set[int]:
    """The id() of the nodes that are or hold a main element, or an article with a heading of the first rank, and of forms that hold any article."""
    order: list[tuple] = [(root, None, None)]
    seeds, found = [], set()
    for k, (node, _, article) in enumerate(order):  # grows while it is read
        within = k if node.tag == "article" else article
        if node.tag == "main":
            seeds.append(k)
        elif node.tag == "h1" and within is not None:
            seeds.append(within)
        elif node.tag == "article":
            above = order[k][1]
            while above is not None:
                if order[above][0].tag in ("form", "fieldset"):
                    found.add(id(order[above][0]))
                above = order[above][1]
        order.extend((c, k, within) for c in node.children if isinstance(c, Node))
    done = set()
    for k in seeds:
        while k is not None and k not in done:
            done.add(k)
            found.add(id(order[k][0]))
            k = order[k][1]
    return found


def _is_region(name: str, protected: bool) -> bool:
    """Whether a class is the name of a region that is no content."""
    if not protected:
        return any(part in NO_CONTENT_NAMES for part in re.split(r"[^a-z]+", name)) or "comment" in name or "sidebar" in name or "advert" in name
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    return name != "header" and any(x in NO_CONTENT_NAMES for x in parts) and all(x in NO_CONTENT_NAMES or x in BOXES for x in parts)


def _of_comments(name: str) -> bool:
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    return any(x in COMMENTS for x in parts) and all(x in COMMENTS or x in BOXES for x in parts)


def _named_no_content(node: Node, protected: bool, holders: set[int], share: float) -> bool:
    """``share``: of the text that the node stands in, what it holds."""
    if node.tag in NO_CONTENT or (node.tag == "header" and not protected):
        return not (node.tag in ("form", "fieldset") and id(node) in holders)
    if not node.attrs or node.tag in PROTECTED or node.tag in ("html", "body"):
        return False
    a = node.attrs
    if a.get("role", "").lower() in NO_CONTENT_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if id(node) in holders or (protected and node.tag not in CONTAINERS):
        return False
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    if node.tag == "p" and protected:
        names = [x for x in names if ADVERTS.intersection(re.split(r"[^a-z]+", x))]
    return any(_is_region(x, protected) and (share <= MOST or _of_comments(x)) for x in names)


def _elements(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in node.children if isinstance(c, Node))


def _text_sizes(root: Node) -> dict[int, int]:
    """The id() of each node with the characters of text it holds, but for what is left out by its tag."""
    sizes: dict[int, int] = {}
    order: list[tuple[Node, int | None]] = [(root, None)]
    for node, _ in order:  # grows while it is read
        sizes[id(node)] = sum(len(c.strip()) for c in node.children if isinstance(c, str)) if node.tag not in NO_CONTENT or node.tag in ("form", "fieldset") else 0
        if node.tag not in NO_CONTENT or node.tag in ("form", "fieldset"):
            order.extend((c, id(node)) for c in node.children if isinstance(c, Node))
    for node, above in reversed(order):
        if above is not None:
            sizes[above] += sizes[id(node)]
    return sizes


def _marked(node: Node) -> bool:
    return bool(node.attrs and (node.attrs.get("class") or node.attrs.get("id") or node.attrs.get("role")))


def _is_slot(node: Node) -> bool:
    """Whether an element has a node in the skeleton; the text of others belongs to what they stand in."""
    return node.tag in BLOCKS or _marked(node)


class Skeleton:
    """A tree of labels; ``kids`` are skeletons, ``nodes`` the page's nodes behind each, ``key`` tells equal trees."""

    __slots__ = ("key", "kids", "label", "nodes")

    def __init__(self, label: str, kids: list | None = None):
        self.label, self.kids, self.nodes, self.key = label, kids or [], [], None

    def to_list(self) -> list:
        return [self.label, [k.to_list() for k in self.kids]]

    @staticmethod
    def of_list(x: list) -> Skeleton:
        return Skeleton(x[0], [Skeleton.of_list(k) for k in x[1]])

    def walk(self) -> Iterator[Skeleton]:
        stack = [self]
        while stack:
            s = stack.pop()
            yield s
            stack.extend(reversed(s.kids))

    def set_keys(self) -> None:
        for s in reversed(list(self.walk())):
            s.key = hash((s.label, *(k.key for k in s.kids)))


def _within(node: Node) -> tuple[list[str], list[Node]]:
    """The texts that belong to an element, and the slots next below it."""
    texts, slots, stack = [], [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            texts.append(x)
        elif _is_slot(x):
            slots.append(x)
        elif x.tag not in NO_CONTENT:
            stack.extend(reversed(x.children))
    return texts, slots


def skeleton(root: Node) -> Skeleton:
    top = Skeleton("#root")
    top.nodes = [root]
    stack = [(top, 0)]
    while stack:
        s, depth = stack.pop()
        if depth == MAX_DEPTH:
            continue
        for child in (x for node in s.nodes if node.tag not in NO_CONTENT for x in _within(node)[1]):
            label = child.label()
            if not s.kids or s.kids[-1].label != label:
                s.kids.append(Skeleton(label))
            s.kids[-1].nodes.append(child)
        if len(s.kids) > MAX_KIDS:
            by_tag: dict[str, Skeleton] = {}
            for k in s.kids:
                tag = k.label.split(".")[0]
                by_tag.setdefault(tag, Skeleton(tag)).nodes.extend(k.nodes)
            s.kids = list(by_tag.values())
        stack.extend((k, depth + 1) for k in s.kids)
    return top


def tree_match(a: Skeleton, b: Skeleton) -> tuple[int, list[tuple[Skeleton, Skeleton]]]:
    """Simple tree matching: the most pairs of equal labels that keep order and descent, as their number and the pairs."""
    if a.label != b.label:
        return 0, []
    if a.key is not None and a.key == b.key:
        pairs = list(zip(a.walk(), b.walk(), strict=True))
        return len(pairs), pairs
    if [k.label for k in a.kids] == [k.label for k in b.kids]:
        got = [tree_match(x, y) for x, y in zip(a.kids, b.kids, strict=True)]
        return 1 + sum(g[0] for g in got), [(a, b), *(p for g in got for p in g[1])]
    m, n = len(a.kids), len(b.kids)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    part: dict[tuple[int, int], tuple] = {}
    for i in range(m):
        for j in range(n):
            if a.kids[i].label == b.kids[j].label:
                part[i, j] = tree_match(a.kids[i], b.kids[j])
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + part.get((i, j), (0,))[0])
    i, j, pairs = m, n, []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs[:0] = part[i - 1, j - 1][1]
            i, j = i - 1, j - 1
    return 1 + best[m][n], [(a, b), *pairs]


def fold(wrapper: Skeleton, page: Skeleton) -> None:
    """Aligns a skeleton with the wrapper; nodes without a match join it beside their matched neighbours."""
    for tree in (wrapper, page):
        tree.set_keys()
    matched = {id(p): w for w, p in tree_match(wrapper, page)[1]}
    room = MAX_NODES - sum(1 for _ in wrapper.walk())
    for p in [x for x in page.walk() if id(x) in matched]:
        w, at = matched[id(p)], 0
        place = {id(x): i for i, x in enumerate(w.kids)}
        joining: list[tuple[int, Skeleton]] = []
        for k in p.kids:
            if id(k) in matched:
                at = place[id(matched[id(k)])] + 1
            elif (n := sum(1 for _ in k.walk())) <= room and len(w.kids) + len(joining) < 4 * MAX_KIDS:
                room -= n
                joining.append((at, Skeleton.of_list(k.to_list())))
        for at, k in reversed(joining):
            w.kids.insert(at, k)


def align(wrapper: Skeleton, page: Skeleton) -> list[int]:
    """For each node of the page's skeleton, in walking order, the number of its wrapper node, -1 without one."""
    for tree in (wrapper, page):
        tree.set_keys()
    number = {id(w): i for i, w in enumerate(wrapper.walk())}
    matched = {id(p): number[id(w)] for w, p in tree_match(wrapper, page)[1]}
    return [matched.get(id(p), -1) for p in page.walk()]


def _own_text(s: Skeleton) -> str:
    return " ".join(" ".join(text for node in s.nodes if node.tag not in NO_CONTENT for text in _within(node)[0]).split())


def extract(root: Node, template: frozenset[int] = frozenset()) -> str:
    """The blocks of main text of a tree, a line each. ``template``: the id() of nodes that are template."""
    holders, sizes = _holders(root), _text_sizes(root)
    text = _extract(root, template, holders, sizes)
    if text or not sizes[id(root)]:
        return text
    # the names leave nothing: what holds most of the text is content
    most = {k for k, n in sizes.items() if n >= MOST * sizes[id(root)]}
    return _extract(root, template, holders | most, sizes)


def _extract(root: Node, template: frozenset[int], holders: set[int], sizes: dict[int, int]) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        if text := " ".join("".join(run).split()):
            blocks.append(text)
        run.clear()

    articles = any(node.tag in PROTECTED for node in _elements(root))  # beside one, a long advert is no page
    # protected: within an article. plain: with no marked element between. own: text of what it stands in is content. scope: text of the page or article
    stack: list = [(root, False, False, True, 0 if articles else sizes[id(root)])]
    while stack:
        item, protected, plain, own, scope = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            run.append(item)
        elif not _named_no_content(item, protected, holders, sizes.get(id(item), 0) / scope if scope else 0.0):
            if item.tag in PROTECTED:
                protected = plain = own = True
                scope = sizes.get(id(item), 0)
            elif protected and item.tag == "h1":
                own = True
            elif _is_slot(item):
                plain = plain and not _marked(item)
                own = plain or id(item) not in template
            block = item.tag in BLOCKS
            if block:
                end()
                stack.append((None, protected, plain, own, scope))
            elif item.tag == "br":
                run.append(" ")
            stack.extend((c, protected, plain, own, scope) for c in reversed(item.children) if own or isinstance(c, Node))
    end()
    return "\n".join(blocks)


def _host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _vote(root: Node) -> str:
    """The words that make a page distinct: those of its article or main elements, or else of the page."""
    found, main, stack = [], [], [(root, False)]
    while stack:
        x, within = stack.pop()
        if isinstance(x, str):
            (main if within else found).extend(x.split())
        elif x.tag not in NO_CONTENT:
            within = within or x.tag in PROTECTED
            stack.extend((c, within) for c in reversed(x.children))
    return " ".join(main or found)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page's host, skeleton, the hash of each skeleton node's own text (0 for none) and of the whole text."""
    for batch in pieces(batches, 1):
        shapes, hashes, wholes = [], [], []
        for page in batch.column(1).to_pylist():
            root = parse(page or "")
            s = skeleton(root)
            wholes.append(xxhash.xxh3_128_digest(_vote(root).encode("utf-8", "surrogatepass")))
            shapes.append(json.dumps(s.to_list(), separators=(",", ":")))
            hashes.append([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) if (t := _own_text(x)) else 0 for x in s.walk()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(wholes, pa.binary())], ["host", "shape", "texts", "whole"])


def _fold_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, part, shape) sorted by part, each part's wrapper."""
    key, wrapper = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"host": key[0], "wrapper": json.dumps(wrapper.to_list(), separators=(",", ":"))}])

    for batch in batches:
        for host, part, shape in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            page = Skeleton.of_list(json.loads(shape))
            if key == (host, part):
                fold(wrapper, page)
                continue
            if key is not None:
                yield out()
            key, wrapper = (host, part), page
    if key is not None:
        yield out()


def _align_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [align(Skeleton.of_list(json.loads(w)), Skeleton.of_list(json.loads(s))) for s, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["host", "shape", "slots"])


def induce_wrappers(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, max_distinct: float = MAX_DISTINCT) -> DataFrame:
    """``host``, ``wrapper`` (a tree of labels) and ``template``: the wrapper's nodes, in walking order, that are template."""
    rows = pages.select(_host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html")).where("host IS NOT NULL")
    seen = materialize(rows.mapInArrow(_shapes, "host string, shape string, texts array<bigint>, whole binary").distinct().drop("whole"))
    shapes = materialize(seen.groupBy("host", "shape").agg(F.count("*").alias("n")))
    part = F.pmod(F.xxhash64("shape"), F.lit(FOLDS)).cast("int").alias("part")
    dealt = shapes.select("host", part, "n", "shape").repartition("host", "part").sortWithinPartitions("host", "part", F.desc("n"), "shape")
    parts = dealt.select("host", "part", "shape").mapInArrow(_fold_parts, "host string, wrapper string")
    gathered = parts.repartition("host").sortWithinPartitions("host", "wrapper").select("host", F.lit(0).alias("part"), "wrapper")
    wrappers = materialize(gathered.mapInArrow(_fold_parts, "host string, wrapper string"))
    slots = shapes.join(wrappers, "host").select("host", "shape", "wrapper").mapInArrow(_align_shapes, "host string, shape string, slots array<int>")
    texts = seen.join(slots, ["host", "shape"]).select("host", F.explode(F.arrays_zip("slots", "texts")).alias("x")).select("host", "x.slots", "x.texts").where("slots >= 0 AND texts != 0")
    kinds = texts.groupBy("host", "slots", "texts").agg(F.count("*").alias("n")).groupBy("host", "slots").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    fixed = kinds.where((F.col("n") >= min_pages) & (F.col("kinds") <= max_distinct * F.col("n"))).groupBy("host").agg(F.sort_array(F.collect_list("slots")).alias("template"))
    return materialize(wrappers.join(fixed, "host"))


def _extractor(html_at: int, into: str):
    """Reads rows with a wrapper and its template in the last two columns; gives them with the text instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, Skeleton] = {}
        slots: dict[tuple[str, str], list[int]] = {}
        for batch in pieces(batches, html_at):
            texts = []
            columns = (batch.column(k).to_pylist() for k in (html_at, batch.num_columns - 2, batch.num_columns - 1))
            for page, wrapper, fixed in zip(*columns, strict=True):
                root, template = parse(page or ""), set()
                if wrapper is not None and fixed:
                    s = skeleton(root)
                    key = wrapper, json.dumps(s.to_list(), separators=(",", ":"))
                    if key not in slots:
                        if len(slots) >= 1000:
                            slots.clear()
                            wrappers.clear()
                        if wrapper not in wrappers:
                            wrappers[wrapper] = Skeleton.of_list(json.loads(wrapper))
                        slots[key] = align(wrappers[wrapper], s)
                    known = set(fixed)
                    template = {id(node) for slot, x in zip(slots[key], s.walk(), strict=True) if slot in known for node in x.nodes}
                texts.append(extract(root, frozenset(template)) or (extract(root) if template else ""))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], [*batch.schema.names[:-2], into])

    return run


def main_text(pages: DataFrame, url: str = "url", html: str = "html", into: str = "main_text") -> DataFrame:
    """``pages`` with one more column (or another in the place of one of its name): the page's main text.

    Wrappers have a row a host; Spark broadcasts them if they are small and else joins by host, splitting large ones.
    """
    pages = pages.drop(into)
    name = fresh(pages.columns, "_wrap")
    wrappers = induce_wrappers(pages, url, html).select(F.col("host").alias(f"{name}host"), F.col("wrapper").alias(f"{name}tree"), F.col("template").alias(f"{name}fixed"))
    rows = pages.withColumn(f"{name}own", _host(F.col(f"`{url}`"))).join(wrappers, F.col(f"{name}own") == F.col(f"{name}host"), "left")
    rows = rows.select(*[F.col(f"`{c}`") for c in pages.columns], f"{name}tree", f"{name}fixed")
    return rows.mapInArrow(_extractor(pages.columns.index(html), into), pages.withColumn(into, F.lit("")).schema)
