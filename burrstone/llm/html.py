"""Main text of web pages by wrapper induction.

The block elements of a page form a tree. For every host one page is the reference; each page of the host is aligned
with it by simple tree matching, and each pair of matched nodes votes on whether the texts they hold themselves are the
same; copies of a page vote once, the reference not at all. Nodes that most pages voted on and that are the same on
nearly all of those become the host's template, on every page that has their text; the others are its slots. A page is
then aligned with its host's template: its content is all that is neither template nor of a kind that is never content
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments; by element, role or
class), on pages that mark an article only what is in it. Inside articles nodes are aligned and voted on too, but not by
pages whose article has most of its text in common with the reference's: those are copies or editions of one another.

Only trees (labels, text hashes and sizes) are shuffled, summed by host before the shuffle, so a host with a third of
all pages is no large group. Templates go to the scan of the pages if they are at most SENT_BYTES; otherwise pages are
joined with them by host.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones
left out, and joined in page order by a blank line. A line break inside a block is white space.

Cases: null and empty html has the empty text; a null url is a host of its own; unclosed and stray tags are read as
browsers do for blocks; repeated rows are answered each; hosts with fewer than LEAST_PAGES distinct pages have no template;
an empty table gives no rows; other columns are not read; pages of any length are parsed whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Distinct pages that a host needs for a template, and the share of aligned pages on which a template node is the same.
LEAST_PAGES, SAME_SHARE = 3, 0.8
#: Templates are broadcast up to this size.
SENT_BYTES = 32 << 20
#: Elements whose text is not parsed.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never close.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Block elements: they end a block of text and are nodes of the tree.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary svg "
    "table tbody td template tfoot th thead tr ul".split()
)
#: Elements that are never content.
NEVER = RAW | frozenset("aside button dialog footer form head header menu nav noscript search select svg template".split())
#: Roles and words of classes and ids that are never content.
NEVER_ROLES = frozenset("alert banner complementary contentinfo dialog menu menubar navigation search".split())
NEVER_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "promotion reaction reactions related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: What an opening tag closes if it is open: element to the elements closed, up to the elements that stop the search.
_ENDS_P = BLOCKS - frozenset("body button caption dd dt head html legend li option select svg summary tbody td template tfoot th thead tr noscript".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _never(tag: str, attributes: str) -> bool:
    """Whether an element is of a kind that is never content."""
    if tag in NEVER:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "role" and value.lower() in NEVER_ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        if name in ("class", "id") and tag not in ("html", "body") and any(w.lower() in NEVER_WORDS for w in _WORDS.findall(value)):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _label(tag: str, attributes: str) -> str:
    """Element and classes; a long list of classes by its hash, so that only equal lists are equal labels."""
    classes = " ".join(sorted(re.findall(r"""class\s*=\s*["']?([^"'>]*)""", attributes)))
    return f"{tag}.{classes if len(classes) <= 60 else xxhash.xxh3_128_hexdigest(classes)}"


class Page:
    """A parsed page: nodes (label, parent, inside an article, never content) and blocks (node, text)."""

    def __init__(self, html: str | None):
        self.labels, self.parents = ["#"], [-1]
        self.article, self.never = [False], [False]
        self.blocks: list[tuple[int, str]] = []
        self._parse(html or "")

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]
        text: list[str] = []
        at = 0

        def flush() -> None:
            if text:
                block = " ".join(unescape("".join(text)).split())
                if block:
                    self.blocks.append((stack[-1][1], block))
                text.clear()

        def close(to: int) -> None:
            flush()
            del stack[to:]

        pos = 0
        size = len(html)
        # An inline element that is never content: its name and how many of that name are open in it.
        skip: list = ["", 0]
        while pos < size:
            m = _TAG.search(html, pos)
            if m is None:
                if not skip[1]:
                    text.append(html[pos:])
                break
            at = m.start()
            if at > pos and not skip[1]:
                text.append(html[pos:at])
            pos = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if skip[1]:
                if tag in BLOCKS:
                    skip[1] = 0
                elif tag == skip[0]:
                    skip[1] += -1 if m.group(1) else 1
                    continue
            if m.group(1):
                if tag in BLOCKS:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            close(k)
                            break
                    else:
                        flush()
                continue
            attributes = m.group(3)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, pos)
                pos = end.start() if end else size
                continue
            if tag == "br":
                text.append(" ")
                continue
            never = _never(tag, attributes)
            if tag not in BLOCKS:  # inline elements are part of their block
                if never and tag not in VOID and not skip[1]:
                    skip = [tag, 1]
                continue
            closes, stops = _CLOSES.get(tag, ((), ()))
            if tag in _ENDS_P:
                closes, stops = {"p"}, frozenset({"article", "main", "div", "section", "td", "th", "li", "blockquote", "body", "button"})
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    close(k)
                    break
                if stack[k][0] in stops:
                    break
            flush()
            if tag in VOID:
                continue
            parent = stack[-1][1]
            inside = self.article[parent] or tag in ("article", "main")
            # Around an article no class counts; in it and beside it every kind does.
            self.labels.append(_label(tag, attributes))
            self.parents.append(parent)
            self.article.append(inside)
            root = tag in ("article", "main") and not self.article[parent]
            self.never.append(self.never[parent] if not never else not root or self.never[parent])
            if root:
                self.never[-1] = False
            stack.append((tag, len(self.labels) - 1))
        flush()

    def outline(self) -> tuple[list[str], list[int], list[int], list[int]]:
        """Of each node the label, the parent, the hash of the text that it holds itself, and the length of that text if
        it is an article's content."""
        own: dict[int, list[str]] = {}
        for node, text in self.blocks:
            own.setdefault(node, []).append(text)
        n = range(len(self.labels))
        hashes = [xxhash.xxh3_64_intdigest("\n".join(own[k])) - (1 << 63) if k in own else 0 for k in n]
        sizes = [sum(map(len, own[k])) if k in own and self.article[k] and not self.never[k] else 0 for k in n]
        return self.labels, self.parents, hashes, sizes

    def text(self, template: set[int]) -> str:
        """The blocks of the content; template has the numbers of nodes that are the host's template."""
        article = any(self.article[node] for node, _ in self.blocks)
        return "\n\n".join(t for node, t in self.blocks if not self.never[node] and node not in template and (self.article[node] or not article))


def match(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Simple tree matching of two outlines (labels, parents and, if given, text hashes): pairs of nodes of a largest
    order-keeping match from the roots down, and of those one with the most equal texts."""

    def kids(parents: list[int]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in parents]
        for k, p in enumerate(parents):
            if p >= 0:
                out[p].append(k)
        return out

    if not a[0] or not b[0] or a[0][0] != b[0][0]:
        return []
    ka, kb = kids(a[1]), kids(b[1])
    number: dict[str, int] = {}
    la, lb = (np.array([number.setdefault(x, len(number)) for x in t[0]]) for t in (a, b))
    ha, hb = (np.array(t[2] if len(t) > 2 else [0] * len(t[0]), np.int64) for t in (a, b))
    # A node more counts more than all equal texts.
    node = min(len(la), len(lb)) + 1
    weights: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], np.ndarray] = {}
    # Children come after their parents, so pairs are worked off from the last by a stack, not by recursion.
    todo = [(0, 0, False)]
    while todo:
        u, v, ready = todo.pop()
        if (u, v) in weights:
            continue
        own = node + int(ha[u] == hb[v] != 0)
        if not ka[u] or not kb[v]:
            weights[u, v] = own
            continue
        left, right = ka[u], kb[v]
        inner = [(i, j) for i, x in enumerate(left) if ka[x] for j, y in enumerate(right) if kb[y] and la[x] == lb[y]]
        if not ready:
            todo.append((u, v, True))
            todo.extend((left[i], right[j], False) for i, j in inner)
            continue
        rows = np.zeros((len(left) + 1, len(right) + 1), np.int64)
        deep: dict[int, list[tuple[int, int]]] = {}
        for i, j in inner:
            deep.setdefault(i, []).append((j, weights[left[i], right[j]]))
        lr, hr = lb[right], hb[right]
        for i, x in enumerate(left):
            w = np.where(lr == la[x], node + ((hr == ha[x]) & (hr != 0)), 0)
            for j, value in deep.get(i, ()):
                w[j] = value
            rows[i + 1, 1:] = np.maximum.accumulate(np.maximum(rows[i, 1:], rows[i, :-1] + w))
        tables[u, v] = rows
        weights[u, v] = own + int(rows[-1, -1])
    pairs, todo = [], [(0, 0)]
    while todo:
        u, v = todo.pop()
        pairs.append((u, v))
        rows = tables.get((u, v))
        if rows is None:
            continue
        i, j = len(ka[u]), len(kb[v])
        while i and j:
            if rows[i, j] == rows[i, j - 1]:
                j -= 1
            elif rows[i, j] == rows[i - 1, j]:
                i -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((ka[u][i], kb[v][j]))
    return pairs


def host_of(url_col: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _large(counts: DataFrame) -> DataFrame:
    """host, blocks: of (host, n) rows those hosts with more than an even share of a shuffle partition, which are at most
    as many as there are partitions, and the number of blocks that their rows are dealt into."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = F.col("n") * parts / max(1, total)
    return counts.where(share > 1).select("host", F.ceil(4 * share).cast("int").alias("blocks"))


def _by_host(rows: DataFrame, key: str, hosts: DataFrame, large: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the row of their host. Rows of a large host are dealt into blocks by a key, and its one row is copied to
    each block, so no task holds a whole host."""
    large = F.broadcast(large)  # a row for each partition at most
    dealt = rows.join(large, "host", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"), F.lit(0)))
    copied = hosts.join(large, "host", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return dealt.drop("blocks").join(copied.drop("blocks"), ["host", "block"], how).drop("block")


def templates(pages: DataFrame) -> DataFrame:
    """host, labels, parents, hashes, same: the reference outline of each host and the numbers of its template nodes."""
    from burrstone.session import cut

    def outlines(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            made = [Page(x).outline() for x in b["html"]]
            yield {"host": b["host"], "page_id": b["page_id"], "labels": [m[0] for m in made], "parents": [m[1] for m in made], "hashes": [m[2] for m in made], "sizes": [m[3] for m in made]}

    outline = "host string, page_id long, labels array<string>, parents array<int>, hashes array<long>, sizes array<int>"
    made = common.arrow_map(pages.select("host", "page_id", "html"), outlines, outline)
    # Pages with equal outlines are copies and count once.
    tree = F.struct("page_id", "labels", "parents", "hashes", "sizes")
    trees = cut(made.groupBy("host", F.xxhash64("labels", "parents", "hashes").alias("key")).agg(F.min(tree).alias("t")).select("host", "key", "t.*"))
    reference = (
        trees.groupBy("host").agg(F.min(F.struct("page_id", "key", "labels", "parents", "hashes", "sizes")).alias("r"), F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= LEAST_PAGES)
        .select("host", "pages", F.col("r.key").alias("rk"), F.col("r.labels").alias("rl"), F.col("r.parents").alias("rp"), F.col("r.hashes").alias("rh"), F.col("r.sizes").alias("rs"))
    )

    def votes(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            seen: Counter = Counter()
            for host, labels, parents, hashes, sizes, rl, rp, rh, rs in zip(*(b[k] for k in ("host", "labels", "parents", "hashes", "sizes", "rl", "rp", "rh", "rs")), strict=True):
                pairs = match((rl, rp, rh), (labels, parents, hashes))
                # Articles with most of their text in common are copies or editions: what they share is no template.
                edition = 2 * sum(sizes[v] for u, v in pairs if rs[u] and rh[u] == hashes[v]) > min(sum(sizes), sum(rs))
                for u, v in pairs:
                    if (rh[u] or hashes[v]) and not (edition and rs[u]):
                        seen[host, u, rh[u] == hashes[v]] += 1
            yield {"host": [k[0] for k in seen], "node": [k[1] for k in seen], "same": [n if k[2] else 0 for k, n in seen.items()], "n": list(seen.values())}

    # The reference has no vote on itself.
    large = cut(_large(trees.groupBy("host").agg(F.count(F.lit(1)).alias("n"))))
    others = _by_host(trees, "key", reference.drop("pages"), large).where("key <> rk").drop("key", "rk")
    cast = common.arrow_map(others, votes, "host string, node int, same long, n long")
    summed = cast.groupBy("host", "node").agg(F.sum("same").alias("same"), F.sum("n").alias("n")).join(reference.select("host", "pages"), "host")
    most = (F.col("n") >= LEAST_PAGES - 1) & (2 * F.col("n") > F.col("pages") - 1)
    constant = summed.where((F.col("same") >= SAME_SHARE * F.col("n")) & most)
    # A host's nodes are at most those of one page.
    nodes = constant.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("same"))
    return reference.join(nodes, "host").select("host", F.col("rl").alias("labels"), F.col("rp").alias("parents"), F.col("rh").alias("hashes"), "same")


def _text(html: str | None, template: tuple | None) -> str:
    page = Page(html)
    if template is None:
        return page.text(set())
    labels, parents, hashes, same = template
    same = set(same)
    mine = page.outline()
    # A node with a text of its own in a template's place is content.
    return page.text({v for u, v in match((labels, parents, hashes), mine[:3]) if u in same and mine[2][v] == hashes[u]})


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    from burrstone.session import cut

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"))
    made = cut(templates(pages))
    size = made.agg(F.coalesce(F.sum(F.length(F.array_join("labels", " ")) + 16 * F.size("parents") + 100), F.lit(0))).first()[0]
    schema = "page_id long, url string, text string, n_chars long"

    def result(b: dict, of) -> dict:
        texts = [_text(x, t) for x, t in zip(b["html"], of, strict=True)]
        return {"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    if size <= SENT_BYTES:
        sent = spark.sparkContext.broadcast({r["host"]: (list(r["labels"]), list(r["parents"]), list(r["hashes"]), list(r["same"])) for r in made.collect()})
        return common.arrow_map(pages, lambda batches: (result(b, [sent.value.get(h) for h in b["host"]]) for b in batches), schema)
    joined = _by_host(pages, "page_id", made, cut(_large(pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")))), "left")
    return common.arrow_map(
        joined,
        lambda batches: (result(b, [None if x[0] is None else x for x in zip(b["labels"], b["parents"], b["hashes"], b["same"], strict=True)]) for b in batches),
        schema,
    )
