"""HTML extraction by consensus host paths.

1. A page votes for its main container: the deepest one that holds more than half of the text outside links. A container goes by its
   path: the tags with their classes from the page's root down, digits replaced, so pages of one template have equal paths. Lists,
   tables, cells and quotes are no containers; their text is that of the container around.
2. Spark counts votes per host and path. A path that most of the pages having it vote for (two at least) is the main container of one
   of the host's templates; a host has as many of these as it has templates.
3. Titles and leads often stand beside the main container. What a container around it adds is taken in too if it differs from page
   to page as the main text does; what repeats, or is links, is not. Around <article> and <main> nothing is added.
4. Every page is read again with the paths of its host. A page that has none of them goes by itself.

Parts that are never text (menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) are
known by their tag, role, or a word of class or id. A word alone does not decide: an element stays that is or holds an article, the main
element or the page's first heading; that has most of the text of the article it stands in; or that has most of the page's text where
the page has neither article, main element nor heading (readers' comments go in the last two cases too). An article is one container, whatever it is
built of.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.llm.base import stage
from lumicat.llm.tags import RAW, tags
from lumicat.llm.urls import host_of

# fixed values: element names of the HTML standard, and words that sites name their parts with
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
CONTAINER = frozenset("article body center div main section".split())
WHOLE = frozenset("article main".split())
NEVER = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frame frameset head iframe input map menu meter nav noframes noscript object progress search select "
    "svg template video".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset(
    "ad ads adv advert advertisement adverts adbox banner bottombar breadcrumb breadcrumbs byline comment comments cookie cookies consent disclaimer disqus footer "
    "gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion recommended related "
    "reply replies respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe tags toolbar topbar warning widget".split())
#: Names of parts that readers write; these go however long they are.
READERS = frozenset("comment comments disqus replies reply respond".split())
#: Elements nested deeper than this are read as part of the one around.
DEPTH = 512
#: A class name with one of these speaks of a part that stands elsewhere ("with-sidebar").
ABOUT = frozenset("no has with without".split())
CLOSES = {"p": BLOCK - {"button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
          "option": {"option", "optgroup"}, "head": {"body"}}

_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_PART = re.compile(r"[a-z]+")


class _Suspect:
    """An element that is named like a part that is no text: the suspect around it, the article around it, and what it holds."""

    __slots__ = ("around", "article", "readers", "main", "size")

    def __init__(self, around: int, article: int, readers: bool):
        self.around, self.article, self.readers, self.main, self.size = around, article, readers, False, 0


class Page:
    """A page's text blocks (container, text, characters in links) and its containers (parent, path)."""

    def __init__(self, html: str):
        self.parents, self.paths, self.blocks, self.whole = [-1], [""], [], set()
        self._text, self._linked = [], 0
        self._suspects, self._articles, self._of, self._headed = [_Suspect(-1, -1, False)], [0], [], False
        self._names: dict = {}
        # open elements: tag, container, never text, article (0: none), suspect (0: none)
        self._open = [("", 0, False, 0, 0)]
        self._count: Counter = Counter()
        at = 0
        for tag in tags(html):
            if tag.start > at:
                self._say(html[at: tag.start])
            at = tag.end
            if tag.name in RAW and not tag.closing:
                if tag.name in BLOCK:
                    self._flush()
            elif tag.closing:
                self._close(tag.name)
            elif tag.name:
                self._start(tag.name, tag.rest)
        if at < len(html):
            self._say(html[at:])
        self._flush()
        self._judge()

    def _judge(self):
        """Take out the blocks inside suspects that nothing speaks for."""
        total, outside = sum(len(text) for _, text, _ in self.blocks), any(s.main for s in self._suspects)
        for (_, text, _), (suspect, article) in zip(self.blocks, self._of):
            if article:
                self._articles[article] += len(text)
            while suspect:
                self._suspects[suspect].size += len(text)
                suspect = self._suspects[suspect].around
        gone = [False]
        for s in self._suspects[1:]:
            stays = s.main or not s.readers and (2 * s.size > self._articles[s.article] if s.article else not outside and 2 * s.size > total)
            gone.append(gone[s.around] or not stays)
        self.blocks = [b for b, (suspect, _) in zip(self.blocks, self._of) if not gone[suspect]]

    def _speaks(self, suspect: int):
        """All suspects around hold the article, the main element or the first heading; the page (0) has one."""
        while suspect >= 0 and not self._suspects[suspect].main:
            self._suspects[suspect].main = True
            suspect = self._suspects[suspect].around

    def _say(self, text: str):
        if not self._open[-1][2]:
            self._text.append(text)
            if any(x[0] == "a" for x in self._open[-6:]):
                self._linked += len(text)

    def _flush(self):
        if self._text:
            text = " ".join(_html.unescape("".join(self._text)).split())
            if text:
                _, here, _, article, suspect = self._open[-1]
                self.blocks.append((here, text, self._linked))
                self._of.append((suspect, article))
            self._text, self._linked = [], 0

    def _start(self, tag: str, rest: str):
        if tag == "br":
            if not self._open[-1][2]:
                self._text.append(" ")
            return
        block = tag in BLOCK
        if block:
            self._flush()
            while len(self._open) > 1 and tag in CLOSES.get(self._open[-1][0], ()):
                self._cut(len(self._open) - 1)
            if self._open[-1][0] not in BLOCK:  # an inline element left open does not hold blocks
                k = len(self._open) - 1
                while k and self._open[k][0] not in BLOCK:
                    k -= 1
                if tag in CLOSES.get(self._open[k][0], ()):
                    self._cut(k)
        if tag in VOID or len(self._open) > DEPTH:
            return
        _, here, never, article, suspect = self._open[-1]
        named, whole = [], tag in WHOLE
        if rest:
            for m in _ATTRIBUTE.finditer(rest):
                value = (m[2] or m[3] or m[4] or "").lower()
                if m[1].lower() == "role":
                    never = never or value in ROLES
                    whole = whole or value == "main"
                else:
                    named += value.split()
        never = never or tag in NEVER or tag == "header" and not article
        if not never:
            # headings and headers of an article are its own, whatever they are called
            if not whole and tag not in ("html", "body") and not (article and tag in HEADS):
                hits = {w for n in named if ABOUT.isdisjoint(words := set(_PART.findall(n))) for w in words & WORDS}
                if hits:
                    self._suspects.append(_Suspect(suspect, article, not READERS.isdisjoint(hits)))
                    suspect = len(self._suspects) - 1
            if whole or tag == "h1" and not self._headed:
                self._headed = self._headed or tag == "h1"
                self._speaks(suspect)
            if not article and (tag in CONTAINER or whole):
                name = ".".join([tag, *sorted({_DIGITS.sub("#", n) for n in named})])
                path = self._names.get((self.paths[here], name))
                if path is None:
                    path = self._names[self.paths[here], name] = f"{self.paths[here]}>{name}"
                self.parents.append(here)
                self.paths.append(path)
                here = len(self.paths) - 1
                if whole:
                    self.whole.add(path)
            if whole and not article:
                self._articles.append(0)
                article = len(self._articles) - 1
        self._open.append((tag, here, never, article, suspect))
        self._count[tag] += 1

    def _cut(self, k: int):
        for element in self._open[k:]:
            self._count[element[0]] -= 1
        del self._open[k:]

    def _close(self, tag: str):
        if tag in VOID:
            return
        if tag in BLOCK:
            self._flush()
        if not self._count[tag]:
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] == tag:
                self._cut(k)
                return
            if tag not in BLOCK and self._open[k][0] in BLOCK:
                return  # the end of an inline element does not reach out of its block

    def weights(self) -> dict[str, int]:
        """Text outside links by path, all that is inside included; paths without any are left out."""
        sums = [0] * len(self.paths)
        for here, text, linked in self.blocks:
            sums[here] += max(0, len(text) - 2 * linked)
        for k in range(len(sums) - 1, 0, -1):
            sums[self.parents[k]] += sums[k]
        out: dict[str, int] = {}
        for path, n in zip(self.paths, sums):
            if n:
                out[path] = out.get(path, 0) + n
        return out

    def around(self, main: str) -> list[tuple[str, list[str], int]]:
        """Containers around ``main`` that have text of their own beside it, from the inside: path, what is added, and how much of it is
        outside links."""
        if main in self.whole:
            return []
        chain, k = [], self.paths.index(main)
        while k >= 0:
            chain.append(self.paths[k])
            k = self.parents[k]
        level = {path: n for n, path in enumerate(chain)}
        at, added = [0] * len(self.paths), {}
        for k, path in enumerate(self.paths):
            at[k] = level[path] if path in level else at[self.parents[k]]
        for here, text, linked in self.blocks:
            if at[here]:
                texts = added.setdefault(at[here], ([], []))
                texts[0].append(text)
                texts[1].append(max(0, len(text) - 2 * linked))
        return [(chain[n], texts, sum(gains)) for n, (texts, gains) in sorted(added.items())]

    def text(self, path: str) -> str:
        inside = [False] * len(self.paths)
        for k, p in enumerate(self.paths):
            inside[k] = p == path or (self.parents[k] >= 0 and inside[self.parents[k]])
        return "\n".join([text for here, text, _ in self.blocks if inside[here]])

    def own_text(self) -> str:
        found = self.weights()
        if not found:
            return ""
        path = main_of(found)
        for wider, _, gain in self.around(path):
            if not gain or is_outer(wider):
                break
            path = wider
        return self.text(path)


def main_of(weights: dict[str, int]) -> str:
    """The deepest path with more than half of the text; these paths lie inside each other."""
    return max((p for p, n in weights.items() if 2 * n > weights[""]), key=len)


def is_outer(path: str) -> bool:
    """The body and what is around it hold a whole page, not an article."""
    return re.match(r"body\b", path.rpartition(">")[2] or "body") is not None


def _digest(texts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def host_paths(pages: DataFrame) -> DataFrame:
    """_host, _path, _wide, _share: the main containers of the templates of each host of pages (url, html), with the container to read for
    each and the share of votes among the pages that have it."""

    def vote(batches):
        for batch in batches:
            out = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(html)
                found = page.weights()
                if not found:
                    continue
                main = main_of(found)
                out += [(host, path, None, int(path == main), None, None) for path in found]
                around = page.around(main)
                if around:
                    own = _digest([page.text(main)])
                    out += [(host, main, wider, 0, _digest(texts) if gain else None, own) for wider, texts, gain in around]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 6, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                ["_host", "_path", "_wider", "vote", "added", "own"])

    given = pages.select(host_of(F.col("url")).alias("_host"), F.col("html").alias("html")).where("html IS NOT NULL")
    votes = stage(given.mapInArrow(vote, "_host string, _path string, _wider string, vote long, added long, own long"))
    mains = votes.where("_wider IS NULL").groupBy("_host", "_path").agg(F.sum("vote").alias("votes"), F.count("*").alias("n")).where("votes > 1 AND 2 * votes > n")
    # copies of a page say nothing about what repeats
    outer = F.col("_wider").rlike(r"^$|>body(\.[^>]*)?$")
    steps = votes.where("_wider IS NOT NULL").groupBy("_host", "_path", "_wider").agg(F.countDistinct("added").alias("added"), F.countDistinct("own").alias("own")).select(
        "_host", "_path", F.struct(F.length("_wider").alias("n"), "_wider", ((2 * F.col("added") > F.col("own")) & (~outer | (F.col("own") > 1))).alias("fits")).alias("step"))
    # the outermost of those before the first that does not fit
    last = F.coalesce(F.array_max(F.expr("transform(filter(steps, x -> NOT x.fits), x -> x.n)")), F.lit(-1))
    wide = steps.groupBy("_host", "_path").agg(F.collect_list("step").alias("steps")).withColumn("last", last).select(
        "_host", "_path", F.expr("array_min(filter(steps, x -> x.n > last))._wider").alias("_wide"))
    return mains.join(wide, ["_host", "_path"], "left").select(
        "_host", "_path", F.coalesce("_wide", "_path").alias("_wide"), (F.col("votes") / (F.col("n") + 1)).alias("_share"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row of ``pages (page_id, url, html)``.

    Null and empty pages give the empty string, and so do pages without text outside the parts that are never text. Urls without a
    host vote together. Repeated rows are rows of their own and vote each.
    """
    chosen = host_paths(pages).groupBy("_host").agg(F.sort_array(F.collect_list(F.struct((-F.col("_share")).alias("_share"), "_path", "_wide"))).alias("_paths"))
    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("_host"))

    def read(batches):
        for batch in batches:
            out = []
            for page, paths in zip(batch.column(2), batch.column(3)):
                page = Page(page.as_py())
                here = set(page.paths)
                texts = (page.text(p["_wide"]) for p in paths.as_py() or () if p["_path"] in here and page.text(p["_path"]))
                out.append(next(texts, "") or page.own_text())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return given.join(chosen, "_host", "left").select("page_id", "url", "html", "_paths").mapInArrow(read, f"page_id {kinds['page_id']}, url string, text string")
