"""HTML extraction by consensus host paths: pages score their containers, hosts vote on generalised paths, pages are read again."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Text that stands under one path on so many different pages of a host, and on more than half of those that have the
#: path, is the host's and no article's.
REPEATS = 3
# Fixed values of HTML: elements without content, elements in the flow of a line, elements that hold blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("blockquote caption dd dt figcaption li p pre td th".split())
LISTS = frozenset("dl ol ul".split())
CONTAINERS = LISTS | frozenset("article body center div html main section table tbody td tr".split())
CLOSES = {"li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: Elements whose content is skipped up to their end tag.
RAW = frozenset("iframe noscript script style svg template textarea title".split())
#: Elements and roles that hold no part of an article.
ASIDE = frozenset("aside button canvas dialog footer form head header math menu nav object select".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Elements that hold an article by what they are; words of their classes say nothing against it.
SURE = frozenset("article body html main".split())
#: Words of a class or id by which a page takes a container for something else, while it has any other.
WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice "
    "notices pager pagination paywall popup promo promoted promotion related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar".split()
)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>""")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}
DIGITS = re.compile(r"\d+")
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def tags(page: str):
    """(start, end, closing, name, attributes) of each tag in page order; name "" for comments, declarations and raw content.

    Linear in the page whatever its markup: `>` in quotes doesn't end a tag, but where quotes don't close, the first
    `>` does, and once such failures have cost a few times the page's length quotes are not looked at any more.
    """
    n, last, at, spare = len(page), page.rfind(">"), 0, 8 * len(page)
    while True:
        at = page.find("<", at)
        if at < 0 or at > last:
            return  # what is left has no tag
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, False, "", ""
            at = end
            continue
        m = NAME.match(page, at)
        if not m:
            if page[at + 1] in "!?":
                end = page.find(">", at) + 1
                yield at, end, False, "", ""
                at = end
            else:
                at += 1
            continue
        whole = REST.match(page, m.end()) if spare > 0 else None
        if whole:
            end = whole.end()
        else:
            if spare > 0:
                spare -= n - m.end()
            end = page.find(">", m.end()) + 1
            if not end:
                return
        name = m[2].lower()
        if name in RAW and not m[1]:
            close = RAW_END[name].search(page, end)
            end = page.find(">", close.end()) + 1 if close else n
            yield at, end or n, False, "", ""
            at = end or n
            continue
        yield at, end, bool(m[1]), name, page[m.end() : end - 1]
        at = end


def named(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The generalised name of an element, tag and classes without digits; whether its content never counts; whether its
    class or id speaks against it."""
    name, aside, doubt = tag, tag in ASIDE, False
    for key, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), a or b or c
        if key == "class":
            own = sorted({DIGITS.sub("", x).lower() for x in value.split()})
            name += "".join("." + x for x in own if x)
        if tag not in SURE and (key == "class" or key == "id" and tag not in HEADINGS):  # the id of a heading is made of its words
            doubt = doubt or any(x.lower() in WORDS for x in SPLIT.split(value))
        elif key == "role":
            aside = aside or value.lower() in ROLES
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            aside = True
    return name, aside, doubt


class Element:
    """A container, or a block whose class speaks against it: its generalised path as a hash, and the text that stands right in it."""

    __slots__ = ("up", "name", "key", "tag", "sure", "doubt", "blocks", "chars", "linked", "prose", "bare")

    def __init__(self, up, name, tag, doubt):
        self.up, self.name, self.tag = up, name, tag
        self.key = xxhash.xxh64_intdigest(f"{up.key if up else 0}>{name}")
        self.sure = tag in ("article", "main") or bool(up and up.sure)
        self.doubt = doubt
        self.blocks: list[str] = []
        self.chars = self.linked = self.prose = self.bare = 0

    def mostly_links(self) -> bool:
        return 2 * self.linked >= self.chars and self.linked > 0


def read(page: str) -> list[tuple[Element, str]]:
    """The blocks of the page in order, each with its container. Linear in the page, also for unclosed or deep markup."""
    root = Element(None, "", "", False)
    # of each open element: tag, container, aside, doubt, place on the stack of the nearest one that is a block
    stack: list[tuple[str, Element, bool, bool, int]] = [("", root, False, False, 0)]
    open_tags: dict[str, int] = {}
    out: list[tuple[Element, str]] = []
    text: list[str] = []
    linked = at = 0
    names: dict[tuple[str, str], tuple[str, bool, bool]] = {}

    def end():
        nonlocal linked
        if text:
            own = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            _, element, aside, _, block = stack[-1]
            if own and not aside:
                element.chars += len(own)
                element.linked += min(linked, len(own))
                element.blocks.append(own)
                tag = stack[block][0]
                if 2 * linked < len(own) and (" " in own or tag in HEADINGS):
                    if tag in PARAGRAPHS:
                        element.prose += len(own)
                    else:
                        element.bare += len(own)
                out.append((element, own))
        linked = 0

    def pop_to(i: int):
        while len(stack) > i:
            open_tags[stack.pop()[0]] -= 1

    for start, stop, closing, tag, attributes in tags(page):
        if start > at:
            text.append(page[at:start])
            if open_tags.get("a"):
                linked += start - at
        at = stop
        if not tag:
            continue
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            elif tag == "hr":
                end()
            continue
        if closing:
            if not open_tags.get(tag):
                if tag not in INLINE:
                    end()
                continue
            i = len(stack) - 1
            while stack[i][0] != tag:
                i -= 1
            if tag not in INLINE or stack[-1][4] > i:
                end()
            pop_to(i)
            continue
        if tag not in INLINE:
            end()
            if stack[stack[-1][4]][0] == "p":
                pop_to(stack[-1][4])
            if tag in CLOSES and stack[stack[-1][4]][0] in CLOSES[tag]:
                pop_to(stack[-1][4])
        key = (tag, attributes)
        if key not in names:
            names[key] = named(tag, attributes)
        name, aside, doubt = names[key]
        _, element, above, doubted, block = stack[-1]
        if tag in INLINE:
            doubt = False
        if tag in CONTAINERS or doubt:  # a block with a telling class is a container of its own, so that what is around it stays
            element = Element(element, name, tag, doubted or doubt)
        stack.append((tag, element, above or aside, doubted or doubt, block if tag in INLINE else len(stack)))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page):
        text.append(page[at:])
    end()
    return out


def ancestors(e: Element):
    while e:
        yield e
        e = e.up


def within(found: list[Element], top: Element | None) -> set[int]:
    """ids of the elements that lie in top; each chain is walked once."""
    known: dict[int, bool] = {id(top): True}
    for e in found:
        chain = []
        x = e
        while x is not None and id(x) not in known:
            chain.append(x)
            x = x.up
        inside = known[id(x)] if x is not None else False
        known.update((id(c), inside) for c in chain)
    return {id(e) for e in found if known[id(e)]}


def lowest_common(found: list[Element]) -> Element:
    """The lowest element that holds them all."""
    chain = list(ancestors(found[0]))[::-1]
    place = {id(e): i for i, e in enumerate(chain)}
    most, seen = len(chain) - 1, set()
    for e in found[1:]:
        x = e
        while id(x) not in place and id(x) not in seen:
            seen.add(id(x))
            x = x.up
        if id(x) in place:
            most = min(most, place[id(x)])
    return chain[most]


def own_article(found: list[tuple[Element, str]]) -> set[int]:
    """ids of the containers that the page by itself takes for its article.

    A container scores by the text of its paragraphs and headings that is not mostly links; bare text counts if there
    is no other. Elements made for articles decide if they hold half of that text; else the article is the lowest
    container of all that scores, or one around it that has text right in it. In it, lists of links and containers
    with a telling class are left out. A telling class counts only while other containers score.
    """
    all_ = list({id(e): e for e, _ in found}.values())
    sure = [e for e in all_ if not e.doubt] or all_
    score = {id(e): e.prose for e in sure}
    if not any(score.values()):
        sure = [e for e in sure if e.bare] or ([e for e in all_ if e.prose or e.bare] if not any(e.bare for e in sure) else sure)
        score = {id(e): e.prose or e.bare for e in sure}
    wanted = [e for e in sure if score[id(e)]]
    if not wanted:
        return {id(e) for e in all_ if not e.mostly_links() and not e.doubt} or {id(e) for e in all_ if not e.mostly_links()}
    total = sum(score.values())
    made = [e for e in wanted if e.sure]
    if 2 * sum(score[id(e)] for e in made) >= total > 0:
        inside = {id(e) for e in all_ if e.sure}
    else:
        top = lowest_common(wanted)
        around = [e for e in ancestors(top) if e is not top and not e.doubt and e.chars and not e.mostly_links()]
        inside = within(all_, around[-1] if around else top)
    clear = {id(e) for e in wanted}
    return {id(e) for e in all_ if id(e) in inside and (id(e) in clear or not e.doubt) and (e.sure or not e.mostly_links())}


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_key(e: Element) -> int:
    return xxhash.xxh64_intdigest("\n".join(e.blocks))


def host_of(url="url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def page_key():
    return F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """host, page, like, path, own, good for each container with text: hashes of the page, of its whole text, of the
    generalised path and of the container's own text, and whether the page takes it for its article."""

    def vote(batches):
        for part in common.slices(batches, "html"):
            rows = []
            for host, page, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), common.strings(part, "html")):
                found = read(text)
                good = own_article(found)
                like = signed(xxhash.xxh64_intdigest("\n".join(t for _, t in found)))
                rows += [(host, page, like, signed(e.key), signed(text_key(e)), i in good) for i, e in {id(e): e for e, _ in found}.items()]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["host", "page", "like", "path", "own", "good"])

    hosted = pages.select(host_of().alias("host"), page_key().alias("page"), "html").where("host <> ''")
    return common.in_arrow(hosted, vote, "host string, page long, like long, path long, own long, good boolean")


def host_paths(cast: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, path, n, won): the paths of each host's containers, the pages that have them, and whether at least half of
    these pages take them for their article; (host, path, own, k): texts that repeat under a path and on how many
    different pages. Counted in two steps, so neither a host nor a path of any size meets in one task."""
    pages = cast.groupBy("host", "path", "page", "like").agg(F.max("good").alias("good"), F.count("*").alias("rows"))
    paths = pages.groupBy("host", "path").agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("good"), F.col("rows")).otherwise(0)).alias("good"))
    apart = pages.select("host", "path", "like").distinct().groupBy("host", "path").agg(F.count("*").alias("n"))
    paths = paths.join(apart, ["host", "path"]).select("host", "path", "n", (2 * F.col("good") >= F.col("rows")).alias("won"))
    texts = cast.select("host", "path", "own", "like").distinct().groupBy("host", "path", "own").agg(F.count("*").alias("k")).where(F.col("k") >= REPEATS)
    return paths, texts


def overruled(pages: DataFrame) -> DataFrame:
    """page, changes: the containers (path, own, keep) of a page on which its host's votes differ from the page's own score."""
    cast = common.checkpointed(votes(pages))
    paths, texts = host_paths(cast)
    verdict = cast.select("host", "page", "path", "own", "good").distinct().join(paths, ["host", "path"]).join(texts, ["host", "path", "own"], "left")
    keep = F.col("won") & ~F.coalesce(2 * F.col("k") > F.col("n"), F.lit(False))
    changed = verdict.withColumn("keep", keep).where(F.col("keep") != F.col("good"))
    return changed.groupBy("page").agg(F.array_sort(F.collect_set(F.struct("path", "own", "keep"))).alias("changes"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path for each row of pages.

    The text is that of the containers whose generalised paths (tags and classes without digits, from the root) won
    their host's vote, without text that the host repeats over its pages under one path. Pages without a host, and a
    page that the votes would leave empty, go by their own score. path is the lowest container of it all. Copies of a
    page vote each, but count once where text repeats. Ties keep a path. Null or empty html gives an empty text, no
    rows give no rows, extra columns are ignored. Unclosed comments, scripts and the like hide the rest of the page, as
    in browsers; a `<` that starts no tag, or a tag that never ends, is text. Time and memory are linear in a page.
    """
    changes = common.checkpointed(overruled(pages)).withColumnRenamed("page", "_page")
    kind = common.id_kind(pages, "page_id")

    def again(batches):
        for part in common.slices(batches, "html"):
            texts, used = [], []
            for page, change in zip(common.strings(part, "html"), part.column(3).to_pylist()):
                found = read(page)
                own = own_article(found)
                kept = own
                if change:
                    told = {(c["path"], c["own"]): c["keep"] for c in change}
                    kept = {id(e) for e in {id(e): e for e, _ in found}.values() if told.get((signed(e.key), signed(text_key(e))), id(e) in own)} or own
                texts.append("\n".join(t for e, t in found if id(e) in kept))
                top = [e for e, _ in found if id(e) in kept]
                used.append(">".join([e.name for e in ancestors(lowest_common(top))][::-1]) if top else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(used, pa.string())], names=["page_id", "url", "text", "n_chars", "path"])

    keyed = pages.select("page_id", "url", "html", page_key().alias("_key"))
    joined = keyed.join(common.small_or_not(changes, 50_000), F.col("_key") == F.col("_page"), "left").select("page_id", "url", "html", "changes")
    return common.in_arrow(joined, again, f"page_id {kind}, url string, text string, n_chars long, path string")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages")).drop("path")
