"""Main text of web pages: the contiguous region of highest score, found in one linear scan.

A page becomes a sequence of words and tags. Words score positive, tags negative; words inside
containers that hold no article text (menus, notices, forms, comments) score negative as well.
The weights are learned from a bounded sample of labelled pages: pages whose own markup names the
main text (<article> or <main>) label their words and tags as inside or outside. Only for containers
that the sample has not shown does the fixed list of container words below decide, by whole names.
Containers around an <article> or <main> say nothing about what it holds, elements such as <nav> do.

Defined results: NULL or empty html gives an empty text, as does a page without words. Repeated
rows each get their row; other columns are not read. Unclosed and crossing tags are closed at the
next ancestor, an unfinished tag at the end of a cut page is dropped. A page of any length is read
whole and in linear time.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm.common import table
from isotherm.llm.words import map_rows

MAX_LABELLED = 500              # labelled pages that weights are learned from, lowest hash first
MIN_SEEN = 20                   # words or tags a weight needs; below, the fixed values hold

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select option button canvas".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot
th thead title tr ul script style""".split())
INLINE_ENDS = frozenset("p li dt dd tr td th option".split())
# containers that never hold article text, and words that make up a class, id or role of such containers
APART = frozenset("nav aside footer form head dialog menu".split())
APART_WORDS = frozenset("""ad ads adbox adslot advert advertisement advertising advertorial affix banner breadcrumb breadcrumbs byline-share comment
comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer disqus dropdown footer form gdpr header
hidden login masthead menu modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination popup
privacy promo promoted promotion recommended related reply replies responses rss search share sharing shop sidebar signup skip skyscraper
social sponsor sponsored sponsors subscribe subscription taboola tags teaser toc toolbar tooltip topbar widget widgets""".split())
# words that may stand beside them in such a name; any other word (no-sidebar, with-sidebar) makes it another name
BESIDE = frozenset("""site page global main top bottom left right primary secondary inner outer box block bar wrapper wrap container
section area panel list item items link links button buttons icon icons text message post posts article articles entry""".split())
OF_ARTICLE = frozenset("article entry page post section".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']|"[^"<]*+"|'[^'<]*+'|["'])*+)>?""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*+>?", re.I) for t in RAW}
_SPLIT = re.compile(r"[^a-z0-9]+")


def names_of(attributes: str) -> list[str]:
    return [n.lower() for m in _NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").split()]


@lru_cache(100_000)
def names_apart(name: str, inside_article: bool) -> bool:
    """Whether a whole class, id or role names a container without article text; a header of the article holds its heading."""
    if name in APART_WORDS and name != "header":
        return True
    parts = {p for p in _SPLIT.split(name) if p}
    found = parts & APART_WORDS
    if inside_article or parts & OF_ARTICLE:
        found -= {"header"}
    return bool(found) and all(p in APART_WORDS or p in BESIDE or p.isdigit() for p in parts)


@dataclass
class Piece:
    """A text (words > 0) or a tag (tag is its name), with the containers it lies in; named: those the list names."""
    tag: str = ""
    text: str = ""
    words: int = 0
    keys: tuple[str, ...] = ()
    apart: bool = False
    block: bool = False
    named: tuple[str, ...] = ()


def pieces(page: str) -> list[Piece]:
    """The page in order. Elements that hold no text to read (scripts, styles) are left out."""
    out: list[Piece] = []
    stack: list[tuple[str, tuple[str, ...], bool, tuple[str, ...]]] = [("", (), False, ())]
    at, end = 0, len(page)

    def text(raw: str) -> None:
        plain = entities.unescape(raw)
        _, keys, apart, named = stack[-1]
        out.append(Piece(text=plain, words=len(plain.split()), keys=keys, apart=apart, named=named))

    while at < end:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        if start > at:
            text(page[at:start])
        m = _TAG.match(page, start)
        if m is None:                       # a lone "<" is text
            text("<")
            at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        if at == end and not m[0].endswith(">"):
            break                           # cut inside a tag
        name = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            # an end tag does not reach beyond the container of an article
            if depth and not (name in ("p", "b", "i", "span", "a") and any(s[0] in ("article", "main", "nav", "aside") for s in stack[depth + 1:])):
                out.append(Piece(tag=name, keys=stack[depth][1], apart=stack[depth][2], block=name in BLOCK))
                del stack[depth:]
            elif not depth:
                out.append(Piece(tag=name, keys=stack[-1][1], apart=stack[-1][2], block=name in BLOCK))
            continue
        if name in RAW:
            close = _RAW_END[name].search(page, at)
            at = close.end() if close else end
            out.append(Piece(tag=name, keys=stack[-1][1], apart=stack[-1][2], block=name in BLOCK))
            continue
        if name in BLOCK and name not in VOID:
            # a block ends an open paragraph, an item its predecessor
            while len(stack) > 1 and (stack[-1][0] == "p" or (name in INLINE_ENDS and stack[-1][0] == name)
                                      or _open_inline(stack[-1][0], stack, name)):
                stack.pop()
        got = names_of(m[3])
        _, keys, apart, named = stack[-1]
        inside_article = any(s[0] in ("article", "main") for s in stack)
        if name not in ("html", "body", "main", "article"):
            named += tuple(f"{name}.{n}" for n in got if names_apart(n, inside_article))
        elif apart and name in ("article", "main") and not inside_article:
            # a form may be wrapped around the whole page
            apart = any(s[0] in APART and s[0] != "form" or s[0] == "header" for s in stack)
        apart = apart or name in APART or (name == "header" and not inside_article)
        if name not in VOID and not m[3].endswith("/"):
            own = tuple(f"{name}.{n}" for n in got) if got else ((name,) if name not in ("html", "body") else ())
            stack.append((name, keys + tuple(k for k in own if k not in keys), apart, named))
        out.append(Piece(tag=name, keys=keys, apart=apart, block=name in BLOCK))
    return out


def _open_inline(top: str, stack: list, name: str) -> bool:
    """An inline element left open inside a paragraph ends with the paragraph."""
    return name in ("p", "article", "section", "div", "footer", "aside", "nav") and top in ("b", "i", "em", "strong", "u") \
        and any(s[0] == "p" for s in stack)


@dataclass
class Weights:
    """word: a word's score; tags: by tag name; inside: container -> log odds of its words."""
    word: float = 1.0
    tag: float = -0.5
    tags: dict[str, float] = field(default_factory=dict)
    inside: dict[str, float] = field(default_factory=dict)

    def of_word(self, p: Piece) -> float:
        """Negative where the page's own naming or the labelled pages place the words apart.

        A learned container counts only with a class or id of its own: that all links or lists of
        the labelled pages were menus says nothing about a link in a sentence. A container that the
        list names is apart unless the labelled pages show more words inside than outside.
        """
        if p.apart:
            return -self.word
        start = next((i for i, k in enumerate(p.keys) if k.split(".")[0] in ("article", "main")), 0)
        for k in p.keys[start:]:
            if "." in k and (self.inside.get(k, -math.inf) <= 0.0 if k in p.named else self.inside.get(k, 0.0) < -1.0):
                return -self.word
        return self.word

    def of_tag(self, p: Piece) -> float:
        return self.tags.get(p.tag, self.tag)


def main_region(seq: list[Piece], w: Weights) -> tuple[int, int]:
    """Start and end of the contiguous run of highest score; the earliest and longest of equals."""
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    for i, p in enumerate(seq):
        if total < 0:
            total, start = 0.0, i
        total += w.of_tag(p) if p.tag else w.of_word(p) * p.words
        if total > best:
            best, best_range = total, (start, i + 1)
    return best_range


def extract(page: str | None, w: Weights) -> str:
    seq = pieces(page or "")
    a, b = main_region(seq, w)
    out = []
    for p in seq[a:b]:
        if p.tag:
            if p.block:
                out.append(" ")
        elif w.of_word(p) > 0:
            out.append(p.text)
    return " ".join("".join(out).split())


def count_labelled(page: str) -> Counter:
    """(what, name, inside) -> number, for a page that marks its main text; else empty."""
    seq = pieces(page)
    n = Counter()
    if not any(p.tag in ("article", "main") for p in seq):
        return n
    for p in seq:
        inside = any(k.split(".")[0] in ("article", "main") for k in p.keys) and not p.apart
        if p.tag:
            n["tag", p.tag, inside] += 1
        else:
            n["word", "", inside] += p.words
            for k in p.keys:
                n["key", k, inside] += p.words
    return n


def learn(pages: DataFrame, id_col: str = "page_id", html: str = "html", max_pages: int = MAX_LABELLED) -> Weights:
    """Weights from labelled pages: log odds of inside, words kept positive and tags negative."""
    rows = pages.select(F.col(f"`{html}`").cast("string").alias("_html"), F.xxhash64(f"`{id_col}`").alias("_h")).where(
        F.lower("_html").rlike("<(article|main)[ >]"))
    # the hashes decide alone, the pages then stay where they are
    last = rows.select("_h").orderBy("_h").limit(max_pages).agg(F.max("_h")).first()[0]
    chosen = rows.where(F.col("_h") <= F.lit(last).cast("long")).select("_html")

    def make():
        def run(columns):
            for (page,) in zip(*columns):
                for (what, name, inside), n in count_labelled(page).items():
                    yield what, name, inside, n
        return run

    rows = map_rows(chosen, make, "what string, name string, inside boolean, n bigint")
    # names are bounded by the sample of pages
    total: dict[tuple[str, str], list[int]] = {}
    for r in rows.groupBy("what", "name", "inside").agg(F.sum("n").alias("n")).collect():
        total.setdefault((r.what, r["name"]), [0, 0])[r.inside] += r.n
    out = Weights()
    for (what, name), (outside, inside) in total.items():
        if outside + inside < MIN_SEEN:
            continue
        odds = math.log((inside + 1) / (outside + 1))
        if what == "tag":
            out.tags[name] = min(-0.1, max(-1.0, odds - 1.0))
        elif what == "key":
            out.inside[name] = odds
        elif what == "word":
            out.word = max(0.2, min(1.0, odds))
    return out


def main_text(spark: SparkSession, pages: DataFrame, w: Weights, id_col: str = "page_id", url: str = "url",
              html: str = "html") -> DataFrame:
    """One row per page: id, url, text and its number of code points."""
    shared = spark.sparkContext.broadcast(w)

    def make():
        def run(columns):
            for key, address, page in zip(*columns):
                t = extract(page, shared.value)
                yield key, address, t, len(t)
        return run

    out = map_rows(pages.select(*[F.col(f"`{c}`").cast("string") for c in (id_col, url, html)]), make,
                   "id string, url string, text string, n_chars bigint")
    return out.select(F.col("id").cast(pages.schema[id_col].dataType).alias(id_col), F.col("url").alias(url), "text", "n_chars")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(spark, pages, learn(pages))
