"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of tags and runs of words. Words score by the element they stand in, tags by their
name; the weights are log odds counted on labelled pages, those that mark their main text themselves (an
``article`` or ``main`` element). Words score positive where labelled pages hold content or nothing is known, tags
always negative. A linear scan finds the contiguous region of the largest sum. Text of the region that stands in menus, page headers,
footers, sidebars, notices, adverts, forms or comments, or scores negative itself, is dropped: these kinds are told by
their elements, roles, or class names and ids that name nothing else.

A null or empty page has empty text; pages are read whole, broken markup is read on (an unknown end tag is skipped,
an open comment, script or quote ends with the page); repeated rows are extracted each; an empty table gives no rows; only
id, url and html are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED = 2000  # pages whose markup the weights are counted on, chosen by hash
SIGNATURES = 5000  # kinds of elements that get weights, the most frequent ones

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)"
    r"|<[!?][^>]*>?|</[^>]*>?", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead title tr ul option select".split()
)
SECTIONS = set("article main nav aside header footer form section div table ul ol dialog menu".split())
LANDMARKS = set("article main nav aside header footer form".split())
CLOSES_SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NOISE_TAGS = set("nav aside footer form head title dialog menu button select option label input fieldset search".split())
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
# Names of the kinds that go, and words that may stand beside them: ``comment-list`` goes, ``comment-theory`` stays.
NOISE_WORDS = set(
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead banner footer sidebar aside notice notices "
    "alert cookie cookies consent gdpr popup modal ad ads advert adverts advertisement advertisements advertising sponsored "
    "form comment comments reply replies disqus".split()
)
BESIDE_NOISE = set(
    "area bar block body bottom box container content footer global group header inner item items left link links list main page panel "
    "reader right section site slot text thread title top unit user wrap wrapper".split()
)
NAME_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
NOISE_WORD, NOISE_TAG = -0.02, -0.2  # what is dropped by name costs little, so it does not part a region that goes on behind it
MARKS_CONTENT = {"article", "main"}


class _Element:
    __slots__ = ("name", "noise", "content", "section")

    def __init__(self, name: str, noise: bool, content: bool, section: str):
        self.name, self.noise, self.content, self.section = name, noise, content, section


def _names_noise(name: str, in_content: bool) -> bool:
    """Whether a class name or id is a kind that goes, alone or beside words of layout; content has headers of its own."""
    parts = {p.lower() for p in NAME_PART.findall(name)}
    return bool(parts & (NOISE_WORDS - {"header"} if in_content else NOISE_WORDS)) and parts <= NOISE_WORDS | BESIDE_NOISE


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region [begin, end) of the largest positive sum, the first to reach it; (0, 0) if there is none."""
    best = total = 0.0
    begin, region = 0, (0, 0)
    for k, x in enumerate(scores):
        total += x
        if total > best:
            best, region = total, (begin, k + 1)
        elif total < 0:
            total, begin = 0.0, k + 1
    return region


def _open(name: str, rest: str, parent: _Element) -> _Element:
    """The element a start tag opens: whether it is noise or marked content, and its nearest section's kind."""
    kind, noise, role = "", parent.noise or name in NOISE_TAGS, ""
    if "=" in rest:
        for m in ATTRIBUTE.finditer(rest):
            value = m[2] or m[3] or m[4] or ""
            key = m[1].lower()
            if key in ("class", "id") and value and name not in ("html", "body"):
                kind = kind or value.split()[0].lower() if value.split() else kind
                noise = noise or name not in MARKS_CONTENT and any(_names_noise(x, parent.content) for x in value.split())
            elif key == "role":
                role = value.lower()
            elif key in ("hidden", "aria-hidden") and value.lower() != "false":
                noise = True
        noise = noise or role in NOISE_ROLES
    if name == "header" and not parent.content:
        noise = True
    content = parent.content or name in MARKS_CONTENT or role in MARKS_CONTENT
    section = f"{name}.{kind}" if kind else name if name in LANDMARKS else parent.section
    return _Element(name, noise, content, section)


def tokens(page: str) -> Iterator[tuple[str, str, int, _Element, str]]:
    """(kind, signature, words, element, text) of tags ("<"), block edges ("|") and text runs ("w")."""
    root = _Element("", False, False, "")
    stack, at, n = [root], 0, len(page)
    while at <= n:
        m = TOKEN.search(page, at)
        upto = m.start() if m else n
        if upto > at:
            text = entities.unescape(page[at:upto])
            top = stack[-1]
            block = next((e.name for e in reversed(stack) if e.name in BLOCKS), "")
            yield "w", f"{top.section}/{block}", len(text.split()), top, text
        if not m:
            return
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if depth and (name in BLOCKS or not any(e.name in BLOCKS for e in stack[depth + 1:])):
                element = stack[depth]
                del stack[depth:]
            elif depth:
                element = stack.pop(depth)
            else:
                element = stack[-1]
        else:
            if name in BLOCKS:
                names, until = CLOSES_SIBLING.get(name, ({"p"}, SECTIONS))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in names or stack[k].name == "p":
                        del stack[k:]
                        break
                    if stack[k].name in until or stack[k].name in SECTIONS:
                        break
            element = _open(name, m["rest"], stack[-1])
            if name in RAW:
                close = re.compile(f"</{name}\\s*>", re.I).search(page, at)
                at = close.end() if close else n
            elif name not in VOID and not m["rest"].endswith("/>"):
                stack.append(element)
        yield "|" if name in BLOCKS or name == "br" else "<", f"<{m['end']}{name}", name != "br", element, ""


def count_labels(page: str) -> Counter:
    """(signature, is content) of a labelled page's words and tags; nothing for a page that marks no content."""
    found: Counter = Counter()
    marked = False
    for kind, signature, words, element, _ in tokens(page):
        content = element.content and not element.noise
        marked |= element.content
        found[signature, content] += words if kind == "w" else 1
    return found if marked else Counter()


def label_weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of content per signature. Tags are shifted below zero."""
    out = {}
    for signature in {s for s, _ in counts}:
        odds = math.log((counts.get((signature, True), 0) + 1) / (counts.get((signature, False), 0) + 1))
        out[signature] = -min(8.0, max(0.2, 1 - odds)) if signature[0] == "<" else max(-4.0, min(4.0, odds))
    return out


def extract(page: str, weights: dict[str, float]) -> str:
    """Blocks of the page's best region, white space made single, joined by blank lines."""
    scores, runs = [], []
    for kind, signature, words, element, text in tokens(page):
        if kind == "w":
            score = NOISE_WORD if element.noise else weights.get(signature, 1.0)
            scores.append(score * words)
            runs.append((text if score > 0 and not element.noise else None, words))
        else:
            scores.append(NOISE_TAG if element.noise else weights.get(signature, -1.0))
            runs.append(("\n" if kind == "|" and words else " " if kind == "|" else "", 0))
    begin, end = best_region(scores)
    blocks: list[list[str]] = [[]]
    for text, words in runs[begin:end]:
        if not words and text == "\n":
            blocks.append([])
        elif text is not None:
            blocks[-1].append(text)
    return "\n\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def fit(pages: DataFrame, labelled: int = LABELLED, id_column: str = "page_id", html_column: str = "html") -> dict[str, float]:
    """Weights from at most ``labelled`` page ids; the driver reads one count per kind of element."""
    ids = pages.select(id_column).distinct().orderBy(F.xxhash64(id_column), id_column).limit(labelled)
    sample = pages.select(id_column, html_column).join(F.broadcast(ids), id_column, "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for page in batch.column(1).to_pylist():
                found.update(count_labels(page or ""))
        yield pa.RecordBatch.from_arrays([
            pa.array([s for s, _ in found], pa.string()), pa.array([c for _, c in found], pa.bool_()),
            pa.array(list(found.values()), pa.int64()),
        ], ["signature", "content", "n"])

    counts = sample.mapInArrow(count, "signature string, content boolean, n bigint").groupBy("signature", "content").agg(
        F.sum("n").alias("n")).orderBy(F.desc("n"), "signature", "content").limit(2 * SIGNATURES).collect()
    return label_weights({(r["signature"], r["content"]): r["n"] for r in counts})


def main_text(pages: DataFrame, labelled: int = LABELLED, id_column: str = "page_id", url_column: str = "url",
              html_column: str = "html") -> DataFrame:
    """Per page: id, url, ``text`` and ``n_chars``."""
    weights = pages.sparkSession.sparkContext.broadcast(fit(pages, labelled, id_column, html_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [extract(page or "", weights.value) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    [id_column, url_column, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_column, url_column)}
    return pages.select(id_column, url_column, html_column).mapInArrow(
        run, f"`{id_column}` {kinds[id_column]}, `{url_column}` {kinds[url_column]}, text string, n_chars bigint")
