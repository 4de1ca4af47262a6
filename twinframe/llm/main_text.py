"""Main text of web pages as the best contiguous region of a scored token stream.

A page becomes a stream of tags and runs of words. Words score by the place they stand in,
positive in places where labelled pages have content; tags score negative. The region with the
largest sum is found by one scan, and its words outside notices, menus, forms and the like are
joined block by block.

Weights come from labelled pages: pages whose own markup (``article`` or ``main``) says where
the content is. Pages without such markup teach nothing but are extracted with the same
weights. The places and tags are fixed lists, so the weights have a fixed size.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import per_batch, strings

# fixed values: element names by their role in a page
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes svg math object canvas select".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul hr".split()
)
BOILERPLATE = set("nav footer aside form menu dialog button head search".split())
CONTENT = {"article", "main"}
CLOSES_P = BLOCK - {"button", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "html", "head", "body"}
SIBLINGS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}}
# fixed values: words in class, id and role attributes of parts that are no main text
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner nav navbar navigation menu "
    "submenu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar comment comments commentlist disqus reply replies respond cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related "
    "recommended recommendations widget pagination pager login signup search complementary contentinfo".split()
)
PLACES = sorted(BLOCK | {"a", "other"})
TAGS = sorted(BLOCK | VOID | {"a", "b", "i", "em", "strong", "span", "other"})

_TOKEN = re.compile(
    r"<!--(?:>|->|(?:.*?)--!?>|.*\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'](?=[^\"'>]*>))*+)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")


def _is_noise(name: str, rest: str, in_content: bool) -> bool:
    if name in BOILERPLATE or (name == "header" and not in_content):
        return True
    if not rest or name in ("body", "html"):
        return False
    for m in _ATTRIBUTE.finditer(rest):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" and value != "until-found" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key in ("class", "id", "role") and name not in CONTENT:
            words = set(_WORDS.findall(value))
            if words & NOISE_WORDS or (not in_content and "header" in words and key != "role"):
                return True
    return False


def tokens(page: str) -> list[tuple[str, str, bool, bool, str]]:
    """(kind, place or tag, in noise, in content markup, text) per tag ('t'), block break included, or run of text ('w')."""
    out: list[tuple[str, str, bool, bool, str]] = []
    stack: list[tuple[str, bool]] = []
    held: Counter = Counter()
    noisy = content = at = 0
    lower = page.lower() if len(page.lower()) == len(page) else page

    def pop() -> str:
        nonlocal noisy, content
        name, noise = stack.pop()
        held[name] -= 1
        noisy -= noise
        content -= name in CONTENT
        return name

    def text(raw: str) -> None:
        if raw:
            place = stack[-1][0] if stack else "other"
            out.append(("w", place if place in _PLACES else "other", noisy > 0, content > 0, html.unescape(raw)))

    last = page.rfind(">")
    while True:
        # a comment may lack its end; other markup needs a ">" further on
        m = _TOKEN.search(page, at) if at <= last or page.find("<!", at) >= 0 else None
        if m is None:
            text(page[at:])
            return out
        text(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name, ends = m["name"].lower(), bool(m["end"])
        if name in RAW:
            if not ends and not m["rest"].endswith("/"):
                close = lower.find(f"</{name}", at)
                after = lower.find(">", close) if close >= 0 else -1
                at = after + 1 if after >= 0 else len(page)
            continue
        tag = name if name in _TAGS else "other"
        keeps = name in BLOCK or name == "a"
        if ends:
            out.append(("t", tag, noisy > 0, content > 0, ""))
            if held[name]:
                while pop() != name:
                    pass
            continue
        if name in CLOSES_P and held["p"]:
            while pop() != "p":
                pass
        elif name in SIBLINGS and held[name]:
            inner = next((s for s, _ in reversed(stack) if s == name or s in SIBLINGS[name]), None)
            if inner == name:
                while pop() != name:
                    pass
        noise = _is_noise(name, m["rest"], content > 0)
        if name not in VOID and (keeps or noise) and not m["rest"].endswith("/"):
            stack.append((name, noise))
            held[name] += 1
            noisy += noise
            content += name in CONTENT
        out.append(("t", tag, noisy > 0, content > 0, ""))


_PLACES, _TAGS = frozenset(PLACES), frozenset(TAGS)


def counts_of(page: str) -> Counter:
    """(kind, key, is content) of the tokens of a labelled page; nothing for a page without content markup."""
    stream = tokens(page)
    if not any(t[3] for t in stream):
        return Counter()
    found: Counter = Counter()
    for kind, key, noise, content, text in stream:
        n = 1 if kind == "t" else len(text.split())
        if n:
            found[kind, f"{key}{'!' if noise else ''}", content and not noise] += n
    return found


def label_weights(rows: list[tuple[str, str, bool, int]]) -> dict[tuple[str, str], float]:
    """Weights of words and tags by place from counts of labelled pages.

    Log odds of content with prior counts: half a page of each kind for places that never
    occurred, all noise for noisy ones. Words lie within -4..2; tags are negative always.
    """
    inside: Counter = Counter()
    outside: Counter = Counter()
    for kind, key, content, n in rows:
        (inside if content else outside)[kind, key] += n
    made = {}
    for kind, keys in (("w", PLACES), ("t", TAGS)):
        for key in keys:
            for noise in ("", "!"):
                a, b = inside[kind, key + noise], outside[kind, key + noise]
                prior = (1.0, 60.0) if noise else (30.0, 20.0)
                if key in ("a", "li") and not noise:
                    prior = (10.0, 20.0)
                odds = math.log((a + prior[0]) / (b + prior[1]))
                made[kind, key + noise] = max(-4.0, min(2.0, odds)) if kind == "w" else -max(0.2, min(4.0, 1.0 - odds))
    return made


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch with the largest positive sum; the first of equals, the longest of its kind."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for at, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, at
        total += score
        if total > best:
            best, found = total, (start, at + 1)
    return found


def extract(page: str, weights: dict[tuple[str, str], float]) -> str:
    """The main text; empty when no region scores above zero."""
    stream = tokens(page)
    scores, before = [], False
    for kind, key, noise, _, text in stream:
        score = weights[kind, f"{key}{'!' if noise else ''}"] * (1 if kind == "t" or noise else len(text.split()))
        # noise never gets out, so a stretch of it costs once, however long; else an advert within a text would cut it in two
        scores.append(0.0 if noise and before else score)
        before = noise
    start, end = best_region(scores)
    blocks: list[list[str]] = [[]]
    for kind, key, noise, _, text in stream[start:end]:
        if kind == "w":
            if not noise:
                blocks[-1].append(text)
        elif key in BLOCK:
            blocks.append([])
        elif key == "br":
            blocks[-1].append(" ")
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def fit_weights(pages: DataFrame, column: str = "html") -> dict[tuple[str, str], float]:
    """Weights from all labelled pages; a fixed number of counts reaches the driver."""

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for page in strings(batch, column):
                found.update(counts_of(page))
        if found:
            keys = list(found)
            yield pa.RecordBatch.from_pydict({"kind": [k[0] for k in keys], "key": [k[1] for k in keys], "content": [k[2] for k in keys], "n": list(found.values())})

    rows = pages.select(column).mapInArrow(run, "kind string, key string, content boolean, n long").groupBy("kind", "key", "content").agg(F.sum("n").alias("n")).collect()
    return label_weights([tuple(r) for r in rows])


def main_text(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    ``labelled`` (default: the pages themselves) gives the weights. NULL or empty html gives an
    empty text, a NULL id or url stays; repeated rows give repeated results; other columns are ignored.
    """
    weights = fit_weights(pages if labelled is None else labelled)
    fields = "page_id, url"
    schema = ", ".join(f"{n} {pages.schema[n].dataType.simpleString()}" for n in fields.split(", ")) + ", text string, n_chars long"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [extract(p, weights) for p in strings(batch, "html")]
            return pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

        return step

    return per_batch(pages.select("page_id", "url", "html"), schema, make)
