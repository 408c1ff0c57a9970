"""HTML extraction: landmarks and a sharded host suffix array.

A page is cut into blocks.  Scripts, styles, markup, comments, forms, menus,
headers, footers, sidebars, notices, adverts and reader comments are boilerplate by
their element or by a name among the words of class, id or role.  Blocks inside
<article> or <main> are its text.  What stands outside both is loose: the host
decides.

Repeats.  The token streams of all blocks outside the article are joined per host.  A
substring of LEAST_TOKENS or more is a template's if it stands in enough distinct
pages of the host: LEAST_PAGES, and LEAST_SHARE of the host's pages.  Each such
substring is the union of its LEAST_TOKENS-token windows, so the suffixes need sorting
by their first LEAST_TOKENS tokens only (the cover is the one of the full suffix
array; a test holds it against one).  Suffixes are dealt to shards twice: by (prefix,
page), where pages are counted apart, and by prefix, where the counts meet; so a
prefix that stands on every page of a host fills no shard.  Loose blocks lose the
covered runs of LEAST_TOKENS or more, or that fill the block, and keep the unique runs.

Pages with equal loose blocks are one page here, whatever menu, advert or footer they
carry.  A page whose loose blocks would lose MOST_COVERED of their tokens is a near
copy of others: only windows on more than twice as many pages as its median window
count for it.

Parsing follows the rules that matter here: attributes are read name by name; a block
element ends an open <p>, <li> ends <li>, and so on; an element without an end tag
ends with its parent.  Boilerplate that is closed keeps an <article> inside it out;
one that never closes does not.

Text: character references decoded, white space inside a block is one blank, blocks
are trimmed and joined by \n in page order.  A <br> ends a block.

Edge cases: null html gives an empty text; a cut-off tag at the end is dropped; a null
or broken url counts as a host of its own; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import U64, batches_of, bucket_count, deal, joined, materialise, mix64, runs, sized_broadcast

LEAST_TOKENS = 8
LEAST_PAGES = 3
LEAST_SHARE = 0.05
MOST_COVERED = 0.9

#: Elements by what they hold.
DROPPED = frozenset("nav footer aside form menu dialog select button object audio video head svg canvas noscript template".split())
RAW = frozenset("script style xmp noembed noframes title textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
MAIN = frozenset(("article", "main"))
#: Elements whose start ends an open one of these, up to the nearest of the fences.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
ENDS_P = frozenset("address article aside blockquote details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split())
P_FENCES = frozenset("article aside main section div td th li blockquote button object table body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Names of boilerplate.  WHOLE must be a whole class or id; PARTS may stand between hyphens; OUTSIDE too, but not inside the article.
WHOLE = frozenset("ad ads nav menu header masthead footer notice notices banner share sharing social related form login signup subscribe subscription widget toolbar pagination navigation".split())
PARTS = frozenset("advert adverts advertisement advertisements sponsor sponsored promo navbar breadcrumb breadcrumbs sidebar cookie cookies consent popup modal newsletter disqus comment comments".split())
OUTSIDE = frozenset("nav menu header masthead footer banner ad ads share social related login signup subscribe".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_CUT = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
_BLANKS = re.compile(r"\s+")


def named_boilerplate(names: str, inside_main: bool) -> bool:
    """Whether a class or id names boilerplate."""
    for name in names.split():
        parts = {p.lower() for p in _CUT.split(name)}
        if name.lower() in WHOLE or not PARTS.isdisjoint(parts) or not inside_main and not OUTSIDE.isdisjoint(parts) or name.lower().startswith(("ad-", "ads-", "ad_", "ads_")):
            return True
    return False


def _boilerplate(name: str, attributes: str, inside_main: bool) -> bool:
    if name in DROPPED or name == "header" and not inside_main:
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or "").lower(), entities.unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.lower().replace(" ", ""):
            return True
        if key == "role" and value.strip().lower() in ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body") and named_boilerplate(value, inside_main):
            return True
    return False


def _pieces(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, text or attributes) in order; kind: text, open, close or void."""
    out, at = [], 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            out.append(("text", "", page[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[4]:
            return out  # cut off inside a tag
        if m[1]:
            out.append(("close", name, ""))
        elif name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
        else:
            out.append(("void" if name in VOID or m[3].endswith("/") else "open", name, m[3]))
    out.append(("text", "", page[at:]))
    return out


def _ended_by(name: str, stack: list) -> int:
    """How much of the stack stays when this element starts."""
    kinds, fences = ENDS.get(name, ((), ()))
    for ends, stop in ((kinds, fences), ({"p"} if name in ENDS_P else (), P_FENCES)):
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    return i
                if stack[i][0] in stop:
                    break
    return len(stack)


def _closed(pieces: list[tuple[str, str, str]]) -> set[int]:
    """The open pieces whose own end tag comes."""
    closed, stack = set(), []
    for at, (kind, name, _) in enumerate(pieces):
        if kind == "open":
            del stack[_ended_by(name, stack) :]
            stack.append((name, at))
        elif kind == "close":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    closed.add(stack[i][1])
                    del stack[i:]
                    break
    return closed


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of each visible block in page order; kind: main, loose or boilerplate."""
    pieces = _pieces(page)
    closed = _closed(pieces)
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str, bool]] = []  # element, kind of what it holds, whether it shuts an article out
    kind = "loose"

    def flush() -> None:
        if parts:
            text = _BLANKS.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((kind, text))

    def cut(size: int) -> None:
        nonlocal kind
        if any(x[0] not in INLINE for x in stack[size:]):
            flush()
        if size < len(stack):
            after = stack[size - 1][1] if size else "loose"
            if after != kind:
                flush()
            del stack[size:]
            kind = after

    for at, (piece, name, text) in enumerate(pieces):
        if piece == "text":
            parts.append(text)
            continue
        if name not in INLINE:
            flush()
        if piece == "close":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    cut(i)
                    break
        elif piece == "open":
            cut(_ended_by(name, stack))
            shut = bool(stack) and stack[-1][2]
            bad = _boilerplate(name, text, kind == "main" or name in MAIN)
            if name in MAIN and not bad:
                new = "boilerplate" if shut else "main"
            elif bad and kind != "boilerplate":
                new = "boilerplate"
            else:
                new = kind
            if new != kind:
                flush()
            stack.append((name, new, shut or bad and at in closed))
            kind = new
    flush()
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "") if url else "\0"
    except ValueError:
        return "\0"


def _windows(host: str, found: list[tuple[str, str]], size: int) -> tuple[np.ndarray, int]:
    """Hash of (host, the size tokens from there) at each place of the stream outside the article, and the digest of the loose blocks."""
    tokens = [t for kind, text in found if kind != "main" for t in text.split(" ")]
    own = np.array([xxhash.xxh64_intdigest(t) for t in tokens], U64)
    n = max(len(own) - size + 1, 0)
    rolling = np.full(n, U64(xxhash.xxh64_intdigest(host)))
    for k in range(size):
        rolling = mix64(rolling + own[k : k + n])
    return rolling, xxhash.xxh64_intdigest("\n".join(t for kind, t in found if kind == "loose"), seed=1)


def _parsed(pages: DataFrame, size: int) -> DataFrame:
    schema = "row long, page_id long, url string, host long, kinds array<string>, texts array<string>, windows binary, stream long, loose boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, column="html"):
            found = [blocks(h or "") for h in batch.column("html").to_pylist()]
            hosts = [host_of(u) for u in batch.column("url").to_pylist()]
            seen = [_windows(h, f, size) for h, f in zip(hosts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("page_id"), batch.column("url"),
                    pa.array(np.array([xxhash.xxh64_intdigest(h) for h in hosts], U64).astype(np.int64)),
                    pa.array([[k for k, _ in f] for f in found], pa.list_(pa.string())),
                    pa.array([[t if k != "boilerplate" else str(t.count(" ") + 1) for k, t in f] for f in found], pa.list_(pa.string())),
                    pa.array([w.tobytes() for w, _ in seen], pa.binary()),
                    pa.array(np.array([d for _, d in seen], U64).astype(np.int64)),
                    pa.array([any(k == "loose" for k, _ in f) for f in found], pa.bool_()),
                ],
                names=["row", "page_id", "url", "host", "kinds", "texts", "windows", "stream", "loose"],
            )

    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, schema)


def template_windows(parsed: DataFrame, buckets: int, least_pages: int, least_share: float) -> DataFrame:
    """(host, windows, pages): the prefixes that stand in enough distinct pages of a host, and in how many, packed.

    A host has at most 1 / least_share times as many of them as a page has windows, or it has few pages.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.frombuffer(w, U64)) for w in batch.column("windows").to_pylist()]
            n = [len(w) for w in found]
            if sum(n):
                prefix = np.concatenate(found)
                stream, host = (np.repeat(batch.column(c).to_numpy(), n) for c in ("stream", "host"))
                yield deal(mix64(prefix ^ mix64(stream.astype(U64))) % U64(buckets), {"prefix": prefix, "stream": stream, "host": host})

    def apart(table: pa.Table) -> pa.Table:
        """Distinct pages of each prefix in this shard, dealt on by prefix."""
        prefix, stream, host = (joined(table[c], t) for c, t in (("prefix", U64), ("stream", np.int64), ("host", np.int64)))
        order = np.lexsort((stream, prefix))
        once = runs(prefix[order], stream[order])
        prefix, host = prefix[order][once], host[order][once]
        heads = runs(prefix)
        n = np.diff(np.append(heads, len(prefix))).astype(np.uint32)
        return pa.Table.from_batches([deal(prefix[heads] % U64(buckets), {"prefix": prefix[heads], "n": n, "host": host[heads]})])

    def together(table: pa.Table) -> pa.Table:
        prefix, n, host = (joined(table[c], t) for c, t in (("prefix", U64), ("n", np.uint32), ("host", np.int64)))
        order = np.argsort(prefix, kind="stable")  # this shard's part of the suffix array
        prefix, n, host = prefix[order], n[order].astype(np.int64), host[order]
        heads = runs(prefix)
        total = np.add.reduceat(n, heads) if len(heads) else n
        many = total >= least_pages
        return pa.table({"host": host[heads][many], "prefix": prefix[heads][many].astype(np.int64), "n": total[many]})

    hosts = sized_broadcast(parsed.where("loose").select("host").distinct())  # the other hosts have nothing to decide
    own = parsed.join(hosts, "host", "left_semi")
    sizes = own.groupBy("host").agg(F.count_distinct("stream").alias("streams"))
    cells = own.select("windows", "stream", "host").mapInArrow(dealt, "bucket long, prefix binary, stream binary, host binary")
    counts = cells.groupBy("bucket").applyInArrow(apart, "bucket long, prefix binary, n binary, host binary")
    repeated = counts.groupBy("bucket").applyInArrow(together, "host long, prefix long, n long")
    often = repeated.join(sized_broadcast(sizes, 24), "host").where(F.col("n") >= F.col("streams") * least_share)
    return often.groupBy("host").agg(F.collect_list(F.struct("prefix", "n")).alias("templates"))


def unique_runs(kinds: list[str], texts: list[str], windows: np.ndarray, templates: dict[int, int], size: int, most_covered: float = MOST_COVERED) -> str:
    """The page's text: main blocks whole, loose blocks without the tokens that template windows cover."""
    counts = [int(t) if k == "boilerplate" else t.count(" ") + 1 for k, t in zip(kinds, texts, strict=True) if k != "main"]
    loose = np.repeat(np.array([k == "loose" for k in kinds if k != "main"], bool), counts)
    pages = np.array([templates.get(w, 0) for w in windows.astype(np.int64).tolist()], np.int64)

    def cover(least: float) -> np.ndarray:
        out = np.zeros(len(loose) + size, bool)
        for p in np.flatnonzero(pages > least).tolist():
            out[p : p + size] = True
        return out[: len(loose)]

    covered = cover(0)
    if loose.any() and covered[loose].mean() >= most_covered:
        inside = pages[loose[: len(pages)]]
        covered = cover(2 * float(np.median(inside)) if len(inside) else 0)
    out, at = [], 0
    for kind, text in zip(kinds, texts, strict=True):
        if kind == "main":
            out.append(text)
        elif kind == "boilerplate":
            at += int(text)
        else:
            tokens = text.split(" ")
            left, i = [], 0
            while i < len(tokens):
                end = i + 1
                while end < len(tokens) and covered[at + end] == covered[at + i]:
                    end += 1
                if not covered[at + i] or end - i < min(size, len(tokens)):  # a repeat that only reaches into the block
                    left += tokens[i:end]
                i = end
            at += len(tokens)
            if left:
                out.append(" ".join(left))
    return "\n".join(out)


def extract_text(pages: DataFrame, size: int = LEAST_TOKENS, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    parsed = materialise(_parsed(pages, size), "page-blocks")
    templates = materialise(template_windows(parsed, bucket_count(pages, "html"), least_pages, least_share), "page-templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kinds", "texts", "windows", "templates")
        for batch in batches:
            text = [unique_runs(k, t, np.frombuffer(w or b"", U64), {x["prefix"]: x["n"] for x in p or ()}, size) for k, t, w, p in zip(*(batch.column(c).to_pylist() for c in names), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = "templates array<struct<prefix:bigint,n:bigint>>".split(" ")[1]
    alone = parsed.where("NOT loose").select("page_id", "url", "kinds", "texts", F.lit(None).cast("binary").alias("windows"), F.lit(None).cast(kind).alias("templates"))
    cut = parsed.where("loose").join(sized_broadcast(templates, 1 << 16), "host", "left").select("page_id", "url", "kinds", "texts", "windows", F.col("templates").cast(kind).alias("templates"))
    return alone.unionByName(cut).mapInArrow(run, "page_id long, url string, text string, n_chars long")
