"""Main text of web pages by union-free wrappers, inferred for each host by aligning its pages.

A page is a stream of tags and texts. `infer` folds groups that repeat side by side, then aligns the folded streams of
up to `PAGES` pages of a host one after another by longest common subsequences, exact at every length: equal tokens stay,
texts that differ become slots, runs of tokens that only one side has become optional groups, folded groups repeat. The
wrapper is a regular expression without unions. From `TELLING` different pages of a host on it decides: the host's article
is the containers whose slots hold most text, an element named article or main only if it holds that, and a container
that the wrapper finds to be mostly constant is none. With fewer pages names of elements and words decide. `extract`
reads those containers of every page, without the parts that are never article: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments, and without blocks that are constant in the wrapper where
they are a container's first or last ones; not even those where they are over a quarter of the article. An element that holds the greatest article, or nearly all text, isn't cut by a word of its class. A page without
its host's containers uses those it infers from itself.

At most `PAGES` pages of a host, one for each value of a hash of the url, teach a wrapper; that is a documented bound
on training, and every page is aligned and extracted whole. Wrappers are broadcast where they are at most `BROADCAST_BYTES`, so no page moves;
larger ones are dealt with the pages by host and a salt. Null or empty html gives an empty text; a null url is a host of
its own; of containers of equal mass the greater name wins; repeated rows give equal texts; other columns play no part;
an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

PAGES = 8
#: Bits of alignment tables that are held at once; with more, rows are computed again where they are needed.
TABLE_BITS = 1 << 28
#: Wrappers of up to so many bytes in all are broadcast; pages of a host are dealt over SALTS tasks else.
BROADCAST_BYTES, SALTS = 64 << 20, 64
#: An article has this share of the greatest article's text at least; smaller ones are teasers.
SHARE = 0.25
#: An element with this share of a page's text isn't cut by a word of its class.
NEARLY_ALL = 0.9
#: Of pages that vary in less of their text nothing is told; ends of an article that are more of it than the rest of this aren't cut.
LEAST_VARYING, MOST_KEPT = 0.25, 0.75
#: Constant texts are told from so many different pages of a host on.
TELLING = 3
#: Elements and words of class or id that never are article; void, block and container elements.
NEVER = frozenset("script style noscript template nav footer aside form button select option textarea input iframe svg canvas head title menu dialog".split())
WORDS = frozenset("nav navbar navigation menu footer sidebar ad ads advert advertisement adverts banner promo sponsor sponsored cookie cookies consent notice alert comments comment respond replies reply share social related recommended breadcrumb breadcrumbs popup modal newsletter subscribe login signup search pagination pager widget toolbar masthead copyright disclaimer".split())
OUTSIDE = frozenset(("header", "hgroup"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = ("article", "main", "section", "div", "td", "body", "html")
CLOSES = {"p": BLOCK, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",)), "option": frozenset(("option",))}

_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: A tag's values may hold `>` in quotes.
_TOKEN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>|([^<]+|<)""")
#: What may stand in a head.
HEAD = frozenset("title meta link script style base noscript template".split())
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


@lru_cache(4096)
def _named(attributes: str) -> tuple[str, int]:
    """Class and id of a tag, and 2 if one of them is a word that never is article, 1 if only a part of one is."""
    found = _NAMED.findall(attributes)
    values = [(k.lower(), a or b or c) for k, a, b, c in found]
    whole = {w for _, v in values for w in v.lower().split()}
    parts = {w for x in whole for w in re.split(r"[^a-z0-9]+", x)}
    return "".join(f"[{k}={v}]" for k, v in values if k != "role" and not re.search(r"\d", v)), 2 if whole & WORDS else int(bool(parts & WORDS))


def tokens(html: str):
    """(kind, tag, attributes or text): kinds are 1 open, 2 close, 0 text."""
    for m in _TOKEN.finditer(_RAW.sub(" ", html)):
        close, tag, attributes, text = m.groups()
        if tag:
            yield (2 if close else 1), tag.lower(), attributes
        elif text:
            yield 0, "", text


def _never(tag: str, level: int, stack: list, spared: bool) -> bool:
    """Whole pages, main, code and what is spared are never cut by a word; articles not by a part of a name."""
    if tag in NEVER:
        return True
    if not level or tag in ("html", "body", "main") or any(s[0] in ("pre", "code") for s in stack):
        return False
    return not (spared or level == 1 and tag == "article")


def walk(html: str):
    """(kind, tag, name, text, stack) with unclosed elements closed; stack holds (tag, name, never, number)."""
    known = list(tokens(html))
    spared: set[int] = set()
    levels = {n: _named(rest)[1] for n, (kind, _, rest) in enumerate(known) if kind == 1}
    if any(levels.values()):
        # Named by a part only: spared if they hold an article or main, or more than half of the text. Named by a whole
        # word: if they hold the greatest article or main (one that isn't named so itself), or nearly all text.
        inside: Counter = Counter()
        total = 0
        above: dict[int, list[int]] = {}
        for kind, tag, _, text, stack in _walk(known, set(levels)):
            if kind == 0 and not any(s[2] for s in stack):
                n = len("".join(text.split()))
                total += n
                for s in stack:
                    inside[s[3]] += n
            elif kind == 1 and tag in ("article", "main") and stack and not any(s[2] for s in stack):
                above[stack[-1][3]] = [s[3] for s in stack[:-1]]
                spared.update(s[3] for s in stack if levels[s[3]] == 1)
        spared |= {k for k, n in inside.items() if levels[k] == 1 and 2 * n > total or n > NEARLY_ALL * total}
        named = [k for k in above if levels[k] < 2]
        spared.update(above[max(named, key=lambda k: (inside[k], -k))] if named else ())
    yield from _walk(known, spared)


def _walk(known: list[tuple], spared: set[int]):
    stack: list[tuple[str, str, bool, int]] = []
    for number, (kind, tag, rest) in enumerate(known):
        if kind == 0:
            yield 0, "", "", rest, stack
        elif kind == 1:
            if tag not in HEAD:
                for k, s in enumerate(stack):
                    if s[0] == "head":  # left open
                        del stack[k:]
                        break
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES:
                    if tag in CLOSES[stack[k][0]]:
                        del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
            named, level = _named(rest)
            name = tag + named
            if tag not in VOID and not rest.endswith("/"):
                stack.append((tag, name, _never(tag, level, stack, number in spared), number))
            yield 1, tag, name, "", stack
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            yield 2, tag, tag, "", stack


def folded(stream: list[tuple]) -> list[tuple]:
    """Groups of up to eight tokens that repeat side by side become one ('+', group, its texts)."""
    out: list[tuple] = []
    i = 0
    shape = [t[:2] if t[0] != "#" else ("#",) for t in stream]
    while i < len(stream):
        for n in range(1, 9):  # the least period, so that groups of different counts align
            k = 1
            while shape[i + k * n : i + (k + 1) * n] == shape[i : i + n] and stream[i][0] == "<" and stream[i + n - 1][0] == "/":
                k += 1
            if k > 1:
                out.append(("+", tuple(shape[i : i + n]), frozenset(t[1:] for t in stream[i : i + k * n] if t[0] == "#")))
                i += k * n
                break
        else:
            out.append(stream[i])
            i += 1
    return out


def _path(stack: list) -> str:
    return ">".join(s[1] for s in stack)


def stream(html: str) -> list[tuple]:
    """Tokens ('<' or '/', name) and ('#', text, path of the elements around it), folded."""
    out = []
    for kind, _, name, text, stack in walk(html):
        if kind == 0:
            if text := " ".join(text.split()):
                out.append(("#", text, _path(stack)))
        else:
            out.append(("<" if kind == 1 else "/", name))
    return folded(out)


def _shape(t: tuple) -> tuple:
    return ("#",) if t[0] in "#*" else t[1] if t[0] == "?" else t[:2]


def common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence, as places in both: a row of the table is the bits of a whole number."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    k = 0
    while k < min(len(a), len(b)) - i and a[-1 - k] == b[-1 - k]:
        k += 1
    head, tail = [(x, x) for x in range(i)], [(len(a) - x, len(b) - x) for x in range(k, 0, -1)]
    a, b = a[i : len(a) - k], b[i : len(b) - k]
    if not a or not b:
        return head + tail
    masks: dict = {}
    for j, t in enumerate(b):
        masks[t] = masks.get(t, 0) | 1 << j
    full = (1 << len(b)) - 1

    def rows(v: int, part: list) -> list[int]:
        """The rows behind row v; a bit is 0 where the length grows."""
        out = []
        for t in part:
            u = v & masks.get(t, 0)
            v = (v + u | v - u) & full
            out.append(v)
        return out

    # Every nth row is kept, the others come again from the one before.
    step = max(1, -(-len(a) * len(b) // TABLE_BITS))
    kept, v = [full], full
    for at in range(0, len(a), step):
        v = rows(v, a[at : at + step])[-1]
        kept.append(v)
    found, x, j, block, table = [], len(a), len(b), -1, [full]
    while x and j:
        if (x - 1) // step != block:
            block = (x - 1) // step
            table = [kept[block], *rows(kept[block], a[block * step : (block + 1) * step])]
        at = x - block * step
        if table[at] >> (j - 1) & 1:
            j -= 1
        else:
            x -= 1
            if not x or table[at - 1] >> (j - 1) & 1:
                j -= 1
                found.append((x + i, j + i))
    return head + found[::-1] + tail


def align(wrapper: list[tuple], page: list[tuple], number: int = 1) -> list[tuple]:
    """The wrapper that matches both: slots for texts that differ, optional groups for what one side lacks.

    Tokens that are equal, texts included, are aligned first, and between them those of one shape. An optional token is
    ('?', shape, group); the tokens of one run have one group, named by the page's number.
    """
    a, b = [_shape(t) for t in wrapper], [_shape(t) for t in page]
    whole = lambda stream: [t[:2] if t[0] in "#</" and len(t) > 1 else _shape(t) for t in stream]
    pairs, i, k = [], 0, 0
    for x, y in [*common(whole(wrapper), whole(page)), (len(a), len(b))]:
        pairs += [(i + m, k + n) for m, n in common(a[i:x], b[k:y])]
        pairs.append((x, y))
        i, k = x + 1, y + 1
    out: list[tuple] = []
    i = k = 0
    for x, y in pairs:
        out += [t if t[0] == "?" else ("?", _shape(t), (number, len(out), 0)) for t in wrapper[i:x]]
        out += [("?", t, (number, y, 1)) for t in b[k:y]]
        i, k = x + 1, y + 1
        if x == len(a):
            break
        p, q = wrapper[x], page[y]
        if p[0] == "?":
            out.append(p)
        elif p[0] == "+" and q[0] == "+":
            out.append((*p[:2], p[2] & q[2]))
        else:
            out.append(("*",) if p[0] == "#" and q[0] == "#" and p != q else p)
    return _grouped(out)


def _grouped(wrapper: list[tuple]) -> list[tuple]:
    """Neighbours that one page or the wrapper before it lacked are one group: they take the name of the first."""
    out: list[tuple] = []
    for t in wrapper:
        if t[0] == "?" and out and out[-1][0] == "?" and out[-1][2][::2] == t[2][::2]:
            t = (*t[:2], out[-1][2])
        out.append(t)
    return out


def expression(wrapper: list[tuple]) -> str:
    """The wrapper as text: `#` a slot, (...)+ a repeated and (...)? an optional group."""

    def told(t):
        if t[0] == "+":
            return "(" + "".join(told(x) for x in t[1]) + ")+"
        return "#" if t[0] in "*#" and len(t) < 2 or t[0] == "*" else re.escape(t[1]) if t[0] == "#" else f"<{'/' * (t[0] == '/')}{t[1]}>"

    parts = []
    for group, run in groupby(wrapper, lambda t: t[2] if t[0] == "?" else None):
        text = "".join(told(t[1] if group else t) for t in run)
        parts.append(f"({text})?" if group else text)
    return "".join(parts)


def constants(wrapper: list[tuple]) -> frozenset:
    """(text, path) of the texts that every aligned page has at this place, repeated groups included."""
    return frozenset(t[1:] for t in wrapper if t[0] == "#") | frozenset(x for t in wrapper if t[0] == "+" for x in t[2])


def _constant(text: str, stack: list, fixed: frozenset) -> bool:
    return bool(fixed) and (" ".join(text.split()), _path(stack)) in fixed


def containers(html: str, fixed: frozenset = frozenset()) -> Counter:
    """Characters of slots, outside what never is article, by the names of all containers around them."""
    mass: Counter = Counter()
    for kind, _, _, text, stack in walk(html):
        if kind == 0 and not _constant(text, stack, fixed) and not any(s[2] or s[0] in ("a", *OUTSIDE) for s in stack):
            n = len("".join(text.split()))
            for name in {s[1] for s in stack if s[0] in CONTAINER}:
                mass[name] += n
    return mass


def main_of(pages: list[str], fixed: frozenset = frozenset(), told: bool = False) -> tuple[str, ...]:
    """The names of the article's containers: articles or main if there are any, else the innermost whose slots hold most text.

    Where a wrapper tells constants (`told`), articles or main must hold most of what the slots hold.

    Several articles, such as posts of different classes, are all read, if they are of some size beside the greatest.
    Text in no container at all, as in a fragment, is the article itself: the name is empty.
    """
    mass: Counter = Counter()
    inner: Counter = Counter()
    for p in pages:
        mass.update(containers(p, fixed))
        for kind, _, _, text, stack in walk(p):
            if kind == 0 and not _constant(text, stack, fixed) and not any(s[2] for s in stack):
                names = [s[1] for s in stack if s[0] in CONTAINER]
                if names:
                    inner[names[-1]] += len("".join(text.split()))
    total = max(mass.values(), default=0)
    for tag in ("article", "main"):
        named = [n for n in mass if n.split("[")[0] == tag]
        # Nested articles of several names count more than once here, which only makes them likelier.
        if named and not (told and 2 * sum(mass[n] for n in named) <= total):
            most = max(mass[n] for n in named)
            return tuple(sorted(n for n in named if mass[n] >= SHARE * most))
    fit = [n for n in mass if mass[n] >= 0.6 * total]
    return (max(fit, key=lambda n: (inner[n], n), default=""),)


def _varying(html: str, fixed: frozenset = frozenset()) -> int:
    """Characters outside what never is article, without those that are constant."""
    return sum(len("".join(text.split())) for kind, _, _, text, stack in walk(html) if kind == 0 and not _constant(text, stack, fixed) and not any(s[2] or s[0] in ("a", *OUTSIDE) for s in stack))


def infer(pages: list[str]) -> dict:
    wrapper: list[tuple] = []
    for k, p in enumerate(pages):
        wrapper = align(wrapper, stream(p), k) if k else stream(p)
    told = len(set(pages)) >= TELLING
    fixed = constants(wrapper) if told else frozenset()
    if fixed and sum(_varying(p, fixed) for p in pages) < LEAST_VARYING * sum(_varying(p) for p in pages):
        fixed, told = frozenset(), False  # the pages are copies of each other
    main = main_of(pages, fixed, told)
    if fixed and sum(len(extract(p, main, fixed)) for p in pages) < MOST_KEPT * sum(len(extract(p, main)) for p in pages):
        fixed = frozenset()
    return {"main": json.dumps(main), "fixed": json.dumps(sorted(fixed)), "expression": expression(wrapper)}


@lru_cache(256)
def _fixed(told: str | None) -> frozenset:
    return frozenset(map(tuple, json.loads(told or "[]")))


@lru_cache(1024)
def _main(told: str | None) -> tuple[str, ...] | None:
    return tuple(json.loads(told)) if told else None


def extract(html: str, main: tuple[str, ...] | None, fixed: frozenset = frozenset()) -> str:
    """The article's blocks, joined by line ends; of each container's first and last ones those that are constant go."""
    #: (text, whether it is constant, number of its container)
    blocks: list[tuple[str, bool, int]] = []
    now: list[str] = []
    seen = slot = False
    where = -1

    def end():
        nonlocal slot
        if text := " ".join("".join(now).split()):
            blocks.append((text, not slot, where))
        now.clear()
        slot = False

    for kind, tag, _, text, stack in walk(html):
        inside, own = main == ("",), -1
        for s in stack:
            if not inside and main and s[1] in main:
                inside, own = True, s[3]
            if s[2] or not inside and s[0] in OUTSIDE:
                inside = False
                break
        seen = seen or inside
        if kind == 0:
            if inside:
                if own != where:
                    end()
                    where = own
                now.append(entities.unescape(text))
                slot = slot or bool(text.strip()) and not _constant(text, stack, fixed)
        elif tag in BLOCK:
            end()
        elif tag == "br":
            now.append(" ")
    end()
    if not seen and main is not None:
        own = main_of([html])
        return extract(html, own, fixed) if own != main else ""
    out: list[str] = []
    for _, run in groupby(blocks, lambda b: b[2]):
        part = list(run)
        varying = [k for k, b in enumerate(part) if not b[1]]
        out += [b[0] for b in part[varying[0] : varying[-1] + 1]] if varying else []
    return "\n".join(out)


def _infer_batches(batches):
    schema = pa.schema([("host", pa.string()), ("main", pa.string()), ("fixed", pa.string()), ("expression", pa.string())])
    for b in batches:
        found = [infer(sorted(p for p in pages if p)) for pages in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), *[pa.array([w[c] for w in found], pa.string()) for c in ("main", "fixed")], pa.array([w["expression"] for w in found], pa.string())], schema=schema)


def _extract_batches(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    for b in batches:
        text = [extract(h or "", _main(m), _fixed(x)) for h, m, x in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(text, pa.string())], schema=schema)


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, main, fixed (constant texts and their paths) and expression: one wrapper for each host."""
    h = F.xxhash64("url")
    drawn = _hosted(pages).filter("html is not null").groupBy("host", F.pmod(h, F.lit(PAGES)).alias("_s")).agg(F.min_by("html", F.struct(h, "page_id")).alias("html"))
    return drawn.groupBy("host").agg(F.collect_list("html").alias("pages")).mapInArrow(_infer_batches, "host string, main string, fixed string, expression string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    known = materialize(wrappers(pages).select("host", "main", "fixed"))
    size = known.agg(F.sum(F.octet_length("host") + F.octet_length("main") + F.octet_length("fixed") + 64)).first()[0] or 0
    rows = _hosted(pages)
    if size <= BROADCAST_BYTES:
        out = rows.join(F.broadcast(known), "host", "left")
    else:  # a hot host's pages are dealt over SALTS tasks, each of which gets its wrapper
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return out.select("page_id", "url", "html", "main", "fixed").mapInArrow(_extract_batches, "page_id long, url string, text string")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
