"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of words (positive) and tags (negative). The weights are log-odds of each token
inside and outside the marked article of labelled pages, those that have exactly one article or main
element; tags of lists and tables whose words aren't mostly links have weights of their own, apart from those of
menus. On a page that marks exactly one article, tags in it, but for those of link lists, weigh as little as
a tag can. The class, id and role names of the elements around a word add theirs, learned likewise from
the words inside such elements; a name of the parts that aren't content (PARTS) has a prior against it,
as marked articles hold such parts, too. Names around nearly all words of a page say nothing. Words of a
negative score, and those in elements that by HTML's own meaning aren't content (APART), are left out, and
tags there weigh nothing. A linear scan finds the run of the largest sum; the text is what it holds, out to the
edges of the blocks it begins and ends in. Parsing and scoring take time in proportion to the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm.common import in_arrow

#: Pages the weights are fitted on, the smallest by the hash of page_id and url.
LABELLED = 2000
WORD_RANGE = (0.1, 3.0)
TAG_RANGE = (-2.5, -0.1)
#: Tags that no labelled page has, outside lists and tables.
UNSEEN = -1.0

MARKED = frozenset("article main".split())
RAW = frozenset("script style noscript template textarea svg iframe object canvas select title".split())
APART = frozenset("nav footer aside form button dialog menu head header".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names of the parts that the text is to be without, and the log-odds they start from.
PARTS = frozenset("menu nav navbar navigation footer sidebar notice cookie cookies ad ads advert advertisement banner comment comments".split())
PRIOR = -8.0
#: Parts that only elements which hold others are, not paragraphs or pieces of a line.
HOLDERS = frozenset("menu nav navbar navigation footer sidebar banner".split())
LINES = frozenset("p h1 h2 h3 h4 h5 h6 a abbr b blockquote cite code em figcaption font i mark pre q s small span strong sub sup td th time u".split())
#: First words of names that speak of a layout, not of the element.
LAYOUT = frozenset("has with no without".split())
#: Names around all but this share of a page's words say nothing.
REST = 0.05
GROUPS = frozenset("ul ol dl table menu dir".split())
#: A list or table is one of links if so many of its words are.
LINKED = 2 / 3
#: A link list lowers a run by no more than this.
GROUP_LOSS = 10.0
#: Elements that end where one of the names opens, unless one of the others is open in between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "a": (("a",), ("td", "th", "table")),
}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"""[>]|=\s*(["'])""")
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
GAP = re.compile(r"[\s ]+")


def is_part(name: str) -> bool:
    """Whether a class, id or role name begins or ends with a part's name; in a line or paragraph (a name after a blank) that of a HOLDERS part doesn't count."""
    words = re.split(r"[_-]+", name.strip())
    if words[0] in LAYOUT:
        return False
    parts = PARTS - HOLDERS if name[:1] == " " else PARTS
    return words[0] in parts or words[-1] in parts


def attributes(attrs: str) -> tuple[list[str], bool]:
    """(class, id and role names of an element, whether it is hidden)."""
    names, hidden = [], False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            names += value.split()
        else:
            hidden |= name == "hidden" and not value or name == "aria-hidden" and value == "true"
    return names, hidden


class _Tags:
    """Finds tags from left to right; a `<` before anything but a name, `/`, `!` or `?` is text, as is one that no `>` follows."""

    def __init__(self, page: str):
        self.page, self.last, self.plain = page, page.rfind(">"), -1

    def _close(self, at: int) -> int:
        """Place of the tag's `>`, beyond quoted values; where a quote isn't closed, of the next `>`, for this and the tags up to the quote."""
        page, pos = self.page, at
        while pos >= self.plain and (m := STOP.search(page, pos)):
            if not m[1]:
                return m.start()
            close = page.find(m[1], m.end())
            if close < 0:
                self.plain = m.end()
                break
            pos = close + 1
        else:
            if pos >= self.plain:  # quotes are closed, the tag isn't
                self.plain = len(page)
        return page.find(">", at)

    def next(self, at: int) -> tuple | None:
        """(start, end, name, attributes, whether it ends an element) of the next tag from `at` on; comments and such have no name."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                return at, len(page) if end < 0 else end + 3, "", "", False
            if at > self.last:
                return None
            ends = page.startswith("/", at + 1)
            if m := NAME.match(page, at + 1 + ends):
                if (end := self._close(m.end())) >= 0:
                    return at, end + 1, m[0].lower(), page[m.end() : end], ends
            elif ends or page[at + 1] in "!?":
                return at, page.find(">", at) + 1, "", "", False
            at += 1
        return None


class Page:
    """A page's tokens: ('text', text, context, apart, group, region) and ('tag', name, context, apart, group, region).

    context: number of the names around; contexts has the parent and the names that are new there.
    group: the list or table around (0: none); groups has the parent, the words and the linked words.
    region: the number of the article around (0: none). apart: whether an APART element is around.
    """

    def __init__(self, page: str):
        self.tokens: list[tuple] = []
        self.contexts: list[tuple[int, list[str]]] = [(0, [])]
        self.groups: list[list[int]] = [[0, 0, 0]]
        # open elements: (name, apart, context before, names that it added, group before)
        self.stack: list[tuple] = []
        self.open: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.around: Counter = Counter()
        self.context = self.group = self.apart = self.marked = self.region = 0
        self._read(page)
        for parent, words, linked in reversed(self.groups[1:]):
            if parent:
                self.groups[parent][1] += words
                self.groups[parent][2] += linked

    def _add(self, kind: str, value: str) -> None:
        self.tokens.append((kind, value, self.context, self.apart > 0, self.group, self.region if self.marked else 0))
        if kind == "text" and self.group:
            n = len(value.split())
            self.groups[self.group][1] += n
            self.groups[self.group][2] += n if self.open["a"] else 0

    def _pop(self, to: int) -> None:
        """Close the elements from place `to` on."""
        while len(self.stack) > to:
            name, off, context, added, group = self.stack.pop()
            self.apart -= off
            self.marked -= name in MARKED
            self.context, self.group = context, group
            for x in added:
                self.around[x] -= 1
            if name:
                self.open[name].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def _end(self, name: str) -> None:
        if not self.open[name]:
            return
        at = self.open[name][-1]
        if name in BLOCKS or not self.blocks or self.blocks[-1] < at:
            self._pop(at)
        else:  # the end of a piece of a line doesn't end the blocks in it
            self.open[name].pop()
            self.stack[at] = ("", *self.stack[at][1:])

    def _implied(self, name: str) -> None:
        """End what a new element ends."""
        if name in BLOCKS and name not in ("caption", "legend") and self.open["p"] and self.blocks[-1] == self.open["p"][-1]:
            self._pop(self.open["p"][-1])
        own, beyond = ENDS.get(name, ((), ()))
        at = max((self.open[x][-1] for x in own if self.open[x]), default=-1)
        if at > max((self.open[x][-1] for x in beyond if self.open[x]), default=-1):
            self._end(next(x for x in own if self.open[x] and self.open[x][-1] == at))

    def _read(self, page: str) -> None:
        at, low, tags = 0, None, _Tags(page)
        while found := tags.next(at):
            start, end, name, attrs, ends = found
            if start > at:
                self._add("text", page[at:start])
            at = end
            if not name:
                continue
            if ends:
                self._end(name)
                self._add("tag", name)
                continue
            self._implied(name)
            self._add("tag", name)
            if name in VOID or attrs.rstrip().endswith("/"):
                continue
            if name in RAW:
                low = page.lower() if low is None else low
                if len(low) != len(page):  # a lower case of another length
                    low = re.sub("[A-Z]", lambda x: x[0].lower(), page)
                close = low.find(f"</{name}", at)
                at = len(page) if close < 0 else (page.find(">", close) + 1 or len(page))
                continue
            self._begin(name, attrs)
        if at < len(page):
            self._add("text", page[at:])

    def _begin(self, name: str, attrs: str) -> None:
        names, hidden = attributes(attrs) if attrs else ([], False)
        off = hidden or name in APART and not (name == "header" and self.marked)
        if name in MARKED and not self.apart:
            self.region += not self.marked
            self.marked += 1
        elif name in MARKED:
            name = "div"
        if name in LINES:
            names = [f" {x}" for x in names]
        added = [] if name in ("html", "body") else [x for x in dict.fromkeys(names) if not self.around[x]]
        self.open[name].append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, off, self.context, added, self.group))
        self.apart += off
        if added:
            self.around.update(added)
            self.contexts.append((self.context, added))
            self.context = len(self.contexts) - 1
        if name in GROUPS:
            self.groups.append([self.group, 0, 0])
            self.group = len(self.groups) - 1

    def of_links(self) -> list[bool]:
        """For each group whether it is a list of links, or lies in one."""
        out = [False]
        for parent, words, linked in self.groups[1:]:
            out.append(out[parent] or words > 0 and linked >= LINKED * words)
        return out

    def below(self, words: list[int]) -> list[int]:
        """Words of each context and those inside it."""
        out = list(words)
        for i in range(len(out) - 1, 0, -1):
            out[self.contexts[i][0]] += out[i]
        return out


def tokens(page: str) -> list[tuple]:
    return Page(page).tokens


def _kind(name: str, group: int, of_links: list[bool]) -> str:
    """Tags of lists and tables that aren't of links are kinds of their own."""
    return name + "~" if group and not of_links[group] else name


def labels(page: str) -> tuple[Counter, Counter] | None:
    """Tokens inside and outside the article of a page that marks exactly one, names ('@') by the words in their elements; None for others."""
    got = Page(page)
    if {t[-1] for t in got.tokens} - {0} != {1}:
        return None
    sides, of_links = (Counter(), Counter()), got.of_links()
    words = [[0] * len(got.contexts) for _ in sides]
    for t in got.tokens:
        side = 0 if t[-1] else 1
        if t[0] == "text":
            n = len(t[1].split())
            sides[side]["text"] += n
            words[side][t[2]] += n
        else:
            sides[side][_kind(t[1], t[4], of_links)] += 1
    for side, own in zip(sides, words):
        for n, (_, names) in zip(got.below(own), got.contexts):
            for name in names:
                side["@" + name] += n
    return sides


def log_odds(inside: Counter, outside: Counter) -> dict[str, float]:
    """Weights: words within WORD_RANGE, tags within TAG_RANGE, names ('@'); '' is the weight of tags not seen."""
    every = {*inside, *outside, "text"}
    kinds = [k for k in every if k[0] != "@"]
    n_in, n_out = (sum(c[k] for k in kinds) + 1 for c in (inside, outside))
    raw = {k: math.log((inside[k] + 0.5) / n_in) - math.log((outside[k] + 0.5) / n_out) for k in kinds}
    out = {k: min(max(v, TAG_RANGE[0]), TAG_RANGE[1]) for k, v in raw.items()}
    out["text"] = min(max(raw["text"] if len(raw) > 1 else 1.0, WORD_RANGE[0]), WORD_RANGE[1])
    w_in, w_out = inside["text"] + 1, outside["text"] + 1
    share = w_in / (w_in + w_out)  # one word more for each name, dealt out as all words are
    for k in every.difference(kinds):
        out[k] = math.log((inside[k] + share) / w_in) - math.log((outside[k] + 1 - share) / w_out) + (PRIOR if is_part(k[1:]) else 0.0)
    return out | {"": UNSEEN}


def is_edge(token: tuple) -> bool:
    return token[0] == "tag" and token[1] in BLOCKS


def _by_names(got: Page, weights: dict[str, float], lifted: int) -> list[float]:
    """What names add to words of each context. lifted: 0 names around nearly all words say nothing, 1 nor do the bad names around most words, 2 nor do any."""
    own = [sum(weights.get("@" + x, PRIOR if is_part(x) else 0.0) for x in names) for _, names in got.contexts]
    words = [0] * len(own)
    for t in got.tokens:
        if t[0] == "text" and not t[3]:
            words[t[2]] += len(t[1].split())
    inside = got.below(words)
    bad = [i for i, x in enumerate(own) if weights["text"] + x < 0]
    if lifted == 1 and bad:  # a part's very name is surer than one that it begins or ends
        vague = [i for i in bad if not PARTS.intersection(got.contexts[i][1])] or bad
        most = max(inside[i] for i in vague)
        bad = [i for i in bad if i not in vague or inside[i] < most]
    out = [0.0]
    keep = {i for i in bad if inside[0] - inside[i] > REST * inside[0]}
    for i, x in enumerate(own[1:], 1):
        # repeated names count once: only new ones are here
        out.append(out[got.contexts[i][0]] + (0.0 if lifted == 2 else x if i in keep or weights["text"] + x >= 0 else 0.0))
    return out


def _scored(got: Page, weights: dict[str, float], lifted: int = 0) -> list[float | None]:
    """Scores of tags and of a word of each text; None: no content, by APART elements or a negative score."""
    word, other, out = weights["text"], weights[""], []
    names, of_links = _by_names(got, weights, lifted), got.of_links()
    single = {t[-1] for t in got.tokens} - {0} == {1}
    for t in got.tokens:
        kind, value, context, apart, group, region = t
        off = apart or word + names[context] < 0
        if kind == "text":
            out.append(None if off else min(word + names[context], WORD_RANGE[1]))
        elif off:
            out.append(0.0)
        elif single and region and not of_links[group]:
            out.append(TAG_RANGE[1])
        elif group and not of_links[group]:
            out.append(weights.get(value + "~", TAG_RANGE[1]))
        else:
            out.append(weights.get(value, other))
    return _bounded(got, out, of_links)


def _bounded(got: Page, scores: list[float | None], of_links: list[bool]) -> list[float | None]:
    """Scores of outermost link lists scaled down where they lower a run by more than GROUP_LOSS."""
    top = [0]
    for i, (parent, _, _) in enumerate(got.groups[1:], 1):
        top.append(top[parent] if of_links[parent] else i if of_links[i] else 0)
    sums = [0.0] * len(top)
    for t, w in zip(got.tokens, scores):
        if (g := top[t[4]]) and w is not None:
            sums[g] += w * len(t[1].split()) if t[0] == "text" else w
    share = [GROUP_LOSS / -x if x < -GROUP_LOSS else 1.0 for x in sums]
    return [w if w is None or not top[t[4]] else w * share[top[t[4]]] for t, w in zip(got.tokens, scores)]


def _best_run(got: list[tuple], scores: list[float | None]) -> tuple[int, int]:
    """The run of the largest sum, out to the edges of blocks."""
    best = total = 0.0
    span, start = (0, 0), 0
    for i, (t, w) in enumerate(zip(got, scores)):
        if t[0] == "tag":
            total += w
        elif w is not None:
            total += w * len(t[1].split())
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    a, b = span
    if a < b:
        while a and not is_edge(got[a - 1]):
            a -= 1
        while b < len(got) and not is_edge(got[b]):
            b += 1
    return a, b


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best run; where names put every word of the page off, that without the names around most words, then without any."""
    parsed = Page(page or "")
    got = parsed.tokens
    for lifted in range(3):
        scores = _scored(parsed, weights, lifted)
        a, b = _best_run(got, scores)
        if a < b:
            break
    blocks, now = [], []
    for t, w in zip(got[a:b], scores[a:b]):
        if t[0] == "text":
            if w is not None:
                now.append(entities.unescape(t[1]))
        elif t[1] in BLOCKS:
            blocks.append("".join(now))
            now = []
        elif t[1] == "br":
            now.append(" ")
    blocks.append("".join(now))
    return "\n\n".join(x for x in (GAP.sub(" ", b).strip() for b in blocks) if x)


def fit(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = LABELLED) -> dict[str, float]:
    """Weights from labelled pages: at most `most` pages, a bounded sample by hash."""
    own = pages.select(F.xxhash64(F.col(id_col).cast("string"), F.col(url_col).cast("string")).alias("h"), F.col(html_col).cast("string").alias("html"))
    total = own.count()
    share = own if total <= most else own.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * most / total))

    def run(batches):
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                if page and (found := labels(page)):
                    inside.update(found[0])
                    outside.update(found[1])
        names = sorted({*inside, *outside})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[x] for x in names], pa.int64()), pa.array([outside[x] for x in names], pa.int64())], names=["name", "inside", "outside"])

    rows = share.select("html").transform(in_arrow, run, "name string, inside long, outside long").groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()  # names of tags and attributes of the sampled pages
    return log_odds(Counter({r[0]: r[1] for r in rows}), Counter({r[0]: r[2] for r in rows}))


def extract(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null or empty html, or no words outside elements that are never content: empty text, 0. Unclosed elements end
    with the page; an unknown character reference stays as it is. Repeated rows are pages of their own.
    Without labelled pages every word scores 1 or the range's bound. Empty table: no rows. Extra columns are ignored.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(own.dtypes)

    def run(batches):
        for batch in batches:
            text = [main_text(x, weights) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return own.transform(in_arrow, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))
