"""Main text of web pages: a linear-chain CRF over the leaf blocks of the page.

A block is the text between two borders of block-level elements. Its features are the tags,
class, id and role words of its ancestors and some of its text's shape. Each block is article
or not; neighbouring labels depend on each other; the best sequence is found by Viterbi. The
weights maximise the likelihood of the labelled pages of ``labelled_pages``, which are
written here from many layouts. The article may hold adverts, notices, asides, forms and comments.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# --- blocks ------------------------------------------------------------------------

_MARKUP = re.compile("<(?=[!?/a-zA-Z])")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile("[a-z]+")

# Elements whose content is no text of the page; some of them hold others of their kind.
_SILENT = frozenset("script style noscript template svg iframe title".split())
_NESTED = frozenset(["template", "svg"])
_BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol optgroup option p pre search section select summary"
    " table tbody td textarea tfoot th thead tr ul caption head".split())
# What a start tag ends implicitly, and the elements it does not look beyond.
_ENDS_P = _BLOCK - {"button", "label", "legend", "option", "optgroup", "select", "textarea", "caption", "html", "body", "head"}
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_P_STOPS = {"td", "th", "button", "table"}
_SECTIONS = frozenset("article aside footer form header main nav section".split())


@dataclass
class Block:
    """A block's text, its number of words inside links, and the features of where it stands."""

    text: str
    linked: int
    place: int


@dataclass
class Places:
    """Chains of open elements by number, with their features; forgotten when there are too many.

    What an element passes on to those in it is kept once for all that add nothing to it. ``vocabulary`` limits
    features to those that count.
    """

    vocabulary: frozenset[str] | None = None
    limit: int = 100_000
    numbers: dict[tuple, int] = field(default_factory=dict)
    passed: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])
    alone: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    sections: list[tuple[str, ...]] = field(default_factory=lambda: [()])

    @property
    def features(self) -> _Features:
        return _Features(self)

    def child(self, parent: int, tag: str, attributes: str) -> int:
        words = ()
        if attributes and "=" in attributes:
            values = (a or b or c for a, b, c in _NAMED.findall(attributes))
            words = tuple(sorted({w for v in values for w in _WORD.findall(v.lower())}))
        key = (parent, tag, words)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.passed)
            own = {f"t:{tag}", *(f"w:{w}" for w in words)}
            if self.vocabulary is not None:
                own &= self.vocabulary
            before = self.passed[parent]
            sections = (*self.sections[parent], tag)[-2:] if tag in _SECTIONS else self.sections[parent]
            self.passed.append(before if own <= before else before | own)
            self.alone.append((f"o:{tag}", "s:" + ">".join(sections)))
            self.sections.append(sections)
        return number

    def trim(self) -> bool:
        if len(self.passed) <= self.limit:
            return False
        self.numbers.clear()
        del self.passed[1:], self.alone[1:], self.sections[1:]
        return True


@dataclass(frozen=True)
class _Features:
    places: Places

    def __getitem__(self, number: int) -> frozenset[str]:
        return self.places.passed[number].union(self.places.alone[number])


@dataclass
class _Open:
    """The open elements, with the places of each tag among them."""

    elements: list[tuple[str, int]] = field(default_factory=lambda: [("", 0)])
    at: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))

    def push(self, tag: str, place: int) -> None:
        self.at[tag].append(len(self.elements))
        self.elements.append((tag, place))

    def _last(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def end(self, tags: Iterable[str], stops: Iterable[str] = ()) -> None:
        """End the last element of these tags with all in it, unless one of ``stops`` began after it."""
        last = self._last(tags)
        if last > self._last(stops):
            while len(self.elements) > last:
                self.at[self.elements.pop()[0]].pop()


def _after_silent(html: str, at: int, tag: str) -> int:
    """Where the text goes on after an element whose content counts for nothing."""
    depth, shut = 1, at
    for found in re.compile(f"<(/?){tag}(?=[\\s/>]|\\Z)", re.I).finditer(html, at):
        if not found[1] and tag not in _NESTED:
            continue
        if shut < found.end():  # the end of the tag, looked for once
            shut = html.find(">", found.end())
            if shut < 0:
                return len(html)
        depth += -1 if found[1] else html[shut - 1] != "/"
        if not depth:
            return shut + 1
    return len(html)


def blocks(html: str, places: Places) -> list[Block]:
    """The blocks of a page with any text, in page order; in time proportional to its length, whatever it holds.

    A tag ends at the first ``>`` outside quotes. If a quote is never closed, this and all further tags end at the
    first one. Without any, what looks like a tag is text.
    """
    out: list[Block] = []
    stack = _Open()
    parts: list[str] = []
    link: list[str] = []
    in_link = False

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, len("".join(link).split()), stack.elements[-1][1]))
            parts.clear()
            link.clear()

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                link.append(text)

    at, size, quoted = 0, len(html), True
    while at < size:
        found = _MARKUP.search(html, at)
        if found is None:
            add(html[at:])
            break
        start = found.start()
        add(html[at:start])
        ends = "-->" if html.startswith("<!--", start) else "]]>" if html.startswith("<![CDATA[", start) else None
        if ends is not None:
            shut = html.find(ends, start + (4 if ends == "-->" else 9))
            at = size if shut < 0 else shut + 3
            continue
        name = _NAME.match(html, start)
        if name is None and html[start + 1] == "/":
            add("<")
            at = start + 1
            continue
        shut, attributes = -1, ""
        if name is not None and quoted:
            inside = _ATTRIBUTES.match(html, name.end())
            quoted = inside is not None
            if quoted:
                shut, attributes = inside.end() - 1, inside[1]
        if shut < 0:
            shut = html.find(">", start + 1)
            if shut < 0:
                add(html[start:])
                break
            attributes = html[name.end() : shut] if name is not None else ""
        at = shut + 1
        if name is None:
            continue
        tag = name[2].lower()
        if name[1]:
            if tag in _BLOCK:
                flush()
                stack.end((tag,))
            elif tag == "a":
                in_link = False
        elif tag in _SILENT:
            if not attributes.endswith("/"):
                at = _after_silent(html, at, tag)
        elif tag in _BLOCK:
            flush()
            if tag in _ENDS_P:
                stack.end(("p",), _P_STOPS)
            if tag in _ENDS:
                stack.end(*_ENDS[tag])
            stack.push(tag, places.child(stack.elements[-1][1], tag, attributes))
        elif tag == "a":
            in_link = True
            link.append(" ")
        elif tag == "br":
            add(" ")
        elif tag == "hr":
            flush()
    flush()
    return out


def shape(block: Block) -> list[str]:
    """Features of a block's text."""
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / words
    out = [
        f"n:{min(words.bit_length(), 7)}",
        "l:none" if share == 0 else "l:some" if share < 0.5 else "l:most" if share < 0.95 else "l:all",
    ]
    if text[-1] in ".!?…。！？\"”":
        out.append("x:stop")
    if text[0].isupper():
        out.append("x:capital")
    if "," in text:
        out.append("x:comma")
    if "©" in text[:40] or text[:9].lower() == "copyright":
        out.append("x:rights")
    return out


# --- the model -----------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Log-odds of article by feature, transition scores [from][to], and the bias."""

    weights: dict[str, float]
    transitions: tuple[tuple[float, float], tuple[float, float]]
    bias: float

    def place(self, features: frozenset[str]) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features)

    def labels(self, scores: list[float]) -> list[bool]:
        """Viterbi: the likeliest labels of blocks with these log-odds."""
        (aa, ab), (ba, bb) = self.transitions
        no, yes, back = 0.0, 0.0, []
        for i, s in enumerate(scores):
            if i == 0:
                no, yes = 0.0, s
                continue
            from_no, from_yes = ba > aa + no - yes, bb >= ab + no - yes
            back.append((from_no, from_yes))
            no, yes = (yes + ba if from_no else no + aa), (yes + bb if from_yes else no + ab) + s
        out = [yes > no] if scores else []
        for pointers in reversed(back):
            out.append(pointers[out[-1]])
        return out[::-1]


def fit(pages: list[list[tuple[list[str], bool]]], rounds: int = 300, ridge: float = 0.02, rate: float = 0.15) -> Model:
    """Weights of greatest likelihood, less a ridge, over pages of (features, label), by gradient steps."""
    names = sorted({f for page in pages for features, _ in page for f in features})
    index = {f: i for i, f in enumerate(names)}
    longest, n = max(map(len, pages)), len(pages)
    x = np.zeros((longest, n, len(names) + 1), np.float32)
    y, live = np.zeros((longest, n), np.int64), np.zeros((longest, n), bool)
    for p, page in enumerate(pages):
        for t, (features, label) in enumerate(page):
            x[t, p, [index[f] for f in set(features)]] = 1
            x[t, p, -1] = 1
            y[t, p], live[t, p] = label, True
    flat = x.reshape(longest * n, -1)
    w, move = np.zeros(len(names) + 1), np.zeros((2, 2))
    mean, square, step = np.zeros(len(w) + 4), np.zeros(len(w) + 4), 0
    both = live[1:] & live[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][both], y[1:][both]), 1)
    for _ in range(rounds):
        s = (flat @ w.astype(np.float32)).reshape(longest, n).astype(np.float64)
        node = np.stack([np.zeros_like(s), s], axis=2)
        forward, backward = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        forward[0] = node[0]
        for t in range(1, longest):
            a = forward[t - 1][:, :, None] + move
            forward[t] = np.where(live[t][:, None], np.logaddexp(a[:, 0], a[:, 1]) + node[t], forward[t - 1])
        for t in range(longest - 2, -1, -1):
            a = move + (node[t + 1] + backward[t + 1])[:, None, :]
            backward[t] = np.where(live[t + 1][:, None], np.logaddexp(a[:, :, 0], a[:, :, 1]), 0)
        total = np.logaddexp(forward[-1][:, 0], forward[-1][:, 1])
        chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - total)
        gradient = ((y - chance) * live).reshape(-1).astype(np.float32) @ flat / n
        expected = np.zeros((2, 2))
        for t in range(longest - 1):
            joint = forward[t][:, :, None] + move + (node[t + 1] + backward[t + 1])[:, None, :] - total[:, None, None]
            expected += np.exp(joint[live[t + 1]]).sum(0)
        ascent = np.concatenate([gradient - ridge * w / 10, ((seen - expected) / n - ridge * move / 10).reshape(-1)])
        step += 1
        mean, square = 0.9 * mean + 0.1 * ascent, 0.99 * square + 0.01 * ascent**2
        change = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, move = w + change[: len(w)], move + change[len(w) :].reshape(2, 2)
    kept = {f: float(v) for f, v in zip(names, w, strict=False)}
    return Model(kept, tuple(tuple(map(float, row)) for row in move), float(w[-1]))


# --- labelled pages -------------------------------------------------------------------

_MAIN = ""
LABELLED_PAGES = 400

_ARTICLE_NAMES = "content main post entry article story text body page single blog news column primary".split()
_OTHER_NAMES = {
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs links topbar toolbar tabs pagination pager skip".split(),
    "header": "header masthead top banner logo branding sitename tagline".split(),
    "footer": "footer foot copyright bottom colophon legal credits imprint".split(),
    "side": "sidebar side aside widget related recommended popular trending teaser tags archive author bio share social".split(),
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion commercial adbox banner dfp taboola".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall warning message".split(),
    "form": "form search login signup contact register".split(),
    "comments": "comments comment commentlist reply replies discussion respond disqus responses thread".split(),
}


class _Writer:
    """Pages of random words and layouts."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        sound = ["".join(self.r.choices("bcdfglmnprstvz", k=1) + self.r.choices("aeiouéü", k=1)) for _ in range(40)]
        return " ".join("".join(self.r.choices(sound, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.r.choice([".", ".", ".", "!", "?", ", etc."])

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def named(self, names: list[str]) -> str:
        value = self.r.choice(["", self.r.choice(["x-", "site-", "c-", "the"])]) + self.r.choice(names)
        value += self.r.choice(["", "", "", "-" + self.r.choice(["box", "wrap", "inner", "area", "list", "item", "block"]), " clear"])
        return f' {self.r.choice(["class", "class", "id"])}="{value}"'

    def links(self, low: int = 2, high: int = 7) -> str:
        item = lambda: f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>'
        n = self.r.randint(low, high)
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return self.r.choice([" | ", " ", " · "]).join(item() for _ in range(n))

    def other(self, kind: str) -> str:
        """An element that is not the article."""
        r, names = self.r, _OTHER_NAMES[kind]
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind)
        text = self.prose(1, 3)
        inner = {
            "menu": lambda: self.links(),
            "header": lambda: r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 6)}</p>", self.links(), f"<div>{text}</div>"]),
            "footer": lambda: r.choice(["&copy; ", "© ", "Copyright ", ""]) + self.words(1, 3) + r.choice([" &middot; ", " "]) + text
            + r.choice(["", self.links(1, 4)]),
            "side": lambda: r.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + r.choice([self.links(), f"<p>{text}</p>", text]),
            "ad": lambda: r.choice([text, f"<p>{text}</p>", f'<a href="/x">{text}</a>', f"<b>{self.words(1, 4)}</b> {text}"]),
            "notice": lambda: r.choice([text, f"<p>{text}</p>"]) + r.choice(["", "<button>Ok</button>", f'<a href="/p">{self.words(1, 2)}</a>']),
            "form": lambda: f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>"
            + r.choice(["", f"<p>{self.sentence()}</p>", "<select><option>a<option>b</select>"]),
            "comments": lambda: r.choice(["", f"<h3>{self.words(1, 2)}</h3>"]) + "".join(
                r.choice(["<div{0}><p>{1}</p></div>", "<li{0}><b>{2}</b> {1}</li>", "<article{0}><p>{1}</p></article>", "<p>{1}</p>"]).format(
                    self.named(names), self.prose(1, 4), self.words(1, 2)) for _ in range(r.randint(1, 4))),
        }[kind]()
        if tag and r.random() < 0.6:
            return f"<{tag}{r.choice(['', self.named(names)])}>{inner}</{tag}>"
        wrap = r.choice(["div", "div", "section", "aside" if kind in ("ad", "notice", "side") else "div"])
        return f"<{wrap}{self.named(names)}>{inner}</{wrap}>"

    def part(self) -> str:
        """A block of the article."""
        r, text = self.r, _MAIN + self.prose(1, 6)
        return r.choice([
            f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text} <a href='/a'>{self.words(1, 3)}</a>.</p>",
            f"<h2>{_MAIN}{self.words(2, 6)}</h2>", f"<blockquote><p>{text}</p></blockquote>", f"<p><em>{_MAIN}{self.words(1, 3)}</em></p>",
            "<ul>" + "".join(f"<li>{_MAIN}{self.sentence()}</li>" for _ in range(r.randint(2, 4))) + "</ul>",
            f"<pre>{text}</pre>", f"<figure><img src=a><figcaption>{_MAIN}{self.sentence()}</figcaption></figure>", f"<div>{text}</div>",
        ])

    def page(self) -> str:
        r = self.r
        parts = [self.part() for _ in range(r.randint(1, 9))]
        title = f"<h1>{_MAIN}{self.words(2, 9)}</h1>" if r.random() < 0.8 else ""
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        for kind in r.choices(["ad", "side", "notice", "form", "comments"], k=r.choice([0, 0, 1, 2])):
            parts.insert(r.randint(1, len(parts)) if kind != "comments" else len(parts), self.other(kind))
        body = title + "".join(parts)
        container = r.choice(["article", "article", "article", "main", "div", "div", "section", "none"])
        if container != "none":
            name = self.named(_ARTICLE_NAMES) if container in ("div", "section") or r.random() < 0.3 else ""
            body = f"<{container}{name}>{body}</{container}>"
        before = [self.other(k) for k in ("header", "menu", "ad", "notice", "form", "side") if r.random() < 0.45]
        after = [self.other(k) for k in ("comments", "side", "ad", "form", "menu", "notice", "footer") if r.random() < 0.4]
        r.shuffle(before)
        head = '<head><meta charset="utf-8"><title>' + self.words(2, 6) + "</title><style>p{margin:0}</style></head>"
        return f'<!DOCTYPE html><html lang="en">{head}<body>{"".join(before)}{body}{"".join(after)}</body></html>'


def labelled_pages(n: int = LABELLED_PAGES, seed: int = 5) -> list[list[tuple[list[str], bool]]]:
    """Blocks of written pages: their features, and whether they belong to the article."""
    writer, out = _Writer(seed), []
    while len(out) < n:
        places = Places()
        page = []
        for block in blocks(writer.page(), places):
            label = block.text.startswith(_MAIN)
            block.text = block.text.replace(_MAIN, "") or "-"
            page.append(([*places.features[block.place], *shape(block)], label))
        if page:
            out.append(page)
    return out


@lru_cache(maxsize=1)
def model() -> Model:
    return fit(labelled_pages())


# --- the operator ------------------------------------------------------------------------


class Extractor:
    """Main text of one page after the other."""

    def __init__(self, crf: Model):
        self._crf, self._places, self._known = crf, Places(frozenset(crf.weights)), {}

    def text(self, html: str) -> str:
        if self._places.trim():
            self._known.clear()
        found, scores = blocks(html, self._places), []
        for block in found:
            place = self._known.get(block.place)
            if place is None:
                place = self._known[block.place] = self._crf.place(self._places.features[block.place])
            scores.append(place + sum(self._crf.weights.get(f, 0.0) for f in shape(block)))
        return "\n\n".join(b.text for b, main in zip(found, self._crf.labels(scores), strict=True) if main)


def _extract(crf: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(crf)
        for batch in batches:
            texts = [extractor.text(x or "") for x in batch.column("html").to_pylist()]
            out = {name: batch.column(name) for name in names}
            yield pa.record_batch(out | {
                "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return run


def extract(pages: DataFrame, keep: list[str], crf: Model | None = None) -> DataFrame:
    """The columns ``keep`` of ``pages`` with text, the article of ``html``, and n_chars, its code points.

    Blocks of the article come in page order with two line feeds between, white space inside
    them is one space, character references are decoded. Null and empty pages, and pages whose
    blocks all are something else, have the empty text. Other columns are not read; kept columns named
    text or n_chars are replaced. Repeated rows are read each; an empty table gives an empty one.
    """
    names = [c for c in keep if c not in ("text", "n_chars")]
    schema = T.StructType([*(pages.schema[c] for c in names), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    columns = list(dict.fromkeys([*names, "html"]))
    return pages.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(_extract(crf or model(), names), schema)
