"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: runs of text between block-level tags.  Each
block is described by the tags and class/id words of its ancestors and by its
text; the chain decides together which blocks are main text (Viterbi).  It is
trained on labelled pages: pages of the given table that mark their article
with a landmark element, and made-up layouts with other marking.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest, map_text, quoted

#: Labelled pages of the table that the model is trained on, at most, and made-up ones
FIT_PAGES, MADE_PAGES = 200, 240
EPOCHS, RATE, DECAY, SEED = 20, 0.3, 1e-4, 8

#: Elements whose content is not text; elements without an end;
#: elements inside a line of text; and what an opening tag closes by itself.
RAW = frozenset("script style template iframe textarea select title head annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " audio canvas noscript object param source track video"
    " math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics"
    " svg circle clippath defs desc ellipse g line lineargradient path polygon polyline rect stop symbol text textpath tspan use".split()
)
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "option": ("option", ()), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",))}
LANDMARKS = frozenset(("article", "main"))
ASIDE_TAGS = frozenset("nav aside footer header form button menu dialog".split())
ASIDE_WORDS = frozenset("comment comments reply replies respond sidebar advert ad ads promo share related cookie newsletter breadcrumb".split())

_open = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_special = re.compile(r"[>\"']")
_named = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_word = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "tags", "words", "own", "linked", "marked")

    def __init__(self, text, tags, words, own, linked, marked):
        self.text, self.tags, self.words, self.own, self.linked, self.marked = text, tags, words, own, linked, marked


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, stop, name, whether it is an end, attributes) of each tag; comments
    and declarations have no name.  ``send(place)`` goes on from there.

    Every place is looked at a fixed number of times at most, whatever the page
    leaves open: a tag without > is text, and a comment or declaration without
    its end takes the rest.
    """
    at, n, last = 0, len(page), page.rfind(">")
    #: quotes from which no end of a tag is reached outside quotes
    dead: set[int] = set()

    def tag_end(place: int) -> int:
        """The > that is not inside a quoted value, or else the first one."""
        seen, here = [], place
        while m := _special.search(page, here):
            i = m.start()
            if page[i] == ">":
                return i
            if i in dead:
                break
            seen.append(i)
            if (here := page.find(page[i], i + 1) + 1) == 0:
                break
        dead.update(seen)
        return page.index(">", place)

    while m := _open.search(page, at):
        start = m.start()
        if m[1]:
            stop = page.find("-->", m.end())
            tag = start, stop + 3 if stop >= 0 else n, "", False, ""
        elif m[2]:
            stop = page.find(">", m.end()) if start < last else -1
            tag = start, stop + 1 if stop >= 0 else n, "", False, ""
        elif start > last:
            # no tag can end here: only a comment or declaration is looked for
            rest = re.compile("<[!?]").search(page, start)
            if not rest:
                return
            tag = rest.start(), n, "", False, ""
        else:
            stop = tag_end(m.end())
            tag = start, stop + 1, m[4].lower(), m[3] == "/", page[m.end() : stop]
        on = yield tag
        at = tag[1] if on is None else on
        if on is not None:
            yield tag


def blocks(page: str, known: Collection[str] | None = None) -> list[Block]:
    """Leaf blocks of a page in order, with white space made single blanks.

    ``known``: features of a model; elements and words that it does not know are
    then left out of what describes a block, which bounds it however deep a page
    is nested.
    """
    out: list[Block] = []
    #: open elements: name, words of class, id and role, made-up main text
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    tags: Counter = Counter()
    words: Counter = Counter()
    #: where each element stands on the stack
    places: dict[str, list[int]] = {}
    text: list[str] = []
    linked, in_link, marked = 0, False, 0
    own = ""
    endless: set[str] = set()

    def shown(name: str) -> bool:
        return known is None or f"tag {name}" in known

    def flush():
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, frozenset(tags), frozenset(words), own, min(1.0, linked / max(1, len(whole))), marked > 0))
            text.clear()
        linked = 0

    def pop():
        nonlocal marked, own
        name, named, mark = stack.pop()
        places[name].pop()
        for box, keys in ((tags, (name,) if shown(name) else ()), (words, named)):
            for k in keys:
                box[k] -= 1
                if not box[k]:
                    del box[k]
        marked -= mark
        own = stack[-1][0] if stack else ""

    def close(names: str, barrier: tuple[str, ...]):
        near = lambda some: max((places[w][-1] for w in some if places.get(w)), default=-1)
        at = near(names.split())
        if at > near(barrier):
            while len(stack) > at:
                pop()

    def find(pattern: str, at: int) -> re.Match | None:
        """The first match, unless there was none before."""
        if pattern not in endless:
            if m := re.compile(pattern, re.I).search(page, at):
                return m
            endless.add(pattern)
        return None

    def after(name: str, at: int) -> int:
        """Where the content of an element that is no text ends."""
        end = find(rf"</{re.escape(name)}\b", at)
        stop = page.find(">", end.end()) + 1 if end and "end" not in endless else 0
        if end and not stop:
            endless.add("end")
        if name == "head" and (body := find(r"<body\b", at)) and (not stop or body.start() < stop):
            return body.start()
        # without its end, a script or style takes the rest, as in browsers
        return stop or (len(page) if name in ("script", "style") else at)

    at, scan = 0, tags_of(page)
    for start, stop, name, ends, attributes in scan:
        if piece := page[at:start]:
            text.append(piece)
            if in_link:
                linked += len(piece)
        at = stop
        if not name:
            continue
        if name in RAW:
            if not ends and not attributes.rstrip().endswith("/") and (to := after(name, at)) > at:
                scan.send(at := to)
            text.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                in_link = not ends
            elif name in ("br", "img"):
                text.append(" ")
            continue
        flush()
        in_link = False
        if name in VOID:
            continue
        if ends:
            if places.get(name):
                while len(stack) > places[name][-1] + 1:
                    pop()
                pop()
            continue
        if places.get("p"):
            close("p", ())
        if name in CLOSES:
            close(*CLOSES[name])
        named = tuple(dict.fromkeys(w for g in _named.findall(attributes) for w in _word.findall(" ".join(g).lower()) if known is None or f"word {w}" in known)) if "=" in attributes else ()
        stack.append((name, named, mark := "data-main" in attributes))
        places.setdefault(name, []).append(len(stack) - 1)
        if shown(name):
            tags[name] += 1
        words.update(named)
        marked += mark
        own = name
    text.append(page[at:])
    flush()
    return out


def describe(page: list[Block], hide: frozenset = frozenset()) -> list[list[str]]:
    """Features of each block; ``hide`` leaves some ancestor tags out."""
    out = []
    for i, b in enumerate(page):
        n, t = len(b.text), b.text
        out.append(
            [f"tag {x}" for x in b.tags if x not in hide]
            + [f"word {x}" for x in b.words]
            + [
                "always",
                f"in {b.own}",
                f"size {min(9, n.bit_length())}",
                f"words {min(7, t.count(' ').bit_length())}",
                f"links {round(4 * b.linked)}",
                "stop" if t[-1] in ".!?:;\"'”»" else "no stop",
                "sentence" if ". " in t or ", " in t else "no sentence",
                f"from start {min(i, 3)}",
                f"to end {min(len(page) - 1 - i, 2)}",
                "rights" if "©" in t or "copyright" in t[:80].lower() else "no rights",
            ]
        )
    return out


def add_log(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -1e300 else a


class Chain:
    """A two-state chain: 0 boilerplate, 1 main text."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.turn = [[0.0, 0.0], [0.0, 0.0]]
        self.first = [0.0, 0.0]

    def gains(self, rows: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum(get(f, 0.0) for f in row) for row in rows]

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The best sequence of states (ties: boilerplate)."""
        if not rows:
            return []
        gain, t = self.gains(rows), self.turn
        best, back = [self.first[0], self.first[1] + gain[0]], []
        for g in gain[1:]:
            zero = 0 if best[0] + t[0][0] >= best[1] + t[1][0] else 1
            one = 0 if best[0] + t[0][1] >= best[1] + t[1][1] else 1
            back.append((zero, one))
            best = [best[zero] + t[zero][0], best[one] + t[one][1] + g]
        state = 0 if best[0] >= best[1] else 1
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]

    def learn(self, pages: list[tuple[list[list[str]], list[int]]]) -> None:
        """Stochastic gradient steps on the likelihood, each weight with its own rate."""
        seen: dict[object, float] = {}
        rng = random.Random(SEED)

        def move(box, key, g, name):
            seen[name] = seen.get(name, 1e-3) + g * g
            box[key] += RATE * (g - DECAY * box[key]) / math.sqrt(seen[name])

        order = list(pages)
        for _ in range(EPOCHS):
            rng.shuffle(order)
            for rows, gold in order:
                if not rows:
                    continue
                gain, t, n = self.gains(rows), self.turn, len(rows)
                ahead = [[self.first[0], self.first[1] + gain[0]]]
                for g in gain[1:]:
                    a, b = ahead[-1]
                    ahead.append([add_log(a + t[0][0], b + t[1][0]), add_log(a + t[0][1], b + t[1][1]) + g])
                behind = [[0.0, 0.0]]
                for g in reversed(gain[1:]):
                    a, b = behind[-1]
                    behind.append([add_log(t[0][0] + a, t[0][1] + g + b), add_log(t[1][0] + a, t[1][1] + g + b)])
                behind.reverse()
                z = add_log(*ahead[-1])
                turns = [[0.0, 0.0], [0.0, 0.0]]
                for i in range(n):
                    miss = gold[i] - math.exp(min(0.0, ahead[i][1] + behind[i][1] - z))
                    if abs(miss) > 1e-4:
                        for f in rows[i]:
                            self.weight.setdefault(f, 0.0)
                            move(self.weight, f, miss, f)
                    if i:
                        turns[gold[i - 1]][gold[i]] += 1
                        for x in (0, 1):
                            for y in (0, 1):
                                turns[x][y] -= math.exp(min(0.0, ahead[i - 1][x] + t[x][y] + y * gain[i] + behind[i][y] - z))
                for x in (0, 1):
                    for y in (0, 1):
                        move(self.turn[x], y, turns[x][y], (x, y))
                    move(self.first, x, (gold[0] == x) - math.exp(min(0.0, ahead[0][x] + behind[0][x] - z)), x)


def landmark_labels(page: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article with a landmark element."""
    if not any(b.tags & LANDMARKS for b in page):
        return None
    return [int(bool(b.tags & LANDMARKS) and not b.tags & ASIDE_TAGS and not b.words & ASIDE_WORDS) for b in page]


def made_pages(n: int, seed: int = SEED) -> list[str]:
    """Layouts with made-up words; main text stands under ``data-main``."""
    rng = random.Random(seed)
    syllables = "ka lo mi ter ann ol sen dra bu pel vor ist que".split()

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(low, high):
        w = [word() for _ in range(rng.randint(low, high))]
        return w[0].capitalize() + " " + ", ".join(" ".join(w[1:]).split("  ")) + "."

    def prose():
        return " ".join(sentence(4, 18) for _ in range(rng.randint(1, 6)))

    def link(k=1):
        return f'<a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 3 * k)))}</a>'

    def menu(tag):
        return f"<{tag}><ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9))) + f"</ul></{tag.split()[0]}>"

    def boxed(names, body):
        tag = rng.choice(("div", "section", "div"))
        return f'<{tag} {rng.choice(("class", "id"))}="{rng.choice(names)}">{body}</{tag}>'

    def aside():
        kind = rng.randrange(9)
        if kind == 0:
            return boxed(("sidebar", "side-bar widget", "aside"), f"<h3>{word()}</h3>" + menu("div"))
        if kind == 1:
            return boxed(("ad", "advert", "ads banner", "sponsored", "promo"), sentence(4, 14))
        if kind == 2:
            return boxed(("cookie-notice", "consent", "notice"), f"<p>{sentence(8, 20)}</p><button>{word()}</button>")
        if kind == 3:
            return boxed(("comments", "comment-list", "reader-comments", "responses"), "".join(f'<div class="comment"><p>{prose()}</p></div>' for _ in range(rng.randint(1, 4))))
        if kind == 4:
            return f"<form><label>{word()}</label><input><p>{sentence(4, 10)}</p><button>{word()}</button></form>"
        if kind == 5:
            return f"<aside><h3>{word()}</h3><p>{sentence(5, 16)}</p></aside>"
        if kind == 6:
            return boxed(("related", "share social", "newsletter subscribe", "breadcrumb"), "".join(f"<p>{link(2)}</p>" for _ in range(rng.randint(2, 4))))
        if kind == 7:
            return menu("nav")
        return boxed(("menu", "navbar", "nav"), "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 6))) + "</ul>")

    out = []
    for _ in range(n):
        body = [f"<h1 data-main>{sentence(3, 9)}</h1>"]
        for _ in range(rng.randint(1, 10)):
            body.append(rng.choice((f"<p data-main>{prose()}</p>", f"<p data-main>{prose()}<br>{sentence(3, 8)}", f"<p data-main>{sentence(1, 4)}</p>", f"<h2 data-main>{sentence(2, 5)}</h2><p data-main>{prose()}</p>", f"<ul data-main><li>{sentence(3, 9)}</li><li>{sentence(3, 9)}</li></ul>", f"<blockquote data-main><p>{prose()}</p></blockquote>")))
        while rng.random() < 0.5:
            body.insert(rng.randint(1, len(body)), aside())
        kind = rng.randrange(5)
        inner = "".join(body)
        inner = [f"<article>{inner}</article>", f"<main>{inner}</main>", f'<div class="{rng.choice(("content", "post-body", "entry", "article-text", "story"))}">{inner}</div>', inner, f'<div id="content"><article>{inner}</article></div>'][kind]
        head = rng.choice((f"<header><p>{word()}</p></header>", boxed(("header", "masthead", "top"), f"<p>{link()}</p>"), ""))
        foot = rng.choice((f"<footer>&copy; {word()} {sentence(3, 10)}</footer>", boxed(("footer", "bottom", "copyright"), f"<p>&copy; {sentence(3, 9)}</p>"), f"<footer><p>{sentence(4, 9)}</p></footer>"))
        before, after = [aside() for _ in range(rng.randint(0, 3))], [aside() for _ in range(rng.randint(0, 3))]
        out.append(f"<html><body>{head}{menu('nav') if rng.random() < 0.7 else ''}{''.join(before)}{inner}{''.join(after)}{foot}</body></html>")
    return out


def learn_pages(pages: DataFrame, html_col: str = "html", limit: int = FIT_PAGES) -> Chain:
    """Train on distinct landmark pages (at most ``limit``, by lowest hash) and
    made-up ones.

    Half of the pages hide their landmark elements from the model, so that
    other signs carry weight too.
    """
    col = F.col(quoted(html_col)).cast("string")
    marked = pages.where(col.rlike("(?i)<(article|main)[ >]")).select(col.alias("html"))
    # copies of a page count once; the total is that of the rows offered
    total = marked.agg(F.approx_count_distinct(F.xxhash64("html"))).first()[0]
    chosen = lowest(marked.distinct(), "html", limit=limit, total=total).collect()
    rng, train = random.Random(SEED), []
    for r in chosen:
        page = blocks(r.html)
        if (gold := landmark_labels(page)) is not None:
            train.append((describe(page, LANDMARKS if rng.random() < 0.5 else frozenset()), gold))
    for text in made_pages(MADE_PAGES):
        page = blocks(text)
        train.append((describe(page, LANDMARKS if rng.random() < 0.5 else frozenset()), [int(b.marked) for b in page]))
    chain = Chain()
    chain.learn(train)
    return chain


def extract(page: str, chain: Chain) -> str:
    """Main text: the chosen blocks, two line ends between them."""
    found = blocks(page, chain.weight.keys())
    return "\n\n".join(b.text for b, s in zip(found, chain.decode(describe(found))) if s)


def extract_text(pages: DataFrame, chain: Chain, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points).

    Null or empty html and pages without main text give ''.  Each page stands
    alone, so repeated rows and ties give repeated results, and an empty table
    an empty one.  A page of any length is read whole, in time that grows with
    its length, also where it is malformed.  A ``keep`` column named like an
    added one is replaced by it.
    """

    def make():
        def work(rows):
            found = [extract(p, chain) for p in rows]
            return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

        return work

    return map_text(pages, html_col, ["page_id", "url"] if keep is None else keep, [("text", "string"), ("n_chars", "long")], make)
