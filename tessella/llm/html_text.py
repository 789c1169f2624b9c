"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text without the border of a block element in them. Each has a vector of
its hashed tag path (names, and words of class, id and role), of its hashed words, and of a few figures.
A bidirectional LSTM reads the blocks of a page in order and labels each as main text or not. It is trained here,
on pages made up from templates with known labels (``TRAINING_PAGES`` of them, fixed seed): no page of the input is
needed for that.

Elements that are never shown as text (head, scripts, styles, templates and the like) and comments of the mark-up
are no blocks. Line breaks are white space within a block. A page is read once from its beginning to its end, whatever
its mark-up is; pages are labelled in groups of at most ``STEPS_AT_ONCE`` blocks with their padding, a longer one by itself.

Defined cases: null and empty pages have the empty text; text outside of any element is a block; a tag that the page
ends in is dropped, as is the rest after a comment, script or style that is never closed; other elements that are not shown hide
nothing if they are never closed or close themselves (``<svg/>``); the head ends at the first element or text that cannot
stand in it, with or without ``</head>`` and ``<body>``; a quote opens a value only after "=", and only if it is closed; open
elements end where their parents do; repeated rows are extracted each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import table, texts_of, to_batch
from tessella.llm.lstm import Tagger, padded, train
from tessella.llm.words import HASHES

#: Element names by what they do to text.
RAW = frozenset("script style".split())
UNSHOWN = RAW | frozenset("template noscript iframe svg object math title audio video canvas".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEEP_IN = ("table", "ul", "ol", "dl", "div", "section", "article", "body")

#: A tag; an attribute's value is quoted only after "=", and only if the quote is closed.
TAG = re.compile(r"""<(/?)([a-z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""", re.I)
CLOSED = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in sorted(UNSHOWN)}
NAMED = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
NAME_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

PATH_BINS, WORD_BINS, FIGURES = 192, 24, 8
N_IN = PATH_BINS + WORD_BINS + FIGURES
HIDDEN, EPOCHS, RATE, SEED, TRAINING_PAGES, STEPS_AT_ONCE, THRESHOLD = 12, 16, 0.02, 7, 1200, 1 << 15, 0.0


def _bin(token: str, bins: int) -> int:
    return (HASHES[token] >> 20) % bins


@lru_cache(maxsize=20_000)
def _marks(name: str, attributes: str) -> tuple[int, int]:
    """Bits of the path vector that an element sets, for all that is in it and for its own text."""
    words = {w.lower() for m in NAMED.finditer(attributes) for w in NAME_WORDS.findall(m[1] or m[2] or m[3] or "")}
    bits = [0, 0]
    for token in (f"<{name}", *(f".{w}" for w in words)):
        bits[0] |= 1 << _bin(token, PATH_BINS)
        bits[1] |= 1 << _bin(f"last {token}", PATH_BINS)
    return bits[0], bits[1]


class _Open:
    """The open elements of a page, with the places of each name and the bits of the path to each."""

    def __init__(self):
        self.names, self.places, self.paths, self.own = [], {}, [0], [0]

    def push(self, name: str, attributes: str) -> None:
        path, own = _marks(name, attributes if len(attributes) < 4096 else "")
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.paths.append(self.paths[-1] | path)
        self.own.append(own)

    def last(self, names) -> int:
        """The innermost place of any of the names, -1 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def cut(self, place: int) -> None:
        """Closes the element at a place and all within it."""
        while len(self.names) > place:
            self.places[self.names.pop()].pop()
            self.paths.pop()
            self.own.pop()


def blocks(page: str) -> list[tuple[str, int, int, float]]:
    """(text, bits of the tag path, its depth, share of the text in links) of the leaf blocks of a page, in order."""
    found: list[tuple[str, int, int, float]] = []
    open_ = _Open()
    parts: list[str] = []
    linked, in_link, in_head, at, end = 0, False, False, 0, len(page)
    never_closed: set[str] = set()

    def leave() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append((text, open_.paths[-1] | open_.own[-1], len(open_.names), min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    while at < end:
        mark = page.find("<", at)
        while 0 <= mark < end - 1 and not (page[mark + 1].isalpha() and page[mark + 1].isascii()) and page[mark + 1] not in "/!?":
            mark = page.find("<", mark + 1)  # a sign of its own
        text = page[at : mark if mark >= 0 else end]
        if text and (not in_head or not text.isspace()):
            in_head = False
            parts.append(text)
            linked += len(text) if in_link else 0
        if mark < 0 or mark == end - 1:
            if mark == end - 1 and parts and parts[-1].endswith("<"):
                parts[-1] = parts[-1][:-1]
            break
        if page.startswith("<!--", mark):
            close = page.find("-->", mark + 4)
            at = close + 3 if close >= 0 else end
            continue
        m = TAG.match(page, mark)
        if m is None:
            if page[mark + 1].isalpha() or page.startswith("</", mark) and page[mark + 2 : mark + 3].isalpha():
                break  # the page ends in a tag
            close = page.find(">", mark)
            at = close + 1 if close >= 0 else end
            continue
        at, name, closing, attributes = m.end(), m[2].lower(), bool(m[1]), m[3]
        if name in UNSHOWN and not closing:
            if name not in RAW and (attributes.endswith("/") or name in never_closed):
                continue
            over = CLOSED[name].search(page, at)
            if over:
                at = over.end()
            elif name in RAW:
                break
            else:
                never_closed.add(name)
            continue
        if name == "head":
            in_head = not closing
            continue
        if in_head:
            if name in IN_HEAD:
                continue
            in_head = False
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                in_link = not closing
            continue
        leave()
        if closing:
            place = open_.last((name,))
            if place >= 0:
                open_.cut(place)
                in_link = False
            continue
        ended = SIBLINGS.get(name, ("p",) if name in ENDS_P else ())
        if ended:
            border, place = open_.last(KEEP_IN), open_.last(ended)
            while place > border:
                open_.cut(place)
                place = open_.last(ended) if name == "tr" else -1
        if name not in VOID:
            open_.push(name, attributes)
    leave()
    return found


def vectors(found: list[tuple[str, int, int, float]], first: int = 0, of: int | None = None) -> np.ndarray:
    """A line for each block; ``first`` and ``of`` tell where in a longer page of so many blocks they are."""
    of = of or len(found)
    out = np.zeros((len(found), N_IN), "f4")
    if found:
        bits = np.frombuffer(b"".join(path.to_bytes(PATH_BINS // 8, "little") for _, path, _, _ in found), "u1")
        out[:, :PATH_BINS] = np.unpackbits(bits.reshape(len(found), -1), axis=1, bitorder="little")
    for i, (text, _, depth, link_share) in enumerate(found):
        words, row = text.split(), out[i]
        bins = np.bincount((np.fromiter(map(HASHES.__getitem__, words), "u8", len(words)) >> np.uint64(20)) % np.uint64(WORD_BINS), minlength=WORD_BINS)
        row[PATH_BINS : PATH_BINS + WORD_BINS] = bins / len(words)
        n = len(text)
        row[PATH_BINS + WORD_BINS :] = (np.log1p(n) / 6, np.log1p(len(words)) / 4, link_share, min(1.0, 10 * (text.count(".") + text.count(",")) / n), text[-1] in ".!?", (first + i) / of, min(depth, 32) / 8, 1.0)
    return out


#: Names that page templates give to their parts.
MAIN_NAMES = ["content", "main content", "post body", "entry-content", "article-body", "story", "text", "post", "hentry", "page-content", "markdown"]
OTHER_NAMES = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "pagination", "main-menu", "toc", "skip-links"],
    "header": ["header", "masthead", "site-header", "banner", "logo", "topbar"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "legal", "colophon"],
    "aside": ["sidebar", "widget", "related", "related-posts", "tags", "popular", "trending", "recommended", "aside", "author-box"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adbox", "sponsor"],
    "notice": ["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "newsletter", "subscribe", "popup", "modal", "paywall", "message", "disclaimer"],
    "form": ["form", "search", "login", "signup", "contact-form", "search-form"],
    "comments": ["comments", "comment", "comment-list", "responses", "disqus", "discussion", "replies", "commentlist"],
    "share": ["share", "social", "share-buttons", "follow", "meta", "byline"],
}
SYLLABLES = "an ba ce do en fi ga he in jo ka le ma no or pe qui re sa ti un ve wi ya zo".split()


def _words(rng: random.Random, least: int, most: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(least, most))]


def _sentences(rng: random.Random, most: int) -> str:
    return " ".join(" ".join(_words(rng, 3, 14)).capitalize() + rng.choice([".", ".", ".", "!", "?", ""]) for _ in range(rng.randint(1, most)))


def made_up_page(rng: random.Random) -> tuple[list[tuple[str, int, int, float]], np.ndarray]:
    """Blocks and labels of a page from a random template. Main text is marked by a character that is taken out."""
    pick = rng.choice
    mark = "\x01"

    def paragraph(main: bool) -> str:
        sign, inner = mark if main else "", _sentences(rng, 6)
        if rng.random() < 0.15:
            inner = f"<b>{inner}</b>"
        if rng.random() < 0.15:
            inner += f' <a href="/x">{pick(_words(rng, 1, 3))}</a>'
        return f"<p>{sign}{inner}" + ("</p>" if rng.random() < 0.9 else "")

    def body_block() -> str:
        kind = rng.random()
        if kind < 0.78:
            return paragraph(True)
        if kind < 0.84:
            return f"<h{rng.randint(2, 4)}>{mark}{' '.join(_words(rng, 2, 8))}</h2>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{mark}{_sentences(rng, 1)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote>{mark}{_sentences(rng, 3)}</blockquote>"
        if kind < 0.96:
            return f"<pre>{mark}{' '.join(_words(rng, 3, 20))}</pre>"
        if kind < 0.98:
            return f"<figure><figcaption>{mark}{_sentences(rng, 1)}</figcaption></figure>"
        return "<table>" + "".join("<tr>" + "".join(f"<td>{mark}{pick(_words(rng, 1, 1))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"

    def other(kind: str) -> str:
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.7 else pick(["div", "section", "ul", "div"])
        name = pick(OTHER_NAMES[kind])
        attribute = "" if tag == kind and rng.random() < 0.5 else f' {pick(["class", "id", "class"])}="{name}"'
        if kind in ("nav", "share") or kind in ("footer", "aside", "header") and rng.random() < 0.4:
            items = [f'<a href="/{i}">{" ".join(_words(rng, 1, 4))}</a>' for i in range(rng.randint(2, 8))]
            inner = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rng.random() < 0.7 else " ".join(items)
        elif kind == "form":
            inner = f"<label>{' '.join(_words(rng, 1, 4))}</label><input><button>{pick(_words(rng, 1, 2))}</button>"
            tag = "form" if tag != "form" and rng.random() < 0.7 else tag
        elif kind == "comments":
            inner = f"<h3>{' '.join(_words(rng, 1, 3))}</h3>" + "".join(f'<{pick(["li", "div", "article", "p"])} class="{pick(["comment", "reply", "comment-body"])}">{paragraph(False)}</div>' for _ in range(rng.randint(1, 6)))
        else:
            inner = "".join(paragraph(False) if rng.random() < 0.5 else _sentences(rng, 2) for _ in range(rng.randint(1, 2)))
            if kind == "aside" and rng.random() < 0.5:
                inner = f"<h4>{' '.join(_words(rng, 1, 3))}</h4>" + inner
        out = f"<{tag}{attribute}>{inner}</{tag}>"
        return f"<div>{out}</div>" if rng.random() < 0.15 else out

    longest = 60 if rng.random() < 0.1 else 14
    main = [f"<h1>{mark}{' '.join(_words(rng, 2, 10))}</h1>"] if rng.random() < 0.7 else []
    for _ in range(rng.randint(1, longest - 1)):
        main.append(body_block())
        if rng.random() < 0.06:
            main.append(other(pick(["ad", "aside", "share", "notice", "form"])))
    if rng.random() < 0.15:
        main.append(other("comments"))
    tag, attribute = (pick(["article", "article", "main"]), "") if rng.random() < 0.5 else (pick(["article", "main", "div", "section", "div"]), f' class="{pick(MAIN_NAMES)}"')
    middle = f"<{tag}{attribute}>{''.join(main)}</{tag}>"
    if rng.random() < 0.3:
        middle = f'<{pick(["main", "div"])} id="{pick(["page", "wrapper", "container", "main", "site"])}">{middle}' + (other("comments") if rng.random() < 0.4 else "") + (other("aside") if rng.random() < 0.4 else "") + "</div></main>"
    before = [other(k) for k in ("nav", "header", "notice", "ad", "form", "aside") if rng.random() < 0.45]
    after = [other(k) for k in ("comments", "aside", "ad", "footer", "share", "notice") if rng.random() < 0.45]
    start = pick(["<body>", "<html><body>", "<html><head><title>x</title></head><body>", f'<body class="{pick(_words(rng, 1, 1))}">', ""])
    found = blocks(start + "".join(before) + middle + "".join(after) + ("</body>" if rng.random() < 0.9 else ""))
    labels = np.array([mark in t for t, *_ in found], "f4")
    return [(t.replace(mark, "").strip() or "x", *rest) for t, *rest in found], labels


@lru_cache(maxsize=1)
def trained() -> Tagger:
    rng = random.Random(SEED)
    pages = [p for p in (made_up_page(rng) for _ in range(TRAINING_PAGES)) if p[0]]
    return train([vectors(b) for b, _ in pages], [y for _, y in pages], hidden=HIDDEN, epochs=EPOCHS, rate=RATE, seed=SEED)


def _groups(lengths: list[int], most: int = STEPS_AT_ONCE):
    """Pages (their numbers) that are labelled together: of like lengths, and as many as fit with their padding, or one."""
    group: list[int] = []
    for i in sorted((i for i, n in enumerate(lengths) if n), key=lengths.__getitem__):
        if group and (len(group) + 1) * lengths[i] > most:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def main_texts(pages: list[str], model: Tagger) -> list[list[str]]:
    """The blocks of main text of each page."""
    cut = [blocks(p) for p in pages]
    out: list[list[str]] = [[] for _ in pages]
    for group in _groups([len(b) for b in cut]):
        if len(cut[group[0]]) > STEPS_AT_ONCE:
            page = cut[group[0]]
            scores = model.scores_in_parts([partial(vectors, page[i : i + STEPS_AT_ONCE], i, len(page)) for i in range(0, len(page), STEPS_AT_ONCE)])[:, None]
        else:
            scores = model.scores(*padded([vectors(cut[i]) for i in group]))
        for j, i in enumerate(group):
            out[i] = [b[0] for b, s in zip(cut[i], scores[: len(cut[i]), j], strict=True) if s > THRESHOLD]
    return out


def extract(pages: DataFrame, model: Tagger | None = None) -> DataFrame:
    """page_id, url, blocks (texts of the main blocks in order)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # a few thousand weights
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("blocks", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            yield to_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "blocks": main_texts(texts_of(batch.column("html")), shared.value)}, schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, blocks array<string>")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages")).select("page_id", "url", F.array_join("blocks", "\n").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
