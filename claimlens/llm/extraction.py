"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is the sequence of its leaf blocks (``dom.blocks``); each is labelled main or other. Features of
a block: the tags and the words of class, id and role of all elements around it, its innermost tags, and of
its text the length, the share of link text, how it begins and ends, digits, and words of stock phrases.
Two transitions' weights and the start's are learned with them by gradient steps on the conditional
likelihood (forward-backward); Viterbi decodes.

Labelled pages: the table has none by hand, so training takes pages that label themselves, by one ``article``
element (``self_labelled``), and pages that are made from their blocks in other dress (``dressed``): containers
of other names or without any, menus, notices, adverts, forms, link lists and comments around and inside the
article, with stock phrases and with prose of other pages. At most ``SAMPLE`` distinct pages of up to ``SAMPLE_CHARS``
characters are taken (smallest hash of the html). The dressed pages keep the field from relying on the ``article`` tag.

Tasks get the weights (``FEATURES`` numbers), read each page once, whole, and return its text: no shuffle.

Defined results: null and empty html give an empty text; a page without tags is one block of text;
white space is what ``str.split`` splits at; a reference to no character stays as
it is; repeated pages each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import arrow_map
from claimlens.llm.dom import LABEL, Paths, blocks

FEATURES = 1 << 14
SAMPLE, SAMPLE_CHARS = 160, 40_000
#: Dressed versions of a sampled page; blocks of a training sequence; gradient steps, their length, weight decay.
DRESSES, SEQUENCE, STEPS, RATE, DECAY = 8, 32, 200, 0.1, 1e-6
#: Chains of elements a task remembers.
HELD_PATHS = 50_000

# --- what training pages are dressed in (fixed values) ------------------------------

CONTAINERS = [
    "article", "main", "div class=content", "div id=content", "div class=article-body", "div class='post-content entry'", "section class=story",
    "div id=main-text", "div class=page", "div", "section", "", "table><tr><td class=text", "div role=main", "div class='body wide'",
]
#: (element, what it holds): link lists, prose, or a set of phrases.
OTHERS = [
    ("nav", "links"), ("div class=menu", "links"), ("ul class=navbar", "links"), ("div id=navigation", "links"), ("header", "links"),
    ("header class=site-header", "short"), ("div class=header", "short"), ("div id=masthead", "short"), ("div role=banner", "short"),
    ("footer", "short"), ("div class=footer", "short"), ("div id=site-footer", "links"), ("div class=copyright", "legal"), ("div role=contentinfo", "legal"),
    ("aside", "prose"), ("aside", "links"), ("div class=sidebar", "links"), ("div id=sidebar-right", "prose"),
    ("div class='left sidebar'", "prose"), ("div class='right sidebar'", "short"), ("div class=widget", "short"),
    ("div class=ad", "prose"), ("div class='ads box'", "short"), ("div class=advert", "prose"), ("div class=advertisement", "short"),
    ("div class=sponsored", "prose"), ("div class=promo", "short"), ("section class=banner", "short"), ("div class='cookie-notice'", "notice"),
    ("div class=consent", "notice"), ("div id=cookies", "notice"), ("div class=notice", "notice"), ("div class=alert", "notice"),
    ("div class=popup", "form"), ("div class=modal", "form"), ("div role=dialog", "notice"), ("form", "form"), ("form class=search", "form"),
    ("form id=login", "form"), ("div class=newsletter", "form"), ("div class=subscribe", "form"), ("div class=signup", "form"),
    ("section class=comments", "talk"), ("div id=comments", "talk"), ("div class=comment", "prose"), ("ol class=comment-list", "talk"),
    ("div class=discussion", "talk"), ("div class=replies", "talk"), ("section id=responses", "talk"), ("div class=reader-comments", "talk"),
    ("div class=related", "links"), ("div class=recommended", "links"), ("div class=share", "share"), ("div class=social", "share"),
    ("div class=breadcrumbs", "links"), ("div class=pagination", "links"), ("div class=tags", "links"), ("div class=toolbar", "links"), ("div", "links"),
    ("div", "legal"), ("div", "notice"), ("ul", "links"),
]
PHRASES = {
    "notice": ["We use cookies to improve this site.", "Accept all cookies", "Read our privacy policy", "Wir verwenden Cookies auf dieser Seite.",
               "Cookies akzeptieren", "Nous utilisons des cookies.", "Accepter les cookies", "Usamos cookies en este sitio.", "Aceptar cookies",
               "Please enable JavaScript", "Your browser is out of date."],
    "form": ["Subscribe to our newsletter", "Enter your email address", "Sign in", "Log in or register", "Search this site", "Password",
             "Newsletter abonnieren", "Anmelden", "Suche", "Abonnez-vous", "Connexion", "Rechercher", "Suscribirse", "Iniciar sesión", "Buscar"],
    "legal": ["© 2024 All rights reserved", "Copyright 2023", "Terms of use | Privacy", "Alle Rechte vorbehalten", "Impressum · Datenschutz",
              "Tous droits réservés", "Mentions légales", "Todos los derechos reservados", "Aviso legal", "Contact us · About"],
    "share": ["Share this", "Tweet", "Share on Facebook", "Email", "Print", "Teilen", "Partager", "Compartir", "Follow us"],
    "talk": ["3 comments", "Leave a comment", "Reply", "Kommentare", "Antworten", "Commentaires", "Répondre", "Comentarios", "Responder"],
    "links": ["Home", "News", "About", "Contact", "Read more", "Next", "Previous", "Startseite", "Accueil", "Inicio", "Related articles"],
}
_STOCK = {w for texts in PHRASES.values() for t in texts for w in t.lower().split() if w.isalpha() and len(w) > 3}

# --- features -----------------------------------------------------------------------


def _text_features(text: str, linked: int) -> tuple[str, ...]:
    words = text.split(" ", 33)
    n = len(words)
    link = 0 if not linked else min(3, 1 + 3 * linked // max(1, len(text)))
    last, head = text[-1], text[0]
    out = [f"words {min(n.bit_length(), 6)}", f"link {link}", "end " + (last if last in ".!?:,…" else "…" if last.isalnum() else "other"),
           "head " + ("upper" if head.isupper() else "digit" if head.isdigit() else "lower" if head.isalpha() else "other")]
    if n <= 12:
        out += sorted({f"stock {w}" for w in (x.strip(".,:;!?|·").lower() for x in words) if w in _STOCK})
        if "©" in text or "|" in text or "·" in text or "»" in text:
            out.append("mark")
        if any(c.isdigit() for c in text):
            out.append("digits")
    return tuple(out)


def _path_features(paths: Paths, at: int) -> list[str]:
    """All features of a chain of elements."""
    got, tags, step = [], [], at
    while step:
        got += paths.own[step]
        tags.append(paths.tag[step])
        step = paths.parent[step]
    return [*got, *_inner(tags[:2])]


def _inner(tags: list[str]) -> list[str]:
    return [f"tag {tags[0]}", "tags " + " ".join(tags)] if tags else ["tag none"]


def _number(feature: str) -> int:
    return crc32(feature.encode()) % FEATURES


# --- the field ----------------------------------------------------------------------


@dataclass
class Field:
    """Log potentials: of ``main`` against ``other`` by feature, and of label pairs and the first label."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def viterbi(self, scores: list[float]) -> list[bool]:
        """The likeliest labels of a sequence with these scores of ``main``; ties are main."""
        (oo, om), (mo, mm) = self.trans.tolist()
        other, main = self.start.tolist()
        back: list[tuple[bool, bool]] = []
        for i, s in enumerate(scores):
            if i:
                to_other, to_main = (main + mo >= other + oo), (main + mm >= other + om)
                back.append((to_other, to_main))
                other, main = (main + mo if to_other else other + oo), (main + mm if to_main else other + om)
            main += s
        label = main >= other
        labels = [label]
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1] if scores else []


class Reader:
    """Applies a field to pages; remembers the scores of chains and of text kinds."""

    def __init__(self, model: Field):
        self.model, self.weights = model, model.weights.tolist()
        self._forget()

    def _forget(self) -> None:
        self.paths, self.around, self.whole, self.kinds = Paths(), {0: 0.0}, {}, {}

    def _around(self, at: int) -> float:
        chain = []
        while at not in self.around:
            chain.append(at)
            at = self.paths.parent[at]
        total = self.around[at]
        for step in reversed(chain):
            total += sum(self.weights[_number(f)] for f in self.paths.own[step])
            self.around[step] = total
        return total

    def _path_score(self, at: int) -> float:
        got = self.whole.get(at)
        if got is None:
            tags = [self.paths.tag[p] for p in (at, self.paths.parent[at]) if p]
            got = self.whole[at] = self._around(at) + sum(self.weights[_number(f)] for f in _inner(tags))
        return got

    def _text_score(self, text: str, linked: int) -> float:
        kind = _text_features(text, linked)
        got = self.kinds.get(kind)
        if got is None:
            got = self.kinds[kind] = sum(self.weights[_number(f)] for f in kind)
        return got

    def main_blocks(self, html: str) -> list[str]:
        if len(self.paths.tag) > HELD_PATHS:
            self._forget()
        found = blocks(html, self.paths)
        labels = self.model.viterbi([self._path_score(p) + self._text_score(t, n) for p, t, n in found])
        return [t for (_, t, _), main in zip(found, labels) if main]


def forward_backward(scores: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of ``main`` at every position of sequences laid end to end (at most ``SEQUENCE`` each),
    summed pair marginals, and the log normaliser of each sequence."""
    begin, longest = np.cumsum(sizes) - sizes, int(sizes.max(initial=0))
    n = len(scores)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    norm = np.zeros(len(sizes))
    own = np.stack([np.zeros(n), scores], 1)
    for s in range(longest):
        at = begin[sizes > s] + s
        into = start if s == 0 else np.logaddexp(alpha[at - 1, :1] + trans[0], alpha[at - 1, 1:] + trans[1])
        alpha[at] = into + own[at]
    for s in range(longest - 1, -1, -1):
        live = sizes > s
        at = begin[live] + s
        more = sizes[live] > s + 1
        ahead = own[at[more] + 1] + beta[at[more] + 1]
        beta[at[more]] = np.logaddexp(ahead[:, :1] + trans[:, 0], ahead[:, 1:] + trans[:, 1])
    some = sizes > 0
    ends = begin[some] + sizes[some] - 1
    norm[some] = np.logaddexp.reduce(alpha[ends], axis=1)
    of = np.repeat(norm, sizes)
    gamma = np.exp(alpha + beta - of[:, None])
    later = np.ones(n, bool)
    later[begin[some]] = False
    at = np.flatnonzero(later)
    pairs = np.exp(alpha[at - 1][:, :, None] + trans[None] + (own[at] + beta[at])[:, None, :] - of[at][:, None, None]).sum(axis=0)
    return gamma[:, 1], pairs, norm


def fit(pages: list[tuple[str, list[bool] | None]]) -> Field:
    """Learns from pages with the labels of their blocks, or (None) with blocks in elements that carry
    ``data-main`` (1 or 0)."""
    model, paths = Field(), Paths()
    numbers, counts, truth, sizes = [], [], [], []
    known: dict[int, list[int]] = {}
    for page, labels in pages:
        found = blocks(page, paths)
        truth += labels if labels is not None else [bool(paths.main[p]) for p, *_ in found]
        for k, (p, text, linked) in enumerate(found):
            if p not in known:
                known[p] = [_number(f) for f in _path_features(paths, p)]
            own = known[p] + [_number(f) for f in _text_features(text, linked)]
            numbers += own
            counts.append(len(own))
            if k % SEQUENCE == 0:
                sizes.append(0)
            sizes[-1] += 1
    if not truth:
        return model
    numbers, y, sizes = np.array(numbers), np.array(truth, np.int64), np.array(sizes)
    owner = np.repeat(np.arange(len(y)), counts)
    head = np.cumsum(sizes) - sizes
    later = np.ones(len(y), bool)
    later[head] = False
    at = np.flatnonzero(later)
    observed = np.bincount(2 * y[at - 1] + y[at], minlength=4).reshape(2, 2)
    params = [model.weights, model.trans, model.start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        scores = np.bincount(owner, model.weights[numbers], len(y))
        main, pairs, _ = forward_backward(scores, sizes, model.trans, model.start)
        over = y - main
        opening = over[head].sum()
        slopes = [np.bincount(numbers, over[owner], FEATURES), observed - pairs, np.array([-opening, opening])]
        for p, g, u, v in zip(params, slopes, first, second):  # Adam
            g = g / len(y) - DECAY * p
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            p += RATE * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


# --- labelled pages -----------------------------------------------------------------

#: Words of elements that are no part of an article that holds them.
_APART = {"in nav", "in aside", "in footer", "in form", "name ad", "name comment", "name comments", "name share", "name related", "name newsletter"}


def self_labelled(html: str) -> list[tuple[str, str, bool]] | None:
    """(tag, text, main) of the blocks of a page with exactly one ``article`` element; None for others."""
    paths = Paths()
    found = blocks(html, paths)
    if sum(t == "article" for t in paths.tag) != 1:
        return None
    out = []
    for p, text, _ in found:
        seen = paths.seen[p]
        out.append((paths.tag[p], text, "in article" in seen and not seen & _APART))
    return out


def _element(what: str, inside: str, main: bool | None = None) -> str:
    label = "" if main is None else f" data-main={int(main)}"
    tag = what.split(">")[0].split(" ")[0] if what else ""
    return f"<{what}{label}>{inside}</{tag}>" if what else f"<{LABEL}{label}>{inside}</{LABEL}>"


def dressed(page: list[tuple[str, str, bool]], prose: list[str], rng: random.Random) -> str:
    """A labelled page: the main blocks of ``page`` in some container, with other parts before, inside and behind.
    ``prose`` is what its adverts and comments say."""
    main, aside = [t for _, t, m in page if m], [t for _, t, m in page if not m]

    def links(n: int) -> str:
        names = [rng.choice(PHRASES["links"]) if rng.random() < 0.3 else " ".join(rng.choice(prose).split()[:rng.randint(1, 4)]) for _ in range(n)]
        return "".join(f"<li><a href=/{k}>{escape(t)}</a></li>" for k, t in enumerate(names))

    def other() -> str:
        what, kind = rng.choice(OTHERS)
        if " " in what and rng.random() < 0.35:  # a name tells more than what the element holds
            kind = rng.choice(["links", "prose", "short"])
        if kind == "links":
            inside = links(rng.randint(1, 7))
        elif kind in ("prose", "talk"):
            texts = [" ".join(rng.choice(prose).split()[:rng.randint(1, 60)]) for _ in range(rng.randint(1, 4))]
            texts = [rng.choice(PHRASES["talk"])] * (kind == "talk") + texts
            inside = "".join(f"<p>{escape(t)}</p>" if rng.random() < 0.7 else f"<div>{escape(t)}</div>" for t in texts)
        elif kind == "short":
            inside = escape(rng.choice(aside or prose)) if rng.random() < 0.5 else f"<p>{escape(rng.choice(PHRASES['legal']))}</p>"
        else:
            inside = "".join(f"<p>{escape(t)}</p>" if rng.random() < 0.6 else f"<div><a href=#>{escape(t)}</a></div>"
                             for t in rng.sample(PHRASES[kind], rng.randint(1, 3)))
        return _element(what, inside, False)

    body = []
    for k, t in enumerate(main):
        tag = rng.choice(["h1", "h2", "p"]) if k == 0 else rng.choice(["p"] * 8 + ["div", "li", "blockquote", "h2", "h3", "pre", "td", "td"])
        if rng.random() < (0.5 if tag in ("td", "li") else 0.1):
            t = " ".join(t.split()[:rng.randint(1, 6)])
        around = {"td": ("<table><tr>", "</table>"), "li": ("<ul>", "</ul>")}.get(tag, ("", ""))
        body.append(f"{around[0]}<{tag}>{escape(t)}" + ("" if tag == "p" and rng.random() < 0.3 else f"</{tag}>{around[1]}"))
        if rng.random() < 0.2:
            body.append(other())
    container = _element(rng.choice(CONTAINERS), "".join(body), True)
    if rng.random() < 0.4:
        container = _element(rng.choice(["div class=wrapper", "div id=page", "div", "main"]), container, None)
    before, behind = ([other() for _ in range(rng.randint(0, 4))] for _ in range(2))
    return f"<html><head><title>x</title></head><body>{''.join(before)}{container}{''.join(behind)}</body></html>"


def labelled_pages(pages: list[str], seed: int = 5) -> list[tuple[str, list[bool] | None]]:
    """Training pages from pages that label themselves; without any, from stock phrases alone."""
    rng = random.Random(seed)
    held = [(h, p) for h in pages if (p := self_labelled(h)) and any(m for *_, m in p)]
    if not held:
        held = [("", [("p", " ".join(rng.choices(sorted(_STOCK), k=rng.randint(3, 60))).capitalize() + ".", True) for _ in range(8)]) for _ in range(40)]
    prose = [t for _, p in held for _, t, m in p if m]
    bare = [(escape(" ".join(t for _, t, m in p if m)), [True]) for _, p in held[:40]]
    return bare + [(h, [m for *_, m in p]) for h, p in held if h] + [(dressed(p, prose, rng), None) for _ in range(DRESSES) for _, p in held]


# --- jobs ---------------------------------------------------------------------------


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Field:
    """Learns from at most ``sample`` distinct pages of up to ``sample_chars`` characters (smallest hash)."""
    text = F.col(html_col).cast("string")
    rows = pages.select(text.alias("html"), F.xxhash64(text).alias("h")).filter((F.length("html") > 0) & (F.length("html") <= sample_chars))
    chosen = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(sample).collect()]
    got = rows.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect() if chosen else []
    return fit(labelled_pages([r["html"] for r in got]))


def extract(pages: DataFrame, model: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_blocks) of each page: its main blocks, joined by two line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            parts = [reader.main_blocks(h.as_py() or "") for h in batch.column(2)]
            texts = ["\n\n".join(p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([len(p) for p in parts], pa.int64())], [id_col, url_col, "text", "n_chars", "n_blocks"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return arrow_map(pages.select(id_col, url_col, F.col(html_col).cast("string")), run,
                     f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long, n_blocks long")
