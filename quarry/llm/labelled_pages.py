"""Labelled pages, made by rule from the parts below: every word of the content carries ``MARK``.

The driver's tables have no labels for pages, so these stand in for a labelled crawl: usual and unusual ways to mark up
an article, what stands around it and what is put into it. Their words are drawn at random, so that nothing can be learned
from them; element names, roles, class names, links and the form of the text are what remains. Names that often mean
other parts of a page are also given to parts of articles here and there, as happens on real pages.
"""

from __future__ import annotations

import random

MARK = ""

NAV = "nav navbar navigation menu main-menu site-nav top-nav submenu breadcrumb breadcrumbs pagination pager skip toolbar topbar tabs toc-nav tags tag-links".split()
HEAD = "header site-header masthead banner branding page-header logo topbar".split()
FOOT = "footer site-footer page-footer foot copyright colophon legal imprint footer-links".split()
SIDE = "sidebar side-bar left-sidebar right-sidebar widget widgets widget-area aside rail secondary trending popular recent-posts".split()
ADS = "ad ads advert advertisement adbox ad-slot ad-banner sponsor sponsored sponsored-content promo promotion outbrain taboola banner-ad commercial google-ad".split()
LINKS = "related related-posts related-articles recommended recommendations read-more more-stories share sharing social social-share share-buttons tags post-tags prev-next".split()
TALK = "comments comment comment-list commentlist comments-area comment-body disqus disqus_thread respond replies reply responses reader-comments discussion user-comments feedback".split()
NOTES = "notice notices cookie cookies cookie-notice cookie-banner consent gdpr alert popup modal overlay newsletter newsletter-signup subscribe subscription signup login paywall disclaimer-bar".split()
CONTENT = "content main main-content article article-body articlebody post post-content post-body entry entry-content story story-body body-text text page-content article-text".split()
NEUTRAL = "wrapper container row col col-8 inner page site outer has-sidebar with-sidebar layout grid clearfix section block box group left right center".split()
#: Parts of articles, some with names that elsewhere mean something else.
PARTS = (
    "intro lead summary results method methods background chapter part related-work related-research hidden-gems footer-note "
    "menu-of-the-day comment-on-results popular-science share-prices ad-hoc-methods banner-years login-study subscribe-rates "
    "cookie-recipe side-effects notice-period recommended-dose social-history tag-theory header-files widget-design"
).split()
ROLES = {
    "nav": "navigation", "head": "banner", "foot": "contentinfo", "side": "complementary", "note": "alert", "dialog": "dialog", "menu": "menu", "search": "search"
}


class Maker:
    """One page after another from a seed."""

    def __init__(self, seed: int):
        self.rng = r = random.Random(seed)
        parts = ["ka", "lo", "mi", "ter", "san", "ou", "re", "ing", "e", "un", "da"]
        self.vocabulary = ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(2000)]

    def word(self) -> str:
        return self.rng.choice(self.vocabulary)

    def words(self, n: int, mark: str) -> list[str]:
        return [mark + w for w in self.rng.choices(self.vocabulary, k=n)]

    def sentence(self, mark: str) -> str:
        w = self.words(self.rng.randint(5, 18), mark)
        w[0] = mark + w[0][len(mark) :].capitalize()
        if self.rng.random() < 0.3:
            i = self.rng.randrange(len(w))
            tag = self.rng.choice(["b", "i", "em", "strong", "code", "span"])
            name = self.name(PARTS) if mark and tag == "span" else ""
            w[i] = f"<{tag}{name}>{w[i]}</{tag}>"
        if mark and self.rng.random() < 0.15:
            i = self.rng.randrange(len(w) - 2)
            w[i] = f'<a href="/{self.word()}">{w[i]}'
            w[i + 2] += "</a>"
        return " ".join(w) + self.rng.choice("....?!")

    def prose(self, mark: str, most: int = 5) -> str:
        return " ".join(self.sentence(mark) for _ in range(self.rng.randint(1, most)))

    def heading(self, mark: str) -> str:
        return " ".join(self.words(self.rng.randint(1, 8), mark))

    def name(self, names: list[str]) -> str:
        """An attribute with one of the names, at times with a neutral one or a number beside it."""
        r, n = self.rng, self.rng.choice(names)
        if r.random() < 0.2:
            n += f" {r.choice(NEUTRAL)}"
        if r.random() < 0.1:
            n += f"-{r.randint(1, 9)}"
        return f' {r.choice(["class", "class", "id"])}="{n}"'

    def link(self) -> str:
        return f'<a href="/{self.word()}">{" ".join(self.words(self.rng.randint(1, 6), ""))}</a>'

    def links(self, least: int = 2) -> str:
        r = self.rng
        items = [self.link() for _ in range(r.randint(least, 8))]
        form = r.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{x}{r.choice(['', '</li>'])}" for x in items) + "</ul>"
        if form < 0.75:
            return "<p>" + r.choice([" | ", " ", " &middot; ", " / "]).join(items) + "</p>"
        if form < 0.85:
            return "<table><tr>" + "".join(f"<td>{x}" for x in items) + "</tr></table>"
        return "".join(f"<div>{x}</div>" for x in items)

    def part(self) -> str:
        """One block of content."""
        r, m = self.rng, MARK
        kind = r.random()
        if kind < 0.04:
            return f"<p>{' '.join(self.words(r.randint(1, 4), m))}</p>"
        if kind < 0.5:
            return f"<p>{self.prose(m)}{r.choice(['', '</p>', '</p>'])}"
        if kind < 0.58:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{r.choice([self.heading, self.sentence])(m)}" for _ in range(r.randint(2, 6))) + f"</{tag}>"
        if kind < 0.66:
            n = r.randint(2, 4)
            rows = ["".join(f"<th>{self.heading(m)}</th>" for _ in range(n))]
            rows += ["".join(f"<td>{' '.join(self.words(r.randint(1, 3), m))}</td>" for _ in range(n)) for _ in range(r.randint(1, 5))]
            return f"<table{r.choice(['', ' class=\"data\"', ' class=\"results\"'])}>" + "".join(f"<tr>{x}</tr>" for x in rows) + "</table>"
        if kind < 0.72:
            return f"<h{r.randint(2, 4)}>{self.heading(m)}</h2><p>{self.prose(m)}</p>"
        if kind < 0.77:
            return f"<blockquote>{r.choice(['', '<p>'])}{self.prose(m, 2)}</blockquote>"
        if kind < 0.8:
            return f"<pre><code>{self.prose(m, 2)}</code></pre>"
        if kind < 0.84:
            return f"<figure><img src=x.png><figcaption>{self.heading(m)}</figcaption></figure>"
        if kind < 0.87:
            return "<dl>" + "".join(f"<dt>{self.heading(m)}<dd>{self.sentence(m)}" for _ in range(r.randint(1, 4))) + "</dl>"
        if kind < 0.9:
            return f"<div>{self.prose(m)}<br><br>{self.prose(m)}</div>"
        return f"<{(t := r.choice(['div', 'section']))}{self.name(PARTS)}>" + "".join(f"<p>{self.prose(m)}</p>" for _ in range(r.randint(1, 3))) + f"</{t}>"

    def comments(self) -> str:
        r = self.rng
        tag = r.choice(["div", "section", "ol"])
        item = "li" if tag == "ol" else "div"
        inner = "".join(
            f"<{item}{r.choice(['', self.name(['comment', 'comment-body', 'reply'])])}><b>{self.word()}</b> <p>{self.prose('', 3)}</p></{item}>" for _ in range(r.randint(1, 5))
        )
        return f"<{tag}{self.name(TALK)}>{r.choice(['', f'<h3>{self.heading(str())}</h3>'])}{inner}</{tag}>"

    def form(self) -> str:
        r = self.rng
        return f"<form{r.choice(['', self.name(NOTES), ' role=\"search\"'])}>{r.choice(['', f'<p>{self.sentence(str())}</p>'])}<label>{self.word()}</label><input name=q> <button>{self.word()}</button></form>"

    def aside(self) -> str:
        """What is put into an article but isn't part of it."""
        r, kind = self.rng, self.rng.random()
        if kind < 0.3:
            return f"<{(t := r.choice(['div', 'aside']))}{self.name(ADS)}>{r.choice(['', '<p>'])}{self.prose('', 3)}</{t}>"
        if kind < 0.55:
            return f"<{(t := r.choice(['div', 'aside', 'section', 'nav']))}{self.name(LINKS)}>{r.choice(['', f'<h4>{self.heading(str())}</h4>'])}{self.links()}</{t}>"
        if kind < 0.7:
            return f"<div{self.name(NOTES)}>{r.choice([self.form(), f'<p>{self.prose(str(), 2)}</p>'])}</div>"
        if kind < 0.8:
            return self.form()
        if kind < 0.9:
            return f"<aside>{self.prose('', 2)}</aside>"
        return f"<div style=\"display:none\">{self.prose('', 2)}</div>" if r.random() < 0.5 else f"<div hidden>{self.prose('', 2)}</div>"

    def before(self) -> list[str]:
        r, out = self.rng, []
        if r.random() < 0.5:
            t = r.choice(["header", "header", "div"])
            role = f' role="{ROLES["head"]}"' if r.random() < 0.2 else ""
            out.append(f"<{t}{self.name(HEAD) if t == 'div' or r.random() < 0.5 else ''}{role}><h{r.randint(1, 3)}>{self.heading('')}</h1><p>{self.heading('')}</p>{r.choice(['', self.links()])}</{t}>")
        if r.random() < 0.75:
            t = r.choice(["nav", "nav", "div", "ul"])
            attr = self.name(NAV) if t != "nav" or r.random() < 0.5 else ""
            role = f' role="{r.choice([ROLES["nav"], ROLES["menu"]])}"' if r.random() < 0.2 else ""
            out.append(f"<{t}{attr}{role}>{self.links()}</{t}>")
        if r.random() < 0.15:
            out.append(self.links(3))
        if r.random() < 0.3:
            out.append(f"<div{self.name(NOTES)}{r.choice(['', ' role=alert', ' role=dialog'])}><p>{self.prose('', 3)}</p><button>{self.word()}</button></div>")
        if r.random() < 0.3:
            out.append(f"<div{self.name(ADS)}>{self.prose('', 3)}</div>")
        if r.random() < 0.2:
            out.append(self.form())
        r.shuffle(out)
        return out

    def after(self) -> list[str]:
        r, out = self.rng, []
        if r.random() < 0.3:
            out.append(self.comments())
        if r.random() < 0.4:
            t = r.choice(["aside", "div"])
            attr = self.name(SIDE) if t == "div" or r.random() < 0.5 else ""
            out.append(f"<{t}{attr}><h3>{self.heading('')}</h3>{r.choice([self.links(), f'<p>{self.prose(str(), 3)}</p>'])}</{t}>")
        if r.random() < 0.3:
            out.append(f"<{(t := r.choice(['div', 'section', 'aside']))}{self.name(LINKS)}>{r.choice(['', f'<h3>{self.heading(str())}</h3>'])}{self.links()}</{t}>")
        if r.random() < 0.2:
            out.append(f"<div{self.name(ADS)}>{self.prose('', 3)}</div>")
        if r.random() < 0.15:
            out.append(self.links(3))
        if r.random() < 0.15:
            out.append(self.form())
        r.shuffle(out)
        if r.random() < 0.7:
            t = r.choice(["footer", "footer", "div"])
            attr = self.name(FOOT) if t == "div" or r.random() < 0.3 else ""
            inner = r.choice([f"&copy; 2020 {self.heading('')}", f"<p>&copy; {self.prose('', 2)}</p>", self.links(), f"{self.prose('', 2)} &middot; {self.link()}"])
            out.append(f"<{t}{attr}>{inner}</{t}>")
        elif r.random() < 0.3:
            out.append(f"<p>&copy; 2020 {self.heading('')}</p>")
        return out

    def page(self) -> str:
        r = self.rng
        parts = [f"<h1>{self.heading(MARK)}</h1>"] if r.random() < 0.8 else []
        if parts and r.random() < 0.2:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(r.choice([1, 2, 4, 8, 15])):
            parts.append(self.part())
            if r.random() < 0.12:
                parts.append(self.aside())
        if r.random() < 0.25:
            parts.append(r.choice([self.comments, self.aside])())
        inner, form = "".join(parts), r.random()
        if form < 0.35:
            inner = f"<article{r.choice(['', self.name(CONTENT)])}>{inner}</article>"
            if r.random() < 0.3:
                inner = f"<main>{inner}</main>"
        elif form < 0.5:
            inner = f"<main{r.choice(['', ' role=main'])}>{inner}</main>"
        elif form < 0.75:
            inner = f"<div{self.name(CONTENT)}{r.choice(['', '', ' itemprop=\"articleBody\"'])}>{inner}</div>"
        elif form < 0.85:
            inner = f"<div{r.choice(['', self.name(NEUTRAL)])}>{inner}</div>"
        elif form < 0.9:
            inner = f"<table><tr><td>{self.links()}</td><td>{inner}</td></tr></table>"
        blocks = [*self.before(), inner, *self.after()]
        if r.random() < 0.1:  # a page of bare text
            blocks = [f"{r.choice(['', '<p>', '<div>'])}{r.choice([self.heading, self.prose])(MARK)}"]
        body = "".join(blocks)
        for _ in range(r.randint(0, 3)):
            body = f"<div{self.name(NEUTRAL)}>{body}</div>"
        return f"<html><head><title>{self.heading('')}</title><style>p{{}}</style></head><body>{body}<script>var a='</p>';</script></body></html>"


def pages(n: int, seed: int) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
