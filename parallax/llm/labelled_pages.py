"""Labelled pages for the block model: seeded compositions of page parts with a label for each.

The parts are written the way pages commonly write them; texts are random words, so the model
learns from structure and shape, not from words.
"""
from __future__ import annotations

import random

#: Usual names of page parts.
MAIN = ["<article>", "<main>", "<main><article>", '<div class="content">', '<div id="content">', '<div class="post">', '<div class="entry-content">',
        '<div class="article-body">', '<div id="main">', '<section class="story">', '<div class="text">', "<div>", '<div class="main-content">', "<section>"]
MENU = ["<nav>", '<div class="nav">', '<div class="menu">', '<div id="navigation">', '<div class="navbar">', '<nav class="breadcrumb">', '<div class="breadcrumbs">',
        '<div class="topbar">', '<div role="navigation">', '<div class="pagination">', '<div class="pager">', '<div class="toc">']
HEAD = ["<header>", '<div class="header">', '<div id="header">', '<div class="masthead">', '<div class="banner">', '<header class="site-header">', '<div class="logo">']
FOOT = ["<footer>", '<div class="footer">', '<div id="footer">', '<div class="copyright">', '<footer class="site-footer">', '<div class="legal">']
SIDE = ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="related">', '<div class="related-posts">', '<div class="widget">', '<div class="recommended">',
        '<div class="share">', '<div class="social">', '<div class="tags">', '<div class="side">', '<div class="more">', '<div class="trending">', '<div class="author-bio">']
NOTICE = ['<div class="notice">', '<div class="cookie">', '<div class="cookie-banner">', '<div id="cookie-consent">', '<div class="alert">', '<div class="popup">',
          '<div class="newsletter">', '<div class="subscribe">', '<div class="gdpr">', '<div class="modal">', '<div class="privacy">', '<div role="alert">', '<div class="disclaimer">',
          '<div class="message">', '<dialog>', '<div class="overlay">', '<div class="paywall">']
ADVERT = ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div id="ad-top">', '<div class="promo">',
          '<aside class="ad">', '<div class="banner-ad">', '<div class="adsbox">', '<ins class="adsbygoogle">', '<div class="promotion">', '<div class="sponsor">']
FORM = ["<form>", '<form class="search">', '<div class="search">', '<form id="login">', '<form class="contact-form">', "<fieldset>", '<div class="form">', '<div class="login">']
COMMENTS = ['<div class="comments">', '<section class="comments">', '<div id="comments">', '<ol class="comment-list">', '<div class="comment">', '<div class="discussion">',
            '<section id="respond">', '<div class="replies">', '<div class="reader-comments">', '<div id="disqus_thread">', '<div class="feedback">', '<div class="reviews">']


class PageMaker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice("aeiouéñü") if k % 2 else self.rng.choice("bcdfghklmnprst") for k in range(self.rng.randrange(2, 9)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randrange(a, b)))

    def sentences(self, a: int, b: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.rng.choice("...?!") for _ in range(self.rng.randrange(a, b)))

    def links(self, a: int, b: int) -> str:
        kind = self.rng.randrange(3)
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.rng.randrange(a, b))]
        return ["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " ".join(items), "".join(f"<div>{x}</div>" for x in items)][kind]

    def part(self, opens: list[str], body: str, label: str) -> str:
        tags = self.rng.choice(opens)
        names = [t.split(">")[0].split()[0] for t in tags.split("<")[1:]]
        first, rest = tags.split(">", 1)
        return f'{first} data-label="{label}">{rest}{body}' + "".join(f"</{n}>" for n in reversed(names))

    def paragraph(self) -> str:
        text = self.sentences(1, 6)
        roll = self.rng.random()
        if roll < 0.15:
            text = f'{text} <a href="/x">{self.words(1, 4)}</a> {self.sentences(1, 3)}'
        elif roll < 0.25:
            text = f"<b>{text}<br>"
        elif roll < 0.35:
            text = self.words(1, 7) + "."
        elif roll < 0.42:
            text = self.words(1, 9)
        return f"<p>{text}</p>" if self.rng.random() < 0.8 else f"<p>{text}"

    def rich(self) -> str:
        kind = self.rng.randrange(7)
        if kind == 0:
            return self.heading(1, 8)
        if kind == 1:
            return "<ul>" + "".join(f"<li>{self.words(2, 14)}</li>" for _ in range(self.rng.randrange(2, 6))) + "</ul>"
        if kind == 2:
            return f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>"
        if kind == 3:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(3)) + "</table>"
        if kind == 4:
            return f"<figure><img src=x><figcaption>{self.words(3, 12)}</figcaption></figure>"
        if kind == 5:
            return f"<pre>{self.words(3, 20)}</pre>"
        return self.heading(1, 6)

    def heading(self, a: int, b: int) -> str:
        tag = self.rng.choice(("h2", "h2", "h3", "h3", "h4"))
        return f"<{tag}>{self.words(a, b)}</{tag}>"

    def boilerplate(self, where: str) -> str:
        w, rng = self, self.rng
        make = {
            "menu": lambda: w.part(MENU, w.links(2, 9), "0"),
            "head": lambda: w.part(HEAD, rng.choice((f"<h1>{w.words(1, 4)}</h1>", f"<p>{w.words(1, 6)}</p>", w.words(1, 5), w.links(1, 5))), "0"),
            "foot": lambda: w.part(FOOT, rng.choice((f"&copy; {w.words(1, 5)} &middot; {w.sentences(1, 2)}", f"<p>Copyright 2020 {w.words(2, 6)}</p>", w.links(2, 6), f"<p>{w.sentences(1, 3)}</p>")), "0"),
            "side": lambda: w.part(SIDE, rng.choice((w.heading(1, 4) + w.links(2, 6), w.heading(1, 4) + f"<p>{w.sentences(1, 3)}</p>", f"<p>{w.sentences(1, 3)}</p>", w.words(2, 9))), "0"),
            "notice": lambda: w.part(NOTICE, rng.choice((w.sentences(1, 3), f"<p>{w.sentences(1, 3)}</p>", w.sentences(1, 2) + "<button>ok</button>", w.heading(1, 4) + f"<p>{w.sentences(1, 3)}</p>")), "0"),
            "advert": lambda: w.part(ADVERT, rng.choice((w.sentences(1, 3), f"<p>{w.sentences(1, 2)}</p>", f'<a href="/b">{w.words(2, 8)}</a>')), "0"),
            "form": lambda: w.part(FORM, f"<label>{w.words(1, 3)}</label><input name=q><p>{w.words(1, 6)}</p><button>go</button>", "0"),
            "comments": lambda: w.part(COMMENTS, w.heading(1, 3) + "".join(rng.choice((f"<div class=\"comment\"><p>{w.sentences(1, 4)}</p></div>", f"<p>{w.sentences(1, 4)}</p>", f"<li>{w.sentences(1, 3)}</li>")) for _ in range(rng.randrange(1, 5))), "0"),
        }
        kinds = {"top": ["menu", "head", "notice", "advert", "form", "menu", "head"], "inside": ["advert", "advert", "notice", "side", "form"],
                 "bottom": ["comments", "side", "foot", "form", "advert", "notice", "menu", "comments", "foot"]}[where]
        return make[rng.choice(kinds)]()

    def page(self) -> str:
        rng = self.rng
        top = "".join(self.boilerplate("top") for _ in range(rng.randrange(0, 4)))
        body = [f"<h1>{self.words(2, 12)}</h1>"] * (rng.random() < 0.8)
        for _ in range(rng.randrange(1, 12)):
            body.append(self.rich() if rng.random() < 0.2 else self.paragraph())
            if rng.random() < 0.1:
                body.append(self.boilerplate("inside"))
        bottom = "".join(self.boilerplate("bottom") for _ in range(rng.randrange(0, 4)))
        end = "</body></html>" if rng.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{top}{self.part(MAIN, ''.join(body), '1')}{bottom}{end}"


def labelled_pages(n: int, seed: int = 3) -> list[str]:
    """Pages whose parts carry data-label 1 (main text) or 0."""
    maker = PageMaker(seed)
    return [maker.page() for _ in range(n)]
