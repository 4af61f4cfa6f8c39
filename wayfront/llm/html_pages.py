"""Labelled pages to train the extraction model on, made by rule from building blocks.

Each page is markup in which every text block is marked: elements with the attribute
``data-main`` hold main text, all others don't.  The attribute is removed before the
model sees a page.
"""

from __future__ import annotations

import random

WORDS = "lo mira tan sel ovo dral nim perra quon ist vale bor uth ena scar toll wem jade ori pleth".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high)))


def _sentence(rng: random.Random) -> str:
    return _words(rng, 4, 18).capitalize() + rng.choice([".", ".", ".", "?", ", " + _words(rng, 2, 9) + "."])


def _paragraph(rng: random.Random) -> str:
    if rng.random() < 0.2:
        return _words(rng, 1, 6).capitalize() + "."
    return " ".join(_sentence(rng) for _ in range(rng.randint(1, 6)))


def _links(rng: random.Random, item: str = "li") -> str:
    return "".join(f'<{item}><a href="/{_words(rng, 1, 1)}">{_words(rng, 1, 3)}</a></{item}>' for _ in range(rng.randint(2, 8)))


def _boilerplate(rng: random.Random, inside: bool) -> str:
    """A block that is not main text; ``inside`` the article or beside it."""
    name = lambda *names: f'{rng.choice(["class", "id"])}="{rng.choice(names)}"'
    both = [
        lambda: f"<div {name('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo')}>{_paragraph(rng) if rng.random() < 0.5 else _words(rng, 2, 9)}</div>",
        lambda: f"<aside {name('sidebar', 'related', 'widget')}><h3>{_words(rng, 1, 3)}</h3><ul>{_links(rng)}</ul></aside>" if rng.random() < 0.6 else f"<aside><p>{_paragraph(rng)}</p></aside>",
        lambda: f"<form action='/s'><label>{_words(rng, 1, 3)}</label><input name=q><p>{_words(rng, 3, 12)}</p><button>{_words(rng, 1, 1)}</button></form>",
        lambda: f"<div {name('share', 'social', 'share-buttons')}>{_links(rng, 'span')}</div>",
        lambda: f"<div {name('newsletter', 'subscribe', 'signup')}><p>{_paragraph(rng)}</p></div>",
        lambda: f"<section {name('comments', 'comment-list', 'disqus')}><h3>{_words(rng, 1, 2)}</h3>" + "".join(f"<div class=comment><b>{_words(rng, 1, 2)}</b><p>{_paragraph(rng)}</p></div>" for _ in range(rng.randint(1, 3))) + "</section>",
        lambda: f"<div {name('cookie-notice', 'cookie', 'notice', 'banner', 'consent', 'alert')}><p>{_paragraph(rng)}</p><button>{_words(rng, 1, 1)}</button></div>",
    ]
    beside = [
        lambda: f"<nav><ul>{_links(rng)}</ul></nav>",
        lambda: f"<div {name('nav', 'menu', 'navbar', 'breadcrumb', 'topbar')}>{_links(rng, 'span')}</div>",
        lambda: f"<header><a href=/>{_words(rng, 1, 3)}</a><p>{_words(rng, 2, 8)}</p></header>" if rng.random() < 0.5 else f"<div {name('header', 'masthead')}><h2>{_words(rng, 1, 4)}</h2></div>",
        lambda: f"<footer>&copy; {_words(rng, 1, 3)} &middot; {_paragraph(rng)}</footer>" if rng.random() < 0.7 else f"<div {name('footer', 'copyright', 'legal')}><p>{_paragraph(rng)}</p></div>",
        lambda: f"<div {name('sidebar', 'side', 'widget')}><h4>{_words(rng, 1, 3)}</h4><p>{_paragraph(rng)}</p></div>",
    ]
    return rng.choice(both if inside else both + beside + beside)()


def _main(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.62:
        text = _paragraph(rng)
        if rng.random() < 0.2:
            text = f'{_words(rng, 1, 5)} <a href="/x">{_words(rng, 1, 3)}</a> {text}'
        return f"<p data-main>{text}" + rng.choice(["</p>", "</p>", "<br>"])
    if kind < 0.74:
        return f"<h{rng.randint(2, 4)} data-main>{_words(rng, 1, 9)}</h3>"
    if kind < 0.84:
        return "<ul>" + "".join(f"<li data-main>{_words(rng, 2, 16)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
    if kind < 0.9:
        return f"<blockquote data-main>{_paragraph(rng)}</blockquote>"
    if kind < 0.94:
        return f"<pre data-main>{_words(rng, 3, 30)}</pre>"
    if kind < 0.97:
        return "<table>" + "".join(f"<tr><td data-main>{_words(rng, 1, 5)}</td><td data-main>{_words(rng, 1, 5)}</td></tr>" for _ in range(2)) + "</table>"
    return f"<figure><img src=x><figcaption data-main>{_words(rng, 3, 12)}</figcaption></figure>"


def labelled_page(rng: random.Random) -> str:
    """One page."""
    opening, closing = rng.choice([("<article>", "</article>")] * 5 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"), ('<div class="post entry">', "</div>"), ('<div class="article-body">', "</div>"), ("", "")])
    parts = [f"<h1 data-main>{_words(rng, 1, 14)}</h1>"] if rng.random() < 0.85 else []
    if rng.random() < 0.2 and parts:
        parts = [f"<header>{parts[0]}</header>"]
    for _ in range(rng.choice([1, 1, rng.randint(1, 9), rng.randint(1, 9)])):
        parts.append(_main(rng))
        if rng.random() < 0.14:
            parts.append(_boilerplate(rng, inside=True))
    before = "".join(_boilerplate(rng, False) for _ in range(rng.randint(0, 4)))
    after = "".join(_boilerplate(rng, False) for _ in range(rng.randint(0, 4)))
    return f"<html><head><title>{_words(rng, 2, 6)}</title></head><body>{before}{opening}{''.join(parts)}{closing}{after}</body></html>"


def labelled_pages(count: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(count)]
