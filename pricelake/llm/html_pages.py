"""Labelled pages for the HTML extractor: composed from layouts by a fixed seed.

Every page is HTML whose text is marked: words of the article are drawn from one list, all other text
from the others, and ``labelled`` returns for each page the set of text pieces that belong to the
article. The layouts vary what real sites vary: semantic or plain containers, class names, link
lists, notices, adverts, forms and reader comments, with closed and unclosed paragraphs.
"""

from __future__ import annotations

import random

# Names that sites give to the parts of a page.
CONTENT = [*["article"] * 6, *["main"] * 3, "section", "div.content", "div.post", "div.entry", "div.story", "div.article-body",
           "div.main-content", "div.text", "div", "td", "body"]
MENUS = ["nav", "ul.menu", "div.nav", "div.navbar", "ul.breadcrumbs", "ul", "div.navigation", "ul.links", "div.toc"]
SIDES = ["aside", "div.sidebar", "div.related", "section.related", "div.widget", "div.trending", "div.teaser", "div.recommended"]
NOTICES = ["div.cookie", "div.notice", "div.cookie-banner", "div.alert", "div.consent", "p.notice", "div.subscribe", "div.newsletter",
           "div.paywall", "div.popup", "div.modal"]
ADVERTS = ["div.ad", "div.ads", "div.advert", "div.advertisement", "aside.ad", "div.sponsored", "div.promo", "div.banner", "section.promo"]
HEADS = ["header", "div.header", "div.masthead", "div.top", "div.topbar", "header.site-header"]
FOOTS = ["footer", "div.footer", "div.copyright", "div.bottom", "div.legal", "footer.site-footer"]
COMMENTS = ["div.comments", "section.comments", "ol.comment-list", "div.discussion", "section.responses", "div.replies", "ul.comments"]
SHARES = ["div.share", "ul.social", "div.tags", "div.toolbar", "div.pager", "div.pagination"]

_SYLLABLES = "ka lo mi ra ne tu so vi da pe gu ri to an el is or un".split()


def _words(rng: random.Random, n: int) -> str:
    out = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
    out[0] = out[0].capitalize()
    return " ".join(out)


def _sentences(rng: random.Random, n: int) -> str:
    return " ".join(_words(rng, rng.randint(3, 18)) + rng.choice([".", ".", ".", "?", "!"]) for _ in range(n))


def _box(name: str, inner: str) -> str:
    tag, _, cls = name.partition(".")
    how = f' class="{cls}"' if cls else ""
    return f"<{tag}{how}>{inner}</{tag}>"


def _links(rng: random.Random, n: int) -> str:
    one = [f'<a href="/x">{_words(rng, rng.randint(1, 3))}</a>' for _ in range(n)]
    return "".join(f"<li>{x}</li>" for x in one) if rng.random() < 0.7 else " | ".join(one)


def _listed(name: str, inner: str) -> str:
    tag = name.partition(".")[0]
    return _box(name, inner) if tag in ("ul", "ol") or "<li>" not in inner else _box(name, f"<ul>{inner}</ul>")


def _boilerplate(rng: random.Random) -> str:
    kind = rng.randrange(9)
    if kind == 0:
        return _listed(rng.choice(MENUS), _links(rng, rng.randint(3, 9)))
    if kind == 1:
        return _box(rng.choice(SIDES), f"<h3>{_words(rng, 2)}</h3>" + rng.choice([
            _links(rng, 4), f"<p>{_sentences(rng, 1)}</p>", f'<p><a href="#">{_words(rng, 7)}</a></p><p>{_words(rng, 9)}</p>']))
    if kind == 2:
        return _box(rng.choice(NOTICES), rng.choice([_sentences(rng, 2), f"<p>{_sentences(rng, 2)}</p><button>{_words(rng, 1)}</button>"]))
    if kind in (3, 4):
        return _box(rng.choice(ADVERTS), rng.choice([_words(rng, 4), _sentences(rng, 1), f"<p>{_sentences(rng, 3)}</p>", f'<a href="#">{_words(rng, 5)}</a>']))
    if kind == 5:
        return f"<form><label>{_words(rng, 2)}</label><input><p>{_words(rng, 6)}</p><button>{_words(rng, 1)}</button></form>"
    if kind in (6, 7):
        each = "".join(f'<div class="comment"><b>{_words(rng, 1)}</b><p>{_sentences(rng, rng.randint(1, 5))}</p></div>' for _ in range(rng.randint(1, 4)))
        return _box(rng.choice(COMMENTS), f"<h3>{_words(rng, 2)}</h3>" + each)
    return _box(rng.choice(SHARES), _links(rng, 3))


def _untidy(rng: random.Random) -> str:
    text = _words(rng, rng.choice([1, 1, 2, 3, 4, 6, 20]))
    return rng.choice([text, text + ".", f"{text} " * rng.randint(5, 60), f"{text}. " * rng.randint(2, 9), text.upper() + "!!", text.replace(" ", " | "), text.replace(" ", "*** "),
                       f"{text} © {rng.randint(1990, 2030)}", f"Copyright {text}", text.replace(" ", " - ") + "."])


def _article(rng: random.Random, mark) -> str:
    out = [f"<h1>{mark(_words(rng, rng.randint(3, 12)))}</h1>"] if rng.random() < 0.8 else []
    if rng.random() < 0.3:
        out.append(f"<h2>{mark(_words(rng, 4))}</h2>")
    untidy = rng.choice([0.05, 0.25, 0.25, 0.6, 0.95])      # short and untidy paragraphs are common, in some articles most
    same = _untidy(rng) if rng.random() < 0.15 else None    # and some repeat one of them
    for _ in range(rng.choice([1, 2, 3, 5, 8, 8, 20, 45])):
        text = lambda n: mark(_sentences(rng, n))
        kind = rng.randrange(12)
        if rng.random() < untidy:
            out.append(f"<p>{mark(same if same and rng.random() < 0.8 else _untidy(rng))}</p>")
        elif kind < 7 and kind != 5 and kind != 6:
            out.append(f"<p>{text(rng.randint(1, 8))}</p>")
        elif kind == 5:
            out.append(f'<p>{text(2)} <a href="#">{mark(_words(rng, 2))}</a> {text(1)} <em>{mark(_words(rng, 1))}</em></p>')
        elif kind == 6:
            out.append(f"<p><b>{text(1)}<br><p>{text(2)}</p>")
        elif kind == 7:
            out.append("<ul>" + "".join(f"<li>{mark(_words(rng, rng.randint(2, 12)))}</li>" for _ in range(3)) + "</ul>")
        elif kind in (8, 9):
            out.append(f"<blockquote><p>{text(1)}</p></blockquote>" if rng.random() < 0.5 else f"<h2>{mark(_words(rng, 3))}</h2><p>{mark(_words(rng, 2))}.</p>")
        else:
            out.append(f"<div>{text(rng.randint(1, 3))}</div>")
        if rng.random() < 0.12:
            out.append(_boilerplate(rng))
    return "".join(out)


def labelled(n: int, seed: int = 1) -> list[tuple[str, set[str]]]:
    """``n`` pages with the text pieces of their articles."""
    rng, pages = random.Random(seed), []
    for _ in range(n):
        own: set[str] = set()

        def mark(text: str, own: set[str] = own) -> str:
            own.add(text.strip())
            return text

        top = [_box(rng.choice(HEADS), rng.choice([_words(rng, 2), f"<h1>{_words(rng, 2)}</h1>{_listed('nav', _links(rng, 4))}", f"<p>{_words(rng, 6)}</p>"]))] if rng.random() < 0.5 else []
        top += [_listed(rng.choice(MENUS[:2]), _links(rng, rng.randint(4, 8)))] if rng.random() < 0.7 else []
        top += [_boilerplate(rng) for _ in range(rng.randint(0, 3))]
        body = _article(rng, mark)
        name = rng.choice(CONTENT)
        if name == "td":
            body = f"<table><tr><td>{_listed('ul', _links(rng, 3))}</td><td>{body}</td></tr></table>"
        elif name != "body":
            body = _box(name, body)
        if rng.random() < 0.25 and name != "main":
            body = _box("main" if rng.random() < 0.5 else "div.wrapper", body + (_boilerplate(rng) if rng.random() < 0.5 else ""))
        end = [_boilerplate(rng) for _ in range(rng.randint(0, 3))]
        end += [_box(rng.choice(FOOTS), rng.choice(["&copy; " + _words(rng, 3) + " &middot; " + _sentences(rng, 1), f"<p>{_words(rng, 5)}</p>", _links(rng, 4)]))] if rng.random() < 0.8 else []
        pages.append((f"<html><head><title>{_words(rng, 4)}</title></head><body>{''.join(top)}{body}{''.join(end)}</body></html>", own))
    return pages
