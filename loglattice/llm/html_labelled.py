"""Labelled pages that the content model is trained on.

In a template ``y="1"`` marks a part that is main text and ``y="0"`` one that is not; unmarked parts inherit,
and a page starts as not.  {s} stands for a sentence, {p} for a paragraph and {w} for a few words, which a
fixed rule fills, so that a template gives several pages.
"""

from __future__ import annotations

import random

#: Words of the filled-in text.
WORDS = (
    "the of and to in is that it was for on are as with they at be this from have or by one had not but what all were when we "
    "river market engine garden winter signal letter harbour method village copper window paper forest theory morning"
).split()

TEMPLATES = (
    '<html><head><title>{w}</title></head><body><nav><ul><li><a href="/a">{w}</a></li><li><a href="/b">{w}</a></li></ul></nav>'
    '<div class="ad">{s}</div><article y="1"><h1>{w}</h1><p><b>{w}<br><p>{p}</p><p>{p}</p><p>{s}</p></article><footer>&copy; {w} &middot; {s}</footer></body></html>',
    '<html><body><header><a href="/">{w}</a><nav><a href="/1">{w}</a> <a href="/2">{w}</a></nav></header><main><article y="1"><h1>{w}</h1><p>{p}</p>'
    '<h2>{w}</h2><p>{p} <a href="/x">{w}</a> {s}</p><ul><li>{s}</li><li>{s}</li></ul><blockquote><p>{s}</p></blockquote></article></main>'
    '<aside><h3>{w}</h3><ul><li><a href="/r">{w}</a></li><li><a href="/q">{w}</a></li></ul></aside><footer><p>{s}</p></footer></body></html>',
    '<html><body><div id="header"><h1><a href="/">{w}</a></h1><p>{w}</p></div><div id="menu"><a href="/1">{w}</a><a href="/2">{w}</a></div>'
    '<div id="content" y="1"><h2>{w}</h2><p>{p}</p><p>{p}</p><p>{s}</p></div><div id="sidebar"><h3>{w}</h3><p>{s}</p></div>'
    '<div id="footer"><p>{w} <a href="/t">{w}</a></p></div></body></html>',
    '<html><body><div class="cookie-notice"><p>{s}</p><button>{w}</button></div><div class="page"><div class="post" y="1"><h1>{w}</h1><p>{p}</p><p>{p}</p>'
    '<div class="share" y="0"><a href="/f">{w}</a><a href="/t">{w}</a></div></div><div class="comments"><h3>{w}</h3><div class="comment"><p>{p}</p></div>'
    '<div class="comment"><p>{s}</p></div></div></div></body></html>',
    '<html><body><article y="1"><h1>{w}</h1><p>{p}</p><aside y="0"><p>{s}</p></aside><p>{p}</p><div class="advert" y="0"><p>{s} {s}</p></div><p>{p}</p>'
    '<figure><figcaption>{s}</figcaption></figure><section y="0" class="comments"><h2>{w}</h2><article class="comment"><p>{p}</p></article></section>'
    '<footer y="0"><p>{s}</p></footer></article></body></html>',
    '<html><body><div class="wrap"><div class="entry-content" y="1"><p>{p}</p><p>{p}</p><table><tr><td>{w}</td><td>{w}</td></tr></table></div>'
    '<form action="/s"><label>{w}</label><input><p>{s}</p><button>{w}</button></form><div class="related"><ul><li><a href="/1">{w}</a></li>'
    '<li><a href="/2">{w}</a></li></ul></div></div></body></html>',
    '<html><body><div class="banner promo"><p>{s}</p></div><main y="1"><h1>{w}</h1><div><p>{p}</p></div><div><p>{s}</p><p>{p}</p></div><pre>{s}</pre>'
    '<form y="0"><p>{s}</p></form></main><div role="contentinfo"><p>{s}</p></div></body></html>',
    '<html><body><section class="story" y="1"><h1>{w}</h1><p>{s}</p><p>{p}</p><dl><dt>{w}</dt><dd>{s}</dd></dl><p><i>{s}</i></p></section>'
    '<div class="newsletter"><h4>{w}</h4><p>{s}</p></div><div class="breadcrumbs"><a href="/">{w}</a> / <a href="/x">{w}</a></div>'
    '<div id="popup"><p>{s} {s}</p></div></body></html>',
    '<html><body><div class="notice"><p>{p}</p></div><article y="1"><header y="0"><p>{w}</p></header><h1>{w}</h1><p>{p}</p><p>{p}</p><ol><li>{s}</li></ol>'
    '<nav y="0"><a href="/p">{w}</a> <a href="/n">{w}</a></nav></article><div class="sponsored"><p>{p}</p></div></body></html>',
    '<html><body><nav><a href="/">{w}</a></nav><article y="1"><h1>{w}</h1><p>{s}</article><div class="ads"><p>{p}</p></div></body></html>',
    '<html><body><p y="1">{p}</p><p y="1">{p}</p><p y="1">{s}</p><div class="footer">{w}</div></body></html>',
    '<html><body><nav><ul><li><a href="/1">{w}</a></li><li><a href="/2">{w}</a></li><li><a href="/3">{w}</a></li></ul></nav><div class="ad">{w}</div>'
    '<article y="1"><h1>{w}</h1><p><b>{w}<br><p>{w}</p><p><b>{w}<br></article><footer>&copy; {w}</footer></body></html>',
    '<html><body><nav><a href="/1">{w}</a><a href="/2">{s}</a></nav><article y="1"><h1>{w} {w} {w}</h1><p><b>{w} {w} {w}<br></article><footer>{s}</footer></body></html>',
    '<html><body><main y="1"><section y="0" id="comments"><div>{s}</div></section><p>{s}</p></main><div class="alert">{s}</div></body></html>',
    '<html><body><article y="1"><p>{s} <span class="ad" y="0">{w}</span> {s}</p><p>{s}</p><p>{p} <em>{w}</em> {s}</p></article><aside>{w}</aside></body></html>',
    '<html><body><main y="1"><p>{s}</p></main><div class="comment-list"><p>{s}</p></div></body></html>',
    '<html><body><p y="1">{s}</p><p y="1">{s}</p></body></html>',
    '<html><body><div y="1"><h1>{w}</h1><p>{s}</p><p>{s}</p><div>{p}</div></div><div class="sidebar"><div><p>{p}</p></div></div>'
    '<ul class="menu"><li><a href="/1">{w}</a></li></ul></body></html>',
    '<html y="1"><body><p>{p}</p></body></html>',
    '<html y="1"><body><p>{s} {s}</p></body></html>',
    '<html y="1"><body>{p}</body></html>',
    '<html y="1">{s} {s}</html>',
)


def _words(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) for _ in range(n))


def _sentence(draw: random.Random) -> str:
    return _words(draw, draw.randint(4, 14)).capitalize() + draw.choice(("", ".", ".", "."))


def labelled_pages(each: int = 4) -> list[str]:
    """``each`` pages of every template, of short to long text."""
    draw = random.Random(3)
    out = []
    for template in TEMPLATES:
        for n in range(each):
            page = template
            for mark, fill in (
                ("{p}", lambda: " ".join(_sentence(draw) for _ in range(draw.randint(1, 2 + 3 * n)))),
                ("{s}", lambda: _sentence(draw)),
                ("{w}", lambda: _words(draw, draw.randint(1, 4)).capitalize() + draw.choice(("", "", ".", ","))),
            ):
                while mark in page:
                    page = page.replace(mark, fill(), 1)
            out.append(page)
    return out
