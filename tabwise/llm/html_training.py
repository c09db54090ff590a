"""Labelled pages for the tree model. ``data-label="1"`` marks an element as content, ``"0"`` as boilerplate; the
nearest mark counts. ``{L}``, ``{M}`` and ``{S}`` stand for a long, middle and short run of prose, ``{W}`` for a
word or two."""

from __future__ import annotations

_HEAD = '<html><head><meta charset="utf-8"><title>{S}</title><style>x{}</style><script>y()</script></head>'
_MENU = '<nav class="menu"><ul><li><a href="/a">{W}</a></li><li><a href="/b">{W}</a></li><li><a href="/c">{W}</a></li></ul></nav>'

# page bodies, written for this model
_BODIES = (
    _MENU + '<div class="ad">{S}</div><article data-label="1"><h1>{S}</h1><p><b>{M}</b></p><p>{L}</p><p>{M}</p><p>{S}</p></article>'
            '<footer>&copy; {S}</footer>',
    '<nav><ul><li><a href="/">{W}</a></li><li><a href="/x">{W}</a></li></ul></nav><div class="ad banner">{M}</div><article data-label="1">'
    '<h1>{S}</h1><p>{L}</p><p>{L}</p><p>{W}</p><h2>{S}</h2><p>{M}</p></article><footer><p>{S}</p></footer>',
    '<header class="site-header"><h1>{W}</h1><p>{S}</p></header>' + _MENU + '<main data-label="1"><article class="post"><h1>{S}</h1><p>{L}</p>'
    '<ul><li>{S}</li><li>{S}</li></ul><blockquote>{M}</blockquote><p>{M} <a href="/z">{W}</a> {S} <em>{W}</em></p></article>'
    '<section id="comments" class="comments" data-label="0"><h2>{W}</h2><div class="comment"><p>{M}</p></div><div class="comment"><p>{S}</p></div></section></main>'
    '<aside class="sidebar"><h3>{W}</h3><p>{S}</p><ul><li><a href="/q">{S}</a></li><li><a href="/r">{S}</a></li></ul></aside><footer><a href="/t">{W}</a> {S}</footer>',
    '<div class="cookie-notice" role="alert"><p>{M}</p><button>{W}</button></div><div class="header"><a href="/">{W}</a></div><div class="content" data-label="1">'
    '<h1>{S}</h1><p>{M}</p><p>{L}</p><pre>{M}</pre><div class="ad" data-label="0"><p>{S}</p></div><p>{L}</p></div>'
    '<form class="search"><label>{W}</label><input><button>{W}</button></form><div class="footer"><p>{S}</p></div>',
    '<div id="top" class="notice"><p>{M}</p></div><article data-label="1"><header data-label="0"><p class="byline">{W}</p></header><h1>{S}</h1><p>{L}</p>'
    '<figure><img><figcaption>{S}</figcaption></figure><p>{M}</p><aside class="related" data-label="0"><h3>{W}</h3><a href="/m">{S}</a></aside><p>{L}</p>'
    '<footer data-label="0"><p>{S}</p></footer></article><div class="comments" id="comments"><ol><li class="comment"><p>{M}</p></li><li class="comment"><p>{L}</p></li></ol></div>',
    '<header><div class="logo">{W}</div></header>' + _MENU + '<div class="breadcrumb"><a href="/">{W}</a> <a href="/b">{W}</a></div><article data-label="1"><h1>{S}</h1>'
    '<table><tr><th>{W}</th><td>{S}</td></tr><tr><th>{W}</th><td>{S}</td></tr></table><p>{L}</p><div class="share social" data-label="0"><a href="/s">{W}</a><a href="/u">{W}</a></div>'
    '<p>{M}</p></article><div class="newsletter subscribe"><h3>{S}</h3><form><input><button>{W}</button></form></div><footer class="footer"><ul><li><a href="/i">{W}</a></li></ul><p>{S}</p></footer>',
    '<div class="advert">{S}</div><div class="sponsored promo"><p>{M}</p></div><article data-label="1"><p>{M}</p><p>{L}</p><p>{S}</p><ol><li>{M}</li><li>{S}</li></ol></article>'
    '<div class="sidebar"><div class="widget"><h4>{W}</h4><p>{M}</p></div></div><noscript><p>{S}</p></noscript><footer>{S}</footer>',
    '<nav><a href="/">{W}</a><a href="/1">{W}</a></nav><main data-label="1"><h1>{S}</h1><p>{L}</p><section><h2>{S}</h2><p>{M}</p><p>{L}</p></section>'
    '<section><h2>{S}</h2><p>{L}</p><dl><dt>{W}</dt><dd>{S}</dd></dl></section></main><section class="comments"><article class="comment"><p>{M}</p></article>'
    '<article class="comment"><p>{L}</p></article><form><textarea></textarea><button>{W}</button></form></section><footer>{S}</footer>',
    '<div class="notice alert"><p>{M}</p></div><div class="wrapper">' + _MENU + '<article class="article entry" data-label="1"><h1>{S}</h1><p>{L}</p><div class="text"><p>{M}</p><p>{L}</p></div>'
    '<p>{S}</p></article><aside><p>{M}</p><div class="ad">{S}</div></aside></div><footer><p>{S}</p><p><a href="/p">{W}</a></p></footer>',
    '<div class="popup modal banner"><p>{M}</p><a href="/y">{W}</a></div><article data-label="1"><h1>{S}</h1><p>{M}</p><p>{L}</p><p>{L}</p></article><div class="reader-comments">'
    '<p class="comment">{L}</p><p class="comment">{M}</p></div><form action="/f"><p>{S}</p><input><select><option>{W}</option></select></form><div id="footer">{S}</div>',
)
# fixed values: usual names of what is not the article, and of what is
_OTHER = """ad ads advert advertisement adsense banner sponsored sponsor promo promotion notice alert cookie consent gdpr popup modal
overlay sidebar side rail widget menu nav navbar navigation breadcrumb breadcrumbs toolbar header masthead topbar footer bottom
copyright comment comments reply replies disqus discussion responses reader related recommended more share sharing social follow
newsletter subscribe signup login register form search pagination pager tags byline author meta disclaimer skip hidden""".split()
_MAIN = "content main article post entry body text story page article-body post-content entry-content story-body main-content".split()


def _named(other: str, main: str, k: int) -> str:
    """A page with an element called ``other`` before, inside and after one called ``main``."""
    inner = ('<p>{M}</p>', '{S}', '<p>{L}</p><p>{S}</p>', '<h3>{W}</h3><ul><li><a href="/a">{W}</a></li><li>{S}</li></ul>', '<p>{S}</p><a href="/b">{W}</a>')
    a, b = inner[k % 5], inner[(k + 2) % 5]
    tag, attr = (("div", "class"), ("section", "id"), ("aside", "class"), ("p", "class"))[k % 4 if "<" not in a + b else k % 3]
    box = f'<{tag} {attr}="{other}" data-label="0">'
    root = (f'<div class="{main}"', '<article', f'<article id="{main}"', f'<main class="{main}"')[k % 4]
    close = root[1:].split(" ")[0]
    return (f'{box}{a}</{tag}>{root} data-label="1"><h1>{{S}}</h1><p>{{L}}</p><p>{{S}}</p>{box}{b}</{tag}><p>{{M}}</p></{close}>'
            f'{box}{b}</{tag}><footer>{{S}}</footer>')


_BARE = (
    '<article data-label="1"><h1>{S}</h1><p>{M}</p><form data-label="0"><label>{W}</label></form><p>{S}</p><form class="poll" data-label="0"><p>{S}</p><input>'
    '<label>{W}</label><button>{W}</button></form><p>{M}</p></article>',
    '<article data-label="1"><p>{S}</p><form data-label="0"><fieldset><legend>{W}</legend><label>{S}</label><textarea></textarea></fieldset></form></article>',
    '<article data-label="1"><h1>{W}</h1><p>{S}</p><ul><li>{W}</li><li>{W}</li></ul><p>{W}</p><ol><li>{S}</li><li>{W}</li></ol></article><aside>{S}</aside>',
    '<nav><ul><li><a href="/a">{W}</a></li></ul></nav><article data-label="1"><ul><li>{W}</li><li>{S}</li></ul><h2>{W}</h2><p>{W}</p></article>',
    '<article data-label="1"><h1>{W}</h1><p>{S}</p></article>',
    '<article data-label="1"><p>{W}</p></article><footer>{S}</footer>',
    '<article data-label="1"><h1>{S}</h1><p>{W} <a href="/k">{S}</a></p><p><a href="/l">{W}</a> {S}</p></article><div class="comments"><p>{S}</p></div>',
    '<article data-label="1">{S}</article>',
    '<nav><a href="/a">{W}</a></nav><article data-label="1"><p>{M} <a href="/k">{W}</a> {S}</p><p><i>{W}</i> {S} <b>{W}</b> <a href="/n">{S}</a></p><ul><li><a href="/o">{S}</a> {S}</li></ul></article>',
    '<article data-label="1"><h2>{W}</h2><p><span>{S}</span> <code>{W}</code></p><div><p>{W}</p></div></article><ul class="comments"><li>{S}</li><li>{M}</li></ul>',
)
_RUNS = {"{L}": "word after word of prose in a paragraph that goes on, ends and starts again. " * 5,
         "{M}": "a paragraph of middle length with a few words more than a line holds, and one clause. ",
         "{S}": "a short line of a few words", "{W}": "word"}


def training_pages() -> list[str]:
    out = []
    named = [_named(o, _MAIN[k % len(_MAIN)], k) for k, o in enumerate(_OTHER)]
    whole = [f"{_HEAD}<body>{body}</body></html>" for body in (*_BODIES * 2, *_BARE * 2, *named)]
    for page in (*whole, *_BARE * 2):
        for mark, text in _RUNS.items():
            page = page.replace(mark, text)
        out.append(page)
    return out
