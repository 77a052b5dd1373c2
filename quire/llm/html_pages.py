"""Labelled pages for training: generated layouts whose article text is known.

A page is a random arrangement of page furniture around (and sometimes inside)
an article, in semantic or in class-named markup, tidy or with missing end tags.
"""

from __future__ import annotations

import random

#: Marks article text; from a private-use area, removed when the labels are read.
MARK = ""

_SYLLABLES = "the an er on re en tion st ou th it is at ha ing le de que eau vi pa ai ch ein sch ung ver keit los as ra ción co do ue".split()
#: Words that name furniture in classes and ids, by kind.
NAMES = {
    "menu": "nav navbar navigation menu main-menu top-nav breadcrumb breadcrumbs pagination pager toolbar tabs skip-links".split(),
    "header": "header site-header masthead page-header top-bar topbar branding logo".split(),
    "footer": "footer site-footer page-footer bottom copyright colophon legal".split(),
    "sidebar": "sidebar side aside widget widgets right-column left-column rail secondary toc".split(),
    "notice": "cookie cookies cookie-banner consent notice alert banner popup modal gdpr overlay message warning paywall disclaimer".split(),
    "ad": "ad ads advert advertisement adbox ad-slot sponsored sponsor promo promotion adsbygoogle banner-ad teaser".split(),
    "form": "form search search-form login signup subscribe newsletter contact-form poll".split(),
    "comments": "comments comment comment-list commentlist discussion replies reply responses disqus feedback reviews".split(),
    "related": "related related-posts recommended recommendations more-stories read-more popular trending share sharing social social-links tags".split(),
}
CONTENT_NAMES = "article article-body content main-content post post-content entry entry-content story story-body text body-text page-content page-body blog-post prose".split()
NEUTRAL = "container wrapper wrap row col-md-8 col-12 clearfix inner box grid section block page layout outer flex".split()
TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "notice": "div", "ad": "div", "form": "form", "comments": "section", "related": "div"}


class Generator:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        style = r.random()
        out = []
        for _ in range(r.randint(low, high)):
            w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
            if style < 0.04:
                w = w.upper() + r.choice(["", "!!"])
            elif style < 0.08:
                w += r.choice(["***", "$$$", "###", "%%%", "&amp;&amp;"])
            elif style < 0.1:
                w += " |"
            elif style < 0.12 and out:
                w = out[0]
            out.append(w)
        return " ".join(out)

    def sentence(self, low: int = 3, high: int = 18) -> str:
        s = self.words(low, high)
        return s[:1].upper() + s[1:] + self.r.choice(".....!?:")

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def attribute(self, names: list[str]) -> str:
        r = self.r
        name = r.choice(names)
        if r.random() < 0.3:
            name = r.choice([name.replace("-", "_"), name.title().replace("-", ""), f"{name}-{r.randint(1, 99)}", f"site-{name}", f"{name}-wrapper", f"{name}s"])
        if r.random() < 0.3:
            name += " " + r.choice(NEUTRAL)
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def wrap(self, kind: str, inner: str) -> str:
        r = self.r
        if kind in ("ad", "notice", "related") or r.random() < 0.45:
            tag = r.choice(["div", "div", "div", "section", "ul" if inner.startswith("<li") else "div"])
            return f"<{tag}{self.attribute(NAMES[kind])}>{inner}</{tag}>"
        tag = TAGS[kind]
        return f"<{tag}{self.attribute(NAMES[kind]) if r.random() < 0.4 else ''}>{inner}</{tag}>"

    def links(self, low: int = 2, high: int = 8) -> str:
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def furniture(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            inner = self.links()
        elif kind == "header":
            inner = r.choice(["", f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 4)}</div>", f"<p>{self.sentence()}</p>"]) + r.choice(["", self.links(), f"<p>{self.words(2, 6)}</p>"])
            inner = inner or self.words(1, 3)
        elif kind == "footer":
            inner = r.choice(["&copy; ", "© ", "Copyright ", ""]) + self.words(1, 3) + r.choice([" &middot; ", " ", " - "]) + self.sentences(1, 3)
            inner = r.choice([inner, f"<p>{inner}</p>", f"<p>{inner}</p>{self.links(2, 4)}"])
        elif kind == "sidebar":
            inner = f"<h{r.randint(2, 4)}>{self.words(1, 4)}</h4>" + r.choice([self.links(), f"<p>{self.sentences(1, 4)}</p>", f"<p>{self.sentence()}</p>{self.links()}"])
        elif kind == "notice":
            inner = r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 3)}</p>", f"<p>{self.sentences(1, 2)}</p><button>{self.words(1, 2)}</button>"])
        elif kind == "ad":
            inner = r.choice([self.sentences(1, 2), self.words(2, 8), f"<p>{self.sentences(1, 2)}</p>", f'<a href="/x">{self.words(2, 8)}</a>', f"<h3>{self.words(2, 5)}</h3><p>{self.sentence()}</p>"])
        elif kind == "form":
            inner = r.choice(["", f"<h3>{self.words(1, 4)}</h3>", f"<p>{self.sentence()}</p>"]) + f"<label>{self.words(1, 3)}</label><input name=q>" + r.choice(
                ["", f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>", f"<textarea>{self.words(1, 4)}</textarea>"]
            ) + f"<button>{self.words(1, 2)}</button>"
        elif kind == "comments":
            one = lambda: r.choice(["<div class=\"comment\"><p>{}</p></div>", "<li><b>{1}</b><p>{0}</p></li>", "<p>{}</p>", "<div class=\"reply\">{}</div>", "<article class=\"comment\"><p>{}</p></article>"]).format(self.sentences(1, 5), self.words(1, 2))
            inner = r.choice(["", f"<h2>{self.words(1, 3)}</h2>"]) + "".join(one() for _ in range(r.randint(1, 6)))
        else:
            inner = r.choice(["", f"<h3>{self.words(1, 4)}</h3>"]) + self.links(2, 6)
        return self.wrap(kind, inner)

    def mark(self, text: str) -> str:
        return MARK + text

    def body_block(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.68:
            t = self.sentences(1, 9)
            if r.random() < 0.25:
                t += f' <a href="/y">{self.words(1, 5)}</a> {self.sentence()}'
            if r.random() < 0.25:
                t = r.choice([self.words(1, 5), self.sentence(1, 4)])
            if r.random() < 0.2:
                return f"<p><b>{self.mark(t)}<br>" + r.choice(["", "</p>"])
            if r.random() < 0.1:
                return f"<div>{self.mark(t)}</div>"
            return f"<p>{self.mark(t)}" + ("</p>" if r.random() < 0.9 else "")
        if x < 0.78:
            return f"<h{r.randint(2, 4)}>{self.mark(self.words(1, 7))}</h{r.randint(2, 4)}>"
        if x < 0.88:
            return "<ul>" + "".join(f"<li>{self.mark(self.words(2, 14))}" + r.choice(["", "</li>"]) for _ in range(r.randint(2, 5))) + "</ul>"
        if x < 0.93:
            return f"<blockquote><p>{self.mark(self.sentences(1, 3))}</p></blockquote>"
        if x < 0.96:
            return f"<pre>{self.mark(self.words(4, 20))}</pre>"
        return "<table>" + "".join("<tr>" + "".join(f"<td>{self.mark(self.words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>"

    def article(self) -> str:
        r = self.r
        head = f"<h1>{self.mark(self.words(2, 12))}</h1>"
        if r.random() < 0.15:
            head = f"<header>{head}</header>"
        parts = [head] if r.random() < 0.9 else []
        for _ in range(r.choice([1, 2, 3, 4, 6, 8, 12])):
            parts.append(self.body_block())
            if r.random() < 0.12:
                parts.append(self.furniture(r.choice(["ad", "ad", "related", "form", "notice", "sidebar"])))
        if r.random() < 0.12:
            parts.append(self.furniture(r.choice(["comments", "related", "form"])))
        inner = "".join(parts)
        x = r.random()
        if x < 0.5:
            return f"<article{self.attribute(CONTENT_NAMES) if r.random() < 0.3 else ''}>{inner}</article>"
        if x < 0.6:
            return f"<main>{inner}</main>"
        if x < 0.9:
            tag = r.choice(["div", "div", "section"])
            return f"<{tag}{self.attribute(CONTENT_NAMES)}>{inner}</{tag}>"
        if x < 0.95:
            return f"<div{self.attribute(NEUTRAL)}>{inner}</div>"
        return inner

    def page(self) -> str:
        r = self.r
        before = [k for k in ("notice", "header", "menu", "ad", "form", "sidebar") if r.random() < 0.45]
        after = [k for k in ("related", "comments", "sidebar", "ad", "form", "menu", "footer", "notice") if r.random() < 0.45]
        middle = self.article()
        if r.random() < 0.3:
            middle = f"<div{self.attribute(NEUTRAL)}>{middle}{self.furniture('sidebar') if r.random() < 0.4 else ''}</div>"
        body = "".join(self.furniture(k) for k in before) + middle + "".join(self.furniture(k) for k in after)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int = 0) -> list[str]:
    """n pages whose article blocks hold MARK."""
    g = Generator(seed)
    return [g.page() for _ in range(n)]
