"""Labelled pages for the HTML extractor: random layouts whose article is known.

Every text of an article starts with ``MARK``; the parser's labels come from it.
"""

from __future__ import annotations

import random

MARK = "\ue000"
_PARTS = "an be co da el fi go ha in jo ka li mo na or pe qui ra so ti un va wi zu".split()

#: Words that sites put into class and id, by what they mark (fixed values).
MAIN = "article content post entry main body text story page single news detail".split()
MENU = "nav menu navbar navigation breadcrumb breadcrumbs toolbar tabs pagination pager toc".split()
HEADER = "header masthead top topbar branding banner site logo".split()
FOOTER = "footer bottom colophon copyright legal imprint credits".split()
SIDE = "sidebar side aside widget related recent trending popular tags archive recommended promo teaser more".split()
NOTICE = "cookie cookies consent gdpr notice alert privacy popup modal overlay warning paywall".split()
ADVERT = "ad ads adv advert advertisement advertising sponsor sponsored commercial adsense adbox dfp".split()
FORM = "form newsletter subscribe signup login search contact".split()
COMMENTS = "comments comment replies reply respond discussion disqus thread feedback responses".split()
SHARE = "share social sharing follow buttons".split()


class Writer:
    def __init__(self, seed: int, embedded: bool = False):
        self.r = random.Random(seed)
        #: Embedded elements are drawn apart, so that the other layouts stay as they are.
        self.e = random.Random(f"embedded {seed}")
        self.embed = embedded

    def words(self, low: int, high: int) -> str:
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            out.append("".join(r.choice(_PARTS) for _ in range(r.randint(1, 4))) + (r.random() < 0.08) * ",")
        text = " ".join(out)
        return text[0].upper() + text[1:]

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 25) + self.r.choice([".", ".", ".", "!", "?", ""]) for _ in range(self.r.randint(low, high)))

    def attrs(self, kinds: list[str], chance: float = 0.85) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        name = r.choice(kinds)
        name += r.choice(["", "", "", "-" + r.choice(["wrap", "box", "inner", "area", "list", "1", "block", "container"])])
        name = r.choice(["", "", "", "site-", "page-", "the", "js-"]) + name
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.icon() if self.embed and self.e.random() < 0.1 else ""}{self.words(1, 5)}</a></li>'
                       for i in range(self.r.randint(low, high)))

    def icon(self) -> str:
        return self.e.choice(["<svg class='icon' width=16/>", "<svg class=icon><title>icon</title><path d='M0 0'/></svg>",
                              "<svg viewBox='0 0 1 1'><style/><use href='#x'/></svg>", "<svg><text>ok</text></svg>"])

    def embedded(self) -> str:
        """A piece of an article in an element that embeds something."""
        m = MARK
        word = "".join(self.e.choice(_PARTS) for _ in range(3))
        more = " ".join("".join(self.e.choice(_PARTS) for _ in range(2)) for _ in range(self.e.randint(4, 20)))
        return self.e.choice([
            f"<p>{m}{word} <math><mi>{m}x</mi><mo>{m}=</mo><mn>{m}{self.e.randint(1, 99)}</mn></math> {m}{more}.</p>",
            f"<p>{m}{more} <math/> {m}{word}.</p>", f"<object data='{word}.bin'><p>{m}{more}.</p></object>",
            f"<object data='{word}.bin'>{m}{more}.", f"<canvas id={word}>{m}{more}</canvas>", f"<canvas><p>{m}{more}.</p>"])

    def choice_box(self) -> str:
        options = "".join(f"<option>{''.join(self.e.choice(_PARTS) for _ in range(2))}" for _ in range(self.e.randint(2, 9)))
        return f"<select name=s>{options}" + self.e.choice(["</select>", ""])

    def menu(self) -> str:
        r = self.r
        tag = r.choice(["nav", "nav", "div", "ul"])
        inner = self.links(3, 12)
        return f"<{tag}{self.attrs(MENU, 0.5 if tag == 'nav' else 0.95)}>" + (
            inner if tag == "ul" else f"<ul>{inner}</ul>" if r.random() < 0.8 else inner.replace("li>", "span>")) + f"</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(["header", "header", "div"])
        inner = f"<a href='/'>{self.words(1, 3)}</a>" + self.r.choice(["", f"<p>{self.words(2, 12)}</p>", f"<h1>{self.words(1, 3)}</h1>"])
        return f"<{tag}{self.attrs(HEADER, 0.4 if tag == 'header' else 0.95)}>{inner}{self.r.choice(['', self.menu()])}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(["footer", "footer", "div"])
        inner = self.r.choice(["&copy; ", "", "All rights reserved. "]) + self.words(1, 8) + self.r.choice(
            ["", " &middot; " + self.words(2, 12) + ".", f"<p>{self.sentences(1, 3)}</p>", f"<ul>{self.links(2, 8)}</ul>"])
        return f"<{tag}{self.attrs(FOOTER, 0.4 if tag == 'footer' else 0.95)}>{inner}</{tag}>"

    def boxed(self, kinds: list[str], tags: list[str], plain: float = 0.95) -> str:
        r, tag = self.r, self.r.choice(tags)
        inner = r.choice([self.sentences(1, 4), f"<p>{self.sentences(1, 4)}</p>", f"<h3>{self.words(1, 4)}</h3><p>{self.sentences(1, 3)}</p>",
                          f"<h4>{self.words(1, 3)}</h4><ul>{self.links(2, 8)}</ul>", f"<p>{self.sentences(2, 5)}</p><p>{self.sentences(1, 5)}</p>"])
        return f"<{tag}{self.attrs(kinds, plain)}>{inner}</{tag}>"

    def form(self) -> str:
        box = f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>"
        if self.embed and self.e.random() < 0.3:
            box += self.choice_box()
        return f"<form{self.attrs(FORM, 0.6)}>{self.r.choice(['', f'<p>{self.sentences(1, 3)}</p>'])}{box}</form>"

    def comments(self) -> str:
        r = self.r
        tag, item = r.choice(["section", "div", "ol", "div"]), r.choice(["div", "li", "article", "p"])
        one = lambda: f"<{item}{self.attrs(COMMENTS, 0.6)}>" + r.choice(
            [f"<b>{self.words(1, 2)}</b> {self.sentences(1, 6)}", f"<p>{self.words(1, 3)}</p><p>{self.sentences(1, 8)}</p>", self.sentences(1, 5)]) + f"</{item}>"
        return f"<{tag}{self.attrs(COMMENTS, 1.0)}>{r.choice(['', f'<h3>{self.words(1, 3)}</h3>'])}" + "".join(
            one() for _ in range(r.randint(1, 8))) + r.choice(["", self.form()]) + f"</{tag}>"

    def article(self) -> str:
        r, m = self.r, MARK
        style = r.choice(["p", "p", "p", "p", "open", "div", "br"])
        out = []
        if r.random() < 0.85:
            title = f"<h1>{m}{self.words(2, 12)}</h1>"
            out.append(r.choice([title, title, f"<header>{title}</header>"]))
        for _ in range(r.choice([1, 2, 3, r.randint(3, 25)])):
            text = m + self.sentences(1, r.choice([1, 3, 8]))
            kind = r.random()
            if kind < 0.1:
                text = f"{m}{self.words(1, 10)} <a href='x'>{m}{self.words(1, 4)}</a> {m}{self.sentences(1, 3)}"
            elif kind < 0.2:
                text = f"<{'b' if kind < .15 else 'em'}>{text}</{'b' if kind < .15 else 'em'}>"
            if kind > 0.95:
                out.append(r.choice([f"<h2>{m}{self.words(1, 8)}</h2>", f"<ul>{''.join(f'<li>{m}{self.words(2, 15)}</li>' for _ in range(r.randint(2, 6)))}</ul>",
                                     f"<blockquote>{text}</blockquote>", f"<table><tr><td>{m}{self.words(1, 4)}</td><td>{m}{self.words(1, 4)}</td></tr></table>",
                                     f"<figure><img src=x><figcaption>{m}{self.words(2, 10)}</figcaption></figure>", f"<pre>{text}</pre>",
                                     self.boxed(ADVERT, ["div", "aside"]), self.boxed(SIDE, ["aside", "div"]), f"<div{self.attrs(SHARE, 1)}>{self.words(1, 3)}</div>"]))
            elif style == "open" or kind > 0.9:
                out.append(r.choice([f"<p>{text}", f"<p><b>{text}<br>"]))
            else:
                out.append({"p": f"<p>{text}</p>", "div": f"<div>{text}</div>", "br": f"{text}<br><br>"}.get(style, f"<p>{text}"))
        for k in range(len(out) - 1, -1, -1):
            if self.embed and self.e.random() < 0.06:
                out.insert(k + 1, self.embedded() if self.e.random() < 0.7 else f"<p>{m}{self.e.choice(_PARTS)} {self.icon()}{m}{self.e.choice(_PARTS)}.</p>")
        return "".join(out)

    def page(self) -> str:
        r = self.r
        tag = r.choice(["article", "article", "main", "section", "div", "div"])
        art = f"<{tag}{self.attrs(MAIN, 0.35 if tag in ('article', 'main') else 0.9)}>{self.article()}"
        inside = r.random() < 0.25
        extra = [r.choice(["", "", self.comments()]), r.choice(["", "", self.boxed(SIDE, ["aside", "div", "section"])]),
                 r.choice(["", "", self.form()]), r.choice(["", "", "", f"<div{self.attrs(SHARE, 1)}><a href=x>{self.words(1, 2)}</a></div>"])]
        art = art + "".join(extra) + f"</{tag}>" if inside else art + f"</{tag}>" + "".join(extra)
        for _ in range(r.choice([0, 0, 1, 2])):
            art = f"<div{self.attrs(MAIN + ['wrapper', 'container', 'row', 'col', 'layout'], 0.7)}>{art}</div>"
        before = [self.header() if r.random() < 0.5 else "", self.menu() if r.random() < 0.8 else "",
                  self.boxed(NOTICE, ["div", "section", "aside"]) if r.random() < 0.35 else "",
                  self.boxed(ADVERT, ["div", "aside", "section", "ins"]) if r.random() < 0.5 else "",
                  self.boxed(SIDE, ["aside", "div"]) if r.random() < 0.2 else "", self.form() if r.random() < 0.15 else ""]
        r.shuffle(before)
        after = [self.boxed(SIDE, ["aside", "div", "section"]) if r.random() < 0.4 else "", self.boxed(ADVERT, ["div", "aside"]) if r.random() < 0.3 else "",
                 self.form() if r.random() < 0.15 else "", self.boxed(NOTICE, ["div", "aside"]) if r.random() < 0.2 else ""]
        r.shuffle(after)
        body = "".join(before) + art + "".join(after) + (self.footer() if r.random() < 0.85 else "")
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{}}</style><script>var a='</p>';</script></head>"
        page = f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"
        return page[:int(len(page) * r.uniform(0.5, 1))] if r.random() < 0.08 else page


def training_pages(n: int, embedded: int = 0) -> list[str]:
    """``n`` pages, and ``embedded`` more with icons, formulas, objects, canvases and selects."""
    return [Writer(seed).page() for seed in range(n)] + [Writer(seed, True).page() for seed in range(n, n + embedded)]
