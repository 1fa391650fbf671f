"""A small HTML tree: elements and text runs in page order, as parallel lists."""

from __future__ import annotations

import re
from html import unescape

#: Elements without content, elements whose content is no text of the page (those of ``CLOSED`` only
#: where they are closed), those in which any element may close itself, and block elements (fixed
#: values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe".split())
CLOSED = frozenset("template textarea title iframe".split())
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset("""address article aside blockquote body br center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre
search section summary table tbody td tfoot th thead tr ul""".split())
_CLOSES_P = BLOCK - frozenset("body br html td th tr tbody thead tfoot li dd dt legend summary".split())
_SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
         "tr": ("tr td th", ("table",)), "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")),
         "option": ("option", ("select",))}
_SAME = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in _SAME.items()}
_PARAGRAPH = (frozenset(("p",)), frozenset("table td th div article section button".split()))
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"""
                    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))|([^<]+|<)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label|itemtype)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


class Page:
    """tag ('' for a text run), text, parent, end (one past the subtree), depth, nth child and
    words of the attributes, per node; node 0 is the page."""

    __slots__ = ("tag", "text", "parent", "end", "depth", "nth", "words")

    def __init__(self, html: str | None):
        self.tag, self.text, self.parent, self.end = ["#page"], [""], [-1], [0]
        self.depth, self.nth, self.words = [0], [0], [()]
        self._parse(html or "")

    def _add(self, stack, children, tag, text, words):
        i, up = len(self.tag), stack[-1]
        self.tag.append(tag)
        self.text.append(text)
        self.parent.append(up)
        self.end.append(i + 1)
        self.depth.append(len(stack))
        self.nth.append(children[-1])
        self.words.append(words)
        children[-1] += 1
        return i

    def _parse(self, html):
        stack, children, tags, at, n = [0], [0], self.tag, 0, len(html)
        places: dict[str, list[int]] = {}  # of open elements in the stack, by name
        unclosed = set()  # raw elements without any end tag from here on

        def close(k):  # every open element from place k of the stack on
            while len(stack) > k:
                i = stack.pop()
                self.end[i] = len(tags)
                children.pop()
                if stack:
                    places[tags[i]].pop()

        def last(names):
            return max((places[x][-1] for x in names if places.get(x)), default=0)

        while at < n:
            m = _TOKEN.match(html, at)
            at = m.end()
            slash, name, attrs, text = m.groups()
            if text is not None:
                if text.isspace():
                    if len(stack) > 1 or len(tags) > 1:
                        self._add(stack, children, "", " ", ())
                else:
                    self._add(stack, children, "", unescape(text), ())
                continue
            if name is None:
                continue
            name = name.lower()
            if slash:
                if places.get(name):
                    close(places[name][-1])
                continue
            closes, within = (_PARAGRAPH if name in _CLOSES_P else _SAME.get(name, ((), ())))
            if (k := last(closes)) > last(within):
                close(k)
            words = tuple(w.lower() for _, v in _ATTR.findall(attrs) for w in _PART.findall(v)) if "=" in attrs else ()
            i = self._add(stack, children, name, "", words)
            if name in RAW and not (attrs.endswith("/>") and (name in CLOSED or last(FOREIGN))):
                end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
                if end:
                    at = end.end()
                    continue
                unclosed.add(name)
                if name not in CLOSED:  # a script or style without an end is the rest of the page
                    break
            elif name not in VOID and not attrs.endswith("/>"):
                places.setdefault(name, []).append(len(stack))
                stack.append(i)
                children.append(0)
        close(0)

    def render(self, kept) -> str:
        """The kept text runs: white space made one space, block elements apart."""
        out, ends = [], []
        for i, tag in enumerate(self.tag):
            while ends and ends[-1] <= i:
                out.append("\n")
                ends.pop()
            if tag == "":
                if kept[i]:
                    out.append(self.text[i])
            elif tag in BLOCK:
                out.append("\n")
                ends.append(self.end[i])
        return " ".join("".join(out).split())
