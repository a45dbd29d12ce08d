"""HTML to Markdown: boilerplate dropped, main content found, headings, lists, tables of code and emphasis kept. One parser pass per page."""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Elements, roles and classes that hold no content, places of the main content, and elements without an end tag.
DROPPED = {"script", "style", "noscript", "iframe", "nav", "footer", "header", "aside", "form", "button", "input", "select", "textarea", "svg"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search"}
CLASSES = {"sidebar", "nav", "navbar", "menu", "footer", "header", "advertisement", "ads", "cookie-banner", "cookie-notice", "newsletter", "social-share", "comments", "related-posts"}
MAIN_CLASSES = ("content", "post", "entry", "article-body", "post-content")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("p div section article main ul ol table tr blockquote pre h1 h2 h3 h4 h5 h6 body html dl dt dd figure".split())
LEAST_MAIN = 50


class _Reader(HTMLParser):
    """Collects Markdown of the whole body and of each candidate for the main content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.stack: list[tuple[str, bool, str]] = []  # element, whether it is dropped, what closes it
        self.dropped = 0
        self.lists: list[int] = []  # -1 for bullets, else the number reached
        self.code = 0
        self.spans: dict[str, list[tuple[int, int]]] = {}
        self.open: list[tuple[int, str, int]] = []  # depth, candidate, place in out

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        classes = set(attrs.get("class", "").lower().split())
        drop = tag in DROPPED or attrs.get("role", "").lower() in ROLES or bool(classes & CLASSES)
        if tag in VOID:
            if not self.dropped and tag in ("br", "hr"):
                self.out.append("\n" if tag == "br" else "\n\n---\n\n")
            return
        self.dropped += drop
        close = ""
        if not self.dropped:
            for name in self._candidates(tag, attrs, classes):
                self.open.append((len(self.stack), name, len(self.out)))
            close = self._start(tag, classes)
        self.stack.append((tag, drop, close))

    @staticmethod
    def _candidates(tag, attrs, classes):
        if tag in ("main", "article", "body"):
            yield tag
        if attrs.get("role", "").lower() == "main":
            yield "role"
        for c in MAIN_CLASSES:
            if c in classes:
                yield "." + c

    def _start(self, tag, classes) -> str:
        put = self.out.append
        if re.fullmatch("h[1-6]", tag):
            put("\n\n" + "#" * int(tag[1]) + " ")
            return "\n\n"
        if tag in ("ul", "ol"):
            self.lists.append(-1 if tag == "ul" else 0)
            put("\n")
            return "\n"
        if tag == "li":
            number = self.lists[-1] if self.lists else -1
            if number >= 0:
                self.lists[-1] = number = number + 1
            put("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if number < 0 else f"{number}. "))
            return ""
        if tag == "pre":
            self.code += 1
            language = next((c.removeprefix("language-") for c in classes if c.startswith("language-")), "")
            put(f"\n\n```{language}\n")
            return "\n```\n\n"
        if self.code:
            return ""
        mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}.get(tag)
        if mark:
            put(mark)
            return mark
        if tag in ("td", "th"):
            return " | "
        if tag in BLOCK:
            put("\n" if tag == "tr" else "\n\n")
            return "\n" if tag == "tr" else "\n\n"
        return ""

    def handle_endtag(self, tag):
        if tag in VOID or not any(t == tag for t, _, _ in self.stack):
            return
        while self.stack:
            name, drop, close = self.stack.pop()
            if close and not self.dropped:
                self.out.append(close)
            self.dropped -= drop
            if name in ("ul", "ol") and not self.dropped and self.lists:
                self.lists.pop()
            if name == "pre" and not self.dropped:
                self.code = max(0, self.code - 1)
            while self.open and self.open[-1][0] >= len(self.stack):
                _, candidate, start = self.open.pop()
                self.spans.setdefault(candidate, []).append((start, len(self.out)))
            if name == tag:
                break

    def handle_data(self, data):
        if not self.dropped:
            self.out.append(data if self.code else re.sub(r"\s+", " ", data))


def tidy(markdown: str) -> str:
    """No blanks around lines, no empty emphasis, one blank line at most."""
    out, code = [], False
    for line in markdown.split("\n"):
        fence = line.startswith("```")
        out.append(line.rstrip() if code or fence else re.sub(r"\*\*\s*\*\*|``", "", line).rstrip().lstrip(" ") if not re.match(r" *(-|\d+\.) ", line) else line.rstrip())
        code ^= fence
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def markdown(html: str | None) -> tuple[str, bool]:
    """The main content as Markdown, and whether the page marks one. Broken markup is read as far as it goes."""
    if not html:
        return "", False
    reader = _Reader()
    reader.feed(html)
    reader.close()
    while reader.stack:
        reader.handle_endtag(reader.stack[-1][0])
    for name in ("main", "article", "role", *("." + c for c in MAIN_CLASSES)):
        for start, end in sorted(reader.spans.get(name, [])):
            text = tidy("".join(reader.out[start:end]))
            if len(text) > (LEAST_MAIN if name.startswith(".") else 0):
                return text, True
    spans = reader.spans.get("body")
    return tidy("".join(reader.out[spans[0][0] : spans[0][1]] if spans else reader.out)), False
