"""A small document tree for stored pages, and the extraction of messages from it.

Layout is not stored, so an element counts as visible unless it or an ancestor has the attribute `hidden` or an inline
`display:none`.  A new block closes an open paragraph with its inline children; items, cells, rows and options close what
they imply.  Nothing here recurses, so nesting of any depth is read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

# Element classes and patterns of the extraction rules.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: By start tag: the open elements it closes, up to an element of the second set.
IMPLIED = {
    "li": (("li",), {"ul", "ol"}),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), {"dl"})),
    **dict.fromkeys(("td", "th"), (("td", "th"), {"tr", "table"})),
    "tr": (("tr",), {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot"), {"table"})),
    "option": (("option",), {"optgroup", "select", "datalist"}),
    "optgroup": (("optgroup", "option"), {"select"}),
}
BLOCKS = set("address article aside blockquote body div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table ul".split())
SILENT = set("button svg img input nav aside header footer script style".split())
ZONE_TAGS = {"nav", "aside", "header", "footer"}
ZONE_ROLES = {"navigation", "complementary", "banner", "contentinfo", "menubar"}
ZONE_NAMES = re.compile(r"sidebar|history|menu|drawer|panel|nav[-_]", re.I)
GEMINI = "[data-message-author-role], user-query, model-response, [class*=user-query], [class*=model-response]"
SITES = (
    ("chatgpt.com", "main", "[data-message-author-role]", "data-message-author-role"),
    ("chat.openai.com", "main", "[data-message-author-role]", "data-message-author-role"),
    ("claude.ai", ".flex-1.overflow-y-auto, main", "[data-is-streaming], .font-claude-message, .font-user-message", None),
)


class Element:
    __slots__ = ("attrs", "hidden", "nodes", "parent", "tag", "zone")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.nodes = tag, attrs, parent, []
        bare = re.sub(r"\s", "", attrs.get("style", "").lower())
        self.hidden = bool(parent and parent.hidden) or "hidden" in attrs or "display:none" in bare
        own = tag in ZONE_TAGS or attrs.get("role") in ZONE_ROLES or bool(ZONE_NAMES.search(f"{attrs.get('id', '')} {attrs.get('class', '')}"))
        # flags go down with the walk, so no ancestor is visited twice; body and what lies above it never count
        self.zone = tag not in ("html", "body") and (own or bool(parent and parent.zone))

    @property
    def children(self) -> list[Element]:
        return [n for n in self.nodes if isinstance(n, Element)]

    def text(self) -> str:
        parts, left = [], [self]
        while left:
            n = left.pop()
            if isinstance(n, str):
                parts.append(n)
            else:
                left += reversed(n.nodes)
        return "".join(parts)

    def walk(self):
        left = self.children[::-1]
        while left:
            child = left.pop()
            yield child
            left += reversed(child.children)

    def matches(self, selector: str) -> bool:
        return any(all(self._simple(p) for p in re.findall(r"\[[^\]]*\]|\.[\w-]+|^[\w-]+", one)) for one in map(str.strip, selector.split(",")))

    def _simple(self, part: str) -> bool:
        if part[0] == ".":
            return part[1:] in self.attrs.get("class", "").split()
        if part[0] == "[":
            name, like, value = part[1:-1].partition("*=")
            return value in self.attrs.get(name, "") if like else name in self.attrs
        return self.tag == part

    def first(self, selector: str) -> Element | None:
        return next((e for e in self.walk() if e.matches(selector)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Element("#document", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close("p")
        names, stop = IMPLIED.get(tag, ((), frozenset()))
        for name in names:
            self._close(name, stop)
        made = Element(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.nodes.append(made)
        if tag not in VOID:
            self.open = made

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(tag)

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.open.nodes.append(data)

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # an unknown keyword; to browsers, a comment
            return self.parse_bogus_comment(i)

    def _close(self, tag, stop=frozenset()):
        at = self.open
        while at.parent is not None:
            if at.tag == tag:
                self.open = at.parent
                return
            if at.tag in stop or (tag == "p" and at.tag in BLOCKS):
                return
            at = at.parent


def parse(html: str) -> Element:
    builder = _Builder()
    # int() refuses numbers of thousands of digits; this one too stands for no character
    builder.feed(re.sub(r"&#\d{4000,}", "&#9999999", html or ""))
    builder.close()
    return builder.root


def _inside(e: Element, base: str):
    parts = []
    for n in e.nodes:
        parts.append(n if isinstance(n, str) else (yield _markdown(n, base)))
    return "".join(parts)


def _listed(e: Element, base: str, mark):
    parts = []
    for i, c in enumerate(c for c in e.children if c.tag == "li"):
        parts.append(mark(i) + (yield _inside(c, base)).strip())
    return "\n".join(parts) + "\n\n"


def _absolute(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:  # no address: as it stands
        return href


def _markdown(e: Element, base: str):
    tag = e.tag
    if tag in SILENT or e.hidden:
        return ""
    if tag == "pre":
        code = e.first("code")
        named = re.search(r"(?:language-|lang-)(\w+)", code.attrs.get("class", "")) if code else None
        return f"\n```{named[1] if named else ''}\n{(code or e).text()}\n```\n"
    if tag == "a":
        target = _absolute(base, e.attrs["href"]) if "href" in e.attrs else ""
        return f"[{e.text()}]({target})"
    if re.fullmatch("h[1-6]", tag):
        return "#" * int(tag[1]) + " " + e.text().strip() + "\n\n"
    if tag in ("ul", "ol"):
        return (yield _listed(e, base, (lambda i: "- ") if tag == "ul" else (lambda i: f"{i + 1}. ")))
    if tag == "code":
        return f"`{e.text()}`"
    if tag == "blockquote":
        return "> " + (yield _inside(e, base)).strip() + "\n\n"
    if tag == "br":
        return "\n"
    before, after = {"strong": ("**", "**"), "b": ("**", "**"), "em": ("*", "*"), "i": ("*", "*"), "p": ("", "\n\n")}.get(tag, ("", ""))
    return before + (yield _inside(e, base)) + after


def _finished(job) -> str:
    """The result of a job that yields the jobs whose results it waits for, on a stack of its own."""
    jobs, told = [job], None
    while jobs:
        try:
            jobs.append(jobs[-1].send(told))
            told = None
        except StopIteration as done:
            jobs.pop()
            told = done.value
    return told


def markdown_of(e: Element, base: str) -> str:
    return _finished(_markdown(e, base))


def html_to_markdown(html: str, base: str) -> str:
    return _finished(_inside(parse(html), base)).strip()


def role_of(e: Element, index: int, attribute: str | None) -> str:
    near = [x for x in (e, e.parent, e.parent and e.parent.parent) if x is not None]

    def judged(value: str, *others: str) -> str | None:
        low = value.lower()
        if "user" in low or "human" in low:
            return "user"
        return "assistant" if any(o in low for o in others) else None

    named = (judged(x.attrs.get(attribute, ""), "assistant", "model", "bot", "system") for x in near) if attribute else ()
    any_ = (judged(v, "assistant", "model", "bot") for x in near for v in x.attrs.values())
    return next((r for part in (named, any_) for r in part if r), "user" if index % 2 == 0 else "assistant")


def _told(blocks: list[Element], base: str, attribute: str | None) -> list[tuple[str, str]]:
    made = [(role_of(b, i, attribute), markdown_of(b, base).strip()) for i, b in enumerate(blocks)]
    return [m for m in made if m[1]]


def _turns(root: Element) -> list[Element]:
    articles = [e for e in root.walk() if e.tag == "article" and not e.zone]
    if len(articles) >= 2:
        return articles
    best, top, level = [], 0, [root]
    for _ in range(8):
        for parent in level:
            kids = [c for c in parent.children if not c.hidden and not c.zone and len(c.text().strip()) > 20]
            score = len(kids) * (2 if len({c.tag for c in kids}) == 1 else 1)
            if len(kids) >= 2 and score > top:
                best, top = kids, score
        level = [c for parent in level for c in parent.children if c.children]
    return best


def page_messages(url: str, html: str) -> list[tuple[str, str, str]]:
    """(role, content, method) of a page: the chat site's own marks, else the best row of like blocks."""
    try:
        host = (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        host = ""
    root = parse(html)
    if "gemini.google.com" in host:
        found = []
        for e in root.walk():
            if e.matches(GEMINI) and (content := e.text().strip()):
                user = e.tag == "user-query" or e.attrs.get("data-message-author-role") == "user"
                found.append(("user" if user else "assistant", content, "gemini"))
        return found
    for domain, container, block, attribute in SITES:
        if domain in host:
            if (within := root.first(container)) is not None:
                blocks = [e for e in within.walk() if e.matches(block) and not e.hidden and not e.zone and len(e.text().strip()) > 10]
                told = _told(blocks, url, attribute) if len(blocks) >= 2 else []
                if len(told) >= 2:
                    return [(*m, "config") for m in told]
            break
    main = root.first("main")
    body = main if main is not None and not main.zone else root.first("body") or root
    return [(*m, "heuristic") for m in _told(_turns(body), url, None)]
