"""A small document tree for HTML, built and walked without recursion into Spark: plain functions of strings and nodes."""

import re
from collections.abc import Generator
from html.parser import HTMLParser
from urllib.parse import urljoin

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Start tags that close an open element of these kinds, up to a boundary.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
BOUNDARY = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
BLOCK = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HIDDEN = frozenset("script style template noscript head title meta link".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None" = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def elements(self):
        """This node and all below, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, hidden: bool = False) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif hidden or node is self or node.tag not in HIDDEN:
                todo.extend(reversed(node.children))
        return "".join(out)

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace(self, *new) -> None:
        siblings = self.parent.children
        at = next(i for i, c in enumerate(siblings) if c is self)
        for n in new:
            if isinstance(n, Node):
                n.parent = self.parent
        siblings[at : at + 1] = new
        self.parent = None

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {})

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._close(("p",), ("body", "article", "section", "div", "td", "li", "blockquote"))
        if tag in CLOSES:
            self._close(CLOSES[tag], BOUNDARY[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tags, boundary):
        node, last = self.at, None
        while node.parent is not None and node.tag not in boundary:
            if node.tag in tags:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed((html or "").replace("\0", "\ufffd"))
    builder.close()
    return builder.root


class _Counter(HTMLParser):
    """Depth, elements and attributes of markup without building a tree."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.children = [0]
        self.depth = self.elements = self.depth_sum = self.texts = self.most_children = self.attributes = self.most_attributes = 0

    def handle_starttag(self, tag, attrs):
        self.elements += 1
        self.depth_sum += len(self.open) + 1
        self.depth = max(self.depth, len(self.open) + 1)
        self.attributes += len(attrs)
        self.most_attributes = max(self.most_attributes, len(attrs))
        self._child()
        if tag not in VOID:
            self.open.append(tag)
            self.children.append(0)

    def handle_endtag(self, tag):
        if tag in self.open[-64:]:
            while self.open.pop() != tag:
                self.children.pop()
            self.children.pop()

    def handle_data(self, data):
        self.texts += 1
        self._child()

    def _child(self):
        self.children[-1] += 1
        self.most_children = max(self.most_children, self.children[-1])


STATS = ("depth", "elements", "depth_sum", "texts", "most_children", "attributes", "most_attributes")


def markup_stats(html: str | None) -> dict[str, int]:
    counter = _Counter()
    counter.feed(html or "")
    counter.close()
    return {k: getattr(counter, k) for k in STATS}


# Selectors: tag, #id, .class, [attr], [attr="v"] with *= ^= $= ~= and the i flag, descendants, children, comma lists.
STEP = re.compile(r"""\s*(>)?\s*((?:[a-zA-Z][\w-]*|\*)?(?:\#[\w-]+|\.[\w-]+|\[[\w-]+(?:[*^$~]?=(?:"[^"]*"|'[^']*'|[^\]\s]+)(?:\s+i)?)?\])*)""")
PIECE = re.compile(r"""\#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^$~]?=)("[^"]*"|'[^']*'|[^\]\s]+)(\s+i)?)?\]""")


def compile_selector(selector: str) -> list[list[tuple[bool, str, list[tuple]]]] | None:
    """Alternatives of steps (child, tag, tests); None if it is not valid."""
    out = []
    for one in selector.split(","):
        steps, at, one = [], 0, one.strip()
        while at < len(one):
            m = STEP.match(one, at)
            if not m or not m[2]:
                return None
            tag = re.match(r"[a-zA-Z][\w-]*|\*|", m[2])[0]
            steps.append((bool(m[1]), tag.lower(), [p.groups() for p in PIECE.finditer(m[2])]))
            at = m.end()
        if not steps:
            return None
        out.append(steps)
    return out


def _fits(node: Node, tag: str, tests: list[tuple]) -> bool:
    if tag not in ("", "*", node.tag) or node.tag == "#document":
        return False
    for ident, cls, attr, op, value, flag in tests:
        if ident and node.attrs.get("id") != ident or cls and cls not in node.classes:
            return False
        if attr:
            have = node.attrs.get(attr.lower())
            if have is None:
                return False
            if op:
                want = value.strip("\"'")
                if flag:
                    have, want = have.lower(), want.lower()
                if not {"=": have == want, "*=": want in have, "^=": have.startswith(want), "$=": have.endswith(want), "~=": want in have.split()}[op]:
                    return False
    return True


def matches(node: Node, steps) -> bool:
    child, tag, tests = steps[-1]
    if not _fits(node, tag, tests):
        return False
    at, todo = node, list(steps[:-1])
    while todo:
        _, tag, tests = todo[-1]
        at = at.parent
        if child:
            if at is None or not _fits(at, tag, tests):
                return False
        else:
            while at is not None and not _fits(at, tag, tests):
                at = at.parent
            if at is None:
                return False
        child = todo.pop()[0]
    return True


def select(root: Node, selector: str) -> list[Node]:
    compiled = compile_selector(selector)
    return [n for n in root.elements() if any(matches(n, s) for s in compiled)] if compiled else []


def first(root: Node, selector: str) -> Node | None:
    return next(iter(select(root, selector)), None)


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


#: Parts of a page that are not content, a list of this library's own.
BOILERPLATE = ("nav", "header", "footer", "aside", "form", "iframe", "script", "style", "noscript", "template", "meta", "link", "button", "svg", '[role="navigation"]', '[role="banner"]', '[role="contentinfo"]', '[role="complementary"]', '[class*="cookie" i]', '[id*="cookie" i]', '[class*="share" i]', '[class*="related" i]', '[class~="ad"]', '[class*="newsletter" i]')
UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)


def clean(root: Node, extra: list[str] | tuple[str, ...] = ()) -> Node:
    """Without boilerplate and pixel images; read-only inputs become code, leading checkboxes `[x]` or `[ ]`."""
    compiled = [c for s in (*BOILERPLATE, *extra) if (c := compile_selector(s))]
    for node in list(root.elements()):
        if any(matches(node, s) for c in compiled for s in c):
            node.drop()
    for node in list(root.elements()):
        if node.tag == "input" and node.parent is not None:
            if node.attrs.get("type", "").lower() == "checkbox":
                node.replace("[x] " if "checked" in node.attrs else "[ ] ")
            elif "readonly" in node.attrs:
                code = Node("code", {}, node.parent)
                code.children.append(node.attrs.get("value", ""))
                node.replace(code)
        elif node.tag == "img":
            if UUID.match(node.attrs.get("alt", "")):
                node.attrs["alt"] = ""
            if node.attrs.get("width") in ("0", "1") and node.attrs.get("height") in ("0", "1"):
                node.drop()
    return root


def preclean(root: Node) -> Node:
    """Hidden paragraphs are shown, widget classes on divs that hold an article's paragraphs are taken off."""
    for node in root.elements():
        if node.tag == "p" and ("paywall" in node.classes or "aria-hidden" in node.attrs):
            node.attrs.pop("aria-hidden", None)
            node.attrs.pop("hidden", None)
            node.attrs["class"] = " ".join(c for c in node.classes if c != "paywall")
        elif node.tag == "div" and node.classes:
            long = sum(1 for c in node.children if isinstance(c, Node) and c.tag == "p" and len(c.text().strip()) >= 80)
            if long >= 5:
                node.attrs["class"] = " ".join(c for c in node.classes if not re.search("widget|sidebar|share|related", c, re.I))
            if "w-embed" in node.classes and any(n.tag == "table" for n in node.elements()):
                node.attrs["class"] = " ".join(c for c in node.classes if c != "w-embed")
    return root


URL_ATTRS = {"img": ("src", "srcset"), "source": ("src", "srcset"), "a": ("href",), "video": ("src", "poster"), "audio": ("src",)}
KEPT_AS_IS = re.compile(r"^\s*(?:data:|mailto:|javascript:|tel:|#)", re.I)


def absolute(url: str, base: str) -> str:
    if not url or KEPT_AS_IS.match(url):
        return url
    try:
        return urljoin(base, url.strip())
    except ValueError:
        return url


def absolutify(root: Node, base: str | None) -> Node:
    for node in root.elements():
        for attr in URL_ATTRS.get(node.tag, ()) if base else ():
            if attr in node.attrs:
                if attr == "srcset":
                    parts = [p.split(None, 1) for p in node.attrs[attr].split(",") if p.strip()]
                    node.attrs[attr] = ", ".join(" ".join([absolute(p[0], base), *p[1:]]) for p in parts)
                else:
                    node.attrs[attr] = absolute(node.attrs[attr], base)
    return root


def to_html(node: Node | str) -> str:
    """Markup of a node; iterative, so depth doesn't matter."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif x.tag == "#document":
            todo.extend(reversed(x.children))
        else:
            attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in x.attrs.items())
            out.append(f"<{x.tag}{attrs}>")
            if x.tag not in VOID:
                todo.append((f"</{x.tag}>",))
                if x.tag in ("script", "style"):
                    todo.extend((c,) for c in reversed(x.children) if isinstance(c, str))
                else:
                    todo.extend(reversed(x.children))
    return "".join(out)


META_NAMES = {"description": "description", "author": "author", "article:published_time": "published_time", "article:modified_time": "modified_time", "og:title": "og_title", "og:description": "og_description", "og:image": "og_image", "og:site_name": "og_site_name", "og:type": "og_type", "twitter:title": "twitter_title", "twitter:description": "twitter_description", "twitter:image": "twitter_image", "twitter:card": "twitter_card"}
METADATA = ("title", "canonical", "language", *META_NAMES.values())


def metadata(root: Node) -> dict[str, str | None]:
    """Title (head, else any outside svg, else og:title, else h1), canonical address, language and named meta tags."""
    out: dict[str, str | None] = dict.fromkeys(METADATA)
    titles, heading = [], None
    for node in root.elements():
        if node.tag == "title":
            up = node.parent
            while up is not None and up.tag not in ("head", "svg"):
                up = up.parent
            if up is None or up.tag == "head":
                titles.append((up is None, squeezed(node.text(True))))
        elif node.tag == "h1" and heading is None:
            heading = squeezed(node.text())
        elif node.tag == "html" and out["language"] is None:
            out["language"] = node.attrs.get("lang") or None
        elif node.tag == "link" and "canonical" in node.attrs.get("rel", "").lower().split() and out["canonical"] is None:
            out["canonical"] = node.attrs.get("href") or None
        elif node.tag == "meta":
            key = META_NAMES.get((node.attrs.get("property") or node.attrs.get("name") or "").lower())
            if key and out[key] is None:
                out[key] = node.attrs.get("content", "").strip() or None
    titles.sort(key=lambda t: t[0])
    out["title"] = next((t for _, t in titles if t), None) or out["og_title"] or heading or None
    return out


DATES = ('meta[property="article:published_time"]', 'meta[name="date"]', 'meta[itemprop="datePublished"]', "time[datetime]", '[itemprop="datePublished"]')


def date_text(root: Node) -> list[str]:
    """What may be the publication date, best first."""
    out = []
    for selector in DATES:
        node = first(root, selector)
        if node is not None:
            out.append(node.attrs.get("content") or node.attrs.get("datetime") or squeezed(node.text()))
    return [x for x in out if x]


SPECIAL = re.compile(r"([\\`*_\[\]])")
OPENING = re.compile(r"^(\s*)(#{1,6}(?=\s)|>|[-+](?=\s)|\d+(?=[.)]\s))")


def _plain(text: str) -> str:
    return SPECIAL.sub(r"\\\1", re.sub(r"\s+", " ", text))


def _unwound(work: Generator) -> object:
    """Result of a generator that yields the generators it needs the results of; a list stands for the call stack, so depth doesn't matter."""
    stack, value = [work], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def _inlines(nodes: list) -> Generator:
    out = []
    for node in nodes:
        out.append((yield _inline(node)))
    return "".join(out)


def _inline(node: Node | str) -> Generator:
    if isinstance(node, str):
        return _plain(node)
    if node.tag in HIDDEN:
        return ""
    if node.tag == "br":
        return "  \n"
    if node.tag == "img":
        src, alt = node.attrs.get("src", ""), squeezed(node.attrs.get("alt", ""))
        return alt if src.startswith("data:") or not src else f"![{alt}]({src})"
    if node.tag in ("code", "kbd", "samp"):
        text = squeezed(node.text())
        return f"`{text}`" if text else ""
    inner = yield _inlines(node.children)
    bare = inner.strip()
    if not bare:
        return inner
    edges = (inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :])
    if node.tag in ("b", "strong"):
        return f"{edges[0]}**{bare}**{edges[1]}"
    if node.tag in ("i", "em"):
        return f"{edges[0]}*{bare}*{edges[1]}"
    if node.tag in ("s", "del"):
        return f"{edges[0]}~~{bare}~~{edges[1]}"
    if node.tag == "a" and node.attrs.get("href"):
        return f"{edges[0]}[{bare}]({node.attrs['href']}){edges[1]}"
    return inner


def _tidy(text: str) -> str:
    text = re.sub(r" *\n *", "\n", text.replace("  \n", "\u0000")).replace("\u0000", "  \n")
    return OPENING.sub(lambda m: f"{m[1]}\\{m[2]}" if not m[2][0].isdigit() else f"{m[1]}{m[2]}\\", re.sub(r"[ \t]{2,}(?!\n)", " ", text).strip())


def _table(node: Node) -> Generator:
    rows = []
    for r in node.elements():
        cells = []
        for c in r.children if r.tag == "tr" else ():
            if isinstance(c, Node) and c.tag in ("td", "th"):
                text = yield _inlines(c.children)
                cells.append(_tidy(text).replace("|", "\\|").replace("\n", " "))
        if cells:
            rows.append(cells)
    if not rows:
        return ""
    wide = max(map(len, rows))
    rows = [r + [""] * (wide - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * wide, *map(line, rows[1:])])


def _list(node: Node) -> Generator:
    out = []
    for n, item in enumerate((c for c in node.children if isinstance(c, Node) and c.tag == "li"), 1):
        mark = f"{n}. " if node.tag == "ol" else "- "
        inner = yield _blocks(item)
        body = "\n".join(inner)
        if body:
            out.append(mark + body.replace("\n", "\n" + " " * len(mark)))
    return "\n".join(out)


def blocks(node: Node) -> list[str]:
    """Markdown blocks of what a node holds."""
    return _unwound(_blocks(node))


def _blocks(node: Node) -> Generator:
    out, run = [], []

    def close():
        text = _tidy("".join(run))
        run.clear()
        if text:
            out.append(text)

    for child in node.children:
        if isinstance(child, str):
            run.append(_plain(child))
            continue
        tag = child.tag
        if tag in HIDDEN:
            continue
        if not (tag in BLOCK or tag in ("body", "html", "td", "th", "tr", "tbody", "thead", "dt", "dd", "li", "figcaption", "summary") or any(n.tag in BLOCK for n in child.elements())):
            run.append((yield _inline(child)))
            continue
        close()
        if re.fullmatch("h[1-6]", tag):
            inner = yield _inlines(child.children)
            text = _tidy(inner).replace("\n", " ")
            out += [f"{'#' * int(tag[1])} {text}"] * bool(text)
        elif tag == "pre":
            code = child.text(True).strip("\n")
            mark = "`" * max(3, 1 + max(map(len, re.findall("`+", code)), default=0))
            lang = next((c.removeprefix("language-") for n in child.elements() for c in n.classes if c.startswith("language-")), "")
            out.append(f"{mark}{lang}\n{code}\n{mark}")
        elif tag in ("ul", "ol", "menu"):
            x = yield _list(child)
            out += [x] if x else []
        elif tag == "blockquote":
            inner = "\n\n".join((yield _blocks(child)))
            out += ["\n".join(f"> {x}".rstrip() for x in inner.split("\n"))] * bool(inner)
        elif tag == "table":
            x = yield _table(child)
            out += [x] if x else []
        elif tag == "hr":
            out.append("---")
        else:
            out += yield _blocks(child)
    close()
    return out


def to_markdown(node: Node) -> str:
    return "\n\n".join(blocks(node))


def body_of(root: Node) -> Node:
    return first(root, "body") or root


def main_content(root: Node) -> Node | None:
    """The container with the best density: text and paragraphs and commas in favour, links against, articles and mains preferred."""
    best, score = None, 0.0
    for node in body_of(root).elements():
        if node.tag not in ("article", "main", "section", "div", "td", "body"):
            continue
        own = [c for c in node.children if isinstance(c, Node) and c.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "h2", "h3")]
        text = sum(len(c.text().strip()) for c in own)
        links = sum(len(a.text()) for c in own for a in c.elements() if a.tag == "a")
        value = (text - links) + 25 * len(own) + 3 * sum(c.text().count(",") for c in own)
        value *= 1.5 if node.tag in ("article", "main") else 1
        if value > score:
            best, score = node, value
    return best


def dominant(body: Node, share: float = 0.9, levels: int = 30) -> Node:
    """Down from the body while one child holds nearly all of the text."""
    at = body
    for _ in range(levels):
        whole = len(at.text().strip()) or 1
        down = next((c for c in at.children if isinstance(c, Node) and len(c.text().strip()) >= share * whole), None)
        if down is None or down.tag == "p":
            break
        at = down
    return at
