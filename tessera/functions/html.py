"""Pages to documents: a forgiving tree builder, cleaning, choice of the content, Markdown.

One Arrow-batched function returns the whole document as a struct. Nothing in it is global and nothing goes out to a
network; a page that can't be read gives an empty document, never an exception.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import quote, unquote_plus, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.urls import LINK_NAMES, LINK_PREFIX

#: The extracted document.
DOCUMENT = T.StructType([
    T.StructField("markdown", T.StringType()), T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())]))),
    T.StructField("meta", T.StructType([T.StructField(n, T.StringType()) for n in ("author", "published_at", "site_name", "lang")])),
    T.StructField("text_length", T.IntegerType()),
])
#: A strategy's text must be longer than this to count.
USEFUL_TEXT = 200
LINK_TEXT, IMAGE_WORD = 200, "изображение"

#: Elements, roles, names that are a page's surroundings and never its content. Fixed values.
CHROME_TAGS = frozenset(("script", "style", "noscript", "template", "svg", "iframe", "nav", "header", "footer", "aside", "form"))
CHROME_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search"))
CHROME_CLASSES = frozenset(("cookie-banner", "newsletter", "advertisement"))
CHROME_IDS = frozenset(("cookie-banner",))
CODE_CHROME = {"span": {"lang", "language-name"}, "button": {"copy"}}
PERMALINK_SIGNS = "¶#§🔗"

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template"))
_HEAD = frozenset(("title", "meta", "link", "base", "style", "script"))
_BLOCK = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul body".split())
_SCOPE = frozenset("table td th ul ol dl body html div section article button".split())
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th", "tbody"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "option": ("option",)}
_TABLE_TAGS = frozenset(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"))
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPACES = re.compile(r"[\s\ufeff]+")
_INVISIBLE = re.compile(r"[\u00ad\u200b\u2060\ufeff\ue000-\uf8ff]")


class Node:
    """An element; text is kept as plain strings among the children."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def add(self, child: Node | str) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def drop(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace(self, *new: Node | str) -> None:
        at = next(k for k, c in enumerate(self.parent.children) if c is self)
        self.parent.children[at : at + 1] = new
        for n in new:
            if isinstance(n, Node):
                n.parent = self.parent
        self.parent = None


def parse_html(html: str) -> Node:
    """The document's tree: ``html`` with ``head`` and ``body``. End tags that are left out are implied."""
    root = Node("html")
    head, body = Node("head"), Node("body")
    root.add(head)
    root.add(body)
    stack: list[Node] = [body]
    in_body = False
    at, size = 0, len(html)

    def text(value: str) -> None:
        nonlocal in_body
        if value and (in_body or value.strip()):
            in_body = True
            stack[-1].add(unescape(value) if "&" in value else value)

    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        closing, opening = m.group(1), m.group(2)
        if closing:
            tag = closing.lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("table", "td", "th") and tag not in _TABLE_TAGS | {"div", "body", "html"}:
                    break
            continue
        if not opening:
            continue
        tag = opening.lower()
        raw = m.group(3)
        attrs: dict[str, str] = {}
        if raw and not raw.isspace():
            for name, a, b, c in _ATTRIBUTE.findall(raw):
                attrs.setdefault(name.lower(), unescape(a or b or c))
        if tag in ("html", "body", "head"):
            target = {"html": root, "body": body, "head": head}[tag]
            for name, value in attrs.items():
                target.attrs.setdefault(name, value)
            in_body = in_body or tag == "body"
            continue
        place = head if not in_body and tag in _HEAD else None
        if place is None:
            in_body = True
            closes = _CLOSED_BY.get(tag)
            if closes:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in closes:
                        del stack[k:]
                        closes = closes if tag in ("tr", "thead", "tbody", "tfoot") else ()
                        if not closes:
                            break
                    elif stack[k].tag in _SCOPE:
                        break
            elif tag in _BLOCK:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        del stack[k:]
                        break
                    if stack[k].tag in _SCOPE:
                        break
        node = Node(tag, attrs)
        (place or stack[-1]).add(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            inner = html[at : end.start() if end else size]
            if inner:
                node.add(unescape(inner) if tag in ("title", "textarea") else inner)
            at = end.end() if end else size
        elif tag not in _VOID and not (raw.endswith("/") and tag not in _BLOCK):
            if place is None:
                stack.append(node)
    return root


def escape_url(url: str) -> str:
    """An absolute URL as a browser writes it."""
    parts = urlsplit(url)
    host = (parts.hostname or "").lower()
    if not host.isascii():
        try:
            host = host.encode("idna").decode("ascii")
        except UnicodeError:
            pass
    host = f"[{host}]" if ":" in host else host
    port = parts.port
    netloc = (parts.netloc.rpartition("@")[0] + "@" if "@" in parts.netloc else "") + host
    if port is not None and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        netloc += f":{port}"
    path = quote(parts.path or "/", safe="/%:@!$&'()*+,;=-._~[]|^\\")
    query = quote(parts.query, safe="/%:@!$&()*+,;=-._~?[]|^\\`{}")
    fragment = quote(parts.fragment, safe="/%:@!$&'()*+,;=-._~?[]|^\\{}#")
    return urlunsplit((parts.scheme, netloc, path, query, fragment)) + ("#" if url.endswith("#") and not parts.fragment else "")


def join_url(href: str, base: str) -> str | None:
    """``href`` seen from ``base``, or None if that is no URL."""
    try:
        href = re.sub(r"[\t\n\r]", "", href.strip())
        joined = urljoin(base, href.replace("\\", "/") if not re.match(r"^[a-z][a-z0-9+.-]*:", href, re.I) else href)
        scheme = urlsplit(joined).scheme
        if scheme in ("http", "https"):
            return escape_url(joined) if urlsplit(joined).hostname else None
        return joined if scheme else None
    except ValueError:
        return None


def strip_tracking_href(href: str) -> str:
    before, mark, fragment = href.partition("#")
    path, sign, query = before.partition("?")
    if not sign:
        return href

    def tracks(pair: str) -> bool:
        name = unquote_plus(pair.split("=", 1)[0]).lower()
        return name.startswith(LINK_PREFIX) or name in LINK_NAMES

    pairs = [p for p in query.split("&") if p]
    kept = [p for p in pairs if not tracks(p)]
    if len(kept) == len(pairs):
        return href
    return path + ("?" + "&".join(kept) if kept else "") + mark + fragment


#: White space of the web platform, which has no U+0085 and no U+001C to U+001F. Fixed values.
_WEB_SPACE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _meta(doc: Node, *names: str) -> str | None:
    metas = doc.all("meta")
    for name in names:
        for node in metas:
            if name in (node.attrs.get("property"), node.attrs.get("name")):
                value = node.attrs.get("content", "").strip(_WEB_SPACE)
                if value:
                    return value
                break
    return None


def sanitize(doc: Node, base: str) -> None:
    """Images to their words, links to the own place away, tracking off links, invisible characters out; in this order."""
    for image in doc.all("img"):
        alt = image.attrs.get("alt", "").strip()
        if not alt:
            image.drop()
            continue
        around = image.parent.children
        at = next(k for k, c in enumerate(around) if c is image)
        before, after = (around[at - 1] if at else None), (around[at + 1] if at + 1 < len(around) else None)
        left = "" if before is None or (isinstance(before, str) and before[-1:].isspace()) else " "
        right = "" if after is None or (isinstance(after, str) and after[:1].isspace()) else " "
        image.replace(f"{left}{IMAGE_WORD}: {alt}{right}")
    own = join_url(base, base)
    own = own.partition("#")[0] if own else None
    for anchor in doc.all("a"):
        href = anchor.attrs.get("href")
        if not href:
            continue
        if own and "#" in href:
            target = join_url(href, base)
            if target and target.partition("#")[0] == own:
                shown = _INVISIBLE.sub("", anchor.text())
                if not "".join(c for c in shown if c not in PERMALINK_SIGNS).strip():
                    anchor.drop()
                    continue
        anchor.attrs["href"] = strip_tracking_href(href)
    body = doc.find("body") or doc
    stack = [body]
    while stack:
        node = stack.pop()
        for k, child in enumerate(node.children):
            if isinstance(child, str):
                node.children[k] = _INVISIBLE.sub("", child)
            elif child.tag not in ("pre", "code"):
                stack.append(child)


def is_chrome(node: Node) -> bool:
    a = node.attrs
    return (
        node.tag in CHROME_TAGS or a.get("role") in CHROME_ROLES or a.get("aria-hidden") == "true" or "hidden" in a
        or a.get("id") in CHROME_IDS or not CHROME_CLASSES.isdisjoint(node.classes())
    )


def without_chrome(node: Node) -> Node:
    """A copy of the tree without the page's surroundings."""
    copy = Node(node.tag, dict(node.attrs))
    stack = [(node, copy)]
    while stack:
        old, new = stack.pop()
        for child in old.children:
            if isinstance(child, str):
                new.add(child)
            elif not is_chrome(child):
                fresh = Node(child.tag, dict(child.attrs))
                new.add(fresh)
                stack.append((child, fresh))
    return copy


_LENGTH_STEPS = [
    (re.compile(r"<[^>]+>"), ""), (re.compile(r"```[^\n]*\n?"), ""), (re.compile(r"!\[[^\]]*\]\([^)]*\)"), ""),
    (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\\([\\`*_{}\[\]()#+\-.!|>~])"), r"\1"), (re.compile(r"[#>*_`|]"), ""),
    (re.compile(r"^[ \t]*[-+][\s\ufeff]+", re.M), ""), (_SPACES, " "),
]


def text_length(markdown: str) -> int:
    """Length of the readable text in UTF-16 units."""
    for pattern, by in _LENGTH_STEPS:
        markdown = pattern.sub(by, markdown)
    markdown = markdown.strip()
    return len(markdown) if markdown.isascii() else len(markdown.encode("utf-16-le", "surrogatepass")) // 2


def _plain(node: Node) -> str:
    return _SPACES.sub(" ", "".join(n if isinstance(n, str) else "" for n in _texts(node))).strip()


def _texts(node: Node) -> Iterator[str]:
    stack: list = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            yield item
        elif item.tag not in ("script", "style", "noscript", "template"):
            stack += reversed(item.children)


def _by_density(body: Node) -> Node | None:
    """The element whose own paragraphs have the most text that is not linked; a parent takes half of its child's score."""
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for node in body.walk():
        if node.tag not in ("p", "pre", "blockquote", "td", "li"):
            continue
        text = _plain(node)
        linked = sum(len(_plain(a)) for a in node.all("a"))
        worth = len(text) - 2 * linked
        if len(text) < 25 or worth <= 0:
            continue
        share, up = 1.0, node.parent
        for _ in range(3):
            if up is None:
                break
            scores[id(up)] = scores.get(id(up), 0.0) + worth * share
            nodes[id(up)] = up
            share, up = share / 2, up.parent
    return nodes[max(scores, key=scores.get)] if scores else None


def pick_content(doc: Node) -> Node:
    """The content by the strategy that finds the most text: marked element, paragraphs' parent, densest element; else the body."""
    body = doc.find("body") or doc
    found: list[Node] = []
    marked = doc.find("article") or doc.find("main") or next((n for n in doc.walk() if n.attrs.get("role") == "main"), None)
    if marked:
        found.append(without_chrome(marked))
    clean = without_chrome(body)
    dense = _by_density(clean)
    if dense:
        found.append(dense)
    sizes = [len(_plain(n)) for n in found]
    best = max(range(len(found)), key=lambda k: (sizes[k], -k), default=None)
    if best is not None and sizes[best] > USEFUL_TEXT:
        return found[best]
    return clean


_ESCAPES = re.compile(r"([\\`*_\[\]])")


def _language(node: Node | None) -> str:
    for name in node.classes() if node else ():
        m = re.fullmatch(r"(?:language|lang|highlight-source)-([\w+#-]+)", name)
        if m:
            return m.group(1)
    m = re.search(r"brush:\s*([\w+#-]+)", node.attrs.get("class", "") if node else "")
    return m.group(1) if m else ""


def _own_head(table: Node) -> bool:
    for node in table.all("th", "thead"):
        up = node.parent
        while up and up.tag != "table":
            up = up.parent
        if up is table:
            return True
    return False


#: Parts of tables. Fixed values.
TABLE_TAGS = frozenset(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"))


def unwrap_layout_tables(root: Node) -> None:
    """Tables without a head of their own become plain blocks with all their parts; data tables stay, also within them."""
    stack = [(root, False)]
    while stack:
        node, data = stack.pop()
        for child in list(node.children):
            if isinstance(child, str):
                continue
            if child.tag in ("col", "colgroup"):
                child.drop()
                continue
            inside = data
            if child.tag == "table":
                inside = _own_head(child)
            if child.tag in TABLE_TAGS and not inside:
                child.tag = "div"
            stack.append((child, inside))


def _own_rows(table: Node) -> list[Node]:
    """The rows of a table without those of tables in its cells."""
    out, stack = [], list(reversed(table.children))
    while stack:
        node = stack.pop()
        if isinstance(node, Node) and node.tag == "tr":
            out.append(node)
        elif isinstance(node, Node) and node.tag in TABLE_TAGS and node.tag != "table":
            stack += reversed(node.children)
    return out


def _inline(node: Node, code: bool = False) -> str:
    out = []
    for child in node.children:
        if isinstance(child, str):
            out.append(child if code else _ESCAPES.sub(r"\\\1", _SPACES.sub(" ", child)))
        elif child.tag in ("script", "style", "noscript", "template"):
            continue
        elif child.tag == "br":
            out.append("  \n")
        elif child.tag == "a":
            inner = _inline(child).strip()
            href = child.attrs.get("href")
            out.append(f"[{inner}]({href})" if href and inner else inner)
        elif child.tag in ("strong", "b", "em", "i", "del", "s", "strike"):
            inner = _inline(child)
            sign = "**" if child.tag in ("strong", "b") else "_" if child.tag in ("em", "i") else "~"
            bare = inner.strip()
            out.append(inner.replace(bare, f"{sign}{bare}{sign}", 1) if bare else inner)
        elif child.tag == "code":
            inner = child.text()
            longest = max((len(x) for x in re.findall(r"`+", inner)), default=0)
            ticks = "`" * (longest + 1)
            out.append(f"{ticks}{' ' if inner[:1] == '`' else ''}{inner}{' ' if inner[-1:] == '`' else ''}{ticks}" if inner.strip() else inner)
        elif child.tag == "input" and child.attrs.get("type") == "checkbox":
            out.append("[x] " if "checked" in child.attrs else "[ ] ")
        elif child.tag in _BLOCK:
            out.append(" " + _inline(child) + " ")
        else:
            out.append(_inline(child))
    return "".join(out)


def _blocks(node: Node) -> list[str]:
    """The Markdown blocks of an element's children."""
    out: list[str] = []
    run = Node("span")

    def flush() -> None:
        nonlocal run
        text = re.sub(r" *\n *", "\n", _inline(run)).strip()
        if text:
            out.append(re.sub(r"(?m)^(\d+)\. ", r"\1\\. ", text))
        run = Node("span")

    for child in node.children:
        if isinstance(child, str) or (child.tag not in _BLOCK and not any(isinstance(c, Node) and c.tag in _BLOCK for c in child.walk())):
            run.children.append(child)
            continue
        flush()
        tag = child.tag
        if tag in ("script", "style", "noscript", "template"):
            continue
        if tag == "pre":
            codes = child.all("code")
            source = codes[0] if len(codes) == 1 else child
            text = re.sub(r"\n+\Z", "", source.text())
            text = text[1:] if text.startswith("\n") else text
            longest = max((len(x) for x in re.findall(r"`+", text)), default=0)
            fence = "`" * max(3, longest + 1)
            out.append(f"{fence}{_language(codes[0] if codes else None) or _language(child)}\n{text}\n{fence}")
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            text = _SPACES.sub(" ", _inline(child)).strip()
            if text:
                out.append("#" * int(tag[1]) + " " + text)
        elif tag == "hr":
            out.append("* * *")
        elif tag == "blockquote":
            inner = "\n\n".join(_blocks(child))
            if inner:
                out.append("\n".join(f"> {line}".rstrip() for line in inner.split("\n")))
        elif tag in ("ul", "ol"):
            lines, number = [], int(child.attrs["start"]) if child.attrs.get("start", "").isdigit() else 1
            for item in child.children:
                if isinstance(item, str) and not item.strip():
                    continue
                inner = "\n".join(_blocks(item) if isinstance(item, Node) else [item.strip()])
                mark = "-   " if tag == "ul" else f"{number}.  "
                number += 1
                if inner:
                    lines.append(mark[:2] + inner.replace("\n", "\n    ") if tag == "ul" else mark + inner.replace("\n", "\n    "))
            if lines:
                out.append("\n".join(lines))
        elif tag == "table" and _own_head(child):
            rows = [[_SPACES.sub(" ", _inline(c)).strip().replace("|", "\\|") for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")] for row in _own_rows(child)]
            rows = [r for r in rows if r]
            if rows:
                width = max(map(len, rows))
                rows = [r + [""] * (width - len(r)) for r in rows]
                out.append("\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * width, *rows[1:]]))
        else:
            out += _blocks(child)
    flush()
    return out


def clean_markdown(text: str) -> str:
    return re.sub(r"[ \t]+$", "", re.sub(r"\n{3,}", "\n\n", text), flags=re.M).strip()


def to_markdown(content: Node) -> str:
    """The content as Markdown; elements nested too deep for that are given as plain text."""
    unwrap_layout_tables(content)
    try:
        return clean_markdown("\n\n".join(_blocks(content)))
    except RecursionError:
        return _plain(content)


def extract(html: str | None, url: str | None) -> dict:
    """The document of a page. Null, blank and unreadable pages give an empty one."""
    empty = {"markdown": "", "title": "", "description": None, "links": [], "meta": dict.fromkeys(("author", "published_at", "site_name", "lang")), "text_length": 0}
    if not html or not html.strip():
        return empty
    url = url or ""
    doc = parse_html(html)
    head_title = doc.find("title")
    title = (head_title.text().strip(_WEB_SPACE) if head_title else "") or _meta(doc, "og:title", "twitter:title") or next((n.text().strip(_WEB_SPACE) for n in doc.all("h1")), "") or ""
    description = _meta(doc, "og:description", "description", "twitter:description")
    meta = {
        "author": _meta(doc, "author", "article:author"), "published_at": _meta(doc, "article:published_time", "datePublished"),
        "site_name": _meta(doc, "og:site_name"), "lang": doc.attrs.get("lang"),
    }
    base_tag = next((n for n in doc.all("base") if n.attrs.get("href")), None)
    base = (join_url(base_tag.attrs["href"], url) if base_tag else None) or url
    for node in doc.all("a", "img"):
        name = "href" if node.tag == "a" else "src"
        if node.attrs.get(name):
            node.attrs[name] = join_url(node.attrs[name], base) or node.attrs[name]
    sanitize(doc, base)
    links, seen = [], set()
    for anchor in doc.all("a"):
        href = join_url(anchor.attrs.get("href", ""), base) if anchor.attrs.get("href") else None
        if href and re.match("https?:", href) and href not in seen:
            seen.add(href)
            links.append({"href": href, "text": anchor.text().strip(_WEB_SPACE)[:LINK_TEXT]})
    for node in doc.all(*CODE_CHROME):
        if not CODE_CHROME[node.tag].isdisjoint(node.classes()):
            node.drop()
    markdown = to_markdown(pick_content(doc))
    return {
        "markdown": markdown, "title": _INVISIBLE.sub("", title), "description": description and _INVISIBLE.sub("", description),
        "links": links, "meta": meta, "text_length": text_length(markdown),
    }


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """``(page_id, url, *keep, doc)`` of every row: one Arrow pass, one evaluation a page, no shuffle.

    A null page has a null document and costs nothing. Put native filters before it
    (:func:`tessera.functions.classify.gate_error`): they reach the scan.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = [id_col, url_col, *(keep or [])]
    source = pages.select(*names, F.col(html_col).alias("_html"))
    kind = to_arrow_type(DOCUMENT)
    schema = T.StructType([source.schema[n] for n in names] + [T.StructField("doc", DOCUMENT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = []
            for html, url in zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(1).to_pylist()):
                try:
                    docs.append(None if html is None else extract(html, url))
                except ValueError:
                    docs.append(extract(None, None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(docs, kind)], names=[*names, "doc"])

    return source.mapInArrow(run, schema)
