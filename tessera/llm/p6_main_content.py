"""Problem 6: page boilerplate mixed with main content.

A page is a tree of block elements. Each has a hidden label, content or boilerplate, with a potential from what the
block looks like, and every parent and child share a potential; sum-product messages up and down the tree yield each
block's marginal. The potentials are trained on pages whose markup labels itself (article, main, nav, aside, footer …);
during training that markup is hidden half of the time, so that pages without it are read by their text and shape.
The lines of the extracted Markdown take over the marginals of the blocks they come from, and a second, flat tree of
paragraphs and lines joins them with what the lines themselves look like, for lines the page does not have.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many pages train the potentials (they are read by the driver).
TRAINING_PAGES, TRAINING_CANDIDATES = 1_500, 6_000
BUCKETS, EPOCHS, RATE, DECAY, SEED = 1 << 17, 4, 0.25, 1e-5, 3
#: How far labels of neighbours agree in the tree of the Markdown: a paragraph with its lines, the text with its paragraphs.
LINE_TIE, PARAGRAPH_TIE = 0.93, 0.6
#: How many times the log-odds of a line's block count in the tree of the Markdown: the page has weighed them already.
PAGE_WEIGHT = 2.5
#: The part of a line's letters that must be found in the page for the page's marginals to count.
LEAST_FOUND = 0.5
LONGEST_LOGIT = 6.0
#: Words remembered by a worker; emptied when full.
REMEMBERED = 200_000

#: Markup that labels itself, and what HTML says about elements. Fixed values.
CONTENT_MARKS = frozenset("article main post content entry story".split())
CHROME_MARKS = frozenset("nav header footer aside form menu side sidebar share bottom notice cookie-banner newsletter cookie breadcrumb related social advertisement".split())
_INLINE = frozenset("a abbr b bdi bdo cite code em font i img input kbd label mark q s samp small span strong sub sup time tt u var wbr br button".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIP = frozenset("script style template noscript svg head iframe select textarea".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_BOUNDS = frozenset("ul ol table body div article section main td dl".split())

_TAG = re.compile(r"<!--.*?-->|<(script|style|template|noscript|svg|head|iframe|select|textarea)\b.*?</\1\s*>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|<[!?][^>]*>", re.S | re.I)
_NAMED = re.compile(r"""(class|id|role|href)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[^\W\d_]+|\d+|[©|·%€$@]")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_MD_LINK = re.compile(r"!?\[((?:[^\[\]]|\[[^\]]*\])*)\]\(([^()\s]*)[^()]*\)")
_MD_MARK = re.compile(r"^\s*(?:>\s*)*(?:(#{1,6})\s+|([-*+]|\d+[.)])\s+)?")
_SPLIT = re.compile(r"\s+[·|•]\s+|\s{2,}|\t")


class Hashes(dict):
    """Bucket of a feature."""

    def __missing__(self, name: str) -> int:
        value = xxhash.xxh32_intdigest(name) % BUCKETS
        if len(self) >= REMEMBERED:
            self.clear()
        self[name] = value
        return value


def letters(text: str) -> str:
    return _NO_LETTERS.sub("", text.lower())


@dataclass
class Block:
    parent: int
    tag: str
    marks: tuple[str, ...]
    text: list[str] = field(default_factory=list)
    size: int = 0
    linked: int = 0
    inner: int = 0
    outer: int = 0


def parse(html: str) -> list[Block]:
    """The block elements of a page in document order; the first is the root. Inline elements add to their block."""
    blocks = [Block(-1, "root", ())]
    stack = [0]
    link: list[str] = []
    at = 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            text = html[at : m.start()]
            block = blocks[stack[-1]]
            if text.isspace():
                if block.text:
                    block.text.append(" ")
            else:
                if "&" in text:
                    text = unescape(text)
                block.text.append(text)
                block.size += len(text)
                if link:
                    block.linked += len(text)
        at = m.end()
        tag = m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                if m.group(2):
                    link.clear()
                else:
                    href = next((x[1] or x[2] or x[3] for x in _NAMED.findall(m.group(4)) if x[0].lower() == "href"), "")
                    link.append(href)
                    block = blocks[stack[-1]]
                    if "://" in href:
                        block.outer += 1
                    else:
                        block.inner += 1
            elif tag == "br":
                blocks[stack[-1]].text.append(" ")
            continue
        if m.group(2):
            for k in range(len(stack) - 1, 0, -1):
                if blocks[stack[k]].tag == tag:
                    del stack[k:]
                    break
            continue
        closes = _CLOSES.get(tag)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if blocks[stack[k]].tag in closes:
                    del stack[k:]
                    break
                if blocks[stack[k]].tag in _BOUNDS:
                    break
        elif len(stack) > 1 and blocks[stack[-1]].tag == "p":
            stack.pop()
        attributes = m.group(4)
        marks = tuple(w.lower() for x in _NAMED.findall(attributes) if x[0].lower() != "href" for w in (x[1] or x[2] or x[3]).split()) if "=" in attributes else ()
        blocks.append(Block(stack[-1], tag, marks))
        if tag not in _VOID and not attributes.endswith("/"):
            stack.append(len(blocks) - 1)
    rest = html[at:].strip()
    if rest and "<" not in rest:
        blocks[stack[-1]].text.append(unescape(rest))
    return blocks


_SIZES = (1, 2, 4, 8, 16, 30, 60, 120)
#: The words of a text, and its bigrams, weigh together no more than so many do.
WORDS_WEIGHT = 10


def text_features(text: str, linked: float, inner: int, outer: int, kind: str, hashes: Hashes) -> tuple[list[int], list[float]]:
    """What a piece of text looks like, wherever it stands, and how much each feature counts: its words, length, marks and links."""
    words = _WORD.findall(text.lower())
    n = len(words)
    size = sum(n > s for s in _SIZES)
    end = text.rstrip()[-1:]
    sentence = "s" if end in ".!?。！？…”\"»" and end else "o"
    link = "n" if linked <= 0 else "f" if linked > 0.85 else "p"
    where = "b" if inner and outer else "i" if inner else "e" if outer else "n"
    out = [hashes["bias"], hashes[f"size:{size}{sentence}"], hashes[f"link:{link}{where}"], hashes[f"kind:{kind}{link}{where}"], hashes[f"kindsize:{kind}{size}{sentence}"]]
    if not (words and any(c.isalpha() for c in text)):
        out.append(hashes["noletters"])
    weights = [1.0] * len(out)
    out += [hashes["w:" + w] for w in words if not w.isdigit()]
    out += [hashes[f"b:{a} {b}"] for a, b in zip(words, words[1:])]
    weights += [min(1.0, WORDS_WEIGHT / max(n, 1))] * (len(out) - len(weights))
    return out, weights


def kind_of(tag: str) -> str:
    return "h1" if tag == "h1" else "h" if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else "li" if tag in ("li", "dt", "dd") else "pre" if tag == "pre" else "td" if tag in ("td", "th") else "p"


def shape_features(blocks: list[Block], k: int, place: str, hashes: Hashes) -> list[int]:
    """Where a block stands: its tag and the tags and names above it."""
    block = blocks[k]
    out = [hashes["tag:" + block.tag], hashes["place:" + place]]
    up, level = k, 0
    while up > 0 and level < 6:
        b = blocks[up]
        out.append(hashes["in:" + b.tag])
        out += [hashes["name:" + w] for w in b.marks]
        up, level = b.parent, level + 1
    return out


def own_label(blocks: list[Block]) -> list[int]:
    """What the markup says about each block: 1 content, 0 boilerplate, -1 nothing.

    The innermost mark counts. On a page that marks its content all that lies outside of it is boilerplate; an
    unknown box within it is left open.
    """
    labels = [-1] * len(blocks)
    marked = any(b.tag in ("article", "main") or CONTENT_MARKS & set(b.marks) for b in blocks)
    labels[0] = 0 if marked else -1
    for k, b in enumerate(blocks):
        if k == 0:
            continue
        names = {b.tag, *b.marks}
        if CHROME_MARKS & names:
            labels[k] = 0
        elif CONTENT_MARKS & names:
            labels[k] = 1
        elif labels[b.parent] == 1 and b.tag == "div" and b.marks:
            labels[k] = -1
        else:
            labels[k] = labels[b.parent]
    return labels


@dataclass
class Model:
    weights: np.ndarray
    ties: dict[tuple[str, str], tuple[tuple[float, float], tuple[float, float]]]


def _places(blocks: list[Block]) -> list[str]:
    """Before, at or after the first main heading, and the tenth of the page's text a block begins in."""
    total = sum(b.size for b in blocks) or 1
    out, before, seen = [], "a", 0
    for b in blocks:
        if b.tag == "h1":
            before = "z"
        out.append(f"{before}{min(9, 10 * seen // total)}")
        seen += b.size
    return out


def _tie_key(blocks: list[Block], k: int) -> tuple[str, str]:
    return blocks[blocks[k].parent].tag, blocks[k].tag


def train(pages: list[str]) -> Model:
    """Potentials of blocks by logistic regression on hashed features, of neighbours by counting."""
    random = np.random.default_rng(SEED)
    hashes = Hashes()
    rows: list[tuple[tuple[list[int], list[float]], list[int], int]] = []
    counts: dict = defaultdict(lambda: np.ones((2, 2)))
    for html in pages:
        blocks = parse(html)
        labels, places = own_label(blocks), _places(blocks)
        for k, b in enumerate(blocks):
            if labels[k] < 0:
                continue
            if b.size:
                text = "".join(b.text).strip()
                if text:
                    rows.append((text_features(text, b.linked / b.size, b.inner, b.outer, kind_of(b.tag), hashes), shape_features(blocks, k, places[k], hashes), labels[k]))
            if k and labels[b.parent] >= 0:
                counts[_tie_key(blocks, k)][labels[b.parent], labels[k]] += 1
                counts["", ""][labels[b.parent], labels[k]] += 1
    weights, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            (text, shares), shape, label = rows[i]
            chance = random.random()
            shown = [] if chance < 0.45 else shape[:2] if chance < 0.6 else shape
            index, parts = text + shown, shares + [1.0] * len(shown)
            z = weights[index] @ parts
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label
            if abs(error) < 1e-3:
                continue
            for j, part in zip(index, parts):
                seen[j] += (error * part) ** 2
                weights[j] -= RATE * (error * part / math.sqrt(seen[j]) + DECAY * weights[j])
    ties = {}
    for key, n in counts.items():
        joint = n / n.sum()
        # how much likelier than by chance the labels go together
        ratio = joint / (joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True))
        ratio = np.clip(ratio, 0.05, 20)
        ties[key] = (tuple(ratio[0]), tuple(ratio[1]))
    ties.setdefault(("", ""), ((1.5, 0.5), (0.5, 1.5)))
    return Model(weights.astype(np.float32), ties)


def sum_product(parents: list[int], odds: list[float], ties: list) -> list[float]:
    """The probability of label 1 of each node of a tree; parents come before their children.

    ``odds`` are the potentials as log-odds, ``ties[k][label of the parent][label of k]`` those of the edges.
    """
    n = len(parents)
    own = []
    for z in odds:
        z = max(-LONGEST_LOGIT, min(LONGEST_LOGIT, z))
        p = 1 / (1 + math.exp(-z))
        own.append([1 - p, p])
    up = [None] * n
    for k in range(n - 1, 0, -1):  # children to parents
        (a, b), (c, d) = ties[k]
        p0, p1 = own[k]
        m0, m1 = a * p0 + b * p1, c * p0 + d * p1
        s = m0 + m1
        m0, m1 = m0 / s, m1 / s
        up[k] = (m0, m1)
        q = own[parents[k]]
        q[0] *= m0
        q[1] *= m1
        s = q[0] + q[1]
        q[0] /= s
        q[1] /= s
    for k in range(1, n):  # parents to children; own[parent] is its belief by now
        q0, q1 = own[parents[k]]
        m0, m1 = up[k]
        q0, q1 = q0 / max(m0, 1e-12), q1 / max(m1, 1e-12)
        (a, b), (c, d) = ties[k]
        d0, d1 = q0 * a + q1 * c, q0 * b + q1 * d
        p0, p1 = own[k][0] * d0, own[k][1] * d1
        s = p0 + p1
        own[k] = [p0 / s, p1 / s]
    return [p[1] for p in own]


def block_marginals(html: str, model: Model, hashes: Hashes) -> list[tuple[str, float, bool]]:
    """(text, probability of being content, whether it is a heading) of each block with text of its own."""
    blocks = parse(html)
    places = _places(blocks)
    index: list[int] = []
    parts: list[float] = []
    starts, owners, texts = [], [], []
    for k, b in enumerate(blocks):
        if b.size:
            text = "".join(b.text).strip()
            if text:
                starts.append(len(index))
                owners.append(k)
                texts.append(text)
                features, shares = text_features(text, b.linked / b.size, b.inner, b.outer, kind_of(b.tag), hashes)
                shape = shape_features(blocks, k, places[k], hashes)
                index += features + shape
                parts += shares + [1.0] * len(shape)
    if not owners:
        return []
    odds = [0.0] * len(blocks)
    for k, z in zip(owners, np.add.reduceat(model.weights[index] * np.array(parts), starts).tolist()):
        odds[k] = z
    default = model.ties["", ""]
    ties = [model.ties.get(_tie_key(blocks, k), default) if k else default for k in range(len(blocks))]
    chances = sum_product([b.parent for b in blocks], odds, ties)
    return [(text, chances[k], kind_of(blocks[k].tag)[0] == "h") for k, text in zip(owners, texts)]


def line_marginals(markdown: str, html: str | None, model: Model, hashes: Hashes) -> list[tuple[int, float]]:
    """(line number, probability of being content) of each line that is not blank."""
    found: dict[str, float] = {}
    if html:
        for text, chance, heading in block_marginals(html, model, hashes):
            key = letters(text)
            if key and heading:  # a title may also be an entry of a sidebar
                found["#" + key] = max(chance, found.get("#" + key, 0.0))
            elif key:
                found[key] = min(chance, found.get(key, 1.0)) if len(key) < 40 else chance
    numbers, parents, odds, ties = [], [-1], [0.0], [None]
    paragraph, fence = -1, None
    paragraph_tie = ((PARAGRAPH_TIE, 1 - PARAGRAPH_TIE), (1 - PARAGRAPH_TIE, PARAGRAPH_TIE))
    line_tie = ((LINE_TIE, 1 - LINE_TIE), (1 - LINE_TIE, LINE_TIE))
    nodes: list[int] = []
    index: list[int] = []
    shares: list[float] = []
    starts: list[int] = []
    pending: list[int] = []
    for no, line in enumerate(markdown.split("\n"), 1):
        if not line.strip():
            if fence is None:
                paragraph = -1
            continue
        if paragraph < 0:
            paragraph = len(parents)
            parents.append(0)
            odds.append(0.0)
            ties.append(paragraph_tie)
        node = len(parents)
        parents.append(paragraph)
        odds.append(0.0)
        ties.append(line_tie)
        nodes.append(node)
        numbers.append(no)
        fenced = line.lstrip().startswith("```")
        if fence is not None or fenced:  # code belongs to what is around it, and nearly always to the content
            fence = None if fence is not None and fenced else fence or "```"
            odds[node] = 2.5
            continue
        mark = _MD_MARK.match(line)
        body = line[mark.end() :]
        links = _MD_LINK.findall(body)
        plain = _MD_LINK.sub(r"\1", body) if links else body
        plain = plain.strip("*_ ")
        linked = sum(len(t) for t, _ in links) / max(1, len(plain))
        kind = ("h1" if len(mark.group(1)) == 1 else "h") if mark.group(1) else "li" if mark.group(2) else "td" if body.startswith("|") else "p"
        key = letters(plain)
        told = found.get("#" + key if kind[0] == "h" else key, found.get(key if kind[0] == "h" else "#" + key)) if key else None
        if told is not None:
            odds[node] = PAGE_WEIGHT * _logit(told)
            continue
        total, known, score = len(key), 0, 0.0
        if found and key:
            parts = [t for t, _ in links] if linked > 0.8 and len(links) > 1 else _SPLIT.split(plain)
            for part in parts if len(parts) > 1 else ():
                piece = letters(part)
                if piece and piece in found:
                    known += len(piece)
                    score += len(piece) * _logit(found[piece])
        if known and known >= LEAST_FOUND * total:
            odds[node] = PAGE_WEIGHT * score / known
            continue
        starts.append(len(index))
        pending.append(node)
        features, own = text_features(plain, linked, sum("://" not in h for _, h in links), sum("://" in h for _, h in links), kind, hashes)
        index += features
        shares += own
    if pending:
        for node, z in zip(pending, np.add.reduceat(model.weights[index] * np.array(shares), starts).tolist()):
            odds[node] = z
    if not nodes:
        return []
    chances = sum_product(parents, odds, [ties[1] if t is None else t for t in ties])
    return [(no, chances[k]) for no, k in zip(numbers, nodes)]


def _logit(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return math.log(p / (1 - p))


def training_pages(pages: DataFrame, text_col: str = "html", id_col: str = "page_id") -> list[str]:
    """Up to ``TRAINING_PAGES`` pages whose markup labels itself, of those with the lowest hashes of their ids: the same in every run."""
    hashed = pages.where(F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("bigint")).alias("h"), F.col(text_col).alias("t"))
    lowest = hashed.select("h").distinct().orderBy("h").limit(TRAINING_CANDIDATES).collect()  # hashes first: pages go nowhere but those
    if not lowest:
        return []
    marked = hashed.where(F.col("h") <= lowest[-1].h).where(F.col("t").rlike("<(article|main|nav|aside|footer)\\b"))
    return [r.t for r in marked.distinct().orderBy("h", "t").limit(TRAINING_PAGES).collect()]


def label_content(extracted: DataFrame, pages: DataFrame, *, id_col: str = "page_id", text_col: str = "markdown", html_col: str = "html") -> DataFrame:
    """``(page_id, line_no, content, line)``: the probability that each line that is not blank is main body.

    Rows delivered twice count once. Texts without a page, or with a null or empty one, are read by themselves;
    null and blank texts give no row; an empty table on either side gives what the other allows. One shuffle of
    both texts by id; the potentials (512 KB) are trained on the driver on at most ``TRAINING_PAGES`` pages.
    """
    spark = extracted.sparkSession
    model = spark.sparkContext.broadcast(train(training_pages(pages, html_col, id_col)))
    texts = extracted.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(text_col).alias("m")).where("page_id is not null and m is not null and trim(m) != ''").dropDuplicates(["page_id"])
    bodies = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).alias("h")).where("page_id is not null").dropDuplicates(["page_id"])
    both = texts.join(bodies, "page_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            ids, numbers, chances, lines = [], [], [], []
            for page, text, html in zip(*(c.to_pylist() for c in batch.columns)):
                split = text.split("\n")
                for no, chance in line_marginals(text, html, model.value, hashes):
                    ids.append(page)
                    numbers.append(no)
                    chances.append(chance)
                    lines.append(split[no - 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(chances, pa.float64()), pa.array(lines, pa.string())], names=["page_id", "line_no", "content", "line"])

    return both.mapInArrow(run, "page_id bigint, line_no int, content double, line string")


def main_body(labelled: DataFrame, least: float = 0.5) -> DataFrame:
    """``(page_id, body, kept_lines)``: the lines of the main body of each page, in order."""
    kept = labelled.where(F.col("content") >= least).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return kept.select("page_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"), F.size("l").alias("kept_lines"))
