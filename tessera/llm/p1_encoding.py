"""Problem 1: text that was decoded with the wrong character encoding.

Round-trip repair: a piece of text is encoded again under the encoding it may have been read with, decoded strictly
under the one it may have been written in, and this is repeated for nested layers as long as a garbling cost drops.
The cost is the number of bits that a character bigram model needs, trained on clean sentences of the corpus's
languages (`train_costs`), so it also tells one Cyrillic code page read as another.
"""

from __future__ import annotations

import codecs
import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import escape, unescape

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of characters that a worker counts at once before it hands their counts on; all are counted.
COUNTED = 1_000_000
#: A pair of characters as one number: the first one's code point is shifted by so many bits.
PAIR_SHIFT = 21
#: Encodings a text may have been read with by mistake, and those it may have been written in. Fixed values.
WESTERN = ("cp1252", "mac_roman", "cp850", "cp437")
CYRILLIC = ("cp1251", "koi8_r", "koi8_u", "cp866", "iso8859_5")
CENTRAL = ("cp1250", "iso8859_2")
JAPANESE = ("shift_jis", "euc_jp")
READ_AS = WESTERN + CYRILLIC + CENTRAL
#: Written in, and read as. Fixed values.
CONFUSED = (("utf_8",), READ_AS), (CYRILLIC, CYRILLIC + WESTERN + CENTRAL), (WESTERN, WESTERN + ("cp1251", "cp866", "koi8_r", "cp1250")), (CENTRAL, CENTRAL + WESTERN + ("cp1251",)), (JAPANESE, WESTERN + ("cp1251",))
#: Marks that are at home beside the words of any clean text, whatever the training sentences have. Fixed values.
HOME_MARKS = "–—‘’‚“”„…«»·©®°№€•→←×±§¶™¡¿ªº²³¼½¾£、。「」・"
#: Bits that a repair must save: one into UTF-8, which proves itself by its bytes, and one between code pages.
UTF8_BITS, PAGE_BITS = 9.0, 14.0
#: The same for single words that are odd in themselves and no longer so when undone, and for those of three letters.
ALONE_BITS, SHORT_BITS = 2.0, 12.0
#: The same where no word of the text is odd in itself, so that only letters speak for the code page.
PLAIN_BITS, PLAIN_WORDS = 24.0, 3
#: Characters in a row beyond ASCII, as no word has them that mixes them with others: what another script reads as.
FOREIGN_RUN = 4
#: A token of at most so many bits a character (and four more) reads like clean text.
CLEAN_BITS = 6.0
#: Tokens, and pairs of characters, remembered by a worker; emptied when full.
REMEMBERED = 200_000

_TOKEN = regex.compile(r"[^ \t\r\n\f]*[^\x00-\x7f \t\r\n\f][^ \t\r\n\f]*")
_LOST = "\N{REPLACEMENT CHARACTER}"
_PART = regex.compile(r"<(script|style|template|pre|code|textarea|svg)\b.*?</\1\s*>|<!--.*?-->|<[a-zA-Z/!?][^>]*>", regex.S | regex.I)
#: A character reference, and one of the character that stands for lost ones.
_REFERENCE = regex.compile(r"&(?:#[xX]?[0-9a-fA-F]|[a-zA-Z])")
_LOST_REFERENCE = regex.compile(r"&#(?:0*65533(?!\d)|[xX]0*[fF]{3}[dD](?![0-9a-fA-F]))")
#: Code samples, and the white space that stands for one while a title is repaired.
_BACKTICKS = regex.compile(r"(`+)[^`].*?\1|\f")
#: What no word of any language has: a mark between letters, a sign before one or a mark of typesetting after one, a
#: foreign capital after a small letter, two alphabets in one word, a control character.
_MARK_IN_WORD = regex.compile(r"(?<=[\p{L}\p{M}])[^\p{L}\p{M}\p{N}\x00-\x7f\u200b-\u200f\u2060’‘´·‧…–—‐‑“”«»、。「」・]+(?=\p{L})|(?<=\p{L})ˆ(?=\p{L})")
_SIGN_AT_WORD = regex.compile(r"(?<![\p{L}\p{M}\p{N}])[\xa2\xa4-\xa6\xa8-\xaa\xac\xae-\xb3\xb6\xb8-\xba\xbc-\xbe\xf7†‡ˆ˜¸‹›‰⌐¬◊∆∏∑∫√∞≈≠≤≥](?=\p{L}\p{Ll})|(?<=\p{L})[\xa4-\xa6\xa8\xac\xaf\xb1\xb8\xbc-\xbeˆ˜‚„‰⌐◊∆∏∑∫√](?![\p{L}\p{N}])|[\u2500-\u259f](?=[^\x00-\x7f\u2500-\u259f\s])|[\u2500-\u259f](?=\p{L})|(?<=\p{L})[\u2500-\u259f]")
_CAPITAL_IN_WORD = regex.compile(r"(?<=\p{Ll})(?![A-Z])\p{Lu}|(?<=[A-Z]{2})(?![a-z])\p{Latin}(?<=\p{Ll})|(?<=\p{Lu})(?![A-Z])\p{Lu}(?=\p{Ll})")
#: What is left of a dash, an apostrophe or quotes whose later bytes are lost: no letter of its own in any language.
_LOST_BYTES = regex.compile(r"(?<![^ \t\r\n\f])[âÃÂ](?![^ \t\r\n\f])|(?<=[a-z]n)ât\b|(?<![^ \t\r\n\f])â\p{L}[^â\n]*\p{L}â(?!\p{L})")
#: The same at the end of a word or one letter before, where no joined names begin.
_CAPITAL_AT_END = regex.compile(r"(?<=\p{Ll}{2})(?![A-Z])\p{Lu}\p{Ll}?(?![\p{L}\p{M}])")
_MIXED = regex.compile(r"\p{Latin}(?=[\p{Cyrillic}\p{Han}\p{Hiragana}\p{Katakana}])|[\p{Cyrillic}\p{Han}\p{Hiragana}\p{Katakana}](?=\p{Latin})|\p{Cyrillic}(?=\p{Han})|\p{Han}(?=\p{Cyrillic})")
_CONTROL = regex.compile(r"[\x80-\x9f]")
#: First and later bytes of UTF-8 as the usual code pages show them, which few words have side by side.
_LEAD_PAIR = regex.compile(r"[ÂÃâÅÄ][^\p{L}\x00-\x7f–—…“”’«»]|[ÂÃ][ƒŠŒŽšœžŸªº]|[ВГвРС][^\p{L}\x00-\x7f–—…“”’«»]|\u0432\u0402|ã[\x80-\xbf‚ƒ„]")
_CYRILLIC_WORD = regex.compile(r"(?<!\p{Latin})\p{Cyrillic}{3,}(?!\p{Latin})")
_FOREIGN = regex.compile(rf"[^\x00-\x7f]{{{FOREIGN_RUN},}}")
_CAPITALS = regex.compile(r"(?![A-Z])\p{Lu}(?![A-Z])\p{Lu}")
_LETTER = regex.compile(r"\p{L}")
_LATIN = regex.compile(r"\p{Latin}")
_WIDE_LETTER = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_ESCAPED = regex.compile(r"[\udc80-\udcff]")


def _table(name: str) -> dict[int, int]:
    """Code point to byte; bytes an encoding leaves open stand for the control characters, as browsers read them."""
    out = {}
    for byte in range(256):
        try:
            char = bytes([byte]).decode(name)
        except UnicodeDecodeError:
            char = chr(byte)
        out.setdefault(ord(char), byte)
    if name == "cp1252":  # the same bytes read as Latin-1
        out |= {c: c for c in range(0x80, 0xA0)}
    return out


def _decoded(raw: bytes, name: str) -> str | None:
    try:
        text = raw.decode(name)
    except UnicodeDecodeError:
        if name in ("utf_8", "shift_jis", "euc_jp"):
            return None
        text = "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in raw)
    return text


def neutral_bits(char: str) -> float:
    """Bits of a character in a clean text of whatever language, by its script alone."""
    point = ord(char)
    if point < 0x80:
        return 6.0
    if 0x80 <= point < 0xA0 or char == _LOST:
        return 24.0
    if char in HOME_MARKS:
        return 8.0
    if char.isalpha():
        if point < 0x250 or 0x1E00 <= point < 0x1F00:
            return 10.0
        if 0x410 <= point < 0x450 or 0x3040 <= point < 0x3100:
            return 6.0
        if 0x4E00 <= point < 0xA000:
            return 11.0
        return 12.0 if 0x250 <= point < 0x370 else 8.0
    if unicodedata.category(char)[0] == "M":
        return 16.0 if 0x300 <= point < 0x370 else 8.0  # letters that need no separate accent have none
    return 11.0


class PairBits(dict):
    """Bits of a pair of characters, None of one that was not trained: sorted arrays, and a dict of those asked for."""

    def __init__(self, codes: np.ndarray, bits: np.ndarray) -> None:
        super().__init__()
        self.codes, self.bits = codes, bits

    def __missing__(self, pair: str) -> float | None:
        code = ord(pair[0]) << PAIR_SHIFT | ord(pair[1])
        at = int(np.searchsorted(self.codes, code))
        if len(self) >= REMEMBERED:
            self.clear()
        self[pair] = bits = float(self.bits[at]) if at < len(self.codes) and self.codes[at] == code else None
        return bits


@dataclass
class Costs:
    """Bits of a character after another one: of the trained languages, and of any language."""

    pairs: PairBits
    single: dict[str, float]
    unknown: float
    neutral: dict[str, float] = field(default_factory=dict)

    def of(self, text: str, trained: bool = False) -> float:
        """Bits of ``text``; with ``trained`` its letters must be those of the trained languages."""
        total, before, pairs, neutral = 0.0, " ", self.pairs, self.neutral
        for char in text:
            known = pairs[before + char]
            if known is None:
                known = self.single.get(char, self.unknown) + 3.0
                any_language = neutral.get(char)
                if any_language is None:
                    any_language = neutral[char] = neutral_bits(char)
                if any_language > 20:
                    known = any_language
                elif any_language < known and (not trained or char < "\x80" or not char.isalpha() or char in self.single):
                    known = any_language
            total += known
            before = char
        return total


def oddness(text: str) -> float:
    """Bits for what no word has in any language."""
    return (8.0 * len(_MARK_IN_WORD.findall(text)) + 6.0 * len(_SIGN_AT_WORD.findall(text)) + 5.0 * len(_CAPITAL_IN_WORD.findall(text)) + 4.0 * len(_CAPITAL_AT_END.findall(text))
            + 10.0 * len(_MIXED.findall(text)) + 4.0 * len(_LEAD_PAIR.findall(text)) + 6.0 * len(_CONTROL.findall(text)))


def pair_counts(sentences: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of characters as numbers, and their counts, for each part of the text; a pair comes again in other parts.

    A sentence begins and ends with a space. Capitals count too, since headings may be set in them.
    """
    joined = f" {' '.join(sentences)} " if sentences else ""
    for text, weight in ((joined, 4), (joined.upper(), 1), (joined.title(), 1)):
        for at in range(0, len(text) - 1, COUNTED):
            points = np.frombuffer(text[at : at + COUNTED + 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            codes, counts = np.unique(points[:-1] << PAIR_SHIFT | points[1:], return_counts=True)
            yield codes, weight * counts


def costs_of(codes: np.ndarray, counts: np.ndarray) -> Costs:
    """The bigram model of pairs that come once each, and their counts."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    before, after = codes >> PAIR_SHIFT, codes & (1 << PAIR_SHIFT) - 1
    first, second = np.bincount(before, counts), np.bincount(after, counts)
    total = int(counts.sum()) + 1
    single = {chr(c): -math.log2(second[c] / total) for c in np.flatnonzero(second).tolist()}
    weight = 12.0
    back = second[after] / total
    bits = -np.log2((counts + weight * back) / (first[before] + weight))
    return Costs(PairBits(codes, bits), single, math.log2(total) + 3)


def train_costs(sentences: Iterable[str]) -> Costs:
    """The bigram model of clean sentences."""
    total: Counter = Counter()
    for codes, counts in pair_counts(list(sentences)):
        for code, n in zip(codes.tolist(), counts.tolist()):
            total[code] += n
    return costs_of(np.fromiter(total.keys(), np.int64, len(total)), np.fromiter(total.values(), np.int64, len(total)))


def trained_costs(samples: DataFrame, sample_col: str = "sample_text") -> Costs:
    """As :func:`train_costs`, of all rows of ``samples``: workers count the pairs, the driver gets each pair once with its sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, counts in (counted for batch in batches for counted in pair_counts(batch.column(0).to_pylist())):
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["pair", "n"])

    counted = samples.select(sample_col).where(F.col(sample_col).isNotNull()).mapInArrow(run, "pair bigint, n bigint")
    summed = counted.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return costs_of(summed["pair"].to_numpy(), summed["n"].to_numpy())


@dataclass(frozen=True)
class Chain:
    """Read as ``read``, but written in ``written``."""

    read: str
    written: str

    @property
    def utf8(self) -> bool:
        return self.written == "utf_8"

    @property
    def foreign(self) -> bool:
        """Letters of another script look like Latin ones or marks: words have long runs of them."""
        return self.read in WESTERN + CENTRAL and self.written in CYRILLIC + JAPANESE or self.written in JAPANESE


@dataclass
class Repairer:
    """Finds and undoes wrong decodings; one per worker."""

    costs: Costs
    tables: dict[str, dict[int, int]] = field(default_factory=lambda: {name: _table(name) for name in READ_AS})
    chains: list[Chain] = field(default_factory=lambda: [Chain(r, w) for written, read in CONFUSED for w in written for r in read if w != r])
    seen: dict[str, tuple] = field(default_factory=dict)

    def undo(self, text: str, chain: Chain) -> str:
        """``text`` undone; a code page must hold for all of it, and of UTF-8 every longest run that can be undone is."""
        table, name = self.tables[chain.read], chain.written
        try:
            undone = _decoded(codecs.charmap_encode(text, "strict", table)[0], name)
            if undone is not None:
                return undone
        except UnicodeEncodeError:
            pass
        if not chain.utf8:
            return text
        out, run = [], []

        def flush() -> None:
            if run:
                raw = "".join(run)
                encoded = codecs.charmap_encode(raw, "strict", table)[0]
                undone = _decoded(encoded, name)
                if undone is None:  # bytes that are no UTF-8 stay the characters they were read as
                    undone = _ESCAPED.sub(lambda m: bytes([ord(m.group()) - 0xDC00]).decode(chain.read, "ignore") or chr(ord(m.group()) - 0xDC00), encoded.decode(name, "surrogateescape"))
                out.append(undone)
                run.clear()

        for char in text:
            if ord(char) in table:
                run.append(char)
            else:
                flush()
                out.append(char)
        flush()
        return "".join(out)

    def token(self, token: str) -> tuple[dict[int, float], bool, dict[int, float], dict[int, bool]]:
        """Of the chains that change the token: the gain, the gain if it may stand alone, whether letters stay; and whether the token is odd.

        In the order gains, odd, fit, kept.
        """
        known = self.seen.get(token)
        if known is None:
            odd, bits = oddness(token), self.costs.of(token)
            gains, fit, kept, letters = {}, {}, {}, len(_LETTER.findall(token))
            # reads like the clean sentences do, and has no character that none of them has
            likely = not odd and not _CAPITALS.search(token) and bits <= CLEAN_BITS * len(token) + 4 and all(c < "\x80" or c in self.costs.single or c in HOME_MARKS for c in token)
            for k, chain in enumerate(() if likely else self.chains):
                if not letters and not chain.utf8:
                    continue  # a dash or a copyright sign alone says nothing about code pages
                undone = self.undo(token, chain)
                if undone == token:
                    continue
                after = oddness(undone)
                kept[k] = chain.utf8 or chain.foreign or len(_LETTER.findall(undone)) >= letters
                gains[k] = bits + odd - self.costs.of(undone, not chain.utf8) - after
                if chain.utf8:  # a sequence of three bytes, or one of marks only, proves itself where it gives a usual character
                    good = odd > after or (len(undone) <= len(token) - 2 or not letters) and (odd > 0 or all(c < "\x80" or c in HOME_MARKS or c in self.costs.single for c in undone))
                    fit[k] = gains[k] if good else 0.0
                elif odd > after == 0:  # a name may have letters that no trained language has
                    gain = gains[k] if chain.foreign else max(gains[k], bits + odd - self.costs.of(undone))
                    fit[k] = gain if self.fits(token, undone, chain, gain) else 0.0
            known = (gains, odd > 0, fit, kept)
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[token] = known
        return known

    def fits(self, token: str, undone: str, chain: Chain, gain: float) -> bool:
        """Whether a single word may be undone amid clean text: what changes becomes letters, and they make one word."""
        if chain.foreign:
            return _FOREIGN.search(token) is not None and not (_WIDE_LETTER.search(undone) and _LATIN.search(undone))
        if len(undone) != len(token) or not all(b.isalpha() for a, b in zip(token, undone) if a != b):
            return False
        letters = len(_LETTER.findall(undone))
        return letters > 3 or letters == 3 and gain >= SHORT_BITS

    def chain_of(self, text: str) -> tuple[int, bool] | None:
        """The chain that lowers the cost of ``text`` most, if any does by enough; whether it holds for most words."""
        tokens = Counter(_TOKEN.findall(text))
        gains, votes, odd_votes, words = defaultdict(float), defaultdict(int), defaultdict(int), 0
        alone, rank = defaultdict(float), defaultdict(float)
        cyrillic = _CYRILLIC_WORD.search(text) is not None
        for token, times in tokens.items():
            by_chain, odd, fit, kept = self.token(token)
            words += bool(_LETTER.search(token))
            for k, gain in by_chain.items():
                gains[k] += gain * times
                if gain > 0 and kept[k]:  # letters do not turn into marks
                    votes[k] += 1
                    odd_votes[k] += odd
                # Cyrillic endings of Latin words are at home in a Cyrillic text
                if fit.get(k, 0.0) > 0 and not (cyrillic and self.chains[k].read in CYRILLIC and self.chains[k].written in WESTERN + CENTRAL):
                    alone[k] += fit[k] * times
                    rank[k] += gain * times
        best, most, whole = None, -math.inf, False
        for k, gain in gains.items():
            chain = self.chains[k]
            if chain.utf8:
                held, good, need = False, alone[k], UTF8_BITS
            else:
                # most words must gain, and they must be odd or so many that their letters prove it
                plain = not odd_votes[k]
                held = 2 * votes[k] > words and gain >= (PLAIN_BITS if plain else PAGE_BITS) and (not plain or votes[k] >= PLAIN_WORDS)
                if held and chain.foreign:
                    held = any(self.token(t)[0].get(k, 0.0) > 0 and _FOREIGN.search(t) for t in tokens)
                elif not held and chain.foreign and 2 * votes[k] > words:
                    held = gain >= PLAIN_BITS and any(self.token(t)[0].get(k, 0.0) > 0 and _FOREIGN.search(t) for t in tokens)
                good, need = (gain, 0.0) if held else (alone[k], ALONE_BITS)
            by = gain if held else rank[k]  # of those that will do, the one whose letters the trained languages know best
            if good >= need and good > 0 and by > most + 1e-9:
                best, most, whole = k, by, held
        return None if best is None else (best, whole)

    def apply(self, text: str, k: int, whole: bool) -> str:
        """``text`` with each token undone that gains by it; short words may lose a little where most words gain."""
        chain = self.chains[k]

        def undone(m: regex.Match) -> str:
            gains, _, fit, _ = self.token(m.group())
            gain = gains.get(k)
            if gain is None or not (gain > -8.0 if whole else gain > 0 if chain.utf8 else fit.get(k, 0.0) > 0):
                return m.group()
            return self.undo(m.group(), chain)

        return _TOKEN.sub(undone, text)

    def repair(self, text: str) -> tuple[str, list[str]]:
        """The repaired text and the layers undone, outermost first."""
        layers: list[str] = []
        while True:  # each layer lowers the cost by UTF8_BITS at least, so this ends
            found = self.chain_of(text)
            if found is None:
                break
            after = self.apply(text, *found)
            if after == text:
                break
            text = after
            layers.append("{1} read as {0}".format(self.chains[found[0]].read, self.chains[found[0]].written))
        return text, layers


def repair_title(title: str, repairer: Repairer) -> tuple[str, list[str], bool] | None:
    """A plain text: (restored, layers, whole) or None if nothing is wrong with it. Code samples are left alone."""
    if title.isascii():
        return None
    readable = _BACKTICKS.sub("\f", title)
    lost = _LOST in readable or _LOST_BYTES.search(readable) is not None
    text, layers = repairer.repair(readable)
    if not layers and not lost:
        return None
    samples = (m.group() for m in _BACKTICKS.finditer(title))
    return regex.sub("\f", lambda _: next(samples), text), layers, not lost


def repair_html(html: str, repairer: Repairer) -> tuple[str, list[str], bool] | None:
    """A page: text between tags is repaired, markup, scripts and code samples stay as they are.

    Text is read with its character references decoded; a node that is repaired is escaped again, others stay as
    they were written.
    """
    if html.isascii() and not _REFERENCE.search(html):
        return None
    parts, at, bad, lost, layers = [], 0, False, False, []
    texts: list[int] = []
    for m in _PART.finditer(html):
        if m.start() > at:
            texts.append(len(parts))
            parts.append(html[at : m.start()])
        parts.append(m.group())
        at = m.end()
    if at < len(html):
        texts.append(len(parts))
        parts.append(html[at:])
    for k in texts:
        referring = "&" in parts[k]
        text = unescape(parts[k]) if referring else parts[k]
        if text.isascii():
            continue
        # a reference to no character shows as U+FFFD too, but nothing was lost there
        lost |= _LOST in parts[k] or _LOST_BYTES.search(text) is not None or (referring and _LOST_REFERENCE.search(parts[k]) is not None)
        fixed, found = repairer.repair(text)
        if found:
            parts[k], bad = escape(fixed, quote=False) if referring else fixed, True
            layers += [x for x in found if x not in layers]
    if not bad and not lost:
        return None
    return "".join(parts), layers, not lost


def find_garbled(df: DataFrame, id_col: str, text_col: str, samples: DataFrame, *, html: bool, sample_col: str = "sample_text") -> DataFrame:
    """``(row_id, restored, layers, whole)`` of every row whose text was decoded with another encoding.

    ``restored`` is the text with all that could be undone undone; ``whole`` is false where characters were lost
    (U+FFFD), so only a part could be restored. Null and empty texts are no cases, nor are plain ASCII ones, but for
    pages with character references, which are read as the characters they stand for; repeated rows are repeated; an empty table gives an empty result. All clean sentences of
    ``samples`` train the cost model, repeated ones by their number; without any the model only knows that controls are no text.
    No shuffle of the text column, which is read in one pass; of the samples, only counts of pairs of characters are.
    """
    return _garbled(df, id_col, text_col, _shared_costs(samples, sample_col), html)


def _shared_costs(samples: DataFrame, sample_col: str = "sample_text") -> Broadcast:
    """The model at every worker; its size is that of the alphabets and not of the samples."""
    return samples.sparkSession.sparkContext.broadcast(trained_costs(samples, sample_col))


def _garbled(df: DataFrame, id_col: str, text_col: str, costs: Broadcast, html: bool) -> DataFrame:
    source = df.select(df[id_col].cast("bigint").alias("row_id"), df[text_col].alias("t"))
    worth = F.expr("octet_length(t) > char_length(t)")
    source = source.where(worth | F.col("t").rlike("&(#[xX]?[0-9a-fA-F]|[a-zA-Z])") if html else worth)
    one = repair_html if html else repair_title

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(costs.value)
        for batch in batches:
            ids, texts, layers, wholes = [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = one(text, repairer)
                if found:
                    ids.append(row)
                    texts.append(found[0])
                    layers.append(", ".join(found[1]))
                    wholes.append(found[2])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(layers, pa.string()), pa.array(wholes, pa.bool_())], names=["row_id", "restored", "layers", "whole"])

    return source.mapInArrow(run, "row_id bigint, restored string, layers string, whole boolean")


def garbled_fields(pages: DataFrame, extracted: DataFrame, samples: DataFrame) -> DataFrame:
    """``(page_id, field_name, restored, layers, whole)`` of ``pages.html`` and ``extracted.title``, each case once."""
    costs = _shared_costs(samples)
    both = [_garbled(pages, "page_id", "html", costs, True).withColumn("field_name", F.lit("html")),
            _garbled(extracted, "page_id", "title", costs, False).withColumn("field_name", F.lit("title"))]
    return both[0].unionByName(both[1]).dropDuplicates(["row_id", "field_name", "restored"]).select(F.col("row_id").alias("page_id"), "field_name", "restored", "layers", "whole")
