"""Problem 9: cutting oversized texts at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import TOKENIZER_FILE, Encoder, encoder
from tessera.llm.common import if_small
from tessera.session import settle

#: Code points of one range of a long text, and of the halo that its neighbours share with it.
RANGE_CHARS = 65_536
HALO_CHARS = 2_048
#: A natural boundary is taken only if the piece then fills this part of its limit; else a weaker boundary is tried.
LEAST_FILL = 0.5
#: Kinds of boundaries, strongest last.
ANY, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)

#: Words of more tokens than this may be cut inside.
LONG_WORD_TOKENS = 24

_PARAGRAPHS = regex.compile(r"\n[ \t]*\n\s*")
#: What a character may be to a cut, as bits of one table over the code points below 2 ** 16. Fixed values.
_END, _WIDE_END, _CLOSER, _STOP, _WIDE_STOP, _SPACE, _FEED = (1 << k for k in range(7))
_CLASS = np.zeros(1 << 16, dtype=np.uint8)
for _bit, _chars in ((_END, ".!?…"), (_WIDE_END, "。！？"), (_CLOSER, "\"'”’»)]」』"), (_STOP, ",;:–—"), (_WIDE_STOP, "、，；："), (_FEED, "\n")):
    for _char in _chars:
        _CLASS[ord(_char)] |= _bit
for _point in range(0x3001):
    if chr(_point).isspace():
        _CLASS[_point] |= _SPACE
_SYNC = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])")


def encoded(text: str, words: Encoder) -> tuple[list[str], list[tuple[int, ...]]]:
    """The words of the tokenizer in ``text`` and their ids."""
    split = words.split.findall(text)
    return split, list(map(words.words.__getitem__, split))


def boundary_kinds(text: str, places: np.ndarray) -> np.ndarray:
    """How natural a cut at each place is, by the characters around it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    padded = np.zeros(len(points) + 3, dtype=np.uint8)
    padded[2:-1] = _CLASS[np.minimum(points, 0xFFFF)]
    two, one, after = padded[places], padded[places + 1], padded[places + 2]
    space, ended = (after & _SPACE) > 0, one | np.where((one & _CLOSER) > 0, two, 0)
    kinds = np.where(space | ((one & _SPACE) > 0), SPACE, ANY).astype(np.int8)
    kinds[(space & ((one & _STOP) > 0)) | ((one & _WIDE_STOP) > 0)] = CLAUSE
    kinds[(space & ((ended & _END) > 0)) | ((ended & _WIDE_END) > 0)] = SENTENCE
    kinds[(one & _FEED) > 0] = LINE
    ends = np.fromiter((m.end() for m in _PARAGRAPHS.finditer(text)), dtype=np.int64)
    ends = ends[ends >= places[0]]  # the places may be those of a part of the text
    if len(ends):
        found = np.searchsorted(places, ends, side="right") - 1
        kinds[found[(ends - places[found] <= 1)]] = PARAGRAPH
    return kinds


def boundary_table(text: str, words: Encoder, known: tuple | None = None, around: tuple[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places where ``text`` may be cut: code point offsets, tokens before them, kind, whether inside a word.

    Ends of words of the tokenizer are cheap to cut, since the ids on both sides stay as they are; a word of many
    tokens also offers its inner token ends that lie between two code points. ``around`` is a longer text and where
    ``text`` begins in it: the first and the last place are typed by the characters on both sides of them.
    """
    split, ids = known or encoded(text, words)
    n = len(split)
    places, tokens = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=n), out=places[1:])
    np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=n), out=tokens[1:])
    more_places, more_tokens = [], []
    for k in np.flatnonzero(np.diff(tokens) > LONG_WORD_TOKENS).tolist():
        for place, inner in inner_ends(split[k], ids[k], words.pieces):
            more_places.append(int(places[k]) + place)
            more_tokens.append(int(tokens[k]) + inner)
    inside = np.zeros(n + 1, dtype=bool)
    if more_places:
        places, tokens = np.concatenate([places, more_places]), np.concatenate([tokens, more_tokens])
        inside = np.concatenate([inside, np.ones(len(more_places), dtype=bool)])
        order = np.argsort(places, kind="stable")
        places, tokens, inside = places[order], tokens[order], inside[order]
    longer, begin = around or (text, 0)
    return places, tokens, boundary_kinds(longer, places + begin), inside


def inner_ends(word: str, ids: tuple[int, ...], pieces: dict[int, bytes]) -> list[tuple[int, int]]:
    """(code points, tokens) before each token end inside ``word`` that lies between two code points."""
    starts, size = {}, 0
    for k, c in enumerate(word):
        starts[size] = k
        size += len(c.encode("utf-8", "surrogatepass"))
    out, size = [], 0
    for inner, i in enumerate(ids[:-1], 1):
        size += len(pieces[i])
        if size in starts:
            out.append((starts[size], inner))
    return out


class Cutter:
    """Cuts one text that comes in ranges, in order; holds the piece it is at and one range, whatever the text's length.

    Each piece ends at the strongest boundary that leaves it at least half full, within the limit by its own count; the
    next one starts at the last boundary that leaves at least ``overlap`` tokens shared, but after the start of the
    piece before, and so that it ends after it. A piece that has more tokens by itself than in the whole text (a word
    was cut inside) is cut again with a limit lower by the excess.
    """

    def __init__(self, limit: int, overlap: int, words: Encoder) -> None:
        self.limit, self.overlap, self.words = limit, max(0, min(overlap, limit - 1)), words
        self.text, self.base = "", 0
        self.places, self.tokens = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.kinds, self.inside = np.zeros(1, dtype=np.int8), np.zeros(1, dtype=bool)
        self.first, self.end, self.done = 0, 0, False

    def feed(self, text: str, table: tuple, final: bool) -> list[tuple[int, int, int, int, str]]:
        """The pieces (start, end, n_tokens, shared, piece) that end in this range; after the last one all of them have come.

        ``table`` is the range's :func:`boundary_table`, with places relative to the range.
        """
        places, tokens, kinds, inside = table
        at = self.base + len(self.text)
        self.places = np.concatenate([self.places[:-1], places + at])
        self.tokens = np.concatenate([self.tokens[:-1], tokens + self.tokens[-1]])
        self.kinds, self.inside = np.concatenate([self.kinds[:-1], kinds]), np.concatenate([self.inside[:-1], inside])
        self.text += text
        if final and not self.end and self.tokens[-1] <= self.limit:
            return []  # the text is within its limit
        out = []
        while not self.done and (cut := self._next(final)) is not None:
            first, place, size = cut
            a, b = int(self.places[first]), int(self.places[place])
            out.append((a, b, size, max(0, self.end - a), self.text[a - self.base : b - self.base]))
            self.end, self.done = b, place == len(self.places) - 1 and final
            back = int(np.searchsorted(self.tokens, self.tokens[place] - self.overlap, side="right")) - 1 if self.overlap else place
            self.first = min(max(back, first + 1), place)
        self._forget()
        return out

    def _next(self, final: bool) -> tuple[int, int, int] | None:
        """(first, cut, n_tokens) of the next piece, which ends after the one before; None if more of the text is needed."""
        first = self.first
        while True:
            found = self._cut(first, final)
            if found is None or self.places[found[0]] > self.end or found[0] == len(self.places) - 1:
                return found and (first, *found)
            first += 1  # less overlap than asked for

    def _cut(self, first: int, final: bool) -> tuple[int, int] | None:
        last, limit = len(self.places) - 1, self.limit
        while True:
            end = int(np.searchsorted(self.tokens, self.tokens[first] + limit, side="right")) - 1
            if end >= last:
                if not final:
                    return None
                cut = last
            else:
                end = max(end, first + 1)  # a single character of more tokens than the limit can't be cut
                # enough that the next piece, which repeats the overlap, still goes forward
                enough = max(int(limit * LEAST_FILL), min(self.overlap, limit - 1) + 1)
                least = max(first + 1, int(np.searchsorted(self.tokens, self.tokens[first] + enough)))
                cut = end
                if least <= end:
                    window = self.kinds[least : end + 1]
                    top = window.max()
                    if top > ANY:
                        cut = least + int(np.flatnonzero(window == top)[-1])
            size = self._size(first, cut)
            if size <= self.limit or limit <= 1 or self.places[cut] - self.places[first] <= 1:
                return cut, size
            limit = max(1, limit - (size - self.limit))

    def _size(self, i: int, j: int) -> int:
        """Tokens of a piece encoded by itself.

        A piece between two word ends has the words of the whole text, but for white space at its end, whose words
        join; a piece that begins or ends inside a word is encoded again.
        """
        a, b = int(self.places[i]), int(self.places[j])
        piece = self.text[a - self.base : b - self.base]
        if self.inside[i] or self.inside[j]:
            return self.words.count(piece)
        bare = len(piece.rstrip())
        if bare == len(piece):
            return int(self.tokens[j] - self.tokens[i])
        k = int(np.searchsorted(self.places, a + bare))
        if self.places[k] == a + bare:
            return int(self.tokens[k] - self.tokens[i]) + self.words.count(piece[bare:])
        return self.words.count(piece)

    def _forget(self) -> None:
        k = self.first
        if k:
            start = int(self.places[k])
            self.text, self.base = self.text[start - self.base :], start
            self.places, self.tokens, self.kinds, self.inside = self.places[k:], self.tokens[k:], self.kinds[k:], self.inside[k:]
            self.first = 0


_PIECE = "doc_id bigint, source string, piece_no int, start_char bigint, end_char bigint, n_tokens int, shared_chars int, piece string"
_PIECE_NAMES = [x.split()[0] for x in _PIECE.split(", ")]
_PIECE_KINDS = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
#: Characters of pieces or ranges in one batch that goes back to Spark.
BATCH_CHARS = 4_000_000


class _Batches:
    """Rows gathered to Arrow batches of about ``BATCH_CHARS`` characters."""

    def __init__(self, names: list[str], kinds: list[pa.DataType]) -> None:
        self.names, self.kinds, self.rows, self.chars = names, kinds, [], 0

    def add(self, row: tuple, chars: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars
        if self.chars >= BATCH_CHARS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows), self.kinds)], names=self.names)
            self.rows, self.chars = [], 0


def split_oversized(documents: DataFrame, limits: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    tokenizer: str = TOKENIZER_FILE, range_chars: int = RANGE_CHARS, halo_chars: int = HALO_CHARS) -> DataFrame:
    """Ordered pieces of every text above its source's limit.

    Columns: ``doc_id, source, piece_no`` (from 1), ``start_char, end_char`` (code points, end excluded),
    ``n_tokens`` (of the piece encoded by itself), ``shared_chars`` (its overlap with the piece before),
    ``piece``. Texts within their limit, null and empty texts, null sources and sources without a positive limit
    give nothing. A source listed twice has its lowest limit. A row delivered twice gives its pieces twice.

    All texts are cut by the same rule (:class:`Cutter`), so ``range_chars`` and ``halo_chars`` change no piece. Texts
    up to ``range_chars`` are one range and cut by the worker that reads them. Longer ones go on as ranges with halos,
    sliced in one pass; each range is encoded by itself from its first to its last safe place (a halo without one is
    widened), and the boundary tables are stitched, summed and cut in order by a worker that holds one range at a time.
    """
    rules = limits.where("source is not null and max_tokens > 0").groupBy("source").agg(
        F.min(F.col("max_tokens").cast("int")).alias("max_tokens"), F.coalesce(F.max(F.col("overlap_tokens").cast("int")), F.lit(0)).alias("overlap_tokens"))
    texts = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    # every token has at least one byte: shorter texts are within the limit without counting
    texts = texts.join(if_small(settle(rules)), "source").where(F.octet_length("text") > F.col("max_tokens")).select("doc_id", "source", "text", "max_tokens", "overlap_tokens")
    small = texts.where(F.char_length("text") <= range_chars)
    long = texts.where(F.char_length("text") > range_chars)
    return _split_small(small, tokenizer).unionByName(_split_long(long, tokenizer, range_chars, halo_chars))


def _split_small(texts: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        out = _Batches(_PIECE_NAMES, _PIECE_KINDS)
        for batch in batches:
            for doc, source, text, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                known = encoded(text, words)
                if sum(map(len, known[1])) <= limit:
                    continue
                pieces = Cutter(limit, overlap, words).feed(text, boundary_table(text, words, known), final=True)
                for no, (a, b, n, shared, piece) in enumerate(pieces, 1):
                    yield from out.add((doc, source, no, a, b, n, shared, piece), len(piece))
        yield from out.flush()

    return texts.mapInArrow(run, _PIECE)


def _split_long(texts: DataFrame, tokenizer: str, size: int, halo: int) -> DataFrame:
    """Range by range; see :func:`split_oversized`."""
    head = "row bigint, doc_id bigint, source string, max_tokens int, overlap_tokens int, range_no int, final boolean"
    head_kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    head_names = [x.split()[0] for x in head.split(", ")]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every range with its halos; a halo without a safe place is widened until it has one or the text ends."""
        out = _Batches([*head_names, "left", "chunk"], [*head_kinds, pa.int32(), pa.string()])
        for batch in batches:
            for k in range(batch.num_rows):
                row, doc, source, text, limit, overlap = (c[k].as_py() for c in batch.columns)
                n = -(-len(text) // size)
                for no in range(n):
                    begin, end = max(0, no * size - halo), min(len(text), (no + 1) * size)
                    upto, wide = min(len(text), end + halo), halo
                    while upto < len(text) and not _SYNC.search(text, end, upto):
                        wide *= 2
                        upto = min(len(text), end + wide)
                    yield from out.add((row, doc, source, limit, overlap, no, no == n - 1, no * size - begin, text[begin : min(len(text), upto + halo)]), upto - begin + halo)
        yield from out.flush()

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text of a range between its first and its last safe place, and its boundary table."""
        words = encoder(tokenizer)
        out = _Batches([*head_names, "text", "places", "tokens", "kinds", "inside"], [*head_kinds, pa.string(), *[pa.binary()] * 4])
        for batch in batches:
            for k in range(batch.num_rows):
                *keys, no, final, left, chunk = (c[k].as_py() for c in batch.columns)
                safe = lambda at: next((m.start() for m in _SYNC.finditer(chunk, at)), len(chunk))  # noqa: B023, E731
                first = 0 if no == 0 else safe(left)
                last = len(chunk) if final else max(first, safe(left + size))
                text = chunk[first:last]
                table = boundary_table(text, words, around=(chunk, first))
                arrays = (table[0].astype("<i8"), table[1].astype("<i8"), table[2].astype("i1"), table[3].astype("i1"))
                yield from out.add((*keys, no, final, text, *(x.tobytes() for x in arrays)), 20 * len(table[0]) + len(text))
        yield from out.flush()

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges sorted by row and number to pieces; state: the text that is being cut."""
        words = encoder(tokenizer)
        out = _Batches(_PIECE_NAMES, _PIECE_KINDS)
        at, cutter, count = None, None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                row, doc, source, limit, overlap, _, final, text, *table = (c[k].as_py() for c in batch.columns)
                if row != at:
                    at, cutter, count = row, Cutter(limit, overlap, words), 0
                table = tuple(np.frombuffer(x, dtype=t) for x, t in zip(table, ("<i8", "<i8", "i1", "?")))
                for count, (a, b, n, shared, piece) in enumerate(cutter.feed(text, table, final), count + 1):
                    yield from out.add((doc, source, count, a, b, n, shared, piece), len(piece))
        yield from out.flush()

    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text", "max_tokens", "overlap_tokens")
    ranges = rows.mapInArrow(slices, f"{head}, left int, chunk string").repartition("row", "range_no")
    known = ranges.mapInArrow(tables, f"{head}, text string, places binary, tokens binary, kinds binary, inside binary")
    return known.repartition("row").sortWithinPartitions("row", "range_no").mapInArrow(stitched, _PIECE)
