"""Problem 5: missing or wrong document language labels.

A bidirectional gated recurrent network reads the bytes of a line, two to a step (``STRIDE``): both bytes of a step have
its label, which halves the time and is finer than a line needs. The positions' probabilities are pooled. It is trained here, in numpy, by backpropagation through time, on clean sentences and on what
befalls them in the wild: lost accents, other letters, capitals, and sentences of two languages in one text.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled sentences train the network (they are read by the driver).
TRAINING_ROWS = 5_000
HIDDEN, STRIDE = 24, 2
TRAINING_STEPS, BATCH, CROP, RATE, SEED = 600, 64, 176, 8e-3, 11
#: Lines read at once; a longer line is read in windows of so many bytes with an overlap on either side.
LINES_AT_ONCE, WINDOW, MARGIN = 1_024, 1_024, 64
#: A line of so many words (or characters of Japanese) counts as a segment of its language.
LEAST_WORDS, LEAST_WIDE = 20, 40
#: A line that does not count is sure of its language from this confidence and so many bytes on.
SURE, SURE_BYTES = 0.9, 60
#: A second language of a text needs this confidence.
LEAST_CONFIDENCE = 0.7

#: Names and codes by language, in lower case. Fixed values.
NAMES = {
    "en": "en eng english anglais englisch inglés inglês английский англійська angielski 英語",
    "ru": "ru rus russian russe russisch ruso russo русский российский російська rosyjski ロシア語",
    "uk": "uk ukr ua ukrainian ukrainien ukrainisch ucraniano украинский українська ukraiński ウクライナ語",
    "de": "de deu ger german allemand deutsch alemán alemão немецкий німецька niemiecki ドイツ語",
    "fr": "fr fra fre french français francais französisch francés francês французский французька francuski フランス語",
    "es": "es spa spanish espagnol spanisch español espanol espanhol castellano испанский іспанська hiszpański スペイン語",
    "pt": "pt por portuguese portugais portugiesisch portugués português portugues португальский португальська portugalski ポルトガル語",
    "pl": "pl pol polish polonais polnisch polaco polonês польский польська polski ポーランド語",
    "ja": "ja jpn jp japanese japonais japanisch japonés japonês японский японська japoński 日本語",
}
_CODES = {name: code for code, names in NAMES.items() for name in names.split()}
#: Russian and Ukrainian letters in Latin ones. Fixed values.
_LATIN_RU = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh sch  y  e yu ya".split(" ")))
_LATIN_UK = _LATIN_RU | {"г": "h", "ґ": "g", "е": "e", "є": "ye", "и": "y", "і": "i", "ї": "yi", "й": "y", "х": "kh", "щ": "shch", "ь": "", "ю": "yu", "я": "ya", "'": "", "’": ""}
_ROMAN = {
    "ru": (_LATIN_RU, _LATIN_RU | {"й": "i", "щ": "shch", "ё": "e", "х": "h"}, _LATIN_RU | {"й": "j", "ц": "c", "ю": "ju", "я": "ja", "ы": "y"}),
    "uk": (_LATIN_UK, _LATIN_UK | {"г": "g", "и": "i", "ї": "i", "щ": "sch"}, _LATIN_UK | {"й": "i", "є": "ie", "ї": "i", "ю": "iu", "я": "ia"}),
}

_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_WORDS = regex.compile(r"\S*[\p{L}\p{N}]\S*")
_LETTER = regex.compile(r"\p{L}")
_FENCE = regex.compile(r"^\s*(```+|~~~+)")


def language_code(label: str | None) -> str | None:
    """The code a label names, in whatever spelling; None if it names none of the languages known here."""
    if label is None:
        return None
    bare = label.strip().lower().strip(".\"'")
    return _CODES.get(bare) or _CODES.get(regex.split(r"[-_ ;,@.(]", bare, maxsplit=1)[0])


def _plain(text: str) -> str:
    """The text without its accents."""
    text = text.translate(str.maketrans("łŁøØßæœđ", "lLoOsaod"))
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)) if not _WIDE.search(text) else text


def _romanised(text: str, table: dict[str, str]) -> str:
    """The text in Latin letters; a capital stays one."""
    out = []
    for char in text:
        latin = table.get(char.lower(), char)
        out.append(latin.capitalize() if char.isupper() and latin != char else latin)
    return "".join(out)


def variants(code: str, text: str) -> list[str]:
    """A sentence and what it may look like elsewhere, the plain sentence with the greatest weight."""
    out = [text, text, text, text, text.lower()]
    if code in _ROMAN:
        out += [_romanised(text, table) for table in _ROMAN[code]]
    elif code != "ja" and not text.isascii():
        out += [_plain(text)] * 2
    return [*out, text.upper()]


@dataclass
class Network:
    """Input tables (by byte), recurrent weights and biases of both directions, and the output layer."""

    codes: list[str]
    tables: np.ndarray  # (2 directions, STRIDE, 256, 3 * HIDDEN)
    recurrent: np.ndarray  # (2, HIDDEN, 3 * HIDDEN)
    bias: np.ndarray  # (2, 3 * HIDDEN)
    out: np.ndarray  # (2 * HIDDEN, languages)
    out_bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.tables, self.recurrent, self.bias, self.out, self.out_bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _read(net: Network, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (2, T, B, HIDDEN) over ``steps`` (T, B, STRIDE) of bytes; ``keep`` collects what backpropagation needs."""
    n, batch = steps.shape[:2]
    states = np.zeros((2, n, batch, HIDDEN), dtype=np.float32)
    h2 = 2 * HIDDEN
    for d in (0, 1):
        order = range(n) if d == 0 else range(n - 1, -1, -1)
        h = np.zeros((batch, HIDDEN), dtype=np.float32)
        gates, candidate = np.ascontiguousarray(net.recurrent[d][:, :h2]), np.ascontiguousarray(net.recurrent[d][:, h2:])
        for t in order:
            x = net.tables[d, 0][steps[t, :, 0]]
            for s in range(1, STRIDE):
                x += net.tables[d, s][steps[t, :, s]]
            x += net.bias[d]
            zr = h @ gates
            zr += x[:, :h2]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1.0
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = (r * h) @ candidate
            c += x[:, h2:]
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c
            if keep is not None:
                keep.append((d, t, h, z, r, c))
            h = new
            states[d, t] = h
    return states


def _outputs(net: Network, states: np.ndarray) -> np.ndarray:
    """Probabilities (T, B, languages) of every position."""
    logits = states[0] @ net.out[:HIDDEN] + states[1] @ net.out[HIDDEN:] + net.out_bias
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def _gradients(net: Network, steps: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over positions; ``labels`` (T, B), ``weight`` (T, B)."""
    keep: list = []
    states = _read(net, steps, keep)
    error = _outputs(net, states)
    n, batch = labels.shape
    np.put_along_axis(error, labels[:, :, None], np.take_along_axis(error, labels[:, :, None], 2) - 1, 2)
    error *= (weight / weight.sum())[:, :, None]
    flat = error.reshape(-1, error.shape[2])
    out = np.vstack([states[d].reshape(-1, HIDDEN).T @ flat for d in (0, 1)])
    back = [error @ net.out[:HIDDEN].T, error @ net.out[HIDDEN:].T]
    tables, recurrent, bias = np.zeros_like(net.tables), np.zeros_like(net.recurrent), np.zeros_like(net.bias)
    carry = np.zeros((2, batch, HIDDEN), dtype=np.float32)
    inputs = np.zeros((2, n, batch, 3 * HIDDEN), dtype=np.float32)
    h2 = 2 * HIDDEN
    for d, t, h, z, r, c in reversed(keep):
        g = back[d][t] + carry[d]
        gz = g * (h - c) * z * (1 - z)
        gc = g * (1 - z) * (1 - c * c)
        through = gc @ net.recurrent[d][:, h2:].T
        gr = through * h * r * (1 - r)
        recurrent[d][:, h2:] += (r * h).T @ gc
        gates = np.hstack([gz, gr])
        recurrent[d][:, :h2] += h.T @ gates
        carry[d] = g * z + through * r + gates @ net.recurrent[d][:, :h2].T
        inputs[d, t] = np.hstack([gates, gc])
    for d in (0, 1):
        rows = inputs[d].reshape(-1, 3 * HIDDEN)
        bias[d] = rows.sum(axis=0)
        for s in range(STRIDE):
            index = steps[:, :, s].reshape(-1)
            order = np.argsort(index, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(index[order]) > 0])
            tables[d, s][index[order][starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return [tables, recurrent, bias, out.astype(np.float32), flat.sum(axis=0)]


def train(sentences: list[tuple[str, str]], steps: int = TRAINING_STEPS, seed: int = SEED) -> Network:
    """A network for the languages of ``sentences`` (code, text), by Adam on random texts of one or two languages."""
    random = np.random.default_rng(seed)
    codes = sorted({code for code, _ in sentences})
    pool = [[v.encode("utf-8") for c, text in sentences if c == code for v in variants(code, text)] for code in codes]
    draw = lambda *shape: (random.standard_normal(shape) * 0.3).astype(np.float32)
    net = Network(codes, draw(2, STRIDE, 256, 3 * HIDDEN), draw(2, HIDDEN, 3 * HIDDEN), np.zeros((2, 3 * HIDDEN), np.float32), draw(2 * HIDDEN, len(codes)), np.zeros(len(codes), np.float32))
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    size = CROP // STRIDE
    for step in range(1, steps + 1):
        data, labels = np.full((BATCH, CROP), 32, dtype=np.uint8), np.zeros((BATCH, CROP), dtype=np.int64)
        weight = np.zeros((BATCH, CROP), dtype=np.float32)
        for b in range(BATCH):
            at, language = 0, int(random.integers(len(codes)))
            mixed = random.random() < 0.25
            while at < CROP:
                text = pool[language][int(random.integers(len(pool[language])))]
                if at == 0:
                    text = text[int(random.integers(max(1, len(text) // 2))) :]
                part = np.frombuffer(text[: CROP - at], dtype=np.uint8)
                data[b, at : at + len(part)], labels[b, at : at + len(part)] = part, language
                weight[b, at : at + len(part)] = 1
                at += len(part) + 1
                if mixed and random.random() < 0.5:
                    language = int(random.integers(len(codes)))
        grid = data.reshape(BATCH, size, STRIDE).transpose(1, 0, 2).astype(np.int64)
        wanted, by = labels[:, ::STRIDE].T, weight[:, ::STRIDE].T
        grads = _gradients(net, grid, wanted, by)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(net.weights(), grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


#: The network trained last, by what it was trained on: sessions ask for the same one again and again.
_TRAINED: dict[bytes, Network] = {}


def trained(sentences: list[tuple[str, str]]) -> Network:
    """As :func:`train`, but trained once a process for the same sentences."""
    key = xxhash.xxh3_128_digest(repr((sentences, TRAINING_STEPS, SEED)))
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = train(sentences)
    return _TRAINED[key]


def line_probabilities(net: Network, lines: list[str]) -> np.ndarray:
    """(line, language): the pooled probabilities of the positions of each line."""
    pieces, owner = [], []
    for k, line in enumerate(lines):
        raw = line.encode("utf-8", "replace")
        for start in range(0, max(1, len(raw)), WINDOW):
            pieces.append((raw[max(0, start - MARGIN) : start + WINDOW + MARGIN], min(start, MARGIN), min(WINDOW, len(raw) - start)))
            owner.append(k)
    total, weight = np.zeros((len(lines), len(net.codes))), np.zeros(len(lines))
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i][0]))
    for a in range(0, len(order), LINES_AT_ONCE):
        chosen = order[a : a + LINES_AT_ONCE]
        longest = -(-max(1, max(len(pieces[i][0]) for i in chosen)) // STRIDE)
        data = np.full((len(chosen), longest * STRIDE), 32, dtype=np.uint8)
        for b, i in enumerate(chosen):
            data[b, : len(pieces[i][0])] = np.frombuffer(pieces[i][0], dtype=np.uint8)
        grid = np.ascontiguousarray(data.reshape(len(chosen), longest, STRIDE).transpose(1, 0, 2)).astype(np.int64)
        each = _outputs(net, _read(net, grid))
        place = np.arange(longest)[:, None] * STRIDE
        start = np.array([pieces[i][1] for i in chosen])
        end = start + np.array([pieces[i][2] for i in chosen])
        inside = ((place >= start) & (place < end)).astype(np.float32)
        sums = np.einsum("tb,tbl->bl", inside, each)
        who = np.array([owner[i] for i in chosen])
        np.add.at(total, who, sums)
        np.add.at(weight, who, inside.sum(axis=0))
    return total / np.maximum(weight, 1e-9)[:, None]


def segments_of(text: str) -> list[tuple[int, str, bool]]:
    """(line number, line, whether it is long enough to count) of the lines with letters outside code."""
    out, fence = [], None
    for no, line in enumerate(text.split("\n"), 1):
        mark = _FENCE.match(line)
        if mark:
            fence = None if fence and line.strip().startswith(fence) else fence or mark.group(1)[:3]
            continue
        if fence or not _LETTER.search(line):
            continue
        long = len(line) >= LEAST_WIDE and (line.count(" ") + 1 >= LEAST_WORDS and len(_WORDS.findall(line)) >= LEAST_WORDS or (not line.isascii() and len(_WIDE.findall(line)) >= LEAST_WIDE // 2 and len(line.strip()) >= LEAST_WIDE))
        out.append((no, line, long))
    return out


def training_sentences(samples: DataFrame, code_col: str = "lang_code", text_col: str = "sample_text") -> list[tuple[str, str]]:
    rows = samples.select(code_col, text_col).where(F.col(code_col).isNotNull() & F.col(text_col).isNotNull()).limit(TRAINING_ROWS).collect()
    return sorted((r[0], r[1]) for r in rows)


def label_lines(df: DataFrame, samples: DataFrame, *, id_col: str = "page_id", text_col: str = "markdown", keep: list[str] | None = None, long_only: bool = False) -> DataFrame:
    """``(row_id, *keep, line_no, n_bytes, counts, lang_code, confidence)`` of each line with text outside code.

    ``counts`` tells whether the line is long enough to count as a segment; with ``long_only`` the others are not
    read. Null and blank texts give no row; repeated rows are repeated; an empty table gives an empty result.
    The network is trained once a process, on the driver, and sent to the workers (under 1 MB).
    """
    keep = keep or []
    net = df.sparkSession.sparkContext.broadcast(trained(training_sentences(samples)))
    source = df.select(F.col(id_col).cast("bigint").alias("row_id"), *(F.col(c) for c in keep), F.col(text_col).alias("_text")).where("_text is not null and trim(_text) != ''")
    fields = [f for f in source.schema if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", line_no int, n_bytes int, counts boolean, lang_code string, confidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for batch in batches:
            where, numbers, lines, counts = [], [], [], []
            for k, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for no, line, long in segments_of(text):
                    if long or not long_only:
                        where.append(k)
                        numbers.append(no)
                        lines.append(line)
                        counts.append(long)
            chances = line_probabilities(model, lines) if lines else np.zeros((0, len(model.codes)))
            best = chances.argmax(axis=1)
            rows = pa.RecordBatch.from_arrays(batch.columns[:-1], names=[f.name for f in fields]).take(pa.array(where, pa.int64()))
            extra = [pa.array(numbers, pa.int32()), pa.array([len(x.encode("utf-8", "replace")) for x in lines], pa.int32()), pa.array(counts, pa.bool_()),
                     pa.array([model.codes[b] for b in best], pa.string()), pa.array(chances[np.arange(len(best)), best], pa.float64())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *extra], names=[*rows.schema.names, "line_no", "n_bytes", "counts", "lang_code", "confidence"])

    return source.mapInArrow(run, schema)


def language_segments(lines: DataFrame) -> DataFrame:
    """``(row_id, segment_no, first_line, last_line, lang_code, confidence, n_bytes)``: runs of lines in one language.

    ``lines`` comes from :func:`label_lines`. A short line that is not sure of its language (see ``SURE``) goes with
    the sure line before it, or the next one if there is none before. ``confidence`` is the mean over the bytes of the
    lines that are of the segment's language by themselves.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("row_id").orderBy("line_no")  # as many rows as a text has lines
    past, future = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    sure = F.when(F.col("counts") | ((F.col("confidence") >= SURE) & (F.col("n_bytes") >= SURE_BYTES)), F.col("lang_code"))
    rows = lines.withColumn("own", F.col("lang_code")).withColumn("sure", sure)
    rows = rows.withColumn("lang_code", F.coalesce(F.last("sure", True).over(past), F.first("sure", True).over(future), F.col("own")))
    fresh = F.coalesce((F.lag("lang_code").over(order) != F.col("lang_code")).cast("int"), F.lit(1))
    rows = rows.withColumn("fresh", fresh).withColumn("segment_no", F.sum("fresh").over(past).cast("int"))
    weight = F.when(F.col("own") == F.col("lang_code"), F.col("n_bytes"))
    mean = F.sum(F.col("confidence") * weight) / F.sum(weight)
    return rows.groupBy("row_id", "segment_no", "lang_code").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), mean.alias("confidence"), F.sum("n_bytes").alias("n_bytes"))


def document_labels(segments: DataFrame) -> DataFrame:
    """``(row_id, lang_code, confidence, share)``: the language of most of each text, by bytes, and its part of them."""
    by = segments.groupBy("row_id", "lang_code").agg(F.sum("n_bytes").alias("n"), (F.sum(F.col("confidence") * F.col("n_bytes")) / F.sum("n_bytes")).alias("confidence"))
    best = by.groupBy("row_id").agg(F.max(F.struct("n", "lang_code", "confidence")).alias("b"), F.sum("n").alias("total"))
    return best.select("row_id", F.col("b.lang_code").alias("lang_code"), F.col("b.confidence").alias("confidence"), (F.col("b.n") / F.col("total")).alias("share"))


def document_languages(df: DataFrame, samples: DataFrame, *, id_col: str = "page_id", text_col: str = "markdown", label_col: str = "label") -> DataFrame:
    """``(row_id, label, lang_code, confidence, share, main_code)``: each language that counts in each text.

    ``confidence`` is the mean over its lines, ``share`` its part of the bytes of lines that count, ``main_code``
    the language of most of them. A language that is not the main one needs ``LEAST_CONFIDENCE``.
    """
    lines = label_lines(df, samples, id_col=id_col, text_col=text_col, keep=[label_col], long_only=True).where("counts")
    whole = lines.groupBy("row_id", label_col, "lang_code").agg(F.sum("n_bytes").alias("n_bytes"), F.max("confidence").alias("best"), (F.sum(F.col("confidence") * F.col("n_bytes")) / F.sum("n_bytes")).alias("confidence"))
    per = whole.groupBy("row_id", label_col).agg(F.sum("n_bytes").alias("total"), F.max_by("lang_code", F.struct("n_bytes", "lang_code")).alias("main_code"), F.collect_list(F.struct("lang_code", "n_bytes", "best", "confidence")).alias("l"))
    flat = per.select("row_id", label_col, "total", "main_code", F.inline("l"))
    flat = flat.where((F.col("lang_code") == F.col("main_code")) | (F.col("best") >= LEAST_CONFIDENCE))
    return flat.select("row_id", F.col(label_col).alias("label"), "lang_code", "confidence", (F.col("n_bytes") / F.col("total")).alias("share"), "main_code")


def wrong_labels(df: DataFrame, samples: DataFrame, *, id_col: str = "page_id", text_col: str = "markdown", label: str = "meta.lang") -> DataFrame:
    """``(page_id, lang_code, confidence, share)``: one row for each language of each affected record, once.

    Affected: the label is missing or names no language, names another one than most of the text, or the text has
    two languages. Records without a line that counts give nothing. Null structs have no label.
    """
    named = df.select(F.col(id_col), F.col(text_col), F.col(label).alias("label")).distinct()
    found = document_languages(named, samples, id_col=id_col, text_col=text_col)
    known = F.create_map(*[F.lit(x) for pair in sorted(_CODES.items()) for x in pair])
    bare = F.regexp_replace(F.lower(F.trim(F.col("label"))), "^[.\"']+|[.\"']+$", "")
    code = F.coalesce(F.try_element_at(known, bare), F.try_element_at(known, F.element_at(F.split(bare, r"[-_ ;,@.(]"), 1)))
    several = F.count(F.lit(1)).over(_by_row()) > 1
    found = found.withColumn("several", several).withColumn("named", code)
    affected = F.col("named").isNull() | (F.col("named") != F.col("main_code")) | F.col("several")
    return found.where(affected).select(F.col("row_id").alias("page_id"), "lang_code", "confidence", "share").dropDuplicates(["page_id", "lang_code"])


def _by_row():
    from pyspark.sql import Window

    return Window.partitionBy("row_id", "label")  # as many rows as languages
