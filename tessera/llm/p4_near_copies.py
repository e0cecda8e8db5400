"""Problem 4: near-duplicate records, by anchor points of a covering code.

A text's fingerprint is a word of N_SYMBOLS symbols over the field of MODULUS elements, symbol i being the minimum of
its word shingles under hash function i; two texts of similarity s agree in each symbol with probability s. The
anchors are the words of the Reed-Solomon code of dimension DIMENSION: the values of a polynomial of that many
coefficients at N_SYMBOLS points. The code is maximum distance separable: any DIMENSION symbols of a fingerprint fix
exactly one code word, so its covering radius is N_SYMBOLS - DIMENSION, and the code words within it are exactly the
polynomials through DIMENSION of the symbols. Every fingerprint is replicated to all of them. Two fingerprints at most
N_SYMBOLS - DIMENSION apart agree in DIMENSION symbols and so meet at an anchor that lies within the covering radius of
both; the threshold adds nothing to the radius here. Texts that meet are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import if_small
from tessera.session import settle

WORDS = regex.compile(r"[\p{L}\p{N}]+")
SHINGLE, LEAST_WORDS = 5, 60
#: Fingerprint: at a similarity of 0.6 two texts meet with probability 0.988, at 0.7 with 0.998, at 0.8 with 0.9999.
N_SYMBOLS, DIMENSION = 10, 3
MODULUS = (1 << 31) - 1
#: Bins of the one-permutation sketch that texts are compared by at an anchor before they are compared exactly, and the
#: standard deviations by which a pair at the wanted similarity may differ more than expected there (a loss of 3e-5).
SKETCH_BINS, SKETCH_SIGMAS = 128, 4.0
#: Members of an anchor up to which its pairs are written as they are. Those of anchors with more are cut into blocks of
#: so many, and every two blocks are compared in place.
RUN, BLOCK = 64, 2_048
#: Members up to which a shingle is counted pair by pair, and shingles of one slice of the matrices for the others.
FEW, SLICE = 8, 2_048
#: So many bare ids may be broadcast (some 50 MB) to save a shuffle of the texts; more are joined by shuffle.
IDS_BROADCAST = 2_000_000
#: Texts whose words a worker holds at once.
ROWS_AT_ONCE = 2_000
#: Words remembered by a worker; emptied when full.
REMEMBERED = 300_000
_SEED = 20_240_607


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of each number."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(texts: list[str | None], size: int = SHINGLE, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, its distinct shingles sorted, offsets) of all texts with at least ``least_words`` words."""
    which, counts, flat = [], [], []
    for k, text in enumerate(texts):
        if text is None:
            continue
        words = WORDS.findall(text.lower())
        if len(words) >= max(least_words, size):
            which.append(k)
            counts.append(len(words))
            flat += map(_HASHES.__getitem__, words)
    if not which:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(1, np.int64)
    words = np.array(flat, dtype=np.uint64)
    n = np.array(counts)
    total = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(0x100000001B3 + 2 * k) + _mixed(words[k : len(words) - size + 1 + k] + np.uint64(k))
    hashes = _mixed(total)
    starts = np.r_[0, np.cumsum(n)[:-1]]
    owner = np.repeat(np.arange(len(n)), n)[: len(hashes)]
    inside = (np.arange(len(hashes)) - starts[owner]) <= n[owner] - size
    hashes, owner = hashes[inside], owner[inside]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
    hashes, owner = hashes[fresh], owner[fresh]
    return np.array(which), hashes, np.searchsorted(owner, np.arange(len(n) + 1))


def symbols(hashes: np.ndarray, offsets: np.ndarray, n_symbols: int = N_SYMBOLS) -> np.ndarray:
    """The fingerprint of each text as a row of ``n_symbols`` field elements."""
    random = np.random.default_rng(_SEED)
    out = np.zeros((len(offsets) - 1, n_symbols), dtype=np.int64)
    for k in range(n_symbols):
        a, b = (np.uint64(int(x) | 1) for x in random.integers(1, 1 << 62, 2))
        low = np.minimum.reduceat((hashes * a + b) ^ (hashes >> np.uint64(33)), offsets[:-1])
        out[:, k] = (_mixed(low) % np.uint64(MODULUS)).astype(np.int64)
    return out


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Four 64-bit numbers a text: which of ``SKETCH_BINS`` bins have a shingle (two), and a bit of the lowest in each."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    bins = (hashes >> np.uint64(57)).astype(np.int64)
    first = np.r_[True, (owner[1:] != owner[:-1]) | (bins[1:] != bins[:-1])]
    full, bit = np.zeros((n, SKETCH_BINS), dtype=np.uint8), np.zeros((n, SKETCH_BINS), dtype=np.uint8)
    full[owner[first], bins[first]] = 1
    bit[owner[first], bins[first]] = (_mixed(hashes[first]) >> np.uint64(17)).astype(np.uint8) & 1
    return np.hstack([np.packbits(x, axis=1).view(np.int64) for x in (full, bit)])


def _inverse(x: int) -> int:
    return pow(x, MODULUS - 2, MODULUS)


def anchors(words: np.ndarray, dimension: int = DIMENSION) -> np.ndarray:
    """The code words within the covering radius of each fingerprint, as one 64-bit number of their coefficients each.

    Newton's interpolation through every choice of ``dimension`` of the symbols, at the points 1, 2, …
    """
    n = words.shape[1]
    out = np.zeros((len(words), len(list(combinations(range(n), dimension)))), dtype=np.uint64)
    for column, chosen in enumerate(combinations(range(n), dimension)):
        points = [c + 1 for c in chosen]
        table = [words[:, c].copy() for c in chosen]
        coefficients = []
        for level in range(dimension):
            coefficients.append(table[0])
            table = [((b - a) % MODULUS) * _inverse((points[i + level + 1] - points[i]) % MODULUS) % MODULUS for i, (a, b) in enumerate(zip(table, table[1:]))]
        # Newton's form to plain coefficients, so that all choices on the same code word give the same number
        plain = [np.zeros(len(words), dtype=np.int64) for _ in range(dimension)]
        for level in reversed(range(dimension)):
            shifted = [np.zeros(len(words), dtype=np.int64), *plain[:-1]]
            plain = [(s - p * points[level]) % MODULUS for s, p in zip(shifted, plain)]
            plain[0] = (plain[0] + coefficients[level]) % MODULUS
        key = np.zeros(len(words), dtype=np.uint64)
        for p in plain:
            key = _mixed(key * np.uint64(0x100000001B3) + p.astype(np.uint64) + np.uint64(1))
        out[:, column] = key
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``ROWS_AT_ONCE`` rows, which bounds the words held at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = batch.column(1).to_pylist()
        which, hashes, offsets = shingles(texts)
        names = ["scrape_id", "class_a", "class_b", "text_a", "text_b", "symbols", "sketch"]
        if not len(which):
            continue
        words = symbols(hashes, offsets)
        sums = np.add.reduceat(_mixed(hashes), offsets[:-1])
        xors = np.bitwise_xor.reduceat(_mixed(hashes + np.uint64(7)), offsets[:-1])
        exact = np.frombuffer(b"".join(xxhash.xxh3_128_digest(texts[k]) for k in which), dtype=np.int64).reshape(-1, 2)
        four = pa.FixedSizeListArray.from_arrays(pa.array(sketches(hashes, offsets).reshape(-1)), 4).cast(pa.list_(pa.int64()))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(words.reshape(-1)), N_SYMBOLS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(ids[which], pa.int64()), pa.array(sums.view(np.int64)), pa.array(xors.view(np.int64)), pa.array(exact[:, 0]), pa.array(exact[:, 1]), lists, four], names=names)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each fingerprint and anchor; anchors that a fingerprint meets several times once."""
    for batch in _slices(batches):
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        words = np.asarray(batch.column(1).flatten()).reshape(-1, N_SYMBOLS)
        keys = np.sort(anchors(words), axis=1)
        fresh = np.c_[np.ones(len(keys), dtype=bool), keys[:, 1:] != keys[:, :-1]]
        rows = np.repeat(ids, fresh.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(keys[fresh].view(np.int64)), pa.array(rows, pa.int64())], names=["anchor", "id"])


def classes_of(df: DataFrame, id_col: str = "scrape_id", text_col: str = "markdown") -> DataFrame:
    """``(scrape_id, rep, text, symbols, sketch)``. Settled.

    Texts with the same set of shingles share a representative, the lowest id; equal texts also share ``text``, the
    lowest id among them.
    """
    source = df.select(df[id_col].cast("bigint").alias("scrape_id"), df[text_col].alias("t")).where("scrape_id is not null and t is not null")
    kinds = "scrape_id bigint, class_a bigint, class_b bigint, text_a bigint, text_b bigint, symbols array<bigint>, sketch array<bigint>"
    prints = settle(source.mapInArrow(_fingerprints, kinds))
    texts = prints.groupBy("class_a", "class_b", "text_a", "text_b").agg(F.min("scrape_id").alias("text"))
    names = texts.join(texts.groupBy("class_a", "class_b").agg(F.min("text").alias("rep")), ["class_a", "class_b"])
    named = prints.join(names, ["class_a", "class_b", "text_a", "text_b"])
    return settle(named.select("scrape_id", "rep", "text", "symbols", "sketch").dropDuplicates(["scrape_id"]))


def _alike(least: float) -> Column:
    """Whether the sketches l0…l3 and r0…r3 differ in no more bits than texts of that similarity do."""
    both = [F.col(f"l{k}").bitwiseAND(F.col(f"r{k}")) for k in (0, 1)]
    differ = [F.col(f"l{k + 2}").bitwiseXOR(F.col(f"r{k + 2}")).bitwiseAND(both[k]) for k in (0, 1)]
    n, d = (F.bit_count(x[0]) + F.bit_count(x[1]) for x in (both, differ))
    rate = (1 - least) / 2
    return d <= n * rate + SKETCH_SIGMAS * F.sqrt(n * rate * (1 - rate)) + 1


def _pairs_of_runs(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, id) sorted by both to pairs of ids with the same anchor, (a, b, null).

    The members of an anchor with more than ``most`` (``RUN``) of them come out as (id, null, anchor) instead.
    """
    most = most or RUN

    def out(a: np.ndarray, b: np.ndarray | None, anchor: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if anchor is None else pa.array(anchor)], names=["a", "b", "anchor"])

    def met(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        lengths = np.diff(np.r_[starts, len(keys)])
        hot = np.repeat(lengths > most, lengths)
        if hot.any():
            yield out(ids[hot], None, keys[hot])
            keys, ids = keys[~hot], ids[~hot]
        left, right = [], []
        for apart in range(1, len(keys)):
            same = keys[apart:] == keys[:-apart]
            if not same.any():
                break
            left.append(ids[:-apart][same])
            right.append(ids[apart:][same])
        if left:
            yield out(np.concatenate(left), np.concatenate(right), None)

    keys, ids, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        more, who = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if hot is not None:  # the run before is known to be hot and goes on
            going = int(np.searchsorted(more, hot, side="right"))
            if going:
                yield out(who[:going], None, more[:going])
                more, who = more[going:], who[going:]
        keys, ids = np.concatenate([keys, more]), np.concatenate([ids, who])
        if not len(keys):
            continue
        hot = None
        cut = int(np.searchsorted(keys, keys[-1], side="left"))  # the last run may go on
        if cut:
            yield from met(keys[:cut], ids[:cut])
        keys, ids = keys[cut:], ids[cut:]
        if len(keys) > most:
            hot = keys[0]
            yield out(ids, None, keys)
            keys, ids = keys[:0], ids[:0]
    if len(keys):
        yield from met(keys, ids)


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, most: int | None = None) -> np.ndarray:
    """(left, right): how many shingles two sets share, for the members at the places ``left`` and ``right``.

    Shingles of up to ``most`` (``FEW``) members are counted pair by pair, the others as a product of 0/1 matrices in slices.
    """
    most = most or FEW
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    row_of, column_of = np.full(len(sets), -1), np.full(len(sets), -1)
    row_of[left], column_of[right] = np.arange(len(left)), np.arange(len(right))
    order = np.lexsort((owner, column))
    owner, column = owner[order], column[order]
    few = (times[column] > 1) & (times[column] <= most)
    who, what = owner[few], column[few]
    for apart in range(1, most):
        same = what[apart:] == what[:-apart]
        if not same.any():
            break
        x, y = who[:-apart][same], who[apart:][same]
        for i, j in ((x, y), (y, x)):
            met = (row_of[i] >= 0) & (column_of[j] >= 0)
            np.add.at(out, (row_of[i[met]], column_of[j[met]]), 1)
    many = np.flatnonzero(times > most)
    place = np.full(len(times), -1)
    place[many] = np.arange(len(many))
    kept = place[column] >= 0
    who, what = owner[kept], place[column[kept]]
    for start in range(0, len(many), SLICE):
        chosen = (what >= start) & (what < start + SLICE)
        held = np.zeros((len(sets), min(SLICE, len(many) - start)), dtype=np.float32)
        held[who[chosen], what[chosen] - start] = 1
        out += held[left] @ held[right].T
    return out


def _links_in_blocks(least: float, most: int):
    """Rows (anchor, low, high, block, id, set) sorted by the first three to the links (a, b, similarity) of two blocks, or of one."""

    def links(keys: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
        block, ids = keys[:, 3], keys[:, 4]
        sets = [np.frombuffer(x, dtype=np.uint64) for x in raw]
        across = len(set(block.tolist())) > 1
        left, right = (np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())) if across else (np.arange(len(ids)),) * 2
        sizes = np.array([len(x) for x in sets], dtype=np.float32)
        both = _common(sets, left, right, most)
        similar = both / (sizes[left][:, None] + sizes[right][None] - both)
        i, j = np.nonzero((similar >= least - 1e-6) & (True if across else ids[left][:, None] < ids[right][None]))
        exact = both[i, j].astype(np.float64) / (sizes[left][i].astype(np.float64) + sizes[right][j] - both[i, j])
        x, y = ids[left][i], ids[right][j]
        keep = exact >= least
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep]), pa.array(exact[keep])], names=["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, raw = np.zeros((0, 5), np.int64), []
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = np.concatenate([rest, np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:5]])])
            raw += batch.column(5).to_pylist()
            starts = np.flatnonzero(np.r_[True, (rest[1:, :3] != rest[:-1, :3]).any(axis=1)])
            for start, end in zip(starts[:-1], starts[1:]):
                yield links(rest[start:end], raw[start:end])
            rest, raw = rest[starts[-1] :], raw[starts[-1] :]  # the last blocks may go on
        if len(rest):
            yield links(rest, raw)

    return run


def _hot_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``(a, b, similarity)`` of the members (anchor, id) of hot anchors with their ``sets`` (id, set), compared exactly in place.

    Members are dealt to blocks, and every two blocks of an anchor meet in a task of their own: no pair leaves it that
    is no link, and no task holds more than two blocks. Of anchors with the same members only one is read.
    """
    named = members.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("y"))
    sizes = named.groupBy("n", "x", "y").agg(F.min("anchor").alias("anchor")).select("anchor", F.ceil(F.col("n") / BLOCK).cast("bigint").alias("blocks"))
    cut = members.join(sizes, "anchor").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    cut = cut.withColumn("partner", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    cut = cut.select("anchor", F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"), "block", "id").join(sets, "id")
    cut = cut.select("anchor", "low", "high", "block", "id", "set").repartition("anchor", "low", "high").sortWithinPartitions("anchor", "low", "high")
    return cut.mapInArrow(_links_in_blocks(least, FEW), "a bigint, b bigint, similarity double")


def meetings(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)``, a < b, of representatives that meet at an anchor and whose sketches are alike; members ``(anchor, id)`` of hot anchors.

    Anchors are sorted once and read as runs. Those with more than ``RUN`` members are hot: their pairs are not
    written, see :func:`_hot_links`.
    """
    reps = classes.where("scrape_id = rep")
    rows = reps.select("rep", "symbols").mapInArrow(_anchor_rows, "anchor bigint, id bigint")
    runs = rows.repartition("anchor").sortWithinPartitions("anchor", "id").mapInArrow(lambda batches, most=RUN: _pairs_of_runs(batches, most), "a bigint, b bigint, anchor bigint")
    runs = settle(runs.distinct())
    met = runs.where("anchor is null").select("a", "b")
    marks = {x: reps.select(F.col("rep").alias(i), *(F.col("sketch")[k].alias(f"{x}{k}") for k in range(4))) for x, i in (("l", "a"), ("r", "b"))}
    alike = met.join(marks["l"], "a").join(marks["r"], "b").where(_alike(least)).select("a", "b")
    return alike, runs.where("anchor is not null").select("anchor", F.col("a").alias("id"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        ids = batch.column(0).to_pylist()
        which, hashes, offsets = shingles(batch.column(1).to_pylist())
        raw = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in which], pa.int64()), pa.array(raw, pa.binary())], names=["id", "set"])


def _similar(least: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = np.zeros(len(part))
            for k, (x, y) in enumerate(zip(part["set_a"], part["set_b"])):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                low, high = sorted((len(p), len(q)))
                if low < least * high:
                    continue
                at = np.minimum(np.searchsorted(p, q), len(p) - 1)
                both = int((p[at] == q).sum())
                out[k] = both / (len(p) + len(q) - both)
            keep = out >= least
            yield pd.DataFrame({"a": part["a"][keep], "b": part["b"][keep], "similarity": out[keep]})

    return run


def near_links(df: DataFrame, *, id_col: str = "scrape_id", text_col: str = "markdown", least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b, similarity)`` between representatives of texts with different shingles, and ``classes_of`` the table.

    Similarity: of all distinct sequences of five words in either text, the part that is in both. Texts under
    ``LEAST_WORDS`` words, null texts and null ids take no part; repeated rows count once.
    """
    classes = classes_of(df, id_col, text_col)
    pairs, hot = meetings(classes, least)
    pairs = settle(pairs)
    texts = df.select(df[id_col].cast("bigint").alias("id"), df[text_col].alias("t")).where("t is not null")

    def sets_of(ids: DataFrame) -> DataFrame:
        return texts.join(if_small(settle(ids), IDS_BROADCAST), "id", "left_semi").mapInArrow(_sets, "id bigint, set binary").dropDuplicates(["id"])

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    links = joined.mapInPandas(_similar(least), "a bigint, b bigint, similarity double")
    if not hot.isEmpty():
        links = links.unionByName(_hot_links(hot, sets_of(hot.select("id").distinct()), least)).dropDuplicates(["a", "b"])
    return settle(links), classes


def near_pairs(df: DataFrame, *, id_col: str = "scrape_id", text_col: str = "markdown", least: float = 0.8) -> DataFrame:
    """``(scrape_a, scrape_b, similarity)``, scrape_a < scrape_b, of all rows.

    Between different texts: all pairs, also where the texts have the same shingles. Between equal texts: each copy
    with the lowest id among them, so copies of one text add rows in proportion to their number and never in pairs.
    """
    links, classes = near_links(df, id_col=id_col, text_col=text_col, least=least)
    texts = classes.where("scrape_id = text").select("rep", "text")
    left, right = (texts.select(F.col("rep").alias(r), F.col("text").alias(t)) for r, t in (("a", "p"), ("b", "q")))
    alike = links.join(left, "a").join(right, "b").select("p", "q", "similarity")
    alike = alike.unionByName(left.join(right, F.col("a") == F.col("b")).where("p < q").select("p", "q", F.lit(1.0).alias("similarity")))
    members = [classes.select(F.col("text").alias(t), F.col("scrape_id").alias(x)) for t, x in (("p", "x"), ("q", "y"))]
    across = alike.join(members[0], "p").join(members[1], "q").select("x", "y", "similarity")
    copies = classes.where("scrape_id != text").select(F.col("scrape_id").alias("x"), F.col("text").alias("y"), F.lit(1.0).alias("similarity"))
    return across.unionByName(copies).select(F.least("x", "y").alias("scrape_a"), F.greatest("x", "y").alias("scrape_b"), "similarity")


def near_groups(df: DataFrame, *, id_col: str = "scrape_id", text_col: str = "markdown", least: float = 0.8) -> DataFrame:
    """``(scrape_id, class_id, group_id, links)``: one row per text of at least ``LEAST_WORDS`` words.

    ``class_id`` is the lowest id whose text has the same shingles, ``group_id`` the lowest id that links lead to,
    ``links`` the number of other classes it is alike to.
    """
    from tessera.llm.groups import connected

    links, classes = near_links(df, id_col=id_col, text_col=text_col, least=least)
    groups = connected(links.select("a", "b"))
    degrees = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    out = classes.select("scrape_id", "rep").join(groups.withColumnRenamed("id", "rep"), "rep", "left").join(degrees, "rep", "left")
    return out.select("scrape_id", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
