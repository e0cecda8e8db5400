import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import p8_mix, p9_split
from tessera.llm.bpe import SPLIT, TOKENIZER_FILE, encoder, merge_word
from tessera.llm.p7_encode import encode_texts

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER_FILE), reason="no tokenizer files")


def _reference():
    import tiktoken

    with open(TOKENIZER_FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


REFERENCE = _reference() if os.path.exists(TOKENIZER_FILE) else None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_as_the_public_library(text):
    assert encoder().encode(text) == REFERENCE.encode_ordinary(text)


def test_long_words_and_special_strings():
    rng = random.Random(1)
    for text in ("a" * 5_000, "ab" * 3_000, "".join(rng.choice("abcdeñж漢") for _ in range(4_000)), "<|endoftext|>", "x <|endoftext|>y", "\n\n \t\n", "don't we'LL 'sx"):
        assert encoder().encode(text) == REFERENCE.encode_ordinary(text)
        assert encoder().decode(encoder().encode(text)).decode() == text
    assert encoder().encode(None) == encoder().encode("") == []


def test_leftmost_of_equal_ranks():
    ranks = {bytes([c]): c for c in range(256)} | {b"aa": 300}
    assert merge_word(b"aaa", ranks) == [300, 97] and merge_word(b"aaaaa", ranks) == [300, 300, 97]


DOCS = "doc_id bigint, text string, source string, n_tokens int, ids string"


def test_encode_any_rows(spark):
    rows = spark.createDataFrame([(1, "a b", "s", 0, "x"), (2, None, None, None, None), (None, "", "s", 1, ""), (1, "a b", "s", 0, "x")], DOCS)
    out = encode_texts(rows)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r.doc_id or 0, r.ids) for r in out.collect()) == [(0, []), (1, [64, 275]), (1, [64, 275]), (2, [])]
    assert encode_texts(rows.where("false")).count() == 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_mix_reaches_its_shares(spark):
    rng = random.Random(5)
    rows = [(k, "w " * rng.randint(1, 40), "abc"[k % 3], None, None) for k in range(90)] + [(900, "only one", "small", None, None), (901, None, "a", None, None), (902, "", "a", None, None), (903, "x", None, None, None), (904, "x y", "untargeted", None, None)]
    docs = spark.createDataFrame(rows + rows[:5], DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 1), ("small", 0.05, 3), ("absent", 0.1, 5), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mixed = p8_mix.mix(docs, targets, exact=True)
    got = {r.source: r for r in p8_mix.shares(mixed, targets).collect()}
    used = sum(r.used_tokens for r in got.values())
    sizes = {s: sum(encoder().count(r[1]) for r in rows if r[2] == s) for s in ("a", "b", "c", "small")}
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.15), ("small", 0.05)):
        assert abs(got[source].used_tokens - share * used) <= 2, source
    assert got["absent"].used_tokens == 0 and got["absent"].actual_share == 0
    assert any(got[s].used_tokens == sizes[s] * c for s, c in (("a", 1), ("b", 2), ("c", 1), ("small", 3)))
    each = mixed.groupBy("source", "doc_id").count().collect()
    assert all(r["count"] <= {"a": 1, "b": 2, "c": 1, "small": 3}[r.source] for r in each)
    pieces = sorted((r.source, r.start_token, r.used_tokens) for r in mixed.collect())
    for (s, a, n), (t, b, _) in zip(pieces, pieces[1:]):
        assert s != t or a + n == b  # the line of a source has no gap and no overlap
    assert sorted(map(tuple, p8_mix.mix(docs, targets, exact=True).collect())) == sorted(map(tuple, mixed.collect()))
    fixed = {r.source: r.used_tokens for r in p8_mix.shares(p8_mix.mix(docs, targets, total_tokens=100), targets).collect()}
    assert fixed["a"] == 50 and fixed["b"] == 30 and fixed["small"] == min(5, 3 * sizes["small"])


def test_mix_takes_as_many_tokens_as_the_documents_have(spark):
    rows = [(k, "w " * (1 + k % 7), "ab"[k % 2], None, None) for k in range(60)] + [(900, "only one", "small", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.7, 2), ("small", 0.1, 3)], "source string, target_share double, max_repeats int")
    size = {s: sum(encoder().count(r[1]) for r in rows if r[2] == s) for s in ("a", "b", "small")}
    total = sum(size.values())
    got = {r.source: r for r in p8_mix.shares(p8_mix.mix(docs, targets), targets).collect()}
    wanted = {"a": int(0.2 * total + 1e-6), "b": int(0.7 * total + 1e-6), "small": 3 * size["small"]}
    assert {s: r.used_tokens for s, r in got.items()} == wanted
    assert all(abs(r.actual_share - wanted[s] / sum(wanted.values())) < 1e-9 for s, r in got.items()) and got["b"].most_repeats == 2


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "s", None, None)], DOCS)
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert p8_mix.mix(docs.where("false"), targets).count() == 0
    assert p8_mix.mix(docs, targets.where("false")).count() == 0
    assert p8_mix.shares(p8_mix.mix(docs.where("false"), targets), targets).first().used_tokens == 0


def _texts():
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "Приложение", "東京の天気"]) for _ in range(rng.randint(3, 14))) + rng.choice([". ", "! ", "。", ", "])
    plain = ["".join(sentence() + rng.choice(["", "", "\n", "\n\n", "   "]) for _ in range(rng.randint(1, 60))) for _ in range(25)]
    return [*plain, "x" * 9_000, "漢" * 3_000, "a \n \n b\n\n\n" * 300, " " * 2_000, "🙂" * 700, "word " * 3, "", None]


@pytest.mark.parametrize("size,halo", [(65_536, 2_048), (700, 120)])
def test_pieces(spark, size, halo):
    texts = _texts()
    docs = spark.createDataFrame([(k, t, "s" if k % 2 else "r", 0, "i") for k, t in enumerate(texts)] + [(500, "x " * 500, None, 0, "")], DOCS)
    limits = spark.createDataFrame([("s", 48, 8), ("r", 64, 0), ("r", 90, 0), (None, 5, 1), ("z", 0, 0)], "source string, max_tokens int, overlap_tokens int")
    out = p9_split.split_oversized(docs, limits, range_chars=size, halo_chars=halo)
    by: dict = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    count = encoder().count
    for k, text in enumerate(texts):
        limit, overlap = (48, 8) if k % 2 else (64, 0)
        if count(text) <= limit:
            assert k not in by
            continue
        pieces = sorted(by[k], key=lambda r: r.piece_no)
        assert [p.piece_no for p in pieces] == list(range(1, len(pieces) + 1))
        end = 0
        for p in pieces:
            assert p.piece == text[p.start_char : p.end_char] and p.n_tokens == count(p.piece) <= limit
            assert p.start_char == end - p.shared_chars and p.end_char > end
            if p.piece_no > 1 and overlap:
                assert p.shared_chars > 0
            end = p.end_char
        assert end == len(text)
        if not overlap:
            assert "".join(p.piece for p in pieces) == text
    assert 500 not in by
    assert p9_split.split_oversized(docs.where("false"), limits).count() == 0
    assert p9_split.split_oversized(docs, limits.where("false")).count() == 0


def test_cuts_are_natural(spark):
    text = "First part of it. Second part, with a clause in it. " * 6 + "\n\n" + "Another paragraph follows here and goes on. " * 8
    docs = spark.createDataFrame([(1, text, "s", 0, "")], DOCS)
    limits = spark.createDataFrame([("s", 90, 0)], "source string, max_tokens int, overlap_tokens int")
    pieces = [r.piece for r in p9_split.split_oversized(docs, limits).orderBy("piece_no").collect()]
    assert pieces[0].endswith("\n\n") and all(p.rstrip().endswith(".") for p in pieces)


def test_ranges_cut_where_the_whole_text_is_cut(spark):
    rng = random.Random(12)
    sentence = lambda: " ".join(rng.choice(("harbour", "boat", "old", "counts", "names", "night")) for _ in range(rng.randint(2, 6))) + rng.choice((". ", ", ", "! ", ".\n", ".\n\n"))
    texts = [(k, "s", "".join(sentence() for _ in range(150))) for k in range(12)]
    docs = spark.createDataFrame(texts, "doc_id bigint, source string, text string")
    limits = spark.createDataFrame([("s", 14, 3)], "source string, max_tokens int, overlap_tokens int")
    cut = lambda size: sorted((r.doc_id, r.piece_no, r.start_char, r.end_char) for r in p9_split.split_oversized(docs, limits, range_chars=size, halo_chars=80).collect())
    assert cut(150) == cut(1_000_000)


def test_every_length_has_one_rule(spark):
    rows = [(k, t, "s" if k % 2 else "r", 0, "i") for k, t in enumerate(_texts())]
    docs = spark.createDataFrame(rows + rows[3:5], DOCS)
    limits = spark.createDataFrame([("s", 48, 8), ("r", 64, 0)], "source string, max_tokens int, overlap_tokens int")
    whole, ranges = (sorted(map(tuple, p9_split.split_oversized(docs, limits, range_chars=size, halo_chars=halo).collect())) for size, halo in ((1 << 30, 2_048), (300, 60)))
    assert whole == ranges
    assert all(whole.count(r) == (2 if r[0] in (3, 4) else 1) for r in whole)  # a row delivered twice


def test_a_cutter_holds_one_range(spark):
    words = encoder()
    text = "The harbour office counts the boats. " * 4_000
    cutter, most, pieces = p9_split.Cutter(60, 10, words), 0, []
    for start in range(0, len(text), 370):
        part = text[start : start + 370]
        pieces += cutter.feed(part, p9_split.boundary_table(part, words), start + 370 >= len(text))
        most = max(most, len(cutter.text))
    assert pieces[-1][1] == len(text) and most < 1_000
