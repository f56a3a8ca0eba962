import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tsudoi.llm import dac, packing
from tsudoi.llm.common import scratch
from tsudoi.llm.tokens import Encoder, encoder, vocabulary

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
PIECES = st.sampled_from(["The", "the", " ", "  ", "\n", "\n\n", "\t", "word,", "word.", "it's", "'s", "...", "1.5", "é", "ΑΣ", "　", "\xa0", "<|endoftext|>", "<|", "x", "\x1c", "é", "İ"])


@pytest.mark.parametrize("file", FILES)
def test_chunks_equal_whole_texts(file):
    enc = encoder(vocabulary(file))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(PIECES, max_size=12).map("".join))
    def check(text):
        assert enc.ids([text])[0].tolist() == enc.library.encode(text, add_special_tokens=False).ids
    check()
    assert enc.mode is not None and [len(x) for x in enc.ids([None, ""])] == [0, 0]


@pytest.mark.parametrize("file", FILES)
def test_chunks_that_end_in_marks(file, monkeypatch):
    enc = Encoder(vocabulary(file))
    for text in ("İ. x", "İ!! x", "ΑΣ. é*** क़. ß,$$$", "it's!! x' 'y", "a1b!! 한글. 中文。 😀!"):
        assert enc.ids([text])[0].tolist() == enc.library.encode(text, add_special_tokens=False).ids
    asked = []
    encode = enc.encode
    monkeypatch.setattr(enc, "encode", lambda texts: asked.extend(texts) or encode(texts))
    text = " ".join(a + b + c + mark for a in "bcdfg" for b in "aeiou" for c in "klmnp" for mark in ("!!", "***", "%%%", "."))
    assert enc.ids([text])[0].tolist() == enc.library.encode(text, add_special_tokens=False).ids
    assert len(asked) <= 8  # the marks and the first word, not each of 500 chunks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2 ** 32 - 1)), max_size=2000))
def test_codes_round_trip(ids):
    levels = dac.encode(np.array(ids, np.uint32))
    assert dac.decode(levels).tolist() == ids
    at = list(range(0, len(ids), 7))[::-1]
    assert dac.access(levels, np.array(at, np.int64)).tolist() == [ids[i] for i in at]


def test_archive(spark):
    rows = cases.odd_rows()
    path = scratch(spark, "dac")
    dac.write(cases.docs(spark, rows), path, vocabulary(FILES[0]), end_id=1, segment_ids=500)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in dac.digests(dac.read(spark, path)).collect()))
    enc = encoder(vocabulary(FILES[0])).library
    ids_of = lambda t: np.array(enc.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
    assert [r[0] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    order = [r[1] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert sorted((r[1:] for r in got), key=repr) == sorted(((i, len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for i, t in rows), key=repr)
    texts = {i: t for i, t in rows}
    whole = {start + k: int(x) for start, i, _, _ in got if i in (4, 8) for k, x in enumerate(ids_of(texts[i]))}
    asked = random.Random(3).sample(sorted(whole), 200)
    found = dac.tokens_at(spark, path, spark.createDataFrame([(p,) for p in asked + asked[:3] + [-1, 10 ** 9, None]], "position long")).collect()
    assert {r.position: r.token for r in found} == {p: whole[p] for p in asked} and len(found) == 200


def test_empty_archive(spark):
    path = scratch(spark, "dac")
    dac.write(cases.docs(spark, []), path, vocabulary(FILES[0]), end_id=1)
    assert dac.read(spark, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_tournament_tree_is_first_fit_decreasing(sizes):
    bins, used = packing.first_fit_decreasing(np.array(sizes, np.int64), 64)
    rooms = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((b for b, room in enumerate(rooms) if room >= sizes[item]), len(rooms))
        if b == len(rooms):
            rooms.append(64)
        rooms[b] -= sizes[item]
        assert bins[item] == b
    assert used.tolist() == [64 - r for r in rooms]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
def test_pack_places_all_once_with_little_padding(sizes):
    rows = packing.pack(np.array(sizes, np.int64), 64, 0.97)
    items, bins = {}, {}
    for item, start, n, b, at in rows:
        items.setdefault(item, []).append((start, n))
        bins.setdefault(b, []).append((at, n))
    for item, size in enumerate(sizes):
        cut = sorted(items[item])
        assert [s for s, _ in cut] == np.cumsum([0] + [n for _, n in cut])[:-1].tolist() and sum(n for _, n in cut) == size
    for cut in bins.values():
        assert [s for s, _ in sorted(cut)] == np.cumsum([0] + [n for _, n in sorted(cut)])[:-1].tolist() and sum(n for _, n in cut) <= 64
    assert sum(64 - sum(n for _, n in cut) for cut in bins.values()) <= 0.03 * 64 * len(bins) + 64


def test_packed_documents(spark):
    rows = cases.odd_rows()
    pieces = packing.packed(cases.docs(spark, rows), vocabulary(FILES[1]), end_id=0, room=128).collect()
    enc = encoder(vocabulary(FILES[1])).library
    want = sorted((np.array(enc.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for _, t in rows))
    assert sum(r.length for r in pieces) == sum(len(w) // 4 for w in want)
    by_sequence = {}
    for r in pieces:
        assert len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for cut in by_sequence.values():
        assert [s for s, _ in sorted(cut)] == np.cumsum([0] + [n for _, n in sorted(cut)])[:-1].tolist() and sum(n for _, n in cut) <= 128
    long = b"".join(r.ids for r in sorted((r for r in pieces if r.doc_id == 4), key=lambda r: r.start))
    assert long in want
    assert packing.packed(cases.docs(spark, []), vocabulary(FILES[1]), end_id=0).count() == 0
