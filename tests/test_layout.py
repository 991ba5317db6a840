import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators.layout import Tiling, max_chunks, same_shape, size, strides, transfers
from tessella.operators.section import InvalidRange, Range, fill, middle, parse


def box(text):
    """"0:1, 5:9" as ranges; "[3,12]" as a box from zero."""
    if text.startswith("["):
        return [Range(0, int(n) - 1) for n in text[1:-1].split(",")]
    return [Range(int(a), int(b or a)) for a, _, b in (p.strip().partition(":") for p in text.split(","))]


PLANS = [
    ("[3,12]", "[3,12]", "none", 12, 3, lambda k: (12 * k, 12 * k)),
    ("[3,12]", "[3,12]", "all", 36, 1, lambda k: (0, 0)),
    ("[1,10,20]", "[2,10,20]", "none", 20, 10, lambda k: (20 * k, 20 * k)),
    ("[1,10,20]", "[2,10,20]", "all", 200, 1, lambda k: (0, 0)),
    ("1, 0:9, 0:19", "[2,10,20]", "none", 20, 10, lambda k: (20 * k, 200 + 20 * k)),
    ("0:1, 5:9, 0:19", "[2,10,20]", "none", 20, 10, lambda k: (20 * k, (100 if k < 5 else 200) + 20 * k)),
    ("0:1, 5:9, 0:19", "[2,10,20]", "all", 100, 2, lambda k: (100 * k, 100 if k < 1 else 300)),
    ("0:1, 0:9, 5:14", "[2,10,20]", "all", 10, 20, lambda k: (10 * k, 5 + 20 * k)),
    ("5:5, 20:29, 5:25", "5:6, 20:29, 5:25", "none", 21, 10, lambda k: (21 * k, 21 * k)),
    ("5:6, 25:29, 5:25", "5:6, 20:29, 5:25", "all", 105, 2, lambda k: (105 * k, 105 if k < 1 else 315)),
    ("6:7, 20:29, 15:24", "5:8, 20:29, 5:25", "none", 10, 20, lambda k: (10 * k, 220 + 21 * k)),
    ("4:5, 20:29, 5:25", "5:8, 20:29, 5:25", "none", 21, 10, lambda k: (210 + 21 * k, 21 * k)),
    ("7:12, 20:29, 5:24", "5:8, 20:29, 5:24", "all", 400, 1, lambda k: (20 * k, 400 + 20 * k)),
    ("2:5, 15:25, 0:30", "5:8, 20:29, 5:24", "all", 20, 6, lambda k: (1183 + 31 * k, 20 * k)),
    ("7:12, 28:30, 20:29", "5:8, 20:29, 5:24", "none", 5, 4, lambda k: ((0 if k < 2 else 10) + 10 * k, (575 if k < 2 else 735) + 20 * k)),
    ("[1,6,12]", "0:0, 0:5, 4:7", "notFirst", 4, 6, lambda k: (4 + 12 * k, 4 * k)),
    ("[3]", "0:2", "notFirst", 1, 3, lambda k: (k, k)),
    ("[6,12]", "0:5, 4:7", "all", 4, 6, lambda k: (4 + 12 * k, 4 * k)),
]


@pytest.mark.parametrize(("have", "want", "merge", "n", "count", "at"), PLANS)
def test_transfer_plans(have, want, merge, n, count, at):
    assert transfers(box(have), box(want), merge) == [(at(k)[0], n, at(k)[1]) for k in range(count)]


def test_transfers_of_disjoint_boxes():
    assert transfers(box("0:1"), box("4:5")) == []


@pytest.mark.parametrize(
    ("shape", "chunk", "section", "cover"),
    [
        ([4, 6, 200], [1, 3, 20], "1:2, 1:2, 0:12", "1:2, 0:0, 0:0"),
        ([4, 6, 200], [1, 3, 20], "1:3, 2:4, 150:199", "1:3, 0:1, 7:9"),
        ([4, 6, 200], [1, 3, 11], "1, 4:5, 33:55", "1:1, 1:1, 3:5"),
        ([60, 120], [15, 30], "20:39, 40:79", "1:2, 1:2"),
        ([8395, 781, 385], [1, 30, 30], "0:9, 0:780, 0:384", "0:9, 0:26, 0:12"),
    ],
)
def test_tile_cover(shape, chunk, section, cover):
    assert Tiling(tuple(shape), tuple(chunk)).cover(box(section)) == box(cover)


def test_tiles():
    t = Tiling((4, 6, 20), (1, 3, 20))
    assert t.tile([2, 5, 20]) == [2, 1, 1]
    assert t.index([2, 1, 1]) == [2, 3, 20]
    assert t.tile_shape() == [4, 2, 1]
    assert Tiling((4, 6), (1, 3, 8)).tile_shape() == [4, 2]
    assert t.order([3, 5, 0]) == 7


@pytest.mark.parametrize("limit", [10000, 3333, 1111, 7])
def test_max_chunks_cover_in_order(limit):
    box_ = [Range(0, 19), Range(0, 29), Range(0, 39)]
    seen = []
    for b in max_chunks(box_, limit):
        assert size([len(r) for r in b]) <= max(limit, 40)
        seen += [(i * 30 + j) * 40 + k for i in range(b[0].start, b[0].last + 1) for j in range(b[1].start, b[1].last + 1) for k in range(b[2].start, b[2].last + 1)]
    assert seen == list(range(24000))


def test_parse_and_fill():
    assert parse("(1:20,:,3,10:20:2)") == [Range(1, 20), None, Range(3, 3), Range(10, 20, 2)]
    with pytest.raises(ValueError, match="illegal selector: x"):
        parse("1,x")
    assert fill(None, [3, 4]) == [Range(0, 2), Range(0, 3)]
    assert fill(None, []) == [Range(0, 0)]
    for bad, shape in (("1:2", [3, 3]), ("1:3", [3]), ("2:1", [5])):
        with pytest.raises(InvalidRange):
            fill(bad, shape)


def test_small_things():
    assert strides([4, 3, 2]) == [6, 2, 1]
    assert same_shape([], [1]) and same_shape([0], [1]) and not same_shape([2], [1])
    assert middle([9, 4]) == [Range(3, 5), Range(0, 3)]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_sections_equal_gather(data):
    shape = [data.draw(st.integers(1, 4)), data.draw(st.integers(6, 8)), data.draw(st.integers(1, 4))]
    want = [Range(n // k, min(n // k + max(1, n // k), n) - 1) for n, k in zip(shape, (2, 3, 2), strict=True)]
    full = np.arange(size(shape)).reshape(shape)
    out = np.full(size([len(r) for r in want]), -1)
    flat = full.ravel()
    for src, n, dst in transfers([Range(0, n - 1) for n in shape], want, data.draw(st.sampled_from(["all", "none", "notFirst"]))):
        out[dst : dst + n] = flat[src : src + n]
    assert out.tolist() == full[tuple(slice(r.start, r.last + 1) for r in want)].ravel().tolist()
