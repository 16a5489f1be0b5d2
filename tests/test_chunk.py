import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docsift.functions.chunk import Chunker

GOLDEN = [
    ("abcdefghij" * 1000, 3200, 480, [(0, 3200), (2720, 5920), (5440, 8640), (8160, 10000)]),
    ("a" * 15 + "×" + "b" * 15, 16, 4, [(0, 15), (11, 27), (23, 32)]),
    ("abcdefghij×××××klmnopqrstuvwxyz×××××123456789", 20, 5, [(0, 20), (14, 34), (29, 49), (44, 55)]),
    (("word " * 20 + "\n") * 8 + "\n# Title two\n" + ("more " * 20 + "\n") * 8, 1000, 150, [(0, 809), (659, 1629)]),
    ("intro\n" * 20 + "```\n" + "code line\n" * 12 + "```\n" + "outro\n" * 20, 150, 20, [(0, 120), (100, 248), (228, 368)]),
    ("x" * 150 + ". " + "x" * 50 + "\n# H\n" + "y" * 400, 198, 20, [(0, 198), (178, 376), (356, 554), (534, 607)]),
    ("tiny — with em dash", 3200, 480, [(0, 21)]),
    ("", 10, 2, [(0, 0)]),
]


@pytest.mark.parametrize(("text", "size", "overlap", "ranges"), GOLDEN)
def test_ranges(text, size, overlap, ranges):
    assert [(c.pos, c.pos + len(c.text.encode())) for c in Chunker(size, overlap).split(text)] == ranges


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n#`-×→😀1*", max_size=400), st.integers(1, 60), st.integers(0, 40))
def test_chunks_cover_the_text(text, size, overlap):
    raw, end = text.encode(), 0
    chunks = Chunker(size, overlap).split(text)
    assert chunks[0].pos == 0
    for c in chunks:
        body = c.text.encode()
        assert raw[c.pos : c.pos + len(body)] == body and c.pos <= end
        end = max(end, c.pos + len(body))
    assert end == len(raw)
