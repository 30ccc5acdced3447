import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from vellum.llm.common import vocabulary
from vellum.llm.piece_lattice import MODEL_NAME, PieceEncoder, encode_pieces, occurrences, piece_digests, suffix_array

from .conftest import document_rows

ENCODER = PieceEncoder(vocabulary(MODEL_NAME))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdeth \n\t.,▁éß漢🎉"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_ids_are_the_librarys(texts):
    got = ENCODER.encode(texts)
    assert [x.tolist() for x in got] == ENCODER.table.model.encode(texts)
    assert [ENCODER.decode(x.tolist()) for x in got] == [ENCODER.table.model.decode(x.tolist()) for x in got]


def test_suffix_array_and_search():
    text = "banana bandana"
    codes = np.array([ord(c) for c in text])
    order = suffix_array(codes, 8)
    assert [text[k:] for k in order] == sorted(text[k:] for k in range(len(text)))
    chars = np.full((3, 4), -1)
    for row, piece in enumerate(("ana", "ban", "x")):
        chars[row, : len(piece)] = [ord(c) for c in piece]
    low, high = occurrences(codes, order, chars)
    assert [sorted(order[a:b].tolist()) for a, b in zip(low, high)] == [[1, 3, 11], [0, 7], []]


def test_rows(docs, no_docs):
    texts = [(r[0], r[1]) for r in document_rows()]
    want = sorted((d is not None, d or 0, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, t) in texts for i in [ENCODER.table.model.encode(t or "")])
    got = piece_digests(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_pieces, r.ids_crc32) for r in got) == want
    assert all(r.round_trip for r in got)
    assert sorted(len(r.ids) for r in encode_pieces(docs).collect()) == sorted(w[2] for w in want)
    assert piece_digests(no_docs).count() == 0
