import pandas as pd

from loam.operators import etl


def test_documents_are_folded_across_batches():
    """Questions that go on in the next batch, and several documents in one batch."""
    rows = [(1, 1, "1. q", 1, "q", None), (1, 1, "① a", None, "", [{"number": 1, "text": "a"}]), (1, 1, "more", None, "", None), (2, 1, "x", None, "", None), (2, 2, "1. r", 1, "r", None), (2, 2, "s", None, "", None)]
    frame = pd.DataFrame([(*r, None) for r in rows], columns=["doc_id", "page", "text", "number", "stem", "choices", "subject"])
    for size in (1, 2, 4, 6):
        got = pd.concat(etl._fold(iter([frame[k : k + size] for k in range(0, len(frame), size)])))
        assert list(zip(got["doc_id"], got["page"], got["stem"], got["choices"], strict=True)) == [(1, 1, "q", [{"number": 1, "text": "a more"}]), (2, 2, "r s", [])]
