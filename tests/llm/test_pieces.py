"""Texts are worked through in pieces that take little memory of a Python worker."""

from __future__ import annotations

import pyarrow as pa

from moniker.llm import common as C


def test_pieces_are_small():
    b = pa.record_batch({"text": ["x" * 1000] * 2000})
    sizes = [p.num_rows for p in C.pieces(iter([b]), "text")]
    assert sum(sizes) == 2000 and max(sizes) * 1000 <= (1 << 18) + 1000
