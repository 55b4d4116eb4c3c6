from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

KINDS = {
    "documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())],
    "benchmark": [("item_id", pa.int64()), ("text", pa.string())],
    "labels": [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())],
    "pages": [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())],
    "embeddings": [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())],
}


@pytest.fixture
def tables(tmp_path):
    """Writes the given rows as tables; short rows are filled with nulls. Gives the folder."""

    def write(**made) -> str:
        for name, rows in made.items():
            kinds = KINDS[name]
            full = [tuple(r) + (None,) * (len(kinds) - len(r)) for r in rows]
            pq.write_table(pa.table({c: pa.array([r[i] for r in full], t) for i, (c, t) in enumerate(kinds)}), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


class Union:
    """Brute-force components: the smallest member that links reach."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


@pytest.fixture
def union():
    return Union()
