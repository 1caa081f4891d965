from __future__ import annotations

import re
from pathlib import Path

from pingworks.llm.shared import tidy


def _own_mb() -> int:
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text()).group(1)) >> 10


def test_a_task_gives_back_what_it_has_freed():
    kept = []

    def run(batches):
        pieces = [bytearray(3000) for _ in range(60_000)]
        kept.append(pieces[-1])  # a late piece, above which alone the C library would shrink by itself
        yield len(pieces)

    before = _own_mb()
    assert list(run(None)) == [60_000] and _own_mb() > before + 100  # held without it
    assert list(tidy(run)(None)) == [60_000] and _own_mb() < before + 60


def test_chunks_that_crowd_one_place_keep_their_entries(monkeypatch):
    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from pingworks.llm.encode import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pa.array([" ".join(f"w{i % 700}x{k} (q{i})" for i in range(900)) for k in range(3)] + ["", None, "Élan, v1"])
    want = [x[2].tolist() for x in Encoder(path).ids(texts, 1)]
    # every search begins at the table's last places, and the table grows meanwhile
    monkeypatch.setattr(Encoder, "_place", lambda self, h: np.full(len(h), len(self.table) - 2) + (h % np.uint64(2)).astype(np.int64))
    crowded = Encoder(path)
    for _ in range(2):
        assert [x[2].tolist() for x in crowded.ids(texts, 1)] == want
    assert len(crowded.table) >= 2 * crowded.n and len(set(crowded._find(crowded.hashes[: crowded.n]))) == crowded.n
