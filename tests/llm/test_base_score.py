import math
import re
import zlib
from collections import Counter

import pytest

from kinroster.llm.queries import QUERIES

from .common import DOCS, frame, odd_documents, table
from .common import words as plain


def tokens(text):
    return [*plain(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "the end"]


def test_base_score_of_the_query_adds_one_to_each_count(spark, tmp_path):
    """Every exact column of op4, in the words of its contract: log10((c+1)/(N+1*(V+1)))."""
    rows = [*[r for r in odd_documents() if r[0] is not None], *[(i, f"Some WORDS of {i % 7} and\x85 \x1cmore İ {'x ' * i}", "en", "a", 1) for i in range(20, 60)]]
    out = frame(QUERIES["op4_kneser_ney"](spark, table(spark, tmp_path, "documents", rows, DOCS)))
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    c = Counter(t for r in kept for t in tokens(r[1]))
    N, V = c.total(), len(c)
    assert 0 < len(kept) < len(rows) and len(out) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in out.itertuples():
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(own), sum(t in c for t in own), N)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (N + 1 * (V + 1))) for t in own), rel=1e-12)
