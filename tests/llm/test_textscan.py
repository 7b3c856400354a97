import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import textscan as T

TEXTS = st.lists(st.none() | st.text(alphabet=st.sampled_from("ab Z9.\té\n 😀-"), max_size=25), max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_hashes_equal_regular_expressions(texts, limit):
    seen = 0
    for t in T.chunks(pa.array(texts, pa.string()), limit):
        t = t.lowered()
        for table, pattern in ((T.SPACED, rb"[^\x20\x09-\x0D]+"), (T.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
            s, e, first = T.word_spans(t, table)
            h = T.Hasher(t.data)(s, e) if len(s) else []
            for i in range(len(t)):
                raw = bytes(t.data[t.offsets[i] : t.offsets[i + 1]])
                assert raw == "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[t.rows.start + i] or "").encode()
                words = re.findall(pattern, raw)
                assert [bytes(t.data[a:b]) for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]], strict=True)] == words
                assert [T.hash_of(w) for w in words] == [int(x) for x in h[first[i] : first[i + 1]]]
        seen += len(t)
    assert seen == len(texts)


def test_sliced_columns_and_lookup():
    col = pa.array(["aa", "b", None, "cc dd"]).slice(1)
    assert [bytes(t.data) for t in T.chunks(col)] == [b"bcc dd"]
    look = T.Lookup(np.array([9, 1 << 60, 5], dtype=np.uint64))
    assert look(np.array([5, 6, 9, 1 << 60], dtype=np.uint64)).tolist() == [2, -1, 0, 1]
    assert T.Lookup(np.zeros(0, np.uint64))(np.array([1], np.uint64)).tolist() == [-1]
