"""Where ids are wanted, a text that ranks can encode is one piece, with the library's ids."""

import numpy as np
import pytest

from bagloom.llm import tokens


def test_plain_texts_are_encoded_whole():
    path = tokens.vocabulary_path()
    encode = tokens.Encoder(path, False)
    if encode._ranks is None:
        pytest.skip("no ranks beside the vocabulary")
    special = encode._special[0] if encode._special else "plain"
    plain = ["one two  three\n\n four", " a", "b ", "a  b ́ café Ж", "x" * 5000, "\t \r\n  y'll 1234567", "ԯ end"]
    other = [None, "", f"a {special} b", "԰ new", "你好  世界", "smile \U0001f600 !"]
    texts = [t for both in zip(plain, other) for t in both] + plain[len(other):]
    found = encode(texts)
    want = [encode._library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b"".join(parts), "<u4").tolist() for parts in found] == want
    assert all(len(parts) == 1 for t, parts in zip(texts, found) if t in plain)
