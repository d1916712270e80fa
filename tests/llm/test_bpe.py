import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from dualview.llm import bpe


@pytest.fixture(scope="module")
def library(vocabulary):
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(vocabulary, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab're'vell s t m d  \n\t'''12é½ 　\x85​漢🙂"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_same_ids_as_the_library_and_back(library, vocabulary, text):
    c = bpe.codec(vocabulary)
    ids = c.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    ends = c.ends(ids)
    assert c.decode(ids, ends) == c.decode(ids) == text.encode()
    assert (ends[-1] if len(ends) else 0) == len(text.encode())


def test_long_slices(library, vocabulary):
    c = bpe.Codec(vocabulary, cache_size=3)
    r = random.Random(3)
    for text in ("x" * 4000, "".join(r.choice("abcdeét") for _ in range(3000)), " " * 2000, "'s" * 700):
        assert c.encode(text).tolist() == library.encode_ordinary(text)


def test_composition_is_associative():
    rng = np.random.default_rng(0)
    f, g, h = (bpe.STEP[rng.integers(0, 7, 50)].astype(np.int64) for _ in range(3))
    assert (bpe.compose(bpe.compose(f, g), h) == bpe.compose(f, bpe.compose(g, h))).all()


def test_odd_rows(spark, odd, empty, library, vocabulary):
    got = bpe.digests(bpe.round_trip(odd, vocabulary, offsets=True)).collect()
    want = []
    for r in odd.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.digests(bpe.round_trip(empty, vocabulary)).count() == 0
