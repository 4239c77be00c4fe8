"""Properties over generated texts: equal to the libraries and to plain versions, whatever the characters."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_dedup import brute_fingerprint
from tests.llm.test_text_ops import brute_spans
from tradelake.llm import license_scan, pii, piece_bpe, simhash, token_counts

texts = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t▁aeé@.+-0123456789<|endoftext|>")), max_size=80)
few = settings(max_examples=300, deadline=None)


@few
@given(texts)
def test_codec(text):
    codec = piece_bpe.codec()
    ids = codec.encode([text])[0]
    assert ids.tolist() == codec.library.encode(text, add_eos=True)
    assert codec.decode(ids) == codec.library.decode(ids.tolist())


@few
@given(texts)
def test_token_count(text):
    counter = token_counts.counter()
    assert counter.count_texts([text]) == [len(counter.library.encode(text, add_special_tokens=False).ids)]


@few
@given(texts)
def test_spans(text):
    spans = pii.base_spans(text)
    assert spans == brute_spans(text)
    seen = [(x["start"], x["end"]) for x in pii.seen_in(text) if x["kind"] < 0]
    assert all(text[a:b].strip() == text[a:b] and a < b <= len(text) and all(b <= x or y <= a for _, x, y in spans) for a, b in seen)


@few
@given(texts)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@few
@given(st.lists(st.sampled_from(["Copyright 2020", "All rights reserved.", "prose", "", "licensed under", "İ licence", "warranty " * 300]), max_size=12))
def test_license_blocks_lie_in_the_text(lines):
    text = "\n".join(lines)
    scanner = license_scan.Scanner()
    found = scanner.scan(text)
    assert all(0 <= x["start"] < x["end"] <= len(text) for x in found)
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:], strict=False))
