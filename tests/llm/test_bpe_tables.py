"""Every code point as the tokenizers library takes it, odd vocabularies and bounded caches."""

import json

import pytest

from formloom.llm import bpe


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary()), bpe.Bpe(json.load(open(bpe.vocabulary())))


def differing(both, texts):
    tok, own = both
    return [t for t, w in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True) if own.encode(t) != w.ids]


def test_every_code_point(both):
    """Letters, numbers, white space and case by the tokenizer's own Unicode version."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 100_000):
        assert differing(both, [f"a{c}b1" for c in points[at : at + 100_000]]) == []


def test_marks_among_marks(both):
    import unicodedata

    marks = [c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] == "M"]
    assert differing(both, [f"aͅ{c}̣́{c}{c} e{c}́" for c in marks]) == []


def test_a_vocabulary_without_a_byte_is_refused(both, spark, tmp_path):
    spec = json.load(open(bpe.vocabulary()))
    end = spec["model"]["end_of_word_suffix"]
    for lost in ("z", "z" + end):
        short = json.loads(json.dumps(spec))
        del short["model"]["vocab"][lost]
        with pytest.raises(ValueError, match="122"):
            bpe.checked(short)
    path = tmp_path / "short.json"
    path.write_text(json.dumps(short))
    with pytest.raises(ValueError, match="122"):
        bpe.encode(spark.createDataFrame([(1, "fizz")], "doc_id long, text string"), str(path), ["doc_id"])


def test_caches_stay_bounded(both, monkeypatch):
    tok, _ = both
    monkeypatch.setattr(bpe, "CACHE", 50)
    own = bpe.Bpe(json.load(open(bpe.vocabulary())))
    text = " ".join(f"w{i}x{i * 7919}" for i in range(2000)) + " " + "longword" * 5000
    assert own.encode(text) == tok.encode(text, add_special_tokens=False).ids
    assert len(own._chunk) <= 50 and len(own._chunk._old) <= 50 and len(own._pair) <= 50
    assert max(map(len, own._chunk)) <= bpe.CACHED_CHARS
