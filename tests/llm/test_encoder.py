"""Ids of texts by pieces, each encoded once, against the whole tokenizer."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cladewise.llm import token_index

PARTS = [
    "a", "B", "Zz", "é", "É", "ß", "ÿ", "Þ", "×", "÷", "µ", "'s", "'", "'S", "'re", "don", "<|", "|>", "<|endoftext|>", "<|EndOfText|>", "</w>", "H̱", "ẖ", "̱", "İ", "İ", "Ǩ",
    "0", "12", "٣", ".", ",", "!!!", "-", "_", "`", "~", "\x7f", "\x00", "\x85", "\xa0", "\xad", "\t", "\r", "\n", " ", "  ", " \n", "日本", "ñ", "Ω", "K", "🙂", "‍", "　", "œ", "ǅ", "ſ",
]


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def same_as_whole(coder, whole, texts, kind=pa.string()):
    column = pa.array(["before it", *texts, "after"], kind)[1 : len(texts) + 1]
    ids, counts = coder.encode(column)
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, coder.end_id] for t in texts]
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_spellings_share_stems(path):
    """Case and punctuation make no new words: what the model is asked for grows with stems and tails, not with their pairs."""
    from tokenizers import Tokenizer

    coder, whole = token_index.WordEncoder(path, 1), Tokenizer.from_file(path)
    stems, tails = ["water", "äpfel", "çödé", "straß"], [".", ",", "!!", ";"]
    words = [f(s) + t for s in stems for f in (str.lower, str.title, lambda s: s[:4].upper() + s[4:]) for t in ["", *tails]]
    same_as_whole(coder, whole, [" ".join(words), "\n".join(reversed(words))])
    assert set(coder.words) == {*stems, *tails}


@pytest.mark.parametrize("cached", [20, 400_000])
def test_odd_texts(path, monkeypatch, cached):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_index, "CACHED_WORDS", cached)
    coder, whole, draw = token_index.WordEncoder(path, 7), Tokenizer.from_file(path), random.Random(2)
    assert coder.plain
    for i in range(150):
        texts = ["".join(draw.choices(PARTS, k=draw.choice([0, 1, 2, 3, 6, 30]))) if draw.random() > 0.05 else None for _ in range(draw.choice([0, 1, 2, 40]))]
        same_as_whole(coder, whole, texts, pa.large_string() if i % 5 == 0 else pa.string())


def test_other_tokenizers(tmp_path):
    """Without the settings that let words be cut, they go through the tokenizer as they are."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    whole = Tokenizer(models.WordLevel({"?": 0, "Ab": 1, "ab": 2, "ab.": 3, ".": 4, "é": 5}, unk_token="?"))
    whole.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    whole.save(str(tmp_path / "made.json"))
    coder = token_index.WordEncoder(str(tmp_path / "made.json"), 9)
    assert not coder.plain
    same_as_whole(coder, whole, ["Ab ab ab. AB", None, " . \n é É\tab", ""])


def test_long_stems(path):
    """Many stems in one call, and one of many letters, keep their places."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice([*"etaoinshrdlué"], n)) for n in rng.integers(1, 14, 10_000)] + ["qx" * 5000]
    same_as_whole(token_index.WordEncoder(path, 1), Tokenizer.from_file(path), [" ".join(words), words[-1]])


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_id_column(kind):
    """One column for all texts has the bytes of each, those without ids too."""
    ids, counts = np.arange(7, dtype="<u4") * 9000, np.array([0, 3, 0, 4, 0])
    column = token_index.id_column(ids, counts, kind)
    column.validate(full=True)
    assert column.to_pylist() == [x.astype(kind).tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert len(token_index.id_column(ids[:0], counts[:0], kind)) == 0
