"""Words as columns: the ids stay those of the whole tokenizer, and a full cache keeps what is in use."""

import random

import pyarrow as pa
from tokenizers import Tokenizer

from opsframe.llm import packing


def encoded(coder, texts):
    out = []
    for ids, ends in coder.encode(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
    return out


def whole(texts):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    return [[*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]


def test_ids_of_words_of_any_letters(monkeypatch):
    draw = random.Random(3)
    near = [chr(n) for n in range(1, 0x180)]
    few = [*"aB.,-'sStldmverLM0129<|>/w½µªß \n\t", "<|endoftext|>", "'ll", "́", "İ", "ſ", "­", "\u0085", " ", "中", "😀"]
    texts = ["".join(near), "", " ", "</w> a</w>", *near]
    texts += ["".join(draw.choice(near) for _ in range(40)) for _ in range(200)]
    texts += ["".join(draw.choice(few) for _ in range(30)) for _ in range(400)]
    want = whole(texts)
    for chunk, cache in ((2_000_000, 150_000), (1, 1), (300, 40)):
        monkeypatch.setattr(packing, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(packing, "CACHE_WORDS", cache)
        assert encoded(packing.Coder(packing.TOKENIZER), texts) == want


def test_a_full_cache_keeps_the_words_in_use(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_BYTES", 1)
    monkeypatch.setattr(packing, "CACHE_WORDS", 12)
    coder, asked = packing.Coder(packing.TOKENIZER), []
    real = coder._encoded
    coder._encoded = lambda words: asked.extend(words.to_pylist()) or real(words)
    texts = [f"these words stay here x{n} y{n} z{n}" for n in range(30)]
    assert encoded(coder, texts) == whole(texts)
    assert [asked.count(w) for w in "these words stay here".split()] == [1] * 4
    assert len(coder.words) <= 12 and len(coder.ends) == len(coder.words) + 1
