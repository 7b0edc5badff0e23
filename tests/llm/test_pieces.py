"""Ids from pieces of words against ids of whole texts."""

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")

from tidemark.llm import packing  # noqa: E402

TEXTS = [
    "a|b c|", "<|endoftext|>X <|ENDOFTEXT|> A<|startoftext|>b", "it's IT'S don'T x's'y", "́a,́b A,́ ", "1234a5.6,,--!x", "", "   ", None,
    "ΑΣ Σ ς'LL", "a b　c d", "ﬁ Å İI ẞ", "|", "| || a|", "‘x’ 'tis 'S 9's <b>Hello</b> <|x|>", "²³ ½ 12½",
    "word " * 3000, "x" * 5000,
]


@pytest.mark.parametrize("fine", [True, False])
def test_ids_are_those_of_whole_texts(fine):
    whole = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    coder = packing.Encoder(packing.default_tokenizer(), fine=fine)
    for _ in range(2):
        ids, begins = coder.encode(pa.array(TEXTS))
        for text, a, b in zip(TEXTS, begins[:-1], begins[1:], strict=True):
            assert ids[a:b].tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        coder.rest()


def test_scores_are_those_of_every_pair_whichever_seeds_come_together():
    draw = np.random.default_rng(3)
    texts = [draw.zipf(1.3, int(n)) % 900 + 2 for n in draw.integers(1, 90, 150)]
    sizes = np.array([len(t) for t in texts])
    ids, begins = np.concatenate(texts).astype(np.uint16), np.concatenate(([0], np.cumsum(sizes)))
    rarity = 1 + draw.random(1 << 16)
    unused = draw.random(150) > 0.6
    length = sizes / sizes.mean()

    def weight(doc, term):
        n = int((texts[doc] == term).sum())
        return max(round(rarity[term] * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * length[doc])) * 64), 1)

    index = packing.Index(ids, begins, rarity, float(sizes.mean()))
    for seed in range(0, 150, 7):
        held = set(texts[seed].tolist())
        score = {d: sum(weight(d, t) for t in held & set(texts[d].tolist())) for d in np.flatnonzero(unused).tolist()}
        want = sorted((d for d in score if score[d]), key=lambda d: (-score[d], d))
        assert list(index.ranked(seed, unused, np.arange(150))) == want
