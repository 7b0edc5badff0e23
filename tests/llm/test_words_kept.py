"""Words that a worker met in several blocks are not cut again in its next task."""

import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")

from tidemark.llm import packing  # noqa: E402

BLOCKS = [["alpha beta", "gamma|delta x9"], ["beta gamma|delta", None], ["", "beta lone", "other"]]


def test_words_met_twice_outlive_a_task():
    coder = packing.Encoder(packing.default_tokenizer(), fine=True)
    asked, plain = [], coder._asked
    coder._asked = lambda texts: asked.extend(texts) or plain(texts)
    first = [[a.tolist() for a in coder.encode(pa.array(b, pa.string()))] for b in BLOCKS]
    coder.rest()
    asked.clear()
    assert [[a.tolist() for a in coder.encode(pa.array(b, pa.string()))] for b in BLOCKS] == first
    again = " ".join(asked)
    assert "beta" not in again and "delta" not in again and "alpha" in again and "lone" in again
    # A task that does not meet a word lets go of it.
    coder.rest()
    coder.encode(pa.array(["alpha"]))
    coder.rest()
    asked.clear()
    coder.encode(pa.array(["beta"]))
    assert "beta" in " ".join(asked)
