"""Long texts without spaces, or with very many detections: plain results, in time that follows the length."""

import base64
import random
import time

import brute
import pytest

from brightrow.llm import licenses, tokens
from brightrow.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


def kinds(size):
    rng = random.Random(size)
    yield "letters", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size))
    yield "base64", base64.b64encode(rng.randbytes(size * 3 // 4)).decode()
    yield "cjk", "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(size // 2)) + "日本語のテキスト" * (size // 16)
    yield "same", "a" * size
    yield "mixed", "".join(rng.choice(["the", "ing", "=", "==", "\n", "é", "🎉", "ab", "▁", "0"]) for _ in range(size // 2))


def library(texts):
    import sentencepiece

    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts)]


@pytest.mark.parametrize("size", [300, 1_000, 20_000])
def test_long_pre_tokens_equal_the_library(size):
    for name, text in kinds(size):
        assert tokens.Counter(PATH).count([text]) == library([text]), name


def test_many_pre_tokens_around_the_bound():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdeT =-", k=rng.randint(350, 450))).replace(" ", "") for _ in range(200)]
    texts += ["".join(rng.choices("ab é", k=900)) for _ in range(50)]
    assert tokens.Counter(PATH).count(texts) == library(texts)


def test_a_million_characters():
    counter = tokens.Counter(PATH)
    counter.count(["warm"])
    seconds = {}
    for size in (100_000, 1_000_000):
        text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=size))
        began = time.perf_counter()
        assert counter.count([text]) == library([text])
        seconds[size] = time.perf_counter() - began
    assert seconds[1_000_000] < 25 * max(seconds[100_000], 0.2)


def test_suppression_equals_a_plain_version():
    rng = random.Random(7)
    for _ in range(300):
        raw = [
            (-rng.randint(1, 3), -rng.randint(1, 6), rng.randint(0, 20), rng.choice("xyz"), rng.choice((0.5, 0.9)))
            for _ in range(rng.randint(0, 25))
        ]
        assert licenses.suppress(raw, 30) == brute.suppressed(raw)


def test_texts_full_of_licenses_take_linear_time():
    unit = "all rights reserved mit license ".split()
    seconds = {}
    for size in (20_000, 200_000):
        words = [w.encode() for w in unit * (size // len(unit))]
        began = time.perf_counter()
        found, base = licenses.detect(words), licenses._phrases(words)
        seconds[size] = time.perf_counter() - began
        assert len(base) == size // len(unit) and len(found) >= size // len(unit)
        assert [w for w, _ in base] == list(range(0, size, len(unit)))
    assert seconds[200_000] < 30 * max(seconds[20_000], 0.05)
