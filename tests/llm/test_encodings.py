"""Secrets in URL-safe and wrapped base64."""

import base64
import bz2
import gzip
import random
import zlib

import pytest

from tickloom.llm import secrets

PACK = {"plain": lambda x: x, "zlib": zlib.compress, "bz2": bz2.compress, "gzip": lambda x: gzip.compress(x, mtime=0), "gzip, OS 3": lambda x: (y := gzip.compress(x))[:9] + b"\x03" + y[10:]}


def wrapped(width, end):
    def encode(raw):
        x = base64.b64encode(raw).decode()
        return end.join(x[i : i + width] for i in range(0, len(x), width))

    return encode


ENCODE = {"url-safe": lambda x: base64.urlsafe_b64encode(x).decode(), "standard": lambda x: base64.b64encode(x).decode(), "wrapped": wrapped(76, "\n"), "MIME": wrapped(64, "\r\n"), "narrow": wrapped(20, "\n"), "odd": wrapped(15, "\n")}


@pytest.mark.parametrize("encode", ENCODE)
@pytest.mark.parametrize("pack", PACK)
def test_encoded_secrets_are_found(pack, encode):
    rng = random.Random(5)
    for k in range(60):
        noise = "".join(rng.choice("ghijklmnopqrstuvwxyz?>~ü") for _ in range(rng.randrange(150)))
        inner = f"{noise} password = hunter{rng.randrange(10**9)} {noise}"
        text = ENCODE[encode](PACK[pack](inner.encode()))
        for whole in (f"see {text} end", f"an\nattached\n{text}\nend"):
            assert secrets.may_hold(whole.encode())
            spans = secrets.all_spans(whole)[1]
            at = whole.index(text)
            assert any(kind == 0 and at <= start < end for start, kind, end in spans), (k, whole)
            assert "[SECRET]" in secrets.redact(whole, spans)


def test_long_runs_take_linear_time():
    assert secrets.all_spans("z" * 1_000_000 + "\n" + "ab\n" * 100_000) == ([], [])
