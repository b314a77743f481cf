"""The secret scanner on texts without bytes that settle its state, and cut anywhere."""

import random
import re
import time

import numpy as np
import pytest
from test_documents import secret_base

from sedra.llm import secrets

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def texts():
    rng = random.Random(5)
    some = lambda letters, n: "".join(rng.choices(letters, k=n))
    yield some(BASE64, 40000)
    yield "eyJ" + some(BASE64, 9000) + ".eyJ" + some(BASE64, 9000) + "." + some(BASE64, 9000)
    yield some("0123456789abcdef", 30000) + "g" + some("0123456789abcdef", 23)
    yield some("abcdefghijklmnopqrstuvwxyz ", 30000) + "password = " + some(BASE64, 20000) + " x"
    yield "".join(rng.choice(["token", "=", " ", "'", "AKIA", "A1B2C3D4E5F6G7H8I9J0", "deadbeef" * 4, "é", "eyJa.eyJb."]) for _ in range(20000))


@pytest.mark.parametrize("lanes", [(2048, 512), (7, 1), (2048, 3)])
def test_lanes_are_exact(monkeypatch, lanes):
    monkeypatch.setattr(secrets, "LANES", lanes[0])
    monkeypatch.setattr(secrets, "LEAST", lanes[1])
    for t in texts():
        (found,) = secrets.scan_texts([t])
        assert [s for s in found if s[0] in secrets.BASE_KINDS] == secret_base(t)
        jwt = [m.span() for m in re.finditer(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", t)]
        assert [s[1:] for s in found if s[0] == "jwt"] == jwt


def test_long_text_without_line_ends():
    letters = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyz ", k=1 << 20))
    lined = re.sub("(.{80}).", r"\1\n", letters)
    seconds = []
    for t in (lined, letters):
        data = np.frombuffer(t.encode(), dtype=np.uint8)
        secrets.begins(data)
        began = time.perf_counter()
        secrets.begins(data)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 3 * seconds[0] + 0.2


def test_added_kinds():
    t = "AIza" + "w" * 35 + " sk_live_" + "x" * 24 + " npm_" + "y1" * 18
    assert [k for k, _, _ in secrets.scan_texts([t])[0]] == ["google", "stripe", "npm"]
