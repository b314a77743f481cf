"""Cues of personal data in any spelling of upper and lower case."""

import pytest

from sedra.llm import pii


@pytest.mark.parametrize("cue, value, kind", [("iban", "DE89370400440532013000", "iban"), ("account no.", "12345678", "account"), ("acct #", "12345678", "account")])
def test_cues_in_any_case(cue, value, kind):
    for spelling in (cue, cue.upper(), cue.title(), cue.swapcase(), "".join(c.upper() if i % 2 else c for i, c in enumerate(cue))):
        text = f"x {spelling} {value} y"
        at = text.index(value)
        assert (kind, at, at + len(value)) in pii.find_spans(text)
        assert value not in pii.redact_all(text)
