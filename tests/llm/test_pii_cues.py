"""op6: values behind a few plain words, ordinary passwords, IBANs without a cue."""

import pytest

from threadlens.llm import pii


@pytest.mark.parametrize("text, kind, value", [
    ("IBAN number: GB82 WEST 1234 5698 7654 32.", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("pay GB82WEST12345698765432 today", "iban", "GB82WEST12345698765432"),
    ("SSN is 123-45-6789", "ssn", "123-45-6789"),
    ("her Social Security number is 123-45-6789", "ssn", "123-45-6789"),
    ("password is hunter2024!x", "secret", "hunter2024!x"),
    ("Password: sunshine", "secret", "sunshine"),
    ("account number is 12345678", "account", "12345678"),
])
def test_found(text, kind, value):
    assert [text[a:b] for a, b in pii.spans_of(text)[kind]] == [value]


@pytest.mark.parametrize("text", ["password is required here", "password protected files", "XGB82WEST12345698765432",
                                  "GB83 WEST 1234 5698 7654 32", "the password is short1", "SSN is not known"])
def test_not_found(text):
    assert not any(pii.spans_of(text)[k] for k in pii.MORE_KINDS)


def test_each_iban_once():
    text = "IBAN: GB82 WEST 1234 5698 7654 32, and GB82WEST12345698765432"
    assert [text[a:b] for a, b in pii.spans_of(text)["iban"]] == ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"]
