"""A private key goes with its body, not its header alone."""

import pytest

from quarterbook.llm.secret_scan import found_spans, without

RSA, PGP = "-----{} RSA PRIVATE KEY-----", "-----{} PGP PRIVATE KEY BLOCK-----"
BODY = "\n".join(["MIIEow" + "aB3+/" * 11 + "abc"] * 3)


@pytest.mark.parametrize(
    "text, want",
    [
        (f"x {RSA.format('BEGIN')}\n{BODY}\nAb==\n{RSA.format('END')}\nafter", "x [pem]\nafter"),
        (f"x {RSA.format('BEGIN')}\nProc-Type: 4,ENCRYPTED\n\n{BODY}\n{RSA.format('END')} after", "x [pem] after"),
        (f"{PGP.format('BEGIN')}\nVersion: GnuPG v1\n\n{BODY}\n=AbCd\n{PGP.format('END')}\nafter", "[pem]\nafter"),
        (f"{RSA.format('BEGIN')}\n{BODY}\nAbcdEf==\nwords after", "[pem]\nwords after"),
        (f"{PGP.format('BEGIN')}\nVersion: GnuPG v1\n\n{BODY}\nabcd\n=AbCd\nThen words", "[pem]\nThen words"),
        (f"{RSA.format('BEGIN')}\n{BODY}\n{RSA.format('BEGIN')}\n{BODY}\n{RSA.format('END')}", "[pem]\n[pem]"),
        (f"{RSA.format('BEGIN')} is a header", "[pem] is a header"),
    ],
)
def test_key_bodies_go(text, want):
    assert without(text, found_spans([text])[0]) == want
