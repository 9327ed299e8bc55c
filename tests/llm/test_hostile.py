"""Texts that make careless patterns or digests fail: long runs, long values, words that fool sums of powers."""

import time

import numpy as np
import pyarrow as pa
import pytest

from labelwright.llm import secrets, sketch
from labelwright.llm.common import Words

MB = 1 << 20
HOSTILE = {
    "dot leaders": lambda n: "Introduction" + "." * n + "12345", "dots and a letter": lambda n: "Introduction" + "." * n + "12a", "mixed marks": lambda n: "Ab" + ".-a" * (n // 3) + "1_",
    "eyJ": lambda n: "eyJ" * (n // 3), "eyJ with dots": lambda n: "eyJa." * (n // 5), "eyJ pairs": lambda n: "eyJab.eyJcd! " * (n // 13), "eyJ and one dot": lambda n: "eyJ" * (n // 6) + "." + "eyJ" * (n // 6),
    "begins without end": lambda n: "-----BEGIN RSA PRIVATE KEY-----\n" * (n // 32), "ends without begin": lambda n: "-----END RSA PRIVATE KEY-----\n" * (n // 30), "dashes": lambda n: "-" * n + "1",
    "keys": lambda n: "key" * (n // 3), "keys with a digit": lambda n: "key" * (n // 3) + "1", "assigned to nothing": lambda n: "key" + "=" * n, "chain": lambda n: "key=" * (n // 4), "named chain": lambda n: "a=" * (n // 2) + "1", "open quotes": lambda n: 'key="' * (n // 5),
    "one open quote": lambda n: 'key="' + "x" * n, "both quotes": lambda n: "key='a key=\"b " * (n // 14), "numbers": lambda n: "1." + "1" * n + "!", "versions": lambda n: "1.1" * (n // 3) + "!", "at": lambda n: "a." * (n // 2) + "@1", "hex": lambda n: "0f" * (n // 2),
    "commas": lambda n: "a1b2c3d4," * (n // 9), "blanks": lambda n: "token" + " " * n + "= 1", "names": lambda n: "a.b-" * (n // 4) + "key=12345678",
}


@pytest.fixture(scope="module")
def scanner():
    rows = secrets.example_findings() + secrets.hard_negatives()
    out = secrets.Scanner(np.zeros((27, 27)), frozenset(), secrets.RandomForest(np.zeros((0, 1)), np.zeros(0)))
    out.forest = secrets.RandomForest(np.array([out.features(*r[:5]) for r in rows], float), np.array([r[5] for r in rows], float))
    return out


@pytest.mark.parametrize("name", HOSTILE)
def test_time_in_proportion(name, scanner):
    text, t = HOSTILE[name](MB), time.process_time()
    found = [f for _, f in secrets.candidates(pa.array([text]))]
    for f in found[:2000]:
        secrets.rule_label(f[2], f[3], f[4])
        assert text[f[0] : f[1]] == f[2]
    scanner.score([(f[2], f[3], "", f[4], f[5]) for f in found[:2000]])
    assert time.process_time() - t < 12


def test_nothing_is_cut_short():
    inner = "\n".join(["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF", "", *["Zm9vYmFyYmF6cXV4" * 4] * 3000])
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{inner}\n-----END RSA PRIVATE KEY-----"
    phrase = "correct horse battery staple " * 40
    long_name = "the_password_" + "of_the_very_long_name_" * 6
    jwt = "eyJ" + "a" * 90_000 + ".eyJ" + "b" * 90_000 + "." + "c" * 90_000
    cases = {
        f"key: {pem} end": pem, f'password = "{phrase}" next': phrase, f"{long_name}=hunter2hunter2 x": "hunter2hunter2", f"bearer {jwt} x": jwt, f"secret: {'a1' * 200_000} x": "a1" * 200_000,
        f"-----BEGIN RSA PRIVATE KEY-----\nlost\n{pem}": pem, f"{pem}\n{pem}": pem, f"eyJab.eyJcd eyJx {jwt}": jwt,
    }
    found = secrets.candidates(pa.array(list(cases)))
    for i, (text, want) in enumerate(cases.items()):
        got = [f[2] for r, f in found if r == i]
        assert want in got, text[:60]
        assert text.count(want) == got.count(want)
    assert secrets.ISSUED.fullmatch(pem) and secrets.ISSUED.fullmatch(jwt) and secrets.rule_label(pem, "", "") == 1


def test_harmless_formats_are_known_as_before():
    for x in ("a.b@c.example", "10.0.0.1", "1.2.3-rc", "v1.22.333beta", "1.2.3.4.5", "2024-01-02T03:04", "http://x.example/a?b=1", "Introduction......12345", "word!?12", "Ab-cd'ef", "12,345.67"):
        assert secrets.rule_label(x, "", "") in (0, None)
    assert [secrets.rule_label(x, "", "") for x in ("v1.22.333beta", "Introduction......1234", "Ab-cd'ef99", "a.b@c.example", "12,345.67")] == [0] * 5
    assert secrets.rule_label("Introduction......12345", "", "") is None


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_digests_tell_apart_what_sums_of_powers_do_not():
    one, other = thue_morse(1024), thue_morse(1024, "b", "a")
    w = Words(pa.array([one, other, f"{one} x", one.upper() + " ", f" {one}\n x", None, "  "]))
    pairs = list(zip(*(x.tolist() for x in w.digests())))
    assert pairs[0] != pairs[1] and pairs[0] == pairs[3] and pairs[2] == pairs[4] and pairs[5] == pairs[6] and len(set(pairs)) == 4
    words = thue_morse(1024, "left ", "right "), thue_morse(1024, "right ", "left ")
    order = list(zip(*(x.tolist() for x in Words(pa.array(words)).digests())))
    assert order[0] != order[1]
    for a, b in ((one, other), words):
        x, y = (sketch.digests([t]) for t in (a, b))
        assert sketch.likeness(x, y)[0] < 1 and sketch.sketches(*x).text() != sketch.sketches(*y).text()
