"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are issued keys wherever they stand, values assigned to a name of ``KEYWORDS`` whatever their characters, and
the parts (between quotes, commas, ampersands, braces, and behind ``name=`` or ``name:``) of words with a digit or of long
ones with mixed case.  Its features are length, character classes and transitions
(shares of class changes, and how likely its letter pairs are in ordinary words), the share that dictionary words cover,
hints in the path, and the words next to it.  The forest is fitted on labelled findings.  Where a caller has none of its
own, ``rule_labels`` labels findings of well-known formats: issued key formats and assigned credentials as secrets,
addresses, card and phone numbers, versions and plain words as none; what no rule knows stays unlabelled and is left to
the forest.
"""

from __future__ import annotations

import bisect
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.llm.common import Words, checkpointed, text_pieces
from labelwright.llm.trees import RandomForest

#: Findings that the forest is fitted on, at most (those of the smallest hash), and words of its dictionary.
TRAIN_FINDINGS = 6_000
DICTIONARY = 2_000
#: Bytes of context kept on either side of a finding.
CONTEXT = 60
LEAST = 8

#: Words that tend to stand before a secret, and path parts that tend to hold made-up ones.
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "access_key", "auth", "bearer", "credential", "private", "client_secret")
PASSWORDS = ("password", "passwd", "pwd", "secret", "credential")
PATH_HINTS = ("test", "example", "sample", "mock", "doc", "lock", "readme", ".env", "config", "secret")
#: Words that stand by digests and identifiers, and beginnings of made-up keys.
DIGEST_WORDS = ("sha1", "sha256", "sha512", "sha", "md5", "digest", "checksum", "hash", "commit", "revision", "rev", "etag", "integrity", "blob", "tree", "uuid", "guid", "request", "trace", "image", "base64", "fingerprint")
MADE_UP = ("example", "dummy", "sample", "xxxx", "changeme", "placeholder", "your_", "test")
#: Formats of issued keys, and of common strings that are none.
_KEYS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk_(?:live|test)_[0-9A-Za-z]{16,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}"
ISSUED = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?s:.*?)-----END [A-Z ]{0,30}PRIVATE KEY-----|eyJ[\w-]+\.eyJ[\w-]+\.[\w-]+|" + _KEYS)
HARMLESS = re.compile(
    r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\d{1,3}(?:\.\d{1,3}){3}|\+?[\d() -]{7,15}|\d{13,19}|v?\d++(?:\.\d++)++\w*+|\d{4}-\d\d-\d\d\S*|https?://\S+|www\.\S+|[^\W\d_]+[.,;:!?]*\d{0,2}|[\d.,%$€]+"
)
# The patterns that run over whole texts take time in proportion to them: what repeats is possessive, or cannot be met twice.
_ISSUED = re.compile(_KEYS.encode())
_EDGE = re.compile(rb"-----(BEGIN|END) [A-Z ]{0,30}PRIVATE KEY-----")
_WEB = re.compile(rb"[\w-]++")
#: What assigns, the value behind it, however long: quoted, or up to white space or a mark; and what a name must have in it.
_ASSIGNS = re.compile(rb"=>|[=:]++")
_VALUE = re.compile(rb"[ \t]{0,3}(?:\"([^\"\n]++)\"|'([^'\n]++)'|`([^`\n]++)`|[\"'`]?([^\s\"'`,;&{}<>()\[\]]++))")
_TELLS = re.compile(rb"(?i)passw(?:or)?d|pwd|secret|token|key|auth|bearer|credential|private")
_IN_NAME = frozenset(b"_.-" + string.ascii_letters.encode() + string.digits.encode())
_PART = re.compile(rb"[^\"'`,;&?|{}\[\]()<>]+")
_NAME = re.compile(rb"([A-Za-z_][\w.-]*+)[=:]+(?!//)(?=.)", re.S)
_NAMED = re.compile(rb"([A-Za-z_][\w.-]{0,40})[\"'`]?[ \t]{0,3}[=:]+[ \t]{0,3}[\"'`]?$")
#: Least length of a value that is assigned to a name of KEYWORDS.
LEAST_ASSIGNED = 4
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_HEXES = re.compile(r"[0-9a-fA-F]+")

FINDING = "start long, end long, candidate string, name string, before string, after string"


def _issued(data: bytes, lo: int, hi: int) -> list[tuple[int, int]]:
    """Spans of the issued keys of data[lo:hi], in order: private keys from the last beginning before an end, web tokens, and those of one pattern."""
    out, begin = [m.span() for m in _ISSUED.finditer(data, lo, hi)], -1
    for m in _EDGE.finditer(data, lo, hi):
        if m[1] == b"BEGIN":
            begin = m.start()
        elif begin >= 0:
            out.append((begin, m.end()))
            begin = -1
    at = data.find(b"eyJ", lo, hi)
    while at >= 0:
        ends = [at]
        for k in range(3):
            m = _WEB.match(data, ends[-1] + (k > 0), hi)
            if m is None or k < 2 and (m.end() - m.start() < 4 or data[m.start() : m.start() + 3] != b"eyJ" or data[m.end() : m.end() + 1] != b"." or m.end() >= hi):
                break
            ends.append(m.end())
        if len(ends) == 4:
            out.append((at, ends[3]))
        # a later start within the same run has the same end
        at = data.find(b"eyJ", ends[3] if len(ends) == 4 else _WEB.match(data, at, hi).end(), hi)
    kept: list[tuple[int, int]] = []
    for a, b in sorted(out, key=lambda x: (x[0], -x[1])):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b))
    return kept


def _assigned(data: bytes, lo: int, hi: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, name) of the values in data[lo:hi] that are assigned to a name with one of KEYWORDS; none overlaps another."""
    done = lo
    for m in _ASSIGNS.finditer(data, lo, hi):
        at = m.start()
        if at < done:
            continue
        end = at
        while end > done and at - end < 3 and data[end - 1] in b" \t":
            end -= 1
        if end > done and data[end - 1] in b"\"'`":
            end -= 1
        start = end
        while start > done and data[start - 1] in _IN_NAME:
            start -= 1
        if start < end and _TELLS.search(data, start, end) and (value := _VALUE.match(data, m.end(), hi)):
            a, b = value.span(value.lastindex)
            done = value.end()
            if value.lastindex == 4:
                b -= len(data[a:b]) - len(data[a:b].rstrip(b".!?"))
            yield a, b, data[start:end]


def _parts(data: bytes, lo: int, hi: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, name) of the values within the word data[lo:hi]."""
    for part in _PART.finditer(data, lo, hi):
        at, end = part.span()
        m = _NAMED.search(data[max(lo, at - 44) : at])
        name = m[1] if m else b""
        while m := _NAME.match(data, at, end):
            name, at = m[1], m.end()
        at += len(data[at:end]) - len(data[at:end].lstrip(b"=:"))
        yield at, end, name


def _spans(data: bytes, lo: int, hi: int, words: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, name) of the candidates of the text data[lo:hi], sorted; none overlaps another.  words: those to be split."""
    taken: list[tuple[int, int, bytes]] = []
    for a, b in _issued(data, lo, hi):
        name = _NAMED.search(data[max(lo, a - 50) : a])
        taken.append((a, b, name[1] if name else b""))
    starts = [x[0] for x in taken]

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(starts, b)
        return not k or taken[k - 1][1] <= a

    for a, b, name in _assigned(data, lo, hi):
        if b - a >= LEAST_ASSIGNED and free(a, b):
            k = bisect.bisect_left(starts, a)
            taken.insert(k, (a, b, name))
            starts.insert(k, a)
    more = []
    for word in words:
        for a, b, name in _parts(data, *word):
            b -= len(data[a:b]) - len(data[a:b].rstrip(b".!?"))
            # what an issued key or an assigned value leaves of a part
            k = max(bisect.bisect_right(starts, a) - 1, 0)
            while k < len(taken) and taken[k][0] < b:
                if taken[k][1] > a:
                    more.append((a, taken[k][0], name))
                    a, name = taken[k][1], b""
                k += 1
            more.append((a, b, name))
    found = [x for x in more if x[1] - x[0] >= LEAST and _telling(data[x[0] : x[1]])]
    return [(a, b, name.decode("utf-8", "ignore")) for a, b, name in sorted(taken + found)]


def _telling(value: bytes) -> bool:
    return re.search(rb"[0-9]", value) is not None or (len(value) >= 20 and len(re.findall(rb"[A-Z]", value)) >= 3 and len(re.findall(rb"[a-z]", value)) >= 3)


def candidates(col: pa.Array) -> list[tuple[int, tuple[int, int, str, str, str, str]]]:
    """(row, finding) of every candidate; start and end count code points of the text."""
    w = Words(col, lower=False)
    raw = w.raw
    digits = np.concatenate([[0], np.cumsum((raw - np.uint8(48)) < 10)])
    upper = np.concatenate([[0], np.cumsum((raw - np.uint8(65)) < 26)])
    lower = np.concatenate([[0], np.cumsum((raw - np.uint8(97)) < 26)])
    tails = np.concatenate([[0], np.cumsum((raw & 0xC0) == 0x80)])
    size = w.end - w.start
    some = lambda c: c[w.end] - c[w.start]
    mixed = (size >= 20) & (some(upper) >= 3) & (some(lower) >= 3)
    data, out = raw.tobytes(), []
    split: dict[int, list[tuple[int, int]]] = {}
    for i in np.flatnonzero((size >= LEAST) & ((some(digits) > 0) | mixed)):
        split.setdefault(int(w.doc[i]), []).append((int(w.start[i]), int(w.end[i])))
    for row in range(w.rows):
        row_lo, row_hi = int(w.off[row]), int(w.off[row + 1])
        for lo, hi, name in _spans(data, row_lo, row_hi, split.get(row, [])):
            while lo < hi and data[lo] & 0xC0 == 0x80:
                lo += 1
            first = lo
            while first > row_lo and lo - first < 80 and data[first - 1] not in b" \t\n\r\x0b\x0c":
                first -= 1
            before = data[max(row_lo, first - CONTEXT) : first].decode("utf-8", "ignore")
            after = data[hi : min(row_hi, hi + CONTEXT // 2)].decode("utf-8", "ignore")
            a, b = (int(x - row_lo - (tails[x] - tails[row_lo])) for x in (lo, hi))
            out.append((row, (a, b, data[lo:hi].decode("utf-8", "replace"), name, before, after)))
    return out


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """A row for each candidate of a text: the columns ``keep``, path, and those of ``FINDING``."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("path", T.StringType()), *T._parse_datatype_string(FINDING).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, text):
            found = candidates(batch.column(batch.schema.get_field_index(text)))
            rows = pa.array([r for r, _ in found], pa.int64())
            kept = [batch.column(batch.schema.get_field_index(c)).take(rows) for c in (*keep, "_path")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            cols = [pa.array([f[k] for _, f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*kept, *cols], names=schema.names)

    where = F.col(path).cast("string") if path else F.lit("")
    return docs.select(*keep, text, F.coalesce(where, F.lit("")).alias("_path")).mapInArrow(run, schema)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def rule_label(candidate: str, name: str, before: str) -> int | None:
    """1: an issued key or an assigned credential; 0: a well-known harmless format; None: no rule knows."""
    said = (name or " ".join(re.findall(r"[A-Za-z_]+\s*[=:]\s*[\"']?$", before)[-1:])).lower()
    if any(x in candidate.lower() for x in MADE_UP):
        return 0 if not any(k in said for k in KEYWORDS) or ISSUED.fullmatch(candidate) else None
    if ISSUED.fullmatch(candidate):
        return 1
    if not any(k in said for k in KEYWORDS) and (_UUID.fullmatch(candidate) or (_HEXES.fullmatch(candidate) and len(candidate) in (32, 40, 64, 128))):
        return 0
    if any(k in said for k in KEYWORDS) and re.search(r"\d", candidate) and entropy(candidate) > 2.5:
        return 1
    if name and any(k in said for k in PASSWORDS):
        return None
    if HARMLESS.fullmatch(candidate) or (candidate.isdigit() and _luhn(candidate)):
        return 0
    if not name and not re.search(r"[=:]", before[-4:]) and re.fullmatch(r"[^\W\d_][^\d\s_]*+\d{0,4}", candidate):
        return 0
    return None


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _kinds(s: str) -> str:
    return "".join("l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" for c in s)


@dataclass
class Scanner:
    """A fitted scan: letter-pair log-probabilities of ordinary words, the dictionary, and the forest."""

    pairs: np.ndarray
    dictionary: frozenset[str]
    forest: RandomForest

    def features(self, candidate: str, name: str, path: str, before: str, after: str) -> list[float]:
        n, kinds = len(candidate), _kinds(candidate)
        steps = max(n - 1, 1)
        low = candidate.lower()
        codes = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in low]
        changes = Counter(zip(kinds, kinds[1:]))
        same = sum(a == b for a, b in zip(kinds, kinds[1:]))
        words = re.findall(r"[^\W\d_]{3,}", low)
        covered = sum(len(x) for x in words if x in self.dictionary)
        prev = [x.lower() for x in re.findall(r"[\w=:]+", before)[-3:]]
        nxt = [x.lower() for x in re.findall(r"[\w=:]+", after)[:2]]
        near = " ".join([*prev, name.lower()])
        hexes = sum(c in "0123456789abcdefABCDEF" for c in candidate)
        about = re.findall(r"[a-z0-9]+", " ".join([*prev, name.lower(), low[:12]]))
        return [
            math.log(n), *(kinds.count(k) / n for k in "luds"), same / steps, *(changes[a, b] / steps for a, b in (("l", "d"), ("d", "l"), ("u", "d"), ("d", "u"), ("l", "u"), ("u", "l"))),
            float(np.mean([self.pairs[a, b] for a, b in zip(codes, codes[1:])])) if n > 1 else 0.0, entropy(candidate), hexes / n, len(set(candidate)) / n, covered / n, max(map(len, words), default=0) / n,
            float("@" in candidate), candidate.count(".") / n, float("/" in candidate), float(bool(name)), float(any(k in near for k in KEYWORDS)), float(before.rstrip().endswith(("=", ":", '"', "'"))),
            sum(x in self.dictionary for x in prev) / 3, sum(x in self.dictionary for x in nxt) / 2, *(float(h in path.lower()) for h in PATH_HINTS[:6]), float(any(h in path.lower() for h in PATH_HINTS[6:])),
            float(any(x in DIGEST_WORDS for x in about)), float(_UUID.fullmatch(candidate) is not None), float(hexes == n and n in (32, 40, 64, 128)), float(any(x in low for x in MADE_UP)), float(bool(ISSUED.fullmatch(candidate))),
        ]

    def score(self, rows: list[tuple[str, str, str, str, str]]) -> np.ndarray:
        return self.forest.score(np.array([self.features(*r) for r in rows], float)) if rows else np.zeros(0)


def hard_negatives(each: int = 40, seed: int = 3) -> list[tuple[str, str, str, str, str, int]]:
    """Made-up findings that look like secrets and are none, labelled 0: digests, identifiers, encoded data, made-up keys."""
    r = random.Random(seed)
    some = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    hexes, mixed, word = "0123456789abcdef", string.ascii_letters + string.digits, lambda: some(r.randint(2, 9), string.ascii_lowercase)
    uuid = lambda: "-".join(some(k, hexes) for k in (8, 4, 4, 4, 12))
    kinds = [
        lambda: (some(40, hexes), r.choice(("", "commit", "revision", "rev", "tree", "blob")), r.choice(("commit ", "at revision ", "merge ", "cherry-picked from ", "")), ""),
        lambda: (some(64, hexes), r.choice(("", "sha256", "digest", "checksum")), r.choice(("sha256 digest ", "checksum ", "image digest ", "")), ""),
        lambda: (some(32, hexes), r.choice(("", "md5", "etag", "hash")), r.choice(("md5 sum ", "etag ", "")), ""),
        lambda: (uuid(), r.choice(("", "id", "uuid", "request_id", "trace_id", "device")), r.choice(("request ", "uuid ", "id ", "")), ""),
        lambda: ("sha512-" + some(86, mixed + "+/") + "==", r.choice(("", "integrity")), "", r.choice(("package-lock.json", "yarn.lock", ""))),
        lambda: (some(r.randint(40, 160), mixed + "+/"), "", r.choice(("data:image/png;base64,", "base64 ", "encoded ")), ""),
        lambda: ("AKIA" + some(9, string.ascii_uppercase) + "EXAMPLE", r.choice(("", "key")), "", r.choice(("docs/readme.md", "test/sample.py", ""))),
        lambda: ("sk_test_" + some(24, mixed), r.choice(("", "key", "api_key")), "", r.choice(("tests/mock.py", "example.env", ""))),
        lambda: (r.choice(("your_api_key_here", "changeme123", "example-token-123", "xxxxxxxx1234", "placeholder_secret1")), r.choice(KEYWORDS), "", r.choice(("readme.md", "config.sample", ""))),
        lambda: (f"{word()}-{some(10, mixed)}.{r.choice(('js', 'css', 'png'))}", "", r.choice(("src ", "href ", "")), ""),
    ]
    out = []
    for make in kinds:
        for _ in range(each):
            value, name, before, path = make()
            inline = bool(name) and r.random() < 0.6
            out.append((value, name if inline else "", path, f"{word()} {word()} {before}" + (f'{name}: "' if name and not inline else ""), f" {word()} {word()}", 0))
    return out


def example_findings(each: int = 40, seed: int = 3) -> list[tuple[str, str, str, str, str, int]]:
    """Made-up labelled findings of every known format, so that the forest knows those that a table hardly has.

    (candidate, name, path, before, after, label); the strings are random, the formats those of the rules above.
    """
    r = random.Random(seed)
    some = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    upper, hexes, mixed = string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: some(r.randint(2, 9), string.ascii_lowercase)
    secret = [
        lambda: ("AKIA" + some(16, upper), ""), lambda: ("ghp_" + some(36, mixed), ""), lambda: ("sk_live_" + some(24, mixed), ""), lambda: ("xoxb-" + some(11, string.digits) + "-" + some(24, mixed), ""), lambda: ("AIza" + some(35, mixed), ""),
        lambda: (f"eyJ{some(17, mixed)}.eyJ{some(40, mixed)}.{some(43, mixed)}", ""), lambda: (some(r.choice((16, 18, 24, 32, 40)), hexes), r.choice(KEYWORDS)), lambda: (some(r.randint(20, 40), mixed), r.choice(KEYWORDS)),
        lambda: (word().title() + word().title() + word(), r.choice(PASSWORDS)), lambda: (word() + word() + word(), r.choice(PASSWORDS)), lambda: (word() + some(r.randint(1, 3), string.digits), r.choice(PASSWORDS)),
        lambda: ("-".join(some(k, hexes) for k in (8, 4, 4, 4, 12)), r.choice(("api_key", "client_secret", "auth_token", "secret"))), lambda: (some(r.choice((32, 40, 64)), hexes), r.choice(("api_key", "secret_key", "auth_token", "password"))),
        lambda: ("-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(some(64, mixed + "+/") for _ in range(r.randint(2, 12))) + "\n-----END RSA PRIVATE KEY-----", ""),
    ]
    harmless = [
        lambda: f"{word()}.{r.randint(1, 99)}@{word()}.example", lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), lambda: some(16, string.digits), lambda: f"555-{some(4, string.digits)}-{some(3, string.digits)}", lambda: f"20{some(2, '012')}-0{r.randint(1, 9)}-1{r.randint(0, 9)}",
        lambda: f"http://{word()}.example/{word()}{r.randint(1, 99)}", lambda: f"{word()}{word()}{r.randint(1, 999)}", lambda: f"{word()}_{word()}_{r.randint(1, 9)}", lambda: f"v{r.randint(1, 9)}.{r.randint(1, 20)}.{r.randint(1, 99)}-{word()}", lambda: f"{some(5, string.digits)},{some(3, string.digits)}",
    ]
    out = []
    for make in secret:
        for _ in range(each):
            value, name = make()
            inline = bool(name) and r.random() < 0.5
            before = f"{word()} {word()} " + (f'{name} = "' if name and not inline else "")
            out.append((value, name if inline else "", "", before, f" {word()} {word()}", 1))
    for make in harmless:
        out += [(make(), "", "", f"{word()} {word()} ", f" {word()} {word()}", 0) for _ in range(each)]
    return out


def fit(findings: DataFrame, label: str = "label", limit: int = TRAIN_FINDINGS) -> Scanner:
    """A scanner of at most ``limit`` labelled findings (columns of ``FINDING``, path and a 0/1 label; null labels are left out).

    Half of the bound is kept for either label, so that rare secrets are not crowded out.  The dictionary and the letter
    pairs come from the same findings' neighbouring words.  ``example_findings`` and ``hard_negatives`` come on top.
    """
    key = F.xxhash64("candidate", "name", "before", "after", "path")
    cols = ["candidate", "name", "path", "before", "after", label]
    part = lambda v: findings.where(F.col(label) == v).select(*cols, key.alias("k")).dropDuplicates(["k"]).orderBy("k").limit(limit // 2)
    rows = [tuple(r)[:6] for r in part(1).collect()] + [tuple(r)[:6] for r in part(0).collect()]
    own = len(rows)
    rows += example_findings() + hard_negatives()
    words = Counter(x for r in rows[:own] for s in (r[3], r[4]) for x in re.findall(r"[^\W\d_]+", s.lower()) if len(x) >= 2)
    dictionary = frozenset(x for x, _ in sorted(words.items(), key=lambda p: (-p[1], p[0]))[:DICTIONARY])
    seen = np.ones((27, 27))
    for x, n in words.items():
        codes = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in x]
        for a, b in zip(codes, codes[1:]):
            seen[a, b] += n
    scanner = Scanner(np.log(seen / seen.sum(1, keepdims=True)), dictionary, RandomForest(np.zeros((0, 1)), np.zeros(0)))
    x = np.array([scanner.features(*r[:5]) for r in rows], float) if rows else np.zeros((0, 1))
    scanner.forest = RandomForest(x, np.array([r[5] for r in rows], float))
    return scanner


def rule_labels(findings: DataFrame) -> DataFrame:
    """``findings`` and label (1, 0 or null) by ``rule_label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            args = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("candidate", "name", "before")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([rule_label(*a) for a in zip(*args)], pa.int32())], names=[*batch.schema.names, "label"])

    return findings.mapInArrow(run, T.StructType([*findings.schema.fields, T.StructField("label", T.IntegerType())]))


def judged(findings: DataFrame, scanner: Scanner, threshold: float = 0.5) -> DataFrame:
    """``findings`` with score double and is_secret int."""
    schema = T.StructType([*findings.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("is_secret", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            args = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("candidate", "name", "path", "before", "after")]
            s = scanner.score(list(zip(*args)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return findings.mapInArrow(run, schema)


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, scanner: Scanner | None = None) -> DataFrame:
    """Every candidate of ``docs`` with its score and is_secret; without a scanner, one is fitted on rule-labelled findings of a bounded share.

    Null and empty texts have no candidates.  Each row is scanned by itself and whole, however long, so repeated rows and
    ids give repeated findings, there are no ties, and clashing columns are not looked at.
    """
    found = checkpointed(find(docs, text, keep, path))
    if scanner is None:
        scanner = fit(rule_labels(found))
    return judged(found, scanner)


def redacted(docs: DataFrame, scanner: Scanner, text: str = "text", path: str | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced; null texts stay null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, text):
            at = batch.schema.get_field_index(text)
            col = batch.column(at)
            found = candidates(col)
            paths = batch.column(batch.schema.get_field_index(path)).cast(pa.string()).to_pylist() if path else [""] * batch.num_rows
            s = scanner.score([(f[2], f[3], paths[r] or "", f[4], f[5]) for r, f in found])
            hits: dict[int, list[tuple[int, int]]] = {}
            for (r, f), value in zip(found, s):
                if value >= 0.5:
                    hits.setdefault(r, []).append((f[0], f[1]))
            if hits:
                texts = col.to_pylist()
                for r, spans in hits.items():
                    for a, b in sorted(spans, reverse=True):
                        texts[r] = texts[r][:a] + mark + texts[r][b:]
                col = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([col if k == at else c for k, c in enumerate(batch.columns)], names=names)

    return docs.mapInArrow(run, docs.schema)


def op3_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, start, end, candidate_sha256, score, is_secret of every candidate of every document."""
    digest = F.sha2(F.col("candidate"), 256).alias("candidate_sha256")
    return scan(documents, path="source").select("doc_id", "start", "end", digest, "score", "is_secret")
