"""Plain restatements of the contracts, one row at a time, for small tables."""

import hashlib
import math
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")

EDGE = [
    None, "", " ", "\n\n\n", "a", "word " * 60, "a b c a b c a b c", "x\ny\nx\n \nx", "日本語 テキスト ümlaut nbsp \U0001f600 emoji",
    "mail a.b@c.de_x@y.zz.q and a@b@c.com a@b. z@-.- %@a.b", "1.2.3.4.5.6.7.8 999.1.2.3.4 0001.02.3.255 1.2.3.256 1..2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 x 4111  1111 1111 1111 12345678901234567890 00000000000000 9380942693487180",
    "+1 (017) 555-7713 call +12 +123456789012345678 ++1 555 010 9999+44 20 7946 0958.", "\U0001f600 a@b.cd \U0001f600 10.0.0.1\r\n+1 555 555 5555",
    "IBAN DE89 3704 0044 0532 0130 00 bank GB82WEST12345698765432 DE00370400440532013000", "ssn 078-05-1120 or 123-45-6789 and 000-12-3456",
    "#" * 70 + " $ % & | < > *", "1" * 3000, "1.1" * 1500, "a" * 5000 + "@" + "b." * 2000 + "c", "+1" + " ()" * 2000 + "9", "1 2-3 " * 800,
]


def op3(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def bucket(*words, buckets=16384):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return seed % buckets if seed < 1 << 63 else (seed - (1 << 64)) % buckets


def grams(text):
    words = [w.lower() for w in WORD.findall(text or "")]
    return [bucket(w) for w in words] + [bucket(*p) for p in zip(words, words[1:])]


def op3_llr(rows, trusted):
    """rows: [(id, text)] -> {id: (sum of whole-number weights, grams)}."""
    t, n = [0] * 16384, [0] * 16384
    of = [(i, grams(x)) for i, x in rows]
    for i, g in of:
        for b in g:
            n[b] += 1
            t[b] += i in trusted
    shift = math.log(sum(n) + 16384) - math.log(sum(t) + 16384)
    w = [round(10_000 * (math.log(a + 1) - math.log(b + 1) + shift)) if sum(t) else 0 for a, b in zip(t, n)]
    return [(i, sum(w[b] for b in g), len(g)) for i, g in of]


def luhn(digits):
    return sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
]


def op9(text):
    text = text or ""
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(BASE) for m in re.finditer(p, text) if ok(m[0])]
    listed = ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(found))
    return [sum(f[2] == name for f in found) for name, *_ in BASE] + [hashlib.sha256(listed.encode()).hexdigest(), listed]
