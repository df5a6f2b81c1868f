"""Plain versions of the operators, to hold results against."""

import hashlib
import re
import zlib

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(text):
    return zlib.crc32(text.encode())


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(account):
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    out = []
    for place, (kind, (pattern, good)) in enumerate(PII.items()):
        out += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text or "") if good(m[0])]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def line_dedup(docs, least_chars=40, least_docs=5):
    """docs: (doc_id, text) -> {(doc_id): (n_lines, n_dropped, text)} of the last such row."""
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(k := key(line)) >= least_chars:
                holders.setdefault(k, set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= least_docs}
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out
