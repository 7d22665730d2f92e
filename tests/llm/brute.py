"""Plain readings of the contracts, one text at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def folded_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def contamination(docs: list[tuple], items: list[tuple]) -> dict:
    windows = defaultdict(set)
    for name, text in items:
        w = folded_words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i:i + 13])].add(name)
    sizes = {len(k) for k in windows}
    out = {}
    for doc_id, text in docs:
        w, hit, names = folded_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i:i + n]))
                if got:
                    hit.update(range(i, i + n))
                    names |= got
        ids = sorted(str(x) for x in names if x is not None)
        out[doc_id] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def quality(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
            len(words) < 10 or 100 * len(repeated) > 20 * len(words))


def shared_lines(docs: list[tuple], least: int = 10, keep_first: bool = False, spare_whole: bool = False) -> dict:
    def key(line: str) -> str:
        return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(UPPER)
    seen = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            seen[key(line)].add(doc_id)
    first = {}
    for doc_id, text in sorted(docs):
        for at, line in enumerate((text or "").split("\n")):
            first.setdefault(key(line), (doc_id, at))
    out = {}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for at, x in enumerate(lines) if not key(x) or len(seen[key(x)]) < least or keep_first and first[key(x)] == (doc_id, at)]
        if spare_whole and not any(key(x) for x in kept):
            kept = lines
        out[doc_id] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def licenses(text: str | None) -> tuple:
    words = folded_words(text)
    at, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split(" ")
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text: str | None) -> tuple:
    text, spans = text or "", []
    spans += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    shown = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
    return tuple(sum(x[1] == i for x in spans) for i in range(3)) + (hashlib.sha256(shown.encode()).hexdigest(), shown)


def url(value: str | None) -> tuple:
    host, path = "", ""
    if value and "://" in value:
        rest = value.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = host.translate(UPPER)
    best = None
    for h, p, v in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h) + len(p) > len(best[0])):
            best = (h + p, v)
    return (host, path, *(best or (None, "allow")))
