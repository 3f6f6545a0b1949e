"""The contracts of the numbered queries in plain Python, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def mix_targets(sizes: dict, weights=(5, 2, 1), share=Fraction(3, 2), most=2) -> dict:
    """Target of each source by resharing what full sources leave."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        part = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s] if s in full else part[s]) for s in names}
        full |= over


def repeats(texts: list[str], length=200) -> list[tuple[int, int, int, str]]:
    data = [t.encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    found = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        found.append((len(d), sum(gone), runs, digest(kept)))
    return found


def simhash(text: str, shingle=3) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    if words and len(words) < shingle:
        parts = [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(ids: list, prints: list[int], radius=3) -> list:
    values = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    label = np.arange(len(ids))
    while True:
        new = np.where(near, label[None, :], len(ids)).min(axis=1)
        if (new == label).all():
            break
        label = new
    least = defaultdict(lambda: None)
    for i, k in zip(ids, label, strict=True):
        if i is not None:
            least[k] = i if least[k] is None else min(least[k], i)
    return [least[k] for k in label]


SECRETS = [
    (
        "assign",
        r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        lambda m: len(m[1]) >= 8,
    ),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]


def secrets(text: str) -> tuple[list[int], str]:
    spans, counts = [], []
    for place, (_, pattern, good) in enumerate(SECRETS):
        found = [(m.start(), place, m.end()) for m in re.finditer(pattern, text) if good(m)]
        counts.append(len(found))
        spans += found
    return counts, ",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in sorted(spans))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


PRIVATE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (
        "ip",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        lambda m: all(int(p) <= 255 for p in m.split(".")),
    ),
    (
        "card",
        r"[0-9]([\x20-]?[0-9])+",
        lambda m: 13 <= len(_digits(m)) <= 19 and luhn(_digits(m)),
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m)) <= 15),
]


def private(text: str) -> tuple[list[int], str]:
    spans, counts = [], []
    for name, pattern, good in PRIVATE:
        found = [f"{name}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if good(m[0])]
        counts.append(len(found))
        spans += found
    return counts, ",".join(spans)


def spots(text: str, common: list[str]) -> set[int]:
    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    content = [w for w in words if w not in common]
    crc = lambda parts: zlib.crc32(" ".join(parts).encode())
    if len(content) == len(words):
        return {crc(content[i : i + 3]) for i in range(len(content))}
    found, before = set(), 0
    for w in words:
        if w in common:
            found.add(crc([w, *content[before : before + 2]]))
        else:
            before += 1
    return found


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def damage(rows: list[tuple]) -> list[tuple]:
    """Damaged `(conv_id, turn, role, text)` rows."""
    found = []
    for conv_id, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv_id, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv_id, turn, "user" if kind == 4 else role, text)
        found += [row] * (2 if kind == 3 else 1)
    return found


def repair(rows: list[tuple]) -> tuple:
    """Counts, cost, audit and repaired lines of one conversation's damaged rows, in order."""
    turns = {t for _, t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        said = [c for c in text if c not in " \t\n\v\f\r"]
        fault = "blank" if not said else "duplicate" if (role, text) in seen else None
        faults.append(fault or ("truncated" if said[-1] not in ".!?" else None))
        seen.add((role, text))
    initials = [role[:1] for _, _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    # Every way that is not already dearer, by cost and audit: (lines) per prefix of rows.
    allowed = re.compile("s?(ua)*u?")
    ways = {"": (0, "", ())}

    def better(into, key, way):
        if allowed.fullmatch(key) and (key not in into or way < into[key]):
            into[key] = way

    def inserted(ways):
        for _ in range(2):
            for key, (cost, audit, lines) in list(ways.items()):
                for role in ("user", "assistant"):
                    better(ways, key + role[0], (cost + 5, audit + "I", (*lines, f"{role}:")))
        return ways

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for key, (cost, audit, lines) in inserted(ways).items():
            better(after, key, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + 5 * (fault == "truncated")
            if role:
                better(after, key + role[0], (more, audit + "K", (*lines, f"{role}:{text}")))
            for new in ("user", "assistant"):
                better(after, key + new[0], (more + 1, audit + "R", (*lines, f"{new}:{text}")))
        ways = after
    whole = [w for key, w in inserted(ways).items() if re.fullmatch("(s?(ua)+)?", key)]
    cost, audit, lines = min(whole)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest("\n".join(lines)))


def variants(docs: list[tuple]) -> list[tuple]:
    """Word, form, root, n, n_near, form_n from `(doc_id, text)` rows, comparing all words."""
    count = Counter()
    upper = {i: i + 32 for i in range(65, 91)}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            count[run if h % 31 else run[:at] + run[at + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    partners = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, others in partners.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            forms[w] = best
    found = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        found.append((w, forms.get(w), root, n, len(partners[w]), words.get(forms.get(w))))
    return found


def tree_score(base: float, feature, edge, leaf, row: list[float]) -> float:
    """Boosted trees walked one after the other, node by node, for one row."""
    total = float(base)
    for features, edges, leaves in zip(feature.tolist(), edge.tolist(), leaf.tolist()):
        node = 0
        while node < len(features):
            node = 2 * node + (2 if row[features[node]] > edges[node] else 1)
        total += leaves[node - len(features)]
    return 1 / (1 + math.exp(-total))
