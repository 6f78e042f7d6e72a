"""Plain Python versions of the operators, and rows that are hard to handle."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(30_000))
EDGE = [
    (None, None), (None, "same words again and again"), (1, None), (2, ""), (3, " \t\n "), (4, "one"),
    (5, "Two words"), (6, "two words"), (7, LONG), (8, LONG + " end"), (9, "same words again and again"),
    (9, "same words again and again"), (10, "a\x00b é ñ ß 漢字 😀"), (11, "\n\n\n\n"),
    (12, "İSTANBUL ΣΑΣ     x"), (13, "."), (14, "12 345"),
]
SCHEMA = "doc_id long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text: str | None, size: int, pattern: re.Pattern = WORD) -> set[tuple[str, ...]]:
    w = pattern.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_groups(rows, size: int, percent: int) -> list[tuple]:
    """(doc_id, shingles, smallest doc_id reachable) of each row."""
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        smallest[find(i)].append(doc_id)
    found = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in smallest[find(i)] if x is not None]
        found.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return found


def without_repeats(rows, length: int) -> list[tuple]:
    """(doc_id, words, words removed, kept text) of each row."""
    split = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[k:k + length]) for w in split for k in range(len(w) - length + 1))
    found = []
    for (doc_id, _), w in zip(rows, split, strict=True):
        stays = [True] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k:k + length])] > 1:
                stays[k:k + length] = [False] * length
        kept = [x for x, s in zip(w, stays, strict=True) if s]
        found.append((doc_id, len(w), len(w) - len(kept), " ".join(kept)))
    return found


def contained(rows, items, size: int, percent: int) -> list[tuple]:
    found = []
    for doc_id, text in rows:
        ours = shingles(text, size, TOKEN)
        for item_id, item in items:
            theirs = shingles(item, size, TOKEN)
            if theirs and 100 * len(ours & theirs) >= percent * len(theirs):
                found.append((doc_id, item_id, len(theirs), len(ours & theirs)))
    return found


def exact_groups(rows) -> list[tuple]:
    """(doc_id, keep_id, group size, digest) of each row."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    found = []
    for content, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        found += [(doc_id, keep, len(members), sha(content)) for doc_id, _ in members]
    return found


def without_repeated_lines(rows) -> list[tuple]:
    """(doc_id, lines, lines removed, kept text); ids are unique."""
    seen, found = set(), []
    for doc_id, text in sorted(rows):
        split = text.split("\n")
        gone = set()
        for i in range(len(split) - 2):
            window = tuple(split[i:i + 3])
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        found.append((doc_id, len(split), len(gone),
                      "\n".join(x for i, x in enumerate(split) if i not in gone)))
    return found


def sort_key(row):
    return tuple((x is None, str(x)) for x in row)


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=sort_key)


def without_repeated_bytes(rows, length: int) -> list[tuple]:
    """(doc_id, bytes, bytes removed, runs removed, kept) of each row."""
    data = [(doc_id, (t or "").encode()) for doc_id, t in rows]
    seen = Counter(b[k:k + length] for _, b in data for k in range(len(b) - length + 1))
    found = []
    for doc_id, b in data:
        stays = bytearray(b"\1" * len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                stays[k:k + length] = bytes(length)
        kept = bytes(x for x, s in zip(b, stays, strict=True) if s)
        runs = sum(not s and (k == 0 or bool(stays[k - 1])) for k, s in enumerate(stays))
        found.append((doc_id, len(b), len(b) - len(kept), runs, kept))
    return found


def best_documents(rows, items, top: int) -> list[tuple]:
    """(item_id, rank, doc_id, score) by scoring everything."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return pattern.findall((text or "").translate(LOWER))

    docs = [(doc_id, Counter(w), len(w)) for doc_id, t in rows if (w := terms(t))]
    total = sum(n for _, _, n in docs)
    df = Counter(w for _, counts, _ in docs for w in counts)
    found = []
    for item_id, text in items:
        scored = []
        for doc_id, counts, n in docs:
            m = 100 - 25 + 25 * n * len(docs) // total
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[w] + 1)))
                        * (10**9 * counts[w] // (1000 * counts[w] + 12 * m))
                        for w in terms(text) if counts[w])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        found += [(item_id, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return found


def repaired(rows) -> list[tuple]:
    """Damage, faults and the cheapest repair of each conversation, by a search over all edits."""
    space = " \t\n\x0b\x0c\r"
    talks = defaultdict(list)
    for c, t, r, x in rows:
        talks[c]
        r, x = " " if r is None else r, " " if x is None else x
        part = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if part == 1 else re.sub("[.!?]", "", x) if part == 2 else x
        if part:
            talks[c] += [(t, "user" if part == 4 else r, x)] * (2 if part == 3 else 1)
    found = []
    for c, turns in talks.items():
        turns.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
        seen, faults = set(), []
        for _, r, x in turns:
            core = x.strip(space)
            faults.append("blank" if not core else "duplicate" if (r, x) in seen else
                          "truncated" if core[-1] not in ".!?" else "")
            seen.add((r, x))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au")
                      for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, kept = _cheapest(turns, faults)
        found.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                      illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in kept)), kept))
    return found


def _cheapest(turns, faults):
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, kept = heapq.heappop(heap)
        if i == len(turns) and last in ("", "a"):
            return cost, audit, kept
        if (i, last) in done:
            continue
        done.add((i, last))
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        roles = [r for r in ("user", "assistant") if r[0] in legal]
        for r in roles:
            heapq.heappush(heap, (cost + 3, audit + "I", i, r[0], (*kept, (r, ""))))
        if i < len(turns):
            _, role, text = turns[i]
            more = 3 * (faults[i] == "truncated")
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, kept))
            if faults[i] not in ("blank", "duplicate"):
                if role and role[0] in legal:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0],
                                          (*kept, (role, text))))
                for r in roles:
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, r[0],
                                          (*kept, (r, text))))
