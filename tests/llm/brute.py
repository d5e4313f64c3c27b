"""Plain versions of the operators, row by row, to test against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingle_set(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def near_duplicates(docs, percent=85):
    """{doc_id: (n_shingles, component)} of {doc_id: text}."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    post = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            post[x].append(i)
    pairs = Counter()
    for ids in post.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1:]:
                pairs[a, b] += 1
    links = [p for p, n in pairs.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    comp = components(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def repeated_bytes(docs, length=200):
    """{doc_id: sorted covered byte positions}."""
    data = {i: (t or "").encode() for i, t in docs.items()}
    count = Counter(b[k:k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        covered = set()
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                covered.update(range(k, k + length))
        out[i] = sorted(covered)
    return out


def trie(rows):
    """Nodes of the trie of rebuilt conversations, from (conv_id, turn, role, text) rows."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            step = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append((turn is not None, turn or 0, step, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, path in sorted(rebuilt.items()):
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for prefix, convs in members.items():
        if prefix:
            children[prefix[:-1]] += 1
    for prefix, convs in members.items():
        gain = (len(convs) - 1) * len(prefix[-1][1].encode()) if prefix else 0
        for d in range(len(prefix) + 1):
            saved[prefix[:d]] += gain
            leaves[prefix[:d]] += not children[prefix]
    return sorted((convs[0], len(p), members[p[:-1]][0] if p else -1, len(convs), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in convs if len(rebuilt[c]) == len(p)).encode()).hexdigest())
                  for p, convs in members.items())
