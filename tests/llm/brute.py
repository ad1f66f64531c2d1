"""Plain versions of whole queries, one text at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}


def floor_mean(values):
    return sum(values) // len(values) if values else 0


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])], len(words)


def importance_resampling(rows, target, percent=25, least_words=20, buckets=10_000, seed=7):
    """(doc_id, n_features, weight, score, rank) of every row."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[0]))
    for text in target:
        t.update(map(bucket, features(text)[0]))
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out, eligible = [], []
    for doc, text in rows:
        found, n = features(text)
        weight = floor_mean([gain(bucket(f)) for f in found])
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(found), weight, score, None])
        if n >= least_words:
            eligible.append(out[-1])
    eligible.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for rank, row in enumerate(eligible[: percent * len(eligible) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=str)


def _one_edit(word, letters):
    for k in range(len(word) + 1):
        for c in letters:
            yield word[:k] + c + word[k:]
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            for c in letters:
                yield word[:k] + c + word[k + 1 :]


def spelling_variants(rows, least_letters=7, least_count=2, times=10):
    """(word, form, root, n, n_near, form_n) of every word."""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}
    letters = sorted({c for w in counts for c in w})
    forms, near = {}, {}
    for word, n in counts.items():
        found = {w for w in _one_edit(word, letters) if w in counts and w != word}
        near[word] = len(found)
        best = min(found, key=lambda w: (-counts[w], w), default=None)
        forms[word] = best if best is not None and counts[best] >= times * n else None
    out = []
    for word, n in counts.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        out.append((word, forms[word], root, n, near[word], counts.get(forms[word])))
    return sorted(out, key=str)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def secrets(text):
    """Base (kind, start, end), by start, then kind."""
    text = text or ""
    assign = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """Base (kind, start, end), by kind, then start."""
    text = text or ""
    valid = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(re.sub("[^0-9]", "", s)) <= 19 and _luhn(re.sub("[^0-9]", "", s)),
        "phone": lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    return [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if valid[k](m[0])]


def counts(spans, kinds):
    held = Counter(k for k, *_ in spans)
    return tuple(held[k] for k in kinds)


def groups(links, nodes):
    """The smallest node that each node reaches."""
    around = defaultdict(set)
    for a, b in links:
        around[a].add(b)
        around[b].add(a)
    out = {}
    for node in sorted(nodes):
        if node in out:
            continue
        todo = [node]
        while todo:
            at = todo.pop()
            if at not in out:
                out[at] = node
                todo += around[at]
    return out
