"""Plain versions of the training-data operators, for small inputs."""

import hashlib
import re


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def contamination(docs, items, window=10):
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    tests = {}
    for i, t in items:
        w = re.findall(pattern, lower(t or ""))
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if n else ():
            tests.setdefault(tuple(w[s : s + n]), set()).add("" if i is None else str(i))
    sizes = sorted({len(k) for k in tests})
    out = {}
    for d, t in docs:
        w = re.findall(pattern, lower(t or ""))
        hit, ids = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in tests:
                    hit.update(range(s, s + n))
                    ids |= tests[k]
        out[d] = (len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit))
    return out


def word_sets(docs, size):
    out = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def near_duplicates(docs, size, threshold=80):
    sets = word_sets(docs, size)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    owners = {}
    for i, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in owners[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    group = {}
    for i, (d, _) in enumerate(docs):
        group.setdefault(find(i), []).append(d)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in group.items()}
    return sorted([(d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(docs)], key=str)


def repeats(docs, window=100):
    """docs in order: (id, text). Equal (id, text) rows are one document."""
    first, out, done = {}, [], {}
    for d, t in docs:
        raw = (t or "").encode()
        if (d, raw) in done:
            out.append(done[d, raw])
            continue
        covered = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            w = raw[s : s + window]
            if w in first:
                covered[s : s + window] = b"\1" * window
            else:
                first[w] = (d, s)
        spans = len(re.findall(b"\1+", bytes(covered)))
        done[d, raw] = (d, len(raw), sum(covered), spans, sha(bytes(b for b, c in zip(raw, covered) if not c)))
        out.append(done[d, raw])
    return out


def base_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeat = {p + k for v in grams.values() if len(v) > 1 for p in v for k in range(5)}
    failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat), failed


def secrets(text):
    t = text or ""
    kinds = (
        ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    )
    out = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, g, n) in enumerate(kinds) for m in re.finditer(p, t) if len(m[g]) >= n]
    return [sum(i == k for _, i, _ in out) for k in range(3)], ",".join(x for _, _, x in sorted(out))


def url(u, rules, default="allow"):
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = lower(raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [r for r in rules if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default
