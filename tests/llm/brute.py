"""Slow, plain versions of the operators' contracts."""

import re

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    import xxhash

    words = space_words((text or "").translate(FOLD))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, bits=2):
    """Least id reachable for each row; prints that differ in ``bits`` bits or fewer are linked."""
    out = []
    left = set(range(len(ids)))
    root = [None] * len(ids)
    while left:
        group, waiting = set(), [left.pop()]
        while waiting:
            i = waiting.pop()
            group.add(i)
            near = {j for j in left if bin(prints[i] ^ prints[j]).count("1") <= bits}
            left -= near
            waiting += near
        known = [ids[i] for i in group if ids[i] is not None]
        for i in group:
            root[i] = min(known) if known else None
    out.extend(root)
    return out


def contamination(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))

    spans = {}
    for i, t in items:
        w = words(t)
        m = min(13, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            spans.setdefault(tuple(w[s : s + m]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(k) for k in spans}:
            for s in range(len(w) - m + 1):
                if items_here := spans.get(tuple(w[s : s + m])):
                    hit |= set(range(s, s + m))
                    found |= items_here
        out.append((d, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def quality(text):
    text = text or ""
    w, places = space_words(text), {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if space_words(line):
            again += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(repeated))


PII = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    parts = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
    return sum(p - 9 * (p > 9) for p in parts) % 10 == 0


def personal(text):
    out = []
    for kind, pattern in enumerate(PII):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            good = [True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15][kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def ppm(rows, held, order=4):
    """Scores of each row by tries of dictionaries: (n_tokens, n_known, N, base, score)."""
    import math

    def words(t):
        return [*space_words((t or "").translate(FOLD)), None]

    def framed(t):
        return b"\xff" * order + (t or "").encode() + b"\xff"

    count, trie = {}, {}
    for (i, t), h in zip(rows, held):
        if h:
            continue
        for w in words(t):
            count[w] = count.get(w, 0) + 1
        b = framed(t)
        for j in range(order, len(b)):
            for k in range(order + 1):
                e = trie.setdefault(b[j - k : j], {})
                e[b[j]] = e.get(b[j], 0) + 1
    total, kinds = sum(count.values()), len(count)
    out = []
    for _, t in rows:
        w = words(t)
        base = sum(math.log10((count.get(x, 0) + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        b, score = framed(t), 0.0
        for j in range(order, len(b)):
            out_of, p = set(), 1.0
            for k in range(order, -1, -1):
                e = {s: n for s, n in trie.get(b[j - k : j], {}).items() if s not in out_of}
                if not e:
                    continue
                whole = sum(e.values()) + len(e)
                if b[j] in e:
                    p *= e[b[j]] / whole
                    break
                p *= len(e) / whole
                out_of |= e.keys()
            else:
                p /= 256 - len(out_of)
            score += math.log10(p)
        out.append((len(w), sum(x in count for x in w), total, base, score))
    return out


def string_kernel_margins(train, labels, texts, landmarks, ridge):
    """Margins (a row for each text, a column for each sorted label) by explicit kernels between sets of grams."""
    import numpy as np

    def grams(text):
        raw = b" ".join(text.translate(FOLD).encode().split())
        raw = b" " + raw + b" "
        return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}

    def kernel(a, b):
        return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])

    sets = [grams(t) for t in train]
    count, marks = {}, []
    for g, label in zip(sets, labels):
        count[label] = count.get(label, 0) + 1
        if count[label] <= landmarks:
            marks.append(g)
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-6 * values[-1]
    half = vectors[:, good] / np.sqrt(values[good])
    x = kernel(sets, marks) @ half
    names = sorted(set(labels))
    y = np.array([[1.0 if label == n else -1.0 for n in names] for label in labels])
    centre, level = x.mean(axis=0), y.mean(axis=0)
    # The dual form: one coefficient for each training text.
    xc = x - centre
    dual = np.linalg.solve(xc @ xc.T + ridge * len(x) * np.eye(len(x)), y - level)
    return (kernel([grams(t) for t in texts], marks) @ half - centre) @ xc.T @ dual + level


def content_words(chain, text, text_lines):
    """Words of the lines on the best path, by trying the best end of every prefix for both states (no back pointers)."""
    import numpy as np

    lines = text_lines(text.encode())[0]
    if not lines:
        return 0
    if not chain.fitted:
        return sum(n for n, _ in lines)
    best = {}
    for i, (n, f) in enumerate(lines):
        gain = (0.0, float(np.dot(f, chain.weights)))
        if i == 0:
            best = {s: (chain.start[s] + gain[s], n * s) for s in (0, 1)}
        else:
            best = {s: max(((best[q][0] + chain.steps[q, s] + gain[s], best[q][1] + n * s) for q in (0, 1)), key=lambda v: (v[0])) for s in (0, 1)}
    return max(best.values(), key=lambda v: v[0])[1]


def chain_gradient(params, x, y, features, lengths):
    """Gradient, by small differences, of the mean log likelihood by line of chains whose lines all have their document's state."""
    import itertools

    import numpy as np

    def likelihood(p):
        weights, steps, start = p[:features], p[features:-2].reshape(2, 2), p[-2:]

        def score(doc, path):
            return start[path[0]] + sum(doc[i] @ weights for i, s in enumerate(path) if s) + sum(steps[a, b] for a, b in zip(path, path[1:]))

        total = 0.0
        for doc, state, n in zip(x, y, lengths.tolist()):
            every = [score(doc, path) for path in itertools.product((0, 1), repeat=n)]
            total += (score(doc, (state,) * n) - np.log(np.exp(every).sum())) / n
        return total / len(x)

    h = 1e-5
    return np.array([(likelihood(params + h * e) - likelihood(params - h * e)) / (2 * h) for e in np.eye(len(params))])
