"""Plain computations that results are held against."""

import bisect
import math
import re
import zlib
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return words((text or "").translate(FOLD))


def quality_base(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {i + k for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for k in range(5)}
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed)


def shingles(text, k):
    ws = folded(text)
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)])


def jaccard(rows, k, percent):
    """rows: (doc_id, text) -> multiset of (doc_id, n_shingles, component_id, n_links), null ids allowed."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = defaultdict(list)
    for i in range(len(rows)):
        if rows[i][0] is not None:
            least[root(i)].append(rows[i][0])
    return Counter((rows[i][0], len(sets[i]), min(least[root(i)], default=None), links[i]) for i in range(len(rows)))


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def fold_of(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def unigram(rows, held_out):
    """rows: (doc_id, text); held_out: ids not learnt from, null ids neither -> per row n_tokens, n_known, N, base."""
    tokens = [folded(t) + [""] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens) if i is not None and not held_out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for (i, _), ws in zip(rows, tokens)]


def level(sizes, weights):
    """Targets of a mix by cutting and sharing again."""
    total = 1.5 * sum(sizes)
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w >= 2 * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
        left -= sum(target[i] for i in over)
        open_ -= over
    return target


def mixed_bits(texts, training, length, code, settings):
    """Bits of each text by online mixing, decision by decision; ``length`` and ``code`` (32 bits, from the top) by byte before and byte."""

    def contexts(line, i):
        before = b"\n" * 24 + line[:i]
        word = before[max(before.rfind(b" "), before.rfind(b"\n")) + 1 :][-16:]
        return ("four", before[-4:]), ("word", word, before[-1:])

    follow = defaultdict(Counter)
    for line in training:
        for i, b in enumerate(line):
            for c in contexts(line, i):
                follow[c][b] += 1

    def scored(line):
        bits = 0.0
        for i, b in enumerate(line):
            if i % settings.window == 0:
                weights = [[settings.start] * 2 for _ in range(2)]
                scale, shift = 1.0, 0.0
            before = line[i - 1] if i else 10
            row = before * 256 + b
            own = contexts(line, i)
            for d in range(int(length[row])):
                bit = int(code[row]) >> (31 - d) & 1
                st = []
                for c in own:
                    met = [0, 0]
                    for other, n in follow[c].items():
                        at = before * 256 + other
                        if length[at] > d and int(code[at]) >> (32 - d) == int(code[row]) >> (32 - d):
                            met[int(code[at]) >> (31 - d) & 1] += n
                    x = math.log((met[1] + 0.4) / (met[0] + 0.4))
                    st.append(round(max(-7.8, min(7.8, x)) * 8) / 8)
                w = weights[st[1] != 0]
                dot = sum(a * x for a, x in zip(w, st))
                p = 1 / (1 + math.exp(-dot))
                r = 1 / (1 + math.exp(-(dot * scale + shift)))
                right = r if bit else 1 - r
                bits -= math.log2(right * (1 - 2 * 2**-14) + 2**-14)
                for k, x in enumerate(st):
                    w[k] += settings.rate * (bit - p) * x
                shift += settings.refine * (bit - r)
                scale += settings.refine * (bit - r) * dot
        return bits

    return [scored(line) for line in texts]


def languages(train, texts, longest):
    """(language, score) of each text from (text, language) rows: words by log frequency, unseen ones by n-grams."""
    find = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    names = sorted({at for t, at in train if find(t)})
    kinds = [{at: Counter() for at in names} for _ in range(2)]
    for t, at in train:
        for w in find(t):
            kinds[0][at][w] += 1
            w = f" {w} "
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    kinds[1][at][w[i : i + k]] += 1
    met = [set().union(*c.values()) for c in kinds]
    sums = [{at: sum(c[at].values()) for at in names} for c in kinds]
    log = lambda kind, x: [math.log((kinds[kind][at][x] + 1) / (sums[kind][at] + len(met[kind]) + 1)) for at in names]
    out = []
    for t in texts:
        ws = find(t)
        if not ws or not names:
            out.append(("und", 0.0))
            continue
        total = [0.0] * len(names)
        for w in ws:
            if w in met[0]:
                own = log(0, w)
            else:
                padded, i, found = f" {w} ", 0, []
                while i < len(padded):
                    k = next((k for k in range(longest, 0, -1) if i + k <= len(padded) and padded[i : i + k] in met[1]), 0)
                    if k:
                        found.append(log(1, padded[i : i + k]))
                    i += k or 1
                own = [sum(x) / len(found) for x in zip(*found)] if found else [0.0] * len(names)
            total = [a + b for a, b in zip(total, own)]
        best = max(range(len(names)), key=lambda j: (total[j], -j))
        out.append((names[best], 1 / sum(math.exp(max(-700, (x - total[best]) / math.sqrt(len(ws)))) for x in total)))
    return out


def best_fit(lengths, capacity):
    """Gaps of the sequences that best-fit decreasing makes, piece by piece."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - x)
    return gaps
