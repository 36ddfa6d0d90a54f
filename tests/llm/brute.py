"""Plain versions of the operators, for small inputs."""

import hashlib
from collections import Counter

import xxhash


def repeats(texts, length=400):
    """(n_bytes, n_removed, n_spans, sha256 of the bytes kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def near_components(rows, radius=2):
    """{row index: smallest doc_id reachable} for (doc_id, fingerprint) rows."""
    rep = {}
    for d, f in rows:
        rep.setdefault(f, []).append(d)
    fps = list(rep)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    best = {}
    for f in fps:
        r = find(f)
        best[r] = min([best.get(r, 1 << 62), *rep[f]])
    return [best[find(f)] for _, f in rows]


def fewest_bins(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in seen:
                seen.add(bins[k])
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    inside = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def language(train, texts, dimensions=1024):
    """(lang, cosine) of each text by bundled trigrams of random letter vectors, one letter and one trigram at a time; train holds (lang, text)."""
    from collections import defaultdict
    from functools import lru_cache

    import numpy as np

    from waymark.llm import langid

    @lru_cache(None)
    def vector(sign):
        return langid.sign_vectors(np.array([sign]), dimensions)[0].astype(int)

    def signs(text):
        out = [0]
        for c in text.lower():
            s = ord(c) if c.isalpha() else 0
            if s or out[-1]:
                out.append(s)
        return out + [0] if out[-1] else out

    def bundle(text):
        s = signs(text)
        total = np.zeros(dimensions)
        n = 0
        for a, b, c in zip(s, s[1:], s[2:]):
            total += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
            n += 1
        return total, n

    sums, sizes = defaultdict(lambda: np.zeros(dimensions)), Counter()
    for lang, text in train:
        if any(c.isalpha() for c in text.lower()):
            total, n = bundle(text)
            sums[lang] += total
            sizes[lang] += n
    langs = sorted(sums)
    known = np.array([sums[x] / sizes[x] for x in langs])
    if len(langs) > 1:
        known = known - known.mean(axis=0)
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    out = []
    for text in texts:
        if not any(c.isalpha() for c in (text or "").lower()):
            out.append(("und", 0.0))
            continue
        v = bundle(text)[0]
        cosine = known @ v / np.linalg.norm(v)
        best = max(range(len(langs)), key=lambda k: (cosine[k], -k))
        out.append((langs[best], min(1.0, max(0.0, float(cosine[best])))))
    return out


def toxic(text, weights, bias):
    """The chance that a text is toxic: one less the product of its sentences' chances not to be."""
    import math
    import re

    calm = 1.0
    for sentence in re.split(r"[.!?\n]+", text or ""):
        if not sentence:
            continue
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", sentence)}
        seen = words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}
        calm *= 1 - 1 / (1 + math.exp(-(bias + sum(weights.get(w, 0.0) for w in seen))))
    return 1 - calm


def language_model(rows):
    """(n_tokens, n_known, base, score) of each (fold, text): deleted interpolation with counts in plain dictionaries."""
    import math

    import numpy as np

    from waymark.llm import lm

    docs = [(fold, [*(text or "").encode().lower().split(), lm.END]) for fold, text in rows]
    start = b"start"
    kept, whole, words = Counter(), Counter(), Counter()
    for fold, tokens in docs:
        if fold == lm.HELD_OUT:
            continue
        padded = [start, start, *tokens]
        grams = Counter(tuple(padded[k - n : k + 1]) for k in range(2, len(padded)) for n in (1, 2)) + Counter((t,) for t in tokens)
        # a triple that reaches back before the start is a pair at the start
        whole.update(grams)
        words.update(tokens)
        if fold != lm.DELETED:
            kept.update(grams)
    total, known = sum(words.values()), len(words)
    classes = {w: k for k, w in enumerate(dict.fromkeys([lm.END, *sorted(words, key=lambda w: (-words[w], w))[: lm.CLASSES - 1]]))}
    k = len(classes)
    pairs = np.zeros((2, k + 2, k + 1))
    for fold, tokens in docs:
        if fold != lm.HELD_OUT:
            kind = [classes.get(t, k) for t in tokens]
            for a, b in zip([k + 1, *kind], kind):
                pairs[int(fold == lm.DELETED), a, b] += 1
    chances = lm.class_chances(*pairs)
    rare = [w for w in words if w not in classes]
    sizes = sum(kept[w,] for w in rare), sum(words[w] for w in rare)
    shares = Counter()
    for w in rare:
        shares[kept[w,]] += words[w] - kept[w,]
    weight = lm.word_weight([(n, d) for n, d in shares.items() if d], sizes[0], known)

    def estimates(tokens, counts, all_):
        for i, t in enumerate(tokens):
            before = tokens[i - 1] if i else start
            two = tokens[i - 2] if i > 1 else start
            one_n = counts[before,] if i else counts[lm.END,]
            two_n = counts[two, before] if i else 0
            triple = counts[two, before, t] / two_n if two_n else 0.0
            pair = counts[before, t] / max(one_n, 1)
            kind = classes.get(t, k)
            word = chances[all_][classes.get(before, k) if i else k + 1, kind]
            if kind == k:
                word *= weight / max(sizes[all_], 1) * counts[t,] + (1 - weight) / (known + 1)
            yield triple, pair, word, int(lm.context_bucket(np.array([one_n]), np.array([two_n]))[0])

    cells = Counter()
    for fold, tokens in docs:
        if fold == lm.DELETED:
            for e in estimates(tokens, kept, 0):
                cells[e[3], *(round(lm.GRADES * math.log10(x)) if x > 0 else -999 for x in e[:3])] += 1
    weights = lm.order_weights(sorted((c[0], *(10.0 ** (x / lm.GRADES) if x > -999 else 0.0 for x in c[1:]), n) for c, n in cells.items()))
    out = []
    for _, tokens in docs:
        score = sum(math.log10(sum(w * x for w, x in zip(weights[e[3]], e))) for e in estimates(tokens, whole, 1))
        base = sum(math.log10((words[t] + 1) / (total + known + 1)) for t in tokens)
        out.append((len(tokens), sum(words[t] > 0 for t in tokens), base, score))
    return out


def fim(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by a list of lines."""
    import re

    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return len(lines), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(lines), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def jump(key, shards):
    """Jump consistent hashing of one 64-bit key, as published."""
    at, next_ = -1, 0
    while next_ < shards:
        at = next_
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        next_ = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def phrases(rows, least, kept=2000):
    """Rows of op13 from (text, lang) by counting every phrase of every piece."""
    import re

    f, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] = f.get((lang, tuple(w[i : i + m])), 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), c in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * c >= 80 * cand[lang, w[i : i + m]]:
                    covered.add((lang, w[i : i + m]))
    out = []
    for (lang, w), a in cand.items():
        if (lang, w) not in covered:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], total[lang], score))
    ranked, seen = [], Counter()
    for r in sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        seen[r[0]] += 1
        if seen[r[0]] <= kept:
            ranked.append((r[0], seen[r[0]], *r[1:]))
    return ranked
