"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact(rows):
    """rows: (id, text) -> sorted (id, keep_id, size, kept, sha)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            out.append((i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
            first = False
    return out


def fingerprint(text, shingle=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))] if words else []
    ones = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def groups(prints):
    """Index of each print's component, by all pairs."""
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def near(rows, shingle=3):
    """rows: (id, text) -> (id, hex fingerprint, component id)."""
    prints = [fingerprint(t, shingle) for _, t in rows]
    comp, best = groups(prints), {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            best[c] = min(best.get(c, i), i)
    return [(i, f"{p:016x}", best.get(c)) for (i, _), p, c in zip(rows, prints, comp, strict=True)]


def alike(texts, shingle=5):
    """For each text the least index of its component, over pairs whose shingle sets have a Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        words = WORD.findall((t or "").lower())
        sets.append({" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))} if words else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(sets))]


def kd_tree_fits(items, shard, leaves, first=0, whole=None):
    """items: (id, size, dims). Whether ``shard`` splits them at weighted medians along the widest dimension, node by node."""
    if leaves == 1 or not items:
        return {shard[i] for i, _, _ in items} <= {first}
    spread = lambda some, d: max(x[2][d] for x in some) - min(x[2][d] for x in some)
    whole = whole or [spread(items, d) or 1 for d in range(len(items[0][2]))]
    wide = max(range(len(whole)), key=lambda d: (spread(items, d) / whole[d], -d))
    half = first + leaves // 2
    left, right = [x for x in items if shard[x[0]] < half], [x for x in items if shard[x[0]] >= half]
    if left and right and max(x[2][wide] for x in left) > min(x[2][wide] for x in right) + 1e-6 * spread(items, wide):
        return False
    total = sum(x[1] for x in items)
    if abs(sum(x[1] for x in left) - total * (leaves // 2) / leaves) > max(x[1] for x in items) + total / 1000:
        return False
    return kd_tree_fits(left, shard, leaves // 2, first, whole) and kd_tree_fits(right, shard, leaves - leaves // 2, half, whole)


def counters(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def distance(p, q):
    def side(a, b):
        return sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)

    return math.sqrt(max(0.0, (side(p, q) + side(q, p)) / 2))


def verdicts(rows, limits, common, classes):
    """rows: (id, text, lang) -> {index: kept}, by the method of the quality operator in plain Python."""
    import regex

    width = max(len(v.split()) for v in common.values()) + 1
    docs = []
    for _, text, lang in rows:
        words = WORD.findall(text or "")
        n, chars, _, _, rep = counters(text)
        joined = "".join(words)
        per = [len(regex.findall(c, joined)) for c in classes]
        per.append(chars - sum(per))
        bins = [0] * width
        listed = common.get(lang, "").split()
        for w in words if lang in common else []:
            bare = w.lower().strip(".,;:!?'\"()")
            bins[listed.index(bare) if bare in listed else -1] += 1
        share = lambda h: [x / max(sum(h), 1) for x in h]
        docs.append((lang, n, chars, n < limits.min_words or 100 * rep > limits.max_repeat_percent * n, share(per), share(bins)))

    def reference(kept):
        by = defaultdict(list)
        for i, d in enumerate(docs):
            if kept[i] and not d[3] and d[1] >= limits.guard_words:
                by[d[0]].append(d)
        mean = lambda g, k: [sum(x) / len(g) for x in zip(*[d[k] for d in g], strict=True)]
        return {lang: (len(g), mean(g, 4), mean(g, 5)) for lang, g in by.items()}

    def judged(ref):
        out = []
        for lang, n, chars, failed, per, bins in docs:
            far = False
            if lang in ref and n >= limits.guard_words and ref[lang][0] >= limits.guard_docs:
                noise = lambda f, h, k: f * math.sqrt(sum(x > 0.001 for x in h) / (8 * math.log(2) * k))
                far = distance(per, ref[lang][1]) > limits.char_distance + noise(limits.char_noise, ref[lang][1], chars)
                if lang in common:
                    far |= distance(bins, ref[lang][2]) > limits.word_distance + noise(limits.word_noise, ref[lang][2], n)
            out.append(not failed and not far)
        return out

    kept = [True] * len(docs)
    ref = reference(kept)
    for _ in range(limits.trims):
        ref = reference(judged(ref))
    return judged(ref)


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """sizes: {source: words} -> {source: target}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        open_ = sum(w for s, w in weight.items() if s not in capped)
        level = left / open_ if open_ else 0
        more = {s for s in order if s not in capped and weight[s] * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= more


def style_trees(pages):
    """pages: (host, html) -> {host: Low}, by the definitions of importance, page by page and branch by branch."""
    from tidemark.llm import html_text as h

    out = {}
    for host in {x for x, _ in pages}:
        distinct = {}
        for x, page in pages:
            if x == host:
                blocks, styles = h.parse(page)
                distinct.setdefault("\n".join(b.text for b in blocks if b.kind in (h.MAIN, h.OPEN)), []).append((blocks, styles))
        has, style, texts, above = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), {}
        for i, copies in enumerate(distinct.values()):
            for blocks, styles in copies:
                for b in blocks:
                    has[b.node].add(i)
                    texts[b.node][b.text].add(i)
                    above[b.node] = b.branches
                for node, branches, x in styles:
                    has[node].add(i)
                    style[node][x].add(i)
                    above[node] = branches
        weight, sums = defaultdict(lambda: [0, 0.0, 0, 0.0]), defaultdict(int)
        for node, where in has.items():
            m = len(where)
            if m < 2:
                continue
            ks, kt = [len(x) for x in style[node].values()], [len(x) for x in texts[node].values()]
            entropy = -sum(k / sum(ks) * math.log(k / sum(ks), m) for k in ks)
            content = sum(k * (1 - math.log(k, m)) for k in kt)
            branches = [b""] + [above[node][i : i + 8] for i in range(0, len(above[node]), 8)]
            for b in branches:
                w = weight[b]
                w[0], w[1], w[2], w[3], sums[b] = w[0] + sum(ks), w[1] + sum(ks) * max(entropy, 0), w[2] + sum(kt), w[3] + max(content, 0), max(sums[b], m)
        importance = {b: max(w[3] / w[2], w[1] / w[0] if w[0] else 0) for b, w in weight.items() if w[2]}
        if b"" not in importance:
            continue
        root = importance.pop(b"")
        blocks = {(h.block_name(h.place(host, node), t), len(has[node])): 1 - math.log(len(x), len(has[node])) for node in texts if len(has[node]) > 1 for t, x in texts[node].items() if len(x) > 1}
        pick = lambda values, pages, low: frozenset(b for b, i, m in values if m >= pages and i < low * root)
        some, named = [(b, i, sums[b]) for b, i in importance.items()], [(b, i, m) for (b, m), i in blocks.items()]
        high = frozenset(b for b, i, m in some if m >= h.ARTICLE_PAGES and i >= h.HIGH * root)
        out[host] = h.Low(pick(some, h.PAGES, h.LOW), pick(named, h.PAGES, h.LOW), pick(some, h.ARTICLE_PAGES, h.ARTICLE_LOW), pick(named, h.ARTICLE_PAGES, h.ARTICLE_LOW), high)
    return out
