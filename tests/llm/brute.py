"""Plain versions of the operators' contracts, row by row, to hold results against."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def crc(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def lower(text):
    return text.translate(UPPER)


def union(links, nodes):
    """The least node that each reaches."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def warc(pages):
    """{page_id: (bytes, digest, kind, refers_to)} of (page_id, html) rows with distinct ids."""
    most = defaultdict(lambda: -1)
    raw = {i: (h or "").encode() for i, h in pages}
    for i, p in raw.items():
        most[p] = max(most[p], i)
    out = {}
    for i, p in raw.items():
        again = len(p) >= 1000 and most[p] != i
        out[i] = (len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", most[p] if again else None)
    return out


def counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    hit = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def phrase_places(text):
    """(n_words, n_base, first, last, labels)"""
    words, at, labels = TERM.findall(lower(text or "")), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), labels


def line_labels(text, templates, stop, threshold):
    """{label: best share of a template's words that one line holds}"""
    out = {}
    for line in (text or "").split("\n"):
        held = set(TERM.findall(lower(line)))
        for label, said in templates.items():
            want = set(TERM.findall(lower(said))) - set(stop)
            share = len(want & held) / len(want)
            if share >= threshold - 1e-12:
                out[label] = max(share, out.get(label, 0))
    return out


def run_labels(text, templates, stop, threshold, slack=2):
    """{label: best share of a template's words that a run of slack times its words holds, whatever the lines}"""
    out, words = {}, TERM.findall(lower(text or ""))
    for label, said in templates.items():
        all_ = TERM.findall(lower(said))
        want = set(all_) - set(stop)
        for i, w in enumerate(words):
            share = len(want & set(words[i : i + slack * len(all_)])) / len(want) if w in want else 0
            if share >= threshold - 1e-12:
                out[label] = max(share, out.get(label, 0))
    return out


def shingles(text):
    words = SPACE.findall(lower(text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_documents(rows, percent=85):
    """{doc_id: (n_shingles, component)}"""
    sets = {i: shingles(t) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = Counter()
    for ids in where.values():
        ids.sort()
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    part = union(links, sets)
    return {i: (len(s), part[i]) for i, s in sets.items()}


def near_vectors(rows, cosine=0.9):
    """(links, {vec_id: usable}) by all pairs, in blocks."""
    fine = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in fine]), np.stack([v / np.linalg.norm(v) for _, v in fine])
    links = set()
    for lo in range(0, len(x), 1000):
        a, b = np.nonzero(x[lo : lo + 1000] @ x.T >= cosine)
        links |= {(min(ids[i + lo], ids[j]), max(ids[i + lo], ids[j])) for i, j in zip(a, b) if ids[i + lo] != ids[j]}
    return links


def packed_pieces(text, tokenizer, size=4096):
    """[(piece, start, length, crc)]"""
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
    return [(k, lo, len(ids[lo : lo + size]), zlib.crc32(ids[lo : lo + size].tobytes())) for k, lo in enumerate(range(0, len(ids), size))]


def check_places(rows, size=4096):
    """Sequences hold no more than `size` and have no gaps; returns (sequences, tokens)."""
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for own in at.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end, "a gap or an overlap"
            end += length
        assert end <= size
    return len(at), sum(r.length for r in rows)


BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def mixed(x):
    x &= MASK
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * times & MASK
    return x ^ (x >> 31)


def span_hash(raw):
    """The hash of a byte string, place by place."""
    return mixed(sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(raw)) + len(raw))


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def toxic_score(text, model, prefixes, bits):
    """A factorization machine, each pair of terms by itself."""
    words = [w.encode() for w in TERM.findall(lower(text or ""))]
    slots = {span_hash(w) >> 64 - bits for w in words}
    slots |= {(span_hash(w[:n]) * (2 * n + 1) & MASK) >> 64 - bits for w in words for n in prefixes if len(w) > n}
    own = sorted({int(model.number[s]) for s in slots} - {-1})
    raw = model.bias + sum(model.weights[i] for i in own)
    raw += sum(float(model.vectors[a] @ model.vectors[b]) for k, a in enumerate(own) for b in own[:k])
    return sigmoid(model.slope * raw + model.shift)


def family_slots(text, bits):
    """{family: slot of each place}"""
    text = text or ""
    h = [span_hash(w.encode()) for w in SPACE.findall(text)]
    code = [int.from_bytes(c.encode(), "little") for c in text]

    def grams(n):
        out = []
        for i in range(len(code) - n + 1):
            x = 0
            for c in code[i : i + n]:
                x = (x * BASE + c) & MASK
            out.append(((x ^ (x >> 29)) * BASE & MASK) >> 64 - bits)
        return out

    pair = [0 if a == b else ((a * 0xD6E8FEB86659FD93 + b * 0x9E3779B97F4A7C15) & MASK) >> 64 - bits for a, b in zip(h, h[1:])]
    return {"chars2": grams(2), "chars4": grams(4), "word": [x >> 64 - bits for x in h], "pair": pair}


def embedded_score(text, model, families, bits):
    """Softmax of the mean vectors of each family's places."""
    hidden = np.zeros(model.vectors.shape[1])
    for k, family in enumerate(families):
        slots = family_slots(text, bits)[family]
        for s in slots:
            hidden += model.vectors[(k << bits) + s] / len(slots)
    z = model.outputs @ hidden + model.biases
    return math.exp(z[1] - z.max()) / sum(math.exp(x - z.max()) for x in z)


def language_scores(rows, texts, orders, least):
    """{text: {lang: mean log frequency}} by words, then shorter and shorter n-grams, from (text, lang) rows."""
    langs = sorted({lang for _, lang in rows})
    words, grams = Counter(), Counter()
    for text, lang in rows:
        own = TERM.findall(lower(text))
        words.update((w, lang) for w in own)
        for w in set(own):
            grams.update((n, w[i : i + n], lang) for n in orders for i in range(len(w) - n + 1))

    def table(counts, keep):
        total = Counter()
        for (*key, _), c in counts.items():
            total[tuple(key)] += c
        known = [k for k, c in total.items() if keep(k, c)]
        sums = {lang: sum(counts[(*k, lang)] for k in known) for lang in langs}
        return {k: [math.log((counts[(*k, lang)] + 0.5) / (sums[lang] + 0.5 * len(known))) for lang in langs] for k in known}

    known = table(words, lambda k, c: c >= least)
    by_order = {n: table(Counter({k: c for k, c in grams.items() if k[0] == n}), lambda k, c: k[0] == 1 or c >= least) for n in orders}
    out = {}
    for text in texts:
        logs = []
        for w in TERM.findall(lower(text)):
            own = known.get((w,))
            for n in orders if own is None else ():
                hit = [by_order[n][n, w[i : i + n]] for i in range(len(w) - n + 1) if (n, w[i : i + n]) in by_order[n]]
                if hit:
                    own = np.mean(hit, axis=0)
                    break
            logs.append(own if own is not None else [0.0] * len(langs))
        out[text] = dict(zip(langs, np.mean(logs, axis=0)))
    return out
