"""Plain Python versions of what the operators give, for small tables."""

import math
import collections
import hashlib
import math
import re
import string
import zlib

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text, pattern=SPACE_WORDS, lower=True):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text, ALNUM_WORDS)
        k = min(13, len(w))
        for i in range(len(w) - k + 1) if k else []:
            windows[tuple(w[i : i + k])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text, ALNUM_WORDS), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (items_ := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= items_
        ids = sorted(str(i) for i in found - {None})
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def quality(text):
    w = words(text, lower=False)
    lines = [x for x in (text or "").split("\n") if SPACE_WORDS.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


SECRETS = (
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PERSONAL = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m[0])) <= 15),
)


def spans(text, rules):
    found = sorted((m.start(), k, kind, m.end()) for k, (kind, pattern, ok) in enumerate(rules) for m in pattern.finditer(text or "") if ok(m))
    counts = [sum(f[1] == k for f in found) for k in range(len(rules))]
    return counts, ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(docs):
    """Smallest doc_id reachable, by comparing every two documents."""
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in parent}


def unigram_scores(docs):
    counts, tokens = collections.Counter(), {}
    for doc, text in docs:
        tokens[doc] = [*words(text), "\n"]
        if doc is not None and zlib.crc32(str(doc).encode()) % 10:
            counts.update(tokens[doc])
    n, v = sum(counts.values()), len(counts)
    return n, {doc: (len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for doc, w in tokens.items()}


def trigram_scores(pairs):
    """log10 of each text (by id) under the interpolated trigrams of the language model, from dictionaries, for corpora in which every trained word is of the vocabulary."""
    from plumeline.llm import ngram_lm as lm

    sequences = [(i, ["<s>", "<s>", *words(t), "</s>"]) for i, t in pairs if i is not None]
    learned = [s for i, s in sequences if zlib.crc32(str(i).encode()) % 10]
    one, two, three = (collections.Counter(tuple(s[k : k + n]) for s in learned for k in range(2 if n == 1 else 1 if n == 2 else 0, len(s) - n + 1)) for n in (1, 2, 3))
    total, ids = sum(one.values()), len(one) + 2
    p1 = lambda w: (one[w,] + lm.ALPHA) / (total + lm.ALPHA * ids)
    seen = lambda b: len(learned) if b == "<s>" else one[b,]
    p2 = {k: (n - lm.DISCOUNT) / seen(k[0]) for k, n in two.items()}
    after = collections.defaultdict(list)
    for b, c in p2:
        after[b].append(c)
    back = {b: max(1 - sum(p2[b, c] for c in cs), 1e-6) / max(1 - sum(map(p1, cs)), 1e-6) for b, cs in after.items()}
    low = lambda b, c: p2.get((b, c)) or back.get(b, 1.0) * p1(c)
    contexts, left = collections.Counter(), collections.Counter()
    for (a, b, _), n in three.items():
        contexts[a, b] += n
    hot = {k for k, n in two.items() if n >= max(1, lm.HOT_SHARE * total)} | {("<s>", "<s>")}
    kept = {k: n for k, n in three.items() if n >= lm.LEAST or k[:2] in hot}
    for k, n in three.items():
        if k not in kept:
            left[k[:2]] += n

    def p3(a, b, c):
        t = contexts[a, b] + lm.MU
        return kept.get((a, b, c), 0) / t + (left[a, b] + lm.MU) / t * low(b, c)

    return {i: sum(math.log10(p3(*s[k : k + 3])) for k in range(len(s) - 2)) for i, s in sequences}, hot


def quality_verdicts(rows):
    """(char_distance, word_distance, kept) of rows (text, lang, base_failed, n_words, n_symbols, word_chars), from dictionaries."""
    from plumeline.llm import quality as q

    def classes(text):
        out = [0] * 4
        for c in text or "":
            kind = 0 if "a" <= c <= "z" or c > "\x7f" else 1 if "A" <= c <= "Z" else None if c in string.digits or c in " \t\n\v\f\r" else 3 if c in "#*$%&|<>" else 2
            if kind is not None:
                out[kind] += 1
        return out

    def distance(a, b):
        a, b = ({k: n / max(sum(x.values()), 1) for k, n in x.items()} for x in (a, b))
        h = lambda p: -sum(v * math.log2(v) for v in p.values() if v)
        half = {k: (a.get(k, 0) + b.get(k, 0)) / 2 for k in {*a, *b}}
        return math.sqrt(max(0.0, h(half) - (h(a) + h(b)) / 2))

    kinds, counted = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, failed, n_words, n_symbols, word_chars in rows:
        c = classes(text)
        if lang is not None and text is not None and not failed and n_symbols <= q.REFERENCE_SYMBOLS * n_words and c[1] <= q.REFERENCE_CAPITALS * word_chars:
            kinds[lang].update(dict(enumerate(c)))
            counted[lang].update(words(text, ALNUM_WORDS))
    langs = sorted(k for k in counted if sum(counted[k].values()) >= q.LANGUAGE_WORDS)
    common = {w for k in langs for w, n in counted[k].items() if n >= q.COMMON * sum(counted[k].values())}
    put = lambda ws: collections.Counter(w if w in common else None for w in ws)
    references = [(kinds[k], put(counted[k].elements())) for k in langs]
    out = []
    for text, lang, failed, *_ in rows:
        c, w = dict(enumerate(classes(text))), words(text, ALNUM_WORDS)
        char, word = min(((distance(c, a), distance(put(w), b)) for a, b in references), key=sum, default=(0.0, 0.0))
        far = (char > q.FAR_CHARS or char > q.ODD_CHARS and word > q.ODD_WORDS and len(w) >= q.MIN_COUNTED) and sum(c.values()) >= q.MIN_CHARS and (lang is None or lang in langs)
        out.append((char, word, not failed and not far))
    return out
