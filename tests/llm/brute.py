"""Plain Python versions of the operators' results, to hold the Spark jobs against."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def words(text):
    return WORD.findall(text or "")


def secret_base(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort()
    kinds = Counter(k for _, _, k, _ in found)
    line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
    return kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(line.encode()).hexdigest(), line


def rule_base(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), lines, len(covered)


def rule_verdict(text, ngram_limits, again_limits, line_limit):
    """False if the base rule or a limit on the characters in repeats rejects the text."""
    w = words(text)
    n_words, chars, _, _, repeated = rule_base(text)
    if n_words < 10 or 100 * repeated > 20 * n_words:
        return False
    seen, in_lines = set(), 0
    for line in text.split("\n"):
        if words(line):
            in_lines += len("".join(words(line))) if line in seen else 0
            seen.add(line)
    kept = in_lines <= line_limit * chars
    for n in ngram_limits:
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        times, met, every, again = Counter(grams), set(), set(), set()
        for i, g in enumerate(grams):
            if times[g] > 1:
                every |= set(range(i, i + n))
                again |= set(range(i, i + n)) if g in met else set()
            met.add(g)
        kept &= sum(len(w[j]) for j in every) <= ngram_limits[n] * chars
        kept &= sum(len(w[j]) for j in again) <= again_limits[n] * chars
    return kept


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, near):
    """rows: (id, value). The smallest id reachable through near values, by id."""
    values = sorted({v for _, v in rows})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if near(a, b):
                root[find(b)] = find(a)
    least = {}
    for k, v in rows:
        if k is not None:
            least[find(v)] = min(k, least.get(find(v), k))
    return [(k, v, least.get(find(v))) for k, v in rows]


def repeated(docs, n=13):
    """docs: (id, text). (id, words, removed, sha256 of the kept words)."""
    first = {}
    for k, text in docs:
        w = words(text)
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(k, first.get(g, k))
    out = []
    for k, text in docs:
        w = words(text)
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < k for j in range(i, i + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes: source -> size. source -> target, in rounds."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, list(order), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def unigram_scores(docs, crc):
    """docs: (id, text). id -> (held out, tokens, known, N, base score)."""
    tokens = {k: [*words(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None] for k, text in docs}
    counts = Counter(t for k, ts in tokens.items() if crc(k) % 10 for t in ts)
    total, kinds = sum(counts.values()), len(counts)
    out = {}
    for k, ts in tokens.items():
        score = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in ts)
        out[k] = (crc(k) % 10 == 0, len(ts), sum(counts[t] > 0 for t in ts), total, score)
    return out


def leaks(docs, items, n=13):
    """(doc, item) that share n tokens in a row (or the whole of a shorter item)."""
    token = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = defaultdict(set)
    for k, text in items:
        w = token(text)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            grams[tuple(w[i : i + n])].add(k)
    sizes = {len(g) for g in grams}
    return {(d, k) for d, text in docs for w in (token(text),) for s in sizes for i in range(len(w) - s + 1) for k in grams.get(tuple(w[i : i + s]), ())}


def near_leaks(docs, items, window=13, similarity=0.8):
    """{(doc, item): (start, equal, compared)}: the first best window of every document and item that agree in enough tokens in place."""
    token = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, text in docs:
        w = token(text)
        for k, item in items:
            own = token(item)
            n = min(window, len(own))
            for shift in range(1 - len(own), len(w)) if n else ():
                for i in range(max(0, -shift), min(len(own), len(w) - shift) - n + 1):
                    equal = sum(a == b for a, b in zip(own[i : i + n], w[shift + i : shift + i + n], strict=True))
                    if equal >= similarity * n - 1e-9:
                        out[d, k] = max(out.get((d, k), (0, 0, 0)), (equal, -(shift + i), n))
    return {p: (-start, equal, n) for p, (equal, start, n) in out.items()}


def random_run(run):
    """(passes the three tests, log likelihood ratio of random to ordinary) of a run without separators."""
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    encodings = [digit, digit + lower[:6], digit + upper[:6], lower, upper, upper + "234567", digit + lower, digit + upper, upper + lower, upper + lower + digit, upper + lower + digit + "+/"]
    alphabet = next(a for a in encodings if set(run) <= set(a))
    x, n, k = [alphabet.index(c) for c in run], len(run), len(alphabet)
    chi = (k / n * sum(c * c for c in Counter(run).values()) - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    high = [v >= k / 2 for v in x]
    n1, turns = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    both = 2 * n1 * (n - n1)
    spread = both * (both - n) / (n * n * (n - 1))
    runs = (turns - both / n - 1) ** 2 / spread if spread > 0 else n
    mean = sum(x) / n
    scale = sum((v - mean) ** 2 for v in x)
    lag = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False))
    serial = n * (lag / scale + 1 / n) ** 2 if scale > 0 else n
    letters = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
    kind = ["l" if c in lower else "u" if c in upper else "d" if c in digit else "s" for c in run]
    log = math.log(0.25)
    for c, q in zip(run, kind, strict=True):
        log += math.log(letters[lower.index(c.lower())] / sum(letters)) if q in "lu" else math.log(0.1 if q == "d" else 0.5)
    log += sum(math.log(0.9) if a == b else math.log(0.1 / 3) for a, b in zip(kind, kind[1:], strict=False))
    return chi * chi + runs + serial <= 16.266, -n * math.log(k) - log


def secret_spans(docs):
    """{row: all spans} of a table of texts, by Benjamini-Hochberg over all runs of a class of length."""
    found, counts = [], Counter()
    for row, text in enumerate(docs):
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
            run = re.sub("[-_=]", "", m[0])
            passes, ratio = random_run(run) if len(run) >= 16 else (False, 0)
            b = max(0, min(199, math.floor(ratio))) if passes else 0
            size = sum(len(m[0]) >= x for x in (24, 32, 48, 64, 128))
            found.append((row, m.start(), m.end(), size, b))
            counts[size, b] += 1
    least = {}
    for size in range(6):
        total = sum(n for (s, _), n in counts.items() if s == size)
        accepted = [b for b in range(1, 200) if (above := sum(n for (s, x), n in counts.items() if s == size and x >= b)) and math.exp(-b) <= 0.01 * above / total]
        least[size] = min(accepted, default=200)
    out = {}
    for row, text in enumerate(docs):
        base = [(int(a), k, int(b)) for k, a, b in (s.split(":") for s in secret_base(text)[4].split(",") if s)]
        more = [(a, "random", b) for r, a, b, size, bin_ in found if r == row and bin_ >= least[size] and not any(x < b and a < y for x, _, y in base)]
        order = ("assign", "access", "hex", "random")
        out[row] = ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(base + more, key=lambda s: (s[0], order.index(s[1]))))
    return out


def importance_weights(docs, target, buckets=1 << 20, doubt=64.0):
    """Log weight of each text: the shrunk log ratios of its hashed words and pairs of words. ``docs``: (id, text); ``target``: ids."""

    def features(text):
        own = [xxhash.xxh64_intdigest(re.sub("[A-Z]", lambda m: m[0].lower(), w).encode()) for w in words(text)]
        pairs = [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(own, own[1:], strict=False)]
        return [h % buckets for h in own + [p ^ p >> 32 for p in pairs]]

    raw, good = Counter(), Counter()
    for k, text in docs:
        raw.update(features(text))
        if k in target:
            good.update(features(text))
    share = sum(good.values()) / sum(raw.values())
    ratio = {}
    for b, n in raw.items():
        e = n * share
        far = ((good[b] - e) / math.sqrt(e + 1)) ** 4
        ratio[b] = math.log((good[b] + 1) / (e + 1)) * far / (far + doubt)
    return [sum(ratio[b] for b in features(text)) for _, text in docs]


def exact_duplicates(rows):
    """(doc_id, keep_id, group_size, text_sha256) of (doc_id, text) rows, and the kept rows as (doc_id, text)."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text))
    out, kept = [], []
    for plain, members in groups.items():
        first = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        kept.append((first[0], len(first[1] or "")))
        out += [(d, first[0], len(members), hashlib.sha256(plain.encode()).hexdigest()) for d, _ in members]
    return out, kept


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _merkle_leaf(row):
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _levels(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_sha("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def _sides(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def merkle_audit(rows):
    """The manifest's rows of (doc_id, source, lang, n_chars, text) rows."""
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[1]].append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _merkle_leaf(r)))
        trees[s] = _levels([_merkle_leaf(r) for r in by_source[s]])
    top = _levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, row in enumerate(by_source[s]):
            sides = _sides(trees[s], i) + _sides(top, k)
            tampered = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            folded = _merkle_leaf((*row[:4], row[4].replace("\n", "")) if tampered else row)
            for before, after in sides:
                folded = _sha("".join(before) + folded + "".join(after))
            root = top[-1][0]
            out.append((row[0], _merkle_leaf(row), trees[s][-1][0], root, _sha("".join(x for a, b in sides for x in a + b)), folded, folded == root))
    return out


def prefix_trie(rows):
    """The trie's rows of (conv_id, turn, role, text) rows whose turns are told apart by their numbers."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [x for _, _, x in sorted(t, key=lambda y: y[:2])] for c, t in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    members, children = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    parent = lambda node: members[node[:-1]][0] if node else None
    ends = lambda node: _sha(",".join(str(c) for c in members[node] if len(whole[c]) == len(node)))
    return [(members[n][0], len(n), parent(n), len(members[n]), len(children[n]), leaves[n], saved[n], ends(n)) for n in members]
