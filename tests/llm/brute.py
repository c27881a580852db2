"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import string
import zlib
from collections import Counter

import numpy as np
import xxhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


class Sets:
    def __init__(self, names):
        self.parent = {n: n for n in names}

    def find(self, a):
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def link(self, a, b):
        self.parent[self.find(a)] = self.find(b)

    def groups(self):
        out = {}
        for n in self.parent:
            out.setdefault(self.find(n), []).append(n)
        return list(out.values())


ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)"""
)


def secrets(text):
    """Base spans as (start, kind number, end)."""
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m["value"]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def rule_spans(text, rules):
    """All rules by regular expressions, as (start, rule number, end)."""
    out = []
    for k, rule in enumerate(rules):
        head = f"(?i:{rule.head})" if rule.either else f"(?:{rule.head})"
        for m in re.finditer(f"{head}(?P<body_>{rule.body})", text or ""):
            if len(m["body_"]) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def fingerprint(text):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(rows):
    """Lists of row numbers that are linked."""
    prints = [fingerprint(t) for _, t in rows]
    sets = Sets(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                sets.link(i, j)
    return prints, sets.groups()


def contamination(docs, items):
    """Per document: n_words, n_hit, sorted item texts."""
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = []
    for _, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                names = windows.get(tuple(w[i : i + n]))
                if names:
                    found |= names
                    hit.update(range(i, i + n))
        out.append((len(w), len(hit), sorted(str(f) for f in found if f is not None)))
    return out


def repeats(rows, length=100):
    """Per (order key, bytes): n_bytes, n_removed, n_spans, digest."""
    docs = sorted(
        {((1 << 63) if i is None else i, (t or "").encode()) for i, t in rows},
        key=lambda d: (d[0], xxhash.xxh64_intdigest(d[1])),
    )
    seen, out = set(), {}
    for name, text in docs:
        gone = np.zeros(len(text), dtype=bool)
        for a in range(len(text) - length + 1):
            window = text[a : a + length]
            if window in seen:
                gone[a : a + length] = True
            seen.add(window)
        begins = gone & ~np.concatenate([[False], gone[:-1]]) if len(text) else gone
        kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
        out[name, text] = (len(text), int(gone.sum()), int(begins.sum()), hashlib.sha256(kept).hexdigest())
    return out


def held_out(doc_id, divisor):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % divisor == 2


def ppm(samples, text, order, least):
    """Bits of a text under each language: PPM, method C with exclusion, one byte after the other."""
    trees = {}
    for name, texts in samples.items():
        tree = trees[name] = {}
        for t in texts:
            for i, byte in enumerate(t):
                for k in range(min(order, i) + 1):
                    tree.setdefault(t[i - k : i], Counter())[byte] += 1
    known = {c for tree in trees.values() for c, n in tree.items() if sum(n.values()) >= least}
    letters = {b for texts in samples.values() for t in texts for b in t}

    def probability(tree, context, byte):
        left, gone = 1.0, set()
        for i in range(len(context) + 1):
            after = {b: n for b, n in tree.get(context[i:], {}).items() if b not in gone}
            if not after:
                continue
            if len(after) + len(gone) == 256:
                return left * after[byte] / sum(after.values())
            below = sum(after.values()) + len(after)
            if byte in after:
                return left * after[byte] / below
            left *= len(after) / below
            gone |= set(after)
        return left / (256 - len(gone))

    bits = dict.fromkeys(sorted(samples), 0.0)
    history = b""
    for byte in text:
        context = history[-order:]
        while context and context not in known:
            context = context[1:]
        for name in bits:
            bits[name] -= math.log2(probability(trees[name], context, byte))
        history = history + bytes([byte]) if byte in letters else b""
    return list(bits.values())


def katz(rows, unigrams_of, discounts_of, cut=5):
    """Per row: held out, tokens, known, N, base score, score."""
    tokens = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    held = [held_out(i, 7) for i, _ in rows]
    uni, bi, context = Counter(), Counter(), Counter()
    for ws, out in zip(tokens, held):
        previous = None
        for w in () if out else ws:
            uni[w] += 1
            bi[previous, w] += 1
            context[previous] += 1
            previous = w
    total, distinct = sum(uni.values()), len(uni)
    frequency = lambda c: [sum(1 for n in c.values() if n == r) for r in range(1, cut + 2)]
    model = unigrams_of(frequency(uni), total, distinct)
    p = lambda w: float(model.shares(np.array([uni[w]]))[0])
    discount = discounts_of(frequency(bi))
    kept = lambda r: float(discount[r]) if r <= cut else 1.0
    after = {}
    for (v, w), n in bi.items():
        after.setdefault(v, {})[w] = n
    terms = {}

    def share(v, w):
        if not context[v]:
            return p(w)
        if v not in terms:
            lost = sum(n * (1 - kept(n)) for n in after[v].values())
            below = context[v] if lost > 0 else context[v] + 1
            free = (lost if lost > 0 else 1) / below
            terms[v] = below, free / (1 - sum(p(x) for x in after[v]))
        below, factor = terms[v]
        n = after[v].get(w, 0)
        return kept(n) * n / below if n else factor * p(w)

    out = []
    for ws, is_held in zip(tokens, held):
        base = sum(math.log10((uni[w] + 1) / (total + distinct + 1)) for w in ws)
        score = sum(math.log10(share(v, w)) for v, w in zip([None, *ws], ws))
        out.append((is_held, len(ws), sum(uni[w] > 0 for w in ws), total, base, score))
    busiest = max(after, key=lambda v: context[v])
    whole = sum(share(busiest, w) for w in uni) + terms[busiest][1] * model.unknown if busiest in terms else 1.0
    return out, whole


def best_fit(lengths, capacity):
    """Remaining capacities of best-fit decreasing, one piece at a time."""
    bins = []
    for length in sorted(lengths, reverse=True):
        open_bins = [i for i, b in enumerate(bins) if b >= length]
        if open_bins:
            bins[min(open_bins, key=lambda i: bins[i])] -= length
        else:
            bins.append(capacity - length)
    return sorted(bins)


def near_vectors(rows, threshold=0.93):
    """Per row number: links, component, and the number of linked pairs."""
    usable = {}
    for i, (_, v, label) in enumerate(rows):
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        usable.setdefault((label, len(v)), []).append(i)
    links, sets, pairs = [0] * len(rows), Sets(range(len(rows))), 0
    for members in usable.values():
        x = np.array([rows[i][1] for i in members], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        for a, b in zip(*np.nonzero(near)):
            if a != b:
                links[members[a]] += 1
                sets.link(members[a], members[b])
                pairs += a < b
    component = {}
    for group in sets.groups():
        least = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        for i in group:
            component[i] = least
    return [(links[i], component[i]) for i in range(len(rows))], int(pairs)


WHITE = "\t\n\x0b\x0c\r "
SHAPE = re.compile("(s?(ua)+)?")


def damaged(rows):
    """Rows (conv_id, turn, role, text) after damage, per conversation and in order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        tail = text.rstrip(WHITE)
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def conversation(rows, repair):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of one damaged conversation."""
    found = faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, kept = repair(rows, found)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    counts = [found.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def repair_all_ways(rows, found, most=2):
    """Every way to edit, with up to ``most`` insertions at each place."""
    import itertools

    fillers = [list(f) for n in range(most + 1) for f in itertools.product(("user", "assistant"), repeat=n)]
    choices = [fillers]
    for (_, role, text), fault in zip(rows, found):
        extra = fault == "truncated"
        edits = [("D", 3, [])]
        if fault not in ("blank", "duplicate"):
            edits += [("K", extra, [(role, text)])] + [("R", 2 + extra, [(r, text)]) for r in ("user", "assistant")]
        choices += [edits, fillers]
    best = None
    for way in itertools.product(*choices):
        cost, audit, kept = 0, "", []
        for k, step in enumerate(way):
            if k % 2:
                cost, audit, kept = cost + step[1], audit + step[0], kept + step[2]
            else:
                cost, audit, kept = cost + 2 * len(step), audit + "I" * len(step), kept + [(r, "") for r in step]
        if SHAPE.fullmatch("".join(r[:1] or "-" for r, _ in kept)) and (best is None or (cost, audit) < best[:2]):
            best = (int(cost), audit, kept)
    return best


def repair_by_whole_strings(rows, found):
    """Row by row with whole edits per state, insertions at every place."""
    step = {("", "s"): "s", **{(a, "u"): "u" for a in ("", "s", "a")}, ("u", "a"): "a"}

    def offer(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def fill(states):
        for _ in range(3):
            for state, (cost, audit, kept) in list(states.items()):
                for role in ("user", "assistant"):
                    if to := step.get((state, role[0])):
                        offer(states, to, (cost + 2, audit + "I", (kept, (role, ""))))
        return states

    states = fill({"": (0, "", None)})
    for (_, role, text), fault in zip(rows, found):
        extra, new = int(fault == "truncated"), {}
        for state, (cost, audit, kept) in states.items():
            offer(new, state, (cost + 3, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            for name, letter, price in ((role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)):
                if to := step.get((state, name[:1])):
                    offer(new, to, (cost + price + extra, audit + letter, (kept, (name, text))))
        states = fill(new)
    cost, audit, kept = min((states[s] for s in ("", "a") if s in states), key=lambda v: v[:2])
    out = []
    while kept:
        kept, row = kept
        out.append(row)
    return cost, audit, out[::-1]


def aligned(texts, first, second):
    """Per text: n_a, n_b, groups as text, links as pairs of ids, by the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a_side = Tokenizer.from_file(first)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=second)
    visible = bytes_of_letters(decoders)
    out = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [b"".join(visible[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [
            bytes.fromhex(p[3:5]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
            for p in map(b_side.id_to_piece, b)
        ]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append((0, 0, "", []))
            continue
        listed, links, i, j = [], [], 0, 0
        while i < len(a):
            m, n, left, right = i + 1, j + 1, len(a_bytes[i]), len(b_bytes[j])
            while left != right:
                if left < right:
                    left, m = left + len(a_bytes[m]), m + 1
                else:
                    right, n = right + len(b_bytes[n]), n + 1
            listed.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            links.append((a[m - 1], b[n - 1]))
            i, j = m, n
        out.append((len(a), len(b), ";".join(listed), links))
    return out


def bytes_of_letters(decoders):
    """Which byte each letter of a byte-level vocabulary stands for, asked of the library's own alphabet."""
    from tokenizers import pre_tokenizers

    out, split = {}, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    for point in range(0x800):
        letters, raw = split.pre_tokenize_str(chr(point))[0][0], chr(point).encode()
        out.update({c: bytes([b]) for c, b in zip(letters, raw)})
    for point in (*range(0x800, 0xD800, 7), *range(0xE000, 0x10000, 7), *range(0x10000, 0x110000, 997)):
        letters, raw = split.pre_tokenize_str(chr(point))[0][0], chr(point).encode()
        out.update({c: bytes([b]) for c, b in zip(letters, raw)})
    return out


def judged_pages(rows, rules, damping, left_out, margin):
    """Per page: id, host, path, rule, verdict; scores by a plain power iteration over sets of links."""

    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        return host.translate(LOWER), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]

    def ruled(host, path):
        fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(fit, key=lambda r: len(r[1] + r[2]), default=None)

    pages = [(name, *split(url), html or "") for name, url, html in rows]
    edges, count, said = Counter(), Counter(), Counter()
    for _, host, path, html in pages:
        if not host:
            continue
        count[host] += 1
        if rule := ruled(host, path):
            said[host, rule[0]] += 1
        targets = {
            m.translate(LOWER) for m in re.findall(r"""href=["'](?:[A-Za-z]+:)?//([^/?#"'<>\s]+)""", html)
        }
        edges.update((host, t) for t in targets if t != host)
    scores = []
    for kind, ahead in (("allow", True), ("block", False)):
        moves = [((a, b) if ahead else (b, a), n) for (a, b), n in edges.items()]
        out = Counter()
        for (a, _), n in moves:
            out[a] += n
        start = {h: 1 - damping for h in count if 2 * said[h, kind] > count[h]}
        mass = dict(start)
        for _ in range(math.ceil(math.log(left_out) / math.log(damping)) if edges else 0):
            new = dict(start)
            for (a, b), n in moves:
                new[b] = new.get(b, 0) + damping * mass.get(a, 0) * n / out[a]
            mass = new
        scores.append(mass)
    out = []
    for name, host, path, _ in pages:
        rule = ruled(host, path) if host else None
        worse = round(scores[1].get(host, 0) - scores[0].get(host, 0), 9) > margin
        verdict = rule[0] if rule else "block" if worse else "allow"
        out.append((name, host, path, rule and rule[1] + rule[2], verdict))
    return out


def suppressed(raw):
    """License detections that lie in no accepted one, each against all accepted ones."""
    accepted = []
    for _, size, first, label, score in sorted(raw):
        end = first - size
        if not any(a <= first and end <= b for a, b, _, _ in accepted):
            accepted.append((first, end, label, score))
    return sorted(accepted)
