"""Plain versions of the operators, for small tables."""
import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACE.findall(text or "")


def shingles(text):
    w = words((text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def rule_counts(text):
    text = text or ""
    w = words(text)
    three = [tuple(w[j:j + 3]) for j in range(len(w) - 2)]
    times = Counter(three)
    covered = {j + k for j, t in enumerate(three) if times[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def components(rows):
    """{doc_id: smallest doc_id reachable} of rows (doc_id, text), ids not null; an id with several texts is one vertex."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def removed(texts, length=200):
    """(bytes removed, spans, bytes kept) of each text."""
    data, times = [(t or "").encode() for t in texts], Counter()
    for b in data:
        times.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append((sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")),
                "card": 16 <= len(digits) <= 19 and _luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left >= most * sizes[s] * total}
        if not over:
            return out | {s: weight[s] * left / total for s in open_}
        worst = min(over, key=lambda s: most * sizes[s] / weight[s])
        out[worst] = float(most * sizes[worst])
        left -= most * sizes[worst]
        open_.remove(worst)
    return out


def pieces_by_document(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]))
    return out


def escaped(text):
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def chats(rows):
    """{conv_id: (turns, formatted, text of assistants)} of rows (conv_id, turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append(((turn is not None, turn or 0), (role is not None, role or ""), escaped(text or ""), role or "", text or ""))
    result = {}
    for conv, own in out.items():
        own.sort()
        line = "".join("<|im_start|>" + escaped(r).replace("\n", "\\n") + "\n" + t + "<|im_end|>\n" for _, _, t, r, _ in own)
        result[conv] = [(r, t) for *_, r, t in own], line, "".join(t for *_, r, t in own if r == "assistant")
    return result


def fill_in_middle(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)], len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def vector_codes(rows, parts=4, entries=256, rounds=4):
    """(rows of (id, label, code, error), codebooks) of rows (id, vector, label), by all distances in every round."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    per = width // parts
    seeds = {}
    for i, v, _ in sorted(kept, key=lambda r: ((r[0] is None, r[0] or 0), r[1])):
        seeds.setdefault(i, v)
    books = [[v[p * per:(p + 1) * per] for v in list(seeds.values())[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for n in range(rounds + 1):
        got = [[nearest(v[p * per:(p + 1) * per], books[p]) for p in range(parts)] for _, v, _ in kept]
        if n == rounds:
            break
        for p in range(parts):
            own = defaultdict(list)
            for (_, v, _), near in zip(kept, got):
                own[near[p][1]].append(v[p * per:(p + 1) * per])
            for j, xs in own.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs)]
    return [(i, label, "".join(f"{j:02x}" for _, j in near), sum(d for d, _ in near)) for (i, _, label), near in zip(kept, got)], books
