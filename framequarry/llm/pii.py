"""Personal data: base patterns and a skip-chain conditional random field.

The base detector finds e-mail addresses, IP addresses, payment cards and phone numbers.  The
random field labels everything else that holds digits, "@" or a spelled-out "at", in every document:
neighbours form a chain, and distant tokens that are equal or similar share skip potentials; loopy
sum-product messages make a document's labels agree.  A base span is a node with an observed label.
The other nodes are stretches of neighbouring digit groups that write a base span's value anew,
spelled-out addresses, and the remaining tokens.  A node whose belief in a label is at least BELIEF
becomes a span; neighbours of one label become one.

Skip links: writings of one value (the same digits, however they are grouped, after zeros or an exit
code as well; of an address the same letters and digits) are of the first kind.  Partly equal ones are
of the second: endings of a phone number of SKIP_DIGITS digits or more, one token of a base span.

The field is log-linear: weights of a token's features by label, of neighbouring labels, and of agreeing
labels for each kind of link.  They maximise the pseudo-likelihood (less a quadratic penalty) of labels
over all documents.  No labelled spans exist, so the labels are made: tokens that the base detector
leaves are none; in copies of the documents with base spans these are rewritten in ways that the
detector doesn't see (alone and beside the original), labelled as what they are, with other digits beside
them, labelled none.  Only sums by pattern (features, neighbours' and links' labels, own label) reach the
driver; their number is bounded by the number of patterns.

Defined cases: a null text is an empty one without spans; offsets are code points with an exclusive
end; texts of any length are read whole; repeated rows get equal results; an empty table gives an
empty one (and weights of zero: nothing is added); input columns with a result's name are replaced.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

#: Kinds in their order, patterns and limits of the base detector.
KINDS = ("email", "ip", "card", "phone")
EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Rounds of messages; least belief of a label that is reported; least digits of a token with skip links.
ROUNDS = 8
BELIEF = 0.65
SKIP_DIGITS = 6
#: Digits at the end that make two numbers similar, and digits from which only equal numbers are.
END_DIGITS, WHOLE_DIGITS = 7, 14
#: The fit: steps, penalty, and links of one label that are told apart.
STEPS = 400
PENALTY = 0.05
MOST_LINKS = 3

LABELS = 1 + len(KINDS)  # 0: none
LINKS = 2  # equal, similar
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("added", T.BooleanType())])
_MARK = re.compile(r"[0-9@]+")
_EDGE = ".,;:!?\"'()[]{}<>|"
_GROUP = re.compile(r"[0-9]+")
#: what may stand between two digit groups of one number, and the most digits of one (a card after an exit code)
_BETWEEN = re.compile(r"[\s()\[\].,/+_\u2010-\u2015-]{1,4}")
_MOST_DIGITS = 22
#: what may stand between two neighbours that become one span
_JOINT = re.compile(r"[\s()-]{1,2}")
#: spelled-out "at" and the rest of such an address
_AT = re.compile(r"[ ]?[\[({<][ ]?at[ ]?[\])}>][ ]?", re.IGNORECASE)
_SPELLED_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|[ ]?[\[({<][ ]?dot[ ]?[\])}>][ ]?)[A-Za-z0-9-]{1,63}){1,8}", re.IGNORECASE)
_WORDED = re.compile(r"[\[({<][ ]?(?:at|dot)[ ]?[\])}>]", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    # no "@" can be part of what stands before or after it: each one is tried once, from left to right
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in EMAIL_NAME:
            start -= 1
        m = EMAIL_HOST.match(t, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = t.find("@", at + 1)


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base detector, sorted; a match that fails its check is dropped without a retry."""
    out = [(a, 0, b) for a, b in _emails(t)]
    for m in IP.finditer(t):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _spelled(t: str) -> list[tuple[int, int]]:
    """Addresses with a bracketed "at"."""
    out, done = [], 0
    for m in _AT.finditer(t):
        a = m.start()
        while a > done and t[a - 1] in EMAIL_NAME:
            a -= 1
        host = _SPELLED_HOST.match(t, m.end())
        if a < m.start() and host:
            out.append((a, host.end()))
            done = host.end()
    return out


def tokens(t: str) -> list[tuple[int, int]]:
    """Stretches without white space that hold a digit or "@", without punctuation at their ends."""
    out, done, n = [], 0, len(t)
    for m in _MARK.finditer(t):
        if m.start() < done:
            continue
        a, b = m.start(), m.end()
        while a > done and not t[a - 1].isspace():
            a -= 1
        while b < n and not t[b].isspace():
            b += 1
        done = b
        while a < b and t[a] in _EDGE:
            a += 1
        while b > a and t[b - 1] in _EDGE:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


#: features of a node: one for any, its digits by size with its digit groups, and the rest by name
SIZES, GROUPS = 9, 5
NAMED = ("letters", "at", "spelled", "quad", "plus", "luhn", "bare", "paren", "bracket", "apart")
FEATURES = 1 + SIZES * GROUPS + len(NAMED)


def features(token: str, spelled: bool = False) -> int:
    """The node's features as a bit mask."""
    groups = _GROUP.findall(token)
    digits = "".join(groups)
    n = len(digits)
    size = bisect_left((2, 3, 4, 6, 7, 9, 13, 19), n)
    named = (
        any(c.isalpha() for c in token),
        "@" in token,
        spelled,
        token.count(".") == 3,
        "+" in token,
        14 <= n <= 19 and luhn(digits),
        n == len(token),
        "(" in token or ")" in token,
        "[" in token or "]" in token,
        "-" in token or "." in token or " " in token,
    )
    out = 1 | 1 << (1 + size * GROUPS + min(len(groups), GROUPS - 1))
    for i, x in enumerate(named):
        out |= x << (1 + SIZES * GROUPS + i)
    return out


def feature_rows(masks: np.ndarray) -> np.ndarray:
    return (np.asarray(masks, dtype=np.int64)[:, None] >> np.arange(FEATURES)) & 1


def skip_key(token: str) -> str | None:
    """Equal keys make tokens equal: their digits, or their letters and digits if they hold "@" or a spelled-out one."""
    if "@" in token:
        return "@" + "".join(filter(str.isalnum, token.lower()))
    if _WORDED.search(token):
        return "@" + "".join(filter(str.isalnum, _WORDED.sub("", token).lower()))
    digits = "".join(c for c in token if "0" <= c <= "9")
    return digits if len(digits) >= SKIP_DIGITS else None


def _similar_key(key: str) -> str:
    """Equal ones make tokens similar."""
    return key if key[0] == "@" or not END_DIGITS < len(key) < WHOLE_DIGITS else key[-END_DIGITS:]


def _value_keys(span: str, kind: int) -> list[str]:
    """The keys of a base span's value, its own first."""
    key = skip_key(span)
    if key is None or KINDS[kind] != "phone":
        return [key] if key else []
    return [key[i:] for i in range(len(key) - SKIP_DIGITS + 1)]


def _value(digits: str, values: dict[str, tuple[int, int]]) -> tuple[int, int] | None:
    """The value that the digits write, with zeros or an exit code before it or not."""
    for d in (digits, digits.lstrip("0"), digits[3:] if digits.startswith("011") else ""):
        if len(d) >= SKIP_DIGITS and d in values:
            return values[d]
    return None


def _writings(t: str, toks: list[tuple[int, int]], values: dict[str, tuple[int, int]], busy: list[tuple[int, int]]) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """(start, end, value) of neighbouring digit groups outside of `busy` that write a value: the longest from each start."""
    groups, k = [], 0
    for m in _GROUP.finditer(t):
        while k < len(busy) and busy[k][1] <= m.start():
            k += 1
        if k == len(busy) or busy[k][0] >= m.end():
            groups.append(m.span())
    ends = [e for _, e in toks]
    i = 0
    while i < len(groups):
        near, digits, j = [], "", i
        while j < len(groups) and (j == i or _BETWEEN.fullmatch(t, groups[j - 1][1], groups[j][0])):
            digits += t[slice(*groups[j])]
            if len(digits) > _MOST_DIGITS:
                break
            near.append(digits)
            j += 1
        hit = next(((i + n, v) for n in range(len(near) - 1, -1, -1) if (v := _value(near[n], values)) is not None), None)
        if hit is None:
            i += 1
            continue
        a, b = groups[i][0], groups[hit[0]][1]
        # whole tokens, if they hold no other digits
        first, last = bisect_left(ends, a + 1), bisect_left(ends, b)
        if first < len(toks) and toks[first][0] <= a and not _GROUP.search(t, toks[first][0], a):
            low = toks[first][0]
        else:
            low = a
        high = toks[last][1] if last < len(toks) and toks[last][0] < b and not _GROUP.search(t, b, toks[last][1]) else b
        if any(s < high and e > low for s, e in busy[max(0, bisect_left(busy, (low, low)) - 1) :][:2]):
            low, high = a, b
        if low and t[low - 1] == "(" and ")" in t[low:high]:
            low -= 1
        if low and t[low - 1] == "+":
            low -= 1
        yield low, high, hit[1]
        i = hit[0] + 1


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _apart(toks: list[tuple[int, int]], busy: list[tuple[int, int]]) -> list[tuple[bool, int]]:
    """For each token whether it overlaps no stretch of `busy` (sorted, disjoint), and the first one that ends after its start."""
    out, k = [], 0
    for a, b in toks:
        while k < len(busy) and busy[k][1] <= a:
            k += 1
        out.append((k == len(busy) or busy[k][0] >= b, k))
    return out


class Graph:
    """One batch's field: nodes of all its documents, chain and skip edges.

    A skip edge runs from a base span to each other writing of its value, and from each remaining token to the
    next equal one, or to the next similar one if that isn't equal.
    """

    def __init__(self, texts: list[str], bases: list[list[tuple[int, int, int]]]):
        self.doc, self.at, self.masks, self.seen, self.tied = [], [], [], [], []
        chain, skip = [], []
        for d, (t, base) in enumerate(zip(texts, bases)):
            spelled = _spelled(t) if "at" in t or "AT" in t or "At" in t else []
            toks = tokens(t)
            if not (toks or spelled or base):
                continue
            busy = _merged([(a, b) for a, _, b in base])
            spelled = [x for x, (free, _) in zip(spelled, _apart(spelled, busy)) if free]
            # key -> (base span, kind of link)
            values: dict[str, tuple[int, int]] = {}
            own: list[int | None] = []
            for i, (a, kind, b) in enumerate(base):
                keys = _value_keys(t[a:b], kind)
                own.append(values.setdefault(keys[0], (i, 0))[0] if keys else None)
                for key in keys:
                    values.setdefault(key, (i, 1))
            starts = [x[0] for x in base]
            for (a, b), (free, k) in zip(toks, _apart(toks, busy)):
                if not free and (key := skip_key(t[a:b])):
                    i = bisect_left(starts, busy[k][0])
                    values.setdefault(key, (i if own[i] is None else own[i], 1))
            nodes = [(a, b, kind + 1, None, False) for a, kind, b in base]
            nodes += [(a, b, 0, skip_key(t[a:b]), True) for a, b in spelled]
            busy = _merged(busy + spelled)
            found = list(_writings(t, toks, values, busy)) if values else []
            nodes += [(a, b, 0, v, False) for a, b, v in found]
            busy = _merged(busy + [x[:2] for x in found])
            for (a, b), (free, _) in zip(toks, _apart(toks, busy)):
                if free:
                    nodes.append((a, b, 0, skip_key(t[a:b]), False))
            nodes.sort(key=lambda x: x[:3])
            first = len(self.doc)
            spans = [first + i for i, x in enumerate(nodes) if x[2]]
            equal: dict[str, int] = {}
            similar: dict[str, int] = {}
            before = None
            for node, (a, b, label, value, is_spelled) in enumerate(nodes, first):
                self.doc.append(d)
                self.at.append((a, b))
                self.masks.append(features(t[a:b], is_spelled))
                self.seen.append(label)
                plain = not label and not is_spelled and not isinstance(value, tuple)
                if plain and before is not None and 0 <= a - self.at[before][1] <= 2:
                    chain.append((before, node))
                before = node if plain else None
                if isinstance(value, str):
                    value = values.get(value, value)
                if isinstance(value, tuple):
                    skip.append((spans[value[0]], node, value[1]))
                elif value is not None:
                    near = _similar_key(value)
                    if value in equal:
                        skip.append((equal[value], node, 0))
                    elif near in similar:
                        skip.append((similar[near], node, 1))
                    equal[value] = similar[near] = node
                self.tied.append(isinstance(value, tuple))
        self.chain = np.array(chain, dtype=np.int64).reshape(-1, 2)
        self.skip = np.array(skip, dtype=np.int64).reshape(-1, 3)


class Weights:
    """Of features by label (none: 0), of neighbouring labels, and of agreeing labels by kind of link."""

    def __init__(self, unary=None, chain=None, skip=None):
        self.unary = np.zeros((FEATURES, LABELS)) if unary is None else np.asarray(unary, dtype=float)
        self.chain = np.zeros((LABELS, LABELS)) if chain is None else np.asarray(chain, dtype=float)
        self.skip = np.zeros((LINKS, LABELS)) if skip is None else np.asarray(skip, dtype=float)


def beliefs(g: Graph, w: Weights) -> np.ndarray:
    """Sum-product messages on the loopy graph; one distribution over labels for each node."""
    n = len(g.doc)
    unary = feature_rows(g.masks) @ w.unary
    seen = np.array(g.seen)
    unary = np.where((seen > 0)[:, None], np.where(np.arange(LABELS) == seen[:, None], 0.0, -1e6), unary)
    edges = np.concatenate([g.chain, g.skip[:, :2]])
    pot = np.concatenate([np.broadcast_to(w.chain, (len(g.chain), LABELS, LABELS)), w.skip[g.skip[:, 2]][:, :, None] * np.eye(LABELS)])
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
    e = len(edges)
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    msg = np.zeros((2 * e, LABELS))

    def total():
        out = unary.copy()
        for k in range(LABELS):
            out[:, k] += np.bincount(dst, weights=msg[:, k], minlength=n)
        return out

    for _ in range(ROUNDS if e else 0):
        into = total()[src] - msg[back]
        x = into[:, :, None] + pot
        top = x.max(axis=1)
        new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        msg = 0.5 * msg + 0.5 * (new - new.max(axis=1, keepdims=True))
    out = total()
    out = np.exp(out - out.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def find(texts: list[str | None], w: Weights) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, added) for each text, sorted by start, kind."""
    texts = [t or "" for t in texts]
    bases = [base_spans(t) for t in texts]
    out = [[(*s, False) for s in b] for b in bases]
    g = Graph(texts, bases)
    if not g.doc:
        return out
    p = beliefs(g, w)
    best = p.argmax(axis=1)
    last = None
    for i in np.flatnonzero((np.array(g.seen) == 0) & (best > 0) & (p.max(axis=1) >= BELIEF)).tolist():
        (a, b), d, kind = g.at[i], g.doc[i], int(best[i]) - 1
        spans = out[d]
        if last == (d, i - 1, kind) and _JOINT.fullmatch(texts[d], spans[-1][2], a) and not g.tied[i] and not g.tied[i - 1]:
            spans[-1] = (spans[-1][0], kind, b, True)
        else:
            spans.append((a, kind, b, True))
        last = (d, i, kind)
    for t, spans in zip(texts, out):
        for k, (a, kind, b, added) in enumerate(spans):
            # a bracket or plus that the token's end doesn't hold
            if added and a and (t[a - 1] == "+" or t[a - 1] == "(" and ")" in t[a:b]) and not any(y == a for _, _, y, _ in spans):
                spans[k] = (a - 1, kind, b, True)
        spans.sort()
    return out


def rewritten(span: str, kind: int, nr: int) -> tuple[str, str, str]:
    """Three other writings: one that shows what it is, one of the same value that may not, and one like it of another value."""
    groups = _GROUP.findall(span)
    digits = "".join(groups)
    other = "".join(str((int(c) * 7 + 3) % 10) for c in digits)
    if KINDS[kind] == "email":
        name, host = span.split("@")
        clear = (f"{name} [at] {host}", f"{name}(at){host}", f"{name} [at] {host.replace('.', ' [dot] ')}")[nr % 3]
        return clear, (f"{name} (AT) {host}", f"{name}@ {host}")[nr % 2], name + str(len(host))
    if KINDS[kind] == "ip":
        return ("[.]".join(groups), "(.)".join(groups))[nr % 2], "-".join(groups), "-".join(str(int(x[-3:]) + 256) for x in groups)
    if KINDS[kind] == "card":
        four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + nr % 8) % 10)
        return (".", "_", "/")[nr % 3].join(four), "--".join(four), (wrong, ".".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)))[nr % 2]
    rest = groups[1:] if len(groups) > 2 else [digits[-10:-7], digits[-7:-4], digits[-4:]]
    clear = (f"({rest[0]}) {'-'.join(rest[1:])}", "-".join(rest), ".".join(rest), " ".join([f"({rest[0]})", *rest[1:]]))[nr % 4]
    return clear, (digits, "".join(rest), "00" + digits, " ".join(rest), ".".join(groups))[nr % 5], (other, other[-10:])[nr % 2]


def lessons(t: str, base: list[tuple[int, int, int]]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Copies of the text with its base spans written otherwise, and where (start, end, label) that is; all else is none."""
    alone, beside, marks, more = [], [t], [], []
    done = at = 0
    size = len(t)
    for nr, (a, kind, b) in enumerate(base):
        clear, unclear, decoy = rewritten(t[a:b], kind, zlib.crc32(t[a:b].encode()) + nr)
        if a >= done:
            alone += [t[done:a], clear]
            at += a - done
            marks.append((at, at + len(clear), kind + 1))
            at += len(clear)
            done = b
        # numbers of other meaning stand right before some
        for lead, other, label in ((" and ", unclear, kind + 1), (" and ", decoy, 0), (f" in {1990 + nr % 40} ", clear, kind + 1), (f" with {nr % 90} ", unclear, kind + 1)):
            beside += [lead, other]
            size += len(lead) + len(other)
            if label:
                more.append((size - len(other), size, label))
    return [("".join([*alone, t[done:]]), marks), ("".join(beside), more)]


def _patterns(texts: list[str], bases: list[list[tuple[int, int, int]]], marks: list[list[tuple[int, int, int]]] | None) -> Counter:
    """(features, surroundings, label) of the nodes without an observed label; marks: labels (None: those of base spans, other writings of their values aren't counted)."""
    g = Graph(texts, bases)
    if not g.doc:
        return Counter()
    label, counted = np.array(g.seen), np.array(g.seen) == 0
    if marks is None:
        counted &= ~np.array(g.tied)
        of = {b: g.seen[a] for a, b, _ in g.skip.tolist() if g.tied[b]}
        for node, y in of.items():
            label[node] = y
    else:
        for node, (d, (a, b)) in enumerate(zip(g.doc, g.at)):
            if not g.seen[node]:
                label[node] = next((y for p, q, y in marks[d] if p < b and q > a), 0)
    n = len(label)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    right[g.chain[:, 0]], left[g.chain[:, 1]] = label[g.chain[:, 1]] + 1, label[g.chain[:, 0]] + 1
    links = np.zeros((n, LINKS * LABELS), np.int64)
    for a, b, kind in g.skip.tolist():
        links[b, kind * LABELS + label[a]] += 1
        links[a, kind * LABELS + label[b]] += 1
    around = left + (LABELS + 1) * right
    around = around * (MOST_LINKS + 1) ** (LINKS * LABELS) + np.minimum(links, MOST_LINKS) @ (MOST_LINKS + 1) ** np.arange(LINKS * LABELS)
    masks = np.array(g.masks)
    return Counter(zip(masks[counted].tolist(), around[counted].tolist(), label[counted].tolist()))


def _counted(texts: list[str | None]) -> Counter:
    """The patterns of the texts and of their lessons."""
    texts = [t or "" for t in texts]
    bases = [base_spans(t) for t in texts]
    out = _patterns(texts, bases, None)
    taught = [x for t, b in zip(texts, bases) if b for x in lessons(t, b)]
    out.update(_patterns([t for t, _ in taught], [base_spans(t) for t, _ in taught], [m for _, m in taught]))
    return out


def trained(patterns: Counter) -> Weights:
    """The weights of largest penalised pseudo-likelihood, by accelerated gradient steps (the function is concave)."""
    if not patterns:
        return Weights()
    rows = sorted(patterns.items())
    x = feature_rows([m for (m, _, _), _ in rows]).astype(float)
    around = np.array([a for (_, a, _), _ in rows], dtype=np.int64)
    y = np.array([label for (_, _, label), _ in rows])
    n = np.array([c for _, c in rows], dtype=float)
    powers = (MOST_LINKS + 1) ** np.arange(LINKS * LABELS)
    links = ((around[:, None] // powers) % (MOST_LINKS + 1)).reshape(-1, LINKS, LABELS).astype(float)
    sides = around // (MOST_LINKS + 1) ** (LINKS * LABELS)
    near = np.zeros((len(rows), LABELS))  # labels of the neighbours
    for side in (sides % (LABELS + 1), sides // (LABELS + 1)):
        near += np.arange(1, LABELS + 1) == side[:, None]
    goal = np.eye(LABELS)[y]
    parts = [np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LINKS, LABELS))]
    ahead, t = [p.copy() for p in parts], 1.0
    most = (x.sum(axis=1) + (near**2).sum(axis=1) + (links**2).sum(axis=(1, 2))).max()
    rate = 1.0 / (0.5 * most + PENALTY)
    scale = n / n.sum()
    for _ in range(STEPS):
        u, c, s = ahead
        z = x @ u + near @ c + (links * s[None]).sum(axis=1)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        gap = (goal - z / z.sum(axis=1, keepdims=True)) * scale[:, None]
        pull = near.T @ gap
        steps = [x.T @ gap, (pull + pull.T) / 2, (links * gap[:, None, :]).sum(axis=0)]
        new = [p + rate * (d - PENALTY / n.sum() * p) for p, d in zip(ahead, steps)]
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = [q + (t - 1) / t2 * (q - p) for p, q in zip(parts, new)]
        parts, t = new, t2
    return Weights(*parts)


def fit(df: DataFrame, text: str = "text") -> Weights:
    """Weights from all documents; the driver gets sums, one row for each pattern."""
    picked = df.select(F.col(text).alias("_text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                total += _counted(batch.slice(at, 64).column("_text").to_pylist())
        rows = sorted(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k, _ in rows], pa.int64()) for i in range(3)] + [pa.array([v for _, v in rows], pa.int64())], ["mask", "around", "label", "n"])

    rows = picked.mapInArrow(step, "mask long, around long, label long, n long").groupBy("mask", "around", "label").agg(F.sum("n").alias("n")).collect()
    return trained(Counter({(r.mask, r.around, r.label): r.n for r in rows}))


def redacted(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    """The text with each stretch of overlapping spans replaced by its first span's kind, as in <email>."""
    if not spans:
        return text
    out, done, end = [], 0, -1
    for a, kind, b, _ in spans:
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            done = end
        out += [text[done:a], f"<{KINDS[kind]}>"]
        end = b
    return "".join([*out, text[end:]])


def detect(df: DataFrame, weights: Weights | None = None, text: str = "text", doc_id: str = "doc_id", spans: str = "spans", clean: str | None = None) -> DataFrame:
    """Adds `spans` (array of kind, start, end, added) and, if named, `clean` (the redacted text; null stays null)."""
    given = df.sparkSession.sparkContext.broadcast(weights or fit(df, text))
    df = without(df, [spans] + ([clean] if clean and clean != text else []))
    fields = [f for f in df.schema.fields]
    own = [T.StructField(spans, T.ArrayType(SPAN))] + ([T.StructField(clean, T.StringType())] if clean and clean != text else [])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = given.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(text).to_pylist()
                found = find(texts, w)
                out = part
                if clean:
                    new = pa.array([redacted(t, s) for t, s in zip(texts, found)], pa.string())
                    out = out.set_column(out.schema.get_field_index(text), text, new) if clean == text else out
                rows = pa.array([[{"kind": KINDS[k], "start": a, "end": b, "added": x} for a, k, b, x in s] for s in found], kind)
                out = out.append_column(spans, rows)
                yield out.append_column(clean, new) if clean and clean != text else out

    return df.mapInArrow(step, T.StructType(fields + own))
