"""Operator 7, personal data by a character BiLSTM with CRF transitions, over fixed base patterns.

The base patterns (email, ip, card, phone) are exact.  The network tags characters with O, B- and
I- of the four kinds and finds what the patterns don't: phones without a plus, spelt-out at signs and dots,
cards grouped by dots.  It is trained here, in numpy, on labelled spans: by default on sentences
that a seeded generator writes, so it needs no corpus and is the same in every run.

Every span of the four kinds holds a digit or an at sign, plain or spelt out; windows of WINDOW
characters, half overlapping, cover REACH characters around each one and the tokens cut there; a span
cut by its window is refused.  All windows of all texts of a
batch are decoded by Viterbi; where windows disagree, the span farther from the ends of its window
wins.  A span is added if it doesn't overlap a base span and holds what its kind must hold.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
WINDOW, REACH, HIDDEN, EMBEDDING = 96, 32, 20, 12
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0@.+-()[]{}_% ,:;/=\"'#!?\n"
_UNKNOWN, _PAD = len(_SYMBOLS) + 1, 0
_CODE = {c: i + 1 for i, c in enumerate(_SYMBOLS)} | {c: _SYMBOLS.index("0") + 1 for c in "123456789"} | {c.upper(): i + 1 for i, c in enumerate(_SYMBOLS[:26])}
_REST = re.compile(r"\S*(?:\s?(?:\.|[(\[{] ?dot ?[)\]}]|\bdot\b)\s?\S+)*", re.I)
#: What every span of the four kinds holds: a digit, an at sign, or "at" spelt out, bare only where a "dot" follows.
ANCHOR = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]|\bat\b(?=[^\n]{1,100}?\bdot\b)", re.I)

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start."""
    out: list[Span] = []
    if re.search("[0-9@]", text) is None:
        return out
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# --- the network ---------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def new_parameters(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    h, e = HIDDEN, EMBEDDING
    p = {"emb": rng.normal(0, 0.3, (_UNKNOWN + 1, e)), "out": rng.normal(0, 0.2, (2 * h, TAGS)), "out_b": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
    for d in "fb":
        p |= {f"wx{d}": rng.normal(0, 1 / np.sqrt(e), (e, 4 * h)), f"wh{d}": rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)), f"b{d}": np.concatenate([np.ones(h), np.zeros(3 * h)])}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _lstm(x: np.ndarray, wh: np.ndarray, keep: list | None) -> np.ndarray:
    """States (steps, batch, HIDDEN) from gate inputs x (steps, batch, 4 HIDDEN): forget, in, out, cell."""
    steps, batch, _ = x.shape
    h = c = np.zeros((batch, HIDDEN), np.float32)
    out = np.empty((steps, batch, HIDDEN), np.float32)
    for t in range(steps):
        z = x[t] + h @ wh
        g = _sigmoid(z[:, : 3 * HIDDEN])
        n = np.tanh(z[:, 3 * HIDDEN :])
        f, i, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
        before, c = c, f * c + i * n
        s = np.tanh(c)
        if keep is not None:
            keep.append((h, before, f, i, o, n, s))
        h = o * s
        out[t] = h
    return out


def _lstm_back(dh_out: np.ndarray, wh: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    steps, batch, _ = dh_out.shape
    dx = np.empty((steps, batch, 4 * HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    dh = dc = np.zeros((batch, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, before, f, i, o, n, s = keep[t]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - s * s)
        dz = np.concatenate([dc * before * f * (1 - f), dc * n * i * (1 - i), dh * s * o * (1 - o), dc * i * (1 - n * n)], axis=1)
        dx[t] = dz
        dwh += h.T @ dz
        dh, dc = dz @ wh.T, dc * f
    return dx, dwh


def _forward(p: dict, codes: np.ndarray, keep: tuple | None = None) -> np.ndarray:
    """Emissions (steps, batch, TAGS) of codes (batch, steps)."""
    x = p["emb"][codes.T]
    kf, kb = keep if keep else (None, None)
    hf = _lstm(x @ p["wxf"] + p["bf"], p["whf"], kf)
    hb = _lstm((x @ p["wxb"] + p["bb"])[::-1], p["whb"], kb)[::-1]
    both = np.concatenate([hf, hb], axis=2)
    return (both @ p["out"] + p["out_b"]) if keep is None else (both @ p["out"] + p["out_b"], x, both)


def _forbidden() -> np.ndarray:
    """I-kind follows only B-kind or I-kind; a text doesn't start with I-kind (last row)."""
    out = np.zeros((TAGS + 1, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[inside - 1, inside] = out[inside, inside] = 0
    return out


_RULE = _forbidden()


def _crf_grad(e: np.ndarray, tags: np.ndarray, mask: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Negative log likelihood and its gradients, by forward and backward sums. All are (steps, batch, ...)."""
    steps, batch, _ = e.shape
    logsum = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = first + e[0]
    for t in range(1, steps):
        alpha[t] = np.where(mask[t][:, None], logsum(alpha[t - 1][:, :, None] + trans, 1) + e[t], alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        beta[t] = np.where(mask[t + 1][:, None], logsum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2), 0)
    z = logsum(alpha[-1], 1)
    de = np.exp(np.minimum(alpha + beta - z[:, None], 0)) * mask[:, :, None]
    loss, dtrans, rows = float(z.sum()), np.zeros_like(trans), np.arange(batch)
    dfirst = de[0].sum(axis=0)
    for t in range(steps):
        on = rows[mask[t]]
        de[t, on, tags[t, on]] -= 1
        loss -= float(e[t, on, tags[t, on]].sum())
        if t:
            pair = np.exp(np.minimum(alpha[t - 1][on, :, None] + trans + (e[t][on] + beta[t][on])[:, None, :] - z[on, None, None], 0))
            dtrans += pair.sum(axis=0)
            np.add.at(dtrans, (tags[t - 1, on], tags[t, on]), -1)
            loss -= float(trans[tags[t - 1, on], tags[t, on]].sum())
    np.add.at(dfirst, tags[0], -1)
    return loss - float(first[tags[0]].sum()), de, dtrans, dfirst


def fit(examples: list[tuple[str, list[Span]]], rounds: int = 4, batch: int = 48, rate: float = 0.012, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters from labelled texts of at most WINDOW characters, by Adam."""
    p = new_parameters(seed)
    codes, tags = np.zeros((len(examples), WINDOW), np.int64), np.zeros((len(examples), WINDOW), np.int64)
    for r, (text, spans) in enumerate(examples):
        codes[r, : len(text)] = encode(text)
        for kind, a, b in spans:
            k = KINDS.index(kind)
            tags[r, a:b] = 2 + 2 * k
            tags[r, a] = 1 + 2 * k
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    rng = np.random.default_rng(seed)
    total = rounds * (-(-len(examples) // batch))
    for _ in range(rounds):
        order = rng.permutation(len(examples))
        for lo in range(0, len(order), batch):
            x, y = codes[order[lo : lo + batch]], tags[order[lo : lo + batch]].T
            kf: list = []
            kb: list = []
            e, emb, both = _forward(p, x, (kf, kb))
            mask = (x != _PAD).T
            _, de, dtrans, dfirst = _crf_grad(e, y, mask, p["trans"] + _RULE[:TAGS], p["first"] + _RULE[TAGS])
            de = (de / len(x)).astype(np.float32)
            g = {"out": np.einsum("tbh,tbk->hk", both, de), "out_b": de.sum(axis=(0, 1)), "trans": dtrans / len(x), "first": dfirst / len(x)}
            dboth = de @ p["out"].T
            dxf, g["whf"] = _lstm_back(dboth[:, :, :HIDDEN], p["whf"], kf)
            dxb, g["whb"] = _lstm_back(dboth[::-1, :, HIDDEN:], p["whb"], kb)
            dxb = dxb[::-1]
            g |= {"wxf": np.einsum("tbe,tbk->ek", emb, dxf), "wxb": np.einsum("tbe,tbk->ek", emb, dxb), "bf": dxf.sum(axis=(0, 1)), "bb": dxb.sum(axis=(0, 1))}
            g["emb"] = np.zeros_like(p["emb"])
            np.add.at(g["emb"], x.T, dxf @ p["wxf"].T + dxb @ p["wxb"].T)
            norm = np.sqrt(sum(float((d**2).sum()) for d in g.values()))
            step += 1
            for k, d in g.items():
                d = d * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                p[k] = (p[k] - rate * (1 - step / (total + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def encode(text: str) -> list[int]:
    return [_CODE.get(c, _UNKNOWN) for c in text]


def decode(p: dict[str, np.ndarray], windows: list[str]) -> list[list[Span]]:
    """Spans of each window of at most WINDOW characters, by Viterbi."""
    out: list[list[Span]] = []
    trans, first = p["trans"] + _RULE[:TAGS], p["first"] + _RULE[TAGS]
    for lo in range(0, len(windows), 512):
        part = windows[lo : lo + 512]
        codes = np.zeros((len(part), WINDOW), np.int64)
        for r, w in enumerate(part):
            codes[r, : len(w)] = encode(w)
        e = _forward(p, codes)
        score, back = first + e[0], np.empty((WINDOW, len(part), TAGS), np.int8)
        for t in range(1, WINDOW):
            every = score[:, :, None] + trans
            back[t] = every.argmax(axis=1)
            best = every.max(axis=1) + e[t]
            inside = (codes[:, t] != _PAD)[:, None]
            back[t] = np.where(inside, back[t], np.arange(TAGS))
            score = np.where(inside, best, score)
        tags = np.empty((len(part), WINDOW), np.int64)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(WINDOW - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(len(part)), tags[:, t]]
        for r, w in enumerate(part):
            spans, row = [], tags[r, : len(w)].tolist()
            if any(row):
                t = 0
                while t < len(row):
                    if row[t] % 2 == 1:
                        end = t + 1
                        while end < len(row) and row[end] == row[t] + 1:
                            end += 1
                        spans.append((KINDS[row[t] // 2], t, end))
                        t = end
                    else:
                        t += 1
            out.append(spans)
    return out


# --- labelled spans ------------------------------------------------------------------------------

_PARTS = "an en er in on re st th ti ou ha le la de ch ge ei un ue as os ci ra do ment tion ing ble ung lich que".split()


def examples(n: int = 3_000, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Invented sentences with labelled spans, plain and disguised, and numbers that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(_PARTS) for _ in range(rng.randint(1, 3)))

    def email() -> str:
        name = rng.choice((word() + rng.choice(("", ".", "_", "-")) + word(), word() + "." + digits(2), word() + digits(rng.randint(0, 3))))
        at = rng.choice(("@", "@", "@", " (at) ", "(at)", " [at] ", "[at]", " @ ", " {at} ", " at ", " at "))
        if rng.random() < 0.15:
            at = at.upper()
        dot = rng.choice((" dot ", " dot ", " DOT ", " (dot) ")) if at in (" at ", " AT ") else "." if at in "@" or rng.random() < 0.4 else rng.choice((".", " . ", " (dot) ", "(dot)", " [dot] ", "[dot]"))
        return name + at + word() + rng.choice(("", digits(1))) + dot + rng.choice(("com", "org", "net", "de", "example" + dot + "com"))

    def ip() -> str:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice((".", ".", ".", " . ", "[.]", "(.)")).join(parts)

    def card() -> str:
        body = digits(15)
        body += next(c for c in "0123456789" if _luhn(body + c))
        return rng.choice(("", "", " ", "-", ".", "  ", "_")).join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice((f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{rng.randint(1, 99)} {a} {b} {c}", f"+{digits(11)}", f"({a}) {b} {c}"))

    def other() -> str:
        hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
        return rng.choice((f"password={hexes(18)}", f'"{hexes(40)}"', digits(rng.randint(1, 6)), f"{rng.randint(1, 30)}.", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.", f"{rng.randint(1900, 2030)}-{digits(2)}-{digits(2)}", f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"{digits(1)},{digits(3)}", f"#{digits(5)}", f"AK{hexes(16).upper()}", f"{digits(2)}:{digits(2)}", f"@{word()}", f"{word()}{digits(2)}"))

    makers, out = {"email": email, "ip": ip, "card": card, "phone": phone}, []
    for _ in range(n):
        text, spans = "", []
        while len(text) < 40:
            text += (" " if text else "") + " ".join(word() + rng.choice(("", "", "", ",", ".")) for _ in range(rng.randint(1, 4))) + " "
            kind = rng.choice((*KINDS, "", ""))
            s = makers[kind]() if kind else other()
            if len(text) + len(s) > WINDOW - 1:
                break
            if kind:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + rng.choice(("", "", ".", ","))
        text = (text + " " + " ".join(word() for _ in range(8)))[: rng.randint(max([len(text) - 1, *(s[2] for s in spans)]), WINDOW)]
        if rng.random() < 0.3:
            text = text[:1].upper() + text[1:]
        out.append((text, spans))
    return out


@lru_cache(1)
def trained() -> dict[str, np.ndarray]:
    return fit(examples())


# --- whole texts ---------------------------------------------------------------------------------


def _token(text: str, a: int, b: int) -> tuple[int, int]:
    """a and b moved out to the ends of the tokens that they cut, and of hosts whose dots are spelt out or spaced."""
    while 0 < a < len(text) and not text[a - 1].isspace() and not text[a].isspace():
        a -= 1
    return a, _REST.match(text, b).end() if b < len(text) and not text[b - 1].isspace() else b


def _windows(text: str) -> list[tuple[int, str]]:
    """Half overlapping windows over what lies within REACH of an anchor, and over the tokens cut there.

    Each at sign has a window more, from the start of the token before it.
    """
    out, areas = [], []
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if areas and a <= areas[-1][1]:
            areas[-1][1] = max(b, areas[-1][1])
        else:
            areas.append([a, b])
        if not m[0].isdigit():
            start = m.start() - (text[max(0, m.start() - 1) : m.start()] == " ")
            least = max(0, start - WINDOW)
            while start > least and not text[start - 1].isspace():
                start -= 1
            out.append((start, text[start : start + WINDOW]))
    whole: list[list[int]] = []
    for a, b in areas:
        if whole and b <= whole[-1][1]:
            continue
        a, b = _token(text, a, b) if not whole or a > whole[-1][1] else (whole[-1][1], _token(text, b, b)[1])
        if whole and a <= whole[-1][1]:
            whole[-1][1] = max(b, whole[-1][1])
        else:
            whole.append([a, b])
    for at, b in whole:
        while True:
            out.append((at, text[at : min(b, at + WINDOW)]))
            if at + WINDOW >= b:
                break
            at += WINDOW // 2
    return list(dict.fromkeys(out))


def _is_cut(text: str, a: int, b: int, lo: int, hi: int) -> bool:
    """Whether the span a to b ends at an end of its window lo to hi, inside a token."""
    return a == lo and lo > 0 and not text[lo - 1].isspace() or b == hi and hi < len(text) and not text[hi].isspace()


def _plausible(kind: str, text: str) -> bool:
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "email":
        spelt = r"(?: ?[(\[{] ?dot ?[)\]}] ?| dot )"
        marked = r"(?: ?@ ?| ?[(\[{] ?at ?[)\]}] ?)[A-Za-z0-9-]+(?:(?: ?\. ?|" + spelt + r")[A-Za-z0-9-]+)+"
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+(?:" + marked + r"| at [A-Za-z0-9-]+(?:" + spelt + r"[A-Za-z0-9-]+)+)", text, re.I))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and bool(re.fullmatch(r"[0-9 .()\[\]]+", text))
    if kind == "card":
        return 13 <= len(digits) <= 19 and bool(re.fullmatch(r"[0-9 ._-]+", text)) and _luhn(digits)
    return 7 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?[0-9 ().-]+", text)) and len(re.findall(r"[ ().-]+", text)) >= 2


def reconcile(found: list[tuple[int, Span]], text: str, base: list[Span]) -> list[Span]:
    """Spans of all windows of a text to one list without overlaps. found: distance to the window's nearer end, and the span."""
    taken = [(a, b) for _, a, b in base]
    out: list[Span] = []
    for _, kind, a, b in sorted((-d, *s) for d, s in found):
        if _plausible(kind, text[a:b]) and all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b))
    return out


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while b > a and text[b - 1] in " ,.;:\n":
        b -= 1
    while a < b and text[a] in " \n":
        a += 1
    return a, b


def _find(p: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            added: dict[int, list[tuple[int, Span]]] = {}
            waiting: list[tuple[int, int, str]] = []
            for row, t in enumerate(texts):
                waiting += [(row, at, w) for at, w in _windows(t)]
                if len(waiting) >= 2048 or row == len(texts) - 1:
                    for (r, at, w), spans in zip(waiting, decode(p, [w for _, _, w in waiting])):
                        for kind, a, b in spans:
                            if _is_cut(texts[r], at + a, at + b, at, at + len(w)):
                                continue
                            x, y = _trim(w, a, b)
                            added.setdefault(r, []).append((min(a if at else WINDOW, len(w) - b if at + len(w) < len(texts[r]) else WINDOW), (kind, at + x, at + y)))
                    waiting = []
            rank = KINDS.index
            show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (rank(s[0]), s[1])))
            counts = [[sum(s[0] == k for s in b) for b in base] for k in KINDS]
            sha = [hashlib.sha256(show(b).encode()).hexdigest() for b in base]
            spans = [show(b + reconcile(added[r], texts[r], b)) if r in added else show(b) for r, b in enumerate(base)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find(docs: DataFrame, parameters: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs (doc_id, text; others are ignored).

    The counts and the hash are of base spans; spans also has those that the network adds.  Null
    and empty texts have none; each repeated row is searched again.
    """
    return docs.select("doc_id", "text").mapInArrow(_find(parameters or trained()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
