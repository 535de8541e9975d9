"""Personal data and secrets: a character BiLSTM with CRF transitions, in numpy.

Characters are embedded and read by an LSTM in either direction (piecewise linear gates
and activations, both directions in one scan); a linear layer scores the kinds O, EMAIL, PHONE, IP, CARD and SECRET for each character and
a CRF with learned transitions joins them.  Training maximises the CRF likelihood by
back-propagation through time with Adam, from labelled spans: lines of a bounded sample
of the corpus (``train_docs`` documents) into which values of these kinds, and harmless
look-alikes, are set, so the labels are exact.

Whole texts, however long, are read in windows of 640 characters that overlap by 64.  Each
window is decoded by Viterbi; a bound first settles the windows in which no path can beat
"all O" (exactly: the result is that of decoding them).  Neighbouring windows are then
reconciled over the whole document: in their overlap the text passes from the one to the
other where both say O, nearest to the middle, else where both agree, else in the middle;
runs of one kind are spans.  A span must be what its kind is by definition: an EMAIL holds
an @, a PHONE digits, an IP four numbers below 256, and a CARD is 13 to 19 digits with a
right check digit (a run of several numbers is taken apart), as any other long number isn't
a card.

Defined cases: null doc_id: no row.  Null text: null text, no spans.  Empty text: no spans.
Very long texts: more windows.  Repeated rows: judged and returned each; equal texts are
decoded once a batch.  Ties between paths: the kind that comes first.  Characters beyond
the alphabet count as "other letter" or "other".  Extra columns: ignored.  Empty table: no
rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import bounded_sample, project, table

KINDS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET")
WINDOW, OVERLAP, ROUND = 640, 64, 64
BATCH = 768
HIDDEN, EMBED = 12, 8
TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_LENGTH, STEPS = 400, 8192, 96, 1000
_KNOWN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\t.,;:!?@+-_=\"'()[]{}<>/\\|#$%&*~^`"
PAD, LETTER, OTHER = 0, 1, 2
VOCABULARY = len(_KNOWN) + 3
_DIGITS = re.compile("[0-9]+")
_TABLE = np.full(0x250, OTHER, np.uint8)
for _c in range(0x250):
    if chr(_c).isalpha():
        _TABLE[_c] = LETTER
for _k, _ch in enumerate(_KNOWN):
    _TABLE[ord(_ch)] = _k + 3


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = _TABLE[np.minimum(points, 0x24F)]
    return np.where(points < 0x250, ids, LETTER) if len(points) and points.max() >= 0x250 else ids


@dataclass
class Model:
    """embed (V, d); cells (2, 4H, H + d + 1), ahead and back, gates i f o g; out (L, 2H + 1); moves (L, L) from, to."""

    embed: np.ndarray
    cells: np.ndarray
    out: np.ndarray
    moves: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7, hidden: int = HIDDEN, dim: int = EMBED, dtype=np.float32) -> Model:
        rng = np.random.default_rng(seed)
        cells = rng.normal(0, 0.3, (2, 4 * hidden, hidden + dim + 1))
        cells[:, :, -1] = 0
        cells[:, hidden : 2 * hidden, -1] = 1.0
        n = len(KINDS)
        return cls(rng.normal(0, 0.5, (VOCABULARY, dim)).astype(dtype), cells.astype(dtype), rng.normal(0, 0.2, (n, 2 * hidden + 1)).astype(dtype), np.zeros((n, n), dtype))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.cells, self.out, self.moves]

    def save(self, path: str) -> None:
        np.savez(path, *self.parts())

    @classmethod
    def load(cls, path: str) -> Model:
        with np.load(path) as kept:
            return cls(*(kept[f"arr_{k}"] for k in range(4)))


def _scan(w: np.ndarray, inputs: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (2, T, H, B) of both directions, side by side, for inputs (T, d, B); keep: what the gradient needs, by step."""
    steps, dim, batch = inputs.shape
    hidden = w.shape[1] // 4
    scaled = w.copy()
    scaled[:, : 3 * hidden] *= 0.2
    scaled[:, : 3 * hidden, -1] += 0.5
    feed = np.zeros((2, hidden + dim + 1, batch), w.dtype)
    feed[:, -1] = 1
    c, z, tc = np.zeros((2, hidden, batch), w.dtype), np.empty((2, 4 * hidden, batch), w.dtype), np.empty((2, hidden, batch), w.dtype)
    states, kept = np.empty((2, steps, hidden, batch), w.dtype), []
    gates, before = z[:, : 3 * hidden], feed[:, :hidden]
    i, f, o, g = (z[:, k * hidden : (k + 1) * hidden] for k in range(4))
    ahead, back = feed[0, hidden:-1], feed[1, hidden:-1]
    for t in range(steps):
        ahead[:] = inputs[t]
        back[:] = inputs[steps - 1 - t]
        np.matmul(scaled, feed, out=z)
        np.clip(gates, 0, 1, out=gates)
        np.clip(g, -1, 1, out=g)
        if keep:
            kept.append((t, feed.copy(), z.copy(), c.copy()))
        np.multiply(f, c, out=c)
        np.multiply(i, g, out=i)
        np.add(c, i, out=c)
        np.clip(c, -1, 1, out=tc)
        np.multiply(o, tc, out=before)
        states[0, t] = before[0]
        states[1, steps - 1 - t] = before[1]
        if keep:
            kept[-1] += (c.copy(), tc.copy())
    return states, kept


def _unscan(w: np.ndarray, kept: list, d_states: np.ndarray, d_inputs: np.ndarray) -> np.ndarray:
    """Gradient of w; that of the inputs is added to d_inputs."""
    hidden, last = w.shape[1] // 4, len(kept) - 1
    dw, dh, dc, turned = np.zeros_like(w), 0, 0, w.transpose(0, 2, 1)
    for t, feed, z, before, c, tc in reversed(kept):
        i, f, o, g = (z[:, k * hidden : (k + 1) * hidden] for k in range(4))
        dh = dh + np.stack([d_states[0, t], d_states[1, last - t]])
        dc = dc + dh * o * (np.abs(c) < 1)
        dz = np.concatenate([dc * g, dc * before, dh * tc, dc * i * (np.abs(g) < 1)], axis=1)
        gates = z[:, : 3 * hidden]
        dz[:, : 3 * hidden] *= 0.2 * ((gates > 0) & (gates < 1))
        dw += dz @ feed.transpose(0, 2, 1)
        d_feed = turned @ dz
        dh, dc = d_feed[:, :hidden], dc * f
        d_inputs[t] += d_feed[0, hidden:-1]
        d_inputs[last - t] += d_feed[1, hidden:-1]
    return dw


def emissions(m: Model, ids: np.ndarray) -> np.ndarray:
    """Scores (T, L, B) of character ids (T, B)."""
    steps, batch = ids.shape
    inputs = np.empty((steps, m.embed.shape[1], batch), m.embed.dtype)
    at = ids.astype(np.intp)
    for k, column in enumerate(m.embed.T.copy()):
        inputs[:, k] = column[at]
    hidden = m.cells.shape[1] // 4
    states, _ = _scan(m.cells, inputs, False)
    scores = np.matmul(m.out[:, :hidden], states[0])
    scores += np.matmul(m.out[:, hidden:-1], states[1])
    scores += m.out[:, -1:]
    return scores


def loss_and_gradients(m: Model, ids: np.ndarray, gold: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative CRF log-likelihood a window of ids, gold (T, B), and its gradients."""
    steps, batch = ids.shape
    inputs = np.ascontiguousarray(m.embed[ids].transpose(0, 2, 1))
    hidden, n = m.cells.shape[1] // 4, len(m.moves)
    states, kept = _scan(m.cells, inputs, True)
    both = np.concatenate([states[0], states[1], np.ones((steps, 1, batch), states.dtype)], axis=1)
    scores = np.matmul(m.out, both)
    top = scores.max(axis=1, keepdims=True)
    e = np.exp(scores - top)
    high = m.moves.max()
    step = np.exp(m.moves - high)
    alpha, beta, norm = np.empty_like(e), np.empty_like(e), np.empty((steps, 1, batch), e.dtype)
    for t in range(steps):
        a = e[t] if t == 0 else (step.T @ alpha[t - 1]) * e[t]
        norm[t] = a.sum(axis=0, keepdims=True)
        alpha[t] = a / norm[t]
    beta[-1] = 1
    for t in range(steps - 2, -1, -1):
        beta[t] = (step @ (beta[t + 1] * e[t + 1])) / norm[t + 1]
    marginals = alpha * beta
    marginals /= marginals.sum(axis=1, keepdims=True)
    hot = np.eye(n, dtype=e.dtype)[gold].transpose(0, 2, 1)
    path = (scores * hot).sum() + m.moves[gold[:-1], gold[1:]].sum()
    total = np.log(norm).sum() + top.sum() + high * (steps - 1) * batch
    d_scores = (marginals - hot) / batch
    d_moves = np.zeros_like(m.moves)
    for t in range(steps - 1):
        d_moves += (alpha[t] @ ((beta[t + 1] * e[t + 1]) / norm[t + 1]).T) * step
    np.subtract.at(d_moves, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    d_out = np.einsum("tlb,tkb->lk", d_scores, both, optimize=True)
    d_both = np.matmul(m.out.T, d_scores)
    d_inputs = np.zeros_like(inputs)
    d_cells = _unscan(m.cells, kept, np.stack([d_both[:, :hidden], d_both[:, hidden : 2 * hidden]]), d_inputs)
    d_embed = np.zeros_like(m.embed)
    np.add.at(d_embed, ids.ravel(), d_inputs.transpose(0, 2, 1).reshape(-1, inputs.shape[1]))
    return float((total - path) / batch), [d_embed, d_cells, d_out, d_moves / batch]


def train(ids: np.ndarray, gold: np.ndarray, steps: int = STEPS, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Model:
    """ids, gold: (windows, T)."""
    m, rng = Model.fresh(seed), np.random.default_rng(seed)
    first, second = [np.zeros_like(p) for p in m.parts()], [np.zeros_like(p) for p in m.parts()]
    for k in range(1, steps + 1):
        at = rng.integers(0, len(ids), batch)
        _, grads = loss_and_gradients(m, ids[at].T, gold[at].T)
        scale = min(1.0, 5.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grads)))))
        lr = rate * min(1.0, k / 20) * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * k / steps)))
        for p, g, a, b in zip(m.parts(), grads, first, second):
            g = g * scale
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (lr * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)).astype(p.dtype)
    return m


def _value(rng: random.Random, words: list[str]) -> tuple[str, str, str, str]:
    """(before, value, after, kind) of a random value; before and after belong to its setting, not to it."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pick = lambda chars, lo, hi: "".join(rng.choice(chars) for _ in range(rng.randint(lo, hi)))
    lower, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    kind = rng.choice(KINDS[1:])
    if kind == "EMAIL":
        local = rng.choice([pick(lower, 2, 10), rng.choice(words).strip(".,").lower() or "x"])
        local += rng.choice(["", f".{digits(2)}", f".{digits(2)}", f".{pick(lower, 2, 8)}", f"_{digits(1)}", digits(3), f"+{pick(lower, 2, 4)}"])
        host = pick(lower, 2, 8) + rng.choice(["", digits(1)]) + rng.choice(["", ".example", "-" + pick(lower, 2, 4)])
        return "", f"{local}@{rng.choice(['mail' + digits(1) + '.example', host])}.{rng.choice(['com', 'org', 'net', 'de', 'io'])}", "", kind
    if kind == "PHONE":
        a, b, c = digits(3), digits(3), digits(4)
        return "", rng.choice([f"+1 ({a}) 555-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}"]), "", kind
    if kind == "IP":
        return "", ".".join(str(rng.randint(0, 255)) for _ in range(4)), "", kind
    if kind == "CARD":
        d = rng.choice("4444545367") + digits(15)
        return "", rng.choice([d, d, d, " ".join(d[k : k + 4] for k in (0, 4, 8, 12)), "-".join(d[k : k + 4] for k in (0, 4, 8, 12))]), "", kind
    form = rng.randint(0, 5)
    name = rng.choice(["token", "key", "secret", "password", "api_key", "pwd", "passwd"])
    if form == 0:
        return "", "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "", kind
    if form == 1:
        return f'{name} = "', pick(hexa, 32, 44), '"', kind
    if form == 2:
        return f"{name}=", pick(hexa, 16, 20), "", kind
    if form == 3:
        return "", "sk-" + pick(lower + lower.upper() + "0123456789", 20, 36), "", kind
    if form == 4:
        return "", pick(hexa, 32, 40), "", kind
    return f"{name}: ", pick(lower + lower.upper() + "0123456789", 16, 28), "", kind


def _harmless(rng: random.Random, words: list[str]) -> str:
    n, w = rng.randint(0, 9999), rng.choice(words)
    return rng.choice([f"{n % 10}.{n % 7}.", f"{n % 10}.{n % 7}", str(n), f"{n % 60}%", f"version {n % 10}.", "token", "password", "key =", f"{w}%%%", f"{w}###", f"{w}&&&", f"{w}***", f"{w}$$$", "|", f"{w.upper()}!!", f"{w.upper()}", f"{w}-{w}", f"({w})", f'"{w}"', f"{n % 24}:{n % 60:02d}", f"{1900 + n % 130}", f"{n % 28 + 1}/{n % 12 + 1}", f"{w}{w}{w}", f"{w.upper()} {w.upper()} {w.upper()}", "CC BY-NC 4.0.", f"{w}, {w}: {w};", "\n", "\n\n", f"{n},{n % 100:02d}"])


def labelled_windows(lines: list[str], n: int = TRAIN_WINDOWS, length: int = TRAIN_LENGTH, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """ids, gold (n, length): lines with labelled values set between their words."""
    rng = random.Random(seed)
    clean = [line.split(" ") for line in lines if line.strip() and not any(sum(c.isdigit() for c in w) > 3 or "@" in w or "=" in w for w in line.split())]
    clean = clean or [["plain", "words", "only."]]
    words = sorted({w for line in clean for w in line if w.isalpha()}) or ["word"]
    ids, gold = np.zeros((n, length), np.uint8), np.zeros((n, length), np.int64)
    for row in range(n):
        text, kinds = "", []
        while len(text) < length + 60:
            line = rng.choice(clean)
            start = rng.randint(0, max(0, len(line) - 4))
            some = " ".join(line[start : start + rng.randint(1, 12)])
            style = rng.random()
            some = some.upper() if style < 0.08 else "!! ".join(some.upper().split(" ")) + "!!" if style < 0.12 else some
            text += some + rng.choice([" ", " ", " ", "\n"])
            kinds += [0] * (len(text) - len(kinds))
            draw = rng.random()
            if draw < 0.4:
                before, value, after, kind = _value(rng, words)
                for part, k in ((before, 0), (value, KINDS.index(kind)), (after + rng.choice(["", "", "", "", ",", ".", ";", "###", "$$$", "&&&", "%%%", " |"]), 0)):
                    text += part
                    kinds += [k] * len(part)
            elif draw < 0.75:
                text += _harmless(rng, words)
            text += rng.choice([" ", " ", " ", " ", "\n"])
            kinds += [0] * (len(text) - len(kinds))
        shift = rng.randint(0, 55)
        if rng.random() < 0.15:
            cut = rng.randint(20, length - 1)
            text, kinds = text[shift : shift + cut], kinds[shift : shift + cut]
        else:
            text, kinds = text[shift : shift + length], kinds[shift : shift + length]
        ids[row, : len(text)] = encode(text)
        gold[row, : len(text)] = kinds
    return ids, gold


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best label paths (T, B) for scores (T, L, B)."""
    steps, n, batch = scores.shape
    best, come = scores[0].copy(), np.empty((steps, n, batch), np.int8)
    for t in range(1, steps):
        reach = best[:, None, :] + moves[:, :, None]
        come[t] = reach.argmax(axis=0)
        best = reach.max(axis=0) + scores[t]
    path = np.empty((steps, batch), np.int64)
    path[-1] = best.argmax(axis=0)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = come[t][path[t], np.arange(batch)]
    return path


def _gains(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, float]:
    """(gain, leave): what a step of another kind can gain at most over O at that step, moves into it included (none at
    the first step), and what returning to O can give back at most, once for each run of other kinds."""
    stay = moves[0, 0]
    enter = moves.max(axis=0)[1:] - stay
    gain = np.empty((len(scores), scores.shape[2]), scores.dtype)
    gain[0] = scores[0, 1:].max(axis=0)
    if len(scores) > 1:
        gain[1:] = (scores[1:, 1:] + enter[:, None]).max(axis=1)
    gain -= scores[:, 0]
    return gain, max(0.0, float((moves[1:, 0] - stay).max()))


def surely_clear(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """For each window whether no path can beat all O."""
    gain, leave = _gains(scores, moves)
    return gain.max(axis=0) < -leave - 1e-3


def _open(gain: np.ndarray, leave: float) -> np.ndarray:
    """(T, B): False where every best path says O.

    A run of other kinds in a best path gains at least 0 over O, so no step outside all stretches whose gains add up to
    -leave is in one.  The best stretch that holds a step joins the best that ends there and the best that starts there.
    """
    gain = gain.astype(np.float64)
    until, since = gain.copy(), gain.copy()
    for t in range(1, len(gain)):
        until[t] += np.maximum(until[t - 1], 0)
    for t in range(len(gain) - 2, -1, -1):
        since[t] += np.maximum(since[t + 1], 0)
    return until + since - gain >= -leave - 1e-3


def best_paths(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The paths of ``viterbi``, which is run on the stretches where a best path may leave O only."""
    steps, kinds, batch = scores.shape
    path = np.zeros((steps, batch), np.int8)
    mask = np.zeros((batch, steps + 2), np.int8)
    mask[:, 1:-1] = _open(*_gains(scores, moves)).T
    edges = np.diff(mask, axis=1)
    (row, start), end = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
    length = end - start
    order = np.argsort(length, kind="stable")
    for k in range(0, len(order), 256):
        some = order[k : k + 256]
        size = int(length[some].max()) + 1
        # set to the right; what lies before is O, and so is the step after, unless the window ends there
        at = end[some] - size + np.arange(size)[:, None]
        inside = at >= start[some]
        part = scores[np.maximum(at, 0), :, row[some]].transpose(0, 2, 1).copy()
        part = np.where(inside[:, None], part, np.where(np.arange(kinds) == 0, 0, -1e9)[:, None]).astype(np.float64)
        first = np.nonzero(start[some] == 0)[0]
        part[size - length[some][first], :, first] -= moves[0]
        part[-1] += np.where(end[some] < steps, moves[:, :1], 0)
        found = viterbi(part, moves.astype(np.float64))
        path[at[inside], np.broadcast_to(row[some], at.shape)[inside]] = found[inside]
    return path


def decode(m: Model, ids: np.ndarray) -> np.ndarray:
    """Labels (T, B); ids (T, B)."""
    scores = emissions(m, ids)
    path = np.zeros(ids.shape, np.int8)
    open_ = np.nonzero(~surely_clear(scores, m.moves))[0]
    if len(open_):
        path[:, open_] = best_paths(np.ascontiguousarray(scores[:, :, open_]), m.moves)
    return path


def _reconcile(windows: list[tuple[int, np.ndarray]], length: int) -> np.ndarray:
    """Labels of a document from the labels of its windows (start, labels), in order."""
    out = np.zeros(length, np.int8)
    for k, (start, labels) in enumerate(windows):
        begin = start
        if k:
            before_start, before = windows[k - 1]
            end = min(before_start + len(before), start + len(labels))
            old, new = before[start - before_start : end - before_start], labels[: end - start]
            middle = len(old) // 2
            for same in ((old == 0) & (new == 0), old == new):
                if same.any():
                    at = np.nonzero(same)[0]
                    middle = int(at[np.abs(at - len(old) // 2).argmin()])
                    break
            begin = start + middle
        out[begin : start + len(labels)] = labels[begin - start :]
    return out


def _passes_check(digits: str) -> bool:
    """Whether the last digit is the check digit (mod 10) of those before it."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def cards(value: str) -> list[tuple[int, int]]:
    """Card numbers in a run of digits and separators: from the left the longest row of digit groups with 13 to 19 digits and a right check digit."""
    groups = [(g.start(), g.end()) for g in _DIGITS.finditer(value)]
    found, k = [], 0
    while k < len(groups):
        best, digits = None, ""
        for j in range(k, len(groups)):
            digits += value[slice(*groups[j])]
            if len(digits) > 19:
                break
            if len(digits) >= 13 and _passes_check(digits):
                best = j
        if best is None:
            k += 1
        else:
            found.append((groups[k][0], groups[best][1]))
            k = best + 1
    return found


def verified(value: str, kind: str) -> list[tuple[int, int]]:
    """The parts of a run that are what its kind is by definition."""
    if kind == "CARD":
        return cards(value)
    if kind == "IP":
        numbers = [int(g) for g in _DIGITS.findall(value)]
        return [(0, len(value))] if len(numbers) == 4 and max(numbers) < 256 else []
    real = "@" in value if kind == "EMAIL" else bool(_DIGITS.search(value)) if kind == "PHONE" else True
    return [(0, len(value))] if real else []


def spans(labels: np.ndarray, text: str) -> list[tuple[int, int, str]]:
    if not labels.any():
        return []
    edges = np.nonzero(np.diff(np.r_[0, labels, 0]))[0]
    runs = [(int(a), int(b), KINDS[labels[a]]) for a, b in zip(edges[:-1], edges[1:]) if labels[a]]
    return [(a + x, a + y, kind) for a, b, kind in runs for x, y in verified(text[a:b], kind)]


def find(m: Model, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of each text, in characters."""
    encoded = [encode(t) for t in texts]
    tasks: dict[int, list[tuple[int, int]]] = {}
    for k, ids in enumerate(encoded):
        for start in range(0, max(1, len(ids) - OVERLAP), WINDOW - OVERLAP):
            if len(ids):
                size = min(WINDOW, len(ids) - start)
                tasks.setdefault(-(-size // ROUND) * ROUND, []).append((k, start))
    marked: dict[int, dict[int, np.ndarray]] = {}
    for size, places in tasks.items():
        for at in range(0, len(places), BATCH):
            some = places[at : at + BATCH]
            ids = np.zeros((len(some), size), np.uint8)
            for row, (k, start) in enumerate(some):
                part = encoded[k][start : start + size]
                ids[row, : len(part)] = part
            labels = decode(m, np.ascontiguousarray(ids.T)).T
            for row in np.nonzero(labels.any(axis=1))[0]:
                k, start = some[row]
                marked.setdefault(k, {})[start] = labels[row]
    result: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for k, by_start in marked.items():
        n = len(encoded[k])
        starts = range(0, max(1, n - OVERLAP), WINDOW - OVERLAP)
        windows = [(s, by_start[s][: min(WINDOW, n - s)] if s in by_start else np.zeros(min(WINDOW, n - s), np.int8)) for s in starts]
        result[k] = spans(_reconcile(windows, n), texts[k])
    return result


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    pieces, at = [], 0
    for a, b, kind in found:
        pieces += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(pieces) + text[at:]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, steps: int = STEPS) -> Model:
    """Train on the lines of the train_docs documents with the least hash of their ids."""
    rows = project(docs, doc_id=("doc_id", "long"), text=("text", "string")).where("text is not null")
    rows = bounded_sample(rows, docs.count(), train_docs, "doc_id")
    lines = sorted(line for r in rows.collect() for line in r["text"].split("\n"))
    return train(*labelled_windows(lines), steps=steps)


def mark(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, n_spans, spans) for each row: text with [KIND] in place of each span; spans as start, end, kind in characters of the original."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 1000):
                some = pdf.iloc[k : k + 1000]
                texts = [t if isinstance(t, str) else None for t in some["text"]]
                each = list(dict.fromkeys(t or "" for t in texts))
                known = dict(zip(each, find(shared.value, each)))
                found = [known[t or ""] for t in texts]
                yield pd.DataFrame({
                    "doc_id": some["doc_id"].to_numpy(),
                    "text": [t if t is None else redact(t, f) for t, f in zip(texts, found)],
                    "n_spans": np.array([len(f) for f in found], np.int32),
                    "spans": [[{"start": a, "end": b, "kind": c} for a, b, c in f] for f in found],
                })

    rows = project(docs, doc_id=("doc_id", "long"), text=("text", "string")).where("doc_id is not null")
    return rows.mapInPandas(look, "doc_id long, text string, n_spans int, spans array<struct<start: int, end: int, kind: string>>")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mark(docs, fit(docs))
