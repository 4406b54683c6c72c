"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Method. Three patterns give the base findings (assign, access, hex). A candidate is a run of at least ``LEAST`` characters
of ``[A-Za-z0-9+/_.=-]`` outside them; of a run that they cover in part, each remainder is one. It is read in pieces of at most ``FRAME`` characters: overlapping windows over the whole
run, and its parts between ``/``, ``.`` and ``=``; the largest probability counts. The network reads the characters before a
piece, the piece and the characters after it: one convolution (numpy, a table per offset and character class), pooled over the
three parts, and a logistic output. It learns from labelled findings: all pieces of the corpus, labelled by the base patterns
(a third in the context of another, so the value alone must do), and a fixed number of generated ones, secrets of common
shapes and harmless look-alikes. A hash of the value holds a fifth out.

A start is fitted on a sample of the pieces. Each of ``passes`` then reads every piece: the gradient of the loss over the whole corpus
takes the place of the sample's at the start, and the fit goes on from there (a communication-efficient surrogate: the sample gives the
curvature only, and where the fit stands still the gradient over the whole corpus is zero). Of the steps along the way, the one with the
least loss over all held-out pieces is taken. These also calibrate the output (scale and shift of its log odds) and
set the threshold: the largest probability that still finds the share ``recall`` of the held-out labelled secrets. Candidates at
or over it become findings of kind ``net``; base findings always stay.

In the loss every kind of piece (secret, word, other) has the weight it has in the sample. Secrets count once per distinct window, all else as often as it occurs.

Bounds. The sample has at most ``sample`` (2,000) distinct pieces of a kind, first by hash. A task sends that, its secrets, a gradient (50 kB) or counts
(400 kB); these are added up in ``GROUPS`` parts. The model is about 40 kB. Texts are read whole, each in its own task; only windows of secrets are shuffled, and held in a stored table.

Results. ``findings``: key and an array of (kind, start, end) in code points, end exclusive, by start and kind.
``redact``: the documents with every finding replaced by ``[kind]``; overlapping ones by the first's kind.

Edge cases. Null or empty text: no findings. Repeated rows are scanned alike. Without candidates in the corpus the
generated findings alone train the network. Empty tables give empty results. Extra columns pass through ``redact``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faceoff.llm import text as T
from faceoff.llm.scratch import Scratch

#: Fixed patterns and their least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_VALUE, ACCESS_SIZE, HEX_SIZE = 6, 20, 24
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "net")

LEAST = 8
BEFORE, VALUE, TAIL, AFTER = 24, 28, 12, 8
FRAME, STEP = VALUE + TAIL, 16
CHUNK = 4096
SPAN = BEFORE + VALUE + TAIL + AFTER
WIDTH, FILTERS = 5, 16
EPOCHS, BATCH, RATE = 10, 64, 0.01
RECALL = 0.98
#: Passes over the corpus; epochs and rate of the fit after each; how strongly it is held to where it began; steps that are tried.
PASSES, NEXT_EPOCHS, NEXT_RATE, HOLD = 1, 4, 0.002, 0.05
#: How strongly scale and shift are drawn to 1 and 0.
DRAWN = 1e-4
STEPS = (0.25, 0.5, 1.0)
#: Raw outputs are counted in steps of 1 / FINE between -REACH and REACH; sums of tasks meet in GROUPS parts.
FINE, REACH, GROUPS = 128, 32, 16


def _flags(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_LOW, _UP, _DIGITS = (bytes(range(a, z)) for a, z in ((97, 123), (65, 91), (48, 58)))
HEX, RUN = _flags(_DIGITS + b"abcdef"), _flags(_LOW + _UP + _DIGITS + b"+/_.=-")
CUT, PLAIN = _flags(b"/.="), _flags(_LOW + _UP + b".")
#: Character classes: 0 outside the text, letters by case, digits together, some symbols, the rest.
CLASS = np.full(256, 71, np.uint8)
CLASS[list(_LOW)] = np.arange(1, 27)
CLASS[list(_UP)] = np.arange(27, 53)
CLASS[list(_DIGITS)] = 53
for _i, _c in enumerate(b"=:\"'-_./+@ \n#$%&|"):
    CLASS[_c] = 54 + _i
CLASS[128:] = 72
CLASSES = 73


@dataclass(frozen=True)
class SecretModel:
    """Weights of the network, calibration and threshold."""

    conv: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5


def base_findings(block: T.Block) -> list[tuple[int, int, int, int]]:
    """(document, kind, start, end) in bytes of the block, by document, start and kind."""
    raw, out = block.data.tobytes(), []
    low = T.LOWER[block.data].tobytes()
    hinted: set[int] = set()
    for hint in HINTS:
        at = low.find(hint)
        while at >= 0:
            i = int(np.searchsorted(block.offsets, at, "right")) - 1
            hinted.add(i)
            at = low.find(hint, max(at + 1, int(block.offsets[i + 1])))
    for i in hinted:
        a, z = int(block.offsets[i]), int(block.offsets[i + 1])
        out += [(i, 0, a + m.start(), a + m.end()) for m in ASSIGN.finditer(raw[a:z]) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    at, akia = raw.find(b"AKIA"), set()
    while at >= 0:
        akia.add(int(np.searchsorted(block.offsets, at, "right")) - 1)
        at = raw.find(b"AKIA", at + 1)
    for i in akia:
        a, z = int(block.offsets[i]), int(block.offsets[i + 1])
        out += [(i, 1, a + m.start(), a + m.end()) for m in ACCESS.finditer(raw[a:z]) if m.end() - m.start() >= ACCESS_SIZE]
    s, e = T.runs(block.data, block.offsets, HEX[block.data])
    long = e - s >= HEX_SIZE
    doc = np.searchsorted(block.offsets, s[long], "right") - 1
    out += list(zip(doc.tolist(), [2] * len(doc), s[long].tolist(), e[long].tolist(), strict=True))
    return sorted(out, key=lambda f: (f[0], f[2], f[1]))


def candidates(block: T.Block, found: list[tuple[int, int, int, int]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every candidate: a run, or what findings leave of it."""
    inside = RUN[block.data]
    for _, _, a, z in found:
        inside[a:z] = False
    s, e = T.runs(block.data, block.offsets, inside)
    long = e - s >= LEAST
    return s[long], e[long]


def pieces(block: T.Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and candidate of the pieces that are scored: together they hold every character of every candidate."""
    edge = np.zeros(len(block.data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    s, e = T.runs(block.data, block.offsets, (np.cumsum(edge[:-1]) > 0) & ~CUT[block.data])
    own = np.searchsorted(starts, s, "right") - 1
    part = (e - s >= LEAST) & (e - s < (ends - starts)[own]) if len(s) else np.zeros(0, bool)
    s, e, own = np.concatenate([starts, s[part]]), np.concatenate([ends, e[part]]), np.concatenate([np.arange(len(starts)), own[part]])
    count = 1 + np.maximum(0, -((FRAME - (e - s)) // STEP))
    at = np.repeat(np.arange(len(s)), count)
    step = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    first = np.maximum(s[at], np.minimum(s[at] + STEP * step, e[at] - FRAME))
    return first, np.minimum(first + FRAME, e[at]), own[at]


def windows_of(block: T.Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Character classes around and in each piece; one longer than ``FRAME`` gives its first and last characters."""
    doc = np.searchsorted(block.offsets, starts, "right") - 1
    lo, hi = block.offsets[doc][:, None], block.offsets[doc + 1][:, None]
    before = starts[:, None] + np.arange(-BEFORE, 0)
    head = starts[:, None] + np.arange(VALUE)
    tail = ends[:, None] + np.arange(-TAIL, 0)
    after = ends[:, None] + np.arange(AFTER)
    s, e = starts[:, None], ends[:, None]
    at = np.concatenate([before, head, tail, after], axis=1)
    ok = np.concatenate([before >= lo, head < e, (tail >= s + VALUE), after < hi], axis=1)
    return np.where(ok, CLASS[block.data[np.clip(at, 0, max(len(block.data) - 1, 0))]], 0).astype(np.uint8)


_PARTS = ((0, BEFORE), (BEFORE, BEFORE + VALUE + TAIL - WIDTH + 1), (BEFORE + VALUE + TAIL - WIDTH + 1, SPAN - WIDTH + 1))


def _forward(x: np.ndarray, conv: np.ndarray, shift: np.ndarray):
    steps = SPAN - WIDTH + 1
    z = np.broadcast_to(shift, (len(x), steps, FILTERS)).copy()
    for k in range(WIDTH):
        z += conv[k][x[:, k:k + steps]]
    act = np.maximum(z, 0)
    peaks = [a + act[:, a:b].argmax(1) for a, b in _PARTS]
    pooled = np.concatenate([np.take_along_axis(act, p[:, None], 1)[:, 0] for p in peaks] + [act[:, slice(*_PARTS[1])].mean(1)], axis=1)
    return act, peaks, pooled


def logits(x: np.ndarray, model: SecretModel) -> np.ndarray:
    """The network's output; as ``_forward``, with one table per two offsets and no place of the peaks."""
    conv, steps = model.conv.astype(np.float32), SPAN - WIDTH + 1
    pairs = [(conv[k][:, None] + conv[k + 1][None]).reshape(-1, FILTERS) for k in (0, 2)]
    last, out = conv[4] + model.shift.astype(np.float32), np.zeros(len(x))
    for lo in range(0, len(x), 128):                # small enough for the cache
        part = x[lo:lo + 128].T.astype(np.int64)
        both = part[:-1] * CLASSES + part[1:]
        z = np.take(pairs[0], both[:steps], axis=0)
        z += np.take(pairs[1], both[2:steps + 2], axis=0)
        z += np.take(last, part[4:], axis=0)
        np.maximum(z, 0, out=z)
        pooled = [z[a:b].max(0) for a, b in _PARTS] + [z[slice(*_PARTS[1])].mean(0)]
        out[lo:lo + 128] = np.concatenate(pooled, axis=1) @ model.out + model.bias
    return out


def probabilities(x: np.ndarray, model: SecretModel) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.scale * logits(x, model) + model.offset, -40, 40)))


def scores(block: T.Block, starts: np.ndarray, ends: np.ndarray, model: SecretModel) -> np.ndarray:
    """The largest probability among the pieces of each candidate."""
    s, e, own = pieces(block, starts, ends)
    out = np.zeros(len(starts))
    for lo in range(0, len(s), CHUNK):
        hi = lo + CHUNK
        np.maximum.at(out, own[lo:hi], probabilities(windows_of(block, s[lo:hi], e[lo:hi]), model))
    return out


def gradient(x: np.ndarray, y: float | np.ndarray, model: SecretModel) -> tuple[float, np.ndarray]:
    """Sums over windows of the log loss and of its gradient by the weights, laid out as in ``_flat``."""
    conv, steps = model.conv.astype(np.float32), SPAN - WIDTH + 1
    pairs = [(conv[k][:, None] + conv[k + 1][None]).reshape(-1, FILTERS) for k in (0, 2)]
    last, (a, b) = conv[4] + model.shift.astype(np.float32), _PARTS[1]
    y = np.broadcast_to(np.asarray(y, float), len(x))
    by_pair, by_last, shift = np.zeros((2, FILTERS, CLASSES**2)), np.zeros((FILTERS, CLASSES)), np.zeros(FILTERS)
    out, bias, loss = np.zeros(4 * FILTERS), 0.0, 0.0
    for lo in range(0, len(x), 512):
        part = np.ascontiguousarray(x[lo:lo + 512].T).astype(np.int64)
        both, n = part[:-1] * CLASSES + part[1:], part.shape[1]
        z = np.take(pairs[0], both[:steps], axis=0)
        z += np.take(pairs[1], both[2:steps + 2], axis=0)
        z += np.take(last, part[4:], axis=0)
        np.maximum(z, 0, out=z)
        peaks, tops = np.empty((3, n, FILTERS), np.int64), np.empty((3, n, FILTERS), np.float32)
        for (i, j), peak, top in zip(_PARTS, peaks, tops, strict=True):
            peak[:], top[:] = i, z[i]
            for place in range(i + 1, j):
                np.copyto(peak, place, where=z[place] > top)
                np.maximum(top, z[place], out=top)
        tops = tops.transpose(1, 0, 2).reshape(n, -1)
        pooled = np.concatenate([tops, z[a:b].mean(0)], axis=1).astype(float)
        raw, yb = (pooled * model.out).sum(1) + model.bias, y[lo:lo + 512]
        d = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - yb
        loss += float((np.logaddexp(0, raw) - yb * raw).sum())
        out += (pooled * d[:, None]).sum(0)
        bias += float(d.sum())
        by_out = d[:, None] * model.out
        each, at = (by_out[:, :3 * FILTERS] * (tops > 0)).ravel(), peaks.transpose(1, 0, 2).reshape(n, -1) * n + np.arange(n)[:, None]
        f = np.tile(np.arange(FILTERS), 3 * n)
        shift += np.bincount(f, each, FILTERS)
        for k in (0, 1):
            by_pair[k] += np.bincount(f * CLASSES**2 + both.ravel()[(at + 2 * k * n).ravel()], each, FILTERS * CLASSES**2).reshape(FILTERS, -1)
        by_last += np.bincount(f * CLASSES + part.ravel()[(at + 4 * n).ravel()], each, FILTERS * CLASSES).reshape(FILTERS, -1)
        mean = (z[a:b] > 0) * (by_out[:, 3 * FILTERS:] / (b - a)).astype(np.float32)
        filled = ((both[a:b] > 0) | (both[a + 2:b + 2] > 0) | (part[a + 4:b + 4] > 0)).ravel()
        mean = mean.reshape(-1, FILTERS).astype(float)
        empty, mean = mean[~filled].sum(0), np.ascontiguousarray(mean[filled].T)
        shift += mean.sum(1) + empty                        # all outside the text: class 0 throughout
        by_pair[:, :, 0] += empty
        by_last[:, 0] += empty
        ids = [v.ravel()[filled] for v in (both[a:b], both[a + 2:b + 2], part[a + 4:b + 4])]
        for j in range(FILTERS):
            for k in (0, 1):
                by_pair[k, j] += np.bincount(ids[k], mean[j], CLASSES**2)
            by_last[j] += np.bincount(ids[2], mean[j], CLASSES)
    square = by_pair.reshape(2, FILTERS, CLASSES, CLASSES)
    by_class = np.stack([square[0].sum(2), square[0].sum(1), square[1].sum(2), square[1].sum(1), by_last]).transpose(0, 2, 1)
    return loss, np.concatenate([by_class.ravel(), shift, out, [bias]])


def _flat(model: SecretModel) -> np.ndarray:
    return np.concatenate([model.conv.ravel(), model.shift, model.out, [model.bias]])


def _shaped(flat: np.ndarray) -> SecretModel:
    conv, shift, out, bias = np.split(flat, np.cumsum([WIDTH * CLASSES * FILTERS, FILTERS, 4 * FILTERS]))
    return SecretModel(conv.reshape(WIDTH, CLASSES, FILTERS), shift, out, float(bias[0]))


def held_out(x: np.ndarray) -> np.ndarray:
    """Whether a window is held out. A value's pieces are on one side whatever surrounds them: a hash of its characters decides."""
    return _value_hash(x) % np.uint64(5) == 0


def _value_hash(x: np.ndarray) -> np.ndarray:
    return _hash(x[:, BEFORE:SPAN - AFTER])


def _hash(x: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes, whose number is a multiple of eight."""
    words = np.ascontiguousarray(x).view(np.uint64)
    return T.mix((words * T.factors(words.shape[1], 9)).sum(1, dtype=np.uint64))


def _descend(model: SecretModel, x: np.ndarray, y: np.ndarray, epochs: int, rate: float, rng: np.random.Generator,
             pull: np.ndarray | None = None) -> SecretModel:
    """Adam over the windows; ``pull`` is added to every gradient and the weights are then held to where they began."""
    w = {"conv": model.conv, "shift": model.shift, "out": model.out, "bias": np.array([model.bias])}
    if pull is not None:
        began, more = w, _shaped(pull)
        extra = {"conv": more.conv, "shift": more.shift, "out": more.out, "bias": np.array([more.bias])}
    first, second = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    own, steps, t = np.arange(len(y)), SPAN - WIDTH + 1, 0
    for _ in range(epochs):
        for lo in range(0, len(own), BATCH):
            at = own[lo:lo + BATCH]
            xb, yb = x[at], y[at]
            act, peaks, pooled = _forward(xb, w["conv"], w["shift"])
            p = 1 / (1 + np.exp(-np.clip(pooled @ w["out"] + w["bias"], -40, 40)))
            d = (p - yb) / len(yb)
            g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
            dp = d[:, None] * w["out"]
            dz = np.zeros_like(act)
            for i, peak in enumerate(peaks):
                np.put_along_axis(dz, peak[:, None], np.take_along_axis(dz, peak[:, None], 1) + dp[:, None, i * FILTERS:(i + 1) * FILTERS], 1)
            a, b = _PARTS[1]
            dz[:, a:b] += dp[:, None, 3 * FILTERS:] / (b - a)
            dz *= act > 0
            g["shift"] = dz.sum((0, 1))
            g["conv"] = np.zeros_like(w["conv"])
            flat = dz.reshape(-1, FILTERS)
            for k in range(WIDTH):
                hot = np.zeros((CLASSES, flat.shape[0]), np.float32)
                hot[xb[:, k:k + steps].ravel(), np.arange(flat.shape[0])] = 1
                g["conv"][k] = hot @ flat
            if pull is not None:
                g = {k: g[k] + extra[k] + HOLD * (w[k] - began[k]) for k in g}
            t += 1
            for key in w:
                first[key] = .9 * first[key] + .1 * g[key]
                second[key] = .999 * second[key] + .001 * g[key] ** 2
                w = {**w, key: w[key] - rate * (first[key] / (1 - .9**t)) / (np.sqrt(second[key] / (1 - .999**t)) + 1e-8)}
        own = rng.permutation(own)
    return SecretModel(w["conv"], w["shift"], w["out"], float(w["bias"][0]))


def _calibrated(model: SecretModel, raw: np.ndarray, y: np.ndarray, weight: np.ndarray, recall: float) -> SecretModel:
    """Scale and shift of the log odds, and the threshold, from weighted raw outputs on values not fitted on."""
    scale, offset, share = 1.0, 0.0, weight / max(weight.sum(), 1e-12)
    for _ in range(50):                     # Newton's steps, drawn to scale 1 and shift 0 a little
        p = 1 / (1 + np.exp(-np.clip(scale * raw + offset, -40, 40)))
        slope, curve = (p - y) * share, p * (1 - p) * share
        g = np.array([(slope * raw).sum() + DRAWN * (scale - 1), slope.sum() + DRAWN * offset])
        h = np.array([[(curve * raw**2).sum(), (curve * raw).sum()], [(curve * raw).sum(), curve.sum()]]) + DRAWN * np.eye(2)
        move = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        scale, offset = max(scale - float(move[0]), 0.05), offset - float(move[1])
    good = (y == 1) & (weight > 0)
    order = np.argsort(raw[good], kind="stable")
    found, upto, threshold = raw[good][order], np.cumsum(weight[good][order]), 1.0
    if len(found):
        at = min(int(np.searchsorted(upto, (1 - recall) * upto[-1], "right")), len(found) - 1)
        threshold = float(1 / (1 + np.exp(-np.clip(scale * found[at] + offset, -40, 40))))
    return SecretModel(model.conv, model.shift, model.out, model.bias, scale, offset, threshold)


def _start(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> SecretModel:
    conv = rng.normal(0, .15, (WIDTH, CLASSES, FILTERS))
    conv[:, 0] = 0
    begin = SecretModel(conv, np.zeros(FILTERS), rng.normal(0, .2, 4 * FILTERS), 0.0)
    order = rng.permutation(len(y))
    return _descend(begin, x[order], y[order], EPOCHS, RATE, rng)


def train(x: np.ndarray, y: np.ndarray, recall: float = RECALL, seed: int = 7) -> SecretModel:
    """Fit on about four fifths of the values, calibrate and place the threshold on values not fitted on."""
    held = held_out(x)
    model = _start(x[~held], y[~held], np.random.default_rng(seed))
    return _calibrated(model, logits(x[held], model), y[held], np.ones(int(held.sum())), recall)


def generated(n: int, seed: int = 11) -> tuple[list[str], list[int]]:
    """``n`` short texts with one candidate each, secrets and harmless look-alikes in turn."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    secrets = [lambda: pick(low + up + dig, rng.integers(20, 64)), lambda: pick("abcdef" + dig, rng.integers(32, 64)),
               lambda: pick(low + up + dig + "+/", rng.integers(24, 60)) + "=", lambda: pick(up + dig, rng.integers(20, 40)),
               lambda: "sk_live_" + pick(low + up + dig, 28), lambda: pick(low + dig + "-_", rng.integers(24, 48)),
               lambda: pick(low + up, rng.integers(20, 48)), lambda: pick(low + up + dig, rng.integers(10, 20))]
    syllable = lambda: pick("bcdfghklmnprstvw", 1) + pick("aeiou", 1) + pick("lmnrst", rng.integers(2))
    word = lambda: "".join(syllable() for _ in range(rng.integers(1, 4)))[:7]
    harmless = [lambda: f"{word()}{rng.integers(99)}.{word()}.{word()}.com", lambda: f"{word()}_{word()}_{word()}_{rng.integers(99)}",
                lambda: "".join(f"/{word()}" for _ in range(rng.integers(2, 12))) + f"{rng.integers(9)}.{word()[:3]}",
                lambda: f"{word()}-{word()}-{word()}-{rng.integers(2100)}",
                lambda: f"{rng.integers(2000, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 28)}T{rng.integers(10, 23)}.{word()}",
                lambda: f"{word()}{word()}{word()}{rng.integers(9)}", lambda: f"{word()}{word()}{word()}", lambda: f"{word().title()}{word().title()}{word().title()}",
                lambda: pick("-=._", 1) * int(rng.integers(8, 80)), lambda: pick(dig, rng.integers(8, 14))]
    lead = ["key = ", "auth: ", "bearer ", 'cred="', "sig=", "pem_key ", ""]
    texts, y = [], []
    for i in range(n):
        kinds = secrets if i % 2 else harmless
        value = kinds[rng.integers(len(kinds))]()
        while len(value) < LEAST:
            value += word()
        front = rng.choice(lead) if i % 2 or rng.random() < .2 else ""
        texts.append(f"{word()} {word()} {word()} {front}{value} {word()} {word()}")
        y.append(i % 2)
    return texts, y


WORD, OTHER, SECRET, GENERATED = 0, 1, 2, 3


def _label(block: T.Block):
    """Windows and label of the pieces of a block; pieces that a base finding covers by less than a half have none."""
    runs, ends = candidates(block)
    s, e, own = pieces(block, runs, ends)
    most, touched = np.zeros(len(s), np.int64), np.zeros(len(s), bool)
    order = np.argsort(s, kind="stable")
    ordered = s[order]
    for _, kind, a, z in base_findings(block):
        lo, hi = np.searchsorted(ordered, (a - FRAME, z))
        near = order[lo:hi]
        touched[near] |= e[near] > a
        if kind == 0:                                       # the name before the value is no secret
            a = max(a, int(runs[max(0, np.searchsorted(runs, z) - 1)])) if len(runs) else a
        most[near] = np.maximum(most[near], np.minimum(e[near], z) - np.maximum(s[near], a))
    plain = np.concatenate([[0], np.cumsum(PLAIN[block.data])])
    y = np.where(2 * most >= e - s, SECRET, np.where(plain[e] - plain[s] == e - s, WORD, OTHER))
    good = ~touched | (y == SECRET)
    s, e, y = s[good], e[good], y[good]
    for lo in range(0, len(s), CHUNK):
        yield windows_of(block, s[lo:lo + CHUNK], e[lo:lo + CHUNK]), y[lo:lo + CHUNK]


def _labelled(sample: int):
    """The first words and other harmless pieces by hash, and every secret."""
    def rows(k, h, w):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(T.signed(h)), pa.array([v.tobytes() for v in w], pa.binary())], ["y", "h", "w"])

    def run(batches):
        kept = {k: (np.zeros(0, np.uint64), np.zeros((0, SPAN), np.uint8)) for k in (WORD, OTHER)}
        for batch in batches:
            for block in T.blocks(batch.column("t")):
                for w, y in _label(block):
                    at = np.arange(len(w), dtype=np.int64) * SPAN
                    h = T.hash_spans(w.ravel(), at, at + SPAN)
                    for k, (had, windows) in kept.items():
                        own = y == k
                        if len(had) == sample:
                            own &= h < had[-1]
                        if own.any():
                            low, first = np.unique(np.concatenate([had, h[own]]), return_index=True)
                            kept[k] = low[:sample], np.concatenate([windows, w[own]])[first[:sample]]
                    if (y == SECRET).any():
                        _, first = np.unique(h[y == SECRET], return_index=True)
                        yield rows(SECRET, h[y == SECRET][first], w[y == SECRET][first])
        for k, (h, w) in kept.items():
            yield rows(k, h, w)
    return run


def _exchanged(w: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """A third of the windows, by a hash of the value and what surrounds it, get the surroundings of another."""
    h = _hash(w)
    swap = h % np.uint64(3) == 1
    if len(contexts):
        w, other = w.copy(), contexts[((h[swap] >> np.uint64(20)) % np.uint64(len(contexts))).astype(np.int64)]
        w[swap, :BEFORE], w[swap, -AFTER:] = other[:, :BEFORE], other[:, -AFTER:]
    return w


def _windows(batches):
    """Windows and labels of the texts, or of stored secrets."""
    for batch in batches:
        if batch.schema.names == ["w"]:
            if len(batch):
                yield np.frombuffer(b"".join(batch.column("w").to_pylist()), np.uint8).reshape(-1, SPAN), np.full(len(batch), SECRET)
        else:
            for block in T.blocks(batch.column("t")):
                for w, y in _label(block):
                    harmless = y != SECRET                  # secrets are stored
                    yield w[harmless], y[harmless]


def _gradients(model: SecretModel, contexts: np.ndarray):
    """Per kind: pieces that are learned from, and their loss and gradient in one row of numbers."""
    def run(batches):
        total = np.zeros((3, 2 + len(_flat(model))))
        for w, y in _windows(batches):
            own = ~held_out(w) if len(w) else np.zeros(0, bool)
            w, y = w[own], y[own]
            if len(w):
                w = _exchanged(w, contexts)
            for k in set(y.tolist()):
                loss, g = gradient(w[y == k], float(k == SECRET), model)
                total[k] += np.concatenate([[(y == k).sum(), loss], g])
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})
    return run


def _counts(models: list[SecretModel], contexts: np.ndarray):
    """Held-out pieces per model, kind and step of the raw output."""
    def run(batches):
        total = np.zeros((len(models), 3, 2 * REACH * FINE))
        for w, y in _windows(batches):
            held = held_out(w) if len(w) else np.zeros(0, bool)
            w, y = w[held], y[held]
            if len(w):
                w = _exchanged(w, contexts)
                for m, model in enumerate(models):
                    at = np.clip(np.floor((logits(w, model) + REACH) * FINE), 0, 2 * REACH * FINE - 1).astype(np.int64)
                    total[m] += np.bincount(y * total.shape[2] + at, minlength=total[m].size).reshape(3, -1)
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})
    return run


def _added(rows: DataFrame, secret: DataFrame, task, shape: tuple[int, ...]) -> np.ndarray:
    """The sums of what ``task`` gives for the texts and for the stored secrets."""
    def add(part: pa.Table) -> pa.Table:
        return pa.table({"v": pa.array([sum(np.frombuffer(v) for v in part.column("v").to_pylist()).tobytes()], pa.binary())})

    parts = rows.mapInArrow(task, "v binary").unionByName(secret.mapInArrow(task, "v binary"))
    sums = parts.withColumn("g", F.spark_partition_id() % GROUPS).groupBy("g").applyInArrow(lambda t: add(t.select(["v"])), "v binary")
    return sum((np.frombuffer(bytes(r["v"])) for r in sums.collect()), np.zeros(int(np.prod(shape)))).reshape(shape)


def _rounded(v: np.ndarray) -> np.ndarray:
    """To a part in 10^8 of the largest, so that the order of the tasks' sums does not show."""
    most = np.abs(v).max(initial=0.0)
    return v if most == 0 else np.round(v / most, 8) * float(f"{most:.8e}")


def fit(docs: DataFrame, *, text: str = "text", sample: int = 2_000, recall: float = RECALL, generate: int = 3_000, passes: int = PASSES) -> SecretModel:
    """Train on labelled findings of the corpus and generated ones: a start on a sample, then on every piece."""
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.keep(rows.mapInArrow(_labelled(sample), "y int, h long, w binary"))
    # hashes are unsigned in the tasks
    by = F.col("h").bitwiseXOR(F.lit(-2**63))
    got = [r for k in (WORD, OTHER, SECRET) for r in found.where(F.col("y") == k).distinct().orderBy(by, "w").limit(sample).collect()]
    stored = scratch.keep(found.where(F.col("y") == SECRET).select("w").distinct())
    scratch.drop(found)
    secret = {bytes(r["w"]) for r in got if r["y"] == SECRET}
    got = [r for r in got if r["y"] == SECRET or bytes(r["w"]) not in secret]
    x = [np.frombuffer(bytes(r["w"]), np.uint8) for r in got]
    kind = [r["y"] for r in got]
    # a finding's value with the surroundings of another: the context of half of them must not decide
    rng = np.random.default_rng(3)
    mixed = []
    for i in range(0, len(x), 2):
        other, own = x[int(rng.integers(len(x)))], x[i].copy()
        own[:BEFORE], own[-AFTER:] = other[:BEFORE], other[-AFTER:]
        mixed.append(own)
    kind += kind[::2]
    contexts = np.array(x, np.uint8).reshape(-1, SPAN)
    texts, made = generated(generate)
    block = next(T.blocks(pa.array(texts), limit=1 << 30))
    s, e, _ = pieces(block, *candidates(block))
    owner = np.searchsorted(block.offsets, s, "right") - 1
    x = np.array([*x, *mixed, *windows_of(block, s, e)], np.uint8).reshape(-1, SPAN)
    y = np.array([*(k == SECRET for k in kind), *np.array(made)[owner]], float)
    kind = np.array([*kind, *np.full(len(s), GENERATED)])
    held, rng = held_out(x), np.random.default_rng(7)
    model = _start(x[~held], y[~held], rng)
    tried = [model]
    for _ in range(passes):
        whole = _added(rows, stored, _gradients(model, contexts), (3, 2 + len(_flat(model))))
        pull = np.zeros(len(_flat(model)))
        for k in (WORD, OTHER, SECRET):
            mine = ~held & (kind == k)
            if mine.any() and whole[k, 0]:
                pull += mine.sum() * whole[k, 2:] / whole[k, 0] - gradient(x[mine], float(k == SECRET), model)[1]
        after = _descend(model, x[~held], y[~held], NEXT_EPOCHS, NEXT_RATE, rng, _rounded(pull) / max(int((~held).sum()), 1))
        tried = [_shaped((1 - t) * _flat(model) + t * _flat(after)) for t in STEPS]
        model = after
    counts = _added(rows, stored, _counts(tried, contexts), (len(tried), 3, 2 * REACH * FINE))
    scratch.drop(stored)
    # every kind weighs what it weighs in the sample
    own = held & (kind == GENERATED)
    share = np.array([(held & (kind == k)).sum() for k in (WORD, OTHER, SECRET)])
    weight = counts * (share / np.maximum(counts.sum(2), 1))[:, :, None]
    steps = np.arange(2 * REACH * FINE) / FINE - REACH
    best = []
    for m, candidate in enumerate(tried):
        raw = np.concatenate([steps, steps, steps, logits(x[own], candidate)])
        label = np.concatenate([np.repeat([0.0, 0.0, 1.0], len(steps)), y[own]])
        each = np.concatenate([weight[m].ravel(), np.ones(int(own.sum()))])
        fitted = _calibrated(candidate, raw, label, each, recall)
        odds = fitted.scale * raw + fitted.offset
        best.append((float(((np.logaddexp(0, odds) - label * odds) * each).sum()), -m, fitted))
    return min(best, key=lambda b: b[:2])[2]


def _all_findings(block: T.Block, model: SecretModel) -> list[tuple[int, int, int, int]]:
    found = base_findings(block)
    s, e = candidates(block, found)
    if len(s):
        hit = scores(block, s, e, model) >= model.threshold
        doc = np.searchsorted(block.offsets, s[hit], "right") - 1
        found += list(zip(doc.tolist(), [3] * len(doc), s[hit].tolist(), e[hit].tolist(), strict=True))
        found.sort(key=lambda f: (f[0], f[2], f[1]))
    return found


def _scan(model: SecretModel):
    def run(batches):
        for batch in batches:
            for block in T.blocks(batch.column("t")):
                found = _all_findings(block, model)
                point = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
                doc = np.array([f[0] for f in found], np.int64)
                edge = np.searchsorted(doc, np.arange(block.docs + 1)).astype(np.int32)
                base = point[block.offsets[doc]]
                start, end = (point[np.array([f[i] for f in found], np.int64)] - base for i in (2, 3))
                cells = pa.StructArray.from_arrays([pa.array([KINDS[f[1]] for f in found], pa.string()), pa.array(start, pa.int64()),
                                                    pa.array(end, pa.int64())], ["kind", "start", "end"])
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(block.lo, block.docs), pa.ListArray.from_arrays(pa.array(edge), cells)],
                                                 ["k", "findings"])
    return run


def findings(docs: DataFrame, model: SecretModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and findings of every whole text."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    out = rows.mapInArrow(_scan(model), f"k {kind}, findings array<struct<kind: string, start: long, end: long>>")
    return out.withColumnRenamed("k", key)


def _redact(model: SecretModel, text: str):
    def run(batches):
        for batch in batches:
            column = batch.column("_row").field(text)
            texts = []
            for block in T.blocks(column):
                raw, by = block.data.tobytes(), {}
                for i, kind, a, z in _all_findings(block, model):
                    by.setdefault(i, []).append((a, z, kind))
                for i in range(block.docs):
                    if i not in by:
                        texts.append(None)
                        continue
                    at, parts = int(block.offsets[i]), []
                    for a, z, kind in by[i]:
                        if a >= at:
                            parts += [raw[at:a], b"[%s]" % KINDS[kind].encode()]
                        at = max(at, z)
                    texts.append(b"".join([*parts, raw[at:block.offsets[i + 1]]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], ["_row", "out"])
    return run


def redact(docs: DataFrame, model: SecretModel, *, text: str = "text") -> DataFrame:
    """The documents with findings replaced."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    out = rows.mapInArrow(_redact(model, text), StructType().add("_row", docs.schema, False).add("out", "string"))
    return out.select(*[F.coalesce("out", F.col("_row").getField(c)).alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])
