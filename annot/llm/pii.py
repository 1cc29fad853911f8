"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions that finds more.

The base spans come from the contract's patterns. The tagger is trained in numpy from labelled spans: windows of a bounded
sample of documents with their base spans, some of them rewritten in forms that the patterns miss, and windows without
any. It then reads every character of every text in overlapping windows. A window whose best path is outside any kind
throughout (shown by a bound on what transitions can add) ends there; the others are decoded. A span counts in the window
in whose core it begins. Where it touches that window's edge, the text around it is read once more as one window with the
span in its midst, which has the last word. Spans that meet a base span or fail the kind's check of digits are dropped,
base spans stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, seeded

KINDS = ("email", "ip", "card", "phone")
#: The tagger is trained on at most so many documents, those with the lowest seeded hash, and so many windows of them.
FIT_DOCS, FIT_WINDOWS = 6000, 6000
SEED = 23
HIDDEN, TAGS = 6, 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
WINDOW, OVERLAP, FIT_LENGTH = 512, 64, 64
BATCH = 1024
_SYMBOLS = " \n@.-+()_%:/,=\"#[];*'"
_CLASSES = 31 + len(_SYMBOLS)
_class = np.full(128, _CLASSES - 1, np.uint8)
_class[97:123] = np.arange(1, 27)
_class[65:91] = 27
_class[48:58] = 29
for _i, _c in enumerate(_SYMBOLS):
    _class[ord(_c)] = 30 + _i

# The contract's patterns, written so that no long run of characters is read again from each of its places: a match that
# fails from the start of a run fails from within it.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind and end of the base spans, in order."""
    found = []
    found += [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if is_ip(m[0].split("."))]
        for kind, pattern, least, most in ((2, CARD, 12, 19), (3, PHONE, 9, 15)):
            for m in pattern.finditer(text):
                digits = _NOT_DIGIT.sub("", m[0])
                if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                    found.append((m.start(), kind, m.end()))
    return sorted(found)


def char_classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _class[np.minimum(codes, 127)], 28).astype(np.uint8)


# -- Training windows


def rewritten(kind: int, text: str, rng) -> str:
    """The text of a span in a form that the patterns miss."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == 0:
        at, dot = (" at ", " dot ") if rng.random() < 0.3 else ("(at)", ".") if rng.random() < 0.5 else (" @ ", ".")
        return text.replace("@", at).replace(".", dot)
    if kind == 1:
        return text.replace(".", "[.]" if rng.random() < 0.5 else " . ")
    if kind == 2:
        mark = "./_"[rng.integers(3)]
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    form = rng.integers(3)
    last = digits[-10:]
    return f"({last[:3]}) {last[3:6]}-{last[6:]}" if form == 0 else f"{last[:3]}-{last[3:6]}-{last[6:]}" if form == 1 else f"00{digits}"


def training_windows(text: str, rng, share: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Classes and tags of windows around the base spans, of which a share is rewritten, around other digits and at one random place."""
    spans, out, places = base_spans(text), [], []
    edited, tags, at = [], [], 0
    for start, kind, end in spans:
        if start < at:
            continue
        piece = text[start:end]
        if rng.random() < share:
            piece = rewritten(kind, piece, rng)
        edited += [text[at:start], piece]
        tags += [0] * (start - at) + [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)
        places.append(len(tags) - len(piece))
        at = end
    whole = "".join([*edited, text[at:]])
    tags = np.array(tags + [0] * (len(whole) - len(tags)), np.int8)
    places += [m.start() for m in list(_DIGIT.finditer(whole))[::9][:4]] + ([int(rng.integers(len(whole)))] if whole else [])
    classes = char_classes(whole)
    for p in places:
        a = p - int(rng.integers(FIT_LENGTH - 8))
        x, y = np.zeros(FIT_LENGTH, np.uint8), np.zeros(FIT_LENGTH, np.int8)
        lo, hi = max(0, a), min(len(whole), a + FIT_LENGTH)
        x[lo - a : hi - a], y[lo - a : hi - a] = classes[lo:hi], tags[lo:hi]
        if lo == a and y[0] and y[0] % 2 == 0:  # a span that began before the window
            y[: np.argmax(y != y[0]) if (y != y[0]).any() else FIT_LENGTH] = 0
        out.append((x, y))
    return out


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            rng = np.random.default_rng(len(text) * 1009 + sum(map(ord, text[:50])))
            for share in (0.0, 0.8):  # each text as it is, and once more
                rows += [(x.tobytes(), y.tobytes(), bool(y.any())) for x, y in training_windows(text, rng, share)]
        yield pd.DataFrame(rows, columns=["x", "y", "spans"])


# -- The tagger. Gates are clipped linear functions, so that a step costs few operations.


def new_model(rng) -> dict[str, np.ndarray]:
    model = {"out": rng.normal(0, 0.3, (TAGS, 2 * HIDDEN)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
    for d in "fb":
        model["in_" + d] = rng.normal(0, 0.3, (4 * HIDDEN, _CLASSES))
        model["in_" + d][: 3 * HIDDEN] += 0.5
        model["own_" + d] = rng.normal(0, 0.2, (4 * HIDDEN, HIDDEN))
    # Spans are rare: to begin with, entering one costs much.
    model["move"][0, 1::2] = -4
    model["start"][1::2] = -4
    model["bias"][0] = 1
    return model


def _barred() -> np.ndarray:
    """Where a transition is barred: into an inside that isn't of the kind before."""
    bar = np.zeros((TAGS, TAGS), bool)
    for k in range(2, TAGS, 2):
        bar[:, k] = True
        bar[k - 1, k] = bar[k, k] = False
    return bar


BARRED = _barred()
FAR = -50.0


def lstm(table: np.ndarray, own: np.ndarray, x: np.ndarray, keep: list | None = None, each=None) -> np.ndarray | None:
    """Hidden states (T, HIDDEN, B) of one direction over classes x (T, B); with each, they are handed to it instead."""
    n, b, hid = len(x), x.shape[1], HIDDEN
    h, c, z, q = np.zeros((hid, b), table.dtype), np.zeros((hid, b), table.dtype), np.empty((4 * hid, b), table.dtype), np.empty((4 * hid, b), table.dtype)
    out = np.empty((1 if each else n, hid, b), table.dtype)
    gates, cell = z[: 3 * hid], z[3 * hid :]
    for t in range(n):
        np.take(table, x[t], axis=1, out=z, mode="clip")
        np.matmul(own, h, out=q)
        z += q
        if keep is not None:
            keep.append((z.copy(), c.copy(), h.copy()))
        np.clip(gates, 0, 1, out=gates)
        np.clip(cell, -1, 1, out=cell)
        c *= z[hid : 2 * hid]
        z[:hid] *= cell
        c += z[:hid]
        h = out[0 if each else t]
        np.clip(c, -1, 1, out=h)
        h *= z[2 * hid : 3 * hid]
        if each:
            each(t, h)
    return None if each else out


def _lstm_back(own: np.ndarray, x: np.ndarray, keep: list, dh_all: np.ndarray, leak: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and own."""
    n, hid, b = dh_all.shape
    dz_all, down = np.empty((n, 4 * hid, b), own.dtype), np.zeros_like(own)
    dh, dc, small = np.zeros((hid, b), own.dtype), np.zeros((hid, b), own.dtype), own.dtype.type(leak)
    for t in range(n - 1, -1, -1):
        z, c0, h0 = keep[t]
        gate, g = np.clip(z[: 3 * hid], 0, 1), np.clip(z[3 * hid :], -1, 1)
        i, f, o = gate[:hid], gate[hid : 2 * hid], gate[2 * hid :]
        c = f * c0 + i * g
        dh = dh + dh_all[t]
        dc = dc + dh * o * np.where(np.abs(c) < 1, 1, small)
        dz = np.concatenate([dc * g, dc * c0, dh * np.clip(c, -1, 1), dc * i])
        dz[: 3 * hid] *= np.where((z[: 3 * hid] > 0) & (z[: 3 * hid] < 1), 1, small)
        dz[3 * hid :] *= np.where(np.abs(z[3 * hid :]) < 1, 1, small)
        dz_all[t] = dz
        down += dz @ h0.T
        dh, dc = own.T @ dz, dc * f
    flat = x.reshape(-1)
    rows = dz_all.transpose(1, 0, 2).reshape(4 * hid, -1)
    return np.stack([np.bincount(flat, r, _CLASSES) for r in rows]).astype(own.dtype), down


def crf_loss(e: np.ndarray, move: np.ndarray, start: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of tags y (T, B) given emissions e (T, B, TAGS), and gradients.

    The forward and backward passes hold probabilities, scaled at each place.
    """
    n, b, k = e.shape
    move = np.where(BARRED, FAR, move)
    step, top = np.exp(move), e.max(2, keepdims=True)
    p = np.exp(e - top)
    alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty((n, b, 1))
    now = np.exp(start) * p[0]
    for t in range(n):
        if t:
            now = (alpha[t - 1] @ step) * p[t]
        scale[t] = now.sum(1, keepdims=True)
        alpha[t] = now / scale[t]
    beta[-1] = 1
    for t in range(n - 2, -1, -1):
        beta[t] = (p[t + 1] * beta[t + 1] / scale[t + 1]) @ step.T
    de = alpha * beta
    after = p[1:] * beta[1:] / scale[1:]
    pair = step * (alpha[:-1].reshape(-1, k).T @ after.reshape(-1, k))
    total = (np.log(scale) + top).sum((0, 2))
    rows = np.arange(b)
    score = start[y[0]] + e[np.arange(n)[:, None], rows[None, :], y].sum(0) + move[y[:-1], y[1:]].sum(0)
    pair -= np.bincount((y[:-1] * k + y[1:]).ravel(), minlength=k * k).reshape(k, k)
    dstart = de[0].sum(0) - np.bincount(y[0], minlength=k)
    de[np.arange(n)[:, None], rows[None, :], y] -= 1
    return float((total - score).mean()), de / b, np.where(BARRED, 0, pair) / b, dstart / b


def train(x: np.ndarray, y: np.ndarray, steps: int = 700, batch: int = 48, rate: float = 0.02) -> dict[str, np.ndarray]:
    """The tagger after `steps` steps of Adam on windows x (N, T) with tags y (N, T)."""
    rng = np.random.default_rng(SEED)
    model = {k: a.astype(np.float32) for k, a in new_model(rng).items()}
    m, v = ({k: np.zeros_like(a) for k, a in model.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.choice(len(x), batch)
        xs, ys = x[pick].T.astype(np.int64), y[pick].T.astype(np.int64)
        keep_f: list = []
        keep_b: list = []
        hf = lstm(model["in_f"], model["own_f"], xs, keep_f)
        hb = lstm(model["in_b"], model["own_b"], xs[::-1], keep_b)[::-1]
        both = np.concatenate([hf, hb], 1).transpose(0, 2, 1)
        _, de, dmove, dstart = crf_loss(both @ model["out"].T + model["bias"], model["move"], model["start"], ys)
        grads = {"out": np.einsum("tbk,tbh->kh", de, both), "bias": de.sum((0, 1)), "move": dmove, "start": dstart}
        dboth = (de @ model["out"]).transpose(0, 2, 1)
        grads["in_f"], grads["own_f"] = _lstm_back(model["own_f"], xs, keep_f, dboth[:, :HIDDEN])
        grads["in_b"], grads["own_b"] = _lstm_back(model["own_b"], xs[::-1], keep_b, dboth[::-1, HIDDEN:])
        norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
        now = rate * min(1.0, 2.0 * (1 - step / steps) + 0.05)
        for k, g in grads.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            model[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def viterbi(e: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best tags (T, B) given emissions e (T, TAGS, B)."""
    n, _, b = e.shape
    score, back = start[:, None] + e[0], np.empty(e.shape, np.int8)
    for t in range(1, n):
        both = score[:, None, :] + move[:, :, None]
        back[t] = both.argmax(0)
        score = both.max(0) + e[t]
    tags = np.empty((n, b), np.int8)
    tags[-1] = score.argmax(0)
    rows = np.arange(b)
    for t in range(n - 1, 0, -1):
        tags[t - 1] = back[t, tags[t], rows]
    return tags


class Tagger:
    """Applies a model to texts; finds (text number, start, kind, end)."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.m = {k: v.astype(np.float32) for k, v in model.items()}
        self.move = np.where(BARRED, np.float32(FAR), self.m["move"])
        # Beyond staying outside: what entering a kind, each further step inside one and leaving it add at most.
        over = self.move - self.move[0, 0]
        self.enter, self.stay, self.leave = float(over[0, 1:].max()), float(over[1:, 1:].max()), float(over[1:, 0].max())
        self.begin = float((self.m["start"][1::2] - self.m["start"][0]).max())

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of classes x (T, B): emissions (T, TAGS, B), and which windows (B) need decoding."""
        n, b = x.shape
        out, q, run, most = np.empty((n, TAGS, b), np.float32), np.empty((TAGS, b), np.float32), np.zeros(b, np.float32), np.full(b, -np.inf, np.float32)
        wide = self.m["bias"][:, None]
        w = np.ascontiguousarray(self.m["out"][:, :HIDDEN]), np.ascontiguousarray(self.m["out"][:, HIDDEN:])

        def ahead(t: int, h: np.ndarray) -> None:
            np.matmul(w[0], h, out=out[t])

        def back(t: int, h: np.ndarray) -> None:
            e = out[n - 1 - t]
            np.matmul(w[1], h, out=q)
            e += q
            e += wide
            # The most that a stretch inside kinds, from here on, can gain over staying outside.
            np.maximum(run, 0.0, out=run)
            gain = e[1:].max(0)
            gain -= e[0]
            gain += self.stay - (self.leave if t == 0 else 0)
            np.add(run, gain, out=run)
            if t == n - 1:
                np.maximum(most, run + (self.begin - self.enter), out=most)
            np.maximum(most, run, out=most)

        lstm(self.m["in_f"], self.m["own_f"], x, each=ahead)
        lstm(self.m["in_b"], self.m["own_b"], x[::-1], each=back)
        return out, most + (self.enter + self.leave - self.stay) > 0

    def __call__(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """text number, start, kind and end of the spans of all texts."""
        step, places, parts = WINDOW - OVERLAP, [], []
        classes = [char_classes(text) for text in texts]
        for k, c in enumerate(classes):
            for a in range(0, max(1, len(c) - OVERLAP), step) if len(c) else ():
                places.append((k, a))
                parts.append(c[a : a + WINDOW])
        found, open_spans = set(), []
        for i, s, kind, e in self.decoded(parts):
            (k, a), size = places[i], len(classes[places[i][0]])
            core_lo = a + (OVERLAP // 2 if a else 0)
            core_hi = size if a + WINDOW >= size else a + WINDOW - OVERLAP // 2
            if core_lo <= a + s < core_hi:
                if (e == WINDOW and a + e < size) or (s == 0 and a):
                    open_spans.append((k, a + s, a + e))
                else:
                    found.add((k, a + s, kind, a + e))
        # Spans at an edge: what a window of twice the length around them says of the place.
        firsts = [max(0, s - WINDOW // 2) for _, s, _ in open_spans]
        for i, s, kind, e in self.decoded([classes[k][a : a + 2 * WINDOW] for (k, _, _), a in zip(open_spans, firsts, strict=True)]):
            k, lo, hi = open_spans[i]
            if firsts[i] + s < hi and firsts[i] + e > lo:
                found.add((k, firsts[i] + s, kind, firsts[i] + e))
        # Of spans that meet, from different windows, the longest stays.
        out: list[tuple[int, int, int, int]] = []
        for k, s, kind, e in sorted(found, key=lambda x: (x[0], x[1] - x[3], x[1], x[2])):
            at = bisect_left(out, (k, s))
            near = out[max(0, at - 1) : at + 1]
            if all(x[0] != k or e <= x[1] or s >= x[3] for x in near):
                out.insert(at, (k, s, kind, e))
        return out

    def decoded(self, parts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """Part number, start, kind and end of the spans on each part's best path."""
        # Windows of like length go together, so that little is read beyond the ends.
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        for lo in range(0, len(order), BATCH):
            group = order[lo : lo + BATCH]
            n = len(parts[group[-1]])
            x = np.zeros((len(group), n), np.uint8)
            for r, i in enumerate(group):
                x[r, : len(parts[i])] = parts[i]
            e, some = self.emissions(np.ascontiguousarray(x.T).astype(np.intp))
            some = np.flatnonzero(some)
            if not len(some):
                continue
            tags = viterbi(np.ascontiguousarray(e[:, :, some]), self.move, self.m["start"])
            for r, col in zip(some, tags.T, strict=True):
                size = len(parts[group[r]])
                for s in np.flatnonzero((col[:size] > 0) & (col[:size] % 2 == 1)):
                    end = s + 1
                    while end < size and col[end] == col[s] + 1:
                        end += 1
                    yield group[r], int(s), int(col[s] // 2), end


def accepted(kind: int, text: str) -> bool:
    """Whether a span that the tagger found holds what its kind must."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == 0:
        return bool(re.search(r"\w ?(@|[(\[]at[)\]]| at ) ?\w", text)) and ("." in text or " dot " in text)
    if kind == 1:
        return is_ip([p for p in _NOT_DIGIT.split(text) if p])
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and len(text) <= 2 * len(digits) and not re.search(r"[^\W\d_]", text)
    return 9 <= len(digits) <= 15 and len(text) <= 2 * len(digits) and not re.search(r"[^\W\d_]", text)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _find(model: dict[str, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for batch in batches:
            texts, rows, at = batch["text"].tolist(), [], 0
            base = [base_spans(t) for t in texts]
            more: list[list] = [[] for _ in texts]
            while at < len(texts):  # some millions of characters together
                stop, total = at, 0
                while stop < len(texts) and (stop == at or total + len(texts[stop]) <= 2_000_000):
                    total += len(texts[stop])
                    stop += 1
                for k, s, kind, e in tagger(texts[at:stop]):
                    text = texts[at + k][s:e]
                    e -= len(text) - len(text.rstrip())
                    taken = base[at + k] + more[at + k]
                    if all(e <= a or s >= b for a, _, b in taken) and accepted(kind, text.rstrip()):
                        more[at + k].append((s, kind, e))
                at = stop
            for doc_id, b, x in zip(batch["doc_id"], base, more, strict=True):
                n = [sum(kind == k for _, kind, _ in b) for k in range(len(KINDS))]
                rows.append((doc_id, *n, hashlib.sha256(joined(b).encode()).hexdigest(), joined(b + x), len(x)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return run


def fit_tagger(df: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS) -> dict[str, np.ndarray]:
    """The tagger, trained on at most fit_windows windows of at most fit_docs documents; half of them hold spans, if so many do."""
    rank = seeded(F.lit(SEED), F.col("doc_id"))
    ids = df.select(F.col(doc_id).alias("doc_id")).where("doc_id is not null").distinct().orderBy(rank, "doc_id").limit(fit_docs)
    texts = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    windows = texts.select("text").mapInPandas(_window_rows, "x binary, y binary, spans boolean")
    half = [windows.where(F.col("spans") == s).orderBy(F.xxhash64("x"), "x", "y").limit(fit_windows // 2).select("x", "y").toArrow().to_pandas() for s in (True, False)]
    rows = pd.concat(half, ignore_index=True)
    if not len(half[0]):
        return new_model(np.random.default_rng(SEED)) | {"out": np.zeros((TAGS, 2 * HIDDEN)), "bias": np.r_[10.0, np.zeros(TAGS - 1)]}
    x, y = (np.frombuffer(b"".join(map(bytes, rows[c])), t).reshape(-1, FIT_LENGTH) for c, t in (("x", np.uint8), ("y", np.int8)))
    return train(x, y)


def find_personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans, n_added for each row of df.

    Null and empty texts have no spans. Repeated rows give equal results. Without any base span to learn from, the tagger
    finds nothing. An empty table gives an empty table; extra columns are ignored.
    """
    model = fit_tagger(df, doc_id, text, **options)
    id_type = df.schema[doc_id].dataType.simpleString()
    texts = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.mapInPandas(_find(model), f"doc_id {id_type}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def op10_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))
