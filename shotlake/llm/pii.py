"""Personal data: base patterns, and a character BiLSTM with CRF transitions that adds spans.

The network is trained in numpy from labelled spans (generated from rules with
a fixed seed). Texts are read in overlapping windows; each window is decoded
by Viterbi into candidate spans, and one weighted interval schedule over the
whole text reconciles the candidates of all windows. A candidate counts only
if its own characters pass the checks of its kind, all of which need a digit
or an at sign. A window with neither can't yield a span and isn't decoded.

Null texts count as empty and have no spans. Repeated rows get equal results.
Offsets are code points, ends exclusive. Columns other than id and text are
not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, table, texts_of

KINDS = ("email", "ip", "card", "phone")
#: What the network labels: the kinds of the base rules, and secrets, which no rule finds.
LABELLED = (*KINDS, "secret")
WIDTH, STRIDE = 128, 64
HIDDEN = 16
#: Windows that go through the network at once.
TOGETHER = 512

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
#: A phone number that the network may add: a base one, or without a plus three groups whose first two can begin an area and an exchange.
SPACED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]|(?:\([2-9][0-9]{2}\)[\x20.-]?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}")
#: A secret: one run of characters that turns often between digits and letters.
SECRET, TURN = re.compile(r"[A-Za-z0-9+/_=-]{20,63}"), re.compile(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, failing ones dropped, in order of kind and start."""
    out: list[tuple[str, int, int]] = []
    if not TRIGGER.search(text):
        return out
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", at + 1)
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        place = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = place + sum(map(len, four)) + 3
            if all(map(_small, four)):
                out.append(("ip", place, end))
            place = end + 1
    for m in DIGITS.finditer(text):
        digits = _only_digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_only_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


CLASS_OF = np.full(128, 1, np.int64)
for _i, _c in enumerate("0123456789"):
    CLASS_OF[ord(_c)] = 2
for _c in "abcdefghijklmnopqrstuvwxyz":
    CLASS_OF[ord(_c)] = 3
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    CLASS_OF[ord(_c)] = 4
for _i, _c in enumerate("@.+-()% _,:;/=#\n\"'"):
    CLASS_OF[ord(_c)] = 5 + _i
N_CLASSES = int(CLASS_OF.max()) + 1
#: Labels: 0 outside, then begin and inside of each kind.
N_LABELS = 1 + 2 * len(LABELLED)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, CLASS_OF[np.minimum(points, 127)], 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """BiLSTM emissions and CRF transitions; trained by Adam on the CRF's log likelihood."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.h = hidden
        shapes = {"out": (2 * hidden, N_LABELS), "out_b": (N_LABELS,), "trans": (N_LABELS, N_LABELS)}
        for d in "fb":
            shapes |= {f"x{d}": (N_CLASSES, 4 * hidden), f"u{d}": (hidden, 4 * hidden)}
        self.p = {k: (rng.normal(0, 0.3, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        self.p["trans"] *= 0

    def _scan(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        n, length = x.shape
        h = np.zeros((n, self.h), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((length, n, self.h), np.float32)
        k = self.h
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = self.p[f"x{d}"][x[:, t]] + h @ self.p[f"u{d}"]
            gate, g = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            before_h, before_c = h, c
            c = gate[:, k : 2 * k] * c + gate[:, :k] * g
            tc = np.tanh(c)
            h = gate[:, 2 * k :] * tc
            out[t] = h
            if keep is not None:
                keep.append((t, gate, g, before_c, tc, before_h))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._scan(x, "f"), self._scan(x, "b")], axis=2)
        return both @ self.p["out"] + self.p["out_b"]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi labels (windows, positions), and emissions of the chosen labels less those of `outside`."""
        e = self.emissions(x)
        length, n, _ = e.shape
        score, back = e[0], np.zeros((length, n, N_LABELS), np.int8)
        for t in range(1, length):
            step = score[:, :, None] + self.p["trans"][None]
            back[t] = step.argmax(1)
            score = step.max(1) + e[t]
        labels = np.zeros((n, length), np.int64)
        labels[:, -1] = score.argmax(1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            labels[:, t - 1] = back[t, rows, labels[:, t]]
        margin = np.take_along_axis(e.transpose(1, 0, 2), labels[:, :, None], 2)[:, :, 0] - e[:, :, 0].T
        return labels, margin

    def _step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood and its gradients."""
        n, length = x.shape
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._scan(x, d, kept[d]) for d in "fb"], axis=2)
        e, a = both @ self.p["out"] + self.p["out_b"], self.p["trans"]

        def lse(v: np.ndarray, axis: int) -> np.ndarray:
            top = v.max(axis, keepdims=True)
            return (top + np.log(np.exp(v - top).sum(axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, length):
            alpha[t] = lse(alpha[t - 1][:, :, None] + a[None], 1) + e[t]
        for t in range(length - 2, -1, -1):
            beta[t] = lse(a[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - log_z[None, :, None])
        rows = np.arange(n)
        gold = np.zeros(n)
        for t in range(length):
            de[t, rows, y[:, t]] -= 1
            gold += e[t, rows, y[:, t]]
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + a[None] + (e[t] + beta[t])[:, None, :] - log_z[:, None, None])
                grads["trans"] += pair.sum(0)
                np.subtract.at(grads["trans"], (y[:, t - 1], y[:, t]), 1)
                gold += a[y[:, t - 1], y[:, t]]
        grads["out"] += np.einsum("tnh,tnl->hl", both, de)
        grads["out_b"] += de.sum((0, 1))
        dboth, k = de @ self.p["out"].T, self.h
        for d, own in (("f", dboth[:, :, :k]), ("b", dboth[:, :, k:])):
            dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
            u = self.p[f"u{d}"]
            for t, gate, g, before_c, tc, before_h in reversed(kept[d]):
                i, f, o = gate[:, :k], gate[:, k : 2 * k], gate[:, 2 * k :]
                dh = dh + own[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                np.add.at(grads[f"x{d}"], x[:, t], dz)
                grads[f"u{d}"] += before_h.T @ dz
                dh, dc = dz @ u.T, dc * f
        return float((log_z - gold).mean()), {k: v / n for k, v in grads.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 8, batch: int = 48, rate: float = 0.02) -> list[float]:
        rng = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, losses = 0, []
        for r in range(rounds):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                own = order[s : s + batch]
                loss, grads = self._step(x[own], y[own])
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = (g * min(1.0, 5 / (size + 1e-9))).astype(np.float32)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * 0.75**r * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                losses.append(loss)
        return losses


def labelled(n: int, length: int = 96, seed: int = 3) -> tuple[list[str], list[list[tuple[str, int, int]]]]:
    """Generated texts of exactly `length` characters with their labelled spans, and look-alikes without one."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(rng.integers(10)) for _ in range(k))
    word = lambda: "".join(pick(["an", "er", "th", "on", "re", "st", "la", "é", "ung", "ch", "qu", "os", "in"]) for _ in range(int(rng.integers(1, 5))))

    def card() -> str:
        body = "4" + num(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = pick(["", "", "", " ", "-"])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = str(rng.integers(2, 10)) + num(2), str(rng.integers(2, 10)) + num(2), num(4)
        return pick([f"+{num(1)} ({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"+{num(2)}{a}{b}{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])

    def email() -> str:
        return f"{word()}{pick(['.', '_', '', '+'])}{num(int(rng.integers(0, 3)))}{pick('abcxyz')}@{pick(['mail', 'post', 'web'])}{num(1)}.{pick(['example.com', 'org', 'co.uk', 'net'])}"

    def ip() -> str:
        return ".".join(str(rng.integers(256)) for _ in range(4))

    def secret() -> str:
        letters, size = pick([("0123456789abcdef", 40), ("0123456789abcdef", 32), ("0123456789ABCDEF", 40), ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", int(rng.integers(24, 44)))])
        return "".join(pick(letters) for _ in range(size))

    cue = {"secret": lambda: pick(['token = "', 'TOKEN = "', "key: ", 'password="', "secret ", ""])}
    made = {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret}
    plain = [lambda: num(int(rng.integers(1, 8))), lambda: f"version {num(1)}.{num(1)}", lambda: f"ref {pick('01')}{num(2)}-{pick('01')}{num(2)}-{num(4)}", lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: "".join(word() for _ in range(6)), lambda: f"{num(16)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"{num(24)}", lambda: f"@{word()}", lambda: f"{num(4)}-{num(2)}-{num(2)}"]
    texts, spans = [], []
    for _ in range(n):
        text, own = word()[: int(rng.integers(0, 9))], []
        while len(text) < length:
            text += pick([" ", " ", " ", ", ", ". ", "\n", "### ", "&&& ", ": "])
            draw = rng.random()
            if draw < 0.22:
                kind = pick(LABELLED)
                piece = made[kind]()
                text += cue.get(kind, str)()
                own.append((kind, len(text), len(text) + len(piece)))
                text += piece
            elif draw < 0.32:
                text += pick(plain)()
            else:
                text += word() if rng.random() < 0.9 else word().upper()
        texts.append(text[:length])
        spans.append([s for s in own if s[2] <= length])
    return texts, spans


@lru_cache(maxsize=1)
def trained(samples: int = 1400) -> dict[str, np.ndarray]:
    texts, spans = labelled(samples)
    x = np.stack([classes(t) for t in texts])
    y = np.zeros(x.shape, np.int64)
    for row, own in enumerate(spans):
        for kind, a, b in own:
            y[row, a:b] = 2 + 2 * LABELLED.index(kind)
            y[row, a] -= 1
    net = Tagger()
    net.fit(x, y)
    return net.p


def _valid(kind: str, piece: str) -> bool:
    if kind == "email":
        local, _, domain = piece.partition("@")
        return bool(local) and set(local) <= LOCAL and bool(DOMAIN.fullmatch(domain))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", piece)) and all(map(_small, piece.split(".")))
    digits = _only_digits(piece)
    if kind == "card":
        return bool(DIGITS.fullmatch(piece)) and 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "secret":
        return bool(SECRET.fullmatch(piece)) and min(len(digits), sum(c.isalpha() for c in piece)) >= 4 and len(TURN.findall(piece)) >= 6
    return bool(SPACED.fullmatch(piece)) and 8 <= len(digits) <= 15


def schedule(found: dict[tuple[str, int, int], float]) -> list[tuple[str, int, int]]:
    """The non-overlapping spans of greatest total score: each span is chosen or not over the whole text."""
    spans = sorted(found, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for i, s in enumerate(spans):
        before = int(np.searchsorted(ends[:i], s[1], side="right"))
        take = best[before][0] + found[s]
        best.append((take, before, True) if take > best[i][0] else (best[i][0], i, False))
    out, i = [], len(spans)
    while i:
        _, before, taken = best[i]
        if taken:
            out.append(spans[i - 1])
        i = before if taken else i - 1
    return out[::-1]


def windows_of(text: str, x: np.ndarray) -> list[int]:
    """Starts of the overlapping windows that hold a digit or an at sign."""
    near = np.nonzero((x == 2) | (x == CLASS_OF[ord("@")]))[0]
    first = np.unique(np.concatenate([near // STRIDE, np.maximum(near // STRIDE - 1, 0)]))
    return [int(s) * STRIDE for s in first if ((near >= s * STRIDE) & (near < s * STRIDE + WIDTH)).any()] if len(near) < 64 else (first * STRIDE).tolist()


def method_spans(net: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans of the tagger for each text, reconciled over its windows."""
    found: list[dict[tuple[str, int, int], float]] = [{} for _ in texts]
    work: list[tuple[int, int]] = []
    rows: list[np.ndarray] = []

    def flush() -> None:
        if not rows:
            return
        labels, margin = net.decode(np.stack(rows))
        for (i, start), tags, gain in zip(work, labels, margin, strict=True):
            text, p = texts[i], 0
            while p < WIDTH:
                if tags[p] == 0:
                    p += 1
                    continue
                kind, q = (tags[p] - 1) // 2, p + 1
                while q < WIDTH and tags[q] == 2 + 2 * kind:
                    q += 1
                a, b = start + p, min(start + q, len(text))
                if a < b and (p > 0 or start == 0) and (q < WIDTH or b == len(text)) and _valid(LABELLED[kind], text[a:b]):
                    key = (LABELLED[kind], a, b)
                    found[i][key] = max(found[i].get(key, 0.0), float(gain[p:q].sum()))
                p = q
        rows.clear(), work.clear()

    for i, text in enumerate(texts):
        if TRIGGER.search(text):
            x = classes(text)
            for start in windows_of(text, x):
                own = x[start : start + WIDTH]
                rows.append(np.concatenate([own, np.zeros(WIDTH - len(own), np.int64)]))
                work.append((i, start))
                if len(rows) >= TOGETHER:
                    flush()
    flush()
    return [schedule({k: v for k, v in f.items() if v > 0}) if f else [] for f in found]


def combine(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans, and those of the method that overlap none of them, by kind and start."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    free = []
    for kind, a, b in more:
        i = int(np.searchsorted(starts, b, side="left"))
        if i == 0 or reach[i - 1] <= a:
            free.append((kind, a, b))
    return sorted(set(base) | set(free), key=lambda s: (LABELLED.index(s[0]), s[1], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans): the counts of kinds are of base spans, n_spans of all."""
    weights = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        net = Tagger()
        net.p = weights.value
        texts = texts_of(batch, text_col)
        base = [sorted(base_spans(t), key=lambda s: (KINDS.index(s[0]), s[1])) for t in texts]
        every = [combine(b, m) for b, m in zip(base, method_spans(net, texts), strict=True)]
        counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
        digest = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base])
        added = pa.array([len(e) - len(b) for e, b in zip(every, base, strict=True)], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(id_col), *counts, digest, pa.array([_joined(e) for e in every]), added, pa.array([len(e) for e in every], pa.int64())], [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return map_texts(docs.select(id_col, text_col), run, schema, text_col)


def op5(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
