"""A character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans."""

from __future__ import annotations

import random
from functools import cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
VOCABULARY = 130  # ASCII, any other character, and padding
PAD = 129


def codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Tagger:
    """Parameters: per direction a table of inputs (characters' vectors times the input weights) and recurrent weights; the
    output layer; the transitions between labels."""

    def __init__(self, hidden: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.h = hidden
        w = {}
        for d in "fb":
            w["t" + d] = rng.normal(0, 0.3, (VOCABULARY, 4 * hidden))
            w["t" + d][:, hidden : 2 * hidden] += 1.0  # remember at first
            w["t" + d][PAD, : 2 * hidden] = -60.0  # padding takes nothing in and keeps nothing: it can't be told from no text
            w["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        w["o"] = rng.normal(0, 0.3, (2 * hidden, LABELS))
        w["c"] = np.zeros(LABELS)
        w["a"] = np.zeros((LABELS, LABELS))
        self.w = w

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States of one direction. x: (time, batch) codes in reading order."""
        h, (time, batch) = self.h, x.shape
        t, u = self.w["t" + d], self.w["u" + d]
        out = np.empty((time, batch, h), t.dtype)
        state, cell, memory = np.zeros((batch, h), t.dtype), np.zeros((batch, h), t.dtype), []
        for k in range(time):
            z = t[x[k]] + state @ u
            s = _sigmoid(z[:, : 3 * h])
            i, f, o, g = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, cell = cell, f * cell + i * g
            tc = np.tanh(cell)
            if keep:
                memory.append((state, i, f, o, g, before, tc))
            state = o * tc
            out[k] = state
        return out, memory

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (time, batch, label) of windows (time, batch)."""
        a, _ = self._run(x, "f", False)
        b, _ = self._run(x[::-1], "b", False)
        return np.concatenate((a, b[::-1]), axis=2) @ self.w["o"] + self.w["c"]

    def _back(self, x: np.ndarray, d: str, memory: list, grad: np.ndarray, g: dict) -> None:
        h, u = self.h, self.w["u" + d]
        ds, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        dt, du = np.zeros_like(self.w["t" + d]), np.zeros_like(u)
        for k in range(len(x) - 1, -1, -1):
            state, i, f, o, gg, before, tc = memory[k]
            ds = ds + grad[k]
            dc = dc + ds * o * (1 - tc * tc)
            dz = np.concatenate((dc * gg * i * (1 - i), dc * before * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - gg * gg)), axis=1)
            np.add.at(dt, x[k], dz)
            du += state.T @ dz
            ds, dc = dz @ u.T, dc * f
        g["t" + d], g["u" + d] = dt, du

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of labels y (time, batch) and its gradients."""
        time, batch = x.shape
        a, ma = self._run(x, "f", True)
        b, mb = self._run(x[::-1], "b", True)
        both = np.concatenate((a, b[::-1]), axis=2)
        e, trans = both @ self.w["o"] + self.w["c"], self.w["a"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for k in range(1, time):
            alpha[k] = _logsumexp(alpha[k - 1][:, :, None] + trans, 1) + e[k]
        for k in range(time - 2, -1, -1):
            beta[k] = _logsumexp(trans[None] + (e[k + 1] + beta[k + 1])[:, None, :], 2)
        z = _logsumexp(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        pair = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum(axis=(0, 1))
        rows, cols = np.indices(y.shape)
        score = e[rows, cols, y].sum() + trans[y[:-1], y[1:]].sum()
        de[rows, cols, y] -= 1
        np.subtract.at(pair, (y[:-1], y[1:]), 1)
        g = {"o": both.reshape(-1, 2 * self.h).T @ de.reshape(-1, LABELS), "c": de.sum(axis=(0, 1)), "a": pair}
        back = de @ self.w["o"].T
        self._back(x, "f", ma, back[:, :, : self.h], g)
        self._back(x[::-1], "b", mb, back[::-1, :, self.h :], g)
        return float(z.sum() - score) / (time * batch), {k: v / batch for k, v in g.items()}

    def train(self, examples: list[tuple[str, list[tuple[str, int, int]]]], width: int = 64, batch: int = 48, steps: int = 320, rate: float = 0.02, seed: int = 5) -> Tagger:
        """Adam over random windows of labelled texts. Spans are (kind, start, end)."""
        rng = np.random.default_rng(seed)
        x = [np.concatenate((codes(t), np.full(width, PAD, np.int32))) for t, _ in examples]
        y = []
        for (_, spans), c in zip(examples, x, strict=True):
            labels = np.zeros(len(c), np.int64)
            for kind, a, b in spans:
                labels[a:b] = 1 + KINDS.index(kind)
            y.append(labels)
        m, v = ({k: np.zeros_like(p) for k, p in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = [(i, int(rng.integers(0, len(x[i]) - width + 1))) for i in rng.integers(0, len(x), batch).tolist()]
            _, g = self.loss(np.stack([x[i][a : a + width] for i, a in pick], 1), np.stack([y[i][a : a + width] for i, a in pick], 1))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, p in self.w.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def single(self) -> Tagger:
        """The same in single precision, to be sent to workers."""
        out = Tagger.__new__(Tagger)
        out.h, out.w = self.h, {k: p.astype(np.float32) for k, p in self.w.items()}
        return out

    def scores(self, x: np.ndarray, steps: int = 4) -> np.ndarray:
        """`emissions` in single precision, both directions side by side. Three gates are sigmoids, (1 + tanh(z / 2)) / 2: their
        weights are halved once, so one tanh serves all four, and their outer halves are taken once of the cell and, for the
        state, by the weights that follow it. Gates come first in memory, so each is one run of numbers; the output layer is
        applied to `steps` at a time, so no more states are kept. Scores lie in memory as (time, label, batch)."""
        h, (time, batch) = self.h, x.shape
        half = np.repeat(np.array([0.5, 1.0], np.float32), [3 * h, h])
        apart = lambda w: np.ascontiguousarray(np.moveaxis((w.astype(np.float32) * half).reshape(*w.shape[:-1], 4, h), -2, 0))
        table = apart(np.concatenate([self.w["tf"], self.w["tb"]]))
        u = apart(np.stack([self.w["uf"], self.w["ub"]]) / 2)
        last = self.w["o"].astype(np.float32).reshape(2, h, LABELS) / 2
        x, both = x.astype(np.intp, copy=False), np.empty((2, batch), np.intp)
        out = np.empty((time, LABELS, batch), np.float32)
        out[:] = self.w["c"].astype(np.float32)[:, None]
        states, cell = np.zeros((2, steps, batch, h), np.float32), np.zeros((2, batch, h), np.float32)  # states are doubled
        z, y, g, t = np.empty((4, 2, batch, h), np.float32), np.empty((4, 2, batch, h), np.float32), np.empty_like(cell), np.empty_like(cell)
        e, state = np.empty((2, steps, batch, LABELS), np.float32), states[:, -1]
        s, (i, f, o, c) = z[:3], z
        gates = list(zip(table, z, strict=True))
        for begin in range(0, time, steps):
            end = min(begin + steps, time)
            for k in range(begin, end):
                both[0] = x[k]
                np.add(x[time - 1 - k], VOCABULARY, out=both[1])
                for rows, gate in gates:
                    rows.take(both, axis=0, out=gate, mode="clip")
                z += np.matmul(state, u, out=y)
                np.tanh(z, out=z)
                s += 1
                cell *= f
                cell += np.multiply(i, c, out=g)
                cell *= 0.5
                state = states[:, k - begin]
                np.multiply(np.tanh(cell, out=t), o, out=state)
            np.matmul(states.reshape(2, -1, h), last, out=e.reshape(2, -1, LABELS))
            ahead, back = e[:, : end - begin].transpose(0, 1, 3, 2)
            out[begin:end] += ahead
            out[time - end : time - begin] += back[::-1]
        return out.transpose(0, 2, 1)

    def tag(self, texts: list[str], width: int = 512, overlap: int = 96, cells: int = 262_144) -> list[list[tuple[str, int, int]]]:
        """Spans of whole texts. Windows of a bounded width cover every character and overlap; each is scored and decoded by
        itself. They are reconciled over all of a text: each position has the label of the window it lies deepest in, so
        windows meet in the middle of their overlaps, and spans are the runs of one label across all windows."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(sizes)))
        joined = codes("".join(texts))
        labels = np.zeros(len(joined), np.int8)
        # Of each window: first position, length, and how much of either end is left to the neighbours.
        many = np.where(sizes > 0, np.maximum(1, -(-(sizes - overlap) // (width - overlap))), 0)
        of = np.repeat(np.arange(len(texts)), many)
        within = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * (width - overlap)
        firsts, lengths = begins[of] + within, np.minimum(width, sizes[of] - within)
        lefts, rights = np.where(within > 0, overlap // 2, 0), np.where(within + width < sizes[of], overlap // 2, 0)
        order = np.argsort(lengths, kind="stable")  # windows of a batch are about as long
        padded = np.concatenate((joined, np.full(width, PAD, np.uint8)))
        held: list[tuple] = []
        while len(order):
            longest = int(lengths[order[-1]])
            some, order = order[-max(1, cells // longest) :], order[: -max(1, cells // longest)]
            x = np.lib.stride_tricks.sliding_window_view(padded, longest)[firsts[some]].T.astype(np.intp, order="C")
            if lengths[some[0]] < longest:
                x[np.arange(longest)[:, None] >= lengths[some]] = PAD
            window, at, *runs = self._open(self.scores(x).transpose(0, 2, 1), lengths[some])
            own = some[window]
            held.append((firsts[own] + at, (at >= lefts[own]) & (at < lengths[own] - rights[own]), *runs))
            if not len(order) or sum(len(h[0]) for h in held) > cells:
                places, kept, begin, e = (np.concatenate(h, axis=-1) for h in zip(*held, strict=True))
                labels[places[kept]] = self._decode(e, begin)[kept]
                held = []
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        turns = np.flatnonzero(np.diff(labels, prepend=0) != 0)
        turns = np.unique(np.concatenate((turns, begins[(begins > 0) & (begins < len(labels))], [len(labels)])))
        own = np.flatnonzero(labels[turns[:-1]])
        s, t = turns[own], turns[own + 1]
        of = np.searchsorted(begins, s, "right") - 1
        for n, label, a, b in zip(of.tolist(), labels[s].tolist(), (s - begins[of]).tolist(), (t - begins[of]).tolist(), strict=True):
            found[n].append((KINDS[label - 1], a, b))
        return found

    def _open(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of windows with scores `e` (time, label, batch) that the best path may label: their window, their place in
        it, whether a run of them begins there, and their scores (label, position). All others have "none" on the best path.
        A run of labels gains over "none" no more than its best scores, with the best steps into, within and out of it; where no
        run through a position can gain anything, that position has none. The scores of a window's ends lack the steps from
        and to "none" that `_decode` takes there."""
        time, _, batch = e.shape
        a = self.w["a"].astype(np.float32)
        extra = a - a[0, 0]
        enter, within, leave = extra[0, 1:].max(), extra[1:, 1:].max(), extra[1:, 0].max()
        gain = e[:, 1:].max(axis=1)
        gain -= e[:, 0]
        gain += within
        behind = np.arange(time)[:, None] >= lengths if lengths.min() < time else None
        if behind is not None:
            gain[behind] = 0
        most, room, last = np.empty_like(gain), np.empty(batch, np.float32), np.zeros(batch, np.float32)
        for own, to_here in zip(gain, most, strict=True):
            last = np.add(np.maximum(last, enter, out=room), own, out=to_here)
        last = np.zeros(batch, np.float32)
        for own, both_ways in zip(gain[::-1], most[::-1], strict=True):
            both_ways += np.maximum(last, leave, out=room)
            np.add(room, own, out=last)
        may = most > within - 0.01  # far more than rounding
        if behind is not None:
            may[behind] = False
        window, at = np.divmod(np.flatnonzero(np.ascontiguousarray(may.T)), time)
        begin = np.diff(window * (time + 1) + at, prepend=-2) != 1
        open_scores = e.reshape(-1).take(at * (LABELS * batch) + window + np.arange(LABELS)[:, None] * batch)
        open_scores[:, at == 0] -= a[0][:, None]
        open_scores[:, at == lengths[window] - 1] -= a[:, 0][:, None]
        return window, at, begin, open_scores

    def _decode(self, e: np.ndarray, begin: np.ndarray, cells: int = 131_072) -> np.ndarray:
        """Best labels of runs of positions with scores `e` (label, position) and "none" on either side, runs of similar length
        at a time."""
        starts, out = np.flatnonzero(begin), np.empty(len(begin), np.int8)
        sizes = np.diff(starts, append=len(begin))
        order = np.argsort(sizes, kind="stable")
        while len(order):
            longest = int(sizes[order[-1]])
            low = max(int(np.searchsorted(sizes[order], longest // 2, "right")), len(order) - max(1, cells // longest))
            some, order = order[low:], order[:low]
            inside = np.arange(longest)[:, None] < sizes[some]
            at = np.where(inside, starts[some] + np.arange(longest)[:, None], 0)
            x = np.empty((longest + 2, LABELS, len(some)), np.float32)
            x[:] = np.array([0] + [-1e9] * (LABELS - 1), np.float32)[:, None]
            np.copyto(x[1:-1], e[:, at].transpose(1, 0, 2), where=inside[:, None])
            out[at[inside]] = self._viterbi(x)[1:-1][inside]
        return out

    def _viterbi(self, e: np.ndarray, steps: int = 32) -> np.ndarray:
        """Best labels (time, batch) of scores (time, label, batch). The best sums of all steps come first, then what led to each,
        for `steps` at a time."""
        time, _, batch = e.shape
        a = self.w["a"].astype(e.dtype)[:, :, None]
        best, paths = np.empty(e.shape, e.dtype), np.empty((LABELS, LABELS, batch), e.dtype)
        best[0] = e[0]
        for k in range(1, time):
            np.add(best[k - 1][:, None], a, out=paths)
            np.maximum.reduce(paths, axis=0, out=best[k])
            best[k] += e[k]
        out = np.empty((time, batch), np.int8)
        out[-1] = best[-1].argmax(axis=0)
        columns = np.arange(batch)
        for end in range(time - 1, 0, -steps):
            begin = max(0, end - steps)
            before = best[begin:end, :, None]
            top, back = before[:, 0] + a[0], np.zeros((end - begin, LABELS, batch), np.int8)
            for p in range(1, LABELS):
                other = before[:, p] + a[p]
                np.maximum(back, (other > top).view(np.int8) * np.int8(p), out=back)  # p grows: the last that is better
                np.maximum(top, other, out=top)
            for k in range(end, begin, -1):
                out[k - 1] = back[k - 1 - begin].ravel().take(out[k] * np.intp(batch) + columns)
        return out


def labelled(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with labelled spans: prose of invented syllables around personal data in usual and unusual spellings, and
    around numbers and words that are none (dates, versions, amounts, tokens, "at" and "dot" in prose)."""
    r = random.Random(seed)
    syllables = "an er the on re ti ha en st ing ou ea nd de que la ch ge ung ció os ado é lo mi ba ku sa".split()
    plain = lambda: "".join(r.choice(syllables[:19]) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        return r.choice([w] * 8 + [w.capitalize(), w.capitalize(), w.upper(), r.choice(["at", "dot", "the", "of", "a", "und", "y", "point"])])

    def email() -> str:
        local = plain() + r.choice(["", "." + plain(), "_" + digits(2), "." + digits(2), "+" + plain()])
        local = local.capitalize() if r.random() < 0.2 else local
        at, dot = r.choice([("@", ".")] * 4 + [(" @ ", "."), (" @", "."), ("(@)", "."), ("[at]", "."), (" (at) ", "."), (" [at] ", " [dot] "), *[(" at ", " dot ")] * 3, ("(at)", "(dot)"), (" AT ", " DOT "), ("@", " . "), ("@", "[.]")])
        return local + at + plain() + r.choice(["", digits(1), "-" + plain()]) + dot + r.choice(["com", "org", "example.com", "net", "de", "fr", "io"])

    def ip() -> str:
        return r.choice(["."] * 3 + ["[.]", " . ", "(.)", "[dot]", ". "]).join(str(r.randint(0, 255)) for _ in range(4))

    def card() -> str:
        size, some = r.choice([16] * 6 + [15, 13, 19]), r.choice(["0123456789"] * 3 + [digits(2), "41", "5"])
        d = [int(r.choice(some)) for _ in range(size - 1)]
        s = sum(x if (size - i) % 2 else (2 * x - 9 * (x > 4)) for i, x in enumerate(d))
        d = "".join(map(str, d)) + str(-s % 10)
        sep = r.choice(["", " ", "-", ".", ".", "/", "  ", " - ", "_"])
        return sep.join(d[k : k + 4] for k in range(0, size, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"00{digits(2)} {a} {b}{c}", f"00{digits(2)}{a}{b}{c}", f"+{digits(2)}{a}{b}{c}", f"+{digits(2)}/{a}/{b}{c}", f"0{a}/{b}{c}", f"+1 {a}/{b}-{c}"])

    def other() -> str:
        year, month, day = r.randint(1900, 2030), r.randint(1, 12), r.randint(1, 28)
        return r.choice([
            f"{year}-{month:02d}-{day:02d}", f"{day}.{month}.{year}", f"{day:02d}/{month:02d}/{year}", f"{year}-{month:02d}-{day:02d} {digits(2)}:{digits(2)}", f"{year}", f"{r.randint(0, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 99999)}",
            "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 32, 40]))), "password=" + "".join(r.choice("0123456789abcdef") for _ in range(18)), f"{r.randint(1, 999)},{digits(2)}", f"{r.randint(1, 99)}.{digits(3)}.{digits(3)},{digits(2)}", "AKIA" + "".join(r.choice("ABCDEFGHIJ0123456789") for _ in range(16)),
            f"{digits(2)}:{digits(2)}", "v" + digits(1) + "." + digits(2) + "." + digits(1), f"{digits(1)}.{digits(1)}.{digits(1)}", f"#{digits(6)}", f"{digits(10)}", f"{digits(16)}", f"No. {digits(4)}-{digits(4)}", f"pp. {digits(3)}-{digits(3)}", f"ISBN 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
            f"{plain()} at {plain()}. {plain()}", f"@{plain()}", f"{plain()}.{plain()}", f"http://{plain()}.{plain()}.com/{digits(3)}", f"{digits(3)} + {digits(3)} = {digits(3)}", f"{digits(1)}, {digits(1)}, {digits(2)}, {digits(2)}", "-" * r.randint(3, 20), "*" * r.randint(2, 9), "<br>", "{}()[];", "...",
        ])

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    lead = {"email": ["mail ", "e-mail: ", "write to "], "ip": ["from ", "host ", "IP "], "card": ["card ", "Visa ", "no. "], "phone": ["call ", "tel. ", "Tel: ", "phone "]}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(2, 5)):
            text += " ".join(word() + r.choice([""] * 9 + [",", ".", ":"]) for _ in range(r.randint(1, 9) if r.random() < 0.8 else r.randint(10, 60))) + r.choice([" ", " ", " ", ": ", "\n", " ("])
            if r.random() < 0.6:
                kind = r.choice(KINDS)
                text += r.choice(lead[kind]) if r.random() < 0.4 else ""
                s = make[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
                text += s + (r.choice([" " + digits(3), " cvv " + digits(3), " 12/27"]) if kind == "card" and r.random() < 0.2 else "")
            else:
                text += other()
            text += r.choice([" ", ". ", ", ", "\n", " ", "! ", ") "])
        out.append((text, spans))
    return out


@cache
def trained(examples: int = 4000, seed: int = 5, hidden: int = 12, steps: int = 1000) -> Tagger:
    """The tagger that the queries use; seeded, so it is the same in every session, and made once in each."""
    return Tagger(hidden, seed).train(labelled(examples, seed), width=160, batch=32, steps=steps, seed=seed).single()
