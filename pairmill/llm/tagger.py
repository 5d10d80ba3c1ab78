"""A character tagger: bidirectional LSTM with CRF transitions, in numpy.

Trained on labelled spans of made-up sentences (seeded, so every run has the
same weights). Latin letters count without case, digits as one class, marks
each by itself. Gates and cells are bent by x / (1 + |x|), which numpy has far
faster than the hyperbolic tangent.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
_MARKS = "@.-_%+ ()[]\"=:,\n/#!"
CLASSES = len(_MARKS) + 31
HIDDEN = 16
#: Characters of a window, and those that two windows share.
WINDOW, SHARED = 512, 64
#: Windows that are read at once, and their characters if they are long.
ROWS, CELLS = 1_024, 1 << 17
_FORBIDDEN = -1e4


def _class_table() -> np.ndarray:
    """Class of each ASCII code: 1 digit, 2 other letter or sign, 3 control, 4 to 29 letters, then the marks; 0 is filler."""
    table = np.full(128, 2, np.int8)
    table[:32] = 3
    table[ord("0") : ord("9") + 1] = 1
    for i in range(26):
        table[[65 + i, 97 + i]] = 4 + i
    for i, c in enumerate(_MARKS):
        table[ord(c)] = 31 + i
    return table


_TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    """Class of each code point."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _TABLE[np.minimum(code, 127)], np.int8(2)).astype(np.int8)


def _allowed() -> np.ndarray:
    """Scores added to transitions: a tag inside a span follows only its own kind."""
    out = np.zeros((TAGS + 1, TAGS))  # the last row is the start
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = _FORBIDDEN
        out[[inside - 1, inside], inside] = 0
    return out


def _pass(x: np.ndarray, size: np.ndarray, wx: np.ndarray, wh: np.ndarray, back: bool, keep: bool):
    """LSTM states (steps, windows, HIDDEN) of x (steps, windows), windows of the given sizes; behind its end a window has state 0."""
    steps, n = x.shape
    out = np.zeros((steps, n, HIDDEN), np.float32)
    z, a = np.empty((n, 4 * HIDDEN), np.float32), np.empty((n, 4 * HIDDEN), np.float32)
    cell, bent, h = (np.zeros((n, HIDDEN), np.float32) for _ in range(3))
    short, kept = int(size.min()), []
    for s in range(steps - 1, -1, -1) if back else range(steps):
        np.take(wx, x[s], axis=0, out=z, mode="clip")
        z += h @ wh
        np.abs(z, out=a)
        a += 1
        z /= a
        gates = z[:, : 3 * HIDDEN]
        gates *= 0.5
        gates += 0.5
        before = cell.copy() if keep else None
        cell *= z[:, HIDDEN : 2 * HIDDEN]
        cell += z[:, :HIDDEN] * z[:, 3 * HIDDEN :]
        if s >= short:
            cell *= (size > s)[:, None]
        np.abs(cell, out=bent)
        bent += 1
        h = out[s]
        np.divide(cell, bent, out=h)
        if keep:
            kept.append((s, before, z.copy(), h.copy()))
        h *= z[:, 2 * HIDDEN : 3 * HIDDEN]
    return out, kept


def _back(x: np.ndarray, grad: np.ndarray, kept: list, out: np.ndarray, size: np.ndarray, wh: np.ndarray, back: bool):
    """Gradients of _pass's weights."""
    steps, n = x.shape
    dz = np.zeros((steps, n, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    hid = HIDDEN
    for s, c0, z, t in reversed(kept):
        live = (size > s)[:, None]
        i, f, o, g = (z[:, k * hid : (k + 1) * hid] for k in range(4))
        dh = (dh + grad[s]) * live
        dc = (dc + dh * o * (1 - np.abs(t)) ** 2) * live
        own = dz[s]
        for k, d in enumerate((dc * g, dc * c0, dh * t)):
            gate = z[:, k * hid : (k + 1) * hid]
            own[:, k * hid : (k + 1) * hid] = d * 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
        own[:, 3 * hid :] = dc * i * (1 - np.abs(g)) ** 2
        dh, dc = own @ wh.T, dc * f
    flat = dz.reshape(-1, 4 * hid)
    before = np.zeros_like(out)
    if back:
        before[:-1] = out[1:]
    else:
        before[1:] = out[:-1]
    one = np.zeros((steps * n, CLASSES), np.float32)
    one[np.arange(steps * n), x.reshape(-1)] = 1
    return one.T @ flat, before.reshape(-1, hid).T @ flat


def emissions(weights: dict, x: np.ndarray, size: np.ndarray, keep: bool = False):
    """Scores (steps, windows, tags) of windows of classes (steps, windows)."""
    ahead, ka = _pass(x, size, weights["fx"], weights["fh"], False, keep)
    behind, kb = _pass(x, size, weights["bx"], weights["bh"], True, keep)
    both = np.concatenate([ahead, behind], axis=2)
    return both @ weights["out"] + weights["bias"], both, ka, kb


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf(scores: np.ndarray, trans: np.ndarray, gold: np.ndarray, mask: np.ndarray):
    """Gradients of the negative log-likelihood: of the scores (steps, windows, tags) and of the transitions."""
    t, n, k = scores.shape
    alpha, beta = np.zeros((t, n, k)), np.zeros((t, n, k))
    alpha[0] = scores[0] + trans[-1]
    for s in range(1, t):
        alpha[s] = np.where(mask[s, :, None], _lse(alpha[s - 1][:, :, None] + trans[None, :-1], 1) + scores[s], alpha[s - 1])
    for s in range(t - 2, -1, -1):
        beta[s] = np.where(mask[s + 1, :, None], _lse(trans[None, :-1] + (scores[s + 1] + beta[s + 1])[:, None, :], 2), beta[s + 1])
    z = _lse(alpha[-1], 1)
    d = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
    dt = np.zeros_like(trans)
    dt[-1] = d[0].sum(axis=0)
    np.add.at(dt[-1], gold[0], -1)
    on = mask[1:]
    p = alpha[:-1][on][:, :, None] + trans[None, :-1] + (scores + beta)[1:][on][:, None, :]
    dt[:-1] += np.exp(p - np.broadcast_to(z, on.shape)[on][:, None, None]).sum(axis=0)
    np.add.at(dt, (gold[:-1][on], gold[1:][on]), -1)
    d[*np.nonzero(mask), gold[mask]] -= 1
    return d, dt


def viterbi(scores: np.ndarray, trans: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Best tags (rows, steps) of padded score rows."""
    n, t, k = scores.shape
    best = scores[:, 0] + trans[-1]
    back = np.zeros((t, n, k), np.int8)
    for s in range(1, t):
        step = best[:, :, None] + trans[None, :-1]
        back[s] = step.argmax(axis=1)
        new = np.take_along_axis(step, back[s][:, None, :].astype(np.int64), axis=1)[:, 0] + scores[:, s]
        best = np.where((s < length)[:, None], new, best)
    tags = np.zeros((n, t), np.int64)
    now = best.argmax(axis=1)
    rows = np.arange(n)
    for s in range(t - 1, -1, -1):
        now = np.where(s + 1 < length, back[min(s + 1, t - 1)][rows, now], now) if s + 1 < t else now
        tags[:, s] = now
    return tags


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a tag row."""
    out, at, kind = [], 0, -1
    for i, tag in enumerate([*tags.tolist(), 0]):
        if kind >= 0 and tag != 2 + 2 * kind:
            out.append((kind, at, i))
            kind = -1
        if tag % 2:
            at, kind = i, tag // 2
    return out


#: What sentences are made of: # is a digit, * a word, & a hexadecimal digit, ~ a number up to 255, $ a card's digits in fours.
_FORMS = (
    ("*@*.com", "*.*@*.org", "*##@*.de", "*_*@*-*.net", "*@*.co.uk", "* @ *.com", "*.* @ *.org", "*(at)*.com", "*.*(at)*.org", "* [at] * [dot] com", "*[at]*.de", "* (at) *.net", "*#@*.*"),
    ("~.~.~.~", "~.~.~.~", "~[.]~[.]~[.]~", "~ . ~ . ~ . ~", "&&&&:&&&:&:&:&:&&&&:&&:&&&&", "&&&&:&&&&:&&&&:&&&&:&&&&:&&&&:&&&&:&&&&"),
    ("$ $ $ $", "$-$-$-$", "$.$.$.$", "$/$/$/$", "$_$_$_$", "$$$$"),
    ("+## ### #######", "+# (###) ###-####", "(###) ###-####", "###-###-####", "###.###.####", "1-###-###-####", "00## ### ######", "00## ## #######", "0###-#######", "0###/#######", "0## ####### ##", "0## ########", "0# ## ## ## ##", "0#### ######", "0### ########", "### ### ####"),
)
_BEFORE = (
    ("mail ", "e-mail: ", "write to ", "contact ", "Mail an ", "courriel : ", "reach ", "address="),
    ("ip ", "host ", "server at ", "from ", "Adresse ", "ping ", "route "),
    ("card ", "visa: ", "Karte ", "credit card no. ", "carte ", "paid with ", "number "),
    ("call ", "tel: ", "phone ", "Tel. ", "telefon: ", "mobile ", "fax ", "ring me on ", "ruf ", "appelez le ", "or ", "me at ", ""),
)
_OTHERS = (
    'token = "&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&"', "key=&&&&&&&&&&&&&&&&", "token &&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&&", "version #.#.##", "v#.##", "##", "####", "######", "ISBN ###-#-##-######-#", "SBN ###-#-##-######-#", "ISBN ##########", "on ####-##-##",
    "##.##.####", "##/##/####", "at ##:##:##", "price #,###.##", "##.####, ##.####", "lat ##.######, lon ##.######", "order #########", "no. ############", "order number ############", "id ################", "pages ###-###", "pages ###-### and ###-###",
    "####-####", "## %", "chapter #.#.#", "@*", "at * dot *", "* @ ##", "* at *", "# ### ### ### people", "row #### #### ####", "### * !!!", "(####)", "##### - #####", "invoice ######## #### total #,###.##", "pi is #.##############", "build #####"
)
_BETWEEN = ("###", " ", ". ", "!! ", ",\n", " ", ") ", "; ", ".\n")


def _word(rng) -> str:
    return bytes(rng.integers(97, 123, rng.integers(1, 10), dtype=np.uint8)).decode()


def _filled(rng, form: str) -> str:
    card = rng.integers(0, 10, 15)
    check = -int(np.where(np.arange(15) % 2 == 0, card * 2 - 9 * (card > 4), card).sum()) % 10
    fours = iter("".join(map(str, [*card, check]))[k : k + 4] for k in (0, 4, 8, 12))
    digit = iter(rng.integers(0, 256, len(form)).tolist())
    fill = {"#": lambda: str(next(digit) % 10), "&": lambda: "0123456789abcdef"[next(digit) % 16], "~": lambda: str(next(digit)), "*": lambda: _word(rng), "$": lambda: next(fours)}
    return "".join(fill[c]() if c in fill else c for c in form)


def labelled(rng) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up sentence and its spans: personal data, and prose and numbers that are none."""
    pick = lambda of: of[rng.integers(0, len(of))]
    text, spans = "", []
    for _ in range(rng.integers(1, 4)):
        for _ in range(rng.integers(0, 7)):
            word = _word(rng)
            text += (word.capitalize() if rng.random() < 0.2 else "é" + word if rng.random() < 0.1 else word) + pick((" ", " ", " ", " ", ", ", ". ", "\n"))
        what = rng.random()
        if what < 0.4:
            kind = int(rng.integers(0, len(KINDS)))
            text += pick(_BEFORE[kind]) if rng.random() < 0.7 else ""
            found = _filled(rng, pick(_FORMS[kind]))
            spans.append((kind, len(text), len(text) + len(found)))
            text += found
        elif what < 0.8:
            text += _filled(rng, pick(_OTHERS))
        text += pick(_BETWEEN).replace("###", "###" if rng.random() < 0.5 else " ")
    return text, spans


def _batch(rng, n: int, size: int):
    """(classes, gold tags, lengths) of n sentences, cut at size."""
    x, gold, length = np.zeros((size, n), np.int8), np.zeros((size, n), np.int64), np.zeros(n, np.int64)
    for r in range(n):
        text, spans = labelled(rng)
        text = text[:size]
        length[r] = len(text)
        x[: len(text), r] = classes(text)
        for kind, a, b in spans:
            if a < size:
                gold[a, r] = 1 + 2 * kind
                gold[a + 1 : min(b, size), r] = 2 + 2 * kind
    return x, gold, length


_trained: dict[tuple[int, int], dict] = {}


def train(seed: int = 7, rounds: int = 300, size: int = 72, rows: int = 48) -> dict:
    """Weights, fitted by Adam; kept for the life of the process."""
    if (seed, rounds) in _trained:
        return _trained[seed, rounds]
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    w = {f"{d}{p}": init(*s) for d in "fb" for p, s in (("x", (CLASSES, 4 * HIDDEN)), ("h", (HIDDEN, 4 * HIDDEN)))}
    for d in "fb":  # a class's row holds the bias too; at first cells remember
        w[d + "x"][:, HIDDEN : 2 * HIDDEN] += 1
    w |= {"out": init(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS + 1, TAGS), np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    allowed = _allowed()
    for step in range(1, rounds + 1):
        x, gold, length = _batch(rng, rows, size)
        mask = np.arange(size)[:, None] < length
        scores, both, ka, kb = emissions(w, x, length, keep=True)
        d, dt = _crf(scores.astype(np.float64), w["trans"] + allowed, gold, mask)
        d = (d / rows).astype(np.float32)
        grad = {"out": both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, TAGS), "bias": d.sum(axis=(0, 1)), "trans": np.where(allowed < 0, 0, dt / rows)}
        up = d @ w["out"].T
        grad["fx"], grad["fh"] = _back(x, up[:, :, :HIDDEN], ka, both[:, :, :HIDDEN], length, w["fh"], False)
        grad["bx"], grad["bh"] = _back(x, up[:, :, HIDDEN:], kb, both[:, :, HIDDEN:], length, w["bh"], True)
        rate = 0.04 * min(1, 2 * (1 - step / (rounds + 1)))
        for k, g in grad.items():
            g = np.clip(g, -5, 5)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    w["trans"] = w["trans"] + allowed
    _trained[seed, rounds] = {k: v.astype(np.float32) for k, v in w.items()}
    return _trained[seed, rounds]


class Reader:
    """Tags of whole texts."""

    def __init__(self, weights: dict):
        self.weights, self.trans = weights, weights["trans"]
        fine = self.trans[self.trans > _FORBIDDEN / 2]
        #: A tag that is further than this below "outside" isn't worth two transitions.
        self.margin = 2 * float(fine.max() - fine.min())

    def scores(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """(length, tags) of each window of classes."""
        size = np.array([len(r) for r in rows])
        x = np.zeros((size.max(), len(rows)), np.int8)
        for i, r in enumerate(rows):
            x[: len(r), i] = r
        out = emissions(self.weights, x, size)[0]
        return [out[:n, i] for i, n in enumerate(size.tolist())]

    def spans(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) in each text of classes.

        Texts are scored in overlapping windows; each position takes the scores
        of the window in whose inside it lies deeper. The best tags are then
        those of whole stretches, across windows: a stretch ends where no tag
        but "outside" comes near over SHARED / 4 characters.
        """
        step = WINDOW - SHARED
        cut = [(len(x[a : a + WINDOW]), t, a) for t, x in enumerate(texts) for a in range(0, max(1, len(x) - SHARED), step) if len(x)]
        cut.sort()
        near: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
        while cut:  # the longest first
            some = cut[-max(1, min(ROWS, CELLS // cut[-1][0])) :]
            del cut[-len(some) :]
            for (n, t, a), got in zip(some, self.scores([texts[t][a : a + WINDOW] for _, t, a in some])):
                lo = SHARED // 2 if a else 0
                hi = n if a + n == len(texts[t]) else n - SHARED // 2
                own = got[lo:hi]
                if (own[:, 1:].max(axis=1) > own[:, 0] - self.margin).any():
                    near[t].append((a + lo, own.copy()))
        stretches: list[tuple[int, int, np.ndarray]] = []
        for t, parts in enumerate(near):
            parts.sort(key=lambda p: p[0])
            for joined in _touching(parts):
                start, own = joined[0][0], np.concatenate([p for _, p in joined])
                hot = np.flatnonzero(own[:, 1:].max(axis=1) > own[:, 0] - self.margin)
                edge = np.flatnonzero(np.diff(hot) > SHARED // 2)
                for lo, hi in zip(hot[np.concatenate([[0], edge + 1])], hot[np.concatenate([edge, [len(hot) - 1]])]):
                    lo, hi = max(0, lo - SHARED // 4), min(len(own), hi + 1 + SHARED // 4)
                    stretches.append((t, start + lo, own[lo:hi]))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        stretches.sort(key=lambda x: len(x[2]))
        for at in range(0, len(stretches), 256):
            some = stretches[at : at + 256]
            size = np.array([len(x) for _, _, x in some])
            padded = np.zeros((len(some), size.max(), TAGS), np.float32)
            for i, (_, _, x) in enumerate(some):
                padded[i, : size[i]] = x
            for (t, start, x), tags in zip(some, viterbi(padded, self.trans, size)):
                out[t] += [(k, start + a, start + b) for k, a, b in spans_of(tags[: len(x)])]
        return [sorted(x, key=lambda s: s[1:]) for x in out]


def _touching(parts: list[tuple[int, np.ndarray]]) -> list[list[tuple[int, np.ndarray]]]:
    """Runs of parts of which each begins where the one before ends."""
    out: list[list[tuple[int, np.ndarray]]] = []
    for part in parts:
        if out and out[-1][-1][0] + len(out[-1][-1][1]) == part[0]:
            out[-1].append(part)
        else:
            out.append([part])
    return out
