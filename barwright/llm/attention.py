"""A small causal self-attention language model in numpy, over symbols.

One attention layer with a learned bias per distance reads the window before a symbol; its result joins the symbol's
embedding in a hidden layer, which predicts the next symbol in two steps, its class and its place in the class. Everything is batched:
windows of one length, masked, so a step is a few matrix products.
"""

from functools import cache

import numpy as np

CLASSES, MEMBERS = 32, 64
SYMBOLS = CLASSES * MEMBERS
DIM, HIDDEN, WINDOW = 16, 48, 32
#: Classes with at most so many targets in a step share one batched product.
PADDED = 24
#: Windows whose attention scoring works out together, rows of a class that it takes together, and weights that a step of Adam changes
#: together, so few that they stay in a core's cache.
BATCH, TOGETHER, CACHED = 80, 1024, 1 << 14
#: Bounds on sums of exponentials beyond which values are shifted first.
SMALL, LARGE = np.exp(-60), np.exp(60)


def initial(counts, seed=5, dim=DIM, hidden=HIDDEN, window=WINDOW):
    """Weights; output biases start at the log frequencies of the symbols (``counts`` by symbol, over the whole corpus).

    The last rows of ``w``, ``uc`` and ``um`` are biases, which multiply a one, so that no pass of their own adds them or sums their gradients.
    """
    rng = np.random.default_rng(seed)
    normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    c = (np.asarray(counts, float) + 0.5).reshape(CLASSES, MEMBERS)
    p = {
        "emb": normal(SYMBOLS, dim, scale=0.3), "q": normal(dim, dim, scale=dim ** -0.5), "k": normal(dim, dim, scale=dim ** -0.5), "v": normal(dim, dim, scale=dim ** -0.5),
        "far": (-0.2 * np.arange(window)).astype(np.float32), "w": normal(2 * dim, hidden, scale=(2 * dim) ** -0.5),
        "uc": normal(hidden, CLASSES, scale=0.05), "um": normal(CLASSES, hidden, MEMBERS, scale=0.05),
    }
    for k, bias in (("w", np.zeros(hidden)), ("uc", np.log(c.sum(1) / c.sum())), ("um", np.log(c / c.sum(1, keepdims=True))[:, None])):
        p[k] = np.concatenate([p[k], bias.reshape(*p[k].shape[:-2], 1, -1)], -2, dtype=np.float32)
    return p


def distances(queries, window):
    """Distance of each key from each of the last ``queries`` positions of a window; negative where the mask hides it."""
    return np.arange(window - queries, window)[:, None] - np.arange(window)[None, :]


@cache
def _ones(n, kind):
    return np.ones(n, kind)


def _exps(values):
    """Exponentials along the last axis, their sums, and what was taken from the values before, which is 0 unless sums come out too large or small.

    ``values`` makes the values anew, in an array that may be overwritten.
    """
    x = values()
    ones = _ones(x.shape[-1], x.dtype)
    total = np.exp(x, out=x) @ ones
    if SMALL < total.min(initial=1) and total.max(initial=1) < LARGE:
        return x, total, 0
    x = values()
    top = x.max(-1, keepdims=True)
    x -= top
    return x, np.exp(x, out=x) @ ones, top[..., 0]


def tables(p):
    """What a symbol brings to each place, worked out once per symbol: query, key beside value and its share of the hidden layer."""
    dim = p["emb"].shape[1]
    return {"q": p["emb"] @ p["q"] * np.float32(dim ** -0.5), "kv": p["emb"] @ np.concatenate([p["k"], p["v"]], 1), "e": p["emb"] @ p["w"][:dim] + p["w"][-1], "w": p["w"][dim:-1],
            **{c: p[c] for c in ("far", "uc", "um")}}


@np.errstate(over="ignore")
def log_probs(t, x, y, queries):
    """Natural log probability of the symbol that follows each of the last ``queries`` positions (y: windows x queries), from tables."""
    dim, hidden = t["w"].shape
    d = distances(queries, x.shape[1])
    bias = np.where(d >= 0, t["far"][np.maximum(d, 0)], np.float32(-1e9))
    last, context = x[:, -queries:], np.empty((*y.shape, dim), np.float32)
    for i in range(0, len(x), BATCH):
        q, kv = t["q"].take(last[i:i + BATCH], 0), t["kv"].take(x[i:i + BATCH], 0)

        def values():
            s = np.matmul(q, kv[..., :dim].transpose(0, 2, 1))  # noqa: B023
            s += bias
            return s
        s, total, _ = _exps(values)
        np.divide(np.matmul(s, kv[..., dim:]), total[..., None], out=context[i:i + BATCH])
    last, context, y = last.reshape(-1), context.reshape(-1, dim), y.reshape(-1)
    cls = (y // MEMBERS).astype(np.uint8)
    order = np.argsort(cls, kind="stable")  # by class, so that each class is one matrix product, or a few
    last, mem = last[order], (y % MEMBERS)[order]
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
    out, every, ones = np.empty(len(y), np.float32), np.arange(TOGETHER), np.ones((TOGETHER, hidden + 1), np.float32)
    for c in range(CLASSES):
        for a in range(bounds[c], bounds[c + 1], TOGETHER):
            b = min(a + TOGETHER, bounds[c + 1])
            pre = context.take(order[a:b], 0) @ t["w"]
            pre += t["e"].take(last[a:b], 0)
            h = ones[:b - a]
            np.maximum(pre, 0, out=h[:, :-1])
            out[order[a:b]] = _right(h, t["uc"], (every[:b - a], c)) + _right(h, t["um"][c], (every[:b - a], mem[a:b]))
    return out.reshape(-1, queries)


def _right(h, u, at):
    """Log of the softmax of each row of h @ u at its place ``at``."""
    right = []

    def values():
        x = h @ u
        right.append(x[at])
        return x
    _, total, top = _exps(values)
    return right[0] - np.log(total) - top


def _softmax_loss(values, at, scale, every):
    """Gradient of the scaled losses by the values that ``values`` makes, whose right ones lie ``at``, and the sum of the losses."""
    right, every = [], every[:len(at)]

    def first():
        x = values()
        right.append(x[every, at])
        return x
    x, total, top = _exps(first)
    x *= (scale / total)[:, None]
    x[every, at] -= scale
    return x, ((np.log(total) + top - right[0]) * scale).sum()


@np.errstate(over="ignore")
def gradients(p, x, y, m, g=None):
    """Mean loss over the masked positions and its gradient by weight, written into ``g`` if given."""
    (n, t), dim, hidden, kind = x.shape, p["emb"].shape[1], p["uc"].shape[0] - 1, p["emb"].dtype
    if g is None:
        g = {k: np.empty_like(v) for k, v in p.items()}
    # attention; queries come scaled
    e = p["emb"].take(x, 0)
    ef = e.reshape(-1, dim)
    shrink = kind.type(dim ** -0.5)
    wide = np.concatenate([p["q"] * shrink, p["k"], p["v"]], 1)
    qkv = (ef @ wide).reshape(n, t, -1)
    q, k, v = qkv[..., :dim], qkv[..., dim:2 * dim], qkv[..., 2 * dim:]
    d = distances(t, t)
    bias = np.where(d >= 0, p["far"][np.maximum(d, 0)], kind.type(-1e9))

    def attention():
        s = np.matmul(q, k.transpose(0, 2, 1))
        s += bias
        return s
    a, total, _ = _exps(attention)
    a /= total[..., None]
    z = np.ones((n, t, 2 * dim + 1), kind)
    z[..., :dim] = e
    ctx = np.matmul(a, v)
    z[..., dim:-1] = ctx
    zf = z.reshape(n * t, -1)
    # hidden layer and what follows it
    h = np.ones((n * t, hidden + 1), kind)
    np.maximum(zf @ p["w"], 0, out=h[:, :-1])
    scale = (m / max(m.sum(), 1)).reshape(-1).astype(kind)
    yf = y.reshape(-1)
    cls = (yf // MEMBERS).astype(np.uint8)
    order = np.argsort(cls, kind="stable")  # by class, so that each class is one matrix product
    cls, mem, hs, sc = cls[order], (yf % MEMBERS)[order], h.take(order, 0), scale[order]
    every = np.arange(len(cls))
    dc, loss = _softmax_loss(lambda: hs @ p["uc"], cls, sc, every)
    np.matmul(hs.T, dc, out=g["uc"])
    ds = dc @ p["uc"][:-1].T
    bounds = np.searchsorted(cls, np.arange(CLASSES + 1))
    sizes = np.diff(bounds)
    for c in np.nonzero(sizes > PADDED)[0].tolist():
        i, j = bounds[c], bounds[c + 1]
        dm, lost = _softmax_loss(lambda: hs[i:j] @ p["um"][c], mem[i:j], sc[i:j], every)  # noqa: B023
        loss += lost
        np.matmul(hs[i:j].T, dm, out=g["um"][c])
        ds[i:j] += dm @ p["um"][c, :-1].T
    few = np.nonzero(sizes <= PADDED)[0]
    width = int(sizes[few].max(initial=0))
    if width:  # one batched product; places beyond a class's size hold a row that counts nothing
        some = slice(few[0], few[-1] + 1) if few[-1] - few[0] + 1 == len(few) else few  # as a rule the last classes, whose weights need no copy then
        used = np.arange(width) < sizes[few, None]
        rows = np.where(used, bounds[few, None] + np.arange(width), 0)
        hp, um, real = hs.take(rows, 0), p["um"][some], rows[used]
        dm, lost = _softmax_loss(lambda: np.matmul(hp, um)[used], mem[real], sc[real], every)
        loss += lost
        padded = np.zeros((*rows.shape, MEMBERS), kind)
        padded[used] = dm
        g["um"][some] = np.matmul(hp.transpose(0, 2, 1), padded)
        ds[real] += np.matmul(padded, um[:, :-1].transpose(0, 2, 1))[used]
    else:
        g["um"][few] = 0
    dh = np.empty_like(ds)
    dh[order] = ds
    dh *= h[:, :-1] > 0
    np.matmul(zf.T, dh, out=g["w"])
    dz = (dh @ p["w"][:-1].T).reshape(n, t, -1)
    # attention again
    dctx = dz[..., dim:]
    ds = np.matmul(dctx, v.transpose(0, 2, 1))
    ds -= np.einsum("wid,wid->wi", dctx, ctx)[..., None]
    ds *= a
    per = ds.sum(0)
    g["far"][:] = np.bincount(d[d >= 0], weights=per[d >= 0], minlength=len(p["far"]))
    back = np.concatenate([np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q), np.matmul(a.transpose(0, 2, 1), dctx)], -1).reshape(n * t, -1)
    gw = ef.T @ back
    g["q"][:], g["k"][:], g["v"][:] = gw[:, :dim] * shrink, gw[:, dim:2 * dim], gw[:, 2 * dim:]
    de = back @ wide.T
    de += dz[..., :dim].reshape(-1, dim)
    at = x.reshape(-1, 1) * dim + np.arange(dim)
    g["emb"].reshape(-1)[:] = np.bincount(at.ravel(), weights=de.ravel(), minlength=p["emb"].size)
    return float(loss), g


def fresh(p):
    """State of training before its first step: weights, both moments of Adam and the number of steps taken.

    Each part's arrays are views of one vector (``flat``), so that a step is a few passes over it; ``grad`` is where a step writes its gradient.
    """
    return _state([np.concatenate([p[k].ravel() for k in sorted(p)]), *np.zeros((2, sum(v.size for v in p.values())), np.float32)], p, 0)


def _state(vectors, like, step):
    out = {"step": step, "flat": dict(zip((*PARTS, "grad"), [*vectors, np.zeros_like(vectors[0])]))}
    for part, v in out["flat"].items():
        out[part], at = {}, 0
        for k in sorted(like):
            out[part][k] = v[at:at + like[k].size].reshape(like[k].shape)
            at += like[k].size
    return out


#: The moments are sums of falling weight (10 and 100 times the usual averages), so that a step scales nothing.
PARTS = ("p", "first", "second")


def descend(state, x, y, m, rate):
    """One step of Adam on windows (x, y, m), in place; their mean loss before it."""
    loss, _ = gradients(state["p"], x, y, m, state["grad"])
    state["step"] += 1
    step = state["step"]
    root = (0.01 / (1 - 0.99 ** step)) ** 0.5
    rate, least = np.float32(rate * 0.1 / (1 - 0.9 ** step) / root), np.float32(1e-8 / root)
    vectors = [state["flat"][part] for part in (*PARTS, "grad")]
    for i in range(0, len(vectors[0]), CACHED):
        p, first, second, g = (v[i:i + CACHED] for v in vectors)
        first *= np.float32(0.9)
        first += g
        np.multiply(g, g, out=g)
        second *= np.float32(0.99)
        second += g
        np.sqrt(second, out=g)
        g += least
        np.divide(first, g, out=g)
        g *= rate
        p -= g
    return loss


def falling(rate, step, done):
    """The rate of a step: it rises over 50 steps and falls with the share of the work that is done."""
    return rate * min(1, step / 50) * (1 - 0.95 * done)


def train(p, x, y, m, epochs=3, batch=256, rate=4e-3, seed=11):
    """Adam over windows (x, y, m) with a falling rate; the weights after it and the mean loss of the last epoch."""
    rng, state = np.random.default_rng(seed), fresh(p)
    total, losses = max(1, epochs * -(-len(x) // batch)), []
    for _ in range(epochs):
        order, losses = rng.permutation(len(x)), []
        for i in range(0, len(x), batch):
            rows, step = order[i:i + batch], state["step"] + 1
            losses.append(descend(state, x[rows], y[rows], m[rows], falling(rate, step, step / total)))
    return state["p"], float(np.mean(losses)) if losses else float("nan")


def packed(state):
    """Weights and moments as one vector of single precision."""
    return np.concatenate([state["flat"][part] for part in PARTS])


def unpacked(v, like, step):
    """The state that ``packed`` made a vector of; ``like`` are weights of its shapes."""
    return _state(np.split(v.astype(np.float32), len(PARTS)), like, step)


def windows(symbols, start, stride, window=WINDOW):
    """Overlapping windows over a sequence: inputs, next symbols of the last ``stride`` positions, and which of them count.

    ``start`` is the context before the first symbol. Each symbol is the target of exactly one window; every window but
    the first ones sees at least ``window - stride`` symbols before each target.
    """
    n = len(symbols)
    count = -(-n // stride)
    first = window - stride + 1  # where the first target lies: the first window's last ``stride`` positions precede the first targets
    padded = np.full(count * stride + first, start, np.int64)
    padded[first:first + n] = symbols
    at = np.arange(count)[:, None] * stride
    x = padded[at + np.arange(window)]
    y = padded[at + np.arange(window - stride, window) + 1]
    return x, y, (at + np.arange(stride)) < n
