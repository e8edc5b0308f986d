"""A small causal self-attention model in numpy: one layer, class-factored output, trained by back-propagation.

A block scores ``STRIDE`` positions and sees ``STRIDE`` more before them, so consecutive blocks overlap and every token is
scored once with 17 to 32 tokens of context.
"""

from __future__ import annotations

import ctypes

import numpy as np

#: Positions scored by a block, positions of its window, width of the model and of its inner layer.
STRIDE, WINDOW, WIDTH, INNER = 16, 32, 16, 32
#: Known input ids (the most frequent; the others share one) and output classes.
INPUTS, CLASSES = 4096, 128

#: Which window positions each scored position may attend to.
CAUSAL = np.where(np.arange(WINDOW)[None, :] <= np.arange(STRIDE)[:, None] + WINDOW - STRIDE, 0.0, -1e9).astype(np.float32)
SCALE = np.float32(WIDTH**-0.5)
#: Sums as products, which are faster than reductions of short rows.
ONES, ONES_WIDE, ONE_PER_CLASS = np.ones((WINDOW, 1), dtype=np.float32), np.ones(WIDTH, dtype=np.float32), np.ones(CLASSES, dtype=np.float32)
#: Logits are at most this; positions whose classes are predicted at a time, so that their logits stay in a core's cache.
MOST, ROWS = 60, 256
SHAPES = {
    "E": (INPUTS, WIDTH), "P": (WINDOW, WIDTH), "Wq": (WIDTH, WIDTH), "Wk": (WIDTH, WIDTH), "Wv": (WIDTH, WIDTH), "Wo": (WIDTH, WIDTH),
    "W1": (WIDTH, INNER), "b1": (INNER,), "W2": (INNER, WIDTH), "U": (WIDTH, CLASSES), "b": (CLASSES,),
}
ENDS = np.cumsum([int(np.prod(s)) for s in SHAPES.values()]).tolist()
SIZE = ENDS[-1]
PARTS = [(name, begin, end, shape) for (name, shape), begin, end in zip(SHAPES.items(), [0, *ENDS], ENDS)]
#: Settings of glibc's mallopt: from which size memory is mapped by itself, and how much free memory is kept.
M_MMAP_THRESHOLD, M_TRIM_THRESHOLD = -3, -1


def keep_freed_memory() -> None:
    """Have the C library keep the memory of arrays that are freed, where it is glibc.

    Otherwise every step gets its arrays' pages from the system anew, which takes about as long as the arithmetic.
    """
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    mallopt(M_MMAP_THRESHOLD, 1 << 23)
    mallopt(M_TRIM_THRESHOLD, 1 << 25)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parts of a parameter vector."""
    return {name: flat[begin:end].reshape(shape) for name, begin, end, shape in PARTS}


def initial(class_log_share: np.ndarray) -> np.ndarray:
    """Small random weights; the output bias starts as the log share of each class."""
    flat = np.random.default_rng(11).normal(0, 0.15, SIZE).astype(np.float32)
    m = unpack(flat)
    m["P"][:] *= 0.3
    m["b1"][:] = 0
    m["b"][:] = class_log_share
    return flat


def exponentials(x: np.ndarray) -> None:
    """In place; logits stay far below the bound, which only keeps a diverging model finite."""
    np.exp(np.minimum(x, MOST, out=x), out=x)


def class_logits(o: np.ndarray, m: dict[str, np.ndarray]):
    """(begin, logits of the classes) of some positions, ``ROWS`` at a time.

    Only where the lengths of the vectors leave it open whether a logit passes the bound, all are held below it.
    """
    most = np.abs(m["b"]).max() + np.sqrt((o * o @ ONES_WIDE).max(initial=0) * (m["U"] ** 2).sum(axis=0).max())
    for i in range(0, len(o), ROWS):
        z = o[i : i + ROWS] @ m["U"]
        z += m["b"]
        if not most < MOST:
            np.minimum(z, MOST, out=z)
        yield i, z


def loss_and_gradient(flat: np.ndarray, ids: np.ndarray, valid: np.ndarray, target: np.ndarray):
    """Mean cross entropy of the targets [n, STRIDE] (-1: none) after windows [n, WINDOW], and its gradient.

    Sums of exponentials divide the narrow sides of products, not the exponentials.
    """
    m, n, flat2 = unpack(flat), len(ids), lambda y: y.reshape(-1, y.shape[-1])
    x = m["E"].take(ids, axis=0)
    x += m["P"]
    xq = np.ascontiguousarray(x[:, WINDOW - STRIDE :])
    X, XQ = flat2(x), flat2(xq)
    Wkv = np.concatenate([m["Wk"], m["Wv"]], axis=1)
    q, kv = (XQ @ (m["Wq"] * SCALE)).reshape(xq.shape), (X @ Wkv).reshape(n, WINDOW, 2 * WIDTH)
    k, v = kv[..., :WIDTH], kv[..., WIDTH:]
    a = q @ k.transpose(0, 2, 1)
    a += CAUSAL
    if not valid.all():
        a += np.where(valid, np.float32(0), np.float32(-1e9))[:, None, :]
    exponentials(a)
    per = 1 / flat2(a @ ONES)
    c = flat2(a @ v)
    c *= per
    h = c @ m["Wo"]
    h += XQ
    r = h @ m["W1"]
    r += m["b1"]
    np.maximum(r, 0, out=r)
    o = r @ m["W2"]
    o += h
    t = target.ravel()
    share = (t >= 0).astype(np.float32)
    share /= max(1, int(share.sum()))
    grad = np.zeros_like(flat)
    g = unpack(grad)
    do, loss = np.empty_like(o), 0.0
    UT = np.ascontiguousarray(m["U"].T)
    for i, p in class_logits(o, m):
        oi, ti, some, row = o[i : i + ROWS], t[i : i + ROWS], share[i : i + ROWS], np.arange(len(p))
        np.exp(p, out=p)
        total, picked = p @ ONE_PER_CLASS, p[row, ti]
        loss -= float((np.log(np.maximum(picked / total, 1e-30)) * some).sum())
        p[row, ti] = picked - total
        some = some / total
        g["U"] += (oi * some[:, None]).T @ p
        g["b"] += some @ p
        do[i : i + ROWS] = (p @ UT) * some[:, None]
    du = do @ m["W2"].T
    du *= r > 0
    ones = np.ones(len(t), dtype=np.float32)
    g["W2"][:], g["W1"][:], g["b1"][:] = r.T @ do, h.T @ du, ones @ du
    dh = do
    dh += du @ m["W1"].T
    dc = dh @ m["Wo"].T
    g["Wo"][:] = c.T @ dh
    dc *= per
    c *= dc
    mean = c @ ONES_WIDE
    dc = dc.reshape(n, STRIDE, WIDTH)
    ds, dkv = dc @ v.transpose(0, 2, 1), np.empty_like(kv)
    np.matmul(a.transpose(0, 2, 1), dc, out=dkv[..., WIDTH:])
    ds -= mean.reshape(n, STRIDE, 1)
    ds *= a
    dq = flat2(ds @ k)
    dq *= SCALE
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :WIDTH])
    DKV = flat2(dkv)
    both = X.T @ DKV
    g["Wq"][:], g["Wk"][:], g["Wv"][:] = XQ.T @ dq, both[:, :WIDTH], both[:, WIDTH:]
    dx = (DKV @ Wkv.T).reshape(x.shape)
    dh += dq @ m["Wq"].T
    dx[:, WINDOW - STRIDE :] += dh.reshape(xq.shape)
    g["P"][:] = dx.sum(axis=0)
    at = (ids.ravel().astype(np.int64) * WIDTH)[:, None] + np.arange(WIDTH)
    g["E"][:] = np.bincount(at.ravel(), dx.ravel(), INPUTS * WIDTH).reshape(INPUTS, WIDTH)
    return loss, grad


class Adam:
    """Moves a parameter vector in place; gradients that are given are used up."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.mean, self.square, self.spare, self.step = flat, np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat), 0

    def move(self, g: np.ndarray, rate: float) -> None:
        self.step += 1
        x, large = self.spare, (1 - 0.99**self.step) ** 0.5
        np.multiply(g, g, out=x)
        x -= self.square
        x *= 0.01
        self.square += x
        g -= self.mean
        g *= 0.1
        self.mean += g
        np.sqrt(self.square, out=x)
        x += 1e-8 * large
        np.divide(self.mean, x, out=x)
        x *= rate * large / (1 - 0.9**self.step)
        self.flat -= x


def numpy_gradient(flat: np.ndarray, ids: np.ndarray, valid: np.ndarray, target: np.ndarray) -> np.ndarray:
    return loss_and_gradient(flat, ids, valid, target)[1]


def train(flat: np.ndarray, ids: np.ndarray, valid: np.ndarray, target: np.ndarray, epochs: int, rate: float, batch: int = 64, gradient=numpy_gradient) -> np.ndarray:
    """Adam over shuffled batches with a rate that falls to a tenth."""
    keep_freed_memory()
    adam, rng, steps = Adam(flat.copy()), np.random.default_rng(5), max(1, epochs * -(-len(ids) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for i in range(0, len(ids), batch):
            some = order[i : i + batch]
            adam.move(gradient(adam.flat, ids[some], valid[some], target[some]), rate * (1 - 0.9 * (adam.step + 1) / steps))
    return adam.flat


class Learner:
    """Adam over windows that come in pools, for as long as they come; the rate falls with the steps taken to a tenth."""

    def __init__(self, flat: np.ndarray, rate: float, batch: int = 64, gradient=numpy_gradient):
        keep_freed_memory()
        self.flat, self.rate, self.batch, self.gradient = flat.copy(), rate, batch, gradient
        self.adam, self.rng, self.seen = Adam(self.flat), np.random.default_rng(5), 0

    def learn(self, ids: np.ndarray, valid: np.ndarray, target: np.ndarray) -> None:
        order = self.rng.permutation(len(ids))
        for i in range(0, len(ids), self.batch):
            some = order[i : i + self.batch]
            g = self.gradient(self.flat, ids[some], valid[some], target[some])
            self.adam.move(g, self.rate * max(0.1, 1 / (1 + (self.adam.step + 1) / 500)))
        self.seen += len(ids)


class Scorer:
    """The forward pass alone, with the projections of all input ids made once."""

    def __init__(self, flat: np.ndarray):
        keep_freed_memory()
        self.m = m = unpack(flat)
        self.KV = m["E"] @ np.concatenate([m["Wk"], m["Wv"]], axis=1)
        self.PKV = m["P"] @ np.concatenate([m["Wk"], m["Wv"]], axis=1)
        self.QE = np.concatenate([m["E"] @ (m["Wq"] * SCALE), m["E"]], axis=1)
        self.PQE = np.concatenate([m["P"] @ (m["Wq"] * SCALE), m["P"]], axis=1)[WINDOW - STRIDE :]

    def block_scores(self, ids: np.ndarray, valid: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the class probability of each target [n, STRIDE] after windows [n, WINDOW]."""
        m = self.m
        kv, qe = self.KV.take(ids, axis=0), self.QE.take(ids[:, WINDOW - STRIDE :], axis=0)
        kv += self.PKV
        qe += self.PQE
        s = qe[..., :WIDTH] @ kv[..., :WIDTH].transpose(0, 2, 1)
        s += CAUSAL
        if not valid.all():
            s += np.where(valid, np.float32(0), np.float32(-1e9))[:, None, :]
        exponentials(s)
        c = s @ kv[..., WIDTH:]
        c /= s @ ONES
        h = c.reshape(-1, WIDTH) @ m["Wo"]
        h += qe[..., WIDTH:].reshape(-1, WIDTH)
        r = h @ m["W1"]
        r += m["b1"]
        np.maximum(r, 0, out=r)
        h += r @ m["W2"]
        t, out = target.ravel(), np.empty(len(h), np.float32)
        for i, z in class_logits(h, m):
            picked = z[np.arange(len(z)), t[i : i + ROWS]]
            np.exp(z, out=z)
            out[i : i + ROWS] = picked - np.log(z @ ONE_PER_CLASS)
        return out.reshape(target.shape)
