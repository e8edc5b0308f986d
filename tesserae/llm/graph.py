"""The attention model as ONNX graphs: its gradient and its scores in one call each, with products that take small matrices.

The graphs compute what ``attention.loss_and_gradient`` and ``attention.Scorer`` do in numpy, which stays in use where
onnxruntime is not installed.  They are written as protocol buffers here, so the ``onnx`` package is not needed.
"""

from __future__ import annotations

import functools

import numpy as np

from tesserae.llm import attention as A

try:
    import onnxruntime
except ImportError:  # numpy does the work
    onnxruntime = None

FLOAT, INT64 = 1, 7
KINDS = {np.dtype(np.float32): FLOAT, np.dtype(np.int64): INT64}
LATE = A.WINDOW - A.STRIDE


def number(n: int) -> bytes:
    """A protocol buffer's variable-length integer."""
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def field(k: int, value: int | bytes | str) -> bytes:
    if isinstance(value, int):
        return number(k << 3) + number(value)
    value = value.encode() if isinstance(value, str) else value
    return number(k << 3 | 2) + number(len(value)) + value


def attribute(name: str, value) -> bytes:
    """Of a node: a float, an integer, a string or a list of integers."""
    if isinstance(value, float):
        return field(1, name) + number(2 << 3 | 5) + np.float32(value).tobytes() + field(20, 1)
    if isinstance(value, str):
        return field(1, name) + field(4, value) + field(20, 3)
    if isinstance(value, int):
        return field(1, name) + field(3, value) + field(20, 2)
    return field(1, name) + b"".join(field(8, x) for x in value) + field(20, 7)


class Graph:
    """Nodes, constants and inputs of a graph; names are given out by number."""

    def __init__(self):
        self.nodes, self.constants, self.inputs, self.names = [], [], [], 0

    def name(self) -> str:
        self.names += 1
        return f"t{self.names}"

    def input(self, name: str, kind: int, rank: int) -> str:
        shape = b"".join(field(1, field(2, f"{name}{i}")) for i in range(rank))
        self.inputs.append(field(1, name) + field(2, field(1, field(1, kind) + field(2, shape))))
        return name

    def constant(self, value) -> str:
        value = np.ascontiguousarray(value) if isinstance(value, np.ndarray) else np.array(value, dtype=np.int64)
        name = self.name()
        self.constants.append(b"".join(field(1, d) for d in value.shape) + field(2, KINDS[value.dtype]) + field(8, name) + field(9, value.tobytes()))
        return name

    def node(self, kind: str, *inputs: str, outputs: int = 0, domain: str = "", **attributes):
        """The output's name, or a list of names if their number is given."""
        names = [self.name() for _ in range(outputs or 1)]
        ends = b"".join(field(1, x) for x in inputs) + b"".join(field(2, x) for x in names)
        self.nodes.append(ends + field(4, kind) + b"".join(field(5, attribute(k, v)) for k, v in attributes.items()) + field(7, domain))
        return names if outputs else names[0]

    def shaped(self, x: str, *shape: int) -> str:
        return self.node("Reshape", x, self.constant(shape))

    def product(self, x: str, y: str, add: str = "", first: int = 0, second: int = 0) -> str:
        """Of matrices, of which the first or the second may be turned, and what is added to it."""
        return self.node("Gemm", x, y, *([add] if add else []), transA=first, transB=second)

    def products(self, x: str, y: str, first: int = 0, second: int = 0, by: float = 1.0) -> str:
        """Of many matrices each."""
        return self.node("FusedMatMul", x, y, domain="com.microsoft", transA=first, transB=second, alpha=by)

    def session(self, output: str):
        info = field(1, output) + field(2, field(1, field(1, FLOAT)))
        body = b"".join(field(1, x) for x in self.nodes) + field(2, "attention") + b"".join(field(5, x) for x in self.constants)
        body += b"".join(field(11, x) for x in self.inputs) + field(12, info)
        sets = field(8, field(1, "") + field(2, 17)) + field(8, field(1, "com.microsoft") + field(2, 1))
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1  # a task has one core
        options.log_severity_level = 3
        return onnxruntime.InferenceSession(field(1, 8) + field(7, body) + sets, options, providers=["CPUExecutionProvider"])


def forward(g: Graph, flat: str) -> dict[str, str]:
    """Nodes up to the logits, which have a row per position; ``hide`` is added to what a window's positions attend to."""
    parts = g.node("Split", flat, g.constant([end - begin for _, begin, end, _ in A.PARTS]), outputs=len(A.PARTS), axis=0)
    m = {name: g.shaped(x, *shape) for (name, _, _, shape), x in zip(A.PARTS, parts)}
    ids, hide = g.input("ids", INT64, 2), g.input("hide", FLOAT, 3)
    m["x"] = g.node("Add", g.node("Gather", m["E"], ids), m["P"])
    m["xq"] = g.node("Slice", m["x"], *map(g.constant, ([LATE], [A.WINDOW], [1])))
    m["X"], m["XQ"] = g.shaped(m["x"], -1, A.WIDTH), g.shaped(m["xq"], -1, A.WIDTH)
    scaled = g.node("Mul", m["Wq"], g.constant(np.array(A.SCALE)))
    wide, late = lambda y: g.shaped(y, -1, A.WINDOW, A.WIDTH), lambda y: g.shaped(y, -1, A.STRIDE, A.WIDTH)
    m["q"], m["k"], m["v"] = late(g.product(m["XQ"], scaled)), wide(g.product(m["X"], m["Wk"])), wide(g.product(m["X"], m["Wv"]))
    a = g.node("Add", g.products(m["q"], m["k"], second=1), g.node("Add", hide, g.constant(A.CAUSAL)))
    m["a"] = g.node("Softmax", a, axis=-1)
    m["c"] = g.products(m["a"], m["v"])
    m["C"] = g.shaped(m["c"], -1, A.WIDTH)
    m["h"] = g.product(m["C"], m["Wo"], m["XQ"])
    m["r"] = g.node("Relu", g.product(m["h"], m["W1"], m["b1"]))
    m["o"] = g.product(m["r"], m["W2"], m["h"])
    m["z"] = g.product(m["o"], m["U"], m["b"])
    return m


@functools.cache
def gradient_session():
    """Inputs: flat, ids, hide, place (of the targets among all logits) and share (of each in the mean); output: gradient."""
    g = Graph()
    m = forward(g, g.input("flat", FLOAT, 1))
    share, place = g.input("share", FLOAT, 2), g.input("place", INT64, 2)
    less = g.node("Expand", g.constant(np.full(1, -1, np.float32)), g.node("Shape", g.shaped(share, -1)))
    p = g.shaped(g.node("Softmax", m["z"], axis=-1), -1)
    dz = g.shaped(g.node("ScatterND", p, place, less, reduction="add"), -1, A.CLASSES)  # times the shares, by which narrow sides are multiplied
    wide, late = lambda y: g.shaped(y, -1, A.WINDOW, A.WIDTH), lambda y: g.shaped(y, -1, A.STRIDE, A.WIDTH)
    total = lambda y, axis, keep=0: g.node("ReduceSum", y, g.constant([axis]), keepdims=keep)
    d = {"U": g.product(g.node("Mul", m["o"], share), dz, first=1), "b": g.product(share, dz, first=1)}
    do = g.node("Mul", g.product(dz, m["U"], second=1), share)
    none = g.constant(np.zeros(1, np.float32))
    du = g.node("Where", g.node("Greater", m["r"], none), g.product(do, m["W2"], second=1), none)
    d |= {"W2": g.product(m["r"], do, first=1), "W1": g.product(m["h"], du, first=1), "b1": total(du, 0)}
    dh = g.product(du, m["W1"], do, second=1)
    dC = g.product(dh, m["Wo"], second=1)
    d["Wo"] = g.product(m["C"], dh, first=1)
    dc = late(dC)
    mean = total(g.node("Mul", m["c"], dc), 2, 1)
    ds = g.node("Mul", g.node("Sub", g.products(dc, m["v"], second=1), mean), m["a"])
    dv, dk = (g.shaped(g.products(x, y, first=1), -1, A.WIDTH) for x, y in ((m["a"], dc), (ds, m["q"])))
    dq = g.shaped(g.products(ds, m["k"], by=float(A.SCALE)), -1, A.WIDTH)
    d |= {"Wq": g.product(m["XQ"], dq, first=1), "Wk": g.product(m["X"], dk, first=1), "Wv": g.product(m["X"], dv, first=1)}
    dx = wide(g.product(dv, m["Wv"], g.product(dk, m["Wk"], second=1), second=1))
    own = late(g.product(dq, m["Wq"], dh, second=1))
    before, after = g.node("Split", dx, g.constant([LATE, A.STRIDE]), outputs=2, axis=1)
    dx = g.node("Concat", before, g.node("Add", after, own), axis=1)
    d["P"] = total(dx, 0)
    d["E"] = g.node("ScatterND", g.constant(np.zeros((A.INPUTS, A.WIDTH), np.float32)), g.shaped("ids", -1, 1), g.shaped(dx, -1, A.WIDTH), reduction="add")
    return g.session(g.node("Concat", *(g.shaped(d[name], -1) for name in A.SHAPES), axis=0))


def hidden(valid: np.ndarray) -> np.ndarray:
    if valid.all():
        return np.zeros((1, 1, A.WINDOW), np.float32)
    return np.where(valid, np.float32(0), np.float32(-1e9))[:, None, :]


def gradient(flat: np.ndarray, ids: np.ndarray, valid: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of the mean cross entropy, as ``attention.loss_and_gradient`` has it."""
    t = target.ravel()
    known = t >= 0
    share = known.astype(np.float32)
    share /= max(1, int(np.count_nonzero(known)))
    place = np.arange(0, len(t) * A.CLASSES, A.CLASSES) + np.maximum(t, 0)
    return gradient_session().run(None, {"flat": flat, "ids": ids.astype(np.int64), "hide": hidden(valid), "share": share[:, None], "place": place[:, None]})[0]


class Scorer:
    """As ``attention.Scorer``; the weights are constants of its graph."""

    def __init__(self, flat: np.ndarray):
        g = Graph()
        m = forward(g, g.constant(flat))
        self.session = g.session(g.node("GatherElements", g.node("LogSoftmax", m["z"], axis=-1), g.input("target", INT64, 2), axis=1))

    def block_scores(self, ids: np.ndarray, valid: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the class probability of each target [n, STRIDE] after windows [n, WINDOW]."""
        given = {"ids": ids.astype(np.int64), "hide": hidden(valid), "target": target.reshape(-1, 1).astype(np.int64)}
        return self.session.run(None, given)[0].reshape(target.shape)


@functools.cache
def fastest():
    """The gradient and the scorer to use: the graphs', if onnxruntime is there and takes them, else numpy's."""
    if onnxruntime is not None:
        try:
            gradient_session()
            Scorer(A.initial(np.zeros(A.CLASSES, np.float32)))
        except Exception:  # its errors share no class; a version without one of the nodes' kinds
            return A.numpy_gradient, A.Scorer
        return gradient, Scorer
    return A.numpy_gradient, A.Scorer
