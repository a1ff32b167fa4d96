"""Small models as ONNX files, written without the onnx package: the few messages of its protocol buffers that they need."""

from __future__ import annotations

import numpy as np

# The format's numbers for element types and attribute kinds.
FLOAT, INT64 = 1, 7
A_INT, A_INTS = 2, 7


def _varint(n: int) -> bytes:
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    """One field: an integer as such, text and messages by length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def _tensor(name: str, a: np.ndarray) -> bytes:
    kind = INT64 if a.dtype.kind == "i" else FLOAT
    raw = a.astype("<i8" if kind == INT64 else "<f4").tobytes()
    return b"".join(_field(1, int(d)) for d in a.shape) + _field(2, kind) + _field(8, name) + _field(9, raw)


def _value(name: str, shape: list) -> bytes:
    """A float tensor; sizes given as text are free."""
    dims = b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in shape)
    return _field(1, name) + _field(2, _field(1, _field(1, FLOAT) + _field(2, dims)))


def _node(kind: str, inputs: list[str], output: str, **attributes) -> bytes:
    out = b"".join(_field(1, i) for i in inputs) + _field(2, output) + _field(4, kind)
    for name, v in attributes.items():
        body = b"".join(_field(8, x) for x in v) + _field(20, A_INTS) if isinstance(v, list) else _field(3, v) + _field(20, A_INT)
        out += _field(5, _field(1, name) + body)
    return out


def _model(nodes: list[bytes], constants: dict[str, np.ndarray], given: bytes, made: bytes) -> bytes:
    graph = b"".join(_field(1, n) for n in nodes) + _field(2, "g") + b"".join(_field(5, _tensor(k, a)) for k, a in constants.items()) + _field(11, given) + _field(12, made)
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


def linear(mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> bytes:
    """Rows of features, standardised, to rows of logits."""
    nodes = [_node("Sub", ["x", "mean"], "a"), _node("Div", ["a", "scale"], "b"), _node("Gemm", ["b", "w", "c"], "y")]
    return _model(nodes, {"mean": mean, "scale": scale, "w": weights, "c": bias}, _value("x", ["n", len(mean)]), _value("y", ["n", len(bias)]))


def bright_cells(size: int, cell: int) -> bytes:
    """A detector of fixed size whose head has suppressed already: (1, n, 6), a box a cell, its confidence the cell's mean brightness."""
    k = size // cell
    y, x = (np.mgrid[:k, :k] * cell).reshape(2, -1)
    boxes = np.stack([x, y, x + cell, y + cell], 1)[None].astype(np.float32)
    nodes = [_node("AveragePool", ["x"], "p", kernel_shape=[cell, cell], strides=[cell, cell]), _node("ReduceMean", ["p"], "m", axes=[1], keepdims=1), _node("Reshape", ["m", "shape"], "s"), _node("Concat", ["boxes", "s", "kind"], "y", axis=2)]
    constants = {"shape": np.array([1, k * k, 1], np.int64), "boxes": boxes, "kind": np.zeros((1, k * k, 1), np.float32)}
    return _model(nodes, constants, _value("x", [1, 3, size, size]), _value("y", [1, k * k, 6]))
