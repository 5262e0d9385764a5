"""Causal attention over item sequences, with gaps in time as part of the input.

Sequences are padded on the left, positions count from the right, so the last
column is always the newest event. Items are represented by id, by text vectors, or
by text vectors with a correction per item; the head is tied to the same table.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np

from listenloom.functions.time import GAP_EDGES
from listenloom.model.autograd import Var, gelu, layer_norm, softmax, unit_rows

PAD, OOV, FIRST = 0, 1, 2
REPRESENTATIONS = ("id", "text_frozen", "text_finetuned", "hybrid")


@dataclass(frozen=True)
class Shape:
    n_items: int
    dim: int = 32
    heads: int = 2
    blocks: int = 2
    max_len: int = 50
    use_time: bool = True
    items: str = "id"
    text_dim: int = 0

    def __post_init__(self):
        if self.dim % self.heads:
            raise ValueError("dim must be a multiple of heads")
        if self.items not in REPRESENTATIONS:
            raise ValueError(f"items must be one of {', '.join(REPRESENTATIONS)}")
        if self.items != "id" and self.text_dim < 1:
            raise ValueError("text vectors need text_dim")


def new_weights(shape: Shape, text: np.ndarray | None = None, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights to start from; ``text`` has a row per item, the first two of zeros."""
    r, d = np.random.default_rng(seed), shape.dim
    w = {"pos": 0.02 * r.normal(size=(shape.max_len, d)), "bias": np.zeros(shape.n_items), "out_scale": np.ones(d), "out_shift": np.zeros(d)}
    if shape.use_time:
        w["time"] = 0.02 * r.normal(size=(len(GAP_EDGES) + 3, d))
        w["time"][0] = 0
    if shape.items == "id":
        w["items"] = 0.02 * r.normal(size=(shape.n_items, d))
        w["items"][PAD] = 0
    else:
        if text is None or text.shape != (shape.n_items, shape.text_dim):
            raise ValueError("text vectors don't fit the shape")
        w["text"] = text.astype(float)
        w["project"] = r.normal(size=(shape.text_dim, d)) / np.sqrt(shape.text_dim)
        if shape.items == "hybrid":
            w["residual"] = np.zeros((shape.n_items, d))
            w["log_scale"] = np.zeros(1)
    for b in range(shape.blocks):
        for name, size in (("q", (d, d)), ("k", (d, d)), ("v", (d, d)), ("o", (d, d)), ("up", (d, 4 * d)), ("down", (4 * d, d))):
            w[f"{b}.{name}"] = 0.02 * r.normal(size=size)
            w[f"{b}.{name}_b"] = np.zeros(size[1])
        for norm in ("attn", "ffn"):
            w[f"{b}.{norm}_scale"], w[f"{b}.{norm}_shift"] = np.ones(d), np.zeros(d)
    return w


def frozen(shape: Shape) -> set[str]:
    """Weights that training leaves alone."""
    return {"text"} if shape.items in ("text_frozen", "hybrid") else set()


def gap_buckets(gaps: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """0 where padded, 1 at the first real position, else 2 and the number of edges reached."""
    out = np.searchsorted(np.array(GAP_EDGES), np.maximum(gaps, 0), side="right") + 2
    before = np.zeros_like(mask)
    before[:, 1:] = mask[:, :-1]
    return np.where(mask, np.where(mask & ~before, 1, out), 0)


def left_padded(histories: list[np.ndarray], times: list[np.ndarray], max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Items and gaps, newest last; padded times repeat a row's first, so no gap comes from padding."""
    width = max(1, min(max_len, max((len(h) for h in histories), default=1)))
    items, gaps = np.zeros((len(histories), width), dtype=np.int64), np.zeros((len(histories), width), dtype=np.int64)
    for i, (h, t) in enumerate(zip(histories, times)):
        h, t = np.asarray(h)[-width:], np.asarray(t)[-width:]
        if len(h):
            items[i, width - len(h) :] = h
            gaps[i, width - len(h) + 1 :] = np.maximum(np.diff(t), 0)
    return items, gaps


class Encoder:
    """``weights`` are arrays to score with, or :class:`Var` to train."""

    def __init__(self, shape: Shape, weights: dict):
        self.shape = shape
        self.w = {k: v if isinstance(v, Var) else Var(v) for k, v in weights.items()}

    def vectors(self, ids: np.ndarray) -> Var:
        """Of these items only: text is looked up before it is projected."""
        if self.shape.items == "id":
            return self.w["items"].take(ids)
        x = self.w["text"].take(ids) @ self.w["project"]
        real = (ids >= FIRST)[..., None].astype(float)
        if self.shape.items == "hybrid":
            scale = Var(np.exp(self.w["log_scale"].data), (self.w["log_scale"],), None)
            scale.back = lambda g: self.w["log_scale"].add_grad(np.atleast_1d((g * scale.data).sum()))
            x = unit_rows(x + self.w["residual"].take(ids)) * scale
        return x * real

    def encode(self, items: np.ndarray, gaps: np.ndarray | None) -> tuple[Var, list[np.ndarray]]:
        """Hidden states ``[B, L, D]`` (zero where padded) and attention ``[B, H, L, L]`` of each block."""
        s, w = self.shape, self.w
        b, length = items.shape
        if length > s.max_len:
            raise ValueError(f"sequences of {length} exceed max_len {s.max_len}")
        mask = items != PAD
        keep = mask[..., None].astype(float)
        x = self.vectors(items) * np.sqrt(s.dim) + w["pos"].take(np.arange(length - 1, -1, -1))
        if s.use_time and gaps is not None:
            x = x + w["time"].take(gap_buckets(gaps, mask))
        x = x * keep
        # a position sees itself and earlier real ones; padding sees itself, so that its row has a sum
        allowed = (np.tril(np.ones((length, length), dtype=bool)) & mask[:, None, :]) | np.eye(length, dtype=bool)
        block_out = np.where(allowed, 0.0, -1e30)[:, None]
        h, traces = s.dim // s.heads, []
        for k in range(s.blocks):
            n = layer_norm(x, w[f"{k}.attn_scale"], w[f"{k}.attn_shift"])
            q, key, v = ((n @ w[f"{k}.{p}"] + w[f"{k}.{p}_b"]).reshape(b, length, s.heads, h).swap(1, 2) for p in "qkv")
            a = softmax((q @ key.swap(2, 3)) * (1 / np.sqrt(h)) + block_out)
            traces.append(a.data)
            x = x + ((a @ v).swap(1, 2).reshape(b, length, s.dim) @ w[f"{k}.o"] + w[f"{k}.o_b"])
            n = layer_norm(x, w[f"{k}.ffn_scale"], w[f"{k}.ffn_shift"])
            x = x + (gelu(n @ w[f"{k}.up"] + w[f"{k}.up_b"]) @ w[f"{k}.down"] + w[f"{k}.down_b"])
        return layer_norm(x, w["out_scale"], w["out_shift"]) * keep, traces

    def table(self) -> np.ndarray:
        """All item vectors, once."""
        return self.vectors(np.arange(self.shape.n_items)).data

    def scores(self, histories, times, table: np.ndarray | None = None) -> np.ndarray:
        """``[B, n_items]``; padding and unknown can't be ranked. An empty history scores by bias alone."""
        items, gaps = left_padded(histories, times, self.shape.max_len)
        hidden = self.encode(items, gaps if self.shape.use_time else None)[0].data[:, -1]
        out = hidden @ (self.table() if table is None else table).T + self.w["bias"].data
        out[:, :FIRST] = -np.inf
        return out


def save(path: str, shape: Shape, weights: dict[str, np.ndarray], vocab_keys: list[str], metrics: dict) -> None:
    """Arrays and plain text only, so that loading runs no code."""
    import json

    meta = {"format_version": 1, "shape": asdict(shape), "vocab": vocab_keys, "metrics": metrics}
    np.savez_compressed(path, __meta=np.frombuffer(json.dumps(meta).encode(), dtype=np.uint8), **weights)


def load(path: str) -> tuple[Shape, dict[str, np.ndarray], list[str], dict]:
    import json

    with np.load(path, allow_pickle=False) as z:
        meta = json.loads(z["__meta"].tobytes().decode())
        if meta.get("format_version") != 1:
            raise ValueError(f"format {meta.get('format_version')} isn't known")
        shape, weights = Shape(**meta["shape"]), {k: z[k] for k in z.files if k != "__meta"}
    missing = set(new_weights(shape, np.zeros((shape.n_items, shape.text_dim)))) - set(weights)
    if missing:
        raise ValueError(f"weights are missing: {', '.join(sorted(missing))}")
    return shape, weights, meta["vocab"], meta["metrics"]


def transfer(shape: Shape, weights: dict[str, np.ndarray], n_items: int, text: np.ndarray) -> tuple[Shape, dict[str, np.ndarray]]:
    """The encoder for another catalogue: what has a row per item starts anew, the rest is kept."""
    if shape.items == "id":
        raise ValueError("items known by number only mean nothing in another catalogue")
    target = Shape(**(asdict(shape) | {"n_items": n_items}))
    fresh = new_weights(target, text)
    own = {"text", "residual", "bias"}
    return target, {k: fresh[k] if k in own else weights[k].copy() for k in fresh}


def untouched_residuals(weights: dict[str, np.ndarray]) -> int:
    """Items of a hybrid table whose correction is exactly zero: known by their text alone."""
    return int((~weights["residual"][FIRST:].any(axis=1)).sum())
