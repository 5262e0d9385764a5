"""Training of small encoders, on one machine: sampled losses, warm-up, clipping, early stop."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

import numpy as np

from listenloom.model.autograd import Var, log_sigmoid, log_softmax
from listenloom.model.encoder import FIRST, PAD, Encoder, Shape, frozen, left_padded

LOSSES = ("sampled_softmax", "bpr")


@dataclass
class Config:
    loss: str = "sampled_softmax"
    epochs: int = 10
    batch: int = 32
    negatives: int = 64
    rate: float = 1e-2
    warmup: int = 20
    decay: float = 0.01
    clip: float = 5.0
    patience: int = 3
    freeze_encoder: bool = False
    seed: int = 0

    @classmethod
    def of(cls, values: dict) -> Config:
        """A configuration from named values; a name it doesn't know is an error, not a default."""
        if unknown := sorted(set(values) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**values)

    @classmethod
    def read(cls, path: str) -> Config:
        """A configuration from a JSON file."""
        return cls.of(json.loads(Path(path).read_text()))


@dataclass
class State:
    epoch: int = 0
    best: float = -1.0
    history: list[dict] = field(default_factory=list)


def learning_rate(step: int, steps: int, config: Config) -> float:
    """Linear warm-up, then a cosine to nothing."""
    if step < config.warmup:
        return config.rate * (step + 1) / config.warmup
    done = (step - config.warmup) / max(1, steps - config.warmup)
    return config.rate * 0.5 * (1 + np.cos(np.pi * min(1.0, done)))


def negative_sampler(n_items: int, counts: np.ndarray | None, seed: int):
    """Draws real items, evenly or by count to the power 0.75."""
    r = np.random.default_rng(seed)
    if counts is None or counts[FIRST:].sum() <= 0:
        return lambda size: r.integers(FIRST, n_items, size)
    p = np.maximum(counts.astype(float), 0) ** 0.75
    p[:FIRST] = 0
    p /= p.sum()
    return lambda size: r.choice(n_items, size, p=p)


def windows_of(items: np.ndarray, times: np.ndarray, max_len: int, stride: int | None = None):
    """``(inputs, targets, times)`` back from the newest event."""
    end = len(items) - 1
    while end >= 2:
        start = max(0, end - max_len)
        yield items[start:end], items[start + 1 : end + 1], times[start:end]
        end -= stride or max_len


def batch_loss(model: Encoder, rows, negatives: np.ndarray, loss: str) -> Var:
    """Mean over positions whose target is a real item; negatives are shared by the batch."""
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {', '.join(LOSSES)}")
    items, gaps = left_padded([r[0] for r in rows], [r[2] for r in rows], model.shape.max_len)
    targets, _ = left_padded([r[1] for r in rows], [r[2] for r in rows], model.shape.max_len)
    at = np.nonzero((items != PAD) & (targets >= FIRST))
    if not len(at[0]):
        return Var(0.0)
    hidden = model.encode(items, gaps if model.shape.use_time else None)[0].take(at)
    wanted = targets[at]
    positive = (hidden * model.vectors(wanted)).sum(axis=-1, keepdims=True) + model.w["bias"].take(wanted).reshape(-1, 1)
    other = hidden @ model.vectors(negatives).swap(0, 1) + model.w["bias"].take(negatives)
    n = len(wanted)
    if loss == "bpr":
        return log_sigmoid(positive - other).sum() * (-1.0 / (n * len(negatives)))
    return log_softmax(_beside(positive, other)).take((slice(None), 0)).sum() * (-1.0 / n)


def _beside(a: Var, b: Var) -> Var:
    k = a.shape[1]
    return Var(np.concatenate([a.data, b.data], axis=1), (a, b), lambda g: (a.add_grad(g[:, :k]), b.add_grad(g[:, k:])))


def held_out(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list, list]:
    """Sequences without their last event, and ``(items, times, target)`` of those whose last item is a real one."""
    shorter, asked = [], []
    for items, times in sequences:
        if len(items) > 3 and items[-1] >= FIRST:
            asked.append((items[:-1], times[:-1], int(items[-1])))
            shorter.append((items[:-1], times[:-1]))
        else:
            shorter.append((items, times))
    return shorter, asked


def ndcg_validator(shape: Shape, asked: list, k: int = 10, batch: int = 64):
    """A function from weights to NDCG at ``k`` of the targets in ``asked``, ranked among all items, ties against them."""

    def validate(weights: dict[str, np.ndarray]) -> float:
        model, gain = Encoder(shape, weights), 0.0
        table = model.table()
        for s in range(0, len(asked), batch):
            part = asked[s : s + batch]
            scores = model.scores([a[0] for a in part], [a[1] for a in part], table)
            own = scores[np.arange(len(part)), [a[2] for a in part]]
            rank = (scores >= own[:, None]).sum(1) - 1
            gain += float((1 / np.log2(rank[rank < k] + 2)).sum())
        return gain / max(1, len(asked))

    return validate


def fit(shape: Shape, weights: dict[str, np.ndarray], sequences: list[tuple[np.ndarray, np.ndarray]], config: Config | None = None, counts: np.ndarray | None = None, validate=None) -> tuple[dict[str, np.ndarray], State]:
    """Weights after training, the best by ``validate(weights)`` if that is given."""
    config = config or Config()
    w = {k: v.copy() for k, v in weights.items()}
    still = frozen(shape) | ({k for k in w if k not in ("items", "project", "residual", "bias", "log_scale")} if config.freeze_encoder else set())
    rows = [r for items, times in sequences for r in windows_of(np.asarray(items), np.asarray(times), shape.max_len)]
    if not rows:
        return w, State()
    draw, r = negative_sampler(shape.n_items, counts, config.seed), np.random.default_rng(config.seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    per, step, state, best = -(-len(rows) // config.batch), 0, State(), {k: v.copy() for k, v in w.items()}
    waited = 0
    for epoch in range(config.epochs):
        order, total = r.permutation(len(rows)), 0.0
        for s in range(0, len(rows), config.batch):
            model = Encoder(shape, w)
            loss = batch_loss(model, [rows[i] for i in order[s : s + config.batch]], draw(config.negatives), config.loss)
            loss.backward()
            grads = {k: v.grad for k, v in model.w.items() if v.grad is not None and k not in still}
            size = np.sqrt(sum((g**2).sum() for g in grads.values()))
            scale, rate = min(1.0, config.clip / (size + 1e-12)), learning_rate(step, per * config.epochs, config)
            step += 1
            for k, g in grads.items():
                g = g * scale
                if k in ("items", "time", "residual"):
                    g[PAD] = 0
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.98 * second[k] + 0.02 * g * g
                w[k] -= rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-8) + config.decay * w[k] * (w[k].ndim > 1))
            total += float(loss.data)
        score = validate(w) if validate else -total / per
        state.history.append({"epoch": epoch, "loss": total / per, "score": score})
        if score > state.best or epoch == 0:
            state.best, state.epoch, waited = score, epoch, 0
            best = {k: v.copy() for k, v in w.items()}
        else:
            waited += 1
            if waited >= config.patience:
                break
    return best, state
