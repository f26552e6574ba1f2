"""A small convolutional network over patches: forward pass, embeddings, training. Weights are a dict of arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES, CHANNELS = 5, (16, 32, 64)
KEYS = ["basin", "outlet", "confluence", "head_1", "head_2"]
#: Windows that are convolved in one go.
WINDOWS = 4096


def one_hot(patches: np.ndarray) -> np.ndarray:
    """(n, h, w) classes to (n, 5, h, w) floats."""
    return (patches[:, None] == np.arange(CLASSES)[None, :, None, None]).astype(np.float32)


def flip(patches: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each patch turned over along either axis with probability one half."""
    out = patches.copy()
    across, down = rng.random(len(out)) < 0.5, rng.random(len(out)) < 0.5
    out[across] = out[across][:, :, ::-1]
    out[down] = out[down][:, ::-1]
    return out


def initial_weights(embedding: int = 4, seed: int = 0) -> dict[str, np.ndarray]:
    """He-scaled normal weights; batch normalisation at rest."""
    rng, w, before = np.random.default_rng(seed), {}, CLASSES
    for i, n in enumerate(CHANNELS, 1):
        w |= {f"conv{i}.w": rng.normal(0, (2 / (9 * before)) ** 0.5, (n, before, 3, 3)), f"conv{i}.b": np.zeros(n)}
        w |= {f"bn{i}.gain": np.ones(n), f"bn{i}.shift": np.zeros(n), f"bn{i}.mean": np.zeros(n), f"bn{i}.var": np.ones(n)}
        before = n
    w |= {"embed.w": rng.normal(0, (2 / before) ** 0.5, (embedding, before)), "embed.b": np.zeros(embedding), "head.w": rng.normal(0, embedding**-0.5, (1, embedding)), "head.b": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def _convolve(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """3 x 3, padded by one; as nine matrix products."""
    padded, (h, v) = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1))), x.shape[2:]
    out = np.zeros((len(x), len(w), h, v), dtype=np.float32)
    for i in range(3):
        for j in range(3):
            out += np.einsum("oc,nchw->nohw", w[:, :, i, j], padded[:, :, i : i + h, j : j + v], optimize=True)
    return out + b[None, :, None, None]


def pooled_features(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Three blocks of convolution, normalisation, rectifier and 2 x 2 maximum, then the mean over the image: (n, 64)."""
    for i in range(1, len(CHANNELS) + 1):
        x = _convolve(x, w[f"conv{i}.w"], w[f"conv{i}.b"])
        scale = w[f"bn{i}.gain"] / np.sqrt(w[f"bn{i}.var"] + 1e-5)
        x = np.maximum(x * scale[None, :, None, None] + (w[f"bn{i}.shift"] - w[f"bn{i}.mean"] * scale)[None, :, None, None], 0)
        h, v = x.shape[2] // 2, x.shape[3] // 2
        x = x[:, :, : 2 * h, : 2 * v].reshape(len(x), x.shape[1], h, 2, v, 2).max(axis=(3, 5))
    return x.mean(axis=(2, 3))


def _paired(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Pairs of numbers below n, numbered from 0 on, equal ones alike; and how many there are."""
    code = a.astype(np.int64) * n + b
    if n * n <= 4 * code.size:
        seen = np.zeros(n * n, dtype=bool)
        seen[code.ravel()] = True
        number = np.cumsum(seen) - 1
        return number[code], int(number[-1]) + 1
    found, number = np.unique(code, return_inverse=True)
    return number.reshape(code.shape), len(found)


def distinct_windows(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The 4 x 4 surroundings of each 2 x 2 block of (images, h, w) numbers, numbered, and (k, 4, 4), each of them once; n is the padding."""
    h, v = ids.shape[1] // 2, ids.shape[2] // 2
    padded = np.pad(ids, ((0, 0), (1, 1), (1, 1)), constant_values=n)
    x, k = _paired(padded[:, :, 0 : 2 * v + 2 : 2], padded[:, :, 1 : 2 * v + 2 : 2], n + 1)
    x, k = _paired(x[:, :, :-1], x[:, :, 1:], k)
    x, k = _paired(x[:, 0 : 2 * h + 2 : 2], x[:, 1 : 2 * h + 2 : 2], k)
    x, k = _paired(x[:, :-1], x[:, 1:], k)
    at = np.empty(k, dtype=np.int64)
    at[x.ravel()] = np.arange(x.size)
    image, r, c = (i[:, None, None] for i in np.unravel_index(at, x.shape))
    return x, padded[image, 2 * r + np.arange(4)[:, None], 2 * c + np.arange(4)]


def _block(x: np.ndarray, i: int, w: dict[str, np.ndarray]) -> np.ndarray:
    """Block i of the network over windows (k, 4, 4, channels), each of which gives one place of its result: (k, channels)."""
    weights = w[f"conv{i}.w"].transpose(2, 3, 1, 0).reshape(-1, len(w[f"conv{i}.w"]))
    scale, out = w[f"bn{i}.gain"] / np.sqrt(w[f"bn{i}.var"] + 1e-5), None
    for r in (0, 1):
        for c in (0, 1):
            y = x[:, r : r + 3, c : c + 3].reshape(len(x), len(weights)) @ weights + w[f"conv{i}.b"]
            y = np.maximum(y * scale + (w[f"bn{i}.shift"] - w[f"bn{i}.mean"] * scale), 0)
            out = y if out is None else np.maximum(out, y)
    return out


def class_features(patches: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """pooled_features of one_hot(patches), up to rounding: each block is computed once for all places that look alike.

    Patches are lines stretched over large areas, so few of their windows differ; where all do, it is the same work.
    """
    ids, values = np.where((patches >= 0) & (patches < CLASSES), patches, CLASSES), np.eye(CLASSES, dtype=np.float32)
    for i in range(1, len(CHANNELS) + 1):
        ids, windows = distinct_windows(ids, len(values))
        padded = np.concatenate([values, np.zeros((1, values.shape[1]), dtype=np.float32)])
        values = np.concatenate([_block(padded[windows[at : at + WINDOWS]], i, w) for at in range(0, max(len(windows), 1), WINDOWS)])
    return values[ids].mean(axis=(1, 2))


def embed(patches: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    return np.maximum(class_features(patches, w) @ w["embed.w"].T + w["embed.b"], 0)


def logits(embedded: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    return (embedded @ w["head.w"].T + w["head.b"])[:, 0]


def extract_embeddings(images: DataFrame, w: dict[str, np.ndarray], batch: int = 64) -> DataFrame:
    """The keys, emb_0 .. emb_{n-1} and cnn_logit (the probability) of each patch; Arrow batches in, broadcast weights."""
    shared, n = images.sparkSession.sparkContext.broadcast(w), len(w["embed.b"])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                grids = np.stack([np.asarray(p, dtype=np.int8).reshape(s, s) for p, s in zip(part["pixels"], part["size"], strict=True)])
                e = embed(grids, shared.value)
                p = 1 / (1 + np.exp(-logits(e, shared.value)))
                yield pd.DataFrame({k: part[k].to_numpy() for k in KEYS} | {f"emb_{i}": e[:, i].astype(np.float32) for i in range(n)} | {"cnn_logit": p.astype(np.float32)})

    schema = "basin string, outlet long, confluence long, head_1 long, head_2 long, " + ", ".join(f"emb_{i} float" for i in range(n)) + ", cnn_logit float"
    return images.filter(F.col("pixels").isNotNull()).mapInPandas(run, schema)


def train_head(features: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray], epochs: int = 60, rate: float = 0.01, patience: int = 12, validation: float = 0.15, seed: int = 0) -> dict[str, np.ndarray]:
    """Fit the embedding and head layers on pooled features: weighted logistic loss, Adam, early stopping, best weights kept.

    The convolutions stay as they are: without an automatic differentiator here they serve as fixed random features.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: int(len(y) * validation)]
    train = order[int(len(y) * validation) :]
    weight = (y[train] == 0).sum() / max((y[train] == 1).sum(), 1)
    names = ["embed.w", "embed.b", "head.w", "head.b"]
    p = {k: w[k].astype(np.float64).copy() for k in names}
    m, v = ({k: np.zeros_like(p[k]) for k in names} for _ in range(2))
    best, left, kept = np.inf, patience, p

    def forward(x):
        hidden = x @ p["embed.w"].T + p["embed.b"]
        e = np.maximum(hidden, 0)
        return hidden, e, (e @ p["head.w"].T + p["head.b"])[:, 0]

    def loss(z, t):
        return float(np.mean(np.where(t == 1, weight, 1) * (np.logaddexp(0, z) - t * z))) if len(t) else 0.0

    for step in range(1, epochs + 1):
        x, t = features[train], y[train]
        hidden, e, z = forward(x)
        g = np.where(t == 1, weight, 1) * (1 / (1 + np.exp(-z)) - t) / len(t)
        back = (g[:, None] * p["head.w"]) * (hidden > 0)
        grads = {"head.w": g[None] @ e, "head.b": np.array([g.sum()]), "embed.w": back.T @ x, "embed.b": back.sum(0)}
        for k in names:
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        now = loss(forward(features[held])[2], y[held]) if len(held) else loss(z, t)
        if now < best - 1e-6:
            best, left, kept = now, patience, {k: a.copy() for k, a in p.items()}
        else:
            left -= 1
            if not left:
                break
    return w | {k: a.astype(np.float32) for k, a in kept.items()}
