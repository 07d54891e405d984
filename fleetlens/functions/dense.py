"""Numpy arithmetic of a dense autoencoder, used on batches inside Spark tasks."""

from __future__ import annotations

import numpy as np

LEAK, BN_EPS, BN_MOMENTUM = 0.01, 1e-3, 0.99
ERRORS = ("mse", "mae", "rmse")
# Defaults of a model configuration.
DEFAULTS = {
    "latent_dim": 16,
    "hidden_dims": [86, 57, 38],
    "activation": "relu",
    "output_activation": "linear",
    "dropout_rate": 0.0,
    "batch_norm": False,
    "l2_reg": 0.0,
    "optimizer": "adam",
    "learning_rate": 1e-3,
    "loss": "mse",
    "reconstruction_error": "mse",
}


def complete(config: dict, input_dim: int) -> dict:
    """A checked configuration with defaults filled in."""
    spec = {**DEFAULTS, "input_dim": int(input_dim), **config}
    spec["hidden_dims"] = list(spec["hidden_dims"] or DEFAULTS["hidden_dims"])
    if "reconstruction_error" not in config:
        spec["reconstruction_error"] = spec["loss"]
    for name, allowed in (
        ("reconstruction_error", ERRORS),
        ("loss", ("mse", "mae")),
        ("optimizer", ("adam", "rmsprop", "sgd")),
        ("activation", tuple(ACTIVATIONS)),
        ("output_activation", tuple(ACTIVATIONS)),
    ):
        if str(spec[name]).lower() not in allowed:
            raise ValueError(f"invalid {name}={spec[name]!r}, expected one of {sorted(allowed)}")
    return spec


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


# name: (value, derivative given input and value)
ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0), lambda z, y: (z > 0).astype(z.dtype)),
    "leaky_relu": (lambda z: np.where(z > 0, z, LEAK * z), lambda z, y: np.where(z > 0, 1.0, LEAK)),
    "leakyrelu": (lambda z: np.where(z > 0, z, LEAK * z), lambda z, y: np.where(z > 0, 1.0, LEAK)),
    "tanh": (np.tanh, lambda z, y: 1 - y * y),
    "sigmoid": (_sigmoid, lambda z, y: y * (1 - y)),
    "linear": (lambda z: z, lambda z, y: np.ones_like(z)),
}


def sizes(spec: dict) -> list[int]:
    hidden = [int(h) for h in spec["hidden_dims"]]
    return [spec["input_dim"], *hidden, int(spec["latent_dim"]), *reversed(hidden), spec["input_dim"]]


def unpack(spec: dict, vector: np.ndarray) -> list[dict]:
    """Views of a flat parameter vector, one dict per dense layer."""
    widths, layers, at = sizes(spec), [], 0
    for i, (a, b) in enumerate(zip(widths, widths[1:])):
        shapes = {"w": (a, b), "b": (b,)}
        if spec["batch_norm"] and i < len(widths) - 2:
            shapes |= {"gamma": (b,), "beta": (b,), "mean": (b,), "var": (b,)}
        layer = {}
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            layer[name] = vector[at : at + n].reshape(shape)
            at += n
        layers.append(layer)
    return layers


def parameter_count(spec: dict) -> int:
    widths = sizes(spec)
    dense = sum(a * b + b for a, b in zip(widths, widths[1:]))
    return dense + (4 * sum(widths[1:-1]) if spec["batch_norm"] else 0)


def initial(spec: dict, seed: int) -> np.ndarray:
    """Glorot-uniform weights, zero biases, identity normalisation."""
    rng = np.random.default_rng(seed)
    vector = np.zeros(parameter_count(spec))
    for layer in unpack(spec, vector):
        a, b = layer["w"].shape
        layer["w"][:] = rng.uniform(-1, 1, (a, b)) * np.sqrt(6.0 / (a + b))
        for name in ("gamma", "var"):
            if name in layer:
                layer[name][:] = 1.0
    return vector


def forward(spec: dict, layers: list[dict], x: np.ndarray, rng=None, upto: int | None = None):
    """Output of the net and, with ``rng`` (training), what the backward pass needs."""
    act, out = ACTIVATIONS[spec["activation"].lower()][0], ACTIVATIONS[spec["output_activation"].lower()][0]
    last, latent, tape = len(layers) - 1, len(spec["hidden_dims"]), []
    for i, p in enumerate(layers[:upto]):
        step = {"x": x}
        z = x @ p["w"] + p["b"]
        if "gamma" in p:
            mean, var = (z.mean(0), z.var(0)) if rng is not None else (p["mean"], p["var"])
            step |= {"hat": (z - mean) / np.sqrt(var + BN_EPS), "mean": mean, "var": var}
            z = p["gamma"] * step["hat"] + p["beta"]
        x = (out if i == last else act)(z)
        step |= {"z": z, "y": x}
        if rng is not None and i not in (latent, last) and spec["dropout_rate"] > 0:
            step["mask"] = (rng.random(x.shape) >= spec["dropout_rate"]) / (1 - spec["dropout_rate"])
            x = x * step["mask"]
        tape.append(step)
    return x, tape


def row_errors(spec: dict, x: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    gap = x - y
    if kind == "mae":
        return np.abs(gap).mean(axis=1)
    squares = (gap * gap).mean(axis=1)
    return np.sqrt(squares) if kind == "rmse" else squares


def penalty(spec: dict, layers: list[dict]) -> float:
    return spec["l2_reg"] * sum(float((p["w"] ** 2).sum()) for p in layers) if spec["l2_reg"] > 0 else 0.0


def gradients(spec: dict, vector: np.ndarray, x: np.ndarray, rng) -> tuple[float, np.ndarray]:
    """Batch loss and its gradient; running moments move in place."""
    layers, grad = unpack(spec, vector), np.zeros_like(vector)
    slots = unpack(spec, grad)
    y, tape = forward(spec, layers, x, rng)
    loss = float(row_errors(spec, x, y, spec["loss"]).mean()) + penalty(spec, layers)
    back = (np.sign(y - x) if spec["loss"] == "mae" else 2 * (y - x)) / x.size
    for i in reversed(range(len(layers))):
        p, g, step = layers[i], slots[i], tape[i]
        name = spec["output_activation"] if i == len(layers) - 1 else spec["activation"]
        if "mask" in step:
            back = back * step["mask"]
        back = back * ACTIVATIONS[name.lower()][1](step["z"], step["y"])
        if "gamma" in p:
            g["gamma"][:], g["beta"][:] = (back * step["hat"]).sum(0), back.sum(0)
            hat = back * p["gamma"]
            back = (hat - hat.mean(0) - step["hat"] * (hat * step["hat"]).mean(0)) / np.sqrt(step["var"] + BN_EPS)
            p["mean"][:] = BN_MOMENTUM * p["mean"] + (1 - BN_MOMENTUM) * step["mean"]
            p["var"][:] = BN_MOMENTUM * p["var"] + (1 - BN_MOMENTUM) * step["var"]
        g["w"][:] = step["x"].T @ back + 2 * spec["l2_reg"] * p["w"]
        g["b"][:] = back.sum(0)
        back = back @ p["w"].T
    return loss, grad


def update(spec: dict, state: dict, grad: np.ndarray) -> None:
    """One optimiser step on state = {params, m, v, t, lr} in place."""
    state["t"] += 1
    if spec["optimizer"] == "sgd":
        state["params"] -= state["lr"] * grad
        return
    if spec["optimizer"] == "rmsprop":
        state["v"] *= 0.9
        state["v"] += 0.1 * grad * grad
        state["params"] -= state["lr"] * grad / (np.sqrt(state["v"]) + 1e-7)
        return
    state["m"] += 0.1 * (grad - state["m"])
    state["v"] += 0.001 * (grad * grad - state["v"])
    rate = state["lr"] * np.sqrt(1 - 0.999 ** state["t"]) / (1 - 0.9 ** state["t"])
    state["params"] -= rate * state["m"] / (np.sqrt(state["v"]) + 1e-7)
