"""A bidirectional gated recurrent network over bytes, in numpy.

A text is cut into runs of ``RUN`` bytes; every run starts from a zero state in both
directions, so all bytes of all texts are read and memory does not depend on a
text's length. The network labels every byte; a text's probabilities are the mean of
the labels of its letters. It is trained by backpropagation through time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RUN = 64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


@dataclass
class Network:
    """``table`` (2, 256, 3h): what a byte adds to the gates of each direction; ``recur`` (2, h, 3h); ``out`` (2h, classes)."""

    table: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.table, self.recur, self.out, self.bias]

    @classmethod
    def fresh(cls, hidden: int, classes: int, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(np.float32)
        return cls(draw(0.3, 2, 256, 3 * hidden), draw(hidden ** -0.5, 2, hidden, 3 * hidden),
                   draw(hidden ** -0.5, 2 * hidden, classes), np.zeros(classes, np.float32))


def _walk(net: Network, side: int, codes: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (run, batch, h) of one direction for codes (run, batch), with what training needs if asked for."""
    h = net.recur.shape[1]
    table, gates_w, new_w = net.table[side], net.recur[side][:, :2 * h].copy(), net.recur[side][:, 2 * h:].copy()
    states = np.empty((*codes.shape, h), np.float32)
    state, saved = np.zeros((codes.shape[1], h), np.float32), []
    for t in range(len(codes)):
        given = table[codes[t]]
        gates = _sigmoid(given[:, :2 * h] + state @ gates_w)
        reset, update = gates[:, :h], gates[:, h:]
        held = reset * state
        new = np.tanh(given[:, 2 * h:] + held @ new_w)
        before = state
        state = new + update * (before - new)
        states[t] = state
        if keep:
            saved.append((before, reset, update, new, held))
    return states, saved


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def label(net: Network, codes: np.ndarray) -> np.ndarray:
    """Class probabilities (run, batch, classes) of every byte of codes (run, batch)."""
    forth, _ = _walk(net, 0, codes, False)
    back, _ = _walk(net, 1, codes[::-1], False)
    h = forth.shape[-1]
    return _softmax(forth @ net.out[:h] + back[::-1] @ net.out[h:] + net.bias)


def _gradients(net: Network, codes: np.ndarray, classes: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients for codes (run, batch), one class per column, weights (run, batch)."""
    h = net.recur.shape[1]
    forth, kept_forth = _walk(net, 0, codes, True)
    back, kept_back = _walk(net, 1, codes[::-1], True)
    both = np.concatenate([forth, back[::-1]], axis=2)
    chances = _softmax(both @ net.out + net.bias)
    total = max(float(weight.sum()), 1.0)
    own = np.take_along_axis(chances, np.broadcast_to(classes[None, :, None], (*codes.shape, 1)), 2)[..., 0]
    loss = float(-(weight * np.log(np.maximum(own, 1e-9))).sum() / total)
    slope = chances.copy()
    np.put_along_axis(slope, np.broadcast_to(classes[None, :, None], (*codes.shape, 1)), (own - 1)[..., None], 2)
    slope *= (weight / total)[..., None].astype(np.float32)
    g_table, g_recur = np.zeros_like(net.table), np.zeros_like(net.recur)
    flat = slope.reshape(-1, slope.shape[-1])
    g_out, g_bias = both.reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
    into = slope @ net.out.T
    for side, saved in ((0, kept_forth), (1, kept_back)):
        given = into[..., :h] if side == 0 else into[::-1, :, h:]
        seen = codes if side == 0 else codes[::-1]
        w, carried = net.recur[side], np.zeros((codes.shape[1], h), np.float32)
        for t in reversed(range(len(seen))):
            before, reset, update, new, held = saved[t]
            d = given[t] + carried
            d_new = d * (1 - update) * (1 - new * new)
            d_update = d * (before - new) * update * (1 - update)
            d_held = d_new @ w[:, 2 * h:].T
            d_reset = d_held * before * reset * (1 - reset)
            d_gates = np.concatenate([d_reset, d_update], axis=1)
            carried = d * update + d_held * reset + d_gates @ w[:, :2 * h].T
            g_recur[side][:, :2 * h] += before.T @ d_gates
            g_recur[side][:, 2 * h:] += held.T @ d_new
            np.add.at(g_table[side], seen[t], np.concatenate([d_gates, d_new], axis=1))
    return loss, [g_table, g_recur, g_out, g_bias]


def train(codes: np.ndarray, lengths: np.ndarray, classes: np.ndarray, n_classes: int, hidden: int = 8, rounds: int = 400,
          batch: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit by Adam on runs (n, RUN) of which ``lengths`` bytes count, each with a class."""
    net, rng = Network.fresh(hidden, n_classes, seed), np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parts]
    second = [np.zeros_like(p) for p in net.parts]
    for step in range(1, rounds + 1):
        some = rng.integers(0, len(codes), batch)
        weight = (np.arange(codes.shape[1])[:, None] < lengths[some][None, :]).astype(np.float32)
        _, slopes = _gradients(net, codes[some].T, classes[some], weight)
        pace = rate * min(1.0, 3 * (1 - (step - 1) / rounds) + 0.02)
        norm = float(np.sqrt(sum((s * s).sum() for s in slopes)))
        for p, s, a, b in zip(net.parts, slopes, first, second):
            s = s * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            a += 0.1 * (s - a)
            b += 0.001 * (s * s - b)
            p -= np.float32(pace) * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return net


def runs(texts: list[bytes], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes (n, run), bytes that count in each, text of each): every text cut into runs, the last filled with zeros."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = -(-sizes // run)
    text = np.repeat(np.arange(len(texts)), count)
    which = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    lengths = np.minimum(run, sizes[text] - which * run)
    codes = np.zeros((len(text), run), np.uint8)
    codes[np.arange(run)[None, :] < lengths[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    return codes, lengths, text


def pooled(net: Network, texts: list[bytes], block: int = 2048) -> np.ndarray:
    """Probabilities (texts, classes): the mean over a text's bytes that may be part of letters, over all bytes if none are."""
    codes, lengths, text = runs(texts)
    out = np.zeros((len(texts), net.out.shape[1]))
    if not len(codes):
        return out
    letter = np.zeros(256, np.float32)
    letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    order = np.argsort(lengths, kind="stable")
    for at in range(0, len(codes), block):
        some = order[at:at + block]
        longest = int(lengths[some].max())
        here = codes[some, :longest].T
        counts = letter[here] + np.float32(1e-6)
        counts *= np.arange(longest)[:, None] < lengths[some][None, :]
        sums = np.einsum("tbc,tb->bc", label(net, here), counts)
        np.add.at(out, text[some], sums)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-30)
