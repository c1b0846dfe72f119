"""A gated recurrent network over token numbers with a class-factored softmax, in numpy."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    """Tokens 0 .. classes * members - 1 are single words, ``members`` to a class; the other ``groups`` tokens each stand for a class of rarer words."""

    hidden: int = 16
    classes: int = 32
    members: int = 64
    groups: int = 32

    @property
    def words(self) -> int:
        return self.classes * self.members

    @property
    def sizes(self) -> dict[str, tuple[int, ...]]:
        h = self.hidden
        return {
            "take": (self.words + self.groups, 3 * h), "keep": (h, 3 * h), "by_class": (h, self.classes + self.groups),
            "class_bias": (self.classes + self.groups,), "by_word": (self.classes, h, self.members), "word_bias": (self.classes, self.members),
        }


Weights = dict[str, np.ndarray]


def flat(weights: Weights, shape: Shape) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in shape.sizes]).astype(np.float32)


def _views(values: np.ndarray, shape: Shape) -> Weights:
    out, at = {}, 0
    for name, size in shape.sizes.items():
        n = math.prod(size)
        out[name] = values[at:at + n].reshape(size)
        at += n
    return out


def unflat(values: np.ndarray, shape: Shape) -> Weights:
    return {name: part.astype(np.float32) for name, part in _views(values, shape).items()}


def start(word_counts: np.ndarray, group_counts: np.ndarray, shape: Shape, seed: int) -> Weights:
    """Small random weights; the biases give the plain frequencies."""
    random = np.random.default_rng(seed)
    out = {k: (random.standard_normal(s) * 0.1).astype(np.float32) for k, s in shape.sizes.items()}
    counts = np.zeros(shape.words)
    counts[:len(word_counts)] = word_counts
    counts = counts.reshape(shape.classes, shape.members)
    # A place in a class that no word takes gets no probability.
    out["word_bias"] = np.where(counts > 0, np.log(np.maximum(counts, 1)), -60).astype(np.float32)
    totals = np.concatenate([counts.sum(1), group_counts])
    out["class_bias"] = np.where(totals > 0, np.log(np.maximum(totals, 1)), np.log(0.5)).astype(np.float32)
    out["class_bias"][:shape.classes][counts.sum(1) == 0] = -60
    out["class_bias"] -= np.log(np.exp(out["class_bias"].astype(np.float64)).sum()).astype(np.float32)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _gate_weights(w: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights of z, r and the new state, each in one piece of memory: by token and by state."""
    return [tuple(np.ascontiguousarray(part) for part in pair) for pair in zip(np.split(w["take"], 3, axis=1), np.split(w["keep"], 3, axis=1))]


def _stepped(gates: list[tuple[np.ndarray, np.ndarray]], tokens: np.ndarray, h: np.ndarray) -> np.ndarray:
    (z_take, z_keep), (r_take, r_keep), (take, keep) = gates
    z, r = h @ z_keep, h @ r_keep
    taken = z_take.take(tokens, axis=0)
    z += taken
    r += r_take.take(tokens, axis=0, out=taken, mode="clip")
    fresh = h @ keep
    fresh *= _sigmoid(r)
    fresh += take.take(tokens, axis=0, out=taken, mode="clip")
    np.tanh(fresh, out=fresh)
    out = np.subtract(h, fresh, out=taken)
    out *= _sigmoid(z)
    out += fresh
    return out


def _advance(w: Weights, tokens: np.ndarray, h: np.ndarray) -> np.ndarray:
    return _stepped(_gate_weights(w), tokens, h)


#: Rows whose logits are worked on at once, so that nearer caches hold them.
_ROWS = 512


def _grouped(spans: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Successive classes that have about so many rows together; a class stays whole."""
    group: list[tuple[int, int, int]] = []
    for span in spans:
        if group and span[2] - group[0][1] > _ROWS:
            yield group
            group = []
        group.append(span)
    if group:
        yield group


#: The largest logits of rows may lie in a range so wide before each has to be looked for.
_REACH = 60


def _shifted(top: np.ndarray) -> bool:
    """Move the biases (last row) of each softmax so that the largest logit of any row is near 0: a state lies within -1 and 1. False, and no
    change, where its exponential could still be too large or too small."""
    reach = np.abs(top[..., :-1, :]).sum(-2)
    high, low = (top[..., -1, :] + reach).max(-1), (top[..., -1, :] - reach).max(-1)
    # Not a number is not below either.
    fits = bool((high - low < _REACH).all())
    if fits:
        top[..., -1, :] -= (high[..., None] + low[..., None]) / 2
    return fits


def _errors(logits: np.ndarray, chosen: np.ndarray, weight: np.ndarray, shifted: bool) -> np.ndarray:
    """Gradient by the logits of the weighted log of the softmax at the chosen column of each row; ``logits`` is used up."""
    if not shifted:
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= (-weight / (logits @ np.ones(logits.shape[1], logits.dtype)))[:, None]
    logits[np.arange(len(chosen)), chosen] += weight
    return logits


class _Room:
    """Arrays that one window after the other works in; memory asked for anew would be mapped anew for each."""

    def __init__(self):
        self.held: dict[tuple, np.ndarray] = {}

    def of(self, name: str, dtype: np.dtype, *size: int) -> np.ndarray:
        n = math.prod(size)
        found = self.held.get((name, dtype))
        if found is None or len(found) < n:
            found = self.held[name, dtype] = np.empty(n, dtype)
        return found[:n].reshape(size)


def _with_one(states: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The states and a column of ones, so that biases take part in products."""
    out[:, :-1] = states
    out[:, -1] = 1
    return out


def _classes(tokens: np.ndarray, shape: Shape) -> np.ndarray:
    return np.where(tokens < shape.words, tokens // shape.members, tokens - shape.words + shape.classes)


def _by_class(classes: np.ndarray, shape: Shape) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows of single words in order of their class, and the span of each class that has some."""
    rows = np.argsort(classes.astype(np.int16 if shape.classes + shape.groups < 1 << 15 else np.int64), kind="stable")
    cuts = np.searchsorted(classes[rows], np.arange(shape.classes + 1)).tolist()
    return rows[:cuts[-1]], [(c, x, y) for c, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]


def _log_of(logits: np.ndarray, chosen: np.ndarray, shifted: bool) -> np.ndarray:
    """Log of the softmax at the chosen column of each row; ``logits`` is used up."""
    if not shifted:
        logits -= logits.max(1, keepdims=True)
    own = logits[np.arange(len(chosen)), chosen]
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def log_probabilities(w: Weights, states: np.ndarray, tokens: np.ndarray, shape: Shape, at_once: int = 4096) -> np.ndarray:
    """ln P(token | state), for a rarer word that of its class; so many rows at once as caches hold."""
    out = np.empty(len(tokens), states.dtype)
    top = np.concatenate([w["by_class"], w["class_bias"][None]])
    words = np.concatenate([w["by_word"], w["word_bias"][:, None]], axis=1)
    top_shifted, words_shifted = _shifted(top), _shifted(words)
    room = _Room()
    for a in range(0, len(tokens), at_once):
        some = tokens[a:a + at_once]
        given = _with_one(states[a:a + at_once], room.of("given", states.dtype, len(some), shape.hidden + 1))
        classes, logs = _classes(some, shape), out[a:a + at_once]
        for x in range(0, len(some), _ROWS):
            rows = given[x:x + _ROWS]
            logits = np.matmul(rows, top, out=room.of("top", states.dtype, len(rows), top.shape[1]))
            logs[x:x + _ROWS] = _log_of(logits, classes[x:x + _ROWS], top_shifted)
        single, spans = _by_class(classes, shape)
        own, members = given[single], some[single] % shape.members
        for group in _grouped(spans):
            first, last = group[0][1], group[-1][2]
            logits = room.of("words", states.dtype, last - first, shape.members)
            for c, x, y in group:
                np.matmul(own[x:y], words[c], out=logits[x - first:y - first])
            logs[single[first:last]] += _log_of(logits, members[first:last], words_shifted)
    return out


def score_texts(w: Weights, tokens: np.ndarray, begins: np.ndarray, shape: Shape, window: int = 32) -> np.ndarray:
    """ln P of each text (a run of tokens), all tokens included; the state is carried from window to window."""
    sizes = np.diff(begins)
    order = np.argsort(-sizes, kind="stable")
    sizes, firsts = sizes[order], begins[:-1][order]
    totals = np.zeros(len(order))
    actives = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0)))).tolist()
    h, gates = np.zeros((len(order), shape.hidden), np.float32), _gate_weights(w)
    for at in range(0, int(sizes.max(initial=0)), window):
        active = actives[at]
        states, seen, owner = [], [], []
        for step, n in enumerate(actives[at:at + window], at):
            now = tokens[firsts[:n] + step]
            states.append(h[:n])
            seen.append(now)
            owner.append(n)
            h = _stepped(gates, now, h[:n])
        logs = log_probabilities(w, np.concatenate(states), np.concatenate(seen), shape)
        rows = np.concatenate([np.arange(n) for n in owner])
        totals[:active] += np.bincount(rows, logs, active)
    out = np.zeros(len(order))
    out[order] = totals
    return out


def _gradients(w: Weights, tokens: np.ndarray, valid: np.ndarray, h: np.ndarray, shape: Shape, room: _Room | None = None) -> tuple[Weights, np.ndarray]:
    """Gradient of the mean log-likelihood of a window (steps x texts), back through its steps only, and the last state.

    The gradients are views of the room's array "gradients", which the next window fills again.
    """
    steps, lanes = tokens.shape
    n, dtype, room = shape.hidden, h.dtype, room or _Room()
    rows = np.take(w["take"], tokens, axis=0, out=room.of("rows", dtype, steps, lanes, 3 * n), mode="clip")
    # Texts run along the last axis, so that a gate of all texts is one piece of memory.
    taken = room.of("taken", dtype, steps, 3 * n, lanes)
    taken[...] = rows.transpose(0, 2, 1)
    # One array for all steps of what the way back needs; gates holds z and r, now the candidate state before and after r and tanh.
    before, gates = room.of("before", dtype, steps, n, lanes), room.of("gates", dtype, steps, 2 * n, lanes)
    kept_fresh, fresh = room.of("kept_fresh", dtype, steps, n, lanes), room.of("fresh", dtype, steps, n, lanes)
    kept, keep_t, state = room.of("kept", dtype, 3 * n, lanes), np.ascontiguousarray(w["keep"].T), h.T.copy()
    for t in range(steps):
        before[t] = state
        np.matmul(keep_t, state, out=kept)
        gate, from_rows = gates[t], taken[t]
        _sigmoid(np.add(from_rows[:2 * n], kept[:2 * n], out=gate))
        kept_fresh[t] = kept[2 * n:]
        now = np.multiply(gate[n:], kept[2 * n:], out=fresh[t])
        now += from_rows[2 * n:]
        np.tanh(now, out=now)
        state -= now
        state *= gate[:n]
        state += now
    count = steps * lanes
    states = room.of("states", dtype, count, n + 1)
    states.reshape(steps, lanes, n + 1)[..., :n] = before.transpose(0, 2, 1)
    states[:, n] = 1
    flat_tokens, weight = tokens.ravel(), valid.ravel().astype(dtype) / max(1, valid.sum())
    values = room.of("gradients", np.dtype(np.float32), sum(map(math.prod, shape.sizes.values())))
    values[:] = 0
    g = _views(values, shape)
    classes = _classes(flat_tokens, shape)
    top = np.concatenate([w["by_class"], w["class_bias"][None]])
    shifted = _shifted(top)
    by_top, by_state = np.zeros_like(top), room.of("by_state", dtype, count, n)
    for a in range(0, count, _ROWS):
        own = states[a:a + _ROWS]
        error = np.matmul(own, top, out=room.of("error", dtype, len(own), top.shape[1]))
        _errors(error, classes[a:a + _ROWS], weight[a:a + _ROWS], shifted)
        by_top += own.T @ error
        np.matmul(error, w["by_class"].T, out=by_state[a:a + _ROWS])
    g["by_class"][:], g["class_bias"][:] = by_top[:-1], by_top[-1]
    # The rows of single words, class by class; products are by class, the softmax is over some classes at once.
    single, spans = _by_class(classes, shape)
    if spans:
        words = np.concatenate([w["by_word"], w["word_bias"][:, None]], axis=1)
        shifted, by_words, words_t = _shifted(words), np.zeros_like(words), w["by_word"].transpose(0, 2, 1)
        own, members, weight, down = states[single], flat_tokens[single] % shape.members, weight[single], room.of("word_down", dtype, len(single), n)
        for group in _grouped(spans):
            first, last = group[0][1], group[-1][2]
            error = room.of("error", dtype, last - first, shape.members)
            for c, x, y in group:
                np.matmul(own[x:y], words[c], out=error[x - first:y - first])
            _errors(error, members[first:last], weight[first:last], shifted)
            for c, x, y in group:
                part = error[x - first:y - first]
                np.matmul(own[x:y].T, part, out=by_words[c])
                np.matmul(part, words_t[c], out=down[x:y])
        g["by_word"][:], g["word_bias"][:] = by_words[:, :n], by_words[:, n]
        by_state[single] += down
    to_state = room.of("to_state", dtype, steps, n, lanes)
    to_state[...] = by_state.reshape(steps, lanes, n).transpose(0, 2, 1)
    down = np.zeros_like(state)
    z, r = gates[:, :n], gates[:, n:]
    # Derivatives of the new state by what goes into the gates and into tanh; the way back multiplies them.
    by_row = room.of("by_row", dtype, steps, 3 * n, lanes)
    by_row[:, :n] = (before - fresh) * z * (1 - z)
    by_row[:, 2 * n:] = (1 - z) * (1 - fresh * fresh)
    by_row[:, n:2 * n] = by_row[:, 2 * n:] * kept_fresh * r * (1 - r)
    by_kept = room.of("by_kept", dtype, steps, 3 * n, lanes)
    by_kept[...] = by_row
    by_kept[:, 2 * n:] *= r
    back, by_gate = room.of("back", dtype, 3, n, lanes), by_kept.reshape(steps, 3, n, lanes)
    back_rows, downs = back.reshape(3 * n, lanes), room.of("downs", dtype, steps, n, lanes)
    for t in range(steps - 1, -1, -1):
        downs[t] = down
        np.multiply(by_gate[t], down, out=back)
        down *= z[t]
        down += np.matmul(w["keep"], back_rows)
        down += to_state[t]
    by_gate *= downs[:, None]
    g["keep"][:] = np.matmul(before, by_kept.transpose(0, 2, 1)).sum(0)
    by_row.reshape(steps, 3, n, lanes)[...] *= downs[:, None]
    rows[...] = by_row.transpose(0, 2, 1)
    order = np.argsort(flat_tokens.astype(np.int16 if shape.words + shape.groups < 1 << 15 else np.int32), kind="stable")
    ordered = flat_tokens[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    dealt = np.take(rows.reshape(-1, 3 * n), order, axis=0, out=room.of("taken", dtype, count, 3 * n), mode="clip")
    g["take"][ordered[first]] = np.add.reduceat(dealt, first, axis=0)
    return g, state.T


def train(w: Weights, blocks: Sequence[np.ndarray], shape: Shape, window: int = 32, lanes: int = 64, rate: float = 0.01, piece: int = 16_384) -> Weights:
    """One pass over the blocks in their order (Adam); truncated backpropagation, the state carried over a block's windows."""
    values = flat(w, shape)
    w = _views(values, shape)
    # The moments are kept as plain sums of what fades, so that their factors join those of the step.
    mean, square, step = np.zeros_like(values), np.zeros_like(values), 0
    part, root, room = np.empty_like(values), np.empty_like(values), _Room()
    for at in range(0, len(blocks), lanes):
        some = blocks[at:at + lanes]
        length = max(len(b) for b in some)
        tokens = np.zeros((length, len(some)), np.int64)
        valid = np.zeros((length, len(some)), bool)
        for k, b in enumerate(some):
            tokens[:len(b), k], valid[:len(b), k] = b, True
        h = np.zeros((len(some), shape.hidden), np.float32)
        for t in range(0, length, window):
            _, h = _gradients(w, tokens[t:t + window], valid[t:t + window], h, shape, room)
            g, step = room.of("gradients", values.dtype, len(values)), step + 1
            scale = (0.01 / (1 - 0.99**step)) ** 0.5
            # In pieces that caches hold.
            for a in range(0, len(values), piece):
                own = slice(a, a + piece)
                gradient, first, second, some_part, some_root = g[own], mean[own], square[own], part[own], root[own]
                first *= np.float32(0.9)
                first += gradient
                second *= np.float32(0.99)
                second += np.multiply(gradient, gradient, out=some_part)
                np.sqrt(second, out=some_root)
                some_root += np.float32(1e-6 / scale)
                np.divide(first, some_root, out=some_part)
                some_part *= np.float32(rate * 0.1 / (1 - 0.9**step) / scale)
                values[own] += some_part
    return w
