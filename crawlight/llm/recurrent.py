"""A gated recurrent network over tokens with a class-factored softmax, in numpy.

A token's probability is its class's times its own within the class.  Classes
come in groups (its group's, then its own within the group), so few exponents
are taken for a token.  Classes of frequent words have a softmax of their own
that follows the state; other classes keep fixed shares.  Documents are laid end to end in streams that run
side by side; the state is set to zero where a document starts and carried
across windows everywhere else, while gradients stop at a window's edge.
"""

from __future__ import annotations

import numpy as np

#: Input that stands before a document's first token.
START = 0


def streams_of(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Whole documents dealt to streams of similar length, at most ``most``."""
    total, longest = int(lengths.sum()), int(lengths.max(initial=1))
    n = max(1, min(most, -(-total // max(longest, 64)), len(lengths)))
    out: list[list[int]] = [[] for _ in range(n)]
    order = np.argsort(-lengths, kind="stable")
    # back and forth: streams end up within a document of each other
    for place, k in enumerate(order.tolist()):
        turn, at = divmod(place, n)
        out[at if turn % 2 == 0 else n - 1 - at].append(k)
    return out


def laid_out(sequences: list[tuple[np.ndarray, ...]], most: int) -> list[np.ndarray]:
    """Time by stream arrays of each component, and of the document; -1 where nothing is left."""
    lengths = np.array([len(s[0]) for s in sequences], np.int64)
    streams = streams_of(lengths, most)
    steps = max(int(sum(lengths[k] for k in s)) for s in streams)
    out = [np.full((steps, len(streams)), -1, np.int32) for _ in range(len(sequences[0]) + 1)]
    for b, s in enumerate(streams):
        at = 0
        for k in s:
            end = at + int(lengths[k])
            for array, values in zip(out, sequences[k], strict=False):
                array[at:end, b] = values
            out[-1][at:end, b] = k
            at = end
    return out


class GatedModel:
    """Gates from the last token and the state; heads for groups, their classes, and words of the small classes."""

    NAMES = ("gates", "state_zr", "state_n", "group_w", "group_b", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, inputs: int, class_shares: np.ndarray, members: list[np.ndarray], word_shares: np.ndarray, groups: np.ndarray | None = None, hidden: int = 16, seed: int = 1):
        """``members``: for each class its words' numbers in order, none for classes of fixed shares; ``groups``: each class's, ascending."""
        rng = np.random.default_rng(seed)
        normal = lambda *shape, by=0.1: rng.normal(0, by, shape).astype(np.float32)
        logs = lambda shares: np.log(np.maximum(shares, 1e-9)).astype(np.float32)
        self.members, self.hidden = members, hidden
        self.groups = np.arange(len(class_shares)) if groups is None else np.asarray(groups)
        self.group_bounds = np.searchsorted(self.groups, np.arange(int(self.groups.max(initial=-1)) + 2))
        self.params = [
            normal(inputs, 3 * hidden, by=0.3), normal(hidden, 2 * hidden), normal(hidden, hidden),
            normal(len(self.group_bounds) - 1, hidden), logs(np.bincount(self.groups, weights=class_shares, minlength=len(self.group_bounds) - 1)),
            normal(len(class_shares), hidden), logs(np.asarray(class_shares)),
            normal(len(word_shares), hidden, by=0.05), logs(np.asarray(word_shares)),
        ]
        self.params[0][:, :hidden] += 1.0  # states are kept at first

    @staticmethod
    def _resets(x: np.ndarray, kind: np.dtype) -> tuple[list[bool], np.ndarray]:
        """Which steps start a document in some stream, and 0 where one starts, else 1."""
        carried = (x != START).astype(kind)
        return (carried.min(1, initial=1) == 0).tolist(), carried

    def forward(self, x: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States of a window of inputs (steps by streams), and the last state.

        Inside, streams are the last axis, so that gates are contiguous blocks.  ``keep`` takes, for all
        steps at once, the states before, the gates with the fresh states, and the gated states.
        """
        gates, zr, nn = self.params[:3]
        k, kind = self.hidden, gates.dtype
        steps, streams = x.shape
        pre = np.ascontiguousarray(gates.take(x, axis=0).transpose(0, 2, 1))  # one gather for the whole window
        out = np.empty((steps, k, streams), kind)
        resets, carried = self._resets(x, kind)
        h = np.ascontiguousarray(h.T)
        if keep is not None:
            keep += [np.empty_like(out), pre, np.empty_like(out)]
        # a sigmoid is half a hyperbolic tangent of half its input: halves are exact, so all inputs are halved at once
        pre[:, : 2 * k] *= 0.5
        zr_t, nn_t = np.ascontiguousarray(zr.T) * kind.type(0.5), np.ascontiguousarray(nn.T)
        wide, product = np.empty((2 * k, streams), kind), np.empty((k, streams), kind)
        spare = np.empty((k, streams), kind)
        for t in range(steps):
            if resets[t]:
                h = h * carried[t]
            a, n = pre[t, : 2 * k], pre[t, 2 * k :]
            np.matmul(zr_t, h, out=wide)
            a += wide
            np.tanh(a, out=a)
            a += 1
            a *= 0.5
            rh = np.multiply(a[k:], h, out=spare if keep is None else keep[2][t])
            np.matmul(nn_t, rh, out=product)
            n += product
            np.tanh(n, out=n)
            if keep is not None:
                keep[0][t] = h
            # n + z (h - n)
            h = np.subtract(h, n, out=out[t])
            h *= a[:k]
            h += n
        return out.transpose(0, 2, 1), h.T

    def log_probabilities(self, states: np.ndarray, classes: np.ndarray, words: np.ndarray, grad: bool = False):
        """Natural logs for flat rows of states; ``words`` is -1 where the class has fixed shares.

        With ``grad`` also the gradients of minus the summed logs.
        """
        gw, gb, cw, cb, ww, wb = self.params[3:]
        # in order of classes every head works on a slice
        order = np.argsort(classes.astype(np.int16), kind="stable")
        sorted_states, sorted_classes, sorted_words = states.take(order, axis=0), classes[order], words[order]
        bounds = np.searchsorted(sorted_classes, np.arange(len(cb) + 1))
        logs, d = np.zeros(len(states)), np.zeros_like(sorted_states) if grad else None
        grads = [np.zeros_like(p) for p in (gw, gb, cw, cb, ww, wb)] if grad else []

        def head(a: int, b: int, own, target: np.ndarray, k: int) -> None:
            """Adds to rows a to b the logs of ``target`` among the entries ``own`` of head k."""
            w, bias, at = self.params[3 + k][own], self.params[4 + k][own], sorted_states[a:b]
            logits = w @ at.T
            logits += bias[:, None]
            logits -= logits.max(0)
            cells = target * (b - a) + np.arange(b - a)
            chosen = logits.ravel()[cells]
            e = np.exp(logits, out=logits)
            total = e.sum(0)
            logs[a:b] += chosen - np.log(total)
            if grad:
                e /= total
                e.ravel()[cells] -= 1
                grads[k][own] += e @ at
                grads[k + 1][own] += e.sum(1)
                d[a:b] += e.T @ w

        if len(states):
            head(0, len(states), slice(None), self.groups[sorted_classes], 0)
        for first, last in zip(self.group_bounds[:-1].tolist(), self.group_bounds[1:].tolist(), strict=True):
            a, b = int(bounds[first]), int(bounds[last])
            if b > a and last - first > 1:
                head(a, b, slice(first, last), sorted_classes[a:b] - first, 2)
        for c, members in enumerate(self.members):
            a, b = int(bounds[c]), int(bounds[c + 1])
            if b > a and len(members):
                # a class's words are numbered in a row, or in any order
                row = slice(int(members[0]), int(members[-1]) + 1) if members[-1] - members[0] + 1 == len(members) else members
                head(a, b, row, np.searchsorted(members, sorted_words[a:b]), 4)
        out = np.empty(len(states))
        out[order] = logs
        if not grad:
            return out
        places = np.empty_like(order)
        places[order] = np.arange(len(order))
        return out, d.take(places, axis=0), grads

    def backward(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of the gates' parameters, back through the window's steps."""
        gates, zr, nn = self.params[:3]
        k = self.hidden
        before, pre, gated = kept
        z, r, n = pre[:, :k], pre[:, k : 2 * k], pre[:, 2 * k :]
        # what each step's gradient is multiplied with
        to_n = (1 - z) * (1 - n * n)
        to_z = (before - n) * z * (1 - z)
        to_r = before * r * (1 - r)
        d_out = np.ascontiguousarray(d_out.transpose(0, 2, 1))
        d_pre = np.empty(pre.shape, d_out.dtype)
        resets, carried = self._resets(x, d_out.dtype)
        d_h = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            d_h += d_out[t]
            d = d_pre[t]
            np.multiply(d_h, to_n[t], out=d[2 * k :])
            d_rh = nn @ d[2 * k :]
            np.multiply(d_h, to_z[t], out=d[:k])
            np.multiply(d_rh, to_r[t], out=d[k : 2 * k])
            d_h *= z[t]
            d_rh *= r[t]
            d_h += d_rh
            d_h += zr @ d[: 2 * k]
            if resets[t]:
                d_h *= carried[t]
        d_gates = np.zeros_like(gates)
        flat = d_pre.transpose(0, 2, 1).reshape(-1, 3 * k)
        if x.size:
            order = np.argsort(x.astype(np.min_scalar_type(len(gates))), axis=None, kind="stable")
            inputs = x.ravel()[order]
            firsts = np.flatnonzero(np.r_[True, inputs[1:] != inputs[:-1]])
            d_gates[inputs[firsts]] = np.add.reduceat(flat.take(order, axis=0), firsts)
        rows = lambda a: a.transpose(0, 2, 1).reshape(-1, k)
        return [d_gates, rows(before).T @ flat[:, : 2 * k], rows(gated).T @ flat[:, 2 * k :]]

    def train(self, sequences: list[tuple[np.ndarray, np.ndarray, np.ndarray]], window: int = 32, streams: int = 128, rate: float = 0.01, epochs: int = 1) -> int:
        """Adam over (inputs, classes, words) of whole documents; returns the tokens seen."""
        if not sequences:
            return 0
        x, classes, words, _ = laid_out(sequences, streams)
        # all parameters lie in one array, of which each is a part
        flat_params, bounds = self.packed(), np.cumsum([0, *(p.size for p in self.params)])
        self.params = [flat_params[a:b].reshape(p.shape) for a, b, p in zip(bounds[:-1], bounds[1:], self.params, strict=True)]
        m, v, change, spare = (np.zeros_like(flat_params) for _ in range(4))
        seen = step = 0
        windows = -(-len(x) // window) * epochs
        for _ in range(epochs):
            h = np.zeros((x.shape[1], self.hidden), np.float32)
            for t in range(0, len(x), window):
                xs, live = np.maximum(x[t : t + window], 0), np.flatnonzero(x[t : t + window].ravel() >= 0)
                kept: list = []
                states, h = self.forward(xs, h, kept)
                flat = states.reshape(-1, self.hidden)
                own = (classes[t : t + window].ravel(), words[t : t + window].ravel())
                if len(live) == len(flat):
                    _, d_out, heads = self.log_probabilities(flat, *own, True)
                else:
                    _, d, heads = self.log_probabilities(flat[live], *(c[live] for c in own), True)
                    d_out = np.zeros_like(flat)
                    d_out[live] = d
                grads = self.backward(xs, kept, d_out.reshape(states.shape)) + heads
                seen += len(live)
                step += 1
                pace = rate * min(1.0, step / 20) * (1 - 0.8 * step / windows)
                g = np.concatenate([x.ravel() for x in grads])
                g /= len(live)
                np.clip(g, -1, 1, out=g)
                # m += 0.1 (g - m), v += 0.01 (g g - v), without arrays made anew
                np.subtract(g, m, out=change)
                change *= 0.1
                m += change
                g *= g
                g -= v
                g *= 0.01
                v += g
                np.divide(v, 1 - 0.99**step, out=spare)
                np.sqrt(spare, out=spare)
                spare += np.float32(1e-6)
                np.divide(m, 1 - 0.9**step, out=change)
                change *= np.float32(pace)
                change /= spare
                flat_params -= change
        return seen

    def score(self, sequences: list[tuple[np.ndarray, np.ndarray, np.ndarray]], window: int = 32, streams: int = 512) -> np.ndarray:
        """Natural log of each whole document's classes, and of its words in small classes."""
        out = np.zeros(len(sequences))
        if not sequences:
            return out
        x, classes, words, owner = laid_out(sequences, streams)
        h = np.zeros((x.shape[1], self.hidden), np.float32)
        for t in range(0, len(x), window):
            live = np.flatnonzero(x[t : t + window].ravel() >= 0)
            states, h = self.forward(np.maximum(x[t : t + window], 0), h)
            flat, own = states.reshape(-1, self.hidden), [a[t : t + window].ravel() for a in (classes, words, owner)]
            if len(live) < len(flat):
                flat, own = flat[live], [a[live] for a in own]
            out += np.bincount(own[2], weights=self.log_probabilities(flat, own[0], own[1]), minlength=len(out))
        return out

    def packed(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k, p in enumerate(self.params):
            self.params[k] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
