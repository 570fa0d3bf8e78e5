"""A log-bilinear language model in numpy, trained by noise-contrastive estimation.

The next token's vector is predicted from the vectors of the tokens before it, each
scaled by weights of its distance; the score of a token is the product of the
predicted vector with the token's own output vector, plus a bias. Training tells the true
token from noise drawn by token frequency, so it never sums over the vocabulary.
Scoring does: scores of all tokens for a block of positions are one matrix product,
and their exponentials are summed, so the log-probabilities are normalised.

Tokens are numbers below ``size``; ``size`` itself stands for what precedes a text.
"""

from __future__ import annotations

import numpy as np

WIDTH = 16
CONTEXT = 4
NOISE = 24
BATCH = 1024
RATE = 0.2
NAMES = ("given", "output", "bias", "weights")


class LogBilinear:
    """given, output: a vector for each token; weights: of each distance, by component; bias: log frequency to begin with."""

    def __init__(self, frequency: np.ndarray, width: int = WIDTH, context: int = CONTEXT, seed: int = 1):
        noise = np.maximum(frequency.astype(np.float64), 1e-9)
        self.noise = noise / noise.sum()
        self.size, self.context = len(noise), context
        rng = np.random.default_rng(seed)
        self.given = rng.normal(0, 0.1, (self.size + 1, width)).astype(np.float32)
        self.output = rng.normal(0, 0.1, (self.size, width)).astype(np.float32)
        self.bias = np.log(self.noise).astype(np.float32)
        self.weights = np.full((context, width), 1 / context, np.float32)
        self.squares = {name: np.full_like(getattr(self, name), 1e-3) for name in NAMES}

    def laid_out(self, texts: list[np.ndarray]) -> np.ndarray:
        """The tokens of all texts, with ``context`` starts before each."""
        start = np.full(self.context, self.size, np.int64)
        return np.concatenate([part for text in texts for part in (start, text)] or [start])

    def predicted(self, vectors: np.ndarray) -> np.ndarray:
        """The predicted vectors of all places but the first ``context``, from the vectors of the places before each."""
        c, n = self.context, len(vectors)
        out = vectors[c - 1 : n - 1] * self.weights[0]
        for i in range(1, c):
            out += vectors[c - 1 - i : n - 1 - i] * self.weights[i]
        return out

    def gradients(self, ids: np.ndarray, noise: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of every parameter for telling the tokens from ``noise``, drawn once for all of them.

        ``ids`` begins with ``context`` places that are only looked back to; starts
        are no tokens. The loss (see ``loss``) is the sum over the tokens: each is
        told from every noise token, which counts with the log of its expected
        number, log(len(noise) * p), as does the token itself.
        """
        c, n = self.context, len(ids) - self.context
        true = ids[c:]
        real = true < self.size
        true = np.where(real, true, 0)
        log_noise = np.log(len(noise) * self.noise).astype(np.float32)
        vectors = self.given[ids]
        hidden, mine, theirs = self.predicted(vectors), self.output[true], self.output[noise]
        score = np.einsum("ij,ij->i", hidden, mine) + (self.bias - log_noise)[true]
        g_true = -real.astype(np.float32) / (1 + np.exp(score))
        fake = hidden @ theirs.T
        fake += (self.bias - log_noise)[noise]
        np.negative(fake, out=fake)
        np.exp(fake, out=fake)
        fake += 1
        g_fake = np.divide(real[:, None].astype(np.float32), fake, out=fake)
        g_true = g_true.astype(np.float32)
        g_hidden = g_fake @ theirs
        g_hidden += g_true[:, None] * mine
        out = {name: np.zeros_like(getattr(self, name)) for name in NAMES}
        width = hidden.shape[1]
        place = ids[:, None] * width + np.arange(width)  # in a table of vectors
        out["output"] += sums(np.where(real[:, None], place[c:], 0), g_true[:, None] * hidden, out["output"])
        out["output"] += sums(noise[:, None] * width + np.arange(width), g_fake.T @ hidden, out["output"])
        out["bias"] += np.bincount(true, g_true, self.size).astype(np.float32)
        out["bias"] += np.bincount(noise, g_fake.sum(axis=0), self.size).astype(np.float32)
        g_vectors = np.zeros_like(vectors)
        for i in range(c):
            g_vectors[c - 1 - i : c - 1 - i + n] += g_hidden * self.weights[i]
            out["weights"][i] = np.einsum("ij,ij->j", g_hidden, vectors[c - 1 - i : c - 1 - i + n])
        out["given"] += sums(place, g_vectors, out["given"])
        return out

    def loss(self, ids: np.ndarray, noise: np.ndarray) -> float:
        """What ``gradients`` descends."""
        true = ids[self.context :]
        kept, hidden = true < self.size, self.predicted(self.given[ids])
        log_noise = np.log(len(noise) * self.noise)
        scores = hidden[kept].astype(np.float64) @ self.output.T.astype(np.float64) + self.bias - log_noise
        mine = scores[np.arange(len(scores)), true[kept]]
        return float(np.logaddexp(0, -mine).sum() + np.logaddexp(0, scores[:, noise]).sum())

    def learn(self, texts: list[np.ndarray], rng: np.random.Generator) -> None:
        """One pass over the tokens of ``texts``, ``BATCH`` places a step, with steps by Adagrad."""
        ids, edges = self.laid_out(texts), np.cumsum(self.noise)
        for first in range(self.context, len(ids), BATCH):
            drawn = np.minimum(np.searchsorted(edges, rng.random(NOISE)), self.size - 1)
            for name, found in self.gradients(ids[first - self.context : first + BATCH], drawn).items():
                seen = self.squares[name]
                seen += found * found
                found /= np.sqrt(seen)
                found *= np.float32(RATE)
                getattr(self, name)[...] -= found

    def log_probabilities(self, texts: list[np.ndarray]) -> np.ndarray:
        """The natural log-probability of every token of the texts, one text after the other."""
        ids = self.laid_out(texts)
        # the bias is one more component, by which every predicted vector has 1
        output, ones = np.concatenate([self.output.T, self.bias[None, :]]), np.ones(self.size, np.float32)
        out, scores = np.empty(len(ids) - self.context), np.empty((BATCH, self.size), np.float32)
        for first in range(self.context, len(ids), BATCH):
            window = ids[first - self.context : first + BATCH]
            true = window[self.context :]
            n = len(true)
            hidden = np.ones((n, len(output)), np.float32)
            hidden[:, :-1] = self.predicted(self.given[window])
            s = np.dot(hidden, output, out=scores[:n])
            mine = s[np.arange(n), np.minimum(true, self.size - 1)].astype(np.float64)
            if s.max() > 60:  # the sum of exponentials could overflow
                top = s.max(axis=1, keepdims=True)
                s -= top
                mine -= top[:, 0]
            np.exp(s, out=s)
            out[first - self.context : first - self.context + n] = mine - np.log((s @ ones).astype(np.float64))
        return out[ids[self.context :] < self.size]

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in NAMES])

    def set_parameters(self, flat: np.ndarray) -> None:
        start = 0
        for name in NAMES:
            value = getattr(self, name)
            value[...] = flat[start : start + value.size].reshape(value.shape)
            start += value.size


def sums(places: np.ndarray, values: np.ndarray, like: np.ndarray) -> np.ndarray:
    """An array like ``like`` with ``values`` summed at ``places`` of its flat form."""
    return np.bincount(places.ravel(), values.ravel(), like.size).astype(np.float32).reshape(like.shape)
