"""Worst-case sequences under a predictor, and scores of given sequences.

A predictor is anything that maps a context (tuple of ids) to log-probabilities of all ids. Searches
run whole in one task for each start; scoring is a join (``operators.model``).
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from sparkquill.functions.coder import Encoder

Predictor = Callable[[tuple[int, ...]], np.ndarray]


def normalise(candidates: Sequence[int], size: int) -> list[int]:
    """Sorted distinct ids, each of the vocabulary, at least one."""
    ids = sorted(set(candidates))
    if not ids or ids[0] < 0 or ids[-1] >= size:
        raise ValueError("candidates must be some ids of the vocabulary")
    return ids


def trimmed(tokens: Sequence[int], most: int, kept: int, cyclic: bool = True) -> tuple[int, ...]:
    """The context after given tokens: it shrinks to ``kept`` at ``most`` and grows again, or stays there."""
    n = len(tokens)
    if n < most:
        return tuple(tokens)
    return tuple(tokens[n - (kept + (n - most) % (most - kept) if cyclic else kept) :])


def by_objective(logp: np.ndarray, candidates: list[int], increment: Callable[[int], int] | None = None) -> list[int]:
    """Candidates from the worst: most bits, or most bits a byte where an increment is given; ties by id."""
    score = {}
    for v in candidates:
        if not np.isfinite(logp[v]):
            continue
        width = 1 if increment is None else increment(v)
        if width > 0:
            score[v] = -logp[v] / np.log(2) / width
    return sorted(score, key=lambda v: (-score[v], v))


def masked_logp(logp: np.ndarray, candidates: list[int], target: int) -> float:
    """Renormalised over the candidates; a target outside is an error."""
    if target not in candidates:
        raise ValueError("the target is no candidate")
    own = logp[candidates]
    top = own.max()
    return float(logp[target] - top - np.log(np.exp(own - top).sum()))


@dataclass
class Generation:
    """A generated sequence with full and masked log-probabilities of what follows its start."""

    tokens: list[int]
    start: int
    logp: list[float] = field(default_factory=list)
    masked: list[float] = field(default_factory=list)

    def summary(self) -> dict:
        bits = [-x / np.log(2) for x in self.logp]
        return {"total_tokens": len(self.tokens), "generated_tokens": len(self.logp), "distinct_tokens": len(set(self.tokens)), "surprisal_bits": float(sum(bits)), "mean_surprisal_bits": float(np.mean(bits)) if bits else 0.0}


def greedy(predict: Predictor, start: Sequence[int], length: int, candidates: list[int], most: int, kept: int, valid: Callable[[list[int]], bool] | None = None, width: Callable[[list[int], int], int] | None = None, resume: Generation | None = None) -> Generation:
    """The worst valid candidate at each step; ``resume`` continues an earlier result."""
    out = Generation(list(resume.tokens), resume.start, list(resume.logp), list(resume.masked)) if resume else Generation(list(start), len(start))
    while len(out.tokens) < length:
        logp = predict(trimmed(out.tokens, most, kept))
        order = by_objective(logp, candidates, None if width is None else lambda v: width(out.tokens, v))
        pick = next((v for v in order if valid is None or valid([*out.tokens, v])), None)
        if pick is None:
            raise ValueError("no candidate is valid")
        out.logp.append(float(logp[pick]))
        out.masked.append(masked_logp(logp, candidates, pick))
        out.tokens.append(pick)
    return out


def uniform(predict: Predictor, start: Sequence[int], length: int, candidates: list[int], most: int, kept: int, seed: int, valid: Callable[[list[int]], bool] | None = None) -> Generation:
    """Candidates drawn without replacement until one is valid, at each step."""
    draw, out = random.Random(seed), Generation(list(start), len(start))
    while len(out.tokens) < length:
        pool = list(candidates)
        pick = None
        while pool and pick is None:
            k = draw.randrange(len(pool))
            pool[k], pool[-1] = pool[-1], pool[k]
            v = pool.pop()
            pick = v if valid is None or valid([*out.tokens, v]) else None
        if pick is None:
            raise ValueError("no candidate is valid")
        logp = predict(trimmed(out.tokens, most, kept))
        out.logp.append(float(logp[pick]))
        out.masked.append(masked_logp(logp, candidates, pick))
        out.tokens.append(pick)
    return out


def beam(predict: Predictor, start: Sequence[int], length: int, candidates: list[int], most: int, kept: int, beam_width: int, branch: int, width: Callable[[list[int], int], int] | None = None, interval: Callable[[np.ndarray, int], tuple[int, int, int]] | None = None, overhead: int = 0) -> Generation:
    """The best sequence of a beam search.

    A beam's score is its bits by its bytes: entropy bits, or with ``interval`` the overhead and the
    length of a coder that is cloned for each extension. Ties go to the smaller ids.
    """
    beams = [(0.0, list(start), [], [], 0, Encoder())]
    while len(beams[0][1]) < length:
        grown = []
        for _, tokens, logs, masks, size, code in beams:
            logp = predict(trimmed(tokens, most, kept, cyclic=False))
            for v in by_objective(logp, candidates, None if width is None else lambda x, t=tokens: width(t, x))[:branch]:
                step = 1 if width is None else width(tokens, v)
                if interval is None:
                    nxt, total = code, -(sum(logs) + float(logp[v])) / np.log(2)
                else:
                    nxt = code.clone()
                    nxt.put(*interval(logp, v))
                    total = overhead + nxt.finished_length()
                grown.append((total / (8 * (size + step)), [*tokens, v], [*logs, float(logp[v])], [*masks, masked_logp(logp, candidates, v)], size + step, nxt))
        if not grown:
            raise ValueError("no candidate is valid")
        beams = sorted(grown, key=lambda b: (-b[0], b[1]))[:beam_width]
    best = beams[0]
    return Generation(best[1], len(start), best[2], best[3])


def rescored(predict: Predictor, tokens: Sequence[int], start: int, candidates: list[int], most: int, kept: int) -> Generation:
    """Full and masked scores of a fixed sequence."""
    out = Generation(list(tokens), start)
    for i in range(start, len(tokens)):
        logp = predict(trimmed(tokens[:i], most, kept))
        out.logp.append(float(logp[tokens[i]]))
        out.masked.append(masked_logp(logp, candidates, tokens[i]))
    return out


def speculative(draft: Predictor, verify: Predictor, start: Sequence[int], length: int, ahead: int) -> tuple[list[int], dict]:
    """The verifier's greedy tokens, found by accepting a draft's longest matching prefix at a time."""
    tokens, n = list(start), {"accepted": 0, "rejected": 0, "abandoned": 0, "cycles": 0}
    best = lambda p, t: int(np.argmax(p(tuple(t))))  # noqa: E731  the lowest id among equals
    while len(tokens) < length:
        n["cycles"] += 1
        proposal: list[int] = []
        for _ in range(min(ahead, length - len(tokens))):
            proposal.append(best(draft, tokens + proposal))
        for k, v in enumerate(proposal):
            right = best(verify, tokens)
            tokens.append(right)
            if right != v:
                n["rejected"] += 1
                n["abandoned"] += len(proposal) - k - 1
                break
            n["accepted"] += 1
    a, r, ab = n["accepted"], n["rejected"], n["abandoned"]
    return tokens, n | {"acceptance_rate": a / max(1, a + r), "proposal_efficiency": a / max(1, a + r + ab)}
