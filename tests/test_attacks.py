import numpy as np
import pytest

from sparkquill.operators import attacks


def fixed(logits):
    z = np.array(logits, float)
    return lambda ctx: z - np.log(np.exp(z).sum())


def test_contexts_shrink_and_grow():
    assert [len(attacks.trimmed(list(range(n)), 4, 2)) for n in range(1, 9)] == [1, 2, 3, 2, 3, 2, 3, 2]
    assert attacks.trimmed([1, 2, 3, 4, 5], 4, 2, cyclic=False) == (4, 5)


def test_worst_tokens_validator_and_masks():
    assert attacks.greedy(fixed([3, -2, 0]), [0], 2, [0, 1, 2], 9, 2).tokens == [0, 1]
    assert attacks.greedy(fixed([-5, 4, 2]), [0], 2, [1, 2], 9, 2).tokens == [0, 2]
    asked = []
    valid = lambda t: asked.append(t[-1]) or t[-1] != 1
    assert attacks.greedy(fixed([2, -4, -2, 1]), [0], 2, [0, 1, 2, 3], 9, 2, valid=valid).tokens == [0, 2] and asked == [1, 2]
    with pytest.raises(ValueError):
        attacks.normalise([3], 3)
    with pytest.raises(ValueError):
        attacks.masked_logp(np.zeros(3), [1, 2], 0)
    assert attacks.normalise([2, 0, 2], 3) == [0, 2]


def test_generation_and_resume():
    predict = fixed([2, -3, 0])
    whole = attacks.greedy(predict, [0], 8, [0, 1, 2], 4, 2)
    part = attacks.greedy(predict, [0], 5, [0, 1, 2], 4, 2)
    assert part.tokens == [0, 1, 1, 1, 1]
    assert attacks.greedy(predict, [0], 8, [0, 1, 2], 4, 2, resume=part) == whole
    again = attacks.rescored(predict, whole.tokens, 1, [0, 1, 2], 4, 2)
    assert np.allclose(again.logp, whole.logp) and np.allclose(again.masked, whole.masked)
    summary = whole.summary()
    assert summary["generated_tokens"] == 7 and summary["distinct_tokens"] == 2
    assert attacks.Generation([1], 1).summary()["mean_surprisal_bits"] == 0.0


def test_objectives_differ():
    logp, width = np.array([0.0, -8, -10]), {1: 1, 2: 4}
    assert attacks.by_objective(logp, [1, 2])[0] == 2 and attacks.by_objective(logp, [1, 2], width.get)[0] == 1
    assert attacks.by_objective(logp, [1, 2], lambda v: v - 1) == [2]


def test_beam_beats_greedy_and_random_is_seeded():
    table = {(0,): [0, -4, -3], (0, 1): [0, 0, 0], (0, 2): [0, -20, 0]}

    def predict(ctx):
        z = np.array(table[tuple(ctx)], float)
        return z - np.log(np.exp(z).sum())

    assert attacks.beam(predict, [0], 3, [0, 1, 2], 9, 2, 2, 3).tokens == [0, 2, 1]
    assert attacks.greedy(predict, [0], 3, [0, 1, 2], 9, 2).tokens[1] == 1
    flat = fixed([0, 0, 0])
    a, b = (attacks.uniform(flat, [0], 6, [1, 2], 9, 2, 7) for _ in range(2))
    assert a == b and set(a.tokens[1:]) <= {1, 2}
    with pytest.raises(ValueError):
        attacks.uniform(flat, [0], 3, [1, 2], 9, 2, 7, valid=lambda t: False)


def test_beam_with_a_real_coder_prefers_more_bits():
    predict = fixed([0, -1, -5])
    cum = {0: (0, 700), 1: (700, 960), 2: (960, 1024)}
    got = attacks.beam(predict, [0], 5, [0, 1, 2], 9, 2, 2, 3, interval=lambda logp, v: (*cum[v], 1024), overhead=32)
    assert got.tokens == [0, 2, 2, 2, 2]


def test_speculation_gives_the_verifiers_tokens():
    verify = lambda t: np.array([float((sum(t) * 7 + v * 3) % 5) for v in range(5)])
    draft = lambda t: verify(t) if len(t) % 3 else -verify(t)
    plain = [1]
    while len(plain) < 20:
        plain.append(int(np.argmax(verify(tuple(plain)))))
    tokens, n = attacks.speculative(draft, verify, [1], 20, 4)
    assert tokens == plain and n["rejected"] > 0 and n["accepted"] + n["rejected"] == 19
    tokens, n = attacks.speculative(verify, verify, [1], 20, 4)
    assert tokens == plain and n["acceptance_rate"] == 1.0
