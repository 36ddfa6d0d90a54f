"""What is learned, against trainers that share no code with it."""

import math
import random
import re

import numpy as np
import pytest

from tests.llm import fixtures


def features(text):
    """The words, and beginnings of four and five letters, of each sentence."""
    out = []
    for s in re.split(r"[.!?\n]+", text):
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", s)}
        if words:
            out.append(words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5})
    return out


def objective(bags, labels, weights, bias, decay):
    """Balanced mean log-likelihood of documents under the noisy-or, less the penalty."""
    share = sum(labels) / len(labels)
    total = 0.0
    for bag, y in zip(bags, labels):
        none = -sum(math.log1p(math.exp(bias + sum(weights.get(w, 0.0) for w in s))) for s in bag)
        ll = math.log(max(-math.expm1(none), 1e-12)) if y else none
        total += ll * (0.5 / share if y else 0.5 / (1 - share))
    return total / len(labels) - decay / (2 * len(labels)) * sum(x * x for x in weights.values())


def plain_trainer(bags, labels, words, bias_most, decay, steps=1500, rate=1.0):
    """Gradient ascent with steps halved whenever they don't help; one document at a time, no vectors shared with the operator."""
    weights, bias = dict.fromkeys(words, 0.0), bias_most
    share = sum(labels) / len(labels)
    best = objective(bags, labels, weights, bias, decay)
    for _ in range(steps):
        grad = {w: -decay * x / len(labels) for w, x in weights.items()}
        down = 0.0
        for bag, y in zip(bags, labels):
            z = [bias + sum(weights.get(w, 0.0) for w in s) for s in bag]
            none = math.exp(-sum(math.log1p(math.exp(x)) for x in z))
            pull = (none / max(1 - none, 1e-12) * 0.5 / share) if y else -0.5 / (1 - share)
            for s, x in zip(bag, z):
                g = pull / (1 + math.exp(-x)) / len(labels)
                down += g
                for w in s:
                    if w in grad:
                        grad[w] += g
        while rate > 1e-9:
            new = {w: x + rate * grad[w] for w, x in weights.items()}
            new_bias = min(bias_most, bias + rate * down)
            value = objective(bags, labels, new, new_bias, decay)
            if value > best:
                weights, bias, best, rate = new, new_bias, value, rate * 2
                break
            rate /= 4
        else:
            break
    return weights, bias, best


def test_op9_fit_is_as_good_as_a_plain_trainer(spark):
    from waymark.llm import toxicity

    rng = random.Random(11)
    calm = [w for w in fixtures.words(rng, 60).split() if len(w) > 1]
    texts, toxic = [], []
    for i in range(120):
        said = [" ".join(rng.sample(calm, 4)) for _ in range(rng.randint(1, 3))]
        y = int(i % 3 == 0)
        if y or rng.random() < 0.05:
            said.insert(rng.randint(0, len(said)), rng.choice(["vilex rubbish", "you foulo", "vilexes all"]))
        texts.append(". ".join(said))
        toxic.append(y)
    docs = fixtures.frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in toxicity.sample(docs, labels).collect())
    weights, bias = toxicity.fit(toxicity.sample(docs, labels))
    bags, y = [features(t) for _, t, _ in rows], [x for _, _, x in rows]
    decay = 0.02
    got = objective(bags, y, weights, bias, decay)
    plain, plain_bias, best = plain_trainer(bags, y, list(weights), toxicity.CALM, decay)
    assert got >= best - 0.02  # it may be better, not clearly worse
    chance = lambda bag, w, b: 1 - math.exp(-sum(math.log1p(math.exp(b + sum(w.get(x, 0.0) for x in s))) for s in bag))
    agree = sum((chance(b, weights, bias) >= 0.5) == (chance(b, plain, plain_bias) >= 0.5) for b in bags)
    assert agree >= 0.97 * len(bags)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_op10_weights_are_the_best_on_held_out_counts(seed):
    """No mixture on a fine grid of the simplex gives the held-out tokens of a bucket a higher likelihood."""
    from waymark.llm import lm

    rng = np.random.default_rng(seed)
    truth = rng.dirichlet([2, 2, 2])
    e = rng.dirichlet([0.5] * 40, size=3)  # three estimates of the chances of forty words
    held = rng.multinomial(5000, truth @ e).astype(float)
    rows = sorted((30, *e[:, k].tolist(), held[k]) for k in range(40))
    got = lm.order_weights(rows)[30]
    like = lambda w: float(held @ np.log(np.maximum(w @ e, 1e-300)))
    grid = [np.array([a, b, 100 - a - b]) / 100 for a in range(101) for b in range(101 - a)]
    assert abs(got.sum() - 1) < 1e-9 and (got >= 0).all()
    assert like(got) >= max(map(like, grid)) - 1e-3 * abs(like(got))
    assert np.abs(got - truth).max() < 0.1


def test_op10_word_weight_is_the_best_on_held_out_counts():
    from waymark.llm import lm

    rng = np.random.default_rng(4)
    counts = np.append(rng.integers(1, 30, 200), np.zeros(201)).astype(float)  # words that only the deleted part has, and one that no part has
    size, known = counts.sum(), 400
    chance = 0.7 * counts / size + 0.3 / (known + 1)
    held = rng.poisson(chance * 4000).astype(float)
    got = lm.word_weight(list(zip(counts, held)), size, known)
    like = lambda w: float(held @ np.log(w * counts / size + (1 - w) / (known + 1)))
    assert like(got) >= max(like(w) for w in np.linspace(0.001, 0.999, 999)) - 0.5
    assert abs(got - 0.7) < 0.1
