"""Suppression, the inference chain and the networks' parts against plain Python."""

import math
import tracemalloc

import numpy as np
import pytest

from nightloom.config import DEFAULT
from nightloom.operators import islands, learn


def _iou(a, b):
    both = max(min(a[1], b[1]) - max(a[0], b[0]), 0.0)
    whole = (a[1] - a[0]) + (b[1] - b[0]) - both
    return both / whole if whole > 0 else 0.0


def _suppress(events):
    kept = []
    for x in sorted(events, key=lambda x: (-x[2], x[3])):
        if all(_iou(x, y) <= DEFAULT.overlap for y in kept):
            kept.append(x)
    return kept


def test_suppression_is_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for rec in range(3):
        start = rng.integers(0, 900, 200).astype(float)
        rows += [(rec, k, float(s), float(s + rng.integers(0, 30)), float(rng.integers(0, 8)) / 8) for k, s in enumerate(start)]
    frame = spark.createDataFrame(rows, "rec long, ord long, start double, end double, avg_conf double").repartition(5)
    found = {(r.rec, r.ord) for r in islands.suppressed(frame, DEFAULT.overlap).collect()}
    expected = {(rec, x[3]) for rec in range(3) for x in _suppress([(r[2], r[3], r[4], r[1]) for r in rows if r[0] == rec])}
    assert found == expected
    assert islands.suppressed(frame.limit(0), DEFAULT.overlap).count() == 0


def test_inferred_index_is_brute_force(spark):
    rng = np.random.default_rng(2)
    windows, slow, expected = [], [], {}
    for rec in range(4):
        n = 3000
        spo2 = (96 - 4 * (rng.random(n) < 0.002 * rec)).astype(int)
        slow += [(rec, i, int(x)) for i, x in enumerate(spo2)]
        starts = list(range(0, n - 60, 30))
        labels = np.repeat(rng.integers(0, 5, len(starts)), rng.integers(1, 6, len(starts)))[: len(starts)].tolist()
        confs = rng.choice([0.2, 0.5, 0.8], len(starts)).tolist()
        windows += list(zip([rec] * len(starts), starts, labels, confs))
        runs = []
        for s, label, conf in [*zip(starts, labels, confs), (None, 0, 1.0)]:
            if label == 0 or conf < DEFAULT.confidence:
                runs.append(None)
            elif runs and runs[-1] and runs[-1][0] == label:
                runs[-1][2] = s + 60
                runs[-1][3].append(conf)
            else:
                runs.append([label, s, s + 60, [conf]])
        kept = []
        for label, s, e, own in filter(None, runs):
            if e - s > 120:
                parts = int((e - s) / 60)
                kept += [(s + k * (e - s) / parts, s + (k + 1) * (e - s) / parts, float(np.mean(own)), label) for k in range(parts)]
            elif label != 4 or spo2[max(0, s - 30) : s + 10].max() - spo2[s : e + 30].min() >= 2:
                kept.append((float(s), float(e), float(np.mean(own)), label))
        alone = _suppress([(s, e, c, k, label) for k, (s, e, c, label) in enumerate(kept)])
        expected[rec] = [sum(x[4] == k for x in alone) for k in (1, 2, 3, 4)], len(alone) / (n / 3600)
    windows = spark.createDataFrame(windows, "rec long, start long, label long, conf double").repartition(3)
    slow = spark.createDataFrame([*slow, (9, 0, 95)], "rec long, i long, spo2 long")
    found = {r.rec: r for r in learn.inferred_index(learn.inferred_events(windows, slow, 60), slow).collect()}
    for rec, (counts, ahi) in expected.items():
        r = found[rec]
        assert [r.obstr, r.cntrl, r.mixed, r.hypop] == counts and r.ahi == pytest.approx(ahi)
    assert found[9].ahi == 0 and found[9].obstr == 0


def test_parts_of_the_rotary_network():
    rng = np.random.default_rng(3)
    net = learn.Mira(3, seed=2)
    x, t = rng.normal(size=(2, 4, 5, 8)), np.arange(5.0)
    turned = net.rotate(x, t)
    for pair in range(4):
        z = (x[..., 2 * pair] + 1j * x[..., 2 * pair + 1]) * np.exp(1j * t * 10000 ** (-pair / 4))
        assert np.allclose(turned[..., 2 * pair], z.real) and np.allclose(turned[..., 2 * pair + 1], z.imag)


def test_erf():
    x = np.concatenate((np.linspace(-7, 7, 4001), [0.0, 1e-9]))
    assert np.allclose(learn.erf(x), [math.erf(v) for v in x], atol=1e-12)


def _norm(v, norm):
    return [(a - np.mean(v)) / math.sqrt(np.var(v) + 1e-5) * g + b for a, g, b in zip(v, norm.gain, norm.bias)]


def _expert(v, expert):
    h = [sum(v[i] * expert.up.w[i, o] for i in range(len(v))) + expert.up.b[o] for o in range(4 * len(v))]
    return np.array([0.5 * a * (1 + math.erf(a / math.sqrt(2))) for a in h]) @ expert.down.w + expert.down.b


def test_the_rotary_network_token_by_token():
    """The whole forward pass against loops over tokens, heads and experts."""
    rng = np.random.default_rng(4)
    net = learn.Mira(2, classes=3, dims=8, layers=2, heads=2, experts=3, top=2, seed=5)
    for block in net.blocks:
        for norm in (block.before_attention, block.before_experts):
            norm.gain, norm.bias = rng.normal(1, 0.1, 8), rng.normal(0, 0.1, 8)
    x = rng.normal(size=(2, 5, 2))
    for own, logits in zip(x, net(x)):
        state = [v @ net.embed.w + net.embed.b for v in own]
        for block in net.blocks:
            normal = [np.array(_norm(v, block.before_attention)) for v in state]
            heads = []
            for h in range(2):
                part = slice(4 * h, 4 * h + 4)
                q, k, v = ([(n @ m.w)[part] for n in normal] for m in (block.query, block.key, block.value))
                turn = lambda y, t: np.concatenate([[y[2 * i] * math.cos(t * 100.0**-i) - y[2 * i + 1] * math.sin(t * 100.0**-i), y[2 * i] * math.sin(t * 100.0**-i) + y[2 * i + 1] * math.cos(t * 100.0**-i)] for i in range(2)])
                out = []
                for i in range(5):
                    score = np.exp([turn(q[i], i) @ turn(k[j], j) / 2 for j in range(5)])
                    out.append(sum(s * v[j] for j, s in enumerate(score / score.sum())))
                heads.append(out)
            state = [s + np.concatenate((heads[0][i], heads[1][i])) @ block.out.w for i, s in enumerate(state)]
            mixed = []
            for s in state:
                v = np.array(_norm(s, block.before_experts))
                gate = v @ block.gate.w + block.gate.b
                top = sorted(range(3), key=lambda e: (-gate[e], e))[:2]
                share = np.exp(gate[top]) / np.exp(gate[top]).sum()
                shared = 1 / (1 + math.exp(-(v @ block.shared_gate.w + block.shared_gate.b)[0]))
                mixed.append(s + sum(w * _expert(v, block.experts[e]) for w, e in zip(share, top)) + shared * _expert(v, block.shared))
            state = mixed
        state = [np.array(_norm(s, net.norm)) for s in state]
        inner, outer = net.flow
        f = lambda y: np.tanh(np.append(y, 0.25) @ inner.w + inner.b) @ outer.w + outer.b
        y = state[-1]
        for _ in range(4):
            a = f(y)
            b = f(y + 0.125 * a)
            c = f(y + 0.125 * b)
            d = f(y + 0.25 * c)
            y = y + 0.25 / 6 * (a + 2 * b + 2 * c + d)
        assert np.allclose(logits, (np.mean(state, axis=0) + y) @ net.head.w + net.head.b)


def test_equal_gates_go_by_number():
    block = learn.Mira(3, dims=8, seed=2).blocks[0]
    block.gate.w[:], block.gate.b[:] = 0, 0
    z = np.random.default_rng(1).normal(size=(1, 2, 8))
    expected = (block.experts[0](z) + block.experts[1](z)) / 2 + block.shared(z) / (1 + np.exp(-block.shared_gate(z)))
    assert np.allclose(block.mixture(z), expected)


def test_the_convolutional_network_step_by_step():
    rng = np.random.default_rng(6)
    net = learn.CNN(2, 3, seed=1)
    for layer in net.layers:
        layer.update(b=rng.normal(size=len(layer["b"])), gamma=rng.normal(1, 0.2, len(layer["b"])), mean=rng.normal(size=len(layer["b"])), var=rng.uniform(0.5, 2, len(layer["b"])))
    x = rng.normal(size=(1, 17, 2))
    own = x[0]
    for layer in net.layers:
        size, out = layer["w"].shape[1], []
        for t in range(0, (len(own) - 1) // 2 + 1):
            total = layer["b"].copy()
            for k in range(size):
                at = 2 * t + k - size // 2
                if 0 <= at < len(own):
                    total += layer["w"][:, k] @ own[at]
            out.append(np.maximum((total - layer["mean"]) / np.sqrt(layer["var"] + 1e-5) * layer["gamma"] + layer["beta"], 0))
        own = np.array(out)
    assert np.allclose(net(x)[0], own.mean(axis=0) @ net.head[0] + net.head[1])


def test_erf_works_in_blocks():
    """It needs little memory besides its result, however long the input is, and has the same values for any shape."""
    x = np.linspace(-7, 7, 40_000).reshape(200, 200)
    tracemalloc.start()
    found = learn.erf(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * x.nbytes
    assert np.array_equal(found.T, learn.erf(x.T)) and np.allclose(found.ravel(), [math.erf(v) for v in x.ravel()], atol=1e-12)
