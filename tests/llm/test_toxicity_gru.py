"""Gradients, windows, and held-out accuracy of the recurrent network."""

import random
import zlib

import numpy as np

from scorelens.llm.toxicity_gru import STRIDE, WINDOW, Network, read_words, toxicity


def slice_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def test_gradients_equal_finite_differences():
    w = read_words(*slice_of(["a bad word here, and Another one", "b c", "", "x y z " * 30]))
    network = Network()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    random_ = np.random.RandomState(0)
    for name in network.p:
        network.p[name] = network.p[name] + random_.normal(size=network.p[name].shape) * 0.1
    keep = np.ones((len(w.bucket), 1))
    goal = random_.normal(size=len(w.windows))
    found = network.gradients(w, lambda logit: goal, keep)
    for name, slope in found.items():
        flat, used = network.p[name].reshape(-1), np.flatnonzero(np.abs(slope.reshape(-1)) > 1e-4)
        for i in used[:: max(1, len(used) // 4)][:5]:
            before, step = flat[i], 1e-3
            flat[i] = before + step
            up = float((network.logits(w) * goal).sum())
            flat[i] = before - step
            down = float((network.logits(w) * goal).sum())
            flat[i] = before
            assert abs((up - down) / (2 * step) - slope.reshape(-1)[i]) < 2e-3 + 0.02 * abs(slope.reshape(-1)[i]), name


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 31, 32, 33, 56, 57, 100, 1000):
        w = read_words(*slice_of([" ".join(f"w{i}" for i in range(n)), "end"]))
        mine = w.windows[w.window_row == 0]
        names = mine[mine < len(w.bucket)]
        assert len(set(names.tolist())) == n
        assert (len(mine) > 1) == (n > WINDOW)
        if n > WINDOW:
            assert STRIDE < WINDOW and (mine < len(w.bucket)).all()


def test_held_out_accuracy_nulls_repeats_and_no_rows(spark):
    rng = random.Random(4)
    rude = ["grumbling", "Zwock!", "ploofer,"]
    docs, labels = [], []
    for i in range(700):
        text = ["".join(rng.choice("etaoinsrh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 150))]
        toxic = int(rng.random() < 0.4)
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(rude))
        docs.append((i, " ".join(text), toxic, "x"))
        labels.append((i, toxic))
    odd = [(None, "ploofer, zwock", None, None), (1000, None, None, None), (1001, "", None, None), (1002, "nice " * 30000 + "zwock! ploofer grumbling", None, None)]
    frame = spark.createDataFrame(docs + odd + docs[:2], "doc_id long, text string, score int, logit string").repartition(4)
    truth = spark.createDataFrame(labels + [(None, 1), (3, None), (5000, 1), (1001, 7)], "doc_id long, toxic int")
    got = toxicity(frame, truth).collect()
    assert len(got) == 706
    right = []
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
        if r.held_out and r.doc_id < 700:
            right.append(r.predicted == labels[r.doc_id][1])
    assert np.mean(right) > 0.93
    assert all(r.score == 0 for r in got if r.doc_id in (1000, 1001))
    assert toxicity(frame.limit(0), truth.limit(0)).collect() == []
