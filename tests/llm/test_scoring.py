import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from areaframe.llm.gatednet import Net, Shape, Tokens, Trainer
from areaframe.llm.scoring import score_documents, train

from .reference import lower, words


def test_base_score_and_counts(spark):
    texts = ["the cat sat on the mat", "The dog sat", None, "", "unseen words only here", "the the the"] * 3
    docs = [(i, t, "en") for i, t in enumerate(texts)] + [(99, texts[0], None), (99, texts[0], None)]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _, _ in docs}
    counts = Counter(w for d, t, _ in docs if not held[d] for w in [*words(lower(t)), 0])
    n, v = sum(counts.values()), len(counts)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    for listed in (1, 3, 1 << 18):
        got = score_documents(frame, held_out, listed=listed).collect()
        assert len(got) == len(docs)
        for r in got:
            tokens = [*words(lower(dict((d, t) for d, t, _ in docs)[r.doc_id])), 0]
            assert (r.n_tokens, r.n_known) == (len(tokens), sum(counts[t] > 0 for t in tokens))
            assert (r.held_out, r.train_tokens) == (held[r.doc_id], n)
            base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
            assert abs(r.base_score - base) < 1e-6
            assert r.score < 0
    assert score_documents(frame.limit(0), held_out).collect() == []


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    shape = Shape(inputs=7, classes=4, learnt=2, words=3, hidden=5)
    params = {k: (rng.standard_normal(x.shape) * 0.5).astype(np.float64) for k, x in shape.empty().items()}
    x = rng.integers(0, 7, (4, 3))
    keep = np.ones((4, 3))
    classes = rng.integers(0, 4, 12)
    inner = np.where(classes < 2, rng.integers(0, 3, 12), -1)
    weight = np.ones(12)

    def loss():
        hs, _ = Net(shape, params).states(x, keep, np.zeros((3, 5)))
        return -Net(shape, params).log_probabilities(hs.reshape(-1, 5).astype(np.float64), classes, inner, weight).mean()

    net, trace, grads = Net(shape, params), [], {}
    hs, _ = net.states(x, keep, np.zeros((3, 5)), trace)
    _, dh = net.log_probabilities(hs.reshape(-1, 5), classes, inner, weight, grads)
    net.back(x, keep, trace, dh.reshape(hs.shape), grads)
    for name in grads:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in params[name].shape)
            own, step = params[name][at], 1e-3
            params[name][at] = own + step
            up = loss()
            params[name][at] = own - step
            down = loss()
            params[name][at] = own
            assert abs((up - down) / (2 * step) - grads[name][at]) < 3e-3, name


def test_model_learns_and_sums_to_one():
    shape = Shape(inputs=7, classes=3, learnt=2, words=3, hidden=8)
    net = Net(shape, shape.empty())
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.r_[np.tile([0, 3, 1, 4], 5), 2] if rng.random() < 0.5 else np.r_[np.tile([5, 0], 9), 2] for _ in range(300)])
    bounds = np.r_[0, np.flatnonzero(ids == 2) + 1]
    tokens = Tokens(ids, ids // 3, np.where(ids < 6, ids % 3, -1), bounds)
    before = net.score(tokens).mean()
    trainer = Trainer(net, width=16)
    for _ in range(20):
        trainer.fit(tokens)
    assert net.score(tokens).mean() > before / 3
    h = rng.standard_normal((1, 8)).astype(np.float32).repeat(7, 0)
    every = np.arange(7)
    logs = net.log_probabilities(h, every // 3, np.where(every < 6, every % 3, -1), None)
    assert abs(np.exp(logs).sum() - 1) < 1e-5


def test_learns_weights_for_1024_words(spark):
    frame = spark.createDataFrame([(" ".join(f"w{i}" for i in range(1500)), 0)], "text string, kin int")
    vocabulary = train(frame, "text", "kin", F.lit(1))[0]
    assert (vocabulary.words >= 0).sum() == 1024
