import random
import zlib

import numpy as np

from parallax.llm.byte_cnn import CHUNK, ByteCNN, chunks_of, score_quality, train_quality


def test_chunks_cover_every_byte():
    sizes = [0, 1, CHUNK - 1, CHUNK, CHUNK + 1, 5000]
    data = np.random.default_rng(1).integers(1, 256, sum(sizes)).astype(np.uint8)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    x, row, weight = chunks_of(data, offs)
    assert np.allclose(np.bincount(row, weight), 1)
    for r, n in enumerate(sizes):
        own = x[row == r]
        assert (own != 0).sum() >= n and (n == 0 or own[-1][own[-1] != 0][-1] == data[offs[r + 1] - 1])


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    net = ByteCNN()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = rng.integers(32, 120, 1800).astype(np.uint8)
    offs, y = np.array([0, 700, 1800]), np.array([1.0, 0.0])
    x, row, weight = chunks_of(data, offs)

    def loss():
        z = np.bincount(row, weight * net.chunk_logits(x), 2)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = net.gradients(x, row, weight, y)
    for k, p in net.p.items():
        flat = p.reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-6 - g[k].reshape(-1)[i]) < 1e-3, k


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = train_quality(docs, labels)
    again = ByteCNN.from_bytes(model.to_bytes())
    assert all(np.array_equal(a, again.p[k]) for k, a in model.p.items())
    score = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    held = [(r.quality, score[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in score]
    right = [(s >= 0.3) == (q == 1) for q, s in held]
    good = [s >= 0.3 for q, s in held if q == 1]
    bad = [s < 0.3 for q, s in held if q == 0]
    print(len(held), sum(right) / len(right), sum(good) / len(good), sum(bad) / len(bad))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) > 0.8


def test_odd_rows(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(("good", "fine")) if i % 2 else rng.choice(("###", "$$$")) for _ in range(30))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "good " * 30_000), (None, "fine"), (103, rows[1][1])]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    model = train_quality(docs, labels)
    got = {r.doc_id: r.score for r in score_quality(docs, model, carry=("source",)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values()) and got[100] == got[101] and abs(got[103] - got[1]) < 1e-6
    assert got[102] > 0.5 and got[0] < 0.5
    assert train_quality(docs, labels.limit(0)) is None and {r.score for r in score_quality(docs, None).collect()} == {0.5}
    assert score_quality(docs.limit(0), model).count() == 0
