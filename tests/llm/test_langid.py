import numpy as np

from dualview.llm import langid


def test_windows_cover_every_byte_and_every_filter():
    for n in (0, 1, 3, 255, 256, 257, 509, 510, 5000):
        w, size = langid.windows_of("a" * n)
        assert size.sum() >= n and (w != 0).sum(axis=1).tolist() == size.tolist()
        starts = np.arange(len(w)) * (langid.WINDOW - 3)
        assert all(any(s <= p and p + 4 <= s + langid.WINDOW for s in starts) for p in range(max(0, n - 3)))


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    net = langid.fit(docs.where(langid.fold("doc_id", 3) != 1))
    got = langid.predict(docs.where(langid.fold("doc_id", 3) == 1).select("doc_id", "lang", "text"), net).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_odd_rows(odd, empty):
    net = langid.fit(odd)
    got = langid.predict(odd, net).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got} == {"en", "und"}
    unread = langid.predict(odd.select("doc_id", "text"), langid.fit(empty)).collect()
    assert {(r["lang_pred"], r["score"]) for r in unread} == {("und", 0.0)}
    assert langid.predict(empty, net).count() == 0
    texts = ["123 !!", None, "", "é", "½", "²", "Ⅷ", "①", "ª", "漢"]
    assert [a for a, _ in net.predict(texts)] == ["und", "und", "und", "en", "und", "und", "und", "und", "en", "en"]


def plain_network(net, window):
    """Probabilities of one window, filter by filter and place by place."""
    e = [[*net.embed[b]] for b in window] + [[0.0] * langid.EMBED] * (max(langid.WIDTHS) - 1)
    top = []
    for f in range(net.filters.shape[1]):
        width = langid.WIDTHS[f // langid.FILTERS]
        best = max(sum(e[p + i][d] * net.filters[i * langid.EMBED + d, f] for i in range(width) for d in range(langid.EMBED)) for p in range(langid.WINDOW))
        top.append(max(best + net.bias[f], 0.0))
    z = [sum(t * net.out[f, c] for f, t in enumerate(top)) + net.out_bias[c] for c in range(len(net.langs))]
    high = max(z)
    total = sum(np.exp(v - high) for v in z)
    return [np.exp(v - high) / total for v in z]


def some_net(seed):
    rng = np.random.default_rng(seed)
    net = langid.ByteNet(["a", "b", "c"])
    net.embed = rng.normal(0, 0.5, net.embed.shape)
    net.embed[0] = 0
    net.filters = rng.normal(0, 0.3, net.filters.shape) * langid.ByteNet.mask()
    net.bias = rng.normal(0, 0.1, net.bias.shape)
    net.out, net.out_bias = rng.normal(0, 0.5, (net.filters.shape[1], 3)), rng.normal(0, 0.5, 3)
    return net


def test_network_equals_plain_version():
    net = some_net(1)
    w, _ = langid.windows_of("Ein kurzer Text, nicht mehr. " * 9)
    assert np.allclose(net.probabilities(w), [plain_network(net, x) for x in w], atol=1e-5)


def test_gradient_equals_differences():
    net = some_net(2)
    x, y = langid.windows_of("abc def ghij " * 60)[0], np.array([0, 2, 1, 1])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(len(y)), y]).mean()
    x = x[: len(y)]
    net.embed, net.filters = net.embed.astype(np.float64), net.filters.astype(np.float64)
    grad, rng = net.gradient(x, y[: len(x)]), np.random.default_rng(0)
    y = y[: len(x)]
    for name in ("filters", "bias", "out", "out_bias", "embed"):
        value = getattr(net, name)
        flat = np.flatnonzero(np.abs(grad[name]) > 1e-4)
        for i in rng.permutation(flat)[:6]:
            at = np.unravel_index(i, value.shape)
            held = value[at]
            value[at] = held + 1e-4
            high = loss()
            value[at] = held - 1e-4
            low = loss()
            value[at] = held
            assert abs((high - low) / 2e-4 - grad[name][at]) < 2e-2 * max(0.05, abs(grad[name][at]))


def test_copies_and_many_languages(spark):
    rows = [("a", "same text again and again " * 20)] * 300 + [(f"l{i}", f"wort{i} " * 50) for i in range(80)]
    found = langid.sample(spark.createDataFrame(rows, "lang string, text string"), "text", "lang")
    assert len({name for name, _, _ in found}) == 81 and sum(name == "a" for name, _, _ in found) <= langid.TRAIN_WINDOWS
