"""Every log-mel frame of a long segment is in one window of the operator's output."""

import numpy as np

from seqframe.llm import media


def test_all_frames_of_long_segments(spark):
    text = "".join(map(chr, np.random.default_rng(6).integers(33, 127, 60_000)))
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    rows = {r.doc_id: media.read(r.windows) for r in media.audio(df).collect()}
    x = np.frombuffer(media.payload_of(text.encode()), np.uint8).astype(np.float32)
    mels, energy = media.log_mel(media.resample((x - x.mean()) / 128, media.STORED_RATE, media.RATE))
    spans = media.segments(energy)
    want = np.concatenate([mels[a:b] for a, b in spans]).astype(np.float32)
    assert max(b - a for a, b in spans) > 3 * media.WINDOW
    stored = rows[1]
    assert stored.schema.equals(media.WINDOWS) and stored.column("mel").type.shape == list(media.SHAPE)
    tensors, frames = stored.column("mel").to_numpy_ndarray(), stored.column("frames").to_pylist()
    assert np.array_equal(np.concatenate([t[:n] for t, n in zip(tensors, frames)]), want)
    assert all((t[n:] == media.FLOOR).all() for t, n in zip(tensors, frames))
    assert stored.column("segment").to_pylist() == [k for k, (a, b) in enumerate(spans) for _ in range(a, b, media.WINDOW)]
    starts = [a * media.HOP / media.RATE for first, last in spans for a in range(first, last, media.WINDOW)]
    assert stored.column("start").to_pylist() == starts and rows[2].num_rows == 1


def plainly(payload):
    """The features of a short payload by their definitions: zero stuffing, direct sums, loops over frames."""
    x = np.frombuffer(payload, np.uint8).astype(float)
    x = (x - x.mean()) / 128
    n = media.HALF * 2  # two samples to one
    t = np.arange(-n, n + 1)
    h = np.sinc(t / 2) * np.hamming(2 * n + 1)
    h /= h.sum()
    y = np.array([sum(h[k + n] * x[2 * i - k] for k in range(-n, n + 1) if 0 <= 2 * i - k < len(x)) for i in range(-(-len(x) // 2))])
    count = 1 + max(0, -(-(len(y) - media.FRAME) // media.HOP))
    y = np.r_[y, np.zeros((count - 1) * media.HOP + media.FRAME - len(y))]
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(2595 * np.log10(1 + 60 / 700), 2595 * np.log10(1 + media.RATE / 2 / 700), media.MELS + 2)]
    mels, energy = [], []
    for i in range(count):
        f = y[i * media.HOP : i * media.HOP + media.FRAME]
        energy.append(10 * np.log10((f**2).mean() + 1e-10))
        w = f * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1)))
        power = [abs(sum(w * np.exp(-2j * np.pi * k * np.arange(media.FRAME) / media.FFT))) ** 2 for k in range(media.FFT // 2 + 1)]
        bank = [sum(p * max(0, min((hz - a) / (b - a), (c - hz) / (c - b))) for p, hz in zip(power, np.arange(media.FFT // 2 + 1) * media.RATE / media.FFT)) for a, b, c in zip(edges, edges[1:], edges[2:])]
        mels.append(np.log10(np.array(bank) + 1e-10))
    peak, spans, i = max(energy), [], 0
    while i < count:
        j = i
        while j < count and energy[j] >= peak - 12:
            j += 1
        if j > i and max(energy[i:j]) >= peak - 6:
            spans.append((i, j))
        i = max(j, i + 1)
    return np.array(mels), np.array(energy), spans


def test_features_by_definition():
    rng = np.random.default_rng(2)
    payload = media.payload_of(("a" * 700 + "".join(map(chr, rng.integers(33, 127, 900))) + "b" * 1200 + "".join(map(chr, rng.integers(33, 127, 500)))).encode())
    mels, energy, spans = plainly(payload)
    x = np.frombuffer(payload, np.uint8).astype(np.float32)
    got, loud = media.log_mel(media.resample((x - x.mean()) / 128, media.STORED_RATE, media.RATE))
    assert np.abs(loud - energy).max() < 1e-3 and np.abs(got - mels).max() < 1e-2 and media.segments(loud) == spans and spans
    found = media.features(payload, media.STORED_RATE)
    assert np.abs(np.concatenate([w["mel"].reshape(media.SHAPE)[: w["frames"]] for w in found]) - np.concatenate([mels[a:b] for a, b in spans])).max() < 1e-2
