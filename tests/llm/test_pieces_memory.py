"""Encoding forgets units and gives memory back on its way, without changing the pieces."""

import pyarrow as pa

from maskwright.llm import common, sentencepiece


def test_memory_goes_back_within_a_task(monkeypatch):
    texts = [f"word{k} other{k * 7} тест{k % 5}\n" * 40 for k in range(60)]
    pieces = sentencepiece.load()
    want, counts = sentencepiece.Encoder(pieces)(texts)
    trims, sizes = [], []
    monkeypatch.setattr(sentencepiece, "KEPT_UNITS", 20)
    monkeypatch.setattr(sentencepiece, "TRIM_SLICES", 2)
    monkeypatch.setattr(sentencepiece, "trim", lambda: trims.append(1))
    monkeypatch.setattr(sentencepiece, "slices", lambda t: common.slices(t, 4096))
    encoder, column, ids, many = sentencepiece.Encoder(pieces), pa.array(texts), [], []
    for at, to, _, _ in sentencepiece._trimmed(column):
        some, n = encoder(column.slice(at, to - at).to_pylist())
        ids += some.tolist()
        many += n.tolist()
        sizes.append(len(encoder.number))
    assert ids == want.tolist() and many == counts.tolist()
    assert len(trims) == len(sizes) // 2 > 5
    assert max(sizes) < 60
