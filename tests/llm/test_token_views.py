"""Chunks encoded together, and sequences and masks as views of their file."""

import random

import numpy as np
import pyarrow as pa

from panelspark.llm import arrow_pack
from panelspark.llm.queries import tokenizer_file


def test_chunks_encoded_together_equal_each_text_alone():
    encoder = arrow_pack.Encoder(tokenizer_file("byte_bpe_50k.json"))
    rng = random.Random(31)
    pieces = ["a", "don't", "x<|endoftext|>", "Ġ", "Ġword", "é", "日本", "🙂", "12,5", "!!", " ", "a\nb", "tab\tin", "\x00", "'s", "q" * 200, ""]
    texts = [" ".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(400)] + ["", " ", "  ", "<|endoftext|> a", "w" * 1_000_000]
    got = encoder.encode(texts)
    for text, raw in zip(texts, got):
        assert np.frombuffer(raw, encoder.width).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_ids_and_masks_are_views_of_the_mapped_file(tmp_path):
    writer = arrow_pack.ShardWriter(str(tmp_path), 32, "<u2")
    ids = np.arange(1000, dtype="<u2")
    writer.write([1, 2], [ids[:700].tobytes(), ids[700:].tobytes()])
    name = writer.close().column("name")[0].as_py()
    before = pa.total_allocated_bytes()
    held = [arrow_pack.views(str(tmp_path), name, k) for k in range(32)]
    # buffers of the mapping are not allocations of Arrow's pools
    assert pa.total_allocated_bytes() - before < 32 * 32
    flat = np.concatenate([i.to_numpy()[m.to_numpy(zero_copy_only=False)] for i, m in held])
    assert (flat == ids).all()
    assert all(len(i) == len(m) == 32 for i, m in held)
