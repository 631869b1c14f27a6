"""What the workers of the pipeline's stages hold: figures a word, and that a task gives back what it held."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from barloom.llm import byte_bpe as bb
from barloom.llm import decontaminate as dc
from barloom.llm import language_id as li
from barloom.llm import storage


def peak(job):
    """The result of ``job`` and the bytes it held at most, and at its end."""
    tracemalloc.start()
    try:
        result = job()
        end, most = tracemalloc.get_traced_memory()
        return result, most, end
    finally:
        tracemalloc.stop()


def test_vectors_of_ngrams_are_kept_as_bits():
    space = li.Space()
    assert space.matrix.nbytes <= 8 << 20
    rng = random.Random(3)
    for dimensions in (1024, 60):  # 60: the last byte isn't full
        space = li.Space(dimensions)
        text = "".join(rng.choice("abcdefgh é") for _ in range(9_000)) + "".join(chr(0x4E00 + k) for k in range(5_000))
        letters = li.letters_of(text).tolist()
        want = np.zeros(dimensions)
        for k in range(len(letters) - 2):
            want += space._vector(letters[k] << 42 | letters[k + 1] << 21 | letters[k + 2])
        assert np.array_equal(np.round(space.bundle(text) * np.sqrt(want @ want), 2), want)


def test_a_shard_holds_numbers_not_words():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3_000)]
    phrases = dc.Phrases([("a", " ".join(words[:40]))], 13)
    texts = [" ".join(rng.choices(words, k=1_000)) for _ in range(200)]
    texts[7] = " ".join([*words[300:800], *words[5:25], *words[300:800]])
    found, most, _ = peak(lambda: dc.shard_hits(texts, phrases))
    assert [k for k, (_, spans, _) in enumerate(found) if spans] == [7] and found[7] == (1_020, [(500, 520)], ["a"])
    assert [n for n, _, _ in found] == [len(t.split()) for t in texts]
    assert most < 24 * sum(n for n, _, _ in found)
    assert dc.shard_hits([], phrases) == [] and dc.shard_hits([None, ""], phrases) == [(0, [], []), (0, [], [])]


def test_the_cache_of_words_is_bounded():
    bpe = bb.ByteBpe({bytes([b]): b for b in range(256)}, r"\S+|\s+")
    digests, rng = bb.Digests(bpe), random.Random(5)
    text = " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(20_000))
    _, _, end = peak(lambda: digests([text]))
    assert end / len(digests.known) * bb.CACHED < 100 << 20


def test_blocks_of_a_column_are_those_of_its_texts():
    rng = random.Random(6)
    for _ in range(50):
        texts = [None if rng.random() < 0.1 else "x" * rng.choice([0, 1, 5, 30]) for _ in range(rng.randrange(12))]
        got = list(bb.text_blocks(pa.array(texts, pa.string()), 20))
        assert [(at, at + len(own)) for at, own in got] == list(bb.blocks(texts, 20))
        assert [t for _, own in got for t in own] == texts


def test_a_task_gives_back_what_it_held(monkeypatch):
    said = []
    monkeypatch.setattr(storage, "give_back", lambda: said.append("given back"))
    batches = [pa.record_batch({"id": pa.array([k])}) for k in range(3)]

    def run(rows):
        for batch in rows:
            said.append(batch.column(0)[0].as_py())
            yield batch

    assert list(storage.lean(run)(iter(batches))) == batches and said == [0, 1, 2, "given back"]
    early = storage.lean(run)(iter(batches))
    next(early)
    early.close()
    assert said[4:] == [0, "given back"]
    monkeypatch.undo()
    storage.give_back()
