"""What Python workers keep between tasks."""

import public_tokenizers
import pyarrow as pa

from cabflow.llm import bpe_codec as B
from cabflow.llm import common as C


def test_powers_are_right_and_the_kept_ones_bounded():
    base = int(C._ODD)
    for n in (0, 5, C.POWERS_STEP - 1, C.POWERS_STEP, C.KEPT_POWERS + 7, 3):
        got = C.powers(n)
        assert len(got) == n + 1
        for k in {0, n // 2, n}:
            assert int(got[k]) == pow(base, k, 1 << 64)
    assert all(len(table) <= C.KEPT_POWERS for table in C._POWERS.values())


def test_codec_keeps_no_pieces_after_its_task(spark, monkeypatch):
    """The task's function runs here as in a worker: its codec remembers pieces only until the batches end."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "one two two"), (2, "three")], "doc_id long, text string")
    held = []

    def captured(self, run, schema, *_, **__):
        if "piece" in str(schema):
            return real(self, run, schema)
        held.append(run)
        return self

    kind = type(docs)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", captured)
    B.bpe_codec(docs, tokenizer, results=("n_tokens",), lexicon_size=10)
    made = []
    codec = B._codec.__wrapped__
    monkeypatch.setattr(B, "_codec", lambda *a: made.append(codec(*a)) or made[-1])
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two two", "three"]})
    out = list(held[0](iter([batch])))
    assert out[0].num_rows == 2 and len(made[0].pieces.pieces) == 0
