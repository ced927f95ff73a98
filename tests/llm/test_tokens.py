"""Token counts, codec and records against the library itself."""

import random
import zlib

import numpy as np
import pytest
from corpus_cases import BYTE_BPE, TEXTS, WORD_BPE, plain
from tokenizers import Tokenizer

from cabflow.llm.bpe_codec import bpe_codec, decode
from cabflow.llm.bpe_vocab import spaced_pieces, vocabulary
from cabflow.llm.common import scratch_path
from cabflow.llm.lexicon import Lexicon, build
from cabflow.llm.records import frame, read_records, unframe, write_records
from cabflow.llm.token_counts import count_text, merged_length

ODD = [t for _, t in TEXTS if t] + ["", " ", "  a", "a  ", "a\n b", "a \nb", "a  b", "'s 's", " 's'll x", "\0 a\0b", "\x1c x \x85 y", "aaaaaaaaaaaaaaaa" * 20]


def texts():
    return [t or "" for _, t, _ in plain()] + ODD


def test_counts_equal_the_library():
    library = Tokenizer.from_file(BYTE_BPE)
    for t in texts():
        assert count_text(t, BYTE_BPE) == len(library.encode(t, add_special_tokens=False).ids), t[:80]


def test_pieces_are_the_text():
    for t in texts():
        assert "".join(spaced_pieces(t)) == t


def test_merging_forms_agree():
    rng = random.Random(1)
    for path in (BYTE_BPE, WORD_BPE):
        vocab = vocabulary(path)
        words = ["".join(rng.choice("theraingésto'1") for _ in range(rng.randint(1, 60))).encode() for _ in range(600)]
        together = vocab.merge_words(words)
        assert together == [vocab.merge_long(w) for w in words]
        assert [len(x) for x in together] == [merged_length(vocab.symbols(w), vocab.ranks, vocab.made) for w in words]


def test_codec_equals_the_library(spark):
    library = Tokenizer.from_file(WORD_BPE)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in bpe_codec(docs, WORD_BPE, lexicon_size=50).collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids), r.text[:80]
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == decode(ids, WORD_BPE)


def test_lexicon_is_minimal_and_exact(tmp_path):
    entries = {w: [k, k + 1][: 1 + k % 2] for k, w in enumerate([b"tap", b"taps", b"top", b"tops", b"a", b"zz"])}
    file = tmp_path / "lexicon.bin"
    file.write_bytes(build(entries))
    found = Lexicon(str(file))
    assert found.n_states == 6  # root, t, ta = to, tap = top, z, and one final state without arcs
    index = found.find([*entries, b"", b"t", b"tapsy", b"b", b"\xff"])
    assert [found.ids(i) for i in index[: len(entries)]] == list(entries.values())
    assert index[len(entries) :].tolist() == [-1] * 5
    file.write_bytes(build({}))
    assert Lexicon(str(file)).find([b"a"]).tolist() == [-1]


def test_records_round_trip_in_any_order(spark):
    library = Tokenizer.from_file(BYTE_BPE)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = scratch_path(spark, "records")
    index = write_records(docs, BYTE_BPE, path, end_id=2, shard_rows=40)
    assert index.select("shard").distinct().count() > 2
    start = 0
    want = {}
    for i, t in rows:
        want[i] = (start, [*library.encode(t, add_special_tokens=False).ids, 2])
        start += len(want[i][1])
    shuffled = index.orderBy("n_bytes")
    got = {r.doc_id: r for r in read_records(shuffled, path, results=("ids", "ids_crc32")).collect()}
    for i, (start, ids) in want.items():
        assert (got[i].start, got[i].ids, got[i].n_ids) == (start, ids, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_damaged_records_are_refused():
    record = frame(b"payload")
    assert unframe(record) == b"payload"
    for at in range(len(record)):
        with pytest.raises(ValueError):
            unframe(record[:at] + bytes([record[at] ^ 1]) + record[at + 1 :])
    with pytest.raises(ValueError):
        unframe(record[:-1])
