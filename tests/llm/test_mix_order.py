"""The mixing stage hands on its schedule: rows are written in slot order and the last stage can restore it."""

import collections
import random

import pytest
from corpus_cases import SF

import corpus_pipeline
from cabflow.llm.common import cut
from cabflow.llm.mixing import mix_sources


@pytest.fixture(scope="module")
def hot(spark):
    """One source with most of the rows, and several part files."""
    rng = random.Random(3)
    names = ["hot"] * 12 + ["b", "c", None]
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(0, 900))), rng.choice(names)) for i in range(900)]
    return cut(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), "hot")


@pytest.fixture(scope="module")
def parts(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_rows_come_in_the_order_of_the_schedule(spark, hot, parts):
    stages = dict(corpus_pipeline.STAGES)
    mixed = cut(stages["mix_sources"](spark, hot, SF), "mixed")
    assert mixed.columns == hot.columns and len(mixed.inputFiles()) > 5
    out = stages["bpe_codec"](spark, mixed, SF).select("doc_id", "source", "mix_part", "mix_row").orderBy("mix_part", "mix_row").collect()
    plan = mix_sources(hot).collect()
    slot_of = {(r.doc_id, r.copy): r.slot for r in plan}
    assert len(out) == len(plan) and len({(r.mix_part, r.mix_row) for r in out}) == len(out)
    copies, slots = collections.Counter(), []
    for r in out:
        slots.append(slot_of[r.doc_id, copies[r.doc_id]])
        copies[r.doc_id] += 1
    assert slots == sorted(slots)
    # The sources follow each other as the schedule says.
    source_of = {r.slot: r.source for r in plan}
    assert [r.source for r in out] == [source_of[s] for s in slots] and len(set(slots)) > 20
