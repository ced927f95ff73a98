"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from cabflow.llm.bpe_codec import op9_bpe_codec
from cabflow.llm.divergence import OP12_SQL, op12_source_divergence
from cabflow.llm.embedding_dedup import OP1_SQL, op1_embedding_dedup
from cabflow.llm.hmm import op7_hmm_scores
from cabflow.llm.licenses import op13_license_scan
from cabflow.llm.line_dedup import OP5_SQL, op5_line_dedup
from cabflow.llm.minhash import op4_near_duplicates
from cabflow.llm.mixing import op3_mix_sources
from cabflow.llm.periodic import op11_periodic_runs
from cabflow.llm.quality import OP2_SQL, op2_quality_rules
from cabflow.llm.records import op8_token_records
from cabflow.llm.repeats import OP6_SQL, op6_suffix_dedup
from cabflow.llm.token_counts import op10_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup,
        op2_quality_rules,
        op3_mix_sources,
        op4_near_duplicates,
        op5_line_dedup,
        op6_suffix_dedup,
        op7_hmm_scores,
        op8_token_records,
        op9_bpe_codec,
        op10_token_counts,
        op11_periodic_runs,
        op12_source_divergence,
        op13_license_scan,
    )
}
#: The others have no plain SQL form; their tests hold them against brute force.
ORACLE_SQL = {
    "op1_embedding_dedup": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_suffix_dedup": OP6_SQL,
    "op12_source_divergence": OP12_SQL,
}
